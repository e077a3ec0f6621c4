"""Registers, clusters and alias logs against plain loops over random logs."""

import random
from pathlib import Path
from urllib.parse import urlparse

import pytest

from quillmark.operators import aliases, clusters, identity
from quillmark.sources.folders import shared_folder

OBSERVED = "seq long, source_observation_id string, namespace string, value string, native_version string, title string, fingerprint string, manifestation_kind string, landing_url string, publication_status string, observed_at long, source_updated_at long, published_at long"


def observation(rng, seq, spread):
    pick = lambda *x: rng.choice(x)
    return (seq, f"o{rng.randrange(spread)}", "doi", f"10.1/{rng.randrange(spread)}", pick("1", "2", None), pick("T", "U"), pick("a", "b") * 64, pick("preprint", "preprint", "publication"), "https://a", pick("published", "published", "unknown"), 10, pick(None, 5), pick(None, 7))


def replayed(rows):
    said, kinds, about, out = {}, {}, {}, {}
    for r in sorted(rows):
        seq, source, _, value, version, title, content, kind, url, status, at, updated, published = r
        if not title or title != title.strip() or kind not in identity.MANIFESTATION_KINDS or len(content) != 64 or updated is not None and updated > at:
            out[seq] = ("invalid_observation", False, False)
            continue
        if said.get(source, r[1:]) != r[1:]:
            out[seq] = ("source_observation_conflict", False, False)
        elif kinds.get(value, kind) != kind:
            out[seq] = ("manifestation_conflict", False, False)
        elif about.get((value, content), (version, title, updated, published)) != (version, title, updated, published):
            out[seq] = ("revision_conflict", False, False)
        else:
            out[seq] = (None, value not in kinds, (value, content) not in about)
            said[source], kinds[value], about[value, content] = r[1:], kind, (version, title, updated, published)
    return out


@pytest.mark.parametrize("seed,spread", [(1, 5), (2, 40), (3, 150)])
def test_register(spark, seed, spread):
    rng = random.Random(seed)
    rows = [observation(rng, i, spread) for i in range(200)]
    rows += [(200 + i, *rng.choice(rows)[1:]) for i in range(60)]  # the same again
    rows += [(300, "o1", "doi", "10.1/1", None, " T", "a" * 64, "preprint", "https://a", "published", 10, None, None), (301, "o2", "doi", "10.1/1", None, "T", "a" * 64, "book", "https://a", "published", 10, None, None), (302, "o3", "doi", "10.1/3", None, "T", "a" * 64, "notice", "https://a", "published", 10, 11, None)]
    got = {r.seq: (r.error, r.created_work, r.created_revision) for r in identity.registered(spark.createDataFrame(rows, OBSERVED).repartition(3)).collect()}
    assert got == replayed(rows)
    found = {e for e, _, _ in got.values()}
    assert found >= {None, "invalid_observation", "source_observation_conflict"} and (spread < 40 or {"manifestation_conflict", "revision_conflict"} & found)


def test_rounds_of_a_register_write_only_what_is_open(spark):
    """However many rounds a log takes, its rows are written about twice."""
    rng = random.Random(7)
    rows = [observation(rng, i, 4000) for i in range(12_000)]
    observations = spark.createDataFrame(rows, OBSERVED).repartition(4)
    size = lambda: sum(p.stat().st_size for p in Path(urlparse(shared_folder(spark)).path).rglob("*") if p.is_file())
    before = size()
    got = {r.seq: (r.error, r.created_work, r.created_revision) for r in identity.registered(observations).collect()}
    assert got == replayed(rows)
    assert size() - before < 250 * len(rows)


def test_ids_follow_from_what_is_observed(spark):
    rng = random.Random(5)
    rows = [observation(rng, i, 30) for i in range(60)]
    found = [r for r in identity.registered(spark.createDataFrame(rows, OBSERVED)).collect() if not r.error]
    assert len({(r.work_id, r.manifestation_id) for r in found}) == len({r.work_id for r in found}) == sum(r.created_work for r in found)
    assert len({r.revision_id for r in found}) == sum(r.created_revision for r in found)
    assert identity.registered(spark.createDataFrame([], OBSERVED)).count() == 0


@pytest.mark.parametrize("n,m,seed", [(30, 10, 1), (300, 280, 2), (400, 900, 3)])
def test_connected(spark, n, m, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(1000, 1200)] + [(2000, i) for i in range(2001, 2100)]
    root = {x: x for e in edges for x in e}

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = up(a), up(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in clusters.connected(spark.createDataFrame(edges, "a long, b long").repartition(3), "a", "b").collect()}
    assert got == {x: up(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}


def test_observed_works(spark):
    rows = [(1, ["a", "b"]), (2, ["b", "c", None]), (3, ["d"]), (4, ["e", "f"]), (5, ["f", "e", "e"]), (6, []), (7, None), (8, ["g", "h"])]
    known = [("c", "w1"), ("d", "w2"), ("e", "w3"), ("f", "w4"), ("x", "w5"), ("g", "w6"), ("h", "w6")]
    got = clusters.observed_works(spark.createDataFrame(rows, "observation_id long, identifiers array<string>"), spark.createDataFrame(known, "identifier string, work_id string"))
    assert {r.observation_id: (r.cluster, r.status, r.work_id) for r in got.collect()} == {
        1: ("a", "known", "w1"), 2: ("a", "known", "w1"), 3: ("d", "known", "w2"), 4: ("e", "conflict", None), 5: ("e", "conflict", None),
        6: (None, "unidentified", None), 7: (None, "unidentified", None), 8: ("g", "known", "w6"),
    }


def merged_one_by_one(log, works):
    live, gone, out = {}, set(), {}

    def root(x):
        hops = 0
        while x in live:
            x, hops = live[x][0], hops + 1
        return x

    for seq, action, alias, canonical, evidence in sorted(log):
        if alias not in works or action == "merge" and canonical not in works:
            out[seq] = ("work_missing", None)
        elif action == "merge":
            target = root(canonical)
            if alias in live:
                out[seq] = ("replayed" if live[alias] == (target, evidence) else "alias_conflict", target)
            elif alias == target:
                out[seq] = ("alias_cycle", target)
            else:
                live[alias] = (target, evidence)
                out[seq] = ("merged", target)
        elif alias not in live:
            out[seq] = ("alias_missing", None)
        else:
            target = live[alias][0]
            if (alias, target) in gone:
                out[seq] = ("alias_revocation_conflict", target)
            else:
                gone.add((alias, target))
                del live[alias]
                out[seq] = ("revoked", target)
    return out


@pytest.mark.parametrize("n_works,n,revoked,seed", [(4, 40, 0.3, 1), (12, 60, 0.2, 2), (60, 60, 0.5, 3)])
def test_merges_one_by_one(spark, n_works, n, revoked, seed):
    rng = random.Random(seed)
    log = []
    for i in range(n):
        kind = "revoke" if rng.random() < revoked else "merge"
        log.append((i * 3, kind, rng.randrange(n_works), rng.randrange(n_works) if kind == "merge" else None, rng.choice("xy")))
    works = set(range(n_works)) - {1}
    df = spark.createDataFrame(log, "seq long, action string, alias_id long, canonical_id long, evidence string").repartition(3)
    got = {r.seq: (r.outcome, r.root) for r in aliases.decided(df, spark.createDataFrame([(w,) for w in works], "work_id long")).collect()}
    assert got == merged_one_by_one(log, works)


def test_rounds_of_merges_are_few_jobs(spark):
    """Each round is a fold and not a dozen of joins, and what no merge names isn't part of rounds until the rest is settled."""
    rng = random.Random(4)
    log = [(i, "merge" if rng.random() < 0.8 else "revoke", rng.randrange(12) if i < 60 else i, rng.randrange(12), rng.choice("xy")) for i in range(300)]
    df = spark.createDataFrame(log, "seq long, action string, alias_id long, canonical_id long, evidence string")
    works = spark.createDataFrame([(w,) for w in range(300)], "work_id long")
    spark.sparkContext.setJobGroup("merges", "")
    got = {r.seq: (r.outcome, r.root) for r in aliases.decided(df, works).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("merges"))
    spark.sparkContext.setJobGroup("", "")
    assert got == merged_one_by_one(log, set(range(300)))
    assert jobs < 150


def test_long_chains_of_merges(spark):
    """Each root becomes an alias in turn; what was merged before follows, up to the bound."""
    log = [(0, "merge", 100, 0, "x")] + [(i, "merge", i - 1, i, "x") for i in range(1, 8)] + [(20, "merge", 200, 100, "x"), (21, "merge", 201, 0, "x"), (22, "revoke", 3, None, "x"), (23, "merge", 202, 100, "x")]
    df = spark.createDataFrame(log, "seq long, action string, alias_id long, canonical_id long, evidence string")
    works = spark.createDataFrame([(w,) for w in {x for r in log for x in r[2:4] if x is not None}], "work_id long")
    got = {r.seq: (r.outcome, r.root) for r in aliases.decided(df, works).collect()}
    assert got == merged_one_by_one(log, {r.work_id for r in works.collect()}) and got[20] == ("merged", 7) and got[23] == ("merged", 3)
    bounded = {r.seq: r.outcome for r in aliases.decided(df, works, most_hops=4).collect()}
    assert bounded[20] == "identity_corrupt" and bounded[23] == "merged"

"""Works that are aliases of others: the canonical work of each, families, and who was told of any of a family."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators.folds import folded
from quillmark.sources.folders import shared_folder, written

MOST_HOPS = 128


def _saved(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def closure(aliases: DataFrame, most_hops: int = MOST_HOPS) -> DataFrame:
    """(alias_id, canonical_id, hops, status) of aliases(alias_id, canonical_id): where each chain ends.

    Each round doubles how far every alias looks, so 128 hops take seven joins. status is ok, or cycle for chains that
    don't end within most_hops; those have no canonical work.
    """
    step = aliases.select("alias_id", F.col("canonical_id").alias("to"), F.lit(1).alias("hops"))
    reach = 1
    while reach < most_hops:
        further = step.select(F.col("alias_id").alias("to"), F.col("to").alias("_next"), F.col("hops").alias("_more"))
        met = _saved(step.join(further, "to", "left").select("alias_id", F.coalesce("_next", "to").alias("to"), (F.col("hops") + F.coalesce("_more", F.lit(0))).alias("hops"), F.col("_next").isNotNull().alias("_went")))
        step, reach = met.drop("_went"), reach * 2
        if not met.where("_went").limit(1).count():  # all chains have ended
            break
    last = step.join(aliases.select(F.col("alias_id").alias("to"), F.lit(True).alias("_open")), "to", "left")
    ended = F.col("_open").isNull() & (F.col("hops") <= most_hops)
    return last.select("alias_id", F.when(ended, F.col("to")).alias("canonical_id"), F.when(ended, F.col("hops")).alias("hops"), F.when(ended, "ok").otherwise("cycle").alias("status"))


def families(works: DataFrame, aliases: DataFrame) -> DataFrame:
    """(work_id, canonical_id) for every work: itself where it is no alias. Works in cycles have no family."""
    ends = closure(aliases).select(F.col("alias_id").alias("work_id"), F.col("canonical_id").alias("_end"), F.lit(True).alias("_alias"))
    return works.select("work_id").join(ends, "work_id", "left").select("work_id", F.when(F.col("_alias"), F.col("_end")).otherwise(F.col("work_id")).alias("canonical_id")).where("canonical_id is not null")


def prior_recipients(works: DataFrame, aliases: DataFrame, ledger: DataFrame) -> DataFrame:
    """(reader_id, work_id): readers told, by ledger(reader_id, work_id, state) accepted or unknown, of any work of its family."""
    family = families(works, aliases)
    told = ledger.where(F.col("state").isin("accepted", "unknown")).join(family, "work_id").select("reader_id", "canonical_id").distinct()
    return told.join(family, "canonical_id").select("reader_id", "work_id")


def current(log: DataFrame) -> DataFrame:
    """Aliases that hold after a log(alias_id, canonical_id, action, at, id) of merges and revocations."""
    last = log.groupBy("alias_id").agg(F.max_by(F.struct("action", "canonical_id"), F.struct("at", "id")).alias("_last"))
    return last.where("_last.action = 'merged'").select("alias_id", F.col("_last.canonical_id").alias("canonical_id"))


#: An entry of a log on its way: cursor is where its canonical work's root is looked for, ends whether its root is never an alias.
ENTRY = ["seq", "node", "merge", "evidence", "cursor", "hops", "root", "ends", "outcome"]


def _step(state: tuple, row: dict) -> tuple[tuple, tuple]:
    """What a work points to (root, evidence, ends), the roots revoked for it, and whether that waits for an entry: each entry moves it, each question is told."""
    pointer, gone, waits = state
    root, outcome, told = row["root"], row["outcome"], (None, None, None)
    if row["asks"]:
        if not waits:
            told = (pointer[0], pointer[2], None) if pointer else (None, None, True)
    elif outcome != "identity_corrupt":
        outcome = None
        if waits:
            pass
        elif row["merge"]:
            if root is None:
                waits = pointer is None
            elif pointer:
                outcome = "replayed" if pointer[:2] == (root, row["evidence"]) else "alias_conflict"
            elif root == row["node"]:
                outcome = "alias_cycle"
            else:
                outcome, pointer = "merged", (root, row["evidence"], row["ends"])
        elif not pointer:
            outcome = "alias_missing"
        else:
            root, gone = pointer[0], set() if gone is None else gone
            outcome = "alias_revocation_conflict" if root in gone else "revoked"
            if outcome == "revoked":
                gone.add(root)
                pointer = None
    return (pointer, gone, waits), (*(row[c] for c in ENTRY[:6]), root, row["ends"], outcome, row["asks"], *told)


def _told(entries: DataFrame, asking: DataFrame, kind: str) -> DataFrame:
    """Logs' entries, decided as far as they can be, and the asking entries with what the work at their cursor points to just before them."""
    line = entries.select(*ENTRY, F.lit(False).alias("asks"), F.col("node").alias("of")).union(asking.select(*ENTRY, F.lit(True), "cursor"))
    schema = f"seq long, node {kind}, merge boolean, evidence {dict(entries.dtypes)['evidence']}, cursor {kind}, hops int, root {kind}, ends boolean, outcome string, asks boolean, next {kind}, next_ends boolean, stops boolean"
    return folded(line, ["of"], ["seq", F.desc("asks")], (None, None, False), _step, schema)


def _moved(told: DataFrame, most_hops: int) -> DataFrame:
    """Entries with a hop done, or with the root that they have found."""
    hop, stops, last = F.col("next").isNotNull(), F.coalesce("stops", F.lit(False)), F.coalesce("next_ends", F.lit(False))
    far = hop & (F.col("hops") >= most_hops)
    return told.select(
        "seq", "node", "merge", "evidence", F.when(hop & ~far, F.col("next")).otherwise(F.col("cursor")).alias("cursor"), (F.col("hops") + F.when(hop, 1).otherwise(0)).alias("hops"),
        F.when(stops, F.col("cursor")).when(last & ~far, F.col("next")).otherwise(F.col("root")).alias("root"), (F.col("ends") | last).alias("ends"), F.when(far, "identity_corrupt").otherwise(F.col("outcome")).alias("outcome"),
    )


def decided(log: DataFrame, works: DataFrame, most_hops: int = MOST_HOPS) -> DataFrame:
    """(seq, outcome, root) of a log(seq, action, alias_id, canonical_id, evidence) of merges and revocations, one after the other.

    A merge makes its alias point to the root that its canonical work has at that moment: later merges of that root are followed, and what is
    revoked later doesn't move it. outcome: merged; replayed for the same root and evidence while it holds, alias_conflict for others;
    alias_cycle where the root is the alias itself; revoked; alias_missing where there is nothing to revoke; alias_revocation_conflict where
    the same root was revoked for that alias before, which leaves the alias as it is; work_missing; identity_corrupt beyond most_hops. root:
    of a merge its canonical work's at that moment, of a revocation what it was about. seq is a unique long.

    What a work points to at a moment follows from its own log before that, and only works that a merge names are ever asked for it. So the logs of
    those come first: questions are followed for all entries at once, a hop a round, and wait where what they depend on is not settled. The first entry never
    waits, so rounds end, after as many as entries depend on one another. Entries of other works then need a round for each hop only. One work's
    log, with what is asked of it, is streamed through one task, which holds what the work points to and the roots that were revoked for it; works that are
    never an alias, however often they are named, are ends without that.
    """
    known = works.select("work_id").distinct()
    found = lambda df, of, c, name: df.join(of.toDF(c).distinct().withColumn(name, F.lit(True)), c, "left")
    merge = F.col("action") == "merge"
    rows = found(found(log, known, "alias_id", "_alias"), known, "canonical_id", "_canonical")
    missing = F.col("_alias").isNull() | (merge & F.col("_canonical").isNull())
    kind, text = log.schema["alias_id"].dataType.simpleString(), F.lit(None).cast("string")
    rows = written(rows.select("seq", F.col("alias_id").cast(kind).alias("node"), merge.alias("merge"), "evidence", F.when(merge, F.col("canonical_id").cast(kind)).alias("cursor"), missing.alias("missing")))
    refused, rows = rows.where("missing").select("seq", F.lit("work_missing").alias("outcome"), F.lit(None).cast(kind).alias("root")), rows.where("not missing").drop("missing")
    rows = found(found(rows, rows.select("node"), "cursor", "_again"), rows.where("merge").select("cursor"), "node", "_named")
    ends = F.col("merge") & F.col("_again").isNull()
    rows = written(rows.select("seq", "node", "merge", "evidence", "cursor", F.lit(0).alias("hops"), F.when(ends, F.col("cursor")).alias("root"), ends.alias("ends"), text.alias("outcome"), F.col("_named").isNotNull().alias("named")))
    named, others, asks = rows.where("named").drop("named"), rows.where("not named").drop("named"), "merge and root is null and outcome is null"
    while named.where("outcome is null").limit(1).count():
        told = _told(named, named.where(asks), kind)
        one = told.groupBy("seq").agg(*(F.max(c).alias(c) for c in told.columns if c not in ("seq", "asks")))  # an entry, and what it was told
        named = written(_moved(one, most_hops))
    settled, asking = [others.where(f"not ({asks})")], others.where(asks)
    while asking.limit(1).count():
        met = written(_moved(_told(named, asking, kind).where("asks"), most_hops))
        settled.append(met.where(f"not ({asks})"))
        asking = met.where(asks)
    rest = _told(reduce(DataFrame.union, settled), asking.limit(0), kind)
    return named.select("seq", "outcome", "root").union(rest.select("seq", "outcome", "root")).union(refused)

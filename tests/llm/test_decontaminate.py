import random
import re

from quillmark.llm import decontaminate as d


def plain(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def test_distance():
    rng = random.Random(1)
    for _ in range(200):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(1, n))) for n in (90, 120))
        masks = {}
        for i, c in enumerate(p):
            masks[c] = masks.get(c, 0) | 1 << i
        assert d.distance(masks, len(p), t) == plain(p, t)


def test_all_items_within_the_budget_are_found(spark, docs, rows, none):
    rng = random.Random(2)
    items = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(3, 30)))) for i in range(20)]
    texts = []
    for i, text in items:
        for edits in (0, 1, 3, 6, 12):
            t = list(text)
            for _ in range(edits):
                at = rng.randrange(len(t))
                t[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "yz"])
            texts.append((1000 + len(texts), "Before, " + "".join(t).upper() + "!! after it"))
    texts += [(r["doc_id"], r["text"]) for r in rows]
    benchmark = spark.createDataFrame([*items, (50, None), (51, ""), (52, "short"), (0, items[0][1])], "item_id long, text string")
    got = d.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), benchmark).collect()
    assert len(got) == len(texts)
    known = {i: d.normal(t) for i, t in items}
    by_text = {}
    for r in got:
        by_text.setdefault(r.doc_id, r)
    for doc_id, text in texts[:100]:
        want = {(i, n) for i, t in known.items() if len(t) >= d.LEAST and (n := plain(t, d.normal(text))) <= int(d.ERROR_RATE * len(t))}
        want |= {(i, 0) for i, t in known.items() if len(t) < d.LEAST and re.search(rf"(?<!\S){t}(?!\S)", d.normal(text))}
        assert {tuple(m) for m in by_text[doc_id].matches} == want
        assert by_text[doc_id].contaminated == bool(want)
    assert not any(r.contaminated for r in got if r.doc_id is None or r.doc_id < 1000)
    assert d.contaminated(none, benchmark).count() == 0
    assert not any(r.contaminated for r in d.contaminated(docs, benchmark.where("false")).collect())


def test_blocks_hold_all_items(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_CHARS", 60)
    items = spark.createDataFrame([(i, f"item number {i} with some words of its own {i * i}") for i in range(7)], "item_id long, text string")
    assert sum(map(len, d.blocks(items))) == 7 and len(list(d.blocks(items))) > 2
    docs = spark.createDataFrame([(i, f"so: Item number {i}, with some words of its own {i * i}.") for i in range(7)], "doc_id long, text string")
    assert {(r.doc_id, tuple(m.item_id for m in r.matches if m.distance == 0)) for r in d.contaminated(docs, items).collect()} == {(i, (i,)) for i in range(7)}


def test_short_items_are_found_unchanged_as_whole_words():
    find = d.Matcher([(1, d.normal("What is 2+2? Four.")), (2, d.normal("Oslo")), (3, "")])
    assert find("He asked: what is 2 + 2?  FOUR!") == [(1, 0)] and find("Oslo") == find("in oslo, so") == [(2, 0)]
    assert find("Oslos, xoslo") == [] and find("What is 2+3? Four.") == [] and find("") == []

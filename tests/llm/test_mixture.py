import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quillmark.llm import mixture


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain(rows):
    names = sorted({r.source for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(words(r.text) for r in rows if r.source == s) for s in names}
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(size.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rate = (total - sum(3 * size[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * rate > 3 * size[s]}
        if not over:
            break
        capped |= over
    target = {s: float(3 * size[s]) if s in capped else weight[s] * rate for s in names}
    out = []
    for s in names:
        at = 0
        key = lambda r: ("g" if r.doc_id is None else hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.doc_id or 0, words(r.text))
        goal = round(target[s])
        for r in sorted((r for r in rows if r.source == s), key=key):
            n = words(r.text)
            taken = goal // size[s] * n + max(0, min(n, goal % size[s] - at)) if size[s] else 0
            out.append((r.doc_id, n, size[s], pytest.approx(target[s]), taken))
            at += n
    return out


def test_plan(docs, none):
    order = lambda r: (repr(r[0]), r[1], r[4])
    got = sorted((tuple(r) for r in mixture.plan(docs).select("doc_id", "size", "source_size", "target", "taken").collect()), key=order)
    assert got == sorted(plain(docs.collect()), key=order)
    assert mixture.plan(none).count() == 0
    for r in mixture.plan(docs).collect():
        assert r.taken <= 3 * r.size and sum(c.words for c in r.copies) == r.taken and all(0 <= c.position <= 1 for c in r.copies)


def test_positions_follow_the_schedule(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2]) for i in range(2000)], "doc_id long, text string, source string")
    knots = F.array(*(F.struct(F.lit(t).alias("t"), w.cast("double").alias("w")) for t, w in ((0.0, 3 - F.col("weight")), (0.5, F.col("weight") * 2), (1.0, F.col("weight")))))
    rows = mixture.plan(docs, knots).select("source", F.explode("copies").alias("c")).select("source", "c.*").collect()
    for source, weight in (("a", 1), ("b", 2)):
        total = sum(r.words for r in rows if r.source == source)
        area = lambda t: (3 - weight) * t + (2 * weight - (3 - weight)) * t * t if t <= 0.5 else ((3 - weight) + 2 * weight) / 4 + 2 * weight * (t - 0.5) - weight * (t - 0.5) ** 2  # noqa: E731,B023
        for t in (0.1, 0.3, 0.5, 0.7, 0.9):
            assert sum(r.words for r in rows if r.source == source and r.position < t) / total == pytest.approx(area(t) / area(1), abs=0.01)


def test_training_order(docs, none):
    got = mixture.training_order(docs)
    rows = got.collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    assert all(words(r.text) == r.words for r in rows)
    planned = mixture.plan(docs).collect()
    assert sum(r.words for r in rows) == sum(r.taken for r in planned)
    assert mixture.training_order(none).count() == 0


def test_rows_that_repeat_under_two_sources_keep_theirs(spark):
    rows = [(1, "a b c", "en", "x"), (1, "a b c", "en", "y"), (1, "a b c", "de", "y"), (1, "a b c", "en", None), (1, "a b c", "en", None), (2, None, None, "x"), (None, "d", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    planned = {}
    for r in mixture.plan(docs, mixture.curriculum(F.col("weight"))).collect():
        planned[r.source] = planned.get(r.source, 0) + r.taken
    got = {}
    for r in mixture.training_order(docs, mixture.curriculum(F.col("weight"))).collect():
        got[r.source] = got.get(r.source, 0) + r.words
    assert got == planned and set(got) == {"x", "y", None}


def test_a_null_is_no_text_of_its_neighbour(spark):
    rows = [(1, None, "en", "s"), (1, "en", None, "s")]
    got = mixture.training_order(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert [(r.text, r.lang, r.words) for r in got] == [("en", None, 1)]


def test_targets_are_planned_apart_from_documents(docs):
    """The driver's memory: the windows of targets and of parts stood in one plan with the documents' joins."""
    assert mixture.plan(docs)._jdf.queryExecution().optimizedPlan().toString().count("Window ") <= 2

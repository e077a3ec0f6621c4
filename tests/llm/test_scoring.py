import math
import random
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import context_tree as tree
from quillmark.llm import scoring


def plain_tree(texts, depth=tree.DEPTH):
    """A function of context and byte: log10 of the context tree's probability, by its definition."""
    seen = Counter((b[i - depth : i], b[i]) for t in texts for b in [bytes(depth) + t + b"\n"] for i in range(depth, len(b)))

    @lru_cache(None)
    def counts(context, above):
        n = [0, 0]
        for (c, x), times in seen.items():
            if c.endswith(context) and (bits := f"{x:08b}").startswith(above):
                n[int(bits[len(above)])] += times
        return tuple(n)

    def own(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - math.log(math.pi)

    @lru_cache(None)
    def weighted(context, above):
        n = counts(context, above)
        if len(context) == depth or not sum(n):
            return own(n)
        before = {c[-len(context) - 1 : len(c) - len(context)] for c, _ in seen if c.endswith(context)}
        return np.logaddexp(own(n), sum(weighted(b + context, above) for b in before)) - math.log(2)

    def mixed(context, d, above, bit):
        n = counts(context[depth - d :], above)
        share = (n[bit] + 0.5) / (sum(n) + 1)
        if d == depth:
            return share
        stop = math.exp(own(n) - math.log(2) - weighted(context[depth - d :], above))
        return stop * share + (1 - stop) * mixed(context, d + 1, above, bit)

    return lambda context, x: sum(math.log10(mixed(context, 0, f"{x:08b}"[:j], int(f"{x:08b}"[j]))) for j in range(8))


def plain(rows, training):
    texts = [(r.text or "").encode().lower().split() for r in rows]
    learnt = [t for r, t in zip(rows, texts) if training(r)]
    c = Counter(w for t in learnt for w in [*t, b"\n"])
    n, v = sum(c.values()), len(c)
    p = plain_tree([b" ".join(t) for t in learnt])
    out = []
    for r, t in zip(rows, texts):
        own = [*t, b"\n"]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        b = bytes(tree.DEPTH) + b" ".join(t) + b"\n"
        score = sum(p(b[i - tree.DEPTH : i], b[i]) for i in range(tree.DEPTH, len(b)))
        out.append((r.doc_id, len(own), sum(c[w] > 0 for w in own), n, pytest.approx(base), pytest.approx(score, rel=1e-5), pytest.approx(-score * math.log2(10) / (len(b) - tree.DEPTH), rel=1e-5)))
    return sorted(out, key=lambda x: repr(x[0]))


@pytest.mark.parametrize("grams,words", [(10**6, 10**6), (0, 0), (40, 5)])
def test_against_the_definition(spark, none, grams, words):
    rng = random.Random(1)
    texts = [None, "", "A b", "ab ab", "zz ☃"] + ["".join(rng.choice("ab cA") for _ in range(rng.randint(1, 25))) for _ in range(9)]
    docs = spark.createDataFrame([*enumerate(texts), (None, "b a"), (3, "ab ab")], "doc_id long, text string").withColumn("n_tokens", F.lit("x"))
    train = F.col("doc_id") % 3 != 1
    got = scoring.score(docs, train, broadcast_grams=grams, broadcast_words=words).collect()
    want = plain(docs.collect(), lambda r: r.doc_id is not None and r.doc_id % 3 != 1)
    assert sorted(map(tuple, got), key=lambda x: repr(x[0])) == want
    assert scoring.score(none, train, broadcast_grams=grams).count() == 0


def test_what_is_broadcast_changes_no_score(docs):
    some = docs.where("doc_id < 40")
    each = [{r.doc_id: r.score for r in scoring.score(some, F.col("doc_id") % 5 != 1, broadcast_grams=n).collect()} for n in (10**6, 200, 0)]
    assert all(each[0][d] == pytest.approx(e[d], rel=1e-12) for e in each for d in e)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    (row,) = scoring.score(docs, F.lit(False)).collect()
    assert row.score == pytest.approx(24 * math.log10(0.5)) and row.n_known == 0 and row.train_tokens == 0


def test_learns(docs):
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    held = {d for d in range(120) if zlib.crc32(str(d).encode()) % 5 == 1}
    rows = [r for r in scoring.score(docs, fold != 1).collect() if r.doc_id in held]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)

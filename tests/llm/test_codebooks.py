"""Vector codes against Lloyd's rounds over all pairs in Python's integers."""

import random

import numpy as np
import pytest

from quillmark.llm import codebooks


def brute(rows, parts, entries, rounds, scale=1024):
    """[(id, code, error)] and codebooks of (id, vector) rows of one width, None for ids that come last."""
    import math

    good = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(good[0][1])
    cut = lambda v, p: v[p * width // parts : (p + 1) * width // parts]
    order = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v in order] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda x, b: min(range(len(b)), key=lambda e: (far(x, b[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = [nearest(cut(v, p), books[p]) for _, v in good]
            for e in set(own):
                mine = [cut(v, p) for (_, v), o in zip(good, own, strict=True) if o == e]
                books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out = []
    for i, v in good:
        code = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, bytes(code), sum(far(cut(v, p), books[p][e]) for p, e in enumerate(code))))
    return out, books


def check(spark, rows, schema="vec_id long, embedding array<double>", **how):
    found = codebooks.compress(spark.createDataFrame(rows, schema).repartition(3), **how)
    want, books = brute(rows, how["parts"], how["entries"], how["rounds"])
    got = [(r.vec_id, bytes(r.code), r.error) for r in found.rows.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert [b.entries for b in found.books] == books
    return found


@pytest.mark.parametrize("spread", [1 / 1024, 4 / 1024, 1.0])
def test_same_as_all_pairs(spark, spread):
    """Vectors in clumps; a small spread on the integer grid makes ties everywhere."""
    rng = random.Random(3)
    middles = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, spread) for x in rng.choice(middles)]) for i in range(300)]
    found = check(spark, rows, parts=4, entries=32, rounds=4)
    assert found.scanned[0] == 1 and all(s <= 1.1 for s in found.scanned)


def test_bounds_spare_work(spark):
    rng = random.Random(4)
    middles = [[rng.uniform(-1, 1) for _ in range(16)] for _ in range(64)]
    rows = [(i, [x + rng.gauss(0, 0.01) for x in middles[i % 64]]) for i in range(1200)]
    found = check(spark, rows, parts=2, entries=64, rounds=3)
    assert found.scanned[-1] < 0.4


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [0.5 * (i % 3), -0.25, i / 7, 1.0]) for i in range(20)] + [(3, [9.0, 9.0, 9.0, 9.0])] * 3
    rows += [(None, [0.1, 0.2, 0.3, 0.4]), (30, None), (31, [1.0, None, 1.0, 1.0]), (32, [nan, 1.0, 1.0, 1.0]), (33, [1.0, inf, 1.0, 1.0]), (34, [-inf, 1.0, 1.0, 1.0])]
    check(spark, rows, parts=4, entries=8, rounds=4)
    check(spark, rows, parts=4, entries=300, rounds=2)  # fewer vectors than entries
    check(spark, rows, parts=3, entries=4, rounds=2)  # parts of unequal width


def test_numbers_of_any_size(spark):
    rows = [(i, [(-1) ** i * 1e30 * (i % 5), 1e12 + i, 0.001 * i, -3.0]) for i in range(40)]
    found = codebooks.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), parts=2, entries=6, rounds=3)
    want, books = brute(rows, 2, 6, 3)
    assert [b.entries for b in found.books] == books
    assert {r.vec_id: (bytes(r.code), r.error) for r in found.rows.collect()} == {i: (c, e if e < 2**63 else None) for i, c, e in want}


def test_other_widths_nothing_and_clashing_names(spark):
    rows = [(1, [1.0, 2.0, 3.0, 4.0], "a", "x", 1), (2, [1.0], "b", "y", 2), (3, [], None, "z", 3), (4, [1.0, 2.0, 3.5, 4.0], None, "z", 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string, components string, code int")
    found = codebooks.compress(df, carry=("label",), entries=2)
    got = {r.vec_id: r for r in codebooks.with_group_error(found.rows, "label").collect()}
    assert len(got) == 4 and got[2].code is None and got[3].error is None and got[1].error == 0
    assert got[4].group_error == 0 and got[2].group_error is None
    none = codebooks.compress(df.where("false"), carry=("label",))
    assert none.rows.count() == 0 and none.books == [] and none.sha256()


def test_bounds_are_rounded_down():
    x = np.abs(np.random.default_rng(1).normal(size=1000)) * np.logspace(-30, 45, 1000)
    back = codebooks.unpacked(codebooks.packed(x))
    assert (back <= x).all() and (back[x < 1e38] >= x[x < 1e38] * 0.99).all()

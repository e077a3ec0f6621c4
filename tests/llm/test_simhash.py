import re

import numpy as np
import pytest
import xxhash

from quillmark.llm import simhash
from quillmark.llm.components import components


def plain(text, shingle):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return "0" * 16
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + shingle]).encode(), 42) for i in range(max(1, len(words) - shingle + 1))]
    return f"{sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)):016x}"


def groups(fps, most):
    group = {f: f for f in fps}

    def root(f):
        while group[f] != f:
            f = group[f]
        return f

    for a in fps:
        for b in fps:
            if (int(a, 16) ^ int(b, 16)).bit_count() <= most:
                group[root(a)] = root(b)
    return {f: root(f) for f in fps}


def test_against_all_pairs(docs, none):
    got = simhash.near_duplicates(docs, shingle=3, bits=64, blocks=4, same=2, distance=2).collect()
    rows = docs.collect()
    fps = {plain(r.text, 3) for r in rows}
    of = groups(fps, 2)
    least = {}
    for r in rows:
        k = of[plain(r.text, 3)]
        if r.doc_id is not None:
            least[k] = min(least.get(k, r.doc_id), r.doc_id)
    want = sorted(((r.doc_id, f := plain(r.text, 3), least[of[f]]) for r in rows), key=repr)
    assert sorted(map(tuple, got), key=repr) == want
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("bits,n", [(64, 300), (64, 6000), (512, 300)])
def test_large_blocks_keep_groups(bits, n):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 63, (n // 30, bits // 64)).astype(np.uint64)
    fps = np.repeat(centres, 30, 0)
    for _ in range(4):
        fps[np.arange(n), rng.integers(0, bits // 64, n)] ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    fps = np.unique(fps, axis=0)
    a, b = simhash.linked(np.zeros(len(fps), int), fps, 2)
    assert len(a) < len(fps)
    name = lambda rows: [r.tobytes() for r in rows]
    group = {x: x for x in name(fps)}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for x, y in zip(name(a), name(b)):
        group[root(x)] = root(y)
    true = np.arange(len(fps))
    for _ in range(60):
        before = true.copy()
        for i in range(len(fps)):
            near = np.flatnonzero(np.bitwise_count(fps ^ fps[i]).sum(1) <= 2)
            true[near] = true[near].min()
        if (true == before).all():
            break
    found = {}
    for i in range(len(fps)):
        assert found.setdefault(true[i], root(fps[i].tobytes())) == root(fps[i].tobytes())
    assert len(set(found.values())) == len(found)


@pytest.mark.parametrize("how", [{}, {"one_task": 0}, {"one_task": 0, "hub": 2}])
def test_components(spark, how):
    edges = [(i, i + 1) for i in range(20)] + [(50, 60), (60, 50), (50, 70), (7, 7), (100, 101), (99, 101), (98, 99)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), **how).collect()))
    assert got == {**{i: 0 for i in range(21)}, 50: 50, 60: 50, 70: 50, 98: 98, 99: 98, 100: 98, 101: 98}
    assert components(spark.createDataFrame([], "a long, b long"), **how).count() == 0

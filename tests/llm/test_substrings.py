import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quillmark.llm import recompress, substrings


def plain(texts, width):
    words = [(t or "").encode().split() for t in texts]
    n = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    for w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if n[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        yield len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone)


def check(docs, width):
    rows = docs.collect()
    want = [(r.doc_id, *p) for r, p in zip(rows, plain([r.text for r in rows], width))]
    got = substrings.without_repeats(docs, width=width).collect()
    order = lambda x: (repr(x[0]), x[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept.encode()) for r in got), key=order) == sorted(want, key=order)


def test_fixture(docs, none):
    check(docs, 35)
    assert substrings.without_repeats(none).count() == 0
    (row,) = [r for r in substrings.without_repeats(docs, digest=True).collect() if r.doc_id == 203]
    assert row.kept_sha256 == hashlib.sha256(b"one").hexdigest()


@pytest.mark.parametrize("width,seed", [(2, 1), (5, 2), (12, 3), (35, 4), (63, 5)])
def test_small_alphabets_and_periods(spark, width, seed):
    rng = random.Random(seed)
    texts = []
    for i in range(60):
        kind = i % 4
        words = [rng.choice("ab" if kind else "abcdefgh") for _ in range(rng.randint(0, 200))]
        if kind == 2:
            period = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
            words[rng.randint(0, len(words)) :] = period * rng.randint(1, 40)
        if kind == 3 and texts:
            other = rng.choice(texts).split()
            a = rng.randint(0, len(other))
            words = words[:50] + other[a : a + rng.randint(1, 120)] + words[50:90]
        texts.append(" ".join(words))
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), width)


def test_long_passages_in_many_texts(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(50)]
    texts = []
    for i in range(200):
        own = [word() for _ in range(rng.randint(5, 80))]
        a = rng.randint(0, 10)
        texts.append(" ".join(own[:20] + passage[a : a + rng.randint(30, 50)] + own[20:]))
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), 35)


def test_rows_that_share_one_hash_alone_are_not_the_same():
    rng = np.random.default_rng(1)
    one, other = rng.integers(0, 3, 400), rng.integers(0, 5, 400)
    route, times = substrings.once_each(one, other, one + 10, np.full(400, -1))
    assert times.sum() == 400 and ((route == -1) == (times == 0)).all()
    assert all(times[(one == a) & (other == b)].sum() == ((one == a) & (other == b)).sum() for a in range(3) for b in range(5))


def test_hashes_are_independent_of_each_other():
    tokens = recompress.mix(np.arange(3000, dtype=np.uint64) % np.uint64(11))
    at = np.arange(2900)
    one, other = recompress.Sums(tokens)(at, at + 40), recompress.PrimeSums(tokens)(at, at + 40)
    assert len(set(one.tolist())) == len(set(other.tolist())) == 11 and not set(one.tolist()) & set(other.tolist())


def thue_morse(n, x, y):
    return [x if bin(i).count("1") % 2 else y for i in range(n)]


def test_words_that_polynomials_modulo_powers_of_two_confuse(spark):
    """Long words, and long passages, of two letters by the Thue-Morse rule: no power of two as a modulus tells them from their complement."""
    same = [f"w{i}" for i in range(34)]
    word = lambda x, y: "".join(thue_morse(2048, x, y))
    texts = [" ".join([*same, word("a", "b")]), " ".join([*same, word("b", "a")])]
    assert [r.n_removed for r in substrings.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()] == [0, 0]
    tokens, others, _ = recompress.word_tokens([" ".join(thue_morse(4096, *pair)).encode() for pair in (("a", "b"), ("b", "a"))])
    start = np.array([0, 4096])
    assert len(set(recompress.Sums(tokens)(start, start + 4096).tolist())) == 1  # so it is known for the first
    assert len(set(recompress.PrimeSums(others)(start, start + 4096).tolist())) == 2

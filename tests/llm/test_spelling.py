"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from quillmark.llm import queries, spelling


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def expected(count):
    near = {w: [v for v in count if one_edit(w, v)] for w in count}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best and count[best] >= 2 * count[w] else None
    out = {}
    for w in count:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, count[w], len(near[w]), count[form[w]] if form[w] else None)
    return out


def variants(spark, count, **how):
    df = spark.createDataFrame(list(count.items()), "word string, n long").repartition(3)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df, **how).collect()}


@pytest.fixture(scope="module")
def vocabulary():
    """Words of few letters, so that bigrams repeat and most words have neighbours; long runs of one letter."""
    rng = random.Random(7)
    count = {"".join(rng.choice("abcé") for _ in range(rng.randint(5, 8))): rng.choice([3, 3, 4, 6, 8, 20, 50]) for _ in range(1500)}
    return count | {"a" * n: n for n in range(5, 40)} | {"ab" * n: 3 for n in range(3, 12)} | {"ÿ" * 2000: 3, "ÿ" * 2001: 6}


@pytest.mark.parametrize("together", [1, 20, 10**9])
def test_same_as_all_pairs(spark, vocabulary, together):
    assert variants(spark, vocabulary, together=together) == expected(vocabulary)


def test_forms_lead_to_roots(spark):
    chain = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "zzzzz": 5, "zzzzy": 5}
    got = variants(spark, chain)
    assert {w: got[w][1] for w in chain} == {w: "abbbb" if w[0] == "a" else w for w in chain}
    assert got["zzzzz"][3] == 1 and got["zzzzz"][0] is None


def test_ties_go_to_the_smallest(spark):
    got = variants(spark, {"wordé": 3, "wordz": 9, "worda": 9, "word": 9})
    assert got["wordé"][0] == "word" and got["word"][3] == 3


def test_words_of_documents(spark):
    texts = [("1", "Hello HELLO hello, naïve×naïve÷ÀÉ École école\nÉCOLE x1y2worldly worldly worldly-worldly"), (None, None), ("2", ""), ("3", "hello " * 5000 + "a" * 3000), ("3", "hello")]
    df = spark.createDataFrame([(i, t, "k", 5) for i, t in texts], "doc_id string, text string, word string, n long")
    want = Counter()
    for _, t in texts:
        want.update(re.findall("[a-zÀ-ÿ]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")))
    want = {w: n for w, n in want.items() if n >= 3 and len(w) >= 5}
    assert {r.word: r.n for r in spelling.words(df).collect()} == want and "worldly" in want
    assert spelling.variants(spelling.words(df.where("false"))).count() == 0


def test_altered_runs(spark):
    """The query's own misspellings, from the rule."""
    runs = [(str(d), f"r{'éabcdefgh'[d % 9] * (d % 6)}{'xyz'[d % 3]}") for d in range(3000)]
    df = spark.createDataFrame(runs, "d string, run string")
    got = {(r.d, r.run): r.word for r in df.withColumn("word", queries.misspelt(df.d, df.run)).collect()}
    changed = 0
    for d, run in runs:
        h = zlib.crc32(f"{d}:{run}".encode())
        at = h % len(run)
        assert got[d, run] == (run[:at] + run[at + 1 :] if h % 97 == 0 else run)
        changed += h % 97 == 0
    assert changed > 10

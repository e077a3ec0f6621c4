import math
import re
from collections import Counter

import pytest

from quillmark.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if n[w] > 1:
            covered.update(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def distance(p, q):
    a, b = sum(p), sum(q)
    p, q = [x / a if a else 0 for x in p], [x / b if b else 0 for x in q]
    part = lambda x, m: x * math.log2(x / m) if x else 0
    return math.sqrt(max(0, sum(part(x, (x + y) / 2) / 2 + part(y, (x + y) / 2) / 2 for x, y in zip(p, q))))


def histograms(text, lang):
    text = text or ""
    words, own = WORD.findall(text), quality.COMMON_WORDS.get(lang, [])
    found = [sum(len(x) for x in re.findall(p, text)) for p in quality.CLASSES.values()]
    inside = sum(map(len, words))
    seen = [words.count(w) for w in own]
    listed = seen + [0] * 0
    return [*found, len(text) - inside, inside - sum(found)], [*listed, max(0, len(words) - sum(seen))]


def test_against_plain_python(docs, none):
    rows, got = docs.collect(), quality.assess(docs, most_class=0.2, most_class_short=0.24, most_word=0.4, least_class_words=50, full_class_words=70, least_word_words=60).collect()
    pools = {}
    for r in rows:
        pools.setdefault(r.lang, ([0] * 6, [0] * 21))
        n = base(r.text)
        if n[0] < 20 or 100 * n[4] > 30 * n[0]:
            continue
        for pool, h in zip(pools[r.lang], histograms(r.text, r.lang)):
            for i, x in enumerate(h):
                pool[i] += x
    want = []
    for r in rows:
        n = base(r.text)
        failed = n[0] < 20 or 100 * n[4] > 30 * n[0]
        a, b = (distance([*h, *[0] * (len(p) - len(h))], p) for h, p in zip(histograms(r.text, r.lang), pools[r.lang]))
        kept = not failed and not (n[0] >= 50 and a > (0.2 if n[0] >= 70 else 0.24)) and not (n[0] >= 60 and b > 0.4)
        empty = not sum(pools[r.lang][0])  # no text of the language passes the base
        want.append((r.doc_id, *n, failed, kept, *([None] * 2 if empty else (pytest.approx(a, abs=1e-6), pytest.approx(b, abs=1e-6)))))
    order = lambda x: (repr(x[0]), *x[1:6])
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert quality.assess(none).count() == 0


def test_noise_goes_and_prose_stays(spark, rows):
    import random

    rng = random.Random(4)
    noisy = [(1000 + i, " ".join(w + rng.choice(["###", "$$$", "&&&", "%%%"]) for w in r["text"].split()), r["lang"]) for i, r in enumerate(rows[:9]) if len(r["text"].split()) >= 100]
    prose = [(r["doc_id"], r["text"], r["lang"]) for r in rows[:120]]
    got = quality.assess(spark.createDataFrame(prose + noisy, "doc_id long, text string, lang string")).collect()
    assert len(noisy) > 4 and not any(r.kept for r in got if r.doc_id >= 1000)
    assert all(r.kept or r.base_failed for r in got if r.doc_id < 1000 and r.doc_id % 10 not in (3, 5, 7))  # those may mix languages

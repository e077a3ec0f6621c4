import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rejected string, entities string, words string, label string"
SYLLABLES = {"en": "th er on in an re ed st".split(), "de": "sch ein ung die ch ü ver".split(), "fr": "eau oi é le ment que".split()}
STOP = {"en": "the of and to in".split(), "de": "der die und von".split(), "fr": "le la de et".split()}


def prose(rng, lang, n):
    return " ".join(rng.choice(STOP[lang]) if rng.random() < 0.3 else "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Texts of three languages with copies, near copies, shared passages, and every odd case."""
    rng = random.Random(5)
    out = []
    passage = prose(rng, "en", 60)
    for i in range(120):
        lang = "en de fr".split()[i % 3]
        text = prose(rng, lang, rng.randint(40, 300))
        if i % 10 == 3:
            text = out[rng.randrange(len(out))]["text"]
        elif i % 10 == 5:
            words = out[rng.randrange(len(out))]["text"].split()
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        elif i % 10 == 7:
            text += "\n" + passage + " " + prose(rng, lang, 30)
        out.append({"doc_id": i, "text": text, "lang": lang, "source": f"s{i % 7}"})
    odd = [None, "", " \n\t", "one", "a a a", "1234 5678", "  x", "wörd " * 200, "a b " * 150, "end\x0b\x0c\r", "🙂 ☃ <|im_end|> é", "x" * 3000]
    for i, text in enumerate(odd, 200):
        out.append({"doc_id": i, "text": text, "lang": "en" if i % 2 else None, "source": None})
    out += [dict(out[0]), {"doc_id": None, "text": out[1]["text"], "lang": None, "source": "s1"}, {"doc_id": None, "text": None, "lang": None, "source": None}]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    full = [(r["doc_id"], r["text"], r["lang"], r["source"], len(r["text"] or ""), 0.5, "x", "y", "z", None) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")

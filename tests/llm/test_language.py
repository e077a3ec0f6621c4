import random

import numpy as np
from pyspark.sql import functions as F

from quillmark.llm import language
from tests.llm.conftest import prose


def test_held_out_documents(docs, none):
    learn = docs.where("doc_id % 4 != 2")
    model = language.fit(learn)
    assert model.languages == ["de", "en", "fr"]
    rows = language.identify(docs, model).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 120 and r.doc_id % 4 == 2]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.9
    for r in rows:
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text))
    assert language.identify(none, model).count() == 0
    again = language.fit(learn.repartition(2))
    assert np.array_equal(again.scores, model.scores) and again.threshold == model.threshold


def test_nothing_to_learn_from(docs, none):
    assert language.fit(none) is None and language.fit(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}


def test_one_language_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "abc " * 200_000, "xx"), (2, "b", "xx")], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.rejected) for r in language.identify(docs, language.fit(docs)).collect()} == {("xx", False)}


def test_texts_of_no_learned_language_are_rejected(spark):
    rng = random.Random(3)
    rows = [(n, prose(rng, lang, rng.randint(30, 120)), lang) for n, lang in enumerate(["en", "de"] * 200 + ["fr"] * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.identify(docs, language.fit(docs.where("doc_id < 400 and doc_id % 4 != 2"))).collect()
    strange = [r.rejected for r in found if r.lang == "fr"]
    right = [r.rejected for r in found if r.lang != "fr" and r.doc_id % 4 == 2]
    assert sum(strange) / len(strange) > 0.8 and sum(right) / len(right) < 0.05


def test_rare_labels_are_counted_and_left_out(docs):
    labelled = docs.where("doc_id < 120").union(docs.where("doc_id = 1").withColumn("lang", F.lit("typo")))
    model = language.fit(labelled, most_languages=3)
    assert model.languages == ["de", "en", "fr"] and model.left_out == 1


def test_sampled_documents_are_bounded(docs, monkeypatch):
    monkeypatch.setattr(language, "KEPT_GRAMS", 50)
    monkeypatch.setattr(language, "SAMPLED", 30)
    rows, left_out = language.sample(docs.where("doc_id < 120"), 600)
    assert left_out == 0 and max(len(h) for _, h, _ in rows) == 50 and len(rows) < 60


def test_columns_of_the_result_are_replaced_and_others_stay(docs):
    odd = docs.withColumn("_found", F.lit("x")).withColumn("a.b", F.lit(1))
    got = language.identify(odd, None)
    assert got.columns == [c for c in odd.columns if c not in ("score", "rejected")] + ["lang_pred", "score", "rejected"]
    assert got.select("_found").first()[0] == "x" and got.count() == docs.count()


def test_null_and_repeated_ids(spark):
    """Rows without an id, or all of one, are drawn as others are; a row that repeats is drawn once."""
    rng = random.Random(8)
    rows = [(prose(rng, lang, rng.randint(20, 60)), lang) for lang in ["en", "de"] * 900]
    for same in (None, 133709):
        docs = spark.createDataFrame([(same, t, lang) for t, lang in rows], "doc_id long, text string, lang string")
        drawn, _ = language.sample(docs, 300)
        assert all(200 < sum(lang == x for x, _, _ in drawn) < 400 for lang in ("en", "de"))
        found = language.identify(docs.limit(100), language.fit(docs)).collect()
        assert sum(r.lang_pred == r.lang for r in found) > 95
    docs = spark.createDataFrame([(1, rows[0][0], "en")] * 3000 + [(2, rows[1][0], "de")], "doc_id long, text string, lang string")
    assert len(language.sample(docs, 300)[0]) == 2


def test_many_languages(spark):
    """More labels than an embedding has numbers, one document each or two; none is left out."""
    rng = random.Random(2)
    rows = [(i, prose(rng, "en", 30) + f" {chr(97 + i % 26)}{i % 40}x" * 30, f"l{i % 40}") for i in range(80)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 40 and model.left_out == 0 and model.scores is None
    assert abs(model.probabilities(rows[0][1]).sum() - 1) < 1e-9


def test_languages_that_are_told_apart_without_an_error_are_not_rejected(spark):
    """With all held-out rows right, probabilities of 1 gave a threshold that every document fell below."""
    rng = random.Random(4)
    alphabets = {"aa": "abcd", "bb": "efgh", "cc": "ijkl", "dd": "mnop"}
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 7))) for _ in range(rng.randint(40, 90)))
    docs = spark.createDataFrame([(n, text(alphabets[lang]), lang) for n, lang in enumerate(list(alphabets) * 150)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert 0 < model.threshold < 0.99 and model.temperature > 0.06
    found = language.identify(docs, model).collect()
    assert not any(r.rejected for r in found) and all(r.lang_pred == r.lang for r in found)

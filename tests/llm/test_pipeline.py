"""The pipeline over a folder of small tables, stage by stage and as a whole."""

import random
import re

import pytest

import corpus_pipeline
from quillmark.llm import decontaminate

ITEM = "the quick survey of every planted passage names seven rivers and eleven unlikely mountains in order"


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(3)
    words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(i % 17) for i in range(300)]
    near = [*words[:150], "changed", *words[151:]]
    extra = [
        (900, " ".join(words), "en", "s1"),
        (901, " ".join(near), "en", "s2"),
        (902, " ".join(words), "en", "s3"),
        (903, f"Some text before it. {ITEM.capitalize().replace('seven', 'sevem')}! And after, the of to in.", "en", "s1"),
        (904, "Write to ann.b12@mail.example.com or +1 (743) 555-3824 about the 4465758382889437 of the and to in.", "en", "s2"),
    ]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    more = spark.createDataFrame([(*r, len(r[1])) for r in extra], "doc_id long, text string, lang string, source string, n_chars long")
    docs.select(columns).union(more).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = rows.columns, {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = rows
        rows = stage(spark, rows, folder)
        if n < 4:
            assert rows.columns == columns
            rows = spark.createDataFrame(rows.collect(), before.schema)
        seen[name] = (before, rows)
    ids = lambda df: {r.doc_id for r in df.collect()}
    before, after = seen["language"]
    silent = {r.doc_id for r in before.collect() if r.text is None or not any(c.isalpha() for c in r.text)} - {None}
    assert silent <= ids(before) - ids(after) and all(200 <= d < 212 for d in ids(before) - ids(after))
    before, after = seen["near_duplicates"]
    assert {901, 902} <= ids(before) - ids(after) and 900 in ids(after)
    texts = {}
    for r in before.collect():
        texts.setdefault(" ".join((r.text or "").lower().split()), []).append(r.doc_id)
    for same in texts.values():
        assert len({d for d in same if d in ids(after)}) <= 1 or None in same
    before, after = seen["decontamination"]
    assert ids(before) - ids(after) == {903}
    before, after = seen["personal_data"]
    assert ids(before) == ids(after)
    (new,) = [r for r in after.collect() if r.doc_id == 904]
    assert not re.search(r"ann\.b12|555-3824|4465758382889437", new.text) and new.n_chars == len(new.text)
    old = {(r.doc_id, r.text) for r in before.collect() if r.doc_id not in (904, 210)}
    assert old <= {(r.doc_id, r.text) for r in after.collect()}
    before, after = seen["mixture"]
    got = after.collect()
    assert [r.position for r in got] == sorted(r.position for r in got) and ids(after) <= ids(before)


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and not {901, 902, 903} & {r.doc_id for r in rows}
    assert not any(decontaminate.Matcher([(1, decontaminate.normal(ITEM))])(r.text) for r in rows)

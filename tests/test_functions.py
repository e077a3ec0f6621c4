import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmark.functions import hashing, identifiers, rates, texts, timing
from quillmark.functions import values as json_values
from quillmark.operators import aliases, evidence, ledgers, revisions, traversal


def values(spark, f, inputs):
    rows = spark.createDataFrame([(i, *(x if isinstance(x, tuple) else (x,))) for i, x in enumerate(inputs)], "i int, a string, b string" if isinstance(inputs[0], tuple) else "i int, a string")
    return [r.out for r in rows.select("i", f.alias("out")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "namespace,cases",
    [
        ("doi", {"https://doi.org/10.1000/A%2Fb": "10.1000/a/b", "doi: 10.1234/ÉA": "10.1234/Éa", "10.1000/c+d": "10.1000/c+d", "https://doi.org/10.1000/a%zz": None, "10.1/x": None, "10.1000/a b": None, "ftp://10.1000/x": None, "10.1000/a%2F": "10.1000/a%2f"}),
        ("arxiv", {"0704.0001v2": "0704.0001", "1412.12345": None, "1501.00001": "1501.00001", "1513.00001": None, "hep-th/9901001v3": "hep-th/9901001", "arXiv:0704.0001": "0704.0001", "0703.0001": None, "math.GT/0613001": None}),
        ("pmid", {" 007 ": "7", "0": None, "12345678901": None, "x": None}),
        ("pmc", {"pmc0012": "PMC12", "PMC0": None, "12": None}),
        ("isbn", {"1": None}),
    ],
)
def test_identifiers(spark, namespace, cases):
    got = values(spark, identifiers.normalized(F.lit(namespace), F.col("a")), [*cases, None])
    assert [g.value for g in got] == [*cases.values(), None]
    assert all((g.error is None) == (g.value is not None) for g in got)


def test_texts(spark):
    assert values(spark, texts.safe_url(F.col("a")), ["https://a.org/x?y=1", "http://a.org", "https://a.org:444/", "https://u@a.org/", "https://a.org/#f", "https://192.168.1.1/", "https://8.8.8.8/", "https://x.local/", "https://[::1]/", "https://a b.org", "", None]) == [True, False, False, False, False, False, True, False, False, False, False, False]
    assert values(spark, texts.html_escape(F.col("a")), ["<a href='x'>&amp;\""]) == ["&lt;a href=&#x27;x&#x27;&gt;&amp;amp;&quot;"]
    assert values(spark, texts.numbers(F.col("a")), ["a1 2.5e3 -4 x_5 6%"]) == [["2.5e3", "-4", "6"]]
    assert values(spark, texts.integrity_kind(F.col("a")), ["Partial_retraction", "new edition", "ERRATUM", None]) == ["retraction", "other_update", "correction", "other_update"]
    assert values(spark, texts.license_class(F.col("a")), ["https://x/licenses/BY-NC-ND/4.0/", "https://x/licenses/by", None]) == ["cc-by-nc-nd", "cc-by", "unknown"]
    assert values(spark, texts.micros(F.col("a")), ["0.0000001", "1.5", "2"]) == [1, 1_500_000, 2_000_000]
    assert values(spark, texts.newlines(F.col("a")), ["\r\na\rb\n "]) == ["a\nb"]
    assert values(spark, texts.contained(F.split("a", ","), F.split("b", ",")), [("a,a", "a,b,a"), ("a,a", "a,b"), ("c", "a")]) == [True, False, False]
    assert values(spark, texts.unit_name(F.col("a")), ["Hours", "公尺", "kg", "lux"]) == ["h", "m", "kg", "lux"]


def test_json(spark):
    cases = ['{"b": 1.50, "a": "é"}', '{"a":1,"a":2}', "[NaN]", "{", None]
    assert values(spark, hashing.canonical_json_ascii(F.col("a")), cases) == ['{"a":"\\u00e9","b":1.5}', None, None, None, None]
    assert values(spark, hashing.canonical_json_utf8(F.col("a")), cases)[0] == '{"a":"é","b":1.5}'
    assert values(spark, json_values.problem(F.col("a"), most_depth=3), [*cases, "[[[[1]]]]"]) == [None, "duplicate_key", "not_finite", "invalid", "invalid", "too_deep"]


def test_local_cutoff(spark):
    rows = spark.sql("SELECT timestamp'2024-03-10 12:00:00' AS now, 'America/New_York' AS zone UNION ALL SELECT timestamp'2024-01-01 00:30:00', 'Asia/Taipei'")
    got = rows.select(timing.local_cutoff(F.col("now"), F.col("zone"), F.lit(9), F.lit(0)).cast("string")).collect()
    assert [r[0] for r in got] == ["2024-03-09 14:00:00", "2023-12-31 01:00:00"]


def test_aliases_of_any_depth(spark):
    chain = [(i, i - 1) for i in range(1, 129)] + [(i, i - 1) for i in range(1001, 1130)] + [(2, 1)][:0] + [(500, 501), (501, 500)]
    got = {r.alias_id: (r.canonical_id, r.status) for r in aliases.closure(spark.createDataFrame(chain, "alias_id long, canonical_id long")).collect()}
    assert got[128] == (0, "ok") and got[1128] == (1000, "ok") and got[1129] == (None, "cycle") and got[500] == (None, "cycle")


def test_admission_leaves_room(spark):
    rows = spark.createDataFrame([("p", "USD", 1, 1, 60), ("p", "USD", 2, 2, 50), ("p", "USD", 3, 3, 40), ("q", "USD", 4, 1, 101)], "period string, currency string, request_id long, at long, amount long")
    assert {r.request_id: r.decision for r in ledgers.admitted(rows, 100).collect()} == {1: "reserved", 2: "blocked", 3: "reserved", 4: "blocked"}


def test_watermark_stops_at_the_first_gap(spark):
    rows = [("a", 0, 1, True), ("a", 1, 2, True), ("a", 3, 4, True), ("b", 0, 1, False), ("b", 1, 2, True), ("c", 5, 6, True)]
    got = traversal.watermarks(spark.createDataFrame(rows, "stream string, from_at long, until_at long, finalised boolean"))
    assert {r.stream: (r.watermark, r.n_windows) for r in got.collect()} == {"a": (2, 2), "b": (None, 0), "c": (6, 1)}


def test_expired_facts_are_not_replaced_by_older_ones(spark):
    facts = spark.createDataFrame([(1, 10, 0, 100), (1, 11, 5, 7)], "k long, id long, checked_at long, expires_at long")
    probes = spark.createDataFrame([(100, 1, 4), (101, 1, 8), (102, 1, -1), (103, 2, 5), (104, 1, 5)], "probe_id long, k long, at long")
    got = {r.probe_id: (r.fact_id, r.status) for r in revisions.as_of(probes, facts, "k").collect()}
    assert got == {100: (10, "current"), 101: (11, "expired"), 102: (None, "missing"), 103: (None, "missing"), 104: (11, "current")}


def test_coverage(spark):
    rows = spark.sql("SELECT * FROM VALUES (0, 'full', true, array('a'), array()), (1, 'full', false, array('a'), array('b')), (2, 'abstract', false, array('abstract'), array()), (3, 'full', false, array('a'), array('a')), (4, 'full', true, array('a'), array('b')) AS t(i, s, c, x, y)")
    got = rows.select("i", evidence.coverage(F.col("s"), F.col("c"), F.col("x").cast("array<string>"), F.col("y").cast("array<string>")).alias("level")).orderBy("i").collect()
    assert [r.level for r in got] == ["full_text", "selected_sections", "abstract_only", "invalid", "invalid"]


def test_findings(spark):
    rows = spark.createDataFrame([(1, "took 5 hours", "5 Hour and 6"), (2, "5 kg", "5 m"), (3, "7", "8")], "pair_id int, text string, source string")
    assert sorted(map(tuple, evidence.findings(rows).collect())) == [(2, "unit_mismatch"), (3, "number_mismatch")]
    assert (1, "number_mismatch") in map(tuple, evidence.findings(rows, all_numbers=True).collect())


def test_multisets(spark):
    rng = random.Random(6)
    pairs = [([rng.choice("abcd") for _ in range(rng.randint(0, 6))], [rng.choice("abcd") for _ in range(rng.randint(0, 9))]) for _ in range(200)] + [(["x"] * 100_000, ["x"] * 99_999 + ["y"]), ([str(i) for i in range(100_000)], [str(i) for i in reversed(range(100_000))])]
    df = spark.createDataFrame([(n, a, b) for n, (a, b) in enumerate(pairs)], "n int, a array<string>, b array<string>")
    began = time.time()
    got = {r.n: r for r in df.select("n", texts.contained(F.col("a"), F.col("b")).alias("c"), texts.counted(F.col("a")).alias("m")).collect()}
    assert time.time() - began < 60
    for n, (a, b) in enumerate(pairs):
        assert got[n].c == (not Counter(a) - Counter(b))
        assert [(m.item, m.n) for m in got[n].m] == sorted(Counter(a).items())

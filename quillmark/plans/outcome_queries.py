"""Queries of what requests, pages and cards come to, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators import evidence, graph, ledgers, traversal
from quillmark.plans.registry import query
from quillmark.sources import xml_pages
from quillmark.sources.tables import table


@query("""
SELECT p_partkey AS card_id, CASE p_partkey % 11 WHEN 6 THEN 'verification_anchor_mismatch' WHEN 7 THEN 'verification_claim_mismatch' WHEN 8 THEN 'invalid_verification_input' WHEN 10 THEN 'verification_claim_mismatch' END AS error,
  CASE WHEN p_partkey % 11 = 0 THEN 'passed' WHEN p_partkey % 11 NOT IN (6, 7, 8, 10) THEN 'rejected' END AS verdict,
  CASE p_partkey % 11 WHEN 0 THEN '' WHEN 1 THEN 'empty_reading_card card -1 ' WHEN 2 THEN 'number_mismatch translation -1 ' WHEN 3 THEN 'number_mismatch translation -1 ;number_mismatch translation 0 '
    WHEN 4 THEN 'unit_mismatch translation 0 ' WHEN 5 THEN 'role_value_mismatch card 0 c1' WHEN 9 THEN 'number_mismatch card 0 c1;unit_mismatch card 0 c1' END AS findings
FROM part
""")
def card_report(spark: SparkSession, folder: str) -> DataFrame:
    """Cards of one passage and one statement about parts, in ways that go wrong by their key."""
    n, k = F.col("p_partkey") % 11, F.col("p_partkey")
    said = F.concat(F.lit("Takes "), F.col("p_size").cast("string"), F.lit(" kg, baseline 300."))
    sized = lambda unit, more: F.concat(F.col("p_size").cast("string"), F.lit(unit), F.lit(more))
    passage = F.when(n == 2, sized(" kg", "")).when(n == 3, sized(" kg", " baseline 300 and 4000")).when(n == 4, sized(" m", " baseline 300")).otherwise(sized(" kg", " baseline 300"))
    statement = F.when(n == 5, F.concat(F.lit("baseline "), sized(" kg", ""))).when(n == 9, F.lit("7000 s")).otherwise(sized(" kg", ""))
    cited = F.when(n == 8, F.array().cast("array<string>")).when(n == 10, F.array(F.lit("c1"), F.lit("c9"))).otherwise(F.array(F.lit("c1")))
    one = F.array(F.struct(statement.alias("text"), F.when(n == 7, "method").otherwise("result").alias("claim_type"), cited.alias("claim_ids")))
    parts = table(spark, folder, "part")
    cards = parts.select(
        k.alias("card_id"), said.alias("abstract"), F.array(F.struct(passage.alias("text"), F.array(F.when(n == 6, "a9").otherwise("a1")).alias("anchor_ids"))).alias("translation"),
        F.when(n == 1, F.slice(one, 1, 0)).otherwise(one).alias("statements"),
    )
    anchors = parts.select(k.alias("card_id"), F.lit("a1").alias("anchor_id"), said.alias("quote"))
    claims = parts.select(k.alias("card_id"), F.lit("c1").alias("claim_id"), F.lit("result").alias("claim_type"), F.array(said).alias("quotes"))
    shown = F.transform("findings", lambda f: F.concat_ws(" ", f["code"], f["kind"], f["place"].cast("string"), F.array_join(f["claim_ids"], ",")))
    return evidence.card_report(cards, anchors, claims).select("card_id", "error", "verdict", F.array_join(shown, ";").alias("findings"))


@query("""
WITH r AS (
  SELECT o_orderkey AS request_id, o_custkey % 40 AS source, o_orderkey % 41 AS target, CASE WHEN o_orderkey % 13 = 0 THEN 'Is' ELSE 'is-' || lower(left(o_orderpriority, 1)) END AS type, o_orderstatus AS evidence, o_orderdate AS made FROM orders
), j AS (
  SELECT *, CASE WHEN source = target OR type = 'Is' THEN 'invalid_work_relation' WHEN source = 7 OR target = 7 THEN 'work_missing' END AS bad FROM r
), f AS (
  SELECT source, target, type, arg_min({'k': request_id, 'e': evidence}, (made, request_id)) AS earliest FROM j WHERE bad IS NULL GROUP BY ALL
)
SELECT request_id, CASE WHEN bad IS NULL THEN 'relation:' || sha256('work-relation-v1' || chr(0) || source || chr(0) || target || chr(0) || type || chr(0)) END AS relation_id,
  coalesce(bad, CASE WHEN request_id = earliest.k THEN 'recorded' WHEN evidence = earliest.e THEN 'replay' ELSE 'work_relation_conflict' END) AS outcome
FROM j LEFT JOIN f USING (source, target, type)
""")
def relation_requests(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.when(k % 13 == 0, "Is").otherwise(F.concat(F.lit("is-"), F.lower(F.left("o_orderpriority", F.lit(1)))))
    requests = table(spark, folder, "orders").select(
        k.alias("request_id"), (F.col("o_custkey") % 40).cast("string").alias("source"), (k % 41).cast("string").alias("target"), kind.alias("type"),
        F.col("o_orderstatus").alias("evidence"), F.col("o_orderdate").alias("at"),
    )
    works = spark.range(41).where("id <> 7").select(F.col("id").cast("string").alias("work_id"))
    return graph.recorded_relations(requests, works)


@query("""
WITH l AS (SELECT l_orderkey, l_orderkey * 10 + l_linenumber AS run_id, l_returnflag, l_tax FROM lineitem),
r AS (
  SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS done, count(*) FILTER (l_returnflag = 'A') AS active, coalesce(bool_or(l_returnflag = 'R' AND l_tax > 0.07), false) AS lost,
    min(run_id) FILTER (l_returnflag = 'R') AS done_id, min(run_id) FILTER (l_returnflag = 'A') AS active_id FROM l GROUP BY 1
), o AS (
  SELECT o_orderkey, *, CASE WHEN done > 1 OR lost OR (done = 0 AND active > 1) THEN 'corrupt' WHEN done = 1 THEN 'cached' WHEN active = 1 THEN 'in_progress' ELSE 'new' END AS outcome FROM orders LEFT JOIN r ON l_orderkey = o_orderkey
)
SELECT o_orderkey AS fingerprint, outcome, CASE outcome WHEN 'cached' THEN done_id WHEN 'in_progress' THEN active_id END AS run_id FROM o
""")
def generation_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Which requests an earlier run answers, or an open one will."""
    requests = table(spark, folder, "orders").select(F.col("o_orderkey").alias("fingerprint"))
    state = F.when(F.col("l_returnflag") == "R", "succeeded").when(F.col("l_returnflag") == "A", "running").otherwise("failed")
    runs = table(spark, folder, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("run_id"), F.col("l_orderkey").alias("fingerprint"), state.alias("state"), F.when(F.col("l_tax") <= 0.07, "kept").alias("output"))
    return ledgers.known_runs(requests, runs)


@query("""
WITH u AS (
  SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'unavailable' ELSE 'partial' END AS state, event_id % 3 AS version, CASE event_id % 7 WHEN 0 THEN 'next' WHEN 1 THEN 'last' WHEN 2 THEN 'verified_empty' WHEN 3 THEN 'total_changed' ELSE 'next' END AS decision,
    user_id AS start, event_id % 50 AS items, CASE WHEN event_id % 11 = 0 THEN 'invalid_page' END AS failure FROM events
), w AS (SELECT *, CASE WHEN state <> 'partial' THEN 'unit_not_open' WHEN failure IS NULL AND decision = 'total_changed' THEN decision END AS wrong FROM u)
SELECT event_id, coalesce(wrong, failure) AS error, CASE WHEN wrong IS NOT NULL THEN state WHEN failure IS NOT NULL THEN CASE WHEN version > 0 THEN 'partial' ELSE 'failed' END WHEN decision = 'verified_empty' THEN decision WHEN decision = 'last' THEN 'succeeded' ELSE 'partial' END AS state,
  CASE WHEN coalesce(wrong, failure) IS NULL THEN version + 1 ELSE version END AS version, CASE WHEN coalesce(wrong, failure) IS NULL THEN start + items ELSE start END AS next_start FROM w
""")
def unit_results(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("event_id")
    state = F.when(k % 5 == 0, "succeeded").when(k % 5 == 1, "unavailable").otherwise("partial")
    decision = F.when(k % 7 == 1, "last").when(k % 7 == 2, "verified_empty").when(k % 7 == 3, "total_changed").otherwise("next")
    after = traversal.unit_result(state, k % 3, decision, F.col("user_id"), k % 50, F.when(k % 11 == 0, "invalid_page"))
    return table(spark, folder, "events").select("event_id", after.alias("r")).select("event_id", "r.*")


@query("""
WITH n AS (SELECT o_custkey, max(o_orderdate) AS watermark FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1), b AS (SELECT o_custkey, max(o_orderdate) AS before FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1),
e AS (SELECT *, CASE WHEN watermark > TIMESTAMP '2001-01-01' - INTERVAL 3600 SECONDS THEN 'window_inside_safety_lag' WHEN watermark < before THEN 'watermark_moved_back' END AS error FROM n FULL JOIN b USING (o_custkey))
SELECT o_custkey AS stream, CAST(epoch_us(CASE WHEN error IS NULL THEN coalesce(watermark, before) ELSE before END) AS BIGINT) AS watermark_us, error FROM e
""")
def published_watermarks(spark: SparkSession, folder: str) -> DataFrame:
    at = F.col("o_orderdate").cast("timestamp")
    orders = table(spark, folder, "orders").withColumn("stream", F.col("o_custkey"))
    found = orders.where("o_orderstatus <> 'O'").groupBy("stream").agg(F.max(at).alias("watermark"))
    before = orders.where("o_orderkey % 3 = 0").groupBy("stream").agg(F.max(at).alias("watermark"))
    return traversal.published(found, before, F.to_timestamp(F.lit("2001-01-01 00:00:00")), 3600).select("stream", F.unix_micros("watermark").alias("watermark_us"), "error")


@query("""
WITH p AS (
  SELECT *, CASE WHEN p_size % 9 = 0 THEN 'malformed_xml' WHEN p_size % 9 = 1 THEN 'invalid_pubmed_identifier' WHEN p_size % 9 = 2 THEN 'duplicate_field' WHEN p_size % 9 = 3 THEN 'pubmed_batch_identity_mismatch' END AS error FROM part
)
SELECT p_partkey AS page_id, 0 AS place, CAST(p_partkey + 1 AS VARCHAR) AS pmid, p_name || ' of 10 2 m < ' || p_size AS title, 'AIM: ' || p_brand || chr(10) || p_type AS abstract, [split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1), p_brand] AS authors,
  '2024-' || p_size AS publication_date, 'month' AS precision, '10.1000/' || lower(p_type) AS doi, 'PMC' || p_partkey AS pmcid, ['eng', 'fre'] AS languages, [p_type, 'Review'] AS publication_types, NULL AS error FROM p WHERE error IS NULL
UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, error FROM p WHERE error IS NOT NULL
""")
def article_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as pages of one article, made of their names, brands and sizes."""
    n, size = F.col("p_size") % 9, F.col("p_size").cast("string")
    say = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    tag = lambda name, *parts: say(f"<{name}>", *parts, f"</{name.split()[0]}>")
    word = lambda k: F.split_part("p_name", F.lit(" "), F.lit(k))
    author = say(tag("Author", tag("LastName", word(2)), tag("ForeName", word(1)), tag("Initials", "X")), tag("Author", tag("CollectiveName", F.col("p_brand"))), "<Author/>")
    article = tag(
        "Article", tag("Journal", tag("JournalIssue", tag("PubDate", tag("Year", "2024"), tag("Month", size))), tag("Title", "J")), tag("ArticleTitle", F.col("p_name"), " of <b>10<sup> 2</sup></b>\n m &lt; ", size),
        tag("Abstract", tag('AbstractText Label="AIM"', F.col("p_brand")), tag("AbstractText", " ", F.col("p_type"), "\n"), "<AbstractText/>"), tag("AuthorList", author),
        tag("Language", "fre"), tag("Language", "eng"), tag("Language", "eng"), tag("PublicationTypeList", tag('PublicationType UI="D1"', F.col("p_type")), tag("PublicationType", "Review")),
    )
    doi = tag('ArticleId IdType="doi"', "10.1000/", F.col("p_type"))
    ids = tag("ArticleIdList", doi, F.when(n == 2, doi).otherwise(""), tag('ArticleId IdType="pmc"', "pmc", F.col("p_partkey").cast("string")))
    pmid = tag('PMID Version="1"', F.when(n == 1, "x").otherwise("0"), (F.col("p_partkey") + 1).cast("string"))
    body = tag("PubmedArticleSet", tag("PubmedArticle", tag("MedlineCitation", pmid, article), tag("PubmedData", ids)), F.when(n == 0, "<x>").otherwise(""))
    expected = F.array((F.col("p_partkey") + F.when(n == 3, 2).otherwise(1)).cast("string"))
    return xml_pages.article_records(table(spark, folder, "part").select(F.col("p_partkey").alias("page_id"), body.alias("body"), expected.alias("expected"))).drop("journal")

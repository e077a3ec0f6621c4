"""Queries of bindings, deliveries, access and replays over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators import delivery, evidence
from quillmark.plans.registry import query
from quillmark.sources.tables import table


@query("""
WITH p AS (SELECT c_custkey AS profile_id, CASE WHEN c_custkey % 5 > 0 THEN 1 + c_custkey % 2 END AS revision FROM customer WHERE c_mktsegment <> 'BUILDING'),
s AS (SELECT profile_id, revision, CASE (profile_id + revision) % 3 WHEN 0 THEN ['arxiv'] WHEN 1 THEN ['arxiv', 'crossref'] ELSE ['pubmed'] END AS ps FROM p WHERE revision IS NOT NULL),
c AS (SELECT DISTINCT o_custkey AS profile_id, 1 + o_custkey % 2 AS revision, o_orderkey % 9 AS domain_id, 1 + o_orderkey % 2 AS domain_revision FROM orders),
d AS (SELECT s_suppkey AS domain_id, 1 AS domain_revision, CASE s_suppkey % 2 WHEN 0 THEN ['crossref', 'arxiv'] ELSE ['pubmed'] END AS ds FROM supplier),
j AS (SELECT profile_id, domain_id, list_sort(list_intersect(ps, ds)) AS both_of FROM s JOIN c USING (profile_id, revision) JOIN d USING (domain_id, domain_revision))
SELECT profile_id, domain_id, unnest(CASE WHEN len(both_of) > 0 THEN both_of ELSE [NULL] END) AS source, len(both_of) = 0 AS gap FROM j
""")
def active_bindings(spark: SparkSession, folder: str) -> DataFrame:
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    arrays = lambda *xs: F.array(*(F.array(*map(F.lit, x)) for x in xs))
    profiles = table(spark, folder, "customer").select(k.alias("profile_id"), F.when(F.col("c_mktsegment") != "BUILDING", "active").otherwise("paused").alias("lifecycle"), F.when(k % 5 > 0, 1 + k % 2).alias("published_revision"))
    revisions = profiles.select("profile_id", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("revision"))
    revisions = revisions.withColumn("sources", F.get(arrays(["arxiv"], ["arxiv", "crossref"], ["pubmed"]), ((F.col("profile_id") + F.col("revision")) % 3).cast("int")))
    chosen = table(spark, folder, "orders").select(F.col("o_custkey").alias("profile_id"), (1 + F.col("o_custkey") % 2).alias("revision"), (o % 9).alias("domain_id"), (1 + o % 2).alias("domain_revision")).distinct()
    domains = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("domain_id"), F.lit(1).cast("long").alias("domain_revision"), F.get(arrays(["crossref", "arxiv"], ["pubmed"]), (F.col("s_suppkey") % 2).cast("int")).alias("sources"))
    return delivery.active_bindings(profiles, revisions, chosen, domains)


@query("""
WITH e AS (SELECT event_id, user_id AS work_id, user_id % 4 AS revision_id FROM events),
p AS (SELECT c_custkey AS work_id, c_custkey AS summary_id, (c_custkey + CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END) % 4 AS r, c_custkey % 3 AS f FROM customer WHERE c_custkey % 5 > 0),
s AS (SELECT c_custkey AS summary_id, (c_custkey + CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END) % 4 AS sr, c_custkey % CASE WHEN c_custkey % 7 = 0 THEN 4 ELSE 3 END AS sf, CASE WHEN c_custkey % 8 = 0 THEN 'pending' ELSE 'passed' END AS qa FROM customer WHERE c_custkey % 11 > 0),
g AS (SELECT event_id, e.work_id, p.summary_id, CASE WHEN p.summary_id IS NULL THEN 'no_summary' WHEN r <> revision_id THEN 'other_revision' WHEN sr IS NULL OR sr <> r OR sf <> f THEN 'corrupt' WHEN qa <> 'passed' THEN 'not_passed' END AS guard
  FROM e LEFT JOIN p USING (work_id) LEFT JOIN s ON s.summary_id = p.summary_id)
SELECT event_id, work_id, CASE WHEN guard IS NULL THEN summary_id END AS summary_id, guard FROM g
""")
def current_summaries(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    revision = (k + F.when(k % 6 == 0, 1).otherwise(0)) % 4
    events = table(spark, folder, "events").select("event_id", F.col("user_id").alias("work_id"), (F.col("user_id") % 4).alias("revision_id"))
    customers = table(spark, folder, "customer")
    pointers = customers.where(k % 5 > 0).select(k.alias("work_id"), F.lit("en").alias("language"), k.alias("summary_id"), revision.alias("revision_id"), (k % 3).alias("fingerprint"))
    summaries = customers.where(k % 11 > 0).select(k.alias("summary_id"), revision.alias("revision_id"), F.when(k % 7 == 0, k % 4).otherwise(k % 3).alias("fingerprint"), F.when(k % 8 == 0, "pending").otherwise("passed").alias("qa_state"))
    return delivery.guarded_summaries(events, pointers, summaries, "en")


@query("""
WITH r AS (SELECT l_orderkey % 50 AS digest_id, l_suppkey % 5 AS reader_id, l_partkey % 400 AS event_id, CAST(l_orderkey * 100 + l_linenumber * 10 AS BIGINT) + l_quantity::BIGINT * 10000000 AS at_no FROM lineitem),
u AS (SELECT DISTINCT ON (digest_id, reader_id, event_id, at_no) * FROM r),
o AS (SELECT *, first_value(digest_id) OVER w AS owner, row_number() OVER (PARTITION BY reader_id, event_id, digest_id ORDER BY at_no) > 1 AS again FROM u WINDOW w AS (PARTITION BY reader_id, event_id ORDER BY at_no, digest_id))
SELECT digest_id, event_id, at_no AS asked, CASE WHEN event_id % 13 = 0 AND reader_id = 1 OR owner <> digest_id THEN 'already_notified' WHEN again THEN 'replayed' ELSE 'queued' END AS outcome FROM o
""")
def digest_queue(spark: SparkSession, folder: str) -> DataFrame:
    at = (F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10 + F.col("l_quantity").cast("long") * 10_000_000).cast("long")
    requests = table(spark, folder, "lineitem").select((F.col("l_orderkey") % 50).alias("digest_id"), (F.col("l_suppkey") % 5).alias("reader_id"), F.lit("email").alias("channel"), (F.col("l_partkey") % 400).alias("event_id"), at.alias("at")).distinct()
    ledger = spark.range(0, 400, 13).select(F.lit(1).cast("long").alias("reader_id"), F.lit("email").alias("channel"), F.col("id").alias("event_id"))
    return delivery.queued(requests, ledger).withColumnRenamed("at", "asked")


@query("""
WITH e AS (SELECT event_id, user_id AS work_id FROM events WHERE event_type IN ('purchase', 'error')),
t AS (SELECT DISTINCT o_orderkey % 7 AS reader_id, o_custkey AS work_id FROM orders),
j AS (SELECT event_id, event_id % 7 AS reader_id, CASE event_id % 4 WHEN 0 THEN 'sent' WHEN 1 THEN 'failed' ELSE 'queued' END AS job FROM events)
SELECT e.event_id, t.reader_id, CASE WHEN t.reader_id IS NULL THEN 'no_prior_recipient' WHEN t.reader_id = 3 THEN 'disabled' WHEN job = 'sent' THEN 'sent' WHEN job = 'failed' THEN 'failed' ELSE 'pending' END AS outcome
FROM e LEFT JOIN t USING (work_id) LEFT JOIN j ON j.event_id = e.event_id AND j.reader_id = t.reader_id
""")
def notice_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    all_events = table(spark, folder, "events")
    events = all_events.where("event_type in ('purchase', 'error')").select("event_id", F.col("user_id").alias("work_id"), F.when(F.col("event_type") == "error", "correction").otherwise("retraction").alias("event_kind"))
    prior = table(spark, folder, "orders").select((F.col("o_orderkey") % 7).alias("reader_id"), F.col("o_custkey").alias("work_id"))
    subscriptions = spark.range(7).select(F.col("id").alias("reader_id"), (F.col("id") != 3).alias("enabled"))
    state = F.when(F.col("event_id") % 4 == 0, "sent").when(F.col("event_id") % 4 == 1, "failed").otherwise("queued")
    jobs = all_events.select("event_id", (F.col("event_id") % 7).alias("reader_id"), state.alias("state"))
    return delivery.notices(events, prior, subscriptions, jobs)


@query("""
WITH a AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'abstract' WHEN 3 THEN 'other' ELSE 'full_text' END AS scope, CASE page_id % 5 WHEN 0 THEN 404 WHEN 1 THEN 206 ELSE 200 END AS status, page_id % 6 > 0 AS same, page_id % 7 > 0 AS safe, CASE page_id % 3 WHEN 0 THEN 'text/html' WHEN 1 THEN 'image/png' END AS t FROM pages),
e AS (SELECT *, CASE WHEN scope = 'other' THEN 'invalid_access_evidence' WHEN NOT safe THEN 'unsafe_access_target' WHEN status IN (200, 206) AND same AND scope = 'full_text' AND coalesce(t <> 'text/html', true) THEN 'unsupported_access_content' END AS error FROM a)
SELECT page_id, error, CASE WHEN error IS NULL THEN CASE WHEN status IN (200, 206) AND same THEN 'open' ELSE 'unknown' END END AS reader_access FROM e
""")
def access_policy(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("page_id")
    rows = table(spark, folder, "pages").select(
        k, F.when(k % 4 == 0, "abstract").when(k % 4 == 3, "other").otherwise("full_text").alias("scope"), F.lit("open").alias("signal"), F.when(k % 5 == 0, 404).when(k % 5 == 1, 206).otherwise(200).alias("status"),
        F.when(k % 3 == 0, "text/html").when(k % 3 == 1, "image/png").alias("content_type"), (k % 6 > 0).alias("identity_matches"), (k % 7 > 0).alias("url_safe"),
    )
    return delivery.access(rows).select("page_id", "error", "reader_access")


@query("""
SELECT p_brand AS kind, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS bytes, count(*) <= 60 AND sum(p_size) <= 1500 AS complete FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_tax > 0.05) GROUP BY 1
""")
def orphan_totals(spark: SparkSession, folder: str) -> DataFrame:
    objects = table(spark, folder, "part").select(F.col("p_brand").alias("kind"), F.col("p_partkey").alias("object_id"), F.col("p_size").alias("size"))
    attached = table(spark, folder, "lineitem").where("l_returnflag = 'R' and l_tax > 0.05").select(F.col("l_partkey").alias("object_id"))
    return delivery.orphan_totals(objects, attached, 60, 1500)


@query("""
SELECT doc_id AS observation_id, CASE WHEN doc_id % 7 = 0 THEN 'object_missing' WHEN doc_id % 5 = 0 THEN 'object_changed' WHEN doc_id % 3 = 0 THEN 'record_missing' ELSE 'record_changed' END AS problem
FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0 OR doc_id % 3 = 0 OR doc_id % 4 = 0
""")
def observation_replay(spark: SparkSession, folder: str) -> DataFrame:
    k, docs = F.col("doc_id"), table(spark, folder, "documents")
    now = F.sha2("text", 256)
    observations = docs.select(k.alias("observation_id"), k.alias("object_id"), F.lit(0).alias("place"), F.sha2(F.concat("text", F.when(k % 4 == 0, "x").otherwise("")), 256).alias("record_sha256"))
    objects = docs.where(k % 7 > 0).select(k.alias("object_id"), F.sha2("lang", 256).alias("sha256"), F.sha2(F.concat("lang", F.when(k % 5 == 0, "x").otherwise("")), 256).alias("actual_sha256"))
    parsed = docs.where(k % 3 > 0).select(k.alias("object_id"), F.lit(0).alias("place"), now.alias("record_sha256"))
    return delivery.replay_problems(observations, objects, parsed)


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN o_orderkey IS NULL THEN 'missing_o_orderkey' WHEN l_shipdate < o_orderdate THEN 'broken_o_orderkey' WHEN p_partkey IS NULL THEN 'missing_p_partkey' WHEN p_size <= 5 THEN 'broken_p_partkey'
  WHEN s_suppkey IS NULL THEN 'missing_s_suppkey' WHEN s_acctbal <= 0 THEN 'broken_s_suppkey' END AS mismatch
FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 17 > 0) ON o_orderkey = l_orderkey LEFT JOIN (SELECT * FROM part WHERE p_partkey % 19 > 0) ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey
""")
def integrity_proof(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey"), "l_shipdate")
    orders, parts = table(spark, folder, "orders").where("o_orderkey % 17 > 0").select("o_orderkey", "o_orderdate"), table(spark, folder, "part").where("p_partkey % 19 > 0").select("p_partkey", "p_size")
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_acctbal")
    out = delivery.integrity_source(lines, (orders, "o_orderkey", F.col("l_shipdate") >= F.col("o_orderdate")), (parts, "p_partkey", F.col("p_size") > 5), (suppliers, "s_suppkey", F.col("s_acctbal") > 0))
    return out.select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "mismatch")


@query("""
SELECT l_orderkey AS claim_id, l_partkey AS anchor_id FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size % 5 = l_suppkey % 5)
""")
def claims_outside(spark: SparkSession, folder: str) -> DataFrame:
    claims = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("claim_id"), (F.col("l_suppkey") % 5).alias("snapshot_id"), F.col("l_partkey").alias("anchor_id"))
    anchors = table(spark, folder, "part").select((F.col("p_size") % 5).cast("long").alias("snapshot_id"), F.col("p_partkey").alias("anchor_id"))
    return evidence.claims_outside(claims, anchors).select("claim_id", "anchor_id")


@query(r"""
WITH p AS (SELECT a.doc_id, a.text || CASE WHEN a.doc_id % 4 = 0 THEN ' 12 kg 7' ELSE '' END AS x, b.text || CASE WHEN b.doc_id % 2 = 0 THEN ' 12 kg' ELSE ' 12 m' END AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id - a.doc_id % 2 + 1 - a.doc_id % 3 % 2),
n AS (SELECT doc_id, list_filter(regexp_extract_all(x, '(^|[^A-Za-z0-9_])([+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?)', 2), lambda v: v <> '') AS l, list_filter(regexp_extract_all(y, '(^|[^A-Za-z0-9_])([+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?)', 2), lambda v: v <> '') AS r FROM p)
SELECT doc_id AS pair_id, 'number_mismatch' AS finding FROM n WHERE len(list_filter(l, lambda v: len(list_filter(l, lambda w: w = v)) > len(list_filter(r, lambda w: w = v)))) > 0
""")
def verification_findings(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    k = F.col("doc_id")
    other = docs.select(k.alias("_id"), F.concat("text", F.when(k % 2 == 0, " 12 kg").otherwise(" 12 m")).alias("source"))
    pairs = docs.join(other, F.col("_id") == k - k % 2 + 1 - k % 3 % 2).select(k.alias("pair_id"), F.concat("text", F.when(k % 4 == 0, " 12 kg 7").otherwise("")).alias("text"), "source")
    return evidence.findings(pairs).where("finding = 'number_mismatch'")

"""Queries of roles, ids of evidence and explanation outcomes over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators import evidence
from quillmark.plans.registry import query
from quillmark.sources.tables import table


@query("""
SELECT o_orderkey, (o_orderkey % 5 IN (1, 2) AND o_orderkey % 3 > 0) OR (o_orderkey % 5 = 2) AS mismatch FROM (SELECT o_orderkey FROM orders) WHERE o_orderkey % 5 <> 4
UNION ALL SELECT o_orderkey, false FROM orders WHERE o_orderkey % 5 = 4
""")
def role_values(spark: SparkSession, folder: str) -> DataFrame:
    """Compared values that are another's in the source; a source in another script is never held against."""
    k = F.col("o_orderkey")
    base = F.when((k % 5 == 1) & (k % 3 > 0), "12").when((k % 5 == 2), "13").otherwise("11")
    text = F.concat(F.lit("The Baseline gave "), base, F.lit(" points, 20 for the proposed method."))
    source = F.when(k % 5 == 4, F.lit("基準 99")).otherwise(F.lit("baseline: 11, while 20: our method"))
    return table(spark, folder, "orders").select("o_orderkey", evidence.role_mismatch(text, source).alias("mismatch"))


@query("""
WITH s AS (
  SELECT doc_id, substr(text, 5, 60) AS quote, 'snapshot:' || sha256('{"evidence_level":"abstract_only","format_version":1,"object_id":"o' || doc_id || '","parser_version":"p1","revision_id":"r' || doc_id || '","text_object_id":"t' || doc_id || '","work_id":"w"}') AS snapshot_id
  FROM documents
)
SELECT doc_id, snapshot_id, 'anchor:' || sha256('{"offset_end":' || (length(quote) + 4) || ',"offset_start":4,"quote":' || CAST(to_json(quote) AS VARCHAR) || ',"section_label":null,"snapshot_id":"' || snapshot_id || '"}') AS anchor_id FROM s
""")
def evidence_ids(spark: SparkSession, folder: str) -> DataFrame:
    quote = F.substring("text", 5, 60)
    docs = table(spark, folder, "documents")
    key = lambda p: F.concat(F.lit(p), F.col("doc_id").cast("string"))
    snapshots = docs.select(key("r").alias("revision_id"), F.lit("w").alias("work_id"), key("o").alias("object_id"), key("t").alias("text_object_id"), F.lit("p1").alias("parser_version"), F.lit("abstract_only").alias("evidence_level"))
    anchors = docs.select("doc_id", key("r").alias("revision_id"), quote.alias("quote"), F.lit(4).alias("offset_start"), (F.length(quote) + 4).alias("offset_end"), F.lit(None).cast("string").alias("section_label"))
    return evidence.identified(snapshots, anchors)[1].select("doc_id", "snapshot_id", "anchor_id")


@query("""
WITH x AS (SELECT o_orderkey AS k, CASE o_orderkey % 7 WHEN 0 THEN 'stale' WHEN 1 THEN 'failed' WHEN 2 THEN 'odd' ELSE 'succeeded' END AS execution, CASE o_orderkey % 4 WHEN 0 THEN 'direct' WHEN 1 THEN 'adjacent' WHEN 2 THEN 'uncertain' ELSE 'direct' END AS decision,
  CASE o_orderkey % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'rejected' WHEN 2 THEN 'odd' ELSE 'passed' END AS qa FROM orders)
SELECT k AS o_orderkey, CASE WHEN k % 31 = 0 OR k % 29 = 0 THEN 'awaiting_external' WHEN k % 23 = 0 OR execution = 'stale' THEN 'cancelled' WHEN execution = 'failed' THEN 'failed' WHEN execution = 'odd' THEN 'awaiting_external' WHEN decision = 'uncertain' THEN 'succeeded'
    WHEN qa = 'pending' THEN 'awaiting_external' WHEN qa = 'rejected' THEN 'cancelled' WHEN qa = 'odd' OR k % 19 = 0 THEN 'awaiting_external' ELSE 'succeeded' END AS state,
  CASE WHEN k % 31 = 0 THEN 'explanation_evidence_mismatch' WHEN k % 29 = 0 THEN 'explanation_relevance_mismatch' WHEN k % 23 = 0 OR execution = 'stale' THEN 'scheduled_input_stale' WHEN execution = 'failed' THEN 'relevance_assessment_failed' WHEN execution = 'odd' THEN 'relevance_assessment_corrupt'
    WHEN decision = 'uncertain' THEN NULL WHEN qa = 'pending' THEN 'summary_verification_pending' WHEN qa = 'rejected' THEN 'summary_verification_rejected' WHEN qa = 'odd' THEN 'summary_qa_state_corrupt' WHEN k % 19 = 0 THEN 'current_summary_mismatch' END AS error_code
FROM x
""")
def explanation_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    pick = lambda n, *xs: F.get(F.array(*map(F.lit, xs)), (k % n).cast("int"))
    rows = table(spark, folder, "orders").select(
        k, (k % 31 > 0).alias("same_evidence"), (k % 29 > 0).alias("same_profile"), (k % 23 > 0).alias("same_revisions"), F.coalesce(pick(7, "stale", "failed", "odd"), F.lit("succeeded")).alias("execution"),
        pick(4, "direct", "adjacent", "uncertain", "direct").alias("decision"), F.coalesce(pick(6, "pending", "rejected", "odd"), F.lit("passed")).alias("qa_state"), (k % 19 > 0).alias("pointer_matches"),
    )
    return evidence.explanation_outcome(rows).select("o_orderkey", "state", "error_code")


@query("""
SELECT o_orderkey AS card_id, 'translation_numbers' AS problem FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT o_orderkey, 'point_numbers' FROM orders WHERE o_orderkey % 7 = 0
""")
def card_problems(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    n = k.cast("string")
    points = F.array(F.concat(F.lit("about "), n), F.when(k % 7 == 0, "and -3.5").otherwise("none"))
    cards = table(spark, folder, "orders").select(k.alias("card_id"), F.concat(F.lit("é 2 x "), n, F.when(k % 5 == 0, " 2").otherwise("")).alias("translation"), F.concat(n, F.lit(" a 2")).alias("source"), points.alias("points"), F.array(F.concat(n, F.lit(", 3.5")), F.lit("x")).alias("quotes"))
    return evidence.card_problems(cards)


@query("""
WITH q AS (SELECT DISTINCT l_orderkey AS request_id, l_linenumber AS claim_id FROM lineitem),
r AS (SELECT l_orderkey AS request_id, CASE WHEN l_orderkey % 9 = 0 THEN l_linenumber + 1 ELSE l_linenumber END AS claim_id, CASE l_returnflag WHEN 'R' THEN 'unsupported' WHEN 'A' THEN 'uncertain' ELSE 'supported' END AS support FROM lineitem WHERE l_linenumber < 7),
g AS (SELECT request_id, claim_id, count(*) AS n, bool_or(support = 'unsupported') AS bad, bool_or(support = 'uncertain') AS undecided FROM r GROUP BY 1, 2),
b AS (SELECT coalesce(q.request_id, g.request_id) AS request_id, q.claim_id IS NULL OR n IS NULL OR n > 1 AS wrong, bad, undecided FROM q FULL JOIN g ON q.request_id = g.request_id AND q.claim_id = g.claim_id)
SELECT request_id, CASE WHEN bool_or(wrong) THEN 'invalid' WHEN bool_or(bad) THEN 'rejected' WHEN bool_or(undecided) THEN 'pending' ELSE 'passed' END AS verdict FROM b GROUP BY 1
""")
def support_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    claim = F.when(F.col("l_orderkey") % 9 == 0, F.col("l_linenumber") + 1).otherwise(F.col("l_linenumber"))
    support = F.when(F.col("l_returnflag") == "R", "unsupported").when(F.col("l_returnflag") == "A", "uncertain").otherwise("supported")
    requests = lines.select(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("claim_id"))
    responses = lines.where("l_linenumber < 7").select(F.col("l_orderkey").alias("request_id"), claim.alias("claim_id"), support.alias("support"))
    return evidence.support_verdicts(requests, responses)

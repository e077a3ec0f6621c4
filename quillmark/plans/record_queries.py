"""Queries of kept summaries and of published profiles over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators import publishing, summaries
from quillmark.plans.registry import query
from quillmark.sources.tables import table


def sha(*parts: Column | str) -> Column:
    return F.sha2(F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts)), 256)


def summary_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as cards: the text is the abstract, its language and source make statements, and its length what the verifiers found."""
    k, n = F.col("doc_id").cast("string"), F.coalesce("n_chars", F.lit(0).cast("long"))
    tagged = lambda tag: F.concat(F.lit(tag + ":"), sha(tag, k))
    claim = F.array(tagged("claim"))
    statement = F.struct(F.lit("method").alias("claim_type"), F.concat(F.coalesce("source", F.lit("-")), F.lit(' "說明"\n')).alias("text"), claim.alias("claim_ids"))
    finding = F.struct(F.lit("number_mismatch").alias("code"), F.lit("card").alias("source_kind"), F.lit(0).alias("source_index"), claim.alias("claim_ids"))
    verdict = F.when(n % 11 == 0, "rejected").otherwise("passed")
    support = F.when((n % 11 > 0) & (n % 3 > 0), F.array(F.struct(F.lit(0).alias("statement_index"), F.when(n % 5 == 0, "unsupported").when(n % 7 == 0, "uncertain").otherwise("supported").alias("verdict"), claim.alias("claim_ids"))))
    backed = support.isNotNull()
    qa = F.when(n % 11 == 0, "rejected").when(backed, summaries.support_outcome(support)).otherwise("pending")
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("request_id"), *(tagged(t).alias(f"{t}_id") for t in ("snapshot", "revision", "work")), sha("input", k).alias("input_fingerprint"), F.coalesce("text", F.lit("")).alias("original_abstract"),
        F.when(n % 13 == 0, "en").otherwise("zh-TW").alias("language"), F.lit("abstract_only").alias("evidence_level"), F.lit("draft_requires_verification").alias("validation_state"), F.array(statement).alias("translation"),
        F.array(statement, statement).alias("card"), F.array(F.lit("limits")).alias("not_reported"), claim.alias("claim_ids"), verdict.alias("verdict"), F.when(verdict == "rejected", F.array(finding)).otherwise(F.array().cast(summaries.FINDINGS)).alias("findings"),
        qa.alias("qa_state"), F.when(verdict == "rejected", "not_run").when(backed, "succeeded").otherwise("failed").alias("support_state"), support.alias("support"), F.when(backed, sha("support", k)).alias("support_fingerprint"),
        *(F.concat(F.lit("run:"), sha(r, k)).alias(f"{r}_run") for r in ("claim", "reading")), *(sha(r, "f", k).alias(f"{r}_fingerprint") for r in ("claim", "reading")),
        F.when(backed, F.concat(F.lit("run:"), sha("s", k))).alias("support_run"), F.when(backed, sha("sf", k)).alias("support_run_fingerprint"), F.timestamp_seconds(F.lit(1_700_000_000) + n).alias("created_at"),
    )


RECORDS = """
WITH d AS (SELECT doc_id, doc_id::VARCHAR AS k, coalesce(text, '') AS text, coalesce(source, '-') AS source, coalesce(n_chars, 0) AS n FROM documents),
e AS (
  SELECT *, n % 13 = 0 AS bad, n % 11 > 0 AND n % 3 > 0 AS backed, CASE WHEN n % 5 = 0 THEN 'unsupported' WHEN n % 7 = 0 THEN 'uncertain' ELSE 'supported' END AS said, '["claim:' || sha256('claim' || k) || '"]' AS claims,
    '"input_fingerprint":"' || sha256('input' || k) || '","revision_id":"revision:' || sha256('revision' || k) || '","snapshot_id":"snapshot:' || sha256('snapshot' || k) || '"' AS ids, 'work:' || sha256('work' || k) AS work,
    '2023-11-' || strftime(TIMESTAMP '2023-11-14 22:13:20' + to_seconds(n), '%dT%H:%M:%S') || '+00:00' AS made_at FROM d
), s AS (
  SELECT *, '{"claim_ids":' || claims || ',"claim_type":"method","text":' || to_json(source || ' "說明"' || chr(10)) || '}' AS st FROM e
), t AS (
  SELECT *, '{"claim_ids":' || claims || ',"evidence_level":"abstract_only","explanation_profile":"plain-zh-TW-v1","faithful_translation":[' || st || '],"format_version":1,"generation_fingerprint":"' || sha256('readingf' || k) || '","generation_input_fingerprint":"' || sha256('input' || k) ||
    '","language":"zh-TW","not_reported_in_read_evidence":["limits"],"original_abstract":' || to_json(text) || ',"plain_language_card":[' || st || ',' || st || '],"revision_id":"revision:' || sha256('revision' || k) || '","snapshot_id":"snapshot:' || sha256('snapshot' || k) || '","work_id":"' || work || '"}' AS summary FROM s
), u AS (SELECT *, 'summary:' || sha256('verified-summary-v1' || chr(0) || summary) AS summary_id FROM t)
"""


@query(RECORDS + """
SELECT doc_id AS request_id, CASE WHEN bad THEN 'invalid_summary_persistence' END AS error, CASE WHEN NOT bad THEN summary_id END AS summary_id,
  CASE WHEN bad THEN NULL WHEN n % 11 = 0 THEN 'rejected' WHEN NOT backed THEN 'pending' WHEN said = 'unsupported' THEN 'rejected' WHEN said = 'uncertain' THEN 'pending' ELSE 'passed' END AS qa_state,
  CASE WHEN NOT bad THEN sha256('{"format_version":1,"report":{"findings":[' || CASE WHEN n % 11 = 0 THEN '{"claim_ids":' || claims || ',"code":"number_mismatch","source_index":0,"source_kind":"card"}' ELSE '' END || '],' || ids || ',"verdict":"' ||
    CASE WHEN n % 11 = 0 THEN 'rejected' ELSE 'passed' END || '","work_id":"' || work || '"},"summary_id":"' || summary_id || '","verified_at":"' || made_at || '","verifier_kind":"deterministic-v1"}') END AS report_sha256,
  CASE WHEN NOT bad AND backed THEN sha256('{"execution_state":"succeeded","format_version":1,"report":{"input_fingerprint":"' || sha256('support' || k) || '","snapshot_id":"snapshot:' || sha256('snapshot' || k) || '","statements":[{"claim_ids":' || claims ||
    ',"statement_index":0,"verdict":"' || said || '"}]},"summary_id":"' || summary_id || '","verified_at":"' || made_at || '","verifier_kind":"supportiveness-v1"}') END AS support_sha256,
  CASE WHEN NOT bad AND backed THEN CASE said WHEN 'unsupported' THEN 'rejected' WHEN 'supported' THEN 'passed' END END AS support_verdict
FROM u
""")
def kept_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of summaries and hashes of the reports that are kept with them."""
    found = summaries.prepared(summary_requests(spark, folder))
    return found.select("request_id", "error", "summary_id", "qa_state", F.sha2("deterministic_report", 256).alias("report_sha256"), F.sha2("support_report", 256).alias("support_sha256"), "support_verdict")


@query("""
WITH RECURSIVE log AS (
  SELECT o_custkey AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey AS seq, o_orderstatus <> 'P' AS publishes, CASE WHEN o_totalprice > 400000 THEN 'other' ELSE 'reader' END AS reader, o_orderpriority AS fingerprint,
    CASE WHEN o_totalprice < 100000 THEN NULL ELSE floor(o_totalprice / 150000)::INTEGER END AS expected, o_custkey % 25 + year(o_orderdate) % 10 > 28 AS lacks, CASE WHEN o_totalprice > 450000 THEN 'archived' WHEN o_totalprice > 200000 THEN 'paused' ELSE 'gone' END AS to_state FROM orders
), f AS (
  SELECT p, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::VARCHAR AS reader, NULL::VARCHAR AS lifecycle, NULL::INTEGER AS current, []::VARCHAR[] AS known, NULL::VARCHAR AS outcome, NULL::INTEGER AS revision FROM (SELECT DISTINCT p FROM log)
  UNION ALL
  SELECT p, n, seq, CASE outcome WHEN 'published' THEN new_reader ELSE reader END, CASE outcome WHEN 'published' THEN coalesce(lifecycle, 'active') WHEN 'set' THEN to_state ELSE lifecycle END,
    CASE outcome WHEN 'published' THEN coalesce(current, 0) + 1 ELSE current END, CASE outcome WHEN 'published' THEN list_append(known, fingerprint) ELSE known END, outcome,
    CASE outcome WHEN 'published' THEN coalesce(current, 0) + 1 WHEN 'replayed' THEN list_position(known, fingerprint)::INTEGER END
  FROM (
    SELECT log.p, log.n, log.seq, f.reader, log.reader AS new_reader, lifecycle, current, known, fingerprint, to_state, CASE
      WHEN NOT publishes THEN CASE WHEN to_state = 'gone' THEN 'invalid_lifecycle' WHEN current IS NULL THEN 'profile_missing' WHEN lifecycle = 'archived' THEN 'profile_archived' ELSE 'set' END
      WHEN current IS NOT NULL AND f.reader <> log.reader THEN 'identity_conflict' WHEN lifecycle = 'archived' THEN 'profile_archived' WHEN list_contains(known, fingerprint) THEN 'replayed'
      WHEN current IS DISTINCT FROM expected THEN 'revision_conflict' WHEN lacks THEN 'domain_revision_missing' ELSE 'published' END AS outcome
    FROM f JOIN log ON log.p = f.p AND log.n = f.n + 1
  )
)
SELECT 'p' || p AS profile_id, seq, outcome, revision, lifecycle FROM f WHERE n > 0
""")
def profile_publications(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as a log of publications and changes of lifecycle of their customers' profiles."""
    price = F.col("o_totalprice")
    domain = F.array(F.struct(F.lit("d").alias("id"), (F.col("o_custkey") % 25 + F.year("o_orderdate") % 10).cast("int").alias("revision")))
    log = table(spark, folder, "orders").select(
        F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("profile_id"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "P", "lifecycle").otherwise("publish").alias("action"),
        F.when(price > 400_000, "other").otherwise("reader").alias("reader_id"), F.lit("name").alias("name"), F.col("o_orderpriority").alias("fingerprint"), F.when(price >= 100_000, F.floor(price / 150_000).cast("int")).alias("expected_revision"),
        domain.alias("domains"), F.when(price > 450_000, "archived").when(price > 200_000, "paused").otherwise("gone").alias("lifecycle"),
    )
    return publishing.decided(log, spark.range(29).select(F.lit("d").alias("id"), F.col("id").cast("int").alias("revision")))

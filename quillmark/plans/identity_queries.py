"""Queries of registers, clusters and alias logs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators import aliases, clusters, identity
from quillmark.plans.registry import query
from quillmark.sources.tables import table


@query("""
WITH RECURSIVE o AS (
  SELECT o_orderkey * 2 + again AS seq, 'o' || o_custkey || '-' || month(o_orderdate) AS sid, 'doi:10.1000/' || floor(o_totalprice / 100)::BIGINT AS key,
    CASE WHEN o_orderpriority < '3' THEN 'preprint' ELSE 'publication' END AS kind, sha256(o_orderstatus) AS content, [o_orderpriority, o_orderstatus] AS about,
    [o_custkey::VARCHAR, floor(o_totalprice / 100)::VARCHAR, o_orderpriority, o_orderstatus, o_orderdate::VARCHAR] AS said
  FROM orders, range(2) t(again) WHERE again = 0 OR o_orderstatus = 'P'
), r AS (
  SELECT 0 AS n, *, NULL::VARCHAR AS error, false AS created_work, false AS created_revision FROM o
  UNION ALL
  SELECT n + 1, seq, sid, key, kind, content, about, said, now, now IS NULL AND kind_at = seq, now IS NULL AND about_at = seq FROM (
    SELECT *, CASE WHEN said_at < seq AND first_said <> said THEN 'source_observation_conflict' WHEN kind_at < seq AND first_kind <> kind THEN 'manifestation_conflict'
      WHEN about_at < seq AND first_about <> about THEN 'revision_conflict' END AS now
    FROM (
      SELECT *, min(seq) FILTER (error IS NULL) OVER (PARTITION BY sid) AS said_at, arg_min(said, seq) FILTER (error IS NULL) OVER (PARTITION BY sid) AS first_said,
        min(seq) FILTER (error IS NULL) OVER (PARTITION BY key) AS kind_at, arg_min(kind, seq) FILTER (error IS NULL) OVER (PARTITION BY key) AS first_kind,
        min(seq) FILTER (error IS NULL) OVER (PARTITION BY key, content) AS about_at, arg_min(about, seq) FILTER (error IS NULL) OVER (PARTITION BY key, content) AS first_about
      FROM r
    ) WHERE n < 16
  )
), ids AS (
  SELECT *, 'manifestation:' || sha256('manifestation-identity-v1' || chr(0) || key || chr(0)) AS m FROM r WHERE n = 16
)
SELECT seq, error, CASE WHEN error IS NULL THEN 'work:' || sha256('work-identity-v1' || chr(0) || key || chr(0)) END AS work_id, CASE WHEN error IS NULL THEN m END AS manifestation_id,
  CASE WHEN error IS NULL THEN 'revision:' || sha256('revision-identity-v1' || chr(0) || m || chr(0) || content || chr(0)) END AS revision_id,
  created_work, created_work AS created_manifestation, created_revision
FROM ids
""")
def identity_register(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as observations, some sent twice: a customer's month is the id of what was observed, and prices are identifiers."""
    orders = table(spark, folder, "orders").withColumn("again", F.explode(F.when(F.col("o_orderstatus") == "P", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    rows = orders.select(
        (F.col("o_orderkey") * 2 + F.col("again")).alias("seq"), F.concat(F.lit("o"), F.col("o_custkey").cast("string"), F.lit("-"), F.month("o_orderdate").cast("string")).alias("source_observation_id"),
        F.lit("doi").alias("namespace"), F.concat(F.lit("10.1000/"), F.floor(F.col("o_totalprice") / 100).cast("string")).alias("value"), F.col("o_orderstatus").alias("native_version"),
        F.col("o_orderpriority").alias("title"), F.sha2("o_orderstatus", 256).alias("fingerprint"), F.when(F.col("o_orderpriority") < "3", "preprint").otherwise("publication").alias("manifestation_kind"),
        F.lit("https://example.org/").alias("landing_url"), F.lit("published").alias("publication_status"), F.col("o_orderdate").alias("observed_at"),
        F.lit(None).cast("timestamp_ntz").alias("source_updated_at"), F.lit(None).cast("timestamp_ntz").alias("published_at"),
    )
    return identity.registered(rows)


@query("""
WITH RECURSIVE o AS (
  SELECT o_orderkey, o_custkey, o_orderpriority, ['a:' || floor(o_totalprice / 10)::BIGINT, 'b:' || o_custkey || '-' || month(o_orderdate) || '-' || o_orderstatus] AS ids FROM orders
), e AS (SELECT ids[1] AS a, ids[2] AS b FROM o UNION SELECT ids[2], ids[1] FROM o),
reach AS (SELECT a AS node, a AS label FROM e UNION SELECT e.b, label FROM reach JOIN e ON e.a = node),
roots AS (SELECT node, min(label) AS cluster FROM reach GROUP BY node),
known AS (SELECT ids[1] AS identifier, 'work:' || o_custkey AS work_id FROM o WHERE o_orderpriority = '1-URGENT'),
works AS (SELECT cluster, min(work_id) AS work_id, count(DISTINCT work_id) AS n FROM known JOIN roots ON identifier = node GROUP BY cluster)
SELECT o_orderkey AS observation_id, roots.cluster, coalesce(n, 0) AS n_works, CASE WHEN n IS NULL THEN 'new' WHEN n = 1 THEN 'known' ELSE 'conflict' END AS status,
  CASE WHEN n IS NULL THEN 'work:' || roots.cluster WHEN n = 1 THEN work_id END AS work_id
FROM o JOIN roots ON node = ids[1] LEFT JOIN works ON works.cluster = roots.cluster
""")
def identity_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as observations of two identifiers each, a price and a customer's month; urgent ones' prices belong to a work already."""
    orders = table(spark, folder, "orders").withColumn("price", F.concat(F.lit("a:"), F.floor(F.col("o_totalprice") / 10).cast("string")))
    month = F.concat_ws("-", F.concat(F.lit("b:"), F.col("o_custkey").cast("string")), F.month("o_orderdate").cast("string"), "o_orderstatus")
    known = orders.where("o_orderpriority = '1-URGENT'").select(F.col("price").alias("identifier"), F.concat(F.lit("work:"), F.col("o_custkey").cast("string")).alias("work_id"))
    return clusters.observed_works(orders.select(F.col("o_orderkey").alias("observation_id"), F.array("price", month).alias("identifiers")), known)


@query("""
WITH RECURSIVE log AS (
  SELECT row_number() OVER (ORDER BY s_suppkey) AS n, s_suppkey AS seq, s_nationkey < 4 AS revokes, (s_suppkey // 4)::BIGINT AS alias,
    (floor(abs(s_acctbal))::BIGINT % 60)::BIGINT AS canonical, (s_nationkey // 9)::VARCHAR AS evidence FROM supplier
), works AS (SELECT 55 AS most),
f AS (
  SELECT 0::BIGINT AS n, NULL::BIGINT AS seq, MAP {}::MAP(BIGINT, STRUCT(t BIGINT, e VARCHAR)) AS live, []::BIGINT[][] AS gone, NULL::VARCHAR AS outcome, NULL::BIGINT AS root
  UNION ALL
  SELECT n, seq, CASE outcome WHEN 'merged' THEN map_concat(live, MAP {alias: {'t': root, 'e': evidence}}) WHEN 'revoked' THEN map_from_entries(list_filter(map_entries(live), lambda x: x.key <> alias)) ELSE live END,
    CASE outcome WHEN 'revoked' THEN list_append(gone, [alias, root]) ELSE gone END, outcome, root
  FROM (
    SELECT *, CASE WHEN is_missing THEN 'work_missing'
      WHEN revokes THEN CASE WHEN root IS NULL THEN 'alias_missing' WHEN list_contains(gone, [alias, root]) THEN 'alias_revocation_conflict' ELSE 'revoked' END
      WHEN live[alias].t IS NOT NULL THEN CASE WHEN live[alias].t = root AND live[alias].e = evidence THEN 'replayed' ELSE 'alias_conflict' END
      WHEN alias = root THEN 'alias_cycle' ELSE 'merged' END AS outcome
    FROM (
      SELECT log.*, live, gone, is_missing, CASE WHEN is_missing THEN NULL WHEN revokes THEN live[alias].t ELSE list_reduce(list_concat([canonical], range(40)), lambda c, i: coalesce(live[c].t, c)) END AS root
      FROM f JOIN log ON log.n = f.n + 1, LATERAL (SELECT alias > most AND alias NOT IN (SELECT l.alias FROM log l) OR NOT revokes AND canonical > most AND canonical NOT IN (SELECT l.alias FROM log l) AS is_missing FROM works)
    )
  )
)
SELECT seq, outcome, root FROM f WHERE n > 0
""")
def alias_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as a log of merges and revocations: four entries a work, into the works that their balances name."""
    suppliers = table(spark, folder, "supplier")
    log = suppliers.select(F.col("s_suppkey").alias("seq"), F.when(F.col("s_nationkey") < 4, "revoke").otherwise("merge").alias("action"), F.floor(F.col("s_suppkey") / 4).cast("long").alias("alias_id"), (F.floor(F.abs("s_acctbal")) % 60).cast("long").alias("canonical_id"), F.floor(F.col("s_nationkey") / 9).cast("string").alias("evidence"))
    works = log.select(F.col("alias_id").alias("work_id")).union(log.select("canonical_id").where("canonical_id <= 55"))
    return aliases.decided(log, works)

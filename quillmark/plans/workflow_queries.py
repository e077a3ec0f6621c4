"""Queries of identity, leases and scheduling over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import texts, timing
from quillmark.operators import identity, leases, planning
from quillmark.plans.registry import query
from quillmark.sources.tables import table


@query("""
WITH o AS (SELECT o_orderkey AS observation_id, 'doi:10.1/' || CAST(o_custkey AS VARCHAR) AS key, o_orderpriority AS fingerprint, o_orderdate FROM orders),
i AS (SELECT *, 'work:' || sha256('work-identity-v1' || chr(0) || key || chr(0)) AS work_id, 'manifestation:' || sha256('manifestation-identity-v1' || chr(0) || key || chr(0)) AS manifestation_id FROM o),
r AS (SELECT *, 'revision:' || sha256('revision-identity-v1' || chr(0) || manifestation_id || chr(0) || fingerprint || chr(0)) AS revision_id FROM i),
f AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY o_orderdate, observation_id) = 1 AS created_work, row_number() OVER (PARTITION BY revision_id ORDER BY o_orderdate, observation_id) = 1 AS created_revision FROM r)
SELECT observation_id, work_id, revision_id, created_work, created_revision, CASE WHEN created_work THEN 'new_work' WHEN created_revision THEN 'revision_available' END AS event_kind FROM f
""")
def identity_resolution(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("observation_id"), F.lit("doi").alias("namespace"), F.concat(F.lit("10.1/"), F.col("o_custkey").cast("string")).alias("value"), F.col("o_orderpriority").alias("fingerprint"), F.col("o_orderdate").alias("observed_at"))
    return identity.resolved(rows).select("observation_id", "work_id", "revision_id", "created_work", "created_revision", "event_kind")


@query("""
SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN a.p_partkey IS NULL THEN 'created' WHEN a.p_brand = b.p_brand THEN 'unchanged' ELSE 'preserved' END AS outcome
FROM (SELECT * FROM part WHERE p_partkey % 3 <> 0) a FULL JOIN (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'new' ELSE p_brand END AS p_brand FROM part WHERE p_partkey % 4 <> 0) b ON a.p_partkey = b.p_partkey
""")
def seed_import(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part")
    seeds = parts.where("p_partkey % 4 <> 0").withColumn("p_brand", F.when(F.col("p_partkey") % 5 == 0, "new").otherwise(F.col("p_brand")))
    return identity.seeded(parts.where("p_partkey % 3 <> 0"), seeds, "p_partkey", "p_brand")


@query("""
WITH c AS (SELECT o_custkey, o_orderkey AS candidate_id, (date_trunc('year', o_orderdate), o_orderpriority) AS f FROM orders), b AS (SELECT o_custkey, max(f) AS f FROM c GROUP BY 1)
SELECT o_custkey, min(candidate_id) AS candidate_id, count(*) > 1 AS tied FROM c JOIN b USING (o_custkey, f) GROUP BY 1
""")
def freshest_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select("o_custkey", F.col("o_orderkey").alias("candidate_id"), F.date_trunc("year", "o_orderdate").alias("a"), F.col("o_orderpriority").alias("b"))
    return identity.freshest(rows, "o_custkey", "a", "b")


@query("""
WITH RECURSIVE c AS (
  SELECT user_id AS job_id, event_id AS command_id, event_type IN ('view', 'click') AS claim, event_id % 3 AS owner, CAST(event_id % 2 + 1 AS BIGINT) AS token, epoch_us(ts) // 1000000 AS t,
    CASE WHEN event_type = 'purchase' AND event_id % 10 = 0 THEN 'succeeded' ELSE 'failed' END AS st, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_id) AS n
  FROM events
), f AS (
  SELECT job_id, 0::BIGINT AS n, NULL::BIGINT AS command_id, 'pending' AS state, -1::BIGINT AS o, 0::BIGINT AS tok, 0::BIGINT AS until_t, '' AS last, '' AS outcome FROM (SELECT DISTINCT job_id FROM c)
  UNION ALL
  SELECT c.job_id, c.n, c.command_id,
    CASE r WHEN 'claimed' THEN 'running' WHEN 'completed' THEN st ELSE state END, CASE r WHEN 'claimed' THEN c.owner ELSE o END, CASE r WHEN 'claimed' THEN tok + 1 ELSE tok END,
    CASE r WHEN 'claimed' THEN t + 86400 ELSE until_t END, CASE r WHEN 'claimed' THEN '' WHEN 'completed' THEN c.owner || ':' || token || ':' || st ELSE last END, r
  FROM (
    SELECT f.state, f.o, f.tok, f.until_t, f.last, c.*, CASE
      WHEN claim AND state = 'succeeded' THEN 'finished' WHEN claim AND state = 'running' AND until_t > t THEN 'busy' WHEN claim THEN 'claimed'
      WHEN state <> 'running' THEN CASE WHEN last = c.owner || ':' || token || ':' || st THEN 'replayed' ELSE 'fencing_mismatch' END
      WHEN o <> c.owner OR tok <> token THEN 'fencing_mismatch' WHEN until_t <= t THEN 'lease_expired' ELSE 'completed' END AS r
    FROM f JOIN c ON c.job_id = f.job_id AND c.n = f.n + 1
  ) c
)
SELECT job_id, command_id, outcome, tok AS fencing_token FROM f WHERE n > 0
""")
def lease_replay(spark: SparkSession, folder: str) -> DataFrame:
    return leases.replayed(lease_commands(table(spark, folder, "events")), 86_400)


def lease_commands(events: DataFrame) -> DataFrame:
    """Events as commands: each user is a job, views and clicks claim it, all others complete it."""
    k = F.col("event_id")
    state = F.when((F.col("event_type") == "purchase") & (k % 10 == 0), "succeeded").otherwise("failed")
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000)).cast("long")
    return events.select(F.col("user_id").alias("job_id"), k.alias("command_id"), F.when(F.col("event_type").isin("view", "click"), "claim").otherwise("complete").alias("kind"), (k % 3).cast("string").alias("owner"), (k % 2 + 1).alias("token"), at.alias("at"), state.alias("state"))


BINDINGS = """
WITH b AS (SELECT c_custkey AS binding, CASE c_custkey % 4 WHEN 0 THEN 'arxiv' WHEN 1 THEN 'pubmed' WHEN 2 THEN 'crossref' ELSE 'other' END AS source, max(CASE WHEN o_orderkey % 2 = 0 THEN date_trunc('day', o_orderdate) END) AS last_end
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
a AS (SELECT c_custkey AS binding, CASE c_custkey % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'awaiting_external' ELSE 'running' END AS state FROM customer WHERE c_custkey % 10 = 0),
e AS (SELECT *, CASE source WHEN 'pubmed' THEN TIMESTAMP '2001-06-01 00:00:00' WHEN 'arxiv' THEN TIMESTAMP '2001-06-01 10:20:00' ELSE TIMESTAMP '2001-06-01 10:20:30' END AS boundary FROM b LEFT JOIN a USING (binding)),
p AS (SELECT *, coalesce(last_end + INTERVAL 1 DAY, boundary) AS next_end FROM e),
o AS (SELECT *, CASE WHEN source = 'other' THEN 'unsupported' WHEN state = 'failed' THEN 'failed' WHEN state = 'awaiting_external' THEN 'awaiting' WHEN state IS NOT NULL THEN 'running' WHEN next_end <= boundary THEN 'harvest' ELSE 'wait' END AS outcome FROM p)
"""


@query(BINDINGS + """
SELECT binding, outcome, CASE WHEN outcome = 'harvest' THEN CAST(epoch_us(next_end) AS BIGINT) END AS until_us,
  CAST(CASE WHEN outcome = 'harvest' THEN row_number() OVER (PARTITION BY outcome ORDER BY last_end ASC NULLS FIRST, binding) END AS INTEGER) AS place FROM o
""")
def catchup_plan(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    source = F.get(F.array(*map(F.lit, ["arxiv", "pubmed", "crossref", "other"])), (k % 4).cast("int"))
    last = F.max(F.when(F.col("o_orderkey") % 2 == 0, F.date_trunc("day", F.col("o_orderdate").cast("timestamp"))))
    customers = table(spark, folder, "customer")
    bindings = customers.join(table(spark, folder, "orders"), F.col("o_custkey") == k, "left").groupBy(k.alias("binding"), source.alias("source")).agg(last.alias("last_end"))
    active = customers.where(k % 10 == 0).select(k.alias("binding"), F.get(F.array(*map(F.lit, ["failed", "awaiting_external", "running"])), (k % 3).cast("int")).alias("state"))
    out = planning.plan(bindings, active, F.to_timestamp(F.lit("2001-06-01 10:20:30")))
    return out.select("binding", "outcome", F.unix_micros("until_at").alias("until_us"), "place")


@query("""
WITH w AS (
  SELECT o_orderkey AS window_id, o_orderpriority AS stream, o_orderstatus = 'P' AND o_orderkey % 50 = 0 AS pending, o_orderdate AS until_at, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate + CAST(o_custkey % 20 AS INTEGER) * INTERVAL 1 DAY END AS finalised_at, o_custkey % 6 = 0 AS running FROM orders
), r AS (SELECT *, row_number() OVER (PARTITION BY stream, finalised_at IS NOT NULL ORDER BY until_at DESC, window_id) AS recent FROM w),
c AS (SELECT *, CASE WHEN pending THEN 'repair_pending' WHEN finalised_at IS NOT NULL AND recent <= 40 AND finalised_at <= TIMESTAMP '2001-08-01' THEN 'periodic_recent_window' END AS reason FROM r WHERE NOT running),
o AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY CASE WHEN reason = 'repair_pending' THEN 0 ELSE 1 END, until_at DESC, window_id) AS place FROM c WHERE reason IS NOT NULL)
SELECT stream, window_id, reason, CAST(place AS INTEGER) AS place FROM o WHERE place <= 50
""")
def repair_candidates(spark: SparkSession, folder: str) -> DataFrame:
    state = F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 50 == 0), "repair_pending").otherwise("traversed")
    finalised = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate") + F.make_dt_interval((F.col("o_custkey") % 20).cast("int")))
    windows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("window_id"), F.col("o_orderpriority").alias("stream"), state.alias("state"), F.col("o_orderdate").alias("until_at"), finalised.alias("finalised_at"), (F.col("o_custkey") % 6 == 0).alias("running"))
    return planning.repairs(windows, 40, F.expr("TIMESTAMP_NTZ '2001-08-01'"), 50)


@query("""
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'invalid_retry_metadata' WHEN event_id % 5 = 0 THEN 'processing_failed' WHEN event_id % 3 = 0 THEN 'source_failed' WHEN event_id % 7 = 0 THEN 'retry_required'
  WHEN TIMESTAMP '2024-01-15' < ts + CASE WHEN event_id % 2 = 0 THEN INTERVAL 3600 SECONDS ELSE INTERVAL 0 SECONDS END THEN 'cooldown' END AS stop
FROM events
""")
def retry_cooldown(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("event_id")
    capture = F.when(k % 11 == 0, F.lit("{}")).otherwise(F.concat(F.lit('{"retryable":'), F.when(k % 3 == 0, "false").otherwise("true"), F.lit(',"failure_code":'), F.when(k % 5 == 0, "null").otherwise('"x"'), F.lit(',"retry_after_seconds":'), F.when(k % 2 == 0, "3600").otherwise("null"), F.lit("}")))
    stop = planning.retry_stop(capture, F.col("ts").cast("timestamp"), F.to_timestamp(F.lit("2024-01-15 00:00:00")), k % 7 != 0)
    return table(spark, folder, "events").select("event_id", stop.alias("stop"))


@query("""
WITH p AS (SELECT p_partkey, list_filter(['cs.SE', 'cs.LG'], lambda c: (p_partkey + length(c) + ascii(right(c, 1))) % 3 = 0) AS c, string_split(p_type, ' ') AS t, p_partkey % 2 = 0 AS inc, p_partkey % 5 = 0 AS exc FROM part),
q AS (SELECT *, list_sort(list_distinct(t)) AS ts FROM p)
SELECT p_partkey, '(' || CASE WHEN len(c) > 0 THEN '(' || array_to_string(list_transform(c, lambda x: 'cat:' || x), ' OR ') || ') OR ' ELSE '' END
  || '(' || array_to_string(list_transform(ts, lambda x: 'ti:"' || x || '" OR abs:"' || x || '"'), ' OR ') || '))'
  || CASE WHEN inc THEN ' AND (ti:"data" OR abs:"data")' ELSE '' END || CASE WHEN exc THEN ' ANDNOT (ti:"a" OR abs:"a" OR ti:"b" OR abs:"b")' ELSE '' END || ' AND submittedDate:[202401010000 TO 202401022359]' AS search,
  CAST(p_partkey % 3 AS BIGINT) AS n_pages
FROM q
""")
def source_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Search texts of a provider, and how many pages each takes."""
    k = F.col("p_partkey")
    categories = F.filter(F.array(F.lit("cs.SE"), F.lit("cs.LG")), lambda c: (k + F.length(c) + F.ascii(F.right(c, F.lit(1)))) % 3 == 0)
    pick = lambda test, xs: F.when(test, F.array(*map(F.lit, xs))).otherwise(F.array().cast("array<string>"))
    text = planning.search(categories, F.split("p_type", " "), pick(k % 2 == 0, ["data"]), pick(k % 5 == 0, ["b", "a", "b"]), F.to_timestamp(F.lit("2024-01-01 00:00:00")), F.to_timestamp(F.lit("2024-01-02 23:59:00")))
    queries = table(spark, folder, "part").select(k.alias("query_id"), text.alias("search"), F.lit(100).alias("page_size"), ((k % 3) * 100).alias("total"))
    pages = planning.page_requests(queries, 30_000).groupBy("query_id").agg(F.count_distinct("fingerprint").alias("n_pages"))
    return queries.join(pages, "query_id", "left").select(F.col("query_id").alias("p_partkey"), "search", F.coalesce("n_pages", F.lit(0).cast("long")).alias("n_pages"))


@query("""
WITH l AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ids FROM lineitem GROUP BY 1),
g AS (SELECT l_orderkey, ids, CASE l_orderkey % 4 WHEN 0 THEN ids WHEN 1 THEN ids[:len(ids) // 2] WHEN 2 THEN list_reverse(ids) ELSE [] END AS got FROM l)
SELECT l_orderkey AS page_id, CASE WHEN ids = got THEN 'succeeded' WHEN len(got) < len(ids) AND ids[:len(got)] = got THEN 'partial' ELSE 'mismatch' END AS state, CAST(len(got) AS INTEGER) AS n_received FROM g
""")
def receipt_completeness(spark: SparkSession, folder: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: x["l_partkey"])
    pages = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("page_id")).agg(ordered.alias("ids"))
    half = F.floor(F.size("ids") / 2).cast("int")
    got = F.when(F.col("page_id") % 4 == 0, F.col("ids")).when(F.col("page_id") % 4 == 1, F.slice("ids", F.lit(1), half)).when(F.col("page_id") % 4 == 2, F.reverse("ids")).otherwise(F.slice("ids", 1, 0))
    both = pages.select("page_id", got.alias("g"))
    cut = F.floor(F.size("g") / 3).cast("int")
    first, second = both.select("page_id", F.lit(2).alias("batch_no"), F.slice("g", cut + 1, F.size("g")).alias("ids")), both.select("page_id", F.lit(1).alias("batch_no"), F.slice("g", F.lit(1), cut).alias("ids"))
    return planning.batches_complete(pages, first.union(second))


@query("""
WITH e AS (SELECT event_id, ts, CASE event_id % 3 WHEN 0 THEN 'pubmed' WHEN 1 THEN 'arxiv' ELSE 'crossref' END AS source FROM events)
SELECT event_id, CAST(epoch_us(CASE source WHEN 'pubmed' THEN date_trunc('day', ts) WHEN 'arxiv' THEN date_trunc('minute', ts) ELSE ts END) AS BIGINT) AS end_us,
  CAST(epoch_us(CASE WHEN ts + INTERVAL 8 HOURS < date_trunc('day', ts + INTERVAL 8 HOURS) + INTERVAL 570 MINUTES THEN date_trunc('day', ts + INTERVAL 8 HOURS) - INTERVAL 1 DAY ELSE date_trunc('day', ts + INTERVAL 8 HOURS) END + INTERVAL 570 MINUTES - INTERVAL 8 HOURS) AS BIGINT) AS cutoff_us
FROM e
""")
def schedule_cutoffs(spark: SparkSession, folder: str) -> DataFrame:
    source = F.get(F.array(F.lit("pubmed"), F.lit("arxiv"), F.lit("crossref")), (F.col("event_id") % 3).cast("int"))
    now = F.col("ts").cast("timestamp")
    cutoff = timing.local_cutoff(now, F.lit("Asia/Taipei"), F.lit(9), F.lit(30))
    return table(spark, folder, "events").select("event_id", F.unix_micros(timing.window_end(source, now)).alias("end_us"), F.unix_micros(cutoff).alias("cutoff_us"))


@query("""
WITH d AS (SELECT doc_id, CAST(doc_id % 90 AS VARCHAR) || CASE doc_id % 5 WHEN 0 THEN ' hours' WHEN 1 THEN 'kg' WHEN 2 THEN ' Meters' WHEN 3 THEN '%' ELSE ' widgets' END AS t FROM documents)
SELECT doc_id, regexp_extract(t, '^[0-9]+') AS number, CASE doc_id % 5 WHEN 0 THEN 'h' WHEN 1 THEN 'kg' WHEN 2 THEN 'm' WHEN 3 THEN '%' END AS unit FROM d WHERE doc_id % 5 < 4
""")
def unit_check(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("doc_id")
    text = F.concat((k % 90).cast("string"), F.get(F.array(*map(F.lit, [" hours", "kg", " Meters", "%", " widgets"])), (k % 5).cast("int")))
    return table(spark, folder, "documents").select("doc_id", F.explode(texts.measured(text)).alias("m")).select("doc_id", "m.number", "m.unit")

"""Queries of digests and events over the driver's tables: users are works, their events research events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators import digests, revisions
from quillmark.plans.registry import query
from quillmark.sources.tables import table

START, CUTOFF = "TIMESTAMP_NTZ '2024-01-20 00:00:00'", "TIMESTAMP_NTZ '2024-01-27 00:00:00'"
EVENTS = """
  SELECT event_id, user_id AS work_id, ts AS observed_at, 'work-' || CAST(user_id AS VARCHAR) AS title,
    CASE event_type WHEN 'purchase' THEN 'retraction' WHEN 'error' THEN 'correction' ELSE 'new_work' END AS event_kind
  FROM events
"""
DIGEST = """
WITH e AS (%s), inside AS (
  SELECT * FROM e WHERE observed_at > TIMESTAMP '2024-01-20' AND observed_at <= TIMESTAMP '2024-01-27' AND event_kind IN (%s)
), ranked AS (
  SELECT *, event_kind IN ('correction', 'retraction') AS is_notice,
    row_number() OVER (PARTITION BY work_id, event_kind IN ('correction', 'retraction') ORDER BY observed_at DESC, event_id DESC) AS n FROM inside
), fresh AS (
  SELECT * FROM ranked WHERE (n = 1 OR is_notice) AND event_id %% 11 <> 0
), works AS (SELECT DISTINCT work_id FROM e), said AS (
  SELECT work_id, 'd' || CAST(work_id %% 3 AS VARCHAR) AS domain_id FROM works UNION ALL SELECT work_id, 'd' || CAST(work_id %% 7 AS VARCHAR) FROM works
), relevant AS (
  SELECT work_id, string_agg(DISTINCT domain_id, ',' ORDER BY domain_id) AS domains, max(CASE WHEN work_id %% 4 = 0 THEN 20 ELSE 10 END) AS priority
  FROM said WHERE work_id %% 4 <> 3 GROUP BY work_id
), chosen AS (
  SELECT fresh.*, domains, priority, 'paper' AS item_kind FROM fresh JOIN relevant USING (work_id) WHERE NOT is_notice AND work_id %% 5 <> 0
  UNION ALL
  SELECT fresh.*, '' AS domains, 100 AS priority, 'notice' AS item_kind FROM fresh
  WHERE is_notice AND work_id IN (SELECT work_id FROM e WHERE event_id %% 11 = 0)
)
SELECT CAST(row_number() OVER (ORDER BY priority DESC, observed_at DESC, event_id) AS INTEGER) AS position, event_id, work_id, item_kind, event_kind,
  observed_at, CAST(priority AS INTEGER) AS priority, domains, title
FROM chosen
"""


def research_events(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "retraction").when(F.col("event_type") == "error", "correction").otherwise("new_work")
    title = F.concat(F.lit("work-"), F.col("user_id").cast("string"))
    return table(spark, folder, "events").select("event_id", F.col("user_id").alias("work_id"), F.col("ts").alias("observed_at"), title.alias("title"), kind.alias("event_kind"))


def _digest(spark: SparkSession, folder: str, kinds: tuple[str, ...]) -> DataFrame:
    events = research_events(spark, folder)
    works = events.select("work_id").distinct()
    decision = F.when(F.col("work_id") % 4 == 0, "direct").when(F.col("work_id") % 4 == 3, "irrelevant").otherwise("adjacent")
    domain = lambda n: works.select("work_id", F.concat(F.lit("d"), (F.col("work_id") % n).cast("string")).alias("domain_id"), decision.alias("decision"))
    notified = events.where("event_id % 11 = 0")
    inside = digests.in_period(events, F.expr(START), F.expr(CUTOFF), kinds)
    return digests.select(inside, notified, notified, works.where("work_id % 5 <> 0"), domain(3).union(domain(7)))


@query(DIGEST % (EVENTS, "'new_work'"))
def digest_selection(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(spark, folder, ("new_work",))


@query(DIGEST % (EVENTS, "'new_work', 'correction', 'retraction'"))
def digest_selection_notices(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(spark, folder, ("new_work", *digests.NOTICES))


@query(f"""
WITH e AS ({EVENTS}), u AS (
  SELECT o_custkey AS work_id, arg_min('https://example.org/' || CAST(o_orderkey AS VARCHAR), (o_orderdate, o_orderkey)) AS url
  FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY o_custkey
)
SELECT event_id, work_id, event_kind, coalesce(CASE WHEN work_id % 7 <> 0 THEN title END, 'untitled') AS title, coalesce(url, 'none') AS url
FROM e LEFT JOIN u USING (work_id)
WHERE observed_at > TIMESTAMP '2024-01-20' AND observed_at <= TIMESTAMP '2024-01-27' AND event_kind IN ('new_work', 'correction')
""")
def event_window_scan(spark: SparkSession, folder: str) -> DataFrame:
    events = digests.in_period(research_events(spark, folder), F.expr(START), F.expr(CUTOFF), ("new_work", "correction"))
    url = F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("https://example.org/"), F.col("o_orderkey").cast("string")))
    held = table(spark, folder, "orders").select(F.col("o_custkey").alias("work_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("id"), url.alias("url"))
    title = F.coalesce(F.when(F.col("work_id") % 7 != 0, F.col("title")), F.lit("untitled"))
    return events.join(digests.first_url(held), "work_id", "left").select("event_id", "work_id", "event_kind", title.alias("title"), F.coalesce("url", F.lit("none")).alias("url"))


@query(f"""
WITH e AS ({EVENTS}), r AS (
  SELECT *, event_kind IN ('correction', 'retraction') AS notice,
    row_number() OVER (PARTITION BY work_id, event_kind IN ('correction', 'retraction') ORDER BY observed_at DESC, event_id DESC) AS n FROM e
)
SELECT event_id, work_id, event_kind FROM r WHERE n = 1 OR notice
""")
def latest_event_per_work(spark: SparkSession, folder: str) -> DataFrame:
    return digests.latest_per_work(research_events(spark, folder)).select("event_id", "work_id", "event_kind")


@query(f"""
WITH e AS ({EVENTS}), said AS (
  SELECT work_id, 'd' || CAST(extract(hour FROM observed_at) // 6 AS VARCHAR) AS domain_id,
    CASE WHEN event_kind = 'retraction' THEN 2 WHEN event_kind = 'correction' THEN 1 END AS strength FROM e
)
SELECT work_id, domain_id, max(strength) AS strength FROM said WHERE strength IS NOT NULL GROUP BY 1, 2
""")
def strongest_decision(spark: SparkSession, folder: str) -> DataFrame:
    decision = F.when(F.col("event_kind") == "retraction", "direct").when(F.col("event_kind") == "correction", "adjacent").otherwise("irrelevant")
    domain = F.concat(F.lit("d"), F.expr("hour(observed_at) div 6").cast("string"))
    return digests.strongest_decisions(research_events(spark, folder).select("work_id", domain.alias("domain_id"), decision.alias("decision")))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_shipdate < o_orderdate THEN 'error' WHEN l_shipdate - o_orderdate > INTERVAL 14 DAYS THEN 'late_discovery'
  WHEN l_orderkey % 7 = 0 OR l_linenumber = 1 THEN 'new_work' ELSE 'revision_available' END AS kind
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")
def event_kind_classify(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    version = F.when(F.col("l_orderkey") % 7 != 0, F.col("l_linenumber"))
    return rows.select("l_orderkey", "l_linenumber", revisions.event_kind(F.col("o_orderdate"), F.col("l_shipdate"), version).alias("kind"))


@query("""
WITH page AS (SELECT event_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 101)
SELECT event_id, event_type, (SELECT count(*) FROM page) <= 100 AS complete FROM page ORDER BY event_id LIMIT 100
""")
def keyset_page(spark: SparkSession, folder: str) -> DataFrame:
    """A page of 100 behind a cursor, and whether nothing comes after it."""
    page = table(spark, folder, "events").where("event_id > 500").orderBy("event_id").limit(101).select("event_id", "event_type")
    return page.crossJoin(page.agg((F.count("*") <= 100).alias("complete"))).orderBy("event_id").limit(100)

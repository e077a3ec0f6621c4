"""Queries of revisions, traversals and access assessments over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators import revisions, traversal
from quillmark.plans.registry import query
from quillmark.sources.tables import table


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, sha256(o_orderstatus || o_orderpriority) AS content FROM orders),
f AS (SELECT o_custkey, content, min((o_orderdate, o_orderkey)) AS first FROM o GROUP BY 1, 2),
n AS (SELECT o_custkey, content, row_number() OVER (PARTITION BY o_custkey ORDER BY first) AS revision FROM f)
SELECT o_custkey, o_orderkey, content, CAST(revision AS INTEGER) AS revision FROM o JOIN n USING (o_custkey, content)
""")
def revision_numbering(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").withColumn("content", F.sha2(F.concat("o_orderstatus", "o_orderpriority"), 256))
    return revisions.numbered(rows, "o_custkey", "content", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "content", "revision")


@query("""
WITH o AS (
  SELECT *, row_number() OVER w = 1 AS is_first, lag(o_orderpriority) OVER w AS p, lag(o_orderstatus) OVER w AS s, lag(CAST(floor(o_totalprice / 50000) AS BIGINT)) OVER w AS c
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
), d AS (SELECT *, NOT is_first AND c IS DISTINCT FROM CAST(floor(o_totalprice / 50000) AS BIGINT) AS content_changed FROM o)
SELECT o_orderkey, is_first, content_changed, NOT is_first AND s IS DISTINCT FROM o_orderstatus AS status_changed,
  NOT is_first AND p IS DISTINCT FROM o_orderpriority AND NOT content_changed AS metadata_changed
FROM d
""")
def revision_change(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").withColumn("content", F.floor(F.col("o_totalprice") / 50000))
    out = revisions.changes(rows, "o_custkey", ["o_orderdate", "o_orderkey"], "content", "o_orderpriority", "o_orderstatus")
    return out.select("o_orderkey", "is_first", "content_changed", "status_changed", "metadata_changed")


@query("""
WITH probes AS (SELECT event_id AS probe_id, user_id, ts - INTERVAL 24 YEARS AS t FROM events),
f AS (
  SELECT probe_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS fact_id, max(o_orderdate) AS checked_at
  FROM probes JOIN orders ON o_custkey = user_id AND o_orderdate <= t GROUP BY probe_id
)
SELECT probe_id, user_id, fact_id,
  CASE WHEN fact_id IS NULL THEN 'missing' WHEN checked_at + INTERVAL 90 DAYS <= t THEN 'expired' ELSE 'current' END AS status
FROM probes LEFT JOIN f USING (probe_id)
""")
def asof_assessment(spark: SparkSession, folder: str) -> DataFrame:
    probes = table(spark, folder, "events").select(F.col("event_id").alias("probe_id"), "user_id", F.expr("ts - INTERVAL 24 YEARS").alias("at"))
    facts = table(spark, folder, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("checked_at"), F.expr("o_orderdate + INTERVAL 90 DAYS").alias("expires_at"))
    return revisions.as_of(probes, facts, "user_id")


ITEMS = """
  SELECT l_orderkey AS pass_id, l_linenumber AS page_no, l_suppkey AS ordinal, CASE WHEN l_partkey % 11 <> 0 THEN l_partkey % 50 END AS doi,
    l_returnflag <> 'R' AS decoded, 4 + CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END AS reported_total, l_linestatus = 'F' AS end_hint, l_partkey
  FROM lineitem
"""


@query(f"""
WITH items AS ({ITEMS}), q AS (SELECT DISTINCT pass_id, page_no, ordinal FROM items WHERE l_partkey % 17 = 0),
r AS (SELECT items.*, q.pass_id IS NOT NULL AS held FROM items LEFT JOIN q USING (pass_id, page_no, ordinal)),
a AS (
  SELECT pass_id, count(*) AS raw, count(*) FILTER (decoded AND NOT held) AS processed, count(*) FILTER (held) AS quarantined,
    count(DISTINCT doi) FILTER (decoded AND NOT held) AS unique_dois, count(DISTINCT reported_total) AS totals,
    arg_min(reported_total, (page_no, ordinal, reported_total)) AS first_total, bool_or(end_hint) AS ended
  FROM r GROUP BY pass_id
), d AS (SELECT *, totals > 1 OR (ended AND raw <> first_total) AS drift FROM a)
SELECT pass_id, raw, processed, quarantined, unique_dois, first_total, ended, processed - unique_dois AS duplicates, drift,
  CASE WHEN NOT ended THEN 'running' WHEN drift OR quarantined > 0 THEN 'repair_pending' ELSE 'traversed' END AS window_state,
  CASE WHEN ended AND NOT (drift OR quarantined > 0) THEN 'provisional' ELSE 'unknown' END AS completeness
FROM d
""")
def traversal_accounting(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("pass_id"),
        F.col("l_linenumber").alias("page_no"),
        F.col("l_suppkey").alias("ordinal"),
        F.when(F.col("l_partkey") % 11 != 0, F.col("l_partkey") % 50).alias("doi"),
        (F.col("l_returnflag") != "R").alias("decoded"),
        (4 + F.when(F.col("l_tax") > 0.07, 1).otherwise(0)).alias("reported_total"),
        (F.col("l_linestatus") == "F").alias("end_hint"),
        "l_partkey",
    )
    return traversal.accounting(items.drop("l_partkey"), items.where("l_partkey % 17 = 0"))


DAYS = """
  SELECT event_type AS stream, date_trunc('day', ts) AS from_at, date_trunc('day', ts) + INTERVAL 1 DAY AS until_at, count(*) % 6 <> 0 AS finalised
  FROM events GROUP BY 1, 2, 3 HAVING count(*) % 9 <> 0
"""


@query(f"""
WITH w AS ({DAYS}), b AS (
  SELECT *, NOT finalised OR coalesce(lag(until_at) OVER (PARTITION BY stream ORDER BY from_at) <> from_at, false) AS bad FROM w
), s AS (SELECT *, bool_or(bad) OVER (PARTITION BY stream ORDER BY from_at ROWS UNBOUNDED PRECEDING) AS stopped FROM b)
SELECT stream, CAST(epoch_us(max(until_at) FILTER (NOT stopped)) AS BIGINT) AS watermark_us, count(*) FILTER (NOT stopped) AS n_windows FROM s GROUP BY stream
""")
def contiguous_watermark(spark: SparkSession, folder: str) -> DataFrame:
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    days = table(spark, folder, "events").groupBy(F.col("event_type").alias("stream"), day.alias("from_at")).count().where("count % 9 <> 0")
    windows = days.select("stream", "from_at", F.expr("from_at + INTERVAL 1 DAY").alias("until_at"), (F.col("count") % 6 != 0).alias("finalised"))
    return traversal.watermarks(windows).select("stream", F.unix_micros("watermark").alias("watermark_us"), "n_windows")


@query("""
WITH d AS (SELECT DISTINCT CAST(epoch_us(date_trunc('day', ts)) // 86400000000 AS BIGINT) AS day FROM events),
w AS (
  SELECT day * 10 AS window_id, day * 48 AS from_at, day * 48 + 48 AS until_at FROM d
  UNION ALL SELECT day * 10 + 1, day * 48, day * 48 + 24 FROM d WHERE day % 3 = 0
  UNION ALL SELECT day * 10 + 2, day * 48 + 24, day * 48 + 48 - CASE WHEN day % 2 = 0 THEN 1 ELSE 0 END FROM d WHERE day % 3 = 0
)
SELECT window_id, from_at, until_at, CAST(NULL AS VARCHAR) AS reason FROM w WHERE NOT (window_id % 10 = 0 AND (window_id // 10) % 3 = 0)
UNION ALL SELECT day * 10, NULL, NULL, 'right_end' FROM d WHERE day % 6 = 0
""")
def window_split_leaves(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf windows, and after them the parents whose halves don't tile them."""
    day = (F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000).cast("long")
    days = table(spark, folder, "events").select(day.alias("day")).distinct()
    split = days.where("day % 3 = 0")
    window = lambda df, n, a, b: df.select((F.col("day") * 10 + n).alias("window_id"), (F.col("day") * 48 + a).alias("from_at"), (F.col("day") * 48 + b).alias("until_at"))
    windows = window(days, 0, 0, 48).union(window(split, 1, 0, 24)).union(window(split, 2, 24, 48 - F.when(F.col("day") % 2 == 0, 1).otherwise(0)))
    splits = split.select((F.col("day") * 10).alias("parent_id"), (F.col("day") * 10 + 1).alias("left_id"), (F.col("day") * 10 + 2).alias("right_id"))
    nothing = F.lit(None).cast("long")
    bad = traversal.split_violations(windows, splits).select(F.col("parent_id").alias("window_id"), nothing.alias("from_at"), nothing.alias("until_at"), "reason")
    return traversal.leaves(windows, splits).withColumn("reason", F.lit(None).cast("string")).union(bad)


@query("""
WITH r AS (
  SELECT user_id, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS ok FROM events
)
SELECT user_id, count(*) FILTER (ok = 0) AS n_failures FROM r GROUP BY user_id
""")
def trailing_failures(spark: SparkSession, folder: str) -> DataFrame:
    attempts = table(spark, folder, "events").withColumn("failed", F.col("event_type") == "error")
    return traversal.trailing_failures(attempts, "user_id", F.desc("ts"), F.desc("event_id"))


@query("""
WITH p AS (
  SELECT l_orderkey AS pass_id, l_linenumber AS page_no, l_partkey % 40 AS cursor_in, l_linestatus = 'F' AND l_tax > 0.06 AS end_hint,
    CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE lead(l_partkey % 40) OVER w END AS cursor_out
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)
), q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pass_id, page_no ORDER BY cursor_in, cursor_out NULLS FIRST, end_hint) AS n FROM p) WHERE n = 1),
s AS (
  SELECT *, coalesce(bool_or(end_hint) OVER (PARTITION BY pass_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended,
    row_number() OVER (PARTITION BY pass_id ORDER BY page_no) > 1 AND lag(cursor_out) OVER (PARTITION BY pass_id ORDER BY page_no) IS DISTINCT FROM cursor_in AS broken,
    row_number() OVER (PARTITION BY pass_id, cursor_in ORDER BY page_no) > 1 AS cycle
  FROM q
)
SELECT pass_id, page_no, CASE WHEN ended THEN 'after_end' WHEN broken THEN 'broken' WHEN cycle THEN 'cycle' ELSE 'ok' END AS status FROM s
""")
def cursor_traversal(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    pages = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("pass_id"),
        F.col("l_linenumber").alias("page_no"),
        (F.col("l_partkey") % 40).alias("cursor_in"),
        ((F.col("l_linestatus") == "F") & (F.col("l_tax") > 0.06)).alias("end_hint"),
        F.when(F.col("l_suppkey") % 5 != 0, F.lead(F.col("l_partkey") % 40).over(w)).alias("cursor_out"),
    )
    one = revisions.latest(pages, ["pass_id", "page_no"], F.col("cursor_in").asc(), F.col("cursor_out").asc_nulls_first(), F.col("end_hint").asc())
    return traversal.cursor_checks(one).select("pass_id", "page_no", "status")


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0.07 AND l_partkey % 20 <> l_suppkey % 20 THEN 'total_changed'
  WHEN l_partkey % 20 = 0 AND l_suppkey % 5 = 0 THEN 'verified_empty' WHEN l_linenumber + l_suppkey % 5 > l_partkey % 20 THEN 'too_many'
  WHEN l_suppkey % 5 < least(4, l_partkey % 20 - l_linenumber) THEN 'incomplete_page' WHEN l_linenumber + l_suppkey % 5 = l_partkey % 20 THEN 'last' ELSE 'next' END AS decision
FROM lineitem
""")
def offset_traversal(spark: SparkSession, folder: str) -> DataFrame:
    total, items = F.col("l_partkey") % 20, F.col("l_suppkey") % 5
    expected = F.when(F.col("l_tax") > 0.07, F.col("l_suppkey") % 20)
    decision = traversal.offset_decision(F.col("l_linenumber"), items, total, expected, F.lit(4))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", decision.alias("decision"))


@query("""
SELECT sha256(translate(regexp_replace(trim(text), '[ \\t\\n\\r]+', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS fingerprint,
  min(doc_id) AS doc_id, count(*) AS n_seen, count(DISTINCT source) > 1 AS conflict
FROM documents GROUP BY 1
""")
def content_fingerprint_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    folded = F.translate(F.regexp_replace(F.trim("text"), "[ \\t\\n\\r]+", " "), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = table(spark, folder, "documents").select(F.sha2(folded, 256).alias("fingerprint"), "doc_id", "source")
    return revisions.registered(rows, "fingerprint", ["source"], ["doc_id"]).select("fingerprint", "doc_id", "n_seen", "conflict")


@query("""
WITH o AS (SELECT *, row_number() OVER w AS n, lag(o_orderstatus) OVER w AS s, lag(o_orderpriority) OVER w AS p FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey, sum(CASE WHEN n = 1 OR s IS DISTINCT FROM o_orderstatus OR p IS DISTINCT FROM o_orderpriority THEN 1 ELSE 0 END)
  OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS policy_version
FROM o
""")
def subscription_policy(spark: SparkSession, folder: str) -> DataFrame:
    out = revisions.policy_versions(table(spark, folder, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderstatus", "o_orderpriority"])
    return out.select("o_orderkey", "policy_version")


TREE = """
WITH range_of AS (SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS lo, CAST(epoch_us(max(ts)) + 1 AS BIGINT) AS hi FROM events GROUP BY user_id),
n AS (
  SELECT user_id, k, (((CAST(epoch_us(ts) AS BIGINT) - lo) * (1 << k)) // (hi - lo))::BIGINT AS b, count(*) AS n FROM events JOIN range_of USING (user_id), range(8) t(k) GROUP BY ALL
), split AS (SELECT user_id, k, b FROM n WHERE n > 3 AND k < 7),
w AS (
  SELECT user_id, 0 AS k, 0 AS b FROM range_of
  UNION ALL SELECT s.user_id, s.k + 1, s.b * 2 + side FROM split s, range(2) t(side) WHERE EXISTS (SELECT 1 FROM n WHERE n.user_id = s.user_id AND n.k = s.k + 1 AND n.b = s.b * 2 + side)
)
"""


@query(TREE + """
, marked AS (
  SELECT user_id, k, b, EXISTS (SELECT 1 FROM split s WHERE s.user_id = w.user_id AND s.k = w.k AND s.b = w.b) AS splits,
    (SELECT count(*) FROM w c WHERE c.user_id = w.user_id AND c.k = w.k + 1 AND c.b // 2 = w.b) AS children FROM w
), broken AS (SELECT DISTINCT user_id FROM marked WHERE splits AND children < 2)
SELECT user_id * 1000 + (1 << k) + b AS window_id, user_id * 1000 + 1 AS root_id, k::INTEGER AS depth, NOT splits AS leaf,
  CASE WHEN splits AND children < 2 THEN 'window_missing' WHEN k = 0 AND user_id IN (SELECT user_id FROM broken) THEN 'leaves_do_not_tile' END AS reason
FROM marked
""")
def window_split_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's time, split in the middle while more than three events fall into a part, to seven levels; parts without events were never recorded."""
    events = table(spark, folder, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    spans = events.groupBy("user_id").agg(F.min("at").alias("lo"), (F.max("at") + 1).alias("hi"))
    each = events.join(spans, "user_id").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    n = each.groupBy("user_id", "lo", "hi", "k", F.expr("((at - lo) * shiftleft(1L, k)) div (hi - lo)").alias("b")).count()
    node = lambda k, b: F.expr(f"user_id * 1000 + shiftleft(1L, {k}) + {b}")
    split = n.where("count > 3 and k < 7")
    splits = split.select(node("k", "b").alias("parent_id"), node("k + 1", "b * 2").alias("left_id"), node("k + 1", "b * 2 + 1").alias("right_id"))
    parts = split.select("user_id", (F.col("k") + 1).alias("k"), F.explode(F.array(F.col("b") * 2, F.col("b") * 2 + 1)).alias("b"))
    there = n.join(parts.union(spans.select("user_id", F.lit(0), F.lit(0).cast("long"))), ["user_id", "k", "b"], "left_semi")
    edge = lambda b: F.expr(f"lo + ((hi - lo) * ({b})) div shiftleft(1L, k)")
    windows = there.select(node("k", "b").alias("window_id"), edge("b").alias("from_at"), edge("b + 1").alias("until_at"))
    return traversal.split_tree(windows, splits)

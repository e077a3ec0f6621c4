"""Queries of ledgers, jobs and aliases over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators import aliases, checks, ledgers
from quillmark.operators.ranking import placed
from quillmark.plans.registry import query
from quillmark.sources.tables import table


def reservations(spark: SparkSession, folder: str, orders: DataFrame | None = None) -> DataFrame:
    state = F.when(F.col("o_orderkey") % 5 == 0, "released").when(F.col("o_orderstatus") == "F", "settled").when(F.col("o_orderstatus") == "O", "reserved").otherwise("unknown")
    amount = F.floor("o_totalprice").cast("long")
    return (table(spark, folder, "orders") if orders is None else orders).select(
        F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.when(F.col("o_custkey") % 2 == 0, "USD").otherwise("EUR").alias("currency"),
        "o_orderkey", "o_orderdate", state.alias("state"), amount.alias("reserved"), F.floor(F.col("o_totalprice") / 2).cast("long").alias("actual"),
    )


@query("""
SELECT strftime(o_orderdate, '%Y-%m') AS period, CASE WHEN o_custkey % 2 = 0 THEN 'USD' ELSE 'EUR' END AS currency,
  CAST(sum(CASE WHEN o_orderkey % 5 = 0 THEN 0 WHEN o_orderstatus = 'F' THEN floor(o_totalprice / 2) ELSE floor(o_totalprice) END) AS BIGINT) AS used
FROM orders GROUP BY 1, 2
""")
def budget_usage(spark: SparkSession, folder: str) -> DataFrame:
    return ledgers.budget_used(reservations(spark, folder))


@query("""
WITH RECURSIVE o AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS period, CASE WHEN o_custkey % 2 = 0 THEN 'USD' ELSE 'EUR' END AS currency, o_orderkey AS request_id,
    CAST(floor(o_totalprice) AS BIGINT) AS amount,
    row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m'), o_custkey % 2 ORDER BY o_orderdate, o_orderkey) AS n
  FROM orders
), fold AS (
  SELECT *, CASE WHEN amount <= 900000 THEN amount ELSE 0 END AS used, amount <= 900000 AS fits FROM o WHERE n = 1
  UNION ALL
  SELECT o.*, used + CASE WHEN used + o.amount <= 900000 THEN o.amount ELSE 0 END, used + o.amount <= 900000
  FROM fold JOIN o ON o.period = fold.period AND o.currency = fold.currency AND o.n = fold.n + 1
)
SELECT period, currency, request_id, CASE WHEN fits THEN 'reserved' ELSE 'blocked' END AS decision FROM fold
""")
def budget_admission(spark: SparkSession, folder: str) -> DataFrame:
    requests = reservations(spark, folder).select("period", "currency", F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").alias("at"), F.col("reserved").alias("amount"))
    return ledgers.admitted(requests, 900_000)


PAIRS = """CASE o_orderkey % 8 WHEN 0 THEN 'pending' WHEN 1 THEN 'sending' WHEN 2 THEN 'provider_accepted' WHEN 3 THEN 'unknown' WHEN 4 THEN 'failed' WHEN 5 THEN 'cancelled' ELSE 'pending' END"""


@query(f"""
WITH parents AS (SELECT o_orderkey, o_custkey, o_orderdate, {PAIRS} AS outbox FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100),
a AS (
  SELECT l_orderkey AS o_orderkey, count(*) AS n_attempts, arg_max(error, (l_linenumber, l_partkey, l_suppkey)) AS last_error
  FROM (SELECT *, CASE WHEN l_returnflag <> 'N' THEN l_returnflag ELSE 'none' END AS error FROM lineitem WHERE l_linestatus = 'O') GROUP BY 1
)
SELECT p.o_orderkey, coalesce(n_attempts, 0) AS n_attempts, last_error, c_name,
  CASE WHEN p.o_orderkey % 3 = 0 AND outbox IN ('pending', 'sending', 'failed') THEN outbox WHEN p.o_orderkey % 3 > 0 AND outbox = 'provider_accepted' THEN 'sent' ELSE 'corrupt' END AS status
FROM parents p LEFT JOIN a USING (o_orderkey) LEFT JOIN customer ON c_custkey = o_custkey AND c_mktsegment <> 'BUILDING'
""")
def delivery_history(spark: SparkSession, folder: str) -> DataFrame:
    """The last hundred deliveries with their attempts, the last error and the reader."""
    parents = table(spark, folder, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(100)
    digest = F.when(F.col("o_orderkey") % 3 == 0, "queued").otherwise("sent")
    parents = parents.select("o_orderkey", "o_custkey", F.expr(PAIRS).alias("outbox"), digest.alias("digest"))
    error = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).otherwise("none")
    attempts = table(spark, folder, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("attempt_no"), error.alias("error"))
    rows = ledgers.with_attempts(parents, attempts, "o_orderkey")
    reader = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    rows = rows.join(reader, (F.col("c_custkey") == F.col("o_custkey")) & (F.col("c_mktsegment") != "BUILDING"), "left")
    return rows.select("o_orderkey", "n_attempts", "last_error", "c_name", ledgers.paired(ledgers.DELIVERY_STATUS, F.col("outbox"), F.col("digest")).alias("status"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'provider_accepted' WHEN 1 THEN 'failed' WHEN 2 THEN 'failed' ELSE 'unknown' END AS attempt,
  CASE o_orderkey % 4 WHEN 0 THEN 'provider_accepted' WHEN 1 THEN 'pending' WHEN 2 THEN 'failed' ELSE 'unknown' END AS outbox,
  CASE o_orderkey % 4 WHEN 0 THEN 'sent' WHEN 3 THEN 'unknown' ELSE 'queued' END AS digest, CASE o_orderkey % 4 WHEN 0 THEN 'accepted' WHEN 3 THEN 'unknown' ELSE 'reserved' END AS ledger
FROM orders
""")
def dispatch_results(spark: SparkSession, folder: str) -> DataFrame:
    result = F.get(F.array(*map(F.lit, ["provider_accepted", "retryable", "rejected", "lost"])), (F.col("o_orderkey") % 4).cast("int"))
    return table(spark, folder, "orders").select("o_orderkey", ledgers.sent_states(result).alias("s")).select("o_orderkey", "s.*")


@query("""
SELECT o.o_orderkey, 'dispatch:' || CAST(o.o_orderkey AS VARCHAR) AS job_key, j.l_linenumber IS NULL AS pending
FROM orders o LEFT JOIN (SELECT DISTINCT 'dispatch:' || CAST(l_orderkey AS VARCHAR) AS job_key, 1 AS l_linenumber FROM lineitem WHERE l_linestatus = 'F' AND l_linenumber = 1) j
  ON j.job_key = 'dispatch:' || CAST(o.o_orderkey AS VARCHAR)
WHERE o.o_orderstatus = 'P'
""")
def pending_outbox(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries that no job, known by its key, has been made for."""
    key = lambda c: F.concat_ws(":", F.lit("dispatch"), F.col(c).cast("string"))
    jobs = table(spark, folder, "lineitem").where("l_linestatus = 'F' and l_linenumber = 1").select(key("l_orderkey").alias("job_key"), F.lit(True).alias("_made")).distinct()
    rows = table(spark, folder, "orders").where("o_orderstatus = 'P'").withColumn("job_key", key("o_orderkey"))
    return rows.join(jobs, "job_key", "left").select("o_orderkey", "job_key", F.col("_made").isNull().alias("pending"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def orphan_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Registered objects that no attempt refers to."""
    orders = table(spark, folder, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, folder, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_tax > 0.06)")
def unmatched_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items that aren't quarantined."""
    held = table(spark, folder, "lineitem").where("l_returnflag = 'R' and l_tax > 0.06").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, folder, "part").join(held, "p_partkey", "left_anti").select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_linestatus = 'F')")
def running_repairs(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "lineitem").where("l_returnflag = 'R' and l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, folder, "orders").join(runs, "o_orderkey", "left_semi").select("o_orderkey")


#: Customers are works; most whose key isn't a multiple of ten are aliases of a smaller one, and two point at each other.
FOREST = """SELECT c_custkey AS alias_id, CASE WHEN c_custkey = 11 THEN 12 WHEN c_custkey = 12 THEN 11 WHEN c_custkey % 10 = 9 THEN c_custkey // 10 ELSE c_custkey - 1 END AS canonical_id
  FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey > 1"""
CLOSURE = f"""
WITH RECURSIVE forest AS ({FOREST}), walk AS (
  SELECT alias_id, canonical_id AS spot, 1 AS hops FROM forest
  UNION ALL SELECT walk.alias_id, f.canonical_id, hops + 1 FROM walk JOIN forest f ON f.alias_id = walk.spot WHERE hops < 129
), ends AS (
  SELECT alias_id, spot AS canonical_id, hops, 'ok' AS status FROM walk WHERE spot NOT IN (SELECT alias_id FROM forest) AND hops <= 128
), closure AS (
  SELECT * FROM ends UNION ALL SELECT alias_id, NULL, NULL, 'cycle' FROM forest WHERE alias_id NOT IN (SELECT alias_id FROM ends)
)
"""


def forest(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    to = F.when(k == 11, 12).when(k == 12, 11).when(k % 10 == 9, F.expr("c_custkey div 10")).otherwise(k - 1)
    return table(spark, folder, "customer").where((k % 10 != 0) & (k > 1)).select(k.alias("alias_id"), to.alias("canonical_id"))


@query(f"{CLOSURE} SELECT alias_id, canonical_id, CAST(hops AS INTEGER) AS hops, status FROM closure")
def alias_closure(spark: SparkSession, folder: str) -> DataFrame:
    return aliases.closure(forest(spark, folder))


FAMILIES = f"""{CLOSURE}, families AS (
  SELECT c_custkey AS work_id, CASE WHEN alias_id IS NULL THEN c_custkey ELSE canonical_id END AS canonical_id
  FROM customer LEFT JOIN closure ON alias_id = c_custkey WHERE alias_id IS NULL OR canonical_id IS NOT NULL
)"""


@query(f"{FAMILIES} SELECT canonical_id, count(*) AS n_works, min(work_id) AS least, max(work_id) AS greatest FROM families GROUP BY 1")
def alias_family(spark: SparkSession, folder: str) -> DataFrame:
    works = table(spark, folder, "customer").select(F.col("c_custkey").alias("work_id"))
    family = aliases.families(works, forest(spark, folder))
    return family.groupBy("canonical_id").agg(F.count("*").alias("n_works"), F.min("work_id").alias("least"), F.max("work_id").alias("greatest"))


@query(f"""{FAMILIES}, told AS (
  SELECT DISTINCT o_orderkey % 7 AS reader_id, canonical_id FROM orders JOIN families ON work_id = o_custkey WHERE o_orderstatus IN ('F', 'P')
)
SELECT reader_id, work_id FROM told JOIN families USING (canonical_id)""")
def prior_recipient(spark: SparkSession, folder: str) -> DataFrame:
    works = table(spark, folder, "customer").select(F.col("c_custkey").alias("work_id"))
    state = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "P", "unknown").otherwise("failed")
    ledger = table(spark, folder, "orders").select((F.col("o_orderkey") % 7).alias("reader_id"), F.col("o_custkey").alias("work_id"), state.alias("state"))
    return aliases.prior_recipients(works, forest(spark, folder), ledger)


@query("""
WITH l AS (
  SELECT o_custkey AS alias_id, arg_max((o_orderstatus, o_orderkey % 100), (o_orderdate, o_orderkey)) AS last FROM orders GROUP BY 1
)
SELECT alias_id, CAST(last[2] AS BIGINT) AS canonical_id FROM (SELECT alias_id, [last[1]::VARCHAR, last[2]::VARCHAR] AS last FROM l) WHERE last[1] <> 'F'
""")
def alias_log(spark: SparkSession, folder: str) -> DataFrame:
    """Aliases that hold after merges and revocations."""
    log = table(spark, folder, "orders").select(F.col("o_custkey").alias("alias_id"), (F.col("o_orderkey") % 100).alias("canonical_id"), F.when(F.col("o_orderstatus") == "F", "revoked").otherwise("merged").alias("action"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"))
    return aliases.current(log)


@query("""
SELECT o_orderkey AS job_key, CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS place FROM orders
WHERE o_orderdate <= TIMESTAMP '1998-01-01' AND (o_orderstatus <> 'O' OR o_orderdate + INTERVAL 30 DAYS <= TIMESTAMP '1998-01-01')
""")
def job_claim_order(spark: SparkSession, folder: str) -> DataFrame:
    jobs = table(spark, folder, "orders").select(F.col("o_orderkey").alias("job_key"), F.col("o_orderdate").alias("due_at"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("pending").alias("state"), F.expr("o_orderdate + INTERVAL 30 DAYS").alias("lease_until"))
    due = ledgers.claimable(jobs, F.expr("TIMESTAMP_NTZ '1998-01-01'"))
    return placed(due, "place", [(F.date_trunc("day", "due_at"), False)], F.asc("due_at"), F.asc("job_key")).select("job_key", "place")


@query("""
WITH b AS (SELECT user_id, max(ts) AS last_end FROM events WHERE event_type <> 'error' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1),
n AS (SELECT *, (epoch_us(TIMESTAMP '2024-01-30') - epoch_us(last_end)) // 86400000000 AS n FROM b)
SELECT user_id AS binding, CAST(k AS INTEGER) AS window_no, CAST(epoch_us(last_end) + k * 86400000000 AS BIGINT) AS from_us, CAST(epoch_us(last_end) + (k + 1) * 86400000000 AS BIGINT) AS until_us
FROM n, unnest(range(n)) AS t(k)
""")
def catchup_windows(spark: SparkSession, folder: str) -> DataFrame:
    last = table(spark, folder, "events").where("event_type <> 'error' and ts < TIMESTAMP_NTZ '2024-01-20'").groupBy(F.col("user_id").alias("binding")).agg(F.max(F.col("ts").cast("timestamp")).alias("last_end"))
    rows = ledgers.catchup_windows(last, F.to_timestamp(F.lit("2024-01-30 00:00:00")))
    return rows.select("binding", "window_no", F.unix_micros("from_at").alias("from_us"), F.unix_micros("until_at").alias("until_us"))


@query("""
WITH j AS (SELECT event_id, event_type = 'view' AS replayed FROM events)
SELECT event_id, CASE WHEN replayed THEN 'replayed' WHEN sum(CASE WHEN replayed THEN 0 ELSE 1 END) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) <= 50 THEN 'enqueued' ELSE 'deferred' END AS decision FROM j
""")
def tick_budget(spark: SparkSession, folder: str) -> DataFrame:
    jobs = table(spark, folder, "events").select("event_id", (F.col("event_type") == "view").alias("replayed"), F.col("event_id").alias("place"))
    return ledgers.tick(jobs, 50).select("event_id", "decision")


@query("""
SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'rejected' WHEN bool_or(l_returnflag = 'A') THEN 'pending' ELSE 'passed' END AS verdict FROM lineitem GROUP BY 1
""")
def qa_verdict(spark: SparkSession, folder: str) -> DataFrame:
    finding = F.when(F.col("l_returnflag") == "R", "unsupported").when(F.col("l_returnflag") == "A", "uncertain").otherwise("supported")
    return ledgers.verdict(table(spark, folder, "lineitem").select("l_orderkey", finding.alias("finding")), "l_orderkey")


@query("""
SELECT 'order_customer' AS rule, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS n
UNION ALL SELECT 'line_order', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
UNION ALL SELECT 'line_key', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))
UNION ALL SELECT 'ship_after_order', (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate)
UNION ALL SELECT 'known_status', (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O'))
""")
def constraint_violations(spark: SparkSession, folder: str) -> DataFrame:
    orders, lines, customers = (table(spark, folder, n) for n in ("orders", "lineitem", "customer"))
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    out = checks.dangling(orders, customers, "order_customer", "o_custkey", "c_custkey")
    out = out.union(checks.dangling(lines, orders, "line_order", "l_orderkey", "o_orderkey")).union(checks.duplicate_keys(lines, "line_key", "l_orderkey", "l_linenumber"))
    return out.union(checks.broken(both, "ship_after_order", F.col("l_shipdate") >= F.col("o_orderdate"))).union(checks.broken(orders, "known_status", F.col("o_orderstatus").isin("F", "O")))

"""Queries of captures, claims, configuration and artifacts over the driver's tables."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from quillmark.operators import captures, evidence, ranking, registers
from quillmark.plans.registry import query
from quillmark.sources import configuration
from quillmark.sources.tables import table


@query("""
WITH c AS (
  SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS claim_id, l_orderkey AS page_id, CASE WHEN l_tax < 0.07 THEN 1 ELSE 2 END AS pass_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) + CASE WHEN l_partkey % 29 = 0 THEN 1 ELSE 0 END AS token,
    CASE WHEN l_partkey % 4 = 0 THEN 'dispatching' WHEN l_partkey % 4 = 1 THEN 'reserved' ELSE 'released' END AS state, CAST(l_linenumber * 100 AS BIGINT) AS reserved_us,
    CASE WHEN l_partkey % 4 = 0 THEN CAST(l_linenumber * 100 + l_suppkey % 60 AS BIGINT) END AS dispatched_us, CASE WHEN l_partkey % 4 > 1 THEN CAST(l_linenumber * 100 + l_suppkey % 9 - 1 AS BIGINT) END AS ended_us, CAST(l_linenumber * 100 + 50 AS BIGINT) AS lease_us
  FROM lineitem
), r AS (SELECT claim_id, CASE WHEN claim_id % 3 > 0 THEN token * 110 END AS not_before_us FROM c WHERE claim_id % 3 > 0),
j AS (
  SELECT c.*, not_before_us, lag(state) OVER w AS s, lag(token) OVER w AS t, lag(pass_id) OVER w AS p, lag(not_before_us) OVER w AS nb, row_number() OVER w > 1 AS second,
    count(*) FILTER (state IN ('reserved', 'dispatching') AND not_before_us IS NULL) OVER (PARTITION BY page_id) AS n_open
  FROM c LEFT JOIN r USING (claim_id) WINDOW w AS (PARTITION BY page_id ORDER BY token, claim_id)
), v AS (
  SELECT claim_id, CASE
    WHEN NOT coalesce(CASE state WHEN 'reserved' THEN dispatched_us IS NULL AND ended_us IS NULL WHEN 'dispatching' THEN dispatched_us >= reserved_us AND dispatched_us < lease_us AND ended_us IS NULL
      ELSE dispatched_us IS NULL AND ended_us >= reserved_us END, false) THEN 'state'
    WHEN second AND token <> t + 1 THEN 'token' WHEN second AND s = 'dispatching' AND nb IS NOT NULL AND reserved_us < nb THEN 'early'
    WHEN second AND s <> 'released' AND NOT coalesce(s = 'dispatching' AND nb IS NOT NULL AND p = pass_id, false) THEN 'unresolved'
    WHEN n_open > 1 AND state IN ('reserved', 'dispatching') AND not_before_us IS NULL THEN 'open_twice' END AS reason FROM j
)
SELECT claim_id, reason FROM v WHERE reason IS NOT NULL
""")
def capture_claims(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    line, part = F.col("l_linenumber").cast("long"), F.col("l_partkey")
    token = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) + F.when(part % 29 == 0, 1).otherwise(0)
    lines = ranking.placed(table(spark, folder, "lineitem"), "number", [(F.floor(F.col("l_orderkey") / 1000), False)], F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"))
    claims = lines.select(
        F.col("number").cast("long").alias("claim_id"), F.col("l_orderkey").alias("page_id"), F.when(F.col("l_tax") < 0.07, 1).otherwise(2).alias("pass_id"), token.alias("token"),
        F.when(part % 4 == 0, "dispatching").when(part % 4 == 1, "reserved").otherwise("released").alias("state"), (line * 100).alias("reserved_us"),
        F.when(part % 4 == 0, line * 100 + F.col("l_suppkey") % 60).alias("dispatched_us"), F.when(part % 4 > 1, line * 100 + F.col("l_suppkey") % 9 - 1).alias("ended_us"), (line * 100 + 50).alias("lease_us"),
    )
    resolutions = claims.where("claim_id % 3 > 0").select("claim_id", F.lit("retry").alias("action"), (F.col("token") * 110).alias("not_before_us"))
    return captures.claim_violations(claims, resolutions)


@F.pandas_udf(BinaryType())
def _packed(texts: pd.Series) -> pd.Series:
    return pd.Series([gzip.compress(t.encode(), 1) for t in texts], dtype=object)


@query("SELECT doc_id, CASE WHEN strlen(text) <= 20000 AND doc_id % 10 <> 0 THEN sha256(text) END AS body_sha256 FROM documents")
def capture_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Hashes of gzip bodies, decoded within a bound; every tenth is broken off."""
    body = _packed(F.col("text"))
    rows = table(spark, folder, "documents").select("doc_id", body.alias("_b"))
    cut = F.when(F.col("doc_id") % 10 == 0, F.expr("substring(_b, 1, length(_b) - 3)")).otherwise(F.col("_b"))
    return rows.select("doc_id", F.sha2(captures.entity("gzip", 20_000)(cut), 256).alias("body_sha256"))


@query("""
SELECT o_orderkey, CAST(ceil(o_custkey * CAST(0.15 AS DECIMAL(18, 6)) + 4000 * CAST(0.6 AS DECIMAL(18, 6))) AS BIGINT) * (2 + o_orderkey % 4) AS micros,
  CASE WHEN o_orderkey % 7 = 1 THEN 'sending' WHEN o_orderkey % 7 = 2 THEN 'provider_accepted' WHEN o_orderkey % 9 = 0 THEN 'corrupt' WHEN o_orderkey % 11 = 0 THEN 'snapshot_changed'
    WHEN o_orderkey % 5 = 0 OR o_orderkey % 13 = 0 THEN 'cancelled' WHEN o_orderkey % 3 = 0 THEN 'effects_disabled' ELSE 'claimed' END AS claim
FROM orders
""")
def dispatch_claims(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    outbox = F.when(k % 7 == 1, "sending").when(k % 7 == 2, "provider_accepted").otherwise("pending")
    claim = captures.dispatch_claim(outbox, F.when(k % 9 == 0, "sent").otherwise("queued"), k % 11 == 0, k % 5 != 0, k % 13 != 0, k % 3 != 0, F.lit(True))
    micros = captures.reservation(F.col("o_custkey"), F.lit("0.15"), F.lit(4000), F.lit("0.6"), k % 4)
    return table(spark, folder, "orders").select("o_orderkey", micros.alias("micros"), claim.alias("claim"))


@query("""
SELECT l_orderkey, arg_min(l_partkey, (CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END, -l_partkey)) AS attempt_no FROM lineitem GROUP BY 1
""")
def preferred_attempt(spark: SparkSession, folder: str) -> DataFrame:
    state = F.when(F.col("l_returnflag") == "A", "captured").when(F.col("l_returnflag") == "R", "failed").otherwise("running")
    return captures.preferred(table(spark, folder, "lineitem").select("l_orderkey", F.col("l_partkey").alias("attempt_no"), state.alias("state")), "l_orderkey")


@query("""
WITH p AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ids FROM lineitem GROUP BY 1)
SELECT l_orderkey, ids[l_orderkey % 4 + 1:l_orderkey % 4 + 2] AS next_ids FROM p
""")
def next_batches(spark: SparkSession, folder: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: x["l_partkey"])
    pages = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(ordered.alias("ids"))
    return pages.select("l_orderkey", captures.next_batch(F.col("ids"), F.col("l_orderkey") % 4, 2).alias("next_ids"))


@query("""
WITH w AS (SELECT o_orderkey AS window_id, o_orderdate AS d, o_orderstatus = 'F' AND o_orderkey % 2 = 0 AND o_custkey % 5 <> 0 AND o_totalprice < 200000 AND o_orderkey % 3 <> 2 AS final FROM orders),
f AS (SELECT window_id, 'finalise' AS action, 0 AS k, row_number() OVER (ORDER BY d, window_id) AS place FROM w WHERE final
  UNION ALL SELECT window_id, 'repair', 1, row_number() OVER (ORDER BY d DESC, window_id) FROM w WHERE NOT final)
SELECT window_id, action FROM f ORDER BY k, place, window_id LIMIT 5000
""")
def maintenance_tick(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    passes = table(spark, folder, "orders").select(
        k.alias("window_id"), F.col("o_orderdate").alias("d"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("state"), (k % 2 == 0).alias("traversal_complete"), (F.col("o_custkey") % 5 != 0).alias("accounting_complete"),
        (F.col("o_totalprice") >= 200_000).alias("repair_pending"), F.lit(False).alias("drift"), F.when(k % 3 == 2, 1).otherwise(0).alias("parse_gaps"), F.lit("provisional").alias("completeness"),
    )
    passes = passes.withColumn("final", captures.finalisable(passes))
    at = F.unix_micros(F.col("d").cast("timestamp"))
    return captures.maintenance(passes.where("final").select("window_id", at.alias("place")), passes.where("not final").select("window_id", (-at).alias("place")), 5000)


@query("""
WITH d AS (SELECT doc_id, doc_id % 6 AS m, CAST(doc_id AS VARCHAR) AS s FROM documents),
c AS (
  SELECT doc_id AS run_id, 0 AS place, CASE WHEN m = 2 THEN 'guess' ELSE 'method' END AS kind, CASE m WHEN 3 THEN ['a1', 'a1'] WHEN 4 THEN ['a1', 'zz'] ELSE ['a1', 'a' || s] END AS ids, m FROM d WHERE m NOT IN (0, 1)
  UNION ALL SELECT doc_id, 1, CASE WHEN m = 5 THEN 'method' ELSE 'result' END, CASE WHEN m = 5 THEN ['a1', 'a' || s] ELSE ['a' || s] END, m FROM d WHERE m NOT IN (0, 1)
), p AS (SELECT *, list_sort(ids) AS anchor_ids FROM c),
h AS (SELECT *, 'claim:' || sha256('{"anchor_ids":[' || array_to_string(list_transform(anchor_ids, lambda x: '"' || x || '"'), ',') || '],"claim_type":"' || kind || '","input_fingerprint":"f"}') AS claim_id FROM p)
SELECT run_id, place, claim_id, kind, anchor_ids, CASE WHEN kind = 'guess' THEN 'unknown_kind' WHEN len(list_distinct(anchor_ids)) < len(anchor_ids) THEN 'anchor_repeated' WHEN list_contains(anchor_ids, 'zz') THEN 'anchor_unknown'
  WHEN row_number() OVER (PARTITION BY run_id, claim_id ORDER BY place) > 1 THEN 'repeated' END AS error FROM h
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, CASE m WHEN 0 THEN 'snapshot_mismatch' ELSE 'input_mismatch' END FROM d WHERE m IN (0, 1)
""")
def claim_parse(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    s, m = F.col("doc_id").cast("string"), F.col("doc_id") % 6
    quoted = lambda *xs: F.concat(F.lit('["'), F.concat_ws('","', *xs), F.lit('"]'))
    own = F.concat(F.lit("a"), s)
    ids = F.when(m == 3, F.lit('["a1","a1"]')).when(m == 4, F.lit('["a1","zz"]')).otherwise(quoted(own, F.lit("a1")))
    first = F.concat(F.lit('{"claim_type":"'), F.when(m == 2, "guess").otherwise("method"), F.lit('","anchor_ids":'), ids, F.lit("}"))
    second = F.concat(F.lit('{"claim_type":"'), F.when(m == 5, "method").otherwise("result"), F.lit('","anchor_ids":'), F.when(m == 5, quoted(F.lit("a1"), own)).otherwise(quoted(own)), F.lit("}"))
    body = F.concat(F.lit('{"snapshot_id":"'), F.when(m == 0, "x").otherwise(s), F.lit('","input_fingerprint":"'), F.when(m == 1, "g").otherwise("f"), F.lit('","claims":['), first, F.lit(","), second, F.lit("]}"))
    candidates = docs.select(F.col("doc_id").alias("run_id"), s.alias("snapshot_id"), F.lit("f").alias("input_fingerprint"), body.alias("content_json"))
    anchors = docs.select(s.alias("snapshot_id"), F.explode(F.array(F.lit("a1"), own)).alias("anchor_id"))
    return evidence.parsed_claims(candidates, anchors, ["method", "result"])


@query("""
SELECT p_partkey AS document_id, 'd' || CAST(k AS VARCHAR) AS id, CASE WHEN p_partkey % 5 = 0 AND k = 1 THEN NULL ELSE p_brand END AS name, list_sort(list_distinct(string_split(p_type, ' '))) AS aliases, ['arxiv', 'crossref'] AS sources,
  CASE WHEN p_partkey % 5 = 0 AND k = 1 THEN 'field_missing' WHEN p_partkey % 3 = 0 THEN 'duplicate_domain' END AS error
FROM part, unnest(CASE WHEN p_partkey % 3 = 0 THEN [1, 1] ELSE [1, 2] END) AS t(k) WHERE p_partkey % 7 > 0
UNION ALL SELECT p_partkey, NULL, NULL, [], [], 'invalid_document' FROM part WHERE p_partkey % 7 = 0
""")
def domain_import(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    aliases = F.concat(F.lit('["'), F.replace("p_type", F.lit(" "), F.lit('","')), F.lit('"]'))
    one = lambda id_, name: F.concat(F.lit(f'{{"id":"{id_}"'), name, F.lit(',"aliases":'), aliases, F.lit(',"sources":["crossref","arxiv","crossref"]}'))
    named = F.concat(F.lit(',"name":"'), F.col("p_brand"), F.lit('"'))
    second = F.when(k % 3 == 0, one("d1", F.when(k % 5 == 0, F.lit("")).otherwise(named))).otherwise(one("d2", named))
    body = F.when(k % 7 == 0, F.lit("[")).otherwise(F.concat(F.lit('{"domains":['), one("d1", F.when(k % 5 == 0, F.lit("")).otherwise(named)), F.lit(","), second, F.lit("]}")))
    out = configuration.domains(table(spark, folder, "part").select(k.alias("document_id"), body.alias("json")))
    return out.select("document_id", "id", "name", "aliases", "sources", "error")


@query("""
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS version, CASE WHEN event_id % 3 < 2 THEN event_type END AS title, CASE WHEN event_id % 3 = 1 THEN 20 END AS priority FROM events
""")
def digest_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of one item, written in both versions and read back; a third version is unknown."""
    k = F.col("event_id")
    items = F.array(F.struct(k.alias("event_id"), F.col("event_type").alias("title"), F.lit(20).alias("priority")))
    old = F.concat(F.lit('{"version":'), F.when(k % 3 == 0, "1").otherwise("3"), F.lit(',"items":[{"event_id":'), k.cast("string"), F.lit(',"title":"'), F.col("event_type"), F.lit('"}]}'))
    body = F.when(k % 3 == 1, configuration.artifact(items, F.array(F.lit("note")))).otherwise(old)
    read = table(spark, folder, "events").select("event_id", configuration.read_artifact(body).alias("a"))
    return read.select("event_id", "a.version", F.get("a.items", F.lit(0))["title"].alias("title"), F.get("a.items", F.lit(0))["priority"].alias("priority"))


RECEIPTS = """
WITH r AS (
  SELECT *, '{"attempt_key":"p' || l_orderkey || '","body_object_id":"raw:' || sha256(l_partkey::VARCHAR) || '","body_sha256":"' || sha256(l_partkey::VARCHAR) || '","body_size":' || l_suppkey || ',"complete":true,"request":{"request_fingerprint":"' ||
    sha256((CASE WHEN l_quantity < 5 THEN 1 ELSE 0 END + l_orderkey)::VARCHAR) || '"},"schema_version":' || CASE WHEN l_tax >= 0.08 THEN 2 ELSE 1 END || '}' AS content
  FROM lineitem WHERE l_returnflag <> 'R'
), o AS (SELECT DISTINCT l_orderkey, l_quantity, l_tax, 'raw:' || sha256(content) AS object_id, content FROM r),
free AS (SELECT * FROM o WHERE object_id NOT IN (SELECT object_id FROM o WHERE l_quantity > 30)),
f AS (SELECT l_orderkey, count(DISTINCT object_id) AS n, min(object_id) AS object_id, arg_min(l_tax >= 0.08, object_id) AS unsound, arg_min(l_quantity < 5, object_id) AS other FROM free GROUP BY 1)
"""


@query(RECEIPTS + """
SELECT 'p' || o_orderkey AS page_id, CASE WHEN o_orderstatus <> 'O' THEN 'crossref_orphan_page_not_active' WHEN n IS NULL THEN 'none' WHEN n > 1 THEN 'crossref_orphan_receipt_ambiguous'
  WHEN unsound THEN 'crossref_orphan_receipt_invalid' WHEN other THEN 'crossref_orphan_request_mismatch' ELSE 'attached' END AS outcome,
  CASE WHEN o_orderstatus = 'O' AND n = 1 AND NOT unsound AND NOT other THEN object_id END AS receipt_id
FROM orders LEFT JOIN f ON l_orderkey = o_orderkey
""")
def orphan_receipts(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as pages and their items as receipts that were stored; those of more than 30 pieces were noted."""
    text = lambda c: F.col(c).cast("string")
    say = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    body = F.sha2(text("l_partkey"), 256)
    fingerprint = F.sha2((F.when(F.col("l_quantity") < 5, 1).otherwise(0) + F.col("l_orderkey")).cast("string"), 256)
    content = say('{"attempt_key":"p', text("l_orderkey"), '","body_object_id":"raw:', body, '","body_sha256":"', body, '","body_size":', text("l_suppkey"), ',"complete":true,"request":{"request_fingerprint":"', fingerprint, '"},"schema_version":', F.when(F.col("l_tax") >= 0.08, "2").otherwise("1"), "}")
    stored = table(spark, folder, "lineitem").where("l_returnflag <> 'R'").select(content.alias("content"), "l_quantity").withColumn("sha256", F.sha2("content", 256)).withColumn("object_id", F.concat(F.lit("raw:"), F.col("sha256")))
    objects = stored.select("object_id", "sha256", F.octet_length("content").cast("long").alias("size"), F.lit("available").alias("state"), "content")
    attempts = stored.where("l_quantity > 30").select(F.col("object_id").alias("receipt_id"))
    pages = table(spark, folder, "orders").select(F.concat(F.lit("p"), text("o_orderkey")).alias("page_id"), F.sha2(text("o_orderkey"), 256).alias("fingerprint"), (F.col("o_orderstatus") == "O").alias("active"))
    return captures.orphan_receipts(pages, objects, attempts)


@query("""
WITH p AS (SELECT o_custkey // 2 AS id, o_orderpriority || '|' || o_orderstatus || '|' || floor(o_totalprice / 20000)::BIGINT AS said, min(o_orderkey) AS first_seq, count(*) AS n FROM orders GROUP BY 1, 2),
w AS (SELECT *, min(first_seq) OVER (PARTITION BY id) AS id_seq, min(first_seq) OVER (PARTITION BY said) AS said_seq FROM p)
SELECT id, first_seq, n, CASE WHEN id_seq < first_seq THEN 'payload_conflict' WHEN said_seq < first_seq THEN 'id_conflict' ELSE 'kept' END AS outcome, CASE WHEN id_seq < first_seq THEN id_seq WHEN said_seq < first_seq THEN said_seq END AS against FROM w
""")
def record_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as records of pairs of customers: what their content breaks of one payload for an id, one id for a payload."""
    rows = table(spark, folder, "orders").select(F.floor(F.col("o_custkey") / 2).cast("long").alias("id"), "o_orderpriority", "o_orderstatus", F.floor(F.col("o_totalprice") / 20_000).alias("price"), "o_orderkey")
    return registers.content_register(rows, "id", ["o_orderpriority", "o_orderstatus", "price"], "o_orderkey").drop("sha256")

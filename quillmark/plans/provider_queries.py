"""Queries of provider pages, items and answers over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions import rates, texts, timing, values
from quillmark.operators import evidence, ledgers, planning, providers, revisions, traversal
from quillmark.plans.registry import query
from quillmark.sources import feeds
from quillmark.sources.tables import table


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as pages of up to two items, in ways that go wrong by their key."""
    k, n = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 13
    first = F.concat(F.lit('{"DOI":"10.1000/'), k, F.lit('","title":["A  b"]}'))
    second = F.when(n == 9, '{"DOI":5}').when(n == 10, '"text"').otherwise(F.concat(F.lit('{"type":"x","DOI":"10.1000/b'), k, F.lit('"}')))
    items = F.when(n == 8, F.concat(F.lit("["), first, F.lit("]"))).when(n == 7, '"none"').otherwise(F.concat(F.lit("["), first, F.lit(","), second, F.lit("]")))
    after = F.when(n == 4, "").when(n == 5, '"next-cursor":"c0",').when(n == 6, '"next-cursor":"*",').otherwise(F.concat(F.lit('"next-cursor":"c'), k, F.lit('",')))
    total = F.when(n == 3, '"total-results":-1,').when(n == 11, "").otherwise('"total-results":900,')
    status = F.when(n == 12, "failed").otherwise("ok")
    body = F.concat(F.lit('{"status":"'), status, F.lit('","message-type":"work-list","message":{'), after, total, F.lit('"items":'), items, F.when(n == 2, "}").otherwise("}}"))
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("page_id"), body.alias("body"), F.lit("c0").alias("cursor"), F.lit(2).alias("rows"), F.when(n == 1, 503).otherwise(200).alias("status"))
    return rows.withColumn("sha256", F.sha2(F.when(F.col("page_id") % 13 == 0, F.lit("x")).otherwise(F.col("body")), 256))


PAGES = """
WITH p AS (SELECT o_orderkey AS page_id, o_orderkey % 13 AS n, CAST(o_orderkey AS VARCHAR) AS k FROM orders),
d AS (
  SELECT *, CASE n WHEN 0 THEN 'crossref_response_hash_mismatch' WHEN 1 THEN 'crossref_http_not_successful' WHEN 2 THEN 'invalid_crossref_json' WHEN 3 THEN 'invalid_crossref_envelope'
    WHEN 4 THEN 'crossref_next_cursor_missing' WHEN 5 THEN 'crossref_cursor_no_progress' WHEN 6 THEN 'crossref_cursor_no_progress' WHEN 7 THEN 'invalid_crossref_envelope' WHEN 12 THEN 'invalid_crossref_envelope' END AS error FROM p
)
"""


@query(PAGES + """
SELECT page_id, error, CASE WHEN error IS NULL THEN 'c' || k END AS next_cursor, CASE WHEN error IS NULL AND n <> 11 THEN CAST(900 AS BIGINT) END AS total,
  CASE WHEN error IS NULL THEN n = 8 END AS end_hint, CASE WHEN error IS NULL THEN CASE WHEN n = 8 THEN 1 ELSE 2 END END AS n_items FROM d
""")
def crossref_decode(spark: SparkSession, folder: str) -> DataFrame:
    return providers.decoded_pages(pages(spark, folder)).withColumn("n_items", F.when(F.col("items").isNotNull(), F.size("items"))).drop("items")


@query(PAGES + """
, i AS (
  SELECT page_id, 0 AS ordinal, '10.1000/' || k AS raw_doi, '{"DOI":"10.1000/' || k || '","title":["A  b"]}' AS json FROM d WHERE error IS NULL
  UNION ALL SELECT page_id, 1, CASE WHEN n NOT IN (9, 10) THEN '10.1000/b' || k END, CASE n WHEN 9 THEN '{"DOI":5}' WHEN 10 THEN '"text"' ELSE '{"DOI":"10.1000/b' || k || '","type":"x"}' END FROM d WHERE error IS NULL AND n <> 8
)
SELECT page_id, ordinal, CASE WHEN raw_doi IS NULL THEN 'quarantined' ELSE 'decoded' END AS state, raw_doi, sha256(json) AS sha256, CASE WHEN raw_doi IS NULL THEN 'crossref_item_doi_field_invalid' END AS error FROM i
""")
def crossref_items(spark: SparkSession, folder: str) -> DataFrame:
    return providers.decoded_items(providers.decoded_pages(pages(spark, folder)))


@query("""
SELECT p_partkey, CASE WHEN n IN (0, 1) THEN p_name END AS title, CASE n WHEN 3 THEN 'title_shape_invalid' WHEN 4 THEN 'title_missing_text' END AS warning FROM (SELECT p_partkey, p_name, p_partkey % 5 AS n FROM part)
""")
def first_titles(spark: SparkSession, folder: str) -> DataFrame:
    n, name = F.col("p_partkey") % 5, F.col("p_name")
    body = (
        F.when(n == 0, F.concat(F.lit('{"title":[" '), name, F.lit('\\n","b"]}')))
        .when(n == 1, F.concat(F.lit('{"title":[5,"  ","'), name, F.lit('"]}')))
        .when(n == 2, F.lit('{"title":null}'))
        .when(n == 3, F.concat(F.lit('{"title":"'), name, F.lit('"}')))
        .otherwise(F.lit('{"title":["", 7, null]}'))
    )
    return table(spark, folder, "part").select("p_partkey", providers.first_title(body).alias("t")).select("p_partkey", "t.title", "t.warning")


@query("""
SELECT p_partkey, sha256('{"DOI":"10.1000/' || p_partkey || '","publisher":"' || p_brand || '","title":["' || p_name || '"]' || CASE WHEN p_partkey % 2 = 0 THEN ',"type":"' || p_type || '"' ELSE '' END || '}') AS semantic_sha256 FROM part
""")
def semantic_hash(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    kind = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('"type":"'), F.col("p_type"), F.lit('",'))).otherwise(F.lit(""))
    body = F.concat(F.lit("{"), kind, F.lit('"indexed":{"n":'), k, F.lit('},"title":["'), F.col("p_name"), F.lit('"],"score":'), F.col("p_size").cast("string"), F.lit(',"publisher":"'), F.col("p_brand"), F.lit('","DOI":"10.1000/X"}'))
    return table(spark, folder, "part").select("p_partkey", providers.semantic_sha256(body, F.concat(F.lit("10.1000/"), k)).alias("semantic_sha256"))


@query("""
WITH i AS (
  SELECT l_orderkey AS page_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS ordinal,
    CASE WHEN l_partkey % 5 = 0 THEN 'crossref_provider_doi_invalid' WHEN l_partkey % 7 = 0 THEN 'crossref_item_mismatch' WHEN l_partkey % 11 = 0 THEN 'invalid_crossref_provider_revision' END AS error FROM lineitem
), s AS (SELECT *, min(CASE WHEN error = 'crossref_item_mismatch' THEN ordinal END) OVER (PARTITION BY page_id) AS stop FROM i)
SELECT page_id, ordinal, CASE WHEN ordinal > stop THEN 'pending' WHEN ordinal = stop THEN 'failed' WHEN error IS NOT NULL THEN 'quarantined' ELSE 'processed' END AS state FROM s
""")
def dead_letters(spark: SparkSession, folder: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    n = lambda m: F.col("l_partkey") % m == 0
    error = F.when(n(5), "crossref_provider_doi_invalid").when(n(7), "crossref_item_mismatch").when(n(11), "invalid_crossref_provider_revision")
    items = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("page_id"), place.alias("ordinal"), error.alias("error"))
    return providers.projected(items).select("page_id", "ordinal", "state")


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN extract('microsecond' FROM ts) % 1000000 > 0 THEN strftime(ts, '.%f') ELSE '' END || '+00:00'
  WHEN 1 THEN strftime(date_trunc('second', ts) - INTERVAL 2 HOURS, '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS instant FROM events
""")
def instants(spark: SparkSession, folder: str) -> DataFrame:
    text, n = lambda f: F.date_format("ts", f), F.col("event_id") % 4
    value = F.when(n == 0, F.concat(text("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))).when(n == 1, F.concat(text("yyyy-MM-dd HH:mm:ss"), F.lit("+02:00"))).when(n == 2, text("yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.lit("soon"))
    return table(spark, folder, "events").select("event_id", timing.instant_text(value).alias("instant"))


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id % 100 AS DOUBLE) WHEN 1 THEN 90.0 WHEN 2 THEN 0.0 END AS seconds FROM events
""")
def retry_afters(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("event_id") % 4
    value = F.when(n == 0, (F.col("event_id") % 100).cast("string")).when(n == 1, "Mon, 01 Jan 2024 00:01:30 GMT").when(n == 2, "Sun, 31 Dec 2023 23:59:59 GMT").otherwise("in a while")
    now = F.try_to_timestamp(F.lit("2024-01-01T00:00:00Z"))
    return table(spark, folder, "events").select("event_id", timing.retry_after(value, now).alias("seconds"))


@query("""
WITH c AS (SELECT o_orderkey AS k, o_orderkey % 11 AS n FROM orders)
SELECT k AS run_id, CASE WHEN n IN (7, 8, 10) THEN CASE WHEN n = 8 THEN 'irrelevant' ELSE 'direct' END END AS decision, CASE WHEN n IN (7, 8, 10) THEN ' because ' END AS reason,
  CASE n WHEN 0 THEN 'relevance_model_mismatch' WHEN 1 THEN 'incomplete_relevance_response' WHEN 2 THEN 'invalid_relevance_response' WHEN 3 THEN 'relevance_version_mismatch' WHEN 4 THEN 'invalid_relevance_response'
    WHEN 5 THEN 'invalid_relevance_response' WHEN 6 THEN 'direct_evidence_missing' WHEN 9 THEN 'invalid_relevance_response' END AS error,
  CASE WHEN n IN (7, 10) THEN 2 WHEN n = 8 THEN 0 END AS n_anchors
FROM c
""")
def relevance_parse(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("o_orderkey") % 11
    ids = F.when(n == 5, '["a1","a1"]').when(n == 6, '["a2"]').when(n == 8, "[]").when(n == 9, '["a1","b9"]').otherwise('["a2","a1"]')
    decision = F.when(n == 8, "irrelevant").when(n == 4, "odd").otherwise("direct")
    more = F.when(n == 2, ',"x":1').otherwise("")
    body = F.concat(
        F.lit('{"schema_version":"v1","snapshot_id":"s","profile_id":"p","domain_id":"d","input_fingerprint":"f","profile_revision":'), F.when(n == 3, "2").otherwise("1"),
        F.lit(',"domain_revision":1,"decision":"'), decision, F.lit('","recommendation_reason":" because ","anchor_ids":'), ids, more, F.lit("}"),
    )
    asked = {"schema_version": "v1", "snapshot_id": "s", "profile_id": "p", "domain_id": "d", "input_fingerprint": "f"}
    rows = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.when(n == 0, "other").otherwise("m").alias("model_name"), F.when(n == 1, "length").otherwise("stop").alias("finish_reason"), body.alias("content_json"),
        *(F.lit(v).alias(c) for c, v in asked.items()), F.lit(1).alias("profile_revision"), F.lit(1).alias("domain_revision"),
    )
    anchors = spark.range(2).select(F.lit("s").alias("snapshot_id"), F.concat(F.lit("a"), (F.col("id") + 1).cast("string")).alias("anchor_id"), F.when(F.col("id") == 0, "of Badminton, say").otherwise("of chess").alias("quote"))
    found = evidence.parsed_relevance(rows, anchors, {"d": ["badminton"]}, "m")
    return found.select("run_id", "decision", "reason", "error", F.when(F.col("anchor_ids").isNotNull(), F.size("anchor_ids")).alias("n_anchors"))


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, sha256(o_orderstatus || o_orderpriority) AS content FROM orders),
f AS (SELECT o_custkey, content, min((o_orderdate, o_orderkey)) AS first FROM o GROUP BY 1, 2),
n AS (SELECT o_custkey, content, row_number() OVER (PARTITION BY o_custkey ORDER BY first) AS revision FROM f)
SELECT o_orderkey, CAST(revision AS INTEGER) AS revision, CAST(max(revision) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS INTEGER) AS pointer FROM o JOIN n USING (o_custkey, content)
""")
def profile_publish(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").withColumn("content", F.sha2(F.concat("o_orderstatus", "o_orderpriority"), 256))
    return revisions.published(rows, "o_custkey", "content", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "revision", "pointer")


@query("""
SELECT o_orderkey, CAST(row_number() OVER w AS INTEGER) AS place, CAST(epoch_us(lead(o_orderdate) OVER w) AS BIGINT) AS until_us FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def revision_history(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").withColumn("since", F.col("o_orderdate").cast("timestamp"))
    return revisions.history(rows, "o_custkey", ["o_orderdate", "o_orderkey"], "since").select("o_orderkey", "place", F.unix_micros("until").alias("until_us"))


@query("""
WITH p AS (SELECT o_custkey AS traversal, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS page_no, [o_orderkey % 20, o_orderkey % 7, o_orderkey % 7] AS ids FROM orders),
e AS (SELECT DISTINCT traversal, page_no, unnest(ids) AS id FROM p), f AS (SELECT *, min(page_no) OVER (PARTITION BY traversal, id) AS first FROM e)
SELECT traversal, CAST(page_no AS INTEGER) AS page_no, count(*) FILTER (page_no > first) AS repeated FROM f GROUP BY 1, 2
""")
def traversal_repeats(spark: SparkSession, folder: str) -> DataFrame:
    no = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("traversal"), no.alias("page_no"), F.array(*(F.col("o_orderkey") % m for m in (20, 7, 7))).alias("ids"))
    return traversal.seen_before(rows)


@query("""
SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS states, count(DISTINCT l_returnflag) = 1 AS agreed FROM lineitem GROUP BY 1
""")
def ledger_states(spark: SparkSession, folder: str) -> DataFrame:
    return ledgers.distinct_states(table(spark, folder, "lineitem"), "l_orderkey", "l_returnflag").select("l_orderkey", F.array_join("states", ",").alias("states"), "agreed")


@query("""
WITH g AS (SELECT l_orderkey, list_sort(list(l_partkey % 3)) AS a, list_sort(list(l_suppkey % 3)) AS b FROM lineitem GROUP BY 1) SELECT l_orderkey, a = b AS same FROM g
""")
def order_free_equality(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey") % 3).alias("a"), F.collect_list(F.col("l_suppkey") % 3).alias("b"))
    return rows.select("l_orderkey", ledgers.same_in_any_order(F.col("a"), F.col("b")).alias("same"))


@query("""
SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(value) AS BIGINT) % 10, CAST(floor(value) AS BIGINT) % 10 + event_id % 3, 'a' || event_id) AS INTEGER) AS place FROM events
""")
def anchor_order(spark: SparkSession, folder: str) -> DataFrame:
    start = F.expr("CAST(floor(value) AS BIGINT) % 10")
    rows = table(spark, folder, "events").select("event_id", F.col("user_id").alias("snapshot_id"), start.alias("offset_start"), (start + F.col("event_id") % 3).alias("offset_end"), F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("anchor_id"))
    return evidence.in_order(rows).select("event_id", "place")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus WHEN o_orderkey % 3 = 0 THEN 'settled' WHEN o_orderkey % 3 = 1 THEN 'released' ELSE 'unknown' END AS state FROM orders
""")
def settled_reservations(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("o_orderkey") % 3
    state = F.when(F.col("o_orderstatus") == "O", "reserved").otherwise(F.col("o_orderstatus"))
    return table(spark, folder, "orders").select("o_orderkey", ledgers.settled_state(state, F.when(n == 0, "success").when(n == 1, "no_charge")).alias("state"))


@query("""
SELECT o_orderkey, o_orderkey % 2 = 0 AS same FROM orders
""")
def returned_ids(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, folder, "orders").select(k, feeds.returned_as_asked(F.array(k, k + 1, k), F.when(k % 2 == 0, F.array(k + 1, k)).otherwise(F.array(k))).alias("same"))


@query("""
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'duplicate_key' WHEN 1 THEN 'not_finite' WHEN 2 THEN 'invalid' WHEN 3 THEN 'too_deep' END AS error,
  regexp_replace(lang || ' a  b', '\\s+', ' ', 'g') AS flat, lang || chr(10) || source || chr(10) || 'x' AS lines FROM documents
""")
def strict_texts(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("doc_id") % 6
    body = F.when(n == 0, '{"a":1,"a":2}').when(n == 1, '{"a":NaN}').when(n == 2, "{a}").when(n == 3, F.concat(F.repeat(F.lit("["), F.lit(70)), F.repeat(F.lit("]"), F.lit(70)))).otherwise('{"a":[1]}')
    flat = texts.flat_space(F.concat(F.lit(" "), F.col("lang"), F.lit(" \n a\t b ")))
    lines = texts.newlines(F.concat(F.lit(" \r\n"), F.col("lang"), F.lit("\r\n"), F.col("source"), F.lit("\rx\n ")))
    return table(spark, folder, "documents").select("doc_id", values.problem(body).alias("error"), flat.alias("flat"), lines.alias("lines"))


@query("""
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'languages>relevance' END, CASE WHEN o_orderkey % 3 = 0 THEN 'free_only>access' END, CASE WHEN o_orderkey % 5 > 0 THEN 'allow_preprints>publication_status' END, CASE WHEN o_orderkey % 7 = 0 THEN 'scope_text>relevance' END], lambda x: x IS NOT NULL), ' ') AS deferred FROM orders
""")
def deferred_filters(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    found = planning.deferred(F.when(k % 2 == 0, F.array(F.lit("en"))).otherwise(F.array().cast("array<string>")), k % 3 == 0, k % 5 == 0, F.when(k % 7 == 0, "x").otherwise(""))
    return table(spark, folder, "orders").select(k, F.array_join(F.transform(found, lambda x: F.concat(x["name"], F.lit(">"), x["stage"])), " ").alias("deferred"))


@query("""
WITH e AS (SELECT event_id, round(value * 100)::BIGINT AS v, user_id AS u, event_type AS t FROM events),
f AS (
  SELECT *, CASE t WHEN 'error' THEN 503 WHEN 'view' THEN 429 WHEN 'click' THEN 200 ELSE 302 END AS status, CASE WHEN u % 5 = 0 THEN NULL ELSE (v % 90)::DOUBLE END AS wait, u % 7 AS failures,
    CASE WHEN v % 4 = 0 THEN NULL ELSE greatest(1.0, (u % 40 + 1)::DOUBLE / (v % 9 + 1)) END AS stated FROM e
)
SELECT event_id, CASE WHEN status IN (429, 503) THEN 'retry' WHEN status = 200 THEN 'accept' ELSE 'stop' END AS action,
  CASE status WHEN 429 THEN 'crossref_rate_limited' WHEN 503 THEN 'crossref_server_error' WHEN 302 THEN 'crossref_redirect' END AS code,
  CASE WHEN status IN (429, 503) THEN greatest(coalesce(stated, 1.0), coalesce(wait, 0.0), least(300.0, pow(2.0, failures + 1)) * 0.75) ELSE 0.0 END AS delay, coalesce(stated, 1.0)::DOUBLE AS interval_s,
  CASE WHEN stated IS NULL THEN ['crossref_rate_headers_missing'] ELSE [] END AS warnings FROM f
""")
def rate_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Events as answers with headers: what each means for the next request."""
    v, u, text = F.round(F.col("value") * 100).cast("long"), F.col("user_id"), lambda c: c.cast("string")
    header = lambda name, value: F.struct(F.lit(name).alias("key"), value.alias("value"))
    headers = F.array_compact(F.array(
        F.when(u % 5 != 0, header("Retry-After", text(v % 90))), F.when(v % 4 != 0, header("X-Rate-Limit-Limit", text(v % 9 + 1))), F.when(v % 4 != 0, header("x-rate-limit-interval", F.concat(text(u % 40 + 1), F.lit("s")))),
    ))
    status = F.when(F.col("event_type") == "error", 503).when(F.col("event_type") == "view", 429).when(F.col("event_type") == "click", 200).otherwise(302)
    made = rates.decision(status, headers, F.col("ts").cast("timestamp"), (u % 7).cast("int"), F.lit(0.5), F.lit(None).cast("string"))
    return table(spark, folder, "events").select("event_id", made.alias("d")).select("event_id", "d.action", "d.code", "d.delay", F.col("d.interval").alias("interval_s"), "d.warnings")


@query("""
SELECT l_linenumber AS case_id, (SELECT bool_or(o_orderstatus = 'P' AND o_orderkey % 7 = l_linenumber) FROM orders) OR (SELECT bool_or(o_orderpriority = '1-URGENT' AND o_orderkey % 90 = l_linenumber) FROM orders) AS blocked
FROM (SELECT DISTINCT l_linenumber FROM lineitem)
""")
def digests_blocked(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    case = lambda n: (F.col("o_orderkey") % n).cast("int").alias("case_id")
    planned = orders.select(case(7), F.when(F.col("o_orderstatus") == "P", "harvest").otherwise("recent").alias("outcome"))
    open_ = orders.select(case(90), F.when(F.col("o_orderpriority") == "1-URGENT", "pending").otherwise("done").alias("state"))
    return planning.digests_blocked(table(spark, folder, "lineitem").select(F.col("l_linenumber").alias("case_id")).distinct(), planned, open_, "case_id")

"""Queries of provider searches and of the pages that answer them, over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.operators import requests
from quillmark.plans.registry import query
from quillmark.sources import paging
from quillmark.sources.folders import shared_folder
from quillmark.sources.tables import table

ENCODED = """replace(replace(replace(replace(replace(replace(replace(replace(replace({}, '%', '%25'), '#', '%23'), '"', '%22'), '(', '%28'), ')', '%29'), '[', '%5B'), ']', '%5D'), '/', '%2F'), ' ', '+')"""


@query(f"""
WITH p AS (
  SELECT p_partkey, list_sort(list_distinct(string_split(p_name, ' ') || [p_brand])) AS scope, CASE WHEN p_size > 25 THEN [p_type] ELSE [] END AS wanted, CASE WHEN p_size % 2 = 0 THEN ['x', p_type] ELSE [] END AS unwanted,
    (p_size * 37)::BIGINT AS total FROM part
), s AS (
  SELECT *, '(' || array_to_string(list_transform(scope, lambda x: '"' || x || '"[Title/Abstract]'), ' OR ') || ')' || CASE WHEN len(wanted) > 0 THEN ' AND ("' || wanted[1] || '"[Title/Abstract])' ELSE '' END ||
    CASE WHEN len(unwanted) > 0 THEN ' NOT (' || array_to_string(list_transform(list_sort(unwanted), lambda x: '"' || x || '"[Title/Abstract]'), ' OR ') || ')' ELSE '' END || ' AND ("eng"[Language])' AS search FROM p
)
SELECT p_partkey, start, least(200, 1000 - start)::BIGINT AS size, 'https://eutils.ncbi.nlm.nih.gov/entrez/eutils/esearch.fcgi?db=pubmed&term=' || {ENCODED.format("search")} || '&retmode=json&retstart=' || start || '&retmax=' || least(200, 1000 - start) ||
  '&datetype=crdt&mindate=2024%2F01%2F01&maxdate=2024%2F01%2F02&tool=t&email=a%40b.org' AS url
FROM s, unnest(range(0, least(total, 1000), 200)) u(start)
""")
def article_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as profiles: every page of their searches, of 200 articles each, up to a thousand."""
    pick = lambda test, *xs: F.when(test, F.array(*xs)).otherwise(F.array().cast("array<string>"))
    parts = table(spark, folder, "part")
    found = requests.article_search(F.split("p_name", " "), F.array("p_brand"), pick(F.col("p_size") > 25, F.col("p_type")), pick(F.col("p_size") % 2 == 0, F.col("p_type")), pick(F.col("p_size") % 2 == 0, F.lit("x")), F.array(F.lit("eng")))
    day = lambda d: F.to_date(F.lit(d))
    queries = parts.select(F.col("p_partkey").alias("query_id"), found["search"].alias("search"), day("2024-01-01").alias("from_day"), day("2024-01-03").alias("until_day"), F.lit(200).alias("page_size"), (F.col("p_size") * 37).cast("long").alias("total"))
    return requests.article_requests(queries, "t", "a@b.org", 1000).withColumnRenamed("query_id", "p_partkey")


@query("""
WITH o AS (
  SELECT o_orderkey, 'c' || o_custkey AS binding, o_orderpriority AS scope, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS a, strftime(o_orderdate + to_hours((o_custkey % 30)::INTEGER), '%Y-%m-%dT%H:%M:%S') AS b, o_custkey % 30 AS hours, o_custkey % 1100 AS n FROM orders
), e AS (SELECT *, CASE WHEN n = 0 OR n > 1000 THEN 'invalid_crossref_rows' WHEN hours = 0 OR hours > 24 THEN 'invalid_crossref_window' END AS error, 'from-index-date:' || a || ',until-index-date:' || b AS filter FROM o),
f AS (
  SELECT *, sha256('{"binding_key":"' || binding || '","config_version":"v1","endpoint":"https://api.crossref.org/works","parameters":[["filter","' || filter || '"],["query.bibliographic","' || scope || '"],["rows","' || n || '"]],"protocol_version":"crossref-rest-page-v1"}') AS q,
    sha256('[["filter","' || filter || '"],["mailto","a@b.org"],["query.bibliographic","' || scope || '"],["rows","' || n || '"]]') AS p,
    'https://api.crossref.org/works?filter=' || replace(replace(filter, ':', '%3A'), ',', '%2C') || '&mailto=a%40b.org&query.bibliographic=' || replace(scope, ' ', '+') || '&rows=' || n || '&cursor=%2A' AS url FROM e
)
SELECT o_orderkey, error, CASE WHEN error IS NULL THEN q END AS query_fingerprint, CASE WHEN error IS NULL THEN p END AS parameters_fingerprint, CASE WHEN error IS NULL THEN url END AS url,
  CASE WHEN error IS NULL THEN sha256('{"method":"GET","parameters_fingerprint":"' || p || '","protocol_version":"crossref-rest-page-v1","query_fingerprint":"' || q || '","url":"' || url || '"}') END AS request_fingerprint FROM f
""")
def works_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as windows of a binding: the plan of each and its first request."""
    at = F.col("o_orderdate").cast("timestamp")
    until = F.timestamp_micros(F.unix_micros(at) + (F.col("o_custkey") % 30) * 3_600_000_000)
    definitions = table(spark, folder, "orders").select("o_orderkey", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("binding_key"), F.col("o_orderpriority").alias("scope"), at.alias("from_index"), until.alias("until_index"), F.lit("a@b.org").alias("email"), F.lit("v1").alias("config_version"), (F.col("o_custkey") % 1100).alias("rows"), F.lit("*").alias("cursor"))
    return requests.works_requests(requests.works_plans(definitions)).select("o_orderkey", "error", "query_fingerprint", "parameters_fingerprint", "url", "request_fingerprint")


PAGE_SIZE = 3


def parts_as_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Parts by brand as the items of a search, three on a page; a page's position is its first item's place."""
    one = Window.partitionBy("search")
    place = F.row_number().over(one.orderBy("p_partkey")) - 1
    parts = table(spark, folder, "part").select(F.col("p_brand").alias("search"), "p_partkey").withColumns({"start": place - place % PAGE_SIZE, "total": F.count("*").over(one).cast("int")})
    return parts.groupBy("search", "total", "start").agg(F.array_sort(F.collect_list("p_partkey")).alias("items"))


@query("""
WITH p AS (SELECT p_brand AS search, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS n FROM part),
g AS (SELECT search, n // 3 * 3 AS start, '[' || string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) || ']' AS items FROM p GROUP BY 1, 2)
SELECT search, start::VARCHAR AS position, '{"items":' || items || '}' AS body, sha256('{"items":' || items || '}') AS sha256, NULL AS error FROM g
UNION ALL SELECT search, (max(start) + 3)::VARCHAR, NULL, NULL, 'page_missing' FROM g GROUP BY search
""")
def stored_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that were stored, read back by the starts that their totals ask for; each total counts one page more than there is."""
    pages = parts_as_pages(spark, folder)
    place = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    paging.store(pages.select("search", F.col("start").cast("string").alias("position"), F.to_json(F.struct("items")).alias("body")), place)
    totals = pages.groupBy("search").agg((F.max("start") + 2 * PAGE_SIZE).alias("total")).collect()  # a row for each search
    return paging.by_start(spark, place, [(r.search, r.total, PAGE_SIZE) for r in totals], pages=4)


@query("""
WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS n FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)), g AS (SELECT n // 3 AS k, list(p_partkey ORDER BY p_partkey) AS items FROM p GROUP BY 1)
SELECT CASE k WHEN 0 THEN '*' ELSE 'c' || k END AS cursor, unnest(items) AS p_partkey FROM g
""")
def followed_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The pages of one search, followed by a stream from cursor to cursor, and the items on them."""
    own = parts_as_pages(spark, folder)
    least = own.agg(F.min("search").alias("search"))
    own = own.join(F.broadcast(least), "search")  # one row
    number = F.expr(f"start div {PAGE_SIZE}")
    cursor = lambda k: F.when(k == 0, "*").otherwise(F.concat(F.lit("c"), k.cast("string")))
    message = F.struct("items", F.when(F.col("start") + PAGE_SIZE < F.col("total"), cursor(number + 1)).alias("next-cursor"))
    place = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    paging.store(own.select("search", cursor(number).alias("position"), F.to_json(F.struct(message.alias("message"))).alias("body")), f"{place}/in")
    stream = paging.by_cursor(spark, f"{place}/in", least.first().search, PAGE_SIZE).select(F.col("position").alias("cursor"), F.explode(F.from_json(F.get_json_object("body", "$.message.items"), "array<bigint>")).alias("p_partkey"))
    stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/offsets").trigger(once=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")

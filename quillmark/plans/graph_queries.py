"""Queries of extracted graphs and provider pages over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators import graph
from quillmark.plans.registry import query
from quillmark.sources import feeds, xml_pages
from quillmark.sources.tables import table

PREDICATES = ["is-preprint-of", "References", "is-part-of", "is-like"]


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as items: two relations each, one of them sometimes broken, and updates."""
    k = F.col("p_partkey").cast("string")
    pick = lambda n: F.get(F.array(*map(F.lit, PREDICATES)), ((F.col("p_partkey") + n) % 4).cast("int"))
    entry = F.concat(F.lit('{"id-type":"doi","id":"10.1000/A'), k, F.lit('","asserted-by":"subject"}'))
    other = F.when(F.col("p_partkey") % 5 == 0, F.lit('{"id-type":"doi"}')).when(F.col("p_partkey") % 5 == 1, F.lit('"x"')).otherwise(F.concat(F.lit('{"id-type":"issn","id":"'), k, F.lit('"}')))
    second = F.when(F.col("p_partkey") % 7 == 0, F.lit('"none"')).otherwise(F.concat(F.lit("["), entry, F.lit("]")))
    kind = F.get(F.array(*map(F.lit, ["Correction", "partial_retraction", "new-edition", "expression of concern"])), (F.col("p_partkey") % 4).cast("int"))
    date = F.concat(F.lit('{"date-parts":[['), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 > 0, F.lit(",5")).otherwise(""), F.lit("]]}"))
    n = F.col("p_partkey") % 11
    date = (
        F.when(n == 2, F.lit('{"date-time":"2024-01-02T03:04:05Z","date-parts":[[2023]]}'))
        .when(n == 3, F.lit('{"date-time":"2024-01-02T03:04:05+02:00"}'))
        .when(n == 4, F.lit('{"date-time":"2024-01-02T03:04:05"}'))
        .when(n == 5, F.lit('{"date-time":"2024-01-02T03:04:05","date-parts":[[2024,13]]}'))
        .when(n == 8, F.lit('"today"'))
        .otherwise(date)
    )
    doi = F.when(n == 7, F.lit(" ")).otherwise(F.concat(F.lit("10.1/"), (F.col("p_partkey") % 300).cast("string")))
    update = F.concat(F.lit('[{"DOI":"'), doi, F.lit('","type":"'), kind, F.lit('","updated":'), date, F.lit("}]"))
    update = F.when(n == 1, F.lit('{"DOI":"10.1/1"}')).when(n == 6, F.lit('["x"]')).otherwise(update)
    body = F.concat(F.lit('{"relation":{"'), pick(0), F.lit('":['), entry, F.lit(","), other, F.lit('],"'), pick(1), F.lit('":'), second, F.lit('},"update-to":'), update, F.lit("}"))
    return table(spark, folder, "part").select(F.col("p_partkey").alias("item_id"), body.alias("json"))


NAMES = "['is-preprint-of', 'References', 'is-part-of', 'is-like']"


@query(f"""
WITH p AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS s, ({NAMES})[p_partkey % 4 + 1] AS a, ({NAMES})[(p_partkey + 1) % 4 + 1] AS b FROM part),
e AS (
  SELECT k, a AS predicate, 0 AS place, 'doi' AS id_type, '10.1000/A' || s AS target, 'subject' AS asserted_by, NULL AS gap FROM p
  UNION ALL SELECT k, a, 1, CASE WHEN k % 5 = 0 THEN 'doi' WHEN k % 5 > 1 THEN 'issn' END, CASE WHEN k % 5 > 1 THEN s END, NULL, CASE k % 5 WHEN 0 THEN 'target_missing' WHEN 1 THEN 'entry_not_object' END FROM p
  UNION ALL SELECT k, b, CASE WHEN k % 7 > 0 THEN 0 END, CASE WHEN k % 7 > 0 THEN 'doi' END, CASE WHEN k % 7 > 0 THEN '10.1000/A' || s END, CASE WHEN k % 7 > 0 THEN 'subject' END, CASE WHEN k % 7 = 0 THEN 'entries_not_list' END FROM p
)
SELECT k AS item_id, predicate, CAST(place AS INTEGER) AS place,
  CAST(CASE WHEN gap IS NULL THEN row_number() OVER (PARTITION BY k, gap IS NULL ORDER BY predicate, place) - 1 END AS INTEGER) AS ordinal, id_type, target, asserted_by,
  CASE predicate WHEN 'is-preprint-of' THEN 'intra_work' WHEN 'is-like' THEN 'unknown' ELSE 'inter_work' END AS class, gap,
  CASE WHEN id_type = 'doi' AND target IS NOT NULL THEN 'normalized' WHEN id_type = 'doi' THEN 'invalid' ELSE 'raw' END AS target_state,
  CASE WHEN id_type = 'doi' THEN lower(target) ELSE target END AS target_value
FROM e
""")
def relation_extract(spark: SparkSession, folder: str) -> DataFrame:
    return graph.targets(graph.relation_entries(items(spark, folder)))


UPDATES = """
WITH p AS (SELECT *, p_partkey % 11 AS n FROM part),
u AS (
  SELECT p_partkey AS item_id, 'update_to' AS direction, 0 AS ordinal, CASE WHEN n <> 7 THEN '10.1/' || CAST(p_partkey % 300 AS VARCHAR) END AS counterparty,
    CASE p_partkey % 4 WHEN 0 THEN 'correction' WHEN 1 THEN 'retraction' WHEN 2 THEN 'other_update' ELSE 'expression_of_concern' END AS kind,
    CASE WHEN n = 2 THEN '2024-01-02T03:04:05+00:00' WHEN n = 3 THEN '2024-01-02T01:04:05+00:00' WHEN n NOT IN (4, 5, 8) THEN lpad(CAST(p_size AS VARCHAR), 4, '0') || CASE WHEN p_partkey % 3 > 0 THEN '-05' ELSE '' END END AS updated,
    CASE WHEN n IN (2, 3) THEN 'second' WHEN n NOT IN (4, 5, 8) THEN CASE WHEN p_partkey % 3 > 0 THEN 'month' ELSE 'year' END END AS precision FROM p WHERE n NOT IN (1, 6)
)
"""


@query(UPDATES + "SELECT * FROM u")
def integrity_extract(spark: SparkSession, folder: str) -> DataFrame:
    return graph.integrity_entries(items(spark, folder))


@query("""
SELECT p_partkey AS item_id, CASE n WHEN 1 THEN 'update-to' WHEN 6 THEN 'update-to[0]' WHEN 7 THEN 'update-to[0].DOI' ELSE 'update-to[0].updated' END AS path,
  CASE n WHEN 1 THEN 'integrity_updates_not_list' WHEN 6 THEN 'integrity_update_not_object' WHEN 7 THEN 'integrity_counterparty_doi_invalid_text' ELSE 'integrity_updated_invalid' END AS code
FROM (SELECT p_partkey, p_partkey % 11 AS n FROM part) WHERE n IN (1, 4, 5, 6, 7, 8)
""")
def integrity_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return graph.integrity_gaps(items(spark, folder))


@query(UPDATES + """
SELECT item_id, ordinal, s_suppkey AS work_id, kind AS event_kind, CASE WHEN precision = 'second' THEN updated END AS occurred, CASE WHEN s_suppkey IS NULL THEN 'unresolved' ELSE 'promoted' END AS state
FROM u LEFT JOIN supplier ON counterparty = '10.1/' || CAST(s_suppkey AS VARCHAR) WHERE kind IN ('correction', 'retraction')
""")
def event_promotion(spark: SparkSession, folder: str) -> DataFrame:
    bindings = table(spark, folder, "supplier").select(F.concat(F.lit("10.1/"), F.col("s_suppkey").cast("string")).alias("doi"), F.col("s_suppkey").alias("work_id"))
    return graph.promoted(graph.integrity_entries(items(spark, folder)), bindings)


@query("""
WITH e AS (SELECT DISTINCT l_partkey % 100 AS source, l_suppkey AS target, l_returnflag AS kind, l_orderkey AS revision, l_shipdate AS observed FROM lineitem)
SELECT source, target, kind, count(DISTINCT (revision, observed)) AS n_observations, CAST(epoch_us(min(observed)) AS BIGINT) AS first_us FROM e GROUP BY 1, 2, 3
""")
def assertion_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select((F.col("l_partkey") % 100).alias("source"), F.col("l_suppkey").alias("target"), F.col("l_returnflag").alias("kind"), F.col("l_orderkey").alias("revision"), F.col("l_shipdate").cast("timestamp").alias("observed"))
    assertions, observations = graph.distinct_assertions(rows, ["source", "target", "kind"], "revision", "observed")
    n = observations.groupBy("assertion_id").agg(F.count("*").alias("n_observations"))
    return assertions.join(n, "assertion_id").select("source", "target", "kind", "n_observations", F.unix_micros("first_observed").alias("first_us"))


FEED = """
WITH d AS (SELECT doc_id, coalesce(lang, '-') AS lang, coalesce(source, '-') AS source, coalesce(n_chars, 0) AS n FROM documents),
e AS (
  SELECT *, place, '24' || lpad((n % 12 + 1)::VARCHAR, 2, '0') || '.' || lpad(((doc_id * 2 + place) % 100000)::VARCHAR, 5, '0') AS base, n % 9 + 1 AS version,
    CASE WHEN n % 10 = 0 THEN 'malformed_xml' WHEN n % 11 = 0 THEN 'invalid_page_counts' WHEN n % 7 = 0 THEN 'unsupported_text_markup' WHEN n % 10 = 1 THEN 'duplicate_field' WHEN n % 10 = 2 THEN 'missing_field'
      WHEN n % 60 = 59 THEN 'invalid_timestamp' END AS error
  FROM d, range(2) t(place)
)
"""


@query(FEED + """
SELECT doc_id AS page_id, place::INTEGER AS place, base || 'v' || version AS id, version::INTEGER AS version, 'On ' || source || ' & <' || lang || '>' AS title, '10.1000/' || n AS doi, [source, 'B'] AS authors,
  CAST(epoch_us(TIMESTAMP '2024-01-02 03:00:00' + to_minutes((n % 60)::INTEGER) - INTERVAL 2 HOURS) AS BIGINT) AS updated_us, lang AS primary_category, NULL AS error FROM e WHERE error IS NULL
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, error FROM e WHERE error IS NOT NULL AND place = 0
""")
def feed_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as pages of two entries, made of their source, language and length."""
    n, lang, source = F.coalesce("n_chars", F.lit(0).cast("long")), F.coalesce("lang", F.lit("-")), F.coalesce("source", F.lit("-"))
    say = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    tag = lambda name, *parts: say(f"<{name}>", *parts, f"</{name}>")
    title = tag("title", "\n On ", source, " &amp; ", F.when(n % 7 == 0, "<i>x</i>").otherwise(""), "<![CDATA[<]]>", lang, "&gt; ")
    minute = F.lpad((n % 60).cast("string"), 2, "0")
    entry = lambda place: tag(
        "entry", tag("id", "http://arxiv.org/abs/24", F.lpad((n % 12 + 1).cast("string"), 2, "0"), ".", F.lpad(((F.col("doc_id") * 2 + place) % 100_000).cast("string"), 5, "0"), "v", (n % 9 + 1).cast("string")),
        title, F.when(n % 10 == 1, title).otherwise(""), tag("author", tag("name", source), "<a:affiliation>X</a:affiliation>"), tag("author", tag("name", "B")),
        F.when(n % 10 == 2, "").otherwise(say('<category term="', lang, '"/><category term="other" scheme="s"/>')), say('<a:primary_category term="', lang, '"/>'),
        tag("published", "2024-01-02T03:04:05Z"), tag("updated", "2024-01-02T03:", minute, F.when(n % 60 == 59, "").otherwise(":00"), "+02:00"), tag("a:doi", " 10.1000/", n.cast("string")), '<link href="https://example.org/"/>',
    )
    items = F.when(n % 11 == 0, "1").otherwise("50")
    body = say('<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:a="http://arxiv.org/schemas/atom" xmlns:opensearch="http://a9.com/-/spec/opensearch/1.1/">', tag("opensearch:totalResults", "9"), tag("opensearch:startIndex", "0"), tag("opensearch:itemsPerPage", items), entry(0), entry(1), F.when(n % 10 == 0, "<feed>").otherwise("</feed>"))
    pages = table(spark, folder, "documents").select(F.col("doc_id").alias("page_id"), body.alias("body"), F.lit(100).alias("max_results"))
    found = xml_pages.atom_records(pages)
    return found.select("page_id", "place", "id", "version", "title", "doi", F.transform("authors", lambda a: a["name"]).alias("authors"), F.unix_micros("updated").alias("updated_us"), "primary_category", "error")


@query("""
WITH p AS (SELECT o_orderkey, o_orderkey % 6 AS n FROM orders)
SELECT o_orderkey, CASE WHEN n = 0 THEN 'invalid_page' WHEN n = 1 THEN 'invalid_id' WHEN n = 2 THEN 'duplicate_id' WHEN n = 3 THEN 'count_mismatch' END AS error FROM p
""")
def id_pages(spark: SparkSession, folder: str) -> DataFrame:
    k, n = (F.col("o_custkey") + 1).cast("string"), F.col("o_orderkey") % 6
    ids = F.when(n == 1, F.lit('["0"]')).when(n == 2, F.concat(F.lit('["7","'), k, F.lit('","7"]'))).otherwise(F.concat(F.lit('["'), k, F.lit('","99999999"]')))
    body = F.when(n == 0, F.lit('{"esearchresult":{}}')).otherwise(F.concat(F.lit('{"esearchresult":{"count":"'), F.when(n == 3, "1").otherwise("9"), F.lit('","idlist":'), ids, F.lit("}}")))
    return table(spark, folder, "orders").select("o_orderkey", feeds.id_page(body)["error"].alias("error"))


@query("""
WITH r AS (SELECT c_custkey AS k, 'objects/' || CAST(c_custkey AS VARCHAR) AS path, sha256(c_name) AS sha, CASE WHEN c_custkey % 10 = 0 THEN 'retired' ELSE 'available' END AS state FROM customer WHERE c_custkey % 4 <> 3),
f AS (SELECT c_custkey AS k, 'objects/' || CAST(c_custkey AS VARCHAR) || CASE WHEN c_custkey % 8 = 7 THEN '.tmp' ELSE '' END AS path, sha256(c_name || CASE WHEN c_custkey % 6 = 0 THEN 'x' ELSE '' END) AS sha FROM customer WHERE c_custkey % 4 <> 1)
SELECT coalesce(r.path, f.path) AS path, CASE WHEN r.path IS NULL THEN CASE WHEN f.path LIKE '%.tmp' THEN 'temporary' ELSE 'unregistered' END WHEN state <> 'available' THEN 'not_available' WHEN f.path IS NULL THEN 'missing' ELSE 'changed' END AS code
FROM r FULL JOIN f ON r.path = f.path WHERE r.path IS NULL OR state <> 'available' OR f.path IS NULL OR r.sha <> f.sha
""")
def storage_inspection(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    path = F.concat(F.lit("objects/"), k.cast("string"))
    rows = table(spark, folder, "customer")
    registry = rows.where(k % 4 != 3).select(path.alias("path"), F.sha2("c_name", 256).alias("sha256"), F.when(k % 10 == 0, "retired").otherwise("available").alias("state"))
    files = rows.where(k % 4 != 1).select(F.concat(path, F.when(k % 8 == 7, ".tmp").otherwise("")).alias("path"), F.sha2(F.concat("c_name", F.when(k % 6 == 0, "x").otherwise("")), 256).alias("sha256"))
    return feeds.storage_problems(registry, files)

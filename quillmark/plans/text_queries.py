"""Queries of identifiers, addresses, evidence and numbers over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import identifiers, texts, timing
from quillmark.functions.hashing import canonical_json_ascii, canonical_json_utf8, framed_sha256
from quillmark.operators import evidence, rendering
from quillmark.plans.registry import query
from quillmark.sources.tables import table

#: Values of every form, some of them wrong, made of keys. %k is the key, %m a month, %y a year.
FORMS = {
    "doi": ["10.%t/A.%k", "https://doi.org/10.%t/ab%2Fc%k", "HTTP://DX.doi.org/10.1000/%k%zz", "doi: 10.12345/É%k", "https://example.org/10.1000/%k", "10.12/%k", "10.1000/x+%k?y"],
    "arxiv": ["%y%m.%s", "arXiv:%y%m.0%sv2", "https://arxiv.org/abs/hep-th/%y%m123v10", "hep-th/%y%m123", "%y13.%s", "https://example.org/%y%m.%s"],
    "pmid": ["00%k", "%k", "0", "x%k", " %k "],
    "pmc": ["PMC0%k", "pmc%k", "%k", "PMC0"],
}
KEY_SQL = """
WITH keys AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS ks, lpad(CAST(o_orderkey % 20 AS VARCHAR), 2, '0') AS y, lpad(CAST(o_orderkey % 14 AS VARCHAR), 2, '0') AS m,
  CAST(1000 + o_orderkey % 9000 AS VARCHAR) AS s, CAST(1000 + o_orderkey % 90000 AS VARCHAR) AS t FROM orders), forms(namespace, n, form) AS (VALUES FORMS),
v AS (
  SELECT k, namespace, replace(replace(replace(replace(replace(form, '%k', ks), '%y', y), '%m', m), '%s', s), '%t', t) AS raw
  FROM keys JOIN (SELECT *, count(*) OVER (PARTITION BY namespace) AS total FROM forms) f ON keys.k % f.total = f.n
)
""".replace("FORMS", ", ".join(f"('{ns}', {n}, '{form}')" for ns, forms in FORMS.items() for n, form in enumerate(forms)))


@query(KEY_SQL + r"""
, bare AS (
  SELECT *, CASE namespace
    WHEN 'doi' THEN CASE WHEN regexp_matches(raw, '(?i)^https?://(dx\.)?doi\.org/') THEN CASE WHEN NOT regexp_matches(raw, '%([^0-9A-Fa-f]|.[^0-9A-Fa-f])') THEN replace(regexp_replace(raw, '(?i)^https?://(dx\.)?doi\.org/', ''), '%2F', '/') END
      WHEN raw LIKE 'doi:%' THEN trim(substr(raw, 5)) WHEN NOT contains(raw, '://') THEN trim(raw) END
    WHEN 'arxiv' THEN CASE WHEN starts_with(raw, 'https://arxiv.org/abs/') THEN substr(raw, 23) WHEN starts_with(lower(raw), 'arxiv:') THEN substr(raw, 7) WHEN NOT contains(raw, '://') THEN raw END
    ELSE upper(trim(raw)) END AS b
  FROM v
), out AS (
  SELECT k, namespace, raw, CASE
    WHEN namespace = 'doi' THEN CASE WHEN regexp_full_match(b, '10\.[0-9]{4,9}/[^\s?#]+') THEN translate(b, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END
    WHEN namespace = 'arxiv' THEN CASE
      WHEN regexp_full_match(b, '[0-9]{2}(0[1-9]|1[0-2])\.[0-9]{4}(v[1-9][0-9]*)?') AND left(b, 4) BETWEEN '0704' AND '1412' THEN left(b, 9)
      WHEN regexp_full_match(b, '[0-9]{2}(0[1-9]|1[0-2])\.[0-9]{5}(v[1-9][0-9]*)?') AND left(b, 4) >= '1501' THEN left(b, 10)
      WHEN regexp_full_match(b, '[a-z][A-Za-z0-9.-]*/[0-9]{2}(0[1-9]|1[0-2])[0-9]{3}(v[1-9][0-9]*)?') THEN regexp_extract(b, '^[^v]*') END
    WHEN namespace = 'pmid' THEN CASE WHEN regexp_full_match(b, '[0-9]{1,10}') AND NOT regexp_full_match(b, '0+') THEN ltrim(b, '0') END
    ELSE CASE WHEN regexp_full_match(b, 'PMC[0-9]{1,10}') AND NOT regexp_full_match(b, 'PMC0+') THEN 'PMC' || ltrim(substr(b, 4), '0') END END AS value, b
  FROM bare
)
SELECT k, namespace, raw, value, CASE WHEN namespace = 'arxiv' AND value IS NOT NULL THEN nullif(regexp_extract(b, 'v([1-9][0-9]*)$', 1), '') END AS version,
  CASE WHEN value IS NULL THEN 'invalid_identifier' END AS error
FROM out
""")
def identifier_normalize(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    part = lambda n, width: F.lpad((k % n).cast("string"), width, "0")
    rows = table(spark, folder, "orders").select(k.alias("k"), k.cast("string").alias("_k"), part(20, 2).alias("_y"), part(14, 2).alias("_m"), (1000 + k % 9000).cast("string").alias("_s"), (1000 + k % 90000).cast("string").alias("_t"))
    out = None
    for namespace, forms in FORMS.items():
        raw = F.get(F.array(*map(F.lit, forms)), (F.col("k") % len(forms)).cast("int"))
        for sign in "kymst":
            raw = F.replace(raw, F.lit(f"%{sign}"), F.col(f"_{sign}"))
        one = rows.select("k", F.lit(namespace).alias("namespace"), raw.alias("raw"))
        out = one if out is None else out.union(one)
    return out.withColumn("id", identifiers.normalized(F.col("namespace"), F.col("raw"))).select("k", "namespace", "raw", "id.*")


URLS = """SELECT page_id, CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN replace(url, 'http://', 'https://') WHEN 2 THEN 'https://localhost/' || page_id WHEN 3 THEN 'https://10.0.0.' || page_id % 200 || '/x'
  WHEN 4 THEN 'https://user@example.org/' WHEN 5 THEN 'https://example.org:443/a?b=' || page_id WHEN 6 THEN 'https://8.8.8.8:8443/' ELSE 'https://creativecommons.org/licenses/' || CASE page_id % 3 WHEN 0 THEN 'by' WHEN 1 THEN 'BY-NC-ND' ELSE 'other' END || '/4.0' END AS u
  FROM pages"""


@query(f"""
WITH p AS ({URLS})
SELECT page_id, regexp_full_match(u, 'https://[^/?#@:\\s]+(:(443)?)?([/?][^#]*)?#?') AND NOT regexp_matches(u, '^https://(localhost|10\\.)') AS safe,
  regexp_full_match(u, 'https://[^/?#@\\s]+([/?#]\\S*)?') AS digest_link,
  CASE WHEN contains(lower(u) || '/', '/licenses/by/') THEN 'cc-by' WHEN contains(lower(u) || '/', '/licenses/by-nc-nd/') THEN 'cc-by-nc-nd' ELSE 'unknown' END AS license
FROM p
""")
def safe_url(spark: SparkSession, folder: str) -> DataFrame:
    u = F.col("u")
    rows = table(spark, folder, "pages").selectExpr("page_id", URLS.split("SELECT page_id, ")[1].split(" FROM pages")[0].strip().removesuffix("FROM pages"))
    return rows.select("page_id", texts.safe_url(u).alias("safe"), texts.digest_url(u).alias("digest_link"), texts.license_class(u).alias("license"))


@query("""
WITH p AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE CAST(year(o_orderdate) AS INTEGER) END AS y, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey % 14 AS INTEGER) END AS m,
    CASE WHEN o_orderkey % 3 = 2 THEN CAST(o_orderkey % 33 AS INTEGER) END AS d FROM orders
), t AS (SELECT *, lpad(CAST(y AS VARCHAR), 4, '0') AS ys, lpad(CAST(m AS VARCHAR), 2, '0') AS ms, lpad(CAST(d AS VARCHAR), 2, '0') AS ds FROM p),
v AS (SELECT o_orderkey, CASE WHEN y < 1 THEN NULL WHEN m IS NULL AND d IS NULL THEN ys WHEN m NOT BETWEEN 1 AND 12 THEN NULL WHEN d IS NULL THEN ys || '-' || ms
  WHEN try_cast(ys || '-' || ms || '-' || ds AS DATE) IS NOT NULL THEN ys || '-' || ms || '-' || ds END AS value FROM t)
SELECT o_orderkey, value, CASE length(value) WHEN 4 THEN 'year' WHEN 7 THEN 'month' WHEN 10 THEN 'day' END AS precision FROM v
""")
def partial_dates(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    date = texts.partial_date(F.when(k % 13 == 0, 0).otherwise(F.year("o_orderdate")), F.when(k % 3 > 0, (k % 14).cast("int")), F.when(k % 3 == 2, (k % 33).cast("int")))
    return table(spark, folder, "orders").select("o_orderkey", date.alias("date")).select("o_orderkey", "date.*")


@query("""
WITH a AS (SELECT doc_id, doc_id % 50 AS start, CASE WHEN doc_id % 5 = 0 THEN 'zzz' ELSE substr(text, doc_id % 50 + 1, 20) END AS quote, CASE WHEN doc_id % 7 = 0 THEN -1 ELSE doc_id END AS snapshot_id FROM documents)
SELECT a.doc_id AS anchor_id, CASE WHEN d.doc_id IS NULL THEN 'no_snapshot' WHEN substr(text, start + 1, length(quote)) = quote THEN 'ok' ELSE 'mismatch' END AS status
FROM a LEFT JOIN documents d ON d.doc_id = snapshot_id
""")
def anchor_verify(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    start = (F.col("doc_id") % 50).cast("int")
    quote = F.when(F.col("doc_id") % 5 == 0, "zzz").otherwise(F.substring("text", start + 1, F.lit(20)))
    anchors = docs.select(F.col("doc_id").alias("anchor_id"), start.alias("start"), quote.alias("quote"), F.when(F.col("doc_id") % 7 == 0, -1).otherwise(F.col("doc_id")).alias("snapshot_id"))
    return evidence.anchors_checked(anchors, docs.select(F.col("doc_id").alias("snapshot_id"), "text")).select("anchor_id", "status")


@query("""
WITH s AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'abstract' ELSE 'full_text' END AS scope, doc_id % 3 = 0 AS complete,
  CASE WHEN doc_id % 5 = 0 THEN ['methods'] ELSE ['abstract'] END AS included, CASE doc_id % 7 WHEN 0 THEN ['appendix'] WHEN 1 THEN ['methods'] ELSE [] END AS missing FROM documents)
SELECT doc_id, CASE WHEN list_has_any(included, missing) OR (scope = 'abstract' AND (complete OR included <> ['abstract'])) OR (scope <> 'abstract' AND complete AND len(missing) > 0) THEN 'invalid'
  WHEN scope = 'abstract' THEN 'abstract_only' WHEN complete THEN 'full_text' ELSE 'selected_sections' END AS level FROM s
""")
def evidence_level(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("doc_id")
    one = lambda x: F.array(F.lit(x))
    missing = F.when(k % 7 == 0, one("appendix")).when(k % 7 == 1, one("methods")).otherwise(F.array().cast("array<string>"))
    level = evidence.coverage(F.when(k % 4 == 0, "abstract").otherwise("full_text"), k % 3 == 0, F.when(k % 5 == 0, one("methods")).otherwise(one("abstract")), missing)
    return table(spark, folder, "documents").select("doc_id", level.alias("level"))


NUMBERS = """list_filter(regexp_extract_all({0}, '(^|[^A-Za-z0-9_])([+-]?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?)', 2), lambda x: x <> '')"""


@query(f"""
WITH p AS (SELECT a.doc_id, {NUMBERS.format("a.text")} AS l, {NUMBERS.format("b.text")} AS r FROM documents a JOIN documents b ON b.doc_id = a.doc_id - a.doc_id % 3)
SELECT doc_id AS pair_id, CAST(len(l) AS INTEGER) AS n_numbers, list_sort(l) = list_sort(r) AS same_multiset,
  len(list_filter(l, lambda x: len(list_filter(l, lambda y: y = x)) > len(list_filter(r, lambda y: y = x)))) = 0 AS multiset_subset,
  len(list_filter(l, lambda x: NOT list_contains(r, x))) = 0 AS set_subset
FROM p
""")
def number_multiset_check(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    other = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("source"))
    pairs = docs.drop("source").join(other, F.col("_id") == F.col("doc_id") - F.col("doc_id") % 3).select(F.col("doc_id").alias("pair_id"), "text", "source")
    return evidence.number_findings(pairs)


@query("""
WITH q AS (SELECT doc_id, text, lang, doc_id % 2 = 0 AS direct FROM documents)
SELECT doc_id, CASE WHEN direct AND NOT regexp_matches(text, '(?i)(^|[^A-Za-z0-9])(with the|die und|le|por)([^A-Za-z0-9]|$)') THEN 'direct_evidence_missing' END AS error FROM q
""")
def lexical_gate(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "direct").otherwise("irrelevant").alias("decision"), F.array("text").alias("quotes"))
    return evidence.cites_phrase(rows, ["with the", "die und", "le", "por"]).select("doc_id", "error")


@query("""
WITH i AS (
  SELECT l_orderkey AS digest, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS position,
    CASE WHEN l_returnflag = 'R' THEN 'notice' ELSE 'paper' END AS item_kind, p_name || ' <' || l_returnflag || '> & "' || l_linestatus || '"' AS title
  FROM lineitem JOIN part ON p_partkey = l_partkey
), g AS (
  SELECT digest, count(*) AS n, count(*) FILTER (item_kind = 'notice') AS k, string_agg(CAST(position AS VARCHAR) || '. ' || title, chr(10) ORDER BY position) AS body,
    string_agg('<li>' || replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</li>', '' ORDER BY position) AS list
  FROM i GROUP BY digest
)
SELECT digest, CASE WHEN k = 0 THEN n || ' papers' WHEN k = n THEN k || ' notices' ELSE (n - k) || ' papers and ' || k || ' notices' END AS heading, body, '<ol>' || list || '</ol>' AS html FROM g
""")
def digest_render(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    rows = table(spark, folder, "lineitem").join(table(spark, folder, "part"), F.col("p_partkey") == F.col("l_partkey"))
    title = F.concat("p_name", F.lit(" <"), "l_returnflag", F.lit('> & "'), "l_linestatus", F.lit('"'))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    items = rows.select(F.col("l_orderkey").alias("digest"), place.alias("position"), F.when(F.col("l_returnflag") == "R", "notice").otherwise("paper").alias("item_kind"), title.alias("title"))
    return rendering.rendered(items, "digest")


@query("""
WITH e AS (SELECT event_id, CAST(event_id % 12 AS INTEGER) AS failures, (event_id % 5) / 4.0 AS jitter, CASE event_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 403 WHEN 4 THEN 404 END AS status FROM events)
SELECT event_id, greatest(1.0, CASE WHEN event_id % 7 = 0 THEN 30.0 ELSE 0.0 END, least(300.0, pow(2.0, least(failures + 1, 9))) * (0.5 + 0.5 * jitter))::DOUBLE AS delay,
  CASE WHEN status = 403 THEN 'stop' WHEN status = 429 OR status >= 500 OR ((status IS NULL OR status = 200) AND event_id % 4 = 0) THEN 'retry' WHEN status = 200 AND event_id % 4 <> 0 THEN 'accept' ELSE 'stop' END AS decision
FROM e
""")
def backoff_delay(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("event_id")
    status = F.get(F.array(*map(F.lit, [200, 429, 503, 403, 404, None])), (k % 6).cast("int"))
    delay = timing.backoff((k % 12).cast("int"), (k % 5) / F.lit(4.0), F.lit(1.0), F.when(k % 7 == 0, F.lit(30.0)))
    error = F.when(k % 4 == 0, "timeout")
    return table(spark, folder, "events").select("event_id", delay.alias("delay"), timing.decision(status, error, ["timeout"]).alias("decision"))


@query("""SELECT user_id, CAST(max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS latest, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1""")
def json_payload_extract(spark: SparkSession, folder: str) -> DataFrame:
    value = F.get_json_object("props", "$.k").cast("long")
    return table(spark, folder, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.max(value).alias("latest"), F.count("*").alias("n"))


@query("""SELECT o_orderkey, sha256(CAST(o_custkey AS VARCHAR) || chr(0) || o_orderstatus || chr(0) || 'paper' || chr(0)) AS id, CAST(round(o_totalprice * 100) AS BIGINT) * 10 AS micros FROM orders""")
def framed_ids(spark: SparkSession, folder: str) -> DataFrame:
    usd = F.format_string("%.5f", F.col("o_totalprice") / 1000)
    return table(spark, folder, "orders").select("o_orderkey", framed_sha256(F.col("o_custkey").cast("string"), F.col("o_orderstatus"), F.lit("paper")).alias("id"), texts.micros(usd).alias("micros"))


@query()
def canonical_json_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Hashes of both JSON forms; bytes of a Python serialiser, which SQL doesn't give."""
    raw = F.concat(F.lit('{ "status": "'), "o_orderstatus", F.lit('", "é": 1.50, "key": '), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 5 == 0, F.lit(', "key": 1}')).otherwise("}"))
    return table(spark, folder, "orders").select("o_orderkey", F.sha2(canonical_json_ascii(raw), 256).alias("ascii_hash"), F.sha2(canonical_json_utf8(raw), 256).alias("utf8_hash"))


@query("""
SELECT p_partkey, list_sort(list_intersect(string_split(p_type, ' '), ['PROMO', 'STEEL', 'BRUSHED', 'TIN', 'SMALL'])) AS shared, len(list_intersect(string_split(p_type, ' '), ['PROMO', 'STEEL', 'BRUSHED', 'TIN', 'SMALL'])) = 0 AS gap FROM part
""")
def source_intersection(spark: SparkSession, folder: str) -> DataFrame:
    """Sources of both a profile and a domain; where there are none, a gap."""
    both = F.array_sort(F.array_intersect(F.split("p_type", " "), F.array(*map(F.lit, ["PROMO", "STEEL", "BRUSHED", "TIN", "SMALL"]))))
    return table(spark, folder, "part").select("p_partkey", both.alias("shared"), (F.size(both) == 0).alias("gap"))

"""Searches of two more providers: their text, what is asked for page by page, and the fingerprints that tell requests apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import texts
from quillmark.functions.hashing import canonical_json_ascii

#: Where requests go, the version of the plan that is part of their fingerprints, and the bounds of its parts.
ARTICLE_SEARCH = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/esearch.fcgi?"
WORKS, WORKS_VERSION = "https://api.crossref.org/works", "crossref-rest-page-v1"
LONGEST_SEARCH, LONGEST_WINDOW = 16_000, 86_400
MOST_ARTICLES = 10_000


def encoded(value: Column) -> Column:
    """As part of a query string: blanks become +, and nothing but letters, digits and _.-~ stays as it is."""
    return F.replace(F.replace(F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")), F.lit("%20"), F.lit("+"))


def query_string(*parameters: tuple[str, Column]) -> Column:
    return F.concat_ws("&", *(F.concat(F.lit(f"{k}="), encoded(v)) for k, v in parameters))


def article_search(aliases: Column, include: Column, wanted: Column, exclude: Column, unwanted: Column, languages: Column) -> Column:
    """struct(search, error): any alias or included term of the domain, any term that the profile wants, none that either excludes, in any of the languages.

    Terms are unique and sorted. empty_discovery_scope without a term of the domain, query_too_large beyond 16,000 bytes.
    """
    unique = lambda *lists: F.array_sort(F.array_distinct(F.concat(*lists)))
    any_of = lambda xs, field: F.concat(F.lit("("), F.array_join(F.transform(xs, lambda x: F.concat(F.lit('"'), x, F.lit(f'"[{field}]'))), " OR "), F.lit(")"))
    then = lambda word, xs, field: F.when(F.size(xs) > 0, F.concat(F.lit(f" {word} "), any_of(xs, field))).otherwise("")
    scope = unique(aliases, include)
    search = F.concat(any_of(scope, "Title/Abstract"), then("AND", unique(wanted), "Title/Abstract"), then("NOT", unique(exclude, unwanted), "Title/Abstract"), then("AND", unique(languages), "Language"))
    error = F.when(F.size(scope) == 0, "empty_discovery_scope").when(F.octet_length(search) > LONGEST_SEARCH, "query_too_large")
    return F.struct(F.when(error.isNull(), search).alias("search"), error.alias("error"))


def article_requests(queries: DataFrame, tool: str, email: str, most: int = MOST_ARTICLES) -> DataFrame:
    """(query_id, start, size, url) for all pages of queries(query_id, search, from_day, until_day, page_size, total); the last day is not part of the window."""
    last = F.least(F.col("total"), F.lit(most)) - 1
    rows = queries.where(last >= 0).select("*", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"), F.col("page_size").cast("long"))).alias("start"))
    size = F.least(F.col("page_size").cast("long"), most - F.col("start"))
    day = lambda d: F.date_format(d, "yyyy/MM/dd")
    url = query_string(
        ("db", F.lit("pubmed")), ("term", F.col("search")), ("retmode", F.lit("json")), ("retstart", F.col("start").cast("string")), ("retmax", size.cast("string")), ("datetype", F.lit("crdt")),
        ("mindate", day(F.col("from_day"))), ("maxdate", day(F.date_sub("until_day", 1))), ("tool", F.lit(tool)), ("email", F.lit(email)),
    )
    return rows.select("query_id", "start", size.alias("size"), F.concat(F.lit(ARTICLE_SEARCH), url).alias("url"))


def works_plans(definitions: DataFrame) -> DataFrame:
    """definitions(binding_key, scope, from_index, until_index, email, config_version, rows) with filter, query_fingerprint, parameters_fingerprint and error.

    The window is in whole seconds, not empty and no longer than a day. The address of who asks is a parameter, but not part of what is asked for.
    """
    whole = lambda c: F.unix_micros(c) % 1_000_000 == 0
    seconds = (F.unix_micros("until_index") - F.unix_micros("from_index")) / 1e6
    fits = lambda c, n: texts.valid_text(F.col(c), n)
    error = (
        F.when(~fits("binding_key", 512), "invalid_crossref_binding")
        .when(~fits("scope", 4096), "invalid_crossref_scope")
        .when(~fits("config_version", 128), "invalid_crossref_config_version")
        .when(~fits("email", 254) | ~F.col("email").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+\z"), "invalid_crossref_contact")
        .when(~F.coalesce(F.col("rows").between(1, 1000), F.lit(False)), "invalid_crossref_rows")
        .when(F.col("from_index").isNull() | F.col("until_index").isNull(), "invalid_crossref_window")
        .when(~whole("from_index") | ~whole("until_index"), "unsupported_crossref_time_precision")
        .when((seconds <= 0) | (seconds > LONGEST_WINDOW), "invalid_crossref_window")
    )
    at = lambda c: F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    window = F.concat(F.lit("from-index-date:"), at("from_index"), F.lit(",until-index-date:"), at("until_index"))
    pair = lambda k, v: F.array(F.lit(k), v)
    asked = [pair("filter", window), pair("query.bibliographic", F.col("scope")), pair("rows", F.col("rows").cast("string"))]
    fingerprint = lambda value: F.sha2(canonical_json_ascii(F.to_json(value)), 256)
    query = F.struct(F.lit(WORKS_VERSION).alias("protocol_version"), F.lit(WORKS).alias("endpoint"), "binding_key", "config_version", F.array(*asked).alias("parameters"))
    fine = lambda c: F.when(F.col("error").isNull(), c)
    rows = definitions.withColumn("error", error)
    return rows.withColumns({"filter": fine(window), "query_fingerprint": fine(fingerprint(query)), "parameters_fingerprint": fine(fingerprint(F.array(asked[0], pair("mailto", F.col("email")), *asked[1:])))})


def works_requests(plans: DataFrame) -> DataFrame:
    """plans (of works_plans, with cursor) with url and request_fingerprint of the page at the cursor."""
    parameters = query_string(("filter", F.col("filter")), ("mailto", F.col("email")), ("query.bibliographic", F.col("scope")), ("rows", F.col("rows").cast("string")), ("cursor", F.col("cursor")))
    url = F.concat(F.lit(WORKS + "?"), parameters)
    request = F.struct(F.lit(WORKS_VERSION).alias("protocol_version"), "query_fingerprint", "parameters_fingerprint", F.lit("GET").alias("method"), url.alias("url"))
    fine = F.col("error").isNull() & texts.valid_text(F.col("cursor"), 65_536)
    return plans.select("*", F.when(fine, url).alias("url"), F.when(fine, F.sha2(canonical_json_ascii(F.to_json(request)), 256)).alias("request_fingerprint"))

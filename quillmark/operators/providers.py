"""Pages of a metadata provider decoded item by item: what is kept, what is set aside, and what an item's content is."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillmark.functions import texts, timing, values
from quillmark.functions.hashing import canonical_json_ascii
from quillmark.operators.rows import pinned

#: Keys of an item that make up its content.
SEMANTIC_KEYS = [
    "DOI", "abstract", "author", "container-title", "editor", "ISBN", "ISSN", "language", "license", "link", "published", "published-online",
    "published-print", "publisher", "relation", "resource", "short-container-title", "short-title", "subject", "subtitle", "title", "translator", "type", "update-to",
]
#: Errors that set an item aside; any other stops its page.
SET_ASIDE = ["crossref_provider_doi_invalid", "crossref_provider_item_mismatch", "invalid_crossref_provider_revision"]
LONGEST_CURSOR, LONGEST_DOI, MOST_BYTES, MOST_DEPTH, MOST_NODES = 65_536, 2048, 8_000_000, 64, 200_000


def decoded_pages(pages: DataFrame) -> DataFrame:
    """pages(page_id, body, cursor, rows, sha256, status) with error, next_cursor, total, end_hint and items (JSON of each, with its numbers as sent).

    Length, brackets and keys are checked before anything is taken out. A page with an error has none of the others. A page of fewer items than asked for (rows) is the last of its traversal; any
    other must say where it goes on, and not where it began.
    """
    own = ["page_id", "body", "cursor", "rows", "sha256", "status"]
    rows = pinned(pages, own, _problem=values.problem(F.col("body"), MOST_DEPTH, MOST_NODES))
    rows = pinned(rows, own, _v=F.when(F.col("_problem").isNull(), F.try_parse_json("body")))
    message = values.member(F.col("_v"), "message")
    items, cursor, total = (values.member(message, k) for k in ("items", "next-cursor", "total-results"))
    text = lambda v: F.when(values.kind(v) == "text", F.try_variant_get(v, "$", "string"))
    rows = pinned(rows, [*own, "_v"], _items=values.elements(items), _cursor=values.there(cursor), next_cursor=text(cursor), _total=values.there(total), total=F.when(values.kind(total) == "integer", F.try_variant_get(total, "$", "bigint")))
    rows = pinned(rows, [*own, "_v", "_cursor", "next_cursor", "_total", "total"], items=values.sent(F.col("_items"), F.col("body"), "message.items"))
    says = lambda k, what: F.coalesce(text(values.member(F.col("_v"), k)) == what, F.lit(False))
    wrong = (values.kind(F.col("_v")) != "object") | ~says("status", "ok") | ~says("message-type", "work-list") | F.col("items").isNull()
    bad_total = F.col("_total") & (F.col("total").isNull() | (F.col("total") < 0))
    last = F.size("items") < F.col("rows")
    error = (
        F.when(F.octet_length("body") > MOST_BYTES, "crossref_response_too_large")
        .when(~F.coalesce(F.sha2("body", 256) == F.col("sha256"), F.lit(False)), "crossref_response_hash_mismatch")
        .when(F.col("status") != 200, "crossref_http_not_successful")
        .when(F.col("_v").isNull(), "invalid_crossref_json")
        .when(wrong | (F.size("items") > F.col("rows")) | bad_total, "invalid_crossref_envelope")
        .when(F.col("_cursor") & ~texts.valid_text(F.col("next_cursor"), LONGEST_CURSOR), "invalid_crossref_cursor")
        .when(~last & ~F.col("_cursor"), "crossref_next_cursor_missing")
        .when(~last & ((F.col("next_cursor") == F.col("cursor")) | (F.col("next_cursor") == "*")), "crossref_cursor_no_progress")
    )
    rows = pinned(rows, ["page_id", "rows", "next_cursor", "total", "items"], error=error)
    fine = lambda c: F.when(F.col("error").isNull(), c)
    return rows.select("page_id", "error", fine(F.col("next_cursor")).alias("next_cursor"), fine(F.col("total")).alias("total"), fine(last).alias("end_hint"), fine(F.col("items")).alias("items"))


def decoded_items(decoded: DataFrame) -> DataFrame:
    """(page_id, ordinal, state, raw_doi, sha256, error) for each item of decoded pages; an item without a usable DOI is quarantined alone."""
    rows = decoded.select("page_id", F.posexplode("items").alias("ordinal", "_raw"))
    rows = pinned(rows, ["page_id", "ordinal", "_raw"], _doi=values.member(F.try_parse_json("_raw"), "DOI"))
    rows = rows.withColumn("raw_doi", F.when(values.kind(F.col("_doi")) == "text", F.try_variant_get("_doi", "$", "string"))).withColumn("sha256", F.sha2(canonical_json_ascii(F.col("_raw")), 256))
    error = F.when(~texts.valid_text(F.col("raw_doi"), LONGEST_DOI), "crossref_item_doi_field_invalid")
    return rows.select("page_id", "ordinal", F.when(error.isNull(), "decoded").otherwise("quarantined").alias("state"), "raw_doi", "sha256", error.alias("error"))


def first_title(item: Column) -> Column:
    """struct(title, warning) of an item's JSON: the first of its titles that is text and not blank, without blanks at its ends."""
    value = values.member(F.try_parse_json(item), "title")
    text = F.filter(F.transform(values.elements(value), lambda v: F.when(values.kind(v) == "text", texts.stripped(F.try_variant_get(v, "$", "string")))), lambda t: t.isNotNull() & (t != ""))
    title = F.get(text, F.lit(0))
    warning = F.when(~values.there(value), None).when(text.isNull(), "title_shape_invalid").when(title.isNull(), "title_missing_text")
    return F.struct(title.alias("title"), warning.alias("warning"))


def provider_instant(item: Column, key: str) -> Column:
    """struct(value, warning) of an item's `indexed`, `created` or `deposited`: its date-time in UTC."""
    value = values.member(F.try_parse_json(item), key)
    at = values.member(value, "date-time")
    text = F.when((values.kind(value) == "object") & (values.kind(at) == "text"), F.try_variant_get(at, "$", "string"))
    utc = timing.instant_text(text)
    warning = F.when(~values.there(value), None).when(text.isNull(), f"{key}_shape_invalid").when(utc.isNull(), f"{key}_time_invalid")
    return F.struct(utc.alias("value"), warning.alias("warning"))


def published(item: Column) -> Column:
    """struct(value, precision, warning) of an item's `published`: its date-parts, as far as they go."""
    value = values.member(F.try_parse_json(item), "published")
    own = values.elements(values.member(value, "date-parts"))
    parts = values.elements(F.get(own, F.lit(0)))
    shaped = (values.kind(value) == "object") & (F.size(own) == 1) & F.size(parts).between(1, 3) & F.forall(parts, lambda p: values.kind(p) == "integer")
    number = lambda n: F.try_variant_get(F.get(parts, F.lit(n)), "$", "bigint")
    date = texts.partial_date(number(0), number(1), number(2))
    there, shaped = values.there(value), F.coalesce(shaped, F.lit(False))
    warning = F.when(~there, None).when(~shaped, "published_shape_invalid").when(date["value"].isNull(), "published_date_invalid")
    fine = there & shaped
    return F.struct(F.when(fine, date["value"]).alias("value"), F.when(fine, date["precision"]).alias("precision"), warning.alias("warning"))


def provider_dates(items: DataFrame, item: str = "json") -> DataFrame:
    """items with indexed, created, deposited, published, published_precision, and warnings in that order, title's first: what a revision takes from an item."""
    dates = {k: provider_instant(F.col(item), k) for k in ("indexed", "created", "deposited")}
    title, out = first_title(F.col(item)), published(F.col(item))
    warnings = F.array_compact(F.array(title["warning"], *(d["warning"] for d in dates.values()), out["warning"]))
    return items.select("*", title["title"].alias("title"), *(d["value"].alias(k) for k, d in dates.items()), out["value"].alias("published"), out["precision"].alias("published_precision"), warnings.alias("warnings"))


@F.pandas_udf(StringType())
def semantic_json(items: pd.Series, dois: pd.Series) -> pd.Series:
    """The item's content in canonical JSON: the semantic keys alone, with the normalised DOI. Null for what is no object."""

    def one(text, doi):
        try:
            value = json.loads(text)
            own = {k: value[k] for k in SEMANTIC_KEYS if k in value} | {"DOI": doi}
            return json.dumps(own, ensure_ascii=True, sort_keys=True, separators=(",", ":"), allow_nan=False)
        except (ValueError, TypeError, RecursionError):
            return None

    return pd.Series([one(t, d) for t, d in zip(items, dois, strict=True)], dtype=object)


def semantic_sha256(item: Column, doi: Column) -> Column:
    return F.sha2(semantic_json(item, doi), 256)


def projected(items: DataFrame) -> DataFrame:
    """items(page_id, ordinal, error) with state: processed, quarantined (an error that sets just the item aside), failed (the first
    other error of its page) or pending (behind that)."""
    stops = F.col("error").isNotNull() & ~F.col("error").isin(SET_ASIDE)
    stop = F.min(F.when(stops, F.col("ordinal"))).over(Window.partitionBy("page_id"))
    state = F.when(F.col("ordinal") > stop, "pending").when(F.col("ordinal") == stop, "failed").when(F.col("error").isNotNull(), "quarantined").otherwise("processed")
    return items.withColumn("state", state)

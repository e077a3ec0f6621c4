"""Digests as text and as HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.texts import html_escape


def heading(items: Column, notices: Column) -> Column:
    """What a digest is headed by: its papers, its notices, or both."""
    return (
        F.when(items == 0, "Nothing new")
        .when(notices == 0, F.concat(items.cast("string"), F.lit(" papers")))
        .when(notices == items, F.concat(notices.cast("string"), F.lit(" notices")))
        .otherwise(F.concat((items - notices).cast("string"), F.lit(" papers and "), notices.cast("string"), F.lit(" notices")))
    )


def rendered(items: DataFrame, digest: str) -> DataFrame:
    """(digest, heading, body, html) of items(digest, position, item_kind, title): numbered lines in order, and the same as HTML."""
    number = F.concat(F.col("position").cast("string"), F.lit(". "))
    rows = items.select(
        digest, "position", "item_kind",
        F.concat(number, F.col("title")).alias("_line"),
        F.concat(F.lit("<li>"), html_escape(F.col("title")), F.lit("</li>")).alias("_li"),
    )
    line = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("position", c))), lambda x: x[c])
    out = rows.groupBy(digest).agg(F.count("*").alias("_n"), F.count_if(F.col("item_kind") == "notice").alias("_notices"), F.array_join(line("_line"), "\n").alias("body"), F.array_join(line("_li"), "").alias("_list"))
    return out.select(digest, heading(F.col("_n"), F.col("_notices")).alias("heading"), "body", F.concat(F.lit("<ol>"), F.col("_list"), F.lit("</ol>")).alias("html"))

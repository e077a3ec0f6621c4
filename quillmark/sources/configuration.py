"""Configuration documents: domains and profiles in one form, with a fingerprint, and digest artifacts in two versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOMAIN = "struct<id:string,name:string,aliases:array<string>,include:array<string>,exclude:array<string>,sources:array<string>>"
ARTIFACT = {
    1: "struct<version:int,items:array<struct<event_id:long,title:string>>>",
    2: "struct<version:int,items:array<struct<event_id:long,title:string,priority:int>>,notes:array<string>>",
}


def domains(documents: DataFrame) -> DataFrame:
    """A row for each domain of documents(document_id, json): lists sorted and without repeats, fingerprint, error.

    error: invalid_document, field_missing or duplicate_domain.
    """
    parsed = F.from_json("json", f"struct<domains:array<{DOMAIN}>>")
    rows = documents.select("document_id", F.explode_outer(parsed["domains"]).alias("d"))
    tidy = lambda c: F.array_sort(F.array_distinct(F.coalesce(F.col(f"d.{c}"), F.array().cast("array<string>"))))
    rows = rows.select("document_id", "d.id", "d.name", *(tidy(c).alias(c) for c in ("aliases", "include", "exclude", "sources")), F.col("d").isNull().alias("_none"))
    twice = F.count("*").over(_by("document_id", "id")) > 1
    error = F.when(F.col("_none"), "invalid_document").when((F.coalesce("id", F.lit("")) == "") | (F.coalesce("name", F.lit("")) == "") | (F.size("sources") == 0), "field_missing").when(twice, "duplicate_domain")
    canonical = F.to_json(F.struct("aliases", "exclude", "id", "include", "name", "sources"))
    return rows.select("document_id", "id", "name", "aliases", "include", "exclude", "sources", F.sha2(F.concat(F.lit("watch-config-v1:domain:"), canonical), 256).alias("fingerprint"), error.alias("error"))


def _by(*columns: str):
    from pyspark.sql import Window

    return Window.partitionBy(*columns)


def artifact(items: Column, notes: Column) -> Column:
    """A digest as the current version's JSON."""
    return F.to_json(F.struct(F.lit(2).alias("version"), items.alias("items"), notes.alias("notes")))


def read_artifact(body: Column) -> Column:
    """struct(version, items, notes) of either version; null for any other."""
    version = F.get_json_object(body, "$.version").cast("int")
    second = F.from_json(body, ARTIFACT[2])
    first = F.from_json(body, ARTIFACT[1])
    nothing = F.lit(None).cast("int")
    lifted = F.struct(first["version"].alias("version"), F.transform(first["items"], lambda x: F.struct(x["event_id"].alias("event_id"), x["title"].alias("title"), nothing.alias("priority"))).alias("items"), F.array().cast("array<string>").alias("notes"))
    return F.when(version == 2, second).when(version == 1, lifted)

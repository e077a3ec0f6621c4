"""Versions: numbering, changes from one to the next, and registers that keep the first of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LATE_AFTER = "INTERVAL 14 DAYS"


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in this order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def numbered(rows: DataFrame, key: str, content: str, seen: list[str]) -> DataFrame:
    """rows with revision: contents of a key are numbered as they first come; a content that returns keeps its number."""
    first = rows.groupBy(key, content).agg(F.min(F.struct(*seen)).alias("_first"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("_first"))
    return rows.join(first.select(key, content, number.alias("revision")), [key, content])


def changes(rows: DataFrame, key: str, order: list[str], content: str, metadata: str, status: str) -> DataFrame:
    """rows with content_changed, metadata_changed and status_changed against the one before; a changed content hides changed
    metadata, and a first revision has changed nothing."""
    before = Window.partitionBy(key).orderBy(*order)
    old = lambda c: F.lag(c).over(before)
    is_first = F.row_number().over(before) == 1
    changed = lambda c: ~is_first & ~old(c).eqNullSafe(F.col(c))
    out = rows.withColumns({"is_first": is_first, "content_changed": changed(content), "status_changed": changed(status), "_metadata": changed(metadata)})
    return out.withColumn("metadata_changed", F.col("_metadata") & ~F.col("content_changed")).drop("_metadata")


def event_kind(published: Column, observed: Column, version: Column) -> Column:
    """Kind of a first observation: late after 14 days, else by version; `error` if published after it was observed."""
    return (
        F.when(observed < published, "error")
        .when(observed - published > F.expr(LATE_AFTER), "late_discovery")
        .when(version.isNull() | (version == 1), "new_work")
        .otherwise("revision_available")
    )


def registered(rows: DataFrame, key: str, payload: list[str], observed: list[str]) -> DataFrame:
    """One row for each key, the first observed, with how many came and whether their payloads differ."""
    body = F.struct(*payload)
    return rows.groupBy(key).agg(
        F.min(F.struct(*observed, *payload)).alias("_first"), F.count("*").alias("n_seen"), (F.count_distinct(body) > 1).alias("conflict")
    ).select(key, *(F.col(f"_first.{c}").alias(c) for c in dict.fromkeys([*observed, *payload])), "n_seen", "conflict")


def published(log: DataFrame, key: str, fingerprint: str, order: list[str]) -> DataFrame:
    """A publish log with the revision each entry results in, and the pointer behind it.

    New content gets the pointer plus one and moves the pointer there; known content gives its own revision and moves nothing.
    """
    rows = numbered(log, key, fingerprint, order)
    return rows.withColumn("pointer", F.max("revision").over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def history(revisions: DataFrame, key: str, order: list[str], since: str) -> DataFrame:
    """revisions with place, from 1 for the oldest of each key, and until: when the next one came; null for the newest."""
    w = Window.partitionBy(key).orderBy(*order)
    return revisions.withColumn("place", F.row_number().over(w)).withColumn("until", F.lead(since).over(w))


def policy_versions(log: DataFrame, key: str, order: list[str], settings: list[str]) -> DataFrame:
    """A log of settings with policy_version: one more whenever a setting differs from the entry before."""
    w = Window.partitionBy(key).orderBy(*order)
    differs = F.lit(False)
    for s in settings:
        differs = differs | ~F.lag(s).over(w).eqNullSafe(F.col(s))
    step = F.when(F.row_number().over(w) == 1, 1).otherwise(differs.cast("int"))
    out = log.withColumn("_step", step)
    return out.withColumn("policy_version", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def as_of(probes: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """probes(probe_id, key, at) with the latest of facts(key, id, checked_at, expires_at) checked by then.

    status is current, expired (an older one is never used instead) or missing. Probes and facts of a key stand in one
    time line, and each probe looks back on it, so that nothing is paired.
    """
    line = facts.select(key, F.col("checked_at").alias("_at"), F.lit(0).alias("_probe"), F.struct("checked_at", "id", "expires_at").alias("_fact"), F.lit(None).cast(probes.schema["probe_id"].dataType).alias("probe_id"))
    line = line.unionByName(probes.select(key, F.col("at").alias("_at"), F.lit(1).alias("_probe"), F.lit(None).cast(line.schema["_fact"].dataType).alias("_fact"), "probe_id"))
    back = Window.partitionBy(key).orderBy("_at", "_probe", F.col("_fact.id")).rowsBetween(Window.unboundedPreceding, 0)
    found = line.withColumn("_found", F.last("_fact", ignorenulls=True).over(back)).where("_probe = 1")
    status = F.when(F.col("_found").isNull(), "missing").when(F.col("_found.expires_at") <= F.col("_at"), "expired").otherwise("current")
    return found.select("probe_id", key, F.col("_found.id").alias("fact_id"), status.alias("status"))

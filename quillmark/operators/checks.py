"""Constraints that tables of the engine have to meet, as queries for the rows that break them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(rows: DataFrame, name: str, *keys: str) -> DataFrame:
    """(rule, n): keys that come more than once."""
    twice = rows.groupBy(*keys).count().where("count > 1")
    return twice.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")


def dangling(rows: DataFrame, parents: DataFrame, name: str, key: str, parent_key: str) -> DataFrame:
    """(rule, n): rows whose key is no parent's; null keys are allowed."""
    left = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"))
    out = left.join(parents.select(F.col(parent_key).alias("_key")), "_key", "left_anti")
    return out.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")


def broken(rows: DataFrame, name: str, condition: Column) -> DataFrame:
    """(rule, n): rows that don't meet the condition; null counts as met."""
    return rows.agg(F.count_if(~F.coalesce(condition, F.lit(True))).alias("n")).select(F.lit(name).alias("rule"), "n")

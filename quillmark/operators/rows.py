"""Columns that are costly to compute and used more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pinned(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """df's columns to keep, and new ones that are computed once for a row, however often they are used later: nothing is merged across a generator."""
    return df.select(*keep, F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))

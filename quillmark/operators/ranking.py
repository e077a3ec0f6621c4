"""Places in an order over all rows, without all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def placed(rows: DataFrame, name: str, parts: list[tuple[Column, bool]], *order: Column) -> DataFrame:
    """rows with their place from 1 in an order that goes by the parts first, then by `order` inside each.

    parts: (expression, descending) that coarsen the order, such as a priority or a day. Rows are counted by part, the few
    counts are summed up in order, and only rows of a part are sorted together.
    """
    names = [f"_part{n}" for n in range(len(parts))]
    rows = rows.withColumns({n: c for n, (c, _) in zip(names, parts, strict=True)})
    by_part = [F.desc(n) if descending else F.asc(n) for n, (_, descending) in zip(names, parts, strict=True)]
    counts = rows.groupBy(*names).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy(*by_part).rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*(F.col(n).alias(f"{n}_of") for n in names), F.coalesce(before, F.lit(0)).alias("_before"))
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}_of"))
    inside = F.row_number().over(Window.partitionBy(*names).orderBy(*order))
    return rows.withColumn("_inside", inside).join(counts, same).withColumn(name, (F.col("_before") + F.col("_inside")).cast("int")).drop("_inside", "_before", *names, *(f"{n}_of" for n in names))

"""Lists of ids in JSON, and what a storage holds against its register."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_page(body: Column) -> Column:
    """struct(ids, total, error) of an id search in JSON: ids are positive, none comes twice, and no more than the total."""
    ids = F.from_json(F.get_json_object(body, "$.esearchresult.idlist"), "array<string>")
    total = F.get_json_object(body, "$.esearchresult.count").try_cast("long")
    error = (
        F.when(ids.isNull() | total.isNull(), "invalid_page")
        .when(~F.forall(ids, lambda x: x.rlike("^[1-9][0-9]*$")), "invalid_id")
        .when(F.size(F.array_distinct(ids)) < F.size(ids), "duplicate_id")
        .when(F.size(ids) > total, "count_mismatch")
    )
    return F.struct(ids.alias("ids"), total.alias("total"), error.alias("error"))


def returned_as_asked(asked: Column, returned: Column) -> Column:
    """Whether two lists of ids are the same set."""
    return (F.size(F.array_except(asked, returned)) == 0) & (F.size(F.array_except(returned, asked)) == 0)


def storage_problems(registry: DataFrame, files: DataFrame) -> DataFrame:
    """(path, code) of registry(path, sha256, state) against files(path, sha256): what is missing, changed or not available, and
    what nobody registered."""
    both = registry.withColumn("_known", F.lit(True)).join(files.select("path", F.col("sha256").alias("_found"), F.lit(True).alias("_there")), "path", "full_outer")
    code = (
        F.when(F.col("_known").isNull(), F.when(F.col("path").endswith(".tmp"), "temporary").otherwise("unregistered"))
        .when(F.col("state") != "available", "not_available")
        .when(F.col("_there").isNull(), "missing")
        .when(F.col("_found") != F.col("sha256"), "changed")
    )
    return both.select("path", code.alias("code")).where("code is not null")

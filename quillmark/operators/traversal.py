"""Harvest windows: accounting of passes, watermarks over windows in a row, splits, and failures in a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.aliases import closure


def accounting(items: DataFrame, quarantined: DataFrame) -> DataFrame:
    """A row for each pass of items(pass_id, page_no, ordinal, doi, decoded, reported_total, end_hint).

    quarantined(pass_id, page_no, ordinal) is held against decoded items. Duplicates are processed items without a DOI of
    their own. The total drifts if pages report several, or at the end another than came. A pass that ended is provisional,
    or needs a repair if its total drifted or anything is quarantined.
    """
    q = quarantined.select("pass_id", "page_no", "ordinal").distinct().withColumn("_held", F.lit(1))
    rows = items.join(q, ["pass_id", "page_no", "ordinal"], "left")
    processed = F.col("decoded") & F.col("_held").isNull()
    out = rows.groupBy("pass_id").agg(
        F.count("*").alias("raw"),
        F.count_if(processed).alias("processed"),
        F.count_if(F.col("_held").isNotNull()).alias("quarantined"),
        F.count_distinct(F.when(processed, F.col("doi"))).alias("unique_dois"),
        (F.min("reported_total") != F.max("reported_total")).alias("_several"),
        F.min_by("reported_total", F.struct("page_no", "ordinal", "reported_total")).alias("first_total"),
        F.bool_or("end_hint").alias("ended"),
    )
    drift = F.coalesce("_several", F.lit(False)) | (F.col("ended") & F.coalesce(F.col("raw") != F.col("first_total"), F.lit(False)))
    repair = F.col("ended") & (F.col("drift") | (F.col("quarantined") > 0))
    out = out.withColumn("duplicates", F.col("processed") - F.col("unique_dois")).withColumn("drift", drift).drop("_several")
    state = F.when(~F.col("ended"), "running").when(repair, "repair_pending").otherwise("traversed")
    return out.withColumn("window_state", state).withColumn("completeness", F.when(F.col("ended") & ~repair, "provisional").otherwise("unknown"))


def leaves(windows: DataFrame, splits: DataFrame) -> DataFrame:
    """windows(window_id) that are no parent of splits(parent_id)."""
    return windows.join(splits.select(F.col("parent_id").alias("window_id")), "window_id", "left_anti")


def split_violations(windows: DataFrame, splits: DataFrame) -> DataFrame:
    """(parent_id, reason): splits whose two windows don't tile the parent's exactly."""
    w = windows.select("window_id", "from_at", "until_at")
    side = lambda s: w.select(F.col("window_id").alias(f"{s}_id"), F.col("from_at").alias(f"{s}_from"), F.col("until_at").alias(f"{s}_until"))
    joined = splits
    for s in ("parent", "left", "right"):
        joined = joined.join(side(s), f"{s}_id", "left")
    reason = (
        F.when(F.col("parent_from").isNull() | F.col("left_from").isNull() | F.col("right_from").isNull(), "window_missing")
        .when(F.col("left_from") != F.col("parent_from"), "left_start")
        .when(F.col("right_until") != F.col("parent_until"), "right_end")
        .when(F.col("left_until") != F.col("right_from"), "gap_between")
    )
    return joined.withColumn("reason", reason).where("reason is not null").select("parent_id", "reason")


def split_tree(windows: DataFrame, splits: DataFrame, most_depth: int = 32) -> DataFrame:
    """(window_id, root_id, depth, leaf, reason) of windows(window_id, from_at, until_at) and splits(parent_id, left_id, right_id).

    reason: two_parents, or split_twice, where a window is more than a leaf was; too_deep beyond most_depth, or where splits go round in a
    circle (root and depth are null then); a reason of split_violations for a parent; leaves_do_not_tile for a root whose leaves, in order, leave a gap or
    overlap. Depths come from looking twice as far in each round, so 32 take five joins.
    """
    child = lambda c: splits.select(F.col(c).alias("alias_id"), F.col("parent_id").alias("canonical_id"))
    up = child("left_id").union(child("right_id"))
    parents = up.groupBy("alias_id").agg(F.min("canonical_id").alias("canonical_id"), F.count("*").alias("n_parents"))
    ends = closure(parents.select("alias_id", "canonical_id"), most_depth).select(F.col("alias_id").alias("window_id"), F.col("canonical_id").alias("root_id"), F.col("hops").alias("depth"), F.lit(True).alias("_child"))
    n_splits = splits.groupBy(F.col("parent_id").alias("window_id")).agg(F.count("*").alias("n_splits"))
    rows = windows.join(ends, "window_id", "left").join(parents.select(F.col("alias_id").alias("window_id"), "n_parents"), "window_id", "left").join(n_splits, "window_id", "left")
    top = F.col("_child").isNull()
    rows = rows.select("window_id", "from_at", "until_at", F.when(top, F.col("window_id")).otherwise(F.col("root_id")).alias("root_id"), F.when(top, 0).otherwise(F.col("depth")).alias("depth"), F.col("n_splits").isNull().alias("leaf"), "n_parents", "n_splits")
    leaves_ = Window.partitionBy("root_id").orderBy("from_at", "until_at")
    cover = rows.where("leaf and root_id is not null").withColumn("_before", F.lag("until_at").over(leaves_)).groupBy("root_id").agg(
        F.min("from_at").alias("_from"), F.max("until_at").alias("_until"), F.bool_and(F.col("_before").isNull() | (F.col("_before") == F.col("from_at"))).alias("_joined"))
    uneven = split_violations(windows, splits).groupBy(F.col("parent_id").alias("window_id")).agg(F.min("reason").alias("uneven"))
    rows = rows.join(uneven, "window_id", "left").join(cover.withColumnRenamed("root_id", "window_id"), "window_id", "left")
    tiled = F.col("_joined") & (F.col("_from") == F.col("from_at")) & (F.col("_until") == F.col("until_at"))
    reason = (
        F.when(F.col("n_parents") > 1, "two_parents")
        .when(F.col("n_splits") > 1, "split_twice")
        .when(F.col("root_id").isNull(), "too_deep")
        .when(F.col("uneven").isNotNull(), F.col("uneven"))
        .when((F.col("root_id") == F.col("window_id")) & ~F.coalesce(tiled, F.lit(False)), "leaves_do_not_tile")
    )
    return rows.select("window_id", "root_id", "depth", "leaf", reason.alias("reason"))


def watermarks(windows: DataFrame, stream: str = "stream") -> DataFrame:
    """(stream, watermark, n_windows): how far windows(stream, from_at, until_at, finalised) are finalised without a gap.

    The first window anchors the row; one that isn't finalised, or doesn't begin where the one before ended, stops it.
    """
    w = Window.partitionBy(stream).orderBy("from_at", "until_at")
    gap = F.lag("until_at").over(w) != F.col("from_at")
    bad = (~F.col("finalised") | F.coalesce(gap, F.lit(False))).cast("int")
    rows = windows.withColumn("_bad", bad).withColumn("_stopped", F.max("_bad").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    good = F.when(F.col("_stopped") == 0, F.col("until_at"))
    return rows.groupBy(stream).agg(F.max(good).alias("watermark"), F.count(good).alias("n_windows"))


def trailing_failures(attempts: DataFrame, key: str, *newest_first: Column) -> DataFrame:
    """(key, n_failures): failed attempts from the newest back to the first that didn't fail."""
    w = Window.partitionBy(key).orderBy(*newest_first).rowsBetween(Window.unboundedPreceding, 0)
    rows = attempts.withColumn("_ok", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(w))
    return rows.groupBy(key).agg(F.count_if(F.col("_ok") == 0).alias("n_failures"))


def cursor_checks(pages: DataFrame) -> DataFrame:
    """pages(pass_id, page_no, cursor_in, cursor_out, end_hint) with status: ok, broken (doesn't follow the page before), cycle
    (a cursor that came before) or after_end."""
    w = Window.partitionBy("pass_id").orderBy("page_no")
    came = F.row_number().over(Window.partitionBy("pass_id", "cursor_in").orderBy("page_no"))
    ended = F.max(F.col("end_hint").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    status = (
        F.when(F.coalesce(ended, F.lit(0)) == 1, "after_end")
        .when((F.row_number().over(w) > 1) & ~F.lag("cursor_out").over(w).eqNullSafe(F.col("cursor_in")), "broken")
        .when(came > 1, "cycle")
        .otherwise("ok")
    )
    return pages.withColumn("status", status)


def offset_decision(start: Column, items: Column, total: Column, expected: Column, page_size: Column) -> Column:
    """What follows a page of an offset traversal."""
    return (
        F.when(expected.isNotNull() & (total != expected), "total_changed")
        .when((total == 0) & (items == 0), "verified_empty")
        .when(start + items > total, "too_many")
        .when(items < F.least(page_size, total - start), "incomplete_page")
        .when(start + items == total, "last")
        .otherwise("next")
    )


def unit_result(state: Column, version: Column, decision: Column, start: Column, items: Column, error: Column) -> Column:
    """struct(error, state, version, next_start) of a unit after a page: an offset decision, or an error of its processing.

    A page that was read moves the checkpoint on by one; one that wasn't leaves it, and the unit is partial if it ever had one.
    Units that are closed take no page.
    """
    closed = state.isin("succeeded", "verified_empty", "unavailable")
    wrong = F.when(closed, "unit_not_open").when(error.isNull() & ~decision.isin("verified_empty", "last", "next"), decision)
    failed = error.isNotNull()
    after = F.when(failed, F.when(version > 0, "partial").otherwise("failed")).when(decision == "verified_empty", "verified_empty").when(decision == "last", "succeeded").otherwise("partial")
    return F.struct(
        F.coalesce(wrong, error).alias("error"),
        F.when(wrong.isNotNull(), state).otherwise(after).alias("state"),
        F.when(wrong.isNotNull() | failed, version).otherwise(version + 1).alias("version"),
        F.when(wrong.isNotNull() | failed, start).otherwise(start + items).alias("next_start"),
    )


def published(found: DataFrame, before: DataFrame, now: Column, lag_seconds: int) -> DataFrame:
    """(stream, watermark, error) of found(stream, watermark) and those published before: a watermark never moves back, and none
    is published inside the safety lag."""
    rows = found.join(before.select("stream", F.col("watermark").alias("_before")), "stream", "full_outer")
    fresh = F.unix_micros("watermark") > F.unix_micros(now) - lag_seconds * 1_000_000
    error = F.when(fresh, "window_inside_safety_lag").when(F.col("watermark") < F.col("_before"), "watermark_moved_back")
    rows = rows.withColumn("error", error)
    return rows.select("stream", F.when(F.col("error").isNull(), F.coalesce("watermark", "_before")).otherwise(F.col("_before")).alias("watermark"), "error")


def seen_before(pages: DataFrame) -> DataFrame:
    """(traversal, page_no, repeated) of pages(traversal, page_no, ids): how many of a page's ids an earlier page had already."""
    each = pages.select("traversal", "page_no", F.explode(F.array_distinct("ids")).alias("id"))
    first = F.min("page_no").over(Window.partitionBy("traversal", "id"))
    counts = each.withColumn("_first", first).groupBy("traversal", "page_no").agg(F.count_if(F.col("page_no") > F.col("_first")).alias("repeated"))
    return pages.select("traversal", "page_no").join(counts, ["traversal", "page_no"], "left").select("traversal", "page_no", F.coalesce("repeated", F.lit(0).cast("long")).alias("repeated"))

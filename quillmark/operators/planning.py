"""What a scheduler does next: harvest windows, repairs, digests that wait, and requests of providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.timing import window_end
from quillmark.operators import ranking

SOURCES = ("arxiv", "pubmed", "crossref")


def plan(bindings: DataFrame, active: DataFrame, now: Column) -> DataFrame:
    """(binding, outcome, until_at, place) of bindings(binding, source, last_end) and active(binding, state) jobs.

    outcome: unsupported, failed, awaiting (both gaps), running, wait (no whole day since last_end yet) or harvest, with the
    end of the next window: a day after the last, or the source's boundary for a first one. place orders the harvests: those
    that never ran, then the oldest.
    """
    rows = bindings.join(active.select("binding", "state"), "binding", "left")
    boundary = window_end(F.col("source"), now)
    next_end = F.when(F.col("last_end").isNull(), boundary).otherwise(F.col("last_end") + F.expr("INTERVAL 1 DAY"))
    outcome = (
        F.when(~F.col("source").isin(*SOURCES), "unsupported")
        .when(F.col("state") == "failed", "failed")
        .when(F.col("state") == "awaiting_external", "awaiting")
        .when(F.col("state").isNotNull(), "running")
        .when(next_end <= boundary, "harvest")
        .otherwise("wait")
    )
    rows = rows.withColumn("outcome", outcome).withColumn("until_at", F.when(F.col("outcome") == "harvest", next_end))
    due = ranking.placed(rows.where("outcome = 'harvest'"), "place", [(F.date_trunc("day", "last_end"), False)], F.asc_nulls_first("last_end"), F.col("binding"))
    others = rows.where("outcome <> 'harvest'").withColumn("place", F.lit(None).cast("int"))
    return due.unionByName(others).select("binding", "outcome", "until_at", "place")


def digests_blocked(cases: DataFrame, planned: DataFrame, explanations: DataFrame, key: str) -> DataFrame:
    """cases(key) with blocked: whether digests of a case wait because something of it is harvested (planned(key, outcome)) or explained (explanations(key, state))."""
    busy = planned.where(F.col("outcome").isin("running", "harvest")).select(key)
    open_ = explanations.where(F.col("state").isin("pending", "running")).select(key)
    waits = busy.union(open_).distinct().withColumn("blocked", F.lit(True))
    return cases.join(waits, key, "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))


def repairs(windows: DataFrame, lookback: int, cutoff: Column, most: int) -> DataFrame:
    """(window_id, reason, place): windows(window_id, stream, state, until_at, finalised_at, running) to repair next in each stream.

    Those that await repair come first; of the last `lookback` finalised ones those not finalised since the cutoff follow.
    Newest first, no more than `most`; none whose repair runs.
    """
    recent = F.row_number().over(Window.partitionBy("stream", F.col("finalised_at").isNotNull()).orderBy(F.desc("until_at"), "window_id"))
    rows = windows.withColumn("_recent", recent)
    periodic = F.col("finalised_at").isNotNull() & (F.col("_recent") <= lookback) & (F.col("finalised_at") <= cutoff)
    rows = rows.where(~F.col("running")).withColumn("reason", F.when(F.col("state") == "repair_pending", "repair_pending").when(periodic, "periodic_recent_window"))
    order = Window.partitionBy("stream").orderBy(F.when(F.col("reason") == "repair_pending", 0).otherwise(1), F.desc("until_at"), "window_id")
    return rows.where("reason is not null").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("stream", "window_id", "reason", "place")


def retry_stop(capture: Column, finished: Column, now: Column, retry_failed: Column) -> Column:
    """Why an attempt isn't made again, by its capture's JSON; null if it may be."""
    get = lambda k: F.get_json_object(capture, f"$.{k}")
    wait = F.coalesce(get("retry_after_seconds").cast("double"), F.lit(0.0))
    return (
        F.when(get("retryable").isNull(), "invalid_retry_metadata")
        .when(get("failure_code").isNull(), "processing_failed")
        .when(get("retryable") != "true", "source_failed")
        .when(~retry_failed, "retry_required")
        .when(F.unix_micros(now) < F.unix_micros(finished) + (wait * 1_000_000).cast("long"), "cooldown")
    )


def search(categories: Column, terms: Column, include: Column, exclude: Column, start: Column, end: Column) -> Column:
    """A search text: any category or term, all of the profile's, none of the excluded, in a window of minutes. Null without scope."""
    quoted = lambda xs: F.concat(F.lit("("), F.array_join(F.transform(xs, lambda x: F.concat(F.lit('ti:"'), x, F.lit('" OR abs:"'), x, F.lit('"'))), " OR "), F.lit(")"))
    some = lambda xs, text: F.when(F.size(xs) > 0, text)
    terms, exclude = F.array_sort(F.array_distinct(terms)), F.array_sort(F.array_distinct(exclude))
    by_category = some(categories, F.concat(F.lit("("), F.array_join(F.transform(categories, lambda c: F.concat(F.lit("cat:"), c)), " OR "), F.lit(")")))
    scope = F.array_compact(F.array(by_category, some(terms, quoted(terms))))
    minute = lambda t: F.date_format(t, "yyyyMMddHHmm")
    return F.when(
        F.size(scope) > 0,
        F.concat(
            F.lit("("), F.array_join(scope, " OR "), F.lit(")"),
            F.coalesce(some(include, F.concat(F.lit(" AND "), quoted(include))), F.lit("")),
            F.coalesce(some(exclude, F.concat(F.lit(" ANDNOT "), quoted(exclude))), F.lit("")),
            F.lit(" AND submittedDate:["), minute(start), F.lit(" TO "), minute(end), F.lit("]"),
        ),
    )


def deferred(languages: Column, free_only: Column, allow_preprints: Column, scope_text: Column) -> Column:
    """The filters that a provider can't apply, with the stage that has to."""
    one = lambda needed, name, stage: F.when(needed, F.struct(F.lit(name).alias("name"), F.lit(stage).alias("stage")))
    return F.array_compact(F.array(one(F.size(languages) > 0, "languages", "relevance"), one(free_only, "free_only", "access"), one(~allow_preprints, "allow_preprints", "publication_status"), one(scope_text != "", "scope_text", "relevance")))


def page_requests(queries: DataFrame, most: int) -> DataFrame:
    """(query_id, start, size, url) for all pages of queries(query_id, search, page_size, total), no further than `most` records."""
    last = F.least(F.col("total"), F.lit(most)) - 1
    rows = queries.where(last >= 0).select("*", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"), F.col("page_size").cast("long"))).alias("start"))
    size = F.least(F.col("page_size").cast("long"), most - F.col("start"))
    plus = F.replace(F.url_encode("search"), F.lit("%20"), F.lit("+"))
    url = F.concat(F.lit("https://export.arxiv.org/api/query?search_query="), plus, F.lit("&start="), F.col("start").cast("string"), F.lit("&max_results="), size.cast("string"), F.lit("&sortBy=submittedDate&sortOrder=ascending"))
    return rows.select("query_id", "start", size.alias("size"), url.alias("url"), F.sha2(url, 256).alias("fingerprint"))


def batches_complete(pages: DataFrame, batches: DataFrame) -> DataFrame:
    """(page_id, state) of pages(page_id, ids) and batches(page_id, batch_no, ids): verified_empty, succeeded when the batches
    in order are the page's ids, partial while they are its beginning, else mismatch."""
    own = batches.groupBy("page_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("batch_no", "ids"))), lambda b: b["ids"])).alias("_got"))
    rows = pages.join(own, "page_id", "left").withColumn("_got", F.coalesce("_got", F.slice("ids", 1, 0)))
    state = (
        F.when((F.size("ids") == 0) & (F.size("_got") == 0), "verified_empty")
        .when(F.col("ids") == F.col("_got"), "succeeded")
        .when((F.size("_got") < F.size("ids")) & (F.slice("ids", F.lit(1), F.size("_got")) == F.col("_got")), "partial")
        .otherwise("mismatch")
    )
    return rows.select("page_id", state.alias("state"), F.size("_got").alias("n_received"))

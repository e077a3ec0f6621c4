"""The digest of a period: which events a reader gets, once each and in which order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.ranking import placed

NOTICES = ("correction", "retraction")
NOTICE_PRIORITY, DIRECT_PRIORITY, ADJACENT_PRIORITY = 100, 20, 10


def in_period(events: DataFrame, start: Column, cutoff: Column, kinds: Iterable[str]) -> DataFrame:
    """Events of these kinds observed after start and up to the cutoff."""
    at = F.col("observed_at")
    return events.where((at > start) & (at <= cutoff) & F.col("event_kind").isin(list(kinds)))


def latest_per_work(events: DataFrame) -> DataFrame:
    """Of paper events the latest of each work (ties by the greater id); all notices."""
    newest = Window.partitionBy("work_id", F.col("event_kind").isin(*NOTICES)).orderBy(F.desc("observed_at"), F.desc("event_id"))
    kept = events.withColumn("_n", F.row_number().over(newest))
    return kept.where((F.col("_n") == 1) | F.col("event_kind").isin(*NOTICES)).drop("_n")


def not_notified(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """Events that the ledger(event_id) doesn't hold yet."""
    return events.join(ledger.select("event_id"), "event_id", "left_anti")


def strongest_decisions(relevance: DataFrame) -> DataFrame:
    """(work_id, domain_id, strength) of relevance(work_id, domain_id, decision): 2 if any is direct, 1 if any is adjacent."""
    rank = F.when(F.col("decision") == "direct", 2).when(F.col("decision") == "adjacent", 1)
    return relevance.where(rank.isNotNull()).groupBy("work_id", "domain_id").agg(F.max(rank).alias("strength"))


def work_relevance(relevance: DataFrame) -> DataFrame:
    """(work_id, domains, priority): all relevant domains in order, and the priority of the strongest."""
    by_work = strongest_decisions(relevance).groupBy("work_id")
    domains = F.concat_ws(",", F.array_sort(F.collect_set("domain_id")))
    return by_work.agg(domains.alias("domains"), F.when(F.max("strength") == 2, DIRECT_PRIORITY).otherwise(ADJACENT_PRIORITY).alias("priority"))


def select(events: DataFrame, ledger: DataFrame, prior: DataFrame, summaries: DataFrame, relevance: DataFrame) -> DataFrame:
    """The digest of events that are already those of its period.

    events(event_id, work_id, event_kind, observed_at, title); ledger(event_id) of what was notified; prior(work_id) of works
    the reader has been told of; summaries(work_id) with a current summary; relevance(work_id, domain_id, decision).
    A work's latest event counts, and hides older ones even if it was notified. Papers need a summary and a relevant domain,
    notices a prior recipient. There is no limit. Position: priority, then newest, then id.
    """
    fresh = not_notified(latest_per_work(events), ledger)
    is_notice = F.col("event_kind").isin(*NOTICES)
    notices = fresh.where(is_notice).join(prior.select("work_id").distinct(), "work_id", "left_semi")
    notices = notices.withColumns({"item_kind": F.lit("notice"), "domains": F.lit(""), "priority": F.lit(NOTICE_PRIORITY)})
    papers = fresh.where(~is_notice).join(summaries.select("work_id").distinct(), "work_id", "left_semi")
    papers = papers.join(work_relevance(relevance), "work_id").withColumn("item_kind", F.lit("paper"))
    both = papers.unionByName(notices)
    hour = F.date_trunc("hour", "observed_at")
    ranked = placed(both, "position", [(F.col("priority"), True), (hour, True)], F.desc("observed_at"), F.asc("event_id"))
    return ranked.select(
        "position", "event_id", "work_id", "item_kind", "event_kind", "observed_at", "priority", "domains", "title"
    )


def first_url(manifestations: DataFrame) -> DataFrame:
    """(work_id, url): the url that came first, by (created_at, id), among those there are."""
    order = F.struct("created_at", "id")
    return manifestations.where("url is not null").groupBy("work_id").agg(F.min_by("url", order).alias("url"))

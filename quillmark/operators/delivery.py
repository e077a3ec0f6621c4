"""Deliveries: who may be told what, what is queued once, and what a stored observation still gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCOPES = ("abstract", "full_text", "metadata")
READABLE = ("application/pdf", "text/html", "application/xhtml+xml")


def active_bindings(profiles: DataFrame, revisions: DataFrame, chosen: DataFrame, domains: DataFrame) -> DataFrame:
    """(profile_id, domain_id, source, gap): active profiles at their published revision with the domains of that revision.

    A row for each source of both; a gap row where they have none in common. chosen binds (profile_id, revision) to
    (domain_id, domain_revision).
    """
    live = profiles.where((F.col("lifecycle") == "active") & F.col("published_revision").isNotNull()).select("profile_id", F.col("published_revision").alias("revision"))
    rows = live.join(revisions.select("profile_id", "revision", F.col("sources").alias("_p")), ["profile_id", "revision"])
    rows = rows.join(chosen, ["profile_id", "revision"]).join(domains.select("domain_id", "domain_revision", F.col("sources").alias("_d")), ["domain_id", "domain_revision"])
    both = F.array_sort(F.array_intersect("_p", "_d"))
    return rows.select("profile_id", "domain_id", F.explode_outer(F.when(F.size(both) > 0, both)).alias("source")).withColumn("gap", F.col("source").isNull())


def guarded_summaries(events: DataFrame, pointers: DataFrame, summaries: DataFrame, language: str) -> DataFrame:
    """events(event_id, work_id, revision_id) with the current summary and why there is none.

    A pointer(work_id, language, summary_id, revision_id, fingerprint) must be of the event's revision, and its summary(summary_id,
    revision_id, fingerprint, qa_state) of the same revision and fingerprint, and passed.
    """
    p = pointers.where(F.col("language") == language).select("work_id", "summary_id", F.col("revision_id").alias("_pr"), F.col("fingerprint").alias("_pf"))
    s = summaries.select("summary_id", F.col("revision_id").alias("_sr"), F.col("fingerprint").alias("_sf"), "qa_state")
    rows = events.join(p, "work_id", "left").join(s, "summary_id", "left")
    guard = (
        F.when(F.col("summary_id").isNull(), "no_summary")
        .when(F.col("_pr") != F.col("revision_id"), "other_revision")
        .when(F.col("_sr").isNull() | (F.col("_sr") != F.col("_pr")) | (F.col("_sf") != F.col("_pf")), "corrupt")
        .when(F.col("qa_state") != "passed", "not_passed")
    )
    return rows.withColumn("guard", guard).select("event_id", "work_id", F.when(guard.isNull(), F.col("summary_id")).alias("summary_id"), "guard")


def queued(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """(digest_id, event_id, outcome) of requests(digest_id, reader_id, channel, event_id, at): queued the first time a reader gets an
    event by a channel, replayed for the same digest again, else already_notified (by the ledger, or an earlier digest)."""
    keys = ["reader_id", "channel", "event_id"]
    first = Window.partitionBy(*keys).orderBy("at", "digest_id")
    same = F.row_number().over(Window.partitionBy(*keys, "digest_id").orderBy("at")) > 1
    rows = requests.join(ledger.select(*keys, F.lit(True).alias("_told")).distinct(), keys, "left")
    owner = F.first("digest_id").over(first)
    rows = rows.withColumns({"_owner": owner, "_again": same})
    outcome = F.when(F.col("_told"), "already_notified").when(F.col("_owner") != F.col("digest_id"), "already_notified").when(F.col("_again"), "replayed").otherwise("queued")
    return rows.select("digest_id", "event_id", "at", outcome.alias("outcome"))


def notices(events: DataFrame, prior: DataFrame, subscriptions: DataFrame, jobs: DataFrame) -> DataFrame:
    """(event_id, reader_id, outcome) for each notice and reader told of its work: disabled, or by the delivery job's state what became
    of it, pending where there is none. A notice nobody was told of has no reader and no_prior_recipient."""
    told = prior.select("reader_id", "work_id").distinct()
    rows = events.where(F.col("event_kind").isin("correction", "retraction")).join(told, "work_id", "left").join(subscriptions, "reader_id", "left")
    rows = rows.join(jobs.select("event_id", "reader_id", F.col("state").alias("_job")), ["event_id", "reader_id"], "left")
    done = F.when(F.col("_job").isin("provider_accepted", "sent"), "sent").when(F.col("_job").isin("failed", "unknown", "cancelled"), F.col("_job"))
    outcome = F.when(F.col("reader_id").isNull(), "no_prior_recipient").when(~F.coalesce("enabled", F.lit(False)), "disabled").otherwise(F.coalesce(done, F.lit("pending")))
    return rows.select("event_id", "reader_id", outcome.alias("outcome"))


def access(rows: DataFrame) -> DataFrame:
    """rows(scope, signal, status, content_type, identity_matches, url_safe) with reader_access and error."""
    success = F.col("status").isin(200, 206) & F.col("identity_matches")
    error = (
        F.when(~F.col("scope").isin(*SCOPES), "invalid_access_evidence")
        .when(~F.col("url_safe"), "unsafe_access_target")
        .when(~F.col("status").between(100, 599), "invalid_access_probe")
        .when(success & (F.col("scope") == "full_text") & ~F.coalesce(F.col("content_type").isin(*READABLE), F.lit(False)), "unsupported_access_content")
    )
    return rows.withColumn("error", error).withColumn("reader_access", F.when(F.col("error").isNull(), F.when(success, F.col("signal")).otherwise("unknown")))


def orphan_totals(objects: DataFrame, attached: DataFrame, most_objects: int, most_bytes: int) -> DataFrame:
    """(kind, n, bytes, complete): objects(kind, object_id, size) that nothing refers to; incomplete beyond a bound of either."""
    own = objects.join(attached.select("object_id"), "object_id", "left_anti")
    out = own.groupBy("kind").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    return out.withColumn("complete", (F.col("n") <= most_objects) & (F.col("bytes") <= most_bytes))


def replay_problems(observations: DataFrame, objects: DataFrame, parsed: DataFrame) -> DataFrame:
    """(observation_id, problem): observations(observation_id, object_id, place, record_sha256) whose raw object is missing or
    changed (objects(object_id, sha256, actual_sha256)), or whose record (parsed(object_id, place, record_sha256)) is another now."""
    rows = observations.join(objects.select("object_id", "sha256", "actual_sha256"), "object_id", "left")
    rows = rows.join(parsed.select("object_id", "place", F.col("record_sha256").alias("_now")), ["object_id", "place"], "left")
    problem = (
        F.when(F.col("sha256").isNull(), "object_missing")
        .when(F.col("sha256") != F.col("actual_sha256"), "object_changed")
        .when(F.col("_now").isNull(), "record_missing")
        .when(F.col("_now") != F.col("record_sha256"), "record_changed")
    )
    return rows.withColumn("problem", problem).where("problem is not null").select("observation_id", "problem")


def integrity_source(assertions: DataFrame, *proofs: tuple[DataFrame, str, Column]) -> DataFrame:
    """assertions with mismatch: the first of the proofs (rows, key, condition) that has no row for the key or breaks its condition."""
    rows, mismatch = assertions, F.lit(None).cast("string")
    for n, (proof, key, condition) in enumerate(proofs):
        rows = rows.join(proof.withColumn(f"_has{n}", F.lit(True)), key, "left")
        mismatch = F.coalesce(mismatch, F.when(F.col(f"_has{n}").isNull(), F.lit(f"missing_{key}")).when(~F.coalesce(condition, F.lit(False)), F.lit(f"broken_{key}")))
    return rows.withColumn("mismatch", mismatch)

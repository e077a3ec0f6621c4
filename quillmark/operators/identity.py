"""Works, manifestations and revisions out of observations, by ids that follow from what is observed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import texts
from quillmark.functions.hashing import framed_sha256
from quillmark.sources.folders import written

#: Kinds of manifestations and states of publications.
MANIFESTATION_KINDS = ["preprint", "publication", "notice", "repository_copy"]
PUBLICATION_STATES = ["preprint", "published", "corrected", "retracted", "withdrawn", "unknown"]
#: What an observation says; one that comes again under its id must say the same.
OBSERVED = ["namespace", "value", "native_version", "title", "fingerprint", "manifestation_kind", "landing_url", "publication_status", "observed_at", "source_updated_at", "published_at"]
#: What belongs to a revision, and may not differ while its content is the same.
OF_REVISION = ["native_version", "title", "source_updated_at", "published_at"]


def resolved(observations: DataFrame) -> DataFrame:
    """observations(observation_id, namespace, value, fingerprint, observed_at) with the ids of work, manifestation and revision,
    whether each is new with this observation, and the revision's kind: new_work with the first one, revision_available after.

    Ids are hashes of the identifier and the content, so an observation gives the same ones whenever it comes.
    """
    key = F.concat_ws(":", "namespace", "value")
    rows = observations.withColumns({
        "work_id": F.concat(F.lit("work:"), framed_sha256(F.lit("work-identity-v1"), key)),
        "manifestation_id": F.concat(F.lit("manifestation:"), framed_sha256(F.lit("manifestation-identity-v1"), key)),
    })
    rows = rows.withColumn("revision_id", F.concat(F.lit("revision:"), framed_sha256(F.lit("revision-identity-v1"), F.col("manifestation_id"), F.col("fingerprint"))))
    first = lambda *k: F.row_number().over(Window.partitionBy(*k).orderBy("observed_at", "observation_id")) == 1
    rows = rows.withColumns({"created_work": first("work_id"), "created_revision": first("work_id", "revision_id")})
    return rows.withColumn("event_kind", F.when(F.col("created_work"), "new_work").when(F.col("created_revision"), "revision_available"))


def seeded(current: DataFrame, seeds: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """(key, outcome) of an import: created, unchanged, or preserved where what is there differs or isn't among the seeds."""
    both = current.select(key, F.col(fingerprint).alias("_old")).join(seeds.select(key, F.col(fingerprint).alias("_new")), key, "full_outer")
    return both.select(key, F.when(F.col("_old").isNull(), "created").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("preserved").alias("outcome"))


def freshest(candidates: DataFrame, key: str, *freshness: str) -> DataFrame:
    """(key, …) with the candidate of the greatest freshness; where the two freshest are equally fresh nothing is published."""
    order = F.struct(*freshness)
    best = candidates.groupBy(key).agg(F.max(order).alias("_best"))
    top = candidates.join(best, key).where(order == F.col("_best"))
    return top.groupBy(key).agg(F.min("candidate_id").alias("candidate_id"), (F.count("*") > 1).alias("tied"))


def well_formed(id_length: int = 128, longest: int = 8192) -> Column:
    """Whether an observation's fields are what they must be: an id, plain title and address, a fingerprint, known kinds, and no update after it was observed."""
    fits = (
        F.col("source_observation_id").rlike(f"^[A-Za-z0-9][A-Za-z0-9:_-]{{0,{id_length - 1}}}\\z")
        & texts.valid_text(F.col("title"), longest)
        & texts.valid_text(F.col("landing_url"), longest)
        & F.col("fingerprint").rlike("^[0-9a-f]{64}\\z")
        & F.col("manifestation_kind").isin(MANIFESTATION_KINDS)
        & F.col("publication_status").isin(PUBLICATION_STATES)
        & F.col("observed_at").isNotNull()
        & (F.col("source_updated_at").isNull() | (F.col("source_updated_at") <= F.col("observed_at")))
    )
    return F.coalesce(fits, F.lit(False))


def _halves(*columns: str) -> list[Column]:
    """What columns say, with its nulls, as two numbers of 60 bits of its SHA-256."""
    said = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    return [F.conv(F.substring(said, at, 15), 16, 10).cast("long") for at in (1, 16)]


def _heads(rows: DataFrame) -> DataFrame:
    """For each key and content: the first row of the key, and of the content, that is not refused (seq, what it says, whether it is accepted for good),
    whether all that are not refused say the same, and whether any row still asks."""
    alive = F.col("status") < 2
    seq, own = F.when(alive, F.col("seq")), {c: F.when(alive, F.col(c)) for c in ("kind", "about_a", "about_b")}
    at = lambda c: F.min_by(c, seq)
    of_content = rows.groupBy("key", "content").agg(
        F.min(seq).alias("about_seq"), at(own["about_a"]).alias("first_a"), at(own["about_b"]).alias("first_b"), at(F.col("status") == 1).alias("about_holds"),
        ((F.min(own["about_a"]) == F.max(own["about_a"])) & (F.min(own["about_b"]) == F.max(own["about_b"]))).alias("about_same"), F.bool_or((F.col("status") != 1) | ~F.col("told")).alias("about_open"),
        at(own["kind"]).alias("own_kind"), F.min(own["kind"]).alias("least_kind"), F.max(own["kind"]).alias("most_kind"),
    )
    of_key = of_content.groupBy("key").agg(
        F.min("about_seq").alias("kind_seq"), F.min_by("own_kind", "about_seq").alias("first_kind"), F.min_by("about_holds", "about_seq").alias("kind_holds"),
        (F.min("least_kind") == F.max("most_kind")).alias("kind_same"), F.bool_or("about_open").alias("kind_open"),
    )
    return of_content.drop("own_kind", "least_kind", "most_kind").join(of_key, "key")


#: Keys with their contents that are broadcast at most, some 25 MB.
BROADCAST_HEADS = 100_000


def _round(rows: DataFrame) -> DataFrame:
    """rows with what is known of each after one more round: status, told, error, what it creates, done (told in this round), stay (of use in the next one)."""
    heads = written(_heads(rows))
    met = rows.join(F.broadcast(heads) if heads.count() <= BROADCAST_HEADS else heads, ["key", "content"])
    seq, settled = F.col("seq"), lambda name: (F.col(f"{name}_seq") < seq) & F.col(f"{name}_holds")
    verdict = lambda name, equal: (F.coalesce(F.col(f"{name}_seq") >= seq, F.lit(True)) | ((F.col(f"{name}_holds") | F.col(f"{name}_same")) & equal), F.coalesce(settled(name) & ~equal, F.lit(False)))
    (kind_fine, kind_differs), (about_fine, about_differs) = verdict("kind", F.col("first_kind") == F.col("kind")), verdict("about", (F.col("first_a") == F.col("about_a")) & (F.col("first_b") == F.col("about_b")))
    met = met.select(
        "seq", "source", "key", "content", "kind", "said_a", "said_b", "about_a", "about_b", "status", "told", kind_fine.alias("kind_fine"), kind_differs.alias("kind_differs"), about_fine.alias("about_fine"), about_differs.alias("about_differs"),
        (F.col("kind_seq") == seq).alias("first_of_key"), (F.col("about_seq") == seq).alias("first_of_content"),
        (((F.col("kind_seq") == seq) | settled("kind")) & ((F.col("about_seq") == seq) | settled("about"))).alias("placed"),
        ((F.col("kind_open") & ~settled("kind")) | (F.col("about_open") & ~settled("about"))).alias("leads"),
    )
    before = Window.partitionBy("source").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    alive = F.col("status") < 2
    same = lambda c: F.coalesce((F.min(F.when(alive, F.col(c))).over(before) == F.col(c)) & (F.max(F.when(alive, F.col(c))).over(before) == F.col(c)), F.lit(False))
    met = met.withColumns({"first": F.first(F.when(alive, F.struct("said_a", "said_b", (F.col("status") == 1).alias("holds"))), ignorenulls=True).over(before), "said_same": same("said_a") & same("said_b")})
    holds, equal = F.coalesce(F.col("first.holds"), F.lit(False)), (F.col("first.said_a") == F.col("said_a")) & (F.col("first.said_b") == F.col("said_b"))
    said_fine, said_differs = F.col("first").isNull() | F.col("said_same") | (holds & equal), holds & ~equal
    error = F.when(said_differs, "source_observation_conflict").when(said_fine & F.col("kind_differs"), "manifestation_conflict").when(said_fine & F.col("kind_fine") & F.col("about_differs"), "revision_conflict")
    accepted = (F.col("status") == 1) | ((F.col("status") == 0) & said_fine & F.col("kind_fine") & F.col("about_fine"))
    met = met.withColumn("error", F.when(F.col("status") != 1, error)).withColumn("holds", holds)
    met = met.withColumn("now", F.when(F.col("error").isNotNull(), 3).when(accepted, 1).when(F.col("kind_differs") | F.col("about_differs"), 2).otherwise(F.col("status")))
    met = met.withColumn("known", F.col("told") | (F.col("now") == 3) | ((F.col("now") == 1) & F.col("placed")))
    asked = F.bool_or((F.col("now") == 0) | (F.col("now") == 2)).over(Window.partitionBy("source"))
    stay = (F.col("now") != 3) & ((F.col("now") != 1) | ~F.col("known") | F.col("leads") | (asked & ~F.col("holds")))
    met = met.withColumn("stay", stay)
    kept = lambda c: F.when(F.col("stay"), F.col(c)).alias(c)
    return met.select(
        "seq", "key", "content", *(kept(c) for c in ("source", "kind", "said_a", "said_b", "about_a", "about_b")), F.col("now").cast("int").alias("status"), F.col("known").alias("told"), "error",
        ((F.col("now") == 1) & F.col("first_of_key")).alias("created_work"), ((F.col("now") == 1) & F.col("first_of_content")).alias("created_revision"), (F.col("known") & ~F.col("told")).alias("done"), "stay",
    )


def registered(observations: DataFrame) -> DataFrame:
    """observations (seq, source_observation_id and OBSERVED) taken one by one in the order of seq: error, ids, and what each creates.

    invalid_observation: not well_formed. source_observation_conflict: its id came before with anything else. manifestation_conflict: its
    identifier has another kind of manifestation. revision_conflict: its content is known with another version, title or date. Such a one
    leaves nothing behind, so it is no reason to refuse a later one. seq is unique.

    What an observation is compared with is the first accepted one of its id, of its identifier, and of its content. A row is decided as soon as
    these are, or as all that may still come before it there say the same. The first one always is, so rounds end, after as many as refusals depend on
    one another. Only rows that are open, and those they are compared with, go on to the next round; of what a row says its hash is carried.
    """
    rows = observations.withColumns({"valid": well_formed(), "key": F.concat_ws(":", "namespace", "value")})
    (said_a, said_b), (about_a, about_b) = _halves(*OBSERVED), _halves(*OF_REVISION)
    kind = F.array_position(F.array(*map(F.lit, MANIFESTATION_KINDS)), F.col("manifestation_kind")).cast("int")
    rows = written(rows.select("seq", "valid", "key", *(F.when(F.col("valid"), c).alias(name) for name, c in {
        "content": F.unhex("fingerprint"), "source": F.col("source_observation_id"), "kind": kind, "said_a": said_a, "said_b": said_b, "about_a": about_a, "about_b": about_b,
    }.items())))
    no = F.lit(False)
    told = [rows.where("not valid").select("seq", "key", "content", F.lit("invalid_observation").alias("error"), no.alias("created_work"), no.alias("created_revision"))]
    left = rows.where("valid").drop("valid").withColumns({"status": F.lit(0), "told": no})
    while left.where("status != 1 or not told").limit(1).count():
        met = written(_round(left))
        told.append(met.where("done").select("seq", "key", "content", "error", "created_work", "created_revision"))
        left = met.where("stay").drop("error", "created_work", "created_revision", "done", "stay")
    new = reduce(DataFrame.union, told)
    fine = lambda c: F.when(F.col("error").isNull(), c)
    manifestation = F.concat(F.lit("manifestation:"), framed_sha256(F.lit("manifestation-identity-v1"), F.col("key")))
    return new.select(
        "seq",
        "error",
        fine(F.concat(F.lit("work:"), framed_sha256(F.lit("work-identity-v1"), F.col("key")))).alias("work_id"),
        fine(manifestation).alias("manifestation_id"),
        fine(F.concat(F.lit("revision:"), framed_sha256(F.lit("revision-identity-v1"), manifestation, F.lower(F.hex("content"))))).alias("revision_id"),
        "created_work",
        F.col("created_work").alias("created_manifestation"),
        "created_revision",
    )

"""Profiles published revision by revision, with what must hold for that, and their lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators.folds import Step, folded

DECIDED = "profile_id string, seq long, outcome string, revision int, lifecycle string"
#: A profile before it is published: reader, name, lifecycle, the newest revision, and fingerprints by revision.
START = (None, None, None, None, {})


def profile_step(state: tuple, row: dict) -> tuple[tuple, tuple]:
    """publish: identity_conflict for another reader or name, profile_archived; content that is known gives its own revision (replayed) whatever is expected; else
    revision_conflict unless the newest one is expected, domain_revision_missing, or published as the next one. lifecycle (active, paused, archived): profile_missing,
    profile_archived, invalid_lifecycle, or set."""
    reader, name, lifecycle, current, known = state
    outcome, revision = None, None
    if row["action"] == "publish":
        if current is not None and (reader, name) != (row["reader_id"], row["name"]):
            outcome = "identity_conflict"
        elif lifecycle == "archived":
            outcome = "profile_archived"
        elif current is not None and row["fingerprint"] in known:
            outcome, revision = "replayed", known[row["fingerprint"]]
        elif current != row["expected_revision"]:
            outcome = "revision_conflict"
        elif row["missing"]:
            outcome = "domain_revision_missing"
        else:
            outcome, revision = "published", (current or 0) + 1
            state = (row["reader_id"], row["name"], lifecycle or "active", revision, known | {row["fingerprint"]: revision})
    elif row["lifecycle"] not in ("active", "paused", "archived"):
        outcome = "invalid_lifecycle"
    elif current is None:
        outcome = "profile_missing"
    elif lifecycle == "archived":
        outcome = "profile_archived"
    else:
        outcome, state = "set", (reader, name, row["lifecycle"], current, known)
    return state, (row["profile_id"], row["seq"], outcome, revision, state[2])


step: Step = profile_step


def decided(log: DataFrame, domains: DataFrame) -> DataFrame:
    """(profile_id, seq, outcome, revision, lifecycle) of log(profile_id, seq, action, reader_id, name, fingerprint, expected_revision, domains
    array<struct<id,revision>>, lifecycle) by domains(id, revision): see profile_step. What is kept of a profile while its log is read are its revisions' fingerprints."""
    each = log.select("profile_id", "seq", F.explode("domains").alias("d")).select("profile_id", "seq", "d.id", "d.revision")
    lacking = each.join(domains.select("id", "revision"), ["id", "revision"], "left_anti").select("profile_id", "seq").distinct().withColumn("missing", F.lit(True))
    rows = log.join(lacking, ["profile_id", "seq"], "left").withColumn("missing", F.coalesce("missing", F.lit(False))).drop("domains")
    return folded(rows, ["profile_id"], ["seq"], START, step, DECIDED)

"""Verified summaries as they are kept: their texts and the reports of both verifiers byte for byte, under ids that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.hashing import canonical_json_utf8

#: The profile of explanations, their language, and the formats of what is kept.
EXPLANATION, LANGUAGE = "plain-zh-TW-v1", "zh-TW"
SUMMARY_TAG = "verified-summary-v1"
DETERMINISTIC, SUPPORTIVENESS = "deterministic-v1", "supportiveness-v1"

STATEMENTS = "array<struct<claim_type:string,text:string,claim_ids:array<string>>>"
FINDINGS = "array<struct<code:string,source_kind:string,source_index:int,claim_ids:array<string>>>"
VERDICTS = "array<struct<statement_index:int,verdict:string,claim_ids:array<string>>>"


def json_of(*columns: Column) -> Column:
    """A struct in canonical JSON: sorted keys, no blanks, all characters as they are, nulls kept."""
    return canonical_json_utf8(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def support_outcome(statements: Column) -> Column:
    """What a supportiveness report comes to: rejected with an unsupported statement, else pending with an uncertain one, else passed."""
    has = lambda verdict: F.exists(statements, lambda s: s["verdict"] == verdict)
    return F.when(has("unsupported"), "rejected").when(has("uncertain"), "pending").otherwise("passed")


def report_problem() -> Column:
    """invalid_verification_result, or null: whether a row's verdict, findings, states and statements go together.

    Rejected with findings, and then no support was looked for; or passed without any, and then support failed (pending), succeeded (with statements, each once, with
    claims, each once, and the state that follows) or was not run (passed).
    """
    hexed = lambda c, prefix: F.col(c).rlike(f"^{prefix}:[0-9a-f]{{64}}\\z")
    sha = lambda c: F.col(c).rlike("^[0-9a-f]{64}\\z")
    ids = hexed("snapshot_id", "snapshot") & hexed("revision_id", "revision") & hexed("work_id", "work") & sha("input_fingerprint")
    support, state, qa = F.col("support"), F.col("support_state"), F.col("qa_state")
    statement = lambda s: (s["statement_index"] >= 0) & s["verdict"].isin("supported", "unsupported", "uncertain") & (F.size(s["claim_ids"]) > 0) & (F.size(F.array_distinct(s["claim_ids"])) == F.size(s["claim_ids"])) & F.forall(s["claim_ids"], lambda c: c.rlike("^claim:[0-9a-f]{64}\\z"))
    indexes = F.transform(support, lambda s: s["statement_index"])
    sound = (F.size(support) > 0) & F.forall(support, statement) & (F.size(F.array_distinct(indexes)) == F.size(indexes)) & sha("support_fingerprint")
    fits = (
        F.when(F.col("verdict") == "rejected", (F.size("findings") > 0) & support.isNull() & (state == "not_run") & (qa == "rejected"))
        .when(F.col("verdict") != "passed", F.lit(False))
        .when(F.size("findings") > 0, F.lit(False))
        .when(state == "failed", support.isNull() & (qa == "pending"))
        .when(state == "not_run", support.isNull() & (qa == "passed"))
        .when(state == "succeeded", sound & (qa == support_outcome(support)))
    )
    return F.when(~F.coalesce(ids & fits, F.lit(False)), "invalid_verification_result")


def run_problem() -> Column:
    """invalid_summary_persistence, or null: runs and fingerprints are there in their forms, those of support both or neither, and with them what support came to."""
    run = lambda c: F.coalesce(F.col(c).rlike("^run:[0-9a-f]{64}\\z"), F.lit(False))
    sha = lambda c: F.coalesce(F.col(c).rlike("^[0-9a-f]{64}\\z"), F.lit(False))
    neither = F.col("support_run").isNull() & F.col("support_run_fingerprint").isNull()
    fine = run("claim_run") & sha("claim_fingerprint") & run("reading_run") & sha("reading_fingerprint") & (neither | (run("support_run") & sha("support_run_fingerprint"))) & F.col("created_at").isNotNull()
    card = (F.col("language") == LANGUAGE) & (F.col("evidence_level") == "abstract_only") & (F.col("validation_state") == "draft_requires_verification")
    return F.when(~F.coalesce(fine & card, F.lit(False)), "invalid_summary_persistence").when(F.col("support").isNull() != neither, "verification_result_mismatch")


def prepared(requests: DataFrame) -> DataFrame:
    """(request_id, error, summary_id, qa_state, summary, deterministic_report, support_report, support_verdict) of what is to be kept.

    requests: request_id; the draft's snapshot_id, revision_id, work_id, input_fingerprint, original_abstract, language, evidence_level, validation_state,
    translation and card (STATEMENTS), not_reported, claim_ids; its verification's verdict, findings (FINDINGS), qa_state, support_state, support (VERDICTS),
    support_fingerprint; claim_run, reading_run, support_run with their fingerprints; created_at. The summary's id is the hash of its text, so the same one
    comes to the same id whenever it was made; reports name it and the time. A request with an error has nothing else.
    """
    error = F.coalesce(run_problem(), report_problem())
    fields = {
        "claim_ids": F.col("claim_ids"), "evidence_level": F.col("evidence_level"), "explanation_profile": F.lit(EXPLANATION), "faithful_translation": F.col("translation"), "format_version": F.lit(1),
        "generation_fingerprint": F.col("reading_fingerprint"), "generation_input_fingerprint": F.col("input_fingerprint"), "language": F.col("language"), "not_reported_in_read_evidence": F.col("not_reported"),
        "original_abstract": F.col("original_abstract"), "plain_language_card": F.col("card"), "revision_id": F.col("revision_id"), "snapshot_id": F.col("snapshot_id"), "work_id": F.col("work_id"),
    }
    rows = requests.withColumn("error", error).withColumn("summary", F.when(F.col("error").isNull(), json_of(*(c.alias(k) for k, c in fields.items()))))
    rows = rows.withColumn("summary_id", F.concat(F.lit("summary:"), F.sha2(F.concat(F.lit(SUMMARY_TAG + "\0"), F.col("summary")), 256)))
    utc = F.to_utc_timestamp("created_at", F.current_timezone())
    at = F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.unix_micros("created_at") % 1_000_000 != 0, F.date_format(utc, ".SSSSSS")).otherwise(""), F.lit("+00:00"))
    common = lambda kind: [F.lit(1).alias("format_version"), F.lit(kind).alias("verifier_kind"), F.col("summary_id"), at.alias("verified_at")]
    found = F.struct("snapshot_id", "revision_id", "work_id", "input_fingerprint", "verdict", "findings")
    backed = F.struct("snapshot_id", F.col("support_fingerprint").alias("input_fingerprint"), F.col("support").alias("statements"))
    fine = lambda c: F.when(F.col("error").isNull(), c)
    there = F.col("error").isNull() & F.col("support").isNotNull()
    verdict = F.when(support_outcome(F.col("support")) == "pending", None).otherwise(support_outcome(F.col("support")))
    return rows.select(
        "request_id", "error", fine(F.col("summary_id")).alias("summary_id"), fine(F.col("qa_state")).alias("qa_state"), "summary",
        fine(json_of(*common(DETERMINISTIC), found.alias("report"))).alias("deterministic_report"),
        F.when(there, json_of(*common(SUPPORTIVENESS), F.col("support_state").alias("execution_state"), backed.alias("report"))).alias("support_report"), F.when(there, verdict).alias("support_verdict"),
    )


def report_text(summary_id: Column) -> Column:
    """A verification's own report under its summary, in canonical JSON, of rows as in `prepared`; null with a problem."""
    found = F.struct("snapshot_id", "revision_id", "work_id", "input_fingerprint", "verdict", "findings")
    backed = F.when(F.col("support").isNotNull(), F.struct("snapshot_id", F.col("support_fingerprint").alias("input_fingerprint"), F.col("support").alias("statements")))
    whole = F.struct(found.alias("deterministic"), backed.alias("support"), "qa_state", F.col("support_state").alias("support_execution_state"))
    return F.when(report_problem().isNull() & summary_id.rlike("^summary:[0-9a-f]{64}\\z"), json_of(F.lit(1).alias("format_version"), summary_id.alias("summary_id"), whole.alias("verification")))

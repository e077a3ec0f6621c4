"""Kept summaries byte for byte against json.dumps, and what is refused."""

import hashlib
import json
from datetime import datetime, timezone

from quillmark.operators import publishing, summaries

H = {n: hashlib.sha256(n.encode()).hexdigest() for n in ("a", "b", "c", "d", "e", "f")}
SCHEMA = f"""request_id long, snapshot_id string, revision_id string, work_id string, input_fingerprint string, original_abstract string, language string, evidence_level string, validation_state string,
  translation {summaries.STATEMENTS}, card {summaries.STATEMENTS}, not_reported array<string>, claim_ids array<string>, verdict string, findings {summaries.FINDINGS}, qa_state string, support_state string,
  support {summaries.VERDICTS}, support_fingerprint string, claim_run string, claim_fingerprint string, reading_run string, reading_fingerprint string, support_run string, support_run_fingerprint string, created_at timestamp"""
AT = datetime(2024, 1, 2, 3, 4, 5, 600, timezone.utc)


def request(n, **changed):
    claim = "claim:" + H["a"]
    statement = ("method", 'Ü "x"\n\u0001 \\ / 中', [claim])
    fields = {
        "request_id": n, "snapshot_id": "snapshot:" + H["a"], "revision_id": "revision:" + H["b"], "work_id": "work:" + H["c"], "input_fingerprint": H["d"], "original_abstract": "a\tb\u007f ", "language": "zh-TW",
        "evidence_level": "abstract_only", "validation_state": "draft_requires_verification", "translation": [statement], "card": [statement, statement], "not_reported": [], "claim_ids": [claim], "verdict": "passed", "findings": [],
        "qa_state": "passed", "support_state": "succeeded", "support": [(0, "supported", [claim])], "support_fingerprint": H["e"], "claim_run": "run:" + H["a"], "claim_fingerprint": H["a"], "reading_run": "run:" + H["b"],
        "reading_fingerprint": H["b"], "support_run": "run:" + H["c"], "support_run_fingerprint": H["c"], "created_at": AT,
    }
    return tuple((fields | changed).values())


def prepared(spark, rows):
    return {r.request_id: r for r in summaries.prepared(spark.createDataFrame(rows, SCHEMA)).collect()}


def canonical(value):
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def test_texts_byte_for_byte(spark):
    claim = "claim:" + H["a"]
    finding = ("number_mismatch", "card", 0, [])
    nothing = {"support": None, "support_fingerprint": None, "support_run": None, "support_run_fingerprint": None}
    got = prepared(spark, [request(1), request(2, verdict="rejected", findings=[finding], qa_state="rejected", support_state="not_run", **nothing)])
    statement = {"claim_type": "method", "text": 'Ü "x"\n\u0001 \\ / 中', "claim_ids": [claim]}
    summary = {
        "format_version": 1, "snapshot_id": "snapshot:" + H["a"], "revision_id": "revision:" + H["b"], "work_id": "work:" + H["c"], "generation_fingerprint": H["b"], "generation_input_fingerprint": H["d"], "language": "zh-TW",
        "explanation_profile": "plain-zh-TW-v1", "evidence_level": "abstract_only", "original_abstract": "a\tb\u007f ", "faithful_translation": [statement], "plain_language_card": [statement] * 2, "not_reported_in_read_evidence": [], "claim_ids": [claim],
    }
    assert got[1].summary == canonical(summary)
    summary_id = "summary:" + hashlib.sha256(("verified-summary-v1\0" + canonical(summary)).encode()).hexdigest()
    assert got[1].summary_id == got[2].summary_id == summary_id and (got[1].support_verdict, got[2].support_verdict, got[2].support_report) == ("passed", None, None)
    of = {"snapshot_id": "snapshot:" + H["a"], "revision_id": "revision:" + H["b"], "work_id": "work:" + H["c"], "input_fingerprint": H["d"]}
    report = lambda verdict, findings: {"format_version": 1, "verifier_kind": "deterministic-v1", "summary_id": summary_id, "verified_at": AT.isoformat(), "report": of | {"verdict": verdict, "findings": findings}}
    assert got[1].deterministic_report == canonical(report("passed", []))
    assert got[2].deterministic_report == canonical(report("rejected", [{"code": "number_mismatch", "source_kind": "card", "source_index": 0, "claim_ids": []}]))
    backed = {"snapshot_id": "snapshot:" + H["a"], "input_fingerprint": H["e"], "statements": [{"statement_index": 0, "verdict": "supported", "claim_ids": [claim]}]}
    assert got[1].support_report == canonical({"format_version": 1, "verifier_kind": "supportiveness-v1", "summary_id": summary_id, "execution_state": "succeeded", "verified_at": AT.isoformat(), "report": backed})


def test_what_does_not_go_together(spark):
    claim = "claim:" + H["a"]
    nothing = {"support": None, "support_fingerprint": None, "support_run": None, "support_run_fingerprint": None}
    wrong = {"invalid_summary_persistence": [{"claim_run": "x"}, {"reading_fingerprint": None}, {"support_run": None}, {"language": "en"}, {"created_at": None}], "verification_result_mismatch": [{"support": None}, {"support_run": None, "support_run_fingerprint": None}]}
    wrong["invalid_verification_result"] = [
        {"qa_state": "pending"}, {"verdict": "rejected"}, {"findings": [("x", "card", 0, [])]}, {"snapshot_id": "snapshot:1"}, {"support": []}, {"support": [(0, "maybe", [claim])]}, {"support": [(0, "supported", [])]}, {"support": [(0, "supported", [claim, claim])]},
        {"support": [(0, "supported", [claim]), (0, "supported", [claim])]}, {"support": [(-1, "supported", [claim])]}, {"support": [(0, "unsupported", [claim])]}, {"support_state": "failed", "qa_state": "passed", **nothing}, {"support_state": None},
    ]
    cases = [(code, changed) for code, many in wrong.items() for changed in many]
    got = prepared(spark, [request(n, **changed) for n, (_, changed) in enumerate(cases)])
    assert [got[n].error for n in range(len(cases))] == [code for code, _ in cases] and all(got[n].summary_id is None and got[n].summary is None for n in got)
    fine = [{"support_state": "failed", "qa_state": "pending", **nothing}, {"support_state": "not_run", **nothing}, {"support": [(0, "uncertain", [claim]), (3, "supported", [claim])], "qa_state": "pending"}, {"support": [(0, "uncertain", [claim]), (3, "unsupported", [claim])], "qa_state": "rejected"}]
    got = prepared(spark, [request(n, **changed) for n, changed in enumerate(fine)])
    assert [(got[n].error, got[n].support_verdict) for n in range(4)] == [(None, None), (None, None), (None, None), (None, "rejected")]


def test_publications(spark):
    log = [
        ("p", 1, "lifecycle", None, None, None, None, [], "active"), ("p", 2, "publish", "r", "n", "f1", 1, [("d", 1)], None), ("p", 3, "publish", "r", "n", "f1", None, [("d", 2)], None), ("p", 4, "publish", "r", "n", "f1", None, [("d", 1)], None),
        ("p", 5, "publish", "r", "n", "f2", 1, [], None), ("p", 6, "publish", "r", "n", "f1", 7, [], None), ("p", 7, "publish", "r", "m", "f3", 2, [], None), ("p", 8, "lifecycle", None, None, None, None, [], "paused"), ("p", 9, "publish", "r", "n", "f3", 2, None, None),
        ("p", 10, "lifecycle", None, None, None, None, [], "archived"), ("p", 11, "publish", "r", "n", "f1", None, [], None), ("p", 12, "lifecycle", None, None, None, None, [], "x"), ("q", 13, "publish", "s", "n", "f1", None, [], None),
    ]
    df = spark.createDataFrame(log, "profile_id string, seq long, action string, reader_id string, name string, fingerprint string, expected_revision int, domains array<struct<id:string,revision:int>>, lifecycle string")
    got = publishing.decided(df, spark.createDataFrame([("d", 1)], "id string, revision int")).orderBy("seq").collect()
    assert [(r.outcome, r.revision) for r in got] == [("profile_missing", None), ("revision_conflict", None), ("domain_revision_missing", None), ("published", 1), ("published", 2), ("replayed", 1), ("identity_conflict", None), ("set", None), ("published", 3), ("set", None), ("profile_archived", None), ("invalid_lifecycle", None), ("published", 1)]
    assert got[8].lifecycle == "paused"

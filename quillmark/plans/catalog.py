"""All queries of the library by name, with the SQL that gives the same rows."""

from quillmark.plans import capture_queries, delivery_queries, digest_queries, evidence_queries, graph_queries, identity_queries, ledger_queries, outcome_queries, provider_queries, record_queries, request_queries, stream_queries, text_queries, version_queries, workflow_queries  # noqa: F401
from quillmark.plans.registry import ORACLES, QUERIES  # noqa: F401

"""Registers addressed by content: one payload for an id and one id for a payload, with every pair that breaks this as a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def content_register(rows: DataFrame, id: str, payload: list[str], seq: str) -> DataFrame:
    """(id, sha256, first_seq, n, outcome, against) for each different pair of id and payload in rows.

    The first payload of an id, by seq, is kept if no earlier id has it. payload_conflict: the id has another payload, first seen at `against`; id_conflict: the
    payload is another id's, first seen at `against`; a pair that is both is a payload_conflict. n counts how often the pair came; what came again is a replay.
    Nulls in a payload are values. Equal pairs become one before they are shuffled by id and by payload.
    """
    said = F.sha2(F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}), 256)
    pairs = rows.groupBy(F.col(id).alias("id"), said.alias("sha256")).agg(F.min(seq).alias("first_seq"), F.count("*").alias("n"))
    by_id = pairs.groupBy("id").agg(F.min("first_seq").alias("_id_seq"))
    by_payload = pairs.groupBy("sha256").agg(F.min("first_seq").alias("_payload_seq"))
    met = pairs.join(by_id, pairs.id.eqNullSafe(by_id.id)).drop(by_id.id).join(by_payload, "sha256")
    other, taken = F.col("_id_seq") < F.col("first_seq"), F.col("_payload_seq") < F.col("first_seq")
    outcome = F.when(other, "payload_conflict").when(taken, "id_conflict").otherwise("kept")
    return met.select("id", "sha256", "first_seq", "n", outcome.alias("outcome"), F.when(other, F.col("_id_seq")).when(taken, F.col("_payload_seq")).alias("against"))

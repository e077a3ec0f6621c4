"""Folds that go on from micro-batch to micro-batch: the state of each key is in Spark's state store."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import _parse_datatype_string

from quillmark.operators import leases, ledgers
from quillmark.operators.folds import Step

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """While a query is started: the store that such states need."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def _plain(value: object) -> object:
    """A value of a pandas row as Python's own, missing ones as None."""
    if value is None or value is pd.NaT or isinstance(value, float) and value != value:
        return None
    return value.item() if hasattr(value, "item") else value


class Fold(StatefulProcessor):
    """Takes a key's rows of a micro-batch in their order on from the state that the last one left. With `ends`, a timer stands at the time of the
    state's field of that name, and what `expired` makes of the state then is a row too."""

    def __init__(self, order: list[str], start: tuple, step: Step, state: str, schema: str, ends: str | None = None, expired=None):
        self.order, self.start, self.step, self.expired = order, start, step, expired
        self.state, self.names = _parse_datatype_string(state), _parse_datatype_string(schema).names
        self.ends = self.state.names.index(ends) if ends else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getValueState("fold", self.state)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(map(_plain, self.kept.get())) if self.kept.exists() else self.start
        before, out = state, []
        for row in pd.concat(list(rows)).sort_values(self.order).to_dict("records"):
            state, result = self.step(state, {k: _plain(v) for k, v in row.items()})
            out.append(result)
        self.kept.update(state)
        if self.ends is not None and state[self.ends] != before[self.ends]:
            if before[self.ends] is not None:
                self.handle.deleteTimer(before[self.ends] * 1000)
            if state[self.ends] is not None:
                self.handle.registerTimer(state[self.ends] * 1000)
        yield pd.DataFrame(out, columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = tuple(map(_plain, self.kept.get()))
        found = self.expired(key, state)
        yield pd.DataFrame([found] if found else [], columns=self.names)

    def close(self) -> None:
        pass


def lapsed(key: tuple, state: tuple) -> tuple | None:
    return (key[0], None, "lapsed", state[2]) if state[0] == "running" else None


def lease_stream(commands: DataFrame, lease: int, *, notify: bool = False) -> DataFrame:
    """`leases.replayed` over a stream whose micro-batches follow one another in time: for each job a few fields are kept, however long its log gets.

    notify: a row with the outcome lapsed for each lease that runs out unfinished, when the watermark of the stream (to be set, in seconds of `at`) passes its end.
    """
    fold = Fold(["at", "command_id"], leases.START, leases.command(lease), leases.STATE, leases.SCHEMA, "until" if notify else None, lapsed)
    return commands.groupBy("job_id").transformWithStateInPandas(fold, leases.SCHEMA, "append", "eventTime" if notify else "none")


def admission_stream(requests: DataFrame, limit: int) -> DataFrame:
    """`ledgers.admitted` over such a stream: for each period and currency the sum of what was reserved is kept."""
    fold = Fold(["at", "request_id"], (0,), ledgers.admission(limit), "used long", ledgers.ADMITTED)
    return requests.groupBy("period", "currency").transformWithStateInPandas(fold, ledgers.ADMITTED, "append", "none")

import random

import pytest
from pyspark.sql import functions as F

from quillmark.operators import leases, ledgers
from quillmark.streaming import events, folds


def test_register_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k string, v string, observed_at timestamp"
    first = spark.createDataFrame([("a", "x", None), ("a", "x", None), ("b", "y", None)], schema)
    first.write.parquet(source)
    stream = lambda: events.register_stream(events.read_stream(spark, source, first), target, str(tmp_path / "c"), "k", ["v"], "observed_at").awaitTermination()
    stream()
    spark.createDataFrame([("b", "y", None), ("c", "z", None)], schema).write.mode("append").parquet(source)
    stream()
    assert sorted(r.k for r in spark.read.parquet(target).collect()) == ["a", "b", "c"]


def test_late_ones_stay(spark):
    rows = spark.sql("SELECT 1 AS version, timestamp'2024-01-01' AS published_at, timestamp'2024-01-20' AS observed_at UNION ALL SELECT 2, timestamp'2024-01-01', timestamp'2024-01-02'")
    assert sorted((r.event_kind, r.late) for r in events.classified(rows).collect()) == [("late_discovery", True), ("revision_available", False)]


COMMANDS = "job_id long, command_id long, kind string, owner string, token long, at long, state string"


def commands(rng, n, jobs):
    return [(rng.randrange(jobs), i, rng.choice(["claim", "claim", "complete"]), rng.choice("xy"), rng.randint(1, 4), i * 3 + rng.randint(0, 2), rng.choice(["failed", "failed", "succeeded"])) for i in range(n)]


def outcomes(rows, lease):
    """By a plain loop."""
    state, out = {}, {}
    for job, command, kind, owner, token, at, to in sorted(rows, key=lambda r: (r[0], r[5], r[1])):
        s = state.setdefault(job, {"state": "pending", "token": 0, "owner": None, "until": None, "last": None})
        if kind == "claim":
            if s["state"] == "succeeded":
                outcome = "finished"
            elif s["state"] == "running" and s["until"] > at:
                outcome = "busy"
            else:
                s.update(state="running", token=s["token"] + 1, owner=owner, until=at + lease, last=None)
                outcome = "claimed"
        elif s["state"] != "running":
            outcome = "replayed" if s["last"] == (owner, token, to) else "fencing_mismatch"
        elif (s["owner"], s["token"]) != (owner, token):
            outcome = "fencing_mismatch"
        elif s["until"] <= at:
            outcome = "lease_expired"
        else:
            s.update(state=to, last=(owner, token, to))
            outcome = "completed"
        out[command] = (outcome, s["token"])
    return out


@pytest.mark.parametrize("jobs", [1, 7, 100])
def test_leases(spark, jobs):
    rows = commands(random.Random(jobs), 3000, jobs)
    got = {r.command_id: (r.outcome, r.fencing_token) for r in leases.replayed(spark.createDataFrame(rows, COMMANDS).repartition(5), 9).collect()}
    assert got == outcomes(rows, 9)
    assert leases.replayed(spark.createDataFrame([], COMMANDS), 9).count() == 0


def test_leases_go_on_from_the_checkpoint(spark, tmp_path):
    """The log comes in parts, with the query stopped between them; jobs go on where they were."""
    rows = commands(random.Random(3), 600, 5)
    source, like = str(tmp_path / "in"), spark.createDataFrame(rows[:1], COMMANDS)

    def run():
        stream = folds.lease_stream(events.read_stream(spark, source, like), 9)
        with folds.state_store(spark):
            stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    for part in (rows[:200], rows[200:201], rows[201:]):
        spark.createDataFrame(part, COMMANDS).coalesce(1).write.mode("append").parquet(source)
        run()
    run()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 600 and {r.command_id: (r.outcome, r.fencing_token) for r in got} == outcomes(rows, 9)


def test_leases_that_run_out_are_told(spark, tmp_path):
    rows = [(1, 1, "claim", "x", 1, 100, "failed"), (2, 2, "claim", "x", 1, 100, "failed"), (2, 3, "complete", "x", 1, 105, "failed"), (3, 4, "claim", "y", 1, 500, "failed")]
    source = str(tmp_path / "in")
    like = spark.createDataFrame(rows, COMMANDS)
    for part in (rows[:3], rows[3:], [(3, 5, "claim", "y", 1, 501, "failed")]):
        spark.createDataFrame(part, COMMANDS).coalesce(1).write.mode("append").parquet(source)
        stream = events.read_stream(spark, source, like).withColumn("time", F.timestamp_seconds("at")).withWatermark("time", "10 seconds")
        with folds.state_store(spark):
            folds.lease_stream(stream, 50, notify=True).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.job_id, r.fencing_token) for r in got if r.outcome == "lapsed"] == [(1, 1)]
    assert {r.command_id for r in got if r.outcome == "claimed"} == {1, 2, 4} and {r.command_id for r in got if r.outcome == "busy"} == {5}


def test_admission(spark):
    rng = random.Random(4)
    rows = [(f"p{rng.randrange(3)}", "USD", i, rng.randrange(50), rng.randint(1, 40)) for i in range(800)]
    used, want = {}, {}
    for period, _, request, _, amount in sorted(rows, key=lambda r: (r[0], r[3], r[2])):
        fits = used.get(period, 0) + amount <= 3000
        used[period] = used.get(period, 0) + amount * fits
        want[request] = "reserved" if fits else "blocked"
    df = spark.createDataFrame(rows, "period string, currency string, request_id long, at long, amount long").repartition(4)
    assert {r.request_id: r.decision for r in ledgers.admitted(df, 3000).collect()} == want

"""Ledgers: budgets, deliveries and their attempts, and states that follow from states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.folds import Step, folded

#: What a delivery is, by the state of its outbox and its digest.
DELIVERY_STATUS = {
    ("pending", "queued"): "pending",
    ("sending", "queued"): "sending",
    ("provider_accepted", "sent"): "sent",
    ("failed", "queued"): "failed",
    ("unknown", "unknown"): "unknown",
    ("cancelled", "cancelled"): "cancelled",
}
#: By what a sender reports, the states of attempt, outbox, digest and ledger; anything else makes all unknown.
SENT_STATES = {
    "provider_accepted": ("provider_accepted", "provider_accepted", "sent", "accepted"),
    "retryable": ("failed", "pending", "queued", "reserved"),
    "rejected": ("failed", "failed", "queued", "reserved"),
}


def budget_used(reservations: DataFrame) -> DataFrame:
    """(period, currency, used) of reservations(period, currency, state, reserved, actual): settled ones count as what they
    cost, open and unknown ones as what was set aside, released ones nothing."""
    amount = F.when(F.col("state") == "settled", F.col("actual")).when(F.col("state").isin("reserved", "unknown"), F.col("reserved")).otherwise(0)
    return reservations.groupBy("period", "currency").agg(F.coalesce(F.sum(amount), F.lit(0)).alias("used"))


ADMITTED = "period string, currency string, request_id long, decision string"


def admission(limit: int) -> Step:
    """A request is reserved unless it would pass the limit; a blocked one leaves room for a smaller later one."""

    def step(state: tuple, row: dict) -> tuple[tuple, tuple]:
        fits = state[0] + row["amount"] <= limit
        return (state[0] + row["amount"] * fits,), (row["period"], row["currency"], row["request_id"], "reserved" if fits else "blocked")

    return step


def admitted(requests: DataFrame, limit: int) -> DataFrame:
    """requests(period, currency, request_id, at, amount) with decision, by time and id in each period and currency; see `admission`."""
    rows = requests.select("period", "currency", "request_id", "at", "amount")
    return folded(rows, ["period", "currency"], ["at", "request_id"], (0,), admission(limit), ADMITTED)


def known_runs(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """requests(fingerprint, ...) with outcome and run_id by runs(run_id, fingerprint, state, output): cached where one succeeded,
    in_progress where one is open, corrupt where two did or are, or no output was kept; new otherwise, which `admitted` decides."""
    done, open_ = F.col("state") == "succeeded", F.col("state").isin("reserved", "running")
    own = runs.groupBy("fingerprint").agg(
        F.count_if(done).alias("_done"), F.count_if(open_).alias("_open"), F.bool_or(done & F.col("output").isNull()).alias("_lost"),
        F.min(F.when(done, F.col("run_id"))).alias("_done_id"), F.min(F.when(open_, F.col("run_id"))).alias("_open_id"),
    )
    corrupt = (F.col("_done") > 1) | F.col("_lost") | ((F.col("_done") == 0) & (F.col("_open") > 1))
    outcome = F.when(corrupt, "corrupt").when(F.col("_done") == 1, "cached").when(F.col("_open") == 1, "in_progress").otherwise("new")
    rows = requests.join(own, "fingerprint", "left").withColumn("outcome", outcome)
    run_id = F.when(F.col("outcome") == "cached", F.col("_done_id")).when(F.col("outcome") == "in_progress", F.col("_open_id"))
    return rows.withColumn("run_id", run_id).drop("_done", "_open", "_lost", "_done_id", "_open_id")


def with_attempts(parents: DataFrame, attempts: DataFrame, key: str) -> DataFrame:
    """parents with n_attempts and last_error of attempts(key, attempt_no, error); zero and null where there are none."""
    own = attempts.groupBy(key).agg(F.count("*").alias("n_attempts"), F.max_by("error", "attempt_no").alias("last_error"))
    return parents.join(own, key, "left").withColumn("n_attempts", F.coalesce("n_attempts", F.lit(0).cast("long")))


def paired(table: dict[tuple[str, str], str], first: Column, second: Column) -> Column:
    """By a closed table of pairs; `corrupt` for any other."""
    out = F.lit("corrupt")
    for (a, b), status in table.items():
        out = F.when((first == a) & (second == b), status).otherwise(out)
    return out


def sent_states(result: Column) -> Column:
    """struct(attempt, outbox, digest, ledger) after a dispatch."""
    names = ("attempt", "outbox", "digest", "ledger")
    state = lambda values: F.struct(*(F.lit(v).alias(n) for n, v in zip(names, values, strict=True)))
    out = state(("unknown",) * 4)
    for name, values in SENT_STATES.items():
        out = F.when(result == name, state(values)).otherwise(out)
    return out


def settled_state(state: Column, outcome: Column) -> Column:
    """What a reservation becomes: settled when it went well, released when nothing was charged, else unknown."""
    return F.when(state != "reserved", state).when(outcome == "success", "settled").when(outcome == "no_charge", "released").otherwise("unknown")


def verdict(rows: DataFrame, key: str) -> DataFrame:
    """(key, verdict) of rows(key, finding): rejected if any is unsupported, pending if any is uncertain, else passed."""
    has = lambda f: F.bool_or(F.col("finding") == f)
    return rows.groupBy(key).agg(F.when(has("unsupported"), "rejected").when(has("uncertain"), "pending").otherwise("passed").alias("verdict"))


def tick(jobs: DataFrame, most_new: int) -> DataFrame:
    """jobs(job_key, replayed, place) with decision: replays are free, of new ones the first most_new are taken, the rest deferred."""
    last = jobs.where(~F.col("replayed")).orderBy("place").limit(most_new).agg(F.max("place").alias("_last"))  # one row
    taken = F.coalesce(F.col("place") <= F.col("_last"), F.lit(False))
    return jobs.crossJoin(F.broadcast(last)).withColumn("decision", F.when(F.col("replayed"), "replayed").when(taken, "enqueued").otherwise("deferred")).drop("_last")


def claimable(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs that are due and free (or whose lease has run out), by due time, then id."""
    free = F.col("state").isin("pending", "failed", "awaiting") | ((F.col("state") == "running") & (F.col("lease_until") <= now))
    return jobs.where((F.col("due_at") <= now) & free).orderBy("due_at", "job_key")


def catchup_windows(bindings: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """(binding, window_no, from_at, until_at): whole windows from each binding's last_end up to now."""
    step = f"INTERVAL {hours} HOURS"
    n = F.floor((F.unix_micros(now) - F.unix_micros("last_end")) / F.lit(hours * 3_600_000_000)).cast("int")
    rows = bindings.withColumn("_n", n).where("_n > 0").select("binding", "last_end", F.posexplode(F.sequence(F.lit(0), F.col("_n") - 1)))
    start = F.timestamp_micros(F.unix_micros("last_end") + F.col("col").cast("long") * F.lit(hours * 3_600_000_000))
    return rows.select("binding", F.col("col").alias("window_no"), start.alias("from_at"), (start + F.expr(step)).alias("until_at"))


def distinct_states(rows: DataFrame, key: str, state: str = "state") -> DataFrame:
    """(key, states, agreed): the different states of each key in order, and whether there is just one."""
    found = rows.groupBy(key).agg(F.sort_array(F.collect_set(state)).alias("states"))
    return found.withColumn("agreed", F.size("states") == 1)


def same_in_any_order(left: Column, right: Column) -> Column:
    """Whether two lists have the same entries as often, whatever their order; two nulls are the same."""
    return F.array_sort(left).eqNullSafe(F.array_sort(right))

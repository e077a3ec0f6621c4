"""Leases on jobs, replayed from a log of commands: what each command came to."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quillmark.operators.folds import Step, folded

SCHEMA = "job_id long, command_id long, outcome string, fencing_token long"
#: A job before its first command, and what is kept of it: its state, the running lease, and the last completion.
START = ("pending", None, 0, None, None, None, None)
STATE = "state string, owner string, token long, until long, last_owner string, last_token long, last_state string"


def command(lease: int) -> Step:
    """claim: claimed with the next token if the job is free or its lease has run out, else busy; finished once it succeeded. complete: completed with the
    running lease's owner and token while it lasts; the same one again is replayed; else lease_expired or fencing_mismatch."""

    def step(state: tuple, row: dict) -> tuple[tuple, tuple]:
        kind, owner, token, until, *last = state
        by = None if row["owner"] is None else str(row["owner"])
        if row["kind"] == "claim":
            if kind == "succeeded":
                outcome = "finished"
            elif kind == "running" and until > row["at"]:
                outcome = "busy"
            else:
                outcome, state = "claimed", ("running", by, token + 1, row["at"] + lease, None, None, None)
        elif kind != "running":
            outcome = "replayed" if last == [by, row["token"], row["state"]] else "fencing_mismatch"
        elif (owner, token) != (by, row["token"]):
            outcome = "fencing_mismatch"
        elif until <= row["at"]:
            outcome = "lease_expired"
        else:
            outcome, state = "completed", (row["state"], owner, token, until, by, row["token"], row["state"])
        return state, (row["job_id"], row["command_id"], outcome, state[2])

    return step


def replayed(commands: DataFrame, lease: int) -> DataFrame:
    """(job_id, command_id, outcome, fencing_token) of commands(job_id, command_id, kind, owner, token, at, state), by time and id in each job; see `command`.
    Completed jobs stay free unless they succeeded."""
    return folded(commands, ["job_id"], ["at", "command_id"], START, command(lease), SCHEMA)

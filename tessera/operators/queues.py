"""Queue and state semantics as batch queries: claims of jobs, leases, retries, cursors, state machines and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The state machine's moves; any other event leaves the state as it is.
MOVES = {
    ("IDLE", "START"): "IN_PROGRESS", ("IN_PROGRESS", "COMPLETE"): "COMPLETED", ("IN_PROGRESS", "FAIL"): "FAILED",
    ("COMPLETED", "RESET"): "IDLE", ("FAILED", "RESET"): "IDLE", ("IN_PROGRESS", "RESET"): "IDLE",
}


def claimable(jobs: DataFrame, now: Column, most_attempts: int, limit: int) -> DataFrame:
    """The jobs that a worker may take: pending, attempts left, due; by priority, due time and id."""
    due = (F.col("status") == "PENDING") & (F.col("attempts") < most_attempts) & (F.coalesce(F.col("next_at"), now) <= now)
    return jobs.where(due).orderBy(F.desc("priority"), "next_at", "job_id").limit(limit)


def recovered(status: Column, lease: Column, attempts: Column, now: Column, most_attempts: int) -> Column:
    """Running jobs whose lease has ended go back, or fail when out of attempts."""
    lost = (status == "RUNNING") & (lease < now)
    return F.when(lost & (attempts >= most_attempts), "FAILED").when(lost, "PENDING").otherwise(status)


def cursor_state(scopes: Column, processed: Column) -> Column:
    """A cursor goes on only when there is a scope and all scopes are processed."""
    return F.when((scopes > 0) & (processed == scopes), "ADVANCED").otherwise("OPEN")


def next_state(state: Column, event: Column) -> Column:
    out = state
    for (s, e), to in MOVES.items():
        out = F.when((state == s) & (event == e), to).otherwise(out)
    return out


def final_states(events: DataFrame, key: str, order: list[str], event: str, start: str = "IDLE") -> DataFrame:
    """(key, state, moves): the state machine folded over each key's events in order; moves counts those that changed it."""
    seq = F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(event).alias("_e")))), lambda x: x["_e"])

    def step(acc: Column, e: Column) -> Column:
        to = next_state(acc["state"], e)
        return F.struct(to.alias("state"), (acc["moves"] + F.when(to != acc["state"], 1).otherwise(0)).alias("moves"))

    first = F.struct(F.lit(start).alias("state"), F.lit(0).alias("moves"))
    return events.groupBy(key).agg(F.aggregate(seq, first, step).alias("_s")).select(key, F.col("_s.state").alias("state"), F.col("_s.moves").alias("moves"))


def first_rule(facts: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """(key, assessment): per key the rule of smallest priority whose conditions (rule, priority, name, least, assessment)
    all hold for its facts (key, name, value); DEFAULT where none does.  Whether the rules are broadcast is left to Spark, which
    knows their size."""
    size = rules.groupBy("rule", "priority", "assessment").agg(F.count(F.lit(1)).alias("n"))
    held = facts.join(rules.select("rule", "name", "least"), "name").where(F.col("value") >= F.col("least"))
    held = held.groupBy(key, "rule").agg(F.count(F.lit(1)).alias("h")).join(size, "rule").where("h = n")
    best = held.groupBy(key).agg(F.min_by("assessment", "priority").alias("assessment"))
    return facts.select(key).distinct().join(best, key, "left").select(key, F.coalesce("assessment", F.lit("DEFAULT")).alias("assessment"))


def batch_status(total: Column, done: Column, failed: Column, running: Column) -> Column:
    return (
        F.when(total == 0, "EMPTY").when((done + failed == total) & (failed > 0), "PARTIAL_FAILED").when(done == total, "COMPLETED")
        .when(running > 0, "RUNNING").otherwise("PENDING")
    )


def backoff(attempt: Column) -> Column:
    """Seconds until the next attempt."""
    return F.least(F.lit(300.0), F.pow(F.lit(2.0), F.greatest(attempt, F.lit(1))))

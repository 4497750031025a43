"""Versioned upserts and a leased task log.

State is an append-only event log; the current state of a key is its latest
row.  One coordinator claims tasks, so this makes no promise about concurrent
claims; every transition is guarded by the claim token and the lease, so a
stale worker changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .classify import BadInput

TARGETS = ("vector", "graph")
LEASE_SECONDS, RETRY_SECONDS, MAX_ERROR_BYTES = 300, 60, 2000


def check_seconds(lease: int = LEASE_SECONDS, delay: int = RETRY_SECONDS) -> None:
    if type(lease) is not int or lease <= 0 or type(delay) is not int or delay < 0:
        raise BadInput("the lease must be positive and the delay not negative")


def latest(log: DataFrame, key: list[str], version: str) -> DataFrame:
    """The row of each key with the largest version; aggregated, not windowed, so hot keys combine early."""
    rest = [c for c in log.columns if c not in key]
    best = log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_row"))
    return best.select(*key, *(F.col("_row")[c].alias(c) for c in rest))


def upserted(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """Last writer wins by key."""
    return latest(old.unionByName(new), key, version)


def fan_out(artifacts: DataFrame, models: DataFrame) -> DataFrame:
    """One task for every stored artifact with a model and every target."""
    both = artifacts.join(models, "artifact_id")
    return both.withColumn("target", F.explode(F.array(*map(F.lit, TARGETS))))


def enqueued(state: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """State after enqueueing wanted(artifact_id, target, payload).

    New keys begin at generation 1, pending; a key whose payload is distinct
    from the stored one gets the next generation and starts over; an unchanged
    payload changes nothing, finished tasks included.
    """
    key = ["artifact_id", "target"]
    s, w = state.alias("s"), wanted.alias("w")
    joined = s.join(w, [F.col(f"s.{k}") == F.col(f"w.{k}") for k in key], "full_outer")
    new, gone = F.col("s.artifact_id").isNull(), F.col("w.artifact_id").isNull()
    changed = ~gone & ~new & ~F.col("s.payload").eqNullSafe(F.col("w.payload"))
    reset = new | changed
    pick = lambda fresh, name: F.when(reset, fresh).otherwise(F.col(f"s.{name}")).alias(name)
    return joined.select(
        *(F.coalesce(F.col(f"s.{k}"), F.col(f"w.{k}")).alias(k) for k in key), pick(F.col("w.payload"), "payload"),
        F.when(new, 1).when(changed, F.col("s.generation") + 1).otherwise(F.col("s.generation")).cast("long").alias("generation"),
        pick(F.lit("pending"), "status"), pick(F.lit(0), "attempts"), pick(F.lit(None).cast("long"), "claim_token"), pick(F.lit(None).cast("timestamp_ntz"), "lease_until"), pick(now, "available_at"),
    )


def claimable(state: DataFrame, now: Column) -> DataFrame:
    """Pending or failed tasks that are due, and running ones whose lease ran out."""
    due = F.col("status").isin("pending", "failed") & (F.col("available_at") <= now)
    lost = (F.col("status") == "running") & (F.col("lease_until") <= now)
    return state.filter(due | lost)


def next_claims(state: DataFrame, now: Column, per_target: int = 1, order: tuple[str, ...] = ("available_at", "id")) -> DataFrame:
    """The tasks to claim next for each target, oldest first."""
    by = Window.partitionBy("target").orderBy(*order)
    return claimable(state, now).withColumn("turn", F.row_number().over(by)).filter(F.col("turn") <= per_target)


def claimed(tasks: DataFrame, now: Column, first_token: int, lease: int = LEASE_SECONDS, order: tuple[str, ...] = ("target", "available_at", "id")) -> DataFrame:
    """Claimed rows: running, one attempt more, a fresh token and a lease."""
    check_seconds(lease)
    number = F.row_number().over(Window.orderBy(*order))  # at most the claims of one run
    return tasks.withColumns({"status": F.lit("running"), "attempts": F.col("attempts") + 1, "claim_token": number + (first_token - 1), "lease_until": now + F.make_dt_interval(secs=F.lit(lease))})


def held(state: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Requests(id, claim_token, …) with `ok`: whether the claim still holds."""
    own = state.select("id", F.col("claim_token").alias("_token"), F.col("status").alias("_status"), F.col("lease_until").alias("_lease"))
    ok = (F.col("claim_token") == F.col("_token")) & (F.col("_status") == "running") & (F.col("_lease") > now)
    return requests.join(own, "id", "left").withColumn("ok", F.coalesce(ok, F.lit(False))).drop("_token", "_status", "_lease")


def error_text(message: Column) -> Column:
    """Without NUL, at most 2000 bytes, cut at a character."""
    clean = F.replace(message, F.lit("\0"), F.lit(""))
    cut = F.make_valid_utf8(F.substr(F.encode(clean, "UTF-8"), F.lit(1), F.lit(MAX_ERROR_BYTES)).cast("string"))
    return F.when(F.octet_length(clean) <= MAX_ERROR_BYTES, clean).otherwise(F.regexp_replace(cut, "�+$", ""))


def transitions(state: DataFrame, requests: DataFrame, now: Column, lease: int = LEASE_SECONDS, delay: int = RETRY_SECONDS) -> DataFrame:
    """State after requests(id, claim_token, action, error): complete, fail or renew where the claim holds."""
    check_seconds(lease, delay)
    good = held(state, requests, now).filter("ok").select("id", "action", "error")
    joined = state.join(good, "id", "left")
    act = F.col("action")
    return joined.withColumns({
        "status": F.when(act == "complete", "completed").when(act == "fail", "failed").otherwise(F.col("status")),
        "available_at": F.when(act == "fail", now + F.make_dt_interval(secs=F.lit(delay))).otherwise(F.col("available_at")),
        "lease_until": F.when(act == "renew", now + F.make_dt_interval(secs=F.lit(lease))).when(act.isin("complete", "fail"), None).otherwise(F.col("lease_until")),
        "claim_token": F.when(act.isin("complete", "fail"), None).otherwise(F.col("claim_token")),
        "last_error": F.when(act == "fail", error_text(F.col("error"))).when(act == "complete", None).otherwise(F.col("last_error")),
    }).select(*state.columns)


def broken_constraints(artifacts: DataFrame, tasks: DataFrame) -> DataFrame:
    """(rule, key) of duplicate places, duplicate task keys, orphans and unknown states."""
    place = artifacts.groupBy("source_uri", "revision", "path").agg(F.count("*").alias("n")).filter("n > 1")
    twice = tasks.groupBy("artifact_id", "target").agg(F.count("*").alias("n")).filter("n > 1")
    orphan = tasks.join(artifacts, "artifact_id", "left_anti")
    unknown = tasks.filter(~F.col("status").isin("pending", "running", "completed", "failed") | ~F.col("target").isin(*TARGETS))
    name = lambda rule, *c: [F.lit(rule).alias("rule"), F.concat_ws("/", *c).alias("key")]
    return place.select(*name("place", "source_uri", "revision", "path")).unionAll(twice.select(*name("task", "artifact_id", "target"))).unionAll(orphan.select(*name("orphan", "artifact_id", "target"))).unionAll(unknown.select(*name("state", "artifact_id", "target")))

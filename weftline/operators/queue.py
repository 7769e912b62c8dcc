"""The durable queue as pure transitions of DataFrames.

One writer commits what these return (see sources.state); clocks, tokens and random numbers are arguments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["configuration_id", "entity", "source_id"]
ORIGINS = ("trigger", "polling", "backfill", "manual")
LIVE = ("active", "staging")
LEASE = ("lease_token", "lease_until", "execution_deadline")


def eligible(rows: DataFrame, revisions: DataFrame) -> DataFrame:
    """Rows whose (configuration_id, entity) is a live revision."""
    return rows.join(revisions.where(F.col("state").isin(*LIVE)), ["configuration_id", "entity"], "left_semi")


def fold_requests(requests: DataFrame) -> DataFrame:
    """Requests (key, operation, origin, seq) folded to one row a key: n, the operation of the last."""
    return requests.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max_by("operation", "seq").alias("operation"))


def coalesced_of(status: Column, generation: Column, processed: Column, n: Column) -> Column:
    """How many of n requests of a key coalesce with one that is already due; nulls mean a new key."""
    g, p = F.coalesce(generation, F.lit(0)), F.coalesce(processed, F.lit(0))
    fresh = F.greatest(F.lit(0), F.least(n, p + 1 - g))
    return F.when(F.coalesce(status.isin("processing", "failed"), F.lit(False)), n).otherwise(n - fresh)


def enqueue(tasks: DataFrame, requests: DataFrame, revisions: DataFrame, now: Column) -> DataFrame:
    """The tasks that requests touch, after them: one row a key, with n and coalesced.

    Requests of a revision that isn't live are dropped.  The table after a commit is this and the untouched tasks.
    """
    folded = fold_requests(eligible(requests, revisions)).withColumnRenamed("operation", "op")
    old = tasks.select(*KEY, "status", "generation", "processed_generation", "attempts", "retry_generation", "next_attempt_at", "last_error")
    both = folded.join(old, KEY, "left")
    keep = F.coalesce(F.col("status").isin("processing", "failed"), F.lit(False))
    generation = F.coalesce("generation", F.lit(0)) + F.col("n")
    return both.select(
        *KEY,
        F.col("op").alias("operation"),
        F.when(keep, F.col("status")).otherwise(F.lit("pending")).alias("status"),
        generation.alias("generation"),
        F.coalesce("processed_generation", F.lit(0)).alias("processed_generation"),
        F.when(keep, F.col("attempts")).otherwise(F.lit(0)).cast("long").alias("attempts"),
        F.when(keep, F.col("retry_generation")).otherwise(F.when(F.col("status").isNull(), F.lit(1)).otherwise(generation)).cast("long").alias("retry_generation"),
        F.when(keep, F.col("next_attempt_at")).otherwise(now).alias("next_attempt_at"),
        now.alias("requested_at"),
        F.when(F.col("status") == "failed", F.col("last_error")).alias("last_error"),
        F.col("n").alias("n"),
        coalesced_of(F.col("status"), F.col("generation"), F.col("processed_generation"), F.col("n")).alias("coalesced"),
    )


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``new`` over ``old`` by key."""
    return old.join(new, key, "left_anti").unionByName(new.select(*old.columns))


def insert_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.unionByName(new.join(old, key, "left_anti").select(*old.columns))


def counters(enqueued: DataFrame, shards: int = 16) -> DataFrame:
    """Increments (entity, shard, enqueued, coalesced) of what ``enqueue`` returned."""
    from ..functions.misc import shard

    return enqueued.groupBy("entity", shard(F.col("source_id"), shards).alias("shard")).agg(F.sum("n").alias("enqueued"), F.sum("coalesced").alias("coalesced"))


def claimable(tasks: DataFrame, revisions: DataFrame, now: Column) -> DataFrame:
    """Pending tasks that are due and processing ones whose lease ran out, of live revisions."""
    due = (F.col("status") == "pending") & (F.col("next_attempt_at") <= now)
    lost = (F.col("status") == "processing") & (F.col("lease_until") < now)
    return eligible(tasks.where(due | lost), revisions)


def claim(tasks: DataFrame, revisions: DataFrame, now: Column, n: int, token: str, lease_s: int = 60, most_s: int = 300) -> DataFrame:
    """The first n claimable tasks, oldest request first, as they are once claimed."""
    first = claimable(tasks, revisions, now).orderBy("requested_at", "id").limit(n)
    again = F.col("retry_generation") == F.col("generation")
    return first.select(
        "id", *KEY, F.lit("processing").alias("status"),
        F.when(again, F.col("attempts") + 1).otherwise(F.lit(1)).cast("long").alias("attempts"),
        F.col("generation").alias("retry_generation"), F.lit(token).alias("lease_token"), now.alias("execution_started_at"),
        (now + F.make_dt_interval(secs=F.lit(most_s))).alias("execution_deadline"),
        (now + F.make_dt_interval(secs=F.lit(min(lease_s, most_s)))).alias("lease_until"),
    )


def renew(tasks: DataFrame, token: str, now: Column, lease_s: int = 60) -> DataFrame:
    """Leases that this token holds and that haven't run out, moved on, at most to the deadline."""
    until = F.least(F.col("execution_deadline"), now + F.make_dt_interval(secs=F.lit(lease_s)))
    return tasks.where(held(F.lit(token), now)).withColumn("lease_until", until)


def held(token: Column, now: Column) -> Column:
    """Whether a task is processed under this token, within its lease and its deadline."""
    owned = (F.col("lease_token") == token) & (F.col("status") == "processing") & (F.col("lease_until") > now) & (F.col("execution_deadline") > now)
    return F.coalesce(owned, F.lit(False))


def finalize(work: DataFrame, now: Column) -> DataFrame:
    """The outcome of each finished work, first match wins, and the task after it.

    ``work``: task columns, live (boolean), token, seen_generation, seen_fingerprint, fingerprint (null if the source is
    gone), stored_fingerprint, has_vector.  A discarded work leaves the task as it is.
    """
    moved = (F.col("generation") != F.col("seen_generation")) | ~F.col("fingerprint").eqNullSafe(F.col("seen_fingerprint"))
    outcome = (
        F.when(~F.coalesce("live", F.lit(False)), "discard")
        .when(~held(F.col("token"), now), "discard")
        .when(moved, "requeue")
        .when(F.col("fingerprint").isNull(), "delete")
        .when(F.col("has_vector"), "upsert")
        .when(~F.col("stored_fingerprint").eqNullSafe(F.col("fingerprint")), "requeue")
        .otherwise("unchanged")
    )
    rows = work.withColumn("outcome", outcome)
    done, again, same = F.col("outcome").isin("delete", "upsert", "unchanged"), F.col("outcome") == "requeue", F.col("outcome") == "discard"
    return rows.select(
        "id", "outcome",
        F.when(done, "done").when(again, "pending").otherwise(F.col("status")).alias("new_status"),
        F.when(done, F.col("generation")).otherwise(F.col("processed_generation")).alias("new_processed"),
        F.when(again, F.lit(0)).otherwise(F.col("attempts")).cast("long").alias("new_attempts"),
        F.when(again, F.col("generation")).otherwise(F.col("retry_generation")).alias("retry_generation"),
        F.when(again, now).otherwise(F.col("requested_at")).alias("requested_at"),
        F.when(again, now).otherwise(F.col("next_attempt_at")).alias("next_attempt_at"),
        F.when(done, now).otherwise(F.col("completed_at")).alias("completed_at"),
        F.when(~done, F.col("last_error")).alias("last_error"), F.when(~done, F.col("error_code")).alias("error_code"),
        *[F.when(same, F.col(c)).alias(c) for c in LEASE],
    )


def fail(work: DataFrame, now: Column, limit: int) -> DataFrame:
    """Failed work and the task after it: task columns, token, seen_generation, aborted, code, retryable, delay_ms.

    Only the owner of a task in process changes it; another's work is discarded and leaves the task as it is.
    """
    owned = F.coalesce((F.col("lease_token") == F.col("token")) & (F.col("status") == "processing"), F.lit(False))
    moved, aborted = F.col("generation") != F.col("seen_generation"), F.col("aborted")
    retry = F.col("retryable") & (F.col("attempts") < limit)
    after = F.when(moved | aborted | retry, "pending").otherwise(F.lit("failed"))
    at = F.when(moved | aborted, now).otherwise(now + F.make_dt_interval(secs=(F.col("delay_ms") / 1000).cast("decimal(18,6)")))
    code = F.when(aborted, F.lit("execution_interrupted")).otherwise(F.col("code"))
    outcome = F.when(~owned, "task_discarded").when(after == "failed", "task_failed").when(retry, "task_retry_scheduled").otherwise("task_requeued")
    rows = work.select("*", owned.alias("owned"), outcome.alias("outcome"))
    mine = F.col("owned")
    return rows.select(
        "id", "outcome",
        F.when(mine, after).otherwise(F.col("status")).alias("new_status"),
        F.when(mine & moved, F.lit(0)).otherwise(F.col("attempts")).cast("long").alias("new_attempts"),
        F.when(mine, F.col("generation")).otherwise(F.col("retry_generation")).alias("retry_generation"),
        F.when(mine, at).otherwise(F.col("next_attempt_at")).alias("next_attempt_at"),
        F.when(mine, now).otherwise(F.col("requested_at")).alias("requested_at"),
        F.when(mine, code).otherwise(F.col("error_code")).alias("error_code"),
        *[F.when(~mine, F.col(c)).alias(c) for c in LEASE],
    )


def unchanged(work: DataFrame) -> DataFrame:
    """Claimed work that needs no vector (T07): the source is there and its fingerprint is the stored one."""
    return work.where(F.col("fingerprint").isNotNull() & F.col("fingerprint").eqNullSafe(F.col("stored_fingerprint")))


def to_embed(work: DataFrame) -> DataFrame:
    """Claimed work that needs a vector: the source is there and its fingerprint is not the stored one."""
    return work.where(F.col("fingerprint").isNotNull() & ~F.col("fingerprint").eqNullSafe(F.col("stored_fingerprint")))


def reprocess(tasks: DataFrame, revision: int, entity: str, now: Column, source_id: str | None = None) -> DataFrame:
    """Failed tasks of a revision's entity, requested anew."""
    rows = tasks.where((F.col("status") == "failed") & (F.col("configuration_id") == revision) & (F.col("entity") == entity))
    if source_id is not None:
        rows = rows.where(F.col("source_id") == source_id)
    g = F.col("generation") + 1
    return rows.select("id", *KEY, F.lit("pending").alias("status"), g.alias("generation"), g.alias("retry_generation"), F.lit(0).cast("long").alias("attempts"), now.alias("requested_at"))


def legacy_fold(rows: DataFrame) -> DataFrame:
    """A queue with one row a request becomes one with one row a key."""
    return rows.groupBy(*KEY).agg(
        F.min("id").alias("id"), F.sum("generation").alias("generation"), (F.max("attempts") + 1).alias("attempts"),
        F.bool_or(F.col("status") == "failed").alias("any_failed"), F.max_by("operation", "id").alias("operation"), F.max("last_error").alias("last_error"),
    )


def burst_positions(requests: DataFrame) -> DataFrame:
    """Position of each request within its key, and whether it coalesces on a new key."""
    pos = F.row_number().over(Window.partitionBy(*KEY).orderBy("seq"))
    return requests.withColumn("position", pos.cast("long")).withColumn("coalesced", F.col("position") > 1)

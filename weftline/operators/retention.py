"""Retention: what a cleanup pass may remove."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _free() -> Column:
    """No lease is left on a task."""
    return F.col("lease_token").isNull() & F.col("lease_until").isNull() & F.col("execution_deadline").isNull()


def completed(tasks: DataFrame, cutoff: Column, n: int) -> DataFrame:
    """The oldest finished tasks up to the cutoff, included, that no lease is left on."""
    done = (F.col("status") == "done") & (F.col("processed_generation") == F.col("generation")) & (F.col("completed_at") <= cutoff) & _free()
    return tasks.where(done).orderBy("completed_at", "id").limit(n)


def superseded(tasks: DataFrame, revisions: DataFrame, n: int) -> DataFrame:
    """Superseded tasks that nothing is left to learn from, of retired and cleaned revisions."""
    gone = revisions.where((F.col("state") == "retired") & F.col("cleaned_at").isNotNull()).select("configuration_id", "entity")
    plain = (F.col("status") == "superseded") & F.col("superseded_from_status").isin("pending", "processing") & F.col("last_error").isNull() & F.col("error_code").isNull()
    return tasks.where(plain & _free()).join(gone, ["configuration_id", "entity"]).orderBy("id").limit(n)


def retired_positions(revisions: DataFrame) -> DataFrame:
    """Retired revisions of each entity that are not cleaned yet, the last retired first; without a time first of all."""
    order = Window.partitionBy("entity").orderBy(F.col("retired_at").desc_nulls_first(), F.col("configuration_id").desc())
    return revisions.where("state = 'retired' and cleaned_at is null").withColumn("position", F.row_number().over(order).cast("long"))


def protected_tables(revisions: DataFrame) -> DataFrame:
    """(destination): the tables that live revisions write, read or depend on."""
    used = F.concat(F.array("destination", "source_table"), F.coalesce("dependency_tables", F.array().cast("array<string>")))
    return revisions.where(F.col("state").isin("active", "staging")).select(F.explode(used).alias("destination")).where("destination is not null").distinct()


def destinations(revisions: DataFrame, keep: int, cutoff: Column, now: Column, n: int) -> DataFrame:
    """Destinations of retired revisions that may go: beyond the kept ones, retired before the cutoff, with no execution that
    may still run, not in use by a live revision and not shared with another retired one that is not cleaned."""
    spots = retired_positions(revisions)
    over = F.col("retired_execution_until").isNull() | (F.col("retired_execution_until") <= now)
    old = spots.where((F.col("position") > keep) & (F.col("retired_at") <= cutoff) & over)
    single = spots.groupBy("destination").agg(F.count(F.lit(1)).alias("users")).where("users = 1").select("destination")
    free = old.join(single, "destination", "left_semi").join(protected_tables(revisions), "destination", "left_anti")
    return free.orderBy("configuration_id", "entity").limit(n)


def audit(actions: DataFrame, cutoff: Column, n: int) -> DataFrame:
    return actions.where(F.col("created_at") < cutoff).orderBy("created_at", "id").limit(n)


def cleanup(tasks: DataFrame, revisions: DataFrame, actions: DataFrame, policy: dict, now: Column) -> dict[str, DataFrame]:
    """One bounded pass (T13): the tables after it, and totals (completed, superseded, destinations, audit) as one row.

    ``policy``: completed_seconds, retired_seconds, reader_grace_seconds, audit_seconds (null: keep all), keep_retired,
    batch_size, drop_retired_destinations.  Each kind removes at most batch_size rows; the next pass goes on.
    """
    n, ago = policy["batch_size"], lambda s: now - F.make_dt_interval(secs=F.lit(s))
    done = completed(tasks, ago(policy["completed_seconds"]), n).select("id")
    dropped = destinations(revisions, policy["keep_retired"], ago(max(policy["retired_seconds"], policy["reader_grace_seconds"])), now, n)
    dropped = dropped.select("configuration_id", "entity").where(F.lit(bool(policy["drop_retired_destinations"])))
    cleaned = revisions.join(dropped.withColumn("__gone", F.lit(True)), ["configuration_id", "entity"], "left")
    cleaned = cleaned.withColumn("cleaned_at", F.when(F.col("__gone"), now).otherwise(F.col("cleaned_at"))).drop("__gone")
    obsolete = superseded(tasks, cleaned, n).select("id")
    old = audit(actions, ago(policy["audit_seconds"]), n).select("id") if policy.get("audit_seconds") is not None else actions.select("id").limit(0)
    totals = None
    for name, rows in (("completed", done), ("superseded", obsolete), ("destinations", dropped), ("audit", old)):
        one = rows.agg(F.count(F.lit(1)).alias(name))
        totals = one if totals is None else totals.join(F.broadcast(one))  # one row each
    return {
        "tasks": tasks.join(done.unionByName(obsolete), "id", "left_anti"), "revisions": cleaned,
        "actions": actions.join(old, "id", "left_anti"), "totals": totals,
    }

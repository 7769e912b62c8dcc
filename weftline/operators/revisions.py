"""Revisions of the configuration: import, look up, activation checks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def import_states(rows: DataFrame) -> DataFrame:
    """state of (configuration_id, entity): the last configuration of an entity is active, others are retired."""
    last = F.max("configuration_id").over(Window.partitionBy("entity"))
    return rows.withColumn("state", F.when(F.col("configuration_id") == last, "active").otherwise(F.lit("retired")))


def entities_of(configurations: DataFrame) -> DataFrame:
    """(id, name) of the entities that configurations, as JSON texts, declare."""
    parsed = F.from_json("configuration", "struct<entities: array<struct<name: string>>>")
    return configurations.select("id", F.explode(parsed["entities"]).alias("e")).select("id", F.col("e.name").alias("name"))


def active(revisions: DataFrame, configurations: DataFrame, state: str = "active") -> DataFrame:
    return revisions.where(F.col("state") == state).join(configurations, revisions["configuration_id"] == configurations["id"]).drop("id")


def blockers(tasks: DataFrame, mismatches: DataFrame, orphans: DataFrame) -> DataFrame:
    """(reason, n): what stands against an activation."""
    parts = [("unfinished_tasks", tasks.where("status <> 'done'")), ("stale_or_missing", mismatches), ("orphans", orphans)]
    out = None
    for reason, df in parts:
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(reason).alias("reason"), "n")
        out = one if out is None else out.unionByName(one)
    return out


class Refused(ValueError):
    """A revision is not in the state that a step needs."""


def _retire(revisions: DataFrame, tasks: DataFrame, gone: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(revisions, tasks) after the revisions ``gone`` (configuration_id, entity) retire: their unfinished tasks are superseded
    and lose their leases; the last deadline of these stays on the revision."""
    key = ["configuration_id", "entity"]
    deadline = tasks.groupBy(*key).agg(F.max("execution_deadline").alias("__until"))
    gone = gone.select(*key, F.lit(True).alias("__gone"))
    rows = revisions.join(gone, key, "left").join(deadline, key, "left")
    off = F.coalesce("__gone", F.lit(False))
    was = F.col("retired_execution_until") if "retired_execution_until" in revisions.columns else F.lit(None).cast("timestamp")
    rows = rows.withColumns({
        "state": F.when(off, "retired").otherwise(F.col("state")), "retired_at": F.when(off, now).otherwise(F.col("retired_at")),
        "retired_execution_until": F.when(off, F.col("__until")).otherwise(was),
    }).drop("__gone", "__until")
    jobs = tasks.join(gone, key, "left")
    ends = F.coalesce("__gone", F.lit(False)) & (F.col("status") != "done")
    before = F.col("superseded_from_status") if "superseded_from_status" in tasks.columns else F.lit(None).cast("string")
    after = {"superseded_from_status": F.when(ends, F.col("status")).otherwise(before), "status": F.when(ends, "superseded").otherwise(F.col("status"))}
    after |= {c: F.when(~ends, F.col(c)) for c in ("lease_token", "lease_until", "execution_deadline") if c in tasks.columns}
    return rows, jobs.withColumns(after).drop("__gone")


def _states(revisions: DataFrame, revision: int) -> dict[str, str]:
    """State of each entity of a revision: as many rows as a configuration has entities."""
    return {r["entity"]: r["state"] for r in revisions.where(F.col("configuration_id") == revision).select("entity", "state").collect()}


def stage(revisions: DataFrame, revision: int, entities: list[str]) -> DataFrame:
    """``revisions`` with a new one staged for each entity; active at once where the entity has no active revision yet."""
    if _states(revisions, revision):
        raise Refused(f"revision {revision} exists")
    spark = revisions.sparkSession
    new = spark.createDataFrame([(revision, e) for e in entities], "configuration_id long, entity string")
    live = revisions.where("state = 'active'").select("entity", F.lit(True).alias("__live")).distinct()
    new = new.join(live, "entity", "left").withColumn("state", F.when(F.col("__live"), "staging").otherwise("active")).drop("__live")
    return revisions.unionByName(new, allowMissingColumns=True)


def activate(revisions: DataFrame, tasks: DataFrame, revision: int, now) -> tuple[DataFrame, DataFrame]:
    """(revisions, tasks) after the staged revision becomes active for its entities: the active revisions of these retire, other
    entities stay as they are.  A revision that is active already changes nothing; one that is not staged, or has tasks that
    are not done, is refused.  See ``blockers`` for what else to ask before.
    """
    states = _states(revisions, revision)
    if states and set(states.values()) == {"active"}:
        return revisions, tasks
    if not states or set(states.values()) != {"staging"}:
        raise Refused("only a staged revision can be activated")
    if not tasks.where((F.col("configuration_id") == revision) & (F.col("status") != "done")).isEmpty():
        raise Refused("drain staged tasks before activation")
    new = revisions.where(F.col("configuration_id") == revision).select("entity")
    old = revisions.where((F.col("state") == "active") & (F.col("configuration_id") != revision)).join(new, "entity", "left_semi")
    rows, jobs = _retire(revisions, tasks, old, now)
    return rows.withColumn("state", F.when(F.col("configuration_id") == revision, "active").otherwise(F.col("state"))), jobs


def cancel(revisions: DataFrame, tasks: DataFrame, revision: int, now) -> tuple[DataFrame, DataFrame]:
    """(revisions, tasks) after a staged revision is given up: it retires and its unfinished tasks are superseded."""
    states = _states(revisions, revision)
    if not states or set(states.values()) != {"staging"}:
        raise Refused("only a staged revision can be cancelled")
    return _retire(revisions, tasks, revisions.where(F.col("configuration_id") == revision), now)


def action(spark, name: str, details: dict, at, id_: int) -> DataFrame:
    """A row of the audit (K06): id, action, details as JSON, created_at."""
    return spark.createDataFrame([(id_, name, json.dumps(details, sort_keys=True))], "id long, action string, details string").withColumn("created_at", at)

"""The loops that tie state, transitions and inference together: a worker's pass and a poller's pass.

Each reads a pinned version, works on DataFrames and commits what changes in one step; a pass that another writer overtook
ends in ``Conflict`` and is run again from the new version.  Clocks and tokens are arguments.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import polling, queue
from ..sources.state import State

TASKS, REVISIONS, VECTORS, CURSORS = "tasks", "revisions", "vectors", "cursors"


def claim(state: State, now: Column, n: int, token: str) -> int:
    """Commit the claim of the first ``n`` tasks that are due; the version after it."""
    at = state.version()
    tasks, revisions = state.read(TASKS, at), state.read(REVISIONS, at)
    taken = queue.claim(tasks, revisions, now, n, token)
    marks = taken.select("id", *[F.col(c).alias(f"__{c}") for c in taken.columns if c != "id"], F.lit(True).alias("__mine"))
    rows = tasks.join(F.broadcast(marks), "id", "left")  # at most n rows
    known = {f"__{c}" for c in taken.columns}
    after = rows.select(*[F.when(F.col("__mine"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if f"__{c}" in known and c != "id" else F.col(c) for c in tasks.columns])
    return state.commit({TASKS: after}, at)


def work(state: State, content: DataFrame, embed: Callable[[DataFrame], DataFrame], now: Column, token: str) -> dict[str, int]:
    """Do what ``token`` has claimed and commit it: outcomes and how many vectors were asked for.

    ``content``: (entity, source_id, content, fingerprint) of the sources as they are; ``embed`` gives (id, vector) for
    (id, content).  Work whose fingerprint is the stored one asks for no vector.
    """
    at = state.version()
    tasks, vectors = state.read(TASKS, at), state.read(VECTORS, at)
    mine = tasks.where((F.col("lease_token") == token) & (F.col("status") == "processing"))
    live = queue.eligible(mine, state.read(REVISIONS, at)).select("id", F.lit(True).alias("live"))
    known = vectors.select("entity", "source_id", F.col("fingerprint").alias("stored_fingerprint"))
    rows = mine.join(live, "id", "left").join(content, ["entity", "source_id"], "left").join(known, ["entity", "source_id"], "left")
    rows = rows.withColumns({"token": F.lit(token), "seen_generation": F.col("generation"), "seen_fingerprint": F.col("fingerprint")}).persist()
    found = embed(queue.to_embed(rows).select("id", "content")).persist()
    judged = rows.join(found.select("id", F.lit(True).alias("has_vector"), "vector"), "id", "left").withColumn("has_vector", F.coalesce("has_vector", F.lit(False)))
    done = queue.finalize(judged, now)
    outcome = done.withColumnsRenamed({"new_status": "status", "new_processed": "processed_generation", "new_attempts": "attempts"})
    changed = [c for c in outcome.columns if c in tasks.columns and c != "id"]
    turned = tasks.join(outcome.select("id", *[F.col(c).alias(f"__{c}") for c in changed], F.lit(True).alias("__mine")), "id", "left")
    after = turned.select(*[F.when(F.col("__mine"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in tasks.columns])
    told = judged.join(done.select("id", "outcome"), "id")
    gone = told.where("outcome in ('delete', 'upsert')").select("entity", "source_id")
    new = told.where("outcome = 'upsert'").select("entity", "source_id", F.col("vector").alias("embedding"), "fingerprint", "configuration_id")
    kept = vectors.join(gone, ["entity", "source_id"], "left_anti").unionByName(new.select(*vectors.columns))
    counts = {r["outcome"]: r["n"] for r in done.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()}  # five outcomes
    counts["embedded"] = found.count()
    state.commit({TASKS: after, VECTORS: kept}, at)
    rows.unpersist()
    found.unpersist()
    return counts


def poll(state: State, source: DataFrame, entity: str, stamp: str, key: str, configuration_id: int, window_end, now, n: int, overlap_s: int = 60) -> int:
    """Take one page of changed rows after the stored cursor, enqueue it and store the cursor, in one commit; the rows taken.

    The table of cursors has a row an entity: cursor_time, cursor_id (null: its time is included), window_end.
    """
    at = state.version()
    cursors, tasks, revisions = state.read(CURSORS, at), state.read(TASKS, at), state.read(REVISIONS, at)
    have = cursors.where(F.col("entity") == entity).first()
    end = have["window_end"] if have and have["window_end"] is not None else window_end
    page = polling.page_by_time(source, stamp, key, end, have["cursor_time"] if have else None, have["cursor_id"] if have else None, n)
    rows = page.select(stamp, key).collect()  # at most n rows
    time, last, window = polling.next_cursor([tuple(r) for r in rows], n, end, now, overlap_s)
    spark = source.sparkSession
    moved = spark.createDataFrame([(entity, time, last, window)], cursors.schema)
    asked = spark.createDataFrame([(configuration_id, entity, str(r[1]), "upsert", "polling", i) for i, r in enumerate(rows)], "configuration_id long, entity string, source_id string, operation string, origin string, seq long")
    asked = polling.recoverable(asked, tasks, queue.KEY)
    new = queue.enqueue(tasks, asked, revisions, F.lit(now))
    untouched = tasks.join(new, queue.KEY, "left_anti")
    ids = tasks.select(*queue.KEY, "id").unionByName(new.join(tasks, queue.KEY, "left_anti").select(*queue.KEY, F.xxhash64(*queue.KEY).alias("id")))
    after = untouched.unionByName(new.join(ids, queue.KEY).select(*[c for c in tasks.columns if c in {*new.columns, "id"}]), allowMissingColumns=True)
    state.commit({TASKS: after.select(*tasks.columns), CURSORS: cursors.where(F.col("entity") != entity).unionByName(moved)}, at)
    return len(rows)

"""Keyset scans, polling windows, backfill and reconciliation."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def page_by_key(df: DataFrame, key: str, after=None, upto=None, n: int = 100) -> DataFrame:
    if after is not None:
        df = df.where(F.col(key) > F.lit(after))
    if upto is not None:
        df = df.where(F.col(key) <= F.lit(upto))
    return df.orderBy(key).limit(n)


def page_by_time(df: DataFrame, stamp: str, key: str, window_end, cursor_time=None, cursor_id=None, n: int = 100) -> DataFrame:
    """Rows after the cursor, in order of (stamp, key).  Without a cursor_id the cursor's time is included."""
    df = df.where(F.col(stamp) <= F.lit(window_end))
    if cursor_time is not None:
        same = F.col(stamp) == F.lit(cursor_time)
        df = df.where((F.col(stamp) > F.lit(cursor_time)) | (same if cursor_id is None else same & (F.col(key) > F.lit(cursor_id))))
    return df.orderBy(stamp, key).limit(n)


def next_cursor(rows: list, n: int, window_end: datetime, now: datetime, overlap_s: int = 60) -> tuple:
    """(cursor_time, cursor_id, window_end) after a page of (stamp, key): a full one goes on, a short one starts over."""
    if len(rows) == n:
        return rows[-1][0], rows[-1][1], window_end
    return window_end - timedelta(seconds=overlap_s), None, now


def backfill_batches(df: DataFrame, key: str, n: int, parts: int = 64) -> DataFrame:
    """(key, batch) of all keys in order.  Ranks are made by range parts and the sizes of the parts before, not in one task."""
    from functools import reduce

    spark = df.sparkSession
    rows = df.select(key)
    cuts = rows.approxQuantile(key, [i / parts for i in range(1, parts)], 0.001) if dict(rows.dtypes)[key] in ("bigint", "int") else []
    part = reduce(lambda a, c: a + (F.col(key) > F.lit(c)).cast("int"), sorted(set(cuts)), F.lit(0))
    rows = rows.withColumn("part", part)
    sizes = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `parts` rows
    base, at = {}, 0
    for p in sorted(sizes):
        base[p], at = at, at + sizes[p]
    start = F.create_map(*[F.lit(x) for kv in (base or {0: 0}).items() for x in kv])[F.col("part")]
    rank = F.row_number().over(Window.partitionBy("part").orderBy(key)) + start - 1
    assert spark
    return rows.select(key, F.floor(rank / n).cast("long").alias("batch"))


def orphans(dest: DataFrame, src: DataFrame, dest_key: str, src_key: str) -> DataFrame:
    return dest.join(src, dest[dest_key] == src[src_key], "left_anti")


def missing_or_stale(src: DataFrame, dest: DataFrame, key: str) -> DataFrame:
    """Source rows (key, fingerprint) whose stored fingerprint is absent or another."""
    stored = dest.select(key, F.col("fingerprint").alias("stored"))
    return src.join(stored, key, "left").where(~F.col("fingerprint").eqNullSafe(F.col("stored")))


def recoverable(requests: DataFrame, tasks: DataFrame, key: list[str]) -> DataFrame:
    """Requests of keys that have no task, or a done one."""
    return requests.join(tasks.where(F.col("status") != "done"), key, "left_anti")


def sweep_step(phase: str, page_len: int, n: int, now: datetime, interval_s: int) -> tuple[str, datetime | None]:
    """(phase, next_reconcile) after a page of a reconciliation."""
    if page_len == n:
        return phase, None
    return ("delete", None) if phase == "source" else ("source", now + timedelta(seconds=interval_s))

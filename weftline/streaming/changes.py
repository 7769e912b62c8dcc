"""Structured Streaming: the coalescing queue as keyed state, and windows with late data."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "generation long, processed long, coalesced long, operation string, last long"
OUT = "source_id string, generation long, processed long, coalesced long, operation string"


def change_log(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of change files; each micro-batch takes a bounded number of them."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _fold(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    generation, processed, coalesced, operation, last = state.get if state.exists else (0, 0, 0, None, None)
    for frame in frames:
        n = len(frame)
        coalesced += n - max(0, min(n, processed + 1 - generation))
        generation += n
        at = frame["seq"].idxmax()
        if last is None or frame["seq"][at] > last:
            last, operation = int(frame["seq"][at]), frame["operation"][at]
    state.update((generation, processed, coalesced, operation, last))
    yield pd.DataFrame([(key[0], generation, processed, coalesced, operation)], columns=["source_id", "generation", "processed", "coalesced", "operation"])


def pending_tasks(changes: DataFrame) -> DataFrame:
    """One pending task a key (source_id, operation, seq), however often it changes; rows are the state after a batch."""
    return changes.groupBy("source_id").applyInPandasWithState(_fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, ts: str, by: str, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts in tumbling windows; events up to ``late`` behind the newest still count."""
    t = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return t.groupBy(F.window("__ts", size).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), "n")


def drain(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    """Run what there is and stop: the batches go to ``each``, which must allow for a batch that comes again."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    q.awaitTermination()

"""Queue snapshots, summaries and time-series queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("pending", "processing", "done", "failed", "superseded")


def queue_snapshot(tasks: DataFrame) -> DataFrame:
    """(entity, status, depth, oldest_request, oldest_start) with a row for each status of each entity."""
    spine = tasks.select("entity").distinct().select("entity", F.explode(F.array(*[F.lit(s) for s in STATUSES])).alias("status"))
    have = tasks.groupBy("entity", "status").agg(F.count(F.lit(1)).alias("depth"), F.min("requested_at").alias("oldest_request"), F.min("execution_started_at").alias("oldest_start"))
    return spine.join(have, ["entity", "status"], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))


def summarise(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Nearest-rank percentiles, extremes and mean."""
    p = {f"p{n}": F.expr(f"percentile_disc({n / 100}) within group (order by {value})") for n in (50, 95, 99)}
    return df.groupBy(*by).agg(F.count(value).alias("count"), F.min(value).alias("min"), *[c.alias(n) for n, c in p.items()], F.max(value).alias("max"), F.avg(value).alias("mean"))


def floor_percentiles(df: DataFrame, value: str, by: list[str], at: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """The value at index floor(p n) of the sorted values: ranks by a window, not lists in memory."""
    order = Window.partitionBy(*by).orderBy(value)
    rows = df.withColumn("__i", F.row_number().over(order) - 1).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    return rows.groupBy(*by).agg(*[F.max(F.when(F.col("__i") == F.least(F.col("__n") - 1, F.floor(F.lit(p) * F.col("__n"))), F.col(value))).alias(f"p{round(100 * p)}") for p in at])


def counter_rate(samples: DataFrame, by: list[str], ts: str, value: str, seconds: int = 300) -> DataFrame:
    """Increase a second over the last ``seconds`` at each sample; a fall of a counter counts as a reset to 0."""
    order = Window.partitionBy(*by).orderBy(ts)
    before = F.lag(value).over(order)
    delta = F.when(before.isNull(), F.lit(0.0)).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    rows = samples.withColumn("__d", delta).withColumn("__s", F.unix_micros(F.col(ts).cast("timestamp")))
    span = Window.partitionBy(*by).orderBy("__s").rangeBetween(-seconds * 1_000_000 + 1, 0)
    return rows.withColumn("rate", F.sum("__d").over(span) / F.lit(float(seconds))).drop("__d", "__s")


def histogram_quantile(buckets: DataFrame, by: list[str], q: float) -> DataFrame:
    """The quantile of cumulative buckets (by, le, n), linear within a bucket; le null is infinity."""
    order = Window.partitionBy(*by).orderBy(F.col("le").asc_nulls_last())
    total = F.max("n").over(Window.partitionBy(*by))
    rows = buckets.withColumn("lo", F.coalesce(F.lag("le").over(order), F.lit(0.0))).withColumn("below", F.coalesce(F.lag("n").over(order), F.lit(0))).withColumn("rank", F.lit(q) * total)
    hit = rows.where((F.col("n") >= F.col("rank")) & (F.col("below") < F.col("rank")))
    inside = F.col("lo") + (F.col("le") - F.col("lo")) * (F.col("rank") - F.col("below")) / (F.col("n") - F.col("below"))
    return hit.select(*by, F.coalesce(inside, F.col("lo")).alias("quantile"))


def cumulative_buckets(df: DataFrame, by: list[str], value: str, bounds: list[float]) -> DataFrame:
    """(by, le, n): one pass counts each bound."""
    counts = df.groupBy(*by).agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(value).alias("all"))
    cells = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(None).cast("double").alias("le"), F.col("all").alias("n")))
    return counts.select(*by, F.explode(cells).alias("c")).select(*by, "c.le", "c.n")


def firing(df: DataFrame, by: list[str], ts: str, bad: Column, for_seconds: int) -> DataFrame:
    """Runs of samples in which a condition holds, that last ``for_seconds`` or longer: (by, since, until, samples)."""
    order = Window.partitionBy(*by).orderBy(ts)
    rows = df.withColumn("__bad", F.coalesce(bad, F.lit(False))).withColumn("__run", F.sum((~F.col("__bad")).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.where("__bad").groupBy(*by, "__run").agg(F.min(ts).alias("since"), F.max(ts).alias("until"), F.count(F.lit(1)).alias("samples"))
    return runs.where(F.unix_micros(F.col("until").cast("timestamp")) - F.unix_micros(F.col("since").cast("timestamp")) >= for_seconds * 1_000_000).drop("__run")


def range_rate(samples: DataFrame, series: list[str], ts: str, value: str, range_s: int, step_s: int) -> DataFrame:
    """(series, instant, increase, rate): the rate of a counter over the last ``range_s`` seconds at each multiple of ``step_s``.

    Samples after the left edge count, up to the instant itself; a fall is a reset to 0.  The increase between the first and
    the last sample is carried on to the edges: whole if a sample is as near as they are apart on average (and a tenth more),
    else by half of that, and to the left no further than where the counter would be 0.  Two samples are needed.
    """
    us, span, step = F.unix_micros(F.col(ts).cast("timestamp")), range_s * 1_000_000, step_s * 1_000_000
    first = F.ceil(F.col("__t") / step)
    last = F.ceil((F.col("__t") + span) / step) - 1
    rows = samples.select(*series, us.alias("__t"), F.col(value).cast("double").alias("__v")).where("__v is not null").where(last >= first)
    rows = rows.select(*series, "__t", "__v", F.explode(F.sequence(first, last)).alias("__k"))
    before = F.lag("__v").over(Window.partitionBy(*series, "__k").orderBy("__t", "__v"))
    rows = rows.withColumn("__d", F.when(before.isNull(), 0.0).when(F.col("__v") < before, F.col("__v")).otherwise(F.col("__v") - before))
    sums = rows.groupBy(*series, "__k").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__t").alias("__a"), F.max("__t").alias("__b"), F.min_by("__v", F.struct("__t", "__v")).alias("__v0"), F.sum("__d").alias("__i")
    ).where("__n > 1 and __b > __a")
    at = F.col("__k") * step
    between, near = F.col("__b") - F.col("__a"), (F.col("__b") - F.col("__a")) / (F.col("__n") - 1)
    edge = lambda gap: F.when(gap >= near * 1.1, near / 2).otherwise(gap)
    zero = F.when((F.col("__i") > 0) & (F.col("__v0") >= 0), between * F.col("__v0") / F.col("__i"))
    left = F.least(edge(F.col("__a") - (at - span)), zero)
    more = F.col("__i") * (between + left + edge(at - F.col("__b"))) / between
    return sums.select(*series, F.timestamp_micros(at).cast("timestamp_ntz").alias("instant"), more.alias("increase"), (more / range_s).alias("rate"))


def latest(samples: DataFrame, series: list[str], ts: str, value: str) -> DataFrame:
    """(series, value): a gauge's last sample."""
    return samples.where(F.col(value).isNotNull()).groupBy(*series).agg(F.max_by(value, F.struct(ts, value)).alias("value"))


def absent(samples: DataFrame, expected: DataFrame, series: list[str], ts: str, since: Column) -> DataFrame:
    """The expected series without a sample since."""
    return expected.join(samples.where(F.col(ts) > since).select(*series).distinct(), series, "left_anti")

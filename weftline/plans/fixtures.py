"""Tables derived from the test data, as DataFrames and as SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-30 23:30:00"


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table; one of fewer splits than cores is dealt out, as a small file would be one task's work."""
    df, cores = spark.read.parquet(f"{sf}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name == "documents" and df.rdd.getNumPartitions() < cores else df


def tasks(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("id")
    g = read(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(
        F.count(F.lit(1)).alias("generation"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.max("ts").alias("last"), F.min("ts").alias("first")
    )
    minutes = lambda m: F.make_dt_interval(mins=m.cast("int"))
    status = F.element_at(F.array(*[F.lit(s) for s in ("pending", "processing", "done", "failed", "superseded")]), (u % 5 + 1).cast("int"))
    g = g.withColumn("status", status)
    is_ = lambda s: F.col("status") == s
    return g.select(
        "id", (u % 4 + 1).alias("configuration_id"), F.concat(F.lit("e"), (u % 3).cast("string")).alias("entity"), u.cast("string").alias("source_id"),
        F.when(u % 2 == 0, "upsert").otherwise(F.lit("delete")).alias("operation"), "status", "generation",
        F.when(is_("done"), F.col("generation")).otherwise(F.col("clicks")).alias("processed_generation"), (u % 6).alias("attempts"),
        (F.col("generation") - u % 2).alias("retry_generation"), F.col("last").alias("requested_at"),
        (F.col("last") + minutes(u % 7 - 3)).alias("next_attempt_at"), F.when(is_("processing"), F.col("last") + minutes(u % 10 - 5)).alias("lease_until"),
        F.when(is_("processing"), F.col("first")).alias("execution_started_at"), F.when(is_("done"), F.col("last")).alias("completed_at"),
        F.when(is_("processing"), F.col("last") + minutes(u % 12 - 5)).when(is_("done") & (u % 4 == 2), F.col("last")).when(is_("superseded") & (u % 4 == 0), F.col("last")).alias("execution_deadline"),
        F.when(is_("failed") | (is_("superseded") & (u % 3 == 1)), F.lit("provider_terminal")).alias("error_code"),
        F.when(is_("failed"), F.lit("x")).alias("last_error"), F.when(is_("processing"), F.concat(F.lit("t"), u.cast("string"))).alias("lease_token"),
        F.when(is_("superseded"), F.when(u % 2 == 0, "pending").otherwise(F.lit("failed"))).alias("superseded_from_status"),
    )


TASKS = """tasks as (
  select id, id % 4 + 1 as configuration_id, 'e' || (id % 3) as entity, id::varchar as source_id,
         case when id % 2 = 0 then 'upsert' else 'delete' end as operation, status, generation,
         case when status = 'done' then generation else clicks end as processed_generation, id % 6 as attempts,
         generation - id % 2 as retry_generation, last as requested_at, last + to_minutes(id % 7 - 3) as next_attempt_at,
         case when status = 'processing' then last + to_minutes(id % 10 - 5) end as lease_until,
         case when status = 'processing' then first end as execution_started_at,
         case when status = 'done' then last end as completed_at, case when status = 'failed' then 'x' end as last_error,
         case when status = 'processing' then 't' || id end as lease_token,
         case when status = 'superseded' then case when id % 2 = 0 then 'pending' else 'failed' end end as superseded_from_status,
         case when status = 'processing' then last + to_minutes(id % 12 - 5) when status = 'done' and id % 4 = 2 then last when status = 'superseded' and id % 4 = 0 then last end as execution_deadline,
         case when status = 'failed' or status = 'superseded' and id % 3 = 1 then 'provider_terminal' end as error_code
  from (select user_id as id, count(*) as generation, count(*) filter (event_type = 'click') as clicks, max(ts) as last, min(ts) as first,
               ['pending', 'processing', 'done', 'failed', 'superseded'][user_id % 5 + 1] as status
        from events group by user_id))"""


def revisions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey").cast("bigint")
    state = F.when((k % 5).isin(0, 3), "retired").when(k % 5 == 1, "staging").otherwise(F.lit("active"))
    old, day = (k % 5).isin(0, 3), F.make_dt_interval(days=k.cast("int"))
    named = lambda x, c: F.concat(F.lit(x), c.cast("string"))
    return read(spark, sf, "nation").where("n_nationkey < 24").select(
        (k % 8 + 1).alias("configuration_id"), named("e", k % 3).alias("entity"), state.alias("state"),
        F.when(old & (k > 0), F.lit("2024-01-01").cast("timestamp_ntz") + day).alias("retired_at"),
        F.when((k % 10).isin(0, 8), F.lit("2024-01-02").cast("timestamp_ntz")).alias("cleaned_at"), named("d", k % 20).alias("destination"),
        F.when(k == 2, "d13").otherwise(named("s", k)).alias("source_table"), F.array(F.when(k == 7, "d18").otherwise(F.lit("x"))).alias("dependency_tables"),
        F.when(old, F.when(k == 15, F.lit("2024-02-01")).otherwise(F.lit("2024-01-20")).cast("timestamp_ntz")).alias("retired_execution_until"),
    )


REVISIONS = """revisions as (
  select k % 8 + 1 as configuration_id, 'e' || (k % 3) as entity,
         case when k % 5 in (0, 3) then 'retired' when k % 5 = 1 then 'staging' else 'active' end as state,
         case when k % 5 in (0, 3) and k > 0 then timestamp '2024-01-01' + to_days(k::integer) end as retired_at,
         case when k % 10 in (0, 8) then timestamp '2024-01-02' end as cleaned_at, 'd' || (k % 20) as destination,
         case when k = 2 then 'd13' else 's' || k end as source_table, [case when k = 7 then 'd18' else 'x' end] as dependency_tables,
         case when k % 5 in (0, 3) then case when k = 15 then timestamp '2024-02-01' else timestamp '2024-01-20' end end as retired_execution_until
  from (select n_nationkey::bigint as k from nation where n_nationkey < 24))"""


def requests(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("user_id") + F.when(F.col("event_id") % 3 == 0, 1000).otherwise(0)
    return read(spark, sf, "events").select(
        (u % 4 + 1).alias("configuration_id"), F.concat(F.lit("e"), (u % 3).cast("string")).alias("entity"), u.cast("string").alias("source_id"),
        F.when(F.col("event_type") == "error", "delete").otherwise(F.lit("upsert")).alias("operation"),
        F.element_at(F.array(*[F.lit(x) for x in ("trigger", "polling", "backfill", "manual")]), (F.col("event_id") % 4 + 1).cast("int")).alias("origin"), F.col("event_id").alias("seq"),
    )


REQUESTS = """requests as (
  select u % 4 + 1 as configuration_id, 'e' || (u % 3) as entity, u::varchar as source_id,
         case when event_type = 'error' then 'delete' else 'upsert' end as operation,
         ['trigger', 'polling', 'backfill', 'manual'][event_id % 4 + 1] as origin, event_id as seq
  from (select *, user_id + case when event_id % 3 = 0 then 1000 else 0 end as u from events))"""

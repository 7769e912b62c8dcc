"""Queries of dashboards and alerts over samples, and other small reads, each with SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import misc
from ..operators import hybrid, telemetry
from . import fixtures as fx
from .registry import _BM, NOW, _hybrid_sql, _search, query

_DAY, _HALF = 86_400, 43_200


def _rate_sql(where: str, series: str, span: int = _DAY, step: int = _HALF) -> str:
    """CTE r: the extrapolated rate of each series at each step."""
    us = "epoch_us(ts)"
    return f"""s0 as (select {series}, {us} as t, value as v from events where {where}),
s1 as (select *, unnest(range(ceil(t / {step}e6)::bigint, ceil((t + {span}e6) / {step}e6)::bigint)) as k from s0),
s2 as (select *, case when lag(v) over w is null then 0 when v < lag(v) over w then v else v - lag(v) over w end as d from s1 window w as (partition by {series}, k order by t, v)),
s3 as (select {series}, k, count(*) as n, min(t) as a, max(t) as b, arg_min(v, t) as v0, sum(d) as i from s2 group by all having count(*) > 1 and max(t) > min(t)),
s4 as (select *, b - a as l, (b - a) / (n - 1) as near, a - (k * {step}000000 - {span}000000) as g0, k * {step}000000 - b as g1 from s3),
s5 as (select *, case when g0 >= near * 1.1 then near / 2 else g0 end as e0, case when g1 >= near * 1.1 then near / 2 else g1 end as e1, case when i > 0 and v0 >= 0 then l * v0 / i end as z from s4),
r as (select {series}, make_timestamp(k * {step}000000) as instant, i * (l + least(e0, coalesce(z, e0)) + e1) / l as increase, i * (l + least(e0, coalesce(z, e0)) + e1) / l / {span} as rate from s5)"""


def _rates(name: str, doc: str, where: str, labels: dict[str, str]):
    """A query: rate of each series (user, event), summed by labels (name to SQL expression over the series)."""
    by = ", ".join(f"{x} as {k}" for k, x in labels.items())

    def f(spark, sf):
        rows = fx.read(spark, sf, "events").where(where)
        rates = telemetry.range_rate(rows, ["user_id", "event_type"], "ts", "value", _DAY, _HALF)
        named = rates.select("instant", "rate", *[F.expr(x).alias(k) for k, x in labels.items()])
        return named.groupBy("instant", *labels).agg(F.round(F.sum("rate"), 9).alias("rate"))

    f.__name__, f.__doc__ = name, doc
    return query(f"select instant, {by}, round(sum(rate), 9) as rate from r group by all", _rate_sql(where, "user_id, event_type"))(f)


_ENTITY, _SERVICE = "'e' || cast(user_id % 3 as string)", "'s' || cast(user_id % 2 as string)"
_rates("rate_by_entity", "M03: what was enqueued, by entity.", "true", {"entity": _ENTITY})
_rates("rate_of_outcomes", "M04: outcomes whose name patterns take, by event.", "event_type like 'p%' or event_type like '%r' or event_type like 's%'", {"event": "event_type"})
_rates("rate_of_provider_calls", "M05: by service and entity.", "event_type = 'click'", {"service": _SERVICE, "entity": _ENTITY})
_rates("rate_of_leases", "M07: interruptions.", "event_type = 'error'", {"event": "event_type"})
_rates("rate_of_queries", "M08: outcomes of one service.", "user_id % 2 = 0", {"event": "event_type"})
_rates("rate_of_scans", "M10: scans, changes and orphans by name.", "event_type in ('click', 'view')", {"name": "event_type", "entity": _ENTITY})


@query("select event_type, instant, round(increase, 6) as increase from r where increase > 100", _rate_sql("true", "event_type", 21_600, 21_600))
def alert_increase(spark, sf):
    """Increase over a window."""
    rows = telemetry.range_rate(fx.read(spark, sf, "events"), ["event_type"], "ts", "value", 21_600, 21_600)
    return rows.where("increase > 100").select("event_type", "instant", F.round("increase", 6).alias("increase"))


@query("select e.event_type from (select distinct event_type from events union all select 'never') e where not exists (select 1 from events x where x.event_type = e.event_type and x.ts > timestamp '2024-01-30 23:50:00')")
def alert_absent(spark, sf):
    """Series that are expected and have no recent sample."""
    events = fx.read(spark, sf, "events")
    expected = events.select("event_type").distinct().unionByName(spark.createDataFrame([("never",)], "event_type string"))
    return telemetry.absent(events, expected, ["event_type"], "ts", F.lit("2024-01-30 23:50:00").cast("timestamp_ntz"))


@query("select entity, count(*) filter (status in ('pending', 'processing')) / 25.0 as ratio from tasks group by entity having count(*) filter (status in ('pending', 'processing')) / 25.0 > 0.1", fx.TASKS)
def alert_queue_ratio(spark, sf):
    """How full the queue is against its limit."""
    due = F.count_if(F.col("status").isin("pending", "processing")) / F.lit(25.0)
    return fx.tasks(spark, sf).groupBy("entity").agg(due.alias("ratio")).where("ratio > 0.1")


@query(f"select entity, max(greatest(0.0, (epoch_us({NOW}) - epoch_us(requested_at)) / 1e6)) filter (status = 'pending') as queue_age, max(greatest(0.0, (epoch_us({NOW}) - epoch_us(execution_started_at)) / 1e6)) filter (status = 'processing') as execution_age from tasks group by entity", fx.TASKS)
def max_ages(spark, sf):
    """Ages of what is pending or in process only."""
    age = lambda s, c: F.max(F.when(F.col("status") == s, misc.age_seconds(fx.now(), F.col(c))))
    return fx.tasks(spark, sf).groupBy("entity").agg(age("pending", "requested_at").alias("queue_age"), age("processing", "execution_started_at").alias("execution_age"))


@query("select event_type as name, max(v) as lag from (select user_id, event_type, arg_max(value, ts) as v from events group by all) group by event_type")
def max_lag_by_name(spark, sf):
    """The largest of the series' last samples."""
    now = telemetry.latest(fx.read(spark, sf, "events"), ["user_id", "event_type"], "ts", "value")
    return now.groupBy(F.col("event_type").alias("name")).agg(F.max("value").alias("lag"))


@query("select configuration_id, entity, (state = 'staging')::int as staging, (cleaned_at is not null)::int as cleaned, coalesce(n, 0) as failed from revisions left join (select configuration_id, entity, count(*) as n from tasks where status = 'failed' group by all) using (configuration_id, entity)", fx.TASKS, fx.REVISIONS)
def revision_gauges(spark, sf):
    """Phases as 0 and 1."""
    failed = fx.tasks(spark, sf).where("status = 'failed'").groupBy("configuration_id", "entity").agg(F.count(F.lit(1)).alias("failed"))
    rows = fx.revisions(spark, sf).join(failed, ["configuration_id", "entity"], "left")
    return rows.select("configuration_id", "entity", (F.col("state") == "staging").cast("int").alias("staging"), F.col("cleaned_at").isNotNull().cast("int").alias("cleaned"), F.coalesce("failed", F.lit(0)).alias("failed"))


@query("select event_type, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9) as per_second, round(count(*) filter (value > 100) / count(*), 9) as fraction from events group by event_type")
def throughput(spark, sf):
    """Rows a second and the fraction that failed."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return fx.read(spark, sf, "events").groupBy("event_type").agg(F.round(F.count(F.lit(1)) / ((F.max(us) - F.min(us)) / 1e6), 9).alias("per_second"), F.round(F.count_if(F.col("value") > 100) / F.count(F.lit(1)), 9).alias("fraction"))


@query("select exists (select 1 from documents where lang = 'de') as found, exists (select 1 from documents where lang = 'xx') as missing")
def exists_scalar(spark, sf):
    """whether there is any."""
    docs = fx.read(spark, sf, "documents").select("lang")
    one = lambda x, name: docs.where(F.col("lang") == x).limit(1).agg((F.count(F.lit(1)) > 0).alias(name))
    return one("de", "found").join(F.broadcast(one("xx", "missing")))  # one row each


@query("select vec_id, md5(vec_id::varchar)::uuid::varchar as id, round(sin(vec_id), 9) as first from embeddings")
def synthetic_ids(spark, sf):
    """Uuids from digests."""
    h = F.md5(F.col("vec_id").cast("string"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return fx.read(spark, sf, "embeddings").select("vec_id", F.concat_ws("-", *parts).alias("id"), F.round(F.sin("vec_id"), 9).alias("first"))


@query("select r.doc_id, r.score, d.lang, d.text from (" + _hybrid_sql("true", 0.5, 0.5) + ") r join documents d using (doc_id)", _BM)
def hybrid_with_content(spark, sf):
    """The rows that the fused ids name, read again."""
    found = _search(spark, sf, None).select("doc_id", "score")
    return hybrid.with_content(found, fx.read(spark, sf, "documents"), "doc_id", ["lang", "text"]).select("doc_id", "score", "lang", "text")

"""The queries over the library's own operators, each with SQL of the same meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import content, misc, retry, vectors
from ..operators import capture, hybrid, lexical, polling, queue, retention, revisions, telemetry
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NOW = f"timestamp '{fx.NOW}'"
T = "document {{doc_id}} in {{lang}}: {{text}}"
PROFILE = content.Profile("local", "openai", "http://localhost:8080", "small", 64, "cosine")
TAIL = content.tail_json(T, PROFILE).replace("'", "''")
TEXT_SQL = "'document ' || doc_id || ' in ' || coalesce(lang, '') || ': ' || coalesce(text, '')"
FP_SQL = f"sha256('[' || to_json({TEXT_SQL})::varchar || ',{TAIL}]')"
FIVE = "'pending', 'processing', 'done', 'failed', 'superseded'"


def query(sql: str | None = None, *with_: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (f"with {', '.join(with_)} " if with_ else "") + sql
        return f

    return add


def docs_fp(spark: SparkSession, sf: str) -> DataFrame:
    return fx.read(spark, sf, "documents").withColumn("fingerprint", content.fingerprint(content.render(T), T, PROFILE))


# --- projections -----------------------------------------------------------------------------------------------------


@query(f"select doc_id, {TEXT_SQL} as content from documents")
def template_render(spark, sf):
    return fx.read(spark, sf, "documents").select("doc_id", content.render(T).alias("content"))


@query(f"select doc_id, {FP_SQL} as fingerprint from documents")
def fingerprint_documents(spark, sf):
    return docs_fp(spark, sf).select("doc_id", "fingerprint")


def _with_nation(spark, sf, table, key, foreign, where="true"):
    nation = fx.read(spark, sf, "nation").where(where)
    rows = capture.with_dependencies(fx.read(spark, sf, table), {"nation": (nation, "n_nationkey", foreign, ["n_name", "n_regionkey"])})
    name = key.replace("key", "").replace("cust", "name").replace("supp", "name")
    return rows.select(key, content.render("{{%s}} of {{nation.n_name}} ({{nation.n_regionkey}})" % name).alias("content"))


@query("select c_custkey, c_name || ' of ' || coalesce(n_name, '') || ' (' || coalesce(n_regionkey::varchar, '') || ')' as content from customer left join nation on c_nationkey = n_nationkey")
def render_with_dependency(spark, sf):
    return _with_nation(spark, sf, "customer", "c_custkey", "c_nationkey")


@query("select s_suppkey, s_name || ' of ' || coalesce(n_name, '') || ' (' || coalesce(n_regionkey::varchar, '') || ')' as content from supplier left join (select * from nation where n_nationkey < 10) on s_nationkey = n_nationkey")
def render_missing_dependency(spark, sf):
    return _with_nation(spark, sf, "supplier", "s_suppkey", "s_nationkey", "n_nationkey < 10")


@query("select event_id, greatest(ceil(least(60000.0, 1000.0 * pow(2.0, least(event_id % 12, 30))) * (0.5 + 0.5 * (event_id % 100) / 100.0)), case when event_id % 5 = 0 then 7000.5::double else 0 end).ceil()::bigint as delay_ms from events")
def backoff_schedule(spark, sf):
    e = F.col("event_id")
    after = F.when(e % 5 == 0, F.lit(7000.5))
    return fx.read(spark, sf, "events").select("event_id", retry.delay_ms(e % 12 + 1, after, (e % 100) / 100.0).alias("delay_ms"))


_STATUS = "[429, 408, 425, 500, 503, 400, 404][event_id % 9 + 1]"


@query(f"""select event_id, case when event_id % 17 = 0 then 'bad_vector' when event_id % 13 = 0 then 'retry_after_exceeds_limit'
  when s = 429 then 'rate_limited' when s in (408, 425, 500, 502, 503, 504) then 'provider_transient' when s is not null then 'provider_terminal'
  when event_id % 2 = 0 then 'database_transient' when event_id % 3 = 0 then 'provider_timeout' when event_id % 5 = 0 then 'provider_transport' else 'processing_terminal' end as code,
  case when event_id % 17 = 0 or event_id % 13 = 0 then false when s is not null then s in (429, 408, 425, 500, 502, 503, 504)
  else event_id % 2 = 0 or event_id % 3 = 0 or event_id % 5 = 0 end as retryable from (select event_id, {_STATUS} as s from events)""")
def error_classes(spark, sf):
    e = F.col("event_id")
    s = F.get(F.array(*[F.lit(x) for x in (429, 408, 425, 500, 503, 400, 404)]), (e % 9).cast("int"))
    kind = F.when(e % 3 == 0, "timeout").when(e % 5 == 0, "transport")
    c = retry.classify(s, F.when(e % 13 == 0, F.lit(700_000_000)), kind, F.when(e % 2 == 0, "40001"), F.when(e % 17 == 0, "bad_vector"))
    return fx.read(spark, sf, "events").select("event_id", c.alias("c")).select("event_id", "c.code", "c.retryable")


@query(f"select event_id, greatest(0.0, (epoch_us({NOW}) - epoch_us(ts)) / 1e6) as age_s, 'v1@' || (event_id % 9) as config_version from events")
def ages_and_versions(spark, sf):
    return fx.read(spark, sf, "events").select("event_id", misc.age_seconds(fx.now(), F.col("ts")).alias("age_s"), misc.config_version(F.lit("v1"), F.col("event_id") % 9).alias("config_version"))


@query("select event_id, event_type as event, (props::json ->> 'k')::bigint as k from events")
def json_fields(spark, sf):
    """Typed fields of a JSON column."""
    p = F.from_json("props", "struct<k: bigint>")
    return fx.read(spark, sf, "events").select("event_id", F.col("event_type").alias("event"), p["k"].alias("k"))


@query("select doc_id, lang, source from documents where regexp_matches(lang, '^[a-z]{2}$') and length(text) between 1 and 32768")
def input_checks(spark, sf):
    """Regular expression and code point checks."""
    ok = F.col("lang").rlike("^[a-z]{2}$") & F.char_length("text").between(1, 32768)
    return fx.read(spark, sf, "documents").where(ok).select("doc_id", "lang", "source")


@query("""select event_id, event_type, value, 'configuration_id=' || user_id || ',count=' || floor(value)::bigint || case when event_type = 'error' then ',error_code=e' else '' end || ',service=app' as context
  from events where event_type in ('click', 'error') and floor(value) > 0""")
def allowed_events(spark, sf):
    """Allow-listed context, dropped kinds, no empty events."""
    n = F.floor("value")
    said = {"service": F.lit("app"), "configuration_id": F.col("user_id"), "count": n, "error_code": F.when(F.col("event_type") == "error", "e"), "revision": F.lit("r"), "event": F.col("event_type"), "secret": F.col("props")}
    context = F.create_map(*[x for k, v in said.items() for x in (F.lit(k), v.cast("string"))])
    rows = fx.read(spark, sf, "events").where(F.col("event_type").isin("click", "error") & (n > 0)).select("event_id", "event_type", "value", misc.allowed(context).alias("c"))
    order = F.array_sort(F.map_entries("c"))
    return rows.select("event_id", "event_type", "value", F.array_join(F.transform(order, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("context"))


# --- scans -----------------------------------------------------------------------------------------------------------


@query("select doc_id, source from documents where doc_id = 42")
def point_lookup(spark, sf):
    return fx.read(spark, sf, "documents").where("doc_id = 42").select("doc_id", "source")


@query("select doc_id from documents where doc_id > 120 order by doc_id limit 50")
def backfill_page(spark, sf):
    return polling.page_by_key(fx.read(spark, sf, "documents"), "doc_id", 120, None, 50).select("doc_id")


@query("select doc_id, ((row_number() over (order by doc_id) - 1) // 100)::bigint as batch from documents")
def backfill_batches(spark, sf):
    return polling.backfill_batches(fx.read(spark, sf, "documents"), "doc_id", 100)


_END, _CUR = "timestamp '1998-01-01'", "timestamp '1995-06-01'"


def _poll(spark, sf, cursor_id, n=100):
    o = fx.read(spark, sf, "orders")
    lit = lambda s: F.lit(s).cast("timestamp_ntz")
    return polling.page_by_time(o, "o_orderdate", "o_orderkey", lit("1998-01-01"), lit("1995-06-01"), cursor_id, n).select("o_orderkey", "o_orderdate")


@query(f"select o_orderkey, o_orderdate from orders where o_orderdate <= {_END} and o_orderdate > {_CUR} or o_orderdate = {_CUR} and o_orderkey > 5000 order by o_orderdate, o_orderkey limit 100")
def poll_tie_cursor(spark, sf):
    return _poll(spark, sf, 5000)


@query(f"select o_orderkey, o_orderdate from orders where o_orderdate <= {_END} and o_orderdate >= {_CUR} order by o_orderdate, o_orderkey limit 100")
def poll_inclusive_restart(spark, sf):
    return _poll(spark, sf, None)


@query(f"select o_orderkey, o_orderdate from orders where o_orderdate <= {_END} order by o_orderdate, o_orderkey limit 100")
def poll_incremental_page(spark, sf):
    return polling.page_by_time(fx.read(spark, sf, "orders"), "o_orderdate", "o_orderkey", F.lit("1998-01-01").cast("timestamp_ntz"), n=100).select("o_orderkey", "o_orderdate")


@query("select max(doc_id) as upper from documents")
def max_key_boundary(spark, sf):
    return fx.read(spark, sf, "documents").agg(F.max("doc_id").alias("upper"))


@query("select doc_id from documents where doc_id > 100 and doc_id <= 400 order by doc_id limit 75")
def sweep_bounded(spark, sf):
    return polling.page_by_key(fx.read(spark, sf, "documents"), "doc_id", 100, 400, 75).select("doc_id")


@query("select vec_id from embeddings where not exists (select 1 from documents where doc_id = vec_id and doc_id % 10 <> 7) order by vec_id limit 200")
def orphan_embeddings(spark, sf):
    src = fx.read(spark, sf, "documents").where("doc_id % 10 <> 7")
    return polling.page_by_key(polling.orphans(fx.read(spark, sf, "embeddings"), src, "vec_id", "doc_id"), "vec_id", n=200).select("vec_id")


_STORED = f"select doc_id, case when doc_id % 7 = 0 then 'old' else {FP_SQL} end as stored from documents where doc_id % 10 <> 7"


def _stored(spark, sf):
    return docs_fp(spark, sf).where("doc_id % 10 <> 7").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("fingerprint")).alias("fingerprint"))


@query(f"select d.doc_id, d.fingerprint, s.stored from (select doc_id, {FP_SQL} as fingerprint from documents) d left join ({_STORED}) s using (doc_id) where d.fingerprint is distinct from s.stored")
def missing_or_stale(spark, sf):
    return polling.missing_or_stale(docs_fp(spark, sf).select("doc_id", "fingerprint"), _stored(spark, sf), "doc_id")


@query("select doc_id + case when doc_id % 10 = 9 then 1000000 * n else 0 end as doc_id, case when doc_id % 10 = 7 or (doc_id % 10 = 9 and n = 0) then 'delete' else 'upsert' end as operation from documents cross join (values (0), (1)) t(n) where doc_id % 10 = 9 or (n = 0 and doc_id % 10 in (3, 7))")
def changed_rows_diff(spark, sf):
    old = fx.read(spark, sf, "documents")
    k = F.col("doc_id") % 10
    new = old.where(k != 7).withColumn("text", F.when(k == 3, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))).withColumn("n_chars", F.col("n_chars") + 1)
    new = new.withColumn("doc_id", F.when(k == 9, F.col("doc_id") + 1_000_000).otherwise(F.col("doc_id")))
    return capture.diff(old, new, "doc_id", ["lang", "text", "source"])


@query("select distinct c_custkey from customer where c_nationkey in (select n_nationkey from nation where n_nationkey % 6 = 0) or c_nationkey in (select n_nationkey + 1 from nation where n_nationkey % 6 = 0)")
def dependency_fanout(spark, sf):
    k = F.col("n_nationkey")
    changes = fx.read(spark, sf, "nation").where(k % 6 == 0).select(k.alias("old_key"), (k + 1).alias("new_key"))
    return capture.fan_out(changes, fx.read(spark, sf, "customer"), "c_custkey", "c_nationkey")


@query("select vec_id as doc_id, case when vec_id % 4 = 1 then 'delete' else 'upsert' end as operation from embeddings where vec_id % 4 in (1, 2)")
def vector_only_update(spark, sf):
    """Another vector is no change of content; another label is, and so is a row that goes."""
    old = fx.read(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")
    new = old.where("doc_id % 4 <> 1").withColumn("embedding", F.reverse("embedding")).withColumn("label", F.when(F.col("doc_id") % 4 == 2, F.col("label") + 1).otherwise(F.col("label")))
    return capture.diff(old, new, "doc_id", ["label"])


@query("select (count(*) - count(doc_id))::bigint as null_keys, (count(*) - count(distinct doc_id))::bigint as repeats from documents")
def key_checks(spark, sf):
    """A key has no nulls and no repeats."""
    per = fx.read(spark, sf, "documents").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("null_keys"), F.coalesce(F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n") - 1).otherwise(F.col("n"))), F.lit(0)).alias("repeats"))


# --- queue -----------------------------------------------------------------------------------------------------------

_LIVE = "exists (select 1 from revisions r where r.configuration_id = x.configuration_id and r.entity = x.entity and r.state in ('active', 'staging'))"
_FOLD = f"f as (select configuration_id, entity, source_id, count(*) as n, max_by(operation, seq) as op from requests x where {_LIVE} group by all)"
_ENQ = f"""e as (select f.*, coalesce(status in ('processing', 'failed'), false) as keep, t.status, t.attempts, t.retry_generation as rg, t.next_attempt_at as na, t.last_error as le,
  coalesce(t.generation, 0) as g0, coalesce(t.processed_generation, 0) as p0 from f left join tasks t using (configuration_id, entity, source_id)),
q as (select configuration_id, entity, source_id, op as operation, case when keep then status else 'pending' end as status, (g0 + n)::bigint as generation, p0::bigint as processed_generation,
  case when keep then attempts else 0 end as attempts, case when keep then rg when status is null then 1 else g0 + n end as retry_generation,
  case when keep then na else {NOW} end as next_attempt_at, {NOW} as requested_at, case when status = 'failed' then le end as last_error, n,
  case when keep then n else n - greatest(0, least(n, p0 + 1 - g0)) end as coalesced from e)"""


def _enqueued(spark, sf):
    return queue.enqueue(fx.tasks(spark, sf), fx.requests(spark, sf), fx.revisions(spark, sf), fx.now())


@query("select * from q", fx.TASKS, fx.REVISIONS, fx.REQUESTS, _FOLD, _ENQ)
def enqueue_fold(spark, sf):
    return _enqueued(spark, sf)


@query("select entity, sum(n)::bigint as enqueued, sum(coalesced)::bigint as coalesced from q group by entity", fx.TASKS, fx.REVISIONS, fx.REQUESTS, _FOLD, _ENQ)
def enqueue_coalesced(spark, sf):
    return queue.counters(_enqueued(spark, sf)).groupBy("entity").agg(F.sum("enqueued").alias("enqueued"), F.sum("coalesced").alias("coalesced"))


@query("select entity, count(*) as enqueued, count(*) filter (origin = 'trigger') as captured, count(*) filter (origin = 'polling') as polled from requests group by entity", fx.REQUESTS)
def enqueue_metrics_by_origin(spark, sf):
    o = F.col("origin")
    return fx.requests(spark, sf).groupBy("entity").agg(F.count(F.lit(1)).alias("enqueued"), F.count_if(o == "trigger").alias("captured"), F.count_if(o == "polling").alias("polled"))


@query("select source_id, seq, row_number() over (partition by configuration_id, entity, source_id order by seq) as position, row_number() over (partition by configuration_id, entity, source_id order by seq) > 1 as coalesced from requests", fx.REQUESTS)
def burst_positions(spark, sf):
    return queue.burst_positions(fx.requests(spark, sf)).select("source_id", "seq", "position", "coalesced")


_AT = "timestamp '2024-01-29 12:00:00'"
_CLAIM = f"((status = 'pending' and next_attempt_at <= {NOW}) or (status = 'processing' and lease_until < {NOW})) and {_LIVE}"


@query(f"select id, status from tasks x where {_CLAIM}", fx.TASKS, fx.REVISIONS)
def claimable_tasks(spark, sf):
    return queue.claimable(fx.tasks(spark, sf), fx.revisions(spark, sf), fx.now()).select("id", "status")


@query(f"""select id, configuration_id, entity, source_id, 'processing' as status, case when retry_generation = generation then attempts + 1 else 1 end as attempts, generation as retry_generation,
  'token' as lease_token, {NOW} as execution_started_at, {NOW} + interval 300 second as execution_deadline, {NOW} + interval 60 second as lease_until
  from tasks x where {_CLAIM} order by requested_at, id limit 10""", fx.TASKS, fx.REVISIONS)
def claim_batch(spark, sf):
    return queue.claim(fx.tasks(spark, sf), fx.revisions(spark, sf), fx.now(), 10, "token")


@query(f"select id, least(execution_deadline, {_AT} + interval 60 second) as lease_until from tasks where lease_token = 't' || id and status = 'processing' and lease_until > {_AT} and execution_deadline > {_AT}", fx.TASKS)
def lease_renewal(spark, sf):
    """Every processing task asks, each with its own token; only leases and deadlines that are not past move on."""
    at = F.lit(_AT[11:-1]).cast("timestamp_ntz")
    t = fx.tasks(spark, sf).where(F.col("lease_token") == F.concat(F.lit("t"), F.col("id").cast("string"))).withColumn("lease_token", F.lit("mine"))
    return queue.renew(t, "mine", at).select("id", "lease_until")


_WORK = f"""w as (select *, {_LIVE} as live, 't' || (id - case when id % 11 = 0 then 1 else 0 end) as token, generation - case when id % 13 = 0 then 1 else 0 end as seen_generation,
  'f' || (id % 4) as seen_fingerprint, case when id % 14 = 6 then null else 'f' || (id % 4 + case when id % 8 = 3 then 1 else 0 end) end as fingerprint, 'f' || (id % 2) as stored_fingerprint, id % 3 = 0 as has_vector from tasks x)"""


def _work(spark, sf):
    i = F.col("id")
    live = fx.revisions(spark, sf).where(F.col("state").isin("active", "staging")).select("configuration_id", "entity", F.lit(True).alias("live"))
    f = lambda c: F.concat(F.lit("f"), c.cast("string"))
    return fx.tasks(spark, sf).join(live, ["configuration_id", "entity"], "left").select(
        "*", F.concat(F.lit("t"), (i - F.when(i % 11 == 0, 1).otherwise(0)).cast("string")).alias("token"), (F.col("generation") - F.when(i % 13 == 0, 1).otherwise(0)).alias("seen_generation"),
        f(i % 4).alias("seen_fingerprint"), F.when(i % 14 == 6, F.lit(None)).otherwise(f(i % 4 + F.when(i % 8 == 3, 1).otherwise(0))).alias("fingerprint"), f(i % 2).alias("stored_fingerprint"), (i % 3 == 0).alias("has_vector"),
    )


_DONE = "outcome in ('delete', 'upsert', 'unchanged')"


@query(f"""select id, outcome, case when {_DONE} then 'done' when outcome = 'requeue' then 'pending' else status end as new_status,
  case when {_DONE} then generation else processed_generation end as new_processed, case when outcome = 'requeue' then 0 else attempts end as new_attempts,
  case when outcome = 'requeue' then generation else retry_generation end as retry_generation, case when outcome = 'requeue' then {_AT} else requested_at end as requested_at,
  case when outcome = 'requeue' then {_AT} else next_attempt_at end as next_attempt_at, case when {_DONE} then {_AT} else completed_at end as completed_at,
  case when not {_DONE} then last_error end as last_error, case when not {_DONE} then error_code end as error_code,
  case when outcome = 'discard' then lease_token end as lease_token, case when outcome = 'discard' then lease_until end as lease_until, case when outcome = 'discard' then execution_deadline end as execution_deadline
  from (select *, case when not live then 'discard'
  when lease_token is distinct from token or status <> 'processing' or lease_until is null or lease_until <= {_AT} or execution_deadline is null or execution_deadline <= {_AT} then 'discard'
  when generation <> seen_generation or fingerprint is distinct from seen_fingerprint then 'requeue'
  when fingerprint is null then 'delete' when has_vector then 'upsert' when stored_fingerprint is distinct from fingerprint then 'requeue' else 'unchanged' end as outcome from w)""", fx.TASKS, fx.REVISIONS, _WORK)
def finalize_outcomes(spark, sf):
    return queue.finalize(_work(spark, sf), F.lit(_AT[11:-1]).cast("timestamp_ntz"))


@query(f"""select id, case when not o then 'task_discarded' when not (m or a or r) then 'task_failed' when r then 'task_retry_scheduled' else 'task_requeued' end as outcome,
  case when not o then status when m or a or r then 'pending' else 'failed' end as new_status, case when o and m then 0 else attempts end as new_attempts,
  case when o then generation else retry_generation end as retry_generation, case when not o then next_attempt_at when m or a then {NOW} else {NOW} + to_milliseconds(id * 10) end as next_attempt_at,
  case when o then {NOW} else requested_at end as requested_at, case when not o then error_code when a then 'execution_interrupted' else 'provider_transient' end as error_code,
  case when not o then lease_token end as lease_token, case when not o then lease_until end as lease_until, case when not o then execution_deadline end as execution_deadline
  from (select *, id % 13 = 0 as m, id % 9 = 0 as a, id % 2 = 0 and attempts < 3 as r, status = 'processing' and id % 11 <> 0 as o from tasks)""", fx.TASKS)
def failure_transitions(spark, sf):
    """Every task's work fails; only that of the owner counts."""
    i = F.col("id")
    w = fx.tasks(spark, sf).withColumns({
        "token": F.concat(F.lit("t"), (i - F.when(i % 11 == 0, 1).otherwise(0)).cast("string")), "seen_generation": F.col("generation") - F.when(i % 13 == 0, 1).otherwise(0),
        "aborted": i % 9 == 0, "code": F.lit("provider_transient"), "retryable": i % 2 == 0, "delay_ms": i * 10,
    })
    return queue.fail(w, fx.now(), 3)


@query(f"select id, configuration_id, entity, source_id, 'pending' as status, generation + 1 as generation, generation + 1 as retry_generation, 0::bigint as attempts, {NOW} as requested_at from tasks where status = 'failed' and configuration_id = 1 and entity = 'e0'", fx.TASKS)
def reprocess_failed(spark, sf):
    return queue.reprocess(fx.tasks(spark, sf), 1, "e0", fx.now())


@query("""select configuration_id, entity, source_id, min(id) as id, sum(generation)::bigint as generation, max(attempts) + 1 as attempts, bool_or(status = 'failed') as any_failed, max_by(operation, id) as operation, max(last_error) as last_error
  from (select seq as id, configuration_id, entity, source_id, 1::bigint as generation, seq % 6 as attempts, case when seq % 5 = 0 then 'failed' else 'done' end as status, operation, case when seq % 5 = 0 then 'e' || (seq % 3) end as last_error from requests) group by all""", fx.REQUESTS)
def legacy_fold(spark, sf):
    s = F.col("seq")
    rows = fx.requests(spark, sf).select("configuration_id", "entity", "source_id", s.alias("id"), F.lit(1).cast("long").alias("generation"), (s % 6).alias("attempts"), F.when(s % 5 == 0, "failed").otherwise(F.lit("done")).alias("status"), "operation", F.when(s % 5 == 0, F.concat(F.lit("e"), (s % 3).cast("string"))).alias("last_error"))
    return queue.legacy_fold(rows)


@query("select r.configuration_id, r.entity, r.source_id, r.operation from requests r where not exists (select 1 from tasks t where t.status <> 'done' and t.configuration_id = r.configuration_id and t.entity = r.entity and t.source_id = r.source_id)", fx.REQUESTS, fx.TASKS)
def enqueue_recoverable(spark, sf):
    return polling.recoverable(fx.requests(spark, sf).select(*queue.KEY, "operation"), fx.tasks(spark, sf), queue.KEY)


_NEW = "n as (select vec_id, label + 100 as label from embeddings where vec_id % 3 = 0 union all select vec_id + 1000000, label from embeddings where vec_id % 4 = 0)"


def _upserted(spark, sf):
    e = fx.read(spark, sf, "embeddings").select("vec_id", "label")
    new = e.where("vec_id % 3 = 0").withColumn("label", F.col("label") + 100).unionByName(e.where("vec_id % 4 = 0").withColumn("vec_id", F.col("vec_id") + 1_000_000))
    return e, new


@query("select coalesce(n.vec_id, e.vec_id) as vec_id, coalesce(n.label, e.label)::integer as label from embeddings e full join n using (vec_id)", _NEW)
def destination_upsert(spark, sf):
    e, new = _upserted(spark, sf)
    return queue.upsert(e, new, ["vec_id"])


@query("select coalesce(e.vec_id, n.vec_id) as vec_id, coalesce(e.label, n.label)::integer as label from embeddings e full join n using (vec_id)", _NEW)
def insert_if_absent(spark, sf):
    return queue.insert_absent(*_upserted(spark, sf), ["vec_id"])


@query("select vec_id, label from embeddings where vec_id not in (select doc_id from documents where doc_id % 10 = 7)")
def destination_delete(spark, sf):
    gone = fx.read(spark, sf, "documents").where("doc_id % 10 = 7").select(F.col("doc_id").alias("vec_id"))
    return fx.read(spark, sf, "embeddings").join(gone, "vec_id", "left_anti").select("vec_id", "label")


@query("select doc_id, d.source, label from documents d left join embeddings on vec_id = doc_id")
def copy_of_left_join(spark, sf):
    e = fx.read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return fx.read(spark, sf, "documents").join(e, "doc_id", "left").select("doc_id", "source", "label")


# --- revisions and retention -----------------------------------------------------------------------------------------


@query("select configuration_id, entity, case when configuration_id = max(configuration_id) over (partition by entity) then 'active' else 'retired' end as state from revisions", fx.REVISIONS)
def revision_import_window(spark, sf):
    return revisions.import_states(fx.revisions(spark, sf).select("configuration_id", "entity"))


_CONF = "c as (select n_nationkey::bigint + 1 as id, '{\"entities\":[{\"name\":\"e' || (n_nationkey % 3) || '\"},{\"name\":\"x' || n_nationkey || '\"}]}' as configuration from nation)"


def _configurations(spark, sf):
    k = F.col("n_nationkey")
    return fx.read(spark, sf, "nation").select((k.cast("bigint") + 1).alias("id"), F.concat(F.lit('{"entities":[{"name":"e'), (k % 3).cast("string"), F.lit('"},{"name":"x'), k.cast("string"), F.lit('"}]}')).alias("configuration"))


@query("select configuration_id, entity, state, configuration from revisions join c on id = configuration_id where state = 'active'", fx.REVISIONS, _CONF)
def active_revision(spark, sf):
    return revisions.active(fx.revisions(spark, sf), _configurations(spark, sf)).select("configuration_id", "entity", "state", "configuration")


@query("select id, unnest(['e' || ((id - 1) % 3), 'x' || (id - 1)]) as name from c", _CONF)
def configured_entities(spark, sf):
    return revisions.entities_of(_configurations(spark, sf))


@query("select configuration_id, entity, retired_at, row_number() over (partition by entity order by retired_at desc nulls first, configuration_id desc) as position from revisions where state = 'retired' and cleaned_at is null", fx.REVISIONS)
def retired_positions(spark, sf):
    return retention.retired_positions(fx.revisions(spark, sf)).select("configuration_id", "entity", "retired_at", "position")


_GONE = """g as (select p.configuration_id, p.entity, p.destination from (select *, row_number() over (partition by entity order by retired_at desc nulls first, configuration_id desc) as position
    from revisions where state = 'retired' and cleaned_at is null) p
  where position > {keep} and retired_at <= timestamp '2024-01-25' and coalesce(retired_execution_until <= {now}, true)
  and not exists (select 1 from revisions r where r.state = 'retired' and r.cleaned_at is null and r.destination = p.destination and (r.configuration_id <> p.configuration_id or r.entity <> p.entity))
  and not exists (select 1 from revisions r where r.state in ('active', 'staging') and (p.destination in (r.destination, r.source_table) or list_contains(r.dependency_tables, p.destination))))"""


@query("select * from g", fx.REVISIONS, _GONE.format(keep=0, now=NOW))
def retired_destinations(spark, sf):
    """Of the retired revisions one is shared, one is a live one's source, one may still execute."""
    return retention.destinations(fx.revisions(spark, sf), 0, F.lit("2024-01-25").cast("timestamp_ntz"), fx.now(), 100).select("configuration_id", "entity", "destination")


_PASS = {"completed_seconds": 12_600, "retired_seconds": 475_200, "reader_grace_seconds": 0, "audit_seconds": 1_814_400, "keep_retired": 0, "batch_size": 25, "drop_retired_destinations": True}
_OLD = f"{NOW} - interval 12600 second"


def _cleanup(spark, sf):
    actions = fx.read(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"))
    return retention.cleanup(fx.tasks(spark, sf), fx.revisions(spark, sf), actions, _PASS, fx.now())


_PASSED = (
    fx.TASKS, fx.REVISIONS, _GONE.format(keep=0, now=NOW),
    f"c1 as (select id from tasks where status = 'done' and processed_generation = generation and completed_at <= {_OLD} and lease_token is null and lease_until is null and execution_deadline is null order by completed_at, id limit 25)",
    "c2 as (select t.id from tasks t join revisions r using (configuration_id, entity) where r.state = 'retired' and (r.cleaned_at is not null or exists (select 1 from g where g.configuration_id = r.configuration_id and g.entity = r.entity)) and t.status = 'superseded' and superseded_from_status in ('pending', 'processing') and last_error is null and error_code is null and lease_token is null and lease_until is null and execution_deadline is null order by t.id limit 25)",
)


@query(f"select (select count(*) from c1) as completed, (select count(*) from c2) as superseded, (select count(*) from g) as destinations, (select count(*) from (select 1 from events where ts < {NOW} - interval 1814400 second limit 25)) as audit", *_PASSED)
def cleanup_totals(spark, sf):
    """What one bounded pass removes."""
    return _cleanup(spark, sf)["totals"]


@query("select id, status from tasks where id not in (select id from c1) and id not in (select id from c2)", *_PASSED)
def cleanup_tasks_left(spark, sf):
    return _cleanup(spark, sf)["tasks"].select("id", "status")


_STAGED = "configuration_id = 2"
_TURN = f"""o as (select configuration_id, entity from revisions x where state = 'active' and not {_STAGED} and exists (select 1 from revisions y where y.entity = x.entity and y.{_STAGED}))"""


def _activated(spark, sf):
    r = fx.revisions(spark, sf).withColumn("state", F.when(F.expr(_STAGED), "staging").otherwise(F.col("state"))).where(f"not ({_STAGED}) or entity <> 'e1'")
    t = fx.tasks(spark, sf).withColumn("status", F.when(F.expr(_STAGED), "done").otherwise(F.col("status")))
    return revisions.activate(r, t, 2, fx.now())


_BASE = (
    fx.TASKS, fx.REVISIONS.replace("revisions as (", "revisions0 as (", 1), f"revisions as (select * replace (case when {_STAGED} then 'staging' else state end as state) from revisions0 where not ({_STAGED}) or entity <> 'e1')",
    f"tasks1 as (select * replace (case when {_STAGED} then 'done' else status end as status) from tasks)", _TURN,
    "d as (select configuration_id, entity, max(execution_deadline) as until from tasks1 group by all)",
)


@query(f"""select configuration_id, entity, case when {_STAGED} then 'active' when o.entity is not null then 'retired' else state end as state, case when o.entity is not null then {NOW} else retired_at end as retired_at,
  case when o.entity is not null then d.until else retired_execution_until end as retired_execution_until from revisions left join o using (configuration_id, entity) left join d using (configuration_id, entity)""", *_BASE)
def activated_revisions(spark, sf):
    """Only the new configuration's entities turn over; entity e1, which it lacks, stays."""
    return _activated(spark, sf)[0].select("configuration_id", "entity", "state", "retired_at", "retired_execution_until")


@query("""select id, case when e then 'superseded' else status end as status, case when e then status else superseded_from_status end as superseded_from_status, case when not e then lease_token end as lease_token,
  case when not e then execution_deadline end as execution_deadline from (select t.*, o.entity is not null and status <> 'done' as e from tasks1 t left join o using (configuration_id, entity))""", *_BASE)
def activated_tasks(spark, sf):
    return _activated(spark, sf)[1].select("id", "status", "superseded_from_status", "lease_token", "execution_deadline")


@query("select id, case when fingerprint is not distinct from stored_fingerprint then 'skip' else 'embed' end as step from w where fingerprint is not null", fx.TASKS, fx.REVISIONS, _WORK)
def embed_or_skip(spark, sf):
    """Work whose fingerprint is the stored one needs no vector."""
    w = _work(spark, sf)
    return queue.unchanged(w).select("id", F.lit("skip").alias("step")).unionByName(queue.to_embed(w).select("id", F.lit("embed").alias("step")))


@query("select id, completed_at from tasks where status = 'done' and processed_generation = generation and completed_at <= timestamp '2024-01-30 20:00:00' and lease_token is null and lease_until is null and execution_deadline is null order by completed_at, id limit 20", fx.TASKS)
def retention_candidates(spark, sf):
    return retention.completed(fx.tasks(spark, sf), F.lit("2024-01-30 20:00:00").cast("timestamp_ntz"), 20).select("id", "completed_at")


@query("select t.id from tasks t join revisions r using (configuration_id, entity) where r.state = 'retired' and r.cleaned_at is not null and t.status = 'superseded' and superseded_from_status in ('pending', 'processing') and last_error is null and error_code is null and lease_token is null and lease_until is null and execution_deadline is null order by t.id limit 20", fx.TASKS, fx.REVISIONS)
def superseded_candidates(spark, sf):
    return retention.superseded(fx.tasks(spark, sf), fx.revisions(spark, sf), 20).select("id")


@query("select event_id as id, ts as created_at from events where ts < timestamp '2024-01-10' order by ts, event_id limit 30")
def audit_prune(spark, sf):
    rows = fx.read(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"))
    return retention.audit(rows, F.lit("2024-01-10").cast("timestamp_ntz"), 30)


@query(f"""select 'unfinished_tasks' as reason, count(*) as n from tasks where status <> 'done'
  union all select 'stale_or_missing', count(*) from (select doc_id, {FP_SQL} as f from documents) d left join ({_STORED}) s using (doc_id) where f is distinct from stored
  union all select 'orphans', count(*) from embeddings where vec_id not in (select doc_id from documents where doc_id % 10 <> 7)""", fx.TASKS)
def activation_blockers(spark, sf):
    src = fx.read(spark, sf, "documents").where("doc_id % 10 <> 7")
    stale = polling.missing_or_stale(docs_fp(spark, sf).select("doc_id", "fingerprint"), _stored(spark, sf), "doc_id")
    return revisions.blockers(fx.tasks(spark, sf), stale, polling.orphans(fx.read(spark, sf, "embeddings"), src, "vec_id", "doc_id"))


# --- search ----------------------------------------------------------------------------------------------------------

QUERY_VECTOR = [round(((i * 37) % 64) / 64 - 0.5, 6) for i in range(64)]
_Q = "[" + ", ".join(f"{x!r}::double" for x in QUERY_VECTOR) + "]"
_V = "embedding::double[]"
TERMS = ["erblend", "thand", "reesan"]
_DIST = {
    "cosine": f"1 - list_inner_product({_V}, {_Q}) / (sqrt(list_inner_product({_V}, {_V})) * sqrt(list_inner_product({_Q}, {_Q})))",
    "l2": f"sqrt(list_sum(list_transform(list_zip({_V}, {_Q}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))",
    "dot_product": f"-list_inner_product({_V}, {_Q})",
}


def _topk(metric):
    def f(spark, sf):
        rows = hybrid.vector_pool(fx.read(spark, sf, "embeddings"), "vec_id", "embedding", QUERY_VECTOR, metric, 20)
        return rows.select("vec_id", F.round("distance", 6).alias("distance"))

    f.__name__ = {"cosine": "cosine_topk", "l2": "l2_topk", "dot_product": "dot_topk"}[metric]
    return query(f"select vec_id, round(d, 6) as distance from (select vec_id, {_DIST[metric]} as d from embeddings) order by d, vec_id limit 20")(f)


for _m in _DIST:
    _topk(_m)


@query(f"select vec_id, len(embedding)::integer as dims, round(sqrt(list_inner_product({_V}, {_V})), 6) as norm, len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 as valid from embeddings")
def vector_validate(spark, sf):
    v = F.col("embedding")
    return fx.read(spark, sf, "embeddings").select("vec_id", F.size(v).alias("dims"), F.round(vectors.norm(v), 6).alias("norm"), vectors.valid(v, 64).alias("valid"))


_TOK = "tok as (select doc_id, source, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') as t from documents)"
_BM = f"""{_TOK}, st as (select count(*) as n, avg(len(t)) as l from tok),
tf as (select doc_id, source, len(t) as dl, {', '.join(f"len(list_filter(t, lambda x: x = '{w}')) as f{i}" for i, w in enumerate(TERMS))} from tok),
df as (select {', '.join(f'count(*) filter (f{i} > 0) as d{i}' for i in range(len(TERMS)))} from tf),
bm as (select doc_id, source, {' + '.join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * (f{i} * 2.2) / (f{i} + 1.2 * (0.25 + 0.75 * dl / l))" for i in range(len(TERMS)))} as score from tf, df, st where greatest({', '.join(f'f{i}' for i in range(len(TERMS)))}) > 0)"""


@query("select token, count(*) as df, sum(tf)::bigint as cf from (select doc_id, token, count(*) as tf from (select doc_id, unnest(t) as token from tok) group by all) group by token", _TOK)
def token_stats(spark, sf):
    return lexical.statistics(fx.read(spark, sf, "documents"), "doc_id", "text")


@query("select doc_id, round(score, 6) as score from bm order by bm.score desc, doc_id limit 20", _BM)
def bm25_topk(spark, sf):
    rows = lexical.bm25(fx.read(spark, sf, "documents"), "doc_id", "text", TERMS).orderBy(F.desc("score"), "doc_id").limit(20)
    return rows.select("doc_id", F.round("score", 6).alias("score"))


@query("select doc_id, round(score, 6) as score from bm order by bm.score desc, doc_id limit 20", _BM)
def bm25_indexed_topk(spark, sf):
    """The same ranks from an inverted index, of which a query reads its own tokens."""
    docs = fx.read(spark, sf, "documents")
    found = lexical.bm25_of(lexical.postings(docs, "doc_id", "text"), lexical.lengths(docs, "doc_id", "text"), "doc_id", TERMS)
    return found.orderBy(F.desc("score"), "doc_id").limit(20).select("doc_id", F.round("score", 6).alias("score"))


@query("""select id, round(coalesce(0.5 / (60 + l), 0) + coalesce(0.5 / (60 + s), 0), 9) as score from (select event_id as id, row_number() over (order by value desc, event_id) as l from events where event_type = 'click' qualify l <= 1000) full join
  (select event_id as id, row_number() over (order by value, event_id) as s from events where user_id % 2 = 0 qualify s <= 1000) using (id) order by coalesce(0.5 / (60 + l), 0) + coalesce(0.5 / (60 + s), 0) desc, id limit 5""")
def rrf_fusion(spark, sf):
    """Two lists of candidates, of which only the first ones can reach the results."""
    e = fx.read(spark, sf, "events").withColumnRenamed("event_id", "id")
    p = hybrid.SearchParams(candidates=1000)
    lex = hybrid.top(e.where("event_type = 'click'"), [F.desc("value"), F.col("id")], p.candidates, "lexical_rank")
    sem = hybrid.top(e.where("user_id % 2 = 0"), [F.col("value"), F.col("id")], p.candidates, "semantic_rank")
    return hybrid.rrf(lex, sem, "id", p).select("id", F.round("score", 9).alias("score"))


def _hybrid_sql(fresh: str, wl: float, ws: float, there: str = "true") -> str:
    return f"""select doc_id, lexical_rank, semantic_rank, round(coalesce({wl} / (60 + lexical_rank), 0) + coalesce({ws} / (60 + semantic_rank), 0), 9) as score from
  (select * from (select doc_id, row_number() over (order by score desc, doc_id) as lexical_rank from bm where source <> 'src1' and doc_id % 11 <> 0) where lexical_rank <= 20 and {wl} > 0) l full join
  (select * from (select doc_id, row_number() over (order by d, doc_id) as semantic_rank from
     (select vec_id as doc_id, {_DIST['cosine']} as d from embeddings where vec_id in (select doc_id from documents where source <> 'src1' and doc_id % 11 <> 0) and {there} order by d, vec_id limit 80) where {fresh}) where semantic_rank <= 20 and {ws} > 0) s using (doc_id)
  order by coalesce({wl} / (60 + lexical_rank), 0) + coalesce({ws} / (60 + semantic_rank), 0) desc, doc_id limit 5"""


def _search(spark, sf, fresh, wl=0.5, ws=0.5, dest=None):
    src = fx.read(spark, sf, "documents")
    dest = (fx.read(spark, sf, "embeddings") if dest is None else dest).withColumnRenamed("vec_id", "doc_id").drop("label")
    allowed = (F.col("source") != "src1") & (F.col("doc_id") % 11 != 0)
    p = hybrid.SearchParams(lexical_weight=wl, semantic_weight=ws)
    out = hybrid.search(src, dest, "doc_id", "text", "embedding", QUERY_VECTOR, TERMS, allowed, fresh, p)
    return out.select("doc_id", "lexical_rank", "semantic_rank", F.round("score", 9).alias("score"))


@query(_hybrid_sql("true", 0.5, 0.5), _BM)
def hybrid_search(spark, sf):
    return _search(spark, sf, None)


_FRESH = f"doc_id in (select d.doc_id from (select doc_id, {FP_SQL} as f from documents) d join ({_STORED}) s using (doc_id) where f = stored)"


@query(_hybrid_sql(_FRESH, 0.5, 0.5, f"vec_id in (select doc_id from ({_STORED}))"), _BM)
def hybrid_fresh_only(spark, sf):
    """Vectors whose stored fingerprint is not that of the row as it is now leave the pool."""
    stored = _stored(spark, sf).select(F.col("doc_id").alias("vec_id"), F.col("fingerprint").alias("stored"))
    dest = fx.read(spark, sf, "embeddings").join(stored, "vec_id")
    return _search(spark, sf, content.fingerprint(content.render(T), T, PROFILE) == F.col("stored"), dest=dest)


@query(_hybrid_sql("true", 0.0, 1.0), _BM)
def hybrid_zero_weight(spark, sf):
    return _search(spark, sf, None, 0.0, 1.0)


# --- telemetry -------------------------------------------------------------------------------------------------------


@query(f"select e.entity, s.status, count(t.id) as depth, min(t.requested_at) as oldest_request, min(t.execution_started_at) as oldest_start from (select distinct entity from tasks) e cross join (select unnest([{FIVE}]) as status) s left join tasks t on t.entity = e.entity and t.status = s.status group by all", fx.TASKS)
def queue_snapshot(spark, sf):
    return telemetry.queue_snapshot(fx.tasks(spark, sf))


@query("select count(*) filter (status in ('pending', 'processing')) as outstanding, count(*) filter (status = 'failed') as failed, max(execution_deadline) as last_deadline from tasks", fx.TASKS)
def outstanding(spark, sf):
    s = F.col("status")
    return fx.tasks(spark, sf).agg(F.count_if(s.isin("pending", "processing")).alias("outstanding"), F.count_if(s == "failed").alias("failed"), F.max("execution_deadline").alias("last_deadline"))


@query("select t.entity, r.state, count(*) as n from tasks t join revisions r using (configuration_id, entity) group by all", fx.TASKS, fx.REVISIONS)
def tasks_by_state(spark, sf):
    return fx.tasks(spark, sf).join(fx.revisions(spark, sf), ["configuration_id", "entity"]).groupBy("entity", "state").agg(F.count(F.lit(1)).alias("n"))


@query("select event_type, count(value) as count, min(value) as min, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, quantile_disc(value, 0.99) as p99, max(value) as max, round(avg(value), 6) as mean from events group by event_type")
def latency_summary(spark, sf):
    return telemetry.summarise(fx.read(spark, sf, "events"), "value", ["event_type"]).withColumn("mean", F.round("mean", 6))


@query("select event_type, v[least(len(v) - 1, floor(0.5 * len(v))::bigint) + 1] as p50, v[least(len(v) - 1, floor(0.95 * len(v))::bigint) + 1] as p95 from (select event_type, list_sort(list(value)) as v from events group by event_type)")
def floor_percentiles(spark, sf):
    return telemetry.floor_percentiles(fx.read(spark, sf, "events"), "value", ["event_type"])


@query("""select event_id, round(sum(d) over (partition by user_id order by epoch_us(ts) range between 299999999 preceding and current row) / 300.0, 9) as rate from (select event_id, user_id, ts,
  case when lag(value) over w is null then 0 when value < lag(value) over w then value else value - lag(value) over w end as d from events window w as (partition by user_id order by ts))""")
def counter_rate_5m(spark, sf):
    return telemetry.counter_rate(fx.read(spark, sf, "events"), ["user_id"], "ts", "value").select("event_id", F.round("rate", 9).alias("rate"))


_BOUNDS = [5.0, 10.0, 25.0, 50.0, 75.0, 100.0, 250.0, 500.0, 1000.0]
_B = "b as (select event_type, le, count(*) filter (le is null or value <= le) as n from events cross join (select unnest([" + ", ".join(map(str, _BOUNDS)) + ", null]::double[]) as le) group by event_type, le)"


@query("select event_type, le, n from b", _B)
def histogram_buckets(spark, sf):
    return telemetry.cumulative_buckets(fx.read(spark, sf, "events"), ["event_type"], "value", _BOUNDS)


@query("""select event_type, round(coalesce(lo + (le - lo) * (0.95 * total - below) / (n - below), lo), 6) as quantile from (select *, coalesce(lag(le) over w, 0) as lo, coalesce(lag(n) over w, 0) as below, max(n) over (partition by event_type) as total
  from b window w as (partition by event_type order by le nulls last)) where n >= 0.95 * total and below < 0.95 * total""", _B)
def histogram_p95(spark, sf):
    b = telemetry.cumulative_buckets(fx.read(spark, sf, "events"), ["event_type"], "value", _BOUNDS)
    return telemetry.histogram_quantile(b, ["event_type"], 0.95).withColumn("quantile", F.round("quantile", 6))


@query("""select user_id, min(ts) as since, max(ts) as until, count(*) as samples from (select *, sum((not bad)::int) over (partition by user_id order by ts rows unbounded preceding) as run from (select user_id, ts, value > 20 as bad from events)) where bad group by user_id, run having epoch_us(max(ts)) - epoch_us(min(ts)) >= 36000000000""")
def alert_runs(spark, sf):
    return telemetry.firing(fx.read(spark, sf, "events"), ["user_id"], "ts", F.col("value") > 20, 36_000)


@query("select event_type, max(value) as peak, max_by(value, ts) as latest from events group by event_type")
def gauge_latest(spark, sf):
    return fx.read(spark, sf, "events").groupBy("event_type").agg(F.max("value").alias("peak"), F.max_by("value", "ts").alias("latest"))


@query("select user_id, ts, case when value < lag(value) over w then null else value - lag(value) over w end as delta from events window w as (partition by user_id order by ts)")
def counter_delta(spark, sf):
    """A counter's delta, null after a reset."""
    from pyspark.sql import Window

    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts"))
    return fx.read(spark, sf, "events").select("user_id", "ts", F.when(F.col("value") >= before, F.col("value") - before).alias("delta"))


@query("select event_type, time_bucket(interval 1 day, ts) as start, count(*) as n from events group by all")
def event_window_tumbling(spark, sf):
    """Extension: tumbling windows."""
    w = F.window(F.col("ts").cast("timestamp"), "1 day")
    return fx.read(spark, sf, "events").groupBy("event_type", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query()
def deterministic_embed(spark, sf):
    """The seeded embedder; a brute-force test checks it."""
    from ..sources.embedder import embed

    return embed(fx.read(spark, sf, "documents").select("doc_id", content.render(T).alias("content")), "content", 8).select("doc_id", "vector")


from . import metrics  # noqa: E402, F401  (adds its queries to these)

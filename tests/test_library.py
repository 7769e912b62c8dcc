"""The library's queries against DuckDB, and its transitions against plain simulators."""

import copy
import json
import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

import verify
from weftline import contract
from weftline.functions import content, retry
from weftline.operators import hybrid, polling, queue, revisions, telemetry
from weftline.plans import registry
from weftline.sources import embedder, files, state
from weftline.streaming import changes


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in verify.TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, con, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    if name in registry.SQL:
        want = con.execute(registry.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert verify.tidy(got) == verify.tidy(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_fold_equals_row_by_row(spark):
    """The closed form of coalescing against the transition table, one request at a time."""
    rnd = random.Random(5)
    rows = []
    for k in range(400):
        status = rnd.choice([None, "pending", "processing", "done", "failed"])
        g = rnd.randint(1, 5) if status else 0
        p = g if status == "done" else rnd.randint(0, g)
        n = rnd.randint(1, 6)
        gen, st, coalesced = g, status, 0
        for _ in range(n):
            gen += 1
            st = "pending" if st in (None, "pending", "done") else st
            coalesced += gen > p + 1 or st in ("processing", "failed")
        rows.append((k, status, g if status else None, p if status else None, n, coalesced))
    df = spark.createDataFrame(rows, "k int, status string, g long, p long, n long, want long")
    got = queue.coalesced_of(F.col("status"), F.col("g"), F.col("p"), F.col("n"))
    assert df.where(got != F.col("want")).count() == 0


def test_captures_coalesce_to_one_row(spark):
    """One insert, 50 unrelated and 50 no-op updates, 20 real ones: 21 requests, one row of generation 21."""
    req = spark.createDataFrame([(1, "a", "7", "upsert", "trigger", i) for i in range(21)], "configuration_id long, entity string, source_id string, operation string, origin string, seq long")
    rev = spark.createDataFrame([(1, "a", "active")], "configuration_id long, entity string, state string")
    none = spark.createDataFrame([], "configuration_id long, entity string, source_id string, status string, generation long, processed_generation long, attempts long, retry_generation long, next_attempt_at timestamp, last_error string")
    rows = queue.enqueue(none, req, rev, F.lit(datetime(2024, 1, 1))).collect()
    assert [(r["generation"], r["coalesced"], r["status"]) for r in rows] == [(21, 20, "pending")]
    assert queue.enqueue(none, req, rev.withColumn("state", F.lit("retired")), F.lit(datetime(2024, 1, 1))).count() == 0


def test_fingerprint_is_sha256_of_json(spark):
    import hashlib

    texts = ['a "q" \\ b\n\t', "é日本\x01\x1f", "", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    p = registry.PROFILE
    got = [r[0] for r in df.select(content.fingerprint(F.col("t"), "{{t}}", p)).collect()]
    want = [json.dumps([t, "{{t}}", p.name, p.type, p.endpoint, p.model, p.dimensions, p.metric], ensure_ascii=False, separators=(",", ":")) for t in texts]
    assert got == [hashlib.sha256(w.encode()).hexdigest() for w in want]
    with pytest.raises(ValueError):
        content.placeholders("{{a}} {b}")


def test_delays(spark):
    df = spark.createDataFrame([(1, None, 0.0), (1, None, 1.0), (3, None, 0.5), (40, None, 1.0), (1, 90_000.2, 0.0)], "a int, r double, x double")
    assert [r[0] for r in df.select(retry.delay_ms(F.col("a"), F.col("r"), F.col("x"))).collect()] == [500, 1000, 3000, 60_000, 90_001]
    assert (retry.attempt_limit(None), retry.attempt_limit(0)) == (5, 1)


def test_cursor_and_sweep():
    t = datetime(2024, 1, 1)
    assert polling.next_cursor([(t, 1), (t, 2)], 2, t, t) == (t, 2, t)
    assert polling.next_cursor([(t, 1)], 2, t, t + timedelta(hours=1)) == (t - timedelta(seconds=60), None, t + timedelta(hours=1))
    assert polling.sweep_step("source", 5, 5, t, 60) == ("source", None)
    assert polling.sweep_step("source", 4, 5, t, 60) == ("delete", None)
    assert polling.sweep_step("delete", 4, 5, t, 60) == ("source", t + timedelta(seconds=60))


def test_fusion_orders_ids_as_numbers(spark):
    lex = spark.createDataFrame([(10, 1), (2, 2)], "id long, lexical_rank long")
    sem = spark.createDataFrame([(2, 1), (10, 2)], "id long, semantic_rank long")
    rows = hybrid.rrf(lex, sem, "id", hybrid.SearchParams()).collect()
    assert [r["id"] for r in rows] == [2, 10] and rows[0]["score"] == pytest.approx(0.5 / 61 + 0.5 / 62)
    for bad in ({"candidates": 0}, {"k": 1001}, {"lexical_weight": 0.0, "semantic_weight": 0.0}, {"lexical_weight": 2.0}):
        with pytest.raises(ValueError):
            hybrid.SearchParams(**bad)


def test_activation(spark):
    rev = spark.createDataFrame([(1, "a", "active", None), (2, "a", "staging", None)], "configuration_id long, entity string, state string, retired_at timestamp")
    tasks = spark.createDataFrame([(1, "a", "pending", None), (1, "a", "done", None), (2, "a", "done", None)], "configuration_id long, entity string, status string, execution_deadline timestamp")
    after, jobs = revisions.activate(rev, tasks, 2, F.lit(datetime(2024, 1, 1)))
    assert {(r["configuration_id"], r["state"], r["retired_at"]) for r in after.collect()} == {(1, "retired", datetime(2024, 1, 1)), (2, "active", None)}
    assert sorted((r["configuration_id"], r["status"], r["superseded_from_status"]) for r in jobs.collect() if r["status"] != "done") == [(1, "superseded", "pending")]


def test_summary_of_ten_values(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 11)], "k string, v double")
    r = telemetry.summarise(df, "v", ["k"]).first()
    assert (r["count"], r["p50"], r["p95"], r["p99"], r["mean"]) == (10, 5.0, 10.0, 10.0, 5.5)
    f = telemetry.floor_percentiles(df, "v", ["k"]).first()
    assert (f["p50"], f["p95"]) == (6.0, 10.0)


def test_seeded_embedder(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "t string")
    v = [r["vector"] for r in embedder.embed(df, "t", 4).collect()]
    assert v[0] == v[1] == embedder.seeded(4)(["a"])[0] and sum(x * x for x in v[2]) == pytest.approx(1)
    with pytest.raises(ValueError):
        embedder.check([[1.0, float("nan")]], 2)


def test_state_commits_once(spark, tmp_path):
    s = state.State(spark, f"file://{tmp_path}/state")
    v1 = s.commit({"t": spark.range(3), "d": spark.range(1)}, 0)
    assert s.commit({"t": spark.range(5)}, v1) == 2 and (s.read("t").count(), s.read("t", 1).count(), s.read("d").count()) == (5, 3, 1)
    with pytest.raises(state.Conflict):
        s.commit({"t": spark.range(9)}, 1)
    assert len(s.vacuum({1}, 0)) == 0 and s.vacuum(set()) == [] and len(s.vacuum(set(), 0)) == 1 and s.read("t").count() == 5
    assert files.relation_size(spark, f"file://{tmp_path}/state") > 0 and files.relation_size(spark, f"file://{tmp_path}/none") == 0


def test_files(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"source": "x", "rows": [{"id": 1, "title": "a"}, {"id": 2, "title": "b"}]}))
    (tmp_path / "trace.jsonl").write_text('{"name": "db", "memory": "1.5MiB", "cpu": "3.5%"}\n{"name": "db", "memory": "2kB", "cpu": "x"}\n')
    assert files.fixture(spark, str(tmp_path / "f.json")).count() == 2
    r = files.resource_peaks(files.resource_trace(spark, str(tmp_path / "trace.jsonl"))).first()
    assert (r["peak_bytes"], r["peak_cpu"]) == (1.5 * 1024**2, 3.5)
    assert files.provenance(spark, str(tmp_path / "f.json")).first()["bytes"] == (tmp_path / "f.json").stat().st_size
    assert files.synthetic_vectors(spark, 5, 3).count() == 5


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").cast("string").alias("source_id"), F.col("event_type").alias("operation"), F.col("event_id").alias("seq"), "ts")
    events.repartition(3).write.parquet(f"{tmp_path}/log")
    log = changes.change_log(spark, f"{tmp_path}/log", "source_id string, operation string, seq long, ts timestamp_ntz", 1)
    last = {}

    def keep(df, _):
        for r in df.collect():
            last[r["source_id"]] = (r["generation"], r["coalesced"])

    changes.drain(changes.pending_tasks(log.select("source_id", "operation", "seq")), f"{tmp_path}/c1", keep)
    want = {r["source_id"]: (r["n"], r["n"] - 1) for r in events.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert last == want
    seen = {}

    def count(df, _):
        seen.update({(r["operation"], r["start"]): r["n"] for r in df.collect()})

    changes.drain(changes.windowed_counts(changes.change_log(spark, f"{tmp_path}/log", "source_id string, operation string, seq long, ts timestamp_ntz"), "ts", "operation"), f"{tmp_path}/c2", count)
    assert sum(seen.values()) == events.count()


GOOD = {
    "version": contract.VERSION,
    "providers": [{"name": "p", "type": "tei", "endpoint": "http://x", "model": "m", "dimensions": 64, "metric": "cosine"}],
    "entities": [
        {
            "name": "articles", "source": "public.articles", "id": {"field": "id", "type": "bigint"}, "content": {"fields": ["title"], "template": "{{title}} {{cat.name}}"},
            "destination": "weftline.article_vectors", "provider": "p", "detection": {"mode": "polling", "updated_at": "updated_at"},
            "dependencies": [{"name": "cat", "table": "public.categories", "key": "id", "foreign_key": "category_id", "fields": ["name"], "relation": "one"}], "hnsw": {"m": 16, "ef_construction": 64},
        }
    ],
}


def test_contract():
    assert contract.validate(GOOD) == GOOD

    def bad(path, value):
        c = copy.deepcopy(GOOD)
        at = c
        for k in path[:-1]:
            at = at[k]
        at[path[-1]] = value
        with pytest.raises(contract.Invalid):
            contract.validate(c)

    e = ("entities", 0)
    for path, value in [
        (("version",), "v0"), (("more",), 1), (("providers",), []), (("providers", 0, "dimensions"), 2001), (("providers", 0, "metric"), "l1"), (("providers", 0, "type"), "openai"),
        ((*e, "provider"), "q"), ((*e, "destination"), "weftline.tasks"), ((*e, "destination"), "public.x"), ((*e, "source"), "weftline.x"), ((*e, "content", "template"), "{{body}}"),
        ((*e, "content", "template"), "{title}"), ((*e, "detection"), {"mode": "polling"}), ((*e, "dependencies", 0, "relation"), "many"), ((*e, "hnsw", "ef_construction"), 20), ((*e, "name"), "x" * 49),
        (("operations",), {"batch_size": 0}),
    ]:
        bad(path, value)


def test_activation_leaves_other_entities_alone(spark):
    rev = spark.createDataFrame([(1, "a", "active"), (1, "b", "active")], "configuration_id long, entity string, state string")
    rev = revisions.stage(rev, 2, ["a", "c"]).withColumn("retired_at", F.lit(None).cast("timestamp"))
    assert {(r[0], r[1], r[2]) for r in rev.select("configuration_id", "entity", "state").collect()} == {(1, "a", "active"), (1, "b", "active"), (2, "a", "staging"), (2, "c", "active")}
    rev = rev.where("entity <> 'c'")
    rows = [(1, "a", "pending", None, "t", "x"), (1, "b", "pending", None, "t", "x"), (1, "a", "superseded", "pending", None, None), (0, "b", "superseded", "failed", None, None)]
    tasks = spark.createDataFrame(rows, "configuration_id long, entity string, status string, superseded_from_status string, lease_token string, d string")
    tasks = tasks.withColumn("execution_deadline", F.when(F.col("d").isNotNull(), F.lit(datetime(2024, 1, 2)))).drop("d")
    after, jobs = revisions.activate(rev, tasks, 2, F.lit(datetime(2024, 1, 1)))
    assert {(r["configuration_id"], r["entity"], r["state"], r["retired_execution_until"]) for r in after.collect()} == {(1, "a", "retired", datetime(2024, 1, 2)), (1, "b", "active", None), (2, "a", "active", None)}
    got = sorted((r["configuration_id"], r["entity"], r["status"], r["superseded_from_status"], r["lease_token"]) for r in jobs.where("status <> 'superseded' or superseded_from_status = 'failed' or lease_token is null").collect() if r["superseded_from_status"] != "superseded")
    assert got == [(0, "b", "superseded", "failed", None), (1, "a", "superseded", "pending", None), (1, "b", "pending", None, "t")]
    with pytest.raises(revisions.Refused):
        revisions.activate(rev, tasks.withColumn("configuration_id", F.lit(2)), 2, F.lit(datetime(2024, 1, 1)))
    with pytest.raises(revisions.Refused):
        revisions.cancel(rev, tasks, 1, F.lit(datetime(2024, 1, 1)))
    gone, _ = revisions.cancel(rev, tasks, 2, F.lit(datetime(2024, 1, 1)))
    assert gone.where("configuration_id = 2").select("state").collect() == [("retired",)]


def test_work_past_its_deadline_and_of_others_is_discarded(spark):
    now, past, later = datetime(2024, 1, 1), datetime(2023, 12, 31), datetime(2024, 1, 2)
    rows = [(1, "t", "processing", later, later), (2, "t", "processing", later, past), (3, "u", "processing", later, later), (4, None, "done", None, None)]
    cols = "id long, lease_token string, status string, lease_until timestamp, execution_deadline timestamp"
    more = {"live": True, "token": "t", "generation": 2, "seen_generation": 2, "seen_fingerprint": "f", "fingerprint": "f", "stored_fingerprint": "g", "has_vector": True, "processed_generation": 1, "attempts": 1, "retry_generation": 2, "aborted": False, "code": "x", "retryable": False, "delay_ms": 0}
    w = spark.createDataFrame(rows, cols).select("*", *[F.lit(v).alias(k) for k, v in more.items()], *[F.lit(None).cast("timestamp").alias(c) for c in ("requested_at", "next_attempt_at", "completed_at")], *[F.lit(None).cast("string").alias(c) for c in ("last_error", "error_code")])
    assert {r["id"]: r["outcome"] for r in queue.finalize(w, F.lit(now)).collect()} == {1: "upsert", 2: "discard", 3: "discard", 4: "discard"}
    assert {r["id"]: (r["outcome"], r["new_status"]) for r in queue.fail(w, F.lit(now), 3).collect()} == {1: ("task_failed", "failed"), 2: ("task_failed", "failed"), 3: ("task_discarded", "processing"), 4: ("task_discarded", "done")}


def test_a_late_change_does_not_overwrite_a_later_one(spark, tmp_path):
    for k, row in enumerate([("a", "delete", 10), ("a", "upsert", 5)]):
        spark.createDataFrame([row], "source_id string, operation string, seq long").coalesce(1).write.parquet(f"{tmp_path}/in{k}")
    seen = []
    for k in range(2):
        spark.read.parquet(f"{tmp_path}/in{k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        log = changes.change_log(spark, f"{tmp_path}/log", "source_id string, operation string, seq long", 1)
        changes.drain(changes.pending_tasks(log), f"{tmp_path}/c", lambda df, _: seen.extend((r["generation"], r["operation"]) for r in df.collect()))
    assert seen == [(1, "delete"), (2, "delete")]


def test_a_change_becomes_a_vector_and_nothing_is_embedded_twice(spark, tmp_path):
    from weftline.streaming import loops

    t0 = datetime(2024, 1, 1, 12)
    s = state.State(spark, f"file://{tmp_path}/s")
    task = "id long, configuration_id long, entity string, source_id string, operation string, status string, generation long, processed_generation long, attempts long, retry_generation long, next_attempt_at timestamp, requested_at timestamp, lease_token string, lease_until timestamp, execution_started_at timestamp, execution_deadline timestamp, completed_at timestamp, last_error string, error_code string"
    s.commit({
        "tasks": spark.createDataFrame([], task), "revisions": spark.createDataFrame([(1, "a", "active")], "configuration_id long, entity string, state string"),
        "vectors": spark.createDataFrame([("a", "3", [0.5], "f3", 1)], "entity string, source_id string, embedding array<double>, fingerprint string, configuration_id long"),
        "cursors": spark.createDataFrame([], "entity string, cursor_time timestamp, cursor_id long, window_end timestamp"),
    }, 0)
    rows = [(k, t0 - timedelta(minutes=5)) for k in (1, 2, 10)] + [(3, t0 - timedelta(minutes=4))]
    source = spark.createDataFrame(rows, "id long, updated_at timestamp")
    assert loops.poll(s, source, "a", "updated_at", "id", 1, t0, t0, 3) == 3
    cursor = s.read("cursors").first()
    assert (cursor["cursor_time"], cursor["cursor_id"], cursor["window_end"]) == (t0 - timedelta(minutes=5), 10, t0)
    assert loops.poll(s, source, "a", "updated_at", "id", 1, t0, t0, 3) == 1
    assert s.read("cursors").first()["cursor_id"] is None and s.read("tasks").count() == 4
    content_ = spark.createDataFrame([("a", str(k), f"text {k}", f"f{k}") for k in (1, 3, 10)], "entity string, source_id string, content string, fingerprint string")
    loops.claim(s, F.lit(t0), 10, "t")
    embed = lambda df: df.select("id", F.array(F.length("content").cast("double")).alias("vector"))
    got = loops.work(s, content_, embed, F.lit(t0 + timedelta(seconds=1)), "t")
    assert got == {"upsert": 2, "unchanged": 1, "delete": 1, "embedded": 2}
    assert s.read("tasks").where("status = 'done' and lease_token is null and processed_generation = generation").count() == 4
    assert {r["source_id"]: r["embedding"] for r in s.read("vectors").collect()} == {"1": [6.0], "3": [0.5], "10": [7.0]}
    assert loops.work(s, content_, embed, F.lit(t0 + timedelta(seconds=2)), "t") == {"embedded": 0}


def test_search_is_pinned_to_a_revision():
    seen = iter([1, 2, 2, 2])
    assert hybrid.pinned(lambda r: [r], lambda: next(seen)) == [2]
    with pytest.raises(LookupError):
        hybrid.pinned(lambda r: [], lambda: None)
    turn = iter(range(99))
    with pytest.raises(RuntimeError):
        hybrid.pinned(lambda r: [], lambda: next(turn))

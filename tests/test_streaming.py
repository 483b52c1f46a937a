"""Streams fed in several micro-batches equal their batch twins."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chatloom import fixtures as fx
from chatloom.operators.pairing import pair_turns
from chatloom.sources import io as IO
from chatloom.streaming import jobs as T


def _write_batches(df, path, cond_list):
    for cond in cond_list:
        df.where(cond).coalesce(1).write.mode("append").parquet(path)


def _stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture(scope="module")
def state_store(spark):
    T.enable_state_store(spark)


def _drain_parts(spark, job, parts, tmp_path):
    """Feeds the parts one by one to a query restarted from its checkpoint; rows and the state rows left."""
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    left = None
    parts[0].limit(0).write.parquet(src)
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(src)
        q = job(spark.readStream.schema(parts[0].schema).parquet(src)).writeStream.option("checkpointLocation", ck).trigger(availableNow=True).format("parquet").option("path", out).start()
        q.awaitTermination()
        states = [x["stateOperators"][0]["numRowsTotal"] for x in map(_progress, q.recentProgress) if x["stateOperators"]]
        left = states[-1] if states else left
    return spark.read.parquet(out), left


def _progress(p):
    import json

    return json.loads(p.json) if hasattr(p, "json") else p


def test_pairing_of_late_turns_within_the_watermark(spark, tmp_path, state_store):
    rnd = random.Random(4)
    start, rows = dt.datetime(2024, 1, 1), []
    for conv in [None, *range(30)]:
        at = start + dt.timedelta(minutes=rnd.randint(0, 600))
        for turn in range(rnd.randint(1, 25) if conv is not None else 30):
            at += dt.timedelta(seconds=rnd.randint(0, 200))
            rows.append((conv, turn, rnd.choice(["user", "assistant", "assistant", "system", None]), rnd.choice([f"t{conv}-{turn}", None, ""]), at))
    schema = "conv_id long, turn long, role string, text string, ts timestamp_ntz"
    arrival = sorted(rows, key=lambda r: r[4] + dt.timedelta(seconds=rnd.randint(0, 3000)))
    parts = [spark.createDataFrame(arrival[a:b], schema) for a, b in ((0, 90), (90, 91), (91, 200), (200, len(arrival)))]
    turns = spark.createDataFrame(rows, schema)
    parts.append(IO.closing_row(turns, "ts", dt.timedelta(days=40)))
    got, left = _drain_parts(spark, T.stream_pair, parts, tmp_path)
    want = pair_turns(turns).select("conv_id", "turn", "user_message", "assistant_response")
    assert got.count() == want.count() > 50 and want.where("conv_id is null").count() > 0
    assert got.exceptAll(want).count() == 0
    assert left == 0  # nothing is kept of conversations that the watermark has left behind


def test_pairing_forgets_after_the_retention_only(spark, tmp_path, state_store):
    schema = "conv_id long, turn long, role string, text string, ts timestamp_ntz"
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    parts = [spark.createDataFrame(rows, schema) for rows in (
        [(1, 0, "assistant", "a", day(0)), (2, 0, "assistant", "b", day(0))], [(1, 1, "user", "u", day(4))], [(3, 0, "system", "s", day(6))],
        [(1, 2, "user", "v", day(8)), (2, 1, "user", "w", day(8))], [(None, None, None, None, day(40))])]
    got, left = _drain_parts(spark, lambda x: T.stream_pair(x, "1 hour", dt.timedelta(days=5)), parts, tmp_path)
    assert sorted((r.conv_id, r.turn, r.assistant_response) for r in got.collect()) == [(1, 1, "a"), (1, 2, "a")] and left == 0


def test_replies_with_empty_finish_reasons_null_requests_and_expiry(spark, tmp_path, state_store):
    at = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n)
    sse = lambda text, reason: 'data: {"choices":[{"delta":{"content":"%s"},"finish_reason":%s}]}' % (text, reason)
    schema = "request_id long, provider string, seq long, line string, ts timestamp_ntz"
    rows = [(1, "openai", 1, sse("he", '""'), at(0)), (None, "openai", 1, sse("nu", "null"), at(0)), (2, "openai", 1, sse("never", '""'), at(1)),
            (1, "openai", 2, sse("llo", '""'), at(10)), (None, "openai", 2, sse("ll", '"length"'), at(10)), (None, "openai", 3, "data: [DONE]", at(11)),
            (1, "openai", 3, sse("", '"stop"'), at(20))]
    parts = [spark.createDataFrame(rows[a:b], schema) for a, b in ((0, 3), (3, 6), (6, 7))]
    chunks = spark.createDataFrame(rows, schema)
    got, left = _drain_parts(spark, T.stream_reassemble, [*parts, IO.closing_row(chunks, "ts", dt.timedelta(days=2))], tmp_path)
    want = T.reassemble_reply(chunks).where("request_id is null or request_id = 1")
    assert {(r.request_id, r.content, r.finish_reason) for r in got.collect()} == {(1, "hello", "stop"), (None, "null", "length")}
    assert got.exceptAll(want).count() == 0 and left == 0


def test_requests_of_a_bucket_keep_apart(spark, tmp_path, state_store):
    at = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n)
    line = lambda text, done=False: '{"message":{"content":"%s"},"done":%s}' % (text, str(done).lower())
    schema = "request_id long, provider string, seq long, line string, ts timestamp_ntz"
    parts = [[], [], []]
    for r in range(30):  # finished in the first, second or third part, or never; a late line to those of the first
        parts[0] += [(r, "ollama", 1, line(f"a{r}"), at(r)), (r, "ollama", 2, line("b", r % 4 == 0), at(r))]
        parts[1] += [(r, "ollama", 3, line(f"c{r}", r % 4 == 1), at(40))]
        parts[2] += [(r, "ollama", 4, line("d", True), at(60))] if r % 4 == 2 else []
    frames = [spark.createDataFrame(p, schema) for p in parts]
    chunks = spark.createDataFrame(sum(parts, []), schema)
    got, left = _drain_parts(spark, lambda c: T.stream_reassemble(c, buckets=2), [*frames, IO.closing_row(chunks, "ts", dt.timedelta(days=2))], tmp_path)
    want = {(r, f"a{r}b") for r in range(0, 30, 4)} | {(r, f"a{r}bc{r}") for r in range(1, 30, 4)} | {(r, f"a{r}bc{r}d") for r in range(2, 30, 4)}
    assert {(r.request_id, r.content) for r in got.collect()} == want and got.count() == len(want) and left == 0


def test_inactivity_of_null_users(spark, tmp_path, state_store):
    rows = [(u, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)) for u in (None, 5) for m in [*range(0, 60, 5), *range(800, 830, 10), 5000]]
    events = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz")
    got, _ = _drain_parts(spark, lambda x: T.stream_inactivity(x, 8.0, 10), [events.where("ts < '2024-01-01 00:30:00'"), events.where("ts >= '2024-01-01 00:30:00'")], tmp_path)
    want = T.idle_points(events, 8.0, 10, now=max(t for _, t in rows))
    assert got.count() == want.count() == 2 and got.exceptAll(want).count() == 0


def _interaction_batches(spark, sf, path):
    inter = fx.fx_interactions(spark, sf)
    ts = F.col("timestamp")
    _write_batches(inter, path, [ts < dt.datetime(2024, 1, 10), ts.between(dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20)),
                                 ts > dt.datetime(2024, 1, 20)])
    return inter


def test_triggers_across_batches_in_more_tasks_than_lines(spark, sf_mid, tmp_path, state_store):
    path = str(tmp_path / "inter")
    inter = _interaction_batches(spark, sf_mid, path).withColumn("model_line", F.when(F.col("model_line") > 0, F.col("model_line")))
    seen = []

    def job(batch, batch_id, folder):
        run = T.trigger_batch()
        first = run(batch, batch_id, folder).collect()
        again = run(batch, batch_id, folder)  # a replayed batch gives the same rows and leaves the same counters
        assert sorted(map(tuple, first), key=str) == sorted(map(tuple, again.collect()), key=str)
        seen.append(again.select(F.spark_partition_id()).distinct().count())
        return again

    stream = _stream(spark, path, inter.schema).withColumn("model_line", F.when(F.col("model_line") > 0, F.col("model_line")))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = T.run_available_now(stream, "test-t5", batch_job=job, schema=T.TRIGGER_SCHEMA)
        want = T.trigger_points(inter)
        assert got.count() == want.count() > 0 and want.where("model_line is null").count() > 0
        assert got.exceptAll(want).count() == 0
        assert len(seen) == 3 and max(seen) > 4  # four model lines
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_trigger_table(spark, sf_small, tmp_path, state_store):
    inter = fx.fx_interactions(spark, sf_small)
    src, out = str(tmp_path / "src"), str(tmp_path / "triggers")
    _write_batches(inter, src, [F.col("timestamp") < dt.datetime(2024, 1, 15), F.col("timestamp") >= dt.datetime(2024, 1, 15)])
    T.stream_triggers(_stream(spark, src, inter.schema), out, str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(out).drop("batch").exceptAll(T.trigger_points(inter)).count() == 0
    assert spark.read.parquet(out).count() == T.trigger_points(inter).count()


def test_window_stats_across_batches(spark, sf_mid, tmp_path, state_store):
    path = str(tmp_path / "inter4")
    inter = _interaction_batches(spark, sf_mid, path)
    got = T.run_available_now(T.stream_stats(_stream(spark, path, inter.schema), "1 day", "1 hour"), "test-t4",
                              mode="update", keys=["window_start"])
    want = T.window_stats(inter, "1 day")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_inactivity_across_batches(spark, sf_mid, tmp_path, state_store):
    ev = spark.read.parquet(f"{sf_mid}/events.parquet")
    path = str(tmp_path / "events")
    ts = F.col("ts")
    _write_batches(ev, path, [ts < dt.datetime(2024, 1, 10), ts.between(dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20)),
                              ts > dt.datetime(2024, 1, 20)])
    got = T.run_available_now(T.stream_inactivity(_stream(spark, path, ev.schema), 8.0, 10), "test-t6")
    latest = ev.agg(F.max("ts")).first()[0]
    want = T.idle_points(ev, 8.0, 10, now=latest)
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0


def test_reassembly_across_batches(spark, sf_small, tmp_path, state_store):
    chunks = fx.fx_chunks(spark, sf_small)
    path = str(tmp_path / "chunks")
    _write_batches(chunks, path, [F.col("seq") < 100, F.col("seq").between(100, 199), F.col("seq") >= 200])
    got = T.run_available_now(T.stream_reassemble(_stream(spark, path, chunks.schema), "3000 days"), "test-t3")
    want = T.reassemble_reply(chunks)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    text = fx.fx_turns(spark, sf_small).where("role = 'assistant'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), F.col("text").alias("content"))
    assert got.select("request_id", "content").exceptAll(text).count() == 0


def test_interaction_sink_stream(spark, sf_small, tmp_path, state_store):
    inter = fx.fx_interactions(spark, sf_small)
    src = str(tmp_path / "src")
    _write_batches(inter, src, [F.col("timestamp") < dt.datetime(2024, 1, 15), F.col("timestamp") >= dt.datetime(2024, 1, 15)])
    out = str(tmp_path / "store")
    q = IO.write_interactions_stream(_stream(spark, src, inter.schema), out, str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    back = spark.read.parquet(out)
    assert back.drop("date", "batch").exceptAll(inter).count() == 0 and back.count() == inter.count()
    assert {"date", "batch"} <= set(back.columns)

"""Structured Streaming operators (T1-T6) and their batch twins.

Every stream job is ``readStream`` -> DataFrame operators -> ``writeStream``.
Stateful steps use ``transformWithStateInPandas`` (RocksDB state store) keyed
by conversation / request / model line, so state is partitioned with the key
and never held by the driver.  ``run_available_now`` drains a source into a
parquet sink under the shared checkpoint folder and reads the result back.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Iterable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from chatloom.config import DEFAULT, Thresholds
from chatloom.functions import content as C
from chatloom.session import checkpoint_dir
from chatloom.streaming.machines import IDLE_SCHEMA, TRIGGER_SCHEMA, IdleMachine, TriggerMachine

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def enable_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def run_available_now(stream: DataFrame, name: str, mode: str = "append", keys: list[str] | None = None,
                      feeds: Iterable[Callable[[], None]] = (lambda: None,), batch_job: Callable | None = None, schema: str | None = None) -> DataFrame:
    """Drain all available input through ``stream`` and return what the sink holds.

    Each of ``feeds`` is called in turn, and what it added is drained before the next one, by a
    query restarted from its checkpoint: state and watermark go on from where they were.

    append: rows are appended to a parquet sink.  update: each micro-batch's
    changed rows are appended with their batch id, and the latest version per
    ``keys`` is returned (an upsert log, so windows that are still open at the
    end are reported too).  batch: ``batch_job(micro-batch, batch id, state folder)``
    gives the rows (of ``schema``) that a micro-batch appends.
    """
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"
    out, ck = f"{base}/data", f"{base}/checkpoint"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)  # there even if nothing is emitted
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)

    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = batch_job(batch, batch_id, f"{base}/state") if batch_job else batch
        rows.write.mode("overwrite").parquet(f"{out}/_batch={batch_id}")  # a replayed batch replaces itself

    for feed in feeds:
        feed()
        writer = stream.writeStream.option("checkpointLocation", ck).trigger(availableNow=True).outputMode("append" if batch_job else mode)
        writer = writer.format("parquet").option("path", out) if mode == "append" and not batch_job else writer.foreachBatch(sink)
        writer.start().awaitTermination()
    if batch_job:
        return spark.read.schema(schema).parquet(out).drop("_batch")
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(out)
    result = spark.read.schema(StructType([*stream.schema.fields, StructField("_batch", LongType())])).parquet(out)
    latest = result.groupBy(*keys).agg(F.max("_batch").alias("_batch"))
    return result.join(latest, [*keys, "_batch"]).drop("_batch")


# ----------------------------------------------------------------------------- T1

def stream_score(requests: DataFrame, rules=None, cfg: Thresholds = DEFAULT) -> DataFrame:
    """Stateless per request: latest pair (P1) -> rules (R2) -> score -> record."""
    from chatloom.operators.interactions import build_interactions
    from chatloom.operators.pairing import latest_pair
    from chatloom.operators.rewrite import apply_rules
    from chatloom.functions.scoring import score

    pairs = latest_pair(requests, skip_prompt_like=False).where(
        F.col("user_message").isNotNull() & (F.length(F.coalesce("previous_assistant", F.lit(""))) > 0)
    )
    if rules:
        pairs = apply_rules(pairs.withColumn("_role", F.lit("user")), rules, text="user_message", role="_role").drop("_role")
    scored = score(pairs, "user_message", True, cfg)
    return build_interactions(
        scored.select(
            F.col("conversation_id").cast("string").alias("conversation_id"),
            F.col("timestamp"),
            "user_message",
            F.col("previous_assistant").alias("assistant_response"),
            "sentiment", "weight", "is_golden",
            F.lit(False).alias("is_refusal"),
        ),
        cfg,
    )


# ----------------------------------------------------------------------------- T2

PAIR_SCHEMA = "conv_id bigint, turn bigint, user_message string, assistant_response string"


def _ceil_ms(us: int) -> int:
    """The first millisecond, the timers' grid, that is not before ``us``."""
    return -(-us // 1000)


def _micros(column: pd.Series) -> list[int]:
    return column.to_numpy().astype("datetime64[us]").astype("int64").tolist()


def _texts(column: pd.Series) -> list:
    """Strings, and None for whatever stands for null."""
    return [t if isinstance(t, str) else None for t in column]


def _state_key(column: str) -> Column:
    """A long key as text, empty for null: the Python workers mix up null keys with others of their batch."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias("state_key")


def _key_column(value: str, n: int) -> pd.Series:
    """The long (or null) column of a state key."""
    return pd.Series([int(value) if value else None] * n, dtype="Int64")


class OneTimer:
    """Keeps at most one event-time timer per key; its time is a value state, since the handle lists timers only one by one."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.handle = handle
        self.state = handle.getValueState("timer", "ms bigint")

    def at(self) -> int | None:
        return self.state.get()[0] if self.state.exists() else None

    def move(self, ms: int) -> None:
        now = self.at()
        if now == ms:
            return
        if now is not None:
            self.handle.deleteTimer(now)
        self.handle.registerTimer(ms)
        self.state.update((ms,))

    def fired(self) -> None:
        self.state.clear()


class PairProcessor(StatefulProcessor):
    """Holds turns back until the watermark has passed them, so late ones take their place.

    State of a conversation: the turns that are not released yet, the last
    assistant text released, and the time of its last turn.  One event-time
    timer per conversation releases the earliest turn held; when none is held it
    stands at the last turn plus the retention, and then everything is cleared.
    """

    def __init__(self, retention_us: int):
        self.retention_us = retention_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "turn bigint, role string, text string, us bigint")
        self.last = handle.getValueState("last", "text string, us bigint")
        self.timer = OneTimer(handle)

    def handleInputRows(self, key, rows, timerValues):
        first = newest = None
        for pdf in rows:
            pdf = pdf[pdf["role"].notna() & pdf["turn"].notna()]
            if len(pdf):
                us = _micros(pdf["ts"])
                self.held.appendList(list(zip(map(int, pdf["turn"]), pdf["role"], _texts(pdf["text"]), us)))
                first = min(us) if first is None else min(first, *us)
                newest = max(us) if newest is None else max(newest, *us)
        if first is not None:
            text, before = self.last.get() if self.last.exists() else (None, newest)
            self.last.update((text, max(newest, before)))
            now = self.timer.at()  # of the earliest turn held, or later
            self.timer.move(_ceil_ms(first) if now is None else min(now, _ceil_ms(first)))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.timer.fired()
        if not self.last.exists():
            return
        watermark = timerValues.getCurrentWatermarkInMs()
        held = sorted(self.held.get(), key=lambda r: (r[0], r[3])) if self.held.exists() else []
        rest = [r for r in held if _ceil_ms(r[3]) > watermark]
        text, newest = self.last.get()
        users = []
        for turn, role, own, us in held:
            if _ceil_ms(us) > watermark:
                continue
            if role == "user" and text is not None:
                users.append((turn, own, text))
            if role == "assistant" and own is not None:
                text = own
        if not rest and _ceil_ms(newest + self.retention_us) <= watermark:
            self.held.clear()
            self.last.clear()
        else:
            if len(rest) < len(held):
                self.held.put(rest) if rest else self.held.clear()
                self.last.update((text, newest))
            self.timer.move(_ceil_ms(min(r[3] for r in rest) if rest else newest + self.retention_us))
        if users:
            turns, messages, texts = zip(*users)
            yield pd.DataFrame({"conv_id": _key_column(key[0], len(users)), "turn": turns, "user_message": messages, "assistant_response": texts})

    def close(self) -> None:
        pass


def stream_pair(turns: DataFrame, delay: str = "1 hour", retention: dt.timedelta = dt.timedelta(days=30), event_time: str = "ts") -> DataFrame:
    """Pair each user turn with the last earlier assistant turn of its conversation.

    Turns may arrive in any order that is at most ``delay`` of event time late:
    each is held until the watermark has passed it, and then takes its place by
    turn number (event time must not fall as turns rise).  Later ones are
    dropped by the watermark.  A conversation without a turn for ``retention``
    of event time is forgotten, so state is bounded by what is active.  Turns
    without a conversation are one conversation, as in the batch form; rows
    without a role or turn number pair with nothing.
    """
    src = turns.select(_state_key("conv_id"), "turn", "role", "text", F.col(event_time).cast("timestamp").alias("ts")).withWatermark("ts", delay)
    return src.groupBy("state_key").transformWithStateInPandas(
        PairProcessor(int(retention.total_seconds() * 1_000_000)), PAIR_SCHEMA, "Append", "EventTime")


# ----------------------------------------------------------------------------- T3

REPLY_SCHEMA = "request_id bigint, content string, finish_reason string, done boolean"


def parsed_chunks(chunks: DataFrame, *extra: str) -> DataFrame:
    """N6 on a chunk table: kept lines with (seq, delta, finish_reason, done, end) and the ``extra`` columns."""
    p = C.parse_stream_line(F.col("line"), F.col("provider"))
    return chunks.select("request_id", "seq", *extra, p.alias("p")).select(
        "request_id", "seq", *extra, "p.keep", "p.delta", "p.finish_reason", "p.done", "p.end"
    )


def reassemble_reply(chunks: DataFrame) -> DataFrame:
    """N7 (batch): per request, non-empty deltas in seq order, the last non-empty finish_reason
    (``stop`` if there is none), done = any done line.  Lines after an SSE ``[DONE]`` are ignored.
    Every line is parsed once; window and aggregate share one shuffle by request."""
    ended = F.min(F.when(F.col("end"), F.col("seq"))).over(Window.partitionBy("request_id"))
    p = parsed_chunks(chunks).withColumn("_end", ended)
    kept = p.where(F.col("keep") & (F.col("_end").isNull() | (F.col("seq") < F.col("_end"))))
    return kept.groupBy("request_id").agg(
        F.coalesce(F.expr("listagg(delta, '') WITHIN GROUP (ORDER BY seq)"), F.lit("")).alias("content"),
        F.coalesce(F.max_by("finish_reason", F.when(F.col("finish_reason") != "", F.col("seq"))), F.lit("stop")).alias("finish_reason"),
        F.bool_or("done").alias("done"),
    )


class ReassembleProcessor(StatefulProcessor):
    """Buffer parsed chunks per request; emit the reply once it is finished.

    With a retention one event-time timer per request stands at its last line
    plus the retention; then the buffer of a request that never finished, or
    the mark of one that did, is cleared.
    """

    def __init__(self, retention_us: int | None = None):
        self.retention_us = retention_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buf = handle.getListState("chunks", "seq bigint, delta string, finish_reason string, done boolean, end boolean")
        self.sent = handle.getValueState("sent", "sent boolean")
        self.timer = OneTimer(handle)

    def handleInputRows(self, key, rows, timerValues):
        finished, sent, newest = False, self.sent.exists(), None
        for pdf in rows:
            if "keep" in pdf:
                pdf = pdf[pdf["keep"].eq(True) | pdf["end"].eq(True)]
            if self.retention_us is not None and len(pdf):
                newest = max([*([] if newest is None else [newest]), *_micros(pdf["ts"])])
            if sent or not len(pdf):  # lines after the reply was emitted (such as a late [DONE]) are ignored
                continue
            flags = [pdf[c].eq(True).tolist() for c in ("done", "end")]
            self.buf.appendList(list(zip(map(int, pdf["seq"]), _texts(pdf["delta"]), _texts(pdf["finish_reason"]), *flags)))
            said = pdf["finish_reason"].notna() & (pdf["finish_reason"] != "")
            finished |= bool(pdf["done"].eq(True).any() or said.any() or pdf["end"].eq(True).any())
        if newest is not None:
            now = self.timer.at()
            expiry = _ceil_ms(newest + self.retention_us)
            self.timer.move(expiry if now is None else max(now, expiry))
        if not finished:  # earlier lines did not finish it either: the buffer is read once, at the end
            return
        allrows = pd.DataFrame(list(self.buf.get()), columns=["seq", "delta", "finish_reason", "done", "end"]).sort_values("seq", kind="mergesort")
        if allrows["end"].any():
            allrows = allrows[allrows["seq"] < allrows.loc[allrows["end"], "seq"].min()]
        fin = allrows["finish_reason"].dropna()
        fin = fin[fin != ""]
        self.buf.clear()
        self.sent.update((True,))
        yield pd.DataFrame(
            {
                "request_id": _key_column(key[0], 1),
                "content": ["".join(d for d in allrows["delta"] if isinstance(d, str) and d)],
                "finish_reason": [fin.iloc[-1] if len(fin) else "stop"],
                "done": [bool(allrows["done"].any())],
            }
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.timer.fired()
        self.buf.clear()
        self.sent.clear()
        yield from ()

    def close(self) -> None:
        pass


class ReassembleBucketProcessor(StatefulProcessor):
    """T3 for all requests of a bucket at once: a call of the state store costs far more than a line, so they are made per bucket.

    State of a bucket: the lines of requests that are not finished, and what is
    known of each request, the time of a last line and whether its reply was
    sent (of several rows of a request the latest time, and sent if one says
    so).  One event-time timer stands at the first expiry of a request or
    before it; then the requests that have expired are cleared.
    """

    def __init__(self, retention_us: int):
        self.retention_us = retention_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", "request string, seq bigint, delta string, finish_reason string, done boolean, end boolean")
        self.known = handle.getListState("known", "request string, us bigint, sent boolean")
        self.timer = OneTimer(handle)

    def requests(self) -> dict[str, tuple[int, bool]]:
        found: dict[str, tuple[int, bool]] = {}
        for request, us, sent in self.known.get():
            before = found.get(request, (us, False))
            found[request] = max(us, before[0]), sent or before[1]
        return found

    def handleInputRows(self, key, rows, timerValues):
        known = self.requests()
        newest: dict[str, int] = {}
        lines: dict[str, list[tuple]] = {}
        for pdf in rows:
            pdf = pdf[pdf["keep"].eq(True) | pdf["end"].eq(True)]
            if not len(pdf):
                continue
            flags = [pdf[c].eq(True).tolist() for c in ("done", "end")]
            for request, us, *line in zip(pdf["request"], _micros(pdf["ts"]), map(int, pdf["seq"]), _texts(pdf["delta"]), _texts(pdf["finish_reason"]), *flags):
                newest[request] = max(us, newest.get(request, us))
                if request not in known or not known[request][1]:  # lines after the reply was sent (such as a late [DONE]) are ignored
                    lines.setdefault(request, []).append(tuple(line))
        if not newest:
            return
        done = {r for r, own in lines.items() if any(is_done or end or reason for _, _, reason, is_done, end in own)}
        waiting = [(r, *line) for r, own in lines.items() if r not in done for line in own]
        if any(r in known for r in done):  # these may have earlier lines
            rest, earlier = [], {}
            for r, *line in self.open.get():
                if r in done:
                    earlier.setdefault(r, []).append(tuple(line))
                else:
                    rest.append((r, *line))
            for r, own in earlier.items():
                lines[r] = own + lines[r]
            rest += waiting
            self.open.put(rest) if rest else self.open.clear()
        elif waiting:
            self.open.appendList(waiting)
        self.known.appendList([(r, us, r in done) for r, us in newest.items()])
        now, expiry = self.timer.at(), _ceil_ms(min(newest.values()) + self.retention_us)
        self.timer.move(expiry if now is None else min(now, expiry))
        if done:
            yield self._replies([(r, lines[r]) for r in lines if r in done])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.timer.fired()
        watermark = timerValues.getCurrentWatermarkInMs()
        known = self.requests()
        kept = {r: k for r, k in known.items() if _ceil_ms(k[0] + self.retention_us) > watermark}
        if not kept:
            self.known.clear()
            self.open.clear()
        else:
            if len(kept) < len(known):
                if not all(known[r][1] for r in known if r not in kept):
                    rest = [tuple(line) for line in self.open.get() if line[0] in kept]
                    self.open.put(rest) if rest else self.open.clear()
                self.known.put([(r, *k) for r, k in kept.items()])
            self.timer.move(min(_ceil_ms(us + self.retention_us) for us, _ in kept.values()))
        yield from ()

    @staticmethod
    def _replies(finished: list[tuple[str, list[tuple]]]) -> pd.DataFrame:
        replies = []
        for request, own in finished:
            own = sorted(own, key=lambda line: line[0])
            end = min((line[0] for line in own if line[4]), default=None)
            own = [line for line in own if end is None or line[0] < end]
            reasons = [line[2] for line in own if line[2]]
            replies.append((request, "".join(line[1] for line in own if line[1]), reasons[-1] if reasons else "stop", any(line[3] for line in own)))
        requests, contents, reasons, done = zip(*replies)
        return pd.DataFrame({"request_id": pd.Series([int(r) if r else None for r in requests], dtype="Int64"),
                             "content": contents, "finish_reason": reasons, "done": done})

    def close(self) -> None:
        pass


def stream_reassemble(chunks: DataFrame, delay: str = "1 hour", retention: dt.timedelta = dt.timedelta(hours=6), event_time: str = "ts",
                      buckets: int = 1024) -> DataFrame:
    """N7 incrementally; a reply is emitted when its done / finish line has arrived (an empty finish reason is none).

    A request without a line for ``retention`` of event time is forgotten: lines
    that never came to an end, and the mark that a reply was sent.  Lines more
    than ``delay`` late are dropped by the watermark.  Lines without a request
    are one request, as in the batch form.  State is kept by bucket of requests,
    so ``buckets`` bounds the calls of the state store in a micro-batch; it must not change
    between runs from the same checkpoint.
    """
    timed = chunks.withColumn("ts", F.col(event_time).cast("timestamp")).withWatermark("ts", delay)
    # lines without content are left out in the processor: a filter here would go below the watermark, which they move too
    lines = parsed_chunks(timed, "ts").withColumns({
        "request": _state_key("request_id"), "state_key": F.pmod(F.xxhash64("request_id"), F.lit(buckets)).cast("string")}).drop("request_id")
    return lines.groupBy("state_key").transformWithStateInPandas(
        ReassembleBucketProcessor(int(retention.total_seconds() * 1_000_000)), REPLY_SCHEMA, "Append", "EventTime")


# ----------------------------------------------------------------------------- T4

def window_stats(interactions: DataFrame, window: str = "1 day", cfg: Thresholds = DEFAULT) -> DataFrame:
    """T4 batch twin: per tumbling window, counts per sentiment class (A1's counters)."""
    return _window_counts(interactions.withColumn("_ts", F.col("timestamp").cast("timestamp")), window, cfg)


def _window_counts(df: DataFrame, window: str, cfg: Thresholds) -> DataFrame:
    s = F.col("sentiment")
    return (
        df.groupBy(F.window("_ts", window).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("interactions"),
            F.count_if(s > cfg.positive).alias("positive"),
            F.count_if(s < cfg.negative).alias("negative"),
            F.count_if(F.abs(s) <= cfg.neutral_band).alias("neutral"),
            F.count_if(F.coalesce(F.col("is_golden"), F.lit(False))).alias("golden"),
            F.count_if(F.coalesce(F.col("is_refusal"), F.lit(False))).alias("refusal"),
        )
        .select(
            F.col("w.start").cast("timestamp_ntz").alias("window_start"),
            F.col("w.end").cast("timestamp_ntz").alias("window_end"),
            "interactions", "positive", "negative", "neutral", "golden", "refusal",
        )
    )


def stream_stats(interactions: DataFrame, window: str = "1 day", watermark: str = "1 hour", cfg: Thresholds = DEFAULT) -> DataFrame:
    """T4: tumbling-window counters on a stream; rows later than the watermark are dropped."""
    ts = interactions.withColumn("_ts", F.col("timestamp").cast("timestamp")).withWatermark("_ts", watermark)
    return _window_counts(ts, window, cfg)


# ----------------------------------------------------------------------------- T5

def _counted(cfg: Thresholds) -> Column:
    """Rows that move a counter of the trigger machine; all others change no state and emit nothing."""
    s = F.col("sentiment")
    flags = (s < cfg.negative, s > cfg.positive, F.col("is_golden"), F.col("is_refusal"))
    return reduce(lambda a, b: a | b, [F.coalesce(f, F.lit(False)) for f in flags])


def trigger_points(interactions: DataFrame, cfg: Thresholds = DEFAULT, key: str = "model_line") -> DataFrame:
    """T5 batch twin: the ordered counter fold per model line (skew-safe FSM scan)."""
    from chatloom.plans.fsm import scan

    cols = [key, "timestamp", "id", "sentiment", "is_golden", "is_refusal"]
    return scan(interactions.where(_counted(cfg)).select(*cols), key, ["timestamp", "id"], TriggerMachine(cfg, key), TRIGGER_SCHEMA)


TRIGGER_STATE = "model_line bigint, state int"


def trigger_batch(cfg: Thresholds = DEFAULT) -> Callable[[DataFrame, int, str], DataFrame]:
    """T5 on a micro-batch: the ordered fold of the batch twin, entered with the counters that the previous batch left.

    A model line's rows are split over range partitions like any other rows; what
    goes from batch to batch is one row per line, written whole under the batch's
    id, so a replayed batch reads and writes the same.
    """
    from chatloom.plans.fsm import OrderedFold

    key, order = "model_line", ["timestamp", "id"]
    cols = [key, *order, "sentiment", "is_golden", "is_refusal"]

    def run(batch: DataFrame, batch_id: int, folder: str) -> DataFrame:
        spark = batch.sparkSession
        empty = spark.createDataFrame([], TRIGGER_STATE)
        before = spark.read.schema(TRIGGER_STATE).parquet(f"{folder}/_batch={batch_id - 1}") if batch_id else empty
        prior = before.select(F.col(key).alias("line"), "state")
        rows = batch.where(_counted(cfg)).select(*cols).join(prior, F.col(key).eqNullSafe(F.col("line")), "left")
        fold = OrderedFold(rows, key, order, TriggerMachine(cfg, key), cols, F.col("state"))
        ends = fold.exits()
        untouched = before.join(ends.select(F.col(key).alias("line")), F.col(key).eqNullSafe(F.col("line")), "left_anti")
        ends.unionByName(untouched).write.mode("overwrite").parquet(f"{folder}/_batch={batch_id}")
        return fold.emitted(TRIGGER_SCHEMA)

    return run


def stream_triggers(interactions: DataFrame, path: str, checkpoint: str, cfg: Thresholds = DEFAULT):
    """T5: a training decision each time a model line's counters cross a trigger, appended to ``path``.

    Returns the writer; rows of a micro-batch follow those of earlier ones.  The
    table is partitioned by ``batch``; the counters are kept beside the checkpoint.
    """
    job = trigger_batch(cfg)

    def sink(batch: DataFrame, batch_id: int) -> None:
        job(batch, batch_id, f"{checkpoint.rstrip('/')}-counters").write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    return interactions.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)


# ----------------------------------------------------------------------------- T6

def idle_points(events: DataFrame, gap_hours: float = 8.0, min_events: int = 10, key: str = "user_id",
                ts: str = "ts", now=None) -> DataFrame:
    """T6 batch twin: sessions with an idle gap (``session_window``; an event exactly one
    gap later opens a new session), then the carry-over fold per key over completed
    sessions (session end + gap <= now)."""
    from chatloom.plans.fsm import scan

    gap = f"{int(gap_hours * 3600)} seconds"
    sessions = (
        events.withColumn("_ts", F.col(ts).cast("timestamp"))
        .groupBy(F.col(key), F.session_window("_ts", gap).alias("s"))
        .agg(F.count(F.lit(1)).alias("events"), F.max(F.col(ts)).alias("session_end"))
        .select(key, "session_end", "events")
    )
    if now is not None:
        if isinstance(now, str):
            now = dt.datetime.fromisoformat(now)
        limit = F.lit(now - dt.timedelta(hours=gap_hours)).cast("timestamp_ntz")
        sessions = sessions.where(F.col("session_end") <= limit)
    return scan(sessions, key, ["session_end"], IdleMachine(min_events, key), IDLE_SCHEMA)


class IdleProcessor(StatefulProcessor):
    """Event-time timer at last event + gap; count carried until it reaches the minimum."""

    def __init__(self, gap_us: int, min_events: int = 10):
        self.gap_us = gap_us
        self.min_events = min_events

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("idle", "events bigint, last_us bigint")

    @staticmethod
    def _timer_ms(last_us: int, gap_us: int) -> int:
        return -((-(last_us + gap_us)) // 1000)  # ceil to the timer's millisecond grid

    def _emit(self, key, counts, last_us):
        return pd.DataFrame({"user_id": _key_column(key[0], len(counts)), "idle_from": pd.to_datetime(last_us, unit="us"), "events": counts})

    def handleInputRows(self, key, rows, timerValues):
        count, last_us = (self.state.get() if self.state.exists() else (0, None))
        if last_us is not None:
            self.handle.deleteTimer(self._timer_ms(int(last_us), self.gap_us))
        times = np.sort(np.concatenate([pdf["ts"].to_numpy().astype("datetime64[us]").astype("int64") for pdf in rows]))
        before = np.concatenate([times[:1] if last_us is None else [last_us], times[:-1]])
        counts, ends, since = [], [], 0
        for at in np.flatnonzero(times - before >= self.gap_us).tolist():  # idle gaps only
            if count + at - since >= self.min_events:
                counts.append(int(count + at - since))
                ends.append(int(before[at]))
                count, since = 0, at
        count, last_us = int(count + len(times) - since), int(times[-1])
        self.state.update((count, last_us))
        self.handle.registerTimer(self._timer_ms(last_us, self.gap_us))
        if counts:
            yield self._emit(key, counts, ends)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.state.exists():
            count, last_us = self.state.get()
            if count >= self.min_events:  # nothing is carried over
                self.state.clear()
                yield self._emit(key, [int(count)], [int(last_us)])

    def close(self) -> None:
        pass


def stream_inactivity(events: DataFrame, gap_hours: float = 8.0, min_events: int = 10, watermark: str = "0 seconds") -> DataFrame:
    """Per user, emit when no event came for ``gap`` and enough events accumulated."""
    src = events.select(_state_key("user_id"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", watermark)
    return src.groupBy("state_key").transformWithStateInPandas(
        IdleProcessor(int(gap_hours * 3600 * 1_000_000), min_events), IDLE_SCHEMA, "Append", "EventTime"
    )

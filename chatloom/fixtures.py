"""Stand-in inputs derived from the driver tables (FIXTURES.md).

Each builder only reshapes a driver table into the schema an operator expects;
none of them does an operator's work.  Every builder is a pure projection or
filter of its source table, so it scales with that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.session import read_table

# The injected feedback texts of the turn fixture, by k.
FEEDBACK_APPEND = {
    0: " Thanks, that is perfect!",
    1: " Exactly what I needed, thank you. Love it!",
    2: " No, that is wrong. Try again.",
    3: " good and helpful, ok",
    4: " there is a mistake, please change it",
    5: " From now on always answer in short form, it is important",
    6: " why? how? when? where?",
    7: " wow!!!",
}
SHORT_REPLACEMENT = {8: "ok"}
PROMPT_PREFIX = {9: "### "}
REFUSAL_K = 10

# Sentiment per event type for the interaction fixture.
EVENT_SENTIMENT = {"purchase": 0.8, "signup": 0.4, "view": 0.1, "click": -0.2, "error": -0.8}


def fx_turns(spark: SparkSession, sf_dir: str, conv: DataFrame | None = None) -> DataFrame:
    """conversations + injected feedback: (conv_id, turn, role, text, ts, is_refusal).

    ``conv`` may be a streaming read of the same table (the builder is a projection)."""
    conv = read_table(spark, sf_dir, "conversations") if conv is None else conv
    k = F.when((F.col("role") == "user") & (F.col("turn") >= 1), (F.col("conv_id") * 7 + F.col("turn") * 3) % 16)
    text = F.col("text")
    new_text: Column = text
    expr = None
    for key, suffix in FEEDBACK_APPEND.items():
        expr = (F.when(k == key, F.concat(text, F.lit(suffix))) if expr is None
                else expr.when(k == key, F.concat(text, F.lit(suffix))))
    for key, rep in SHORT_REPLACEMENT.items():
        expr = expr.when(k == key, F.lit(rep))
    for key, pre in PROMPT_PREFIX.items():
        expr = expr.when(k == key, F.concat(F.lit(pre), text))
    new_text = expr.otherwise(text)
    return conv.select(
        "conv_id",
        "turn",
        "role",
        new_text.alias("text"),
        F.timestamp_add("MINUTE", F.col("conv_id") * 37 + F.col("turn"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("ts"),
        F.coalesce(k == REFUSAL_K, F.lit(False)).alias("is_refusal"),
    )


def fx_interactions(spark: SparkSession, sf_dir: str, ev: DataFrame | None = None) -> DataFrame:
    """events reshaped into the interaction fact table (``ev`` may be a stream of events)."""
    ev = read_table(spark, sf_dir, "events") if ev is None else ev
    sent = None
    for et, v in EVENT_SENTIMENT.items():
        sent = F.when(F.col("event_type") == et, F.lit(v)) if sent is None else sent.when(F.col("event_type") == et, F.lit(v))
    user_message = F.concat(F.col("event_type"), F.lit(" "), F.col("props"))
    assistant = F.concat(F.lit("reply "), F.col("event_id").cast("string"))
    return ev.select(
        F.col("event_id").cast("string").alias("id"),
        F.col("user_id").cast("string").alias("conversation_id"),
        F.col("ts").alias("timestamp"),
        (F.col("user_id") % 4).alias("model_line"),
        user_message.alias("user_message"),
        assistant.alias("assistant_response"),
        F.length(user_message).alias("user_message_length"),
        F.length(assistant).alias("assistant_response_length"),
        sent.otherwise(F.lit(0.0)).alias("sentiment"),
        F.least(F.lit(5.0), F.lit(0.25) + F.col("value") / F.lit(20.0)).alias("weight"),
        ((F.col("event_id") % 37) == 0).alias("is_golden"),
        ((F.col("event_type") == "error") & ((F.col("event_id") % 5) == 0)).alias("is_refusal"),
        F.lit(False).alias("truncated"),
    )


def fx_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders reshaped into a training-run log (run_id, model_line, ts, mode, losses, has_adapter)."""
    o = read_table(spark, sf_dir, "orders")
    # ln() differs in the last bit between math libraries; the stand-in loss is quantised
    # to 1e-9 so every engine starts from the same value.
    raw = F.log(F.lit(1.5) + (F.floor(F.col("o_totalprice")) % 300) / F.lit(100.0))
    measured = F.floor(raw * F.lit(1e9) + F.lit(0.5)) / F.lit(1e9)
    k = F.col("o_orderkey")
    eval_loss = F.when(k % 97 == 0, F.lit(None)).when(k % 89 == 0, F.lit(120.0)).otherwise(measured)  # not evaluated; diverged
    return o.select(
        F.col("o_orderkey").alias("run_id"),
        (F.col("o_custkey") % 5).alias("model_line"),
        F.col("o_orderdate").alias("ts"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("dpo")).otherwise(F.lit("sft")).alias("mode"),
        F.when(k % 83 != 0, measured * F.lit(0.9)).alias("train_loss"),
        eval_loss.alias("eval_loss"),
        ((F.col("o_orderkey") % 7) != 0).alias("has_adapter"),
    )


def fx_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate rejection replies keyed by the interaction prompt text, from events.

    Variant by event_id % 8: a valid string, 10 characters, 11 characters, empty with
    thinking, a block list, whitespace only; 6 failed (status 500) and 7 came back without content.  Many events share a
    prompt, so repeated prompts (last reply by seq wins) occur throughout.
    """
    ev = read_table(spark, sf_dir, "events")
    v = F.col("event_id") % 8
    prompt = F.concat(F.col("event_type"), F.lit(" "), F.col("props"))
    content = (
        F.when(v == 0, F.concat(F.lit('"Rejected answer for '), F.replace(F.col("props"), F.lit('"'), F.lit('\\"')), F.lit('"')))
        .when(v == 1, F.lit('"0123456789"'))
        .when(v == 2, F.lit('"0123456789A"'))
        .when(v == 3, F.lit('""'))
        .when(v == 4, F.lit('[{"type":"text","text":"block one"},{"type":"image_url"},{"type":"text","text":"block two"}]'))
        .when(v == 5, F.lit('"   "'))
    )
    thinking = F.when(v == 3, F.concat(F.lit("thinking about "), F.col("event_type")))
    return ev.select(
        prompt.alias("prompt"), F.col("event_id").alias("seq"), F.when(v == 6, F.lit(500)).otherwise(F.lit(200)).alias("status"),
        content.alias("content"), thinking.alias("thinking"),
        F.timestamp_add("MINUTE", -(F.col("event_id") % 720), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")).alias("cached_at"),
    )


def _json_str(c: Column) -> Column:
    """JSON text of a string value (quoted and escaped)."""
    j = F.to_json(F.array(c))
    return F.substring(j, F.lit(2), F.length(j) - 2)


MSG_TYPE = "array<struct<role:string,content:string,name:string,tool_calls:string,tool_call_id:string>>"


def fx_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chat request per user turn, holding the whole conversation up to that turn.

    Content is carried as JSON text.  The newest message's form varies by ``h`` =
    (5 conv_id + turn) mod 16, ``h`` mod 8 being 1 text blocks, 2 image + text blocks, 3 a bare
    string, true and null in a list, 4 an object with only ``content``, 5 a tool exchange after it, 6 invalid
    sampling values, 7 a ``:tag`` on the model, else a string.  Also: 9 no model given, 11 no user
    message at all, 12 another model, 14 penalties and top_logprobs out of range.
    """
    t = fx_turns(spark, sf_dir).select("conv_id", "turn", "role", "text", "ts")
    asked = t.where(F.col("role") == "user").select("conv_id", F.col("turn").alias("upto"), F.col("ts").alias("asked_at"))
    h = (F.col("conv_id") * 5 + F.col("upto")) % 16
    v = h % 8
    u = _json_str(F.col("text"))
    shaped = (
        F.when(v == 1, F.concat(F.lit('[{"type":"text","text":'), u, F.lit("}]")))
        .when(v == 2, F.concat(F.lit('[{"type":"image_url","image_url":{"url":"data:image/png;base64,QUJD"}},{"type":"text","text":'), u, F.lit("}]")))
        .when(v == 3, F.concat(F.lit("["), u, F.lit(',true,null,{"type":"text","text":"extra"}]')))
        .when(v == 4, F.concat(F.lit('{"content":'), u, F.lit("}")))
        .otherwise(u)
    )
    content = F.when(F.col("turn") == F.col("upto"), shaped).otherwise(u)
    # One group per request: a long conversation's requests are spread over tasks by request.
    hist = asked.join(t, "conv_id").where(F.col("turn") <= F.col("upto")).groupBy("conv_id", "upto", "asked_at").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", content.alias("content")))).alias("_hist"))

    def msg(role, content, tool_calls=None, tool_call_id=None):
        return F.struct(
            role.alias("role"), content.alias("content"), F.lit(None).cast("string").alias("name"),
            F.lit(tool_calls).cast("string").alias("tool_calls"), F.lit(tool_call_id).cast("string").alias("tool_call_id"),
        )

    base = F.transform("_hist", lambda m: msg(m["role"], m["content"]))
    tool = F.array(
        msg(F.lit("assistant"), F.lit("null"), '[{"id":"call_1","type":"function","function":{"name":"lookup","arguments":"{}"}}]'),
        msg(F.lit("tool"), F.lit('"42"'), None, "call_1"),
    )
    messages = F.when(v == 5, F.concat(base, tool)).when(h == 11, F.filter(base, lambda m: m["role"] != "user")).otherwise(base)
    odd = h == 14
    return hist.select(
        (F.col("conv_id") * 1000 + F.col("upto")).alias("request_id"),
        F.col("conv_id").cast("string").alias("conversation_id"),
        F.col("asked_at").alias("timestamp"),
        F.when(h == 9, F.lit(None)).when(h == 12, F.lit("other-model")).when(v == 7, F.lit("chatloom-model:latest"))
        .otherwise(F.lit("chatloom-model")).alias("model"),
        F.when(v == 6, F.lit(2)).otherwise(F.lit(1)).alias("n"),
        F.when(v == 6, F.lit(3.0)).otherwise(F.lit(0.7)).alias("temperature"),
        F.when(v == 6, F.lit(1.5)).otherwise(F.lit(0.9)).alias("top_p"),
        F.when(v == 6, F.lit(0)).otherwise(F.lit(256)).alias("max_tokens"),
        F.when(odd, F.lit(3.0)).alias("presence_penalty"),
        F.when(odd, F.lit(-2.5)).alias("frequency_penalty"),
        F.when(odd, F.lit(21)).alias("top_logprobs"),
        messages.cast(MSG_TYPE).alias("messages"),
    )


def fx_request_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The provider's reply body to every request of ``fx_requests``: (request_id, provider, body).

    The text is the conversation's next turn where that is an assistant turn, else empty.  By
    (3 conv_id + turn) mod 8: 0 a finished ollama reply, 1 finished openai, 2 a tool call, 3 cut
    at the length limit, 4 ollama without an end mark, 5 an error body, 6 openai with a null finish
    reason, 7 ollama done with a null reason.
    """
    t = fx_turns(spark, sf_dir).select("conv_id", "turn", "role", "text")
    nxt = t.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    r = t.where(F.col("role") == "user").select("conv_id", "turn").join(nxt, ["conv_id", "turn"], "left")
    g = (F.col("conv_id") * 3 + F.col("turn")) % 8
    j = _json_str(F.coalesce("reply", F.lit("")))
    body = (
        F.when(g == 0, F.concat(F.lit('{"message":{"content":'), j, F.lit('},"done":true,"done_reason":"stop"}')))
        .when(g == 1, F.concat(F.lit('{"choices":[{"message":{"content":'), j, F.lit('},"finish_reason":"stop"}]}')))
        .when(g == 2, F.lit('{"choices":[{"message":{"content":null,"tool_calls":[{"function":{"arguments":"{}","name":"lookup"},"id":"c1","type":"function"}]},"finish_reason":"tool_calls"}]}'))
        .when(g == 3, F.concat(F.lit('{"choices":[{"message":{"content":'), j, F.lit('},"finish_reason":"length"}]}')))
        .when(g == 4, F.concat(F.lit('{"message":{"content":'), j, F.lit('},"done":false}')))
        .when(g == 6, F.concat(F.lit('{"choices":[{"message":{"content":'), j, F.lit('},"finish_reason":null}]}')))
        .when(g == 7, F.concat(F.lit('{"message":{"content":'), j, F.lit('},"done":true,"done_reason":null}')))
        .otherwise(F.lit('{"error":"overloaded"}'))
    )
    return r.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"),
        F.when(g.isin(1, 2, 3, 6), F.lit("openai")).otherwise(F.lit("ollama")).alias("provider"), body.alias("body"),
    )


CHUNK = 16


def fx_chunks(spark: SparkSession, sf_dir: str, turns: DataFrame | None = None) -> DataFrame:
    """Streamed provider lines for every assistant turn of fx_turns (request_id = conv_id*1000+turn).

    The text is cut into 16-character pieces, one line each; even conversations use
    NDJSON (``message.content``, then a ``done`` line with ``done_reason``), odd ones SSE
    (``data: `` + ``choices[0].delta.content``, a finish line, then ``[DONE]``), with an
    empty instead of a null finish reason in every second of them.  Each request also gets
    one blank and one malformed line.  A line's time is its turn's, a second later per piece.
    """
    t = (fx_turns(spark, sf_dir) if turns is None else turns).where(F.col("role") == "assistant")
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / F.lit(CHUNK)).cast("int"))
    pieces = t.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"),
        F.when(F.col("conv_id") % 2 == 0, F.lit("ollama")).otherwise(F.lit("openai")).alias("provider"),
        "text", "ts", F.when(F.col("conv_id") % 4 == 1, F.lit("")).alias("open"),
        F.explode(F.sequence(F.lit(0), n - 1)).alias("i"),
    )

    def later(seconds: Column) -> Column:
        return F.timestamp_add("SECOND", seconds, F.col("ts")).alias("ts")

    piece = F.substring("text", F.col("i") * CHUNK + 1, CHUNK)
    ollama = F.to_json(F.struct(F.struct(piece.alias("content")).alias("message"), F.lit(False).alias("done")))
    sse = F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(
        F.struct(piece.alias("content")).alias("delta"), F.col("open").alias("finish_reason"))).alias("choices"))))
    body = pieces.select(
        "request_id", "provider", (F.col("i") * 10 + 10).alias("seq"),
        F.when(F.col("provider") == "ollama", ollama).otherwise(sse).alias("line"), later(F.col("i")),
    )
    reqs = pieces.where(F.col("i") == 0).select("request_id", "provider", "text", "ts")
    n_end = (F.greatest(F.lit(1), F.ceil(F.length("text") / F.lit(CHUNK)).cast("int")) * 10 + 10)
    tail = reqs.select(
        "request_id", "provider",
        F.explode(F.array(
            F.struct(F.lit(5).alias("o"), F.lit("").alias("l")),
            F.struct(F.lit(7).alias("o"), F.lit("{not json").alias("l")),
            F.struct(F.lit(-1).alias("o"), F.when(F.col("provider") == "ollama",
                     F.lit('{"message":{"content":""},"done":true,"done_reason":"stop"}'))
                     .otherwise(F.lit('data: {"choices":[{"delta":{},"finish_reason":"stop"}]}')).alias("l")),
            F.struct(F.lit(-2).alias("o"), F.when(F.col("provider") == "openai", F.lit("data: [DONE]")).alias("l")),
        )).alias("x"),
        n_end.alias("_end"), "ts",
    ).select(
        "request_id", "provider",
        F.when(F.col("x.o") == -1, F.col("_end")).when(F.col("x.o") == -2, F.col("_end") + 1).otherwise(F.col("x.o")).alias("seq"),
        F.col("x.l").alias("line"), later(F.when(F.col("x.o") < 0, F.col("_end") / 10).otherwise(F.lit(0)).cast("int")),
    ).where(F.col("line").isNotNull())
    return body.unionByName(tail)


def fx_score_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a scoring model, one per event (event_id, status, reply): numbers in and out of range,
    numbers inside text, bare and missing ones; every 16th request failed."""
    ev = read_table(spark, sf_dir, "events")
    e = F.col("event_id")
    num = F.concat((e % 3).cast("string"), F.lit("."), F.lpad((e % 100).cast("string"), 2, "0"))
    v = e % 8
    reply = (
        F.when(v == 0, num).when(v == 1, F.concat(F.lit("  -"), num, F.lit(" \n")))
        .when(v == 2, F.concat(F.lit("Score: "), num, F.lit(" of 1"))).when(v == 3, F.lit("no number"))
        .when(v == 4, F.lit("")).when(v == 5, F.concat((e % 2).cast("string"), F.lit(".")))
        .when(v == 6, F.lit("- .5")).otherwise(F.lit("between -0.25 and 0.75"))
    )
    return ev.select("event_id", F.when(e % 16 == 0, F.lit(500)).otherwise(F.lit(200)).alias("status"), reply.alias("reply"))


LOG_LINES = 60


def fx_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trainer logs of 60 lines from events (log_id, line_no, line): mode lines, passes, epochs,
    timestamps and keyword lines between the event texts."""
    ev = read_table(spark, sf_dir, "events")
    e = F.col("event_id")
    log, no = F.floor(e / LOG_LINES), e % LOG_LINES
    k = log % 4
    line = (
        F.when((no == 0) & (k == 0), F.lit("CPU TRAINING MODE ENABLED"))
        .when((no == 0) & (k < 3), F.lit("Loading base model"))
        .when((no == 1) & (k == 1), F.lit("Using 8-bit quantization"))
        .when((no == 5) & (k < 3), F.concat(F.lit("  PASS "), k + 1, F.lit("/4: Training layers "), k * 5, F.lit("-"), k * 5 + 4))
        .when(no == 7, F.concat(F.lit("Epoch "), k + 1, F.lit("/5")))
        .when(no == 9, F.lit("2024-01-05 10:00:09 started"))
        .when(no == 20, F.lit("PASS 4/4: Training layers 15-19, 2024-01-05 11:00:00"))
        .when(no % 7 == 0, F.concat(F.lit("  loss after step "), e, F.lit("  ")))
        .when(no % 11 == 3, F.lit("Merging adapter"))
        .otherwise(F.concat(F.col("event_type"), F.lit(" "), F.col("props")))
    )
    return ev.select(log.alias("log_id"), no.alias("line_no"), line.alias("line"))


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def fx_checkpoint_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One checkpoint metadata file per supplier (path, content); every fifth is not JSON."""
    k = F.col("s_suppkey")
    body = F.to_json(F.struct(
        F.concat(F.lit("ck_"), k).alias("checkpoint_id"), F.concat(F.lit("/adapters/"), k).alias("adapter_path"),
        F.concat(F.lit("2024-01-"), _two(k % 28 + 1), F.lit("T00:00:00")).alias("timestamp"),
        F.struct((k / 4).alias("perplexity")).alias("metrics"), k.alias("training_samples"),
        (k % 2 == 0).alias("can_rollback"), (k % 7 == 0).alias("deployed")))
    return read_table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("ck_"), k, F.lit("_metadata.json")).alias("path"),
        F.when(k % 5 == 4, F.lit("{broken")).otherwise(body).alias("content"))


def fx_run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of one training run per supplier (path, content).

    Run k with k mod 3 = 0 is sequential: two reported passes (the second with trainer states of
    checkpoints 3 and 12), and for even k a third pass with only a log; the others have one
    metadata file and, for even k, one trainer state whose last entry has no evaluation loss.
    With k mod 5 = 0 a later checkpoint folder holds weights but no state, with k mod 7 = 0 a
    broken one.
    """
    k = F.col("s_suppkey")
    run = F.concat(F.lit("run_"), k)
    day = F.concat(F.lit("2024-01-"), _two(k % 28 + 1), F.lit("T"), _two(k % 24))

    def meta(minute: str, extra: int) -> Column:
        return F.to_json(F.struct(
            F.concat(day, F.lit(f":{minute}:00")).alias("timestamp"), ((k + extra) / 4).alias("train_loss"),
            ((k + extra) / 8).alias("eval_loss"), (k + 100).alias("train_samples"), (k % 10).alias("val_samples"), F.lit(3.0).alias("epochs")))

    def state(step: int, last: str) -> str:
        return f'{{"epoch": {step / 4}, "global_step": {step}, "max_steps": 40, "log_history": [{{"loss": 0.5, "step": 1}}, {last}]}}'

    evaluated = '{"eval_loss": 0.25, "eval_runtime": 2.5, "step": 12}'

    def file(path: str, content: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.concat(run, F.lit("/" + path)).alias("path"), content.alias("content")))

    seq, even = k % 3 == 0, k % 2 == 0
    files = [
        file("training_metadata.json", meta("00", 0), F.lit(True)),
        file("checkpoint-5/trainer_state.json", F.lit(state(5, '{"loss": 0.4, "step": 5}')), ~seq & even),
        file("pass_1_layers_0_4/training_metadata.json", meta("10", 1), seq),
        file("pass_2_layers_5_9/training_metadata.json", meta("30", 2), seq),
        file("pass_2_layers_5_9/checkpoint-3/trainer_state.json", F.lit(state(3, '{"eval_loss": 0.75, "eval_runtime": 1.5, "step": 3}')), seq),
        file("pass_2_layers_5_9/checkpoint-12/trainer_state.json", F.lit(state(12, evaluated)), seq),
        file("pass_3_layers_10_14/train.log", F.lit("started"), seq & even),
        file("checkpoint-20/weights.txt", F.lit("w"), ~seq & (k % 5 == 0)),
        file("pass_2_layers_5_9/checkpoint-100/weights.txt", F.lit("w"), seq & (k % 5 == 0)),
        file("pass_2_layers_5_9/checkpoint-30/trainer_state.json", F.lit('{"global_step": 30, "log_history": [{"eval_loss"'), seq & (k % 7 == 0)),
    ]
    return read_table(spark, sf_dir, "supplier").select(F.inline(F.array_compact(F.array(*files))))

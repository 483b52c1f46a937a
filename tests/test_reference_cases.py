"""Cases in which the reference's rules are easily missed."""

import datetime as dt
import re

import pytest

from chatloom.operators.interactions import prune_by_age
from chatloom.operators.requests import flag_invalid_requests
from chatloom.operators.rewrite import apply_rules, compile_rules
from chatloom.operators.similarity import similar_topk
from chatloom.streaming.jobs import ReassembleProcessor, reassemble_reply


def test_reply_without_a_finish_line_stops(spark):
    rows = [(1, 1, 'data: {"choices":[{"delta":{"content":"hi"},"finish_reason":null}]}', "openai"),
            (2, 1, 'data: {"choices":[{"delta":{"content":"yo"},"finish_reason":""}]}', "openai"),
            (3, 1, 'data: {"choices":[{"delta":{"content":"a"},"finish_reason":"length"}]}', "openai"),
            (3, 2, "data: [DONE]", "openai")]
    out = reassemble_reply(spark.createDataFrame(rows, "request_id long, seq long, line string, provider string"))
    assert {r.request_id: (r.content, r.finish_reason) for r in out.collect()} == {1: ("hi", "stop"), 2: ("yo", "stop"), 3: ("a", "length")}


class _State:
    def __init__(self):
        self.rows, self.value = [], None

    def appendValue(self, row):
        self.rows.append(row)

    def appendList(self, values):
        self.rows += values

    def get(self):
        return iter(self.rows)

    def clear(self):
        self.rows = []

    def exists(self):
        return self.value is not None

    def update(self, value):
        self.value = value


def test_late_end_line_gives_no_second_reply():
    import pandas as pd

    p = ReassembleProcessor()
    p.buf, p.sent, p.timer = _State(), _State(), None
    columns = ["seq", "delta", "finish_reason", "done", "end"]
    first = pd.DataFrame([(1, "hi", None, False, False), (2, None, "stop", False, False)], columns=columns)
    late = pd.DataFrame([(3, None, None, False, True)], columns=columns)
    assert [d.content[0] for d in p.handleInputRows(("1",), iter([first]), None)] == ["hi"]
    assert list(p.handleInputRows(("1",), iter([late]), None)) == []


def test_no_model_is_the_configured_one(spark):
    df = spark.createDataFrame([(1, None, [("user",)]), (2, "other", [("user",)])], "request_id long, model string, messages array<struct<role:string>>")
    assert {r.request_id: r.unknown_model for r in flag_invalid_requests(df, "m").collect()} == {1: False, 2: True}


def test_a_null_timestamp_is_kept(spark):
    now = dt.datetime(2024, 2, 1)
    rows = [("a", None, False), ("b", dt.datetime(2020, 1, 1), False), ("c", dt.datetime(2024, 1, 31), False)]
    kept, deleted = prune_by_age(spark.createDataFrame(rows, "id string, timestamp timestamp_ntz, is_golden boolean"), now, 20)
    assert sorted(r.id for r in kept.collect()) == ["a", "c"] and [r.id for r in deleted.collect()] == ["b"]


def test_equal_vectors_rank_by_id(spark):
    corpus = spark.createDataFrame([(f"{i:05d}", [1.0, 0.0]) for i in range(3000)], "id string, embedding array<double>")
    out = similar_topk(spark.createDataFrame([("q", [1.0, 0.0])], "id string, embedding array<double>"), corpus, k=3)
    assert [r.cid for r in out.orderBy("rank").collect()] == ["00000", "00001", "00002"]


def test_blocks_without_a_neighbour(spark):
    vectors = spark.createDataFrame([(f"v{i}", [1.0, float(i)]) for i in range(3)], "id string, embedding array<double>")
    out = similar_topk(vectors, vectors, k=5, query_blocks=2, corpus_blocks=7)  # most corpus blocks hold one vector or none
    assert sorted((r.qid, r["rank"], r.cid) for r in out.collect()) == [("v0", 1, "v1"), ("v0", 2, "v2"), ("v1", 1, "v2"), ("v1", 2, "v0"), ("v2", 1, "v1"), ("v2", 2, "v0")]


def test_rules_read_as_python_patterns(spark):
    rules = [
        {"id": "names", "pattern": r"(?P<first_word>\w+) café", "replacement": r"<\g<first_word>> X", "target_roles": ["all"]},
        {"id": "back", "pattern": r"\b(?P<a_b>\w)(?P=a_b)\b", "replacement": r"\g<a_b>0", "target_roles": ["all"]},
        {"id": "class", "pattern": r"[[&&]+\Z", "replacement": "!", "target_roles": ["all"]},
        {"id": "space", "pattern": r"\d\s\d", "replacement": "D", "target_roles": ["all"]},
    ]
    texts = ["Bob café zz", "éé Élan café", "a [&", "٣\u00a0٤ 12", "tail[&\n"]
    want = []
    for t in texts:
        for r in rules:
            t = re.sub(r["pattern"], r["replacement"], t)
        want.append(t)
    df = spark.createDataFrame([("user", t) for t in texts], "role string, text string")
    assert [r.text for r in apply_rules(df, rules).collect()] == want
    with pytest.raises(ValueError):
        compile_rules([{"id": "x", "pattern": r"(a)?(?(1)b|c)", "replacement": ""}], spark)


def test_one_failing_prompt_costs_only_itself(spark):
    from chatloom.operators.batchfn import generate_rejections, model_sentiment

    def factory():
        def gen(prompts):
            if "bad" in prompts:
                raise ValueError("refused")
            return [(200, f'"a long enough reply to {p}"', None) for p in prompts]

        return gen

    out, report = generate_rejections(spark.createDataFrame([("good",), ("bad",), ("fine",)], "prompt string").coalesce(1), factory)
    assert {r.prompt for r in out.collect()} == {"good", "fine"} and report.first().succeeded == 2

    def scorer_factory():
        def score(texts):
            if any("x" in t for t in texts):
                raise ValueError
            return [(200, "0.5")] * len(texts)

        return score

    scored = model_sentiment(spark.createDataFrame([("ok",), ("x",)], "user_message string").coalesce(1), scorer_factory)
    assert {r.user_message: r.model_sentiment for r in scored.collect()} == {"ok": 0.5, "x": 0.0}


def test_a_replayed_stream_batch_is_written_once(spark, tmp_path):
    from chatloom.sources.io import batch_sink

    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1)), ("b", dt.datetime(2024, 1, 2))], "id string, timestamp timestamp_ntz")
    sink = batch_sink(str(tmp_path / "t"))
    for batch_id in (0, 1, 1):
        sink(df, batch_id)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4


def test_rules_mean_on_the_jvm_what_they_mean_in_python(spark):
    import random
    import re

    from pyspark.sql import functions as F

    from chatloom.operators import rewrite as R

    patterns = [r"\.$", r"\s+", r"[^\w\s]", r"a.b", r"^x", r"(?m)^x$", r"(?m)e$", r"\bcaf\w", r"\d+", r"[\S]+$", r"[^\S]x", r"[\W_]", r"(?i)é",
                r"(?is)A.*B", r"[\s,]+", r"\w+\Z", r"(?P<q_1>\w)(?P=q_1)", r"x\$", r"[$.]", r"[^\W\d]+", r"(?x) a \s b # c", r"\S\s\S", r"$", r"(a|$)",
                r"[]\w]", r"\\s", r"\Bx", r"(?<=\s)b", r"e(?=$)", r"[\b]", r"\b", r"\B"]
    texts = ["end.\r\n", "end.\n", "end.\r", "a\x1cb", "²³ x", "a\u2028b", "a\rb", "x\r\nx\n", "naïve café", "٣٤", "a\u00a0b", "a\u180eb", "a\x85b", "é É",
             "A\n\u2029B", "x$ $.", "aa bb", "_9z", ". \x1f.", "a\u200bb", "Ⅷ x", "½", "e\u0301x", "a b # c", "", "\n", "\n\n", "x]w", "\\s", "\x08"]
    rnd = random.Random(1)
    texts += ["".join(rnd.choice("ab x.\n\r\u2028\x1c\x85²é_9,$\u00a0") for _ in range(rnd.randint(0, 12))) for _ in range(300)]
    rules = R.compile_rules([{"id": str(i), "pattern": p, "replacement": "<>"} for i, p in enumerate(patterns)], spark)
    assert len(rules) == len(patterns)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", *[F.regexp_replace("t", c.pattern, c.replacement).alias(f"c{c.id}") for c in rules]).collect():
        for i, p in enumerate(patterns):
            assert r[f"c{i}"] == re.sub(p, "<>", r.t), (p, r.t)


def test_null_and_missing_reply_fields(spark):
    from pyspark.sql import functions as F

    from chatloom.functions.content import parse_reply, text_content

    bodies = [("openai", '{"choices":[{"message":{"content":"x"},"finish_reason":null}]}'), ("openai", '{"choices":[{"message":{"content":null}}]}'),
              ("ollama", '{"message":{"content":"x"},"done_reason":null}'), ("ollama", '{"message":{}}'), ("openai", '{"choices":[]}')]
    df = spark.createDataFrame(bodies, "p string, b string").coalesce(1)
    got = [(r.r.content, r.r.finish_reason) for r in df.select(parse_reply(F.col("b"), F.col("p")).alias("r")).collect()]
    assert got == [("x", None), (None, "stop"), ("x", None), ("", "stop"), ("", "error")]
    contents = ['[true,false,null,7,"s",{"text":null},{"content":true}]', '{"text":null}', '{"content":false}', "null", '"x"']
    df = spark.createDataFrame([(c,) for c in contents], "c string").coalesce(1)
    assert [r.t for r in df.select(text_content(F.col("c")).alias("t")).collect()] == ["True False None 7 s None True", "None", "False", "", "x"]


def test_history_follows_the_highest_checkpoint_folder(spark, tmp_path):
    import json

    from chatloom.sources import io as IO

    def put(path, content):
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content if isinstance(content, str) else json.dumps(content))

    meta = lambda minute: {"timestamp": f"2024-01-01T00:0{minute}:00", "eval_loss": 2.0}
    state = {"global_step": 10, "log_history": [{"eval_loss": 0.5, "eval_runtime": 1.0}]}
    put(tmp_path / "a/training_metadata.json", meta(1))
    put(tmp_path / "a/checkpoint-10/trainer_state.json", state)
    put(tmp_path / "a/checkpoint-20/weights.bin", "w")  # the highest folder has no state
    put(tmp_path / "b/training_metadata.json", meta(2))
    put(tmp_path / "b/checkpoint-9/trainer_state.json", state)
    put(tmp_path / "b/checkpoint-last/trainer_state.json", "{broken")  # no number counts as 0
    put(tmp_path / "c/training_metadata.json", meta(3))
    put(tmp_path / "c/checkpoint-5/trainer_state.json", "{broken")
    put(tmp_path / "d/training_metadata.json", meta(4))
    put(tmp_path / "d/pass_1_layers_0_4/train.log", "a pass folder without a report")
    put(tmp_path / "e/training_metadata.json", meta(5))
    put(tmp_path / "e/checkpoint-1/trainer_state.json", {"global_step": 3, "log_history": []})
    got = [(r.checkpoint_name, r.eval_loss, r.global_step) for r in IO.read_training_history(spark, str(tmp_path)).collect()]
    assert got == [("a", 2.0, None), ("b", 0.5, 10), ("c", 2.0, None), ("e", 2.0, None)]


def test_two_hundred_rules_as_one_expression(spark):
    import random
    import re

    from pyspark.sql import functions as F

    from chatloom.operators import rewrite as R

    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randint(2, 4)))
    shapes = [lambda: word(), lambda: rf"\b{word()}\b", lambda: rf"({word()})\s+({word()})", lambda: rf"(?i){word()}", lambda: rf"[{word()}]{{3}}", lambda: rf"(?:{word()})+", lambda: rf"x?{word()}|{word()}", lambda: "^" + word()]
    rules = [{"id": f"r{i}", "pattern": rnd.choice(shapes)(), "replacement": rnd.choice(["", word(), "$" + word(), r"[\g<0>]"]), "priority": rnd.randint(0, 5),
              "target_roles": rnd.choice([["user"], ["assistant", "user"], ["all"], ["system"]])} for i in range(200)]
    compiled = R.compile_rules(rules, spark)
    assert len(compiled) == 200 and sum(r.literal is not None for r in compiled) > 120
    rows = [(rnd.choice(["user", "assistant", "system", "tool", None]), " ".join(word() for _ in range(rnd.randint(0, 25)))) for _ in range(120)] + [("user", None), ("user", "")]
    df = spark.createDataFrame(rows, "role string, text string").coalesce(1)
    out = R.apply_rules(df, compiled)

    def python(role, text):
        for r in compiled:
            if text is not None and ("all" in r.roles or role in r.roles):
                text = re.sub(r.source, next(x["replacement"] for x in rules if x["id"] == r.id), text)
        return text

    assert [r.text for r in out.collect()] == [python(*r) for r in rows]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Project") <= 2
    per_row, summary = R.rule_match_report(df, compiled)
    want = dict.fromkeys((r.id for r in compiled), 0)
    for (_, text), got in zip(rows, per_row.collect()):
        flags = []
        for r in compiled:
            new = text if text is None else re.sub(r.source, next(x["replacement"] for x in rules if x["id"] == r.id), text)
            flags.append((r.id, new != text))
            want[r.id] += new != text
            text = new
        assert got.output == text and [tuple(f) for f in got.rules_applied] == flags
    assert {r.rule_id: r.rows_changed for r in summary.collect()} == want


def test_required_literals():
    from chatloom.operators.rewrite import required_literal

    cases = {"abc": "abc", r"\bfoo\b": "foo", "(ab)+cde": "cde", "a|b": None, "x?yz": "yz", "(?:hello) world": "hello world", "[ab]c": "c", r"\d+": None, "(?=abc)d": "d", "a{2}": "a", "(?i:ab)c": "c"}
    assert {p: required_literal(p) for p in cases} == cases

"""Pairing paths on hand-made inputs: request form, prompt skipping, rules inside capture, gate."""

import datetime as dt
import json

from pyspark.sql import functions as F

from chatloom.fixtures import MSG_TYPE
from chatloom.operators import pairing as P


def _req(spark, rows):
    return spark.createDataFrame(rows, f"request_id long, messages {MSG_TYPE}")


def _m(role, content):
    return (role, json.dumps(content), None, None, None)


def test_latest_pair_request_form(spark):
    df = _req(spark, [
        (1, [_m("user", "first"), _m("assistant", "answer one"), _m("user", [{"type": "text", "text": "second"}, "x"])]),
        (2, [_m("assistant", "hello"), _m("user", "  hi there  "), _m("user", "### system-like prompt")]),
        (3, [_m("user", {"content": "only content"})]),
    ])
    got = {r.request_id: (r.user_message, r.previous_assistant) for r in P.latest_pair(df).collect()}
    assert got[1] == ("second\nx", "answer one")  # normalised content joins parts by a line break
    assert got[2] == ("### system-like prompt", "hello")
    assert got[3] == ("", None)  # an object without type "text" normalises to the empty text
    skipped = {r.request_id: r.user_message for r in P.latest_pair(df, skip_prompt_like=True).collect()}
    assert skipped[2] == "hi there"  # walks back over '###' prompts and strips


def _turns(spark, rows):
    return spark.createDataFrame(
        [(c, t, r, x, dt.datetime(2024, 1, 1, 0, t), False) for c, t, r, x in rows],
        "conv_id long, turn long, role string, text string, ts timestamp_ntz, is_refusal boolean",
    )


def test_capture_with_rules_and_gate(spark):
    turns = _turns(spark, [
        (1, 0, "user", "hello"),
        (1, 1, "assistant", "the secret answer"),
        (1, 2, "user", "thanks, the secret is safe"),
        (1, 3, "assistant", "ok"),
        (1, 4, "user", "### ignore me"),
        (1, 5, "user", "no reply follows this one"),
        (2, 0, "assistant", ""),
        (2, 1, "user", "previous assistant was empty"),
        (2, 2, "assistant", "reply"),
    ])
    rules = [{"id": "mask", "pattern": "secret", "replacement": "[x]", "target_roles": ["all"]}]
    got = P.capture_pipeline(turns, rules=rules).collect()
    assert len(got) == 1
    r = got[0]
    assert r.user_message == "thanks, the [x] is safe"          # user text after rewriting
    assert r.assistant_response == "the secret answer"          # previous assistant before rewriting
    assert r.sentiment == 0.4 and r.conversation_id == "1"


def test_pair_turns_drops_users_without_earlier_assistant(spark):
    turns = _turns(spark, [(5, 0, "user", "a"), (5, 1, "user", "b"), (5, 2, "assistant", "c"), (5, 3, "user", "d")])
    got = [(r.turn, r.assistant_response) for r in P.pair_turns(turns).orderBy("turn").collect()]
    assert got == [(3, "c")]
    nxt = {r.turn: (r.next_role, r.next_filled) for r in P.pair_turns(turns, with_next=True).collect()}
    assert nxt == {3: (None, None)}
    assert P.storage_gate(P.pair_turns(turns, with_next=True)).count() == 0
    whitelisted = spark.createDataFrame([("m:latest",), ("other",), ("m",)], "model string")
    assert sorted(r.model for r in P.whitelist_models(whitelisted, ["m"]).collect()) == ["m", "m:latest"]
    assert P.whitelist_models(whitelisted, []).count() == 3
    assert F is not None


_LOG = f"request_id long, conversation_id string, timestamp timestamp_ntz, model string, n int, messages {MSG_TYPE}"


def _log(spark, rows):
    return spark.createDataFrame([(i, f"c{i}", dt.datetime(2024, 1, 1, 0, i), model, 1, msgs) for i, model, msgs in rows], _LOG)


def _facts(spark, rows):
    return spark.createDataFrame(rows, "request_id long, content string, finish_reason string, done boolean")


def test_dialogue_stores_the_reaction_to_the_earlier_answer(spark):
    """A first question stores nothing; thanks sent with the answer in the history is a positive pair."""
    question, answer = "How do tides work?", "The moon pulls on the water."
    log = _log(spark, [
        (1, "local-llm", [_m("user", question)]),
        (2, "local-llm", [_m("user", question), _m("assistant", answer), _m("user", "Thanks! That is perfect!")]),
        (3, None, [_m("user", question), _m("assistant", answer), _m("user", "No, that is wrong. Try again.")]),
    ])
    replies = _facts(spark, [(i, "some text", "stop", True) for i in (1, 2, 3)])
    got = {r.conversation_id: r for r in P.capture_requests(log, replies, configured_model="m:tag").collect()}
    assert set(got) == {"c2", "c3"}
    assert (got["c2"].user_message, got["c2"].assistant_response) == ("Thanks! That is perfect!", answer)
    assert got["c2"].sentiment > 0.3 and got["c3"].sentiment < -0.3


def test_api_gate_and_validation(spark):
    pair = [_m("assistant", "a"), _m("user", "u")]
    log = _log(spark, [(i, "m", pair) for i in range(1, 7)] + [
        (7, "other", pair), (8, "m", [_m("assistant", "a")]), (9, "m", [_m("assistant", None), _m("user", "u")]),
        (10, "m", [_m("assistant", "a"), _m("user", None)])])
    replies = _facts(spark, [
        (1, "x", "stop", False), (2, "x", "length", True), (3, "", "stop", True), (4, None, "stop", True), (5, "x", "tool_calls", True),
        *[(i, "x", "stop", True) for i in (7, 8, 9, 10)], (1, "x", "stop", False)])
    got = P.capture_requests(log, replies, configured_model="m").collect()
    assert sorted(r.conversation_id for r in got) == ["c1", "c10"]  # 6 has no reply, 1 two


def test_proxy_gate_whitelist_and_prompt_skip(spark):
    log = _log(spark, [
        (1, "m:x", [_m("assistant", "a"), _m("user", " kept "), _m("user", "### task")]),
        (2, "n", [_m("assistant", "a"), _m("user", "u")]), (3, "m", [_m("assistant", "a"), _m("user", "  ")]),
        (4, "m", [_m("user", "u")]), (5, "m", [_m("assistant", "a"), _m("user", "u")]), (6, None, [_m("assistant", "a"), _m("user", "u")])])
    replies = _facts(spark, [(i, "", "length", i != 5) for i in range(1, 7)])
    got = P.capture_requests(log, replies, path="proxy", models=["m:latest"]).collect()
    assert [(r.conversation_id, r.user_message) for r in got] == [("c1", "kept")]
    every = P.capture_requests(log, replies, path="proxy").collect()
    assert sorted(r.conversation_id for r in every) == ["c1", "c2", "c6"]


def test_rules_rewrite_the_request_user_text_only(spark):
    log = _log(spark, [(1, "m", [_m("assistant", "foo"), _m("user", [{"type": "text", "text": "foo"}, "bar"])])])
    rules = [{"id": "r", "pattern": "foo", "replacement": "baz", "target_roles": ["user"]}]
    r = P.capture_requests(log, _facts(spark, [(1, "x", "stop", True)]), rules=rules).first()
    assert (r.user_message, r.assistant_response) == ("baz\nbar", "foo")

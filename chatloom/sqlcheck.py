"""DuckDB SQL twins of the fixtures and scoring rules.

Used only to build ``oracle_sql()`` strings: the driver runs them in DuckDB over
the same parquet tables and compares with the Spark results.  They are
written independently of the Spark code (SQL text, not Columns) but the regex
patterns come from the same lexicon module, so both sides share one rule text.
"""

from __future__ import annotations

from chatloom.config import DEFAULT, Thresholds
from chatloom.fixtures import EVENT_SENTIMENT, FEEDBACK_APPEND, PROMPT_PREFIX, REFUSAL_K, SHORT_REPLACEMENT
from chatloom.functions import lexicon
from chatloom.functions.content import WS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def d(x: float) -> str:
    """A DOUBLE literal (DuckDB types bare decimals as DECIMAL)."""
    return f"CAST({x!r} AS DOUBLE)"


def fx_turns_cte() -> str:
    k = "CASE WHEN role = 'user' AND turn >= 1 THEN (conv_id * 7 + turn * 3) % 16 END"
    whens = []
    for key, suffix in FEEDBACK_APPEND.items():
        whens.append(f"WHEN _k = {key} THEN text || {q(suffix)}")
    for key, rep in SHORT_REPLACEMENT.items():
        whens.append(f"WHEN _k = {key} THEN {q(rep)}")
    for key, pre in PROMPT_PREFIX.items():
        whens.append(f"WHEN _k = {key} THEN {q(pre)} || text")
    return f"""fx_turns AS (
  SELECT conv_id, turn, role,
         CASE {' '.join(whens)} ELSE text END AS text,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(conv_id * 37 + turn AS BIGINT)) AS ts,
         coalesce(_k = {REFUSAL_K}, false) AS is_refusal
  FROM (SELECT *, {k} AS _k FROM conversations)
)"""


def fx_interactions_cte() -> str:
    sent = " ".join(f"WHEN event_type = {q(k)} THEN {d(v)}" for k, v in EVENT_SENTIMENT.items())
    return f"""fx_interactions AS (
  SELECT CAST(event_id AS VARCHAR) AS id,
         CAST(user_id AS VARCHAR) AS conversation_id,
         ts AS "timestamp",
         user_id % 4 AS model_line,
         event_type || ' ' || props AS user_message,
         'reply ' || CAST(event_id AS VARCHAR) AS assistant_response,
         CAST(length(event_type || ' ' || props) AS INTEGER) AS user_message_length,
         CAST(length('reply ' || CAST(event_id AS VARCHAR)) AS INTEGER) AS assistant_response_length,
         CASE {sent} ELSE {d(0.0)} END AS sentiment,
         least({d(5.0)}, {d(0.25)} + value / {d(20.0)}) AS weight,
         event_id % 37 = 0 AS is_golden,
         event_type = 'error' AND event_id % 5 = 0 AS is_refusal,
         false AS truncated
  FROM events
)"""


def fx_runs_cte() -> str:
    ev = f"(floor(ln({d(1.5)} + (CAST(floor(o_totalprice) AS BIGINT) % 300) / {d(100.0)}) * {d(1e9)} + {d(0.5)}) / {d(1e9)})"
    return f"""fx_runs AS (
  SELECT o_orderkey AS run_id, o_custkey % 5 AS model_line, o_orderdate AS ts,
         CASE WHEN o_orderpriority = '5-LOW' THEN 'dpo' ELSE 'sft' END AS mode,
         CASE WHEN o_orderkey % 83 <> 0 THEN {ev} * {d(0.9)} END AS train_loss,
         CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN {d(120.0)} ELSE {ev} END AS eval_loss,
         o_orderkey % 7 <> 0 AS has_adapter
  FROM orders
)"""


def fx_pairs_cte(drop_prompt_like: bool = False) -> str:
    """P2 over fx_turns (optionally P3 first): user turn + last earlier assistant text."""
    src = "fx_turns"
    if drop_prompt_like:
        src = f"(SELECT * FROM fx_turns WHERE NOT (role = 'user' AND regexp_matches(text, '^{WS}*###')))"
    return f"""fx_pairs AS (
  SELECT conv_id, turn, ts, is_refusal, text AS user_message, assistant_response FROM (
    SELECT *, last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS)
                OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
              AS assistant_response
    FROM {src})
  WHERE role = 'user' AND assistant_response IS NOT NULL
)"""


def score_sql(src: str, text_col: str = "user_message", continuing: str = "true", cfg: Thresholds = DEFAULT,
              keep_steps: bool = False) -> str:
    """Subquery adding sentiment, weight, is_golden to every column of ``src``."""
    low = f"lower({text_col})"
    c0 = f"""SELECT *,
      {lexicon.sql_family_count(low, 'strong_pos')} AS _sp,
      {lexicon.sql_family_count(low, 'strong_neg')} AS _sn,
      {lexicon.sql_family_count(low, 'mod_pos')} AS _mp,
      {lexicon.sql_family_count(low, 'mod_neg')} AS _mn,
      {lexicon.sql_family_count(low, 'instruction')} AS _in,
      length({low}) - length(replace({low}, '?', '')) AS _q,
      length({low}) - length(replace({low}, '!', '')) AS _e,
      length({text_col}) AS _len,
      {lexicon.sql_directive_hit(low)} AS _dir,
      {continuing} AS _cont
    FROM {src}"""
    s0 = f"""SELECT *, CASE WHEN _mn > _mp THEN {d(0.0)} - {d(0.4)} * (_mn / (_mn + _mp + 1))
                       WHEN _mp > _mn THEN {d(0.0)} + {d(0.4)} * (_mp / (_mn + _mp + 1))
                       ELSE {d(0.0)} END AS _s0 FROM ({c0})"""
    s1 = f"SELECT *, CASE WHEN _len < 10 AND _cont THEN _s0 - {d(0.1)} ELSE _s0 END AS _s1 FROM ({s0})"
    s2 = f"SELECT *, CASE WHEN _q > 2 THEN _s1 - {d(0.15)} ELSE _s1 END AS _s2 FROM ({s1})"
    s3 = f"""SELECT *, CASE WHEN _e > 0 THEN (CASE WHEN _s2 >= 0 THEN _s2 + {d(0.1)} * least(_e, 2)
                                               ELSE _s2 - {d(0.1)} * least(_e, 2) END)
                       ELSE _s2 END AS _s3 FROM ({s2})"""
    s4 = f"SELECT *, CASE WHEN _in > 0 THEN greatest(_s3, {d(0.3)}) ELSE _s3 END AS _s4 FROM ({s3})"
    s5 = f"SELECT *, CASE WHEN _cont AND _s4 = 0 THEN {d(cfg.continuation)} ELSE _s4 END AS _s5 FROM ({s4})"
    s6 = f"""SELECT *, CASE WHEN _sn > 0 THEN {d(-0.8)} * least(_sn / {d(2.0)}, {d(1.0)})
                       WHEN _sp > 0 THEN {d(0.8)} * least(_sp / {d(2.0)}, {d(1.0)})
                       ELSE greatest({d(-1.0)}, least({d(1.0)}, _s5)) END AS sentiment FROM ({s5})"""
    w0 = f"""SELECT *, CASE WHEN _in >= 2 THEN {d(1.0)} * {d(cfg.instruction_boost)}
                       WHEN _in = 1 THEN {d(1.0)} * {d(1.3)} ELSE {d(1.0)} END
                  * ({d(1.0)} + abs(sentiment) * {d(0.5)}) AS _w1 FROM ({s6})"""
    w1 = f"""SELECT *, least(CASE WHEN _len > 500 THEN _w1 * {d(2.0)} WHEN _len > 200 THEN _w1 * {d(1.5)}
                             WHEN _len < 20 THEN _w1 * {d(0.7)} ELSE _w1 END, {d(5.0)}) AS weight FROM ({w0})"""
    excl = "_w1" if keep_steps else "_sp, _sn, _mp, _mn, _in, _q, _e, _len, _dir, _cont, _s0, _s1, _s2, _s3, _s4, _s5, _w1"
    g = f"""SELECT * EXCLUDE ({excl}),
              (weight >= 5.0 OR sentiment >= 0.7 OR (abs(sentiment) >= 0.3 AND _dir)
               OR (sentiment < -0.6 AND _len > 300)) AS is_golden
            FROM ({w1})"""
    return f"({g})"


def fx_replies_cte() -> str:
    return """fx_replies AS (
  SELECT event_type || ' ' || props AS prompt, event_id AS seq, CASE WHEN event_id % 8 = 6 THEN 500 ELSE 200 END AS status,
         CASE event_id % 8
           WHEN 0 THEN '"Rejected answer for ' || replace(props, '"', '\\"') || '"'
           WHEN 1 THEN '"0123456789"'
           WHEN 2 THEN '"0123456789A"'
           WHEN 3 THEN '""'
           WHEN 4 THEN '[{"type":"text","text":"block one"},{"type":"image_url"},{"type":"text","text":"block two"}]'
           WHEN 5 THEN '"   "' END AS content,
         CASE WHEN event_id % 8 = 3 THEN 'thinking about ' || event_type END AS thinking,
         TIMESTAMP '2024-02-01 00:00:00' - to_minutes(CAST(event_id % 720 AS BIGINT)) AS cached_at
  FROM events
)"""


def clean_rejections_cte(src: str = "fx_replies") -> str:
    """D6 in DuckDB: block lists joined by a space, strings as-is, strip, thinking fallback, > 10 chars."""
    from chatloom.functions.content import WS

    text = f"""CASE WHEN content IS NULL THEN ''
         WHEN json_type(content) = 'ARRAY' THEN array_to_string(list_transform(
              list_filter(from_json(content, '["JSON"]'), lambda x: json_type(x) = 'OBJECT' AND json_extract_string(x, '$.type') = 'text'),
              lambda x: coalesce(json_extract_string(x, '$.text'), '')), ' ')
         WHEN json_type(content) = 'VARCHAR' THEN json_extract_string(content, '$')
         ELSE content END"""
    strip = lambda e: f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"
    return f"""cleaned AS (
  SELECT * FROM (
    SELECT *, CASE WHEN {strip(text)} = '' AND coalesce(thinking, '') <> '' THEN {strip('thinking')} ELSE {strip(text)} END AS rejection
    FROM {src}) WHERE length(rejection) > 10
)"""


def fx_requests_cte() -> str:
    """Needs fx_turns in scope."""
    def msg(role, content, tool_calls="NULL", tool_call_id="NULL"):
        return (f"{{'role': {role}, 'content': {content}, 'name': CAST(NULL AS VARCHAR), "
                f"'tool_calls': CAST({tool_calls} AS VARCHAR), 'tool_call_id': CAST({tool_call_id} AS VARCHAR)}}")
    h = "((r.conv_id * 5 + r.turn) % 16)"
    j = "to_json(t.text)::VARCHAR"
    content = f"""CASE WHEN t.turn < r.turn THEN {j} ELSE CASE {h} % 8 WHEN 1 THEN '[{{"type":"text","text":' || {j} || '}}]'
             WHEN 2 THEN '[{{"type":"image_url","image_url":{{"url":"data:image/png;base64,QUJD"}}}},{{"type":"text","text":' || {j} || '}}]'
             WHEN 3 THEN '[' || {j} || ',true,null,{{"type":"text","text":"extra"}}]'
             WHEN 4 THEN '{{"content":' || {j} || '}}'
             ELSE {j} END END"""
    call = q('[{"id":"call_1","type":"function","function":{"name":"lookup","arguments":"{}"}}]')
    tool = f"""[{msg("'assistant'", "'null'", call)}, {msg("'tool'", "'\"42\"'", 'NULL', "'call_1'")}]"""
    return f"""fx_requests AS (
  SELECT request_id, CAST(conv_id AS VARCHAR) AS conversation_id, ts AS "timestamp",
         CASE WHEN h = 9 THEN NULL WHEN h = 12 THEN 'other-model' WHEN h % 8 = 7 THEN 'chatloom-model:latest' ELSE 'chatloom-model' END AS model,
         CASE WHEN h % 8 = 6 THEN 2 ELSE 1 END AS n,
         CASE WHEN h % 8 = 6 THEN {d(3.0)} ELSE {d(0.7)} END AS temperature,
         CASE WHEN h % 8 = 6 THEN {d(1.5)} ELSE {d(0.9)} END AS top_p,
         CASE WHEN h % 8 = 6 THEN 0 ELSE 256 END AS max_tokens,
         CASE WHEN h = 14 THEN {d(3.0)} END AS presence_penalty,
         CASE WHEN h = 14 THEN {d(-2.5)} END AS frequency_penalty,
         CASE WHEN h = 14 THEN 21 END AS top_logprobs,
         CASE WHEN h % 8 = 5 THEN list_concat(hist, {tool}) WHEN h = 11 THEN list_filter(hist, lambda m: m.role <> 'user') ELSE hist END AS messages
  FROM (SELECT r.conv_id, r.turn, r.ts, r.conv_id * 1000 + r.turn AS request_id, {h} AS h, list({msg('t.role', content)} ORDER BY t.turn) AS hist
        FROM fx_turns r JOIN fx_turns t ON r.conv_id = t.conv_id AND t.turn <= r.turn WHERE r.role = 'user' GROUP BY r.conv_id, r.turn, r.ts)
)"""


def fx_request_replies_cte() -> str:
    """Needs fx_turns in scope.  (request_id, content, finish_reason, done): the facts a parsed reply body holds."""
    return """fx_request_replies AS (
  SELECT request_id, CASE WHEN g = 2 THEN NULL WHEN g = 5 THEN '' ELSE reply END AS content,
         CASE WHEN g = 2 THEN 'tool_calls' WHEN g = 3 THEN 'length' WHEN g = 5 THEN 'error' WHEN g < 6 THEN 'stop' END AS finish_reason, g IN (0, 7) AS done
  FROM (SELECT r.conv_id * 1000 + r.turn AS request_id, (r.conv_id * 3 + r.turn) % 8 AS g, coalesce(a.text, '') AS reply
        FROM fx_turns r LEFT JOIN fx_turns a ON a.conv_id = r.conv_id AND a.turn = r.turn + 1 AND a.role = 'assistant'
        WHERE r.role = 'user')
)"""


def last_of_role(role: str, col: str) -> str:
    return f"list_filter(messages, lambda m: m.role = '{role}')[-1].{col}"


def p1_user_sql() -> str:
    """The newest user message's normalised text (null without one)."""
    return n1_sql(last_of_role("user", "content"))


def p1_assistant_sql() -> str:
    return f"(CASE WHEN {last_of_role('assistant', 'role')} IS NOT NULL THEN {n2_sql(last_of_role('assistant', 'content'))} END)"


def astext(e: str) -> str:
    return (f"(CASE json_type({e}) WHEN 'VARCHAR' THEN json_extract_string({e}, '$') WHEN 'NULL' THEN 'None' "
            f"WHEN 'BOOLEAN' THEN CASE WHEN CAST({e} AS VARCHAR) = 'true' THEN 'True' ELSE 'False' END ELSE CAST({e} AS VARCHAR) END)")


def n1_sql(c: str) -> str:
    item = (f"lambda e: CASE WHEN json_type(e) = 'VARCHAR' THEN json_extract_string(e, '$') "
            f"WHEN json_type(e) = 'OBJECT' AND json_extract_string(e, '$.type') = 'text' THEN coalesce(json_extract_string(e, '$.text'), '') END")
    return f"""(CASE WHEN {c} IS NULL THEN NULL
      WHEN NOT json_valid({c}) THEN {c}
      WHEN json_type({c}) = 'NULL' THEN NULL
      WHEN json_type({c}) = 'VARCHAR' THEN json_extract_string({c}, '$')
      WHEN json_type({c}) = 'ARRAY' THEN array_to_string(list_transform(from_json({c}, '["JSON"]'), {item}), chr(10))
      WHEN json_type({c}) = 'OBJECT' THEN CASE WHEN json_extract_string({c}, '$.type') = 'text' THEN coalesce(json_extract_string({c}, '$.text'), '') ELSE '' END
      ELSE {c} END)"""


def n2_sql(c: str) -> str:
    def sub(e, path):
        x = f"json_extract({e}, '{path}')"
        return f"(CASE WHEN {x} IS NOT NULL THEN {astext(x)} END)"

    # a null element of the list comes out of from_json as SQL's null
    item = f"lambda e: CASE WHEN e IS NULL THEN 'None' WHEN json_type(e) = 'OBJECT' THEN coalesce({sub('e', '$.text')}, {sub('e', '$.content')}) ELSE {astext('e')} END"
    return f"""(CASE WHEN {c} IS NULL THEN ''
      WHEN NOT json_valid({c}) THEN {c}
      WHEN json_type({c}) = 'NULL' THEN ''
      WHEN json_type({c}) = 'VARCHAR' THEN json_extract_string({c}, '$')
      WHEN json_type({c}) = 'ARRAY' THEN array_to_string(list_transform(from_json({c}, '["JSON"]'), {item}), ' ')
      WHEN json_type({c}) = 'OBJECT' THEN coalesce({sub(c, '$.text')}, {sub(c, '$.content')}, {c})
      ELSE {astext(c)} END)"""


def fx_chunks_cte() -> str:
    """Needs fx_turns in scope."""
    return """fx_chunks AS (
  WITH t AS (SELECT conv_id * 1000 + turn AS request_id, CASE WHEN conv_id % 2 = 0 THEN 'ollama' ELSE 'openai' END AS provider,
                    text, greatest(1, CAST(ceil(length(text) / 16.0) AS INTEGER)) AS n
             FROM fx_turns WHERE role = 'assistant'),
  p AS (SELECT request_id, provider, text, n, unnest(range(0, n)) AS i FROM t)
  SELECT request_id, provider, i * 10 + 10 AS seq,
         CASE WHEN provider = 'ollama'
              THEN '{"message":{"content":' || to_json(substring(text, i * 16 + 1, 16))::VARCHAR || '},"done":false}'
              ELSE 'data: {"choices":[{"delta":{"content":' || to_json(substring(text, i * 16 + 1, 16))::VARCHAR || '},"finish_reason":' || CASE WHEN request_id // 1000 % 4 = 1 THEN '""' ELSE 'null' END || '}]}' END AS line
  FROM p
  UNION ALL SELECT request_id, provider, 5, '' FROM t
  UNION ALL SELECT request_id, provider, 7, '{not json' FROM t
  UNION ALL SELECT request_id, provider, n * 10 + 10,
         CASE WHEN provider = 'ollama' THEN '{"message":{"content":""},"done":true,"done_reason":"stop"}'
              ELSE 'data: {"choices":[{"delta":{},"finish_reason":"stop"}]}' END FROM t
  UNION ALL SELECT request_id, provider, n * 10 + 11, 'data: [DONE]' FROM t WHERE provider = 'openai'
)"""

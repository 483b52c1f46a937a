"""Message-content projections (N1-N10) as native Column expressions.

Message ``content`` is polymorphic (string, list of blocks, object or null).
It is carried as the JSON text of the value and opened with ``try_parse_json``
into a VARIANT; text that is not valid JSON is treated as a plain string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.split()/strip() whitespace, in a class both the JVM regex and RE2 accept.
WS = r"[\t\n\x{0B}\f\r\x{1C}-\x{1F}\x{85}\p{Z}]"


def _v(c: Column) -> Column:
    return F.try_parse_json(c)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _get(v: Column, path: str, typ: str = "string") -> Column:
    return F.try_variant_get(v, path, typ)


def _as_text(e: Column) -> Column:
    """Python's str(item) of a JSON value: strings as they are, True / False / None, numbers.

    Containers keep their JSON text, and a number its shortest form (1.0 is 1: the parsed value has no zero places).
    """
    k = _kind(e)
    return (
        F.when(k == "STRING", _get(e, "$")).when(k == "VOID", F.lit("None"))
        .when(k == "BOOLEAN", F.when(_get(e, "$", "boolean"), F.lit("True")).otherwise(F.lit("False"))).otherwise(F.to_json(e))
    )


def _get_or(v: Column, path: str, absent: str) -> Column:
    """``dict.get(key, absent)``: a key that is there with null gives null."""
    return F.when(_get(v, path, "variant").isNull(), F.lit(absent)).otherwise(_get(v, path))


def normalize_content(c: Column) -> Column:
    """Flatten list content to text ("\\n"-joined text parts and bare strings)."""
    v = _v(c)
    k = _kind(v)
    arr = _get(v, "$", "array<variant>")
    parts = F.transform(
        arr,
        lambda e: F.when(_kind(e) == "STRING", _get(e, "$")).when(
            _kind(e).startswith("OBJECT") & (_get(e, "$.type") == "text"), F.coalesce(_get(e, "$.text"), F.lit(""))
        ),
    )
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(v.isNull(), c)
        .when(k == "VOID", F.lit(None).cast("string"))
        .when(k == "STRING", _get(v, "$"))
        .when(k.startswith("ARRAY"), F.array_join(parts, "\n"))
        .when(
            k.startswith("OBJECT"),
            F.when(_get(v, "$.type") == "text", F.coalesce(_get(v, "$.text"), F.lit(""))).otherwise(F.lit("")),
        )
        .otherwise(F.to_json(v))
    )


def text_content(c: Column) -> Column:
    """Text for scoring: objects give ``text`` else ``content``; joined by a space."""
    v = _v(c)
    k = _kind(v)
    arr = _get(v, "$", "array<variant>")

    def item(e: Column) -> Column:
        return F.when(
            _kind(e).startswith("OBJECT"), F.coalesce(_as_text_path(e, "$.text"), _as_text_path(e, "$.content"))
        ).otherwise(_as_text(e))

    return (
        F.when(c.isNull(), F.lit(""))
        .when(v.isNull(), c)
        .when(k == "VOID", F.lit(""))
        .when(k == "STRING", _get(v, "$"))
        .when(k.startswith("ARRAY"), F.array_join(F.transform(arr, item), " "))
        .when(
            k.startswith("OBJECT"),
            F.coalesce(_as_text_path(v, "$.text"), _as_text_path(v, "$.content"), F.to_json(v)),
        )
        .otherwise(_as_text(v))
    )


def _as_text_path(v: Column, path: str) -> Column:
    sub = _get(v, path, "variant")
    return F.when(sub.isNotNull(), _as_text(sub))


def split_blocks_text_images(c: Column) -> Column:
    """struct(text, images) for list content; data-URI prefixes stripped."""
    v = _v(c)
    arr = _get(v, "$", "array<variant>")
    texts = F.transform(
        arr,
        lambda e: F.when(~_kind(e).startswith("OBJECT"), _as_text(e)).when(
            _get(e, "$.type") == "text", F.coalesce(_get(e, "$.text"), F.lit(""))
        ),
    )

    def image_payload(e: Column) -> Column:
        url = F.coalesce(_get(e, "$.image_url.url"), F.lit(""))
        after = F.substr(url, F.instr(url, ";base64,") + F.lit(8))
        is_data = url.startswith("data:") & (F.instr(url, ";base64,") > 0)
        return F.when(
            _kind(e).startswith("OBJECT") & (_get(e, "$.type") == "image_url"),
            F.when(is_data, after).when(url != "", url),
        )

    is_list = _kind(v).startswith("ARRAY")
    return F.struct(
        F.when(is_list, F.array_join(texts, "\n")).otherwise(text_content(c)).alias("text"),
        F.when(is_list, F.array_compact(F.transform(arr, image_payload))).otherwise(
            F.array().cast("array<string>")
        ).alias("images"),
    )


def extract_thinking(c: Column) -> Column:
    """struct(thinking, content) from the first <think>...</think> block."""
    pattern = r"(?s)<think>(.*?)</think>(.*)"
    has = c.rlike(r"(?s)<think>.*?</think>")
    strip = lambda x: F.regexp_replace(x, f"^{WS}+|{WS}+$", "")
    return F.struct(
        F.when(has, strip(F.regexp_extract(c, pattern, 1))).alias("thinking"),
        F.when(has, strip(F.regexp_extract(c, pattern, 2))).otherwise(c).alias("content"),
    )


def parse_reply(body: Column, provider: Column) -> Column:
    """Provider reply JSON -> struct(content, tool_calls, thinking, finish_reason).

    provider ``ollama``: ``message`` object, ``done_reason``; otherwise OpenAI
    layout: ``choices[0].message``, ``finish_reason``, thinking from
    ``reasoning`` else ``thoughts``.  A missing content is empty and a missing
    finish reason ``stop``; either given as null stays null.
    """
    v = _v(body)
    o_msg = _get(v, "$.message", "variant")
    choice = _get(v, "$.choices[0]", "variant")
    a_msg = _get(choice, "$.message", "variant")
    o_ok = o_msg.isNotNull()
    a_ok = choice.isNotNull()
    is_ollama = provider == "ollama"
    content = F.when(is_ollama, F.when(o_ok, _get_or(o_msg, "$.content", "")).otherwise(F.lit(""))).otherwise(
        F.when(a_ok, _get_or(a_msg, "$.content", "")).otherwise(F.lit(""))
    )
    tool_calls = F.when(is_ollama & o_ok, F.to_json(_get(o_msg, "$.tool_calls", "variant"))).when(
        ~is_ollama & a_ok, F.to_json(_get(a_msg, "$.tool_calls", "variant"))
    )
    a_think = F.coalesce(
        F.when(F.coalesce(_get(a_msg, "$.reasoning"), F.lit("")) != "", _get(a_msg, "$.reasoning")),
        _get(a_msg, "$.thoughts"),
    )
    thinking = F.when(is_ollama & o_ok, _get(o_msg, "$.thinking")).when(~is_ollama & a_ok, a_think)
    finish = F.when(is_ollama, F.when(o_ok, _get_or(v, "$.done_reason", "stop")).otherwise(F.lit("error"))).otherwise(
        F.when(a_ok, _get_or(choice, "$.finish_reason", "stop")).otherwise(F.lit("error"))
    )
    return F.struct(
        content.alias("content"), tool_calls.alias("tool_calls"), thinking.alias("thinking"), finish.alias("finish_reason")
    )


def parse_stream_line(line: Column, provider: Column) -> Column:
    """One streamed line -> struct(keep, delta, finish_reason, done, end).

    NDJSON (``ollama``): blank and malformed lines are not kept; a kept line
    gives ``message.content`` and, when ``done``, ``done_reason``.  SSE: only
    ``data: `` lines; ``[DONE]`` marks the end (``end``) and is not kept.
    """
    is_ollama = provider == "ollama"
    o = _v(line)
    o_keep = (F.length(F.regexp_replace(line, f"^{WS}+|{WS}+$", "")) > 0) & o.isNotNull() & _get(o, "$.message", "variant").isNotNull()
    o_done = F.coalesce(_get(o, "$.done", "boolean"), F.lit(False))
    data = F.substr(line, F.lit(7))
    is_data = line.startswith("data: ")
    is_end = is_data & (data == "[DONE]")
    s = _v(data)
    s_keep = is_data & ~is_end & s.isNotNull()
    delta = F.when(is_ollama, _get(o, "$.message.content")).otherwise(_get(s, "$.choices[0].delta.content"))
    finish = F.when(is_ollama, F.when(o_done, _get(o, "$.done_reason"))).otherwise(_get(s, "$.choices[0].finish_reason"))
    return F.struct(
        F.when(is_ollama, o_keep).otherwise(s_keep).alias("keep"),
        F.when(F.coalesce(delta, F.lit("")) != "", delta).alias("delta"),
        finish.alias("finish_reason"),
        F.when(is_ollama, o_keep & o_done).otherwise(F.lit(False)).alias("done"),
        F.when(is_ollama, F.lit(False)).otherwise(is_end).alias("end"),
    )


def word_count(c: Column) -> Column:
    """len(text.split()) with Python's whitespace; 0 for null/empty."""
    toks = F.split(F.regexp_replace(c, f"^{WS}+|{WS}+$", ""), f"{WS}+")
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, F.lit(0)).otherwise(
        F.size(F.filter(toks, lambda t: t != ""))
    )


def token_usage(prompt: Column, completion: Column) -> Column:
    """Whitespace token counts; total is 0 unless both sides are non-empty."""
    p = word_count(prompt)
    cpl = word_count(completion)
    both = (F.coalesce(F.length(prompt), F.lit(0)) > 0) & (F.coalesce(F.length(completion), F.lit(0)) > 0)
    return F.struct(
        p.alias("prompt_tokens"),
        cpl.alias("completion_tokens"),
        F.when(both, p + cpl).otherwise(F.lit(0)).alias("total_tokens"),
    )


def normalize_model(c: Column) -> Column:
    """Text before the first ':'."""
    return F.substring_index(c, ":", 1)

"""Pairing of user turns with the assistant turn they react to.

The turn table form (conversation id, turn number, role, text) is the scalable
one: ``pair_turns`` pairs user turn N with the last earlier assistant turn of
the same conversation using the skew-safe running carry in ``plans.ordering``.
The request form (one row per request with the whole message array) is paired
with array functions inside a single projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.config import DEFAULT, Thresholds
from chatloom.functions import content as C
from chatloom.functions.scoring import score
from chatloom.plans.ordering import carry_many

WS = C.WS


def strip(col: Column) -> Column:
    return F.regexp_replace(col, f"^{WS}+|{WS}+$", "")


def rstrip(col: Column) -> Column:
    return F.regexp_replace(col, f"{WS}+$", "")


# --- request form ------------------------------------------------------------

def latest_pair(requests: DataFrame, messages: str = "messages", skip_prompt_like: bool = False) -> DataFrame:
    """P1 (and P3 on the request form): last user and last assistant content of each request.

    The assistant side is read with the scoring text rule (N2).  The user side is read from the
    normalised messages (N1), as the rewrite rules see them; with ``skip_prompt_like`` (the proxy
    path, which reads raw content) it is read with N2, skips messages whose stripped text starts
    with ``###``, and is stripped.
    """
    user_rule = C.text_content if skip_prompt_like else C.normalize_content
    norm = F.transform(F.col(messages), lambda m: F.struct(
        m["role"].alias("role"),
        F.when(m["role"] == "user", user_rule(m["content"])).otherwise(C.text_content(m["content"])).alias("text")))
    users = F.filter(norm, lambda m: m["role"] == "user")
    if skip_prompt_like:
        users = F.filter(users, lambda m: ~F.coalesce(strip(m["text"]).startswith("###"), F.lit(False)))
    last_user = F.try_element_at(users, F.lit(-1))["text"]
    if skip_prompt_like:
        last_user = strip(last_user)
    last_asst = F.try_element_at(F.filter(norm, lambda m: m["role"] == "assistant"), F.lit(-1))["text"]
    return requests.withColumn("user_message", last_user).withColumn("previous_assistant", last_asst)


def parsed_replies(replies: DataFrame, body: str = "body", provider: str = "provider") -> DataFrame:
    """Reply facts the request gate reads, from whole reply bodies (N5): content, finish_reason and
    ``done`` (the provider's end mark).  Streamed replies have them from ``reassemble_reply`` (N7)."""
    p = C.parse_reply(F.col(body), F.col(provider))
    done = F.coalesce(F.try_variant_get(F.try_parse_json(F.col(body)), "$.done", "boolean"), F.lit(False))
    return replies.select("*", p["content"].alias("content"), p["finish_reason"].alias("finish_reason"), done.alias("done"))


def gate_requests(pairs: DataFrame, replies: DataFrame, path: str = "api", key: str = "request_id") -> DataFrame:
    """P4 on paired requests (``latest_pair``) and their reply facts (content, finish_reason, done).

    ``api``: the reply ended with ``stop`` and has text, and the previous assistant text is not
    empty.  ``proxy``: the reply is done, and both sides of the pair are not empty.  A request is
    kept once however many of its replies pass; requests without a reply are dropped.
    """
    def filled(c: str) -> Column:
        return F.coalesce(F.length(c), F.lit(0)) > 0

    if path == "api":
        final, whole = (F.col("finish_reason") == "stop") & filled("content"), filled("previous_assistant")
    elif path == "proxy":
        final, whole = F.col("done"), filled("user_message") & filled("previous_assistant")
    else:
        raise ValueError(f"path {path!r} is neither 'api' nor 'proxy'")
    # Texts of replies stay out of the shuffle: only the ids of final ones are joined.
    return pairs.where(whole).join(replies.where(final).select(key), key, "left_semi")


def capture_requests(
    requests: DataFrame,
    replies: DataFrame,
    path: str = "api",
    rules=None,
    configured_model: str | None = None,
    models: Sequence[str] = (),
    cfg: Thresholds = DEFAULT,
) -> DataFrame:
    """P6 on a request log and its reply facts: validate, pair, rewrite, gate, score, record.

    ``api``: with ``configured_model``, requests that N10 rejects are not stored; the user text is
    normalised and rewritten by the rules before scoring, the assistant text stays as given.
    ``proxy``: the model whitelist (P5) decides what is stored, prompt-like user messages are
    skipped (P3), and no rules apply.
    """
    from chatloom.operators.interactions import build_interactions
    from chatloom.operators.requests import flag_invalid_requests
    from chatloom.operators.rewrite import apply_rules

    if path == "proxy":
        if rules:
            raise ValueError("rules apply on the api path only")
        pairs = latest_pair(whitelist_models(requests, models), skip_prompt_like=True)
    else:
        valid = requests
        if configured_model is not None:
            valid = flag_invalid_requests(requests, configured_model).where(F.size("reasons") == 0)
        pairs = latest_pair(valid.where(F.exists("messages", lambda m: m["role"] == "user")))
        pairs = pairs.withColumn("user_message", F.coalesce("user_message", F.lit("")))
    pairs = pairs.select("request_id", "conversation_id", "timestamp", "user_message", "previous_assistant")
    if rules:
        pairs = apply_rules(pairs.withColumn("_role", F.lit("user")), rules, text="user_message", role="_role").drop("_role")
    scored = score(gate_requests(pairs, replies, path), "user_message", True, cfg)
    return build_interactions(
        scored.select("conversation_id", "timestamp", "user_message", F.col("previous_assistant").alias("assistant_response"),
                      "sentiment", "weight", "is_golden", F.lit(False).alias("is_refusal")),
        cfg,
    )


# --- turn form ---------------------------------------------------------------

def drop_prompt_like_users(turns: DataFrame, text: str = "text", role: str = "role") -> DataFrame:
    """Remove user turns whose stripped text starts with ``###``; strip the rest."""
    is_prompt = (F.col(role) == "user") & F.coalesce(strip(F.col(text)).startswith("###"), F.lit(False))
    return turns.where(~is_prompt).withColumn(
        text, F.when(F.col(role) == "user", strip(F.col(text))).otherwise(F.col(text))
    )


def pair_turns(
    turns: DataFrame,
    key: str = "conv_id",
    order: Sequence[str] = ("turn",),
    text: str = "text",
    role: str = "role",
    with_next: bool = False,
) -> DataFrame:
    """Each user turn with the most recent earlier assistant text (N : N-1).

    User turns without an earlier assistant turn are dropped.  With
    ``with_next`` the immediately following turn's role and whether it has text are attached
    as ``next_role`` / ``next_filled`` (needed by the storage gate).
    """
    specs = [(F.when(F.col(role) == "assistant", F.col(text)), "assistant_response", "last")]
    if with_next:
        specs.append((F.struct(F.col(role).alias("r"), (F.coalesce(F.length(text), F.lit(0)) > 0).alias("f")), "_next", "first"))
    t = carry_many(turns, key, list(order), specs)
    if with_next:
        t = t.withColumn("next_role", F.col("_next.r")).withColumn("next_filled", F.col("_next.f")).drop("_next")
    t = t.where((F.col(role) == "user") & F.col("assistant_response").isNotNull())
    return t.withColumnRenamed(text, "user_message")


def storage_gate(pairs: DataFrame) -> DataFrame:
    """P4 on paired turns: the reply (next turn) is a non-empty assistant turn and
    the previous assistant text is non-empty."""
    return pairs.where(
        (F.col("next_role") == "assistant")
        & F.col("next_filled")
        & (F.length(F.col("assistant_response")) > 0)
    )


def whitelist_models(df: DataFrame, models: Sequence[str], model_col: str = "model") -> DataFrame:
    """P5: keep rows whose normalised model is in the normalised whitelist; empty keeps all."""
    if not models:
        return df
    allowed = sorted({m.split(":", 1)[0] for m in models})
    return df.where(C.normalize_model(F.col(model_col)).isin(allowed))


def capture_pipeline(
    turns: DataFrame,
    rules=None,
    cfg: Thresholds = DEFAULT,
    gate: bool = True,
    skip_prompt_like: bool = True,
) -> DataFrame:
    """Rewrite -> pair -> gate -> score -> record, on a turn table.

    The previous-assistant text is taken before rewriting, the user text after
    (rules are applied to user turns only for the pairing input, the assistant
    side keeps the original text).
    """
    from chatloom.operators.interactions import build_interactions
    from chatloom.operators.rewrite import apply_rules

    t = turns
    if skip_prompt_like:
        t = drop_prompt_like_users(t)
    if rules:
        rewritten = apply_rules(t.withColumn("_orig", F.col("text")), rules, text="text", role="role")
        t = rewritten.withColumn(
            "text", F.when(F.col("role") == "assistant", F.col("_orig")).otherwise(F.col("text"))
        ).drop("_orig")
    pairs = pair_turns(t, with_next=gate)
    if gate:
        pairs = storage_gate(pairs)
    scored = score(pairs, "user_message", True, cfg)
    return build_interactions(
        scored.select(
            F.col("conv_id").cast("string").alias("conversation_id"),
            F.col("ts").alias("timestamp"),
            "user_message",
            "assistant_response",
            "sentiment",
            "weight",
            "is_golden",
            "is_refusal",
        ),
        cfg,
    )

"""Request-level operators: message explosion (S2) and validation flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.functions import content as C

LOCAL_ALIAS = "local-llm"


def explode_messages(requests: DataFrame, keys: Sequence[str] = ("request_id",)) -> DataFrame:
    """One row per message with request key, position, role and normalised content."""
    return requests.select(*keys, F.posexplode("messages").alias("position", "m")).select(
        *keys, "position", F.col("m.role").alias("role"), C.normalize_content(F.col("m.content")).alias("content")
    )


def flag_invalid_requests(requests: DataFrame, configured_model: str) -> DataFrame:
    """Boolean reasons a request is rejected, plus their names in order.

    unknown model, n given (0 counts as not given) and not 1, no user message, temperature outside
    [0, 2], top_p outside [0, 1], max_tokens < 1, penalties outside [-2, 2],
    top_logprobs outside [0, 20].  Missing optional fields never flag.
    """
    allowed = sorted({configured_model, configured_model.split(":", 1)[0], LOCAL_ALIAS})

    def opt(name: str):
        return F.col(name) if name in requests.columns else F.lit(None)

    def outside(name: str, lo: float, hi: float):
        c = opt(name)
        return F.coalesce((c < lo) | (c > hi), F.lit(False))

    flags = {
        "unknown_model": ~F.coalesce(C.normalize_model(F.col("model")).isin(allowed), F.lit(True)),  # none given: the configured one
        "n_not_1": F.coalesce((opt("n") != 0) & (opt("n") != 1), F.lit(False)),  # 0 counts as not given
        "no_user_message": ~F.exists("messages", lambda m: m["role"] == "user"),
        "bad_temperature": outside("temperature", 0.0, 2.0),
        "bad_top_p": outside("top_p", 0.0, 1.0),
        "bad_max_tokens": F.coalesce(opt("max_tokens") < 1, F.lit(False)),
        "bad_presence_penalty": outside("presence_penalty", -2.0, 2.0),
        "bad_frequency_penalty": outside("frequency_penalty", -2.0, 2.0),
        "bad_top_logprobs": outside("top_logprobs", 0.0, 20.0),
    }
    reasons = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in flags.items()]))
    return requests.select("*", *[v.alias(k) for k, v in flags.items()], reasons.alias("reasons"))

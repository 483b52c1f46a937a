"""Feedback scoring as native Column expressions.

Everything here is JVM-side and code-generated: regex matches, CASE chains and
arithmetic.  ``score`` evaluates each regex family once per row in a first
projection and derives sentiment, weight and golden from those counts, so the
regex work is not repeated by the nested CASE expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.config import DEFAULT, Thresholds
from chatloom.functions import lexicon



def lexicon_counts(text: Column) -> dict[str, Column]:
    """Per family, the number of patterns matching the lower-cased text."""
    low = F.lower(text)
    return {
        "strong_pos": lexicon.family_count(low, "strong_pos"),
        "strong_neg": lexicon.family_count(low, "strong_neg"),
        "mod_pos": lexicon.family_count(low, "mod_pos"),
        "mod_neg": lexicon.family_count(low, "mod_neg"),
        "instruction": lexicon.family_count(low, "instruction"),
    }


def char_count(text: Column, ch: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))


def _with_sentiment_steps(df: DataFrame, cfg: Thresholds) -> DataFrame:
    """E2 as one column per step (``_s0`` .. ``_s5``), keeping the reference's
    floating-point order.

    Steps are separate columns (evaluated once in generated code), and each step
    refers to its predecessor as few times as exactness allows: subtracting a
    conditional ``0.0`` or taking ``greatest`` with ``-inf`` is bit-identical to
    skipping the step (no step value can be ``-0.0``).  This keeps the expression
    small even if a later filter on the scores is pushed below these projections
    and the optimizer inlines the step columns into it.
    """
    c = {k: F.col(k) for k in ("_sp", "_sn", "_mp", "_mn", "_in", "_q", "_e", "_len", "_cont")}
    mn, mp = c["_mn"], c["_mp"]
    out = df.withColumn(
        "_s0",
        F.when(mn > mp, F.lit(0.0) - F.lit(0.4) * (mn / (mn + mp + 1)))
        .when(mp > mn, F.lit(0.0) + F.lit(0.4) * (mp / (mn + mp + 1)))
        .otherwise(F.lit(0.0)),
    )
    out = out.withColumn("_s1", F.col("_s0") - F.when((c["_len"] < 10) & c["_cont"], F.lit(0.1)).otherwise(F.lit(0.0)))
    out = out.withColumn("_s2", F.col("_s1") - F.when(c["_q"] > 2, F.lit(0.15)).otherwise(F.lit(0.0)))
    bang = F.lit(0.1) * F.least(c["_e"], F.lit(2))
    out = out.withColumn(
        "_s3",
        F.col("_s2") + F.when(c["_e"] > 0, F.when(F.col("_s2") >= 0, bang).otherwise(-bang)).otherwise(F.lit(0.0)),
    )
    out = out.withColumn("_s4", F.greatest(F.col("_s3"), F.when(c["_in"] > 0, F.lit(0.3)).otherwise(F.lit(float("-inf")))))
    out = out.withColumn("_s5", F.when(c["_cont"] & (F.col("_s4") == 0), F.lit(cfg.continuation)).otherwise(F.col("_s4")))
    return out.withColumn(
        "sentiment",
        F.when(c["_sn"] > 0, F.lit(-0.8) * F.least(c["_sn"] / F.lit(2.0), F.lit(1.0)))
        .when(c["_sp"] > 0, F.lit(0.8) * F.least(c["_sp"] / F.lit(2.0), F.lit(1.0)))
        .otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_s5")))),
    )


def _weight_base(inst, sentiment: Column, cfg: Thresholds) -> Column:
    """E6, first part: instruction boost times (1 + |s| * 0.5)."""
    w = (
        F.when(inst >= 2, F.lit(1.0) * F.lit(cfg.instruction_boost))
        .when(inst == 1, F.lit(1.0) * F.lit(1.3))
        .otherwise(F.lit(1.0))
    )
    return w * (F.lit(1.0) + F.abs(sentiment) * F.lit(0.5))


def _weight_length(w: Column, length) -> Column:
    """E6, second part: length factor (multiplying by 1.0 is exact), then the 5.0 cap."""
    factor = (
        F.when(length > 500, F.lit(2.0))
        .when(length > 200, F.lit(1.5))
        .when(length < 20, F.lit(0.7))
        .otherwise(F.lit(1.0))
    )
    return F.least(w * factor, F.lit(5.0))


def _golden_from(sentiment: Column, weight: Column, length, directive: Column) -> Column:
    """Any of four criteria."""
    return (
        (weight >= 5.0)
        | (sentiment >= 0.7)
        | ((F.abs(sentiment) >= 0.3) & directive)
        | ((sentiment < -0.6) & (length > 300))
    )


def _signals_col() -> Column:
    """E3 over the step columns: names of the signals that fired, in evaluation order."""
    sp, sn, mp, mn, inst = (F.col(k) for k in ("_sp", "_sn", "_mp", "_mn", "_in"))
    n_q, n_e, length, cont = (F.col(k) for k in ("_q", "_e", "_len", "_cont"))
    tail = F.array_compact(
        F.array(
            F.when(mn > mp, F.format_string("moderate_negative(%d)", mn)).when(
                mp > mn, F.format_string("moderate_positive(%d)", mp)
            ),
            F.when((length < 10) & cont, F.lit("very_short")),
            F.when(n_q > 2, F.format_string("many_questions(%d)", n_q)),
            F.when(n_e > 0, F.when(F.col("_s2") >= 0, F.lit("enthusiastic")).otherwise(F.lit("frustrated"))),
            F.when(inst > 0, F.format_string("instruction(%d)", inst)),
            F.when(cont & (F.col("_s4") == 0), F.lit("continuation")),
        )
    )
    return (
        F.when(sn > 0, F.array(F.format_string("strong_negative(%d)", sn)))
        .when(sp > 0, F.array(F.format_string("strong_positive(%d)", sp)))
        .otherwise(tail)
    )


def score(
    df: DataFrame,
    text_col: str = "user_message",
    continuing: Column | bool = True,
    cfg: Thresholds = DEFAULT,
    with_signals: bool = False,
) -> DataFrame:
    """Add ``sentiment``, ``weight`` and ``is_golden`` (E1, E2, E6, E7) for ``text_col``.

    Two narrow projections; no shuffle, no Python.
    """
    cont = continuing if isinstance(continuing, Column) else F.lit(bool(continuing))
    text = F.col(text_col)
    counts = lexicon_counts(text)
    staged = df.select(
        "*",
        counts["strong_pos"].alias("_sp"),
        counts["strong_neg"].alias("_sn"),
        counts["mod_pos"].alias("_mp"),
        counts["mod_neg"].alias("_mn"),
        counts["instruction"].alias("_in"),
        char_count(text, "?").alias("_q"),
        char_count(text, "!").alias("_e"),
        F.length(text).alias("_len"),
        lexicon.directive_hit(F.lower(text)).alias("_dir"),
        cont.alias("_cont"),
    )
    c = {k: F.col(k) for k in ("_in", "_len", "_dir")}
    staged = _with_sentiment_steps(staged, cfg)
    staged = staged.withColumn("_w0", _weight_base(c["_in"], F.col("sentiment"), cfg))
    staged = staged.withColumn("weight", _weight_length(F.col("_w0"), c["_len"]))
    staged = staged.withColumn("is_golden", _golden_from(F.col("sentiment"), F.col("weight"), c["_len"], c["_dir"]))
    if with_signals:
        staged = staged.withColumn("signals", _signals_col())
    return staged.drop("_sp", "_sn", "_mp", "_mn", "_in", "_q", "_e", "_len", "_dir", "_cont",
                       "_s0", "_s1", "_s2", "_s3", "_s4", "_s5", "_w0")


def with_lexicon_counts(df: DataFrame, text_col: str) -> DataFrame:
    """E1 as an operator: five count columns."""
    counts = lexicon_counts(F.col(text_col))
    return df.select("*", *[v.alias(k) for k, v in counts.items()])


def parse_score_reply(reply: Column, status: Column | None = None) -> Column:
    """First number in the trimmed reply clamped to [-1, 1]; none or non-200 -> 0.0."""
    trimmed = F.regexp_replace(F.regexp_replace(reply, r"^\s+", ""), r"\s+$", "")
    raw = F.regexp_extract(trimmed, r"-?[0-9]+\.?[0-9]*", 0)
    val = F.when(raw == "", F.lit(0.0)).otherwise(
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw.try_cast("double")))
    )
    val = F.coalesce(val, F.lit(0.0))
    if status is not None:
        val = F.when(status == 200, val).otherwise(F.lit(0.0))
    return val


def sentiment_flags(sentiment: Column, cfg: Thresholds = DEFAULT) -> dict[str, Column]:
    """Three independent class flags (a row may be in two with asymmetric thresholds)."""
    return {
        "is_positive": sentiment > F.lit(cfg.positive),
        "is_negative": sentiment < F.lit(cfg.negative),
        "is_neutral": F.abs(sentiment) <= F.lit(cfg.neutral_band),
    }


def sentiment_class(sentiment: Column, cfg: Thresholds = DEFAULT) -> Column:
    """Display class used by reports (positive wins, then negative, else neutral)."""
    return (
        F.when(sentiment > F.lit(cfg.positive), F.lit("positive"))
        .when(sentiment < F.lit(cfg.negative), F.lit("negative"))
        .otherwise(F.lit("neutral"))
    )


def golden(text: Column, sentiment: Column, weight: Column) -> Column:
    """E7 on stored values: the golden rule for an existing (text, sentiment, weight)."""
    return _golden_from(sentiment, weight, F.length(text), lexicon.directive_hit(F.lower(text)))

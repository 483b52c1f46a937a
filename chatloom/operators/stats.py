"""Training statistics and decisions.

Statistics are one aggregation pass (``count_if`` / ``max`` with partial,
map-side aggregation); decisions are Column expressions over the statistics
row(s), so a per-model breakdown is just a ``groupBy`` key.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.config import DEFAULT, Thresholds

STATS_COLUMNS = (
    "total", "new", "hours_since_last", "days_since_training", "new_positive", "new_negative",
    "new_neutral", "new_golden", "new_refusal", "new_negative_since_dpo", "new_refusals_since_dpo",
    "days_since_dpo",
)


def _lit_ts(x) -> Column:
    if isinstance(x, str):
        x = dt.datetime.fromisoformat(x)
    return F.lit(x).cast("timestamp_ntz")


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def _elapsed(now, then: Column, unit_seconds: float) -> Column:
    """(now - then).total_seconds() / unit, with the same rounding steps as Python."""
    return ((_micros(_lit_ts(now)) - _micros(then)) / F.lit(1_000_000.0)) / F.lit(float(unit_seconds))


def training_stats(
    df: DataFrame,
    now,
    last_training=None,
    last_dpo=None,
    group: Sequence[str] | None = None,
    cfg: Thresholds = DEFAULT,
) -> DataFrame:
    """A1: one row (or one per group) of training counters.

    New = timestamp > last_training (all rows when never trained); the
    since-DPO counters fall back to the since-training counts when DPO never
    ran.  An empty input gives zeros, hours 0.0 and days 999.0.
    """
    ts = F.col("timestamp")
    s = F.col("sentiment")
    golden = F.coalesce(F.col("is_golden"), F.lit(False))
    refusal = F.coalesce(F.col("is_refusal"), F.lit(False))
    new = (ts > _lit_ts(last_training)) if last_training is not None else F.lit(True)
    pos, neg = s > F.lit(cfg.positive), s < F.lit(cfg.negative)
    neu = F.abs(s) <= F.lit(cfg.neutral_band)
    if last_dpo is not None:
        since_dpo = ts > _lit_ts(last_dpo)
        neg_dpo, ref_dpo = F.count_if(since_dpo & neg), F.count_if(since_dpo & refusal)
    else:
        neg_dpo, ref_dpo = F.count_if(new & neg), F.count_if(new & refusal)
    aggs = [
        F.count(F.lit(1)).alias("total"),
        F.count_if(new).alias("new"),
        F.max(ts).alias("_last"),
        F.count_if(new & pos).alias("new_positive"),
        F.count_if(new & neg).alias("new_negative"),
        F.count_if(new & neu).alias("new_neutral"),
        F.count_if(new & golden).alias("new_golden"),
        F.count_if(new & refusal).alias("new_refusal"),
        neg_dpo.alias("new_negative_since_dpo"),
        ref_dpo.alias("new_refusals_since_dpo"),
    ]
    g = list(group or [])
    raw = df.groupBy(*g).agg(*aggs) if g else df.agg(*aggs)
    empty = F.col("total") == 0
    days_tr = F.lit(999.0) if last_training is None else _elapsed(now, _lit_ts(last_training), 86400)
    days_dpo = F.lit(999.0) if last_dpo is None else _elapsed(now, _lit_ts(last_dpo), 86400)
    return raw.select(
        *g,
        "total",
        "new",
        F.when(empty, F.lit(0.0)).otherwise(_elapsed(now, F.col("_last"), 3600)).alias("hours_since_last"),
        F.when(empty, F.lit(999.0)).otherwise(days_tr).alias("days_since_training"),
        "new_positive", "new_negative", "new_neutral", "new_golden", "new_refusal",
        "new_negative_since_dpo", "new_refusals_since_dpo",
        F.when(empty, F.lit(999.0)).otherwise(days_dpo).alias("days_since_dpo"),
    )


def sentiment_distribution(df: DataFrame, group: Sequence[str] | None = None) -> DataFrame:
    """A2: positive (> 0.3), negative (< -0.3), neutral = total - both."""
    aggs = [
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("sentiment") > 0.3).alias("positive"),
        F.count_if(F.col("sentiment") < -0.3).alias("negative"),
    ]
    g = list(group or [])
    raw = df.groupBy(*g).agg(*aggs) if g else df.agg(*aggs)
    return raw.withColumn("neutral", F.col("total") - F.col("positive") - F.col("negative"))


def overview_columns(size_gb: float, cfg: Thresholds = DEFAULT) -> list[Column | str]:
    """A3's columns over a row with total_interactions and golden_examples."""
    return [
        F.round(F.lit(float(size_gb)), 3).alias("size_gb"),
        F.lit(float(cfg.max_size_gb)).alias("max_size_gb"),
        F.round(F.lit(cfg.max_size_gb * cfg.cleanup_threshold), 3).alias("threshold_size_gb"),
        (F.round(F.lit(size_gb / cfg.max_size_gb * 100), 1) if cfg.max_size_gb > 0 else F.lit(0.0)).alias("usage_percentage"),
        "total_interactions",
        "golden_examples",
        F.lit(True).alias("auto_cleanup_enabled"),
        F.lit(cfg.cleanup_fraction * 100).alias("auto_cleanup_percentage"),
    ]


def store_overview(df: DataFrame, size_gb: float, cfg: Thresholds = DEFAULT) -> DataFrame:
    """A3: size, cleanup threshold, usage, totals and golden count in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("total_interactions"),
        F.count_if(F.coalesce(F.col("is_golden"), F.lit(False))).alias("golden_examples"),
    ).select(*overview_columns(size_gb, cfg))


def _dpo_signals() -> Column:
    return F.col("new_negative_since_dpo") + F.col("new_refusals_since_dpo")


def training_mode(cfg: Thresholds = DEFAULT) -> Column:
    """A5: ``dpo`` when negatives + refusals since DPO reach the mode threshold, else ``sft``."""
    return F.when(_dpo_signals() >= cfg.dpo_mode, F.lit("dpo")).otherwise(F.lit("sft"))


def training_decision(cfg: Thresholds = DEFAULT, user_requested: Column | bool = False) -> Column:
    """A4: struct(should_train, reason, mode) by the trigger priority."""
    req = user_requested if isinstance(user_requested, Column) else F.lit(bool(user_requested))
    pos_total = F.col("new_positive") + F.col("new_golden")
    mode = training_mode(cfg)

    def out(flag: bool, reason: Column, m: Column) -> Column:
        return F.struct(F.lit(flag).alias("should_train"), reason.alias("reason"), m.alias("mode"))

    return (
        F.when(req, out(True, F.lit("user_request"), mode))
        .when(_dpo_signals() >= cfg.dpo_trigger, out(True, F.concat(_dpo_signals().cast("string"), F.lit("_dpo_signals")), F.lit("dpo")))
        .when(pos_total >= cfg.sft_trigger, out(True, F.concat(pos_total.cast("string"), F.lit("_positive_examples")), F.lit("sft")))
        .when(
            (F.col("hours_since_last") >= cfg.inactivity_hours) & (F.col("new") >= cfg.inactivity_min_new),
            out(True, F.lit("inactivity_consolidation"), mode),
        )
        .otherwise(out(False, F.lit("none"), F.lit("none")))
    )


def status_report(stats: DataFrame, cfg: Thresholds = DEFAULT) -> DataFrame:
    """The human-readable status text per stats row; a row that never ran DPO has no DPO lines."""
    sig = _dpo_signals()
    pos_total = F.col("new_positive") + F.col("new_golden")
    ih = cfg.inactivity_hours
    ih_txt = str(int(ih)) if float(ih).is_integer() else str(ih)
    # fixed values: the texts of the report
    lines = [
        F.format_string("Total interactions: %d", F.col("total")),
        F.format_string("New interactions since last training: %d", F.col("new")),
        F.format_string("  └─ Positive: %d, Negative: %d, Neutral: %d, Golden: %d",
                        F.col("new_positive"), F.col("new_negative"), F.col("new_neutral"), F.col("new_golden")),
        F.format_string("Hours since last interaction: %.1f", F.col("hours_since_last")),
        F.format_string("Days since last training: %.1f", F.col("days_since_training")),
    ]
    ran_dpo = F.col("days_since_dpo") != 999.0  # A1's value for never
    lines += [
        F.when(ran_dpo, F.format_string("Days since last DPO training: %.1f", F.col("days_since_dpo"))),
        F.when(ran_dpo, F.format_string("New negatives since DPO: %d", F.col("new_negative_since_dpo"))),
    ]
    lines += [
        F.lit("\nTrigger Status:"),
        F.format_string(
            "%s %d/%d (%d negative + %d refusals)",
            F.when(sig >= cfg.dpo_trigger, F.lit("✓ DPO threshold met:")).otherwise(F.lit("  DPO threshold:")),
            sig, F.lit(cfg.dpo_trigger), F.col("new_negative_since_dpo"), F.col("new_refusals_since_dpo"),
        ),
        F.format_string(
            "%s %d/%d positive/golden",
            F.when(pos_total >= cfg.sft_trigger, F.lit("✓ SFT threshold met:")).otherwise(F.lit("  SFT threshold:")),
            pos_total, F.lit(cfg.sft_trigger),
        ),
        F.when(
            F.col("hours_since_last") >= ih,
            F.format_string("✓ Inactivity threshold met: %.1fh/" + ih_txt + "h", F.col("hours_since_last")),
        ),
    ]
    return stats.select("*", F.array_join(F.array_compact(F.array(*lines)), "\n").alias("status"))


def in_schedule_window(ts: Column, cfg: Thresholds = DEFAULT) -> Column:
    """Is the (UTC) instant within +/- window minutes of the daily local schedule time?

    Circular over midnight (a gap above 12 h counts as 24 h minus the gap).
    Schedule off -> always true.
    """
    if not cfg.schedule_enabled:
        return F.lit(True)
    hh, mm = (int(x) for x in cfg.schedule_time.split(":"))
    local = F.from_utc_timestamp(ts.cast("timestamp"), cfg.schedule_timezone)
    micro_of_minute = F.second(local).cast("bigint") * 1_000_000 + (_micros(local) % 1_000_000)
    secs = (F.hour(local) * 3600 + F.minute(local) * 60).cast("double") + micro_of_minute / F.lit(1_000_000.0)
    diff = F.abs(secs - F.lit(float(hh * 3600 + mm * 60))) / F.lit(60.0)
    diff = F.when(diff > 720, F.lit(1440.0) - diff).otherwise(diff)
    return diff <= F.lit(float(cfg.schedule_window_minutes))


def advance_training_state(runs: DataFrame, group: Sequence[str] | None = None) -> DataFrame:
    """Training state after a run log: last_training, last_dpo (dpo runs only), last_mode."""
    aggs = [
        F.max("ts").alias("last_training"),
        F.max(F.when(F.col("mode") == "dpo", F.col("ts"))).alias("last_dpo"),
        F.max_by("mode", F.struct("ts", "run_id")).alias("last_mode"),
        F.count(F.lit(1)).alias("runs"),
    ]
    g = list(group or [])
    return runs.groupBy(*g).agg(*aggs) if g else runs.agg(*aggs)


def training_stats_from_state(df: DataFrame, state: DataFrame, now, group: Sequence[str], cfg: Thresholds = DEFAULT) -> DataFrame:
    """A1 per group with each group's own training state (e.g. the output of A8).

    ``state`` has the group columns plus ``last_training`` / ``last_dpo`` (either may
    be null: never trained / never DPO-trained).  It holds one row per group, so the
    join is against a table the size of the group count; groups without interactions
    are not reported.
    """
    g = list(group)
    st = state.select(*g, F.col("last_training").alias("_lt"), F.col("last_dpo").alias("_ld"))
    j = df.join(st, g, "left")
    ts, s = F.col("timestamp"), F.col("sentiment")
    golden = F.coalesce(F.col("is_golden"), F.lit(False))
    refusal = F.coalesce(F.col("is_refusal"), F.lit(False))
    new = F.when(F.col("_lt").isNull(), F.lit(True)).otherwise(ts > F.col("_lt"))
    since_dpo = F.when(F.col("_ld").isNull(), new).otherwise(ts > F.col("_ld"))
    pos, neg = s > F.lit(cfg.positive), s < F.lit(cfg.negative)
    neu = F.abs(s) <= F.lit(cfg.neutral_band)
    raw = j.groupBy(*g).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(new).alias("new"),
        F.max(ts).alias("_last"),
        F.max("_lt").alias("_lt"),
        F.max("_ld").alias("_ld"),
        F.count_if(new & pos).alias("new_positive"),
        F.count_if(new & neg).alias("new_negative"),
        F.count_if(new & neu).alias("new_neutral"),
        F.count_if(new & golden).alias("new_golden"),
        F.count_if(new & refusal).alias("new_refusal"),
        F.count_if(since_dpo & neg).alias("new_negative_since_dpo"),
        F.count_if(since_dpo & refusal).alias("new_refusals_since_dpo"),
    )
    days = lambda c: F.when(F.col(c).isNull(), F.lit(999.0)).otherwise(_elapsed(now, F.col(c), 86400))
    return raw.select(
        *g, "total", "new",
        _elapsed(now, F.col("_last"), 3600).alias("hours_since_last"),
        days("_lt").alias("days_since_training"),
        "new_positive", "new_negative", "new_neutral", "new_golden", "new_refusal",
        "new_negative_since_dpo", "new_refusals_since_dpo",
        days("_ld").alias("days_since_dpo"),
    )

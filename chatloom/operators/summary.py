"""Daily partial aggregates of the interaction table, kept by a stream, and A1-A3 from them.

A partial row holds the counters of one day (and group); partials of a day add
up, whatever batch they came from.  Statistics since an instant need the days
after it, which are sums of a few small rows, and of the instant's own day the
rows after it, which is one partition of the stored table.

The summary is partitioned by ``day`` and ``batch``: a replayed micro-batch
replaces what it wrote.  ``refresh_days`` recounts days that an operation of
``operators.store`` has rewritten.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.config import DEFAULT, Thresholds
from chatloom.operators.stats import _elapsed, _lit_ts
from chatloom.operators.store import _Files, read_store

COUNTERS = ("total", "positive", "negative", "neutral", "golden", "refusal")
_FIELDS = ", ".join([*(f"{c} bigint" for c in COUNTERS), "last timestamp_ntz"])


def _counters(cfg: Thresholds) -> list[Column]:
    s, flag = F.col("sentiment"), lambda c: F.coalesce(F.col(c), F.lit(False))
    return [
        F.count(F.lit(1)).alias("total"), F.count_if(s > F.lit(cfg.positive)).alias("positive"), F.count_if(s < F.lit(cfg.negative)).alias("negative"),
        F.count_if(F.abs(s) <= F.lit(cfg.neutral_band)).alias("neutral"), F.count_if(flag("is_golden")).alias("golden"),
        F.count_if(flag("is_refusal")).alias("refusal"), F.max("timestamp").alias("last"),
    ]


def daily_partials(df: DataFrame, group: Sequence[str] = (), cfg: Thresholds = DEFAULT) -> DataFrame:
    """(day, *group, counters, last): one row per day and group; rows without a timestamp have no day."""
    return df.groupBy(F.to_date("timestamp").alias("day"), *group).agg(*_counters(cfg))


def summary_sink(path: str, group: Sequence[str] = (), cfg: Thresholds = DEFAULT) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: appends a micro-batch's partials under its batch id."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = daily_partials(batch, group, cfg).withColumn("batch", F.lit(int(batch_id)).cast("long"))
        rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)

    return sink


def read_summary(spark: SparkSession, path: str, group: Sequence[str] = (), group_types: str = "") -> DataFrame:
    """The partials added up per day and group.  ``group_types``: their columns' DDL, such as ``model_line bigint``."""
    schema = ", ".join(x for x in (group_types, _FIELDS, "day date, batch bigint") if x)
    rows = spark.read.schema(schema).parquet(path)
    return rows.groupBy("day", *group).agg(*[F.sum(c).alias(c) for c in COUNTERS], F.max("last").alias("last"))


def refresh_days(spark: SparkSession, store: str, path: str, days: Iterable[dt.date], group: Sequence[str] = (), cfg: Thresholds = DEFAULT) -> None:
    """Recount the given days from the stored table (partition ``date``); only they are read."""
    days, files, root = sorted(set(days)), _Files(spark, path), path.rstrip("/")
    if not days:
        return
    partials = daily_partials(read_store(spark, store).where(F.col("date").isin(days)), group, cfg).withColumn("batch", F.lit(-1).cast("long"))
    fresh = f"{root}/_refresh"
    partials.coalesce(1).write.mode("overwrite").partitionBy("day", "batch").parquet(fresh)
    for d in days:
        files.delete(f"{root}/day={d}")
        if files.exists(f"{fresh}/day={d}"):
            files.move(f"{fresh}/day={d}", f"{root}/day={d}")
    files.delete(fresh)


def _since(instant, names: dict[str, str], summary: DataFrame, store: DataFrame, group: Sequence[str], cfg: Thresholds) -> DataFrame:
    """Counters of rows after ``instant`` (None: all rows), as partial rows with the columns ``names`` maps to."""
    if instant is None:
        rows = summary
    else:
        at = dt.datetime.fromisoformat(instant) if isinstance(instant, str) else instant
        later = summary.where(F.col("day") > F.lit(at.date()))
        own = store.where((F.col("date") == F.lit(at.date())) & (F.col("timestamp") > _lit_ts(at)))
        rows = later.select(*group, *COUNTERS).unionByName(daily_partials(own, group, cfg).select(*group, *COUNTERS))
    return rows.groupBy(*group).agg(*[F.sum(c).alias(n) for c, n in names.items()])


def training_stats_from_summary(summary: DataFrame, store: DataFrame, now, last_training=None, last_dpo=None,
                                group: Sequence[str] = (), cfg: Thresholds = DEFAULT) -> DataFrame:
    """A1 from the daily summary and the stored table, of which the days of ``last_training`` and ``last_dpo`` are read."""
    g = list(group)
    new = {"total": "new", "positive": "new_positive", "negative": "new_negative", "neutral": "new_neutral", "golden": "new_golden", "refusal": "new_refusal"}
    dpo = {"negative": "new_negative_since_dpo", "refusal": "new_refusals_since_dpo"}
    parts = [
        summary.groupBy(*g).agg(F.sum("total").alias("total"), F.max("last").alias("_last")),
        _since(last_training, new, summary, store, g, cfg),
        _since(last_dpo if last_dpo is not None else last_training, dpo, summary, store, g, cfg),
    ]
    columns = ["total", *new.values(), *dpo.values()]
    spread = [p.select(*g, *[F.col(c) if c in p.columns else F.lit(None).cast("bigint").alias(c) for c in columns],
                       F.col("_last") if "_last" in p.columns else F.lit(None).cast("timestamp_ntz").alias("_last")) for p in parts]
    rows = spread[0].unionByName(spread[1]).unionByName(spread[2])
    merged = rows.groupBy(*g).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns], F.max("_last").alias("_last"))
    empty = F.col("total") == 0
    days = lambda x: F.lit(999.0) if x is None else _elapsed(now, _lit_ts(x), 86400)
    return merged.select(
        *g, "total", "new",
        F.when(empty, F.lit(0.0)).otherwise(_elapsed(now, F.col("_last"), 3600)).alias("hours_since_last"),
        F.when(empty, F.lit(999.0)).otherwise(days(last_training)).alias("days_since_training"),
        "new_positive", "new_negative", "new_neutral", "new_golden", "new_refusal", "new_negative_since_dpo", "new_refusals_since_dpo",
        F.when(empty, F.lit(999.0)).otherwise(days(last_dpo)).alias("days_since_dpo"),
    )


def distribution_from_summary(summary: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """A2 from the daily summary (at the default class bounds)."""
    raw = summary.groupBy(*group).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "positive", "negative")])
    return raw.withColumn("neutral", F.col("total") - F.col("positive") - F.col("negative"))


def overview_from_summary(summary: DataFrame, size_gb: float, cfg: Thresholds = DEFAULT) -> DataFrame:
    """A3 from the daily summary."""
    from chatloom.operators.stats import overview_columns

    return summary.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total_interactions"), F.coalesce(F.sum("golden"), F.lit(0)).alias("golden_examples")).select(
        *overview_columns(size_gb, cfg))

"""The data side of one training run, composed: statistics to exported sets.

A1 -> A4 / A5 -> A7 -> D1 -> (D5, D8, D7) -> D2 / D3 -> D9 -> D10 / D11 -> S7.
Only decisions (one row of statistics, counts) reach the driver; pools, sets and
rejections stay distributed and are read by the steps after them from tables in
the run's folder.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.config import DEFAULT, Thresholds
from chatloom.operators import batchfn as BF
from chatloom.operators import datasets as DS
from chatloom.operators import stats as A
from chatloom.sources.io import export_training_set


@dataclass(frozen=True)
class RunResult:
    """``status``: waiting (no trigger), outside_schedule, no_data, empty_set, or exported."""

    status: str
    reason: str
    mode: str
    pool: int = 0
    prompts: int = 0
    rejections: int = 0
    train: int = 0
    validation: int = 0


def training_run(interactions: DataFrame, folder: str, run_id: str, now, last_training=None, last_dpo=None, requested_mode: str | None = None,
                 cache: str | None = None, generator_factory: Callable[[], BF.Generator] = BF.stand_in_generator, cfg: Thresholds = DEFAULT) -> RunResult:
    """One run over the stored interactions; writes ``<folder>/<run_id>/{set, train, validation}`` if it trains.

    ``requested_mode``: a user's request, ``sft``, ``dpo`` or ``auto`` (mode by A5); it overrides
    the triggers, not the schedule.  A preference run whose rejections all fail falls back to SFT.
    A repeated run id asks the generator for nothing new, and writes the same sets again.
    """
    spark = interactions.sparkSession
    stats = A.training_stats(interactions, now, last_training, last_dpo, cfg=cfg)
    decided = stats.select(A.training_decision(cfg, requested_mode is not None).alias("d"), A.in_schedule_window(A._lit_ts(now), cfg).alias("open")).first()
    reason, mode = decided.d.reason, decided.d.mode
    if not decided.d.should_train:
        return RunResult("waiting", reason, mode)
    if not decided.open:
        return RunResult("outside_schedule", reason, mode)
    if requested_mode in ("sft", "dpo"):
        mode = requested_mode
    base = f"{folder.rstrip('/')}/{run_id}"
    pool, golden = DS.select_training_pool(interactions, cfg)
    pool.withColumn("_from_golden", F.lit(False)).unionByName(golden.withColumn("_from_golden", F.lit(True))).write.mode("overwrite").parquet(f"{base}/pool")
    rows = spark.read.parquet(f"{base}/pool")
    n_pool = rows.count()
    if not n_pool:
        return RunResult("no_data", reason, mode)
    prompts = found = 0
    if mode == "dpo":
        asked = DS.rejection_prompts(rows.where("not _from_golden"), rows.where("_from_golden"), cfg)
        rejections, _ = BF.cached_rejections(asked, cache or f"{folder.rstrip('/')}/rejections", now, run_id, generator_factory, cfg=cfg)
        prompts, found = asked.select("prompt").distinct().count(), rejections.count()
        if not found:
            mode = "sft"
    built = DS.build_dpo(rows, None, rejections.withColumn("seq", F.lit(0).cast("long")), cfg) if mode == "dpo" else DS.build_sft(rows, cfg=cfg)
    built.write.mode("overwrite").parquet(f"{base}/set")
    dataset = spark.read.schema(built.schema).parquet(f"{base}/set")
    if dataset.isEmpty():
        return RunResult("empty_set", reason, mode, n_pool, prompts, found)
    split = DS.with_split(dataset, cfg=cfg)
    formatted = DS.format_dpo if mode == "dpo" else DS.format_sft
    counts = {}
    for part in ("train", "validation"):
        export_training_set(formatted(split.where(F.col("split") == part)), f"{base}/{part}")
        counts[part] = spark.read.text(f"{base}/{part}").count()
    return RunResult("exported", reason, mode, n_pool, prompts, found, counts["train"], counts["validation"])

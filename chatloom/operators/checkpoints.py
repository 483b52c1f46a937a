"""Checkpoint analytics (C1-C7) over a training-run log.

A run log row: run_id, model_line, ts, mode ('sft' | 'dpo'), train_loss,
eval_loss, has_adapter.  One row per finished training run, so a model line's
log grows with the number of training runs, not with interaction volume.

Perplexities are carried at 1e-9 resolution (``floor(x * 1e9 + 0.5) / 1e9``):
``exp``/``log`` differ in the last bit between math libraries, and the 5 %
deploy tolerance is otherwise decided by that bit on decimal ties.
"""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.config import DEFAULT, Thresholds
from chatloom.plans.fsm import Machine, scan

GATE_SCHEMA = (
    "model_line bigint, run_id bigint, ts timestamp_ntz, mode string, perplexity double, "
    "deployed boolean, parent_run bigint"
)


def perplexity_of(eval_loss: Column) -> Column:
    """C1 (SFT part): exp(eval_loss) at 1e-9 resolution; 999.0 when eval_loss >= 100;
    a missing eval_loss reads as 0.0 (perplexity 1.0)."""
    loss = F.coalesce(eval_loss, F.lit(0.0))
    return F.when(loss < 100, F.floor(F.exp(loss) * F.lit(1e9) + F.lit(0.5)) / F.lit(1e9)).otherwise(F.lit(999.0))


def checkpoint_metrics(runs: DataFrame) -> DataFrame:
    """Perplexity / train_loss / eval_loss per run.  DPO runs carry the deployed
    baseline, which needs the gate's state: their perplexity comes from ``deploy_gate``.
    When the log has ``val_samples``, ``training_samples`` is that validation-row count
    (the figure a checkpoint records)."""
    extra = [F.col("val_samples").cast("bigint").alias("training_samples")] if "val_samples" in runs.columns else []
    return runs.select(
        "*",
        F.when(F.col("mode") == "dpo", F.lit(None).cast("double")).otherwise(perplexity_of(F.col("eval_loss"))).alias("sft_perplexity"),
        F.coalesce(F.col("train_loss"), F.lit(0.0)).alias("train_loss_or_0"),
        F.coalesce(F.col("eval_loss"), F.lit(0.0)).alias("eval_loss_or_0"),
        *extra,
    )


class GateMachine(Machine):
    """C2 as an ordered fold: state = (deployed perplexity, deployed run) or None.

    A DPO run always deploys and keeps the perplexity; so the SFT runs alone
    decide which perplexities are deployed, and from a deployed SFT run the next
    is the first whose perplexity is within tolerance of its own: a function of
    that run, whatever came before.

    Segment summary (for a segment entered with an unknown state): an SFT run can
    only be the first to deploy if its perplexity is a strict prefix minimum of
    the segment's SFT perplexities (a "record"); from there the exit follows.
    Consecutive records with the same exit form one group (threshold, exit).  An
    entry baseline p then exits through the first group whose smallest record is
    <= p x tolerance (the very first group when p is below the sanity floor), or
    keeps p (with the last DPO run as current) when no SFT run deploys.
    """

    def __init__(self, min_ppl: float, tolerance: float):
        self.min_ppl = min_ppl
        self.tol = tolerance
        self.initial = None

    def load(self, pdf):
        dpo = (pdf["mode"] == "dpo").to_numpy()
        q = pdf["sft_perplexity"].astype(float).to_numpy()
        sft = np.flatnonzero(~dpo)
        return dpo, pdf["run_id"].to_numpy(), q, sft, q[sft]

    def _next(self, q, i: int, stop: int, p: float | None) -> int:
        """Place of the first SFT run from ``i`` on that deploys over ``p`` (``stop`` if none); looks ahead in growing steps."""
        if p is None or p < self.min_ppl:
            return i
        step, limit = 16, p * self.tol
        while i < stop:
            hit = np.flatnonzero(q[i:min(i + step, stop)] <= limit)
            if len(hit):
                return i + int(hit[0])
            i, step = i + step, step * 4
        return stop

    def _entry_baseline(self, rows, start: int, state):
        """The perplexity that SFT runs from ``start`` on meet: 999 after a DPO run that came before any."""
        return state[0] if state is not None else (999.0 if rows[0][start] else None)

    def _deployed(self, rows, start: int, stop: int, baseline) -> tuple[list[int], int, int]:
        """Places, among the SFT runs, of those deployed from ``baseline`` on; first and last place of the slice."""
        _, _, _, sft, q = rows
        first, last = (int(np.searchsorted(sft, x)) for x in (start, stop))
        places, i, p = [], first, baseline
        while (i := self._next(q, i, last, p)) < last:
            places.append(i)
            p, i = q[i], i + 1
        return places, first, last

    def run(self, rows, start: int, stop: int, state, found=None):
        dpo, run_id, _, sft, q = rows
        baseline = self._entry_baseline(rows, start, state)
        places, _, _ = self._deployed(rows, start, stop, baseline)
        deployed = dpo[start:stop].copy()
        deployed[sft[places] - start] = True
        if found is not None:
            found.append((start, stop, state, baseline, deployed, sft[places], q[places]))
        ends = np.flatnonzero(deployed)
        if not len(ends):
            return state
        return float(q[places[-1]]) if places else float(baseline), int(run_id[start + ends[-1]])

    def emit(self, pdf, found):
        parts = []
        for start, stop, state, baseline, deployed, at, q in found:
            own = pdf[["model_line", "run_id", "ts", "mode"]].iloc[start:stop]
            n = stop - start
            before = np.searchsorted(at, np.arange(start, stop), side="right")  # deployed SFT runs up to each row
            held = np.concatenate([[np.nan if baseline is None else baseline], q])[before]
            dpo = (own["mode"] == "dpo").to_numpy()
            last = np.maximum.accumulate(np.where(deployed, np.arange(n), -1))
            prior = np.concatenate([[-1], last[:-1]])
            ids = own["run_id"].to_numpy()
            parent = pd.array(np.where(prior >= 0, ids[np.maximum(prior, 0)], 0 if state is None else state[1]), dtype="Int64")
            parent[(prior < 0) & (state is None)] = pd.NA
            parts.append(own.assign(perplexity=np.where(dpo, held, pdf["sft_perplexity"].astype(float).to_numpy()[start:stop]),
                                    deployed=deployed, parent_run=parent))
        return pd.concat(parts, ignore_index=True)

    def summary(self, rows, start: int, stop: int):
        dpo, run_id, _, sft, q = rows
        first, last = (int(np.searchsorted(sft, x)) for x in (start, stop))
        own = q[first:last]
        lowest = np.minimum.accumulate(own) if len(own) else own
        records = np.flatnonzero(own < np.concatenate([[np.inf], lowest[:-1]])) if len(own) else []
        last_dpo = np.flatnonzero(dpo[start:stop])
        last_dpo = start + int(last_dpo[-1]) if len(last_dpo) else None
        final: dict[int, int] = {}  # deployed place -> last place that deploys after it
        groups: list = []
        for r in records:
            path, i = [], first + int(r)
            while i < last and i not in final:
                path.append(i)
                i = self._next(q, i + 1, last, q[i])
            end = final[i] if i < last else path[-1]
            final.update(dict.fromkeys(path, end))
            row = int(sft[end])
            exit_ = [float(q[end]), int(run_id[row if last_dpo is None else max(row, last_dpo)])]
            if groups and groups[-1][1] == exit_:
                groups[-1][0] = float(own[r])
            else:
                groups.append([float(own[r]), exit_])
        none = self.run(rows, start, stop, None)
        return {"groups": groups, "none": list(none) if none is not None else None, "last_dpo": int(run_id[last_dpo]) if last_dpo is not None else None}

    def compose(self, first, second):
        groups: list = []
        lowest = first["groups"][-1][0] if first["groups"] else float("inf")
        for low, exit_ in [(low, list(self.resume(second, tuple(exit_)))) for low, exit_ in first["groups"]] + [g for g in second["groups"] if g[0] < lowest]:
            if groups and groups[-1][1] == exit_:
                groups[-1][0] = low
            else:
                groups.append([low, exit_])
        none = self.resume(second, tuple(first["none"]) if first["none"] is not None else None)
        return {"groups": groups, "none": list(none) if none is not None else None,
                "last_dpo": second["last_dpo"] if second["last_dpo"] is not None else first["last_dpo"]}

    def resume(self, summary, entry):
        if entry is None:
            return tuple(summary["none"]) if summary["none"] is not None else None
        p0, c0 = entry
        groups = summary["groups"]
        if groups and p0 < self.min_ppl:
            return tuple(groups[0][1])
        t = p0 * self.tol
        for min_r, ex in groups:
            if min_r <= t:
                return tuple(ex)
        return (p0, summary["last_dpo"] if summary["last_dpo"] is not None else c0)


def deploy_gate(runs: DataFrame, cfg: Thresholds = DEFAULT) -> DataFrame:
    """Per model line in (ts, run_id) order, deploy when nothing is deployed, the
    deployed perplexity is below the sanity floor, or new <= tolerance x deployed.

    Only deployed runs become the next baseline and parent.  Runs as the parallel
    ordered fold of ``plans.fsm.scan`` with ``GateMachine``'s segment summaries, so
    a model line with most of the rows is still spread over all partitions.
    """
    narrow = checkpoint_metrics(runs).select("model_line", "run_id", "ts", "mode", "sft_perplexity")
    return scan(narrow, "model_line", ["ts", "run_id"], GateMachine(cfg.min_perplexity, cfg.perplexity_tolerance), GATE_SCHEMA)


def _newest_first() -> list[Column]:
    return [F.col("ts").desc(), F.col("run_id").desc()]


def current_checkpoints(gated: DataFrame) -> DataFrame:
    """The deployed pointer per model line after a gate run: its last deployed run."""
    return gated.where("deployed").groupBy("model_line").agg(
        F.max_by("run_id", F.struct("ts", "run_id")).alias("current_run")
    )


def checkpoints_to_drop(ckpts: DataFrame, current: DataFrame, keep: int | None = None, cfg: Thresholds = DEFAULT) -> DataFrame:
    """Newest first per model line; the current checkpoint is always kept and not
    counted; everything beyond ``keep`` others is dropped."""
    keep = cfg.max_checkpoints if keep is None else keep
    c = ckpts.join(current, "model_line", "left")
    others = c.where(F.col("current_run").isNull() | (F.col("run_id") != F.col("current_run")))
    w = Window.partitionBy("model_line").orderBy(*_newest_first())
    return others.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") > keep).drop("_rank", "current_run")


def rotate_checkpoints(ckpts: DataFrame, keep: int | None = None, cfg: Thresholds = DEFAULT) -> DataFrame:
    """C4: keep the newest ``keep`` per model line (no exception for the current one); return the rest."""
    keep = cfg.max_checkpoints if keep is None else keep
    w = Window.partitionBy("model_line").orderBy(*_newest_first())
    return ckpts.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") > keep).drop("_rank")


def dangling_checkpoints(ckpts: DataFrame, adapters: DataFrame) -> DataFrame:
    """Checkpoints without an adapter entry (left anti join on run_id)."""
    return ckpts.join(adapters.select("run_id").distinct(), "run_id", "left_anti")


def rollback(ckpts: DataFrame, requests: DataFrame, now) -> DataFrame:
    """Per rollback request (model_line, run_id): the new deployed pointer, or an error row.

    status: ``ok`` when the checkpoint exists and has an adapter, ``not_found`` when
    unknown, ``no_adapter`` when its adapter is missing.
    """
    if isinstance(now, str):
        now = dt.datetime.fromisoformat(now)
    known = ckpts.select("model_line", "run_id", "has_adapter", F.lit(True).alias("_known"))
    r = requests.join(known, ["model_line", "run_id"], "left")
    status = (
        F.when(F.col("_known").isNull(), F.lit("not_found"))
        .when(~F.coalesce(F.col("has_adapter"), F.lit(False)), F.lit("no_adapter"))
        .otherwise(F.lit("ok"))
    )
    ok = status == "ok"
    return r.select(
        "model_line",
        "run_id",
        status.alias("status"),
        F.when(ok, F.col("run_id")).alias("current_run"),
        ok.alias("deployed"),
        F.when(ok, F.lit(now).cast("timestamp_ntz")).alias("deployed_at"),
    )


def training_progress(meta: DataFrame, states: DataFrame, pass_dirs: DataFrame, now, active_seconds: int = 600) -> DataFrame:
    """Progress of the latest run's passes, in pass order.

    ``meta``: (run, pass_dir, timestamp, train_loss, train_samples, val_samples,
    epochs); ``states``: (run, pass_dir, _st = latest checkpoint's trainer state);
    ``pass_dirs``: every pass directory that exists.  The latest run is the one with
    the newest pass timestamp.  Training is active when its last reported pass is
    younger than ``active_seconds``; then, if fewer passes reported than exist, the
    last one is marked incomplete and is the current pass.
    """
    if isinstance(now, str):
        now = dt.datetime.fromisoformat(now)
    latest = meta.groupBy("run").agg(F.max("timestamp").alias("_t")).orderBy(F.col("_t").desc(), F.col("run").desc()).limit(1)
    passes = meta.join(latest.select("run"), "run").join(states, ["run", "pass_dir"], "left")
    total = pass_dirs.join(latest.select("run"), "run").groupBy("run").agg(F.count(F.lit(1)).alias("total_passes"))
    pass_no = F.regexp_extract("pass_dir", r"^pass_([0-9]+)_", 1).try_cast("int")
    layers = F.concat(F.regexp_extract("pass_dir", r"^pass_[0-9]+_[^_]+_([^_]+)_", 1), F.lit("-"),
                      F.regexp_extract("pass_dir", r"^pass_[0-9]+_[^_]+_[^_]+_([^_/]+)", 1))
    p = passes.select(
        "run", pass_no.alias("pass_number"), layers.alias("layers"), "train_loss", "train_samples", "val_samples", "epochs",
        "timestamp", F.col("_st.epoch").alias("epoch"), F.col("_st.global_step").alias("global_step"),
        F.col("_st.max_steps").alias("max_steps"), F.col("_st._last.eval_loss").alias("eval_loss"),
        F.col("_st._last.eval_runtime").alias("eval_runtime"),
    ).join(total, "run", "left")
    w = Window.partitionBy("run")
    last_ts = F.max_by("timestamp", "pass_number").over(w)
    reported = F.count(F.lit(1)).over(w)
    age = (F.unix_micros(F.lit(now).cast("timestamp_ntz").cast("timestamp"))
           - F.unix_micros(F.to_timestamp(F.regexp_replace(last_ts, "Z$", "")).cast("timestamp"))) / F.lit(1_000_000.0)
    active = age < active_seconds
    partial = active & (reported < F.col("total_passes"))
    is_last = F.col("pass_number") == F.max("pass_number").over(w)
    return p.select(
        F.col("run").alias("checkpoint_id"), "*",
        active.alias("training_active"),
        F.when(partial, reported).otherwise(F.col("total_passes")).alias("current_pass"),
        (~(partial & is_last)).alias("completed"),
    ).drop("run").orderBy("pass_number")

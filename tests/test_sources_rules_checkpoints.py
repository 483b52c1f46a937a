"""File sources, rule compilation and the checkpoint gate on hand-made inputs."""

import json
import math
import os

import pandas as pd
from pyspark.sql import functions as F

from chatloom.config import DEFAULT
from chatloom.operators import checkpoints as CK
from chatloom.operators import rewrite as R
from chatloom.sources import io as IO


def test_read_checkpoints_newest_first_skips_bad(spark, tmp_path):
    d = tmp_path / "ckpts"
    d.mkdir()
    (d / "checkpoint_a_metadata.json").write_text(json.dumps(
        {"checkpoint_id": "checkpoint_a", "adapter_path": "/x/a", "timestamp": "2024-01-01T10:00:00",
         "metrics": {"perplexity": 3.1}, "training_samples": 5, "deployed": True}, indent=2))
    (d / "checkpoint_b_metadata.json").write_text(json.dumps(
        {"checkpoint_id": "checkpoint_b", "adapter_path": "/x/b", "timestamp": "2024-01-02T10:00:00",
         "metrics": {"perplexity": 2.9, "train_loss": 0.4}, "parent_checkpoint": "checkpoint_a"}, indent=2))
    (d / "checkpoint_c_metadata.json").write_text("{not json")
    (d / "current_checkpoint.json").write_text(json.dumps({"checkpoint_id": "checkpoint_b"}))
    rows = IO.read_checkpoints(spark, str(d)).collect()
    assert [r.checkpoint_id for r in rows] == ["checkpoint_b", "checkpoint_a"]
    assert rows[0].metrics["perplexity"] == 2.9


def test_read_training_history(spark, tmp_path):
    root = tmp_path / "runs"
    a = root / "checkpoint_A"
    a.mkdir(parents=True)
    (a / "training_metadata.json").write_text(json.dumps(
        {"timestamp": "2024-01-01T00:00:00", "train_loss": 1.0, "eval_loss": 1.2, "train_samples": 90, "val_samples": 10, "epochs": 3}))
    b = root / "checkpoint_B"
    for name, ts in (("pass_1_layers_0_4", "2024-01-02T00:00:00"), ("pass_2_layers_5_9", "2024-01-03T00:00:00")):
        p = b / name
        p.mkdir(parents=True)
        (p / "training_metadata.json").write_text(json.dumps({"timestamp": ts, "train_loss": 0.9, "eval_loss": 1.1}))
        for k, loss in ((2, 5.0), (10, 0.7)):
            c = p / f"checkpoint-{k}"
            c.mkdir()
            (c / "trainer_state.json").write_text(json.dumps(
                {"global_step": k, "log_history": [{"loss": 1.0, "step": 1}, {"eval_loss": loss, "eval_runtime": 1.5, "step": k}]}))
    (b / "training_metadata.json").write_text(json.dumps({"timestamp": "2023-12-31T00:00:00", "train_loss": 9.9}))
    (root / "broken").mkdir()
    (root / "broken" / "training_metadata.json").write_text("{bad")
    rows = IO.read_training_history(spark, str(root)).collect()
    names = [r.checkpoint_name for r in rows]
    assert names == ["checkpoint_A", "checkpoint_B - Pass 1 (Layers 0-4)", "checkpoint_B - Pass 2 (Layers 5-9)"]
    assert rows[1].eval_loss == 0.7 and rows[1].global_step == 10 and rows[1].eval_runtime == 1.5
    assert rows[0].eval_loss == 1.2 and rows[0].global_step is None


def test_scan_training_logs(spark):
    lines = [f"noise line {i}" for i in range(60)]
    lines[3] = "2024-05-01 12:00:00 CPU TRAINING MODE ENABLED"
    lines[5] = "PASS 1/4: Training layers 0-4"
    lines[7] = "Epoch 2/3"
    lines[9] = "PASS 2/4: Training layers 5-9"
    lines[55] = "  loss 0.5  "
    lines[58] = "Merging adapter complete"
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "log_id int, line_no int, line string")
    r = IO.scan_training_logs(df).first()
    assert (r.training_mode, r.current_pass, r.total_passes, r.current_layers) == ("CPU", 1, 4, "0-4")
    assert (r.current_epoch, r.total_epochs, r.last_log_time) == (2, 3, "2024-05-01 12:00:00")
    assert r.logs == ["loss 0.5", "Merging adapter complete"]


RULES = [
    {"id": "g", "pattern": r"(\w+)@(\w+)", "replacement": r"\2 at \g<1>", "target_roles": ["user"], "priority": 10},
    {"id": "d", "pattern": "cost", "replacement": "$5 cost", "target_roles": ["all"], "priority": 10},
    {"id": "off", "pattern": "a", "replacement": "b", "enabled": False},
    {"id": "bad", "pattern": "(oops", "replacement": "x", "priority": 1},
    {"id": "sys", "pattern": "secret", "replacement": "[hidden]"},
    {"id": "chain", "pattern": "example at", "replacement": "EX", "target_roles": ["user"], "priority": 50},
]


def test_compile_rules_order_and_filters():
    compiled = R.compile_rules(RULES)
    assert [r.id for r in compiled] == ["g", "d", "chain", "sys"]
    assert compiled[0].replacement == "$2 at $1"
    assert compiled[1].replacement == "\\$5 cost"
    assert compiled[3].roles == ("system",)


def test_apply_rules_roles_and_chaining(spark):
    df = spark.createDataFrame(
        [("user", "mail me: bob@example about cost"), ("system", "the secret cost"), ("assistant", "bob@example"), ("user", None)],
        "role string, text string",
    )
    out = [r.text for r in R.apply_rules(df, RULES).collect()]
    assert out == ["mail me: EX bob about $5 cost", "the [hidden] $5 cost", "bob@example", None]
    _, summary = R.rule_match_report(df, RULES)
    got = {r.rule_id: r.rows_changed for r in summary.collect()}
    assert got == {"g": 2, "d": 2, "chain": 2, "sys": 1}  # test mode ignores roles


def test_deploy_gate_hand_case(spark):
    ln = math.log
    rows = [
        (1, 0, "2024-01-01", "sft", ln(3.0)),
        (2, 0, "2024-01-02", "sft", ln(3.2)),
        (3, 0, "2024-01-03", "dpo", 0.3),
        (4, 0, "2024-01-04", "sft", ln(3.1)),
        (5, 0, "2024-01-05", "sft", None),
        (6, 0, "2024-01-06", "sft", ln(4.0)),
        (7, 0, "2024-01-07", "sft", 150.0),
        (8, 1, "2024-01-01", "dpo", 0.2),
        (9, 1, "2024-01-02", "sft", ln(2.5)),
    ]
    df = spark.createDataFrame(rows, "run_id long, model_line long, d string, mode string, eval_loss double").select(
        "run_id", "model_line", F.to_timestamp("d").cast("timestamp_ntz").alias("ts"), "mode", "eval_loss",
        F.lit(0.0).alias("train_loss"), F.lit(True).alias("has_adapter"))
    got = {r.run_id: r for r in CK.deploy_gate(df).collect()}
    assert [got[i].deployed for i in range(1, 10)] == [True, False, True, True, True, True, False, True, True]
    assert [got[i].parent_run for i in range(1, 10)] == [None, 1, 1, 3, 4, 5, 6, None, 8]
    assert got[3].perplexity == 3.0 and got[5].perplexity == 1.0 and got[7].perplexity == 999.0
    assert got[8].perplexity == 999.0
    cur = {r.model_line: r.current_run for r in CK.current_checkpoints(CK.deploy_gate(df)).collect()}
    assert cur == {0: 6, 1: 9}


def test_retention(spark):
    rows = [(i, 0, f"2024-01-{i:02d}") for i in range(1, 8)]
    df = spark.createDataFrame(rows, "run_id long, model_line long, d string").select(
        "run_id", "model_line", F.to_timestamp("d").cast("timestamp_ntz").alias("ts"))
    cur = spark.createDataFrame([(0, 2)], "model_line long, current_run long")
    assert sorted(r.run_id for r in CK.checkpoints_to_drop(df, cur, 3).collect()) == [1, 3, 4]
    assert sorted(r.run_id for r in CK.rotate_checkpoints(df, 3).collect()) == [1, 2, 3, 4]


def test_request_log_round_trip(spark, sf_small, tmp_path):
    from chatloom import fixtures as fx
    from chatloom.operators.requests import explode_messages

    req = fx.fx_requests(spark, sf_small)
    path = str(tmp_path / "log")
    IO.write_request_log(req, path)
    with open(os.path.join(path, "part-99999-broken.txt"), "w") as fh:
        fh.write("{broken line\n")
    back = IO.read_requests(spark, path)
    bad = back.where(F.col("_corrupt_record").isNotNull()).select("request_id", "_corrupt_record").collect()
    assert len(bad) == 1 and bad[0].request_id is None
    a = explode_messages(back.where(F.col("_corrupt_record").isNull()))
    b = explode_messages(req)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_training_progress(spark, tmp_path):
    root = tmp_path / "ckpts"
    run = root / "checkpoint_20240105"
    for i, (name, ts) in enumerate((("pass_1_layers_0_4", "2024-01-05T10:00:00"), ("pass_2_layers_5_9", "2024-01-05T10:55:00")), 1):
        p = run / name
        (p / "checkpoint-3").mkdir(parents=True)
        (p / "training_metadata.json").write_text(json.dumps({"timestamp": ts, "train_loss": 0.5 * i, "epochs": 3}))
        (p / "checkpoint-3" / "trainer_state.json").write_text(json.dumps(
            {"epoch": 1.0 * i, "global_step": 3 * i, "max_steps": 9, "log_history": [{"eval_loss": 0.4 * i, "eval_runtime": 2.0}]}))
    (run / "pass_3_layers_10_14").mkdir()
    (run / "pass_3_layers_10_14" / "train.log").write_text("started")
    old = root / "checkpoint_20231201" / "pass_1_layers_0_4"
    old.mkdir(parents=True)
    (old / "training_metadata.json").write_text(json.dumps({"timestamp": "2023-12-01T00:00:00", "train_loss": 2.0}))
    meta, states, dirs = IO.read_pass_tree(spark, str(root))
    rows = CK.training_progress(meta, states, dirs, "2024-01-05T11:00:00").collect()
    assert [r.pass_number for r in rows] == [1, 2]
    assert all(r.checkpoint_id == "checkpoint_20240105" for r in rows)
    assert rows[0].training_active and rows[0].current_pass == 2 and rows[0].total_passes == 3
    assert [r.completed for r in rows] == [True, False]
    assert rows[1].eval_loss == 0.8 and rows[1].global_step == 6 and rows[1].layers == "5-9"
    later = CK.training_progress(meta, states, dirs, "2024-01-05T12:00:00").collect()
    assert not later[0].training_active and later[0].current_pass == 3 and all(r.completed for r in later)


def _gate_fold(min_ppl: float, tolerance: float):
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "run_id"], kind="mergesort")
        cur_p = None
        cur_id = None
        out_p, out_dep, out_par = [], [], []
        for mode, q_sft, rid in zip(pdf["mode"].to_numpy(), pdf["sft_perplexity"].to_numpy(), pdf["run_id"].to_numpy()):
            q = (999.0 if cur_p is None else cur_p) if mode == "dpo" else float(q_sft)
            deploy = cur_p is None or cur_p < min_ppl or q <= cur_p * tolerance
            out_p.append(q)
            out_dep.append(bool(deploy))
            out_par.append(cur_id)
            if deploy:
                cur_p, cur_id = q, int(rid)
        return pd.DataFrame(
            {
                "model_line": pdf["model_line"].to_numpy(),
                "run_id": pdf["run_id"].to_numpy(),
                "ts": pdf["ts"].to_numpy(),
                "mode": pdf["mode"].to_numpy(),
                "perplexity": out_p,
                "deployed": out_dep,
                "parent_run": pd.array(out_par, dtype="Int64"),
            }
        )

    return fold


def deploy_gate_grouped(runs, cfg=DEFAULT):
    """C2 reference form: one sequential fold per model line (``applyInPandas``)."""
    narrow = CK.checkpoint_metrics(runs).select("model_line", "run_id", "ts", "mode", "sft_perplexity")
    return narrow.groupBy("model_line").applyInPandas(_gate_fold(cfg.min_perplexity, cfg.perplexity_tolerance), CK.GATE_SCHEMA)


def test_parallel_gate_equals_sequential_fold_under_skew(spark):
    import random

    rnd = random.Random(11)
    rows = []
    rid = 0
    for line, n in ((0, 4000), (1, 300), (2, 50)):
        for i in range(n):
            rid += 1
            mode = "dpo" if rnd.random() < 0.2 else "sft"
            # drifting perplexities with resets below the floor and occasional huge losses
            loss = None if rnd.random() < 0.02 else (150.0 if rnd.random() < 0.01 else math.log(1.5 + rnd.random() * 3.0 - i * 1e-4))
            rows.append((rid, line, i, mode, loss))
    df = spark.createDataFrame(rows, "run_id long, model_line long, i long, mode string, eval_loss double").select(
        "run_id", "model_line", F.timestamp_seconds(F.col("i") * 60).cast("timestamp_ntz").alias("ts"), "mode", "eval_loss",
        F.lit(0.0).alias("train_loss"), F.lit(True).alias("has_adapter")).repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        par = CK.deploy_gate(df)
        seq = deploy_gate_grouped(df)
        assert par.count() == seq.count() == len(rows)
        assert par.exceptAll(seq).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_checkpoint_metrics_training_samples(spark):
    df = spark.createDataFrame([(1, "sft", 0.0, None, 12), (2, "dpo", 0.1, 0.2, 7), (3, "sft", 150.0, 1.0, None)],
                               "run_id long, mode string, eval_loss double, train_loss double, val_samples int")
    got = {r.run_id: r for r in CK.checkpoint_metrics(df).collect()}
    assert (got[1].sft_perplexity, got[1].train_loss_or_0, got[1].training_samples) == (1.0, 0.0, 12)
    assert got[2].sft_perplexity is None and got[3].sft_perplexity == 999.0 and got[3].training_samples is None


def _some_runs(root):
    for i in range(30):
        c = root / f"run_{i}" / "checkpoint-2"
        c.mkdir(parents=True)
        (c.parent / "training_metadata.json").write_text(json.dumps({"timestamp": f"2024-01-{i + 1:02d}T00:00:00", "eval_loss": 2.0}))
        (c / "trainer_state.json").write_bytes(json.dumps({"global_step": i, "log_history": [{"eval_loss": 0.5}]}).encode("utf-8-sig" if i % 2 else "utf-16-le"))
    (root / "run_3/training_metadata.json").write_text(json.dumps([{"timestamp": "x", "train_loss": 1.0}, {"timestamp": "y"}]))
    (root / "run_4/training_metadata.json").write_bytes(b'{"timestamp": "\xff\xfe"}')
    (root / "run_5/training_metadata.json").write_text('{"timestamp": "z", "train_loss": "not a number"}')
    (root / "run_6/training_metadata.json").write_text(" ")
    (root / "_temporary/run_x").mkdir(parents=True)
    (root / "_temporary/training_metadata.json").write_text('{"timestamp": "hidden"}')
    (root / "training_metadata.json").write_text('{"timestamp": "in no run"}')


def test_run_trees_are_listed_by_tasks(spark, tmp_path):
    """Neither the status of a file nor a list of files goes through the driver."""
    _some_runs(tmp_path)
    history = IO.read_training_history(spark, f"file://{tmp_path}")
    meta, states, dirs = IO.read_pass_tree(spark, str(tmp_path))
    for df in (history, meta, states, dirs):
        plan = df._jdf.queryExecution().toString()
        assert not df.inputFiles() and "FileScan" not in plan and "FileIndex" not in plan
    rows = {r.checkpoint_name: r for r in history.where("checkpoint_name <> 'run_3'").collect()}
    assert sorted(rows) == sorted(f"run_{i}" for i in range(30) if i not in (3, 4, 5, 6))
    assert all(r.eval_loss == 0.5 and r.global_step == int(k[4:]) for k, r in rows.items())
    assert [r.timestamp for r in history.where("checkpoint_name = 'run_3'").collect()] == ["x", "y"]


def test_run_trees_in_a_store_that_only_spark_opens(spark, tmp_path):
    _some_runs(tmp_path)
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.runs.link./in", f"file://{tmp_path}")
    far = IO.read_training_history(spark, "viewfs://runs/in")
    assert far.exceptAll(IO.read_training_history(spark, str(tmp_path))).count() == 0 and far.count() == 28

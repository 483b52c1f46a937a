"""One composed run: decision, pool, rejections, set, split and exported files against the steps done by hand."""

import datetime as dt
import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from chatloom import fixtures as fx
from chatloom.config import DEFAULT
from chatloom.operators import datasets as DS
from chatloom.operators.training_run import training_run

NOW = dt.datetime(2024, 2, 1, 6, 30)
SMALL = replace(DEFAULT, top_n=300)


@pytest.fixture(scope="module")
def inter(spark, sf_small):
    return fx.fx_interactions(spark, sf_small).cache()


def lines(path):
    return [json.loads(x) for f in sorted(path.glob("*.json")) for x in f.read_text().split("\n") if x]


def test_preference_run(spark, inter, tmp_path):
    result = training_run(inter, str(tmp_path), "r1", NOW, cfg=SMALL)
    pool, golden = DS.select_training_pool(inter, SMALL)
    assert (result.status, result.mode) == ("exported", "dpo") and result.reason.endswith("_dpo_signals")
    assert result.pool == pool.count() + golden.count() == 300
    prompts = DS.rejection_prompts(pool, golden, SMALL)
    assert result.prompts == result.rejections == prompts.select("prompt").distinct().count() > 0
    replies = prompts.select("prompt").distinct().select(
        "prompt", F.lit(0).alias("seq"), F.rtrim(F.concat(F.lit("I would rather not go into that: "), "prompt")).alias("rejection"))
    whole = DS.build_dpo(pool, golden, replies, SMALL)
    parts = dict(zip(("train", "validation"), DS.split_train_val(whole, cfg=SMALL)))
    for name, rows in parts.items():
        want = sorted((r.prompt, r.chosen, r.rejected) for r in DS.format_dpo(rows).collect())
        assert sorted((x["prompt"], x["chosen"], x["rejected"]) for x in lines(tmp_path / "r1" / name)) == want
        assert getattr(result, name) == len(want) > 0
    assert training_run(inter, str(tmp_path), "r1", NOW, cfg=SMALL) == result


def test_fallback_requests_schedule_and_nothing_to_do(spark, inter, tmp_path):
    failing = training_run(inter, str(tmp_path), "f", NOW, cfg=SMALL, generator_factory=lambda: lambda prompts: [(500, None, None)] * len(prompts))
    assert (failing.status, failing.mode, failing.rejections) == ("exported", "sft", 0) and failing.prompts > 0
    pool, golden = DS.select_training_pool(inter, SMALL)
    chosen = DS.build_sft(pool, golden, SMALL).where("chosen is not null").count()
    assert failing.train + failing.validation == chosen and lines(tmp_path / "f" / "train")[0].keys() == {"prompt", "completion", "weight"}
    asked = training_run(inter, str(tmp_path), "u", NOW, last_training=NOW, last_dpo=NOW, requested_mode="sft", cfg=SMALL)
    assert (asked.status, asked.reason, asked.mode) == ("exported", "user_request", "sft")
    late = replace(SMALL, schedule_enabled=True)  # 01:00 in New York is 06:00 here
    assert training_run(inter, str(tmp_path), "s1", NOW, cfg=late).status == "exported"
    assert training_run(inter, str(tmp_path), "s2", NOW + dt.timedelta(hours=4), cfg=late).status == "outside_schedule"
    assert training_run(inter, str(tmp_path), "w", NOW, last_training=NOW, last_dpo=NOW, cfg=SMALL).status == "waiting"
    assert training_run(inter.limit(0), str(tmp_path), "n", NOW, requested_mode="auto", cfg=SMALL).status == "no_data"
    flat = inter.limit(5).withColumns({"sentiment": F.lit(-0.9), "is_golden": F.lit(False), "is_refusal": F.lit(False)})
    one = training_run(flat, str(tmp_path), "e", NOW, requested_mode="sft", cfg=SMALL)
    assert (one.status, one.train + one.validation) == ("exported", 0)  # rejected texts only: samples, but none with a completion

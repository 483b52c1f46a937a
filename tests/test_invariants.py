"""Invariants of the interaction-table and training-set operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chatloom import fixtures as fx
from chatloom.operators import datasets as DS
from chatloom.operators import interactions as I


def test_prunes_partition_the_input_and_keep_golden(spark, sf_mid):
    df = fx.fx_interactions(spark, sf_mid)
    n = df.count()
    golden = df.where("is_golden").count()
    for kept, deleted in (
        I.prune_by_age(df, dt.datetime(2024, 2, 1), 20),
        I.prune_by_weight(df, 0.5),
        I.prune_lowest(df, 0.1),
    ):
        assert kept.count() + deleted.count() == n
        assert kept.where("is_golden").count() == golden
        assert deleted.where("is_golden").count() == 0
        assert kept.join(deleted, "id", "inner").count() == 0


def test_prune_lowest_deletes_exactly_k_lowest(spark, sf_mid):
    df = fx.fx_interactions(spark, sf_mid)
    cand = df.where(~F.col("is_golden"))
    k = int(cand.count() * 0.1)
    _kept, deleted = I.prune_lowest(df, 0.1)
    assert deleted.count() == k
    max_deleted = deleted.agg(F.max("weight")).first()[0]
    assert max_deleted <= _kept.where(~F.col("is_golden")).agg(F.min("weight")).first()[0]


def test_prune_lowest_zero_is_noop(spark, sf_small):
    df = fx.fx_interactions(spark, sf_small)
    kept, deleted = I.prune_lowest(df, 0.0)
    assert kept.count() == df.count() and deleted.count() == 0


def test_split_is_a_partition(spark, sf_mid):
    pool, golden = DS.select_training_pool(fx.fx_interactions(spark, sf_mid))
    ds = DS.build_sft(pool, golden)
    n = ds.count()
    train, val = DS.split_train_val(ds, 0.1, seed=7)
    assert train.count() == int(n * 0.9)
    assert train.count() + val.count() == n
    assert train.join(val, "sample_id").count() == 0
    assert train.unionByName(val).exceptAll(ds).count() == 0


def test_pool_size_and_golden(spark, sf_small):
    df = fx.fx_interactions(spark, sf_small)
    pool, golden = DS.select_training_pool(df)
    g = golden.count()
    assert pool.count() == min(max(0, 1000 - g), df.where(~F.col("is_golden")).count())
    assert pool.where("is_golden").count() == 0


def test_updates_only_supplied_fields(spark):
    base = spark.createDataFrame(
        [("a", 0.5, 1.0, False), ("b", -0.5, 2.0, True)], "id string, sentiment double, weight double, is_golden boolean"
    )
    upd = spark.createDataFrame([("a", None, 3.0, None), ("zz", 1.0, 1.0, True)], "id string, sentiment double, weight double, is_golden boolean")
    got = {r.id: r for r in I.apply_updates(base, upd).collect()}
    assert (got["a"].sentiment, got["a"].weight, got["a"].is_golden) == (0.5, 3.0, False)
    assert (got["b"].sentiment, got["b"].weight, got["b"].is_golden) == (-0.5, 2.0, True)
    assert set(got) == {"a", "b"}


def test_repeated_update_ids_need_a_sequence(spark):
    base = spark.createDataFrame([("a", 0.5, 1.0, False)], "id string, sentiment double, weight double, is_golden boolean")
    twice = spark.createDataFrame([("a", 3.0, 2), ("a", 4.0, 1)], "id string, weight double, seq int")
    assert I.apply_updates(base, twice).first().weight == 3.0
    with pytest.raises(Exception, match="repeat an id"):
        I.apply_updates(base, twice.drop("seq")).collect()


def test_truncation(spark):
    long = "x" * 60001
    df = spark.createDataFrame(
        [("c", dt.datetime(2024, 1, 1), long, "ok", 0.1, 1.0, False, False)],
        "conversation_id string, timestamp timestamp_ntz, user_message string, assistant_response string, "
        "sentiment double, weight double, is_golden boolean, is_refusal boolean",
    )
    r = I.build_interactions(df).first()
    assert r.truncated and r.user_message_length == 60001
    assert r.user_message == "x" * 60000 + "...[TRUNCATED]"
    assert r.id == "c_1704067200000000"


def test_partition_pruning_on_stored_table(spark, sf_small, tmp_path):
    from chatloom.sources import io as IO

    path = str(tmp_path / "store")
    IO.write_interactions(fx.fx_interactions(spark, sf_small), path)
    stored = spark.read.parquet(path)
    since = I.interactions_since(stored, dt.datetime(2024, 1, 25))
    plan = since._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "date#" in plan
    want = fx.fx_interactions(spark, sf_small).where(F.col("timestamp") > dt.datetime(2024, 1, 25)).count()
    assert since.count() == want
    kept, deleted = I.prune_by_age(stored, dt.datetime(2024, 2, 1), 20)
    assert kept.count() + deleted.count() == stored.count()


def test_stats_from_per_line_state(spark):
    from chatloom.operators import stats as A

    ts = lambda d, h=0: dt.datetime(2024, 1, d, h)
    inter = spark.createDataFrame(
        [("a", 0, ts(1), -0.8, False, True), ("b", 0, ts(5), 0.8, True, False), ("c", 0, ts(9), -0.5, False, False),
         ("d", 1, ts(2), 0.4, False, False), ("e", 1, ts(8), -0.9, False, True)],
        "id string, model_line long, timestamp timestamp_ntz, sentiment double, is_golden boolean, is_refusal boolean",
    )
    state = spark.createDataFrame(
        [(0, ts(3), ts(7)), (1, None, None)], "model_line long, last_training timestamp_ntz, last_dpo timestamp_ntz"
    )
    got = {r.model_line: r for r in A.training_stats_from_state(inter, state, dt.datetime(2024, 1, 10), ["model_line"]).collect()}
    r0, r1 = got[0], got[1]
    assert (r0.total, r0.new, r0.new_positive, r0.new_negative, r0.new_golden) == (3, 2, 1, 1, 1)
    assert (r0.new_negative_since_dpo, r0.new_refusals_since_dpo) == (1, 0)
    assert r0.days_since_training == 7.0 and r0.days_since_dpo == 3.0 and r0.hours_since_last == 24.0
    assert (r1.total, r1.new, r1.new_negative_since_dpo, r1.new_refusals_since_dpo) == (2, 2, 1, 1)
    assert r1.days_since_training == 999.0 and r1.days_since_dpo == 999.0

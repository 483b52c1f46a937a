"""Skew-safe ordered helpers: exact on data where one key holds most rows."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chatloom.plans.fsm import Machine, OrderedFold, scan
from chatloom.plans import ordering
from chatloom.plans.ordering import SEG, before_boundary, carry_many, global_index, kth_boundary, range_segments


def _skewed_turns(spark, n_hot=3000, n_cold=200, seed=7):
    rnd = random.Random(seed)
    rows = []
    for t in range(n_hot):  # one conversation with most rows
        rows.append((0, t, rnd.choice(["user", "assistant", "assistant", "system"]), f"h{t}"))
    for c in range(1, n_cold):
        for t in range(rnd.randint(1, 6)):
            rows.append((c, t, rnd.choice(["user", "assistant"]), f"c{c}-{t}"))
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)


def test_carry_matches_windows_under_skew(spark):
    df = _skewed_turns(spark)
    specs = [(F.when(F.col("role") == "assistant", F.col("text")), "prev_asst", "last"),
             (F.col("text"), "next_text", "first")]
    outs = [carry_many(df, "conv_id", ["turn"], specs, num_partitions=n) for n in (1, 5)]
    w_prev = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    w_next = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(1, Window.unboundedFollowing)
    want = df.select(
        "*",
        F.last(F.when(F.col("role") == "assistant", F.col("text")), True).over(w_prev).alias("prev_asst"),
        F.first("text", True).over(w_next).alias("next_text"),
    )
    for out in outs:
        assert out.count() == df.count()
        assert out.exceptAll(want.select(*out.columns)).count() == 0


def test_range_segments_split_the_hot_key(spark):
    seg = range_segments(_skewed_turns(spark), [F.col("conv_id"), F.col("turn")], 5)
    assert seg.where("conv_id = 0").select(SEG).distinct().count() >= 4


def test_carry_keeps_rows_of_the_null_key(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), (1, 1, "c"), (1, 2, "d")], "k long, o long, v string")
    out = carry_many(df, "k", ["o"], [(F.col("v"), "prev", "last")], num_partitions=3)
    assert sorted((str(r.k), r.o, r.v, r.prev) for r in out.collect()) == [
        ("1", 1, "c", None), ("1", 2, "d", "c"), ("None", 1, "a", None), ("None", 2, "b", "a")]


def test_boundary_row_at_every_position(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    for k in (0, 1, 499, 999):
        b = kth_boundary(df, [F.col("x")], lambda n, k=k: k)
        assert df.where(before_boundary([F.col("x")], b)).count() == k
    assert kth_boundary(df, [F.col("x")], lambda n: n) is None
    assert kth_boundary(df.limit(0), [F.col("x")], lambda n: 0) is None


def test_boundary_by_refinement_with_ties_nulls_and_times(spark, monkeypatch):
    monkeypatch.setattr(ordering, "SELECT_ROWS", 20)
    monkeypatch.setattr(ordering, "OVERSAMPLE", 2)
    # (segments of a few rows, so that every position is found by several divisions)
    rnd = random.Random(6)
    start = dt.datetime(2024, 1, 1)
    rows = [(rnd.choice([None, 1.0, 1.0, 1.0, 2.5, -0.5, float(rnd.randint(0, 400))]), start + dt.timedelta(seconds=rnd.randint(0, 9000)), f"é{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "w double, t timestamp_ntz, id string").repartition(5)
    order = [F.col("w"), F.col("t"), F.col("id")]
    for k in (0, 7, 1500, 2998, 2999):
        b = kth_boundary(df, order, lambda n, k=k: k)
        assert df.where(before_boundary(order, b)).count() == k
    same = spark.createDataFrame([(1.0,)] * 500 + [(2.0,)] * 3, "w double").repartition(3)
    for k, below in ((0, 0), (499, 0), (500, 500), (502, 500)):
        b = kth_boundary(same, [F.col("w")], lambda n, k=k: k)
        assert same.where(before_boundary([F.col("w")], b)).count() == below


def test_carry_moves_the_rows_once_and_stitches_crossing_keys_only(spark):
    df = _skewed_turns(spark)
    out = carry_many(df, "conv_id", ["turn"], [(F.when(F.col("role") == "assistant", F.col("text")), "prev", "last")], num_partitions=6)
    plan = out._jdf.queryExecution().executedPlan().toString()
    wide = [line for line in plan.split("\n") if "shufflepartitionidpassthrough" in line.lower()]
    assert len(wide) == 1 and "RDDScan" not in plan.replace("ExistingRDD", "")
    spread = out.where("conv_id = 0").select(F.spark_partition_id()).distinct().count()
    assert spread >= 4  # the hot conversation is several tasks' work


def test_global_index_is_exact(spark):
    df = _skewed_turns(spark)
    got = global_index(df, [F.col("conv_id"), F.col("turn")], "pos")
    want = df.select("*", (F.row_number().over(Window.orderBy("conv_id", "turn")) - 1).alias("pos"))
    assert got.exceptAll(want).count() == 0
    assert sorted(r.pos for r in got.select("pos").collect()) == list(range(df.count()))


def step(state, role):
    """The fold that ``Counter`` computes, a row at a time: emit every third 'user' row."""
    state += role == "user"
    return (0, True) if state >= 3 else (state, False)


class Counter(Machine):
    """Emit every time the running count of 'user' rows reaches 3, then reset."""

    n_states = 3
    initial = 0
    stride = 5

    def load(self, pdf):
        return np.cumsum([0, *pdf["role"].eq("user")])

    def run(self, rows, start, stop, state, found=None):
        since = rows[start] - state
        while (at := np.searchsorted(rows[start:stop + 1], since + 3) + start) <= stop:
            if found is not None:
                found.append(at - 1)
            since = rows[at]
        return int(rows[stop] - since)

    def emit(self, pdf, found):
        return pdf[["conv_id", "turn"]].iloc[found]


def folded(rows):
    want, ends, states = [], {}, {}
    for key, turn, role in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1])):
        states[key], hit = step(states.get(key, 0), role)
        want += [(key, turn)] if hit else []
    return sorted(want, key=str), states


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_fsm_scan_equals_sequential_fold(spark, batch):
    df = _skewed_turns(spark)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)  # summaries of a segment's batches compose
    try:
        fold = OrderedFold(df.select("conv_id", "turn", "role"), "conv_id", ["turn"], Counter())
        got = sorted((tuple(r) for r in fold.emitted("conv_id long, turn long").collect()), key=str)
        exits = {r.conv_id: r.state for r in fold.exits().collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want, states = folded([(r.conv_id, r.turn, r.role) for r in df.collect()])
    assert got == want and len(want) > 100
    assert exits == states


def test_fsm_scan_in_two_parts_goes_on_from_the_exit_states(spark):
    df = _skewed_turns(spark).select("conv_id", "turn", "role")
    first, second = df.where("turn % 1000 < 400 and turn < 400 or conv_id > 100"), df.where("not (turn % 1000 < 400 and turn < 400 or conv_id > 100)")
    whole = OrderedFold(df, "conv_id", ["turn"], Counter())
    one = OrderedFold(first, "conv_id", ["turn"], Counter())
    entries = one.exits().withColumnRenamed("state", "entry")
    two = OrderedFold(second.join(entries, "conv_id", "left"), "conv_id", ["turn"], Counter(), ["conv_id", "turn", "role"], F.col("entry"))
    schema = "conv_id long, turn long"
    parts = one.emitted(schema).unionByName(two.emitted(schema))
    assert parts.exceptAll(whole.emitted(schema)).count() == 0 and parts.count() == whole.emitted(schema).count()


def test_fsm_scan_over_segments_null_keys_and_moved_partitions(spark):
    # one key spans several segments, and half of the keys are null
    rows = [(None if i % 2 else 7, i) for i in range(400)]
    df = spark.createDataFrame([(k, t, "user") for k, t in rows], "conv_id long, turn long, role string").repartition(3)
    out = scan(df, "conv_id", ["turn"], Counter(), "conv_id long, turn long")
    want = []
    for key in (7, None):
        state = 0
        for k, t in rows:
            if k == key:
                state, emitted = step(state, "user")
                want += [(k, t)] if emitted else []
    order = lambda rs: sorted(rs, key=str)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    plain = [tuple(r) for r in out.collect()]
    assert order(plain) == order(want) and {k for k, _ in plain} == {7, None}
    assert order(tuple(r) for r in out.coalesce(1).collect()) == order(want)
    shifted = spark.createDataFrame([(0, 0)] * 5, "conv_id long, turn long").repartition(5).unionByName(out)
    assert order(tuple(r) for r in shifted.where("conv_id is null or conv_id <> 0").collect()) == order(want)


def test_cluster_without_a_shared_folder_is_an_error():
    import types

    from chatloom.session import checkpoint_dir

    context = types.SimpleNamespace(master="spark://host:7077", getConf=lambda: {}, getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError):
        checkpoint_dir(types.SimpleNamespace(sparkContext=context))

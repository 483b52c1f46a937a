"""Operations on the stored table rewrite the partitions they touch, once per run id, and recover from a crash at any step."""

import datetime as dt
import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from chatloom.config import DEFAULT
from chatloom.operators import interactions as I
from chatloom.operators import store as ST
from chatloom.sources import io as IO

SCHEMA = "id string, timestamp timestamp_ntz, user_message string, sentiment double, weight double, is_golden boolean"


@pytest.fixture
def store(spark, tmp_path):
    rows = [(f"{d}-{i}", dt.datetime(2024, 1, 1 + d, i), f"m{i}", 0.1 * i, float(d + 1), i == 3) for d in range(6) for i in range(5)]
    rows += [("none-0", None, "m", 0.0, 0.5, False), ("none-1", None, "m", 0.0, None, True)]
    path = str(tmp_path / "store")
    df = spark.createDataFrame(rows, SCHEMA)
    IO.write_interactions(df, path)
    return path, df


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names
            if f.endswith(".parquet") and "/_" not in d.removeprefix(path)}


def days(before, after):
    """Partitions in which a file was added, changed or removed."""
    return {os.path.basename(os.path.dirname(f)).split("=")[1] for f in {*before.items()} ^ {*after.items()} for f in [f[0]]}


def same(spark, path, want):
    got = ST.read_store(spark, path).drop("date").select(want.columns)
    return got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_updates_rewrite_only_the_days_of_their_ids(spark, store):
    path, df = store
    updates = spark.createDataFrame([("1-2", -0.9, None, None), ("4-0", None, 9.0, True), ("none-0", 0.5, None, None), ("absent", 1.0, 1.0, True)],
                                    "id string, sentiment double, weight double, is_golden boolean")
    before = files(path)
    ST.store_updates(spark, path, "u1", updates)
    after = files(path)
    assert days(before, after) == {"2024-01-02", "2024-01-05", "__HIVE_DEFAULT_PARTITION__"}
    assert same(spark, path, I.apply_updates(df, updates))
    ST.store_updates(spark, path, "u1", spark.createDataFrame([("0-0", 1.0)], "id string, sentiment double"))
    assert files(path) == after  # the run is done, whatever it is called with


def test_toggling_once_per_run(spark, store):
    path, df = store
    for run in ("t1", "t1", "t2", "t3", "t3"):
        ST.store_toggles(spark, path, run, ["0-1", "5-3"])
    assert same(spark, path, I.toggle_golden(df, ["0-1", "5-3"]))


def test_deletions_and_prunes(spark, store, tmp_path):
    path, df = store
    before = files(path)
    ST.store_deletions(spark, path, "d1", [f"2-{i}" for i in range(5)])  # a day without rows afterwards
    assert days(before, files(path)) == {"2024-01-03"} and not os.path.exists(f"{path}/date=2024-01-03")
    rest = I.delete_ids(df, [f"2-{i}" for i in range(5)])
    assert same(spark, path, rest)
    before = files(path)
    ST.store_prune_by_age(spark, path, "a1", dt.datetime(2024, 1, 10), 8)
    rest = I.prune_by_age(rest, dt.datetime(2024, 1, 10), 8)[0]
    assert days(before, files(path)) == {"2024-01-01"} and same(spark, path, rest)
    before = files(path)
    ST.store_prune_by_weight(spark, path, "w1", 2.5)
    rest = I.prune_by_weight(rest, 2.5)[0]
    assert days(before, files(path)) == {"2024-01-02", "__HIVE_DEFAULT_PARTITION__"} and same(spark, path, rest)
    before = files(path)
    ST.store_prune_lowest(spark, path, "l1", 0.25)
    rest = I.prune_lowest(rest, 0.25)[0]
    assert days(before, files(path)) == {"2024-01-04"} and same(spark, path, rest)
    assert not ST.store_prune_if_oversize(spark, path, "o1") and same(spark, path, rest)
    small = replace(DEFAULT, max_size_gb=I.dataset_size_gb(spark, path))
    assert ST.store_prune_if_oversize(spark, path, "o2", small) and same(spark, path, I.prune_lowest(rest, DEFAULT.cleanup_fraction)[0])


def test_golden_review(spark, store):
    path, df = store
    before = files(path)
    ST.store_golden_review(spark, path, "g1")
    want = I.reevaluate_golden(df)
    lost = {str(r.d) for r in want.where("golden_removed").select(F.to_date("timestamp").alias("d")).collect()}
    assert {d.replace("__HIVE_DEFAULT_PARTITION__", "None") for d in days(before, files(path))} == lost and lost
    assert same(spark, path, want.drop("golden_removed"))


@pytest.mark.parametrize("step", ["delete", "move", "mark"])
@pytest.mark.parametrize("at", [1, 2, 3])
def test_a_crash_while_partitions_are_swapped(spark, store, monkeypatch, step, at):
    path, df = store
    ids = [f"{d}-{i}" for d in (1, 2) for i in range(5)] + ["3-1", "4-1", "none-0"]
    calls = []
    plain = getattr(ST._Files, step)

    def failing(self, *args):
        calls.append(args)
        if len(calls) == at:
            raise OSError("executor gone")
        return plain(self, *args)

    monkeypatch.setattr(ST._Files, step, failing)
    crashed = False
    try:
        ST.store_deletions(spark, path, "c1", ids)
    except OSError:
        crashed = True
    assert crashed or step == "mark" and at > 1
    monkeypatch.setattr(ST._Files, step, plain)
    ST.store_deletions(spark, path, "c1", ids)
    assert same(spark, path, I.delete_ids(df, ids))
    assert not os.path.exists(f"{path}/date=2024-01-02")


def test_only_touched_partitions_are_read_for_the_rewrite(spark, store):
    path, _ = store
    df = ST.read_store(spark, path)
    plan = I.delete_ids(df, ["1-1"]).where(F.col("date").isin([dt.date(2024, 1, 2)]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "2024-01-02" in plan.split("PartitionFilters: [")[1].split("]")[0]

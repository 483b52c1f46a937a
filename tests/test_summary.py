"""A1-A3 from daily partials equal the full pass; the cache of rejections asks the generator once."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chatloom import fixtures as fx
from chatloom.operators import batchfn as BF
from chatloom.operators import stats as A
from chatloom.operators import store as ST
from chatloom.operators import summary as SU
from chatloom.sources import io as IO

NOW = dt.datetime(2024, 2, 1)
GROUP, TYPES = ["model_line"], "model_line bigint"


def equal(a, b):
    return a.select(b.columns).exceptAll(b).count() == 0 and b.exceptAll(a.select(b.columns)).count() == 0


@pytest.fixture
def kept(spark, sf_small, tmp_path):
    """Stored interactions with null times and flags, and their summary from three batches, one of them replayed."""
    df = fx.fx_interactions(spark, sf_small).withColumn("timestamp", F.when(F.col("id") % 50 != 0, F.col("timestamp"))).withColumn(
        "is_golden", F.when(F.col("id") % 3 != 0, F.col("is_golden")))
    store, path = str(tmp_path / "store"), str(tmp_path / "summary")
    IO.write_interactions(df, store)
    sink = SU.summary_sink(path, GROUP)
    for i in (0, 1, 1, 2):
        sink(df.where(F.col("id") % 3 == i), i)
    return df, store, path


@pytest.mark.parametrize("training, dpo", [(dt.datetime(2024, 1, 20, 7, 30), dt.datetime(2024, 1, 9, 23, 59, 59)), ("2024-01-15T00:00:00", None), (None, None), (dt.datetime(2030, 1, 1), None)])
@pytest.mark.parametrize("group", [[], GROUP])
def test_stats_equal_the_full_pass(spark, kept, training, dpo, group):
    df, store, path = kept
    summary = SU.read_summary(spark, path, GROUP, TYPES)
    got = SU.training_stats_from_summary(summary, ST.read_store(spark, store), NOW, training, dpo, group)
    assert equal(got, A.training_stats(df, NOW, training, dpo, group or None))


def test_distribution_and_overview(spark, kept):
    df, _, path = kept
    summary = SU.read_summary(spark, path, GROUP, TYPES)
    assert equal(SU.distribution_from_summary(summary, GROUP), A.sentiment_distribution(df, GROUP))
    assert equal(SU.overview_from_summary(summary, 1.5), A.store_overview(df, 1.5))
    assert equal(SU.overview_from_summary(summary.limit(0), 1.5), A.store_overview(df.limit(0), 1.5))


def test_only_the_boundary_days_of_the_store_are_read(spark, kept):
    _, store, path = kept
    out = SU.training_stats_from_summary(SU.read_summary(spark, path, GROUP, TYPES), ST.read_store(spark, store), NOW, dt.datetime(2024, 1, 20, 5), dt.datetime(2024, 1, 9, 5))
    plan = out._jdf.queryExecution().executedPlan().toString()
    days = {part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:] if "date" in part.split("]")[0]}
    assert len(days) == 2 and {d for d in ("2024-01-20", "2024-01-09") for x in days if d in x} == {"2024-01-20", "2024-01-09"}


def test_refreshed_days_follow_the_store(spark, kept):
    df, store, path = kept
    gone = [r.id for r in df.where("to_date(timestamp) in ('2024-01-03', '2024-01-20')").collect()]
    ST.store_deletions(spark, store, "d", gone[1:])
    SU.refresh_days(spark, store, path, [dt.date(2024, 1, 3), dt.date(2024, 1, 20)], GROUP)
    SU.refresh_days(spark, store, path, [], GROUP)
    left = df.where(~F.col("id").isin(gone[1:]))
    summary = SU.read_summary(spark, path, GROUP, TYPES)
    assert equal(SU.distribution_from_summary(summary), A.sentiment_distribution(left))
    got = SU.training_stats_from_summary(summary, ST.read_store(spark, store), NOW, dt.datetime(2024, 1, 20, 1), None)
    assert equal(got, A.training_stats(left, NOW, dt.datetime(2024, 1, 20, 1), None))


def test_a_second_run_asks_the_generator_for_nothing(spark, tmp_path):
    path, log = str(tmp_path / "cache"), tmp_path / "asked"
    log.mkdir()

    def factory(folder=str(log)):
        def gen(prompts):
            import uuid

            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(prompts))
            return [(500 if p == "fails" else 200, f'"a rejected answer to {p}"', None) for p in prompts]

        return gen

    def asked():
        found = sorted(p for f in log.iterdir() for p in f.read_text().split("\n") if p)
        for f in log.iterdir():
            f.write_text("")
        return found

    prompts = spark.createDataFrame([("old",), ("new",), ("stale",), ("new",), (None,), ("fails",)], "prompt string").repartition(2)
    cache = [("old", 1, "first kept answer", NOW - dt.timedelta(hours=5)), ("old", 2, "later kept answer", NOW - dt.timedelta(hours=1)),
             ("stale", 1, "an answer of long ago", NOW - dt.timedelta(hours=7)), ("unasked", 1, "kept but not wanted", NOW)]
    spark.createDataFrame(cache, "prompt string, seq bigint, rejection string, cached_at timestamp_ntz").write.parquet(f"{path}/run=earlier")
    got, report = BF.cached_rejections(prompts, path, NOW, "r1", factory)
    want = {"old": "later kept answer", "new": "a rejected answer to new", "stale": "a rejected answer to stale"}
    assert {r.prompt: r.rejection for r in got.collect()} == want and asked() == ["fails", "new", "stale"]
    assert tuple(report.first())[:2] == (3, 2)
    assert asked() == []
    again, report = BF.cached_rejections(prompts, path, NOW, "r2", factory)
    assert {r.prompt: r.rejection for r in again.collect()} == want and asked() == ["fails"]  # only what failed is asked again
    repeated, _ = BF.cached_rejections(prompts, path, NOW, "r1", factory)  # a finished run keeps what it has
    assert {r.prompt: r.rejection for r in repeated.collect()} == want and asked() == ["fails"]
    (tmp_path / "cache" / "run=r1" / "_SUCCESS").unlink()  # a run that crashed while it wrote
    anew, _ = BF.cached_rejections(prompts, path, NOW, "r1", factory)
    assert {r.prompt: r.rejection for r in anew.collect()} == want and asked() == ["fails", "new", "stale"]
    fine = prompts.where("prompt <> 'fails'")
    assert {r.prompt: r.rejection for r in BF.cached_rejections(fine, path, "2024-02-01T05:00:00", "r3", factory)[0].collect()} == want and asked() == []
    empty, _ = BF.cached_rejections(fine, str(tmp_path / "none"), NOW, "r1", factory)
    assert empty.count() == 3

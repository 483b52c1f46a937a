"""Maintenance of the stored interaction table (I6, I7, I8, I9-I13 written back).

The table is Parquet partitioned by ``date``.  An operation reads what it needs,
computes the new rows of the partitions it touches, and replaces those
partitions only; the files of all others stay as they are.

Every operation has a run id.  New rows and the list of touched partitions are
staged under ``_staging/<run id>`` first; then partitions are swapped by
renaming folders, and ``_runs/<run id>`` marks the end.  A run that is repeated
after a crash goes on where it stopped: an unfinished staging is done anew, a
finished one is swapped in without looking at the half-replaced table again,
and a marked run does nothing.  While a partition is swapped, a reader may miss
it for a moment; one writer at a time is assumed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.config import DEFAULT, Thresholds
from chatloom.operators import interactions as I

PARTITION = "date"
_NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


class _Files:
    """The few file operations of a swap, on whatever file system holds the table."""

    def __init__(self, spark: SparkSession, root: str):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def make(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def move(self, source: str, target: str) -> None:
        if not self._fs.rename(self._path(source), self._path(target)):
            raise OSError(f"cannot move {source} to {target}")

    def mark(self, path: str) -> None:
        self._fs.mkdirs(self._path(path).getParent())
        self._fs.create(self._path(path), True).close()


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The stored table with its ``date`` column (of date type also where every timestamp is null)."""
    df = spark.read.parquet(path)
    return df if dict(df.dtypes)[PARTITION] == "date" else df.withColumn(PARTITION, F.col(PARTITION).cast("date"))


def write_back(spark: SparkSession, path: str, run_id: str, result: DataFrame | None, touched: DataFrame | None) -> None:
    """Replace the partitions in ``touched`` (a ``date`` column) by the rows that ``result``, the whole new table, has for them.

    The filter on the touched dates reaches the scan of ``result``, so other
    partitions are not read for it.  One row per touched partition reaches the
    driver.
    """
    root = path.rstrip("/")
    files, staging, done = _Files(spark, root), f"{root}/_staging/{run_id}", f"{root}/_runs/{run_id}"
    if files.exists(done):
        return
    if not files.exists(f"{staging}/list/_SUCCESS"):
        days = sorted((r[PARTITION] for r in touched.select(PARTITION).distinct().collect()), key=str)
        chosen = F.col(PARTITION).isin([d for d in days if d is not None]) | (F.col(PARTITION).isNull() if None in days else F.lit(False))
        result.where(chosen).write.mode("overwrite").partitionBy(PARTITION).parquet(f"{staging}/rows")
        names = [f"{PARTITION}={_NULL_PARTITION if d is None else d}" for d in days]
        listed = [(n, files.exists(f"{staging}/rows/{n}")) for n in names]
        spark.createDataFrame(listed, "name string, filled boolean").coalesce(1).write.mode("overwrite").parquet(f"{staging}/list")
    for name, filled in sorted(map(tuple, spark.read.schema("name string, filled boolean").parquet(f"{staging}/list").collect())):
        source, target = f"{staging}/rows/{name}", f"{root}/{name}"
        if files.exists(source):
            files.delete(target)
            files.move(source, target)
        elif not filled:  # the operation left no row
            files.delete(target)
    files.mark(done)
    files.delete(staging)
    spark.catalog.refreshByPath(root)


def _changed(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Partitions that hold one of the ids (two columns are read)."""
    return df.select("id", PARTITION).join(ids.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi")


def _pending(spark: SparkSession, path: str, run_id: str) -> bool:
    """Whether the run still has to be computed; a staged or finished one must not look at the table again."""
    files, root = _Files(spark, path), path.rstrip("/")
    if files.exists(f"{root}/_runs/{run_id}"):
        return False
    if files.exists(f"{root}/_staging/{run_id}/list/_SUCCESS"):
        write_back(spark, path, run_id, None, None)
        return False
    return True


def store_updates(spark: SparkSession, path: str, run_id: str, updates: DataFrame) -> None:
    """I6 on the stored table."""
    if _pending(spark, path, run_id):
        df = read_store(spark, path)
        write_back(spark, path, run_id, I.apply_updates(df, updates), _changed(df, updates))


def store_toggles(spark: SparkSession, path: str, run_id: str, ids) -> None:
    """I7 on the stored table: applied once per run id."""
    if _pending(spark, path, run_id):
        df = read_store(spark, path)
        write_back(spark, path, run_id, I.toggle_golden(df, ids), _changed(df, I._id_frame(spark, ids)))


def store_golden_review(spark: SparkSession, path: str, run_id: str, cfg: Thresholds = DEFAULT) -> None:
    """I8 on the stored table: only partitions with a golden row that fails are written."""
    if _pending(spark, path, run_id):
        reviewed = I.reevaluate_golden(read_store(spark, path), cfg)
        write_back(spark, path, run_id, reviewed.drop("golden_removed"), reviewed.where("golden_removed"))


def store_deletions(spark: SparkSession, path: str, run_id: str, ids) -> None:
    """I9 on the stored table."""
    if _pending(spark, path, run_id):
        df = read_store(spark, path)
        write_back(spark, path, run_id, I.delete_ids(df, ids), _changed(df, I._id_frame(spark, ids)))


def _store_prune(spark: SparkSession, path: str, run_id: str, prune) -> None:
    if _pending(spark, path, run_id):
        kept, deleted = prune(read_store(spark, path))
        write_back(spark, path, run_id, kept, deleted)


def store_prune_by_age(spark: SparkSession, path: str, run_id: str, now, days: int | None = None, cfg: Thresholds = DEFAULT) -> None:
    """I10 on the stored table."""
    _store_prune(spark, path, run_id, lambda df: I.prune_by_age(df, now, days, cfg))


def store_prune_by_weight(spark: SparkSession, path: str, run_id: str, threshold: float | None = None, cfg: Thresholds = DEFAULT) -> None:
    """I11 on the stored table."""
    _store_prune(spark, path, run_id, lambda df: I.prune_by_weight(df, threshold, cfg))


def store_prune_lowest(spark: SparkSession, path: str, run_id: str, fraction: float | None = None, cfg: Thresholds = DEFAULT) -> None:
    """I12 on the stored table: the boundary is that of the whole table, the rewrite that of the partitions below it."""
    _store_prune(spark, path, run_id, lambda df: I.prune_lowest(df, fraction, cfg))


def store_prune_if_oversize(spark: SparkSession, path: str, run_id: str, cfg: Thresholds = DEFAULT) -> bool:
    """I13 on the stored table; whether it was over the limit."""
    if not _pending(spark, path, run_id):
        return True
    if I.dataset_size_gb(spark, path) < cfg.max_size_gb * cfg.cleanup_threshold:
        return False
    _store_prune(spark, path, run_id, lambda df: I.prune_lowest(df, cfg.cleanup_fraction, cfg))
    return True

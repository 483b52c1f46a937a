"""Operators on the interaction fact table.

The table has one row per stored interaction: id, conversation_id, timestamp,
user_message, assistant_response, their original lengths, sentiment, weight,
is_golden, is_refusal, truncated.  Every operator is a DataFrame -> DataFrame
transformation; deletions return the kept rows (and the deleted rows where a
caller needs them) instead of mutating anything.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.config import DEFAULT, Thresholds
from chatloom.functions.scoring import golden as golden_rule
from chatloom.plans.ordering import before_boundary, kth_boundary

TRUNC_MARK = "...[TRUNCATED]"


def _ts(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        x = dt.datetime.fromisoformat(x)
    return F.lit(x).cast("timestamp_ntz")


def _weight(df_col: str = "weight") -> Column:
    return F.coalesce(F.col(df_col), F.lit(1.0))


def build_interactions(pairs: DataFrame, cfg: Thresholds = DEFAULT) -> DataFrame:
    """Scored pairs -> interaction rows.

    id = conversation_id + '_' + epoch microseconds of the timestamp; lengths
    are taken before truncation; each side longer than the limit is cut and
    marked; ``document`` is the text the embedder reads.
    """
    n = cfg.truncate_at
    um, ar = F.col("user_message"), F.col("assistant_response")

    def cut(c: Column) -> Column:
        return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(TRUNC_MARK))).otherwise(c)

    micros = F.unix_micros(F.col("timestamp").cast("timestamp"))
    return pairs.select(
        F.concat(F.col("conversation_id"), F.lit("_"), micros.cast("string")).alias("id"),
        "conversation_id",
        "timestamp",
        cut(um).alias("user_message"),
        cut(ar).alias("assistant_response"),
        F.length(um).alias("user_message_length"),
        F.length(ar).alias("assistant_response_length"),
        "sentiment",
        "weight",
        "is_golden",
        F.coalesce(F.col("is_refusal"), F.lit(False)).alias("is_refusal"),
        ((F.length(um) > n) | (F.length(ar) > n)).alias("truncated"),
        F.concat(F.lit("User: "), um, F.lit("\nAssistant: "), ar).alias("document"),
    )


def _date_floor(df: DataFrame, ts_lower: Column) -> Column:
    """Partition predicate implied by ``timestamp >= ts_lower`` on a table stored by
    ``write_interactions`` (partitioned by ``date``); true when there is no such column."""
    if "date" in df.columns:
        return F.col("date") >= F.to_date(ts_lower)
    return F.lit(True)


def interactions_since(df: DataFrame, since=None, limit: int | None = None) -> DataFrame:
    """Rows with timestamp > since, ascending; ``limit`` keeps the latest N.

    On a date-partitioned store the implied ``date`` bound prunes partitions."""
    out = df if since is None else df.where(_date_floor(df, _ts(since)) & (F.col("timestamp") > _ts(since)))
    if limit:
        out = out.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(int(limit))
    return out.orderBy("timestamp", "id")


def top_by_weight(df: DataFrame, n: int, exclude_golden: bool = True) -> DataFrame:
    """The n highest weights; ties in ingest order (timestamp, id). A TakeOrdered top-k."""
    src = df.where(~F.coalesce(F.col("is_golden"), F.lit(False))) if exclude_golden else df
    return src.orderBy(_weight().desc(), F.col("timestamp").asc(), F.col("id").asc()).limit(max(0, int(n)))


def golden_examples(df: DataFrame) -> DataFrame:
    """I4: all golden rows (a filter; never a second copy)."""
    return df.where(F.coalesce(F.col("is_golden"), F.lit(False)))


def _id_frame(spark: SparkSession, ids) -> DataFrame:
    if isinstance(ids, DataFrame):
        return ids.select(F.col(ids.columns[0]).cast("string").alias("id")).distinct()
    return spark.createDataFrame([(str(i),) for i in ids], "id string")


def lookup(df: DataFrame, ids) -> DataFrame:
    """Full records for the given ids (semi join; AQE broadcasts a small id side)."""
    return df.join(_id_frame(df.sparkSession, ids), "id", "left_semi")


def apply_updates(df: DataFrame, updates: DataFrame) -> DataFrame:
    """Overwrite sentiment / weight / is_golden only where the update supplies a value.

    ``updates`` has ``id`` and any of ``sentiment``, ``weight``, ``is_golden``
    (null = not supplied); other columns are ignored.  When an id repeats, the
    value with the highest ``seq`` wins if the updates carry a ``seq`` column;
    without one, a repeated id is an error.
    """
    fields = [c for c in ("sentiment", "weight", "is_golden") if c in updates.columns]
    has_seq = "seq" in updates.columns
    u = updates.select(
        F.col("id").cast("string").alias("id"), *[F.col(c).alias(f"_u_{c}") for c in fields],
        (F.col("seq") if has_seq else F.lit(0)).alias("_seq"),
    )

    def pick(c: str) -> Column:
        v = F.col(f"_u_{c}")
        if has_seq:
            return F.max_by(v, F.when(v.isNotNull(), F.col("_seq"))).alias(f"_u_{c}")
        repeated = F.raise_error(F.lit("updates repeat an id; give them a seq column"))
        return F.when(F.count(F.lit(1)) > 1, repeated).otherwise(F.max(v)).alias(f"_u_{c}")

    # Partial aggregation: one row per id and task before the shuffle.
    u = u.groupBy("id").agg(*[pick(c) for c in fields])
    joined = df.join(u, "id", "left")
    for c in fields:
        joined = joined.withColumn(c, F.coalesce(F.col(f"_u_{c}"), F.col(c)))
    return joined.drop(*[f"_u_{c}" for c in fields]).select(*df.columns)


def toggle_golden(df: DataFrame, ids) -> DataFrame:
    """Flip the golden flag of the given ids."""
    marks = _id_frame(df.sparkSession, ids).withColumn("_flip", F.lit(True))
    return (
        df.join(marks, "id", "left")
        .withColumn(
            "is_golden",
            F.when(F.col("_flip"), ~F.coalesce(F.col("is_golden"), F.lit(False))).otherwise(F.col("is_golden")),
        )
        .select(*df.columns)
    )


def reevaluate_golden(df: DataFrame, cfg: Thresholds = DEFAULT) -> DataFrame:
    """I8: re-run the golden rule on stored values for golden rows; failures are cleared.

    Never adds goldens.  Adds ``golden_removed`` for the report.
    """
    still = golden_rule(F.coalesce(F.col("user_message"), F.lit("")), F.coalesce(F.col("sentiment"), F.lit(0.0)), _weight())
    was = F.coalesce(F.col("is_golden"), F.lit(False))
    return df.withColumn("golden_removed", was & ~still).withColumn("is_golden", was & still)


def golden_reevaluation_report(reevaluated: DataFrame) -> DataFrame:
    """I8 report: total golden before, removed, kept (one pass)."""
    return reevaluated.agg(
        F.count_if(F.col("is_golden") | F.col("golden_removed")).alias("total_golden"),
        F.count_if(F.col("golden_removed")).alias("removed"),
        F.count_if(F.col("is_golden")).alias("kept"),
    )


def delete_ids(df: DataFrame, ids) -> DataFrame:
    """Remove rows by id (golden rows too)."""
    return df.join(_id_frame(df.sparkSession, ids), "id", "left_anti")


def prune_by_age(df: DataFrame, now, days: int | None = None, cfg: Thresholds = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(kept, deleted); deleted = non-golden rows older than now - days (a null timestamp is kept)."""
    days = cfg.max_age_days if days is None else days
    cutoff = _ts(now) - F.expr(f"INTERVAL {int(days)} DAYS")
    old = F.coalesce(F.col("timestamp") < cutoff, F.lit(False)) & ~F.coalesce(F.col("is_golden"), F.lit(False))
    deleted = df.where(old)
    if "date" in df.columns:  # date-partitioned store: only partitions up to the cutoff date
        deleted = df.where((F.col("date") <= F.to_date(cutoff)) & old)
    return df.where(~old), deleted


def prune_by_weight(df: DataFrame, threshold: float | None = None, cfg: Thresholds = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(kept, deleted); deleted = non-golden rows with weight < threshold (null weight = 1.0)."""
    threshold = cfg.min_weight if threshold is None else threshold
    low = (_weight() < F.lit(float(threshold))) & ~F.coalesce(F.col("is_golden"), F.lit(False))
    return df.where(~low), df.where(low)


def prune_lowest(df: DataFrame, fraction: float | None = None, cfg: Thresholds = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Drop the int(n * fraction) lowest-weight non-golden rows (ties by timestamp, id).

    One count, then the exact k-th row of the non-golden rows in (weight,
    timestamp, id) order from a range sort of those three columns; the rows
    before it are deleted.  Golden rows are never candidates.
    """
    fraction = cfg.cleanup_fraction if fraction is None else fraction
    is_g = F.coalesce(F.col("is_golden"), F.lit(False))
    candidates = df.where(~is_g)
    order = [_weight(), F.col("timestamp"), F.col("id")]
    # Exact boundary row from the narrow order columns only; the wide table
    # is then split by a predicate (no wide shuffle, no join back).
    boundary = kth_boundary(candidates, order, lambda n: int(n * float(fraction)))
    low = ~is_g & before_boundary(order, boundary)
    return df.where(~low), df.where(low)


def dataset_size_gb(spark: SparkSession, path: str) -> float:
    """Total bytes of the stored table's files, in GiB: one row per file, no contents read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    total = files.agg(F.sum("length")).first()[0] or 0
    return total / (1024 ** 3)


def prune_if_oversize(spark: SparkSession, path: str, cfg: Thresholds = DEFAULT) -> tuple[bool, DataFrame]:
    """Apply I12 when the stored size reaches max_size * cleanup_threshold."""
    df = spark.read.parquet(path)
    if dataset_size_gb(spark, path) >= cfg.max_size_gb * cfg.cleanup_threshold:
        return True, prune_lowest(df, cfg.cleanup_fraction, cfg)[0]
    return False, df


def list_interactions(
    df: DataFrame,
    now=None,
    sentiment_filter: str | None = None,
    is_golden: bool | None = None,
    hours: int | None = None,
    skip: int = 0,
    limit: int = 50,
) -> DataFrame:
    """Filtered, newest-first page with 200-character previews and rounded scores.

    Adds ``total`` (the filtered count before paging) to every row.
    """
    out = df
    if sentiment_filter == "positive":
        out = out.where(F.col("sentiment") > 0.3)
    elif sentiment_filter == "negative":
        out = out.where(F.col("sentiment") < -0.3)
    elif sentiment_filter == "neutral":
        out = out.where(F.abs(F.col("sentiment")) <= 0.3)
    if is_golden is not None:
        out = out.where(F.coalesce(F.col("is_golden"), F.lit(False)) == F.lit(bool(is_golden)))
    if hours:
        lower = _ts(now) - F.expr(f"INTERVAL {int(hours)} HOURS")
        out = out.where(_date_floor(out, lower) & (F.col("timestamp") >= lower))
    total = out.count()
    page = out.orderBy(F.col("timestamp").desc(), F.col("id").desc()).offset(int(skip)).limit(int(limit))
    return page.select(
        "id",
        "timestamp",
        "conversation_id",
        F.substring("user_message", 1, 200).alias("user_message"),
        F.substring("assistant_response", 1, 200).alias("assistant_response"),
        F.round("sentiment", 3).alias("sentiment"),
        F.round("weight", 2).alias("weight"),
        F.coalesce(F.col("is_golden"), F.lit(False)).alias("is_golden"),
        F.lit(total).cast("bigint").alias("total"),
    )


def recent(df: DataFrame, n: int = 20) -> DataFrame:
    """Newest n rows with full text (sentiment 3 dp, weight 2 dp), the table
    total and the number returned."""
    total = df.count()
    return (
        df.orderBy(F.col("timestamp").desc(), F.col("id").desc())
        .limit(int(n))
        .select(
            "id", "timestamp", "conversation_id", "user_message", "assistant_response",
            F.round("sentiment", 3).alias("sentiment"), F.round("weight", 2).alias("weight"),
            F.coalesce(F.col("is_golden"), F.lit(False)).alias("is_golden"),
            F.lit(total).cast("bigint").alias("total"), F.lit(min(int(n), total)).cast("bigint").alias("returned"),
        )
    )


def recent_requests(log: DataFrame, n: int = 50, ts: str = "timestamp", tiebreak: Sequence[str] = ("request_id",)) -> DataFrame:
    """I16: the last n request-log rows, newest first (a top-k)."""
    return log.orderBy(F.col(ts).desc(), *[F.col(c).desc() for c in tiebreak]).limit(int(n))

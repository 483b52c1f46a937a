"""Mixing sources to target weights (DataFrame functions only).

Sizes (words) are summed per source.  The targets share the size of the whole
corpus by weight; a target stops at ``max_rate`` times its source's size and
the excess is shared anew, by weight, among the others.  A source's repetition
rate is target / size, and each of its documents is emitted floor(rate) times,
plus once more if a hash of the document, and of its number among equal rows,
read as a number in [0, 1), is below the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.llm.common import GAP, fresh_name, pin, text_of

WEIGHTS = (5, 2, 1)
#: Up to this many sources their rates are broadcast (three numbers and a name each).
BROADCAST_SOURCES = 10_000


def size_of(text: Column) -> Column:
    """Number of words; by splitting, which is linear in the text."""
    return F.size(F.array_remove(F.split(text, GAP, -1), "")).cast("long")


def _numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with ``place``: 0, 1, ... by code point, null last, without gathering them in one task."""
    ordered = pin(
        sources.orderBy(F.col("source").cast("binary").asc_nulls_last())
        .withColumn("row_id", F.monotonically_increasing_id())
    ).withColumn("part", F.shiftright("row_id", 33))
    starts = {}
    total = 0
    for r in sorted(ordered.groupBy("part").count().collect()):  # one row per partition
        starts[r["part"]] = total
        total += r["count"]
    if not starts:
        return ordered.select(*sources.columns, F.lit(0).cast("long").alias("place"))
    before = F.create_map(*[F.lit(x).cast("long") for kv in starts.items() for x in kv])
    return ordered.select(*sources.columns, (F.element_at(before, F.col("part")) + F.col("row_id").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = 3) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``.

    Each round is one distributed sum over the sources: those whose share
    exceeds their stop are set to it and the rest is shared anew, until no
    share exceeds its stop.  Two numbers per round reach the driver.
    """
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = pin(_numbered(sizes).withColumn("weight", weight).withColumn("stop", max_rate * F.col("source_size")))
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0).cast("long"))).first()[0]
    stopped, seen = F.lit(False), None
    while True:
        sums = table.agg(
            F.sum(F.when(stopped, F.col("stop")).otherwise(0)).alias("fixed"),
            F.sum(F.when(stopped, F.lit(0)).otherwise(F.col("weight"))).alias("open"),
        ).first()
        rest, left = total - int(sums["fixed"] or 0), int(sums["open"] or 0)
        share = F.lit(rest).cast("double") * F.col("weight") / F.lit(max(left, 1)).cast("double")
        if (rest, left) == seen or not left:
            return table.select("source", "source_size", F.when(stopped, F.col("stop").cast("double")).otherwise(share).alias("target"))
        seen = (rest, left)
        stopped = F.col("stop").cast("double") < share  # shares only grow: once stopped a source stays so


def row_key(id_column: Column, source: Column, text: Column, seed: str) -> Column:
    """Digest of the seed, id, source and text; values carry their byte counts, so null, empty and joined values stay apart."""
    marked = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (id_column.cast("string"), source, text)]
    return F.md5(F.concat(F.lit(seed), *marked).cast("binary"))


def draw(key: Column, number: Column) -> Column:
    """A number in [0, 1) from a row's key and its number among equal rows; equal in every run and on every cluster."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", key, number.cast("string")).cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def with_turns(rows: DataFrame, whole: Column) -> DataFrame:
    """``rows`` with ``turn``, the draw of every row, from their ``key``; ``key`` goes.

    Rows that share a key are numbered in the order of ``whole`` (a hash of all
    that tells them apart; rows equal in it are alike), each draws for itself.
    They are spread by (key, whole, position), so that one key with a third of
    all rows is many tasks' work; the others have number 0 and do not move.
    """
    shared = pin(rows.groupBy("key").count().filter("count > 1").select("key"))
    if shared.isEmpty():
        return rows.withColumn("turn", draw(F.col("key"), F.lit(0))).drop("key")
    several = pin(rows.join(shared, "key", "left_semi").withColumn("whole", whole).withColumn("at", F.monotonically_increasing_id()))
    order = ["key", "whole", "at"]
    parted = pin(several.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    counts = parted.groupBy("key", "part").agg(F.count(F.lit(1)).alias("here"))
    before = F.sum("here").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("key", "part", F.coalesce(before, F.lit(0)).alias("start"))
    local = parted.withColumn("no", F.row_number().over(Window.partitionBy("part", "key").orderBy("whole", "at")) - 1)
    numbered = local.join(starts, ["key", "part"]).withColumn("turn", draw(F.col("key"), F.col("start") + F.col("no")))
    single = rows.join(shared, "key", "left_anti").withColumn("turn", draw(F.col("key"), F.lit(0)))
    return single.drop("key").unionByName(numbered.select(single.drop("key").columns))


def repetition(target: Column, source_size: Column) -> Column:
    return F.when(source_size > 0, target / source_size).otherwise(F.lit(0.0))


def copies(target: Column, source_size: Column, turn: Column) -> Column:
    """How often a document is taken: floor(rate), plus one if its draw is below the fraction."""
    rate = repetition(target, source_size)
    return (F.floor(rate) + F.when(turn < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def _with_rates(rows: DataFrame, weights: tuple[int, ...], max_rate: int) -> DataFrame:
    """Rows with ``source`` and ``size`` -> the same with source_size, target and target_error."""
    sizes = rows.select("source", "size").groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("size")).alias("squares"))
    part = repetition(F.col("target"), F.col("source_size")) - F.floor(repetition(F.col("target"), F.col("source_size")))
    targets = pin(source_targets(sizes.select("source", "source_size"), weights, max_rate).alias("t").join(
        sizes.select(F.col("source").alias("name"), "squares"), F.col("t.source").eqNullSafe(F.col("name"))).select(
        "name", "source_size", "target", F.sqrt(part * (1 - part) * F.col("squares")).alias("target_error")))
    if targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    return rows.join(targets, F.col("source").eqNullSafe(F.col("name"))).drop("name")


def mix_plan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
             weights: tuple[int, ...] = WEIGHTS, max_rate: int = 3, seed: str = "mix") -> DataFrame:
    """Per row: doc_id, size, source_size, target (its source's), taken (words, copies counted), target_error.

    ``target_error`` is the standard error of the source's taken words about
    its target: the draws are independent, one for every row, rows that repeat
    id, source and text included.  A null text has size 0; a null source is a
    source of its own, the last, apart from the empty one.  A source without
    words has target 0.  An empty table gives an empty result.  Columns other
    than the three named are not read.
    """
    source, text = F.col(f"`{source_column}`").cast("string"), F.col(f"`{text_column}`").cast("string")
    rows = pin(docs.select(
        F.col(f"`{id_column}`").alias("doc_id"), source.alias("source"), size_of(text_of(f"`{text_column}`")).alias("size"),
        row_key(F.col(f"`{id_column}`"), source, text, seed).alias("key")))
    taken = copies(F.col("target"), F.col("source_size"), F.col("turn")) * F.col("size")
    drawn = with_turns(rows, F.lit(0))
    return _with_rates(drawn, weights, max_rate).select("doc_id", "size", "source_size", "target", taken.alias("taken"), "target_error")


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
        weights: tuple[int, ...] = WEIGHTS, max_rate: int = 3, seed: str = "mix") -> DataFrame:
    """The mixture itself: every row as often as it is taken, with ``copy`` (0, 1, ...) beside its columns."""
    copy = fresh_name(docs, "copy")
    source, text = F.col(f"`{source_column}`").cast("string"), F.col(f"`{text_column}`").cast("string")
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), source.alias("source"),
        size_of(text_of(f"`{text_column}`")).alias("size"), row_key(F.col(f"`{id_column}`"), source, text, seed).alias("key"))
    n = copies(F.col("target"), F.col("source_size"), F.col("turn")).cast("int")
    taken = _with_rates(with_turns(sized, F.xxhash64(F.to_json("row"))), weights, max_rate).withColumn("n", n).filter("n > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("c")).select("row.*", F.col("c").alias(copy))

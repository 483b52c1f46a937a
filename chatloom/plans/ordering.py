"""Order-dependent helpers that stay parallel when one key holds most rows.

Running values per key ("last assistant text before this turn") and exact
global positions ("the k lowest rows") are usually written as windows
partitioned by the key, or as an unpartitioned window.  Both put a hot key (or
everything) into one task.  The helpers here cut the order ``(key, order)``
into contiguous segments at bounds taken from a sample of those narrow columns,
so a hot key is spread over several segments; segments work in parallel, and
what crosses them is bounded by the number of segments, not by the data.

The bounds are literals, chosen once: a row's segment is an expression of its
own columns, the same in every plan, scan and retried task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.session import cut_lineage

SEG = "_seg"


def _cols(xs: Sequence[str | Column]) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def range_segments(df: DataFrame, order: Sequence[str | Column], num_partitions: int | None = None) -> DataFrame:
    """Range-partition on ``order`` and tag each row with its segment id, pinned.

    Segment ids increase with ``order``.  Every range exchange samples its own
    bounds (the sampling seed depends on the RDD), so two consumers of an
    unpinned frame could be planned as two exchanges with different bounds.
    The tagged frame is therefore cut with a reliable checkpoint into the shared
    checkpoint folder: all consumers read the same segments, and a lost executor
    re-reads them instead of re-sampling.
    """
    cols = _cols(order)
    parted = df.repartitionByRange(num_partitions, *cols) if num_partitions else df.repartitionByRange(*cols)
    return cut_lineage(parted.withColumn(SEG, F.spark_partition_id()))


#: Sampled rows per segment, and rows that are not worth a segment of their own.
OVERSAMPLE, SEGMENT_ROWS = 60, 50_000


def _literal(value, kind) -> Column:
    if value is not None and kind.typeName() == "timestamp_ntz":  # by its digits, whatever the time zones are
        value = value.isoformat(sep=" ")
    return F.lit(value).cast(kind)


class Segments:
    """Contiguous segments of a total order, about ``parts`` of equal size.

    Bounds come from the rows whose hash is 0 modulo a number, about
    ``OVERSAMPLE`` a segment, whatever the size; they only balance the work.
    """

    def __init__(self, df: DataFrame, order: Sequence[Column], parts: int, rows: int):
        self.names = [f"_o{i}" for i in range(len(order))]
        narrow = df.select(*[c.alias(n) for c, n in zip(order, self.names)])
        self.kinds = [f.dataType for f in narrow.schema.fields]
        thin = max(1, rows // (OVERSAMPLE * parts))
        sample = self._sample(narrow, thin) if parts > 1 else []
        if parts > 1 and len(sample) < 2 and thin > 1:  # few different rows, each many times
            distinct = narrow.distinct()
            sample = self._sample(distinct, max(1, distinct.count() // (OVERSAMPLE * parts)))
        picks = sorted({len(sample) * i // parts for i in range(1, parts)}) if len(sample) > 1 else []
        self.bounds = [sample[i] for i in picks if i > 0]
        self.parts = len(self.bounds) + 1

    def _sample(self, narrow: DataFrame, thin: int) -> list:
        return narrow.where(F.pmod(F.xxhash64(*self.names), F.lit(thin)) == 0).distinct().sort(*self.names).collect()

    def place(self, order: Sequence[Column]) -> Column:
        return F.struct(*[c.cast(k).alias(n) for c, k, n in zip(order, self.kinds, self.names)])

    def bound(self, row) -> Column:
        return F.struct(*[_literal(v, k).alias(n) for v, k, n in zip(row, self.kinds, self.names)])

    def of(self, order: Sequence[Column]) -> Column:
        """Number of the segment (int): how many bounds are not after the row, by binary search."""
        if not self.bounds:
            return F.lit(0)
        bounds, place = F.array(*[self.bound(r) for r in self.bounds]), self.place(order)
        steps = [1 << k for k in reversed(range(len(self.bounds).bit_length()))]

        def look(low: Column, step: Column) -> Column:
            reach = low + step
            return F.when((reach <= len(self.bounds)) & (F.get(bounds, F.least(reach, F.lit(len(self.bounds))) - 1) <= place), reach).otherwise(low)

        return F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), look)


def carry(
    df: DataFrame,
    key: str | Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    direction: str = "last",
) -> DataFrame:
    """Running value per key without a per-key single task (see ``carry_many``)."""
    return carry_many(df, key, order, [(value, out, direction)])


def carry_many(
    df: DataFrame,
    key: str | Sequence[str],
    order: Sequence[str],
    specs: Sequence[tuple[Column, str, str]],
    num_partitions: int | None = None,
) -> DataFrame:
    """Several running values per key in one pass; the same plan for any size and key skew.

    Each spec is (value, out, direction).  ``direction="last"``: the last
    non-null ``value`` among rows *before* each row (by ``order``) with the
    same key; ``"first"``: the first non-null ``value`` among rows *after* it.

    The rows are shuffled once, to their segments, where the windows run.  Only
    keys that go on in another segment, at most one per bound, need more: of
    these the places (not the values) of the edge values are aggregated from the
    narrow columns, the few values fetched, and broadcast: per segment at most
    one value and spec.  ``df`` is read several times, so pin it if it is not
    deterministic.
    """
    keys = [key] if isinstance(key, str) else list(key)
    total = [F.col(c) for c in [*keys, *order]]
    rows = df.select(*total).count()
    n = num_partitions or min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // SEGMENT_ROWS))
    cut = Segments(df, total, max(1, n), rows)
    tagged = df.withColumn(SEG, cut.of(total))
    order_cols = [F.col(c) for c in order]
    by = Window.partitionBy(SEG, *keys).orderBy(*order_cols)
    locals_ = []
    for i, (value, _out, direction) in enumerate(specs):
        if direction == "last":
            locals_.append(F.last(value, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_local{i}"))
        elif direction == "first":
            locals_.append(F.first(value, ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing)).alias(f"_local{i}"))
        else:
            raise ValueError(direction)
    laid = (tagged.repartitionById(cut.parts, F.col(SEG)) if cut.parts > 1 else tagged).select("*", *locals_)
    carried = _carried(df, tagged, keys, list(order), specs) if cut.parts > 1 else None
    if carried is None:
        return laid.select(*df.columns, *[F.col(f"_local{i}").alias(name) for i, (_v, name, _d) in enumerate(specs)])
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [SEG, *keys]]
    joined = laid.alias("s").join(F.broadcast(carried.alias("c")), same, "left")
    values = [F.coalesce(F.col(f"_local{i}"), F.col(f"_carry{i}")).alias(name) for i, (_v, name, _d) in enumerate(specs)]
    return joined.select(*[F.col(f"s.{c}") for c in df.columns], *values)


def _carried(df: DataFrame, tagged: DataFrame, keys: list[str], order: list[str], specs) -> DataFrame | None:
    """(segment, key, one value per spec) of keys in several segments; None if there are none.

    At most one key per bound goes on across it, so this has at most as many
    rows as there are segments and bounds together.
    """
    spark, whole = df.sparkSession, F.struct(*keys)
    ends = sorted(tagged.groupBy(SEG).agg(F.min(whole).alias("first"), F.max(whole).alias("last")).collect(), key=lambda r: r[SEG])  # a row per segment
    kinds = [df.schema[k].dataType for k in keys]
    crossing = {tuple(a["last"]) for a, b in zip(ends, ends[1:]) if a["last"] == b["first"]}
    if not crossing:
        return None
    rows = [F.struct(*[_literal(v, k).alias(c) for v, k, c in zip(r, kinds, keys)]) for r in sorted(crossing, key=str)]
    named = spark.range(1).select(F.inline(F.array(*rows)))
    narrow = tagged.select(SEG, *keys, *order, *[v.isNotNull().alias(f"_has{i}") for i, (v, _n, _d) in enumerate(specs)])
    own = narrow.alias("n").join(F.broadcast(named.alias("k")), [F.col(f"n.{k}").eqNullSafe(F.col(f"k.{k}")) for k in keys], "left_semi")
    spot = F.struct(*order)
    picks = [(F.max if d == "last" else F.min)(F.when(F.col(f"_has{i}"), spot)).alias(f"_at{i}") for i, (_v, _n, d) in enumerate(specs)]
    edges = own.groupBy(SEG, *keys).agg(*picks)
    by = Window.partitionBy(*keys).orderBy(SEG)
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(1, Window.unboundedFollowing)
    out = edges.select(SEG, *keys, *[
        (F.last(f"_at{i}", ignorenulls=True).over(before) if d == "last" else F.first(f"_at{i}", ignorenulls=True).over(after)).alias(f"_at{i}")
        for i, (_v, _n, d) in enumerate(specs)])
    for i, (value, _name, _d) in enumerate(specs):
        places = out.where(F.col(f"_at{i}").isNotNull()).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(f"_at{i}").alias("_spot")).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
        found = df.select(*keys, spot.alias("_own"), value.alias(f"_carry{i}")).join(
            F.broadcast(places), [*same, F.col("_own").eqNullSafe(F.col("_spot"))], "inner").select(
            *[F.col(f"_k_{k}").alias(f"_f_{k}") for k in keys], F.col("_spot").alias(f"_f_at{i}"), f"_carry{i}")
        out = out.join(F.broadcast(found), [*[F.col(k).eqNullSafe(F.col(f"_f_{k}")) for k in keys], F.col(f"_at{i}") == F.col(f"_f_at{i}")], "left").drop(
            *[f"_f_{k}" for k in keys], f"_f_at{i}")
    return out.select(SEG, *keys, *[f"_carry{i}" for i in range(len(specs))])


def global_index(df: DataFrame, order: Sequence[str | Column], out: str = "_idx") -> DataFrame:
    """Exact 0-based position of each row in the total order ``order``.

    ``order`` must be a total order (end it with a unique column).  Range
    partitioning sorts in parallel; per-segment counts (one row per partition)
    give each segment its starting offset.  No unpartitioned window over rows.
    """
    cols = _cols(order)
    seg = range_segments(df, cols)
    local = seg.withColumn("_local", F.row_number().over(Window.partitionBy(SEG).orderBy(*cols)) - 1)
    sizes = seg.groupBy(SEG).agg(F.count(F.lit(1)).alias("_n"))
    # At most spark.sql.shuffle.partitions rows: safe to order globally and broadcast.
    offsets = sizes.select(
        SEG,
        F.coalesce(
            F.sum("_n").over(Window.orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_off"),
    )
    return (
        local.join(F.broadcast(offsets), SEG, "left")
        .withColumn(out, F.col("_off") + F.col("_local"))
        .drop("_off", "_local", SEG)
    )


#: So many narrow rows are sorted to find a position in them.
SELECT_ROWS = 200_000


def kth_boundary(df: DataFrame, order: Sequence[Column], position: Callable[[int], int]):
    """The order values of the row at 0-based position ``position(number of rows)`` in the total
    order, or None past the end.

    Selection by counting: the rows of every segment of a sampled division are counted (one
    aggregate over the narrow order columns, as many rows as segments), the segment that holds
    the position is divided anew until it is small, and only that is sorted.  No shuffle or
    copy of the rows.  Rows before the boundary are exactly ``struct(order) < boundary``.
    """
    names = [f"_o{i}" for i in range(len(order))]
    cols = [F.col(n) for n in names]
    parts = max(32, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(*[c.alias(n) for c, n in zip(order, names)])
    left = rows.count()
    k = max(0, position(left))
    if k >= left:
        return None
    while left > SELECT_ROWS:
        cut = Segments(rows, cols, parts, left)
        if not cut.bounds:  # all rows are equal
            return cut.bound(rows.first())
        sizes = {r[SEG]: r["count"] for r in rows.groupBy(cut.of(cols).alias(SEG)).count().collect()}
        segment = 0
        while k >= sizes.get(segment, 0):
            k -= sizes.get(segment, 0)
            segment += 1
        place, left = cut.place(cols), sizes[segment]
        if segment > 0:
            rows = rows.where(place >= cut.bound(cut.bounds[segment - 1]))
        if segment < len(cut.bounds):
            rows = rows.where(place < cut.bound(cut.bounds[segment]))
    return Segments(rows, cols, 1, left).bound(rows.orderBy(*cols).offset(k).limit(1).first())


def before_boundary(order: Sequence[Column], boundary: Column | None) -> Column:
    """Predicate: the row sorts strictly before ``boundary`` (all rows when None)."""
    if boundary is None:
        return F.lit(True)
    return F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)]) < boundary

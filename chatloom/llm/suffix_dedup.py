"""Exact substring dedup: column-wise collection BWT over aligned contexts.

Every byte inside a string of ``length`` bytes that also starts earlier (in a
smaller document, or earlier in the same one) is removed.

The collection is never one string.  A window of ``length`` bytes is filed
under the least hash among its grams of 32 bytes (the last such gram on ties).
That gram, its anchor, depends on the window's bytes alone, so equal windows
are filed under equal grams and at equal distances from them.  Anchors that
occur twice or more deal short contexts (the windows filed under one anchor,
at most 68 + 168 bytes) to tasks by gram.

A task builds the order of all suffixes of such a collection of contexts, all
aligned on the anchor, column by column from the right: each round inserts one
symbol of every context, a stable distribution by symbol updates the order
(the symbols read in that order are the collection's Burrows-Wheeler column),
and the common prefixes of neighbours are one more than the least common
prefix between their previous places, or zero where symbols differ.  Runs of
common prefixes of at least ``length`` are equal windows, compared byte by
byte; all but the earliest start of a run are covered.  Contexts reach a task
sorted by gram through Spark's shuffle files, read in sequence, and only one
batch of them is in memory.

A gram that more than ``group_limit`` places share is not put in one task as
it is: equal contexts are combined first, map-side.  If still more than
``context_limit`` distinct contexts are left, they are cut into their windows,
windows are grouped by content with map-side combining, and the join back can
be split by AQE.  That gives the same windows by the same rule, exactly up to
128-bit digests.

Copies of a whole text are found first, by 256-bit digest, and take no part:
all but the first lose every byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import id_of_key, keyed, pin

#: Bytes of a gram, a power of two.
GRAM = 32
#: Window starts hashed at a time (bounds memory on very long texts); places in a piece must fit 20 bits.
PIECE = 1 << 17
_PLACE_BITS = np.uint64(20)
_SYMBOLS = np.random.default_rng(20).integers(1, 1 << 63, 256).astype(np.uint64)
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD))


def gram_hashes(octets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every ``GRAM``-byte substring, by doubling."""
    h = _SYMBOLS[octets]
    width = 1
    for factor in _MIX:
        wider = h[:-width] * factor
        wider += h[width:]
        h, width = wider, 2 * width
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(29)
    return h


def least_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """For every run of ``width`` hashes the place of its least one, the last on ties.

    Places fill the low bits of the compared numbers; running minima from both
    ends of blocks of ``width`` give the minimum of any run from two of them.
    """
    n = len(hashes)
    top = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = hashes | top
    blocks[:n] -= np.arange(n, dtype=np.uint64)
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - width + 1], ahead[width - 1: n])
    return (top - (least & top)).astype(np.int64)


def anchors(octets: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of texts that lie end to end in ``octets``; text i ends where text i + 1 begins (``offsets``).

    Per anchor: gram hash (signed), place, first and last start of the windows
    filed there, as places in ``octets``.  Windows never cross texts.
    """
    inside = np.zeros(max(len(octets) - length + 1, 0), bool)
    sizes = np.diff(offsets)
    for a, n in zip((offsets[:-1] - offsets[0])[sizes >= length].tolist(), sizes[sizes >= length].tolist()):
        inside[a:a + n - length + 1] = True
    found = [[], [], [], []]
    for at in range(0, len(inside), PIECE):
        legal = inside[at:at + PIECE]
        if not legal.any():
            continue
        hashes = gram_hashes(octets[at:at + PIECE + length - 1])
        of_window = np.where(legal, least_places(hashes, length - GRAM + 1), -1)
        begins = np.flatnonzero(np.concatenate([[True], of_window[1:] != of_window[:-1]]))
        ends = np.concatenate([begins[1:], [len(of_window)]]) - 1
        real = of_window[begins] >= 0
        place = of_window[begins][real]
        for kept, new in zip(found, (hashes[place].view(np.int64), place + at, begins[real] + at, ends[real] + at)):
            kept.append(new)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, end to end, and where its texts begin and the last one ends (from 0)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    octets = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return octets, offsets - offsets[0]


_ANCHORS = "gram long, k1 long, k2 long, place int, n int"


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            octets, offsets = _texts(batch.column("raw"))
            gram, place, _, _ = anchors(octets, offsets, length)
            text = np.searchsorted(offsets, place, side="right") - 1
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            if len(gram):  # a gram that a text repeats is one row: its first place there and how many
                order, heads = _pairs(text, gram)
                own = order[heads]
                n = np.diff(np.concatenate([heads, [len(order)]]))
                yield _record_batch([(gram[own], k1[text[own]], k2[text[own]], place[own] - offsets[text[own]], n)], _ANCHORS)

    return run


def _pairs(text: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of anchors by (text, gram), places ascending, and where each pair begins in it."""
    order = np.lexsort((gram, text))
    moved = (np.diff(text[order]) != 0) | (np.diff(gram[order]) != 0)
    return order, np.concatenate([[0], np.flatnonzero(moved) + 1])


def _record_batch(parts: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*[x.split() for x in schema.split(", ")])
    types = {"long": (np.int64, pa.int64()), "int": (np.int32, pa.int32())}
    columns = [np.concatenate([p[i] for p in parts]).astype(types[k][0]) for i, k in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([pa.array(c, types[k][1]) for c, k in zip(columns, kinds)], names=list(names))


#: Contexts per Arrow batch that goes back to Spark.
_OUT = 1 << 15
_CONTEXTS = "gram long, k1 long, k2 long, place int, lead int, context binary"


def _context_rows(length: int):
    """From documents with the places of their shared grams to contexts: the bytes of all windows filed under an anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            octets, offsets = _texts(batch.column("raw"))
            lists = batch.column("found")
            edges = lists.offsets.to_numpy()
            shared = np.zeros(len(octets), bool)
            places = lists.values.to_numpy(zero_copy_only=False)[edges[0]:edges[-1]]
            shared[places + np.repeat(offsets[:-1], np.diff(edges))] = True
            gram, place, first, last = anchors(octets, offsets, length)
            text_of_anchor = np.searchsorted(offsets, place, side="right") - 1
            order, heads = _pairs(text_of_anchor, gram)
            listed = np.logical_or.reduceat(shared[place[order]], heads)
            kept = np.sort(order[np.repeat(listed, np.diff(np.concatenate([heads, [len(order)]])))])
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            raw = octets.tobytes()
            for at in range(0, len(kept), _OUT):
                own = kept[at:at + _OUT]
                text = text_of_anchor[own]
                contexts = [raw[a:b] for a, b in zip(first[own].tolist(), (last[own] + length).tolist())]
                yield _with_binary([(gram[own], k1[text], k2[text], place[own] - offsets[text], place[own] - first[own])], contexts)

    return run


def _with_binary(parts: list[tuple], contexts: list[bytes]) -> pa.RecordBatch:
    fixed = _record_batch(parts, _CONTEXTS.rpartition(", ")[0])
    return pa.RecordBatch.from_arrays([*fixed.columns, pa.array(contexts, pa.binary())], names=[*fixed.schema.names, "context"])


def covered_starts(group: np.ndarray, rank: np.ndarray, lead: np.ndarray, contexts: list[bytes], length: int) -> np.ndarray:
    """Which windows of aligned contexts have an equal window of lower rank in their group.

    ``group`` ascending.  Result: a boolean row per context; column j is the
    window that starts j bytes after the leftmost start any context can have.
    """
    n, reach = len(contexts), length - GRAM
    columns = reach + length  # from the leftmost start to the end of a window that starts at the anchor
    sizes = np.fromiter(map(len, contexts), np.int64, n)
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    column = np.arange(columns)[:, None] - (reach - lead)[None, :]
    inside = (column >= 0) & (column < sizes[None, :])
    symbols = np.zeros((columns, n), np.int16)  # 0: the context has no symbol there
    symbols[inside] = flat[(begin[None, :] + column)[inside]].astype(np.int16) + 1
    last_column = int(np.flatnonzero(inside.any(axis=1))[-1]) if n else -1
    covered = np.zeros((n, reach + 1), bool)

    order, number = np.arange(n), np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]).astype(np.int64)]))
    common = np.zeros(n + 1, np.int32)  # with the previous in order; the last entry only ends ranges
    for c in range(last_column, -1, -1):
        here = symbols[c][order]
        slot = number * 257 + here
        turn = np.argsort(slot, kind="stable")  # one symbol of each context is inserted
        kept = slot[turn]
        equal = np.flatnonzero((kept[1:] == kept[:-1]) & (here[turn[1:]] > 0)) + 1
        fresh = np.zeros(n + 1, np.int32)
        if len(equal):
            ranges = np.empty(2 * len(equal), np.int64)
            ranges[0::2], ranges[1::2] = turn[equal - 1] + 1, turn[equal] + 1
            fresh[equal] = np.minimum.reduceat(common, ranges)[::2] + 1
        order, common = order[turn], fresh  # ``number`` is unchanged: groups stay in place
        if c <= reach:
            alike = common[:n] >= length
            if alike.any():
                heads = np.flatnonzero(~alike)
                lowest = np.minimum.reduceat(rank[order], heads)
                run = np.cumsum(~alike) - 1
                covered[order, c] = rank[order] > lowest[run]
    return covered


_COVERED = "k1 long, k2 long, begin int, stop int"


def _intervals(k1, k2, place, covered: np.ndarray, length: int) -> tuple | None:
    """Runs of covered window starts as byte intervals."""
    padded = np.zeros((len(covered), covered.shape[1] + 2), np.int8)
    padded[:, 1:-1] = covered
    edge = np.diff(padded, axis=1)
    row, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1]
    if not len(row):
        return None
    left = place[row] - (length - GRAM)
    return k1[row], k2[row], left + first, left + last - 1 + length


def _covered_rows(length: int):
    def settle(batch: pa.Table) -> Iterator[pa.RecordBatch]:
        gram, k1, k2, place, lead = (batch.column(n).to_numpy() for n in ("gram", "k1", "k2", "place", "lead"))
        by_age = np.lexsort((place, k2, k1))
        moved = np.any([np.diff(x[by_age]) != 0 for x in (k1, k2, place)], axis=0)
        rank = np.empty(len(gram), np.int64)
        rank[by_age] = np.concatenate([[0], np.cumsum(moved)])
        found = _intervals(k1, k2, place.astype(np.int64),
                           covered_starts(gram, rank, lead.astype(np.int64), batch.column("context").to_pylist(), length), length)
        if found:
            yield _record_batch([found], _COVERED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            gram = held.column("gram").to_numpy()
            whole = int(np.searchsorted(gram, gram[-1]))  # the last group may go on in the next batch
            if whole:
                yield from settle(held.slice(0, whole).combine_chunks())
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield from settle(held.combine_chunks())

    return run


def _crowded(contexts: DataFrame, length: int, context_limit: int, partitions: int) -> DataFrame:
    """Covered intervals of contexts whose grams occur too often to be put in one task as they are."""
    age = F.struct("k1", "k2", "place")
    marked = contexts.withColumn("same", F.unhex(F.md5("context")))
    first = marked.groupBy("gram", "lead", "same").agg(F.min(age).alias("first"), F.max_by("context", age).alias("context"))
    # a repeated context is covered whole
    again = marked.select("gram", "lead", "same", "k1", "k2", "place", F.length("context").alias("size")).join(
        first.select("gram", "lead", "same", "first"), ["gram", "lead", "same"]).filter(age > F.col("first"))
    whole = again.select("k1", "k2", (F.col("place") - F.col("lead")).alias("begin"), (F.col("place") - F.col("lead") + F.col("size")).alias("stop"))
    # the first of equal contexts can still share windows with others
    counted = first.join(first.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram")
    few = counted.filter(F.col("n").between(2, context_limit)).select("gram", "first.k1", "first.k2", "first.place", "lead", "context")
    settled = few.repartition(partitions, "gram").sortWithinPartitions("gram").mapInArrow(_covered_rows(length), _COVERED)
    windows = counted.filter(F.col("n") > context_limit).repartition("same").select(
        "first", F.explode(F.transform(
            F.sequence(F.lit(0), F.length("context") - length),
            lambda j: F.struct((F.col("first.place") - F.col("lead") + j).alias("begin"),
                               F.unhex(F.md5(F.col("context").substr(j + 1, F.lit(length)))).alias("content")))).alias("w"))
    windows = windows.select("first.k1", "first.k2", "w.begin", "w.content")
    start = F.struct("k1", "k2", "begin")
    earliest = windows.groupBy("content").agg(F.min(start).alias("earliest"), F.max(start).alias("latest")).filter("latest > earliest")
    single = windows.join(earliest.select("content", "earliest"), "content").filter(start > F.col("earliest"))
    return whole.unionByName(settled).unionByName(single.select("k1", "k2", "begin", (F.col("begin") + length).alias("stop")))


def _copies(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, bool]:
    """Keys and sizes of all but the first copy of a text, and whether ids alone tell the rows apart."""
    listed = pin(keyed(docs, id_column, text_column).select("k1", "k2", F.unhex(F.sha2("text", 256)).alias("same"), F.octet_length("text").alias("size")))
    repeats = listed.groupBy("k1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    place = F.struct("k1", "k2")
    first = listed.groupBy("same").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("last > first").select("same", "first")
    copies = listed.join(first, "same").filter(place > F.col("first")).select("k1", "k2", "size").distinct()
    return pin(copies), repeats.isEmpty()


_RESULT = "n_bytes long, n_removed long, spans array<struct<begin:int,stop:int>>, kept_sha256 string, kept binary"


def _merge(begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by intervals (touching ones are one run)."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(stop[order])
    fresh = np.concatenate([[True], begin[1:] > reach[:-1]])
    return begin[fresh], reach[np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(reach) - 1]])]


def _remove(keep_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column("raw"), batch.column("found")
            sizes, removed, spans, digests, kept = [], [], [], [], []
            for i in range(batch.num_rows):
                raw = texts[i].as_buffer().to_pybytes()
                found = lists[i].values
                runs = []
                if found is not None and len(found):
                    b, s = _merge(found.field("begin").to_numpy(zero_copy_only=False), found.field("stop").to_numpy(zero_copy_only=False))
                    runs = list(zip(b.tolist(), s.tolist()))
                rest = b"".join(raw[x:y] for x, y in zip([0, *(s for _, s in runs)], [*(b for b, _ in runs), len(raw)]))
                sizes.append(len(raw))
                removed.append(len(raw) - len(rest))
                spans.append([{"begin": b, "stop": s} for b, s in runs])
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if keep_bytes else None)
            span = pa.list_(pa.struct([("begin", pa.int32()), ("stop", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(digests, pa.string()), pa.array(kept, pa.binary())],
                names=["k1", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"])

    return run


def substring_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = 100,
                    group_limit: int = 1000, context_limit: int = 50_000, keep_bytes: bool = True) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, spans (maximal removed runs), kept_sha256, kept (the remaining bytes).

    Texts are judged as UTF-8 bytes; a null text is empty; texts shorter than
    ``length`` lose nothing.  Rows that repeat both id and text count as one
    document, and each gets its result; rows that share only the id are
    ordered by text hash; null ids come last.  An empty table gives an empty
    result.  Other columns are not read.  ``keep_bytes=False`` leaves ``kept``
    null.  ``length`` is at least 33.
    """
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM}")
    copies, unique_ids = _copies(docs, id_column, text_column)
    copies = copies.filter(F.col("size") >= length)
    # where ids are unique the text hash would only widen every row
    # (no literal, which the optimizer folds out of some joins only, nor a nullable column, which it filters in some only:
    # one shuffle of the texts serves every join below)
    second = F.coalesce(F.pmod("k1", F.lit(1)), F.lit(0)) if unique_ids else F.col("k2")
    copies = copies.select("k1", second.alias("k2"), "size")
    base = keyed(docs, id_column, text_column).select("k1", second.alias("k2"), F.col("text").cast("binary").alias("raw"))
    own = base.join(copies, ["k1", "k2"], "left_anti")
    occurrences = own.mapInArrow(_anchor_rows(length), _ANCHORS)
    shared = occurrences.select("gram", "n").groupBy("gram").agg(F.sum("n").alias("places")).filter("places > 1")
    found = occurrences.drop("n").join(shared, "gram")

    def contexts(which: Column) -> DataFrame:
        by_doc = found.filter(which).groupBy("k1", "k2").agg(F.collect_list("place").alias("found"))
        return base.join(by_doc, ["k1", "k2"]).mapInArrow(_context_rows(length), _CONTEXTS)

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    settled = contexts(F.col("places") <= group_limit).repartition(n, "gram").sortWithinPartitions("gram").mapInArrow(_covered_rows(length), _COVERED)
    crowded = _crowded(contexts(F.col("places") > group_limit), length, context_limit, n)
    whole = copies.select("k1", "k2", F.lit(0).alias("begin"), F.col("size").alias("stop"))
    by_doc = settled.unionByName(crowded).unionByName(whole).groupBy("k1", "k2").agg(F.collect_list(F.struct("begin", "stop")).alias("found"))
    result = base.join(by_doc, ["k1", "k2"], "left").select("k1", "raw", "found").mapInArrow(_remove(keep_bytes), f"k1 long, {_RESULT}")
    return result.select(id_of_key("k1").alias("doc_id"), "n_bytes", "n_removed", "spans", "kept_sha256", "kept")

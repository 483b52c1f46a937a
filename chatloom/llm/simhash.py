"""SimHash near-duplicates: pigeonring candidate chains, full Hamming check, components.

Two fingerprints that differ in at most ``max_bits`` bits, cut into ``segments``
segments on a ring, have a start from which every chain of l consecutive
segments differs in at most l * max_bits / segments bits.  Chains whose budget
rounds down to zero must be equal, which gives the join key of that start; the
longer chains and the full distance are tested inside the join, so only true
links leave it.

Everything after the fingerprint pass works on distinct fingerprints, so exact
copies, however many, are one row.  A key that more than ``bucket_limit``
distinct fingerprints share is not compared pairwise: each of them is dealt to
the strings that differ from it in at most one of the non-key bits.  Two
fingerprints at most two bits apart meet at such a string, at most one more
fingerprint per bit meets there, and linking all of them to the least one
keeps every connection, exactly and in linear space.  (For budgets other than
two bits see ``similar_fingerprints``.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.llm.common import id_of_key, keyed, packed, pin
from chatloom.llm.graph import connected_components

SEED = 42
#: Hashes turned into bits at a time (bounds memory on very long texts).
_BLOCK = 1 << 16


def fingerprint(raw: bytes, shingle: int = 3) -> int:
    """The 64-bit fingerprint of one whole text (unsigned; 0 without words)."""
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1]
    stops = ends[shingle - 1:]
    counts = np.zeros(64, np.int64)
    digest, seed = xxhash.xxh64_intdigest, SEED
    for at in range(0, len(starts), _BLOCK):
        part = zip(starts[at:at + _BLOCK].tolist(), stops[at:at + _BLOCK].tolist())
        hashes = np.array([digest(joined[a:b], seed) for a, b in part], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(starts), bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def _fingerprint_column(raw: Column, shingle: int) -> Column:
    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            prints = np.fromiter((fingerprint(bytes(t), shingle) for t in texts), np.uint64, len(texts))
            yield pd.Series(prints.view(np.int64))

    return run(raw)


def segment_masks(segments: int) -> list[int]:
    """Masks of ``segments`` consecutive bit runs that together cover 64 bits, as equal as can be."""
    edges = [64 * i // segments for i in range(segments + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _starts_chain(xor: Column, start: int, masks: list[int], max_bits: int) -> Column:
    """Every chain from ``start`` stays within its proportional budget."""
    total, test = F.lit(0), F.lit(True)
    for length in range(1, len(masks) + 1):
        total = total + F.bit_count(xor.bitwiseAND(F.lit(_signed(masks[(start + length - 1) % len(masks)]))))
        test = test & (total <= length * max_bits // len(masks))
    return test


def similar_fingerprints(prints: DataFrame, max_bits: int = 2, segments: int = 5, bucket_limit: int = 128) -> DataFrame:
    """Links ``(a, b)``, a < b, among the distinct values of the long column ``fp``.

    The links connect exactly the fingerprints that a chain of pairs at most
    ``max_bits`` apart connects.  Where a key has at most ``bucket_limit``
    fingerprints every such pair is itself a link, given once (by the first
    start whose chains hold).  ``max_bits`` up to 2; at least
    ``max_bits + 1`` segments, so that each start has a key.
    """
    if not 0 <= max_bits <= 2 or not max_bits < segments <= 64:
        raise ValueError("max_bits must be 0, 1 or 2, and segments in max_bits + 1 .. 64")
    masks = segment_masks(segments)
    equal = sum(1 for length in range(1, segments + 1) if length * max_bits // segments == 0)
    keys = [sum(masks[(s + i) % segments] for i in range(equal)) for s in range(segments)]
    dealt = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(k))) for k in keys])).alias("start", "key"))
    sizes = dealt.groupBy("start", "key").count().filter("count > 1")
    shared = pin(dealt.join(sizes, ["start", "key"]))

    small = shared.filter(F.col("count") <= bucket_limit)
    xor = F.col("a").bitwiseXOR(F.col("b"))
    first = F.lit(False)
    for s in reversed(range(segments)):
        first = F.when(_starts_chain(xor, s, masks, max_bits), F.col("start") == s).otherwise(first)
    pairs = (
        small.select("start", "key", F.col("fp").alias("a"))
        .join(small.select(F.col("start").alias("start_b"), F.col("key").alias("key_b"), F.col("fp").alias("b")),
              (F.col("start") == F.col("start_b")) & (F.col("key") == F.col("key_b")) & (F.col("a") < F.col("b"))
              & (F.bit_count(xor) <= max_bits) & first)
        .select("a", "b")
    )

    # crowded keys: meet at the strings at most one bit away
    flips = [0] + [1 << i for i in range(64)] if max_bits else [0]
    free = F.col("key_mask")
    crowded = (
        shared.filter(F.col("count") > bucket_limit).repartition("fp")  # not one task per crowded key
        .withColumn("key_mask", F.element_at(F.array(*[F.lit(_signed(k)) for k in keys]), F.col("start") + 1))
        .select("start", "fp", F.explode(F.filter(F.array(*[F.lit(_signed(f)) for f in flips]), lambda f: f.bitwiseAND(free) == 0)).alias("flip"))
        .withColumn("meet", F.col("fp").bitwiseXOR(F.col("flip")))
    )
    if max_bits == 1:  # only a fingerprint and its one-bit neighbours: the meeting string itself must be one of them
        crowded = crowded.withColumn("own", (F.col("flip") == 0).cast("int"))
        place = Window.partitionBy("start", "meet")
        stars = crowded.withColumn("hub", F.max(F.when(F.col("own") == 1, F.col("fp"))).over(place)).filter("hub IS NOT NULL")
    else:
        # at most 65 rows at a meeting string: itself and one for each bit
        stars = crowded.withColumn("hub", F.min("fp").over(Window.partitionBy("start", "meet")))
    stars = stars.filter("fp <> hub").select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b"))
    return pairs.unionByName(stars)


def simhash_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3) -> DataFrame:
    """``(k1, k2, fp)`` per row, computed once and kept in the shared folder."""
    rows = keyed(docs, id_column, text_column)
    return pin(rows.select("k1", "k2", _fingerprint_column(F.col("text").cast("binary"), shingle).alias("fp")))


def with_components(rows: DataFrame, max_bits: int = 2, segments: int = 5, bucket_limit: int = 128) -> DataFrame:
    """``rows`` (k1, k2, fp) with ``root``, the least fingerprint reachable over links, and ``component``, the least k1.

    Only the root tells components apart: unrelated texts may share an id, or have none.
    """
    prints = pin(rows.groupBy("fp").agg(F.min("k1").alias("k1")))
    roots = connected_components(similar_fingerprints(prints.select("fp"), max_bits, segments, bucket_limit), "a", "b")
    of_print = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = of_print.groupBy("root").agg(F.min("k1").alias("component"))
    return rows.join(of_print.join(least, "root").select("fp", "root", "component"), "fp")


def simhash_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3,
                       max_bits: int = 2, segments: int = 5, bucket_limit: int = 128) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable).

    Null and empty texts have fingerprint zero and link like any other.  Rows
    that repeat are rows of the result too.  A null id is the greatest id: its
    component_id is null only where no row of the component has an id.  An
    empty table gives an empty result.  Other columns are not read.
    """
    rows = with_components(simhash_rows(docs, id_column, text_column, shingle), max_bits, segments, bucket_limit)
    return rows.select(
        id_of_key("k1").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        id_of_key("component").alias("component_id"),
    )


def keep_one_per_component(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3,
                           max_bits: int = 2, segments: int = 5, bucket_limit: int = 128) -> DataFrame:
    """The rows, with all their columns, of one document per component: the least id, then the least text hash.

    Of rows that repeat both id and text one stays.  Unrelated texts stay, also
    where they share an id or have none.
    """
    rows = with_components(simhash_rows(docs, id_column, text_column, shingle), max_bits, segments, bucket_limit)
    winners = rows.groupBy("root").agg(F.min(F.struct("k1", "k2")).alias("w")).select("w.k1", "w.k2")
    kept = packed(docs, id_column, text_column).join(winners, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return kept.select("row.*")

"""Line or paragraph dedup: normalise, hash, keep the earliest occurrence of a digest.

``unit="line"``: every line with a word is one unit.

``unit="paragraph"``: a text is cut into sentences (after ``.``, ``!`` or ``?``
before white space, and at line breaks), and from each sentence on the shortest
run of whole sentences with ``min_words`` words is a paragraph; a text of fewer
words is one paragraph.  Paragraphs overlap, so a passage is found wherever it
begins, inside a line too, and a stock sentence alone is no paragraph.

A unit is normalised (A-Z lower-cased, white space runs to one space, trimmed)
and hashed to 128 bits.  The occurrence with the least (rank, id, text hash,
number) stays; every other one is removed.  A sentence goes if any paragraph
over it does.  The offsets of what goes are those of the original text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import NULL_ID, fresh_name, id_of_key, keyed, packed, pin, with_gone

MIN_WORDS = 20
_SPACE = b" \t\n\x0b\x0c\r"
_SENTENCE_END = re.compile(rb"(?<=[.!?])[\x20\x09\x0B-\x0D]+")


def lines_of(raw: bytes) -> list[tuple[int, int]]:
    """Byte ranges of all lines, without their line breaks."""
    found, at = [], 0
    for line in raw.split(b"\n"):
        found.append((at, at + len(line)))
        at += len(line) + 1
    return found


def sentences_of(raw: bytes) -> list[tuple[int, int]]:
    """Byte ranges of the sentences that have a word, without white space around them."""
    found = []
    for begin, stop in lines_of(raw):
        at = begin
        for m in _SENTENCE_END.finditer(raw, begin, stop):
            found.append((at, m.start()))
            at = m.end()
        found.append((at, stop))
    trimmed = []
    for a, b in found:
        text = raw[a:b]
        a += len(text) - len(text.lstrip(_SPACE))
        text = text.strip(_SPACE)
        if text:
            trimmed.append((a, a + len(text)))
    return trimmed


def paragraphs_of(counts: list[int], min_words: int) -> list[int]:
    """Per sentence from which a paragraph starts, the sentence after its last; ``counts``: words of the sentences."""
    ends, stop, words = [], 0, 0
    for first, own in enumerate(counts):
        while stop < len(counts) and words < min_words:
            words += counts[stop]
            stop += 1
        if words < min_words:
            break
        ends.append(stop)
        words -= own
    return ends or ([len(counts)] if counts else [])


def normalise(unit: bytes) -> bytes:
    return b" ".join(unit.lower().split())


def parts_of(raw: bytes, unit: str, min_words: int) -> Iterator[tuple[int, bytes]]:
    """(number, normalised text) of the units that are hashed."""
    if unit == "line":
        for no, (a, b) in enumerate(lines_of(raw)):
            if plain := normalise(raw[a:b]):
                yield no, plain
        return
    plain = [normalise(raw[a:b]) for a, b in sentences_of(raw)]
    for first, stop in enumerate(paragraphs_of([p.count(b" ") + 1 for p in plain], min_words)):
        yield first, b" ".join(plain[first:stop])


_PARTS = "k1 long, k2 long, no array<int>, d1 array<long>, d2 array<long>"


def _digests(unit: str, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, numbers, heads, tails = batch.column("raw"), [], [], []
            for i in range(batch.num_rows):
                own = [(no, hashlib.md5(plain).digest()) for no, plain in parts_of(texts[i].as_buffer().to_pybytes(), unit, min_words)]
                numbers.append([no for no, _ in own])
                heads.append([int.from_bytes(d[:8], "big", signed=True) for _, d in own])
                tails.append([int.from_bytes(d[8:], "big", signed=True) for _, d in own])
            long_list = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1"), batch.column("k2"), pa.array(numbers, pa.list_(pa.int32())), pa.array(heads, long_list), pa.array(tails, long_list)],
                names=["k1", "k2", "no", "d1", "d2"])

    return run


_RESULT = "k1 long, n_units long, n_removed long, removed array<struct<begin:int,stop:int>>, kept string"


def _cuts(raw: bytes, gone: list[int], unit: str, min_words: int) -> tuple[int, list[tuple[int, int]], bytes]:
    """Number of units, ranges of those that go, and the rest of the text.

    A line goes with the line break after it (the last one with the one before),
    a sentence with the white space after it.
    """
    if unit == "line":
        units = lines_of(raw)
        cut = sorted(gone)
        ends = [min(units[no][1] + 1, len(raw)) for no in cut]
    else:
        units = sentences_of(raw)
        stops = paragraphs_of([len(raw[a:b].split()) for a, b in units], min_words)
        cut, last = [], 0
        for first in sorted(gone):
            cut.extend(range(max(first, last), stops[first]))
            last = max(last, stops[first])
        ends = [units[no + 1][0] if no + 1 < len(units) else len(raw) for no in cut]
    rest, at = [], 0
    for no, end in zip(cut, ends):
        rest.append(raw[at:units[no][0]])
        at = end
    text = b"".join(rest) + raw[at:]
    if unit == "line" and cut and cut[-1] == len(units) - 1 and text.endswith(b"\n"):
        text = text[:-1]
    return len(units), [units[no] for no in cut], text


def _drop(unit: str, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone_lists = batch.column("raw"), batch.column("gone").to_pylist()
            counts, removed, spans, kept = [], [], [], []
            for i in range(batch.num_rows):
                raw = texts[i].as_buffer().to_pybytes()
                n, cut, text = _cuts(raw, sorted(set(gone_lists[i] or [])), unit, min_words)
                counts.append(n)
                removed.append(len(cut))
                own, at, chars = [], 0, 0
                for a, b in cut:  # every byte is decoded once
                    begin = chars + len(raw[at:a].decode())
                    at, chars = b, begin + len(raw[a:b].decode())
                    own.append({"begin": begin, "stop": chars})
                spans.append(own)
                kept.append(text.decode())
            span = pa.list_(pa.struct([("begin", pa.int32()), ("stop", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string())],
                names=["k1", "n_units", "n_removed", "removed", "kept"])

    return run


def unit_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", unit: str = "paragraph",
               min_words: int = MIN_WORDS, rank: Column | None = None) -> DataFrame:
    """Per row: doc_id, n_units, n_removed, removed (character offsets in the original text), kept (the rest).

    Units are lines, blank ones too (which never go), or the sentences of which
    paragraphs consist.  A paragraph that repeats itself with an overlap (one
    sentence over and over) loses all but its first period.  ``rank``: a long
    column of ``docs``, least first, nulls last; by default the id decides.
    Null texts are empty.  Of rows that repeat id and text one comes first,
    with the least rank of them, and the others repeat its units; rows that
    share only the id are ordered by text hash; null ids come last.  An empty
    table gives an empty result.  Other columns are not read.
    """
    if unit not in ("line", "paragraph") or min_words < 1:
        raise ValueError("unit must be line or paragraph, min_words 1 or more")
    raw = F.col("text").cast("binary").alias("raw")
    base = keyed(docs, id_column, text_column).select("k1", "k2", raw)
    parts = pin(base.mapInArrow(_digests(unit, min_words), _PARTS))
    place = F.col("p")
    places = parts.select("k1", "k2", F.explode(F.arrays_zip("no", "d1", "d2")).alias("p")).select(
        "k1", "k2", place["no"].alias("no"), place["d1"].alias("d1"), place["d2"].alias("d2"))
    order = F.struct("k1", "k2", "no")
    if rank is not None:
        best = packed(docs.withColumn(fresh_name(docs, "rank_"), rank), id_column, text_column).select(
            "k1", "k2", F.coalesce(F.col("row").getField(fresh_name(docs, "rank_")).cast("long"), F.lit(NULL_ID)).alias("rank"))
        places = places.join(best.groupBy("k1", "k2").agg(F.min("rank").alias("rank")), ["k1", "k2"])
        order = F.struct("rank", "k1", "k2", "no")
    # pinned, so that the join has an exchange on either side and a frequent unit's places can be split among tasks
    first = pin(places.groupBy("d1", "d2").agg(F.min(order).alias("first"), F.max(order).alias("last")).filter("last > first").select("d1", "d2", "first"))
    gone = places.join(first, ["d1", "d2"]).filter(order > F.col("first")).groupBy("k1", "k2").agg(F.collect_list("no").alias("gone"))
    copies = pin(parts.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.first("no").alias("gone")).filter("n > 1").select("k1", "k2", "gone"))
    result = with_gone(base, gone, copies).select("k1", "raw", "gone").mapInArrow(_drop(unit, min_words), _RESULT)
    return result.select(id_of_key("k1").alias("doc_id"), "n_units", "n_removed", "removed", "kept")

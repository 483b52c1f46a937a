"""Compression classifier: zstandard dictionaries of good and bad text as a quality score.

A text that compresses better with the dictionary built from good text than
with the one built from bad text resembles good text.  The difference of the
two compressed sizes, divided by the raw size, is turned into a probability by
a logistic curve fitted on labelled rows that built neither dictionary.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import text_of

#: Texts are compressed block by block, so a long text does not become its own dictionary.
BLOCK = 4096
LEVEL = 3
#: Added to the raw size in the quotient, so a few bytes decide little about a very short text.
SHORT = 64
DICTIONARY_BYTES = 112_640


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; the raw sample text where there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


class SizeDifference:
    """(size with the bad dictionary - size with the good one) / (raw size + SHORT), over all blocks of a text."""

    def __init__(self, good: bytes, bad: bytes):
        self._pair = []
        for content in (good, bad):
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=LEVEL)
            self._pair.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False))

    def __call__(self, raw: bytes) -> float:
        good, bad = self._pair
        total = 0
        for at in range(0, len(raw), BLOCK):
            block = raw[at:at + BLOCK]
            total += len(bad.compress(block)) - len(good.compress(block))
        return total / (len(raw) + SHORT)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> tuple[float, float]:
    """Intercept and slope (Newton steps on the standardised input, slope lightly ridged)."""
    mean, scale = float(x.mean()), float(x.std()) or 1.0
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(2)
    penalty = np.array([1e-9, ridge])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        gradient = z.T @ (p - y) + penalty * w
        hessian = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-10:
            break
    return float(w[0] - w[1] * mean / scale), float(w[1] / scale)


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    intercept: float
    slope: float

    def score(self, text: Column) -> Column:
        """Probability of label 1 for a string column, whole texts (null as empty)."""
        model = self

        @F.pandas_udf("double")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            difference = SizeDifference(model.good, model.bad) if model.good and model.bad else (lambda raw: 0.0)
            for texts in batches:
                x = np.array([difference(t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"") for t in texts], float)
                yield pd.Series(1 / (1 + np.exp(-np.clip(model.intercept + model.slope * x, -35, 35))))

        return run(text)


def is_held_out(doc_id: Column) -> Column:
    """Rows whose labels the fit never sees (a null id is none of them)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_compression(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                    label_column: str = "quality", max_docs_per_class: int = 2000, max_chars: int = 8000) -> CompressionModel:
    """Fit on a bounded sample of labelled rows that are not held out.

    Bounds (of the sample only, never of what is scored): per class the
    ``max_docs_per_class`` ids that come first by hash among those with a text
    in ``docs``, of each one block of at most ``max_chars`` characters (a text
    of more is cut into such blocks and a hash of the id picks one); so at most
    4000 blocks reach the driver.
    Every second of them, by hash, builds a dictionary and the others fit the
    logistic curve.  Ids with both labels, or a null one, teach nothing; of rows
    that share an id the least block is taken.  A class without labelled text:
    every text scores the share of label 1 (one half without any label).
    """
    known = (
        labels.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("int").alias("y"))
        .filter(~is_held_out(F.col("id"))).groupBy("id").agg(
            F.min("y").alias("y"), F.max("y").alias("y2"), F.count_if(F.col("y").isNull()).alias("unsaid"))
        .filter("id IS NOT NULL AND y = y2 AND y IN (0, 1) AND unsaid = 0").select("id", "y", F.xxhash64("id").alias("turn"))
    )
    texts_of = docs.select(F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text")).filter("text <> ''")
    # narrow rows: only ids that have a text count against the bound
    there = known.join(texts_of.select("id").distinct(), "id")
    chosen = there.filter("y = 0").orderBy("turn").limit(max_docs_per_class).unionByName(
        there.filter("y = 1").orderBy("turn").limit(max_docs_per_class))
    blocks = F.ceil(F.length("text") / max_chars)
    block = F.substr(F.col("text"), (F.pmod("turn", blocks) * max_chars + 1).cast("int"), F.lit(max_chars))
    sample = (
        texts_of.join(F.broadcast(chosen), "id")  # at most 2 * max_docs_per_class rows
        .select("id", "y", "turn", block.alias("text"))
        .groupBy("id", "y", "turn").agg(F.min("text").alias("text"))
        .orderBy("turn").collect()
    )
    texts = {c: [r.text.encode("utf-8", "surrogatepass") for r in sample if r.y == c] for c in (0, 1)}
    if min(map(len, texts.values())) < 4:
        share = (len(texts[1]) + 1) / (len(sample) + 2)
        return CompressionModel(b"", b"", math.log(share / (1 - share)), 0.0)
    good, bad = _dictionary(texts[1][::2]), _dictionary(texts[0][::2])
    difference = SizeDifference(good, bad)
    x = [[difference(t) for t in texts[c][1::2]] for c in (0, 1)]
    # the sample is balanced, the labels are not: weigh the curve back to their shares
    shares = {r.y: r["count"] for r in known.groupBy("y").count().collect()}  # two rows
    intercept, slope = fit_logistic(np.array(x[0] + x[1]), np.repeat([0.0, 1.0], [len(x[0]), len(x[1])]))
    drift = math.log(shares[1] / shares[0]) - math.log(len(x[1]) / len(x[0]))
    return CompressionModel(good, bad, intercept + drift, slope)


def score_quality(docs: DataFrame, model: CompressionModel, id_column: str = "doc_id", text_column: str = "text",
                  threshold: float = 0.7) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted (1 if score >= threshold).

    The score sees the text alone.  Empty and null texts get the curve's value
    at difference zero.  One narrow pass; other columns are not read.
    """
    return (
        docs.select(F.col(id_column).alias("doc_id"), is_held_out(F.col(id_column)).alias("held_out"), model.score(text_of(text_column)).alias("score"))
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )


def keep_good(docs: DataFrame, model: CompressionModel, text_column: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows, with all their columns, that score at least ``threshold``."""
    return docs.filter(model.score(text_of(text_column)) >= threshold)

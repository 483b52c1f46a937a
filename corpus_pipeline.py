"""Training-corpus pipeline: the stages in order, each over all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chatloom.llm.decontaminate import decontaminate
from chatloom.llm.line_dedup import dedup_texts
from chatloom.llm.mixing import mix
from chatloom.llm.quality_classifier import fit_compression, keep_good
from chatloom.llm.queries import MAX_BITS, SHINGLE, WINDOW_WORDS
from chatloom.llm.simhash import keep_one_per_component
from chatloom.session import ensure_importable, read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents scored below 0.7 go."""
    return keep_good(docs, fit_compression(docs, read_table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: repeated chunks of lines leave the texts; n_chars follows."""
    return dedup_texts(docs, length_column="n_chars" if "n_chars" in docs.columns else None)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: one document of each SimHash component stays."""
    return keep_one_per_component(docs, shingle=SHINGLE, max_bits=MAX_BITS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: contaminated documents go."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"), size=WINDOW_WORDS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: every document as often as the mixture takes it."""
    return mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("mix_sources", mix_stage),
]

#: SQL cannot train zstandard dictionaries or hash shingles with XXH64; tested against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents table."""
    ensure_importable(spark)
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.session import checkpoint_dir, cut_lineage

#: A word: a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Stand-in for a null document id inside join keys: null ids sort last.
NULL_ID = (1 << 63) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Catalyst may inline a projected expression into the body of a higher-order
    function and so evaluate it once per element; a lambda variable cannot be
    inlined.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(column: str = "text") -> Column:
    """The text, with null read as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def keyed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(k1, k2, text)``: a never-null key of (id, text hash) and the whole text.

    Rows that repeat both the id and the text have the same key and count as
    one document; rows that share only the id are told apart, and ordered, by
    the text hash.  Only the named columns are read, so other columns cannot clash.
    """
    return docs.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(NULL_ID)).alias("k1"),
        F.xxhash64(text_of(text_column)).alias("k2"),
        text_of(text_column).alias("text"),
    )


def packed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(k1, k2, row)``: the key of ``keyed`` beside the whole row as one struct, so that no column can clash."""
    return docs.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(NULL_ID)).alias("k1"),
        F.xxhash64(text_of(text_column)).alias("k2"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )


def id_of_key(k1: str = "k1") -> Column:
    """The document id of a key (null for the null stand-in)."""
    return F.when(F.col(k1) != F.lit(NULL_ID), F.col(k1))


def pin(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: computed once, read by all consumers."""
    return cut_lineage(df)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back; like ``pin``, for columns that encode well."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def copies_of(places: DataFrame) -> DataFrame:
    """``(k1, k2, gone)``, pinned: of keys that several rows share, the numbers of all parts.

    ``places``: (k1, k2, no), one row per part of every row.
    """
    return pin(
        places.groupBy("k1", "k2", "no").count().filter("count > 1")
        .groupBy("k1", "k2").agg(F.collect_set("no").alias("gone")))


def with_gone(rows: DataFrame, gone: DataFrame, copies: DataFrame) -> DataFrame:
    """``rows`` (k1, k2, ..) with ``gone``, the numbers of the parts to remove.

    One row of a key loses what ``gone`` (k1, k2, gone) says; every further row
    of the key repeats it and loses all its parts, those in ``copies`` (as of
    ``copies_of``).  Only rows of repeated keys are numbered and pinned; a hot
    key is a skewed join with one row, no window.
    """
    if copies.isEmpty():
        return rows.join(gone, ["k1", "k2"], "left")
    keys = copies.select("k1", "k2")
    several = pin(rows.join(keys, ["k1", "k2"], "left_semi").withColumn("place", F.monotonically_increasing_id()))
    first = several.groupBy("k1", "k2").agg(F.min("place").alias("first"))
    numbered = several.join(first, ["k1", "k2"]).withColumn("later", F.col("place") > F.col("first")).drop("place", "first")
    marked = rows.join(keys, ["k1", "k2"], "left_anti").withColumn("later", F.lit(False)).unionByName(numbered)
    both = gone.withColumn("later", F.lit(False)).unionByName(copies.withColumn("later", F.lit(True)))
    return marked.join(both, ["k1", "k2", "later"], "left").drop("later")


def fresh_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until no column has that name (any case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted

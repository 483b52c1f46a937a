"""Embeddings and exact top-k cosine similarity.

``similar_topk`` is an exact blocked search: queries and corpus are hashed
into blocks, each (query block, corpus block) pair is one task that computes
its similarity matrix with numpy and keeps only the k best per query, and a
final per-query ranking merges at most k x corpus-blocks candidates.  No
pair set is materialised and neither side goes through the driver.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Callable
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CANDIDATE_SCHEMA = "qid string, cid string, similarity double"
CHUNK = 512  # query rows per similarity matrix inside a task
TILE = 2048  # corpus rows per similarity matrix
ENCODED_ROWS = 512  # texts whose vectors are held at once by a task


#: Characters between terms.
NOT_TERM = r"[^\p{L}\p{N}_]+"


@functools.lru_cache(maxsize=1 << 16)
def term_bucket(term: str, dim: int) -> int:
    return int(hashlib.md5(term.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) % dim


def _hashed_terms(dim: int) -> Callable[[pd.Series], pd.Series]:
    split = regex.compile(NOT_TERM).split

    def encode(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            buckets = [term_bucket(x, dim) for x in split(t.lower() if isinstance(t, str) else "") if x]
            counts = np.bincount(np.array(buckets, np.int64), minlength=dim).astype(float)
            norm = np.sqrt((counts * counts).sum())
            out.append((counts / norm if norm else counts).astype(np.float32))
        return pd.Series(out)

    return encode


def embed(df: DataFrame, text_col: str = "document", out: str = "embedding", dim: int = 384,
          encoder: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """Vector for each text.  Default: L2-normalised counts of lower-cased terms, hashed by
    MD5 into ``dim`` buckets (a text without terms has zeros).  A caller-supplied ``encoder``
    (pandas Series[str] -> Series[list[float]]) takes its place; either runs batch-wise through Arrow."""
    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    schema = StructType(df.schema.fields + [StructField(out, ArrayType(FloatType()))])
    encode = encoder or _hashed_terms(dim)

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), ENCODED_ROWS):
                part = pdf.iloc[at:at + ENCODED_ROWS].reset_index(drop=True)
                part[out] = encode(part[text_col]).map(lambda v: np.asarray(v, np.float32))
                yield part

    return df.mapInPandas(run, schema)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """A column of equally long vectors as one matrix of its own number type."""
    lengths = np.unique(vectors.value_lengths().to_numpy(zero_copy_only=False))
    if len(lengths) != 1 or np.isnan(lengths[0]):
        raise ValueError("vectors must be there and of one length")
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), int(lengths[0]))


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0, 1.0, norms)


def nearest_rows(qids: list, qm: np.ndarray, cids: list, cm: np.ndarray, k: int, chunk: int = CHUNK, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """(similarities, places in the corpus), a row of the k best per query (-inf: none); ties go to the least id.

    ``cids`` ascend.  Only ``tile`` corpus rows and ``chunk`` query rows are held as doubles, with their similarities.
    """
    spans: dict = {}
    for at, cid in enumerate(cids):
        spans[cid] = (spans[cid][0] if cid in spans else at, at + 1)
    best = np.full((len(qids), k), -np.inf)
    place = np.zeros((len(qids), k), np.int64)
    for start in range(0, len(cids), tile):
        c = _unit(cm[start:start + tile])
        kk = min(k, len(c))
        for lo in range(0, len(qids), chunk):
            sims = _unit(qm[lo:lo + chunk]) @ c.T
            # compared at 1e-9: products of equal vectors may differ in the last bits
            sims *= 1e9
            sims += 0.5
            np.floor(sims, out=sims)
            sims /= 1e9
            for row, qid in enumerate(qids[lo:lo + chunk]):  # a vector is not its own neighbour
                first, end = spans.get(qid, (0, 0))
                sims[row, max(0, first - start):max(0, end - start)] = -np.inf
            # Keep the kk best per query; where the last of them ties with others, the least ids.
            idx = np.argpartition(-sims, kk - 1, axis=1)[:, :kk]
            last = np.take_along_axis(sims, idx, axis=1).min(axis=1, keepdims=True)
            for r in np.flatnonzero((sims >= last).sum(axis=1) > kk):
                idx[r] = np.argsort(-sims[r], kind="stable")[:kk]
            both = np.concatenate([best[lo:lo + chunk], np.take_along_axis(sims, idx, axis=1)], axis=1)
            places = np.concatenate([place[lo:lo + chunk], idx + start], axis=1)
            order = np.lexsort((places, -both), axis=1)[:, :k]
            best[lo:lo + chunk] = np.take_along_axis(both, order, axis=1)
            place[lo:lo + chunk] = np.take_along_axis(places, order, axis=1)
    return best, place


def _block_topk(k: int, chunk: int = CHUNK):
    def fn(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts = ([], []), ([], [])
        for batch in batches:
            for side in (0, 1):
                own = batch.filter(pc.equal(batch.column("_side"), side))
                if own.num_rows:
                    ids[side].extend(own.column("_id").to_pylist())
                    parts[side].append(_matrix(own.column("_vec")))
        (qids, cids), (qm, cm) = ids, (np.concatenate(p) if p else None for p in parts)
        parts = None
        if qids and cids:
            by_id = sorted(range(len(cids)), key=lambda i: (cids[i] is not None, cids[i]))
            cids, cm = [cids[i] for i in by_id], cm[by_id]
            best, place = nearest_rows(qids, qm, cids, cm, k, chunk)
            rows, nth = np.nonzero(np.isfinite(best))
            yield pa.RecordBatch.from_arrays(
                [pa.array([qids[i] for i in rows], pa.string()), pa.array([cids[i] for i in place[rows, nth]], pa.string()), pa.array(best[rows, nth])],
                ["qid", "cid", "similarity"])

    return fn


def similar_topk(queries: DataFrame, corpus: DataFrame, k: int = 5, id_col: str = "id", vec_col: str = "embedding",
                 query_blocks: int | None = None, corpus_blocks: int | None = None,
                 block_rows: int = 16384, chunk: int = CHUNK) -> DataFrame:
    """The k nearest corpus rows of every query by cosine similarity (exact).

    Returns (qid, cid, similarity, rank) with rank 1..k; similarities are rounded to
    1e-9 and ties broken by cid.  Each
    task holds one query block and one corpus block of about ``block_rows`` rows at
    most, as Arrow has them, and multiplies 512 query rows by 2048 corpus rows at a time.  The work is the exact
    all-pairs product; for corpora too large for that, an approximate index is the
    tool (not built here).
    """
    spark = queries.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if query_blocks is None or corpus_blocks is None:
        # Blocks sized from the data so one task's inputs stay bounded as they grow.  The
        # corpus is copied once per query block and queries once per corpus block, so a
        # small query set (one block) never copies the corpus; the corpus side is spread
        # over at least the shuffle partitions.
        n_q, n_c = queries.count(), corpus.count()
        bq = query_blocks or max(1, math.ceil(n_q / block_rows))
        bc = corpus_blocks or max(1, min(max(1, n_c), max(parts // bq, math.ceil(n_c / block_rows))))
    else:
        bq, bc = query_blocks, corpus_blocks
    q = queries.select(F.col(id_col).cast("string").alias("_id"), F.col(vec_col).alias("_vec"))
    c = corpus.select(F.col(id_col).cast("string").alias("_id"), F.col(vec_col).alias("_vec"))
    # Each query row is needed by every corpus block and vice versa: replicate by block id.
    q_rep = q.select(
        "_id", "_vec", F.lit(0).alias("_side"),
        F.pmod(F.xxhash64("_id"), F.lit(bq)).alias("_qb"),
        F.explode(F.sequence(F.lit(0), F.lit(bc - 1))).alias("_cb"),
    )
    c_rep = c.select(
        "_id", "_vec", F.lit(1).alias("_side"),
        F.explode(F.sequence(F.lit(0), F.lit(bq - 1))).alias("_qb"),
        F.pmod(F.xxhash64("_id"), F.lit(bc)).alias("_cb"),
    )
    cands = q_rep.unionByName(c_rep).groupBy("_qb", "_cb").applyInArrow(_block_topk(k, chunk), CANDIDATE_SCHEMA)
    w = Window.partitionBy("qid").orderBy(F.col("similarity").desc(), F.col("cid").asc())
    return cands.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def context_prompts(requests: DataFrame, corpus: DataFrame, k: int = 3, id_col: str = "id",
                    text_col: str = "user_message", doc_col: str = "document") -> DataFrame:
    """Prepend the k most similar stored interactions as context to each request text."""
    hits = similar_topk(requests, corpus, k, id_col=id_col)
    docs = corpus.select(F.col(id_col).cast("string").alias("cid"), F.col(doc_col).alias("_doc"))
    ctx = (
        hits.join(docs, "cid")
        .groupBy("qid")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "_doc"))).alias("_ctx"))
        .select("qid", F.concat_ws("\n\n", F.transform("_ctx", lambda x: x["_doc"])).alias("context"))
    )
    base = requests.withColumn("qid", F.col(id_col).cast("string"))
    return base.join(ctx, "qid", "left").withColumn(
        "prompt",
        F.when(F.col("context").isNotNull(), F.concat(F.lit("Context:\n"), F.col("context"), F.lit("\n\nUser: "), F.col(text_col)))
        .otherwise(F.col(text_col)),
    ).drop("qid")

"""Exact top-k cosine similarity of sparse term vectors by an inverted index (J1 / J2 on terms).

Vectors are rows (id, term, w) with weights above 0 and length 1.  Of a query
only so many terms are looked up, rarest first, as its k-th best similarity
leaves undecided: what the other terms can still add is bounded by their weights
(Cauchy-Schwarz, and each term's largest weight in the corpus).  Frequent terms
weigh little, so most of their long lists are never read.  A task takes the corpus
as it lies, indexes one block of it at a time, and sums up similarities in memory
for one block of queries after another, which it reads from the shared folder;
neither the corpus nor the texts that meet are rows of a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatloom.operators.similarity import CANDIDATE_SCHEMA, NOT_TERM
from chatloom.sources.io import scratch_path

#: Entries of the index that a query reads at first, to learn how good its k-th best is at least.
PROBE = 2000
#: Rows (id, term, w) of a block of either side, about.
BLOCK_ENTRIES = 1_000_000
#: Words that are counted at once.
CHUNK_WORDS = 2_000_000
#: Rows that a task hands over at once.
OUT_ROWS = 50_000
#: Terms that one in so many texts of a block has are multiplied as a matrix, the most frequent ones.
DENSE_ONE_IN, DENSE_TERMS = 32, 1024
#: Similarities that are held at once, and entries of the index read for them.
TILE_CELLS, TILE_READ = 4_000_000, 200_000
#: One in so many blocks of the corpus tells at first how good the k best of a query are at least.
SOUND_ONE_IN = 12
#: Similarities are compared at this resolution.
GRAIN = 1e-9
#: Parts into which the terms of all texts are dealt to be counted, at most.
TERM_PARTS = 256
ASKED_SCHEMA = "qid string, terms array<string>, w array<double>, bound array<float>, probed int"


def term_weights(df: DataFrame, text_col: str, id_col: str = "id") -> DataFrame:
    """(id, term, w): lower-cased terms of every text, count x ln((N + 1) / (documents with the term + 1/2)), length 1.

    A text without terms has no rows; rows that share an id are one text.  Texts are
    counted and kept in chunks with a dictionary of terms each; only the dictionaries meet.
    """
    words = F.filter(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), NOT_TERM, -1), lambda w: w != "").alias("words")
    texts = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    total = df.select(id_col).distinct().count()
    once = F.lit(None).cast("array<bigint>").alias("n")
    twice = texts.groupBy("id").count().where("count > 1").select(F.col("id").alias("_id"))
    if twice.isEmpty():
        rows = texts.select("id", words, once)
    else:
        same = F.col("id").eqNullSafe(F.col("_id"))
        counts = texts.join(twice, same, "left_semi").select("id", F.explode(words).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("n"))
        whole = counts.groupBy("id").agg(F.collect_list(F.struct("term", "n")).alias("of")).select("id", F.col("of.term").alias("words"), F.col("of.n").alias("n"))
        rows = texts.join(twice, same, "left_anti").select("id", words, once).unionByName(whole)
    parts = min(TERM_PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    chunks = _kept(rows.mapInArrow(_counted(CHUNK_WORDS, parts), "chunk bigint, body binary, pieces array<binary>"), "term-counts")
    pieces = chunks.select("chunk", F.posexplode("pieces").alias("part", "piece"))
    everywhere = pieces.groupBy("part").applyInArrow(_summed, "chunk bigint, part int, docs binary")
    packed = _kept(chunks.select("chunk", "body").groupBy("chunk").cogroup(everywhere.groupBy("chunk")).applyInArrow(_with_docs(parts), "body binary, docs binary"), "term-weights")
    weights = packed.mapInArrow(_weighted(total), "id string, term string, w double")
    weights._chunks = packed, total  # the same rows for tasks that index them, without a row for each in between
    return weights


def _kept(df: DataFrame, name: str) -> DataFrame:
    """Pinned as Parquet: long tables of repeated ids and terms take several times less space than as a checkpoint."""
    return df.sparkSession.read.schema(df.schema).parquet(_kept_at(df, name))


def _kept_at(df: DataFrame, name: str) -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _of_about(batches: Iterator[pa.RecordBatch], lists: str, most: int) -> Iterator[pa.RecordBatch]:
    """Rows whose lists hold about ``most`` values together."""
    held, values = [], 0
    for batch in batches:
        ends = np.cumsum(_lengths(batch.column(lists)))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most - values, "right")))
            held.append(batch.slice(start, stop - start))
            values += ends[stop - 1] - before
            if values >= most or stop < batch.num_rows:
                yield _one(held)
                held, values = [], 0
            start = stop
    if held:
        yield _one(held)


def _pack(**lists: pa.Array) -> bytes:
    """Arrays of any lengths, compressed."""
    batch = pa.RecordBatch.from_pydict({name: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for name, x in lists.items()})
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def _unpack(packed: pa.Scalar) -> list[pa.Array]:
    return [x[0].values for x in pa.ipc.open_stream(packed.as_buffer()).read_next_batch().columns]


def _dealt(terms: pa.Array, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of terms part by part, and where the parts begin."""
    part = np.array([zlib.crc32(x) % parts for x in terms.cast(pa.binary()).to_pylist()], np.int64)
    return np.argsort(part, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])


def _counted(most: int, parts: int):
    """Rows (id, words, n) as chunks of about ``most`` words, and of each the (terms, texts with the term) by parts of the terms.

    n: how often each word is there, or null where words repeat.
    """
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for rows in _of_about(batches, "words", most):
            length = _lengths(rows.column("words"))
            words = rows.column("words").flatten().dictionary_encode()
            terms = words.dictionary
            if not len(words):
                continue
            key = np.repeat(np.arange(len(length)), length) * len(terms) + words.indices.to_numpy()
            if rows.column("n").null_count == len(length):
                key, count = np.unique(key, return_counts=True)
            else:
                each = np.ones(len(key))
                each[np.repeat(rows.column("n").is_valid().to_numpy(zero_copy_only=False), length)] = rows.column("n").flatten().to_numpy()
                key, place = np.unique(key, return_inverse=True)
                count = np.bincount(place, weights=each)
            text, term = key // len(terms), (key % len(terms)).astype(np.int32)
            sizes, docs = np.bincount(text, minlength=len(length)).astype(np.int32), np.bincount(term, minlength=len(terms)).astype(np.int32)
            body = _pack(ids=rows.column("id"), sizes=pa.array(sizes), steps=pa.array(np.diff(term, prepend=np.int32(0))), n=pa.array(count.astype(np.int32)), terms=terms)
            order, at = _dealt(terms, parts)
            pieces = [_pack(terms=terms.take(pa.array(x)), docs=pa.array(docs[x])) for x in np.split(order, at[1:-1])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int64()), pa.array([body], pa.binary()), pa.array([pieces], pa.list_(pa.binary()))], ["chunk", "body", "pieces"])
            chunk += 1

    return fn


def _summed(pieces: pa.Table) -> pa.Table:
    """The pieces of one part of the terms with ``docs`` of all chunks."""
    terms, docs = zip(*(_unpack(x) for x in pieces.column("piece")))
    term = pa.concat_arrays(terms).dictionary_encode().indices.to_numpy()
    whole = np.bincount(term, weights=np.concatenate([x.to_numpy() for x in docs]))[term].astype(np.int32)
    packed = [_pack(docs=pa.array(x)) for x in np.split(whole, np.cumsum([len(x) for x in docs])[:-1])]
    return pa.table({"chunk": pieces.column("chunk"), "part": pieces.column("part"), "docs": pa.array(packed, pa.binary())})


def _with_docs(parts: int):
    """A chunk with ``docs`` of all texts, which come as the pieces of its parts."""
    def fn(chunk: pa.Table, pieces: pa.Table) -> pa.Table:
        order, _ = _dealt(_unpack(chunk.column("body")[0])[4], parts)
        docs = np.empty(len(order), np.int32)
        docs[order] = np.concatenate([_unpack(x)[0].to_numpy() for x in pieces.sort_by("part").column("docs")])
        return pa.table({"body": chunk.column("body"), "docs": pa.array([_pack(docs=pa.array(docs))], pa.binary())})

    return fn


def _entries(batches: Iterator[pa.RecordBatch], total: int) -> Iterator[tuple[pa.DictionaryArray, pa.DictionaryArray, np.ndarray]]:
    """(ids, terms, weights) of the entries of every chunk whose ``docs`` are those of all texts."""
    for batch in batches:
        for at in range(batch.num_rows):
            ids, sizes, steps, n, terms = _unpack(batch.column("body")[at])
            term = np.cumsum(steps.to_numpy(), dtype=np.int32)
            text = np.repeat(np.arange(len(ids), dtype=np.int32), sizes.to_numpy())
            raw = n.to_numpy() * np.log((total + 1.0) / (_unpack(batch.column("docs")[at])[0].to_numpy() + 0.5))[term]
            norm = np.sqrt(np.bincount(text, weights=raw * raw, minlength=len(ids)))
            left = (raw > 0) & ids.is_valid().to_numpy(zero_copy_only=False)[text]
            text, term, raw = text[left], term[left], raw[left]
            there, text = np.unique(text, return_inverse=True)
            if len(raw):
                ids = ids.take(pa.array(there))
                yield pa.DictionaryArray.from_arrays(pa.array(text.astype(np.int32)), ids), pa.DictionaryArray.from_arrays(pa.array(term), terms), raw / norm[there][text]


def _weighted(total: int):
    """The rows (id, term, w) of chunks."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, terms, w in _entries(batches, total):
            for lo in range(0, len(w), OUT_ROWS):
                some = slice(lo, lo + OUT_ROWS)
                yield pa.RecordBatch.from_arrays([ids[some].dictionary_decode(), terms[some].dictionary_decode(), pa.array(w[some])], ["id", "term", "w"])

    return fn


def _frequencies(total: int):
    """(term, docs, top) of the entries of every chunk."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, terms, w in _entries(batches, total):
            term = terms.indices.to_numpy()
            top = np.zeros(len(terms.dictionary))
            np.maximum.at(top, term, w)
            docs = np.bincount(term, minlength=len(top))
            there = np.flatnonzero(docs)
            yield pa.RecordBatch.from_arrays([terms.dictionary.take(pa.array(there)), pa.array(docs[there]), pa.array(top[there])], ["term", "docs", "top"])

    return fn


def _places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of several runs one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _at(values: pa.Array, among: pa.Array) -> np.ndarray:
    """The place of every value, or -1."""
    return pc.fill_null(pc.index_in(values, value_set=among), -1).to_numpy()


class _Index:
    """A block's entries by term and by text, its texts in the order of their ids, and the most frequent terms as a matrix too."""

    def __init__(self, ids: pa.DictionaryArray, terms: pa.DictionaryArray, w: np.ndarray):
        order = pc.sort_indices(ids.dictionary)
        self.ids, self.terms = ids.dictionary.take(order), terms.dictionary
        self.n_texts, self.n_terms = len(self.ids), len(self.terms)
        number = np.empty(self.n_texts, np.int32)
        number[order.to_numpy()] = np.arange(self.n_texts, dtype=np.int32)
        text, term = number[ids.indices.to_numpy()], terms.indices.to_numpy()
        by = np.argsort(text, kind="stable")
        self.text_at = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.n_texts))])
        self.text_term, self.text_w = term[by], w[by]
        by = np.argsort(term, kind="stable")
        self.list_at = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=self.n_terms))])
        self.list_text, self.list_w = text[by], w[by]
        self.length = np.sqrt(np.bincount(text, weights=w * w).max())
        docs = np.diff(self.list_at)
        dense = np.argsort(-docs, kind="stable")[:DENSE_TERMS]
        dense = dense[docs[dense] * DENSE_ONE_IN >= self.n_texts]
        self.slot = np.full(self.n_terms, -1, np.int32)
        self.slot[dense] = np.arange(len(dense), dtype=np.int32)
        self.width = -(-self.n_texts // 16) * 16
        self.matrix = np.zeros((len(dense), self.width), np.float32)
        own = np.flatnonzero(self.slot[term] >= 0)
        np.add.at(self.matrix, (self.slot[term[own]], text[own]), w[own])

    def similarities(self, row: np.ndarray, term: np.ndarray, w: np.ndarray, rows: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(from row, to row, sums) of ``rows`` queries by the lists of their terms; ``row`` ascends."""
        edges = np.searchsorted(row, np.arange(rows + 1))
        length = np.diff(self.list_at)[term]
        reads = np.concatenate([[0], np.cumsum(length)])[edges]
        lo = 0
        while lo < rows:
            hi = max(lo + 1, int(np.searchsorted(reads, reads[lo] + TILE_READ, "right")) - 1)
            hi = min(hi, lo + max(1, TILE_CELLS // 4 // self.width), rows)
            some = slice(edges[lo], edges[hi])
            if reads[hi] > reads[lo]:
                read = _places(self.list_at[term[some]], length[some])
                cell = np.repeat((row[some] - lo) * self.width, length[some]) + self.list_text[read]
                sums = np.bincount(cell, weights=self.list_w[read] * np.repeat(w[some], length[some]), minlength=(hi - lo) * self.width)
                yield lo, hi, sums.reshape(hi - lo, self.width)
            lo = hi


class _Asked:
    """A block of queries, its entries ascending by query; of a query the first ``first`` terms are looked up."""

    def __init__(self, rows: pa.RecordBatch, first: str):
        self.ids, self.n = rows.column("qid"), rows.num_rows
        terms = rows.column("terms").flatten().dictionary_encode()
        self.terms, self.term, self.w = terms.dictionary, terms.indices.to_numpy(), rows.column("w").flatten().to_numpy()
        length = _lengths(rows.column("terms"))
        self.row = np.repeat(np.arange(self.n), length)
        self.needed = np.arange(len(self.row)) - np.repeat(np.cumsum(length) - length, length) < np.repeat(rows.column(first).to_numpy(), length)
        self.floor, self.rest = (rows.column(c).to_numpy() if c in rows.schema.names else np.zeros(self.n) for c in ("floor", "rest"))


def _probed(index: _Index, asked: _Asked, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, text, part): the k best of every query by its first terms alone."""
    term = _at(asked.terms, index.terms)[asked.term]
    own = np.flatnonzero(asked.needed & (term >= 0))
    row, term, w = asked.row[own], term[own], asked.w[own]
    length = np.diff(index.list_at)[term]
    read = _places(index.list_at[term], length)
    pair, place = np.unique(np.repeat(row, length) * index.n_texts + index.list_text[read], return_inverse=True)
    part = np.bincount(place, weights=index.list_w[read] * np.repeat(w, length), minlength=len(pair))
    query, text = pair // index.n_texts, pair % index.n_texts
    keep = np.flatnonzero((text != _at(asked.ids, index.ids)[query]) & (part > 0))
    keep = keep[np.lexsort((-part[keep], query[keep]))]
    keep = keep[np.arange(len(keep)) - np.searchsorted(query[keep], query[keep]) < k]
    return query[keep], text[keep], part[keep]


def _nearest(index: _Index, asked: _Asked, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, text, similarity): the k nearest texts of the block, as far as they can be among the k best of all.

    What a query's looked-up terms give is summed up for all texts, in single precision, which
    ``slack`` allows for; the texts that it does not exclude are then summed up over all terms.
    """
    term = _at(asked.terms, index.terms)[asked.term]
    there = np.flatnonzero(term >= 0)
    row, term, w, needed = asked.row[there], term[there], asked.w[there], asked.needed[there]
    itself, edges = _at(asked.ids, index.ids), np.searchsorted(row, np.arange(asked.n + 1))
    length = np.sqrt(np.bincount(row, weights=w * w, minlength=asked.n))
    weight = np.zeros(index.n_terms)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, TILE_CELLS // index.width)
    for lo in range(0, asked.n, step):
        hi = min(lo + step, asked.n)
        some = slice(edges[lo], edges[hi])
        own, slot, look = row[some] - lo, index.slot[term[some]], needed[some]
        part = np.zeros((hi - lo, index.width), np.float32)
        by_matrix = np.bincount(own[look & (slot >= 0)], minlength=hi - lo) > 0
        if by_matrix.any():
            which = np.flatnonzero((slot >= 0) & by_matrix[own])
            left = np.zeros((hi - lo, len(index.matrix)), np.float32)
            np.add.at(left, (own[which], slot[which]), w[some][which])
            if by_matrix.all():
                np.matmul(left, index.matrix, out=part)
            else:
                part[by_matrix] = left[by_matrix] @ index.matrix
        lists = np.flatnonzero(look & (slot < 0))
        for a, b, sums in index.similarities(own[lists], term[some][lists], w[some][lists], hi - lo):
            part[a:b] += sums
        at = np.flatnonzero(itself[lo:hi] >= 0)
        part[at, itself[lo:hi][at]] = 0.0
        # the k-th best of the highest of every 16 texts is at most the k-th best of all
        high = part.reshape(hi - lo, 16, -1).max(axis=1)
        kth = np.partition(high, high.shape[1] - k, axis=1)[:, high.shape[1] - k] if high.shape[1] >= k else np.zeros(hi - lo)
        passed = ~look & ~((slot >= 0) & by_matrix[own])
        rest = np.minimum(np.sqrt(np.bincount(own[passed], weights=w[some][passed] ** 2, minlength=hi - lo)) * max(1.0, index.length), asked.rest[lo:hi])
        slack = (DENSE_TERMS + 16) * 2.0**-23 * length[lo:hi] * index.length + 2 * GRAIN
        least = np.maximum(kth - slack, asked.floor[lo:hi]) - rest - slack
        queries, texts = np.nonzero(part >= np.maximum(least, np.finfo(np.float32).tiny).astype(np.float32)[:, None])
        by = np.lexsort((-part[queries, texts], queries))
        queries, texts = queries[by], texts[by]
        ends = np.searchsorted(queries, np.arange(hi - lo + 1))
        last = part[queries, texts][np.minimum(ends[:-1] + k - 1, ends[1:] - 1)[queries]]
        queries, texts = (x[part[queries, texts] >= np.where((ends[1:] - ends[:-1] >= k)[queries], last - (2 * slack + rest)[queries], 0)] for x in (queries, texts))
        ends = np.searchsorted(queries, np.arange(hi - lo + 1))
        for q in np.flatnonzero(np.diff(ends)):
            entries, near = slice(edges[lo + q], edges[lo + q + 1]), texts[ends[q]:ends[q + 1]]
            np.add.at(weight, term[entries], w[entries])
            size = index.text_at[near + 1] - index.text_at[near]
            read = _places(index.text_at[near], size)
            total = np.bincount(np.repeat(np.arange(len(near)), size), weights=index.text_w[read] * weight[index.text_term[read]], minlength=len(near))
            weight[term[entries]] = 0.0
            similarity = np.floor(total * 1e9 + 0.5) / 1e9
            best = np.lexsort((near, -similarity))[:k]
            found.append((np.full(len(best), lo + q), near[best], similarity[best]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _sounded(index: _Index, asked: _Asked, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, text, part) from which the k-th best can be told from below: by a query's first terms alone, in one of SOUND_ONE_IN blocks by all."""
    if zlib.crc32(index.ids[0].as_buffer()) % SOUND_ONE_IN:
        return _probed(index, asked, k)
    asked.needed[:] = True
    return _nearest(index, asked, k)


def _opened(spark: SparkSession, path: str) -> Callable[[], Iterator[pa.RecordBatch]]:
    """What lets a task read a pinned table from the shared folder; where only Spark's file systems open that, it goes by broadcast."""
    base = re.sub("^file:/*", "/", path)
    try:
        there = fs.FileSystem.from_uri(base)[0].get_file_info(fs.FileSystem.from_uri(base)[1]).type == fs.FileType.Directory
    except (pa.ArrowException, OSError):
        there = False
    if not there:
        table = spark.sparkContext.broadcast(spark.read.parquet(path).toArrow())
        return lambda: iter(table.value.to_batches(max_chunksize=1024))

    def read() -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(base)
        for x in sorted(store.get_file_info(fs.FileSelector(top)), key=lambda x: x.path):
            if x.path.endswith(".parquet"):
                with store.open_input_file(x.path) as file:
                    yield from pq.ParquetFile(file).iter_batches(batch_size=1024)

    return read


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.DictionaryArray, pa.DictionaryArray, np.ndarray]]:
    """(ids, terms, weights) of rows (id, term, w) in blocks of about ``most``; adjacent rows of an id stay together."""
    def block(held: list[tuple]) -> tuple[pa.DictionaryArray, pa.DictionaryArray, np.ndarray]:
        both = (pa.chunked_array([x[c] for x in held]).unify_dictionaries() for c in (0, 1))
        ids, terms = (pa.DictionaryArray.from_arrays(pa.concat_arrays([x.indices for x in y.chunks]), y.chunk(0).dictionary) for y in both)
        return ids, terms, np.concatenate([x[2] for x in held])

    def encoded(batch: pa.RecordBatch) -> tuple:
        return batch.column("id").dictionary_encode(), batch.column("term").dictionary_encode(), batch.column("w").to_numpy().copy()

    held, rows = [], 0
    for batch in batches:
        if rows >= most:  # as soon as another id begins
            other = np.flatnonzero(pc.not_equal(batch.column("id"), last).to_numpy(zero_copy_only=False))
            if len(other):
                yield block([*held, encoded(batch.slice(0, other[0]))] if other[0] else held)
                held, rows, batch = [], 0, batch.slice(other[0])
        held.append(encoded(batch))
        rows += batch.num_rows
        last = batch.column("id")[-1]
    if rows:
        yield block(held)


def _against(blocks: Callable, queries: Callable[[], Iterator[pa.RecordBatch]], first: str, k: int, find: Callable, most: int):
    """(qid, cid, number) that ``find`` finds for every block of queries in every block of the corpus, and (null, id, null) for the ids of a block."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["qid", "cid", "similarity"]
        for block in blocks(batches):
            index = _Index(*block)
            yield pa.RecordBatch.from_arrays([pa.nulls(index.n_texts, pa.string()), index.ids, pa.nulls(index.n_texts, pa.float64())], names)
            for rows in _of_about(queries(), "terms", most):
                asked = _Asked(rows, first)
                query, text, number = find(index, asked, k)
                yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(query)), index.ids.take(pa.array(text)), pa.array(number, pa.float64())], names)

    return fn


def _bounded(probe: int):
    """Queries with ``bound``, the most that a term and those after it can add, and how many terms are ``probed``: those read within ``probe`` entries."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = _lengths(batch.column("terms"))
            ends = np.cumsum(length)
            row = np.repeat(np.arange(len(length)), length)
            terms = batch.column("terms").flatten()
            w, docs, top = (batch.column(c).flatten().to_numpy() for c in ("w", "docs", "top"))
            by = np.lexsort((pc.rank(terms, tiebreaker="dense").to_numpy(), docs, row))  # rarest first
            terms, w, docs, top = terms.take(pa.array(by)), w[by], docs[by], top[by]
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())

            def onward(x: np.ndarray) -> np.ndarray:
                after = np.concatenate([np.cumsum(x[::-1])[::-1], [0.0]])
                return np.maximum(after[:-1] - after[ends][row], x)

            # the sums of a batch may have lost digits, so they count as a little more
            bound = np.minimum(np.sqrt(onward(w * w) + 1e-9), onward(w * top) + 1e-9).astype(np.float32)
            read = np.cumsum(docs)
            probed = np.bincount(row[read - np.concatenate([[0], read])[ends - length][row] <= probe], minlength=len(length)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("qid"), *(pa.ListArray.from_arrays(offsets, x) for x in (terms, pa.array(w), pa.array(np.nextafter(bound, np.float32(np.inf))))), pa.array(probed)],
                ["qid", "terms", "w", "bound", "probed"])

    return fn


def _undecided(queries: DataFrame, corpus: DataFrame, k: int, probe: int) -> str:
    """Where (qid, terms, w, needed, floor, rest) is pinned, terms ascending by frequency: the first ``needed`` of them are undecided."""
    spark = corpus.sparkSession
    chunks, blocks = _as_blocks(corpus)
    if "_chunks" in vars(corpus):
        index = chunks.mapInArrow(_frequencies(corpus._chunks[1]), "term string, docs bigint, top double").groupBy("term").agg(F.sum("docs").alias("docs"), F.max("top").alias("top"))
    else:
        index = corpus.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.max("w").alias("top"))
    met = queries.where("id is not null").select(F.col("id").alias("qid"), "term", "w").join(index, "term")
    lists = met.groupBy("qid").agg(F.collect_list(F.struct("docs", "term", "w", "top")).alias("of"))
    ranked = _kept_at(lists.select("qid", F.col("of.term").alias("terms"), F.col("of.w").alias("w"), F.col("of.docs").alias("docs"), F.col("of.top").alias("top"))
                      .mapInArrow(_bounded(probe), ASKED_SCHEMA), "asked")
    # what the rarest terms alone give is less than the whole similarity: its k-th largest bounds the k-th best from below
    found = chunks.mapInArrow(_against(blocks, _opened(spark, ranked), "probed", k, _sounded, BLOCK_ENTRIES), CANDIDATE_SCHEMA).where("qid is not null")
    partial = found.groupBy("qid", "cid").agg(F.sum("similarity").alias("part"))
    kth = partial.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("part").desc()))).where(F.col("place") == k)
    known = spark.read.parquet(ranked).join(kth.select("qid", F.col("part").alias("floor")), "qid", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    needed = F.size(F.filter("bound", lambda x: x >= F.col("floor") - 2 * GRAIN))
    return _kept_at(known.withColumn("needed", needed).select(
        "qid", "terms", "w", "needed", "floor", F.coalesce(F.try_element_at("bound", F.col("needed") + 1).cast("double"), F.lit(0.0)).alias("rest")), "undecided")


def _as_blocks(corpus: DataFrame) -> tuple[DataFrame, Callable]:
    """A frame, and what makes the blocks of its batches: the chunks behind ``term_weights``, or rows (id, term, w) as they lie."""
    if "_chunks" in vars(corpus):
        chunks, total = corpus._chunks
        return chunks, lambda batches: _entries(batches, total)
    return _as_rows(corpus)


def _as_rows(corpus: DataFrame) -> tuple[DataFrame, Callable]:
    most = BLOCK_ENTRIES
    return corpus.where("id is not null and term is not null").select("id", "term", "w"), lambda batches: _blocks(batches, most)


def undecided_terms(queries: DataFrame, corpus: DataFrame, k: int, probe: int = PROBE) -> DataFrame:
    """(qid, term, w, needed, floor, rest), pinned: a query's terms, and whether a text that shares none before it could still be among the k best.

    ``floor``: a lower bound of the k-th best similarity; ``rest``: the most
    that the terms that are not needed can add.
    """
    terms = queries.sparkSession.read.parquet(_undecided(queries, corpus, k, probe))
    return terms.select("qid", F.posexplode(F.arrays_zip("terms", "w")).alias("at", "of"), "needed", "floor", "rest").select(
        "qid", F.col("of.terms").alias("term"), F.col("of.w").alias("w"), (F.col("at") < F.col("needed")).alias("needed"), "floor", "rest")


def sparse_topk(queries: DataFrame, corpus: DataFrame, k: int = 5, probe: int = PROBE) -> DataFrame:
    """(qid, cid, similarity, rank): the k nearest of ``corpus`` for every query, exact, itself left out.

    Both sides are rows (id, term, w) as of ``term_weights``.  Only texts that share a term
    have a similarity; a query with fewer than k of them has fewer results.  Similarities are
    rounded to 1e-9 and ties broken by cid, as in ``similar_topk``.
    """
    spark = corpus.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = _opened(spark, _undecided(queries, corpus, k, probe))

    def near(rows: DataFrame, blocks: Callable) -> DataFrame:
        return _kept(rows.mapInArrow(_against(blocks, asked, "needed", k, _nearest, BLOCK_ENTRIES), CANDIDATE_SCHEMA), "candidates")

    found = near(*_as_blocks(corpus))
    if not found.where("qid is null").groupBy("cid").count().where("count > 1").isEmpty():  # rows of a text lay in several blocks
        rows, blocks = _as_rows(corpus)
        found = near(rows.repartition(parts, "id").sortWithinPartitions("id"), blocks)
    some = F.pmod(F.xxhash64("qid"), F.lit(parts)).alias("_some")
    return found.where("qid is not null").groupBy(some).applyInArrow(_best(k), f"{CANDIDATE_SCHEMA}, rank int")


def _best(k: int):
    """The k best of every query."""
    def fn(rows: pa.Table) -> pa.Table:
        rows = rows.select(["qid", "cid", "similarity"]).sort_by([("qid", "ascending"), ("similarity", "descending"), ("cid", "ascending")]).combine_chunks()
        number = rows.column("qid").combine_chunks().dictionary_encode().indices.to_numpy()
        rank = np.arange(len(number)) - np.searchsorted(number, number) + 1
        return rows.append_column("rank", pa.array(rank.astype(np.int32))).filter(pa.array(rank <= k))

    return fn


def pairs_examined(queries: DataFrame, corpus: DataFrame, k: int = 5, probe: int = PROBE) -> tuple[int, int]:
    """Index entries read for the needed terms, and those that all terms would have read."""
    terms = undecided_terms(queries, corpus, k, probe)
    met = terms.join(corpus.groupBy("term").agg(F.count(F.lit(1)).alias("docs")), "term")
    row = met.agg(F.sum(F.when(F.col("needed"), F.col("docs"))), F.sum("docs")).first()
    return int(row[0] or 0), int(row[1] or 0)

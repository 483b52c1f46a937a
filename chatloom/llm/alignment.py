"""Cross-tokenizer alignment with exact-text deduplication.

Documents are shuffled by their full text, every distinct text is tokenised by
two tokenizers and aligned once, and what it adds to corpus-wide pair counts is
weighted by its number of copies.  The measures then join the documents by the
text's digest.

A group lies between byte offsets at which tokens of both tokenizers end; the
tokens of a group are linked all with all.  The count of an id pair is the
number of documents that hold it linked.

Corpus-wide counts meet the texts again in two steps that need no switch: pairs
of at least a threshold count, at most ``common_pairs`` of them whatever the
corpus, are broadcast; the others, of which none is frequent, are joined by a
shuffle.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import pin, stored

#: Links expanded at once while a text is aligned; a text of more is worked off in slices.
SLICE_LINKS = 1 << 20
#: Distinct pairs in one row of the table of aligned texts; a text of more has several rows.
ROW_PAIRS = 1 << 16
#: Pairs in one Arrow batch from a worker.
BATCH_PAIRS = 1 << 19


def _default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_level_bytes(token: str) -> bytes:
    """Bytes of a byte-level BPE token: printable Latin-1 characters stand for themselves, the others follow 255 in order."""
    return bytes(_BYTE_OF[c] for c in token)


def _byte_of() -> dict[str, int]:
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


_BYTE_OF = _byte_of()


#: The pattern with which byte-level BPE of this kind splits a text before merging (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteLevel:
    """A byte-level BPE of a ``tokenizers`` file; special tokens in a text are plain text.

    Where the merges are numbered in their order, an id is its merge's rank, and
    tiktoken's faster engine gives the same tokens from the file's vocabulary.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            description = json.load(file)
        vocabulary, merges = description["model"]["vocab"], description["model"]["merges"]
        special = {t["content"] for t in description["added_tokens"]}
        self.token_bytes = [b""] * (max([*vocabulary.values(), *(t["id"] for t in description["added_tokens"])]) + 1)
        for token, i in vocabulary.items():
            self.token_bytes[i] = token.encode() if token in special else byte_level_bytes(token)
        first = len(vocabulary.keys() - special) - len(merges)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in merges)
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if description["normalizer"] is None and plain.items() <= (description["pre_tokenizer"] or {}).items() and all(
                vocabulary.get(x + y) == first + k for k, (x, y) in enumerate(pairs)):
            import tiktoken

            ranks = {self.token_bytes[i]: i for token, i in vocabulary.items() if token not in special}
            ordinary = tiktoken.Encoding("byte_level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self._encode = lambda texts: [ordinary(t) for t in texts]
        else:
            self._encode = plain_encode(path)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._encode([" " + t for t in texts])


def plain_encode(path: str) -> Callable[[list[str]], list[list[int]]]:
    """The ``tokenizers`` library's own encoding of a file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """A sentencepiece model (which adds the space in front itself)."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self._model = SentencePieceProcessor(model_file=path)
        self.token_bytes = [self._bytes(i) for i in range(self._model.get_piece_size())]

    def _bytes(self, i: int) -> bytes:
        piece = self._model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self._model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


def linked_pairs(a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct id pairs ``a << 32 | b`` of tokens in the same group, ascending, and how many occurrences each links.

    Groups are worked off in slices of at most ``SLICE_LINKS`` links; a single
    group of more is expanded over its distinct ids.
    """
    count_a, count_b = np.bincount(group_a), np.bincount(group_b)
    links = count_a * count_b
    if links.sum() <= SLICE_LINKS:
        return _expand(a, group_a, b, count_b)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    before = np.cumsum(links) - links
    at_a, at_b = np.concatenate([[0], np.cumsum(count_a)]), np.concatenate([[0], np.cumsum(count_b)])
    first = 0
    while first < len(links):
        last = max(first + 1, int(np.searchsorted(before, before[first] + SLICE_LINKS)) - 1)
        own_a, own_b = a[at_a[first]:at_a[last]], b[at_b[first]:at_b[last]]
        if links[first:last].sum() > SLICE_LINKS:  # one group
            ids_a, n_a = np.unique(own_a, return_counts=True)
            ids_b, n_b = np.unique(own_b, return_counts=True)
            rows = max(1, SLICE_LINKS // len(ids_b))
            for i in range(0, len(ids_a), rows):
                keys = (ids_a[i:i + rows, None].astype(np.int64) << 32 | ids_b[None, :]).ravel()
                found.append((keys, (n_a[i:i + rows, None] * n_b[None, :]).ravel()))
        else:
            found.append(_expand(own_a, group_a[at_a[first]:at_a[last]] - first, own_b, count_b[first:last]))
        first = last
    keys, where = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(where, weights=np.concatenate([n for _, n in found])).astype(np.int64)


def _expand(a: np.ndarray, group_a: np.ndarray, b: np.ndarray, count_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    partners = count_b[group_a]
    start = (np.cumsum(count_b) - count_b)[group_a]
    step = np.arange(partners.sum()) - np.repeat(np.cumsum(partners) - partners, partners)
    keys = np.repeat(a.astype(np.int64), partners) << 32 | b[np.repeat(start, partners) + step]
    return np.unique(keys, return_counts=True)


class Aligner:
    """Aligns whole texts with tokenizers A and B (objects with ``encode`` and ``token_bytes``)."""

    def __init__(self, a, b):
        self.a, self.b = a, b
        self._length = [np.array([len(t) for t in x.token_bytes], np.int64) for x in (a, b)]
        width = len(str(max(len(a.token_bytes), len(b.token_bytes)))) + 1
        self._print = [np.array([f"{i}{end}" for i in range(len(x.token_bytes)) for end in (",", stop)], f"S{width}")
                       for x, stop in ((a, "|"), (b, ";"))]

    def __call__(self, texts: list[str]) -> Iterator[tuple | None]:
        """Per text ``(n_a, n_b, n_groups, n_links, groups_sha256, pairs, weights)``, or None where the bytes of a side differ from the text's."""
        for text, ids_a, ids_b in zip(texts, self.a.encode(texts), self.b.encode(texts)):
            raw = b" " + text.encode()
            side_a, side_b = self.a.token_bytes, self.b.token_bytes
            same = b"".join([side_a[i] for i in ids_a]) == raw and b"".join([side_b[i] for i in ids_b]) == raw
            yield self.align(np.array(ids_a, np.int64), np.array(ids_b, np.int64), len(raw)) if same else None

    def align(self, a: np.ndarray, b: np.ndarray, n_bytes: int) -> tuple:
        end_a, end_b = np.cumsum(self._length[0][a]), np.cumsum(self._length[1][b])
        ends = np.zeros(n_bytes + 1, np.int8)
        ends[end_a] = 1
        ends[end_b] += 1
        cut_a, cut_b = ends[end_a] == 2, ends[end_b] == 2  # the token ends its group
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        count_a, count_b = np.bincount(group_a), np.bincount(group_b)
        text = np.empty(len(a) + len(b), self._print[0].dtype)
        text[np.arange(len(a)) + (np.cumsum(count_b) - count_b)[group_a]] = self._print[0][2 * a + cut_a]
        text[np.arange(len(b)) + np.cumsum(count_a)[group_b]] = self._print[1][2 * b + cut_b]
        digest = hashlib.sha256(text.tobytes().replace(b"\0", b"")[:-1]).hexdigest()
        pairs, weights = linked_pairs(a, group_a, b, group_b)
        return len(a), len(b), len(count_a), int((count_a * count_b).sum()), digest, pairs, weights


_ALIGNED = "key binary, n long, part int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, weights array<int>"


def _align(make: Callable[[], tuple]):
    """Rows of (key, n, text) -> one row of measures and pairs per text, and more rows where it has over ``ROW_PAIRS`` pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, rows, held = Aligner(*make()), [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64).to_pydict()
                for key, n, found in zip(some["key"], some["n"], aligner(some["text"])):
                    if found is None:
                        continue
                    *measures, pairs, weights = found
                    for part, first in enumerate(range(0, max(1, len(pairs)), ROW_PAIRS)):
                        chunk = slice(first, first + ROW_PAIRS)
                        rows.append((key, n, part, *(measures if part == 0 else [None] * 5), pairs[chunk], weights[chunk]))
                        held += len(rows[-1][-1])
                        if held >= BATCH_PAIRS:
                            yield _batch(rows)
                            rows, held = [], 0
        if rows:
            yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    flat = [pa.array(c, k) for c, k in zip(columns, kinds)]
    ends = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in columns[8]])]), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(c).astype(k))) for c, k in ((columns[8], np.int64), (columns[9], np.int32))]
    return pa.RecordBatch.from_arrays(flat + lists, names=[f.split()[0] for f in _ALIGNED.split(", ")])


def text_key(text: Column) -> Column:
    """Digest of a text that has one; null for a null or empty text."""
    return F.when(F.length(text) > 0, F.unhex(F.sha2(text.cast("binary"), 256)))


def aligned_texts(docs: DataFrame, text_column: str, make: Callable[[], tuple]) -> DataFrame:
    """Every distinct text with its number of documents, measures and linked pairs (``_ALIGNED``), stored (pairs repeat, so the columns' dictionaries keep them small)."""
    text = F.col(f"`{text_column}`").cast("string")
    distinct = docs.select(text.alias("text")).filter(F.length("text") > 0).groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    return stored(distinct.select(text_key(F.col("text")).alias("key"), "n", "text").mapInArrow(_align(make), _ALIGNED))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(pair, count, best)``, pinned: in how many documents a pair is linked, and whether no other pair of its A id has more.

    A window of one A id holds at most as many rows as B has ids.
    """
    from pyspark.sql import Window

    counts = aligned.select("n", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("n").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.shiftright("pair", 32)))
    return pin(counts.select("pair", "count", (F.col("count") == most).alias("best")))


def common_from(counts: DataFrame, most: int) -> int:
    """The least power of two such that at most ``most`` pairs have that count or more (a histogram of at most 64 rows reaches the driver)."""
    sizes = {r["power"]: r["count"] for r in counts.groupBy(F.floor(F.log2("count")).cast("int").alias("power")).count().collect()}
    power = max(sizes, default=0) + 1
    while power > 0 and sizes.get(power - 1, 0) + sum(n for p, n in sizes.items() if p >= power) <= most:
        power -= 1
    return 1 << power


def _sums(links: DataFrame) -> DataFrame:
    weight = F.col("weight").cast("long")
    return links.groupBy("key").agg(F.sum(F.when(F.col("best"), weight).otherwise(0)).alias("n_best"), F.sum(weight * F.col("count")).alias("count_sum"))


def cross_tokenizer_alignment(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path_a: str | None = None,
                              path_b: str | None = None, make: Callable[[], tuple] | None = None, common_pairs: int = 200_000) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``path_a``: a byte-level BPE file of ``tokenizers``; ``path_b``: a
    sentencepiece model; both must be readable on every executor.  ``make``
    gives other tokenizers instead.  A null or empty text, and one whose tokens
    do not spell a space and the text, has zeros and an empty groups_sha256,
    and adds to no count.  Rows that repeat a text count as often as they
    occur; ids may repeat or be null.  An empty table gives an empty result.
    Other columns are not read.
    """
    if make is None:
        a, b = path_a or _default_path("byte_bpe_50k.json"), path_b or _default_path("piece_bpe_32k.model")

        def make() -> tuple:
            return ByteLevel(a), Pieces(b)

    aligned = aligned_texts(docs, text_column, make)
    counts = pair_counts(aligned)
    least = common_from(counts, common_pairs)
    links = aligned.select("key", F.explode(F.arrays_zip("pairs", "weights")).alias("l")).select("key", F.col("l.pairs").alias("pair"), F.col("l.weights").alias("weight"))
    common = F.broadcast(counts.filter(F.col("count") >= least))  # at most common_pairs rows
    rare = counts.filter(F.col("count") < least)
    often = _sums(links.join(common, "pair"))
    seldom = _sums(links.join(common.select("pair"), "pair", "left_anti").join(rare, "pair"))
    names = ["n_a", "n_b", "n_groups", "n_links"]
    own = aligned.filter("part = 0").select("key", *names, "groups_sha256")
    blank = [F.lit(None).cast("long").alias(c) for c in names] + [F.lit(None).cast("string").alias("groups_sha256")]
    none = [F.lit(0).cast("long").alias(c) for c in ("n_best", "count_sum")]
    parts = own.select("*", *none).unionByName(often.select("key", *blank, "n_best", "count_sum")).unionByName(seldom.select("key", *blank, "n_best", "count_sum"))
    measures = pin(parts.groupBy("key").agg(*[F.max(c).alias(c) for c in [*names, "groups_sha256"]], *[F.sum(c).alias(c) for c in ("n_best", "count_sum")]))
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), text_key(F.col(f"`{text_column}`").cast("string")).alias("key"))
    return rows.join(measures, "key", "left").select(
        "doc_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in [*names, "n_best", "count_sum"]], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))

"""Convolutional toxicity classifier: hashed word embeddings, filters of several widths, max pooling; trained in numpy.

A text is the sequence of its words; a word's vector is the sum of the rows that
its own hash and the hashes of its beginnings and endings choose in an embedding
table, so an unseen word is placed by its stem and ending.  Filters of one, two and three words run over the whole text,
each keeps its largest response, and a linear layer on these gives a logit.
The threshold on the logit is calibrated for each language, which is told from
the text's own function words, on labelled texts that trained no weight; the
score is the logistic curve around that threshold.
"""

from __future__ import annotations

import collections
import functools
import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import pin, text_of

WIDTHS = (1, 2, 3)
BUCKETS = 1 << 16
DIMENSION = 16
FILTERS = 12
#: Lengths of the beginnings and endings of a word that are hashed beside the word itself.
BEGINNINGS, ENDINGS = (4, 5, 6, 7), (4,)
PARTS = 1 + len(BEGINNINGS) + len(ENDINGS)
#: A bucket teaches and counts only if it occurs in so many training texts; other buckets have the zero vector.
LEAST_TEXTS = 3
#: Words of a text, or texts, that are scored at once (bounds memory; windows reach over the cut).
SEGMENT_WORDS, BATCH_WORDS, TEXTS_AT_ONCE = 50_000, 200_000, 512
_WORDS = re.compile(r"[^\W_]+")
# Frequent function words by language, most of which no other listed language has.
FUNCTION_WORDS = {
    "en": "the of and to in is it that was for are with as he be on this by not at from which",
    "de": "der die das und ist nicht ein eine zu den von mit dem des sich auf auch als im werden",
    "fr": "le la les et des du est une dans que qui pour pas sur au par avec ce il sont",
    "es": "el los las y del se un por con una su para es al lo como más pero sus fue",
    "it": "il di che è per non sono della nel gli alla con come anche più dei questo degli ha lo",
    "pt": "o os as e do da em um uma não com para dos ao mais se na foi pela pelo",
    "nl": "de het een van en dat niet op te met voor zijn aan er ook als bij naar nog wordt",
}
LANGUAGES = (*FUNCTION_WORDS, "other")
_LANGUAGE_SETS: dict[str, int] = {}
for _bit, _line in enumerate(FUNCTION_WORDS.values()):
    for _word in _line.split():
        _LANGUAGE_SETS[_word] = _LANGUAGE_SETS.get(_word, 0) | 1 << _bit


@functools.lru_cache(maxsize=1 << 18)
def buckets_of(word: str) -> tuple[int, ...]:
    """``PARTS`` buckets of a word (0: no such part): the word, its beginnings, its endings."""
    parts = [word] + [f"{word[:n]}-" if len(word) > n else "" for n in BEGINNINGS] + [f"-{word[-n:]}" if len(word) > n else "" for n in ENDINGS]
    return tuple(1 + zlib.crc32(p.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) if p else 0 for p in parts)


def numbered_words(texts: list[str], buckets: Callable[[str], tuple[int, ...]] = buckets_of) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Texts as numbers of their distinct words; the words' buckets (a row each) and sets of languages."""
    numbers: dict[str, int] = collections.defaultdict(lambda: len(numbers))
    own = [np.array([numbers[w] for w in _WORDS.findall(t.lower())], np.int64) for t in texts]
    parts = np.array([buckets(w) for w in numbers], np.int64).reshape(-1, PARTS)
    return own, parts, np.array([_LANGUAGE_SETS.get(w, 0) for w in numbers], np.int64)


def language_of(sets: np.ndarray) -> int:
    """The language with the most function words (the first of equals; ``other`` without any)."""
    sets = sets[sets > 0]
    counts = [int(np.count_nonzero(sets & (1 << bit))) for bit in range(len(FUNCTION_WORDS))]
    return counts.index(max(counts)) if max(counts) else len(FUNCTION_WORDS)


def pooled(texts: list[np.ndarray], tables: list[list[np.ndarray]], biases: list[np.ndarray]) -> np.ndarray:
    """Per text (word numbers) the largest response (zero at least) of every filter, whole texts in bounded pieces.

    ``tables``: per width and position the response of every word to every
    filter; a window's response is a sum of their rows.
    """
    out = np.zeros((len(texts), sum(len(b) for b in biases)), np.float32)
    reach, blank = max(WIDTHS) - 1, len(tables[0][0]) - 1  # the last row is that of no word
    pieces: list[tuple[int, np.ndarray, int]] = []  # text, its words with what the last windows reach, number of windows
    held = 0

    def flush() -> None:
        nonlocal held
        if not pieces:
            return
        flat = np.concatenate([p for _, p, _ in pieces])
        starts = np.cumsum([0, *(len(p) for _, p, _ in pieces[:-1])])
        outside = np.zeros(len(flat), bool)
        for (_, p, n), start in zip(pieces, starts):
            outside[start + n:start + len(p)] = True
        best = []
        for of_width, bias in zip(tables, biases):
            response = of_width[0][flat] + bias
            for j, table in enumerate(of_width[1:], 1):
                response[:len(flat) - j] += table[flat[j:]]
            response[outside] = 0
            best.append(np.maximum.reduceat(response, starts, axis=0))
        np.maximum.at(out, [i for i, _, _ in pieces], np.concatenate(best, axis=1))
        pieces.clear()
        held = 0

    for i, own in enumerate(texts):
        for at in range(0, len(own), SEGMENT_WORDS):
            piece = own[at:at + SEGMENT_WORDS + reach]
            n = min(SEGMENT_WORDS, len(own) - at)
            pieces.append((i, np.concatenate([piece, np.full(n + reach - len(piece), blank)]), n))
            held += len(pieces[-1][1])
            if held >= BATCH_WORDS:
                flush()
    flush()
    return out


@dataclass
class ConvolutionModel:
    """Trained weights; ``thresholds`` by language in the order of ``LANGUAGES``."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    dense: np.ndarray
    intercept: float
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))

    def responses(self, parts: np.ndarray) -> np.ndarray:
        """Of every word (a row of its parts' buckets) to every filter position, side by side."""
        flat = np.concatenate([f[j] for f in self.filters for j in range(len(f))], axis=1)
        return np.concatenate([self.embedding[parts[at:at + 8192]].sum(axis=1) @ flat for at in range(0, len(parts), 8192)] or [flat[:0]])

    def logits(self, texts: list[np.ndarray], responses: np.ndarray) -> np.ndarray:
        """Of texts as numbers of words (rows of ``responses``)."""
        rows = np.concatenate([responses, np.zeros((1, responses.shape[1]), np.float32)])
        columns = iter(range(0, rows.shape[1], FILTERS))
        tables = [[np.ascontiguousarray(rows[:, (k := next(columns)):k + FILTERS]) for _ in f] for f in self.filters]
        return (pooled(texts, tables, self.biases) @ self.dense).astype(float) + self.intercept

    def scores(self, texts: list[str]) -> np.ndarray:
        """Calibrated probabilities of whole texts."""
        own, parts, sets = numbered_words(texts)
        cut = self.thresholds[[language_of(sets[n]) for n in own]]
        return sigmoid(self.logits(own, self.responses(parts)) - cut)

    def score(self, text: Column) -> Column:
        """Probability of label 1 for a string column, whole texts (null as empty)."""
        model = self

        @F.pandas_udf("double")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                scores: list[np.ndarray] = []
                for at in range(0, len(texts), TEXTS_AT_ONCE):
                    scores.append(model.scores([t if isinstance(t, str) else "" for t in texts.iloc[at:at + TEXTS_AT_ONCE]]))
                yield pd.Series(np.concatenate(scores) if scores else np.zeros(0))

        return run(text)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class _Adam:
    def __init__(self, values: list[np.ndarray], rate: float):
        self.values, self.rate, self.step = values, rate, 0
        self.mean = [np.zeros_like(v) for v in values]
        self.square = [np.zeros_like(v) for v in values]

    def __call__(self, gradients: list[np.ndarray]) -> None:
        self.step += 1
        scale = self.rate * np.sqrt(1 - 0.999 ** self.step) / (1 - 0.9 ** self.step)
        for v, g, m, s in zip(self.values, gradients, self.mean, self.square):
            m *= 0.9
            m += 0.1 * g
            s *= 0.999
            s += 0.001 * g * g
            v -= scale * m / (np.sqrt(s) + 1e-7)


class _Trainer:
    """Weights in training: Adam on the small ones, Adagrad (``squares``) on the rows of the embedding that a batch reaches."""

    def __init__(self, embedding: np.ndarray, filters: list[np.ndarray], biases: list[np.ndarray], dense: np.ndarray, intercept: np.ndarray,
                 squares: np.ndarray, rate: float, decay: float):
        self.embedding, self.filters, self.biases, self.dense, self.intercept, self.squares = embedding, filters, biases, dense, intercept, squares
        self.rate, self.decay = rate, decay
        self.step = _Adam([*filters, *biases, dense, intercept], rate)

    def learn(self, texts: list[np.ndarray], parts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """One step on a batch of texts as word numbers (rows of ``parts``, whose last row is no word).

        The gradient of a maximum reaches one window per text and filter, so the
        backward pass is small whatever the length.
        """
        reach = max(WIDTHS) - 1
        lengths = np.array([len(own) for own in texts])
        starts = np.cumsum([0, *(lengths[:-1] + reach)])
        flat = np.full(lengths.sum() + reach * len(texts), len(parts) - 1)
        for own, start in zip(texts, starts):
            flat[start:start + len(own)] = own
        used, where = np.unique(flat, return_inverse=True)
        own_parts = parts[used]
        vectors = self.embedding[own_parts].sum(axis=1)
        best, places = [], []
        for f, bias in zip(self.filters, self.biases):
            response = np.tile(bias, (len(flat), 1))
            for j in range(len(f)):
                response[:len(flat) - j] += (vectors @ f[j])[where[j:]]
            at = np.array([s + response[s:s + n].argmax(axis=0) if n else np.full(FILTERS, s) for s, n in zip(starts, lengths)])
            best.append(np.where(lengths[:, None] > 0, np.maximum(response[at, np.arange(FILTERS)], 0), 0))
            places.append(at)
        features = np.concatenate(best, axis=1)
        error = ((sigmoid(features @ self.dense + self.intercept[0]) - y) * weight / len(texts)).astype(np.float32)
        back = error[:, None] * self.dense * (features > 0)
        d_words, d_filters, d_biases = np.zeros_like(vectors), [], []
        for k, f in enumerate(self.filters):
            own = back[:, k * FILTERS:(k + 1) * FILTERS]
            d_biases.append(own.sum(axis=0))
            d_filter = self.decay * f
            for j in range(len(f)):
                seen = where[np.minimum(places[k] + j, len(flat) - 1)]
                d_filter[j] += np.einsum("df,dfe->ef", own, vectors[seen])
                np.add.at(d_words, seen, own[:, :, None] * f[j].T)
            d_filters.append(d_filter)
        self.step([*d_filters, *d_biases, features.T @ error + self.decay * self.dense, np.array([error.sum()], np.float32)])
        touched = np.flatnonzero(np.abs(d_words).sum(axis=1))
        rows, place = np.unique(own_parts[touched], return_inverse=True)
        change = np.zeros((len(rows), DIMENSION), np.float32)
        np.add.at(change, place.reshape(-1, PARTS), d_words[touched][:, None, :])
        self.squares[rows] += (change * change).mean(axis=1)
        self.embedding[rows] -= 5 * self.rate * change / np.sqrt(self.squares[rows])[:, None]
        self.embedding[0] = 0


def class_weights(ones: int, zeros: int) -> np.ndarray:
    """Of a text of label 0 and of label 1, so that both classes weigh the same."""
    return np.array([0.5 / max(1, zeros), 0.5 / max(1, ones)]) * (ones + zeros)


def train(texts: list[np.ndarray], parts: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 32, rate: float = 0.01,
          decay: float = 1e-3, seed: int = 7) -> tuple[ConvolutionModel, np.ndarray]:
    """Fit on texts as word numbers (rows of ``parts``); both classes weigh the same.  Also the sums of squares of every bucket."""
    texts_with = np.zeros(BUCKETS, np.int64)
    for own in texts:
        texts_with[np.unique(parts[np.unique(own)])] += 1
    known = np.flatnonzero(texts_with >= LEAST_TEXTS)
    known = known[known > 0]
    compact = np.zeros(BUCKETS, np.int64)
    compact[known] = np.arange(1, len(known) + 1)  # 0: no known part
    parts = np.concatenate([compact[parts], np.zeros((1, PARTS), np.int64)])
    rng = np.random.default_rng(seed)
    draw = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    embedding = draw(0.05, len(known) + 1, DIMENSION)
    embedding[0] = 0
    filters = [draw(0.3, w, DIMENSION, FILTERS) for w in WIDTHS]
    biases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    dense, intercept = draw(0.3, FILTERS * len(WIDTHS)), np.zeros(1, np.float32)
    trainer = _Trainer(embedding, filters, biases, dense, intercept, np.full(len(embedding), 1e-8, np.float32), rate, decay)
    weight = class_weights(y.sum(), (1 - y).sum())[y]
    for _ in range(epochs):
        for chosen in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // batch)):
            trainer.learn([texts[i] for i in chosen], parts, y[chosen], weight[chosen])
    full, squares = np.zeros((BUCKETS, DIMENSION), np.float32), np.full(BUCKETS, 1e-8, np.float32)
    full[known], squares[known] = embedding[1:], trainer.squares[1:]
    return ConvolutionModel(full, filters, biases, dense, float(intercept[0])), squares


def _pieces(texts: list[np.ndarray], most: int = 12, seed: int | Sequence[int] = 11) -> list[np.ndarray]:
    """A short piece, sometimes of no word, of every text: what a text of label 0 contains is of label 0, and short texts are rare."""
    rng = np.random.default_rng(seed)
    found = []
    for own in texts:
        n = int(rng.integers(0, most + 1))
        at = int(rng.integers(0, max(1, len(own) - n + 1)))
        found.append(own[at:at + n])
    return found


def best_threshold(logits: np.ndarray, y: np.ndarray, share: float) -> float:
    """Where the fewest labels are wrong, each class weighing its share; the middle between the two logits beside the cut."""
    if not len(logits):
        return 0.0
    order = np.argsort(logits, kind="stable")
    x, t = logits[order], y[order]
    n1, n0 = max(1, t.sum()), max(1, (1 - t).sum())
    missed = np.concatenate([[0], np.cumsum(t)]) * share / n1
    false = (1 - t).sum() * (1 - share) / n0 - np.concatenate([[0], np.cumsum(1 - t)]) * (1 - share) / n0
    edges = np.concatenate([[x[0] - 1], (x[1:] + x[:-1]) / 2, [x[-1] + 1]])
    cost = missed + false
    cost[1:-1][x[1:] == x[:-1]] = np.inf
    low = np.flatnonzero(cost <= cost.min() + 1e-12)
    return float(edges[low[len(low) // 2]])


def calibrate(model: ConvolutionModel, texts: list[np.ndarray], parts: np.ndarray, sets: np.ndarray, y: np.ndarray, share: float, least: int = 12) -> None:
    """Set the thresholds from texts that trained no weight; a language with fewer than ``least`` texts of a class has the common one."""
    logits = model.logits(texts, model.responses(parts))
    language = np.array([language_of(sets[n]) for n in texts], int)
    model.thresholds[:] = best_threshold(logits, y, share)
    for k in range(len(LANGUAGES)):
        own = language == k
        if min((y[own] == 1).sum(), (y[own] == 0).sum()) >= least:
            model.thresholds[k] = best_threshold(logits[own], y[own], share)


def is_held_out(doc_id: Column) -> Column:
    """Rows whose labels the fit never sees (a null id is none of them)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _labelled(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str) -> tuple[DataFrame, DataFrame]:
    """``(id, y, turn)`` of the ids whose label may teach, and ``(id, text)`` of the texts that are not empty."""
    known = (
        labels.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{label_column}`").cast("int").alias("y"))
        .filter(~is_held_out(F.col("id"))).groupBy("id").agg(
            F.min("y").alias("y"), F.max("y").alias("y2"), F.count_if(F.col("y").isNull()).alias("unsaid"))
        .filter("id IS NOT NULL AND y = y2 AND y IN (0, 1) AND unsaid = 0").select("id", "y", F.xxhash64("id").alias("turn")))
    texts = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), text_of(f"`{text_column}`").alias("text")).filter("text <> ''")
    return known, texts.filter(~is_held_out(F.col("id")))


def _start_rows(known: DataFrame, texts: DataFrame, max_docs_per_class: int, max_chars_per_class: int) -> list:
    """``(id, y, turn, size, text)`` of a bounded sample in a fixed order; ``size``: of the longest text of the id."""
    there = known.join(texts.groupBy("id").agg(F.max(F.length("text")).alias("size")), "id")
    chosen = []
    for y in (0, 1):  # narrow rows, at most max_docs_per_class a class
        total = own = 0
        for r in there.filter(F.col("y") == y).orderBy("turn", "id").limit(max_docs_per_class).collect():
            total += min(r["size"], max_chars_per_class)
            if own and total > max_chars_per_class:
                break
            own += 1
            chosen.append((r.id, y, r.turn, r["size"]))
    if not chosen:
        return []
    named = known.sparkSession.createDataFrame(chosen, "id long, y int, turn long, size int")
    return (texts.join(F.broadcast(named), "id")  # at most 2 * max_docs_per_class ids
            .select("id", "y", "turn", "size", F.substring("text", 1, max_chars_per_class).alias("text"))
            .groupBy("id", "y", "turn", "size").agg(F.min("text").alias("text")).orderBy("turn", "id").collect())


def _share(known: DataFrame) -> float:
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}  # two rows
    return counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5


def labelled_sample(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str,
                    max_docs_per_class: int, max_chars_per_class: int) -> tuple[list[tuple[str, int]], float]:
    """``(text, label)`` of a bounded sample in a fixed order, and the share of label 1 among all that may teach."""
    known, texts = _labelled(docs, labels, id_column, text_column, label_column)
    rows = _start_rows(known, texts, max_docs_per_class, max_chars_per_class)
    return [(r.text, r.y) for r in rows], _share(known) if rows else 0.5


def _checks(turn: Column | int) -> Column | int:
    """Whether the id of this hash calibrates (3 of 4: it trains)."""
    return (turn >> 7) % 4 == 3 if isinstance(turn, int) else F.pmod(F.shiftright(turn, 7), F.lit(4)) == 3


def _in_shards(known: DataFrame, texts: DataFrame, shards: int, checks: bool) -> DataFrame:
    """``(id, y, text)`` of all ids that calibrate, or of all that train, a task per shard, in order of hash.

    An id's rows follow each other: its label, with a null text, then its texts,
    with a null label, the least first.  So a text moves once, whatever the tables' sizes.
    """
    rows = known.select("id", "y", F.lit(None).cast("string").alias("text")).unionByName(texts.select("id", F.lit(None).cast("int").alias("y"), "text"))
    turn = F.xxhash64("id")
    return (rows.filter(_checks(turn) if checks else ~_checks(turn)).filter("id IS NOT NULL")
            .repartitionById(shards, F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(shards)).cast("int"))
            .sortWithinPartitions(turn, "id", F.col("text").asc_nulls_first()))


def _batches(frames: Iterator[pd.DataFrame], most: int, chars: int = 2_000_000) -> Iterator[tuple[list[str], np.ndarray]]:
    """Texts and labels of the ids that have both, of each id the first text; so many at once (fewer long ones)."""
    texts, y, held = [], [], 0
    labelled, label = None, 0  # the id whose label was read last, until its first text
    for frame in frames:
        for key, own, text in zip(frame["id"].tolist(), frame["y"].tolist(), frame["text"].tolist()):
            if not isinstance(text, str):
                labelled, label = key, int(own)
            elif key == labelled:
                labelled = None
                texts.append(text)
                y.append(label)
                held += len(text)
                if len(texts) >= most or held >= chars:
                    yield texts, np.array(y, int)
                    texts, y, held = [], [], 0
    if texts:
        yield texts, np.array(y, int)


#: Over few texts passes are repeated until about so many have trained.
PASSES_UNTIL = 20_000
#: Buckets of a row in which a shard's changes are brought together.
_BLOCK = 1024


def train_on_all(known: DataFrame, all_texts: DataFrame, shards: int, start: ConvolutionModel, squares: np.ndarray, weights: np.ndarray,
                 batch: int = 32, rate: float = 0.003, decay: float = 1e-3) -> ConvolutionModel:
    """One more pass from ``start`` over all labelled texts that train: a task trains on each shard, the changes are averaged.

    A bucket's change is the mean over the shards that changed it, so a rare word
    learns as fast as a frequent one.  A bucket that fewer than ``LEAST_TEXTS`` of
    all texts have is the zero vector afterwards.  What goes to the driver is one model.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        small = [*(f.copy() for f in start.filters), *(b.copy() for b in start.biases), start.dense.copy(), np.array([start.intercept], np.float32)]
        n = len(WIDTHS)
        t = _Trainer(start.embedding.copy(), small[:n], small[n:2 * n], small[2 * n], small[2 * n + 1], squares.copy(), rate, decay)
        texts_with, there, shard = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, bool), None
        for number, (texts, y) in enumerate(_batches(frames, batch)):
            own, parts, _ = numbered_words(texts)
            parts = np.concatenate([parts, np.zeros((1, PARTS), np.int64)])
            for words in own:
                there[parts[words]] = True
                found = np.flatnonzero(there)
                texts_with[found] += 1
                there[found] = False
            pieces = _pieces([words for words, label in zip(own, y) if label == 0], seed=(11, number))
            y = np.concatenate([y, np.zeros(len(pieces), int)])
            t.learn(own + pieces, parts, y, weights[y])
            shard = zlib.crc32(texts[0].encode("utf-8", "surrogatepass")) if shard is None else shard  # orders the sums
        if shard is None:
            return
        flat = np.concatenate([(now - then).ravel() for now, then in zip(small, [
            *start.filters, *start.biases, start.dense, np.array([start.intercept], np.float32)])]).astype(np.float32)
        yield pd.DataFrame({"block": [-1], "shard": [shard], "change": [flat.tobytes()], "changed": [b"\1"], "texts": [b"\0" * 8]})
        change, changed = t.embedding - start.embedding, (t.squares > squares).astype(np.uint8)
        cuts = range(0, BUCKETS, _BLOCK)
        yield pd.DataFrame({
            "block": [at // _BLOCK for at in cuts], "shard": shard, "change": [change[at:at + _BLOCK].tobytes() for at in cuts],
            "changed": [changed[at:at + _BLOCK].tobytes() for at in cuts], "texts": [texts_with[at:at + _BLOCK].tobytes() for at in cuts]})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["shard", "change"])
        changed = sum(np.frombuffer(b, np.uint8).astype(np.int64) for b in rows["changed"])
        total = sum(np.frombuffer(b, np.float32).astype(float).reshape(len(changed), -1) for b in rows["change"])
        texts = sum(np.frombuffer(b, np.int64) for b in rows["texts"])
        mean = (total / np.maximum(changed, 1)[:, None]).astype(np.float32)
        return pd.DataFrame({"block": rows["block"].iloc[:1].tolist(), "change": [mean.tobytes()], "texts": [texts.tobytes()]})

    merged = (_in_shards(known, all_texts, shards, False).mapInPandas(run, "block int, shard long, change binary, changed binary, texts binary")
              .groupBy("block").applyInPandas(merge, "block int, change binary, texts binary").collect())  # one model
    found = {r.block: r for r in merged}
    if not found:
        return start
    step, at = np.frombuffer(found[-1].change, np.float32), 0
    small = []
    for then in [*start.filters, *start.biases, start.dense, np.array([start.intercept], np.float32)]:
        small.append(then + step[at:at + then.size].reshape(then.shape))
        at += then.size
    blocks = [found[k] for k in range(BUCKETS // _BLOCK)]
    embedding = start.embedding + np.concatenate([np.frombuffer(r.change, np.float32) for r in blocks]).reshape(BUCKETS, DIMENSION)
    embedding[np.concatenate([np.frombuffer(r.texts, np.int64) for r in blocks]) < LEAST_TEXTS] = 0
    n = len(WIDTHS)
    return ConvolutionModel(embedding, small[:n], small[n:2 * n], small[2 * n], float(small[2 * n + 1][0]))


def thresholds_of(logits: DataFrame, share: float, least: int = 12) -> np.ndarray:
    """``calibrate`` on a table (language, logit, y): exact thresholds from all rows, sorted in ranges of logits.

    Of several equally good cuts the middle one of the first range that has them is taken.
    """
    common = len(LANGUAGES)
    counted = pin(
        logits.withColumn("language", F.explode(F.array("language", F.lit(common))))
        .groupBy("language", "logit").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"))
        .repartitionByRange("language", "logit").sortWithinPartitions("language", "logit").withColumn("part", F.spark_partition_id()))
    # a row per range and language
    ends = counted.groupBy("language", "part").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.min("logit").alias("low"), F.max("logit").alias("high")).orderBy("language", "part").collect()
    totals: dict[int, list[int]] = {}
    places: dict[tuple[int, int], tuple[int, int, float]] = {}  # counts before the range, highest logit before it
    for r in ends:
        n0, n1, *high = totals.get(r.language, [0, 0])
        places[r.part, r.language] = n0, n1, high[0] if high else r.low - 2
        totals[r.language] = [n0 + r.n0, n1 + r.n1, r.high]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: dict[tuple[int, int], tuple[int, int, float]] = {}
        for frame in frames:
            for key, own in frame.groupby(["part", "language"], sort=True):
                n0, n1, before = at.get(key, places[key])
                all0, all1 = max(1, totals[key[1]][0]), max(1, totals[key[1]][1])
                x = np.concatenate([[before], own["logit"].to_numpy(float)])
                c0, c1 = np.concatenate([[n0], n0 + own["n0"].cumsum()]), np.concatenate([[n1], n1 + own["n1"].cumsum()])
                # the cut below each logit of the range
                cost = c1[:-1] * share / all1 + (totals[key[1]][0] - c0[:-1]) * (1 - share) / all0
                low = np.flatnonzero(cost <= cost.min() + 1e-12)
                k = low[len(low) // 2]
                yield pd.DataFrame({"language": [key[1]], "cost": [float(cost[k])], "cut": [float((x[k] + x[k + 1]) / 2)]})
                at[key] = int(c0[-1]), int(c1[-1]), float(x[-1])

    cuts = counted.mapInPandas(run, "language int, cost double, cut double").groupBy("language").agg(
        F.min(F.struct(F.round("cost", 12), "cut")).alias("best")).collect()  # a row per language
    best = {r.language: (r.best[0], r.best[1]) for r in cuts}
    for language, (_, n1, high) in totals.items():  # or above all logits
        if n1 and totals[language][1] * share / max(1, n1) < best[language][0]:
            best[language] = share, high + 1
        elif not n1:
            best[language] = 0.0, high + 1
    out = np.full(len(LANGUAGES), best[common][1] if common in best else 0.0)
    for language, (n0, n1, _) in totals.items():
        if language != common and min(n0, n1) >= least:
            out[language] = best[language][1]
    return out


def logits_of(known: DataFrame, all_texts: DataFrame, shards: int, model: ConvolutionModel) -> DataFrame:
    """``(language, logit, y)`` of all labelled texts that calibrate and of a short piece of each of label 0."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, (texts, y) in enumerate(_batches(frames, TEXTS_AT_ONCE)):
            own, parts, sets = numbered_words(texts)
            pieces = _pieces([words for words, label in zip(own, y) if label == 0], seed=(13, number))
            yield pd.DataFrame({"language": [language_of(sets[n]) for n in own + pieces], "logit": model.logits(own + pieces, model.responses(parts)),
                                "y": np.concatenate([y, np.zeros(len(pieces), int)])})

    return _in_shards(known, all_texts, shards, True).mapInPandas(run, "language int, logit double, y int")


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
                 max_docs_per_class: int = 2000, max_chars_per_class: int = 10_000_000, docs_per_shard: int = 4000, max_shards: int = 256,
                 rate: float = 0.003) -> ConvolutionModel:
    """Train and calibrate on all labelled rows that are not held out.

    The weights start from several passes over a bounded number of texts: per class the
    ``max_docs_per_class`` ids that come first by hash among those with a text,
    until their texts have ``max_chars_per_class`` characters.  If these are not
    all, every labelled text then trains in one more pass (in several, up to ten, if there are few), a task per shard of
    about ``docs_per_shard`` ids (of more, if ``max_shards`` have more), and
    bucket counts and thresholds come from all texts, too.  Three of four train
    the weights, the fourth calibrates the thresholds.  Ids with both labels, or a null one,
    teach nothing; of rows that share an id the least text is taken.  Without
    four texts of each class every text scores the share of label 1.
    """
    known, all_texts = _labelled(docs, labels, id_column, text_column, label_column)
    sample = _start_rows(known, all_texts, max_docs_per_class, max_chars_per_class)
    share = _share(known)
    y = np.array([r.y for r in sample], int)
    if min(y.sum(), (1 - y).sum()) < 4:
        model = ConvolutionModel(np.zeros((BUCKETS, DIMENSION), np.float32), [np.zeros((w, DIMENSION, FILTERS), np.float32) for w in WIDTHS],
                                 [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32), 0.0)
        counts = _counts(known, all_texts) if len(sample) else {}
        model.intercept = float(np.log((sum(counts.get((1, c), 0) for c in (True, False)) + 1) / (sum(counts.get((0, c), 0) for c in (True, False)) + 1)))
        return model
    counts = _counts(known, all_texts)
    whole = sum(counts.values()) == len(sample) and max(r["size"] for r in sample) <= max_chars_per_class
    texts, parts, sets = numbered_words([r.text for r in sample], buckets_of.__wrapped__)  # each word once: nothing to cache on the driver
    if whole:
        turn = np.zeros(len(y), int)
        for label in (0, 1):  # every fourth of each class calibrates
            turn[y == label] = np.arange((y == label).sum()) % 4
        checked = turn == 3
    else:
        checked = np.array([_checks(r.turn) for r in sample])
    own = {}
    for name, rows in (("fit", np.flatnonzero(~checked)), ("check", np.flatnonzero(checked))):
        pieces = _pieces([texts[i] for i in rows if y[i] == 0])
        own[name] = [texts[i] for i in rows] + pieces, np.concatenate([y[rows], np.zeros(len(pieces), int)])
    model, squares = train(own["fit"][0], parts, own["fit"][1])
    if whole:
        calibrate(model, own["check"][0], parts, sets, own["check"][1], share)
        return model
    del sample, texts, parts, sets, own
    shards = min(max_shards, -(-sum(counts.values()) // docs_per_shard))
    weights = class_weights(counts.get((1, False), 0), 2 * counts.get((0, False), 0))  # a text of label 0 has a piece
    for _ in range(max(1, min(10, PASSES_UNTIL // sum(counts.values())))):
        model = train_on_all(known, all_texts, shards, model, squares, weights, rate=rate)
    model.thresholds[:] = thresholds_of(logits_of(known, all_texts, shards, model), share)
    return model


def _counts(known: DataFrame, texts: DataFrame) -> dict[tuple[int, bool], int]:
    """Ids with a text by label and by whether they calibrate."""
    there = known.join(texts.select("id"), "id", "left_semi")
    return {(r.y, r.checks): r["count"] for r in there.groupBy("y", _checks(F.col("turn")).alias("checks")).count().collect()}  # four rows


def score_toxicity(docs: DataFrame, model: ConvolutionModel, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted (1 if score >= threshold).

    The score sees the text alone.  A null text is empty; an empty text, or one
    without a known word, has the score of no response at all.  An empty table
    gives an empty result.  Other columns are not read.
    """
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), is_held_out(F.col(f"`{id_column}`")).alias("held_out"), model.score(text_of(f"`{text_column}`")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

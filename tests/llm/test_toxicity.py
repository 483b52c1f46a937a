"""Toxicity classifier: plain convolution, held-out accuracy, labels that may not teach, odd inputs."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatloom.llm import toxicity as tx

BAD = {"en": ["grubble", "snorfel", "blatherskite"], "de": ["quatschk" + e for e in ("er", "en", "ung", "heit", "lich", "bar")]}


def corpus(n=700, seed=2):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        lang = rng.choice(["en", "de"])
        words = [rng.choice(tx.FUNCTION_WORDS[lang].split()) if rng.random() < 0.4 else rng.choice(plain) for _ in range(rng.randint(5, 80))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD[lang]).capitalize() + rng.choice(["", ",", "!"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = corpus()
    extra = [(9001, None), (9002, ""), (9003, " \n "), (None, docs[0][1]), (3, docs[3][1]), (9004, ("word and the " * 40_000) + "grubble" + " of the" * 30_000)]
    frame = spark.createDataFrame([(*d, "x", 1.5, True) for d in docs + extra], "doc_id long, text string, score string, predicted double, held_out boolean").repartition(3)
    odd = [(5, 1), (5, 0), (6, None), (None, 1), (99_999, 1), (8, 7)]
    marks = spark.createDataFrame(labels + odd, "doc_id long, toxic int")
    return docs, labels, frame, marks, tx.fit_toxicity(frame, marks)


def test_held_out_accuracy_and_odd_rows(fitted):
    docs, labels, frame, _, model = fitted
    out = tx.score_toxicity(frame, model)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == len(docs) + 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    by_id = {r.doc_id: r for r in rows}
    truth = dict(labels)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(by_id[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in truth) and not by_id[None].held_out
    assert np.mean([by_id[i].predicted == truth[i] for i in held]) > 0.95
    assert by_id[9001].score == by_id[9002].score == by_id[9003].score and by_id[9002].predicted == 0
    assert by_id[9004].predicted == 1  # one word far inside a long text
    assert by_id[None].score == by_id[0].score


def test_held_out_and_contradictory_labels_teach_nothing(spark, fitted):
    docs, labels, frame, _, model = fitted
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels] + [(5, 1), (5, 0), (6, None), (8, 7)]
    again = tx.fit_toxicity(frame, spark.createDataFrame(turned, "doc_id long, toxic int"))
    sample = [t for _, t in docs[:50]]
    assert np.allclose(again.scores(sample), model.scores(sample), atol=0.02)


def test_scores_equal_a_plain_convolution_in_any_pieces(fitted, monkeypatch):
    docs, _, _, _, model = fitted
    texts = [t for _, t in docs[:25]] + ["", "one", "of the"]

    def plain(text):
        vectors = [sum(model.embedding[b] for b in tx.buckets_of(w)) for w in tx._WORDS.findall(text.lower())]
        features = []
        for f, bias in zip(model.filters, model.biases):
            tops = [bias + sum(vectors[i + j] @ f[j] for j in range(len(f)) if i + j < len(vectors)) for i in range(len(vectors))]
            features.append(np.maximum(np.max(tops, axis=0), 0) if tops else np.zeros(len(bias)))
        counts = [sum(w in line.split() for w in tx._WORDS.findall(text.lower())) for line in tx.FUNCTION_WORDS.values()]
        cut = model.thresholds[counts.index(max(counts)) if max(counts) else -1]
        return 1 / (1 + np.exp(cut - model.intercept - np.concatenate(features) @ model.dense))

    want = np.array([plain(t) for t in texts])
    assert np.allclose(model.scores(texts), want, atol=1e-4)
    monkeypatch.setattr(tx, "SEGMENT_WORDS", 7)
    monkeypatch.setattr(tx, "BATCH_WORDS", 20)
    assert np.allclose(model.scores(texts), want, atol=1e-4)


def test_thresholds_by_language():
    logits, y = np.array([0.0, 1, 2, 3, 4, 5]), np.array([0, 0, 1, 0, 1, 1])
    assert tx.best_threshold(logits, y, 0.1) == 3.5 and tx.best_threshold(logits, y, 0.9) == 1.5
    assert tx.best_threshold(np.array([]), np.array([]), 0.5) == 0
    for k, line in enumerate(tx.FUNCTION_WORDS.values()):
        assert tx.language_of(tx.numbered_words([line])[2]) == k
    assert tx.LANGUAGES[tx.language_of(tx.numbered_words(["xyzzy 12"])[2])] == "other"


def test_without_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = tx.fit_toxicity(docs, none)
    assert [r.score for r in tx.score_toxicity(docs, model).collect()] == [0.5, 0.5]
    assert tx.score_toxicity(spark.createDataFrame([], docs.schema), model).count() == 0


def test_sample_is_bounded_and_whole(spark):
    docs = spark.createDataFrame([(i, "x" * 10 * i) for i in range(1, 60)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, toxic int")
    rows, share = tx.labelled_sample(docs, marks, "doc_id", "text", "toxic", 5, 10_000)
    assert sum(y for _, y in rows) == 5 and len(rows) == 10 and 0.3 < share < 0.7
    few, _ = tx.labelled_sample(docs, marks, "doc_id", "text", "toxic", 50, 300)
    assert all(sum(len(t) for t, y in few if y == k) <= 300 or sum(1 for _, y in few if y == k) == 1 for k in (0, 1)) and {y for _, y in few} == {0, 1}


def test_rows_beyond_the_start_teach_and_calibrate(spark):
    rng = random.Random(4)
    plain = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(3, 9))) for _ in range(200)]
    late, docs = {}, []
    first = [r.id for r in spark.range(600).orderBy(F.xxhash64("id")).collect()]
    known = [i for i in first if zlib.crc32(str(i).encode()) % 5]
    for n, i in enumerate(known):  # label 1 is another word in the rows that come late by hash
        late[i] = n >= 60
        words = [rng.choice(plain) for _ in range(30)]
        if i % 2:
            words[rng.randrange(30)] = "zwogglefritz" if late[i] else "grubblesnorf"
        docs.append((i, " ".join(words)))
    frame = spark.createDataFrame(docs + [(known[0], "\U0010ffff later copy"), (None, "no id")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in known] + [(None, 1)], "doc_id long, toxic int")
    model = tx.fit_toxicity(frame, marks, max_docs_per_class=20, docs_per_shard=300)
    texts = [t for _, t in docs]
    right = model.scores(texts).round() == [i % 2 for i in known]
    assert right.mean() > 0.95 and right[[n for n, i in enumerate(known) if late[i] and i % 2]].mean() > 0.9
    assert np.abs(model.embedding[tx.buckets_of("zwogglefritz")[0]]).max() > 0  # its bucket is in no text of the start


def test_thresholds_of_a_table_are_those_of_the_arrays(spark):
    rng = np.random.default_rng(3)
    language, y = rng.integers(0, 3, 900), rng.integers(0, 2, 900)
    logits = np.round(rng.normal(y * 1.5 + language, 1), 2)
    language[:20] = 5  # too few for a threshold of its own
    frame = spark.createDataFrame([(int(a), float(b), int(c)) for a, b, c in zip(language, logits, y)], "language int, logit double, y int").repartition(4)
    got = tx.thresholds_of(frame, 0.3)

    def cost(own, cut):
        x, t = logits[own], y[own]
        return 0.3 * ((x < cut) & (t == 1)).sum() / t.sum() + 0.7 * ((x > cut) & (t == 0)).sum() / (1 - t).sum()

    every = np.ones(900, bool)
    assert np.isclose(cost(every, got[-1]), cost(every, tx.best_threshold(logits, y, 0.3))) and got[5] == got[-1] == got[3]
    for k in range(3):
        own = language == k
        assert np.isclose(cost(own, got[k]), cost(own, tx.best_threshold(logits[own], y[own], 0.3)))
    assert (tx.thresholds_of(frame.limit(0), 0.3) == 0).all()

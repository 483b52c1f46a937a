"""Operators do the whole job on inputs with several null ids, shared ids, long labelled texts and short or all-letter secrets."""

import random

from chatloom.llm import line_dedup, quality_classifier, simhash, unit_dedup


def prose(seed, n=40):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_near_dedup_keeps_unrelated_texts_that_share_an_id_or_have_none(spark):
    a, b, c, d = map(prose, range(4))
    rows = [(None, a), (None, b), (None, c), (None, c), (7, d), (7, prose(9)), (8, d)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one_per_component(docs).collect()), key=str)
    assert kept == sorted([(None, a), (None, b), (None, c), (7, d), (7, prose(9))], key=str)


def test_quality_fit_learns_from_long_texts_and_skips_labels_without_text(spark):
    rng = random.Random(5)
    syllables = {1: ["ta", "ri", "mo", "len", "su"], 0: ["XQ", "ZZ", "##", "$$", "!!"]}
    text = lambda y: " ".join("".join(rng.choice(syllables[y]) for _ in range(3)) for _ in range(300))
    texts = [(i, text(i % 2), i % 2) for i in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    labels = [(i, y) for i, _, y in texts]
    right = lambda model: sum(r.predicted == r.doc_id % 2 for r in quality_classifier.score_quality(docs, model).collect()) / 120
    long_texts = quality_classifier.fit_compression(docs, spark.createDataFrame(labels, "doc_id long, quality int"), max_chars=500)
    assert long_texts.good and right(long_texts) > 0.95
    strangers = [(i, i % 2) for i in range(1000, 5000)]
    model = quality_classifier.fit_compression(docs, spark.createDataFrame(labels + strangers, "doc_id long, quality int"), max_docs_per_class=40)
    assert model.good and right(model) > 0.95


def test_rows_that_repeat_id_and_text_lose_their_repeats(spark):
    a, b = ("\n".join(prose(100 * k + i, 8) for i in range(40)) for k in (5, 6))
    docs = spark.createDataFrame([(None, a, i) for i in range(4)] + [(3, b, 4), (3, b, 5), (9, b, 6), (None, None, 7), (None, None, 8)],
                                 "doc_id long, text string, n int").repartition(4)
    units = [r.kept for r in unit_dedup.unit_dedup(docs).collect()]
    assert sorted(map(len, units)) == sorted([0] * 7 + [len(a), len(b)]) and {a, b} <= set(units)
    lined = line_dedup.line_dedup(docs).collect()
    # a later copy, under its own id or another, loses every chunk
    (by_id,) = {r.n_removed_chunks for r in lined if r.doc_id == 9}
    assert by_id > 5 and sorted(r.n_removed_chunks for r in lined if r.doc_id == 3) == [0, by_id]
    assert [r.n_removed_chunks > 5 for r in sorted(lined, key=lambda r: r.n_removed_chunks) if r.doc_id is None] == [False] * 3 + [True] * 3
    texts = line_dedup.dedup_texts(docs).collect()
    assert sorted(r.n for r in texts) == list(range(9)) and sum(r.text == a for r in texts) == sum(r.text == b for r in texts) == 1

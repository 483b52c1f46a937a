"""The inverted-index search equals the blocked dense search on the same vectors."""

import math
import random

import pytest
from pyspark.sql import functions as F

from chatloom.operators import term_search as TS
from chatloom.operators.similarity import similar_topk


def dense(spark, weights):
    """The same vectors with one place per term."""
    terms = {r.term: i for i, r in enumerate(weights.select("term").distinct().sort("term").collect())}
    rows = {}
    for r in weights.collect():
        rows.setdefault(r.id, [0.0] * len(terms))[terms[r.term]] = r.w
    return spark.createDataFrame(list(rows.items()), "id string, embedding array<double>")


def triples(df):
    return sorted((r.qid, r["rank"], r.cid, round(r.similarity, 6)) for r in df.collect() if r.similarity > 1e-8)


@pytest.mark.parametrize("probe", [0, 30, 2000])
def test_equals_the_blocked_search(spark, probe):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(120)]
    text = lambda: " ".join(words[min(int(rnd.paretovariate(0.7)) - 1, 119)] for _ in range(rnd.randint(0, 40)))
    texts = [text() for _ in range(150)]
    texts += [texts[3], texts[3] + " W1, w2.", None, "", "only_here"]
    df = spark.createDataFrame([(f"d{i:03d}", t) for i, t in enumerate(texts)], "id string, text string").repartition(3)
    weights = TS.term_weights(df, "text").cache()
    full = dense(spark, weights)
    asked = weights.where("substring(id, 4, 1) in ('0', '3', '7')")
    want = similar_topk(full.join(asked.select("id").distinct(), "id"), full, 4)
    got = TS.sparse_topk(asked, weights, 4, probe)
    assert triples(got) == triples(want) and len(triples(got)) > 100


def test_on_documents_reads_a_part_of_the_index(spark, sf_mid):
    docs = spark.read.parquet(f"{sf_mid}/documents.parquet")
    weights = TS.term_weights(docs, "text", "doc_id").cache()
    asked = weights.where("cast(id as long) % 20 = 0")
    full = dense(spark, weights)
    want = similar_topk(full.join(asked.select("id").distinct(), "id"), full, 5)
    assert triples(TS.sparse_topk(asked, weights, 5)) == triples(want)
    read, all_ = TS.pairs_examined(asked, weights, 5)
    assert 0 < read < all_


def test_empty_sides(spark):
    empty = spark.createDataFrame([], "id string, term string, w double")
    one = spark.createDataFrame([("a", "x", 1.0)], "id string, term string, w double")
    assert TS.sparse_topk(empty, one).count() == TS.sparse_topk(one, empty).count() == TS.sparse_topk(one, one).count() == 0
    assert TS.term_weights(spark.createDataFrame([(1, None)], "id long, text string"), "text").count() == 0


@pytest.mark.parametrize("entries", [40, 2_000_000])
def test_texts_that_meet_are_no_rows_of_a_shuffle(spark, monkeypatch, entries):
    """200 texts share their terms: all pairs meet, but a block hands over k rows per query at most."""
    monkeypatch.setattr(TS, "BLOCK_ENTRIES", entries)
    rnd = random.Random(2)
    df = spark.createDataFrame([(f"d{i:03d}", " ".join(rnd.choices("abcdefgh", k=12))) for i in range(200)], "id string, text string")
    weights = TS.term_weights(df, "text")
    asked = weights.where("substring(id, 4, 1) = '0'")
    got = TS.sparse_topk(asked, weights, 3)
    full = dense(spark, weights)
    assert triples(got) == triples(similar_topk(full.join(asked.select("id").distinct(), "id"), full, 3))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Join" not in plan


def shuffled(spark):
    """Bytes by name of the shuffle files there are."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName(): f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")}


def test_entries_of_the_corpus_are_no_rows_of_a_shuffle(spark):
    """Of 300 texts with about 200 terms each only the dictionaries and the ten queries are shuffled."""
    rnd = random.Random(3)
    words = [f"word{i}" for i in range(600)]
    df = spark.createDataFrame([(f"d{i:03d}", " ".join(rnd.choices(words, k=240))) for i in range(300)], "id string, text string").coalesce(2)
    before = shuffled(spark)
    weights = TS.term_weights(df, "text")
    got = triples(TS.sparse_topk(weights.where("substring(id, 3, 2) = '00' or id < 'd007'"), weights, 3))
    written = sum(n for name, n in shuffled(spark).items() if name not in before)
    assert len(got) == 3 * 9
    assert written < 5 * weights.count()


def test_rows_of_a_text_may_lie_anywhere(spark, monkeypatch):
    """Texts whose rows are spread over partitions and blocks are whole again, also where nothing is known of the frame."""
    monkeypatch.setattr(TS, "BLOCK_ENTRIES", 50)
    rnd = random.Random(4)
    df = spark.createDataFrame([(f"d{i:02d}", " ".join(rnd.choices("abcdefghijklmnop", k=9))) for i in range(60)], "id string, text string")
    weights = TS.term_weights(df, "text")
    want = triples(TS.sparse_topk(weights.where("id < 'd12'"), weights, 4))
    spread = spark.createDataFrame(weights.collect(), weights.schema).repartition(3, "term")
    assert len(want) == 48 and triples(TS.sparse_topk(spread.where("id < 'd12'"), spread, 4)) == want


def test_rows_that_share_an_id_are_one_text(spark):
    rows = [("a", "x y y"), ("a", "y z"), ("b", "x"), ("c", "z z"), (None, "x q"), (None, "q")]
    weights = {(r.id, r.term): r.w for r in TS.term_weights(spark.createDataFrame(rows, "id string, text string"), "text").collect()}
    raw = {"x": math.log(5 / 3.5), "y": 3 * math.log(5 / 1.5), "z": math.log(5 / 2.5)}
    norm = math.sqrt(sum(x * x for x in raw.values()))
    assert weights.keys() == {("a", "x"), ("a", "y"), ("a", "z"), ("b", "x"), ("c", "z")}
    assert all(abs(weights["a", t] - x / norm) < 1e-12 for t, x in raw.items()) and abs(weights["c", "z"] - 1) < 1e-12

"""Pluggable batch functions, embeddings, similarity and stored-size pruning."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from chatloom import fixtures as fx
from chatloom.operators import batchfn as BF
from chatloom.operators import interactions as I
from chatloom.operators import similarity as J
from chatloom.sources import io as IO


def failing_scorer():
    def score(texts):
        raise RuntimeError("model down")

    return score


def fixed_scorer():
    return lambda texts: [(200, "the score is -0.35") if "!" in t else (503, "1.0") for t in texts]


def test_model_sentiment_parses_and_fails_soft(spark):
    df = spark.createDataFrame([(1, "great!"), (2, "meh")], "id int, user_message string")
    got = {r.id: r.model_sentiment for r in BF.model_sentiment(df, fixed_scorer).collect()}
    assert got == {1: -0.35, 2: 0.0}
    assert {r.model_sentiment for r in BF.model_sentiment(df, failing_scorer).collect()} == {0.0}


def test_generate_rejections_report(spark):
    def gen_factory():
        return lambda ps: [(200, '"' + "x" * (5 if p == "short" else 20) + '"', None) for p in ps]

    prompts = spark.createDataFrame([("a",), ("a",), ("short",), ("b",)], "prompt string")
    rej, report = BF.generate_rejections(prompts, gen_factory)
    assert sorted(r.prompt for r in rej.collect()) == ["a", "b"]
    r = report.first()
    assert (r.prompts, r.succeeded) == (3, 2) and math.isclose(r.success_rate, 2 / 3)


def test_tokenize_with_custom_tokenizer(spark):
    ds = spark.createDataFrame([("ab", "abcd")], "prompt_text string, full_text string")
    r = BF.tokenize_with(ds, BF.char_tokenizer, max_len=6).first()
    assert r.input_ids == [98, 99, 100, 101, 0, 0] and r.attention_mask == [1, 1, 1, 1, 0, 0]
    assert r.prompt_len == 2 and r.labels == [-100, -100, 100, 101, 0, 0]


def test_similarity_matches_brute_force(spark, sf_small):
    emb = spark.read.parquet(f"{sf_small}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    got = J.similar_topk(emb, emb, 3, query_blocks=3, corpus_blocks=2, chunk=37).collect()
    pdf = emb.toPandas()
    m = np.vstack(pdf["embedding"].to_numpy()).astype(np.float64)
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = m @ m.T
    np.fill_diagonal(sims, -np.inf)
    ids = pdf["id"].astype(str).to_numpy()
    want = set()
    for i in range(len(ids)):
        order = sorted(range(len(ids)), key=lambda j: (-sims[i, j], ids[j]))[:3]
        want |= {(ids[i], ids[j], r + 1) for r, j in enumerate(order)}
    assert {(r.qid, r.cid, r.rank) for r in got} == want


def test_embed_default_and_pluggable(spark):
    df = spark.createDataFrame([("1", "User: hi\nAssistant: hello there"), ("2", "")], "id string, document string")
    got = {r.id: r.embedding for r in J.embed(df, dim=32).collect()}
    assert len(got["1"]) == 32 and math.isclose(sum(x * x for x in got["1"]), 1.0, rel_tol=1e-5)
    enc = J.embed(df, encoder=lambda s: pd.Series([[float(len(t)), 0.0] for t in s]))
    assert {r.id: r.embedding for r in enc.collect()} == {"1": [31.0, 0.0], "2": [0.0, 0.0]}


def test_prune_if_oversize(spark, sf_small, tmp_path):
    from dataclasses import replace

    from chatloom.config import DEFAULT

    path = str(tmp_path / "store")
    IO.write_interactions(fx.fx_interactions(spark, sf_small), path)
    size = I.dataset_size_gb(spark, path)
    assert 0 < size < 1
    pruned, kept = I.prune_if_oversize(spark, path, replace(DEFAULT, max_size_gb=size / 0.95))
    n = fx.fx_interactions(spark, sf_small).count()
    assert pruned and kept.count() == n - int(fx.fx_interactions(spark, sf_small).where("NOT is_golden").count() * 0.1)
    not_pruned, same = I.prune_if_oversize(spark, path, replace(DEFAULT, max_size_gb=size * 10))
    assert not not_pruned and same.count() == n


def test_similarity_block_holds_one_tile_of_doubles():
    """Two blocks of 4096 vectors: no matrix of all their similarities, no second copy of the vectors as doubles."""
    import tracemalloc

    rng = np.random.default_rng(3)
    m = rng.normal(size=(4096, 384)).astype(np.float32)
    ids = [f"{i:05d}" for i in range(len(m))]
    tracemalloc.start()
    best, place = J.nearest_rows(ids, m, ids, m, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    unit = m[:40].astype(float) / np.linalg.norm(m[:40].astype(float), axis=1, keepdims=True)
    sims = unit @ (m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)).T
    sims[np.arange(40), np.arange(40)] = -1
    assert (np.argsort(-sims, axis=1)[:, :3] == place[:40]).all()


def test_embed_hands_over_few_vectors_at_a_time(spark):
    def encoder(texts):
        assert len(texts) <= J.ENCODED_ROWS
        return texts.map(lambda t: [float(len(t))])

    df = spark.range(3000).selectExpr("cast(id as string) as document").coalesce(1)
    got = J.embed(df, encoder=encoder).collect()
    assert len(got) == 3000 and all(r.embedding == [float(len(r.document))] for r in got)

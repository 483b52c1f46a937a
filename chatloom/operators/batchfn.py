"""Pluggable model steps run as Arrow batch functions.

The scorer, rejection generator and tokenizer are caller-supplied functions
over a batch of strings.  Each is built once per task by a factory (so a model
or client is initialised per partition, not per row) and called on Arrow
batches through ``mapInPandas``; the parsing and masking around them stay
native Column code.  The default factories are deterministic stand-ins so the
pipelines run without a model; they are not models.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from chatloom.config import DEFAULT, Thresholds
from chatloom.functions.scoring import parse_score_reply
from chatloom.session import cut_lineage

Scorer = Callable[[list[str]], list[tuple[int, str]]]
Generator = Callable[[list[str]], list[tuple[int, str | None, str | None]]]
Tokenizer = Callable[[list[str]], list[list[int]]]


def stand_in_scorer() -> Scorer:
    """Replies like a scoring model would: a number in text; '!' nudges up, '?' down."""

    def score(texts: list[str]) -> list[tuple[int, str]]:
        out = []
        for t in texts:
            v = 0.1 * t.count("!") - 0.1 * t.count("?")
            out.append((200, f"Score: {v:.2f}"))
        return out

    return score


def _each(call: Callable, items: list, failed: tuple) -> list:
    """``call`` on a batch; if that fails, on every item alone, so one bad item costs only itself."""
    try:
        return call(items)
    except Exception:  # noqa: BLE001 - a failing model is part of its contract
        out = []
        for x in items:
            try:
                out += call([x])
            except Exception:  # noqa: BLE001
                out.append(failed)
        return out


def model_sentiment(df: DataFrame, scorer_factory: Callable[[], Scorer] = stand_in_scorer,
                    text_col: str = "user_message", out: str = "model_sentiment", max_chars: int = 500) -> DataFrame:
    """E5: score the first ``max_chars`` characters of each text (the scorer's prompt limit) with a pluggable scorer.

    The reply is parsed natively (E4): first number, clamped to [-1, 1]; a
    non-200 status, an unparsable reply or a scorer failure gives 0.0.
    """
    schema = StructType(df.schema.fields + [StructField("_status", IntegerType()), StructField("_reply", StringType())])

    def run(batches: Iterable[pd.DataFrame]):
        scorer = scorer_factory()
        for pdf in batches:
            texts = pdf[text_col].fillna("").str.slice(0, max_chars).tolist()
            replies = _each(scorer, texts, (500, ""))  # a failing scorer scores 0.0
            pdf["_status"] = [int(s) for s, _ in replies]
            pdf["_reply"] = [r for _, r in replies]
            yield pdf

    scored = df.mapInPandas(run, schema)
    return scored.withColumn(out, parse_score_reply(F.col("_reply"), F.col("_status"))).drop("_status", "_reply")


def stand_in_generator() -> Generator:
    """Deterministic 'worse answer' text per prompt (status, content JSON, thinking)."""

    def gen(prompts: list[str]) -> list[tuple[int, str | None, str | None]]:
        import json

        return [(200, json.dumps(f"I would rather not go into that: {p}"), None) for p in prompts]

    return gen


def generate_rejections(prompts: DataFrame, generator_factory: Callable[[], Generator] = stand_in_generator,
                        prompt_col: str = "prompt") -> tuple[DataFrame, DataFrame]:
    """Run the generator over the distinct prompts, clean the replies (D6), drop failures.

    Returns (rejections(prompt, seq, rejection), report(prompts, succeeded, success_rate)).
    """
    from chatloom.operators.datasets import clean_rejections

    distinct = prompts.select(F.col(prompt_col).alias("prompt")).where(F.col("prompt").isNotNull()).distinct()
    # (report below reads the pinned replies and the distinct prompts once more)

    def run(batches: Iterable[pd.DataFrame]):
        gen = generator_factory()
        for pdf in batches:
            replies = _each(gen, pdf["prompt"].tolist(), (500, None, None))  # failed generations are dropped
            pdf = pdf.assign(status=[r[0] for r in replies], content=[r[1] for r in replies], thinking=[r[2] for r in replies])
            yield pdf

    # Generated once: the replies feed both outputs, and a sampling model must not be
    # asked twice (its answers could differ); the checkpoint also survives executor loss.
    raw = cut_lineage(distinct.mapInPandas(run, "prompt string, status int, content string, thinking string"))
    ok = clean_rejections(raw.where(F.col("status") == 200)).select("prompt", F.lit(0).cast("bigint").alias("seq"), "rejection")
    report = (
        distinct.join(ok.select("prompt", F.lit(True).alias("_ok")), "prompt", "left")
        .agg(F.count(F.lit(1)).alias("prompts"), F.count_if(F.coalesce("_ok", F.lit(False))).alias("succeeded"))
        .withColumn("success_rate", F.when(F.col("prompts") > 0, F.col("succeeded") / F.col("prompts")).otherwise(F.lit(0.0)))
    )
    return ok, report


CACHE_SCHEMA = "prompt string, seq bigint, rejection string, cached_at timestamp_ntz, run string"


def cached_rejections(prompts: DataFrame, path: str, now, run_id: str, generator_factory: Callable[[], Generator] = stand_in_generator,
                      prompt_col: str = "prompt", cfg: Thresholds = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """D7 + D8: rejections of all prompts, asking the generator only for those without a fresh one in the cache.

    The cache is a table of (prompt, seq, rejection, cached_at) partitioned by ``run``; the newest
    fresh rejection of a prompt counts.  What is generated is written under ``run_id`` and so kept for
    later runs; a run that crashed while it wrote is found unfinished and done anew, a finished one that
    is repeated adds what is still missing.  Failed prompts are not cached, so they are asked again next
    time.  Returns (prompt, rejection) and the generation report.
    """
    from chatloom.operators.datasets import fresh_rejections
    from chatloom.operators.store import _Files

    spark = prompts.sparkSession
    if isinstance(now, str):
        now = dt.datetime.fromisoformat(now)
    files, own = _Files(spark, path), f"{path.rstrip('/')}/run={run_id}"
    files.make(path)
    finished = files.exists(f"{own}/_SUCCESS")
    if not finished:
        files.delete(own)
    wanted = prompts.select(F.col(prompt_col).alias("prompt")).where(F.col("prompt").isNotNull()).distinct()

    def newest() -> DataFrame:
        fresh = fresh_rejections(spark.read.schema(CACHE_SCHEMA).parquet(path), now, cfg)
        return fresh.groupBy("prompt").agg(F.max_by("rejection", F.struct("cached_at", "seq", "run")).alias("rejection"))

    # pinned: it is read again for the report, when the cache has what was generated
    missing = cut_lineage(wanted.join(newest().select("prompt"), "prompt", "left_anti"))
    generated, report = generate_rejections(missing, generator_factory)
    generated.withColumn("cached_at", F.lit(now).cast("timestamp_ntz")).write.mode("append" if finished else "overwrite").parquet(own)
    return newest().join(wanted, "prompt", "left_semi"), report


def char_tokenizer() -> Tokenizer:
    """Stand-in tokenizer: one id per character (code point + 1); 0 is padding."""

    def tok(texts: list[str]) -> list[list[int]]:
        return [[ord(c) + 1 for c in t] for t in texts]

    return tok


def tokenize_with(ds: DataFrame, tokenizer_factory: Callable[[], Tokenizer], max_len: int = 256, pad_id: int = 0) -> DataFrame:
    """D13 with a pluggable tokenizer: ids from Python, truncation / padding / masks natively."""
    schema = StructType(ds.schema.fields + [StructField("_full_ids", ArrayType(LongType())), StructField("_prompt_ids", ArrayType(LongType()))])

    def run(batches: Iterable[pd.DataFrame]):
        tok = tokenizer_factory()
        for pdf in batches:
            pdf["_full_ids"] = tok(pdf["full_text"].fillna("").tolist())
            pdf["_prompt_ids"] = tok(pdf["prompt_text"].fillna("").tolist())
            yield pdf

    ids = ds.mapInPandas(run, schema)
    from chatloom.operators.datasets import masks_from_ids

    return masks_from_ids(ids, F.col("_full_ids"), F.col("_prompt_ids"), max_len, pad_id).drop("_full_ids", "_prompt_ids")

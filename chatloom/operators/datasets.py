"""Training-set construction.

A set is one pass over (pool + golden rows): every row emits the samples
whose class conditions hold (UNION ALL semantics, overlaps kept).  The
rejection lookup is an equi-join on the prompt text after a per-prompt
``max_by`` (one row per prompt on the lookup side, so a hot prompt on the
sample side only meets a single lookup row; AQE splits a skewed side).
The train/validation split uses the exact range-partitioned global index.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.config import DEFAULT, Thresholds
from chatloom.functions.content import WS
from chatloom.operators.interactions import golden_examples, top_by_weight
from chatloom.plans.ordering import before_boundary, kth_boundary

SAMPLE_COLS = ("sample_id", "prompt", "chosen", "rejected", "weight", "sentiment", "type")


def _w() -> Column:
    return F.coalesce(F.col("weight"), F.lit(1.0))


def _s() -> Column:
    return F.coalesce(F.col("sentiment"), F.lit(0.0))


def select_training_pool(df: DataFrame, cfg: Thresholds = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(pool, golden): all golden rows plus the top max(0, top_n - golden) non-golden by weight."""
    golden = golden_examples(df)
    n_golden = golden.count()
    return top_by_weight(df, max(0, cfg.top_n - n_golden), exclude_golden=True), golden


def _classes(df: DataFrame, cfg: Thresholds):
    s = F.col("sentiment")
    return (
        df.where(s > F.lit(cfg.positive)),
        df.where(s < F.lit(cfg.negative)),
        df.where(F.abs(s) <= F.lit(cfg.neutral_band)),
    )


def _explode_samples(df: DataFrame, candidates: list[tuple[Column, str, Column, Column, Column]]) -> DataFrame:
    """One pass: each row emits the samples whose condition holds (classes may overlap)."""
    structs = [
        F.when(
            cond,
            F.struct(
                F.concat(F.lit(typ + ":"), F.col("id")).alias("sample_id"),
                F.col("user_message").alias("prompt"),
                chosen.cast("string").alias("chosen"),
                rejected.cast("string").alias("rejected"),
                weight.alias("weight"),
                _s().alias("sentiment"),
                F.lit(typ).alias("type"),
            ),
        )
        for cond, typ, chosen, rejected, weight in candidates
    ]
    return df.select(F.explode(F.array_compact(F.array(*structs))).alias("_x")).select("_x.*")


def whole_pool(df: DataFrame) -> DataFrame:
    """All interactions as one training pool, golden rows marked: one scan where pool and golden rows apart are two."""
    golden = F.coalesce(F.col("is_golden"), F.lit(False))
    return df.select("id", "user_message", "assistant_response", "weight", "sentiment", "is_refusal", golden.alias("_from_golden"))


def _tagged(pool: DataFrame, golden: DataFrame | None) -> DataFrame:
    cols = ["id", "user_message", "assistant_response", "weight", "sentiment", "is_refusal"]
    if golden is None:
        return pool.select(*cols, "_from_golden")
    return pool.select(*cols, F.lit(False).alias("_from_golden")).unionByName(
        golden.select(*cols, F.lit(True).alias("_from_golden"))
    )


def build_sft(pool: DataFrame, golden: DataFrame | None = None, cfg: Thresholds = DEFAULT) -> DataFrame:
    """Positive (chosen, w), negative (rejected only, 2w), neutral (chosen, 0.5w), golden (chosen, w).

    Classes are independent flags, so with asymmetric thresholds a pool row can
    yield two samples; one pass over pool + golden emits them all.  Without ``golden``
    the pool marks its golden rows itself (``whole_pool``).
    """
    s = F.col("sentiment")
    g = F.col("_from_golden")
    ar = F.col("assistant_response")
    nul = F.lit(None).cast("string")
    return _explode_samples(_tagged(pool, golden), [
        (~g & (s > F.lit(cfg.positive)), "positive", ar, nul, _w()),
        (~g & (s < F.lit(cfg.negative)), "negative", nul, ar, _w() * F.lit(2.0)),
        (~g & (F.abs(s) <= F.lit(cfg.neutral_band)), "neutral", ar, nul, _w() * F.lit(0.5)),
        (g, "golden", ar, nul, _w()),
    ])


def latest_rejections(rejections: DataFrame) -> DataFrame:
    """J4 lookup side: one rejection per prompt, the last (highest seq) non-empty one wins.

    A partial (map-side) aggregation, so a prompt with many replies costs one row per task.
    """
    present = F.coalesce(F.length("rejection"), F.lit(0)) > 0
    last = rejections.groupBy("prompt").agg(F.max_by("rejection", F.when(present, F.col("seq"))).alias("rejection"))
    return last.where(F.col("rejection").isNotNull())


def attach_rejections(samples: DataFrame, rejections: DataFrame, prompt: str = "user_message") -> DataFrame:
    """Left equi-join on the exact prompt text; adds ``rejection`` (null when missing).

    The lookup side holds one row per prompt; a hot prompt on the sample side is
    split by AQE's skew-join handling.
    """
    lookup = latest_rejections(rejections).withColumnRenamed("prompt", "_p")
    return samples.join(lookup, samples[prompt] == lookup["_p"], "left").drop("_p")


def build_dpo(pool: DataFrame, golden: DataFrame | None, rejections: DataFrame, cfg: Thresholds = DEFAULT) -> DataFrame:
    """D3: refusals first (rejected only), then positive / neutral / golden with their
    rejections (fallbacks as stated); negatives are dropped.  The refusal split applies to
    the pool only.  One join of (pool + golden) with the per-prompt lookup, one projection.
    ``golden`` may be None, as in ``build_sft``."""
    s = F.col("sentiment")
    g = F.col("_from_golden")
    refusal = F.coalesce(F.col("is_refusal"), F.lit(False))
    ar = F.col("assistant_response")
    rej = F.col("rejection")
    has = rej.isNotNull()
    nul = F.lit(None).cast("string")
    pos = ~g & ~refusal & (s > F.lit(cfg.positive))
    neu = ~g & ~refusal & (F.abs(s) <= F.lit(cfg.neutral_band))
    joined = attach_rejections(_tagged(pool, golden), rejections)
    return _explode_samples(joined, [
        (~g & refusal, "refusal_rejected_only", nul, ar, _w()),
        (pos & has, "positive_dpo", ar, rej, _w()),
        (pos & ~has, "positive_sft", ar, nul, _w()),
        (neu & has, "neutral_dpo", ar, rej, _w() * F.lit(0.5)),
        (g & has, "golden_dpo", ar, rej, _w() * F.lit(2.0)),
        (g & ~has, "golden_sft", ar, nul, _w() * F.lit(2.0)),
    ])


def dataset_composition(ds: DataFrame) -> DataFrame:
    """Per type: samples, SFT-usable (chosen present), preference pairs, fallbacks."""
    return ds.groupBy("type").agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(F.col("chosen").isNotNull()).alias("sft_usable"),
        F.count_if(F.col("rejected").isNotNull()).alias("preference_pairs"),
        F.count_if(F.col("rejected").isNull()).alias("fallbacks"),
    )


def rejection_prompts(pool: DataFrame, golden: DataFrame, cfg: Thresholds = DEFAULT) -> DataFrame:
    """Prompts of positive, then neutral pool rows, then golden rows (refusals kept).

    ``source_order`` (0, 1, 2) keeps the reference's order; dedupe only right
    before calling a generator.
    """
    pos, _neg, neu = _classes(pool, cfg)
    part = lambda d, i: d.select(F.col("id"), F.col("user_message").alias("prompt"), F.lit(i).alias("source_order"))
    return part(pos, 0).unionByName(part(neu, 1)).unionByName(part(golden, 2))


def clean_rejections(replies: DataFrame, content: str = "content", thinking: str = "thinking",
                     drop_short: bool = True) -> DataFrame:
    """List content -> text blocks joined by a space, else the string; strip; if
    empty use stripped thinking; keep only results longer than 10 characters.

    The JSON is parsed once into a column and read from there.  With
    ``drop_short=False`` short results are kept as a null ``rejection`` instead of
    being filtered, so a downstream aggregate can skip them without a filter that
    the optimizer would inline (and re-evaluate) below the parse.
    """
    staged = replies.select("*", F.try_parse_json(F.col(content)).alias("_v"))
    staged = staged.select("*", F.schema_of_variant("_v").alias("_k"))
    arr = F.try_variant_get("_v", "$", "array<variant>")
    blocks = F.array_join(
        F.transform(
            F.filter(arr, lambda e: F.schema_of_variant(e).startswith("OBJECT") & (F.try_variant_get(e, "$.type", "string") == "text")),
            lambda e: F.coalesce(F.try_variant_get(e, "$.text", "string"), F.lit("")),
        ),
        " ",
    )
    text = (
        F.when(F.col(content).isNull(), F.lit(""))
        .when(F.col("_k").startswith("ARRAY"), blocks)
        .when(F.col("_k") == "STRING", F.try_variant_get("_v", "$", "string"))
        .otherwise(F.col(content))
    )
    strip = lambda c: F.regexp_replace(c, f"^{WS}+|{WS}+$", "")
    staged = staged.select("*", strip(text).alias("_c"))
    cleaned = F.when((F.col("_c") == "") & (F.coalesce(F.col(thinking), F.lit("")) != ""), strip(F.col(thinking))).otherwise(F.col("_c"))
    staged = staged.select("*", cleaned.alias("_r")).drop("_v", "_k", "_c")
    if drop_short:
        return staged.withColumnRenamed("_r", "rejection").where(F.length("rejection") > 10)
    return staged.withColumn("rejection", F.when(F.length("_r") > 10, F.col("_r"))).drop("_r")


def fresh_rejections(cache: DataFrame, now, cfg: Thresholds = DEFAULT) -> DataFrame:
    """Cached rejections are reused unless older than the cache age (strictly greater)."""
    if isinstance(now, str):
        now = dt.datetime.fromisoformat(now)
    now_us = F.unix_micros(F.lit(now).cast("timestamp_ntz").cast("timestamp"))
    age_h = ((now_us - F.unix_micros(F.col("cached_at").cast("timestamp"))) / F.lit(1_000_000.0)) / F.lit(3600.0)
    return cache.where(~(age_h > F.lit(float(cfg.rejection_cache_hours))))


def with_split(ds: DataFrame, fraction: float | None = None, seed: int = 42, key: str = "sample_id", cfg: Thresholds = DEFAULT) -> DataFrame:
    """D9 as one frame: ``split`` is ``train`` for the first int(n * (1 - fraction)) rows of a
    seeded shuffle by md5(seed || key), else ``validation``.

    The boundary position is exact (found by counting over the narrow columns, no unpartitioned
    window); ``key`` must be unique.
    """
    fraction = cfg.validation_split if fraction is None else fraction
    order = [F.md5(F.concat(F.lit(str(seed)), F.col(key))), F.col(key)]
    first_k = before_boundary(order, kth_boundary(ds, order, lambda n: int(n * (1 - float(fraction)))))
    return ds.withColumn("split", F.when(first_k, F.lit("train")).otherwise(F.lit("validation")))


def split_train_val(ds: DataFrame, fraction: float | None = None, seed: int = 42, key: str = "sample_id",
                    cfg: Thresholds = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """D9 as two frames (``with_split`` computes the set once for both)."""
    both = with_split(ds, fraction, seed, key, cfg)
    return both.where("split = 'train'").drop("split"), both.where("split = 'validation'").drop("split")


def format_sft(ds: DataFrame) -> DataFrame:
    """Rows with chosen present (empty string kept) -> prompt, completion, weight."""
    return ds.where(F.col("chosen").isNotNull()).select("prompt", F.col("chosen").alias("completion"), "weight")


def format_dpo(ds: DataFrame) -> DataFrame:
    """Rows with non-empty chosen and rejected; prompt right-stripped of whitespace."""
    ok = (F.coalesce(F.length("chosen"), F.lit(0)) > 0) & (F.coalesce(F.length("rejected"), F.lit(0)) > 0)
    return ds.where(ok).select(F.regexp_replace("prompt", f"{WS}+$", "").alias("prompt"), "chosen", "rejected")


# The two chat templates (prompt part and full text).
TEMPLATES = {
    "chatml": ("<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n", "<|im_end|>"),
    "harmony": ("<|start|>user<|message|>", "<|end|><|start|>assistant<|channel|>final<|message|>", "<|return|>"),
}


def render_chat(ds: DataFrame, template: str = "chatml") -> DataFrame:
    """prompt_text and full_text for a formatted SFT row (prompt, completion)."""
    head, mid, tail = TEMPLATES[template]
    prompt_text = F.concat(F.lit(head), F.col("prompt"), F.lit(mid))
    return ds.withColumn("prompt_text", prompt_text).withColumn(
        "full_text", F.concat(prompt_text, F.col("completion"), F.lit(tail))
    )


def whitespace_hash_ids(text: Column, vocab: int = 32000) -> Column:
    """Default tokenizer: whitespace tokens -> 1 + (first 6 hex digits of md5) mod (vocab - 1).

    Id 0 is reserved for padding.  Deterministic and engine-independent.
    """
    toks = F.filter(F.split(F.regexp_replace(text, f"^{WS}+|{WS}+$", ""), f"{WS}+"), lambda t: t != "")
    return F.transform(toks, lambda t: (F.conv(F.substring(F.md5(t), 1, 6), 16, 10).cast("bigint") % (vocab - 1)) + 1)


def masks_from_ids(ds: DataFrame, full_ids: Column, prompt_ids: Column, max_len: int = 256, pad_id: int = 0) -> DataFrame:
    """Truncate / pad token ids and derive attention mask, prompt_len and labels natively.

    input_ids = full ids truncated to max_len and padded with ``pad_id``;
    prompt_len = prompt ids truncated to max_len // 2; labels = input_ids with the
    first prompt_len positions set to -100 (padding is not masked in labels).
    """
    staged = ds.withColumn("_ids", F.slice(full_ids, 1, max_len)).withColumn(
        "prompt_len", F.least(F.size(prompt_ids), F.lit(max_len // 2))
    )
    n = F.size("_ids")
    pad = F.array_repeat(F.lit(pad_id).cast("bigint"), F.lit(max_len) - n)
    staged = staged.withColumn("input_ids", F.concat("_ids", pad)).withColumn(
        "attention_mask", F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_len) - n))
    )
    labels = F.transform("input_ids", lambda x, i: F.when(i < F.col("prompt_len"), F.lit(-100).cast("bigint")).otherwise(x))
    return staged.withColumn("labels", labels).drop("_ids")


def tokenize_with_mask(ds: DataFrame, max_len: int = 256, vocab: int = 32000, pad_id: int = 0) -> DataFrame:
    """D13 with the default tokenizer (pluggable tokenizers: ``batchfn.tokenize_with``).

    Runs entirely in the JVM: whitespace tokens, md5-derived ids, then ``masks_from_ids``.
    """
    return masks_from_ids(
        ds, whitespace_hash_ids(F.col("full_text"), vocab), whitespace_hash_ids(F.col("prompt_text"), vocab), max_len, pad_id
    )

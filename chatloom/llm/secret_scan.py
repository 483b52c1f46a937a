"""Secret scan: candidates by pattern, false positives removed by a random forest (DataFrame functions and Spark ML only).

A candidate is a run of at least 16 key characters, of letters alone too, or
whatever stands in the position of a value, of any length: after ``=``, or in
quotes after ``:``, in the same word or the next.  Its features are its length, the transitions between its character classes, how
much of it dictionary words cover, its path, and its neighbouring words.  The
dictionary is the corpus' own: letter runs found in at least
``min_doc_frequency`` documents, counted over all of them.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import let, pin, text_of

CANDIDATE = r"[A-Za-z0-9_+/.@-]{16,}={0,2}"
#: A value inside a word, at the start of the word after ``=``, and after ``:`` (or ``=``) in quotes.
INLINE, PLAIN, QUOTED = r"""(?:=["']?|:["'])([^"'=\s]+)""", r"""^([^"'=\s]+)""", r"""^["']([^"'\s]+)"""
_ANY = CANDIDATE + r"""|=\s*["']?[^"'=\s]|:\s*["'][^"'\s]"""
_CLASSES = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "other": r"_+/.@=\-"}
#: Words that often stand near a secret, and parts of paths that often hold made-up ones.
NEAR_WORDS = ("key", "token", "secret", "password", "passwd", "pwd", "auth", "credential", "api")
TEST_PATHS = ("test", "example", "sample", "fixture", "mock", "demo", "doc")
#: Words of the context before a candidate.
BEFORE = 3
_HASHED = 64


def find_candidates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path_column: str = "source") -> DataFrame:
    """``(doc_id, no, value, before, after, path)``: every candidate of every whole text, numbered from 0 in its text."""
    def values(words: Column, i: Column) -> Column:
        word, prior = F.get(words, i), F.coalesce(F.get(words, i - 1), F.lit(""))
        return F.array_distinct(F.concat(
            F.regexp_extract_all(word, F.lit(CANDIDATE), 0), F.regexp_extract_all(word, F.lit(INLINE), 1),
            F.when(prior.rlike("[=:]$"), F.regexp_extract_all(word, F.lit(QUOTED), 1)).otherwise(F.array().cast("array<string>")),
            F.when(prior.endswith("="), F.regexp_extract_all(word, F.lit(PLAIN), 1)).otherwise(F.array().cast("array<string>"))))

    def of_words(words: Column) -> Column:
        def one(i: Column) -> Column:
            word = F.get(words, i)
            before = F.lower(F.array_join(F.slice(words, F.greatest(i - BEFORE, F.lit(0)) + 1, F.least(i, F.lit(BEFORE))), " "))
            after = F.lower(F.coalesce(F.get(words, i + 1), F.lit("")))
            return F.transform(
                values(words, i),
                lambda v: F.struct(
                    v.alias("value"),
                    F.concat_ws(" ", before, F.lower(F.substr(word, F.lit(1), F.instr(word, v) - 1))).alias("before"), after.alias("after")))

        def may(i: Column) -> Column:
            return F.get(words, i).rlike(CANDIDATE + "|" + INLINE) | F.coalesce(F.get(words, i - 1).rlike("[=:]$"), F.lit(False))

        places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), may)
        return F.flatten(F.transform(places, one))

    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(path_column).cast("string"), F.lit("")).alias("path"), text_of(text_column).alias("text"))
    found = rows.filter(F.col("text").rlike(_ANY)).select("doc_id", "path", F.posexplode(let(F.split("text", r"\s+", -1), of_words)).alias("no", "c"))
    return found.select("doc_id", "no", "c.value", "c.before", "c.after", "path")


def _transitions(value: Column) -> dict[str, Column]:
    """Share of neighbouring characters that step from one class to another."""
    pairs = F.greatest(F.length(value) - 1, F.lit(1))
    return {
        f"{a}_{b}": F.regexp_count(value, F.lit(f"(?<=[{x}])[{y}]")) / pairs
        for a, x in _CLASSES.items() for b, y in _CLASSES.items()
    }


def candidate_features(candidates: DataFrame, docs: DataFrame, text_column: str = "text", min_doc_frequency: int = 5) -> DataFrame:
    """Candidates with their numeric features and the words around them."""
    value = F.col("value")
    numeric = {
        "n_chars": F.length(value).cast("double"),
        "distinct_share": F.size(F.array_distinct(F.split(value, ""))) / F.length(value),
        "vowel_share": F.regexp_count(value, F.lit("[aeiouAEIOU]")) / F.length(value),
        "is_hex": value.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"),
        **_transitions(value),
        "path_depth": F.regexp_count("path", F.lit("/")).cast("double"),
        "path_is_test": F.lower("path").rlike("|".join(TEST_PATHS)).cast("double"),
        "path_bucket": F.pmod(F.xxhash64("path"), F.lit(32)).cast("double"),
        "near_word": F.col("before").rlike("|".join(NEAR_WORDS)).cast("double"),
        "assigned": F.col("before").rlike(r"[=:]\s*[\"']?$").cast("double"),
    }
    around = F.filter(F.split(F.concat_ws(" ", F.regexp_replace("before", r"[^\p{L}\p{N}]+", " "), F.regexp_replace("after", r"[^\p{L}\p{N}]+", " ")), " "), lambda w: w != "")
    # the same value in the same surroundings has the same features: work on distinct ones
    letters = candidates.select("value").distinct().withColumn("run", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{3,}"), 0)))
    words = (
        docs.select(F.explode(F.array_distinct(F.split(F.lower(text_of(text_column)), r"\P{L}+", -1))).alias("run"))
        .filter(F.col("run").rlike("^[a-z]{3,}$"))
        .groupBy("run").count().filter(F.col("count") >= min_doc_frequency).select("run")
    )
    cover = letters.join(words, "run").groupBy("value").agg(F.sum(F.length("run")).alias("covered"))
    return (
        candidates.join(cover, "value", "left")
        .withColumn("coverage", F.coalesce("covered", F.lit(0)) / F.length("value"))
        .withColumns(numeric).withColumn("around", around).drop("covered")
    )


def uncovered(findings: DataFrame, candidates: DataFrame) -> DataFrame:
    """Labelled findings that are no candidates, whatever their label: the forest never sees them."""
    known = findings.filter("value IS NOT NULL").select("doc_id", "value").distinct()
    own = candidates.select(F.col("doc_id").alias("c_id"), F.col("value").alias("c_value")).distinct()
    return known.join(own, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("value") == F.col("c_value")), "left_anti")


def feature_names() -> list[str]:
    return ["n_chars", "distinct_share", "vowel_share", "is_hex", *(f"{a}_{b}" for a in _CLASSES for b in _CLASSES),
            "path_depth", "path_is_test", "path_bucket", "near_word", "assigned", "coverage"]


def fit_forest(features: DataFrame, findings: DataFrame, max_findings: int = 20_000, trees: int = 20, depth: int = 6, seed: int = 7) -> PipelineModel | None:
    """A random forest from labelled findings ``(doc_id, value, label)``; None unless both labels occur.

    At most ``max_findings`` findings, the first by hash, are used (a bound of
    the training sample only).  Findings with a null or contradictory label
    teach nothing, nor do those that are no candidates (``uncovered`` lists them).
    """
    known = (
        findings.select(F.col("doc_id").cast("long").alias("f_id"), F.col("value").alias("f_value"), F.col("label").cast("double").alias("label"))
        .groupBy("f_id", "f_value").agg(F.min("label").alias("label"), F.max("label").alias("label2"))
        .filter("label = label2 AND label IN (0, 1)").drop("label2")
        .orderBy(F.xxhash64("f_id", "f_value"), "f_id", "f_value").limit(max_findings)
    )
    rows = pin(features.join(known, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("value") == F.col("f_value"))).select("around", "label", *feature_names()))
    if len(rows.select("label").distinct().limit(3).collect()) < 2:
        return None
    return Pipeline(stages=[
        HashingTF(inputCol="around", outputCol="around_tf", numFeatures=_HASHED),
        VectorAssembler(inputCols=[*feature_names(), "around_tf"], outputCol="features"),
        RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed),
    ]).fit(rows)


def secret_scan(docs: DataFrame, findings: DataFrame, id_column: str = "doc_id", text_column: str = "text", path_column: str = "source",
                threshold: float = 0.5, max_findings: int = 20_000, min_doc_frequency: int = 5) -> DataFrame:
    """Per candidate: doc_id, no, value, probability of a real secret, secret (probability >= threshold).

    Null and empty texts have no candidates, a null path is empty.  Rows that
    repeat give their candidates again.  Without labelled findings of both
    kinds nothing is filtered: every candidate has probability 1.  An empty
    table gives an empty result.  Columns other than those named are not read.
    """
    candidates = pin(find_candidates(docs, id_column, text_column, path_column))
    features = pin(candidate_features(candidates, docs, text_column, min_doc_frequency))
    model = fit_forest(features, findings, max_findings)
    if model is None:
        scored = features.withColumn("chance", F.lit(1.0))
    else:
        scored = model.transform(features).withColumn("chance", F.element_at(vector_to_array("probability"), 2))
    return scored.select("doc_id", "no", "value", F.col("chance").alias("probability"), (F.col("chance") >= threshold).alias("secret"))

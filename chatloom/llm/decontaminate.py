"""Benchmark decontamination by word windows (DataFrame functions only).

Words are runs of letters, digits and non-ASCII characters, with A-Z lower-cased.
A window is 13 consecutive words of a benchmark item, or a whole shorter item.
A document word inside an occurrence of a window is hit.

The windows are a hash set that travels with the tasks, only up to
``set_limit`` windows, which is checked.  A document is scanned in full only if
one of its aligned shorter grams (every seventh word for 13-word windows) is a
gram of a window: any occurrence contains such a gram, so nothing is missed.
Hits are verified as strings.  With more windows than the limit, windows and
document grams meet in a shuffled join instead; the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import id_of_key, let, packed, pin, text_of

#: The contract's words: everything but ASCII characters that are neither letters nor digits.
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    # splitting is linear in the text; extracting all matches copies the text for each of them
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), GAPS, -1), "")


def _gram(words: Column, start: Column, size: int) -> Column:
    """``size`` words from ``start`` (counted from 0) as one string."""
    return F.array_join(F.slice(words, start + 1, size), " ")


def _starts(n: Column, size: int, step: int = 1) -> Column:
    return F.when(n >= size, F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))


def benchmark_windows(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text", size: int = 13) -> DataFrame:
    """``(item_id, length, window)``, distinct: every window of every item (none without words)."""
    items = benchmark.select(F.col(id_column).cast("string").alias("item_id"), words_of(text_of(text_column)).alias("w"))
    whole = F.struct(F.size("w").alias("length"), F.array_join("w", " ").alias("window"))
    sliding = F.transform(_starts(F.size("w"), size), lambda i: F.struct(F.lit(size).alias("length"), _gram(F.col("w"), i, size).alias("window")))
    found = F.when(F.size("w") >= size, sliding).when(F.size("w") > 0, F.array(whole))
    return items.select("item_id", F.explode(found).alias("x")).select("item_id", "x.length", "x.window").distinct()


def _hits_in_row(windows: list, text: Column) -> Column:
    """(n_words, hits) of one text against a bounded set of windows; a hit is (start, length, window)."""
    by_length: dict[int, list[str]] = {}
    for row in windows:
        by_length.setdefault(row.length, []).append(row.window)

    def scan(words: Column) -> Column:
        found = []
        for length, texts in sorted(by_length.items()):
            part = (length + 1) // 2  # any occurrence holds a whole gram that starts at a multiple of this
            grams = {" ".join(t.split(" ")[i:i + part]) for t in texts for i in range(length - part + 1)}
            maybe = F.exists(_starts(F.size(words), part, part), lambda i: _gram(words, i, part).isin(sorted(grams)))
            at = F.transform(_starts(F.size(words), length), lambda i: F.struct(i.alias("start"), F.lit(length).alias("length"), _gram(words, i, length).alias("window")))
            hits = F.filter(at, lambda h: h["window"].isin(sorted(texts)))
            found.append(F.when(maybe, hits).otherwise(F.array().cast("array<struct<start:int,length:int,window:string>>")))
        all_hits = F.array_sort(F.flatten(F.array(*found))) if found else F.array().cast("array<struct<start:int,length:int,window:string>>")
        return F.struct(F.size(words).cast("long").alias("n_words"), all_hits.alias("hits"))

    return let(words_of(text), scan)


def _hits_by_join(docs: DataFrame, distinct: DataFrame, lengths: list[int], id_column: str, text_column: str) -> DataFrame:
    """``(k1, k2, hits)``: document grams meet the windows in a shuffled join."""
    base = packed(docs, id_column, text_column).select("k1", "k2", words_of(text_of(f"row.{text_column}")).alias("w")).dropDuplicates(["k1", "k2"])

    def grams_of(n: int) -> Column:
        return F.transform(_starts(F.size("w"), n), lambda i: F.struct(i.alias("start"), F.lit(n).alias("length"), _gram(F.col("w"), i, n).alias("window")))

    grams = F.concat(*[grams_of(n) for n in lengths])
    return (
        base.select("k1", "k2", F.explode(grams).alias("g")).select("k1", "k2", "g.*")
        .join(distinct.hint("merge"), ["length", "window"])
        .groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("start", "length", "window"))).alias("hits"))
    )


def with_hits(docs: DataFrame, windows: DataFrame, id_column: str = "doc_id", text_column: str = "text", set_limit: int = 50_000) -> DataFrame:
    """``(k1, k2, row, n_words, hits)``: every row, packed, with its occurrences of windows in order."""
    distinct = windows.select("length", "window").distinct()
    held = distinct.limit(set_limit + 1).collect()  # at most the limit and one
    rows = packed(docs, id_column, text_column)
    text = F.coalesce(F.col("row").getField(text_column).cast("string"), F.lit(""))
    if len(held) <= set_limit:
        return rows.withColumn("s", _hits_in_row(held, text)).select("k1", "k2", "row", "s.n_words", "s.hits")
    lengths = sorted(r.length for r in distinct.select("length").distinct().collect())  # at most the window size
    hits = _hits_by_join(docs, distinct, lengths, id_column, text_column)
    none = F.array().cast("array<struct<start:int,length:int,window:string>>")
    return rows.join(hits, ["k1", "k2"], "left").select("k1", "k2", "row", F.size(words_of(text)).cast("long").alias("n_words"), F.coalesce("hits", none).alias("hits"))


def hit_words(hits: Column) -> Column:
    """Number of words inside at least one hit; ``hits`` ascending by start."""
    def step(acc: Column, h: Column) -> Column:
        end = h["start"] + h["length"]
        return F.struct((acc["n"] + F.greatest(F.lit(0), end - F.greatest(h["start"], acc["end"]))).alias("n"), F.greatest(acc["end"], end).alias("end"))

    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(hits, zero, step, lambda acc: acc["n"].cast("long"))


def _contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  size: int = 13, set_limit: int = 50_000, item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    ``contaminated``: n_hit > 0 and 20 * n_hit >= n_words.  Null and empty
    texts have no words and no hits; null item ids are left out of the items.
    Rows that repeat are rows of the result too.  An empty table on either side
    is no error.  Columns other than the named ones are not read.
    """
    windows = benchmark_windows(benchmark, item_column, item_text, size)
    found = with_hits(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")), windows, set_limit=set_limit)
    # one row at least for each row of docs; pinned, for a task that ran anew could number its rows otherwise
    numbered = pin(found.select(
        F.monotonically_increasing_id().alias("rid"), "k1", "n_words", hit_words(F.col("hits")).alias("n_hit"),
        F.array_distinct(F.transform("hits", lambda h: h["window"])).alias("windows")))
    rows = numbered.select("rid", "k1", "n_words", "n_hit", F.explode_outer("windows").alias("window"))
    items = windows.groupBy("window").agg(F.collect_set("item_id").alias("items"))
    joined = rows.join(items, "window", "left")
    per_row = joined.groupBy("rid", "k1", "n_words", "n_hit").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return per_row.select(
        id_of_key("k1").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        _contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", id_column: str = "doc_id", text_column: str = "text",
                  size: int = 13, set_limit: int = 50_000, item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows with all their columns, free of benchmark text.

    ``mode="documents"`` drops contaminated documents and leaves the others as
    they are; ``mode="spans"`` keeps every row and removes the hit words, each
    with what separates it from the next word.
    """
    if mode not in ("documents", "spans"):
        raise ValueError("mode must be documents or spans")
    found = with_hits(docs, benchmark_windows(benchmark, item_column, item_text, size), id_column, text_column, set_limit)
    if mode == "documents":
        return found.filter(~_contaminated(hit_words(F.col("hits")), F.col("n_words"))).select("row.*")
    text = F.col("row").getField(text_column)

    def cut(words: Column) -> Column:
        def join(gaps: Column) -> Column:
            def keep(i: Column) -> Column:
                gone = F.exists(F.col("hits"), lambda h: (h["start"] <= i) & (i < h["start"] + h["length"]))
                return F.when(gone, F.lit("")).otherwise(F.concat(F.get(words, i), F.get(gaps, i + 1)))

            return F.concat(F.get(gaps, F.lit(0)), F.array_join(F.transform(F.sequence(F.lit(0), F.size(words) - 1), keep), ""))

        return let(F.split(text, WORDS, -1), join)

    clean = F.when(F.size("hits") > 0, let(F.array_remove(F.split(text, GAPS, -1), ""), cut)).otherwise(text)
    return found.select(F.col("row").withField(f"`{text_column}`", clean).alias("row")).select("row.*")

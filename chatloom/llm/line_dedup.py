"""Line dedup by content-defined chunks (DataFrame functions only).

Over the lines that have a word runs a rolling hash of the hashes of the last
``window`` of them; a chunk ends where it is less than at the line before and
at the line after.  Such lines are never neighbours, so every chunk of a text
with two worded lines has at least two, and boundaries depend on nearby lines
alone, so a passage that is shifted by inserted lines is cut the same way from
its second boundary on.  Chunks that occur earlier, in any document, are
removed; they are found by digest and compared by their bytes.  A later copy of
a whole text of two worded lines or more is removed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import WORD, copies_of, id_of_key, keyed, let, packed, pin, with_gone

#: Modulus and base of the rolling hash; products stay below 2^52.
PRIME = (1 << 31) - 1
BASE = 1_000_003


def _line_hashes(lines: Column) -> Column:
    return F.transform(lines, lambda line: F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long"))


def _last_lines(lines: Column, hashes: Column, window: int) -> Column:
    """Numbers (from 1) of the lines that end a chunk."""
    n = F.size(lines)

    def of_worded(worded: Column) -> Column:
        m = F.size(worded)

        def rolled(j: Column) -> Column:
            first = F.greatest(j - (window - 1), F.lit(1))
            last = F.slice(worded, first, j - first + 1)
            return F.aggregate(last, F.lit(0).cast("long"), lambda a, i: (a * BASE + F.element_at(hashes, i)) % PRIME)

        def of_rolls(rolls: Column) -> Column:
            inner = F.when(m >= 4, F.sequence(F.lit(2), m - 2)).otherwise(F.array().cast("array<int>"))
            least = F.filter(inner, lambda j: (F.element_at(rolls, j) < F.element_at(rolls, j - 1)) & (F.element_at(rolls, j) < F.element_at(rolls, j + 1)))
            return F.concat(F.transform(least, lambda j: F.element_at(worded, j)), F.array(n))

        positions = F.when(m >= 1, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<int>"))
        return let(F.transform(positions, rolled), of_rolls)

    return let(F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(lines, i).rlike(WORD)), of_worded)


def chunks_of(text: Column, window: int, with_text: bool) -> Column:
    """Array of (no, first, last, n_worded, digest[, body]) of one text; line numbers count from 1."""
    def build(lines: Column) -> Column:
        def of_cuts(cuts: Column) -> Column:
            def chunk(last: Column, no: Column) -> Column:
                first = F.when(no == 0, F.lit(1)).otherwise(F.get(cuts, no - 1) + 1)

                def fields(body_lines: Column) -> Column:
                    def finish(body: Column) -> Column:
                        found = [no.alias("no"), first.alias("first"), last.alias("last"),
                                 F.size(F.filter(body_lines, lambda x: x.rlike(WORD))).alias("n_worded"), F.xxhash64(body).alias("digest")]
                        return F.struct(*found, *([body.alias("body")] if with_text else []))

                    return let(F.array_join(body_lines, "\n"), finish)

                return let(F.slice(lines, first, last - first + 1), fields)

            return F.transform(cuts, chunk)

        return let(let(_line_hashes(lines), lambda h: _last_lines(lines, h, window)), of_cuts)

    return let(F.split(text, "\n", -1), build)


def repeated_chunks(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 2) -> tuple[DataFrame, DataFrame]:
    """``(k1, k2, gone)``: per document key the numbers of the chunks to remove; and ``(k1, k2, no)`` of all chunks that can be.

    Digests are counted first (narrow rows, combined map-side); only the texts
    of chunks with a repeated digest are compared, by grouping on the bytes.
    The chunk that starts earliest by (id, text hash, number) stays.
    """
    base = keyed(docs, id_column, text_column)
    listed = base.select("k1", "k2", F.explode(chunks_of(F.col("text"), window, False)).alias("c")).filter("c.n_worded >= 2")
    narrow = pin(listed.select("k1", "k2", "c.no", "c.digest"))
    shared = pin(narrow.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest"))  # for a join that splits, as below
    by_doc = narrow.join(shared, "digest").groupBy("k1", "k2").agg(F.collect_set("no").alias("numbers"))
    bodies = base.join(by_doc, ["k1", "k2"]).select(
        "k1", "k2", F.explode(let(chunks_of(F.col("text"), window, True), lambda chunks: F.transform("numbers", lambda no: F.get(chunks, no)))).alias("c"),
    ).select("k1", "k2", "c.no", "c.digest", "c.body")
    place = F.struct("k1", "k2", "no")
    # pinned, so that the join has an exchange on either side and a frequent chunk's places can be split among tasks
    first = pin(bodies.groupBy("digest", "body").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("last > first").select("digest", "body", "first"))
    gone = bodies.join(first, ["digest", "body"]).filter(place > F.col("first"))
    return gone.groupBy("k1", "k2").agg(F.collect_set("no").alias("gone")), narrow.select("k1", "k2", "no")


def without_chunks(text: Column, gone: Column, window: int) -> Column:
    """(text, n_lines, n_chunks, n_removed_lines, n_removed_chunks) after dropping the numbered chunks."""
    def build(lines: Column) -> Column:
        def of_chunks(chunks: Column) -> Column:
            at = lambda numbers: F.transform(numbers, lambda no: F.get(chunks, no))
            dropped = at(gone)
            kept = at(F.array_except(F.sequence(F.lit(0), F.size(chunks) - 1), gone))  # one pass over either array
            return F.struct(
                F.array_join(F.transform(kept, lambda c: F.array_join(F.slice(lines, c["first"], c["last"] - c["first"] + 1), "\n")), "\n").alias("text"),
                F.size(lines).cast("long").alias("n_lines"), F.size(chunks).cast("long").alias("n_chunks"),
                F.aggregate(dropped, F.lit(0).cast("long"), lambda a, c: a + c["last"] - c["first"] + 1).alias("n_removed_lines"),
                F.size(dropped).cast("long").alias("n_removed_chunks"),
            )

        return let(chunks_of(text, window, False), of_chunks)

    return let(F.split(text, "\n", -1), build)


def line_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 2) -> DataFrame:
    """Per row: doc_id, text without repeated chunks, and counts of lines and chunks before and removed.

    A null text counts as empty (one empty line, never removed).  Of rows that
    repeat both id and text one comes first and the others repeat its chunks;
    rows that share only the id are ordered by text hash; null ids come last.  An empty table gives an
    empty result.  Other columns are not read.
    """
    gone, places = repeated_chunks(docs, id_column, text_column, window)
    none = F.array().cast("array<int>")
    joined = with_gone(keyed(docs, id_column, text_column), gone, copies_of(places))
    return joined.select(
        id_of_key("k1").alias("doc_id"),
        without_chunks(F.col("text"), F.coalesce("gone", none), window).alias("r"),
    ).select("doc_id", "r.*")


def dedup_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 2,
                length_column: str | None = None) -> DataFrame:
    """All rows and columns, the text without its repeated chunks.

    Untouched texts, nulls included, stay as they are.  ``length_column``, if
    given, is set to the length of a changed text.
    """
    gone, places = repeated_chunks(docs, id_column, text_column, window)
    joined = with_gone(packed(docs, id_column, text_column), gone, copies_of(places))
    old = F.col("row").getField(text_column)
    new = F.when(F.col("gone").isNull(), old).otherwise(
        without_chunks(F.coalesce(old.cast("string"), F.lit("")), F.col("gone"), window)["text"])
    changed = joined.select(F.col("row").withField(f"`{text_column}`", new).alias("row"), F.col("gone").isNotNull().alias("changed"))
    if length_column:
        field = F.col("row").getField(length_column)
        kind = docs.schema[length_column].dataType
        length = F.when(F.col("changed"), F.length(F.col("row").getField(text_column)).cast(kind)).otherwise(field)
        changed = changed.withColumn("row", F.col("row").withField(f"`{length_column}`", length))
    return changed.select("row.*")

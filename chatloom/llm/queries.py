"""The registered queries of the training-data operators, with production parameters, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm import alignment, decontaminate, line_dedup, merkle, mixing, quality_classifier, quality_rules, secret_scan, simhash, suffix_dedup, toxicity, unit_dedup, warc
from chatloom.session import read_table

#: The contract's parameters.
SHINGLE, MAX_BITS, SUBSTRING_BYTES, WINDOW_WORDS = 3, 2, 100, 13


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules over all documents: base counts, votes, posterior, kept."""
    return quality_rules.quality_rules(read_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup over all documents: counts and the digest of what is left."""
    out = line_dedup.line_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_chunks", "n_removed_lines", "n_removed_chunks", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compression classifier fitted on labels.quality, over all documents."""
    docs = read_table(spark, sf_dir, "documents")
    return quality_classifier.score_quality(docs, quality_classifier.fit_compression(docs, read_table(spark, sf_dir, "labels")))


def responses_of(pages: DataFrame) -> DataFrame:
    """Pages as response records (stand-in input: the ids, dates and headers a crawler would have written)."""
    digest = F.sha1(F.col("html").cast("binary"))
    return pages.select(
        F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws("|", "page_id", "url").cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce("page_id", F.lit(0)) % 10_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        F.lit("HTTP/1.1 200 OK").alias("http_status"),
        F.array(
            F.struct(F.lit("Content-Type").alias("name"), F.lit("text/html; charset=utf-8").alias("value")),
            F.struct(F.lit("Content-Length").alias("name"), F.octet_length("html").cast("string").alias("value")),
            F.struct(F.lit("Server").alias("name"), F.lit("stand-in").alias("value")),
        ).alias("http_headers"),
        F.col("html").cast("binary").alias("payload"), F.concat(F.lit("sha1:"), digest).alias("payload_digest"),
    )


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of all pages."""
    return warc.warc_derivatives(responses_of(read_table(spark, sf_dir, "pages")))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.simhash_components(read_table(spark, sf_dir, "documents"), shingle=SHINGLE, max_bits=MAX_BITS)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document inside a 100-byte string that starts earlier."""
    out = suffix_dedup.substring_dedup(read_table(spark, sf_dir, "documents"), length=SUBSTRING_BYTES, keep_bytes=False)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in every document."""
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), size=WINDOW_WORDS)


def findings_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled findings of documents in ``labels`` (stand-in input: there is no table of findings).

    The label follows from what a value is, never from where it stands: 40 hex digits are an access
    token (real); a number with a valid Luhn checksum, a mail or IP address and a word of letters
    alone are not.  Other values have no label.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).filter(F.col("t").rlike(r"[0-9A-Za-z@._+/-]{16,}|[=:]\s*[\"']"))
    values = texts.select("doc_id", F.explode(F.array_distinct(F.concat(
        F.regexp_extract_all("t", F.lit(r"[A-Za-z0-9_+/.@-]{16,}={0,2}"), 0),
        F.regexp_extract_all("t", F.lit(r"""[=:]\s*["']([^"'\s]+)"""), 1)))).alias("value"))
    value = F.col("value")
    label = (
        F.when(value.rlike("^(?i)[0-9a-f]{40}$"), 1)
        .when(value.rlike("^[0-9]{13,19}$"), F.when(F.call_function("luhn_check", value), 0))
        .when(value.rlike(r"^[^@]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$|^[0-9]{1,3}(\.[0-9]{1,3}){3}$|^[A-Za-z]+$"), 0))
    found = values.withColumn("label", label).filter("label IS NOT NULL")
    # narrow rows meet the labels; a semi join would be pushed below the extraction and shuffle the texts
    return found.join(labels.select("doc_id").distinct(), "doc_id")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate secret of every document with its probability."""
    docs = read_table(spark, sf_dir, "documents")
    return secret_scan.secret_scan(docs, findings_of(docs, read_table(spark, sf_dir, "labels")))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mixture takes of every document."""
    return mixing.mix_plan(read_table(spark, sf_dir, "documents"))


def op10_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every document in paragraphs that occur earlier, with their offsets."""
    out = unit_dedup.unit_dedup(read_table(spark, sf_dir, "documents"))
    offsets = F.array_join(F.transform("removed", lambda r: F.concat_ws("-", r["begin"].cast("string"), r["stop"].cast("string"))), ",")
    return out.select("doc_id", "n_units", "n_removed", offsets.alias("removed_offsets"), F.md5(F.col("kept").cast("binary")).alias("kept_md5"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle leaf, subroot, root and checked proof of every document."""
    return merkle.audit(read_table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Convolutional classifier fitted on labels.toxic, over all documents."""
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, read_table(spark, sf_dir, "labels")))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of two public tokenizers over every document."""
    return alignment.cross_tokenizer_alignment(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_quality_rules, op2_line_dedup, op3_quality_classifier, op4_warc_derivatives, op5_simhash_near_dedup,
        op6_suffix_array_dedup, op7_benchmark_decontamination, op8_secret_scan, op9_mix_sources, op10_unit_dedup, op11_merkle_manifest,
        op12_toxicity, op13_cross_tokenizer_alignment)
}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op2_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h, regexp_matches(line, '[^\x20\x09-\x0D]') AS worded, count(*) OVER (PARTITION BY doc_id) AS n FROM l),
r AS (
  SELECT doc_id, i, row_number() OVER w AS j, count(*) OVER (PARTITION BY doc_id) AS m,
         (coalesce(lag(h) OVER w % 2147483647, 0) * 1000003 + h) % 2147483647 AS roll
  FROM h WHERE worded WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
b AS (SELECT doc_id, i FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i) QUALIFY j BETWEEN 2 AND m - 2 AND roll < lag(roll) OVER w AND roll < lead(roll) OVER w),
e AS (SELECT h.*, CASE WHEN h.i = n OR b.i IS NOT NULL THEN 1 ELSE 0 END AS ends FROM h LEFT JOIN b ON b.doc_id = h.doc_id AND b.i = h.i),
c AS (SELECT *, sum(ends) OVER (PARTITION BY doc_id ORDER BY i) - ends AS no FROM e),
chunk AS (
  SELECT doc_id, no, string_agg(line, chr(10) ORDER BY i) AS body, count(*) AS lines,
         count(*) FILTER (WHERE worded) AS worded, min(i) AS first
  FROM c GROUP BY doc_id, no),
seen AS (SELECT *, worded >= 2 AND row_number() OVER (PARTITION BY body, worded >= 2 ORDER BY doc_id, no) > 1 AS gone FROM chunk)
SELECT doc_id, sum(lines)::BIGINT AS n_lines, count(*)::BIGINT AS n_chunks,
       coalesce(sum(lines) FILTER (WHERE gone), 0)::BIGINT AS n_removed_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_removed_chunks,
       md5(coalesce(string_agg(body, chr(10) ORDER BY first) FILTER (WHERE NOT gone), '')) AS kept_md5
FROM seen GROUP BY doc_id""",
    "op6_suffix_array_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, s, substr(x, 2 * s + 1, 200) AS win
      FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 99)) AS s FROM d WHERE length(x) >= 200)),
dup AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS k FROM w) WHERE k > 1),
marked AS (SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 1 ELSE 0 END AS fresh FROM dup),
run AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b
        FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS r FROM marked) GROUP BY doc_id, r),
cut AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM run),
agg AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS last,
               string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
        FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN agg USING (doc_id)""",
    "op7_benchmark_decontamination": rf"""
WITH b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, 13 AS len, array_to_string(w[i + 1:i + 13], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(0, len(w) - 12)) AS i FROM b WHERE len(w) >= 13)
  UNION ALL SELECT DISTINCT item_id, len(w), array_to_string(w, ' ') FROM b WHERE len(w) BETWEEN 1 AND 12),
d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, i, n AS len, array_to_string(w[i + 1:i + n], ' ') AS t
      FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT len AS n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, len, item_id FROM g JOIN win USING (len, t)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + len)) AS p FROM (SELECT DISTINCT doc_id, i, len FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op9_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(concat('mix', coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-'), coalesce(strlen(source) || ':' || source, '-'),
                    coalesce(strlen(text) || ':' || text, '-'))) AS key
  FROM documents),
n AS (SELECT *, ('0x' || substr(md5(key || '|' || (row_number() OVER (PARTITION BY key) - 1)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS turn FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size * size)::BIGINT AS squares FROM d GROUP BY source),
p AS (SELECT *, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 3 * source_size AS stop FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY stop::DOUBLE / weight, source) AS k FROM p),
r AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(stop) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
             (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS open FROM o),
f AS (SELECT k, rest, open FROM r WHERE NOT stop::DOUBLE < rest::DOUBLE * weight / open::DOUBLE ORDER BY k LIMIT 1),
t AS (SELECT o.source, o.source_size, o.squares, CASE WHEN o.k < f.k THEN o.stop::DOUBLE ELSE f.rest::DOUBLE * o.weight / f.open::DOUBLE END AS target FROM o, f)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN turn < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken,
       sqrt((rate - floor(rate)) * (1 - (rate - floor(rate))) * squares) AS target_error
FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate
      FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source)""",
    "op10_unit_dedup": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS toks,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS plain
  FROM documents),
w AS (SELECT doc_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM t),
c AS (
  SELECT *, coalesce(sum(CASE WHEN contains(tok, chr(10)) OR regexp_matches(tok, '[.!?][\x20\x09-\x0D]+$') THEN 1 ELSE 0 END)
                       OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no,
         coalesce(sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM w),
s AS (
  SELECT doc_id, no, min(i) - 1 AS a, max(i) AS b, min(i) + 19 AS need, min(pos) AS pos, string_agg(tok, '' ORDER BY i) AS body FROM c GROUP BY doc_id, no),
run AS (SELECT s.doc_id, s.no, s.a, e.b FROM s ASOF JOIN s e ON s.doc_id = e.doc_id AND s.need <= e.b),
par AS (
  SELECT * FROM run
  UNION ALL SELECT doc_id, 0, 0, len(plain) FROM t WHERE len(plain) BETWEEN 1 AND 19),
seen AS (
  SELECT par.*, row_number() OVER (PARTITION BY array_to_string(plain[a + 1:b], ' ') ORDER BY doc_id, no) > 1 AS gone
  FROM par JOIN t USING (doc_id)),
lost AS (SELECT DISTINCT s.doc_id, s.no FROM s JOIN seen p ON p.gone AND p.doc_id = s.doc_id AND p.a <= s.a AND s.b <= p.b),
m AS (
  SELECT s.*, lost.no IS NOT NULL AS gone, length(t.text) - list_sum(list_transform(t.toks, lambda x: length(x))) + s.pos AS start
  FROM s JOIN t USING (doc_id) LEFT JOIN lost ON lost.doc_id = s.doc_id AND lost.no = s.no),
r AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS n_gone, min(start) AS lead,
         string_agg(start::BIGINT::VARCHAR || '-' || (start + length(regexp_replace(body, '[\x20\x09-\x0D]+$', '')))::BIGINT::VARCHAR, ',' ORDER BY no) FILTER (WHERE gone) AS cut,
         string_agg(body, '' ORDER BY no) FILTER (WHERE NOT gone) AS rest
  FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_units, coalesce(n_gone, 0)::BIGINT AS n_removed, coalesce(cut, '') AS removed_offsets,
       md5(CASE WHEN n IS NULL THEN text ELSE substr(text, 1, lead::BIGINT) || coalesce(rest, '') END) AS kept_md5
FROM t LEFT JOIN r USING (doc_id)""",
    "op11_merkle_manifest": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, concat(
           coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-'), coalesce(strlen(source) || ':' || source, '-'),
           coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-')) AS head, text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
             lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 2 = 0 AS tampered
  FROM documents),
leaf AS (
  SELECT *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) AS broken,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM d),
up AS (
  SELECT 0 AS lvl, source, pos, n, leaf AS digest FROM leaf
  UNION ALL
  SELECT lvl + 1, source, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY lvl, source, pos // 3),
sub AS (SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS lvl, pos, n, digest FROM sub
  UNION ALL
  SELECT lvl + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 3),
kin AS (
  SELECT lvl, source, pos, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM up WHERE n > 1 WINDOW w AS (PARTITION BY lvl, source, pos // 3 ORDER BY pos)),
topkin AS (
  SELECT lvl, pos, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM top WHERE n > 1 WINDOW w AS (PARTITION BY lvl, pos // 3 ORDER BY pos)),
walk AS (
  SELECT source, pos AS k, 0 AS lvl, pos, CASE WHEN tampered THEN broken ELSE leaf END AS digest, '' AS proof FROM leaf
  UNION ALL
  SELECT w.source, w.k, w.lvl + 1, w.pos // 3, sha256(l || w.digest || r), w.proof || l || r
  FROM walk w JOIN kin ON kin.lvl = w.lvl AND kin.pos = w.pos AND kin.source IS NOT DISTINCT FROM w.source),
done AS (SELECT source, k, arg_max(digest, lvl) AS digest, arg_max(proof, lvl) AS proof FROM walk GROUP BY source, k),
climb AS (
  SELECT done.source, k, 0 AS lvl, sub.pos, done.digest, proof FROM done JOIN sub ON sub.source IS NOT DISTINCT FROM done.source
  UNION ALL
  SELECT c.source, c.k, c.lvl + 1, c.pos // 3, sha256(l || c.digest || r), c.proof || l || r FROM climb c JOIN topkin t ON t.lvl = c.lvl AND t.pos = c.pos),
fin AS (SELECT source, k, arg_max(digest, lvl) AS digest, arg_max(proof, lvl) AS proof FROM climb GROUP BY source, k)
SELECT doc_id, leaf, sub.digest AS subroot, top.digest AS root, sha256(fin.proof) AS proof_sha256, fin.digest AS folded_root, fin.digest = top.digest AS verified
FROM leaf JOIN sub ON sub.source IS NOT DISTINCT FROM leaf.source
JOIN fin ON fin.source IS NOT DISTINCT FROM leaf.source AND fin.k = leaf.pos, (SELECT digest FROM top WHERE n = 1) top""",
}

"""Operators against brute force on small corpora with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from chatloom.llm import decontaminate as dc
from chatloom.llm import line_dedup, mixing, quality_classifier, quality_rules, secret_scan, simhash, unit_dedup, warc
from chatloom.llm.graph import connected_components

SPACE = "[^\x20\x09-\x0d]+"


def corpus(n=80, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 8)))
    line = lambda: " ".join(word() for _ in range(rng.randint(3, 14)))
    shared = [line() for _ in range(8)]
    texts = []
    for _ in range(n):
        t = [line() if rng.random() < 0.7 else rng.choice(shared) for _ in range(rng.randint(1, 12))]
        if rng.random() < 0.3:
            a = rng.randint(0, 3)
            t[1:1] = shared[a:a + 5]
        texts.append("\n".join(t))
    for _ in range(n // 4):
        texts.append(texts[rng.randrange(n)])
    texts.append(" ".join(word() for _ in range(30_000)))  # very long
    rows = [(i * 7 % 1009, t, f"src{i % 4}" if i % 3 else "src0") for i, t in enumerate(texts)]
    return rows + [(5000, None, None), (5001, "", "src1"), (5002, " \n\t\n ", "src9"), (None, texts[0], None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    # extra columns with names that the operators use themselves
    names = "k1 long, k2 string, row int, size string, target string, turn int, gone int, n int, score string, fp long, rank string, places int, copy string"
    extra = tuple(None for _ in names.split(","))
    return spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, text string, source string, {names}").repartition(5).cache()


def words(text):
    return re.findall(SPACE, text or "")


def test_quality_rules(docs, rows, spark):
    out = {(r.doc_id): r for r in quality_rules.quality_rules(docs).collect()}
    for doc_id, text, _ in rows:
        w, text = words(text), text or ""
        windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        seen = collections.Counter(windows)
        covered = {j for i, x in enumerate(windows) if seen[x] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if re.search(SPACE, x)]
        r = out[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.kept and r.base_failed) and 0 <= r.posterior <= 1
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def test_votes_and_posterior_equal_a_plain_em(docs, rows):
    """Votes by hand from the counts, EM text by text in plain Python."""
    def vote(f, good, bad):
        return 0 if bad(f) else 1 if good(f) else -1

    plain = {
        "word_length": (lambda f: f["w"] and 3 * f["w"] <= f["c"] <= 10 * f["w"], lambda f: f["w"] and (f["c"] < 2 * f["w"] or f["c"] > 15 * f["w"])),
        "symbols": (lambda f: f["w"] and 100 * f["s"] <= f["w"], lambda f: f["w"] and 10 * f["s"] >= f["w"]),
        "duplicate_lines": (lambda f: f["l"] and 20 * f["d"] <= f["l"], lambda f: f["l"] and 10 * f["d"] >= 3 * f["l"]),
        "repeated_words": (lambda f: f["w"] and 10 * f["r"] <= f["w"], lambda f: f["w"] and 10 * f["r"] >= 3 * f["w"]),
        "capitals": (lambda f: f["a"] and 100 * f["u"] <= 15 * f["a"], lambda f: f["a"] and 10 * f["u"] >= 3 * f["a"]),
        "letters": (lambda f: f["c"] and 100 * f["y"] >= 90 * f["c"], lambda f: f["c"] and 100 * f["y"] < 85 * f["c"]),
        "digits": (lambda f: f["c"] and 20 * f["n"] <= f["c"], lambda f: f["c"] and 5 * f["n"] >= f["c"]),
    }
    assert list(plain) == [r.name for r in quality_rules.RULES]
    out = quality_rules.quality_rules(docs).collect()
    texts = {doc_id: text or "" for doc_id, text, _ in rows}
    votes = []
    for r in out:
        t = texts[r.doc_id]
        lines = [x for x in t.split("\n") if words(x)]
        f = {"w": r.n_words, "c": r.word_chars, "s": r.n_symbols, "d": r.n_dup_lines, "r": r.n_repeat_words, "l": len(lines), "u": len(re.findall("[A-Z]", t)),
             "a": len(re.findall("[A-Za-z]", t)), "n": len(re.findall("[0-9]", t)), "y": len(re.findall("[A-Za-z]", t)) + sum(ord(c) > 127 for c in t)}
        votes.append([vote(f, *plain[name]) for name in plain])
        assert votes[-1] == [r[f"vote_{name}"] for name in plain]
    n, rate, g, b = len(plain), 0.9, [0.999] * len(plain), [0.4] * len(plain)
    for _ in range(500):
        chance = []
        for v in votes:
            up, down = rate, 1 - rate
            for k in range(n):
                up *= 1 if v[k] < 0 else g[k] if v[k] else 1 - g[k]
                down *= 1 if v[k] < 0 else 1 - b[k] if v[k] else b[k]
            chance.append(up / (up + down))
        old = (rate, g, b)
        rate = (sum(chance) + 1) / (len(votes) + 2)
        said = [sum(v[k] >= 0 for v in votes) for k in range(n)]
        g = [(sum(c for c, v in zip(chance, votes) if v[k] == 1) + 1 + 0.1 * said[k] * 0.99) / (sum(c for c, v in zip(chance, votes) if v[k] >= 0) + 2 + 0.1 * said[k]) for k in range(n)]
        b = [min(1 - 1e-9, max((sum(1 - c for c, v in zip(chance, votes) if v[k] == 0) + 1) / (sum(1 - c for c, v in zip(chance, votes) if v[k] >= 0) + 2), 1 - g[k] + 1e-6)) for k in range(n)]
        if max([abs(rate - old[0]), *(abs(x - y) for x, y in zip(g + b, old[1] + old[2]))]) < 1e-10:
            break
    for r, v in zip(out, votes):
        up, down = rate, 1 - rate
        for k in range(n):
            up *= 1 if v[k] < 0 else g[k] if v[k] else 1 - g[k]
            down *= 1 if v[k] < 0 else 1 - b[k] if v[k] else b[k]
        assert r.posterior == pytest.approx(up / (up + down), abs=1e-4)
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)


def test_vote_model_finds_the_bad_class():
    rng = np.random.default_rng(1)
    good = rng.random(4000) < 0.85
    rates = [(0.995, 0.6), (0.99, 0.5), (1.0, 0.3)]
    votes = np.array([[int(rng.random() < g) if y else int(rng.random() >= b) for g, b in rates] for y in good])
    votes[rng.random(votes.shape) < 0.1] = -1
    distinct, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality_rules.fit_votes(distinct, counts.astype(float))
    assert abs(model.good_rate - 0.85) < 0.05
    assert all(abs(b - want) < 0.15 for b, (_, want) in zip(model.on_bad, rates))


def chunk_brute(rows, window=2):
    prime, base, out, seen = (1 << 31) - 1, 1_000_003, {}, set()
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        lines = (text or "").split("\n")
        worded = [i for i, x in enumerate(lines) if re.search(SPACE, x)]
        rolls = []
        for j in range(len(worded)):
            rolled = 0
            for i in worded[max(j - window + 1, 0):j + 1]:
                rolled = (rolled * base + int(hashlib.md5(lines[i].encode()).hexdigest()[:8], 16)) % prime
            rolls.append(rolled)
        ends = [worded[j] for j in range(1, len(worded) - 2) if rolls[j] < rolls[j - 1] and rolls[j] < rolls[j + 1]] + [len(lines) - 1]
        kept, first = [], 0
        for end in ends:
            body = lines[first:end + 1]
            multi = sum(bool(re.search(SPACE, x)) for x in body) >= 2
            assert multi or len(worded) < 2
            if not (multi and "\n".join(body) in seen):
                kept += body
            if multi:
                seen.add("\n".join(body))
            first = end + 1
        out[doc_id] = "\n".join(kept)
    return out


def test_line_dedup_removes_later_copies_whole_and_most_of_a_passage(spark):
    rng = random.Random(8)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(2, 9)))
    passage = [line() for _ in range(60)]
    long_ = "\n".join(line() for _ in range(3000))
    odd = "same line\n" * 500 + "\n \nother\n"
    rows = [(1, "\n".join(passage)), (2, "\n".join([line(), line()] + passage + [line()])), (3, "two\nlines"), (4, "two\nlines"), (5, "one line"), (6, "one line"),
            (7, long_), (8, long_), (9, odd), (10, odd), (11, "a\n\n\nb"), (12, "a\n\n\nb")]
    out = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i].text == "" and out[i].n_removed_lines == out[i].n_lines for i in (4, 8, 10, 12))
    assert out[5].n_removed_lines == out[6].n_removed_lines == 0  # a line alone is no chunk of several lines
    assert out[1].n_removed_lines == 0 and 50 <= out[2].n_removed_lines <= 60 and out[7].n_removed_lines == 0


def test_line_dedup(docs, rows, spark):
    want = chunk_brute(rows)
    out = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    assert {k: r.text for k, r in out.items()} == want
    assert sum(r.n_removed_chunks for r in out.values()) > 10
    texts = line_dedup.dedup_texts(docs, length_column="n")
    assert texts.columns == docs.columns
    assert {r.doc_id: r.text or "" for r in texts.collect()} == want
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


def test_quality_classifier(spark):
    rng = random.Random(2)
    syllables = {1: ["ta", "ri", "mo", "len", "su"], 0: ["XQ", "ZZ", "##", "$$", "!!"]}
    texts = [(i, " ".join("".join(rng.choice(syllables[i % 2]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 200))), i % 2) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in texts] + [(9000, None, None), (9001, "", None), (None, "ta ri", None)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in texts] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit_compression(docs, labels)
    out = {r.doc_id: r for r in quality_classifier.score_quality(docs, model).collect()}
    held = [(out[i], y) for i, _, y in texts if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 50 and all(r.held_out for r, _ in held)
    assert sum(r.predicted == y for r, y in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out.values())
    assert out[9000].score == out[9001].score and not out[None].held_out
    # held-out labels change nothing
    flipped = labels.withColumn("quality", F.when(quality_classifier.is_held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality_classifier.fit_compression(docs, flipped) == model
    none = quality_classifier.fit_compression(docs, labels.limit(0))
    assert {r.score for r in quality_classifier.score_quality(docs, none).collect()} == {0.5}
    assert quality_classifier.keep_good(docs, model).columns == docs.columns


def test_warc_round_trip(spark, tmp_path):
    page = b"<html><head><title>A &amp; B</title><style>x{}</style></head><body><p>One&nbsp;two</p><script>no()</script><a href='/l?a=1&amp;b=2'>three</a></body></html>"
    headers = [("Content-Type", "text/html; charset=utf-8"), ("X-A", "1\r\nX-B: 2")]
    data = [("<urn:uuid:1>", "http://a/", "2024-01-01T00:00:00Z", "HTTP/1.1 200 OK", headers, page, warc.digest_of(page), 1),
            (None, None, None, None, None, None, None, 2), ("<urn:uuid:3>", "http://b/", "2024", "HTTP/1.1 200 OK", [("Content-Type", "text/plain; charset=latin-1")], "é".encode("latin-1"), "sha1:00", 3)]
    schema = "record_id string, target_uri string, date string, http_status string, http_headers array<struct<name:string,value:string>>, payload binary, payload_digest string, block int"
    out = warc.warc_derivatives(spark.createDataFrame(data, schema))
    by = {(r.refers_to, r.warc_type): r for r in out.collect()}
    assert len(by) == 6
    meta, text = by["<urn:uuid:1>", "metadata"], by["<urn:uuid:1>", "conversion"]
    assert text.block == "One two\nthree" and text.content_length == len(text.block)
    assert "source-payload-digest-verified: true" in meta.block and "title: A & B" in meta.block and "outlink: /l?a=1&b=2" in meta.block
    assert "source-header: X-A: 1 X-B: 2\r\n" in meta.block and f"conversion-record: {text.record_id}" in meta.block
    assert "WARC-Refers-To: <urn:uuid:1>" in text.header and f"WARC-Concurrent-To: {text.record_id}" in meta.header
    assert by["<urn:uuid:3>", "conversion"].block == "é" and "verified: false" in by["<urn:uuid:3>", "metadata"].block
    assert by["", "conversion"].block == ""
    warc.write_warc(out, str(tmp_path / "w"), "none")
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    records, at = [], 0
    while at < len(raw):  # exact round trip by Content-Length
        end = raw.index(b"\r\n\r\n", at) + 4
        n = int(re.search(rb"Content-Length: (\d+)", raw[at:end])[1])
        records.append(raw[end:end + n].decode())
        assert raw[end + n:end + n + 4] == b"\r\n\r\n"
        at = end + n + 4
    assert sorted(records) == sorted(r.block for r in by.values())


def test_simhash_fingerprints_and_components(docs, rows):
    def brute(text):
        w = re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0

    prints = {doc_id: brute(text) for doc_id, text, _ in rows}
    out = {r.doc_id: r for r in simhash.simhash_components(docs).collect()}
    assert {k: int(r.fingerprint, 16) for k, r in out.items()} == prints
    order = sorted(prints, key=lambda x: (x is None, x or 0))
    component = {x: x for x in order}
    changed = True
    while changed:
        changed = False
        for a in order:
            for b in order:
                if bin(prints[a] ^ prints[b]).count("1") <= 2:
                    least = min(component[a], component[b], key=lambda x: (x is None, x or 0))
                    if component[a] != least or component[b] != least:
                        component[a] = component[b] = least
                        changed = True
    assert {k: r.component_id for k, r in out.items()} == component
    kept = simhash.keep_one_per_component(docs)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(set(component.values()), key=str) and kept.columns == docs.columns
    assert simhash.simhash_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("max_bits, segments, bucket_limit", [(2, 5, 128), (2, 5, 2), (2, 3, 1), (1, 4, 2), (1, 4, 128), (0, 2, 1)])
def test_similar_fingerprints_connect_as_all_pairs_do(spark, max_bits, segments, bucket_limit):
    rng = random.Random(max_bits * 10 + segments)
    prints = set()
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 10)):
            prints.add(x)
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(prints)]
    links = simhash.similar_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp long"), max_bits, segments, bucket_limit)
    got = connected_components(links, "a", "b")
    near = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= max_bits}
    assert all((r.a, r.b) in near for r in links.collect())
    if bucket_limit == 128:
        assert sorted((r.a, r.b) for r in links.collect()) == sorted(near)
    root = {x: x for x in signed}
    for _ in signed:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.node: r.root for r in got.collect()} == {x: root[x] for pair in near for x in pair}


@pytest.mark.parametrize("set_limit", [50_000, 3])
def test_contamination(spark, docs, rows, set_limit):
    long_text = rows[0][1].upper()
    bench = [(1, " ".join(words(rows[2][1])[:20])), (2, long_text), (3, "aa bb"), (4, None), (5, ""), (None, "?!"), (6, "zzz " * 20)]
    more = spark.createDataFrame([(7000, "x AA-bb, y"), (7001, "zzz " * 40 + "end")], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    items = spark.createDataFrame(bench, "item_id long, text string")
    lower = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for item, text in bench:
        w = lower(text)
        for i in range(max(len(w) - 12, min(len(w), 1))):
            windows[tuple(w[i:i + 13])].add(str(item))
    out = {r.doc_id: r for r in dc.contamination(more, items, set_limit=set_limit).collect()}
    assert len(out) == len(rows) + 2
    for r in more.collect():
        w, hit, found = lower(r.text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        got = out[r.doc_id]
        assert (got.n_words, got.n_hit, got.n_items, got.contaminated) == (len(w), len(hit), len(found), bool(hit) and 20 * len(hit) >= len(w))
        assert got.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    kept = dc.decontaminate(docs, items, set_limit=set_limit)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows if not out[r[0]].contaminated}
    spans = {r.doc_id: r.text for r in dc.decontaminate(more, items, "spans", set_limit=set_limit).collect()}
    assert spans[7000] == "x y" and spans[7001] == "end" and spans[5000] is None
    assert dc.contamination(more.limit(0), items).count() == 0
    assert not any(r.contaminated for r in dc.contamination(more, items.limit(0)).collect())


def test_secret_scan_learns_its_findings(spark):
    rng = random.Random(4)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    data, findings = [], []
    for i in range(300):
        a, b = key(), "".join(rng.choice("0123456789") for _ in range(16))
        data.append((i, f'some words here token = "{a}" more prose and card {b} end', f"src{i % 3}"))
        if i < 200:
            findings += [(i, a, 1), (i, b, 0)]
    data += [(900, None, None), (901, "", "x"), (902, "no candidates", None), (902, "no candidates", None)]
    docs = spark.createDataFrame([(*d, None, None) for d in data], "doc_id long, text string, source string, value string, label int")
    out = secret_scan.secret_scan(docs, spark.createDataFrame([*findings, (1, None, None)], "doc_id long, value string, label int")).collect()
    held = [r for r in out if r.doc_id >= 200]
    assert len(out) == 600 and all(r.secret == (len(r.value) == 40) for r in held)
    f = secret_scan.candidate_features(secret_scan.find_candidates(docs), docs).where("doc_id = 0 and no = 0").first()
    assert f.n_chars == 40 and f.is_hex == 1.0 and f.near_word == 1.0 and f.assigned == 1.0 and f.after == "more"
    unlearned = secret_scan.secret_scan(docs, spark.createDataFrame([], "doc_id long, value string, label int")).collect()
    assert {(r.probability, r.secret) for r in unlearned} == {(1.0, True)} and secret_scan.secret_scan(docs.limit(0), docs.select("doc_id", "value", "label")).count() == 0


def test_secret_candidates_equal_brute_force(spark):
    """Every value position and long run, found anew with Python's regex on whole texts."""
    rng = random.Random(12)
    parts = ['password="hunter"', "pwd=ab", "key: 'x'", 'api = "short"', "plain = word", "token:notquoted", "AllLettersLongerThanSixteen", "a=b=c", "x1234567890123456789==", "word", "is", ":", "=",
             "'quoted'", 'name="two words"', "url?a=1&b=2", "é=ü", "user@host.example.com", '""', "k='", "12.34.56.78"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(150)] + [None, "", " = ", 'secret =\n"abcdefgh"', "x" * 30_000 + " k=v"]
    got = collections.defaultdict(list)
    docs = spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(3)
    for r in secret_scan.find_candidates(docs).collect():
        got[r.doc_id].append((r.no, r.value))
    for i, text in enumerate(texts):
        want, ws = [], re.split(r"[\s]+", text or "")
        for k, word in enumerate(ws):
            prior = ws[k - 1] if k else ""
            found = [m.group(0) for m in re.finditer(r"[A-Za-z0-9_+/.@-]{16,}={0,2}", word)]
            found += [m.group(1) for m in re.finditer(r"""(?:=["']?|:["'])([^"'=\s]+)""", word)]
            found += re.findall(r"""^["']([^"'\s]+)""", word) if prior[-1:] in ("=", ":") and prior else []
            found += re.findall(r"""^([^"'=\s]+)""", word) if prior.endswith("=") else []
            want += list(dict.fromkeys(found))
        assert [v for _, v in sorted(got[i])] == want
    assert sum(map(len, got.values())) > 300


def test_no_labelled_finding_is_left_out(spark, sf_mid):
    from chatloom.llm.queries import findings_of

    docs, labels = (spark.read.parquet(f"{sf_mid}/{t}.parquet") for t in ("documents", "labels"))
    findings = findings_of(docs, labels)
    assert secret_scan.uncovered(findings, secret_scan.find_candidates(docs)).count() == 0 and findings.filter("label = 1").count() > 5
    short = spark.createDataFrame([(1, 'the password = "hunter" and passphrase="correcthorse" end', "s"), (2, "short AKIA key", "s")], "doc_id long, text string, source string")
    marks = spark.createDataFrame([(1, "hunter", 1), (1, "correcthorse", 1), (2, "AKIA", 1)], "doc_id long, value string, label int")
    assert [r.value for r in secret_scan.uncovered(marks, secret_scan.find_candidates(short)).collect()] == ["AKIA"]


def test_mixing(docs, rows):
    plan = mixing.mix_plan(docs)
    out = {r.doc_id: r for r in plan.collect()}
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len(words(text))
    order = sorted((s for s in sizes if s), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    stopped = set()
    while True:  # share, stop, share the rest
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in stopped)
        left = sum(weight[s] for s in order if s not in stopped)
        share = {s: 3 * sizes[s] if s in stopped else rest * weight[s] / left for s in order}
        over = {s for s in order if share[s] > 3 * sizes[s]}
        if not over:
            break
        stopped |= over
    for doc_id, text, source in rows:
        r = out[doc_id]
        assert (r.size, r.source_size) == (len(words(text)), sizes[source]) and r.target == pytest.approx(share[source])
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    assert {r.doc_id: r.taken for r in mixing.mix_plan(docs.repartition(3)).collect()} == {k: r.taken for k, r in out.items()}
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "copy_"]  # a column of that name is there already
    assert sum(len(words(r.text)) for r in mixed.select("text").collect()) == sum(r.taken for r in out.values())
    assert mixing.mix_plan(docs.limit(0)).count() == 0


def test_mixing_draws_for_every_repeated_row(spark):
    six, two = "a b c d e f", "g h"
    rows = [(None, six, "hot")] * 400 + [(None, two, "hot")] * 300 + [(1, six, None)] * 40 + [(1, six, "")] * 40 + [(i, six, "b") for i in range(100)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, source string, n int").repartition(7)
    plan = mixing.mix_plan(docs, weights=(2, 3, 2, 5)).collect()
    assert len(plan) == len(rows)
    by_source = collections.defaultdict(list)
    for r in plan:
        by_source[r.source_size, r.target].append(r)
    assert len(by_source) >= 3
    for (_, target), own in by_source.items():
        errors = {r.target_error for r in own}
        assert len(errors) <= 2 and all(r.taken <= 3 * r.size for r in own)
    hot = [r for r in plan if r.source_size == 3000]
    taken, error = sum(r.taken for r in hot), hot[0].target_error
    assert error > 0 and abs(taken - hot[0].target) <= 3 * error and 0 < len({r.taken for r in hot if r.size == 6})
    assert len({r.taken for r in hot if r.size == 6}) == 2  # equal rows draw for themselves
    again = mixing.mix_plan(docs.repartition(3), weights=(2, 3, 2, 5)).collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter(map(tuple, plan))
    one, other = ({(r.n, r.copy) for r in mixing.mix(docs.repartition(k), weights=(2, 3, 2, 5)).collect()} for k in (2, 5))
    assert one == other and len(one) == sum(r.taken // r.size for r in plan)
    keys = docs.select(mixing.row_key(F.col("doc_id"), F.col("source"), F.col("text"), "mix").alias("k"), "source").distinct().collect()
    assert len({r.k for r in keys if r.source in (None, "")}) == 2  # null and empty sources are apart


def in_rank(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))


def test_unit_dedup_of_lines_has_no_floor(docs, rows, spark):
    seen = set()
    out = {r.doc_id: r for r in unit_dedup.unit_dedup(docs, unit="line").collect()}
    for doc_id, text, _ in in_rank(rows):
        kept, spans, at = [], [], 0
        for line in (text or "").split("\n"):
            plain = " ".join(words(line)).lower()
            if plain and plain in seen:
                spans.append((at, at + len(line)))
            else:
                kept.append(line)
            seen.add(plain)
            at += len(line) + 1
        assert [(s.begin, s.stop) for s in out[doc_id].removed] == spans
        assert out[doc_id].kept == "\n".join(kept)
    short = spark.createDataFrame([(1, "a\nb c\n"), (2, "B  C\nd\na")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in unit_dedup.unit_dedup(short, unit="line").collect()} == {1: "a\nb c\n", 2: "d"}
    assert unit_dedup.unit_dedup(docs.limit(0), unit="line").count() == 0


def paragraph_brute(rows, min_words):
    """Sentences as word ranges; every paragraph occurrence compared with all earlier ones as text."""
    seen, out = set(), {}
    for doc_id, text, _ in in_rank(rows):
        text = text or ""
        found = [(m.start(), m.end()) for m in re.finditer(SPACE, text)]
        units, own = [], []
        for k, (a, b) in enumerate(found):
            own.append((a, b))
            gap = text[b:found[k + 1][0]] if k + 1 < len(found) else "\n"
            if "\n" in gap or text[b - 1] in ".!?":
                units.append(own)
                own = []
        plain = [" ".join(text[a:b] for a, b in u) for u in units]
        plain = ["".join(c.lower() if c.isascii() else c for c in p) for p in plain]
        runs = []
        for i in range(len(units)):
            for j in range(i + 1, len(units) + 1):
                if sum(map(len, units[i:j])) >= min_words:
                    runs.append((i, j))
                    break
        gone = set()
        for i, j in runs or [(0, len(units))]:
            if units:
                body = " ".join(plain[i:j])
                if body in seen:
                    gone.update(range(i, j))
                seen.add(body)
        kept, at = "", 0
        for k, u in enumerate(units):
            if k in gone:
                kept += text[at:u[0][0]]
                at = units[k + 1][0][0] if k + 1 < len(units) else len(text)
        out[doc_id] = (len(units), [(units[k][0][0], units[k][-1][1]) for k in sorted(gone)], kept + text[at:])
    return out


@pytest.mark.parametrize("min_words", [20, 7, 1])
def test_unit_dedup_of_paragraphs_equals_brute_force(spark, min_words):
    rng = random.Random(min_words)
    sentence = lambda: " ".join("".join(rng.choice("abcdEé") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 14))) + rng.choice([". ", "! ", ".\n", "\n", " \n\n", "?  ", ".) ", "."])
    stock = [sentence() for _ in range(6)]
    passage = "".join(sentence() for _ in range(9))
    texts = []
    for i in range(70):
        t = "".join(sentence() if rng.random() < 0.6 else rng.choice(stock) for _ in range(rng.randint(0, 12)))
        if i % 3 == 0:
            at = rng.randint(0, len(passage) // 2)
            t = t[:len(t) // 2] + " " + passage[at:at + 400].upper() + t[len(t) // 2:]
        texts.append(rng.choice(["", " ", "\n\t"]) + t)
    texts += [texts[5], texts[6], "same. " * 500, "word " * 3000, "x y", "X  y", None, "", " \n "]
    rows = [(3 * i, t, None) for i, t in enumerate(texts)]
    names = "k1 long, k2 string, no int, d1 int, raw string, gone int, rank string, n int, p int"
    extra = tuple(None for _ in names.split(","))
    docs = spark.createDataFrame([(*r[:2], *extra) for r in rows], f"doc_id long, text string, {names}").repartition(4)
    out = {r.doc_id: (r.n_units, [(s.begin, s.stop) for s in r.removed], r.kept) for r in unit_dedup.unit_dedup(docs, min_words=min_words).collect()}
    assert out == paragraph_brute(rows, min_words)
    assert sum(len(o[1]) for o in out.values()) > 50
    assert unit_dedup.unit_dedup(docs.limit(0), min_words=min_words).count() == 0


def test_unit_dedup_finds_a_passage_inside_lines_and_leaves_a_stock_sentence(spark):
    long_ = "We went down to the harbour. The boats were all gone by then. Nobody had seen them leave, or would say so. We waited until the evening tide."
    docs = spark.createDataFrame([(1, "Start here. " + long_), (2, "All rights reserved."), (3, "Own words. All rights reserved.\nMore own words that no one else has written down here. " + long_ + " And an end."),
                                  (4, "Licence text. All rights reserved. A last sentence of its own with many more words than the others have got in this table.")], "doc_id long, text string")
    out = {r.doc_id: r for r in unit_dedup.unit_dedup(docs).collect()}
    assert out[1].n_removed == out[2].n_removed == out[4].n_removed == 0
    assert out[3].kept == "Own words. All rights reserved.\nMore own words that no one else has written down here. And an end."
    two = spark.createDataFrame([(1, "a line that is long enough", 9), (2, "A  line that is long enough", 1)], "doc_id long, text string, order_ int")
    for unit in ("line", "paragraph"):
        assert {r.doc_id: r.n_removed for r in unit_dedup.unit_dedup(two, unit=unit, rank=F.col("order_")).collect()} == {1: 1, 2: 0}
    with pytest.raises(ValueError):
        unit_dedup.unit_dedup(docs, unit="page")


def test_pipeline_stage_by_stage(spark, sf_small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "mix_sources"]
    labels, items = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("labels", "benchmark"))
    triples = lambda df: [(r.doc_id, r.text, r.source) for r in df.collect()]

    good = stages["quality_classifier"](spark, docs, sf_small).cache()
    model = quality_classifier.fit_compression(docs, labels)
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality_classifier.score_quality(docs, model).collect() if r.predicted}
    lined = stages["line_dedup"](spark, good, sf_small).cache()
    assert {r[0]: r[1] for r in triples(lined)} == chunk_brute(triples(good))
    assert all(r.n_chars == len(r.text) for r in lined.collect())
    alone = stages["simhash_near_dedup"](spark, lined, sf_small).cache()
    least = {r.component_id for r in simhash.simhash_components(lined).collect()}
    assert {r.doc_id for r in alone.collect()} == least and alone.count() == len(least)
    clean = stages["benchmark_decontamination"](spark, alone, sf_small).cache()
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in dc.contamination(alone, items).collect() if not r.contaminated}
    assert docs.columns == good.columns == lined.columns == alone.columns == clean.columns
    copies = collections.Counter(r.doc_id for r in stages["mix_sources"](spark, clean, sf_small).collect())
    plan = {r.doc_id: r for r in mixing.mix_plan(clean).collect()}
    assert {k: n * plan[k].size for k, n in copies.items() if plan[k].size} == {k: r.taken for k, r in plan.items() if r.taken}
    whole = collections.Counter(r.doc_id for r in corpus_pipeline.run(spark, sf_small).collect())
    assert whole == copies

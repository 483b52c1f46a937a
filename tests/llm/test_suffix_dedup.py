"""Column-wise substring dedup against brute force over every window."""

import hashlib
import random

import numpy as np
import pytest

from chatloom.llm import suffix_dedup as sd


def brute(rows, length):
    """Expected (doc_id, n_bytes, n_removed, n_spans, sha) per row; rows are (doc_id, text) with distinct ids."""
    first, out = {}, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            w = raw[s:s + length]
            if w in first:
                gone[s:s + length] = True
            else:
                first[w] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc_id, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passages = [prose(60) for _ in range(4)] + ["x" * 400, "ab" * 300]
    rows = []
    for i in range(n):
        text = prose(rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            cut = p[a:a + rng.randint(40, len(p))]
            at = rng.randint(0, len(text))
            text = text[:at] + cut + text[at:]
        if rows and rng.random() < 0.25:  # near copy
            text = rng.choice(rows)[1] or ""
            for _ in range(rng.randint(0, 3)):
                at = rng.randint(0, max(len(text) - 1, 0))
                text = text[:at] + rng.choice("xyz") + text[at + 1:]
        rows.append((i * 3, text))
    rows += [(1000, None), (1001, ""), (1002, "short"), (None, rows[0][1])]
    rng.shuffle(rows)
    return rows


def result(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("group_limit, context_limit", [(1000, 50_000), (3, 50_000), (1, 50_000), (1, 2), (1, 0)])
def test_matches_brute_force(spark, group_limit, context_limit):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = result(sd.substring_dedup(docs, group_limit=group_limit, context_limit=context_limit))
    assert got == sorted(brute(rows, 100), key=str)
    assert any(r[2] for r in got)


def test_other_length_and_pieces(spark, monkeypatch):
    rows = corpus(9, 25)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(sd.substring_dedup(docs, length=50)) == sorted(brute(rows, 50), key=str)
    raw = np.frombuffer("".join(chr(97 + i % 7 * (i % 11) % 26) for i in range(5000)).encode(), np.uint8)
    monkeypatch.setattr(sd, "PIECE", 1000)
    _, _, first, last = sd.anchors(raw, np.array([0, 2000, 2050, 5000]), 100)
    cut = np.concatenate([np.arange(f, t + 1) for f, t in zip(first, last)])
    # every window of every text is filed once, whatever the pieces
    assert cut.tolist() == [*range(0, 1901), *range(2050, 4901)]


def test_kept_bytes_are_the_text_without_the_spans(spark):
    passage = " ".join(f"word{i}" for i in range(40))
    rows = [(1, "Alpha " + passage + " omega"), (2, "Béta " + passage + " end")]
    out = {r.doc_id: r for r in sd.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert bytes(out[1].kept).decode() == rows[0][1] and out[1].n_removed == 0
    raw = rows[1][1].encode()
    (span,) = out[2].spans
    assert bytes(out[2].kept) == raw[:span.begin] + raw[span.stop:]
    assert bytes(out[2].kept).decode() == "Bétend"  # the shared "a ... e" of both sides goes too


def test_repeated_rows_clashing_columns_and_empty_tables(spark):
    text = " ".join(f"tok{i}" for i in range(50))
    docs = spark.createDataFrame(
        [(1, text, 1, "a"), (1, text, 1, "a"), (1, text + " more", 2, "b"), (None, text, None, None)],
        "doc_id long, text string, k1 int, gram string")
    got = result(sd.substring_dedup(docs))
    assert len(got) == 4 and len({r for r in got if r[0] == 1}) == 2  # identical rows have one result
    assert [r[2] for r in got if r[0] is None] == [len(text)]
    assert sd.substring_dedup(docs.limit(0)).collect() == []

"""Cross-tokenizer alignment against a plain Python version with the libraries' own token strings."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from chatloom.llm import alignment


def byte_table():
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {chr(b): b for b in printable}, 0
    for b in range(256):
        if b not in printable:
            table[chr(256 + extra)] = b
            extra += 1
    return table


class Plain:
    def __init__(self):
        self.a = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        self.bytes_of = byte_table()

    def tokens(self, text):
        e = self.a.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(self.bytes_of[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        return a, b

    def groups(self, text):
        if not text:
            return []
        a, b = self.tokens(text)
        raw = b" " + text.encode()
        if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            return []
        groups, own_a, own_b, at_a, at_b = [], [], [], 0, 0
        a, b = collections.deque(a), collections.deque(b)
        while a or b:
            if at_a <= at_b and a:
                i, x = a.popleft()
                own_a.append(i)
                at_a += len(x)
            else:
                i, x = b.popleft()
                own_b.append(i)
                at_b += len(x)
            if at_a == at_b:
                groups.append((own_a, own_b))
                own_a, own_b = [], []
        return groups

    def measures(self, texts):
        grouped = [self.groups(t) for t in texts]
        linked = [collections.Counter((x, y) for a, b in g for x in a for y in b) for g in grouped]
        counts = collections.Counter(p for c in linked for p in c)
        best = collections.defaultdict(int)
        for (x, _), n in counts.items():
            best[x] = max(best[x], n)
        out = []
        for g, c in zip(grouped, linked):
            text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
            out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()),
                        sum(n for p, n in c.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in c.items()),
                        hashlib.sha256(text.encode()).hexdigest() if g else ""))
        return out


def corpus():
    rng = random.Random(4)
    words = "the of réeux achlich ing tion 東京 пример 🙂👩‍👩‍👧 é don't I'll 1234567 x_y <|endoftext|> <s> </s> <0x41> naïve space ﬁ Ⅷ".split(" ")
    texts = [None, "", " ", "\n", "  two  spaces ", "\ttab\r\nline", "▁", "a▁b", "\0nul", "​", "﻿bom", "<|endoftext|>", "</s>"]
    for _ in range(60):
        texts.append(rng.choice([" ", " ", "  ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(1, 40))))
    texts += [texts[20]] * 30 + [texts[21]] * 3  # copies
    texts.append(" ".join(rng.choice(words[:12]) for _ in range(40_000)))  # very long
    texts.append("".join(rng.choice("abc東🙂") for _ in range(3000)))  # no spaces
    return [((i * 7) % 97 if i % 11 else None, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("common_pairs", [200_000, 40, 0])
def test_equals_plain_python(spark, common_pairs, monkeypatch):
    rows = corpus()
    names = "key string, n int, pair long, pairs string, part int, n_a int, best string, count int, weight int"
    extra = tuple(None for _ in names.split(","))
    docs = spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, text string, {names}").repartition(5)
    got = alignment.cross_tokenizer_alignment(docs, common_pairs=common_pairs)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got.columns == columns
    want = [(r[0], *m) for r, m in zip(rows, Plain().measures([t for _, t in rows]))]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(1 for r in want if r[1] == 0) >= 4 and sum(1 for r in want if r[1]) > 60


def test_both_engines_of_the_byte_level_tokenizer_agree():
    path = public_tokenizers.path("byte_bpe_50k.json")
    fast = alignment.ByteLevel(path)
    points = [c for c in range(0x20, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    rng = random.Random(3)
    texts = [t or "" for _, t in corpus()] + [f"a{chr(c)}{chr(c)}b1 {chr(c)}'s" for c in points]
    texts += ["".join(rng.choice("ab 1\n\t'sé東🙂\u00a0\u3000\x1c\x85") for _ in range(40)) for _ in range(3000)]
    assert fast.encode(texts) == alignment.plain_encode(path)([" " + t for t in texts])


def test_empty_table(spark):
    assert alignment.cross_tokenizer_alignment(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_slices_and_huge_groups_give_the_same_pairs(monkeypatch):
    rng = np.random.default_rng(3)
    sizes = [(1, 1), (40, 50), (3, 2), (1, 1), (70, 1), (2, 2)] * 5
    a, b = (rng.integers(0, 9, sum(s[i] for s in sizes)) for i in (0, 1))
    group_a, group_b = (np.repeat(np.arange(len(sizes)), [s[i] for s in sizes]) for i in (0, 1))
    whole = alignment.linked_pairs(a, group_a, b, group_b)
    brute = collections.Counter(int(x) << 32 | int(y) for g in range(len(sizes)) for x in a[group_a == g] for y in b[group_b == g])
    assert dict(zip(*map(np.ndarray.tolist, whole))) == brute
    for limit in (1, 7, 100, 2000, 2500):
        monkeypatch.setattr(alignment, "SLICE_LINKS", limit)
        assert dict(zip(*map(np.ndarray.tolist, alignment.linked_pairs(a, group_a, b, group_b)))) == brute


def test_texts_with_many_pairs_have_several_rows(monkeypatch):
    texts = ["".join(chr(0x4E00 + 7 * i) for i in range(200)), "short"]
    aligner = alignment.Aligner(alignment.ByteLevel(public_tokenizers.path("byte_bpe_50k.json")), alignment.Pieces(public_tokenizers.path("piece_bpe_32k.model")))
    whole = [x[5].tolist() for x in aligner(texts)]
    monkeypatch.setattr(alignment, "ROW_PAIRS", 50)
    monkeypatch.setattr(alignment, "BATCH_PAIRS", 60)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"key": [b"a", b"b"], "n": [1, 2], "text": texts})
    make = lambda: (aligner.a, aligner.b)
    rows = [r for out in alignment._align(make)([batch]) for r in out.to_pylist()]
    for key, pairs in zip((b"a", b"b"), whole):
        own = sorted((r for r in rows if r["key"] == key), key=lambda r: r["part"])
        assert [p for r in own for p in r["pairs"]] == pairs and [r["part"] for r in own] == list(range(len(own)))
        assert own[0]["n_a"] and all(r["n_a"] is None for r in own[1:])
    assert len(rows) > 4

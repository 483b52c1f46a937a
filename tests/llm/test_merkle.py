"""Merkle manifest against a plain recursive construction."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from chatloom.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def enc(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree_of(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i:i + fanout])) for i in range(0, len(below), fanout)])
    return levels


def path_of(levels, i, fanout):
    path = []
    for level in levels[:-1]:
        a = i // fanout * fanout
        path.append(("".join(level[a:i]), "".join(level[i + 1:a + fanout])))
        i //= fanout
    return path


def brute(rows, fanout=3):
    by = {}
    for row in rows:
        leaf = sha("".join(map(enc, row)))
        by.setdefault(row[1], []).append((row[0] is None, row[0] or 0, leaf, row))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree_of([x[2] for x in sorted(by[s], key=lambda x: x[:3])], fanout) for s in names}
    top = tree_of([trees[s][-1][0] for s in names], fanout)
    out = []
    for k, s in enumerate(names):
        for i, (_, _, leaf, row) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            path = path_of(trees[s], i, fanout) + path_of(top, k, fanout)
            digest = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                digest = sha("".join(map(enc, (*row[:4], row[4].replace("\n", "")))))
            for left, right in path:
                digest = sha(left + digest + right)
            root = top[-1][0]
            out.append((row[0], leaf, trees[s][-1][0], root, sha("".join(a + b for a, b in path)), digest, digest == root))
    return sorted(out, key=repr)


def corpus(n=130, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["hot"] * 5 + ["b", "é", "Z", "", None])
        text = rng.choice([None, "", "\n", "one line", "a\nb é\n\nc", "x" * 50 + "\n" + str(i)])
        rows.append((rng.randrange(-50, 4000), source, rng.choice(["en", None, ""]), rng.choice([None, 0, -7, 12345678901]), text))
    rows += [rows[0], rows[0], rows[1]]  # repeated rows
    rows += [(rows[2][0], rows[2][1], "other", 1, "same id\nand source")] * 2  # ties
    rows += [(None, "hot", "en", 1, "no\nid"), (None, "hot", "en", 1, "no\nid"), (None, None, None, None, None), (77, "lone", "en", 5, "lone\n")]
    rows.append((88, "hot", "en", 1, "long line\n" * 60_000))
    return rows


@pytest.mark.parametrize("fanout, block_levels", [(3, 1), (3, 2), (3, 6), (2, 3)])
def test_audit_equals_brute_force(spark, fanout, block_levels):
    rows = corpus()
    names = "tree string, pos long, n int, digest string, load string, part int, at int, entries string, levels string, proof string, root string, id long"
    extra = tuple(None for _ in names.split(","))
    docs = spark.createDataFrame([(*r, *extra) for r in rows], f"{SCHEMA}, {names}").repartition(6)
    got = merkle.audit(docs, fanout=fanout, block_levels=block_levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, fanout)


def test_single_leaf_is_its_own_root_and_empty_table(spark):
    row = (4, "s", "en", 3, "a\nb")
    one = merkle.audit(spark.createDataFrame([row], SCHEMA)).collect()
    leaf = sha("".join(map(enc, row)))
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root == leaf and one[0].proof_sha256 == sha("")
    assert merkle.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_manifest_proofs_fold_to_the_root_and_name_the_row(spark):
    rows = corpus(60, seed=9)
    docs = spark.createDataFrame(rows, SCHEMA)
    made = merkle.merkle_manifest(docs, FIELDS, carry=F.col("lang"), block_levels=2)
    folded = made.select("*", merkle.fold(F.col("digest"), F.col("proof")).alias("folded")).collect()
    assert len(folded) == len(rows) and all(r.folded == r.root for r in folded)
    assert sorted((r.tree, r.id, r.load) for r in folded if None not in (r.tree, r.id, r.load)) == sorted(
        (r[1], r[0], r[2]) for r in rows if None not in r[:3])
    by_tree = {}
    for r in folded:
        by_tree.setdefault(r.tree, []).append(r.pos)
    assert all(sorted(p) == list(range(len(p))) for p in by_tree.values())
    with pytest.raises(ValueError):
        merkle.merkle_manifest(docs, FIELDS, fanout=1)

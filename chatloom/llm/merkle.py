"""Merkle manifest of a dataset by concatenated-level strings.

The leaves of a tree (one tree per source) are numbered in order and cut into
aligned blocks of ``fanout ** block_levels`` leaves.  A block keeps every level
as one string, the hex digests of the level after one another, so the parents
are the hashes of its fixed-width substrings, and the siblings of a node are
the substrings left and right of it inside its run.  The roots of the blocks
are the nodes of the next round, until one is left in each tree; the roots of
the trees, in order, then climb the same way to the root of the dataset.

No tree is gathered in one task: a block is the largest group (729 digests by
default), and numbering splits a large tree over range partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.llm.common import let, pin

#: Characters of a SHA-256 digest in hex.
WIDTH = 64
FANOUT = 3
BLOCK_LEVELS = 6
#: What a node brings along: a leaf its id and the caller's value, a tree its name.
LOAD = "struct<id:bigint,extra:string>"


def sha_hex(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value (integers in decimal)."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    """Digest of one row: its encoded values after one another."""
    return sha_hex(F.concat(*[encoded(v) for v in values]))


def _levels(digests: Column, n_levels: Column, fanout: int) -> Column:
    """All levels of a block, leaves first, each as one (binary) string of hex digests."""
    run = fanout * WIDTH

    def climb(levels: Column, _: Column) -> Column:
        def parents(level: Column) -> Column:
            runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / run).cast("int"))
            return F.concat(levels, F.array(F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(level, i * run + 1, run), 256)), "").cast("binary")))

        return let(F.element_at(levels, -1), parents)

    start = F.array(F.array_join(digests, "").cast("binary"))
    return F.aggregate(F.slice(F.sequence(F.lit(0), n_levels), 2, n_levels), start, climb)


def _segments(levels: Column, index: Column, fanout: int) -> Column:
    """For the node at ``index`` of the lowest level: (left, right) siblings at every level below the block's root."""
    def flanks(level: Column, height: Column) -> Column:
        node = F.floor(index / F.pow(F.lit(float(fanout)), height)).cast("int")
        first = (node - node % fanout) * WIDTH
        return F.struct(
            F.substring(level, first + 1, (node % fanout) * WIDTH).cast("string").alias("left"),
            F.substring(level, (node + 1) * WIDTH + 1, (fanout - 1 - node % fanout) * WIDTH).cast("string").alias("right"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), flanks)


def proof_digest(proof: Column) -> Column:
    """Digest of the siblings, level by level, left to right."""
    return sha_hex(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]).cast("binary"), 256))


def _numbered(rows: DataFrame, tree: Column, order: Sequence[Column]) -> DataFrame:
    """``rows`` with ``tree`` (as given), ``pos`` (0, 1, .. inside the tree) and ``n`` (nodes of the tree), pinned.

    A range partitioning on (tree, order) spreads a large tree over several
    tasks; the counts of (partition, tree), at most partitions + trees rows,
    give every stretch its offset.
    """
    keyed = rows.select(tree.alias("tree"), F.struct(*order).alias("order"), "*")
    cut = pin(keyed.repartitionByRange(F.col("tree"), F.col("order")).withColumn("part", F.spark_partition_id()))
    counts = cut.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("here"))
    by_tree = Window.partitionBy("tree").orderBy("part")
    starts = pin(counts.select(
        "tree", "part", F.coalesce(F.sum("here").over(by_tree.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
        F.sum("here").over(Window.partitionBy("tree")).alias("n")))
    # a row number per (part, tree): a part is one task's share of the rows, whatever the size of the tree
    local = cut.withColumn("at", F.row_number().over(Window.partitionBy("part", "tree").orderBy("order")) - 1)
    joined = local.alias("a").join(starts.alias("b"), (F.col("a.part") == F.col("b.part")) & F.col("a.tree").eqNullSafe(F.col("b.tree")))
    return joined.select("a.tree", (F.col("start") + F.col("at")).alias("pos"), "n", *[f"a.{c}" for c in rows.columns])


def _blocks(nodes: DataFrame, fanout: int, block_levels: int) -> DataFrame:
    """``(tree, block, n, entries, levels)``, pinned, from nodes ``(tree, pos, n, digest, load)``."""
    size = fanout ** block_levels
    n_levels = F.when(F.col("n") > size, F.lit(block_levels)).otherwise(
        F.size(F.filter(F.array(*[F.lit(fanout ** i) for i in range(block_levels + 1)]), lambda whole: whole < F.col("n"))))
    grouped = nodes.groupBy("tree", F.floor(F.col("pos") / size).alias("block")).agg(
        F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "digest", "load"))).alias("entries"))
    return pin(grouped.select("tree", "block", "n", "entries", _levels(F.col("entries.digest"), n_levels.cast("int"), fanout).alias("levels")))


def _climb(nodes: DataFrame, fanout: int, block_levels: int) -> list[DataFrame]:
    """The block tables of all rounds, lowest first; every tree of the last has one block.  One number a round reaches the driver."""
    rounds = [_blocks(nodes, fanout, block_levels)]
    while rounds[-1].agg(F.max("block")).first()[0]:
        below = rounds[-1]
        roots = below.select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / fanout ** block_levels).cast("long").alias("n"),
                             F.element_at("levels", -1).cast("string").alias("digest"), F.lit(None).cast(LOAD).alias("load"))
        rounds.append(_blocks(roots, fanout, block_levels))
    return rounds


def _descend(rounds: list[DataFrame], above: DataFrame, fanout: int) -> DataFrame:
    """``(tree, pos, digest, load, proof, subroot, root)`` of the lowest nodes.

    ``above``: ``(tree, proof, root)`` of every tree's root.  Proofs go down
    from block to block, so a level's join moves one path per block, not per node.
    """
    path = above.withColumn("pos", F.lit(0).cast("long")).withColumn("subroot", F.lit(None).cast("string"))
    for depth, blocks in reversed(list(enumerate(rounds))):
        top = depth == len(rounds) - 1
        joined = blocks.alias("b").join(path.alias("p"), (F.col("b.block") == F.col("p.pos")) & F.col("b.tree").eqNullSafe(F.col("p.tree")))
        whole = F.element_at("b.levels", -1).cast("string") if top else F.col("p.subroot")
        nodes = joined.select(
            "b.tree", "b.levels", F.col("p.proof").alias("upper"), whole.alias("subroot"), "p.root",
            F.posexplode("b.entries").alias("index", "entry"))
        path = nodes.select(
            "tree", F.col("entry.pos").alias("pos"), F.col("entry.digest").alias("digest"), F.col("entry.load").alias("load"),
            F.concat(_segments(F.col("levels"), F.col("index"), fanout), F.col("upper")).alias("proof"), "subroot", "root")
        if depth:
            path = pin(path.drop("digest", "load"))
    return path


def merkle_manifest(docs: DataFrame, fields: Sequence[str], id_column: str = "doc_id", tree_column: str = "source",
                    carry: Column | None = None, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """Per row: ``tree``, ``pos``, ``digest`` (leaf), ``load`` (``carry`` as text), ``id``, ``proof``, ``subroot``, ``root``.

    ``proof`` lists the (left, right) siblings of every level, leaf to root.
    A tree holds the rows of one value of ``tree_column`` in ascending order of
    the id; a null id comes last, rows that share an id are ordered by their
    digest, and equal rows stand beside one another.  Trees are ordered by
    their UTF-8 bytes, null first.  A run of fewer than ``fanout`` nodes, even
    of one, is hashed like any other; a tree of one leaf is that leaf.  An
    empty table gives an empty result.  Only the named columns are read.
    """
    if fanout < 2 or block_levels < 1:
        raise ValueError("fanout must be 2 or more and block_levels 1 or more")
    load = F.lit(None).cast("string") if carry is None else carry.cast("string")
    leaves = docs.select(
        F.col(f"`{tree_column}`").cast("string").alias("t"), F.col(f"`{id_column}`").cast("long").alias("id"),
        leaf_digest([F.col(f"`{f}`") for f in fields]).alias("digest"), load.alias("extra"))
    placed = _numbered(leaves, F.col("t"), [F.col("id").isNull().alias("absent"), F.col("id").alias("id"), F.col("digest").alias("digest")])
    loaded = F.struct(F.col("id").alias("id"), F.col("extra").alias("extra"))
    rounds = _climb(placed.select("tree", "pos", "n", "digest", loaded.cast(LOAD).alias("load")), fanout, block_levels)
    subroots = rounds[-1].select("tree", F.element_at("levels", -1).cast("string").alias("digest"))
    # the order of Spark strings is the order of their UTF-8 bytes, nulls first
    trees = _numbered(subroots.select(F.col("tree").alias("name"), "digest"), F.lit(0), [F.col("name")])
    upper = _climb(trees.select("tree", "pos", "n", "digest", F.struct(F.lit(None).alias("id"), F.col("name").alias("extra")).cast(LOAD).alias("load")), fanout, block_levels)
    root = upper[-1].select("tree", F.array().cast("array<struct<left:string,right:string>>").alias("proof"), F.element_at("levels", -1).cast("string").alias("root"))
    above = _descend(upper, root, fanout).select(F.col("load.extra").alias("tree"), "proof", "root")
    found = _descend(rounds, pin(above), fanout)
    return found.select("tree", "pos", "digest", F.col("load.id").alias("id"), F.col("load.extra").alias("load"), "proof", "subroot", "root")


def tampers(id_column: Column) -> Column:
    """Whether 2 divides the CRC-32 of the decimal id (a null id has none)."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 2 == 0, F.lit(False))


def audit(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), text_column: str = "text",
          id_column: str = "doc_id", tree_column: str = "source", fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """The manifest checked against a tampered copy, in which the texts of some ids have lost their line breaks.

    Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root (from the
    tampered leaf where the row was tampered with, and the original siblings),
    verified (folded_root equals root).  A null id or text is never tampered with.
    """
    text = F.col(f"`{text_column}`")
    broken = leaf_digest([F.translate(text.cast("string"), "\n", "") if f == text_column else F.col(f"`{f}`") for f in fields])
    changed = F.when(tampers(F.col(f"`{id_column}`")) & text.contains("\n"), broken)
    rows = merkle_manifest(docs, fields, id_column, tree_column, changed, fanout, block_levels)
    return rows.select(
        F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"),
        fold(F.coalesce("load", "digest"), F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))

"""Merkle manifest of a table: a three-way hash tree for each source, a tree over the sources, and a proof for every row.

H is the lowercase hex SHA-256 of its inputs' concatenation, digests going in as hex text. A row's leaf is H of its fields, each
``-`` if null, else UTF-8 byte count, ``:`` and value. Within a source, leaves ascend by id (null first; rows with one id by leaf);
while several nodes remain, every three neighbours become their H, the last run having fewer, even one. What remains is the
source's subroot; subroots, by source (null first, bytewise), give the root in the same way.

Only every sixth level (``step``) is stored. A stored level is a table of aligned subtrees: one row holds 3 ** 6 nodes (or fewer)
below one node of the next stored level. Building a level reads such rows and writes only the node above. Proofs go down from the
root: each subtree's missing interior nodes are made again from its stored descendants, every node's siblings are put before the
path of the node above, and the interior nodes are forgotten. A task holds one subtree at a time.

Places of rows come from a range partitioning by source and id: a place is a row's distance from the first row of its source in
its partition, and the source's rows in earlier partitions. So a source that holds most rows is split like any other, and no
group larger than a subtree is ever gathered.

Null fields are leaves like any other, repeated rows are leaves of their own, a source of one row is its own subroot, and an empty
table gives an empty result. Columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorframe.session import materialize

STEP = 6  # levels between stored ones
WIDTH = 3  # children of a node


def field(value: Column) -> Column:
    """A field as it enters a leaf."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: Sequence[Column]) -> Column:
    """The digest (32 bytes) of a row's fields."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256))


def _above(nodes: list[bytes]) -> list[bytes]:
    """The next level of some digests."""
    texts = [n.hex() for n in nodes]
    return [sha256("".join(texts[i:i + WIDTH]).encode()).digest() for i in range(0, len(texts), WIDTH)]


def climb(nodes: list[bytes], alone: bool, step: int = STEP) -> list[list[bytes]]:
    """All levels of a subtree, the given nodes first: up to its one node if it is the whole tree, else ``step`` levels up."""
    levels = [nodes]
    while len(levels[-1]) > 1 if alone else len(levels) <= step:
        levels.append(_above(levels[-1]))
    return levels


# A path lists, level by level from below, how many siblings stand on the left and on the right, and their digests.
def siblings(level: list[bytes], i: int) -> bytes:
    """The part of a path at one level."""
    first = i - i % WIDTH
    left, right = level[first:i], level[i + 1:first + WIDTH]
    return b"".join([bytes([len(left), len(right)]), *left, *right])


def parts_of(path: bytes) -> list[tuple[list[bytes], list[bytes]]]:
    """(left, right) digests of each level of a path."""
    out, at = [], 0
    while at < len(path):
        n, m = path[at], path[at + 1]
        found = [path[at + 2 + 32 * k:at + 34 + 32 * k] for k in range(n + m)]
        out.append((found[:n], found[n:]))
        at += 2 + 32 * (n + m)
    return out


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its path give."""
    node = leaf
    for left, right in parts_of(path):
        node = sha256("".join([x.hex() for x in (*left, node, *right)]).encode()).digest()
    return node


def paths(nodes: list[bytes], alone: bool, above: bytes, step: int = STEP) -> list[bytes]:
    """The path of each node of a stored subtree, given the path of the node above it. Interior nodes are made for this and dropped."""
    levels = climb(nodes, alone, step)
    found = [above]
    for level in levels[-2::-1]:
        found = [siblings(level, i) + found[i // WIDTH] for i in range(len(level))]
    return found


def _tops(step: int):
    """The node above each stored subtree."""
    def run(batches):
        for got in batches:
            nodes = [climb(n, alone, step)[-1][0] for n, alone in zip(got.column(3).to_pylist(), got.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*got.columns[:3], pa.array(nodes, pa.binary())], names=["grp", "idx", "size", "node"])

    return run


def _paths(step: int):
    """Rows (grp, block, nodes, alone, path above): the path of each node by its place."""
    def run(batches):
        for got in batches:
            for grp, block, nodes, alone, above in zip(*(c.to_pylist() for c in got.columns)):
                found, first = paths(nodes, alone, above, step), block * WIDTH ** step
                yield pa.RecordBatch.from_arrays([pa.array([grp] * len(found), pa.int64()), pa.array(range(first, first + len(found)), pa.int64()), pa.array(found, pa.binary())],
                                                 names=["grp", "idx", "path"])

    return run


def _placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows with ``idx``, their place (from 0) within ``grp`` in the given order, and ``size``, the group's rows."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "grp", *order).sortWithinPartitions("grp", *order)
    ranged = materialize(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.expr("shiftright(at, 33)")))
    # One row for each group, and one more for each partition at most, where a group goes on.
    starts = materialize(ranged.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows")))
    base = materialize(starts.selectExpr("grp AS g", "part AS p", "sum(rows) OVER (PARTITION BY grp ORDER BY part) - rows - first AS base", "sum(rows) OVER (PARTITION BY grp) AS size"))
    found = ranged.join(base, ranged["grp"].eqNullSafe(base["g"]) & (ranged["part"] == base["p"]))
    return found.withColumn("idx", F.col("at") + F.col("base")).drop("g", "p", "base", "at", "part")


def _subtrees(rows: DataFrame, step: int, extra: Sequence[str] = ()) -> DataFrame:
    """Placed nodes (grp, idx, size, node, extra) as stored subtrees (grp, block, size, nodes, alone, extra as arrays)."""
    held = F.sort_array(F.collect_list(F.struct("idx", "node", *extra))).alias("rows")
    blocks = rows.groupBy("grp", F.expr(f"idx div {WIDTH ** step}").alias("block"), "size").agg(held)
    arrays = [F.col(f"rows.{c}").alias(name) for c, name in (("node", "nodes"), *((c, c) for c in extra))]
    return materialize(blocks.select("grp", "block", F.expr(f"(size + {WIDTH ** step - 1}) div {WIDTH ** step}").alias("size"), *arrays, F.expr(f"size <= {WIDTH ** step}").alias("alone")))


def _levels(first: DataFrame, step: int) -> tuple[list[DataFrame], DataFrame]:
    """All stored levels above the first, the first among them, and the top node of each group (grp, node)."""
    levels, tops = [first], None
    while True:
        above = materialize(levels[-1].select("grp", "block", "size", "nodes", "alone").mapInArrow(_tops(step), "grp long, idx long, size long, node binary"))
        ended = above.where("size = 1").select("grp", "node")
        tops = ended if tops is None else tops.unionByName(ended)
        going = above.where("size > 1")
        if going.isEmpty():
            return levels, materialize(tops)
        levels.append(_subtrees(going, step))


def _descend(levels: list[DataFrame], above: DataFrame, step: int) -> DataFrame:
    """The first level's subtrees, each with the path of the node above it; ``above``: grp and the path of its top node."""
    known = None
    for level in levels[::-1]:
        ended = level.where("alone").join(above, "grp").withColumnRenamed("path", "above")
        if known is not None:
            up = known.select("grp", F.col("idx").alias("block"), F.col("path").alias("above"))
            ended = ended.unionByName(level.where("NOT alone").join(up, ["grp", "block"]))
        if level is levels[0]:
            return ended
        known = materialize(ended.select("grp", "block", "nodes", "alone", "above").mapInArrow(_paths(step), "grp long, idx long, path binary"))
    raise AssertionError("a tree has a level")


def _proofs(root: bytes | None, step: int):
    """Of each subtree of leaves one row for each leaf: id, digests, proof and the root folded from the tampered leaf."""
    names = ["row_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def run(batches):
        for got in batches:
            for ids, nodes, tampered, alone, above, subroot in zip(*(c.to_pylist() for c in got.columns)):
                rows = []
                for n, (leaf, path) in enumerate(zip(nodes, paths(nodes, alone, above, step))):
                    proof = sha256("".join([x.hex() for left, right in parts_of(path) for x in (*left, *right)]).encode()).hexdigest()
                    folded = fold(tampered[n] or leaf, path)
                    rows.append((ids[n], leaf.hex(), subroot.hex(), root.hex(), proof, folded.hex(), folded == root))
                kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def manifest(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", source_col: str = "source",
             tampered: tuple[Column, dict[str, Column]] | None = None, step: int = STEP) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    ``tampered`` (condition, column -> changed value) makes the leaf that is folded with the original siblings where the condition
    holds; a row is verified if that gives the root. proof_sha256 is H of a row's siblings, level by level from the leaf to the root.
    """
    condition, changed = tampered or (F.lit(False), {})
    leaves = docs.select(F.col(source_col).cast("string").alias("grp"), F.col(id_col).cast("long").alias("row_id"), leaf_of([F.col(c) for c in fields]).alias("node"),
                         F.when(condition, leaf_of([changed.get(c, F.col(c)) for c in fields])).alias("tampered"))
    placed = _placed(leaves, ["row_id", "node"])
    # Sources are numbered in their order, so that all later joins are on numbers; null has its own.
    named = materialize(_placed(placed.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("name")).distinct(), ["name"]).select("name", F.col("idx").alias("number")))
    numbered = placed.join(named, placed["grp"].eqNullSafe(named["name"])).select(F.col("number").alias("grp"), "idx", "size", "row_id", "node", "tampered")
    levels, subroots = _levels(_subtrees(numbered, step, ["row_id", "tampered"]), step)
    sources = subroots.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("idx"), F.lit(named.count()).cast("long").alias("size"), "node")
    sources, tops = _levels(_subtrees(sources, step), step)
    top = tops.first()  # one row, of the tree over the sources
    known = _descend(sources, tops.select("grp", F.lit(b"").alias("path")), step).select("grp", "block", "nodes", "alone", "above")
    known = materialize(known.mapInArrow(_paths(step), "grp long, idx long, path binary")).select(F.col("idx").alias("grp"), "path")
    blocks = _descend(levels, known, step).join(subroots.withColumnRenamed("node", "subroot"), "grp")
    blocks = blocks.select("row_id", "nodes", "tampered", "alone", "above", "subroot")
    kinds = "row_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return blocks.mapInArrow(_proofs(top["node"] if top else None, step), kinds).withColumnRenamed("row_id", id_col)

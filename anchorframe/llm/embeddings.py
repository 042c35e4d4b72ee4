"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Equal vectors of a label form a class. The classes of a label are dealt to tiles of bounded size, and each pair of tiles is
one small group, so no group grows with the data and a hot label is only more groups. In a pair of tiles, unit vectors u are
quantised to whole numbers q of 8 bits with one scale s each, and r = |u - s q| is kept. Then

    |u·v - s_u s_v q_u·q_v| <= r_v |s_u q_u| + r_u |v| <= r_v (1 + r_u) + r_u

holds for every pair, so a pair is dropped only where the quantised product plus this bound is below the threshold; all others
are computed again in double precision. The whole-number products are exact. A tile pair returns, for each class, how many
vectors it is linked with and one link of a local spanning tree, never its list of links.

Vectors that are null, zero or hold null or non-finite components, and rows with a null label, link with nothing and are kept.
Only vectors of equal length are compared. Repeated rows are vectors of their own. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorframe.llm.components import components
from anchorframe.session import materialize

_SLACK = 1e-9  # covers rounding in double precision
_EXACT = 1024  # columns whose products of 8-bit numbers add up exactly in single precision
_BLOCK = 512


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit numbers, scale and length of the rest of each unit vector."""
    scale = np.abs(unit).max(1, keepdims=True) / 127
    numbers = np.rint(unit / scale).astype(np.int8)
    return numbers, scale[:, 0], np.sqrt(((unit - scale * numbers) ** 2).sum(1))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = 0.0
    for at in range(0, a.shape[1], _EXACT):
        total = total + (a[:, at:at + _EXACT].astype(np.float32) @ b[:, at:at + _EXACT].astype(np.float32).T).astype(np.float64)
    return total


def linked_pairs(a: np.ndarray, b: np.ndarray, least: float):
    """Blocks of index pairs (into a and b, unit vectors) whose product in double precision is at least ``least``."""
    (qa, sa, ra), (qb, sb, rb) = quantise(a), quantise(b)
    for at in range(0, len(a), _BLOCK):
        rows = slice(at, at + _BLOCK)
        near = _products(qa[rows], qb) * sa[rows, None] * sb + (rb * (1 + ra[rows, None]) + ra[rows, None])
        x, y = np.nonzero(near >= least - _SLACK)
        for part in range(0, len(x), 1 << 18):
            i, j = x[part:part + (1 << 18)] + at, y[part:part + (1 << 18)]
            sure = np.einsum("ij,ij->i", a[i], b[j]) >= least
            yield i[sure], j[sure]


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each one's component, with the links (a, b) added."""
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _tile_pair(least: float):
    def run(key, got):
        own, other = key[2].as_py(), key[3].as_py()
        tile = got["tile"].to_numpy()
        vectors = got["unit"].combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)
        order = np.argsort(got["rep"].to_numpy(), kind="stable")
        tile, vectors = tile[order], vectors[order]
        reps, sizes = got["rep"].to_numpy()[order], got["size"].to_numpy()[order]
        first, second = np.flatnonzero(tile == own), np.flatnonzero(tile == other)
        links, root = np.zeros(len(reps), np.int64), np.arange(len(reps))
        for i, j in linked_pairs(vectors[first], vectors[second], least):
            i, j = first[i], second[j]
            if own == other:
                i, j = i[i != j], j[i != j]
            np.add.at(links, i, sizes[j])
            if own != other:
                np.add.at(links, j, sizes[i])
            root = _join(root, i, j)
        some = links > 0
        return pa.table({"rep": reps[some], "links": links[some], "tree": reps[root[some]]})

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.98, tile: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row; links join vectors of one label with cosine at least ``least``."""
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), vector.alias("v"))
    fit = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
           & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False)))
    top = F.array_max(F.transform("v", F.abs))  # scaled first, so that no square under- or overflows
    scaled = rows.where("fit").withColumn("v", F.transform("v", lambda x: x / top))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x))
    key = F.concat_ws("-", F.hex(F.xxhash64("label", "v")), F.hex(F.xxhash64("v", F.lit(1), "label")))
    scaled = scaled.select("vec_id", "label", "v", key.alias("key"), F.size("v").alias("width"))
    classes = materialize(scaled.groupBy("key", "label", "width").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.first("v").alias("v"))
                          .withColumn("norm", norm).select("key", "label", "width", "rep", "size", F.transform("v", lambda x: x / F.col("norm")).alias("unit")))
    tiles = classes.groupBy("label", "width").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = (classes.join(tiles, ["label", "width"]).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
             .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .select("label", "width", F.least("tile", "with").alias("i"), F.greatest("tile", "with").alias("j"), "tile", "rep", "size", "unit"))
    found = materialize(dealt.groupBy("label", "width", "i", "j").applyInArrow(_tile_pair(least), "rep long, links long, tree long"))
    trees = components(found.select(F.col("rep").alias("a"), F.col("tree").alias("b")))
    known = (classes.select("key", "rep", "size").join(found.groupBy(F.col("rep").alias("r")).agg(F.sum("links").alias("links")), F.col("rep") == F.col("r"), "left")
             .join(trees, F.col("rep") == F.col("node"), "left")
             .select("key", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    linked = scaled.select("vec_id", "key").join(known, "key").select("vec_id", "n_links", "component_id")
    alone = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

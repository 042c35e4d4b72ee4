"""Joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anchorframe.functions.text import in_list
from anchorframe.operators.ranking import attach, same_keys
from anchorframe.session import SMALL_ROWS, materialize


def keyed_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on named keys where NULL matches NULL; outer joins return one coalesced key column."""
    if how in ("left_semi", "left_anti", "inner", "left"):
        return attach(left, right, keys, how) if how in ("inner", "left") else _filter_join(left, right, keys, how)
    joined = left.join(right.withColumnsRenamed({k: f"__r_{k}" for k in keys}), same_keys(keys), how)
    cols = [F.coalesce(F.col(k), F.col(f"__r_{k}")).alias(k) if k in keys else F.col(k) for k in left.columns]
    return joined.select(*cols, *[F.col(c) for c in right.columns if c not in keys])


def _filter_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys])
    return left.join(r, same_keys(keys), how)


def natural_join(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join on every shared column name; missing keys match missing keys."""
    shared = [c for c in left.columns if c in set(right.columns)]
    if not shared:
        raise ValueError("natural_join needs at least one shared column")
    return keyed_join(left, right, shared, how)


def semi_join(df: DataFrame, keep: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _filter_join(df, keep, keys, "left_semi")


def anti_join(df: DataFrame, exclude: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _filter_join(df, exclude, keys, "left_anti")


def keep_listed(df: DataFrame, col: str, values: Sequence, negate: bool = False) -> DataFrame:
    hit = in_list(col, values)
    return df.filter(~hit if negate else hit)


def anchor_join(observations: DataFrame, anchors: DataFrame, keys: Sequence[str], salt: int = 16) -> DataFrame:
    """Attach the anchor of each entity (one row per key) to its observations.

    Few anchors are broadcast. Many are joined on key and salt, so an entity with a large share of the
    observations is spread over ``salt`` tasks and a later aggregate by the key still combines first.
    """
    side = materialize(anchors)
    if side.count() <= SMALL_ROWS:
        return observations.join(F.broadcast(side), list(keys))
    spread = F.sequence(F.lit(0).cast("bigint"), F.lit(salt - 1).cast("bigint"))
    left = observations.withColumn("__salt", F.pmod(F.xxhash64(*observations.columns), F.lit(salt)))
    return left.join(side.withColumn("__salt", F.explode(spread)), [*keys, "__salt"]).drop("__salt")


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Attach columns of a key table with one row per key; Spark broadcasts it when its size allows."""
    return attach(df, table.select(*keys, *cols), keys, "left")


def lagged_period_join(anchors: DataFrame, facts: DataFrame, id_col: str, anchor_date: str,
                       year_col: str, lag: int = 1) -> DataFrame:
    """Attach each entity's yearly facts from ``year(anchor) - lag``; no such year leaves NULLs."""
    left = anchors.withColumn(year_col, F.year(anchor_date) - F.lit(lag))
    return attach(left, facts, [id_col, year_col], "left")


def pair_semi_join(df: DataFrame, listing: DataFrame, id_col: str, pair_col: str, order_col: str) -> DataFrame:
    """Keep the (id, replicate) pairs of a listing; the last listing of an id wins."""
    last = listing.groupBy(id_col).agg(F.max_by(pair_col, order_col).alias(pair_col))
    return semi_join(df, materialize(last), [id_col, pair_col])


def id_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct ids on each side, shared and unshared ids, matched row count and smallest unshared ids."""
    ca = a.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__na"))
    cb = b.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__nb"))
    both = keyed_join(ca, cb, [key], "full")
    in_a, in_b = F.col("__na").isNotNull(), F.col("__nb").isNotNull()
    return both.agg(
        F.count(F.when(in_a, 1)).alias("n_a"), F.count(F.when(in_b, 1)).alias("n_b"),
        F.count(F.when(in_a & in_b, 1)).alias("n_both"),
        F.count(F.when(in_a & ~in_b, 1)).alias("n_only_a"),
        F.count(F.when(~in_a & in_b, 1)).alias("n_only_b"),
        F.coalesce(F.sum(F.col("__na") * F.col("__nb")), F.lit(0)).alias("matched_rows"),
        F.min(F.when(in_a & ~in_b, F.col(key))).alias("sample_only_a"),
        F.min(F.when(~in_a & in_b, F.col(key))).alias("sample_only_b"))


def unshared_ids(a: DataFrame, b: DataFrame, key: str, n: int) -> DataFrame:
    """Of each side the first ``n`` ids that the other side lacks, with their place: ``side``, ``place``, the id."""
    parts = []
    for side, one, other in (("a", a, b), ("b", b, a)):
        only = one.filter(F.col(key).isNotNull()).select(key).distinct().join(other.select(F.col(key).alias("__o")), F.col(key) == F.col("__o"), "left_anti")
        first = only.orderBy(key).limit(n)  # n rows of each task at most
        parts.append(first.select(F.lit(side).alias("side"), F.row_number().over(Window.orderBy(key)).alias("place"), key))
    return parts[0].unionByName(parts[1])


HELD = 8_192  # rows of the right in one block, unless ``block`` is larger
COPIES = 4  # of a left row, unless blocks would hold more than that
PAIRS, CELLS = 1 << 18, 1 << 13  # pairs of a cell at least, and how many cells all pairs are cut into beyond that
TASK_PAIRS, TASK_CELLS, TASK_COPIES, TASKS = 1 << 23, 64, 1 << 20, 2_048  # what a task takes, and tasks that share more than that


def _dealt(df: DataFrame, blocks: DataFrame, keys: Sequence[str], own: str, other: str, spread: int = 1) -> DataFrame:
    """Rows of heavy keys with one block of their own side, for each block of the other one; ``spread`` tasks make the copies."""
    rows = attach(df.withColumn("__at", F.monotonically_increasing_id()), blocks, keys, "inner")
    rows = rows.withColumn(f"__{own}", F.pmod(F.xxhash64("__at"), F.col(f"__{own}_blocks")))
    rows = rows.repartition(spread, "__at") if spread > 1 else rows
    return rows.withColumn(f"__{other}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"__{other}_blocks") - 1))).drop("__at", "__l_blocks", "__r_blocks")


def _blocks(sizes: DataFrame, keys: Sequence[str], block: int) -> tuple[DataFrame, int, list[int]]:
    """Blocks of each key on both sides; tasks that make the pairs, and tasks that copy the rows of either side."""
    nl, nr = F.col("__nl").cast("double"), F.col("__nr").cast("double")
    pairs = sizes.agg(F.sum(nl * nr)).first()[0] or 0
    held = F.least(nr, F.greatest(F.lit(block), F.least(F.ceil(nr / COPIES), F.lit(HELD))))
    met = F.greatest(F.lit(block), F.ceil(F.lit(max(PAIRS, pairs / CELLS)) / held))
    blocks = sizes.withColumns({"__l_blocks": F.ceil(nl / met).cast("long"), "__r_blocks": F.ceil(nr / held).cast("long")})
    l, r = F.col("__l_blocks").cast("double"), F.col("__r_blocks").cast("double")
    cells, *copies = [n or 0 for n in blocks.agg(F.sum(l * r), F.sum(nl * r), F.sum(nr * l)).first()]
    tasks = max(1, min(TASKS, round(pairs / TASK_PAIRS)), round(cells / TASK_CELLS))
    return blocks.drop("__nl", "__nr"), tasks, [max(1, min(TASKS, round(n / TASK_COPIES))) for n in copies]


def many_to_many_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", block: int = 10_000) -> DataFrame:
    """All pairs of rows with equal keys (NULL matches NULL); ``how`` is ``inner`` or ``left``.

    Keys are counted on both sides first. Those with more than ``block`` rows on a side are heavy: their rows are dealt by place to
    blocks of about ``block`` rows or more, and each block of the left meets each of the right as a cell of its own. The right's rows
    of a cell are arrays in one row (about ``HELD`` rows, or ``block`` if that is more), which each left row of the cell goes through,
    so that left rows are never held. A row is copied for each block of the other side; blocks grow with their key to keep copies few.
    Other keys are joined as they are, if the left has any. The heavy keys are at most rows / ``block`` many.
    """
    if how not in ("inner", "left"):
        raise ValueError("inner or left")
    keys = list(keys)
    counted = lambda df, n: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    big = lambda df, n: counted(df, n).where(F.col(n) > block)
    heavy = materialize(keyed_join(big(left, "__nl"), big(right, "__nr"), keys, "full").select(*keys))
    if heavy.isEmpty():
        return keyed_join(left, right, keys, how)
    sizes = attach(semi_counts(left, heavy, keys, "__nl"), semi_counts(right, heavy, keys, "__nr"), keys)
    sizes = materialize(sizes.withColumn("__key", F.monotonically_increasing_id()))
    blocks, tasks, spread = _blocks(sizes.where("__nr IS NOT NULL"), keys, block)
    cell, values = ["__key", "__l", "__r"], [c for c in right.columns if c not in keys]
    l = _dealt(left, blocks, keys, "l", "r", spread[0]).repartition(tasks, *cell)
    r = _dealt(right, blocks, keys, "r", "l", spread[1]).repartition(tasks, *cell)
    # lists of rows first, as a list of one column would leave out its NULLs; then an array for each column
    packs = r.groupBy(*cell).agg(F.collect_list(F.struct(*values or [F.lit(True).alias("__one")])).alias("__rows"))
    first, *rest = values or ["__one"]
    packs = packs.select(*cell, *[F.col("__rows").getField(c).alias(f"__of_{c}") for c in (first, *rest)])
    met = l.join(packs, cell).select(*left.columns, *[f"__of_{c}" for c in rest], F.posexplode(f"__of_{first}").alias("__at", first))
    parts = [met.select(*left.columns, *[c if c == first else F.get(f"__of_{c}", "__at").alias(c) for c in values])]
    others = anti_join(left, heavy, keys)
    if not others.isEmpty():
        parts.append(keyed_join(others, anti_join(right, heavy, keys), keys, how))
    alone = sizes.where("__nr IS NULL")  # heavy on the left alone
    if how == "left" and not alone.isEmpty():
        parts.append(semi_join(left, alone, keys).select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in values]))
    return reduce(DataFrame.unionByName, parts)


def semi_counts(df: DataFrame, listing: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Rows of each listed key."""
    return semi_join(df, listing, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def fan_out(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows a many-to-many join would give per left row, without making the pairs."""
    ca = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_left"))
    cb = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_right"))
    return attach(ca, cb, keys, "left").withColumn(
        "n_joined", F.col("n_left") * F.greatest(F.coalesce("n_right", F.lit(1)), F.lit(1)))

"""Mixing sources to target weights by hierarchical budgets, with DataFrame operations only.

Weights stand at the nodes of a tree of domains, languages and sources. A node's budget is shared among its children by
weight; a child that cannot use its share, because its documents run out after ``epochs`` passes, gets what it can use, and the
rest goes to its siblings by weight. Only what all siblings together cannot use goes to the parent's siblings: each node's
capacity is known before budgets are handed down, so no budget goes where it is lost.

Each leaf reads its documents in a seeded order, a new one for each epoch, and takes whole epochs while its budget lasts and
then a prefix of the next: documents as long as their tokens, summed, stay within the rest. The end of the prefix is found in
sums over ever finer ranges of the order's hash (4096 each), so that no leaf's documents are gathered or sorted as a whole,
and the selection compares each document's hash with its leaf's bound: texts are not shuffled.

Nulls: a null domain, language or source is the empty name, a null id hashes as the empty text, a null text has the
length 0. Nodes whose weight is null or not positive get nothing. Rows with one id are taken or left together. Ties in the
order of filling go by name. Leaf tables have a row for each source; budgets are whole numbers of tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorframe.session import materialize

LEVELS = ("domain", "language", "source")
_DIGITS = (3, 6)  # hex digits of the ranges


def _order(seed: int, epoch: Column, doc_id: Column) -> Column:
    """A document's place in an epoch."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _fill(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Hand ``budget`` of each parent down to its nodes (weight, capacity): the column becomes the node's own."""
    whole = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    ratio = F.col("capacity") / F.col("weight")
    order = whole.orderBy(ratio, name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    spent = F.coalesce(F.sum("capacity").over(before), F.lit(0))
    full = ratio <= (F.col("budget") - spent) / F.sum("weight").over(after)
    nodes = nodes.withColumn("full", full)
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(whole), F.lit(0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole)
    share = F.floor(F.col("weight") * left / open_weight)
    return nodes.withColumn("own", F.when(F.col("full"), F.col("capacity")).otherwise(share)).drop("budget", "full").withColumnRenamed("own", "budget")


def budgets(leaves: DataFrame, weights: dict[str, Column], budget: int, epochs: int) -> DataFrame:
    """``leaves`` (domain, language, source, tokens) with the tokens each leaf may give, as ``budget``."""
    tree = leaves.withColumn("capacity", F.col("tokens") * epochs)
    for level in LEVELS:
        tree = tree.withColumn(f"w_{level}", weights[level].cast("long"))
    tree = tree.where(" AND ".join(f"w_{level} > 0" for level in LEVELS))
    given = None
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[:depth])
        nodes = tree.groupBy(*path, level).agg(F.sum("capacity").alias("capacity"), F.first(f"w_{level}").alias("weight"))
        nodes = nodes.withColumn("budget", F.lit(budget).cast("long")) if given is None else nodes.join(given, path)
        given = _fill(nodes, path, level).select(*path, level, F.col("budget").cast("long"))
    return leaves.join(given, list(LEVELS))


def bounds(rows: DataFrame, weights: dict[str, Column], share: tuple[int, int], epochs: int, seed: int) -> DataFrame:
    """For each leaf the whole epochs it gives (``full``) and the last place it gives in the next (``last``, or null).

    ``rows``: doc_id, domain, language, source, tokens. The budget is the fraction ``share`` of all tokens.
    """
    keys = list(LEVELS)
    leaves = materialize(rows.groupBy(*keys).agg(F.sum("tokens").alias("tokens")))
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    leaves = budgets(leaves, weights, total * share[0] // share[1], epochs)
    leaves = materialize(leaves.select(*keys, F.floor(F.col("budget") / F.col("tokens")).alias("full"),
                                       (F.col("budget") % F.col("tokens")).alias("rest")))
    placed = rows.join(leaves, keys).withColumn("place", _order(seed, F.col("full"), F.col("doc_id")))
    # The range in which the rest runs out: (spent, part) are what came before it and its prefix.
    cut = leaves.select(*keys, "rest", F.lit("").alias("part"), F.lit(0).cast("long").alias("spent"))
    for digits in _DIGITS:
        inside = placed.select(*keys, "place", "tokens").join(cut, keys).where(F.col("place").startswith(F.col("part")))
        ranges = inside.groupBy(*keys, "rest", "spent", F.substring("place", 1, digits).alias("next")).agg(F.sum("tokens").alias("tokens"))
        ordered = Window.partitionBy(*keys).orderBy("next")
        ranges = ranges.withColumn("upto", F.col("spent") + F.sum("tokens").over(ordered)).where("upto > rest")
        cut = materialize(ranges.groupBy(*keys).agg(F.min_by(F.struct("rest", F.col("next").alias("part"), (F.col("upto") - F.col("tokens")).alias("spent")), "next").alias("r"))
                          .select(*keys, "r.*"))
    inside = placed.select(*keys, "place", "tokens").join(cut, keys).where(F.col("place").startswith(F.col("part")))
    ordered = Window.partitionBy(*keys).orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("upto", F.col("spent") + F.sum("tokens").over(ordered)).where("upto <= rest")
    ends = inside.groupBy(*keys).agg(F.max("place").alias("end"))
    # Without a document inside the last range, everything before the range is given.
    found = leaves.join(cut.select(*keys, "part"), keys, "left").join(ends, keys, "left")
    return materialize(found.select(*keys, "full", F.coalesce("end", "part").alias("last")))


def plain_rows(docs: DataFrame, path: dict[str, Column], tokens: Column, id_col: str = "doc_id") -> DataFrame:
    named = [F.coalesce(path[level].cast("string"), F.lit("")).alias(level) for level in LEVELS]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *named, tokens.cast("long").alias("tokens"))


def select(rows: DataFrame, ends: DataFrame, seed: int) -> DataFrame:
    """The rows that are taken, one for each epoch, with the column ``epoch``."""
    taken = rows.join(ends, list(LEVELS)).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full"))))
    taken = taken.where((F.col("epoch") < F.col("full")) | (_order(seed, F.col("epoch"), F.col("doc_id")) <= F.col("last")))
    return taken.drop("full", "last")


def mix(docs: DataFrame, path: dict[str, Column], weights: dict[str, Column], tokens: Column, share: tuple[int, int], epochs: int = 2,
        seed: int = 7, id_col: str = "doc_id") -> DataFrame:
    """doc_id, domain, language, source, tokens and epoch of every document taken in every epoch."""
    rows = materialize(plain_rows(docs, path, tokens, id_col))
    return select(rows, bounds(rows, weights, share, epochs, seed), seed)


def mixed_documents(docs: DataFrame, path: dict[str, Column], weights: dict[str, Column], tokens: Column, share: tuple[int, int], seed: int = 7,
                    id_col: str = "doc_id") -> DataFrame:
    """The documents, with all their columns, that one epoch takes."""
    rows = materialize(plain_rows(docs, path, tokens, id_col))
    ends = bounds(rows, weights, share, 1, seed)
    ends = ends.select(*[F.col(c).alias(f"_mix_{c}") for c in ends.columns])
    same = [F.coalesce(path[level].cast("string"), F.lit("")) == F.col(f"_mix_{level}") for level in LEVELS]
    kept = docs.join(ends, same).where((F.col("_mix_full") > 0) | (_order(seed, F.lit(0), F.col(id_col).cast("long")) <= F.col("_mix_last")))
    return kept.select(*docs.columns)

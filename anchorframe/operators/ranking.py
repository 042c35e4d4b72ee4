"""Exact ranks, per-group samples and quantiles that never place a whole group in one task.

Samples cut a group into ordered hash buckets, whose totals (a small table) give each bucket its starting rank. Ranks by value come
from one range partitioning of all rows by group, value and tie, which splits a group, and a value, wherever it is too large for a
partition. Quantiles come from repeated histograms of the cells that hold a wanted rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorframe.functions.hashing import key_bucket, order_key
from anchorframe.session import materialize, small_table

HISTOGRAM = 4096  # parts of a cell in one pass of the quantiles


def same_keys(keys: Sequence[str]) -> Column:
    """Join condition on ``key`` and its copy ``__r_key`` where NULL matches NULL."""
    return F.expr(" AND ".join(f"`{k}` <=> `__r_{k}`" for k in keys) or "true")


def attach(df: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join ``side`` (one row per key) onto ``df`` with NULL keys matching each other.

    Without keys ``side`` is the one row of a whole-table aggregate and becomes literal columns.
    """
    if not keys:
        row = side.first()
        value = lambda f: F.lit(row[f.name]).cast(f.dataType)
        return df.select("*", *[value(f).alias(f.name) for f in side.schema])
    copies = {k: f"__r_{k}" for k in keys}
    return df.join(side.withColumnsRenamed(copies), same_keys(keys), how).drop(*copies.values())


def _starts(counts: DataFrame, by: Sequence[str], bucket: str) -> DataFrame:
    """Add ``__before`` (rows in earlier buckets of the group); input is one row per (group, bucket)."""
    w = Window.partitionBy(*by).orderBy(bucket)
    return counts.withColumn("__before", F.sum("__n").over(w) - F.col("__n"))


def _hash_parts(df, by, n, seed, op, ids):
    """Rows tagged with key, bucket and the group's cut bucket and remaining count."""
    keys = list(by)
    n_col = F.col(n) if isinstance(n, str) else F.lit(n)
    rows = df.withColumn("__key", order_key(seed, op, *ids)).withColumn("__bkt", key_bucket(F.col("__key")))
    counts = rows.groupBy(*keys, "__bkt").agg(
        F.count(F.lit(1)).alias("__n"), F.max(n_col.cast("bigint")).alias("__want"))
    starts = _starts(counts, keys, "__bkt")
    want = F.greatest(F.coalesce(F.col("__want"), F.lit(0)), F.lit(0))
    # the cut bucket is the first one that reaches the wanted count
    cuts = starts.groupBy(*keys).agg(
        F.min(F.when(F.col("__before") + F.col("__n") >= want, F.struct("__bkt", "__before"))).alias("__cut"),
        F.max(want).alias("__want"))
    # one row per group, read by the two scans below
    cuts = small_table(cuts.select(*keys, F.col("__cut.__bkt").alias("__cut_bkt"),
                                   (F.col("__want") - F.col("__cut.__before")).alias("__left")))
    return attach(rows, cuts, keys, "inner"), keys


def _edge_rank(rows: DataFrame, keys: list[str], ids: Sequence) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("__key", *ids)
    return rows.filter(F.col("__bkt") == F.col("__cut_bkt")).withColumn("__rn", F.row_number().over(w))


_TMP = ("__key", "__bkt", "__cut_bkt", "__left", "__rn")


def take_per_group(df: DataFrame, by: Sequence[str], n: int | str, seed, op: str,
                   ids: Sequence[str]) -> DataFrame:
    """The ``n`` rows of each group with the smallest hash keys (``n`` may be a per-group column).

    Whole buckets below the cut are kept as they are scanned; only the cut bucket, 1/65536 of the
    group, is shuffled and sorted.
    """
    rows, keys = _hash_parts(df, by, n, seed, op, ids)
    sure = rows.filter(F.col("__cut_bkt").isNull() | (F.col("__bkt") < F.col("__cut_bkt")))
    edge = _edge_rank(rows, keys, ids).filter(F.col("__rn") <= F.col("__left"))
    return sure.drop(*_TMP).unionByName(edge.drop(*_TMP))


def drop_per_group(df: DataFrame, by: Sequence[str], n: int | str, seed, op: str,
                   ids: Sequence[str]) -> DataFrame:
    """Complement of :func:`take_per_group`: everything but the ``n`` smallest hash keys."""
    rows, keys = _hash_parts(df, by, n, seed, op, ids)
    sure = rows.filter(F.col("__bkt") > F.col("__cut_bkt"))
    edge = _edge_rank(rows, keys, ids).filter(F.col("__rn") > F.col("__left"))
    return sure.drop(*_TMP).unionByName(edge.drop(*_TMP))


def hash_rank(df: DataFrame, by: Sequence[str], seed, op: str, ids: Sequence[str],
              out: str = "rank") -> DataFrame:
    """1-based rank of every row in its group by hash key."""
    keys = list(by)
    rows = df.withColumn("__key", order_key(seed, op, *ids)).withColumn("__bkt", key_bucket(F.col("__key")))
    starts = _starts(rows.groupBy(*keys, "__bkt").agg(F.count(F.lit(1)).alias("__n")), keys, "__bkt").drop("__n")
    w = Window.partitionBy(*keys, "__bkt").orderBy("__key", *ids)
    ranked = rows.withColumn("__rn", F.row_number().over(w))
    ranked = attach(ranked, starts, [*keys, "__bkt"], "inner")
    return ranked.withColumn(out, (F.col("__before") + F.col("__rn")).cast("bigint")).drop(*_TMP, "__before")


def value_rank(df: DataFrame, by: Sequence[str], value: str, ids: Sequence[str], out: str = "rank") -> DataFrame:
    """1-based row number of every row in its group by ``value``, ties in hash order of ``ids``.

    All rows are dealt to ranges of (group, value, tie) of about equal size, cut at sampled places, and sorted there; a rank is the place
    in a range, and the group's rows in earlier ranges. The ranges are written, so that counts and ranks see the same ones.
    """
    keys = list(by)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*keys, value, "__key", *ids]
    ranged = df.withColumn("__key", order_key(0, "tie", *ids)).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = materialize(ranged.withColumn("__at", F.monotonically_increasing_id()).withColumn("__bkt", F.expr("shiftright(__at, 33)")).drop("__key"))
    # One row for each group, and one more for each range in which a group goes on.
    counts = materialize(ranged.groupBy(*keys, "__bkt").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n")))
    starts = _starts(counts, keys, "__bkt").select(*keys, "__bkt", (F.col("__before") - F.col("__first") + 1).alias("__base"))
    ranked = attach(ranged, starts, [*keys, "__bkt"], "inner")
    return ranked.withColumn(out, F.col("__at") + F.col("__base")).drop("__at", "__bkt", "__base")


def _slot(parts: int) -> str:
    """SQL: which part of the cell [__lo, __hi] a value ``__v`` is in, of equal parts or (``__bend``) of parts equal in logarithm.

    Both grow with the value, and put the two ends in different parts. In cells of few rows each value is a part.
    """
    log = lambda x: f"(CASE WHEN {x} = 0 THEN 0D ELSE signum({x}) * least(log2(abs({x})) + 1080, 2200D) END)"
    even = "try_divide(__v / 2 - __lo / 2, __hi / 2 - __lo / 2)"
    bent = f"try_divide({log('__v')} - {log('__lo')}, {log('__hi')} - {log('__lo')})"
    share = f"CASE WHEN __bend THEN {bent} ELSE {even} END"
    return f"CASE WHEN __rows <= {parts} OR __v = __lo OR __v = __hi THEN __v ELSE least(greatest(floor(({share}) * {parts}), 0), {parts - 1}) END"


def exact_quantiles(df: DataFrame, by: Sequence[str], cols: Sequence[str], qs: Sequence[float], parts: int = HISTOGRAM) -> DataFrame:
    """Linear-interpolated quantiles, long form: ``by..., variable, q, value``. NULL and NaN are skipped.

    A cell is a range of values with the ranks in it; at first it is a group. Each pass counts the rows of the cells that hold a wanted
    rank by ``parts`` parts, and the part with the rank is the next cell, from its smallest to its largest value. A rank is
    found when these are one. Cells of up to ``parts`` rows are counted by value and so end at once; passes alternate between even and
    logarithmic parts, so a few suffice for any values. Nothing is sorted but a cell's parts.
    """
    keys = [*by, "variable"]
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("__v")) for c in cols])
    long = df.select(*by, F.explode(pairs).alias("__p")).select(*by, "__p.variable", "__p.__v")
    long = long.filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    groups = materialize(long.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")))
    wanted = []
    for q in qs:
        pos = F.lit(float(q)) * (F.col("__rows") - 1)
        wanted.append(F.struct(F.lit(float(q)).alias("q"), F.floor(pos).alias("__l"), F.ceil(pos).alias("__h"), (pos - F.floor(pos)).alias("frac")))
    asked = materialize(groups.select(*keys, F.explode(F.array(*wanted)).alias("__w")).select(*keys, "__w.*"))
    ranks = asked.select(*keys, F.explode(F.array("__l", "__h")).alias("__rank")).distinct()
    cells = attach(ranks, groups.withColumn("__before", F.lit(0).cast("long")), keys, "inner")
    found, bend = cells.where("__lo = __hi"), False
    cells = materialize(cells.where("__lo < __hi"))
    while not cells.isEmpty():
        own = cells.select(*keys, "__lo", "__hi", "__rows", "__before").distinct().withColumn("__bend", (F.lit(bend) | F.isnan(F.col("__hi") / 2 - F.col("__lo") / 2) | (F.col("__hi") / 2 - F.col("__lo") / 2 == float("inf"))))
        inside = attach(long, small_table(own), keys, "inner").where("__v BETWEEN __lo AND __hi")
        counted = inside.groupBy(*keys, "__lo", "__before", F.expr(_slot(parts)).alias("__slot"), F.expr(f"CASE WHEN __rows <= {parts} THEN 0 WHEN __v = __lo THEN -1 WHEN __v = __hi THEN 1 ELSE 0 END").alias("__end")).agg(
            F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__least"), F.max("__v").alias("__most"))
        within = Window.partitionBy(*keys, "__before").orderBy("__least")
        counted = counted.withColumn("__start", F.col("__before") + F.sum("__c").over(within) - F.col("__c"))
        next_cells = attach(cells.select(*keys, "__rank", "__before"), counted.drop("__lo", "__slot", "__end"), [*keys, "__before"], "inner")
        next_cells = next_cells.where("__rank >= __start AND __rank < __start + __c")
        next_cells = materialize(next_cells.select(*keys, "__rank", F.col("__c").alias("__rows"), F.col("__least").alias("__lo"), F.col("__most").alias("__hi"), F.col("__start").alias("__before")))
        found = found.unionByName(next_cells.where("__lo = __hi").select(*found.columns))
        cells, bend = next_cells.where("__lo < __hi"), not bend
    values = materialize(found.select(*keys, "__rank", F.col("__lo").alias("__x")))
    of = lambda name: values.select(*keys, F.col("__rank").alias(name), F.col("__x").alias(name + "x"))
    both = attach(attach(asked, of("__l"), [*keys, "__l"], "inner"), of("__h"), [*keys, "__h"], "inner")
    value = F.when(F.col("__lx") == F.col("__hx"), F.col("__lx")).otherwise(F.col("__lx") * (1 - F.col("frac")) + F.col("__hx") * F.col("frac"))
    return both.select(*keys, "q", value.alias("value"))


def quantiles_wide(df: DataFrame, by: Sequence[str], col: str, named: dict[str, float]) -> DataFrame:
    """One row per group with one column per named quantile."""
    long = exact_quantiles(df, by, [col], list(named.values()))
    aggs = [F.max(F.when(F.col("q") == F.lit(float(q)), F.col("value"))).alias(name) for name, q in named.items()]
    return long.groupBy(*by).agg(*aggs)

"""Distribution summaries: the data behind histograms, density curves and quantile bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorframe.functions.numbers import cut
from anchorframe.operators.joins import anti_join
from anchorframe.operators.ranking import attach, exact_quantiles, quantiles_wide
from anchorframe.operators.tables import complete_scaffold
from anchorframe.session import small_table

DENSITY_CELLS = 4096


def histogram(df: DataFrame, col: str, bins: int, by: Sequence[str] = (), free: bool = False) -> DataFrame:
    """Counts per bin: width (max-min)/(bins-1), the first bin centred on the minimum, right-closed.

    With ``free`` each group has its own range, otherwise all share one.
    """
    rows = df.filter(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double")))
    keys = list(by) if free else []
    span = rows.groupBy(*keys).agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    wide = attach(rows.select(*by, col), small_table(span), keys, "inner")
    width = (F.col("__hi") - F.col("__lo")) / F.lit(float(bins - 1))
    idx = F.when(width == 0, 0).otherwise(F.greatest(F.lit(0), F.ceil((F.col(col) - F.col("__lo")) / width - 0.5)))
    binned = wide.withColumn("bin", idx.cast("int")).withColumn("width", width)
    out = binned.groupBy(*by, "bin", F.col("__lo").alias("lo"), "width").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("center", F.col("lo") + F.col("bin") * F.col("width")).drop("lo")


def bandwidths(df: DataFrame, col: str, by: Sequence[str], adjust: float = 1.0) -> DataFrame:
    """Rule-of-thumb bandwidth 0.9 min(sd, IQR/1.34) n^(-1/5) per group, with the group's range."""
    x = df.filter(F.col(col).isNotNull())
    q = quantiles_wide(x, by, col, {"__q1": 0.25, "__q3": 0.75})
    m = x.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(col).alias("__sd"),
                           F.min(col).alias("lo"), F.max(col).alias("hi"))
    j = attach(m, q, by, "inner")
    iqr = (F.col("__q3") - F.col("__q1")) / 1.34
    # a zero spread falls back to the other measure, then to the size of the values, then to 1
    spread = F.least("__sd", F.when(iqr > 0, iqr))
    spread = F.coalesce(F.when(spread > 0, spread), F.when(F.abs("lo") > 0, F.abs("lo")), F.lit(1.0))
    return j.withColumn("bw", F.lit(0.9 * adjust) * spread * F.pow("n", F.lit(-0.2))).drop("__q1", "__q3", "__sd")


def _curve(df: DataFrame, col: str, groups: Sequence[str], params: DataFrame, keys: Sequence[str], n_grid: int) -> DataFrame:
    """Gaussian kernel sum on a grid over [lo, hi]; ``params`` gives lo, hi and bw per ``keys``.

    Rows are first split linearly onto ``DENSITY_CELLS`` cells, so the kernel work depends on cells
    and grid, not on the number of rows.
    """
    params = small_table(params.select(*keys, "lo", "hi", "bw"))
    x = attach(df.filter(F.col(col).isNotNull()).select(*groups, col), params.drop("bw"), keys, "inner")
    last = DENSITY_CELLS - 1
    pos = F.when(F.col("hi") > F.col("lo"), (F.col(col) - F.col("lo")) / (F.col("hi") - F.col("lo")) * last).otherwise(0.0)
    x = x.select(*groups, pos.alias("__p"))
    left = F.least(F.floor("__p"), F.lit(last - 1)).cast("int")
    parts = F.array(F.struct(left.alias("c"), (1 - (F.col("__p") - left)).alias("w")),
                    F.struct((left + 1).alias("c"), (F.col("__p") - left).alias("w")))
    cells = x.select(*groups, F.explode(parts).alias("s")).groupBy(*groups, F.col("s.c").alias("c")).agg(
        F.sum("s.w").alias("w")).filter(F.col("w") > 0)
    total = cells.groupBy(*groups).agg(F.sum("w").alias("__total"))
    cells = attach(attach(cells, total, groups, "inner"), params, keys, "inner")
    step = (F.col("hi") - F.col("lo"))
    # a few thousand cells per group fan out to the grid, so spread them over all tasks first
    cells = cells.repartition(df.sparkSession.sparkContext.defaultParallelism, *groups, "c")
    at = cells.withColumn("__x", F.col("lo") + step * F.col("c") / float(last))
    at = at.withColumn("grid", F.explode(F.sequence(F.lit(0), F.lit(n_grid - 1))))
    at = at.withColumn("x", F.col("lo") + step * F.col("grid") / float(n_grid - 1))
    z = (F.col("x") - F.col("__x")) / F.col("bw")
    kernel = F.exp(-0.5 * z * z) * F.col("w") / (F.col("__total") * F.col("bw") * F.lit(2.5066282746310002))
    return at.groupBy(*groups, "grid", "x").agg(F.sum(kernel).alias("density"))


def density(df: DataFrame, col: str, by: Sequence[str] = (), n: int = 512, adjust: float = 1.0) -> DataFrame:
    """Kernel density per group on ``n`` points over the group's own data range."""
    return _curve(df, col, list(by), bandwidths(df, col, by, adjust), list(by), n)


def seasonal_density(df: DataFrame, col: str, month: str, by: Sequence[str], n: int = 512, cut_share: float = 0.01) -> DataFrame:
    """Density per month and facet with the facet's mean monthly bandwidth and common range.

    Points below ``cut_share`` of the facet's highest density are dropped (the tails of a ridge).
    """
    monthly = bandwidths(df, col, [*by, month])
    facet = monthly.groupBy(*by).agg(F.avg("bw").alias("bw"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    curve = _curve(df, col, [*by, month], facet, list(by), n)
    top = curve.groupBy(*by).agg(F.max("density").alias("__top"))
    return attach(curve, top, by, "inner").filter(F.col("density") >= cut_share * F.col("__top")).drop("__top")


def quantile_band(df: DataFrame, x: str, y: str, by: Sequence[str], qs: Sequence[float] = (0.1, 0.5, 0.9),
                  pool_days: int = 0) -> DataFrame:
    """Quantiles of ``y`` for each whole-number ``x``, optionally pooling ``pool_days`` either side."""
    rows = df.select(*by, F.col(x).cast("int").alias(x), y)
    if pool_days:
        around = F.sequence(F.col(x) - pool_days, F.col(x) + pool_days)
        days = small_table(rows.select(*by, x).distinct())
        rows = attach(rows.withColumn(x, F.explode(around)), days, [*by, x], "inner")
    long = exact_quantiles(rows, [*by, x], [y], qs).drop("variable")
    return long


# Break points and labels of the odds-ratio map, per term.
ODDS_BREAKS = {
    "pdsi": ([0.75, 0.85, 0.9], ["0.75-0.8", ">0.85"]),
    "percent_woody": ([0.9, 1, 1.05], ["<1.00", "1.00-1.05"]),
    "spei": ([0.2, 0.3, 0.4, 0.5, 0.8], ["0.2 - 0.3", "0.3 - 0.4", "0.4 - 0.5", ">0.5"]),
    "vpd": ([3, 5, 6, 15], ["3 - 4", "5 - 6.0", ">10"]),
    "year": ([0.8, 1, 1.3], ["<1", ">1"]),
    "vs": ([1.1, 1.4, 1.5, 1.6, 1.7, 3], ["1.2 - 1.3", "1.4 - 1.5", "1.5 - 1.6", "1.6 - 1.7", "1.7 - 2.0"]),
}


def odds_map_table(coefs: DataFrame, regions: DataFrame, region: str, breaks: dict = ODDS_BREAKS,
                   alpha: float = 0.05) -> DataFrame:
    """Region x term with its odds-ratio class.

    Not significant terms, regions without a model and main effects that take part in an interaction
    get their own labels. ``coefs`` has ``term``, ``odds_ratio`` and ``p_value``.
    """
    c = coefs.filter(F.col("term") != "(Intercept)").withColumn("odds_ratio", F.bround("odds_ratio", 3))
    label = F.when(~(F.col("p_value") < alpha) | F.col("p_value").isNull(), "Insignificant")
    for term, (edges, names) in breaks.items():
        label = label.when(F.col("term") == term, cut("odds_ratio", edges, names))
    binned = c.withColumn("bins", label).select(region, "term", "odds_ratio", "bins")
    involved = c.filter(F.col("term").contains(":")).select(
        region, F.explode(F.split("term", ":")).alias("term")).distinct().withColumn("__inter", F.lit(True))
    main = c.filter(~F.col("term").contains(":"))
    absent = anti_join(regions.select(region).distinct(), coefs.select(region).distinct(), [region])
    levels = sorted({r[0] for r in main.select("term").distinct().collect()} | set(breaks))
    scaffold = complete_scaffold(absent.withColumn("term", F.lit("")), region, "term", levels)
    scaffold = scaffold.select(region, "term", F.lit(None).cast("double").alias("odds_ratio"), F.lit("Excluded").alias("bins"))
    both = attach(binned.unionByName(scaffold), involved, [region, "term"])
    return both.withColumn("bins", F.when(F.col("__inter"), "Involved in Interaction").otherwise(F.col("bins"))).drop("__inter")

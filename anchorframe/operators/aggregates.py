"""Aggregates: event windows, group profiles, audits and comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorframe.operators.joins import keyed_join
from anchorframe.operators.ranking import exact_quantiles
from anchorframe.operators.tables import append, numeric_columns, unpivot_long
from anchorframe.session import materialize


def _bound_name(v: int) -> str:
    return f"{'m' if v < 0 else 'p'}{abs(v)}" if v else "0"


@dataclass(frozen=True)
class WindowSpec:
    """``fn`` of ``measure`` over the days ``lo <= offset <= hi``."""

    measure: str
    lo: int
    hi: int
    fn: str = "mean"
    name: str | None = None

    @property
    def out(self) -> str:
        return self.name or f"{self.measure}_{_bound_name(self.lo)}_{_bound_name(self.hi)}_{self.fn}"


# The averaging windows studied, in days around the event.
DROUGHT_WINDOWS = [(-10, 10), (-10, 5), (-5, 5), (-1, 5), (-3, 3), (-1, 3), (-1, 1)]
WEATHER_WINDOWS = [(-5, 10), (-1, 10), (-5, 5), (-1, 1), (-1, 5)]
FUEL_WINDOWS = [(-5, 10), (-1, 10), (-5, 5), (-1, 1)]
WIND_MAX_WINDOWS = [(-1, 10), (-1, 5), (-1, 1)]


def window_specs(measures: Sequence[str], windows: Sequence[tuple[int, int]], fn: str = "mean") -> list[WindowSpec]:
    return [WindowSpec(m, lo, hi, fn) for m in measures for lo, hi in windows]


def event_window_agg(df: DataFrame, by: Sequence[str], specs: Sequence[WindowSpec], offset: str = "offset") -> DataFrame:
    """All window features of an event in one hash aggregate; an empty window gives NULL."""
    fns = {"mean": "avg", "max": "max", "sum": "sum"}
    aggs = [F.expr(f"{fns[s.fn]}(CASE WHEN `{offset}` BETWEEN {s.lo} AND {s.hi} THEN nanvl(`{s.measure}`, NULL) END)").alias(s.out)
            for s in specs]
    return df.groupBy(*by).agg(*aggs)


def daily_moments(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Sum, count and max per key: the partial state of a window aggregate, taken before a join."""
    aggs = []
    for m in measures:
        x = F.nanvl(m, F.lit(None))
        aggs += [F.sum(x).alias(f"{m}__sum"), F.count(x).alias(f"{m}__n"), F.max(x).alias(f"{m}__max")]
    return df.groupBy(*keys).agg(*aggs)


def event_window_agg_moments(df: DataFrame, by: Sequence[str], specs: Sequence[WindowSpec],
                             offset: str = "offset") -> DataFrame:
    """:func:`event_window_agg` over rows reduced by :func:`daily_moments`."""
    aggs = []
    for s in specs:
        part = lambda kind: f"CASE WHEN `{offset}` BETWEEN {s.lo} AND {s.hi} THEN `{s.measure}__{kind}` END"  # noqa: E731,B023
        value = {"mean": f"try_divide(sum({part('sum')}), sum({part('n')}))", "max": f"max({part('max')})",
                 "sum": f"sum({part('sum')})"}[s.fn]
        aggs.append(F.expr(value).alias(s.out))
    return df.groupBy(*by).agg(*aggs)


def window_mean(df: DataFrame, by: Sequence[str], measures: Sequence[str], lo: int, hi: int,
                offset: str = "offset") -> DataFrame:
    """Mean within one window, days with a missing or NaN measure left out; events without a row in it do not appear."""
    inside = df.filter(F.col(offset).between(lo, hi))
    return inside.groupBy(*by).agg(*[F.avg(F.nanvl(F.col(m).cast("double"), F.lit(None))).alias(m) for m in measures])


def max_all_numeric(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.max(c).alias(c) for c in numeric_columns(df, by)])


def mean_profile_long(df: DataFrame, by: Sequence[str], name: str, value: str) -> DataFrame:
    """Mean of every numeric column by group in long form (the data of a class profile)."""
    cols = numeric_columns(df, by)
    means = df.groupBy(*by).agg(*[F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None))).alias(c) for c in cols])
    return unpivot_long(means, by, cols, name, value, drop_null=False)


def share_in_group(df: DataFrame, by: Sequence[str], cls: str) -> DataFrame:
    """Count and share of each class within its group."""
    counts = df.groupBy(*by, cls).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("__t"))
    return keyed_join(counts, totals, by, "inner").withColumn("share", F.col("n") / F.col("__t")).drop("__t")


def value_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Five-number summary, mean and missing count per column, long form."""
    q = exact_quantiles(df, [], cols, [0.25, 0.5, 0.75])
    names = {0.25: "q25", 0.5: "median", 0.75: "q75"}
    wide = q.groupBy("variable").agg(*[F.max(F.when(F.col("q") == k, F.col("value"))).alias(n) for k, n in names.items()])
    stats = {"min": F.min, "max": F.max, "mean": F.avg, "n_missing": lambda x: F.count(F.when(x.isNull(), 1))}
    x = {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in cols}
    parts = F.array(*[F.struct(F.lit(c).alias("variable"), *[F.col(f"{c}__{n}").alias(n) for n in stats]) for c in cols])
    means = df.agg(*[f(x[c]).alias(f"{c}__{n}") for c in cols for n, f in stats.items()]).select(F.explode(parts).alias("p")).select("p.*")
    return keyed_join(means, wide, ["variable"], "left")


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair, long form, in one aggregate."""
    pairs = [(a, b) for a in cols for b in cols if a <= b]
    aggs = [F.corr(a, b).alias(f"__{i}") if a != b else F.lit(1.0).alias(f"__{i}") for i, (a, b) in enumerate(pairs)]
    rows = []
    for i, (a, b) in enumerate(pairs):
        rows.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"__{i}").alias("r")))
        if a != b:
            rows.append(F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), F.col(f"__{i}").alias("r")))
    return df.agg(F.count(F.lit(1)).alias("__n"), *aggs).select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def bad_value_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULL, NaN, zero and usable counts per column in one pass."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs.append(F.struct(
            F.lit(c).alias("variable"), F.count(F.when(x.isNull(), 1)).alias("n_null"),
            F.count(F.when(F.isnan(x), 1)).alias("n_nan"), F.count(F.when(x == 0, 1)).alias("n_zero"),
            F.count(F.when(x.isNotNull() & ~F.isnan(x) & (x != 0), 1)).alias("n_usable")))
    return df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("p")).select("p.*")


def share_below(c: str | Column, limit: float) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.avg(F.when(x < limit, 1.0).otherwise(0.0))


def row_audit(stages: Mapping[str, DataFrame], cases: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows left per group after each stage beside the case count, and the excess over it."""
    out = cases.groupBy(*by).agg(F.count(F.lit(1)).alias("n_cases"))
    for name, df in stages.items():
        out = keyed_join(out, df.groupBy(*by).agg(F.count(F.lit(1)).alias(f"n_{name}")), by, "full")
    for name in stages:
        out = out.withColumn(f"excess_{name}", F.col(f"n_{name}") - F.col("n_cases"))
    return out


def balance_report(cases: DataFrame, before: DataFrame, after: DataFrame, by: Sequence[str],
                   cols: Sequence[str]) -> DataFrame:
    """Mean and median by group and set, before and after matching, long over the covariates."""
    tagged = append(*[d.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]).withColumn("set", F.lit(s))
                      for s, d in (("case", cases), ("control_before", before), ("control_after", after))])
    tagged = materialize(tagged)  # read three times below
    keys = [*by, "set"]
    med = exact_quantiles(tagged, keys, cols, [0.5]).drop("q").withColumnRenamed("value", "median")
    means = unpivot_long(tagged.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols]), keys, cols, "variable", "mean")
    both = keyed_join(means, med, [*keys, "variable"], "full")
    pick = lambda s, stat: F.max(F.when(F.col("set") == s, F.col(stat)))
    aggs = [pick(s, stat).alias(f"{s}_{stat}") for s in ("case", "control_before", "control_after")
            for stat in ("mean", "median")]
    return both.groupBy(*by, "variable").agg(*aggs)


def reconcile(new: DataFrame, old: DataFrame, keys: Sequence[str], cols: Sequence[str], tol: float) -> DataFrame:
    """Absolute and relative differences of two versions of a table; rows above ``tol`` are flagged."""
    joined = keyed_join(new.select(*keys, *[F.col(c).alias(f"{c}_new") for c in cols]),
                        old.select(*keys, *[F.col(c).alias(f"{c}_old") for c in cols]), keys, "left")
    for c in cols:
        d = F.abs(F.col(f"{c}_new") - F.col(f"{c}_old"))
        joined = (joined.withColumn(f"{c}_diff", d)
                  .withColumn(f"{c}_rel", F.try_divide(d, F.col(f"{c}_new")))
                  .withColumn(f"{c}_above", F.coalesce(d > tol, F.lit(False))))
    return joined


def reconcile_summary(diff: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Of a reconciliation, per column: rows, rows the old version lacks, rows above the tolerance, largest and mean difference."""
    parts = F.array(*[F.struct(F.lit(c).alias("variable"), *[F.col(f"{c}__{n}").alias(n) for n in ("n", "n_missing", "n_above", "max_diff", "mean_diff")]) for c in cols])
    aggs = []
    for c in cols:
        d = F.col(f"{c}_diff")
        aggs += [F.count(F.lit(1)).alias(f"{c}__n"), F.count(F.when(F.col(f"{c}_old").isNull(), 1)).alias(f"{c}__n_missing"), F.count(F.when(F.col(f"{c}_above"), 1)).alias(f"{c}__n_above"),
                 F.max(d).alias(f"{c}__max_diff"), F.avg(d).alias(f"{c}__mean_diff")]
    return diff.agg(*aggs).select(F.explode(parts).alias("p")).select("p.*")


def mismatches(diff: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """The rows of a reconciliation above the tolerance, long over the columns: keys, variable, new, old, diff."""
    each = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"{c}_new").cast("double").alias("new"), F.col(f"{c}_old").cast("double").alias("old"), F.col(f"{c}_diff").alias("diff"),
                              F.col(f"{c}_above").alias("above")) for c in cols])
    return diff.select(*keys, F.explode(each).alias("p")).where("p.above").select(*keys, "p.variable", "p.new", "p.old", "p.diff")

"""Row-level diagnostics and predictions from fitted models.

Coefficients and covariances are a small table; rows meet them by group, so nothing here shuffles
the data except the rank-based summaries.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorframe.functions.hashing import uniform
from anchorframe.functions.numbers import format_effect, p_band, round_half_even
from anchorframe.functions.text import relabel
from anchorframe.operators.glm import Z975, Fits, base_columns, design
from anchorframe.operators.ranking import attach, value_rank
from anchorframe.operators.tables import complete_cases
from anchorframe.session import small_table


def _linear(p: int) -> tuple[Column, Column]:
    """Linear predictor and its variance from ``__x*``, ``beta`` and ``vcov``."""
    eta = " + ".join(f"CASE WHEN used[{i}] > 0 THEN __x{i} * beta[{i}] ELSE 0D END" for i in range(p))
    var = " + ".join(f"__x{a} * __x{b} * vcov[{a * p + b}]" + (" * 2" if a != b else "") for a in range(p) for b in range(a, p))
    return F.expr(eta), F.expr(var)


def _with_fits(rows: DataFrame, fits: Fits) -> DataFrame:
    p = len(fits.names)
    j = attach(rows, small_table(fits.table.select(*fits.by, "model", "used", "beta", "vcov", "k", "dispersion", F.col("n").alias("n_fit"))), fits.by, "inner")
    eta, var = _linear(p)
    return j.withColumn("eta", eta).withColumn("eta_var", var).drop("beta", "vcov", "used", *[f"__x{i}" for i in range(p)])


def row_diagnostics(df: DataFrame, fits: Fits, keep: Sequence[str] = ()) -> DataFrame:
    """Fitted value, residuals, leverage, standardized residual and Cook's distance of every row."""
    d = _with_fits(design(df, fits.y, fits.by, fits.terms, keep), fits)
    y = F.col("__y")
    if fits.family == "binomial":
        d = d.withColumn("fitted", 1.0 / (1.0 + F.exp(-F.col("eta"))))
        var = F.col("fitted") * (1.0 - F.col("fitted"))
        d = d.withColumn("__w", var)
        nll = F.greatest(F.col("eta"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("eta"))) - y * F.col("eta")
        unit_dev, working = 2.0 * nll, (y - F.col("fitted")) / var
    else:
        d = d.withColumn("fitted", F.col("eta"))
        var = F.col("fitted") * F.col("fitted")
        d = d.withColumn("__w", 1.0 / var)
        ratio = y / F.col("fitted")
        unit_dev, working = 2.0 * (ratio - 1.0 - F.log(ratio)), y - F.col("fitted")
    resid = y - F.col("fitted")
    d = d.withColumn("resid_response", resid).withColumn("resid_pearson", resid / F.sqrt(var))
    d = d.withColumn("resid_deviance", F.signum(resid) * F.sqrt(F.greatest(unit_dev, F.lit(0.0)))).withColumn("resid_working", working)
    d = d.withColumn("leverage", F.col("__w") * F.col("eta_var") / F.col("dispersion"))
    one_less = 1.0 - F.col("leverage")
    d = d.withColumn("std_resid", F.col("resid_deviance") / F.sqrt(F.col("dispersion") * one_less))
    k = F.col("k") - F.lit(0 if fits.family == "binomial" else 1)
    cook = F.pow(F.col("resid_pearson") / one_less, F.lit(2)) * F.col("leverage") / (F.col("dispersion") * k)
    d = d.withColumn("cooks_d", cook)
    return d.select(*fits.by, "model", *keep, F.col("__y").alias("y"), "eta", "fitted", "resid_response", "resid_pearson",
                    "resid_deviance", "resid_working", "leverage", "std_resid", "cooks_d", "n_fit")


def influential(diag: DataFrame, by: Sequence[str], id_col: str) -> DataFrame:
    """Rows with Cook's distance above 4/n per fit: how many, the largest, and which row it is."""
    flag = F.col("cooks_d") > 4.0 / F.col("n_fit")
    return diag.groupBy(*by, "model").agg(
        F.count(F.when(flag, 1)).alias("n_influential"), F.max("cooks_d").alias("max_cooks_d"),
        F.max_by(id_col, "cooks_d").alias("max_row"))


def binned_residuals(diag: DataFrame, by: Sequence[str], id_cols: Sequence[str], x: str = "fitted",
                     residual: str = "resid_response") -> DataFrame:
    """Mean ``x`` and residual with a two-standard-error band in near-equal-count bins of ``x``."""
    keys = [*by, "model"]
    ranked = value_rank(diag.select(*keys, *id_cols, x, residual), keys, x, id_cols)
    sizes = small_table(diag.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")))
    r = attach(ranked, sizes, keys, "inner")
    n = F.col("__n")
    bins = F.when(n >= 100, F.floor(F.sqrt(n.cast("double")))).when(n > 10, F.lit(10)).otherwise(F.floor(n / 2)).cast("bigint")
    r = r.withColumn("bin", F.floor((F.col("rank") * bins + n - 1) / n).cast("bigint"))
    return r.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean_x"), F.avg(residual).alias("mean_residual"),
        (2.0 * F.stddev_samp(residual) / F.sqrt(F.count(F.lit(1)))).alias("two_se"))


def quantile_residuals(diag: DataFrame, seed, id_cols: Sequence[str]) -> DataFrame:
    """Randomized quantile residual of a 0/1 response: uniform on (0, 1) when the model holds."""
    u = uniform(seed, "qres", *id_cols)
    p = F.col("fitted")
    return diag.withColumn("qres", F.when(F.col("y") == 0, u * (1.0 - p)).otherwise((1.0 - p) + u * p))


def ks_distance(resid: DataFrame, by: Sequence[str], id_cols: Sequence[str], col: str = "qres") -> DataFrame:
    """Largest gap between the residuals and the uniform distribution, per fit."""
    keys = [*by, "model"]
    ranked = value_rank(resid.select(*keys, *id_cols, col), keys, col, id_cols)
    j = attach(ranked, small_table(resid.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))), keys, "inner")
    return j.groupBy(*keys, "n").agg(F.max(F.abs(F.col("rank") / F.col("n") - F.col(col))).alias("ks"))


def _profiles(df: DataFrame, fits: Fits) -> DataFrame:
    """Group means of the base columns over the rows the fits used."""
    cols = base_columns(fits.terms)
    rows = complete_cases(df, [fits.y, *cols, *fits.by])
    return small_table(rows.groupBy(*fits.by).agg(*[F.avg(c).alias(c) for c in cols]) if fits.by
                       else rows.agg(*[F.avg(c).alias(c) for c in cols]))


def _predict(grid: DataFrame, fits: Fits, keep: Sequence[str], conf_z: float) -> DataFrame:
    xs = [F.lit(1.0).alias("__x0")]
    for i, t in enumerate(fits.terms):
        c = F.col(t) if isinstance(t, str) else F.col(t[0]) * F.col(t[1])
        xs.append(c.cast("double").alias(f"__x{i + 1}"))
    g = _with_fits(grid.select(*fits.by, *keep, *xs), fits)
    inv = (lambda e: 1.0 / (1.0 + F.exp(-e))) if fits.family == "binomial" else (lambda e: e)
    se = F.sqrt(F.greatest("eta_var", F.lit(0.0)))
    return g.select(*fits.by, "model", *keep, inv(F.col("eta")).alias("predicted"),
                    inv(F.col("eta") - conf_z * se).alias("lo"), inv(F.col("eta") + conf_z * se).alias("hi"))


def predict_grid(df: DataFrame, fits: Fits, x: str, values: Sequence[float], conf_z: float = Z975) -> DataFrame:
    """Predicted response with its interval along one predictor, the others at their group means."""
    g = _profiles(df, fits).withColumn(x, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    return _predict(g, fits, [x], conf_z)


def predict_interaction(df: DataFrame, fits: Fits, x: str, values: Sequence[float], moderator: str,
                        levels: Sequence[float], conf_z: float = Z975) -> DataFrame:
    """:func:`predict_grid` repeated at chosen levels of a second predictor."""
    g = _profiles(df, fits).withColumn(x, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    g = g.withColumn(moderator, F.explode(F.array(*[F.lit(float(v)) for v in levels])))
    return _predict(g, fits, [x, moderator], conf_z)


def odds_ratio_report(coefs: DataFrame, by: Sequence[str], labels: Mapping[str, str]) -> DataFrame:
    """Readable odds-ratio rows: labels, three decimals, p bands, formatted text and row order."""
    c = coefs.filter(F.col("term") != "(Intercept)")
    text = F.concat(format_effect("odds_ratio"), F.lit(" ("), format_effect("or_lo"), F.lit(", "), format_effect("or_hi"), F.lit(")"))
    return c.select(*by, "term_pos", relabel("term", labels).alias("label"), round_half_even("odds_ratio", 3).alias("odds_ratio"),
                    round_half_even("or_lo", 3).alias("or_lo"), round_half_even("or_hi", 3).alias("or_hi"),
                    p_band("p_value").alias("p_band"), text.alias("text")).orderBy(*by, "term_pos")


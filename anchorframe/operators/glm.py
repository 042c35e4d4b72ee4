"""Regression for all groups and candidate models at once.

One iteration is one Spark aggregate: every row meets the current coefficients of its group's models
and contributes to their normal equations, which combine before the shuffle. Only the p x p systems
are solved outside the aggregate: on the driver while there are few of them, otherwise in tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from anchorframe.operators.ranking import attach
from anchorframe.operators.tables import complete_cases
from anchorframe.session import collect_bounded, local_table, materialize, small_table

INTERCEPT = "(Intercept)"
TOLERANCE = 1e-8
MAX_ITERATIONS = 25
DRIVER_SYSTEMS = 20_000  # normal equations solved on the driver; more of them stay in tasks
Z975 = 1.959963984540054

Term = str | tuple[str, str]


def term_name(t: Term) -> str:
    return t if isinstance(t, str) else ":".join(t)


def base_columns(terms: Iterable[Term]) -> list[str]:
    out: list[str] = []
    for t in terms:
        for c in (t,) if isinstance(t, str) else t:
            if c not in out:
                out.append(c)
    return out


def crossed(a: str, b: str) -> list[Term]:
    """Main effects and their interaction."""
    return [a, b, (a, b)]


def _term_column(t: Term) -> Column:
    return F.col(t).cast("double") if isinstance(t, str) else F.col(t[0]).cast("double") * F.col(t[1]).cast("double")


@dataclass(frozen=True)
class Fits:
    """Fitted models. ``table`` has one row per (group, model); array columns follow ``terms``."""

    table: DataFrame
    by: list[str]
    terms: list[Term]
    y: str
    family: str

    @property
    def names(self) -> list[str]:
        return [INTERCEPT, *map(term_name, self.terms)]


def design(df: DataFrame, y: str, by: Sequence[str], terms: Sequence[Term], keep: Sequence[str] = ()) -> DataFrame:
    """Complete rows with the response and one column per term (``__x0`` is the intercept)."""
    rows = complete_cases(df, [y, *base_columns(terms), *by])
    xs = [F.lit(1.0).alias("__x0"), *[_term_column(t).alias(f"__x{i + 1}") for i, t in enumerate(terms)]]
    return rows.select(*by, *keep, F.col(y).cast("double").alias("__y"), *xs)


def _scaled(d: DataFrame, p: int, by: Sequence[str] = ()) -> tuple[DataFrame, np.ndarray, np.ndarray, float, list[dict] | None]:
    """Centre and scale the term columns over all rows.

    Returns the rows, the mean and spread used, the mean response, and the groups (None when there
    are too many for the driver). One job serves all of it: overall moments are pooled from the groups.
    """
    stats = ["count(1) AS n", "avg(__y) AS y"]
    for i in range(1, p):
        stats += [f"avg(__x{i}) AS m{i}", f"var_pop(__x{i}) AS v{i}"]
    moments = [F.expr(e) for e in stats]
    rows = d.groupBy(*by).agg(*moments).limit(DRIVER_SYSTEMS + 1).collect()
    groups = [{k: r[k] for k in by} for r in rows] if len(rows) <= DRIVER_SYSTEMS else None
    if groups is None:
        rows = [d.agg(*moments).first()]
    n = np.array([r["n"] for r in rows], float)
    total = max(n.sum(), 1.0)
    m, s = np.zeros(p), np.ones(p)
    for i in range(1, p):
        gm, gv = (np.array([r[f"{c}{i}"] or 0.0 for r in rows]) for c in "mv")
        m[i] = (n * gm).sum() / total
        s[i] = math.sqrt((n * (gv + (gm - m[i]) ** 2)).sum() / total) or 1.0
    mean_y = float(sum(k * (r["y"] or 0.0) for k, r in zip(n, rows)) / total)
    xs = [f"(__x{i} - {float(m[i])!r}D) / {float(s[i])!r}D AS __x{i}" if i else "__x0" for i in range(p)]
    rest = [f"`{c}`" for c in d.columns if not c.startswith("__x")]
    return d.selectExpr(*rest, *xs), m, s, mean_y, groups


def _scaled_by_group(d: DataFrame, p: int, by: Sequence[str]) -> tuple[DataFrame, DataFrame, float, list[dict] | None]:
    """Centre and scale the term columns within each group, as groups may differ far more than their rows.

    Returns the rows, the table of what was used (``__m`` and ``__s`` per group), the mean response and the groups with
    their ``__m`` and ``__s`` (None when there are too many for the driver).
    """
    xs = range(1, p)
    mean = F.array(F.lit(0.0), *[F.avg(f"__x{i}") for i in xs])
    spread = F.array(F.lit(1.0), *[F.coalesce(F.nullif(F.stddev_pop(f"__x{i}"), F.lit(0.0)), F.lit(1.0)) for i in xs])
    table = materialize(d.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.avg("__y").alias("__mean_y"), mean.alias("__m"), spread.alias("__s")))
    mean_y = table.agg(F.try_divide(F.sum(F.col("__n") * F.col("__mean_y")), F.sum("__n"))).first()[0] or 0.0
    table = table.select(*by, "__m", "__s")
    found = table.limit(DRIVER_SYSTEMS + 1).collect()
    groups = [r.asDict() for r in found] if len(found) <= DRIVER_SYSTEMS else None
    rest = [f"`{c}`" for c in d.columns if not c.startswith("__x")]
    rows = attach(d, table, by, "inner").selectExpr(*rest, "__x0", *[f"(__x{i} - __m[{i}]) / __s[{i}] AS __x{i}" for i in xs])
    return rows, table, float(mean_y), groups


def _state_schema(d: DataFrame, by: Sequence[str]) -> T.StructType:
    arr, dbl = T.ArrayType(T.DoubleType()), T.DoubleType()
    fields = [T.StructField(k, d.schema[k].dataType) for k in by]
    fields += [T.StructField("model", T.StringType()), T.StructField("b", arr), T.StructField("used", arr),
               T.StructField("shift", arr), T.StructField("prev_b", arr), T.StructField("prev_dev", dbl),
               T.StructField("it", T.IntegerType()), T.StructField("done", T.BooleanType()),
               T.StructField("converged", T.BooleanType()), T.StructField("dev", dbl), T.StructField("n", T.LongType()),
               T.StructField("loglik", dbl), T.StructField("dispersion", dbl), T.StructField("vcov", arr)]
    return T.StructType(fields)


CARRY = ("b", "used", "shift", "prev_b", "prev_dev", "it")


def _statistics(rows: DataFrame, state: DataFrame, by: Sequence[str], p: int, family: str) -> DataFrame:
    """Normal equations and fit sums per (group, model) at the state's coefficients."""
    j = attach(rows, state.select(*by, "model", "b", "shift"), by, "inner")
    ids = [f"`{k}`" for k in (*by, "model")]
    eta = " + ".join(f"(__x{i} + shift[{i}]) * b[{i}]" for i in range(p))
    j = j.selectExpr(*ids, "__y", *[f"__x{i} + shift[{i}] AS __u{i}" for i in range(p)], f"{eta} AS __eta")
    if family == "binomial":
        j = j.selectExpr("*", "1 / (1 + exp(-__eta)) AS __mu").selectExpr("*", "__mu * (1 - __mu) AS __w", "__y - __mu AS __r")
        sums = ["sum(greatest(__eta, 0D) + log1p(exp(-abs(__eta))) - __y * __eta) AS s0", "0D AS s1", "0D AS s2",
                "0D AS s3", "0L AS bad"]
    else:
        j = j.selectExpr("*", "CASE WHEN __eta > 0 THEN __eta ELSE 1D END AS __mu")
        j = j.selectExpr("*", "1 / (__mu * __mu) AS __w", "(__y - __mu) / (__mu * __mu) AS __r", "__y / __mu AS __q")
        sums = ["sum(ln(__y)) AS s0", "sum(__q) AS s1", "sum(ln(__mu)) AS s2", "sum((__q - 1) * (__q - 1)) AS s3",
                "count_if(NOT __eta > 0) AS bad"]
    gram = ", ".join(f"sum(__w * __u{a} * __u{b})" for a in range(p) for b in range(a, p))
    score = ", ".join(f"sum(__u{a} * __r)" for a in range(p))
    aggs = ["count(1) AS n", *sums, f"array({gram}) AS gram", f"array({score}) AS score"]
    return j.groupBy(*by, "model").agg(*[F.expr(e) for e in aggs])


def _independent(g: np.ndarray) -> list[int]:
    """Positions kept after dropping columns that earlier ones determine (by pivoted elimination in order)."""
    keep: list[int] = []
    for i in range(len(g)):
        if g[i, i] <= 0:
            continue
        left = g[i, i]
        if keep:
            c = g[np.ix_(keep, [i])][:, 0]
            left -= c @ np.linalg.lstsq(g[np.ix_(keep, keep)], c, rcond=None)[0]
        if left > 1e-9 * g[i, i]:
            keep.append(i)
    return keep


def _advance(records: Iterable[dict], p: int, family: str) -> list[dict]:
    """One update of every (group, model): accept or halve the step, test convergence, solve for the next."""
    out = []
    for r in records:
        b, prev_b = np.array(r["b"], float), r["prev_b"]
        used = np.array(r["used"], float) > 0
        n = int(r["n"])
        if family == "binomial":
            dev, loglik, disp = 2.0 * r["s0"], -r["s0"], 1.0
        else:
            dev = 2.0 * (r["s1"] - n - r["s0"] + r["s2"])
            disp = r["s3"] / max(n - int(used.sum()), 1)
            phi = max(dev / n, 1e-300)
            a = 1.0 / phi
            loglik = (a - 1) * r["s0"] - a * r["s1"] - a * (r["s2"] + n * math.log(phi)) - n * math.lgamma(a)
        invalid = not math.isfinite(dev) or r["bad"] > 0
        worse = prev_b is not None and math.isfinite(r["prev_dev"]) and dev > r["prev_dev"] + 1e-7 * (abs(r["prev_dev"]) + 0.1)
        new = {k: v for k, v in r.items() if k not in ("s0", "s1", "s2", "s3", "bad", "gram", "score")}
        new.update(dev=dev, n=n, loglik=loglik, dispersion=disp, it=r["it"] + 1, done=False, converged=False, vcov=None)
        last = new["it"] >= 4 * MAX_ITERATIONS if (invalid or worse) else new["it"] > MAX_ITERATIONS
        if (invalid or worse) and prev_b is not None and not last:
            new["b"] = list((b + np.array(prev_b, float)) / 2)
            out.append(new)
            continue
        g = np.zeros((p, p))
        g[np.triu_indices(p)] = r["gram"]
        g = g + np.triu(g, 1).T
        idx = np.flatnonzero(used)
        keep = [int(idx[i]) for i in _independent(g[np.ix_(idx, idx)])] if not invalid else []
        settled = prev_b is not None and abs(dev - r["prev_dev"]) / (abs(dev) + 0.1) < TOLERANCE
        if settled or last or not keep:
            v = np.full((p, p), np.nan)
            if keep:
                v[np.ix_(keep, keep)] = np.linalg.inv(g[np.ix_(keep, keep)]) * disp
            # a standard error this large on the scaled columns means a direction that separates the classes
            spread = np.sqrt(np.nanmax(np.diag(v)[keep])) if keep else np.inf
            separated = family == "binomial" and (dev < 1e-6 * max(n, 1) or spread > 100)
            if settled and keep:  # one more step costs nothing here and squares the remaining error
                b[keep] += np.linalg.solve(g[np.ix_(keep, keep)], np.array(r["score"], float)[keep])
            aliased = [i for i in idx if i not in keep]
            b[aliased] = np.nan
            new.update(done=True, converged=bool(settled and not separated), vcov=list(v.ravel()), b=list(b))
        else:
            step = np.zeros(p)
            step[keep] = np.linalg.solve(g[np.ix_(keep, keep)], np.array(r["score"], float)[keep])
            new.update(prev_b=list(b), prev_dev=dev, b=list(b + step))
        out.append(new)
    return out


def _iterate(rows: DataFrame, state: DataFrame | list[dict], by: Sequence[str], p: int, family: str, schema: T.StructType) -> DataFrame | list[dict]:
    """Run all (group, model) fits to the end and return the final state.

    The state is a list while its systems are solved on the driver, and a table beyond that.
    """
    spark = rows.sparkSession
    if isinstance(state, list):
        finished: list[dict] = []
        while state:
            held = {(*[r[k] for k in by], r["model"]): r for r in state}
            table = F.broadcast(local_table(spark, state, schema))
            stats = [r.asDict() for r in _statistics(rows, table, by, p, family).collect()]
            for r in stats:
                r.update({c: held[(*[r[k] for k in by], r["model"])][c] for c in CARRY})
            moved = _advance(stats, p, family)
            finished += [m for m in moved if m["done"]]
            state = [m for m in moved if not m["done"]]
        return finished

    def solve(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame(_advance(_records(pdf), p, family), columns=schema.names)

    done = None
    while True:
        # the state joins back after the sums: arrays inside the aggregate would force a sort of all rows
        sums = attach(_statistics(rows, state, by, p, family), state.select(*by, "model", *CARRY), [*by, "model"], "inner")
        moved = materialize(sums.mapInPandas(solve, schema))
        ended = moved.filter("done")
        done = ended if done is None else done.unionByName(ended)
        state = moved.filter("not done")
        if state.isEmpty():
            return done


def _records(pdf) -> list[dict]:
    out = pdf.to_dict("records")
    for r in out:
        r["prev_b"] = None if r["prev_b"] is None else list(r["prev_b"])
        r["prev_dev"] = float("nan") if r["prev_dev"] is None else r["prev_dev"]
    return out


def _initial_state(rows: DataFrame, by: Sequence[str], groups: list[dict] | None, models: Mapping[str, list[float]],
                   start: float, schema: T.StructType, p: int) -> DataFrame | list[dict]:
    """Starting coefficients for every group and model: intercept ``start``, slopes 0."""
    zero = [0.0] * p
    if groups is not None and len(groups) * len(models) <= DRIVER_SYSTEMS:
        return [{**{k: g[k] for k in by}, "model": m, "used": used, "b": [start, *zero[1:]], "shift": zero, "it": 0, "prev_b": None, "prev_dev": None}
                for g in groups for m, used in models.items()]
    arr = lambda v: F.array(*[F.lit(float(x)) for x in v])
    kinds = F.array(*[F.struct(F.lit(m).alias("model"), arr(u).alias("used")) for m, u in models.items()])
    s = rows.select(*by).distinct().withColumn("__m", F.explode(kinds)).select(*by, "__m.model", "__m.used")
    s = s.withColumns({"b": arr([start, *zero[1:]]), "shift": arr(zero), "it": F.lit(0)})
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in s.columns}
    return materialize(s.withColumns(missing).select(*[F.col(f.name).cast(f.dataType) for f in schema]))


def _union_terms(models: Mapping[str, Sequence[Term]]) -> list[Term]:
    out: list[Term] = []
    for terms in models.values():
        for t in terms:
            if t not in out:
                out.append(t)
    return out


def _finish(final: DataFrame | list[dict], spark: SparkSession, state_schema: T.StructType, by: Sequence[str], scale: DataFrame,
            groups: list[dict] | None, p: int, family: str) -> DataFrame:
    """Back to the original scale of each group: coefficients, covariance, AICc and variance inflation per fit."""
    dbl, arr = T.DoubleType(), T.ArrayType(T.DoubleType())
    keep = [f for f in state_schema if f.name in [*by, "model", "used", "n", "loglik", "dispersion", "converged"]]
    schema = T.StructType([*keep, T.StructField("k", T.IntegerType()), T.StructField("deviance", dbl),
                           T.StructField("iterations", T.IntegerType()), T.StructField("aicc", dbl),
                           T.StructField("beta", arr), T.StructField("vcov", arr), T.StructField("p", arr), T.StructField("vif", arr)])
    def convert(records):
        out = []
        for r in records:
            m, s = np.array(r["__m"], float), np.array(r["__s"], float)
            back = np.diag(1.0 / s)
            back[0, :] = -m / s
            back[0, 0] = 1.0
            g = np.array(r["b"], float)
            v = np.array(r["vcov"], float).reshape(p, p)
            used = np.array(r["used"], float) > 0
            ok = used & np.isfinite(g) & np.isfinite(np.diag(v))
            g0, v0 = np.where(ok, g, 0.0), np.where(np.outer(ok, ok), v, 0.0)
            b, vb = back @ g0, back @ v0 @ back.T
            b[~ok] = np.where(used[~ok], np.nan, 0.0)
            vif = np.full(p, np.nan)
            sl = [i for i in range(1, p) if ok[i]]
            if len(sl) > 1:
                sub = vb[np.ix_(sl, sl)]
                sd = np.sqrt(np.diag(sub))
                vif[sl] = np.diag(np.linalg.pinv(sub / np.outer(sd, sd)))
            elif sl:
                vif[sl] = 1.0
            with np.errstate(all="ignore"):
                z = np.abs(b) / np.sqrt(np.diag(vb))
            pv = [math.erfc(x / math.sqrt(2.0)) if math.isfinite(x) else math.nan for x in z]
            k = int(ok.sum()) + (0 if family == "binomial" else 1)
            n = int(r["n"])
            aicc = -2 * r["loglik"] + 2 * k + (2 * k * (k + 1) / (n - k - 1) if n - k - 1 > 0 else math.inf)
            out.append({**{f.name: r[f.name] for f in keep}, "used": list(ok.astype(float)), "k": k,
                        "deviance": r["dev"], "iterations": int(r["it"]), "aicc": aicc, "beta": list(b),
                        "vcov": list(vb.ravel()), "p": pv, "vif": list(vif)})
        return out

    if isinstance(final, list):
        held = {tuple(g[k] for k in by): g for g in groups}
        return local_table(spark, convert({**r, **held[tuple(r[k] for k in by)]} for r in final), schema)

    def batches(it):
        import pandas as pd

        for pdf in it:
            yield pd.DataFrame(convert(pdf.to_dict("records")), columns=schema.names)

    return materialize(attach(final, scale, by, "inner").mapInPandas(batches, schema))


def fit_candidates(df: DataFrame, y: str, by: Sequence[str], models: Mapping[str, Sequence[Term]],
                   family: str = "binomial") -> Fits:
    """Fit every model in every group on the rows complete in all terms."""
    terms = _union_terms(models)
    p = len(terms) + 1
    by = list(by)
    raw = design(df, y, by, terms).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows, scale, mean_y, groups = _scaled_by_group(raw, p, by)
        schema = _state_schema(rows, by)
        used = {name: [1.0] + [1.0 if t in list(ts) else 0.0 for t in terms] for name, ts in models.items()}
        state = _initial_state(rows, by, groups, used, 0.0 if family == "binomial" else mean_y, schema, p)
        final = _iterate(rows, state, by, p, family, schema)
        return Fits(_finish(final, df.sparkSession, schema, by, scale, groups, p, family), by, terms, y, family)
    finally:
        raw.unpersist()


def fit_logistic(df: DataFrame, y: str, by: Sequence[str], terms: Sequence[Term]) -> Fits:
    return fit_candidates(df, y, by, {"model": terms})


def fit_gamma_identity(df: DataFrame, y: str, by: Sequence[str], terms: Sequence[Term]) -> Fits:
    """Gamma response with identity link (use on ``log10`` of a size, for instance)."""
    return fit_candidates(df, y, by, {"model": terms}, family="gamma")


def _erfc(x: Column) -> Column:
    """Complementary error function, x >= 0 (Chebyshev fit, relative error below 1.2e-7)."""
    # Published coefficients of the rational Chebyshev approximation.
    cs = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587,
          -0.82215223, 0.17087277]
    t = 1.0 / (1.0 + 0.5 * x)
    poly = F.lit(cs[-1])
    for c in reversed(cs[:-1]):
        poly = F.lit(c) + t * poly
    return t * F.exp(-x * x + poly)


def p_value(z: Column) -> Column:
    """Two-sided normal p-value."""
    return _erfc(F.abs(z) / F.lit(math.sqrt(2.0)))


def coef_table(fits: Fits, conf_z: float = Z975) -> DataFrame:
    """One row per coefficient: estimate, se, z, p, Wald interval and odds ratios."""
    p = len(fits.names)
    items = F.array(*[F.struct(
        F.lit(i).alias("term_pos"), F.lit(nm).alias("term"), F.col("used")[i].alias("u"), F.col("beta")[i].alias("estimate"),
        F.sqrt(F.col("vcov")[i * p + i]).alias("se"), F.col("p")[i].alias("p_value"), F.col("vif")[i].alias("vif")) for i, nm in enumerate(fits.names)])
    t = fits.table.select(*fits.by, "model", F.explode(items).alias("c")).select(*fits.by, "model", "c.*")
    t = t.filter(F.col("u") > 0).drop("u")
    z = F.col("estimate") / F.col("se")
    lo, hi = F.col("estimate") - conf_z * F.col("se"), F.col("estimate") + conf_z * F.col("se")
    return t.select(*fits.by, "model", "term_pos", "term", "estimate", "se", z.alias("z"), "p_value",
                    lo.alias("ci_lo"), hi.alias("ci_hi"), F.exp("estimate").alias("odds_ratio"),
                    F.exp(lo).alias("or_lo"), F.exp(hi).alias("or_hi"), "vif")


def vif(fits: Fits) -> DataFrame:
    t = coef_table(fits).filter(F.col("term") != INTERCEPT)
    return t.select(*fits.by, "model", "term", "vif")


def fit_table(fits: Fits) -> DataFrame:
    text = F.concat_ws(" + ", *[F.when(F.col("used")[i + 1] > 0, F.lit(term_name(t))) for i, t in enumerate(fits.terms)])
    return fits.table.select(*fits.by, "model", "n", "k", "loglik", "deviance", "dispersion", "aicc", "converged",
                             "iterations", F.when(text == "", "1").otherwise(text).alias("terms"))


def selection_table(fits: Fits, max_delta: float | None = 2.0) -> DataFrame:
    """Models of each group by AICc: difference to the best, relative likelihood and Akaike weight."""
    t = fit_table(fits)
    best = t.groupBy(*fits.by).agg(F.min("aicc").alias("__best"))
    t = attach(t, best, fits.by).withColumn("delta_aicc", F.col("aicc") - F.col("__best"))
    t = t.withColumn("rel_likelihood", F.exp(-0.5 * F.col("delta_aicc")))
    total = t.groupBy(*fits.by).agg(F.sum("rel_likelihood").alias("__sum"))
    t = attach(t, total, fits.by).withColumn("weight", F.bround(F.col("rel_likelihood") / F.col("__sum"), 3))
    out = t.select(*fits.by, "model", "terms", "loglik", "k", "aicc", "delta_aicc", "rel_likelihood", "weight")
    return out if max_delta is None else out.filter(F.col("delta_aicc") <= max_delta)


def interaction_gate(coefs: DataFrame, by: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Models whose interactions are all significant; a model without interactions passes."""
    worst = F.max(F.when(F.col("term").contains(":"), F.col("p_value")))
    g = coefs.groupBy(*by, "model").agg(worst.alias("max_interaction_p"))
    return g.withColumn("accepted", F.coalesce(F.col("max_interaction_p") < alpha, F.lit(True)))


def compare_windows(df: DataFrame, y: str, by: Sequence[str], features: Sequence[str]) -> DataFrame:
    """One single-feature model per averaging window, ranked by AICc within each group."""
    return selection_table(fit_candidates(df, y, by, {f: [f] for f in features}), None)


def average_models(fits: Fits, max_delta: float | None = None) -> DataFrame:
    """AICc-weighted coefficients with unconditional errors; a term a model lacks counts as 0."""
    sel = selection_table(fits, max_delta).select(*fits.by, "model", "rel_likelihood")
    total = sel.groupBy(*fits.by).agg(F.sum("rel_likelihood").alias("__t"))
    w = attach(sel, total, fits.by).withColumn("__w", F.col("rel_likelihood") / F.col("__t"))
    p = len(fits.names)
    items = F.array(*[F.struct(F.lit(nm).alias("term"), F.col("beta")[i].alias("b"), F.col("vcov")[i * p + i].alias("v"))
                      for i, nm in enumerate(fits.names)])
    t = fits.table.select(*fits.by, "model", F.explode(items).alias("c")).select(*fits.by, "model", "c.*")
    t = attach(t, w.select(*fits.by, "model", "__w"), [*fits.by, "model"], "inner").na.fill(0.0, ["b", "v"])
    mean = t.groupBy(*fits.by, "term").agg(F.sum(F.col("__w") * F.col("b")).alias("estimate"))
    t = attach(t, mean, [*fits.by, "term"])
    dev = F.col("b") - F.col("estimate")
    out = t.groupBy(*fits.by, "term", "estimate").agg(F.sqrt(F.sum(F.col("__w") * (F.col("v") + dev * dev))).alias("se"))
    z = F.col("estimate") / F.col("se")
    return out.withColumn("z", z).withColumn("p_value", p_value(z))


def standardized_average(avg: DataFrame, df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Averaged coefficients per standard deviation of their predictor."""
    sds = df.groupBy(*by).agg(*[F.stddev_samp(c).alias(c) for c in cols])
    long = sds.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("term"), F.col(c).alias("sd")) for c in cols])).alias("s"))
    j = attach(avg, long.select(*by, "s.term", "s.sd"), [*by, "term"], "inner")
    return j.withColumn("std_estimate", F.col("estimate") * F.col("sd")).withColumn("std_se", F.col("se") * F.col("sd"))


def zscored(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Columns centred and scaled within their group."""
    stats = df.groupBy(*by).agg(*[F.avg(c).alias(f"__m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"__s_{c}") for c in cols])
    j = attach(df, small_table(stats), by, "inner")
    for c in cols:
        j = j.withColumn(c, F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}")))
    return j.select(*df.columns)


def standardized_effects(df: DataFrame, y: str, by: Sequence[str], terms: Sequence[Term]) -> DataFrame:
    """Odds ratios per standard deviation with their interval; p-values come from the unscaled fit."""
    rows = complete_cases(df, [y, *base_columns(terms), *by])
    raw = coef_table(fit_logistic(rows, y, by, terms)).select(*by, "term", "p_value")
    std = coef_table(fit_logistic(zscored(rows, by, base_columns(terms)), y, by, terms))
    return attach(std.select(*by, "term_pos", "term", "odds_ratio", "or_lo", "or_hi"), raw, [*by, "term"])


def _profile_starts(records: Iterable[dict], by: Sequence[str], p: int, level_z: float) -> list[dict]:
    """For each coefficient of each fit and both sides where its search starts: at the Wald bound, the others where they are expected."""
    out = []
    for r in records:
        used, beta, v = np.array(r["used"], float) > 0, np.array(r["beta"], float), np.array(r["vcov"], float).reshape(p, p)
        m, s = np.array(r["__m"], float), np.array(r["__s"], float)
        b = np.where(used & np.isfinite(beta), beta, 0.0)
        for j in np.flatnonzero(used):
            sound = bool(r["converged"]) and math.isfinite(v[j, j]) and v[j, j] > 0
            reach = level_z * math.sqrt(v[j, j]) if sound else 1.0
            along = np.where(used, v[:, j] / v[j, j], 0.0) if sound else np.zeros(p)
            # The coefficient as a sum of those of the centred and scaled columns.
            c = np.where(used, -m / s, 0.0) if j == 0 else np.zeros(p)
            c[j] = 1.0 if j == 0 else 1.0 / s[j]
            for side in (-1, 1):
                start = b + along * side * reach
                g = start * s
                g[0] = start[0] + float(start[1:] @ m[1:])
                out.append({**{k: r[k] for k in by}, "fit": r["model"], "model": f"{r['model']}|{j}|{side}", "j": int(j), "side": side, "it": 0, "b": list(g), "last_b": None, "c": list(c),
                            "used": list(used.astype(float)), "shift": [0.0] * p, "hat": float(b[j]), "reach": reach, "inner": 0.0, "outer": math.inf, "bound": None,
                            "target": r["deviance"] + level_z ** 2, "status": None if sound else "fit not converged"})
    return out


def _profile_step(records: Iterable[dict], p: int, rounds: int) -> list[dict]:
    """One joint step of a coefficient and the others towards the deviance of its bound.

    With the others at their best, deviance is a quadratic of the coefficient, which is solved for the target; a step that leaves what
    is known to lie on both sides of the bound halves that instead.
    """
    out = []
    for r in records:
        side, b, c = r["side"], np.array(r["b"], float), np.array(r["c"], float)
        i = np.flatnonzero(np.array(r["used"], float) > 0)
        g = np.zeros((p, p))
        g[np.triu_indices(p)] = r["gram"]
        g = (g + np.triu(g, 1).T)[np.ix_(i, i)]
        score, dev, new = np.array(r["score"], float)[i], 2.0 * r["s0"], {k: v for k, v in r.items() if k not in ("n", "s0", "s1", "s2", "s3", "bad", "gram", "score")}
        new["it"] = r["it"] + 1
        over = new["it"] > rounds
        if not (math.isfinite(dev) and np.isfinite(g).all()) or np.linalg.matrix_rank(g) < len(i):  # too far out
            new.update(b=list((b + np.array(r["last_b"], float)) / 2) if r["last_b"] is not None else list(b), status="not found" if over or r["last_b"] is None else None)
            out.append(new)
            continue
        newton, towards = np.linalg.solve(g, np.column_stack([score, c[i]])).T
        bend = 1.0 / float(c[i] @ towards)
        towards, own = towards * bend, float(c[i] @ newton)
        others, still = newton - towards * own, float(score @ newton) - own * own * bend  # the others' step, and what it gains
        pull, d = own * bend, side * (float(c @ b) - r["hat"])
        root = pull * pull - bend * (dev - still - r["target"])
        step = (pull + side * math.sqrt(root)) / bend if root > 0 else own
        if abs(dev - r["target"]) < 1e-8 * max(1.0, abs(r["target"])) and still < 1e-8 and root > 0:
            new.update(status="found", bound=float(c @ b) + step)  # the last step squares what error remains
        elif over:
            new["status"] = "not found" if math.isfinite(r["outer"]) else "unbounded"
        else:
            if still < 0.1:
                inside = dev - still < r["target"]
                new["inner"], new["outer"] = max(r["inner"], d) if inside else r["inner"], r["outer"] if inside else min(r["outer"], d)
            to = d + side * float(np.clip(step, -2 * r["reach"] - abs(d), 2 * r["reach"] + abs(d)))
            if not new["inner"] <= to <= new["outer"]:
                to = (new["inner"] + new["outer"]) / 2 if math.isfinite(new["outer"]) else max(2 * d, r["reach"])
            moved = b.copy()
            moved[i] += towards * side * (to - d) + others * min(1.0, 20.0 / max(float(np.abs(others).max()), 1e-12))
            new.update(b=list(moved), last_b=list(b))
        out.append(new)
    return out


def profile_intervals(df: DataFrame, fits: Fits, level_z: float = Z975, rounds: int = 40) -> DataFrame:
    """Profile-likelihood intervals of logistic fits: all groups, models, coefficients and sides together.

    A bound is where fixing the coefficient costs ``level_z`` squared in deviance. The state of all searches is a table (coefficients,
    bracket, target, status), so their number is not limited by the driver; one pass over the rows moves all of them by one joint step.
    ``lo_status`` and ``hi_status`` say how each search ended: ``found``, ``unbounded`` (the likelihood does not fall off on that side, as where
    a coefficient separates a group), ``not found`` after ``rounds`` steps, or ``fit not converged``. Bounds that are not found are NULL.
    """
    by, p = list(fits.by), len(fits.names)
    raw = design(df, fits.y, by, fits.terms).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows, scale, _, _ = _scaled_by_group(raw, p, by)
        txt, dbl, whole, arr = T.StringType(), T.DoubleType(), T.IntegerType(), T.ArrayType(T.DoubleType())
        kinds = {"fit": txt, "model": txt, "j": whole, "side": whole, "it": whole, "inner": dbl, "outer": dbl, "bound": dbl, "target": dbl, "status": txt, "used": arr, "c": arr,
                 "last_b": arr, "b": arr, "shift": arr, "hat": dbl, "reach": dbl}
        schema = T.StructType([*[raw.schema[k] for k in by], *[T.StructField(c, k) for c, k in kinds.items()]])
        names = schema.names

        def frames(step):
            def run(batches):
                import pandas as pd

                for pdf in batches:
                    found = step(_plain_records(pdf))
                    yield pd.DataFrame({c: pd.Series([f[c] for f in found], dtype=object) for c in names})

            return run

        table = attach(fits.table.select(*by, "model", "used", "beta", "vcov", "deviance", "converged"), scale, by, "inner")
        state = materialize(table.mapInPandas(frames(lambda records: _profile_starts(records, by, p, level_z)), schema))
        ended = state.where("status IS NOT NULL")
        state = state.where("status IS NULL")
        while not state.isEmpty():
            sums = attach(_statistics(rows, state, by, p, "binomial"), state, [*by, "model"], "inner")
            moved = materialize(sums.mapInPandas(frames(lambda records: _profile_step(records, p, rounds)), schema))
            ended, state = ended.unionByName(moved.where("status IS NOT NULL")), moved.where("status IS NULL")
        term = F.element_at(F.array(*[F.lit(nm) for nm in fits.names]), F.col("j") + 1).alias("term")
        of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
        return ended.groupBy(*by, F.col("fit").alias("model"), term).agg(of(-1, "bound").alias("prof_lo"), of(1, "bound").alias("prof_hi"), of(-1, "status").alias("lo_status"), of(1, "status").alias("hi_status"))
    finally:
        raw.unpersist()


def _plain_records(pdf) -> list[dict]:
    """Rows with None for what is missing."""
    out = pdf.to_dict("records")
    for r in out:
        for c, v in r.items():
            if isinstance(v, float) and math.isnan(v) and c in ("bound", "status", "last_b"):
                r[c] = None
    return out

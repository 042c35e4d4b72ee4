import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from anchorframe.catalog.base import Tables
from anchorframe.catalog.models import signal_rows
from anchorframe.operators import glm, glmm
from anchorframe.operators.diagnostics import binned_residuals, influential, ks_distance, predict_grid, quantile_residuals, row_diagnostics
from anchorframe.operators.distributions import odds_map_table
from anchorframe.operators.glm import (
    average_models, coef_table, crossed, fit_candidates, fit_gamma_identity, fit_logistic, fit_table, interaction_gate,
    p_value, profile_intervals, selection_table, standardized_effects)
from anchorframe.operators.glmm import fit_random_intercept
from anchorframe.plans.regional import regional_models
from conftest import SF_DIR


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    n = 3000
    g = np.where(rng.random(n) < 0.6, "big", "small")
    a, b = rng.normal(2000, 10, n), rng.normal(0, 1, n)
    eta = 0.05 * (a - 2000) - 0.8 * b + 0.3 * (g == "big")
    y = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(int)
    size = rng.gamma(20, (3 + 0.4 * (b - b.min())) / 20)
    return spark.createDataFrame(pd.DataFrame(dict(id=range(n), g=g, a=a, b=b, y=y, size=size, copy=a * 2 + 1))).cache()


def _reference(df, y, cols, family, link):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    d = VectorAssembler(inputCols=cols, outputCol="v").transform(df)
    return GeneralizedLinearRegression(family=family, link=link, featuresCol="v", labelCol=y, tol=1e-12, maxIter=60).fit(d)


def test_logistic_equals_the_library_fit(data):
    d = data.withColumn("ab", F.col("a") * F.col("b"))
    fits = fit_logistic(data, "y", ["g"], crossed("a", "b"))
    got = {(r.g, r.term): r for r in coef_table(fits).collect()}
    table = {r.g: r for r in fit_table(fits).collect()}
    for g in ("big", "small"):
        m = _reference(d.filter(F.col("g") == g), "y", ["a", "b", "ab"], "binomial", "logit")
        want = dict(zip(["a", "b", "a:b", "(Intercept)"], zip([*m.coefficients, m.intercept], m.summary.coefficientStandardErrors, m.summary.pValues)))
        for term, (est, se, p) in want.items():
            r = got[(g, term)]
            assert r.estimate == pytest.approx(est, rel=1e-4) and r.se == pytest.approx(se, rel=1e-4), (g, term)
            assert r.p_value == pytest.approx(p, rel=1e-3, abs=1e-12)
        assert -2 * table[g].loglik == pytest.approx(m.summary.deviance, rel=1e-8) and table[g].converged
        n = table[g].n
        assert table[g].aicc == pytest.approx(m.summary.aic + 2 * 4 * 5 / (n - 5), rel=1e-8)


def test_gamma_equals_the_library_fit(data):
    fits = fit_gamma_identity(data, "size", [], ["b"])
    m = _reference(data, "size", ["b"], "gamma", "identity")
    got = {r.term: r for r in coef_table(fits).collect()}
    assert got["b"].estimate == pytest.approx(m.coefficients[0], rel=1e-6)
    assert got["(Intercept)"].se == pytest.approx(m.summary.coefficientStandardErrors[1], rel=1e-6)
    f = fit_table(fits).first()
    assert f.deviance == pytest.approx(m.summary.deviance, rel=1e-8) and f.k == 3
    assert -2 * f.loglik + 2 * f.k == pytest.approx(m.summary.aic, rel=1e-6)


def test_intercept_only_and_binary_predictor(spark, data):
    f = fit_logistic(data, "y", [], [])
    p = data.agg(F.avg("y")).first()[0]
    assert coef_table(f).first().estimate == pytest.approx(math.log(p / (1 - p)), rel=1e-9)
    counts = [(0, 0, 30), (0, 1, 10), (1, 0, 5), (1, 1, 20)]
    d = spark.createDataFrame([(x, y) for x, y, n in counts for _ in range(n)], "x int, y int")
    r = coef_table(fit_logistic(d, "y", [], ["x"])).filter("term = 'x'").first()
    assert r.odds_ratio == pytest.approx(30 * 20 / (10 * 5), rel=1e-9)
    assert r.se == pytest.approx(math.sqrt(1 / 30 + 1 / 10 + 1 / 5 + 1 / 20), rel=1e-9)


def test_separation_is_reported(spark):
    d = spark.createDataFrame([("sep", float(i), int(i >= 10)) for i in range(20)] + [("ok", float(i), int(i % 3 == 0)) for i in range(20)], "g string, x double, y int")
    got = {r.g: r.converged for r in fit_table(fit_logistic(d, "y", ["g"], ["x"])).collect()}
    assert got == {"sep": False, "ok": True}


def test_aliased_column_is_left_out(data):
    r = {x.term: x for x in coef_table(fit_logistic(data, "y", [], ["a", "copy", "b"])).collect()}
    plain = {x.term: x for x in coef_table(fit_logistic(data, "y", [], ["a", "b"])).collect()}
    assert "copy" not in r and r["b"].estimate == pytest.approx(plain["b"].estimate, rel=1e-8)


def test_many_groups_are_solved_in_tasks(data, monkeypatch):
    models = {"a": ["a"], "ab": ["a", "b"]}
    key = ["g", "model", "term"]
    want = {tuple(r[k] for k in key): r.estimate for r in coef_table(fit_candidates(data, "y", ["g"], models)).collect()}
    monkeypatch.setattr(glm, "DRIVER_SYSTEMS", 1)
    got = {tuple(r[k] for k in key): r.estimate for r in coef_table(fit_candidates(data, "y", ["g"], models)).collect()}
    assert got == pytest.approx(want, rel=1e-9)


def test_partitioning_does_not_matter(data):
    one, many = (sorted(tuple(r) for r in coef_table(fit_logistic(data.repartition(k), "y", ["g"], ["b"])).select("g", "term_pos", "estimate").collect()) for k in (1, 37))
    assert [x[:2] for x in one] == [x[:2] for x in many] and [x[2] for x in one] == pytest.approx([x[2] for x in many], rel=1e-10)


def test_selection_and_average(data):
    fits = fit_candidates(data, "y", ["g"], {"0": [], "a": ["a"], "b": ["b"], "ab": ["a", "b"]})
    sel = selection_table(fits, None).toPandas()
    for _, s in sel.groupby("g"):
        assert s.delta_aicc.min() == 0 and s.weight.sum() == pytest.approx(1, abs=0.003)
        assert s.loc[s.delta_aicc.idxmin(), "model"] == "ab"
    assert set(selection_table(fits).select("delta_aicc").toPandas().delta_aicc <= 2) == {True}
    avg = {(r.g, r.term): r for r in average_models(fits).collect()}
    full = {(r.g, r.term): r for r in coef_table(fits).filter("model = 'ab'").collect()}
    assert avg[("big", "b")].estimate == pytest.approx(full[("big", "b")].estimate, rel=1e-2)


def test_interaction_gate_bounds(spark):
    c = spark.createDataFrame([("m1", "a", 0.9), ("m1", "a:b", 0.049), ("m2", "a:b", 0.05), ("m3", "a", 0.9)], "model string, term string, p_value double")
    assert {r.model: r.accepted for r in interaction_gate(c, []).collect()} == {"m1": True, "m2": False, "m3": True}


def test_profile_interval_costs_the_right_deviance(data):
    d = data.filter("g = 'small' and id < 400")
    fits = fit_logistic(d, "y", ["g"], ["b"])
    wald = {r.term: r for r in coef_table(fits).collect()}
    prof = {r.term: r for r in profile_intervals(d, fits).collect()}
    pdf = d.toPandas()
    base = fit_table(fits).first().deviance

    def cost(slope):  # best intercept at a fixed slope
        b0 = 0.0
        for _ in range(50):
            mu = 1 / (1 + np.exp(-(b0 + slope * pdf.b)))
            b0 += (pdf.y - mu).sum() / (mu * (1 - mu)).sum()
        mu = 1 / (1 + np.exp(-(b0 + slope * pdf.b)))
        return -2 * np.where(pdf.y == 1, np.log(mu), np.log(1 - mu)).sum() - base

    for side in ("prof_lo", "prof_hi"):
        assert cost(prof["b"][side]) == pytest.approx(3.841459, abs=1e-4)
    tidy = {r.term: r for r in regional_models(d, "y", "g", ["b"], min_cases=1, intervals="profile").collect()}
    assert tidy["b"].ci_hi == pytest.approx(prof["b"].prof_hi, rel=1e-6) and tidy["b"].or_hi == pytest.approx(math.exp(prof["b"].prof_hi), rel=1e-6)
    assert prof["(Intercept)"].prof_lo == pytest.approx(wald["(Intercept)"].ci_lo, abs=0.02)


def test_diagnostics_identities(data):
    fits = fit_logistic(data, "y", ["g"], ["a", "b"])
    d = row_diagnostics(data, fits, ["id"]).toPandas()
    for _, x in d.groupby("g"):
        assert x.leverage.sum() == pytest.approx(3, rel=1e-6)
        assert x.resid_response.sum() == pytest.approx(0, abs=1e-5)
    diag = row_diagnostics(data, fits, ["id"])
    i = {r.g: r for r in influential(diag, ["g"], "id").collect()}
    assert i["big"].max_cooks_d == pytest.approx(d[d.g == "big"].cooks_d.max(), rel=1e-9)
    bins = binned_residuals(diag, ["g"], ["id"]).toPandas()
    for g, x in bins.groupby("g"):
        n = (d.g == g).sum()
        assert x.n.sum() == n and len(x) == int(math.sqrt(n)) and x.n.max() - x.n.min() <= 1
    ks = {r.g: (r.ks, r.n) for r in ks_distance(quantile_residuals(diag, 5, ["id"]), ["g"], ["id"]).collect()}
    assert all(k < 1.7 / math.sqrt(n) for k, n in ks.values())


def test_prediction_and_standardized(data):
    fits = fit_logistic(data, "y", [], ["a", "b"])
    p = predict_grid(data, fits, "b", [-1.0, 0.0, 1.0]).toPandas().sort_values("b")
    assert list(p.predicted) == sorted(p.predicted, reverse=True) and (p.lo < p.predicted).all() and (p.predicted < p.hi).all()
    s = {r.term: r for r in standardized_effects(data, "y", [], ["a", "b"]).collect()}
    raw = {r.term: r for r in coef_table(fits).collect()}
    sd = data.agg(F.stddev_samp("b")).first()[0]
    assert math.log(s["b"].odds_ratio) == pytest.approx(raw["b"].estimate * sd, rel=1e-6)
    assert s["b"].p_value == pytest.approx(raw["b"].p_value, rel=1e-9)


def test_p_value_expression(spark):
    zs = [0.0, 0.5, 1.96, 5.0]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(p_value(F.col("z"))).collect()]
    assert got == pytest.approx([math.erfc(z / math.sqrt(2)) for z in zs], rel=2e-7)


def test_regional_models_with_an_override(data):
    out = regional_models(data, "y", "g", ["a", "b"], {"small": crossed("a", "b")}, min_cases=50)
    terms = {(r.g, r.term) for r in out.collect()}
    assert ("small", "a:b") in terms and ("big", "a:b") not in terms and len(terms) == 7
    assert regional_models(data, "y", "g", ["a"], min_cases=800).select("g").distinct().count() == 1


def test_odds_map(spark):
    c = spark.createDataFrame([("r1", "(Intercept)", 1.0, 0.0), ("r1", "vpd", 4.0, 0.01), ("r1", "spei", 0.3, 0.001), ("r1", "vs", 1.2, 0.2),
                               ("r2", "vpd", 99.0, 0.01), ("r2", "year", 0.9, 0.01), ("r2", "vpd:year", 1.1, 0.01)], "g string, term string, odds_ratio double, p_value double")
    got = {(r.g, r.term): r.bins for r in odds_map_table(c, spark.createDataFrame([("r1",), ("r2",), ("r3",)], "g string"), "g").collect()}
    assert got[("r1", "vpd")] == "3 - 4" and got[("r1", "spei")] == "0.2 - 0.3" and got[("r1", "vs")] == "Insignificant"
    assert got[("r2", "vpd")] == got[("r2", "year")] == "Involved in Interaction"
    assert got[("r3", "pdsi")] == "Excluded" and sum(g == "r3" for g, _ in got) == 6


def test_random_intercepts_recover_the_truth(spark):
    rng = np.random.default_rng(3)
    n, q1, q2 = 8000, 15, 8
    g, yr, x = rng.integers(0, q1, n), rng.integers(0, q2, n), rng.normal(0, 1, n)
    u, v = rng.normal(0, 0.9, q1), rng.normal(0, 0.5, q2)
    y = (rng.random(n) < 1 / (1 + np.exp(-(-0.4 + 0.7 * x + u[g] + v[yr])))).astype(int)
    d = spark.createDataFrame(pd.DataFrame(dict(g=[f"r{i}" for i in g], yr=yr, x=x, y=y)))
    f = fit_random_intercept(d, "y", ["x"], ["g", "yr"])
    c = {r.term: r for r in f.coefs.collect()}
    assert abs(c["x"].estimate - 0.7) < 4 * c["x"].se and 0.01 < c["x"].se < 0.06
    fit = f.fit.first()
    assert fit.converged and abs(fit.sigma_g - u.std()) < 0.3 and abs(fit.sigma_yr - v.std()) < 0.25
    modes = {(r.factor, r.level): r.mode for r in f.random.collect()}
    assert np.corrcoef([modes[("g", f"r{i}")] for i in range(q1)], u)[0, 1] > 0.97


def test_no_group_variance_ends_near_the_plain_fit(spark, data):
    d = data.withColumn("level", F.col("id") % 10)
    f = fit_random_intercept(d, "y", ["b"], ["level"], errors=False)
    plain = fit_table(fit_logistic(data, "y", [], ["b"])).first()
    assert f.fit.first().loglik == pytest.approx(plain.loglik, abs=2.0) and f.fit.first().sigma_level < 0.3


def test_groups_far_apart_keep_their_slopes(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=800)
    y = (rng.random(800) < 1 / (1 + np.exp(-0.8 * x))).astype(int)
    d = pd.concat([pd.DataFrame({"g": "near", "x": x, "y": y}), pd.DataFrame({"g": "far", "x": x + 1e5, "y": y})])
    fits = glm.fit_logistic(spark.createDataFrame(d), "y", ["g"], ["x"])
    got = {r.g: (r.beta[1], r.converged) for r in fits.table.collect()}
    assert got["near"][1] and got["far"][1] and got["far"][0] == pytest.approx(got["near"][0], rel=1e-5) and got["near"][0] > 0.4


def test_a_separated_group_has_no_profile_bound(spark):
    d = pd.DataFrame({"g": ["a"] * 40, "x": np.linspace(-1, 1, 40)})
    d["y"] = (d.x > 0).astype(int)
    rows = spark.createDataFrame(d)
    found = glm.profile_intervals(rows, glm.fit_logistic(rows, "y", ["g"], ["x"])).filter("term = 'x'").first()
    assert found.prof_hi is None
    assert found.lo_status == found.hi_status == "fit not converged"


# ---- mixed models

@pytest.mark.parametrize("levels", [[7], [9, 4], [3, 8]])
def test_block_elimination_equals_the_dense_inverse(levels, monkeypatch):
    monkeypatch.setattr(glmm, "_CHUNK", 8)  # several blocks
    rng = np.random.default_rng(sum(levels))
    codes = np.unique(np.stack([rng.integers(0, n, 20) for n in levels], 1), axis=0)
    cells = glmm._Cells(codes, levels)
    w, shrink = rng.random(len(codes)) * 5, np.repeat(rng.random(len(levels)) + 0.3, levels)
    dense = np.diag(shrink)
    for row, x in zip(cells.idx, w):
        for i in row:
            for j in row:
                dense[i, j] += x
    h, inverse = glmm._Precision(cells, w, shrink), np.linalg.inv(dense)
    right = rng.normal(size=(cells.q, 3))
    assert h.logdet == pytest.approx(np.linalg.slogdet(dense)[1]) and h.solve(right) == pytest.approx(inverse @ right)
    diagonal, lever = h.variances()
    assert diagonal == pytest.approx(np.diag(inverse)) and lever == pytest.approx([inverse[np.ix_(r, r)].sum() for r in cells.idx])


def _dense_laplace(y, x, groups, sizes, theta):
    """The Laplace log-likelihood by plain Newton steps on dense matrices."""
    p = x.shape[1]
    z = np.hstack([np.eye(n)[g] for g, n in zip(groups, sizes)])
    d = np.repeat(np.exp(-2 * theta[p:]), sizes)
    b = np.zeros(z.shape[1])
    for _ in range(60):
        mu = 1 / (1 + np.exp(-(x @ theta[:p] + z @ b)))
        h = (z * (mu * (1 - mu))[:, None]).T @ z + np.diag(d)
        b = b + np.linalg.solve(h, z.T @ (y - mu) - d * b)
    eta = x @ theta[:p] + z @ b
    mu = 1 / (1 + np.exp(-eta))
    h = (z * (mu * (1 - mu))[:, None]).T @ z + np.diag(d)
    return (y * eta - np.logaddexp(0, eta)).sum() - 0.5 * d @ b ** 2 + 0.5 * np.log(d).sum() - 0.5 * np.linalg.slogdet(h)[1]


@pytest.fixture(scope="module")
def crossed_rows():
    rng = np.random.default_rng(8)
    n, sizes = 3000, (12, 5)
    g, yr, x = rng.integers(0, 12, n), rng.integers(0, 5, n), rng.normal(2, 3, n)
    eta = -0.3 + 0.25 * x + rng.normal(0, 0.8, 12)[g] + rng.normal(0, 0.6, 5)[yr]
    y = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(int)
    return pd.DataFrame(dict(g=[f"r{i:02d}" for i in g], yr=yr, x=x, y=y)), (g, yr), sizes


@pytest.mark.parametrize("factors", [["g"], ["g", "yr"]])
def test_mixed_fit_is_the_optimum_with_its_curvature(spark, crossed_rows, factors):
    d, codes, sizes = crossed_rows
    k = len(factors)
    f = fit_random_intercept(spark.createDataFrame(d), "y", ["x"], factors)
    fit, table = f.fit.first(), f.fixed.table.first()
    theta = np.array([*table.beta, *[np.log(fit[f"sigma_{c}"]) for c in factors]])
    design = np.stack([np.ones(len(d)), d.x.to_numpy()], 1)
    value = lambda t: _dense_laplace(d.y.to_numpy(), design, codes[:k], sizes[:k], t)
    assert fit.converged and fit.passes <= 30 and fit.loglik == pytest.approx(value(theta), abs=1e-6)
    eps = np.array([1e-3] * len(theta))
    steps = [np.eye(len(theta))[i] * eps[i] for i in range(len(theta))]
    grad = [(value(theta + s) - value(theta - s)) / (2 * 1e-3) for s in steps]
    assert np.abs(grad).max() < 2e-3
    hess = np.array([[(value(theta + a + b) - value(theta + a - b) - value(theta - a + b) + value(theta - a - b)) / 4e-6 for b in steps] for a in steps])
    assert np.array(table.vcov).reshape(2, 2) == pytest.approx(np.linalg.inv(-hess)[:2, :2], rel=2e-3)


def test_variances_of_intercepts_belong_to_the_estimates(spark):
    rows = signal_rows(Tables(spark, SF_DIR))
    f, d = fit_random_intercept(rows, "y", ["price", "crop"], ["nation"], errors=False), rows.select("y", "price", "crop", "nation").toPandas()
    beta, levels = f.fixed.table.first().beta, f.random.toPandas().set_index("level")
    mu = 1 / (1 + np.exp(-(beta[0] + beta[1] * d.price + beta[2] * d.crop + levels["mode"].loc[d.nation].to_numpy())))
    weight = (mu * (1 - mu)).groupby(d.nation).sum()
    assert np.abs(levels["sd"] - (weight + f.fit.first().sigma_nation ** -2) ** -0.5).max() < 3e-8


def test_mixed_models_share_their_passes_and_keep_their_own_rows(spark, crossed_rows):
    d = crossed_rows[0].copy()
    d["part"] = np.where(np.arange(len(d)) % 3 == 0, np.nan, d.x)
    rows = spark.createDataFrame(d)
    alone = glmm._fit(rows, "y", {"a": ["x"]}, ["g"], False)
    both = glmm._fit(rows, "y", {"a": ["x"], "b": ["part"], "c": []}, ["g"], False)
    assert both[0]["a"].state.value == pytest.approx(alone[0]["a"].state.value, abs=1e-7)
    assert both[0]["a"].n == 3000 and both[0]["b"].n == 2000
    apart = [glmm._fit(rows, "y", {"m": ts}, ["g"], False)[2] for ts in (["x"], ["part"], [])]
    assert both[2] == max(apart)
    table = {r.feature: r for r in glmm.compare_mixed_windows(rows, "y", {"f": ["x", "part"]}, ["g"]).collect()}
    assert table["part"].n == 2000 and table["x"].n == 3000 and min(r.delta_aicc for r in table.values()) == 0


def test_many_levels_of_one_of_two_factors(spark):
    rng = np.random.default_rng(4)
    n, q = 60_000, 20_000
    g, yr, x = np.arange(n) % q, rng.integers(0, 6, n), rng.normal(size=n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.5 * x + rng.normal(0, 1, q)[g] + rng.normal(0, 0.4, 6)[yr])))).astype(int)
    f = fit_random_intercept(spark.createDataFrame(pd.DataFrame(dict(g=g, yr=yr, x=x, y=y))), "y", ["x"], ["g", "yr"])
    fit, c = f.fit.first(), {r.term: r for r in f.coefs.collect()}
    assert fit.converged and fit.passes <= 30 and abs(c["x"].estimate - 0.5) < 0.15 and f.random.count() == q + 6


def test_mixed_rows_of_an_unseen_level_and_their_residuals(spark, crossed_rows):
    rows = spark.createDataFrame(crossed_rows[0])
    f = fit_random_intercept(rows, "y", ["x"], ["g"], errors=False)
    more = spark.createDataFrame([("new", 0, 1.0, 1), (None, 0, 1.0, 1)], "g string, yr long, x double, y long")
    got = glmm.mixed_diagnostics(more, f).collect()
    assert len(got) == 1 and got[0].eta == got[0].eta_fixed
    u = quantile_residuals(glmm.mixed_diagnostics(rows.withColumn("id", F.monotonically_increasing_id()), f, ["id"]), 3, ["id"]).toPandas().qres
    assert abs(u.mean() - 0.5) < 0.03 and np.abs(np.sort(u) - np.arange(len(u)) / len(u)).max() < 0.04


def test_a_mixed_fit_without_rows_says_so(spark, crossed_rows):
    with pytest.raises(ValueError):
        fit_random_intercept(spark.createDataFrame(crossed_rows[0]).limit(0), "y", ["x"], ["g"])


def test_profile_bounds_cost_what_they_should(spark, data):
    d = data.select("id", (F.col("a") - 2000).alias("a"), "b", "y", F.when(F.col("id") % 3 == 0, "u").otherwise("v").alias("g"))
    fits = glm.fit_logistic(d, "y", ["g"], ["a", "b"])
    found = glm.profile_intervals(d, fits).collect()
    assert {r.lo_status for r in found} | {r.hi_status for r in found} == {"found"}
    rows = d.toPandas()
    hat = {r.g: (r.beta, r.deviance) for r in fits.table.collect()}
    for r in found:
        own = rows[rows.g == r.g]
        x, j = np.stack([np.ones(len(own)), own.a, own.b], 1), ["(Intercept)", "a", "b"].index(r.term)
        o = [i for i in range(3) if i != j]
        for bound in (r.prof_lo, r.prof_hi):
            b = np.array(hat[r.g][0], float)
            b[j] = bound
            for _ in range(60):
                mu = 1 / (1 + np.exp(-(x @ b)))
                b[o] += np.linalg.solve((x[:, o] * (mu * (1 - mu))[:, None]).T @ x[:, o], x[:, o].T @ (own.y - mu))
            eta = x @ b
            assert 2 * (np.logaddexp(0, eta) - own.y * eta).sum() - hat[r.g][1] == pytest.approx(glm.Z975 ** 2, abs=1e-6)

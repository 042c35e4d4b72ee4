"""Regression, model selection and diagnostics.

The check SQL runs Newton steps in a recursive query for models with up to two slopes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorframe.catalog.base import query, rounded, rsql
from anchorframe.catalog.proxies import COVER, order_cover
from anchorframe.catalog.sampling import SEED, u_sql
from anchorframe.catalog.sweep import logistic_sql, sweep_sql
from anchorframe.functions.hashing import uniform
from anchorframe.operators.diagnostics import (
    binned_residuals, influential, ks_distance, odds_ratio_report, predict_grid, predict_interaction, quantile_residuals,
    row_diagnostics)
from anchorframe.operators.distributions import odds_map_table
from anchorframe.operators.glm import (
    average_models, coef_table, compare_windows, crossed, fit_candidates, fit_gamma_identity, fit_logistic, fit_table,
    interaction_gate, profile_intervals, selection_table, standardized_average, standardized_effects, vif)
from anchorframe.operators.joins import anti_join
from anchorframe.operators.tables import keep_groups
from anchorframe.session import materialize


def signal_rows(t):
    """Orders with a 0/1 outcome drawn from a known model of price, crop share, nation and year."""
    d = order_cover(t)
    number = F.regexp_extract("nation", r"(\d+)$", 1).cast("double")
    eta = -0.5 + 0.4 * (F.col("o_totalprice") / 100000) - 1.5 * F.col("crop") + 0.05 * (number - 12) + 0.1 * (F.year("o_orderdate") - 1998)
    hit = uniform(SEED, "outcome", "o_orderkey") < 1 / (1 + F.exp(-eta))
    return d.select("o_orderkey", "nation", "region", "crop", "hay", (F.col("o_totalprice") / 100000).alias("price"),
                    (F.dayofyear("o_orderdate") / 100).alias("season"), F.year("o_orderdate").alias("year"), hit.cast("int").alias("y"))


SIGNAL = COVER + f""", sig AS (SELECT o_orderkey, nation, region, crop, hay, o_totalprice / 100000 AS price, dayofyear(o_orderdate) / 100.0::DOUBLE AS season,
 year(o_orderdate)::INTEGER AS year, ({u_sql('outcome', 'o_orderkey')} < 1 / (1 + exp(-(-0.5::DOUBLE + 0.4::DOUBLE * (o_totalprice / 100000) - 1.5::DOUBLE * crop
 + 0.05::DOUBLE * (replace(nation, 'NATION_', '')::DOUBLE - 12) + 0.1::DOUBLE * (year(o_orderdate) - 1998)))))::INTEGER AS y FROM cover)"""


def newton_sql(name: str, src: str, by: str, y: str, x1: str | None, x2: str | None, family: str = "binomial") -> str:
    """CTEs fitting ``y ~ x1 + x2`` per group; ``name`` holds coefficients, covariance and likelihood."""
    d = f"{name}_d AS MATERIALIZED (SELECT {by}, ({y})::DOUBLE AS y, {x1 or '0'}::DOUBLE AS x1, {x2 or '0'}::DOUBLE AS x2 FROM {src})"
    if family == "binomial":
        mu, w, r, start = "1 / (1 + exp(-eta))", "mu * (1 - mu)", "y - mu", "0.0::DOUBLE"
    else:
        mu, w, r, start = "eta", "1 / (mu * mu)", "(y - mu) / (mu * mu)", "avg(y)"
    sums = """count(*) AS n, sum(w) AS a, sum(w * x1) AS b, sum(w * x2) AS c, sum(w * x1 * x1) AS d, sum(w * x1 * x2) AS e, sum(w * x2 * x2) AS f,
   sum(r) AS g0, sum(r * x1) AS g1, sum(r * x2) AS g2, sum(ln_y) AS s0, sum(y / mu) AS s1, sum(ln_mu) AS s2, sum(pow(y / mu - 1, 2)) AS s3"""
    ll = "y * eta - greatest(eta, 0) - ln(1 + exp(-abs(eta)))" if family == "binomial" else "ln(y)"
    rows = f"""SELECT *, {w} AS w, {r} AS r, {ll} AS ln_y, ln(mu) AS ln_mu FROM (SELECT *, {mu} AS mu FROM
   (SELECT i.*, dd.y, dd.x1, dd.x2, b0 + b1 * x1 + b2 * x2 AS eta FROM {{it}} i JOIN {name}_d dd USING ({by})))"""
    if x1 is None:
        det, inv = "a", {"00": "1 / a", "01": "0", "02": "0", "11": "0", "12": "0", "22": "0"}
    elif x2 is None:
        det = "(a * d - b * b)"
        inv = {"00": f"d / {det}", "01": f"-b / {det}", "11": f"a / {det}", "02": "0", "12": "0", "22": "0"}
    else:
        det = "(a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d))"
        inv = {"00": f"(d * f - e * e) / {det}", "01": f"(c * e - b * f) / {det}", "02": f"(b * e - c * d) / {det}",
               "11": f"(a * f - c * c) / {det}", "12": f"(b * c - a * e) / {det}", "22": f"(a * d - b * b) / {det}"}
    step = [" + ".join(f"({inv[''.join(sorted((i, j)))]}) * g{j}" for j in "012") for i in "012"]
    vs = ", ".join(f"({v})::DOUBLE AS v{k}" for k, v in inv.items())
    return f"""{d},
 {name}_it AS (SELECT 0 AS step, {by}, {start} AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM {name}_d GROUP BY {by}
  UNION ALL SELECT step + 1, {by}, b0 + {step[0]}, b1 + {step[1]}, b2 + {step[2]} FROM
  (SELECT step, {by}, b0, b1, b2, {sums} FROM ({rows.format(it=name + '_it')}) WHERE step < 9 GROUP BY step, {by}, b0, b1, b2)),
 {name} AS (SELECT {by}, n, b0, b1, b2, {vs}, s0, s1, s2, s3 FROM
  (SELECT {by}, b0, b1, b2, {sums} FROM ({rows.format(it=f'(SELECT * FROM {name}_it WHERE step = 9)')}) GROUP BY {by}, b0, b1, b2))"""


def _terms_sql(name: str, by: str, terms: list[str], cols: str) -> str:
    parts = []
    for i, t in enumerate(["(Intercept)", *terms]):
        parts.append(f"SELECT {by}, {i} AS term_pos, '{t}' AS term, b{i} AS est, sqrt(v{i}{i}) AS se FROM {name}")
    return f"SELECT {cols} FROM ({' UNION ALL '.join(parts)})"


# Coefficients of the published Chebyshev approximation of erfc.
_CS = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def p_sql(z: str) -> str:
    x = f"(abs({z}) / 1.4142135623730951::DOUBLE)"
    t = f"(1 / (1 + 0.5::DOUBLE * {x}))"
    poly = f"{_CS[-1]}::DOUBLE"
    for c in reversed(_CS[:-1]):
        poly = f"({c}::DOUBLE + {t} * {poly})"
    return f"({t} * exp(-{x} * {x} + {poly}))"


_FIT2 = f"WITH RECURSIVE {SIGNAL}, {newton_sql('m', 'sig', 'region', 'y', 'price', 'crop')}"
_COEF_COLS = (f"region, term_pos, term, {rsql('est')} AS estimate, {rsql('se')} AS se, {rsql('est / se')} AS z, {rsql('exp(est)')} AS odds_ratio, "
              f"{rsql('exp(est - 1.959963984540054::DOUBLE * se)')} AS or_lo, {rsql('exp(est + 1.959963984540054::DOUBLE * se)')} AS or_hi")


def signal_table(t):
    """Written once, for queries that read it after the fit as well."""
    return materialize(signal_rows(t))


def _fit2(t):
    d = signal_table(t)
    return d, fit_logistic(d, "y", ["region"], ["price", "crop"])


@query("logistic_by_region", f"{_FIT2} {_terms_sql('m', 'region', ['price', 'crop'], f'''region, term, {rsql('est')} AS estimate''')}")
def logistic(t):
    return rounded(coef_table(_fit2(t)[1]).select("region", "term", "estimate"))


@query("coef_table", f"{_FIT2} {_terms_sql('m', 'region', ['price', 'crop'], _COEF_COLS)}")
def coefs(t):
    c = coef_table(_fit2(t)[1])
    return rounded(c.select("region", "term_pos", "term", "estimate", "se", "z", "odds_ratio", "or_lo", "or_hi"))


@query("coef_p_values", f"{_FIT2} {_terms_sql('m', 'region', ['price', 'crop'], 'region, term, round(' + p_sql('est / se') + ', 5) AS p_value')}")
def p_values(t):
    return coef_table(_fit2(t)[1]).select("region", "term", F.round("p_value", 5).alias("p_value"))


@query("logistic_interaction", f"""WITH RECURSIVE {SIGNAL}, {newton_sql('m', 'sig', 'region', 'y', 'price', 'price * crop')}
 {_terms_sql('m', 'region', ['price', 'price:crop'], f'''region, term, {rsql('est')} AS estimate, {rsql('se')} AS se''')}""")
def logistic_inter(t):
    return rounded(coef_table(fit_logistic(signal_rows(t), "y", ["region"], ["price", ("price", "crop")])).select("region", "term", "estimate", "se"))


_N2 = f"WITH RECURSIVE {SIGNAL}, sig1 AS (SELECT *, 1 AS one FROM sig), {newton_sql('m', 'sig1', 'one', 'y', 'price', 'crop')}"


@query("logistic_overall", f"{_N2} {_terms_sql('m', 'one', ['price', 'crop'], f'''term, {rsql('est')} AS estimate, {rsql('se')} AS se''')}")
def logistic_all(t):
    return rounded(coef_table(fit_logistic(signal_rows(t), "y", [], ["price", "crop"])).select("term", "estimate", "se"))


_FULL = ["price", "crop", "price:crop", "hay", "season", "year"]


def _full_sql() -> str:
    """The fit is on years since 1995; its intercept goes back to year 0. Variance inflation is that of the slopes' correlations."""
    fit = logistic_sql("m", "sig", "region", "y", ["price", "crop", "price * crop", "hay", "season", "year - 1995"])
    p = len(_FULL) + 1
    slopes = ", ".join(f"v_{i}_{j} AS c_{i - 1}_{j - 1}" for i in range(1, p) for j in range(i, p))
    swept = sweep_sql(f"SELECT m.*, {slopes} FROM m", "c", p - 1)
    rows = [f"SELECT region, 0 AS term_pos, '(Intercept)' AS term, b0 - 1995 * b{p - 1} AS est, sqrt(v_0_0 - 2 * 1995 * v_0_{p - 1} + 1995.0::DOUBLE * 1995 * v_{p - 1}_{p - 1}) AS se, NULL::DOUBLE AS vif FROM f"]
    rows += [f"SELECT region, {i}, '{t}', b{i}, sqrt(v_{i}_{i}), -c_{i - 1}_{i - 1} * v_{i}_{i} FROM f" for i, t in enumerate(_FULL, 1)]
    return f"""WITH RECURSIVE {SIGNAL}, {fit}, f AS ({swept}), c AS ({' UNION ALL '.join(rows)})
 SELECT region, term_pos, term, {rsql('est', 5)} AS estimate, {rsql('se', 5)} AS se, {rsql('est / se', 5)} AS z, round({p_sql('est / se')}, 5) AS p_value, {rsql('vif', 5)} AS vif FROM c"""


@query("logistic_full", _full_sql())
def logistic_full(t):
    terms = [*crossed("price", "crop"), "hay", "season", "year"]
    c = coef_table(fit_logistic(signal_rows(t), "y", ["region"], terms)).withColumn("vif", F.nanvl("vif", F.lit(None)))
    c = c.select("region", "term_pos", "term", "estimate", "se", "z", F.col("p_value").alias("p"), "vif")
    return rounded(c, 5).drop("p").join(c.select("region", "term", F.round("p", 5).alias("p_value")), ["region", "term"])


@query("gamma_identity", f"""WITH RECURSIVE {SIGNAL}, {newton_sql('m', '(SELECT * FROM sig)', 'region', 'log10(price * 100000)', 'crop', None, 'gamma')}
 SELECT region, {rsql('b0')} AS b0, {rsql('b1')} AS b1, {rsql('sqrt(v11 * s3 / (n - 2))')} AS se1, {rsql('2 * (s1 - n - s0 + s2)')} AS deviance FROM m""")
def gamma(t):
    d = signal_rows(t).withColumn("log_size", F.log10(F.col("price") * 100000))
    f = fit_gamma_identity(d, "log_size", ["region"], ["crop"])
    return rounded(f.table.select("region", F.col("beta")[0].alias("b0"), F.col("beta")[1].alias("b1"),
                                  F.sqrt(F.col("vcov")[3]).alias("se1"), "deviance"))


_MODELS = {"null": [], "price": ["price"], "crop": ["crop"], "hay": ["hay"], "both": ["price", "crop"]}
_CAND = f"WITH RECURSIVE {SIGNAL}, " + ", ".join(
    newton_sql(f"m_{k}", "sig", "region", "y", *([*v, None, None][:2])) for k, v in _MODELS.items()) + ", fits AS (" + " UNION ALL ".join(
    f"SELECT region, '{k}' AS model, '{' + '.join(v) or '1'}' AS terms, n, {len(v) + 1} AS k, s0 AS ll, b0, b1, b2, v00, v11, v22 FROM m_{k}"
    for k, v in _MODELS.items()) + "), cand AS (SELECT *, -2 * ll + 2 * k + 2.0::DOUBLE * k * (k + 1) / (n - k - 1) AS aicc FROM fits)"


def _cands(t):
    d = signal_rows(t)
    return d, fit_candidates(d, "y", ["region"], _MODELS)


@query("candidate_fits", f"{_CAND} SELECT region, model, terms, n, k::INTEGER AS k, {rsql('ll')} AS loglik, {rsql('aicc')} AS aicc FROM cand")
def cands(t):
    return rounded(fit_table(_cands(t)[1]).select("region", "model", "terms", "n", "k", "loglik", "aicc"))


_SEL = f"""{_CAND}, sel AS (SELECT *, aicc - min(aicc) OVER (PARTITION BY region) AS delta FROM cand), wt AS (SELECT *, exp(-0.5::DOUBLE * delta) AS rel,
 exp(-0.5::DOUBLE * delta) / sum(exp(-0.5::DOUBLE * delta)) OVER (PARTITION BY region) AS w FROM sel)"""


@query("selection_table", f"{_SEL} SELECT region, model, {rsql('delta')} AS delta_aicc, {rsql('rel')} AS rel_likelihood, round(w, 3) AS weight FROM wt WHERE delta <= 2")
def selection(t):
    s = selection_table(_cands(t)[1])
    return rounded(s.select("region", "model", "delta_aicc", "rel_likelihood", "weight"))


@query("compare_windows", f"""{_SEL.replace('aicc - min(aicc) OVER', 'aicc - min(CASE WHEN model IN (' + "'price', 'crop', 'hay'" + ') THEN aicc END) OVER')}
 SELECT region, model AS feature, {rsql('aicc')} AS aicc, {rsql('delta')} AS delta_aicc FROM wt WHERE model IN ('price', 'crop', 'hay')""")
def windows(t):
    c = compare_windows(signal_rows(t), "y", ["region"], ["price", "crop", "hay"])
    return rounded(c.select("region", F.col("model").alias("feature"), "aicc", "delta_aicc"))


def _avg_sql() -> str:
    parts = []
    for i, (term, pick) in enumerate((("(Intercept)", {m: 0 for m in _MODELS}), ("price", {"price": 1, "both": 1}),
                                      ("crop", {"crop": 1, "both": 2}), ("hay", {"hay": 1}))):
        b = "CASE model " + " ".join(f"WHEN '{m}' THEN b{k}" for m, k in pick.items()) + " ELSE 0 END"
        v = "CASE model " + " ".join(f"WHEN '{m}' THEN v{k}{k}" for m, k in pick.items()) + " ELSE 0 END"
        parts.append(f"SELECT region, '{term}' AS term, w, {b} AS b, {v} AS v FROM wt")
    return " UNION ALL ".join(parts)


@query("average_models", f"""{_SEL}, long AS ({_avg_sql()}), mean AS (SELECT region, term, sum(w * b) AS est FROM long GROUP BY 1, 2)
 SELECT region, term, {rsql('est')} AS estimate, {rsql('sqrt(sum(w * (v + pow(b - est, 2))))')} AS se FROM long JOIN mean USING (region, term) GROUP BY region, term, est""")
def averaged(t):
    return rounded(average_models(_cands(t)[1]).select("region", "term", "estimate", "se"))


@query("average_models_standardized", f"""{_SEL}, long AS ({_avg_sql()}), mean AS (SELECT region, term, sum(w * b) AS est FROM long GROUP BY 1, 2),
 sd AS (SELECT region, 'price' AS term, stddev_samp(price) AS sd FROM sig GROUP BY 1 UNION ALL SELECT region, 'crop', stddev_samp(crop) FROM sig GROUP BY 1)
 SELECT region, term, {rsql('est * sd')} AS std_estimate FROM mean JOIN sd USING (region, term)""")
def averaged_std(t):
    d, f = _cands(t)
    return rounded(standardized_average(average_models(f), d, ["region"], ["price", "crop"]).select("region", "term", "std_estimate"))


@query("vif", f"""{_FIT2} SELECT region, t.term, {rsql('1 / (1 - v12 * v12 / (v11 * v22))')} AS vif FROM m CROSS JOIN (VALUES ('price'), ('crop')) t(term)""")
def vifs(t):
    return rounded(vif(_fit2(t)[1]).select("region", "term", "vif"))


@query("interaction_gate", f"""WITH RECURSIVE {SIGNAL}, {newton_sql('m', 'sig', 'nation', 'y', 'price', 'price * hay')}
 SELECT nation, round({p_sql('b2 / sqrt(v22)')}, 5) AS max_interaction_p, {p_sql('b2 / sqrt(v22)')} < 0.05::DOUBLE AS accepted FROM m""")
def gate(t):
    c = coef_table(fit_logistic(signal_rows(t), "y", ["nation"], ["price", ("price", "hay")]))
    g = interaction_gate(c, ["nation"])
    return g.select("nation", F.round("max_interaction_p", 5).alias("max_interaction_p"), "accepted")


_REPORT = _terms_sql("m", "region", ["price", "crop"], f"""region, term_pos, CASE term WHEN 'crop' THEN 'Crop share' ELSE term END AS label, round_even(exp(est), 3) AS odds_ratio,
 round_even(exp(est - 1.959963984540054::DOUBLE * se), 3) AS or_lo, round_even(exp(est + 1.959963984540054::DOUBLE * se), 3) AS or_hi, {p_sql('est / se')} AS p""")


@query("odds_ratio_report", f"""{_FIT2} SELECT * EXCLUDE (p), CASE WHEN p < 0.001::DOUBLE THEN '<0.001' WHEN p < 0.01::DOUBLE THEN '<0.01' WHEN p < 0.05::DOUBLE THEN '<0.05' ELSE printf('%.3f', p) END AS p_band,
 printf('%.3f (%.3f, %.3f)', odds_ratio, or_lo, or_hi) AS text FROM ({_REPORT}) WHERE term_pos > 0""")
def report(t):
    return odds_ratio_report(coef_table(_fit2(t)[1]), ["region"], {"crop": "Crop share"})


_DIAG = f"""{_FIT2}, dg AS (SELECT *, mu * (1 - mu) AS w, mu * (1 - mu) * (v00 + 2 * price * v01 + 2 * crop * v02 + price * price * v11 + 2 * price * crop * v12 + crop * crop * v22) AS h
 FROM (SELECT s.o_orderkey, s.region, y, price, crop, m.* EXCLUDE (region), 1 / (1 + exp(-(b0 + b1 * price + b2 * crop))) AS mu FROM sig s JOIN m USING (region))),
 dd AS (SELECT *, pow((y - mu) / sqrt(w) / (1 - h), 2) * h / 3 AS cooks FROM dg)"""


def _diag(t):
    d, f = _fit2(t)
    return row_diagnostics(d, f, ["o_orderkey"])


def _diag_table(t):
    """Written once: ranks read it three times."""
    return materialize(_diag(t).select("o_orderkey", "region", "model", "y", "fitted", "resid_response"))


@query("row_diagnostics", f"""{_DIAG} SELECT o_orderkey, {rsql('mu')} AS fitted, {rsql('(y - mu) / sqrt(w)')} AS resid_pearson, {rsql('sign(y - mu) * sqrt(-2 * ln(CASE y WHEN 1 THEN mu ELSE 1 - mu END))')} AS resid_deviance,
 {rsql('(y - mu) / w')} AS resid_working, {rsql('h')} AS leverage, {rsql('sign(y - mu) * sqrt(-2 * ln(CASE y WHEN 1 THEN mu ELSE 1 - mu END)) / sqrt(1 - h)')} AS std_resid, {rsql('cooks * 1000')} AS cooks_d FROM dd""")
def diagnostics(t):
    d = _diag(t).withColumn("cooks_d", F.col("cooks_d") * 1000)
    return rounded(d.select("o_orderkey", "fitted", "resid_pearson", "resid_deviance", "resid_working", "leverage", "std_resid", "cooks_d"))


@query("influential", f"""{_DIAG} SELECT region, count(CASE WHEN cooks > 4.0::DOUBLE / n THEN 1 END) AS n_influential, {rsql('max(cooks) * 1000')} AS max_cooks_d, arg_max(o_orderkey, cooks) AS max_row
 FROM dd GROUP BY 1""")
def influence(t):
    i = influential(_diag(t), ["region"], "o_orderkey").drop("model")
    return rounded(i.withColumn("max_cooks_d", F.col("max_cooks_d") * 1000))


@query("refit_without_influential", f"""{_DIAG}, worst AS (SELECT region, arg_max(o_orderkey, cooks) AS k FROM dd GROUP BY 1), sig2 AS (SELECT * FROM sig WHERE o_orderkey NOT IN (SELECT k FROM worst)),
 {newton_sql('w', 'sig2', 'region', 'y', 'price', 'crop')}, a AS ({_terms_sql('m', 'region', ['price', 'crop'], 'region, term, est')}), b AS ({_terms_sql('w', 'region', ['price', 'crop'], 'region, term, est')})
 SELECT region, term, k AS left_out, {rsql('a.est')} AS estimate, {rsql('b.est')} AS estimate_without FROM a JOIN b USING (region, term) JOIN worst USING (region)""")
def refitted(t):
    d, f = _fit2(t)
    worst = materialize(influential(row_diagnostics(d, f, ["o_orderkey"]), ["region"], "o_orderkey").select("region", F.col("max_row").alias("left_out")))
    again = fit_logistic(anti_join(d, worst.select(F.col("left_out").alias("o_orderkey")), ["o_orderkey"]), "y", ["region"], ["price", "crop"])
    both = coef_table(f).select("region", "term", "estimate").join(coef_table(again).select("region", "term", F.col("estimate").alias("estimate_without")), ["region", "term"])
    return rounded(both.join(worst, "region"))


@query("binned_residuals", f"""{_DIAG}, rk AS (SELECT region, mu, y - mu AS r, row_number() OVER (PARTITION BY region ORDER BY mu, md5('0:tie:' || o_orderkey)) AS k, n, floor(sqrt(n::DOUBLE))::BIGINT AS nb FROM dd)
 SELECT region, ((k * nb + n - 1) // n)::BIGINT AS bin, count(*) AS n, {rsql('avg(mu)')} AS mean_x, {rsql('avg(r)')} AS mean_residual, {rsql('2 * stddev_samp(r) / sqrt(count(*))')} AS two_se
 FROM rk GROUP BY 1, 2""")
def binned(t):
    return rounded(binned_residuals(_diag_table(t), ["region"], ["o_orderkey"]).drop("model"))


_QRES = f"""{_DIAG}, qr AS (SELECT o_orderkey, region, n, CASE y WHEN 0 THEN {u_sql('qres', 'o_orderkey')} * (1 - mu) ELSE (1 - mu) + {u_sql('qres', 'o_orderkey')} * mu END AS qres FROM dd)"""


@query("quantile_residuals", f"{_QRES} SELECT o_orderkey, {rsql('qres')} AS qres FROM qr")
def qres(t):
    return rounded(quantile_residuals(_diag(t), SEED, ["o_orderkey"]).select("o_orderkey", "qres"))


@query("ks_distance", f"""{_QRES} SELECT region, n, {rsql('max(abs(rk::DOUBLE / n - qres))')} AS ks FROM
 (SELECT *, row_number() OVER (PARTITION BY region ORDER BY qres) AS rk FROM qr) GROUP BY 1, 2""")
def ks(t):
    return rounded(ks_distance(quantile_residuals(_diag_table(t), SEED, ["o_orderkey"]), ["region"], ["o_orderkey"]).drop("model"))


@query("standardized_effects", f"""WITH RECURSIVE {SIGNAL}, z AS (SELECT region, y, (price - avg(price) OVER g) / stddev_samp(price) OVER g AS price, (crop - avg(crop) OVER g) / stddev_samp(crop) OVER g AS crop
 FROM sig WINDOW g AS (PARTITION BY region)), {newton_sql('m', 'z', 'region', 'y', 'price', 'crop')}
 {_terms_sql('m', 'region', ['price', 'crop'], f'''region, term, {rsql('exp(est)')} AS odds_ratio, {rsql('exp(est - 1.959963984540054::DOUBLE * se)')} AS or_lo''')}""")
def standardized(t):
    s = standardized_effects(signal_table(t), "y", ["region"], ["price", "crop"])
    return rounded(s.select("region", "term", "odds_ratio", "or_lo"))


_GRID = [0.5, 1.0, 2.0, 4.0]


def _curve_sql(x: str, hold: str) -> str:
    eta = f"(b0 + b1 * {x} + b2 * {hold})"
    se = f"sqrt(v00 + 2 * {x} * v01 + 2 * {hold} * v02 + {x} * {x} * v11 + 2 * {x} * {hold} * v12 + {hold} * {hold} * v22)"
    inv = lambda e: rsql(f"1 / (1 + exp(-({e})))")
    return f"{inv(eta)} AS predicted, {inv(f'{eta} - 1.959963984540054::DOUBLE * {se}')} AS lo, {inv(f'{eta} + 1.959963984540054::DOUBLE * {se}')} AS hi"


@query("predict_grid", f"""{_FIT2}, g AS (SELECT region, avg(crop) AS hold FROM sig GROUP BY 1) SELECT region, price, {_curve_sql('price', 'hold')}
 FROM m JOIN g USING (region) CROSS JOIN (SELECT unnest([{', '.join(f'{v}::DOUBLE' for v in _GRID)}]) AS price)""")
def grid(t):
    return rounded(predict_grid(*_fit2(t), "price", _GRID).drop("model"))


@query("predict_interaction", f"""WITH RECURSIVE {SIGNAL}, {newton_sql('m', 'sig', 'region', 'y', 'price', 'price * crop')} SELECT region, price, crop, {_curve_sql('price', '(price * crop)')}
 FROM m CROSS JOIN (SELECT unnest([{', '.join(f'{v}::DOUBLE' for v in _GRID)}]) AS price) CROSS JOIN (SELECT unnest([0.1::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE]) AS crop)""")
def grid2(t):
    d = signal_table(t)
    f = fit_logistic(d, "y", ["region"], ["price", ("price", "crop")])
    return rounded(predict_interaction(d, f, "price", _GRID, "crop", [0.1, 0.5, 0.9]).drop("model"))


_BREAKS = {"price": ([1.0, 1.25, 1.5, 1.75, 2.5], ["1 - 1.25", "1.25 - 1.5", "1.5 - 1.75", ">1.75"]), "crop": ([0.0, 0.2, 0.4, 1.0], ["<0.2", "0.2 - 0.4", ">0.4"])}


def _bins_sql() -> str:
    arms = []
    for term, (edges, labels) in _BREAKS.items():
        arms.append(f"WHEN term = '{term}' THEN CASE WHEN orr < {edges[0]}::DOUBLE THEN NULL " + " ".join(
            f"WHEN orr <= {e}::DOUBLE THEN '{lab}'" for e, lab in zip(edges[1:], labels)) + " END")
    return "CASE WHEN NOT (p < 0.05::DOUBLE) THEN 'Insignificant' " + " ".join(arms) + " END"


@query("odds_map_table", f"""WITH RECURSIVE {SIGNAL}, big AS (SELECT * FROM sig WHERE nation IN (SELECT nation FROM sig WHERE y = 1 GROUP BY 1 HAVING count(*) >= 190)),
 {newton_sql('m', 'big', 'nation', 'y', 'price', 'crop')}, c AS ({_terms_sql('m', 'nation', ['price', 'crop'], f"nation, term, round_even(exp(est), 3) AS orr, {p_sql('est / se')} AS p")})
 SELECT nation, term, orr AS odds_ratio, {_bins_sql()} AS bins FROM c WHERE term <> '(Intercept)' UNION ALL
 SELECT nation, term, NULL, 'Excluded' FROM (SELECT DISTINCT nation FROM sig WHERE nation NOT IN (SELECT nation FROM big)) CROSS JOIN (VALUES ('price'), ('crop')) v(term)""")
def odds_map(t):
    d = signal_table(t)
    kept = keep_groups(d, ["nation"], min_rows=190, where=F.col("y") == 1)
    c = coef_table(fit_logistic(kept, "y", ["nation"], ["price", "crop"]))
    return odds_map_table(c, d.select("nation"), "nation", _BREAKS)


def profile_sql(name: str, fit: str, by: str, terms: list[str]) -> str:
    """CTEs with the profile bounds of a fit on two columns, by Newton's method on scores and deviance together.

    Of the three equations the profiled coefficient's is that the deviance costs the wanted amount; the other two are zero scores.
    """
    sums = """sum(w) AS g00, sum(w * x1) AS g01, sum(w * x2) AS g02, sum(w * x1 * x1) AS g11, sum(w * x1 * x2) AS g12, sum(w * x2 * x2) AS g22,
   sum(r) AS s0, sum(r * x1) AS s1, sum(r * x2) AS s2, -2 * sum(l) AS dev"""
    rows = f"""SELECT *, mu * (1 - mu) AS w, y - mu AS r, y * eta - greatest(eta, 0) - ln(1 + exp(-abs(eta))) AS l FROM (SELECT *, 1 / (1 + exp(-eta)) AS mu FROM
   (SELECT i.*, dd.y, dd.x1, dd.x2, b0 + b1 * x1 + b2 * x2 AS eta FROM {name}_p i JOIN {fit}_d dd USING ({by})))"""
    g = [[f"g{min(i, k)}{max(i, k)}" for k in range(3)] for i in range(3)]
    m = [[f"CASE j WHEN {i} THEN 2 * s{k} ELSE {g[i][k]} END AS m{i}{k}" for k in range(3)] + [f"CASE j WHEN {i} THEN dev - target ELSE s{i} END AS r{i}"] for i in range(3)]
    det = lambda c: f"({c[0][0]} * ({c[1][1]} * {c[2][2]} - {c[1][2]} * {c[2][1]}) - {c[0][1]} * ({c[1][0]} * {c[2][2]} - {c[1][2]} * {c[2][0]}) + {c[0][2]} * ({c[1][0]} * {c[2][1]} - {c[1][1]} * {c[2][0]}))"
    full = [[f"m{i}{k}" for k in range(3)] for i in range(3)]
    steps = [f"b{k} + {det([[f'r{i}' if c == k else full[i][c] for c in range(3)] for i in range(3)])} / {det(full)}" for k in range(3)]
    v = [[f"v{min(i, k)}{max(i, k)}" for k in range(3)] for i in range(3)]
    first = " UNION ALL ".join(f"SELECT 0 AS step, {by}, {j} AS j, {side} AS side, -2 * s0 + pow(1.959963984540054::DOUBLE, 2) AS target, " + ", ".join(
        f"b{k} + {side} * 1.959963984540054::DOUBLE * {v[k][j]} / sqrt({v[j][j]}) AS b{k}" for k in range(3)) + f" FROM {fit}" for j in range(3) for side in (-1, 1))
    label = "CASE j WHEN 0 THEN '(Intercept)' " + " ".join(f"WHEN {i + 1} THEN '{t}'" for i, t in enumerate(terms)) + " END"
    return f"""{name}_p AS ({first} UNION ALL SELECT step + 1, {by}, j, side, target, {', '.join(steps)} FROM (SELECT *, {', '.join(x for row in m for x in row)} FROM
  (SELECT step, {by}, j, side, target, b0, b1, b2, {sums} FROM ({rows}) WHERE step < 9 GROUP BY step, {by}, j, side, target, b0, b1, b2))),
 {name} AS (SELECT {by}, {label} AS term, max(CASE WHEN side = -1 THEN CASE j WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END END) AS lo, max(CASE WHEN side = 1 THEN CASE j WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END END) AS hi
  FROM {name}_p WHERE step = 9 GROUP BY {by}, j)"""


@query("profile_intervals", f"""{_FIT2}, {profile_sql('pr', 'm', 'region', ['price', 'crop'])}
 SELECT region, 'model' AS model, term, {rsql('lo')} AS prof_lo, {rsql('hi')} AS prof_hi, 'found' AS lo_status, 'found' AS hi_status FROM pr""")
def profile(t):
    return rounded(profile_intervals(*_fit2(t)))

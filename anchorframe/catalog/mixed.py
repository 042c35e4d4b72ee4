"""Queries on models with random intercepts.

The check SQL fits the same models by another road: a recursive query that moves intercepts, coefficients and log sigma together
until they stand still, with the precision matrix inverted by sweeps, and a second one that differences the gradient for errors.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorframe.catalog.base import _shift, query, rounded, rsql
from anchorframe.catalog.models import _GRID, SIGNAL, signal_rows, signal_table
from anchorframe.catalog.sampling import SEED, u_sql
from anchorframe.catalog.sweep import pair, sweep_sql
from anchorframe.operators.diagnostics import predict_grid, predict_interaction, quantile_residuals
from anchorframe.operators.glmm import compare_mixed_windows, fit_random_intercept, mixed_diagnostics, mixed_standardized_effects, random_effects

_STEPS = 60


def _sum(parts) -> str:
    return "(" + (" + ".join(parts) or "0") + ")"


class MixedSql:
    """CTEs of the fit of ``y ~ xs`` with intercepts of ``a`` and, if given, of ``b`` with ``m`` levels.

    ``{name}`` has one row per level of ``a``: lv, u, v (of b), b0.. (coefficients), l0.. (log sigma), sd_a, the log-likelihood ll, n and, with
    ``errors``, the covariance of the coefficients v00, v01, ...
    """

    def __init__(self, name: str, src: str, y: str, xs: list[str], a: str, b: str | None = None, m: int = 0, errors: bool = True):
        self.name, self.p, self.m, self.nf, self.errors = name, len(xs) + 1, m, 1 + (m > 0), errors
        place = f"dense_rank() OVER (ORDER BY {b})" if b else "1"
        columns = ", ".join(f"({x})::DOUBLE AS x{i + 1}" for i, x in enumerate(xs))
        self.data = f"{name}_d AS MATERIALIZED (SELECT {a} AS lv, {place} AS c, ({y})::DOUBLE AS y, 1.0::DOUBLE AS x0{', ' + columns if xs else ''} FROM {src})"
        self.betas, self.logs = [f"b{j}" for j in range(self.p)], [f"l{f}" for f in range(self.nf)]
        self.k = range(max(m, 1))

    def stages(self, state: str, keys: str) -> str:
        """``state`` with the sums, the short step to the intercepts' modes, the gradient there and the information of the coefficients."""
        p, m, nf, k = self.p, self.m, self.nf, self.k
        over = f"OVER (PARTITION BY {keys})"
        held = ", ".join([keys, "lv", "u", "v", *self.betas, *self.logs])
        eta = _sum(["u", *(["v[c]"] if m else []), *(f"b{j} * x{j}" for j in range(p))])
        rows = f"SELECT * FROM {state} st JOIN {self.name}_d USING (lv)"
        rows = f"SELECT *, {eta} AS eta FROM ({rows})"
        rows = f"SELECT *, 1 / (1 + exp(-eta)) AS mu FROM ({rows})"
        rows = f"SELECT *, mu * (1 - mu) AS w, y - mu AS r, mu * (1 - mu) * (1 - 2 * mu) AS t FROM ({rows})"
        sums = ["sum(y * eta - greatest(eta, 0) - ln(1 + exp(-abs(eta)))) AS s_ll", "count(*) AS s_n"]
        sums += [f"coalesce(sum(x{j} * {c}) FILTER (c = {i + 1}), 0) AS {q}{j}_{i}" for q, c in (("xr", "r"), ("xw", "w"), ("xt", "t")) for j in range(p) for i in k]
        sums += [f"sum(w * x{i} * x{j}) AS xx_{i}_{j}" for i in range(p) for j in range(i, p)]
        q = f"SELECT {held}, {', '.join(sums)} FROM ({rows}) GROUP BY {held}"
        shrink = [f"exp(-2 * l{f}) AS d{f}" for f in range(nf)]
        q = f"SELECT *, {', '.join(shrink)} FROM ({q})"
        q = f"SELECT *, {_sum(f'xw0_{i}' for i in k)} + d0 AS da FROM ({q})"
        # The smaller factor's matrix after elimination of the larger one, and the right sides that meet it.
        sides = {"g": (_sum(f"xr0_{i}" for i in k) + " - d0 * u", [f"sum(xr0_{i}) {over} - d1 * v[{i + 1}]" for i in k])}
        sides |= {f"z{j}": (_sum(f"xw{j}_{i}" for i in k), [f"sum(xw{j}_{i}) {over}" for i in k]) for j in range(p)}
        if m:
            cells = [f"{'sum(xw0_%d) %s + d1' % (i, over) if i == j else '0'} - sum(xw0_{i} * xw0_{j} / da) {over} AS s_{i}_{j}" for i in k for j in k if i <= j]
            q = sweep_sql(f"SELECT *, {', '.join(cells)} FROM ({q})", "s", m)
        q = self._solve(q, sides, over)
        # At the mode, one short step away.
        q = f"SELECT *, u + g_a AS u1{', [' + ', '.join(f'v[{i + 1}] + g_b{i}' for i in k) + '] AS v1' if m else ', v AS v1'} FROM ({q})"
        pulls = {"p0": ("2 * d0 * u1", ["0" for _ in k])} | ({"p1": ("0", [f"2 * d1 * v1[{i + 1}]" for i in k])} if m else {})
        q = self._solve(q, pulls, over)
        if m:
            reach = [_sum(f"xw0_{j} / da * -{pair('s', i, j)}" for j in k) + f" AS reach_{i}" for i in k]
            q = f"SELECT *, {', '.join(reach)} FROM ({q})"
            q = f"SELECT *, 1 / da + {_sum(f'reach_{i} * xw0_{i} / da' for i in k)} AS var_a FROM ({q})"
            q = f"SELECT *, {', '.join(f'var_a - {pair('s', i, i)} - 2 * reach_{i} AS lever_{i}' for i in k)} FROM ({q})"
        else:
            q = f"SELECT *, 1 / da AS var_a, 1 / da AS lever_0 FROM ({q})"
        of = lambda side, i: f"({side}_a + {side}_b{i})" if m else f"{side}_a"
        grads = [f"sum({_sum(f'xr{j}_{i} - xw{j}_{i} * {of('g', i)} - lever_{i} / 2 * (xt{j}_{i} - xt0_{i} * {of(f'z{j}', i)})' for i in k)}) {over} AS grad{j}" for j in range(p)]
        turn = lambda f: _sum(f"lever_{i} * xt0_{i} * {of(f'p{f}', i)}" for i in k)
        grads += [f"sum(d0 * u1 * u1 - 1 + d0 * var_a - {turn(0)} / 2) {over} AS grad{p}"]
        if m:
            of_b = _sum(f"d1 * v1[{i + 1}] * v1[{i + 1}] - 1 - d1 * {pair('s', i, i)}" for i in k)
            grads += [f"{of_b} - sum({turn(1)} / 2) {over} AS grad{p + 1}"]
        inside = lambda i, j: f"z{i}_a * {_sum(f'xw{j}_{c}' for c in k)}" + ("".join(f" + z{i}_b{c} * xw{j}_{c}" for c in k) if m else "")
        info = [f"sum(xx_{i}_{j} - ({inside(i, j)})) {over} AS info_{i}_{j}" for i in range(p) for j in range(i, p)]
        det = f"sum(ln(da)) {over}" + "".join(f" + ln(s_piv_{i})" for i in k) * (m > 0)
        value = f"sum(s_ll - d0 * u * u / 2 - l0) {over}" + ("".join(f" - d1 * v[{i + 1}] * v[{i + 1}] / 2 - l1" for i in k) if m else "") + f" - ({det}) / 2"
        q = f"SELECT *, {', '.join([*grads, *info])}, {value} AS ll, CAST(sum(s_n) {over} AS BIGINT) AS n, count(*) {over} AS qa FROM ({q})"
        return sweep_sql(q, "info", p)

    def _solve(self, rows: str, sides: dict[str, tuple[str, list[str]]], over: str) -> str:
        """The inverse precision matrix times level values: name_a on each row, name_b0.. of the smaller factor."""
        if not self.m:
            return f"SELECT *, {', '.join(f'({a}) / da AS {name}_a' for name, (a, _) in sides.items())} FROM ({rows})"
        k = self.k
        rows = f"SELECT *, {', '.join(f'({a}) AS {name}_ga' for name, (a, _) in sides.items())} FROM ({rows})"
        rows = f"SELECT *, {', '.join(f'{b[i]} - sum(xw0_{i} * {name}_ga / da) {over} AS {name}_gb{i}' for name, (_, b) in sides.items() for i in k)} FROM ({rows})"
        xb = [_sum(f"-{pair('s', i, j)} * {name}_gb{j}" for j in k) + f" AS {name}_b{i}" for name in sides for i in k]
        rows = f"SELECT *, {', '.join(xb)} FROM ({rows})"
        return f"SELECT *, {', '.join(f'({name}_ga - {_sum(f'xw0_{i} * {name}_b{i}' for i in k)}) / da AS {name}_a' for name in sides)} FROM ({rows})"

    def ctes(self) -> str:
        name, p, m, nf, k = self.name, self.p, self.m, self.nf, self.k
        zero = "[" + ", ".join("0.0::DOUBLE" for _ in k) + "]"
        first = f"SELECT DISTINCT 0 AS step, lv, 0.0::DOUBLE AS u, {zero} AS v, " + ", ".join([*(f"0.0::DOUBLE AS b{j}" for j in range(p)), *(f"-0.7::DOUBLE AS l{f}" for f in range(nf))]) + f" FROM {name}_d"
        # Coefficients by the information, log sigma by twice the number of levels; intercepts follow both.
        change = [_sum(f"-{pair('info', i, j)} * grad{j}" for j in range(p)) + f" AS db{i}" for i in range(p)]
        change += [f"greatest(least(grad{p + f} / (2 * {'qa' if f == 0 else m}), 0.5), -0.5) AS dl{f}" for f in range(nf)]
        moved = f"SELECT *, {', '.join(change)} FROM ({self.stages(name + '_it', 'step')})"
        along = lambda end: "".join(f" - z{j}_{end} * db{j}" for j in range(p)) + "".join(f" + p{f}_{end} * dl{f}" for f in range(nf))
        to_v = "[" + ", ".join(f"v1[{i + 1}]{along(f'b{i}')}" for i in k) + "]" if m else "v"
        move = f"SELECT step + 1, lv, u1{along('a')}, {to_v}, " + ", ".join([*(f"b{j} + db{j}" for j in range(p)), *(f"l{f} + dl{f}" for f in range(nf))]) + f" FROM ({moved}) WHERE step < {_STEPS}"
        out = [self.data, f"{name}_it AS ({first} UNION ALL {move})", f"{name}_e AS MATERIALIZED ({self.stages(f'(SELECT * FROM {name}_it WHERE step = {_STEPS})', 'step')})"]
        held = f"lv, u1 AS u, v1 AS v, {', '.join([*self.betas, *self.logs])}, sqrt(var_a) AS sd_a, ll, n"
        if not self.errors:
            return ",\n ".join([*out, f"{name} AS MATERIALIZED (SELECT {held} FROM {name}_e)"])
        size = p + nf
        eps = [*(f"sqrt(-{pair('info', j, j)}) / 100" for j in range(p)), *("0.001::DOUBLE" for _ in range(nf))]
        place = [*self.betas, *self.logs]
        near = " UNION ALL ".join(f"SELECT 0 AS step, {2 * i + (sign < 0)} AS s, {eps[i]} AS eps, lv, u, v, " + ", ".join(f"{c} {'+' if sign > 0 else '-'} {eps[i]} AS {c}" if n == i else c for n, c in enumerate(place))
                                  + f" FROM {name}_e" for i in range(size) for sign in (1, -1))
        step = f"SELECT step + 1, s, eps, lv, u1, v1, {', '.join(place)} FROM ({self.stages(name + '_n', 'step, s, eps')}) WHERE step < 7"
        out += [f"{name}_n AS ({near} UNION ALL {step})",
                f"{name}_g AS MATERIALIZED (SELECT DISTINCT s, eps, {', '.join(f'grad{i}' for i in range(size))} FROM ({self.stages(f'(SELECT * FROM {name}_n WHERE step = 7)', 'step, s, eps')}))"]
        slope = lambda i, j: f"max(CASE WHEN s = {2 * i} THEN grad{j} / eps END) - max(CASE WHEN s = {2 * i + 1} THEN grad{j} / eps END)"
        cells = ", ".join(f"-({slope(i, j)} + {slope(j, i)}) / 4 AS h_{i}_{j}" for i in range(size) for j in range(i, size))
        out.append(f"{name}_v AS MATERIALIZED ({sweep_sql(f'SELECT {cells} FROM {name}_g', 'h', size)})")
        vs = ", ".join(f"-h_{i}_{j} AS v{i}{j}" for i in range(p) for j in range(i, p))
        return ",\n ".join([*out, f"{name} AS MATERIALIZED (SELECT {held}, {vs} FROM {name}_e CROSS JOIN {name}_v)"])


def _with(*fits: MixedSql, before: str = SIGNAL) -> str:
    return f"WITH RECURSIVE {before}, " + ",\n ".join(f.ctes() for f in fits)


def _coef_sql(name: str, terms: list[str], cols: str) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS term_pos, '{t}' AS term, {cols.replace('EST', f'b{i}').replace('SE', f'sqrt(v{i}{i})')} FROM (SELECT * FROM {name} LIMIT 1)" for i, t in enumerate(["(Intercept)", *terms]))


_WIDTH = "1.959963984540054::DOUBLE"
_COEFS = (f"{rsql('EST')} AS estimate, {rsql('SE', 5)} AS se, {rsql('EST - ' + _WIDTH + ' * SE', 5)} AS ci_lo, {rsql('EST + ' + _WIDTH + ' * SE', 5)} AS ci_hi, {rsql('exp(EST)', 5)} AS odds_ratio, "
          f"{rsql('exp(EST - ' + _WIDTH + ' * SE)', 4)} AS or_lo, {rsql('exp(EST + ' + _WIDTH + ' * SE)', 4)} AS or_hi")
_TERMS, _FACTORS = ["price", "crop"], ["nation", "year"]


def _rounded_coefs(coefs):
    digits = {"estimate": 6, "se": 5, "ci_lo": 5, "ci_hi": 5, "odds_ratio": 5, "or_lo": 4, "or_hi": 4}
    return rounded_by(coefs.select("term_pos", "term", *digits), digits)


def rounded_by(df, digits: dict[str, int]):
    """Columns rounded to their own number of digits, off ties as ``rounded`` does."""
    return df.selectExpr(*[f"round(`{c}` + {_shift(digits[c])!r}D, {digits[c]}) AS `{c}`" if c in digits else f"`{c}`" for c in df.columns])


@query("random_intercept", f"{_with(MixedSql('m', 'sig', 'y', _TERMS, 'nation', 'year', 7))} {_coef_sql('m', _TERMS, _COEFS)}")
def random_intercept(t):
    return _rounded_coefs(fit_random_intercept(signal_rows(t), "y", _TERMS, _FACTORS).coefs)


@query("random_intercept_fit", f"""{_with(MixedSql('m', 'sig', 'y', _TERMS, 'nation', 'year', 7, errors=False))} SELECT n, {rsql('ll', 5)} AS loglik, {rsql('-2 * ll + 10 + 60.0::DOUBLE / (n - 6)', 5)} AS aicc,
 {rsql('exp(l0)', 5)} AS sigma_nation, {rsql('exp(l1)', 5)} AS sigma_year FROM (SELECT * FROM m LIMIT 1)""")
def random_fit(t):
    fit = fit_random_intercept(signal_rows(t), "y", _TERMS, _FACTORS, errors=False).fit
    return rounded(fit.select("n", "loglik", "aicc", "sigma_nation", "sigma_year"), 5)


_ONE = MixedSql("m", "sig", "y", _TERMS, "nation")


@query("mixed_coef_table", f"{_with(_ONE)} {_coef_sql('m', _TERMS, _COEFS)}")
def mixed_coefs(t):
    return _rounded_coefs(fit_random_intercept(signal_rows(t), "y", _TERMS, ["nation"]).coefs)


@query("random_effects", f"""{_with(MixedSql('m', 'sig', 'y', _TERMS, 'nation', errors=False))} SELECT 'nation' AS factor, lv AS level, {rsql('u', 5)} AS mode, {rsql('sd_a', 5)} AS sd, {rsql('u - 1.96 * sd_a', 5)} AS lo,
 {rsql('u + 1.96 * sd_a', 5)} AS hi FROM m""")
def random_levels(t):
    return rounded(random_effects(fit_random_intercept(signal_rows(t), "y", _TERMS, ["nation"], errors=False)), 5)


_WINDOWS = {"size": ["price"], "cover": ["crop", "hay"]}
_EACH = " UNION ALL ".join(f"SELECT '{family}' AS family, '{c}' AS feature, n, ll FROM (SELECT * FROM w_{c} LIMIT 1)" for family, cols in _WINDOWS.items() for c in cols)


@query("compare_mixed_windows", f"""{_with(*(MixedSql(f'w_{c}', 'sig', 'y', [c], 'nation', errors=False) for cols in _WINDOWS.values() for c in cols))},
 each AS (SELECT *, -2 * ll + 6 + 24.0::DOUBLE / (n - 4) AS aicc FROM ({_EACH}))
 SELECT family, feature, n, {rsql('ll', 5)} AS loglik, 3 AS k, {rsql('aicc', 5)} AS aicc, {rsql('aicc - min(aicc) OVER (PARTITION BY family)', 5)} AS delta_aicc FROM each""")
def mixed_windows(t):
    return rounded(compare_mixed_windows(signal_rows(t), "y", _WINDOWS, ["nation"]).drop("converged"), 5)


def _mixed_curve_sql(x: str, second: str) -> str:
    eta = f"(b0 + b1 * {x} + b2 * {second})"
    se = f"sqrt(v00 + 2 * {x} * v01 + 2 * {second} * v02 + {x} * {x} * v11 + 2 * {x} * {second} * v12 + {second} * {second} * v22)"
    inv = lambda e: rsql(f"1 / (1 + exp(-({e})))", 5)
    return f"{inv(eta)} AS predicted, {inv(f'{eta} - {_WIDTH} * {se}')} AS lo, {inv(f'{eta} + {_WIDTH} * {se}')} AS hi"


_GRID_SQL = f"(SELECT unnest([{', '.join(f'{v}::DOUBLE' for v in _GRID)}]) AS price)"


@query("mixed_predict_grid", f"{_with(_ONE)} SELECT price, {_mixed_curve_sql('price', 'hold')} FROM (SELECT * FROM m LIMIT 1) CROSS JOIN (SELECT avg(crop) AS hold FROM sig) CROSS JOIN {_GRID_SQL}")
def mixed_grid(t):
    d = signal_table(t)
    fit = fit_random_intercept(d, "y", _TERMS, ["nation"])
    return rounded(predict_grid(d, fit.fixed, "price", _GRID).drop("model"), 5)


@query("mixed_predict_interaction", f"""{_with(MixedSql('m', 'sig', 'y', ['price', 'price * crop'], 'nation'))} SELECT price, crop, {_mixed_curve_sql('price', '(price * crop)')}
 FROM (SELECT * FROM m LIMIT 1) CROSS JOIN {_GRID_SQL} CROSS JOIN (SELECT unnest([0.1::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE]) AS crop)""")
def mixed_interaction(t):
    d = signal_table(t)
    fit = fit_random_intercept(d, "y", ["price", ("price", "crop")], ["nation"])
    return rounded(predict_interaction(d, fit.fixed, "price", _GRID, "crop", [0.1, 0.5, 0.9]).drop("model"), 5)


@query("mixed_standardized_effects", f"""{_with(MixedSql('m', 'z', 'y', _TERMS, 'nation'), before=SIGNAL + ''', z AS (SELECT nation, y, (price - avg(price) OVER ()) / stddev_samp(price) OVER () AS price,
 (crop - avg(crop) OVER ()) / stddev_samp(crop) OVER () AS crop FROM sig)''')} {_coef_sql('m', _TERMS, f"{rsql('exp(EST)', 5)} AS odds_ratio, {rsql('exp(EST - ' + _WIDTH + ' * SE)', 5)} AS or_lo, {rsql('exp(EST + ' + _WIDTH + ' * SE)', 5)} AS or_hi")}""")
def mixed_standardized(t):
    return rounded(mixed_standardized_effects(signal_rows(t), "y", _TERMS, ["nation"]).drop("p_value"), 5)


@query("mixed_quantile_residuals", f"""{_with(MixedSql('m', 'sig', 'y', _TERMS, 'nation', errors=False))}, dg AS (SELECT o_orderkey, y, 1 / (1 + exp(-(b0 + b1 * price + b2 * crop + u))) AS mu FROM sig JOIN m ON nation = lv)
 SELECT o_orderkey, {rsql('mu', 5)} AS fitted, {rsql(f"CASE y WHEN 0 THEN {u_sql('qres', 'o_orderkey')} * (1 - mu) ELSE (1 - mu) + {u_sql('qres', 'o_orderkey')} * mu END", 5)} AS qres FROM dg""")
def mixed_residuals(t):
    d = signal_table(t)
    diag = mixed_diagnostics(d, fit_random_intercept(d, "y", _TERMS, ["nation"], errors=False), ["o_orderkey"])
    return rounded(quantile_residuals(diag, SEED, ["o_orderkey"]).select("o_orderkey", "fitted", "qres"), 5)

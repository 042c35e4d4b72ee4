"""Logistic regression with random intercepts for one grouping factor or two crossed ones.

Maximum likelihood by the Laplace approximation, many models at once. Rows get whole-number codes for their factor levels and
stay in Spark; each pass is one aggregate that answers the open requests of all models with sums per cell (combination of levels).
A model is a coroutine: it asks for sums at its coefficients and intercepts and goes on with the answer, so that any number of
models, and all steps of a numerical curvature, share their passes.

The precision matrix of the intercepts is diagonal within a factor. Of two crossed factors the one with more levels is
eliminated by blocks, which leaves a dense matrix of the smaller factor's levels only; nothing of the size levels x levels is made.
The driver holds vectors of levels and of observed cells.
"""

from __future__ import annotations

import math
from collections.abc import Generator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from anchorframe.operators.glm import INTERCEPT, Z975, Fits, Term, _term_column, _union_terms, base_columns, term_name, zscored
from anchorframe.operators.ranking import attach
from anchorframe.operators.tables import complete_cases
from anchorframe.session import local_table

MIN_SIGMA = 1e-4
INNER_ROUNDS, OUTER_ROUNDS = 60, 60
BROADCAST_BYTES = 8 << 20  # of the intercepts of a factor's levels, in all requests of a pass
_CHUNK = 1 << 21  # numbers of a block of levels x smaller factor held at once


@dataclass(frozen=True)
class MixedFit:
    """``coefs``, ``random`` and ``fit`` are result tables; ``fixed`` is the fixed part with its full covariance, as a plain fit.

    ``fixed`` goes into ``predict_grid`` and ``predict_interaction``: predictions then are those of a level with intercept 0.
    """

    coefs: DataFrame
    random: DataFrame
    fit: DataFrame
    factors: list[str]
    fixed: Fits


# ---- cells

class _Cells:
    """The observed combinations of factor levels: codes, and sums moved between cells and levels."""

    def __init__(self, codes: np.ndarray, levels: list[int]):
        self.codes, self.levels = codes, levels  # one column of codes for each factor
        self.start = np.cumsum([0, *levels])
        self.q = int(self.start[-1])
        self.idx = codes + self.start[:-1]
        self.large = int(np.argmax(levels))
        self.order = np.argsort(codes[:, self.large], kind="stable")

    def spread(self, cell: np.ndarray) -> np.ndarray:
        """Cell values summed onto the levels they belong to."""
        flat = cell.reshape(len(cell), -1)
        out = np.empty((self.q, flat.shape[1]))
        for k in range(flat.shape[1]):
            out[:, k] = np.bincount(self.idx.ravel(), np.repeat(flat[:, k], self.idx.shape[1]), self.q)
        return out.reshape(self.q, *cell.shape[1:])

    def gather(self, level: np.ndarray) -> np.ndarray:
        """Level values summed over each cell's levels."""
        return level[self.idx].sum(axis=1)


class _Precision:
    """The intercepts' precision matrix (cell weights and 1 / sigma ** 2) with one factor eliminated by blocks."""

    def __init__(self, cells: _Cells, w: np.ndarray, shrink: np.ndarray):
        self.cells, self.w = cells, w
        self.diagonal = cells.spread(w) + shrink
        self.crossed = len(cells.levels) == 2
        if self.crossed:
            a, b = cells.large, 1 - cells.large
            self.a, self.b = (slice(int(cells.start[f]), int(cells.start[f + 1])) for f in (a, b))
            self.da, self.db = self.diagonal[self.a], self.diagonal[self.b]
            self.ca, self.cb = cells.codes[:, a], cells.codes[:, b]
            left = np.diag(self.db)
            for _, own, block in self._blocks():
                left = left - (block / self.da[own][:, None]).T @ block
            self.inner = np.linalg.inv((left + left.T) / 2)
            self.logdet = float(np.log(self.da).sum()) + float(np.linalg.slogdet(left)[1])
        else:
            self.logdet = float(np.log(self.diagonal).sum())

    def _blocks(self):
        """Cells of some levels of the eliminated factor at a time: their places, those levels, and their weights as a block."""
        m, order = len(self.db), self.cells.order
        step = max(1, _CHUNK // m)
        sorted_a = self.ca[order]
        for low in range(0, len(self.da), step):
            high = min(len(self.da), low + step)
            at = order[np.searchsorted(sorted_a, low):np.searchsorted(sorted_a, high)]
            block = np.zeros((high - low, m))
            block[self.ca[at] - low, self.cb[at]] = self.w[at]
            yield at, slice(low, high), block

    def solve(self, right: np.ndarray) -> np.ndarray:
        """The matrix's inverse times one or several columns of level values."""
        flat = right.reshape(len(right), -1)
        if not self.crossed:
            return (flat / self.diagonal[:, None]).reshape(right.shape)
        out = np.empty_like(flat)
        for k in range(flat.shape[1]):
            ga, gb = flat[self.a, k], flat[self.b, k]
            xb = self.inner @ (gb - np.bincount(self.cb, self.w * (ga / self.da)[self.ca], len(self.db)))
            out[self.b, k] = xb
            out[self.a, k] = (ga - np.bincount(self.ca, self.w * xb[self.cb], len(self.da))) / self.da
        return out.reshape(right.shape)

    def variances(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the inverse: the diagonal, and for each cell the variance of the sum of its levels' intercepts."""
        if not self.crossed:
            diagonal = 1.0 / self.diagonal
            return diagonal, self.cells.gather(diagonal)
        diagonal, cross = np.empty(self.cells.q), np.empty(len(self.w))
        diagonal[self.b] = np.diag(self.inner)
        of_a = np.empty(len(self.da))
        for at, own, block in self._blocks():
            scaled = block / self.da[own][:, None]
            reach = scaled @ self.inner
            of_a[own] = 1.0 / self.da[own] + (reach * scaled).sum(axis=1)
            cross[at] = -reach[self.ca[at] - own.start, self.cb[at]]
        diagonal[self.a] = of_a
        return diagonal, self.cells.gather(diagonal) + 2 * cross


# ---- passes

@dataclass(frozen=True)
class _Request:
    """Sums wanted at coefficients (of all terms, 0 where the model lacks one) and intercepts; ``full``: with sums of term pairs."""

    model: int
    beta: np.ndarray
    b: np.ndarray
    full: bool = False


@dataclass
class _Rows:
    """Coded rows and the passes over them."""

    rows: DataFrame
    factors: list[str]
    names: list[list]  # level values of each factor, by code
    p: int
    needs: list[int]  # terms of each model, as bits
    passes: int = field(default=0)

    def answer(self, requests: list[_Request]) -> list[dict[str, np.ndarray]]:
        """One pass: per-cell sums (and the cells' codes) of every request."""
        self.passes += 1
        p, spark, nf = self.p, self.rows.sparkSession, len(self.factors)
        j = self.rows
        arr = T.ArrayType(T.DoubleType())
        for f in range(nf):
            low = sum(len(n) for n in self.names[:f])
            off = np.array([r.b[low:low + len(self.names[f])] for r in requests]).T
            schema = T.StructType([T.StructField(f"__c{f}", T.IntegerType()), T.StructField(f"__o{f}", arr)])
            table = local_table(spark, [{f"__c{f}": i, f"__o{f}": list(map(float, o))} for i, o in enumerate(off)], schema)
            j = j.join(F.broadcast(table) if off.nbytes <= BROADCAST_BYTES else table, f"__c{f}")
        full = any(r.full for r in requests)
        asked = ", ".join(f"struct({n} AS id, {self.needs[r.model]}L AS need, array({', '.join(f'{float(x)!r}D' for x in r.beta)}) AS beta)" for n, r in enumerate(requests))
        codes = [f"__c{f}" for f in range(nf)]
        keep = [*codes, *[f"__o{f}" for f in range(nf)], "__y", *[f"__x{i}" for i in range(p)]]
        j = j.selectExpr(*keep, "__have", f"explode(array({asked})) AS r").where("(__have & r.need) = r.need")
        off = " + ".join(f"__o{f}[r.id]" for f in range(nf))
        eta = " + ".join(f"__x{i} * r.beta[{i}]" for i in range(p))
        j = j.selectExpr("r.id AS id", *codes, "__y", *[f"__x{i}" for i in range(p)], f"{off} + {eta} AS __eta")
        j = j.selectExpr("*", "1 / (1 + exp(-__eta)) AS __mu").selectExpr("*", "__mu * (1 - __mu) AS __w", "__y - __mu AS __r")
        j = j.selectExpr("*", "__w * (1 - 2 * __mu) AS __v")
        sums = {"n": "count(1)", "ll": "sum(__y * __eta - greatest(__eta, 0D) - log1p(exp(-abs(__eta))))", "r": "sum(__r)", "w": "sum(__w)", "v": "sum(__v)"}
        for i in range(p):
            sums |= {f"xr{i}": f"sum(__x{i} * __r)", f"xw{i}": f"sum(__x{i} * __w)", f"xv{i}": f"sum(__x{i} * __v)"}
        pairs = [(i, k) for i in range(p) for k in range(i, p)] if full else []
        sums |= {f"xx{i}_{k}": f"sum(__w * __x{i} * __x{k})" for i, k in pairs}
        got = j.groupBy("id", *codes).agg(*[F.expr(e).alias(c) for c, e in sums.items()]).toArrow()
        ids, cell = got["id"].to_numpy(), np.stack([got[c].to_numpy() for c in codes], 1) if got.num_rows else np.zeros((0, nf), int)
        out = []
        for n, _ in enumerate(requests):
            own = np.flatnonzero(ids == n)
            own = own[np.lexsort(cell[own].T[::-1])]
            col = lambda c: got[c].to_numpy()[own].astype(float)  # noqa: B023, E731
            s = {"codes": cell[own], **{c: col(c) for c in ("n", "ll", "r", "w", "v")}}
            s |= {c: np.stack([col(f"{c}{i}") for i in range(p)], 1) for c in ("xr", "xw", "xv")}
            if full:
                xx = np.zeros((p, p))
                for i, k in pairs:
                    xx[i, k] = xx[k, i] = col(f"xx{i}_{k}").sum()
                s["xx"] = xx
            out.append(s)
        return out


def _coded(df: DataFrame, y: str, terms: Sequence[Term], factors: list[str]) -> tuple[DataFrame, list[list], np.ndarray, np.ndarray, float]:
    """Rows with response and factors: level codes, bits of the terms a row has, scaled term columns (0 where missing)."""
    p = len(terms) + 1
    xs = [F.lit(1.0).alias("__x0"), *[_term_column(t).alias(f"__x{i + 1}") for i, t in enumerate(terms)]]
    raw = complete_cases(df, [y, *factors]).select(*factors, F.col(y).cast("double").alias("__y"), *xs)
    known = [F.when(F.isnan(f"__x{i}"), None).otherwise(F.col(f"__x{i}")).alias(f"__x{i}") for i in range(p)]
    raw = raw.select(*factors, "__y", *known).persist(StorageLevel.MEMORY_AND_DISK)
    moments = [F.avg("__y").alias("y"), *[F.avg(f"__x{i}").alias(f"m{i}") for i in range(1, p)], *[F.stddev_pop(f"__x{i}").alias(f"s{i}") for i in range(1, p)]]
    names, found = [], raw.select(F.explode(F.array(*[F.struct(F.lit(i).alias("f"), *[F.col(c) if i == k else F.lit(None).cast(raw.schema[c].dataType).alias(c) for k, c in enumerate(factors)])
                                                      for i in range(len(factors))])).alias("x")).select("x.*").distinct().toArrow()
    for i, c in enumerate(factors):
        own = found.filter(found["f"].to_numpy() == i)[c].to_pylist() if found.num_rows else []
        names.append(sorted(own, key=str))
    row = raw.agg(*moments).first()
    m = np.array([0.0, *[row[f"m{i}"] or 0.0 for i in range(1, p)]])
    s = np.array([1.0, *[row[f"s{i}"] or 1.0 for i in range(1, p)]])
    rows = raw
    for i, c in enumerate(factors):
        schema = T.StructType([T.StructField(c, raw.schema[c].dataType), T.StructField(f"__c{i}", T.IntegerType())])
        rows = attach(rows, local_table(df.sparkSession, [{c: v, f"__c{i}": k} for k, v in enumerate(names[i])], schema), [c], "inner")
    have = " | ".join(f"(CASE WHEN __x{i} IS NULL THEN 0L ELSE {1 << i}L END)" for i in range(p))
    xs = [f"coalesce((__x{i} - {float(m[i])!r}D) / {float(s[i])!r}D, 0D) AS __x{i}" for i in range(1, p)]
    rows = rows.selectExpr(*[f"__c{i}" for i in range(len(factors))], "__y", f"{have} AS __have", "__x0", *xs).persist(StorageLevel.MEMORY_AND_DISK)
    rows.count()
    raw.unpersist()
    return rows, names, m, s, float(row["y"] or 0.0)


# ---- one model

@dataclass
class _State:
    """Where a model stands: log-likelihood and gradient over (coefficients, log sigma), intercepts and how they move."""

    theta: np.ndarray
    value: float
    grad: np.ndarray
    b: np.ndarray
    move: np.ndarray
    sound: bool
    spread: np.ndarray  # variances of the intercepts
    carry: tuple[np.ndarray, np.ndarray, np.ndarray]  # weights of the cells, and how they change with a row's predictor: sums, and times terms


class _Model:
    """The steps of one model; generators yield lists of requests and receive lists of sums."""

    def __init__(self, data: _Rows, number: int, used: list[int], mean_y: float, errors: bool):
        self.data, self.number, self.used, self.mean_y, self.errors = data, number, used, mean_y, errors
        self.levels = [len(n) for n in data.names]
        self.p, self.nf = len(used), len(self.levels)
        self.cells: _Cells | None = None
        self.n = 0

    def _ask(self, beta: np.ndarray, b: np.ndarray, full: bool = False) -> _Request:
        whole = np.zeros(self.data.p)
        whole[self.used] = beta
        return _Request(self.number, whole, b, full)

    def _take(self, s: dict) -> dict:
        if self.cells is None:
            self.cells, self.n = _Cells(s["codes"], self.levels), int(s["n"].sum())
        s = {**s, **{c: s[c][:, self.used] for c in ("xr", "xw", "xv")}}
        if "xx" in s:
            s["xx"] = s["xx"][np.ix_(self.used, self.used)]
        return s

    def shrink(self, sigma: np.ndarray) -> np.ndarray:
        return np.repeat(1.0 / sigma ** 2, self.levels)

    def joint(self, beta: np.ndarray, sigma: np.ndarray, b: np.ndarray, rounds: int) -> Generator:
        """Start values: coefficients and intercepts together at fixed sigma, which is then set from the intercepts; some rounds."""
        for n in range(rounds):
            s = self._take((yield [self._ask(beta, b, True)])[0])
            h, zwx, d = _Precision(self.cells, s["w"], self.shrink(sigma)), self.cells.spread(s["xw"]), self.shrink(sigma)
            gb, gx = self.cells.spread(s["r"]) - d * b, s["xr"].sum(axis=0)
            hz = h.solve(np.column_stack([zwx, gb]))
            info = s["xx"] - zwx.T @ hz[:, :-1]
            dbeta = np.linalg.lstsq(info, gx - zwx.T @ hz[:, -1], rcond=None)[0]
            beta, b = beta + dbeta, b + hz[:, -1] - hz[:, :-1] @ dbeta
            if n:
                var = h.variances()[0]
                sigma = np.array([max(math.sqrt(float(np.mean(x ** 2 + y))), 0.05) for x, y in zip(np.split(b, self.cells.start[1:-1]), np.split(var, self.cells.start[1:-1]))])
        return beta, sigma, b, info

    def evaluate(self, thetas: list[np.ndarray], starts: list[np.ndarray]) -> Generator:
        """The Laplace objective and its gradient at several points at once; intercepts by Newton steps, halved where they go too far."""
        p = self.p
        out: list = [None] * len(thetas)
        held = {k: dict(b=b, old=b, value=-math.inf) for k, b in enumerate(starts)}
        for n in range(INNER_ROUNDS):
            if not held:
                break
            got = yield [self._ask(thetas[k][:p], x["b"]) for k, x in held.items()]
            for (k, x), s in zip(list(held.items()), got):
                s, sigma = self._take(s), np.exp(thetas[k][p:])
                d = self.shrink(sigma)
                value = s["ll"].sum() - 0.5 * float(d @ (x["b"] ** 2))
                last = n == INNER_ROUNDS - 1
                if value < x["value"] - 1e-9 * (abs(value) + 1) and not last:
                    x["b"] = (x["b"] + x["old"]) / 2
                    continue
                h = _Precision(self.cells, s["w"], d)
                grad = self.cells.spread(s["r"]) - d * x["b"]
                step = h.solve(grad)
                gain = float(grad @ step)
                if gain < 1e-7 or last:
                    out[k] = self._state(thetas[k], s, sigma, x["b"], step, gain < 1e-3)
                    del held[k]
                else:
                    x.update(old=x["b"], b=x["b"] + step, value=value)
        return out

    def _state(self, theta: np.ndarray, s: dict, sigma: np.ndarray, b: np.ndarray, step: np.ndarray, sound: bool) -> _State:
        """Objective and gradient at the mode, one short step away: sums are carried there to first order."""
        cells, d, shift = self.cells, self.shrink(sigma), self.cells.gather(step)
        ll = s["ll"].sum() + float(s["r"] @ shift) - 0.5 * float(s["w"] @ shift ** 2)
        w, xw = s["w"] + s["v"] * shift, s["xw"] + s["xv"] * shift[:, None]
        xr, b = s["xr"] - s["xw"] * shift[:, None], b + step
        h = _Precision(cells, w, d)
        diagonal, lever = h.variances()
        value = ll - 0.5 * float(d @ b ** 2) + 0.5 * float(np.log(d).sum()) - 0.5 * h.logdet
        by_beta = -h.solve(cells.spread(xw))
        pull = np.zeros((cells.q, self.nf))
        slices = [slice(int(cells.start[f]), int(cells.start[f + 1])) for f in range(self.nf)]
        for f, own in enumerate(slices):
            pull[own, f] = 2 * d[own] * b[own]
        by_sigma = h.solve(pull)
        weight = lever * s["v"]
        g_beta = xr.sum(axis=0) - 0.5 * ((lever[:, None] * s["xv"]).sum(axis=0) + weight @ cells.gather(by_beta))
        g_sigma = [float(d[own] @ b[own] ** 2) - (own.stop - own.start) + float(diagonal[own] @ d[own]) - 0.5 * float(weight @ cells.gather(by_sigma[:, f])) for f, own in enumerate(slices)]
        return _State(theta, float(value), np.concatenate([g_beta, g_sigma]), b, np.column_stack([by_beta, by_sigma]), sound, diagonal,
                      (w, s["v"], s["xv"]))

    def climb(self, at: _State, inv: np.ndarray) -> Generator:
        """Quasi-Newton ascent with a backtracking step; intercepts are predicted along each step."""
        floor = math.log(MIN_SIGMA)
        for _ in range(OUTER_ROUNDS):
            move = inv @ at.grad
            gain = float(at.grad @ move)
            if gain < 1e-10:
                return at, inv, at.sound
            size = 1.0
            while True:
                new = at.theta + size * move
                new[self.p:] = np.maximum(new[self.p:], floor)
                to = (yield from self.evaluate([new], [at.b + at.move @ (new - at.theta)]))[0]
                if math.isfinite(to.value) and to.value >= at.value + 1e-4 * size * gain - 1e-11 * abs(at.value) or size < 1e-4:
                    break
                size /= 2
            s, y = to.theta - at.theta, at.grad - to.grad
            sy = float(s @ y)
            if sy > 1e-14:
                rho, eye = 1.0 / sy, np.eye(len(s))
                inv = (eye - rho * np.outer(s, y)) @ inv @ (eye - rho * np.outer(y, s)) + rho * np.outer(s, s)
            stuck = size < 1e-4
            at = to
            if stuck:
                return at, inv, float(at.grad @ inv @ at.grad) < 1e-6 and at.sound
        return at, inv, False

    def run(self) -> Generator:
        """The fit: best state, covariance (NaN without errors) and whether it converged."""
        p, nf = self.p, self.nf
        beta = np.zeros(p)
        beta[0] = math.log(max(self.mean_y, 1e-6) / max(1 - self.mean_y, 1e-6))
        beta, sigma, b, info = yield from self.joint(beta, np.full(nf, 0.5), np.zeros(sum(self.levels)), 6)
        inv = np.zeros((p + nf, p + nf))
        inv[:p, :p] = np.linalg.pinv(info)
        inv[range(p, p + nf), range(p, p + nf)] = [0.5 / n for n in self.levels]
        size = np.sqrt(np.diag(inv))
        at = (yield from self.evaluate([np.concatenate([beta, np.log(sigma)])], [b]))[0]
        at, inv, ok = yield from self.climb(at, inv)
        cov = np.full((p + nf, p + nf), np.nan)
        if self.errors:
            free = [i for i in range(p + nf) if i < p or at.theta[i] > math.log(MIN_SIGMA) + 1e-6]
            steps = []
            for i in free:
                for side in (1, -1):
                    step = np.zeros(p + nf)
                    step[i] = side * (1e-3 if i >= p else 1e-2 * size[i])
                    steps.append(step)
            ends = yield from self.evaluate([at.theta + x for x in steps], [at.b + at.move @ x for x in steps])
            hess = np.zeros((p + nf, p + nf))
            for n, i in enumerate(free):
                hess[i] = (ends[2 * n].grad - ends[2 * n + 1].grad) / (2 * steps[2 * n][i])
            hess = -(hess + hess.T) / 2
            cov[np.ix_(free, free)] = np.linalg.pinv(hess[np.ix_(free, free)])
            inv = np.nan_to_num(cov)
        # The last step is too short to matter for anything but the last digits of the estimates; the variances take it too.
        last = inv @ at.grad
        shift, (w, v, xv) = at.move @ last, at.carry
        at.theta, at.b = at.theta + last, at.b + shift
        w = np.maximum(w + v * self.cells.gather(shift) + xv @ last[:p], 0.0)
        at.spread = _Precision(self.cells, w, self.shrink(np.exp(at.theta[p:]))).variances()[0]
        return at, cov, ok


def _together(data: _Rows, models: list[_Model]) -> list[tuple[_State, np.ndarray, bool]]:
    """Runs all models side by side; each pass answers what all of them ask."""
    runs = {n: m.run() for n, m in enumerate(models)}
    asked = {n: next(r) for n, r in runs.items()}
    done: dict[int, tuple] = {}
    while asked:
        every = [q for wanted in asked.values() for q in wanted]
        sums = iter(data.answer(every))
        more = {}
        for n, wanted in asked.items():
            try:
                more[n] = runs[n].send([next(sums) for _ in wanted])
            except StopIteration as end:
                done[n] = end.value
        asked = more
    return [done[n] for n in range(len(models))]


# ---- results

@dataclass(frozen=True)
class _Fitted:
    terms: list[Term]
    beta: np.ndarray
    vcov: np.ndarray
    state: _State
    ok: bool
    n: int
    k: int

    @property
    def aicc(self) -> float | None:
        rest = self.n - self.k - 1
        return -2 * self.state.value + 2 * self.k + 2 * self.k * (self.k + 1) / rest if rest > 0 else None


def _fit(df: DataFrame, y: str, models: Mapping[str, Sequence[Term]], factors: list[str], errors: bool) -> tuple[dict[str, _Fitted], list[list], int]:
    if not 1 <= len(factors) <= 2:
        raise ValueError("one factor or two crossed ones")
    terms = _union_terms(models)
    rows, names, m, s, mean_y = _coded(df, y, terms, factors)
    try:
        if not all(names):
            raise ValueError("no row has a response and all factors")
        used = [[0, *[terms.index(t) + 1 for t in ts]] for ts in models.values()]
        data = _Rows(rows, factors, names, len(terms) + 1, [sum(1 << i for i in u) for u in used])
        all_models = [_Model(data, n, u, mean_y, errors) for n, u in enumerate(used)]
        found = _together(data, all_models)
    finally:
        rows.unpersist()
    out = {}
    for (name, ts), u, model, (at, cov, ok) in zip(models.items(), used, all_models, found):
        p = len(u)
        back = np.diag(1.0 / s[u])
        back[0, :] = -m[u] / s[u]
        back[0, 0] = 1.0
        out[name] = _Fitted(list(ts), back @ at.theta[:p], back @ cov[:p, :p] @ back.T, at, ok, model.n, p + len(factors))
    return out, names, data.passes


_DBL, _TXT = T.DoubleType(), T.StringType()


def fit_random_intercept(df: DataFrame, y: str, terms: Sequence[Term], factors: Sequence[str], errors: bool = True) -> MixedFit:
    """Fit; ``errors=False`` skips the curvature of the likelihood (enough to compare models)."""
    factors, spark = list(factors), df.sparkSession
    found, names, passes = _fit(df, y, {"model": terms}, factors, errors)
    got = found["model"]
    p, at = len(terms) + 1, got.state
    labels = [INTERCEPT, *map(term_name, terms)]
    coefs = []
    for i, nm in enumerate(labels):
        se = math.sqrt(got.vcov[i, i]) if got.vcov[i, i] > 0 else float("nan")
        est, z = float(got.beta[i]), float(got.beta[i]) / se
        coefs.append(dict(term_pos=i, term=nm, estimate=est, se=se, z=z, p_value=math.erfc(abs(z) / math.sqrt(2)), ci_lo=est - Z975 * se, ci_hi=est + Z975 * se,
                          odds_ratio=math.exp(min(est, 700)), or_lo=math.exp(min(est - Z975 * se, 700)), or_hi=math.exp(min(est + Z975 * se, 700))))
    schema = T.StructType([T.StructField("term_pos", T.IntegerType()), T.StructField("term", _TXT)] +
                          [T.StructField(c, _DBL) for c in ("estimate", "se", "z", "p_value", "ci_lo", "ci_hi", "odds_ratio", "or_lo", "or_hi")])
    random, place = [], 0
    for f, levels in zip(factors, names):
        for lv in levels:
            mode, sd = float(at.b[place]), math.sqrt(at.spread[place])
            random.append(dict(factor=f, level=str(lv), mode=mode, sd=sd, lo=mode - 1.96 * sd, hi=mode + 1.96 * sd))
            place += 1
    rschema = T.StructType([T.StructField("factor", _TXT), T.StructField("level", _TXT)] + [T.StructField(c, _DBL) for c in ("mode", "sd", "lo", "hi")])
    fit = {"n": got.n, "k": got.k, "loglik": at.value, "aicc": got.aicc, "converged": got.ok, "passes": passes}
    fields = [T.StructField("n", T.LongType()), T.StructField("k", T.IntegerType()), T.StructField("loglik", _DBL), T.StructField("aicc", _DBL),
              T.StructField("converged", T.BooleanType()), T.StructField("passes", T.IntegerType())]
    for f, t in zip(factors, at.theta[p:]):
        fit[f"sigma_{f}"] = math.exp(t)
        fields.append(T.StructField(f"sigma_{f}", _DBL))
    arr = T.ArrayType(_DBL)
    plain = dict(model="model", used=[1.0] * p, beta=list(map(float, got.beta)), vcov=list(map(float, got.vcov.ravel())), k=got.k, dispersion=1.0, n=got.n, loglik=at.value,
                 deviance=-2 * at.value, aicc=got.aicc, converged=got.ok, iterations=passes, p=[c["p_value"] for c in coefs], vif=[math.nan] * p)
    kinds = {"model": _TXT, "k": T.IntegerType(), "n": T.LongType(), "converged": T.BooleanType(), "iterations": T.IntegerType(), "used": arr, "beta": arr, "vcov": arr, "p": arr, "vif": arr}
    fixed = local_table(spark, [plain], T.StructType([T.StructField(c, kinds.get(c, _DBL)) for c in plain]))
    return MixedFit(local_table(spark, coefs, schema), local_table(spark, random, rschema), local_table(spark, [fit], T.StructType(fields)), factors,
                    Fits(fixed, [], list(terms), y, "binomial"))


def random_effects(fit: MixedFit) -> DataFrame:
    return fit.random


def mixed_diagnostics(df: DataFrame, fit: MixedFit, keep: Sequence[str] = ()) -> DataFrame:
    """Rows with their fixed and conditional linear predictors, ``fitted`` (given the intercepts of their levels) and ``y``.

    A level that the fit has not seen has intercept 0. ``quantile_residuals`` of the result are uniform if the model holds.
    """
    terms, factors = fit.fixed.terms, fit.factors
    rows = complete_cases(df, [fit.fixed.y, *base_columns(terms), *factors])
    beta = fit.fixed.table.first()["beta"]
    eta: Column = F.lit(float(beta[0]))
    for b, t in zip(beta[1:], terms):
        eta = eta + F.lit(float(b)) * _term_column(t)
    rows = rows.select(*factors, *[c for c in keep if c not in factors], F.col(fit.fixed.y).cast("double").alias("y"), eta.alias("eta_fixed"))
    for n, f in enumerate(factors):
        level = fit.random.where(F.col("factor") == f).select(F.col("level").alias("__level"), F.col("mode").alias(f"__b{n}"))
        rows = rows.withColumn("__level", F.col(f).cast("string")).join(level, "__level", "left").drop("__level")
    eta = sum((F.coalesce(f"__b{n}", F.lit(0.0)) for n in range(len(factors))), F.col("eta_fixed"))
    rows = rows.withColumn("eta", eta).withColumn("fitted", 1.0 / (1.0 + F.exp(-F.col("eta"))))
    return rows.select(F.lit("model").alias("model"), *factors, *[c for c in keep if c not in factors], "y", "eta_fixed", "eta", "fitted", (F.col("y") - F.col("fitted")).alias("resid_response"))


def mixed_standardized_effects(df: DataFrame, y: str, terms: Sequence[Term], factors: Sequence[str]) -> DataFrame:
    """Odds ratios per standard deviation (over all rows the fit uses) with their interval; p-values come from the unscaled fit."""
    cols = base_columns(terms)
    rows = complete_cases(df, [y, *cols, *factors]).select(y, *cols, *factors).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        raw = fit_random_intercept(rows, y, terms, factors).coefs.select("term", "p_value")
        std = fit_random_intercept(zscored(rows, [], cols), y, terms, factors).coefs
        return std.select("term_pos", "term", "odds_ratio", "or_lo", "or_hi").join(raw, "term")
    finally:
        rows.unpersist()


def compare_mixed_windows(df: DataFrame, y: str, features: Mapping[str, Sequence[str]], factors: Sequence[str]) -> DataFrame:
    """Random-intercept model per averaging window and feature family, ranked by AICc within the family.

    All models share their passes; each uses the rows complete in its own terms, and ``n`` says how many those are. Models with
    different ``n`` are not comparable. AICc and its difference are NULL where a model has too many parameters for its rows.
    """
    wanted = {(family, c): [c] for family, cols in features.items() for c in cols}
    models = {f"{family}\x1f{c}": ts for (family, c), ts in wanted.items()}
    found, _, _ = _fit(df, y, models, list(factors), False)
    out = []
    for family, cols in features.items():
        own = {c: found[f"{family}\x1f{c}"] for c in cols}
        best = min((f.aicc for f in own.values() if f.aicc is not None), default=None)
        out += [dict(family=family, feature=c, n=f.n, loglik=f.state.value, k=f.k, aicc=f.aicc, converged=f.ok, delta_aicc=None if f.aicc is None else f.aicc - best) for c, f in own.items()]
    schema = T.StructType([T.StructField("family", _TXT), T.StructField("feature", _TXT), T.StructField("n", T.LongType()), T.StructField("loglik", _DBL), T.StructField("k", T.IntegerType()),
                           T.StructField("aicc", _DBL), T.StructField("converged", T.BooleanType()), T.StructField("delta_aicc", _DBL)])
    return local_table(df.sparkSession, out, schema)

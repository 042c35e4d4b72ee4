"""SQL of symmetric matrices held in columns, and of logistic fits with any number of terms."""

from __future__ import annotations


def pair(name: str, i: int, j: int) -> str:
    return f"{name}_{min(i, j)}_{max(i, j)}"


def sweep_sql(rows: str, name: str, n: int) -> str:
    """``rows`` with the symmetric matrix in columns name_i_j replaced by minus its inverse; the pivots are name_piv_k."""
    for k in range(n):
        new = []
        for i in range(n):
            for j in range(i, n):
                if i == j == k:
                    e = f"-1 / {pair(name, k, k)}"
                elif k in (i, j):
                    e = f"{pair(name, i, j)} / {pair(name, k, k)}"
                else:
                    e = f"{pair(name, i, j)} - {pair(name, i, k)} * {pair(name, j, k)} / {pair(name, k, k)}"
                new.append(f"{e} AS {pair(name, i, j)}")
        old = ", ".join(pair(name, i, j) for i in range(n) for j in range(i, n))
        rows = f"SELECT * EXCLUDE ({old}), {', '.join(new)}, {pair(name, k, k)} AS {name}_piv_{k} FROM ({rows})"
    return rows


def logistic_sql(name: str, src: str, by: str, y: str, xs: list[str], steps: int = 9) -> str:
    """CTEs of Newton's method for ``y ~ xs`` per group: ``{name}`` holds b0.., the covariance v_i_j and the number of rows."""
    p = len(xs) + 1
    columns = ", ".join(f"({x})::DOUBLE AS x{i + 1}" for i, x in enumerate(xs))
    cells = [(i, j) for i in range(p) for j in range(i, p)]
    betas = ", ".join(f"b{i}" for i in range(p))
    eta = " + ".join(f"b{i} * x{i}" for i in range(p))
    sums = ", ".join([*(f"sum(w * x{i} * x{j}) AS g_{i}_{j}" for i, j in cells), *(f"sum((y - mu) * x{i}) AS s{i}" for i in range(p))])

    def at(state: str) -> str:
        rows = f"SELECT i.*, d.* EXCLUDE ({by}), {eta} AS eta FROM {state} i JOIN {name}_d d USING ({by})"
        rows = f"SELECT *, 1 / (1 + exp(-eta)) AS mu FROM ({rows})"
        rows = f"SELECT *, mu * (1 - mu) AS w FROM ({rows})"
        return sweep_sql(f"SELECT step, {by}, {betas}, count(*) AS n, {sums} FROM ({rows}) GROUP BY step, {by}, {betas}", "g", p)

    move = ", ".join(f"b{i} - (" + " + ".join(f"{pair('g', i, j)} * s{j}" for j in range(p)) + ")" for i in range(p))
    zero = ", ".join(f"0.0::DOUBLE AS b{i}" for i in range(p))
    return f"""{name}_d AS MATERIALIZED (SELECT {by}, ({y})::DOUBLE AS y, 1.0::DOUBLE AS x0, {columns} FROM {src}),
 {name}_it AS (SELECT DISTINCT 0 AS step, {by}, {zero} FROM {name}_d UNION ALL SELECT step + 1, {by}, {move} FROM ({at(name + '_it')}) WHERE step < {steps}),
 {name} AS MATERIALIZED (SELECT {by}, n, {betas}, {', '.join(f'-g_{i}_{j} AS v_{i}_{j}' for i, j in cells)} FROM ({at(f'(SELECT * FROM {name}_it WHERE step = {steps})')}))"""

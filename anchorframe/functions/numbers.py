"""Numeric expressions with the rounding, binning and missing-value rules of the analysis."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_missing(c: str | Column, dtype: str = "double") -> Column:
    """NULL, or NaN for floating columns."""
    col = _c(c)
    return col.isNull() | F.isnan(col) if dtype in ("double", "float") else col.isNull()


def row_sum(cols: Sequence[str], skip_nulls: bool = False) -> Column:
    """Sum across columns: NULL when any part is NULL, or NULLs counted as 0."""
    parts = [F.coalesce(_c(c), F.lit(0.0)) if skip_nulls else _c(c) for c in cols]
    return reduce(lambda a, b: a + b, parts)


def round_half_even(c: str | Column, digits: int = 0) -> Column:
    return F.bround(_c(c), digits)


def signif(c: str | Column, digits: int) -> Column:
    """Keep ``digits`` significant digits, halves to even; zero stays zero."""
    x = _c(c)
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.bround(x * scale, 0) / scale)


def format_effect(c: str | Column) -> Column:
    """Above ten in scientific form with two digits, otherwise three decimals."""
    x = _c(c)
    return F.when(x > 10, F.format_string("%.2e", x)).otherwise(F.format_string("%.3f", x))


def breakpoints(start: float, stop: float, step: float) -> list[float]:
    """``start + i*step`` in double arithmetic, never a running sum."""
    n = int(round((stop - start) / step))
    return [start + i * step for i in range(n + 1)]


def interval_labels(breaks: Sequence[float]) -> list[str]:
    """``[a,b]`` for the first interval and ``(a,b]`` for the others, three significant digits."""
    txt = [f"{b:.3g}" for b in breaks]
    return [("[" if i == 0 else "(") + f"{txt[i]},{txt[i + 1]}]" for i in range(len(breaks) - 1)]


def cut(c: str | Column, breaks: Sequence[float], labels: Sequence | None = None) -> Column:
    """Right-closed intervals with the lowest edge included; outside or NULL gives NULL."""
    x = _c(c)
    names = list(labels) if labels is not None else interval_labels(breaks)
    out = F.when(x < F.lit(float(breaks[0])), F.lit(None))
    for upper, name in zip(breaks[1:], names):
        out = out.when(x <= F.lit(float(upper)), F.lit(name))
    return out


def bin_fixed(c: str | Column, step: float) -> Column:
    """Equal-width right-closed bins over [0, 1]."""
    return cut(c, breakpoints(0.0, 1.0, step))


def log_odds_to_probability(eta: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))


def percent_change(estimate: str | Column) -> tuple[Column, Column]:
    """(exp(b)-1)/10 and the per-unit odds multiplier exp(b)."""
    b = _c(estimate)
    return (F.exp(b) - 1) / F.lit(10.0), F.exp(b)


def p_band(p: str | Column) -> Column:
    """Text bands for a p-value; a value exactly on a bound falls to the wider band."""
    x = _c(p)
    return (
        F.when(x.isNull() | F.isnan(x), F.lit(None).cast("string"))
        .when(x < 0.001, "<0.001")
        .when(x < 0.01, "<0.01")
        .when(x < 0.05, "<0.05")
        .otherwise(F.format_string("%.3f", x))
    )

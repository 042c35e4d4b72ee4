"""Regional models and drought conditions at events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorframe.functions.text import in_list
from anchorframe.operators.aggregates import window_mean
from anchorframe.operators.glm import Fits, Term, coef_table, fit_logistic, profile_intervals
from anchorframe.operators.joins import keyed_join
from anchorframe.operators.tables import keep_groups


def _tidy(df: DataFrame, fits: Fits, region: str, intervals: str) -> DataFrame:
    c = coef_table(fits)
    if intervals == "profile":
        p = profile_intervals(df, fits).drop("model")
        c = keyed_join(c.drop("ci_lo", "ci_hi"), p, [region, "term"]).withColumnsRenamed({"prof_lo": "ci_lo", "prof_hi": "ci_hi"})
    return c.select(region, "term", "estimate", "ci_lo", "ci_hi", F.exp("estimate").alias("odds_ratio"),
                    F.exp("ci_lo").alias("or_lo"), F.exp("ci_hi").alias("or_hi"), "p_value")


def regional_models(df: DataFrame, y: str, region: str, terms: Sequence[Term], overrides: Mapping[str, Sequence[Term]] = {},
                    min_cases: int = 71, intervals: str = "wald") -> DataFrame:
    """Tidy coefficients of one logistic model per region with enough cases.

    ``overrides`` names regions with their own terms. Regions with the same terms are fitted together.
    """
    rows = keep_groups(df, [region], min_rows=min_cases, where=F.col(y) == 1)
    special: dict[tuple, list[str]] = {}
    for name, own in overrides.items():
        special.setdefault(tuple(own), []).append(name)
    usual = rows.filter(~in_list(region, list(overrides))) if overrides else rows
    parts = [_tidy(usual, fit_logistic(usual, y, [region], terms), region, intervals)]
    for own, names in special.items():
        part = rows.filter(in_list(region, names))
        parts.append(_tidy(part, fit_logistic(part, y, [region], list(own)), region, intervals))
    return reduce(lambda a, b: a.unionByName(b), parts)


def drought_at_event(daily: DataFrame, region: str, id_col: str, measures: Sequence[str], min_events: int = 10,
                     half_window: int = 5, overall: str = "all regions", offset: str = "offset") -> DataFrame:
    """Mean index around each event by region (regions with enough events), and of all events over all regions."""
    kept = keep_groups(daily, [region], min_distinct=min_events, distinct_col=id_col)
    means = window_mean(kept, [region, id_col], measures, -half_window, half_window, offset)
    whole = window_mean(daily, [id_col], measures, -half_window, half_window, offset)
    return means.unionByName(whole.withColumn(region, F.lit(overall)))

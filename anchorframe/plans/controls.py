"""Choosing controls: range exclusion, two matching passes, and one acceptable date per control."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorframe.functions.dates import day_offset
from anchorframe.operators.sampling import case_counts, match_distribution, one_per_entity, padded_target
from anchorframe.operators.tables import beyond_case_range, range_limits
from anchorframe.session import materialize


@dataclass(frozen=True)
class ControlStages:
    """Controls left after each step."""

    in_range: DataFrame
    crop_matched: DataFrame
    matched: DataFrame


def select_controls(cases: DataFrame, controls: DataFrame, region: str, ids: Sequence[str], water: str,
                    developed: Sequence[str], crop: str, hay: str, seed, mult: int = 5) -> ControlStages:
    """Exclude controls beyond the case range, then match the crop and the hay distribution per region.

    Each stage is written once because the next one reads it several times.
    """
    limits = range_limits(cases, [region], [water, *developed])
    in_range = materialize(beyond_case_range(controls, limits, [region], [water], developed))
    crop_matched = materialize(match_distribution(
        in_range, cases, [region], crop, 0.05, padded_target(cases, [region], mult), "half_even", seed, ids))
    matched = match_distribution(
        crop_matched, cases, [region], hay, 0.1, case_counts(cases, [region], "target"), "floor", seed, ids)
    return ControlStages(in_range, crop_matched, matched)


def accumulated_on_day(daily: DataFrame, by: Sequence[str], measure: str, obs: str, anchor: str) -> DataFrame:
    """Sum of a measure on the event day (the 24 hours from the anchor); missing and NaN values are left out."""
    rows = daily.withColumn("__d", day_offset(obs, anchor, "floor")).filter((F.col("__d") > -1) & (F.col("__d") < 1))
    return rows.groupBy(*by).agg(F.sum(F.nanvl(F.col(measure).cast("double"), F.lit(None))).alias("accumulated"))


def restrict_dates(case_daily: DataFrame, control_daily: DataFrame, region: str, id_col: str, replicate: str,
                   measure: str, obs: str, anchor: str, seed) -> DataFrame:
    """One random date per control among those no wetter than the region's wettest case."""
    cases = accumulated_on_day(case_daily, [region, id_col], measure, obs, anchor)
    controls = accumulated_on_day(control_daily, [region, id_col, replicate], measure, obs, anchor)
    kept = beyond_case_range(controls, range_limits(cases, [region], ["accumulated"]), [region], ["accumulated"])
    return one_per_entity(kept.select(id_col, replicate), [id_col], seed, [id_col, replicate])

"""Presence/absence tables: lagged cover, drought and weather windows for cases and for controls."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorframe.functions.dates import day_offset
from anchorframe.operators.aggregates import DROUGHT_WINDOWS, WEATHER_WINDOWS, event_window_agg, window_specs
from anchorframe.operators.joins import keyed_join, lagged_period_join, pair_semi_join, semi_join
from anchorframe.operators.ranking import attach
from anchorframe.operators.sampling import dedupe_multi_region, rebalance_controls
from anchorframe.operators.tables import shared_columns_union
from anchorframe.session import materialize


@dataclass(frozen=True)
class Names:
    """Column names of the study tables."""

    id: str = "event_id"
    region: str = "region"
    date: str = "ig_date"
    obs: str = "obs_date"
    anchor: str = "anchor"
    year: str = "year"
    replicate: str = "ignition_id"


def percent_woody(events: DataFrame, woody: DataFrame, evaluated: DataFrame, n: Names) -> DataFrame:
    """Woody share of the evaluated area in the year before each event."""
    yearly = keyed_join(woody, evaluated, [n.id, n.year], "full")
    yearly = yearly.withColumn("percent_woody", F.try_divide("woody_hectares", "evaluated_hectares"))
    return lagged_period_join(events, yearly.select(n.id, n.year, "percent_woody"), n.id, n.date, n.year).drop(n.year)


def drought_features(daily: DataFrame, by: Sequence[str], n: Names) -> DataFrame:
    """Window means of the two drought indices; day 0 covers the 48 hours around the event."""
    rows = daily.withColumn("offset", day_offset(n.obs, n.anchor, "trunc"))
    return event_window_agg(rows, by, window_specs(["spei14d", "pdsi"], DROUGHT_WINDOWS))


def weather_features(daily: DataFrame, by: Sequence[str], n: Names) -> DataFrame:
    """Window means of vapour pressure deficit and wind speed by calendar day."""
    rows = daily.withColumn("offset", day_offset(n.obs, n.anchor, "date"))
    return event_window_agg(rows, by, window_specs(["vpd", "vs"], WEATHER_WINDOWS))


def _in_range(date: str, start: str, end: str) -> Column:
    return F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def build_presence(events: DataFrame, woody: DataFrame, evaluated: DataFrame, drought: DataFrame, weather: DataFrame,
                   start: str, end: str, names: Names = Names()) -> DataFrame:
    """One row per (case, region) in the date range with all features and ``pa`` = 1."""
    n = names
    base = percent_woody(events.filter(_in_range(n.date, start, end)).select(n.id, n.region, n.date), woody, evaluated, n)
    out = attach(attach(base, drought_features(drought, [n.id], n), [n.id]), weather_features(weather, [n.id], n), [n.id])
    return out.withColumn("pa", F.lit(1))


def build_absence(controls: DataFrame, kept: DataFrame, chosen: DataFrame, woody: DataFrame, evaluated: DataFrame,
                  drought: DataFrame, weather: DataFrame, start: str, end: str, names: Names = Names()) -> DataFrame:
    """The same for controls that survived matching, at the one date chosen for each; ``pa`` = 0.

    Daily tables hold every date replicate of a control; only the chosen (control, replicate) is used.
    """
    n = names
    rows = semi_join(controls.filter(_in_range(n.date, start, end)), kept, [n.id])
    rows = pair_semi_join(rows, chosen, n.id, n.replicate, n.replicate)
    base = percent_woody(rows.select(n.id, n.region, n.date), woody, evaluated, n)
    pick = lambda daily: pair_semi_join(daily, chosen, n.id, n.replicate, n.replicate)
    out = attach(attach(base, drought_features(pick(drought), [n.id], n), [n.id]), weather_features(pick(weather), [n.id], n), [n.id])
    return out.withColumn("pa", F.lit(0))


def presence_absence(presence: DataFrame, absence: DataFrame, seed, names: Names = Names()) -> tuple[DataFrame, DataFrame]:
    """(small-region table, large-region table).

    The large-region table keeps one region per case and then removes as many controls from each region
    as it lost cases.
    """
    fine = materialize(shared_columns_union(presence, absence))  # both tables and the dedupe start from it
    cases, controls = fine.filter("pa = 1"), fine.filter("pa = 0")
    kept, _, dropped = dedupe_multi_region(cases, names.id, names.region, seed)
    coarse = rebalance_controls(kept.unionByName(controls), names.region, dropped, seed, [names.id, names.region])
    return fine, coarse

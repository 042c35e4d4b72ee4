"""Event windows and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorframe.catalog.base import query, rounded, rsql
from anchorframe.catalog.proxies import ANCHORS, OBS, anchored_events, observation_days
from anchorframe.functions.dates import calendar_parts, day_offset, decade_bucket, trailing_date, year_index
from anchorframe.operators.aggregates import (
    DROUGHT_WINDOWS, WIND_MAX_WINDOWS, event_window_agg, event_window_agg_moments, window_mean, window_specs)
from anchorframe.operators.tables import with_overall_group
from anchorframe.sources.io import date_spine

SPECS = window_specs(["value"], DROUGHT_WINDOWS) + window_specs(["value"], WIND_MAX_WINDOWS, "max")


def _sql_windows(specs) -> str:
    fns = {"mean": "avg", "max": "max", "sum": "sum"}
    return ", ".join(
        rsql(f'{fns[s.fn]}(CASE WHEN "offset" BETWEEN {s.lo} AND {s.hi} THEN {s.measure} END)') + f" AS {s.out}"
        for s in specs)


@query("event_window_features", f"WITH {OBS} SELECT user_id, {_sql_windows(SPECS)} FROM obs GROUP BY user_id")
def event_window_features(t):
    return rounded(event_window_agg_moments(observation_days(t), ["user_id"], SPECS))


@query("event_window_sparse", f"""WITH {OBS} SELECT user_id, event_type, {_sql_windows(SPECS)} FROM obs
 GROUP BY user_id, event_type""")
def event_window_sparse(t):
    """Per event type, so that some windows are empty; observations already carry their anchor."""
    e = anchored_events(t).withColumn("offset", day_offset("ts", "anchor_ts"))
    return rounded(event_window_agg(e, ["user_id", "event_type"], SPECS))


_RAW = "((epoch_us(ts) - epoch_us(anchor_ts)) / 86400000000.0::DOUBLE)"


@query("day_offset_modes", f"""WITH {OBS}, m AS (SELECT event_type, "offset"::INTEGER AS d, floor({_RAW})::INTEGER AS f,
 trunc({_RAW})::INTEGER AS tr, abs({_RAW}) AS ab FROM obs)
 SELECT event_type, d AS offset_date, f AS offset_floor, tr AS offset_trunc, count(*) AS n, {rsql('avg(ab)')} AS mean_abs
 FROM m GROUP BY ALL""")
def day_offset_modes(t):
    e = anchored_events(t)
    m = e.select("event_type", *[day_offset("ts", "anchor_ts", k).alias(f"offset_{k}")
                                 for k in ("date", "floor", "trunc", "abs")])
    return rounded(m.groupBy("event_type", "offset_date", "offset_floor", "offset_trunc").agg(
        F.count(F.lit(1)).alias("n"), F.avg("offset_abs").alias("mean_abs")))


@query("accumulated_day0", f"""WITH {ANCHORS} SELECT user_id, round(sum(value), 6) AS accumulated, count(*) AS n_obs
 FROM events JOIN anchors USING (user_id)
 WHERE floor((epoch_us(ts) - epoch_us(anchor_ts)) / 86400000000.0::DOUBLE) = 0 GROUP BY user_id""")
def accumulated_day0(t):
    e = anchored_events(t).withColumn("d", day_offset("ts", "anchor_ts", "floor"))
    return rounded(e.filter((F.col("d") > -1) & (F.col("d") < 1)).groupBy("user_id").agg(
        F.sum("value").alias("accumulated"), F.count(F.lit(1)).alias("n_obs")))


@query("drought_at_event", f"""WITH {OBS}, w AS (SELECT event_type AS region, user_id, avg(value) AS value FROM obs
 WHERE "offset" BETWEEN -5 AND 5 GROUP BY 1, 2), o AS (SELECT 'all types' AS region, user_id, avg(value) AS value FROM obs
 WHERE "offset" BETWEEN -5 AND 5 GROUP BY 2)
 SELECT region, user_id, {rsql('value')} AS value FROM w UNION ALL SELECT region, user_id, {rsql('value')} FROM o""")
def drought_at_event(t):
    """Mean within five days of the event by region, and once more over all regions."""
    days = observation_days(t, ("event_type",)).withColumnRenamed("event_type", "region")
    both = with_overall_group(days, "region", "all types")
    specs = window_specs(["value"], [(-5, 5)])
    inside = both.filter(F.col("offset").between(-5, 5))
    out = event_window_agg_moments(inside, ["region", "user_id"], specs)
    return rounded(out.select("region", "user_id", F.col(specs[0].out).alias("value")))


@query("window_mean_by_type", f"""WITH {OBS} SELECT event_type, "offset"::INTEGER AS day, {rsql('avg(value)')} AS value
 FROM obs WHERE "offset" BETWEEN -3 AND 3 GROUP BY 1, 2""")
def window_mean_by_type(t):
    e = anchored_events(t).withColumn("offset", day_offset("ts", "anchor_ts"))
    return rounded(window_mean(e.withColumn("day", F.col("offset")), ["event_type", "day"], ["value"], -3, 3))


@query("calendar_parts", """SELECT year(o_orderdate)::INTEGER AS year, dayofyear(o_orderdate)::INTEGER AS day_of_year,
 month(o_orderdate)::INTEGER AS month, strftime(o_orderdate, '%b') AS month_abbr,
 (year(o_orderdate) - 1990)::INTEGER AS year_index,
 (CASE WHEN year(o_orderdate) - 1990 <= 10 THEN 1 WHEN year(o_orderdate) - 1990 < 20 THEN 2 ELSE 3 END)::INTEGER AS decade,
 count(*) AS n FROM orders
 WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' GROUP BY ALL""")
def calendar(t):
    o = t.orders.filter(F.to_date("o_orderdate").between(F.lit("1996-01-01").cast("date"), F.lit("2000-12-31").cast("date")))
    idx = year_index("o_orderdate", 1990)
    parts = o.select(*calendar_parts("o_orderdate"), idx.alias("year_index"), decade_bucket(idx).alias("decade"))
    return parts.groupBy(*parts.columns).agg(F.count(F.lit(1)).alias("n"))


@query("trailing_date", """SELECT o_orderkey, 'AL31' || o_custkey || strftime(o_orderdate, '%Y%m%d') AS event_id,
 CAST(o_orderdate AS DATE) AS event_date FROM orders""")
def trailing(t):
    ids = F.concat(F.lit("AL31"), F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyyMMdd"))
    return t.orders.select("o_orderkey", ids.alias("event_id")).withColumn("event_date", trailing_date("event_id"))


@query("date_spine", """WITH b AS (SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS z FROM orders),
 s AS (SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS date FROM b),
 n AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1)
 SELECT date, coalesce(n, 0) AS n_orders FROM s LEFT JOIN n USING (date)""")
def spine(t):
    b = t.orders.agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("z"))
    n = t.orders.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("n_orders"))
    days = date_spine(b, "a", "z").select("date")
    return days.join(n, "date", "left").withColumn("n_orders", F.coalesce("n_orders", F.lit(0)))

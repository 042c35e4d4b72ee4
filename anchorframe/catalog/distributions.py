"""Distribution summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorframe.catalog.base import query, rounded, rsql
from anchorframe.catalog.proxies import OBS, REG_ORDERS, anchored_events, regional_orders
from anchorframe.functions.classes import drought_class
from anchorframe.functions.dates import day_offset
from anchorframe.operators.distributions import DENSITY_CELLS, density, histogram, quantile_band, seasonal_density


def _hist_sql(src: str, by: str, col: str, bins: int, free: bool) -> str:
    over = f"PARTITION BY {by}" if free else ""
    return f"""SELECT {by}, bin, width, count(*) AS n, {rsql('min(lo) + bin * width')} AS center FROM (SELECT {by}, lo, (hi - lo) / {bins - 1}.0::DOUBLE AS width,
 greatest(0, ceil(({col} - lo) / ((hi - lo) / {bins - 1}.0::DOUBLE) - 0.5))::INTEGER AS bin FROM
 (SELECT {by}, {col}, min({col}) OVER ({over}) AS lo, max({col}) OVER ({over}) AS hi FROM {src})) GROUP BY {by}, bin, width"""


@query("histogram", f"WITH {REG_ORDERS} SELECT region, bin, n, center FROM ({_hist_sql('reg_orders', 'region', 'o_totalprice', 30, False)})")
def hist(t):
    return rounded(histogram(regional_orders(t), "o_totalprice", 30, ["region"]).drop("width"))


@query("histogram_free", f"WITH {REG_ORDERS} SELECT nation, bin, n, center FROM ({_hist_sql('reg_orders', 'nation', 'o_totalprice', 20, True)})")
def hist_free(t):
    return rounded(histogram(regional_orders(t), "o_totalprice", 20, ["nation"], free=True).drop("width"))


_BW = """SELECT {keys}, count(*) AS n, min(v) AS lo, max(v) AS hi,
 0.9::DOUBLE * least(stddev_samp(v), (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34::DOUBLE) * pow(count(*), -0.2::DOUBLE) AS bw FROM {src} GROUP BY {keys}"""


def _curve_sql(src: str, groups: str, keys: str, params: str, n: int) -> str:
    """Kernel curve CTEs mirroring the linear split onto cells; result is ``curve``."""
    last = f"{DENSITY_CELLS - 1}.0::DOUBLE"
    return f"""p AS ({params}),
 pos AS (SELECT s.*, (v - lo) / (hi - lo) * {last} AS ps FROM {src} s JOIN p USING ({keys})),
 parts AS (SELECT {groups}, least(floor(ps), {DENSITY_CELLS - 2})::INTEGER AS c, 1 - (ps - least(floor(ps), {DENSITY_CELLS - 2})) AS w FROM pos
  UNION ALL SELECT {groups}, least(floor(ps), {DENSITY_CELLS - 2})::INTEGER + 1, ps - least(floor(ps), {DENSITY_CELLS - 2}) FROM pos),
 cells AS (SELECT {groups}, c, sum(w) AS w FROM parts GROUP BY ALL HAVING sum(w) > 0),
 tot AS (SELECT {groups}, sum(w) AS total FROM cells GROUP BY ALL),
 curve AS (SELECT {groups}, g AS grid, p.lo + (p.hi - p.lo) * g / {n - 1}.0::DOUBLE AS x,
  sum(exp(-0.5::DOUBLE * pow((p.lo + (p.hi - p.lo) * g / {n - 1}.0::DOUBLE - (p.lo + (p.hi - p.lo) * c / {last})) / bw, 2)) * w / (total * bw * 2.5066282746310002::DOUBLE)) AS density
  FROM cells JOIN tot USING ({groups}) JOIN p USING ({keys}) CROSS JOIN (SELECT unnest(generate_series(0, {n - 1}))::INTEGER AS g) GROUP BY ALL)"""


@query("density", f"""WITH src AS (SELECT event_type, value AS v FROM events), {_curve_sql('src', 'event_type', 'event_type', _BW.format(keys='event_type', src='src'), 512)}
 SELECT event_type, grid, {rsql('x')} AS x, {rsql('density * 1000')} AS density FROM curve""")
def kde(t):
    d = density(t.events, "value", ["event_type"])
    return rounded(d.withColumn("density", F.col("density") * 1000))


@query("seasonal_density", f"""WITH {REG_ORDERS}, src AS (SELECT region, month(o_orderdate)::INTEGER AS month, dayofyear(o_orderdate)::DOUBLE + o_totalprice / 1000000 AS v FROM reg_orders WHERE pa = 1),
 m AS ({_BW.format(keys='region, month', src='src')}),
 {_curve_sql('src', 'region, month', 'region', 'SELECT region, avg(bw) AS bw, min(lo) AS lo, max(hi) AS hi FROM m GROUP BY 1', 128)},
 top AS (SELECT region, max(density) AS top FROM curve GROUP BY 1)
 SELECT region, month, grid, {rsql('x')} AS x, {rsql('density')} AS density FROM curve JOIN top USING (region) WHERE density >= 0.01::DOUBLE * top""")
def season(t):
    d = regional_orders(t).filter("pa = 1").select(
        "region", F.month("o_orderdate").alias("month"),
        (F.dayofyear("o_orderdate").cast("double") + F.col("o_totalprice") / 1000000).alias("v"))
    return rounded(seasonal_density(d, "v", "month", ["region"], n=128))


_BAND_SRC = OBS + """, b AS (SELECT CASE WHEN value / 20 - 5 <= -4 THEN 'Extreme Drought' WHEN value / 20 - 5 < 0 THEN 'Drought' ELSE 'wet' END AS zone,
 "offset"::INTEGER AS day, value FROM obs)"""


def _band(t):
    e = anchored_events(t)
    return e.select(drought_class(F.col("value") / 20 - 5, "pdsi_zone").alias("zone"), day_offset("ts", "anchor_ts").alias("day"), "value")


@query("quantile_band", f"""WITH {_BAND_SRC} SELECT zone, day, q, {rsql('CASE q WHEN 0.1::DOUBLE THEN q1 WHEN 0.5 THEN q5 ELSE q9 END')} AS value FROM
 (SELECT zone, day, quantile_cont(value, 0.1) AS q1, quantile_cont(value, 0.5) AS q5, quantile_cont(value, 0.9) AS q9 FROM b GROUP BY 1, 2)
 CROSS JOIN (SELECT unnest([0.1::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE]) AS q)""")
def band(t):
    return rounded(quantile_band(_band(t), "day", "value", ["zone"])).withColumn("q", F.round("q", 1))


@query("quantile_band_pooled", f"""WITH {_BAND_SRC}, d AS (SELECT DISTINCT zone, day FROM b) SELECT d.zone, d.day, 0.5::DOUBLE AS q, {rsql('quantile_cont(value, 0.5)')} AS value
 FROM d JOIN b ON d.zone = b.zone AND b.day BETWEEN d.day - 2 AND d.day + 2 GROUP BY 1, 2""")
def band_pooled(t):
    return rounded(quantile_band(_band(t), "day", "value", ["zone"], [0.5], pool_days=2)).withColumn("q", F.round("q", 1))

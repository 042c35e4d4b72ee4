"""How the study concepts map onto the supplied tables, as frames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorframe.catalog.base import Tables
from anchorframe.functions.dates import day_offset
from anchorframe.operators.aggregates import daily_moments
from anchorframe.operators.joins import anchor_join

FIRST_ANCHOR_DAY = "2024-01-11"


def anchors(t: Tables) -> DataFrame:
    """Dated events: each user's first purchase from day 10 on."""
    e = t.events.filter((F.col("event_type") == "purchase")
                        & (F.col("ts") >= F.lit(FIRST_ANCHOR_DAY).cast("timestamp_ntz")))
    return e.groupBy("user_id").agg(F.min("ts").alias("anchor_ts"))


ANCHORS = """anchors AS (SELECT user_id, min(ts) AS anchor_ts FROM events
 WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-11 00:00:00' GROUP BY user_id)"""


def anchored_events(t: Tables) -> DataFrame:
    """Every event with its user's anchor."""
    return anchor_join(t.events, anchors(t), ["user_id"])


def observation_days(t: Tables, extra: tuple[str, ...] = ()) -> DataFrame:
    """Daily partial sums of ``value`` per user joined to the anchor, with the day offset.

    Reducing to user-days first bounds what one user can send to the join.
    """
    days = daily_moments(t.events.withColumn("obs_date", F.to_date("ts")), ["user_id", *extra, "obs_date"], ["value"])
    return anchor_join(days, anchors(t), ["user_id"]).withColumn("offset", day_offset("obs_date", "anchor_ts"))


OBS = ANCHORS + """, obs AS (SELECT e.*, a.anchor_ts, date_diff('day', CAST(a.anchor_ts AS DATE), CAST(e.ts AS DATE)) AS "offset"
 FROM events e JOIN anchors a USING (user_id))"""


def regions(t: Tables) -> DataFrame:
    """Customer with nation (the small region) and region (the large one)."""
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


REGIONS = """regions AS (SELECT c_custkey AS o_custkey, n_name AS nation, r_name AS region
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def regional_orders(t: Tables) -> DataFrame:
    """Orders as events: status F are cases (pa 1), O are controls (pa 0), P neither."""
    pa = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0)
    return t.orders.join(regions(t), "o_custkey").withColumn("pa", pa)


REG_ORDERS = REGIONS + """, reg_orders AS (SELECT o.*, nation, region,
 CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS pa FROM orders o JOIN regions USING (o_custkey))"""


def order_cover(t: Tables) -> DataFrame:
    """Cases and controls with cover shares: each order's quantity share by discount and tax level.

    crop is the share of quantity sold at a discount above 5 %, hay the share taxed above 6 %.
    """
    q = F.col("l_quantity")
    li = t.lineitem.groupBy("l_orderkey").agg(
        F.sum(q).alias("q"), F.sum(F.when(F.col("l_discount") > 0.05, q).otherwise(0.0)).alias("qc"),
        F.sum(F.when(F.col("l_tax") > 0.06, q).otherwise(0.0)).alias("qh"))
    o = regional_orders(t).filter(F.col("pa").isNotNull())
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "o_orderkey", "nation", "region", "pa", "o_orderdate", "o_totalprice",
        (F.col("qc") / F.col("q")).alias("crop"), (F.col("qh") / F.col("q")).alias("hay"))


COVER = REG_ORDERS + """, cover AS (SELECT o_orderkey, nation, region, pa, o_orderdate, o_totalprice, qc / q AS crop, qh / q AS hay
 FROM reg_orders JOIN (SELECT l_orderkey, sum(l_quantity) AS q,
   sum(CASE WHEN l_discount > 0.05::DOUBLE THEN l_quantity ELSE 0.0 END)::DOUBLE AS qc,
   sum(CASE WHEN l_tax > 0.06::DOUBLE THEN l_quantity ELSE 0.0 END)::DOUBLE AS qh
   FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey WHERE pa IS NOT NULL)"""

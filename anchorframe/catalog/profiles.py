"""Group profiles, audits and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorframe.catalog.base import query, rounded, rsql
from anchorframe.catalog.proxies import COVER, REG_ORDERS, order_cover, regional_orders
from anchorframe.catalog.tables import _SHARES, _TYPES, _class_shares
from anchorframe.operators.aggregates import (
    bad_value_report, balance_report, correlation_matrix, max_all_numeric, mean_profile_long, mismatches, reconcile, reconcile_summary, row_audit,
    share_below, share_in_group, value_profile)
from anchorframe.operators.tables import pivot_wide
from anchorframe.session import materialize


@query("max_all_numeric", """SELECT l_returnflag, max(l_quantity) AS l_quantity, max(l_extendedprice) AS l_extendedprice, max(l_discount) AS l_discount, max(l_tax) AS l_tax,
 max(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1""")
def maxima(t):
    return max_all_numeric(t.lineitem.select("l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_linestatus"), ["l_returnflag"])


@query("mean_profile_long", f"""WITH {_SHARES}, n AS (SELECT DISTINCT l_orderkey, o_orderpriority FROM sh JOIN orders ON l_orderkey = o_orderkey),
 x AS (SELECT n.o_orderpriority AS priority, c.cls AS nlcd_class, coalesce(share, 0.0) AS share FROM n CROSS JOIN (SELECT unnest({_TYPES}) AS cls) c
  LEFT JOIN sh ON sh.l_orderkey = n.l_orderkey AND sh.p_type = c.cls)
 SELECT priority, nlcd_class, {rsql('avg(share)')} AS mean_share FROM x GROUP BY 1, 2""")
def profile(t):
    wide = pivot_wide(_class_shares(t), ["l_orderkey"], "p_type", "share", _TYPES)
    s = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("priority"))
    return rounded(mean_profile_long(wide.join(s, "l_orderkey").drop("l_orderkey"), ["priority"], "nlcd_class", "mean_share"))


@query("share_in_group", f"""WITH {REG_ORDERS} SELECT nation, o_orderpriority, count(*) AS n, {rsql('(count(*) / sum(count(*)) OVER (PARTITION BY nation))::DOUBLE')} AS share
 FROM reg_orders GROUP BY 1, 2""")
def shares(t):
    return rounded(share_in_group(regional_orders(t), ["nation"], "o_orderpriority"))


_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _profile_sql(c):
    return f"""SELECT '{c}' AS variable, {rsql(f'avg({c})')} AS mean, count(*) - count({c}) AS n_missing, round(min({c}), 6) AS min,
 {rsql(f'quantile_cont({c}, 0.25)')} AS q25, {rsql(f'quantile_cont({c}, 0.5)')} AS median, {rsql(f'quantile_cont({c}, 0.75)')} AS q75, round(max({c}), 6) AS max FROM x"""


@query("value_profile", "WITH x AS (SELECT l_quantity, l_extendedprice, l_discount, CASE WHEN l_tax > 0 THEN l_tax END AS l_tax FROM lineitem) "
       + " UNION ALL ".join(_profile_sql(c) for c in _COLS))
def profile5(t):
    x = t.lineitem.select("l_quantity", "l_extendedprice", "l_discount", F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("l_tax"))
    return rounded(value_profile(x, _COLS))


@query("correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {'1.0::DOUBLE' if a == b else rsql(f'corr({a}, {b})')} AS r" + ("" if a == b else " FROM lineitem")
    for a in _COLS for b in _COLS))
def correlations(t):
    return rounded(correlation_matrix(t.lineitem, _COLS))


@query("bad_value_report", """SELECT 'discount' AS variable, count(CASE WHEN l_quantity < 5 THEN 1 END) AS n_null, count(CASE WHEN l_quantity > 45 THEN 1 END) AS n_nan,
  count(CASE WHEN l_quantity BETWEEN 5 AND 45 AND l_discount = 0 THEN 1 END) AS n_zero, count(CASE WHEN l_quantity BETWEEN 5 AND 45 AND l_discount <> 0 THEN 1 END) AS n_usable FROM lineitem
 UNION ALL SELECT 'l_tax', 0, 0, count(CASE WHEN l_tax = 0 THEN 1 END), count(CASE WHEN l_tax <> 0 THEN 1 END) FROM lineitem""")
def bad_values(t):
    q = F.col("l_quantity")
    x = t.lineitem.select(F.when(q < 5, None).when(q > 45, F.lit(float("nan"))).otherwise(F.col("l_discount")).alias("discount"), "l_tax")
    return bad_value_report(x, ["discount", "l_tax"])


@query("share_below", f"""WITH {REG_ORDERS} SELECT nation, {rsql('avg(CASE WHEN o_totalprice < 100000 THEN 1.0::DOUBLE ELSE 0.0 END)')} AS share FROM reg_orders GROUP BY 1""")
def below(t):
    return rounded(regional_orders(t).groupBy("nation").agg(share_below("o_totalprice", 100000).alias("share")))


@query("row_audit", f"""WITH {COVER}, c AS (SELECT nation, count(*) AS n FROM cover WHERE pa = 1 GROUP BY 1), a AS (SELECT nation, count(*) AS n FROM cover WHERE pa = 0 GROUP BY 1),
 b AS (SELECT nation, count(*) AS n FROM cover WHERE pa = 0 AND crop <= 0.6::DOUBLE GROUP BY 1), d AS (SELECT nation, count(*) AS n FROM cover WHERE pa = 0 AND crop <= 0.6::DOUBLE AND hay <= 0.3::DOUBLE GROUP BY 1)
 SELECT nation, c.n AS n_cases, a.n AS n_start, b.n AS n_crop, d.n AS n_hay, a.n - c.n AS excess_start, b.n - c.n AS excess_crop, d.n - c.n AS excess_hay
 FROM c FULL JOIN a USING (nation) FULL JOIN b USING (nation) FULL JOIN d USING (nation)""")
def audit(t):
    d = materialize(order_cover(t))
    controls = d.filter("pa = 0")
    crop = controls.filter(F.col("crop") <= 0.6)
    return row_audit({"start": controls, "crop": crop, "hay": crop.filter(F.col("hay") <= 0.3)}, d.filter("pa = 1"), ["nation"])


def _balance_sql(c):
    parts = []
    for s, cond in (("case", "pa = 1"), ("control_before", "pa = 0"), ("control_after", "pa = 0 AND crop <= 0.6::DOUBLE")):
        parts.append(f"{rsql(f'avg({c}) FILTER ({cond})')} AS {s}_mean, {rsql(f'quantile_cont({c}, 0.5) FILTER ({cond})')} AS {s}_median")
    return f"SELECT region, '{c}' AS variable, {', '.join(parts)} FROM cover GROUP BY 1"


@query("balance_report", f"WITH {COVER} {_balance_sql('crop')} UNION ALL {_balance_sql('hay')}")
def balance(t):
    d = order_cover(t)
    controls = d.filter("pa = 0")
    return rounded(balance_report(d.filter("pa = 1"), controls, controls.filter(F.col("crop") <= 0.6), ["region"], ["crop", "hay"]))


def _reconciled(t):
    old = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("o_totalprice"))
    return reconcile(t.orders.select("o_orderkey", "o_totalprice"), old, ["o_orderkey"], ["o_totalprice"], 100000)


_RECONCILED = """n AS (SELECT o_orderkey, o_totalprice FROM orders), o AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS o_totalprice FROM lineitem GROUP BY 1),
 d AS (SELECT n.o_orderkey, n.o_totalprice AS new, o.o_totalprice AS old, abs(n.o_totalprice - o.o_totalprice) AS diff FROM n LEFT JOIN o ON n.o_orderkey = o.l_orderkey)"""


@query("reconcile_summary", f"""WITH {_RECONCILED} SELECT 'o_totalprice' AS variable, count(*) AS n, count(*) - count(old) AS n_missing, count(CASE WHEN diff > 100000 THEN 1 END) AS n_above,
 {rsql('max(diff)', 4)} AS max_diff, {rsql('avg(diff)', 4)} AS mean_diff FROM d""")
def reconciled_summary(t):
    return rounded(reconcile_summary(_reconciled(t), ["o_totalprice"]), 4)


@query("reconcile_mismatches", f"WITH {_RECONCILED} SELECT o_orderkey, 'o_totalprice' AS variable, {rsql('new', 4)} AS new, {rsql('old', 4)} AS old, {rsql('diff', 4)} AS diff FROM d WHERE diff > 100000")
def reconciled_mismatches(t):
    return rounded(mismatches(_reconciled(t), ["o_orderkey"], ["o_totalprice"]), 4)


@query("reconcile", """WITH n AS (SELECT o_orderkey, o_totalprice FROM orders), o AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS o_totalprice FROM lineitem GROUP BY 1)
 SELECT n.o_orderkey, n.o_totalprice AS o_totalprice_new, o.o_totalprice AS o_totalprice_old, round(abs(n.o_totalprice - o.o_totalprice), 4) AS o_totalprice_diff,
 round(abs(n.o_totalprice - o.o_totalprice) / n.o_totalprice, 6) AS o_totalprice_rel, coalesce(abs(n.o_totalprice - o.o_totalprice) > 100000, false) AS o_totalprice_above
 FROM n LEFT JOIN o ON n.o_orderkey = o.l_orderkey""")
def reconciled(t):
    out = _reconciled(t)
    return out.withColumn("o_totalprice_diff", F.round("o_totalprice_diff", 4)).withColumn("o_totalprice_rel", F.round("o_totalprice_rel", 6))

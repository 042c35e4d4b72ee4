"""Missing values, reshaping and group filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorframe.catalog.base import query, rounded, rsql
from anchorframe.catalog.proxies import REG_ORDERS, regional_orders
from anchorframe.operators.tables import (
    beyond_case_range, complete_cases, duplicate_entities, fill_missing, keep_groups, pivot_wide, range_limits,
    rows_with_missing, unpivot_long, with_group_stats, with_overall_group)


@query("keep_groups", f"""WITH {REG_ORDERS}, g AS (SELECT nation FROM reg_orders GROUP BY 1 HAVING count(CASE WHEN pa = 1 THEN 1 END) >= 190)
 SELECT nation, pa, count(*) AS n FROM reg_orders WHERE nation IN (SELECT nation FROM g) GROUP BY ALL""")
def keep(t):
    kept = keep_groups(regional_orders(t), ["nation"], min_rows=190, where=F.col("pa") == 1)
    return kept.groupBy("nation", "pa").agg(F.count(F.lit(1)).alias("n"))


@query("keep_groups_distinct", """SELECT l_suppkey, l_shipdate, l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN
 (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 520)""")
def keep_distinct(t):
    li = t.lineitem.select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    return keep_groups(li, ["l_suppkey"], min_distinct=520, distinct_col="l_partkey").drop("l_partkey")


def _holey(t):
    li = t.lineitem
    return li.select("l_orderkey", "l_linenumber", "l_partkey",
                     F.when(F.col("l_tax") > 0.01, F.col("l_tax")).alias("tax"),
                     F.when(F.col("l_discount") < 0.09, F.col("l_discount")).otherwise(F.lit(float("nan"))).alias("discount"))


_HOLEY = """h AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax > 0.01::DOUBLE THEN l_tax END AS tax,
 CASE WHEN l_discount < 0.09::DOUBLE THEN l_discount END AS discount FROM lineitem)"""


@query("complete_cases", f"WITH {_HOLEY} SELECT * FROM h WHERE tax IS NOT NULL AND discount IS NOT NULL")
def complete(t):
    return complete_cases(_holey(t))


@query("rows_with_missing", f"WITH {_HOLEY} SELECT l_orderkey, l_linenumber, l_partkey FROM h WHERE tax IS NULL OR discount IS NULL")
def missing(t):
    return rows_with_missing(_holey(t)).select("l_orderkey", "l_linenumber", "l_partkey")


@query("fill_missing", f"WITH {_HOLEY} SELECT l_orderkey, l_linenumber, l_partkey, coalesce(tax, 0)::DOUBLE AS tax, coalesce(discount, 0)::DOUBLE AS discount FROM h")
def filled(t):
    return fill_missing(_holey(t), 0, ["tax", "discount"])


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def _class_shares(t):
    """Long land-cover table: share of each order's quantity by part type; most orders lack some types."""
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type")
    long = t.lineitem.select("l_partkey", "l_orderkey", "l_quantity").join(p, "l_partkey").groupBy("l_orderkey", "p_type").agg(F.sum("l_quantity").alias("q"))
    total = long.groupBy("l_orderkey").agg(F.sum("q").alias("total"))
    return long.join(total, "l_orderkey").select("l_orderkey", "p_type", (F.col("q") / F.col("total")).alias("share"))


_SHARES = """s AS (SELECT l_orderkey, p_type, sum(l_quantity) AS q FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
 sh AS (SELECT l_orderkey, p_type, q / sum(q) OVER (PARTITION BY l_orderkey) AS share FROM s)"""


@query("pivot_wide", f"WITH {_SHARES} SELECT l_orderkey, " + ", ".join(
    rsql(f"coalesce(max(CASE WHEN p_type = '{c}' THEN share END), 0.0)::DOUBLE") + f" AS {c.lower()}" for c in _TYPES) + " FROM sh GROUP BY 1")
def pivot(t):
    wide = pivot_wide(_class_shares(t), ["l_orderkey"], "p_type", "share", _TYPES)
    return rounded(wide.toDF("l_orderkey", *[c.lower() for c in _TYPES]))


@query("unpivot_long", """WITH w AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END AS d1,
  CAST(o_orderdate AS DATE) + 7 AS d2, CASE WHEN o_totalprice > 250000 THEN CAST(o_orderdate AS DATE) + 30 END AS d3 FROM orders)
 SELECT * FROM (SELECT o_orderkey, d1 AS date, 1 AS ignition_id FROM w UNION ALL SELECT o_orderkey, d2, 2 FROM w UNION ALL SELECT o_orderkey, d3, 3 FROM w)
 WHERE date IS NOT NULL""")
def unpivot(t):
    d = F.to_date("o_orderdate")
    w = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", d).alias("d1"), F.date_add(d, 7).alias("d2"),
                        F.when(F.col("o_totalprice") > 250000, F.date_add(d, 30)).alias("d3"))
    return unpivot_long(w, ["o_orderkey"], ["d1", "d2", "d3"], "name", "date", "ignition_id").drop("name")


@query("overall_group", f"""WITH {REG_ORDERS} SELECT region, count(*) AS n, {rsql("avg(o_totalprice)", 4)} AS mean_price FROM reg_orders GROUP BY 1
 UNION ALL SELECT 'all regions', count(*), {rsql("avg(o_totalprice)", 4)} FROM reg_orders""")
def overall(t):
    d = with_overall_group(regional_orders(t).select("o_orderkey", "region", "o_totalprice"), "region", "all regions", ["o_orderkey"])
    return rounded(d.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean_price")), 4)


@query("duplicate_entities", """SELECT l_orderkey, l_suppkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey, l_suppkey) IN
 (SELECT (l_orderkey, l_suppkey) FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1)""")
def duplicates(t):
    li = t.lineitem.select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey", F.concat_ws(":", "l_orderkey", "l_suppkey").alias("k"))
    return duplicate_entities(li, "k").drop("k")


@query("group_stats", """SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n_rows, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS total,
 round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share, round(o_totalprice - min(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS above_min FROM orders""")
def group_stats(t):
    o = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    d = with_group_stats(o, ["o_custkey"], {"n_rows": F.count(F.lit(1)), "total": F.sum("o_totalprice"), "lo": F.min("o_totalprice")})
    return d.select("o_orderkey", "n_rows", F.round("total", 2).alias("total"), F.round(F.col("o_totalprice") / F.col("total"), 6).alias("share"),
                    F.round(F.col("o_totalprice") - F.col("lo"), 2).alias("above_min"))


@query("exclude_beyond_case_range", """WITH f AS (SELECT l_suppkey % 20 AS region, l_returnflag = 'R' AND l_quantity < 25 AS is_case, l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax,
  l_extendedprice FROM lineitem),
 m AS (SELECT region, max(l_extendedprice) AS mp, max(l_extendedprice * l_discount) AS md, max(l_extendedprice * l_tax) AS mt FROM f WHERE is_case GROUP BY 1)
 SELECT f.region, l_orderkey, l_linenumber, l_partkey FROM f JOIN m USING (region) WHERE NOT is_case
 AND NOT (l_extendedprice > mp AND (l_extendedprice * l_discount > md OR l_extendedprice * l_tax > mt))""")
def beyond(t):
    li = t.lineitem.select(
        (F.col("l_suppkey") % 20).alias("region"), "l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
        F.col("l_extendedprice").alias("water"), (F.col("l_extendedprice") * F.col("l_discount")).alias("developed_low"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("developed_high"))
    cases = li.filter("l_returnflag = 'R' and l_quantity < 25")
    limits = range_limits(cases, ["region"], ["water", "developed_low", "developed_high"])
    kept = beyond_case_range(li.filter("NOT (l_returnflag = 'R' AND l_quantity < 25)"), limits, ["region"], ["water"], ["developed_low", "developed_high"])
    return kept.select("region", "l_orderkey", "l_linenumber", "l_partkey")

"""Case/control sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorframe.catalog.base import query, rounded, rsql
from anchorframe.catalog.expressions import _cut_sql
from anchorframe.catalog.proxies import COVER, REG_ORDERS, order_cover, regional_orders
from anchorframe.functions.hashing import uniform
from anchorframe.operators.sampling import (
    assign_k_dates_within_year, assign_random_date, bin_quotas, case_counts, collect_values, dedupe_multi_region, draw_from_empirical,
    match_distribution, one_per_entity, padded_target, rebalance_controls, remainder, sample_n, sample_n_per_group,
    spread_dates, top_up)
from anchorframe.operators.tables import unpivot_long
from anchorframe.session import materialize

SEED = 123


def key_sql(op: str, *ids: str) -> str:
    return f"md5(concat_ws(':', '{SEED}', '{op}', {', '.join(f'{i}::VARCHAR' for i in ids)}))"


def u_sql(op: str, *ids: str) -> str:
    return f"(CAST(('0x' || substr({key_sql(op, *ids)}, 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


@query("hash_uniform", f"SELECT o_orderkey, {u_sql('u', 'o_orderkey')} AS u FROM orders")
def hash_uniform(t):
    return t.orders.select("o_orderkey", uniform(SEED, "u", "o_orderkey").alias("u"))


@query("random_date", f"""SELECT c_custkey, CAST(DATE '1991-01-01' + floor({u_sql('date', 'c_custkey')} * (date_diff('day', DATE '1991-01-01', DATE '2021-12-31') + 1))::INTEGER AS DATE) AS rdm_date
 FROM customer""")
def random_date(t):
    return assign_random_date(t.customer.select("c_custkey"), F.lit("1991-01-01"), F.lit("2021-12-31"), SEED, ["c_custkey"])


@query("k_dates_in_year", f"""WITH d AS (SELECT c_custkey, year, unnest(generate_series(0, date_diff('day', make_date(year, 1, 1), make_date(year + 1, 1, 1)) - 1)) AS d
  FROM (SELECT c_custkey, (1991 + c_custkey % 30)::INTEGER AS year FROM customer)),
 r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY {key_sql('day', 'c_custkey', 'd')}) AS rn FROM d)
 SELECT c_custkey, year, rn::INTEGER AS ignition_id, CAST(make_date(year, 1, 1) + d::INTEGER AS DATE) AS date FROM r WHERE rn <= 5""")
def k_dates(t):
    c = t.customer.select("c_custkey", (1991 + F.col("c_custkey") % 30).cast("int").alias("year"))
    d = spread_dates(assign_k_dates_within_year(c, "year", 5, SEED, ["c_custkey"]), "dates", "Ig_Date", 5)
    return unpivot_long(d, ["c_custkey", "year"], [f"Ig_Date_{i}" for i in range(1, 6)], "name", "date", "ignition_id").drop("name")


@query("sample_n_per_group", f"""WITH {REG_ORDERS}, n AS (SELECT nation, count(*) AS n FROM reg_orders WHERE pa = 1 AND o_totalprice > 250000 GROUP BY 1),
 r AS (SELECT nation, o_orderkey, row_number() OVER (PARTITION BY nation ORDER BY {key_sql('sample', 'o_orderkey')}) AS rn FROM reg_orders WHERE pa = 0)
 SELECT nation, o_orderkey FROM r JOIN n USING (nation) WHERE rn <= n""")
def sample_groups(t):
    d = regional_orders(t).select("nation", "o_orderkey", "pa", "o_totalprice")
    n = case_counts(d.filter("pa = 1 and o_totalprice > 250000"), ["nation"])
    return sample_n_per_group(d.filter("pa = 0"), ["nation"], n, "n_cases", SEED, ["o_orderkey"]).select("nation", "o_orderkey")


@query("sample_n", f"SELECT o_orderkey FROM orders ORDER BY {key_sql('sample', 'o_orderkey')} LIMIT 2277")
def sample_rows(t):
    return sample_n(t.orders.select("o_orderkey"), 2277, SEED, ["o_orderkey"])


@query("draw_from_empirical", f"""WITH {REG_ORDERS}, c AS (SELECT nation, o_totalprice AS size, row_number() OVER (PARTITION BY nation ORDER BY {key_sql('index', 'o_orderkey')}) AS idx,
  count(*) OVER (PARTITION BY nation) AS n FROM reg_orders WHERE pa = 1 AND o_totalprice > 495000),
 k AS (SELECT DISTINCT nation, n FROM c)
 SELECT o.o_orderkey, o.nation, coalesce(c.size, 0) AS size FROM reg_orders o JOIN k USING (nation)
 JOIN c ON c.nation = o.nation AND c.idx = floor({u_sql('draw', 'o.o_orderkey')} * k.n) + 1 WHERE pa = 0""")
def draw(t):
    d = regional_orders(t).select("nation", "o_orderkey", "pa", F.col("o_totalprice").alias("size"))
    cases = d.filter("pa = 1 and size > 495000")
    return draw_from_empirical(d.filter("pa = 0").drop("size", "pa"), cases, ["nation"], "size", SEED, ["o_orderkey"], ["o_orderkey"])


@query("collect_values", f"""WITH {REG_ORDERS} SELECT nation, row_number() OVER (PARTITION BY nation ORDER BY {key_sql('index', 'o_orderkey')}) AS idx, o_totalprice FROM reg_orders WHERE pa = 1""")
def values(t):
    return collect_values(regional_orders(t).filter("pa = 1"), ["nation"], "o_totalprice", SEED, ["o_orderkey"])


@query("one_per_entity", f"""WITH r AS (SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey
 ORDER BY {key_sql('one', 'l_orderkey', 'l_partkey', 'l_linenumber')}, l_partkey, l_linenumber) AS rn FROM lineitem WHERE l_discount <= 0.05::DOUBLE)
 SELECT l_orderkey, l_partkey, l_linenumber FROM r WHERE rn = 1""")
def one_each(t):
    li = t.lineitem.filter(F.col("l_discount") <= 0.05).select("l_orderkey", "l_partkey", "l_linenumber")
    return one_per_entity(li, ["l_orderkey"], SEED, ["l_orderkey", "l_partkey", "l_linenumber"])


@query("padded_target", f"""WITH {REG_ORDERS} SELECT nation, o_orderpriority, count(*) * 5 AS total, CASE WHEN count(*) * 5 < 190 THEN count(*) * 5 + 150 ELSE count(*) * 5 + 5 END AS target
 FROM reg_orders WHERE pa = 1 GROUP BY 1, 2""")
def targets(t):
    return padded_target(regional_orders(t).filter("pa = 1"), ["nation", "o_orderpriority"], small=190)


def _match_sql(name: str, pool: str, col: str, step: float, target: str, rounding: str) -> str:
    """CTEs of one matching pass over ``pool``; the result is ``name``."""
    fn = "round_even({}, 0)" if rounding == "half_even" else "floor({})"
    return f"""{name}_c AS (SELECT region, {_cut_sql(col, step)} AS bin, count(*) AS n FROM cover WHERE pa = 1 GROUP BY 1, 2),
 {name}_s AS (SELECT region, bin, n, n / sum(n) OVER (PARTITION BY region) AS share FROM {name}_c),
 {name}_p AS (SELECT *, {_cut_sql(col, step)} AS bin FROM {pool}),
 {name}_b AS (SELECT region, bin, count(*) AS n_pool FROM {name}_p GROUP BY 1, 2),
 {name}_q AS (SELECT b.region, b.bin, b.n_pool, coalesce(share, 0.0)::DOUBLE AS share,
   coalesce({fn.format('(coalesce(n, 0) * target) / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY b.region), 0)')}, 0)::BIGINT AS n_keep
   FROM {name}_b b LEFT JOIN {name}_s s ON s.region = b.region AND s.bin IS NOT DISTINCT FROM b.bin
   LEFT JOIN (SELECT region, {target} AS target FROM cover WHERE pa = 1 GROUP BY 1) g ON g.region = b.region),
 {name} AS (SELECT p.* EXCLUDE (bin, rn) FROM (SELECT *, row_number() OVER (PARTITION BY region, bin ORDER BY {key_sql('match_' + col, 'o_orderkey')}) AS rn FROM {name}_p) p
   JOIN {name}_q q ON q.region = p.region AND q.bin = p.bin WHERE rn <= n_keep)"""


# pools are as large as the case sets here, so the plain case count is the target and bins run short
_CROP = _match_sql("m1", "(SELECT * FROM cover WHERE pa = 0)", "crop", 0.05, "(CASE WHEN count(*) < 90 THEN count(*) + 150 ELSE count(*) + 5 END)", "half_even")
_HAY = _match_sql("m2", "m1", "hay", 0.1, "count(*)", "floor")


def matched(t):
    d = materialize(order_cover(t))
    cases, pool = d.filter("pa = 1"), d.filter("pa = 0")
    crop = match_distribution(pool, cases, ["region"], "crop", 0.05, padded_target(cases, ["region"], mult=1), "half_even", SEED, ["o_orderkey"])
    crop = materialize(crop)
    plain = case_counts(cases, ["region"], "target")
    return cases, pool, crop, match_distribution(crop, cases, ["region"], "hay", 0.1, plain, "floor", SEED, ["o_orderkey"])


@query("bin_quotas", f"WITH {COVER}, {_CROP} SELECT region, bin, n_pool, {rsql('share')} AS share, n_keep FROM m1_q")
def quotas(t):
    d = materialize(order_cover(t))
    cases, pool = d.filter("pa = 1"), d.filter("pa = 0")
    q = bin_quotas(cases, pool, ["region"], "crop", 0.05, padded_target(cases, ["region"], mult=1), "half_even")
    return rounded(q.select("region", "bin", "n_pool", "share", "n_keep"))


@query("match_distribution", f"WITH {COVER}, {_CROP}, {_HAY} SELECT region, o_orderkey FROM m2")
def match(t):
    return matched(t)[3].select("region", "o_orderkey")


@query("match_remainder", f"WITH {COVER}, {_CROP} SELECT region, o_orderkey FROM cover WHERE pa = 0 AND o_orderkey NOT IN (SELECT o_orderkey FROM m1)")
def unmatched(t):
    _, pool, crop, _ = matched(t)
    return remainder(pool, crop, ["o_orderkey"]).select("region", "o_orderkey")


@query("top_up", f"""WITH {COVER}, {_CROP}, {_HAY} SELECT region, o_orderkey FROM m2 UNION ALL
 (SELECT region, o_orderkey FROM cover WHERE pa = 0 AND region = 'ASIA' AND crop > 0.5 AND o_orderkey NOT IN (SELECT o_orderkey FROM m2) ORDER BY {key_sql('top_up', 'o_orderkey')} LIMIT 40)""")
def topped(t):
    _, pool, _, hay = matched(t)
    more = top_up(hay, pool, (F.col("region") == "ASIA") & (F.col("crop") > 0.5), 40, SEED, ["o_orderkey"])
    return more.select("region", "o_orderkey")


# an order's suppliers play the regions an event lies in: status R lines are cases
_PAIRS = """pairs AS (SELECT l_orderkey, l_suppkey % 25 AS region, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS pa
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""
_DEDUPE = _PAIRS + f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {key_sql('region', 'l_orderkey', 'region')}) AS rn FROM pairs)"""


def _pairs(t):
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    li = t.lineitem.select("l_orderkey", (F.col("l_suppkey") % 25).alias("region")).distinct()
    return li.join(o, "l_orderkey").select("l_orderkey", "region", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("pa"))


@query("dedupe_multi_region", f"WITH {_DEDUPE} SELECT l_orderkey, region, pa::INTEGER AS pa FROM ranked WHERE rn = 1")
def dedupe(t):
    return dedupe_multi_region(_pairs(t), "l_orderkey", "region", SEED)[0]


@query("dedupe_drop_counts", f"WITH {_DEDUPE} SELECT region, count(*) AS n_drop FROM ranked WHERE rn > 1 GROUP BY 1")
def drop_counts(t):
    return dedupe_multi_region(_pairs(t), "l_orderkey", "region", SEED)[2]


@query("rebalance_controls", f"""WITH {_DEDUPE}, drops AS (SELECT region, count(*) AS n_drop FROM ranked WHERE rn > 1 AND pa = 1 AND region < 20 GROUP BY 1),
 base AS (SELECT region, l_orderkey, pa FROM ranked WHERE pa = 0 OR rn = 1),
 c AS (SELECT b.*, coalesce(n_drop, 0) AS n_drop, row_number() OVER (PARTITION BY b.region ORDER BY {key_sql('rebalance', 'l_orderkey', 'b.region')}) AS k FROM base b LEFT JOIN drops d ON d.region = b.region WHERE pa = 0)
 SELECT l_orderkey, region, pa::INTEGER AS pa FROM base WHERE pa = 1 UNION ALL SELECT l_orderkey, region, pa::INTEGER FROM c WHERE k > n_drop""")
def rebalance(t):
    p = materialize(_pairs(t))
    kept, dropped, _ = dedupe_multi_region(p.filter("pa = 1"), "l_orderkey", "region", SEED)
    drops = dropped.filter("region < 20").groupBy("region").agg(F.count(F.lit(1)).alias("n_drop"))
    return rebalance_controls(kept.unionByName(p.filter("pa = 0")), "region", drops, SEED, ["l_orderkey", "region"])

"""Column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorframe.catalog.base import query, rounded, rsql
from anchorframe.functions.classes import drought_class
from anchorframe.functions.numbers import (
    bin_fixed, format_effect, p_band, percent_change, round_half_even, row_sum, signif)
from anchorframe.functions.text import normalize_id, relabel, relabel_pattern, snake_case, with_levels
from anchorframe.operators.tables import drop_columns_with_nulls, shared_columns_union
from anchorframe.sources.io import with_chunks


@query("normalize_id", """WITH s AS (SELECT o_orderkey, CASE o_orderkey % 5
  WHEN 0 THEN lpad(o_custkey::VARCHAR, 9, '0') WHEN 1 THEN o_custkey || '.0' WHEN 2 THEN ' ' || o_custkey || ' '
  WHEN 3 THEN ' AL' || o_custkey || ' ' ELSE '' END AS raw FROM orders)
 SELECT o_orderkey, raw, CASE WHEN try_cast(trim(raw) AS DOUBLE) IS NOT NULL
  THEN trunc(try_cast(trim(raw) AS DOUBLE))::BIGINT::VARCHAR ELSE trim(raw) END AS id FROM s""")
def ids(t):
    k = F.col("o_custkey").cast("string")
    m = F.col("o_orderkey") % 5
    raw = (F.when(m == 0, F.lpad(k, 9, "0")).when(m == 1, F.concat(k, F.lit(".0")))
           .when(m == 2, F.concat(F.lit(" "), k, F.lit(" "))).when(m == 3, F.concat(F.lit(" AL"), k, F.lit(" ")))
           .otherwise(""))
    return t.orders.select("o_orderkey", raw.alias("raw")).withColumn("id", normalize_id("raw"))


@query("relabel_levels", """SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'now' WHEN '5-LOW' THEN 'later' ELSE o_orderpriority END AS label,
 CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus END AS status,
 (CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 END)::INTEGER AS level_rank,
 trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g'), '_') AS snake,
 regexp_replace(o_orderpriority, '^[0-9]-', '') AS bare, count(*) AS n FROM orders GROUP BY ALL""")
def relabels(t):
    o = with_levels(t.orders, "o_orderstatus", ["O", "F"])
    cols = [relabel("o_orderpriority", {"1-URGENT": "now", "5-LOW": "later"}).alias("label"),
            F.col("o_orderstatus").alias("status"), "level_rank", snake_case("o_orderpriority").alias("snake"),
            relabel_pattern("o_orderpriority", [("^[0-9]-", "")]).alias("bare")]
    d = o.select(*cols)
    return d.groupBy(*d.columns).agg(F.count(F.lit(1)).alias("n"))


@query("row_sums", """SELECT o_orderkey, round(tax_total + disc_total, 6) AS strict_sum,
 round(coalesce(tax_total, 0) + coalesce(disc_total, 0), 6) AS lenient_sum FROM orders
 LEFT JOIN (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN l_tax END) AS tax_total,
  sum(CASE WHEN l_returnflag = 'A' THEN l_discount END) AS disc_total FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def row_sums(t):
    li = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_tax"))).alias("a"),
        F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_discount"))).alias("b"))
    o = t.orders.select("o_orderkey").join(li, "o_orderkey", "left")
    return rounded(o.select("o_orderkey", row_sum(["a", "b"]).alias("strict_sum"),
                            row_sum(["a", "b"], skip_nulls=True).alias("lenient_sum")))


@query("format_numbers", """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity * l_discount > 10 THEN printf('%.2e', l_quantity * l_discount)
 ELSE printf('%.3f', l_quantity * l_discount) END AS effect FROM lineitem""")
def formats(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", format_effect(F.col("l_quantity") * F.col("l_discount")).alias("effect"))


@query("signif_round", """SELECT l_orderkey, l_linenumber, l_partkey,
 CASE WHEN l_extendedprice = 0 THEN 0.0 ELSE round_even(l_extendedprice * pow(10.0, 1 - floor(log10(abs(l_extendedprice)))), 0)
  / pow(10.0, 1 - floor(log10(abs(l_extendedprice)))) END::DOUBLE AS two_digits,
 round_even(l_quantity / 2, 0)::DOUBLE AS half_even FROM lineitem""")
def signif_round(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", signif("l_extendedprice", 2).alias("two_digits"),
                             round_half_even(F.col("l_quantity") / 2).alias("half_even"))


@query("drop_null_columns", "SELECT c_custkey, c_mktsegment FROM customer")
def drop_null_columns(t):
    c = t.customer.select("c_custkey", "c_mktsegment",
                          F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("positive_balance"),
                          F.when(F.col("c_nationkey") > 0, F.col("c_nationkey").cast("double"))
                          .otherwise(F.lit(float("nan"))).alias("nation_number"))
    return drop_columns_with_nulls(c)


@query("shared_columns_union", """SELECT s_nationkey AS nationkey, s_acctbal AS acctbal, 1 AS pa FROM supplier
 UNION ALL SELECT c_nationkey, c_acctbal, 0 FROM customer""")
def shared_union(t):
    s = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal"), F.lit(1).alias("pa"))
    c = t.customer.select("c_custkey", F.lit(0).alias("pa"), F.col("c_acctbal").alias("acctbal"), F.col("c_nationkey").alias("nationkey"))
    return shared_columns_union(s, c)


def _cut_sql(x: str, step: float) -> str:
    n = round(1 / step)
    b = [i * step for i in range(n + 1)]
    txt = [f"{v:.3g}" for v in b]
    arms = " ".join(f"WHEN {x} <= {b[i + 1]!r}::DOUBLE THEN '{'[' if i == 0 else '('}{txt[i]},{txt[i + 1]}]'" for i in range(n))
    return f"CASE WHEN {x} < 0 THEN NULL {arms} END"


@query("bin_fixed", f"SELECT l_discount + l_tax AS share, {_cut_sql('(l_discount + l_tax)', 0.05)} AS bin, count(*) AS n FROM lineitem GROUP BY ALL")
def bins(t):
    d = t.lineitem.select((F.col("l_discount") + F.col("l_tax")).alias("share")).withColumn("bin", bin_fixed("share", 0.05))
    return d.groupBy("share", "bin").agg(F.count(F.lit(1)).alias("n"))


@query("drought_class", """WITH x AS (SELECT o_orderkey, o_totalprice / 50000 - 5 AS v FROM orders)
 SELECT o_orderkey, CASE WHEN v <= -4 THEN 'Extreme Drought' WHEN v < 0 THEN 'Drought' ELSE 'wet' END AS zone,
 CASE WHEN v <= -5 THEN 'extreme drought' WHEN v <= -4 THEN 'severe drought' WHEN v <= -3 THEN 'moderate drought'
  WHEN v <= -2 THEN 'mild drought' WHEN v <= -1 THEN 'incipient dry spell' WHEN v < 1 THEN 'near normal'
  WHEN v < 2 THEN 'incipient wet spell' WHEN v < 3 THEN 'slightly wet' WHEN v < 4 THEN 'moderately wet'
  WHEN v < 5 THEN 'very wet' ELSE 'extremely wet' END AS pdsi_class,
 CASE WHEN v <= -2 THEN 'extreme drought' WHEN v <= -1.6::DOUBLE THEN 'severe drought' WHEN v <= -1.3::DOUBLE THEN 'moderate drought'
  WHEN v <= -0.8::DOUBLE THEN 'mild drought' WHEN v <= -0.5 THEN 'incipient dry spell' WHEN v < 0.5 THEN 'near normal'
  WHEN v < 0.8::DOUBLE THEN 'incipient wet spell' WHEN v < 1.3::DOUBLE THEN 'slightly wet' WHEN v < 1.6::DOUBLE THEN 'moderately wet'
  WHEN v < 2 THEN 'very wet' ELSE 'extremely wet' END AS spei_class FROM x""")
def classes(t):
    x = t.orders.select("o_orderkey", (F.col("o_totalprice") / 50000 - 5).alias("v"))
    return x.select("o_orderkey", drought_class("v", "pdsi_zone").alias("zone"), drought_class("v", "pdsi").alias("pdsi_class"),
                    drought_class("v", "spei").alias("spei_class"))


@query("p_band", """WITH p AS (SELECT DISTINCT l_tax * l_discount AS p FROM lineitem)
 SELECT p, CASE WHEN p < 0.001::DOUBLE THEN '<0.001' WHEN p < 0.01::DOUBLE THEN '<0.01' WHEN p < 0.05::DOUBLE THEN '<0.05'
 ELSE printf('%.3f', p) END AS band FROM p""")
def p_bands(t):
    p = t.lineitem.select((F.col("l_tax") * F.col("l_discount")).alias("p")).distinct()
    return p.withColumn("band", p_band("p"))


@query("effect_percent_change", f"""SELECT DISTINCT l_discount AS estimate, {rsql('(exp(l_discount) - 1) / 10', 9)} AS change, {rsql('exp(l_discount)', 9)} AS odds
 FROM lineitem""")
def percent(t):
    change, odds = percent_change("estimate")
    return rounded(t.lineitem.select(F.col("l_discount").alias("estimate")).distinct().select(
        "estimate", change.alias("change"), odds.alias("odds")), 9)


@query("write_chunks", """SELECT o_orderkey, o_custkey, floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 5000)::INTEGER AS chunk FROM orders""")
def chunks(t):
    return with_chunks(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey", 5000)

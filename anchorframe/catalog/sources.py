"""Scans, sinks and spines: tables written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from anchorframe.catalog.base import query
from anchorframe.functions.text import sort_by_level
from anchorframe.operators.tables import exclude_ids, first_rows
from anchorframe.session import shared_folder
from anchorframe.sources.io import literal_lookup, literal_table, numeric_spine, read_delimited, read_many, read_polygons, read_table, write_chunks, write_table


def _place(t, name: str) -> str:
    return f"{shared_folder(t.spark)}/tables/{name}-{uuid.uuid4().hex}"


@query("delimited_scan", """SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status, o_totalprice FROM orders""")
def delimited(t):
    path = _place(t, "orders-csv")
    o = t.orders.select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"), "o_totalprice")
    write_table(o, path, "csv")
    return read_delimited(t.spark, path, "o_orderkey bigint, o_custkey bigint, status string, o_totalprice double")


@query("polygon_scan", "SELECT n_nationkey, n_name, 5070 AS srid, n_nationkey % 5 * 100.0::DOUBLE AS x, 5 AS points FROM nation")
def polygons(t):
    from anchorframe.catalog.spatial import nation_squares

    path = _place(t, "nations")
    write_table(nation_squares(t).select("n_nationkey", "n_name", "geometry", F.lit(5070).alias("srid")), path)
    back = read_polygons(t.spark, path, "n_nationkey int, n_name string")
    return back.select("n_nationkey", "n_name", "srid", F.expr("geometry[0][0].x").alias("x"), F.expr("size(geometry[0])").alias("points"))


@query("several_files", """SELECT c_custkey AS id, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer
 UNION ALL SELECT s_suppkey, s_nationkey, s_acctbal, NULL FROM supplier""")
def several(t):
    first, second = _place(t, "customer"), _place(t, "supplier")
    write_table(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")), first)
    write_table(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")), second)
    return read_many([read_table(t.spark, first), read_table(t.spark, second)])


@query("chunks_written", """WITH n AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS chunk FROM orders)
 SELECT chunk::INTEGER AS chunk, count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM n GROUP BY 1""")
def chunks(t):
    path = _place(t, "chunks")
    write_chunks(t.orders.select("o_orderkey", "o_totalprice"), path, "o_orderkey", 500)
    back = read_table(t.spark, path).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    return back.withColumn("chunk", F.col("chunk").cast("int"))


@query("numeric_spine", """WITH s AS (SELECT unnest(generate_series(0, 12)) * 50000.0::DOUBLE AS price), n AS (SELECT floor(o_totalprice / 50000) * 50000 AS price, count(*) AS n FROM orders GROUP BY 1)
 SELECT s.price, coalesce(n, 0) AS n FROM s LEFT JOIN n USING (price)""")
def price_spine(t):
    n = t.orders.groupBy((F.floor(F.col("o_totalprice") / 50000) * 50000).cast("double").alias("price")).agg(F.count(F.lit(1)).alias("n"))
    return numeric_spine(t.spark, 0, 600000, 50000, "price").join(n, "price", "left").select("price", F.coalesce("n", F.lit(0)).alias("n"))


@query("literal_key_table", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' END AS status, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS rank FROM orders""")
def literals(t):
    ranks = literal_table(t.spark, [("F", 1), ("O", 2)], "o_orderstatus string, rank int")
    named = t.orders.select("o_orderkey", "o_orderstatus", literal_lookup("o_orderstatus", {"F": "final", "O": "open"}).alias("status"))
    return named.join(F.broadcast(ranks), "o_orderstatus", "left").select("o_orderkey", "status", "rank")  # two literal rows


@query("first_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def first(t):
    return first_rows(t.orders.select("o_orderkey", "o_totalprice"), 25, F.desc("o_totalprice"), "o_orderkey")


@query("sort_by_level", """SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, o_orderkey""")
def by_level(t):
    return sort_by_level(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["5-LOW", "1-URGENT"], "o_orderkey")


@query("exclude_ids", """SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_suppkey NOT IN (1, 5) GROUP BY 1""")
def without(t):
    li = exclude_ids(t.lineitem.select("l_suppkey", "l_quantity"), "l_suppkey", [1, 5])
    return li.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))

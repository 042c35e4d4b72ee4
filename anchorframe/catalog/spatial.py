"""Polygons built from table keys by arithmetic: nations are squares of a grid, customers are diamonds."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorframe.catalog.base import query, rounded, rsql
from anchorframe.catalog.sampling import SEED, u_sql
from anchorframe.functions.hashing import uniform
from anchorframe.operators.spatial import (
    bbox, boundary_edges, centroid, clip_to_bbox, dissolve, equal_area_buffer, perimeter, polygon_area, polygon_area_ha,
    random_points, region_key, spatial_intersects_join)


def nation_squares(t):
    """5 x 5 coverage of squares with side 100, five nations per region."""
    n = t.nation.select("n_nationkey", "n_name", "n_regionkey", (F.col("n_nationkey") % 5 * 100.0).alias("x"),
                        (F.floor(F.col("n_nationkey") / 5) * 100.0).alias("y"))
    ring = F.expr("""array(named_struct('x', x, 'y', y), named_struct('x', x + 100, 'y', y), named_struct('x', x + 100, 'y', y + 100),
        named_struct('x', x, 'y', y + 100), named_struct('x', x, 'y', y))""")
    return n.select("n_nationkey", "n_name", "n_regionkey", F.array(ring).alias("geometry"))


def customer_diamonds(t):
    c = t.customer.select("c_custkey", (uniform(SEED, "cx", "c_custkey") * 500).alias("x"), (uniform(SEED, "cy", "c_custkey") * 500).alias("y"),
                          (F.abs("c_acctbal") / 200 + 0.5).alias("r"))
    ring = F.expr("""array(named_struct('x', x + r, 'y', y), named_struct('x', x, 'y', y + r), named_struct('x', x - r, 'y', y),
        named_struct('x', x, 'y', y - r), named_struct('x', x + r, 'y', y))""")
    return c.withColumn("geometry", F.array(ring))


DIAMONDS = f"""dia AS (SELECT c_custkey, {u_sql('cx', 'c_custkey')} * 500 AS x, {u_sql('cy', 'c_custkey')} * 500 AS y, abs(c_acctbal) / 200 + 0.5 AS r FROM customer),
 sq AS (SELECT n_nationkey, n_name, n_regionkey, n_nationkey % 5 * 100.0::DOUBLE AS x0, (n_nationkey // 5) * 100.0::DOUBLE AS y0 FROM nation)"""


@query("polygon_area", f"""WITH {DIAMONDS} SELECT c_custkey, {rsql('2 * r * r')} AS area, {rsql('2 * r * r / 10000', 9)} AS area_ha, {rsql('4 * r * sqrt(2.0::DOUBLE)')} AS perimeter FROM dia""")
def area(t):
    d = customer_diamonds(t).select("c_custkey", polygon_area().alias("area"), polygon_area_ha().alias("area_ha"), perimeter().alias("perimeter"))
    d = d.withColumn("ha", F.col("area_ha"))
    return rounded(d.drop("area_ha", "ha")).join(rounded(d.select("c_custkey", F.col("ha").alias("area_ha")), 9), "c_custkey")


@query("polygon_area_geodesic", f"""WITH {DIAMONDS}, g AS (SELECT n_nationkey, x0 / 10 AS lon, y0 / 10 AS lat FROM sq)
 SELECT n_nationkey, {rsql("6371007.2::DOUBLE * 6371007.2::DOUBLE * radians(10) * (sin(radians(lat + 10)) - sin(radians(lat))) / 10000", 2)} AS area_ha FROM g""")
def area_geodesic(t):
    d = nation_squares(t).withColumn("geometry", F.expr("transform(geometry, r -> transform(r, p -> named_struct('x', p.x / 10, 'y', p.y / 10)))"))
    return rounded(d.select("n_nationkey", polygon_area_ha(mode="geodesic").alias("area_ha")), 2)


@query("bbox", f"""WITH {DIAMONDS}, j AS (SELECT c_mktsegment, d.* FROM dia d JOIN customer USING (c_custkey))
 SELECT c_mktsegment, {rsql('min(x - r) - 5')} AS xmin, {rsql('max(x + r) + 5')} AS xmax, {rsql('min(y - r) - 5')} AS ymin, {rsql('max(y + r) + 5')} AS ymax FROM j GROUP BY 1""")
def boxes(t):
    d = customer_diamonds(t).join(t.customer.select("c_custkey", "c_mktsegment"), "c_custkey")
    return rounded(bbox(d, ["c_mktsegment"], pad=5))


@query("centroid", f"WITH {DIAMONDS} SELECT c_custkey, {rsql('x', 5)} AS cx, {rsql('y', 5)} AS cy FROM dia")
def centroids(t):
    d = customer_diamonds(t).withColumn("c", centroid())
    return rounded(d.select("c_custkey", F.col("c.x").alias("cx"), F.col("c.y").alias("cy")), 5)


# the part of a diamond left of a vertical line: whole, none, or the square minus / plus a triangle
@query("clip_bbox", f"""WITH {DIAMONDS} SELECT c_custkey, {rsql('CASE WHEN x + r <= 250 THEN 2 * r * r WHEN x <= 250 THEN 2 * r * r - pow(x + r - 250, 2) ELSE pow(250 - (x - r), 2) END', 5)} AS area
 FROM dia WHERE x - r < 250""")
def clip(t):
    d = clip_to_bbox(customer_diamonds(t), -1000, -1000, 250, 1000)
    return rounded(d.select("c_custkey", polygon_area().alias("area")), 5)


@query("dissolve", f"""WITH {DIAMONDS}, e AS (SELECT n_regionkey, x0, y0, unnest([x0, x0 + 100, x0, x0]) AS ax, unnest([y0, y0, y0 + 100, y0]) AS ay, unnest([x0 + 100, x0 + 100, x0 + 100, x0]) AS bx, unnest([y0, y0 + 100, y0 + 100, y0 + 100]) AS by_ FROM sq),
 k AS (SELECT n_regionkey, ax, ay, bx, by_ FROM e GROUP BY ALL HAVING count(*) = 1), l AS (SELECT n_regionkey, sum(sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2))) AS boundary_length, count(*) AS n_edges FROM k GROUP BY 1)
 SELECT n_regionkey, count(*) AS n_members, 10000.0::DOUBLE * count(*) AS area, min(x0) AS xmin, max(x0) + 100 AS xmax, min(y0) AS ymin, max(y0) + 100 AS ymax, boundary_length, n_edges
 FROM sq JOIN l USING (n_regionkey) GROUP BY n_regionkey, boundary_length, n_edges""")
def dissolved(t):
    return rounded(dissolve(nation_squares(t), ["n_regionkey"]))


@query("boundary_edges", """SELECT (s * 100)::DOUBLE AS ax, (e * 100)::DOUBLE AS ay, (s * 100)::DOUBLE + 100 * h AS bx, (e * 100)::DOUBLE + 100 * (1 - h) AS by FROM
 (SELECT unnest([0, 1, 2, 3, 4, 0, 1, 2, 3, 4, 0, 0, 0, 0, 0, 5, 5, 5, 5, 5]) AS s, unnest([0, 0, 0, 0, 0, 5, 5, 5, 5, 5, 0, 1, 2, 3, 4, 0, 1, 2, 3, 4]) AS e,
  unnest([1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]) AS h)""")
def outline(t):
    return boundary_edges(nation_squares(t).withColumn("everything", F.lit(1)), ["everything"]).drop("everything")


@query("equal_area_buffer", f"""WITH {DIAMONDS} SELECT c_custkey, {rsql('sqrt(r * 10000 / pi())')} AS radius, {rsql('32 * sin(2 * pi() / 64) * (r * 10000 / pi())', 4)} AS area FROM dia""")
def buffers(t):
    b = equal_area_buffer(customer_diamonds(t).drop("geometry"), "x", "y", "r")
    b = b.select("c_custkey", "radius", polygon_area().alias("area"))
    return rounded(b.select("c_custkey", "radius")).join(rounded(b.select("c_custkey", "area"), 4), "c_custkey")


_TOUCH = """dia d JOIN sq s ON greatest(s.x0 - d.x, 0, d.x - s.x0 - 100) + greatest(s.y0 - d.y, 0, d.y - s.y0 - 100) <= d.r"""


@query("spatial_intersects_join", f"WITH {DIAMONDS} SELECT c_custkey, n_nationkey FROM {_TOUCH}")
def intersects(t):
    return spatial_intersects_join(customer_diamonds(t), nation_squares(t), ["c_custkey"], ["n_nationkey"])


@query("region_key", f"WITH {DIAMONDS} SELECT DISTINCT c_custkey, n_regionkey FROM {_TOUCH}")
def key(t):
    return region_key(customer_diamonds(t), nation_squares(t), ["c_custkey"], ["n_regionkey"])


# Tight squares: many draws fall near an earlier one, and whether that one was kept itself decides.
@query("random_points", f"""WITH RECURSIVE {DIAMONDS}, j AS (SELECT c_custkey, x AS cx, y AS cy, r, unnest(generate_series(0, 199)) AS draw FROM dia),
 p AS (SELECT c_custkey, draw, cx - r + {u_sql('px', 'c_custkey', 'draw')} * 2 * r AS x, cy - r + {u_sql('py', 'c_custkey', 'draw')} * 2 * r AS y, cx, cy, r FROM j),
 i AS (SELECT c_custkey, x, y, row_number() OVER (PARTITION BY c_custkey ORDER BY draw) AS rn FROM p WHERE abs(x - cx) + abs(y - cy) < r),
 g AS (SELECT c_custkey, 0::BIGINT AS rn, []::STRUCT(x DOUBLE, y DOUBLE)[] AS kept FROM dia
  UNION ALL SELECT g.c_custkey, i.rn, CASE WHEN len(list_filter(kept, lambda k: pow(k.x - i.x, 2) + pow(k.y - i.y, 2) < 0.0144::DOUBLE)) = 0
   THEN list_append(kept, {{'x': i.x, 'y': i.y}}) ELSE kept END FROM g JOIN i ON i.c_custkey = g.c_custkey AND i.rn = g.rn + 1 WHERE len(kept) < 10),
 f AS (SELECT c_custkey, arg_max(kept, rn) AS kept FROM g GROUP BY 1)
 SELECT c_custkey, point::INTEGER AS point, {rsql('kept[point].x', 5)} AS x, {rsql('kept[point].y', 5)} AS y, (10 - len(kept))::INTEGER AS shortfall
 FROM (SELECT *, unnest(generate_series(1, len(kept))) AS point FROM f)""")
def points(t):
    return rounded(random_points(customer_diamonds(t), ["c_custkey"], 10, 0.12, SEED), 5)

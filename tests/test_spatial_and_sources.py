import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from anchorframe import session
from anchorframe.operators.distributions import bandwidths, density, histogram
from anchorframe.operators.spatial import (
    boundary_edges, centroid, clip_to_bbox, dissolve, equal_area_buffer, polygon_area, polygon_area_ha, random_points,
    spatial_intersects_join, thin_points)
from anchorframe.session import collect_bounded, small_table
from anchorframe.sources.io import (
    date_spine, literal_lookup, numeric_spine, read_delimited, read_many, read_polygons, read_table, write_chunks, write_table)

SCHEMA = "id string, geometry array<array<struct<x:double,y:double>>>"


def ring(*pts):
    return [(float(x), float(y)) for x, y in pts] + [(float(pts[0][0]), float(pts[0][1]))]


def square(x, y, s):
    return ring((x, y), (x + s, y), (x + s, y + s), (x, y + s))


def hole(x, y, s):
    return ring((x, y), (x, y + s), (x + s, y + s), (x + s, y))


@pytest.fixture(scope="module")
def shapes(spark):
    ring_shape = [square(0, 0, 10), hole(4, 4, 2)]
    return spark.createDataFrame([("plain", [square(0, 0, 10)]), ("holed", ring_shape), ("two", [square(0, 0, 1), square(5, 5, 2)])], SCHEMA)


def test_area_and_centroid(shapes):
    got = {r.id: (r.a, r.c.x, r.c.y) for r in shapes.select("id", polygon_area().alias("a"), centroid().alias("c")).collect()}
    assert got["plain"] == (100.0, 5.0, 5.0) and got["holed"][0] == 96.0 and got["two"][0] == 5.0
    assert got["two"][1] == pytest.approx((0.5 * 1 + 6 * 4) / 5)
    ha = shapes.filter("id = 'plain'").select(polygon_area_ha(mode="geodesic")).first()[0]
    cap = 6371007.2**2 * math.radians(10) * math.sin(math.radians(10)) / 1e4
    assert ha == pytest.approx(cap, rel=0.02)


def test_clip(shapes):
    got = {r.id: r.a for r in clip_to_bbox(shapes, 5, 5, 100, 100).select("id", polygon_area().alias("a")).collect()}
    assert got == {"plain": 25.0, "holed": 24.0, "two": 4.0}


def test_dissolve_cancels_inner_edges(spark):
    d = spark.createDataFrame([("a", [square(0, 0, 1)]), ("a", [square(1, 0, 1)]), ("b", [square(5, 5, 2)])], SCHEMA)
    got = {r.id: (r.n_members, r.area, r.boundary_length, r.xmax) for r in dissolve(d, ["id"]).collect()}
    assert got == {"a": (2, 2.0, 6.0, 2.0), "b": (1, 4.0, 8.0, 7.0)}
    assert boundary_edges(d, ["id"]).filter("id = 'a'").count() == 6


def test_buffer_area(spark):
    d = equal_area_buffer(spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, ha double"), "x", "y", "ha", vertices=720)
    assert d.select(polygon_area_ha()).first()[0] == pytest.approx(3.0, rel=1e-4)


@pytest.mark.parametrize("points", [1_000_000, 0])
def test_intersections_by_brute_force(spark, points):
    rng = np.random.default_rng(2)
    boxes = [(f"e{i}", *rng.uniform(0, 50, 2), rng.uniform(0.1, 8)) for i in range(120)] + [("touch", 20.0, 20.0, 1.0), ("inside", 41.0, 41.0, 0.5), ("around", -5.0, -5.0, 80.0)]
    regs = [("r1", 0.0, 0.0, 20.0), ("r2", 30.0, 0.0, 15.0), ("r3", 40.0, 40.0, 5.0)]
    mk = lambda rows: spark.createDataFrame([(n, [square(x, y, s)]) for n, x, y, s in rows], SCHEMA)
    got = {(r[0], r[1]) for r in spatial_intersects_join(mk(boxes), mk(regs).withColumnRenamed("id", "reg"), ["id"], ["reg"], broadcast_points=points).collect()}
    want = {(e[0], r[0]) for e in boxes for r in regs if e[1] <= r[1] + r[3] and r[1] <= e[1] + e[3] and e[2] <= r[2] + r[3] and r[2] <= e[2] + e[3]}
    assert got == want


def test_event_in_a_hole_does_not_touch(spark, shapes):
    ev = spark.createDataFrame([("in_hole", [square(4.5, 4.5, 1)]), ("over_edge", [square(3.5, 4.5, 1)])], SCHEMA)
    got = spatial_intersects_join(ev, shapes.filter("id = 'holed'").withColumnRenamed("id", "reg"), ["id"], ["reg"]).collect()
    assert [tuple(r) for r in got] == [("over_edge", "holed")]


def test_thinning_by_brute_force(spark):
    rng = np.random.default_rng(8)
    pts = [("p", i, *map(float, xy)) for i, xy in enumerate(np.vstack([rng.uniform(0, 10, (150, 2)), rng.uniform(3, 3.5, (100, 2))]))]
    got = {r.draw for r in thin_points(spark.createDataFrame(pts, "id string, draw int, x double, y double"), ["id"], 0.5).collect()}
    kept = []
    for _, i, x, y in pts:  # a point goes only for an earlier one that stays
        if all(math.hypot(x - a, y - b) >= 0.5 for _, a, b in kept):
            kept.append((i, x, y))
    assert got == {i for i, _, _ in kept}


def test_a_tight_polygon_says_what_is_missing(spark):
    flat = [[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 0.0, "y": 0.0}]]
    d = spark.createDataFrame([("tight", [square(0, 0, 10)]), ("flat", flat)], SCHEMA)
    got = random_points(d, ["id"], 40, 5.0, 3, rounds=3).toPandas()
    tight = got[got.id == "tight"]
    assert 3 <= len(tight) < 40 and set(tight.shortfall) == {40 - len(tight)}
    assert got[got.id == "flat"][["point", "shortfall"]].isna().point.tolist() == [True] and set(got[got.id == "flat"].shortfall) == {40}
    assert d.filter("id = 'flat'").select(centroid().alias("c")).first().c.x is None


def test_every_part_of_a_multipart_polygon_counts(spark):
    ev = spark.createDataFrame([("second_inside", [square(100, 100, 1), square(5, 5, 1)]), ("around_island", [square(49, 49, 4)]), ("apart", [square(80, 0, 1)])], SCHEMA)
    reg = spark.createDataFrame([("main_and_island", [square(0, 0, 20), square(50, 50, 2)])], SCHEMA).withColumnRenamed("id", "reg")
    got = {r.id for r in spatial_intersects_join(ev, reg, ["id"], ["reg"]).collect()}
    assert got == {"second_inside", "around_island"}


def test_random_points(spark, shapes):
    got = random_points(shapes, ["id"], 40, 0.1, 3).toPandas()
    assert got.groupby("id").size().to_dict() == {"plain": 40, "holed": 40, "two": 40}
    h = got[got.id == "holed"]
    assert not ((h.x > 4) & (h.x < 6) & (h.y > 4) & (h.y < 6)).any()
    again = random_points(shapes.repartition(5), ["id"], 40, 0.1, 3).toPandas()
    assert got.sort_values(["id", "point"]).reset_index(drop=True).equals(again.sort_values(["id", "point"]).reset_index(drop=True))


def test_histogram_rules(spark):
    d = spark.createDataFrame([(0.0,), (0.5,), (0.51,), (10.0,), (None,)], "x double")
    got = {r.bin: r.n for r in histogram(d, "x", 11).collect()}
    assert got == {0: 2, 1: 1, 10: 1}
    same = histogram(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x", 20).collect()
    assert [(r.bin, r.n) for r in same] == [(0, 2)]


def test_density_integrates_to_one(spark):
    rng = np.random.default_rng(4)
    d = spark.createDataFrame([(float(v),) for v in rng.normal(5, 2, 3000)], "x double")
    curve = density(d, "x").toPandas().sort_values("x")
    assert np.trapezoid(curve.density, curve.x) == pytest.approx(1, abs=0.02)
    v = np.array([r[0] for r in d.collect()])
    iqr = np.subtract(*np.percentile(v, [75, 25]))
    bw = bandwidths(d, "x", []).first().bw
    assert bw == pytest.approx(0.9 * min(v.std(ddof=1), iqr / 1.34) * len(v) ** -0.2, rel=1e-9)
    at = curve.iloc[256]
    exact = np.exp(-0.5 * ((at.x - v) / bw) ** 2).sum() / (len(v) * bw * math.sqrt(2 * math.pi))
    assert at.density == pytest.approx(exact, rel=1e-4)


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,d,x\n001,2020-01-02,1.5\nb,NA,NA\n")
    a = read_delimited(spark, str(tmp_path / "a.csv"), "id string, d date, x double")
    assert [tuple(map(str, r)) for r in a.orderBy("id").collect()] == [("001", "2020-01-02", "1.5"), ("b", "None", "None")]
    write_table(a, str(tmp_path / "out"), "csv")
    assert read_delimited(spark, str(tmp_path / "out"), "id string, d date, x double").count() == 2
    b = spark.createDataFrame([("c", 2)], "id string, extra int")
    assert read_many([a, b]).columns == ["id", "d", "x", "extra"]
    write_chunks(spark.range(25).withColumnRenamed("id", "k"), str(tmp_path / "chunks"), "k", 10)
    sizes = {r.chunk: (r.n, r.lo, r.hi) for r in read_table(spark, str(tmp_path / "chunks")).groupBy("chunk").agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).collect()}
    assert sizes == {0: (10, 0, 9), 1: (10, 10, 19), 2: (5, 20, 24)}
    poly = spark.createDataFrame([("r", [square(0, 0, 2)], 5070)], SCHEMA + ", srid int")
    write_table(poly, str(tmp_path / "poly"))
    assert read_polygons(spark, str(tmp_path / "poly"), "id string").select(polygon_area()).first()[0] == 4.0


def test_spines(spark):
    b = spark.createDataFrame([("2020-02-27", "2020-03-01")], "a string, b string")
    assert date_spine(b, "a", "b").count() == 4
    x = [r.x for r in numeric_spine(spark, -2.2, 2.2, 0.01).orderBy("x").collect()]
    assert len(x) == 441 and x[0] == -2.2 and x[220] == pytest.approx(0.0, abs=1e-12)
    assert spark.range(1).select(literal_lookup(F.lit("a"), {"a": 1}), literal_lookup(F.lit("z"), {"a": 1})).first() == (1, None)


def test_small_table_beyond_its_limit(spark, tmp_path):
    d = spark.range(50)
    assert small_table(d, 10).count() == 50 and small_table(d, 100).count() == 50
    with pytest.raises(ValueError):
        collect_bounded(d, 10, "ids")
    assert session.try_small(d, 10) is None

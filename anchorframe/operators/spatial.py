"""Polygon tables: area, boxes, clipping, dissolving, centroids, random points and assignment to regions.

A geometry is an array of closed rings (first point repeated last), shells counter-clockwise and
holes clockwise, each ring an array of ``struct<x,y>``. Both layers of a join share one plane
reference system; nothing is reprojected.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorframe.functions.hashing import uniform
from anchorframe.operators.joins import keyed_join
from anchorframe.operators.ranking import attach
from anchorframe.session import materialize, small_table

EARTH_RADIUS_M = 6371007.2  # radius of the sphere with the earth's surface
M2_PER_HA = 10_000.0
SALT = 16
DRAW_BLOCK = 1024


def _ring_sum(geom: str, term: str) -> str:
    """Sum of ``term`` over all edges (p -> q) of all rings."""
    body = term.replace("p.", "element_at(r, i).").replace("q.", "element_at(r, i + 1).")
    return (f"aggregate({geom}, 0D, (t, r) -> t + IF(size(r) < 2, 0D, "
            f"aggregate(sequence(1, size(r) - 1), 0D, (s, i) -> s + ({body}))))")


CROSS = "(p.x * q.y - q.x * p.y)"


def polygon_area(geom: str = "geometry") -> Column:
    """Plane area; holes count against their shell by orientation."""
    return F.expr(f"abs({_ring_sum(geom, CROSS)}) / 2")


def polygon_area_ha(geom: str = "geometry", mode: str = "planar") -> Column:
    """Hectares from metres (``planar``) or from degrees on a sphere (``geodesic``, an approximation)."""
    if mode == "planar":
        return polygon_area(geom) / F.lit(M2_PER_HA)
    term = "radians(q.x - p.x) * (2 + sin(radians(p.y)) + sin(radians(q.y)))"
    return F.expr(f"abs({_ring_sum(geom, term)})") * F.lit(EARTH_RADIUS_M**2 / 2 / M2_PER_HA)


def centroid(geom: str = "geometry") -> Column:
    """Area-weighted centroid as a struct; its fields are NULL without an area."""
    area2 = _ring_sum(geom, CROSS)
    x, y = (f"try_divide({_ring_sum(geom, f'(p.{a} + q.{a}) * {CROSS}')}, 3 * {area2})" for a in "xy")
    return F.expr(f"named_struct('x', {x}, 'y', {y})")


def perimeter(geom: str = "geometry") -> Column:
    return F.expr(_ring_sum(geom, "sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2))"))


def _extent(geom: str, axis: str, fn: str) -> Column:
    return F.expr(f"array_{fn}(transform(flatten({geom}), p -> p.{axis}))")


def with_bbox(df: DataFrame, geom: str = "geometry", prefix: str = "") -> DataFrame:
    cols = {f"{prefix}{a}{fn}": _extent(geom, a, fn) for a in "xy" for fn in ("min", "max")}
    return df.select("*", *[c.alias(n) for n, c in cols.items()])


def bbox(df: DataFrame, by: Sequence[str] = (), pad: float = 0.0, geom: str = "geometry") -> DataFrame:
    """Envelope of each group, widened by ``pad`` on every side."""
    b = with_bbox(df, geom)
    return b.groupBy(*by).agg((F.min("xmin") - pad).alias("xmin"), (F.max("xmax") + pad).alias("xmax"),
                              (F.min("ymin") - pad).alias("ymin"), (F.max("ymax") + pad).alias("ymax"))


def _clip_side(axis: str, bound: float, lower: bool) -> str:
    """One half-plane of a convex clip, over all rings: keep the inside, cut crossing edges at the bound."""
    other = "y" if axis == "x" else "x"
    inside = f"{{}}.{axis} {'>=' if lower else '<='} {bound!r}D"
    p, q = "element_at(r, i)", "element_at(r, i + 1)"
    at = f"{p}.{other} + ({q}.{other} - {p}.{other}) * ({bound!r}D - {p}.{axis}) / ({q}.{axis} - {p}.{axis})"
    xy = (f"{bound!r}D", at) if axis == "x" else (at, f"{bound!r}D")
    cut = f"named_struct('x', {xy[0]}, 'y', {xy[1]})"
    pin, qin = inside.format(p), inside.format(q)
    edges = (f"flatten(transform(sequence(1, size(r) - 1), i -> CASE WHEN {pin} AND {qin} THEN array({q}) WHEN {pin} THEN array({cut}) "
             f"WHEN {qin} THEN array({cut}, {q}) ELSE filter(array({q}), z -> false) END))")
    rings = f"filter(transform(filter(geometry, r -> size(r) > 1), r -> {edges}), c -> size(c) >= 3)"
    return f"transform({rings}, c -> concat(c, array(element_at(c, 1))))"


def clip_to_bbox(df: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Features that reach into the box, cut to it; column ``geometry``."""
    out = df
    for axis, bound, lower in (("x", xmin, True), ("x", xmax, False), ("y", ymin, True), ("y", ymax, False)):
        out = out.withColumn("geometry", F.expr(_clip_side(axis, float(bound), lower)))
    return out.filter((F.size("geometry") > 0) & (polygon_area() > 0))


def _edges(geom: str) -> Column:
    return F.expr(f"""flatten(transform(filter({geom}, r -> size(r) > 1), r -> transform(sequence(1, size(r) - 1), i -> named_struct(
        'x1', element_at(r, i).x, 'y1', element_at(r, i).y, 'x2', element_at(r, i + 1).x, 'y2', element_at(r, i + 1).y))))""")


def boundary_edges(df: DataFrame, by: Sequence[str], geom: str = "geometry") -> DataFrame:
    """Outline of each dissolved group: on a clean coverage an inner edge occurs twice and cancels."""
    e = df.select(*by, F.explode(_edges(geom)).alias("e")).select(*by, "e.*")
    swap = F.expr("x1 > x2 OR (x1 = x2 AND y1 > y2)")
    e = e.select(*by, *[F.when(swap, F.col(b)).otherwise(F.col(a)).alias(a2) for a, b, a2 in
                        (("x1", "x2", "ax"), ("y1", "y2", "ay"), ("x2", "x1", "bx"), ("y2", "y1", "by"))])
    return e.groupBy(*by, "ax", "ay", "bx", "by").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") % 2 == 1).drop("n")


def dissolve(df: DataFrame, by: Sequence[str], geom: str = "geometry") -> DataFrame:
    """One row per group: members, total area, outline length and box."""
    box = with_bbox(df.withColumn("__area", polygon_area(geom)), geom).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_members"), F.sum("__area").alias("area"), F.min("xmin").alias("xmin"),
        F.max("xmax").alias("xmax"), F.min("ymin").alias("ymin"), F.max("ymax").alias("ymax"))
    line = boundary_edges(df, by, geom).groupBy(*by).agg(
        F.sum(F.expr("sqrt(pow(bx - ax, 2) + pow(by - ay, 2))")).alias("boundary_length"), F.count(F.lit(1)).alias("n_edges"))
    return keyed_join(box, line, list(by), "inner")


def equal_area_buffer(df: DataFrame, x: str, y: str, area_ha: str, vertices: int = 64) -> DataFrame:
    """Circle of the given area around each point: its radius and a closed polygon."""
    r = F.sqrt(F.col(area_ha) * M2_PER_HA / F.lit(math.pi))
    ring = F.expr(f"transform(sequence(0, {vertices}), i -> named_struct('x', `{x}` + radius * cos(2 * pi() * (i % {vertices}) / {vertices}), "
                  f"'y', `{y}` + radius * sin(2 * pi() * (i % {vertices}) / {vertices})))")
    return df.withColumn("radius", r).withColumn("geometry", F.array(ring))


def _inside(edges: str, x: str, y: str) -> str:
    """Even-odd ray test of a point against an edge array."""
    hit = (f"(e.y1 > {y}) != (e.y2 > {y}) AND {x} < (e.x2 - e.x1) * ({y} - e.y1) / (e.y2 - e.y1) + e.x1")
    return f"aggregate({edges}, 0, (c, e) -> c + IF({hit}, 1, 0)) % 2 = 1"


def _turn(o: str, a: str, b: str) -> str:
    ax, ay = (f"{a[0]}", f"{a[1]}")
    return f"(({ax} - {o[0]}) * ({b[1]} - {o[1]}) - ({ay} - {o[1]}) * ({b[0]} - {o[0]}))"


def _edges_meet() -> str:
    """Two edges share a point (touching counts)."""
    a1, a2, b1, b2 = ("a.x1", "a.y1"), ("a.x2", "a.y2"), ("b.x1", "b.y1"), ("b.x2", "b.y2")
    boxes = " AND ".join(f"least(a.{c}1, a.{c}2) <= greatest(b.{c}1, b.{c}2) AND least(b.{c}1, b.{c}2) <= greatest(a.{c}1, a.{c}2)" for c in "xy")
    return (f"{boxes} AND signum({_turn(a1, a2, b1)}) * signum({_turn(a1, a2, b2)}) <= 0 "
            f"AND signum({_turn(b1, b2, a1)}) * signum({_turn(b1, b2, a2)}) <= 0")


def _cell_size(events: DataFrame, regions: DataFrame) -> float:
    """Cells about as wide as a typical event, but no region spans more than 128 of them each way."""
    e = events.agg(F.percentile_approx(F.greatest(F.expr("xmax - xmin"), F.expr("ymax - ymin")), 0.5).alias("m")).first()["m"]
    r = regions.agg(F.max(F.greatest(F.expr("r_xmax - r_xmin"), F.expr("r_ymax - r_ymin"))).alias("m")).first()["m"]
    return max(e or 0.0, (r or 0.0) / 128.0) or 1.0


def spatial_intersects_join(events: DataFrame, regions: DataFrame, event_cols: Sequence[str], region_cols: Sequence[str],
                            cell: float | None = None, broadcast_points: int = 1_000_000) -> DataFrame:
    """Pairs of event and region polygons that share a point; geometries are dropped.

    Both layers are cut into grid cells and meet on the cell. A pair is tested only in the cell that
    holds the lower left corner of their boxes' overlap, so no pair is tested twice and nothing needs
    de-duplication. Region cells are broadcast when their points are counted to be few; otherwise the
    join is salted, so a cell holding a large share of the events is spread over ``SALT`` tasks.
    """
    ev = with_bbox(events.select(*event_cols, "geometry"))
    rg = with_bbox(regions.select(*[F.col(c).alias(f"r_{c}") for c in region_cols], F.col("geometry").alias("r_geometry")), "r_geometry", "r_")
    s = float(cell) if cell else _cell_size(ev, rg)

    def celled(df, p):
        span = lambda a: f"sequence(cast(floor({p}{a}min / {s!r}D) AS int), cast(floor({p}{a}max / {s!r}D) AS int))"
        return df.withColumn("cx", F.explode(F.expr(span("x")))).withColumn("cy", F.explode(F.expr(span("y"))))

    r_cells = celled(rg.withColumn("r_edges", _edges("r_geometry")), "r_")
    starts = "transform(filter({}, r -> size(r) > 1), r -> r[0])"  # a vertex of every ring: a part may lie apart from the others
    r_cells = r_cells.withColumn("r_starts", F.expr(starts.format("r_geometry"))).drop("r_geometry")
    e_cells = celled(ev.withColumn("edges", _edges("geometry")), "").withColumn("starts", F.expr(starts.format("geometry"))).drop("geometry")
    if (r_cells.agg(F.sum(F.size("r_edges")).alias("n")).first()["n"] or 0) <= broadcast_points:
        j = e_cells.join(F.broadcast(r_cells), ["cx", "cy"])
    else:
        e_cells = e_cells.withColumn("salt", F.pmod(F.xxhash64(*event_cols), F.lit(SALT)))
        r_cells = r_cells.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint"))))
        j = e_cells.join(r_cells, ["cx", "cy", "salt"])
    j = j.filter(F.expr(f"""xmin <= r_xmax AND r_xmin <= xmax AND ymin <= r_ymax AND r_ymin <= ymax
        AND cx = floor(greatest(xmin, r_xmin) / {s!r}D) AND cy = floor(greatest(ymin, r_ymin) / {s!r}D)"""))
    near = ("filter(r_edges, b -> least(b.x1, b.x2) <= xmax AND greatest(b.x1, b.x2) >= xmin "
            "AND least(b.y1, b.y2) <= ymax AND greatest(b.y1, b.y2) >= ymin)")
    within = f"exists(starts, v -> {_inside('r_edges', 'v.x', 'v.y')})"
    around = f"exists(r_starts, v -> {_inside('edges', 'v.x', 'v.y')})"
    j = j.filter(F.expr(f"exists({near}, b -> exists(edges, a -> {_edges_meet()})) OR {within} OR {around}"))
    return j.select(*event_cols, *[F.col(f"r_{c}").alias(c) for c in region_cols])


def region_key(events: DataFrame, regions: DataFrame, event_cols: Sequence[str], region_cols: Sequence[str]) -> DataFrame:
    """Distinct (event, region) table."""
    return spatial_intersects_join(events, regions, event_cols, region_cols).distinct()


def _draw(polygons: DataFrame, ids: Sequence[str], seed) -> DataFrame:
    """Numbered uniform points in each polygon's box that fall inside it; ``__draws`` says how many to try."""
    spread = lambda axis, d: F.col(f"{axis}min") + uniform(seed, f"p{axis}", *ids, d) * (F.col(f"{axis}max") - F.col(f"{axis}min"))
    # tries are dealt out in blocks, so neither few polygons nor one with many tries end up in one task
    blocks = F.sequence(F.lit(0), F.expr(f"(__draws - 1) div {DRAW_BLOCK}"))
    polygons = polygons.withColumn("__block", F.explode(blocks)).repartition(
        polygons.sparkSession.sparkContext.defaultParallelism, *ids, "__block")
    first = F.col("__block") * DRAW_BLOCK
    tries = F.transform(F.sequence(first, F.least(first + DRAW_BLOCK, F.col("__draws").cast("bigint")) - 1),
                        lambda d: F.struct(d.alias("draw"), spread("x", d).alias("x"), spread("y", d).alias("y")))
    # exploding finished points keeps the hashes out of the per-edge test below
    p = polygons.withColumn("__p", F.explode(tries)).select(*ids, "__edges", "__p.*")
    return p.filter(F.expr(_inside("__edges", "x", "y"))).select(*ids, "draw", "x", "y")


def _decide(keys: int, min_dist: float):
    """Of tiles' points in drawing order: which of its own a tile keeps or drops, and which wait for a point of another tile.

    Rows: the ``keys`` columns of the polygon, tile (two numbers), draw, x, y, state, own; sorted by polygon, tile and draw.
    """
    limit = min_dist * min_dist

    def run(batches):
        tile, grid = None, {}
        for got in batches:
            state, own = (got.column(keys + n).to_pylist() for n in (5, 6))
            names = zip(*(got.column(n).to_pylist() for n in range(keys + 2)))
            for i, (name, x, y) in enumerate(zip(names, *(got.column(keys + n).to_pylist() for n in (3, 4)))):
                if name != tile:
                    tile, grid = name, {}
                cx, cy = math.floor(x / min_dist), math.floor(y / min_dist)
                if own[i] and state[i] == OPEN:
                    found = KEPT
                    for cell in ((cx + dx, cy + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)):
                        for x2, y2, other in grid.get(cell, ()):
                            if found != DROPPED and (x - x2) ** 2 + (y - y2) ** 2 < limit:
                                found = DROPPED if other == KEPT else OPEN
                    state[i] = found
                if state[i] != DROPPED:
                    grid.setdefault((cx, cy), []).append((x, y, state[i]))
            columns = [*got.columns[:keys], *got.columns[keys + 2:keys + 5], pa.array(state, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*got.schema.names[:keys], "draw", "x", "y", "state"]).filter(pa.array(own, pa.bool_()))

    return run


OPEN, KEPT, DROPPED = 0, 1, 2
TILE_POINTS = 4096


def thin_points(points: DataFrame, ids: Sequence[str], min_dist: float) -> DataFrame:
    """Keep a point unless an earlier kept one of the same polygon is nearer than ``min_dist``.

    A polygon is cut into square tiles of some ``TILE_POINTS`` points; a tile also gets the points within ``min_dist`` around it and decides
    its own in drawing order. What depends on an undecided point of another tile waits for the next round, which sees only
    kept and waiting points; the earliest one that waits is always decided, so rounds end, after two or three as a rule.
    """
    keys, span = list(ids), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    side = F.greatest(F.lit(8.0 * min_dist), span * F.sqrt(F.lit(float(TILE_POINTS)) / F.count(F.lit(1)))).alias("__side")
    state = attach(points.select(*keys, "draw", "x", "y"), small_table(points.groupBy(*keys).agg(side)), keys, "inner").withColumn("state", F.lit(OPEN))
    kept = None
    while True:
        tiles = state
        for axis in "xy":
            lo, hi = (F.floor((F.col(axis) + s * min_dist) / F.col("__side")) for s in (-1, 1))
            tiles = tiles.withColumn(f"t{axis}", F.explode(F.sequence(lo, hi)))
        own = (F.col("tx") == F.floor(F.col("x") / F.col("__side"))) & (F.col("ty") == F.floor(F.col("y") / F.col("__side")))
        tiles = tiles.withColumn("own", own)
        schema = tiles.select(*keys, "draw", "x", "y", "state").schema
        tiles = tiles.select(*keys, "tx", "ty", "draw", "x", "y", "state", "own").repartition(*keys, "tx", "ty").sortWithinPartitions(*keys, "tx", "ty", "draw", "x", "y")
        decided = materialize(tiles.mapInArrow(_decide(len(keys), min_dist), schema))
        kept = decided.where(F.col("state") == KEPT)
        if decided.where(F.col("state") == OPEN).isEmpty():
            return kept.select(*keys, "draw", "x", "y")
        state = attach(decided.where(F.col("state") != DROPPED), small_table(state.select(*keys, "__side").distinct()), keys, "inner")


def random_points(polygons: DataFrame, ids: Sequence[str], n: int, min_dist: float, seed, rounds: int = 8) -> DataFrame:
    """``n`` random points in each polygon, at least ``min_dist`` apart, numbered in drawing order.

    Polygons that come out short are drawn again with twice the tries, at most ``rounds`` times. A point is judged against
    earlier draws only, so more tries never change the points already found. ``shortfall`` says how many points of a
    polygon are missing after the last round (more may not fit); a polygon without any point has one row with NULL points.
    """
    p = with_bbox(polygons.select(*ids, "geometry")).withColumn("__edges", _edges("geometry"))
    ratio = F.try_divide(F.expr("(xmax - xmin) * (ymax - ymin)"), polygon_area())
    p = p.withColumn("__draws", F.ceil(1.3 * n * ratio + 10).cast("long")).drop("geometry")
    todo = p.filter("__draws IS NOT NULL")
    w = Window.partitionBy(*ids).orderBy("draw")
    done = None
    for turn in range(rounds):
        pts = materialize(_draw(todo, ids, seed))  # thinning reads it several times
        pts = thin_points(pts, ids, min_dist) if min_dist > 0 else pts
        pts = materialize(pts.withColumn("point", F.row_number().over(w)).filter(F.col("point") <= n).drop("draw"))
        full = pts.groupBy(*ids).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= n)
        short = todo.join(full, list(ids), "left_anti")
        last = turn == rounds - 1 or short.isEmpty()
        keep = pts if last else pts.join(full.select(*ids), list(ids), "left_semi")
        done = keep if done is None else done.unionByName(keep)
        if last:
            break
        todo = materialize(short.withColumn("__draws", F.col("__draws") * 2))
    found = done.groupBy(*ids).agg(F.count(F.lit(1)).alias("__n"))
    missing = materialize(p.select(*ids).join(found, list(ids), "left").select(*ids, (n - F.coalesce("__n", F.lit(0))).cast("int").alias("shortfall")))
    return missing.join(done, list(ids), "left").select(*ids, "x", "y", "point", "shortfall")

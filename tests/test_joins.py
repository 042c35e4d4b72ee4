"""Joins of hot and missing keys against plain Python."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from anchorframe.operators import joins
from anchorframe.operators.joins import many_to_many_join, unshared_ids


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("block", [7, 10_000])
def test_many_to_many_gives_every_pair(spark, how, block):
    left = [(k, n) for n, k in enumerate(["hot"] * 60 + [None] * 25 + ["few"] * 3 + ["alone"] * 20 + ["one"])] + [("hot", 0)] * 9
    right = [(k, n) for n, k in enumerate(["hot"] * 5 + [None] * 30 + ["few"] * 2 + ["other"] * 40)]
    a, b = spark.createDataFrame(left, "k string, x long").repartition(4), spark.createDataFrame(right, "k string, y long").repartition(3)
    got = many_to_many_join(a, b, ["k"], how, block)
    assert got.columns == ["k", "x", "y"]
    want = Counter((k, x, y) for k, x in left for k2, y in right if k == k2)
    if how == "left":
        want += Counter((k, x, None) for k, x in left if k not in {k2 for k2, _ in right})
    assert Counter(map(tuple, got.collect())) == want


def test_no_block_of_a_heavy_key_is_much_larger_than_asked(spark):
    a = spark.range(4000).select(F.lit(1).alias("k"), F.lit(2).alias("same"))
    blocks = spark.createDataFrame([(1, 8, 3)], "k int, __l_blocks long, __r_blocks long")
    sizes = [r["count"] for r in joins._dealt(a, blocks, ["k"], "l", "r").groupBy("__l", "__r").count().collect()]
    assert len(sizes) == 24 and sum(sizes) == 12_000 and max(sizes) < 2 * 500


def test_rows_of_a_heavy_key_are_copied_few_times(spark, monkeypatch):
    dealt, real = [], joins._dealt
    monkeypatch.setattr(joins, "_dealt", lambda *a: dealt.append(real(*a)) or dealt[-1])
    a = spark.range(12_000).select(F.when(F.col("id") % 3 > 0, 1).alias("k"), F.col("id").alias("x"))
    b = spark.range(4_000).select(F.when(F.col("id") % 2 > 0, 1).alias("k"), F.col("id").alias("y"))
    pairs = many_to_many_join(a, b, ["k"], "left", block=20)
    assert pairs.distinct().count() == 4_000 * 2_000 + 8_000 * 2_000
    assert sum(rows.count() for rows in dealt) <= 5 * 12_000 + 20 * 4_000
    assert "Union" not in pairs._jdf.queryExecution().executedPlan().toString()  # no branch without rows


@pytest.mark.parametrize("how", ["inner", "left"])
def test_cells_of_many_blocks_give_every_pair(spark, monkeypatch, how):
    for name, value in (("HELD", 6), ("COPIES", 2), ("PAIRS", 30), ("TASK_PAIRS", 50), ("TASK_CELLS", 3), ("TASK_COPIES", 40)):
        monkeypatch.setattr(joins, name, value)
    left = [(k, g, n) for n, (k, g) in enumerate([("hot", 1)] * 50 + [("hot", None)] * 9 + [(None, None)] * 25 + [("alone", 1)] * 20 + [("one", 2)])] + [("hot", 1, 0)] * 3
    right = [(k, g, n if n % 4 else None, f"{n}" if n % 3 else None) for n, (k, g) in enumerate([("hot", 1)] * 40 + [(None, None)] * 7 + [("other", 1)] * 40 + [("one", 2)] * 2)] + [("hot", 1, 1, "1")] * 2
    a, b = spark.createDataFrame(left, "k string, g int, x long").repartition(4), spark.createDataFrame(right, "k string, g int, y long, z string").repartition(3)
    want = Counter((k, g, x, y, z) for k, g, x in left for k2, g2, y, z in right if (k, g) == (k2, g2))
    keys = [r[:2] for r in right]
    got = many_to_many_join(a, b, ["k", "g"], how, 4)
    assert got.columns == ["k", "g", "x", "y", "z"]
    assert Counter(map(tuple, got.collect())) == want + Counter((*r, None, None) for r in left if how == "left" and r[:2] not in keys)
    bare = many_to_many_join(a, b.select("g", "k"), ["k", "g"], how, 4)  # the right has keys alone
    assert Counter(map(tuple, bare.collect())) == Counter(r for r in left for n in range(keys.count(r[:2]) or how == "left"))


def test_heavy_keys_of_one_side_only(spark):
    a, none = spark.range(9).select(F.lit(1).alias("k"), "id"), spark.createDataFrame([], "k int, y int")
    assert many_to_many_join(a, none, ["k"], "inner", 4).count() == many_to_many_join(none, a, ["k"], "left", 4).count() == 0
    assert sorted(map(tuple, many_to_many_join(a, none, ["k"], "left", 4).collect())) == [(1, n, None) for n in range(9)]


def test_many_to_many_with_empty_sides(spark):
    a, none = spark.createDataFrame([(1, 2)], "k int, x int"), spark.createDataFrame([], "k int, y int")
    assert many_to_many_join(a, none, ["k"]).count() == 0
    assert [tuple(r) for r in many_to_many_join(a, none, ["k"], "left").collect()] == [(1, 2, None)]


def test_unshared_ids_are_the_first_of_each_side(spark):
    a, b = spark.range(0, 50).toDF("k"), spark.range(40, 100).toDF("k").union(spark.createDataFrame([(None,)], "k long"))
    got = [tuple(r) for r in unshared_ids(a, b, "k", 2).collect()]
    assert sorted(got) == [("a", 1, 0), ("a", 2, 1), ("b", 1, 50), ("b", 2, 51)]

import datetime as dt
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from anchorframe.functions.hashing import uniform
from anchorframe.operators import ranking
from anchorframe.operators.ranking import drop_per_group, exact_quantiles, hash_rank, take_per_group, value_rank
from anchorframe.operators.sampling import (
    assign_k_dates_within_year, assign_random_date, dedupe_multi_region, draw_from_empirical, match_distribution,
    one_per_entity, padded_target, rebalance_controls, remainder, sample_n, sample_n_per_group, top_up)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, one is tiny, one key is NULL."""
    g = F.when(F.col("id") < 6000, "hot").when(F.col("id") < 6005, "tiny").when(F.col("id") < 7000, "mid")
    return spark.range(8000).select(F.col("id"), g.alias("g"), (F.col("id") * 7919 % 1000 / 10).alias("v")).cache()


def test_take_matches_plain_ranking(skewed):
    want = {}
    for r in hash_rank(skewed, ["g"], 1, "op", ["id"]).collect():
        want.setdefault(r.g, []).append((r["rank"], r.id))
    for g, pairs in want.items():
        assert sorted(k for k, _ in pairs) == list(range(1, len(pairs) + 1)), g
    for n in (0, 1, 5, 700, 100000):
        got = take_per_group(skewed, ["g"], n, 1, "op", ["id"]).collect()
        assert sorted(r.id for r in got) == sorted(i for p in want.values() for k, i in p if k <= n)
        left = drop_per_group(skewed, ["g"], n, 1, "op", ["id"]).collect()
        assert sorted(r.id for r in left) == sorted(i for p in want.values() for k, i in p if k > n)


def test_sample_ignores_partitioning(skewed):
    one = rows(sample_n(skewed.repartition(1), 100, 3, ["id"]))
    assert one == rows(sample_n(skewed.repartition(37), 100, 3, ["id"])) and len(one) == 100


def test_take_with_negative_and_missing_counts(spark):
    d = spark.createDataFrame([(i, "a" if i < 5 else "b", -2 if i < 5 else None) for i in range(10)], "id int, g string, n int")
    assert take_per_group(d, ["g"], "n", 1, "op", ["id"]).count() == 0
    assert drop_per_group(d, ["g"], "n", 1, "op", ["id"]).count() == 10


@pytest.mark.parametrize("parts", [4096, 8])
def test_exact_quantiles(spark, parts):
    rng = np.random.default_rng(5)
    data = {"hot": np.concatenate([np.full(3000, 2.5), rng.lognormal(0, 2, 2000)]), "few": np.array([3.0, 1.0, 2.0]), "one": np.array([7.0]), "flat": np.full(50, -1.0),
            "wide": np.concatenate([10.0 ** rng.uniform(-300, 300, 400), -10.0 ** rng.uniform(-300, 300, 400), [0.0, -0.0, 5e-324, 1e-323]]),
            "close": 1.0 + np.arange(300) * 2.0 ** -52, "ends": np.array([-np.inf, np.inf, 1.0, 2.0, 3.0] * 5)}
    d = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v] + [("few", float("nan")), ("few", None), ("none", None)], "g string, x double")
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.q): r.value for r in exact_quantiles(d, ["g"], ["x"], qs, parts).collect()}
    assert {g for g, _ in got} == set(data)
    for g, v in data.items():
        for q in qs:
            at = np.sort(v)[[int(np.floor(q * (len(v) - 1))), int(np.ceil(q * (len(v) - 1)))]]
            frac = q * (len(v) - 1) - np.floor(q * (len(v) - 1))
            assert got[(g, q)] == pytest.approx(at[0] if at[0] == at[1] else at[0] * (1 - frac) + at[1] * frac, rel=1e-12, nan_ok=True), (g, q)
    whole = {r.q: r.value for r in exact_quantiles(d, [], ["x"], [0.5], parts).collect()}
    assert whole[0.5] == pytest.approx(np.quantile(np.concatenate(list(data.values())), 0.5), rel=1e-12)


@pytest.mark.parametrize("hot", [True, False])
def test_ranges_of_ranks_are_of_about_equal_size(spark, monkeypatch, hot):
    kept = []
    write = ranking.materialize
    monkeypatch.setattr(ranking, "materialize", lambda df: kept.append(write(df)) or kept[-1])
    d = spark.range(40_000).select("id", (F.lit(1.0) if hot else F.rand(3)).alias("v"))
    assert value_rank(d, [], "v", ["id"]).agg(F.countDistinct("rank"), F.max("rank")).first() == (40_000, 40_000)
    sizes = [r["count"] for r in kept[0].groupBy("__bkt").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 40_000 / 8


def test_value_rank_with_a_hot_value(spark):
    d = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, F.lit(1.5)).otherwise(F.col("id") * 37 % 991 / 100.0).alias("v"), (F.col("id") < 10).alias("g"))
    got = value_rank(d, ["g"], "v", ["id"]).collect()
    for g in (True, False):
        part = sorted((r["rank"], r.v) for r in got if r.g == g)
        assert [k for k, _ in part] == list(range(1, len(part) + 1))
        assert [v for _, v in part] == sorted(v for _, v in part)


def test_random_dates(spark):
    d = assign_random_date(spark.range(3000), F.lit("2000-01-01"), F.lit("2000-01-10"), 9, ["id"])
    seen = Counter(r.rdm_date for r in d.collect())
    assert min(seen) == dt.date(2000, 1, 1) and max(seen) == dt.date(2000, 1, 10) and len(seen) == 10 and min(seen.values()) > 200


def test_k_dates_are_distinct_and_leap_aware(spark):
    d = spark.range(400).select("id", F.when(F.col("id") % 2 == 0, 2000).otherwise(2001).alias("year"))
    last = set()
    for r in assign_k_dates_within_year(d, "year", 5, 4, ["id"]).collect():
        assert len(set(r.dates)) == 5 and all(x.year == r.year for x in r.dates)
        last |= {(x.month, x.day) for x in r.dates if r.year == 2000}
    assert (2, 29) in last or len(last) > 300
    full = assign_k_dates_within_year(d.limit(1), "year", 366, 4, ["id"]).first()
    assert len(set(full.dates)) == 366


def test_sample_per_group_counts(spark, skewed):
    t = spark.createDataFrame([("hot", 10), ("tiny", 50), ("absent", 3)], "g string, n int")
    got = Counter(r.g for r in sample_n_per_group(skewed, ["g"], t, "n", 1, ["id"]).collect())
    assert got == {"hot": 10, "tiny": 5}


def test_draw_from_empirical(spark):
    cases = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), ("b", 3, 5.0)], "g string, c int, size double")
    targets = spark.range(600).select(F.col("id").alias("t"), F.when(F.col("id") < 400, "a").when(F.col("id") < 500, "b").otherwise("none").alias("g"))
    got = Counter((r.g, r["size"]) for r in draw_from_empirical(targets, cases, ["g"], "size", 1, ["t"], ["c"]).collect())
    assert set(got) == {("a", 10.0), ("a", 20.0), ("b", 5.0)} and got[("b", 5.0)] == 100 and 150 < got[("a", 10.0)] < 250
    kept = draw_from_empirical(targets, cases, ["g"], "size", 1, ["t"], ["c"], keep_empty=True)
    assert kept.filter("g = 'none' and size = 0").count() == 100


def test_match_distribution_quotas(spark):
    cases = spark.createDataFrame([("a", 0.05)] * 6 + [("a", 0.5)] * 3 + [("a", 0.95)], "g string, x double")
    pool = spark.range(300).select(F.col("id"), F.lit("a").alias("g"), F.when(F.col("id") < 200, 0.05).when(F.col("id") < 202, 0.5).when(F.col("id") < 299, 0.7).otherwise(1.5).alias("x"))
    target = spark.createDataFrame([("a", 18)], "g string, target bigint")
    # the bin of 0.95 is absent among controls, so shares are taken over 9 cases: 12 and 6, of which 2 exist
    got = match_distribution(pool, cases, ["g"], "x", 0.1, target, "half_even", 1, ["id"])
    assert Counter(r.x for r in got.collect()) == {0.05: 12, 0.5: 2}
    assert remainder(pool, got, ["id"]).count() == 300 - 14
    more = top_up(got, pool, F.col("x") == 0.7, 5, 1, ["id"])
    assert more.count() == 19 and more.select("id").distinct().count() == 19


def test_padded_target(spark):
    cases = spark.createDataFrame([("small", 1)] * 3 + [("big", 1)] * 20, "g string, i int")
    assert rows(padded_target(cases, ["g"])) == [("big", 100, 105), ("small", 15, 165)]


def test_dedupe_and_rebalance(spark):
    cases = [("e1", "r1"), ("e1", "r2"), ("e2", "r1"), ("e3", "r2"), ("e3", "r3")]
    d = spark.createDataFrame([(e, r, 1) for e, r in cases] + [(f"c{i}", f"r{i % 4 + 1}", 0) for i in range(9)], "id string, g string, pa int")
    kept, dropped, counts = dedupe_multi_region(d.filter("pa = 1"), "id", "g", 7)
    assert kept.select("id").distinct().count() == kept.count() == 3 and dropped.count() == 2
    out = rebalance_controls(kept.unionByName(d.filter("pa = 0")), "g", counts, 7, ["id"])
    lost = {r.g: r.n_drop for r in counts.collect()}
    have = Counter(r.g for r in d.filter("pa = 0").collect())
    left = Counter(r.g for r in out.filter("pa = 0").collect())
    assert all(left[g] == max(have[g] - lost.get(g, 0), 0) for g in have)
    many = spark.createDataFrame([("r1", 100)], "g string, n_drop int")
    assert rebalance_controls(d, "g", many, 7, ["id"]).filter("pa = 0 and g = 'r1'").count() == 0


def test_one_per_entity_covers_all(spark):
    d = spark.range(100).select((F.col("id") % 7).alias("e"), F.col("id").alias("rep"))
    got = one_per_entity(d, ["e"], 1, ["e", "rep"]).collect()
    assert len(got) == 7 and all(r.rep % 7 == r.e for r in got)


def test_uniform_looks_uniform(spark):
    u = np.array([r[0] for r in spark.range(4000).select(uniform(1, "x", "id")).collect()])
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.02

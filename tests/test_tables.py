import datetime as dt

import pytest
from anchorframe.functions.text import normalize_id, sort_by_level
from anchorframe.operators.aggregates import window_mean
from anchorframe.operators.tables import exclude_ids, first_rows, range_limits
from anchorframe.plans.regional import drought_at_event
from pyspark.sql import functions as F

from anchorframe.operators.aggregates import (
    WindowSpec, daily_moments, event_window_agg, event_window_agg_moments, reconcile, row_audit, share_in_group)
from anchorframe.operators.joins import (
    anchor_join, anti_join, id_overlap, keyed_join, lagged_period_join, natural_join, pair_semi_join, semi_join)
from anchorframe.operators.tables import (
    append, beyond_case_range, complete_cases, complete_scaffold, drop_columns_with_nulls, fill_missing, keep_groups,
    pivot_wide, range_limits, rows_with_missing, shared_columns_union, unpivot_long, with_overall_group)

NAN = float("nan")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_natural_join_matches_missing_keys(spark):
    a = spark.createDataFrame([(None, 1, "x"), ("k", 2, "y"), ("only", 3, "z")], "k string, n int, v string")
    b = spark.createDataFrame([(None, 1, 10), ("k", 2, 20), ("other", 9, 30)], "k string, n int, w int")
    assert rows(natural_join(a, b)) == rows(spark.createDataFrame(
        [(None, 1, "x", 10), ("k", 2, "y", 20), ("only", 3, "z", None)], "k string, n int, v string, w int"))
    full = natural_join(a, b, "full")
    assert full.columns == ["k", "n", "v", "w"] and ("other", 9, None, 30) in rows(full) and full.count() == 4
    assert semi_join(a, b, ["k", "n"]).count() == 2
    assert rows(anti_join(a, b, ["k", "n"])) == [("only", 3, "z")]
    with pytest.raises(ValueError):
        natural_join(a, b.select("w"))


def test_right_join_keeps_every_key(spark):
    a = spark.createDataFrame([("a", 1)], "k string, n int")
    b = spark.createDataFrame([("a",), ("b",)], "k string")
    assert rows(keyed_join(a, b, ["k"], "right")) == [("a", 1), ("b", None)]


def test_lagged_join(spark):
    e = spark.createDataFrame([("a", dt.date(2000, 1, 1)), ("a", dt.date(2002, 5, 5)), ("b", dt.date(2000, 1, 1))], "id string, d date")
    f = spark.createDataFrame([("a", 1999, 1.0), ("a", 2000, 2.0), ("b", 2000, 3.0)], "id string, year int, v double")
    assert rows(lagged_period_join(e, f, "id", "d", "year")) == rows(spark.createDataFrame(
        [("a", dt.date(2000, 1, 1), 1999, 1.0), ("a", dt.date(2002, 5, 5), 2001, None), ("b", dt.date(2000, 1, 1), 1999, None)],
        "id string, d date, year int, v double"))


def test_pair_semi_last_listing_wins(spark):
    d = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "id int, rep int")
    listing = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (2, 5, 2)], "id int, rep int, pos int")
    assert rows(pair_semi_join(d, listing, "id", "rep", "pos")) == [(1, 2)]


def test_id_overlap(spark):
    a = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    b = spark.createDataFrame([("a",), ("a",), ("a",), ("c",)], "k string")
    r = id_overlap(a, b, "k").first()
    assert (r.n_a, r.n_b, r.n_both, r.n_only_a, r.n_only_b, r.matched_rows, r.sample_only_a, r.sample_only_b) == (2, 2, 1, 1, 1, 6, "b", "c")


def test_anchor_join_salted_equals_broadcast(spark, monkeypatch):
    obs = spark.range(1000).select((F.col("id") % 3).alias("u"), F.col("id").alias("v"))
    anchors = spark.createDataFrame([(0, 5), (1, 6)], "u bigint, a int")
    plain = rows(anchor_join(obs, anchors, ["u"]))
    monkeypatch.setattr("anchorframe.operators.joins.SMALL_ROWS", 0)
    assert rows(anchor_join(obs, anchors, ["u"])) == plain


def test_missing_values(spark):
    d = spark.createDataFrame([(1, 1.0, 2.0), (2, NAN, 2.0), (3, None, 2.0)], "i int, x double, y double")
    assert rows(complete_cases(d).select("i")) == [(1,)]
    assert rows(rows_with_missing(d).select("i")) == [(2,), (3,)]
    assert drop_columns_with_nulls(d).columns == ["i", "y"]
    assert [r.x for r in fill_missing(d).orderBy("i").collect()] == [1.0, 0.0, 0.0]


def test_event_windows(spark):
    obs = [("e", o, float(10 + o)) for o in (-6, -5, -1, 0, 1, 10, 11)] + [("f", 30, 1.0), ("g", 0, NAN), ("g", 1, 4.0)]
    d = spark.createDataFrame(obs, "id string, offset int, vpd double")
    specs = [WindowSpec("vpd", -5, 10), WindowSpec("vpd", -1, 1, "max"), WindowSpec("vpd", 0, 0)]
    assert [s.out for s in specs] == ["vpd_m5_p10_mean", "vpd_m1_p1_max", "vpd_0_0_mean"]
    want = [("e", (5 + 9 + 10 + 11 + 20) / 5, 11.0, 10.0), ("f", None, None, None), ("g", 4.0, 4.0, None)]
    assert rows(event_window_agg(d, ["id"], specs)) == want
    assert rows(event_window_agg_moments(daily_moments(d, ["id", "offset"], ["vpd"]), ["id"], specs)) == want


def test_reshape(spark):
    long = spark.createDataFrame([("a", "crop", 0.25), ("a", "hay", 0.5), ("b", "crop", 1.0)], "id string, c string, p double")
    wide = pivot_wide(long, ["id"], "c", "p", ["crop", "hay", "water"])
    assert rows(wide) == [("a", 0.25, 0.5, 0.0), ("b", 1.0, 0.0, 0.0)]
    back = unpivot_long(wide, ["id"], ["crop", "hay"], "c", "p", "pos")
    assert rows(back) == [("a", "crop", 0.25, 1), ("a", "hay", 0.5, 2), ("b", "crop", 1.0, 1), ("b", "hay", 0.0, 2)]


def test_groups(spark):
    d = spark.createDataFrame([("a", 1, "x"), ("a", 0, "x"), ("a", 1, "y"), ("b", 0, "x"), (None, 1, "z"), (None, 1, "z")], "g string, pa int, e string")
    assert rows(keep_groups(d, ["g"], min_rows=2, where=F.col("pa") == 1).select("g").distinct()) == [("a",), (None,)]
    assert rows(keep_groups(d, ["g"], min_distinct=2, distinct_col="e").select("g").distinct()) == [("a",)]
    whole = with_overall_group(d.select("g", "e"), "g", "all", ["e"])
    assert whole.filter("g = 'all'").count() == 3
    assert complete_scaffold(d, "g", "e").count() == 9
    with pytest.raises(ValueError):
        complete_scaffold(d, "g", "e", max_levels=2)
    assert rows(share_in_group(d, ["g"], "e").select("g", "share")) == [("a", 1 / 3), ("a", 2 / 3), ("b", 1.0), (None, 1.0)]


def test_append(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    b = spark.createDataFrame([(2.0, 2)], "z double, n int")
    assert rows(append(a, b)) == [(1, "x", None), (2, None, 2.0)]
    assert shared_columns_union(a, b).columns == ["n"]


def test_case_range(spark):
    cases = spark.createDataFrame([("a", 1.0, 5.0, 5.0)], "g string, w double, d1 double, d2 double")
    controls = spark.createDataFrame([(1, "a", 2.0, 6.0, 0.0), (2, "a", 2.0, 5.0, 5.0), (3, "a", 1.0, 9.0, 9.0), (4, "none", 0.0, 0.0, 0.0),
                                      (5, "a", None, 9.0, 9.0), (6, "a", 2.0, None, 6.0)], "i int, g string, w double, d1 double, d2 double")
    limits = range_limits(cases, ["g"], ["w", "d1", "d2"])
    kept = beyond_case_range(controls, limits, ["g"], ["w"], ["d1", "d2"])
    assert rows(kept.select("i")) == [(2,), (3,), (5,)]
    assert rows(beyond_case_range(controls, limits, ["g"], ["w"], ["d1", "d2"], keep_beyond=True).select("i")) == [(1,), (4,), (6,)]


def test_nan_days_and_cases_are_left_out(spark):
    nan = float("nan")
    d = spark.createDataFrame([("r", 1, 0, 2.0), ("r", 1, 1, nan), ("r", 1, 2, 4.0), ("s", 2, 0, 8.0)], "region string, id int, offset int, v double")
    assert rows(window_mean(d, ["id"], ["v"], -5, 5)) == [(1, 3.0), (2, 8.0)]
    assert rows(range_limits(d, ["region"], ["v"])) == [("r", 4.0), ("s", 8.0)]
    # the overall group has the events of regions that are too small themselves
    got = rows(drought_at_event(d, "region", "id", ["v"], min_events=2).select("region", "id", "v"))
    assert got == [("all regions", 1, 3.0), ("all regions", 2, 8.0)]


def test_ids_levels_and_first_rows(spark):
    d = spark.createDataFrame([("005",), ("123.0",), (" 7 ",), ("12d",), ("7f",), ("NaN",), ("",)], "id string")
    assert [r[0] for r in d.select(normalize_id("id")).collect()] == ["5", "123", "7", "12d", "7f", "NaN", ""]
    e = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("z", 4), ("a", 1)], "k string, n int")
    assert [tuple(r) for r in sort_by_level(e, "k", ["b", "a"], "n").collect()] == [("b", 1), ("a", 1), ("a", 2), (None, 3), ("z", 4)]
    assert [tuple(r) for r in first_rows(e, 2, "n", "k").collect()] == [("a", 1), ("b", 1)]
    assert rows(exclude_ids(e, "k", ["a"]).filter("k is not null")) == [("b", 1), ("z", 4)] and exclude_ids(e, "k", ["a"]).count() == 3


def test_audit_and_reconcile(spark):
    a = spark.createDataFrame([("r", 1), ("r", 2), ("s", 3)], "g string, i int")
    cases = spark.createDataFrame([("r", 1), ("q", 1)], "g string, i int")
    assert rows(row_audit({"all": a}, cases, ["g"])) == [("q", 1, None, None), ("r", 1, 2, 1), ("s", None, 1, None)]
    new = spark.createDataFrame([(1, 10.0), (2, 5.0), (3, 0.0)], "k int, v double")
    old = spark.createDataFrame([(1, 7.0), (3, 1.0)], "k int, v double")
    got = rows(reconcile(new, old, ["k"], ["v"], 2.0))
    assert got == [(1, 10.0, 7.0, 3.0, 0.3, True), (2, 5.0, None, None, None, False), (3, 0.0, 1.0, 1.0, None, False)]

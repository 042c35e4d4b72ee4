import datetime as dt

from pyspark.sql import functions as F

from anchorframe.functions.classes import drought_class
from anchorframe.functions.dates import day_offset, decade_bucket, trailing_date
from anchorframe.functions.numbers import (
    bin_fixed, breakpoints, cut, format_effect, interval_labels, p_band, round_half_even, row_sum, signif)
from anchorframe.functions.text import in_list, normalize_id, relabel, relabel_pattern, snake_case, with_levels


def col(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_normalize_id(spark):
    got = col(spark, ["005", "123.0", " 7 ", "AL3010319920315", "", "  ", None, "NaN", "-3.9", "1e3"], "string", normalize_id("x"))
    assert got == ["5", "123", "7", "AL3010319920315", "", "", None, "NaN", "-3", "1000"]


def test_trailing_date(spark):
    got = col(spark, ["AL3010319920315", "19920230", "abc", None, "x19991231"], "string", trailing_date("x"))
    assert got == [dt.date(1992, 3, 15), None, None, None, dt.date(1999, 12, 31)]


def test_day_offset_modes(spark):
    anchor = dt.datetime(2020, 3, 1, 12)
    hours = [-36, -24, -12, 0, 12, 24, 36]
    rows = [(i, anchor + dt.timedelta(hours=h), anchor) for i, h in enumerate(hours)]
    df = spark.createDataFrame(rows, "i int, o timestamp_ntz, a timestamp_ntz").orderBy("i")
    modes = {m: [r[0] for r in df.select(day_offset("o", "a", m)).collect()] for m in ("date", "floor", "trunc", "raw", "abs")}
    assert modes["date"] == [-1, -1, 0, 0, 1, 1, 2]
    assert modes["floor"] == [-2, -1, -1, 0, 0, 1, 1]
    assert modes["trunc"] == [-1, -1, 0, 0, 0, 1, 1]
    assert modes["raw"] == [-1.5, -1.0, -0.5, 0.0, 0.5, 1.0, 1.5]
    assert modes["abs"] == [1.5, 1.0, 0.5, 0.0, 0.5, 1.0, 1.5]


def test_bins_on_edges(spark):
    third = 3 * 0.05  # a breakpoint in double arithmetic
    got = col(spark, [0.0, 0.05, third, 0.15, 0.1500001, 1.0, 1.01, -0.01, None], "double", bin_fixed("x", 0.05))
    assert got == ["[0,0.05]", "[0,0.05]", "(0.1,0.15]", "(0.1,0.15]", "(0.15,0.2]", "(0.95,1]", None, None, None]
    assert breakpoints(0, 1, 0.1)[3] == 0.30000000000000004
    assert interval_labels([0.0, 0.05, 0.1]) == ["[0,0.05]", "(0.05,0.1]"]
    assert col(spark, [0.2, 0.25, 0.3, 0.9], "double", cut("x", [0.2, 0.3, 0.8], ["low", "high"])) == ["low", "low", "low", None]


def test_rounding(spark):
    assert col(spark, [0.5, 1.5, 2.5, -2.5], "double", round_half_even("x")) == [0.0, 2.0, 2.0, -2.0]
    assert col(spark, [123456.0, 0.0012345, -98.7, 0.0], "double", signif("x", 2)) == [120000.0, 0.0012, -99.0, 0.0]
    assert col(spark, [12345.678, 10.0, 0.12345], "double", format_effect("x")) == ["1.23e+04", "10.000", "0.123"]


def test_p_band_bounds(spark):
    got = col(spark, [0.0005, 0.001, 0.005, 0.01, 0.03, 0.05, 0.2, None, float("nan")], "double", p_band("x"))
    assert got == ["<0.001", "<0.01", "<0.01", "<0.05", "<0.05", "0.050", "0.200", None, None]


def test_drought_classes_leave_no_gap(spark):
    got = col(spark, [-5.0, -4.995, -0.995, 0.0, 0.999, 1.0, 4.995, 5.0, None], "double", drought_class("x", "pdsi"))
    assert got == ["extreme drought", "severe drought", "near normal", "near normal", "near normal", "incipient wet spell",
                   "very wet", "extremely wet", None]
    assert col(spark, [-4.0, -0.1, 0.0], "double", drought_class("x", "pdsi_zone")) == ["Extreme Drought", "Drought", "wet"]
    assert col(spark, [-2.0, -0.5, -0.49, 0.5, 1.595, 2.0], "double", drought_class("x", "spei")) == [
        "extreme drought", "incipient dry spell", "near normal", "incipient wet spell", "moderately wet", "extremely wet"]


def test_labels(spark):
    assert col(spark, ["a", "b", None], "string", relabel("x", {"a": "A"})) == ["A", "b", None]
    assert col(spark, ["vpd_1.1.window_mean"], "string", relabel_pattern("x", [(r"_.*$", "")])) == ["vpd"]
    assert col(spark, ["Developed, Open Space "], "string", snake_case("x")) == ["developed_open_space"]
    assert col(spark, ["a", None], "string", in_list("x", ["a"])) == [True, False]
    df = with_levels(spark.createDataFrame([("lo",), ("hi",), ("other",)], "x string"), "x", ["hi", "lo"])
    assert {tuple(r) for r in df.collect()} == {("lo", 2), ("hi", 1), (None, None)}


def test_row_sum_forms(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 2.0)], "a double, b double")
    got = df.select(row_sum(["a", "b"]), row_sum(["a", "b"], skip_nulls=True)).collect()
    assert [tuple(r) for r in got] == [(3.0, 3.0), (None, 2.0)]


def test_decades(spark):
    assert col(spark, [0, 10, 11, 19, 20, 31], "int", decade_bucket(F.col("x"))) == [1, 1, 2, 2, 3, 3]

"""Case/control sampling. Randomness is a hash of the row's identity, see ``functions.hashing``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorframe.functions.hashing import order_key, uniform
from anchorframe.functions.numbers import bin_fixed
from anchorframe.operators.joins import anti_join
from anchorframe.operators.ranking import attach, drop_per_group, hash_rank, take_per_group
from anchorframe.session import small_table


def assign_random_date(df: DataFrame, start: str | Column, end: str | Column, seed, ids: Sequence[str],
                       out: str = "rdm_date") -> DataFrame:
    """A uniform day between two dates, both included."""
    s = (F.col(start) if isinstance(start, str) else start).cast("date")
    e = (F.col(end) if isinstance(end, str) else end).cast("date")
    days = F.floor(uniform(seed, "date", *ids) * (F.datediff(e, s) + 1)).cast("int")
    return df.withColumn(out, F.date_add(s, days))


def assign_k_dates_within_year(df: DataFrame, year: str, k: int, seed, ids: Sequence[str],
                               out: str = "dates") -> DataFrame:
    """``k`` distinct days of the row's own year, without replacement, as an array in draw order.

    Works inside the row (365 or 366 hashes), so it needs no shuffle.
    """
    first = F.make_date(F.col(year), F.lit(1), F.lit(1))
    n_days = F.datediff(F.make_date(F.col(year) + 1, F.lit(1), F.lit(1)), first)
    drawn = F.transform(F.sequence(F.lit(0), n_days - 1),
                        lambda d: F.struct(order_key(seed, "day", *ids, d).alias("k"), d.alias("d")))
    picked = F.slice(F.array_sort(drawn), 1, k)
    return df.withColumn(out, F.transform(picked, lambda p: F.date_add(first, p["d"])))


def spread_dates(df: DataFrame, dates: str, prefix: str, k: int) -> DataFrame:
    """Array of dates to columns ``prefix_1..prefix_k``."""
    return df.select("*", *[F.get(dates, i).alias(f"{prefix}_{i + 1}") for i in range(k)]).drop(dates)


def sample_n_per_group(pool: DataFrame, by: Sequence[str], targets: DataFrame, n_col: str, seed,
                       ids: Sequence[str]) -> DataFrame:
    """Exactly ``n_col`` rows per group (all when fewer), the counts coming from a target table."""
    rows = attach(pool, small_table(targets.select(*by, F.col(n_col).alias("__n_wanted"))), by, "inner")
    return take_per_group(rows, by, "__n_wanted", seed, "sample", ids).drop("__n_wanted")


def sample_n(pool: DataFrame, n: int, seed, ids: Sequence[str]) -> DataFrame:
    """``n`` random rows of the whole table."""
    return take_per_group(pool, [], n, seed, "sample", ids)


def case_counts(cases: DataFrame, by: Sequence[str], out: str = "n_cases") -> DataFrame:
    return cases.groupBy(*by).agg(F.count(F.lit(1)).alias(out))


def collect_values(df: DataFrame, by: Sequence[str], col: str, seed, ids: Sequence[str], out: str = "idx") -> DataFrame:
    """The values of each group as numbered rows (a list per group would have to fit one task)."""
    return hash_rank(df, by, seed, "index", ids, out).select(*by, out, col)


def draw_from_empirical(targets: DataFrame, cases: DataFrame, by: Sequence[str], value: str, seed,
                        target_ids: Sequence[str], case_ids: Sequence[str], keep_empty: bool = False) -> DataFrame:
    """Give each target a value drawn with replacement from the cases of its group.

    Cases are numbered within their group, the target draws a number, and the two meet on
    (group, number). A group without cases gives 0, and its targets are dropped unless kept.
    """
    indexed = collect_values(cases, by, value, seed, case_ids, "__idx")
    counts = small_table(case_counts(cases, by, "__n"))
    drawn = attach(targets, counts, by).withColumn(
        "__idx", (F.floor(uniform(seed, "draw", *target_ids) * F.col("__n")) + 1).cast("bigint"))
    out = attach(drawn, indexed, [*by, "__idx"]).withColumn(
        value, F.when(F.col("__n").isNull(), F.lit(0)).otherwise(F.col(value)))
    out = out if keep_empty else out.filter(F.col("__n").isNotNull())
    return out.drop("__n", "__idx")


def one_per_entity(df: DataFrame, entity: Sequence[str], seed, ids: Sequence[str]) -> DataFrame:
    """One random row per entity, as a minimum that combines before the shuffle."""
    rest = [c for c in df.columns if c not in entity]
    key = order_key(seed, "one", *ids)
    best = df.groupBy(*entity).agg(F.min(F.struct(key.alias("__k"), *rest)).alias("__best"))
    return best.select(*[F.col(c) if c in entity else F.col(f"__best.{c}") for c in df.columns])


def bin_shares(cases: DataFrame, by: Sequence[str], col: str, step: float) -> DataFrame:
    """Share of each group's cases per bin."""
    counts = cases.withColumn("bin", bin_fixed(col, step)).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n_cases"))
    total = counts.groupBy(*by).agg(F.sum("n_cases").alias("__t"))
    return attach(counts, total, by, "inner").withColumn("share", F.col("n_cases") / F.col("__t")).drop("__t")


def padded_target(cases: DataFrame, by: Sequence[str], mult: int = 5, small: int = 90, pad_small: int = 150,
                  pad: int = 5) -> DataFrame:
    """Controls wanted per group: a multiple of its cases, padded more when that is small."""
    n = F.count(F.lit(1)) * mult
    counts = cases.groupBy(*by).agg(n.cast("bigint").alias("total"))
    padded = F.when(F.col("total") < small, F.col("total") + pad_small).otherwise(F.col("total") + pad)
    return counts.withColumn("target", padded.cast("bigint"))


def bin_quotas(cases: DataFrame, controls: DataFrame, by: Sequence[str], col: str, step: float,
               targets: DataFrame, rounding: str) -> DataFrame:
    """Controls to keep per (group, bin): case share renormalised over the bins present among controls.

    The share of a bin over the shares of all present bins equals the ratio of case counts, so the
    quota is taken from whole numbers and does not depend on the order of a floating sum.
    """
    present = controls.withColumn("bin", bin_fixed(col, step)).groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n_pool"))
    q = attach(present, bin_shares(cases, by, col, step), [*by, "bin"]).na.fill(0, ["share", "n_cases"])
    total = q.groupBy(*by).agg(F.sum("n_cases").alias("__s"))
    q = attach(attach(q, total, by), targets.select(*by, "target"), by)
    raw = F.coalesce(F.try_divide(F.col("n_cases") * F.col("target"), F.col("__s")), F.lit(0.0))
    n = F.bround(raw, 0) if rounding == "half_even" else F.floor(raw)
    return q.withColumn("n_keep", n.cast("bigint")).drop("__s", "target")


def match_distribution(controls: DataFrame, cases: DataFrame, by: Sequence[str], col: str, step: float,
                       targets: DataFrame, rounding: str, seed, ids: Sequence[str]) -> DataFrame:
    """Subsample controls so that each (group, bin) holds the case share of the group's target.

    ``rounding`` is ``half_even`` or ``floor``. Values outside [0, 1] have no bin and are never kept.
    """
    quotas = small_table(bin_quotas(cases, controls, by, col, step, targets, rounding).select(*by, "bin", "n_keep"))
    binned = controls.withColumn("bin", bin_fixed(col, step)).filter(F.col("bin").isNotNull())
    rows = attach(binned, quotas, [*by, "bin"], "inner")
    return take_per_group(rows, [*by, "bin"], "n_keep", seed, f"match_{col}", ids).select(*controls.columns)


def top_up(selected: DataFrame, pool: DataFrame, where: Column, n: int, seed, ids: Sequence[str]) -> DataFrame:
    """Add ``n`` random rows of a named stratum that are not selected yet."""
    spare = anti_join(pool.filter(where), selected, ids)
    extra = take_per_group(spare, [], n, seed, "top_up", ids)
    return selected.unionByName(extra.select(*selected.columns))


def remainder(pool: DataFrame, selected: DataFrame, ids: Sequence[str]) -> DataFrame:
    return anti_join(pool, selected, ids)


def dedupe_multi_region(df: DataFrame, key: str, region: str, seed) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keep one random region of an entity listed in several: (kept, dropped, dropped count by region)."""
    pick = F.min(F.struct(order_key(seed, "region", key, region).alias("k"), F.col(region).alias("r")))
    chosen = df.groupBy(key).agg(pick.alias("__p")).select(key, F.col("__p.r").alias("__keep"))
    flagged = attach(df, chosen, [key], "inner")
    same = F.col(region).eqNullSafe(F.col("__keep"))
    kept, dropped = flagged.filter(same).drop("__keep"), flagged.filter(~same).drop("__keep")
    return kept, dropped, dropped.groupBy(region).agg(F.count(F.lit(1)).alias("n_drop"))


def rebalance_controls(df: DataFrame, by: str, drop_counts: DataFrame, seed, ids: Sequence[str],
                       pa: str = "pa") -> DataFrame:
    """Remove as many random controls per region as cases were dropped there; never below zero left."""
    rows = attach(df.filter(F.col(pa) == 0), small_table(drop_counts.select(by, "n_drop")), [by])
    rows = rows.withColumn("n_drop", F.coalesce("n_drop", F.lit(0)))
    left = drop_per_group(rows, [by], "n_drop", seed, "rebalance", ids).select(*df.columns)
    return df.filter(F.col(pa) == 1).unionByName(left)



"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) is the data, BENCH_CPUS (default 8) the local cores.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from anchorframe.catalog import QUERIES

HEADLINE = [
    "event_window_features", "drought_at_event", "lagged_period_join", "id_overlap", "keep_groups",
    "exclude_beyond_case_range", "balance_report", "value_profile", "correlation_matrix", "reconcile",
    "sample_n_per_group", "draw_from_empirical", "match_distribution", "rebalance_controls", "histogram", "density",
    "quantile_band", "coef_table", "selection_table", "row_diagnostics", "random_intercept", "spatial_intersects_join",
    "random_points", "presence_absence", "select_controls",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("anchorframe-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()

"""Time the headline queries: prints one JSON line.  ``python bench.py --all`` times every query."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "flagship_rolling_rate_by_nation",
    "s1_scan_parquet",
    "p7_quality_filter",
    "f7_dictionary_replace",
    "f10_local_to_utc",
    "f18_bad_weather_flag",
    "a2_pct_frequency",
    "a4_summary_stats",
    "a9_conditional_rate",
    "a13_corr_matrix",
    "a17_empirical_cdf",
    "a24_utility_score",
    "w1_rolling_avg_range",
    "w2_rolling_sum_multi_safe",
    "w3_rolling_ratio",
    "w5_surrogate_row_id",
    "w11_annualized_volatility",
    "w14_fill_chain",
    "w20_top_k_per_group",
    "u3_distinct_rows",
    "j1_inner_equi",
    "j4_interval_join",
    "j5_asof_join_2h_4h",
    "j6_nearest_neighbor_geo",
    "j12_calendar_asof_fill",
    "g5_transition_matrix",
    "g7_pagerank",
    "b5o_cohort_summary",
    "b6o_sharpe",
    "m7_stratified_split",
    "m13_logistic_regression",
    "m17_logistic_gd",
    "m21_roc_auc",
    "m28_knn_classify",
    "d1_ols_summary",
    "d9_fixed_effects",
]


def main() -> None:
    from feathergrid.plans import catalog
    from feathergrid.session import get_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    names = list(catalog.QUERIES) if "--all" in sys.argv else HEADLINE
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()  # start the engine
    times, exchanges = {}, {}
    for name in names:
        start = time.time()
        df = catalog.QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        plan = df._jdf.queryExecution().executedPlan().toString()
        exchanges[name] = sum("Exchange" in line and "ReusedExchange" not in line for line in plan.splitlines())
        spark.catalog.clearCache()
    total = round(sum(times.values()), 3)
    out = {"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times}
    out["sf"] = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    if "--all" in sys.argv:
        out["exchanges"] = exchanges
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()

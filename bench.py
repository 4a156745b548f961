"""Time the headline queries and print one JSON line.

BENCH_SF_DIR selects the tables, BENCH_CPUS the local cores, BENCH_QUERIES an optional comma list of names.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship_model_ranking", "h1_regression_errors", "h4_spearman", "h7_roc_auc", "h8_average_precision", "e1_rank_ties_min",
    "d1_metric_dedupe", "d2_best_row_per_dataset", "d5_reference_comparison", "d6_cross_dataset_model_summary",
    "d14_most_common_value", "d16_selector_family_enrichment", "d31_ensemble_vs_best_base", "d35_ablation_summary",
    "c1_occurrence_join", "c3_multiway_alignment", "c12_rank_against_reference", "c13_nearest_neighbour_join", "g6_order_free_signatures",
    "i2_stratified_holdout", "i3_group_holdout", "i5_hash_split", "i8_group_kfold", "j3_exact_duplicate_columns",
    "j9_hashed_presence_features", "b4_median_fill", "l1_knn_novelty", "m1_prediction_diversity", "m2_friedman_test",
    "k11_inverse_rmse_weights", "k12_out_of_fold_stacking", "k13_score_fusion_candidates", "a15_incremental_feature_cache",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    from evalspark.plans import all_queries
    from evalspark.session import build_session

    spark = build_session("bench", f"local[{cpus}]", cpus, {"spark.ui.enabled": "false", "spark.driver.memory": "12g",
                                                            "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    sink = lambda df: df.write.format("noop").mode("overwrite").save()
    registry = all_queries()
    sink(registry["h1_regression_errors"].build(spark, sf))  # start the engine before timing
    times = {}
    for name in names:
        started = time.perf_counter()
        sink(registry[name].build(spark, sf))
        times[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({"metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf.rstrip("/").rsplit("/", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Times the headline queries once each and prints one JSON line.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (local cores).
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "positive_edges", "min_degree_edges", "external_only_edges", "network_match_edges", "stratified_split", "negative_pool", "industry_negatives", "bootstrap_sample",
    "roc_auc", "threshold_table", "f1_f2_grid", "macro_stability", "prediction_intervals", "highvar_by_degree", "wasserstein",
    "candidate_pairs", "scored_imputations", "imputation_by_year", "overlap_sweep", "source_pair_overlap",
    "longest_run", "epoch_mean_std", "hist_wasserstein", "normalized_adjacency", "message_passing", "gcn_encode", "bigru_encode", "multi_model_inference",
]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from chronoloom import catalog

    found, times = catalog.queries(), {}
    spark.read.parquet(f"{folder}/orders.parquet").count()
    for name in HEADLINE:
        began = time.time()
        found[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()

"""Wall seconds of the headline queries: median of three runs after one warm-up. Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from datalathe.plans.queries import QUERIES
from datalathe.session import local_session

HEADLINE = (
    "profile_base",
    "profile_numeric",
    "profile_moments",
    "entropy",
    "column_types",
    "category_freq_top",
    "histogram",
    "normality",
    "dup_rows",
    "dedup_first",
    "dup_columns",
    "impute_median",
    "impute_ffill",
    "impute_preview",
    "quartiles_wide",
    "outliers_iqr",
    "outliers_modz",
    "tx_boxcox",
    "corr_pearson",
    "corr_pearson_wide",
    "corr_spearman",
    "corr_kendall_wide",
    "cramers_v",
    "enc_label",
    "enc_multilabel",
    "scale_robust",
    "recommendations",
    "replay_steps",
)


def run(query, spark, folder: str) -> float:
    start = time.perf_counter()
    # The noop sink computes every row without bringing it to the driver.
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cores)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run(QUERIES[name], spark, folder)
        seconds[name] = round(statistics.median(run(QUERIES[name], spark, folder) for _ in range(repeats)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total of medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "cores": cores,
                "shuffle_partitions": 8,
            }
        )
    )


if __name__ == "__main__":
    main()

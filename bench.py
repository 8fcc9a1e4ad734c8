"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskweave.operators import features, rules  # noqa: E402
from riskweave.plans.catalogue import QUERIES  # noqa: E402
from riskweave.session import tune  # noqa: E402
from riskweave.sources.corpus import corpus_table  # noqa: E402

HEADLINE = (
    "a01_finding_summary", "p02_node_table", "r01_hardcoded_password", "r14_scan", "f14_line_count",
    "f25_all_features", "f28_zscore", "f33_tf_idf", "g10_dataset_split", "xp1_detect_pii", "xp2_redact_pii",
    "xe3_explain_finding", "e05_roc_auc", "e07_roc_curve", "e09_auc_one_vs_rest", "e19_leaderboard",
    "u2_analysis_complete", "s01_directory_scan", "l01c_logistic_regression",
)
COPIES = int(os.environ.get("BENCH_COPIES", "60"))


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("riskweave-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tune(spark)
    # Start the JVM's code paths and the Python workers before timing.
    run(QUERIES["a01_finding_summary"](spark, folder))
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        run(QUERIES[name](spark, folder))
        times[name] = round(time.perf_counter() - start, 3)
    corpus = corpus_table(spark, folder, COPIES)
    size = features.text_measures(corpus).agg(F.count("*"), F.sum("line_count"), F.sum("char_count")).first()
    start = time.perf_counter()
    run(rules.findings(corpus))
    seconds = time.perf_counter() - start
    times["scan_large_corpus"] = round(seconds, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "scan": {
                    "files": size[0], "lines": size[1], "chars": size[2],
                    "lines_per_second": round(size[1] / seconds), "mb_per_second": round(size[2] / seconds / 1e6, 1),
                },
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

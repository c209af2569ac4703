"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores, ``BENCH_QUERIES`` an optional
comma-separated list of other registered queries (``all`` for every one).
"""

from __future__ import annotations

import json
import os
import time

from nextcover.session import local_session
from workload.catalog import REGISTRY
from workload.registry import runner

# one query per stage of the work
HEADLINE = [
    "likely_next_products", "category_from_four_fields", "product_lookup_join", "first_and_second_policy",
    "neighbouring_policy", "event_index", "consecutive_policy_pairs", "client_360_view", "single_policy_clients",
    "training_rows", "flags_ideal_and_tenure_product_and_segment_product_and_three_way", "changes_of_category",
    "sliding_examples", "extended_history_features", "scoring_input", "propensity_features", "median_imputation",
    "ordinal_codes", "target_encoding", "outliers_by_quartile_range", "score_ranks", "score_deciles",
    "advisor_smart_list", "multi_product_strategy", "client_narrative", "prediction_outcomes", "feature_drift",
    "class_report",
]


def timed(spark, name: str, sf_dir: str) -> float:
    """Seconds to compute every row and column of a query, without moving them to the driver."""
    start = time.perf_counter()
    runner(REGISTRY[name])(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(REGISTRY) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = local_session(cpus)
    timed(spark, HEADLINE[0], sf_dir)  # start the JVM's code paths
    times = {n: timed(spark, n, sf_dir) for n in names}
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

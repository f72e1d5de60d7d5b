"""Times the headline queries once each, after a run on the smallest tables; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from featureline.queries import QUERIES  # noqa: E402
from featureline.queries.models import _model_path  # noqa: E402
from featureline.session import build_session  # noqa: E402

HEADLINE = [
    "j1_asof_ttl", "j1_asof_strict_tiebreak", "j1_asof_customer_features", "j1_asof_hot_user", "j2_two_views",
    "j2_views_with_different_keys", "j3_features_with_labels", "j5_keyed_insert", "s6_parquet_sink",
    "s9_online_incremental", "t1_stream_materialize", "w2_latest_per_key", "w3_stratified_split_orders",
    "a7_scaler_statistics", "a9_roc_auc_many_scores", "d1_spine_errors", "d4_leakage_many_labels",
    "d5_completeness", "o1_log_table", "o2_utilisation_alarm", "o3_dashboard", "s11_synthetic_features",
    "m1_standardize",
]
MODELS = ["m2_random_forest", "m6_batch_scoring", "m12_train_job"]


def timed(spark, names: list[str], sf_dir: str) -> dict[str, float]:
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    return seconds


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    # The smallest tables go first, so that starting the engine and compiling the plans is not counted.
    smallest = f"{os.path.dirname(sf_dir)}/sf0.001"
    if os.path.isdir(smallest):
        timed(spark, HEADLINE, smallest)
    result = {"metric": "headline_total", "value": 0.0, "unit": "sec"}
    seconds = timed(spark, HEADLINE, sf_dir)
    # A tenth of the rows: ten times the rows should cost less than twelve times the time.
    tenth = f"{os.path.dirname(sf_dir)}/sf0.01"
    if os.path.basename(sf_dir) == "sf0.1" and os.path.isdir(tenth):
        small = timed(spark, HEADLINE, tenth)
        result["growth_for_10x_rows"] = round(sum(seconds.values()) / sum(small.values()), 2)
    start = time.perf_counter()
    _model_path(spark, sf_dir)  # the fit that the model queries share
    seconds["model_fit"] = round(time.perf_counter() - start, 3)
    seconds |= timed(spark, MODELS, sf_dir)
    result |= {"value": round(sum(seconds.values()), 3), "queries": seconds,
               "sf": os.path.basename(sf_dir).removeprefix("sf")}
    print(json.dumps(result))


if __name__ == "__main__":
    main()

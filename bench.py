"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from riskloom.operators import windows as w  # noqa: E402
from riskloom.plans import load_queries  # noqa: E402
from riskloom.plans.registry import Tables  # noqa: E402
from riskloom.session import local_session  # noqa: E402

HEADLINE = [
    "feature_table", "velocity_day_frames", "velocity_time_frames", "velocity_row_frames", "previous_row_features",
    "moving_average", "places_revisited", "merchant_fraud_history_on_rows", "spend_profile", "qr_profile",
    "person_risk_profile", "category_group_counts", "risk_exposure", "mode_flags", "crosstab_ratios", "weight_of_evidence",
    "information_value", "label_transactions", "labelled_sample_of_cards", "activity_histogram", "column_value_counts",
    "secondary_sort", "top_totals", "token_cooccurrence", "graph_neighbors", "graph_transitions", "threshold_sweep",
    "velocity_skewed", "velocity_burst", "random_forest_scores",
]
# Minutes each at sf0.1; run them by name: boosted_tree_scores, random_walks, node_embedding, model_trained_on_features.


def velocity_skewed(spark, folder):
    """A third of the transactions on one card."""
    txn = Tables(spark, folder).txn
    hot = F.when(F.pmod(F.xxhash64("txn_id"), F.lit(3)) == 0, F.lit(-1)).otherwise(F.col("card"))
    return w.velocity(txn.withColumn("card", hot), "card", "ts", "txn_id", "cents", [w.LAST3, w.DAY3, w.HOUR2])


def velocity_burst(spark, folder):
    """All transactions of one card, within two hours."""
    squeezed = F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.unix_micros(F.col("ts").cast("timestamp")) % 7_200_000_000)
    txn = Tables(spark, folder).txn.withColumns({"ts": squeezed, "card": F.lit(1)})
    return w.velocity(txn, "card", "ts", "txn_id", "cents", [w.LAST3, w.HOUR2])


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("riskloom-bench", cores, int(cores) if cores.isdigit() else 8)
    queries = {**load_queries()[0], "velocity_skewed": velocity_skewed, "velocity_burst": velocity_burst}
    chosen = sys.argv[1:] or HEADLINE
    # One small pass warms the JVM, so the first query is not charged for it.
    queries["mean_spend"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        # Every output column is computed; nothing is sent to the driver.
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline query wall time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cores": cores,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

"""Time the tables that queries share and the headline queries; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from verification.queries import Inputs, run

HEADLINE = [
    "patient_sequences",
    "discretize",
    "universal_events",
    "censor_at_index",
    "censor_any_row",
    "add_age",
    "build_visits",
    "build_sequences",
    "horizon_test_sets",
    "stratified_split",
    "build_vocab",
    "encode_mlm",
    "encode_classifier",
    "metrics_by_horizon",
    "attribution_summary",
    "smooth",
    "patient_profile",
    "top_codes",
]


# Tables that several queries start from, each computed once and stored, in this order.
SHARED = ["crosswalk", "index", "demo", "events", "seqs", "cohort", "split", "vocab"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM and its code generator outside the clock.
    run("confusion", spark, sf_dir).write.format("noop").mode("overwrite").save()
    Inputs.forget()
    shared, seconds = {}, {}
    for name in SHARED:
        start = time.time()
        getattr(Inputs(spark, sf_dir), name)
        shared[name] = round(time.time() - start, 3)
    for name in HEADLINE:
        start = time.time()
        run(name, spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "time of the tables that queries share, once each, and of the headline queries beyond them",
                "value": round(sum(seconds.values()) + sum(shared.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "shared": shared,
                "sf": sf_dir.rstrip("/").split("sf")[-1],
            }
        )
    )


if __name__ == "__main__":
    main()

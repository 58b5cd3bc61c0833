"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Shapes of the published baseline, then further operators.
HEADLINE = "pricing_summary shipping_priority local_supplier forecast_revenue promo_revenue window_ranks window_navigation window_frames session_funnel json_pipeline unnest_correlated array_agg_events information_schema_columns wildcard_scan qualify_top_per_group rollup pivot as_of_join range_sessionize gap_fill merge property_graph".split()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    from larkspur.plans import suite

    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):  # the first run compiles and reads for the first time
            began = time.time()
            suite.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        seconds[name] = round(min(runs), 4)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

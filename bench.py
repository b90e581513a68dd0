"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmith.operators import detectors, features, forest, series
from seriesmith.plans import registry

#: Detectors, the multi-series rolling statistics, the forest and the evaluation grid.
HEADLINE = (
    *("rolling_trailing", "rolling_users", "zscore_adaptive", "prederr_adaptive", "hybrid_adaptive", "mean_shift_adaptive", "isolation_forest"),
    *("global_zscore", "iqr", "tumbling_zscore", "ensemble", "fuzzy_eval", "series_stats", "fill_interpolate"),
)
#: Operators over every series repeated ten times, a million rows at sf0.1, and over one series of all rows, dealt out in runs.
LARGE = {
    "rolling_times_10": lambda spark, d: features.rolling(series.tile(registry.events(spark, d), 10), 20),
    "isolation_forest_times_10": lambda spark, d: forest.isolation_forest(series.tile(registry.events(spark, d), 10)),
    "zscore_one_series": lambda spark, d: detectors.rolling_zscore(one_series(spark, d), threshold=registry.ADAPTIVE, chunk=1 << 14),
}


def one_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return series.to_series(rows, F.lit("all"), "ts", "value", "event_id", unit="day")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "8g"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    made = {name: registry.QUERIES[name] for name in HEADLINE} | LARGE
    run = lambda name: made[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("series_stats")  # starts the workers and compiles what all share
    times = {}
    for name in made:
        best = []
        for _ in range(2):
            began = time.perf_counter()
            run(name)
            best.append(time.perf_counter() - began)
        times[name] = round(min(best), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times[name] for name in HEADLINE), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()

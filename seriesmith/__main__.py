"""Command line: list, info, detect, evaluate, benchmark."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import detectors, ensemble, evaluate, features, forest, series
from .sources import files


def session(cores: str = "*") -> SparkSession:
    return SparkSession.builder.master(f"local[{cores}]").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="seriesmith", description="Anomalies in folders of series, CSV files with timestamp and value.")
    parser.add_argument("command", choices=["list", "info", "detect", "evaluate", "benchmark"])
    parser.add_argument("root", help="folder of series")
    parser.add_argument("--series", nargs="*", help="names; all by default")
    parser.add_argument("--algorithm", choices=[*ensemble.REGISTRY, "all", "ensemble"], default="all")
    parser.add_argument("--sensitivity", choices=[*ensemble.SENSITIVITY], default="Medium")
    parser.add_argument("--fill", choices=series.FILLS, default="interpolate")
    parser.add_argument("--normalize", choices=["standard", "minmax"], help="detect on normalised values")
    parser.add_argument("--labels", help="JSON file of labelled intervals")
    parser.add_argument("--cores", nargs="*", type=int, default=[1, 2, 4, 8], help="for benchmark")
    parser.add_argument("--times", type=int, default=10, help="for benchmark: how often each series is repeated")
    parser.add_argument("--output", help="folder of results")
    args = parser.parse_args(argv)
    if args.command == "benchmark":
        benchmark(args)
        return
    spark = session()
    if args.command == "list":
        print("\n".join(files.catalog(spark, args.root)))
        return
    rows = series.validate(files.read_series(spark, args.root, args.series))
    df = series.preprocess(series.to_series(rows, "series_id", "timestamp", "value"), args.fill, args.normalize)
    if args.command == "info":
        series.series_stats(df).show(1000, truncate=False)
        return
    if args.normalize:
        df = df.withColumn("value", F.col("value_normalized")).drop("value_normalized")
    names = tuple(ensemble.REGISTRY) if args.algorithm in ("all", "ensemble") else (args.algorithm,)
    wide = ensemble.detect_wide(df, names, {n: ensemble.preset(n, args.sensitivity) for n in names}).cache()
    long = ensemble.stacked(wide, names)
    if args.algorithm == "ensemble":
        long = ensemble.vote(wide, names).join(df, ["series_id", "idx"]).withColumns({"algorithm": F.lit("ensemble"), "detection_type": F.lit("")})
    ensemble.run_summary(long).show(truncate=False)
    if args.command == "evaluate":
        _, labels = files.with_labels(df, files.read_labels(spark, args.labels))
        spans = evaluate.intervals_to_index(df, labels)
        for name in ("ensemble",) if args.algorithm == "ensemble" else names:
            print(name)
            evaluate.fuzzy(long.where(F.col("algorithm") == name), spans).show(1000, truncate=False)
    if args.output:
        files.write_wide(wide.drop(*(f"{n}_type" for n in names)) if args.algorithm != "ensemble" else long, f"{args.output}/points")
        files.write_results(long, f"{args.output}/by_series")
        files.write_report(ensemble.run_summary(long), f"{args.output}/summary")


#: What is timed with several numbers of cores.
TIMED = {"global_zscore": detectors.global_zscore, "rolling": features.rolling, "isolation_forest": forest.isolation_forest}


def benchmark(args: argparse.Namespace) -> None:
    """Seconds, speedup and efficiency by cores of each of TIMED over tiled series, one line of pandas' rolling statistics beside them."""
    times: dict[str, list[tuple[int, float]]] = {name: [] for name in TIMED}
    for cores in args.cores:
        spark = session(str(cores))
        df = series.tile(series.to_series(files.read_series(spark, args.root, args.series), "series_id", "timestamp", "value"), args.times)
        for name, f in TIMED.items():
            best = []
            for _ in range(2):
                began = time.perf_counter()
                f(df).write.format("noop").mode("overwrite").save()
                best.append(time.perf_counter() - began)
            times[name].append((cores, min(best)))
        if cores == args.cores[-1]:
            parts = [p["value"] for _, p in files.to_pandas(df.select("series_id", "idx", "value")).sort_values("idx").groupby("series_id")]
            began = time.perf_counter()
            for values in parts:
                values.rolling(20, min_periods=10).agg(["mean", "std"])
            print(f"pandas rolling, in memory: {time.perf_counter() - began:.4f} s")
            for name, rows in times.items():
                print(name)
                evaluate.scalability(spark.createDataFrame(rows, "cores int, seconds double")).show()
        else:
            spark.stop()


if __name__ == "__main__":
    main()

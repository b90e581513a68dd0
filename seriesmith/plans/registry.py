"""Queries by name over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.core import Quantile, Threshold, stats
from ..operators import detectors, ensemble, evaluate, features, forest, series
from . import oracles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Queries over several detectors, whose SQL stands beside the form without the forest, which SQL cannot follow.
OF_DETECTORS = ("detect_all", "detect_wide", "ensemble", "run_summary", "eval_grid", "eval_means", "eval_pivot", "eval_averages")
ORACLES: dict[str, str] = {f"{k}_without_forest" if k in OF_DETECTORS else k: v for k, v in oracles.SQL.items()}

#: Window of the registered tumbling queries, and width of buckets that truth is built of.
TUMBLING, TRUTH_BUCKET = "6 hours", "12 hours"
#: The threshold policies of the registered detectors; the percentile falls between two rows.
PERCENTILE, K = 97.3, 3.0
PERCENT, ADAPTIVE = Threshold("percentile", percentile=PERCENTILE), Threshold("adaptive_std", k=K)


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def events(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    """Events as series by type; gaps: every 17th value is missing."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    value = F.when(F.col("event_id") % 17 != 0, F.col("value")) if gaps else F.col("value")
    return series.to_series(rows, "event_type", "ts", value, "event_id")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.to_series(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "ts", "value", "event_id")


def out(df: DataFrame, *columns: str, keys: tuple[str, ...] = ("series_id", "idx")) -> DataFrame:
    """keys, then the columns, doubles rounded to six places."""
    rounded = [F.round(c, 6).alias(c) if df.schema[c].dataType.typeName() == "double" else F.col(c) for c in columns]
    return df.select(*keys, *rounded)


def found(df: DataFrame, keys: tuple[str, ...] = ("series_id", "idx")) -> DataFrame:
    return out(df, "score", "label", "detection_type", keys=keys)


def _register(name: str, f: Query) -> None:
    QUERIES[name] = f


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events where every 13th value is not a number."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return series.to_series(rows, "event_type", "ts", F.when(F.col("event_id") % 13 != 0, F.col("value")).otherwise(F.lit(float("nan"))), "event_id")


def emptied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which one series has no value at all."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return series.to_series(rows, "event_type", "ts", F.when(F.col("event_type") != EMPTY, F.col("value")), "event_id")


#: The series of emptied().
EMPTY = "click"

for _m in series.FILLS:
    _register({"forward_fill": "fill_ffill"}.get(_m, f"fill_{_m}"), lambda s, d, m=_m: out(series.fill(events(s, d, True), m), "value"))
for _m in ("standard", "minmax"):
    _register(f"scale_{_m}", lambda s, d, m=_m: out(series.scale(events(s, d), m), "value_normalized"))
_register("scale_robust", lambda s, d: out(series.robust_scale(events(s, d)), "value", "value_normalized"))
_register("denormalize", lambda s, d: out(series.denormalize(series.scale(events(s, d), keep=True)), "value_normalized", "value_denormalized"))
_register("preprocess", lambda s, d: out(series.preprocess(events(s, d, True), "interpolate", "minmax"), "value", "value_normalized"))
_register("series_stats", lambda s, d: out(series.series_stats(events(s, d)), "count", "mean", "std", "min", "max", "median", "q25", "q75", "skewness", "kurtosis", keys=("series_id",)))


_register("fill_long_series", lambda s, d: out(series.fill(events(s, d, True), chunk=128), "value"))
_register("fill_nan", lambda s, d: out(series.fill(numbered(s, d)), "value"))
_register("series_stats_nan", lambda s, d: out(series.series_stats(numbered(s, d)), "count", "mean", "std", "min", "max", "median", "q25", "q75", "skewness", "kurtosis", keys=("series_id",)))


@query
def labelled_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = series.labelled_stats(users(spark, sf_dir))
    return out(df.withColumns({c: series.format_timestamp(F.col(c)) for c in ("first_ts", "last_ts")}), "rows", "mean", "std", "min", "max", "first_ts", "last_ts", keys=("series_id",))


_register("memory_usage", lambda s, d: series.memory_usage(events(s, d)))
_register("tile", lambda s, d: out(series.tile(events(s, d), 3), "value"))
@query
def series_by_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series view, numbered by slices of a day."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return out(series.to_series(rows, "event_type", "ts", "value", "event_id", unit="day"), "value")


_register("synthetic", lambda s, d: out(series.synthetic(s, 10_000), "value"))
_register("rolling_trailing", lambda s, d: out(features.rolling(events(s, d), 20), "rolling_mean", "rolling_std"))
_register("rolling_centered", lambda s, d: out(features.rolling(events(s, d), 20, centre=True), "rolling_mean", "rolling_std"))
_register("rolling_users", lambda s, d: out(features.rolling(users(s, d), 20), "rolling_mean", "rolling_std"))
_register("rolling_range", lambda s, d: out(features.rolling_range(events(s, d), 40), "rolling_max", "rolling_min", "rolling_range"))
_register("sliding_features", lambda s, d: out(features.sliding_features(events(s, d), 10), "row_num", "window_mean_10", "window_std_10"))


@query
def rolling_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = features.window_matrix(events(spark, sf_dir), 16, 4)
    ends = m.select("series_id", "start", "centre", F.aggregate("window", F.lit(0.0), lambda a, x: a + x).alias("total"), F.element_at("window", 1).alias("first"), F.element_at("window", -1).alias("last"))
    return out(ends, "centre", "total", "first", "last", keys=("series_id", "start"))


_register("forecast_ma", lambda s, d: out(features.forecast(events(s, d), 10), "prediction"))
_register("error_smoothing", lambda s, d: out(features.smooth(features.abs_diff(events(s, d)), "abs_diff", 5, "smooth"), "abs_diff", "smooth"))
_register("trend_slope", lambda s, d: out(features.trend(events(s, d), 5), "trend"))
_register("trend_gradient", lambda s, d: out(features.gradient(features.trend(events(s, d), 5)), "trend", "gradient"))
_register("box_count", lambda s, d: out(features.box_count(events(s, d), F.col("value") > 100), "box_count"))
_register("downsample_minmax", lambda s, d: out(features.downsample(events(s, d), 300), "value"))
_register("histogram", lambda s, d: features.histogram(events(s, d), 30))


@query
def sampled_with_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The down-sampled series with all anomalies put back, each timestamp once."""
    df = events(spark, sf_dir)
    marked = detectors.global_zscore(df).where("label = 1").select(*df.columns)
    return out(features.keep_first([features.downsample(df, 300), marked]), "value")


for _name, _t in (("fixed", None), ("percentile", PERCENT), ("adaptive", ADAPTIVE)):
    _register(f"zscore_{_name}", lambda s, d, t=_t: found(detectors.rolling_zscore(events(s, d), threshold=t or Threshold("fixed", 3.0))))
    _register(f"prederr_{_name}", lambda s, d, t=_t: found(detectors.prediction_error(events(s, d), smoothing=3, threshold=t or Threshold("fixed", 3.0))))
    _register(f"hybrid_{_name}", lambda s, d, t=_t: found(detectors.hybrid(events(s, d), threshold=t or Threshold("fixed"))))
    _register(f"mean_shift_{_name}", lambda s, d, t=_t: found(detectors.mean_shift(events(s, d), threshold=t or Threshold("fixed", 0.5))))


@query
def hybrid_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = detectors.hybrid(events(spark, sf_dir), threshold=Threshold("percentile", percentile=90.1))
    return h.where("label = 1").groupBy("series_id", "detection_type").agg(F.count("*").alias("n"))


def long_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as series by type, numbered by slices of a day, as very long series are."""
    return series.to_series(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "ts", "value", "event_id", unit="day")


#: The operators with series dealt out in short runs, so that no task holds a series.
_register("rolling_long_series", lambda s, d: out(features.rolling(long_events(s, d), 20, chunk=256), "rolling_mean", "rolling_std"))
for _name, _f in (("zscore", detectors.rolling_zscore), ("prederr", detectors.prediction_error), ("hybrid", detectors.hybrid), ("mean_shift", detectors.mean_shift)):
    for _policy, _t in (("", ADAPTIVE), ("_percentile", PERCENT)):
        _more = {"smoothing": 3} if _name == "prederr" else {}
        _register(f"{_name}{_policy}_long_series", lambda s, d, f=_f, t=_t, m=_more: found(f(long_events(s, d), threshold=t, chunk=256, **m)))
_register("all_detectors_long_series", lambda s, d: found(ensemble.detect_all(long_events(s, d), WITHOUT_FOREST, {n: {"threshold": ADAPTIVE, "chunk": 256} for n in WITHOUT_FOREST}), ("algorithm", "series_id", "idx")))


_register("global_zscore", lambda s, d: out(detectors.global_zscore(events(s, d)), "zscore", "score", "label"))
_register("global_zscore_gaps", lambda s, d: out(detectors.global_zscore(events(s, d, True)), "zscore", "score", "label"))
_register("prederr_empty_series", lambda s, d: found(detectors.prediction_error(emptied(s, d), smoothing=3, threshold=ADAPTIVE)))
_register("iqr_long_series", lambda s, d: out(detectors.iqr(events(s, d), joined=True), "value", "q1", "q3", "lower", "upper"))
#: Detection by position after rows were dropped, of whole series and of runs of rows.
for _name, _f in (("zscore", detectors.rolling_zscore), ("prederr", detectors.prediction_error), ("hybrid", detectors.hybrid), ("mean_shift", detectors.mean_shift)):
    for _suffix, _chunk in (("", None), ("_long_series", 128)):
        _register(f"{_name}_after_drop{_suffix}", lambda s, d, f=_f, c=_chunk: found(f(series.fill(events(s, d, True), "drop", c), threshold=ADAPTIVE, chunk=c), ("series_id", "idx", "pos")))
_register("global_zscore_filter", lambda s, d: out(detectors.global_zscore_filter(events(s, d)), "value", "mean", "std", "zscore"))
_register("simple_sigma_filter", lambda s, d: out(detectors.global_zscore_filter(events(s, d), 1.0), "value", "zscore"))
_register("iqr", lambda s, d: out(detectors.iqr(events(s, d), joined=False), "value", "q1", "q3", "lower", "upper"))
_register("tumbling_zscore", lambda s, d: out(detectors.tumbling_zscore(events(s, d), TUMBLING), "value", "mean", "std", "n", "zscore"))
_register("tumbling_iqr", lambda s, d: out(detectors.tumbling_iqr(events(s, d), TUMBLING), "value", "q1", "q3"))
_register("spark_rolling", lambda s, d: found(detectors.plain_rolling_zscore(events(s, d))))
_register("compare_methods", lambda s, d: detectors.compare_methods(events(s, d)))

#: All detectors, and those that SQL can follow.
NAMES = tuple(ensemble.REGISTRY)
WITHOUT_FOREST = ("rolling_zscore", "prediction_error", "hybrid", "mean_shift")


def wide_form(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = NAMES, k: float = K) -> DataFrame:
    """Detectors at the adaptive threshold; the forest, which has none, at its default contamination."""
    return ensemble.detect_wide(events(spark, sf_dir), names, {n: {"threshold": Threshold("adaptive_std", k=k)} for n in names if n != "isolation_forest"})


for _s, _n in (("", NAMES), ("_without_forest", WITHOUT_FOREST)):
    _register(f"detect_all{_s}", lambda s, d, n=_n: found(ensemble.stacked(wide_form(s, d, n), n), ("algorithm", "series_id", "idx")))
    _register(f"detect_wide{_s}", lambda s, d, n=_n: out(wide_form(s, d, n), *(f"{x}_{c}" for x in n for c in ("anomaly", "score"))))
    _register(f"ensemble{_s}", lambda s, d, n=_n: out(ensemble.vote(wide_form(s, d, n), n), "score", "label"))
    _register(f"run_summary{_s}", lambda s, d, n=_n: out(ensemble.run_summary(ensemble.stacked(wide_form(s, d, n), n)), "points", "anomalies", "percent", "min_score", "max_score", "mean_score", keys=("algorithm",)))
_register("top_anomalies", lambda s, d: found(ensemble.top_anomalies(detectors.rolling_zscore(events(s, d), threshold=ADAPTIVE))))
_register("dominant_type", lambda s, d: ensemble.dominant_type(detectors.hybrid(events(s, d), threshold=Threshold("percentile", percentile=90.1))))
_register("if_features", lambda s, d: out(forest.forest_features(events(s, d)), *forest.FEATURES))
_register("isolation_forest", lambda s, d: found(forest.isolation_forest(events(s, d))))


def intervals(df: DataFrame) -> DataFrame:
    """Truth made of the data: by series and bucket of time, from the first to the last value beyond the 99th percentile."""
    high = stats(df, {"_p": Quantile("value", 0.99)}).where("value > _p").withColumn("_b", F.window("timestamp", TRUTH_BUCKET)["start"])
    spans = high.groupBy("series_id", "_b").agg(F.min("timestamp").alias("start_ts"), F.max("timestamp").alias("end_ts"))
    return spans.select("series_id", (F.row_number().over(Window.partitionBy("series_id").orderBy("start_ts")) - 1).cast("long").alias("interval_id"), "start_ts", "end_ts")


def judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labelled points of the adaptive z-score, with truth; the intervals by index."""
    df = events(spark, sf_dir)
    spans = intervals(df)
    return evaluate.point_mask(detectors.rolling_zscore(df, threshold=ADAPTIVE), spans), evaluate.intervals_to_index(df, spans)


METRICS = ("tp", "fp", "fn", "tn", "precision", "recall", "f1", "fpr")
_S = ("series_id",)


@query
def interval_to_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir)
    return evaluate.intervals_to_index(df, intervals(df))


@query
def point_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir)
    return out(evaluate.point_mask(df, intervals(df)), "truth")


_register("confusion", lambda s, d: evaluate.confusion(judged(s, d)[0]))
_register("point_metrics", lambda s, d: out(evaluate.point_metrics(judged(s, d)[0]), *METRICS, keys=_S))
_register("metrics_summary", lambda s, d: evaluate.metrics_summary(evaluate.point_metrics(judged(s, d)[0])))
_register("fuzzy_eval", lambda s, d: out(evaluate.fuzzy(*judged(s, d), tolerance=5), *METRICS, "score", keys=_S))


@query
def fuzzy_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every interval labelled twice."""
    points, spans = judged(spark, sf_dir)
    twice = spans.unionByName(spans.withColumn("interval_id", F.col("interval_id") + 100_000))
    return out(evaluate.fuzzy(points, twice, 5), *METRICS, "score", keys=_S)


_register("detection_delay", lambda s, d: out(evaluate.detection_delay(judged(s, d)[0]), "delay_samples", "delay_seconds", keys=_S))
_register("detection_delay_long_series", lambda s, d: out(evaluate.detection_delay(judged(s, d)[0], chunk=128), "delay_samples", "delay_seconds", keys=_S))
_register("simple_score", lambda s, d: out(evaluate.simple_score(judged(s, d)[0]), "fp", "fn", "score", keys=_S))
_register("baseline_rank", lambda s, d: out(evaluate.baseline_rank(evaluate.simple_score(judged(s, d)[0])), "score", "vs_htm", "vs_rcf", "vs_skyline", "rank", keys=_S))
_register("score_contrast", lambda s, d: out(evaluate.score_contrast(judged(s, d)[0]), "inside", "outside", "contrast", keys=_S))
_register("diagnostic_ratio", lambda s, d: out(evaluate.diagnostic_ratio(judged(s, d)[0]), "detected_percent", "truth_percent", "ratio", keys=_S))


def grid(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = NAMES) -> DataFrame:
    """Fuzzy metrics by series, algorithm and sensitivity; of each sensitivity all detectors in one pass."""
    df = events(spark, sf_dir)
    spans = evaluate.intervals_to_index(df, intervals(df))
    out_ = None
    for threshold in ("Low", "Medium"):
        long = ensemble.detect_all(df, names, {n: ensemble.preset(n, threshold) for n in names})
        one = evaluate.fuzzy(long, spans, 5, names).select("series_id", "algorithm", F.lit(threshold).alias("threshold"), "precision", "recall", "f1", "tp", "fp", "fn")
        out_ = one if out_ is None else out_.unionByName(one)
    return out_


for _s, _n in (("", NAMES), ("_without_forest", WITHOUT_FOREST)):
    _register(f"eval_grid{_s}", lambda s, d, n=_n: out(grid(s, d, n), "precision", "recall", "f1", "tp", "fp", "fn", keys=("series_id", "algorithm", "threshold")))
    _register(f"eval_means{_s}", lambda s, d, n=_n: evaluate.grouped_mean(grid(s, d, n), ("algorithm", "threshold")))
    _register(f"eval_pivot{_s}", lambda s, d, n=_n: evaluate.pivot_f1(evaluate.grouped_mean(grid(s, d, n), ("algorithm", "threshold")), ("Low", "Medium")))
    _register(f"eval_averages{_s}", lambda s, d, n=_n: out(evaluate.averages(grid(s, d, n)), "avg_precision", "avg_recall", "avg_f1", "std_f1", "best", keys=("algorithm",)))


@query
def eval_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by category of series, those of purchases and signups and the rest, algorithm and sensitivity, without the forest."""
    category = F.when(F.col("series_id").isin("purchase", "signup"), "sales").otherwise("other")
    return evaluate.grouped_mean(grid(spark, sf_dir, WITHOUT_FOREST).withColumn("category", category))


@query
def scalability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speedup if time falls with the square root of the cores, by region key for cores."""
    regions = spark.read.parquet(f"{sf_dir}/region.parquet")
    times = regions.select((F.col("r_regionkey") + 1).cast("int").alias("cores"), (F.lit(100.0) / F.sqrt(F.col("r_regionkey") + 1)).alias("seconds"))
    return out(evaluate.scalability(times), "seconds", "speedup", "efficiency", keys=("cores",))


def _swept(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = events(spark, sf_dir)
    return detectors.global_zscore(df), evaluate.intervals_to_index(df, intervals(df))


_register("threshold_sweep", lambda s, d: out(evaluate.sweep(*_swept(s, d)), "raw_score", "tp", "fp", "fn", keys=("threshold",)))


@query
def null_perfect_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The simplified raw score hits - misses - 0.11 false alarms of the adaptive z-score, normalised in each cost profile."""
    points, spans = judged(spark, sf_dir)
    total = evaluate.fuzzy(points, spans, 5).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    out_ = None
    for name, (hit, miss, alarm) in evaluate.PROFILES.items():
        raw = total.select(F.lit(name).alias("profile"), (hit * F.col("tp") - miss * F.col("fn") - alarm * F.col("fp")).alias("raw_score"))
        one = evaluate.normalised(raw, spans, name)
        out_ = one if out_ is None else out_.unionByName(one)
    return out(out_, "raw_score", "null_raw", "perfect_raw", "score", keys=("profile",))


@query
def iforest_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir)
    return out(evaluate.fuzzy(forest.isolation_forest(df), evaluate.intervals_to_index(df, intervals(df)), 5), *METRICS, keys=_S)

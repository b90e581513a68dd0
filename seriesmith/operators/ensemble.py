"""Detectors by name, all at once, the vote, and summaries of their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import Threshold
from . import detectors, forest

REGISTRY: dict[str, Callable[..., DataFrame]] = {
    "rolling_zscore": detectors.rolling_zscore,
    "prediction_error": detectors.prediction_error,
    "hybrid": detectors.hybrid,
    "isolation_forest": forest.isolation_forest,
    "mean_shift": detectors.mean_shift,
}

#: Fixed values of the sensitivity presets: k of adaptive_std, and the forest's contamination.
SENSITIVITY = {"Low": (4.0, 0.002), "Medium": (3.0, 0.005), "High": (2.0, 0.05)}


def detect(df: DataFrame, name: str, **parameters) -> DataFrame:
    if name not in REGISTRY:
        raise ValueError(f"unknown detector {name!r}; one of {sorted(REGISTRY)}")
    return REGISTRY[name](df, **parameters)


def preset(name: str, sensitivity: str) -> dict:
    """The parameters of a detector at a sensitivity."""
    k, contamination = SENSITIVITY[sensitivity]
    return {"contamination": contamination} if name == "isolation_forest" else {"threshold": Threshold("adaptive_std", k=k)}


def _chunked(parameters: dict[str, dict] | None) -> bool:
    return any(p.get("chunk") is not None for p in (parameters or {}).values())


def detect_wide(df: DataFrame, names: tuple[str, ...] = tuple(REGISTRY), parameters: dict[str, dict] | None = None) -> DataFrame:
    """The rows of a series view with <name>_score, <name>_anomaly and <name>_type of each detector.

    Each detector adds its columns to the rows of the one before, so that the
    series are numbered, dealt out and sorted once for all. Detectors with chunk=
    join their rows to statistics of the series; those are run apart from each
    other and put together by series and idx. An error of one is raised, not
    dropped.
    """
    if _chunked(parameters):
        parts = [(n, detect(df, n, **(parameters or {}).get(n, {}))) for n in names]
        columns = lambda n: [F.col("score").alias(f"{n}_score"), F.col("label").alias(f"{n}_anomaly"), F.col("detection_type").alias(f"{n}_type")]
        for n, found in parts:
            df = df.join(found.select("series_id", "idx", *columns(n)), ["series_id", "idx"])
        return df
    for name in sorted(names, key="isolation_forest".__eq__):  # the forest last, as a Python step forgets how its input was dealt out
        df = detect(df, name, **(parameters or {}).get(name, {})).withColumnsRenamed({"score": f"{name}_score", "label": f"{name}_anomaly", "detection_type": f"{name}_type"})
    return df


def stacked(wide: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The long form of detect_wide: a row for each detector, with score, label, detection_type and algorithm."""
    own = [c for c in wide.columns if c not in {f"{n}_{s}" for n in names for s in ("score", "anomaly", "type")}]
    one = lambda n: F.struct(F.col(f"{n}_score").alias("score"), F.col(f"{n}_anomaly").alias("label"), F.col(f"{n}_type").alias("detection_type"), F.lit(n).alias("algorithm"))
    return wide.select(*own, F.inline(F.array(*map(one, names))))


def detect_all(df: DataFrame, names: tuple[str, ...] = tuple(REGISTRY), parameters: dict[str, dict] | None = None) -> DataFrame:
    """All detectors in long form, with a column algorithm."""
    if _chunked(parameters):
        out = None
        for n in names:
            one = detect(df, n, **(parameters or {}).get(n, {})).withColumn("algorithm", F.lit(n))
            out = one if out is None else out.unionByName(one)
        return out
    return stacked(detect_wide(df, names, parameters), names)


def wide(long: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """A row per point, with <name>_anomaly and <name>_score for each detector, of a long form that was written and read."""
    picked = [f(F.when(F.col("algorithm") == n, F.col(c))).alias(f"{n}_{s}") for n in names for f, c, s in ((F.max, "label", "anomaly"), (F.max, "score", "score"))]
    return long.groupBy("series_id", "idx").agg(F.first("timestamp").alias("timestamp"), F.first("value").alias("value"), *picked)


def vote(wide: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Half of the detectors or more make a label; the score is their mean. wide: as detect_wide gives it."""
    mean = lambda s: sum((F.col(f"{n}_{s}") for n in names[1:]), F.col(f"{names[0]}_{s}")) / F.lit(float(len(names)))
    return wide.select("series_id", "idx", mean("score").alias("score"), (mean("anomaly") >= 0.5).cast("int").alias("label"))


def run_summary(long: DataFrame) -> DataFrame:
    """By algorithm: points, anomalies, percent, least, largest and mean score."""
    n, a = F.count("*"), F.sum("label")
    return long.groupBy("algorithm").agg(n.alias("points"), a.alias("anomalies"), (a * 100.0 / n).alias("percent"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.avg("score").alias("mean_score"))


def top_anomalies(df: DataFrame, most: int = 100) -> DataFrame:
    """The first labelled rows of the whole result in the order of series and idx."""
    return df.where("label = 1").orderBy("series_id", "idx").limit(most)


def dominant_type(df: DataFrame) -> DataFrame:
    """By series the most frequent type among labelled rows, the one seen first on a tie."""
    counted = df.where("label = 1 and detection_type <> ''").groupBy("series_id", "detection_type").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"))
    by = Window.partitionBy("series_id").orderBy(F.desc("n"), "first_idx")
    return counted.withColumn("_rank", F.row_number().over(by)).where("_rank = 1").select("series_id", F.col("detection_type").alias("dominant_type"), "n")

"""Causal detectors over streams of points: what looks only back can run as points arrive."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "series_id string, timestamp timestamp, value double, zscore double, prediction double, label int"


def rolling_stream(points: DataFrame, width: int = 20, limit: float = 4.0, forecast: int = 10) -> DataFrame:
    """Rolling z-score and moving-average forecast of a stream (series_id, timestamp, value).

    The state of a series is its last max(width, forecast) values; points of one
    trigger are taken in the order of time, and a point that comes in a later
    trigger than a younger one counts as it comes. Null values are left out. z
    is 0 below width // 2 values, the forecast null below `forecast` values.
    """
    keep, least = max(width, forecast), max(1, width // 2)

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past = np.array(state.get[0] if state.exists else [], float)
        rows = pd.concat(list(parts)).dropna(subset=["value"]).sort_values(["timestamp", "value"], kind="stable")
        new = rows["value"].to_numpy(float)
        every = np.r_[np.full(keep, np.nan), past, new]  # windows that reach before the first value see nothing there
        first = len(every) - len(new)
        frames = lambda size, end: np.lib.stride_tricks.sliding_window_view(every, size)[first - size + end : len(every) - size + end]
        window = frames(width, 1)
        n = np.isfinite(window).sum(1)
        mean = np.nansum(window, 1) / np.maximum(n, 1)
        std = np.sqrt(np.nansum((window - mean[:, None]) ** 2, 1) / np.maximum(n - 1, 1))
        z = np.where((std > 0) & (n >= least), np.abs(new - mean) / np.where(std > 0, std, 1.0), 0.0)
        state.update((every[np.isfinite(every)][-keep:].tolist(),))
        yield pd.DataFrame({"series_id": key[0], "timestamp": rows["timestamp"].to_numpy(), "value": new, "zscore": z, "prediction": frames(forecast, 0).mean(1), "label": (z >= limit).astype(np.int32)})

    points = points.select("series_id", F.col("timestamp").cast("timestamp").alias("timestamp"), F.col("value").cast("double").alias("value"))
    return points.groupBy("series_id").applyInPandasWithState(run, SCHEMA, "past array<double>", "append", GroupStateTimeout.NoTimeout)


def tumbling_stream(points: DataFrame, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Count, mean and sample deviation of each series' time windows, emitted when the watermark has passed them."""
    timed = points.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late)
    windows = timed.groupBy("series_id", F.window("timestamp", length).alias("w")).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return windows.select("series_id", F.col("w.start").alias("window_start"), "n", "mean", "std")

"""Detectors: a series view in, the same rows with score, label and detection_type out. All are lazy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.core import Quantile, Threshold, capped, centred, edge, frames, gated, position, quotient, reaches, running_sum, stats
from . import features


def _typed(kind: str) -> Column:
    return F.when(F.col("label") == 1, F.lit(kind)).otherwise(F.lit(""))


def _finish(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns, "score", "label", "detection_type")


def rolling_zscore(df: DataFrame, width: int = 20, least: int | None = None, threshold: Threshold = Threshold("fixed", 4.0), chunk: int | None = None) -> DataFrame:
    """|value - mean| / deviation of the last `width` rows, the row itself included; rows without enough of them have z = 0."""
    rows = features.rolling(df, width, least, chunk=chunk).withColumn("_z", F.abs(quotient(F.col("value") - F.col("rolling_mean"), F.col("rolling_std"))))
    rows = threshold.add(rows, {"_t": ("_z", threshold.value)}, chunk is not None)
    rows = rows.withColumns({"score": capped(F.col("_z"), F.col("_t")), "label": reaches(F.col("_z"), F.col("_t")).cast("int")}).withColumn("detection_type", _typed("Spike"))
    return _finish(rows, df.columns)


def prediction_error(df: DataFrame, width: int = 10, smoothing: int = 1, threshold: Threshold = Threshold("fixed", 4.5), chunk: int | None = None) -> DataFrame:
    """Distance from a moving-average forecast; the fixed policy means mean + value deviations of the unsmoothed error."""
    joined = chunk is not None
    rows = features.forecast(df, width, chunk, joined).withColumn("_e", F.abs(F.col("value") - F.col("prediction")))
    rows = features.smooth(rows, "_e", smoothing, "_s", chunk) if smoothing > 1 else rows.withColumn("_s", F.col("_e"))
    rows = rows.withColumn("_s", F.coalesce("_s", F.lit(0.0)))
    if threshold.method == "fixed":
        rows = Threshold("adaptive_std", k=threshold.value).add(rows, {"_t": ("_e", 0.0)}, joined)
    else:
        rows = threshold.add(rows, {"_t": ("_s", 0.0)}, joined)
    rows = rows.withColumns({"score": capped(F.col("_s"), F.col("_t")), "label": reaches(F.col("_s"), F.col("_t")).cast("int")}).withColumn("detection_type", _typed("Spike"))
    return _finish(rows, df.columns)


def hybrid(df: DataFrame, width: int = 20, trend_width: int = 5, volatility_width: int = 10, weights: tuple[float, ...] = (0.5, 0.3, 0.2), threshold: Threshold = Threshold("fixed"), fixed: tuple[float, float, float] = (3.5, 1.2, 3.5), chunk: int | None = None) -> DataFrame:
    """Three weighted channels (centred z-score, change of slope, volatility) and two that fire by themselves (extreme volatility, flat line)."""
    joined = chunk is not None
    flat = 2 * width
    zb, za, z_columns = features.rolling_columns(width, None, True)
    vb, va = centred(volatility_width)
    tb, ta, slope = features.slope_columns(trend_width)

    def first(w: WindowSpec) -> dict[str, Column]:
        v, r = w.rowsBetween(-vb, va), w.rowsBetween(-(flat - 1), 0)
        n = F.count("value").over(r)
        least = max(1, volatility_width // 2)
        return z_columns(w) | slope(w) | {"_vol": gated(F.stddev_samp("value").over(v), F.count("value").over(v), least), "_range": gated(F.max("value").over(r) - F.min("value").over(r), n, flat)}

    rows = frames(df, max(zb, vb, tb, flat), max(za, va, ta), first, chunk)
    rows = rows.withColumn("_z", F.abs(quotient(F.col("value") - F.col("rolling_mean"), F.col("rolling_std"))))
    rows = stats(rows, {"_vm": F.avg("_vol"), "_vs": F.stddev_pop("_vol"), "_hi": F.max("value"), "_lo": F.min("value")}, joined)
    span = F.col("_hi") - F.col("_lo")
    span = F.when(span == 0, F.lit(1.0)).otherwise(span)
    rows = rows.withColumns({"_v": F.greatest(quotient(F.col("_vol") - F.col("_vm"), F.col("_vs")), F.lit(0.0)), "_flat": (position(df) >= flat) & (F.coalesce("_range", span) < F.greatest(span * 0.01, F.lit(1e-6)))})
    rows = features.gradient(rows, "trend", "_g", chunk).withColumn("_g", F.abs("_g"))
    rows = threshold.add(rows, {"_zt": ("_z", fixed[0]), "_gt": ("_g", fixed[1]), "_vt": ("_v", fixed[2])}, joined)
    rows = rows.withColumns({f"_{c}n": capped(F.col(f"_{c}"), F.col(f"_{c}t")) for c in "zgv"})
    w1, w2, w3 = [*list(weights)[:3], 0.0, 0.0, 0.0][:3]
    rows = rows.withColumns({"_sum": (w1 * F.col("_zn") + w2 * F.col("_gn") + w3 * F.col("_vn")) / ((w1 + w2 + w3) or 1.0), "_strong": (F.col("_vt") > 0) & (F.col("_v") >= 2.5 * F.col("_vt")), "_spiky": ((F.col("_zn") >= F.col("_gn")) & (F.col("_zn") >= F.col("_vn"))).cast("int"), "_sign": F.signum("trend")})

    def second(w: WindowSpec) -> dict[str, Column]:
        near = w.rowsBetween(-5, 5)
        return {"_vol_edge": edge("_strong", w), "_flat_edge": edge("_flat", w), "_near": F.sum("_spiky").over(near), "_steady": F.abs(F.sum("_sign").over(near)) / 11}

    rows = frames(rows, 5, 5, second, chunk)
    alone = F.col("_vol_edge") | F.col("_flat_edge")
    rows = rows.withColumns({"label": ((F.col("_sum") >= 0.80) | alone).cast("int"), "score": F.when(alone, F.greatest("_sum", F.lit(0.85))).otherwise(F.col("_sum"))})
    z, g, v = F.col("_zn"), F.col("_gn"), F.col("_vn")
    channel = F.when((z >= g) & (z >= v), "Spike").when(g >= v, F.when(F.col("_near") > 0, "Spike").when(F.col("_steady") < 0.5, "Volatility").otherwise("Trend")).otherwise("Volatility")
    kind = F.when(F.col("label") == 0, "").when(F.col("_flat_edge"), "Flatline").when(F.col("_vol_edge"), "Volatility").otherwise(channel)
    return _finish(rows.withColumn("detection_type", kind), df.columns)


def mean_shift(df: DataFrame, width: int = 50, threshold: Threshold = Threshold("adaptive_std", k=3.0), chunk: int | None = None) -> DataFrame:
    """Distance of the means of the `width` rows before and from here on, in deviations before; the highest row of each run is the shift."""
    joined = chunk is not None
    rows = stats(df, {"_n": F.count("*"), "_sd": F.stddev_pop("value")}, joined)

    def make(w: WindowSpec) -> dict[str, Column]:
        before, after = w.rowsBetween(-width, -1), w.rowsBetween(0, width - 1)
        return {"_before": F.avg("value").over(before), "_spread": F.stddev_pop("value").over(before), "_after": F.avg("value").over(after)}

    rows = frames(rows, width, width - 1, make, chunk)
    floor = F.greatest(F.col("_sd") * 0.01, F.lit(1e-4))
    at = position(df)
    inside = (at >= width) & (at < F.col("_n") - width)
    raw = F.abs(F.col("_after") - F.col("_before")) / F.greatest("_spread", floor)
    rows = rows.withColumn("_raw", F.when(inside, F.coalesce(raw, F.lit(0.0))).otherwise(F.lit(0.0)))
    rows = threshold.add(rows, {"_t": ("_raw", threshold.value)}, joined)
    rows = rows.withColumns({"score": capped(F.col("_raw"), F.col("_t")), "_above": reaches(F.col("_raw"), F.col("_t"))})
    rows = running_sum(rows.withColumn("_one", F.col("_above").cast("long")), "_one", "_reached", chunk)
    run = at - F.col("_reached")  # constant within a run
    rows = rows.withColumn("_run", F.when(F.col("_above"), run))
    best = F.row_number().over(Window.partitionBy("series_id", "_run").orderBy(F.desc("_raw"), "idx"))
    # rows outside runs are spread over windows of their own
    spread = rows.withColumn("_run", F.coalesce("_run", -1 - F.col("idx")))
    rows = spread.withColumn("label", (F.col("_above") & (best == 1)).cast("int")).withColumn("detection_type", _typed("Level Shift"))
    return _finish(rows, df.columns)


def global_zscore(df: DataFrame, limit: float = 2.5, joined: bool = True) -> DataFrame:
    """Distance from the series' mean in sample deviations; label where z > limit; a null value, or any of a constant series, has z = 0."""
    rows = stats(df, {"_m": F.avg("value"), "_s": F.stddev_samp("value")}, joined)
    rows = rows.withColumn("zscore", F.coalesce(F.when(F.col("_s") > 0, F.abs(F.col("value") - F.col("_m")) / F.col("_s")), F.lit(0.0)))
    return rows.withColumns({"score": F.least(F.col("zscore") / limit, F.lit(1.0)), "label": (F.col("zscore") > limit).cast("int")}).withColumn("detection_type", _typed("Spike")).drop("_m", "_s")


def global_zscore_filter(df: DataFrame, limit: float = 2.0, joined: bool = True) -> DataFrame:
    """Only the rows with z > limit, with mean, std and zscore."""
    rows = stats(df, {"mean": F.avg("value"), "std": F.stddev_samp("value")}, joined)
    return rows.withColumn("zscore", F.try_divide(F.abs(F.col("value") - F.col("mean")), F.col("std"))).where(F.col("zscore") > limit)


def iqr(df: DataFrame, multiplier: float = 1.5, approximate: bool = False, joined: bool = True) -> DataFrame:
    """Only the rows beyond `multiplier` interquartile ranges outside the quartiles, with q1, q3, lower, upper."""
    q = (lambda p: F.percentile_approx("value", p)) if approximate else (lambda p: Quantile("value", p))
    rows = stats(df, {"q1": q(0.25), "q3": q(0.75)}, joined)
    width = (F.col("q3") - F.col("q1")) * multiplier
    rows = rows.withColumns({"lower": F.col("q1") - width, "upper": F.col("q3") + width})
    return rows.where((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")))


def tumbling_zscore(df: DataFrame, length: str = "5 minutes", limit: float = 2.0) -> DataFrame:
    """Rows with z > limit within their tumbling time window, with window_start, mean, std, n, zscore; windows of one row have none."""
    rows = df.withColumn("window_start", F.window("timestamp", length)["start"])
    per = rows.groupBy("series_id", "window_start").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("n"))
    rows = rows.join(per, ["series_id", "window_start"])
    return rows.withColumn("zscore", F.try_divide(F.abs(F.col("value") - F.col("mean")), F.col("std"))).where(F.col("zscore") > limit)


def tumbling_iqr(df: DataFrame, length: str = "5 minutes", multiplier: float = 1.5) -> DataFrame:
    """Rows outside the quartile fences of their tumbling time window."""
    rows = df.withColumn("window_start", F.window("timestamp", length)["start"])
    per = rows.groupBy("series_id", "window_start").agg(F.percentile("value", F.lit(0.25)).alias("q1"), F.percentile("value", F.lit(0.75)).alias("q3"))
    rows = rows.join(per, ["series_id", "window_start"])
    width = (F.col("q3") - F.col("q1")) * multiplier
    return rows.where((F.col("value") < F.col("q1") - width) | (F.col("value") > F.col("q3") + width))


def plain_rolling_zscore(df: DataFrame, width: int = 20, percentile: float = 99.5, chunk: int | None = None) -> DataFrame:
    """Rolling z-score without a least count, against a percentile of itself."""
    rows = features.rolling_plain(df, width, chunk).withColumn("_z", F.abs(quotient(F.col("value") - F.col("rolling_mean"), F.col("rolling_std"))))
    rows = Threshold("percentile", percentile=percentile).add(rows, {"_t": ("_z", 0.0)}, chunk is not None)
    rows = rows.withColumns({"score": capped(F.col("_z"), F.col("_t")), "label": reaches(F.col("_z"), F.col("_t")).cast("int")}).withColumn("detection_type", _typed("Spike"))
    return _finish(rows, df.columns)


def compare_methods(df: DataFrame) -> DataFrame:
    """How many rows the global z-score, the quartile and the tumbling z-score filters keep: method, anomalies."""
    parts = {"zscore": global_zscore_filter(df, 2.0), "iqr": iqr(df, 1.5), "window": tumbling_zscore(df, "5 minutes", 2.0)}
    out = None
    for name, found in parts.items():
        one = found.agg(F.count("*").alias("anomalies")).select(F.lit(name).alias("method"), "anomalies")
        out = one if out is None else out.unionByName(one)
    return out

"""Window features of a series view: rolling statistics, forecasts, trend, windows, down-sampling and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.core import centred, frames, gated, position, stats


def rolling_columns(width: int, least: int | None, centre: bool, column: str = "value") -> tuple[int, int, dict]:
    back, ahead = centred(width) if centre else (width - 1, 0)
    least = max(1, width // 2) if least is None else least

    def make(w: WindowSpec) -> dict[str, Column]:
        f = w.rowsBetween(-back, ahead)
        n = F.count(column).over(f)
        return {"rolling_mean": gated(F.avg(column).over(f), n, least), "rolling_std": gated(F.stddev_samp(column).over(f), n, least)}

    return back, ahead, make


def rolling(df: DataFrame, width: int = 20, least: int | None = None, centre: bool = False, chunk: int | None = None) -> DataFrame:
    """rolling_mean and rolling_std (sample) of the last `width` rows, or of a centred frame; null below `least` values (half the width)."""
    return frames(df, *rolling_columns(width, least, centre), chunk)


def rolling_plain(df: DataFrame, width: int = 20, chunk: int | None = None) -> DataFrame:
    """The last `width` rows without a least count; a deviation that is not defined is 0."""
    f = lambda w: w.rowsBetween(-(width - 1), 0)
    return frames(df, width - 1, 0, lambda w: {"rolling_mean": F.avg("value").over(f(w)), "rolling_std": F.coalesce(F.stddev_samp("value").over(f(w)), F.lit(0.0))}, chunk)


def sliding_features(df: DataFrame, width: int = 10, chunk: int | None = None) -> DataFrame:
    """row_num, window_mean_<width>, window_std_<width> of the last rows."""
    f = lambda w: w.rowsBetween(-(width - 1), 0)
    df = df.withColumn("row_num", position(df) + 1)
    return frames(df, width - 1, 0, lambda w: {f"window_mean_{width}": F.avg("value").over(f(w)), f"window_std_{width}": F.stddev_samp("value").over(f(w))}, chunk)


def rolling_range(df: DataFrame, width: int, chunk: int | None = None) -> DataFrame:
    """rolling_max, rolling_min, rolling_range of full windows."""

    def make(w: WindowSpec) -> dict[str, Column]:
        f = w.rowsBetween(-(width - 1), 0)
        n, hi, lo = F.count("value").over(f), F.max("value").over(f), F.min("value").over(f)
        return {"rolling_max": gated(hi, n, width), "rolling_min": gated(lo, n, width), "rolling_range": gated(hi - lo, n, width)}

    return frames(df, width - 1, 0, make, chunk)


def forecast(df: DataFrame, width: int = 10, chunk: int | None = None, joined: bool = False) -> DataFrame:
    """prediction: the mean of the `width` rows before; the first `width` rows get their own mean."""
    head = position(df) < width
    df = stats(df, {"_head": F.avg(F.when(head, F.col("value")))}, joined)
    df = frames(df, width, 0, lambda w: {"_before": F.avg("value").over(w.rowsBetween(-width, -1))}, chunk)
    return df.withColumn("prediction", F.when(head, F.col("_head")).otherwise(F.col("_before"))).drop("_head", "_before")


def smooth(df: DataFrame, column: str, width: int = 1, out: str | None = None, chunk: int | None = None) -> DataFrame:
    """A centred rolling mean of whatever rows there are."""
    back, ahead = centred(width)
    return frames(df, back, ahead, lambda w: {out or column: F.avg(column).over(w.rowsBetween(-back, ahead))}, chunk)


def slope_columns(width: int):
    """Least-squares slope over `width` centred rows, 0 at the ends, and 0 everywhere for an even width."""
    half = width // 2

    def make(w: WindowSpec) -> dict[str, Column]:
        if width % 2 == 0 or width < 2:
            return {"trend": F.lit(0.0)}
        total = sum(k * k for k in range(-half, half + 1))
        up = F.lit(0.0)
        for k in range(1, half + 1):
            up = up + k * (F.lead("value", k).over(w) - F.lag("value", k).over(w))
        full = F.lead("value", half).over(w).isNotNull() & F.lag("value", half).over(w).isNotNull()
        return {"trend": F.when(full, F.coalesce(up / total, F.lit(0.0))).otherwise(F.lit(0.0))}

    return half, half, make


def trend(df: DataFrame, width: int = 5, chunk: int | None = None) -> DataFrame:
    return frames(df, *slope_columns(width), chunk)


def gradient(df: DataFrame, column: str = "trend", out: str = "gradient", chunk: int | None = None) -> DataFrame:
    """Central differences; one-sided at both ends; 0 for a single row."""

    def make(w: WindowSpec) -> dict[str, Column]:
        here, after, before = F.col(column), F.lead(column).over(w), F.lag(column).over(w)
        return {out: F.coalesce((after - before) / 2, after - here, here - before, F.lit(0.0))}

    return frames(df, 1, 1, make, chunk)


def abs_diff(df: DataFrame, out: str = "abs_diff", chunk: int | None = None) -> DataFrame:
    return frames(df, 1, 0, lambda w: {out: F.coalesce(F.abs(F.col("value") - F.lag("value").over(w)), F.lit(0.0))}, chunk)


def box_count(df: DataFrame, flag: Column, half: int = 5, out: str = "box_count", chunk: int | None = None) -> DataFrame:
    """How many rows within `half` rows on either side have the flag."""
    df = df.withColumn("_flag", F.coalesce(flag.cast("int"), F.lit(0)))
    return frames(df, half, half, lambda w: {out: F.sum("_flag").over(w.rowsBetween(-half, half))}, chunk).drop("_flag")


def window_matrix(df: DataFrame, width: int, step: int = 1, chunk: int | None = None) -> DataFrame:
    """series_id, start, centre, window: every `step`-th full window of `width` values."""
    df = frames(df, 0, width - 1, lambda w: {"window": F.collect_list("value").over(w.rowsBetween(0, width - 1))}, chunk)
    at = position(df)
    return df.where((at % step == 0) & (F.size("window") == width)).select("series_id", at.alias("start"), (at + width // 2).alias("centre"), "window")


def downsample(df: DataFrame, most: int) -> DataFrame:
    """At most about `most` rows of a longer series: the first smallest and the first largest row of each of most // 2 equal runs."""
    buckets = max(1, most // 2)
    sized = stats(df, {"_n": F.count("*")})
    step, at = F.col("_n") / F.lit(float(buckets)), position(df)
    # run k spans rows [int(k * step), int((k + 1) * step)); rounding is put right by one step either way
    guess = F.floor(at / step).cast("long")
    low = lambda k: F.floor(k * step).cast("long")
    bucket = F.when(low(guess) > at, guess - 1).when(low(guess + 1) <= at, guess + 1).otherwise(guess)
    runs = sized.withColumn("_bucket", F.least(bucket, F.lit(buckets - 1)))
    by = Window.partitionBy("series_id", "_bucket")
    ranked = runs.withColumns({"_lo": F.row_number().over(by.orderBy(F.asc_nulls_last("value"), "idx")), "_hi": F.row_number().over(by.orderBy(F.desc_nulls_last("value"), "idx"))})
    return ranked.where((F.col("_n") <= most) | (F.col("_lo") == 1) | (F.col("_hi") == 1)).select(*df.columns)


def histogram(df: DataFrame, bins: int = 30) -> DataFrame:
    """series_id, bin (from 1), n: counts in equal bins between a series' extremes, the largest value in the last bin."""
    df = stats(df, {"_min": F.min("value"), "_max": F.max("value")}).where("value is not null")
    at = F.when(F.col("_max") > F.col("_min"), F.least(F.floor((F.col("value") - F.col("_min")) / (F.col("_max") - F.col("_min")) * bins) + 1, F.lit(bins))).otherwise(F.lit(1))
    return df.groupBy("series_id", at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def keep_first(parts: list[DataFrame]) -> DataFrame:
    """Union of parts of one series view, a row for each series and timestamp, of the first part that has it."""
    out = None
    for k, df in enumerate(parts):
        df = df.withColumn("_part", F.lit(k))
        out = df if out is None else out.unionByName(df)
    by = Window.partitionBy("series_id", "timestamp").orderBy("_part", "idx")
    return out.withColumn("_rank", F.row_number().over(by)).where("_rank = 1").drop("_part", "_rank")



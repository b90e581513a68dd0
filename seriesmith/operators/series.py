"""The series view, its validation, gap filling, scaling and statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.core import Quantile, dense, nearest, quotient, stats


def number(c: Column) -> Column:
    """As double; what is not a number is missing, as null is."""
    c = c.cast("double")
    return F.when(~F.isnan(c), c)


def to_series(df: DataFrame, series: Column | str, timestamp: str, value: Column | str, tie: str | None = None, unit: str | None = None) -> DataFrame:
    """series_id, idx (from 0, by timestamp and tie-breaker), timestamp, value as double, null where it is not a number. No global sort.

    unit (hour, day, month ...): rows are numbered within such slices of time and
    moved on by the counts of the slices before, so that no task sorts a whole
    series; idx is the same.
    """
    one = lambda c: F.col(c) if isinstance(c, str) else c
    rows = df.select(one(series).cast("string").alias("series_id"), F.col(timestamp).alias("timestamp"), number(one(value)).alias("value"), (F.col(tie) if tie else F.lit(0)).alias("_tie"))
    order = ("timestamp", "_tie", "value")
    if unit is None:
        by = Window.partitionBy("series_id").orderBy(*order)
        return rows.select("series_id", (F.row_number().over(by) - 1).cast("long").alias("idx"), "timestamp", "value")
    first = F.lit("0001-01-01").cast("timestamp")  # rows without a time come first
    rows = rows.withColumn("_slice", F.coalesce(F.date_trunc(unit, F.col("timestamp").cast("timestamp")), first))
    before = Window.partitionBy("series_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("series_id", "_slice").agg(F.count("*").alias("_n"))
    offsets = counts.select("series_id", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("series_id", "_slice").orderBy(*order)
    numbered = rows.withColumn("_at", F.row_number().over(within) - 1).join(offsets, ["series_id", "_slice"])
    return numbered.select("series_id", (F.col("_offset") + F.col("_at")).cast("long").alias("idx"), "timestamp", "value")


def validate(df: DataFrame) -> DataFrame:
    """Raises ValueError without a timestamp, a numeric value or any row; gives df back."""
    missing = {"timestamp", "value"} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    if df.schema["value"].dataType.typeName() not in ("byte", "short", "integer", "long", "float", "double", "decimal"):
        raise ValueError("value must be numeric")
    if df.isEmpty():
        raise ValueError("no rows")
    return df


def parse_timestamps(df: DataFrame, column: str = "timestamp", fmt: str | None = None, lenient: bool = False) -> DataFrame:
    """Text to timestamps without time zone; lenient: null where it cannot be read."""
    args = [F.col(column)] + ([F.lit(fmt)] if fmt else [])
    parsed = F.try_to_timestamp(*args).cast("timestamp_ntz") if lenient else F.to_timestamp_ntz(*args)
    return df.withColumn(column, parsed)


def format_timestamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def memory_usage(df: DataFrame) -> DataFrame:
    """(bytes, memory): eight bytes a number or time, the bytes of texts, as megabytes of two places."""
    width = lambda f: F.coalesce(F.octet_length(f.name), F.lit(0)) if f.dataType.typeName() == "string" else F.lit(8)
    total = sum((width(f) for f in df.schema), F.lit(0).cast("long"))
    return df.agg(F.coalesce(F.sum(total), F.lit(0)).alias("bytes")).withColumn("memory", F.format_string("%.2f MB", F.col("bytes") / 1024**2))


def concat_series(parts: dict[str, DataFrame]) -> DataFrame:
    """Several single series as one table, tagged with their names."""
    out = None
    for name, df in parts.items():
        df = df.withColumn("series_id", F.lit(name))
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("no series")
    return out


FILLS = ("interpolate", "forward_fill", "mean", "drop")


def fill(df: DataFrame, method: str = "interpolate", chunk: int | None = None) -> DataFrame:
    """Fills nulls in value by series; drop leaves idx as it was and adds pos, the place among the rows that are left, which detectors go by.

    interpolate: linear by position, ends take the nearest value. forward_fill:
    the last value before, at the start the first one after. With chunk a series
    is the work of many tasks, a run of so many rows each.
    """
    v, i = F.col("value"), F.col("idx")
    if method == "drop":
        return dense(df.dropna(subset=["value"]), chunk)
    if method == "mean":
        return stats(df, {"_mean": F.avg("value")}, chunk is not None).withColumn("value", F.coalesce(v, "_mean")).drop("_mean")
    if method not in FILLS:
        raise ValueError(f"unknown fill method {method!r}; one of {FILLS}")
    df = nearest(df, v, chunk)
    before, after = F.col("_before"), F.col("_after")
    if method == "forward_fill":
        return df.withColumn("value", F.coalesce(before["v"], after["v"])).drop("_before", "_after")
    between = before["v"] + (after["v"] - before["v"]) * F.try_divide((i - before["i"]).cast("double"), (after["i"] - before["i"]).cast("double"))
    return df.withColumn("value", F.coalesce(v, between, after["v"], before["v"])).drop("_before", "_after")


def scale(df: DataFrame, method: str = "standard", keep: bool = False, joined: bool = False) -> DataFrame:
    """Adds value_normalized by series: standard (population deviation) or minmax; a constant series becomes 0. keep: leaves the parameters."""
    if method == "standard":
        df = stats(df, {"_centre": F.avg("value"), "_spread": F.stddev_pop("value")}, joined)
    elif method == "minmax":
        df = stats(df, {"_centre": F.min("value"), "_top": F.max("value")}, joined).withColumn("_spread", F.col("_top") - F.col("_centre")).drop("_top")
    else:
        raise ValueError(f"unknown scale method {method!r}")
    df = df.withColumn("value_normalized", F.when(F.col("value").isNotNull(), quotient(F.col("value") - F.col("_centre"), F.col("_spread"))))
    return df if keep else df.drop("_centre", "_spread")


def denormalize(df: DataFrame, column: str = "value_normalized") -> DataFrame:
    """The inverse of scale(keep=True): adds value_denormalized and drops the parameters."""
    return df.withColumn("value_denormalized", F.col(column) * F.col("_spread") + F.col("_centre")).drop("_centre", "_spread")


def robust_scale(df: DataFrame, method: str = "standard", low: float = 0.01, high: float = 0.99, joined: bool = False) -> DataFrame:
    """Clips value to two percentiles of its series, then scales it; value itself becomes the clipped one."""
    df = stats(df, {"_low": Quantile("value", low), "_high": Quantile("value", high)}, joined)
    clipped = F.when(F.col("value").isNotNull(), F.least(F.greatest("value", "_low"), F.col("_high")))
    return scale(df.withColumn("value", clipped).drop("_low", "_high"), method, joined=joined)


def series_stats(df: DataFrame) -> DataFrame:
    """One row a series: count, mean, population deviation, extremes, quartiles, and bias-corrected skewness and excess kurtosis."""
    out = df.groupBy("series_id").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.percentile("value", F.lit(0.5)).alias("median"), F.percentile("value", F.lit(0.25)).alias("q25"), F.percentile("value", F.lit(0.75)).alias("q75"),
        F.skewness("value").alias("_g1"), F.kurtosis("value").alias("_g2"),
    )
    n = F.col("count").cast("double")
    skew = F.try_divide(F.col("_g1") * F.sqrt(n * (n - 1)), n - 2)
    kurt = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6)
    return out.withColumns({"skewness": F.when(n > 2, skew), "kurtosis": F.when(n > 3, kurt)}).drop("_g1", "_g2")


def labelled_stats(df: DataFrame) -> DataFrame:
    """One row a series: rows, mean, sample deviation, extremes, first and last timestamp."""
    return df.groupBy("series_id").agg(F.count("*").alias("rows"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))


def preprocess(df: DataFrame, fill_method: str = "interpolate", scale_method: str | None = None) -> DataFrame:
    """fill, then scale if asked for, on a series view."""
    df = fill(df, fill_method)
    return scale(df, scale_method) if scale_method else df


def tile(df: DataFrame, times: int) -> DataFrame:
    """Every series repeated end to end, with idx running on and the timestamps as they were."""
    sized = df.join(df.groupBy("series_id").agg(F.count("*").alias("_n")), "series_id")
    return sized.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("idx", F.col("idx") + F.col("_k") * F.col("_n")).drop("_k", "_n")


def synthetic(spark: SparkSession, n: int, mean: float = 50.0, std: float = 10.0, seed: int = 42, series_id: str = "synthetic") -> DataFrame:
    """A normal series of n points, one a second; the same rows for the same seed, in whatever partitions.

    Two uniform numbers of 32 bits from a hash of seed and place give each value.
    """
    at = F.timestamp_seconds(F.lit(1_600_000_000) + F.col("id")).cast("timestamp_ntz")
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")).cast("binary"))
    uniform = lambda k: (F.conv(F.substring(digest, k, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    normal = F.sqrt(-2.0 * F.log(uniform(1))) * F.cos(2.0 * math.pi * uniform(9))
    return spark.range(n).select(F.lit(series_id).alias("series_id"), F.col("id").alias("idx"), at.alias("timestamp"), (F.lit(mean) + F.lit(std) * normal).alias("value"))

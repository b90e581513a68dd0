"""Windows, guarded arithmetic and threshold policies that all operators share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def ordered() -> WindowSpec:
    """The one ordered window of a series: all operators use it, so that they share one exchange and one sort."""
    return Window.partitionBy("series_id").orderBy("idx")


def whole() -> WindowSpec:
    return Window.partitionBy("series_id")


def position(df: DataFrame) -> Column:
    """A row's place in its series: pos, which a table has whose idx has gaps, else idx."""
    return F.col("pos" if "pos" in df.columns else "idx")


def dense(df: DataFrame, chunk: int | None = None) -> DataFrame:
    """Adds pos, the place from 0 on among a series' rows that are left, beside idx.

    With chunk, rows are numbered within runs of so many idx and moved on by the
    counts of the runs before, so that no task reads a whole series.
    """
    if chunk is None:
        return df.withColumn("pos", (F.row_number().over(ordered()) - 1).cast("long"))
    df = df.withColumn("_run", F.floor(F.col("idx") / chunk))
    before = Window.partitionBy("series_id").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy("series_id", "_run").agg(F.count("*").alias("_n")).select("series_id", "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("series_id", "_run").orderBy("idx")) - 1
    columns = [c for c in df.columns if c != "_run"]
    return df.withColumn("_at", within).join(offsets, ["series_id", "_run"]).select(*columns, (F.col("_at") + F.col("_offset")).cast("long").alias("pos"))


def running_sum(df: DataFrame, column: str, out: str, chunk: int | None = None) -> DataFrame:
    """Adds the sum of a column from the start of the series to the row; with chunk by runs of rows, moved on by the sums of the runs before."""
    if chunk is None:
        return df.withColumn(out, F.sum(column).over(ordered()))
    df = df.withColumn("_run", F.floor(position(df) / chunk))
    before = Window.partitionBy("series_id").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy("series_id", "_run").agg(F.sum(column).alias("_s")).select("series_id", "_run", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_offset"))
    within = F.sum(column).over(Window.partitionBy("series_id", "_run").orderBy("idx"))
    columns = [c for c in df.columns if c != "_run"]
    return df.withColumn("_sum", within).join(sums, ["series_id", "_run"]).select(*columns, (F.col("_sum") + F.col("_offset")).alias(out))


def nearest(df: DataFrame, given: Column, chunk: int | None = None) -> DataFrame:
    """Adds _before and _after: idx and value, as a struct (i, v), of the last row up to this one, and the first from this one on, where given is not null.

    With chunk by runs of rows, of which only the outermost such rows travel.
    """
    by = ["series_id"] if chunk is None else ["series_id", "_run"]
    if chunk is not None:
        df = df.withColumn("_run", F.floor(position(df) / chunk))
    df = df.withColumn("_given", F.when(given.isNotNull(), F.struct(F.col("idx").alias("i"), given.alias("v"))))
    # what follows is what came before in the opposite order: a frame that only grows is read once
    last = lambda order: F.last("_given", True).over(Window.partitionBy(*by).orderBy(order("idx")).rowsBetween(Window.unboundedPreceding, 0))
    out = df.withColumns({"_before": last(F.asc), "_after": last(F.desc)})
    if chunk is None:
        return out.drop("_given")
    ends = df.groupBy(*by).agg(F.min("_given").alias("_first"), F.max("_given").alias("_last"))
    others = lambda order: Window.partitionBy("series_id").orderBy(order("_run")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*by, F.max("_last").over(others(F.asc)).alias("_earlier"), F.min("_first").over(others(F.desc)).alias("_later"))
    columns = [c for c in df.columns if c not in ("_run", "_given")]
    return out.join(ends, by).select(*columns, F.coalesce("_before", "_earlier").alias("_before"), F.coalesce("_after", "_later").alias("_after"))


def quotient(a: Column, b: Column) -> Column:
    """a / b, and 0 where that is null, not a number or infinite."""
    q = F.try_divide(a.cast("double"), b.cast("double"))
    return F.when(q.isNull() | F.isnan(q) | (F.abs(q) == F.lit(float("inf"))), F.lit(0.0)).otherwise(q)


def gated(value: Column, count: Column, least: int) -> Column:
    """value where the frame has as many rows as it needs, else null."""
    return F.when(count >= least, value)


def centred(width: int) -> tuple[int, int]:
    """Rows before and after of a centred frame; an even width looks back one row more."""
    after = (width - 1) // 2
    return width - 1 - after, after


def frames(df: DataFrame, back: int, ahead: int, columns: Callable[[WindowSpec], dict[str, Column]], chunk: int | None = None) -> DataFrame:
    """Adds columns computed over the ordered window, whose frames reach `back` rows back and `ahead` rows ahead at most.

    With chunk, a series is dealt out in runs of so many rows, each with the rows
    that its frames reach into, so that one long series is the work of many tasks.
    """
    if chunk is None:
        return df.withColumns(columns(ordered()))
    at = position(df)
    first = F.greatest(F.lit(0), F.floor((at - ahead) / chunk))
    halo = df.withColumn("_chunk", F.explode(F.sequence(first.cast("long"), F.floor((at + back) / chunk).cast("long"))))
    by = Window.partitionBy("series_id", "_chunk").orderBy("idx")
    return halo.withColumns(columns(by)).where(F.col("_chunk") == F.floor(at / chunk)).drop("_chunk")


@dataclass(frozen=True)
class Quantile:
    """The p-quantile of a column's values in a series, by linear interpolation between two ranks."""

    column: str
    p: float


#: Accuracy of the sketch that says between which values a quantile lies: its rank is wrong by one in so many rows at most.
SKETCH = 10_000


def _quantiles(df: DataFrame, column: str, wanted: dict[str, float]) -> DataFrame:
    """(series_id, names) of exact quantiles of a column, without any task that holds a series.

    A sketch gives two values around each, a bracket; only the different values
    in brackets, with how often they occur, are then put in order, and of those
    between two brackets the first and the last.
    """
    values = df.select("series_id", F.col(column).alias("_v")).where("_v is not null")
    play, n = 4 / SKETCH, len(wanted)
    ends = F.array(*(F.lit(e) for p in wanted.values() for e in (max(0.0, p - play), min(1.0, p + play))))
    marks = values.groupBy("series_id").agg(F.percentile_approx("_v", ends, SKETCH).alias("_ends"), F.count("*").alias("_n"))
    marks = marks.select("series_id", "_n", *(F.get("_ends", F.lit(k)).alias(f"_e{k}") for k in range(2 * n)))
    v, inside, under = F.col("_v"), F.lit(False), []
    for k in range(n):
        inside = inside | v.between(F.col(f"_e{2 * k}"), F.col(f"_e{2 * k + 1}"))
    for k in range(2 * n):
        under.append(F.when(F.col(f"_e{k}") <= v, F.col(f"_e{k}")))
    near = values.join(marks, "series_id").withColumns({"_in": inside, "_at": F.when(inside, v).otherwise(F.greatest(*under))})
    times = near.groupBy("series_id", "_in", "_at").agg(F.count("*").alias("_c"), F.min("_v").alias("_first"), F.max("_v").alias("_last"), F.first("_n").alias("_n"))
    # of what lies between two brackets only the first and the last value can be asked for
    pair = lambda x, c: F.struct(x.alias("_v"), c.alias("_times"))
    c = F.col("_c")
    times = times.select("series_id", "_n", F.inline(F.when(F.col("_in"), F.array(pair(F.col("_first"), c))).otherwise(F.array(pair(F.col("_first"), c - 1), pair(F.col("_last"), F.lit(1).cast("long"))))))
    upto = F.sum("_times").over(Window.partitionBy("series_id").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    at = {name: (F.col("_n") - 1) * F.lit(p) for name, p in wanted.items()}
    rank = lambda k: F.min(F.when(F.col("_upto") > k, F.col("_v")))
    found = times.withColumn("_upto", upto).groupBy("series_id").agg(F.first("_n").alias("_n"), *(rank(f(x)).alias(f"{name}{c}") for name, x in at.items() for f, c in ((F.floor, "_a"), (F.ceil, "_b"))))

    def between(name: str) -> Column:
        x, a, b = at[name], F.col(f"{name}_a"), F.col(f"{name}_b")
        return F.when(a == b, a).otherwise((F.ceil(x) - x) * a + (x - F.floor(x)) * b).alias(name)

    return found.select("series_id", *map(between, wanted))


def stats(df: DataFrame, aggregates: dict[str, Column | Quantile], joined: bool = False) -> DataFrame:
    """Adds aggregates of the whole series to each row.

    By a window over the series, which shares its exchange; joined: by a partial
    aggregation and a join, so that a series may have more rows than one task should read.
    """
    if not joined:
        over = {k: F.percentile(c.column, F.lit(c.p)) if isinstance(c, Quantile) else c for k, c in aggregates.items()}
        return df.withColumns({k: c.over(whole()) for k, c in over.items()})
    plain = [c.alias(k) for k, c in aggregates.items() if not isinstance(c, Quantile)]
    per = df.groupBy("series_id").agg(*(plain or [F.count("*").alias("_rows")]))
    wanted: dict[str, dict[str, float]] = {}
    for name, c in aggregates.items():
        if isinstance(c, Quantile):
            wanted.setdefault(c.column, {})[name] = c.p
    for column, quantiles in wanted.items():
        per = per.join(_quantiles(df, column, quantiles), "series_id", "left")
    return df.join(per if plain else per.drop("_rows"), "series_id")


@dataclass(frozen=True)
class Threshold:
    """fixed: a constant; percentile: of the signal, by linear interpolation; adaptive_std: mean plus k population deviations."""

    method: str = "fixed"
    value: float = 0.0
    percentile: float = 95.0
    k: float = 2.0

    def add(self, df: DataFrame, signals: dict[str, tuple[str, float]], joined: bool = False) -> DataFrame:
        """signals: name of the threshold column -> (signal, fixed value)."""
        if self.method not in ("fixed", "percentile", "adaptive_std"):
            raise ValueError(f"unknown threshold method {self.method!r}")
        if self.method == "fixed":
            return df.withColumns({name: F.lit(float(value)) for name, (_, value) in signals.items()})
        if self.method == "adaptive_std":  # a sum of two window functions is not one
            parts = {}
            for name, (signal, _) in signals.items():
                parts |= {f"{name}_mean": F.avg(signal), f"{name}_std": F.stddev_pop(signal)}
            df = stats(df, parts, joined)
            return df.withColumns({n: F.col(f"{n}_mean") + F.lit(float(self.k or 2.0)) * F.col(f"{n}_std") for n in signals}).drop(*parts)
        return stats(df, {name: Quantile(signal, (self.percentile or 95.0) / 100) for name, (signal, _) in signals.items()}, joined)


def capped(signal: Column, threshold: Column) -> Column:
    """min(signal / threshold, 1), and 0 for a null signal or a threshold that is null or not positive."""
    return F.when(threshold > 0, F.least(F.try_divide(F.coalesce(signal, F.lit(0.0)), threshold), F.lit(1.0))).otherwise(F.lit(0.0))


def reaches(signal: Column, threshold: Column) -> Column:
    """Whether a signal reaches a positive threshold; false if either is null."""
    return F.coalesce((threshold > 0) & (signal >= threshold), F.lit(False))


def edge(flag: str, w: WindowSpec) -> Column:
    """Where a boolean column becomes true."""
    return F.col(flag) & ~F.coalesce(F.lag(flag).over(w), F.lit(False))

"""Evaluation against labelled points and intervals.

Rows and intervals are merged: both stand in one order, of time or idx, and a
window that grows along it carries what a row must know of the intervals, or an
interval of the rows. There is no range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import frames, nearest, quotient

#: Published scores that are compared with (fixed values).
BASELINES = {"HTM": 70.5, "Random Cut Forest": 51.7, "Skyline": 35.7, "Random": 11.0}
#: Cost profiles: weights of a hit, a miss and a false alarm (fixed values).
PROFILES = {"standard": (1.0, 1.0, 0.11), "reward_low_FP": (1.0, 1.0, 0.22), "reward_low_FN": (1.0, 2.0, 0.11)}
PROBATION = 0.15
#: Slices of the scores over which a sweep is dealt out.
SLICES = 4096


def intervals_to_index(df: DataFrame, intervals: DataFrame) -> DataFrame:
    """(series_id, interval_id, start_idx, end_idx) of intervals (series_id, interval_id, start_ts, end_ts).

    start_idx is the first row from start_ts on, end_idx one beyond the last row
    up to end_ts; an interval for which either is missing is left out. Both
    bounds are looked up by merging rows and bounds on time, in one exchange and
    without a range join.
    """
    none = F.lit(None).cast("long")
    points = df.select("series_id", F.col("timestamp").alias("ts"), "idx", none.alias("interval_id"), F.lit(1).alias("_r"))
    # in time order a start stands before the rows of its time, an end behind them
    bound = lambda c, rank: F.struct(F.col(c).alias("ts"), F.lit(rank).alias("_r"))
    bounds = intervals.select("series_id", F.col("interval_id").cast("long").alias("interval_id"), F.inline(F.array(bound("start_ts", 0), bound("end_ts", 2))))
    both = points.unionByName(bounds.withColumn("idx", none))
    seen = lambda order: F.last("idx", True).over(Window.partitionBy("series_id").orderBy(*map(order, ("ts", "_r", "idx"))).rowsBetween(Window.unboundedPreceding, 0))
    marks = both.withColumns({"_before": seen(F.asc), "_after": seen(F.desc)}).where("interval_id is not null")
    found = marks.groupBy("series_id", "interval_id").agg(F.max(F.when(F.col("_r") == 0, F.col("_after"))).alias("start_idx"), F.max(F.when(F.col("_r") == 2, F.col("_before"))).alias("end_idx"))
    return found.where("start_idx is not null and end_idx is not null").select("series_id", "interval_id", "start_idx", (F.col("end_idx") + 1).alias("end_idx"))


def point_mask(df: DataFrame, intervals: DataFrame) -> DataFrame:
    """Adds truth: 1 where the timestamp lies in an interval (start_ts, end_ts), both ends included; 0 for a null timestamp.

    Rows and intervals are merged on time: a row is covered if, of the intervals
    that began up to its time, one ends at it or later.
    """
    null = lambda c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    marks = intervals.where("start_ts <= end_ts").select(*(F.col("series_id") if c == "series_id" else F.col("start_ts").alias(c) if c == "timestamp" else null(c) for c in df.columns), F.col("end_ts").alias("_end"), F.lit(0).alias("_row"))
    both = df.withColumns({"_end": F.lit(None).cast(marks.schema["_end"].dataType), "_row": F.lit(1)}).unionByName(marks)
    reach = F.max("_end").over(Window.partitionBy("series_id").orderBy("timestamp", "_row").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("truth", F.coalesce((reach >= F.col("timestamp")).cast("int"), F.lit(0))).where("_row = 1").drop("_end", "_row")


def confusion(df: DataFrame, keys: tuple[str, ...] = ("series_id",), truth: str = "truth", label: str = "label") -> DataFrame:
    t, p = F.col(truth) == 1, F.col(label) == 1
    return df.groupBy(*keys).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))


def with_metrics(counts: DataFrame) -> DataFrame:
    """precision, recall, f1, fpr from tp, fp, fn, tn; 0 where a denominator is 0."""
    p, r = quotient(F.col("tp"), F.col("tp") + F.col("fp")), quotient(F.col("tp"), F.col("tp") + F.col("fn"))
    out = counts.withColumns({"precision": p, "recall": r, "fpr": quotient(F.col("fp"), F.col("fp") + F.col("tn"))})
    return out.withColumn("f1", quotient(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def point_metrics(df: DataFrame, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    return with_metrics(confusion(df, keys))


def fuzzy(df: DataFrame, spans: DataFrame, tolerance: int = 100, algorithms: tuple[str, ...] | None = None) -> DataFrame:
    """By series, and by algorithm where the algorithms of a long form are named: interval hits and misses, point false alarms, with `tolerance` rows of play at both ends.

    spans: series_id, start_idx, end_idx (one beyond the last row); spans that
    repeat count as often as they stand there. An interval is hit by a label
    from start - tolerance to end + tolerance, both included and cut to the
    series; labels outside all such zones are false alarms. Rows without a label
    are counted before anything travels; labels and zones are merged by idx.
    """
    by = ["series_id", *(["algorithm"] if algorithms else [])]
    at, label = F.col("_at"), F.col("_zone").isNull()
    points = df.groupBy(*by, F.when(F.col("label") == 1, F.col("idx")).alias("_at")).agg(F.count("*").alias("_n"))
    zones = spans.select("series_id", F.greatest(F.lit(0), F.col("start_idx") - tolerance).cast("long").alias("_at"), F.lit(0).cast("long").alias("_n"), (F.col("end_idx") + tolerance).alias("_zone"), (F.col("end_idx") - F.col("start_idx")).alias("_rows"))
    if algorithms:
        zones = zones.withColumn("algorithm", F.explode(F.array(*map(F.lit, algorithms))))
    none = F.lit(None).cast("long")
    both = points.withColumns({"_zone": none, "_rows": none}).unionByName(zones)
    # a zone stands before the labels of its first row; what follows is what came before in the opposite order
    grows = lambda order: Window.partitionBy(*by).orderBy(order("_at"), order(label)).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"_reach": F.max("_zone").over(grows(F.asc)), "_next": F.last(F.when(label, at), True).over(grows(F.desc))})
    found = F.sum(F.when(label & at.isNotNull(), F.col("_n")).otherwise(0))
    inside = F.sum(F.when(label & (F.col("_reach") >= at), F.col("_n")).otherwise(0))
    tp, count = F.count_if(~label & (F.col("_next") <= F.col("_zone"))), F.count_if(~label)
    per = both.groupBy(*by).agg(F.sum("_n").alias("n"), tp.alias("tp"), (found - inside).alias("fp"), (count - tp).alias("fn"), F.coalesce(F.sum("_rows"), F.lit(0)).alias("_covered")).where("n > 0")
    out = with_metrics(per.withColumn("tn", F.col("n") - F.col("_covered") - F.col("fp")).select(*by, "tp", "fp", "fn", "tn"))
    return out.withColumn("score", F.greatest(F.lit(0.0), 100 - (0.11 * F.col("fp") + F.col("fn"))))


def detection_delay(df: DataFrame, sample_rate: float = 300.0, chunk: int | None = None) -> DataFrame:
    """By series the mean distance in rows from the start of a true run to the first label from there on; runs never detected do not count; and in seconds."""
    rows = frames(df, 1, 0, lambda w: {"_last": F.lag("truth").over(w)}, chunk)
    rows = rows.withColumn("_begins", (F.col("truth") == 1) & (F.coalesce("_last", F.lit(0)) == 0))
    delays = nearest(rows, F.when(F.col("label") == 1, F.col("label")), chunk).withColumn("_delay", F.col("_after")["i"] - F.col("idx"))
    out = delays.groupBy("series_id").agg(F.coalesce(F.avg(F.when(F.col("_begins"), F.col("_delay"))), F.lit(0.0)).alias("delay_samples"))
    return out.withColumn("delay_seconds", F.col("delay_samples") / sample_rate)


def simple_score(df: DataFrame, probation: float = PROBATION, least: int = 750) -> DataFrame:
    """By series 100 - (0.11 false alarms + misses), not below 0, without the first max(probation of the rows, least) rows; series that short score 100."""
    sizes = df.groupBy("series_id").agg(F.count("*").alias("_n"))
    rows = df.join(sizes, "series_id").withColumn("_used", F.col("idx") >= F.greatest(F.floor(F.col("_n") * probation), F.lit(least)))
    t, p = F.col("truth") == 1, F.col("label") == 1
    counts = rows.groupBy("series_id").agg(F.count_if(F.col("_used") & ~t & p).alias("fp"), F.count_if(F.col("_used") & t & ~p).alias("fn"))
    return counts.withColumn("score", F.greatest(F.lit(0.0), 100 - (0.11 * F.col("fp") + F.col("fn"))))


def baseline_rank(scores: DataFrame) -> DataFrame:
    """Adds the distances to three published scores and the rank among all four."""
    rank = F.lit(1)
    for v in BASELINES.values():
        rank = rank + (F.col("score") < v).cast("int")
    return scores.withColumns({"vs_htm": F.col("score") - BASELINES["HTM"], "vs_rcf": F.col("score") - BASELINES["Random Cut Forest"], "vs_skyline": F.col("score") - BASELINES["Skyline"], "rank": rank.cast("int")})


def scalability(times: DataFrame) -> DataFrame:
    """speedup and efficiency of (cores, seconds) against one core; nothing without its time."""
    one = times.where("cores = 1").agg(F.min("seconds")).scalar()
    rows = times.where("seconds > 0").withColumn("speedup", one / F.col("seconds")).where("speedup is not null")
    return rows.select("cores", "seconds", "speedup", (F.col("speedup") / F.col("cores")).alias("efficiency"))


def metrics_summary(metrics: DataFrame) -> DataFrame:
    """A line of text for each row of metrics."""
    return metrics.select("series_id", F.format_string("P=%.3f R=%.3f F1=%.3f FPR=%.3f", "precision", "recall", "f1", "fpr").alias("summary"))


def grouped_mean(results: DataFrame, keys: tuple[str, ...] = ("category", "algorithm", "threshold")) -> DataFrame:
    return results.groupBy(*keys).agg(*(F.round(F.avg(c), 4).alias(f"avg_{c}") for c in ("precision", "recall", "f1")))


def pivot_f1(means: DataFrame, thresholds: tuple[str, ...]) -> DataFrame:
    """algorithm by threshold of avg_f1."""
    return means.groupBy("algorithm").pivot("threshold", list(thresholds)).agg(F.avg("avg_f1"))


def averages(results: DataFrame) -> DataFrame:
    """By algorithm the means and the population deviation of f1, and whether it is the best by mean f1."""
    per = results.groupBy("algorithm").agg(F.avg("precision").alias("avg_precision"), F.avg("recall").alias("avg_recall"), F.avg("f1").alias("avg_f1"), F.stddev_pop("f1").alias("std_f1"))
    best = per.agg(F.max_by("algorithm", F.struct("avg_f1", "algorithm"))).scalar()
    return per.withColumn("best", (F.col("algorithm") == best).cast("int"))


def score_contrast(df: DataFrame) -> DataFrame:
    """By series the mean score inside and outside of the truth, and their ratio; infinite for 0 outside, null without either."""
    inside, outside = F.avg(F.when(F.col("truth") == 1, F.col("score"))), F.avg(F.when(F.col("truth") == 0, F.col("score")))
    out = df.groupBy("series_id").agg(inside.alias("inside"), outside.alias("outside"))
    return out.withColumn("contrast", F.when(F.col("inside").isNull() | F.col("outside").isNull(), None).when(F.col("outside") == 0, F.lit(float("inf"))).otherwise(F.try_divide("inside", "outside")))


def diagnostic_ratio(df: DataFrame) -> DataFrame:
    """By series the percentages of labelled and of true rows, and the first over the second."""
    out = df.groupBy("series_id").agg((F.avg("label") * 100).alias("detected_percent"), (F.avg("truth") * 100).alias("truth_percent"))
    return out.withColumn("ratio", quotient(F.col("detected_percent"), F.col("truth_percent")))


def sigmoid(position: Column) -> Column:
    """The published scaled sigmoid: 1 well ahead in a window, 0 at its right end, -1 far beyond; position is 0 at the right end, -1 at the left."""
    return F.when(position > 3.0, F.lit(-1.0)).otherwise(2.0 / (1.0 + F.exp(5.0 * position)) - 1.0)


def sweep(df: DataFrame, spans: DataFrame, profile: str = "standard", probation: float = PROBATION) -> DataFrame:
    """The best threshold of a pooled sweep over all series: threshold, raw_score, tp, fp, fn.

    Every score that occurs is a threshold. Within a window only the earliest
    detection counts, by its position; outside, a detection costs the weight of
    a false alarm by its distance from the window before it, all of it without
    one; a window without detection costs a miss. Rows in probation
    (probation of the first 5000 rows at most) are left out.
    """
    hit, miss, alarm = PROFILES[profile]
    sizes = df.groupBy("series_id").agg(F.count("*").alias("_n"))
    rows = df.join(sizes, "series_id").where(F.col("idx") >= F.floor(F.least("_n", F.lit(5000)) * probation)).select("series_id", "idx", "score")
    marks = spans.select("series_id", F.col("start_idx").alias("idx"), F.struct("start_idx", "end_idx").alias("_span"))
    w = Window.partitionBy("series_id").orderBy("idx", "_point").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.withColumns({"_span": F.lit(None).cast(marks.schema["_span"].dataType), "_point": F.lit(1)}).unionByName(marks.withColumns({"score": F.lit(None).cast("double"), "_point": F.lit(0)}))
    placed = both.withColumn("_span", F.last("_span", True).over(w)).where("_point = 1")
    start, end = F.col("_span.start_idx"), F.col("_span.end_idx")
    within = F.coalesce(F.col("idx") < end, F.lit(False))
    width = (end - start).cast("double")
    gain = hit * sigmoid(-(end - F.col("idx")) / width) / (2.0 / (1.0 + F.exp(F.lit(-5.0))) - 1.0)
    cost = F.when(end.isNull(), F.lit(-alarm)).otherwise(alarm * sigmoid((F.col("idx") - end + 1) / F.greatest(width - 1, F.lit(1.0))))
    points = placed.select("series_id", "idx", "score", within.alias("_within"), F.col("_span").alias("_span"), F.when(within, gain).otherwise(cost).alias("_points"))
    # a window's gain at threshold t is that of its first row with score >= t: the running maxima of score from its left end
    run = Window.partitionBy("series_id", "_span").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    firsts = points.where("_within").withColumn("_before", F.max("score").over(run))
    firsts = firsts.where("_before is null or score > _before")
    # the row pays from its score down to, not including, the largest score before it
    up = firsts.select(F.col("score").alias("t"), F.col("_points").alias("d"), F.when(F.col("_before").isNull(), 1).otherwise(1).alias("tp"), F.lit(0).alias("fp"))
    down = firsts.where("_before is not null").select(F.col("_before").alias("t"), (-F.col("_points")).alias("d"), F.lit(-1).alias("tp"), F.lit(0).alias("fp"))
    out = points.where("not _within").select(F.col("score").alias("t"), F.col("_points").alias("d"), F.lit(0).alias("tp"), F.lit(1).alias("fp"))
    steps = up.unionByName(down).unionByName(out).groupBy("t").agg(F.sum("d").alias("d"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    # scores lie in 0..1: running sums within slices of them, and sums of the slices above, of which there are few
    steps = steps.withColumn("_slice", F.floor(F.col("t") * SLICES))
    parts = ("d", "tp", "fp")
    above = Window.orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    slices = steps.groupBy("_slice").agg(*(F.sum(c).alias(c) for c in parts)).select("_slice", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"_{c}") for c in parts))
    high = Window.partitionBy("_slice").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    swept = steps.select("_slice", "t", *(F.sum(c).over(high).alias(c) for c in parts)).join(slices, "_slice")
    tp, missed = F.col("tp") + F.col("_tp"), spans.agg(F.count("*")).scalar() - F.col("tp") - F.col("_tp")
    scored = swept.select(F.col("t").alias("threshold"), (F.col("d") + F.col("_d") - miss * missed).alias("raw_score"), tp.alias("tp"), (F.col("fp") + F.col("_fp")).alias("fp"), missed.alias("fn"))
    return scored.orderBy(F.desc("raw_score"), F.desc("threshold")).limit(1)


def normalised(raw: DataFrame, spans: DataFrame, profile: str = "standard") -> DataFrame:
    """Adds null_raw, perfect_raw and score: 0 for detecting nothing, 100 for the start of every window and nothing else."""
    hit, miss, _ = PROFILES[profile]
    windows = spans.agg(F.count("*")).scalar()
    out = raw.withColumns({"null_raw": -miss * windows, "perfect_raw": hit * windows})
    return out.withColumn("score", quotient(F.col("raw_score") - F.col("null_raw"), F.col("perfect_raw") - F.col("null_raw")) * 100)

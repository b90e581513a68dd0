"""Isolation forest over six features of a series view."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions.core import Quantile, frames, quotient, stats
from . import features

FEATURES = ("value", "f_mean", "f_std", "f_diff", "f_ratio", "f_flat")
#: Rows of a series that each tree is drawn from, and rows of a series that trees are drawn from.
SUBSAMPLE, POOL = 256, 16_384


def forest_features(df: DataFrame, width: int = 20, chunk: int | None = None) -> DataFrame:
    """value, centred mean and deviation (nulls filled by the series'), absolute difference, ratio to the typical spike, and how far the deviation is below its usual."""
    joined = chunk is not None
    back, ahead, columns = features.rolling_columns(width, None, True)
    rows = frames(df, max(back, 1), ahead, lambda w: columns(w) | _difference(w), chunk)
    rows = stats(rows, {"_m": F.avg("value"), "_s": F.stddev_samp("value"), "_p99": Quantile("value", 0.99)}, joined)
    rows = rows.withColumns({"f_mean": F.coalesce("rolling_mean", "_m"), "f_std": F.coalesce("rolling_std", "_s"), "_high": F.when(F.col("value") > F.col("_p99"), F.col("value"))})
    rows = stats(rows, {"_highs": F.count("_high"), "_median": Quantile("_high", 0.5), "_sm": F.avg("f_std"), "_ss": F.stddev_pop("f_std")}, joined)
    spike = F.when(F.col("_highs") >= 2, F.col("_median")).otherwise(F.col("_p99"))
    rows = rows.withColumns({"f_ratio": quotient(F.col("value"), spike + 1e-8), "f_flat": F.greatest(F.lit(0.0), quotient(F.col("_sm") - F.col("f_std"), F.col("_ss") + 1e-8))})
    return rows.select(*df.columns, "f_mean", "f_std", "f_diff", "f_ratio", "f_flat")


def _difference(w: WindowSpec) -> dict:
    return {"f_diff": F.coalesce(F.abs(F.col("value") - F.lag("value").over(w)), F.lit(0.0))}


def path_correction(n: np.ndarray | float):
    """The mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    big = 2.0 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2.0 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


class Forest:
    """All trees in arrays by node: feature, cut, two children, and the path length that ends at a leaf, which is its own child."""

    def __init__(self, feature: np.ndarray, cut: np.ndarray, child: np.ndarray, path: np.ndarray, trees: int, size: int):
        self.feature, self.cut, self.child, self.path, self.trees, self.size = feature, cut, child, path, trees, size

    @classmethod
    def grow(cls, x: np.ndarray, trees: int, seed: int) -> Forest:
        """The first `trees` nodes are the roots; all trees grow by a level at a time."""
        rng = np.random.default_rng(seed)
        size = min(SUBSAMPLE, len(x))
        limit = math.ceil(math.log2(max(size, 2)))
        sample = x[np.concatenate([rng.choice(len(x), size, replace=False) for _ in range(trees)])]
        at, active = np.repeat(np.arange(trees), size), np.arange(len(sample))
        made, first, levels = trees, 0, []
        for depth in range(limit + 1):
            active = active[np.argsort(at[active], kind="stable")]
            starts = np.searchsorted(at[active], np.arange(first, made))
            counts = np.diff(np.r_[starts, len(active)])
            low, high = (f.reduceat(sample[active], starts) for f in (np.minimum, np.maximum))
            varied = high > low
            splits = varied.any(1) & (counts > 1) & (depth < limit)
            chosen = np.where(varied, rng.random(varied.shape), -1.0).argmax(1)
            rows = np.arange(len(chosen))
            # above the lowest value and at most the highest, so that both sides have rows
            cut = high[rows, chosen] - rng.random(len(chosen)) * (high - low)[rows, chosen]
            child = np.stack([rows + first] * 2, 1)
            child[splits] = made + np.arange(2 * int(splits.sum())).reshape(-1, 2)
            levels.append((np.where(splits, chosen, 0), np.where(splits, cut, np.inf), child, np.where(splits, 0.0, depth + path_correction(counts))))
            active = active[splits[at[active] - first]]
            if not len(active):
                break
            node = at[active] - first
            at[active] = child[node, (sample[active, chosen[node]] >= cut[node]).astype(int)]
            first, made = made, made + 2 * int(splits.sum())
        feature, cut, child, path = (np.concatenate(v) for v in zip(*levels, strict=True))
        return cls(feature, cut, child.ravel(), path, trees, size)

    def anomaly(self, x: np.ndarray, rows: int = 8192) -> np.ndarray:
        """2 to the power of minus the mean path length over that of an unsuccessful search."""
        depth = math.ceil(math.log2(max(self.size, 2)))
        out = np.empty(len(x))
        for lo in range(0, len(x), rows):
            part = np.ascontiguousarray(x[lo : lo + rows])
            flat, base, total = part.ravel(), np.arange(len(part)) * part.shape[1], np.zeros(len(part))
            for tree in range(self.trees):
                at = np.full(len(part), tree)
                for _ in range(depth):
                    at = self.child[2 * at + (flat[base + self.feature[at]] >= self.cut[at])]
                total += self.path[at]
            out[lo : lo + rows] = total / self.trees
        return 2.0 ** (-out / max(float(path_correction(self.size)), 1e-9))


_U = "_chance"
_KINDS = {"size": "int", "feature": "array<bigint>", "cut": "array<double>", "child": "array<bigint>", "path": "array<double>"}


def _matrix(table: pa.Table) -> np.ndarray:
    return np.column_stack([np.asarray(table.column(f"_x{k}").combine_chunks()) for k in range(len(FEATURES))]) if table.num_rows else np.zeros((0, len(FEATURES)))


def _planted(table: pa.Table, rows: int, trees: int, seed: int) -> Forest:
    """Trees from the pool of a series of so many rows: those whose chance is below the pool's share."""
    x = _matrix(table)[np.asarray(table.column(_U)) < POOL / max(rows, 1)]
    return Forest.grow(x[np.lexsort(x.T)], trees, seed)


def _quantile(x: np.ndarray, p: float) -> float:
    """By linear interpolation between two ranks."""
    x, at = np.sort(x), (len(x) - 1) * p
    a, b = x[math.floor(at)], x[math.ceil(at)]
    return a if a == b else (math.ceil(at) - at) * a + (at - math.floor(at)) * b


def isolation_forest(df: DataFrame, contamination: float = 0.01, trees: int = 100, width: int = 20, seed: int = 42, chunk: int | None = None) -> DataFrame:
    """score: anomaly by the mean isolation depth, scaled to 0..1 by series; label: beyond the contamination quantile.

    The trees of a series are grown from about POOL of its rows, or all of a
    shorter one, chosen by a hash of idx. A series is grown and scored in one
    task; with chunk its trees are grown in a small one, and its rows scored in
    runs. Rows that score alike get one label; a null feature counts as 0.
    """
    rows = forest_features(df, width, chunk)
    inputs = {f"_x{k}": F.coalesce(F.col(c), F.lit(0.0)) for k, c in enumerate(FEATURES)}
    chance = F.pmod(F.xxhash64("idx", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = rows.withColumns({**inputs, _U: chance}).select(*df.columns, *inputs, _U)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    own = list(df.columns)

    def whole(table):
        forest = _planted(table, table.num_rows, trees, seed)
        a = forest.anomaly(_matrix(table))
        low, span = a.min(), a.max() - a.min()
        label = (a > _quantile(a, 1 - contamination)).astype(np.int32)
        score = (a - low) / span if span > 0 else np.zeros(len(a))
        return table.select(own).append_column("score", pa.array(score)).append_column("label", pa.array(label)).append_column("detection_type", pa.array(np.where(label == 1, "Spike", "").tolist(), pa.string()))

    if chunk is None:
        return rows.groupBy("series_id").applyInArrow(whole, f"{schema}, score double, label int, detection_type string")

    def plant(table):
        forest = _planted(table, table.column("_n")[0].as_py(), trees, seed)
        arrays = {"feature": forest.feature, "cut": forest.cut, "child": forest.child, "path": forest.path}
        return pa.table({"of": table.column("series_id").slice(0, 1), "size": pa.array([forest.size], pa.int32()), **{k: pa.array([v]) for k, v in arrays.items()}})

    def score(key, table, model):
        row = model.slice(0, 1)
        array = lambda k: np.asarray(row.column(k).combine_chunks().flatten())
        forest = Forest(array("feature"), array("cut"), array("child"), array("path"), trees, row.column("size")[0].as_py())
        return table.select(own).append_column("_a", pa.array(forest.anomaly(_matrix(table))))

    sized = stats(rows, {"_n": F.count(F.lit(1))}, True)
    planted = sized.where(F.col(_U) < F.lit(float(POOL)) / F.col("_n")).groupBy("series_id").applyInArrow(plant, "of string, " + ", ".join(f"{k} {v}" for k, v in _KINDS.items()))
    run = rows.withColumn("_run", F.floor(F.col("idx") / (1 << 16)))
    runs = run.select(F.col("series_id").alias("of"), F.col("_run").alias("of_run")).distinct().join(planted, "of")
    scored = run.groupBy("series_id", "_run").cogroup(runs.groupBy("of", "of_run")).applyInArrow(score, f"{schema}, _a double")
    scored = stats(scored, {"_lo": F.min("_a"), "_hi": F.max("_a"), "_t": Quantile("_a", 1 - contamination)}, True)
    scored = scored.withColumns({"score": quotient(F.col("_a") - F.col("_lo"), F.col("_hi") - F.col("_lo")), "label": (F.col("_a") > F.col("_t")).cast("int")})
    return scored.select(*df.columns, "score", "label", F.when(F.col("label") == 1, "Spike").otherwise("").alias("detection_type"))

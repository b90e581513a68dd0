"""Missing values, dropped rows, exact quantiles of long series, and names of files and labels."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmith.functions.core import Quantile, Threshold, stats
from seriesmith.operators import detectors, evaluate, forest
from seriesmith.operators import series as S
from seriesmith.sources import files

RNG = np.random.default_rng(11)
WAVE = (np.sin(np.arange(220) / 9) * 8 + RNG.normal(0, 1, 220)).tolist()
K = Threshold("adaptive_std", k=2.5)


def test_what_is_no_number_is_missing(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = [("a", t + datetime.timedelta(minutes=k), v) for k, v in enumerate([1.0, math.nan, 3.0, None, 5.0])]
    view = S.to_series(spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double"), "k", "ts", "v")
    assert [r.value for r in view.orderBy("idx").collect()] == [1.0, None, 3.0, None, 5.0]
    assert [r.value for r in S.fill(view).orderBy("idx").collect()] == [1.0, 2.0, 3.0, 4.0, 5.0]
    assert S.series_stats(view).first()["mean"] == 3.0
    scored = detectors.global_zscore(view, 0.5).orderBy("idx").collect()
    assert [(r.score, r.label) for r in scored if r.value is None] == [(0.0, 0)] * 2


@pytest.mark.parametrize("name", ["rolling_zscore", "prediction_error", "hybrid", "mean_shift"])
def test_detectors_go_by_position_after_a_drop(series, name):
    gappy = [None if k % 5 == 3 else v for k, v in enumerate(WAVE)]
    detect = getattr(detectors, name)
    dense = detect(series({"a": [v for v in gappy if v is not None], "b": WAVE[:30]}), threshold=K).where("series_id = 'a'").orderBy("idx").collect()
    for chunk in (None, 32):
        got = detect(S.fill(series({"a": gappy, "b": [*WAVE[:30], None]}), "drop", chunk), threshold=K, chunk=chunk).where("series_id = 'a'").orderBy("idx").collect()
        assert [r.idx for r in got] == [k for k in range(220) if k % 5 != 3] and [r.pos for r in got] == list(range(176))
        assert [r.label for r in got] == [r.label for r in dense] and [r.score for r in got] == pytest.approx([r.score for r in dense], abs=1e-9)


def test_long_series_are_filled_and_judged_alike(series):
    gappy = [None if RNG.random() < 0.6 or 90 < k < 160 else v for k, v in enumerate(WAVE)]
    df = series({"a": gappy, "b": [None, 1.0, None, None], "c": [None] * 40})
    for method in S.FILLS:
        whole, runs = (sorted(map(str, S.fill(df, method, chunk).withColumn("value", F.round("value", 9)).collect())) for chunk in (None, 16))
        assert whole == runs
    marked = df.withColumns({"truth": (F.col("idx") % 50 > 40).cast("int"), "label": (F.col("idx") % 70 == 45).cast("int")})
    assert sorted(map(str, evaluate.detection_delay(marked).collect())) == sorted(map(str, evaluate.detection_delay(marked, chunk=16).collect()))


def test_an_empty_series_has_no_label(series):
    df = series({"a": [None] * 30, "b": WAVE})
    for detect in (detectors.rolling_zscore, detectors.prediction_error, detectors.hybrid, detectors.mean_shift):
        for threshold in (K, Threshold("percentile", percentile=90.0)):
            assert {(r.score, r.label) for r in detect(df, threshold=threshold).where("series_id = 'a'").collect()} == {(0.0, 0)}
    assert {r.label for r in forest.isolation_forest(df, trees=5).where("series_id = 'a'").collect()} == {0}


def test_quantiles_without_a_task_that_holds_a_series(spark):
    kinds = {
        "wave": RNG.normal(0, 1, 30_000), "ties": RNG.integers(0, 4, 30_000).astype(float), "one": np.array([4.0]), "two": np.array([1.0, 2.0]),
        "few": RNG.normal(0, 1, 57), "zeros": np.r_[np.zeros(9000), RNG.normal(0, 1, 100)], "thirds": np.r_[np.full(4000, 2.5), RNG.normal(2.5, 1, 8000)],
    }
    rows = [(k, float(v)) for k, x in kinds.items() for v in x] + [("wave", None), ("none", None)]
    df = spark.createDataFrame(rows, "series_id string, value double").repartition(5)
    ps = (0.0, 0.01, 0.25, 0.5, 0.973, 0.99, 1.0)
    wanted = {f"p{k}": Quantile("value", p) for k, p in enumerate(ps)}
    got = {r.series_id: r for r in stats(df, {**wanted, "n": F.count("value")}, True).groupBy("series_id").agg(*(F.min(c).alias(c) for c in [*wanted, "n"])).collect()}
    for name, x in kinds.items():
        assert [got[name][c] for c in wanted] == pytest.approx(np.quantile(x, ps).tolist(), abs=1e-12) and got[name].n == len(x)
    assert got["none"].p0 is None and stats(df, wanted, True).count() == len(rows)


def test_a_series_in_runs_has_the_same_forest(series):
    df = series({"a": [*WAVE, 90.0, *WAVE], "b": WAVE[:40]})
    whole = {(r.series_id, r.idx): (r.score, r.label) for r in forest.isolation_forest(df, trees=20).collect()}
    runs = {(r.series_id, r.idx): (r.score, r.label) for r in forest.isolation_forest(df, trees=20, chunk=64).collect()}
    assert set(whole) == set(runs) and all(whole[k] == (pytest.approx(runs[k][0], abs=1e-9), runs[k][1]) for k in whole)
    assert whole["a", 220] == (1.0, 1)


def test_trees_by_brute_force():
    """Depths of the level-wise trees are those of a walk, node by node, and every leaf holds what its path says."""
    x = RNG.normal(0, 1, (300, 6))
    f = forest.Forest.grow(x, 7, 1)
    depth, limit = np.zeros(300), 8
    for tree in range(7):
        for k, row in enumerate(x):
            at, steps = tree, 0
            while f.child[2 * at] != at:
                at, steps = int(f.child[2 * at + (row[f.feature[at]] >= f.cut[at])]), steps + 1
            assert steps <= limit and f.path[at] >= steps
            depth[k] += f.path[at]
    assert f.anomaly(x) == pytest.approx(2.0 ** (-depth / 7 / float(forest.path_correction(256))))


def test_intervals_that_repeat(series):
    df = series({"a": [0.0] * 50}).withColumn("label", F.when(F.col("idx") == 20, 1).otherwise(0))
    spans = df.sparkSession.createDataFrame([("a", 0, 18, 22), ("a", 1, 18, 22), ("a", 2, 40, 42)], "series_id string, interval_id long, start_idx long, end_idx long")
    for s in (spans, spans.drop("interval_id")):
        r = evaluate.fuzzy(df, s, 2).first()
        assert (r.tp, r.fp, r.fn) == (2, 0, 1)


def test_labels_find_their_series(spark):
    labels = spark.createDataFrame([(k, 0, None, None) for k in ("web/load", "db/disk", "net/disk", "plain", "web/cpu")], "series_id string, interval_id long, start_ts timestamp_ntz, end_ts timestamp_ntz")
    names = spark.createDataFrame([("db/load",), ("web/cpu",), ("disk",), ("plain",), ("other",)], "series_id string")
    _, found = files.with_labels(names, labels)
    assert sorted(r.series_id for r in found.collect()) == ["disk", "plain", "web/cpu"]


def test_names_of_files(spark, tmp_path):
    for name in ("x y", "sub dir/a+b", "sub dir/c%20d", "é"):
        path = tmp_path / "root" / f"{name}.csv"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("timestamp,value\n2024-01-01 00:00:00,1\n2024-01-01 00:01:00,NaN\n2024-01-01 00:02:00,\n")
    names = files.catalog(spark, f"{tmp_path}/root")
    got = files.read_series(spark, f"{tmp_path}/root")
    assert sorted({r.series_id for r in got.collect()}) == names == sorted(["x y", "sub dir/a+b", "sub dir/c%20d", "é"])
    assert got.where("value is null").count() == 8
    assert {r.series_id for r in files.read_series(spark, f"{tmp_path}/root", ["a+b"]).collect()} == {"sub dir/a+b"}

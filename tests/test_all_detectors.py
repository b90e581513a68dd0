"""The registered queries over all five detectors, against loops over the detectors' own rows."""

import datetime
import random
from collections import defaultdict
from statistics import fmean, pstdev

import pytest
from pyspark.sql import functions as F

from seriesmith.operators import ensemble, evaluate, forest
from seriesmith.plans import registry

FIVE = ["hybrid", "isolation_forest", "mean_shift", "prediction_error", "rolling_zscore"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r, start, rows = random.Random(3), datetime.datetime(2024, 1, 1), []
    for name in ("a", "b"):
        for k in range(160):
            value = r.gauss(50, 3) + (60 if k in (70, 71, 120) else 0) + (25 if name == "b" and k > 140 else 0)
            rows.append((len(rows), name, start + datetime.timedelta(minutes=30 * k), value))
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "event_id long, event_type string, ts timestamp_ntz, value double").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.fixture(scope="module")
def points(spark, tables):
    """(algorithm, series, idx) -> (score, label) of each detector run by itself."""
    df, out = registry.events(spark, tables), {}
    for name in FIVE:
        one = forest.isolation_forest(df) if name == "isolation_forest" else ensemble.REGISTRY[name](df, threshold=registry.ADAPTIVE)
        out |= {(name, r.series_id, r.idx): (r.score, r.label) for r in one.collect()}
    return out


def run(spark, tables, name):
    return registry.QUERIES[name](spark, tables).collect()


def test_points_votes_and_summary(spark, tables, points):
    long = run(spark, tables, "detect_all")
    assert len(long) == len(points) == 5 * 320
    assert all((r.score, r.label) == (pytest.approx(points[r.algorithm, r.series_id, r.idx][0], abs=1e-6), points[r.algorithm, r.series_id, r.idx][1]) for r in long)
    wide, votes = run(spark, tables, "detect_wide"), run(spark, tables, "ensemble")
    assert len(wide) == len(votes) == 320
    for r in wide:
        for name in FIVE:
            score, label = points[name, r.series_id, r.idx]
            assert r[f"{name}_anomaly"] == label and r[f"{name}_score"] == pytest.approx(score, abs=1e-6)
    two = 0
    for r in votes:
        mine = [points[name, r.series_id, r.idx] for name in FIVE]
        marked = sum(label for _, label in mine)
        two += marked == 2
        assert r.label == (marked >= 3) and r.score == pytest.approx(fmean(score for score, _ in mine), abs=1e-6)
    assert two  # of such rows four detectors without the forest may make a label
    summary = {r.algorithm: r for r in run(spark, tables, "run_summary")}
    assert sorted(summary) == FIVE
    for name, r in summary.items():
        mine = [v for k, v in points.items() if k[0] == name]
        scores, marked = [s for s, _ in mine], sum(m for _, m in mine)
        assert (r.points, r.anomalies) == (320, marked) and r.percent == pytest.approx(marked / 3.2, abs=1e-6)
        assert (r.min_score, r.max_score, r.mean_score) == (pytest.approx(min(scores), abs=1e-6), pytest.approx(max(scores), abs=1e-6), pytest.approx(fmean(scores), abs=1e-6))


def test_evaluation_grid(spark, tables):
    df = registry.events(spark, tables)
    spans = defaultdict(list)
    for r in evaluate.intervals_to_index(df, registry.intervals(df)).collect():
        spans[r.series_id].append((r.start_idx, r.end_idx))
    want = {}
    for threshold in ("Low", "Medium"):
        for name in FIVE:
            marked = defaultdict(set)
            for r in ensemble.REGISTRY[name](df, **ensemble.preset(name, threshold)).where(F.col("label") == 1).collect():
                marked[r.series_id].add(r.idx)
            for s in ("a", "b"):
                zones = [range(max(0, a - 5), min(160, b + 5) + 1) for a, b in spans[s]]
                tp = sum(any(k in z for k in marked[s]) for z in zones)
                fp = sum(not any(k in z for z in zones) for k in marked[s])
                p, q = tp / (tp + fp) if tp + fp else 0.0, tp / len(zones)
                want[s, name, threshold] = (p, q, 2 * p * q / (p + q) if p + q else 0.0, tp, fp, len(zones) - tp)
    got = {(r.series_id, r.algorithm, r.threshold): tuple(r)[3:] for r in run(spark, tables, "eval_grid")}
    assert set(got) == set(want) and all(got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())
    f1 = lambda name, threshold: [v[2] for k, v in want.items() if k[1] == name and threshold in (None, k[2])]
    means = {(r.algorithm, r.threshold): r.avg_f1 for r in run(spark, tables, "eval_means")}
    assert means == {(n, t): pytest.approx(fmean(f1(n, t)), abs=1e-4) for n in FIVE for t in ("Low", "Medium")}
    pivot = {r.algorithm: (r.Low, r.Medium) for r in run(spark, tables, "eval_pivot")}
    assert pivot == {n: pytest.approx((fmean(f1(n, "Low")), fmean(f1(n, "Medium"))), abs=1e-4) for n in FIVE}
    averages = {r.algorithm: r for r in run(spark, tables, "eval_averages")}
    assert sorted(averages) == FIVE and [n for n in FIVE if averages[n].best] == [max(FIVE, key=lambda n: (fmean(f1(n, None)), n))]
    assert all((averages[n].avg_f1, averages[n].std_f1) == pytest.approx((fmean(f1(n, None)), pstdev(f1(n, None))), abs=1e-6) for n in FIVE)

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmith.functions.core import Threshold
from seriesmith.operators import detectors, ensemble, evaluate, forest
from seriesmith.sources import files

RNG = np.random.default_rng(3)


@pytest.fixture
def points(spark):
    def make(truth: str, label: str, score=None):
        rows = [("a", k, int(t), int(p), float(p) if score is None else float(score[k])) for k, (t, p) in enumerate(zip(truth, label, strict=True))]
        return spark.createDataFrame(rows, "series_id string, idx long, truth int, label int, score double")

    return make


def test_worked_example(points):
    df = points("0001100011100", "0011100111000")
    r = evaluate.point_metrics(df).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (4, 2, 1, 6)
    assert (r.precision, r.recall, r.f1, r.fpr) == pytest.approx((4 / 6, 4 / 5, 8 / 11, 2 / 8))
    assert evaluate.detection_delay(df).first().delay_samples == 0
    assert evaluate.simple_score(df).first().score == 100
    r = evaluate.simple_score(df, least=0).first()
    assert (r.fp, r.fn, r.score) == (2, 1, pytest.approx(100 - 1.22))


def test_fuzzy_against_loops(spark):
    n = 3000
    for seed in range(3):
        rng = np.random.default_rng(seed)
        labels = sorted(rng.choice(n, 40, replace=False).tolist())
        spans = [(int(a), int(a) + int(rng.integers(1, 60))) for a in rng.choice(n - 80, 6, replace=False)]
        tol = 30
        zone = [(max(0, a - tol), min(n, b + tol)) for a, b in spans]
        tp = sum(any(lo <= i <= hi for i in labels) for lo, hi in zone)
        fp = sum(not any(lo <= i <= hi for lo, hi in zone) for i in labels)
        df = spark.range(n).select(F.lit("a").alias("series_id"), F.col("id").alias("idx"), F.col("id").isin(labels).cast("int").alias("label"))
        r = evaluate.fuzzy(df, spark.createDataFrame([("a", a, b) for a, b in spans], "series_id string, start_idx long, end_idx long"), tol).first()
        assert (r.tp, r.fp, r.fn) == (tp, fp, len(spans) - tp)
        assert r.score == pytest.approx(max(0, 100 - (0.11 * fp + len(spans) - tp)))


def test_fuzzy_zone_is_one_row_wider_on_the_right(spark):
    spans = spark.createDataFrame([("a", 10, 13)], "series_id string, start_idx long, end_idx long")
    for at, hit in ((5, 1), (4, 0), (18, 1), (19, 0)):
        df = spark.range(50).select(F.lit("a").alias("series_id"), F.col("id").alias("idx"), (F.col("id") == at).cast("int").alias("label"))
        assert evaluate.fuzzy(df, spans, 5).first().tp == hit


def test_sweep_against_brute_force(spark):
    n, spans = 800, [(200, 240), (500, 520)]
    score = np.round(RNG.random(n), 2)
    rows = [("a", k, float(s)) for k, s in enumerate(score)]
    df = spark.createDataFrame(rows, "series_id string, idx long, score double")
    got = evaluate.sweep(df, spark.createDataFrame([("a", a, b) for a, b in spans], "series_id string, start_idx long, end_idx long")).first()

    def sig(x):
        return -1.0 if x > 3 else 2 / (1 + np.exp(5 * x)) - 1

    best = None
    for t in sorted(set(score[120:])):
        total, tp, fp = 0.0, 0, 0
        for a, b in spans:
            hits = [k for k in range(a, b) if score[k] >= t]
            if hits:
                total += sig(-(b - hits[0]) / (b - a)) / sig(-1.0)
                tp += 1
            else:
                total -= 1.0
        for k in range(120, n):
            if score[k] >= t and not any(a <= k < b for a, b in spans):
                before = [x for x in spans if x[1] <= k]
                total += 0.11 * sig((k - before[-1][1] + 1) / max(before[-1][1] - before[-1][0] - 1, 1)) if before else -0.11
                fp += 1
        if best is None or (total, t) > best[:2]:
            best = (total, t, tp, fp)
    assert (got.raw_score, got.threshold, got.tp, got.fp, got.fn) == (pytest.approx(best[0]), best[1], best[2], best[3], 2 - best[2])


def test_intervals_by_time(series):
    df = series({"a": range(60)})
    spans = df.sparkSession.createDataFrame([("a", 0, "2024-01-01 00:10:30", "2024-01-01 00:20:30"), ("a", 1, "2025-01-01 00:00:00", "2025-01-02 00:00:00")], "series_id string, interval_id long, s string, e string")
    spans = spans.select("series_id", "interval_id", F.to_timestamp_ntz("s").alias("start_ts"), F.to_timestamp_ntz("e").alias("end_ts"))
    got = evaluate.intervals_to_index(df, spans).collect()
    assert [(r.interval_id, r.start_idx, r.end_idx) for r in got] == [(0, 11, 21)]
    assert [r.idx for r in evaluate.point_mask(df, spans).where("truth = 1").orderBy("idx").collect()] == list(range(11, 21))


def test_forest_finds_planted_outliers(series):
    x = (50 + RNG.normal(0, 2, 1500)).tolist()
    for k in (300, 700, 1100):
        x[k] = 120.0
    df = series({"a": x, "b": [5.0] * 50})
    got = forest.isolation_forest(df, 0.01)
    labelled = [r.idx for r in got.where("label = 1 and series_id = 'a'").collect()]
    assert {300, 700, 1100} <= set(labelled) and len(labelled) <= 15
    assert got.where("series_id = 'b' and (label = 1 or score <> 0)").count() == 0
    again = forest.isolation_forest(df.repartition(7), 0.01)
    assert sorted(map(tuple, got.select("series_id", "idx", "score").collect())) == sorted(map(tuple, again.select("series_id", "idx", "score").collect()))


def test_ensemble(series):
    x = RNG.normal(0, 1, 200)
    x[100] = 50
    df = series({"a": x.tolist()})
    names = ("rolling_zscore", "prediction_error", "mean_shift")
    long = ensemble.detect_all(df, names, {n: ensemble.preset(n, "Low") for n in names})
    assert long.count() == 600
    assert [r.idx for r in ensemble.vote(ensemble.detect_wide(df, names, {n: ensemble.preset(n, "Low") for n in names}), names).where("label = 1").collect()] == [100]
    assert {"rolling_zscore_anomaly", "mean_shift_score"} <= set(ensemble.wide(long, names).columns)
    assert ensemble.dominant_type(detectors.rolling_zscore(df, threshold=Threshold("fixed", 4.0))).first().dominant_type == "Spike"
    with pytest.raises(ValueError):
        ensemble.detect(df, "nothing")


def test_files(spark, tmp_path):
    (tmp_path / "web").mkdir()
    (tmp_path / "web/load.csv").write_text("timestamp,value\n2024-01-01 00:00:00,1.5\n2024-01-01 00:05:00,2.5\n")
    (tmp_path / "alone.csv").write_text("timestamp,value\n2024-01-01 00:00:00,7\n")
    (tmp_path / "labels.json").write_text(json.dumps({"web/load.csv": [["2024-01-01 00:00:00", "2024-01-01 00:02:00"]], "other.csv": []}))
    root = str(tmp_path)
    assert files.catalog(spark, root) == ["alone", "web/load"]
    df = files.read_series(spark, root)
    assert sorted((r.series_id, r.value) for r in df.collect()) == [("alone", 7.0), ("web/load", 1.5), ("web/load", 2.5)]
    assert files.read_series(spark, root, ["load"]).count() == 2
    with pytest.raises(FileNotFoundError):
        files.resolve(spark, root, "missing")
    labels = files.read_labels(spark, f"{root}/labels.json")
    assert [(r.series_id, str(r.end_ts)) for r in labels.collect()] == [("web/load", "2024-01-01 00:02:00")]
    assert files.with_labels(df, labels)[1].count() == 1
    files.write_report(df, f"{root}/out")
    assert spark.read.json(f"{root}/out").count() == 3

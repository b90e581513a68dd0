import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesmith.functions.core import Threshold, centred
from seriesmith.operators import detectors, features
from seriesmith.operators import series as S

RNG = np.random.default_rng(5)
WAVE = (np.sin(np.arange(300) / 7) * 10 + RNG.normal(0, 1, 300)).tolist()


def values(df, column="value", name="a"):
    return [r[column] for r in df.where(F.col("series_id") == name).orderBy("idx").collect()]


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert (x is None and (y is None or math.isnan(y))) or x == pytest.approx(y, rel=1e-9, abs=1e-9), (x, y)


def test_to_series_breaks_ties(spark):
    t = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", t, 2, 5), ("a", t, 1, 7), ("b", t, 1, 9)], "k string, ts timestamp_ntz, tie int, v long")
    rows = {(r.series_id, r.idx): r.value for r in S.to_series(df, "k", "ts", "v", "tie").collect()}
    assert rows == {("a", 0): 7.0, ("a", 1): 5.0, ("b", 0): 9.0}


def test_numbering_by_slices_is_the_same(spark):
    r = np.random.default_rng(1)
    rows = [(f"s{k % 3}", None if k % 41 == 0 else datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=int(r.integers(0, 400))), k, float(k % 7)) for k in range(500)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, tie int, v double")
    for unit in ("hour", "day", "month"):
        a, b = (sorted(map(str, S.to_series(df, "k", "ts", "v", "tie", unit=u).collect())) for u in (None, unit))
        assert a == b


@pytest.mark.parametrize("gaps", [[None, 1, None, None, 4, None], [None, None], [3, 1, 2]])
def test_fills(series, gaps):
    df, p = series({"a": gaps}), pd.Series(gaps, dtype=float)
    close(values(S.fill(df, "interpolate")), p.interpolate().bfill().ffill().tolist())
    close(values(S.fill(df, "forward_fill")), p.ffill().bfill().tolist())
    close(values(S.fill(df, "mean")), p.fillna(p.mean()).tolist())
    assert values(S.fill(df, "drop")) == p.dropna().tolist()
    with pytest.raises(ValueError):
        S.fill(df, "guess")


def test_scales_and_back(series):
    df = series({"a": WAVE, "c": [5.0] * 10})
    x = np.array(WAVE)
    close(values(S.scale(df, "standard"), "value_normalized"), ((x - x.mean()) / x.std()).tolist())
    close(values(S.scale(df, "minmax"), "value_normalized"), ((x - x.min()) / (x.max() - x.min())).tolist())
    assert set(values(S.scale(df, "standard"), "value_normalized", "c")) == {0.0}
    close(values(S.denormalize(S.scale(df, "minmax", keep=True)), "value_denormalized"), WAVE)
    close(values(S.scale(df, "standard", joined=True), "value_normalized"), ((x - x.mean()) / x.std()).tolist())


def test_stats_match_pandas(series):
    r = S.series_stats(series({"a": WAVE})).first()
    p = pd.Series(WAVE)
    close([r["count"], r["mean"], r["std"], r["median"], r["q25"], r["skewness"], r["kurtosis"]], [300, p.mean(), p.std(ddof=0), p.median(), p.quantile(0.25), p.skew(), p.kurt()])


@pytest.mark.parametrize("width", [20, 10, 7, 5])
@pytest.mark.parametrize("chunk", [None, 32])
def test_rolling_matches_pandas(series, width, chunk):
    df, p = series({"a": WAVE, "b": WAVE[:3]}), pd.Series(WAVE)
    for centre in (False, True):
        got = features.rolling(df, width, centre=centre, chunk=chunk)
        r = p.rolling(width, min_periods=width // 2, center=centre)
        close(values(got, "rolling_mean"), r.mean().tolist())
        close(values(got, "rolling_std"), r.std().tolist())
    back, ahead = centred(width)
    assert back + ahead + 1 == width


def test_trend_gradient_forecast(series):
    df, x = series({"a": WAVE}), np.array(WAVE)
    slope = [np.polyfit(range(5), x[i - 2 : i + 3], 1)[0] if 2 <= i < 298 else 0.0 for i in range(300)]
    close(values(features.trend(df, 5), "trend"), slope)
    close(values(features.gradient(features.trend(df, 5)), "gradient"), np.gradient(slope).tolist())
    assert set(values(features.trend(df, 4), "trend")) == {0.0}
    guess = [x[:10].mean()] * 10 + [x[i - 10 : i].mean() for i in range(10, 300)]
    close(values(features.forecast(df, 10), "prediction"), guess)
    close(values(features.forecast(df, 10, chunk=32, joined=True), "prediction"), guess)


def test_matrix_downsample_histogram(series):
    df = series({"a": WAVE, "c": [1.0] * 5})
    m = features.window_matrix(df, 16, 4).where("series_id = 'a'").orderBy("start").collect()
    assert [r.start for r in m] == list(range(0, 285, 4)) and all(r["window"] == WAVE[r.start : r.start + 16] and r.centre == r.start + 8 for r in m)
    kept = {r.idx for r in features.downsample(df, 60).where("series_id = 'a'").collect()}
    step, want = 300 / 30, set()
    for k in range(30):
        part = WAVE[int(k * step) : int((k + 1) * step)]
        want |= {int(k * step) + int(np.argmin(part)), int(k * step) + int(np.argmax(part))}
    assert kept == want and features.downsample(df, 60).where("series_id = 'c'").count() == 5
    bins = {r.bin: r.n for r in features.histogram(df, 30).where("series_id = 'a'").collect()}
    expected, _ = np.histogram(WAVE, 30)
    assert [bins.get(k + 1, 0) for k in range(30)] == expected.tolist()


def test_zscore_finds_the_spike_whatever_scale(series):
    spiked = [*WAVE[:150], 500.0, *WAVE[151:]]
    df = series({"a": spiked, "b": [3 * v - 7 for v in spiked], "flat": [5.0] * 100, "one": [1.0]})
    got = detectors.rolling_zscore(df, threshold=Threshold("adaptive_std", k=4.0))
    assert [r.idx for r in got.where("label = 1 and series_id = 'a'").collect()] == [150]
    close(values(got, "score"), values(got, "score", "b"))
    assert got.where("series_id in ('flat', 'one') and (label = 1 or score <> 0)").count() == 0
    chunked = detectors.rolling_zscore(df, threshold=Threshold("adaptive_std", k=4.0), chunk=32)
    close(values(got, "score"), values(chunked, "score"))


def test_percentile_flags_as_many_as_it_says(series):
    got = detectors.rolling_zscore(series({"a": WAVE}), threshold=Threshold("percentile", percentile=95.0))
    assert sum(values(got, "label")) == math.floor(299 * 0.05) + 1
    assert all(0 <= s <= 1 for s in values(got, "score"))


def test_mean_shift_labels_one_row_of_each_run(series):
    steps = [v + RNG.normal(0, 0.3) for v, n in ((10, 150), (35, 150), (15, 150)) for _ in range(n)]
    for chunk in (None, 64):
        got = detectors.mean_shift(series({"a": steps}), threshold=Threshold("fixed", 20.0), chunk=chunk)
        at = [r.idx for r in got.where("label = 1").orderBy("idx").collect()]
        assert at == [150, 300]
        assert {r.detection_type for r in got.where("label = 1").collect()} == {"Level Shift"}


def test_hybrid_types(series):
    flat = [*WAVE[:120], *[WAVE[119]] * 60, *WAVE[180:]]
    burst = [v if not 200 <= k < 215 else v + (60 if k % 2 else -60) for k, v in enumerate(flat)]
    got = detectors.hybrid(series({"a": burst}), fixed=(3.5, 1.2, 1.0))
    found = got.where("label = 1").groupBy("detection_type").count().collect()
    kinds = {r.detection_type: r["count"] for r in found}
    assert kinds["Flatline"] == 1 and kinds.get("Volatility", 0) >= 1
    chunked = detectors.hybrid(series({"a": burst}), fixed=(3.5, 1.2, 1.0), chunk=64)
    close(values(got, "score"), values(chunked, "score"))
    assert values(got, "detection_type") == values(chunked, "detection_type")


def test_global_filters(series):
    seven = [10, 12, 100, 11, 13, 200, 14]
    got = detectors.global_zscore_filter(series({"a": seven}), 1.0)
    assert [r.value for r in got.collect()] == [200.0]
    assert detectors.global_zscore_filter(series({"a": [5.0] * 9}), 1.0).count() == 0
    assert [r.value for r in detectors.iqr(series({"a": [*range(20), 500]})).collect()] == [500.0]
    assert detectors.iqr(series({"a": [*range(20), 500]}), approximate=True).count() == 1
    window = detectors.tumbling_zscore(series({"a": [1.0, 2.0, 1.5, 1.2, 40.0, 1.0] * 4}), "6 minutes", 1.9)
    assert {r.value for r in window.collect()} == {40.0} and window.count() == 4


def test_empty(series):
    df = series({"a": [1.0]}).where("idx < 0")
    for got in (S.fill(df), features.rolling(df), detectors.hybrid(df), detectors.mean_shift(df), detectors.rolling_zscore(df)):
        assert got.count() == 0
    with pytest.raises(ValueError):
        S.validate(df)

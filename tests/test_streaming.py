import pytest

from seriesmith.__main__ import main
from seriesmith.operators import features
from seriesmith.operators import series as S
from seriesmith.streaming.rolling import rolling_stream, tumbling_stream


def test_stream_equals_batch(spark, tmp_path):
    schema = "series_id string, timestamp timestamp, value double"
    rows = [("a", f"2024-01-01 00:{k:02d}:00", float(k * k % 17)) for k in range(40)]
    for n, part in enumerate((rows[:15], rows[15:])):
        spark.createDataFrame(part, "series_id string, t string, value double").selectExpr("series_id", "timestamp(t) AS timestamp", "value").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    for name, make in (("points", lambda s: rolling_stream(s, 10, 2.0, 5)), ("windows", tumbling_stream)):
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        query = make(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        query.awaitTermination()
    got = spark.table("points").orderBy("timestamp").collect()
    view = S.to_series(spark.read.schema(schema).parquet(f"{tmp_path}/in/*"), "series_id", "timestamp", "value")
    want = features.rolling(view, 10).orderBy("idx").collect()
    assert len(got) == 40
    for g, w in zip(got, want, strict=True):
        z = abs(g.value - w.rolling_mean) / w.rolling_std if w.rolling_std else 0.0
        assert g.zscore == pytest.approx(z)
    assert spark.table("windows").count() >= 4 and {r.n for r in spark.table("windows").collect()} == {5}


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "in").mkdir()
    lines = [f"2024-01-01 00:{k:02d}:00,{500 if k == 40 else k % 7}" for k in range(60)]
    (tmp_path / "in/load.csv").write_text("\n".join(["timestamp,value", *lines]))
    (tmp_path / "labels.json").write_text('{"load.csv": [["2024-01-01 00:38:00", "2024-01-01 00:42:00"]]}')
    monkeypatch.setattr("seriesmith.__main__.session", lambda cores="*": spark)
    main(["list", f"{tmp_path}/in"])
    main(["info", f"{tmp_path}/in"])
    main(["evaluate", f"{tmp_path}/in", "--algorithm", "rolling_zscore", "--labels", f"{tmp_path}/labels.json", "--output", f"{tmp_path}/out"])
    assert "load" in capsys.readouterr().out
    assert spark.read.csv(f"{tmp_path}/out/points", header=True).count() == 60

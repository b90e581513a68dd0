"""Reading series and labels, and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import number

SCHEMA = "timestamp string, value double"


def _files(spark: SparkSession, root: str) -> list[str]:
    """CSV files in a folder and its subfolders of one level, by Spark's own file systems."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for entry in fs.listStatus(path) if fs.exists(path) else []:
        inner = fs.listStatus(entry.getPath()) if entry.isDirectory() else [entry]
        out += [f.getPath().toString() for f in inner if f.isFile() and f.getPath().getName().endswith(".csv")]
    return out


def catalog(spark: SparkSession, root: str) -> list[str]:
    """Names of the series in a folder: <subfolder>/<stem> or <stem>, sorted."""
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).getName()
    names = []
    for f in _files(spark, root):
        *_, parent, name = f.split("/")
        stem = name.removesuffix(".csv")
        names.append(stem if parent == base else f"{parent}/{stem}")
    return sorted(names)


def resolve(spark: SparkSession, root: str, name: str) -> str:
    """The file of a series: as given, under the folder, or in the first subfolder that has it."""
    fs_of = lambda p: p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    stem = name.removesuffix(".csv")
    for candidate in (name, f"{root}/{stem}.csv"):
        p = path(candidate)
        if candidate.endswith(".csv") and fs_of(p).exists(p):
            return candidate
    found = sorted(f for f in _files(spark, root) if f.rpartition("/")[2] == f"{stem}.csv")
    if not found:
        raise FileNotFoundError(f"no series {name!r} in {root}")
    return found[0]


def read_series(spark: SparkSession, root: str, names: list[str] | None = None) -> DataFrame:
    """series_id, timestamp, value of the named series, or of all, in one scan; columns by header, no schema inference."""
    files = [resolve(spark, root, n) for n in names] if names is not None else _files(spark, root)
    if not files:
        return spark.createDataFrame([], "series_id string, timestamp timestamp_ntz, value double")
    rows = spark.read.csv(files, schema=SCHEMA, header=True, enforceSchema=False)
    path = F.split(F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B"))), "/")
    stem, parent = F.regexp_replace(F.element_at(path, -1), r"\.csv$", ""), F.element_at(path, -2)
    base = root.rstrip("/").rpartition("/")[2]
    name = F.when(parent == base, stem).otherwise(F.concat_ws("/", parent, stem))
    return rows.select(name.alias("series_id"), F.try_to_timestamp("timestamp").cast("timestamp_ntz").alias("timestamp"), number(F.col("value")).alias("value"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """series_id, interval_id, start_ts, end_ts from a JSON object of lists of [start, end]; keys lose .csv."""
    whole = spark.read.text(path, wholetext=True)
    entries = whole.select(F.explode(F.from_json("value", "map<string, array<array<string>>>")).alias("key", "spans"))
    spans = entries.select(F.regexp_replace("key", r"\.csv$", "").alias("series_id"), F.posexplode("spans").alias("interval_id", "span"))
    at = lambda k: F.try_to_timestamp(F.get("span", F.lit(k))).cast("timestamp_ntz")
    return spans.select("series_id", F.col("interval_id").cast("long").alias("interval_id"), at(0).alias("start_ts"), at(1).alias("end_ts"))


def with_labels(series: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Series and the labels that name them.

    A key names the series that is called so. A series without a folder and
    without such a key takes the labels of the first key, in their order, that
    is its name in some folder; a series in a folder takes none of another one.
    """
    names = series.select("series_id").distinct()
    exact = labels.join(names, "series_id", "left_semi")
    bare = names.where(~F.contains("series_id", F.lit("/"))).join(labels, "series_id", "left_anti").withColumnRenamed("series_id", "_name")
    keys = labels.where(F.contains("series_id", F.lit("/"))).select("series_id", F.element_at(F.split("series_id", "/"), -1).alias("_name")).distinct()
    chosen = keys.join(bare, "_name").groupBy("_name").agg(F.min("series_id").alias("series_id"))
    loose = labels.join(chosen, "series_id").drop("series_id").withColumnRenamed("_name", "series_id")
    return series, exact.unionByName(loose.select(*exact.columns))


def write_wide(df: DataFrame, path: str) -> None:
    """One row a point as CSV with a header."""
    df.write.mode("overwrite").csv(path, header=True)


def write_results(long: DataFrame, path: str) -> None:
    """timestamp, value, anomaly_score, label 0: files by algorithm, category (a series' folder, or none) and series."""
    at = F.instr("series_id", "/")
    category = F.when(at > 0, F.col("series_id").substr(F.lit(1), at - 1)).otherwise("none")
    name = F.when(at > 0, F.col("series_id").substr(at + 1, F.length("series_id"))).otherwise(F.col("series_id"))
    columns = ["timestamp", "value", F.col("score").alias("anomaly_score"), F.lit(0).alias("label")]
    long.select("algorithm", category.alias("category"), name.alias("series"), *columns).write.mode("overwrite").partitionBy("algorithm", "category", "series").csv(path, header=True)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def from_pandas(spark: SparkSession, pdf) -> DataFrame:
    return spark.createDataFrame(pdf)


def to_pandas(df: DataFrame):
    """For the edge of a program only: all rows come to the driver."""
    return df.toPandas()

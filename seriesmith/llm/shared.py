"""What the operators share: the shared folder, Arrow text buffers, hashed words and shingles."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a text that may be in a sample to learn from, which is held by the driver.
LEARNT_BYTES = 1 << 20
#: Bytes of text that the vectorised code holds at a time, more only for one longer document.
SLICE_BYTES = 1_000_000

_U = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where none is set and all run on this machine, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='shared-')}")
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Writes df to the shared folder and reads it again, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)  # and shuffle files of this plan are of no more use
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes the files of tables that cut() gave and that nothing will read again."""
    for df in tables:
        where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of an Arrow batch at most: a batch of long texts must fit into a small executor with its working arrays.
BATCH_ROWS = 4096


def trim() -> None:
    """Gives freed memory back to the machine, as a worker lives on for tasks of other operators."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of BATCH_ROWS at most; workers give memory back at the end of a task."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return df.mapInArrow(tidy, schema)


#: Keys of so large a share of a table's rows, one in so many, are told to all tasks: no more keys than this.
HOT = 1000


def join_to_one(many: DataFrame, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """many joined to `one`, which has a row a key with its number of rows in many, times; times is left out.

    A key that a thousandth of all rows share is hot. There are a thousand hot
    keys at most; they are told to all tasks, so that their rows stay where they
    are. one must come from files, as it is read several times.
    """
    total = one.agg(F.sum("times")).first()[0] or 0
    hot = F.broadcast(one.where(F.col("times") * HOT >= total))
    few = many.join(hot, key)
    rest = many.join(hot.select(key), key, "left_anti").join(one.where(F.col("times") * HOT < total), key, how)
    return few.unionByName(rest).drop("times")


def named(column: str):
    """The column of exactly that name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def crc_mod(column: str, modulus: int):
    """crc32 of the column as text, modulo modulus; a null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_null(column.type) else pa.nulls(len(column), pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), offsets


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Ranges of rows of at most so many bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_rng = np.random.default_rng(20240517)
_LUT = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LUT[65:91] = _LUT[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LUT[_SPACE] = 0
_BASE = 0x9E3779B97F4A7C15
_FACTORS = (_rng.integers(1, 2**63, 16, dtype=np.uint64) * _U(2)) | _U(1)
_SHORT = np.arange(16, dtype=np.uint64) * _FACTORS[15]
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[key] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, and each row's first word (n + 1 places).

    A word's hash is a polynomial over random byte values: two different words
    of one corpus agree with probability about 2**-64.
    """
    lo = int(offsets[0])
    data, offsets = data[lo : int(offsets[-1])], np.asarray(offsets, np.int64) - lo
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[offsets[offsets < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[offsets[offsets > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = _power(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LUT[data] * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Each row's sorted set of n-word shingle hashes; with fewer words the whole sequence as one; empty without words."""
    w, at = words(data, offsets)
    count = len(w) - n + 1
    if count > 0:
        grams = np.zeros(count, np.uint64)
        for k in range(n):
            grams += w[k : k + count] * _FACTORS[k]
        grams = mix(grams)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= n:
            g = np.sort(grams[a : b - n + 1])
            keep = np.empty(len(g), bool)
            keep[0] = True
            np.not_equal(g[1:], g[:-1], out=keep[1:])
            out.append(g[keep])
        elif b > a:
            out.append(mix((w[a:b] * _FACTORS[: b - a]).sum(keepdims=True, dtype=np.uint64) + _SHORT[b - a]))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def digest(s: np.ndarray) -> int:
    """A signed 64-bit name of a set of hashes, by content."""
    if not len(s):
        return 0
    h = int(mix(s + _FACTORS[14]).sum(dtype=np.uint64)) ^ (len(s) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    h = int(mix(np.array([h], np.uint64))[0])
    return h - (1 << 64) if h >> 63 else h


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large and small stars: (node, label), label the smallest node reachable.

    Every round is two aggregations and two joins over the edges, without a
    driver-side structure; it stops when the edges no longer change, after a
    number of rounds that grows with the square of the logarithm of the nodes at
    most. Only nodes of the edges are returned. A node of very many edges is
    split by Spark's handling of skewed joins, as each side but one has a row a node.
    """
    e = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    seen = now = None
    while seen is None or now != seen:
        seen = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        e, done = cut(small, "edges"), e
        drop(done)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))

"""Exact top-k search by vector-approximation files.

The approximation file is written once: of every vector its cells, one byte a
component with a scale of its own, beside the exact numbers. A search scans the
cells: one product of small numbers bounds the inner product on both sides.
Exact vectors are taken out of the file only for what can still be among the k
best, in the order of falling upper bounds, until the k-th best score is
certain. Queries come in blocks of a bounded size, which are sent to all tasks
one after the other.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Cells on either side of zero; components in a block of queries; rows and queries that are compared at once; exact vectors read at a time.
CELLS, BLOCK, ROWS, STEP, READ = 127, 1 << 21, 4096, 512, 16
#: Components from here on are not approximated; their vectors are read in every search.
LARGE = float(1 << 40)
_MOST = (1 << 63) - 1


def approximate(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of vectors that stand one after the other, and each vector's width of a cell, infinite for a vector with a large component."""
    top = np.maximum.reduceat(np.abs(values), offsets[:-1])
    width = np.where(top > 0, top / CELLS, 1.0)
    cells = np.rint(values / np.repeat(width, np.diff(offsets))).astype(np.int8)
    return cells, np.where(top < LARGE, width, np.inf)


def bounds(cells: np.ndarray, width: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of every query's inner product with every vector of finite width: no component is farther than half a cell from its cell's middle."""
    length = np.abs(queries).sum(1)
    kind = np.float32 if length.max(initial=0) * CELLS < 1 << 24 else np.float64  # whole numbers up to there are exact
    middle = (queries.astype(kind) @ cells.T.astype(kind)) * width
    reach = length[:, None] * (width * (0.5 + 1e-6))
    return middle - reach, middle + reach


class Best:
    """The k best (score, id) of each query so far, smaller ids first among equal scores; `reads` counts exact vectors."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k, self.reads = ids, queries, k, 0
        self.top = np.abs(queries).max(1, initial=0)
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]
        self.kth = np.full(len(ids), -np.inf)

    def _offer(self, q: int, x: np.ndarray, names: np.ndarray) -> None:
        self.reads += len(x)
        if np.abs(x).max(initial=0) * self.top[q] * x.shape[1] < 1 << 51:
            scores = (x @ self.queries[q]).astype(np.int64).tolist()
        else:  # beyond what doubles hold exactly
            scores = [max(-_MOST, min(_MOST, sum(int(a) * int(b) for a, b in zip(v, self.queries[q], strict=True)))) for v in x]
        self.found[q] = sorted([*self.found[q], *zip((-s for s in scores), names.tolist(), strict=True)])[: self.k]
        if len(self.found[q]) == self.k and abs(self.found[q][-1][0]) < 1 << 53:
            self.kth[q] = -self.found[q][-1][0]

    def scan(self, names: np.ndarray, width: np.ndarray, cells: np.ndarray, exact) -> None:
        """exact: from an array of rows to their exact vectors."""
        wide = ~np.isfinite(width)
        width = np.where(wide, 0.0, width)
        for a in range(0, len(self.ids), STEP):
            low, high = bounds(cells, width, np.where(self.top[a : a + STEP, None] < LARGE, self.queries[a : a + STEP], 0.0))
            unknown = wide[None, :] | (self.top[a : a + STEP, None] >= LARGE)
            if unknown.any():
                low[unknown], high[unknown] = -np.inf, np.inf
            same = self.ids[a : a + STEP, None] == names[None, :]
            low[same] = high[same] = -np.inf
            least = self.kth[a : a + STEP].copy()
            new = np.flatnonzero(least == -np.inf)
            if len(new) and len(names) > self.k:
                least[new] = np.partition(low[new], len(names) - self.k, 1)[:, len(names) - self.k]
            for r in np.flatnonzero(high.max(1) >= least).tolist():
                left = np.flatnonzero((high[r] >= least[r]) & ~same[r])
                left = left[np.argsort(-high[r][left], kind="stable")]
                for at in range(0, len(left), READ):
                    part = left[at : at + READ]
                    if high[r][part[0]] < self.kth[a + r]:
                        break
                    self._offer(a + r, exact(part), names[part])


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


_FILE = "vec_id long, size int, width double, cells binary, exact binary"


def _write(batches):
    """Rows of the approximation file; exact numbers are floor(256 * x) as doubles."""
    for batch in batches:
        column = batch.column("vector")
        values = np.floor(256 * np.asarray(column.flatten(), np.float64))
        at = np.r_[0, np.cumsum(np.asarray(column.value_lengths()))].astype(np.int64)
        for i, j in shared.slices(at, 1 << 22):
            part, offsets = values[at[i] : at[j]], at[i : j + 1] - at[i]
            cells, width = approximate(part, offsets)
            columns = [batch.column("vec_id").slice(i, j - i), pa.array(np.diff(offsets).astype(np.int32)), pa.array(width), _binary(cells, offsets), _binary(part, offsets * 8)]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _FILE.split(", ")])


def _read(column: pa.Array, rows: np.ndarray, kind) -> np.ndarray:
    """Binary values of equal length, of these rows only, as the rows of a matrix."""
    return np.stack([np.frombuffer(column[int(k)].as_buffer(), kind) for k in rows])


def _read_all(column: pa.Array, kind) -> np.ndarray:
    _, offsets, data = column.buffers()
    first, last = np.frombuffer(offsets, np.int32)[[column.offset, column.offset + len(column)]]
    return np.frombuffer(data, np.uint8)[first:last].view(kind).reshape(len(column), -1)


def _search(batch, best: dict[int, Best]) -> None:
    sizes = np.asarray(batch.column("size"))
    for n in np.unique(sizes).tolist():
        if n in best:
            rows = np.flatnonzero(sizes == n)
            exact, cells = batch.column("exact"), batch.column("cells")
            cells = _read_all(cells, np.int8) if len(rows) == len(cells) else _read(cells, rows, np.int8)
            best[n].scan(np.asarray(batch.column("vec_id"))[rows], np.asarray(batch.column("width"))[rows], cells, lambda part, rows=rows, exact=exact: _read(exact, rows[part], np.float64))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k highest integer inner products of each query, a row whose id is divisible by `every`, with all rows but those of its id.

    Returns query_id, rank, vec_id, score; ties go to the smaller vec_id. Rows
    without an id, and vectors null, empty or holding a null or non-finite
    component, or one too large to multiply by 256, take no part; vectors of another length than the query's are no
    candidates of it. Repeated rows are candidates of their own; ids that repeat
    are one query, of the smallest of their vectors. Scores beyond 64 bits are the nearest number of 64 bits.
    Other columns are not read; an empty table gives none.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where("vec_id is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity') and abs(256 * x) < double('infinity'))")
    file = shared.cut(shared.map_batches(rows, _write, _FILE), "vafile")
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    schema = "query_id long, vec_id long, score long"

    def search(block: list) -> DataFrame:
        held = spark.sparkContext.broadcast([(np.array([r["vec_id"] for r in part], np.int64), np.floor(256 * np.array([r["vector"] for r in part], np.float64))) for part in block])

        def run(batches):
            best = {q.shape[1]: Best(ids, q, k) for ids, q in held.value}
            for batch in batches:
                for lo in range(0, batch.num_rows, ROWS):
                    _search(batch.slice(lo, ROWS), best)
            found = [(int(q), i, -s) for b in best.values() for q, have in zip(b.ids, b.found, strict=True) for s, i in have]
            columns = list(zip(*found, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

        return shared.map_batches(file, run, schema)

    out, block, held = [], {}, 0
    for r in itertools.chain(queries.toLocalIterator(prefetchPartitions=True), [None]):
        if r is not None:
            block.setdefault(len(r["vector"]), []).append(r)
            held += len(r["vector"])
        if block and (r is None or held >= BLOCK):
            part = search(list(block.values()))
            out.append(part if r is None and not out else shared.cut(part, "top"))
            block, held = {}, 0
    if not out:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

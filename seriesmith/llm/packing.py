"""Token pieces and vector best-fit packing."""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, shared

CAPACITY = 2048
#: Pieces that are packed together; every group leaves one sequence partly empty at most.
GROUP = 4096
#: Documents of a sequence, and weights of the three residuals, in the registered query and the pipeline.
DOCUMENTS, WEIGHTS = 64, (1.0, 1.0, 1.0)


def added_tokens(tokenizer: str) -> tuple[tuple[str, int], ...]:
    """Contents and ids of a tokenizer file's added tokens, which it matches in a text as they stand."""
    with open(tokenizer, encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    if any(t[k] for t in found for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("an added token that takes in what stands around it")
    return tuple((t["content"], t["id"]) for t in found)


@lru_cache(maxsize=2)
def _encoding(ranks: str, pattern: str, added: tuple[tuple[str, int], ...]) -> tiktoken.Encoding:
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens=dict(added))


#: White space of a length at which the library's pattern engine may run out of stack.
_LONG_RUN = re.compile(r"\s{4096}")


def token_ids(text: str, ranks: str, pattern: str, added: tuple[tuple[str, int], ...] = ()) -> np.ndarray:
    """Ids of a whole text; one with very long runs of white space goes through the encoder of this package, which has no stack to run out of."""
    if not _LONG_RUN.search(text):
        return np.asarray(_encoding(ranks, pattern, added).encode_to_numpy(text, allowed_special="all", disallowed_special=()), "<u4")
    names, plain = dict(added), bpe.load(ranks, pattern)
    parts = re.split("(" + "|".join(map(re.escape, names)) + ")", text) if names else [text]
    return np.array([i for part in parts for i in ([names[part]] if part in names else plain.encode(part))], "<u4")


def cut_lengths(total: int, most: int) -> list[int]:
    """Lengths of a document's pieces: only the first may be shorter than most."""
    first = total % most
    return [first] * (first > 0) + [most] * (total // most)


def token_pieces(docs: DataFrame, ranks: str, pattern: str, end_id: int = 0, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id", added: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """(doc_id, piece, start, length, ids): each whole text's token ids and end_id, as little-endian unsigned 32-bit numbers, cut where there are more than capacity.

    Added tokens, (content, id), are one id each wherever they stand in a text.
    A null or empty text is end_id alone. Rows are independent; other columns
    are not read; an empty table gives none.
    """

    def run(batches):
        tail = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = []
                for name, t in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                    ids = token_ids(t.as_py() or "", ranks, pattern, added).tobytes() + tail
                    start = 0
                    for piece, n in enumerate(cut_lengths(len(ids) // 4, capacity)):
                        rows.append((name, piece, start, n, ids[4 * start : 4 * (start + n)]))
                        start += n
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids"])

    return shared.map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), run, "doc_id long, piece int, start long, length long, ids binary")


def best_fit(lengths: np.ndarray, limits: tuple[float, float, float], weights: tuple[float, float, float], rule: str = "norm") -> tuple[np.ndarray, np.ndarray, int]:
    """Vector best fit, longest first: (bin, offset in the bin) of each length, and the number of bins.

    A piece needs (tokens, one document, attention cost length squared). Of the
    bins that hold it under all three limits, "norm" takes the one with the
    least weighted norm of what remains, "dot" the one with the largest weighted
    dot product of need and residual; ties go to the oldest bin.
    """
    limit = np.array(limits, float)
    scale = np.array(weights, float) / limit**2
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room = np.empty((max(16, len(lengths)), 3))
    name = np.empty(len(room), np.int64)
    open_, made = 0, 0
    order = np.argsort(-lengths, kind="stable")
    least = np.minimum.accumulate(lengths[order][::-1])[::-1] if len(lengths) else lengths
    for step, k in enumerate(order.tolist()):
        n = int(lengths[k])
        need = np.array([n, 1, float(n) * n])
        left = room[:open_] - need
        fits = np.flatnonzero((left >= 0).all(1))
        if len(fits):
            score = (left[fits] ** 2 @ scale) if rule == "norm" else -(room[fits] * need @ scale)
            at = int(fits[score.argmin()])
            offsets[k] = limits[0] - room[at, 0]
            room[at] = left[at]
        else:
            at = open_
            room[at], name[at] = limit - need, made
            if (room[at] < 0).any():
                raise ValueError("a piece is larger than a sequence")
            open_, made = open_ + 1, made + 1
        bins[k] = name[at]
        if step % 64 == 63 and step + 1 < len(order):
            # no later piece is shorter than the shortest, so fuller bins are done
            low = least[-1]
            live = (room[:open_, 0] >= low) & (room[:open_, 1] >= 1) & (room[:open_, 2] >= float(low) * low)
            if not live.all():
                count = int(live.sum())
                room[:count], name[:count], open_ = room[:open_][live], name[:open_][live], count
    return bins, offsets, made


def pack(pieces: DataFrame, capacity: int = CAPACITY, documents: int = DOCUMENTS, attention: float = float(CAPACITY) ** 2, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> DataFrame:
    """Adds sequence_id and offset to pieces, which need length and keep their other columns; columns that have these two names are replaced.

    Every sequence obeys the three limits: tokens, documents and the summed
    square of lengths. Pieces are dealt evenly by a hash into groups of about
    GROUP, whatever their source or length, and each group is packed by itself.
    Repeated pieces are pieces of their own; an empty table gives none; a piece
    longer than a limit allows, or of null length, is an error.
    """
    pieces = shared.cut(pieces.drop("sequence_id", "offset"), "pieces")
    groups = max(1, -(-pieces.count() // GROUP))
    names = {f"c{k}": c for k, c in enumerate(pieces.columns)}  # columns may have any name
    by = [k for k, c in names.items() if c != "ids"]
    plain = pieces.select(*(shared.named(c).alias(k) for k, c in names.items()))
    dealt = plain.withColumn("group", F.pmod(F.xxhash64(*by, F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    length = next(k for k, c in names.items() if c == "length")
    limits = (float(capacity), float(documents), float(attention))

    def run(key, table):
        shared.trim()
        bins, offsets, _ = best_fit(np.asarray(table.column(length).combine_chunks()), limits, weights, rule)
        table = table.drop_columns(["group"])
        return table.append_column("sequence_id", pa.array(bins + (key[0].as_py() << 32))).append_column("offset", pa.array(offsets))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema) + ", sequence_id long, offset long"
    packed = dealt.groupBy("group").applyInArrow(run, schema)
    return packed.select(*(F.col(k).alias(c) for k, c in names.items()), "sequence_id", "offset")

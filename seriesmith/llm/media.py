"""PNG columns: writing and reading images with zlib and numpy, and low-frequency cosine hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: The signature with which every PNG file begins (fixed by the format).
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples a pixel by colour type (fixed by the format).
SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}
#: A payload's row: 64 pixels of three samples.
ROW, WIDTH = 192, 64


class PngError(ValueError):
    pass


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(pixels: np.ndarray, level: int = 3) -> bytes:
    """A (height, width, samples) array of bytes as PNG; each row by the filter of None, Sub and Up with the smallest sum of differences."""
    height, width, samples = pixels.shape
    colour = {v: k for k, v in SAMPLES.items()}[samples]
    raw = pixels.reshape(height, width * samples)
    left = raw.copy()
    left[:, samples:] -= raw[:, :-samples]
    above = raw.copy()
    above[1:] -= raw[:-1]
    options = (raw, left, above)
    cost = np.stack([np.abs(x.view(np.int8).astype(np.int16)).sum(1, dtype=np.int64) for x in options])
    kind = cost.argmin(0).astype(np.uint8)
    rows = np.empty((height, width * samples + 1), np.uint8)
    rows[:, 0] = kind
    for k, x in enumerate(options):
        rows[kind == k, 1:] = x[kind == k]
    header = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(rows: np.ndarray, samples: int) -> np.ndarray:
    """Undoes the row filters: whole runs of rows at once where rows do not depend on each other pixel by pixel."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    height, width = out.shape
    if height and kinds.max() > 4:
        raise PngError("an unknown row filter")
    runs = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]]) if height else []
    zero = np.zeros(width, np.uint8)
    for start, stop in zip(runs, np.r_[runs[1:], height] if height else [], strict=True):
        kind, part = kinds[start], out[start:stop]
        if kind == 1:
            shaped = part.reshape(stop - start, width // samples, samples)
            np.cumsum(shaped, axis=1, dtype=np.uint8, out=shaped)
        elif kind == 2:
            if start:
                part[0] += out[start - 1]
            np.cumsum(part, axis=0, dtype=np.uint8, out=part)
        elif kind >= 3:
            for y in range(start, stop):
                above = (out[y - 1] if y else zero).astype(np.int16).reshape(-1, samples)
                row, left, corner = out[y].reshape(-1, samples), np.zeros(samples, np.int16), np.zeros(samples, np.int16)
                for x in range(len(row)):
                    if kind == 3:
                        guess = (left + above[x]) >> 1
                    else:
                        p = left + above[x] - corner
                        a, b, c = abs(p - left), abs(p - above[x]), abs(p - corner)
                        guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, above[x], corner))
                        corner = above[x]
                    left = (row[x] + guess) & 255
                    row[x] = left
    return out


def read_png(data: bytes) -> np.ndarray:
    """The (height, width, samples) bytes of an 8-bit PNG that is not interlaced; raises PngError on a wrong checksum, order or length."""
    if data[:8] != SIGNATURE:
        raise PngError("no PNG signature")
    at, header, body, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise PngError("a chunk is cut off")
        (length,) = struct.unpack_from(">I", data, at)
        kind, chunk = data[at + 4 : at + 8], data[at + 8 : at + 8 + length]
        check = data[at + 8 + length : at + 12 + length]
        if len(check) < 4 or struct.unpack(">I", check)[0] != zlib.crc32(kind + chunk):
            raise PngError(f"the checksum of {kind!r} is wrong")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body.append(chunk)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise PngError(f"an unknown critical chunk {kind!r}")
        at += 12 + length
    if header is None or not ended:
        raise PngError("IHDR or IEND is missing")
    width, height, depth, colour, method, filters, interlaced = header
    if depth != 8 or colour not in SAMPLES or method or filters or interlaced:
        raise PngError("only 8-bit images without palette or interlacing are read")
    samples = SAMPLES[colour]
    try:
        raw = zlib.decompress(b"".join(body))
    except zlib.error as e:
        raise PngError(str(e)) from e
    if len(raw) != height * (width * samples + 1):
        raise PngError("the image data have a wrong length")
    return _unfilter(np.frombuffer(raw, np.uint8).reshape(height, width * samples + 1), samples).reshape(height, width, samples)


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi / n * (np.arange(n) + 0.5)[None, :] * np.arange(k)[:, None])


_SIDE, _LOW = 32, 8
_DCT = _cosines(_SIDE, _LOW)


def cosine_hash(pixels: np.ndarray) -> str:
    """64 bits as 16 hex digits: the 8 x 8 lowest cosine coefficients of the grey image, scaled to 32 x 32 by means, against their median without the constant one."""
    grey = pixels.mean(2)
    for axis in (0, 1):
        n = grey.shape[axis]
        if n >= _SIDE:
            edges = np.arange(_SIDE) * n // _SIDE
            sums = np.add.reduceat(grey, edges, axis=axis)
            count = np.diff(np.r_[edges, n])
            grey = sums / (count[:, None] if axis == 0 else count[None, :])
        else:
            grey = np.take(grey, np.arange(_SIDE) * n // _SIDE, axis=axis)
    low = (_DCT @ grey @ _DCT.T).round(6).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and the text with spaces up to a positive multiple of a row."""
    raw = (text or "").encode()
    return len(raw), raw + b" " * (-len(raw) % ROW or (0 if raw else ROW))


def text_images(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, image): each whole text as a lossless RGB PNG of 64 pixels a row in a binary column; a null text counts as empty and is one row of spaces."""

    def run(batches):
        for batch in batches:
            n, images = [], []
            for t in batch.column("text"):
                size, payload = payload_of(t.as_py())
                n.append(size)
                images.append(write_png(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 3)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(images, pa.binary())], ["doc_id", "n_bytes", "image"])

    return shared.map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), run, "doc_id long, n_bytes long, image binary")


def image_features(images: DataFrame) -> DataFrame:
    """Reads each PNG again, with every checksum tested, and returns its payload's digests and cosine hash beside doc_id and n_bytes.

    Equal images give equal values, repeated rows repeated results, an empty
    table none. A damaged image fails the query.
    """

    def run(batches):
        for batch in batches:
            out = []
            for data in batch.column("image"):
                data = data.as_py()
                pixels = read_png(data)
                payload = pixels.tobytes()
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(pixels)))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", *names])

    return shared.map_batches(images, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

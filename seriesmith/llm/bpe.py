"""Byte-level BPE by prefix dynamic programming.

Every prefix of a piece of text has one BPE encoding, and that encoding has one
last token. Storing the last token of each prefix is enough: walking back from
the end gives the whole encoding, appending needs only the new prefixes, and
after an edit the old values hold again as soon as as many of them in a row
agree as the longest token has bytes. A token can be the last one of a prefix
if BPE leaves it and the token before it as they are, and this is a property of
the two tokens alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Entries of the cache of encoded pieces, of which two generations are kept, and of checked token pairs.
PIECES, PAIRS = 120_000, 600_000
#: Rows whose texts are split together.
ROWS = 1024
_NONE = 1 << 60


def _ranges(pattern: str) -> str:
    """What of the basic plane matches, as ranges of a character class."""
    found, out = [c for c in range(1 << 16) if not 0xD800 <= c < 0xE000 and regex.match(pattern, chr(c))], []
    for c in found:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in out)


class Splitter:
    """findall of a pattern of \\p{L}, \\p{N}, \\s and \\S; texts of the basic plane go through plain character classes, which are faster."""

    def __init__(self, pattern: str):
        self.general = regex.compile(pattern)
        plain = pattern
        for name, of in ((r"\p{L}", r"\p{L}"), (r"\p{N}", r"\p{N}"), (r"\s", r"\s")):
            ranges = _ranges(of)
            inside = re.sub(r"(\[[^\]]*)" + re.escape(name), lambda m, r=ranges: m[1] + r, plain)
            plain = inside.replace(name, f"[{ranges}]")
            if name == r"\s":
                plain = plain.replace(r"\S", f"[^{ranges}]")
        try:
            self.plain = re.compile(plain)
        except re.error:
            self.plain = None

    def findall(self, text: str) -> list[str]:
        if self.plain and (text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text)):
            return self.plain.findall(text)
        return self.general.findall(text)


class PrefixBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, Splitter(pattern)
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks))
        self._pairs: dict[int, bool] = {}
        self._alone: dict[int, bool] = {}

    def merge(self, piece: bytes) -> list[int]:
        """BPE by its definition: again and again the leftmost pair of lowest rank; for short pieces."""
        rank = self.ranks.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [rank(a + b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (least := min(pairs)) < _NONE:
            at = pairs.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], _NONE)
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], _NONE)
        return [self.ranks[p] for p in parts]

    def fits(self, before: int, token: int) -> bool:
        """Whether BPE leaves these two neighbours as they are."""
        key = before << 20 | token
        if (known := self._pairs.get(key)) is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self.merge(self.bytes_of[before] + self.bytes_of[token]) == [before, token]
        return known

    def _reachable(self, token: int) -> bool:
        if (known := self._alone.get(token)) is None:
            known = self._alone[token] = self.merge(self.bytes_of[token]) == [token]
        return known

    def prefixes(self, piece: bytes, last: list[int] | None = None, end: int | None = None) -> list[int]:
        """The last token of every prefix up to end (last[0] is unused); goes on from those in last."""
        last = [-1] if last is None else last
        rank, known, longest = self.ranks.get, self._pairs.get, self.longest
        for stop in range(len(last), (len(piece) if end is None else end) + 1):
            # only one candidate is valid, and short ones are the most likely
            for start in range(stop - 1, max(-1, stop - longest - 1), -1):
                token = rank(piece[start:stop])
                if token is None:
                    continue
                if start:
                    fits = known(last[start] << 20 | token)
                    if fits or fits is None and self.fits(last[start], token):
                        break
                elif self._reachable(token):
                    break
            else:
                raise ValueError("no token for a byte")
            last.append(token)
        return last

    def tokens(self, last: list[int]) -> list[int]:
        out, end = [], len(last) - 1
        while end > 0:
            out.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return out[::-1]

    def edited(self, old: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """The piece and its table after old[start:end] became new; recomputes only near the edit."""
        piece = old[:start] + new + old[end:]
        out, shift, same = last[: start + 1], len(new) - (end - start), 0
        for stop in range(start + 1, len(piece) + 1):
            if same >= self.longest:
                return piece, out + last[stop - shift :]
            self.prefixes(piece, out, stop)
            same = same + 1 if stop - shift > end and out[-1] == last[stop - shift] else 0
        return piece, out

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.tokens(self.prefixes(piece))

    def encode(self, text: str) -> list[int]:
        """As the rank file's library does without special tokens: each match of the pattern by itself."""
        return [t for piece in self.pattern.findall(text) for t in self.encode_piece(piece.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> PrefixBPE:
    return PrefixBPE(read_ranks(path), pattern)


class Texts:
    """Whole texts through a bounded cache of pieces: number of ids, ids as text, and the decoded bytes.

    New pieces are encoded in sorted order, so that the table of a prefix that
    two of them share is computed once and only appended to.
    """

    def __init__(self, bpe: PrefixBPE):
        self.bpe, self.cache, self.old = bpe, {}, {}

    def _learn(self, pieces) -> None:
        if len(self.cache) >= PIECES:
            self.cache, self.old = {}, self.cache
        bpe, cache, old = self.bpe, self.cache, self.old
        before, last = b"", [-1]
        for piece in sorted(p for p in pieces if p not in cache):
            if (entry := old.get(piece)) is None:
                raw = piece.encode()
                whole = bpe.ranks.get(raw)
                if whole is None:
                    same, most = 0, min(len(raw), len(before))
                    while same < most and raw[same] == before[same]:
                        same += 1
                    before, last = raw, bpe.prefixes(raw, last[: same + 1])
                    ids = bpe.tokens(last)
                else:
                    ids = [whole]
                entry = (",".join(map(str, ids)), bpe.decode(ids), len(ids))
            cache[piece] = entry

    def __call__(self, texts: list[str]):
        split = [self.bpe.pattern.findall(t) for t in texts]
        self._learn(set().union(*split))
        get = self.cache.__getitem__
        for pieces in split:
            if pieces:
                ids, decoded, n = zip(*map(get, pieces), strict=True)
                yield sum(n), ",".join(ids), b"".join(decoded)
            else:
                yield 0, "", b""


@lru_cache(maxsize=2)
def texts_of(path: str, pattern: str) -> Texts:
    return Texts(load(path, pattern))


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids): the token ids of each whole text; a null or empty text has none. ranks: a rank file that every machine has."""

    def run(batches):
        bpe = load(ranks, pattern)
        for batch in batches:
            ids = [bpe.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return shared.map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, bytes): the inverse of encode()."""

    def run(batches):
        bpe = load(ranks, pattern)
        for batch in batches:
            out = [bpe.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return shared.map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, bytes binary")


def digests(docs: DataFrame, ranks: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Encodes each whole text, decodes the ids, and returns (doc_id, n_tokens, ids_sha256, decoded_sha256).

    A null text counts as empty: no tokens and the digests of nothing. Rows are
    independent, so repeated rows give repeated results; other columns are not
    read; an empty table gives none.
    """

    def run(batches):
        texts = texts_of(ranks, pattern)
        for batch in batches:
            n, ids, decoded = [], [], []
            for lo in range(0, batch.num_rows, ROWS):
                for count, joined, raw in texts([t or "" for t in batch.column("text").slice(lo, ROWS).to_pylist()]):
                    n.append(count)
                    ids.append(hashlib.sha256(joined.encode()).hexdigest())
                    decoded.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return shared.map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

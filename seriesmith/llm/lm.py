"""N-gram scoring with an Elias-Fano trie in parts.

All pairs and triples that occur LEAST times in the training texts are kept,
whatever the size of the corpus. No table of them, or of words, is ever held
whole: n-grams are dealt out by a hash of their first two words, and words by
their own, into parts of which there are more as the input grows. Each group of
documents asks every part for what it holds; a part counts what all groups
sent, builds its level of the trie and answers in the order of the request.

1. Groups ask for their pairs. A part keeps those that occur often enough and
   gives each its place in the second level.
2. A triple can be kept only if both its pairs are. Groups ask for the triples
   that are left, each as the place of its first pair and, for its last word,
   the place of its second pair, that is, a number relative to the word before;
   and for their words, with what was kept of the pairs that a word begins.
3. With these answers a group scores its texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Training occurrences of a kept pair or triple, at any size of the corpus.
LEAST = 2
DISCOUNT = 0.75
#: Documents that are scored together: so many rows of the input, one after the other; one of more bytes is scored by itself.
GROUP, LONG = 2048, 1 << 16
#: Bytes of text to a part of the trie, and to a task that reads groups or parts, where that gives more tasks than the session's number.
PART_BYTES, TASK_BYTES = 2_500_000, 1 << 26


def _pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Values of `width` bits one after the other, in 64-bit words and one to spare."""
    if not width:
        return np.zeros(1, np.uint64)
    bits = (values[:, None] >> np.arange(width, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).ravel()
    raw = np.packbits(bits, bitorder="little").tobytes()
    return np.frombuffer(raw + b"\0" * (-len(raw) % 8 + 8), np.uint64)


_SELECT = np.array([[next((k for k in range(8) if bin(b & ((2 << k) - 1)).count("1") == r + 1), 0) for r in range(8)] for b in range(256)], np.uint8)
_COUNT = np.array([bin(b).count("1") for b in range(256)], np.uint8)


class EliasFano:
    """A sequence of numbers that never falls: low bits packed, high bits in unary, numbers read by position."""

    def __init__(self, low: np.ndarray, high: np.ndarray, before: np.ndarray, width: int, n: int):
        self.low, self.high, self.before, self.width, self.n = low, high, before, width, n

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        low = _pack_bits(values.astype(np.uint64) & np.uint64((1 << width) - 1), width)
        bits = np.zeros((top >> width) + n + 1, np.uint8)
        bits[(values >> width).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little")
        return cls(low, high, np.r_[0, np.cumsum(_COUNT[high], dtype=np.int64)].astype(np.uint32), width, n)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        at = np.asarray(at, np.int64)
        byte = np.searchsorted(self.before, at, "right") - 1
        bit = byte * 8 + _SELECT[self.high[byte], at - self.before[byte]]
        value = (bit - at) << self.width
        if self.width:
            first = at * self.width
            word, shift = first >> 6, (first & 63).astype(np.uint64)
            wide = self.low[word] >> shift
            wide |= np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
            value |= (wide & np.uint64((1 << self.width) - 1)).astype(np.int64)
        return value

    def below(self, high: np.ndarray) -> np.ndarray:
        """How many numbers have high bits less than these: the place of the high-th zero, without the zeros."""
        zeros = np.arange(len(self.before), dtype=np.int64) * 8 - self.before
        at = high - 1
        byte = np.minimum(np.searchsorted(zeros, at, "right") - 1, len(self.high) - 1)
        bit = byte * 8 + _SELECT[255 - self.high[byte], np.clip(at - zeros[byte], 0, 7)]
        return np.where(high <= 0, 0, np.minimum(bit - at, self.n))

    def find(self, target: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Place of each target in [lo, hi), or -1: by its high bits, then by binary search among the few numbers that share them."""
        high = target >> self.width
        last = int(self[np.array([self.n - 1])][0]) >> self.width
        inside = high <= last
        high = np.minimum(high, last)
        lo = np.maximum(lo, self.below(high))
        hi = np.where(inside, np.minimum(hi, np.where(high < last, self.below(np.minimum(high + 1, last)), self.n)), lo)
        end, left = hi.copy(), np.flatnonzero(lo < hi)
        lo, hi = lo.copy(), hi.copy()
        while len(left):
            mid = (lo[left] + hi[left]) >> 1
            less = self[mid] < target[left]
            lo[left[less]], hi[left[~less]] = mid[less] + 1, mid[~less]
            left = left[lo[left] < hi[left]]
        out = np.full(len(target), -1, np.int64)
        at = np.flatnonzero(lo < end)
        out[at] = np.where(self[lo[at]] == target[at], lo[at], -1)
        return out


class Level:
    """One level of a trie.

    A parent's successors stand in [pointers[i], pointers[i + 1]). Their numbers
    rise within a parent, and each parent's begin where those of the one before
    ended, so that they are one sequence that never falls and no longer than it
    must be; where a parent begins is read from the number before its range.
    """

    def __init__(self, parents: int, span: int, keys: np.ndarray, counts: np.ndarray):
        """keys: sorted parent * span + number of the word."""
        parent, number = keys // max(span, 1), keys % max(span, 1)
        self.pointers = EliasFano.of(np.r_[0, np.cumsum(np.bincount(parent, minlength=parents))])
        last = np.flatnonzero(np.r_[parent[1:] != parent[:-1], True]) if len(keys) else np.empty(0, np.int64)
        begins = np.r_[0, np.cumsum(number[last] + 1)]
        self.successors = EliasFano.of(np.repeat(begins[: len(last)], np.diff(np.r_[-1, last])) + number)
        self.counts = counts

    def find(self, parent: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Place of each parent's successor of that number, or -1; so too for a parent or number of -1."""
        out = np.full(len(parent), -1, np.int64)
        ok = np.flatnonzero((parent >= 0) & (number >= 0))
        if self.successors.n and len(ok):
            lo, hi = self.pointers[parent[ok]], self.pointers[parent[ok] + 1]
            begins = np.where(lo > 0, self.successors[np.maximum(lo - 1, 0)] + 1, 0)
            out[ok] = self.successors.find(begins + number[ok], lo, hi)
        return out


def _at(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """values[at], 0 where at is -1."""
    return np.where(at >= 0, values[np.maximum(at, 0)], 0) if len(values) else np.zeros(len(at), np.int64)


def _among(table: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted value in a sorted table, or -1."""
    if not len(table):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return np.where(table[at] == wanted, at, -1)


_END, _START = (int(shared.mix(np.array([x], np.uint64))[0]) for x in (0x454E44, 0x5354415254))
_LOW = np.uint64(0xFFFFFFFF)


def _tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's words and its end, and each row's first place."""
    data, offsets = shared.utf8(column)
    parts, counts = [], []
    for i, j in shared.slices(offsets):
        w, at = shared.words(data, offsets[i : j + 1])
        parts.append(np.insert(w, at[1:], np.uint64(_END)))
        counts.append(np.diff(at) + 1)
    return np.concatenate([*parts, np.empty(0, np.uint64)]), np.r_[0, np.cumsum(np.concatenate([*counts, np.empty(0, np.int64)]))].astype(np.int64)


def _pack(*columns: tuple[np.ndarray, int]) -> bytes:
    """Numbers of so many bytes, each column in planes of equal bytes' places, which compress well."""
    out = [np.array([len(columns), *(len(x) for x, _ in columns)], "<u4").tobytes()]
    for x, width in columns:
        wide = np.ascontiguousarray(x) if width == 1 else np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].T
        out.append(np.ascontiguousarray(wide).tobytes())
    raw = b"".join(out)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(blob: bytes, widths: tuple[int, ...]) -> list[np.ndarray]:
    blob = pa.decompress(memoryview(blob)[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    sizes = np.frombuffer(blob, "<u4", len(widths), 4)
    out, at = [], 4 + 4 * len(widths)
    for n, width in zip(sizes.tolist(), widths, strict=True):
        if width == 1:
            out.append(np.frombuffer(blob, np.uint8, n, at))
        else:
            x = np.zeros((n, 8), np.uint8)
            x[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n).T
            out.append(x.view("<i8").ravel())
        at += n * width
    return out


def _bits(flags: np.ndarray) -> np.ndarray:
    return np.packbits(flags, bitorder="little")


def _flags(bits: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(bits, count=n, bitorder="little").astype(bool)


#: Bytes of the numbers of requests and answers. Pairs: hashes of the first and the second word, training count; whether kept, place, count, whether this group tells of it.
_PAIRS, _PAIR_ANSWER = (4, 4, 4), (1, 4, 8, 1)
#: Words: hash, training count, occurrences and number of the kept pairs that this group tells of; the sums of these.
_WORDS, _WORD_ANSWER = (8, 4, 8, 4), (8, 8, 8)
#: Triples: places of all kept pairs, how many triples begin with each, part and place of their second pairs, training counts; by pair occurrences and number of kept triples, by triple whether kept, count.
_TRIPLES, _TRIPLE_ANSWER = (4, 4, 4, 4, 4), (8, 4, 1, 8)
PAIRS, WORDS, TRIPLES = 0, 1, 2


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in the order of their first places, and each one's number."""
    made = pa.array(x).dictionary_encode()
    return np.asarray(made.dictionary), np.asarray(made.indices)


def _first_places(code: np.ndarray, n: int) -> np.ndarray:
    out = np.empty(n, np.int64)
    out[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    return out


class Dealt:
    """Values of a group in the order of their parts; `of`: from a value's number to its place in that order."""

    def __init__(self, values: np.ndarray, parts: int):
        part = _part(values, parts)
        order = np.argsort(part.astype(np.uint16 if parts <= 1 << 16 else np.int64), kind="stable")
        self.order, self.part, self.values = order, part[order], values[order]
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.arange(len(order))
        self.cuts = np.flatnonzero(np.r_[True, self.part[1:] != self.part[:-1], True]) if len(order) else np.zeros(1, np.int64)

    def spans(self):
        """(part, first, end) of each part that has values, and their sum, by which a group knows its request again."""
        starts = self.cuts[:-1].tolist()
        sums = np.add.reduceat(self.values, self.cuts[:-1]).view(np.int64).tolist() if starts else []
        return zip(self.part[starts].tolist(), starts, self.cuts[1:].tolist(), sums, strict=True)


class Group:
    """The tokens of a group of documents, its pairs, and what it asks for."""

    def __init__(self, texts, train: np.ndarray, parts: int):
        self.parts, self.train = parts, train
        self.hashes, self.first = _tokens(texts)
        self.taught = np.repeat(train, np.diff(self.first))
        self.before = np.r_[np.uint64(_START), self.hashes[:-1]]
        self.before[self.first[:-1]] = _START
        values, code = _coded(shared.mix(self.before * shared._FACTORS[0] + self.hashes * shared._FACTORS[1]))
        self.pairs = Dealt(values, parts)
        self.pair = self.pairs.of[code]
        self.pair_at = _first_places(self.pair, len(values))

    def ask_pairs(self):
        count = np.bincount(self.pair, self.taught, len(self.pairs.order))
        head, tail = self.before[self.pair_at] & _LOW, self.hashes[self.pair_at] & _LOW
        for q, i, j, check in self.pairs.spans():
            yield PAIRS, q, check, _pack(*zip((head[i:j], tail[i:j], count[i:j]), _PAIRS, strict=True))

    def hear_pairs(self, said: dict) -> None:
        n = len(self.pairs.order)
        self.place, self.count, self.tells = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        for q, i, j, check in self.pairs.spans():
            kept, place, count, tells = _unpack(_checked(said, PAIRS, q, check), _PAIR_ANSWER)
            at = i + np.flatnonzero(_flags(kept, j - i))
            self.place[at], self.count[at], self.tells[at] = place, count, _flags(tells, len(at))
        values, code = _coded(np.r_[self.hashes, np.uint64(_START)])
        self.words = Dealt(values, self.parts)
        self.word = self.words.of[code[:-1]]
        self.start = int(self.words.of[code[-1]])
        self.word_before = np.r_[0, self.word[:-1]]
        self.word_before[self.first[:-1]] = self.start
        # triples whose two pairs are kept, by the places of these among this group's pairs
        inner = np.ones(len(self.hashes), bool)
        inner[self.first[:-1]] = False
        ends = np.flatnonzero(inner)
        self.third = ends[(self.place[self.pair[ends - 1]] >= 0) & (self.place[self.pair[ends]] >= 0)]
        keys, self.triple = np.unique(self.pair[self.third - 1] * n + self.pair[self.third], return_inverse=True)
        self.leads, self.follows = keys // max(n, 1), keys % max(n, 1)
        self.kept = np.flatnonzero(self.place >= 0)
        self.ends = ends

    def _triple_spans(self):
        """(part, kept pairs, triples, check) of each part that has kept pairs of this group."""
        part = self.pairs.part[self.kept]
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, np.int64)
        lead = np.searchsorted(self.kept, self.leads)
        at = np.searchsorted(lead, cuts)
        marks = np.r_[0, np.cumsum(self.place[self.follows] * 31 + self.place[self.leads])]
        names = np.r_[0, np.cumsum(self.place[self.kept])]
        for k, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            a, b = int(at[k]), int(at[k + 1])
            yield int(part[i]), (i, j), (a, b), int(marks[b] - marks[a] + names[j] - names[i])

    def ask_words(self):
        count = np.bincount(self.word, self.taught, len(self.words.order))
        count[self.start] += self.train.sum()
        told = self.kept[self.tells[self.kept]]
        begins = self.word_before[self.pair_at[told]]
        total, kinds = np.bincount(begins, self.count[told], len(count)), np.bincount(begins, minlength=len(count))
        for q, i, j, check in self.words.spans():
            yield WORDS, q, check, _pack(*zip((self.words.values[i:j], count[i:j], total[i:j], kinds[i:j]), _WORDS, strict=True))

    def ask_triples(self):
        count = np.bincount(self.triple, self.taught[self.third], len(self.leads))
        fan = np.bincount(np.searchsorted(self.kept, self.leads), minlength=len(self.kept))
        for q, (i, j), (a, b), check in self._triple_spans():
            other = self.follows[a:b]
            yield TRIPLES, q, check, _pack(*zip((self.place[self.kept[i:j]], fan[i:j], self.pairs.part[other], self.place[other], count[a:b]), _TRIPLES, strict=True))

    def log_probabilities(self, said: dict, below: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token whether it is known, and the logarithms of its base and of its model probability."""
        c, total, kinds = (np.zeros(len(self.words.order), np.int64) for _ in range(3))
        for q, i, j, check in self.words.spans():
            c[i:j], total[i:j], kinds[i:j] = _unpack(_checked(said, WORDS, q, check), _WORD_ANSWER)
        single = (c[self.word] + 1) / below
        left = np.where(c > 0, (c - total + DISCOUNT * kinds) / np.maximum(c, 1), 1.0)
        here = self.count[self.pair]
        p = left[self.word_before] * single + np.where(here > 0, (here - DISCOUNT) / np.maximum(c, 1)[self.word_before], 0.0)
        over, followed, kinds = np.zeros(len(self.leads), np.int64), np.zeros(len(self.kept), np.int64), np.zeros(len(self.kept), np.int64)
        for q, (i, j), (a, b), check in self._triple_spans():
            followed[i:j], kinds[i:j], kept, count = _unpack(_checked(said, TRIPLES, q, check), _TRIPLE_ANSWER)
            over[a + np.flatnonzero(_flags(kept, b - a))] = count
        left = np.ones(len(self.place))
        n = self.count[self.kept]
        left[self.kept] = (n - followed + DISCOUNT * kinds) / n
        p[self.ends] *= left[self.pair[self.ends - 1]]
        m = over[self.triple]
        p[self.third] += np.where(m > 0, (m - DISCOUNT) / self.count[self.pair[self.third - 1]], 0.0)
        return c[self.word] > 0, np.log10(single), np.log10(p)


def _checked(said: dict, kind: int, part: int, check: int) -> bytes:
    blob, seen = said.get((kind, part), (b"", None))
    if seen != check:
        raise RuntimeError("the input gave other rows when it was read again")
    return blob


_ASKED = "kind int, part int, grp long, check long, blob binary"


def _asked(rows: list[tuple]) -> pa.RecordBatch:
    """rows: kind, part, group, check, blob."""
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _ASKED.split(", ")])


def _pair_requests(parts: int):
    """Requests of each group; its rows may come in several batches, one after the other."""

    def sent(name: int, texts: list, trains: list):
        group = Group(pa.chunked_array(texts, pa.string()), np.concatenate(trains), parts)
        return _asked([(kind, q, name, check, blob) for kind, q, check, blob in group.ask_pairs()])

    def run(batches):
        last, texts, trains = None, [], []
        for batch in batches:
            names, train = np.asarray(batch.column("grp")), np.asarray(batch.column("train").cast(pa.int8())).astype(np.int64)
            for k in np.flatnonzero(names < 0).tolist():
                yield sent(int(names[k]), [batch.column("text").slice(k, 1)], [train[k : k + 1]])
            usual = np.flatnonzero(names >= 0)
            names, train, text = names[usual], train[usual], batch.column("text").take(pa.array(usual))
            cuts = np.flatnonzero(np.r_[True, names[1:] != names[:-1], True]).tolist() if len(names) else []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if last is not None and names[lo] != last:
                    yield sent(last, texts, trains)
                    texts, trains = [], []
                    shared.trim()
                last = int(names[lo])
                texts.append(text.slice(lo, hi - lo))
                trains.append(train[lo:hi])
        if last is not None:
            yield sent(last, texts, trains)

    return run


def _joined(blobs: list, widths: tuple) -> tuple[list[np.ndarray], list[list[np.ndarray]]]:
    asked = [_unpack(x, widths) for x in blobs]
    return [np.concatenate(x) for x in zip(*asked, strict=True)], asked


def _pair_answers(blobs: list) -> list[bytes]:
    """The second level of a part: pairs that occur LEAST times, under their first words."""
    (head, tail, n), asked = _joined(blobs, _PAIRS)
    pairs, pair = np.unique(head << 32 | tail, return_inverse=True)
    counts = np.bincount(pair, n, len(pairs)).astype(np.int64)
    kept = counts >= LEAST
    firsts, words = np.unique(pairs[kept] >> 32), np.unique(pairs[kept] & 0xFFFFFFFF)
    parent, number = _among(firsts, pairs >> 32), _among(words, pairs & 0xFFFFFFFF)
    level = Level(len(firsts), len(words), parent[kept] * len(words) + number[kept], counts[kept])
    place = level.find(parent, number)
    found = place[pair]
    tells = np.zeros(len(pair), bool)
    tells[_first_places(pair, len(pairs))] = True  # the first group that has a pair tells its first word's part of it
    out, at = [], 0
    for x in asked:
        mine, told = found[at : at + len(x[0])], tells[at : at + len(x[0])]
        at += len(x[0])
        has = mine >= 0
        out.append(_pack(*zip((_bits(has), mine[has], level.counts[mine[has]], _bits(told[has])), _PAIR_ANSWER, strict=True)))
    return out


def _word_answers(blobs: list) -> tuple[list[bytes], tuple[int, int]]:
    """The first level of a part, and its training tokens and different words."""
    (names, *values), asked = _joined(blobs, _WORDS)
    words = np.unique(names.view(np.uint64) >> np.uint64(1)).astype(np.int64)  # numbers of 63 bits
    level = Level(1, 1 << 62, np.empty(0, np.int64), np.empty(0, np.int64))
    level.pointers, level.successors = EliasFano.of(np.array([0, len(words)])), EliasFano.of(words)
    at = level.find(np.zeros(len(names), np.int64), (names.view(np.uint64) >> np.uint64(1)).astype(np.int64))
    c, total, kinds = (np.bincount(at, x, len(words)).astype(np.int64) for x in values)
    taught = c[words != _START >> 1]
    out, i = [], 0
    for x in asked:
        mine = at[i : i + len(x[0])]
        i += len(mine)
        out.append(_pack(*zip((c[mine], total[mine], kinds[mine]), _WORD_ANSWER, strict=True)))
    return out, (int(taught.sum()), int((taught > 0).sum()))


def _triple_answers(blobs: list) -> list[bytes]:
    """The third level of a part: triples that occur LEAST times, under their first pairs."""
    (place, fan, part, other, n), asked = _joined(blobs, _TRIPLES)
    parents = int(place.max(initial=-1)) + 1
    words, number = np.unique(part << 32 | other, return_inverse=True)
    span = max(len(words), 1)
    triples, triple = np.unique(np.repeat(place, fan) * span + number, return_inverse=True)
    counts = np.bincount(triple, n, len(triples)).astype(np.int64)
    kept = counts >= LEAST
    level = Level(parents, span, triples[kept], counts[kept])
    over = _at(level.counts, level.find(triples // span, triples % span))[triple]
    parent = triples[kept] // span
    followed, kinds = np.bincount(parent, counts[kept], parents).astype(np.int64), np.bincount(parent, minlength=parents)
    out, i, k = [], 0, 0
    for x in asked:
        mine, m = x[0], over[k : k + len(x[2])]
        i, k = i + len(mine), k + len(m)
        out.append(_pack(*zip((followed[mine], kinds[mine], _bits(m > 0), m[m > 0]), _TRIPLE_ANSWER, strict=True)))
    return out


_ANSWERS = "kind int, part int, grp long, check long, blob binary, tokens long, kinds long"


def _answers(table: pa.Table) -> pa.Table:
    """Counts what all groups asked a part, and answers each; tokens and different words of the training texts stand in the first row."""
    shared.trim()
    kind = table.column("kind")[0].as_py()
    order = np.argsort(np.asarray(table.column("grp")), kind="stable")  # the same answers at every attempt
    table = table.take(pa.array(order))
    blobs, totals = table.column("blob").to_pylist(), (0, 0)
    if kind == PAIRS:
        out = _pair_answers(blobs)
    elif kind == TRIPLES:
        out = _triple_answers(blobs)
    else:
        out, totals = _word_answers(blobs)
    more = np.zeros((2, len(out)), np.int64)
    more[:, 0] = totals
    table = table.drop_columns(["blob"])
    return table.append_column("blob", pa.array(out, pa.binary())).append_column("tokens", pa.array(more[0])).append_column("kinds", pa.array(more[1]))


def _of_group(rows: pa.Table, answers: pa.Table, parts: int) -> tuple[pa.Table, Group, dict]:
    """A group's rows in the order of the input, the group with its pairs' answers, and all answers by kind and part."""
    shared.trim()
    place = np.asarray(rows.column("row"))
    if (place[1:] < place[:-1]).any():
        rows = rows.take(pa.array(np.argsort(place)))
    said = {(k, q): (x, c) for k, q, x, c in zip(*(answers.column(c).to_pylist() for c in ("kind", "part", "blob", "check")), strict=True)}
    group = Group(rows.column("text"), np.asarray(rows.column("train").combine_chunks().cast(pa.int8())).astype(np.int64), parts)
    group.hear_pairs(said)
    return rows, group, said


def lm_scores(docs: DataFrame, train, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Learns from the rows where the boolean column expression train holds, and scores all.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    A null or empty text is its end alone. Long texts are scored whole. Repeated
    rows count and are scored as often as they occur. Without training rows
    every token has probability 1 and both scores are 0. Other columns are not
    read; an empty table gives none. docs are read several times and must come in
    the same partitions each time, as files do; else this fails.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    # neighbours in the input make a group, so that its pairs are found without a shuffle of texts
    long = F.coalesce(F.octet_length("text") > LONG, F.lit(False))
    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    grouped = numbered.withColumn("grp", F.when(long, -1 - F.col("row")).otherwise(F.floor(F.col("row") / F.lit(GROUP))).cast("long"))
    size = int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    parts, tasks = max(1, -(-size // PART_BYTES)), size // TASK_BYTES
    dealt = lambda df, *by: df.repartition(tasks, *by) if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else df
    asked = shared.map_batches(grouped.select("grp", "text", "train"), _pair_requests(parts), _ASKED)
    pairs = shared.cut(dealt(asked, "part").groupBy("part").applyInArrow(_answers, _ANSWERS), "pairs")

    def ask(rows, answers):
        if not rows.num_rows:
            return pa.Table.from_batches([_asked([])])
        name = rows.column("grp")[0].as_py()
        _, group, _ = _of_group(rows, answers, parts)
        return pa.Table.from_batches([_asked([(kind, q, name, check, blob) for f in (group.ask_words, group.ask_triples) for kind, q, check, blob in f()])])

    told = lambda df: dealt(df.select("grp", "kind", "part", "check", "blob"), "grp").groupBy("grp")
    asked = dealt(grouped, "grp").groupBy("grp").cogroup(told(pairs)).applyInArrow(ask, _ASKED)
    more = shared.cut(dealt(asked, "kind", "part").groupBy("kind", "part").applyInArrow(_answers, _ANSWERS), "ngrams")
    tokens, kinds = more.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    below = float(tokens + kinds + 1)

    def score(rows, answers):
        if not rows.num_rows:
            return pa.table({k: pa.array([], t) for k, t in _RESULT})
        rows, group, said = _of_group(rows, answers, parts)
        sums = lambda x: np.add.reduceat(x, group.first[:-1])
        known, base, whole = group.log_probabilities(said, below)
        values = [rows.column("doc_id"), pa.array(group.train == 0), pa.array(np.diff(group.first)), pa.array(sums(known.astype(np.int64))), pa.array(np.full(len(group.train), tokens, np.int64)), pa.array(sums(base)), pa.array(sums(whole))]
        return pa.table({k: (v if isinstance(v, pa.ChunkedArray) else v.cast(t)) for (k, t), v in zip(_RESULT, values, strict=True)})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt(grouped, "grp").groupBy("grp").cogroup(told(pairs.unionByName(more))).applyInArrow(score, schema)


_RESULT = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]

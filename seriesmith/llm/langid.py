"""Language identification with interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

ORDER = 4
#: Characters of training text a language, at most on average: a bounded sample of whole labelled documents.
SAMPLE_CHARS = 1_500_000
#: Bytes of a cache of looked-up codes.
CACHE_BYTES = 1 << 26
UND = "und"
_PLANE = 1 << 16


@dataclass
class Level:
    """One order of one language: sorted hashes of grams with discounted probabilities, and of contexts with the weight of the order below."""

    grams: np.ndarray
    discounted: np.ndarray
    contexts: np.ndarray
    weights: np.ndarray


def _hashed(codes: np.ndarray, order: int) -> np.ndarray:
    return shared.mix(codes.astype(np.uint64) * np.uint64(16) + np.uint64(order))


def _find(table: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(table):
        return np.full(len(wanted), missing)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return np.where(table[at] == wanted, values[at], missing)


def train(codes: np.ndarray, order: int, base: int) -> list[Level]:
    """Interpolated Kneser-Ney from codes of `order` symbols in number base `base`, the last symbol being predicted."""
    grams, counts = np.unique(codes, return_counts=True)
    levels = []
    for n in range(order, 0, -1):
        once, twice = int((counts == 1).sum()), int((counts == 2).sum())
        discount = once / (once + 2 * twice) if once else 0.5
        contexts = grams // base
        names, at = np.unique(contexts, return_inverse=True)
        total = np.bincount(at, counts)
        kinds = np.bincount(at)
        lost = np.bincount(at, np.minimum(counts, discount))
        keys, above = _hashed(grams, n), np.maximum(counts - discount, 0) / total[at]
        ctx = _hashed(names, n + 8)
        a, b = np.argsort(keys), np.argsort(ctx)
        levels.append(Level(keys[a], above[a], ctx[b], (lost / total)[b]))
        assert len(kinds) == len(names)
        grams, counts = np.unique(grams % base ** (n - 1), return_counts=True)  # how many different symbols come before
    return levels[::-1]


def probabilities(levels: list[Level], codes: np.ndarray, base: int) -> np.ndarray:
    p = np.full(len(codes), 1 / base)
    for n, level in enumerate(levels, 1):
        gram = codes % base**n
        p = _find(level.grams, level.discounted, _hashed(gram, n), 0.0) + _find(level.contexts, level.weights, _hashed(gram // base, n + 8), 1.0) * p
    return p


class Alphabet:
    """Symbols: 0 for all that is no letter, 1 for letters that no sample had, then those that one had."""

    def __init__(self, letters: list[str]):
        self.letters = letters
        self.size = len(letters) + 2
        at = self.at = {c: k + 2 for k, c in enumerate(letters)}
        self.table = np.zeros(_PLANE + 1, np.int32)
        for c in range(_PLANE):
            if not 0xD800 <= c < 0xE000 and (ch := chr(c)).isalpha():
                self.table[c] = at.get(ch.lower()[:1], 1)
        self.table[_PLANE] = 1

    def codes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of ORDER symbols for each scored character of a slice; each row's first code; each row's number of letters.

        Runs of what is no letter count as one symbol, and rows do not see each other.
        """
        lo = int(offsets[0])
        data, offsets = data[lo : int(offsets[-1])], np.asarray(offsets, np.int64) - lo
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        leads = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        starts = leads[offsets]
        symbols = self.table[np.minimum(points, _PLANE)]
        beyond = np.flatnonzero(points >= _PLANE)
        if len(beyond):
            symbols[beyond] = [self.at.get(chr(c).lower()[:1], 1) if chr(c).isalpha() else 0 for c in points[beyond].tolist()]
        n, code = len(symbols), np.zeros(len(symbols), np.int64)
        before = None
        for k in range(ORDER - 1, -1, -1):
            shifted = np.zeros(n, np.int32)
            shifted[k:] = symbols[: n - k] if k else symbols
            for t in range(k):
                at = starts[:-1] + t
                shifted[at[at < starts[1:]]] = 0
            code = code * self.size + shifted
            before = shifted if k == 1 else before
        scored = (symbols > 0) | (before > 0)
        first = np.r_[0, np.cumsum(scored)][starts]
        letters = np.diff(np.r_[0, np.cumsum(symbols > 0)][starts])
        return code[scored], first, letters


class LanguageModel:
    """Models of several languages over one alphabet, with a calibrated limit of cross-entropy for each."""

    def __init__(self, alphabet: Alphabet, names: list[str], levels: list[list[Level]], limits: np.ndarray):
        self.alphabet, self.names, self.levels, self.limits = alphabet, names, levels, limits
        self._codes, self._logs = np.empty(0, np.int64), np.empty((0, len(names)))

    def __getstate__(self):
        return {"letters": self.alphabet.letters, "names": self.names, "levels": self.levels, "limits": self.limits}

    def __setstate__(self, state):
        self.__init__(Alphabet(state["letters"]), state["names"], state["levels"], state["limits"])

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """(codes, languages) natural logarithms; each different code is looked up once, and kept up to a bound."""
        coded = pa.array(codes).dictionary_encode()
        different, at = np.asarray(coded.dictionary), np.asarray(coded.indices)
        place = np.searchsorted(self._codes, different)
        known = place < len(self._codes)
        known[known] = self._codes[place[known]] == different[known]
        if not known.all():
            new = np.sort(different[~known])
            logs = np.stack([np.log(probabilities(levels, new, self.alphabet.size)) for levels in self.levels], 1)
            if (len(self._codes) + len(new)) * 8 * (len(self.names) + 1) > CACHE_BYTES:
                self._codes, self._logs = np.empty(0, np.int64), np.empty((0, len(self.names)))
                if known.any():
                    return self.log_probabilities(codes) if len(different) * 8 * (len(self.names) + 1) <= CACHE_BYTES else self._direct(different)[at]
            where = np.searchsorted(self._codes, new)
            self._codes, self._logs = np.insert(self._codes, where, new), np.insert(self._logs, where, logs, 0)
            place = np.searchsorted(self._codes, different)
        return self._logs[place][at]

    def _direct(self, codes: np.ndarray) -> np.ndarray:
        return np.stack([np.log(probabilities(levels, codes, self.alphabet.size)) for levels in self.levels], 1)

    def entropies(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row: cross-entropies by language, scored characters, letters."""
        rows = len(offsets) - 1
        out, counts, letters = np.zeros((rows, len(self.names))), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        for i, j in shared.slices(offsets, shared.SLICE_BYTES // 2):
            codes, first, found = self.alphabet.codes(data, offsets[i : j + 1])
            n = np.diff(first)
            letters[i:j], counts[i:j] = found, n
            logs = self.log_probabilities(codes)
            for k in range(len(self.names)):
                sums = np.r_[0.0, np.cumsum(logs[:, k], dtype=np.float64)]
                out[i:j, k] = -(sums[first[1:]] - sums[first[:-1]]) / np.maximum(n, 1)
        return out, counts, letters


#: The limit of a language is set so that this share of texts that its model has not seen stays below it, and then this much higher.
SHARE, MARGIN = 0.95, 2.5
#: No limit is nearer to the mean than this share of the way to the uniform distribution: a text with a passage of another language is not rejected.
FLOOR = 0.4
#: Characters of a text from which on it takes part in the calibration.
LEAST = 30


def _trained(texts: dict[str, list[np.ndarray]], alphabet: Alphabet) -> LanguageModel:
    return LanguageModel(alphabet, sorted(texts), [train(np.concatenate([*texts[name], np.empty(0, np.int64)]), ORDER, alphabet.size) for name in sorted(texts)], np.zeros((len(texts), 4)))


def fit(sample: list[tuple[str, str]]) -> LanguageModel:
    """A model from (language, text) pairs.

    Rejection is calibrated by cross-fitting: either half of a language's texts
    is scored by a model of the other half. A text of n characters is rejected
    beyond mean + z * sqrt(spread**2 + noise**2 / n), of such unseen texts, or
    beyond FLOOR if that is farther.
    """
    letters: set[str] = set()
    for _, text in sample:
        letters.update(c for c in text.lower() if c.isalpha())
    alphabet = Alphabet(sorted(letters))
    coded: dict[str, list[np.ndarray]] = {}
    for name, text in sample:
        raw = np.frombuffer(text.encode(), np.uint8)
        coded.setdefault(name, []).append(alphabet.codes(raw, np.array([0, len(raw)]))[0])
    model = _trained(coded, alphabet)
    halves = [_trained({name: texts[k::2] for name, texts in coded.items()}, alphabet) for k in (1, 0)]
    for k, name in enumerate(model.names):
        each = [-half.log_probabilities(codes)[:, k] for at, half in enumerate(halves) for codes in coded[name][at::2] if len(codes) >= LEAST]
        if not each:
            model.limits[k] = np.log(alphabet.size), 1.0, 1.0, 1.0
            continue
        n, mean = np.array([len(x) for x in each]), np.array([x.mean() for x in each])
        centre, noise = np.median(mean), np.sqrt(np.mean([x.var() for x in each]))
        spread = np.median(np.abs(mean - centre)) * 1.4826
        away = (mean - centre) / np.sqrt(spread**2 + noise**2 / n)
        model.limits[k] = centre, spread, noise, max(3.0, np.quantile(away, SHARE)) * MARGIN
    return model


def learn(docs: DataFrame, text: str, lang: str, sample_chars: int = SAMPLE_CHARS) -> LanguageModel | None:
    """Fits a model on a sample of whole labelled documents of LEARNT_BYTES at most, chosen by a hash of their text, copies once; None if there are none."""
    labelled = docs.where(F.col(lang).isNotNull() & (F.octet_length(F.col(text).cast("string")) <= shared.LEARNT_BYTES)).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    total = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()}
    if not total:
        return None
    share = F.create_map([F.lit(x) for k, n in total.items() for x in (k, min(1.0, sample_chars / max(n, 1)))])
    chance = F.pmod(F.xxhash64("text"), F.lit(1 << 24)) / F.lit(float(1 << 24))
    chosen = labelled.where(chance < share[F.col("lang")]).distinct()  # a much copied text counts once
    return fit(sorted((r["lang"], r["text"]) for r in chosen.collect()))


def identify(docs: DataFrame, model: LanguageModel | None, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, entropy, rejected) of each whole text, after the columns in keep.

    lang_pred is the language of the lowest cross-entropy by character, the
    first by name on a tie; `und` with score 0 for a null text, one without a
    letter, and all texts if nothing could be learnt. rejected: `und`, or an
    entropy above that language's calibrated limit. Repeated rows give repeated
    results, other columns are not read, an empty table gives none.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    names = [f"kept_{k}" for k in range(len(keep))]
    source = docs.select(*(shared.named(c).alias(x) for c, x in zip(keep, names, strict=True)), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        model = held.value
        for batch in batches:
            data, offsets = shared.utf8(batch.column("text"))
            rows = batch.num_rows
            if model is None:
                best, entropy, score, bad = np.array([UND] * rows, object), np.zeros(rows), np.zeros(rows), np.ones(rows, bool)
            else:
                entropies, n, letters = model.entropies(data, offsets)
                at = entropies.argmin(1)
                entropy = entropies[np.arange(rows), at]
                odds = np.exp(-(entropies - entropy[:, None]) * np.minimum(n, 40)[:, None])
                none = letters == 0
                score = np.where(none, 0.0, 1 / odds.sum(1))
                mean, spread, noise, z = model.limits[at].T
                far = np.maximum(z * np.sqrt(spread**2 + noise**2 / np.maximum(n, 1)), FLOOR * (np.log(model.alphabet.size) - mean))
                bad = none | (entropy > mean + far)
                best = np.array(model.names, object)[at]
                best[none] = UND
            made = [pa.array(best.tolist(), pa.string()), pa.array(score), pa.array(entropy), pa.array(bad)]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), batch.column("doc_id"), *made], [*names, "doc_id", "lang_pred", "score", "entropy", "rejected"])

    schema = "".join(f"{x} {source.schema[x].dataType.simpleString()}, " for x in names) + "doc_id long, lang_pred string, score double, entropy double, rejected boolean"
    return shared.map_batches(source, run, schema)

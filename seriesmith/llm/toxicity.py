"""Toxicity by a weighted finite-state grammar of clauses.

A lexical transducer reads the letters of a word and writes its class: insult,
threat, target, negation, report, break or nothing. Insults are a short fixed
list and stems learnt from labelled texts; the other classes are closed lists.
Transducers for targets, negation and reported speech are composed, once to be
run from left to right and once from right to left, so that cues count before
an insult and after it. Their arcs have weights, log odds that add up along the
path: that of the word accepted, and those of the cues that reach it. They are
learnt from the labels over a prior. A text's score is the chance that one
clause of it at least is toxic.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


#: Labelled texts of either label that are learnt from, at most on average.
SAMPLE = 3000
#: Fixed word lists of the closed classes, in English, German, French and Spanish; an insult is a beginning of a word.
INSULTS = "idiot moron stupid scum worthless pathetic disgusting loser clown trash bastard dumbass imbecile dummkopf trottel arschloch abschaum wertlos connard imbécile salaud minable estúpid imbécil escoria".split()
THREATS = "kill hurt murder stab shoot strangle töten umbringen erschießen verprügeln tuer frapper étrangler matar golpear apuñalar".split()
TARGETS = "you your yours yourself he she they them him her du dich dir ihr euch tu toi vous ton te ti usted ustedes".split()
NEGATIONS = "not no never nobody nicht kein keine niemals pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says say saying claimed called quoted wrote sagte sagt behauptete dit disait écrit dijo dice llamó".split()
#: Symbols of the grammar, and marks that are added to insult and threat.
NOTHING, INSULT, THREAT, TARGET, NEGATION, REPORT, BREAK = range(7)
TARGETED, NEGATED, REPORTED = 8, 16, 32
#: Prior chance that a clause with such a word is toxic, by which factor a cue changes its odds, and how many texts the prior counts as.
PRIOR = {INSULT: 0.85, THREAT: 0.35}
FACTORS = {(INSULT, TARGETED): 2.0, (THREAT, TARGETED): 8.0, (INSULT, NEGATED): 0.15, (THREAT, NEGATED): 0.1, (INSULT, REPORTED): 0.25, (THREAT, REPORTED): 0.25}
PRIOR_TEXTS = 4
#: How many symbols a cue reaches over, before and after; targets and negation not over a comma or colon.
REACH = {TARGETED: 8, NEGATED: 3, REPORTED: 12}
_TOKEN = re.compile(r"[^\W\d_]+|[,:]")
_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;|\n]")


def log_odds(p: float) -> float:
    return math.log(p / (1 - p))


class Transducer:
    """States from 0 on, and a step: (state, symbol) to (state, written symbol, weight). Steps are kept once taken."""

    def __init__(self, step: Callable[[int, int], tuple[int, int, float]]):
        self._step, self._known = step, {}

    def step(self, state: int, symbol: int) -> tuple[int, int, float]:
        key = (state, symbol)
        if key not in self._known:
            self._known[key] = self._step(state, symbol)
        return self._known[key]

    def run(self, symbols: Iterable[int]) -> tuple[list[int], list[float]]:
        state, out, weights = 0, [], []
        for s in symbols:
            state, written, weight = self.step(state, s)
            out.append(written)
            weights.append(weight)
        return out, weights

    def then(self, other: Transducer, states: int = 16) -> Transducer:
        """The composition: what this one writes, the other reads; weights add up. states: more than this one's states."""

        def step(state: int, symbol: int) -> tuple[int, int, float]:
            a, written, weight = self.step(state % states, symbol)
            b, written, more = other.step(state // states, written)
            return b * states + a, written, weight + more

        return Transducer(step)


def marker(cue: int, mark: int, weights: dict[tuple[int, int], float], stops: bool = True) -> Transducer:
    """Marks insults and threats that follow the cue by at most its reach and are not marked yet, on arcs that weigh log odds; stops: at a break."""
    reach = REACH[mark]

    def step(state: int, symbol: int) -> tuple[int, int, float]:
        if symbol == cue:
            return reach, symbol, 0.0
        if symbol == BREAK and stops:
            return 0, symbol, 0.0
        kind = symbol & 7
        hit = state and kind in (INSULT, THREAT) and not symbol & mark
        return max(0, state - 1), symbol | mark if hit else symbol, weights[kind, mark] if hit else 0.0

    return Transducer(step)


class Grammar:
    """Both runs over a clause: the one from right to left reads what the other wrote."""

    def __init__(self, weights: dict[tuple[int, int], float] | None = None):
        w = self.weights = weights or {k: math.log(f) for k, f in FACTORS.items()}
        report = marker(REPORT, REPORTED, w, stops=False)
        self.forward = marker(TARGET, TARGETED, w).then(marker(NEGATION, NEGATED, w)).then(report, 256)
        self.backward = marker(TARGET, TARGETED, w).then(marker(REPORT, REPORTED, w, stops=False))

    def run(self, symbols: list[int]) -> tuple[list[int], list[float]]:
        """The marked symbols and the weights of their cues."""
        out, first = self.forward.run(symbols)
        out, second = self.backward.run(out[::-1])
        return out[::-1], [a + b for a, b in zip(first, second[::-1], strict=True)]


class Lexicon:
    """The lexical transducer: a trie of letters that ends in (class, stem)."""

    def __init__(self, stems: list[str]):
        """stems: learnt beginnings of words; one that ends in $ is a whole word. The fixed insults are stems too."""
        self.learnt = stems
        self.stems = sorted({*stems, *INSULTS})
        self.trie: dict = {}
        closed = {w + "$": k for k, group in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in group}
        for word, kind in {**closed, **dict.fromkeys(self.stems, INSULT)}.items():
            node = self.trie
            for c in word:
                node = node.setdefault(c, {})
            node[""] = (kind, word)
        every = sorted({re.escape(s[:-1]) + r"\b" if s.endswith("$") else re.escape(s) for s in self.stems} | {re.escape(w) + r"\b" for w in THREATS})
        self.hit = re.compile(r"\b(?:" + "|".join(every) + ")")

    def read(self, word: str) -> tuple[int, str]:
        """Class and stem of a word; the shortest insult that it begins with."""
        if word in (",", ":"):
            return BREAK, ""
        node = self.trie
        for c in word + "$":
            node = node.get(c)
            if node is None:
                break
            if "" in node:
                return node[""]
        return NOTHING, ""

    def clauses(self, text: str) -> Iterable[list[tuple[int, str]]]:
        """Every clause that may have an insult or a threat, as classes and stems."""
        low, done, bounds = text.lower(), -1, None
        for m in self.hit.finditer(low):
            if m.start() < done:
                continue
            if bounds is None:
                bounds, at = [c.start() for c in _CLAUSE.finditer(low)] + [len(low)], 0
            while bounds[at] < m.start():
                at += 1
            start, done = (bounds[at - 1] + 1 if at else 0), bounds[at]
            yield [self.read(w) for w in _TOKEN.findall(low, start, done)]


def learn_stems(texts: list[tuple[str, bool]], least: int = 4, ratio: float = 0.01) -> list[str]:
    """Beginnings of words, or whole words, that hardly occur outside toxic texts: the longest with the same reach as the shortest such one.

    A stem needs different neighbours in most texts that have it, and `least`, so
    that the words of a much copied toxic text are not taken for insults.
    """
    count, total = (Counter(), Counter()), [0, 0]
    around: dict[str, set] = {}
    texts = list(dict.fromkeys(texts))
    for text, toxic in texts:
        words, seen = _WORD.findall(text.lower()), set()
        for w in set(words):
            w += "$"
            seen.update(w[:n] for n in range(3, min(len(w), 8) + 1))
            if len(w) <= 20:
                seen.add(w)
        count[toxic].update(seen)
        total[toxic] += 1
    pure = {s: n for s, n in count[1].items() if n >= least and (count[0][s] + 0.2) / (total[0] + 1) <= ratio * n / (total[1] + 1)}
    for text, toxic in texts:
        if toxic:
            words = ["", *_WORD.findall(text.lower()), ""]
            for before, w, after in zip(words, words[1:], words[2:], strict=False):
                w += "$"
                for n in {*range(3, min(len(w), 8) + 1), len(w)}:
                    if (s := w[:n]) in pure:
                        around.setdefault(s, set()).add((before, after))
    pure = {s: n for s, n in pure.items() if len(around.get(s, ())) >= max(least, 0.6 * n)}
    roots = {s for s in pure if not any(s[:n] in pure for n in range(3, len(s)))}
    longer: dict[str, list[str]] = {}
    for s in pure:
        for n in range(3, len(s)):
            if s[:n] in roots:
                longer.setdefault(s[:n], []).append(s)
                break
    return sorted({max([r, *(s for s in longer.get(r, []) if pure[s] >= 0.97 * pure[r])], key=lambda s: (len(s), s)) for r in roots})


class ToxicityModel:
    def __init__(self, stems: list[str], words: dict[str, float], cues: dict[tuple[int, int], float], base: float):
        """words: log odds of a clause with that stem or threat; cues: weights of the grammar's arcs."""
        self.lexicon, self.words, self.grammar, self.base = Lexicon(stems), words, Grammar(cues), base

    def __reduce__(self):
        return ToxicityModel, (self.lexicon.learnt, self.words, self.grammar.weights, self.base)

    def found(self, text: str | None) -> Iterable[tuple[int, str, float]]:
        """Marked class, stem and log odds of each insult and threat."""
        for clause in self.lexicon.clauses(text or ""):
            marked, weights = self.grammar.run([k for k, _ in clause])
            for (kind, stem), symbol, w in zip(clause, marked, weights, strict=True):
                if kind in (INSULT, THREAT):
                    yield symbol, stem, self.words.get(stem, log_odds(PRIOR[kind])) + w

    def score(self, text: str | None) -> float:
        safe = math.log1p(-self.base)
        for _, _, odds in self.found(text):
            safe -= math.log1p(math.exp(min(odds, 20.0)))
        return -math.expm1(safe)


def fit(texts: list[tuple[str, bool]]) -> ToxicityModel:
    """Learns from (text, toxic) pairs; without any, only the priors and fixed lists speak."""
    stems = learn_stems(texts)
    plain = ToxicityModel(stems, {}, {k: math.log(f) for k, f in FACTORS.items()}, 0.01)
    words, cues, none = {}, {}, [0, 0]
    for text, toxic in texts:
        found = list(plain.found(text))
        none[toxic] += not found
        for key in {(symbol & 7, stem) for symbol, stem, _ in found if symbol < 8} or {(symbol & 7, stem) for symbol, stem, _ in found}:
            words.setdefault(key, [0, 0])[toxic] += 1
        for key in {(symbol & 7, mark) for symbol, _, _ in found for mark in REACH if symbol & mark}:
            cues.setdefault(key, [0, 0])[toxic] += 1

    def odds(counts: list[int], p: float) -> float:
        return log_odds((counts[1] + PRIOR_TEXTS * p) / (sum(counts) + PRIOR_TEXTS))

    weights = {k: math.log(f) for k, f in FACTORS.items()}
    for (kind, mark), counts in cues.items():
        usual = log_odds(PRIOR[kind])
        weights[kind, mark] = odds(counts, 1 / (1 + math.exp(-usual - weights[kind, mark]))) - usual
    learnt = {stem: odds(counts, PRIOR[kind]) for (kind, stem), counts in words.items()}
    return ToxicityModel(stems, learnt, weights, min(0.4, (none[1] + 0.5) / (sum(none) + 50)))


def learn(docs: DataFrame, labels: DataFrame, fold, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """Fits on a sample of labelled texts of about `sample` of each label, of LEARNT_BYTES at most, chosen by a hash of their ids, where the expression fold over doc_id holds."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("toxic")).where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold)
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, F.lit(sample / max(1, total.get(1, 0)))).otherwise(F.lit(sample / max(1, total.get(0, 0))))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 24)) < share * (1 << 24))
    # about twice `sample` ids: a size that does not grow with the tables
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.where(F.coalesce(F.octet_length("text") <= shared.LEARNT_BYTES, F.lit(True))).join(F.broadcast(chosen), "doc_id")
    return fit(sorted((r["text"] or "", bool(r["toxic"])) for r in rows.select("text", "toxic").distinct().collect()))


def toxicity_scores(docs: DataFrame, model: ToxicityModel, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score, predicted) of each whole text, after the columns in keep.

    score is between 0 and 1; predicted is 1 from a half on. A null or empty
    text, or one without insult or threat, has the small base score. Repeated
    rows give repeated results, other columns are not read, an empty table
    gives none.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"kept_{k}" for k in range(len(keep))]
    source = docs.select(*(shared.named(c).alias(x) for c, x in zip(keep, names, strict=True)), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        model = held.value
        for batch in batches:
            scores = [model.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], [*names, "doc_id", "score", "predicted"])

    return shared.map_batches(source, run, "".join(f"{x} {source.schema[x].dataType.simpleString()}, " for x in names) + "doc_id long, score double, predicted int")



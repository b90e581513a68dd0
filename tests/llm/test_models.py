import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmith.llm import langid, lm, shared, toxicity

WORDS = {"xx": "lobra menti suro kala tepi nomi vask".split(), "yy": "zhuk grapf stein mulz knorf wixt".split()}


def text_of(lang, r, n=30):
    return " ".join(r.choices(WORDS[lang], k=n)) + "."


@pytest.fixture(scope="module")
def tongues():
    r = random.Random(1)
    return langid.fit([(k, text_of(k, r)) for k in WORDS for _ in range(40)])


def test_kneser_ney_sums_to_one(tongues):
    base = tongues.alphabet.size
    for context in (0, 5, 3 * base + 7, base**3 - 1):
        codes = context * base + np.arange(base)
        for levels in tongues.levels:
            assert langid.probabilities(levels, codes, base).sum() == pytest.approx(1.0)


def test_slices_and_rows_do_not_matter(tongues, monkeypatch):
    texts = ["lobra menti", "", "zhuk!!  grapf", "1234", "Ä ö 日本", "suro " * 40]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])]
    whole = tongues.entropies(data, offsets)
    monkeypatch.setattr(shared, "SLICE_BYTES", 10)
    for a, b in zip(whole, tongues.entropies(data, offsets), strict=True):
        assert np.allclose(a, b)
    for k, x in enumerate(raw):
        alone = tongues.entropies(np.frombuffer(x, np.uint8), np.array([0, len(x)]))
        assert np.allclose(alone[0][0], whole[0][k]) and alone[2][0] == whole[2][k]
    assert whole[2].tolist() == [sum(c.isalpha() for c in t) for t in texts]


def test_identify_odd_rows(spark, tongues):
    r = random.Random(2)
    rows = [(1, text_of("xx", r), "yy"), (2, text_of("yy", r), None), (3, None, "xx"), (4, "12 !?", "xx"), (5, "", "xx"), (None, "lobra menti suro", "xx"), (1, "zhuk grapf", None), (7, "qqjjqq jqjqj " * 30, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    got = langid.identify(df, tongues, keep=("lang_pred",)).collect()
    by = {(x.doc_id, x.kept_0): x for x in got}
    assert [by[k].lang_pred for k in ((1, "yy"), (2, None), (3, "xx"), (4, "xx"), (5, "xx"), (None, "xx"), (1, None))] == ["xx", "yy", "und", "und", "und", "xx", "yy"]
    assert [by[k].rejected for k in ((1, "yy"), (2, None), (3, "xx"), (4, "xx"), (7, None))] == [False, False, True, True, True]
    assert all(0 <= x.score <= 1 for x in got)
    assert langid.identify(df.limit(0), tongues).count() == 0
    assert langid.learn(df.limit(0), "text", "lang_pred") is None
    assert {x.lang_pred for x in langid.identify(df, None).collect()} == {"und"}


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = shared.crc_mod("doc_id", 4)
    model = langid.learn(docs.where(fold != 2), "text", "lang")
    got = langid.identify(docs.where(fold == 2), model).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_fold_is_pythons_crc32(spark):
    df = spark.createDataFrame([(k,) for k in [*range(50), -3, None]], "doc_id long").withColumn("m", shared.crc_mod("doc_id", 7))
    assert all(r.m == zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 7 for r in df.collect())


def marks_by_definition(symbols):
    """Marks of each insult or threat: cues near enough on the sides that count, without a break between where that matters."""
    T, out = toxicity, []
    for i, s in enumerate(symbols):
        if s in (T.INSULT, T.THREAT):
            for cue, mark, after, stops in ((T.TARGET, T.TARGETED, True, True), (T.NEGATION, T.NEGATED, False, True), (T.REPORT, T.REPORTED, True, False)):
                near = [j for j, x in enumerate(symbols) if x == cue and abs(i - j) <= T.REACH[mark] and (j < i or after)]
                if any(not stops or T.BREAK not in symbols[min(i, j) : max(i, j)] for j in near):
                    s |= mark
        out.append(s)
    return out


def test_the_composed_grammar_against_its_definition():
    T, grammar = toxicity, toxicity.Grammar()
    r = random.Random(0)
    for _ in range(400):
        symbols = r.choices(range(7), weights=(8, 3, 2, 1, 1, 1, 1), k=r.randrange(30))
        got, weights = grammar.run(symbols)
        assert got == marks_by_definition(symbols)
        for symbol, w in zip(got, weights, strict=True):
            assert w == pytest.approx(sum(math.log(T.FACTORS[symbol & 7, m]) for m in T.REACH if symbol & m))
    a, b = T.marker(T.TARGET, T.TARGETED, grammar.weights), T.marker(T.NEGATION, T.NEGATED, grammar.weights)
    for _ in range(50):
        symbols = [r.randrange(7) for _ in range(12)]
        between, first = a.run(symbols)
        out, second = b.run(between)
        assert a.then(b).run(symbols) == (out, [x + y for x, y in zip(first, second, strict=True)])


def test_the_lexical_transducer():
    lexicon = toxicity.Lexicon(["grubl", "snot$"])
    read = lambda w: lexicon.read(w)
    assert read("grublings") == (toxicity.INSULT, "grubl") and read("snot") == (toxicity.INSULT, "snot$") and read("snots")[0] == read("grub")[0] == read("killing")[0] == toxicity.NOTHING
    assert [read(w)[0] for w in ("kill", "you", "not", "said", ",", "idiots")] == [toxicity.THREAT, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT, toxicity.BREAK, toxicity.INSULT]


PLAIN = [a + b for a in ("bar", "cel", "dim", "fop", "gus", "hen", "jot", "kal") for b in ("a", "en", "il", "os", "ut", "ymp", "ex")]


def toxic_texts(seed=3, n=120):
    r = random.Random(seed)
    plain = PLAIN
    out = []
    for k in range(n):
        w = r.choices(plain, k=40)
        if k % 3 == 0:
            w[r.randrange(40)] = r.choice(["grubling", "snotface"])
        out.append((" ".join(w) + ".", k % 3 == 0))
    return out


def test_toxicity_learns_and_reads_clauses():
    model = toxicity.fit(toxic_texts())
    assert model.score("cela grubling gusen") > 0.8 > 0.5 > model.score("cela gusen") > 0
    assert model.score(None) == model.score("") == model.score("dimos")
    bare, negated, reported = (model.score(t) for t in ("a snotface.", "not a snotface.", "they said a snotface."))
    assert negated < bare and reported < bare
    assert model.score("Not me. Snotface") == model.score("snotface")
    unlearnt = toxicity.fit([])
    score = unlearnt.score
    assert score("I will kill you") > 0.5 > score("I will kill time") > score("I will never kill you") > score("hello")
    assert score("you idiot") > score("idiot") > 0.5 > score("not an idiot") and score("you idiot, he said") < score("you idiot, he did")
    assert score("you idiot. he said") == score("you idiot")


def test_toxicity_held_out():
    con = duckdb.connect()
    rows = con.execute("SELECT doc_id, coalesce(text, ''), toxic FROM '/root/testdata/sf0.1/documents.parquet' JOIN '/root/testdata/sf0.1/labels.parquet' USING (doc_id)").fetchall()
    held = lambda k: zlib.crc32(str(k).encode()) % 5 == 0
    model = toxicity.fit(sorted({(t, bool(y)) for k, t, y in rows if not held(k)}))
    said = [(model.score(t) >= 0.5, bool(y)) for k, t, y in rows if held(k)]
    hits = sum(a and b for a, b in said)
    assert hits / sum(b for _, b in said) > 0.9 and hits / sum(a for a, _ in said) > 0.9


def test_toxicity_rows(spark):
    texts = toxic_texts()
    docs = spark.createDataFrame([(k, t, 0.5, "x") for k, (t, _) in enumerate(texts)] + [(500, None, 0.1, None), (None, "grubling", None, None)], "doc_id long, text string, score double, toxic string")
    labels = spark.createDataFrame([(k, int(y)) for k, (_, y) in enumerate(texts)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, shared.crc_mod("doc_id", 5) != 0)
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, model).collect()}
    assert len(got) == len(texts) + 2 and all(got[k].predicted == int(y) for k, (_, y) in enumerate(texts))
    assert got[500].predicted == 0 and got[None].predicted == 1
    assert toxicity.toxicity_scores(docs.limit(0), model).count() == 0


def test_a_much_copied_text_teaches_no_stems():
    copied = " ".join(f"{x}odd" for x in PLAIN[:30]) + " grubling"
    texts = toxic_texts() + [(f"{copied} {x}", True) for x in PLAIN[:20]]
    assert not any("odd" in s for s in toxicity.learn_stems(texts))


def test_elias_fano():
    rng = np.random.default_rng(0)
    for top, n in ((0, 1), (5, 40), (10**6, 1000), (2**40, 300), (3, 0)):
        values = np.sort(rng.integers(0, top + 1, n))
        ef = lm.EliasFano.of(values)
        at = np.arange(n)
        assert (ef[at] == values).all()
        if n:
            probe = np.r_[values, rng.integers(0, top + 2, 200)]
            lo = rng.integers(0, n + 1, len(probe))
            hi = np.maximum(lo, rng.integers(0, n + 1, len(probe)))
            found = ef.find(probe, lo, hi)
            for p, a, b, f in zip(probe, lo, hi, found, strict=True):
                places = np.flatnonzero(values[a:b] == p) + a
                assert (f == -1) == (not len(places)) and (f == -1 or values[f] == p and a <= f < b)


def tokens_of(text):
    return [*(text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split(), None]


def reference_scores(rows, least):
    """The model by its definition, without quantisation."""
    train = [tokens_of(t) for k, t in rows if zlib.crc32(b"" if k is None else str(k).encode()) % 7 != 2]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    kept = {w for w, x in c.items() if x >= least}
    pairs, triples = Counter(), Counter()
    for t in train:
        s = ["<s>", *t]
        pairs.update(p for p in zip(s, s[1:], strict=False) if p[1] in kept and (p[0] in kept or p[0] == "<s>"))
    pairs = {p: x for p, x in pairs.items() if x >= least}
    for t in train:
        s = ["<s>", *t]
        triples.update(p for p in zip(s, s[1:], s[2:], strict=False) if p[:2] in pairs and p[1:] in pairs)
    triples = {p: x for p, x in triples.items() if x >= least}
    total = {w: c[w] for w in kept} | {"<s>": len(train)}
    left2, left3 = {u: 1.0 for u in total}, {p: 1.0 for p in pairs}
    for (a, _), x in pairs.items():
        left2[a] -= (x - lm.DISCOUNT) / total[a]
    for (a, b, _), x in triples.items():
        left3[a, b] -= (x - lm.DISCOUNT) / pairs[a, b]

    def p(a, b, w):
        out = (c[w] + 1) / (n + v + 1)
        out = (pairs[b, w] - lm.DISCOUNT) / total[b] + left2[b] * out if (b, w) in pairs else left2.get(b, 1.0) * out
        return (triples[a, b, w] - lm.DISCOUNT) / pairs[a, b] + left3[a, b] * out if (a, b, w) in triples else left3.get((a, b), 1.0) * out

    out = {}
    for k, t in rows:
        s = [0, "<s>", *tokens_of(t)]
        out[k, t] = (len(s) - 2, sum(c[w] > 0 for w in s[2:]), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in s[2:]), sum(math.log10(p(*x)) for x in zip(s, s[1:], s[2:], strict=False)))
    return out


def test_lm_against_its_definition(spark):
    r = random.Random(5)
    words = [f"w{k}" for k in range(12)]
    rows = [(k, " ".join(r.choices(words, weights=range(12, 0, -1), k=r.randint(0, 40)))) for k in range(80)]
    rows += [(200, None), (201, ""), (202, "Never seen"), (None, "w1 W2 w3"), (203, "w1 w2 " * 2000)]
    df = spark.createDataFrame([(*x, 1, "g") for x in rows], "doc_id long, text string, n int, grp string").coalesce(2)
    got = lm.lm_scores(df, shared.crc_mod("doc_id", 7) != 2)
    want = {k: v for (k, _), v in reference_scores(rows, 2).items()}
    result = {x.doc_id: x for x in got.collect()}
    assert set(result) == set(want)
    for k, (n, known, total, base, score) in want.items():
        x = result[k]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (n, known, total)
        assert x.base_score == pytest.approx(base, rel=1e-9)
        assert x.score == pytest.approx(score, rel=0.02)
    assert lm.lm_scores(df.limit(0), F.lit(True)).count() == 0
    none = lm.lm_scores(df, F.lit(False)).collect()
    assert all(x.train_tokens == 0 and x.base_score == 0 and x.score == 0 for x in none)


def test_lm_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = lm.lm_scores(docs, shared.crc_mod("doc_id", 7) != 2).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1] * 0.99


def test_lm_keeps_rare_ngrams_at_any_size(spark, monkeypatch):
    """Pairs and triples that occur twice count among more than 2**21 training tokens, in many parts and with long texts in groups of their own or not."""
    rows = [(k, " ".join(f"f{k}x{j % 11}" for j in range(k * 7, k * 7 + 24))) for k in range(300)]
    rows += [(1000, "one rare phrase here"), (1001, "then one rare phrase here"), (1002, "one rare phrase here again")]
    rows += [(2000 + k, "fill " * 110_000) for k in range(24)]
    want = reference_scores(rows, 2)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    for parts, long in ((1 << 40, 1 << 16), (700_000, 1 << 20), (700_000, 100)):
        monkeypatch.setattr(lm, "PART_BYTES", parts)
        monkeypatch.setattr(lm, "LONG", long)
        monkeypatch.setattr(lm, "TASK_BYTES", parts)
        got = {x.doc_id: x for x in lm.lm_scores(df, shared.crc_mod("doc_id", 7) != 2).collect()}
        assert len(got) == len(rows)
        for (k, _), (n, known, total, base, score) in want.items():
            assert (got[k].n_tokens, got[k].n_known, got[k].train_tokens) == (n, known, total) and total > 1 << 21
            assert got[k].base_score == pytest.approx(base, rel=1e-9)
            assert got[k].score == pytest.approx(score, rel=1e-9)


def test_rejection_is_calibrated_on_unseen_texts(tongues):
    """Unseen texts of the languages stay, also with a passage of the other one; other letters and other words go."""
    r = random.Random(9)

    def rejected(text):
        raw = text.encode()
        entropies, n, _ = tongues.entropies(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        at = entropies[0].argmin()
        mean, spread, noise, z = tongues.limits[at]
        return entropies[0, at] > mean + max(z * math.sqrt(spread**2 + noise**2 / n[0]), langid.FLOOR * (math.log(tongues.alphabet.size) - mean))

    assert not any(rejected(text_of(k, r, n)) for k in WORDS for n in (3, 10, 30, 200) for _ in range(30))
    assert not rejected(text_of("xx", r, 60) + text_of("yy", r, 5))
    assert all(rejected("".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=n))) for n in (60, 300) for _ in range(20))
    assert rejected("не из этого мира " * 5)


def test_letters_of_all_scripts_are_symbols():
    r = random.Random(4)
    letters = {"el": "αβγδεζηθικλμνξοπ ", "ru": "абвгдежзийклмнопрсту ", "zz": "𐐨𐐩𐐪𐐫𐐬 "}
    made = lambda k, n: "".join(r.choices(letters[k], k=n))
    model = langid.fit([(k, made(k, 300)) for k in letters for _ in range(6)])
    assert model.alphabet.size == 2 + 16 + 20 + 5
    for name in letters:
        for text in (made(name, 20) + letters[name][0], made(name, 200).upper() + letters[name][0]):
            raw = text.encode()
            entropies, _, found = model.entropies(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            assert model.names[entropies[0].argmin()] == name and found[0] == sum(c.isalpha() for c in text)

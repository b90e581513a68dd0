import itertools
import random

import numpy as np
import pytest

from seriesmith.llm import ngram_join, shared
from seriesmith.llm.ngram_join import divide_skip, ngram_jaccard_join

SCHEMA = "doc_id long, text string, digest string, n int, label double"


def words_of(text):
    return (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()


def brute(rows, n, num, den):
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    links = [[] for _ in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
            links[i].append(j)
            links[j].append(i)
    out = []
    for i, (name, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            todo += (new := [k for k in links[todo.pop()] if k not in seen])
            seen.update(new)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        out.append((name, len(sets[i]), min(ids) if ids else None, len(links[i])))
    return sorted(out, key=str)


def corpus(seed, size=60):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = " ".join(r.choices(vocabulary, k=40))
    texts = []
    for _ in range(size):
        kind = r.random()
        if texts and kind < 0.5:
            w = r.choice(texts).split()
            for _ in range(r.randint(0, 5)):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocabulary)
            texts.append(" ".join(w))
        elif kind < 0.7:
            texts.append(passage + " " + " ".join(r.choices(vocabulary, k=r.randint(1, 60))))
        else:
            texts.append(" ".join(r.choices(vocabulary, k=r.choice([1, 2, 5, 30, 80, 200]))))
    return texts


@pytest.mark.parametrize("seed,n,num,den", [(1, 4, 85, 100), (2, 5, 80, 100), (3, 4, 3, 5)])
def test_join_against_all_pairs(spark, seed, n, num, den):
    odd = [None, "", " \t\n", "One", "one", "ONE two", "one\x0btwo", "é ü", "a b c d", "a b c d", "x " * 3000]
    rows = [(k, t) for k, t in enumerate(corpus(seed) + odd)] + [(3, "a b c d"), (None, "a b c d"), (None, None)]
    df = spark.createDataFrame([(*x, "clash", 1, None) for x in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, ngram_jaccard_join(df, n=n, num=num, den=den).collect()), key=str)
    assert got == brute(rows, n, num, den)


def test_large_components_and_hot_classes(spark, monkeypatch):
    """Blocks so small that components are split by size and into chunks, and a class that holds a third of all rows."""
    monkeypatch.setattr(ngram_join, "BLOCK", 150)
    monkeypatch.setattr(ngram_join, "PART", 200)
    monkeypatch.setattr(shared, "HOT", 5)
    texts = corpus(4, 50)
    passage = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    texts += [" ".join([*passage, *(f"z{k}" for k in range(j))]) for j in range(40)] + [texts[0]] * 50 + [None] * 3
    df = spark.createDataFrame([(k, t, "clash", 1, None) for k, t in enumerate(texts)], SCHEMA).repartition(3)
    got = sorted(map(tuple, ngram_jaccard_join(df, n=4, num=3, den=5).collect()), key=str)
    assert got == brute(list(enumerate(texts)), 4, 3, 5)


def test_empty_table(spark):
    assert ngram_jaccard_join(spark.createDataFrame([], SCHEMA)).collect() == []


def test_divide_skip_finds_all_links():
    rng = np.random.default_rng(0)
    base = [np.unique(rng.integers(0, 300, rng.integers(1, 80)).astype(np.uint64)) for _ in range(40)]
    sets = base + [np.unique(np.r_[s[: max(1, len(s) - 2)], rng.integers(0, 300, 1).astype(np.uint64)]) for s in base]
    want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 10 * len(set(sets[i]) & set(sets[j])) >= 8 * len(set(sets[i]) | set(sets[j]))}
    got = {tuple(sorted((q, int(p)))) for q, partners in divide_skip(sets, 8, 10) for p in partners}
    assert got == want and want


def test_words_and_their_hashes():
    texts = ["The  cat\tsat", "the cat", "", "Ä ä a", "cat"]
    raw = [t.encode() for t in texts]
    w, at = shared.words(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])])
    assert np.diff(at).tolist() == [3, 2, 0, 3, 1]
    assert w[0] == w[3] and w[1] == w[4] == w[8] and len({w[2], w[5], w[6], w[7]}) == 4

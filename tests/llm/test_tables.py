import hashlib
import os
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seriesmith.llm import queries, secrets, url_filter, vafile

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cursor = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted((tuple(r[columns.index(c)] for c in order) for r in cursor.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in order) for r in df.collect()), key=str) == want


def test_cascade_is_exact_on_its_universe(spark):
    listed = spark.range(300).select(F.concat(F.lit("k"), F.col("id") * 7).alias("key"))
    universe = spark.range(4000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    cascade = url_filter.Cascade.build(listed, universe)
    assert len(cascade.levels) > 1
    got = universe.select("key", cascade.lists(F.col("key")).alias("on")).collect()
    assert {r.key for r in got if r.on} == {f"k{7 * k}" for k in range(300)}
    empty = url_filter.Cascade.build(listed.limit(0), universe)
    assert universe.where(empty.lists(F.col("key"))).count() == 0
    assert url_filter.Cascade.build(listed, universe.limit(0)).levels


def test_a_large_list_and_a_large_corpus(spark, monkeypatch):
    """Sizes of the levels are those of the list; a list of several cascades judges alike."""
    listed = spark.range(6000).select(F.concat(F.lit("k"), F.col("id") * 5, F.lit(".com")).alias("key"))
    pages = spark.range(30_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.k"), F.col("id"), F.lit(".com/x")).alias("url"))
    cascade = url_filter.Cascade.build(listed, url_filter.corpus_keys(pages, 2))
    assert all(level.bits <= url_filter.sized(6000, 30_000)[0] for level in cascade.levels) and len(cascade.levels) < 12
    for most in (url_filter.MOST_BITS, 1 << 15):
        monkeypatch.setattr(url_filter, "MOST_BITS", most)
        got = url_filter.url_verdicts(pages, [], listed, 2)
        assert got.where((F.col("verdict") == "block") != (F.col("page_id") % 5 == 0)).count() == 0 and got.count() == 30_000


def test_urls(spark):
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
    cases = [
        (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("", "", "", None, "allow"), ("http://", "", "", None, "allow"),
        ("http://A.Example.ORG/es/x?y#z", "a.example.org", "/es/x", "example.org/es/", "block"), ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), ("http://org", "org", "", None, "allow"), ("x://bad.net?q=/a", "bad.net", "", None, "block"),
        ("x://sub.bad.net/p", "sub.bad.net", "/p", None, "block"), ("x://worsebad.net/p", "worsebad.net", "/p", None, "allow"), ("http://x.com/de/bad.net", "x.com", "/de/bad.net", "com/de/", "block"),
        ("http://a://b/c", "a:", "//b/c", None, "allow"), ("http://x.com/" + "p" * 5000, "x.com", "/" + "p" * 5000, None, "allow"), ("http://É.com/fr/#", "É.com", "/fr/", "com/fr/", "allow"),
    ]
    rows = [(k, c[0], "clash") for k, c in enumerate(cases)] + [(None, cases[4][0], "again")]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string")
    listed = spark.createDataFrame([("bad.net",), (None,)], "key string")
    got = url_filter.url_verdicts(df, rules, listed, 2)
    by = {r.page_id: tuple(r)[1:] for r in got.collect()}
    assert len(by) == len(rows)
    for k, c in enumerate(cases):
        assert by[k] == c[1:], c[0]
    assert by[None] == cases[4][1:]
    assert url_filter.url_verdicts(df.limit(0), rules, listed, 2).count() == 0


TOKEN = "Zx9" + "aB3" * 8


def test_secrets_and_owners(spark):
    key, own = "AKIA" + "ABCDEFGHIJ123456", "0123456789abcdef" * 2
    texts = [
        (1, f"é password = \"hunter2x\" and {own}", "a"), (2, None, "a"), (3, "", "b"), (4, f"{key} {key}", "b"), (5, f"x {key}", "c"), (6, f"api_key:{key}/z", "d"),
        (7, "token=abc secret: abcdef TOKEN='ABCDEF'", "a"), (8, f"see {TOKEN}.", "a"), (9, f"token={own}", None), (9, f"token={own}", None), (None, "AKIA12 passwd=12345", "e"), (10, f"{TOKEN} " * 300, "a"),
    ]
    df = spark.createDataFrame([(*t, "en", 1) for t in texts], "doc_id long, text string, source string, lang string, spans int")
    got = secrets.scan(df).collect()
    assert len(got) == len(texts)
    pattern = [re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")]
    for name, text, _ in texts:
        t = text or ""
        spans = sorted([(m.start(), 0, m.end()) for m in pattern[0].finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in pattern[1].finditer(t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in pattern[2].finditer(t) if len(m[0]) >= 24])
        base = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        for r in (r for r in got if r.doc_id == name):
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))
            assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
            assert set(base.split(",")) - {""} <= set(r.spans.split(","))
    by = {r.doc_id: r for r in got}
    assert by[4].n_copied == 2 and by[4].n_live == 0 and by[5].n_copied == 1
    assert by[1].n_live == 2 and by[9].n_live == 2  # a value of two owners is not widely copied
    assert by[8].n_owned == 1 and by[8].spans == f"owned:4:{4 + len(TOKEN)}" and by[10].n_owned == 300
    clean = {r.doc_id: r for r in secrets.redact(df).collect()}
    assert clean[8].text == "see [SECRET]." and clean[4].text == texts[3][1] and clean[2].text is None and clean[1].text == "é [SECRET]\" and [SECRET]"
    assert secrets.redact(df).columns == df.columns and secrets.scan(df.limit(0)).count() == 0


def test_many_matches_in_one_text(spark):
    """100,000 matches of several kinds, with mixed tokens between and in them, are scanned and masked in seconds."""
    values = [hashlib.md5(str(k).encode()).hexdigest() for k in range(50_000)]
    text = " ".join(f"{v} token={v[:8]}Zq{k}X{'y' * 16}" if k % 2 else f"é{v} {v[:10]}Zq{k}X{'y' * 16}" for k, v in enumerate(values))
    df = spark.createDataFrame([(1, text, "a", "en"), (2, "nothing", "a", "en"), (3, values[0], "b", "en")], "doc_id long, text string, source string, lang string")
    began = time.perf_counter()
    got = {r.doc_id: r for r in secrets.scan(df).collect()}
    clean = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert time.perf_counter() - began < 60
    assert (got[1].n_hex, got[1].n_assign, got[1].n_owned, got[1].n_live, got[2].spans, got[3].n_hex) == (50_000, 25_000, 25_000, 75_000, "", 1)
    want = sorted([(m.start(), 0, m.end()) for m in re.finditer(r"token=[A-Za-z0-9]+", text)] + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]{24,}", text)])
    base = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
    assert got[1].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert clean[1] == " ".join("[SECRET] [SECRET]" if k % 2 else "é[SECRET] [SECRET]" for k in range(50_000)) and clean[2] == "nothing" and clean[3] == "[SECRET]"


def test_masks_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(secrets, "BLOCK", 7)
    text = "ä" * 10 + f" token={'q' * 20} " + "m" * 30 + f" {TOKEN} x {TOKEN}"
    df = spark.createDataFrame([(1, text, "a", "en"), (2, TOKEN, "a", "en")], "doc_id long, text string, source string, lang string")
    assert {r.doc_id: r.text for r in secrets.redact(df).collect()} == {1: "ä" * 10 + " [SECRET] " + "m" * 30 + " [SECRET] x [SECRET]", 2: "[SECRET]"}


def brute_top(rows, k=5):
    ok = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, q in ok:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in ok if j != i and len(v) == len(q))[:k]
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(best)}
    return out


def test_top_k_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(k, [float(x) for x in rng.normal(0, 1, 8)]) for k in range(180)]
    rows += [(k, rows[k % 7][1]) for k in range(200, 260)]  # ties
    rows += [(300, None), (301, []), (350, [1.0, None] * 4), (302, [float("nan")] * 8), (400, [float("inf")] * 8), (None, [1.0] * 8), (450, [0.5, 0.25]), (451, [0.5, -0.25]), (452, [0.0, 0.0]), (500, [1e6] * 8)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = brute_top(exact)
    assert {tuple(r) for r in vafile.top_k(df).collect()} == want
    monkeypatch.setattr(vafile, "BLOCK", 16)
    monkeypatch.setattr(vafile, "ROWS", 7)
    assert {tuple(r) for r in vafile.top_k(df).collect()} == want
    assert vafile.top_k(df.limit(0)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(3)
    for most in (3, 500, 10**9):
        x, q = rng.integers(-most, most, (200, 16)).astype(float), rng.integers(-most, most, (20, 16)).astype(float)
        cells, width = vafile.approximate(x.ravel(), np.arange(201) * 16)
        low, high = vafile.bounds(cells.reshape(200, 16), width, q)
        exact = q @ x.T
        assert (low <= exact).all() and (exact <= high).all() and (high - low < 0.2 * most * np.abs(q).sum(1)[:, None]).all()


def test_few_exact_vectors_are_read():
    """Of 2000 vectors the cells leave a few for each query, counting those read before a first bound was known."""
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (2000, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True))
    cells, width = vafile.approximate(x.ravel(), np.arange(2001) * 64)
    best = vafile.Best(np.arange(100), x[:100], 5)
    for a in range(0, 2000, 500):
        best.scan(np.arange(a, a + 500), width[a : a + 500], cells.reshape(2000, 64)[a : a + 500], lambda rows, a=a: x[a + rows])
    for q in range(100):
        scores = (x @ x[q]).astype(int)
        assert best.found[q] == sorted((-int(scores[k]), k) for k in range(2000) if k != q)[:5]
    assert best.reads < 0.03 * 100 * 2000


STEMS = [a + b for a in ("bar", "cel", "dim", "fop", "gus") for b in ("ab", "er", "im", "on")]


def test_pipeline_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "toxicity", "n-gram Jaccard join", "secret scans", "best-fit packing"]
    base = [f"the quiet river number{k} runs over old stones and under the tall bridge towards the wide sea every day of this year" for k in range(30)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(100, base[0]), (101, base[0] + " again"), (102, None), (103, "1234"), (104, base[5] + " token = abcdef123456"), (None, base[7].replace("river", "canal") + " x y z u v")]
    rows += [(200 + k, f"{STEMS[k]}a different {STEMS[k]}en grubling {STEMS[k]}os about {STEMS[k]}ut nothing {STEMS[k]}il here") for k in range(20)]
    docs = spark.createDataFrame([(k, t, "en", f"s{(k or 0) % 5}", len(t or ""), "c") for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, `kept_0` string")
    labels = spark.createDataFrame([(k, 1, int(k >= 200)) for k, _ in rows if k is not None], "doc_id long, quality int, toxic int")
    docs.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stage = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids, seen = {k for k, _ in rows}, []
    for n, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, stage, str(tmp_path)).write.parquet(f"{tmp_path}/{n}")
        stage = spark.read.parquet(f"{tmp_path}/{n}")
        seen.append(stage)
        assert n == 4 or stage.columns == docs.columns
    assert {r.doc_id for r in seen[0].collect()} == ids - {102, 103}
    assert {r.doc_id for r in seen[1].collect()} == ids - {102, 103} - set(range(200, 220))

    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    left = [(r.doc_id, grams(r.text)) for r in seen[1].collect()]
    group = list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            a, b = left[i][1], left[j][1]
            if 100 * len(a & b) >= 80 * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    stay = [r.doc_id for r in seen[2].collect()]
    assert len(stay) == len(set(group))
    assert {group[[x[0] for x in left].index(k)] for k in stay} == set(group)
    masked = {r.doc_id: r for r in seen[3].collect()}
    assert set(masked) == set(stay) and all(r.n_chars == len(r.text) for r in masked.values())
    assert not any("abcdef123456" in r.text for r in masked.values())
    assert {r.doc_id for r in seen[4].collect()} == set(stay)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(stay)
    assert os.path.isdir(f"{tmp_path}/3")


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, `row` string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for n, (_, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, docs, str(tmp_path))
        assert out.count() == 0 and (n == 4 or out.columns == docs.columns)


def test_the_pipeline_masks_what_is_not_widely_copied(spark):
    two, three, hot, mixed = "AKIA" + "A" * 16, "AKIA" + "D" * 16, "AKIA" + "E" * 16, TOKEN
    rows = [(two, s, "en") for s in "ab"] + [(three, s, "en") for s in "abc"] + [(hot, "a", lang) for lang in ("de", "en", "es", "fr")] + [(mixed, s, "en") for s in "ab"]
    docs = spark.createDataFrame([(k, f"see {v}.", lang, s, len(v) + 5) for k, (v, s, lang) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars int")
    clean = {r.doc_id: r.text for r in corpus_pipeline.secret_scan(spark, docs, "").collect()}
    for k, (v, _, _) in enumerate(rows):
        assert clean[k] == ("see [SECRET]." if v in (two, mixed) else f"see {v}.")
    found = secrets.find(docs, keep=("doc_id",), many=secrets.MANY).collect()
    assert len(found) == len(rows) and all(len(r.live) + len(r.copied) == len(r.base) for r in found)

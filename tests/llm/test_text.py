import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from seriesmith.llm import bpe, media, packing, queries

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["", "Hello, world's  best\n\n test", "naïve Straße ½ ² Ⅷ 12345", "𝒳𝒴 emoji 😀😀", "a" * 500, " " * 70 + "x", "\x1c\x1d tab\tend\r\n", "don't 're 'll", "日本語のテキスト", "<|endoftext|> x", "​﻿　 z", "ß" * 40]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def noise(seed, n=200):
    r = random.Random(seed)
    return "".join(r.choice("abcde fg.,'\n0123é ß日😀\x1c²") for _ in range(n))


def test_encoding_is_the_librarys(library):
    own = bpe.load(RANKS, P.PATTERN)
    for t in TEXTS + [noise(k) for k in range(60)]:
        assert own.encode(t) == library.encode_ordinary(t)
        assert own.decode(own.encode(t)) == t.encode()


def test_prefixes_append_and_edit():
    own = bpe.load(RANKS, P.PATTERN)
    r = random.Random(4)
    for _ in range(60):
        piece = bytes(r.choice(b"theringabout") for _ in range(r.randint(1, 60)))
        table = own.prefixes(piece)
        for k in range(1, len(piece) + 1):
            assert own.tokens(table[: k + 1]) == own.merge(piece[:k])
        more = bytes(r.choice(b"xyzing") for _ in range(8))
        assert own.prefixes(piece + more, list(table)) == own.prefixes(piece + more)
        a = r.randrange(len(piece))
        b = r.randint(a, len(piece))
        new, changed = own.edited(piece, table, a, b, more[: r.randint(0, 8)])
        assert changed == own.prefixes(new)


def test_digests_of_odd_rows(spark, library):
    rows = [(k, t, "clash") for k, t in enumerate(TEXTS)] + [(0, None, None), (None, "x", "y"), (1, TEXTS[1], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df, RANKS, P.PATTERN).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {(k, len(ids := library.encode_ordinary(t or "")), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())) for k, t, _ in rows}
    assert got == want
    assert bpe.digests(df.limit(0), RANKS, P.PATTERN).count() == 0
    back = bpe.decode(bpe.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert sorted(bytes(r.bytes) for r in back) == sorted((t or "").encode() for _, t, _ in rows)


@pytest.mark.parametrize("samples", [1, 2, 3, 4])
def test_png_round_trip_and_every_filter(samples):
    rng = np.random.default_rng(samples)
    pixels = rng.integers(0, 256, (9, 7, samples)).astype(np.uint8)
    assert (media.read_png(media.write_png(pixels)) == pixels).all()
    raw = pixels.reshape(9, -1).astype(int)
    rows = []
    for y in range(9):
        kind, line = y % 5, [y % 5]
        for x in range(raw.shape[1]):
            a = raw[y, x - samples] if x >= samples else 0
            b = raw[y - 1, x] if y else 0
            c = raw[y - 1, x - samples] if y and x >= samples else 0
            p = a + b - c
            paeth = min((abs(p - v), k, v) for k, v in enumerate((a, b, c)))[2]
            line.append((raw[y, x] - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
        rows.append(bytes(line))
    head = media.write_png(pixels)[8:33]
    data = media.SIGNATURE + head + media._chunk(b"IDAT", zlib.compress(b"".join(rows))) + media._chunk(b"IEND", b"")
    assert (media.read_png(data) == pixels).all()


def test_damaged_images_are_refused():
    good = media.write_png(np.zeros((3, 4, 3), np.uint8))
    for bad in (b"", good[:-3], good[:20] + b"x" + good[21:], good.replace(b"IDAT", b"IDOT"), b"x" + good):
        with pytest.raises(media.PngError):
            media.read_png(bad)


def test_images_of_texts(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "é" * 96, 1), (4, "é" * 96, 2), (None, "x" * 193, 1), (5, "long " * 50_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, image int")
    got = media.image_features(media.text_images(df)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for name, text, _ in rows:
        raw = (text or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        r = by[name]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert by[3][1:] == by[4][1:] and by[1][1:] == by[2][1:]
    assert media.image_features(media.text_images(df.limit(0))).count() == 0


def test_similar_images_have_near_hashes():
    rng = np.random.default_rng(1)
    smooth = np.kron(rng.integers(20, 230, (8, 8)), np.ones((8, 8))).astype(np.uint8)[:, :, None].repeat(3, 2)
    noisy = np.clip(smooth.astype(int) + rng.integers(-3, 4, smooth.shape), 0, 255).astype(np.uint8)
    other = rng.integers(0, 256, smooth.shape).astype(np.uint8)
    far = lambda a, b: (int(media.cosine_hash(a), 16) ^ int(media.cosine_hash(b), 16)).bit_count()
    assert far(smooth, noisy) < 8 < far(smooth, other)


def cosine_hash_by_definition(pixels):
    """Every coefficient by its sum, over the means of the blocks, or nearest rows and columns, of the grey image."""
    grey = pixels.astype(float).mean(2)
    height, width = grey.shape

    def span(k, n):
        lo = k * n // 32
        return slice(lo, max(lo + 1, (k + 1) * n // 32)) if n >= 32 else slice(lo, lo + 1)

    small = [[grey[span(y, height), span(x, width)].mean() for x in range(32)] for y in range(32)]
    low = [round(sum(small[y][x] * math.cos(math.pi / 32 * (y + 0.5) * u) * math.cos(math.pi / 32 * (x + 0.5) * v) for y in range(32) for x in range(32)), 6) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    bits = "0" + "".join(str(int(c > middle)) for c in low[1:])
    return f"{int(bits, 2):016x}"


def test_cosine_hash_against_its_definition():
    rng = np.random.default_rng(8)
    for height, width, samples in ((64, 64, 3), (40, 64, 1), (5, 64, 3), (100, 33, 4), (1, 1, 2)):
        pixels = rng.integers(0, 256, (height, width, samples)).astype(np.uint8)
        assert media.cosine_hash(pixels) == cosine_hash_by_definition(pixels)


def test_pieces_and_packing(spark):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    long = " ".join(f"word{k}" for k in range(3000))
    texts = [*TEXTS, None, long, "one two " * 700, *[noise(k, 900) for k in range(40)]]
    rows = [(k, t, "clash") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    pieces = packing.token_pieces(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for rule, weights in (("norm", (1.0, 0.0, 0.0)), ("dot", (1.0, 0.1, 0.1))):
        got = packing.pack(pieces, documents=6, rule=rule, weights=weights).collect()
        sequences = {}
        for r in got:
            sequences.setdefault(r.sequence_id, []).append(r)
        for part in sequences.values():
            part.sort(key=lambda r: r.offset)
            assert [r.offset for r in part] == np.r_[0, np.cumsum([r.length for r in part])[:-1]].tolist()
            assert sum(r.length for r in part) <= 2048 and len(part) <= 6
        for k, t, _ in rows:
            ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
            mine = sorted((r for r in got if r.doc_id == k), key=lambda r: r.piece)
            assert b"".join(bytes(r.ids) for r in mine) == ids.tobytes()
            assert [r.start for r in mine] == np.r_[0, np.cumsum([r.length for r in mine])[:-1]].tolist()
            assert len(mine) == 1 or all(r.length == 2048 for r in mine[1:])
    assert packing.pack(pieces.limit(0)).count() == 0
    plain = packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    assert {"sequence_id", "offset", "ids_crc32"} <= set(plain.columns)


def test_best_fit_is_close_to_the_bound():
    rng = np.random.default_rng(2)
    lengths = np.minimum(2048, rng.geometric(1 / 400, 3000))
    bins, offsets, made = packing.best_fit(lengths, (2048, 2048, 2048.0**2), (1.0, 0.0, 0.0))
    assert np.bincount(bins, lengths).max() <= 2048 and len(set(bins)) == made
    assert made <= 1.01 * lengths.sum() / 2048 + 1
    assert packing.best_fit(np.empty(0, np.int64), (2048, 2, 9.0), (1, 1, 1))[2] == 0


def naive_best_fit(lengths, limits, weights):
    """Vector best fit by its definition: every bin is looked at for every piece."""
    bins, out = [], [0] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        need = (float(lengths[k]), 1.0, float(lengths[k]) ** 2)
        best = None
        for at, room in enumerate(bins):
            left = [r - n for r, n in zip(room, need, strict=True)]
            if min(left) >= 0:
                norm = sum(w * (x / m) ** 2 for x, w, m in zip(left, weights, limits, strict=True))
                if best is None or norm < best[0] - 1e-12:
                    best = norm, at, left
        if best is None:
            bins.append([m - n for m, n in zip(limits, need, strict=True)])
            out[k] = len(bins) - 1
        else:
            bins[best[1]], out[k] = best[2], best[1]
    return out


def test_best_fit_against_brute_force():
    rng = np.random.default_rng(4)
    for limits, weights in (((2048, 64, 2048.0**2), (1.0, 1.0, 1.0)), ((2048, 5, 2048.0**2), (1.0, 1.0, 1.0)), ((2048, 2048, 2048.0**2), (1.0, 0.0, 0.0))):
        lengths = np.minimum(2048, rng.geometric(1 / 200, 400))
        bins, offsets, made = packing.best_fit(lengths, limits, weights)
        assert bins.tolist() == naive_best_fit(lengths.tolist(), limits, weights)
        for b in range(made):
            mine = np.flatnonzero(bins == b)
            mine = mine[np.argsort(offsets[mine])]
            assert offsets[mine].tolist() == np.r_[0, np.cumsum(lengths[mine])[:-1]].tolist() and len(mine) <= limits[1]
    lengths = np.minimum(2048, rng.geometric(1 / 200, 2000))
    assert (packing.best_fit(lengths, (2048, 64, 2048.0**2), packing.WEIGHTS)[0] != packing.best_fit(lengths, (2048, 2048, 2048.0**2), (1.0, 0.0, 0.0))[0]).any()


def test_long_runs_of_white_space(spark):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ranks, added = P.path("byte_bpe_50k.tiktoken"), packing.added_tokens(P.path("byte_bpe_50k.json"))
    for text in (" " * 9000 + "x", "a" + "\n" * 9000, "\t \n" * 4000 + "<|endoftext|>" + " " * 5000, "word" * 5000):
        assert packing.token_ids(text, ranks, P.PATTERN, added).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    text = {1: " " * 1_000_000, 2: "\n" * 1_000_000, 3: "a" * 1_000_000}
    docs = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    got = packing.token_pieces(docs, ranks, P.PATTERN, added=added).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    plain = bpe.load(ranks, P.PATTERN)
    assert {r.doc_id: r.n for r in got} == {k: len(plain.encode(t)) + 1 for k, t in text.items()}


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(k, 5, "a", 9, 9, "b") for k in range(7)], "doc_id long, length long, `group` string, sequence_id int, offset int, `a``b` string")
    got = packing.pack(df)
    assert got.columns == ["doc_id", "length", "group", "a`b", "sequence_id", "offset"] and got.count() == 7
    assert {r.group for r in got.collect()} == {"a"} and got.select("sequence_id", "offset").distinct().count() == 7


def test_added_tokens_are_the_librarys(spark, tmp_path):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"one {end} two", end, f"{end}{end}", f"a  {end}  b \n{end}\n", f"x{end}y <|endoftext|", f"{end} " * 3000, "plain"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {k: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4") for k, t in enumerate(texts)}
    assert len(want[0]) == 5
    got = queries.op9_best_fit_packing(spark, str(tmp_path)).collect()
    stage = corpus_pipeline.best_fit_packing(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()
    for rows in (got, stage):
        assert {r.doc_id for r in rows} == set(want)
        for r in rows:
            assert r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes())
        assert all(sum(r.length for r in rows if r.doc_id == k) == len(ids) for k, ids in want.items())


def test_documents_of_a_sequence_are_limited_in_production(spark, tmp_path):
    spark.createDataFrame([(k, "short") for k in range(300)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    stage = corpus_pipeline.best_fit_packing(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    for df in (queries.op9_best_fit_packing(spark, str(tmp_path)), stage):
        counts = [r["count"] for r in df.groupBy("sequence_id").count().collect()]
        assert sum(counts) == 300 and len(counts) == 5 and max(counts) <= 64
    assert all(w > 0 for w in packing.WEIGHTS)

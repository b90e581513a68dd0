"""N-gram Jaccard join by T-occurrence search.

1. Every text becomes its sorted set of word-shingle hashes; equal sets are one
   class, so exact copies cost one row.
2. Shingles are counted over all classes. They travel to their part of the hash
   range in packed blocks, seven bytes a shingle, and those of several classes
   come back with their counts. A class that shares fewer of its shingles with
   others than a link needs has none. Each other class keeps its rarest: two
   linked sets share one at least of their prefixes, 1 + size - required overlap
   shingles in the order of frequency. The most common shingles are told to all
   tasks, come last in that order, and do not travel.
3. Classes that share a prefix shingle are joined to the first of them, a star
   and never all pairs, and connected ones share a block; one that grows beyond a
   block is split by size, as linked sets are of like sizes, and sets of two
   neighbouring sizes that are still too many into pairs of chunks.
4. In a block, DivideSkip answers each set's T-occurrence query: the short
   inverted lists are merged as sorted runs, the long ones probed by binary
   search, and sets that reach the required overlap are links.

Nothing is sampled or capped: every link between different sets is found.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Bits a set of the filter that keeps sets without candidates out of the shuffle, and bits of it at most: with more sets it lets more others pass, which the join after it drops.
FILTER_BITS, MOST_FILTER = 8, 1 << 27
#: So many common shingles are told to the tasks at most.
COMMON = 1 << 16
#: Shingles of a block.
BLOCK = 1_000_000
SALTS = 16
#: Shingles of a part of the hash range, and bits of a shingle that tell it from others of its part.
PART, LOW_BITS = 1_000_000, 40
#: Frequencies of shingles are counted up to this.
MOST_DF = 1 << 31


def _sets(batch, text: str, n: int):
    data, offsets = shared.utf8(batch.column(text))
    for i, j in shared.slices(offsets):
        yield from zip(range(i, j), shared.shingle_sets(data, offsets[i : j + 1], n), strict=True)


def _parts(batches, rows: int = 1024):
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def _profile(text: str, n: int):
    """Per row its class; besides, shingles that several sets of a batch share, with how many."""

    def run(batches):
        for batch in batches:
            ids, sizes, names, distinct = batch.column("doc_id"), [], [], {}
            for _, s in _sets(batch, text, n):
                name = shared.digest(s)
                sizes.append(len(s))
                names.append(name)
                distinct.setdefault(name, s)
            k = len(names)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array([True] * k)], ["doc_id", "digest", "n", "is_doc"])
            every = np.sort(np.concatenate([*distinct.values(), np.empty(0, np.uint64)]))
            if len(every):
                first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
                times = np.diff(np.r_[first, len(every)])
                hot = times >= 3
                if hot.any():
                    yield pa.RecordBatch.from_arrays([pa.nulls(int(hot.sum()), pa.int64()), pa.array(shared.signed(every[first[hot]])), pa.array(times[hot].astype(np.int64)), pa.array([False] * int(hot.sum()))], ["doc_id", "digest", "n", "is_doc"])

    return run


_EMITTED = "batch long, part int, names array<bigint>, sizes array<int>, commons array<int>, owners binary, low binary, df binary"


def _emitted(batch, part, names=(), sizes=(), commons=(), owners=(), low=(), df=()):
    """Rows of _EMITTED; columns that are left out are null."""
    n = len(batch)
    fill = lambda x: x if len(x) else [None] * n
    kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary())
    return [pa.array(fill(x), k) for x, k in zip((batch, part, names, sizes, commons, owners, low, df), kinds, strict=True)]


_NAMES = [x.split()[0] for x in _EMITTED.split(", ")]


def _emit(text: str, n: int, common, parts: int):
    """Each batch's classes, as a row with a negative part, and their shingles in a block for each part."""

    def run(batches):
        hot, rank = common.value
        task = TaskContext.get().partitionId()
        for count, batch in enumerate(_parts(batches, 2048)):
            uid, classes = (task << 24) + count, {}
            for _, s in _sets(batch, text, n):
                if len(s):
                    classes.setdefault(shared.digest(s), s)
            if not classes:
                continue
            sizes = np.array([len(s) for s in classes.values()])
            tokens, owner = np.concatenate(list(classes.values())), np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
            commons: list[list[int]] = [[] for _ in sizes]
            if len(hot):
                place = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
                is_hot = hot[place] == tokens
                found, of = rank[place[is_hot]], owner[is_hot]
                for k, r in zip(*(x[np.lexsort((-found, of))].tolist() for x in (of, found)), strict=True):
                    commons[k].append(r)  # the least common first
                tokens, owner = tokens[~is_hot], owner[~is_hot]
            flat = [len(c) for c in commons] + [r for c in commons for r in c]
            yield pa.RecordBatch.from_arrays(_emitted([uid], [-1 - uid % parts], [list(classes)], [sizes.tolist()], [flat]), _NAMES)
            part = (tokens >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            order = np.argsort(part.astype(np.uint16 if parts < 1 << 16 else np.uint32), kind="stable")
            part, owner = part[order].astype(np.int64), owner[order]
            low = np.ascontiguousarray(tokens[order].view(np.uint8).reshape(-1, 8)[:, : LOW_BITS // 8])
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else []
            spans = list(itertools.pairwise(cuts))
            if spans:
                yield pa.RecordBatch.from_arrays(_emitted([uid] * len(spans), part[cuts[:-1]], owners=[owner[a:b].tobytes() for a, b in spans], low=[low[a:b].tobytes() for a, b in spans]), _NAMES)

    return run


def _unpack(column) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, LOW_BITS // 8)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, : LOW_BITS // 8] = raw
    return wide.view(np.int64).ravel()


def _count(key, group):
    """A part's shingles that several classes have, with how many, in a row for each batch; rows of classes pass."""
    if key[0].as_py() < 0:
        return group
    low = _unpack(group.column("low"))
    sizes = [len(x) // 2 for x in group.column("owners").to_pylist()]
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(low, kind="stable")
    first = np.flatnonzero(np.r_[True, low[order][1:] != low[order][:-1]]) if len(low) else np.empty(0, np.int64)
    times = np.diff(np.r_[first, len(low)])
    df = np.empty(len(low), np.uint32)
    df[order] = np.repeat(np.minimum(times, MOST_DF), times)
    keep = df > 1
    owners = np.frombuffer(b"".join(group.column("owners").to_pylist()), np.uint16)[keep]
    cuts = np.r_[0, np.cumsum(np.bincount(row[keep], minlength=len(sizes)))]
    low, df = low[keep], df[keep]
    raw = np.ascontiguousarray(low.view(np.uint8).reshape(-1, 8)[:, : LOW_BITS // 8])
    spans = [(k, a, b) for k, (a, b) in enumerate(itertools.pairwise(cuts)) if b > a]
    uid = group.column("batch").to_pylist()
    out = _emitted([uid[k] for k, _, _ in spans], [key[0].as_py()] * len(spans), owners=[owners[a:b].tobytes() for _, a, b in spans], low=[raw[a:b].tobytes() for _, a, b in spans], df=[df[a:b].tobytes() for _, a, b in spans])
    return pa.Table.from_arrays(out, _NAMES)


def _pick(num: int, den: int):
    """A batch's prefix shingles: (sig, salt, digest) of classes that share enough shingles with others."""

    def run(group):
        rows = group.to_pylist()
        token, owner, df = [np.empty(0, np.int64)], [np.empty(0, np.uint16)], [np.empty(0, np.uint32)]
        about = next(r for r in rows if r["part"] < 0)
        for r in rows:
            if r["part"] >= 0:
                low = _unpack(pa.array([r["low"]], pa.binary()))
                token.append(low + (r["part"] << LOW_BITS))
                owner.append(np.frombuffer(r["owners"], np.uint16))
                df.append(np.frombuffer(r["df"], np.uint32))
        token, owner, df = map(np.concatenate, (token, owner, df))
        order = np.lexsort((token, df, owner))
        token, classes = token[order], len(about["names"])
        start = np.r_[0, np.cumsum(np.bincount(owner, minlength=classes))]
        lens, ranks = about["commons"][:classes], about["commons"][classes:]
        sig, salt, digest, at = [], [], [], 0
        for k, (name, n, c) in enumerate(zip(about["names"], about["sizes"], lens, strict=True)):
            mine, hot = token[start[k] : start[k + 1]], ranks[at : at + c]
            at += c
            need = -(-num * n // den)
            shared_ = len(mine) + c
            if shared_ < need:
                continue
            take = n - need + 1 - (n - shared_)  # shingles of no other class come first
            some = mine[: max(0, take)].tolist()
            more = [-1 - r for r in hot[: max(0, take - len(mine))]]
            sig += some + more
            salt += [-1] * len(some) + [name % SALTS] * len(more)
            digest += [name] * (len(some) + len(more))
        return pa.table({"sig": pa.array(sig, pa.int64()), "salt": pa.array(salt, pa.int8()), "digest": pa.array(digest, pa.int64())})

    return run


def _stars(batches):
    """Sorted by (sig, salt, digest): an edge from the first of a run to each other; a salted run is tied to its shingle too."""
    last = hub = None
    for batch in batches:
        sig, salt, name = (np.asarray(batch.column(k)) for k in ("sig", "salt", "digest"))
        if not len(sig):
            continue
        first = np.r_[last != (sig[0], salt[0]), (sig[1:] != sig[:-1]) | (salt[1:] != salt[:-1])]
        head = np.maximum.accumulate(np.where(first, np.arange(len(sig)), -1))
        hubs = np.where(head >= 0, name[head], hub if hub is not None else 0)
        last, hub = (sig[-1], salt[-1]), hubs[-1]
        other = hubs != name
        tied = first & (salt >= 0)
        a, b = np.r_[hubs[other], sig[tied]], np.r_[name[other], name[tied]]
        if len(a):
            pairs = np.unique(np.rec.fromarrays([a, b], names="a,b"))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs.a)), pa.array(np.ascontiguousarray(pairs.b))], ["a", "b"])


def _member_sets(text: str, n: int, wanted):
    """(digest, shingles) of the classes that the filter has, once a batch."""

    def run(batches):
        bits = wanted.value
        size = len(bits) << 6
        for batch in _parts(batches):
            found = {}
            for _, s in _sets(batch, text, n):
                name = shared.digest(s)
                at = name % size
                if len(s) and name not in found and bits[at >> 6] >> (at & 63) & 1:
                    found[name] = shared.signed(s)
            lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(x) for x in found.values()])].astype(np.int32), np.concatenate([*found.values(), np.empty(0, np.int64)]))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), lists], ["digest", "shingles"])

    return run


def divide_skip(sets: list[np.ndarray], num: int, den: int, side: np.ndarray | None = None, above: np.ndarray | None = None):
    """Yields (query, partners): positions in sets, each pair with den * overlap >= num * union once.

    side: if given, only pairs with different sides count; above: if given, not pairs of which both have it.
    """
    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    size = np.array([len(sets[k]) for k in order], np.int64)
    if not len(order) or not size[-1]:
        return
    docs, total = len(order), int(size.sum())
    tokens = np.concatenate([sets[k] for k in order])
    owner = np.repeat(np.arange(docs), size)
    by = np.argsort(tokens, kind="stable")
    sorted_tokens = tokens[by]
    first = np.flatnonzero(np.r_[True, sorted_tokens[1:] != sorted_tokens[:-1]])
    length = np.diff(np.r_[first, total])
    token_of = np.empty(total, np.int64)
    token_of[by] = np.repeat(np.arange(len(first)), length)
    postings = owner[by]
    keyed = np.repeat(np.arange(len(first)), length) * docs + postings  # ascending
    start = np.r_[0, np.cumsum(size)]
    order = np.array(order)
    for q in range(1, docs):
        a = int(size[q])
        low = int(np.searchsorted(size, -(-num * a // den), "left"))
        if low >= q:
            continue
        mine = token_of[start[q] : start[q + 1]]
        mine = mine[length[mine] > 1]
        need = -(-num * (a + int(size[low])) // (num + den))
        if len(mine) < need:
            continue
        left = np.searchsorted(keyed, mine * docs + low)
        right = np.searchsorted(keyed, mine * docs + q)
        lens = right - left
        used = lens > 0
        if int(used.sum()) < need:
            continue
        mine, left, lens = mine[used], left[used], lens[used]
        by_len = np.argsort(-lens, kind="stable")
        longest = int(lens[by_len[0]])
        long = min(need - 1, int(need / (0.01 * math.log2(longest + 1) + 1)))
        short = by_len[long:]
        take = np.concatenate([postings[x : x + y] for x, y in zip(left[short].tolist(), lens[short].tolist(), strict=True)])
        take.sort(kind="stable")  # merges the sorted runs
        head = np.flatnonzero(np.r_[True, take[1:] != take[:-1]])
        hits = np.diff(np.r_[head, len(take)])
        keep = hits >= need - long
        found, hits = take[head[keep]], hits[keep]
        if side is not None:
            differ = side[order[found]] != side[order[q]]
            found, hits = found[differ], hits[differ]
        if above is not None and above[order[q]]:
            other = ~above[order[found]]
            found, hits = found[other], hits[other]
        if not len(found):
            continue
        probes = by_len[:long]
        if long and len(found) * long * math.log2(total + 1) <= 8 * int(lens[probes].sum()):
            want = (mine[probes][:, None] * docs + found[None, :]).ravel()
            at = np.minimum(np.searchsorted(keyed, want), total - 1)
            hits = hits + (keyed[at] == want).reshape(long, len(found)).sum(0)
        elif long:
            more = np.concatenate([postings[x : x + y] for x, y in zip(left[probes].tolist(), lens[probes].tolist(), strict=True)])
            hits = hits + np.bincount(more - low, minlength=q - low)[found - low]
        ok = den * hits >= num * (a + size[found] - hits)
        if ok.any():
            yield int(order[q]), order[found[ok]]


def _links(num: int, den: int):
    """A block's links as degrees, with copies counted, and one edge for each set joined to another."""

    def run(table):
        shared.trim()
        names, copies, chunk = (np.asarray(table.column(k).combine_chunks()) for k in ("digest", "copies", "chunk"))
        above = np.asarray(table.column("above").combine_chunks().cast(pa.int8())).astype(bool)
        lists = table.column("shingles").combine_chunks()
        values, at = np.asarray(lists.values).view(np.uint64), np.asarray(lists.offsets)
        sets = [np.sort(values[a:b]) for a, b in itertools.pairwise(at)]
        cross = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        links = np.zeros(len(sets), np.int64)
        root = list(range(len(sets)))

        def top(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for q, partners in divide_skip(sets, num, den, chunk if cross else None, above if above.any() else None):
            links[q] += int(copies[partners].sum())
            links[partners] += copies[q]
            x = top(q)
            for y in partners.tolist():
                y = top(y)
                if x != y:
                    x, y = min(x, y), max(x, y)
                    root[y] = x
        got = np.flatnonzero(links)
        return pa.table({"digest": pa.array(names[got]), "other": pa.array(names[np.array([top(k) for k in got.tolist()], np.int64)] if len(got) else np.empty(0, np.int64)), "links": pa.array(links[got])})

    return run


def ngram_jaccard_join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """Links texts whose sets of n-word shingles have Jaccard similarity num / den or more.

    Returns a row per input row: doc_id, n_shingles, component_id (the smallest
    doc_id reachable by links, itself included), n_links (rows linked with it).
    A null or empty text, or one of white space, has no shingle and no link; a
    text of fewer than n words is one shingle. Repeated rows and equal ids are
    rows of their own, linked like other copies; a null doc_id stays null and is
    no component_id unless it has none besides. Other columns are not read. Very
    long texts are read whole. An empty table gives none.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    profile = shared.cut(shared.map_batches(docs, _profile("text", n), "doc_id long, digest long, n long, is_doc boolean"), "profile")
    rows = profile.where("is_doc").drop("is_doc")
    hot = [r[0] for r in profile.where("not is_doc").groupBy("digest").agg(F.sum("n").alias("times")).orderBy(F.desc("times"), "digest").limit(COMMON).select("digest").collect()]
    hot = np.array(hot, np.int64).view(np.uint64)
    by = np.argsort(hot)
    common = spark.sparkContext.broadcast((hot[by], by))  # rank 0 is the most common
    texts = docs.select("text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    pieces = max(4 * parts, -(-total // PART))
    emitted = shared.map_batches(texts, _emit("text", n, common, pieces), _EMITTED)
    postings = emitted.groupBy("part").applyInArrow(_count, _EMITTED).groupBy("batch").applyInArrow(_pick(num, den), "sig long, salt byte, digest long")
    dealt = postings.repartition(parts, "sig", "salt").sortWithinPartitions("sig", "salt", "digest")
    coarse = shared.cut(shared.components(shared.map_batches(dealt, _stars, "a long, b long")), "coarse")
    del emitted, postings, dealt

    classes = shared.cut(rows.groupBy("digest").agg(F.first("n").alias("n"), F.min("doc_id").alias("least"), F.count("*").alias("copies")), "classes")
    members = shared.cut(classes.join(coarse.withColumnRenamed("node", "digest"), "digest").select("digest", "n", "copies", "label"), "members")
    size = 1 << 16
    while size < min(MOST_FILTER, FILTER_BITS * members.count()):
        size *= 2
    bits = np.zeros(size >> 6, np.uint64)
    at = F.pmod("digest", F.lit(size))
    for r in members.select(F.shiftright(at, 6).alias("w"), at.alias("at")).groupBy("w").agg(F.expr("bit_or(shiftleft(1L, int(at % 64)))").alias("bits")).toLocalIterator():
        bits[r["w"]] = r["bits"] & (2**64 - 1)
    wanted = spark.sparkContext.broadcast(bits)
    sets = shared.map_batches(texts, _member_sets("text", n, wanted), "digest long, shingles array<bigint>").groupBy("digest").agg(F.first("shingles").alias("shingles"))
    groups = members.groupBy("label").agg(F.sum("n").alias("volume"), F.count("*").alias("kinds")).where("kinds > 1")
    total = members.agg(F.sum("n")).first()[0] or 0
    bins = max(1, -(-int(total) // BLOCK))
    chunks = F.greatest(F.lit(1), F.ceil(F.col("volume") / F.lit(BLOCK))).cast("int")
    placed = members.join(groups.select("label", (F.col("volume") > BLOCK).alias("large")), "label")
    # linked sets of a large component are of one band of sizes or of two neighbours: a block has a band and the one above
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(den / num) * (1 + 1e-9))).cast("long") if num < den else F.col("n")
    own, below = F.struct(band.alias("band"), F.lit(False).alias("above")), F.struct((band - 1).alias("band"), F.lit(True).alias("above"))
    alone = F.struct(F.lit(0).cast("long").alias("band"), F.lit(False).alias("above"))
    placed = placed.withColumn("at", F.explode(F.when(F.col("large"), F.array(own, below)).otherwise(F.array(alone)))).select("digest", "n", "copies", "large", F.when(F.col("large"), F.col("label")).otherwise(F.pmod(F.xxhash64("label"), F.lit(bins))).alias("block"), "at.*")
    blocks = placed.where("large").groupBy("block", "band").agg(F.sum("n").alias("volume"), F.bool_and("above").alias("idle")).where("not idle").select(F.lit(True).alias("large"), "block", "band", chunks.alias("chunks"))
    split = placed.where("large").join(blocks, ["large", "block", "band"])
    placed = placed.where("not large").withColumn("chunks", F.lit(1)).unionByName(split).withColumn("chunk", F.pmod(F.xxhash64("digest"), F.col("chunks")).cast("int"))
    placed = placed.join(sets, "digest").select("digest", "copies", "shingles", "chunk", "large", "block", "band", "above", F.explode(F.expr("sequence(0, chunks - 1)")).alias("k"))
    placed = placed.withColumn("i", F.least("chunk", "k")).withColumn("j", F.greatest("chunk", "k")).drop("k")
    found = shared.cut(placed.groupBy("large", "block", "band", "i", "j").applyInArrow(_links(num, den), "digest long, other long, links long"), "links")
    shared.drop(coarse, members)

    label = shared.components(found, "digest", "other")
    least = label.join(classes.select(F.col("digest").alias("node"), "least"), "node")
    component = least.groupBy("label").agg(F.min("least").alias("component_id"))
    linked = found.groupBy("digest").agg(F.sum("links").alias("links"))
    per_class = (
        classes.select("digest", "least", "copies")
        .join(label.join(component, "label").select(F.col("node").alias("digest"), "component_id"), "digest", "left")
        .join(linked, "digest", "left")
        .select("digest", F.coalesce("component_id", "least").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("times"))
    )
    real = F.col("n") > 0
    every = shared.join_to_one(rows, shared.cut(per_class, "components"), "digest")
    return every.select("doc_id", F.col("n").alias("n_shingles"), F.when(real, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(real, F.col("n_links")).otherwise(F.lit(0).cast("long")).alias("n_links"))

"""URL filtering by a Bloom filter cascade, in DataFrame functions only.

Level 0 of the cascade is a Bloom filter of the listed domains. Level 1 holds
those domains of the corpus that are not listed and yet pass level 0, level 2
the listed ones that pass level 1, and so on, each level with hashes of its own,
until a level has no false positive left. Over the domains of the corpus, and
for all listed ones, the answer is exact: a key is listed if the first level
that lacks it is an odd one. Each level's rate of false positives is set by how
many keys it holds and how many it must tell from them, so that level 1 is no
larger than the list, and all levels together grow with the list and with the
corpus only by its logarithm.

The levels are written into the plan as literals, so that judging a page needs
no join. A list whose filters would be larger than MOST_BITS is dealt out by a
hash of its keys to several cascades, which judge the pages one after the other.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Highest rate of false positives of a level, and bits of one cascade's first level.
RATE, MOST_BITS = 1 / 16, 1 << 25


@dataclass
class Level:
    seed: int
    bits: int
    hashes: int
    words: str  # 64 bits each, in order

    def holds(self, key: Column) -> Column:
        words = F.split(F.lit(self.words), ",").cast("array<bigint>")  # once in the plan, however many hashes
        word = lambda at: F.get(words, F.shiftright(at, 6).cast("int"))
        is_set = lambda at: F.expr("bigint(1)").bitwiseAND(F.call_function("shiftright", word(at), F.pmod(at, F.lit(64)).cast("int"))) == 1
        return F.forall(F.array(*positions(key, self.seed, self.bits, self.hashes)), is_set)


def positions(key: Column, seed: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed), F.lit(k)), F.lit(bits)) for k in range(hashes)]


def sized(inside: int, outside: int) -> tuple[int, int]:
    """Bits and hashes of a level that holds so many keys and is asked for so many others."""
    rate = min(RATE, inside / max(outside, 1))
    hashes = math.ceil(-math.log2(rate))
    return 64 * math.ceil(inside * hashes / math.log(2) / 64), hashes


def _level(keys: DataFrame, inside: int, outside: int, seed: int) -> Level:
    bits, hashes = sized(inside, outside)
    at = keys.select(F.explode(F.array(*positions(F.col("key"), seed, bits, hashes))).alias("at"))
    empty = keys.sparkSession.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("x"))
    words = at.select(F.shiftright("at", 6).alias("w"), F.expr("shiftleft(1L, int(at % 64))").alias("x")).unionByName(empty).groupBy("w").agg(F.bit_or("x").alias("x"))
    # bits / 64 numbers, MOST_BITS / 64 at most, as one string
    whole = words.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("w", "x"))), lambda s: s["x"].cast("string")), ",")).first()[0]
    return Level(seed, bits, hashes, whole)


class Cascade:
    def __init__(self, levels: list[Level]):
        self.levels = levels

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame) -> Cascade:
        """listed, universe: a string column key each. Exact for all keys of both."""
        inside = shared.cut(listed.where("key is not null").distinct(), "listed")
        outside = shared.cut(universe.where("key is not null").distinct().join(inside, "key", "left_anti"), "others")
        levels, n, others = [], inside.count(), outside.count()
        while n:
            level = _level(inside, n, others, len(levels))
            levels.append(level)
            inside, outside = shared.cut(outside.where(level.holds(F.col("key"))), "passing"), inside
            n, others = inside.count(), n
        return cls(levels)

    def lists(self, key: Column) -> Column:
        """Whether a key of the corpus is listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels) - 1, -1, -1):
            out = F.when(~self.levels[k].holds(key), F.lit(k % 2 == 1)).otherwise(out)
        return out


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return _lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def keys_above(labels: int) -> list[Column]:
    """A host and the domains above it, of up to so many labels."""
    return [F.substring_index(F.col("host"), ".", -k) for k in range(1, labels + 1)]


def corpus_keys(pages: DataFrame, labels: int, url: str = "url") -> DataFrame:
    """key: all hosts of the pages and the domains above them, of up to so many labels, each once."""
    hosts = pages.select(host_and_path(F.col(url).cast("string"))[0].alias("host")).distinct()
    return hosts.select(F.explode(F.array_distinct(F.array(*keys_above(labels)))).alias("key")).distinct()


def _both(f, g):
    return lambda key: f(key) & g(key)


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str]], listed: DataFrame, labels: int, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """Returns page_id, host, path, rule, verdict for every row.

    rules: (allow or block, host followed by a path); a rule fits its host and
    all subdomains if the path starts with its own, and the longest that fits
    decides. Without one, a page is blocked if its host or a domain above it, of
    up to `labels` labels, is among listed (a string column key), as the cascade
    says. A null url, or one without ://, has an empty host and path and is
    allowed. Repeated rows give repeated results, long urls are judged whole,
    other columns are not read, an empty table gives none.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    listed, universe = shared.cut(listed.where("key is not null").distinct(), "list"), shared.cut(corpus_keys(pages, labels, url), "universe")
    parts = max(1, -(-sized(max(1, listed.count()), universe.count())[0] // MOST_BITS))
    rows = rows.withColumn("on_list", F.lit(False))
    for p in range(parts):
        mine = lambda key, p=p: F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(parts)) == p
        lists = Cascade.build(listed.where(mine(F.col("key"))), universe.where(mine(F.col("key")))).lists
        on_list = F.exists(F.array(*keys_above(labels)), _both(mine, lists) if parts > 1 else lists)
        rows = rows.withColumn("on_list", F.col("on_list") | on_list)
        if parts > 1:
            rows = shared.cut(rows, "judged")
    rule = verdict = None
    for what, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((F.col("host") == name) | F.endswith(F.col("host"), F.lit(f".{name}"))) & F.startswith(F.col("path"), F.lit(slash + rest))
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(what)) if verdict is None else verdict.when(fits, F.lit(what))
    method = F.when(F.col("on_list"), F.lit("block")).otherwise(F.lit("allow"))
    rule = F.lit(None).cast("string") if rule is None else rule
    verdict = method if verdict is None else verdict.otherwise(method)
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))

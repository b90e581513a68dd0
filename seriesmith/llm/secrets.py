"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Three patterns give the base spans. Besides, long mixed tokens outside them are
candidates. The hash of every candidate's value is counted over the corpus by
distinct repositories and owners: a value that several owners or many
repositories hold is a copied example, any other looks live. Mixed tokens that
look live are added as spans of kind `owned`.

Matches are dealt out as rows of lengths, and windows over a text's rows sum
them to places, so that the work grows with the matches and not their square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Kinds in the order in which they are listed.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: A candidate without a keyword: a token of 20 or more characters with a digit and letters of both cases.
MIXED = r"[A-Za-z0-9+/_=-]{20,}"
#: A value of so many owners, or in so many repositories whoever owns them, is a copied example.
WIDE, MANY = 3, 4
#: Code points of a block of a text that is put together anew.
BLOCK = 4096


def _hits(text: Column, pattern: str, kind: int, group: int, ok) -> Column:
    """array<struct<kind, at, gap, size, hash>> of the matches in order: lengths, in code points, of the gap before and of the match; a hash if the value passes."""
    found, gaps, values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    sized = F.zip_with(found, gaps, lambda m, g: F.struct(F.length(m).alias("size"), F.length(g).alias("gap")))
    valued = F.filter(F.zip_with(sized, values, lambda s, v: F.struct(s["size"].alias("size"), s["gap"].alias("gap"), v.alias("value"))), lambda x: x["size"].isNotNull())
    out = F.transform(valued, lambda x, k: F.struct(F.lit(kind).alias("kind"), k.alias("at"), x["gap"].cast("long").alias("gap"), x["size"].cast("long").alias("size"), F.when(ok(x["value"]), F.sha2(x["value"], 256)).alias("hash")))
    return F.when(F.rlike(text, F.lit(pattern)), out).otherwise(F.array().cast("array<struct<kind:int,at:int,gap:bigint,size:bigint,hash:string>>"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


_NONE = "array<struct<start:bigint,kind:int,end:bigint>>"


def _judged(docs: DataFrame, text: str, owner: str, repository: tuple[str, ...], wide: int, many: int, keep: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """A row per row: row, the columns in keep as one struct `kept`, and whether it has matches; and a row per span: row, start, kind, end, copied."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    rows = docs.select(F.struct(*map(shared.named, keep)).alias("kept"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), part(owner).alias("owner"), F.concat_ws("\1", *map(part, repository)).alias("repo"))
    t = F.col("text")
    always = lambda v: v.isNotNull()
    mixed = lambda v: F.rlike(v, F.lit("[0-9]")) & F.rlike(v, F.lit("[a-z]")) & F.rlike(v, F.lit("[A-Z]"))
    hits = F.concat(_hits(t, ASSIGN, 0, 1, lambda v: F.length(v) >= 6), _hits(t, ACCESS, 1, 0, always), _hits(t, HEX, 2, 0, always), _hits(t, MIXED, 3, 0, mixed))
    rows = shared.cut(rows.select(F.monotonically_increasing_id().alias("row"), "kept", "owner", "repo", hits.alias("hits")), "hits")

    each = rows.where(F.size("hits") > 0).select("row", "owner", "repo", F.inline("hits")).repartition("row")
    running = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(running)).withColumn("start", F.col("end") - F.col("size")).where("hash is not null")
    # a mixed token stays if no base span that begins up to its start ends beyond it, and none begins before its end
    base = F.col("kind") < 3
    grows = lambda order: Window.partitionBy("row").orderBy(order("start"), order("kind")).rowsBetween(Window.unboundedPreceding, 0)
    reach, following = F.max(F.when(base, F.col("end"))).over(grows(F.asc)), F.min(F.when(base, F.col("start"))).over(grows(F.desc))
    each = each.withColumns({"_reach": reach, "_next": following}).where(base | ((F.coalesce("_reach", F.lit(0)) <= F.col("start")) & (F.coalesce("_next", F.col("end")) >= F.col("end"))))
    each = shared.cut(each.select("row", "owner", "repo", "start", "kind", "end", "hash"), "spans")
    by_repo = each.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    held = shared.cut(by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("times")), "held")
    copied = ((F.col("owners") >= wide) | (F.col("repos") >= many)).alias("copied")
    spans = shared.join_to_one(each.select("row", "start", "kind", "end", "hash"), held.select("hash", "times", copied), "hash")
    return rows.select("row", "kept", (F.size("hits") > 0).alias("some")), spans.drop("hash")


def find(docs: DataFrame, text: str = "text", owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), wide: int = WIDE, keep: tuple[str, ...] = (), many: int = MANY) -> DataFrame:
    """A row per row: the columns in keep as one struct `kept`, then base, live, copied and owned, arrays of spans (start, kind, end).

    Every base span is copied, if `wide` owners or `many` repositories hold its
    value, or else live; owned are the mixed tokens that are not copied.
    """
    rows, spans = _judged(docs, text, owner, repository, wide, many, keep)
    is_base, copied = F.col("kind") < 3, F.col("copied")
    kinds = {"base": is_base, "live": is_base & ~copied, "copied": is_base & copied, "owned": ~is_base & ~copied}
    judged = spans.groupBy("row").agg(*(F.array_sort(F.collect_list(F.when(ok, F.struct("start", "kind", "end")))).alias(c) for c, ok in kinds.items()))
    none = F.array().cast(_NONE)
    some = rows.where("some").join(judged, "row", "left").select("kept", *(F.coalesce(c, none).alias(c) for c in kinds))
    return some.unionByName(rows.where("not some").select("kept", *(none.alias(c) for c in kinds)))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), wide: int = WIDE, many: int = MANY) -> DataFrame:
    """Returns per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, n_owned.

    spans are the base spans and those of kind `owned`. A null text counts as
    empty: no spans. A null owner or repository is one of its own. Repeated rows
    give repeated results and are no further owners; long texts are scanned
    whole; other columns are not read; an empty table gives none.
    """
    found = find(docs, text, owner, repository, wide, (doc_id,), many)
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    size = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return found.select(F.col("kept").getField(doc_id).alias("doc_id"), n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "owned")).alias("spans"), size("live"), size("copied"), size("owned"))


def redact(docs: DataFrame, text: str = "text", owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), wide: int = WIDE, mark: str = "[SECRET]", many: int = MANY) -> DataFrame:
    """The same rows and columns, with every live base span and owned token of the text replaced by mark; spans that overlap become one.

    A null or empty text stays as it is. Repeated rows stay repeated, long texts
    are put together whole, an empty table gives none.
    """
    rows, spans = _judged(docs, text, owner, repository, wide, many, tuple(docs.columns))
    before = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    holes = spans.where("not copied").withColumn("_from", F.coalesce(F.max("end").over(before), F.lit(0)))
    stays = F.when(F.col("start") >= F.col("_from"), F.struct(F.col("_from").alias("a"), F.col("start").alias("b")))
    holes = holes.groupBy("row").agg(F.array_sort(F.collect_list(stays)).alias("stays"), F.max("end").alias("last"))
    none = F.lit(None)
    some = rows.where("some").join(holes, "row", "left").select("kept", "stays", "last")
    every = some.unionByName(rows.where("not some").select("kept", none.cast("array<struct<a:bigint,b:bigint>>").alias("stays"), none.cast("long").alias("last")))
    t = F.col("kept").getField(text)
    every = every.withColumn("blocks", F.when(F.col("stays").isNotNull(), F.regexp_extract_all(t.cast("string"), F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))))

    def piece(a: Column, b: Column) -> Column:
        """Code points a to b, of the blocks that hold them."""
        i, j = F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int")
        block = lambda k: F.coalesce(F.get("blocks", k), F.lit(""))
        first, stop = F.pmod(a, F.lit(BLOCK)).cast("int") + 1, F.pmod(b, F.lit(BLOCK)).cast("int")
        inner = F.array_join(F.slice("blocks", i + 2, j - i - 1), "")
        return F.when(i == j, block(i).substr(first, (b - a).cast("int"))).otherwise(F.concat(block(i).substr(first, F.lit(BLOCK)), inner, block(j).substr(F.lit(1), stop)))

    end = F.aggregate("blocks", F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    clean = F.array_join(F.concat(F.transform("stays", lambda s: piece(s["a"], s["b"])), F.array(piece(F.col("last"), end))), mark)
    return every.select(*(F.when(F.col("stays").isNotNull(), clean).otherwise(t).alias(c) if c == text else F.col("kept").getField(c).alias(c) for c in docs.columns))

"""The registered queries of this subpackage: whole tables, production parameters, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, lm, media, ngram_join, oracles, packing, secrets, shared, toxicity, url_filter, vafile


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(_table(spark, sf_dir, "documents"), n=4, num=85, den=100)


#: Rules of op2: what to do with a host and its subdomains where the path begins so.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: The list of op2 stands in for a bought one: so many made-up names, and the domains of the corpus, of three labels at most and more than two, whose md5 begins with 0 or 1.
LISTED, LISTED_BELOW = 200_000, "2"


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    made = spark.range(LISTED).select(F.concat(F.lit("site-"), F.col("id").cast("string"), F.lit(".example.net")).alias("key"))
    bad = url_filter.corpus_keys(pages, 3).where((F.md5(F.col("key").cast("binary")) < LISTED_BELOW) & F.col("key").like("%.%.%"))
    return url_filter.url_verdicts(pages, RULES, made.unionByName(bad), labels=3)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = _table(spark, sf_dir, "documents"), shared.crc_mod("doc_id", 5)
    model = toxicity.learn(docs, _table(spark, sf_dir, "labels"), fold != 0)
    return toxicity.toxicity_scores(docs, model).select("doc_id", (fold == 0).alias("held_out"), "score", "predicted")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fold = shared.crc_mod("doc_id", 4)
    model = langid.learn(docs.where(fold != 2), "text", "lang")
    held_out = shared.crc_mod("doc_id", 4) == 2
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.image_features(media.text_images(_table(spark, sf_dir, "documents")))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json")))
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(_table(spark, sf_dir, "documents"), shared.crc_mod("doc_id", 7) != 2)


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_url_filter, op3_toxicity, op4_language_id, op5_byte_bpe, op6_media_columns, op7_secret_scan, op8_exact_top_k, op9_best_fit_packing, op10_lm_scoring)}

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": oracles.NGRAM_JACCARD,
    "op2_url_filter": oracles.url_filter(RULES, LISTED, LISTED_BELOW),
    "op7_secret_scan": oracles.SECRETS,
    "op8_exact_top_k": oracles.TOP_K,
}

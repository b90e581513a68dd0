"""A training-data pipeline over documents: language, toxicity, near copies, secrets, packing.

Each stage takes (spark, docs, sf_dir), docs being what the stage before it
kept, and returns the columns of documents, but the last, which returns where
every piece of a document lies in the packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmith.llm import langid, ngram_join, packing, secrets, shared, toxicity

#: Words of a shingle, and the least similarity of near copies as a fraction.
WORDS, SIMILAR = 5, (80, 100)


def _kept(scored: DataFrame, docs: DataFrame, ok) -> DataFrame:
    """The rows that pass, with the names that their columns had."""
    return scored.where(ok).select(*(F.col(f"kept_{k}").alias(c) for k, c in enumerate(docs.columns)))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, null and empty ones included, or unlike every language of the corpus, go. Repeated rows go or stay alike; an empty table gives none."""
    scored = langid.identify(docs, langid.learn(docs, "text", "lang"), keep=tuple(docs.columns))
    return _kept(scored, docs, ~F.col("rejected"))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted as toxic go; null and empty texts stay. Rows without a label, or of a null doc_id, are judged like others; an empty table gives none."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.toxicity_scores(docs, toxicity.learn(docs, labels, F.lit(True)), keep=tuple(docs.columns))
    return _kept(scored, docs, F.col("predicted") == 0)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the first row stays; a document without words is a group of its own. An empty table gives none.

    Rows are numbered in a table of their own, so that every scan numbers them alike.
    """
    row = "row" + "_" * max(map(len, docs.columns))  # a name that none of them has
    rows = shared.cut(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = ngram_join.ngram_jaccard_join(rows, doc_id=row, n=WORDS, num=SIMILAR[0], den=SIMILAR[1])
    stay = groups.where("doc_id = component_id").select(F.col("doc_id").alias(row))
    return rows.join(stay, row, "left_semi").select(*map(shared.named, docs.columns))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Credentials that are not widely copied are masked in the texts; n_chars follows. Null and empty texts stay as they are, repeated rows repeated; an empty table gives none."""
    clean = secrets.redact(docs)
    return clean.select(*(F.coalesce(F.length("text"), F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else shared.named(c) for c in docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every document's pieces of at most 2048 tokens; a null or empty text is one token, its end. Repeated rows are pieces of their own; an empty table gives none."""
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json")))
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [
    ("language ID", language_id),
    ("toxicity", toxic_documents),
    ("n-gram Jaccard join", near_copies),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]

#: SQL cannot express the stages that learn; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written as Parquet and read again as the next one's docs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared.cut(docs, "stage")
    return docs

"""Training-corpus pipeline: quality, line dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chirpline.llm import byte_bpe, decontam, line_dedup, near_dedup, quality
from chirpline.llm.common import fresh, written
from chirpline.llm.vocab import rank_file


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from labelled rows of the input.

    A null or empty text is scored as a text without n-grams. Each of repeated rows gets
    the same decision. Of an empty table nothing remains.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that occurred before.

    Null texts stay null. Rows that repeat doc_id and text are one document and all stay
    alike. No row goes; an empty table stays empty.
    """
    return line_dedup.dedup_lines_in(docs)


def unique_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id.

    Texts that share a doc_id are documents of their own, in the order of their hashes. Of
    rows that repeat doc_id and text one stays, the first by its other columns; rows with a
    null doc_id all stay.
    """
    at, key, row = (fresh(docs, c) for c in ("kept_id", "kept_key", "kept_row"))
    text_key = F.xxhash64("text")
    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = known.groupBy("doc_id").agg(F.min(text_key).alias("low"), F.max(text_key).alias("high")).where("low < high")
    if shared.isEmpty():
        own = F.col("doc_id").cast("long")
    else:
        own = F.struct(F.col("doc_id").cast("long").alias("doc_id"), text_key.alias("text_key"))
    kept = near_dedup.near_documents(known.select(own.alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias(at)).distinct()
    rest = F.to_json(F.struct(*[c for c in docs.columns if c != "text"]))
    stay = docs.join(kept, own == F.col(at), "left_semi").groupBy(F.col("doc_id").alias(at), text_key.alias(key))
    one = stay.agg(F.min_by(F.struct(*docs.columns), rest).alias(row)).select(f"{row}.*")
    return one.unionByName(docs.where("doc_id is null"))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passages beyond the contamination rule.

    Null and empty texts are clean. Each of repeated rows gets the same decision; an empty
    table stays empty.
    """
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the decoded bytes.

    A null text counts as empty and has no tokens. Each of repeated rows gets a row.
    """
    return byte_bpe.tokenized(docs, *rank_file())


STAGES = [
    ("quality", good_quality),
    ("line_dedup", unique_lines),
    ("near_dedup", unique_documents),
    ("decontamination", uncontaminated),
    ("tokens", tokens),
]

#: A trained classifier and a byte-pair encoder have no SQL form; tests compare every
#: stage with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

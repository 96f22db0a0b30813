"""The registered queries of the text operators, and SQL for those that have a SQL form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chirpline.llm import byte_bpe, decontam, fill_middle, fingerprint, importance, language_id, line_dedup, near_dedup, paragraph_dedup, pitman_yor, quality, secrets, toxicity
from chirpline.llm.vocab import rank_file


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return language_id.languages_of(docs, language_id.train(docs))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.toxicity_scores(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_read(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.quality_scores(docs, quality.train(docs, _read(spark, sf_dir, "labels")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_read(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(_read(spark, sf_dir, "documents"))


def op7_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.repeated_paragraphs(_read(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("items")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.tokenized(_read(spark, sf_dir, "documents"), *rank_file(), with_ids=False)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"), shingle=4, percent=80)


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return pitman_yor.scores(docs, pitman_yor.train(docs))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fim_digest(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_language_id, op2_toxicity, op3_fingerprint, op4_quality, op5_line_dedup, op6_secrets, op7_paragraph_dedup, op8_decontamination, op9_byte_bpe, op10_near_dedup, op11_language_model, op12_importance, op13_fill_middle)
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": line_dedup.SQL, "op6_secrets": secrets.sql(), "op12_importance": importance.sql(), "op13_fill_middle": fill_middle.sql()}

"""Corpus pipeline: quality, near copies, benchmark leaks, secrets, packing. Each stage works on all that the last one kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.llm import decontaminate, near_copies, packing, quality_model, secrets, texts
from slatewise.session import written

#: Models and alignments have no SQL form; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject, with all their columns."""
    model = quality_model.fit(docs, texts.table(spark, sf_dir, "labels"))
    return quality_model.keep_accepted(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near copies."""
    return near_copies.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, texts.table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars follows the text."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in out.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences for training, with their ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [("quality", quality), ("near copies", one_of_each), ("decontamination", without_benchmark), ("secrets", without_secrets),
          ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents; every stage's rows are written as Parquet and read again."""
    docs = texts.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

"""The corpus pipeline: language ID, toxicity, line dedup, near-dedup, packing, each stage written and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm import jaccard, language_id, line_dedup, packing, toxicity
from turnlake.llm.common import shared_dir, table

#: Documents are rejected whose best language's score lies less than this part of the way from even chances to certainty, as
#: are those without a letter.
LEAST_LANGUAGE = 0.15
MOST_TOXIC = 0.5


def least_score(languages: int) -> float:
    return 1 / languages + LEAST_LANGUAGE * (1 - 1 / languages) - 1e-6


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a learned language. If nothing can be learned (no labelled language), only texts without a letter go."""
    model = language_id.train(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    got = language_id.predict(docs, model)
    found, score = got.columns[-2:]
    return got.where((F.col(found) != "und") & (F.col(score) >= least_score(len(model.langs)))).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score below MOST_TOXIC."""
    got = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return got.where(F.col(got.columns[-1]) < MOST_TOXIC).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without its site's boilerplate lines, however small the site; n_chars follows the text."""
    got = line_dedup.drop_lines(docs).select(*docs.columns)
    return got.withColumn("n_chars", F.length("text").cast("long"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more."""
    return jaccard.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("packing", packing_stage),
]

#: Recurrent networks, weak supervision and packing have no SQL form; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

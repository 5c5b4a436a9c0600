"""From raw documents to token sequences: five stages, each on all rows the one before has kept.

Defined results: a text that is null or has no letter has no language and goes with the first stage, so later
stages see it only if they are called by themselves: there null and empty texts hold no line, no shingle and no
benchmark passage and stay, and packing makes them one piece. Copies of a row with one id and text become one row
in the third stage; rows without an id are never anyone's copy and stay. Ties go to the least ``doc_id``. An
empty table stays empty in every stage. Columns of any other name pass through the stages before packing
unchanged, whatever they are called; packing returns its own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.llm import decontamination, language_id, line_dedup, ngram_join, packing
from clusterlens.llm.common import read, staged


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models recognise; those they reject go."""
    model = language_id.train(language_id.learning_rows(docs))
    whole = docs.select(F.struct("*").alias("row"))  # columns of any name are out of the way
    judged = whole.withColumn("judged", language_id.identify(model, F.col("row.text"), spark))
    return judged.filter(~F.col("judged.rejected")).select("row.*")


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document holds; ``n_chars`` follows the text."""
    cut = line_dedup.dedup_lines(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else cut


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each component of near copies."""
    return ngram_join.representatives(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", unrepeated_lines),
    ("ngram_join", one_of_each_group),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Language models cannot be written as SQL; the tests check the stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    *first, (_, last) = STAGES
    for name, stage in first:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return last(spark, docs, sf_dir)

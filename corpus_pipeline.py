"""The corpus pipeline: five stages, each over all that the one before it kept.

``run(spark, sf_dir)`` applies them to the table ``documents``; each stage's rows are
written to the shared folder and read again by the next. All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetables.llm import decontaminate, langid, linededup, packing, simhash
from pagetables.llm.common import stored


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the language identification rejects go: those without a letter, and those
    far from every learned language."""
    return langid.keep_known(docs)


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines repeated from earlier documents go; a document goes if all its lines went."""
    kept = linededup.dedupe_lines(docs)
    return kept.filter((F.col("lines_removed") == 0) | (F.col("lines_kept") > 0)).select(
        *(F.length("text").cast("bigint").alias("n_chars") if c == "n_chars" else F.col(f"`{c}`")
          for c in docs.columns))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays.

    Rows of one doc_id stay or go together, rows without a doc_id stay.
    """
    groups = simhash.simhash_groups(docs, shingle=4, bits=4)
    gone = stored(groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("__d"))
                  .distinct(), "copies")
    return docs.join(gone, F.col("doc_id") == F.col("__d"), "left_anti")


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in sequences of 2048, neighbours on the curve together."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", known_language),
    ("line_dedup", new_lines),
    ("simhash_near_dedup", one_of_each_group),
    ("benchmark_decontamination", not_in_benchmark),
    ("packing", packed),
]

#: SQL cannot express the learned first stage, the alignment or the tokens; the tests hold
#: each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, name)
    return docs

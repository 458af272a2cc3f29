"""The corpus pipeline: quality classifier, line dedup, SimHash near-dedup, benchmark decontamination, best-fit packing.

Every stage works on all that the stage before it kept and returns the columns of ``documents``, but for the last, whose rows
are the packed pieces. ``documents`` may hold null, empty and repeated rows and further columns; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexweave.llm import decontam, linededup, packing, quality, similar
from lexweave.llm.common import default_tokenizer, documents, free_name, written

#: Pieces of text whose ids a packing worker keeps: after four stages the JVM beside it is already large.
KEPT = 150_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from those labelled documents that are among ``docs``."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has go; a document of which nothing is left goes too, one that was empty stays."""
    removed = free_name(docs, "_removed")
    out = linededup.dedup_lines(docs, removed_column=removed)
    whole = F.col(removed).isNull()
    out = out.where(whole | (F.col("text") != "")).withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id; of repeated rows of that id, one.

    A link is a similarity of 0.8 or more over five-word shingles, not the 3 bits over three-word shingles of the op4 query.
    It counts between the texts as they are now, and between the whole texts from before the line dedup: a near copy loses its
    common lines there, and what is left of it looks like nothing else.
    """
    return similar.keep_first(docs, earlier=documents(spark, sf_dir))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.pack(docs, default_tokenizer(), kept=KEPT)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: SQL cannot express the trained classifier, the alignment, the fingerprints and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

"""The corpus pipeline: quality, exact copies, near copies, benchmark passages, packing.

Each stage judges each row by its own text, whatever ids are null or repeat. Null texts count as empty; columns beyond doc_id and
text, whatever their names, go through; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetra.llm import jaccard
from vetra.llm.common import read, stored, without
from vetra.llm.decontaminate import decontaminate
from vetra.llm.exact_dedup import exact_dedup
from vetra.llm.packing import pack
from vetra.llm.quality import fit, good, grades_of


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, fitted on the labels table, grades as good. Null and empty texts are graded by their shape; equal texts, however long, fare alike."""
    return good(docs, fit(docs, grades_of(read(spark, sf_dir, "labels"))))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of identical texts, the row with the largest id (a null one only if there is no other); of rows that repeat its id and text, the least by their other columns."""
    out = stored(exact_dedup(docs).where("group_size > 1").groupBy("doc_id", "text_sha256", "kept").agg(F.count("*").alias("n")), "pipeline-copies")
    return without(docs, out.where("not kept"), out.where("kept and n > 1"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the row with the smallest id (a null one only if there is no other); of rows that repeat its id and text, the least by their other columns.

    Near copies share 0.8 of their distinct 5-word shingles at least, by Jaccard similarity. Texts without words are copies of each other.
    """
    return without(docs, *jaccard.redundant(docs))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that aren't contaminated by the benchmark table; texts without words aren't."""
    bad = decontaminate(docs, read(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id", "text_sha256")
    return without(docs, bad, bad.limit(0))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, with their sequences and offsets; a text without tokens is one piece, its end token."""
    return pack(docs).drop("ids")


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("packing", packing_stage),
]

#: Neither the classifier, nor the fingerprints, nor the tokenizer can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each writes what it keeps, and the next one reads that."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline: quality rules, near duplicates, benchmark decontamination, packing.

Every stage is a function of (session, documents, table folder) that works on all rows its predecessor
kept. ``run`` writes each result as Parquet to the shared folder and rereads it for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorebase.llm import decontaminate, jaccard, packing, quality
from lorebase.llm.common import stage, stage_lookup, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the quality rules, with all their columns. Every row is judged by itself, so null keys and repeated
    rows are rows like others; null, empty and wordless texts fail the rules and go. Long texts are judged whole, ties at the
    cutoff stay, an empty table gives an empty one, and columns may have any names."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of every component of similar documents. Documents without a set or without a
    doc_id stay; rows that repeat a doc_id are one document and stay or go together. Whole texts of any length are compared, equal
    texts are a tie that the smallest doc_id wins, an empty table gives an empty one, and other columns may have any names."""
    dropped = jaccard.join(docs).filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(stage_lookup(dropped, "dropped"), "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose document holds no item of the benchmark table; rows without a doc_id stay. Whole texts are read; rows that
    repeat a doc_id stay or go together, an empty table gives an empty one, and other columns may have any names."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All remaining documents, packed: one row per piece. Every row is packed, null texts as the end id alone, long ones in
    several pieces, repeated rows each on its own; an empty table gives no pieces and other columns are ignored."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules), ("near_duplicates", near_duplicates),
    ("decontamination", decontamination), ("packing", pack),
]
ORACLE_SQL = None  # SQL has no tokenizer; tests/llm/test_pipeline.py checks against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

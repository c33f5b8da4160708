"""From raw documents to packed training sequences, in five stages.

A stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns the columns of
documents; the last one returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.llm.common import dropped, table, written
from stepforge.llm.op03_pii import sanitise
from stepforge.llm.op04_exact import without_copies
from stepforge.llm.op05_quality import good_documents
from stepforge.llm.op08_packing import pack_documents
from stepforge.llm.op10_simhash import Similar, one_of_each
from stepforge.shared import remove, scope


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney classifier rejects go."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of their five-word shingles, the one with the least doc_id stays.

    Candidates come from SimHash links, and beyond their radius from bands; the sets are compared exactly.
    """
    return one_of_each(docs, similar=Similar(words=5, jaccard=0.8))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced; n_chars counts the new text."""
    return sanitise(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return pack_documents(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("SimHash near-dedup", near), ("PII", private), ("packing", packing)]

#: The model, the links between fingerprints and the tokenizer are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage wrote on its way goes when the stage is written, or fails, and a stage's table when the next one is."""
    docs, keep = table(spark, sf_dir, "documents"), []
    try:
        for name, stage in STAGES[:-1]:
            with scope(spark, keep):
                done = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"), "zstd")
                keep.append(done.written_at)
            if len(keep) > 1:
                dropped(docs)
            docs = done
        return STAGES[-1][1](spark, docs, sf_dir)
    except BaseException:
        for path in keep:
            remove(spark, path)
        raise

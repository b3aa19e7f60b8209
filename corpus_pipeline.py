"""A training corpus from raw documents: quality, near copies, repeated passages, benchmark leaks, packing.

Every stage takes all documents that the one before kept. All but the last give the columns of ``documents``.
A row without an id passes the stages that decide by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusmatch.llm import decontaminate, divergence, packing, simhash, suffixes
from corpusmatch.operators.storage import new_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose histograms are those of their language, and that pass the base rules."""
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("_doc"), "text", "lang")
    kept = divergence.rules(rows, keep=["_doc", "text"]).filter("kept")
    return kept.select("_doc.*", "text").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document: fingerprints of four-word shingles within 4 bits are linked.

    The row of the smallest id stays; of rows that share that id, the first by a digest of the whole row. Rows that
    repeat an id but belong to different groups all stay, each in its group.
    """
    return simhash.first_of_each(docs, distance=4).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; a cut character goes as a whole."""
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    rows = docs.select("doc_id", "text", F.struct(*others).alias("_doc"))
    left = suffixes.remove_repeats(rows, as_text=True).select("_doc.*", F.col("kept").alias("text"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens.

    A worker keeps its pieces' ids while it runs the other stages, so it keeps fewer here.
    """
    return packing.digests(packing.pack(docs, 2048, end_id=1, cached_pieces=100_000))


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("packing", packed),
]

# Connected components, suffix sorting and token ids have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), new_folder(spark)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

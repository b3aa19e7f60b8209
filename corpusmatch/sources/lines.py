"""Lists of repositories: one entry per line, from files and from arguments."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusmatch.functions import text as tx
from corpusmatch.operators.skew import keep_first


def list_entries(lines: DataFrame, line: str = "value") -> DataFrame:
    """Strip the lines, drop blank ones and ``#`` comments."""
    entry = tx.strip(F.col(line))
    return lines.withColumn(line, entry).filter((F.col(line) != "") & ~F.col(line).startswith("#"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """``block, pos, url`` of a list file in file order; a missing file is an empty list."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "block bigint, pos bigint, url string")
    placed = lines.select(
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"), "value"
    )
    return list_entries(placed).withColumnRenamed("value", "url")


def first_occurrences(entries: DataFrame) -> DataFrame:
    """Each ``url`` once, where it occurs first by (``source_rank``, ``block``, ``pos``), in that order."""
    order = ["source_rank", "block", "pos"]
    return keep_first(entries, ["url"], *[F.col(c) for c in order]).orderBy(*order)


def collect_urls(spark: SparkSession, arguments: Sequence[str], list_file: str | None = None) -> DataFrame:
    """Ordered distinct entries of the arguments (``@file`` stands for a list file), then of ``list_file``."""
    parts = []
    for rank, argument in enumerate(arguments):
        if argument.startswith("@"):
            entries = read_list(spark, argument[1:])
        else:
            entries = spark.createDataFrame([(0, 0, argument)], "block bigint, pos bigint, url string")
        parts.append(entries.withColumn("source_rank", F.lit(rank)))
    if list_file:
        parts.append(read_list(spark, list_file).withColumn("source_rank", F.lit(len(parts))))
    if not parts:
        return spark.createDataFrame([], "block bigint, pos bigint, url string, source_rank int")
    return first_occurrences(reduce(DataFrame.unionByName, parts))

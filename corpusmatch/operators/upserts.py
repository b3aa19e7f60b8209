"""Upserts as one union and one aggregate, so that repeated keys combine before they are shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusmatch.operators.skew import keep_first


def _old_and_new(old: DataFrame, new: DataFrame, pos: str) -> DataFrame:
    """Union with ``_order``: old rows before new ones, new ones by position."""
    before = old.withColumn("_order", F.struct(F.lit(0).alias("age"), F.lit(0).cast("bigint").alias("pos")))
    after = new.withColumn("_order", F.struct(F.lit(1).alias("age"), F.col(pos).cast("bigint").alias("pos"))).drop(pos)
    return before.unionByName(after, allowMissingColumns=True)


def last_per_key(df: DataFrame, key: str, pos: str) -> DataFrame:
    """The row with the largest ``pos`` per key."""
    return keep_first(df, [key], -F.col(pos))


def upsert_patterns(old: DataFrame, new: DataFrame, pos: str = "pos") -> DataFrame:
    """By ``name``: a new row replaces all but ``pattern_id``; the last of several wins; others stay."""
    cols = [c for c in old.columns if c not in ("name", "pattern_id")]
    merged = _old_and_new(old, new, pos).groupBy("name").agg(
        F.min_by("pattern_id", "_order").alias("pattern_id"),
        F.max(F.struct("_order", *cols)).alias("_row"),
    )
    return merged.select("name", "pattern_id", "_row.*").select(*old.columns)


def upsert_repos(old: DataFrame, new: DataFrame, pos: str = "pos") -> DataFrame:
    """By ``url``: path, branch and time are replaced; the id and the name stay those of the first insert."""
    latest = ["local_path", "default_branch", "last_sync_ts"]
    merged = _old_and_new(old, new, pos).groupBy("url").agg(
        F.min(F.struct("_order", "repo_id", "name")).alias("_first"),
        F.max(F.struct("_order", *latest)).alias("_last"),
    )
    return merged.select(
        "_first.repo_id", "url", "_first.name", *[f"_last.{c}" for c in latest]
    ).select(*old.columns)


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` plus the rows of ``old`` whose key it does not have (insert or replace)."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)

"""Joins, first-per-key and top-k that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from corpusmatch.operators.storage import written

# A key may keep this many rows in one task; a heavier one is split into that many more tasks.
HOT_ROWS = 1_000_000
# A right side of at most so many rows and bytes goes to all tasks.
SMALL_ROWS, SMALL_BYTES = 100_000, 16 << 20


def fits_all_tasks(df: DataFrame, rows: int = SMALL_ROWS, size: int = SMALL_BYTES) -> bool:
    """Whether ``df`` is small enough to be broadcast; at most ``rows`` of it (and one) are looked at."""
    weight = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(16))
    found = df.select(weight.alias("w")).limit(rows + 1).agg(F.count("*").alias("n"), F.sum("w").alias("w")).first()
    return found["n"] <= rows and (found["w"] or 0) <= size


def _heavy_keys(df: DataFrame, on: Sequence[str], hot_rows: int) -> DataFrame:
    """All keys with more than ``hot_rows`` rows: one row per so many rows of ``df`` at most. Counted once, and written."""
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    named = counts.select(
        *[F.col(c).alias(f"_hot_{c}") for c in on], F.ceil(F.col("_n") / hot_rows).cast("int").alias("_splits")
    )
    return written(named, "heavy_keys")


def _with_splits(df: DataFrame, heavy: DataFrame, on: Sequence[str]) -> DataFrame:
    same_key = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_hot_{c}")) for c in on])
    tagged = df.join(heavy, same_key, "left").drop(*[f"_hot_{c}" for c in on])
    return tagged.withColumn("_splits", F.coalesce("_splits", F.lit(1)))


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    row_key: str,
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    small_rows: int = SMALL_ROWS,
) -> DataFrame:
    """Equi-join whose left side may be skewed (NULL keys included) and whose right side is not.

    A small right side is broadcast, and the left one is read once. Otherwise the heavy left keys are found by a
    map-side combined count over the key column only; their left rows are dealt out over several salts by
    ``row_key``, and just their right rows are repeated once per salt. Both sides are read twice then: pass what is
    costly as a written table. ``how`` is inner, left, left_semi or left_anti.
    """
    on = [on] if isinstance(on, str) else list(on)
    if small_rows and fits_all_tasks(right, small_rows):
        return left.join(F.broadcast(right), on, how)
    heavy = _heavy_keys(left, on, hot_rows)
    dealt = _with_splits(left, heavy, on).withColumn(
        "_salt", F.pmod(F.xxhash64(row_key), F.col("_splits")).cast("int")
    )
    repeated = _with_splits(right, heavy, on).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.col("_splits") - 1))
    )
    return dealt.drop("_splits").join(repeated.drop("_splits"), [*on, "_salt"], how).drop("_salt")


def keep_first(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One whole row per key, the first by ``order`` (which must be total within a key).

    An aggregate rather than a window: copies collapse on the map side, so a key that owns a third of
    the rows sends only one row per map task over the wire.
    """
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[o.alias(f"_order{i}") for i, o in enumerate(order)], *rest)
    first = df.groupBy(*keys).agg(F.min(ranked).alias("_first"))
    return first.select(*[F.col(c) if c in keys else F.col("_first")[c].alias(c) for c in df.columns])


def top_k(df: DataFrame, key: str, order: Sequence[Column], k: int, row_key: str, slices: int = 64) -> DataFrame:
    """The first ``k`` rows per key by ``order``.

    Ranked within slices of a key first: however many rows a key has, the task that ranks it finally
    sees at most ``slices * k`` of them.
    """
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(row_key), F.lit(slices)))
    per_slice = W.partitionBy(key, "_slice").orderBy(*order)
    survivors = sliced.withColumn("_rank", F.row_number().over(per_slice)).filter(F.col("_rank") <= k)
    per_key = W.partitionBy(key).orderBy(*order)
    ranked = survivors.drop("_slice").withColumn("_rank", F.row_number().over(per_key))
    return ranked.filter(F.col("_rank") <= k).drop("_rank")

"""The semantic top k kept up to date while repositories are replaced, without scoring all vectors again.

Per pattern a reserve of ``k + spare`` best rows stands, and a floor: the last row of the reserve when it was full. Above the
floor nothing is missing, as whatever was left out ranks below. When repositories are replaced, their rows leave the reserve, and
their new vectors enter as far as they rank above the floor. As long as ``k`` rows are left, or there is no floor, the first
``k`` are those of a full computation. A pattern that falls below ``k``, that is new, or whose vector or name has changed is scored
anew against all vectors, and no other.

The reserve has ``k + spare`` rows per pattern at most, whatever the corpus; a replacement reads the vectors of its own repositories.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from corpusmatch.functions import vectors as vx
from corpusmatch.operators.semantic import semantic_topk
from corpusmatch.operators.skew import top_k
from corpusmatch.operators.storage import small_batches, written

_ORDER = ("score", "symbol_id")
RESERVE = ["pattern_id", "pattern_name", "symbol_id", "repo_id", "score"]


@dataclass(frozen=True)
class Standing:
    """``reserve``: RESERVE rows; ``floors``: pattern_id, signature, floor_score, floor_symbol (null where nothing was left out)."""

    reserve: DataFrame
    floors: DataFrame

    def best(self, k: int) -> DataFrame:
        """The first ``k`` rows of each pattern."""
        return top_k(self.reserve, "pattern_id", [F.desc("score"), F.asc("symbol_id")], k, row_key="symbol_id")


def _signatures(patterns: DataFrame) -> DataFrame:
    embedded = patterns.filter(vx.is_embedded(F.col("embedding")))
    return embedded.select("pattern_id", F.xxhash64("name", "embedding").alias("signature"))


def _not_below(score: Column, symbol: Column) -> Column:
    """Whether a row ranks at the floor or above it."""
    below = (F.col("score") < score) | ((F.col("score") == score) & (F.col("symbol_id") > symbol))
    return score.isNull() | ~below


def _floors(reserve: DataFrame, patterns: DataFrame, size: int, old: DataFrame | None = None) -> DataFrame:
    """A full reserve's last row; one that isn't full keeps its old floor."""
    last = F.max(F.struct((-F.col("score")).alias("score"), "symbol_id")).alias("last")
    full = reserve.groupBy("pattern_id").agg(F.count("*").alias("n"), last).filter(F.col("n") >= size)
    full = full.select("pattern_id", (-F.col("last.score")).alias("new_score"), F.col("last.symbol_id").alias("new_symbol"))
    rows = _signatures(patterns).join(full, "pattern_id", "left")
    if old is None:
        return rows.select("pattern_id", "signature", F.col("new_score").alias("floor_score"), F.col("new_symbol").alias("floor_symbol"))
    rows = rows.join(old.select("pattern_id", "floor_score", "floor_symbol"), "pattern_id", "left")
    is_full = F.col("new_symbol").isNotNull()
    return rows.select(
        "pattern_id",
        "signature",
        F.when(is_full, F.col("new_score")).otherwise(F.col("floor_score")).alias("floor_score"),
        F.when(is_full, F.col("new_symbol")).otherwise(F.col("floor_symbol")).alias("floor_symbol"),
    )


def build(vectors: DataFrame, patterns: DataFrame, k: int, min_cos: float, spare: int, folder: str | None = None) -> Standing:
    """The state of all patterns over all vectors."""
    with small_batches(vectors.sparkSession):
        reserve = written(semantic_topk(vectors, patterns, k + spare, min_cos).select(*RESERVE), "reserve", folder)
    return Standing(reserve, written(_floors(reserve, patterns, k + spare), "floors", folder))


def replace(
    state: Standing,
    replaced: DataFrame,
    fresh: DataFrame,
    vectors: DataFrame,
    patterns: DataFrame,
    k: int,
    min_cos: float,
    spare: int,
    folder: str | None = None,
) -> tuple[Standing, DataFrame]:
    """The state after the repositories in ``replaced`` (``repo_id``) have the vectors ``fresh``, and the patterns scored anew.

    ``vectors`` are all vectors after the replacement; they are read only for patterns that must be scored anew.
    """
    size = k + spare
    known = _signatures(patterns).join(state.floors, ["pattern_id", "signature"])
    known = written(known.select("pattern_id", "floor_score", "floor_symbol"), "known", folder)
    kept = state.reserve.join(known, "pattern_id", "left_semi").join(replaced.select("repo_id").distinct(), "repo_id", "left_anti")
    entering = semantic_topk(fresh, patterns.join(known, "pattern_id", "left_semi"), size, min_cos).join(known, "pattern_id")
    entering = entering.filter(_not_below(F.col("floor_score"), F.col("floor_symbol")))
    merged = kept.select(*RESERVE).unionByName(entering.select(*RESERVE))
    merged = top_k(merged, "pattern_id", [F.desc("score"), F.asc("symbol_id")], size, row_key="symbol_id")
    merged = written(merged.select(*RESERVE), "merged", folder)
    counts = merged.groupBy("pattern_id").agg(F.count("*").alias("n"))
    sound = known.join(counts, "pattern_id", "left").filter((F.coalesce("n", F.lit(0)) >= k) | F.col("floor_symbol").isNull())
    anew = _signatures(patterns).join(sound, "pattern_id", "left_anti").select("pattern_id")
    anew = written(anew, "anew", folder)
    rest = merged.join(anew, "pattern_id", "left_anti")
    if anew.isEmpty():
        reserve = merged
    else:
        again = semantic_topk(vectors, patterns.join(anew, "pattern_id", "left_semi"), size, min_cos)
        reserve = written(rest.select(*RESERVE).unionByName(again.select(*RESERVE)), "reserve", folder)
    old = known.join(anew, "pattern_id", "left_anti")
    return Standing(reserve, written(_floors(reserve, patterns, size, old), "floors", folder)), anew

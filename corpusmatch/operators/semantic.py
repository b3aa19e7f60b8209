"""Semantic match: thresholded top-k cosine between pattern and symbol vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StringType, StructType

from corpusmatch.functions import text as tx, vectors as vx
from corpusmatch.operators.bounded import MAX_BLOCK_BYTES, collect_in_blocks
from corpusmatch.operators.skew import top_k
from corpusmatch.schemas import table

# Allowance for one winner row beside its name: keys of 64 characters and the score, in a hash relation.
WINNER_BYTES = 320
# Winners are broadcast to the symbol texts up to this size.
MAX_WINNER_BYTES = 256 << 20
# So many patterns are multiplied with a batch of symbols at a time.
# A task holds about so many scored pairs before it drops what is out of the top k, or hands them on.
HELD_ROWS = 500_000
PATTERNS_AT_ONCE = 1024

_EPS32 = float(np.finfo(np.float32).eps)


def _exact_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise dot product in double, summed left to right whatever the batch looks like."""
    out = np.zeros(len(a))
    with np.errstate(all="ignore"):
        for d in range(a.shape[1]):
            out += a[:, d].astype(np.float64) * b[:, d]
    return out


def _candidates(a: np.ndarray, b: np.ndarray, min_cos: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all pairs that may reach ``min_cos`` and be among the best ``k`` of their ``b``.

    Judged by a float32 matrix product, whose rounding error has a bound: a pair is only left out when
    it stays below the threshold, or below ``k`` others, by more than that.
    """
    with np.errstate(all="ignore"):
        norms = np.sqrt((a.astype(np.float64) ** 2).sum(1).max() * (b.astype(np.float64) ** 2).sum(1).max())
        if not norms < 1e37:  # float32 may overflow: judge nothing
            return np.nonzero(np.ones((len(a), len(b)), dtype=bool))
        error = (a.shape[1] + 1) * _EPS32 * norms
    rough = a @ b.T
    floor = np.full(len(b), min_cos - error)
    crowded = np.flatnonzero((rough >= floor).sum(axis=0) > k)
    if len(crowded):
        kth = np.partition(rough[:, crowded], len(a) - k, axis=0)[len(a) - k]
        floor[crowded] = np.maximum(floor[crowded], kth - 2 * error)
    return np.nonzero(rough >= floor)


def _scores_above(a: np.ndarray, b: np.ndarray, min_cos: float, k: int, pairs_at_once: int = 1 << 16):
    """(i, j, score) with score >= min_cos, complete as far as the best ``k`` of each ``b`` go."""
    i, j = _candidates(a, b, min_cos, k)
    score = np.empty(len(i))
    for lo in range(0, len(i), pairs_at_once):
        part = slice(lo, lo + pairs_at_once)
        score[part] = _exact_dot(a[i[part]], b[j[part]])
    keep = score >= min_cos
    return i[keep], j[keep], score[keep]


def _vectors_by_dim(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Split a list array by length: {dim: (row numbers, matrix)}.

    A vector with a missing or NaN element is left out: its score is NaN and never matches.
    """
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    out = {}
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        flat = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        matrix = flat.astype(np.float32).reshape(len(rows), int(dim))
        usable = ~np.isnan(matrix).any(axis=1)
        if usable.any():
            out[int(dim)] = rows[usable], matrix[usable]
    return out


def _best_per_pattern(pattern: np.ndarray, score: np.ndarray, symbol_id: pa.Array, k: int) -> np.ndarray:
    """Positions left after dropping what ``k`` better ones of the same pattern in this batch rule out."""
    if len(pattern) == 0 or np.bincount(pattern).max() <= k:
        return np.arange(len(pattern))
    keys = pa.table({"pattern": pattern, "score": score, "symbol_id": symbol_id})
    order = pc.sort_indices(
        keys, sort_keys=[("pattern", "ascending"), ("score", "descending"), ("symbol_id", "ascending")]
    ).to_numpy()
    ordered = pattern[order]
    rank = np.arange(len(ordered)) - np.searchsorted(ordered, ordered, side="left")
    return order[rank < k]


def _block_scores(symbols: DataFrame, block: list[Row], schema: StructType, min_cos: float, k: int) -> DataFrame:
    """Score every symbol against one broadcast block of patterns inside the tasks that scan the symbols."""
    matrices = _vectors_by_dim(pa.array([row["embedding"] for row in block], pa.list_(pa.float32())))
    names = pa.table(
        {
            name: pa.array([row[name] for row in block], to_arrow_type(schema[name].dataType))
            for name in ("pattern_id", "pattern_name")
        }
    )
    shared = symbols.sparkSession.sparkContext.broadcast((matrices, names))

    def pairs(vectors: pa.Array):
        for dim, (rows, matrix) in _vectors_by_dim(vectors).items():
            for pattern_dim, (numbers, patterns) in shared.value[0].items():
                if pattern_dim == dim:
                    for lo in range(0, len(numbers), PATTERNS_AT_ONCE):
                        i, j, score = _scores_above(matrix, patterns[lo : lo + PATTERNS_AT_ONCE], min_cos, k)
                        yield rows[i], numbers[lo + j], score
                elif min_cos <= -1.0:
                    i, j = np.divmod(np.arange(len(rows) * len(numbers)), len(numbers))
                    yield rows[i], numbers[j], np.full(len(i), -1.0)

    def score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the best k of each pattern so far, over all batches of the task
        held: list[pa.Table] = []
        weight = 0

        def best() -> pa.Table:
            found = pa.concat_tables(held)
            number, score = (found[c].to_numpy() for c in ("_number", "score"))
            return found.take(pa.array(_best_per_pattern(number, score, found["symbol_id"].combine_chunks(), k)))

        def rows(found: pa.Table) -> list[pa.RecordBatch]:
            of_pattern = shared.value[1].take(found["_number"])
            columns = [*of_pattern.columns, *[found[c] for c in ("symbol_id", "repo_id", "score")]]
            return pa.table(columns, names=schema.fieldNames()).to_batches(max_chunksize=10_000)

        for batch in batches:
            for at, numbers, score in pairs(batch["embedding"]):
                some = _best_per_pattern(numbers, score, batch["symbol_id"].take(pa.array(at)), k)
                of_symbol = batch.select(["symbol_id", "repo_id"]).take(pa.array(at[some]))
                names = ["_number", "symbol_id", "repo_id", "score"]
                columns = [pa.array(numbers[some]), *of_symbol.columns, pa.array(score[some])]
                held.append(pa.table(columns, names=names))
                weight += len(some)
                if weight > HELD_ROWS:
                    held = [best()]
                    weight = len(held[0])
                    if weight > HELD_ROWS // 2:
                        yield from rows(held[0])
                        held, weight = [], 0
        if held:
            yield from rows(best())

    return symbols.mapInArrow(score_batches, schema)


def _winner_schema(symbols: DataFrame, patterns: DataFrame) -> StructType:
    return table(
        pattern_id=patterns.schema["pattern_id"].dataType,
        pattern_name=StringType(),
        symbol_id=symbols.schema["symbol_id"].dataType,
        repo_id=symbols.schema["repo_id"].dataType,
        score=DoubleType(),
    )


def _winners(
    symbols: DataFrame, patterns: DataFrame, topk: int, min_cos: float, max_block_bytes: int, carried: Column
) -> tuple[DataFrame, int]:
    """The top-k rows of all patterns, and how many bytes they weigh at most with ``carried`` bytes more each."""
    schema = _winner_schema(symbols, patterns)
    embedded = symbols.filter(vx.is_embedded(F.col("embedding"))).select("symbol_id", "repo_id", "embedding")
    catalogue = patterns.filter(vx.is_embedded(F.col("embedding"))).select(
        "pattern_id", F.col("name").alias("pattern_name"), "embedding", carried.alias("carried")
    )
    row_bytes = 128 + F.octet_length("pattern_name") + 4 * F.size("embedding")
    order = [F.desc("score"), F.asc("symbol_id")]
    best, size = [], 0
    for block in collect_in_blocks(catalogue, row_bytes, max_block_bytes):
        scored = _block_scores(embedded, block, schema, min_cos, topk)
        best.append(top_k(scored, "pattern_id", order, topk, row_key="symbol_id"))
        size += sum(topk * (WINNER_BYTES + 4 * len(row["pattern_name"] or "") + row["carried"]) for row in block)
    if not best:
        return symbols.sparkSession.createDataFrame([], schema), 0
    return reduce(DataFrame.unionByName, best), size


def _winner_bytes(patterns: DataFrame, topk: int, carried: Column) -> int:
    """What ``topk`` winners of each pattern weigh at most, with ``carried`` bytes more each."""
    one = topk * (WINNER_BYTES + 4 * F.char_length(F.coalesce("name", F.lit(""))) + carried)
    return patterns.agg(F.sum(one)).first()[0] or 0


def semantic_topk(
    symbols: DataFrame,
    patterns: DataFrame,
    topk: int = 50,
    min_cos: float = 0.45,
    max_block_bytes: int = MAX_BLOCK_BYTES,
) -> DataFrame:
    """``pattern_id, pattern_name, symbol_id, repo_id, score``: the best ``topk`` symbols of each pattern.

    Scores reach ``min_cos``; ties go to the smaller ``symbol_id``. Pairs below the threshold, and those
    that a batch already shows to be out of the top k, never leave the task that scans the symbols. The
    catalogue is broadcast in blocks of checked size.
    """
    return _winners(symbols, patterns, topk, min_cos, max_block_bytes, F.lit(0))[0]


def semantic_match(
    symbols: DataFrame,
    patterns: DataFrame,
    topk: int = 50,
    min_cos: float = 0.45,
    max_block_bytes: int = MAX_BLOCK_BYTES,
    vectors: DataFrame | None = None,
    snippet_chars: int | None = None,
    winners: DataFrame | None = None,
) -> DataFrame:
    """Semantic hits: threshold, top-k, then the whole-word gate; so a pattern may end with fewer than ``topk``.

    Texts are fetched for the winners only, in one pass. There are at most ``topk`` winners per pattern: up to
    a bound on what they weigh with their indicators they are broadcast, and the symbol texts are scanned in
    place and not shuffled. Joining on ``repo_id`` as well lets that scan skip the partitions of
    repositories without a winner. Only the first ``snippet_chars`` of a text are its snippet. ``vectors`` is a table of the symbols' vectors, where they are kept apart.
    ``winners`` are the rows of ``semantic_topk``, where they are known already.
    """
    vectors = symbols if vectors is None else vectors
    texts = symbols.select("repo_id", "symbol_id", "name", "docstring", "source")
    carried = F.coalesce(F.octet_length(F.array_join("indicators", "")) + 32 * F.size("indicators"), F.lit(0))
    if winners is None:
        best, size = _winners(vectors, patterns, topk, min_cos, max_block_bytes, carried)
    else:
        best, size = winners, _winner_bytes(patterns, topk, carried)
    wanted = best.join(patterns.select("pattern_id", "indicators"), "pattern_id")
    passes = tx.has_whole_word(
        tx.gate_text(F.col("name"), F.col("docstring"), F.col("source")), F.col("indicators")
    )
    gated = texts.join(F.broadcast(wanted) if size <= MAX_WINNER_BYTES else wanted, ["repo_id", "symbol_id"]).filter(passes)
    snippet = tx.first_chars(F.col("source"), snippet_chars)
    return gated.select(
        "pattern_id",
        "pattern_name",
        "symbol_id",
        "repo_id",
        F.lit("semantic").alias("match_kind"),
        "score",
        tx.semantic_reason(F.col("score")).alias("reason"),
        snippet.alias("code_snippet"),
        tx.text_hash(snippet).alias("snippet_hash"),
    )

"""The hit table: deduplication, insert-or-ignore, hash backfill, enrichment, deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusmatch.functions import text as tx
from corpusmatch.operators.skew import keep_first, spread_join
from corpusmatch.operators.storage import written

HIT_KEY = ["pattern_id", "snippet_hash", "repo_id"]

# Insert order: what is there already wins over keyword hits, and those over semantic hits.
_PRIORITY = {"existing": 0, "keyword": 1, "semantic": 2}


def backfill_hash(hits: DataFrame) -> DataFrame:
    """Fill a NULL or empty ``snippet_hash`` where there is a snippet to hash."""
    missing = F.coalesce(F.col("snippet_hash") == "", F.lit(True)) & F.col("code_snippet").isNotNull()
    filled = F.when(missing, tx.text_hash(F.col("code_snippet"))).otherwise(F.col("snippet_hash"))
    return hits.withColumn("snippet_hash", filled)


def dedup_hits(hits: DataFrame, id_col: str) -> DataFrame:
    """Keep the smallest ``id_col`` (unique) per (pattern, snippet, repository); NULL keys form groups too.

    Only keys and ids are shuffled, and the rows then picked by id.
    """
    first = hits.groupBy(*HIT_KEY).agg(F.min(id_col).alias(id_col)).select(id_col)
    return hits.join(first, id_col, "left_semi")


def insert_ignore(existing: DataFrame | None, keyword: DataFrame, semantic: DataFrame) -> DataFrame:
    """Union of the three with the first hit per (pattern, snippet, repository) winning, without snippets.

    Existing hits come first, then keyword hits by symbol, then semantic hits by falling score. The hash stands for
    the snippet; ``attach_snippets`` fetches it for the hits that are left.
    """
    sources = {"keyword": keyword, "semantic": semantic}
    if existing is not None:
        sources["existing"] = existing
    ranked = None
    for name, hits in sources.items():
        part = hits.drop("code_snippet").withColumn("_priority", F.lit(_PRIORITY[name]))
        ranked = part if ranked is None else ranked.unionByName(part)
    falling = F.when(F.col("_priority") == _PRIORITY["semantic"], -F.col("score"))
    return keep_first(ranked, HIT_KEY, F.col("_priority"), falling, F.col("symbol_id")).drop("_priority")


def attach_snippets(hits: DataFrame, symbols: DataFrame, snippet_chars: int | None = None) -> DataFrame:
    """Hits with ``code_snippet``: the symbol's source, for semantic hits its first ``snippet_chars``."""
    texts = symbols.select("repo_id", "symbol_id", F.col("source").alias("_source"))
    head = tx.first_chars(F.col("_source"), snippet_chars)
    snippet = F.when(F.col("match_kind") == "semantic", head).otherwise(F.col("_source"))
    return hits.join(texts, ["repo_id", "symbol_id"]).withColumn("code_snippet", snippet).drop("_source")


def enrich_hits(hits: DataFrame, repos: DataFrame) -> DataFrame:
    """Hits with their repository's name and URL; a repository may own any share of the hits."""
    names = repos.select("repo_id", F.col("name").alias("repo_name"), F.col("url").alias("repo_url"))
    return spread_join(hits, names, "repo_id", row_key="symbol_id")


def create_enriched_view(hits: DataFrame, repos: DataFrame, name: str = "pattern_hits_enriched") -> None:
    enrich_hits(hits, repos).createOrReplaceTempView(name)


def cascade_delete(
    hits: DataFrame, symbols: DataFrame, files: DataFrame, repos: DataFrame, folder: str | None = None
):
    """``(hits, symbols, files)`` without what belongs to the repositories in ``repos``.

    Follows the keys: repository to files to symbols to hits; the ids that go are worked out once and written.
    """
    gone_repos = repos.select("repo_id").distinct()
    left_files = files.join(gone_repos, "repo_id", "left_semi").select("file_id")
    gone_files = written(left_files, "gone_files", folder)
    gone_symbols = written(symbols.join(gone_files, "file_id", "left_semi").select("symbol_id"), "gone_symbols", folder)
    return (
        spread_join(hits, gone_symbols, "symbol_id", "pattern_id", "left_anti"),
        spread_join(symbols, gone_files, "file_id", "symbol_id", "left_anti"),
        spread_join(files, gone_repos, "repo_id", "file_id", "left_anti"),
    )

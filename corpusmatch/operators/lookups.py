"""Lookups along symbol, file and repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusmatch.operators.skew import spread_join


def symbols_with_repo(symbols: DataFrame, files: DataFrame, repo_id=None) -> DataFrame:
    """Symbols with the repository of their file, of one repository only when ``repo_id`` is given.

    One file may own a large share of the symbols; its rows are spread.
    """
    owners = files.select("file_id", "repo_id")
    if repo_id is not None:
        owners = owners.filter(F.col("repo_id") == F.lit(repo_id))
    return spread_join(symbols.drop("repo_id"), owners, "file_id", row_key="symbol_id")


def repo_of_symbols(ids: DataFrame, symbols: DataFrame, files: DataFrame, repos: DataFrame) -> DataFrame:
    """``symbol_id, repo_id`` for the given symbols, as far as the chain down to ``repos`` holds.

    Plain joins on ids: only what was asked for goes on, and adaptive execution splits a file with very many of them.
    """
    wanted = symbols.select("symbol_id", "file_id").join(ids.select("symbol_id").distinct(), "symbol_id")
    known = files.select("file_id", "repo_id").join(repos.select("repo_id"), "repo_id", "left_semi")
    return wanted.join(known, "file_id").select("symbol_id", "repo_id")


def symbols_without_repo(ids: DataFrame, symbols: DataFrame, files: DataFrame, repos: DataFrame) -> DataFrame:
    """The given symbol ids that lead to no repository; a caller that needs them all fails on any row."""
    found = repo_of_symbols(ids, symbols, files, repos).select("symbol_id", F.lit(True).alias("_found"))
    asked = ids.select("symbol_id").distinct()
    # not an anti join: Spark would move that below the distinct, where copies of an id are still apart
    return asked.join(found, "symbol_id", "left").filter(F.col("_found").isNull()).drop("_found")

"""Keyword scan: every pattern's indicators against every symbol's name and docstring."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from corpusmatch.functions import text as tx
from corpusmatch.functions.worker import once_per_worker
from corpusmatch.operators.bounded import collect_in_blocks
from corpusmatch.schemas import table

# A block of indicators is held by every Python worker as an automaton, some ten times its size.
MAX_KEYWORD_BYTES = 16 << 20


def _matcher(block: list[Row], id_type: DataType):
    """Arrow UDF: text -> [(pattern_id, pattern_name, indicators found)], one pass over the text for all needles."""
    match_type = ArrayType(table(pattern_id=id_type, pattern_name=StringType(), words=ArrayType(StringType())))
    arrow_type = to_arrow_type(match_type)
    owners_by_needle: dict[str, list[tuple[int, str]]] = {}
    for number, row in enumerate(block):
        for word in dict.fromkeys(w for w in row["indicators"] if w):
            owners_by_needle.setdefault(word.lower(), []).append((number, word))
    named = [(row["pattern_id"], row["pattern_name"]) for row in block]
    shared = SparkSession.active().sparkContext.broadcast((owners_by_needle, named))
    key = uuid.uuid4().hex

    @F.arrow_udf(match_type)
    def match(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        def build():
            automaton = ahocorasick.Automaton()
            for needle, owners in shared.value[0].items():
                automaton.add_word(needle, (needle, owners))
            automaton.make_automaton()
            return automaton

        automaton, named = once_per_worker(("keywords", key), build, keep=2), shared.value[1]
        for texts in batches:
            found = []
            for value in texts:
                needles = dict(hit for _, hit in automaton.iter((value.as_py() or "").lower()))
                words_by_pattern: dict[int, list[str]] = {}
                for owners in needles.values():
                    for pattern, word in owners:
                        words_by_pattern.setdefault(pattern, []).append(word)
                found.append([(*named[p], words) for p, words in words_by_pattern.items()])
            yield pa.array(found, type=arrow_type)

    return match


def keyword_pairs(
    symbols: DataFrame, patterns: DataFrame, text: Column, max_block_bytes: int = MAX_KEYWORD_BYTES
) -> DataFrame:
    """``symbols`` columns plus ``pattern_id, pattern_name, words`` for each pattern with an indicator in ``text``.

    Substring containment, ignoring case. The symbols are neither shuffled nor paired with the
    patterns: one automaton over a block of the catalogue reads each text once, and only ``text`` travels
    to Python. A pattern's indicators share a block, so its words come out of one row whole.
    """
    catalogue = patterns.select("pattern_id", F.col("name").alias("pattern_name"), "indicators").filter(
        F.exists("indicators", lambda w: w != "")
    )
    words_bytes = F.octet_length(F.array_join("indicators", "")) + 64 * F.size("indicators")
    row_bytes = F.octet_length("pattern_name") + words_bytes
    id_type = catalogue.schema["pattern_id"].dataType
    scanned = []
    for block in collect_in_blocks(catalogue, row_bytes, max_block_bytes):
        match = _matcher(block, id_type)
        scanned.append(symbols.withColumn("_match", F.explode(match(text))).select(*symbols.columns, "_match.*"))
    if not scanned:
        found = table(pattern_id=id_type, pattern_name=StringType(), words=ArrayType(StringType()))
        return symbols.sparkSession.createDataFrame([], StructType(symbols.schema.fields + found.fields))
    return reduce(DataFrame.unionByName, scanned)


def keyword_scan(symbols: DataFrame, patterns: DataFrame, max_block_bytes: int = MAX_KEYWORD_BYTES) -> DataFrame:
    """Keyword hits. The snippet is the full source; duplicates are left to ``insert_ignore``."""
    needed = symbols.select("symbol_id", "repo_id", "name", "docstring", "source")
    pairs = keyword_pairs(needed, patterns, tx.keyword_text(F.col("name"), F.col("docstring")), max_block_bytes)
    return pairs.select(
        "pattern_id",
        "pattern_name",
        "symbol_id",
        "repo_id",
        F.lit("keyword").alias("match_kind"),
        F.lit(None).cast("double").alias("score"),
        tx.keyword_reason(F.col("words")).alias("reason"),
        F.col("source").alias("code_snippet"),
        tx.text_hash(F.col("source")).alias("snippet_hash"),
    )

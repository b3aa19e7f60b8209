"""The pattern catalogue: a delimited text file with free-form headers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from corpusmatch.functions import text as tx
from corpusmatch.operators.embed import Encoder, embed_texts
from corpusmatch.operators.upserts import last_per_key
from corpusmatch.schemas import PATTERNS, conform, key_of
from corpusmatch.sources.sheets import read_sheet_in_blocks

# Accepted headers (after normalising) and the column each one fills.
HEADERS = {
    "pattern_name": "name",
    "name": "name",
    "description": "description",
    "motivation": "motivation",
    "solution": "solution",
    "alias": "alias",
    "sub_category": "sub_category",
    "subcategory": "sub_category",
    "category": "category",
    "resources": "resources",
    "link": "link",
    "url": "link",
    "type": "ptype",
    "comments": "comments",
    "comment": "comments",
}
# The columns that are stripped on load; the others are kept as they are.
_STRIPPED = {"description", "motivation", "solution"}


def normalize_header(header: str) -> str:
    return re.sub(r"\s+", "_", header.strip().lower())


def read_sheet(spark: SparkSession, path: str, sep: str = ",", encoding: str = "utf-8") -> DataFrame:
    """The file as strings under its own headers, blanks as ''; quoted fields may span lines.

    ``encoding='cp1252'`` needs ``spark.sql.legacy.javaCharsets``. A header that repeats an earlier one
    to the letter gets a suffix and so maps to nothing.
    """
    reader = spark.read.options(sep=sep, encoding=encoding, multiLine=True, quote='"', escape='"')
    headers = _headers(reader.csv(path, header=False).first())
    return reader.csv(path, header=True, enforceSchema=True).toDF(*headers).na.fill("")


def read_large_sheet(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """The same by as many tasks as the file has blocks, with ``_row_in_file`` for the order of the rows; UTF-8 only."""
    reader = spark.read.options(sep=sep, multiLine=True, quote='"', escape='"')
    return read_sheet_in_blocks(spark, path, _headers(reader.csv(path, header=False).first()), sep)


def _headers(first: Row | None) -> list[str]:
    headers: list[str] = []
    for position, value in enumerate(first or []):
        header = (value or "").removeprefix("\ufeff")
        headers.append(f"{header}.{position}" if header in headers else header)
    return headers


def catalog_from_sheet(sheet: DataFrame, pos: str | None = None) -> DataFrame:
    """Map headers, clean names, drop rows without a name, keep the last row of each name.

    ``pos`` is the column that holds the row order; the file order is used without it. Of two headers
    for one column the later wins. Loading leaves ``indicators`` empty: no keyword gate by default.
    """
    ordered = sheet.withColumn("_pos", F.monotonically_increasing_id() if pos is None else F.col(pos))
    chosen = {HEADERS[n]: i for i, n in enumerate(map(normalize_header, sheet.columns)) if n in HEADERS}
    if "name" not in chosen:
        raise ValueError(f"no column of the sheet holds the names of patterns: {', '.join(sheet.columns)}")
    by_position = ordered.toDF(*[f"_c{i}" for i in range(len(sheet.columns))], "_pos")
    columns = []
    for field in PATTERNS.fieldNames():
        if field in ("pattern_id", "indicators", "embedding"):
            continue
        value = tx.text_or_empty(F.col(f"_c{chosen[field]}").cast("string")) if field in chosen else F.lit("")
        value = tx.clean_pattern_name(value) if field == "name" else tx.strip(value) if field in _STRIPPED else value
        columns.append(value.alias(field))
    named = by_position.select(*columns, "_pos").filter(F.col("name") != "")
    rows = last_per_key(named, "name", "_pos")
    return conform(
        rows.withColumn("pattern_id", key_of(F.col("name"))).withColumn("indicators", F.array().cast("array<string>")),
        PATTERNS,
    )


def embed_catalog(patterns: DataFrame, encoder: Encoder) -> DataFrame:
    """Patterns with the vector of their text (name first)."""
    text = tx.pattern_text(F.col("name"), F.col("description"), F.col("motivation"), F.col("solution"))
    return embed_texts(patterns.withColumn("_text", text), "_text", encoder).drop("_text")


def load_patterns(
    spark: SparkSession, path: str, encoder: Encoder | None = None, sep: str = ",", encoding: str = "utf-8"
) -> DataFrame:
    """The catalogue file as the ``patterns`` table, embedded when an encoder is given."""
    if encoding.lower() in ("utf-8", "utf8"):
        patterns = catalog_from_sheet(read_large_sheet(spark, path, sep), "_row_in_file")
    else:
        patterns = catalog_from_sheet(read_sheet(spark, path, sep, encoding))
    return patterns if encoder is None else embed_catalog(patterns, encoder)

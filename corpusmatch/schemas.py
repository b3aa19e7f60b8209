"""Fixed table schemas and the projection that conforms older data to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType,
    DataType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

_STRING, _INT, _DOUBLE, _TIME = StringType(), IntegerType(), DoubleType(), TimestampType()
_STRINGS, VECTOR = ArrayType(_STRING), ArrayType(FloatType())


def table(**fields: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


REPOS = table(
    repo_id=_STRING, url=_STRING, name=_STRING, local_path=_STRING, default_branch=_STRING, last_sync_ts=_TIME
)
FILES = table(file_id=_STRING, repo_id=_STRING, path=_STRING, rel_path=_STRING, lang=_STRING, sha256=_STRING)
SYMBOLS = table(
    symbol_id=_STRING,
    file_id=_STRING,
    repo_id=_STRING,
    ordinal=_INT,
    kind=_STRING,
    name=_STRING,
    lineno=_INT,
    end_lineno=_INT,
    signature=_STRING,
    docstring=_STRING,
    parent_name=_STRING,
    source=_STRING,
    embedding=VECTOR,
)
# Files as they are stored: with what went wrong while their symbols were extracted, and by which extraction.
INDEXED_FILES = StructType([*FILES.fields, StructField("error", _STRING), StructField("extraction", _STRING)])
# The vectors of the symbols on their own: scoring reads nothing else of a symbol.
SYMBOL_VECTORS = table(symbol_id=_STRING, repo_id=_STRING, text_hash=_STRING, embedding=VECTOR)
PATTERNS = table(
    pattern_id=_STRING,
    name=_STRING,
    description=_STRING,
    motivation=_STRING,
    solution=_STRING,
    alias=_STRING,
    sub_category=_STRING,
    category=_STRING,
    resources=_STRING,
    link=_STRING,
    ptype=_STRING,
    comments=_STRING,
    indicators=_STRINGS,
    embedding=VECTOR,
)
HITS = table(
    pattern_id=_STRING,
    pattern_name=_STRING,
    symbol_id=_STRING,
    repo_id=_STRING,
    match_kind=_STRING,
    score=_DOUBLE,
    reason=_STRING,
    code_snippet=_STRING,
    snippet_hash=_STRING,
)
# The kept best rows of each pattern, and from where on rows were left out.
RESERVE = table(pattern_id=_STRING, pattern_name=_STRING, symbol_id=_STRING, repo_id=_STRING, score=_DOUBLE)
FLOORS = table(pattern_id=_STRING, signature=LongType(), floor_score=_DOUBLE, floor_symbol=_STRING)
CACHE = table(text_hash=_STRING, embedding=VECTOR)
# The cache as it is stored: with the name of the encoder that made the vector.
STORED_CACHE = StructType([*CACHE.fields, StructField("encoder", _STRING)])


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Project ``df`` onto ``schema``; a column it lacks becomes NULL, an unknown one is dropped."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def key_of(*parts: Column) -> Column:
    """Deterministic surrogate key: sha256 over the NUL-joined parts."""
    return F.sha2(F.concat_ws("\u0000", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)

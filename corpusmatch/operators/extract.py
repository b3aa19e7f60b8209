"""Symbol extraction: files in, symbols out, one pass over the file contents.

Whole-file symbols are plain projections. Python and notebook files need a grammar, so their text, and
only theirs, goes through an Arrow UDF that parses one file at a time.
"""

from __future__ import annotations

import ast
import json
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StringType, StructType

from corpusmatch.functions import text as tx
from corpusmatch.schemas import SYMBOLS, key_of, table

# Languages kept as one symbol per file.
CONFIG_LANGS = ["yaml", "json", "toml", "ini", "dockerfile", "requirements"]
DOC_LANGS = ["markdown", "text"]
PARSED_LANGS = ["python", "ipynb"]

_SYMBOL_FIELDS = ["kind", "name", "lineno", "end_lineno", "signature", "docstring", "parent_name", "source"]
_PARSED = table(symbols=ArrayType(StructType([SYMBOLS[name] for name in _SYMBOL_FIELDS])), error=StringType())
_PARSED_ARROW = to_arrow_type(_PARSED)

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _signature(function) -> str:
    """Argument names only; positional-only ones, defaults, annotations and a bare ``*`` are left out."""
    a = function.args
    names = [x.arg for x in a.args]
    names += [f"*{a.vararg.arg}"] if a.vararg else []
    names += [x.arg for x in a.kwonlyargs]
    names += [f"**{a.kwarg.arg}"] if a.kwarg else []
    return f"({', '.join(names)})"


def _definitions(tree: ast.AST) -> Iterator[tuple[str, ast.AST, str | None]]:
    """(kind, node, parent name) in source order, without what is defined inside a function.

    A class is followed by its own methods; those come up again as functions when the class body is
    walked, which is wanted: they count as symbols twice.
    """
    pending = [tree]
    while pending:
        node = pending.pop()
        if isinstance(node, _FUNCTIONS):
            yield "function", node, None
            continue
        if isinstance(node, ast.ClassDef):
            yield "class", node, None
            yield from (("method", m, node.name) for m in node.body if isinstance(m, _FUNCTIONS))
        pending.extend(reversed(list(ast.iter_child_nodes(node))))


def python_symbols(source: str) -> Iterator[dict]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(source)
    lines = source.split("\n")

    def text_of(node) -> str:
        # columns are byte offsets
        first, last = node.lineno - 1, node.end_lineno - 1
        tail = lines[last].encode()[: node.end_col_offset]
        if first == last:
            return tail[node.col_offset :].decode()
        head = lines[first].encode()[node.col_offset :]
        return "\n".join([head.decode(), *lines[first + 1 : last], tail.decode()])

    for kind, node, parent in _definitions(tree):
        yield {
            "kind": kind,
            "name": node.name,
            "lineno": node.lineno,
            "end_lineno": node.end_lineno,
            "signature": None if kind == "class" else _signature(node),
            "docstring": ast.get_docstring(node),
            "parent_name": parent,
            "source": text_of(node),
        }


def notebook_cells(text: str) -> list[dict]:
    """Every cell in order, its type as kind; what is a symbol and its name is decided in ``_cell_symbols``."""
    try:
        cells = json.loads(text).get("cells", ())
    except ValueError:
        return []
    return [{"kind": f"{c.get('cell_type', '')}", "source": "".join(c.get("source", ()))} for c in cells]


def _cell_symbols(cells: Column) -> Column:
    """Cells with a source as symbols; the name has the number that the cell has among all cells."""

    def named(cell: Column, number: Column) -> Column:
        kind = F.when(cell["kind"] == "code", "notebook_code").otherwise("notebook_markdown")
        name = F.concat(F.lit("cell_"), number, F.lit("_"), cell["kind"])
        return cell.withField("name", name).withField("kind", kind)

    return F.filter(F.transform(cells, named), lambda cell: tx.strip(cell["source"]) != "")


def _parse(lang: str, text: str) -> dict:
    """Symbols of one file and what went wrong, so that a bad file costs only itself."""
    symbols = []
    try:
        for symbol in list(python_symbols(text) if lang == "python" else notebook_cells(text)):
            for field in ("name", "docstring", "source"):
                (symbol.get(field) or "").encode()  # a lone surrogate cannot be stored
            symbols.append(symbol)
    except Exception as e:
        message = f"{type(e).__name__}: {e}".encode(errors="replace").decode()
        return {"symbols": symbols, "error": message}
    return {"symbols": symbols, "error": None}


@F.arrow_udf(_PARSED)
def _parse_files(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for langs, texts in batches:
        pairs = zip(langs.to_pylist(), texts)
        yield pa.array([_parse(lang, t.as_py()) if t.is_valid else None for lang, t in pairs], type=_PARSED_ARROW)


# or Spark would parse once more for every filter on the result
_parse_files = _parse_files.asNondeterministic()


def _whole_file(kind: str) -> Column:
    nothing = F.lit(None)
    return F.array(
        F.struct(
            F.lit(kind).alias("kind"),
            F.col("rel_path").alias("name"),
            nothing.cast("int").alias("lineno"),
            nothing.cast("int").alias("end_lineno"),
            nothing.cast("string").alias("signature"),
            nothing.cast("string").alias("docstring"),
            nothing.cast("string").alias("parent_name"),
            tx.text_or_empty(F.col("text")).alias("source"),
        )
    )


def extract(files: DataFrame) -> DataFrame:
    """``files`` (with ``lang``, ``rel_path``, ``text``) plus ``symbols ARRAY<STRUCT>`` and ``error``, minus ``text``."""
    lang = F.col("lang")
    parsed = files.withColumn("_parsed", _parse_files(lang, F.when(lang.isin(PARSED_LANGS), F.col("text"))))
    symbols = (
        F.when(lang.isin(CONFIG_LANGS), _whole_file("config"))
        .when(lang.isin(DOC_LANGS), _whole_file("doc"))
        .when(lang == "ipynb", _cell_symbols(F.coalesce(F.col("_parsed.symbols"), F.array())))
        .otherwise(F.coalesce(F.col("_parsed.symbols"), F.array()))
    )
    return parsed.select(
        *[c for c in files.columns if c != "text"],
        F.when(F.col("text").isNotNull(), symbols).alias("symbols"),
        F.col("_parsed.error").alias("error"),
    )


def symbols_of(extracted: DataFrame) -> DataFrame:
    """One row per symbol with its position in the file."""
    exploded = extracted.select("file_id", "repo_id", F.posexplode("symbols").alias("ordinal", "_symbol"))
    return exploded.select(
        key_of(F.col("file_id"), F.col("ordinal")).alias("symbol_id"), "file_id", "repo_id", "ordinal", "_symbol.*"
    )


def errors_of(extracted: DataFrame) -> DataFrame:
    """One row per file whose extraction failed."""
    return extracted.filter(F.col("error").isNotNull()).select("file_id", "repo_id", "rel_path", "error")

import json

from pyspark.sql import functions as F

from corpusmatch.operators import extract as ex

SOURCE = '''\
"""Module."""
import os

@decorator(option=1)
class Outer(Base):
    """First é.

        Indented.
    """
    x = 1

    @property
    def first(self, a, /, b, *args, key=1, **kw):
        """Doc é."""
        return lambda q: q

    class Nested:
        async def go(self): pass

    if x:
        def guarded(self): pass
        class InIf:
            def deep(self): pass

    try:
        def tried(self): pass
    except Exception:
        def caught(self): pass
    else:
        pass

def top(*, only):
    class Hidden:
        def no(self): pass
    def inner(): pass
    return "é"; y = 2

async def later(a: int = 1, *b) -> None: é = 1

for _ in ():
    def looped(): pass
'''


def _files(spark, files):
    rows = [(str(i), "r", path, lang, text) for i, (path, lang, text) in enumerate(files)]
    return ex.extract(spark.createDataFrame(rows, "file_id string, repo_id string, rel_path string, lang string, text string"))


def _symbols(spark, files):
    return sorted(ex.symbols_of(_files(spark, files)).collect(), key=lambda r: (int(r["file_id"]), r["ordinal"]))


def test_python_symbols(spark):
    rows = _symbols(spark, [("a.py", "python", SOURCE)])
    assert [(r["kind"], r["name"], r["parent_name"], r["signature"]) for r in rows] == [
        ("class", "Outer", None, None),
        ("method", "first", "Outer", "(b, *args, key, **kw)"),
        ("function", "first", None, "(b, *args, key, **kw)"),
        ("class", "Nested", None, None),
        ("method", "go", "Nested", "(self)"),
        ("function", "go", None, "(self)"),
        ("function", "guarded", None, "(self)"),
        ("class", "InIf", None, None),
        ("method", "deep", "InIf", "(self)"),
        ("function", "deep", None, "(self)"),
        ("function", "tried", None, "(self)"),
        ("function", "caught", None, "(self)"),
        ("function", "top", None, "(only)"),
        ("function", "later", None, "(a, *b)"),
        ("function", "looped", None, "()"),
    ]
    lines = SOURCE.split("\n")
    for r in rows:
        # nothing precedes a definition on its first line here, and no other statement ends on its last
        segment = "\n".join(lines[r["lineno"] - 1 : r["end_lineno"]]).lstrip()
        assert r["source"] == segment.removesuffix("; y = 2") or r["name"] == "top"
        assert r["source"].startswith(("def ", "class ", "async def "))
    outer, first, top = rows[0], rows[1], rows[12]
    assert outer["docstring"] == "First é.\n\nIndented." and outer["lineno"] == 5
    assert first["docstring"] == "Doc é." and rows[3]["docstring"] is None
    assert top["source"].endswith('return "é"; y = 2')
    assert len({r["symbol_id"] for r in rows}) == len(rows)


def test_whole_files_and_other_languages(spark):
    files = [("c.yaml", "yaml", "a: 1"), ("d.md", "markdown", ""), ("Dockerfile", "dockerfile", "FROM x"), ("n.txt", "text", "t")]
    got = [(r["kind"], r["name"], r["source"], r["lineno"], r["docstring"]) for r in _symbols(spark, files)]
    assert got == [
        ("config", "c.yaml", "a: 1", None, None), ("doc", "d.md", "", None, None),
        ("config", "Dockerfile", "FROM x", None, None), ("doc", "n.txt", "t", None, None),
    ]


def test_notebook_cells(spark):
    cells = [
        {"cell_type": "code", "source": ["a = 1\n", "b"]},
        {"cell_type": "markdown", "source": "# text"},
        {"cell_type": "code", "source": [" \n"]},
        {"cell_type": "raw", "source": '["looks", "like a list"]'},
        {"source": ["no type"]},
        {"cell_type": None, "source": "null type"},
        {"cell_type": "code"},
        {"cell_type": "code", "source": []},
    ]
    got = _symbols(spark, [("n.ipynb", "ipynb", json.dumps({"cells": cells, "n": float("nan")}))])
    assert [(r["kind"], r["name"], r["source"]) for r in got] == [
        ("notebook_code", "cell_0_code", "a = 1\nb"),
        ("notebook_markdown", "cell_1_markdown", "# text"),
        ("notebook_markdown", "cell_3_raw", '["looks", "like a list"]'),
        ("notebook_markdown", "cell_4_", "no type"),
        ("notebook_markdown", "cell_5_None", "null type"),
    ]


def test_a_bad_file_costs_only_itself(spark):
    bad = [
        ("syntax.py", "python", "def ("),
        ("bom.py", "python", "﻿x = 1"),
        ("nul.py", "python", "x = '\0'"),
        ("deep.py", "python", "(" * 5000),
        ("list.ipynb", "ipynb", "[1]"),
        ("cell.ipynb", "ipynb", '{"cells": [{"source": "kept?"}, {"source": [1]}]}'),
        ("lone.py", "python", 'def a():\n    "fine"\n\ndef b():\n    "\\ud800"\n\ndef c(): pass\n'),
    ]
    fine = [("ok.py", "python", "def ok(): pass"), ("none.ipynb", "ipynb", "not json"), ("empty.ipynb", "ipynb", "{}"), ("gone.py", "python", None)]
    extracted = _files(spark, bad + fine).cache()
    errors = {r["rel_path"]: r["error"].split(":")[0] for r in ex.errors_of(extracted).collect()}
    assert set(errors) == {path for path, _, _ in bad}
    assert errors["syntax.py"] == "SyntaxError" and errors["list.ipynb"] == "AttributeError"
    # what precedes an unstorable symbol stays
    assert sorted(r["name"] for r in ex.symbols_of(extracted).collect()) == ["a", "ok"]
    assert extracted.count() == len(bad + fine)


def test_generated_files_are_dealt_out_by_their_number(spark, tmp_path, monkeypatch):
    """A small file of many parts is many tasks; keys may repeat or be null."""
    from corpusmatch.plans import roles

    rows = [(None if i % 9 == 0 else i % 50, f"name {i}", "type", i, "brand") for i in range(95)]
    parts = spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_size int, p_brand string")
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    whole = roles.Corpus(spark, str(tmp_path)).part_sources().collect()
    monkeypatch.setattr(roles, "FILES_PER_TASK", 10)
    files = roles.Corpus(spark, str(tmp_path)).part_sources()
    sizes = files.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 10 and max(r["count"] for r in sizes) <= 12
    assert sorted(map(str, files.collect())) == sorted(map(str, whole)) and len(whole) == 95

import re

import pytest
from pyspark.sql import functions as F

from corpusmatch.functions import text as tx, vectors as vx


def _evaluate(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_strip_agrees_with_str_strip(spark):
    values = [chr(c) + "x y" + chr(c) for c in range(0x3100) if chr(c).isspace()] + ["", "​ a", " \t\n"]
    got = _evaluate(spark, [(v,) for v in values], "s string", tx.strip(F.col("s")))
    assert [g for (g,) in got] == [v.strip() for v in values]


LANGS = {
    "a/b.py": "python", "pkg/__init__.py": "python", ".py": "unknown", "..py": "python", "x.PY": "unknown",
    "Dockerfile": "dockerfile", "sub/Dockerfile": "dockerfile", "dockerfile": "unknown", "requirements.txt": "requirements",
    "dev-requirements.txt": "text", "environment.yml": "yaml", "pyproject.toml": "toml", "README.md": "markdown",
    "readme.md": "markdown", ".h.md": "markdown", ".md": "unknown", "c.conf": "ini", "c.cfg": "ini", "nb.ipynb": "ipynb",
    "a.tar.json": "json", "a.": "unknown", "noext": "unknown", "x.rs": "unknown", "dir.py/file": "unknown",
}


def test_detect_lang(spark):
    got = _evaluate(spark, [(p,) for p in LANGS], "p string", F.col("p"), tx.detect_lang(F.col("p")))
    assert dict(got) == LANGS


WORDS = ["tool", "über", "tool use", "a.b", "C#", "re$act", "工具", "c++", " agent ", "", None, "x\\Ey", "_id", "x²"]
TEXTS = [
    "A Tool.", "toolbox", "tool_use", "ÜBER alles", "uber", "tool use", "tool  use", "a.b", "axb", "C# now", "C#x",
    "re$act", "工具 x", "工具箱", "c++", "c++x", "agents", "agent", "x\\Ey", "my_id", "_id", "x²", "x²y", "xx²", "",
]


def _reference_gate(text, indicators):
    if not indicators:
        return True
    words = [(w or "").strip() for w in indicators]
    return any(re.search(rf"\b{re.escape(w)}\b", text, re.IGNORECASE) for w in words if w)


def test_whole_word_agrees_with_the_definition(spark):
    rows = [(t, [w]) for t in TEXTS for w in WORDS] + [(t, []) for t in TEXTS] + [(t, None) for t in TEXTS]
    rows += [(t, ["nothing", "tool"]) for t in TEXTS] + [(t, [" ", None]) for t in TEXTS]
    # the first place has no boundary but a later one has, also where places overlap; marks in the text; case folds
    more = ["toolbox tool", "xa a a", "a a a", "aa.aa.aa", "x.a.b.a", "\ue000tool", "too\ue000l", "ΟΔΟΣ οδος", "ſtar", "µm", "İx ıx"]
    rows += [(t, [w]) for t in more for w in ["tool", "a a", "aa.aa", ".a.b", "a.b.a", "οδοσ", "ΟΔΟΣ", "star", "μM", "l"]]
    whole = tx.has_whole_word(F.col("t"), F.col("w"))
    got = _evaluate(spark, rows, "t string, w array<string>", whole)
    assert [g for (g,) in got] == [_reference_gate(*r) for r in rows]
    got = _evaluate(spark, rows, "t string, w array<string>", tx.has_whole_word(tx.folded(F.col("t")), F.col("w"), tx.words_of(tx.folded(F.col("t")))))
    assert [g for (g,) in got] == [_reference_gate(*r) for r in rows]


def test_line_slice_agrees_with_splitlines(spark):
    def expected(source, first, last):
        if not first or not last:
            return ""
        return "\n".join(source.splitlines()[max(first - 1, 0) : last])

    sources = ["", "one", "a\nb\nc", "a\r\nb\rc\n", "a\x0bb\x0cc d\x85e\n\n", "\n\n"]
    rows = [(s, a, b) for s in sources for a in (None, 0, 1, 2, 3, 9) for b in (None, 0, 1, 2, 3, 9)]
    got = _evaluate(
        spark, rows, "s string, a int, b int", tx.line_slice(F.col("s"), F.col("a"), F.col("b"))
    )
    assert [g for (g,) in got] == [expected(*r) for r in rows]


def test_decode_agrees_with_ignoring_errors(spark):
    values = [
        b"plain", b"\xef\xbb\xbfbom", b"a\xffb", b"\xe2\x82", b"a\xe2\x82b\xf0\x9f\x98", b"\xc3\x28", b"crlf\r\nx\ry\n",
        "genuine �".encode(), "genuine �".encode() + b"\xff", b"\xed\xa0\x80x", b"\xf5\x80\x80\x80", b"\xc0\xaf", b"",
    ]
    rows = [(bytearray(v),) for v in values]
    got = _evaluate(spark, rows, "b binary", tx.decode_utf8(F.col("b")))

    def expected(b):
        return b.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")

    assert [g for (g,) in got] == [expected(v) for v in values]


def test_names_and_texts(spark):
    names = {
        "ReAct [12a]": "ReAct", "Plan (3)": "Plan", "a  b\t\tc": "a b c", "[ 1 ]": "", " x ( 2b ) y ": "x y",
        "keep [x1] (12x3)": "keep [x1] (12x3)", "t  u": "t u",
    }
    got = _evaluate(spark, [(n,) for n in names], "n string", F.col("n"), tx.clean_pattern_name(F.col("n")))
    assert dict(got) == names
    urls = {
        "https://h/o/r.git": "r", "https://h/o/r/": "r", "https://h/o/a.github.io": "ahub.io", "r": "r", "h/x.git.git//": "x",
    }
    got = _evaluate(spark, [(u,) for u in urls], "u string", F.col("u"), tx.repo_name(F.col("u")))
    assert dict(got) == urls


@pytest.mark.parametrize("max_body, kept", [(None, 2000), (1500, 1500), (10, 10)])
def test_symbol_text(spark, max_body, kept):
    rows = [("n", None, "", "\U0001f600" * 2000), (None, None, None, None), ("n", "k", "d", " s ")]
    text = tx.symbol_text(F.col("n"), F.col("k"), F.col("d"), F.col("s"), max_body)
    got = _evaluate(spark, rows, "n string, k string, d string, s string", text)
    assert got == [("n\n" + "\U0001f600" * kept,), ("",), ("k\nn\nd\n s",)]


def test_reasons_round_like_printf(spark):
    scores = [i / 1000 for i in range(-1000, 1001)] + [0.125, 0.375, 0.625, 0.005, 0.015, 1.0, 0.985]
    got = _evaluate(spark, [(s,) for s in scores], "s double", tx.semantic_reason(F.col("s")))
    assert [g for (g,) in got] == [f"semantic={s:.2f}" for s in scores]
    got = _evaluate(spark, [(["b", "a", "b", "B"],)], "w array<string>", tx.keyword_reason(F.col("w")))
    assert got == [("matched: B, a, b",)]


def test_vectors(spark):
    rows = [([3.0, 4.0], [1.0, 0.0]), ([0.0, 0.0], [1.0]), (None, [1.0]), ([1.0], None)]
    got = _evaluate(
        spark, rows, "a array<float>, b array<float>", vx.l2_normalize(F.col("a")), vx.cosine(F.col("a"), F.col("b"))
    )
    assert got[0][1] == 3.0 and [round(x, 6) for x in got[0][0]] == [0.6, 0.8]
    assert got[1] == ([0.0, 0.0], -1.0) and got[2] == (None, -1.0) and got[3][1] == -1.0
    texts = [("[1.5, 2]",), ("",), (None,), ("{",), ("[1",), ('{"a": 1}',)]
    got = _evaluate(spark, texts, "j string", vx.from_json_text(F.col("j")), tx.json_strings(F.col("j")))
    assert [g[0] for g in got] == [[1.5, 2.0], None, None, None, None, None]
    assert [g[1] for g in got][1:] == [[], [], [], [], []]

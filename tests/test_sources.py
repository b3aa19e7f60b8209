import os

import pytest

from corpusmatch.operators.embed import hashed_bag_of_words
from corpusmatch.schemas import FILES, PATTERNS, conform
from corpusmatch.sources import catalog, files as fs, lines as ls
from corpusmatch.sources.tables import Tables


def test_collect_urls(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("\n# note\n  u1  \r\nu2\n\t# no\nu1\nu3 - 5".encode())
    (tmp_path / "b.txt").write_text("u4\nu2\nu0\n")
    entries = ls.collect_urls(spark, ["u9", f"@{tmp_path}/a.txt", "u3 - 5", "u9", f"@{tmp_path}/missing"], f"{tmp_path}/b.txt")
    assert [r["url"] for r in entries.collect()] == ["u9", "u1", "u2", "u3 - 5", "u4", "u0"]
    assert ls.collect_urls(spark, []).count() == 0
    assert ls.read_list(spark, f"{tmp_path}/missing").count() == 0


CSV = '''Pattern Name,Description,pattern name,MOTIVATION,Sub Category,subcategory,URL,Type,Extra
ReAct [12a]," two
lines, ""quoted"" ",ReAct [12a], why ,first,second, l ,T,x
(3),d,(3),m,,,,,
Plan  it (4),old,Plan  it (4),m,,,,,
,d,,m,,,,,
Plan it,new,Plan it,,,,,,
'''


@pytest.mark.parametrize("sep, prefix", [(",", ""), (";", "﻿")])
def test_load_patterns(spark, tmp_path, sep, prefix):
    path = tmp_path / "catalog.csv"
    text = CSV if sep == "," else CSV.replace("lines, ", "lines# ").replace(",", ";").replace("lines# ", "lines, ")
    path.write_bytes((prefix + text).encode())
    patterns = catalog.load_patterns(spark, str(path), sep=sep)
    assert patterns.schema == PATTERNS or patterns.columns == PATTERNS.fieldNames()
    rows = {r["name"]: r for r in patterns.collect()}
    assert set(rows) == {"ReAct", "Plan it"}
    react = rows["ReAct"]
    assert react["description"] == 'two\nlines, "quoted"' and react["motivation"] == "why"
    assert react["sub_category"] == "second" and react["link"] == " l " and react["ptype"] == "T"
    assert react["alias"] == "" and react["indicators"] == [] and react["embedding"] is None
    assert rows["Plan it"]["description"] == "new"


def test_catalog_in_a_legacy_encoding(spark, tmp_path):
    (tmp_path / "old.csv").write_bytes("name\tdescription\nCafé\t“quoted”\n".encode("cp1252"))
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    try:
        row = catalog.load_patterns(spark, f"{tmp_path}/old.csv", sep="\t", encoding="cp1252").first()
    finally:
        spark.conf.unset("spark.sql.legacy.javaCharsets")
    assert (row["name"], row["description"]) == ("Café", "“quoted”")


def test_catalog_variants(spark, tmp_path):
    repeated = spark.createDataFrame([("a", "b", "c")], "Name string, `Pattern  Name` string, d string")
    assert [r["name"] for r in catalog.catalog_from_sheet(repeated).collect()] == ["b"]
    (tmp_path / "twice.csv").write_text("Name,Name\nfirst,second\n")
    assert [r["name"] for r in catalog.load_patterns(spark, f"{tmp_path}/twice.csv").collect()] == ["first"]
    (tmp_path / "short.csv").write_text("name,description,link\nx\n\ny,d\n")
    got = catalog.load_patterns(spark, f"{tmp_path}/short.csv", hashed_bag_of_words(8)).collect()
    assert sorted((r["name"], r["description"], r["link"], len(r["embedding"])) for r in got) == [("x", "", "", 8), ("y", "d", "", 8)]
    with pytest.raises(ValueError):
        catalog.catalog_from_sheet(spark.createDataFrame([("x",)], "title string"))


@pytest.fixture
def tree(tmp_path):
    def put(path, content):
        target = tmp_path / "root" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content)

    put("pkg/__init__.py", b"x=1\r\n")
    put("pkg/_private/deep/.hidden.md", b"h")
    put("pkg/bytes.py", b"y = '\xff'")
    put("Dockerfile", b"FROM x")
    put(".git/config.ini", b"no")
    put("sub/.git/x.md", b"no")
    put(".github/wf.yml", b"yes")
    put("a b #%.txt", b"odd name")
    put("y.rs", b"unknown")
    os.symlink(tmp_path / "root" / "Dockerfile", tmp_path / "root" / "link.md")
    os.symlink(tmp_path / "root" / "pkg", tmp_path / "root" / "linked")
    return str(tmp_path / "root")


KNOWN = [".github/wf.yml", "Dockerfile", "a b #%.txt", "link.md", "pkg/__init__.py", "pkg/_private/deep/.hidden.md", "pkg/bytes.py"]


def test_read_tree(spark, tree):
    import hashlib

    contents = fs.read_tree(spark.createDataFrame([("r", tree)], "repo_id string, root string"))
    rows = {r["rel_path"]: r for r in fs.index_files(contents).collect()}
    assert sorted(rows) == KNOWN
    assert rows["pkg/__init__.py"]["text"] == "x=1\n"
    assert rows["pkg/__init__.py"]["sha256"] == hashlib.sha256(b"x=1\r\n").hexdigest()
    assert rows["pkg/bytes.py"]["text"] == "y = ''" and rows["pkg/bytes.py"]["lang"] == "python"
    assert rows["pkg/__init__.py"]["path"] == f"{tree}/pkg/__init__.py"


def test_read_tree_by_uri(spark, tree):
    os.remove(f"{tree}/linked")
    contents = fs.read_tree(spark.createDataFrame([("r", f"file://{tree}")], "repo_id string, root string"))
    rows = {r["rel_path"]: bytes(r["content"]) for r in contents.collect()}
    assert sorted(rows) == KNOWN
    assert rows["Dockerfile"] == b"FROM x"


def test_reading_in_small_batches(spark, tree, monkeypatch):
    monkeypatch.setattr(fs, "_BATCH_BYTES", 3)
    monkeypatch.setattr(fs, "_BATCH_PATHS", 2)
    contents = fs.read_tree(spark.createDataFrame([("r", tree)], "repo_id string, root string"))
    assert sorted(r["rel_path"] for r in contents.collect()) == KNOWN


def test_an_unreadable_file_is_kept(spark, tree):
    paths = spark.createDataFrame([("r", f"{tree}/gone.md", "gone.md", 5)], "repo_id string, path string, rel_path string, bytes long")
    row = fs.index_files(fs.read_contents(paths)).first()
    assert row["sha256"] is None and row["text"] is None and "FileNotFoundError" in row["read_error"]


def test_replace_repositories(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))

    def rows(*pairs):
        return conform(spark.createDataFrame([(i, r) for i, r in pairs], "file_id string, repo_id string"), FILES)

    def repos(*names):
        return spark.createDataFrame([(n,) for n in names], "repo_id string")

    def now():
        return sorted((r["file_id"], r["repo_id"]) for r in tables.read("files", FILES).collect())

    assert now() == []
    first = rows(("a", "01"), ("b", "2"), ("c", "3"))
    tables.replace("files", first, repos("01", "2", "3"), FILES, "repo_id")
    assert now() == [("a", "01"), ("b", "2"), ("c", "3")]
    tables.replace("files", rows(("d", "2"), ("e", "4")), repos("2", "3", "4"), FILES, "repo_id")
    assert now() == [("a", "01"), ("d", "2"), ("e", "4")]
    tables.replace("files", rows(("d", "2"), ("e", "4")), repos("2", "3", "4"), FILES, "repo_id")
    assert now() == [("a", "01"), ("d", "2"), ("e", "4")]


def test_conform_fills_and_drops(spark):
    old = spark.createDataFrame([("f", 1, "x")], "file_id string, sha256 int, extra string")
    row = conform(old, FILES).first()
    assert row.asDict() == {"file_id": "f", "repo_id": None, "path": None, "rel_path": None, "lang": None, "sha256": "1"}
    assert conform(old, FILES).schema.fieldNames() == FILES.fieldNames()


def test_a_bad_root_costs_only_itself(spark, tree, tmp_path):
    roots = spark.createDataFrame([("r", tree), ("gone", f"{tmp_path}/none")], "repo_id string, root string")
    rows = fs.index_files(fs.read_tree(roots)).collect()
    assert sorted(r["rel_path"] for r in rows if r["repo_id"] == "r") == KNOWN
    (bad,) = [r for r in rows if r["repo_id"] == "gone"]
    assert "FileNotFoundError" in bad["read_error"] and bad["lang"] is None and bad["text"] is None


def test_a_tree_is_listed_in_rounds(spark, tmp_path):
    want = set()
    for i in range(3):
        at = tmp_path / "deep"
        for j in range(6):
            at = at / f"{i}{j}"
            at.mkdir(parents=True, exist_ok=True)
            (at / "x.md").write_text("x")
            want.add(f"{at}/x.md")
    listed = fs.list_tree(spark.createDataFrame([("r", f"{tmp_path}/deep")], "repo_id string, root string"), quota=2)
    assert sorted(r["path"] for r in listed.collect()) == sorted(want)


def test_a_file_that_no_value_can_hold_is_an_error(spark, tree, monkeypatch):
    roots = spark.createDataFrame([("r", tree)], "repo_id string, root string")
    whole = {r["rel_path"]: len(r["content"]) for r in fs.read_tree(roots).collect()}
    monkeypatch.setattr(fs, "MAX_FILE_BYTES", 5)
    rows = {r["rel_path"]: r for r in fs.read_tree(roots).collect()}
    large = {n for n, size in whole.items() if size > 5}
    assert sorted(rows) == KNOWN and {n for n, r in rows.items() if r["read_error"]} == large and 0 < len(large) < len(KNOWN)

"""A sheet read in blocks gives the rows of the plain reader, wherever the blocks begin."""

import csv
import random

import pytest

from corpusmatch.sources.catalog import load_patterns, read_large_sheet, read_sheet
from corpusmatch.sources.sheets import ends_inside, records


@pytest.fixture
def small_blocks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield use
    for key, value in before.items():
        spark.conf.set(key, value)


def _sheet(path, rows, end="\n"):
    rng = random.Random(3)
    words = ["plan", "a, b", 'say "x"', "two\nlines", "", "ü", "\n\n", '"', "x" * 60, "q,\n\"r\"\n,s"]
    with open(path, "w", encoding="utf-8", newline="") as file:
        out = csv.writer(file, lineterminator=end)
        out.writerow(["Pattern Name", "Description", "Comments"])
        for i in range(rows):
            out.writerow([f"name {i % (rows - 3)}", *(" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(2))])


@pytest.mark.parametrize("size", [7, 50, 1 << 20])
def test_equal_to_the_plain_reader(spark, tmp_path, small_blocks, size):
    path = str(tmp_path / "s.csv")
    _sheet(path, 25)
    want = [tuple(r) for r in read_sheet(spark, path).collect()]
    small_blocks(size)
    got = read_large_sheet(spark, path)
    if size < 100:
        assert records(spark, path).select("text").rdd.getNumPartitions() > 1
    assert [tuple(r)[:-1] for r in got.orderBy("_row_in_file").collect()] == want
    assert len(want) == 25 and got.columns == ["Pattern Name", "Description", "Comments", "_row_in_file"]


def test_odd_sheets(spark, tmp_path, small_blocks):
    small_blocks(11)
    path = tmp_path / "s.csv"
    for text, want in (
        ('﻿name,link\r\n"a\r\nb",x\r\n\r\nc,5" wide\r\nd,"open\r\nto the end', [("a\r\nb", "x"), ("c", '5" wide'), ("d", "open\r\nto the end")]),
        ("name,link\n", []),
        ('name,link\na\n"b""c",,\n', [("a", ""), ('b"c', "")]),
    ):
        path.write_bytes(text.encode())
        assert [tuple(r)[:-1] for r in read_large_sheet(spark, str(path)).orderBy("_row_in_file").collect()] == want
    # the last row of a name wins, whichever block it is in
    path.write_text("name,link\n" + "".join(f'n{i % 3},"l\n{i}"\n' for i in range(30)))
    found = {r["name"]: r["link"] for r in load_patterns(spark, str(path)).collect()}
    assert found == {"n0": "l\n27", "n1": "l\n28", "n2": "l\n29"}


def test_lines():
    assert not ends_inside('a,"b"', False) and ends_inside('a,"b', False) and not ends_inside('b",c', True)
    assert ends_inside('b""', True) and not ends_inside('b"x"y', True) and ends_inside('b"x,"y', True)
    assert not ends_inside('5" wide, 6"', False) and ends_inside("", True) and not ends_inside('x"\r', True)

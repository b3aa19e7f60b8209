"""A delimited text with quoted fields that may span lines, read by many tasks.

Where a block of a file starts in the middle of a record is not known to its task. So each block is first run
through twice, as if it started outside and inside a quoted field, and reports where either way ends and how many
records begin on it: a row for each block. Put together in file order these give every block its true start and the number of its
first record. Blocks are then cut into records; only the pieces of a record that crosses a border are brought together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

_BLOCKS = "path string, start long, inside boolean, ends_inside boolean, records long"
_PIECES = "pos long, part long, open boolean, text string"


def ends_inside(line: str, inside: bool, sep: str = ",") -> bool:
    """Whether a quoted field is open behind the line, which starts inside of one or at the start of a record.

    A quote opens a field at its start only; two stand for one; one before anything but a separator or the line's
    end leaves the rest of the field without quotes.
    """
    line, at = line.removesuffix("\r"), 0
    if not inside and '"' not in line:
        return False
    while True:
        if not inside:
            if not line.startswith('"', at):
                at = line.find(sep, at)
                if at < 0:
                    return False
                at += len(sep)
                continue
            at += 1
        at = line.find('"', at)
        if at < 0:
            return True
        inside = line.startswith('"', at + 1)
        if inside:
            at += 2
            continue
        at = line.find(sep, at + 1)
        if at < 0:
            return False
        at += len(sep)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[str]]]:
    """The lines of each block; they lie together and in order."""
    rows = (
        row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns))
    )
    row = next(rows, None)
    while row is not None:
        block = row[1:]

        def lines() -> Iterator[str]:
            nonlocal row
            while row is not None and row[1:] == block:
                yield row[0]
                row = next(rows, None)

        yield *block, lines()


def records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """``pos, first, text``: the records of the file, or of all files of a folder by name, as they are written.

    ``pos`` numbers them; ``first`` is true for the first one of each file. Empty lines between records are none.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")
    )

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for file, start, some in _runs(batches):
            state, begun = [False, True], [0, 0]
            for line in some:
                for way in (0, 1):
                    begun[way] += not state[way] and line not in ("", "\r")
                    state[way] = ends_inside(line, state[way], sep)
            found += [
                {"path": file, "start": start, "inside": bool(way), "ends_inside": state[way], "records": begun[way]}
                for way in (0, 1)
            ]
        if found:
            yield pa.RecordBatch.from_pylist(found)

    ways = {(r["path"], r["start"], r["inside"]): r for r in lines.mapInArrow(look, _BLOCKS).collect()}
    known: dict[tuple[str, int], tuple[bool, int, int]] = {}
    inside, before, file, firsts = False, 0, None, []
    for part, (name, start) in enumerate(sorted({key[:2] for key in ways})):
        if name != file:
            inside, file = False, name
            firsts.append(before)
        way = ways[name, start, inside]
        known[name, start] = inside, before, part
        inside, before = way["ends_inside"], before + way["records"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, start, some in _runs(batches):
            state, pos, part = known[file, start]
            # what comes before the block's first record belongs to the one before
            pos, held, found, weight, open_ = pos - 1, [], [], 0, True

            def done(last: bool) -> None:
                if held:
                    text = "\n".join(held)
                    found.append({"pos": pos, "part": part, "open": open_ or last, "text": text})

            for line in some:
                if not state:
                    if line in ("", "\r"):
                        continue
                    done(False)
                    held, pos, open_ = [], pos + 1, False
                held.append(line)
                weight += len(line)
                state = ends_inside(line, state, sep)
                if not state:
                    done(False)
                    held = []
                if weight > 1 << 20 and found:
                    yield pa.RecordBatch.from_pylist(found)
                    found.clear()
                    weight = 0
            done(True)
            if found:
                yield pa.RecordBatch.from_pylist(found)

    pieces = lines.mapInArrow(cut, _PIECES)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), "\n")
    crossing = pieces.filter("open").groupBy("pos").agg(joined.alias("text"))
    every = pieces.filter("NOT open").select("pos", "text").unionByName(crossing)
    return every.select("pos", F.col("pos").isin(firsts).alias("first"), "text")


def read_sheet_in_blocks(spark: SparkSession, path: str, headers: list[str], sep: str = ",") -> DataFrame:
    """The rows under the first one of each file as strings, blanks as '', with ``_row_in_file`` for their order. UTF-8 only.

    Lines end in a line feed, with or without a carriage return.
    """
    fields = [f"_c{i}" for i in range(len(headers))]
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true"}
    rows = records(spark, path, sep).filter("NOT first")
    parsed = rows.select(
        F.from_csv(F.regexp_replace("text", r"\r$", ""), ", ".join(f"{f} string" for f in fields), options).alias("r"), "pos"
    )
    return parsed.select(*[F.coalesce(f"r.{f}", F.lit("")).alias(f) for f in fields], "pos").toDF(*headers, "_row_in_file")

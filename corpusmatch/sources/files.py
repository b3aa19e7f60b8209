"""File trees: list the files of many roots and read them inside the tasks.

Spark's own file sources hide names that start with ``_`` or ``.``, so they would lose ``__init__.py``.
Roots are folders every executor can reach: plain paths on a shared mount, or URIs.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, LongType, StringType

from corpusmatch.functions import text as tx
from corpusmatch.operators.storage import written
from corpusmatch.schemas import conform, key_of, table

BYTES_PER_TASK = 128 << 20
_BATCH_BYTES = 32 << 20
# A task lists about so many entries in one round.
LISTED_PER_TASK = 20_000
# What one value of a binary column can hold.
MAX_FILE_BYTES = (1 << 31) - 4096
_BATCH_PATHS = 10_000


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path within it of a URI whose path is written plainly, not percent-encoded."""
    return pafs.FileSystem.from_uri(quote(uri, safe=":/"))


def _children(folder: str) -> Iterator[tuple[str, bool, int]]:
    """(path, is folder, bytes) of what lies directly in ``folder``; links to folders are not followed."""
    if "://" in folder:
        filesystem, inner = _open(folder)
        prefix = folder.removesuffix("/").removesuffix(inner)
        for info in filesystem.get_file_info(pafs.FileSelector(inner)):
            if info.type != pafs.FileType.NotFound:
                yield prefix + info.path, info.type == pafs.FileType.Directory, info.size or 0
        return
    with os.scandir(folder) as entries:
        for entry in entries:
            if entry.is_dir(follow_symlinks=False):
                yield entry.path, True, 0
            elif entry.is_file():
                yield entry.path, False, entry.stat().st_size


def _read(path: str) -> bytes:
    if "://" in path:
        filesystem, inner = _open(path)
        with filesystem.open_input_stream(inner) as stream:
            return stream.read()
    with open(path, "rb") as f:
        return f.read()


def write_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Write ``path, content`` rows as files (for ``mapInArrow``); gives the paths."""
    for batch in batches:
        for path, content in zip(batch["path"].to_pylist(), batch["content"]):
            system, inner = _open(path if "://" in path or path.startswith("file:") else f"file://{path}")
            system.create_dir(os.path.dirname(inner), recursive=True)
            with system.open_output_stream(inner) as out:
                out.write(content.as_buffer() if content.is_valid else b"")
        yield batch.select(["path"])


_LISTED = table(
    repo_id=StringType(), root=StringType(), path=StringType(), is_dir=BooleanType(), bytes=LongType(), error=StringType()
)
_LISTED_ARROW = to_arrow_schema(_LISTED)


def _list_batches(batches: Iterator[pa.RecordBatch], quota: int) -> Iterator[pa.RecordBatch]:
    """What lies below the folders of ``batches``; after about ``quota`` rows the folders left over come back as they are."""
    rows, listed = [], 0
    for batch in batches:
        for given in batch.to_pylist():
            folders = [given["path"]]
            while folders:
                folder = folders.pop()
                if listed >= quota:
                    rows.append({**given, "path": folder, "is_dir": True})
                    continue
                try:
                    for path, is_dir, size in _children(folder):
                        if not is_dir:
                            rows.append({**given, "path": path, "is_dir": False, "bytes": size})
                            listed += 1
                        elif os.path.basename(path) != ".git":
                            folders.append(path)
                        if len(rows) >= _BATCH_PATHS:
                            yield pa.RecordBatch.from_pylist(rows, _LISTED_ARROW)
                            rows = []
                except OSError as e:
                    rows.append({**given, "path": folder, "is_dir": False, "error": f"{type(e).__name__}: {e}"})
                listed += 1
    yield pa.RecordBatch.from_pylist(rows, _LISTED_ARROW)


def list_tree(roots: DataFrame, folder: str | None = None, quota: int = LISTED_PER_TASK) -> DataFrame:
    """``repo_id, root, path, bytes, error`` of every regular file below the roots (``repo_id, root``) but ``.git`` folders.

    A folder that is missing or may not be read gives a row with the error and costs nothing but itself. A task lists
    about ``quota`` entries and hands back the folders that it did not come to; those are dealt out over all tasks
    in the next round, so a huge root or a deep one does not occupy one task alone.
    """
    todo = conform(roots.withColumns({"path": F.col("root"), "is_dir": F.lit(True)}), _LISTED)
    tasks, found, turn = roots.sparkSession.sparkContext.defaultParallelism, None, 0
    while True:
        dealt = todo.repartition(tasks, "path").mapInArrow(lambda it: _list_batches(it, quota), _LISTED)
        listed = written(dealt, f"listed{turn}", folder)
        files = listed.filter(~F.col("is_dir"))
        found, turn = files if found is None else found.unionByName(files), turn + 1
        todo = listed.filter("is_dir")
        if todo.isEmpty():
            break
    return found.filter(tx.outside_git_dir(tx.relative_path(F.col("path"), F.col("root")))).drop("is_dir")


def read_contents(paths: DataFrame, bytes_per_task: int = BYTES_PER_TASK) -> DataFrame:
    """Add ``content`` and ``read_error`` to ``paths`` (``path``, ``bytes``); reading is spread by total size.

    An unreadable file, or one of 2 GiB or more (which no value can hold), gets NULL content and the error. The number of tasks is set from the bytes to be
    read: the rows shuffled here are short, and their size says nothing about the work behind them.
    """
    spark = paths.sparkSession
    total = paths.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // bytes_per_task))
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, contents, errors, held = 0, [], [], 0
            sizes = batch["bytes"].to_pylist()
            for number, path in enumerate(batch["path"].to_pylist()):
                try:
                    if (sizes[number] or 0) > MAX_FILE_BYTES:
                        raise OSError(f"{sizes[number]} bytes are too many for one value")
                    content = _read(path)
                    if len(content) > MAX_FILE_BYTES:
                        raise OSError(f"{len(content)} bytes are too many for one value")
                    contents.append(content)
                    errors.append(None)
                except (OSError, MemoryError) as e:
                    contents.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
                held += len(contents[-1] or b"")
                ahead = sizes[number + 1] or 0 if number + 1 < batch.num_rows else 0
                if held + ahead >= _BATCH_BYTES or number == batch.num_rows - 1:
                    part = batch.slice(done, len(contents))
                    arrays = [*part.columns, pa.array(contents, pa.binary()), pa.array(errors, pa.string())]
                    yield pa.RecordBatch.from_arrays(arrays, [*part.schema.names, "content", "read_error"])
                    done, contents, errors, held = number + 1, [], [], 0

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in paths.schema.fields)
    return paths.repartition(int(tasks), "path").mapInArrow(read, schema + ", content binary, read_error string")


def read_tree(roots: DataFrame, folder: str | None = None) -> DataFrame:
    """``repo_id, path, rel_path, lang, content, read_error`` of all files of a known language below the roots.

    A folder that could not be listed is a row without language and content.
    """
    rel_path = tx.relative_path(F.col("path"), F.col("root"))
    listed = list_tree(roots, folder).select("repo_id", "path", rel_path.alias("rel_path"), "bytes", "error")
    known = known_files(listed.filter("error IS NULL").drop("error"))
    nothing = F.lit(None)
    failed = listed.filter("error IS NOT NULL").select(
        "repo_id",
        "path",
        "rel_path",
        nothing.cast("string").alias("lang"),
        nothing.cast("binary").alias("content"),
        F.col("error").alias("read_error"),
    )
    return read_contents(written(known, "paths", folder)).drop("bytes").unionByName(failed)


def known_files(files: DataFrame) -> DataFrame:
    """Add ``lang`` by ``rel_path`` and drop files of an unknown language."""
    return files.withColumn("lang", tx.detect_lang(F.col("rel_path"))).filter(F.col("lang") != tx.UNKNOWN_LANG)


def index_files(contents: DataFrame) -> DataFrame:
    """Add ``file_id``, the checksum of the bytes and the decoded ``text``; every file keeps its row."""
    return (
        contents.withColumn("file_id", key_of(F.col("repo_id"), F.col("rel_path")))
        .withColumn("sha256", F.sha2("content", 256))
        .withColumn("text", tx.decode_utf8(F.col("content")))
        .drop("content")
    )

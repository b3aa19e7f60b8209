"""Token ids as binary files of independent zstandard frames with a trailing seek table.

A file holds whole documents in ascending order of id. Each document is one frame, a very long one several;
a frame is the raw little-endian ids, 16 or 32 bits wide. Then come two skippable frames, so any zstandard
reader gives all ids of the file:

* the index: a head (version, id width, documents, tokens), then per document its id, whether that is null,
  its number of tokens and its number of frames;
* the seek table of the public seekable format: compressed size, raw size and the low 32 bits of the raw
  XXH64 of each frame, and the footer that says how many frames there are.

A reader seeks to the end, reads these two, and decompresses no frames but those of the documents it is asked
for; a frame that does not match its checksum is an error.

Nulls: a null text is empty (its ids are the end id alone), a null id comes first. Repeated ids keep all their
rows, ordered by text. An empty table gives no file and an empty result.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusmatch.llm.tokens import default_path, encoder
from corpusmatch.operators.storage import new_folder

# Fixed values of the public formats.
SKIPPABLE = 0x184D2A5E
INDEX = 0x184D2A50
SEEKABLE = 0x8F92EAB1
_HEAD = "<4sBBQQ"
FRAME_IDS = 1 << 18

MANIFEST = "part int, path string, docs long, tokens long"


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Writer:
    def __init__(self, out, width: int, level: int):
        self.out, self.width, self.packer = out, width, zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, bool, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        step = FRAME_IDS * self.width
        parts = [ids[at : at + step] for at in range(0, len(ids), step)]
        for part in parts:
            packed = self.packer.compress(part)
            self.out.write(packed)
            self.frames.append((len(packed), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF))
        self.docs.append((doc_id or 0, doc_id is None, len(ids) // self.width, len(parts)))

    @property
    def tokens(self) -> int:
        return sum(d[2] for d in self.docs)

    def end(self) -> None:
        ids, null, tokens, frames = zip(*self.docs)
        index = struct.pack(_HEAD, b"tokf", 1, self.width, len(self.docs), self.tokens) + b"".join(
            np.array(x, kind).tobytes() for x, kind in ((ids, "<i8"), (null, "u1"), (tokens, "<u8"), (frames, "<u4"))
        )
        table = np.array(self.frames, "<u4").tobytes() + struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE)
        for magic, content in ((INDEX, index), (SKIPPABLE, table)):
            self.out.write(struct.pack("<II", magic, len(content)) + content)


class Reader:
    """``doc_ids`` (None where null) and ``tokens`` of a file; ``ids(n)`` of its nth document."""

    def __init__(self, uri: str):
        system, path = _place(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE or not flags & 0x80:
            raise ValueError(f"{uri} has no seek table with checksums")
        length = 12 * n + 9
        table = np.frombuffer(self.file.read_at(12 * n, size - length), "<u4").reshape(n, 3).astype(np.int64)
        self.packed, self.raw, self.sums = table.T
        self.at = np.concatenate(([0], np.cumsum(self.packed)))
        index = self.file.read_at(size - length - 16 - int(self.at[-1]), int(self.at[-1]) + 8)
        kind, _, self.width, docs, _ = struct.unpack_from(_HEAD, index)
        if kind != b"tokf":
            raise ValueError(f"{uri} has no index of documents")
        pos, parts = struct.calcsize(_HEAD), []
        for of in ("<i8", "u1", "<u8", "<u4"):
            parts.append(np.frombuffer(index, of, docs, pos))
            pos += parts[-1].nbytes
        self.doc_ids = [None if null else int(i) for i, null in zip(parts[0], parts[1])]
        self.tokens = parts[2].astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(parts[3].astype(np.int64))))
        self.unpacker = zstandard.ZstdDecompressor()

    def ids(self, n: int) -> np.ndarray:
        found = []
        for f in range(self.first[n], self.first[n + 1]):
            packed = self.file.read_at(int(self.packed[f]), int(self.at[f]))
            raw = self.unpacker.decompress(packed, max_output_size=int(self.raw[f]))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[f]:
                raise ValueError(f"frame {f} does not match its checksum")
            found.append(raw)
        return np.frombuffer(b"".join(found), f"<u{self.width}")


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer: str | None = None,
    end_id: int = 2,
    level: int = 1,
    key: str = "doc_id",
    text: str = "text",
) -> list[tuple[int, str, int, int, int]]:
    """Write the files; of each (a row per task): part, path, documents, tokens, tokens before it.

    A task writes under a name of its own and renames at the end, so a repeated task does no harm.
    """
    file = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _place(folder)
        coder, part = encoder(file), TaskContext.get().partitionId()
        end = np.array([end_id], coder.dtype).tobytes()
        name, own, out, writer = f"{root}/part-{part:06d}.tokf", f"{root}/.{uuid.uuid4().hex}", None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                if writer is None:
                    system.create_dir(root, recursive=True)
                    out = system.open_output_stream(own)
                    writer = Writer(out, coder.dtype.itemsize, level)
                found = coder.encode([x or "" for x in some.column(1).to_pylist()])
                for doc_id, ids in zip(some.column(0).to_pylist(), found):
                    writer.add(doc_id, ids + end)
        if writer is None:
            return
        writer.end()
        out.close()
        system.move(own, name)
        row = [[part], [f"{folder}/part-{part:06d}.tokf"], [len(writer.docs)], [writer.tokens]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64()))],
            ["part", "path", "docs", "tokens"],
        )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    parts, before = [], 0
    for r in sorted(dealt.mapInArrow(run, MANIFEST).collect()):
        parts.append((r["part"], r["path"], r["docs"], r["tokens"], before))
        before += r["tokens"]
    return parts


def read_tokens(spark: SparkSession, parts: list[tuple]) -> DataFrame:
    """``doc_id, start, ids`` (little-endian unsigned 32-bit) of every document of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = Reader(path)
                starts = before + np.concatenate(([0], np.cumsum(file.tokens)[:-1]))
                for some in _weighed(file.tokens):
                    ids = [file.ids(n).astype("<u4").tobytes() for n in some]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([file.doc_ids[n] for n in some], pa.int64()),
                            pa.array(starts[some]),
                            pa.array(ids, pa.binary()),
                        ],
                        ["doc_id", "start", "ids"],
                    )

    schema = "doc_id long, start long, ids binary"
    if not parts:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame([(p[1], p[4]) for p in parts], "path string, before long")
    return files.repartition(len(parts), "path").mapInArrow(run, schema)


def _weighed(tokens: np.ndarray, most: int = 2_000_000) -> Iterable[list[int]]:
    """Runs of documents of about ``most`` tokens."""
    some, weight = [], 0
    for n, t in enumerate(tokens.tolist()):
        some.append(n)
        weight += t
        if weight >= most:
            yield some
            some, weight = [], 0
    if some:
        yield some


def token_table(docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the token files to ``folder`` (or a new one in the shared folder) and read them back."""
    spark = docs.sparkSession
    return read_tokens(spark, write_tokens(docs, f"{folder or new_folder(spark)}/tokens", **options))

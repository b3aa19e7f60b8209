"""Documents packed into windows of a fixed number of tokens, by repeat counts of length combinations.

A document's ids and its end id are cut into full windows; what is left over is a remainder. A task takes a
block of documents, counts its remainders by length, and lists the shallow combinations of lengths that fill
a window exactly: two or three remainders, or one whose length is a power of two and needs no padding. How
often to use each is a non-negative least-squares fit of the combinations to the histogram; counts are
rounded and used as far as remainders last. What is left is packed greedily, the longest that fits first, and
cut where nothing fits. The last window of a block is dealt out over powers of two, so nothing is padded.

Blocks have a bounded number of tokens and don't depend on each other: there is no shuffle, no global state
and no hot group, and a repeated task gives the same pieces again.

Nulls: a null text is empty and has its end id alone; a null id is kept. Repeated rows are packed as often as
they are there. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from corpusmatch.llm.tokens import CACHED, default_path, encoder

PIECES = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"


def combinations(counts: np.ndarray, window: int, partners: int = 48) -> np.ndarray:
    """Rows of three lengths (0 where there are fewer) that fill the window, or a power of two alone.

    ``counts[n]`` is the number of remainders of length n. The middle length of three is one of the
    ``partners`` most frequent ones.
    """
    lengths = np.flatnonzero(counts[:window])
    lengths = lengths[lengths > 0]
    there = np.zeros(2 * window + 1, bool)
    there[lengths] = True
    rows = []
    alone = lengths[(lengths & (lengths - 1)) == 0]
    rows.append(np.stack([alone, 0 * alone, 0 * alone], 1))
    two = lengths[(2 * lengths >= window) & there[window - lengths]]
    two = two[(2 * two > window) | (counts[two] > 1)]
    rows.append(np.stack([two, window - two, 0 * two], 1))
    for middle in lengths[np.argsort(-counts[lengths], kind="stable")[:partners]]:
        third = window - middle - lengths
        fits = (third > 0) & (third <= lengths)
        fits[fits] = there[third[fits]]
        a, c = lengths[fits], third[fits]
        rows.append(np.sort(np.stack([a, 0 * a + middle, c], 1), 1)[:, ::-1])
    return np.unique(np.concatenate(rows), axis=0)


def repeat_counts(combos: np.ndarray, counts: np.ndarray, steps: int = 60) -> np.ndarray:
    """Non-negative least squares: how often each combination is used, by multiplicative steps."""
    wanted = counts.astype(float)
    wanted[0] = 0
    used = np.ones(len(combos))
    aim = wanted[combos].sum(axis=1)
    for _ in range(steps):
        given = sum(np.bincount(combos[:, i], used, len(wanted)) for i in range(combos.shape[1]))
        given[0] = 0
        used *= aim / np.maximum(given[combos].sum(axis=1), 1e-12)
    return used


def plan(counts: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of remainders and how often each is used; never more than there are."""
    combos = combinations(counts, window)
    if not len(combos):
        return []
    used = repeat_counts(combos, counts)
    left, chosen = counts.tolist(), []
    for i in np.argsort(-used, kind="stable").tolist():
        if used[i] < 0.05:
            break
        parts = [n for n in combos[i].tolist() if n]
        needs = {n: parts.count(n) for n in parts}
        times = min(max(1, round(used[i])), *(left[n] // k for n, k in needs.items()))
        if times > 0:
            chosen.append((tuple(parts), times))
            for n, k in needs.items():
                left[n] -= times * k
    return chosen


def fill(left: dict[int, list], window: int) -> Iterator[list[tuple]]:
    """Windows of ``(piece, from, to)`` of what ``left`` holds by length: longest fit first, cut if none fits."""
    lengths = sorted(n for n, x in left.items() if x)

    def take(i: int):
        n = lengths[i]
        piece = left[n].pop()
        if not left[n]:
            lengths.pop(i)
        return piece

    while lengths:
        row, gap = [], window
        while gap and lengths:
            i = bisect.bisect_right(lengths, gap) - 1
            if i >= 0:
                piece, start, end = take(i)
                row.append((piece, start, end))
                gap -= end - start
            else:
                piece, start, end = take(0)
                row.append((piece, start, start + gap))
                rest = end - start - gap
                if not left.get(rest):
                    left[rest] = []
                    bisect.insort(lengths, rest)
                left[rest].append((piece, start + gap, end))
                gap = 0
        yield row


def powers(row: list[tuple]) -> Iterator[list[tuple]]:
    """The pieces of a window that is not full, over sequences whose lengths are powers of two."""
    total = sum(end - start for _, start, end in row)
    row = row[::-1]
    while total:
        part, gap = [], 1 << (total.bit_length() - 1)
        total -= gap
        while gap:
            piece, start, end = row.pop()
            cut = min(end, start + gap)
            part.append((piece, start, cut))
            gap -= cut - start
            if cut < end:
                row.append((piece, cut, end))
        yield part


def sequences(lengths: list[int], window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of ``(document, from, to)`` for documents of these numbers of tokens."""
    counts, left = np.zeros(window, np.int64), defaultdict(list)
    for doc, n in enumerate(lengths):
        full = n - n % window
        for start in range(0, full, window):
            yield [(doc, start, start + window)]
        if n % window:
            counts[n % window] += 1
            left[n % window].append((doc, full, n))
    for parts, times in plan(counts, window):
        for _ in range(times):
            yield [left[n].pop() for n in parts]
    for row in fill(left, window):
        if sum(end - start for _, start, end in row) == window:
            yield row
        else:
            yield from powers(row)


def pack(
    docs: DataFrame,
    window: int = 2048,
    tokenizer: str | None = None,
    end_id: int = 1,
    block_tokens: int = 8_000_000,
    cached_pieces: int = CACHED,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The pieces of all documents: ids (little-endian unsigned 32-bit), their place in document and sequence."""
    file = tokenizer or default_path()

    def packed(first: int, doc_ids: list, ids: list[bytes], width: int) -> Iterator[pa.RecordBatch]:
        lengths, rows, n = [len(x) // width for x in ids], [], first
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        for n, row in enumerate(sequences(lengths, window), first):
            offset = 0
            for doc, start, end in row:
                raw = np.frombuffer(ids[doc], f"<u{width}", end - start, start * width).astype("<u4").tobytes()
                rows.append((doc_ids[doc], start, raw, lengths[doc], n, offset))
                offset += end - start
            if len(rows) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _NAMES)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _NAMES)
        return n + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(file, cached_pieces)
        end, width = np.array([end_id], coder.dtype).tobytes(), coder.dtype.itemsize
        n, doc_ids, ids, weight = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                found = coder.encode([x or "" for x in some.column(1).to_pylist()])
                doc_ids += some.column(0).to_pylist()
                ids += [x + end for x in found]
                weight += sum(map(len, found)) // width + len(found)
                if weight >= block_tokens:
                    n = yield from packed(n, doc_ids, ids, width)
                    doc_ids, ids, weight = [], [], 0
        if ids:
            yield from packed(n, doc_ids, ids, width)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, PIECES)


_NAMES = ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"]


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with length and crc32 of their ids instead of the ids."""
    return pieces.select(
        "doc_id",
        "start",
        F.floor(F.length("ids") / 4).alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )

"""Repeated passages found by suffix sorting: bytes covered by a long string of an earlier document.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id. All
windows of that length whose string may occur twice are sorted; equal neighbours share the smallest id.

* **Blocks.** Documents are written as blocks of a few megabytes; a very long one is a block of its own. A task takes
  some fifty bytes for each byte of a block, so ``block_bytes`` may grow with the executors.
* **Anchors.** The window is anchored at its minimizer, the pair of a hash and a place that is least among the strings of ``seed`` bytes
  in it. Equal windows have equal anchors, so only windows with an anchor that occurs in two documents can
  match. Each block sends the 32-bit hashes of its distinct anchors to a bucket by further bits of the hash;
  the bucket tells each block which of them are shared.
* **Segments.** Windows in a row that have the same shared anchor are one segment. Each block sends its distinct
  segments, with the least and the greatest id that holds them, to the bucket of the anchor.
* **Deep-shallow sort.** A bucket sorts all windows of its segments: multikey quicksort by eight bytes at a
  time down to a shallow depth, which splits groups of equal keys again and again; a group that is still
  together there is ordered by a blind trie over the rest of the strings, each of which is entered once.
* **Hot anchors.** A string of a line that very many documents have in different surroundings anchors more segments than
  one bucket should hold. Its windows then go singly, each to the bucket of its own hash.
* **Verdict.** Equal windows get their smallest id; a block learns it for those of its segments where it is
  smaller than the greatest id that it holds, and removes, counts and hashes.

Everything that moves is distinct within its block, so a passage or document that a third of all rows share
weighs one segment per block. No step compares two documents.

Nulls and empty texts have no bytes. Rows that repeat an id are not earlier than each other; a row with a null
id comes before all others. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusmatch.operators.storage import written

_LEAST = -(1 << 63)
_MIX = np.uint64(0x9E3779B97F4A7C15)


# --- hashes and anchors ---------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    """In place."""
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _window_hashes(raw: np.ndarray, length: int) -> np.ndarray:
    """64-bit hash of every string of ``length`` bytes, by doubling."""
    n = len(raw) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    have, size = _mixed((raw.astype(np.uint64) + np.uint64(1)) * _MIX), 1
    while size * 2 <= length:
        both = have[:-size] * _MIX
        both += have[size:]
        have = _mixed(both)
        size *= 2
    if size < length:
        both = have[:n] * _MIX
        both += have[length - size : length - size + n]
        both += np.uint64(1)
        have = _mixed(both)
    return have[:n]


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    n, size = len(x) - width + 1, 1
    if n <= 0:
        return x[:0]
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[width - size : width - size + n]) if size < width else x[:n]


class Block:
    """The windows of a block's documents with their anchors.

    ``text`` holds the documents one after another, ``starts`` and ``ids`` tell them apart. Runs of windows with one
    anchor in one document: ``first`` (offset of the first window), ``count`` (windows), ``anchor`` (hash), ``doc``.
    """

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, text: bytes, length: int, seed: int):
        self.ids, self.sizes, self.text = ids, sizes, np.frombuffer(text, np.uint8)
        self.starts = np.cumsum(sizes) - sizes
        self.length = length
        hashes = _window_hashes(self.text, seed)
        least = _sliding_least(hashes, length - seed + 1)
        # windows that stay in one document
        windows = np.maximum(sizes - length + 1, 0)
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), windows)
        skipped = self.starts - np.cumsum(windows) + windows
        window = np.arange(len(doc)) + np.repeat(skipped, windows)
        anchor = least[window] if len(window) else np.zeros(0, np.uint64)
        del hashes, least
        new = np.ones(len(window), bool)
        if len(window) > 1:
            new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        # a run is at most as long as the anchor can stay the least: cut longer ones (repeated strings)
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(window)))
        most = length - seed + 1
        pieces = -(-count // most)
        if len(count) and pieces.max() > 1:
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            at = np.repeat(at, pieces) + nth * most
            count = np.minimum(np.repeat(count, pieces) - nth * most, most)
        self.first, self.count, self.anchor, self.doc = window[at], count, anchor[at], doc[at]


def _distinct_pairs(anchor: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchors, whether each is in more than one document of the block, and its number of runs."""
    order = np.lexsort((doc, anchor))
    a, d = anchor[order], doc[order]
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    other = np.zeros(len(a), bool)
    other[1:] = (a[1:] == a[:-1]) & (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(a)))
    return a[at], np.logical_or.reduceat(other, at) if len(at) else other[:0], runs


# --- deep-shallow sort ----------------------------------------------------------------------------


class Windows:
    """Strings of ``length`` bytes at places of a text, word by word of eight bytes; words compare as bytes do.

    The last word may overlap the one before: where all others are equal, it still decides as the rest would.
    """

    def __init__(self, text: np.ndarray, place: np.ndarray, length: int):
        self.place, self.shift = place, np.uint64(8 * max(0, 8 - length))
        self.at = list(range(0, length - 7, 8)) or [0]
        if length > 8 and length % 8:
            self.at.append(length - 8)
        self.words = np.zeros(len(text), np.uint64)
        padded = np.concatenate((text, np.zeros(8, np.uint8)))
        for i in range(8):
            self.words <<= np.uint64(8)
            self.words |= padded[i : i + len(text)]

    def word(self, depth: int, rows: np.ndarray) -> np.ndarray:
        return self.words[self.place[rows] + self.at[depth]] >> self.shift

    def string(self, row: int) -> np.ndarray:
        return self.words[self.place[row] + np.array(self.at)] >> self.shift


class _Blind:
    """A blind trie: inner nodes know only where their strings part and by which words."""

    def __init__(self, strings: Windows):
        self.strings, self.root, self.rows = strings, None, {}

    def add(self, leaf: int, row: int) -> None:
        """``leaf`` stands for the string of ``row``; those of equal strings share a place."""
        self.rows[leaf] = row
        if self.root is None:
            self.root = [leaf]
            return
        node, own = self.root, self.strings.string(row)
        path = []
        while isinstance(node, tuple):
            path.append(node)
            depth, ways = node
            node = ways.get(own[depth]) or next(iter(ways.values()))
        other = self.strings.string(self.rows[node[0]])
        parts = np.flatnonzero(own != other)
        if not len(parts):
            node.append(leaf)
            return
        depth = int(parts[0])
        above, here = None, self.root
        while isinstance(here, tuple) and here[0] < depth:
            above, here = here, here[1][own[here[0]]]
        if isinstance(here, tuple) and here[0] == depth:
            here[1][own[depth]] = [leaf]
            return
        parted = (depth, {other[depth]: here, own[depth]: [leaf]})
        if above is None:
            self.root = parted
        else:
            above[1][own[above[0]]] = parted

    def groups(self, node=None) -> Iterator[list[int]]:
        node = self.root if node is None else node
        if isinstance(node, tuple):
            for word in sorted(node[1]):
                yield from self.groups(node[1][word])
        else:
            yield node


def deep_shallow_sort(strings: Windows, shallow: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings, and the number of the group of equal strings of each sorted row."""
    n = len(strings.place)
    order, new = np.zeros(0, np.int64), np.ones(n, bool)
    if n:
        word = strings.word(0, np.arange(n))
        order = np.argsort(word)
        word = word[order]
        new[1:] = word[1:] != word[:-1]

    def parting(depth: int) -> np.ndarray:
        """Which groups have rows that differ from their first in this word."""
        tied = np.flatnonzero(~new)
        head = np.flatnonzero(new)[group[tied]]
        differs = strings.word(depth, order[tied]) != strings.word(depth, order[head])
        parts = np.zeros(int(group[-1]) + 1 if n else 0, bool)
        parts[group[tied[differs]]] = True
        return parts

    # shallow: groups that part at the next word are sorted by it, and split
    depths = len(strings.at)
    for depth in range(1, min(shallow, depths)):
        group = np.cumsum(new) - 1
        rows = np.flatnonzero(parting(depth)[group]) if n else order
        if not len(rows):
            continue
        word, inside = strings.word(depth, order[rows]), group[rows]
        again = np.lexsort((word, inside))
        order[rows], word = order[rows][again], word[again]
        parts = np.ones(len(rows), bool)
        parts[1:] = (word[1:] != word[:-1]) | (inside[1:] != inside[:-1])
        new[rows] = parts
    # deep: what is still together is most often equal; a trie orders the distinct strings of the groups that are not
    if depths > shallow and n:
        group = np.cumsum(new) - 1
        mixed = np.logical_or.reduce([parting(depth) for depth in range(shallow, depths)])
        rows = np.flatnonzero(mixed[group])
        if len(rows):
            inside, tail = group[rows], [strings.word(depth, order[rows]) for depth in range(shallow, depths)]
            code = np.zeros(len(rows), np.uint64)
            for word in tail:
                code = _mixed(code * _MIX + word)
            again = np.lexsort((code, inside))
            order[rows] = order[rows][again]
            head = np.ones(len(rows), bool)
            head[1:] = (inside[1:] != inside[:-1]) | np.logical_or.reduce([w[again][1:] != w[again][:-1] for w in tail])
            heads = np.flatnonzero(head)
            sizes, sorted_rows = np.diff(np.append(heads, len(rows))), order[rows].copy()
            cuts = np.flatnonzero(np.append(True, np.diff(inside[heads]) != 0)).tolist() + [len(heads)]
            placed, starts = [], []
            for a, b in zip(cuts, cuts[1:]):
                trie = _Blind(strings)
                for k in range(a, b):
                    trie.add(k, int(sorted_rows[heads[k]]))
                for equal in trie.groups():
                    placed += equal
                    starts += [True] + [False] * (len(equal) - 1)
            placed = np.array(placed)
            moved = np.repeat(heads[placed] - np.cumsum(sizes[placed]) + sizes[placed], sizes[placed]) + np.arange(len(rows))
            order[rows] = sorted_rows[moved]
            first = np.zeros(len(rows), bool)
            first[(np.cumsum(sizes[placed]) - sizes[placed])[np.array(starts)]] = True
            new[rows] = first
    return order, np.cumsum(new) - 1


# --- the steps ------------------------------------------------------------------------------------

_BLOCKS = "block long, weight long, ids binary, sizes binary, text binary, rest binary"


def blocks(docs: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """Documents in their order, packed; ``rest`` holds their other columns as an Arrow stream."""
    names = [x.split()[0] for x in _BLOCKS.split(", ")]
    kinds = [pa.int64()] * 2 + [pa.binary()] * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        packer = zstandard.ZstdCompressor(level=1)

        def out(some: pa.RecordBatch):
            nonlocal number
            number += 1
            ids = [_LEAST if x is None else x for x in some.column(0).to_pylist()]
            parts = [x or b"" for x in some.column(1).to_pylist()]
            rest, stream = some.select(list(range(2, some.num_columns))), pa.BufferOutputStream()
            if rest.num_columns:
                with pa.ipc.new_stream(stream, rest.schema) as writer:
                    writer.write_batch(rest)
            columns = [
                number - 1,
                sum(map(len, parts)),
                np.array(ids, np.int64).tobytes(),
                np.array([len(p) for p in parts], np.int64).tobytes(),
                packer.compress(b"".join(parts)),
                packer.compress(stream.getvalue().to_pybytes()),
            ]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            first, weight = 0, 0
            for i, some in enumerate(batch.column(1)):
                n = some.as_buffer().size if some.is_valid else 0
                if i > first and weight + n > size:
                    yield out(batch.slice(first, i - first))
                    first, weight = i, 0
                weight += n
            if batch.num_rows > first:
                yield out(batch.slice(first))

    rest = [F.col(c) for c in docs.columns if c not in (key, text)]
    rows = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).cast("binary").alias("_text"), *rest)
    return rows.mapInArrow(run, _BLOCKS)


def _opened(ids: bytes, sizes: bytes, text: bytes, length: int, seed: int) -> Block:
    raw = zstandard.ZstdDecompressor().decompress(text) if len(text) else b""
    return Block(np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64), raw, length, seed)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """One at a time: a row is a whole block."""
    for i in range(batch.num_rows):
        yield from batch.slice(i, 1).to_pylist()


def _bucket(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return ((anchor >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _low(anchor: np.ndarray) -> np.ndarray:
    return (anchor & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    at = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1])) if len(order) else []
    for a, b in zip(at, np.append(at[1:], len(order)) if len(order) else []):
        yield int(bucket[order[a]]), order[a:b]


def _anchors(table: DataFrame, length: int, seed: int, buckets: int) -> DataFrame:
    """``bucket, block, anchors, several, runs``: distinct anchors of a block, which are in two documents, runs of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                block = _opened(row["ids"], row["sizes"], row["text"], length, seed)
                anchor, several, runs = _distinct_pairs(block.anchor, block.ids[block.doc])
                runs, pack = runs.astype(np.uint32), zstandard.ZstdCompressor(level=1).compress
                found = [
                    (b, row["block"], _low(anchor[i]).tobytes(), np.packbits(several[i]).tobytes(), pack(runs[i].tobytes()))
                    for b, i in _by_bucket(_bucket(anchor, buckets))
                ]
                if found:
                    kinds = [pa.int64()] * 2 + [pa.binary()] * 3
                    names = ["bucket", "block", "anchors", "several", "runs"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)

    columns = table.select("block", "ids", "sizes", "text")
    return columns.mapInArrow(run, "bucket long, block long, anchors binary, several binary, runs binary")


def _shared(sent: DataFrame, hot_runs: int) -> DataFrame:
    """``block, bucket, anchors, hot``: the anchors of a block that two documents have, anywhere, and which are hot."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        anchors = [np.frombuffer(a, np.uint32) for a in rows["anchors"]]
        # one that two documents of one block have counts twice
        several = [
            np.unpackbits(np.frombuffer(s, np.uint8), count=len(a)).astype(bool)
            for a, s in zip(anchors, rows["several"])
        ]
        weight = np.concatenate([1 + s.astype(np.int64) for s in several])
        value, back = np.unique(np.concatenate(anchors), return_inverse=True)
        twice = (np.bincount(back, weight) > 1)[back]
        unpack = zstandard.ZstdDecompressor().decompress
        runs = np.concatenate([np.frombuffer(unpack(r), np.uint32) for r in rows["runs"]])
        hot = (np.bincount(back, runs) > hot_runs)[back]
        ends = np.cumsum([len(a) for a in anchors])
        kept, heat = [], []
        for a, e in zip(anchors, ends):
            some = twice[e - len(a) : e]
            order = np.argsort(a[some])
            kept.append(a[some][order].tobytes())
            heat.append(np.packbits(hot[e - len(a) : e][some][order]).tobytes())
        return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "anchors": kept, "hot": heat})

    schema = "block long, bucket long, anchors binary, hot binary"
    return sent.groupBy("bucket").applyInPandas(run, schema).filter(F.length("anchors") > 0)


def _segment_hash(whole: np.ndarray, length: int, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hash of a segment's bytes, from the hashes of its first, middle and last window and its size."""
    last = first + size - length
    middle = first + (size - length) // 2
    return _mixed(_mixed(whole[first] * _MIX + whole[last]) * _MIX + whole[middle] + size.astype(np.uint64))


class _Segments:
    """The distinct contents of the runs of a block whose anchor is shared; the windows of a hot one are runs of their own.

    Of each: ``first`` and ``count`` of one place, its ``bucket``, ``least`` and ``greatest`` id, ``single`` if of a hot one.
    """

    def __init__(self, block: Block, shared: dict[int, tuple[bytes, bytes]], buckets: int):
        bucket, low = _bucket(block.anchor, buckets), _low(block.anchor)
        keep, hot = np.zeros(len(low), bool), np.zeros(len(low), bool)
        for b, i in _by_bucket(bucket):
            if b in shared:
                known = np.frombuffer(shared[b][0], np.uint32)
                heat = np.unpackbits(np.frombuffer(shared[b][1], np.uint8), count=len(known)).astype(bool)
                at = np.minimum(np.searchsorted(known, low[i]), len(known) - 1)
                keep[i] = known[at] == low[i]
                hot[i] = keep[i] & heat[at]
        run = np.flatnonzero(keep & ~hot)
        first, count, ids, bucket = block.first[run], block.count[run], block.ids[block.doc[run]], bucket[run]
        single = np.zeros(len(run), bool)
        whole = _window_hashes(block.text, block.length)
        if hot.any():
            run = np.flatnonzero(hot)
            times = block.count[run]
            window = np.repeat(block.first[run] - np.cumsum(times) + times, times) + np.arange(times.sum())
            first, count = np.append(first, window), np.append(count, np.ones(len(window), count.dtype))
            ids = np.append(ids, np.repeat(block.ids[block.doc[run]], times))
            bucket = np.append(bucket, _bucket(whole[window], buckets))
            single = np.append(single, np.ones(len(window), bool))
        hashes = _segment_hash(whole, block.length, first, count + block.length - 1)
        _, at, of = np.unique(hashes, return_index=True, return_inverse=True)
        self.first, self.count, self.bucket, self.single = first[at], count[at], bucket[at], single[at]
        self.least = np.full(len(at), np.iinfo(np.int64).max)
        self.greatest = np.full(len(at), np.iinfo(np.int64).min)
        np.minimum.at(self.least, of, ids)
        np.maximum.at(self.greatest, of, ids)


def _per_block(table: DataFrame, sent: DataFrame) -> DataFrame:
    """A block with what was sent to it: arrays of ``bucket`` and its content; blocks that got nothing stay."""
    columns = [c for c in sent.columns if c != "block"]
    packed = sent.groupBy("block").agg(F.collect_list(F.struct(*columns)).alias("sent"))
    return table.join(packed, "block", "left")


def _segments(table: DataFrame, length: int, seed: int, buckets: int) -> DataFrame:
    """The distinct segments of a block by bucket: windows, least and greatest id, and bytes of each, compressed."""
    names = ["bucket", "block", "counts", "base", "least", "span", "text", "single"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64()] + [pa.binary()] * 3 + [pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                if not row["sent"]:
                    continue
                pack = zstandard.ZstdCompressor(level=1).compress
                block = _opened(row["ids"], row["sizes"], row["text"], length, seed)
                segments = _Segments(block, {x["bucket"]: (x["anchors"], x["hot"]) for x in row["sent"]}, buckets)
                out = []
                for b, i in _by_bucket(segments.bucket):
                    size = segments.count[i] + length - 1
                    places = np.repeat(segments.first[i] - np.cumsum(size) + size, size) + np.arange(size.sum())
                    least, base = segments.least[i], int(segments.least[i].min())
                    out.append(
                        (
                            b,
                            row["block"],
                            segments.count[i].astype(np.uint8).tobytes(),
                            base,
                            pack((least - base).tobytes()),
                            pack((segments.greatest[i] - least).tobytes()),
                            pack(block.text[places].tobytes()),
                            bool(segments.single[i].any()),
                        )
                    )
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    schema = "bucket long, block long, counts binary, base long, least binary, span binary, text binary, single boolean"
    # all columns of the blocks, so that their shuffle is the same as the one before the results
    return table.mapInArrow(run, schema)


def _sorted_windows(sent: DataFrame, length: int) -> DataFrame:
    """Windows (``starts`` to ``ends``) of a block's segments whose string an earlier id has; ``single``: some are of hot anchors."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        counts = [np.frombuffer(c, np.uint8).astype(np.int64) for c in rows["counts"]]
        count = np.concatenate(counts)
        unpack = zstandard.ZstdDecompressor().decompress
        least = np.concatenate([np.frombuffer(unpack(x), np.int64) + b for x, b in zip(rows["least"], rows["base"])])
        greatest = least + np.concatenate([np.frombuffer(unpack(x), np.int64) for x in rows["span"]])
        text = np.frombuffer(b"".join(map(unpack, rows["text"])), np.uint8)
        size = count + length - 1
        start = np.cumsum(size) - size
        hashes = _segment_hash(_window_hashes(text, length), length, start, size)
        owner = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
        # the same segment from several blocks is sorted once
        _, at, of = np.unique(hashes, return_index=True, return_inverse=True)
        low = np.full(len(at), np.iinfo(np.int64).max)
        np.minimum.at(low, of, least)
        segment = np.repeat(np.arange(len(at)), count[at])
        nth = np.arange(len(segment)) - np.repeat(np.cumsum(count[at]) - count[at], count[at])
        place = start[at][segment] + nth
        order, group = deep_shallow_sort(Windows(text, place, length))
        best = np.full(int(group[-1]) + 1 if len(group) else 0, np.iinfo(np.int64).max)
        np.minimum.at(best, group, low[segment[order]])
        smallest = np.empty(len(segment), np.int64)
        smallest[order] = best[group]
        # runs of windows of a segment with one smallest id
        new = np.ones(len(segment), bool)
        new[1:] = (segment[1:] != segment[:-1]) | (smallest[1:] != smallest[:-1])
        runs = np.flatnonzero(new)
        run_segment, run_id = segment[runs], smallest[runs]
        run_from, run_to = nth[runs], nth[np.append(runs[1:], len(segment)) - 1] + 1
        runs_of = np.bincount(run_segment, minlength=len(at))
        first_run = np.cumsum(runs_of) - runs_of
        # what each block must hear: the runs of its segments with an id before the greatest it holds
        times = runs_of[of]
        told = np.repeat(np.arange(len(of)), times)
        r = np.arange(len(told)) - np.repeat(np.cumsum(times) - times, times) + first_run[of[told]]
        useful = run_id[r] < greatest[told]
        told, r = told[useful], r[useful]
        ends = np.searchsorted(owner[told], np.arange(len(counts) + 1))
        out = {c: [] for c in ("block", "hashes", "starts", "ends", "ids", "single")}
        for k, block in enumerate(rows["block"]):
            a, b = ends[k], ends[k + 1]
            if b > a:
                out["block"].append(block)
                out["hashes"].append(hashes[told[a:b]].tobytes())
                out["starts"].append(run_from[r[a:b]].astype(np.uint8).tobytes())
                out["ends"].append(run_to[r[a:b]].astype(np.uint8).tobytes())
                out["ids"].append(run_id[r[a:b]].tobytes())
                out["single"].append(rows["single"].iloc[k])
        return pd.DataFrame(out)

    schema = "block long, hashes binary, starts binary, ends binary, ids binary, single boolean"
    return sent.groupBy("bucket").applyInPandas(run, schema)


def _covered(block: Block, sent: list[dict]) -> np.ndarray:
    """Whether each byte of the block goes."""
    gone = np.zeros(len(block.text) + 1, np.int32)
    if not sent:
        return gone[:-1] > 0
    hashes, starts, ends, ids = (
        np.concatenate([np.frombuffer(x[c], kind) for x in sent])
        for c, kind in (("hashes", np.uint64), ("starts", np.uint8), ("ends", np.uint8), ("ids", np.int64))
    )
    order = np.argsort(hashes, kind="stable")
    hashes, starts, ends, ids = hashes[order], starts[order].astype(np.int64), ends[order].astype(np.int64), ids[order]
    whole = _window_hashes(block.text, block.length)

    def told_of(first: np.ndarray, count: np.ndarray, doc: np.ndarray) -> None:
        own = _segment_hash(whole, block.length, first, count + block.length - 1)
        a, b = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
        n = b - a
        run = np.repeat(np.arange(len(own)), n)
        told = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + a[run]
        earlier = ids[told] < block.ids[doc[run]]
        run, told = run[earlier], told[earlier]
        np.add.at(gone, first[run] + starts[told], 1)
        np.add.at(gone, first[run] + ends[told] - 1 + block.length, -1)

    told_of(block.first, block.count, block.doc)
    if any(x["single"] for x in sent):
        run = np.repeat(np.arange(len(block.count)), block.count)
        nth = np.arange(len(run)) - np.repeat(np.cumsum(block.count) - block.count, block.count)
        longer = block.count[run] > 1
        run, nth = run[longer], nth[longer]
        told_of(block.first[run] + nth, np.ones(len(run), block.count.dtype), block.doc[run])
    return np.cumsum(gone[:-1]) > 0


_FOUND = ["n_bytes", "n_removed", "n_spans", "kept"]


def _results(
    table: DataFrame, length: int, seed: int, key: str, rest: StructType, as_text: bool
) -> DataFrame:
    schema = StructType([StructField(key, LongType())])
    for name in _FOUND[:3]:
        schema = schema.add(name, "long")
    schema = schema.add("kept", "string" if as_text else "binary")
    others = [f for f in rest.fields if f.name not in schema.names]
    names, kinds = schema.names, [pa.int64()] * 4 + [pa.string() if as_text else pa.binary()]
    schema = StructType(schema.fields + others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in _rows(batch):
                block = _opened(row["ids"], row["sizes"], row["text"], length, seed)
                gone = _covered(block, row["sent"])
                out = []
                for doc_id, start, size in zip(block.ids.tolist(), block.starts.tolist(), block.sizes.tolist()):
                    own, text = gone[start : start + size], block.text[start : start + size]
                    spans = int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if size else 0
                    removed = int(own.sum())
                    kept = (text if not removed else text[~own]).tobytes()
                    kept = kept.decode("utf-8", "ignore") if as_text else kept
                    out.append((None if doc_id == _LEAST else doc_id, size, removed, spans, kept))
                columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                if others:
                    more = pa.ipc.open_stream(unpacker.decompress(row["rest"])).read_next_batch()
                    columns += [more.column(f.name) for f in others]
                yield pa.RecordBatch.from_arrays(columns, [*names, *[f.name for f in others]])

    return table.mapInArrow(run, schema)


def remove_repeats(
    docs: DataFrame,
    length: int = 50,
    seed: int = 20,
    block_bytes: int = 2 << 20,
    bucket_bytes: int = 4 << 20,
    hot_runs: int = 100_000,
    key: str = "doc_id",
    text: str = "text",
    as_text: bool = False,
) -> DataFrame:
    """Of every row: its id, ``n_bytes, n_removed, n_spans``, ``kept`` (the bytes left) and its other columns.

    With ``as_text`` ``kept`` is a string, without the characters that were cut in two. The text itself is left out, and so is a column that is named like a result.
    There is a bucket for each ``bucket_bytes`` of text; an anchor of more than ``hot_runs`` runs is hot.
    """
    table = written(blocks(docs, block_bytes, key, text), "blocks")
    buckets = 1 + (table.agg(F.sum("weight")).first()[0] or 0) // bucket_bytes
    shared = _shared(_anchors(table, length, seed, buckets), hot_runs)
    sent = _segments(_per_block(table, shared), length, seed, buckets)
    verdicts = _sorted_windows(sent, length)
    return _results(_per_block(table, verdicts), length, seed, key, docs.drop(key, text).schema, as_text)

"""Importance resampling towards a target: hashed n-grams whose CRCs come from running CRCs of the text.

A text is lower-cased (A-Z), its words are joined by one separator, and it is scanned once; the running CRC-32 registers at the ends
of words are all that is kept. Registers are linear over GF(2), so with P the running one, that of any substring from a to b is
P(b) xor P(a) shifted over b - a bytes: what came before cancels, other texts included. Shifts are table lookups, four for
lengths under 256 bytes, and four more for each higher bit of the length, so an n-gram costs the same whatever its length and n.
The scan itself goes byte by byte through all rows of 256 bytes at once, and shifts what a row begins with by the same rule.

Features are the runs of 1 to n words, in buckets by their CRC. A bucket's gain is a thousand times the log ratio of its smoothed share in
the target and in the documents; a document's weight is the floored mean of its features' gains. Gumbel noise
from a hash of the id makes the highest scores a sample without replacement with chances by weight.

Tasks send one count per bucket, and the gains (one integer per bucket) go to all tasks. The draw needs no global sort: scores are
integers, their counts (bounded by their range) give the place of each score, and ids are ranked within one score.

Nulls and texts without words have no features and weight 0. A null id is hashed as an empty string and comes after the others of
its score. Repeated rows are drawn as often as they are there, those of one id in the order of their features. An empty table gives an
empty result; without target texts the target's counts are all 0.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from corpusmatch.functions.worker import once_per_worker
from corpusmatch.operators.storage import written

BUCKETS = 10_000
# Bytes of text that a task scans at a time, or one longer text.
AT_ONCE = 1 << 21
_POLYNOMIAL = 0xEDB88320
_SEPARATORS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


class Shifts:
    """Shifts of CRC states over zero bytes, as lookups of their four bytes."""

    SHORT = 256

    def __init__(self):
        self.byte = np.zeros(256, np.uint32)
        for x in range(256):
            state = x
            for _ in range(8):
                state = (state >> 1) ^ (_POLYNOMIAL if state & 1 else 0)
            self.byte[x] = state
        units = np.arange(256, dtype=np.uint32)[None] << (np.uint32(8) * np.arange(4, dtype=np.uint32))[:, None]
        self.short = np.zeros((self.SHORT, 4, 256), np.uint32)
        self.short[0] = units
        for n in range(1, self.SHORT):
            before = self.short[n - 1]
            self.short[n] = (before >> np.uint32(8)) ^ self.byte[before & np.uint32(255)]
        # over 256, 512, 1024 bytes and so on
        self.long = [self._apply(self.short[128], self.short[128])]
        for _ in range(40):
            self.long.append(self._apply(self.long[-1], self.long[-1]))

    @staticmethod
    def _apply(table: np.ndarray, state: np.ndarray) -> np.ndarray:
        found = table[0][state & np.uint32(255)]
        for i in range(1, 4):
            found ^= table[i][(state >> np.uint32(8 * i)) & np.uint32(255)]
        return found

    def running(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Registers after each byte of a row of ``SHORT`` bytes, as if it began with none, and what each row begins with."""
        width = self.SHORT
        rows = -(-len(text) // width)
        padded = np.zeros(rows * width, np.uint8)
        padded[: len(text)] = text
        columns = padded.reshape(rows, width).T.astype(np.uint32)
        state = np.zeros(rows, np.uint32)
        for i in range(width):
            state = (state >> np.uint32(8)) ^ self.byte[(state ^ columns[i]) & np.uint32(255)]
            columns[i] = state
        # a row begins with all rows before it: by doubling distances
        begin = np.concatenate((np.zeros(min(rows, 1), np.uint32), state[:-1]))
        distance, bit = 1, 0
        while distance < rows:
            more = self._apply(self.long[bit], begin[:-distance])
            begin[distance:] ^= more
            distance, bit = 2 * distance, bit + 1
        return columns, begin

    def over(self, state: np.ndarray, length: np.ndarray) -> np.ndarray:
        low = length % self.SHORT
        found = self.short[low, 0, state & np.uint32(255)]
        for i in range(1, 4):
            found ^= self.short[low, i, (state >> np.uint32(8 * i)) & np.uint32(255)]
        rest, bit = length // self.SHORT, 0
        while rest.any():
            some = np.flatnonzero(rest & 1)
            found[some] = self._apply(self.long[bit], found[some])
            rest, bit = rest >> 1, bit + 1
        return found


def shifts() -> Shifts:
    return once_per_worker("crc-shifts", Shifts)


def ngram_crcs(texts: list[bytes], longest: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRCs of all runs of 1 to ``longest`` words of the texts, the number of the text of each, and words of each text."""
    joined = [b" ".join(x.translate(_SEPARATORS).split()) for x in texts]
    counts = np.array([x.count(b" ") + 1 if x else 0 for x in joined], np.int64)
    raw = np.frombuffer(b"".join(b" " + x for x in joined if x), np.uint8)
    table = shifts()
    columns, begin = table.running(raw)
    # a word stands between two separators, the last before the end
    ahead = np.flatnonzero(raw == 0x20)
    behind = np.append(ahead[1:], len(raw))[: len(ahead)] - 1

    def registers(at: np.ndarray) -> np.ndarray:
        row, column = at // table.SHORT, at % table.SHORT
        return columns[column, row] ^ table.over(begin[row], column + 1)

    # the register that CRC-32 starts with is turned to its complement, and so is its result
    starts, ends = ~registers(ahead), ~registers(behind)
    text = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    crcs, owners = [], []
    for n in range(1, longest + 1):
        last = np.flatnonzero(nth >= n - 1)
        first = last - (n - 1)
        crcs.append(ends[last] ^ table.over(starts[first], behind[last] - ahead[first]))
        owners.append(text[last])
    return np.concatenate(crcs), np.concatenate(owners), counts


def _some(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows and texts, about ``AT_ONCE`` bytes at a time."""
    for batch in batches:
        texts = batch.column(column)
        first, weight = 0, 0
        for i in range(batch.num_rows):
            n = texts[i].as_buffer().size if texts[i].is_valid else 0
            if i > first and weight + n > AT_ONCE:
                some = batch.slice(first, i - first)
                yield some, [x or b"" for x in some.column(column).to_pylist()]
                first, weight = i, 0
            weight += n
        if batch.num_rows > first:
            some = batch.slice(first)
            yield some, [x or b"" for x in some.column(column).to_pylist()]


def bucket_counts(df: DataFrame, text: str = "text", longest: int = 2, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for _, texts in _some(batches, 0):
            crcs, _, _ = ngram_crcs(texts, longest)
            counts += np.bincount(crcs % buckets, minlength=buckets)
        at = np.flatnonzero(counts)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["bucket", "n"])

    told = df.select(F.col(text).cast("binary").alias("text")).mapInArrow(run, "bucket long, n long")
    found = np.zeros(buckets, np.int64)
    for r in told.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        found[r["bucket"]] = r["n"]
    return found


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket floor(1000 * ln of its smoothed share in the target over that in the source)."""
    s_all, t_all, n = int(source.sum()), int(target.sum()), len(source)
    return np.array(
        [
            math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n))))
            for s, t in zip(source.tolist(), target.tolist())
        ],
        np.int64,
    )


def noise(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(
    docs: DataFrame, gain: np.ndarray, longest: int = 2, seed: int = 7, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row."""
    names = ["doc_id", "n_words", "n_features", "weight", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _some(batches, 1):
            crcs, owners, words = ngram_crcs(texts, longest)
            n = np.bincount(owners, minlength=len(texts))
            total = np.zeros(len(texts), np.int64)
            np.add.at(total, owners, gain[crcs % len(gain)])
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            score = weight + np.array([noise(x, seed) for x in rows.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), *map(pa.array, (words, n, weight, score))], names)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def draw(scored: DataFrame, percent: int = 25, least_words: int = 20) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3 ... of the drawn rows by falling score and rising id, null for the others."""
    able = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    counts = written(scored.filter(able).groupBy("score").agg(F.count("*").alias("n")), "counts")
    wanted = (counts.agg(F.sum("n")).first()[0] or 0) * percent // 100
    # rows of higher scores, in two steps, so that no window sees more than a few hundred rows
    coarse = F.floor(F.col("score") / 256).alias("coarse")
    steps = counts.groupBy(coarse).agg(F.sum("n").alias("n"))
    over = W.orderBy(F.desc("coarse")).rowsBetween(W.unboundedPreceding, -1)
    steps = steps.select("coarse", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))
    inside = W.partitionBy("coarse").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)
    above = counts.withColumn("coarse", coarse).withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    above = above.join(steps, "coarse").select("score", (F.col("before") + F.col("within")).alias("above"))
    above = written(above.filter(F.col("above") < wanted), "above")
    # one row per score, and scores are thousandths of logs: a few hundred thousand at any size of the input
    marked = scored.join(F.broadcast(above), "score", "left").withColumn("above", F.when(able, F.col("above")))
    rest = marked.filter("above IS NULL").withColumn("rank", F.lit(None).cast("long"))
    order = W.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight")
    near = marked.filter("above IS NOT NULL").withColumn("rank", F.col("above") + F.row_number().over(order))
    near = near.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return near.unionByName(rest).drop("above")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 25,
    least_words: int = 20,
    longest: int = 2,
    buckets: int = BUCKETS,
    seed: int = 7,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row; ``rank`` is null where it isn't drawn."""
    source = bucket_counts(docs, text, longest, buckets)
    gain = gains(source, bucket_counts(target, target_text, longest, buckets))
    return draw(written(weights(docs, gain, longest, seed, key, text), "weights"), percent, least_words)

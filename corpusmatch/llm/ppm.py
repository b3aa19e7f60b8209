"""Prediction by partial matching over bytes: log10 probability of whole texts under a model of the corpus.

A text is its bytes with A-Z in lower case, then one end symbol; in front of it stand ``order`` start symbols,
which are context and never predicted. The trie of contexts is a table of counts by context and next symbol,
from order 0 to ``order``. A context predicts a seen symbol with ``(c - 0.5) / N`` (N occurrences, T different
symbols) and escapes to the next shorter one with ``T / 2N``; there the symbols of the longer context are
excluded from N and T. Below order 0 the symbols never seen share what is left evenly. A context that was
never seen costs nothing.

As every occurrence of a context is one of its shorter form too, what is excluded is always the symbol set of
the context just left. So the probability of each (context, symbol) follows from its own counts and the result
for the context that is one symbol shorter, and the model is worked out order by order with joins in
which no key has more rows than there are symbols. A text's score is then a sum over its (context, symbol)
pairs. The most frequent entries of the model, up to a fixed number, go to all tasks; the pairs of a text that
are not among them are joined with the rest of the table, so nothing is cut off.

The base is a unigram model over words with 0.5 added to each count; it is gathered and looked up the same way,
words by a 64-bit hash.

Nulls: a null text is empty (its end symbol is scored); a row with a null id trains. Repeated rows count and
come back as often as they are there. An empty table gives an empty result; with no row to learn from, all
symbols are equally likely.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from corpusmatch.operators.storage import written

BITS = 9
END, START = 256, 257
SYMBOLS = 257  # bytes and the end
HALF = 0.5

_SLICE = 1 << 19


def held_out(key: Column, parts: int = 5, held: int = 1) -> Column:
    """Whether the crc32 of the id as text leaves ``held`` over ``parts``."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == held, F.lit(False))


def _slices(raw: bytes, order: int) -> Iterator[np.ndarray]:
    """The symbols of a text, each slice with ``order`` symbols of context in front."""
    body = np.frombuffer(raw.lower(), np.uint8).astype(np.int64)
    symbols = np.concatenate((np.full(order, START), body, [END]))
    for at in range(order, len(symbols), _SLICE):
        yield symbols[at - order : at + _SLICE]


def _grams(pieces: list[np.ndarray], order: int) -> np.ndarray:
    """(context, symbol) of each place of the pieces, in order: the symbol in the lowest bits, older ones above."""
    found = []
    for piece in pieces:
        n = len(piece) - order
        gram = np.zeros(n, np.int64)
        for i in range(order + 1):
            gram = (gram << BITS) | piece[i : i + n]
        found.append(gram)
    return np.concatenate(found)


def _word_key(word: bytes) -> int:
    """A negative number, so that words and contexts can share a column."""
    return -(xxhash.xxh64_intdigest(word) >> 1) - 1


_END_WORD = -(1 << 63)  # no word's key: those of words are hashes of bytes, up to -1


def _batches(batch: pa.RecordBatch, column: int, order: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Row numbers and pieces, together about one slice of symbols at a time."""
    rows, pieces, weight = [], [], 0
    for i, text in enumerate(batch.column(column)):
        for piece in _slices(text.as_py() or b"", order):
            rows.append(i)
            pieces.append(piece)
            weight += len(piece)
            if weight >= _SLICE:
                yield rows, pieces
                rows, pieces, weight = [], [], 0
    if rows:
        yield rows, pieces


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    return [key], [np.bincount(back, np.concatenate(counts), len(key)).astype(np.int64)]


def counts(rows: DataFrame, order: int) -> DataFrame:
    """``key, n``: how often each (context, symbol) and each word occurs in rows to learn from.

    Contexts of rows held out are there too, with zero. ``rows``: text (binary), held_out.
    """
    most = 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key, n):
            for at in range(0, len(key), 50_000):
                part = [pa.array(x[at : at + 50_000], pa.int64()) for x in (key, n)]
                yield pa.RecordBatch.from_arrays(part, ["key", "n"])

        words: Counter = Counter()
        ends, keys, totals = 0, [], []
        for batch in batches:
            held = batch.column(1).to_pylist()
            for i, text in enumerate(batch.column(0)):
                if not held[i]:
                    words.update((text.as_py() or b"").lower().split())
                    ends += 1
                if len(words) > 150_000:
                    yield from out(list(map(_word_key, words)), list(words.values()))
                    words.clear()
            for numbers, pieces in _batches(batch, 0, order):
                learns = [p for i, p in zip(numbers, pieces) if not held[i]]
                others = [p for i, p in zip(numbers, pieces) if held[i]]
                if learns:
                    key, n = np.unique(_grams(learns, order), return_counts=True)
                    keys.append(key)
                    totals.append(n)
                if others:
                    key = np.unique(_grams(others, order))
                    keys.append(key)
                    totals.append(np.zeros(len(key), np.int64))
                if sum(map(len, keys)) > most:
                    keys, totals = _merged(keys, totals)
                    if len(keys[0]) > most // 2:
                        yield from out(keys[0], totals[0])
                        keys, totals = [], []
        if ends:
            yield from out([*map(_word_key, words), _END_WORD], [*words.values(), ends])
        if keys:
            keys, totals = _merged(keys, totals)
            yield from out(keys[0], totals[0])

    found = rows.select("text", "held_out").mapInArrow(run, "key long, n long")
    return found.groupBy("key").agg(F.sum("n").alias("n"))


def model(grams: DataFrame, order: int) -> DataFrame:
    """``key, n, value``: the log10 probability of the symbol in the context, for each (context, symbol)."""
    by_order = {order: grams.select("key", "n")}
    for k in range(order - 1, -1, -1):
        mask = (1 << BITS * (k + 1)) - 1
        shorter = by_order[k + 1].groupBy(F.col("key").bitwiseAND(mask).alias("key")).agg(F.sum("n").alias("n"))
        by_order[k] = written(shorter, f"order{k}")

    def log(a, b) -> Column:
        return F.log10(F.col(a) if isinstance(a, str) else a) - F.log10(F.col(b) if isinstance(b, str) else b)

    known = None
    for k in range(order + 1):
        now = by_order[k].withColumn("ctx", F.shiftright("key", BITS))
        if known is None:
            now = now.withColumn("n1", F.lit(0).cast("long"))
        else:
            mask = (1 << BITS * k) - 1
            now = now.withColumn("short", F.col("key").bitwiseAND(mask)).join(known, "short")
        seen = F.col("n") > 0
        nodes = now.groupBy("ctx").agg(
            F.sum("n").alias("whole"),
            F.sum(F.when(seen, 1).otherwise(0)).alias("kinds"),
            F.sum(F.when(seen, F.col("n1")).otherwise(0)).alias("met"),
        )
        now = now.join(nodes, "ctx")
        if known is None:
            # an unseen symbol shares the rest evenly with all unseen ones
            escaped = -F.log10(F.greatest(F.lit(SYMBOLS) - F.col("kinds"), F.lit(1)).cast("double"))
            unknown = F.lit(-math.log10(SYMBOLS))
        else:
            # what the shorter context has when this one's symbols are excluded
            rest_n, rest_t = F.col("whole1") - F.col("met"), F.col("kinds1") - F.col("kinds")
            escaped = (
                F.when(rest_t <= 0, F.col("escaped1"))
                .when(F.col("n1") > 0, log(F.col("n1") - HALF, rest_n))
                .otherwise(log(rest_t * HALF, rest_n) + F.col("escaped1"))
            )
            unknown = F.col("value1")
        value = (
            F.when(F.col("whole") == 0, unknown)
            .when(seen, log(F.col("n") - HALF, "whole"))
            .otherwise(log(F.col("kinds") * HALF, "whole") + F.col("escaped"))
        )
        now = now.withColumn("escaped", escaped).withColumn("value", value)
        now = written(now.select("key", "n", "whole", "kinds", "escaped", "value"), f"model{k}")
        known = now.select(
            F.col("key").alias("short"),
            *[F.col(c).alias(f"{c}1") for c in ("n", "whole", "kinds", "escaped", "value")],
        )
    return now.select("key", "n", "value")


def _frequent(table: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, DataFrame | None]:
    """Keys (sorted) and values of the most frequent entries, ``most`` or fewer, and the rest as a table."""
    step = F.floor(F.log2(F.col("n") + 1.0) * 8)
    sizes = {r["s"]: r["c"] for r in table.groupBy(step.alias("s")).agg(F.count("*").alias("c")).collect()}
    total, least = 0, None
    for s in sorted(sizes, reverse=True):
        if total + sizes[s] > most:
            break
        total, least = total + sizes[s], s
    common = table.limit(0) if least is None else table.filter(step >= least)
    got = common.select("key", "value").toArrow()
    keys, values = got.column("key").to_numpy(), got.column("value").to_numpy()
    order = np.argsort(keys)
    rest = None if total == sum(sizes.values()) else table if least is None else table.filter(step < least)
    return keys[order], values[order].astype(np.float64), rest


def score(
    docs: DataFrame,
    order: int = 5,
    key: str = "doc_id",
    text: str = "text",
    held: Column | None = None,
    sent_entries: int = 1_500_000,
    sent_words: int = 1_000_000,
) -> DataFrame:
    """Of every row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``sent_entries`` and ``sent_words`` bound what goes to all tasks (16 bytes each).
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(key).cast("long").alias("doc_id"),
        (held_out(F.col(key)) if held is None else held).alias("held_out"),
        F.col(text).cast("binary").alias("text"),
    )
    gathered = written(counts(rows, order), "counts")
    words = gathered.filter("key < 0").withColumn("value", F.col("n").cast("double"))
    whole = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    train, least = whole["n"], whole["n"] + 0.5 * (whole["v"] + 1)
    entries = model(gathered.filter("key >= 0"), order)
    word_keys, word_values, more_words = _frequent(words, sent_words)
    gram_keys, gram_values, more_grams = _frequent(entries, sent_entries)
    sent = spark.sparkContext.broadcast((word_keys, word_values, gram_keys, gram_values))
    words_end, grams_end = more_words is None, more_grams is None
    names = ["kind", "key", "row", "n", "n_tokens", "n_known", "base", "score", "doc_id", "held_out"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_keys, word_values, gram_keys, gram_values = sent.value

        def found(of: np.ndarray, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not len(keys):
                return np.zeros(len(of), bool), np.zeros(len(of))
            at = np.minimum(np.searchsorted(keys, of), len(keys) - 1)
            return keys[at] == of, values[at]

        def out(kind, key, row, n, n_tokens=None, n_known=None, base=None, score=None, ids=None, held=None):
            size = len(row)
            zero = np.zeros(size)
            parts = [np.full(size, kind, np.int32), key, row, n]
            parts += [(zero if x is None else x).astype(np.int64) for x in (n_tokens, n_known)]
            parts += [zero if x is None else x for x in (base, score)]
            columns = [pa.array(x) for x in parts]
            columns.append(pa.nulls(size, pa.int64()) if ids is None else ids)
            columns.append(pa.nulls(size, pa.bool_()) if held is None else held)
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            row = np.asarray(batch.column(0))
            size = len(row)
            scores, base = np.zeros(size), np.zeros(size)
            n_tokens, n_known = np.zeros(size, np.int64), np.zeros(size, np.int64)
            for numbers, pieces in _batches(batch, 1, order):
                of = np.repeat(numbers, [len(p) - order for p in pieces])
                grams, back = np.unique(_grams(pieces, order), return_inverse=True)
                there, value = found(grams, gram_keys, gram_values)
                scores += np.bincount(of, np.where(there, value, 0)[back], size)
                if not grams_end and not there.all():
                    missed = ~there[back]
                    pair, n = np.unique(np.stack([of[missed], back[missed]]), axis=1, return_counts=True)
                    yield out(2, grams[pair[1]], row[pair[0]], n)
            for at in range(0, size, 256):
                tokens = [Counter((t.as_py() or b"").lower().split()) for t in batch.column(1)[at : at + 256]]
                of = at + np.repeat(np.arange(len(tokens)), [len(c) + 1 for c in tokens])
                keys = np.array([k for c in tokens for k in (*map(_word_key, c), _END_WORD)], np.int64)
                n = np.array([k for c in tokens for k in (*c.values(), 1)], np.int64)
                there, value = found(keys, word_keys, word_values)
                n_tokens += np.bincount(of, n, size).astype(np.int64)
                n_known += np.bincount(of, n * there, size).astype(np.int64)
                here = there if not words_end else np.ones(len(of), bool)
                part = n * np.log10((np.where(there, value, 0) + 0.5) / least)
                base += np.bincount(of, np.where(here, part, 0), size)
                if not here.all():
                    yield out(1, keys[~here], row[of[~here]], n[~here])
            yield out(0, row, row, np.zeros(size, np.int64), n_tokens, n_known, base, scores, *batch.columns[2:])

    # the number of a row holds within this one pass only, so all that is known of a row goes along
    schema = "kind int, key long, row long, n long, n_tokens long, n_known long, base double, score double"
    parts = rows.select("row", "text", "doc_id", "held_out").mapInArrow(
        run, schema + ", doc_id long, held_out boolean"
    )
    rest = [
        t.select(F.lit(kind).alias("kind"), "key", "value")
        for kind, t in ((1, more_words), (2, more_grams))
        if t is not None
    ]
    if rest:
        table = rest[0] if len(rest) == 1 else rest[0].unionByName(rest[1])
        value = F.coalesce("value", F.lit(0.0))
        by_word, by_gram = F.col("kind") == 1, F.col("kind") == 2
        parts = parts.join(table, ["kind", "key"], "left").select(
            "row",
            "doc_id",
            "held_out",
            "n_tokens",
            F.when(by_word & F.col("value").isNotNull(), F.col("n")).otherwise(F.col("n_known")).alias("n_known"),
            F.when(by_word, F.col("n") * F.log10((value + 0.5) / least)).otherwise(F.col("base")).alias("base"),
            F.when(by_gram, F.col("n") * value).otherwise(F.col("score")).alias("score"),
        )
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")]
    known = [F.max(c).alias(c) for c in ("doc_id", "held_out")]
    return parts.groupBy("row").agg(*known, *sums).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(train).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), "score",
    )

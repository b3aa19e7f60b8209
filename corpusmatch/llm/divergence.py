"""Quality rules: counts of a text, and how far its histograms are from those of its language.

Two histograms are held against the references of all languages by Jensen-Shannon distance (root of the
divergence in bits, 0 to 1): one of character classes, one of the language's most common words and all others.
The nearest reference counts. A short text strays from any reference by chance, so the limit is
``base + spread / sqrt(words)``, and a text below a minimum length is not judged by that histogram.

References are taken from all documents of the table: every task counts classes and words by language, the
counts are added up, and the few most common words of each language go to the driver.

Nulls: a null text has no words. A null language is held against all references like any other; a language
with fewer than ``min_reference_words`` words gives no reference, and its documents are not judged by
distance. Repeated rows count as often as they are there. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

SYMBOLS = "#*$%&|<>"
_CLASSES = 7


def _class_table() -> np.ndarray:
    """Class of a UTF-8 byte: space, lower, upper, digit, punctuation, other ASCII, first byte beyond ASCII."""
    table = np.full(256, _CLASSES, np.uint8)
    for b in range(128):
        c = chr(b)
        table[b] = (
            0 if c in " \t\n\v\f\r" else 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit()
            else 4 if c in ".,;:!?'\"()-" else 5
        )
    table[0xC0:] = 6
    return table


@dataclass
class Limits:
    common_words: int = 100
    min_reference_words: int = 10_000
    min_chars: int = 200
    min_words: int = 100
    chars: tuple[float, float] = (0.12, 1.5)
    words: tuple[float, float] = (0.18, 3.2)


@dataclass
class References:
    """By language: class counts, and counts of the common words with those of all other words at the end."""

    classes: dict[str, np.ndarray] = field(default_factory=dict)
    words: dict[str, dict[bytes, int]] = field(default_factory=dict)
    totals: dict[str, int] = field(default_factory=dict)


def _distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two count vectors; 1 if either is empty."""
    if not p.sum() or not q.sum():
        return 1.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    parts = [(x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum() for x in (p, q)]
    return math.sqrt(max(0.0, sum(parts) / 2))


_WORD, _TOTAL = -1, -2


def references(docs: DataFrame, limits: Limits, text: str = "text", lang: str = "lang") -> References:
    """Counted over all documents; a task holds at most ``most`` counts before it hands them on."""
    most = 100_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        others: Counter = Counter()
        table = _class_table()

        def rows() -> pa.RecordBatch:
            of = [(k, w, _WORD, n) for k, c in words.items() for w, n in c.items()]
            of += [(k, None, kind, n) for (k, kind), n in others.items()]
            words.clear()
            others.clear()
            kinds = (pa.string(), pa.binary(), pa.int32(), pa.int64())
            columns = zip(*of) if of else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        names = ["lang", "word", "kind", "n"]
        for batch in batches:
            for some, of in zip(batch.column(0), batch.column(1).to_pylist()):
                raw = some.as_py() or b""
                found = raw.lower().split()
                words.setdefault(of, Counter()).update(found)
                others[of, _TOTAL] += len(found)
                for kind, n in enumerate(np.bincount(table[np.frombuffer(raw, np.uint8)], minlength=8)[:_CLASSES]):
                    others[of, kind] += int(n)
                if sum(map(len, words.values())) > most:
                    yield rows()
        yield rows()

    rows = docs.filter(F.col(lang).isNotNull()).select(F.col(text).cast("binary").alias("text"), F.col(lang).alias("lang"))
    counted = rows.mapInArrow(run, "lang string, word binary, kind int, n long")
    summed = counted.groupBy("lang", "word", "kind").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang", F.col("kind") == _WORD).orderBy(F.desc("n"), "word", "kind")
    best = summed.withColumn("rank", F.row_number().over(first)).filter(
        F.col("rank") <= max(limits.common_words, _CLASSES + 1)
    )
    found, totals = References(), {}
    for r in best.orderBy("lang", "rank").collect():
        if r["kind"] == _WORD:
            if r["rank"] <= limits.common_words:
                found.words.setdefault(r["lang"], {})[bytes(r["word"])] = r["n"]
        elif r["kind"] == _TOTAL:
            totals[r["lang"]] = r["n"]
        else:
            found.classes.setdefault(r["lang"], np.zeros(_CLASSES))[r["kind"]] = r["n"]
    for of in [*found.classes]:
        if totals.get(of, 0) < limits.min_reference_words:
            found.classes.pop(of)
            found.words.pop(of, None)
        else:
            found.totals[of] = totals[of]
    return found


class Judge:
    """Distances of a text from the nearest reference, and the verdict."""

    def __init__(self, known: References, limits: Limits):
        self.known, self.limits, self.table = known, limits, _class_table()

    def distances(self, raw: bytes, words: list[bytes]) -> tuple[float | None, float | None]:
        limits, chars, common = self.limits, None, None
        if not self.known.classes:
            return None, None
        if len(raw) >= limits.min_chars:
            counts = np.bincount(self.table[np.frombuffer(raw, np.uint8)], minlength=8)[:_CLASSES]
            chars = min(_distance(counts, q) for q in self.known.classes.values())
        if len(words) >= limits.min_words:
            own, common = Counter(words), 1.0
            for of, ref in self.known.words.items():
                p = np.array([own.get(w, 0) for w in ref], float)
                q = np.array(list(ref.values()), float)
                rest = len(words) - p.sum(), self.known.totals[of] - q.sum()
                common = min(common, _distance(np.append(p, rest[0]), np.append(q, rest[1])))
        return chars, common

    def keeps(self, n_words: int, chars: float | None, words: float | None) -> bool:
        for found, (base, spread) in ((chars, self.limits.chars), (words, self.limits.words)):
            if found is not None and found > base + spread / math.sqrt(max(n_words, 1)):
                return False
        return True


def repeated(words: list) -> int:
    """Words that lie in a window of three words found twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    n, covered = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            n += i + 3 - max(i, covered)
            covered = i + 3
    return n


_SYMBOL = re.compile(f"[{re.escape(SYMBOLS)}]".encode())
_LINES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, char_distance double, word_distance double"
)


def _measures(raw: bytes, of: str | None, judge: Judge) -> tuple:
    words = raw.split()
    n = len(words)
    # continuation bytes are no code points of their own
    inside = b"".join(words)
    points = len(inside) - int(np.count_nonzero((np.frombuffer(inside, np.uint8) & 0xC0) == 0x80))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    again = repeated(words)
    failed = n < 50 or 100 * again > 50 * n
    judged = of is None or of in judge.known.classes
    chars, common = judge.distances(raw, raw.lower().split()) if judged else (None, None)
    return (
        n, points, len(_SYMBOL.findall(raw)), len(lines) - len(set(lines)), again,
        failed, not failed and judge.keeps(n, chars, common), chars, common,
    )


def rules(
    docs: DataFrame,
    limits: Limits | None = None,
    known: References | None = None,
    text: str = "text",
    lang: str = "lang",
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns of ``keep`` (default: all), and of every row its measures, ``base_failed`` and ``kept``.

    ``keep`` must not hold a column named like a measure; such a column is left out.
    """
    limits = limits or Limits()
    judge = Judge(known or references(docs, limits, text, lang), limits)
    names = [x.split()[0] for x in _LINES.split(", ")]
    kept = [c for c in (keep or docs.columns) if c not in names and c != text]
    gives_text = text in (keep or docs.columns)
    rows = docs.select(F.col(text).cast("binary").alias("_text"), F.col(lang).alias("_lang"), *kept)
    schema = rows.drop("_text", "_lang").schema
    if gives_text:
        schema = schema.add(text, "string")
    for part in _LINES.split(", "):
        schema = schema.add(*part.split())
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                _measures(some.as_py() or b"", of, judge)
                for some, of in zip(batch.column(0), batch.column(1).to_pylist())
            ]
            columns = zip(*found) if found else [()] * len(kinds)
            own = [pa.array(c, k) for c, k in zip(columns, kinds)]
            given = [batch.column(0).cast(pa.string())] if gives_text else []
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *given, *own], schema.names)

    return rows.mapInArrow(run, schema)

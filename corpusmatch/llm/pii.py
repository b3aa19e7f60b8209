"""Personal data: generous generators propose overlapping spans, boosted trees judge them, calibrated thresholds choose.

* **Base spans** are what four strict patterns match (e-mail, IPv4 address, payment card, telephone number), leftmost and not
  overlapping per kind, without those that fail their check. They always stay.
* **Candidates** are proposed beyond that: addresses with ``(at)`` and ``dot`` written out, four numbers with other separators,
  and of each run of digits and separators every stretch of up to ``PARTS`` of its parts, as a card and as a telephone number.
  They overlap freely.
* **Features** describe a candidate's format (digits, groups, separators, check digits, ranges, labels) and its
  context (words before it that announce such data or something else, what it touches).
* **Trees.** Gradient boosting for the logistic loss over trees of depth 3 on binned features. It learns from the candidates of all
  texts, copies included: base spans are good; candidates that fail a check or have the wrong ends are bad. Good spans also come
  rewritten in the other forms and bad ones are made of them (a wrong check digit, dates, versions, amounts), in the
  contexts where they stood. Examples stay in tables: equal ones are a row with their number, each level of a tree is a pass
  that sums gradients by node, feature and bin, and the driver holds these sums (up to ``ROWS_PER_TASK`` distinct examples
  it makes them itself). They are whole numbers of ``1 / UNITS``,
  so that the trees don't depend on the order of rows or tasks.
* **Thresholds.** The examples of a fifth of all texts (by hash) are seen by no tree and calibrate the scores: for each kind the
  smallest multiple of ``1 / STEPS`` from which on at least ``precision`` of them are good. A kind without such a threshold
  adds nothing.

Chosen candidates are added by falling score where they overlap no span that is there already. With fewer than 20 good
or 20 bad examples nothing is added.

Nulls and empty texts have no spans; null and repeated ids are kept; an empty table gives an empty result. All
patterns are linear in the text.
"""

from __future__ import annotations

import bisect
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusmatch.operators.storage import staging, written

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
ROUNDS, DEPTH, RATE, BINS = 80, 3, 0.2, 32
# Parts of one that gradients are rounded to, and that thresholds may be; scores beyond the bound count as it.
UNITS, STEPS, MOST = 1 << 20, 256, 64
# Distinct examples that one task sums, examples of one batch, and trees after which scores are written.
ROWS_PER_TASK, EXAMPLES_AT_ONCE, TREES_KEPT = 100_000, 5000, 10
# Parts of a run of numbers that one candidate may have.
PARTS = 6

# --- base spans -----------------------------------------------------------------------------------

_AT = re.compile("@")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile("[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, x in enumerate(reversed(digits)):
        d = int(x) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    """By the at signs, so that a long run of other characters is not searched again and again."""
    found, after = [], 0
    for m in _AT.finditer(text):
        at = m.start()
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            after = domain.end()
        else:
            after = max(after, at + 1)
    return found


def _ips(text: str) -> list[tuple[int, int]]:
    """A longer chain of numbers is cut into fours from its left."""
    found = []
    for m in _DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        for i in range(0, len(parts) - 3, 4):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in parts[i : i + 4]):
                found.append((at + (int(ends[i - 1]) + 1 if i else 0), at + int(ends[i + 3])))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` in order."""
    if not _ANY.search(text):
        return []
    found = [(a, 0, b) for a, b in _emails(text)] + [(a, 1, b) for a, b in _ips(text)]
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() and 12 <= len(digits := _digits(m.group())) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(found)


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


# --- candidates -----------------------------------------------------------------------------------

_WRITTEN_AT = re.compile(r"\s?(?:@|\(at\)|\[at\]|\{at\}|<at>|(?<=\s)at(?=\s))\s?", re.I)
_WRITTEN_DOT = r"(?:\.|\s?(?:\(dot\)|\[dot\]|\{dot\}|<dot>|\(\.\)|\[\.\])\s?|\sdot\s)"
_WRITTEN_DOMAIN = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{_WRITTEN_DOT}[A-Za-z0-9-]{{1,63}}){{1,6}}", re.I)
_WRITTEN_LOCAL = re.compile(rf"(?:[A-Za-z0-9_%+-]{{1,64}}{_WRITTEN_DOT}){{0,3}}[A-Za-z0-9._%+-]{{1,64}}\Z", re.I)
_FOUR = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\s?[.,:]\s?|\[\.\]|\(\.\)|\sdot\s)[0-9]{1,3}){3}(?![0-9])", re.I)
_NUMBERS = re.compile(r"[+(]{0,2}[0-9](?:[\x20(). ‐-–/-]{0,3}[0-9])+")
_RUN = re.compile(r"([+(]{0,2})[0-9]+")
_NEAR = 40


def candidates(text: str) -> set[tuple[int, int, int]]:
    """Overlapping proposals ``(start, kind, end)``; the base spans are among them."""
    found = set(base_spans(text))
    low = text if "@" in text else text.lower()
    if "@" in low or "at" in low and "dot" in low or "(at" in low or "[at" in low:
        for m in _WRITTEN_AT.finditer(text):
            domain = _WRITTEN_DOMAIN.match(text, m.end())
            local = _WRITTEN_LOCAL.search(text[max(0, m.start() - _NEAR) : m.start()]) if domain else None
            if local:
                start = max(0, m.start() - _NEAR) + local.start()
                found.add((start, 0, domain.end()))
                # shorter ends: a sentence may go on behind the last label
                dots = list(re.finditer(_WRITTEN_DOT, domain.group(), re.I))
                found |= {(start, 0, domain.start() + d.start()) for d in dots[1:]}
    if not _ANY.search(text):
        return found
    found |= {(m.start(), 1, m.end()) for m in _FOUR.finditer(text)}
    for m in _NUMBERS.finditer(text):
        if m.end() - m.start() < 7:
            continue
        runs = [(m.start() + r.start(), m.start() + r.end(1), m.start() + r.end()) for r in _RUN.finditer(m.group())]
        sizes = [b - first for _, first, b in runs]
        for i in range(len(runs)):
            n = 0
            for j in range(i, min(len(runs), i + PARTS)):
                n += sizes[j]
                if n > 19:
                    break
                if 7 <= n <= 15:
                    found.add((runs[i][0], 3, runs[j][2]))
                if 12 <= n:
                    found.add((runs[i][1], 2, runs[j][2]))
    return found


# --- features -------------------------------------------------------------------------------------

# Words that announce a kind of data, and words that announce other numbers.
HINTS = (
    ("mail", "contact", "write", "correo", "courriel", "kontakt", "schreib", "escrib", "écri"),
    ("ip", "server", "host", "address", "adresse", "dirección", "login", "client"),
    ("card", "visa", "credit", "tarjeta", "carte", "karte", "payment", "paid"),
    ("phone", "call", "tel", "mobile", "fax", "cell", "whatsapp", "llam", "appel", "anruf", "móvil", "handy"),
)
OTHERS = ("version", "release", "token", "order", "isbn", "price", "total", "invoice", "section", "page", "build", "date", "key", "hash")

FEATURES = (
    "email ip card phone length digits groups longest shortest even_groups spaces hyphens dots brackets slashes plus luhn first_digit "
    "byte_parts zero_parts hint other_hint other at_sign at_bracket dot_written labels last_label local local_marks touches_letter "
    "touches_digit touches_mark number_before number_after quoted money date_like"
).split()


_NUMBER_BEFORE = re.compile(r"[0-9+][\s().-]{0,2}\Z")
_NUMBER_AFTER = re.compile(r"[\s().-]{0,2}[0-9]")


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    span = text[start:end]
    digits = _digits(span)
    groups = re.findall("[0-9]+", span)
    sizes = [len(g) for g in groups] or [0]
    before, after = text[max(0, start - _NEAR) : start].lower(), text[end : end + 3]
    hints = [any(h in before for h in hint) for hint in HINTS]
    left, right = before[-1:], after[:1]
    email = kind == 0
    local, _, domain = re.sub(_WRITTEN_AT, "@", span, count=1).partition("@") if email else ("", "", "")
    labels = [x for x in re.split(_WRITTEN_DOT, domain, flags=re.I) if x and x.strip()] if email else []
    low = span.lower()
    year = len(groups) >= 3 and any(len(g) == 4 and g[:2] in ("19", "20") for g in (groups[0], groups[-1]))
    return [
        kind == 0,
        kind == 1,
        kind == 2,
        kind == 3,
        len(span),
        len(digits),
        len(groups),
        max(sizes),
        min(sizes),
        len(set(sizes[:-1])) <= 1 and sizes[-1] <= sizes[0],
        sum(c.isspace() for c in span),
        sum(c in "-‐‑‒–" for c in span),
        span.count("."),
        span.count("(") + span.count("["),
        span.count("/"),
        span[:2].count("+"),
        bool(digits) and luhn(digits),
        int(digits[:1] or -1),
        sum(len(g) <= 3 and int(g[-4:]) <= 255 for g in groups),
        sum(len(g) > 1 and g[0] == "0" for g in groups),
        hints[kind],
        any(h for k, h in enumerate(hints) if k != kind),
        any(o in before for o in OTHERS),
        "@" in span,
        any(x in low for x in ("(at", "[at", "{at", "<at")),
        any(x in low for x in ("(dot", "[dot", "{dot", "<dot", " dot ", "[.", "(.")),
        len(labels),
        len(labels[-1].strip()) if labels else 0,
        len(local.strip()),
        sum(c in "._%+-0123456789" for c in local),
        left.isalpha() + right.isalpha(),
        left.isdigit() + right.isdigit(),
        (left in tuple("-/._@=#+")) + (right in tuple("-/_@=%") or after[:1] in (".", ",") and after[1:2].isdigit()),
        bool(_NUMBER_BEFORE.search(before)),
        bool(_NUMBER_AFTER.match(text, end)),
        left in ('"', "'") or right in ('"', "'"),
        any(c in before[-4:] + after for c in "$€£%"),
        bool(year),
    ]


# --- boosted trees --------------------------------------------------------------------------------


def _node(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Where rows are after so many levels: a node sends a row right if its feature is above the node's cut."""
    rows, node = np.arange(len(x)), np.zeros(len(x), np.int64)
    for level in range(levels):
        at = node + 2**level - 1
        node = 2 * node + (x[rows, feature[at]] > cut[at])
    return node


class Trees:
    """Boosted trees with the same number of nodes on every path; ``score`` is the log odds.

    ``feature`` and ``cut`` are by tree and node (a cut of infinity sends all rows left), ``leaf`` by tree and leaf.
    """

    def __init__(self, start: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.start, self.feature, self.cut, self.leaf = start, feature, cut, leaf

    def score(self, x: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """From ``before`` on, the scores of the trees that came before these."""
        found = np.full(len(x), self.start) if before is None else np.array(before, np.float64)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            found += leaf[_node(x, feature, cut, leaf.shape[-1].bit_length() - 1)]
        return found


class Model:
    """Trees, and the threshold of each kind (infinite where nothing may be added)."""

    def __init__(self, trees: Trees, thresholds: list[float]):
        self.trees, self.thresholds = trees, thresholds


def _bins(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, len(FEATURES))


def _over(rows: DataFrame | pa.Table, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> pa.Table:
    """What ``run`` makes of the batches: in the tasks of a table of Spark, or of few rows right here."""
    if isinstance(rows, DataFrame):
        return rows.mapInArrow(run, schema).toArrow()
    return pa.Table.from_batches(run(iter(rows.to_batches(10_000))))


def _sums(rows: DataFrame | pa.Table, trees: Trees, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and weights by node of this level of the last tree, feature and bin; the trees before it are finished."""
    finished = Trees(trees.start, trees.feature[:-1], trees.cut[:-1], trees.leaf[:-1])
    shape = (2**level, len(FEATURES), BINS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, h = np.zeros(shape).ravel(), np.zeros(shape).ravel()
        for batch in batches:
            x = _bins(batch["x"])
            good, bad, before = (batch[c].to_numpy(zero_copy_only=False) for c in ("good", "bad", "score"))
            p = 1 / (1 + np.exp(-finished.score(x, before)))
            node = _node(x, trees.feature[-1], trees.cut[-1], level)
            cell = (node[:, None] * shape[1] + np.arange(shape[1])) * BINS + x
            for to, value in ((g, good * (1 - p) - bad * p), (h, (good + bad) * p * (1 - p))):
                to += np.bincount(cell.ravel(), np.repeat(np.rint(value * UNITS), shape[1]), len(to))
        yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()]) for v in (g, h)], ["g", "h"])

    # each a sum of whole numbers, and so the same in any order
    found = _over(rows, run, "g binary, h binary")
    return tuple(sum(np.frombuffer(v.as_py()) for v in found[c]).reshape(shape) / UNITS for c in ("g", "h"))


def _scored(rows: DataFrame | pa.Table, trees: Trees, folder: str) -> DataFrame | pa.Table:
    """``rows`` with the scores of these trees added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(trees.score(_bins(batch["x"]), batch["score"].to_numpy(zero_copy_only=False)))
            yield batch.set_column(batch.schema.get_field_index("score"), "score", score)

    if isinstance(rows, DataFrame):
        return written(rows.mapInArrow(run, rows.schema), f"scored_{uuid.uuid4().hex}", folder)
    return _over(rows, run, "")


def _boosted(rows: DataFrame, start: float, folder: str) -> Trees:
    """Trees on bins over ``rows`` (``x, good, bad, score``): distinct examples, how many are good and bad, the score so far.

    Rows that one task would do come to the driver, which makes the same sums without a job for each level.
    """
    tasks = -(-rows.count() // ROWS_PER_TASK)
    rows = rows.coalesce(tasks) if tasks > 1 else rows.toArrow()
    feature, cut = np.zeros((ROUNDS, 2**DEPTH - 1), np.int64), np.full((ROUNDS, 2**DEPTH - 1), np.inf)
    leaf, done = np.zeros((ROUNDS, 2**DEPTH)), 0
    for r in range(ROUNDS):
        if r - done == TREES_KEPT:
            trees = Trees(start, feature[done:r], cut[done:r], leaf[done:r])
            rows, done = _scored(rows, trees, folder), r
        for level in range(DEPTH):
            now = slice(done, r + 1)
            g, h = _sums(rows, Trees(start, feature[now], cut[now], leaf[now]), level)
            all_g, all_h = g.sum(2, keepdims=True), h.sum(2, keepdims=True)
            left_g, left_h = g.cumsum(2), h.cumsum(2)
            gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
            for n in range(2**level):
                f, at = np.unravel_index(gain[n].argmax(), gain[n].shape)
                split = gain[n, f, at] > 1e-9
                if split:
                    feature[r, 2**level - 1 + n], cut[r, 2**level - 1 + n] = f, at
                if level == DEPTH - 1:
                    sides = [(left_g[n, f, at], left_h[n, f, at])] if split else [(all_g[n, 0, 0], all_h[n, 0, 0])]
                    sides.append((all_g[n, f, 0] - sides[0][0], all_h[n, f, 0] - sides[0][1]))
                    leaf[r, 2 * n : 2 * n + 2] = [RATE * a / (b + 1) for a, b in sides]
    return Trees(start, feature, cut, leaf)


def _threshold(score: np.ndarray, good: np.ndarray, bad: np.ndarray, precision: float) -> float:
    """The smallest score from which on at least ``precision`` are good; no kind starts with fewer than 10 good ones."""
    order = np.argsort(-score, kind="stable")
    n_good, n = np.cumsum(good[order]), np.cumsum((good + bad)[order])
    fits = np.flatnonzero(n_good >= precision * n)
    return float(score[order][fits[-1]]) if len(fits) and n_good[fits[-1]] >= 10 else float("inf")


def _luhn_digit(digits: str) -> str:
    return next(d for d in "0123456789" if luhn(digits + d))


def _rewritten(kind: int, span: str, rng: np.random.Generator) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
    """Good spans in other forms, and bad ones, that could stand where this base span stands."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    number = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    digits, good, bad = _digits(span), [], []
    if kind == 0:
        local, _, domain = span.partition("@")
        at, dot = pick((" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), ("(at)", "."), (" at ", "."))
        word = re.sub("[^a-z]", "", local.lower()) or "noon"
        local = pick(local, word, f"{word}.{word[::-1]}", f"{word[:1]}{word}{number(2)}")
        domain = pick(domain, f"{word}.{pick('com', 'org', 'net', 'de', 'fr', 'es', 'co.uk')}")
        good.append((0, local + at + domain.replace(".", dot)))
        bad += [(0, f"{word}@{number(2)}.{number(2)}"), (0, f"{word} at {number(1)}.{number(2)}"), (0, f"{word} at the.{word}")]
        bad.append((0, f"{word}@{word}..{word}"))
    elif kind == 1:
        good.append((1, span.replace(".", pick("[.]", "(.)", " . ", " dot ", ". "))))
        bad += [(1, pick(",", ":", ", ").join(str(x) for x in rng.integers(0, 256, 4)))]
        bad += [(1, ".".join(str(x) for x in (*rng.integers(0, 256, 3), rng.integers(256, 999))))]
    elif kind == 2:
        four = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        good += [(2, pick(" ", "-", ".", "/", " ", "  ").join(four))]
        other = str((int(digits[-1]) + int(rng.integers(1, 10))) % 10)
        bad += [(2, digits[:-1] + other), (2, pick(" ", "-").join([*four[:-1], four[-1][:-1] + other])), (3, digits[:11])]
        fresh = pick("4", "5", "37", "6011") + number(11)
        good.append((2, fresh + _luhn_digit(fresh)))
    else:
        d = digits[-10:]
        good += [(3, pick("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}", "1-{}-{}-{}", "001 {} {} {}").format(d[:3], d[3:6], d[6:]))]
        good += [(3, "+" + pick(" ", ".", "/").join([digits[:-7] or "1", digits[-7:-4], digits[-4:]]))]
        day, month, year = (f"{int(x):02d}" for x in (rng.integers(1, 29), rng.integers(1, 13), rng.integers(1950, 2050)))
        bad += [(3, pick(f"{year}-{month}-{day}", f"{day}.{month}.{year}", f"{day}/{month}/{year}", f"{year}{month}{day}"))]
        isbn = f"978-{number(1)}-{number(2)}-{number(6)}-{number(1)}"
        bad += [(3, isbn), (3, isbn[:-2]), (3, isbn[4:]), (3, number(8)), (3, number(10)), (3, number(13)), (3, f"{number(3)}.{number(3)}.{number(3)}"), (3, f"{year}-{int(year) + 7}")]
        bad += [(3, f"{number(3)} {number(4)} {number(2)}"), (3, f"1.{number(1)}.{number(5)}")]
    return good, bad


def examples(text: str, seed: int = 11) -> Iterator[tuple[list[float], int, bool]]:
    """Features, kind and label of every example that a text gives."""
    base = base_spans(text)
    known, starts, ends = set(base), [a for a, _, _ in base], np.maximum.accumulate([0] + [b for _, _, b in base]).tolist()
    for a, k, b in sorted(candidates(text)):
        if (a, k, b) in known:
            yield features(text, a, k, b), k, True
        elif ends[bisect.bisect_left(starts, b)] > a or k == 2 and not luhn(_digits(text[a:b])):
            yield features(text, a, k, b), k, False
        elif k and (text[a - 1 : a].isalnum() and a or text[b : b + 1].isalnum()):
            yield features(text, a, k, b), k, False
    rng = np.random.default_rng([seed, zlib.crc32(text.encode())]) if base else None
    for a, k, b in base:
        good, bad = _rewritten(k, text[a:b], rng)
        lead = ("", "", "", HINTS[k][int(rng.integers(len(HINTS[k])))] + pick_mark(rng))[int(rng.integers(4))]
        wrong = ("", "", OTHERS[int(rng.integers(len(OTHERS)))] + pick_mark(rng))[int(rng.integers(3))]
        for (kind, span), is_good in [(x, True) for x in good] + [(x, False) for x in bad]:
            before = text[max(0, a - _NEAR) : a] + (lead if is_good else wrong)
            whole, end = before + span + text[b : b + _NEAR], len(before) + len(span)
            yield features(whole, len(before), kind, end), kind, is_good
            if is_good and " " in span.strip() and kind >= 2:
                # without its first or its last part
                yield features(whole, len(before) + span.index(" ") + 1, kind, end), kind, False
                yield features(whole, len(before), kind, len(before) + span.rindex(" ")), kind, False


def pick_mark(rng: np.random.Generator) -> str:
    return (" ", ": ", " is ")[int(rng.integers(3))]


def _all_examples(docs: DataFrame, text: str) -> DataFrame:
    """``x`` (features as int32), ``kind, good, held, n``: the examples of all texts; equal ones of a batch are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: Counter = Counter()

        def told() -> pa.RecordBatch:
            columns = [*zip(*some), list(some.values())]
            types = (pa.binary(), pa.int8(), pa.bool_(), pa.bool_(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["x", "kind", "good", "held", "n"])

        for batch in batches:
            for own, held in zip(batch["text"], batch["held"].to_pylist()):
                for x, kind, good in examples(own.as_py()):
                    some[np.array(x, np.int32).tobytes(), kind, bool(good), held] += 1
                    if len(some) >= EXAMPLES_AT_ONCE:
                        yield told()
                        some.clear()
        if some:
            yield told()

    # a text without digits and at signs has no base span and no candidate that is known to be bad
    able = docs.select(F.col(text).alias("text")).filter(F.col("text").rlike("[0-9@]"))
    able = able.withColumn("held", F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(5)) == 4)
    return able.mapInArrow(run, "x binary, kind tinyint, good boolean, held boolean, n long")


def _values(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, len(FEATURES))


def _cuts(found: DataFrame) -> list[np.ndarray]:
    """Cuts of each feature: all its values (but the largest) if they fit the bins, else its quantiles.

    What comes to the driver is how often each value of a feature occurs. Features are numbers of characters and parts, so texts of
    ``n`` characters have some ``sqrt(2 * n)`` values of one at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, n = _values(batch["x"]), batch["n"].to_numpy()
            for f in range(x.shape[1]):
                value, at = np.unique(x[:, f], return_inverse=True)
                counted = np.bincount(at, n, len(value)).astype(np.int64)
                columns = [np.full(len(value), f, np.int32), value, counted]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["feature", "value", "n"])

    counts = found.select("x", "n").mapInArrow(run, "feature int, value int, n long")
    rows = counts.groupBy("feature", "value").agg(F.sum("n").alias("n")).collect()
    table = np.array(sorted((r["feature"], r["value"], r["n"]) for r in rows), np.int64).reshape(-1, 3)
    cuts = []
    for f in range(len(FEATURES)):
        value, n = table[table[:, 0] == f][:, 1], np.cumsum(table[table[:, 0] == f][:, 2])
        if len(value) > BINS:
            value = np.unique(value[np.searchsorted(n, np.arange(1, BINS) * n[-1] / BINS)])
        else:
            value = value[:-1]
        cuts.append(value.astype(np.float64))
    return cuts


def _binned(found: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """``x`` (bins as bytes), ``kind, held, good, bad``: distinct examples and how many there are of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _values(batch["x"])
            cells = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1).astype(np.uint8)
            yield batch.set_column(0, "x", pa.array([row.tobytes() for row in cells], pa.binary()))

    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    rows = found.select("x", "kind", "good", "held", "n")
    rows = rows.mapInArrow(run, rows.schema).groupBy("x", "kind", "held")
    return rows.agg(count(F.col("good")).alias("good"), count(~F.col("good")).alias("bad"))


def _calibrated(rows: DataFrame, trees: Trees, precision: float) -> list[float]:
    """The threshold of each kind by ``rows`` (``x, kind, good, bad``), which no tree has seen; scores are counted by steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.clip(trees.score(_bins(batch["x"])), -MOST, MOST)
            step = pa.array(np.floor(score * STEPS).astype(np.int32))
            yield pa.RecordBatch.from_arrays([step, *(batch[c] for c in ("kind", "good", "bad"))], ["step", "kind", "good", "bad"])

    steps = rows.select("x", "kind", "good", "bad").mapInArrow(run, "step int, kind tinyint, good long, bad long")
    found = steps.groupBy("kind", "step").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect()
    of_kind = ([r for r in found if r["kind"] == k] for k in range(len(KINDS)))
    columns = ([np.array([r[c] for r in some], np.float64) for c in ("step", "good", "bad")] for some in of_kind)
    return [_threshold(step / STEPS, good, bad, precision) for step, good, bad in columns]


def learn(docs: DataFrame, precision: float = PRECISION, text: str = "text") -> Model | None:
    """The model of all texts; None where they hold too few examples."""
    with staging(docs.sparkSession) as folder:
        found = written(_all_examples(docs, text), "examples", folder)
        seen = found.filter(~F.col("held"))
        counts = {(r["held"], r["good"]): r["n"] for r in found.groupBy("held", "good").agg(F.sum("n").alias("n")).collect()}
        good, bad = counts.get((False, True), 0), counts.get((False, False), 0)
        if min(good, bad) < 20 or not any(held for held, _ in counts):
            return None
        cuts, start = _cuts(seen), float(np.log(good / bad))
        rows = written(_binned(found, cuts), "binned", folder)
        trees = _boosted(rows.filter(~F.col("held")).select("x", "good", "bad", F.lit(start).alias("score")), start, folder)
        thresholds = _calibrated(rows.filter("held"), trees, precision)
    # from bins to the values that they end with
    cut = np.array([[cuts[f][int(c)] if c < len(cuts[f]) else np.inf for f, c in zip(*tree)] for tree in zip(trees.feature, trees.cut)])
    return Model(Trees(start, trees.feature, cut, trees.leaf), thresholds)


def added(text: str, base: list[tuple[int, int, int]], model: Model | None) -> list[tuple[int, int, int]]:
    """Chosen candidates that overlap neither a base span nor a better one."""
    if model is None:
        return []
    found = sorted(candidates(text) - set(base))
    if not found:
        return []
    taken = sorted((a, b) for a, _, b in base)
    score = np.concatenate([model.trees.score(np.array([features(text, *c) for c in found[at : at + 4096]], np.float64)) for at in range(0, len(found), 4096)])
    over = score >= np.array(model.thresholds)[[k for _, k, _ in found]]
    out: list[tuple[int, int, int]] = []
    starts = [a for a, _ in taken]
    for i in np.lexsort((np.arange(len(found)), -score)).tolist():
        a, k, b = found[i]
        if not over[i]:
            continue
        at = bisect.bisect_left(starts, b)
        # base spans of different kinds may overlap each other, so a few before are looked at
        if any(e > a for _, e in taken[max(0, at - 4) : at]):
            continue
        out.append((a, k, b))
        at = bisect.bisect_left(starts, a)
        starts.insert(at, a)
        taken.insert(at, (a, b))
    return out


SPANS = "base array<struct<start:int,kind:string,end:int>>, added array<struct<start:int,kind:string,end:int>>"


def find(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, base, added`` of every row: spans in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                base, more = [], []
                for i in range(batch.num_rows):
                    own = batch.column(1)[i].as_py() or ""
                    strict = base_spans(own)
                    base.append([(a, KINDS[k], b) for a, k, b in strict])
                    more.append([(a, KINDS[k], b) for a, k, b in sorted(added(own, strict, model))])
                columns = [pa.array([[dict(zip(("start", "kind", "end"), s)) for s in x] for x in c], kind) for c in (base, more)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "base", "added"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {SPANS}")


def redact(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows with ``text`` where each span is its kind in brackets; overlapping spans are one, of the first's kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                own = batch.column(0)[i].as_py()
                if own:
                    strict = base_spans(own)
                    parts, at = [], 0
                    for a, k, b in sorted(strict + added(own, strict, model)):
                        if a >= at:
                            parts += [own[at:a], f"[{KINDS[k]}]"]
                        at = max(at, b)
                    own = "".join(parts) + own[at:]
                out.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column(1)], ["text", "row"])

    others = [F.col(c) for c in docs.columns if c != text]
    rows = docs.select(F.col(text).alias("text"), (F.struct(*others) if others else F.lit(0)).alias("row"))
    told_back = rows.mapInArrow(run, rows.schema)
    columns = [F.col("text").alias(text) if c == text else F.col("row")[c].alias(c) for c in docs.columns]
    return told_back.select(*columns)


def digests(found: DataFrame) -> DataFrame:
    """Counts by kind and the digest of the base spans, and all spans as a string."""
    name = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    place = F.array(*[F.lit(k) for k in KINDS])
    ordered = lambda c: F.transform(
        F.array_sort(F.transform(c, lambda s: F.struct(s["start"], F.array_position(place, s["kind"]).alias("nth"), s["end"], s["kind"]))),
        name,
    )
    of_kind = lambda k: F.filter("base", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(F.array_join(ordered(F.col("base")), ","), 256).alias("base_sha256"),
        F.array_join(ordered(F.concat("base", "added")), ",").alias("spans"),
    )

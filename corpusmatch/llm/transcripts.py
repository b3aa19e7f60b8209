"""Roles of a plain transcript, recovered by a hidden Markov model, and its canonical form.

A transcript is a text in which turns follow each other line by line; some turns begin with a speaker marker
("User:", "### Assistant", "Q."), others with nothing but a new paragraph. Each line is an observation: the role that a marker at its
start names (or none, or one that names nobody known), whether an empty line comes before it, whether its end closes a sentence, and
the size class of the paragraph. A state is a role at the first line of a turn, or a role within one. Start, transition and emission
probabilities are counted, with a constant added, over transcripts whose turns are known; counting is a sum in
Spark and its result a table of fixed size. Viterbi gives the most probable states of a new transcript; lines of
one turn are joined, markers taken off, and turns written as ``<|role|>`` line, text and ``<|end|>`` line.

A turn of any role but system, user and assistant (tool, function, unknown, null) is a turn of the role ``other``.

A marker outweighs the rest by far but does not decide alone: a known word before a colon in the middle of a
turn stays text where the model finds that likelier.

Nulls and empty texts give no turns. A line of any length is one observation; a text of any number of lines
takes memory in proportion to it. Repeated rows come back as often. Empty tables give an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

ROLES = ("system", "user", "assistant", "other")
# Names that speakers go by.
NAMES = {
    "system": "system", "instructions": "system", "context": "system",
    "user": "user", "human": "user", "q": "user", "question": "user", "customer": "user", "me": "user", "prompt": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "a": "assistant", "answer": "assistant",
    "agent": "assistant", "model": "assistant", "gpt": "assistant", "response": "assistant",
    "tool": "other", "function": "other",
}
_MARKER = re.compile(
    r"\s*(?:#{1,6}\s*|[*_]{1,2}|\[|<\|?|>\s*)?(" + "|".join(sorted(NAMES, key=len, reverse=True)) + r")"
    r"(?:[*_]{1,2}\s*[:.)]|\]\s*:?|\|?>|\s*[:.)]|\s*[-–—](?=\s))(?:[*_]{1,2})?[ \t]*",
    re.I,
)
_HEADING = re.compile(r"\s*#{1,6}\s*(" + "|".join(sorted(NAMES, key=len, reverse=True)) + r")\s*$", re.I)

STATES = tuple((role, first) for first in (True, False) for role in ROLES)
_N = len(STATES)
# marker (none or a role) x empty line before x sentence closed x size class
_MARKERS, _SIZES = 1 + len(ROLES), 4
OBSERVATIONS = _MARKERS * 2 * 2 * _SIZES


def marker(line: str) -> tuple[str | None, int]:
    """The role that the start of a line names, and where the text after it starts."""
    found = _MARKER.match(line) or _HEADING.match(line)
    return (NAMES[found[1].lower()], found.end()) if found else (None, 0)


def observe(lines: list[str]) -> tuple[list[int], list[int], list[int]]:
    """Numbers of the lines that are not empty, what each shows, and where its text starts."""
    at, shown, starts, gap = [], [], [], False
    for i, line in enumerate(lines):
        if not line.strip():
            gap = True
            continue
        role, start = marker(line)
        n = len(line)
        size = 0 if n < 40 else 1 if n < 120 else 2 if n < 300 else 3
        named = 0 if role is None else 1 + ROLES.index(role)
        closed = line.rstrip()[-1] in ".!?:;…\"')]}"
        at.append(i)
        shown.append(((named * 2 + gap) * 2 + closed) * _SIZES + size)
        starts.append(start)
        gap = False
    return at, shown, starts


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    show: np.ndarray

    @staticmethod
    def of(counts: dict[tuple[str, int, int], int], added: float = 0.5) -> Model:
        start, move, show = np.full(_N, added), np.full((_N, _N), added), np.full((_N, OBSERVATIONS), added)
        for (kind, a, b), n in counts.items():
            if kind == "start":
                start[a] += n
            elif kind == "move":
                move[a, b] += n
            else:
                show[a, b] += n
        # a text starts with a first line, and a turn goes on in its own role only
        for s, (role, first) in enumerate(STATES):
            if not first:
                start[s] = 0
            for t, (other, begins) in enumerate(STATES):
                if not begins and other != role:
                    move[s, t] = 0
        with np.errstate(divide="ignore"):
            return Model(
                np.log(start / start.sum()),
                np.log(move / move.sum(axis=1, keepdims=True)),
                np.log(show / show.sum(axis=1, keepdims=True)),
            )

    def viterbi(self, shown: list[int]) -> list[int]:
        score, back = self.start + self.show[:, shown[0]], []
        for x in shown[1:]:
            ways = score[:, None] + self.move
            best = ways.argmax(axis=0)
            back.append(best.astype(np.uint8))
            score = ways[best, np.arange(_N)] + self.show[:, x]
        state = int(score.argmax())
        path = [state]
        for best in reversed(back):
            state = int(best[state])
            path.append(state)
        return path[::-1]


def turns(text: str | None, model: Model) -> list[tuple[str, str]]:
    """Role and text of each turn."""
    lines = (text or "").split("\n")
    at, shown, starts = observe(lines)
    out: list[tuple[str, list[str]]] = []
    if not at:
        return []
    for k, state in enumerate(model.viterbi(shown)):
        role, first = STATES[state]
        i = at[k]
        if first:
            named = marker(lines[i])[0]
            out.append((role, [lines[i][starts[k] :] if named == role else lines[i]]))
        else:
            # empty lines within a turn stay
            out[-1][1].extend(lines[at[k - 1] + 1 : i + 1])
    return [(role, "\n".join(part).strip()) for role, part in out]


def render(found: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in found)


def learn(known: DataFrame, turns_column: str = "turns", text: str = "text") -> Model:
    """Count over transcripts with known turns: ``text`` and an array of ``role, lines`` (how many lines it has)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int, int], int] = {}

        def add(*what):
            counts[what] = counts.get(what, 0) + 1

        for batch in batches:
            for text, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                truth = [
                    (p["role"], i == 0) for p in parts or () if p["role"] in ROLES for i in range(p["lines"] or 0)
                ]
                lines = (text or "").split("\n")
                if len(truth) != len(lines):
                    continue
                last, begins = None, False
                at, shown, _ = observe(lines)
                seen = dict(zip(at, shown))
                for i, (role, first) in enumerate(truth):
                    # an empty first line hands its turn on to the next
                    begins = begins or first
                    if i not in seen:
                        continue
                    state = STATES.index((role, begins))
                    add("show", state, seen[i])
                    add("start", state, 0) if last is None else add("move", last, state)
                    last, begins = state, False
        columns = list(zip(*[(*k, n) for k, n in counts.items()])) or [(), (), (), ()]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["kind", "a", "b", "n"])

    counted = known.select(text, turns_column).mapInArrow(run, "kind string, a int, b int, n long")
    rows = counted.groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    return Model.of({(r["kind"], r["a"], r["b"]): r["n"] for r in rows})


_TURNS = ArrayType(StructType([StructField("role", StringType()), StructField("text", StringType())]))


def parse(transcripts: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The columns of ``transcripts``, ``turns`` (role, text) and ``rendered``; columns named so are left out."""
    rest = [c for c in transcripts.columns if c not in ("turns", "rendered")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [turns(t, model) for t in batch.column(0).to_pylist()]
            kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            own = pa.array([[{"role": r, "text": t} for r, t in x] for x in found], kind)
            shown = pa.array([render(x) for x in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], own, shown], [*rest, "turns", "rendered"])

    rows = transcripts.select(F.col(text).alias("_text"), *rest)
    return rows.mapInArrow(run, rows.drop("_text").schema.add("turns", _TURNS).add("rendered", "string"))


def transcripts(conversations: DataFrame, block: int = 256) -> DataFrame:
    """Plain transcripts of a table of turns: ``conv_id, block, text, turns``.

    Each conversation writes its markers in one of several styles, and drops some: by its number and the turn's.
    A turn whose role is none of the known ones is one of ``other``. So that no task holds an endless conversation, a
    transcript has the turns of one block of turn numbers.
    """
    conv = F.coalesce(F.col("conv_id").cast("long"), F.lit(0))
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(0))
    given = F.lower(F.trim("role"))
    role = F.when(given.isin(*ROLES), given).otherwise("other")

    def styled(*marks: str) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for pair in zip(ROLES, marks) for x in pair]), role)

    style = F.pmod(conv, F.lit(4))
    mark = (
        F.when(style == 0, styled("System: ", "User: ", "Assistant: ", "Tool: "))
        .when(style == 1, styled("### Instructions\n", "### Human\n", "### Assistant\n", "### Tool\n"))
        .when(style == 2, styled("[system] ", "Q: ", "A: ", "[tool] "))
        .otherwise(styled("**Context:** ", "**Customer:** ", "**Agent:** ", "**Function:** "))
    )
    # a marker is left out now and then, and an empty line parts the turns instead
    drops = F.pmod(F.xxhash64(conv, turn), F.lit(6)) == 0
    told = F.concat(
        F.when(drops, "\n").otherwise(mark), F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n")
    )
    rows = conversations.select(
        "conv_id",
        F.floor(turn / block).alias("block"),
        F.struct(turn.alias("turn"), told.alias("text"), role.alias("role")).alias("t"),
    )
    grouped = rows.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return grouped.select(
        "conv_id",
        "block",
        F.array_join(F.transform("t", lambda t: t["text"]), "\n").alias("text"),
        F.transform(
            "t", lambda t: F.struct(t["role"].alias("role"), F.size(F.split(t["text"], "\n")).alias("lines"))
        ).alias("known"),
    )

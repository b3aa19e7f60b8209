"""Near copies by 64-bit SimHash: pigeonring filter, Hamming check, connected components.

A fingerprint is a ring of five boxes of 13, 13, 13, 13 and 12 bits. Where two fingerprints differ in at most
four bits, some box starts a chain in which every first l boxes differ in at most ``4 * l / 5`` bits together:
none in the first, one in the first two, two in three, three in four. The boxes after the first of a chain of l differ in
l - 1 bits at most, so if they are cut into m parts, m - l + 1 of these are equal. A fingerprint is therefore dealt out by
each box together with every choice of so many parts: either half of the next box (keys of 20 bits), or for many
fingerprints two of four parts of the next two boxes (26 bits) or three of six of the next three (32 bits), so that few
others share a key at any size. Pairs that meet must keep the budgets of the chain before all 64 bits are compared.

Nulls and texts without words have fingerprint zero and are linked like any other. A row with a null id takes
part in nothing but keeps its fingerprint; its component is that of its fingerprint. Repeated rows come back
as often as they are there. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from corpusmatch.llm.components import components
from corpusmatch.operators.skew import spread_join
from corpusmatch.operators.storage import written

BOXES = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
# A group that shares a key is cut into blocks of about so many fingerprints; each two blocks meet in one place.
BLOCK = 1024
# Rows of one fingerprint that a task may keep.
HOT_FP_ROWS = 1000


def fingerprint(text: bytes, words: int = 4) -> int:
    parts = text.lower().split()
    if not parts:
        return 0
    joined, n = b" ".join(parts), len(parts)
    if n <= words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[: n - words] + 1)).tolist()
        digest = xxhash.xxh64_intdigest
        spans = zip(starts, ends[words - 1 :].tolist())
        hashes = np.array([digest(joined[a:b], 42) for a, b in spans], np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: Column | None = None) -> DataFrame:
    """``doc_id, fp`` (the bits as a long) and ``digest`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            found = [fingerprint(texts[i].as_py() or b"") for i in range(len(texts))]
            fps = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fps, batch.column(2)], ["doc_id", "fp", "digest"])

    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.col(text).cast("binary").alias("text"),
        (F.lit(None).cast("string") if digest is None else digest).alias("digest"),
    )
    return rows.mapInArrow(run, "doc_id long, fp long, digest string")


def _mask(i: int, first: int = 0, width: int | None = None) -> int:
    at, bits = BOXES[i % 5]
    width = bits if width is None else width
    return ((1 << width) - 1) << (at + first)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


# Chain length and parts, up to so many fingerprints.
WIDTHS = ((2, 2, 1 << 26), (3, 4, 1 << 32), (4, 6, 1 << 62))


def key_masks(boxes: int, parts: int) -> list[int]:
    """Masks of the keys of chains of ``boxes``: as many for each first box, one after the other."""
    masks = []
    for i in range(5):
        bits = [BOXES[(i + j) % 5][0] + b for j in range(1, boxes) for b in range(BOXES[(i + j) % 5][1])]
        cuts = [len(bits) * p // parts for p in range(parts + 1)]
        pieces = [sum(1 << b for b in bits[x:y]) for x, y in zip(cuts, cuts[1:])]
        masks += [_mask(i) | sum(some) for some in itertools.combinations(pieces, parts - boxes + 1)]
    return masks


_CHAINS = [[sum(_mask(i + j) for j in range(n)) for n in (2, 3, 4, 5)] for i in range(5)]


def _links(boxes: np.ndarray, x: np.ndarray, distance: int) -> np.ndarray:
    """Which differences keep the budget of the chain that starts at their box, and the whole distance."""
    chains = np.array(_CHAINS, np.uint64)[boxes]
    good = np.bitwise_count(x) <= distance
    for n in range(4):
        good &= np.bitwise_count(x & chains[:, n]) <= distance * (n + 2) // 5
    return good


def _joined(box: int, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that hold together what is linked within one group: one less than its members at most."""
    n, left = len(fps), np.arange(len(fps))
    a, b = [], []
    while len(left):
        root, reached, front = left[0], np.zeros(n, bool), left[:1]
        reached[root] = True
        while len(front):
            near = np.zeros(n, bool)
            for at in range(0, len(front), 256):
                x = fps[front[at : at + 256], None] ^ fps[None, :]
                near |= _links(np.full(x.size, box), x.ravel(), distance).reshape(x.shape).any(axis=0)
            front = np.flatnonzero(near & ~reached)
            reached[front] = True
        members = np.flatnonzero(reached)
        a.append(np.full(len(members) - 1, fps[root]))
        b.append(fps[members[members != root]])
        left = left[~reached[left]]
    return np.concatenate(a), np.concatenate(b)


def _group_links(boxes, starts, sizes, fps, distance):
    a, b = [], []
    # small groups: all their pairs at once, by distance within the sorted rows
    small = np.repeat(sizes <= 16, sizes)
    group = np.repeat(np.arange(len(starts)), sizes)
    for shift in range(1, int(min(16, sizes.max(initial=0)))):
        same = np.flatnonzero((group[shift:] == group[:-shift]) & small[shift:])
        good = same[_links(boxes[same], fps[same] ^ fps[same + shift], distance)]
        a.append(fps[good])
        b.append(fps[good + shift])
    for g in np.flatnonzero(sizes > 16):
        some = slice(starts[g], starts[g] + sizes[g])
        more = _joined(int(boxes[starts[g]]), fps[some], distance)
        a.append(more[0])
        b.append(more[1])
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)


def links(fps: DataFrame, distance: int = 4, block: int = BLOCK, width: tuple[int, int] | None = None) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints ``fp`` that hold every linked set together.

    Groups of up to 16 give all their links; a larger one gives a tree of each set that it links. ``width`` (chain length
    and parts) is chosen by the number of fingerprints. ``distance`` is 4 at most.
    """
    if width is None:
        n = fps.count()
        width = next((boxes, parts) for boxes, parts, most in WIDTHS if n <= most)
    masks = key_masks(*width)
    per_box = len(masks) // 5
    keys = F.array(
        *[
            F.struct(F.lit(i).alias("kind"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value"))
            for i, m in enumerate(masks)
        ]
    )
    dealt = fps.select("fp", F.inline(keys))
    large = dealt.groupBy("kind", "value").count().filter(F.col("count") > block)
    large = large.select("kind", "value", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64(F.lit(7), "fp"), F.col("blocks")).cast("int")
    meets = F.when(
        F.col("blocks").isNotNull(),
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(own, o), F.greatest(own, o))),
    ).otherwise(F.array(F.struct(F.lit(0), F.lit(0))))
    grouped = (
        dealt.join(large, ["kind", "value"], "left")
        .select("kind", "value", "fp", F.explode(meets).alias("meet"))
        .select(F.col("kind"), F.xxhash64("kind", "value", "meet").alias("grp"), "fp")
        .repartition("grp", "kind")
        .sortWithinPartitions("grp", "kind")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(kind, group, fp):
            new = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (kind[1:] != kind[:-1]))))
            sizes = np.diff(np.append(new, len(fp)))
            found = _group_links(kind // per_box, new, sizes, fp, distance)
            return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

        rest = None
        for batch in batches:
            now = [np.asarray(batch.column(i)) for i in range(3)]
            now[2] = now[2].view(np.uint64)
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now)]
            if not len(now[0]):
                continue
            # the last group may go on in the next batch
            same = (now[1] == now[1][-1]) & (now[0] == now[0][-1])
            cut = len(same) - int(same.sum())
            rest = [x[cut:] for x in now]
            if cut:
                yield linked(*[x[:cut] for x in now])
        if rest is not None and len(rest[0]):
            yield linked(*rest)

    return grouped.mapInArrow(run, "a long, b long").distinct()


def _components(rows: DataFrame, distance: int) -> DataFrame:
    """``fp, component`` (one of its fingerprints), ``component_id`` of every distinct fingerprint of ``rows``."""
    firsts = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = components(links(firsts, distance))
    named = found.join(firsts.withColumnRenamed("fp", "id"), "id")
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    joined = named.join(smallest, "component").select(F.col("id").alias("fp"), "component", "component_id")
    per_fp = firsts.join(joined, "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("component"), F.coalesce("component_id", "first").alias("component_id")
    )
    return written(per_fp, "components")


def near_duplicates(docs: DataFrame, distance: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row; documents of one text or linked ones share a component."""
    rows = written(fingerprints(docs, key, text), "fingerprints")
    return spread_join(rows, _components(rows, distance), "fp", "doc_id", hot_rows=HOT_FP_ROWS).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def first_of_each(docs: DataFrame, distance: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, as it is: that of the smallest id, and among rows of one id that of the least digest.

    The digest is of the whole row, so what stays does not change from run to run; of rows that are the same in
    every column one stays. Rows without an id all stay.
    """
    columns, digest = docs.columns, F.sha2(F.to_json(F.struct(*[F.col(c) for c in docs.columns])), 256)
    rows = written(fingerprints(docs, key, text, digest).filter("doc_id IS NOT NULL"), "fingerprints")
    named = spread_join(rows, _components(rows, distance), "fp", "doc_id", hot_rows=HOT_FP_ROWS)
    first = named.groupBy("component").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    first = written(first.select(F.col("first.doc_id").alias("id"), F.col("first.digest").alias("digest")), "first")
    marked = docs.select(F.struct(*columns).alias("row"), F.col(key).cast("long").alias("id"), digest.alias("digest"))
    chosen = marked.join(first, ["id", "digest"], "left_semi")
    again = rows.groupBy("doc_id", "digest").count().filter("count > 1").select(F.col("doc_id").alias("id"), "digest")
    again = written(again, "repeated")
    if not again.isEmpty():
        once = chosen.join(again, ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"])
        chosen = chosen.join(again, ["id", "digest"], "left_anti").unionByName(once)
    return chosen.select("row.*").unionByName(docs.filter(F.col(key).isNull()))

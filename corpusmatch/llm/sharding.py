"""Shards of near-equal bytes: sampled splitters, ranges of the key, overfull ranges split again.

Rows are ordered by (key, row number). Keys are drawn with a chance that grows with their size; their
quantiles are the splitters of the ranges. A range that turns out overfull is sampled again on its own and
split. Running sums within the ranges then place each row, so a shard's bytes miss the mean by one row at
most on either side, however good the sample was.

Nulls: a null key comes first; a null or empty text weighs one byte. Repeated rows and keys are told apart
by their place in the input, so one key may hold any share of the rows. An empty table gives an empty result.
Only DataFrame functions work on the rows; the driver sees sampled keys and one row per range.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusmatch.operators.storage import written

_CHANCES = float(1 << 53)


def text_size(text: Column) -> Column:
    """Bytes of the text, and one for the row."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def shard_by_bytes(
    docs: DataFrame,
    key: str,
    size: Column,
    shards: int = 16,
    *,
    keep: dict[str, Column] | None = None,
    ranges_per_shard: int = 16,
    draws_per_range: int = 16,
    rounds: int = 3,
) -> DataFrame:
    """``key``, the columns of ``keep``, ``size``, ``shard`` and ``slot`` (gapless from 0) of every row.

    ``ranges_per_shard`` is what the tasks of the last step are made of: a range is sorted in one task.
    """
    kept = keep or {}
    rows = docs.select(
        F.col(key).alias("_key"),
        F.monotonically_increasing_id().alias("_row"),
        size.cast("long").alias("_size"),
        *[c.alias(name) for name, c in kept.items()],
    )
    rows = written(rows, "rows")
    total = rows.agg(F.sum("_size").alias("bytes")).first()["bytes"] or 0
    place = F.struct(F.col("_key").isNotNull().alias("a"), F.col("_key").alias("b"), F.col("_row").alias("c"))
    rows = rows.withColumn("_place", place)
    kind = rows.schema["_place"].dataType.simpleString()
    aim = shards * ranges_per_shard
    splitters = _quantiles(_drawn(rows, total, aim * draws_per_range, 0), aim)
    ranged, weights = _ranged(rows, splitters, kind), {}
    for turn in range(1, rounds + 1):
        weights = {r["_range"]: (r["bytes"], r["n"]) for r in _totals(ranged).collect()}
        overfull = {r: w for r, (w, n) in weights.items() if w > 2 * total / aim and n > 1}
        if not overfull or turn == rounds:
            break
        within = ranged.filter(F.col("_range").isin([*overfull]))
        parts = {r: -(-w * aim // total) for r, w in overfull.items()}
        again = _drawn(within, sum(overfull.values()), sum(parts.values()) * draws_per_range, turn, "_range")
        for r, n in parts.items():
            splitters += _quantiles([x for x in again if x["_range"] == r], n)
        splitters = sorted(set(splitters), key=_order)
        ranged = _ranged(rows, splitters, kind)
    return _placed(ranged, weights, total, shards, key, list(kept))


def _order(place) -> tuple:
    return (place[0], place[1] if place[0] else 0, place[2])


def _drawn(rows: DataFrame, total: int, draws: int, turn: int, *more: str) -> list:
    """About ``draws`` places; a row's chance is its share of the bytes, and its number decides."""
    chance = F.pmod(F.xxhash64(F.lit(turn), "_row"), F.lit(1 << 53)) / F.lit(_CHANCES)
    return rows.filter(chance < F.lit(draws / max(total, 1)) * F.col("_size")).select("_place", *more).collect()


def _quantiles(drawn: list, parts: int) -> list[tuple]:
    places = sorted({tuple(x["_place"]) for x in drawn}, key=_order)
    return [places[len(places) * i // parts] for i in range(1, parts)] if len(places) >= parts else places


def _ranged(rows: DataFrame, splitters: list[tuple], kind: str) -> DataFrame:
    """The number of splitters up to the row's place, counted in two steps: among every 32nd, then in its run."""
    if not splitters:
        return rows.withColumn("_range", F.lit(0))

    def literal(value, of: str) -> Column:
        return F.from_json(F.lit(json.dumps(value, default=str)), of)

    runs = [[dict(zip("abc", p)) for p in splitters[i : i + 32]] for i in range(0, len(splitters), 32)]
    coarse = F.size(F.filter(literal([r[0] for r in runs], f"array<{kind}>"), lambda p: p <= F.col("_place")))
    fine = F.element_at(literal(runs, f"array<array<{kind}>>"), F.greatest(F.col("_run"), F.lit(1)))
    within = F.size(F.filter(fine, lambda p: p <= F.col("_place")))
    number = F.when(F.col("_run") == 0, 0).otherwise((F.col("_run") - 1) * 32 + within)
    return rows.withColumn("_run", coarse).withColumn("_range", number).drop("_run")


def _longs(values: list[int]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def _totals(ranged: DataFrame) -> DataFrame:
    return ranged.groupBy("_range").agg(F.sum("_size").alias("bytes"), F.count("*").alias("n"))


def _placed(ranged: DataFrame, weights: dict, total: int, shards: int, key: str, kept: list[str]) -> DataFrame:
    bytes_before, rows_before, base = 0, 0, {}
    for r in sorted(weights):
        base[r] = (bytes_before, rows_before)
        bytes_before, rows_before = bytes_before + weights[r][0], rows_before + weights[r][1]
    last = max(weights, default=0)
    at = F.col("_range") + 1
    start_bytes = F.element_at(_longs([base.get(r, (0, 0))[0] for r in range(last + 1)]), at)
    start_rows = F.element_at(_longs([base.get(r, (0, 0))[1] for r in range(last + 1)]), at)
    before = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.col("_size")
    # the shard in which the middle byte of the row lies
    middle = 2 * (start_bytes + F.col("_sum")) - size
    shard = F.least(F.floor(middle * shards / F.lit(2 * max(total, 1))), F.lit(shards - 1)).cast("int")
    placed = (
        ranged.withColumn("_sum", F.sum("_size").over(before))
        .withColumn("_nth", F.count("*").over(before))
        .select(
            F.col("_key").alias(key),
            *kept,
            size.alias("size"),
            shard.alias("shard"),
            (start_rows + F.col("_nth") - 1).alias("_global"),
        )
    )
    placed = written(placed, "placed")
    firsts = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("_global").alias("first")).collect()}
    first = F.element_at(_longs([firsts.get(s, 0) for s in range(shards)]), F.col("shard") + 1)
    return placed.withColumn("slot", F.col("_global") - first).drop("_global")

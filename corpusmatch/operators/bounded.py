"""Hand a catalogue to the tasks in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, functions as F

MAX_BLOCK_BYTES = 64 << 20


def collect_in_blocks(df: DataFrame, row_bytes: Column, max_bytes: int = MAX_BLOCK_BYTES) -> Iterator[list[Row]]:
    """The rows of ``df`` in blocks that weigh at most ``max_bytes`` (or are one single row).

    Rows come to the driver one partition at a time and each is weighed, so that no block, and no
    broadcast made of it, outgrows the bound; a larger catalogue gives more blocks.
    """
    block: list[Row] = []
    held = 0
    for row in df.withColumn("_bytes", F.coalesce(row_bytes, F.lit(0))).toLocalIterator():
        if block and held + row["_bytes"] > max_bytes:
            yield block
            block, held = [], 0
        block.append(row)
        held += row["_bytes"]
    if block:
        yield block

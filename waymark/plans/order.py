"""Places of rows in a global order, found without sending all rows to one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.plans.stage import stage

_IN_PARTITION = (1 << 33) - 1  # monotonically_increasing_id: partition, then row


def numbered(df: DataFrame, order: list[Column | str], name: str = "numbered") -> DataFrame:
    """`df`, stored in order, with `n`: the place of each row, from 0.

    Rows are dealt out by ranges of the order and sorted there. A row's place is its place
    in the partition and the rows of the partitions before, of which the driver gets one
    count each."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    mid = F.monotonically_increasing_id()
    placed = placed.select(
        "*", F.shiftright(mid, 33).cast("int").alias("_range"),
        mid.bitwiseAND(F.lit(_IN_PARTITION)).alias("_at"),
    )
    placed = stage(placed, name)
    counts = dict(map(tuple, placed.groupBy("_range").count().collect()))
    if not counts:
        return placed.select(*df.columns, F.col("_at").alias("n"))
    sizes = [counts.get(i, 0) for i in range(max(counts) + 1)]
    before = F.lit([0, *accumulate(sizes)][: len(sizes)]).cast("array<bigint>")
    place = F.get(before, F.col("_range")) + F.col("_at")
    return placed.select(*df.columns, place.alias("n"))

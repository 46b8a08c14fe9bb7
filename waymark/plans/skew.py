"""Equi-joins that hold when one key has a large share of the rows.

Where counts show that no key can be too much for one task, these are plain joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.plans.stage import measured, stage
from waymark.settings import DEFAULTS

#: Tasks for each `rows_per_task` rows of a join that is dealt out by its rows.
TASKS_PER_SHARE = 4


def heaviest(counts: DataFrame, on: list[str], rows_per_task: int) -> DataFrame | None:
    """Of (key, _rows, ...) the keys with too many rows, with the number `_parts`
    to split each into; None if there are none. They are staged, so that Spark
    knows their size and broadcasts them only where it is small."""
    parts = F.ceil(F.col("_rows") / rows_per_task).cast("bigint").alias("_parts")
    others = [c for c in counts.columns if c not in on and c != "_rows"]
    heavy = counts.where(F.col("_rows") > rows_per_task).select(*on, *others, parts)
    staged = stage(heavy, "hot-keys")
    return staged if measured(staged) else None


def hot_keys(
    many: DataFrame, on: list[str], rows_per_task: int, at_most: int | None = None
) -> DataFrame | None:
    """Keys of `many` with more rows than one task should take. Nothing is read
    if the table has no more rows than that (`at_most`, or as staged). Counts are
    combined before the shuffle."""
    total = measured(many) if at_most is None else at_most
    if total is not None and total <= rows_per_task:
        return None
    counts = many.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    return heaviest(counts, on, rows_per_task)


def tasks_of(df: DataFrame, rows: int, rows_per_task: int) -> int | None:
    """For how many tasks a join of so many rows is; None if it is small."""
    tasks = -(-rows * TASKS_PER_SHARE // rows_per_task)
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(tasks, usual) if tasks > 1 else None


def skew_join(
    many: DataFrame,
    one: DataFrame,
    on: list[str],
    spread: list[str],
    how: str = "inner",
    rows_per_task: int = DEFAULTS.rows_per_task,
    at_most: int | None = None,
) -> DataFrame:
    """Join `many`, in which a key may have any number of rows, with `one`, in
    which it has few. The rows of a hot key are split by a hash of the `spread`
    columns, and only the `one` rows of hot keys are repeated, once per part.
    `how` is `inner` or `left`."""
    hot = hot_keys(many, on, rows_per_task, at_most)
    return salted_join(many, one, on, spread, hot, how)


def salted_join(
    many: DataFrame,
    one: DataFrame,
    on: list[str],
    spread: list[str],
    hot: DataFrame | None,
    how: str = "inner",
    tasks: int | None = None,
) -> DataFrame:
    """`skew_join` with the hot keys of `many` known. Rows of `many` that are narrow, but
    give many or wide ones, are dealt out to a number of `tasks`."""
    if hot is None:
        return (many.repartition(tasks, *on) if tasks else many).join(one, on, how)
    digest = F.xxhash64(*spread)
    part = F.pmod(digest, F.coalesce(F.col("_parts"), F.lit(1)).cast("bigint"))
    if how == "left":
        # Rows without a key match nothing but must be kept: spread them as well.
        absent = F.lit(False)
        for key in on:
            absent = absent | F.col(key).isNull()
        part = F.when(absent, F.pmod(digest, F.lit(1024).cast("bigint"))).otherwise(part)
    salted = many.join(hot, on, "left").withColumn("_part", part).drop("_parts")
    last = F.coalesce(F.col("_parts"), F.lit(1)).cast("bigint") - 1
    repeated = (
        one.join(hot, on, "left")
        .withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        .drop("_parts")
    )
    return salted.join(repeated, on + ["_part"], how).drop("_part")


def work_join(
    asking: DataFrame,
    table: DataFrame,
    on: list[str],
    matches: str,
    asking_spread: list[str],
    table_spread: list[str],
    rows_per_task: int = DEFAULTS.rows_per_task,
) -> DataFrame:
    """Inner join in which a key may have many rows on both sides. `asking` is
    staged with the sum of its column `matches`, the number of `table` rows of the
    key. What counts is the number of rows that a key gives. Of a key that gives
    too many, the side with more rows is split and the other is repeated."""
    total = measured(asking)
    hot = None
    if total is None or total > rows_per_task:
        counts = asking.groupBy(*on).agg(
            F.sum(matches).alias("_rows"),
            (F.count(F.lit(1)) >= F.max(matches)).alias("_split_asking"),
        )
        hot = heaviest(counts, on, rows_per_task)
    asking = asking.drop(matches)
    if hot is None:
        return asking.join(table, on)

    def salted(df: DataFrame, split: Column, spread: list[str]) -> DataFrame:
        parts = F.coalesce(F.col("_parts"), F.lit(1)).cast("bigint")
        own = F.array(F.pmod(F.xxhash64(*spread), parts))
        every = F.sequence(F.lit(0).cast("bigint"), parts - 1)
        part = F.explode(F.when(split, own).otherwise(every))
        return df.join(hot, on, "left").withColumn("_part", part).drop("_parts", "_split_asking")

    one = salted(asking, F.coalesce("_split_asking", F.lit(True)), asking_spread)
    two = salted(table, ~F.coalesce("_split_asking", F.lit(True)), table_spread)
    if total is not None:
        # Dealt out by the rows that come out: by the bytes that go in there would be few tasks.
        tasks = -(-total * TASKS_PER_SHARE // rows_per_task)
        one, two = (df.repartition(tasks, *on, "_part") for df in (one, two))
    return one.join(two, on + ["_part"]).drop("_part")

"""Paths through a hierarchy of any depth, in as many rounds as the logarithm of its depth.

Edges go from an object to its parent. Round k holds the paths of exactly 2**k edges and
joins them with themselves, so a chain of a thousand levels takes ten rounds. What the caller
collects on the way is extended each round by the paths of that round."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.plans.skew import skew_join
from waymark.plans.stage import measured, stage
from waymark.settings import DEFAULTS, SearchSettings


def _cycle(jumps: DataFrame) -> ValueError:
    ends = jumps.select(F.col("b").alias("a")).distinct()
    named = jumps.select("a").distinct().join(ends, "a").orderBy("a").limit(10).collect()
    return ValueError(f"cycle in the hierarchy, through {[r['a'] for r in named]}")


def climb(
    edges: DataFrame,
    start: DataFrame,
    join: Callable[[DataFrame, DataFrame], DataFrame],
    step: Callable[[Column, Column], Column] | None,
    carried: list[str],
    settings: SearchSettings = DEFAULTS,
) -> DataFrame:
    """`edges` (a, b, and the `carried` columns of the way from a to b) and `start`, what is
    collected with paths of no edge. Each round `join(collected, jumps)` gives what paths that
    are longer by 2**k edges add. `step(upper, lower)` puts the carried columns of two paths
    one above the other together; with a step, equal paths are one. A cycle fails the call."""
    distinct = (lambda df: df.distinct()) if step else (lambda df: df)
    jumps = stage(distinct(edges), "climb-0")
    found = stage(distinct(start), "climb-found-0")
    # A path of more edges than there are objects meets one of them twice.
    objects = jumps.select("a").distinct().count()
    length, no = 1, 0
    while measured(jumps):
        no += 1
        found = stage(distinct(found.unionByName(join(found, jumps))), f"climb-found-{no}")
        if length > objects or not jumps.where("a = b").isEmpty():
            raise _cycle(jumps)
        upper = jumps.select(
            F.col("a").alias("b"), F.col("b").alias("_b"), *[F.col(c).alias(f"_{c}") for c in carried]
        )
        both = skew_join(jumps, upper, ["b"], ["a"], rows_per_task=settings.rows_per_task,
                         at_most=measured(jumps))
        together = [step(F.col(f"_{c}"), F.col(c)).alias(c) for c in carried] if step else []
        jumps = stage(distinct(both.select("a", F.col("_b").alias("b"), *together)), f"climb-{no}")
        length *= 2
    return found

"""The corpus: every current address with its text, from the regions downward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.predicates import is_current, is_root, is_searchable_level
from waymark.functions.text import count_spaces
from waymark.operators.chains import topped
from waymark.plans.doubling import climb
from waymark.plans.skew import skew_join
from waymark.plans.stage import stage
from waymark.settings import DEFAULTS, SearchSettings


def build_paths(addrobj: DataFrame, settings: SearchSettings = DEFAULTS) -> DataFrame:
    """(id, aoid, fullname, sname, wordcount) of each path from a current region
    down to a current object. Two parents with different texts give two paths.

    The paths of objects with children are found first, in rounds of doubled length; equal
    ones are merged, so no path is built twice. Leaves, the bulk of a registry, meet the
    paths of their parents once."""
    current = stage(
        addrobj.where(is_current()).select(
            "id", "aoid", "aoguid", "aolevel", "parentguid", "shortname",
            F.concat("shortname", F.lit(" "), "formalname").alias("own"),
        ),
        "paths-current",
    )
    has_children = stage(
        current.where(F.col("parentguid").isNotNull())
        .select(F.col("parentguid").alias("aoguid"))
        .distinct(),
        "paths-inner",
    )
    inner = current.join(has_children, "aoguid", "left_semi")
    text = F.struct(F.col("own").alias("full"), F.col("shortname").alias("short"))

    def below(upper: Column, lower: Column) -> Column:
        return F.struct(
            F.concat(upper["full"], F.lit(", "), lower["full"]).alias("full"),
            F.concat(upper["short"], F.lit(" "), lower["short"]).alias("short"),
        )

    tops = climb(
        inner.where(F.col("parentguid").isNotNull()).select(
            F.col("aoguid").alias("a"), F.col("parentguid").alias("b"), text.alias("text")
        ),
        inner.where(is_root()).select(F.col("aoguid").alias("parentguid"), text.alias("text")),
        lambda found, jumps: topped(found, jumps, ["text"], below, settings),
        below, ["text"], settings,
    )
    lower = skew_join(
        current.where(F.col("parentguid").isNotNull()),
        tops.withColumnRenamed("text", "above"), ["parentguid"], ["id"],
        rows_per_task=settings.rows_per_task,
    ).withColumn("text", below(F.col("above"), text))
    columns = ["id", "aoid", "aolevel", "text.full", "text.short"]
    paths = (
        current.where(is_root()).withColumn("text", text).select(columns)
        .unionByName(lower.select(columns))
        .where(is_searchable_level())
    )
    return paths.select(
        "id", "aoid", F.col("full").alias("fullname"), F.col("short").alias("sname"),
        count_spaces(F.col("full")).alias("wordcount"),
    )

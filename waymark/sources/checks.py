"""Keys and widths of loaded tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.schemas import TableSpec


def unique_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values of more than one row, with their count `n`. As in SQL, a key
    with a null repeats freely."""
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return (
        df.where(whole)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
    )


def width_report(df: DataFrame, spec: TableSpec) -> DataFrame:
    """One row per limited or required column: (name, width, longest, too_long,
    nulls), from one pass over the table."""
    names = list(spec.widths) + [c for c in spec.required if c not in spec.widths]
    measures = []
    for name in names:
        length = F.length(name)
        width = spec.widths.get(name)
        too_long = F.count_if(length > width) if width else F.lit(0).cast("bigint")
        measures.append(
            F.struct(
                F.lit(name).alias("name"),
                F.lit(width).cast("int").alias("width"),
                F.max(length).alias("longest"),
                too_long.alias("too_long"),
                F.count_if(F.col(name).isNull()).alias("nulls"),
            )
        )
    return df.agg(F.array(*measures).alias("report")).select(F.inline("report"))


def validate(df: DataFrame, spec: TableSpec) -> None:
    """Raise if the table could not be stored."""
    for keys in spec.unique:
        repeated = unique_violations(df, list(keys)).limit(3).collect()
        if repeated:
            raise ValueError(f"{spec.name}: {keys} not unique, for example {repeated}")
    bad = width_report(df, spec).where(
        (F.col("too_long") > 0)
        | (F.col("name").isin(list(spec.required)) & (F.col("nulls") > 0))
    )
    rows = bad.collect()  # one row per column at most
    if rows:
        raise ValueError(f"{spec.name}: values too long or missing: {rows}")

"""Rows that cannot be stored are set aside with their reasons; the others are loaded."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.predicates import is_canonical_uuid
from waymark.plans.skew import skew_join
from waymark.plans.stage import stage
from waymark.schemas import TableSpec


@dataclass(frozen=True)
class Sorted:
    """good: rows of the stored types. refused: the columns of the file as text, with
    `reasons`. counts: rows by reason, and under `good` the rows kept."""

    good: DataFrame
    refused: DataFrame
    counts: dict[str, int]


def _faults(spec: TableSpec, uuids: bool) -> list[Column]:
    """For each rule its reason, null where the row keeps it."""
    faults = []
    for name, kind in spec.columns.items():
        raw = F.col(f"raw.{name.upper()}")
        if kind.typeName() != "string":
            lost = raw.isNotNull() & F.col(name).isNull()
            faults.append(F.when(lost, f"{name}: not {kind.simpleString()}"))
        if name in spec.widths:
            faults.append(F.when(F.length(name) > spec.widths[name], f"{name}: too long"))
        if name in spec.required:
            faults.append(F.when(F.col(name).isNull(), f"{name}: missing"))
        if uuids and name in spec.ids:
            faults.append(F.when(~is_canonical_uuid(F.col(name)), f"{name}: no uuid"))
    return faults


def sort_rows(rows: DataFrame, spec: TableSpec, uuids: bool = False) -> Sorted:
    """Rows as a reader gives them (text, upper-case names) to good ones and refused
    ones. A row is refused if a value is not of its type, is too long or missing where it
    must not be, if an identifier is no uuid (where `uuids` asks for that), or if a
    unique key stands in several otherwise good rows: then all of these are refused, since
    none is better than the others. A key with a null repeats freely."""
    names = list(spec.text_schema.fieldNames())
    typed = []
    for name, kind in spec.columns.items():
        value = F.col(f"raw.{name.upper()}")
        if name in spec.ids:
            value = F.lower(F.trim(value))
        typed.append(value.try_cast(kind).alias(name))
    judged = rows.select(F.struct(*names).alias("raw")).select("raw", *typed)
    judged = judged.withColumn("reasons", F.array_compact(F.array(*_faults(spec, uuids))))
    staged = stage(judged, f"sort-{spec.name.lower()}")
    for keys in spec.unique:
        whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
        counts = staged.where(whole & (F.size("reasons") == 0)).groupBy(*keys).count()
        repeated = stage(counts.where("count > 1").select(*keys, F.lit(True).alias("_again")), "repeated")
        fault = F.array(F.lit(f"{', '.join(keys)}: repeated"))
        again = F.col("_again") & (F.size("reasons") == 0)
        # A key may be in any number of rows, but once among the repeated ones.
        staged = stage(
            skew_join(staged, repeated, list(keys), ["raw"], "left")
            .withColumn("reasons", F.when(again, fault).otherwise(F.col("reasons")))
            .select("raw", *spec.columns, "reasons"),
            f"sort-{spec.name.lower()}",
        )
    good = staged.where(F.size("reasons") == 0).select(*spec.columns)
    refused = staged.where(F.size("reasons") > 0).select("raw.*", "reasons")
    tally = staged.select(
        F.explode(F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit("good"))))
        .alias("reason")
    ).groupBy("reason").count()
    return Sorted(good, refused, dict(map(tuple, tally.collect())))

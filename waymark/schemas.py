"""Schemas, keys and width limits of the registry tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class TableSpec:
    """What a stored table looks like. `columns` is the order used in files."""

    name: str
    columns: dict[str, T.DataType]
    key: str
    row_tag: str | None
    widths: dict[str, int]
    required: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...]
    ids: tuple[str, ...] = ()

    @property
    def schema(self) -> T.StructType:
        stored = [T.StructField("id", T.LongType(), False)]
        for name, kind in self.columns.items():
            stored.append(T.StructField(name, kind, name not in self.required))
        return T.StructType(stored)

    @property
    def text_schema(self) -> T.StructType:
        """All columns as text under their upper-case file names."""
        return T.StructType([T.StructField(c.upper(), T.StringType()) for c in self.columns])


# Names, order, widths and keys of the stored tables.
ADDROBJ = TableSpec(
    name="ADDROBJ",
    columns={
        "aoid": T.StringType(),
        "aoguid": T.StringType(),
        "shortname": T.StringType(),
        "formalname": T.StringType(),
        "aolevel": T.ShortType(),
        "parentguid": T.StringType(),
        "actstatus": T.BooleanType(),
        "livestatus": T.BooleanType(),
        "nextid": T.StringType(),
        "regioncode": T.ShortType(),
    },
    key="aoid",
    row_tag="Object",
    widths={"shortname": 10, "formalname": 120},
    required=("aoid",),
    unique=(("aoid",),),
    ids=("aoid", "aoguid", "parentguid", "nextid"),
)

SOCRBASE = TableSpec(
    name="SOCRBASE",
    columns={
        "level": T.ShortType(),
        "socrname": T.StringType(),
        "scname": T.StringType(),
        "kod_t_st": T.StringType(),
    },
    key="kod_t_st",
    row_tag="AddressObjectType",
    widths={"scname": 10, "socrname": 50, "kod_t_st": 4},
    required=(),
    unique=(("kod_t_st",), ("level", "scname")),
)

AOTRIG = TableSpec(
    name="AOTRIG",
    columns={
        "word": T.StringType(),
        "trigramm": T.StringType(),
        "frequency": T.LongType(),
    },
    key="word",
    row_tag=None,
    widths={"word": 50, "trigramm": 180},
    required=(),
    unique=(("word",),),
)

TABLES = {spec.name: spec for spec in (ADDROBJ, SOCRBASE, AOTRIG)}
IMPORTABLE = ("ADDROBJ", "SOCRBASE")


def typed(spec: TableSpec) -> list[Column]:
    """Casts of the text columns of a file to the stored types; a value that
    does not fit its type fails the load. Identifiers become canonical."""
    out = []
    for name, kind in spec.columns.items():
        value = F.col(name.upper())
        if name in spec.ids:
            value = F.lower(F.trim(value))
        out.append(value.cast(kind).alias(name))
    return out

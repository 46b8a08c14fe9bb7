"""Row predicates shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_current() -> Column:
    """The version of an object that is in force."""
    return F.col("actstatus") & F.col("livestatus") & F.col("nextid").isNull()


def is_root() -> Column:
    return F.col("aolevel") == 1


def is_searchable_level() -> Column:
    """Regions and autonomous districts are only parts of longer addresses."""
    return ~F.col("aolevel").isin(1, 3)


def is_legal_request(text: Column) -> Column:
    """What a free-text request may hold; other requests are refused."""
    # Fixed value: the admitted characters, and at least three of them; a line end may follow.
    return text.rlike(r"^[0-9A-zА-яЁё, .\-/]{3,}\n?\z")


def is_canonical_uuid(value: Column) -> Column:
    return value.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")

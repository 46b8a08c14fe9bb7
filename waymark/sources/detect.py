"""What a registry folder holds."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import SparkSession

from waymark.plans.files import Files
from waymark.schemas import IMPORTABLE

# The names of the files, by kind of source, and the words that tell
# rows to create from rows to delete.
_TABLE = "(" + "|".join(IMPORTABLE) + ")"
FILE_NAMES = {
    "tsv": rf"fd_(CREATE|DELETE)_{_TABLE}\.part[0-9]+\.csv",
    "xml": rf"(AS|DEL)_{_TABLE}_[0-9]{{8}}_[a-z0-9-]+\.XML",
}
OPERATIONS = {"CREATE": "create", "DELETE": "delete", "AS": "create", "DEL": "delete"}
_PREFIXES = {("tsv", "create"): "fd_CREATE", ("tsv", "delete"): "fd_DELETE",
             ("xml", "create"): "AS", ("xml", "delete"): "DEL"}


@dataclass(frozen=True)
class RegistrySource:
    folder: str
    kind: str
    parts: frozenset[tuple[str, str]]  # (table, operation) of which there are files

    def paths(self, table: str, operation: str) -> str | None:
        """A pattern of the files with rows to create or delete, if any. A part
        may be one file, or a folder of them as Spark writes it."""
        if (table, operation) not in self.parts:
            return None
        start = f"{self.folder}/{_PREFIXES[self.kind, operation]}_{table}"
        if self.kind == "tsv":
            return f"{start}.part[0-9]*.csv"
        return f"{start}_{'[0-9]' * 8}_*.XML"


def list_parts(spark: SparkSession, folder: str) -> list[tuple[str, str, str]]:
    """(kind, table, operation) of the files and part folders with known names. Only names
    are read, so a part without rows is found as well."""
    parts = set()
    for path in Files(spark, folder).found(f"{folder}/*"):
        for kind, pattern in FILE_NAMES.items():
            if found := re.fullmatch(pattern, path.rsplit("/", 1)[1]):
                parts.add((kind, found[2], OPERATIONS[found[1]]))
    return sorted(parts)


def detect_source(spark: SparkSession, folder: str) -> RegistrySource:
    """The one kind of source in the folder. All tables must be there."""
    kinds = {}
    for found, table, operation in list_parts(spark, folder):
        kinds.setdefault(found, set()).add((table, operation))
    whole = {
        kind: parts
        for kind, parts in kinds.items()
        if {table for table, _ in parts} == set(IMPORTABLE)
    }
    if not whole:
        raise ValueError(f"{folder} holds no complete set of registry files")
    if len(whole) > 1:
        raise ValueError(f"{folder} holds several kinds of registry files: {sorted(whole)}")
    kind, parts = whole.popitem()
    return RegistrySource(folder, kind, frozenset(parts))

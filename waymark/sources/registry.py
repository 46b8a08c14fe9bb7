"""Loading and exporting a registry."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.plans.files import Files
from waymark.plans.order import numbered
from waymark.plans.stage import measured, stage
from waymark.schemas import AOTRIG, IMPORTABLE, TABLES, TableSpec, typed
from waymark.settings import DEFAULTS, SearchSettings
from waymark.sources.checks import validate
from waymark.sources.detect import RegistrySource, detect_source
from waymark.sources.quarantine import sort_rows
from waymark.sources.readers import escape, read_dictionary_text, read_tsv, read_xml
from waymark.sources.versions import save_table

_READERS = {"tsv": read_tsv, "xml": read_xml}


def apply_deletes(base: DataFrame, deletes: DataFrame, key: str) -> DataFrame:
    """Rows of `base` whose key is not to be deleted. A null key matches none."""
    return base.join(deletes.select(key).distinct(), key, "left_anti")


def _read(
    spark: SparkSession, source: RegistrySource, spec: TableSpec, operation: str
) -> DataFrame | None:
    paths = source.paths(spec.name, operation)
    if paths is None:
        return None
    return _READERS[source.kind](spark, paths, spec)


def load_table(
    spark: SparkSession,
    source: RegistrySource,
    spec: TableSpec,
    check: bool = True,
    refused: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """All rows to create, less all to delete, whatever the order of the files. A row that
    cannot be stored fails the load; where a dictionary `refused` is given, it is set
    aside there under the table's name instead, and the others are loaded."""
    raw = _read(spark, source, spec, "create")
    if raw is None:
        rows = spark.createDataFrame([], spec.schema).drop("id")
    elif refused is not None:
        parted = sort_rows(raw, spec)
        rows, refused[spec.name.lower()] = parted.good, parted.refused
    else:
        rows = raw.select(typed(spec))
    deletes = _read(spark, source, spec, "delete")
    if deletes is not None:
        rows = apply_deletes(rows, deletes.select(typed(spec)), spec.key).select(list(spec.columns))
    rows = stage(rows, f"load-{spec.name.lower()}")
    if check and refused is None:
        validate(rows, spec)
    # Numbers are given to stored rows and stored in turn, so they never change.
    numbers = rows.select((F.monotonically_increasing_id() + 1).alias("id"), "*")
    return stage(numbers, spec.name.lower())


def load_registry(
    spark: SparkSession,
    folder: str,
    check: bool = True,
    refused: dict[str, DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """Tables of a folder with registry files, by lower-case name. See `load_table`."""
    source = detect_source(spark, folder)
    return {
        name.lower(): load_table(spark, source, TABLES[name], check, refused)
        for name in IMPORTABLE
    }


def replace_dictionary(spark: SparkSession, lines: str, path: str) -> DataFrame:
    """Put the words of a file of `word frequency` lines in place of the dictionary stored
    at `path`. A file with a bad line, a repeated or too long word changes nothing."""
    words = stage(read_dictionary_text(spark, lines), "dictionary-text")
    validate(words, AOTRIG)
    return save_table(words, path)


def export_xml(df: DataFrame, path: str, spec: TableSpec) -> None:
    """Write a table as one XML file that `load_registry` reads, an element a row with
    its values as attributes; nulls are left out, booleans become 1 and 0.

    The elements are made by many tasks. Only one can write a file: it copies them, which is the
    least there is to do for each row, and puts the root around them."""
    columns = []
    for name, kind in spec.columns.items():
        value = F.col(name)
        if kind.typeName() == "boolean":
            value = value.cast("int")
        columns.append(value.cast("string").alias("_" + name.upper()))
    options = {"attributePrefix": "_", "rowTag": spec.row_tag}
    elements = stage(df.select(F.to_xml(F.struct(*columns), options).alias("value")), "xml-elements")
    first, last = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<Rows>\n', "\n</Rows>"
    files = Files(df.sparkSession, path)
    total = measured(elements)
    if not total:
        files.create(path, first + last.lstrip())
        return
    # The one task numbers what it copies from 0.
    placed = elements.coalesce(1).select("value", F.monotonically_increasing_id().alias("n"))
    start = F.when(F.col("n") == 0, first).otherwise("")
    end = F.when(F.col("n") == total - 1, last).otherwise("")
    raw = f"{path.rpartition('/')[0]}/_writing-{uuid.uuid4().hex}"
    placed.select(F.concat(start, "value", end).alias("value")).write.option(
        "compression", "none"
    ).text(raw)
    (written,) = files.found(f"{raw}/part-*")
    files.move(written, path)
    files.remove(raw)


def export_tsv(
    df: DataFrame,
    folder: str,
    spec: TableSpec,
    operation: str = "CREATE",
    settings: SearchSettings = DEFAULTS,
    order: list[str] | None = None,
) -> int:
    """Write a table as numbered tab-delimited parts that `load_registry` reads, of
    `rows_per_file` rows each but the last, and return their number. Rows go by `order` (the id
    where there is one, else the key). Booleans become 1 and 0.

    Each part is written by one task under a folder of its own, and moved to its
    name when all are there."""
    fields = []
    for name, kind in spec.columns.items():
        value = F.col(name)
        if kind.typeName() == "boolean":
            value = value.cast("int")
        fields.append(escape(value.cast("string")))
    line = F.concat_ws("\t", *fields)
    by = order or (["id"] if "id" in df.columns else [spec.key])
    # Rows that are equal in the order stand by their lines, so that reruns agree.
    keys = [F.col(c).alias(f"_{i}") for i, c in enumerate(by)]
    lines = df.select(*keys, line.alias("value"))
    lines = numbered(lines, [*[f"_{i}" for i in range(len(by))], "value"], "export-lines")
    part = F.floor(F.col("n") / settings.rows_per_file).cast("bigint")
    lines = lines.select("value", "n", part.alias("part"))
    files = Files(df.sparkSession, folder)
    files.make_folder(folder)
    start = f"{folder}/fd_{operation}_{spec.name}.part"
    raw = f"{folder}/_writing-{uuid.uuid4().hex}"
    # The writer needs the rows of a part together, and leaves the order within it.
    sorted_ = lines.repartition("part").sortWithinPartitions("part", "n")
    sorted_.select("value", "part").write.partitionBy("part").text(raw)
    written = files.found(f"{raw}/part=*/*.txt")
    for file in written:
        files.move(file, f"{start}{file.split('/part=')[1].split('/')[0]}.csv")
    files.remove(raw)
    if not written:
        files.create(f"{start}0.csv")
    return max(1, len(written))

"""Helpers that the operators of this package share."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.plans.stage import stage_root

#: Applications whose workers have this package.
_shipped: set[str] = set()


#: Spark's setting by which the shuffle files of a query go when the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: the lineage ends
    there, and the loss of an executor costs no earlier work. Nothing reads the shuffle files
    of the write after it, so they go at once."""
    spark = df.sparkSession
    path = "/".join(
        [stage_root(spark), "llm", spark.sparkContext.applicationId,
         f"{name}-{uuid.uuid4().hex}"]
    )
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._path = path
    return stored


def release(*tables: DataFrame) -> None:
    """Delete tables made by `store` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def together(tables: list[DataFrame]) -> DataFrame:
    """The rows of tables of one schema made by `store`, by one scan of all their files: a
    union would have a scan for each, and the driver plans, describes and compiles all of them again
    with every query on it."""
    reader = tables[0].sparkSession.read.schema(tables[0].schema)
    return reader.parquet(*[t._path for t in tables])


def rows(documents: DataFrame) -> DataFrame:
    """`documents` as one column `row`, so that its names cannot meet working names."""
    return documents.select(F.struct(*[documents[f"`{c}`"] for c in documents.columns]).alias("row"))


def columns_of(documents: DataFrame, **changed: Column) -> list[Column]:
    """The columns of `documents` out of `row`, those named with another content."""
    return [
        (changed[c] if c in changed else F.col("row").getField(c)).alias(c)
        for c in documents.columns
    ]


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else. `lower` does that at once where all is ASCII."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, letters, letters.lower())
    )


def text_key(text: Column) -> Column:
    """Tells rows of one id apart; rows equal in id and text stay one document."""
    return F.xxhash64(text)


def held_out(doc_id: Column, folds: int, held: int) -> Column:
    """crc32 of the id as text, modulo `folds`, is `held`. A null id is not held out."""
    fold = F.crc32(doc_id.cast("string").cast("binary")) % folds
    return F.coalesce(fold == held, F.lit(False))


def for_python(df: DataFrame, rows: int = 1000) -> DataFrame:
    """`df`, in a session whose Python workers know this package and are handed at most
    so many rows at a time: texts may be very long. Spark has that as a setting of the
    session only."""
    spark = df.sparkSession
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) not in range(1, rows + 1):
        spark.conf.set(name, str(rows))
    if spark.sparkContext.applicationId not in _shipped:
        package = Path(__file__).parent.parent
        archive = shutil.make_archive(
            f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name
        )
        spark.sparkContext.addPyFile(archive)
        _shipped.add(spark.sparkContext.applicationId)
    return df


def blocks(texts: list[str], size: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about `size` characters, with the number of the first."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield first, texts[first : i + 1]
            first, total = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def sampled(df: DataFrame, by: str, per_class: int, id_col: str = "doc_id") -> DataFrame:
    """About `per_class` rows of each value of `by`, or all if there are fewer, picked
    by a hash of the id; `_rate` is the share that was picked. There must be few values."""
    counts = {r[0]: r[1] for r in df.groupBy(by).count().collect()}
    if not counts:
        return df.withColumn("_rate", F.lit(1.0))
    rates = [x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_class / n)))]
    place = F.pmod(F.xxhash64(F.lit("sample"), id_col), F.lit(1_000_000)) / 1e6
    rated = df.withColumn("_rate", F.element_at(F.create_map(*rates), F.col(by)))
    return rated.where(place < F.col("_rate"))


def rows_of(documents: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`text` of the rows of `documents` that `wanted` (_doc, _key and other columns)
    names by id and hash of the text, with the columns of `wanted`. Most rows are not
    wanted: Spark is told to filter the scan by a Bloom filter of the wanted keys, so
    that their texts are not shuffled."""
    spark = documents.sparkSession
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.enabled", "true")
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "1b")
    docs = documents.select(
        F.xxhash64(id_col, F.xxhash64(text_col)).alias("_row"),
        F.xxhash64(text_col).alias("_k"), F.col(text_col).alias("text"),
    ).where(F.col("text").isNotNull())
    named = store(wanted.withColumn("_row", F.xxhash64("_doc", "_key")), "wanted")
    # The comparison holds for every number; the filter is built on compared keys only.
    named = named.where(F.col("_row") >= F.lit(-(2**63)))
    return docs.join(named, "_row").where(F.col("_k").bitwiseXOR(F.col("_key")) == 0)


def placed(values: list, at: np.ndarray, n: int) -> pd.Series:
    """A column of `n` rows with `values` at the rows `at` and null elsewhere."""
    out = np.full(n, None, dtype=object)
    for i, x in zip(at.tolist(), values, strict=True):
        out[i] = x
    return pd.Series(out, dtype=object)

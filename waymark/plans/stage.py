"""Intermediate results as tables in the shared folder of the cluster.

A written table cuts the lineage, survives the loss of executors, is read with
column pruning and filters, and tells the optimizer its true size. Its rows are
counted while it is written.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local_roots: dict[str, str] = {}


def stage_root(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`. A session on one machine that
    names none (as in tests) gets a temporary one; a cluster must name one."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_roots:
        _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="waymark-")
    return _local_roots[context.applicationId]


def stage(df: DataFrame, name: str, measure: Column | None = None) -> DataFrame:
    """Write `df` under the stage folder and read it back. `measured` gives the
    number of rows written, or the value of the aggregate `measure`."""
    spark = df.sparkSession
    path = "/".join(
        [stage_root(spark), "waymark", spark.sparkContext.applicationId,
         f"{name}-{uuid.uuid4().hex}"]
    )
    seen = Observation()
    total = F.count(F.lit(1)) if measure is None else F.coalesce(measure, F.lit(0))
    df.observe(seen, total.alias("total")).write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._measured = seen.get.get("total")
    return staged


def measured(staged: DataFrame) -> int | None:
    """What `stage` counted; None for other tables and where the plan turned out
    so empty that nothing was counted."""
    return getattr(staged, "_measured", None)

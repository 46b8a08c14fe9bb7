"""Tables that are replaced and appended to by commits.

A table is a folder of data folders, each written once, and of numbered commit files, each
of which names the data folders of a version. A commit is made last and by one new file, so
a write that fails leaves the table as it was; a reader holds the version that it opened.
Two writers that commit at the same time get two numbers: an append is made anew upon the other's
version, a replacement is the last word."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from waymark.plans.files import Files


def _commits(files: Files, path: str) -> list[tuple[int, dict]]:
    """The commits of a table. A file that is still being written is not one yet."""
    out = []
    for file in files.found(f"{path}/_commits/*.json"):
        text = files.text(file)
        if text.endswith("\n"):
            out.append((int(file.rsplit("/", 1)[1].removesuffix(".json")), json.loads(text)))
    return out


def versions(spark: SparkSession, path: str) -> list[int]:
    return [n for n, _ in _commits(Files(spark, path), path)]


def open_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest version of a table, or the one named. What is opened stays what it is,
    whatever is committed later."""
    commits = dict(_commits(Files(spark, path), path))
    if not commits or version is not None and version not in commits:
        raise ValueError(f"{path} has no version {'' if version is None else version}".rstrip())
    commit = commits[max(commits) if version is None else version]
    folders = [f"{path}/{name}" for name in commit["folders"]]
    return spark.read.schema(commit["schema"]).parquet(*folders)


def _commit(df: DataFrame, path: str, keep: bool) -> int:
    spark = df.sparkSession
    files = Files(spark, path)
    folder = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    files.make_folder(f"{path}/_commits")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    while True:
        last, commit = max(_commits(files, path), default=(0, {"folders": [], "schema": schema}), key=lambda c: c[0])
        if keep and commit["schema"] != schema:
            raise ValueError(f"{path} has columns {commit['schema']}, not {schema}")
        folders = [*commit["folders"], folder] if keep else [folder]
        text = json.dumps({"folders": folders, "schema": schema}) + "\n"
        if files.create(f"{path}/_commits/{last + 1:012d}.json", text):
            return last + 1


def save_table(df: DataFrame, path: str) -> DataFrame:
    """Replace the table at `path`, which `df` may be made from."""
    return open_table(df.sparkSession, path, _commit(df, path, False))


def append_table(df: DataFrame, path: str) -> DataFrame:
    """Add rows to the table at `path`, or begin it."""
    return open_table(df.sparkSession, path, _commit(df, path, True))

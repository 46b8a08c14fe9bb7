"""The queries of this package, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate,
    langid,
    line_dedup,
    minhash_dedup,
    mixing,
    pii,
    prefix_trie,
    secrets,
    substring_dedup,
    token_alignment,
    topk,
    toxicity,
    url_filter,
)
from .oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_dedup.classes(_table(spark, sf_dir, "documents"), percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_held_out(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    )


def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )


def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(_table(spark, sf_dir, "documents"))


def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.classes(_table(spark, sf_dir, "documents")).drop("key")


def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_private(_table(spark, sf_dir, "documents")).drop("redacted")


def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_held_out(_table(spark, sf_dir, "documents"))


def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_table(spark, sf_dir, "documents"))


def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.report(_table(spark, sf_dir, "documents"))


def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.sequences(_table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.rebuilt(turns))


def queries() -> dict[str, Query]:
    return {
        "op1_minhash_dedup": _op1,
        "op2_topk": _op2,
        "op3_mixing": _op3,
        "op4_toxicity": _op4,
        "op5_decontaminate": _op5,
        "op6_substring_dedup": _op6,
        "op7_line_dedup": _op7,
        "op8_url_filter": _op8,
        "op9_pii": _op9,
        "op10_langid": _op10,
        "op11_secrets": _op11,
        "op12_token_alignment": _op12,
        "op13_prefix_trie": _op13,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

"""Exact search for the highest inner products, score at a time: the index holds the
digits of all vectors in segments of falling impact; a query adds up segments until what
is left proves which vectors can be in its answer, and these are scored exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import for_python, store

SCALE = 256
#: Vectors of an index block and queries of a query block, about.
INDEX_BLOCK, QUERY_BLOCK = 4096, 512
#: Impacts, as powers of two, of the segments, in falling order; each next one has the
#: digits that are left by those before.
SEGMENTS = (6, 4, 2)
#: Largest sum that stays exact in floating point.
EXACT = 2.0**53


def _usable(vector: Column) -> Column:
    """Whether a vector has elements and all are finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & (F.size(vector) > 0), F.lit(False))


def _packed(rows: DataFrame, per_block: int, ids: str, matrix: str, block: str) -> DataFrame:
    """Rows (vec_id, v) as blocks: dim, number of the block, ids and numbers as bytes. The
    hash of the id deals the rows, and hot values do not meet in one block."""
    counts = {r[0]: r[1] for r in rows.groupBy("dim").count().collect()}
    if not counts:
        number = F.lit(0)
    else:
        sizes = [
            x for dim, n in counts.items() for x in (F.lit(dim), F.lit(-(-n // per_block)))
        ]
        number = F.pmod(F.xxhash64("vec_id"), F.element_at(F.create_map(*sizes), F.col("dim")))
    dealt = rows.withColumn(block, number.cast("int"))

    def pack(key: tuple[int, int], group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id", kind="stable")
        return pd.DataFrame({
            "dim": [key[0]], block: [key[1]],
            ids: [group["vec_id"].to_numpy(np.int64).tobytes()],
            matrix: [np.stack(group["v"].to_numpy()).astype(np.int64).tobytes()],
        })

    return for_python(dealt).groupBy("dim", block).applyInPandas(
        pack, f"dim int, {block} int, {ids} binary, {matrix} binary"
    )


def search_block(
    queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query_id, vec_id, score of the `k` best of `vectors` for each query, ids rising. A
    vector with the query's own id is none of them."""
    limit = float(np.abs(queries).max()) * float(np.abs(vectors).max()) * vectors.shape[1]
    if limit >= EXACT:
        return _rescored(queries, query_ids, vectors, ids, k, None)
    q = queries.astype(np.float64)
    own = query_ids[:, None] == ids[None, :]
    total = np.zeros((len(q), len(ids)))
    plus, minus = np.maximum(q, 0).sum(axis=1), np.minimum(q, 0).sum(axis=1)
    left, possible = vectors, None
    for power in SEGMENTS:
        digits = left >> power
        left = left - (digits << power)
        total += (q @ digits.T.astype(np.float64)) * float(1 << power)
        # What is left of a number lies between 0 and 2 ** power - 1.
        rest = float((1 << power) - 1)
        low, high = total + rest * minus[:, None], total + rest * plus[:, None]
        low[own] = -np.inf
        if len(ids) > k:
            kth = np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k]
            possible = (high >= kth[:, None]) & ~own
            if possible.sum() <= 2 * k * len(q):
                break
    return _rescored(queries, query_ids, vectors, ids, k, possible)


def _rescored(
    queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int,
    possible: np.ndarray | None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i, q in enumerate(queries):
        some = np.flatnonzero(ids != query_ids[i] if possible is None else possible[i])
        score = vectors[some] @ q
        best = np.lexsort((ids[some], -score))[:k]
        out.append((np.full(len(best), query_ids[i]), ids[some][best], score[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the `k` highest integer inner products of
    every row of `queries` with the rows of `vectors`, or all if there are fewer.

    Each component x counts as floor(256 * x). Ties go to the smaller id. Rows without
    id, null vectors, empty ones, and those with a null or non-finite component take no
    part; vectors meet queries of their own length only; a vector with the query's id
    is no candidate. Of rows that repeat an id and a vector one counts. A finite component
    so large that a product of two such vectors might not fit a long fails the search.
    """
    # dim * largest ** 2 has to stay below 2 ** 63.
    largest = F.sqrt(F.lit(2.0**62) / F.size(vector_col))
    wrong = F.raise_error(F.lit("a component is too large for scores of 64 bits")).cast("long")

    def number(x: Column) -> Column:
        whole = F.floor(x.cast("double") * SCALE)
        return F.when(F.abs(x.cast("double")) * SCALE > largest, wrong).otherwise(whole.cast("long"))

    numbers = lambda df: df.where(F.col(id_col).isNotNull() & _usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, number).alias("v"),
        F.size(vector_col).alias("dim"),
    ).dropDuplicates(["vec_id", "v"])
    index = store(
        _packed(numbers(vectors), INDEX_BLOCK, "ids", "numbers", "block"), "topk-index"
    )
    asked = store(
        _packed(numbers(queries), QUERY_BLOCK, "query_ids", "query_numbers", "asked"), "topk-asked"
    )
    # Every block of queries goes to every block of the index of its length.
    last = index.groupBy("dim").agg(F.max("block").alias("last"))
    spread = asked.join(last, "dim").withColumn("block", F.explode(F.sequence(F.lit(0), "last")))
    pairs = spread.select("dim", "asked", "block").join(asked, ["dim", "asked"]).join(
        index, ["dim", "block"]
    ).select("dim", "query_ids", "query_numbers", "ids", "numbers")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, qi, qn, vi, vn in batch.itertuples(index=False):
                found = search_block(
                    np.frombuffer(qn, np.int64).reshape(-1, dim), np.frombuffer(qi, np.int64),
                    np.frombuffer(vn, np.int64).reshape(-1, dim), np.frombuffer(vi, np.int64), k,
                )
                yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    best = for_python(pairs).mapInPandas(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    )
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )

"""Near-duplicate documents: a similarity join of their shingle sets along chosen paths.

Each of several independent trees sends a document down to the node of the minwise token
that the tree's root selects. Small nodes are compared exhaustively; a crowded node
branches by paths of further minwise tokens, which it selects itself, several tokens at a time
and so many paths that similar documents go on together in two of them on average.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, columns_of, for_python, placed, rows, rows_of, store, together
from .linking import draws, link, sketches

#: Words of a shingle.
WORDS = 5
#: Minwise tokens of a document; the roots of the trees select the first of them.
TOKENS = 32
TREES = 10
LEVELS = 6
_ODD = np.random.default_rng(20240607).integers(1, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the distinct shingles of all `texts`, in rising order for each text,
    and the number of shingles of each text."""
    split = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    n = np.array([len(x) for x in split])
    flat = np.array([w for x in split for w in x] + [None], dtype=object)[:-1]
    h = pd.util.hash_array(flat, categorize=False) if len(flat) else np.zeros(0, np.uint64)
    first = np.concatenate(([0], np.cumsum(n)))
    # A text of fewer words is one shingle, made with the number of its words.
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(texts)), count)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner]
    length = np.minimum(n[owner], words)
    made = length.astype(np.uint64)
    for j in range(words):
        inside = length > j
        part = np.zeros(len(start), dtype=np.uint64)
        part[inside] = h[start[inside] + j]
        made = np.where(inside, _mixed(made * np.uint64(0x9E3779B97F4A7C15) + part), made)
    order = np.lexsort((made, owner))
    made = made[order]  # the owners stay as they are
    new = np.ones(len(made), dtype=bool)
    new[1:] = (made[1:] != made[:-1]) | (owner[1:] != owner[:-1])
    return made[new], np.bincount(owner[new], minlength=len(texts))


def minwise(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """TOKENS minwise values of each set that is not empty."""
    first = (np.cumsum(n) - n)[n > 0]
    out = np.zeros((len(first), TOKENS), dtype=np.uint64)
    for i, odd in enumerate(_ODD):
        out[:, i] = np.minimum.reduceat(hashes * odd, first) if len(first) else 0
    return out


def shingled(documents: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key, n, d1 and d2 (digest of the set), tokens, s1 and s2 (sketch); of an empty
    set n is 0 and the others say nothing."""
    docs = for_python(documents).select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("key"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, some in blocks(batch["text"].tolist()):
                hashes, n = shingle_sets(some, words)
                cut = np.split(hashes, np.cumsum(n)[:-1])
                rows = batch.iloc[at : at + len(some)][["doc_id", "key"]].reset_index(drop=True)
                rows["n"] = n
                digests = b"".join(hashlib.md5(x.tobytes()).digest() for x in cut if len(x))
                tokens = minwise(hashes, n)
                halves = np.frombuffer(digests, np.int64).reshape(-1, 2)
                full, s = np.flatnonzero(n), sketches(tokens)
                rows["tokens"] = placed(list(tokens.view(np.int64)), full, len(n))
                for name, x in zip(("d1", "d2", "s1", "s2"), (*halves.T, *s), strict=True):
                    column = np.zeros(len(n), dtype=np.int64)
                    column[full] = x
                    rows[name] = column
                yield rows[["doc_id", "key", "n", "d1", "d2", "tokens", "s1", "s2"]]

    return docs.mapInPandas(
        run,
        "doc_id long, key long, n long, d1 long, d2 long, tokens array<long>, s1 long, s2 long",
    )


def classes(
    documents: DataFrame, percent: int = 80, words: int = WORDS, trees: int = TREES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, key (hash of the text), n_shingles, root (one set of the component; null
    without shingles), component_id, kept of every row.

    Documents with 100 * intersection >= percent * union of their sets of `words`-word
    shingles are linked (A-Z lower-cased, words between ASCII white space); the component
    is the smallest doc_id reachable over links, and kept says that it is the row's own. A
    text of fewer words is one shingle. A null text or one without words has no shingle
    and is linked with nothing. Equal sets are one set from the start, however many rows
    have them. A null doc_id is never the smallest; a component of nulls only has null,
    and its rows are kept. Repeated rows are in one component and each kept if its id is.
    """
    rows = store(shingled(documents, words, id_col, text_col), "dedup-rows")
    sets = rows.where(F.col("n") > 0).groupBy("d1", "d2").agg(
        *[F.first(c).alias(c) for c in ("n", "tokens", "s1", "s2")],
        F.min(F.struct("doc_id", "key")).alias("place"), F.min("doc_id").alias("least"),
    )
    # Half of the digest is the number of a set; should two sets share it, they part here.
    twin = F.row_number().over(Window.partitionBy("d1").orderBy("d2"))
    number = F.when(twin == 1, F.col("d1")).otherwise(F.xxhash64("d1", "d2", twin))
    sets = store(sets.withColumn("id", number), "dedup-sets")
    infos = sets.select("id", "n", "s1", "s2")
    roots = F.slice("tokens", 1, trees)
    members = sets.select(
        "id", "n", "s1", "s2", F.posexplode(roots).alias("tree", "token")
    ).select(F.xxhash64("tree", "token").alias("node"), "id", "n", "s1", "s2")

    def branch(many: DataFrame, level: int) -> DataFrame:
        joined = many.join(sets.select("id", "tokens"), "id")
        return joined.select(
            "node", "id", "tokens", F.explode(draws(level, percent, TOKENS)).alias("places")
        ).select(
            F.xxhash64(
                "node", "places", F.transform("places", lambda i: F.get("tokens", i))
            ).alias("node"),
            "id",
        )

    stored: list[DataFrame] = []

    def whole(ids: DataFrame) -> DataFrame:
        # The whole sets of the documents that have a candidate, made when first asked for.
        wanted = ids.distinct()
        if stored:
            wanted = wanted.join(together(stored).select("id"), "id", "left_anti")
        wanted = store(wanted, "dedup-wanted")
        if not stored or not wanted.isEmpty():
            wanted = wanted.join(sets.select("id", "place"), "id").select(
                F.col("id").alias("_id"), F.col("place.doc_id").alias("_doc"),
                F.col("place.key").alias("_key"),
            )
            stored.append(store(_sets_of(documents, wanted, words, id_col, text_col), "dedup-full"))
        return together(stored)

    def verify(pairs: DataFrame) -> DataFrame:
        full = whole(pairs.select(F.col("a").alias("id")).union(pairs.select("b")))
        return _similar(pairs, full, percent)

    def decode(bodies: list) -> list[np.ndarray]:
        return [np.frombuffer(x, np.uint64) for x in bodies]

    found = link(members, infos, verify, whole, decode, branch, percent, LEVELS)
    least = found.join(sets.select(F.col("id").alias("node"), "least"), "node").groupBy("root").agg(
        F.min("least").alias("component_id")
    )
    named = found.join(least, "root").select(F.col("node").alias("id"), "root", "component_id")
    # Of the sets of no component each is its own.
    alone = sets.join(named, "id", "left").select(
        "d1", "d2", F.coalesce("root", "id").alias("root"),
        F.coalesce("component_id", "least").alias("component_id"),
    )
    same = (F.col("n") > 0) & (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2"))
    alone = alone.withColumnsRenamed({"d1": "_d1", "d2": "_d2"})
    return rows.join(alone, same, "left").select(
        "doc_id", "key", F.col("n").alias("n_shingles"), "root",
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias(
            "component_id"
        ),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _sets_of(
    documents: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str
) -> DataFrame:
    """id, body (the set as bytes) and weight (its size) of the sets `wanted` (_id, _doc, _key)."""
    texts = rows_of(for_python(documents), wanted, id_col, text_col).select("_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, some in blocks(batch["text"].tolist()):
                hashes, n = shingle_sets(some, words)
                cut = np.split(hashes, np.cumsum(n)[:-1])
                ids = batch["_id"].iloc[at : at + len(some)].tolist()
                yield pd.DataFrame({"id": ids, "body": [x.tobytes() for x in cut], "weight": n})

    # Repeated rows have equal sets; one is enough.
    made = texts.mapInPandas(run, "id long, body binary, weight long")
    return made.groupBy("id").agg(F.first("body").alias("body"), F.first("weight").alias("weight"))


def _similar(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    both = pairs.join(
        full.select(F.col("id").alias("a"), F.col("body").alias("x")), "a"
    ).join(full.select(F.col("id").alias("b"), F.col("body").alias("y")), "b")

    @F.pandas_udf("boolean")
    def enough(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for one, two in zip(x, y, strict=True):
            p, q = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
            merged = np.concatenate((p, q))
            merged.sort()
            shared = int((merged[1:] == merged[:-1]).sum())
            out.append(100 * shared >= percent * (len(merged) - shared))
        return pd.Series(out, dtype=bool)

    return for_python(both).where(enough("x", "y")).select("a", "b")


def keep_one(documents: DataFrame, percent: int = 80) -> DataFrame:
    """One row of `documents` (doc_id, text and any other columns) for each component:
    that of the smallest doc_id. Rows without words stay; rows equal in id and text are
    one."""
    found = store(classes(documents, percent), "dedup-classes")
    first = found.where(F.col("root").isNotNull()).groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "key")).alias("x")
    )
    empty = found.where(F.col("root").isNull()).select("doc_id", "key").distinct()
    found = first.select("x.doc_id", "x.key").unionByName(empty).select(
        F.col("doc_id").alias("_kept_id"), F.col("key").alias("_k")
    )
    docs = rows(documents).select(
        "row", F.col("row.doc_id").alias("_id"), F.xxhash64("row.text").alias("_key")
    )
    kept = docs.join(
        found,
        F.col("_id").eqNullSafe(F.col("_kept_id")) & F.col("_key").eqNullSafe(F.col("_k")),
        "left_semi",
    )
    return kept.dropDuplicates(["_id", "_key"]).select(columns_of(documents))

"""Repeated substrings: content-defined chunks by a gear rolling hash, found again by
their digests wherever they stand."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, columns_of, for_python, rows, store

#: Bytes that the rolling hash sees; a power of two.
WINDOW = 16
#: A chunk ends where the hash is lowest within so many bytes on either side, so cuts
#: depend on what is near only, and chunks are longer than this.
RADIUS = 20
#: Repeated chunks in a row count if they have so many characters together.
LEAST = 64
_GEAR = np.random.default_rng(4).integers(0, 2**32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of the last WINDOW bytes: h = (h << 1) + GEAR[byte], by
    doubling. The sum of k hashes is shifted by k for the next k bytes."""
    h = _GEAR[data]
    k = 1
    while k < WINDOW:
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
        k *= 2
    return h


def _lowest(h: np.ndarray, n: int) -> np.ndarray:
    """The minimum of h[i : i + n] for each i where that fits."""
    out, k = h, 1
    while 2 * k <= n:
        out = np.minimum(out[:-k], out[k:])
        k *= 2
    return np.minimum(out[: len(h) - n + 1], out[n - k : len(h) - k + 1]) if k < n else out


def cuts(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts with room between them, the first byte of each chunk and the byte behind
    its end, and the number of its text."""
    room = bytes(WINDOW + RADIUS + 1)
    data = room + room.join(texts) + room
    size = np.array([len(t) for t in texts])
    begin = len(room) + np.cumsum(size + len(room)) - size - len(room)
    codes = np.frombuffer(data, dtype=np.uint8)
    # Every text is hashed behind the same room, whatever stands before that.
    h = gear(codes) ^ np.uint32(0x5BD1E995)
    low = _lowest(h, RADIUS)
    i = np.arange(RADIUS, len(h) - RADIUS)
    at = i[(h[i] < low[i - RADIUS]) & (h[i] <= low[i + 1])] + 1
    # A cut stands before a character, not in one.
    for _ in range(3):
        at = at + ((codes[np.minimum(at, len(codes) - 1)] & 0xC0) == 0x80)
    owner = np.searchsorted(begin, at, side="right") - 1
    inside = (owner >= 0) & (at > begin[owner]) & (at < begin[owner] + size[owner])
    full = np.flatnonzero(size)
    start = np.concatenate((begin[full], at[inside]))
    who = np.concatenate((full, owner[inside]))
    order = np.lexsort((start, who))
    start, who = start[order], who[order]
    end = np.append(start[1:], 0)
    last = np.append(who[1:] != who[:-1], True)
    end[last] = (begin + size)[who[last]]
    return data, start, end, who


def chunks(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (hash of the text), start and end (code points), d1, d2 (digest) of
    every chunk of every text that is not null or empty."""
    docs = for_python(documents).select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("key"),
        F.col(text_col).alias("text"),
    ).where(F.length("text") > 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, keys = batch["doc_id"].array, batch["key"].to_numpy()
            for at, some in blocks(batch["text"].tolist()):
                data, start, end, who = cuts([t.encode("utf-8", "surrogatepass") for t in some])
                view, digest = memoryview(data), xxhash.xxh3_128_digest
                found = b"".join(
                    [digest(view[s:e]) for s, e in zip(start.tolist(), end.tolist(), strict=True)]
                )
                d = np.frombuffer(found, dtype=np.int64).reshape(-1, 2)
                codes = np.frombuffer(data, dtype=np.uint8)
                point = np.concatenate(([0], np.cumsum((codes & 0xC0) != 0x80)))
                first = np.concatenate(([True], who[1:] != who[:-1]))
                origin = point[start[first]][np.cumsum(first) - 1]
                yield pd.DataFrame({
                    "doc_id": ids[at + who], "key": keys[at + who], "start": point[start] - origin,
                    "end": point[end] - origin, "d1": d[:, 0], "d2": d[:, 1],
                })

    return docs.mapInPandas(run, "doc_id long, key long, start long, end long, d1 long, d2 long")


def repeated(
    documents: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row for each chunk that stands in a repeated passage: doc_id, key, run (start of
    the passage), start, end, first_doc_id, first_start, duplicate.

    A passage is a row of chunks that each occur more than once in all texts, of `least`
    characters together. The first occurrence of a chunk, by doc_id (null last) and
    place, is not a duplicate. Null and empty texts have no chunks; a text without a
    cut is one chunk. Rows equal in id and text are one document.
    """
    again = chunks(documents, id_col, text_col).groupBy("d1", "d2").agg(
        F.count(F.lit(1)).alias("k")
    ).where(F.col("k") > 1).select("d1", "d2")
    again = store(again, "chunks-again")
    met = store(chunks(documents, id_col, text_col).join(again, ["d1", "d2"]), "chunks-met")
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "start", "key")
    first = met.groupBy("d1", "d2").agg(
        F.min(order).alias("first"), F.max(order).alias("last")
    ).where(F.col("first") != F.col("last")).drop("last")  # repeated rows repeat nothing
    met = met.join(first, ["d1", "d2"]).withColumn("duplicate", order != F.col("first"))
    by = Window.partitionBy("doc_id", "key").orderBy("start")
    breaks = F.coalesce(F.lag("end").over(by), F.lit(-1)) < F.col("start")
    run = F.last(F.when(breaks, F.col("start")), ignorenulls=True).over(
        by.rowsBetween(Window.unboundedPreceding, 0)
    )
    runs = met.dropDuplicates(["doc_id", "key", "start"]).withColumn("run", run)
    whole = F.max("end").over(Window.partitionBy("doc_id", "key", "run")) - F.col("run")
    return runs.withColumn("whole", whole).where(F.col("whole") >= least).select(
        "doc_id", "key", "run", "start", "end", F.col("first.doc_id").alias("first_doc_id"),
        F.col("first.start").alias("first_start"), "duplicate",
    )


def passages(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, start, end, n_chunks, n_duplicate, first_doc_id (the smallest document that
    has any of it) of every repeated passage. Cases: see `repeated`."""
    return repeated(documents, least).groupBy("doc_id", "key", F.col("run").alias("start")).agg(
        F.max("end").alias("end"), F.count(F.lit(1)).alias("n_chunks"),
        F.sum(F.col("duplicate").cast("long")).alias("n_duplicate"),
        F.min("first_doc_id").alias("first_doc_id"),
    ).drop("key")


def drop_repeated(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """`documents` (doc_id, text and any other columns) without the duplicate chunks of
    repeated passages. Texts without any stay as they are."""
    gone = repeated(documents, least).where("duplicate").groupBy("doc_id", "key").agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_gone")
    ).select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), "_gone")
    joined = rows(documents).join(
        store(gone, "chunks-gone"),
        F.col("row.doc_id").eqNullSafe(F.col("_doc"))
        & F.xxhash64("row.text").eqNullSafe(F.col("_key")),
        "left",
    )
    n = F.size("_gone")
    # What is left stands between one end and the next start.
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("_gone", lambda x: x["end"]))
    ends = F.concat(
        F.transform("_gone", lambda x: x["start"]), F.array(F.length("row.text").cast("long"))
    )
    pieces = F.zip_with(
        starts, ends,
        lambda s, e: F.substring("row.text", (s + 1).cast("int"), (e - s).cast("int")),
    )
    text = F.when(n > 0, F.array_join(pieces, "")).otherwise(F.col("row.text"))
    return joined.select(columns_of(documents, text=text))

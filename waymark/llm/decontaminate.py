"""Benchmark decontamination: a hash set of the test items' word n-grams meets every
window of every document; hits are verified word by word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, columns_of, rows, store, text_key

#: Words of a window.
N = 10
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The set of window hashes is broadcast up to so many rows of 12 bytes; beyond that
#: the windows are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def _words(text: Column) -> Column:
    words = F.filter(F.split(ascii_lower(text), GAP), lambda w: w != "")
    return F.coalesce(words, F.array().cast("array<string>"))


def benchmark_windows(benchmark: DataFrame, n: int = N, item_col: str = "item_id",
                      text_col: str = "text") -> DataFrame:
    """item_id, len, gram, h of every window. An item of fewer than `n` words is one
    window; one without words has none. Rows without an item_id are left out."""
    words = benchmark.where(F.col(item_col).isNotNull()).select(
        F.col(item_col).alias("item_id"), _words(F.col(text_col)).alias("w")
    )
    words = words.where(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(n)))
    grams = F.transform(
        F.sequence(F.lit(1), F.size("w") - F.col("len") + 1),
        lambda i: F.array_join(F.slice("w", i, F.col("len")), " "),
    )
    grams = words.select("item_id", "len", F.explode(grams).alias("gram")).distinct()
    return grams.withColumn("h", F.xxhash64(_hashes(F.split("gram", " "))))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def scan(
    documents: DataFrame,
    benchmark: DataFrame,
    n: int = N,
    broadcast_rows: int = BROADCAST_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, key, n_words, hits (distinct verified windows: pos from 1, len, gram) of
    every row of `documents`; key is the hash of its text.

    Null text has no words. Rows equal in id and text get equal results. An empty
    benchmark hits nothing.
    """
    grams = store(benchmark_windows(benchmark, n), "bench-windows")
    docs = documents.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")
    ).withColumn("key", text_key(F.col("text")))
    # At most n lengths: the long windows, and those of short items.
    lengths = [r[0] for r in grams.select("len").distinct().collect()]
    hashed = docs.select(
        "doc_id", "key", _hashes(_words(F.col("text"))).alias("hs")
    )
    found = None
    for length in sorted(lengths):
        wanted = grams.where(F.col("len") == length).select("h").distinct()
        if wanted.limit(broadcast_rows + 1).count() <= broadcast_rows:
            wanted = F.broadcast(wanted)
        windows = F.transform(
            F.sequence(F.lit(1), F.size("hs") - length + 1),
            lambda i: F.xxhash64(F.slice("hs", i, length)),
        )
        rows = hashed.where(F.size("hs") >= length).select(
            "doc_id", "key", F.posexplode(windows).alias("pos", "h")
        ).join(wanted, "h")
        rows = rows.select("doc_id", "key", F.lit(length).alias("len"), "pos", "h")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = hashed.sparkSession.createDataFrame(
            [], "doc_id long, key long, len int, pos int, h long"
        )
    found = store(found, "bench-found")
    by_gram = grams.select("len", "h", "gram").distinct()
    per_doc = found.join(by_gram, ["len", "h"]).groupBy("doc_id", "key").agg(
        F.collect_set(F.struct((F.col("pos") + 1).alias("pos"), "len", "gram")).alias("hits")
    )
    joined = docs.alias("d").join(
        per_doc.alias("p"),
        F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & F.col("d.key").eqNullSafe(F.col("p.key")),
        "left",
    ).select("d.doc_id", "d.key", "hits", _words(F.col("text")).alias("w"))
    same = lambda e: F.array_join(F.slice("w", e["pos"], e["len"]), " ") == e["gram"]
    hits = F.when(F.col("hits").isNotNull(), F.filter("hits", same))
    return joined.select(
        "doc_id", "key", F.size("w").cast("long").alias("n_words"), hits.alias("hits")
    )


def _covered(hits: Column) -> Column:
    """The numbers, from 1, of the words inside any hit."""
    spans = F.transform(hits, lambda e: F.sequence(e["pos"], e["pos"] + e["len"] - 1))
    return F.array_distinct(F.flatten(spans))


def report(
    documents: DataFrame, benchmark: DataFrame, n: int = N, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row. Cases:
    see `scan`; a document without hits has the hash of the empty string."""
    scanned = scan(documents, benchmark, n, id_col=id_col, text_col=text_col).select(
        "doc_id", "key", "n_words",
        F.coalesce(F.size(_covered(F.col("hits"))), F.lit(0)).cast("long").alias("n_hit"),
        F.array_distinct(F.transform("hits", lambda e: e["gram"])).alias("grams"),
    ).withColumn("n_hit", F.greatest("n_hit", F.lit(0)))
    scanned = store(scanned, "bench-scanned")
    items = benchmark_windows(benchmark, n).select("gram", F.col("item_id").cast("string"))
    met = scanned.where(F.col("n_hit") > 0).select("doc_id", "key", F.explode("grams").alias("gram"))
    met = met.distinct().join(items, "gram").groupBy("doc_id", "key").agg(
        F.sort_array(F.collect_set("item_id")).alias("items")
    )
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return scanned.alias("d").join(
        met.alias("m"),
        F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & F.col("d.key").eqNullSafe(F.col("m.key")),
        "left",
    ).select(
        "d.doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """The rows of `documents` (doc_id, text and any other columns) that hold no window
    of the benchmark."""
    hit = scan(documents, benchmark, n).where(F.size("hits") > 0).select(
        F.col("doc_id").alias("_hit_id"), F.col("key").alias("_hit_key")
    )
    clean = rows(documents).join(
        store(hit.distinct(), "bench-hit"),
        F.col("row.doc_id").eqNullSafe(F.col("_hit_id"))
        & text_key(F.col("row.text")).eqNullSafe(F.col("_hit_key")),
        "left_anti",
    )
    return clean.select(columns_of(documents))

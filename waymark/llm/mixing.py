"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, rows, store, text_key

#: Sources take these weights in turn, by the code points of their names, null last.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 20240229
#: Hexadecimal digits of the seeded hash that make a slice of a source.
SLICE_DIGITS = 3
GAP = r"[\x20\x09-\x0D]+"
#: Behind every word that a gap follows.
WORD_END = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"


def word_count(text: Column) -> Column:
    words = F.filter(F.split(text, GAP), lambda w: w != "")
    return F.when(text.isNull(), 0).otherwise(F.size(words)).cast("long")


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of `sources` (source, source_size, weight): shares of the whole size by
    weight; a source stops at `max_epochs` times its size and what it leaves is shared
    again by weight until no source is above. The level, words per unit of weight, only
    rises, and each round clamps one more source at least."""
    cap = (F.col("source_size") * max_epochs).cast("double")
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level, clamped = (float(total) / weights if total else 0.0), 0
    while True:
        full = cap < F.col("weight") * F.lit(level)
        n, used, free = sources.agg(
            F.count_if(full), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if n == clamped or not free:
            break
        clamped, level = n, (total - used) / free
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def mix(
    documents: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """doc_id, key (hash of the text), size, source, source_size, target, taken of every row.

    A source whose target is r times its size gives each document floor(r) times whole.
    The rest goes to its documents in a seeded order until it is used up; the document
    at the end of it gives its first words only, so that a source's taken words add up
    to its target, rounded down. The order is that of a hash of id and size: reruns
    agree. A running total by slices of the hash keeps a hot source in many tasks.

    Null text has size 0; documents of size 0 are returned and give nothing; null is
    a source of its own; rows with one id are separate documents. An empty table
    gives an empty result.
    """
    order = F.md5(
        F.concat_ws(
            ":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
            F.col("size").cast("string"),
        ).cast("binary")
    )
    sized = documents.select(
        F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("key"), word_count(F.col(text_col)).alias("size"),
        F.col(source_col).alias("source"),
    ).withColumn("place", order)
    sized = store(
        sized.withColumn("slice", F.substring("place", 1, SLICE_DIGITS)), "mix-sizes"
    )
    slices = store(
        sized.groupBy("source", "slice").agg(F.sum("size").alias("slice_size")), "mix-slices"
    )
    sums = slices.groupBy("source").agg(F.sum("slice_size").alias("source_size"))
    # One row for each source: the only rows that are numbered across all of them.
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    turn = F.array(*[F.lit(w) for w in weights])
    sources = store(
        sums.withColumn("weight", F.get(turn, (rank - 1) % len(weights))), "mix-sources"
    )
    targets = water_fill(sources, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    whole = F.coalesce(whole, F.lit(0)).cast("long")
    extra = F.floor("target").cast("long") - whole * F.col("source_size")
    targets = targets.select(
        "source", "source_size", "target", whole.alias("whole"),
        F.greatest(extra, F.lit(0)).alias("extra"),
    )
    ahead = Window.partitionBy("source").orderBy("slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    slices = slices.withColumn("before", F.coalesce(F.sum("slice_size").over(ahead), F.lit(0)))
    plan = slices.alias("s").join(
        targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))
    ).select("s.source", "slice", "before", "source_size", "target", "whole", "extra")
    placed = sized.alias("d").join(
        plan.alias("p"),
        F.col("d.source").eqNullSafe(F.col("p.source"))
        & (F.col("d.slice") == F.col("p.slice")),
    ).select(
        "doc_id", "key", "size", "d.source", "place", "d.slice", "before", "source_size", "target",
        "whole", "extra",
    )
    earlier = Window.partitionBy("source", "slice").orderBy(
        "place", "doc_id", "size", "key"
    ).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(earlier), F.lit(0))
    part = F.greatest(F.least(F.col("size"), F.col("extra") - start), F.lit(0))
    return placed.select(
        "doc_id", "key", "size", "source", "source_size", "target",
        (F.col("whole") * F.col("size") + part).alias("taken"),
    )


def apply_mix(documents: DataFrame, mixed: DataFrame) -> DataFrame:
    """What `mixed`, made of `documents` (doc_id, text and any other columns), takes of
    them: a row for every whole repetition of a document, and one with its first words
    for what is left. With copy (from 1), size (words of the document), source_size,
    target and taken (words of the row, which add up to the targets of the sources,
    rounded down). n_chars becomes the new length, where there is that column."""
    same = Window.partitionBy("_id", "_key")
    docs = rows(documents).select(
        "row", F.col("row.doc_id").alias("_id"), text_key(F.col("row.text")).alias("_key")
    )
    docs = docs.withColumn("_no", F.row_number().over(same.orderBy(F.lit(0))))
    taken = mixed.select(
        F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "size", "source_size",
        "target", "taken",
    )
    taken = taken.withColumn("_no", F.row_number().over(same.orderBy(F.desc("taken"))))
    d, t = docs.alias("d"), taken.where(F.col("taken") > 0).alias("t")
    added = ("copy", "size", "source_size", "target", "taken")
    names = {c: c for c in added}
    for c in added:
        while names[c] in documents.columns:
            names[c] = f"mix_{names[c]}"
    joined = d.join(
        t,
        F.col("d._id").eqNullSafe(F.col("t._id")) & F.col("d._key").eqNullSafe(F.col("t._key"))
        & (F.col("d._no") == F.col("t._no")),
    ).select(
        "row", *[F.col(f"t.{c}").alias(c) for c in added[1:]],
        F.explode(F.sequence(F.lit(1), F.ceil(F.col("t.taken") / F.col("t.size")).cast("int"))).alias("copy"),
    )
    words = F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size"))
    partly = F.col("_words") < F.col("size")
    cut = F.array_join(F.slice(F.split("row.text", WORD_END), 1, F.col("_words").cast("int")), "")
    cut_text = joined.withColumn("_words", words).withColumn(
        "_text", F.when(partly, cut).otherwise(F.col("row.text"))
    ).withColumn("taken", F.col("_words"))
    changed = {"text": F.col("_text")}
    if "n_chars" in documents.columns:
        length = F.length("_text").cast(documents.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(partly, length).otherwise(F.col("row.n_chars"))
    return cut_text.select(
        *columns_of(documents, **changed), *[F.col(c).alias(names[c]) for c in added]
    )

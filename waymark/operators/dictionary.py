"""The word dictionary: words of all address texts with their frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.text import chunks, trigram_text
from waymark.plans.order import numbered
from waymark.plans.stage import measured, stage
from waymark.settings import DEFAULTS, SearchSettings


def count_words(texts: DataFrame) -> DataFrame:
    """(text) to (word, frequency). Words are the terms of the index: of a hyphenated one
    the parts and the whole. Equal ones are counted before they are taken apart."""
    whole = texts.select(F.explode(chunks(F.col("text"))).alias("chunk"))
    whole = whole.groupBy("chunk").agg(F.count(F.lit(1)).alias("times"))
    parts = F.split("chunk", "-")
    words = F.when(F.size(parts) > 1, F.concat(parts, F.array("chunk"))).otherwise(parts)
    return (
        whole.select(F.explode(words).alias("word"), "times")
        .groupBy("word")
        .agg(F.sum("times").alias("frequency"))
    )


def most_frequent(counted: DataFrame, size: int) -> DataFrame:
    """The first `size` words by falling frequency, then by word. Words are dealt out by
    ranges of that order; only the range in which the list ends is cut."""
    total = measured(counted)
    if total is not None and total <= size:
        return counted
    places = numbered(counted, [F.desc("frequency"), F.asc("word")], "word-places")
    return places.where(F.col("n") < size).drop("n")


def with_trigrams(words: DataFrame) -> DataFrame:
    """(word, frequency) with the trigram text and the length of each word."""
    return words.select(
        "word",
        trigram_text(F.col("word")).alias("trigramm"),
        "frequency",
        F.length("word").alias("len"),
    )


def build_dictionary(texts: DataFrame, settings: SearchSettings = DEFAULTS) -> DataFrame:
    """(text) to (word, frequency), at most `dictionary_size` words."""
    counted = stage(count_words(texts), "word-counts")
    return most_frequent(counted, settings.dictionary_size)

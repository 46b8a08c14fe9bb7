"""What is known about words, prepared once for many requests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.text import gram_bits, trigrams
from waymark.plans.stage import stage

GRAM_PARTS = 64


@dataclass(frozen=True)
class Lexicon:
    """prefixes: every prefix of a dictionary word (word, n_like, n_exact, freq);
    a whole word is a prefix of itself. full, short: abbreviations by their full
    and short names. gram_rows: one row per dictionary word and distinct trigram.
    grams: (gram, df, most), `most` being the most occurrences in one word."""

    prefixes: DataFrame
    full: DataFrame
    short: DataFrame
    gram_rows: DataFrame
    grams: DataFrame


def count_prefixes(dictionary: DataFrame) -> DataFrame:
    """Number of dictionary words that start with each prefix of any of them, and
    how often the prefix is itself a word (once at most), with its frequency."""
    ends = F.sequence(F.lit(1), F.length("word"))
    prefixes = F.transform(ends, lambda n: F.substr("word", F.lit(1), n))
    rows = dictionary.select(
        F.explode(prefixes).alias("prefix"), "word", "frequency"
    )
    whole = F.col("prefix") == F.col("word")
    return rows.groupBy(F.col("prefix").alias("word")).agg(
        F.count(F.lit(1)).alias("n_like"),
        F.count_if(whole).alias("n_exact"),
        F.max(F.when(whole, F.col("frequency"))).alias("freq"),
    )


def trigram_rows(dictionary: DataFrame) -> DataFrame:
    """One row per dictionary word and distinct trigram; `times` is how often the
    word has it. `repeats` is the number of trigrams that occur again in the word,
    and `bits0`... the digest of them all."""
    words = dictionary.select(
        F.col("word").alias("suggestion"),
        "frequency",
        F.length("word").alias("len"),
        trigrams(F.col("word")).alias("grams"),
    )
    words = words.withColumn("distinct", F.array_distinct("grams")).select(
        "*",
        (F.size("grams") - F.size("distinct")).alias("repeats"),
        *[b.alias(f"bits{i}") for i, b in enumerate(gram_bits(F.col("distinct")))],
    )
    rows = words.select("*", F.explode("distinct").alias("gram")).drop("distinct")
    times = F.when(
        F.col("repeats") > 0, F.size(F.filter("grams", lambda g: g == F.col("gram")))
    ).otherwise(1)
    return rows.withColumn("times", times)


def build_lexicon(dictionary: DataFrame, socrbase: DataFrame) -> Lexicon:
    """(word, frequency) and the abbreviations to a lexicon."""
    full = socrbase.groupBy(F.lower("socrname").alias("abbr")).agg(
        F.count(F.lit(1)).alias("n_socr"), F.max("scname").alias("scname")
    )
    short = socrbase.groupBy(F.lower("scname").alias("abbr")).agg(
        F.count(F.lit(1)).alias("n_socr_like")
    )
    # Each row meets many words, so the rows are spread over more tasks than their
    # size calls for.
    spread = dictionary.repartition(GRAM_PARTS, "word")
    rows = stage(trigram_rows(spread), "lexicon-gram-rows")
    grams = rows.groupBy("gram").agg(
        F.count(F.lit(1)).alias("df"), F.max("times").alias("most")
    )
    return Lexicon(
        prefixes=stage(count_prefixes(dictionary), "lexicon-prefixes"),
        full=stage(full, "lexicon-full"),
        short=stage(short, "lexicon-short"),
        gram_rows=rows.drop("times"),
        grams=stage(grams, "lexicon-grams"),
    )

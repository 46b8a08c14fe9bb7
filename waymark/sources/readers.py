"""Readers of registry files. They give all columns as text, under the upper-case
names of the files; `schemas.typed` casts them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions.text import trigram_text
from waymark.schemas import TableSpec

NULL_MARK = "NULL"
BACKSLASH = "\\"
ESCAPES = {"t": "\t", "n": "\n", "r": "\r"}  # what is written
# Letters that stand for control characters when read.
LETTERS = ESCAPES | {"b": "\b", "f": "\f", "v": "\v"}


def _letters() -> Column:
    return F.create_map(*[F.lit(x) for pair in LETTERS.items() for x in pair])


def unescape(raw: Column) -> Column:
    """Backslash escapes of tab-delimited parts, decoded from left to right: letters
    (b, f, n, r, t, v), up to three octal digits and `x` with up to two hexadecimal ones, which
    give a byte each, and any other character for itself. A lone backslash at the
    end gives nothing. Bytes that are no text fail the load."""
    token = r"(?s)\\x[0-9A-Fa-f]{1,2}|\\[0-7]{1,3}|\\.|\\$|[^\\]+"

    def coded(piece: Column) -> Column:
        """The bytes of a piece, in hexadecimal."""
        body = F.substr(piece, F.lit(2))
        octal = F.conv(body, 8, 10).cast("int").bitwiseAND(F.lit(255))
        letter = F.try_element_at(_letters(), body)
        return (
            F.when(~piece.startswith(BACKSLASH), F.hex(F.encode(piece, "UTF-8")))
            .when(body.rlike("^x[0-9A-Fa-f]"), F.lpad(F.substr(piece, F.lit(3)), 2, "0"))
            .when(body.rlike("^[0-7]"), F.lpad(F.hex(octal), 2, "0"))
            .otherwise(F.hex(F.encode(F.coalesce(letter, body), "UTF-8")))
        )

    pieces = F.regexp_extract_all(raw, F.lit(token), F.lit(0))
    decoded = F.decode(F.unhex(F.array_join(F.transform(pieces, coded), "")), "UTF-8")
    return F.when(F.contains(raw, F.lit(BACKSLASH)), decoded).otherwise(raw)


def escape(value: Column) -> Column:
    """The inverse: the text of a field, with nulls marked."""
    text = F.replace(value, F.lit(BACKSLASH), F.lit(BACKSLASH * 2))
    for letter, plain in ESCAPES.items():
        text = F.replace(text, F.lit(plain), F.lit(BACKSLASH + letter))
    text = F.when(text == NULL_MARK, BACKSLASH + NULL_MARK).otherwise(text)
    return F.coalesce(text, F.lit(NULL_MARK))


def read_tsv(spark: SparkSession, paths: str, spec: TableSpec) -> DataFrame:
    """Tab-delimited parts without header or quotes. An empty field is an empty
    string; a row with another number of fields fails the load."""
    names = [field.name for field in spec.text_schema]
    # A tab after a single backslash is part of its field. Pairs of backslashes count from
    # the left, so between them a backslash before a tab stands alone.
    pieces = F.split("value", r"\\\\")
    plain = F.transform(pieces, lambda p: F.replace(p, F.lit(BACKSLASH + "\t"), F.lit(BACKSLASH + "t")))
    fields = F.split(F.array_join(plain, BACKSLASH * 2), "\t")
    wrong = F.raise_error(F.concat(F.lit(f"not {len(names)} fields: "), F.col("value")))
    rows = spark.read.option("lineSep", "\n").text(paths).select(
        F.when(F.size(fields) == len(names), fields).otherwise(wrong).alias("raw")
    )
    columns = []
    for i, name in enumerate(names):
        raw = F.col("raw")[i]
        columns.append(F.when(raw != NULL_MARK, unescape(raw)).alias(name))
    return rows.select(columns)


def read_xml(spark: SparkSession, paths: str, spec: TableSpec) -> DataFrame:
    """One row per element; the values are its attributes. An attribute that is
    absent is null. Elements of other names are passed over.

    The files are cut at the starts of the row elements, so that a large one is read
    by many tasks: `<` stands nowhere in a value, so no cut can lie within one. What
    could hide such a start, a comment or a CDATA section that reaches over it, fails the
    load, as does an element that is not well-formed."""
    names = [field.name for field in spec.text_schema]
    schema = T.StructType([T.StructField("_" + name, T.StringType()) for name in names])
    start = "<" + spec.row_tag
    cuts = spark.read.option("lineSep", start).text(paths).select("value")
    # Of a longer name, and what stands before the first element.
    cuts = cuts.where(F.col("value").rlike(r"^[\s/>]") & ~F.col("value").rlike(r"^\s*<"))
    attributes = r"""^((?:[^<>"']++|"[^<"]*+"|'[^<']*+')*+)>"""
    inner = F.regexp_extract("value", attributes, 1)
    hides = F.col("value").rlike(r"(?s)<!(?:--|\[CDATA\[)(?!.*(?:-->|\]\]>))")
    wrong = F.raise_error(F.concat(F.lit(f"not a whole element {spec.row_tag}: "), F.substring("value", 1, 200)))
    element = F.concat(F.lit(start), F.regexp_replace(inner, r"/$", ""), F.lit("/>"))
    options = {"attributePrefix": "_", "mode": "FAILFAST", "ignoreSurroundingSpaces": "false"}
    whole = F.col("value").rlike(attributes) & ~hides
    rows = cuts.select(F.when(whole, element).otherwise(wrong).alias("element"))
    rows = rows.select(F.from_xml("element", schema, options).alias("row"))
    return rows.select([F.col(f"row._{name}").alias(name) for name in names])


def read_dictionary_text(
    spark: SparkSession, paths: str, on_bad: str = "raise"
) -> DataFrame:
    """Lines of `word frequency` to (word, trigramm, frequency). A line without
    both fails the load, or is left out with `on_bad="skip"`."""
    parts = F.split("value", " ")
    word, frequency = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    lines = spark.read.text(paths).select("value", word.alias("word"), frequency.alias("freq"))
    good = (F.length("word") > 0) & (F.coalesce(F.length("freq"), F.lit(0)) > 0)
    if on_bad == "skip":
        lines = lines.where(good)
    else:
        wrong = F.raise_error(F.concat(F.lit("not a word and its frequency: "), F.col("value")))
        lines = lines.withColumn("word", F.when(good, F.col("word")).otherwise(wrong))
    return lines.select(
        "word",
        trigram_text(F.col("word")).alias("trigramm"),
        F.col("freq").cast("bigint").alias("frequency"),
    )

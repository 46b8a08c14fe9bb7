"""Text expressions. All are built-in Spark columns; none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators of a request, and the characters of an index term.
PHRASE_SEPARATORS = "[ ,:.#$]+"
TERM = "[0-9a-z_а-я]+"
CHUNK = TERM + "(?:-" + TERM + ")*"


def split_phrase(text: Column) -> Column:
    """Words of a request, lower case; may hold empty strings."""
    return F.split(F.lower(text), PHRASE_SEPARATORS)


def clean_word(word: Column) -> Column:
    return F.btrim(F.translate(word, "@#", ""), F.lit("-"))


def trigrams(word: Column) -> Column:
    """Overlapping three-character slices of the word padded by two `_`."""
    padded = F.concat(F.lit("__"), word, F.lit("__"))
    starts = F.sequence(F.lit(1), F.length(padded) - 2)
    return F.transform(starts, lambda i: F.substr(padded, i, F.lit(3)))


DIGEST = 4  # numbers of 64 bits in a digest


def gram_bits(grams: Column) -> list[Column]:
    """A digest of trigrams: one bit for each, by its hash, over DIGEST numbers."""
    one = F.lit(1).cast("bigint")

    def number(i: int) -> Column:
        def add(bits: Column, gram: Column) -> Column:
            place = F.pmod(F.xxhash64(gram), F.lit(64 * DIGEST)).cast("int") - 64 * i
            bit = F.call_function("shiftleft", one, place)
            return F.when(place.between(0, 63), bits.bitwiseOR(bit)).otherwise(bits)

        return F.aggregate(grams, F.lit(0).cast("bigint"), add)

    return [number(i) for i in range(DIGEST)]


def trigram_text(word: Column) -> Column:
    return F.array_join(trigrams(word), " ")


def fold(text: Column) -> Column:
    """Case and yo folding of the index; `@` is ignored altogether."""
    return F.translate(F.lower(text), "ё@", "е")


def tokenize(text: Column) -> Column:
    """Index terms of a text, in order."""
    return F.regexp_extract_all(fold(text), F.lit(TERM), F.lit(0))


def chunks(text: Column) -> Column:
    """Index terms of a text, with words joined by hyphens left whole."""
    return F.regexp_extract_all(fold(text), F.lit(CHUNK), F.lit(0))


def index_terms(text: Column) -> Column:
    """`array<struct<term, pos>>`: the terms of a text with their positions, and
    each hyphenated word once more as a whole, at the position of its start."""
    # Each part of a chunk, the last with the whole where there are several; then the place
    # of a part in the flat list is its position. Linear in the length of the text.
    def parts(chunk: Column) -> Column:
        words = F.split(chunk, "-")
        last = F.size(words) - 1
        return F.transform(words, lambda w, i: F.struct(
            w.alias("term"), F.when((i == last) & (last > 0), chunk).alias("whole"), last.alias("last")
        ))

    def placed(part: Column, i: Column) -> Column:
        plain = F.struct(part["term"].alias("term"), i.alias("pos"))
        whole = F.struct(part["whole"].alias("term"), (i - part["last"]).alias("pos"))
        return F.when(part["whole"].isNull(), F.array(plain)).otherwise(F.array(plain, whole))

    joined = F.flatten(F.transform(F.flatten(F.transform(chunks(text), parts)), placed))
    plain = F.transform(
        chunks(text), lambda w, i: F.struct(w.alias("term"), i.alias("pos"))
    )
    return F.when(text.contains("-"), joined).otherwise(plain)


def count_spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))

"""Texts with HTML markup, as the index takes them: a column expression, no UDF.

The text is cut from left to right into comments, declarations, tags, entities and the
text between. Tags of inline elements go without a trace, other markup leaves a space;
known entities become their characters. What only looks like markup stays."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: elements whose tags do not separate words.
INLINE = (
    "a b i s u basefont big em font img label small span strike strong sub sup tt"
).split()

# Each alternative can end in one way only, so nothing is tried twice. Markup without its
# end takes the rest of the text.
COMMENT = r"<!--.*?(?:-->|\z)"
DECLARATION = r"<[!?][^>]*(?:>|\z)"
QUOTED_TAG = r"""</?[A-Za-z](?:[^>"']{0}|"[^"]*{0}"|'[^']*{0}')*{0}(?:>|\z)"""
OPEN_TAG = r"</?[A-Za-z][^>]*(?:>|\z)"
ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,7});"


def pattern(possessive: str = "+") -> str:
    """What a piece of text is. Possessive loops spare the JVM its stack."""
    tag = QUOTED_TAG.format(possessive)
    if possessive:
        tag = tag.replace("""[^>"']+|""", """[^>"']++|""")
    return f"(?s)(?:{COMMENT}|{DECLARATION}|{tag}|{OPEN_TAG}|{ENTITY}|[^<&]+|[<&])"


def _character(code: Column, piece: Column) -> Column:
    """The character of a code point; the piece as it is if there is none."""
    real = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    utf32 = F.unhex(F.lpad(F.hex(F.when(real, code)), 8, "0"))
    return F.coalesce(F.decode(utf32, "UTF-32"), piece)


def _plain(piece: Column) -> Column:
    names = F.create_map(*[F.lit(x) for k, n in name2codepoint.items() for x in (k, chr(n))])
    name = F.regexp_extract(piece, r"^&([A-Za-z][A-Za-z0-9]*);$", 1)
    decimal = F.regexp_extract(piece, "^&#([0-9]+);$", 1)
    hexadecimal = F.regexp_extract(piece, "^&#[xX]([0-9A-Fa-f]+);$", 1)
    element = F.lower(F.regexp_extract(piece, "^</?([A-Za-z][A-Za-z0-9]*)", 1))
    entity = (
        F.when(name != "", F.coalesce(F.try_element_at(names, name), piece))
        .when(decimal != "", _character(decimal.try_cast("bigint"), piece))
        .when(hexadecimal != "", _character(F.conv(hexadecimal, 16, 10).cast("bigint"), piece))
        .otherwise(piece)
    )
    markup = F.when(element.isin(INLINE), "").when(piece == "<", piece).otherwise(" ")
    return F.when(piece.startswith("&"), entity).when(piece.startswith("<"), markup).otherwise(piece)


def strip_markup(text: Column) -> Column:
    pieces = F.regexp_extract_all(text, F.lit(pattern()), F.lit(0))
    stripped = F.array_join(F.transform(pieces, _plain), "")
    return F.when(text.contains("<") | text.contains("&"), stripped).otherwise(text)

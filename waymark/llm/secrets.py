"""Secrets in texts, with column expressions only.

Base spans come from three fixed patterns. Beyond them, candidate strings (runs of at least 20
characters that keys are written with) are judged by their Shannon entropy: a window slides
along the candidate, the counts of the characters in it change by the one that enters and the
one that leaves, and so does the sum of n * log2(n) over the counts. If the window of least sum is
even enough for the candidate's character class, the candidate is a span of kind `entropy`.
Strings that the allow list knows are left alone: identifiers of fixed form, alphabets and rows
of digits, placeholders, words and numbers joined by signs, and the caller's own values. The allow
list takes away no base span. A candidate that overlaps a base span is reported by that alone.

The work per text is linear in its length up to a factor of the window or the alphabet; running sums
over the matches of one text are taken in blocks of the square root of their number.

Defined results. A null or empty text has no span. Offsets are code points, the end exclusive.
Only ASCII letters match in either case. Every row has its row in the result, repeated rows and
null ids as well; an empty table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns.
ASSIGN = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6
KINDS = ["assign", "access", "hex", "entropy"]

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Character classes, the narrowest first: pattern of the candidate, alphabet, characters
#: in the window, and the bits of entropy per character that a window of a secret has.
CLASSES = [
    (r"^[0-9]+$", _DIGITS, 20, math.inf),
    (r"^([0-9a-f]+|[0-9A-F]+)$", _DIGITS + "abcdefABCDEF", 20, 3.0),
    (r"^[A-Za-z]+$", _LOWER + _LOWER.upper(), 20, 4.1),
    (r"", _DIGITS + _LOWER + _LOWER.upper() + "+/_=-", 20, 3.7),
]
#: A candidate in which one of these is found is no secret.
ALLOWED = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)abcdefghij|0123456789|1234567890|example|placeholder|dummy|x{6,}",
    r"^[+/_=-]*([A-Za-z]?[a-z]+|[A-Z]+|[0-9]{1,8})([+/_=-]+([A-Za-z]?[a-z]+|[A-Z]+|[0-9]{1,8}))*[+/_=-]*$",
]
#: Sums of n * log2(n) are whole numbers of this unit, so that they are exact.
UNIT = 1 << 20


def n_log_n(n: int) -> int:
    return round(n * math.log2(n) * UNIT) if n else 0


def limit(window: int, bits: float) -> int:
    """The greatest sum over the counts of a window that has `bits` of entropy."""
    return -1 if bits == math.inf else math.floor(window * (math.log2(window) - bits) * UNIT)


def _placed(df: DataFrame, name: str, text: str, pattern: str) -> DataFrame:
    """`df` with the columns `name`, an array of (at, value) for the matches of `pattern` in
    the column `text`, and `name`_gaps, the pieces of text around them."""
    found = F.col(text).rlike(pattern)
    none = F.array().cast("array<string>")
    out = df.withColumns({
        "hits": F.when(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none),
        f"{name}_gaps": F.when(found, F.split(text, pattern, -1)).otherwise(F.array(F.col(text))),
    })
    # A match begins where the gaps and the matches before it end: running sums, in blocks
    # of the square root of their number. Arrays are arguments of the functions, never
    # taken from around a lambda: the optimizer may put what makes them into it.
    out = out.withColumn("steps", F.expr(
        f"zip_with(slice({name}_gaps, 1, size(hits)), slice(concat(array(''), hits), 1, size(hits)), "
        "(g, h) -> cast(char_length(g) + char_length(h) AS bigint))"
    ))
    out = out.withColumn("block", F.expr("greatest(1, cast(ceil(sqrt(size(steps))) AS int))"))
    out = out.withColumn("blocks", F.expr(
        "transform(sequence(0, greatest(1, cast(ceil(size(steps) / block) AS int)) - 1), "
        "i -> slice(steps, i * block + 1, block))"
    ))
    running = "aggregate({0}, array({1}), (a, x) -> concat(a, array(element_at(a, -1) + {2})))"
    sums = running.format("blocks", "0L", "aggregate(x, 0L, (s, y) -> s + y)")
    out = out.withColumn("before", F.expr(sums))
    inner = running.format("b", "first", "x")
    out = out.withColumn("at", F.expr(
        f"flatten(zip_with(blocks, slice(before, 1, size(blocks)), (b, first) -> slice({inner}, 2, size(b))))"
    ))
    out = out.withColumn(
        name, F.expr("zip_with(hits, at, (m, place) -> named_struct('at', place, 'value', m))")
    )
    return out.drop("hits", "steps", "block", "blocks", "before", "at")


def _least_sum() -> str:
    """Of a candidate c with `signs` (places of its characters in the alphabet) and `shape`:
    the least sum of n * log2(n) over its windows. The state is the counts of the window,
    their sum, and the least sum of a full window so far."""
    table = ", ".join(f"{n_log_n(n)}L" for n in range(max(c[2] for c in CLASSES) + 1))
    value = f"element_at(array({table}), {{0}} + 1)"
    enters, leaves = "c.signs[i - 1]", "c.signs[i - 1 - c.shape.width]"
    more, less = f"s.counts[{enters} - 1]", f"s.counts[{leaves} - 1]"
    gain = f"{value.format(more + ' + 1')} - {value.format(more)}"
    loss = f"{value.format(less)} - {value.format(less + ' - 1')}"
    total = f"""s.total + CASE WHEN i <= c.shape.width THEN {gain}
                               WHEN {enters} = {leaves} THEN 0L ELSE {gain} - ({loss}) END"""
    left = f"IF(i > c.shape.width, {leaves}, 0)"
    return f"""
      aggregate(
        sequence(1, size(c.signs)),
        named_struct('counts', array_repeat(0, char_length(c.shape.alphabet)),
                     'total', 0L, 'least', {2**62}L),
        (s, i) -> named_struct(
          'counts', transform(s.counts, (n, j) -> n + IF(j + 1 = {enters}, 1, 0) - IF(j + 1 = {left}, 1, 0)),
          'total', {total},
          'least', IF(i >= c.shape.width, least(s.least, {total}), s.least)),
        s -> s.least)"""


def _shape(value: Column) -> Column:
    """The character class of a candidate: (alphabet, width, most)."""
    out = None
    for pattern, alphabet, width, bits in reversed(CLASSES):
        shape = F.struct(
            F.lit(alphabet).alias("alphabet"), F.lit(width).alias("width"),
            F.lit(limit(width, bits)).cast("bigint").alias("most"),
        )
        out = shape if out is None else F.when(value.rlike(pattern), shape).otherwise(out)
    return out


def find_secrets(
    documents: DataFrame, allow: list[str] | None = None, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, secrets) per row of `documents`: an array of (start, no, kind, end, value) in
    order of start and kind. `allow` is a list of further values that are no secrets."""
    doc = documents.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    doc = _placed(doc, "assign", "text", ASSIGN)
    long_enough = lambda m: F.char_length(F.regexp_extract(m["value"], ASSIGN, 1)) >= LEAST_VALUE
    # Candidates lie outside the assignments found: those are blank, the rest stays in place.
    blank = F.transform("assign", lambda m: F.when(
        long_enough(m), F.repeat(F.lit(" "), F.char_length(m["value"]))).otherwise(m["value"]))
    doc = doc.withColumn("blank", blank)
    masked = F.expr("array_join(zip_with(assign_gaps, blank, (g, b) -> concat(g, coalesce(b, ''))), '')")
    doc = doc.withColumn("masked", masked).withColumn("assign", F.filter("assign", long_enough))
    doc = _placed(doc.drop("assign_gaps", "blank"), "candidate", "masked", CANDIDATE)
    doc = doc.drop("masked", "candidate_gaps")
    for name, pattern in (("access", ACCESS), ("hex", HEX)):
        doc = _placed(doc, name, "text", pattern).drop(f"{name}_gaps")

    def open_(c: Column) -> Column:
        known = c["value"].rlike(ACCESS) | c["value"].rlike(HEX)
        for pattern in ALLOWED:
            known = known | c["value"].rlike(pattern)
        return ~(known | c["value"].isin(allow)) if allow else ~known

    doc = doc.withColumn("judged", F.transform(F.filter("candidate", open_), lambda c: F.struct(
        c["at"].alias("at"), c["value"].alias("value"), _shape(c["value"]).alias("shape"))))
    signs = "transform(split(c.value, ''), x -> instr(c.shape.alphabet, x))"
    doc = doc.withColumn("judged", F.expr(f"""
      transform(filter(judged, c -> c.shape.most >= 0),
                c -> named_struct('at', c.at, 'value', c.value, 'shape', c.shape, 'signs', {signs}))"""))
    doc = doc.withColumn("entropy", F.expr(f"filter(judged, c -> {_least_sum()} <= c.shape.most)"))
    spans = [
        F.expr(f"""
          transform({kind}, m -> named_struct(
            'start', m.at, 'no', {i}, 'kind', '{kind}', 'end', m.at + char_length(m.value), 'value', m.value))""")
        for i, kind in enumerate(KINDS)
    ]
    return doc.select("doc_id", F.array_sort(F.concat(*spans)).alias("secrets"))


def report(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `documents`: n_assign, n_access, n_hex, base_sha256 (of the base spans as
    kind:start:end, joined by commas) and spans (all of them, joined likewise)."""
    found = find_secrets(documents, None, id_col, text_col)
    written = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("secrets", lambda s: s["kind"] != "entropy")
    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(written(base), 256).alias("base_sha256"), written(F.col("secrets")).alias("spans"),
    )

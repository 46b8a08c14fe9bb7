"""Near-duplicate lines: minwise signatures of character shingles, banding with a high
recall, exact verification, and components of which one line stays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, columns_of, for_python, rows, rows_of, store, together
from .linking import LANE_BITS, LANES, draws, link, sketches

#: Characters of a shingle, of the line in lower case with single spaces.
CHARS = 5
#: Similar lines share one of the bands at least with a probability over 0.999 at 0.8.
BANDS, ROWS = 10, 3
PERCENT = 80
LEVELS = 4
#: Characters that are hashed at a time, about.
CACHED = 1 << 17
#: Characters of the pairs that are compared at a time, about.
PAIRED = 1 << 18
_A = 0x9E3779B97F4A7C15
_ODD = np.random.default_rng(77).integers(0, 2**31, 2 * LANES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def normal(line: str) -> str:
    return " ".join(line.split()).lower()


def _shift(h: np.ndarray, other: np.ndarray, by: int) -> np.ndarray:
    """Hashes of windows made of those in `h` and, `by` characters on, those in `other`."""
    m = min(len(h), len(other) - by)
    power = np.uint64(pow(_A, by, 1 << 64))
    return h[:m] * power + other[by : by + m]


def signatures(lines: list[str]) -> np.ndarray:
    """2 * LANES minwise values of the shingles of each of `lines`, none of them empty. A
    line of fewer than CHARS characters is one shingle, filled up with marks."""
    # Some lines at a time, whose hashes stay in the processor's cache.
    parts = [_least(some) for _, some in blocks(lines, CACHED)]
    # The low bits make the sketch.
    out = np.concatenate(parts).astype(np.uint64) * np.uint64(_A)
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _least(lines: list[str]) -> np.ndarray:
    """The least values of `lines` in 2 * LANES orders of 32 bits."""
    padded = [x + "\0" * (CHARS - len(x)) for x in lines]
    joined = "".join(padded).encode("utf-32-le", "surrogatepass")
    one = np.frombuffer(joined, dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    two = _shift(one, one, 1)
    four = _shift(two, two, 2)
    five = _shift(four, one, 4)  # CHARS
    five = (five ^ (five >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    length = np.array([len(x) for x in padded])
    end = np.cumsum(length)
    # Windows that reach into the next line are left out.
    over = (end[:-1, None] - np.arange(1, CHARS)).ravel()
    inside = np.ones(len(five), dtype=bool)
    inside[over] = False
    kept = (five[inside] >> np.uint64(32)).astype(np.uint32)
    # Every value is the least of an order of its own: a short line's values are as
    # independent as a long one's, which the sketch filter and the bands build on.
    count = length - CHARS + 1
    first = np.cumsum(count) - count
    out = np.empty((2 * LANES, len(lines)), dtype=np.uint32)
    for i, odd in enumerate(_ODD):
        out[i] = np.minimum.reduceat(kept * odd, first)
    return out.T


def lines_of(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key, line_no (from 0), d1, d2 (digest of the normal line) of every line that
    is not blank; bands, s1 and s2 stand at the first of equal lines in a block, at the
    others bands are null."""
    docs = for_python(documents).select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("key"),
        F.col(text_col).alias("text"),
    ).where(F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc_id").cast(pa.int64()), batch.column("key")
            for at, some in blocks(batch.column("text").to_pylist()):
                owner, number, place, known = [], [], [], {}
                for i, text in enumerate(some):
                    for k, line in enumerate(text.split("\n")):
                        line = normal(line)
                        if line:
                            owner.append(at + i)
                            number.append(k)
                            place.append(known.setdefault(line, len(known)))
                if not known:
                    continue
                different = list(known)
                digest = np.frombuffer(
                    b"".join(xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in different),
                    dtype=np.int64,
                ).reshape(-1, 2)
                values = signatures(different)
                bands = np.zeros((len(values), BANDS), dtype=np.uint64)
                for r in range(ROWS):
                    bands = (bands ^ values[:, r : ROWS * BANDS : ROWS]) * np.uint64(_A)
                    bands ^= bands >> np.uint64(32)
                bands += np.arange(BANDS, dtype=np.uint64)
                place_, owner_ = np.array(place), pa.array(owner, pa.int64())
                # Lines are numbered as they come: a number above all before is a new one.
                new = place_ > np.concatenate([[-1], np.maximum.accumulate(place_)[:-1]])
                sketch = [np.zeros(len(place), dtype=np.int64) for _ in range(2)]
                for column, x in zip(sketch, sketches(values), strict=True):
                    column[new] = x
                ends = np.concatenate([[0], np.cumsum(new) * BANDS]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(owner_), keys.take(owner_), pa.array(number, pa.int64()),
                        pa.array(digest[place_, 0]), pa.array(digest[place_, 1]),
                        pa.ListArray.from_arrays(
                            pa.array(ends), pa.array(bands.view(np.int64).ravel()), mask=pa.array(~new)
                        ),
                        *map(pa.array, sketch),
                    ],
                    names=["doc_id", "key", "line_no", "d1", "d2", "bands", "s1", "s2"],
                )

    return docs.mapInArrow(
        run,
        "doc_id long, key long, line_no long, d1 long, d2 long, bands array<long>, s1 long, s2 long",
    )


def classes(
    documents: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, key (hash of the text), line_no (from 0), keep_doc_id, keep_line_no, kept of
    every line that is not blank.

    Lines are compared in lower case with single spaces, as sets of CHARS-character
    shingles; a shorter line is one shingle. Lines with a Jaccard similarity of `percent`
    or more are linked, and of what hangs together the first line, by doc_id (null last)
    and number, is kept. Blank lines and null texts have no rows. Rows equal in id and
    text are one document. (Of lines whose digests agree in one half but not in the
    other, some may find their equals only; below billions of lines there are none.)
    """
    rows = store(lines_of(documents, id_col, text_col), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "line_no", "key")
    equal = store(rows.groupBy("d1", "d2").agg(F.min(place).alias("place")), "lines-equal")
    signed = rows.where(F.col("bands").isNotNull())
    members = signed.select(
        F.explode("bands").alias("node"), F.col("d1").alias("id"), F.lit(1).cast("long").alias("n"), "s1", "s2"
    )
    infos = signed.groupBy(F.col("d1").alias("id")).agg(
        F.lit(1).cast("long").alias("n"), F.min("s1").alias("s1"), F.min("s2").alias("s2")
    )

    def branch(many: DataFrame, level: int) -> DataFrame:
        # The lanes of the sketch are the minwise values that are selected.
        def bits(i: Column) -> Column:
            value = F.when(i < LANES, F.col("s1")).otherwise(F.col("s2"))
            shift = (F.pmod(i, F.lit(LANES)) * LANE_BITS).cast("int")
            moved = F.call_function("shiftrightunsigned", value, shift)
            return moved.bitwiseAND(F.lit((1 << LANE_BITS) - 1))

        return many.join(infos, "id").select(
            "node", "id", "s1", "s2",
            F.explode(draws(level, percent, 2 * LANES)).alias("places"),
        ).select(F.xxhash64("node", "places", F.transform("places", bits)).alias("node"), "id")

    fetched: list[DataFrame] = []

    def whole(ids: DataFrame) -> DataFrame:
        wanted = ids.select(F.col("id").alias("d1")).distinct()
        if fetched:
            known = together(fetched).select(F.col("id").alias("d1"))
            wanted = wanted.join(known, "d1", "left_anti")
        wanted = store(wanted, "lines-wanted")
        if not fetched or not wanted.isEmpty():
            named = wanted.join(equal, "d1").select(
                F.col("d1").alias("id"), F.col("place.doc_id").alias("_doc"),
                F.col("place.key").alias("_key"), F.col("place.line_no").cast("int").alias("_no"),
            )
            texts = rows_of(documents, named, id_col, text_col)
            line = F.get(F.split("text", "\n"), F.col("_no"))
            some = texts.select("id", line.alias("body")).groupBy("id").agg(F.min("body").alias("body"))
            fetched.append(store(some.withColumn("weight", F.length("body")), "lines-text"))
        return together(fetched)

    def verify(pairs: DataFrame) -> DataFrame:
        known = whole(pairs.select(F.col("a").alias("id")).union(pairs.select("b")))
        return _similar(pairs, known, percent)

    def decode(bodies: list) -> list[np.ndarray]:
        code, bounds = shingle_sets(bodies)
        return np.split(code, bounds[1:-1])

    found = link(members, infos, verify, whole, decode, branch, percent, LEVELS)
    part = found.withColumnRenamed("node", "d1").join(equal, "d1")
    first = part.groupBy("root").agg(F.min("place").alias("first"))
    linked = found.withColumnRenamed("node", "d1").join(first, "root").select("d1", "first")
    # Of the lines that are linked with none each is its own first.
    named = equal.join(linked, "d1", "left").select(
        "d1", "d2", F.coalesce("first", "place").alias("first")
    )
    return rows.select("doc_id", "key", "line_no", "d1", "d2").join(named, ["d1", "d2"]).select(
        "doc_id", "key", "line_no", F.col("first.doc_id").alias("keep_doc_id"),
        F.col("first.line_no").alias("keep_line_no"),
        (
            F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
            & (F.col("line_no") == F.col("first.line_no")) & (F.col("key") == F.col("first.key"))
        ).alias("kept"),
    )


def _shingles(line: str) -> set[str]:
    """What `shingle_sets` holds of one line, as text."""
    x = normal(line)
    return {x[i : i + CHARS] for i in range(max(1, len(x) - CHARS + 1))}


def shingle_sets(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of all `lines`, those of one line side by side and in order,
    as numbers that agree between lines, and the place where each line's begin and end.
    Numbers are made of the places of the characters among those that occur, so different
    shingles never share one."""
    # No normal line holds a line break: it fills up lines that are shorter than a shingle.
    padded = [x + "\n" * (CHARS - len(x)) for x in map(normal, lines)]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    length = np.array([len(x) for x in padded], dtype=np.int64)
    owner = np.repeat(np.arange(len(padded)), length)
    end = np.cumsum(length)
    inside = np.ones(len(points), dtype=bool)
    inside[(end[:, None] - np.arange(1, CHARS)).ravel()] = False
    letters = np.bincount(points) > 0
    one = (np.cumsum(letters) - 1)[points]
    at, kinds = np.flatnonzero(inside), int(letters.sum())
    code, total = one[at], kinds
    for i in range(1, CHARS):
        code, total = _room(code, total, kinds)
        code, total = code * kinds + one[at + i], total * kinds
    code, total = _room(code, total, len(padded) + 1)
    keys = np.sort(owner[at] * total + code)
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return keys % total, np.searchsorted(keys, np.arange(len(padded) + 1) * total)


def _room(code: np.ndarray, total: int, times: int) -> tuple[np.ndarray, int]:
    """Numbers below `total` that may be multiplied by `times`: their ranks, if need be."""
    if total * times < 1 << 62:
        return code, total
    different, code = np.unique(code, return_inverse=True)
    return code, len(different)


def similar(x: list[str], y: list[str], percent: int) -> np.ndarray:
    """Whether each line of `x` and the one of `y` at its place have a Jaccard similarity of
    `percent` or more."""
    number: dict[str, int] = {}
    one = np.array([number.setdefault(t, len(number)) for t in x])
    two = np.array([number.setdefault(t, len(number)) for t in y])
    code, bounds = shingle_sets(list(number))
    size = np.diff(bounds)
    total = int(code.max()) + 1
    # Sizes may rule a pair out; the shingles of the others' smaller line are looked up in
    # the larger one's.
    low, high = np.where(size[one] <= size[two], (one, two), (two, one))
    near = np.flatnonzero(100 * size[low] >= percent * size[high])
    count = size[low[near]]
    first = np.cumsum(count) - count
    asked = code[np.arange(count.sum()) + np.repeat(bounds[low[near]] - first, count)]
    keys = np.repeat(np.arange(len(size)), size) * total + code
    wanted = np.repeat(high[near], count) * total + asked
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    met = np.concatenate([[0], np.cumsum(keys[place] == wanted)])
    shared = met[first + count] - met[first]
    out = np.zeros(len(x), dtype=bool)
    out[near] = 100 * shared >= percent * (count + size[high[near]] - shared)
    return out


def _similar(pairs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    both = pairs.join(
        lines.select(F.col("id").alias("a"), F.col("body").alias("x")), "a"
    ).join(lines.select(F.col("id").alias("b"), F.col("body").alias("y")), "b")

    @F.pandas_udf("boolean")
    def enough(x: pd.Series, y: pd.Series) -> pd.Series:
        one, two, out = x.tolist(), y.tolist(), []
        for at, some in blocks([p + q for p, q in zip(one, two, strict=True)], PAIRED):
            end = at + len(some)
            out.append(similar(one[at:end], two[at:end], percent))
        return pd.Series(np.concatenate(out) if out else [], dtype=bool)

    return for_python(both).where(enough("x", "y")).select("a", "b")


def drop_repeated(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """`documents` (doc_id, text and any other columns) without the lines that are not
    kept, and without the blank lines those leave at either end. A row loses its place
    if it had lines and keeps none; blank and null texts stay as they are. n_chars
    becomes the new length, where there is that column."""
    gone = store(classes(documents, percent), "lines-classes").groupBy("doc_id", "key").agg(
        F.collect_set(F.when(~F.col("kept"), F.col("line_no").cast("int"))).alias("_gone"),
        F.max("kept").alias("_any"),
    ).select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), "_gone", "_any")
    joined = rows(documents).join(
        gone,
        F.col("row.doc_id").eqNullSafe(F.col("_doc"))
        & F.xxhash64("row.text").eqNullSafe(F.col("_key")),
        "left",
    ).where(F.coalesce("_any", F.lit(True)))
    left = F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains("_gone", i))
    text = F.when(
        F.size("_gone") > 0, F.regexp_replace(F.array_join(left, "\n"), r"^\n+|\n+$", "")
    ).otherwise(F.col("row.text"))
    changed = {"text": F.col("_text")}
    if "n_chars" in documents.columns:
        changed["n_chars"] = F.length("_text").cast(documents.schema["n_chars"].dataType)
    return joined.withColumn("_text", text).select(columns_of(documents, **changed))

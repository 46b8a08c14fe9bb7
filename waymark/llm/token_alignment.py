"""Alignment of two tokenizers by the bytes that their tokens cover.

A block of texts is laid out on one axis of bytes. Each tokenizer gives an incidence matrix
of tokens by bytes, kept as compressed sparse rows (CSR) built here by hand. Row products
after Gustavson give the links: A·Bᵀ holds for each pair of tokens the bytes that both
cover. Where a pair's last bytes agree, both texts are cut there; the tokens between two cuts
are a group, and the incidence matrices of tokens by groups, GA and GB, give the links
of tokens that share one (GA·GBᵀ; its rows are runs, and are given as runs).

The first tokenizer is a byte-level BPE (a file of the `tokenizers` library, encoded by
`tiktoken` with that file's vocabulary), the second a `sentencepiece` model that puts a space
in front by itself. Both get the whole text; special tokens within it are plain text.

Defined results. Texts that are null or empty, or whose joined tokens of either side are not
the text after a space (a normaliser changed it), have no tokens: zeros, and '' as digest.
Every row of the table has its row in the result, repeated rows and null ids as well. Only
the id and the text are read, so other columns may have any names. An empty table gives an
empty result.

Corpus-wide counts are kept by pair of ids (a, b) that end together somewhere. The shorter
token of such a pair is a suffix of the longer one, so the number of pairs is bounded by the
vocabularies (`most_pairs`, under 2 million for the files used), whatever the corpus is:
this table may be sent to all tasks.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, for_python, store

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"

# Fixed value: how the byte-level vocabulary cuts a text before its merges.
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


class CSR(NamedTuple):
    """Rows `indptr[i]` to `indptr[i + 1]` of `indices` (columns) and `data`."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    columns: int

    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))


def tiled(lengths: np.ndarray) -> CSR:
    """Tokens by bytes, for tokens that lie one behind the other."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    indptr = np.concatenate([np.zeros(1, np.int64), ends])
    return CSR(indptr, np.arange(total), np.ones(total, np.int64), total)


def transposed(m: CSR) -> CSR:
    order = np.argsort(m.indices, kind="stable")
    per_row = np.bincount(m.indices, minlength=m.columns)
    indptr = np.concatenate([np.zeros(1, np.int64), np.cumsum(per_row)])
    return CSR(indptr, m.rows()[order], m.data[order], len(m.indptr) - 1)


def row_product(a: CSR, b: CSR) -> CSR:
    """A·B after Gustavson: row i is the sum of the rows k of B, each times A[i, k]."""
    width = np.diff(b.indptr)[a.indices]
    total = int(width.sum())
    entry, rows, values = b.indptr[a.indices], a.rows(), a.data
    if not np.all(width == 1):
        entry = np.repeat(entry - (np.cumsum(width) - width), width) + np.arange(total)
        rows, values = np.repeat(rows, width), np.repeat(values, width)
    columns = b.indices[entry]
    values = values * b.data[entry]
    key = rows * max(b.columns, 1) + columns
    if total and np.any(key[1:] < key[:-1]):
        order = np.argsort(key, kind="stable")
        key, rows, columns, values = key[order], rows[order], columns[order], values[order]
    new = np.flatnonzero(np.concatenate([np.ones(min(total, 1), bool), key[1:] != key[:-1]]))
    sums = np.add.reduceat(values, new) if total else values
    per_row = np.bincount(rows[new], minlength=len(a.indptr) - 1)
    indptr = np.concatenate([np.zeros(1, np.int64), np.cumsum(per_row)])
    return CSR(indptr, columns[new], sums, b.columns)


def byte_vocabulary(path: str) -> dict[bytes, int]:
    """Bytes and id of every token of a byte-level BPE file, special tokens left out. In
    it, printable characters stand for their own byte and the characters from U+0100 on
    for the other bytes in order."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = sorted(set(range(256)) - set(own))
    byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"] for t in file.get("added_tokens", [])}
    vocabulary = file["model"]["vocab"]
    return {bytes(byte[c] for c in w): i for w, i in vocabulary.items() if w not in special}


class Sides:
    """Both tokenizers, with the bytes of each of their tokens by id."""

    def __init__(self, a_path: str, b_path: str):
        ranks = byte_vocabulary(a_path)
        self.encoder = tiktoken.Encoding(
            "a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}
        )
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        size = max(ranks.values()) + 1
        a_bytes = [b""] * size
        for token, i in ranks.items():
            a_bytes[i] = token
        b_bytes = [self._piece(i) for i in range(self.pieces.get_piece_size())]
        self.a = pa.array(a_bytes, pa.large_binary())
        self.b = pa.array(b_bytes, pa.large_binary())
        self.a_len = np.array([len(x) for x in a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in b_bytes], np.int64)
        # What the digest writes for a token: its id and the sign after it.
        self.a_size, self.b_size = size, len(b_bytes)
        signed = [f"{i}{s}" for n, ss in ((size, ",|"), (len(b_bytes), ",;")) for s in ss for i in range(n)]
        self.written = pa.array([x.encode() for x in signed], pa.large_binary())

    def _piece(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        if self.pieces.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        a = [self.encoder.encode_to_numpy(" " + t, disallowed_special=()) for t in texts]
        b = self.pieces.encode(texts, num_threads=1)
        return [x.astype(np.int64) for x in a], [np.array(x, np.int64) for x in b]


_sides: dict[tuple[str, str], Sides] = {}


def sides(a_path: str, b_path: str) -> Sides:
    """The tokenizers of this process: reading their files takes a while."""
    if (a_path, b_path) not in _sides:
        _sides[a_path, b_path] = Sides(a_path, b_path)
    return _sides[a_path, b_path]


def most_pairs(a_path: str = BYTE_BPE, b_path: str = PIECES) -> int:
    """The number of pairs (a, b) of which one is a suffix of the other: no more pairs can
    end together in any corpus."""
    s = sides(a_path, b_path)
    a, b = Counter(s.a.to_pylist()), Counter(s.b.to_pylist())
    shorter_b = sum(n * b[x[k:]] for x, n in a.items() for k in range(len(x)))
    shorter_a = sum(n * a[x[k:]] for x, n in b.items() for k in range(1, len(x)))
    return shorter_b + shorter_a


class Aligned(NamedTuple):
    """The alignment of a block of texts. Tokens and links of all texts stand one behind
    the other; `a_at`, `b_at` and `link_at` hold where those of a text begin."""

    a: np.ndarray
    b: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray
    overlap: CSR
    links: tuple[np.ndarray, np.ndarray]
    link_at: np.ndarray
    a_groups: CSR
    b_groups: CSR


def _from(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    at = np.cumsum([0, *map(len, parts)])
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), at


def _spelled(table: pa.Array, ids: np.ndarray, at: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The bytes of all tokens, and the place of each boundary of `at` in them."""
    if not len(ids):
        return memoryview(b""), np.zeros(len(at), np.int64)
    taken = table.take(pa.array(ids))
    offsets = np.frombuffer(taken.buffers()[1], np.int64)[: len(ids) + 1]
    # Seen as unsigned bytes: Arrow shows its memory as signed ones.
    return memoryview(taken.buffers()[2] or b"").cast("B"), offsets[at]


def align(s: Sides, texts: list[str]) -> Aligned:
    """Align the texts of one block."""
    a_parts, b_parts = s.encode(texts)
    none = np.zeros(0, np.int64)
    spelled, place = _spelled(s.b, *_from(b_parts))
    for i, text in enumerate(texts):
        # Byte-level tokens keep every byte, so only the other side can differ.
        if not text or spelled[place[i] : place[i + 1]] != (" " + text).encode():
            a_parts[i] = b_parts[i] = none
    (a, a_at), (b, b_at) = _from(a_parts), _from(b_parts)
    left, right = tiled(s.a_len[a]), tiled(s.b_len[b])
    overlap = row_product(left, transposed(right))
    rows = overlap.rows()
    together = left.indptr[rows + 1] == right.indptr[overlap.indices + 1]
    links = rows[together], overlap.indices[together]

    def by_group(count: int, last: np.ndarray) -> CSR:
        """Tokens by groups, given the last token of each group."""
        begins = np.zeros(count + 1, np.int64)
        begins[last + 1] = 1
        group = np.cumsum(begins)[:count]
        return CSR(np.arange(count + 1), group, np.ones(count, np.int64), len(last))

    return Aligned(
        a, b, a_at, b_at, overlap, links, np.searchsorted(links[0], a_at),
        by_group(len(a), links[0]), by_group(len(b), links[1]),
    )


def _digests(s: Sides, x: Aligned) -> list[str]:
    """sha256 of `a1,a2|b1;a3|b2,b3` by text, '' without tokens."""
    a_of, b_of = x.a_groups.indices, x.b_groups.indices
    a_until, b_until = x.links[0] + 1, x.links[1] + 1
    written = np.empty(len(x.a) + len(x.b), np.int64)
    sign = x.a.copy()
    sign[a_until - 1] += s.a_size
    written[np.arange(len(x.a)) + np.concatenate([[0], b_until])[a_of]] = sign
    sign = x.b + 2 * s.a_size
    sign[b_until - 1] += s.b_size
    written[np.arange(len(x.b)) + a_until[b_of]] = sign
    spelled, place = _spelled(s.written, written, x.a_at + x.b_at)
    return [
        hashlib.sha256(spelled[i : j - 1]).hexdigest() if j > i else ""
        for i, j in zip(place[:-1], place[1:], strict=True)
    ]


ALIGNED = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
    "groups_sha256 string, a_ends binary, b_ends binary"
)


def aligned(
    documents: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per row of `documents` its numbers of tokens, groups and links, the digest of its
    groups, and the ids of the linked tokens (little-endian 32-bit numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sides(a_path, b_path)
        for batch in batches:
            ids = batch.column(0)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for first, part in blocks(texts):
                x = align(s, part)
                n_links = np.diff(x.link_at)
                ends = [
                    [side[ids_of][i:j].astype("<u4").tobytes() for i, j in zip(x.link_at[:-1], x.link_at[1:], strict=True)]
                    for side, ids_of in ((x.a, x.links[0]), (x.b, x.links[1]))
                ]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(part)), pa.array(np.diff(x.a_at)), pa.array(np.diff(x.b_at)),
                     pa.array(n_links), pa.array(n_links), pa.array(_digests(s, x)),
                     pa.array(ends[0], pa.binary()), pa.array(ends[1], pa.binary())],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a_ends", "b_ends"],
                )

    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return for_python(rows).mapInArrow(run, ALIGNED)


def _keys(a_ends: pa.Array, b_ends: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a batch as numbers, and where those of a row begin."""
    sizes = [len(x) // 4 for x in a_ends.to_pylist()]
    a, b = (np.frombuffer(b"".join(x.to_pylist()), "<u4").astype(np.int64) for x in (a_ends, b_ends))
    return a << 32 | b, np.cumsum([0, *sizes])


def pair_counts(staged: DataFrame) -> DataFrame:
    """(a_id, b_id, n, best): how many links of the corpus hold the pair, and whether no
    pair of the same b_id has more. Tasks add up their links before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            new, _ = _keys(batch.column(0), batch.column(1))
            new, n = np.unique(new, return_counts=True)
            keys, place = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(
                place, weights=np.concatenate([counts, n]), minlength=len(keys)
            ).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF), pa.array(counts)],
            names=["a_id", "b_id", "n"],
        )

    parts = staged.select("a_ends", "b_ends").mapInArrow(run, "a_id bigint, b_id bigint, n bigint")
    counts = parts.groupBy("a_id", "b_id").agg(F.sum("n").alias("n"))
    most = counts.groupBy("b_id").agg(F.max("n").alias("most"))
    return counts.join(most, "b_id").select("a_id", "b_id", "n", (F.col("n") == F.col("most")).alias("best"))


REPORT = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, "
    "count_sum bigint, groups_sha256 string"
)


def report(
    documents: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per row of `documents`: n_a, n_b (tokens), n_groups, n_links (pairs of tokens that
    end together), n_best (links whose count is the highest of their b_id), count_sum (the
    counts of its links), groups_sha256."""
    staged = store(aligned(documents, a_path, b_path, id_col, text_col), "aligned")
    counts = pair_counts(staged).toPandas()  # bounded by the vocabularies, see `most_pairs`
    counts["key"] = counts["a_id"].to_numpy(np.int64) << 32 | counts["b_id"].to_numpy(np.int64)
    counts = counts.sort_values("key")
    table = documents.sparkSession.sparkContext.broadcast(
        (counts["key"].to_numpy(np.int64), counts["n"].to_numpy(np.int64),
         counts["best"].to_numpy(np.int64))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = table.value
        for batch in batches:
            pairs, at = _keys(batch.column("a_ends"), batch.column("b_ends"))
            place = np.searchsorted(keys, pairs)
            sums = [
                np.concatenate([[0], np.cumsum(x[place])])[at] if len(pairs) else at * 0
                for x in (best, counts)
            ]
            column = batch.column
            yield pa.RecordBatch.from_arrays(
                [*(column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")),
                 *(pa.array(np.diff(x).astype(np.int64)) for x in sums), column("groups_sha256")],
                names=[c.split()[0] for c in REPORT.split(", ")],
            )

    return staged.mapInArrow(run, REPORT)


def overlap_links(
    documents: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """A·Bᵀ: (doc_id, a_index, a_id, b_index, b_id, bytes, ends_together) for every pair of
    tokens that share bytes. A text has fewer links than tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sides(a_path, b_path)
        for batch in batches:
            ids = batch.column(0)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for first, part in blocks(texts):
                x = align(s, part)
                rows, columns = x.overlap.rows(), x.overlap.indices
                text = np.searchsorted(x.a_at, rows, side="right") - 1
                together = np.isin(rows * (len(x.b) + 1) + columns, x.links[0] * (len(x.b) + 1) + x.links[1])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(text + first)), pa.array(rows - x.a_at[text]), pa.array(x.a[rows]),
                     pa.array(columns - x.b_at[text]), pa.array(x.b[columns]),
                     pa.array(x.overlap.data), pa.array(together)],
                    names=["doc_id", "a_index", "a_id", "b_index", "b_id", "bytes", "ends_together"],
                )

    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return for_python(rows).mapInArrow(
        run,
        "doc_id bigint, a_index bigint, a_id bigint, b_index bigint, b_id bigint, bytes bigint, "
        "ends_together boolean",
    )


def shared_group_links(
    documents: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """GA·GBᵀ: per token of A the run of tokens of B in its group (doc_id, group, a_index,
    a_id, first_b, last_b). As runs, since a group of p and q tokens has p * q links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sides(a_path, b_path)
        for batch in batches:
            ids = batch.column(0)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for first, part in blocks(texts):
                x = align(s, part)
                members = transposed(x.b_groups)
                runs = CSR(
                    np.arange(members.columns and len(members.indptr) or 1),
                    members.indices[members.indptr[:-1]], np.diff(members.indptr), members.columns,
                )
                product = row_product(x.a_groups, runs)
                text = np.searchsorted(x.a_at, np.arange(len(x.a)), side="right") - 1
                first_b = product.indices - x.b_at[text]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(text + first)), pa.array(x.a_groups.indices - x.link_at[text]),
                     pa.array(np.arange(len(x.a)) - x.a_at[text]), pa.array(x.a),
                     pa.array(first_b), pa.array(first_b + product.data - 1)],
                    names=["doc_id", "group", "a_index", "a_id", "first_b", "last_b"],
                )

    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return for_python(rows).mapInArrow(
        run, "doc_id bigint, group bigint, a_index bigint, a_id bigint, first_b bigint, last_b bigint"
    )

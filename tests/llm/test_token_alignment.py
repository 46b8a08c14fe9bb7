"""Token alignment against a plain two-pointer walk over the library's own encodings."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from waymark.llm import token_alignment as ta

TEXTS = [
    "Hello world, this is a test.", "Hello world, this is a test.", None, "", " ", "  two  spaces \n\n",
    "ünïcödé 漢字 🙂 and <|endoftext|> <s> </s> <0x41>", "▁ is not a space", "ﬁ ligature", "\x00 nul",
    "a" * 5000, "word " * 3000, "é combining", "x", "𝔘𝔫𝔦", "tab\tand\r\nlines",
]
SCHEMA = "doc_id long, text string, n_a int, a_ends string, key string"


def encoded(texts):
    tok = Tokenizer.from_file(ta.BYTE_BPE)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=ta.PIECES)
    a_bytes = {i: b for b, i in ta.byte_vocabulary(ta.BYTE_BPE).items()}

    def piece(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()

    out = []
    for t in texts:
        whole = (" " + (t or "")).encode()
        a = tok.encode(" " + (t or ""), add_special_tokens=False).ids
        b = sp.encode(t or "")
        same = b"".join(a_bytes[i] for i in a) == whole == b"".join(map(piece, b))
        if not t or not same:
            a = b = []
        a_end = np.cumsum([len(a_bytes[i]) for i in a]).tolist()
        b_end = np.cumsum([len(piece(i)) for i in b]).tolist()
        out.append((a, b, a_end, b_end))
    return out


def expected(texts):
    rows = encoded(texts)
    links, groups = [], []
    for a, b, a_end, b_end in rows:
        found, parts, i, j = [], [], 0, 0
        for end in sorted(set(a_end) & set(b_end)):
            x, y = a_end.index(end), b_end.index(end)
            found.append((a[x], b[y]))
            parts.append(",".join(map(str, a[i : x + 1])) + "|" + ",".join(map(str, b[j : y + 1])))
            i, j = x + 1, y + 1
        links.append(found)
        groups.append(";".join(parts))
    count = Counter(p for ls in links for p in ls)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return [
        (len(a), len(b), len(ls), len(ls), sum(count[p] == best[p[1]] for p in ls),
         sum(count[p] for p in ls), hashlib.sha256(g.encode()).hexdigest() if a else "")
        for (a, b, _, _), ls, g in zip(rows, links, groups, strict=True)
    ]


def test_report(spark):
    rows = [(i, t, 1, "x", "k") for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], 1, "x", "k")]
    got = ta.report(spark.createDataFrame(rows, SCHEMA)).collect()
    want = expected([r[1] for r in rows])
    found = {r.doc_id: tuple(r)[1:] for r in got}
    assert len(got) == len(rows)
    for r, w in zip(rows, want, strict=True):
        assert found[r[0]] == w, r[1]
    assert found[2] == found[3] == (0, 0, 0, 0, 0, 0, "")
    assert found[7][0] == 0  # the sign for a space is not a space


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ta.report(empty).collect() == []
    assert ta.overlap_links(empty).collect() == []


def test_links(spark):
    docs = spark.createDataFrame([(i, t, 1, "x", "k") for i, t in enumerate(TEXTS)], SCHEMA)
    want, runs = set(), set()
    for i, (a, b, a_end, b_end) in enumerate(encoded(TEXTS)):
        if len(a) > 300:
            continue
        cuts = sorted(set(a_end) & set(b_end))
        group_of = lambda e: sum(c < e for c in cuts)
        for x, end in enumerate(a_end):
            begin = a_end[x - 1] if x else 0
            for y, other in enumerate(b_end):
                shared = min(end, other) - max(begin, b_end[y - 1] if y else 0)
                if shared > 0:
                    want.add((i, x, a[x], y, b[y], shared, end == other))
            mates = [y for y, e in enumerate(b_end) if group_of(e) == group_of(end)]
            runs.add((i, group_of(end), x, a[x], mates[0], mates[-1]))
    short = [i for i, (a, *_) in enumerate(encoded(TEXTS)) if len(a) <= 300]
    got = ta.overlap_links(docs).where(f"doc_id in ({','.join(map(str, short))})").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    got = ta.shared_group_links(docs).where(f"doc_id in ({','.join(map(str, short))})").collect()
    assert sorted(map(tuple, got)) == sorted(runs)


@pytest.mark.parametrize("seed", range(5))
def test_row_product(seed):
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(0, 3, size) * (rng.random(size) < 0.4) for size in ((7, 9), (9, 5)))

    def csr(m):
        rows, columns = np.nonzero(m)
        indptr = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(m)))])
        return ta.CSR(indptr, columns, m[rows, columns], m.shape[1])

    product = ta.row_product(csr(a), csr(b))
    dense = np.zeros((7, 5), int)
    dense[product.rows(), product.indices] = product.data
    assert (dense == a @ b).all()
    back = ta.transposed(csr(a))
    dense = np.zeros((9, 7), int)
    dense[back.rows(), back.indices] = back.data
    assert (dense == a.T).all()


def test_pairs_are_bounded_by_the_vocabularies():
    assert 32_000 < ta.most_pairs() < 2_000_000


def test_same_ids_as_the_tokenizers_library():
    """Every code point, alone and next to letters, digits and itself."""
    tok = Tokenizer.from_file(ta.BYTE_BPE)
    tok.encode_special_tokens = True
    encoder = ta.sides(ta.BYTE_BPE, ta.PIECES).encoder
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [
        " ".join(f"a{chr(c)}b {chr(c)}1 {chr(c)}{chr(c)}. x" for c in points[k : k + 200])
        for k in range(0, len(points), 200)
    ]
    ids = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert ids == [encoder.encode_ordinary(t) for t in texts]

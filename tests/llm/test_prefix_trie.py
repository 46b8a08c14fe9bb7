"""The trie of conversations against a dictionary of all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from waymark.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, path string, k1 int, n int"


def brute(convs):
    """The nodes of {conv_id: [(role, text), ...]}."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = []
    subtree = {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        leaves = sum(subtree[q][0] for q in children[p]) or 1
        subtree[p] = leaves, own + sum(subtree[q][1] for q in children[p])
        ends = sorted(c for c in members[p] if len(convs[c]) == len(p))
        out.append((
            min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]),
            len(children[p]), *subtree[p], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def grouped(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}


def rebuild(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def rows_of(convs):
    return [(c, i, *t, "p", 1, 2) for c, ts in convs.items() for i, t in enumerate(ts)]


def found(spark, rows, change=False):
    s = prefix_trie.sequences(spark.createDataFrame(rows, SCHEMA))
    return sorted(map(tuple, prefix_trie.trie(prefix_trie.rebuilt(s) if change else s).collect()), key=str)


def random_conversations(seed, n=150):
    rng = random.Random(seed)
    convs = {}
    for c in rng.sample(range(10_000), n):
        if convs and rng.random() < 0.5:
            base = convs[rng.choice(list(convs))]
            turns = base[: rng.randint(0, len(base))]
        else:
            turns = []
        more = [(rng.choice("ua"), rng.choice(["x", "é", "yy", ""])) for _ in range(rng.randint(0, 6))]
        convs[c] = (turns + more) or [("u", "")]
    return convs


@pytest.mark.parametrize("change", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_random(spark, seed, change):
    convs = random_conversations(seed)
    want = brute(rebuild(convs) if change else convs)
    assert found(spark, rows_of(convs), change) == want


def test_nulls_and_repeated_rows(spark):
    rows = [
        (1, None, None, "a", "p", 1, 2), (1, 0, "u", None, None, None, None), (1, 0, "u", None, "p", 1, 2),
        (2, None, "", "a", "p", 1, 2), (None, 0, "u", "gone", "p", 1, 2), (3, 5, "u", "b" * 100_000, "p", 1, 2),
        (7, 1, "u", "only turn of a conversation that h cuts away", "p", 1, 2),
    ]
    convs = grouped(rows)
    assert found(spark, rows) == brute(convs)
    assert found(spark, rows, True) == brute(rebuild(convs))


def test_copies_and_long_conversations(spark):
    """A group of copies whose ids fill several pieces, and conversations of a thousand turns
    of which two agree in their first turns."""
    copies = {c: [("u", "hi"), ("a", "hello")] for c in range(5000)}
    long = [("u", f"t{i}") for i in range(1000)]
    convs = copies | {6000: long, 6001: long[:3] + [("a", "other")] * 500, 6002: long, 6003: long[:6]}
    assert found(spark, rows_of(convs)) == brute(convs)


def test_empty_table(spark):
    assert found(spark, []) == []
    assert found(spark, [], True) == []
    assert found(spark, [(None, 1, "u", "x", "p", 1, 2)]) == []

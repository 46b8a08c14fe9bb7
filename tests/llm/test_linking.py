import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import linking


@pytest.fixture
def scans(monkeypatch):
    """Name and number of table scans of everything that linking stores."""
    found, store = [], linking.store

    def counted(df, name):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        found.append((name, plan.count("Relation [")))
        return store(df, name)

    monkeypatch.setattr(linking, "store", counted)
    return found


def test_plans_do_not_grow_with_the_tables_of_earlier_comparisons(spark, scans):
    search = linking._Search(lambda pairs: pairs.where(F.col("a") % 2 == 0))
    for k in range(5):
        # Every other pair was compared before, and one is given twice.
        rows = [(a, a + 1) for a in range(2 * k, 2 * k + 4)] + [(2 * k, 2 * k + 1)]
        search.add(spark.createDataFrame(rows, "a long, b long"))
    assert [n for name, n in scans if name == "link-pairs"] == [0, 1, 1, 1, 1]
    scans.clear()
    known = {(r["node"], r["root"]) for r in search.known().collect()}
    assert known == {(x, x - x % 2) for x in range(12)}
    assert scans[0] == ("cc-edges", 1)


def test_known_parts_and_later_links_connect(spark):
    search = linking._Search(lambda pairs: pairs.where(F.col("a") < 10))
    search.add(spark.createDataFrame([(1, 2), (3, 4)], "a long, b long"))
    assert {(r["node"], r["root"]) for r in search.known().collect()} == {(1, 1), (2, 1), (3, 3), (4, 3)}
    search.add(spark.createDataFrame([(20, 21)], "a long, b long"))
    search.add(spark.createDataFrame([(2, 3), (1, 2)], "a long, b long"))
    assert {(r["node"], r["root"]) for r in search.known().collect()} == {(x, 1) for x in (1, 2, 3, 4)}


def _members(spark, groups):
    """Rows of members: of each node (number, ids, sketches)."""
    rows = [(node, i, 10, s1, 0) for node, members in groups for i, s1 in members]
    return spark.createDataFrame(rows, "node long, id long, n long, s1 long, s2 long")


def _by_kind(found):
    kinds = {kind: set() for kind in (linking.PAIR, linking.MANY, linking.LARGE)}
    for r in found.collect():
        kinds[r["kind"]].add((r["a"], r["b"]))
    return kinds


def test_a_node_of_similar_members_gives_a_few_rows_for_each(spark):
    # All 44,850 pairs may be similar: they must not be made, yet all members hang together.
    many = [(7, [(i, 0) for i in range(300)])]
    # One of 40 has sketches unlike all others, the others are alike in twos.
    unlike = lambda i: int(f"{i + 1:x}" * 16, 16) if i < 7 else 0
    few = [(8, [(1000 + i, unlike(i // 2)) for i in range(14)]), (9, [(5, 0)])]
    found = _by_kind(linking._compared(_members(spark, many + few), 80, 8))
    pairs = {p for p in found[linking.PAIR] if p[1] < 1000}
    assert len(pairs) <= (linking.PIVOTS + 1) * 300
    assert {x for p in pairs for x in p} == set(range(300))
    assert found[linking.MANY] == {(7, i) for i in range(300)} and not found[linking.LARGE]
    assert found[linking.PAIR] - pairs == {(1000 + i, 1001 + i) for i in range(0, 14, 2)}


def test_nodes_over_the_limit_are_given_back_whole(spark, monkeypatch):
    monkeypatch.setattr(linking, "LIMIT", 50)
    monkeypatch.setattr(linking, "TAKEN", 30)
    members = _members(spark, [(n, [(i, 0) for i in range(20 + 40 * n)]) for n in range(3)])
    # A member that comes many times is one.
    members = members.unionByName(_members(spark, [(0, [(3, 0)] * 200)])).repartition(3)
    monkeypatch.setattr(linking, "BATCH", 7)
    found = _by_kind(linking._compared(members, 80, 8))
    assert found[linking.LARGE] == {(n, i) for n in (1, 2) for i in range(20 + 40 * n)}
    assert found[linking.PAIR] == {(a, b) for a in range(20) for b in range(a + 1, 20)}


@pytest.mark.parametrize("limit", [8, 4096])
def test_links_of_large_nodes_are_those_of_all_pairs(spark, monkeypatch, limit):
    monkeypatch.setattr(linking, "LIMIT", limit)
    monkeypatch.setattr(linking, "PASSING_PER_MEMBER", 1)
    # A chain: neighbours are similar, all pairs may be.
    infos = spark.range(40).selectExpr("id", "10L n", "0L s1", "0L s2")
    members = infos.selectExpr("5L node", "id", "n", "s1", "s2")
    # The sets are ranges of 81 numbers, which overlap in 76 or 71 for the next two only.
    verify = lambda pairs: pairs.where(F.col("b") - F.col("a") <= 2)
    bodies = infos.selectExpr("id", "id body", "1L weight")

    def decode(rows):
        return [np.arange(5 * x, 5 * x + 81) for x in rows]

    branch = lambda many, level: many.select("node", "id")
    found = linking.link(members, infos, verify, lambda ids: bodies, decode, branch, 76, 1)
    assert {r["node"]: r["root"] for r in found.collect()} == dict.fromkeys(range(40), 0)

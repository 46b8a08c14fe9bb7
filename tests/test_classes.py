"""Look-ups by classes of documents that are equal but for their rare terms."""

import random

import pytest

from test_search import _brute_force
from waymark.operators import matching
from waymark.operators.matching import build_index, match_requests
from waymark.plans.stage import measured
from waymark.settings import SearchSettings

DOCS = "id bigint, aoid string, fullname string, sname string, wordcount int"
VARIANTS = ("request_id bigint, cort int, op string, "
            "groups array<array<struct<term:string,boost:double>>>, sname array<string>, n_words int")


def _docs(n, shuffled=True):
    """Few different names, each with a word of its own, some with a word twice."""
    rng = random.Random(5)
    docs = []
    for i in range(n):
        name = [f"c{rng.randint(0, 2)}", f"d{rng.randint(0, 3)}", rng.choice(["e", "e e", "f"]), f"u{i}"]
        if shuffled:
            rng.shuffle(name)
        docs.append((i, f"a{i}", " ".join(name), rng.choice(["st", "st cty"]), len(name) - 1))
    return docs


@pytest.mark.parametrize("rare_rows, probe_rows", [(1, 1000), (1, 3), (60, 10), (10**6, 1000)])
def test_classes_against_brute_force(spark, rare_rows, probe_rows):
    docs, rng = _docs(240), random.Random(7)
    words = ["c0", "c1", "c2", "d0", "d1", "d2", "d3", "e", "f", "u7", "u21", "u1*", "zz"]
    variants = []
    for i in range(50):
        groups = [[(w, rng.choice([1.0, 0.6])) for w in rng.sample(words, rng.randint(1, 3))]
                  for _ in range(rng.randint(1, 4))]
        variants.append((i, 0, "maybe" if i % 3 else "and", groups,
                         rng.choice([[], ["st"], ["st", "cty"]]), rng.randint(1, 6)))
    settings = SearchSettings(rare_rows=rare_rows, probe_rows=probe_rows)
    index = build_index(spark.createDataFrame(docs, DOCS), settings)
    got = {}
    for r in match_requests(spark.createDataFrame(variants, VARIANTS), index, settings).collect():
        got.setdefault(r["request_id"], {})[r["pos"]] = (r["krank"], r["doc_id"])
    names = ["request_id", "cort", "op", "groups", "sname", "n_words"]
    for v in variants:
        mine = got.get(v[0], {})
        assert [mine[p] for p in sorted(mine)] == _brute_force(docs, dict(zip(names, v))), v


def test_look_ups_do_not_grow_with_documents(spark, monkeypatch):
    looked_up = []
    join = matching.work_join

    def counted(asking, *more):
        looked_up.append(measured(asking))
        return join(asking, *more)

    monkeypatch.setattr(matching, "work_join", counted)
    variants = [(i, 0, "maybe", [[(f"c{i % 3}", 1.0)], [(f"d{i % 4}", 1.0)], [(f"u{i}", 1.0)]], [], 4)
                for i in range(12)]
    sums = []
    for n in (800, 4800):
        looked_up.clear()
        settings = SearchSettings(rare_rows=20)
        index = build_index(spark.createDataFrame(_docs(n, shuffled=False), DOCS), settings)
        hits = match_requests(spark.createDataFrame(variants, VARIANTS), index, settings)
        assert hits.count() == 120
        sums.append(sum(looked_up))
    assert sums[1] < 2 * sums[0], sums


def test_terms_need_no_postings(spark, monkeypatch):
    written = []
    stage = matching.stage
    monkeypatch.setattr(matching, "stage", lambda df, name, *m: written.append(name) or stage(df, name, *m))
    index = build_index(spark.createDataFrame(_docs(20), DOCS))
    assert index.terms.count() > 20 and written == ["index-docs", "index-terms"]
    assert index.postings.count() > 0 and "index-postings" in written


@pytest.mark.parametrize("rare_rows", [3, 60])
def test_classes_of_listed_and_joined_common_terms(spark, monkeypatch, rare_rows):
    settings = SearchSettings(rare_rows=rare_rows)
    docs = _docs(120) + [(500, "a500", "c0-d1 e", "st", 1), (501, "a501", "-", "st", 0)]
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    tables = []
    for most in (0, 500):
        monkeypatch.setattr(matching, "MOST_LISTED", most)
        index = build_index(spark.createDataFrame(docs, DOCS), settings)
        tables.append([rows(x) for x in (index.postings, index.classes, index.members, index.sized)])
    assert tables[0] == tables[1] and all(tables[0])


def test_index_is_built_by_one_shuffle_of_documents(spark):
    index = build_index(spark.createDataFrame(_docs(60), DOCS), SearchSettings(rare_rows=10))
    masked = matching._masked(index._rows, index._terms, index._settings)
    assert "Exchange" not in masked._jdf.queryExecution().executedPlan().toString()
    # Names and counts of terms are lists of the document, no structure for each term.
    assert dict(index._rows.dtypes)["names"] == "array<string>"


def test_large_tables_are_read_for_distinct_terms(spark, monkeypatch):
    staged, stage = {}, matching.stage

    def kept(df, name, *m):
        staged[name] = stage(df, name, *m)
        return staged[name]

    monkeypatch.setattr(matching, "stage", kept)
    variants = [(i, 0, op, [[("c0", 1.0)], [("d1", 1.0)], [("u1*", 0.9)], [(f"u{i % 3}", 1.0)]], ["st"], n)
                for i in range(6) for n, op in enumerate(("and", "maybe"), 4)]
    index = build_index(spark.createDataFrame(_docs(200), DOCS), SearchSettings(rare_rows=20))
    hits = match_requests(spark.createDataFrame(variants, VARIANTS), index, SearchSettings(rare_rows=20))
    assert hits.count() > 0
    asked = {(r["field"], r["term"]) for r in staged["match-terms"].collect()}
    assert len(asked) == staged["match-terms"].count() and ("f", "u1") in asked and ("s", "st") in asked
    assert staged["match-prefixes"].count() == 1
    # Of the postings only those of the terms looked up are joined.
    assert staged["match-tids"].count() == staged["match-tids"].distinct().count() <= len(asked)

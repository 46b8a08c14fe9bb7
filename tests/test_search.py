import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from waymark.functions import text as T
from waymark.operators.dictionary import build_dictionary, most_frequent
from waymark.operators.find import find, single_hit
from waymark.operators.lexicon import build_lexicon
from waymark.operators.matching import SATURATION, build_index, match_requests
from waymark.operators.paths import build_paths
from waymark.operators.queries import plan_queries
from waymark.operators.ranks import match_types, rank_words, split_requests
from waymark.operators.suggest import suggest
from waymark.settings import SearchSettings


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in rows.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_text_functions(spark):
    assert column(spark, ["ab"], T.trigram_text) == ["__a _ab ab_ b__"]
    assert column(spark, ["Г. Москва,ул:Мира"], T.split_phrase) == [["г", "москва", "ул", "мира"]]
    assert column(spark, ["-а@б--"], T.clean_word) == ["аб"]
    terms = column(spark, ["ул Ёлочная, Санкт-Петербург 5"], T.index_terms)[0]
    assert [(t["term"], t["pos"]) for t in terms] == [
        ("ул", 0), ("елочная", 1), ("санкт", 2), ("петербург", 3), ("санкт-петербург", 2), ("5", 4)
    ]
    assert column(spark, ["а б  в", None], T.count_spaces) == [3, None]


def test_match_types_of_all_codes(spark):
    codes = ["".join(c) for c in itertools.product("012x", "01x", "01x", "01x")]
    assert len(codes) == 108
    df = spark.createDataFrame([(c,) for c in codes], "code string")
    rows = df.select("code", *[c.alias(n) for n, c in match_types(F.col("code")).items()]).collect()
    counts = {}
    for row in rows:
        types = tuple(n for n in row.__fields__ if n != "code" and row[n])
        counts[types] = counts.get(types, 0) + 1
    assert counts == {
        ("many_sugg",): 1,
        ("some_sugg", "last_star"): 1,
        ("some_sugg", "both_star"): 1,
        ("last_star", "as_is"): 1,
        ("last_star",): 1,
        (): 4,
        ("some_sugg", "last_star", "as_is", "is_socr"): 4,
        ("last_star", "as_is", "is_socr"): 4,
        ("some_sugg", "add_socr"): 4,
        ("some_sugg", "as_is"): 8,
        ("as_is", "add_socr"): 8,
        ("add_socr",): 12,
        ("as_is", "is_socr"): 16,
        ("as_is",): 43,
    }


def test_most_frequent_is_a_sorted_limit(spark):
    rng = random.Random(5)
    words = {f"{rng.choice('abc')}{rng.choice('abc')}xx{i % 37}": rng.choice([1, 1, 1, 2, 9])
             for i in range(300)}
    df = spark.createDataFrame(list(words.items()), "word string, frequency int")
    order = sorted(words.items(), key=lambda w: (-w[1], w[0]))
    for size in (1, 20, len(words) - 1, len(words) + 5):
        got = {tuple(r) for r in most_frequent(df, size).collect()}
        assert got == set(order[:size])


def test_repeated_words_multiply_counts(spark, socrbase):
    dictionary = spark.createDataFrame(
        [("мира", 5), ("мирная", 2), ("ул", 9)], "word string, frequency int")
    lexicon = build_lexicon(dictionary, socrbase)
    asked = spark.createDataFrame(
        [(1, "мир мира"), (2, "мира мира"), (3, "улица -ул-")], "request_id bigint, text string")
    ranked = rank_words(split_requests(asked), lexicon)
    codes = {(r["request_id"], r["word"]): r["code"] for r in ranked.collect()}
    assert codes == {
        (1, "мир"): "2000", (1, "мира"): "1100", (2, "мира"): "2x00",
        (3, "улица"): "0010", (3, "ул"): "1100",  # compared with abbreviations as typed
    }


def _grams(word):
    padded = f"__{word}__"
    return [padded[i:i + 3] for i in range(len(padded) - 2)]


@pytest.mark.parametrize("rows_per_task", [20, 1_000_000])
def test_suggest_against_brute_force(spark, socrbase, rows_per_task):
    rng = random.Random(11)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(2, 9)))
                    for _ in range(400)} | {"aaaaa", "aaaaaa", "abababab"})
    frequency = {w: rng.randint(1, 50) for w in words}
    dictionary = spark.createDataFrame(list(frequency.items()), "word string, frequency int")
    asked = ["aaaa", "zz", "abcdz", "ababab"] + [w[:1] + w[2:] for w in words[:60] if len(w) > 3]
    lexicon = build_lexicon(dictionary, socrbase)
    settings = SearchSettings(rows_per_task=rows_per_task)
    df = spark.createDataFrame([(w,) for w in asked], "word string")
    got = {}
    for r in suggest(df, lexicon, settings).collect():
        got.setdefault(r["word"], {})[r["pos"]] = (r["suggestion"], r["rank"])
    for word in asked:
        mine = set(_grams(word))
        ranks = []
        for other in words:
            shared = sum(g in mine for g in _grams(other))
            apart = abs(len(other) - len(word))
            if shared and apart <= 2:
                ranks.append((shared + 2 - apart, other))
        ranks.sort(key=lambda r: (-r[0], -frequency[r[1]], r[1]))
        top = [(o, r) for r, o in ranks[:10] if ranks[0][0] - r < 2]
        perfect = [(o, r) for o, r in top if r == ranks[0][0]]
        want = (perfect if len(perfect) >= 2 else top)[:6]
        assert [got.get(word, {})[p] for p in sorted(got.get(word, {}))] == want, word


def _brute_force(docs, variant):
    """Best documents of one variant by the definition of the ranking."""
    n = len(docs)
    fields = {"f": 2, "s": 3}
    tokens = {d[0]: {k: re.findall("[0-9a-z_а-я]+", d[i]) for k, i in fields.items()} for d in docs}
    df, terms = {}, set()
    for d in docs:
        for k in fields:
            for t in set(tokens[d[0]][k]):
                df[k, t] = df.get((k, t), 0) + 1
    groups = [("f", g, variant["op"] == "and" or i == 0) for i, g in enumerate(variant["groups"])]
    groups += [("s", [(t, 1.0)], True) for t in variant["sname"]]
    hits = []
    for d in docs:
        total, whole, found = 0.5, True, set()
        for k, alternatives, required in groups:
            here = {}
            for t, boost in alternatives:
                names = [t]
                if t.endswith("*"):
                    names = sorted((x for kk, x in df if kk == "f" and len(t) > 3 and x.startswith(t[:-1])),
                                   key=lambda x: (-df["f", x], x))[:32]
                for name in names:
                    if name in tokens[d[0]][k]:
                        here[name] = max(boost, here.get(name, 0))
            for name, boost in here.items():
                times = tokens[d[0]][k].count(name)
                idf = math.log((n - df[k, name] + 1) / df[k, name]) / (2 * math.log(n + 1))
                total += boost * idf * times / (times + SATURATION)
                found.add(k)
            whole &= bool(here) or not required
        if whole:
            rank = 1000 * len(found) + math.floor(round(1000 * total, 6))
            hits.append((rank - 4 * abs(d[4] - variant["n_words"]), d[0]))
    hits.sort(key=lambda h: (-h[0], h[1]))
    return hits[:10]


@pytest.mark.parametrize("rows_per_task, probe_rows", [(1_000_000, 1000), (1_000_000, 5), (40, 20)])
def test_match_against_brute_force(spark, rows_per_task, probe_rows):
    rng = random.Random(3)
    common, rare = ["reg", "north", "south"], [f"w{i}" for i in range(40)]
    docs = []
    for i in range(300):
        name = [rng.choice(common) for _ in range(2)] + [rng.choice(rare) for _ in range(3)]
        name += [f"u{i}"] if i % 2 else [name[-1]]
        sname = " ".join(rng.choice(["st", "cty", "str"]) for _ in range(2))
        docs.append((i, f"a{i}", " ".join(name), sname, len(name) - 1))
    paths = spark.createDataFrame(
        docs, "id bigint, aoid string, fullname string, sname string, wordcount int")
    variants = []
    for i in range(60):
        groups = [[(rng.choice(common + rare), 1.0)] for _ in range(rng.randint(1, 4))]
        groups += [[(f"u{rng.randint(0, 300)}", 0.7), (rng.choice(rare), 0.5)]]
        if i % 5 == 0:
            groups.append([(rng.choice(["u1*", "u12*", "sou*", "nor*"]), 0.9)])
        rng.shuffle(groups)
        variants.append((i, i % 2, "maybe" if i % 3 else "and", groups[:rng.randint(1, 6)],
                         rng.choice([[], ["st"], ["st", "cty"]]), rng.randint(1, 6)))
    df = spark.createDataFrame(
        variants, "request_id bigint, cort int, op string, "
        "groups array<array<struct<term:string,boost:double>>>, sname array<string>, n_words int")
    settings = SearchSettings(rows_per_task=rows_per_task, probe_rows=probe_rows)
    got = {}
    for r in match_requests(df, build_index(paths, settings), settings).collect():
        got.setdefault(r["request_id"], {})[r["pos"]] = (r["krank"], r["doc_id"])
    names = ["request_id", "cort", "op", "groups", "sname", "n_words"]
    matched = 0
    for v in variants:
        want = _brute_force(docs, dict(zip(names, v)))
        mine = got.get(v[0], {})
        assert [mine[p] for p in sorted(mine)] == want, v
        matched += bool(want)
    assert matched > 20


def test_find_by_hand(spark, addrobj, socrbase):
    paths = build_paths(addrobj)
    texts = paths.select(F.col("fullname").alias("text")).unionByName(
        paths.select(F.col("sname").alias("text")))
    lexicon = build_lexicon(build_dictionary(texts), socrbase)
    index = build_index(paths)
    asked = spark.createDataFrame(
        [(1, "Псковская обл, Порховский р-н, д. Гречушанка"), (2, "Псковская Гречушнка"),
         (3, "псковская ёлочная улица"), (4, "!?"), (5, ", . ,"), (6, "щщщщщщ"),
         (7, "г Близнецы"), (8, "Псковская обл, Порховский р-н, снт Ромашка"),
         (9, "обл Псковская, г Второй, ул Санкт-Петербургская")],
        "request_id bigint, text string")
    soft = {}
    for r in find(asked, index, lexicon, SearchSettings()).collect():
        soft.setdefault(r["request_id"], []).append(r)
    first = {k: min(v, key=lambda r: r["pos"] or 0) for k, v in soft.items()}
    assert first[1]["aoid"] == first[2]["aoid"] == "d1"
    assert first[3]["aoid"] == "s1"  # yo is folded, the full type name is understood
    assert first[4]["status"] == first[5]["status"] == "bad_data"
    assert first[6]["status"] == "ok" and first[6]["aoid"] is None
    for rows in soft.values():
        ids = [r["aoid"] for r in rows if r["aoid"]]
        assert len(ids) == len(set(ids)) <= 10
    strong = {r["request_id"]: r for r in
              find(asked, index, lexicon, SearchSettings(), strong=True).collect()}
    # d1 has one word less than asked for, and the street below it has one more.
    assert strong[1]["status"] == "not_found"
    assert strong[8]["aoid"] == "k1"
    assert strong[6]["status"] == "not_found"
    assert len(strong) == 9
    # A hyphenated word is found whole and by its parts, in both modes.
    assert first[9]["aoid"] == strong[9]["aoid"] == "s2"



def test_strong_refuses_ties(spark):
    merged = spark.createDataFrame(
        [(1, 1, 500, "a"), (1, 2, 500, "b"), (2, 1, 500, "a"), (2, 2, 400, "b"), (3, 1, 9, "c")],
        "request_id bigint, pos int, ratio int, aoid string")
    assert {r["request_id"]: r["aoid"] for r in single_hit(merged).collect()} == {2: "a", 3: "c"}


def test_query_variants(spark):
    term = lambda t, b=1.0: (t, b)
    varied = spark.createDataFrame(
        [(1, 0, [], [term("ул")]), (1, 1, [term("мира")], []), (1, 2, [term("мира")], []),
         (2, 0, [term("мира")], []), (3, 0, [], []), (3, 1, [term("а"), term("б", 0.5)], []),
         (3, 2, [term("в")], [])],
        "request_id bigint, pos int, full array<struct<term:string,boost:double>>, "
        "abbr array<struct<term:string,boost:double>>")
    rows = plan_queries(varied).orderBy("request_id", "cort").collect()
    plans = [(r["request_id"], r["cort"], r["op"], len(r["groups"]), r["sname"], r["n_words"])
             for r in rows]
    # With one group `and` and `maybe` are the same query, kept once.
    assert plans == [
        (1, 0, "and", 1, ["ул"], 3), (1, 1, "and", 1, [], 3),
        (2, 0, "and", 1, [], 1),
        (3, 0, "and", 2, [], 3), (3, 1, "maybe", 2, [], 3),
    ]
    strong = plan_queries(varied, strong=True)
    assert {r["request_id"] for r in strong.collect()} == {1, 2}  # 3 has an empty variation


def test_plans_make_each_list_once(spark):
    varied = spark.createDataFrame(
        [(1, 0, [("a", 1.0)], []), (1, 1, [("b", 1.0)], [("st", 1.0)])],
        "request_id bigint, pos int, full array<struct<term:string,boost:double>>, "
        "abbr array<struct<term:string,boost:double>>")
    plan = plan_queries(varied)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("array_join") == 2, plan  # one for each of the two lists of a word


def test_index_terms_with_and_without_hyphens(spark):
    texts = ["а б  в", "а-б в", "-", "", None, "x -y- z-w-q"]
    got = [t and [(x["term"], x["pos"]) for x in t] for t in column(spark, texts, T.index_terms)]
    assert got == [
        [("а", 0), ("б", 1), ("в", 2)], [("а", 0), ("б", 1), ("а-б", 0), ("в", 2)], [], [], None,
        [("x", 0), ("y", 1), ("z", 2), ("w", 3), ("q", 4), ("z-w-q", 2)],
    ]

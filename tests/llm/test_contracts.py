"""Names of extra columns, sums that do not fit, and where the labelled tables come from."""

import os
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from waymark.llm import decontaminate, line_dedup, minhash_dedup, mixing, pii, substring_dedup, topk, url_filter

WORKING = "_key _doc _gone _any _kept_id _k _kept_key _hit_id _hit_key _id _no _words _text row copy size mix_size taken".split()
LINE = "a line of some words that stands in two of the documents here and is long enough"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LINE + "\nfirst", 1), (2, LINE + "\nsecond text", 1), (3, "clean words only", 1), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    return df.select("*", F.lit("s").alias("source"), *[F.lit("KEEP").alias(c) for c in WORKING])


@pytest.mark.parametrize("name", ["lines", "near", "bench", "chunks", "mix"])
def test_columns_with_working_names(spark, docs, name):
    bench = spark.createDataFrame([("b", "clean words only")], "item_id string, text string")
    run = {
        "lines": lambda: line_dedup.drop_repeated(docs), "near": lambda: minhash_dedup.keep_one(docs),
        "bench": lambda: decontaminate.drop_contaminated(docs, bench),
        "chunks": lambda: substring_dedup.drop_repeated(docs),
        "mix": lambda: mixing.apply_mix(docs, mixing.mix(docs)),
    }[name]
    out = run()
    assert out.columns[: len(docs.columns)] == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == "KEEP" for r in rows for c in WORKING)
    if name == "bench":
        assert sorted(r.doc_id or 0 for r in rows) == [0, 1, 2]
    if name == "lines":
        assert {r.doc_id: r.text for r in rows}[2] == "second text"


def test_scores_beyond_64_bits(spark):
    vectors = lambda x: spark.createDataFrame([(0, [x, 1.0]), (50, [x, 2.0])], "vec_id long, embedding array<double>")
    search = lambda df: topk.search(df, df.where("vec_id % 50 = 0")).collect()
    with pytest.raises(Exception, match="too large"):
        search(vectors(1e17))
    big = 4.0e6
    assert {r.score for r in search(vectors(big))} == {int(256 * big) ** 2 + 256 * 512}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_labelled_tables_are_our_own():
    """No long word of a labelled table, and no host, stands in the tables of the tests."""
    read = lambda t, c: "\n".join(x or "" for x in pq.read_table(f"/root/testdata/sf0.1/{t}.parquet", columns=[c])[c].to_pylist())
    words = {w for w in re.findall(r"[^\W_]{9,}", pii.LABELLED) if re.search(r"[0-9]{9,}|[^a-z0-9]", w)}
    known = set(re.findall(r"[^\W_]{9,}", read("documents", "text")))
    assert not words & known, words & known
    hosts = {line.split()[1].rsplit(".", 2)[0] for line in url_filter.LABELLED.split("\n") if line}
    seen = {re.sub(r"^.*?://", "", u).split("/")[0] for u in read("pages", "url").split("\n")}
    seen = {part for host in seen for part in (host, *host.split("."), host.rsplit(".", 2)[0])}
    assert not hosts & seen, hosts & seen

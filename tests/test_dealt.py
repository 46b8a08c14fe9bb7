"""Expansions: requests dealt out by the rows that they give, chains sorted at once."""

from dataclasses import replace

import pytest

from waymark.operators.chains import collect_chains, expand
from waymark.settings import DEFAULTS


@pytest.mark.parametrize("rows_per_task", [1, 20, DEFAULTS.rows_per_task])
def test_expand_deals_requests_out(spark, addrobj, socrbase, rows_per_task):
    ids = [(i, u) for i, u in enumerate(["s1", "s2", "b1", "d2v1", "D2", "x1", "none", None, "r1"])]
    requests = spark.createDataFrame(ids + [(9, "s1")], "request_id bigint, uuid string")
    rows = expand(requests, addrobj, socrbase, replace(DEFAULTS, rows_per_task=rows_per_task))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    # With hot keys they are salted, and few requests need no more tasks.
    assert ("REPARTITION_BY_NUM" in plan) == (rows_per_task == 20)
    got = sorted((r["request_id"], r["depth"], r["aoid"] or "", r["status"]) for r in rows.collect())
    assert [g[1:] for g in got if g[0] == 2] == [(0, "b1", "ok"), (1, "d1", "ok"), (2, "a1", "ok"), (3, "r1", "ok")]
    assert [g[1:] for g in got if g[0] in (6, 7)] == [(None, "", "not_found")] * 2
    assert [g[1:] for g in got if g[0] == 0] == [g[1:] for g in got if g[0] == 9]


def test_chains_are_sorted_without_a_comparator(spark, addrobj, socrbase):
    requests = spark.createDataFrame([(1, "b1")], "request_id bigint, uuid string")
    chains = collect_chains(expand(requests, addrobj, socrbase))
    assert "lambda" not in chains._jdf.queryExecution().optimizedPlan().toString()
    assert [e["aoid"] for e in chains.first()["chain"]] == ["r1", "a1", "d1", "b1"]

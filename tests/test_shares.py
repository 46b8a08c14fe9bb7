"""Work that is dealt out by the rows that come out, and suggestions that need few pairs."""

from pyspark.sql import functions as F

from waymark.operators import suggest as suggesting
from waymark.operators.lexicon import build_lexicon
from waymark.plans.skew import work_join
from waymark.plans.stage import measured, stage


def test_suggest_reads_few_pairs_of_words_without_near_ones(spark, socrbase, monkeypatch):
    """Numbers of seven digits, all with a common start: most share their commonest trigrams only."""
    words = [(str(1_000_000 + 37 * i), 1 + i % 3) for i in range(3000)]
    lexicon = build_lexicon(spark.createDataFrame(words, "word string, frequency bigint"), socrbase)
    asked = [str(1_493_083 + 9091 * i) for i in range(12)]
    probes = []

    def seen(df, name, measure=None):
        staged = stage(df, name, measure)
        if name == "suggest-probes":
            probes.append(measured(staged))
        return staged

    monkeypatch.setattr(suggesting, "stage", seen)
    rows = suggesting.suggest(spark.createDataFrame([(w,) for w in asked], "word string"), lexicon)
    got = {}
    for r in rows.collect():
        got.setdefault(r["word"], []).append((r["pos"], r["suggestion"], r["rank"]))

    grams = lambda w: [f"__{w}__"[i : i + 3] for i in range(len(w) + 2)]
    common = 0
    for w in asked:
        wanted = set(grams(w))
        ranked = [
            (-(sum(g in wanted for g in grams(x)) + 2 - abs(len(x) - len(w))), -f, x)
            for x, f in words if wanted & set(grams(x)) and abs(len(x) - len(w)) <= 2
        ]
        best = sorted(ranked)[:10]
        top = [r for r in best if r[0] - best[0][0] < 2]
        if sum(r[0] == best[0][0] for r in top) >= 2:
            top = [r for r in top if r[0] == best[0][0]]
        assert sorted(got[w]) == [(i + 1, x, -r) for i, (r, _, x) in enumerate(top[:6])]
        common += sum(len(wanted & set(grams(x))) for x, _ in words)
    assert sum(probes) < common / 2, (probes, common)


def test_a_join_with_a_hot_key_is_dealt_out_by_its_rows(spark):
    asking = stage(
        spark.range(400).select((F.col("id") % 40).alias("k"), "id", F.lit(10).cast("bigint").alias("n")),
        "asking", F.sum("n"),
    )
    table = spark.range(400).select((F.col("id") % 40).alias("k"), F.col("id").alias("x"))
    joined = work_join(asking, table, ["k"], "n", ["id"], ["x"], rows_per_task=50)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 320), REPARTITION_BY_NUM") == 2, plan  # 4,000 rows, 4 tasks for 50
    assert joined.count() == 4000

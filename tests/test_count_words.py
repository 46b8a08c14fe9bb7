"""Words are counted whole before they are taken apart."""

from pyspark.sql import functions as F

from waymark.functions.text import index_terms
from waymark.operators.dictionary import count_words


def test_count_words_as_the_terms_of_the_index(spark):
    rows = [("Санкт-Петербургская ул, санкт",), ("a-b-a a-b - -b Ё@ж",), ("",), (None,), ("a a-b-a",)]
    texts = spark.createDataFrame(rows, "text string")
    terms = texts.select(F.explode(index_terms(F.col("text"))["term"]).alias("word"))
    want = {r["word"]: r["count"] for r in terms.groupBy("word").count().collect()}
    counted = count_words(texts)
    assert counted.schema.simpleString() == "struct<word:string,frequency:bigint>"
    assert {r["word"]: r["frequency"] for r in counted.collect()} == want
    assert want["a"] == 6 and want["a-b-a"] == 2 and want["еж"] == 1
    # Texts are not taken apart term by term: one count by chunk, then one by word.
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2, plan

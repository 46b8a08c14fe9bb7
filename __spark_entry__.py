"""Queries of the driver contract.

``entry`` is the flagship query, ``queries`` has one entry per operator and
``oracle_sql`` the same result by DuckDB. The tables are described in
``fixture_tables``, the statements in ``oracles``.
"""

from __future__ import annotations

import importlib.util
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import oracles
from fixture_tables import Fixture
from waymark.operators.chains import collect_chains, expand, full_text
from waymark.functions.markup import strip_markup
from waymark.functions.text import tokenize
from waymark.operators.dictionary import build_dictionary, count_words, most_frequent, with_trigrams
from waymark.operators.find import analyse, find, request_status
from waymark.operators.ids import normalize, to_guid
from waymark.operators.matching import (
    build_index,
    build_postings,
    expand_terms,
    match_requests,
)
from waymark.operators.paths import build_paths
from waymark.operators.queries import plan_queries
from waymark.operators.ranks import rank_words, split_requests, with_match_types
from waymark.operators.saved import open_index, open_lexicon, save_index, save_lexicon
from waymark.operators.suggest import suggest
from waymark.plans.stage import stage, stage_root
from waymark.schemas import ADDROBJ, SOCRBASE
from waymark.settings import SearchSettings
from waymark.sources.checks import unique_violations, width_report
from waymark.sources.quarantine import sort_rows
from waymark.sources.registry import (
    apply_deletes,
    export_tsv,
    export_xml,
    load_registry,
    replace_dictionary,
)
from waymark.sources.versions import append_table, open_table, save_table, versions

llm_queries = corpus_pipeline = None
if importlib.util.find_spec("waymark.llm") and importlib.util.find_spec("corpus_pipeline"):
    # The subpackage and the pipeline on it can be left out.
    import corpus_pipeline
    from waymark.llm import queries as llm_queries

Query = Callable[[SparkSession, str], DataFrame]


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_paths(Fixture(spark, sf_dir).addrobj)


def _normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Fixture(spark, sf_dir)
    return normalize(f.id_requests, f.addrobj)


def _to_guid(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Fixture(spark, sf_dir)
    return to_guid(f.id_requests, f.addrobj)


def _expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Fixture(spark, sf_dir)
    return expand(f.id_requests, f.addrobj, f.socrbase)


def _expand_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    chains = collect_chains(_expand(spark, sf_dir))
    step = F.transform(
        "chain",
        lambda e: F.concat(
            e["shortname"], F.lit(" "), e["formalname"], F.lit(" ("),
            F.coalesce(e["socrname"], F.lit("?")), F.lit(")"),
        ),
    )
    return chains.select(
        "request_id", "status", F.size("chain").alias("n_elements"),
        F.array_join(step, " > ").alias("chain"),
    )


def _full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Fixture(spark, sf_dir)
    return full_text(f.version_requests, f.addrobj)


def _apply_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Fixture(spark, sf_dir)
    return apply_deletes(f.addrobj, f.deletes, "aoid")


def _unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unique_violations(Fixture(spark, sf_dir).addrobj, ["aoguid"])


def _width_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return width_report(Fixture(spark, sf_dir).addrobj, ADDROBJ)


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"


def _tsv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Fixture(spark, sf_dir)
    folder = _new_folder(spark, "tsv")
    export_tsv(f.addrobj, folder, ADDROBJ)
    export_tsv(f.socrbase, folder, SOCRBASE)
    return load_registry(spark, folder)["addrobj"].drop("id")


def _xml_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Fixture(spark, sf_dir)
    folder = _new_folder(spark, "xml")
    for df, spec in ((f.addrobj, ADDROBJ), (f.socrbase, SOCRBASE)):
        columns = []
        for name, kind in spec.columns.items():
            value = F.col(name)
            if kind.typeName() == "boolean":
                value = value.cast("int")
            columns.append(value.cast("string").alias("_" + name.upper()))
        writer = df.select(columns).write.format("xml").option("attributePrefix", "_")
        writer = writer.option("rowTag", spec.row_tag).option("rootTag", "Rows")
        writer.save(f"{folder}/AS_{spec.name}_20210901_a1.XML")
    return load_registry(spark, folder)["addrobj"].drop("id")


def _xml_single_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the original is published: all versions in one file, read in splits."""
    f = Fixture(spark, sf_dir)
    folder = _new_folder(spark, "xml")
    for df, spec in ((f.addrobj, ADDROBJ), (f.socrbase, SOCRBASE)):
        export_xml(df, f"{folder}/AS_{spec.name}_20210901_a1.XML", spec)
    return load_registry(spark, folder)["addrobj"].drop("id")


def _numbered_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part that each row of an export is in, and its line there."""
    f = Fixture(spark, sf_dir)
    folder = _new_folder(spark, "parts")
    export_tsv(f.addrobj, folder, ADDROBJ, settings=SearchSettings(rows_per_file=1000))
    part = F.regexp_extract("_metadata.file_name", r"part([0-9]+)\.csv", 1).cast("bigint")
    lines = spark.read.text(f"{folder}/fd_CREATE_ADDROBJ.part*.csv").select(
        F.split("value", "\t")[0].alias("aoid"), part.alias("part")
    )
    return lines


def _refused_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    refused = sort_rows(Fixture(spark, sf_dir).raw_addrobj, ADDROBJ).refused
    return refused.select("AOID", F.array_join("reasons", "; ").alias("reasons"))


def _table_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table is begun, appended to, and replaced by a part of itself; then all three
    versions are read."""
    f = Fixture(spark, sf_dir)
    path = _new_folder(spark, "versions")
    rows = f.addrobj.select("id", "aoid", "aolevel")
    save_table(rows.where("aolevel < 6"), path)
    append_table(rows.where("aolevel >= 6"), path)
    save_table(open_table(spark, path).where("aolevel <> 6"), path)
    out = None
    for version in versions(spark, path):
        one = open_table(spark, path, version).select(F.lit(version).alias("version"), "id", "aoid")
        out = one if out is None else out.unionByName(one)
    return out


def _dictionary_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The more frequent half of the vocabulary."""
    counted = stage(count_words(Fixture(spark, sf_dir).texts), "half-counts")
    return most_frequent(counted, counted.count() // 2)


def _dictionary_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Fixture(spark, sf_dir)
    lines = _new_folder(spark, "dictionary")
    short = f.dictionary.where(F.length("word") <= 43)  # what fits the stored width
    short.select(F.concat_ws(" ", "word", "frequency").alias("value")).write.text(lines)
    return replace_dictionary(spark, lines, _new_folder(spark, "words"))


def _page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = Fixture(spark, sf_dir).table("pages")
    return count_words(pages.select(strip_markup(F.col("html")).alias("text")))


def _request_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines of the documents would be taken as requests."""
    docs = Fixture(spark, sf_dir).table("documents")
    lines = docs.select(
        F.col("doc_id"), F.posexplode(F.split("text", "\n")).alias("line", "text")
    )
    lines = lines.select(F.concat_ws(":", "doc_id", "line").alias("request_id"), "text")
    return request_status(lines)


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_dictionary(Fixture(spark, sf_dir).texts)


def _trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_trigrams(Fixture(spark, sf_dir).dictionary)


def _find_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_requests(Fixture(spark, sf_dir).find_requests)


def _rank_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Fixture(spark, sf_dir)
    return rank_words(f.word_requests, f.lexicon)


def _rank_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rank_words(spark, sf_dir).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def _match_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = with_match_types(_rank_words(spark, sf_dir))
    return typed.select(
        "request_id", "word", "code", "many_sugg", "some_sugg", "last_star", "both_star",
        "as_is", "add_socr", "is_socr",
    )


def _suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the benchmark texts with its second letter lost."""
    f = Fixture(spark, sf_dir)
    words = f.table("benchmark").select(F.explode(tokenize(F.col("text"))).alias("word"))
    lost = F.concat(F.substring("word", 1, 1), F.expr("substr(word, 3)"))
    misspelt = words.where(F.length("word") > 4).select(lost.alias("word")).distinct()
    return suggest(misspelt, f.lexicon).withColumn("precision", F.round("precision", 9))


def _term_text(column: str) -> Column:
    return F.array_join(
        F.transform(
            column,
            lambda t: F.concat_ws(":", t["term"], F.round(t["boost"] * 100).cast("int")),
        ),
        "|",
    )


def _varied(f: Fixture, strong: bool) -> DataFrame:
    return analyse(f.find_requests, f.lexicon, f.settings, strong)


def _variations(strong: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _varied(Fixture(spark, sf_dir), strong).select(
            "request_id", "pos", "word",
            _term_text("full").alias("full_terms"), _term_text("abbr").alias("abbr_terms"),
        )

    return run


def _query_plans(strong: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = Fixture(spark, sf_dir)
        plans = plan_queries(_varied(f, strong), f.settings, strong)
        term = lambda t: F.concat_ws(":", t["term"], F.round(t["boost"] * 100).cast("int"))
        group = lambda g: F.array_join(F.transform(g, term), "|")
        return plans.select(
            "request_id", "cort", "op",
            F.array_join(F.transform("groups", group), " & ").alias("groups"),
            F.array_join(
                F.transform("sname", lambda t: F.concat(t, F.lit(":100"))), "|"
            ).alias("sname"),
        )

    return run


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_postings(Fixture(spark, sf_dir).paths)


def _index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_index(Fixture(spark, sf_dir).paths).terms.select("field", "term", "df")


def _prefix_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand_terms(Fixture(spark, sf_dir).index.terms)


def _match(op: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = Fixture(spark, sf_dir)
        plans = plan_queries(_varied(f, False), f.settings)
        return match_requests(plans.where(F.col("op") == op), f.index, f.settings).select(
            "request_id", "cort", "pos", "doc_id", "aoid", "fullname", "krank"
        )

    return run


def _find(strong: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = Fixture(spark, sf_dir)
        return find(f.find_requests, f.index, f.lexicon, f.settings, strong)

    return run


def _find_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index and the lexicon are saved, and another session answers with them."""
    f = Fixture(spark, sf_dir)
    folder = _new_folder(spark, "saved")
    save_index(f.index, f"{folder}/index")
    save_lexicon(f.lexicon, f"{folder}/lexicon")
    other = spark.newSession()
    index, lexicon = open_index(other, f"{folder}/index"), open_lexicon(other, f"{folder}/lexicon")
    requests = other.read.parquet(*f.find_requests.inputFiles())
    hits = stage(find(requests, index, lexicon, f.settings), "saved-hits")
    return spark.read.parquet(*hits.inputFiles())


def entry(spark: SparkSession) -> DataFrame:
    """The text of every current address."""
    return _paths(spark, "/root/testdata/sf0.001")


def _run_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    more = {}
    if llm_queries is not None:
        more = llm_queries.queries() | {"pipeline": _run_pipeline}
    return _own_queries() | more


def _own_queries() -> dict[str, Query]:
    return {
        "paths": _paths,
        "normalize": _normalize,
        "to_guid": _to_guid,
        "expand": _expand,
        "expand_chains": _expand_chains,
        "full_text": _full_text,
        "apply_deletes": _apply_deletes,
        "unique_violations": _unique_violations,
        "width_report": _width_report,
        "tsv_roundtrip": _tsv_roundtrip,
        "xml_roundtrip": _xml_roundtrip,
        "xml_single_file": _xml_single_file,
        "numbered_parts": _numbered_parts,
        "refused_rows": _refused_rows,
        "table_versions": _table_versions,
        "dictionary_half": _dictionary_half,
        "dictionary_roundtrip": _dictionary_roundtrip,
        "page_words": _page_words,
        "request_status": _request_status,
        "dictionary": _dictionary,
        "trigrams": _trigrams,
        "find_words": _find_words,
        "rank_words": _rank_words,
        "rank_codes": _rank_codes,
        "match_types": _match_types,
        "suggest": _suggest,
        "variations_soft": _variations(False),
        "variations_strong": _variations(True),
        "postings": _postings,
        "index_terms": _index_terms,
        "prefix_expand": _prefix_expand,
        "query_plans": _query_plans(False),
        "query_plans_strong": _query_plans(True),
        "match_all": _match("and"),
        "match_maybe": _match("maybe"),
        "find_soft": _find(False),
        "find_strong": _find(True),
        "find_saved": _find_saved,
    }


def oracle_sql() -> dict[str, str]:
    more = {}
    if llm_queries is not None:
        more = llm_queries.oracle_sql()
        if corpus_pipeline.ORACLE_SQL:
            more["pipeline"] = corpus_pipeline.ORACLE_SQL
    return oracles.oracle_sql() | more

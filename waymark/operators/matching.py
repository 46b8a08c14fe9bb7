"""Finding the best documents of each query variant in the address corpus.

An index of rare terms points to documents, one of common terms to classes of documents
that are equal but for their rare terms; each variant is looked up by the few groups that
decide its result, and what is found is then checked and scored whole, from the terms it
carries. So the work of a variant does not grow with the documents of its common terms.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.markup import strip_markup
from waymark.functions.text import chunks, index_terms
from waymark.operators.queries import variant_key
from waymark.plans.order import numbered
from waymark.plans.skew import heaviest, salted_join, skew_join, work_join
from waymark.plans.stage import measured, stage
from waymark.settings import DEFAULTS, SearchSettings

SATURATION = 1.2  # the usual constant of the BM25 family
DOCS_PER_PART = 4_000
MAX_BITS = 62
MOST_LISTED = 500  # common terms that go to all tasks as a list


@dataclass(frozen=True)
class SearchIndex:
    """postings: one row per document and rare term of a field, in numbers only: (tid, doc,
    wordcount, ids, sats, plain), and for each field the terms in order, with the steps
    between their positions where these are not all 1. classes: the same for common terms
    and the classes of documents (first, size, lead) that have the same words in both fields
    where rare terms are taken for one (0). members: the documents by class (n, doc); those of
    a class are at `first` and the places after it, in order, from its `lead`. docs: (doc,
    doc_id, aoid, fullname), read for the winners alone. terms: (field, term, tid, df,
    most, classes), `most` being the most occurrences in one document and `classes` the
    number of classes of a common term, null for a rare one. expansions: (prefix, pos, term,
    df), the address terms that a prefix stands for.

    `tid` is the number of a term in a field, `ids` those of a document and `sats`
    their saturated occurrences (empty where `plain` tells that each occurs once). Documents
    are numbered in the order of their id and text, which settles ties. A posting repeats
    the numbers of its document so that a match is scored where it is found. There are far
    more matches than postings, and none of them is shuffled but the best."""

    postings: DataFrame
    classes: DataFrame
    members: DataFrame
    docs: DataFrame
    terms: DataFrame
    expansions: DataFrame
    n_docs: int

    @property
    def sized(self) -> DataFrame:
        return self.terms


def term_number(field: Column, term: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), field, term)


def build_postings(paths: DataFrame) -> DataFrame:
    """(term, doc_id, field, pos) of every term of both text fields. Field `f` is
    the address text and `s` the abbreviations."""
    fields = []
    for field, column in (("f", "fullname"), ("s", "sname")):
        fields.append(
            paths.select(
                F.col("id").alias("doc_id"),
                F.lit(field).alias("field"),
                F.inline(index_terms(strip_markup(F.col(column)))),
            )
        )
    return fields[0].unionByName(fields[1]).select("term", "doc_id", "field", "pos")


def expand_terms(terms: DataFrame, settings: SearchSettings = DEFAULTS) -> DataFrame:
    """(field, term, df) to (prefix, pos, term, df): for each prefix of an address
    term the commonest terms that start with it, then by term. Too short prefixes
    have none. Spark cuts each partition to the first rows of a prefix before the
    shuffle, so no prefix is too common."""
    ends = F.sequence(F.lit(settings.min_prefix), F.length("term"))
    prefixes = F.transform(ends, lambda n: F.substr("term", F.lit(1), n))
    long = terms.where((F.col("field") == "f") & (F.length("term") >= settings.min_prefix))
    rows = long.select(F.explode(prefixes).alias("prefix"), "term", "df")
    order = Window.partitionBy("prefix").orderBy(F.desc("df"), "term")
    ranked = rows.withColumn("pos", F.row_number().over(order))
    return ranked.where(F.col("pos") <= settings.expansion_limit).select(
        "prefix", "pos", "term", "df"
    )


def _steps(positions: Column) -> Column:
    """Steps between positions, the first from -1; null where all are 1."""
    steps = F.transform(positions, lambda p, i: p - F.when(i > 0, F.get(positions, i - 1)).otherwise(-1))
    in_a_row = positions == F.sequence(F.lit(0), F.size(positions) - 1)
    return F.when(~in_a_row, F.when(F.exists(steps, lambda x: x != 1), steps))


def _documents(paths: DataFrame, seed: int) -> DataFrame:
    """Numbered paths with the terms of both fields as lists and as numbers."""
    docs = paths.select(
        F.col("id").alias("doc_id"), "aoid", "fullname", "wordcount", "sname"
    ).where(F.col("fullname").isNotNull())
    docs = numbered(docs, ["doc_id", "fullname", "sname", "aoid"], "index-numbers").select(
        F.col("n").alias("doc"), "doc_id", "aoid", "fullname", "wordcount",
        index_terms(strip_markup(F.col("fullname"))).alias("f"),
        index_terms(strip_markup(F.col("sname"))).alias("s"),
    )
    docs = docs.select(
        "doc", "doc_id", "aoid", "fullname", "wordcount",
        F.col("f.term").alias("f_terms"), F.col("f.pos").alias("f_pos"),
        F.col("s.term").alias("s_terms"), F.col("s.pos").alias("s_pos"),
    )

    def tids(field: str, terms: str) -> Column:
        return F.transform(terms, lambda t: term_number(F.lit(field), t, seed))

    def times(field: str) -> Column:
        """The occurrences of the distinct terms of a field, counted within the row of
        the document, without a shuffle."""
        terms = F.col(f"{field}_terms")
        return F.transform(
            f"{field}_distinct", lambda t: F.size(F.filter(terms, lambda x: x == t))
        )

    def numbers(field: str, before: Column) -> list[Column]:
        """The numbers are those of the distinct terms where no term comes twice."""
        mine = F.slice("ids", before + 1, F.size(f"{field}_terms"))
        ids = F.when(F.col(f"{field}_once"), mine).otherwise(tids(field, f"{field}_terms"))
        return [ids.alias(f"{field}_ids"), _steps(F.col(f"{field}_pos")).alias(f"{field}_steps")]

    for field in ("f", "s"):
        docs = docs.withColumn(f"{field}_distinct", F.array_distinct(f"{field}_terms"))
    once = {k: F.size(f"{k}_distinct") == F.size(f"{k}_terms") for k in ("f", "s")}
    docs = docs.withColumns({f"{k}_once": c for k, c in once.items()})
    docs = docs.withColumn("ids", F.concat(tids("f", "f_distinct"), tids("s", "s_distinct")))
    docs = docs.withColumn("plain", F.col("f_once") & F.col("s_once"))
    docs = docs.withColumn("times", F.when(~F.col("plain"), F.concat(times("f"), times("s"))))
    return docs.select(
        "doc", "doc_id", "aoid", "fullname", "wordcount", "plain", "ids", "times",
        F.concat("f_distinct", "s_distinct").alias("names"), F.size("f_distinct").alias("n_f"),
        F.transform("times", lambda n: n / (n + SATURATION)).alias("sats"),
        *numbers("f", F.lit(0)), *numbers("s", F.size("f_distinct")),
    )


FORM = ["wordcount", "f_ids", "f_steps", "s_ids", "s_steps"]


def _listed(terms: DataFrame) -> list[int] | None:
    """The numbers of the common terms; None if there are too many for a list."""
    found = terms.where("common").select("tid").limit(MOST_LISTED + 1).collect()
    return [r["tid"] for r in found] if len(found) <= MOST_LISTED else None


def _masked(docs: DataFrame, terms: DataFrame, settings: SearchSettings) -> DataFrame:
    """Documents (doc, FORM) in which rare terms have the number 0. Few common terms, as
    usual, are told to each task; many are joined."""
    listed = _listed(terms)
    known = docs
    if listed is None:
        common = terms.where("common").select("tid")
        counts = terms.where("common").select("tid", F.col("df").alias("_rows"))
        rows = docs.select("doc", F.explode("ids").alias("tid"))
        hot = heaviest(counts, ["tid"], settings.rows_per_task)
        known = salted_join(rows, common, ["tid"], ["doc"], hot)
        known = known.groupBy("doc").agg(F.collect_list("tid").alias("common"))
        known = docs.select("doc", *FORM).join(known, "doc", "left")
        known = known.withColumn("common", F.coalesce("common", F.array().cast("array<bigint>")))

    def masked(ids: str) -> Column:
        among = lambda t: F.array_contains("common", t) if listed is None else t.isin(listed)
        zero = F.lit(0).cast("bigint")
        return F.transform(ids, lambda t: F.when(among(t), t).otherwise(zero)).alias(ids)

    return known.select("doc", "wordcount", masked("f_ids"), "f_steps", masked("s_ids"), "s_steps")


def _classes(docs: DataFrame, terms: DataFrame, settings: SearchSettings) -> DataFrame:
    """Documents (doc, FORM) in the order of their classes, with the place `n`: rare terms
    have the number 0. Digests come first, as they are sooner compared."""
    order = [F.xxhash64(*FORM), *FORM, "doc"]
    return numbered(_masked(docs, terms, settings), order, "index-members")


def _class_postings(members: DataFrame) -> DataFrame:
    """One row per class and common term."""
    forms = members.groupBy(*FORM).agg(
        F.min("n").alias("first"), F.count(F.lit(1)).alias("size"), F.min("doc").alias("lead")
    )
    forms = forms.withColumn("all", F.filter(F.concat("f_ids", "s_ids"), lambda t: t != 0))
    forms = forms.withColumn("ids", F.array_distinct("all"))
    times = F.transform("ids", lambda t: F.size(F.filter("all", lambda x: x == t)))
    forms = forms.withColumn("plain", F.size("all") == F.size("ids")).withColumn("times", times)
    sats = F.transform("times", lambda n: n / (n + SATURATION))
    forms = forms.select(
        "first", "size", "lead", "plain", "ids", F.when(~F.col("plain"), sats).alias("sats"), *FORM
    )
    return stage(forms.where(F.size("ids") > 0), "index-classes")


def build_index(
    paths: DataFrame, settings: SearchSettings = DEFAULTS, seed: int = 0
) -> SearchIndex | BuiltIndex:
    docs = stage(_documents(paths, seed), "index-docs")
    n_docs = measured(docs)
    if n_docs is None:
        n_docs = docs.count()
    # A common term has many documents, or so many that it takes from a rank.
    common = (F.col("df") > settings.rare_rows) | (2 * F.col("df") > n_docs + 1)
    items = docs.select("n_f", "times", F.posexplode(F.arrays_zip("names", "ids")))
    terms = (
        items.select(
            F.when(F.col("pos") < F.col("n_f"), "f").otherwise("s").alias("field"),
            F.col("col.names").alias("term"), F.col("col.ids").alias("tid"),
            F.coalesce(F.get("times", F.col("pos")), F.lit(1)).alias("n"),
        )
        .groupBy("field", "term", "tid")
        .agg(F.count(F.lit(1)).alias("df"), F.max("n").alias("most"))
        .withColumn("common", common)
    )
    terms = stage(terms, "index-terms")
    # Two terms of one number would be taken for each other: number them anew.
    again = terms.groupBy("tid").count().where("count > 1 or tid = 0")
    if not again.isEmpty():
        return build_index(paths, settings, seed + 1)
    return BuiltIndex(docs, terms, n_docs, settings)


class BuiltIndex:
    """What `SearchIndex` tells, each table written when first asked for: who asks for terms
    needs no postings. `terms` has no `classes` here; `sized` has."""

    def __init__(self, rows: DataFrame, terms: DataFrame, n_docs: int, settings: SearchSettings):
        self.n_docs = n_docs
        self.docs = rows.select("doc", "doc_id", "aoid", "fullname")
        self.terms = terms.drop("common")
        self._rows, self._terms, self._settings = rows, terms, settings

    @cached_property
    def _members(self) -> DataFrame:
        return _classes(self._rows, self._terms, self._settings)

    @cached_property
    def members(self) -> DataFrame:
        return self._members.select("n", "doc")

    @cached_property
    def classes(self) -> DataFrame:
        forms = _class_postings(self._members)
        # Each posting meets many queries: more tasks than the size calls for.
        spread = forms.repartition(1 + (measured(forms) or 0) // DOCS_PER_PART, "first")
        return stage(spread.select("*", F.explode("ids").alias("tid")), "index-class-postings")

    @cached_property
    def postings(self) -> DataFrame:
        listed, rows = _listed(self._terms), self._rows
        if listed is None:
            masked = self._members.select("doc", F.concat("f_ids", "s_ids").alias("common"))
            rows, rare = rows.join(masked, "doc"), F.array_except("ids", "common")
        else:
            rare = F.filter("ids", lambda t: ~t.isin(listed))
        postings = rows.select(
            "doc", "wordcount", "plain", "ids", "sats", "f_ids", "f_steps", "s_ids", "s_steps",
            F.explode(rare).alias("tid"),
        )
        return stage(postings, "index-postings")

    @cached_property
    def sized(self) -> DataFrame:
        n_classes = self.classes.groupBy("tid").agg(F.count(F.lit(1)).alias("classes"))
        return stage(self.terms.join(n_classes, "tid", "left"), "index-term-classes")

    @cached_property
    def expansions(self) -> DataFrame:
        return stage(expand_terms(self.terms, self._settings), "index-expansions")


def _query_terms(
    variants: DataFrame, index: SearchIndex, settings: SearchSettings, n_terms: int | None
) -> DataFrame:
    """One row per variant, group and index term, with the term's statistics.
    Groups are numbered within their field. A word that the index would split
    becomes several groups."""
    full = variants.select(
        "variant", "op", F.posexplode("groups").alias("g", "alternatives")
    ).select(
        "variant", F.lit("f").alias("field"), "g",
        ((F.col("op") == "and") | (F.col("g") == 0)).alias("required"),
        F.inline("alternatives"),
    )
    short = variants.select("variant", F.posexplode("sname").alias("g", "term")).select(
        "variant", F.lit("s").alias("field"), "g", F.lit(True).alias("required"),
        "term", F.lit(1.0).alias("boost"),
    )
    asked = full.unionByName(short).select(
        "variant", "field", "g", "required", "boost",
        F.col("term").endswith("*").alias("starred"),
        F.posexplode(chunks(F.col("term"))).alias("part", "term"),
    )
    plain = asked.where(~F.col("starred")).drop("starred")
    starred = asked.where("starred").withColumnRenamed("term", "prefix").drop("starred")
    spread = ["variant", "g"]
    limit = settings.rows_per_task
    # The large tables are read for the distinct prefixes and terms, of known number.
    prefixes = stage(starred.select("prefix").distinct(), "match-prefixes")
    expanded = stage(
        index.expansions.select("prefix", "term").join(prefixes, "prefix"), "match-expanded"
    )
    starred = skew_join(
        starred, expanded, ["prefix"], spread, "left", limit, at_most=n_terms
    ).drop("prefix")
    rows = stage(plain.unionByName(starred), "match-rows")
    asked = stage(rows.select("field", "term").distinct(), "match-terms")
    known = stage(index.sized.join(asked, ["field", "term"]), "match-known")
    return skew_join(
        rows, known, ["field", "term"], spread, "left", limit, at_most=measured(rows)
    )


def _idf(index: SearchIndex) -> Column:
    n = index.n_docs
    return F.log((F.lit(n) - F.col("df") + 1) / F.col("df")) / (2 * F.log(F.lit(n + 1.0)))


def _resolve(
    variants: DataFrame, index: SearchIndex, settings: SearchSettings, n_terms: int | None
) -> DataFrame:
    """Distinct variants with their groups of weighted index terms. A variant
    of which a required group has no term in the index cannot match and is
    dropped; an optional group without terms is. `cost` is the number of class postings
    of a group and `most` the most its common terms can add to a rank."""
    rows = _query_terms(variants, index, settings, n_terms)
    term = rows.groupBy("variant", "field", "g", "part", "required", "term").agg(
        F.max("boost").alias("boost"), F.max("tid").alias("tid"),
        F.max("df").alias("df"), F.max("most").alias("most"), F.max("classes").alias("classes"),
    )
    weight = F.col("boost") * _idf(index)
    term = term.withColumn("weight", weight)
    top = F.col("most") / (F.col("most") + SATURATION) * F.col("weight")
    known, common = F.col("df").isNotNull(), F.col("classes").isNotNull()
    most = F.when(common, F.greatest(top, F.lit(0.0)))
    groups = term.groupBy("variant", "field", "g", "part", "required").agg(
        F.coalesce(F.sum("classes"), F.lit(0)).alias("cost"),
        F.coalesce(F.sum(most), F.lit(0.0)).alias("most"),
        F.array_sort(
            F.collect_list(F.when(known, F.struct("term", "tid", "weight", "df", "classes")))
        ).alias("terms"),
    )
    group = F.struct("field", "g", "part", "required", "cost", "most", "terms")
    resolved = groups.groupBy("variant").agg(F.array_sort(F.collect_list(group)).alias("all"))
    resolved = resolved.where(
        ~F.exists("all", lambda g: g["required"] & (F.size(g["terms"]) == 0))
    ).withColumn("all", F.filter("all", lambda g: F.size(g["terms"]) > 0))
    found = variants.select("variant", "op", "n_words").join(resolved, "variant")
    single = F.filter("all", lambda g: g["required"] & (F.size(g["terms"]) == 1))
    return found.where(F.size("all") > 0).select(
        "*", F.array_distinct(F.transform(single, lambda g: g["terms"][0]["tid"])).alias("must")
    )


def _asked(resolved: DataFrame, strong: bool, common: bool) -> DataFrame:
    """What a document, or with `common` a class, is scored by: the terms of all groups,
    or the common ones."""
    kept = (lambda t: t["classes"].isNotNull()) if common else (lambda t: F.lit(True))

    def entries(group: Column, no: Column) -> Column:
        return F.transform(
            F.filter(group["terms"], kept),
            lambda t: F.struct(
                no.alias("no"), group["field"].alias("field"),
                group["required"].alias("required"),
                t["tid"].alias("tid"), t["weight"].alias("weight"),
            ),
        )

    def numbers(field: str) -> Column:
        return F.transform(
            F.filter("all", lambda g: g["field"] == field),
            lambda g: F.transform(F.filter(g["terms"], kept), lambda t: t["tid"]),
        )

    runs = [numbers(k).alias(f"{k}_groups") for k in ("f", "s")] if strong else []
    return resolved.select(
        "variant", "n_words", "must",
        F.flatten(F.transform("all", entries)).alias("entries"),
        F.size("all").alias("n_groups"),
        F.size(F.filter("all", lambda g: g["required"])).alias("n_required"),
        F.aggregate(
            F.transform("all", lambda g, no: F.when(g["required"], _bit(no)).otherwise(_bit(None))),
            _bit(None), lambda bits, b: bits.bitwiseOR(b),
        ).alias("required_bits"),
        *runs,
    )


def _bit(no: Column | None) -> Column:
    none = F.lit(0).cast("bigint")
    return none if no is None else F.call_function("shiftleft", F.lit(1).cast("bigint"), no)


def _with_terms(asked: DataFrame) -> DataFrame:
    """Adds what the entries of each term count for."""

    def mask(field: str) -> Column:
        return F.aggregate(
            F.filter("entries", lambda e: e["field"] == field),
            _bit(None),
            lambda bits, e: bits.bitwiseOR(_bit(e["no"])),
        )

    def of_term(tid: Column) -> Column:
        """All that a term counts for, in whichever groups it is."""
        mine = F.filter("entries", lambda e: e["tid"] == tid)
        weight = F.aggregate(mine, F.lit(0.0), lambda total, e: total + e["weight"])
        bits = F.aggregate(mine, _bit(None), lambda bits, e: bits.bitwiseOR(_bit(e["no"])))
        return F.struct(weight.alias("weight"), bits.alias("bits"))

    return asked.withColumn("q_ids", F.array_distinct("entries.tid")).select(
        "*",
        F.map_from_arrays("q_ids", F.transform("q_ids", of_term)).alias("q_terms"),
        mask("f").alias("f_bits"),
        mask("s").alias("s_bits"),
    )


_MET = "struct<total:double,whole:boolean,f:boolean,s:boolean>"


def _met_by_map() -> Column:
    """What a document has of a variant: the relevance of the matched terms, and
    their groups as bits. For documents without repeated terms. The common terms are
    found first, and only these are looked up."""
    common = F.transform(
        F.array_intersect("q_ids", "ids"), lambda t: F.element_at("q_terms", t)
    )
    state = "struct<total:double,bits:bigint>"
    nothing = F.struct(F.lit(0.0).alias("total"), F.lit(0).cast("bigint").alias("bits"))
    return F.aggregate(
        common,
        nothing.cast(state),
        lambda acc, t: F.struct(
            (acc["total"] + t["weight"]).alias("total"),
            acc["bits"].bitwiseOR(t["bits"]).alias("bits"),
        ),
    )


def _met_by_list() -> Column:
    """The relevance, whether all required groups are there, and whether there is any
    term in each field, for any document and variant. The terms come group by group,
    so a group is counted at its first match."""

    once = F.lit(1 / (1 + SATURATION))

    def add(acc: Column, e: Column) -> Column:
        at = F.array_position("ids", e["tid"]).cast("int")
        counted = e["required"] & (e["no"] != acc["last"])
        found = F.struct(
            (acc["total"] + e["weight"] * F.coalesce(F.get("sats", at - 1), once)).alias("total"),
            (acc["groups"] + counted.cast("int")).alias("groups"),
            e["no"].alias("last"),
            (acc["f"] | (e["field"] == "f")).alias("f"),
            (acc["s"] | (e["field"] == "s")).alias("s"),
        )
        return F.when(at > 0, found).otherwise(acc)

    state = "struct<total:double,groups:int,last:int,f:boolean,s:boolean>"
    nothing = F.struct(
        F.lit(0.5).alias("total"), F.lit(0).alias("groups"), F.lit(-1).alias("last"),
        F.lit(False).alias("f"), F.lit(False).alias("s"),
    ).cast(state)
    return F.aggregate(
        "entries",
        nothing,
        lambda acc, e: add(acc, e).cast(state),
        lambda acc: F.struct(
            acc["total"].alias("total"),
            (acc["groups"] == F.col("n_required")).alias("whole"),
            acc["f"].alias("f"),
            acc["s"].alias("s"),
        ),
    )


def _scored(
    met: DataFrame, places: list[str], settings: SearchSettings, strong: bool
) -> DataFrame:
    """Our own ranking formula; see the README. No rank without all required groups.

    In steps, so that no costly expression is evaluated for each of its uses."""
    plain = F.col("plain") & (F.col("n_groups") <= MAX_BITS)
    step = met.withColumn("quick", F.when(plain, _met_by_map()))
    bits = F.col("quick.bits")
    by_map = F.struct(
        (0.5 + F.col("quick.total") / (1 + SATURATION)).alias("total"),
        (bits.bitwiseAND(F.col("required_bits")) == F.col("required_bits")).alias("whole"),
        (bits.bitwiseAND(F.col("f_bits")) != 0).alias("f"),
        (bits.bitwiseAND(F.col("s_bits")) != 0).alias("s"),
    ).cast(_MET)
    step = step.withColumn(
        "met",
        F.when(F.col("quick").isNotNull(), by_map).otherwise(_met_by_list().cast(_MET)),
    )
    bm25 = F.floor(F.round(1000 * F.col("met.total"), 6)).cast("int")
    if strong:
        fields = _longest_run("f") + _longest_run("s")
    else:
        fields = F.col("met.f").cast("int") + F.col("met.s").cast("int")
    apart = F.abs(F.col("wordcount") - F.col("n_words"))
    rank = 1000 * fields + bm25 - settings.length_penalty * apart
    return step.select(
        "variant", *places, F.when(F.col("met.whole"), rank).alias("krank"),
    )


def _longest_run(field: str) -> Column:
    """Most groups in a row that are found at as many positions in a row. Each
    group in turn looks where it is found; a run goes on where the group before
    it was found one position earlier."""
    terms = F.col(f"{field}_ids")
    none_yet = F.array().cast("array<int>")
    positions = F.aggregate(
        f"{field}_steps", none_yet,
        lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(-1)) + x)),
    )
    places = F.coalesce(positions, F.transform(terms, lambda t, i: i))
    groups = F.col(f"{field}_groups")
    state = "struct<at:array<struct<pos:int,run:int>>,best:int>"

    def add(acc: Column, g: Column) -> Column:
        spots = F.array_distinct(
            F.transform(
                F.filter(F.arrays_zip(places.alias("pos"), terms.alias("term")),
                         lambda z: F.array_contains(g, z["term"])),
                lambda z: z["pos"],
            )
        )
        at = F.transform(
            spots,
            lambda p: F.struct(
                p.alias("pos"),
                (
                    F.coalesce(
                        F.array_max(
                            F.transform(
                                F.filter(acc["at"], lambda a: a["pos"] == p - 1),
                                lambda a: a["run"],
                            )
                        ),
                        F.lit(0),
                    )
                    + 1
                ).alias("run"),
            ),
        )
        best = F.greatest(
            acc["best"], F.coalesce(F.array_max(F.transform(at, lambda a: a["run"])), F.lit(0))
        )
        return F.struct(at.alias("at"), best.alias("best"))

    none = F.struct(
        F.array().cast("array<struct<pos:int,run:int>>").alias("at"), F.lit(0).alias("best")
    ).cast(state)
    return F.aggregate(groups, none, add, lambda acc: acc["best"])


def _best(hits: DataFrame, settings: SearchSettings, tie: str = "doc") -> DataFrame:
    """The best hits of each variant. Documents that do not match have no rank and
    come last; leaving them out only here spares scoring them twice."""
    order = Window.partitionBy("variant").orderBy(F.col("krank").desc_nulls_last(), tie)
    ranked = hits.withColumn("pos", F.row_number().over(order))
    return ranked.where(F.col("pos") <= settings.max_hits).where(F.col("krank").isNotNull())


def _look_up(
    asked: DataFrame,
    table: DataFrame,
    places: list[str],
    settings: SearchSettings,
    strong: bool,
) -> DataFrame:
    """Variants with the terms to look up (`probed`: tid, rows) to the best rows of `table`
    that have one of the terms and all required groups.

    The terms looked up carry their variant along to the postings. Only the best
    hits of each task are shuffled."""
    probes = _with_terms(asked).withColumn("probe", F.explode("probed"))
    probes = probes.withColumn("probed", F.col("probed.tid")).select("*", "probe.*").drop("probe")
    probes = stage(probes, "match-probes", F.sum("rows"))
    met = work_join(
        probes, table, ["tid"], "rows", ["variant"], places[:1], settings.rows_per_task
    )
    # What is found by several terms is kept at the first of them only.
    first = F.array_intersect("probed", "ids")[0]
    met = met.where((F.size("probed") == 1) | (F.col("tid") == first))
    # Required groups of one term can be tested before anything is scored.
    met = met.where(F.size(F.array_intersect("must", "ids")) == F.size("must"))
    return _best(_scored(met, places, settings, strong), settings, places[-1])


def _by_rare_terms(
    resolved: DataFrame, index: SearchIndex, settings: SearchSettings, strong: bool
) -> DataFrame:
    """The best documents that have a rare term of the variant. Where a required group has
    rare terms alone, the cheapest such group finds all that match; else all groups are
    looked up, so that no other document has more of the variant than its class."""

    def to_look_up(terms: Column) -> Column:
        return F.transform(terms, lambda t: F.struct(t["tid"].alias("tid"), t["df"].alias("rows")))

    def cost(group: Column) -> Column:
        return F.aggregate(group["terms"], _bit(None), lambda total, t: total + t["df"])

    lone = F.filter("all", lambda g: g["required"] & (g["cost"] == 0))
    cheapest = F.array_min(
        F.transform(lone, lambda g: F.struct(cost(g).alias("cost"), to_look_up(g["terms"]).alias("terms")))
    )["terms"]
    rare = F.filter(F.flatten(F.transform("all", lambda g: g["terms"])), lambda t: t["classes"].isNull())
    probed = F.array_sort(F.array_distinct(F.coalesce(cheapest, to_look_up(rare))))
    probed = resolved.select("variant", probed.alias("probed"))
    asked = _asked(resolved, strong, False).join(probed, "variant")
    # Few of all postings are asked for: the others are left out where they are read.
    tids = stage(probed.select(F.explode("probed.tid").alias("tid")).distinct(), "match-tids")
    postings = index.postings.join(tids, "tid", "left_semi")
    return _look_up(asked, postings, ["doc"], settings, strong)


def _by_classes(
    groups: DataFrame,
    resolved: DataFrame,
    index: SearchIndex,
    settings: SearchSettings,
    strong: bool,
) -> DataFrame:
    """Groups to look up (variant, terms) to the best documents by what their classes have.

    Variants that ask the same of classes are looked up once. Documents of one class are
    equal here, so the first ones of the best classes are the best."""
    probed = (
        groups.select("variant", F.inline("terms"))
        .where(F.col("classes").isNotNull())
        .groupBy("variant")
        .agg(F.array_sort(F.collect_set(F.struct("tid", F.col("classes").alias("rows")))).alias("probed"))
    )
    asked = _asked(resolved, strong, True).join(probed, "variant")
    content = F.to_json(F.struct(*[c for c in asked.columns if c != "variant"]))
    asked = stage(asked.withColumn("same", F.unhex(F.md5(content))), "match-asked")
    once = asked.drop("variant").dropDuplicates(["same"]).withColumnRenamed("same", "variant")
    found = stage(
        _look_up(once, index.classes, ["first", "size", "lead"], settings, strong),
        "match-classes",
    )
    last = F.least("size", F.lit(settings.max_hits)).cast("bigint") - 1
    spots = F.sequence(F.lit(0).cast("bigint"), last)
    n_found = measured(found)
    places = found.select("variant", "krank", "first", F.explode(spots).alias("spot"))
    docs = skew_join(
        places.select("variant", "krank", (F.col("first") + F.col("spot")).alias("n")),
        index.members, ["n"], ["variant"], rows_per_task=settings.rows_per_task,
        at_most=None if n_found is None else n_found * settings.max_hits,
    )
    best = stage(_best(docs, settings), "match-class-hits")
    return skew_join(
        asked.select("variant", "same"),
        best.select(F.col("variant").alias("same"), "doc", "krank"), ["same"], ["variant"],
        rows_per_task=settings.rows_per_task, at_most=measured(asked),
    ).select("variant", "doc", "krank")


def _together(found: list[DataFrame], settings: SearchSettings, name: str) -> DataFrame:
    """The best of all hits. A document counts by the most that is known of it."""
    rows = None
    for hits in found:
        hits = hits.select("variant", "doc", "krank")
        rows = hits if rows is None else rows.unionByName(hits)
    rows = rows.groupBy("variant", "doc").agg(F.max("krank").alias("krank"))
    return stage(_best(rows, settings), name)


def _fetched(hits: DataFrame, index: SearchIndex, settings: SearchSettings) -> DataFrame:
    """The best hits with their documents; one document may be a hit of many variants."""
    return skew_join(
        hits.select("variant", "pos", "doc", "krank"), index.docs, ["doc"], ["variant"],
        rows_per_task=settings.rows_per_task, at_most=measured(hits),
    ).select("variant", "pos", "doc_id", "aoid", "fullname", "krank")


def _groups(resolved: DataFrame) -> DataFrame:
    """Groups of each variant in the order of cost, with what comes before."""
    rows = resolved.select(
        "variant", "op", F.size(F.filter("all", lambda g: g["field"] == "s")).alias("n_short"),
        F.inline("all"),
    )
    by_cost = Window.partitionBy("variant").orderBy("cost", "field", "g", "part")
    before = by_cost.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("variant")
    required_cost = F.when(F.col("required"), F.col("cost"))
    first_required = F.row_number().over(
        Window.partitionBy("variant").orderBy(F.desc("required"), "cost", "field", "g", "part")
    )
    return rows.select(
        "*",
        F.coalesce(F.sum("cost").over(before), F.lit(0)).alias("cost_before"),
        F.coalesce(F.sum("most").over(before), F.lit(0.0)).alias("most_before"),
        F.sum("most").over(whole).alias("most_all"),
        F.min(required_cost).over(whole).alias("cost_required"),
        (first_required == 1).alias("main"),
    )


def match(
    variants: DataFrame,
    index: SearchIndex,
    settings: SearchSettings = DEFAULTS,
    strong: bool = False,
    n_terms: int | None = None,
) -> DataFrame:
    """Distinct variants (variant, op, groups, sname, n_words) to their best hits
    (variant, pos, doc_id, aoid, fullname, krank).

    Documents that have a rare term of the variant are found by it. The others have
    no more of the variant than their class, so classes are looked up in their place.
    If all groups are required it is enough to look up the cheapest one. If only
    the first group is, its classes may be most of the corpus, but few can be
    among the best. The cheapest groups are looked up first; their hits give a
    bound that the last hit wanted reaches. Classes with none of the groups
    looked up cannot get more than the other groups add. Groups are looked up in
    the order of cost until that is below the bound, or until the required group
    is no dearer, which settles the matter too. `n_terms` is an upper bound of the
    variants and their terms, if known. Boosts must not be negative."""
    resolved = stage(_resolve(variants, index, settings, n_terms), "match-variants")
    groups = stage(_groups(resolved), "match-groups")

    whole = Window.partitionBy("variant")
    early = F.col("cost_before") < settings.probe_rows
    spent = F.sum(F.when(early, F.col("cost"))).over(whole)
    first = groups.withColumn("early", early).withColumn(
        "settled", (F.col("op") == "and") | (spent >= F.col("cost_required"))
    )
    first = first.where(F.when(F.col("settled"), F.col("main")).otherwise(F.col("early")))
    hits = _together(
        [
            _by_rare_terms(resolved, index, settings, strong),
            _by_classes(first, resolved, index, settings, strong),
        ],
        settings, "match-first",
    )
    if strong:
        return _fetched(hits, index, settings)

    last = hits.where(F.col("pos") == settings.max_hits).select(
        "variant", F.col("krank").alias("bound")
    )
    open_groups = (
        groups.where(F.col("op") != "and")
        .withColumn("early", early)
        .withColumn("spent", spent)
        .where(F.col("spent") < F.col("cost_required"))
        .join(last, "variant", "left")
    )
    # The most that a document can get without this group and all before it...
    fields = 1 + (F.col("n_short") > 0).cast("int")
    without = F.floor(
        F.round(1000 * (0.5 + F.col("most_all") - F.col("most_before")), 6)
    ) + 1000 * fields
    # ... which may still reach the bound, so the group must be looked up. One
    # point is left for the rounding of sums.
    needed = F.col("bound").isNull() | (without + 1 >= F.col("bound"))
    needed_cost = F.sum(F.when(F.col("needed"), F.col("cost"))).over(whole)
    second = (
        open_groups.withColumn("needed", needed)
        .withColumn("dear", needed_cost >= F.col("cost_required"))
        .where(
            F.when(F.col("dear"), F.col("main")).otherwise(F.col("needed") & ~F.col("early"))
        )
    )
    second = stage(second.select("variant", "terms"), "match-second")
    if second.isEmpty():
        return _fetched(hits, index, settings)
    more = _by_classes(second, resolved, index, settings, strong)
    return _fetched(_together([hits, more], settings, "match-both"), index, settings)


def match_requests(
    variants: DataFrame,
    index: SearchIndex,
    settings: SearchSettings = DEFAULTS,
    strong: bool = False,
) -> DataFrame:
    """Variants of requests (see `plan_queries`) to hits (request_id, cort, pos,
    doc_id, aoid, fullname, krank). Equal variants are looked up once."""
    n_terms = F.aggregate("groups", F.size("sname") + 1, lambda n, g: n + F.size(g))
    keyed = stage(
        variants.withColumn("variant", variant_key()), "match-requests", F.sum(n_terms)
    )
    distinct = keyed.drop("request_id", "cort").dropDuplicates(["variant"])
    most = measured(keyed)
    hits = match(distinct, index, settings, strong, most)
    return skew_join(
        keyed.select("request_id", "cort", "variant"), hits, ["variant"], ["request_id"],
        rows_per_task=settings.rows_per_task, at_most=most,
    ).drop("variant")

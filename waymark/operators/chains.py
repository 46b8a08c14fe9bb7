"""Climbing from an address to its region: `expand` and `full_text`.

The ancestors of a row depend only on its `parentguid`, so each distinct parent
is climbed once, however many requests lie below it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.predicates import is_current
from waymark.operators.ids import resolve_requests
from waymark.plans.doubling import climb
from waymark.plans.skew import heaviest, salted_join, skew_join, tasks_of
from waymark.plans.stage import measured, stage
from waymark.settings import DEFAULTS, SearchSettings

ELEMENT = ["aoid", "aoguid", "shortname", "formalname", "aolevel", "regioncode"]


def _own_text() -> F.Column:
    return F.concat("shortname", F.lit(" "), "formalname")


def _parents_of(starts: DataFrame) -> DataFrame:
    parents = starts.where(F.col("parentguid").isNotNull())
    return stage(parents.select(F.col("parentguid").alias("guid")).distinct(), "climb-guids")


def _edges(parents: DataFrame, inner: DataFrame, carried: list[str]) -> DataFrame:
    """Of the current rows (up, above, ...) those of objects that something lies below:
    (a, b, carried). Leaves, the bulk of a registry, take no part in the climb."""
    rows = parents.join(inner.withColumnRenamed("guid", "up"), "up", "left_semi")
    return rows.where(F.col("above").isNotNull()).select(
        F.col("up").alias("a"), F.col("above").alias("b"), *carried
    )


def _inner(parents: DataFrame, guids: DataFrame) -> DataFrame:
    above = parents.where(F.col("above").isNotNull()).select(F.col("above").alias("guid"))
    return stage(above.unionByName(guids).distinct(), "climb-inner")


def under(upper: Column, lower: Column) -> Column:
    """The text of a path, from its top downwards."""
    return F.concat(upper, F.lit(", "), lower)


def topped(
    found: DataFrame,
    jumps: DataFrame,
    carried: list[str],
    step: Callable[[Column, Column], Column],
    settings: SearchSettings,
) -> DataFrame:
    """Paths that reach a top (parentguid, carried), longer by the paths of `jumps`."""
    tops = found.select(
        F.col("parentguid").alias("b"), *[F.col(c).alias(f"_{c}") for c in carried]
    )
    longer = skew_join(jumps, tops, ["b"], ["a"], rows_per_task=settings.rows_per_task,
                       at_most=measured(jumps))
    together = [step(F.col(f"_{c}"), F.col(c)).alias(c) for c in carried]
    return longer.select(F.col("a").alias("parentguid"), *together)


def expand(
    requests: DataFrame,
    addrobj: DataFrame,
    socrbase: DataFrame,
    settings: SearchSettings = DEFAULTS,
) -> DataFrame:
    """(request_id, uuid) to one row per element of the chain: the version asked
    for (depth 0) and the current rows of its ancestors, as far as they exist.
    `socrname` is null where the abbreviation is unknown. A request that finds
    nothing gives one row with status `not_found`. Order by `aolevel`, `depth`
    descending, to read a chain from its top."""
    found = stage(
        resolve_requests(requests, addrobj, settings).select("request_id", "aoid"), "expand-ids"
    )
    # How often each version is asked for tells all hot keys below, without the joins.
    counts = stage(found.groupBy("aoid").agg(F.count(F.lit(1)).alias("_rows")), "expand-asked")
    starts = stage(
        addrobj.select(*ELEMENT, "parentguid").join(counts, "aoid"), "expand-starts"
    )
    guids = _parents_of(starts)
    parents = stage(
        addrobj.where(is_current()).select(
            F.col("aoguid").alias("up"), *ELEMENT, F.col("parentguid").alias("above")
        ),
        "expand-parents",
    )

    # The objects on the way up from each parent, with their distance; then their rows.
    start = guids.select("guid", F.col("guid").alias("at"), F.lit(1).alias("depth"))

    def further(found: DataFrame, jumps: DataFrame) -> DataFrame:
        length = 1 << further.rounds
        further.rounds += 1
        return skew_join(
            found.withColumnRenamed("at", "a"), jumps, ["a"], ["guid"],
            rows_per_task=settings.rows_per_task, at_most=measured(found),
        ).select("guid", F.col("b").alias("at"), (F.col("depth") + length).alias("depth"))

    further.rounds = 0
    way = climb(
        _edges(parents, _inner(parents, guids), []), start, further, None, [], settings
    )
    above = skew_join(
        way.withColumnRenamed("at", "up"), parents, ["up"], ["guid"],
        rows_per_task=settings.rows_per_task, at_most=measured(way),
    ).select("guid", "depth", *ELEMENT)

    names = (
        socrbase.select(
            F.col("scname").alias("shortname"), F.col("level").alias("aolevel"), "socrname"
        )
    )
    keys = ["shortname", "aolevel"]
    above = above.join(names, keys, "left")
    own = starts.drop("_rows").join(names, keys, "left").withColumn("depth", F.lit(0))

    # Each request meets its own row, then the ancestors of that row's parent.
    spread, per_task = ["request_id"], settings.rows_per_task
    total = measured(found)
    hot_starts = hot_guids = tasks = None
    if total is None or total > per_task:
        by_guid = starts.groupBy(F.col("parentguid").alias("guid")).agg(F.sum("_rows").alias("_rows"))
        hot_starts = heaviest(counts.withColumnRenamed("aoid", "start"), ["start"], per_task)
        hot_guids = heaviest(by_guid.where(F.col("guid").isNotNull()), ["guid"], per_task)
    if total is not None:
        tasks = tasks_of(found, total, per_task)
    own_rows = salted_join(
        found.withColumnRenamed("aoid", "start"), own.withColumn("start", F.col("aoid")),
        ["start"], spread, hot_starts, "left", tasks,
    )
    upper_rows = salted_join(
        own_rows.where(F.col("parentguid").isNotNull()).select(
            "request_id", F.col("parentguid").alias("guid")
        ),
        above, ["guid"], spread, hot_guids, tasks=tasks,
    )
    columns = ["request_id", "depth", *ELEMENT, "socrname"]
    status = F.when(F.col("aoid").isNull(), "not_found").otherwise("ok").alias("status")
    rows = own_rows.select(columns).unionByName(upper_rows.select(columns))
    return rows.select(*columns, status)


def collect_chains(elements: DataFrame) -> DataFrame:
    """Result of `expand` as one row per request with the chain as an array, top
    first. A chain is no longer than the depth of the hierarchy."""
    item = F.struct(
        "aolevel", (-F.col("depth")).alias("order"), *[c for c in ELEMENT if c != "aolevel"],
        "socrname",
    )
    chain = F.sort_array(F.collect_list(F.when(F.col("status") == "ok", item)))
    return elements.groupBy("request_id", "status").agg(chain.alias("chain"))


def full_text(
    requests: DataFrame, addrobj: DataFrame, settings: SearchSettings = DEFAULTS
) -> DataFrame:
    """(request_id, uuid), where uuid is a version identifier, to (request_id,
    fullname, status). The text is given only if the chain reaches a root; the
    smallest one if several do. A missing name makes the text null: `invalid`."""
    ids = requests.select(F.col("uuid").alias("aoid")).distinct()
    starts = stage(
        addrobj.select("aoid", "parentguid", _own_text().alias("own")).join(
            ids, "aoid", "left_semi"
        ),
        "text-starts",
    )
    guids = _parents_of(starts)
    parents = stage(
        addrobj.where(is_current()).select(
            F.col("aoguid").alias("up"),
            _own_text().alias("name"),
            F.col("parentguid").alias("above"),
        ),
        "text-parents",
    )

    inner = _inner(parents, guids)
    tops = parents.where(F.col("above").isNull()).join(
        inner.withColumnRenamed("guid", "up"), "up", "left_semi"
    )
    complete = climb(
        _edges(parents, inner, [F.col("name").alias("text")]),
        tops.select(F.col("up").alias("parentguid"), F.col("name").alias("text")),
        lambda found, jumps: topped(found, jumps, ["text"], under, settings),
        under, ["text"], settings,
    )
    lower = skew_join(
        starts.where(F.col("parentguid").isNotNull()),
        complete,
        ["parentguid"],
        ["aoid"],
        rows_per_task=settings.rows_per_task,
        at_most=measured(starts),
    ).select("aoid", F.concat("text", F.lit(", "), "own").alias("fullname"))
    roots = starts.where(F.col("parentguid").isNull()).select(
        "aoid", F.col("own").alias("fullname")
    )
    texts = (
        roots.unionByName(lower)
        .groupBy(F.col("aoid").alias("uuid"))
        .agg(F.min("fullname").alias("fullname"), F.lit(True).alias("reached"))
    )
    status = (
        F.when(F.col("reached").isNull(), "not_found")
        .when(F.col("fullname").isNull(), "invalid")
        .otherwise("ok")
    )
    return skew_join(
        requests, texts, ["uuid"], ["request_id"], "left", settings.rows_per_task
    ).select("request_id", "fullname", status.alias("status"))

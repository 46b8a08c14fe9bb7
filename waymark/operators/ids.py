"""Version and object identifiers: `normalize` and `to_guid`.

Requests are a DataFrame (request_id, uuid); identifiers are canonical text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.predicates import is_current
from waymark.plans.skew import skew_join
from waymark.settings import DEFAULTS, SearchSettings


def resolve(ids: DataFrame, addrobj: DataFrame) -> DataFrame:
    """Distinct (uuid) to (uuid, aoid, aoguid). An identifier names a version in
    any state, or else the current version of an object. Of several matches a
    version wins over an object, then the smallest `id`."""
    columns = ["id", "aoid", "aoguid"]
    by_version = addrobj.select(F.col("aoid").alias("uuid"), F.lit(0).alias("kind"), *columns)
    by_object = addrobj.where(is_current()).select(
        F.col("aoguid").alias("uuid"), F.lit(1).alias("kind"), *columns
    )
    matches = ids.join(by_version.unionByName(by_object), "uuid")
    best = F.min(F.struct("kind", "id", "aoid", "aoguid")).alias("best")
    return matches.groupBy("uuid").agg(best).select("uuid", "best.aoid", "best.aoguid")


def resolve_requests(
    requests: DataFrame, addrobj: DataFrame, settings: SearchSettings = DEFAULTS
) -> DataFrame:
    """Requests with `aoid` and `aoguid`, null where nothing was found."""
    found = resolve(requests.select("uuid").distinct(), addrobj)
    return skew_join(
        requests, found, ["uuid"], ["request_id"], "left", settings.rows_per_task
    )


def _status(column: str) -> F.Column:
    return F.when(F.col(column).isNull(), "not_found").otherwise("ok").alias("status")


def normalize(
    requests: DataFrame, addrobj: DataFrame, settings: SearchSettings = DEFAULTS
) -> DataFrame:
    """(request_id, uuid) to (request_id, aoid, status)."""
    found = resolve_requests(requests, addrobj, settings)
    return found.select("request_id", "aoid", _status("aoid"))


def to_guid(
    requests: DataFrame, addrobj: DataFrame, settings: SearchSettings = DEFAULTS
) -> DataFrame:
    """(request_id, uuid) to (request_id, aoguid, status). A version without an
    object identifier is found, but has nothing to give: `invalid`."""
    found = resolve_requests(requests, addrobj, settings)
    status = (
        F.when(F.col("aoid").isNull(), "not_found")
        .when(F.col("aoguid").isNull(), "invalid")
        .otherwise("ok")
    )
    return found.select("request_id", "aoguid", status.alias("status"))

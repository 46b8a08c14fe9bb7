"""Registry tables and requests derived from the driver's tables.

The texts of ADDROBJ, SOCRBASE and the requests run in Spark and in DuckDB alike;
`{name}` stands for a driver table or an earlier derived one. What an operator
builds (paths, dictionary, index) is built by the operator on the Spark side.
Built tables are kept for the session, as a registry is loaded once and then
asked many times.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators.dictionary import build_dictionary
from waymark.operators.lexicon import Lexicon, build_lexicon
from waymark.operators.matching import SearchIndex, build_index
from waymark.operators.paths import build_paths
from waymark.plans.stage import stage
from waymark.settings import DEFAULTS, SearchSettings

ADDROBJ = """
SELECT CAST(1 + r_regionkey AS BIGINT) AS id, concat('r', r_regionkey) AS aoid,
       concat('R', r_regionkey) AS aoguid, 'reg' AS shortname, r_name AS formalname,
       1 AS aolevel, CAST(NULL AS STRING) AS parentguid, true AS actstatus,
       true AS livestatus, CAST(NULL AS STRING) AS nextid, r_regionkey AS regioncode
FROM {region}
UNION ALL
SELECT CAST(100 + n_nationkey AS BIGINT), concat('n', n_nationkey), concat('N', n_nationkey),
       'st', n_name, CASE WHEN n_nationkey % 2 = 0 THEN 3 ELSE 4 END,
       concat('R', n_regionkey), true, true, CAST(NULL AS STRING), n_regionkey
FROM {nation}
UNION ALL
SELECT 1000000 + 2 * c_custkey, concat('c', c_custkey, 'v2'), concat('C', c_custkey),
       CASE c_custkey % 3 WHEN 0 THEN 'cty' WHEN 1 THEN 'vlg' ELSE 'stl' END,
       c_mktsegment, 6, concat('N', c_nationkey), true, c_custkey % 11 <> 0,
       CAST(NULL AS STRING), n_regionkey
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
UNION ALL
SELECT 1000001 + 2 * c_custkey, concat('c', c_custkey, 'v1'), concat('C', c_custkey), 'vlg',
       c_name, 6, concat('N', c_nationkey), false, false, concat('c', c_custkey, 'v2'),
       n_regionkey
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE c_custkey % 5 = 0
UNION ALL
SELECT 10000000 + o_orderkey, concat('o', o_orderkey), concat('O', o_orderkey),
       CASE o_orderkey % 2 WHEN 0 THEN 'str' ELSE 'ave' END, concat(p_name, ' ', o_orderkey),
       7, concat('C', o_custkey), true, true, CAST(NULL AS STRING), n_regionkey
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
     JOIN {nation} ON c_nationkey = n_nationkey
     JOIN {part} ON p_partkey = o_orderkey % (SELECT count(*) FROM {part})
"""

SOCRBASE = """
SELECT * FROM (VALUES (1,'reg','Region','101'),(3,'st','State','301'),(4,'st','State','401'),
  (6,'cty','City','601'),(6,'vlg','Village','602'),(7,'str','Street','701'),
  (7,'ave','Avenue','702')) AS v(level, scname, socrname, kod_t_st)
"""

# The registry as text under the names of the files, with faults of every kind: lost keys,
# levels and flags that are none, too long names, and keys that stand twice.
RAW_ADDROBJ = """
SELECT CASE WHEN id % 211 = 0 THEN NULL ELSE aoid END AS AOID, aoguid AS AOGUID,
       CASE WHEN id % 107 = 0 THEN 'settlement of a type' ELSE shortname END AS SHORTNAME,
       formalname AS FORMALNAME,
       CASE WHEN id % 101 = 0 THEN 'seven' WHEN id % 103 = 0 THEN '70000'
            ELSE CAST(aolevel AS STRING) END AS AOLEVEL,
       parentguid AS PARENTGUID,
       CASE WHEN id % 109 = 0 THEN 'maybe' WHEN actstatus THEN '1' ELSE '0' END AS ACTSTATUS,
       CASE WHEN livestatus THEN '1' ELSE '0' END AS LIVESTATUS, nextid AS NEXTID,
       CAST(regioncode AS STRING) AS REGIONCODE
FROM {addrobj}
UNION ALL
SELECT upper(aoid), aoguid, shortname, formalname, '7', parentguid, '1', '1', nextid, '1'
FROM {addrobj} WHERE id % 113 = 0
"""

# Every version, every object, and one unknown identifier per supplier.
ID_REQUESTS = """
SELECT id AS request_id, aoid AS uuid FROM {addrobj}
UNION ALL SELECT id + 1000000000, aoguid FROM {addrobj}
UNION ALL SELECT 2000000000 + s_suppkey, concat('missing', s_suppkey) FROM {supplier}
"""

# Versions, and identifiers that are no versions.
VERSION_REQUESTS = """
SELECT id AS request_id, aoid AS uuid FROM {addrobj}
UNION ALL SELECT 2000000000 + s_suppkey, concat('missing', s_suppkey) FROM {supplier}
"""

# Delete lists of the delta query: the address of every supplier's latest order,
# keys that are not in the registry, and a null key.
DELETES = """
SELECT concat('o', max(l_orderkey)) AS aoid FROM {lineitem} GROUP BY l_suppkey
UNION ALL SELECT concat('missing', s_suppkey) FROM {supplier}
UNION ALL SELECT CAST(NULL AS STRING)
"""

# Each word of the dictionary as it is, cut, with a letter lost, and doubled; and
# each abbreviation in both forms.
WORD_REQUESTS = """
SELECT concat(word, ':exact') AS request_id, 0 AS pos, word FROM {dictionary}
UNION ALL SELECT concat(word, ':cut'), 0, substr(word, 1, length(word) - 2)
          FROM {dictionary} WHERE length(word) > 3
UNION ALL SELECT concat(word, ':lost'), 0, concat(substr(word, 1, 1), substr(word, 3))
          FROM {dictionary} WHERE length(word) > 4
UNION ALL SELECT concat(word, ':twice'), k, word
          FROM {dictionary} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) kk
UNION ALL SELECT concat(w, ':short'), 0, w
          FROM (SELECT lower(socrname) AS w FROM {socrbase}
                UNION SELECT lower(scname) FROM {socrbase}) s
"""

# The street of every supplier's latest order: as written, with full type names,
# misspelt (the letter i lost), and with its last character cut.
FIND_REQUESTS = """
SELECT l_suppkey AS request_id, l_suppkey % 4 AS kind,
 CASE l_suppkey % 4
   WHEN 0 THEN fullname
   WHEN 1 THEN replace(replace(fullname, ', str ', ', street '), ', ave ', ', avenue ')
   WHEN 2 THEN replace(lower(fullname), 'i', '')
   ELSE substr(fullname, 1, length(fullname) - 1) END AS text
FROM {paths}
JOIN (SELECT l_suppkey, 10000000 + max(l_orderkey) AS street FROM {lineitem} GROUP BY l_suppkey) s
  ON id = street
"""

# A word is frequent if it is in two addresses of three.
FREQ_THRESHOLD = "SELECT CAST(floor(count(*) * 2 / 3) AS BIGINT) AS n FROM {orders}"

TABLES = "region nation customer supplier part orders lineitem documents pages benchmark".split()
_kept: dict[tuple[str, str, str], object] = {}


class Fixture:
    """Derived tables of one scale folder, each built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def _keep(self, name: str, build: Callable[[], object]):
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _kept:
            _kept[key] = build()
        return _kept[key]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str, **derived: DataFrame) -> DataFrame:
        frames = {t: self.table(t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **frames, **derived)

    def _staged(self, name: str, text: str, **derived: DataFrame) -> DataFrame:
        return self._keep(name, lambda: stage(self.sql(text, **derived), name))

    @property
    def addrobj(self) -> DataFrame:
        return self._staged("addrobj", ADDROBJ)

    @property
    def raw_addrobj(self) -> DataFrame:
        return self.sql(RAW_ADDROBJ, addrobj=self.addrobj)

    @property
    def socrbase(self) -> DataFrame:
        return self._staged("socrbase", SOCRBASE)

    @property
    def paths(self) -> DataFrame:
        return self._keep("paths", lambda: stage(build_paths(self.addrobj), "paths"))

    @property
    def texts(self) -> DataFrame:
        """All texts whose words the dictionary counts."""
        paths = self.paths
        return (
            paths.select(F.col("fullname").alias("text"))
            .unionByName(paths.select(F.col("sname").alias("text")))
            .unionByName(self.table("documents").select("text"))
        )

    @property
    def dictionary(self) -> DataFrame:
        return self._keep("dictionary", lambda: stage(build_dictionary(self.texts), "dictionary"))

    @property
    def lexicon(self) -> Lexicon:
        return self._keep("lexicon", lambda: build_lexicon(self.dictionary, self.socrbase))

    @property
    def index(self) -> SearchIndex:
        return self._keep("index", lambda: build_index(self.paths))

    @property
    def settings(self) -> SearchSettings:
        def build() -> SearchSettings:
            return replace(DEFAULTS, freq_threshold=self.sql(FREQ_THRESHOLD).first()["n"])

        return self._keep("settings", build)

    @property
    def id_requests(self) -> DataFrame:
        return self._staged("id-requests", ID_REQUESTS, addrobj=self.addrobj)

    @property
    def version_requests(self) -> DataFrame:
        return self._staged("version-requests", VERSION_REQUESTS, addrobj=self.addrobj)

    @property
    def deletes(self) -> DataFrame:
        return self.sql(DELETES)

    @property
    def word_requests(self) -> DataFrame:
        return self._staged(
            "word-requests", WORD_REQUESTS, dictionary=self.dictionary, socrbase=self.socrbase
        ).withColumn("bare", F.col("word"))

    @property
    def find_requests(self) -> DataFrame:
        return self._staged("find-requests", FIND_REQUESTS, paths=self.paths)

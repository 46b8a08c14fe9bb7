import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("waymark-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


# (id, aoid, aoguid, shortname, formalname, aolevel, parentguid, act, live, nextid, region)
ROWS = [
    (1, "r1", "R1", "обл", "Псковская", 1, None, True, True, None, 60),
    (2, "a1", "A1", "р-н", "Порховский", 3, "R1", True, True, None, 60),
    (3, "d1", "D1", "д", "Гречушанка", 6, "A1", True, True, None, 60),
    # An old version, which points to its successor, and the current one.
    (4, "d2v1", "D2", "д", "Старая", 6, "A1", False, False, "d2v2", 60),
    (5, "d2v2", "D2", "д", "Новая", 6, "A1", True, True, None, 60),
    # Below an object that is not there.
    (6, "x1", "X1", "ул", "Потерянная", 7, "GONE", True, True, None, 60),
    # Two current parents of one identifier: same name, and different names.
    (7, "t1a", "T1", "г", "Близнецы", 4, "R1", True, True, None, 60),
    (8, "t1b", "T1", "г", "Близнецы", 4, "R1", True, True, None, 60),
    (9, "s1", "S1", "ул", "Ёлочная", 7, "T1", True, True, None, 60),
    (10, "t2a", "T2", "г", "Первый", 4, "R1", True, True, None, 60),
    (11, "t2b", "T2", "г", "Второй", 4, "R1", True, True, None, 60),
    (12, "s2", "S2", "ул", "Санкт-Петербургская", 7, "T2", True, True, None, 60),
    # Without a name, and an abbreviation that is not in the dictionary.
    (13, "n1", "N1", "ул", None, 7, "T1", True, True, None, 60),
    (14, "k1", "K1", "снт", "Ромашка", 6, "A1", True, True, None, 60),
    (15, "b1", "B1", "ул", "С\\Косой", 7, "D1", True, True, None, 60),
]
SOCR = [
    (1, 1, "обл", "Область", "101"),
    (2, 3, "р-н", "Район", "301"),
    (3, 4, "г", "Город", "401"),
    (4, 6, "д", "Деревня", "601"),
    (5, 7, "ул", "Улица", "701"),
]


@pytest.fixture(scope="session")
def addrobj(spark):
    from waymark.schemas import ADDROBJ

    return spark.createDataFrame(ROWS, ADDROBJ.schema)


@pytest.fixture(scope="session")
def socrbase(spark):
    return spark.createDataFrame(
        SOCR, "id bigint, level smallint, scname string, socrname string, kod_t_st string"
    )

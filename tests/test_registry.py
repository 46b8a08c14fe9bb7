import pytest
from pyspark.sql import functions as F

from waymark.operators.chains import collect_chains, expand, full_text
from waymark.operators.ids import normalize, to_guid
from waymark.operators.paths import build_paths
from waymark.plans.skew import skew_join, work_join
from waymark.plans.stage import stage
from waymark.schemas import ADDROBJ, SOCRBASE
from waymark.settings import SearchSettings
from waymark.sources.checks import unique_violations, width_report
from waymark.sources.detect import detect_source
from waymark.sources.readers import read_dictionary_text
from waymark.sources.registry import apply_deletes, export_tsv, load_registry


def requests(spark, *ids):
    return spark.createDataFrame(list(enumerate(ids)), "request_id bigint, uuid string")


def test_normalize_and_to_guid(spark, addrobj):
    asked = requests(spark, "d2v1", "D2", "d2v2", "nothing")
    rows = {r["request_id"]: (r["aoid"], r["status"]) for r in normalize(asked, addrobj).collect()}
    # A version names itself even if it is old; an object names its current version.
    assert rows == {
        0: ("d2v1", "ok"), 1: ("d2v2", "ok"), 2: ("d2v2", "ok"), 3: (None, "not_found")
    }
    guids = {r["request_id"]: r["aoguid"] for r in to_guid(asked, addrobj).collect()}
    assert guids == {0: "D2", 1: "D2", 2: "D2", 3: None}


def test_expand(spark, addrobj, socrbase):
    rows = collect_chains(expand(requests(spark, "D1", "x1", "k1", "s2", "no"), addrobj, socrbase))
    chains = {r["request_id"]: r for r in rows.collect()}
    names = {k: [e["formalname"] for e in r["chain"]] for k, r in chains.items()}
    assert names[0] == ["Псковская", "Порховский", "Гречушанка"]
    assert names[1] == ["Потерянная"]  # as far as the chain goes
    assert [e["socrname"] for e in chains[2]["chain"]] == ["Область", "Район", None]
    assert sorted(names[3]) == sorted(
        ["Псковская", "Псковская", "Первый", "Второй", "Санкт-Петербургская"]
    )
    assert chains[4]["status"] == "not_found" and names[4] == []


def test_full_text(spark, addrobj):
    rows = full_text(requests(spark, "d1", "x1", "n1", "s2", "d2v1", "D1", "r1"), addrobj)
    texts = {r["request_id"]: (r["fullname"], r["status"]) for r in rows.collect()}
    assert texts[0] == ("обл Псковская, р-н Порховский, д Гречушанка", "ok")
    assert texts[1] == (None, "not_found")
    assert texts[2] == (None, "invalid")
    assert texts[3] == ("обл Псковская, г Второй, ул Санкт-Петербургская", "ok")
    assert texts[4] == ("обл Псковская, р-н Порховский, д Старая", "ok")
    assert texts[5] == (None, "not_found")  # objects are not looked up here
    assert texts[6] == ("обл Псковская", "ok")


@pytest.mark.parametrize("rows_per_task", [1, 1_000_000])
def test_paths(addrobj, rows_per_task):
    paths = build_paths(addrobj, SearchSettings(rows_per_task=rows_per_task))
    found = sorted((r["aoid"], r["fullname"], r["sname"], r["wordcount"]) for r in paths.collect()
                   if r["fullname"])
    assert ("d1", "обл Псковская, р-н Порховский, д Гречушанка", "обл р-н д", 5) in found
    by_aoid = [r[0] for r in found]
    assert by_aoid.count("s1") == 1  # parents of one text give one path
    assert by_aoid.count("s2") == 2  # of different texts, two
    assert not {"r1", "a1", "x1", "d2v1"} & set(by_aoid)
    assert paths.where("fullname IS NULL").count() == 1


def test_cycles_are_reported(spark, addrobj):
    """Whether their length is a power of two or not, and whoever leads into them."""
    for length in (1, 3, 4):
        ring = [(100 + i, f"z{i}", f"Z{i}", "л", f"и{i}", 6, f"Z{(i + 1) % length}", True, True, None, 1)
                for i in range(length)]
        below = (200, "y", "Y", "л", "под", 7, "Z0", True, True, None, 1)
        rows = addrobj.unionByName(spark.createDataFrame([*ring, below], addrobj.schema))
        for run in (lambda: full_text(requests(spark, "y"), rows), lambda: build_paths(rows)):
            with pytest.raises(ValueError, match="cycle.*Z0"):
                run().collect()


def test_a_thousand_levels(spark, socrbase, monkeypatch):
    from waymark.plans import doubling

    deep = 1000
    rows = [(i, f"d{i}", f"D{i}", "л", str(i), 1 if i == 0 else 5, f"D{i - 1}" if i else None, True,
             True, None, 1) for i in range(deep)]
    df = spark.createDataFrame(rows, ADDROBJ.schema)
    tables = []
    monkeypatch.setattr(doubling, "stage", lambda df, name: tables.append(name) or stage(df, name))
    text = full_text(requests(spark, f"d{deep - 1}", "d3"), df).orderBy("request_id").collect()
    assert text[0].fullname == ", ".join(f"л {i}" for i in range(deep))
    assert text[1].fullname == "л 0, л 1, л 2, л 3"
    assert sum("found" in t for t in tables) - 1 <= 12
    chain = collect_chains(expand(requests(spark, f"d{deep - 1}"), df, socrbase)).first()
    assert len(chain["chain"]) == deep
    paths = {r.id: r.fullname for r in build_paths(df).where("id in (1, 700)").collect()}
    assert paths == {1: "л 0, л 1", 700: ", ".join(f"л {i}" for i in range(701))}


def test_skew_join_is_an_ordinary_join(spark):
    many = spark.range(600).select(
        "id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 5 == 0, None)
        .otherwise(F.col("id")).alias("k"))
    one = spark.range(400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        salted = skew_join(many, one, ["k"], ["id"], how, rows_per_task=10)
        plain = many.join(one, "k", how)
        assert sorted(map(tuple, salted.collect()), key=repr) == sorted(
            map(tuple, plain.collect()), key=repr)


def test_work_join_is_an_ordinary_join(spark):
    table = spark.range(300).select((F.col("id") % 4).alias("k"), F.col("id").alias("t"))
    df = table.groupBy("k").agg(F.count("t").alias("df"))
    asking = spark.range(200).select((F.col("id") % 7).alias("k"), F.col("id").alias("a"))
    asking = stage(asking.join(df, "k"), "asking", F.sum("df"))
    joined = work_join(asking, table, ["k"], "df", ["a"], ["t"], rows_per_task=50)
    plain = asking.drop("df").join(table, "k")
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, plain.collect()))


def test_tsv_round_trip_and_deletes(spark, addrobj, socrbase, tmp_path):
    odd = [(20, "o1", None, "", "NULL", None, None, None, None, None, None),
           (21, "o2", "O2", "a\\tb", "tab\there\nline\\", 7, "D1", False, True, None, 1)]
    rows = addrobj.unionByName(spark.createDataFrame(odd, addrobj.schema))
    folder = str(tmp_path / "tsv")
    export_tsv(rows, folder, ADDROBJ, settings=SearchSettings(rows_per_file=4))
    export_tsv(socrbase, folder, SOCRBASE)
    gone = spark.createDataFrame(
        [(1, "d1") + (None,) * 9, (2, "unknown") + (None,) * 9], addrobj.schema)
    export_tsv(gone, folder, ADDROBJ, "DELETE")
    loaded = load_registry(spark, folder)
    columns = [c for c in ADDROBJ.columns if c not in ADDROBJ.ids]
    # Identifiers are made canonical, and d1 is deleted.
    expected = rows.where("aoid <> 'd1'").select(F.lower("aoid").alias("aoid"), *columns)
    got = loaded["addrobj"].select("aoid", *columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        map(tuple, expected.collect()), key=repr)
    assert loaded["addrobj"].select("id").distinct().count() == expected.count()
    assert loaded["socrbase"].count() == 5
    files = list((tmp_path / "tsv").glob("fd_CREATE_ADDROBJ.part*.csv"))
    assert len(files) == 5 and all(f.is_file() for f in files)


def test_xml_source(spark, tmp_path):
    (tmp_path / "AS_ADDROBJ_20210901_ab-1.XML").write_text(
        '<?xml version="1.0" encoding="utf-8"?><AddressObjects>'
        '<Object AOID="AA" AOGUID="GG" SHORTNAME="ул" FORMALNAME="Мира" AOLEVEL="7" '
        'ACTSTATUS="1" LIVESTATUS="0" REGIONCODE="60" OTHER="x" />'
        '<Object AOID="BB" AOLEVEL="1" ACTSTATUS="1" LIVESTATUS="1"/></AddressObjects>',
        encoding="utf-8")
    (tmp_path / "DEL_ADDROBJ_20210901_ab-2.XML").write_text(
        '<AddressObjects><Object AOID="BB"/></AddressObjects>')
    (tmp_path / "AS_SOCRBASE_20210901_ab-3.XML").write_text(
        '<Rows><AddressObjectType LEVEL="7" SOCRNAME="Улица" SCNAME="ул" KOD_T_ST="701"/></Rows>',
        encoding="utf-8")
    (tmp_path / "AS_HOUSE_20210901_ab-4.XML").write_text("<Rows/>")
    assert detect_source(spark, str(tmp_path)).kind == "xml"
    loaded = load_registry(spark, str(tmp_path))
    rows = [tuple(r)[1:] for r in loaded["addrobj"].collect()]
    assert rows == [("aa", "gg", "ул", "Мира", 7, None, True, False, None, 60)]


def test_incomplete_and_double_sources(spark, addrobj, socrbase, tmp_path):
    folder = str(tmp_path / "one")
    export_tsv(addrobj, folder, ADDROBJ)
    with pytest.raises(ValueError, match="no complete"):
        detect_source(spark, folder)
    export_tsv(socrbase, folder, SOCRBASE)
    for name in ("ADDROBJ", "SOCRBASE"):
        (tmp_path / "one" / f"AS_{name}_20210901_a.XML").write_text("<Rows/>")
    with pytest.raises(ValueError, match="several"):
        detect_source(spark, folder)


def test_checks(spark, addrobj):
    repeated = unique_violations(addrobj, ["aoguid"]).collect()
    assert {r["aoguid"]: r["n"] for r in repeated} == {"D2": 2, "T1": 2, "T2": 2}
    report = {r["name"]: r for r in width_report(addrobj, ADDROBJ).collect()}
    assert report["formalname"]["nulls"] == 1 and report["shortname"]["longest"] == 3
    null_key = spark.createDataFrame([(None,), ("r1",)], "aoid string")
    assert apply_deletes(addrobj, null_key, "aoid").count() == addrobj.count() - 1


def test_dictionary_text(spark, tmp_path):
    good = tmp_path / "good.txt"
    good.write_text("ab 12\nмир 3\n", encoding="utf-8")
    rows = [tuple(r) for r in read_dictionary_text(spark, str(good)).collect()]
    assert ("ab", "__a _ab ab_ b__", 12) in rows
    bad = tmp_path / "bad.txt"
    bad.write_text("ab 12\nalone\n")
    with pytest.raises(Exception, match="not a word"):
        read_dictionary_text(spark, str(bad)).collect()
    assert read_dictionary_text(spark, str(bad), "skip").count() == 1

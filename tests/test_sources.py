"""Reading, setting aside, committing and exporting, against plain Python."""

import random
import re
from html.entities import name2codepoint
from xml.sax.saxutils import quoteattr

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions.markup import INLINE, strip_markup
from waymark.operators.dictionary import most_frequent
from waymark.plans.order import numbered
from waymark.schemas import ADDROBJ, AOTRIG, SOCRBASE
from waymark.settings import SearchSettings
from waymark.sources.quarantine import sort_rows
from waymark.sources.readers import escape, read_dictionary_text, read_tsv, read_xml, unescape
from waymark.sources.registry import export_tsv, export_xml, load_registry, replace_dictionary
from waymark.sources.versions import append_table, open_table, save_table, versions


def xml_of(rows, rng):
    """Elements with attributes in any order and quotes, and other elements between."""
    out = ['<?xml version="1.0" encoding="utf-8"?>\n<Objects>']
    for row in rows:
        items = [(k, v) for k, v in row.items() if v is not None] + [("OTHER", "x > y / 'z'")]
        rng.shuffle(items)
        text = rng.choice([" ", "\n  "]).join(f"{k}={quoteattr(v)}" for k, v in items)
        out.append(f"<Object {text}{rng.choice(['/>', ' />', '></Object>', '>inner text</Object>'])}")
        out.append(rng.choice(["", "\n", "<ObjectList A='1'/>", "<!-- a note -->"]))
    return "".join(out) + "</Objects>"


def test_xml_in_splits(spark, tmp_path):
    rng = random.Random(1)
    signs = ["a", "Я", " ", ">", "<", "&", '"', "'", "/", "=", "🙂", "x", "/>"]
    rows = [
        {"AOID": f"id{i}", "FORMALNAME": "".join(rng.choice(signs) for _ in range(rng.randint(0, 30))),
         "SHORTNAME": rng.choice(["ул", None]), "AOLEVEL": str(i % 9)}
        for i in range(3000)
    ]
    file = tmp_path / "AS_ADDROBJ_20210901_a.XML"
    file.write_text(xml_of(rows, rng), encoding="utf-8")
    name = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(name, "20000")
    try:
        df = read_xml(spark, str(file), ADDROBJ)
        assert df.rdd.getNumPartitions() > 5
        found = df.collect()
    finally:
        spark.conf.unset(name)
    got = sorted((r.AOID, r.FORMALNAME, r.SHORTNAME, r.AOLEVEL, r.NEXTID) for r in found)
    assert got == sorted((r["AOID"], r["FORMALNAME"], r["SHORTNAME"], r["AOLEVEL"], None) for r in rows)


@pytest.mark.parametrize("bad", [
    '<A><Object AOID="1"/><!-- <Object AOID="2"/> --></A>', '<A><Object AOID="1</A>',
    "<A><Object AOID=1/></A>", '<A><Object AOID="1" AOID="&nothing;"/></A>',
    '<A><Object AOID="1"',
])
def test_broken_xml_fails(spark, tmp_path, bad):
    (tmp_path / "x.XML").write_text(bad)
    with pytest.raises(Exception, match="(?i)whole element|malformed"):
        read_xml(spark, str(tmp_path / "x.XML"), ADDROBJ).collect()


def decode_field(raw):
    """Left to right, byte by byte."""
    letters = {"b": 8, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11}
    out, i = bytearray(), 0
    while i < len(raw):
        if raw[i] != "\\":
            out += raw[i].encode()
            i += 1
            continue
        rest = raw[i + 1 :]
        if m := re.match("x[0-9A-Fa-f]{1,2}", rest):
            out.append(int(m[0][1:], 16))
        elif m := re.match("[0-7]{1,3}", rest):
            out.append(int(m[0], 8) & 255)
        elif rest:
            m = re.match("(?s).", rest)
            out += bytes([letters[m[0]]]) if m[0] in letters else m[0].encode()
        else:
            break
        i += 1 + len(m[0])
    return bytes(out)


def test_escapes(spark, tmp_path):
    rng = random.Random(2)
    pieces = ["\\", "\\\\", "x", "4", "7", "1", "n", "b", "é", "\\x41", "\\101", "\\xD0\\x9f", "v", "N", "g", "\\\t"]
    raws = []
    while len(raws) < 800:
        raw = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        try:
            decode_field(raw).decode()
        except UnicodeDecodeError:
            continue
        raws.append(raw)
    df = spark.createDataFrame([(r,) for r in raws], "raw string")
    for r in df.select("raw", unescape(F.col("raw")).alias("text")).collect():
        assert r.text == decode_field(r.raw).decode(), r.raw
    texts = ["".join(rng.choice(["\\", "\t", "\n", "\r", "NULL", "é", "x4", "7"]) for _ in range(6)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in [*texts, "", "NULL"]], "t string")
    assert df.where(unescape(escape(F.col("t"))) != F.col("t")).count() == 0
    # Fields are cut at tabs that no backslash stands before.
    good = [
        f"w{i}\t{raw}g\\\tx\t{i}" for i, raw in enumerate(raws)
        if not re.search(r"[\t\\]", re.sub(r"(?s)\\.", "", raw))
    ]
    assert len(good) > 300
    (tmp_path / "a.csv").write_text("\n".join(good) + "\n", encoding="utf-8")
    for r in read_tsv(spark, str(tmp_path / "a.csv"), AOTRIG).collect():
        i = int(r.WORD[1:])
        assert r.TRIGRAMM == decode_field(raws[i] + "g\\\tx").decode() and r.FREQUENCY == str(i)


def test_numbered_and_most_frequent(spark):
    rng = random.Random(3)
    rows = [(f"w{i}", rng.choice([1, 1, 1, 2, 3, 50])) for i in range(5000)]
    df = spark.createDataFrame(rows, "word string, frequency long").repartition(16)
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    places = numbered(df, [F.desc("frequency"), F.asc("word")]).collect()
    assert [(r.word, r.frequency) for r in sorted(places, key=lambda r: r.n)] == want
    assert sorted(r.n for r in places) == list(range(5000))
    for size in (0, 1, 2500, 4999, 5000, 9000):
        got = {tuple(r) for r in most_frequent(df, size).collect()}
        assert got == set(want[:size])
    assert numbered(df.limit(0), ["word"]).collect() == []


def test_numbered_parts(spark, addrobj, socrbase, tmp_path):
    many = addrobj.unionByName(
        spark.range(100, 1100).select(
            "id", F.concat(F.lit("m"), "id").alias("aoid"),
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in addrobj.schema[2:]])
    ).repartition(7)
    folder = str(tmp_path / "out")
    settings = SearchSettings(rows_per_file=64)
    n = export_tsv(many, folder, ADDROBJ, settings=settings)
    assert export_tsv(socrbase.limit(0), folder, SOCRBASE, settings=settings) == 1
    files = [tmp_path / "out" / f"fd_CREATE_ADDROBJ.part{i}.csv" for i in range(n)]
    lines = [f.read_text(encoding="utf-8").splitlines() for f in files]
    assert n == 16 and [len(x) for x in lines] == [64] * 15 + [55]
    ids = [x.split("\t")[0] for part in lines for x in part]
    assert ids == [r.aoid for r in many.orderBy("id").collect()]
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("_")) == []
    loaded = load_registry(spark, folder)
    assert loaded["addrobj"].count() == 1015 and loaded["socrbase"].count() == 0


def test_quarantine(spark, tmp_path):
    good = ("AA", "GG", "ул", "Мира", "7", None, "1", "0", None, "60")
    rows = [
        good, ("BB", *good[1:4], "seven", *good[5:]), (None, *good[1:]), ("CC", "G", "x" * 11, *good[3:9], "99999"),
        ("dd", *good[1:]), ("DD", *good[1:]), (" Dd ", *good[1:4], "x", *good[5:]),
    ]
    raw = spark.createDataFrame(rows, ADDROBJ.text_schema)
    parted = sort_rows(raw, ADDROBJ)
    assert [tuple(r) for r in parted.good.collect()] == [
        ("aa", "gg", "ул", "Мира", 7, None, True, False, None, 60)]
    reasons = sorted((r.AOID or "", sorted(r.reasons)) for r in parted.refused.collect())
    assert reasons == [
        ("", ["aoid: missing"]), (" Dd ", ["aolevel: not smallint"]), ("BB", ["aolevel: not smallint"]),
        ("CC", ["regioncode: not smallint", "shortname: too long"]),
        ("DD", ["aoid: repeated"]), ("dd", ["aoid: repeated"])]
    assert parted.counts == {
        "good": 1, "aoid: missing": 1, "aolevel: not smallint": 2, "regioncode: not smallint": 1,
        "shortname: too long": 1, "aoid: repeated": 2}
    uuids = sort_rows(raw, ADDROBJ, uuids=True)
    assert "good" not in uuids.counts and uuids.counts["aoguid: no uuid"] == 7
    empty = sort_rows(raw.limit(0), ADDROBJ)
    assert empty.good.count() == empty.refused.count() == 0
    # A folder is loaded without the rows that would fail it.
    for name in ("ADDROBJ", "SOCRBASE"):
        tag, body = ("Object", "".join(f'<Object AOID="{a}" AOLEVEL="{v}"/>' for a, v in
                     [("a", "1"), ("b", "x"), ("c", "2"), ("c", "3")])) if name == "ADDROBJ" else ("", "")
        (tmp_path / f"AS_{name}_20210901_a.XML").write_text(f"<Rows>{body}</Rows>")
    refused = {}
    loaded = load_registry(spark, str(tmp_path), refused=refused)
    assert [r.aoid for r in loaded["addrobj"].collect()] == ["a"]
    assert sorted(r.AOID for r in refused["addrobj"].collect()) == ["b", "c", "c"]


def test_commits(spark, tmp_path):
    path = str(tmp_path / "table")
    numbers = lambda df: sorted(r.id for r in df.collect())
    first = save_table(spark.range(5), path)
    more = append_table(spark.range(5, 8), path)
    assert numbers(first) == list(range(5)) and numbers(more) == list(range(8))
    # A table may be made anew from itself, and what was opened before stays.
    third = save_table(open_table(spark, path).where("id % 2 = 0"), path)
    assert numbers(third) == [0, 2, 4, 6] and numbers(more) == list(range(8))
    assert versions(spark, path) == [1, 2, 3] and numbers(open_table(spark, path, 2)) == list(range(8))
    # A write that fails changes nothing, and neither does one that another overtakes.
    bad = spark.range(3).select(F.raise_error(F.lit("broken")).cast("bigint").alias("id"))
    for write in (save_table, append_table):
        with pytest.raises(Exception, match="broken"):
            write(bad, path)
    with pytest.raises(ValueError, match="has columns"):
        append_table(spark.range(3).select(F.col("id").cast("string")), path)
    assert numbers(open_table(spark, path)) == [0, 2, 4, 6] and versions(spark, path) == [1, 2, 3]
    (tmp_path / "table" / "_commits" / "000000000004.json").write_text('{"folders": [')
    assert numbers(open_table(spark, path)) == [0, 2, 4, 6]
    with pytest.raises(ValueError, match="no version"):
        open_table(spark, str(tmp_path / "nothing"))


def test_dictionary_is_replaced_or_left(spark, tmp_path):
    path, file = str(tmp_path / "words"), tmp_path / "f.txt"
    file.write_text("мир 3000000000\nab 2\n", encoding="utf-8")
    stored = replace_dictionary(spark, str(file), path)
    assert {tuple(r) for r in stored.collect()} == {
        ("ab", "__a _ab ab_ b__", 2), ("мир", "__м _ми мир ир_ р__", 3_000_000_000)}
    for bad, why in (("ab 1\nab 2\n", "not unique"), ("x\n", "not a word"), (f"{'w' * 51} 1\n", "too long")):
        file.write_text(bad)
        with pytest.raises(Exception, match=why):
            replace_dictionary(spark, str(file), path)
    assert open_table(spark, path).count() == 2
    assert read_dictionary_text(spark, str(file)).schema["frequency"].dataType.simpleString() == "bigint"


def strip(text):
    """Character by character."""
    out, i = [], 0
    while i < len(text):
        rest = text[i:]
        if rest.startswith("<!--"):
            end = text.find("-->", i + 4)
            i = len(text) if end < 0 else end + 3
            out.append(" ")
        elif re.match("<[!?]", rest):
            end = text.find(">", i + 2)
            i = len(text) if end < 0 else end + 1
            out.append(" ")
        elif m := re.match("</?([A-Za-z][A-Za-z0-9]*)", rest):
            at, quote = i + rest.index(m[1][0]) + 1, None
            while at < len(text) and (quote or text[at] != ">"):
                if quote and text[at] == quote:
                    quote = None
                elif not quote and text[at] in "\"'":
                    quote = text[at]
                at += 1
            if quote:  # a quote without its end is no quote
                end = text.find(">", i + 2)
                at = len(text) if end < 0 else end
            out.append("" if m[1].lower() in INLINE else " ")
            i = at + 1
        elif m := re.match("&(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,7});", rest):
            code = name2codepoint.get(m[1])
            if m[1][0] == "#":
                code = int(m[1][2:], 16) if m[1][1] in "xX" else int(m[1][1:])
            real = code and code < 0x110000 and not 0xD800 <= code < 0xE000
            out.append(chr(code) if real else m[0])
            i += len(m[0])
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def test_markup(spark):
    rng = random.Random(5)
    bits = ["<", ">", "<b>", "</p>", "<!--", "-->", "-", "&amp;", "&#233;", "&#xe9", ";", "&lt;", "&zzz;", '"', "'",
            "<a href=", "x", " ", "é", "&#55296;", "<?", "<!DOCTYPE", "<H1 a='1>'", "&#9999999;", "/", "&", "<br/>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    texts += [None, "", "plain", "<p " + "a='b' " * 50_000 + ">x", "<" * 1000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", strip_markup(F.col("t")).alias("s")).collect():
        assert r.s == (None if r.t is None else strip(r.t)), r.t


def test_one_xml_file_holds_what_the_writer_of_spark_writes(spark, tmp_path):
    odd = [
        ("a\"1", "A&1", "st", "<b> 'x' > \t\n\r y ", 7, None, True, False, "é\u00a0\U0001f600", 5),
        ("a2", "A2", " st", "", None, "A1", None, None, None, None),
        ("a3", None, None, None, 6, None, False, True, None, 1),
    ]
    df = spark.createDataFrame(odd * 50, T.StructType([T.StructField(c, k) for c, k in ADDROBJ.columns.items()]))
    path = tmp_path / "one" / "AS_ADDROBJ_20210901_a1.XML"
    export_xml(df.repartition(7), f"file://{path}", ADDROBJ)
    assert [p.name for p in path.parent.iterdir() if not p.name.startswith(".")] == [path.name]
    columns = [F.col(c).cast("int" if k.typeName() == "boolean" else "string").cast("string").alias(f"_{c.upper()}") for c, k in ADDROBJ.columns.items()]
    writer = df.coalesce(1).select(columns).write.format("xml").option("attributePrefix", "_")
    writer.option("rowTag", ADDROBJ.row_tag).option("rootTag", "Rows").save(str(tmp_path / "spark"))
    (old,) = (tmp_path / "spark").glob("part-*")
    lines = lambda p: [x.strip() for x in p.read_text("utf-8").splitlines()]
    assert sorted(lines(path)) == sorted(lines(old))
    assert lines(path)[:2] == lines(old)[:2] and lines(path)[-1] == lines(old)[-1] == "</Rows>"
    assert read_xml(spark, str(path), ADDROBJ).count() == 150


def test_one_xml_file_of_no_rows(spark, tmp_path):
    path = tmp_path / "AS_ADDROBJ_20210901_a1.XML"
    export_xml(spark.createDataFrame([], ADDROBJ.schema), str(path), ADDROBJ)
    assert path.read_text().endswith("<Rows>\n</Rows>")
    assert read_xml(spark, str(path), ADDROBJ).isEmpty()

import io
import json
import zipfile
from datetime import datetime
from xml.dom import minidom

import pytest
from pyspark.sql import functions as F

from recordloom.operators.matcher import field_column
from recordloom.operators.rules import Invalid
from recordloom.service import FileStore, Service, new_id, normalize_id
from recordloom.sources import archive as A
from recordloom.sources import parsing as P
from recordloom.sources import sinks as K


def test_pairs_in_any_shape():
    assert P.parse_pairs("id_a,id_b,score\n1,2,0.5\n3,4,0.7") == ([("1", "2", 0.5), ("3", "4", 0.7)], True, False, True)
    assert P.parse_pairs("A,B\nC,D") == ([("A", "B", None), ("C", "D", None)], False, False, False)
    assert P.parse_pairs("1\t2\t0.5\n3\t4\t0.7")[0] == [("1", "2", 0.5), ("3", "4", 0.7)]
    assert P.parse_pairs('[["A","B"],{"a":"C","b":"D","score":0.7}]')[1:3] == (False, True)
    assert P.parse_pairs('{"pairs":[["A","B",0.5]]}')[:2] == ([("A", "B", 0.5)], True)
    assert P.parse_pairs("a,b\nX,Y", True)[0] == [("X", "Y", None)] and P.parse_pairs("  ")[0] == []
    assert P.normalize_pairs([{"left": 1.0, "right": 2, "prob": "0.5"}])[0] == [("1", "2", 0.5)]
    for bad in ([["a"]], [{"q": 1}], [["a", ""]], [["a", "b", "x"]], "no", [3]):
        with pytest.raises(Invalid):
            P.normalize_pairs(bad)


def test_csv_labels_records_paths():
    assert P.parse_csv('a,"b,""q""",c\r\n1,2,3\n\n') == [["a", 'b,"q"', "c"], ["1", "2", "3"]]
    assert P.delimiter_of("a;b;c,d") == ";" and P.delimiter_of("plain") == ","
    assert P.looks_like_header(["id", "x"]) and not P.looks_like_header(["id", "3"]) and not P.looks_like_header(["a", "b"])
    assert P.parse_labels("id,block\n1,x\n2,y") == {"1": "x", "2": "y"} and P.parse_labels('[{"id":1,"match_id":"m"},["2","n"]]') == {"1": "m", "2": "n"}
    assert P.parse_labels('{"1":"a"}') == {"1": "a"}
    records, columns = P.parse_records('id,name,match_id\n1,"A, B",M\n2,C\n3,D,M')
    assert columns == ["id", "name", "match_id"] and records[0]["name"] == "A, B" and records[1]["match_id"] == ""
    assert P.parse_records('{"x":[{"a":1},{"b":2}]}')[1] == ["a", "b"]
    assert P.get_path({"order": {"id": "X"}}, "order.@id") == "X" and P.get_path({"a": {"b": {"_value": "v", "c": 1}}}, "a.b") == "v" and P.get_path({"a.b": 1}, "a.b") == 1


def test_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text('id1;id2;similarity\n"1";2;0.5\n3;"4;5";0.9\n')
    df, has = P.read_delimited(spark, str(tmp_path / "p.csv"))
    assert has and sorted(map(tuple, P.pairs_of(df).collect())) == [("1", "2", 0.5), ("3", "4;5", 0.9)]
    (tmp_path / "q.csv").write_text("A|B\nC|D\n")
    assert sorted(map(tuple, P.pairs_of(P.read_delimited(spark, str(tmp_path / "q.csv"))[0]).collect())) == [("A", "B"), ("C", "D")]
    (tmp_path / "r.json").write_text('[{"id": 1, "o": {"x": "y", "v": {"_value": 7, "w": 1}}}]')
    r = P.read_records(spark, str(tmp_path / "r.json"))
    assert r.select(field_column(r, "o.@x"), field_column(r, "o.v")).first()[:] == ("y", 7)
    (tmp_path / "l.csv").write_text("id,block\n1,x\n2,y\n")
    assert sorted(map(tuple, P.labels_of(P.read_records(spark, str(tmp_path / "l.csv"))).collect())) == [("1", "x"), ("2", "y")]


def test_record_files_in_json(spark, tmp_path):
    def read(name, text):
        (tmp_path / name).write_text(text)
        return P.read_records(spark, str(tmp_path / name))

    lines = read("lines.json", '{"id": 1, "v": "a"}\n\n{"id": 2, "v": "b"}\n{"id": 3}\n')
    assert sorted((r.id, r.v) for r in lines.collect()) == [(1, "a"), (2, "b"), (3, None)]
    wrapped = read("wrapped.json", '{\n "total": 2,\n "zebra": [{"id": 1, "n": {"x": 5}}, {"id": 2}],\n "also": [{"id": 9}]}')
    assert sorted((r.id, r.n and r.n.x) for r in wrapped.collect()) == [(1, 5), (2, None)]
    assert sorted(r.id for r in read("one.json", '{"records": [{"id": 7}, {"id": 8}]}').collect()) == [7, 8]
    assert sorted(r.id for r in read("list.json", '[{"id": 7},\n {"id": 8}]').collect()) == [7, 8]
    with pytest.raises(Invalid):
        read("none.json", '{"a": 1,\n "b": {"c": 2}}')


@pytest.mark.parametrize("row", [("1", "2", "high"), ("1", "2", "NaN"), ("", "2", "0.5"), (None, "2", "0.5"), ("1", " ", None)])
def test_bad_pairs_are_refused_with_their_values(spark, row):
    df = spark.createDataFrame([("7", "8", "0.9"), row], "left string, right string, sim string")
    with pytest.raises(Exception, match="in the pair|is not a number in"):
        P.pairs_of(df).collect()
    assert P.pairs_of(df, strict=False).count() == 2
    assert [tuple(r) for r in P.pairs_of(spark.createDataFrame([("7", "8", "0.9")], df.schema)).collect()] == [("7", "8", 0.9)]
    assert P.pairs_of(spark.createDataFrame([("1", "2", "")], "a string, b string, score string")).first().score is None


def flat(spark):
    rows = [(1, "A & <B>", ["x", "y"], ["1", "2"], 2.0, 'q"u', "n"), (2, None, [], [], 1.5, "a,b\nc", "m")]
    return spark.createDataFrame(rows, "`@id` long, `o.name` string, `o.items[0-2].@k` array<string>, `o.items[0-2].v` array<string>, amount double, `note` string, `o` string")


def test_json_xml_csv(spark):
    df = flat(spark)
    got = [json.loads(r[0]) for r in df.select(K.json_line(df)).collect()]
    assert got[0] == {"id": 1, "o": {"name": "A & <B>", "items": [{"k": "x", "v": "1"}, {"k": "y", "v": "2"}], "_value": "n"}, "amount": 2.0, "note": 'q"u'}
    assert got[1]["o"]["name"] is None and got[1]["o"]["items"] == []
    lines = [r[0] for r in df.select(K.csv_line(df)).collect()]
    assert lines[0] == '1,A & <B>,x|y,1|2,2,"q""u",n' and lines[1] == '2,,,,1.5,"a,b\nc",m'
    whole = K.serialized(df, "xml", "all", "one")
    doc = minidom.parseString(whole)
    first = doc.documentElement.getElementsByTagName("one")[0]
    assert first.getAttribute("id") == "1" and [e.getAttribute("k") for e in first.getElementsByTagName("items")] == ["x", "y"]
    assert first.getElementsByTagName("name")[0].firstChild.data == "A & <B>" and "<name></name>" in whole
    assert K.nested(df).select("o.items").first()[0][1].v == "2"


def test_writers(spark, tmp_path):
    df = flat(spark)
    for kind in ("csv", "json", "xml"):
        K.write_records(df, str(tmp_path / kind), kind)
        assert spark.read.text(str(tmp_path / kind)).count() >= 2
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv")).count() == 2


def test_fingerprint_tells_order_and_content(spark):
    base = spark.range(10000).select(F.col("id").alias("o"), F.col("id").cast("string").alias("l"))
    one = K.fingerprint(base, "o", "l").first()[0]
    assert len(one) == 32 and one == K.fingerprint(base.repartition(7), "o", "l").first()[0]
    assert one != K.fingerprint(base.withColumn("l", F.when(F.col("o") == 9, F.lit("x")).otherwise(F.col("l"))), "o", "l").first()[0]


def test_zip_and_names():
    data = A.zip_files([("/a/b.txt", "x" * 99), ("c\\d.txt", b"")], datetime(1970, 1, 1))
    z = zipfile.ZipFile(io.BytesIO(data))
    assert z.namelist() == ["a/b.txt", "c/d.txt"] and z.read("a/b.txt") == b"x" * 99 and z.testzip() is None
    assert data == A.zip_files([("a/b.txt", "x" * 99), ("c/d.txt", b"")])
    with pytest.raises(Invalid):
        A.zip_files([("a", "1"), ("/a", "2")])
    taken = set()
    assert [A.unique_name("r", "csv", taken) for _ in range(3)] == ["r.csv", "r-2.csv", "r-3.csv"]
    assert [A.column_letters(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    names = set()
    assert [A.sheet_name(n, names, i) for i, n in enumerate(["a/b", "A B", "", "x" * 40])] == ["a b", "A B (2)", "Sheet3", "x" * 31]
    assert A.sheet_name("X" * 40, names, 9) == "X" * 27 + " (2)"
    assert [A.clean_name(n) for n in ("../a", "a/../b..", "c\\..", "/x.y")] == ["_/a", "a/_/b_", "c/_", "x.y"]
    with pytest.raises(Invalid):
        A.clean_name("//")


def test_workbook(spark):
    df = spark.createDataFrame([("a<b\x01", 1, 0.5, True)], "name string, n long, precision double, ok boolean")
    z = zipfile.ZipFile(io.BytesIO(A.report({"Sum/mary": df, "Empty": df.limit(0)})))
    sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert "a&lt;b<" in sheet and 's="2"' in sheet and 'state="frozen"' in sheet
    for n in z.namelist():
        minidom.parseString(z.read(n))


DOC = {"entities": [{"name": "P", "dupLevel": "medium", "dupPct": 50, "rows": 30, "fields": [{"name": "id", "type": "UUID"}, {"name": "n", "type": "Full Name"}, {"name": "e", "type": "Email", "keep": True}]}]}


def test_service(spark, tmp_path):
    s = Service(spark, FileStore(str(tmp_path)))
    key = s.register(DOC)
    assert normalize_id(f" {key[:16].lower()}-{key[16:]}") == key and normalize_id("nope") is None and len(new_id()) == 32
    a, b = s.generate(key, 20, 5), Service(spark, FileStore(str(tmp_path))).generate(key, {"P": 20}, 5, "csv")
    assert a["fingerprint"] == b["fingerprint"] != s.generate(key, 20, 6)["fingerprint"]
    records = json.loads(a["data"]["P"])
    assert len(records) == len(b["data"]["P"].splitlines()) - 1 and set(records[0]) == {"match_id", "id", "n", "e"}
    by = {}
    for r in records:
        by.setdefault(r["match_id"], []).append(r["id"])
    pairs = [[v[0], x] for v in by.values() for x in v[1:]]
    for truth in ({"records": records, "idField": "id"}, {"schemaId": key, "seed": 5, "count": 20, "idField": "id"}, {"labels": {r["id"]: r["match_id"] for r in records}}):
        e = s.score(truth, pairs)["evaluation"].first()
        assert (e.precision, e.recall, e.records) == (1.0, 1.0, len(records))
    for bad in (lambda: s.generate("x"), lambda: s.generate(key, 20, 5, "pdf"), lambda: s.score({}, pairs), lambda: s.register({})):
        with pytest.raises(Invalid):
            bad()
    assert s.health()["ok"]


def test_header_detect_reads_every_page(spark, tmp_path):
    from recordloom.plans import reading

    urls = ["http://x.org/id/a", "id/score", "a/b", "id/3", None]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.header for r in reading.header_detect(spark, str(tmp_path)).collect()}
    assert got == {i: P.looks_like_header(u.split("/") if u else None) for i, u in enumerate(urls)} and got[1] and not got[2]


def test_seeds_and_row_limits(spark):
    from recordloom.service import Service, seed_of

    assert [seed_of(x) for x in (5, "7", " 12abc", "-3", 4.9)] == [5, 7, 12, -3, 4]
    assert all(0 <= seed_of(x) < 10**9 for x in (None, "", "abc"))
    service = Service(spark)
    key = service.register({"entities": [{"name": "E", "fields": [{"name": "n", "type": "Row Number"}]}]})
    with pytest.raises(Invalid):
        service.generate(key, 10_001, 1)
    assert service.generate(key, 3, "8x")["seed"] == 8

import re

import pytest
from pyspark.sql import functions as F

from recordloom.functions import rng as R
from recordloom.operators import duplicates as D
from recordloom.operators.formula import Scope, compile_formula
from recordloom.operators.generate import IX, Generator, dense_index
from recordloom.operators.rules import Invalid
from recordloom.operators.schema import Entity, Field, parse_name, read_schema, repeat_prefix, resolve_counts
from recordloom.operators.scoring import truth_of, truth_summary


def run(spark, doc, count=None, seed=42):
    entities = read_schema(doc)
    return Generator(spark, entities, resolve_counts(entities, count), seed).run()


def field(name, kind, **more):
    return {"name": name, "type": kind, **more}


def test_names():
    segs = parse_name("order.items[5-2].@id")
    assert [(s.key, s.attr, s.repeat) for s in segs] == [("order", False, None), ("items", False, (2, 5)), ("id", True, None)]
    assert repeat_prefix(segs) == ("order.items", (2, 5)) and repeat_prefix(parse_name("a.b")) is None


def test_fixed_draw_schema_replays_the_stream(spark):
    doc = [field("i", "Row Number"), field("f", "First Name"), field("b", "Boolean"), field("n", "Number", opts={"min": "9", "max": "3", "decimals": "2"}), field("p", "Phone")]
    rows = run(spark, doc, 20)["Records"].rows.orderBy(IX).collect()
    draw = R.mulberry32(42)
    from recordloom.functions.pools import FIRST

    whole = lambda lo, hi: lo + int(draw() * (hi - lo + 1))
    for r, row in enumerate(rows):
        assert row.i == r + 1 and row.f == FIRST[int(draw() * len(FIRST))] and row.b == (draw() < 0.5)
        assert abs(row.n - round(3 + draw() * 6, 2)) < 0.011
        assert row.p == f"({whole(200, 989)}) {whole(200, 989)}-{whole(0, 9999):04d}"


def test_entities_continue_one_stream(spark):
    doc = {"entities": [{"name": "A", "fields": [field("x", "City")]}, {"name": "B", "fields": [field("y", "City"), field("r", "Reference", opts={"entity": "A", "field": "x"})]}]}
    got = run(spark, doc, {"A": 3, "B": 4}, 7)
    draw = R.mulberry32(7)
    from recordloom.functions.pools import CITY

    cities = [CITY[int(draw() * 10)] for _ in range(3)]
    assert [r.x for r in got["A"].rows.orderBy(IX).collect()] == cities
    for r in got["B"].rows.orderBy(IX).collect():
        assert r.y == CITY[int(draw() * 10)] and r.r == cities[int(draw() * 3)]


def test_types_and_options(spark):
    doc = [
        field("u", "UUID"), field("d", "Date", opts={"from": "2024-03-01", "to": "2024-03-05", "dateFormat": "DD/MM/YYYY HH:mm"}), field("bad", "Date", opts={"from": "x", "to": "y"}),
        field("l", "Custom List", opts={"values": " a, ,b "}), field("e", "Custom List", opts={"values": " , "}), field("w", "Lorem Words", opts={"count": "2"}), field("s", "Static Value", opts={"value": "k"}),
        field("g", "Number", opts={"min": "?", "max": "?"}), field("m", "Faker (any)", opts={"method": "ident.npi"}), field("em", "Email"), field("z", "Zip Code"),
    ]
    for r in run(spark, doc, 50)["Records"].rows.collect():
        assert re.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", r.u)
        assert re.fullmatch(r"0[1-5]/03/2024 \d\d:\d\d", r.d) and r.bad == "" and r.l in ("a", "b") and r.e == "" and len(r.w.split()) == 2 and r.s == "k"
        assert 1 <= r.g <= 100 and len(r.m) == 10 and re.fullmatch(r"[a-z]+\.[a-z]+@example\.com", r.em) and len(r.z) == 5


def test_references(spark):
    ref = lambda f, u="": {"entity": "A", "field": f, "unique": u}
    doc = {
        "entities": [
            {"name": "A", "fields": [field("id", "Row Number"), field("tags[2]", "UUID")]},
            {"name": "B", "fields": [field("a", "Reference", opts=ref("id", "1")), field("t", "Reference", opts=ref("tags[2]"))]},
            {"name": "C", "fields": [field("many[3]", "Reference", opts=ref("id", "1"))]},
            {"name": "D", "fields": [field("b", "Reference", opts={"entity": "B", "field": "a"})]},
        ]
    }
    got = run(spark, doc, {"A": 5, "B": 7, "C": 4, "D": 6})
    taken = [r.a for r in got["B"].rows.collect()]
    assert sorted(x for x in taken if x != "#REF") == ["1", "2", "3", "4", "5"] and taken.count("#REF") == 2
    tags = {x for r in got["A"].rows.collect() for x in r["tags[2]"]}
    assert len(tags) == 10 and all(r.t in tags for r in got["B"].rows.collect())
    flat = [x for r in got["C"].rows.collect() for x in r["many[3]"]]
    assert len(flat) == 12 and sorted(x for x in flat if x != "#REF") == ["1", "2", "3", "4", "5"] and flat.count("#REF") == 7
    assert {r.b for r in got["D"].rows.collect()} <= set(taken)


def test_repeats_share_their_count(spark):
    doc = [field("o.items[0-3].@id", "Row Number"), field("o.items[0-3].n", "City"), field("none[0]", "City"), field("o.items[0-3].k", "Formula (JS)", opts={"expr": "i + ':' + field('o.items[0-3].n')"})]
    sizes = set()
    for r in run(spark, doc, 60)["Records"].rows.collect():
        a, b, k = r["o.items[0-3].@id"], r["o.items[0-3].n"], r["o.items[0-3].k"]
        assert len(a) == len(b) == len(k) <= 3 and r["none[0]"] == []
        assert k == [f"{i}:{x}" for i, x in enumerate(b)]
        sizes.add(len(a))
    assert sizes == {0, 1, 2, 3}


def test_any_partitioning_gives_the_same(spark):
    doc = {"entities": [{"name": "P", "dupLevel": "medium", "dupPct": 30, "fields": [field("id", "UUID"), field("n", "Full Name"), field("e", "Email"), field("r[0-2]", "City")]}]}
    was = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in ("1", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append([tuple(r) for r in run(spark, doc, 80)["P"].rows.orderBy(IX).select("id", "n", "e", "r[0-2]", "match_id").collect()])
    spark.conf.set("spark.sql.shuffle.partitions", was)
    assert found[0] == found[1] != []


@pytest.mark.parametrize("level", ["light", "medium", "heavy", "targeted"])
def test_duplicates(spark, level):
    doc = {"entities": [{"name": "P", "dupLevel": level, "dupPct": "40", "dupMax": "3", "fields": [
        field("id", "UUID"), field("seq", "Row Number"), field("first", "First Name", sim={"algo": "jw", "target": "0.9"}), field("last", "Last Name", keep=True), field("mail", "Email"),
        field("phone", "Phone"), field("born", "Date"), field("zip", "Zip Code"), field("amount", "Number", sim={"algo": "lev", "target": "0.6"}), field("key", "Formula (JS)", opts={"expr": "normalize(field('first') + field('last'))"}),
        field("match_id", "City"),
    ]}]}
    made = run(spark, doc, 150)["P"]
    rows = made.rows.orderBy(IX).collect()
    assert made.match_field == "_match_id" and [r.seq for r in rows] == list(range(1, len(rows) + 1)) and 170 < len(rows) < 330
    originals = {r["_match_id"]: r for r in rows if r["__variant"] == 0}
    assert len(originals) == 150 and len({r.id for r in rows}) == len(rows)
    changed = set()
    for r in rows:
        o = originals[r["_match_id"]]
        assert r.last == o.last and r.match_id == (o.match_id if level == "targeted" else r.match_id)
        assert r.key == re.sub("[^a-z0-9]", "", ((r["first"] or "") + r.last).lower())
        if r["__variant"]:
            here = {f for f in ("first", "mail", "phone", "born", "zip", "amount", "match_id") if r[f] != o[f]}
            changed |= here
            assert len(here) <= {"light": 1, "medium": 2, "heavy": 3, "targeted": 2}[level]
    assert "first" in changed and ("born" in changed) == (level in ("medium", "heavy")) and ("amount" in changed) == (level in ("heavy", "targeted"))
    truth = truth_of(made.rows, "id", "_match_id")
    assert truth_summary(truth).first().clusters == 150


def test_damage_kinds(spark):
    u = R.cell_stream(R.cell_key(3, F.col("id")), 6)
    day = [r[0] for r in spark.range(60).select(D.date_shift(F.lit("2024-03-05T10"), u, True)).collect()]
    assert set(day) == {"2024-03-04T10", "2024-03-06T10", "2024-05-03T10"}
    phone = {r[0] for r in spark.range(60).select(D.phone_format(F.lit("+1 (303) 735-1748"), u)).collect()}
    assert phone == {"13037351748", "303-735-1748", "(303) 735-1748"}
    assert all(len(r[0]) == 5 and sum(a != b for a, b in zip(r[0], "64093")) == 1 for r in spark.range(60).select(D.digit_swap(F.lit("64093"), u)).collect())
    assert all(abs(len(r[0]) - 5) <= 1 for r in spark.range(60).select(D.typo(F.lit("Smith"), u)).collect())
    mails = {r[0] for r in spark.range(80).select(D.email_fuzz(F.lit("Al.Bo@x.com"), u)).collect()}
    assert {"AlBo@x.com", "al.bo@x.com"} <= mails and all(m.endswith("@x.com") for m in mails)


@pytest.mark.parametrize("algo,target,near", [("jw", 0.6, 0.06), ("lev", 0.55, 0.05), ("jw", 0.9, 0.025)])
def test_targets_are_met_on_average(algo, target, near):
    names = ["Christopher Walkinshaw", "Margaret Thornberry", "Jonathan Fitzgerald", "Alexandria Castellano"]
    got = [D._similarity(algo, n, D.corrupt_to_target(n, algo, target, R.mulberry32(i))) for i in range(30) for n in names]
    assert abs(sum(got) / len(got) - target) < near
    assert D.corrupt_to_target("abc", "jw", 0.999, R.mulberry32(1)) == "abc" and D.corrupt_to_target("", "jw", 0.5, R.mulberry32(1)) == ""


@pytest.mark.parametrize(
    "expr,want",
    [
        ("field('a') + '-' + field('n')", "Ab c-12"), ("normalize(field('a'))", "abc"), ("pad(field('n'), 5)", "00012"), ("pad(field('a'), 2)", "Ab c"), ("concat(field('a'), 1, 'x')", "Ab c1x"),
        ("field('n') > 10 ? 'big' : 'small'", "big"), ("Math.round(field('n') / 5 * 10) / 10", "2.4"), ("field('a').toUpperCase().slice(0, 2)", "AB"), ("field('a').slice(-1)", "c"), ("(1 + 2) * 3 - 4 % 3", "8"),
        ("fields('r').length", "2"), ("fields('r').join('|')", "x|y"), ("field('a').length >= 4 && !false", "true"), ("row['a'].charAt(1)", "b"), ("field('zz') === undefined ? 'none' : 'some'", "none"), ("String(3) + field('a').indexOf('c')", "33"),
    ],
)
def test_formulas(spark, expr, want):
    df = spark.createDataFrame([("Ab c", 12, ["x", "y"])], "a string, n long, r array<string>")
    kinds = {"a": "text", "n": "number", "r": "text"}
    s = Scope(lambda n: F.col(n) if n in kinds else F.lit(None).cast("string"), F.col, F.lit(0), lambda n: kinds.get(n, "text"), lambda i: F.lit(0.5))
    assert df.select(compile_formula(expr)(s).shown()).first()[0] == want


def test_formulas_are_not_code():
    for bad in ("process.exit()", "field(", "import('x')", "(()=>1)()", "a b", "field('x').constructor('y')", "eval('1')"):
        with pytest.raises(Invalid):
            compile_formula(bad)


def test_documents_and_counts():
    ok = {"entities": [{"name": "A", "rows": "0", "dupPct": "0", "dupMax": "9", "fields": [field("x", "City")]}]}
    e = read_schema(ok)[0]
    assert (e.rows, e.dup_pct, e.dup_max, e.dup_level) == (1, 20, 5, "off")
    assert read_schema({"fields": [field("x", "City")], "rows": 7})[0] == Entity("Records", [Field("x", "City")], 7)
    for bad in ({}, {"entities": []}, {"entities": [{"name": " ", "fields": []}]}, {"fields": [field("x", "Nope")]}, {"fields": [field("x", "Faker (any)", opts={"method": "a.b"})]}, {"fields": [field("x", "Reference", opts={"entity": "Z", "field": "q"})]}, {"fields": [field("x", "City"), field("x", "City")]}, {"fields": [field("x", "Formula (JS)", opts={"expr": "nope()"})]}):
        with pytest.raises(Invalid):
            read_schema(bad)
    one = read_schema(ok)
    assert resolve_counts(one, 5) == {"A": 5} and resolve_counts(one) == {"A": 1}
    for bad in (0, "x", 1.5, {}, {"B": 1}, {"A": 0}, True):
        with pytest.raises(Invalid):
            resolve_counts(one, bad)


def test_variant_notes():
    note = lambda kind, level, **more: D.variant_note(Field("x", kind, **more), level)
    assert note("UUID", "light") == "new in every variant" and note("City", "off") == note("City", "heavy", keep=True) == "unchanged in variants"
    assert note("Date", "heavy") != note("Date", "medium") == "a day off" and note("City", "targeted", sim=("jw", 0.9)) == "fuzzed to jw similarity 0.9"
    assert all(note(k, lv) for k in ("Email", "Phone", "Date", "Zip Code", "Number", "City", "Row Number", "Formula (JS)") for lv in D.NOTES["string"])


def test_dense_index(spark):
    got = dense_index(spark.range(100).repartition(7), F.col("id") % 10, F.col("id")).collect()
    assert [r.id for r in sorted(got, key=lambda r: r[IX])] == sorted(range(100), key=lambda i: (i % 10, i)) and {r[IX] for r in got} == set(range(100))

import itertools

import pytest
from pyspark.sql import functions as F

from recordloom.functions import keys as K
from recordloom.functions import similarity as S
from recordloom.operators import diagnostics as D
from recordloom.operators.matcher import Matcher, candidates_of
from recordloom.operators.rules import Comparison as C
from recordloom.operators.rules import Invalid, Rule, matcher_document, read_matcher, read_scorer, scorer_document, suggest_rules, validate_rule

FIVE = [
    ("1", "John", "Smith", "1980-01-01", "j.smith@x.com"),
    ("2", "Jon", "Smith", "1980-01-01", None),
    ("3", "John", "Smyth", "1980-01-01", "J.SMITH@X.COM"),
    ("4", "Mary", "Jones", "1975-06-15", "m@y.com"),
    ("5", "Mary", "Jones", "1999-12-31", " "),
]


@pytest.fixture(scope="module")
def five(spark):
    return spark.createDataFrame(FIVE, "id string, first string, last string, dob string, email string").cache()


def links(df, rules, **kw):
    return sorted((r.a, r.b) for r in Matcher(df, rules, "id").run(**kw).pairs.collect())


def rule(*comparisons, conf="0.95", blank=False):
    return Rule("r", [C(*c) for c in comparisons], conf, blank)


@pytest.mark.parametrize(
    "kind,arg,a,b,want",
    [
        ("exact", "", "Smith", "Smith", True), ("exact", "", "Smith", "smith", False),
        ("normalized", "", "O'Brien-Smith", "obrien smith", True), ("normalized", "", "Smith", "Smyth", False), ("normalized", "", "!!!", "???", True),
        ("prefix", "5", "Smithson", "Smithers", True), ("prefix", "3", "Smithson", "Smythe", False), ("prefix", "0", "abcd", "abcx", True),
        ("soundex", "", "Ashcraft", "Ashcroft", True), ("soundex", "", "123", "456", True),
        ("tokens", "", "John Smith", "Smith, John", True), ("tokens", "", "John Smith", "Jon Smith", False),
        ("jw", "0.85", "Smith", "Smyth", True), ("jw", "0.85", "Smith", "Jones", False),
        ("lev", "0.6", "Smith", "Smiht", True), ("lev", "0.6", "Smith", "Brown", False),
        ("jwTokens", "0.85", "John Smith", "Smyth John", True),
        ("numeric", "1", "100", "101", True), ("numeric", "1", "100", "103", False), ("numeric", "5", "abc", "abd", False), ("numeric", "0", "12abc", "12", True),
        ("days", "1", "2024-03-01", "2024-03-02", True), ("days", "1", "2024-03-01", "2024-03-05", False), ("days", "1", "never", "whenever", False),
    ],
)
def test_comparisons(spark, kind, arg, a, b, want):
    df = spark.createDataFrame([("1", a), ("2", b)], "id string, x string")
    assert (links(df, [rule(("x", kind, arg))]) == [("1", "2")]) == want


def test_soundex_and_jaro_winkler_values(spark):
    words = {"Robert": "R163", "Rupert": "R163", "Ashcraft": "A261", "Tymczak": "T522", "Pfister": "P236", "Honeyman": "H555", "": "", None: ""}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r[0]: r[1] for r in df.select("w", K.soundex(F.col("w"))).collect()} == words
    want = {("MARTHA", "MARHTA"): 0.9611111111111111, ("DIXON", "DICKSONX"): 0.8133333333333332, ("Smith", "Smyth"): 0.8933333333333333, ("Durgan", "DURGAN"): 0.5, ("adbdaebdd", "bcbbdcade"): 0.6388888888888888, ("", ""): 1.0, ("a", ""): 0.0}
    for (a, b), v in want.items():
        assert abs(S.jaro_winkler_value(a, b) - v) < 1e-12
    got = spark.createDataFrame(list(want), "a string, b string").select("a", "b", S.jaro_winkler(F.col("a"), F.col("b")), S.jaro_winkler_column(F.col("a"), F.col("b"))).collect()
    for a, b, x, y in got:
        assert abs(x - want[a, b]) < 1e-12 and abs(y - want[a, b]) < 1e-12


def test_and_or_and_blanks(five):
    exact = [("last", "exact"), ("first", "exact"), ("dob", "exact")]
    assert links(five, [rule(*exact)]) == []
    assert links(five, [rule(("last", "exact"), ("dob", "exact"))]) == [("1", "2")]
    both = [rule(("last", "exact"), ("dob", "exact"), conf="0.9"), rule(("last", "soundex"), ("dob", "exact"), conf="0.7")]
    m = Matcher(five, both, "id").run()
    assert {(r.a, r.b): (r.score, r.rules) for r in m.links.collect()} == {("1", "2"): (0.9, [0, 1]), ("1", "3"): (0.7, [1]), ("2", "3"): (0.7, [1])}
    assert {r.rule: r.linked for r in m.per_rule.collect()} == {0: 1, 1: 3}
    assert links(five, [rule(("email", "normalized"))]) == [("1", "3")]
    assert links(five, [rule(("email", "normalized"), blank=True)]) == [("1", "3")]
    assert links(five, [rule(("last", "exact"), ("email", "normalized"))]) == []
    agreeing = links(five, [rule(("last", "exact"), ("email", "normalized"), blank=True)])
    assert ("1", "2") in agreeing and ("4", "5") in agreeing and ("1", "4") not in agreeing


def test_blocked_is_brute_force_and_costs_less(five, spark):
    blocked, loose = rule(("dob", "exact"), ("last", "jw", "0.8")), rule(("last", "jw", "0.8"))
    m = Matcher(five, [blocked], "id")
    assert links(five, [blocked]) == [p for p in links(five, [loose]) if dict((r[0], r[3]) for r in FIVE)[p[0]] == dict((r[0], r[3]) for r in FIVE)[p[1]]]
    assert m.cost().first().compared == 3 and Matcher(five, [loose], "id").cost().first().compared == 10
    with pytest.raises(Invalid, match='"r"'):
        Matcher(five, [loose], "id").run(budget=3)
    people = [(str(i), f"n{i % 7}", None if i % 5 == 0 else f"z{i % 3}", f"{'ab' * (i % 4)}{i % 6}") for i in range(40)]
    df = spark.createDataFrame(people, "id string, n string, z string, t string")
    for blank in (False, True):
        r = rule(("z", "exact"), ("n", "exact"), ("t", "lev", "0.5"), blank=blank)
        want = []
        for x, y in itertools.combinations(sorted(people), 2):
            tests = []
            for i, k in ((2, "e"), (1, "e"), (3, "l")):
                a, b = x[i], y[i]
                if not (a or "").strip() or not (b or "").strip():
                    tests.append(blank)
                elif k == "e":
                    tests.append(a == b)
                else:
                    tests.append(1 - lev(a, b) / max(len(a), len(b)) >= 0.5)
            if all(tests):
                want.append((x[0], y[0]))
        assert links(df, [r]) == sorted(want)
        got = Matcher(df, [r], "id")
        assert got.cost().first().compared == got.run().candidates.count()


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        row = out
    return row[-1]


def test_policy_and_ranking(spark):
    df = spark.createDataFrame([("A", "smith", "k"), ("B", "smith", "k"), ("C", "smyth", "k"), ("D", "smyth", "k")], "id string, last string, dob string")
    rules = [rule(("last", "exact"), ("dob", "exact"), conf="1.0"), rule(("last", "soundex"), ("dob", "exact"), conf="0.8")]
    every, best = Matcher(df, rules, "id").run(), Matcher(df, rules, "id").run("best")
    assert every.pairs.count() == 6 and {r.id: r.other for r in every.matched_to.collect()} == {"A": "B", "B": "A", "C": "D", "D": "C"}
    assert sorted((r.a, r.b) for r in best.pairs.collect()) == [("A", "B"), ("C", "D")]
    assert best.links.where("not chosen").count() == 4 and {r.rule: r.linked for r in best.per_rule.collect()} == {0: 2, 1: 6}
    own = candidates_of(best, "A").orderBy("rank").collect()
    assert [(r.to, r.score, r.linked, r.picked) for r in own] == [("B", 1.0, True, True), ("C", 0.8, False, False), ("D", 0.8, False, False)]
    same = spark.createDataFrame([("P", "x"), ("Q", "x"), ("R", "x")], "id string, v string")
    assert {r.id: r.other for r in Matcher(same, [rule(("v", "exact"))], "id").run().matched_to.collect()} == {"P": "Q", "Q": "P", "R": "P"}


def test_partitions_do_not_matter(five):
    rules = [rule(("dob", "exact"), ("last", "jw", "0.8"))]
    assert {tuple(links(five.repartition(n), rules)) for n in (1, 3, 8)} == {tuple(links(five, rules))}


def test_validation_documents_suggestions():
    for bad in (Rule("x"), rule(("", "exact")), rule(("nope", "exact")), rule(("last", "odd")), rule(("last", "jw", "1.5")), rule(("last", "numeric", "-1")), rule(("last", "exact"), conf="2")):
        with pytest.raises(Invalid):
            validate_rule(bad, 0, {"last"})
    rules = [rule(("last", "jw", ""), ("dob", "exact"))]
    read, warnings = read_matcher(matcher_document(rules, "People", "best"), ["last"])
    assert read["rules"][0].comparisons[0].arg == "0.90" and read["linkPolicy"] == "best" and len(warnings) == 1
    scorer, warnings = read_scorer(scorer_document(rules, idField="id", autoMerge=0.5, reviewFloor=0.9), [])
    assert (scorer["autoMerge"], scorer["reviewFloor"]) == (0.92, 0.78) and warnings
    for bad in ([], {"kind": "other", "rules": []}, {"rules": 3}, {"entities": []}):
        with pytest.raises(Invalid):
            read_matcher(bad)
    names = [r.name for r in suggest_rules(["id", "first_name", "last_name", "birth_date", "email", "zip"])]
    assert names == ["Same email", "Fuzzy name and exact birth date", "Fuzzy name and postal code"]
    full = suggest_rules(["person.ssn", "person.surname", "fname", "dob", "postal_code"])
    assert [[(c.field, c.kind, c.arg) for c in r.comparisons] for r in full] == [
        [("person.ssn", "exact", ""), ("dob", "exact", "")],
        [("person.surname", "jw", "0.85"), ("fname", "jw", "0.80"), ("dob", "exact", "")],
        [("person.surname", "soundex", ""), ("fname", "jw", "0.85"), ("postal_code", "exact", "")],
    ]
    assert [r.name for r in suggest_rules(["code"])] == ["Rule 1"] and suggest_rules([]) == []
    assert [r.comparisons[0].field for r in suggest_rules(["code", "colour"])] == ["code"]


def test_explain_and_attribute(spark, five):
    strict = Rule("strict", [C("last", "exact"), C("dob", "exact")])
    fuzzy = Rule("fuzzy", [C("last", "jw", "0.85"), C("dob", "days", "1"), C("email", "normalized")], "0.8", True)
    got = D.explain_pairs([strict, fuzzy], five, spark.createDataFrame([("1", "3")], "a string, b string"), "id").collect()
    assert [(r.rule, r.field) for r in got if not r.passed] == [(0, "last")]
    assert {r.rule: r.rule_passed for r in got} == {0: False, 1: True}
    missed = spark.createDataFrame([("1", "3"), ("4", "5"), ("4", "9")], "a string, b string")
    head, slots = D.attribute_misses([strict, fuzzy], five, missed, "id")
    assert {r.rule: (r.misses, r.near_misses, r.blank_only, r.inspected) for r in head.collect()} == {0: (3, 2, 0, 2), 1: (3, 1, 0, 2)}
    assert {(r.rule, r.field): r["count"] for r in slots.collect()} == {(0, "last"): 1, (0, "dob"): 1, (1, "last"): 0, (1, "dob"): 1, (1, "email"): 0}


@pytest.mark.parametrize(
    "a,b,want",
    [
        ("Smith", "Smith", None), (None, "", None), ("Smith", "SMITH", "case"), ("Mary.Ann@X.com", "mary.ann@x.com", "case"), ("Mary Ann", "Mary  Ann", "spacing"), ("Smith", "Smith ", "spacing"),
        ("Durgan", "Duqan", "typo"), ("Smith", "Smiht", "typo"), ("Johnathan", "Jonatn", "fuzzed"), ("64093", "64098", "digits"), ("1972-04-09", "1972-09-04", "date"),
        ("(303) 735-1748", "303-735-1748", "format"), ("mary.ann@x.com", "maryann@x.com", "format"), ("Smith", " ", "blanked"), ("", "Smith", "filled"),
        ("123e4567-e89b-12d3-a456-426614174000", "123e4567-e89b-12d3-a456-426614174111", "regenerated"), ("Smith", "Rodriguez", "other"),
    ],
)
def test_change_kinds(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(D.classify_change(F.col("a"), F.col("b"))).first()[0] == want
    assert df.select(D.classify_change(F.col("a"), F.col("b"), "Formula (JS)")).first()[0] == (None if (a or "") == (b or "") else "derived")


def test_audit_and_what_if(spark, five):
    rules = [Rule("strict", [C("last", "exact")]), Rule("loose", [C("last", "soundex")])]
    changes = "array<struct<field:string,kind:string>>"
    variants = spark.createDataFrame([("3", "1", [("last", "typo"), ("email", "case")]), ("2", "1", [("first", "typo")]), ("99", "1", [])], f"id string, original_id string, changes {changes}")
    got = {(r.rule, r.dimension, r.value): (r.caught, r.lost) for r in D.audit_variants(rules, five, variants, "id").collect()}
    assert got[0, "all", ""] == (1, 1) and got[1, "all", ""] == (2, 0) and got[0, "kind", "typo"] == (1, 1) and got[0, "field", "last"] == (0, 1)
    assert tuple(D.audit_totals(rules, five, variants, "id").first()) == (2, 2, 0)
    one = spark.createDataFrame([("1", "Durgan")], "id string, last string")
    cycle = F.array(*map(F.lit, ["DURGAN", "Duqan", "Durgan", "Dxrgxn"]))
    kinds = [Rule("exact", [C("last", "exact")]), Rule("norm", [C("last", "normalized")])]
    outcomes, survival = D.what_if(kinds, one, "last", lambda v, i: F.element_at(cycle, i % 4 + 1), 8)
    assert [(r["value"], r["count"], r["change"], r["accepted"]) for r in outcomes.collect()] == [("DURGAN", 2, "case", [1]), ("Duqan", 2, "typo", []), ("Durgan", 2, None, [0, 1]), ("Dxrgxn", 2, "typo", [])]
    assert {r.rule: (r.survived, r.rate) for r in survival.collect()} == {0: (2, 0.25), 1: (4, 0.5)}


def test_run_checks_ids_and_cost_first(spark):
    run = lambda rows, **kw: Matcher(spark.createDataFrame(rows, "id string, last string"), [rule(("last", "jw", "0.8"))], "id").run(**kw)
    for rows, words in (([("1", "a"), ("", "b")], "no value"), ([("1", "a"), (None, "b")], "no value"), ([("1", "a"), ("1", "b")], 'id "1" is not unique')):
        with pytest.raises(Invalid, match=words):
            run(rows)
    with pytest.raises(Invalid, match="no records"):
        run([])
    many = spark.range(2600).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("last"))
    with pytest.raises(Invalid, match="3,378,700"):
        Matcher(many, [rule(("last", "jw", "0.8"))], "id").run()

"""What only larger tables show: long keys, many copies of a value, values that nearly agree."""

import duckdb
import pytest

from recordloom.plans import catalog
from tests.test_queries import rows


def same_as_sql(spark, folder, name, **tables):
    """A query against its SQL on the given tables."""
    con = duckdb.connect()
    for t, select in tables.items():
        con.execute(f"COPY ({select}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, want = rows(catalog.queries()[name](spark, str(folder)).toPandas()), rows(con.execute(catalog.oracle_sql()[name]).df())
    assert got == want
    return got[1]


def test_check_digits_of_long_keys(spark, tmp_path):
    """Keys whose numbers have more digits than the bodies."""
    keys = "SELECT unnest([0, 1, 12627, 12628, 14999, 899999, 123456789]::BIGINT[]) AS c_custkey"
    assert len(same_as_sql(spark, tmp_path, "ident_checks", customer=keys)) == 7


def test_prices_are_read_once_a_part(spark, tmp_path):
    """The number pattern must not be run on pairs, of which there are far more than parts."""
    parts = "SELECT i::BIGINT AS p_partkey, 'a ' || i % 3 AS p_name, 'B' || i % 2 AS p_brand, CASE WHEN i % 50 = 0 THEN NULL ELSE 900 + i % 120 + i % 7 / 4 END::DOUBLE AS p_retailprice FROM range(600) x(i)"
    assert len(same_as_sql(spark, tmp_path, "cmp_numeric", part=parts)) > 1000
    plan = catalog.queries()["cmp_numeric"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "regexp" not in plan.split("Join", 1)[0] + plan.split("Join", 1)[1].split("\n", 1)[0]


def test_what_if_is_dealt_out(spark, tmp_path):
    """Draws of records are judged in many tasks, and not brought together by all their columns before."""
    people = "SELECT i::BIGINT AS c_custkey, 'Customer#' || lpad((i % 40)::VARCHAR, 9, '0') AS c_name, (i % 3)::INTEGER AS c_nationkey, i % 9 + 0.5 AS c_acctbal, 'S' || i % 2 AS c_mktsegment FROM range(200) x(i)"
    assert len(same_as_sql(spark, tmp_path, "what_if", customer=people)) == 3
    plan = catalog.queries()["what_if"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan and plan.count("Aggregate") == 1


CASES = [("lev", "0.94", False), ("lev", "0.8", True), ("jw", "0.985", False), ("jw", "0.93", True), ("jwTokens", "0.97", False)]


@pytest.mark.parametrize("kind,least,agrees", CASES)
def test_near_texts_are_all_found(spark, kind, least, agrees):
    """Similar values against every pair compared one by one: copies, blanks, one and two edits, swaps, all lengths."""
    import random

    from recordloom.functions import similarity as S
    from recordloom.operators.matcher import Matcher
    from recordloom.operators.rules import Comparison, Rule

    draw, texts = random.Random(7), ["", "!", None]
    for n in (1, 2, 3, 6, 10, 17, 18, 19, 26, 27, 34, 40):
        base = "".join(draw.choice("abcd 01") for _ in range(n)).strip() or "a"
        i = draw.randrange(len(base))
        texts += [base, base, base[:i] + "x" + base[i + 1 :], base[:i] + base[i + 1 :], base[:i] + "yz" + base[i:], base + "q", base[:-2] + base[-2:][::-1]]
    rows_in = [(f"r{i:03d}", t, draw.choice(["p", "q", "", None])) for i, t in enumerate(texts)]
    rule = Rule("near", [Comparison("code", "exact"), Comparison("name", kind, least)], "0.6", agrees)
    found = Matcher(spark.createDataFrame(rows_in, "id string, name string, code string"), [rule], "id").run(budget=None).links
    got = {(r.a, r.b) for r in found.collect()}

    def measure(a, b):
        if kind == "lev":
            row = list(range(len(b) + 1))
            for i, x in enumerate(a, 1):
                row, last = [i], row
                for j, y in enumerate(b, 1):
                    row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
            return 1 - row[-1] / max(len(a), len(b))
        if kind == "jwTokens":
            import re

            a, b = (" ".join(sorted(w for w in re.split("[^a-z0-9]+", t.lower()) if w)) for t in (a, b))
        return S.jaro_winkler_value(a, b)

    blank = lambda t: t is None or not t.strip()
    want = set()
    for i, (a, x, k) in enumerate(rows_in):
        for b, y, m in rows_in[i + 1 :]:
            tests = [(blank(k) or blank(m), lambda: k == m), (blank(x) or blank(y), lambda: measure(x, y) >= float(least))]  # noqa: B023
            if all(agrees if no else test() for no, test in tests) and not all(no for no, _ in tests):
                want.add((a, b))
    assert got == want


def test_near_texts_meet_few(spark):
    """Of a block's 4,498,500 pairs only those that share a part of their names are looked at; copies once."""
    from recordloom.operators.matcher import Matcher, first_wide
    from recordloom.operators.rules import Comparison, Rule

    own = spark.range(3000).selectExpr("concat('r', id) AS id", "concat('Customer ', lpad(cast(id * 7919 % 100000 AS string), 9, '0')) AS name", "'k' AS code")
    for kind, least in (("lev", "0.94"), ("jw", "0.985")):
        rule = Rule("near", [Comparison("code", "exact"), Comparison("name", kind, least)], "0.6")
        m = Matcher(own, [rule], "id")
        met = m._near(rule, rule.comparisons[1], first_wide(rule.comparisons[1]))
        assert sum(df.count() for df in met) < 450_000


def _near_pairs(spark, kind, least, agrees):
    from recordloom.operators.matcher import Matcher, first_wide
    from recordloom.operators.rules import Comparison, Rule

    own = spark.range(3000).selectExpr("concat('r', id) AS id", "concat('Customer ', lpad(cast(id * 7919 % 100000 AS string), 9, '0')) AS name", "CASE WHEN id % 9 > 0 THEN concat('k', id % 5) END AS code")
    places = [Comparison("code", "exact")] * agrees
    rule = Rule("near", [*places, Comparison("name", kind, least)], "0.6", agrees)
    m = Matcher(own, [rule], "id")
    return m, sum(df.count() for df in m._near(rule, rule.comparisons[-1], first_wide(rule.comparisons[-1])))


def test_blanks_meet_few(spark):
    """A blank code meets names that share a part, not every record; nothing is joined by a nested loop."""
    m, met = _near_pairs(spark, "lev", "0.94", True)
    assert met < 20_000
    plan = m.links(budget=None)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_sorted_names_meet_few(spark):
    """Names of one length that must agree in all characters do not meet on all but one of them."""
    assert _near_pairs(spark, "jw", "0.985", False)[1] < 20_000


SUPPLIERS = """SELECT i::BIGINT AS s_suppkey, (CASE WHEN i % 7 = 3 THEN 'Supplier#' || i % 40 WHEN i % 11 = 5 THEN 'Supplier#0000' || i % 20 || 'x'
    ELSE 'Supplier#' || lpad((i * 37 % 120)::VARCHAR, 9, '0') END) AS s_name, (i % 25)::INTEGER AS s_nationkey, 1.5::DOUBLE AS s_acctbal FROM range(130) x(i)"""


@pytest.mark.parametrize("broadcast,many", [(200_000, 1_000), (0, 1)])
@pytest.mark.parametrize("name", ["match_unblocked", "match_blank_agrees"])
def test_suppliers_of_several_lengths(spark, tmp_path, monkeypatch, name, broadcast, many):
    """Copies, swaps and lengths that differ, opened with and without records at every executor."""
    from recordloom.operators import matcher

    monkeypatch.setattr(matcher, "BROADCAST", broadcast)
    monkeypatch.setattr(matcher, "MANY", many)
    assert len(same_as_sql(spark, tmp_path, name, supplier=SUPPLIERS)) > 20


def test_jaro_winkler_of_many_pairs():
    """Batches give the value of each pair to the last bit."""
    import random

    import pandas as pd

    from recordloom.functions import similarity as S

    draw, a, b = random.Random(11), ["", "a", "", None, "\0", "x" * 40], ["", "", "b", "c", "a\0", "x" * 39 + "y"]
    for _ in range(4000):
        letters = draw.choice(["ab", "abcdef 01", "a\0", "é😀xyz"])
        x = [draw.choice(letters) for _ in range(draw.randrange(36))]
        y = x[:]
        draw.shuffle(y) if draw.random() < 0.3 else y.insert(draw.randrange(len(y) + 1), "q")
        a.append("".join(x))
        b.append("".join(y))
    got = S._jaro_winkler.func(pd.Series(a, dtype=object), pd.Series(b, dtype=object)).tolist()
    assert [g for g, x, y in zip(got, a, b) if x is not None] == [S.jaro_winkler_value(x, y) for x, y in zip(a, b) if x is not None]
    assert got[3] != got[3]

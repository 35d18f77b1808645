import re

import pytest
from pyspark.sql import functions as F

from recordloom.functions import modules as M
from recordloom.functions import pools as P
from recordloom.functions import rng as R


def test_stream_is_the_known_one(spark):
    own = R.mulberry32(42)
    want = [0.6011037519201636, 0.44829055899754167, 0.8524657934904099, 0.6697340414393693, 0.17481389874592423]
    assert [own() for _ in range(5)] == want
    got = spark.range(1).select(R.uniforms(F.lit(42).cast("long"), F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long")))).first()[0]
    assert got == want
    u = R.row_stream(7, F.col("id"), 2)
    assert [x for r in spark.range(2).select(u(0), u(1)).collect() for x in r][:3] == [0.011704753153026104, 0.06195825757458806, 0.97690763277933]


def draws(spark, name, n=200):
    u = R.cell_stream(R.cell_key(11, name, F.col("id")), 96)
    return [r[0] for r in spark.range(n).select(M.catalog()[name](u)).collect()]


def luhn_ok(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def test_check_digits(spark):
    assert all(luhn_ok("80840" + x) and re.fullmatch(r"[12]\d{9}", x) for x in draws(spark, "ident.npi"))
    assert all(sum(int(c) * w for c, w in zip(x, [3, 7, 1] * 3)) % 10 == 0 and len(x) == 9 for x in draws(spark, "ident.abaRouting"))
    assert all(luhn_ok("".join(c if c.isdigit() else str(ord(c) - 55) for c in x)) for x in draws(spark, "ident.isin"))
    for name, n, w in (("ident.gtin13", 13, (1, 3)), ("ident.upc12", 12, (3, 1))):
        assert all(len(x) == n and sum(int(c) * w[i % 2] for i, c in enumerate(x)) % 10 == 0 for x in draws(spark, name))
    values = dict(zip(M.VIN_ALPHABET, M.VIN_VALUES))
    for x in draws(spark, "ident.vin"):
        r = sum(values.get(c, 0) * w for c, w in zip(x, M.VIN_WEIGHTS)) % 11
        assert len(x) == 17 and x[8] == ("X" if r == 10 else str(r))
    for x in draws(spark, "ident.nhsNumber"):
        d = [int(c) for c in x.replace(" ", "")]
        assert len(d) == 10 and sum(a * w for a, w in zip(d, range(10, 1, -1))) + d[9] & -1 and (sum(a * w for a, w in zip(d, range(10, 0, -1))) % 11 == 0)
    assert all(luhn_ok(x.replace(" ", "")) for x in draws(spark, "ident.sinCanada"))
    assert all(not x.startswith("666") and re.fullmatch(r"\d{3}-\d{2}-\d{4}", x) for x in draws(spark, "ident.ssn"))
    letters = M.LETTERS + "012345"
    for x in draws(spark, "ids.salesforce18"):
        assert x[15:] == "".join(letters[sum(1 << i for i in range(5) if x[k * 5 + i].isupper())] for k in range(3))


def test_postal_codes_and_skew(spark):
    for region, rows in P.REGIONS.items():
        shapes = [r"[A-Z]{1,2}[1-9]\d? \d[A-Z]{2}" if s == "UK" else re.sub("A", "[A-Z]", re.sub("9", r"\\d", s)) for *_, s in rows]
        assert all(any(re.fullmatch(s, x) for s in shapes) for x in draws(spark, f"geo{region}.postal", 60))
    tiers = draws(spark, "weighted.customerTier", 4000)
    assert abs(tiers.count("Standard") / 4000 - 0.7) < 0.03 and abs(tiers.count("Enterprise") / 4000 - 0.1) < 0.02


@pytest.mark.parametrize("part", range(4))
def test_every_method_gives_repeatable_text(spark, part):
    names = list(M.catalog())[part::4]
    u = lambda n: R.cell_stream(R.cell_key(5, n, F.col("id")), 96)
    for i in range(0, len(names), 12):
        cols = [M.catalog()[n](u(n)).alias(n) for n in names[i : i + 12]]
        a, b = spark.range(4).select(*cols).collect(), spark.range(4).repartition(3).select("id", *cols).orderBy("id").drop("id").collect()
        assert a == b and all(isinstance(x, str) for r in a for x in r)


def test_catalog_size():
    by = {}
    for n in M.catalog():
        by.setdefault(n.split(".")[0], []).append(n)
    assert {k: len(by[k]) for k in ("unwrap", "ids", "ident", "dirty", "weighted", "intlAny")} == {"unwrap": 23, "ids": 14, "ident": 10, "dirty": 22, "weighted": 11, "intlAny": 4}
    assert sum(len(v) for k, v in by.items() if k.startswith("geo")) == 25 and sum(len(v) for k, v in by.items() if k.startswith("intl") and k != "intlAny") == 72


def test_cells_of_large_tables_are_unique(spark):
    n = 2_000_000
    keys = spark.range(n).select(R.cell_key(42, "E", "f", F.col("id")).alias("k"))
    assert keys.distinct().count() == n
    few = spark.range(200_000).select(M.uuid(R.cell_stream(R.cell_key(42, "E", "u", F.col("id")), 31)).alias("u"))
    assert few.distinct().count() == 200_000
    u = spark.range(20_000).select(F.explode(R.cell_draws(R.cell_key(1, F.col("id")), 3)).alias("u")).agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= u[0] < 0.001 and 0.999 < u[1] < 1 and abs(u[2] - 0.5) < 0.01


def test_employer_prefixes(spark):
    assert len(M.EIN) == 82 and M.EIN[0] == "01" and "07" not in M.EIN and "99" in M.EIN

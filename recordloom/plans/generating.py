"""Queries for generation: one record for each customer or supplier, so that they grow with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import modules as M
from ..functions import pools as P
from ..functions import rng as R
from ..operators.generate import IX, Generator
from ..operators.schema import read_schema
from ..sources.sinks import json_line
from .beds import table

SEED = 42


def _run(spark, d, doc, **tables):
    counts = {e: table(spark, d, t).count() for e, t in tables.items()}
    return Generator(spark, read_schema(doc), counts, SEED).run()


def _field(name, kind, **opts):
    return {"name": name, "type": kind, "opts": {k.rstrip("_"): v for k, v in opts.items()}}


FIXED = {"entities": [{"name": "E", "fields": [_field("seq", "Row Number"), _field("first", "First Name"), _field("flag", "Boolean"), _field("amount", "Number", min="-5", max="500"), _field("day", "Date", from_="2024-01-01", to="2025-01-01"), _field("colour", "Custom List", values="red, green, blue"), _field("phone", "Phone")]}]}


def gen_fixed_draw(spark, d):
    return _run(spark, d, FIXED, E="customer")["E"].flat()


def gen_uuid(spark, d):
    return _run(spark, d, {"entities": [{"name": "E", "fields": [_field("n", "Row Number"), _field("u", "UUID")]}]}, E="customer")["E"].flat()


LINKED = {"entities": [{"name": "A", "fields": [_field("id", "Row Number"), _field("city", "City")]}, {"name": "B", "fields": [_field("n", "Row Number"), _field("a", "Reference", entity="A", field="id"), _field("word", "Lorem Words", count="2")]}]}


def gen_reference(spark, d):
    return _run(spark, d, LINKED, A="supplier", B="customer")["B"].flat()


def gen_reference_unique(spark, d):
    doc = {"entities": [LINKED["entities"][0], {"name": "B", "fields": [_field("n", "Row Number"), _field("a", "Reference", entity="A", field="id", unique="1")]}]}
    own = _run(spark, d, doc, A="supplier", B="customer")["B"].flat()
    return own.agg(F.count("*").alias("records"), F.count_if(F.col("a") == "#REF").alias("left_over"), F.countDistinct(F.when(F.col("a") != "#REF", F.col("a"))).alias("taken"))


def gen_repeat_nested(spark, d):
    """Nested records with repeats as JSON lines."""
    doc = {"entities": [{"name": "E", "fields": [_field("@id", "Row Number"), _field("o.name", "Company"), _field("o.items[0-3].@sku", "UUID"), _field("o.items[0-3].qty", "Number", min="1", max="9")]}]}
    made = _run(spark, d, doc, E="customer")["E"]
    return made.rows.select(F.col(IX).alias("n"), json_line(made.rows, [f.name for f in made.entity.fields]).alias("json"))


def gen_formula(spark, d):
    doc = {"entities": [{"name": "E", "fields": [_field("n", "Row Number"), _field("key", "Formula (JS)", expr="pad(field('n'), 7) + '-' + (field('n') % 2 === 0 ? 'even' : 'odd')"), _field("short", "Formula (JS)", expr="normalize(field('key')).slice(-4).toUpperCase()")]}]}
    return _run(spark, d, doc, E="customer")["E"].flat()


def gen_modules(spark, d):
    """A value of a method of every module for each supplier."""
    names = ["ids.salesforce18", "ident.vin", "dirty.phoneMessy", "weighted.industry", "geoEurope.place", "intlJapan.place", "unwrap.colorHsl"]
    n = table(spark, d, "supplier").count()
    return spark.range(n).select("id", *[M.catalog()[x](R.cell_stream(R.cell_key(SEED, x, F.col("id")), 96)).alias(x.replace(".", "_")) for x in names])


def weighted_pick(spark, d):
    u = R.row_stream(SEED, F.col("id"), 1)
    picked = spark.range(table(spark, d, "customer").count()).select(R.weighted(u(0), P.WEIGHTED["leadSource"]).alias("source"))
    return picked.groupBy("source").agg(F.count("*").alias("n"))


def ident_checks(spark, d):
    """Check digits over numbers made from the customers' keys: the first ``n`` digits of longer ones."""
    body = lambda n: F.lpad((F.col("c_custkey") * 7919).cast("string"), n, "0")
    own = table(spark, d, "customer")
    aba = (10 - M.weighted_sum(body(8), [3, 7, 1, 3, 7, 1, 3, 7]) % 10) % 10
    return own.select("c_custkey", M.luhn(F.concat(F.lit("80840"), body(9))).alias("npi"), aba.cast("string").alias("aba"), M.gtin(body(12), 12, 1).alias("gtin13"), M.gtin(body(11), 11, 3).alias("upc12"))


def _people_doc(level):
    fields = [_field("id", "UUID"), _field("name", "Full Name") | {"sim": {"algo": "jw", "target": "0.88"}}, _field("mail", "Email"), _field("phone", "Phone"), _field("born", "Date"), _field("zip", "Zip Code")]
    return {"entities": [{"name": "E", "dupLevel": level, "dupPct": "30", "dupMax": "3", "fields": fields}]}


def dup_inject(spark, d):
    """Clusters by size after duplicates went in, with the records that differ from their original in each field."""
    rows = _run(spark, d, _people_doc("medium"), E="customer")["E"].rows
    by = rows.groupBy("match_id").agg(F.count("*").alias("size"), *[(F.countDistinct(c) - 1).alias(c) for c in ("name", "mail", "phone", "born", "zip")])
    return by.groupBy("size").agg(F.count("*").alias("clusters"), *[F.sum(c).alias(f"{c}_changed") for c in ("name", "mail", "phone", "born", "zip")])


def dup_targeted(spark, d):
    made = _run(spark, d, _people_doc("targeted"), E="supplier")["E"]
    return made.flat()


QUERIES = {f.__name__: f for f in (gen_fixed_draw, gen_uuid, gen_reference, gen_reference_unique, gen_repeat_nested, gen_formula, gen_modules, weighted_pick, ident_checks, dup_inject, dup_targeted)}


def draw(k: str) -> str:
    """Draw k of the seed in DuckDB SQL."""
    times = lambda a, b: f"(({a})::HUGEINT * ({b})::HUGEINT % 4294967296)::UBIGINT"
    state = f"(({SEED} + ({k})::HUGEINT * {R.STEP}) % 4294967296)::UBIGINT"
    one = f"list_transform([{state}], lambda a: {times('xor(a, a >> 15)', 'a | 1')})"
    two = f"list_transform({one}, lambda t: xor((t + {times('xor(t, t >> 7)', 't | 61')}) % 4294967296, t))"
    return f"(list_transform({two}, lambda t: xor(t, t >> 14)::DOUBLE / 4294967296::DOUBLE)[1])"


def _pool(values: list[str], u: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][CAST(floor({u} * {len(values)}) AS INT) + 1]"


def _int(u: str, lo: int, hi: int) -> str:
    return f"CAST(floor({u} * {hi - lo + 1}) + {lo} AS BIGINT)"


_ROWS = "WITH rows AS (SELECT i AS r FROM range((SELECT count(*) FROM {t})) x(i))"
_U = ", ".join(f"{draw(f'r * 8 + {i + 1}')} AS u{i}" for i in range(8))
_HEX = "'0123456789abcdef'"


def _uuid_sql() -> str:
    out, i = [], 0
    for c in "xxxxxxxx-xxxx-4xxx-yxxx-xxxxxxxxxxxx":
        if c in "-4":
            out.append(f"'{c}'")
            continue
        out.append(f"substr({_HEX if c == 'x' else repr('89ab' * 4)}, CAST(floor(us[{i + 1}] * 16) AS INT) + 1, 1)")
        i += 1
    return " || ".join(out)


def _digit_sum(text: str, weights: list[int]) -> str:
    return "(" + " + ".join(f"CAST(substr({text}, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(weights)) + ")"


def _luhn_sql(text: str, n: int) -> str:
    terms = []
    for i in range(n):
        digit = f"CAST(substr({text}, {n - i}, 1) AS INT)"
        terms.append(f"(CASE WHEN {digit} * 2 > 9 THEN {digit} * 2 - 9 ELSE {digit} * 2 END)" if i % 2 == 0 else digit)
    return f"CAST((10 - ({' + '.join(terms)}) % 10) % 10 AS VARCHAR)"


_LEAD, _run_total, _cases = P.WEIGHTED["leadSource"], 0.0, []
for _value, _weight in _LEAD[:-1]:
    _run_total += _weight
    _cases.append(f"WHEN u < {_run_total / sum(w for _, w in _LEAD)!r}::DOUBLE THEN '{_value}'")

ORACLES = {
    "gen_fixed_draw": f"""{_ROWS.format(t='customer')}, d AS (SELECT r, {_U} FROM rows)
        SELECT r + 1 AS seq, {_pool(P.FIRST, 'u0')} AS first, u1 < 0.5::DOUBLE AS flag, CAST(floor(-5::DOUBLE + u2 * 505::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS amount,
          strftime(make_timestamp(CAST(floor(1704067200000::DOUBLE + u3 * 31622400000::DOUBLE) AS BIGINT) * 1000), '%Y-%m-%d') AS day, {_pool(['red', 'green', 'blue'], 'u4')} AS colour,
          '(' || {_int('u5', 200, 989)} || ') ' || {_int('u6', 200, 989)} || '-' || lpad(CAST({_int('u7', 0, 9999)} AS VARCHAR), 4, '0') AS phone FROM d""",
    "gen_uuid": f"""{_ROWS.format(t='customer')}, d AS (SELECT r, [{', '.join(draw(f'r * 31 + {i + 1}') for i in range(31))}] AS us FROM rows) SELECT r + 1 AS n, {_uuid_sql()} AS u FROM d""",
    "gen_reference": f"""{_ROWS.format(t='customer')}, s AS (SELECT count(*) AS n FROM supplier),
        d AS (SELECT r, n, {draw('n + r * 3 + 1')} AS u0, {draw('n + r * 3 + 2')} AS u1, {draw('n + r * 3 + 3')} AS u2 FROM rows, s)
        SELECT r + 1 AS n, CAST(floor(u0 * n) + 1 AS BIGINT) AS a, {_pool(P.WORDS, 'u1')} || ' ' || {_pool(P.WORDS, 'u2')} AS word FROM d""",
    "gen_reference_unique": "SELECT (SELECT count(*) FROM customer) AS records, greatest(0, (SELECT count(*) FROM customer) - (SELECT count(*) FROM supplier)) AS left_over, least((SELECT count(*) FROM customer), (SELECT count(*) FROM supplier)) AS taken",
    "gen_formula": f"""{_ROWS.format(t='customer')}, k AS (SELECT r + 1 AS n, lpad(CAST(r + 1 AS VARCHAR), 7, '0') || '-' || CASE WHEN (r + 1) % 2 = 0 THEN 'even' ELSE 'odd' END AS key FROM rows)
        SELECT n, key, upper(right(regexp_replace(lower(key), '[^a-z0-9]', '', 'g'), 4)) AS short FROM k""",
    "weighted_pick": f"{_ROWS.format(t='customer')} SELECT CASE {' '.join(_cases)} ELSE '{_LEAD[-1][0]}' END AS source, count(*) AS n FROM (SELECT {draw('r + 1')} AS u FROM rows) GROUP BY 1",
    "ident_checks": f"""WITH b AS (SELECT c_custkey, '80840' || lpad(CAST(c_custkey * 7919 AS VARCHAR), 9, '0') AS npi, lpad(CAST(c_custkey * 7919 AS VARCHAR), 8, '0') AS aba, lpad(CAST(c_custkey * 7919 AS VARCHAR), 12, '0') AS g, lpad(CAST(c_custkey * 7919 AS VARCHAR), 11, '0') AS u FROM customer)
        SELECT c_custkey, {_luhn_sql('npi', 14)} AS npi, CAST((10 - {_digit_sum('aba', [3, 7, 1, 3, 7, 1, 3, 7])} % 10) % 10 AS VARCHAR) AS aba,
          CAST((10 - {_digit_sum('g', [1, 3] * 6)} % 10) % 10 AS VARCHAR) AS gtin13, CAST((10 - {_digit_sum('u', [3, 1] * 5 + [3])} % 10) % 10 AS VARCHAR) AS upc12 FROM b""",
}

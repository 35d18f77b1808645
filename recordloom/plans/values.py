"""Queries for the kinds of values, the generator modules and the damages, each value beside its record.

All draws come from the one counter-based stream, so SQL can say what every cell must be.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import modules as M
from ..functions import pools as P
from ..functions import rng as R
from ..operators import duplicates as D
from .beds import table
from .generating import SEED, _field, _luhn_sql, _run, draw

SIMPLE = ["Last Name", "Email", "Street Address", "City", "State", "State Abbr", "Zip Code", "Country", "Company", "Job Title"]


def gen_simple_kinds(spark, d):
    """A value of each simple kind for every customer."""
    fields = [_field("n", "Row Number"), _field("fixed", "Static Value", value="same")] + [_field(k.lower().replace(" ", "_"), k) for k in SIMPLE]
    return _run(spark, d, {"entities": [{"name": "E", "fields": fields}]}, E="customer")["E"].flat()


def _drawn(spark, d, name, count):
    n = table(spark, d, name).count()
    return spark.range(n).select("id", R.row_draws(SEED, F.col("id"), count).alias("us"))


def weighted_all(spark, d):
    """A value of every weighted pool for every customer."""
    u = R.from_array(F.col("us"))
    return _drawn(spark, d, "customer", len(P.WEIGHTED)).select("id", *[R.weighted(u(i), x).alias(k) for i, (k, x) in enumerate(P.WEIGHTED.items())])


GEO = ("country", "countryCode", "city", "postal", "place")
INTL = ("fullName", "city", "streetAddress", "zipCode", "phone", "place")


def geo_place(spark, d):
    """All methods of all regions for every supplier."""
    made, u = M.catalog(), R.from_array(F.col("us"))
    return _drawn(spark, d, "supplier", 12).select("id", *[made[f"geo{r}.{k}"](u).alias(f"{r}_{k}") for r in P.REGIONS for k in GEO])


def intl_place(spark, d):
    """All methods of all locales for every supplier."""
    made, u = M.catalog(), R.from_array(F.col("us"))
    return _drawn(spark, d, "supplier", 60).select("id", *[made[f"intl{x}.{k}"](u).alias(f"{x}_{k}") for x in P.LOCALES for k in INTL])


IDENT = ("ssn", "ein", "npi", "abaRouting", "isin", "gtin13", "upc12", "vin", "nhsNumber", "sinCanada")


def ident_all(spark, d):
    """All identifiers with check digits for every customer."""
    made, u = M.catalog(), R.from_array(F.col("us"))
    return _drawn(spark, d, "customer", 20).select("id", *[made[f"ident.{k}"](u).alias(k) for k in IDENT])


FLAT = {"language": ("Name", "Alpha2", "Alpha3"), "airport": ("Name", "Iata"), "airline": ("Name", "Iata"), "airplane": ("Name", "Iata"), "currency": ("Name", "Code", "Symbol", "Numeric"), "element": ("Name", "Symbol", "AtomicNumber"), "unit": ("Name", "Symbol")}
LISTS = {"language": P.LANGUAGES, "airport": P.AIRPORTS, "airline": P.AIRLINES, "airplane": P.AIRPLANES, "currency": P.CURRENCIES, "element": P.ELEMENTS, "unit": P.UNITS}


def unwrap_all(spark, d):
    """All flat accessors for every customer."""
    made, u = M.catalog(), R.from_array(F.col("us"))
    names = [f"{k}{f}" for k, fields in FLAT.items() for f in fields] + ["colorHsl", "colorHwb", "colorCmyk"]
    return _drawn(spark, d, "customer", 4).select("id", *[made[f"unwrap.{k}"](u).alias(k) for k in names])


DAMAGES = [("mail", "email", D.LIGHT), ("mail", "email", D.MEDIUM), ("phone", "phone", D.MEDIUM), ("born", "date", D.MEDIUM), ("born", "date", D.HEAVY), ("zip", "digits", D.MEDIUM), ("name", "string", D.LIGHT), ("name", "string", D.MEDIUM), ("name", "string", D.HEAVY), ("n", "number", D.HEAVY)]


def dup_damage_kinds(spark, d):
    """Every kind of field at every level that damages it, for every customer."""
    k = F.col("c_custkey")
    text = lambda x: x.cast("string")
    own = table(spark, d, "customer").select(
        k.alias("id"),
        R.row_draws(SEED, k, 6).alias("us"),
        F.when(k % 7 == 0, F.lit("no at sign")).otherwise(F.concat(F.lit("Ann.B."), text(k), F.lit("@Mail.example.com"))).alias("mail"),
        F.when(k % 5 == 0, F.lit("12-345")).otherwise(F.concat(F.lit("+1 ("), text(k % 700 + 200), F.lit(") 555-"), F.lpad(text(k % 10000), 4, "0"))).alias("phone"),
        F.when(k % 6 == 0, F.lit("1/2/2003")).otherwise(F.concat(F.date_format(F.date_add(F.lit("1960-01-01").cast("date"), (k % 20000).cast("int")), "yyyy-MM-dd"), F.when(k % 4 == 0, F.lit("T10:00")).otherwise(F.lit("")))).alias("born"),
        F.lpad(text(k * 37 % 100000), 5, "0").alias("zip"),
        F.when(k % 11 == 0, F.lit("")).when(k % 13 == 0, F.lit("Q")).otherwise(F.col("c_name")).alias("name"),
        (k % 50).alias("n"),
    )
    u = R.from_array(F.col("us"))
    return own.select("id", *[D.damage(kind, level, F.col(c), u).alias(f"{kind}_{level}") for c, kind, level in DAMAGES])


QUERIES = {f.__name__: f for f in (gen_simple_kinds, weighted_all, geo_place, intl_place, ident_all, unwrap_all, dup_damage_kinds)}


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _pick(values: list[str], u: str) -> str:
    return f"[{', '.join(map(_quoted, values))}][CAST(floor({u} * {len(values)}) AS INT) + 1]"


def _int(u: str, lo: int, hi: int) -> str:
    return f"CAST(floor({u} * {hi - lo + 1}) + {lo} AS BIGINT)"


def _rows(name: str, count: int) -> str:
    return f"rows AS (SELECT i AS r FROM range((SELECT count(*) FROM {name})) x(i)), d AS (SELECT r, [{', '.join(draw(f'r * {count} + {i + 1}') for i in range(count))}] AS us FROM rows)"


def _u(i: int) -> str:
    return f"us[{i + 1}]"


def _char(u: str, alphabet: str) -> str:
    return f"substr('{alphabet}', CAST(floor({u} * {len(alphabet)}) AS INT) + 1, 1)"


def _shape(start: int, shape: str, letters: bool = True) -> str:
    """The text of a shape in SQL; British codes begin with one or two letters and a number."""
    if letters and shape == "UK":
        return f"substr({_shape(start, 'AA')}, 1, {_int(_u(start + 2), 1, 2)}) || {_int(_u(start + 3), 1, 99)} || ' ' || {_shape(start + 4, '9AA')}"
    parts = [_char(_u(start + i), M.DIGITS) if c == "9" else _char(_u(start + i), M.LETTERS) if letters and c == "A" else _quoted(c) for i, c in enumerate(shape)]
    return "(" + (" || ".join(parts) or "''") + ")"


def _weighted(pairs, u: str) -> str:
    run, cases = 0.0, []
    for value, w in pairs[:-1]:
        run += w
        cases.append(f"WHEN {u} < {run / float(sum(w for _, w in pairs))!r}::DOUBLE THEN {_quoted(value)}")
    return f"CASE {' '.join(cases)} ELSE {_quoted(pairs[-1][0])} END"


def _simple_sql() -> str:
    u = {k: i for i, k in enumerate(["last", "mail_first", "mail_last", "street_no", "street", "city", "state", "abbr", "zip", "country", "company", "job"])}
    at = lambda k: _u(u[k])
    return f"""WITH {_rows('customer', 12)} SELECT r + 1 AS n, 'same' AS fixed, {_pick(P.LAST, at('last'))} AS last_name,
        lower({_pick(P.FIRST, at('mail_first'))}) || '.' || lower({_pick(P.LAST, at('mail_last'))}) || '@example.com' AS email,
        {_int(at('street_no'), 10, 9999)} || ' ' || {_pick(P.STREET, at('street'))} AS street_address, {_pick(P.CITY, at('city'))} AS city, {_pick(P.STATE, at('state'))} AS state,
        {_pick(P.STATE_ABBR, at('abbr'))} AS state_abbr, CAST({_int(at('zip'), 10000, 99999)} AS VARCHAR) AS zip_code, {_pick(P.COUNTRY, at('country'))} AS country,
        {_pick(P.COMPANY, at('company'))} AS company, {_pick(P.JOB, at('job'))} AS job_title FROM d"""


def _json(**values: str) -> str:
    return "'{' || " + " || ',' || ".join(f"""'"{k}":"' || {v} || '"'""" for k, v in values.items()) + " || '}'"


def _geo_sql() -> str:
    columns = []
    for region, rows in P.REGIONS.items():
        one = lambda values, n=len(rows): f"[{', '.join(values)}][CAST(floor({_u(0)} * {n}) AS INT) + 1]"
        made = {
            "country": one([_quoted(x[0]) for x in rows]),
            "countryCode": one([_quoted(x[1]) for x in rows]),
            "city": one([_pick(x[2], _u(1)) for x in rows]),
            "postal": one([_shape(2, x[3]) for x in rows]),
        }
        made["place"] = _json(**made)
        columns += [f"{v} AS \"{region}_{k}\"" for k, v in made.items()]
    return f"WITH {_rows('supplier', 12)} SELECT r AS id, {', '.join(columns)} FROM d"


def _intl_sql() -> str:
    columns = []
    for name, (country, firsts, lasts, cities, street, postal, phone) in P.LOCALES.items():
        made = {
            "fullName": f"{_pick(firsts, _u(0))} || ' ' || {_pick(lasts, _u(1))}",
            "city": _pick(cities, _u(2)),
            "streetAddress": _shape(3, street, False),
            "zipCode": _shape(24, postal),
            "phone": _shape(36, phone, False),
        }
        made["place"] = _json(country=_quoted(country), name=made["fullName"], street=made["streetAddress"], city=made["city"], postal=made["zipCode"])
        columns += [f"{v} AS \"{name}_{k}\"" for k, v in made.items()]
    return f"WITH {_rows('supplier', 60)} SELECT r AS id, {', '.join(columns)} FROM d"


def _digits(start: int, n: int) -> str:
    return _shape(start, "9" * n)


def _turns(text: str, weights: list[int]) -> str:
    return "(" + " + ".join(f"CAST(substr({text}, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(weights)) + ")"


def _ident_sql() -> str:
    """Bodies first, then check digits: ISIN letters count as two digits, an NHS body without a check digit goes."""
    values = ", ".join(map(str, M.VIN_VALUES))
    spread = "array_to_string(list_transform(string_split(isin, ''), lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), '')"
    nhs = "(11 - list_sum(list_transform(range(1, 10), lambda i: CAST(substr(b, CAST(i AS INT), 1) AS INT) * (11 - i))) % 11) % 11"
    isin_check = """(10 - list_sum(list_transform(range(1, length(wide) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CASE WHEN CAST(substr(reverse(wide), CAST(i AS INT), 1) AS INT) * 2 > 9 THEN CAST(substr(reverse(wide), CAST(i AS INT), 1) AS INT) * 2 - 9
        ELSE CAST(substr(reverse(wide), CAST(i AS INT), 1) AS INT) * 2 END ELSE CAST(substr(reverse(wide), CAST(i AS INT), 1) AS INT) END)) % 10) % 10"""
    return f"""WITH {_rows('customer', 20)},
      b AS (SELECT r, us, {_pick(['1', '2'], _u(0))} || {_digits(1, 8)} AS npi, {_digits(0, 8)} AS aba, {_digits(0, 12)} AS g, {_digits(0, 11)} AS u,
          {_pick(P.ISIN_COUNTRIES, _u(0))} || {' || '.join(_char(_u(1 + i), M.LETTERS + M.DIGITS) for i in range(9))} AS isin,
          [{', '.join(f'CAST(floor({_u(i)} * {len(M.VIN_ALPHABET)}) AS INT) + 1' for i in range(17))}] AS vin,
          list_filter(list_transform(us, lambda x: lpad(CAST(CAST(floor(x * 1e9::DOUBLE) AS BIGINT) AS VARCHAR), 9, '0')), lambda b: {nhs} <> 10) AS nhs,
          {_int(_u(0), 1, 9)} || {_digits(1, 7)} AS sin FROM d),
      c AS (SELECT *, {spread} AS wide, list_sum(list_transform(list_zip(vin, {M.VIN_WEIGHTS}), lambda p: [{values}][p[1]] * p[2])) % 11 AS v, sin || {_luhn_sql('sin', 8)} AS s9 FROM b)
      SELECT r AS id, lpad(CAST(CASE WHEN {_int(_u(0), 1, 899)} = 666 THEN 667 ELSE {_int(_u(0), 1, 899)} END AS VARCHAR), 3, '0') || '-' || lpad(CAST({_int(_u(1), 1, 99)} AS VARCHAR), 2, '0') || '-' || lpad(CAST({_int(_u(2), 1, 9999)} AS VARCHAR), 4, '0') AS ssn,
        {_pick(M.EIN, _u(0))} || {_digits(1, 7)} AS ein, npi || {_luhn_sql("('80840' || npi)", 14)} AS npi,
        aba || CAST((10 - {_turns('aba', [3, 7, 1, 3, 7, 1, 3, 7])} % 10) % 10 AS VARCHAR) AS "abaRouting",
        isin || CAST({isin_check} AS VARCHAR) AS isin,
        g || CAST((10 - {_turns('g', [1, 3] * 6)} % 10) % 10 AS VARCHAR) AS gtin13, u || CAST((10 - {_turns('u', [3, 1] * 5 + [3])} % 10) % 10 AS VARCHAR) AS upc12,
        array_to_string(list_transform(range(1, 18), lambda i: CASE WHEN i = 9 THEN CASE WHEN v = 10 THEN 'X' ELSE CAST(v AS VARCHAR) END ELSE substr('{M.VIN_ALPHABET}', vin[i], 1) END), '') AS vin,
        CASE WHEN len(nhs) = 0 THEN '400 000 0004' ELSE substr(nhs[1], 1, 3) || ' ' || substr(nhs[1], 4, 3) || ' ' || substr(nhs[1], 7, 3) || CAST(list_transform([nhs[1]], lambda b: {nhs})[1] AS VARCHAR) END AS "nhsNumber",
        substr(s9, 1, 3) || ' ' || substr(s9, 4, 3) || ' ' || substr(s9, 7, 3) AS "sinCanada" FROM c"""


def _unwrap_sql() -> str:
    percent = lambda i: f"{_int(_u(i), 0, 100)} || '%'"
    columns = [f"{_pick([x[i] for x in LISTS[k]], _u(0))} AS \"{k}{f}\"" for k, fields in FLAT.items() for i, f in enumerate(fields)]
    columns.append(f"'hsl(' || {_int(_u(0), 0, 360)} || ', ' || {percent(1)} || ', ' || {percent(2)} || ')' AS \"colorHsl\"")
    columns.append(f"'hwb(' || {_int(_u(0), 0, 360)} || ' ' || {percent(1)} || ' ' || {percent(2)} || ')' AS \"colorHwb\"")
    columns.append(f"'cmyk(' || {percent(0)} || ', ' || {percent(1)} || ', ' || {percent(2)} || ', ' || {percent(3)} || ')' AS \"colorCmyk\"")
    return f"WITH {_rows('customer', 4)} SELECT r AS id, {', '.join(columns)} FROM d"


def _place(u: str, n: str) -> str:
    return f"CAST(floor({u} * ({n})) + 1 AS INT)"


def _typo(s: str, k: int) -> str:
    i = _place(_u(k), f"greatest(1, length({s}) - 1)")
    return f"""CASE WHEN length({s}) < 2 THEN {s} || {s} WHEN floor({_u(k + 1)} * 3) = 0 THEN substr({s}, 1, {i} - 1) || substr({s}, {i} + 1, 1) || substr({s}, {i}, 1) || substr({s}, {i} + 2)
      WHEN floor({_u(k + 1)} * 3) = 1 THEN substr({s}, 1, {i} - 1) || substr({s}, {i} + 1) ELSE substr({s}, 1, {i}) || substr({s}, {i}) END"""


def _flip(s: str) -> str:
    return f"CASE WHEN floor({_u(0)} * 3) = 0 THEN upper({s}) WHEN floor({_u(0)} * 3) = 1 THEN lower({s}) ELSE lower(substr({s}, 1, 1)) || substr({s}, 2) END"


def _spaced(s: str) -> str:
    i = _place(_u(0), f"length({s})")
    return f"CASE WHEN {_u(1)} < 0.5 THEN substr({s}, 1, {i} - 1) || '  ' || substr({s}, {i}) ELSE {s} || ' ' END"


def _swap(s: str, k: int) -> str:
    places = f"list_filter(range(1, length({s}) + 1), lambda p: regexp_matches(substr({s}, CAST(p AS INT), 1), '[0-9]'))"
    i = f"CAST({places}[{_place(_u(k), f'len({places})')}] AS INT)"
    return f"CASE WHEN len({places}) = 0 THEN {s} ELSE substr({s}, 1, {i} - 1) || CAST((CAST(substr({s}, {i}, 1) AS INT) + {_int(_u(k + 1), 1, 9)}) % 10 AS VARCHAR) || substr({s}, {i} + 1) END"


def _damage_sql() -> str:
    iso = r"regexp_matches(born, '^\d{4}-\d{2}-\d{2}')"
    moved = f"CASE WHEN {iso} THEN strftime(CAST(substr(born, 1, 10) AS DATE) + CASE WHEN {_u(0)} < 0.5 THEN -1 ELSE 1 END, '%Y-%m-%d') || substr(born, 11) ELSE {_swap('born', 1)} END"
    swapped = f"CASE WHEN {iso} AND CAST(substr(born, 9, 2) AS INT) <= 12 AND substr(born, 6, 2) <> substr(born, 9, 2) AND {_u(3)} < 0.5 THEN substr(born, 1, 5) || substr(born, 9, 2) || '-' || substr(born, 6, 2) || substr(born, 11) ELSE {moved} END"
    op = f"floor({_u(0)} * 3)"
    level = lambda n: f"floor({_u(4)} * {n})"
    kept = lambda c, x: f"CASE WHEN {c} = '' THEN {c} ELSE {x} END"
    return f"""WITH c AS (SELECT c_custkey AS id, [{', '.join(draw(f'c_custkey * 6 + {i + 1}') for i in range(6))}] AS us,
        CASE WHEN c_custkey % 7 = 0 THEN 'no at sign' ELSE 'Ann.B.' || c_custkey || '@Mail.example.com' END AS mail,
        CASE WHEN c_custkey % 5 = 0 THEN '12-345' ELSE '+1 (' || (c_custkey % 700 + 200) || ') 555-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') END AS phone,
        CASE WHEN c_custkey % 6 = 0 THEN '1/2/2003' ELSE strftime(DATE '1960-01-01' + CAST(c_custkey % 20000 AS INT), '%Y-%m-%d') || CASE WHEN c_custkey % 4 = 0 THEN 'T10:00' ELSE '' END END AS born,
        lpad(CAST(c_custkey * 37 % 100000 AS VARCHAR), 5, '0') AS zip, CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN 'Q' ELSE c_name END AS name, c_custkey % 50 AS n FROM customer),
      p AS (SELECT *, regexp_replace(phone, '[^0-9]', '', 'g') AS dg, split_part(mail, '@', 1) AS local, instr(mail, '@') AS sign, {_typo('name', 0)} AS once FROM c),
      t AS (SELECT *, right(dg, 10) AS t FROM p)
      SELECT id, {_flip('mail')} AS email_light,
        CASE WHEN sign <= 1 THEN {_typo('mail', 1)} WHEN {op} = 0 THEN replace(local, '.', '') || substr(mail, sign) WHEN {op} = 1 THEN ({_typo('local', 1)}) || substr(mail, sign) ELSE lower(mail) END AS email_medium,
        CASE WHEN length(dg) < 7 THEN {_swap('phone', 1)} WHEN {op} = 0 THEN dg WHEN {op} = 1 THEN substr(t, 1, 3) || '-' || substr(t, 4, 3) || '-' || substr(t, 7) ELSE '(' || substr(t, 1, 3) || ') ' || substr(t, 4, 3) || '-' || substr(t, 7) END AS phone_medium,
        {moved} AS date_medium, {swapped} AS date_heavy, {_swap('zip', 0)} AS digits_medium,
        {kept('name', f"CASE WHEN {_u(4)} < 0.5 THEN {_flip('name')} ELSE {_spaced('name')} END")} AS string_light,
        {kept('name', f"CASE WHEN {level(3)} = 0 THEN {_typo('name', 0)} WHEN {level(3)} = 1 THEN {_flip('name')} ELSE {_spaced('name')} END")} AS string_medium,
        {kept('name', f"CASE WHEN {level(4)} = 0 THEN {_typo('once', 2)} WHEN {level(4)} = 1 THEN once WHEN {level(4)} = 2 THEN '' ELSE {_flip('name')} END")} AS string_heavy,
        n + {_int(_u(0), -1, 1)} AS number_heavy FROM t"""


ORACLES = {
    "gen_simple_kinds": _simple_sql(),
    "weighted_all": f"WITH {_rows('customer', len(P.WEIGHTED))} SELECT r AS id, " + ", ".join(f'{_weighted(x, _u(i))} AS "{k}"' for i, (k, x) in enumerate(P.WEIGHTED.items())) + " FROM d",
    "geo_place": _geo_sql(),
    "intl_place": _intl_sql(),
    "ident_all": _ident_sql(),
    "unwrap_all": _unwrap_sql(),
    "dup_damage_kinds": _damage_sql(),
}

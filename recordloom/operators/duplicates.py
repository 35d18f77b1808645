"""Duplicate injection: fuzzed variants that share a ground-truth key with their original.

Every record gets a key; a share of them get one to ``dup_max`` variants, each damaged in some fields according to the
entity's level. Variants are rows of one explode, damages are expressions with the variant's own draws, and the output
order is that of a seeded hash, so the result is the same on any partitioning. Damage towards a target similarity is
a search and runs as an Arrow UDF with its own seeded stream.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rng as R
from ..functions.modules import padded, uuid
from ..functions.similarity import jaro_winkler_value
from .generate import IX, VARIANT, dense_index
from .schema import Entity, Field

LIGHT, MEDIUM, HEAVY, TARGETED = "light", "medium", "heavy", "targeted"


def kind_of(f: Field) -> str:
    """How a field is damaged."""
    method = f.opts.get("method", "").lower() if f.type == "Faker (any)" else ""
    if f.type == "Formula (JS)":
        return "formula"
    if f.type == "Email" or "email" in method:
        return "email"
    if f.type == "Phone" or "phone" in method:
        return "phone"
    if f.type in ("Row Number", "Boolean", "Static Value", "Reference"):
        return "keep"
    return {"Date": "date", "Number": "number", "Zip Code": "digits", "UUID": "uuid"}.get(f.type, "string")


#: What a level can do to each kind of field, for those who write rules.
NOTES = {
    "email": {LIGHT: "case changes"},
    "phone": {},
    "date": {LIGHT: "unchanged", HEAVY: "a day off, or month and day swapped"},
    "digits": {LIGHT: "unchanged"},
    "number": {LIGHT: "unchanged", MEDIUM: "unchanged", HEAVY: "one off"},
    "string": {LIGHT: "case or spacing", MEDIUM: "a typo, case or spacing", HEAVY: "typos, case, or blanked"},
}
USUAL = {"email": "dots dropped, a typo or lower case", "phone": "reformatted", "date": "a day off", "digits": "one digit changed"}


def variant_note(f: Field, level: str) -> str:
    """What variants show in a field at a level."""
    kind = kind_of(f)
    if level == "off" or f.keep or kind == "keep":
        return "unchanged in variants"
    if kind == "uuid":
        return "new in every variant"
    if kind == "formula":
        return "computed again from the variant's fields"
    if level == TARGETED:
        return f"fuzzed to {f.sim[0]} similarity {f.sim[1]:g}" if f.sim else "unchanged in variants"
    return NOTES[kind].get(level, USUAL.get(kind, ""))


def _at(u: Column, n: Column) -> Column:
    """A position from 1 to n."""
    return (F.floor(u * n) + 1).cast("int")


def _cut(s: Column, start: Column | int, n: Column | int | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.substring(s, lit(start), F.length(s) if n is None else lit(n))


def typo(s: Column, u: R.Draws, k: int = 0) -> Column:
    """Swap two neighbours, drop a character or double one."""
    i, op = _at(u(k), F.greatest(F.lit(1), F.length(s) - 1)), F.floor(u(k + 1) * 3)
    head, c, rest = _cut(s, 1, i - 1), _cut(s, i, 1), _cut(s, i + 1)
    swapped = F.concat(head, _cut(rest, 1, 1), c, _cut(rest, 2))
    return F.when(F.length(s) < 2, F.concat(s, s)).when(op == 0, swapped).when(op == 1, F.concat(head, rest)).otherwise(F.concat(head, c, c, rest))


def flip_case(s: Column, u: R.Draws, k: int = 0) -> Column:
    op = F.floor(u(k) * 3)
    return F.when(op == 0, F.upper(s)).when(op == 1, F.lower(s)).otherwise(F.concat(F.lower(_cut(s, 1, 1)), _cut(s, 2)))


def spacing(s: Column, u: R.Draws, k: int = 0) -> Column:
    i = _at(u(k), F.length(s))
    return F.when(u(k + 1) < 0.5, F.concat(_cut(s, 1, i - 1), F.lit("  "), _cut(s, i))).otherwise(F.concat(s, F.lit(" ")))


def digit_swap(s: Column, u: R.Draws, k: int = 0) -> Column:
    """Another digit in the place of one."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(s))), lambda i: _cut(s, i, 1).rlike("[0-9]"))
    i = F.try_element_at(places, _at(u(k), F.size(places)))
    new = ((_cut(s, i, 1).cast("int") + R.integer(u(k + 1), 1, 9)) % 10).cast("string")
    return F.when(F.size(places) == 0, s).otherwise(F.concat(_cut(s, 1, i - 1), new, _cut(s, i + 1)))


def phone_format(s: Column, u: R.Draws) -> Column:
    d = F.regexp_replace(s, "[^0-9]", "")
    t = F.right(d, F.lit(10))
    op = F.floor(u(0) * 3)
    dashes = F.concat_ws("-", _cut(t, 1, 3), _cut(t, 4, 3), _cut(t, 7))
    parens = F.concat(F.lit("("), _cut(t, 1, 3), F.lit(") "), _cut(t, 4, 3), F.lit("-"), _cut(t, 7))
    return F.when(F.length(d) < 7, digit_swap(s, u, 1)).when(op == 0, d).when(op == 1, dashes).otherwise(parens)


def date_shift(s: Column, u: R.Draws, swap: bool) -> Column:
    """A day earlier or later; if allowed, month and day change places."""
    day = F.substring(s, 1, 10).try_cast("date")
    moved = F.concat(F.date_format(F.date_add(day, F.when(u(0) < 0.5, F.lit(-1)).otherwise(F.lit(1))), "yyyy-MM-dd"), _cut(s, 11))
    out = F.coalesce(moved, digit_swap(s, u, 1))
    if swap:
        m, d = F.substring(s, 6, 2), F.substring(s, 9, 2)
        can = s.rlike(r"^\d{4}-\d{2}-\d{2}") & (d.try_cast("int") <= 12) & (m != d) & (u(3) < 0.5)
        out = F.when(can, F.concat(F.substring(s, 1, 5), d, F.lit("-"), m, _cut(s, 11))).otherwise(out)
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), out).otherwise(digit_swap(s, u, 1))


def email_fuzz(s: Column, u: R.Draws) -> Column:
    at = F.instr(s, "@")
    op, local, rest = F.floor(u(0) * 3), _cut(s, 1, at - 1), _cut(s, at)
    fuzzed = F.when(op == 0, F.concat(F.replace(local, F.lit(".")), rest)).when(op == 1, F.concat(typo(local, u, 1), rest)).otherwise(F.lower(s))
    return F.when(at <= 1, typo(s, u, 1)).otherwise(fuzzed)


def damage(kind: str, level: str, v: Column, u: R.Draws) -> Column:
    """A damaged value; blanks stay."""
    if kind == "number":
        return v + R.integer(u(0), -1, 1)
    s = v.cast("string")
    if kind == "email":
        out = flip_case(s, u) if level == LIGHT else email_fuzz(s, u)
    elif kind == "phone":
        out = phone_format(s, u)
    elif kind == "date":
        out = date_shift(s, u, level == HEAVY)
    elif kind == "digits":
        out = digit_swap(s, u)
    elif level == LIGHT:
        out = F.when(u(4) < 0.5, flip_case(s, u)).otherwise(spacing(s, u))
    elif level == MEDIUM:
        op = F.floor(u(4) * 3)
        out = F.when(op == 0, typo(s, u)).when(op == 1, flip_case(s, u)).otherwise(spacing(s, u))
    else:
        op = F.floor(u(4) * 4)
        out = F.when(op == 0, typo(typo(s, u), u, 2)).when(op == 1, typo(s, u)).when(op == 2, F.lit("")).otherwise(flip_case(s, u))
    return F.when(s.isNull() | (s == ""), s).otherwise(out)


def _levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        row = out
    return row[-1]


def _similarity(algo: str, a: str, b: str) -> float:
    return jaro_winkler_value(a, b) if algo == "jw" else 1 - _levenshtein(a, b) / max(len(a), len(b), 1)


#: How near is near enough, and the target from which a text stays as it is.
TOLERANCE, SAME = 0.02, 0.995
#: Plans that are drawn for a text at most.
PLANS = 24
_NUMERIC = set("0123456789 \t().,+-")


def _plan(text: str, draw) -> list[tuple[int, str, str]]:
    """Edits at places of a text, one a place and some behind its end, in a random order."""
    pool = "0123456789" if set(text) <= _NUMERIC else "abcdefghijklmnopqrstuvwxyz"
    edits = []
    for i in range(len(text) + max(1, len(text) // 3)):
        kind = "insert" if i >= len(text) else ("change", "change", "drop", "insert", "swap")[int(draw() * 5)]
        letter = pool[int(draw() * len(pool))]
        if i < len(text) and letter == text[i].lower():
            letter = pool[(pool.index(letter) + 1) % len(pool)]
        edits.append((draw(), i, kind, letter))
    return [e[1:] for e in sorted(edits)]


def _edited(text: str, edits: list[tuple[int, str, str]]) -> str:
    out, at = list(text) + [""], dict((i, (kind, letter)) for i, kind, letter in edits if i < len(text))
    for i, (kind, letter) in at.items():
        if kind == "swap" and i + 1 < len(text) and i + 1 not in at:
            out[i], out[i + 1] = out[i + 1], out[i]
        else:
            out[i] = {"drop": "", "insert": letter + out[i]}.get(kind, letter)
    return "".join(out) + "".join(letter for i, _, letter in edits if i >= len(text))


def corrupt_to_target(text: str, algo: str, target: float, draw) -> str:
    """A text whose similarity to the given one is the target within ``TOLERANCE``, else the nearest one met.

    The more edits of a plan are made, the less similar the text: how many it takes is found by bisection. A plan
    that jumps over the target is followed by another one.
    """
    if not text or target >= SAME:
        return text
    best, gap = text, 1 - target
    for _ in range(PLANS):
        plan = _plan(text, draw)
        few, many = 0, len(plan)
        while few < many and gap > TOLERANCE:
            made = (few + many) // 2 if few else max(1, min(many, round((1 - target) * len(text))))
            found = _edited(text, plan[:made])
            near = _similarity(algo, text, found)
            if abs(near - target) < gap:
                best, gap = found, abs(near - target)
            few, many = (made + 1, many) if near > target else (few, made - 1)
        if gap <= TOLERANCE:
            break
    return best


def _towards(algo: str, target: float):
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else corrupt_to_target(t, algo, target, R.mulberry32(int(k) ^ int(k) >> 32)) for t, k in zip(texts, keys)], dtype=object)

    return run


def _fresh(v: Column, key, repeated: bool) -> Column:
    """New identifiers: a variant is a record of its own."""
    own = lambda j: uuid(R.cell_stream(key(j), 31))
    return F.transform(v, lambda x, j: own(j)) if repeated else own(F.lit(0))


def _one_damaged(v: Column, kind: str, level: str, u: R.Draws) -> Column:
    """A list with one of its elements damaged."""
    place = _at(u(5), F.size(v)) - 1
    return F.transform(v, lambda x, j: F.when(j == place, damage(kind, level, x, u)).otherwise(x if kind == "number" else x.cast("string")))


def _variant(rows: DataFrame, e: Entity, seed: int) -> DataFrame:
    """Damage the variants: a column of choices first, then every field once."""
    level = e.dup_level
    key = lambda *what: R.cell_key(seed, e.name, "variant", F.col(IX), F.col(VARIANT), *what)
    columns = {}
    for f in e.fields:
        if kind_of(f) == "uuid" and not f.keep:
            columns[f.name] = _fresh(F.col(f"`{f.name}`"), lambda j, n=f.name: key(n, j), f.repeat is not None)
    if level == TARGETED:
        for f in e.fields:
            if f.keep or not f.sim or kind_of(f) in ("keep", "uuid", "formula"):
                continue
            udf, v = _towards(f.sim[0], min(max(f.sim[1], 0.5), 1.0)), F.col(f"`{f.name}`")
            if f.repeat:
                # Elements keep their places: the texts of all places are damaged one place at a time.
                most = f.repeat[1][1]
                made = F.array(*[F.when(F.size(v) > j, udf(F.get(v, F.lit(j)).cast("string"), key(f.name, j))) for j in range(most)])
                columns[f.name] = F.slice(made, F.lit(1), F.size(v)) if most else v
            else:
                made = udf(v.cast("string"), key(f.name))
                columns[f.name] = F.coalesce(made.try_cast("double"), v.cast("double")) if kind_of(f) == "number" else F.when(v.cast("string") == "", v.cast("string")).otherwise(made)
        return rows.withColumns(columns)
    can = [f for f in e.fields if not f.keep and kind_of(f) not in ("keep", "uuid", "formula") and not (level != HEAVY and kind_of(f) == "number") and not (level == LIGHT and kind_of(f) in ("date", "digits"))]
    if not can:
        return rows.withColumns(columns) if columns else rows
    # Fields with a value, in the order of the variant's hash of them; the first few are damaged.
    filled = lambda f: (F.size(F.col(f"`{f.name}`")) > 0) if f.repeat else (F.col(f"`{f.name}`").isNotNull() & (F.col(f"`{f.name}`").cast("string") != ""))
    order = F.array_sort(F.array_compact(F.array(*[F.when(filled(f), F.struct(key("order", f.name).alias("h"), F.lit(f.name).alias("f"))) for f in can])))
    u = R.cell_stream(key("count"), 1)(0)
    n = F.lit(1) if level == LIGHT else R.integer(u, 1, 2) if level == MEDIUM else R.integer(u, 2, 3)
    # Choices and draws are columns before they are used: a damage uses its draws many times.
    helpers = {"__chosen": F.transform(F.slice(order, F.lit(1), n.cast("int")), lambda x: x["f"])}
    helpers |= {f"__draws_{i}": R.cell_draws(key("damage", f.name), 6) for i, f in enumerate(can)}
    rows = rows.withColumns(helpers)
    for i, f in enumerate(can):
        v, hit, draws = F.col(f"`{f.name}`"), F.array_contains("__chosen", f.name), R.from_array(F.col(f"__draws_{i}"))
        if f.repeat:
            columns[f.name] = F.when(hit, _one_damaged(v, kind_of(f), level, draws)).otherwise(v)
        else:
            columns[f.name] = F.when(hit, damage(kind_of(f), level, v, draws)).otherwise(v)
    return rows.withColumns(columns).drop(*helpers)


def inject(rows: DataFrame, e: Entity, seed: int, match_field: str) -> DataFrame:
    """Originals and variants with ``match_field``, ``__original`` (index of the original) and a new output order."""
    own = rows.withColumn(match_field, F.concat(F.lit("M"), padded(F.col(IX) + 1, 5))).withColumn("__original", F.col(IX))
    u = R.cell_stream(R.cell_key(seed, e.name, "duplicates", F.col(IX)), 2)
    many = F.when(u(0) * 100 < e.dup_pct, R.integer(u(1), 1, e.dup_max)).otherwise(F.lit(0)).cast("int")
    variants = own.withColumn(VARIANT, F.explode(F.when(many > 0, F.sequence(F.lit(1), many))))
    every = own.withColumn(VARIANT, F.lit(0)).unionByName(_variant(variants, e, seed))
    shuffle = F.xxhash64(F.lit(seed), F.lit(e.name), F.lit("shuffle"), F.col("__original"), F.col(VARIANT))
    return dense_index(every.drop(IX), shuffle, F.col("__original"), F.col(VARIANT), name=IX)

"""Schema documents: entities, fields, nested names, validation and row counts. All of it runs on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from ..functions.modules import catalog
from .rules import Invalid

#: The limits of a document, the built-in types with the defaults of their options.
LIMITS = {"entities": 10, "fields": 200, "expression": 2_000}
TYPES: dict[str, dict[str, str]] = {
    "Row Number": {}, "First Name": {}, "Last Name": {}, "Full Name": {}, "Email": {}, "Phone": {}, "Street Address": {}, "City": {}, "State": {}, "State Abbr": {}, "Zip Code": {},
    "Country": {}, "Company": {}, "Job Title": {}, "Faker (any)": {"method": "company.name"}, "UUID": {}, "Boolean": {}, "Number": {"min": "1", "max": "100", "decimals": "0"},
    "Date": {"from": "2024-01-01", "to": "2026-08-27", "dateFormat": "YYYY-MM-DD"}, "Custom List": {"values": "red, green, blue"}, "Static Value": {"value": "fixed"},
    "Lorem Words": {"count": "3"}, "Reference": {"entity": "", "field": "", "unique": ""}, "Formula (JS)": {"expr": "normalize(field('name') + field('nick'))"},
}
LEVELS = ("light", "medium", "heavy", "targeted")


@dataclass(frozen=True)
class Segment:
    key: str
    attr: bool = False
    repeat: tuple[int, int] | None = None


def parse_name(name: str) -> list[Segment]:
    """Segments of a dotted name: ``@`` marks an attribute, ``[n]`` or ``[a-b]`` a repeat (bounds in any order)."""
    out = []
    for raw in name.strip().split("."):
        found = re.search(r"\[(\d+)(?:-(\d+))?\]$", raw)
        repeat = None
        if found:
            lo, hi = int(found[1]), int(found[2] or found[1])
            repeat = (min(lo, hi), max(lo, hi))
            raw = raw[: found.start()]
        out.append(Segment(raw.removeprefix("@"), raw.startswith("@"), repeat))
    return out


def repeat_prefix(segments: list[Segment]) -> tuple[str, tuple[int, int]] | None:
    """Path and bounds of the first repeating segment."""
    for i, s in enumerate(segments):
        if s.repeat:
            return ".".join(x.key for x in segments[: i + 1]), s.repeat
    return None


@dataclass
class Field:
    name: str
    type: str
    opts: dict[str, str] = field(default_factory=dict)
    sim: tuple[str, float] | None = None
    keep: bool = False

    def __post_init__(self):
        self.name = self.name.strip()
        self.opts = {**TYPES.get(self.type, {}), **{k: str(v) for k, v in self.opts.items()}}

    @property
    def segments(self) -> list[Segment]:
        return parse_name(self.name)

    @property
    def repeat(self):
        return repeat_prefix(self.segments)


@dataclass
class Entity:
    name: str
    fields: list[Field]
    rows: int = 100
    root: str = "records"
    record: str = "record"
    dup_level: str = "off"
    dup_pct: int = 20
    dup_max: int = 2


def whole(value: Any, default: int) -> int:
    found = re.match(r"\s*[+-]?\d+", str(value if value is not None else ""))
    return int(found[0]) if found else default


def _element(value: Any, default: str) -> str:
    return value if isinstance(value, str) and re.fullmatch(r"[A-Za-z_][\w.-]*", value) else default


def read_schema(doc: Any, max_rows: int | None = None) -> list[Entity]:
    """Entities of a schema document; a bare list of fields is one entity. ``Invalid`` names the part at fault."""
    if isinstance(doc, list):
        doc = {"fields": doc}
    if not isinstance(doc, dict):
        raise Invalid("a schema is a JSON object")
    if not isinstance(doc.get("entities"), list):
        if not isinstance(doc.get("fields"), list):
            raise Invalid("a schema needs a list of entities", "entities")
        doc = {"entities": [{k: v for k, v in doc.items()} | {"name": "Records"}]}
    if not 1 <= len(doc["entities"]) <= LIMITS["entities"]:
        raise Invalid(f"a schema has 1 to {LIMITS['entities']} entities", "entities")
    out: list[Entity] = []
    known = set(catalog())
    for i, raw in enumerate(doc["entities"]):
        at = f"entities[{i}]"
        name = str(raw.get("name") or "").strip() if isinstance(raw, dict) else ""
        if not name:
            raise Invalid("an entity needs a name", f"{at}.name")
        if any(e.name == name for e in out):
            raise Invalid(f'the entity name "{name}" is there twice', f"{at}.name")
        given = raw.get("fields")
        if not isinstance(given, list) or not 1 <= len(given) <= LIMITS["fields"]:
            raise Invalid(f'"{name}" needs 1 to {LIMITS["fields"]} fields', f"{at}.fields")
        fields = [_field(f, f"{at}.fields[{j}]", out, known, name) for j, f in enumerate(given)]
        if len({f.name for f in fields}) < len(fields):
            raise Invalid(f'"{name}" has two fields of one name', f"{at}.fields")
        rows = max(1, whole(raw.get("rows"), 100))
        level = raw.get("dupLevel") if raw.get("dupLevel") in LEVELS else "off"
        # A share of 0 means the default, as a variant count of 0 does; at most 5 variants a record.
        pct, most = min(max(whole(raw.get("dupPct"), 20) or 20, 1), 100), min(max(whole(raw.get("dupMax"), 2) or 2, 1), 5)
        out.append(Entity(name, fields, min(rows, max_rows) if max_rows else rows, _element(raw.get("root"), "records"), _element(raw.get("record"), "record"), level, pct, most))
    return out


def _field(raw: Any, at: str, before: list[Entity], known: set[str], entity: str) -> Field:
    if not isinstance(raw, dict):
        raise Invalid("a field is an object", at)
    name, kind = str(raw.get("name") or "").strip(), str(raw.get("type") or "")
    if not name:
        raise Invalid("a field needs a name", f"{at}.name")
    if kind not in TYPES:
        raise Invalid(f'unknown type "{kind}" of "{name}"', f"{at}.type")
    opts = {k: str((raw.get("opts") or {}).get(k, d)) for k, d in TYPES[kind].items()}
    if kind == "Faker (any)" and opts["method"].strip() not in known:
        raise Invalid(f'"{name}": unknown method "{opts["method"]}"', f"{at}.opts.method")
    if kind == "Formula (JS)":
        from .formula import compile_formula

        if not opts["expr"].strip() or len(opts["expr"]) > LIMITS["expression"]:
            raise Invalid(f'"{name}" needs a formula of at most {LIMITS["expression"]} characters', f"{at}.opts.expr")
        try:
            compile_formula(opts["expr"])
        except Invalid as e:
            raise Invalid(f'"{name}": {e}', f"{at}.opts.expr") from e
    if kind == "Reference":
        source = next((e for e in before if e.name == opts["entity"].strip()), None)
        if source is None:
            raise Invalid(f'"{name}" refers to "{opts["entity"]}", which is no entity before "{entity}"', f"{at}.opts.entity")
        if opts["field"].strip() not in {f.name for f in source.fields}:
            raise Invalid(f'"{source.name}" has no field "{opts["field"]}"', f"{at}.opts.field")
    sim = raw.get("sim") or {}
    near = (sim["algo"], float(sim.get("target") or 0.9)) if sim.get("algo") in ("jw", "lev") else None
    return Field(name, kind, opts, near, raw.get("keep") in (True, "1", "true"))


def resolve_counts(entities: list[Entity], count: Any = None, max_rows: int | None = None) -> dict[str, int]:
    """Rows of each entity: a number for a single entity, or a map; entities left out keep their own."""
    own = {e.name: e.rows for e in entities}
    if count is None:
        return own
    if not isinstance(count, dict):
        if len(entities) > 1:
            raise Invalid(f"with several entities ({', '.join(own)}) the count must name each it is for", "count")
        count = {entities[0].name: count}
    if not count:
        raise Invalid("the count is empty", "count")
    for k, v in count.items():
        if k not in own:
            raise Invalid(f'the count names "{k}", which is no entity', "count")
        if isinstance(v, bool) or str(v).strip() != str(whole(v, -1)) or whole(v, -1) < 1 or (max_rows and whole(v, 1) > max_rows):
            raise Invalid(f"the count of {k} must be a whole number from 1" + (f" to {max_rows}" if max_rows else ""), f"count.{k}")
        own[k] = int(v)
    return own

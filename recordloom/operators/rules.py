"""Match rules as documents: validation, defaults, files, suggestions and the text that describes them."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field
from typing import Any


@dataclass(frozen=True)
class Kind:
    """A comparison: label, name and default of its argument, unit of what it measures, whether it can block."""

    label: str
    arg: str | None = None
    default: str = ""
    unit: str | None = None
    blocks: bool = False
    help: str = ""


#: The comparison catalogue.
KINDS: dict[str, Kind] = {
    "exact": Kind("is exactly", blocks=True, help="the values are the same text"),
    "normalized": Kind("matches ignoring case and punctuation", blocks=True, help="the same letters and digits in the same order"),
    "prefix": Kind("first N characters match", "n", "3", blocks=True, help="the same first letters and digits"),
    "soundex": Kind("sounds alike (Soundex)", blocks=True, help="the same Soundex code, for names"),
    "tokens": Kind("same words in any order", blocks=True, help="the same words however they are ordered"),
    "jw": Kind("Jaro-Winkler at least", "threshold", "0.90", "similarity", help="similar texts, agreeing starts count more"),
    "lev": Kind("Levenshtein at least", "threshold", "0.85", "similarity", help="few edits for their length"),
    "jwTokens": Kind("Jaro-Winkler on sorted words at least", "threshold", "0.90", "similarity", help="similar words however they are ordered"),
    "numeric": Kind("numbers within", "n", "1", "difference", help="numbers no further apart than this"),
    "days": Kind("dates within", "n", "1", "days", help="dates no further apart than this"),
}

POLICIES = ("all", "best")


class Invalid(ValueError):
    """A document that cannot be used; ``where`` names the part at fault."""

    def __init__(self, message: str, where: str | None = None):
        super().__init__(message)
        self.where = where


def leading_number(value: Any) -> float | None:
    """The number a text begins with."""
    found = re.match(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", "" if value is None else str(value))
    return float(found[1]) if found else None


@dataclass
class Comparison:
    field: str
    kind: str = "exact"
    arg: str = ""

    def __post_init__(self):
        known = KINDS.get(self.kind)
        if known and known.arg and self.arg in ("", None):
            self.arg = known.default
        self.arg = "" if self.arg is None else str(self.arg)

    @property
    def number(self) -> float:
        return leading_number(self.arg) or 0.0

    @property
    def prefix(self) -> int:
        return max(1, int(self.number) or 3)

    @property
    def threshold(self) -> float:
        return self.number or float(KINDS[self.kind].default)


@dataclass
class Rule:
    name: str = "Rule"
    comparisons: list[Comparison] = field(default_factory=list)
    confidence: str | float = "0.95"
    blankAgrees: bool = False

    @property
    def score(self) -> float:
        own = leading_number(self.confidence)
        return 1.0 if own is None else min(max(own, 0.0), 1.0)

    @property
    def blocked(self) -> bool:
        return any(KINDS[c.kind].blocks for c in self.comparisons)


def validate_rule(rule: Rule, index: int, fields: set[str] | None = None) -> None:
    """Raise ``Invalid`` for a rule that could not mean what its author meant."""
    where = f"rule {index + 1}" + (f' "{rule.name}"' if rule.name else "")
    if not rule.comparisons:
        raise Invalid(f"{where} has no comparisons: it would link every record to every other", where)
    for c in rule.comparisons:
        if not c.field:
            raise Invalid(f"{where}: a comparison has no field", where)
        if fields and c.field not in fields:
            raise Invalid(f'{where}: no field named "{c.field}"', where)
        kind = KINDS.get(c.kind)
        if kind is None:
            raise Invalid(f'{where}: unknown comparison "{c.kind}"', where)
        value = leading_number(c.arg)
        if kind.arg == "threshold" and not (value is not None and 0 < value <= 1):
            raise Invalid(f"{where}: {kind.label} needs a similarity between 0 and 1", where)
        if kind.arg == "n" and not (value is not None and value >= 0):
            raise Invalid(f"{where}: {kind.label} needs a number of 0 or more", where)
    own = leading_number(rule.confidence)
    if rule.confidence not in ("", None) and not (own is not None and 0 <= own <= 1):
        raise Invalid(f"{where}: confidence must be between 0 and 1", where)


# Files. A matcher file holds rules and the link policy; a scorer file also fields, bands and mode.


def rules_document(rules: list[Rule]) -> list[dict]:
    return [asdict(r) | {"confidence": str(r.confidence)} for r in rules]


def read_rules(found: Any, fields: list[str], warnings: list[str]) -> list[Rule]:
    out = []
    for i, r in enumerate(found):
        if not isinstance(r, dict):
            raise Invalid(f"rule {i + 1} is not an object")
        where = f"rule {i + 1}" + (f' "{r["name"]}"' if r.get("name") else "")
        if not isinstance(r.get("comparisons"), list):
            raise Invalid(f"{where} has no list of comparisons")
        own = []
        for k, c in enumerate(r["comparisons"]):
            if not isinstance(c, dict):
                raise Invalid(f"{where}, comparison {k + 1} is not an object")
            if str(c.get("kind") or "") not in KINDS:
                raise Invalid(f'{where}: unknown comparison "{c.get("kind")}"')
            name = str(c.get("field") or "")
            if fields and name and name not in fields:
                warnings.append(f'{where} compares "{name}", which is not there')
            own.append(Comparison(name, str(c["kind"]), c.get("arg")))
        sure = leading_number(r.get("confidence"))
        out.append(Rule(str(r.get("name") or f"Rule {i + 1}"), own, "0.95" if sure is None else f"{min(max(sure, 0.0), 1.0):g}", bool(r.get("blankAgrees"))))
    return out


def _file_kind(found: Any, want: str) -> str:
    if not isinstance(found, dict):
        raise Invalid(f"a {want} file is a JSON object")
    if isinstance(found.get("entities"), list) and not found.get("rules"):
        raise Invalid(f"this is a schema file, not a {want} file")
    if found.get("kind") not in (None, "scorer", "matcher"):
        raise Invalid(f'this is a "{found["kind"]}" file, not a {want} file')
    if not isinstance(found.get("rules"), list):
        raise Invalid(f"a {want} file needs a list of rules (it may be empty)")
    return found.get("kind") or want


def _policy(found: dict, warnings: list[str]) -> str:
    own = found.get("linkPolicy")
    if own in POLICIES:
        return own
    if own not in (None, ""):
        warnings.append(f'unknown link policy "{own}"; "all" was used')
    return "all"


def matcher_document(rules: list[Rule], entity: str = "", link_policy: str = "all") -> dict:
    return {"kind": "matcher", "version": 1, "entity": entity, "linkPolicy": link_policy if link_policy in POLICIES else "all", "rules": rules_document(rules)}


def read_matcher(found: Any, fields: list[str] | None = None) -> tuple[dict, list[str]]:
    """(matcher, warnings) of a matcher or scorer file."""
    kind, warnings = _file_kind(found, "matcher"), []
    rules = read_rules(found["rules"], fields or [], warnings)
    if kind == "scorer":
        warnings.append("this is a scorer file; only its rules and link policy were taken")
    return {"entity": str(found.get("entity") or ""), "linkPolicy": _policy(found, warnings), "rules": rules}, warnings


#: Default bands.
AUTO_MERGE, REVIEW_FLOOR = 0.92, 0.78


def scorer_document(rules: list[Rule], **state) -> dict:
    number = lambda k, d: float(state[k]) if leading_number(state.get(k)) is not None else d
    return matcher_document(rules, state.get("entity", ""), state.get("linkPolicy", "all")) | {
        "kind": "scorer",
        "idField": state.get("idField", ""),
        "blockField": state.get("blockField", ""),
        "mode": "simulate" if state.get("mode") == "simulate" else "paste",
        "closeTransitively": state.get("closeTransitively") is not False,
        "autoMerge": number("autoMerge", AUTO_MERGE),
        "reviewFloor": number("reviewFloor", REVIEW_FLOOR),
    }


def read_scorer(found: Any, fields: list[str] | None = None) -> tuple[dict, list[str]]:
    """(scorer, warnings) of a scorer file, or of a matcher file with defaults for the rest."""
    kind, warnings, fields = _file_kind(found, "scorer"), [], fields or []
    rules = read_rules(found["rules"], fields, warnings)
    if kind == "matcher":
        warnings.append("this is a matcher file; fields and bands are defaults")

    def share(k, default):
        own = leading_number(found.get(k)) if found.get(k) is not None else None
        return own if own is not None and 0 <= own <= 1 else default

    auto, floor = share("autoMerge", AUTO_MERGE), share("reviewFloor", REVIEW_FLOOR)
    if floor > auto:
        warnings.append("the review floor was above auto-merge; both were reset")
        auto, floor = AUTO_MERGE, REVIEW_FLOOR
    names = {}
    for k in ("idField", "blockField"):
        names[k] = str(found.get(k) or "")
        if fields and names[k] and names[k] not in fields:
            warnings.append(f'{k} "{names[k]}" is not there')
            names[k] = ""
    mode = "simulate" if found.get("mode") == "simulate" or (found.get("mode") is None and rules) else "paste"
    return names | {"entity": str(found.get("entity") or ""), "mode": mode, "closeTransitively": found.get("closeTransitively") is not False, "autoMerge": auto, "reviewFloor": floor, "linkPolicy": _policy(found, warnings), "rules": rules}, warnings


# Suggestions: roles that field names suggest.

#: What names of the roles look like, and the rules proposed for the roles that are there.
ROLES = {
    "first": r"^(first[_ ]?name|given[_ ]?name|forename|fname)$",
    "last": r"^(last[_ ]?name|surname|family[_ ]?name|lname)$",
    "dob": r"(birth[_ ]?date|date[_ ]?of[_ ]?birth|dob|birthdate)$",
    "email": r"e[-_ ]?mail",
    "phone": r"phone|mobile|tel",
    "ssn": r"ssn|social|national[_ ]?id",
    "zip": r"(zip|postal)(_?code)?$",
    "street": r"street|address(\.|_)?(line|1)?$",
    "company": r"company|organi[sz]ation|employer",
}
SUGGESTIONS = [
    ("Identifier and birth date", "0.99", [("ssn", "exact", ""), ("dob", "exact", "")]),
    ("Same email", "0.95", [("email", "normalized", "")]),
    ("Fuzzy name and exact birth date", "0.90", [("last", "jw", "0.85"), ("first", "jw", "0.80"), ("dob", "exact", "")]),
    ("Fuzzy name and postal code", "0.82", [("last", "soundex", ""), ("first", "jw", "0.85"), ("zip", "exact", "")]),
]


def suggest_rules(fields: list[str]) -> list[Rule]:
    """The proposed rules whose roles all have a field, strictest first; else an exact rule on the first field."""
    plays = lambda role, f: any(re.search(ROLES[role], name, re.I) for name in (f, f.rpartition(".")[2]))
    of = {role: next((f for f in fields if plays(role, f)), None) for role in ROLES}
    fitting = [x for x in SUGGESTIONS if all(of[role] for role, *_ in x[2])]
    out = [Rule(name, [Comparison(of[role], kind, arg) for role, kind, arg in tests], score) for name, score, tests in fitting]
    return out or [Rule("Rule 1", [Comparison(f, "exact")], "0.95") for f in fields[:1]]


def comparison_help() -> str:
    return "\n".join(f"{k}: {v.label}" + (f" ({v.arg}, {v.default} by default)" if v.arg else "") + f": {v.help}" for k, v in KINDS.items())


def authoring_prompt(entity: str, fields: list[tuple[str, str]], note: str = "") -> str:
    """A specification of the rule format for whoever writes rules for ``entity``."""
    lines = [f'Write match rules for the records of "{entity}".', "A pair matches if any rule passes; a rule passes if all its comparisons do.", "Fields:"]
    lines += [f"- {name} ({kind})" for name, kind in fields]
    lines += ["Comparisons:", comparison_help(), 'Answer with JSON: {"kind": "matcher", "version": 1, "rules": [{"name", "confidence", "blankAgrees", "comparisons": [{"field", "kind", "arg"}]}]}']
    return "\n".join(lines + ([note] if note else []))

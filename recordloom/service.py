"""Register, generate and score as plain functions over a store of immutable schemas."""

from __future__ import annotations

import json
import os
import re
import secrets
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import scoring as S
from .operators.generate import IX, Generated, Generator
from .operators.rules import AUTO_MERGE, REVIEW_FLOOR, Invalid
from .operators.schema import read_schema, resolve_counts
from .sources import parsing, sinks

#: Fixed value: the alphabet of identifiers (no I, L, O or U).
ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
#: Fixed value: rows of an entity that one request may ask for. Replies are made on the driver, so they are bounded.
MAX_ROWS = 10_000


def new_id() -> str:
    """An identifier of 32 characters that cannot be guessed."""
    return "".join(secrets.choice(ALPHABET) for _ in range(32))


def seed_of(raw: Any) -> int:
    """The whole number that a seed begins with; a new random one if it begins with none."""
    found = re.match(r"\s*([+-]?\d+)", "" if raw is None else str(raw))
    return int(found[1]) if found else secrets.randbelow(10**9)


def normalize_id(raw: Any) -> str | None:
    """The identifier as it is stored; None if it is none."""
    own = re.sub(r"[\s-]", "", str(raw or "")).upper()
    return own if re.fullmatch(f"[{ALPHABET}]{{32}}", own) else None


class MemoryStore:
    """Schemas by id; written once."""

    def __init__(self):
        self.own: dict[str, str] = {}

    def get(self, key: str) -> Any:
        return json.loads(self.own[key]) if key in self.own else None

    def put(self, key: str, doc: Any) -> None:
        if key in self.own:
            raise Invalid("the id is taken")
        self.own[key] = json.dumps(doc)


class FileStore(MemoryStore):
    """One JSON file a schema; files are never overwritten. Kept in memory once read."""

    def __init__(self, folder: str):
        super().__init__()
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def get(self, key: str) -> Any:
        path = os.path.join(self.folder, f"{key}.json")
        if key not in self.own and os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                self.own[key] = f.read()
        return super().get(key)

    def put(self, key: str, doc: Any) -> None:
        with open(os.path.join(self.folder, f"{key}.json"), "x", encoding="utf-8") as f:
            json.dump(doc, f)


class Service:
    def __init__(self, spark: SparkSession, store: MemoryStore | None = None):
        self.spark, self.store = spark, store or MemoryStore()

    def register(self, doc: Any) -> str:
        read_schema(doc)
        key = new_id()
        self.store.put(key, doc)
        return key

    def schema(self, key: str) -> Any:
        own = normalize_id(key)
        doc = self.store.get(own) if own else None
        if doc is None:
            raise Invalid("no such schema", "schemaId")
        return doc

    def run(self, key: str, count: Any = None, seed: int | None = None) -> tuple[dict[str, Generated], int]:
        entities = read_schema(self.schema(key))
        seed, counts = seed_of(seed), resolve_counts(entities, count, MAX_ROWS)
        over = [name for name, n in counts.items() if n > MAX_ROWS]
        if over:
            raise Invalid(f'"{over[0]}" has more than {MAX_ROWS:,} rows', "count")
        return Generator(self.spark, entities, counts, seed).run(), seed

    def generate(self, key: str, count: Any = None, seed: int | None = None, kind: str = "json") -> dict:
        """Texts of all entities, the seed, a fingerprint that does not depend on the format, and warnings."""
        if kind not in ("json", "csv", "xml"):
            raise Invalid(f'unknown format "{kind}"', "format")
        made, seed = self.run(key, count, seed)
        data, prints, warnings = {}, [], []
        for name, g in made.items():
            names = g.flat().columns
            own = g.rows.select(IX, *[F.col(f"`{n}`") for n in names])
            data[name] = sinks.serialized(own, kind, g.entity.root, g.entity.record, IX)
            lines = own.select(IX, sinks.json_line(own, names).alias("line"))
            prints.append(sinks.fingerprint(lines, IX, "line").first().fingerprint)
            warnings += g.messages
        whole = self.spark.range(1).select(F.substring(F.sha2(F.lit("".join(prints)), 256), 1, 32)).first()[0]
        return {"seed": seed, "format": kind, "data": data, "fingerprint": whole, "warnings": warnings}

    def truth(self, given: dict) -> DataFrame:
        """Labels from a map, from records, or from a schema that is generated again."""
        if "labels" in given:
            return parsing.labels_frame(self.spark, given["labels"] if isinstance(given["labels"], dict) else parsing.parse_labels(json.dumps(given["labels"])))
        if "records" in given:
            rows = [(parsing.get_path(r, given["idField"]), parsing.get_path(r, given.get("matchField", "match_id"))) for r in given["records"]]
            shown = [(None if a is None else parsing.as_text(a), None if b is None else parsing.as_text(b)) for a, b in rows]
            return S.truth_of(self.spark.createDataFrame(shown, "id string, match_id string"), "id")
        if "schemaId" in given:
            made, _ = self.run(given["schemaId"], given.get("count"), given.get("seed"))
            name = given.get("entity") or next(iter(made))
            if name not in made or not made[name].match_field:
                raise Invalid(f'"{name}" has no duplicates to score against', "truth.entity")
            return S.truth_of(made[name].rows, given["idField"], made[name].match_field)
        raise Invalid("truth needs labels, records or a schemaId", "truth")

    def score(self, truth: dict, pairs: Any, close: bool = True, candidates: Any = None, blocks: dict | None = None, thresholds: list[float] | None = None, bands: tuple[float, float] = (AUTO_MERGE, REVIEW_FLOOR)) -> dict:
        found, *_ = parsing.normalize_pairs(pairs)
        compared = parsing.pairs_frame(self.spark, parsing.normalize_pairs(candidates)[0]) if candidates is not None else None
        labelled = parsing.labels_frame(self.spark, blocks) if blocks is not None else None
        return S.score_all(self.truth(truth), parsing.pairs_frame(self.spark, found), close, compared, labelled, thresholds, *bands)

    def health(self) -> dict:
        return {"ok": True, "spark": self.spark.version}

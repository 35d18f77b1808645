"""Pairs, labels and records from what people paste or have in files.

Pasted text is small and is read on the driver; files are read by Spark's own readers after a look at their first line.
"""

from __future__ import annotations

import csv
import io
import json
import math
import re
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.matcher import field_column
from ..operators.rules import Invalid

#: Delimiters in order of preference, spellings of the two ids and of the score, words of headers.
DELIMITERS = [",", "\t", ";", "|"]
PAIR_KEYS = [("a", "b"), ("left", "right"), ("id_a", "id_b"), ("id1", "id2"), ("idA", "idB"), ("source", "target"), ("from", "to"), ("record_a", "record_b"), ("first", "second"), ("x", "y")]
SCORE_KEYS = ["score", "similarity", "sim", "weight", "probability", "prob", "confidence"]
HEADER = re.compile(
    r"(id|ids?[_ ]?[ab12]|record[_ ]?[ab12]?|rec[_ ]?[ab12]|left|right|source|target|from|to|first|second|score|sim|similarity|weight|prob|probability|confidence|match_id|_match_id|block|block_key|key|cluster|label)",
    re.I,
)
NUMERIC = re.compile(r"-?\d+(\.\d+)?")


def delimiter_of(line: str) -> str:
    """The most frequent delimiter of a line; the first of equals."""
    return max(DELIMITERS, key=lambda d: (line.count(d), -DELIMITERS.index(d)))


def parse_csv(text: str, delimiter: str | None = None) -> list[list[str]]:
    """Rows of delimited text with quoted cells; blank lines and a byte order mark go."""
    text = text.removeprefix("﻿")
    first = re.split(r"\r?\n", text, maxsplit=1)[0]
    rows = csv.reader(io.StringIO(text, newline=""), delimiter=delimiter or delimiter_of(first))
    return [r for r in rows if len(r) > 1 or (r and r[0].strip())]


def looks_like_header(row: list[str]) -> bool:
    """Two cells at least, none a number, one a word that headers use."""
    cells = [str(c).strip() for c in row or []]
    return len(cells) >= 2 and not any(NUMERIC.fullmatch(c) for c in cells) and any(HEADER.fullmatch(c) for c in cells)


def as_text(value: Any) -> str:
    """A JSON value as text; whole numbers without a fraction."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value)


def normalize_pairs(found: Any) -> tuple[list[tuple[str, str, float | None]], bool, bool]:
    """(pairs, every pair scored, some scored) of a list in any of the usual shapes."""
    if isinstance(found, dict) and isinstance(found.get("pairs"), list):
        found = found["pairs"]
    if not isinstance(found, list):
        raise Invalid("pairs must be a list")
    out = []
    for i, p in enumerate(found):
        if isinstance(p, (list, tuple)):
            if len(p) < 2:
                raise Invalid(f"pairs[{i}]: two record ids are needed")
            a, b, score = p[0], p[1], p[2] if len(p) > 2 else None
        elif isinstance(p, dict):
            names = next((k for k in PAIR_KEYS if k[0] in p and k[1] in p), None)
            if names is None:
                raise Invalid(f"pairs[{i}]: the two record ids were not found")
            a, b = p[names[0]], p[names[1]]
            score = next((p[k] for k in SCORE_KEYS if k in p), None)
        else:
            raise Invalid(f"pairs[{i}]: expected two ids")
        if a in (None, "") or b in (None, ""):
            raise Invalid(f"pairs[{i}]: an id is empty")
        if score in (None, ""):
            out.append((as_text(a), as_text(b), None))
            continue
        try:
            number = float(score)
        except (TypeError, ValueError):
            number = math.nan
        if not math.isfinite(number):
            raise Invalid(f'pairs[{i}]: the score "{score}" is not a number')
        out.append((as_text(a), as_text(b), number))
    n = sum(s is not None for *_, s in out)
    return out, bool(out) and n == len(out), 0 < n < len(out)


def parse_pairs(text: str, header: bool | None = None):
    """(pairs, every pair scored, some scored, had a header) of JSON or delimited text."""
    text = text.strip()
    if not text:
        return [], False, False, False
    if text[0] in "[{":
        return (*normalize_pairs(json.loads(text)), False)
    rows = parse_csv(text)
    has = looks_like_header(rows[0]) if header is None else header
    return (*normalize_pairs([[c.strip() for c in r[:3]] for r in rows[has:]]), has)


def parse_records(text: str) -> tuple[list[dict], list[str]]:
    """(records, columns) of a JSON list, the first list in a JSON object, or delimited text with a header."""
    text = text.strip()
    if not text:
        return [], []
    if text[0] in "[{":
        found = json.loads(text)
        if isinstance(found, dict):
            found = next((v for v in found.values() if isinstance(v, list)), None)
            if found is None:
                raise Invalid("the JSON holds no list of records")
        return found, list(dict.fromkeys(k for r in found if isinstance(r, dict) for k in r))
    rows = parse_csv(text)
    if len(rows) < 2:
        raise Invalid("a header and one record at least are needed")
    columns = [c.strip() for c in rows[0]]
    return [{c: r[i] if i < len(r) else "" for i, c in enumerate(columns)} for r in rows[1:]], columns


def get_path(record: Any, path: str) -> Any:
    """A value by its full name first, else by walking the path; marks of repeats and attributes are optional."""
    if isinstance(record, dict) and path in record:
        return record[path]
    at = record
    for part in path.split("."):
        part = part.split("[")[0].removeprefix("@")
        if not isinstance(at, dict) or part not in at:
            return None
        at = at[part]
    return at.get("_value") if isinstance(at, dict) and "_value" in at else at


def parse_labels(text: str, header: bool | None = None) -> dict[str, str]:
    """id -> key of a JSON object, a JSON list, or delimited text; later ones win."""
    text = text.strip()
    if not text:
        return {}
    if text[0] == "{":
        entries = list(json.loads(text).items())
    elif text[0] == "[":
        entries = []
        for e in json.loads(text):
            if isinstance(e, list):
                entries.append((e[0], e[1]))
            else:
                entries.append((get_path(e, "id"), next((v for v in (get_path(e, k) for k in ("key", "block", "match_id")) if v is not None), None)))
    else:
        rows = parse_csv(text)
        has = looks_like_header(rows[0]) if header is None else header
        entries = [(r[0].strip(), (r[1] if len(r) > 1 else "").strip()) for r in rows[has:]]
    for i, (k, v) in enumerate(entries):
        if k in (None, "") or v is None:
            raise Invalid(f"labels[{i}]: an id or a key is missing")
    return {as_text(k): as_text(v) for k, v in entries}


def pairs_frame(spark: SparkSession, pairs: list[tuple[str, str, float | None]]) -> DataFrame:
    return spark.createDataFrame(pairs, "a string, b string, score double")


def labels_frame(spark: SparkSession, labels: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(labels.items()), "id string, key string")


# Files of any size.


def first_line(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path).where(F.length(F.trim("value")) > 0).first()
    return row.value.removeprefix("﻿") if row else ""


def read_delimited(spark: SparkSession, path: str, header: bool | None = None) -> tuple[DataFrame, bool]:
    """(all columns as text, had a header) of delimited files; delimiter and header are told by the first line."""
    line = first_line(spark, path)
    d = delimiter_of(line)
    cells = next(csv.reader([line], delimiter=d), [])
    has = looks_like_header(cells) if header is None else header
    reader = spark.read.option("sep", d).option("quote", '"').option("escape", '"').option("multiLine", True).option("header", has)
    names = [c.strip() for c in cells] if has else [f"c{i}" for i in range(len(cells))]
    return reader.schema(", ".join(f"`{n}` string" for n in names)).csv(path), has


def pairs_of(df: DataFrame, strict: bool = True) -> DataFrame:
    """Canonical a, b (, score) of a table that names its ids in one of the usual ways, else by place.

    A row with an empty id or a score that is no finite number is refused when it is read, naming the row's values;
    unless ``strict`` such ids and scores are null.
    """
    names = next((k for k in PAIR_KEYS if k[0] in df.columns and k[1] in df.columns), None)
    if names is None:
        if len(df.columns) < 2:
            raise Invalid("the two record ids were not found")
        names = (df.columns[0], df.columns[1])
        score = df.columns[2] if len(df.columns) > 2 else None
    else:
        score = next((k for k in SCORE_KEYS if k in df.columns), None)
    text = lambda n: F.trim(F.col(f"`{n}`").cast("string"))
    shown = F.concat_ws(", ", *[F.coalesce(text(n), F.lit("null")) for n in [*names, *([score] if score else [])]])

    def kept(value: Column, fine: Column, what: str) -> Column:
        if not strict:
            return F.when(fine, value)
        return F.when(fine, value).otherwise(F.raise_error(F.concat(F.lit(f"{what} in the pair ("), shown, F.lit(")"))).cast("string"))

    ids = [kept(text(n), F.coalesce(text(n) != "", F.lit(False)), "an id is empty").alias(c) for n, c in zip(names, "ab")]
    if not score:
        return df.select(*ids)
    blank, number = F.coalesce(text(score), F.lit("")) == "", text(score).try_cast("double")
    finite = F.coalesce(~F.isnan(number) & (F.abs(number) != float("inf")), F.lit(False))
    value = kept(F.when(~blank, text(score)), blank | finite, "the score is not a number")
    return df.select(*ids, value.cast("double").alias("score"))


def labels_of(df: DataFrame) -> DataFrame:
    """Canonical id, key of a table (key, block or match_id), one row an id.

    A table has no order, so of several keys of one id the largest holds; in a text the last one does.
    """
    have = [F.col(f"`{c}`").cast("string") for c in ("key", "block", "match_id") if c in df.columns]
    id_column: Column = F.col("id") if "id" in df.columns else F.col(f"`{df.columns[0]}`")
    key = F.coalesce(*have) if have else F.col(f"`{df.columns[1]}`").cast("string")
    return df.select(F.trim(id_column.cast("string")).alias("id"), F.trim(key).alias("key")).groupBy("id").agg(F.max("key").alias("key"))


def _is_whole(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON files (a list, an object that holds one, or an object a line) or delimited files with a header.

    Lines that are whole objects are read as lines, in parallel; else a file is one document. A document that is an
    object gives the records of the first of its lists. Missing cells of delimited files are empty.
    """
    line = first_line(spark, path).strip()
    if line[:1] == "{" and _is_whole(line) and spark.read.text(path).where(F.length(F.trim("value")) > 0).limit(2).count() == 2:
        return spark.read.json(path)
    if line[:1] == "[":
        return spark.read.option("multiLine", True).json(path)
    if line[:1] == "{":
        found = spark.read.option("multiLine", True).json(path)
        lists = [f.name for f in found.schema if isinstance(f.dataType, T.ArrayType)]
        if not lists:
            raise Invalid("the JSON holds no list of records")
        # Spark orders inferred fields by name; the file says which list comes first.
        order = [k for k in _keys_of(spark, path) if k in lists] or lists
        return found.select(F.inline(F.col(f"`{order[0]}`")))
    return read_delimited(spark, path, True)[0].fillna("")


def _keys_of(spark: SparkSession, path: str) -> list[str]:
    """Names of a JSON document's own fields, in the order of the first file."""
    whole = spark.read.text(path, wholetext=True)
    row = whole.select(F.json_object_keys("value").alias("keys")).first()
    return (row["keys"] or []) if row else []


def column(df: DataFrame, path: str) -> Column:
    return field_column(df, path)

"""Normal forms of field values as Columns: what two records must agree on under an equality comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The leading number that counts of a text, and what counts as white space when testing for blanks.
NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
BLANK = r"(?U)^[\s\x{FEFF}]*$"


def text(column: Column, kind: T.DataType | None = None) -> Column:
    """A value as text; whole floating-point numbers without a fraction (1.0 is "1")."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (column == F.floor(column)) & (F.abs(column) < 1e15)
        return F.when(whole, column.cast("long").cast("string")).otherwise(column.cast("string"))
    return column.cast("string")


def is_blank(value: Column) -> Column:
    """Null, empty or white space only."""
    return value.isNull() | value.rlike(BLANK)


def normalized(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]", "")


def prefix(value: Column, n: int) -> Column:
    return F.substring(normalized(value), 1, n)


def soundex(value: Column) -> Column:
    """Soundex of the letters A-Z; the empty text if there are none."""
    letters = F.regexp_replace(F.upper(F.coalesce(value, F.lit(""))), "[^A-Z]", "")
    return F.when(letters == "", F.lit("")).otherwise(F.soundex(letters))


def tokens(value: Column) -> Column:
    """The lower-cased alphanumeric words in order."""
    words = F.split(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]+")
    return F.array_join(F.array_sort(F.filter(words, lambda w: w != "")), " ")


def number(value: Column) -> Column:
    """The number that a text begins with; null if none."""
    found = F.regexp_extract(value, NUMBER, 1)
    return F.when(found != "", found).try_cast("double")


def moment(value: Column) -> Column:
    """Milliseconds of an ISO date or date-time, or of month/day/year; null for anything else."""
    slashed = F.when(value.rlike(r"^\s*\d{1,2}/\d{1,2}/\d{4}\s*$"), F.try_to_timestamp(F.trim(value), F.lit("M/d/yyyy")))
    iso = F.when(value.rlike(r"^\s*\d{4}-\d{2}(-\d{2})?"), F.trim(value).try_cast("timestamp"))
    return F.unix_millis(F.coalesce(iso, slashed))

"""String similarities. Levenshtein runs in the JVM; Jaro-Winkler is an Arrow-batched UDF (no builtin exists)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of Jaro-Winkler: longest prefix that counts and its weight. The bonus has no lower gate.
PREFIX, WEIGHT = 4, 0.1
#: Texts up to this length are compared many pairs at once.
SHORT = 32


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; two empty texts are equal."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b) / longer)


def levenshtein_at_least(a: Column, b: Column, least: float) -> Column:
    """The similarity test behind a length test that spares the distance where it cannot pass."""
    la, lb = F.length(a), F.length(b)
    longer = F.greatest(la, lb)
    possible = F.abs(la - lb) <= (F.lit(1.0 - least) * longer + F.lit(1e-9))
    return possible & (levenshtein_similarity(a, b) >= F.lit(least))


def jaro_winkler_value(a: str, b: str) -> float:
    """Jaro-Winkler of two texts. Greedy matching goes through ``a``; half transpositions count in halves."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = list(b)
    matched, places = [], []
    for i, c in enumerate(a):
        lo = max(0, i - reach)
        try:
            j = free.index(c, lo, i + reach + 1)
        except ValueError:
            continue
        free[j] = None
        matched.append(c)
        places.append(j)
    m = len(matched)
    if not m:
        return 0.0
    places.sort()
    half = sum(c != b[j] for c, j in zip(matched, places)) / 2
    jaro = (m / len(a) + m / len(b) + (m - half) / m) / 3
    same = 0
    for x, y in zip(a[:PREFIX], b[:PREFIX]):
        if x != y:
            break
        same += 1
    return jaro + same * WEIGHT * (1 - jaro)


def jaro_winkler_values(a: list[str], b: list[str]) -> np.ndarray:
    """``jaro_winkler_value`` of many pairs of texts of up to SHORT characters at once."""
    la, lb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    wide = max(int(la.max(initial=0)), int(lb.max(initial=0)), 1)
    x, y = (np.array(t, dtype=f"U{wide}").view(np.uint32).reshape(len(t), wide) for t in (a, b))
    reach = np.maximum(0, np.maximum(la, lb) // 2 - 1)
    rows, places = np.arange(len(a)), np.arange(wide)
    free = places < lb[:, None]
    taken = np.zeros((len(a), wide), bool)
    for i in range(int(la.max(initial=0))):
        lo, hi = max(0, i - int(reach.max())), i + int(reach.max()) + 1
        fits = (y[:, lo:hi] == x[:, i, None]) & free[:, lo:hi] & (np.abs(places[lo:hi] - i) <= reach[:, None])
        if not fits.size:
            continue
        at = fits.argmax(axis=1)
        met = fits[rows, at] & (i < la)
        free[rows[met], lo + at[met]] = False
        taken[:, i] = met
    m = taken.sum(axis=1)
    gone = (places < lb[:, None]) & ~free
    # Matched characters of both sides line up: the k-th of a row stands at the same place in both lists.
    row = np.nonzero(taken)[0]
    half = np.bincount(row[x[taken] != y[gone]], minlength=len(a)) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = (m / la + m / lb + (m - half) / m) / 3
    head = x[:, :PREFIX] == y[:, :PREFIX]
    head &= places[:PREFIX] < np.minimum(la, lb)[:, None]
    same = np.cumprod(head, axis=1).sum(axis=1)
    equal = (la == lb) & (x == y).all(axis=1)
    return np.where(equal, 1.0, np.where(m == 0, 0.0, jaro + same * WEIGHT * (1 - jaro)))


@F.pandas_udf(T.DoubleType())
def _jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    out = np.full(len(a), np.nan)
    known, short = {}, []
    for i, (x, y) in enumerate(zip(a, b)):
        if x is None or y is None:
            continue
        if len(x) <= SHORT and len(y) <= SHORT:
            short.append(i)
            continue
        if (x, y) not in known:
            known[x, y] = jaro_winkler_value(x, y)
        out[i] = known[x, y]
    if short:
        out[short] = jaro_winkler_values(a.iloc[short].tolist(), b.iloc[short].tolist())
    return pd.Series(out, dtype="float64")


def jaro_winkler(a: Column, b: Column) -> Column:
    return _jaro_winkler(a, b)


def jaro_winkler_column(a: Column, b: Column) -> Column:
    """The same value from builtin functions only, for plans that must not leave the JVM (slower)."""
    reach = F.greatest(F.lit(0), F.floor(F.greatest(F.length(a), F.length(b)) / 2).cast("int") - 1)
    start = F.struct(F.array().cast("array<int>").alias("places"), F.array().cast("array<string>").alias("chars"))

    def step(state, i):
        open_places = F.filter(
            F.sequence(F.greatest(F.lit(1), i - reach), F.least(F.length(b), i + reach)),
            lambda j: (F.substring(b, j, F.lit(1)) == F.substring(a, i, F.lit(1))) & ~F.array_contains(state["places"], j),
        )
        place = F.when((i - reach) <= F.length(b), F.try_element_at(open_places, F.lit(1)))
        grown = F.struct(F.array_append(state["places"], place).alias("places"), F.array_append(state["chars"], F.substring(a, i, F.lit(1))).alias("chars"))
        return F.when(place.isNull(), state).otherwise(grown)

    walked = F.aggregate(F.sequence(F.lit(1), F.length(a)), start, step)
    m = F.size(walked["places"])
    pairs = F.zip_with(walked["chars"], F.array_sort(walked["places"]), lambda c, j: c != F.substring(b, j, F.lit(1)))
    half = F.size(F.filter(pairs, lambda x: x)) / 2
    jaro = F.when(m == 0, F.lit(0.0)).otherwise((m / F.length(a) + m / F.length(b) + (m - half) / m) / 3)
    same = F.lit(0)
    for n in range(PREFIX, 0, -1):
        fits = (F.length(a) >= n) & (F.length(b) >= n) & (F.substring(a, 1, n) == F.substring(b, 1, n))
        same = F.when((same == 0) & fits, F.lit(n)).otherwise(same)
    return F.when(a == b, F.lit(1.0)).when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(jaro + same * WEIGHT * (1 - jaro))

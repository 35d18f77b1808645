"""Counter-based random numbers as Columns.

Draw k of a seed is a pure function of (seed, k): the 32-bit mixer Mulberry32 over seed + k * step. So any row can
compute its draws alone, on any partitioning. A schema whose rows take a fixed number of draws replays one stream
(row r takes draws r * D + 1 ...); where draws depend on data, each cell has a stream of its own, keyed by 64 bits of
a hash of what the cell is: draw k of it is a 64-bit hash of key and k.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The step and the two constants of Mulberry32.
STEP, FIRST, SECOND = 0x6D2B79F5, 1, 61
MASK = 0xFFFFFFFF

Draws = Callable[[int], Column]


def _times(a: Column, b: Column) -> Column:
    """Low 32 bits of a product; split so that no 64-bit product overflows."""
    low, high = a.bitwiseAND(F.lit(65535)), F.shiftright(a, 16)
    return (low * b + F.shiftleft((high * b).bitwiseAND(F.lit(65535)), 16)).bitwiseAND(F.lit(MASK))


def uniforms(seed: Column, counters: Column) -> Column:
    """array<double> of the draws with the given numbers (array<bigint>)."""
    state = F.transform(counters, lambda k: (seed + _times(F.pmod(k, F.lit(1 << 32)), F.lit(STEP))).bitwiseAND(F.lit(MASK)))
    one = F.transform(state, lambda a: _times(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(FIRST))))
    two = F.transform(one, lambda t: (t + _times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(SECOND)))).bitwiseAND(F.lit(MASK)).bitwiseXOR(t))
    return F.transform(two, lambda t: t.bitwiseXOR(F.shiftright(t, 14)).cast("double") / F.lit(4294967296.0))


def mulberry32(seed: int):
    """The same stream as a Python function, for drivers and UDFs."""
    state = seed & MASK

    def draw() -> float:
        nonlocal state
        state = (state + STEP) & MASK
        t = (state ^ state >> 15) * (state | FIRST) & MASK
        t = (t + (t ^ t >> 7) * (t | SECOND)) & MASK ^ t
        return (t ^ t >> 14) / 4294967296

    return draw


def from_array(every: Column) -> Draws:
    """Draws that are at hand as an array."""
    return lambda i: F.element_at(every, i + 1)


def row_draws(seed: int, row: Column, per_row: int, skip: int = 0) -> Column:
    """All draws of row ``row`` (0-based) in the stream of ``seed``; ``skip`` draws were taken before the first row."""
    first = row.cast("long") * per_row + F.lit(skip + 1).cast("long")
    return uniforms(F.lit(seed & MASK).cast("long"), F.sequence(first, first + F.lit(max(per_row, 1) - 1)))


def row_stream(seed: int, row: Column, per_row: int, skip: int = 0) -> Draws:
    return from_array(row_draws(seed, row, per_row, skip))


def cell_key(seed: int, *what) -> Column:
    """The stream of a cell: a 64-bit hash of the seed and what the cell is (text, numbers or Columns)."""
    parts = [x if isinstance(x, Column) else F.lit(x) for x in (seed, *what)]
    return F.xxhash64(*parts)


def cell_draws(key: Column, count: int) -> Column:
    """The first draws of one cell, of 53 bits each."""
    numbers = F.sequence(F.lit(1), F.lit(count))
    return F.transform(numbers, lambda k: F.shiftrightunsigned(F.xxhash64(key, k), 11).cast("double") / F.lit(float(1 << 53)))


def cell_stream(key: Column, count: int = 64) -> Draws:
    return from_array(cell_draws(key, count))


def integer(u: Column, lo: int, hi: int) -> Column:
    """A whole number from lo to hi."""
    return F.floor(u * F.lit(float(hi - lo + 1))) + F.lit(lo).cast("long")


def choice(u: Column, values: list) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(u * F.lit(float(len(values)))) + 1).cast("int"))


def weighted(u: Column, pairs: list[tuple[str, float]]) -> Column:
    """A value by cumulative weights."""
    total, run, out = float(sum(w for _, w in pairs)), 0.0, None
    for value, w in pairs[:-1]:
        run += w
        test = u < F.lit(run / total)
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    last = F.lit(pairs[-1][0])
    return last if out is None else out.otherwise(last)

"""Rule-based record linkage as Spark plans.

A pair links if any rule passes; a rule passes if all its comparisons do. Every equality comparison of a rule becomes
one precomputed key column, so each rule is an equi-join of the records with themselves (Spark picks the strategy,
adaptive execution splits heavy blocks) and only the remaining comparisons are residual predicates. An OR over rules
would leave the optimizer no join key, so rules are separate joins whose links are united and aggregated by pair.

Rules with a similarity first fold records of equal values. Two texts that are similar enough share a part that is at
most one character short of each, so distinct values meet on such parts (``signatures``) instead of all of their block;
texts too long for that meet as before. What passes is opened to the records again.
"""

from __future__ import annotations

import copy
import math
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import similarity as S
from .rules import KINDS, POLICIES, Comparison, Invalid, Rule, validate_rule
from .storage import write_through

#: Comparisons that a run may cost by default; None asks for no limit.
MAX_COMPARISONS = 3_000_000
#: Blocking comparisons that are told apart by which of them are blank, under rules in which blanks agree.
TOLD_APART = 3
#: Records that every executor gets whole when pairs of classes are opened, and copies in a class from which its pairs are dealt out again.
BROADCAST, MANY = 200_000, 1_000


def field_column(df: DataFrame, path: str) -> Column:
    """A field by its full name first, else by walking a nested path; attributes and repeats lose their marks."""
    if path in df.columns:
        return F.col(f"`{path}`")
    at, kind = None, df.schema
    for part in path.replace("@", "").split("."):
        part = part.split("[")[0]
        if not hasattr(kind, "fieldNames") or part not in kind.fieldNames():
            raise Invalid(f'no field named "{path}"', path)
        at = F.col(f"`{part}`") if at is None else at[part]
        kind = kind[part].dataType
    if hasattr(kind, "fieldNames") and "_value" in kind.fieldNames():
        at = at["_value"]
    return at


def _kind_of(df: DataFrame, column: Column):
    return df.select(column.alias("x")).schema["x"].dataType


def key_of(c: Comparison, value: Column) -> Column:
    """What two records agree on if the comparison passes."""
    if c.kind == "exact":
        return value
    if c.kind == "prefix":
        return K.prefix(value, c.prefix)
    return {"normalized": K.normalized, "soundex": K.soundex, "tokens": K.tokens}[c.kind](value)


def measure_of(c: Comparison, a: Column, b: Column) -> Column | None:
    """What a comparison measures (similarity, difference or days); null if it cannot; None for equality kinds."""
    if c.kind == "jw":
        return S.jaro_winkler(a, b)
    if c.kind == "lev":
        return S.levenshtein_similarity(a, b)
    if c.kind == "jwTokens":
        return S.jaro_winkler(K.tokens(a), K.tokens(b))
    if c.kind == "numeric":
        return F.abs(K.number(a) - K.number(b))
    if c.kind == "days":
        return F.abs(K.moment(a) - K.moment(b)) / F.lit(86_400_000.0)
    return None


def test_of(c: Comparison, a: Column, b: Column) -> Column:
    """Whether two non-blank values pass."""
    if KINDS[c.kind].blocks:
        return key_of(c, a) == key_of(c, b)
    if c.kind == "lev":
        return S.levenshtein_at_least(a, b, c.threshold)
    measured = measure_of(c, a, b)
    if KINDS[c.kind].unit == "similarity":
        return measured >= F.lit(c.threshold)
    return F.coalesce(measured <= F.lit(c.number), F.lit(False))


def at_most(c: Comparison, a: Column, b: Column) -> Column | None:
    """What a Jaro-Winkler similarity can be at most for texts of these lengths; None for other kinds.

    At most all characters of the shorter text match, and the first four agree.
    """
    if c.kind not in ("jw", "jwTokens"):
        return None
    x, y = (K.tokens(a), K.tokens(b)) if c.kind == "jwTokens" else (a, b)
    x, y = F.length(x), F.length(y)
    jaro = (2 + F.least(x, y) / F.greatest(x, y, F.lit(1))) / 3
    return jaro + 0.4 * (1 - jaro) + 1e-9


def _need(c: Comparison) -> float:
    """The least share of the longer text that the shorter one's length can be if the comparison passes."""
    return c.threshold if c.kind == "lev" else 3 * (c.threshold - 0.4) / 0.6 - 2


def first_wide(c: Comparison) -> int | None:
    """The least longer length of a pair that may pass though a text lacks two characters of the other; None if none.

    Levenshtein: the distance is (1 - threshold) of the longer length at most, and so is what either text lacks.
    Jaro-Winkler: jaro is (threshold - 0.4) / 0.6 at least, since four agreeing characters add 0.4 of what it lacks;
    the characters matched are as many as ``common_length`` says, and the longer text lacks most of them where the
    shorter one lacks none.
    """
    least = max(_need(c), 0.0)
    if least >= 1 - 1e-6:
        return None
    hi = max(1, math.floor(1.9 / (1 - least)) - 2)
    while hi - math.ceil(least * hi - 1e-9) < 2:
        hi += 1
    return hi


def common_length(c: Comparison, x: Column, y: Column) -> Column:
    """How many characters texts of these lengths have in common at least if they pass: in order (lev) or in any."""
    if c.kind == "lev":
        return F.ceil(F.lit(c.threshold) * F.greatest(x, y) - F.lit(1e-9))
    jaro = (c.threshold - 0.4) / 0.6
    return F.ceil(F.lit(3 * jaro - 1) * x * y / F.greatest(x + y, F.lit(1)) - F.lit(1e-9))


def compared_text(c: Comparison, value: Column) -> Column:
    return K.tokens(value) if c.kind == "jwTokens" else value


def part_text(c: Comparison, value: Column) -> Column:
    """What parts are taken of: the text, or its sorted characters for Jaro-Winkler, which matches them out of order."""
    own = compared_text(c, value)
    if c.kind == "lev":
        return own
    places = F.sequence(F.lit(1), F.greatest(F.length(own), F.lit(1)))
    return F.array_join(F.sort_array(F.transform(places, lambda i: F.substring(own, i, F.lit(1)))), "")


def sketch(value: Column) -> Column:
    """A long of 21 places of three bits: texts of one length that differ in n characters differ in n places at most."""
    places = F.sequence(F.lit(1), F.greatest(F.length(value), F.lit(1)))
    bits = lambda i: F.call_function("shiftleft", F.ascii(F.substring(value, i, F.lit(1))).cast("long").bitwiseAND(7), (i - 1) % 21 * 3)
    return F.aggregate(places, F.lit(0).cast("long"), lambda all_bits, i: all_bits.bitwiseXOR(bits(i)))


def swaps_fit(c: Comparison, size: Column, other: Column, a: Column, b: Column) -> Column:
    """Whether a Jaro-Winkler similarity can pass for texts with these lengths and sketches.

    Where all characters of both must match, half of the places at which they differ are transpositions.
    """
    every = (size == other) & (common_length(c, size, other) >= size)
    z = a.bitwiseXOR(b)
    z = z.bitwiseOR(F.shiftright(z, 1)).bitwiseOR(F.shiftright(z, 2)).bitwiseAND(F.lit(int("001" * 21, 2)))
    return ~every | (F.bit_count(z) <= F.lit(6 * (1 - (c.threshold - 0.4) / 0.6)) * size + F.lit(1e-6))


def signatures(c: Comparison, own: Column, size: Column, wide: int | None, right: bool = False, lengths: list[int] | None = None) -> Column:
    """Parts of a text, one of which it shares with every text that it passes with and neither is ``wide`` long.

    ``own`` is its ``part_text``, ``size`` the length of that; both should be columns, as they are used for every part.
    A part is ``own`` or ``own`` without one character, beside the left and the ``right`` text's length. Levenshtein
    texts of one length that lack one character of each other differ in one place, which is named too; those of
    Jaro-Winkler are sorted. Lengths that differ by two or more lack two characters. ``lengths`` are all that occur, if
    known.
    """
    places = F.sequence(F.lit(1), F.greatest(size, F.lit(1)))
    without = lambda i: F.concat(F.substring(own, F.lit(1), i - 1), F.substring(own, i + 1, size))
    none = F.array().cast("array<string>")
    parts = []
    for step in (-1, 0, 1):
        other = size + step
        lacks = size - common_length(c, size, other)
        fits = other >= 0
        if wide is not None:
            fits &= F.greatest(size, other) < wide
        if lengths is not None:
            fits &= other.isin(lengths)
        both = [n.cast("string") for n in ((other, size) if right else (size, other))]
        if step == 0 and c.kind == "lev":
            shorter = F.transform(places, lambda i: F.concat_ws(" ", *both, i.cast("string"), without(i)))  # noqa: B023
        else:
            shorter = F.transform(places, lambda i: F.concat_ws(" ", *both, without(i)))  # noqa: B023
        parts.append(F.when(fits & (lacks == 0), F.array(F.concat_ws(" ", *both, own))).when(fits & (lacks == 1), shorter).otherwise(none))
    return F.array_distinct(F.concat(*parts))


def passes(rule: Rule, a: dict[str, Column], b: dict[str, Column], blank_of=K.is_blank, keyed: bool = False, python: bool = True) -> Column:
    """All comparisons pass and one at least was evaluated. Builtin tests come first, Python ones last.

    ``keyed`` says that the pair met on the rule's keys: its equality comparisons were evaluated and passed. Without
    ``python`` only what the JVM can tell is asked: whether the pair may pass, whichever of the two comes first.
    """
    ordered = sorted(rule.comparisons, key=lambda c: c.kind in ("jw", "jwTokens"))
    every, some = [F.lit(True)] * keyed, [F.lit(True)] * keyed
    for c in ordered:
        if keyed and KINDS[c.kind].blocks:
            continue
        blank = blank_of(a[c.field]) | blank_of(b[c.field])
        test = test_of(c, a[c.field], b[c.field])
        # A conjunct of its own, so that the JVM drops pairs by their lengths before Python sees them.
        bound = at_most(c, a[c.field], b[c.field])
        if bound is not None:
            every.append(F.when(blank, F.lit(rule.blankAgrees)).otherwise(bound >= F.lit(c.threshold)))
        if bound is None or python:
            every.append(F.when(blank, F.lit(rule.blankAgrees)).otherwise(test))
        some.append(~blank)
    return reduce(lambda x, y: x & y, every) & reduce(lambda x, y: x | y, some)


def strength(rule: Rule, a: dict[str, Column], b: dict[str, Column], blank_of=K.is_blank) -> Column:
    """Mean closeness over comparisons of non-blank values: 1, the similarity, or 1 / (1 + difference)."""
    total, n = F.lit(0.0), F.lit(0)
    for c in rule.comparisons:
        blank = blank_of(a[c.field]) | blank_of(b[c.field])
        measured = measure_of(c, a[c.field], b[c.field])
        if measured is None:
            own = F.lit(1.0)
        else:
            own = measured if KINDS[c.kind].unit == "similarity" else F.lit(1.0) / (1 + measured)
        own = F.when(~blank, own)
        # Only differences can be null where values are not; a similarity is not to be computed again for its count.
        counts = own.isNotNull() if measured is not None and KINDS[c.kind].unit != "similarity" else ~blank
        total, n = total + F.coalesce(own, F.lit(0.0)), n + counts.cast("int")
    return F.when(n > 0, total / n).otherwise(F.lit(0.0))


def rounded(x: Column, places: int) -> Column:
    scale = float(10**places)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


@dataclass
class Match:
    """What a run produced, as DataFrames (all lazy)."""

    links: DataFrame  # a, b, score, strength, rules, chosen: every pair some rule passed
    pairs: DataFrame  # a, b, score, rules: what the policy keeps
    matched_to: DataFrame  # id, other: each record's best candidate
    candidates: DataFrame  # a, b: every pair compared
    per_rule: DataFrame  # rule, name, linked, compared, blocked
    cost: DataFrame  # rule, name, blocked, compared, records
    ranked: DataFrame  # id, other, rank, score, strength, rules, chosen


class Matcher:
    """Rules bound to records. ``order`` names the column that orients pairs (the id if not given)."""

    def __init__(self, records: DataFrame, rules: list[Rule], id_field: str, order: str | None = None):
        if not id_field:
            raise Invalid("an id field is needed")
        if not rules:
            raise Invalid("at least one match rule is needed")
        self.id_field = id_field
        self.rules, self.fields = rules, sorted({c.field for r in rules for c in r.comparisons})
        for i, r in enumerate(rules):
            validate_rule(r, i)
        value = lambda p: K.text(field_column(records, p), _kind_of(records, field_column(records, p)))
        self.column = {f: f"f{i}" for i, f in enumerate(self.fields)}
        place = field_column(records, order) if order else value(id_field)
        # Blanks become null once for each record, so that pairs need no pattern to tell them.
        present = lambda f: F.when(~K.is_blank(value(f)), value(f))
        self.records = records.select(value(id_field).alias("id"), place.alias("ord"), *[present(f).alias(c) for f, c in self.column.items()])

    def check_ids(self) -> None:
        """Refuse an input without records, records without an id, and ids that are there twice."""
        by_id = self.records.groupBy("id").agg(F.count("*").alias("n"))
        n, blank, most = by_id.agg(F.sum("n"), F.sum(F.when(K.is_blank(F.col("id")), F.col("n")).otherwise(0)), F.max("n")).first()
        if not n:
            raise Invalid("there are no records to match", self.id_field)
        if blank:
            raise Invalid(f'{blank} records have no value in the id field "{self.id_field}"', self.id_field)
        if most > 1:
            raise Invalid(f'the id "{by_id.where("n > 1").orderBy("id").first().id}" is not unique', self.id_field)

    def _keys(self, rule: Rule) -> list[Column]:
        return [key_of(c, F.col(self.column[c.field])) for c in rule.comparisons if KINDS[c.kind].blocks]

    def _keyed(self, rule: Rule) -> tuple[DataFrame, DataFrame]:
        """Records with a block key, and those whose key is blank somewhere."""
        blank = reduce(lambda x, y: x | y, [F.col(self.column[c.field]).isNull() for c in rule.comparisons if KINDS[c.kind].blocks])
        keyed = self.records.where(~blank)
        return keyed.select("*", *[k.alias(f"k{i}") for i, k in enumerate(self._keys(rule))]), self.records.where(blank)

    def _spread(self, df: DataFrame) -> DataFrame:
        """Small inputs have few partitions but many pairs: deal them out before a broadcast join."""
        return df.repartition(df.sparkSession.sparkContext.defaultParallelism, "id") if self._small(df) else df

    def _small(self, df: DataFrame) -> bool:
        least = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= (int(least) if least.isdigit() else 10 << 20)

    def _side(self, df: DataFrame, s: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{s}_{c}") for c in df.columns])

    def _compared(self, rule: Rule) -> list[tuple[DataFrame, bool]]:
        """Pairs a rule compares, oriented, with both sides' values (l_*, r_*), and whether they met on its keys."""
        ordered = (F.col("l_ord") < F.col("r_ord")) | ((F.col("l_ord") == F.col("r_ord")) & (F.col("l_id") < F.col("r_id")))
        if not rule.blocked:
            return [(self._side(self._spread(self.records), "l").join(self._side(self.records, "r"), ordered), False)]
        keyed, wild = self._keyed(rule)
        n = len(self._keys(rule))
        same = reduce(lambda x, y: x & y, [F.col(f"l_k{i}") == F.col(f"r_k{i}") for i in range(n)])
        drop = [f"{s}_k{i}" for s in "lr" for i in range(n)]
        found = self._side(self._spread(keyed), "l").join(self._side(keyed, "r"), same & ordered).drop(*drop)
        if not rule.blankAgrees:
            return [(found, True)]
        # Keyless records meet everything: once as the left and once as the right side, wild pairs only once.
        rest = self.records.join(wild.select("id"), "id", "left_anti")
        with_rest = self._side(self._spread(wild), "l").join(self._side(rest, "r"), ordered).unionByName(self._side(self._spread(rest), "l").join(self._side(wild, "r"), ordered))
        among = self._side(wild, "l").join(self._side(wild, "r"), ordered)
        return [(found, True), (with_rest.unionByName(among), False)]

    def rule_links(self, index: int) -> DataFrame:
        """Pairs that pass one rule: a, b, rule, confidence, strength."""
        rule = self.rules[index]
        if any(KINDS[c.kind].unit == "similarity" for c in rule.comparisons):
            found = self._opened(*self._folded(rule))
            return found.select("a", "b", F.lit(index).alias("rule"), F.lit(rule.score).alias("confidence"), "strength")
        side = lambda s: {f: F.col(f"{s}_{c}") for f, c in self.column.items()}
        null = lambda c: c.isNull()
        parts = [df.where(passes(rule, side("l"), side("r"), null, keyed)) for df, keyed in self._compared(rule)]
        passed = reduce(DataFrame.unionByName, parts)
        return passed.select(F.col("l_id").alias("a"), F.col("r_id").alias("b"), F.lit(index).alias("rule"), F.lit(rule.score).alias("confidence"), strength(rule, side("l"), side("r"), null).alias("strength"))

    def _folded(self, rule: Rule) -> tuple[DataFrame, DataFrame, int, int]:
        """(records' classes: id, ord, class; pairs of classes that pass, with strengths for both orders; how many records there are, and in a class at most)."""
        names = [self.column[f] for f in sorted({c.field for c in rule.comparisons})]
        classes = write_through(self.records.groupBy(*names).agg(F.count("*").alias("n")).select(F.monotonically_increasing_id().alias("id"), *names, "n"), "classes")
        same = reduce(lambda x, y: x & y, [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in names])
        members = self.records.alias("r").join(classes.alias("c"), same).select("r.id", "r.ord", F.col("c.id").alias("class"))
        whole = copy.copy(self)
        whole.records = classes.select("id", F.col("id").alias("ord"), *names)
        copies = classes.where("n > 1").select("id", F.col("id").alias("ord"), *names)
        met = [copies.select(*[F.col(c).alias(f"{s}_{c}") for s in "lr" for c in copies.columns])]
        near = [c for c in rule.comparisons if KINDS[c.kind].unit == "similarity"]
        star = max(near, key=lambda c: first_wide(c) or math.inf)
        wide, text = first_wide(star), F.col(self.column[star.field])
        length = F.length(compared_text(star, text))
        # Only lengths below ``wide`` matter, which are few.
        few = F.lit(None) if wide is None else F.collect_set(F.when(length < wide, length))
        longest, every, most, lengths = classes.agg(F.max(length), F.sum("n"), F.max("n"), few).first()
        if wide is not None and wide <= 4:
            met += [df.select(*met[0].columns) for df, _ in whole._compared(rule)]
        else:
            met += [df.select(*met[0].columns) for df in whole._near(rule, star, wide, lengths)]
            if wide is not None and (longest or 0) >= wide:
                size = lambda s: F.length(compared_text(star, F.col(f"{s}_{self.column[star.field]}")))
                met += [df.where(F.greatest(size("l"), size("r")) >= wide).select(*met[0].columns) for df, _ in whole._compared(rule)]
        side = lambda s: {c.field: F.col(f"{s}_{self.column[c.field]}") for c in rule.comparisons}
        null = lambda c: c.isNull()
        l, r = side("l"), side("r")
        both = reduce(DataFrame.unionByName, met).where(passes(rule, l, r, null, python=False))
        sides = ["l_id", "r_id"]
        if all(c.kind == "lev" for c in near):  # the same in both orders
            found = both.select(*sides, F.lit(True).alias("fore"), strength(rule, l, r, null).alias("fore_s"))
            found = found.withColumn("back", F.lit(True)).withColumn("back_s", F.col("fore_s"))
        else:
            found = both.select(*sides, passes(rule, l, r, null).alias("fore"), strength(rule, l, r, null).alias("fore_s"), passes(rule, r, l, null).alias("back"), strength(rule, r, l, null).alias("back_s")).where("fore or back")
        tasks = 4 * found.sparkSession.sparkContext.defaultParallelism
        return members, found.repartition(tasks, *sides).dropDuplicates(sides), every or 0, most or 0

    def _near(self, rule: Rule, star: Comparison, wide: int | None, lengths: list[int] | None = None) -> list[DataFrame]:
        """Pairs of classes that share their blocking keys and a signature of ``star``, in parts.

        Where blanks agree, a part for each set of comparisons that neither side has blank: of the rest each is blank
        on one side at least. With nothing left that neither side has blank, no pair passes.
        """
        places = [c for c in rule.comparisons if KINDS[c.kind].blocks]
        value = lambda c: F.col(self.column[c.field])
        if rule.blankAgrees:
            every = [*places[:TOLD_APART], star]
            own = self.records
        else:
            every = [*places, star]
            own = self.records.where(reduce(lambda x, y: x & y, [value(c).isNotNull() for c in rule.comparisons]))
        keys = lambda some: [key_of(c, value(c)) for c in some if c is not star]

        small, tasks = self._small(own), 4 * own.sparkSession.sparkContext.defaultParallelism
        own = self._spread(own)
        cut = {}
        for s in "lr":
            df = own.where(value(star).isNotNull()).select("*", part_text(star, value(star)).alias("own")).select("*", F.length("own").alias("size"), (F.lit(None).cast("long") if star.kind == "lev" else sketch(compared_text(star, value(star)))).alias("sketch"))
            cut[s] = df.select("*", F.explode(signatures(star, F.col("own"), F.col("size"), wide, s == "r", lengths)).alias("part"))

        def part(some, l: Column, r: Column) -> DataFrame:
            sides = []
            for s, only in (("l", l), ("r", r)):
                df = reduce(DataFrame.where, [value(c).isNotNull() for c in some], (cut[s] if star in some else own).where(only))
                seen = ["size", "sketch"] if star in some and star.kind != "lev" else []
                df = df.select("id", "ord", *self.column_of(rule), *seen, F.xxhash64(*keys(some), *(["part"] if star in some else []), F.lit(0)).alias("h"))
                # Few bytes are left in few tasks otherwise, though many pairs come of them.
                sides.append(self._side(df.repartition(tasks, "h") if small and some else df, s))
            ordered = F.col("l_ord") < F.col("r_ord")
            if seen:
                ordered &= swaps_fit(star, F.col("l_size"), F.col("r_size"), F.col("l_sketch"), F.col("r_sketch"))
            for c in every:
                if c not in some:
                    ordered &= F.col(f"l_{self.column[c.field]}").isNull() | F.col(f"r_{self.column[c.field]}").isNull()
            if not some:
                return sides[0].drop("l_h").join(sides[1].drop("r_h"), ordered)
            # Parts are many times the records, which sizes guessed from files do not show: not to be broadcast.
            return sides[0].join(sides[1].hint("merge"), (F.col("l_h") == F.col("r_h")) & ordered).drop(*[f"{s}_{c}" for s in "lr" for c in ("h", *seen)])

        whole = F.lit(True)
        out = [part(every, whole, whole)]
        if rule.blankAgrees:
            for n in range(len(every) == len(rule.comparisons), len(every)):
                for some in combinations(every, n):
                    blank = value(next(c for c in every if c not in some)).isNull()
                    out += [part(list(some), blank, whole), part(list(some), ~blank, blank)]
        return out

    def column_of(self, rule: Rule) -> list[str]:
        return [self.column[f] for f in sorted({c.field for c in rule.comparisons})]

    def _opened(self, members: DataFrame, found: DataFrame, every: int, most: int) -> DataFrame:
        """Pairs of records (a, b, strength) of pairs of classes, each in the records' order."""
        members = F.broadcast(members) if every <= BROADCAST else members
        side = lambda s: members.select(*[F.col(c).alias(f"{s}_{k}") for c, k in (("id", "a"), ("ord", "ord"), ("class", "id"))])
        left = found.join(side("l"), "l_id")
        if most >= MANY:
            left = left.repartition(4 * members.sparkSession.sparkContext.defaultParallelism)
        every = left.join(side("r"), "r_id")
        first = (F.col("l_ord") < F.col("r_ord")) | ((F.col("l_ord") == F.col("r_ord")) & (F.col("l_a") < F.col("r_a")))
        every = every.where(((F.col("l_id") != F.col("r_id")) | first) & F.when(first, F.col("fore")).otherwise(F.col("back")))
        pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
        return every.select(pick("l_a", "r_a").alias("a"), pick("r_a", "l_a").alias("b"), pick("fore_s", "back_s").alias("strength"))

    def cost(self) -> DataFrame:
        """Comparisons each rule needs, from group sizes alone: nothing is paired."""
        parts = []
        for i, rule in enumerate(self.rules):
            n = self.records.agg(F.count("*").alias("records"))
            pairs = (F.col("records") * (F.col("records") - 1)).cast("decimal(38,0)")
            if not rule.blocked:
                own = n.withColumn("compared", (pairs / 2).cast("long"))
            else:
                keyed, wild = self._keyed(rule)
                names = [f"k{j}" for j in range(len(self._keys(rule)))]
                grouped = keyed.groupBy(*names).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long")), F.lit(0)).alias("grouped"))
                loose = (wild if rule.blankAgrees else wild.limit(0)).agg(F.count("*").alias("w"))
                each = F.col("grouped") + F.col("w") * (F.col("records") - 1) - (F.col("w") * (F.col("w") - 1) / 2).cast("long")
                own = n.join(grouped).join(loose).withColumn("compared", each).drop("grouped", "w")
            parts.append(own.select(F.lit(i).alias("rule"), F.lit(rule.name).alias("name"), F.lit(rule.blocked).alias("blocked"), F.col("compared").cast("long").alias("compared"), "records"))
        return reduce(DataFrame.unionByName, parts)

    def admit(self, budget: int | None = MAX_COMPARISONS) -> int:
        """Refuse a run that would compare more pairs than the budget, naming the rules without a key."""
        total = self.cost().agg(F.sum("compared")).first()[0] or 0
        if budget is not None and total > budget:
            loose = [f'"{r.name}"' for r in self.rules if not r.blocked]
            why = f" {', '.join(loose)} compares every pair: no exact, normalized, prefix, Soundex or token comparison narrows it." if loose else ""
            raise Invalid(f"these rules would need {total:,} comparisons, over the limit of {budget:,}.{why}")
        return total

    def _allow(self, budget: int | None, check: bool) -> None:
        if check:
            self.check_ids()
        if budget is not None:
            self.admit(budget)

    def _each(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.rule_links(i) for i in range(len(self.rules))])

    def _by_pair(self, each: DataFrame, unique: bool) -> DataFrame:
        """Links of all rules by pair; a single rule finds a pair once, if ids are ``unique``."""
        if unique and len(self.rules) == 1:
            each = each.select("a", "b", F.col("confidence").alias("score"), "strength", F.array(F.lit(0)).alias("rules"))
        else:
            each = each.groupBy("a", "b").agg(F.max("confidence").alias("score"), F.max("strength").alias("strength"), rules_of(len(self.rules)).alias("rules"))
        return each.select("a", "b", rounded(F.col("score"), 3).alias("score"), rounded(F.col("strength"), 3).alias("strength"), "rules")

    def links(self, budget: int | None = MAX_COMPARISONS, check: bool = True) -> DataFrame:
        """The links of a run that keeps all, for those who want nothing else of it: not written through."""
        self._allow(budget, check)
        return self._by_pair(self._each(), check).withColumn("chosen", F.lit(True))

    def run(self, policy: str = "all", budget: int | None = MAX_COMPARISONS, check: bool = True) -> Match:
        """All results under a link policy.

        Ids are checked first, then the cost against the budget, both from aggregates, before any pair is made; a
        budget of None asks for no limit. The links are written through once; what is made from them reads them there.
        """
        if policy not in POLICIES:
            raise Invalid(f'unknown link policy "{policy}"; use "all" or "best"')
        self._allow(budget, check)
        each = write_through(self._each(), "links")
        links = self._by_pair(each, check)
        ranked = rank_candidates(links)
        picks = ranked.where("rank = 1").select(F.col("id"), F.col("other"))
        if policy == "best":
            kept = picks.select(F.least("id", "other").alias("x"), F.greatest("id", "other").alias("y")).distinct().withColumn("chosen", F.lit(True))
            same = (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y"))
            links = links.join(kept, same, "left").drop("x", "y").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
        else:
            links = links.withColumn("chosen", F.lit(True))
        cost = self.cost()
        per_rule = cost.join(each.groupBy("rule").agg(F.count("*").alias("linked")), "rule", "left").select("rule", "name", F.coalesce("linked", F.lit(0)).alias("linked"), "compared", "blocked")
        pairs = links.where("chosen").select("a", "b", "score", "rules")
        compared = reduce(DataFrame.unionByName, [df.select(F.col("l_id").alias("a"), F.col("r_id").alias("b")) for r in self.rules for df, _ in self._compared(r)]).distinct()
        return Match(links, pairs, picks, compared, per_rule, cost, ranked)


def rules_of(count: int) -> Column:
    """The sorted numbers of a group's rules; as bits of a number, which is summed up without a sort, if they fit."""
    if count > 62:
        return F.array_sort(F.collect_set("rule"))
    bits = F.bit_or(F.expr("shiftleft(1L, rule)"))
    return F.filter(F.array(*[F.when(F.getbit(bits, F.lit(i)) == 1, F.lit(i)) for i in range(count)]), lambda i: i.isNotNull())


def rank_candidates(links: DataFrame) -> DataFrame:
    """Each record's candidates, best first: score, number of rules, strength, then the smaller id."""
    both = links.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("x"), "score", "strength", "rules")
    by = Window.partitionBy("id").orderBy(F.desc("score"), F.desc(F.size("rules")), F.desc("strength"), "other")
    return both.select("x.id", "x.other", "score", "strength", "rules").withColumn("rank", F.row_number().over(by))


def candidates_of(match: Match, record: str) -> DataFrame:
    """Ranked candidates of one record, with what the policy linked and what was picked."""
    me = match.ranked.where(F.col("id") == record)
    chosen = match.links.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "chosen")
    same = (F.least("id", "other") == F.col("x")) & (F.greatest("id", "other") == F.col("y"))
    return me.join(chosen, same).select(F.col("other").alias("to"), "rank", "score", "strength", "rules", F.col("chosen").alias("linked"), (F.col("rank") == 1).alias("picked"))

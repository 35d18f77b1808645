"""Record generation: every entity is a plan over ``spark.range``, every cell a function of the seed and its place.

A schema whose rows take a fixed number of draws replays one seeded stream; with repeats, unique references,
duplicates or formulas that draw, each cell has a stream of its own, so results never depend on partitioning.
Columns are named by the fields' full names; ``nested`` builds the structured view.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import modules as M
from ..functions import pools as P
from ..functions import rng as R
from .formula import Scope, compile_formula
from .rules import leading_number
from .schema import Entity, Field, whole
from .storage import write_through

#: Draws of each fixed-draw type; others are known from their options.
DRAWS = {"Row Number": 0, "Static Value": 0, "Full Name": 2, "Email": 2, "Street Address": 2, "Phone": 3, "UUID": 31}
IX, VARIANT = "__ix", "__variant"


def draws_of(f: Field) -> int | None:
    """How many draws a cell takes; None if that depends on data."""
    if f.repeat or f.type in ("Formula (JS)", "Faker (any)") or (f.type == "Reference" and f.opts.get("unique") == "1"):
        return None
    if f.type == "Lorem Words":
        return max(0, whole(f.opts["count"], 3))
    if f.type == "Custom List":
        return 1 if _listed(f) else 0
    if f.type == "Date":
        return 0 if _bounds(f) is None else 1
    return DRAWS.get(f.type, 1)


def _listed(f: Field) -> list[str]:
    return [x.strip() for x in f.opts["values"].split(",") if x.strip()]


def _millis(text: str) -> int | None:
    from datetime import datetime, timezone

    try:
        at = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    except ValueError:
        return None
    return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1000)


def _bounds(f: Field) -> tuple[int, int] | None:
    lo, hi = _millis(f.opts["from"]), _millis(f.opts["to"])
    if lo is None and hi is None:
        return None
    lo, hi = (hi if lo is None else lo), (lo if hi is None else hi)
    return lo, max(lo, hi)


#: The tokens of date formats and what Spark calls them.
DATE_TOKENS = {"YYYY": "yyyy", "MM": "MM", "DD": "dd", "HH": "HH", "mm": "mm", "ss": "ss"}


def date_text(millis: Column, shape: str) -> Column:
    at = F.timestamp_millis(millis)
    parts = [F.date_format(at, DATE_TOKENS[p]) if p in DATE_TOKENS else F.lit(p) for p in re.split("(YYYY|MM|DD|HH|mm|ss)", shape) if p]
    return F.concat(*parts) if parts else F.lit("")


def value_of(f: Field, u: R.Draws, row: Column) -> Column:
    """The value of a cell from its draws. References and formulas are made elsewhere."""
    t, o = f.type, f.opts
    if t == "Number":
        lo, hi = leading_number(o["min"]), leading_number(o["max"])
        lo, hi = 1.0 if lo is None else lo, 100.0 if hi is None else hi
        lo, hi = min(lo, hi), max(lo, hi)
        places = min(max(whole(o["decimals"], 0), 0), 8)
        x = F.lit(lo) + u(0) * F.lit(hi - lo)
        return F.round(x, places) if places else F.floor(x + F.lit(0.5))
    if t == "Date":
        span = _bounds(f)
        return F.lit("") if span is None else date_text(F.floor(F.lit(float(span[0])) + u(0) * F.lit(float(span[1] - span[0]))), o["dateFormat"] or "YYYY-MM-DD")
    if t == "Custom List":
        return R.choice(u(0), _listed(f)) if _listed(f) else F.lit("")
    if t == "Lorem Words":
        n = max(0, whole(o["count"], 3))
        return F.concat_ws(" ", *[R.choice(u(i), P.WORDS) for i in range(n)])
    if t == "Faker (any)":
        return M.catalog()[o["method"].strip()](u)
    simple = {
        "Row Number": lambda: row + 1,
        "First Name": lambda: M.first(u(0)),
        "Last Name": lambda: M.last(u(0)),
        "Full Name": lambda: M.full(u),
        "Email": lambda: F.concat(F.lower(M.first(u(0))), F.lit("."), F.lower(M.last(u(1))), F.lit("@example.com")),
        "Phone": lambda: F.concat(F.lit("("), R.integer(u(0), 200, 989).cast("string"), F.lit(") "), R.integer(u(1), 200, 989).cast("string"), F.lit("-"), M.padded(R.integer(u(2), 0, 9999), 4)),
        "Street Address": lambda: F.concat_ws(" ", R.integer(u(0), 10, 9999).cast("string"), R.choice(u(1), P.STREET)),
        "City": lambda: R.choice(u(0), P.CITY),
        "State": lambda: R.choice(u(0), P.STATE),
        "State Abbr": lambda: R.choice(u(0), P.STATE_ABBR),
        "Zip Code": lambda: R.integer(u(0), 10000, 99999).cast("string"),
        "Country": lambda: R.choice(u(0), P.COUNTRY),
        "Company": lambda: R.choice(u(0), P.COMPANY),
        "Job Title": lambda: R.choice(u(0), P.JOB),
        "UUID": lambda: M.uuid(u),
        "Boolean": lambda: u(0) < 0.5,
        "Static Value": lambda: F.lit(o["value"]),
    }
    return simple[t]()


@dataclass
class Generated:
    """A generated entity: flat records in output order (``__ix``), its spec, and messages."""

    entity: Entity
    rows: DataFrame
    match_field: str | None = None
    messages: list[str] = field(default_factory=list)

    def flat(self) -> DataFrame:
        """The records' own columns."""
        names = ([self.match_field] if self.match_field else []) + [f.name for f in self.entity.fields]
        return self.rows.select(*[F.col(f"`{n}`") for n in names])


def dense_index(df: DataFrame, *order: Column, name: str = IX) -> DataFrame:
    """Number rows 0, 1, ... in an order without passing them through one task: range partitions and their sizes."""
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = write_through(df.repartitionByRange(parts, *order).withColumn("__pid", F.spark_partition_id()), "index")
    sizes = ranged.groupBy("__pid").agg(F.count("*").alias("__n"))
    before = sizes.select("__pid", F.coalesce(F.sum("__n").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__pid").orderBy(*order))
    return ranged.withColumn("__row", within).join(F.broadcast(before), "__pid").withColumn(name, F.col("__before") + F.col("__row") - 1).drop("__pid", "__row", "__before")


class Generator:
    """Generates the entities of a schema in their order; later ones may refer to earlier ones."""

    def __init__(self, spark: SparkSession, entities: list[Entity], counts: dict[str, int], seed: int):
        self.spark, self.entities, self.counts, self.seed = spark, entities, counts, seed
        self.done: dict[str, Generated] = {}
        self.skip: int | None = 0  # draws that the stream has taken so far; None once they cannot be told

    def run(self) -> dict[str, Generated]:
        for e in self.entities:
            self.done[e.name] = self._entity(e)
        return self.done

    def _entity(self, e: Entity) -> Generated:
        n, messages = self.counts[e.name], []
        base = self.spark.range(n).select(F.col("id").alias(IX))
        fixed = [draws_of(f) for f in e.fields]
        per_row = sum(x or 0 for x in fixed)
        streamed = self.skip is not None and all(x is not None for x in fixed) and e.dup_level == "off"
        # Draws are columns before they are used: a value may use one several times.
        stream = None
        if streamed and per_row:
            base = base.withColumn("__draws", R.row_draws(self.seed, F.col(IX), per_row, self.skip))
            stream = R.from_array(F.col("__draws"))
        cells = {} if streamed else {f.name: f"__cell_{i}" for i, f in enumerate(e.fields) if f.type not in ("Formula (JS)", "Reference") and not f.repeat and fixed[i] != 0}
        for f in e.fields:
            if f.name in cells:
                base = base.withColumn(cells[f.name], R.cell_draws(R.cell_key(self.seed, e.name, f.name, F.col(IX)), self._width(f)))
        taken, columns, references, counts = 0, [], [], {}
        for f in e.fields:
            if f.repeat and f.repeat[0] not in counts:
                path, (lo, hi) = f.repeat
                counts[path] = R.integer(R.cell_stream(R.cell_key(self.seed, e.name, "repeat", path, F.col(IX)), 1)(0), lo, hi).cast("int")
        for f, k in zip(e.fields, fixed):
            if f.type == "Formula (JS)":
                continue
            if f.type == "Reference":
                u = stream and (lambda i, t=taken: stream(t + i))
                references.append((f, u(0) if u else None))
                taken += k or 0
                continue
            if f.repeat:
                columns.append(self._repeated(e, f, counts[f.repeat[0]]).alias(f.name))
                continue
            u = R.from_array(F.col(cells[f.name])) if f.name in cells else (lambda i, t=taken: stream(t + i))
            taken += k or 0
            columns.append(value_of(f, u, F.col(IX)).alias(f.name))
        # Draws of references are columns until they are joined to positions.
        drawn = [(u if u is not None else R.cell_stream(R.cell_key(self.seed, e.name, f.name, F.col(IX)), 1)(0)).alias(f"__u{i}") for i, (f, u) in enumerate(references)]
        sizes = [c.alias(f"__count_{i}") for i, c in enumerate(counts.values())]
        rows = base.select(IX, *columns, *drawn, *sizes)
        for i, (f, _) in enumerate(references):
            rows = self._reference(rows, e, f, f"__u{i}", list(counts).index(f.repeat[0]) if f.repeat else None, messages)
        self.skip = self.skip + n * per_row if streamed else None
        match = None
        if e.dup_level != "off" and e.fields:
            from .duplicates import inject

            match = "match_id"
            while any(f.name == match for f in e.fields):
                match = "_" + match
            rows = inject(rows, e, self.seed, match)
            numbers = [f.name for f in e.fields if f.type == "Row Number" and not f.repeat]
            rows = rows.withColumns({x: F.col(IX) + 1 for x in numbers}) if numbers else rows
        rows = self._formulas(rows, e, list(counts))
        return Generated(e, rows, match, messages)

    def _width(self, f: Field) -> int:
        return 96 if f.type == "Faker (any)" else max(1, draws_of(f) or 31)

    def _repeated(self, e: Entity, f: Field, count: Column) -> Column:
        one = lambda j: value_of(f, R.cell_stream(R.cell_key(self.seed, e.name, f.name, F.col(IX), j), self._width(f)), F.col(IX))
        return F.transform(F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")), one)

    def _pool(self, f: Field) -> DataFrame:
        """(pos, value) of the values that a reference may take, in output order."""
        source = self.done[f.opts["entity"].strip()]
        name = f.opts["field"].strip()
        of = next(x for x in source.entity.fields if x.name == name)
        rows = source.rows.select(F.col(IX).alias("__pos"), F.col(f"`{name}`").alias("__value"))
        if not of.repeat:
            return rows
        flat = rows.select("__pos", F.posexplode("__value").alias("__k", "__value"))
        return dense_index(flat.withColumnRenamed("__pos", "__r"), F.col("__r"), F.col("__k"), name="__pos").select("__pos", "__value")

    def _reference(self, rows: DataFrame, e: Entity, f: Field, u: str, count: int | None, messages: list[str]) -> DataFrame:
        name = f.opts["entity"].strip()
        if name not in self.done:
            messages.append(f"Reference {name}.{f.opts['field']}: no values")
            missing = F.lit("#REF") if count is None else F.array_repeat(F.lit("#REF"), F.col(f"__count_{count}"))
            return rows.withColumn(f.name, missing).drop(u)
        pool = self._pool(f)
        value = F.col("__value")
        size = pool.count()
        if f.opts.get("unique") == "1":
            return self._unique(rows, e, f, pool, size, count).drop(u)
        if count is None:
            at = F.floor(F.col(u) * F.lit(float(size))).alias("__pos")
            return rows.withColumn("__pos", at).join(pool, "__pos", "left").withColumn(f.name, F.coalesce(value.cast("string"), F.lit("#REF")) if not size else value).drop("__pos", "__value", u)
        wanted = rows.select(IX, F.explode(F.when(F.col(f"__count_{count}") > 0, F.sequence(F.lit(1), F.col(f"__count_{count}")))).alias("__k"))
        draw = R.cell_stream(R.cell_key(self.seed, e.name, f.name, F.col(IX), F.col("__k")), 1)(0)
        met = wanted.withColumn("__pos", F.floor(draw * F.lit(float(size)))).join(pool, "__pos", "left")
        return self._gathered(rows, met, f, u)

    def _unique(self, rows: DataFrame, e: Entity, f: Field, pool: DataFrame, size: int, count: int | None) -> DataFrame:
        """Without replacement: both sides are numbered, the pool in a seeded shuffle; what is left over is #REF."""
        shuffled = dense_index(pool, F.xxhash64(F.lit(self.seed), F.lit(e.name), F.lit(f.name), F.col("__pos")), F.col("__pos"), name="__turn").select("__turn", "__value")
        if count is None:
            return rows.join(shuffled, F.col(IX) == F.col("__turn"), "left").withColumn(f.name, F.coalesce(F.col("__value").cast("string"), F.lit("#REF"))).drop("__turn", "__value")
        wanted = rows.select(IX, F.explode(F.when(F.col(f"__count_{count}") > 0, F.sequence(F.lit(1), F.col(f"__count_{count}")))).alias("__k"))
        numbered = dense_index(wanted, F.col(IX), F.col("__k"), name="__turn")
        return self._gathered(rows, numbered.join(shuffled, "__turn", "left"), f, "__none")

    def _gathered(self, rows: DataFrame, met: DataFrame, f: Field, u: str) -> DataFrame:
        lists = met.groupBy(IX).agg(F.array_sort(F.collect_list(F.struct("__k", F.coalesce(F.col("__value").cast("string"), F.lit("#REF")).alias("v")))).alias("__list"))
        return rows.join(lists, IX, "left").withColumn(f.name, F.coalesce(F.transform("__list", lambda x: x["v"]), F.array().cast("array<string>"))).drop("__list", u)

    def _formulas(self, rows: DataFrame, e: Entity, paths: list[str]) -> DataFrame:
        """Formulas in field order, so that later ones see earlier ones; over final values, variants included."""
        for f in e.fields:
            if f.type != "Formula (JS)":
                continue
            made = compile_formula(f.opts["expr"])
            repeats = {x.name for x in e.fields if x.repeat}
            kinds = dict(rows.dtypes)

            def kind(n):
                t = kinds.get(n, "string").removeprefix("array<").removesuffix(">")
                return {"string": "text", "boolean": "truth"}.get(t, "number")

            def reach(n, j=None):
                if n not in kinds:
                    return F.lit(None).cast("string")
                own = F.col(f"`{n}`")
                return F.coalesce(F.try_element_at(own, F.lit(1) if j is None else j), F.try_element_at(own, F.lit(1))) if n in repeats else own

            every = lambda n: F.col(f"`{n}`") if n in repeats else F.array(reach(n))
            variant = F.col(VARIANT) if VARIANT in rows.columns else F.lit(0)
            draw = lambda j: lambda i: R.cell_stream(R.cell_key(self.seed, e.name, f.name, F.col(IX), variant, j, F.lit(i)), 1)(0)
            if f.repeat:
                count = F.col(f"__count_{paths.index(f.repeat[0])}")
                own = F.transform(
                    F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")),
                    lambda j: made(Scope(lambda n: reach(n, j), every, j - 1, kind, draw(j))).text(),
                )
            else:
                v = made(Scope(reach, every, F.lit(0), kind, draw(F.lit(0))))
                own = v.column
            rows = rows.withColumn(f.name, own)
        return rows

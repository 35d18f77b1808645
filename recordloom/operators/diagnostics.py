"""Why a pair links or not: explanations, attribution of misses, kinds of change, audits of variants, what-if."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import similarity as S
from .matcher import _kind_of, field_column, key_of, measure_of, rounded, test_of
from .rules import KINDS, Rule

#: Kinds of change in their order, with labels.
CHANGES = {
    "case": "case only",
    "spacing": "spacing only",
    "typo": "typo (1–2 edits)",
    "fuzzed": "fuzzed (several edits)",
    "digits": "digits changed",
    "date": "date shifted",
    "format": "reformatted",
    "blanked": "blanked",
    "filled": "filled in",
    "regenerated": "id regenerated",
    "derived": "derived (formula)",
    "other": "rewritten",
}
#: Fixed value: what a universally unique identifier looks like.
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def _sides(pairs: DataFrame, records: DataFrame, rules: list[Rule], id_field: str) -> DataFrame:
    """Pairs (a, b, ...) with the rules' fields of both records; pairs with an unknown end go."""
    fields = sorted({c.field for r in rules for c in r.comparisons})
    value = lambda p: K.text(field_column(records, p), _kind_of(records, field_column(records, p)))
    own = records.select(value(id_field).alias("id"), *[value(f).alias(f"f{i}") for i, f in enumerate(fields)])
    for s in "ab":
        pairs = pairs.join(own.select(F.col("id").alias(s), *[F.col(f"f{i}").alias(f"{s}_f{i}") for i in range(len(fields))]), s)
    return pairs


def explanation(rules: list[Rule], side: Callable[[str, str], Column]) -> Column:
    """An array of (rule, name, passed, evaluated_nothing, comparisons) for two records, nothing short-circuited."""
    out = []
    for i, rule in enumerate(rules):
        rows = []
        for j, c in enumerate(rule.comparisons):
            a, b = side("a", c.field), side("b", c.field)
            blank = K.is_blank(a) | K.is_blank(b)
            measured = measure_of(c, a, b)
            shown = F.lit(None).cast("double") if measured is None else F.when(~blank, rounded(measured, 3))
            rows.append(
                F.struct(
                    F.lit(j).alias("comparison"),
                    F.lit(c.field).alias("field"),
                    F.lit(c.kind).alias("kind"),
                    F.lit(KINDS[c.kind].label).alias("label"),
                    F.lit(c.arg).alias("arg"),
                    F.coalesce(a, F.lit("")).alias("a"),
                    F.coalesce(b, F.lit("")).alias("b"),
                    shown.alias("measured"),
                    F.lit(KINDS[c.kind].unit).alias("unit"),
                    (blank & F.lit(rule.blankAgrees)).alias("skipped"),
                    F.when(blank, F.lit(rule.blankAgrees)).otherwise(test_of(c, a, b)).alias("passed"),
                    (~blank).alias("evaluated"),
                )
            )
        every = F.array(*rows)
        evaluated = F.exists(every, lambda x: x["evaluated"])
        passed = F.forall(every, lambda x: x["passed"]) & evaluated
        name = rule.name or f"Rule {i + 1}"
        out.append(F.struct(F.lit(i).alias("rule"), F.lit(name).alias("name"), passed.alias("passed"), (~evaluated).alias("evaluated_nothing"), every.alias("comparisons")))
    return F.array(*out)


def explain_pairs(rules: list[Rule], records: DataFrame, pairs: DataFrame, id_field: str) -> DataFrame:
    """A row for each pair, rule and comparison: values, what was measured, whether it was skipped and passed."""
    return exploded(explained(rules, records, pairs, id_field))


def explained(rules: list[Rule], records: DataFrame, pairs: DataFrame, id_field: str) -> DataFrame:
    """Pairs with the array of explanations."""
    fields = sorted({c.field for r in rules for c in r.comparisons})
    joined = _sides(pairs, records, rules, id_field)
    side = lambda s, f: F.col(f"{s}_f{fields.index(f)}")
    return joined.select(*pairs.columns, explanation(rules, side).alias("explained"))


def exploded(df: DataFrame) -> DataFrame:
    """The explanations of ``explained`` a row each comparison."""
    keep = [c for c in df.columns if c != "explained"]
    by_rule = df.select(*keep, F.explode("explained").alias("r"))
    rows = by_rule.select(*keep, F.col("r.rule").alias("rule"), F.col("r.name").alias("name"), F.col("r.passed").alias("rule_passed"), F.col("r.evaluated_nothing").alias("evaluated_nothing"), F.explode("r.comparisons").alias("c"))
    fields = ("comparison", "field", "kind", "arg", "a", "b", "measured", "unit", "skipped", "passed")
    return rows.select(*keep, "rule", "name", "rule_passed", "evaluated_nothing", *[F.col(f"c.{f}").alias(f if f not in ("a", "b") else f"value_{f}") for f in fields])


def attribute_misses(rules: list[Rule], records: DataFrame, missed: DataFrame, id_field: str) -> tuple[DataFrame, DataFrame]:
    """(a row a rule: misses, near_misses, blank_only, inspected; a row a comparison: how many pairs it sank).

    ``misses`` counts all given pairs, the rest those whose records are known. Comparisons count by their place.
    """
    by_rule = explained(rules, records, missed.select("a", "b"), id_field).select(F.explode("explained").alias("r"))
    failing = F.filter("r.comparisons", lambda c: ~c["passed"])
    given = missed.agg(F.count("*").alias("misses"))
    lost = F.col("r.passed") == F.lit(False)
    summary = by_rule.groupBy(F.col("r.rule").alias("rule"), F.col("r.name").alias("name")).agg(
        F.count_if(lost & (F.size(failing) == 1)).alias("near_misses"), F.count_if(lost & F.col("r.evaluated_nothing")).alias("blank_only"), F.count("*").alias("inspected")
    )
    spark = records.sparkSession
    names = spark.createDataFrame([(i, r.name or f"Rule {i + 1}") for i, r in enumerate(rules)], "rule int, name string")
    slots = spark.createDataFrame([(i, j, c.field, c.kind) for i, r in enumerate(rules) for j, c in enumerate(r.comparisons)], "rule int, comparison int, field string, kind string")
    sunk = by_rule.where(lost).select(F.col("r.rule").alias("rule"), F.explode(failing).alias("c")).groupBy("rule", F.col("c.comparison").alias("comparison")).agg(F.count("*").alias("count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    head = names.join(summary.drop("name"), "rule", "left").join(given).select("rule", "name", "misses", zero("near_misses"), zero("blank_only"), zero("inspected"))
    return head, slots.join(sunk, ["rule", "comparison"], "left").select("rule", "comparison", "field", "kind", zero("count"))


def classify_change(before: Column, after: Column, kind: str = "") -> Column:
    """What was done to a value; null if nothing. The first that fits, in the order below."""
    a, b = F.coalesce(before.cast("string"), F.lit("")), F.coalesce(after.cast("string"), F.lit(""))
    if kind.lower().startswith("formula"):
        return F.when(a != b, F.lit("derived"))
    squash = lambda x: F.lower(F.regexp_replace(x, r"(?U)\s+", ""))
    digits = lambda x: F.regexp_replace(x, "[^0-9]", "")
    mask = lambda x: F.regexp_replace(x, "[0-9]", "#")
    la, lb = F.lower(a), F.lower(b)
    mail = F.contains(a, F.lit("@")) & F.contains(b, F.lit("@")) & (squash(F.replace(a, F.lit("."))) == squash(F.replace(b, F.lit("."))))
    date = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    return (
        F.when(a == b, F.lit(None).cast("string"))
        .when(~K.is_blank(a) & K.is_blank(b), F.lit("blanked"))
        .when(K.is_blank(a) & ~K.is_blank(b), F.lit("filled"))
        .when(a.rlike(UUID) & b.rlike(UUID), F.lit("regenerated"))
        .when(la == lb, F.lit("case"))
        .when(squash(a) == squash(b), F.lit("spacing"))
        .when(a.rlike(date) & b.rlike(date), F.lit("date"))
        .when((F.length(digits(a)) >= 4) & (digits(a) == digits(b)), F.lit("format"))
        .when(mail, F.lit("format"))
        .when((F.length(digits(a)) >= 3) & (F.length(digits(a)) == F.length(digits(b))) & (mask(a) == mask(b)), F.lit("digits"))
        .when(F.levenshtein(la, lb) <= 2, F.lit("typo"))
        .when(S.levenshtein_similarity(la, lb) >= 0.5, F.lit("fuzzed"))
        .otherwise(F.lit("other"))
    )


def audit_variants(rules: list[Rule], records: DataFrame, variants: DataFrame, id_field: str) -> DataFrame:
    """Variants (id, original_id, changes array<struct<field, kind>>) against every rule, rolled up.

    rule, dimension ('all', 'kind' or 'field'), value, caught, lost: a variant counts once for each kind and each
    field it carries. One pass explodes each variant's few groupings; the rollup combines before the exchange.
    """
    asked = variants.select(F.col("original_id").cast("string").alias("a"), F.col("id").cast("string").alias("b"), "changes")
    by = explained(rules, records, asked, id_field).select("changes", F.explode("explained").alias("r"))
    one = lambda d, v: F.struct(F.lit(d).alias("dimension"), v.alias("value"))
    part = lambda d, f: F.transform(F.array_distinct(F.transform(F.coalesce("changes", F.array()), lambda c: c[f])), lambda v: one(d, v))
    groups = F.concat(F.array(one("all", F.lit(""))), part("kind", "kind"), part("field", "field"))
    return by.select(F.col("r.rule").alias("rule"), F.col("r.passed").alias("passed"), F.explode(groups).alias("g")).groupBy("rule", "g.dimension", "g.value").agg(F.count_if("passed").alias("caught"), F.count_if(~F.col("passed")).alias("lost"))


def audit_totals(rules: list[Rule], records: DataFrame, variants: DataFrame, id_field: str) -> DataFrame:
    """inspected, caught (by any rule), lost."""
    asked = variants.select(F.col("original_id").cast("string").alias("a"), F.col("id").cast("string").alias("b"))
    hit = explained(rules, records, asked, id_field).select(F.exists("explained", lambda r: r["passed"]).alias("hit"))
    return hit.agg(F.count("*").alias("inspected"), F.count_if("hit").alias("caught"), F.count_if(~F.col("hit")).alias("lost"))


def what_if(rules: list[Rule], records: DataFrame, field: str, damage: Callable[[Column, Column], Column], samples: int = 25, kind: str = "") -> tuple[DataFrame, DataFrame]:
    """(outcomes: value, count, change and the rules that still accept it; survival: a row a rule).

    ``damage`` maps (value, number of the draw) to a damaged value as a Column; each record is drawn ``samples`` times.
    """
    samples = max(1, samples)
    original = K.text(field_column(records, field), _kind_of(records, field_column(records, field)))
    drawn = records.select("*", original.alias("__from"), F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("__draw"))
    value = F.coalesce(damage(F.col("__from"), F.col("__draw")).cast("string"), F.lit(""))
    seen = drawn.withColumn("__to", value).groupBy(*[c for c in drawn.columns if c != "__draw"], "__to").agg(F.count("*").alias("count"))
    own = lambda f: K.text(field_column(records, f), _kind_of(records, field_column(records, f)))
    side = lambda s, f: F.col("__to") if s == "b" and f == field else own(f)
    found = seen.select("__from", F.col("__to").alias("value"), "count", classify_change(F.col("__from"), F.col("__to"), kind).alias("change"), explanation(rules, side).alias("explained"))
    accepted = F.transform(F.filter("explained", lambda r: r["passed"]), lambda r: r["rule"])
    outcomes = found.groupBy("value", "change", accepted.alias("accepted")).agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "value")
    return outcomes, _survival(rules, records, field, damage, samples)


def _survival(rules: list[Rule], records: DataFrame, field: str, damage: Callable[[Column, Column], Column], samples: int) -> DataFrame:
    """A row a rule: how many draws it still accepts.

    What the draws leave as it is, is judged once for each record; records are dealt out, for there are many draws of
    each. No explanation is made and no draw is brought together with its likes.
    """
    spark = records.sparkSession
    fields = sorted({c.field for r in rules for c in r.comparisons})
    own = lambda f: K.text(field_column(records, f), _kind_of(records, field_column(records, f)))
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = records.select(*[own(f).alias(f"v{i}") for i, f in enumerate({field: 0} | dict.fromkeys(fields))]).repartition(tasks)
    at = {f: F.col(f"v{i}") for i, f in enumerate({field: 0} | dict.fromkeys(fields))}
    told, drawn = {}, []
    for i, r in enumerate(rules):
        for j, c in enumerate(r.comparisons):
            v, name = at[c.field], f"{i}_{j}"
            if c.field != field:
                told |= {f"b{name}": K.is_blank(v), f"t{name}": F.when(K.is_blank(v), F.lit(r.blankAgrees)).otherwise(test_of(c, v, v))}
                drawn.append((i, F.col(f"t{name}"), ~F.col(f"b{name}")))
            else:
                blank = F.col("b") | F.col("__blank")
                test = test_of(c, v, F.col("__to"))
                if KINDS[c.kind].blocks:
                    told[f"k{name}"] = key_of(c, v)
                    test = F.col(f"k{name}") == key_of(c, F.col("__to"))
                drawn.append((i, F.when(blank, F.lit(r.blankAgrees)).otherwise(test), ~blank))
    base = base.select(at[field].alias("__from"), at[field], K.is_blank(at[field]).alias("b"), *[x.alias(k) for k, x in told.items()])
    each = base.withColumn("__draw", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    each = each.withColumn("__to", F.coalesce(damage(F.col("__from"), F.col("__draw")).cast("string"), F.lit(""))).withColumn("__blank", K.is_blank(F.col("__to")))
    passed = []
    for i in range(len(rules)):
        every, some = [x for k, x, _ in drawn if k == i], [x for k, _, x in drawn if k == i]
        passed.append(reduce(lambda x, y: x & y, every) & reduce(lambda x, y: x | y, some))
    sums = each.agg(F.count("*").alias("samples"), *[F.count_if(p).alias(f"n{i}") for i, p in enumerate(passed)])
    rows = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(r.name or f"Rule {i + 1}").alias("name"), F.col(f"n{i}").alias("survived")) for i, r in enumerate(rules)])
    return sums.where("samples > 0").select("samples", F.explode(rows).alias("r")).select("r.rule", "r.name", "r.survived", "samples", (F.col("r.survived") / F.col("samples")).alias("rate"))

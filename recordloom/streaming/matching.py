"""Records that arrive in a stream, matched against a table of known records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators.matcher import field_column, key_of, passes, strength
from ..operators.rules import KINDS, Invalid, Rule


def match_stream(arriving: DataFrame, known: DataFrame, rules: list[Rule], id_field: str) -> DataFrame:
    """Links a, b, rule, confidence, strength of arriving records to known ones: stream-static keyed joins.

    Every rule needs an equality comparison (an unblocked rule would compare each arrival with the whole table). The
    join keeps no state, so the stream may run for ever; each arrival is matched with the table as it is then.
    """
    if loose := [r.name for r in rules if not r.blocked]:
        raise Invalid(f"rules without a key cannot run on a stream: {', '.join(loose)}")
    fields = sorted({c.field for r in rules for c in r.comparisons})

    def side(df: DataFrame, s: str) -> DataFrame:
        value = lambda p: field_column(df, p).cast("string")
        return df.select(value(id_field).alias(f"{s}_id"), *[value(f).alias(f"{s}_{i}") for i, f in enumerate(fields)])

    left, right, out = side(arriving, "l"), side(known, "r"), []
    at = lambda s: {f: F.col(f"{s}_{i}") for i, f in enumerate(fields)}
    for i, rule in enumerate(rules):
        blocks = [c for c in rule.comparisons if KINDS[c.kind].blocks]
        full = lambda s: reduce(lambda x, y: x & y, [~K.is_blank(at(s)[c.field]) for c in blocks])
        keyed = lambda df, s: df.where(full(s)).withColumns({f"{s}_k{j}": key_of(c, at(s)[c.field]) for j, c in enumerate(blocks)})
        same = reduce(lambda x, y: x & y, [F.col(f"l_k{j}") == F.col(f"r_k{j}") for j in range(len(blocks))])
        met = keyed(left, "l").join(keyed(right, "r"), same).where(passes(rule, at("l"), at("r")))
        out.append(met.select(F.col("l_id").alias("a"), F.col("r_id").alias("b"), F.lit(i).alias("rule"), F.lit(rule.score).alias("confidence"), strength(rule, at("l"), at("r")).alias("strength")))
    return reduce(DataFrame.unionByName, out)

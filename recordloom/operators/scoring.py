"""Pairwise match quality against known truth.

Counts come from sizes, not from pairs: the pairs a set of links implies are sum n(n-1)/2 over components, the true
ones among them sum m(m-1)/2 over the parts of components that share a truth key. Only listings make pairs, and no more
than their limit calls for.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .closure import connected_components
from .matcher import rounded
from .rules import AUTO_MERGE, REVIEW_FLOOR, Invalid
from .storage import write_through

#: True pairs that may be enumerated by default; counts and listings enumerate none and have no such limit.
MAX_TRUE_PAIRS = 2_000_000
#: Default thresholds of a sweep.
THRESHOLDS = [i / 20 for i in range(10, 21)]


def halves(n: Column) -> Column:
    """n(n-1)/2 as a whole number."""
    return (n * (n - 1) / 2).cast("long")


def labels_of(df: DataFrame, id_field: str = "id", key: str = "key") -> DataFrame:
    """id, key as text, one row an id."""
    return df.select(F.col(id_field).cast("string").alias("id"), F.col(key).cast("string").alias("key"))


def truth_of(records: DataFrame, id_field: str, match_field: str = "match_id") -> DataFrame:
    """Labels from records; refuses blank ids or keys and repeated ids."""
    own = labels_of(records, id_field, match_field)
    head = own.agg(F.count_if(F.coalesce(F.trim("id"), F.lit("")) == "").alias("no_id"), F.count_if(F.coalesce(F.trim("key"), F.lit("")) == "").alias("no_key")).first()
    if head.no_id or head.no_key:
        raise Invalid(f'{head.no_id or head.no_key} records have no value in "{id_field if head.no_id else match_field}"')
    twice = own.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").orderBy("id").first()
    if twice:
        raise Invalid(f'the id "{twice.id}" is not unique')
    return own


def normalize_pairs(pairs: DataFrame) -> DataFrame:
    """a, b as text (and score); rows with a null end are refused by callers that count them."""
    own = [F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")]
    return pairs.select(*own, *([F.col("score").cast("double").alias("score")] if "score" in pairs.columns else []))


def scored(pairs: DataFrame) -> tuple[bool, bool]:
    """(every pair has a finite score, some have)."""
    if "score" not in pairs.columns:
        return False, False
    fine = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf"))
    n, k = pairs.agg(F.count("*"), F.count_if(fine)).first()
    return bool(n) and n == k, 0 < k < n


def _canonical(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def true_pair_count(truth: DataFrame) -> DataFrame:
    """records, true_pairs."""
    return truth.groupBy("key").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.coalesce(F.sum(halves(F.col("n"))), F.lit(0)).alias("true_pairs"))


def true_pairs(truth: DataFrame, limit: int | None = MAX_TRUE_PAIRS) -> DataFrame:
    """All pairs of records that share a key; refused above the limit, before anything is enumerated."""
    if limit is not None:
        n = true_pair_count(truth).first().true_pairs
        if n > limit:
            raise Invalid(f"the labels imply {n:,} true pairs, over the limit of {limit:,}")
    x, y = truth.alias("x"), truth.alias("y")
    return x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def truth_summary(truth: DataFrame) -> DataFrame:
    """records, clusters, singletons, true_pairs, sizes (size -> clusters)."""
    by = truth.groupBy("key").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("c"))
    return by.agg(
        F.coalesce(F.sum(F.col("n") * F.col("c")), F.lit(0)).alias("records"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("clusters"),
        F.coalesce(F.sum(F.when(F.col("n") == 1, F.col("c"))), F.lit(0)).alias("singletons"),
        F.coalesce(F.sum(halves(F.col("n")) * F.col("c")), F.lit(0)).alias("true_pairs"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("n", "c")))).alias("sizes"),
    )


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / F.when(whole != 0, whole))


def quality(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 (four places; 0 where a denominator is 0) to tp, fp, fn."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select("*", rounded(p, 4).alias("precision"), rounded(r, 4).alias("recall"), rounded(ratio(2 * p * r, p + r), 4).alias("f1"))


def components_of(pairs: DataFrame) -> DataFrame:
    return connected_components(pairs.select("a", "b"))


def closed_counts(truth: DataFrame, components: DataFrame) -> DataFrame:
    """predicted_pairs, tp, fp of what components imply."""
    sizes = components.groupBy("component").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(halves(F.col("n"))), F.lit(0)).alias("predicted_pairs"))
    parts = components.join(truth, "id").groupBy("component", "key").agg(F.count("*").alias("m")).agg(F.coalesce(F.sum(halves(F.col("m"))), F.lit(0)).alias("tp"))
    return sizes.join(parts).withColumn("fp", F.col("predicted_pairs") - F.col("tp"))


def open_counts(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    marked = _marked(truth, _canonical(pairs))
    return marked.agg(F.count("*").alias("predicted_pairs"), F.count_if("hit").alias("tp")).withColumn("fp", F.col("predicted_pairs") - F.col("tp"))


def _marked(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs with whether both ends share a truth key; no pair is enumerated for it."""
    left, right = truth.select(F.col("id").alias("a"), F.col("key").alias("ka")), truth.select(F.col("id").alias("b"), F.col("key").alias("kb"))
    return pairs.join(left, "a", "left").join(right, "b", "left").select("a", "b", F.coalesce(F.col("ka") == F.col("kb"), F.lit(False)).alias("hit"))


def evaluate(truth: DataFrame, pairs: DataFrame, close: bool = True) -> DataFrame:
    """One row: records, true_pairs, predicted_pairs, tp, fp, fn, precision, recall, f1, unknown_id_count, self_pairs_ignored."""
    pairs = normalize_pairs(pairs)
    linked = pairs.where("a <> b")
    counts = closed_counts(truth, components_of(linked)) if close else open_counts(truth, linked)
    base = true_pair_count(truth)
    unknown = unknown_ids(truth, pairs).agg(F.count("*").alias("unknown_id_count"))
    own = pairs.agg(F.count_if(F.col("a") == F.col("b")).alias("self_pairs_ignored"))
    every = base.join(counts).withColumn("fn", F.col("true_pairs") - F.col("tp")).join(unknown).join(own)
    return quality(every).select("records", "true_pairs", "predicted_pairs", "tp", "fp", "fn", "precision", "recall", "f1", "unknown_id_count", "self_pairs_ignored")


def unknown_ids(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """Ids of links that the truth does not know."""
    ends = normalize_pairs(pairs).where("a <> b").select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return ends.join(truth, "id", "left_anti")


def _unlike(members: DataFrame, limit: int, groups_first: bool) -> DataFrame:
    """The first pairs a < b of one group whose marks differ, from (grp, id, mark): grp, a, b, at most ``limit``.

    In order of (grp, a, b), or of (a, b). Every id gives a pair unless all later ids of its group share its mark, so
    the first ``limit`` ids that give one are all the first ends there can be. Their partners are among the first ids
    of the group once no mark is there more than 2 * ``limit`` times: of those at most ``limit`` come before a first
    end, and what was left out has ``limit`` others of its mark before it. So no more than 4 * ``limit`` ids of a
    group are looked at, however large it is; the windows keep only such heads of their groups before the exchange.
    """
    whole = members.groupBy("grp").agg(F.max(F.struct("id", "mark")).alias("last"), F.min("mark").alias("lo"), F.max("mark").alias("hi")).where("lo <> hi").select("grp", "last")
    own = members.join(whole, "grp")
    turn = own.where("mark <> last.mark").groupBy("grp").agg(F.max("id").alias("turn"))
    first = own.join(turn, "grp").where(F.when(F.col("mark") == F.col("last.mark"), F.col("id") < F.col("turn")).otherwise(F.lit(True)))
    order = ["grp", "id"] if groups_first else ["id", "grp"]
    heads = first.select("grp", "id", "mark").orderBy(*order).limit(limit)
    near = members.join(F.broadcast(heads.select("grp").distinct()), "grp", "left_semi")
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("grp", "mark").orderBy("id"))).where(F.col("n") <= 2 * limit)
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("grp").orderBy("id"))).where(F.col("n") <= 4 * limit).drop("n")
    x, y = F.broadcast(heads).alias("x"), near.alias("y")
    found = y.join(x, (F.col("x.grp") == F.col("y.grp")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.mark") != F.col("y.mark")))
    found = found.select("x.grp", F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    return found.orderBy(*(["grp", "a", "b"] if groups_first else ["a", "b"])).limit(limit)


def _marks(labels: DataFrame, by: DataFrame, key: str) -> DataFrame:
    """grp (the truth key), id, and as mark what ``by`` says of the id; an id it does not know is alone."""
    mark = F.coalesce(F.concat(F.lit("k:"), F.col(f"m.{key}").cast("string")), F.concat(F.lit("i:"), F.col("t.id")))
    return labels.alias("t").join(by.alias("m"), F.col("t.id") == F.col("m.id"), "left").select(F.col("t.key").alias("grp"), F.col("t.id").alias("id"), mark.alias("mark"))


def _unpaired(truth: DataFrame, pairs: DataFrame, limit: int) -> DataFrame:
    """The first true pairs that are not among ``pairs``. An id is a first end if it has later true partners beyond
    its pairs; the first ``limit`` of those ids are enough."""
    known = _marked(truth, _canonical(normalize_pairs(pairs))).where("hit").select("a", "b")
    hits = known.groupBy("a").agg(F.count("*").alias("hits"))
    later = truth.withColumn("later", F.count("*").over(Window.partitionBy("key").orderBy(F.desc("id"))) - 1)
    open_ = later.join(hits, later["id"] == hits["a"], "left").where(F.col("later") > F.coalesce("hits", F.lit(0)))
    heads = F.broadcast(open_.select("key", "id").orderBy("id").limit(limit)).alias("x")
    found = truth.alias("y").join(heads, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")))
    found = found.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    return found.join(known, ["a", "b"], "left_anti").orderBy("a", "b").limit(limit)


def missed_matches(truth: DataFrame, pairs: DataFrame, close: bool = True, limit: int = 200) -> DataFrame:
    """The first true pairs, in order, that the links do not give; true pairs are not enumerated for it."""
    linked = normalize_pairs(pairs).where("a <> b")
    if not close:
        return _unpaired(truth, linked, limit)
    return _unlike(write_through(_marks(truth, components_of(linked), "component"), "missed"), limit, False).select("a", "b").orderBy("a", "b")


def false_merges(truth: DataFrame, pairs: DataFrame, close: bool = True, limit: int = 200) -> DataFrame:
    """Predicted pairs that are not true, at most ``limit``: those of the components with the least ids, in order."""
    linked = normalize_pairs(pairs).where("a <> b")
    if not close:
        return _marked(truth, _canonical(linked)).where("not hit").select("a", "b").orderBy("a", "b").limit(limit)
    comp = components_of(linked).select(F.col("component").alias("key"), "id")
    return _unlike(write_through(_marks(comp, truth, "key"), "false-merges"), limit, True).select("a", "b").orderBy("a", "b")


def report(truth: DataFrame, pairs: DataFrame, close: bool = True, limit: int = 200) -> DataFrame:
    """``evaluate`` with the listings in it: false_merges, missed_matches and unknown_ids, at most ``limit`` each, and
    whether the first two were cut short."""
    listed = lambda df, *c: df.agg(F.array_sort(F.collect_list(F.struct(*c) if len(c) > 1 else F.col(c[0]))))
    out = evaluate(truth, pairs, close)
    out = out.join(listed(false_merges(truth, pairs, close, limit), "a", "b").toDF("false_merges")).join(listed(missed_matches(truth, pairs, close, limit), "a", "b").toDF("missed_matches"))
    out = out.join(listed(unknown_ids(truth, pairs).orderBy("id").limit(limit), "id").toDF("unknown_ids"))
    cut = lambda c, n: F.size(c) < F.col(n)
    return out.withColumns({"false_merges_truncated": cut("false_merges", "fp"), "missed_matches_truncated": cut("missed_matches", "fn"), "closed_transitively": F.lit(close)})


def blocking(truth: DataFrame, pairs: DataFrame | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """Pair completeness and reduction ratio of candidate pairs, or of block labels (then from sizes alone)."""
    base = true_pair_count(truth)
    if blocks is not None:
        count = blocks.groupBy("key").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(halves(F.col("n"))), F.lit(0)).alias("candidate_pairs"))
        both = truth.join(blocks.select("id", F.col("key").alias("block")), "id").groupBy("key", "block").agg(F.count("*").alias("m"))
        kept = both.agg(F.coalesce(F.sum(halves(F.col("m"))), F.lit(0)).alias("surviving_blocking"))
        counts = count.join(kept)
    else:
        counts = _marked(truth, _canonical(normalize_pairs(pairs))).agg(F.count("*").alias("candidate_pairs"), F.count_if("hit").alias("surviving_blocking"))
    every = base.join(counts).withColumn("total_possible_pairs", halves(F.col("records")))
    total = F.col("total_possible_pairs")
    return every.select(
        "records",
        "true_pairs",
        "surviving_blocking",
        rounded(ratio(F.col("surviving_blocking"), F.col("true_pairs")), 4).alias("pair_completeness"),
        "candidate_pairs",
        "total_possible_pairs",
        F.when(total == 0, F.lit(0.0)).otherwise(rounded(1 - F.col("candidate_pairs") / F.when(total != 0, total), 4)).alias("reduction_ratio"),
    )


def lost_to_blocking(truth: DataFrame, pairs: DataFrame | None = None, blocks: DataFrame | None = None, limit: int = 200) -> DataFrame:
    """The first true pairs, in order, that are no candidates."""
    if blocks is None:
        return _unpaired(truth, pairs, limit)
    return _unlike(write_through(_marks(truth, blocks, "key"), "lost"), limit, False).select("a", "b").orderBy("a", "b")


def sweep(truth: DataFrame, pairs: DataFrame, thresholds: list[float] | None = None, close: bool = True) -> DataFrame:
    """A row a threshold: linked (raw links kept), tp, fp, fn, precision, recall, f1.

    All cutoffs share one pass: a link belongs to every cutoff up to its score, so ends are paired with the cutoff
    and one closure runs over (cutoff, id) for all of them at once.
    """
    pairs = normalize_pairs(pairs)
    if not scored(pairs)[0]:
        raise Invalid("a sweep needs a score on every pair")
    cuts = sorted(float(t) for t in (thresholds or THRESHOLDS))
    spark = truth.sparkSession
    steps = F.broadcast(spark.createDataFrame([(i, t) for i, t in enumerate(cuts)], "cut int, t double"))
    own = pairs.join(steps, F.col("score") >= F.col("t"))
    linked = own.groupBy("cut").agg(F.count("*").alias("linked"))
    proper = own.where("a <> b")
    if close:
        mark = lambda c: F.concat_ws(":", F.lpad(F.col("cut").cast("string"), 6, "0"), c)
        comp = connected_components(proper.select(mark("a").alias("a"), mark("b").alias("b"))).select(F.substring("id", 1, 6).cast("int").alias("cut"), F.expr("substring(id, 8)").alias("id"), "component")
        sizes = comp.groupBy("cut", "component").agg(F.count("*").alias("n")).groupBy("cut").agg(F.sum(halves(F.col("n"))).alias("predicted"))
        hits = comp.join(truth, "id").groupBy("cut", "component", "key").agg(F.count("*").alias("m")).groupBy("cut").agg(F.sum(halves(F.col("m"))).alias("tp"))
    else:
        distinct = proper.select("cut", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        left, right = truth.select(F.col("id").alias("a"), F.col("key").alias("ka")), truth.select(F.col("id").alias("b"), F.col("key").alias("kb"))
        marked = distinct.join(left, "a", "left").join(right, "b", "left")
        sizes = marked.groupBy("cut").agg(F.count("*").alias("predicted"))
        hits = marked.groupBy("cut").agg(F.count_if(F.coalesce(F.col("ka") == F.col("kb"), F.lit(False))).alias("tp"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    every = steps.join(linked, "cut", "left").join(sizes, "cut", "left").join(hits, "cut", "left").join(true_pair_count(truth).select("true_pairs"))
    counts = every.select("cut", rounded(F.col("t"), 3).alias("threshold"), zero("linked").alias("linked"), zero("tp").alias("tp"), (zero("predicted") - zero("tp")).alias("fp"), (F.col("true_pairs") - zero("tp")).alias("fn"))
    return quality(counts).drop("cut")


def banded(truth: DataFrame, pairs: DataFrame, auto_merge: float = AUTO_MERGE, review_floor: float = REVIEW_FLOOR, close: bool = True) -> DataFrame:
    """What auto-merging at one score and reviewing down to another would do, as one row."""
    if review_floor > auto_merge:
        raise Invalid("the review floor must not be above auto-merge")
    pairs = normalize_pairs(pairs)
    if not scored(pairs)[0]:
        raise Invalid("bands need a score on every pair")
    auto = evaluate(truth, pairs.where(F.col("score") >= auto_merge).select("a", "b"), close)
    review = _marked(truth, _canonical(pairs.where((F.col("score") >= review_floor) & (F.col("score") < auto_merge))))
    seen = review.agg(F.count("*").alias("review_queue_size"), F.count_if("hit").alias("true_pairs_in_review"))
    every = auto.join(seen)
    caught = F.col("tp") + F.col("true_pairs_in_review")
    return every.select(
        F.lit(float(auto_merge)).alias("auto_merge_threshold"),
        F.lit(float(review_floor)).alias("review_floor"),
        F.col("precision").alias("auto_merge_precision"),
        F.col("recall").alias("auto_merge_recall"),
        F.col("fp").alias("false_merges"),
        "review_queue_size",
        "true_pairs_in_review",
        rounded(ratio(F.col("true_pairs_in_review"), F.col("review_queue_size")), 4).alias("review_precision"),
        rounded(ratio(caught, F.col("true_pairs")), 4).alias("recall_after_perfect_review"),
        F.greatest(F.lit(0), F.col("true_pairs") - caught).alias("missed_below_review"),
    )


def score_all(truth: DataFrame, pairs: DataFrame, close: bool = True, candidates: DataFrame | None = None, blocks: DataFrame | None = None, thresholds: list[float] | None = None, auto_merge: float = AUTO_MERGE, review_floor: float = REVIEW_FLOOR) -> dict:
    """Everything that can be said: summary, evaluation, sweep and bands if scored, blocking if given, warnings."""
    pairs = normalize_pairs(pairs)
    every, some = scored(pairs)
    warnings = ["some pairs have no score, so there is no sweep and there are no bands"] if some else []
    out = {"truth": truth_summary(truth), "evaluation": evaluate(truth, pairs, close), "sweep": None, "bands": None, "blocking": None, "warnings": warnings}
    if every:
        out["sweep"] = sweep(truth, pairs, thresholds, close)
        out["bands"] = banded(truth, pairs, auto_merge, review_floor, close)
    if candidates is not None or blocks is not None:
        out["blocking"] = blocking(truth, candidates, blocks)
    unknown = unknown_ids(truth, pairs).limit(4).collect()
    if unknown:
        warnings.append("links name ids that the truth does not know, such as " + ", ".join(r.id for r in unknown[:3]))
    return out



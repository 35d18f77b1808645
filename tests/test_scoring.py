import random

import pytest
from pyspark.sql import functions as F

from recordloom.operators import scoring as S
from recordloom.operators.rules import Invalid

TRUTH = {"1": "M1", "2": "M1", "3": "M1", "4": "M2", "5": "M2", "6": "M3", "7": "M4"}


@pytest.fixture(scope="module")
def truth(spark):
    return spark.createDataFrame(list(TRUTH.items()), "id string, key string").cache()


def pairs(spark, *rows):
    kind = "a string, b string" + (", score double" if rows and len(rows[0]) == 3 else "")
    return spark.createDataFrame([tuple(map(str, r[:2])) + r[2:] for r in rows], kind)


def one(df):
    return df.first().asDict()


def test_worked_example(spark, truth):
    p = pairs(spark, (1, 2), (2, 3), (6, 7))
    got = one(S.evaluate(truth, p))
    assert [got[k] for k in ("records", "true_pairs", "predicted_pairs", "tp", "fp", "fn", "precision", "recall", "f1")] == [7, 4, 4, 3, 1, 1, 0.75, 0.75, 0.75]
    assert [tuple(r) for r in S.false_merges(truth, p).collect()] == [("6", "7")] and [tuple(r) for r in S.missed_matches(truth, p).collect()] == [("4", "5")]
    got = one(S.evaluate(truth, p, close=False))
    assert (got["tp"], got["fn"], got["predicted_pairs"]) == (2, 2, 3)


def test_repeats_empties_selves_unknowns(spark, truth):
    got = one(S.evaluate(truth, pairs(spark, (2, 1), (1, 2), (3, 2))))
    assert (got["tp"], got["fp"], got["predicted_pairs"]) == (3, 0, 3)
    got = one(S.evaluate(truth, spark.createDataFrame([], "a string, b string")))
    assert (got["precision"], got["recall"], got["f1"], got["fn"], got["fp"]) == (0.0, 0.0, 0.0, 4, 0)
    got = one(S.evaluate(truth, pairs(spark, (1, 1), (1, 2))))
    assert (got["self_pairs_ignored"], got["tp"]) == (1, 1)
    p = pairs(spark, (1, "ZZZ"))
    got = one(S.evaluate(truth, p))
    assert (got["fp"], got["unknown_id_count"]) == (1, 1) and [r.id for r in S.unknown_ids(truth, p).collect()] == ["ZZZ"]
    nothing = spark.createDataFrame([], "id string, key string")
    assert one(S.evaluate(nothing, pairs(spark, (1, 2))))["recall"] == 0.0


def test_truth(spark, truth):
    got = one(S.truth_summary(truth))
    assert (got["records"], got["clusters"], got["singletons"], got["true_pairs"], got["sizes"]) == (7, 4, 2, 4, {1: 2, 2: 1, 3: 1})
    big = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.lit("k").alias("key"))
    with pytest.raises(Invalid, match="4,498,500"):
        S.true_pairs(big)
    for rows in ([("1", None)], [("", "k")], [("1", "a"), ("1", "b")]):
        with pytest.raises(Invalid):
            S.truth_of(spark.createDataFrame(rows, "id string, match_id string"), "id")


def test_one_giant_component(spark):
    n = 20_000
    truth = spark.range(n).select(F.col("id").cast("string").alias("id"), F.floor(F.col("id") / 2).cast("string").alias("key"))
    chain = spark.range(n - 1).select(F.col("id").cast("string").alias("a"), (F.col("id") + 1).cast("string").alias("b"))
    got = one(S.evaluate(truth, chain))
    assert (got["predicted_pairs"], got["tp"], got["fn"]) == (199_990_000, 10_000, 0)
    listed = S.false_merges(truth, chain, limit=50).collect()
    assert len(listed) == 50 and [r.a for r in listed] == ["0"] * 50 and "1" not in {r.b for r in listed}


def test_listing_is_the_first_of_all(spark):
    keys = {str(i): f"k{i % 9 // 2}" for i in range(40)}
    truth = spark.createDataFrame(list(keys.items())[:35], "id string, key string")
    links = pairs(spark, *[(i, i + 1) for i in range(12)], *[(i, i + 3) for i in range(14, 36)])
    comp = {r.id: r.component for r in S.components_of(links).collect()}
    known = dict(list(keys.items())[:35])
    every = sorted((comp[a], a, b) for a in comp for b in comp if a < b and comp[a] == comp[b] and not (a in known and known.get(a) == known.get(b)))
    for limit in (1, 7, 40, 10_000):
        assert [tuple(r) for r in S.false_merges(truth, links, limit=limit).collect()] == sorted((a, b) for _, a, b in every[:limit])


def test_blocking(spark, truth):
    blocks = spark.createDataFrame([("1", "b1"), ("2", "b1"), ("3", "b2"), ("4", "b3"), ("5", "b3"), ("6", "b4"), ("7", "b4")], "id string, key string")
    got = one(S.blocking(truth, blocks=blocks))
    assert (got["surviving_blocking"], got["pair_completeness"], got["candidate_pairs"], got["total_possible_pairs"], got["reduction_ratio"]) == (2, 0.5, 3, 21, 0.8571)
    assert S.lost_to_blocking(truth, blocks=blocks).count() == 2
    got = one(S.blocking(truth, pairs=pairs(spark, (1, 2), (2, 3), (1, 3), (4, 5), (6, 7))))
    assert (got["pair_completeness"], got["candidate_pairs"]) == (1.0, 5)


SCORED = ((1, 2, 0.97), (2, 3, 0.85), (6, 7, 0.93), (4, 5, 0.6))


def test_sweep_and_bands(spark, truth):
    p = pairs(spark, *SCORED)
    rows = {r.threshold: r for r in S.sweep(truth, p).collect()}
    assert len(rows) == 11 and (rows[0.5].recall, rows[0.5].fp, rows[0.5].precision) == (1.0, 1, 0.8) and (rows[0.95].precision, rows[0.95].recall) == (1.0, 0.25)
    for close in (True, False):
        for r in S.sweep(truth, p, [0.9, 0.6, 0.99], close).collect():
            e = one(S.evaluate(truth, p.where(F.col("score") >= r.threshold).select("a", "b"), close))
            assert (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) == tuple(e[k] for k in ("tp", "fp", "fn", "precision", "recall", "f1"))
            assert r.linked == sum(s >= r.threshold for *_, s in SCORED)
    got = one(S.banded(truth, p))
    assert (got["auto_merge_precision"], got["auto_merge_recall"], got["false_merges"], got["review_queue_size"], got["true_pairs_in_review"], got["review_precision"]) == (0.5, 0.25, 1, 1, 1, 1.0)
    assert (got["recall_after_perfect_review"], got["missed_below_review"]) == (0.5, 2)


def test_score_all(spark, truth):
    some = spark.createDataFrame([("1", "2", 0.9), ("2", "3", None), ("2", "Q", 0.1)], "a string, b string, score double")
    got = S.score_all(truth, some)
    assert got["sweep"] is None and got["bands"] is None and len(got["warnings"]) == 2
    with pytest.raises(Invalid):
        S.sweep(truth, some)
    got = S.score_all(truth, pairs(spark, *SCORED), candidates=pairs(spark, (1, 2)))
    assert got["sweep"].count() == 11 and got["blocking"].first().candidate_pairs == 1
    with pytest.raises(Invalid):
        S.banded(truth, pairs(spark, *SCORED), 0.5, 0.9)


def listings_by_hand(truth, pairs, limit):
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = root(a), root(b)
            top[max(a, b)] = min(a, b)
    key = dict(truth)
    groups = {}
    for x in top:
        groups.setdefault(root(x), []).append(x)
    merged = []
    for g in sorted(sorted(v) for v in groups.values()):
        merged += [(a, b) for i, a in enumerate(g) for b in g[i + 1 :] if key.get(a) is None or key.get(a) != key.get(b)]
    missed = sorted((a, b) for a in key for b in key if a < b and key[a] == key[b] and not (a in top and b in top and root(a) == root(b)))
    plain = {(min(p), max(p)) for p in pairs}
    lost = sorted((a, b) for a in key for b in key if a < b and key[a] == key[b] and (a, b) not in plain)
    return sorted(merged[:limit]), missed[:limit], lost[:limit]


@pytest.mark.parametrize("seed", range(4))
def test_listings_against_brute_force(spark, seed):
    r = random.Random(seed)
    ids = [f"r{i:03d}" for i in range(60)]
    truth = [(x, f"k{min(r.randrange(8), r.randrange(8))}" if seed else ("same" if x != "r030" else "other")) for x in ids[: 60 - seed * 3]]
    pairs = [tuple(r.sample(ids, 2)) for _ in range([59, 12, 30, 60][seed])] + [("r001", "r001")]
    if not seed:
        pairs = list(zip(ids, ids[1:]))
    t, p = spark.createDataFrame(truth, "id string, key string"), spark.createDataFrame(pairs, "a string, b string")
    for limit in (1, 5, 40, 5000):
        merged, missed, lost = listings_by_hand(truth, pairs, limit)
        assert [tuple(x) for x in S.false_merges(t, p, limit=limit).collect()] == merged
        assert [tuple(x) for x in S.missed_matches(t, p, limit=limit).collect()] == missed
        assert [tuple(x) for x in S.missed_matches(t, p, close=False, limit=limit).collect()] == lost
        if limit == 5:
            row = S.report(t, p, limit=limit).first()
            assert [tuple(x) for x in row.false_merges] == merged and row.false_merges_truncated == (row.fp > len(merged))
            assert [tuple(x) for x in row.missed_matches] == missed and row.missed_matches_truncated == (row.fn > len(missed))


def test_one_key_of_thousands_is_listed_without_enumerating(spark):
    truth = spark.range(3000).select(F.format_string("%05d", "id").alias("id"), F.lit("k").alias("key"))
    pairs = spark.createDataFrame([("00000", "00002")], "a string, b string")
    assert [tuple(x) for x in S.missed_matches(truth, pairs, limit=3).collect()] == [("00000", "00001"), ("00000", "00003"), ("00000", "00004")]

"""Queries for scoring: truth, closure, evaluation, listings, blocking, sweeps, bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring as S
from ..operators.closure import connected_components
from .beds import links, people, table, truth
from .sqltext import COMPONENTS, WITH, quality, round_to


def _blocks(spark, d):
    return people(spark, d).where("zip IS NOT NULL AND trim(zip) <> ''").selectExpr("id", "concat(nation, segment, zip) AS key")


def closure_components(spark, d):
    return connected_components(links(spark, d))


def truth_summary(spark, d):
    """Documents labelled by their text."""
    own = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.sha2("text", 256).alias("key"))
    return S.truth_summary(own).select("records", "clusters", "singletons", "true_pairs", F.explode("sizes").alias("size", "count"))


def implied_pairs(spark, d):
    own = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.concat_ws("|", "source", "lang").alias("key"))
    return S.true_pair_count(own)


def evaluate_closed(spark, d):
    return S.evaluate(truth(spark, d), links(spark, d))


def evaluate_open(spark, d):
    return S.evaluate(truth(spark, d), links(spark, d), close=False)


def false_merges(spark, d):
    return S.false_merges(truth(spark, d), links(spark, d))


def missed_matches(spark, d):
    return S.missed_matches(truth(spark, d), links(spark, d))


def evaluate_report(spark, d):
    """The evaluation with its listings: how long they are, what is in them, whether they were cut short."""
    own = S.report(truth(spark, d), links(spark, d), limit=40)
    text = lambda c: F.array_join(F.transform(c, lambda p: F.concat_ws("+", p["a"], p["b"])), ",").alias(c)
    return own.select("records", "fp", "fn", text("false_merges"), text("missed_matches"), F.array_join("unknown_ids", ",").alias("unknown_ids"), "false_merges_truncated", "missed_matches_truncated", "closed_transitively")


def unknown_ids(spark, d):
    return S.unknown_ids(truth(spark, d), links(spark, d))


def blocking_labels(spark, d):
    return S.blocking(truth(spark, d), blocks=_blocks(spark, d))


def blocking_pairs(spark, d):
    return S.blocking(truth(spark, d), pairs=links(spark, d))


def lost_to_blocking(spark, d):
    return S.lost_to_blocking(truth(spark, d), blocks=_blocks(spark, d))


def sweep_closed(spark, d):
    return S.sweep(truth(spark, d), links(spark, d))


def sweep_open(spark, d):
    return S.sweep(truth(spark, d), links(spark, d), close=False)


def banded_report(spark, d):
    return S.banded(truth(spark, d), links(spark, d))


QUERIES = {
    f.__name__: f
    for f in (closure_components, truth_summary, implied_pairs, evaluate_closed, evaluate_open, false_merges, missed_matches, evaluate_report, unknown_ids, blocking_labels, blocking_pairs, lost_to_blocking, sweep_closed, sweep_open, banded_report)
}

_TRUE = "true_pairs AS (SELECT x.id AS a, y.id AS b FROM truth x JOIN truth y ON x.key = y.key AND x.id < y.id)"
_PLAIN = "plain AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM links WHERE a <> b)"
_CLOSED = f"{COMPONENTS.format(links='links')}, implied AS (SELECT x.id AS a, y.id AS b, x.component FROM components x JOIN components y ON x.component = y.component AND x.id < y.id)"


def _evaluate(predicted: str) -> str:
    counts = f"""SELECT (SELECT count(*) FROM truth) AS records, (SELECT count(*) FROM true_pairs) AS true_pairs, p AS predicted_pairs, t AS tp, p - t AS fp, (SELECT count(*) FROM true_pairs) - t AS fn,
      (SELECT count(*) FROM (SELECT a AS id FROM links WHERE a <> b UNION SELECT b FROM links WHERE a <> b) WHERE id NOT IN (SELECT id FROM truth)) AS unknown_id_count,
      (SELECT count(*) FROM links WHERE a = b) AS self_pairs_ignored
      FROM (SELECT count(*) AS p, count(*) FILTER ((a, b) IN (SELECT (a, b) FROM true_pairs)) AS t FROM {predicted})"""
    return quality(counts)


def _blocked(candidates: str, hit: str) -> str:
    return f"""SELECT records, true_pairs, s AS surviving_blocking, {round_to('CASE WHEN true_pairs = 0 THEN 0::DOUBLE ELSE s::DOUBLE / true_pairs::DOUBLE END', 4)} AS pair_completeness, c AS candidate_pairs,
      records * (records - 1) // 2 AS total_possible_pairs, {round_to('1 - c::DOUBLE / (records * (records - 1) // 2)::DOUBLE', 4)} AS reduction_ratio
      FROM (SELECT (SELECT count(*) FROM truth) AS records, (SELECT count(*) FROM true_pairs) AS true_pairs, (SELECT count(*) FROM true_pairs t WHERE {hit}) AS s, ({candidates}) AS c)"""


_BLOCKS = "blocks AS (SELECT id, nation || segment || zip AS key FROM people WHERE zip IS NOT NULL AND trim(zip) <> '')"
_SAME_BLOCK = "EXISTS (SELECT 1 FROM blocks x JOIN blocks y ON x.key = y.key WHERE x.id = t.a AND y.id = t.b)"
_CUTS = "cuts AS (SELECT i::DOUBLE / 20::DOUBLE AS t FROM range(10, 21) r(i)), cut AS (SELECT t, a, b FROM cuts JOIN links ON score >= t)"


def _sweep(predicted: str) -> str:
    counts = f"""SELECT {round_to('c.t', 3)} AS threshold, (SELECT count(*) FROM cut k WHERE k.t = c.t) AS linked, COALESCE(tp, 0) AS tp, COALESCE(p, 0) - COALESCE(tp, 0) AS fp, (SELECT count(*) FROM true_pairs) - COALESCE(tp, 0) AS fn
      FROM cuts c LEFT JOIN (SELECT t, count(*) AS p, count(*) FILTER ((a, b) IN (SELECT (a, b) FROM true_pairs)) AS tp FROM {predicted} GROUP BY t) q ON q.t = c.t"""
    return quality(counts)


ORACLES = {
    "closure_components": f"{WITH}, {COMPONENTS.format(links='links')} SELECT id, component FROM components",
    "truth_summary": """WITH c AS (SELECT count(*) AS n FROM documents GROUP BY text), h AS (SELECT n, count(*) AS c FROM c GROUP BY n)
        SELECT (SELECT CAST(sum(n * c) AS BIGINT) FROM h) AS records, (SELECT CAST(sum(c) AS BIGINT) FROM h) AS clusters, (SELECT COALESCE(CAST(sum(c) AS BIGINT), 0) FROM h WHERE n = 1) AS singletons,
               (SELECT CAST(sum(n * (n - 1) // 2 * c) AS BIGINT) FROM h) AS true_pairs, n AS size, c AS count FROM h""",
    "implied_pairs": "SELECT CAST(sum(n) AS BIGINT) AS records, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS true_pairs FROM (SELECT count(*) AS n FROM documents GROUP BY source, lang)",
    "evaluate_closed": f"{WITH}, {_TRUE}, {_CLOSED} {_evaluate('implied')}",
    "evaluate_open": f"{WITH}, {_TRUE}, {_PLAIN} {_evaluate('plain')}",
    "false_merges": f"{WITH}, {_TRUE}, {_CLOSED} SELECT a, b FROM (SELECT * FROM implied WHERE (a, b) NOT IN (SELECT (a, b) FROM true_pairs) ORDER BY component, a, b LIMIT 200)",
    "missed_matches": f"{WITH}, {_TRUE}, {_CLOSED} SELECT a, b FROM true_pairs WHERE (a, b) NOT IN (SELECT (a, b) FROM implied) ORDER BY a, b LIMIT 200",
    "evaluate_report": f"""{WITH}, {_TRUE}, {_CLOSED},
        wrong AS (SELECT component, a, b FROM implied WHERE (a, b) NOT IN (SELECT (a, b) FROM true_pairs)), first_wrong AS (SELECT a, b FROM wrong ORDER BY component, a, b LIMIT 40),
        missed AS (SELECT a, b FROM true_pairs WHERE (a, b) NOT IN (SELECT (a, b) FROM implied)), first_missed AS (SELECT a, b FROM missed ORDER BY a, b LIMIT 40),
        strange AS (SELECT id FROM (SELECT a AS id FROM links WHERE a <> b UNION SELECT b FROM links WHERE a <> b) WHERE id NOT IN (SELECT id FROM truth) ORDER BY id LIMIT 40)
        SELECT (SELECT count(*) FROM truth) AS records, (SELECT count(*) FROM wrong) AS fp, (SELECT count(*) FROM missed) AS fn,
          (SELECT COALESCE(string_agg(a || '+' || b, ',' ORDER BY a, b), '') FROM first_wrong) AS false_merges, (SELECT COALESCE(string_agg(a || '+' || b, ',' ORDER BY a, b), '') FROM first_missed) AS missed_matches,
          (SELECT COALESCE(string_agg(id, ',' ORDER BY id), '') FROM strange) AS unknown_ids, (SELECT count(*) > 40 FROM wrong) AS false_merges_truncated, (SELECT count(*) > 40 FROM missed) AS missed_matches_truncated, TRUE AS closed_transitively""",
    "unknown_ids": f"{WITH} SELECT id FROM (SELECT a AS id FROM links WHERE a <> b UNION SELECT b FROM links WHERE a <> b) WHERE id NOT IN (SELECT id FROM truth)",
    "blocking_labels": f"{WITH}, {_TRUE}, {_BLOCKS} {_blocked('SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM (SELECT count(*) AS n FROM blocks GROUP BY key)', _SAME_BLOCK)}",
    "blocking_pairs": f"{WITH}, {_TRUE}, {_PLAIN} {_blocked('SELECT count(*) FROM plain', '(t.a, t.b) IN (SELECT (a, b) FROM plain)')}",
    "lost_to_blocking": f"{WITH}, {_TRUE}, {_BLOCKS} SELECT a, b FROM true_pairs t WHERE NOT {_SAME_BLOCK} ORDER BY a, b LIMIT 200",
    "sweep_closed": f"""{WITH}, {_TRUE}, {_CUTS},
        edges AS (SELECT t, a, b FROM cut WHERE a <> b UNION SELECT t, b, a FROM cut WHERE a <> b),
        reach AS (SELECT t, a AS id, a AS other FROM edges UNION SELECT reach.t, reach.id, edges.b FROM reach JOIN edges ON reach.t = edges.t AND reach.other = edges.a),
        components AS (SELECT t, id, min(other) AS component FROM reach GROUP BY t, id),
        implied AS (SELECT x.t, x.id AS a, y.id AS b FROM components x JOIN components y ON x.t = y.t AND x.component = y.component AND x.id < y.id) {_sweep('implied')}""",
    "sweep_open": f"{WITH}, {_TRUE}, {_CUTS}, plain AS (SELECT DISTINCT t, least(a, b) AS a, greatest(a, b) AS b FROM cut WHERE a <> b) {_sweep('plain')}",
    "banded_report": f"""{WITH}, {_TRUE}, auto AS (SELECT * FROM links WHERE score >= 0.92::DOUBLE), {COMPONENTS.format(links='auto')},
        implied AS (SELECT x.id AS a, y.id AS b FROM components x JOIN components y ON x.component = y.component AND x.id < y.id),
        review AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM links WHERE a <> b AND score >= 0.78::DOUBLE AND score < 0.92::DOUBLE),
        n AS (SELECT (SELECT count(*) FROM true_pairs) AS t, (SELECT count(*) FROM implied) AS p, (SELECT count(*) FROM implied WHERE (a, b) IN (SELECT (a, b) FROM true_pairs)) AS tp,
                     (SELECT count(*) FROM review) AS q, (SELECT count(*) FROM review WHERE (a, b) IN (SELECT (a, b) FROM true_pairs)) AS tq)
        SELECT 0.92::DOUBLE AS auto_merge_threshold, 0.78::DOUBLE AS review_floor, {round_to('CASE WHEN p = 0 THEN 0::DOUBLE ELSE tp::DOUBLE / p::DOUBLE END', 4)} AS auto_merge_precision,
               {round_to('CASE WHEN t = 0 THEN 0::DOUBLE ELSE tp::DOUBLE / t::DOUBLE END', 4)} AS auto_merge_recall, p - tp AS false_merges, q AS review_queue_size, tq AS true_pairs_in_review,
               {round_to('CASE WHEN q = 0 THEN 0::DOUBLE ELSE tq::DOUBLE / q::DOUBLE END', 4)} AS review_precision, {round_to('CASE WHEN t = 0 THEN 0::DOUBLE ELSE (tp + tq)::DOUBLE / t::DOUBLE END', 4)} AS recall_after_perfect_review,
               greatest(0, t - tp - tq) AS missed_below_review FROM n""",
}

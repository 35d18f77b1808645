"""SQL shared by the oracles and the plans: the linkage test bed and the pieces that DuckDB has no function for.

The driver's tables have no ground truth for linkage, so variants of customers are made by closed-form edits that both
engines compute alike: every fourth customer gets a variant whose name is upper-cased, loses a character, or gains a
double space. A record and its variant share a match_id.
"""

from __future__ import annotations

#: Spark SQL and DuckDB SQL alike.
PEOPLE = """
  SELECT 'C' || CAST(c_custkey AS VARCHAR(20)) AS id, c_custkey * 2 AS ord, replace(c_name, '#', ' ') AS name,
         CAST(c_nationkey AS VARCHAR(20)) AS nation, c_mktsegment AS segment, c_acctbal AS balance,
         CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN ' ' ELSE 'z' || CAST(c_custkey % 97 AS VARCHAR(20)) END AS zip,
         'M' || CAST(c_custkey AS VARCHAR(20)) AS match_id
  FROM customer
  UNION ALL
  SELECT 'V' || CAST(c_custkey AS VARCHAR(20)), c_custkey * 2 + 1,
         CASE c_custkey % 12 WHEN 0 THEN upper(replace(c_name, '#', ' ')) WHEN 4 THEN substr(replace(c_name, '#', ' '), 1, 3) || substr(replace(c_name, '#', ' '), 5, 40)
              ELSE replace(c_name, '#', '  ') END,
         CAST(c_nationkey AS VARCHAR(20)), c_mktsegment, c_acctbal + c_custkey % 3,
         CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'z' || CAST(c_custkey % 97 AS VARCHAR(20)) END,
         'M' || CAST(c_custkey AS VARCHAR(20))
  FROM customer WHERE c_custkey % 4 = 0"""

#: Links of the test bed with scores, made from keys alone so that scoring can be checked by itself: a record to its
#: variant (but for some), a record to its neighbour (false), repeats, reversed repeats, self-links, unknown ids.
LINKS = """
  SELECT 'C' || CAST(c_custkey AS VARCHAR(20)) AS a, 'V' || CAST(c_custkey AS VARCHAR(20)) AS b,
         CAST(0.5 AS DOUBLE) + CAST(c_custkey % 11 AS DOUBLE) / CAST(20 AS DOUBLE) AS score
  FROM customer WHERE c_custkey % 4 = 0 AND c_custkey % 5 <> 0
  UNION ALL
  SELECT 'C' || CAST(c_custkey + 1 AS VARCHAR(20)), 'C' || CAST(c_custkey AS VARCHAR(20)), CAST(0.4 AS DOUBLE) + CAST(c_custkey % 12 AS DOUBLE) / CAST(20 AS DOUBLE)
  FROM customer WHERE c_custkey % 6 IN (0, 1)
  UNION ALL
  SELECT 'V' || CAST(c_custkey AS VARCHAR(20)), 'C' || CAST(c_custkey AS VARCHAR(20)), CAST(0.9 AS DOUBLE) FROM customer WHERE c_custkey % 28 = 0
  UNION ALL
  SELECT 'C' || CAST(c_custkey AS VARCHAR(20)), 'C' || CAST(c_custkey AS VARCHAR(20)), CAST(0.8 AS DOUBLE) FROM customer WHERE c_custkey % 50 = 0
  UNION ALL
  SELECT 'C' || CAST(c_custkey AS VARCHAR(20)), 'X' || CAST(c_custkey AS VARCHAR(20)), CAST(0.95 AS DOUBLE) FROM customer WHERE c_custkey % 90 = 0"""

WITH = f"WITH RECURSIVE people AS ({PEOPLE}), links AS ({LINKS}), truth AS (SELECT id, match_id AS key FROM people)"


def norm(x: str) -> str:
    return f"regexp_replace(lower(COALESCE({x}, '')), '[^a-z0-9]', '', 'g')"


def tokens(x: str) -> str:
    return f"array_to_string(list_sort(list_filter(regexp_split_to_array(lower(COALESCE({x}, '')), '[^a-z0-9]+'), lambda w: w <> '')), ' ')"


def soundex(x: str) -> str:
    """Soundex spelled out: H and W go, letters become digits, runs collapse, the first code and vowels go."""
    letters = f"regexp_replace(upper(COALESCE({x}, '')), '[^A-Z]', '', 'g')"
    rest = f"substr({letters}, 1, 1) || regexp_replace(substr({letters}, 2), '[HW]', '', 'g')"
    codes = f"translate({rest}, 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '11112222222233455600000000')"
    for d in "123456":
        codes = f"regexp_replace({codes}, '{d}+', '{d}', 'g')"
    return f"CASE WHEN {letters} = '' THEN '' ELSE substr({letters}, 1, 1) || rpad(substr(replace(substr({codes}, 2), '0', ''), 1, 3), 3, '0') END"


def lev(a: str, b: str) -> str:
    return f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b}))::DOUBLE END"


def number(x: str) -> str:
    return rf"TRY_CAST(NULLIF(regexp_extract({x}, '^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)', 1), '') AS DOUBLE)"


def round_to(x: str, places: int) -> str:
    scale = f"1e{places}::DOUBLE"
    return f"floor(({x}) * {scale} + 0.5::DOUBLE) / {scale}"


def jaro_winkler(pairs: str) -> str:
    """CTEs over ``pairs`` (a SELECT of distinct x, y): jw(x, y, jw). A walk through x with the list of used places."""
    return f"""
jw_pairs AS ({pairs}),
jw_walk(x, y, i, places, chars) AS (
  SELECT x, y, 0, CAST([] AS INTEGER[]), CAST([] AS VARCHAR[]) FROM jw_pairs
  UNION ALL
  SELECT x, y, i + 1,
         CASE WHEN len(hits) > 0 THEN list_append(places, hits[1]) ELSE places END,
         CASE WHEN len(hits) > 0 THEN list_append(chars, substr(x, i + 1, 1)) ELSE chars END
  FROM (SELECT *, list_filter(CAST(range(greatest(1, i + 1 - greatest(0, greatest(length(x), length(y)) // 2 - 1)),
                              least(length(y), i + 1 + greatest(0, greatest(length(x), length(y)) // 2 - 1)) + 1) AS INTEGER[]),
                              lambda j: substr(y, j, 1) = substr(x, i + 1, 1) AND NOT list_contains(places, j)) AS hits
        FROM jw_walk WHERE i < length(x))),
jw_matched AS (
  SELECT x, y, len(places) AS m,
         len(list_filter(list_zip(chars, list_sort(places)), lambda p: p[1] <> substr(y, p[2], 1)))::DOUBLE / 2 AS half
  FROM jw_walk WHERE i = length(x)),
jw_jaro AS (
  SELECT x, y, CASE WHEN m = 0 THEN 0::DOUBLE ELSE (m::DOUBLE / length(x) + m::DOUBLE / length(y) + (m - half) / m) / 3 END AS j,
         CASE WHEN length(x) >= 4 AND length(y) >= 4 AND substr(x, 1, 4) = substr(y, 1, 4) THEN 4
              WHEN length(x) >= 3 AND length(y) >= 3 AND substr(x, 1, 3) = substr(y, 1, 3) THEN 3
              WHEN length(x) >= 2 AND length(y) >= 2 AND substr(x, 1, 2) = substr(y, 1, 2) THEN 2
              WHEN length(x) >= 1 AND length(y) >= 1 AND substr(x, 1, 1) = substr(y, 1, 1) THEN 1 ELSE 0 END AS p
  FROM jw_matched),
jw AS (SELECT x, y, CASE WHEN x = y THEN 1::DOUBLE ELSE j + p * 0.1::DOUBLE * (1 - j) END AS jw FROM jw_jaro)"""


#: Components of the links by closure, and the quality figures of counts.
COMPONENTS = """
edges AS (SELECT a, b FROM {links} WHERE a <> b UNION SELECT b, a FROM {links} WHERE a <> b),
reach AS (SELECT a AS id, a AS other FROM edges UNION SELECT reach.id, edges.b FROM reach JOIN edges ON reach.other = edges.a),
components AS (SELECT id, min(other) AS component FROM reach GROUP BY id)"""


def quality(counts: str) -> str:
    """precision, recall and f1 over a SELECT with tp, fp, fn."""
    p = "CASE WHEN tp + fp = 0 THEN 0::DOUBLE ELSE tp::DOUBLE / (tp + fp)::DOUBLE END"
    r = "CASE WHEN tp + fn = 0 THEN 0::DOUBLE ELSE tp::DOUBLE / (tp + fn)::DOUBLE END"
    return f"""SELECT * EXCLUDE (p, r), {round_to('p', 4)} AS precision, {round_to('r', 4)} AS recall,
      {round_to('CASE WHEN p + r = 0 THEN 0::DOUBLE ELSE 2 * p * r / (p + r) END', 4)} AS f1
      FROM (SELECT *, {p} AS p, {r} AS r FROM ({counts}))"""

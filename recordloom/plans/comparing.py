"""Queries for the comparison catalogue: normal forms, similarities, tolerances."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import similarity as S
from .beds import people, table
from .sqltext import PEOPLE, jaro_winkler, lev, norm, number, soundex, tokens

NAMES = "SELECT DISTINCT p_name AS x FROM part"
PAIRS = f"SELECT a.x AS x, b.x AS y FROM ({NAMES}) a JOIN ({NAMES}) b ON a.x < b.x"


def _names(spark, d):
    return table(spark, d, "part").select(F.col("p_name").alias("x")).distinct()


def _pairs(spark, d):
    a = _names(spark, d)
    return a.join(a.select(F.col("x").alias("y")), F.col("x") < F.col("y"))


def cmp_normalized(spark, d):
    return people(spark, d).select("id", K.normalized(F.col("name")).alias("key"), K.normalized(F.col("zip")).alias("zip_key"))


def cmp_prefix(spark, d):
    return people(spark, d).select("id", K.prefix(F.col("name"), 12).alias("key"), K.prefix(F.col("zip"), 2).alias("zip_key"))


def cmp_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", K.tokens(F.col("text")).alias("key"))


def cmp_soundex(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.split("text", "[^A-Za-z]+")).alias("word")).distinct()
    return words.select("word", K.soundex(F.col("word")).alias("code"))


def cmp_blank(spark, d):
    return people(spark, d).select("id", K.is_blank(F.col("zip")).alias("blank"))


def cmp_lev(spark, d):
    return _pairs(spark, d).select("x", "y", S.levenshtein_similarity(F.col("x"), F.col("y")).alias("similarity"))


def cmp_jw(spark, d):
    return _pairs(spark, d).select("x", "y", F.round(S.jaro_winkler(F.col("x"), F.col("y")), 9).alias("similarity"))


def cmp_jw_tokens(spark, d):
    keyed = _pairs(spark, d).select(K.tokens(F.col("x")).alias("x"), K.tokens(F.col("y")).alias("y")).distinct()
    return keyed.select("x", "y", F.round(S.jaro_winkler(F.col("x"), F.col("y")), 9).alias("similarity"))


def cmp_numeric(spark, d):
    """Prices are read as numbers once for each part; parts are dealt out, for there are far more pairs than parts."""
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_name", K.number(K.text(F.col("p_retailprice"), table(spark, d, "part").schema["p_retailprice"].dataType)).alias("price"))
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    a, b = part.repartition(tasks, "p_partkey").alias("a"), part.alias("b")
    diff = F.abs(F.col("a.price") - F.col("b.price"))
    met = a.join(b, (F.col("a.p_brand") == F.col("b.p_brand")) & (F.col("a.p_name") == F.col("b.p_name")) & (F.col("a.p_partkey") < F.col("b.p_partkey")))
    return met.where(diff <= 50).select(F.col("a.p_partkey").alias("a"), F.col("b.p_partkey").alias("b"), diff.alias("difference"))


def cmp_days(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    a, b = o.alias("a"), o.alias("b")
    apart = F.abs(K.moment(F.col("a.day")) - K.moment(F.col("b.day"))) / F.lit(86_400_000.0)
    met = a.join(b, (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("a.o_orderkey") < F.col("b.o_orderkey")))
    return met.where(apart <= 30).select(F.col("a.o_orderkey").alias("a"), F.col("b.o_orderkey").alias("b"), apart.alias("days"))


QUERIES = {f.__name__: f for f in (cmp_normalized, cmp_prefix, cmp_tokens, cmp_soundex, cmp_blank, cmp_lev, cmp_jw, cmp_jw_tokens, cmp_numeric, cmp_days)}

ORACLES = {
    "cmp_normalized": f"WITH people AS ({PEOPLE}) SELECT id, {norm('name')} AS key, {norm('zip')} AS zip_key FROM people",
    "cmp_prefix": f"WITH people AS ({PEOPLE}) SELECT id, substr({norm('name')}, 1, 12) AS key, substr({norm('zip')}, 1, 2) AS zip_key FROM people",
    "cmp_tokens": f"SELECT doc_id, {tokens('text')} AS key FROM documents",
    "cmp_soundex": f"SELECT word, {soundex('word')} AS code FROM (SELECT DISTINCT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS word FROM documents)",
    "cmp_blank": f"WITH people AS ({PEOPLE}) SELECT id, zip IS NULL OR trim(zip) = '' AS blank FROM people",
    "cmp_lev": f"SELECT x, y, {lev('x', 'y')} AS similarity FROM ({PAIRS})",
    "cmp_jw": f"WITH RECURSIVE {jaro_winkler(PAIRS)} SELECT x, y, round(jw, 9) AS similarity FROM jw",
    "cmp_jw_tokens": f"WITH RECURSIVE {jaro_winkler(f'SELECT DISTINCT {tokens('x')} AS x, {tokens('y')} AS y FROM ({PAIRS})')} SELECT x, y, round(jw, 9) AS similarity FROM jw",
    "cmp_numeric": f"""SELECT a.p_partkey AS a, b.p_partkey AS b, abs({number('CAST(a.p_retailprice AS VARCHAR)')} - {number('CAST(b.p_retailprice AS VARCHAR)')}) AS difference
        FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_name = b.p_name AND a.p_partkey < b.p_partkey WHERE abs(a.p_retailprice - b.p_retailprice) <= 50""",
    "cmp_days": """SELECT a.o_orderkey AS a, b.o_orderkey AS b, abs(epoch_ms(date_trunc('day', a.o_orderdate)::TIMESTAMP) - epoch_ms(date_trunc('day', b.o_orderdate)::TIMESTAMP))::DOUBLE / 86400000 AS days
        FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
        WHERE abs(epoch_ms(date_trunc('day', a.o_orderdate)::TIMESTAMP) - epoch_ms(date_trunc('day', b.o_orderdate)::TIMESTAMP))::DOUBLE / 86400000 <= 30""",
}

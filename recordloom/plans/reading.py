"""Queries for sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.matcher import field_column
from ..sources import parsing, sinks
from .beds import table


def csv_lines(spark, d):
    own = table(spark, d, "documents").select("doc_id", "lang", "text", F.split("source", "c").alias("parts"), (F.col("n_chars") / 4).alias("quarter"))
    return own.select("doc_id", sinks.csv_line(own).alias("line"))


def json_nested(spark, d):
    own = table(spark, d, "nation").select(F.col("n_nationkey").alias("@id"), F.col("n_name").alias("place.name"), F.col("n_regionkey").alias("place.region.key"))
    return own.select(F.col("`@id`").alias("n"), sinks.json_line(own).alias("json"))


def xml_records(spark, d):
    part = table(spark, d, "part")
    own = part.select(F.col("p_partkey").alias("@id"), F.col("p_name").alias("names.full"), F.split("p_name", " ").alias("names.word[0-9]"), F.concat(F.lit("<"), F.col("p_brand"), F.lit('&"')).alias("brand"))
    return own.select(F.col("`@id`").alias("n"), sinks.xml_record(own, "part").alias("xml"))


def fingerprint(spark, d):
    own = table(spark, d, "customer")
    lines = own.select(F.col("c_custkey").alias("o"), F.concat_ws("|", "c_name", "c_mktsegment").alias("line"))
    return sinks.fingerprint(lines, "o", "line")


def pairs_normalize(spark, d):
    """Links in a table that names its ids and score in another of the usual ways."""
    own = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_discount").alias("similarity"))
    return parsing.pairs_of(own)


def header_detect(spark, d):
    """Which rows read like a header: every page's address, cut at slashes."""
    own = table(spark, d, "pages").select("page_id", F.split("url", "/").alias("cells"))
    return own.select("page_id", F.array_join("cells", "|").alias("row"), F.udf(parsing.looks_like_header, "boolean")("cells").alias("header"))


def path_access(spark, d):
    own = table(spark, d, "events").select("event_id", F.struct(F.col("user_id").alias("id"), F.struct(F.col("value").alias("_value"), F.col("event_type").alias("kind")).alias("amount")).alias("e"))
    return own.select("event_id", field_column(own, "e.@id").alias("user"), field_column(own, "e.amount").alias("amount"), field_column(own, "e.amount.kind").alias("kind"))


def labels_normalize(spark, d):
    """Labels in a table with several keys an id."""
    return parsing.labels_of(table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.concat(F.lit(" "), "o_orderstatus").alias("block")))


QUERIES = {f.__name__: f for f in (csv_lines, json_nested, xml_records, fingerprint, pairs_normalize, labels_normalize, header_detect, path_access)}


def _cell(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '[\",\\n]') THEN '\"' || replace({x}, '\"', '\"\"') || '\"' ELSE {x} END"


_NUM = "CASE WHEN n_chars % 4 = 0 THEN CAST(n_chars // 4 AS VARCHAR) ELSE CAST(n_chars / 4 AS VARCHAR) END"
_LEVEL = "SELECT o // 4096 AS o, sha256(string_agg(h, '' ORDER BY o)) AS h FROM {t} GROUP BY o // 4096"
_ESC = "replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"

ORACLES = {
    "csv_lines": f"SELECT doc_id, CAST(doc_id AS VARCHAR) || ',' || {_cell('lang')} || ',' || {_cell('text')} || ',' || array_to_string(string_split(source, 'c'), '|') || ',' || {_NUM} AS line FROM documents",
    "json_nested": """SELECT n_nationkey AS n, '{"id":' || n_nationkey || ',"place":{"name":"' || n_name || '","region":{"key":' || n_regionkey || '}}}' AS json FROM nation""",
    "xml_records": f"""SELECT p_partkey AS n, '  <part id="' || p_partkey || '">' || chr(10) || '    <names>' || chr(10) || '      <full>' || {_ESC.format(x='p_name')} || '</full>' || chr(10)
        || array_to_string(list_transform(string_split(p_name, ' '), lambda w: '      <word>' || {_ESC.format(x='w')} || '</word>' || chr(10)), '') || '    </names>' || chr(10)
        || '    <brand>&lt;' || {_ESC.format(x='p_brand')} || '&amp;&quot;</brand>' || chr(10) || '  </part>' AS xml FROM part""",
    "fingerprint": f"""WITH a AS (SELECT c_custkey AS o, sha256(c_name || '|' || c_mktsegment) AS h FROM customer), b AS ({_LEVEL.format(t='a')}), c AS ({_LEVEL.format(t='b')})
        SELECT substr(sha256(string_agg(h, '' ORDER BY o)), 1, 32) AS fingerprint FROM c""",
    "pairs_normalize": "SELECT CAST(l_orderkey AS VARCHAR) AS a, CAST(l_partkey AS VARCHAR) AS b, l_discount AS score FROM lineitem",
    "labels_normalize": "SELECT CAST(o_custkey AS VARCHAR) AS id, max(trim(o_orderstatus)) AS key FROM orders GROUP BY o_custkey",
    "header_detect": rf"""WITH c AS (SELECT page_id, string_split(url, '/') AS cells FROM pages), t AS (SELECT page_id, cells, list_transform(cells, lambda x: trim(x)) AS own FROM c)
        SELECT page_id, array_to_string(cells, '|') AS row, COALESCE(len(own), 0) >= 2 AND len(list_filter(own, lambda x: regexp_full_match(x, '-?\d+(\.\d+)?'))) = 0
          AND len(list_filter(own, lambda x: regexp_full_match(x, '{parsing.HEADER.pattern}', 'i'))) > 0 AS header FROM t""",
    "path_access": 'SELECT event_id, user_id AS "user", value AS amount, event_type AS kind FROM events',
}

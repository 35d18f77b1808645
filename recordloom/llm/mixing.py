"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a seeded shuffle, played once more from the start if its target asks for
more than it has. A play is served in pieces of a few words, so that a long document doesn't hold its queue up; a
piece's virtual finish time is the cumulative words of its source up to its end, divided by the source's target. All
pieces of all sources are range-sorted by finish time, and the sorted sequence is truncated at the total budget: what
lies before the cut is the mix. Every source is served in proportion to its target, so at the cut each has its target
but for a piece.

Cumulative words come from two levels of sums: slices of the shuffle within a source, and ranges of the sorted
sequence, of which only the one with the cut is summed row by row. No source, however large, has to pass through one
task. All of it is native; SQL can express it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: Weights of the sources in code point order, repeating; share of all words to take; most plays of a document.
WEIGHTS, SHARE, PLAYS = (3.0, 1.0, 2.0), 1.5, 2.0
#: Documents in a slice of the shuffle over all sources, about, and least number of slices.
PER_SLICE, LEAST_SLICES = 50_000, 64
#: Words of a piece at most, least number of pieces of a target (small sources have smaller pieces), pieces in a range
#: of the sorted sequence, about.
PIECE, PIECES, PER_RANGE = 128, 256, 1_000_000


def size_of(text) -> F.Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(C.WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> target of each source: weights fill a budget, no target above ``PLAYS`` sizes.

    Sharing the excess again by weight until nobody is above its limit comes to one level: target = min(limit,
    level * weight). The sources that reach their limit are those with the smallest limit / weight. One row a source.
    """
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place + 1).cast("int"))
    own = sizes.withColumn("weight", weight).withColumn("most", PLAYS * F.col("source_size")).withColumn("turn", F.col("most") / F.col("weight"))
    by = Window.orderBy("turn", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    own = (
        own.withColumn("budget", SHARE * F.sum("source_size").over(every))
        .withColumn("full", F.sum("most").over(by.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("open", F.sum("weight").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.coalesce("full", F.lit(0.0))) / F.col("open"))
    )
    # The level is that of the first source in turn that it does not fill; all sources before it are full. From there
    # on levels only fall, so it is the largest of those below their own turn.
    own = own.withColumn("final", F.max(F.when(F.col("level") <= F.col("turn"), F.col("level"))).over(every))
    return own.select("source", "source_size", F.least(F.col("most"), F.coalesce(F.col("final") * F.col("weight"), F.col("most"))).alias("target"))


def placed(docs: DataFrame, slices: int | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, start: words of the source before the document in its shuffle."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size_of(F.col("text")).alias("size"))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    sized = C.cut(sized.withColumn("shuffle", key), "mixing-sizes")
    count = slices or max(LEAST_SLICES, -(-sized.count() // PER_SLICE))
    sized = sized.withColumn("slice", F.floor(F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("long") * F.lit(count) / F.lit(1 << 32)))
    parts = C.cut(sized.groupBy("source", "slice").agg(F.sum("size").alias("part")), "mixing-parts")
    goals = targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")))
    ahead = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("source", "slice", F.coalesce(F.sum("part").over(ahead), F.lit(0)).alias("before"))
    offsets = starts.alias("s").join(goals.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select("s.source", "s.slice", "s.before", "g.source_size", "g.target")
    within = Window.partitionBy("source", "slice").orderBy("shuffle", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = sized.withColumn("upto", F.sum("size").over(within)).alias("d")
    both = upto.join(offsets.alias("o"), F.col("d.source").eqNullSafe(F.col("o.source")) & (F.col("d.slice") == F.col("o.slice")))
    return both.select("d.doc_id", "d.source", "d.size", "o.source_size", "o.target", (F.col("o.before") + F.col("d.upto") - F.col("d.size")).alias("start"))


def global_order() -> list[F.Column]:
    """The order of the queue; ``start`` tells rows apart that share an id and a source."""
    return [F.col("finish"), F.col("source").asc_nulls_last(), F.col("doc_id").asc_nulls_last(), F.col("start"), F.col("play"), F.col("piece")]


def queue(own: DataFrame) -> DataFrame:
    """Every piece of every play of the placed documents that have words: its words and its virtual finish time."""
    most = F.greatest(F.lit(1.0), F.least(F.lit(float(PIECE)), F.floor(F.col("target") / PIECES))).cast("long")
    plays = F.ceil(F.col("target") / F.col("source_size"))
    own = own.where("size > 0 and target > 0").withColumn("most", most)
    own = own.withColumn("play", F.explode(F.sequence(F.lit(0).cast("long"), plays - 1)))
    own = own.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / F.col("most")) - 1)))
    done = F.least((F.col("piece") + 1) * F.col("most"), F.col("size"))
    finish = (F.col("start") + F.col("play") * F.col("source_size") + done) / F.col("target")
    return own.select("doc_id", "source", "size", "source_size", "target", "start", "play", "piece", (done - F.col("piece") * F.col("most")).alias("words"), finish.alias("finish"))


def truncated(pieces: DataFrame, budget: int, ranges: int | None = None) -> DataFrame:
    """The pieces range-sorted by finish time, with the words ``served`` of each before the budget is used up."""
    count = ranges or max(1, -(-int(budget // PIECE + 1) // PER_RANGE), pieces.sparkSession.sparkContext.defaultParallelism)
    order = global_order()
    ordered = pieces.repartitionByRange(count, *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
    ordered = C.cut(ordered, "mixing-queue")
    sums = ordered.groupBy("range").agg(F.sum("words").alias("words"))  # one row a range
    upto = sums.withColumn("upto", F.sum("words").over(Window.orderBy("range")))
    last = upto.where(F.col("upto") >= budget).orderBy("range").first()
    if last is None:
        return ordered.withColumn("served", F.col("words"))
    left = F.lit(budget - (last["upto"] - last["words"])).cast("long")
    before = F.sum("words").over(Window.partitionBy("range").orderBy(*order)) - F.col("words")
    cut = ordered.where(F.col("range") == last["range"]).withColumn("served", F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), left - before)))
    rest = ordered.where(F.col("range") != last["range"]).withColumn("served", F.when(F.col("range") < last["range"], F.col("words")).otherwise(F.lit(0).cast("long")))
    return rest.unionByName(cut)


def mix(docs: DataFrame, slices: int | None = None, ranges: int | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words of the document in the mix, repeats counted).

    Null text has size 0 and is taken with 0 words; null sources are one source, the last. The shuffle is the order
    of md5(doc_id as text), then doc_id, then size: reruns agree, and rows that are the same in all of these share
    their place in any order. An empty table gives an empty result.
    """
    own = C.cut(placed(docs, slices), "mixing-placed")
    words = int(own.agg(F.sum("size")).first()[0] or 0)
    row = ["doc_id", "source", "size", "source_size", "target", "start"]
    served = truncated(queue(own), int(SHARE * words + 0.5), ranges).groupBy(*row).agg(F.sum("served").alias("taken"))
    out = served.unionByName(own.where("size = 0 or target = 0").withColumn("taken", F.lit(0).cast("long")))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted fair mix of all of ``documents``."""
    return mix(C.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5(COALESCE(CAST(doc_id AS VARCHAR), '')) AS shuffle
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, 2 * source_size AS most,
         [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight
  FROM sources),
levels AS (
  SELECT *, (1.5 * sum(source_size) OVER () - COALESCE(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted),
goals AS (
  SELECT source, source_size, least(most, COALESCE(max(CASE WHEN level <= most / weight THEN level END) OVER () * weight, most)) AS target
  FROM levels),
placed AS (
  SELECT doc_id, size, s.source, CAST(source_size AS BIGINT) AS source_size, target,
         CAST(sum(size) OVER (PARTITION BY s.source ORDER BY shuffle, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
plays AS (
  SELECT *, CAST(greatest(1, least(128, floor(target / 256))) AS BIGINT) AS most, unnest(range(CAST(ceil(target / source_size) AS BIGINT))) AS play
  FROM placed WHERE size > 0 AND target > 0),
pieces AS (
  SELECT *, unnest(range(CAST(ceil(CAST(size AS DOUBLE) / most) AS BIGINT))) AS piece FROM plays),
queue AS (
  SELECT *, least((piece + 1) * most, size) - piece * most AS words,
         CAST(start + play * source_size + least((piece + 1) * most, size) AS DOUBLE) / target AS finish
  FROM pieces),
served AS (
  SELECT *, sum(words) OVER (ORDER BY finish, source NULLS LAST, doc_id NULLS LAST, start, play, piece ROWS UNBOUNDED PRECEDING) - words AS ahead
  FROM queue),
taken AS (
  SELECT source, start, CAST(sum(greatest(0, least(words, (SELECT floor(1.5 * sum(size) + 0.5) FROM sized) - ahead))) AS BIGINT) AS taken
  FROM served GROUP BY source, start)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CASE WHEN size > 0 THEN COALESCE(taken, 0) ELSE 0 END AS taken
FROM placed p LEFT JOIN taken t ON p.size > 0 AND p.source IS NOT DISTINCT FROM t.source AND p.start = t.start
"""

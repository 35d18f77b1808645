"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept, and returns a DataFrame; ``run``
writes each result as Parquet in the shared folder and rereads it as the next stage's ``docs``. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.llm import bpe, common, mixing, near_dedup, suffix_dedup, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _settled(stage):
    """The stage, begun after all heaps gave back what the one before left in them."""

    @functools.wraps(stage)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.settle(spark)
        return stage(spark, docs, sf_dir)

    return begin


@_settled
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model predicts toxic go; it is trained on the labelled folds of ``docs``.

    Rows without a doc_id or without text are judged like all others; rows that stay, stay as they are.
    """
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs.select(*COLUMNS), model)


@_settled
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component the document with the least id stays; texts without words all stay.

    Rows that share a doc_id but not the text are documents of their own, known by a hash of both, so that no text is
    lost with another one; of rows alike in id and text one stays. Rows without a doc_id stay.
    """
    own = docs.select(*COLUMNS)
    again = own.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("again"))
    if again.isEmpty():
        kept = near_dedup.near_duplicates(own).where("kept and doc_id is not null").select("doc_id")
        return own.join(kept, "doc_id", "left_semi").select(*COLUMNS).unionByName(own.where("doc_id is null"))
    row = F.when(F.col("again"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id")).alias("row")
    named = common.cut(own.join(again, "doc_id", "left").select(row, *COLUMNS), "pipeline-rows")
    kept = near_dedup.near_duplicates(named.select(F.col("row").alias("doc_id"), "text")).where("kept and doc_id is not null").select(F.col("doc_id").alias("row")).distinct()
    first = F.row_number().over(Window.partitionBy("row").orderBy(F.xxhash64(*COLUMNS)))
    stay = named.join(kept, "row", "left_semi").withColumn("place", first).where("place = 1").select(*COLUMNS)
    return stay.unionByName(own.where("doc_id is null"))


@_settled
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats of 50 bytes that also start in an earlier document leave the texts; n_chars follows.

    Every row stays; a null text comes back empty, rows without a doc_id count as the last.
    """
    out = suffix_dedup.suffix_dedup(docs.select(*COLUMNS), with_text=True, carry=("lang", "source"))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


@_settled
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The weighted fair mix: a row for each play of a document, whole.

    The one document of each source that is in service when the mix ends stays if half of it was served at least.
    Documents without words weigh nothing and stay once. Rows alike in doc_id (null included), source and size share
    one decision.
    """
    own = docs.select(*COLUMNS)
    plays = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int")
    decided = mixing.mix(own).groupBy("doc_id", "source", "size").agg(F.max("taken").alias("taken")).select("doc_id", "source", "size", plays.alias("plays")).where("plays > 0")
    sized = own.withColumn("size", mixing.size_of(F.col("text"))).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & F.col("d.source").eqNullSafe(F.col("m.source")) & (F.col("d.size") == F.col("m.size"))
    return sized.join(decided.alias("m"), same).withColumn("play", F.explode(F.sequence(F.lit(1), F.col("plays")))).select(*[f"d.{c}" for c in COLUMNS])


@_settled
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row's ids and decoded text; a null doc_id stays null, a null text is empty."""
    return bpe.bpe_encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Sketches, suffix runs and the tokenizer are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None

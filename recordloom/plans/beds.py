"""Inputs of the queries as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from . import sqltext


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_sql(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    """A SELECT over the driver's tables, each given as an argument so that no view is left behind."""
    for t in tables:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in tables})


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, sqltext.PEOPLE, "customer")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, sqltext.LINKS, "customer")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people(spark, sf_dir).selectExpr("id", "match_id AS key")

"""Parquet tables as units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushgrid.sources.files import as_file_units


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return as_file_units(docs.select(path.alias("source_id"), F.col("text").alias("content"), "doc_id", "source")).withColumn("unit_id", F.regexp_extract("source_id", r"doc_(\d+)\.txt$", 1).cast("long"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_file_units(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("url").alias("source_id"), F.col("html").alias("content")))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(ref.alias("source_id"), F.col("text").alias("content"))
    return as_file_units(turns, "git_commit_message").withColumn("git_ref", F.col("source_id"))


def one(spark: SparkSession, text: str, kind: str) -> DataFrame:
    """A branch name or commit message given by hand."""
    return as_file_units(spark.createDataFrame([(kind, text.rstrip("\n"))], "source_id string, content string"), kind)

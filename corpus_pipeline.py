"""From raw documents to packed sequences. Each stage takes (spark, docs, sf_dir)."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushgrid.llm import decontam, langid, neardup, packing, substring_dedup
from hushgrid.llm.runtime import ready, shared_dir


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: not those without a letter, nor those between two languages. The model is fitted on a bounded sample of labelled documents."""
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    spoken = langid.predict(docs.select(F.struct("*").alias("row"), "text"), model)
    return spoken.where((F.col("lang_pred") != langid.UND) & ~F.col("ambiguous")).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: texts whose sets of five-word shingles have an exact Jaccard similarity of at least 0.8, with others between them or at once. SimHash fingerprints, searched by the generalised pigeonhole, propose; the sets decide."""
    return neardup.keep_one(docs, shingle=5, least=0.8)


def substring_dedup_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words and more stay in the document of smallest id alone. Other columns but n_chars are as they were."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    kept = substring_dedup.remove_repeats(docs.select("doc_id", "text", F.struct(F.lit(0).alias("-"), *[F.col(f"`{c}`") for c in others]).alias("row")), rejoin=False)
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return kept.select(*[own[c].alias(c) if c in own else F.col(f"row.`{c}`") for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 4096 tokens."""
    return packing.pack_documents(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup_),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Hashing, tokenizers and a fitted model are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table, each written to the shared folder and read again."""
    ready(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

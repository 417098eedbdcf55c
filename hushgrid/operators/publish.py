"""Whether what a remote would publish is safe: refs that show what the primary does not, or that are named like leftovers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushgrid.functions.enums import DANGER_PATTERNS
from hushgrid.functions.globs import name_glob
from hushgrid.functions.text import first_matching


def ref_facts(findings: DataFrame) -> DataFrame:
    """(ref, entities, block_tier, n_findings) from findings by ref. Entity sets are bounded by the catalog."""
    return findings.groupBy(F.col("git_ref").alias("ref")).agg(F.array_sort(F.collect_set("entity_id")).alias("entities"), F.bool_or(F.col("decision") == "block").alias("block_tier"), F.count("*").alias("n_findings"))


def evaluate(refs: DataFrame, facts: DataFrame, primary: str, baseline_scanned: bool = True, patterns: tuple[str, ...] = DANGER_PATTERNS, remote: str = "origin") -> DataFrame:
    """A verdict for each ref. refs: name, kind, scanned; facts: ref_facts(). The primary's entities are one row, joined to all."""
    own = refs.join(facts.withColumnRenamed("ref", "_ref"), F.col("name") == F.col("_ref"), "left").drop("_ref")
    own = own.withColumns({"entities": F.coalesce("entities", F.array().cast("array<string>")), "block_tier": F.coalesce("block_tier", F.lit(False)), "n_findings": F.coalesce("n_findings", F.lit(0).cast("long"))})
    base = facts.where(F.col("ref") == primary).agg(F.coalesce(F.first("entities"), F.array().cast("array<string>")).alias("_base"))
    own = own.crossJoin(F.broadcast(base)) if baseline_scanned else own.withColumn("_base", F.col("entities"))  # one row, an aggregate without keys
    divergent = F.when(F.col("name") == primary, F.array().cast("array<string>")).otherwise(F.array_sort(F.array_except("entities", "_base")))
    own = own.withColumn("divergent_entities", divergent)
    named = first_matching(F.col("name"), [(p, name_glob(p)) for p in patterns])
    reasons = F.array_compact(F.array(F.when(F.size("divergent_entities") > 0, F.lit("diverges_from_primary")), F.when(named.isNotNull(), F.lit("name_pattern"))))
    own = own.withColumn("reasons", reasons).withColumn("leak_vector", F.size("reasons") > 0)
    action = F.concat(F.lit(f"git push {remote} --delete "), F.when(F.col("kind") == "tag", F.concat(F.lit("refs/tags/"), "name")).otherwise(F.col("name")))
    return own.withColumn("suggested_action", F.when(F.col("leak_vector"), action)).drop("_base")


def surface(verdicts: DataFrame) -> DataFrame:
    """One row: publish_safe, and the refs that leak."""
    leaks = F.array_sort(F.coalesce(F.collect_list(F.when(F.col("leak_vector"), F.col("name"))), F.array().cast("array<string>")))
    unsafe = F.coalesce(F.bool_or(F.col("leak_vector") | F.col("block_tier")), F.lit(False))
    return verdicts.agg((~unsafe).alias("publish_safe"), leaks.alias("leak_vector_refs"))

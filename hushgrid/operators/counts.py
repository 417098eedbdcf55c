"""Counts over findings, suppressions and units, and their order and numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BY_PLACE = ("git_ref", "path", "surface_kind", "surface", "line", "col", "detector_id", "fingerprint")


def by(findings: DataFrame, column: str) -> DataFrame:
    return findings.groupBy(column).agg(F.count("*").alias("n"))


def by_ref_and_severity(findings: DataFrame) -> DataFrame:
    """For each ref and severity, each severity, and all, in one pass: expanded before, counted in part on each task."""
    sets = findings.groupingSets([["git_ref", "severity"], ["severity"], []], "git_ref", "severity")
    return sets.agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def scan_counts(units: DataFrame) -> DataFrame:
    return units.agg(F.count("*").alias("files_scanned"), F.coalesce(F.sum("n_bytes"), F.lit(0)).cast("long").alias("bytes_scanned"), F.count_distinct("source_id").alias("distinct_paths"))


def numbered(findings: DataFrame, prefix: str = "f") -> DataFrame:
    """findings with ids in the order of BY_PLACE.

    A range sort deals the rows out in order; each row's number is that of its task's first row, from a count a
    task, plus its place in the task. So no task has to see all rows.
    """
    ordered = findings.orderBy(*BY_PLACE).withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    counts = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    before = counts.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    place = F.col("_at").bitwiseAND((1 << 33) - 1)
    joined = ordered.withColumn("_part", part).join(before, "_part").withColumn("rank", F.col("_before") + place + 1)
    return joined.withColumn("id", F.format_string(f"{prefix}-%04d", "rank")).drop("_at", "_part", "_before")

"""From unique contents to every place that shows them: scan once, then fan out by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushgrid.functions import text as T
from hushgrid.operators.detect import FINDING, detect
from hushgrid.sources.catalog import Compiled


def unique_blobs(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one unit a content, the one of least source_id and unit_id, and (blob, path) of all units). Contents are compared by SHA-256."""
    named = units.drop("blob").withColumn("blob", F.sha2("content", 256))
    first = F.min_by(F.struct(*[c for c in named.columns if c != "blob"]), F.struct("source_id", "unit_id"))
    one = named.groupBy("blob").agg(first.alias("_first")).select("blob", "_first.*").withColumns({"source_id": F.col("blob"), "source_kind": F.lit("git_history_blob"), "suppress_path": F.lit(True)})
    return one, named.select("blob", F.col("source_id").alias("path"))


def to_commits(findings: DataFrame, attr: DataFrame) -> DataFrame:
    """Findings of blobs at each (commit, path) that holds the blob, with fingerprints made anew."""
    own = findings.drop("path", "source_id", "git_ref", "surface_kind")
    moved = own.join(attr.select("blob", F.col("commit").alias("git_ref"), "path"), "blob").withColumns({"source_id": F.col("path"), "surface_kind": F.lit("blob")})
    return moved.withColumn("fingerprint", T.fingerprint()).select("unit_id", *FINDING, "blob")


def path_findings(attr: DataFrame, compiled: Compiled) -> DataFrame:
    """Findings in the paths themselves, those of binary files included. Each distinct path is scanned once."""
    paths = attr.select("path").distinct().select(F.xxhash64("path").alias("unit_id"), F.col("path").alias("source_id"), F.lit("git_history_blob").alias("source_kind"), F.lit("").alias("content"))
    found, _ = detect(paths, Compiled(compiled.entities, (), compiled.allow, compiled.threshold, compiled.visibility))
    return found


def by_commit(attr: DataFrame, compiled: Compiled) -> DataFrame:
    moved = path_findings(attr, compiled).drop("git_ref").join(attr.select("path", F.col("commit").alias("git_ref")), "path").withColumn("surface_kind", F.lit("blob"))
    return moved.withColumn("fingerprint", T.fingerprint()).select("unit_id", *FINDING)


def sorted_places(attr: DataFrame) -> DataFrame:
    """Each blob with its places in order."""
    return attr.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("commit", "path"))).alias("places"))


def to_refs(content: DataFrame, in_paths: DataFrame, blob_path_ref: DataFrame) -> DataFrame:
    """Findings by ref: those of contents wherever the blob is, those of paths where the path is."""
    places = blob_path_ref.select("blob", "path", F.col("ref").alias("git_ref")).distinct()
    a = content.drop("path", "source_id", "git_ref", "surface_kind").join(places, "blob")
    b = in_paths.drop("git_ref", "surface_kind", "source_id").join(places.drop("blob").distinct(), "path")
    both = a.drop("blob").unionByName(b.drop("blob") if "blob" in b.columns else b, allowMissingColumns=True).withColumns({"source_id": F.col("path"), "surface_kind": F.lit("blob")})
    return both.withColumn("fingerprint", T.fingerprint()).select("unit_id", *FINDING)

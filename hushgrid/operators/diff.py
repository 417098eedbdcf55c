"""Diffs as units: each run of added lines (removed lines don't part it), by gaps and islands over the diff's lines. Every line of a unit ends in a line end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def parse_lines(lines: DataFrame) -> DataFrame:
    """lines (diff_id, n, line) with the path and hunk that each belongs to. Each diff is a partition of its own."""
    w = Window.partitionBy("diff_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    header = F.col("line").startswith("+++ ")
    target = F.regexp_extract("line", r"^\+\+\+ (?:b/)?([^\t]*)", 1)
    start = F.regexp_extract("line", r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@", 1)
    marked = lines.withColumns({"_p": F.when(header, F.when(target == "/dev/null", "").otherwise(target)), "_s": F.when(start != "", start.cast("int")), "_added": F.col("line").startswith("+") & ~F.col("line").startswith("+++")})
    edge = header | F.col("line").startswith("@@ ") | F.col("line").startswith(" ")
    located = marked.withColumns({"path": F.last("_p", True).over(w), "hunk": F.count("_s").over(w), "start": F.last("_s", True).over(w), "_edge": edge.cast("int")})
    return located.withColumn("island", F.sum("_edge").over(w))


def hunk_units(lines: DataFrame) -> DataFrame:
    """A unit for each run of added lines, with the line that it starts at."""
    added = parse_lines(lines).where("_added and path is not null and path <> ''")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat(F.expr("substring(line, 2)"), F.lit("\n")).alias("text")))), lambda x: x["text"]), "")
    islands = added.groupBy("diff_id", "path", "hunk", "island").agg(F.min("start").alias("start"), F.min("n").alias("first"), F.count("*").alias("n_lines"), text.alias("content"))
    before = Window.partitionBy("diff_id", "hunk").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    base = F.col("start") + F.coalesce(F.sum("n_lines").over(before), F.lit(0))
    return islands.withColumn("line_base", base.cast("int")).select(F.xxhash64("diff_id", "path", "first").alias("unit_id"), F.col("path").alias("source_id"), F.lit("git_diff").alias("source_kind"), "content", F.octet_length("content").cast("long").alias("n_bytes"), "line_base", F.lit("").alias("git_ref"), F.lit("").alias("stage"), F.lit(False).alias("suppress_path"), F.lit(None).cast("string").alias("blob"))

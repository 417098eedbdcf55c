"""A folder as units, and every file that became none as a skip."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushgrid.functions.enums import BINARY_EXTENSIONS, SIZE_CAP
from hushgrid.sources.ignore import Rule, ignored, may_reinclude, parse

SKIPS = "source_id string, reason string, is_dir boolean, represented long, gap string, coverage_excluded boolean, legacy_excluded boolean, blob string"
UNITS = "unit_id long, source_id string, source_kind string, content string, n_bytes long, line_base int, git_ref string, stage string, suppress_path boolean, blob string"
IGNORE_FILES = (".gitignore", ".hushgridignore")


def root_rules(root: str) -> list[Rule]:
    """The root's ignore files; rules of the later file win."""
    out: list[Rule] = []
    for name in IGNORE_FILES:
        path = os.path.join(root, name)
        if os.path.isfile(path):
            with open(path, encoding="utf-8", errors="replace") as f:
                out += parse(f.read())
    return out


def _count(folder: str) -> int:
    """Files below a folder that is passed over, those of nested repositories left out."""
    total = 0
    for _, dirs, files in os.walk(folder):
        dirs[:] = [d for d in dirs if d != ".git"]
        total += len(files)
    return total


def listing(root: str, rules: list[Rule], cap: int = SIZE_CAP, include_ignored: bool = False) -> tuple[list[tuple[str, int]], list[tuple]]:
    """((path, size) of each file to read, skips), in order of paths. Only names and sizes are looked at."""
    if not os.path.isdir(root):
        raise NotADirectoryError("the root is not a folder")
    cap = cap if cap > 0 else SIZE_CAP
    files, skips = [], []

    def skip(path, reason, is_dir=False, represented=0, gap=None):
        skips.append((path, reason, is_dir, represented, gap, False, False, None))

    def walk(folder: str) -> None:
        try:
            entries = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
        except OSError:
            skip(folder, "unreadable", True, 0, "unreadable_directory")
            return
        for e in entries:
            path = f"{folder}/{e.name}".lstrip("/")
            try:
                mode, size = e.stat(follow_symlinks=False).st_mode, e.stat(follow_symlinks=False).st_size
            except OSError:
                skip(path, "unknown", gap="unknown_entry")
                continue
            if stat.S_ISDIR(mode):
                if e.name == ".git":
                    continue
                if not include_ignored and ignored(rules, path, True) and not may_reinclude(rules, path):
                    skip(path, "ignored", True, _count(os.path.join(root, path)))
                else:
                    walk(path)
            elif not include_ignored and ignored(rules, path, False):
                skip(path, "ignored")
            elif stat.S_ISLNK(mode):
                skip(path, "ignored", gap="unfollowed_symlink")
            elif not stat.S_ISREG(mode):
                skip(path, "unknown", gap="unknown_entry")
            elif os.path.splitext(e.name)[1].lower() in BINARY_EXTENSIONS:
                skip(path, "binary_detected")
            elif size > cap:
                skip(path, "file_too_large")
            elif not os.access(os.path.join(root, path), os.R_OK):
                skip(path, "unreadable")
            else:
                files.append((path, size))

    walk("")
    return files, skips


def read_folder(spark: SparkSession, root: str, cap: int = SIZE_CAP, include_ignored: bool = False) -> tuple[DataFrame, DataFrame]:
    """(units, skips) of a folder. Names are listed first; only files that are scanned are opened, by Spark's own reader."""
    root = os.path.abspath(root)
    files, skips = listing(root, root_rules(root), cap, include_ignored)
    skipped = spark.createDataFrame(skips, SKIPS)
    if not files:
        return spark.createDataFrame([], UNITS), skipped
    seen = [p for p, _ in files if os.path.basename(p)[0] not in "._"]
    names = spark.createDataFrame([(p,) for p, _ in files if os.path.basename(p)[0] in "._"], "source_id string")
    named = names.mapInArrow(_reader(root), "source_id string, content string, n_bytes long")
    if seen:
        raw = spark.read.format("binaryFile").load([f"file://{root}/{p}" for p in seen])
        path = F.substring(F.url_decode(F.regexp_replace(F.col("path"), r"\+", "%2B")), len(f"file:{root}/") + 1, 1 << 20)
        named = named.unionByName(raw.select(path.alias("source_id"), F.decode("content", "UTF-8").alias("content"), F.col("length").alias("n_bytes")))
    return as_file_units(named), skipped


def _reader(root: str):
    """Reads the files that Spark's reader takes for hidden, by their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch["source_id"].to_pylist():
                with open(os.path.join(root, name), "rb") as f:
                    data = f.read()
                yield pa.RecordBatch.from_pylist([{"source_id": name, "content": data.decode("utf-8", "replace"), "n_bytes": len(data)}], schema=pa.schema([("source_id", pa.string()), ("content", pa.string()), ("n_bytes", pa.int64())]))

    return run


def as_file_units(df: DataFrame, kind: str = "file") -> DataFrame:
    """source_id, content (and n_bytes) as units of a kind."""
    size = F.col("n_bytes") if "n_bytes" in df.columns else F.octet_length("content").cast("long")
    none = F.lit(None)
    return df.select(F.xxhash64("source_id").alias("unit_id"), "source_id", F.lit(kind).alias("source_kind"), "content", size.alias("n_bytes"), none.cast("int").alias("line_base"), F.lit("").alias("git_ref"), F.lit("").alias("stage"), F.lit(False).alias("suppress_path"), none.cast("string").alias("blob"))

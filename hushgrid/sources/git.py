"""Git repositories as tables, read through the git program.

Names of refs and commits are listed on the driver; histories of refs, trees, messages and blobs are read
by tasks (blobs through a long-lived ``cat-file --batch``, after a probe of their size), so that a history of any length is spread out. Tasks
need the repository at the same path (a shared folder, or a bundle unpacked by each).
"""

from __future__ import annotations

import os
import subprocess
import tarfile
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from hushgrid.functions.enums import BINARY_EXTENSIONS, SIZE_CAP
from hushgrid.functions.text import extension
from hushgrid.operators.diff import hunk_units
from hushgrid.sources.files import SKIPS, as_file_units, read_folder


class GitError(RuntimeError):
    pass


def git(root: str, *args: str) -> bytes:
    got = subprocess.run(["git", "-C", root, *args], capture_output=True, check=False)
    if got.returncode:
        raise GitError(f"git {args[0]} failed")
    return got.stdout


def check(root: str, work_tree: bool = False) -> None:
    if work_tree and git(root, "rev-parse", "--is-inside-work-tree").strip() != b"true":
        raise GitError("not a work tree")
    git(root, "rev-parse", "--git-dir")


def _text(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def read_staged(spark: SparkSession, root: str, cap: int = SIZE_CAP) -> tuple[DataFrame, DataFrame]:
    """(units, skips) of what is added or changed in the index, with the index's bytes."""
    check(root, True)
    units, skips = [], []
    for name in sorted(_text(x) for x in git(root, "diff", "--cached", "--name-only", "--diff-filter=AM", "-z").split(b"\0") if x):
        reason = "binary_detected" if os.path.splitext(name)[1].lower() in BINARY_EXTENSIONS else None
        data = b"" if reason else git(root, "show", f":{name}")
        reason = reason or ("file_too_large" if len(data) > cap else None)
        if reason:
            skips.append((name, reason, False, 0, None, False, False, None))
        else:
            units.append((name, _text(data), len(data)))
    return as_file_units(spark.createDataFrame(units, "source_id string, content string, n_bytes long")).withColumn("stage", F.lit("index")), spark.createDataFrame(skips, SKIPS)


def read_diff(spark: SparkSession, root: str, base: str) -> DataFrame:
    """One unit for each run of added lines since base."""
    check(root, True)
    text = _text(git(root, "diff", "--unified=0", "--diff-filter=AM", "-M", f"{base}...HEAD"))
    lines = spark.createDataFrame(list(enumerate(text.split("\n")[:-1])), "n long, line string")
    return hunk_units(lines.withColumn("diff_id", F.lit(0).cast("long")))


def read_archive(spark: SparkSession, root: str, ref: str, cap: int = SIZE_CAP) -> tuple[DataFrame, DataFrame, str]:
    """(units, skips, folder) of a ref's files, unpacked into a folder that the caller removes; works for bare repositories."""
    check(root)
    folder = tempfile.mkdtemp(prefix="hushgrid-archive-")
    with tempfile.TemporaryFile() as f:
        f.write(git(root, "archive", ref))
        f.seek(0)
        with tarfile.open(fileobj=f) as tar:
            tar.extractall(folder, filter="data")
    return *read_folder(spark, folder, cap), folder


def commits(root: str, *refs: str) -> list[str]:
    return sorted(_text(git(root, "rev-list", *(refs or ("--all",)))).split())


def tree(root: str, commit: str) -> list[tuple[str, str]]:
    """(blob, path) of each file of a commit."""
    out = []
    for record in git(root, "ls-tree", "-r", "-z", "--full-tree", commit).split(b"\0"):
        meta, _, path = record.partition(b"\t")
        if path and meta.split()[1] == b"blob":
            out.append((_text(meta.split()[2]), _text(path)))
    return out


def _spread(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A list of names, dealt out evenly."""
    return spark.createDataFrame(rows, schema).repartition(max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism)))


def _each(df: DataFrame, schema: str, rows_of: Callable[[tuple], Iterator[tuple]]) -> DataFrame:
    """The rows that a function makes of each row of df, in tasks."""
    kind = df.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                made = list(rows_of(row))
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def trees(commit_rows: DataFrame, root: str) -> DataFrame:
    """(blob, commit, path) of the commits (column commit); each tree is listed by a task."""
    return _each(commit_rows.select("commit"), "blob string, commit string, path string", lambda row: ((b, row[0], p) for b, p in tree(root, row[0])))


def blob_attr(spark: SparkSession, root: str) -> DataFrame:
    """(blob, commit, path) over all commits."""
    check(root)
    return trees(_spread(spark, [(c,) for c in commits(root)], "commit string"), root)


def messages(spark: SparkSession, root: str) -> DataFrame:
    """(source_id, content): each commit's message, read by tasks."""
    rows = _spread(spark, [(c,) for c in commits(root)], "commit string")
    return _each(rows, "source_id string, content string", lambda row: iter([(row[0], _text(git(root, "log", "-1", "--format=%B", row[0])))]))


def read_blobs(blobs: DataFrame, root: str, cap: int = SIZE_CAP) -> DataFrame:
    """blob, size and content (null beyond the cap, which is known before anything is read) of each row's blob."""
    schema = pa.schema([("blob", pa.string()), ("n_bytes", pa.int64()), ("content", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pipes = {"stdin": subprocess.PIPE, "stdout": subprocess.PIPE}
        with subprocess.Popen(["git", "-C", root, "cat-file", "--batch-check"], **pipes) as probe, subprocess.Popen(["git", "-C", root, "cat-file", "--batch"], **pipes) as p:

            def ask(process: subprocess.Popen, blob: str) -> int:
                process.stdin.write(f"{blob}\n".encode())
                process.stdin.flush()
                head = process.stdout.readline().split()
                return int(head[2]) if len(head) == 3 else -1

            for batch in batches:
                for blob in batch["blob"].to_pylist():
                    size = ask(probe, blob)
                    content = _text(p.stdout.read(ask(p, blob) + 1)[:-1]) if 0 <= size <= cap else None
                    yield pa.RecordBatch.from_pylist([{"blob": blob, "n_bytes": size, "content": content}], schema=schema)

    return blobs.select("blob").mapInArrow(run, "blob string, n_bytes long, content string")


def blob_skips(attr: DataFrame, found: DataFrame) -> DataFrame:
    """Skips of blobs: those all of whose paths are binary, those that can't be read and those over the cap. attr: blob, path; found: read_blobs() of the rest."""
    binary = extension(F.col("path")).isin(*BINARY_EXTENSIONS)
    all_binary = attr.groupBy("blob").agg(F.every(binary).alias("all"), F.min("path").alias("source_id"))
    unread = found.where("content is null").join(attr.groupBy("blob").agg(F.min("path").alias("source_id")), "blob")
    rows = all_binary.where("all").select("blob", F.col("blob").alias("source_id"), F.lit("binary_detected").alias("reason"))
    rows = rows.unionByName(unread.select("blob", "source_id", F.when(F.col("n_bytes") < 0, "unreadable").otherwise("file_too_large").alias("reason")))
    return rows.select("source_id", "reason", F.lit(False).alias("is_dir"), F.lit(0).cast("long").alias("represented"), F.lit(None).cast("string").alias("gap"), F.lit(False).alias("coverage_excluded"), F.lit(False).alias("legacy_excluded"), "blob")


def read_history(spark: SparkSession, root: str, cap: int = SIZE_CAP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(units of unique blobs and commit messages, skips, attributions to readable paths)."""
    attr = blob_attr(spark, root)
    binary = extension(F.col("path")).isin(*BINARY_EXTENSIONS)
    readable = attr.where(~binary)
    found = read_blobs(readable.select("blob").distinct(), root, cap)
    texts = found.where("content is not null").select(F.col("blob").alias("source_id"), "content", "n_bytes", "blob")
    units = as_file_units(texts, "git_history_blob").withColumn("suppress_path", F.lit(True)).withColumn("blob", F.col("source_id"))
    none = F.lit(None).cast("string")
    place = F.struct("commit", "path")
    first = attr.groupBy("blob").agg(F.every(binary).alias("all"), F.min(place)["path"].alias("any"), F.min(F.when(~binary, place))["path"].alias("text"))
    yes, no = F.lit(True), F.lit(False)
    skipped = [  # a binary path counts where it is, a blob that has no other paths counts once for coverage
        attr.where(binary).select(F.col("path").alias("source_id"), F.lit("binary_detected").alias("reason"), yes.alias("coverage_excluded"), no.alias("legacy_excluded"), "blob"),
        first.where("all").select(F.col("any").alias("source_id"), F.lit("binary_detected").alias("reason"), no.alias("coverage_excluded"), yes.alias("legacy_excluded"), "blob"),
        found.where("content is null").join(first, "blob").select(F.col("text").alias("source_id"), F.when(F.col("n_bytes") < 0, "unreadable").otherwise("file_too_large").alias("reason"), no.alias("coverage_excluded"), no.alias("legacy_excluded"), "blob"),
    ]
    skips = skipped[0].unionByName(skipped[1]).unionByName(skipped[2])
    skips = skips.select("source_id", "reason", F.lit(False).alias("is_dir"), F.lit(0).cast("long").alias("represented"), none.alias("gap"), "coverage_excluded", "legacy_excluded", "blob")
    said = as_file_units(messages(spark, root), "git_commit_message").withColumn("git_ref", F.col("source_id"))
    return units.unionByName(said), skips, readable


def refs(root: str, remote: str | None = None) -> list[tuple[str, str, str, str, bool]]:
    """(name, full name, kind, tip, whether its objects are here) of a remote's branches and tags, or of the local ones; annotated tags are peeled."""
    if remote:
        lines = _text(git(root, "ls-remote", "--heads", "--tags", remote)).splitlines()
        pairs = [(full, sha) for sha, _, full in (x.partition("\t") for x in lines)]
    else:
        lines = _text(git(root, "for-each-ref", "--format=%(refname)%09%(objectname)%09%(*objectname)", "refs/heads", "refs/tags")).splitlines()
        pairs = [(a, c or b) for a, b, c in (x.split("\t") for x in lines)]
    tips: dict[str, str] = {}
    for full, sha in sorted(pairs, key=lambda p: p[0].endswith("^{}")):
        tips[full.removesuffix("^{}")] = sha
    out = []
    for full, sha in sorted(tips.items()):
        kind = "branch" if full.startswith("refs/heads/") else "tag" if full.startswith("refs/tags/") else None
        if kind:
            here = subprocess.run(["git", "-C", root, "cat-file", "-e", f"{sha}^{{commit}}"], capture_output=True, check=False).returncode == 0
            out.append((full.split("/", 2)[2], full, kind, sha, here))
    return out


def short_name(ref: str) -> str:
    """A branch's or tag's name without where it lies."""
    ref = ref.strip()
    return next((ref.removeprefix(p) for p in ("refs/heads/", "refs/tags/") if ref.startswith(p)), ref)


def primary(root: str, remote: str | None = None, override: str | None = None) -> str:
    """The short name of the ref that others are compared with: the one given, else where the remote's HEAD points to, else main."""
    if override and override.strip():
        return short_name(override)
    try:
        for line in _text(git(root, "ls-remote", "--symref", remote or "origin", "HEAD")).splitlines():
            if line.startswith("ref:") and line[4:].split() and line[4:].split()[0].startswith(("refs/heads/", "refs/tags/")):
                return short_name(line[4:].split()[0])
    except GitError:
        pass
    return "main"


def publish_surface(spark: SparkSession, root: str, scanned: list[tuple[str, str]]) -> DataFrame:
    """(blob, path, ref) of all commits that each (ref, tip) reaches. Refs are followed and trees listed by tasks, the tree of each commit once."""
    check(root, True)
    reached = _each(_spread(spark, scanned, "ref string, tip string"), "ref string, commit string", lambda row: ((row[0], c) for c in commits(root, row[1]))).persist()
    return reached.join(trees(reached.select("commit").distinct(), root), "commit").select("blob", "path", "ref").distinct()


def archive_target(given: list[str], ref: str) -> tuple[str, str]:
    """(folder, ref) of ``scan [REPO] --git-archive [REF]``: one argument is a folder if there is one of that name, else a ref; of two the first is a folder."""
    ref = ref.strip() or "HEAD"
    if len(given) > 1:
        if not os.path.exists(given[0]):
            raise ValueError("the first of two arguments is an existing folder")
        return given[0], given[1]
    if given:
        return (given[0], ref) if os.path.exists(given[0]) else (".", given[0])
    return ".", ref


def is_bare(root: str) -> bool:
    return git(root, "rev-parse", "--is-bare-repository").strip() == b"true"

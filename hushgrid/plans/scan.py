"""A scan from units to a document and an exit code; and the audit of what a remote would publish."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushgrid.functions import text as T
from hushgrid.functions.enums import BINARY_EXTENSIONS
from hushgrid.operators import attribute, counts, coverage, publish
from hushgrid.operators.detect import detect
from hushgrid.operators.redact import Redactor, redact_with
from hushgrid.plans import document
from hushgrid.sources import git
from hushgrid.sources.catalog import Catalog, CatalogError, Compiled, compile_catalogs, unsafe_ids

OK, BLOCKED, CONFIG, RUNTIME = 0, 1, 2, 3
Say = Callable[[str], None]
#: Findings that a document may hold; more are written as a table (see write_findings), which the document names.
MOST_IN_DOCUMENT = 100_000


@dataclass
class Report:
    document: dict
    exit_code: int


def prepare(catalogs: list[Catalog], visibility: str, threshold: str) -> tuple[Compiled, Redactor]:
    unsafe_ids(catalogs)
    aliases = [a for c in catalogs for a in c.aliases()]
    if not aliases:
        raise CatalogError("redaction needs a catalog with an alias or token")
    return compile_catalogs(catalogs, visibility, threshold), Redactor(aliases)


def totals(findings: DataFrame, suppressions: DataFrame) -> dict:
    """Counts by severity, surface and decision in one aggregation of a bounded number of rows."""
    out: dict = {"findings_total": 0, "by_severity": {}, "by_surface": {}}
    blocked = 0
    for sev, surface, decision, n in findings.groupBy("severity", "surface", "decision").count().collect():
        out["findings_total"] += n
        out["by_severity"][sev] = out["by_severity"].get(sev, 0) + n
        out["by_surface"][surface] = out["by_surface"].get(surface, 0) + n
        blocked += n * (decision == "block")
    out["_blocked"] = blocked
    out["_suppressed"] = {r[0]: r[1] for r in suppressions.groupBy("allowlist_id").count().collect()}
    return out


def gate(blocked: bool, mode: str | None, status: str) -> int:
    return BLOCKED if blocked or mode == "release" and status == "incomplete" else OK


def say_warnings(catalogs: list[Catalog], redactor: Redactor, say: Say) -> None:
    for c in catalogs:
        for w in c.warnings:
            say(f"catalog warning: {redactor(w)}")


def say_skips(skips: DataFrame, redactor: Redactor, say: Say) -> None:
    """A line a skip, redacted; of a folder the number of files only, never their names. Rows come one by one."""
    for r in skips.orderBy("source_id", "reason").toLocalIterator():
        kind, size = ("directory", f" files={r.represented}") if r.is_dir else ("file", "")
        say(f"scan skip: kind={kind} reason={r.reason} source={redactor(r.source_id)}{size} detail={r.gap or 'n/a'}")


def say_suppressions(suppressions: DataFrame, redactor: Redactor, say: Say) -> None:
    """A line a suppression, in order: ids and redacted places, never what matched."""
    for r in suppressions.orderBy("allowlist_id", "entity_id", "surface", "source_id").toLocalIterator():
        at = f" git_ref={redactor(r.git_ref)}" if r.git_ref else ""
        say(f"allowlist suppression: allowlist_id={r.allowlist_id} entity_id={r.entity_id} surface={r.surface} source={redactor(r.source_id) or r.surface}{at}")


def run_scan(units: DataFrame, skips: DataFrame | None, catalogs: list[Catalog], visibility: str = "public_oss", threshold: str = "high", mode: str | None = None, allowances: dict[str, int] | None = None, skip_unit: str = "file", metadata: dict | None = None, attr: DataFrame | None = None, all_places: DataFrame | None = None, warnings: list[dict] = (), table: str | None = None, say: Say | None = None, explain: bool = False) -> Report:
    """say: gets lines on warnings, skips and, with explain, suppressions. table: where findings go if they are too many for a document. units and skips of any source. attr (blob, commit, path): findings of blobs go to all their places; all_places: also paths of what was not read."""
    began = time.time()
    compiled, redactor = prepare(catalogs, visibility, threshold)
    findings, suppressions = detect(units, compiled, keep=("blob",))
    if attr is not None:
        moved = attribute.to_commits(findings.where("blob is not null"), attr).drop("blob")
        findings = findings.where("blob is null").drop("blob").unionByName(moved).unionByName(attribute.by_commit(all_places if all_places is not None else attr, compiled))
    else:
        findings = findings.drop("blob")
    findings, suppressions = findings.persist(), suppressions.persist()
    try:
        return _report(units, skips, catalogs, findings, suppressions, redactor, began, visibility, mode, allowances, skip_unit, metadata, warnings, table, say, explain)
    finally:
        findings.unpersist()
        suppressions.unpersist()


def _report(units, skips, catalogs, findings, suppressions, redactor, began, visibility, mode, allowances, skip_unit, metadata, warnings, table, say, explain) -> Report:
    total = totals(findings, suppressions)
    spark = units.sparkSession
    skips = skips if skips is not None else spark.createDataFrame([], "source_id string, reason string, is_dir boolean, represented long, gap string, coverage_excluded boolean, legacy_excluded boolean, blob string")
    if say:
        say_warnings(catalogs, redactor, say)
        say_skips(skips, redactor, say)
        if explain:
            say_suppressions(suppressions, redactor, say)
    covered = coverage.summarize(skips, skip_unit, allowances)
    scanned = counts.scan_counts(units).collect()[0]
    passed = coverage.file_counts(skips).collect()
    rows, written = for_document(findings, total["findings_total"], redactor, table)
    suppressed = total.pop("_suppressed")
    blocked = total.pop("_blocked") > 0
    files = scanned.distinct_paths if metadata and metadata.get("scan_root_kind") == "git_diff" else scanned.files_scanned
    meta = {"duration_ms": int(1000 * (time.time() - began)), "visibility": visibility, "worker_count": spark.sparkContext.defaultParallelism, "files_scanned": files, "bytes_scanned": scanned.bytes_scanned, "files_skipped": sum(r.files for r in passed), "directories_skipped": sum(r.folders for r in passed), "files_skipped_by_reason": {r.reason: r.files for r in passed if r.files}, "allowlist_suppressions": sum(suppressed.values()), "allowlist_suppressions_by_entry": suppressed, "catalogs_loaded": [{"catalog_id": c.id, "load_status": "ok"} for c in catalogs], **({"findings_table": written} if written else {}), **(metadata or {})}
    doc = document.scan_document(rows, meta, covered, total, redactor, warnings)
    blocked = blocked or any(w["decision"] == "block" for w in warnings)
    return Report(doc, gate(blocked, mode, covered["status"]))


def for_document(findings: DataFrame, n: int, redactor: Redactor, table: str | None) -> tuple[list[dict], str | None]:
    """The n findings for a document; or none and the path of the table that holds them all."""
    if n <= MOST_IN_DOCUMENT:
        return [r.asDict() | {"id": f"f-{i:04d}"} for i, r in enumerate(findings.orderBy(*counts.BY_PLACE).collect(), 1)], None
    path = table or f"hushgrid-findings-{uuid.uuid4().hex}"
    write_findings(findings, path, redactor)
    return [], path


def write_findings(findings: DataFrame, path: str, redactor: Redactor) -> None:
    """Findings of a run of any size, redacted and numbered, in the order of a document, as Parquet. Only what a document shows is written."""
    clean = {c: redact_with(F.col(c), redactor) for c in ("path", "source_id", "git_ref", "message")}
    kind = F.col("kind") if "kind" in findings.columns else F.lit("detection").alias("kind")
    names = ("id", "fingerprint", "severity", "confidence", "decision", "entity_id", "entity_class", "detector_id", "rule_id", "source_kind", "surface", "path", "source_id", "line", "col", "git_ref", "surface_kind", "replacement_id", "evidence_shape", "message")
    rows = counts.numbered(findings).select(kind, *[clean[c].alias(c) if c in clean else F.col(c) for c in names], "rank")
    order = [F.coalesce(F.col(c), F.lit(0 if c in ("line", "col") else "")) for c in ("git_ref", "path", "surface_kind", "source_id", "surface", "line", "col", "detector_id")]
    rows.orderBy(*order, "rank").drop("rank").write.parquet(path)


def run_history(spark: SparkSession, root: str, catalogs: list[Catalog], **options) -> Report:
    units, skips, readable = git.read_history(spark, root)
    meta = {"scan_root": root, "scan_root_kind": "git_history"} | options.pop("metadata", {})
    return run_scan(units, skips, catalogs, skip_unit="unique_blob", metadata=meta, attr=readable, all_places=git.blob_attr(spark, root), **options)


def run_audit(spark: SparkSession, root: str, catalogs: list[Catalog], remote: str | None = None, primary: str | None = None, visibility: str = "public_oss", threshold: str = "high", names_only: bool = False, branches: bool = True, tags: bool = True, mode: str | None = None, allowances: dict[str, int] | None = None, table: str | None = None, say: Say | None = None) -> Report:
    if names_only and mode == "release":
        raise CatalogError("a release needs contents, not names alone")
    all_refs = git.refs(root, remote)
    base = git.primary(root, remote, primary)
    shown = [r for r in all_refs if branches and r[2] == "branch" or tags and r[2] == "tag"]
    gaps = ["ref_missing_local_objects"] * sum(not r[4] for r in shown)
    scan = {r[0]: r[3] for r in all_refs if r[4] and (r in shown or r[0] == base)} if not names_only else {}
    skips = spark.createDataFrame([], "source_id string, reason string, is_dir boolean, represented long, gap string, coverage_excluded boolean, legacy_excluded boolean, blob string")
    if names_only:
        gaps.append("names_only_content_omitted")
    touched: set[str] = set()
    held: list[DataFrame] = []
    try:
        return _audit(spark, root, catalogs, remote, base, shown, scan, gaps, skips, visibility, threshold, mode, allowances, table, say, held, touched)
    finally:
        for df in held:
            df.unpersist()


def _audit(spark, root, catalogs, remote, base, shown, scan, gaps, skips, visibility, threshold, mode, allowances, table, say, held, touched) -> Report:
    redactor, findings = None, None

    def keep(df: DataFrame) -> DataFrame:
        held.append(df.persist())
        return df

    if scan:
        compiled, redactor = prepare(catalogs, visibility, threshold)
        places = keep(git.publish_surface(spark, root, sorted(scan.items())))
        binary = T.extension(F.col("path")).isin(*BINARY_EXTENSIONS)
        blobs = keep(git.read_blobs(places.where(~binary).select("blob").distinct(), root))
        units = blobs.where("content is not null").select(F.xxhash64("blob").alias("unit_id"), F.col("blob").alias("source_id"), F.lit("git_history_blob").alias("source_kind"), "content", "n_bytes", F.lit(True).alias("suppress_path"), "blob")
        content, _ = detect(units, compiled, keep=("blob",))
        findings = keep(attribute.to_refs(content, attribute.path_findings(places, compiled), places))
        skips = keep(git.blob_skips(places, blobs))
        touched |= {r[0] for r in places.join(skips.select("blob"), "blob").select("ref").distinct().collect()}
        if say:
            say_warnings(catalogs, redactor, say)
            say_skips(skips, redactor, say)
    baseline = base in scan
    if scan and not baseline:
        gaps.append("primary_baseline_unscanned")
        if say:
            say("audit-publish: the primary ref is not here, so what diverges from it can't be told; names only are judged. Fetch all refs for a full audit.")
    ref_table = spark.createDataFrame([(n, k, n in scan and n not in touched) for n, _, k, _, _ in shown], "name string, kind string, scanned boolean")
    facts = publish.ref_facts(findings) if findings is not None else spark.createDataFrame([], "ref string, entities array<string>, block_tier boolean, n_findings long")
    verdicts = keep(publish.evaluate(ref_table, facts, base, baseline, remote=remote or "origin"))
    verdict = publish.surface(verdicts).collect()[0].asDict()
    covered = coverage.summarize(skips, "unique_blob", allowances, gaps)
    rows, written = for_document(findings, findings.count(), redactor, table) if findings is not None else ([], None)
    if mode == "release" and covered["status"] == "incomplete":
        verdict["publish_safe"] = False
    doc = document.audit_document([r.asDict() for r in verdicts.collect()], verdict, base, covered, rows, redactor) | ({"findings_table": written} if written else {})
    return Report(doc, OK if verdict["publish_safe"] else BLOCKED)

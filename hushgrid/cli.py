"""Command line: scan, audit-publish, catalog, attest, verify-attestation. Exit codes: 0 ok, 1 blocked, 2 configuration, 3 runtime."""

from __future__ import annotations

import argparse
import contextlib
import datetime as dt
import json
import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

from hushgrid.functions.enums import MODES, POSTURES, SIZE_CAP, VISIBILITIES
from hushgrid.sources import config as C
from hushgrid.sources import git, tables, termlist, visibility
from hushgrid.sources.catalog import CatalogError, content_hash, load_file
from hushgrid.sources.files import read_folder

CONFIG_PATH = ".hushgrid/config.yaml"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="hushgrid")
    sub = p.add_subparsers(dest="command", required=True)
    scan = sub.add_parser("scan")
    scan.add_argument("roots", nargs="*")
    audit = sub.add_parser("audit-publish")
    audit.add_argument("root", nargs="?", default=".")
    for x in (scan, audit):
        x.add_argument("--catalog", action="append", default=[])
        x.add_argument("--config")
        x.add_argument("--visibility", choices=VISIBILITIES)
        x.add_argument("--mode", choices=MODES)
        x.add_argument("--private-catalog-missing", choices=POSTURES)
        x.add_argument("--allow-skips", action="append", default=[], metavar="REASON=N")
        x.add_argument("--findings-table", metavar="PATH", help="where findings go, as Parquet, if they are too many for a document")
        x.add_argument("--format", choices=("json", "human"), default="json")
        x.add_argument("--explain", "--explain-suppressions", action="store_true", help="say on stderr what exceptions took away")
    kinds = scan.add_mutually_exclusive_group()
    kinds.add_argument("--staged", action="store_true")
    kinds.add_argument("--diff", metavar="BASE")
    kinds.add_argument("--git-archive", metavar="REF", nargs="?", const="HEAD")
    kinds.add_argument("--git-history-all", action="store_true")
    kinds.add_argument("--branch-name-stdin", action="store_true")
    kinds.add_argument("--commit-msg-stdin", action="store_true")
    scan.add_argument("--max-file-size", type=int, default=SIZE_CAP)
    scan.add_argument("--include-ignored", action="store_true")
    audit.add_argument("--remote")
    audit.add_argument("--primary")
    audit.add_argument("--names-only", action="store_true")
    which = audit.add_mutually_exclusive_group()
    which.add_argument("--branches-only", action="store_true")
    which.add_argument("--tags-only", action="store_true")
    cat = sub.add_parser("catalog").add_subparsers(dest="action", required=True)
    build = cat.add_parser("build")
    build.add_argument("--from", dest="source", required=True)
    build.add_argument("--id", required=True)
    build.add_argument("--out", required=True)
    build.add_argument("--no-whole-word", action="store_true")
    allow = cat.add_parser("visibility-allowlist")
    for name in ("--base", "--map", "--out"):
        allow.add_argument(name, required=True)
    attest = sub.add_parser("attest")
    verify = sub.add_parser("verify-attestation")
    for x in (attest, verify):
        x.add_argument("root", nargs="?", default=".")
        x.add_argument("--file", default=".hushgrid/attestation.json")
    attest.add_argument("--catalog", action="append", required=True)
    attest.add_argument("--base")
    attest.add_argument("--operator", default="")
    attest.add_argument("--mode", choices=MODES)
    verify.add_argument("--max-age", default="72h")
    verify.add_argument("--allow-hash", action="append", default=[])
    return p


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def say(line: str) -> None:
    """A line on stderr; that nobody reads it must not fail a scan."""
    with contextlib.suppress(OSError):
        print(line, file=sys.stderr, flush=True)


def loaded(args) -> tuple[list, dict | None, list[dict]]:
    """(catalogs, configuration, warnings): those that the configuration refers to first, then those given."""
    from hushgrid.plans.document import config_warning

    path = args.config or os.path.join(args.root, CONFIG_PATH)
    config = C.load_config(Path(path).read_bytes()) if os.path.isfile(path) else None
    if args.config and config is None:
        raise CatalogError("the configuration cannot be read")
    found = C.resolve(config, os.path.dirname(path), C.posture(args.private_catalog_missing, args.mode, config)) if config else []
    catalogs = [r.catalog for r in found if r.catalog] + [load_file(c) for c in args.catalog]
    missing = [r for r in found if r.status == C.WARN]
    if not catalogs and not found and not getattr(args, "names_only", False):
        raise CatalogError("no catalog")
    return catalogs, config, [config_warning(r.catalog_id, i, "warn") for i, r in enumerate(missing, 1)]


def do_scan(args) -> int:
    from hushgrid.operators.coverage import parse_allowances
    from hushgrid.plans import document, scan

    try:
        allowances = parse_allowances(args.allow_skips)
        if args.git_archive is not None:
            args.root, args.git_archive = git.archive_target(args.roots, args.git_archive)
        elif len(args.roots) > 1:
            raise ValueError("more than one folder")
        else:
            args.root = args.roots[0] if args.roots else "."
    except ValueError as e:
        raise CatalogError(str(e)) from None
    catalogs, config, warnings = loaded(args)
    options = {"say": say, "explain": args.explain, "visibility": C.visibility(args.visibility, config), "threshold": C.threshold(args.mode, config), "mode": args.mode, "allowances": allowances, "warnings": warnings, "table": args.findings_table}
    spark, skips, folder = session(), None, None
    try:
        if args.git_history_all:
            report = scan.run_history(spark, args.root, catalogs, **options)
        else:
            meta = {"scan_root": args.root}
            if args.staged:
                units, skips = git.read_staged(spark, args.root, args.max_file_size)
                meta["scan_root_kind"] = "staged"
            elif args.diff:
                try:
                    units = git.read_diff(spark, args.root, args.diff)
                except git.GitError:
                    raise CatalogError("the base of the diff cannot be read") from None
                meta |= {"scan_root_kind": "git_diff"}
            elif args.git_archive:
                units, skips, folder = git.read_archive(spark, args.root, args.git_archive, args.max_file_size)
                meta |= {"scan_root_kind": "git_archive", "git_ref": args.git_archive}
            elif args.branch_name_stdin or args.commit_msg_stdin:
                units = tables.one(spark, sys.stdin.read(), "branch_name" if args.branch_name_stdin else "commit_message")
            else:
                units, skips = read_folder(spark, args.root, args.max_file_size, args.include_ignored)
            report = scan.run_scan(units, skips, catalogs, metadata=meta, **options)
    finally:
        if folder:
            shutil.rmtree(folder, ignore_errors=True)
    sys.stdout.write(document.dumps(report.document))
    return report.exit_code


def do_audit(args) -> int:
    from hushgrid.operators.coverage import parse_allowances
    from hushgrid.plans import document, scan

    catalogs, config, _ = loaded(args)
    report = scan.run_audit(session(), args.root, catalogs, args.remote, args.primary, C.visibility(args.visibility, config), C.threshold(args.mode, config), args.names_only, not args.tags_only, not args.branches_only, args.mode, parse_allowances(args.allow_skips), args.findings_table, say)
    sys.stdout.write(document.dumps(report.document))
    for name in report.document["leak_vector_refs"]:
        print(f"warning: {name} would publish what the primary does not", file=sys.stderr)
    return report.exit_code


def private_write(path: str, data: bytes) -> None:
    fd = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600)
    with os.fdopen(fd, "wb") as f:
        f.write(data)


def forge(repo: str) -> str:
    """What the forge's own program says, unresolved if it says nothing."""
    try:
        got = subprocess.run(["gh", "repo", "view", repo, "--json", "visibility", "--jq", ".visibility"], capture_output=True, text=True, timeout=20, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return visibility.UNRESOLVED
    return visibility.classify(got.stdout) if not got.returncode else visibility.UNRESOLVED


def do_catalog(args, resolve=forge) -> int:
    if args.action == "build":
        private_write(args.out, termlist.build(Path(args.source).read_text(encoding="utf-8"), args.id, whole_word=not args.no_whole_word))
    else:
        data, counts = visibility.allow_public(Path(args.base).read_bytes(), Path(args.map).read_text(encoding="utf-8"), resolve)
        private_write(args.out, data)
        print(json.dumps(counts), file=sys.stderr)
    return 0


def duration(text: str) -> dt.timedelta:
    m = re.fullmatch(r"(?:(\d+)h)?(?:(\d+)m)?(?:(\d+)s)?", text)
    if not m or not any(m.groups()):
        raise CatalogError("not a duration")
    return dt.timedelta(hours=int(m[1] or 0), minutes=int(m[2] or 0), seconds=int(m[3] or 0))


def operator_label(text: str) -> str:
    return text if re.fullmatch(r"[a-z][a-z0-9-]*", text) else "unknown"


def do_attest(args) -> int:
    """Scan what the base lacks (in a bare repository all of HEAD) and write a record of it: what was scanned, with which catalogs (by hash), and what came out. A scan that doesn't pass leaves no record."""
    from hushgrid.plans import scan

    catalogs = [load_file(c) for c in args.catalog]
    spark, folder, bare = session(), None, git.is_bare(args.root)
    try:
        if bare:
            units, skips, folder = git.read_archive(spark, args.root, "HEAD")
        else:
            units, skips = (git.read_diff(spark, args.root, args.base), None) if args.base else read_folder(spark, args.root)
        report = scan.run_scan(units, skips, catalogs, mode=args.mode, say=say)
    finally:
        if folder:
            shutil.rmtree(folder, ignore_errors=True)
    if report.exit_code:
        say("attest: the scan did not pass; no record is written")
        return report.exit_code
    record = {"version": "v0", "scan_timestamp": dt.datetime.now(dt.UTC).isoformat(), "commit": git.git(args.root, "rev-parse", "HEAD").decode().strip(), "catalog_hash": content_hash({c: Path(c).read_bytes() for c in args.catalog}), "operator": operator_label(args.operator), "exit_code": report.exit_code, "summary": report.document["summary"]}
    path = os.path.join(args.root, args.file)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    Path(path).write_text(json.dumps(record, indent=2) + "\n", encoding="utf-8")
    if not bare:
        git.git(args.root, "add", "--", args.file)
    say(f"attestation written{'' if bare else ' and staged'}: {args.file}")
    return 0


def verify(record: dict, head: str, parent: str | None, only_record_changed: bool, max_age: dt.timedelta, hashes: list[str], now: dt.datetime) -> list[str]:
    """What speaks against a record."""
    wrong = []
    age = now - dt.datetime.fromisoformat(record["scan_timestamp"])
    if not dt.timedelta(0) <= age <= max_age:
        wrong.append("it is too old, or of the future")
    if hashes and record["catalog_hash"] not in hashes:
        wrong.append("its catalogs are not among those allowed")
    if record["commit"] != head and not (record["commit"] == parent and only_record_changed):
        wrong.append("it is of another commit")
    if record["exit_code"]:
        wrong.append("the scan did not pass")
    return wrong


def do_verify(args) -> int:
    try:
        record = json.loads(git.git(args.root, "show", f"HEAD:{args.file}"))
        head = git.git(args.root, "rev-parse", "HEAD").decode().strip()
    except (git.GitError, ValueError):
        raise CatalogError("no committed record") from None
    try:
        parent = git.git(args.root, "rev-parse", "HEAD~1").decode().strip()
        changed = git.git(args.root, "diff", "--name-only", "HEAD~1", "HEAD").decode().split("\n")[:-1]
    except git.GitError:
        parent, changed = None, []
    wrong = verify(record, head, parent, changed == [args.file], duration(args.max_age), args.allow_hash, dt.datetime.now(dt.UTC))
    for w in wrong:
        print(f"attestation: {w}", file=sys.stderr)
    return 1 if wrong else 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return {"scan": do_scan, "audit-publish": do_audit, "catalog": do_catalog, "attest": do_attest, "verify-attestation": do_verify}[args.command](args)
    except CatalogError as e:
        print(f"configuration: {e}", file=sys.stderr)
        return 2
    except git.GitError as e:  # names git's command alone
        print(f"runtime: {e}", file=sys.stderr)
        return 3
    except Exception as e:  # noqa: BLE001  what went wrong may hold protected values
        print(f"runtime: {type(e).__name__}", file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(main())

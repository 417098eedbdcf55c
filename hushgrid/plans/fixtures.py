"""Queries over small made-up inputs (catalogs, term lists, folders, repositories) whose results are known beforehand.

Each runs the library on its input; its SQL is the table of results that the rules ask for.
"""

from __future__ import annotations

import atexit
import contextlib
import datetime as dt
import io
import os
import shutil
import subprocess
import sys
import tempfile
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path
from unittest import mock

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushgrid import cli
from hushgrid.functions.globs import clean_path, path_glob
from hushgrid.operators import coverage, publish
from hushgrid.operators.detect import detect
from hushgrid.operators.redact import Redactor
from hushgrid.plans import document, scan
from hushgrid.sources import config, files, git, ignore, tables, termlist, visibility
from hushgrid.sources.catalog import Catalog, CatalogError, compile_catalogs, content_hash, load_bytes, load_file

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def known(columns: str, rows: list[tuple]):
    """Registers a function of (spark) that gives rows, with the rows it ought to give. columns: 'name type, ...' (string or long). A text that starts with = is SQL."""
    names = [c.split() for c in columns.split(", ")]

    def value(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, str):
            return x[1:] if x.startswith("=") else "'" + x.replace("'", "''") + "'"
        return str(int(x))

    def add(f: Callable[[SparkSession], list[tuple]]) -> Callable:
        made = ", ".join(f"CAST({n} AS {'BIGINT' if t == 'long' else 'VARCHAR'}) AS {n}" for n, t in names)
        ORACLE_SQL[f.__name__] = f"SELECT {made} FROM (VALUES {', '.join('(' + ', '.join(map(value, r)) + ')' for r in rows)}) AS t({', '.join(n for n, _ in names)})"
        QUERIES[f.__name__] = lambda spark, _sf_dir: spark.createDataFrame([tuple(int(x) if isinstance(x, bool) else x for x in r) for r in f(spark)], columns)
        return f

    return add


def folder() -> str:
    path = tempfile.mkdtemp(prefix="hushgrid-fixture-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def write(root: str, contents: dict[str, str]) -> str:
    for name, text in contents.items():
        path = Path(root, name)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    return root


@contextlib.contextmanager
def console(spark: SparkSession, given: str = "") -> Iterator[io.StringIO]:
    """The command line with this session, nothing shown; gives what goes to stderr."""
    err = io.StringIO()
    with mock.patch.object(cli, "session", lambda: spark), mock.patch.object(sys, "stdin", io.StringIO(given)), contextlib.redirect_stderr(err), contextlib.redirect_stdout(io.StringIO()):
        yield err


def run_git(root: str, *args: str) -> None:
    subprocess.run(["git", "-C", root, "-c", "user.name=a", "-c", "user.email=a@b", *args], check=True, capture_output=True)


# ---- catalogs

BASE = {"$schema": "s", "catalog_id": "c-1", "schema_version": "1.1.0", "default_severity": "high", "entities": [{"id": "e-1", "class": "codename", "aliases": ["Zorblat"]}]}
E = BASE["entities"][0]
CASES = {
    "as it should be": ({}, "ok"), "newer minor version": ({"schema_version": "1.9.0"}, "ok"), "other major version": ({"schema_version": "2.0.0"}, "refused"), "no entities": ({"entities": []}, "refused"),
    "unknown field": ({"odd": 1}, "refused"), "match for aliases": ({"entities": [{"id": "e", "class": "codename", "match": "a"}]}, "refused"), "nothing to match": ({"entities": [{"id": "e", "class": "codename"}]}, "refused"),
    "unknown class": ({"entities": [E | {"class": "x"}]}, "refused"), "unknown severity": ({"default_severity": "x"}, "refused"), "id twice": ({"entities": [E, E]}, "refused"), "id shows an alias": ({"entities": [E | {"id": "e-Zorblat"}]}, "refused"),
    "one term": ({"co_occurrence_rules": [{"rule_id": "r", "terms": ["e-1"], "window_kind": "file"}]}, "refused"), "unknown term": ({"co_occurrence_rules": [{"rule_id": "r", "terms": ["e-1", "e-2"], "window_kind": "file"}]}, "refused"),
    "no window": ({"co_occurrence_rules": [{"rule_id": "r", "terms": ["e-1", "e-1"]}]}, "refused"), "exception of unknown kind": ({"allowlist": [{"id": "a", "kind": "glob", "pattern": "x"}]}, "refused"),
    "exception does not compile": ({"allowlist": [{"id": "a", "kind": "regex", "pattern": "("}]}, "refused"), "exception is blank": ({"allowlist": [{"id": "a", "kind": "literal", "pattern": " "}]}, "refused"), "good exception": ({"allowlist": [{"id": "a", "kind": "regex", "pattern": "Z[a-z]+"}]}, "ok"),
}


def load(**change) -> Catalog:
    return load_bytes(yaml.safe_dump(BASE | change).encode())


@known("name string, verdict string, shown long", [(k, v, 0) for k, (_, v) in CASES.items()])
def fx_catalog_rules(spark):
    """Which catalogs are refused, and that no message shows a protected value."""
    out = []
    for name, (change, _) in CASES.items():
        try:
            load(**change)
            out.append((name, "ok", 0))
        except CatalogError as e:
            out.append((name, "refused", int("orblat" in str(e))))
    return out


@known("name string, n long", [("plain", 0), ("no $schema", 1), ("newer", 1), ("whole word in any case", 1), ("exceptions before 1.1.0", 1)])
def fx_catalog_warnings(spark):
    made = {"plain": load(), "no $schema": load_bytes(yaml.safe_dump({k: v for k, v in BASE.items() if k != "$schema"}).encode()), "newer": load(schema_version="1.7.0"), "whole word in any case": load(entities=[E | {"variants": {"case_insensitive": True, "whole_word": True}}]), "exceptions before 1.1.0": load(schema_version="1.0.0", allowlist=[{"id": "a", "kind": "literal", "pattern": "x"}])}
    return [(name, len(c.warnings)) for name, c in made.items()]


def found(spark, rows: list[tuple[str, str]], entities: list[dict], kind: str = "file", **more) -> tuple[list, list]:
    units = files.as_file_units(spark.createDataFrame(rows, "source_id string, content string"), kind)
    findings, suppressions = detect(units, compile_catalogs([load(entities=entities, **more)]))
    return [(r.source_id, r.entity_id, r.detector_id, r.line, r.col) for r in findings.collect()], [(r.source_id, r.entity_id, r.allowlist_id) for r in suppressions.collect()]


FOLD = {"variants": {"case_insensitive": True}}


@known("unit string, entity string, detector string, line long, col long", [("a", "e-3", "regex", 1, 6), ("b", "e-1", "literal", 1, 1), ("d", "e-2", "literal", 1, 2), ("e", "e-4", "literal", 2, 1)])
def fx_entity_rules(spark):
    """Patterns and tokens are matched as written, also where aliases ignore case; aliases come before tokens and patterns."""
    entities = [{"id": "e-1", "class": "codename", "aliases": ["quux"], "regex_patterns": ["ABC[0-9]"], **FOLD}, {"id": "e-2", "class": "codename", "tokens": [" tok "]}, {"id": "e-3", "class": "codename", "regex_patterns": ["x{2}y}+"]}, {"id": "e-4", "class": "codename", "aliases": ["ILT"]}]
    return found(spark, [("a", "abc1 xxy}}"), ("b", "QUUX ABC1"), ("c", "atok tok_"), ("d", "- tok -"), ("e", "tilt ILTx\nILT")], entities)[0]


@known("unit string, entity string, entry string", [("a", "e-1", "al-1"), ("c", "e-1", "al-2"), ("e", "e-1", "al-3")])
def fx_allow_rules(spark):
    """Exceptions are matched as written, white space included; a pattern is whole words only if it says so."""
    allow = [{"id": "al-1", "kind": "literal", "pattern": " zorblat "}, {"id": "al-2", "kind": "regex", "pattern": "ZORBLAT-[0-9]", "variants": {"case_insensitive": True, "whole_word": True}}, {"id": "al-3", "kind": "regex", "pattern": "q?zorblat[a-z]"}]
    rows = [("a", "one zorblat two"), ("b", "zorblat"), ("c", "zorblat-1"), ("d", "zorblat-12"), ("e", "qzorblatx"), ("f", "zorblatx zorblat")]
    return found(spark, rows, [{"id": "e-1", "class": "codename", "aliases": ["zorblat"]}], allowlist=allow)[1]


# ---- term lists, visibility, configuration

TERMS = "# terms\nZorblat==>ClientOne   # class=client_identity severity=high\nZorblatCorp==>ClientOne\nregex:x==>ProjectTwo\nregex:\\bQX-[0-9]{4}\\b  # severity=low\nallowlist:literal:QX-0000  # case_insensitive=true whole_word=true\n"


def _opaque(prefix: str, text: str) -> str:
    return f"='{prefix}' || substr(sha256({text}), 1, 12)"


@known("id string, class string, severity string, terms string, replacement string", [(_opaque("e-tl-", "'ClientOne'"), "client_identity", "high", "Zorblat,ZorblatCorp", "ClientOne"), (_opaque("e-tl-", "'ProjectTwo'"), "codename", None, "regex:x", "ProjectTwo"), (_opaque("e-rx-", "'\\bQX-[0-9]{4}\\b'"), "codename", "low", "\\bQX-[0-9]{4}\\b", None), (_opaque("al-tl-", "'literal' || chr(0) || 'QX-0000'"), "literal", None, "QX-0000", None)])
def fx_termlist(spark):
    """What a term list becomes. Lines with the separator are terms whatever they start with."""
    c = load_bytes(termlist.build(TERMS, "c-list"))
    rows = [(e["id"], e["class"], e.get("severity_override"), ",".join(e.get("aliases") or e["regex_patterns"]), e.get("replacement_suggestion")) for e in c.entities]
    return rows + [(a["id"], a["kind"], None, a["pattern"], None) for a in c.allowlist]


BAD_LINES = {"Zorblat": 1, "x==>y\nZorblat==>": 2, "==>x": 1, "a==>x # odd=1": 1, "# c\n\nregex:(": 3, "regex:a # whole_word=true": 1, "allowlist:literal:a # class=x": 1, "a==>x # class=codename\nb==>x # class=person": 2, "allowlist:regex:(": 1, "a==>b # severity": 1}


@known("text string, line long", [(f"={' || chr(10) || '.join(repr(x) for x in k.split(chr(10)))}", n) for k, n in BAD_LINES.items()])
def fx_termlist_errors(spark):
    out = []
    for text in BAD_LINES:
        try:
            termlist.build(text, "c")
        except termlist.TermListError as e:
            out.append((text, e.line))
    return out


@known("what string, n long", [("total", 4), ("public", 2), ("not_public", 1), ("unresolved", 1), ("added", 2), ("exceptions", 2), ("again unchanged", 1), ("conflict refused", 1)])
def fx_visibility_map(spark):
    base = yaml.safe_dump(BASE).encode()
    answers = {"o/a": "PUBLIC", "o/b": "private", "o/c": None, "o/d": " public "}
    text = "Zorblat==>o/a\nB==>o/b\nC==>o/c\nD==>o/d\nZorblat==>o/a\n"
    data, counts = visibility.allow_public(base, text, lambda r: visibility.classify(answers[r]))
    again, _ = visibility.allow_public(data, text, lambda r: visibility.classify(answers[r]))
    refused = 0
    with contextlib.suppress(CatalogError):
        refused = 1
        visibility.pairs("A==>x\nA==>y")
        refused = 0
    return [*counts.items(), ("exceptions", sum(a["variants"] == {"case_insensitive": True, "whole_word": True} for a in load_bytes(data).allowlist)), ("again unchanged", again == data), ("conflict refused", refused)]


@known("what string, value string", [("c-1 silent", "ok"), ("c-2 silent", "absent_optional"), ("c-2 warn", "missing_warn"), ("c-2 error", "refused"), ("posture of release", "error"), ("posture of ci", "warn"), ("posture of a flag", "warn"), ("posture of none", "silent"), ("threshold of release", "medium"), ("threshold of ci", "high"), ("threshold of policy", "low"), ("visibility of repo", "internal"), ("visibility of a flag", "local_only"), ("kind ftp", "refused"), ("id twice", "refused"), ("no repo id", "refused")])
def fx_config(spark):
    root = write(folder(), {"c.yaml": yaml.safe_dump(BASE)})
    doc = {"schema_version": "1", "repo": {"id": "r", "visibility": "internal"}, "policy": {"block_threshold": "low"}, "catalogs": [{"catalog_id": "c-1", "source": {"kind": "file", "path": "c.yaml"}}, {"catalog_id": "c-2", "optional": True, "source": {"kind": "env", "var": "HUSHGRID_NO_SUCH_VARIABLE"}}]}

    def tried(f) -> str:
        try:
            return str(f())
        except CatalogError:
            return "refused"

    cfg = config.load_config(yaml.safe_dump(doc).encode())
    parsed = lambda d: config.load_config(yaml.safe_dump(d).encode())
    one, two = config.resolve(cfg, root)
    return [
        ("c-1 silent", one.status), ("c-2 silent", two.status), ("c-2 warn", config.resolve(cfg, root, "warn")[1].status), ("c-2 error", tried(lambda: config.resolve(cfg, root, "error")[1].status)),
        ("posture of release", config.posture(None, "release", cfg)), ("posture of ci", config.posture(None, "ci", cfg)), ("posture of a flag", config.posture("warn", "release", cfg)), ("posture of none", config.posture(None, None, cfg)),
        ("threshold of release", config.threshold("release", cfg)), ("threshold of ci", config.threshold("ci", cfg)), ("threshold of policy", config.threshold(None, cfg)), ("visibility of repo", config.visibility(None, cfg)), ("visibility of a flag", config.visibility("local_only", cfg)),
        ("kind ftp", tried(lambda: parsed(doc | {"catalogs": [{"catalog_id": "x", "source": {"kind": "ftp"}}]}))), ("id twice", tried(lambda: parsed(doc | {"catalogs": doc["catalogs"][:1] * 2}))), ("no repo id", tried(lambda: parsed({"schema_version": "1", "repo": {}}))),
    ]


# ---- coverage, gates, verdicts

STATES = [("nothing", [], {}, "complete"), ("ignored only", [("ignored", 1, None)], {}, "complete"), ("one unreadable", [("unreadable", 1, None)], {}, "incomplete"), ("agreed to", [("unreadable", 1, None)], {"unreadable": 1}, "acknowledged"), ("one more than agreed to", [("unreadable", 2, None)], {"unreadable": 1}, "incomplete"), ("a gap is never agreed to", [("ignored", 1, "unfollowed_symlink")], {"unknown": 9}, "incomplete"), ("an odd reason is a gap", [("odd", 1, None)], {"unknown": 9}, "incomplete"), ("two kinds", [("binary_detected", 3, None), ("file_too_large", 1, None)], {"binary_detected": 3, "file_too_large": 1}, "acknowledged")]


@known("name string, status string, consistent long", [(n, s, 1) for n, _, _, s in STATES])
def fx_coverage_states(spark):
    out = []
    for name, rows, allowed, _ in STATES:
        s = coverage.summarize(spark.createDataFrame([("x", r, False, 0, gap, False, False, None) for r, n, gap in rows for _ in range(n)], files.SKIPS), allowances=allowed)
        try:
            coverage.validate(s)
            coverage.validate(s | {"status": "complete" if s["status"] != "complete" else "incomplete"})
            out.append((name, s["status"], 0))
        except ValueError:
            out.append((name, s["status"], 1))
    return out


@known("blocked long, mode string, status string, code long", [(1, "ci", "complete", 1), (0, "ci", "incomplete", 0), (0, "local", "incomplete", 0), (0, "release", "incomplete", 1), (0, "release", "acknowledged", 0), (0, "release", "complete", 0), (1, "release", "complete", 1)])
def fx_gate(spark):
    cases = [(1, "ci", "complete"), (0, "ci", "incomplete"), (0, "local", "incomplete"), (0, "release", "incomplete"), (0, "release", "acknowledged"), (0, "release", "complete"), (1, "release", "complete")]
    return [(*c, scan.gate(bool(c[0]), c[1], c[2])) for c in cases]


@known("name string, divergent string, reasons string, action string", [("main", "", "", None), ("backup/old", "e-client", "diverges_from_primary,name_pattern", "git push origin --delete backup/old"), ("v1", "e-tag", "diverges_from_primary", "git push origin --delete refs/tags/v1"), ("wip/x", "", "name_pattern", "git push origin --delete wip/x"), ("feature", "", "", None)])
def fx_publish_verdicts(spark):
    refs = spark.createDataFrame([("main", "branch", True), ("backup/old", "branch", True), ("v1", "tag", True), ("wip/x", "branch", False), ("feature", "branch", True)], "name string, kind string, scanned boolean")
    facts = spark.createDataFrame([("main", ["e-code"], False, 1), ("backup/old", ["e-client", "e-code"], True, 2), ("v1", ["e-tag"], False, 1), ("feature", ["e-code"], False, 1)], "ref string, entities array<string>, block_tier boolean, n_findings long")
    return [(r.name, ",".join(r.divergent_entities), ",".join(r.reasons), r.suggested_action) for r in publish.evaluate(refs, facts, "main").collect()]


ALIASES = [("Zor", "e-1", True), ("Zorblat", "e-2", False), ("e-2", "e-9", False), ("a.b", "e-3", False)]


@known("text string, clean string", [("Zorblat ZOR zorblat", "<r:e-2> <r:e-1> <r:e-1>blat"), ("e-2 Zorblat", "<r:e-9> <r:e-2>"), ("a.b axb", "<r:e-3> axb"), ("nothing", "nothing"), ("", "")])
def fx_redaction(spark):
    """The longest alias at a place wins; markers are never looked into again."""
    r = Redactor(ALIASES)
    return [(t, r(t)) for t in ("Zorblat ZOR zorblat", "e-2 Zorblat", "a.b axb", "nothing", "")]


RULES = "# c\n\nbuild/\n*.log\n!keep.log\n/top\ndocs/**\n"
PATHS = [("build", 1, 1), ("build", 0, 0), ("build/x.txt", 0, 1), ("a/x.log", 0, 1), ("keep.log", 0, 0), ("a/keep.log", 0, 0), ("top", 0, 1), ("a/top", 0, 0), ("docs/a/b", 0, 1), ("src/x", 0, 0)]


@known("path string, is_dir long, ignored long", PATHS)
def fx_ignore_rules(spark):
    return [(p, d, ignore.ignored(ignore.parse(RULES), p, bool(d))) for p, d, _ in PATHS]


GLOBS = [("*.go", "a.go", 1), ("*.go", "a/b.go", 0), ("**/x", "a/b/x", 1), ("**/x", "x", 1), ("a/**", "a/b/c", 1), ("a/**", "ab", 0), ("a?c", "abc", 1), ("[!a]b", "cb", 1), ("{a,b}.x", "b.x", 1), ("a.b", "axb", 0)]


@known("pattern string, path string, matches long, cleaned string", [(g, p, m, p) for g, p, m in GLOBS] + [("x", "./a//b/../x", 0, "a/x"), ("x", "a\\x", 0, "a/x")])
def fx_globs(spark):
    import re

    return [(g, p, bool(re.match(path_glob(g), clean_path(p))), clean_path(p)) for g, p, _ in GLOBS + [("x", "./a//b/../x", 0), ("x", "a\\x", 0)]]


NOW = dt.datetime(2026, 1, 2, tzinfo=dt.UTC)
RECORD = {"scan_timestamp": "2026-01-01T12:00:00+00:00", "catalog_hash": "h", "commit": "a", "exit_code": 0}
ATTESTED = {"same commit": ({}, ("a", None, False), 1), "parent, record alone changed": ({}, ("b", "a", True), 1), "parent, more changed": ({}, ("b", "a", False), 0), "other commit": ({"commit": "z"}, ("a", None, False), 0), "other catalogs": ({"catalog_hash": "x"}, ("a", None, False), 0), "scan failed": ({"exit_code": 1}, ("a", None, False), 0), "too old": ({"scan_timestamp": "2025-12-01T00:00:00+00:00"}, ("a", None, False), 0), "of the future": ({"scan_timestamp": "2026-02-01T00:00:00+00:00"}, ("a", None, False), 0)}


@known("name string, passes long", [(k, v[2]) for k, v in ATTESTED.items()])
def fx_attestations(spark):
    return [(k, not cli.verify(RECORD | change, *at, cli.duration("72h"), ["h"], NOW)) for k, (change, at, _) in ATTESTED.items()]


@known("what string, value string", [("hash", "='sha256:' || sha256('x' || chr(0) || '2' || chr(0) || 'x' || chr(0) || '1' || chr(0))"), ("label Jane Doe", "unknown"), ("label ci-bot", "ci-bot"), ("90m", "5400"), ("1h30s", "3630"), ("an hour", "refused")])
def fx_attestation_inputs(spark):
    def seconds(text: str) -> str:
        try:
            return str(int(cli.duration(text).total_seconds()))
        except CatalogError:
            return "refused"

    return [("hash", content_hash({"/b/x": b"1", "/a/x": b"2"})), *((f"label {x}", cli.operator_label(x)) for x in ("Jane Doe", "ci-bot")), *((x, seconds(x)) for x in ("90m", "1h30s", "an hour"))]


def _row(n: int, **change) -> dict:
    return {"id": f"f-{n:04d}", "fingerprint": f"{n:016d}", "severity": "high", "confidence": "high", "decision": "block", "entity_id": "e-1", "entity_class": "codename", "detector_id": "literal", "rule_id": "", "source_kind": "file", "surface": "content", "path": "b.txt", "source_id": "b.txt", "line": 1, "col": 1, "git_ref": "", "surface_kind": "working_tree", "replacement_id": "", "evidence_shape": "literal", "message": "m"} | change


@known("place long, id string, path string, fields string", [(0, "cw-0001", None, "source_id"), (1, "f-0003", "<r:e-1>/z.txt", "column,line,path,source_id,surface_kind"), (2, "f-0002", "b.txt", "column,line,path,source_id,surface_kind"), (3, "f-0001", "b.txt", "column,line,path,source_id,surface_kind"), (4, "f-0004", "b.txt", "column,git_ref,line,path,source_id,surface_kind")])
def fx_document(spark):
    """Records are put in order as they are shown, after redaction; warnings of the configuration are among them."""
    rows = [_row(1, line=2), _row(2), _row(3, path="zorblat/z.txt", source_id="zorblat/z.txt"), _row(4, git_ref="abc")]
    doc = document.scan_document(rows, {"scan_root": "zorblat"}, {}, {}, Redactor([("zorblat", "e-1", True)]), [document.config_warning("c-2", 1, "warn")])
    assert "zorblat" not in document.dumps(doc)
    return [(i, f["id"], f["location"].get("path"), ",".join(sorted(f["location"]))) for i, f in enumerate(doc["findings"])]


@known("place long, name string, leak long", [(0, "<r:e-1>-bak", 1), (1, "wip/x", 1), (2, "main", 0)])
def fx_audit_document(spark):
    verdicts = [{"name": n, "kind": "branch", "scanned": True, "leak_vector": leak, "reasons": [], "divergent_entities": [], "suggested_action": None} for n, leak in (("main", False), ("wip/x", True), ("zorblat-bak", True))]
    doc = document.audit_document([v | {"suggested_action": ""} for v in verdicts], {"publish_safe": False, "leak_vector_refs": ["wip/x", "zorblat-bak"]}, "main", {}, [], Redactor([("zorblat", "e-1", True)]))
    return [(i, r["name"], r["leak_vector"]) for i, r in enumerate(doc["refs"])]


# ---- folders, standard input, repositories


@known("path string, reason string, gap string", [(".gitignore", None, None), ("a/x y+z.txt", None, None), ("a/b.PNG", "binary_detected", None), ("big.txt", "file_too_large", None), ("build", "ignored", None), ("link", "ignored", "unfollowed_symlink"), ("t.tmp", "ignored", None)])
def fx_folder(spark):
    """Files that are read have no reason; .git is passed over in silence."""
    root = write(folder(), {"a/x y+z.txt": "hello", "a/b.PNG": "p", "big.txt": "x" * 50, "build/one": "1", "build/two": "2", ".gitignore": "build/\n*.tmp\n", "t.tmp": "t", ".git/config": "no"})
    os.symlink("big.txt", f"{root}/link")
    units, skips = files.read_folder(spark, root, cap=40)
    return [(r.source_id, None, None) for r in units.collect()] + [(r.source_id, r.reason, r.gap) for r in skips.collect()]


@known("reason string, files long, folders long", [("ignored", 4, 1), ("binary_detected", 1, 0)])
def fx_folder_counts(spark):
    """A folder that is passed over counts for the files below it."""
    root = write(folder(), {"build/a": "1", "build/b/c": "2", "build/b/d": "3", "x.log": "l", "y.zip": "z", ".gitignore": "build/\n*.log\n", "k.txt": "k"})
    return [tuple(r) for r in coverage.file_counts(files.read_folder(spark, root)[1]).select("reason", "files", "folders").collect()]


@known("kind string, surface string, path string, line long", [("branch_name", "branch_name", "", 1), ("commit_message", "commit_message", "", 2)])
def fx_stdin(spark):
    c = compile_catalogs([load(entities=[E | FOLD])])
    out = []
    for kind, text in (("branch_name", "feat/zorblat-fix\n"), ("commit_message", "Subject\nabout Zorblat\n")):
        out += [(r.source_kind, r.surface, r.path, r.line) for r in detect(tables.one(spark, text, kind), c)[0].collect()]
    return out


@cache
def repository() -> str:
    """Two commits on main, a backup of the first, a tag, and something staged."""
    root = write(folder(), {"a.txt": "line zorblat\n", "b.png": "line zorblat\n", "same.txt": "both\n", "same.png": "both\n"})
    run_git(root, "init", "-q", "-b", "main")
    run_git(root, "add", ".")
    run_git(root, "commit", "-qm", "first zorblat")
    run_git(root, "branch", "backup/old")
    write(root, {"a.txt": "line one\n", "c.txt": "x\nnew zorblat\n", "big.txt": "b" * 100 + "\n"})
    run_git(root, "rm", "-q", "b.png")
    run_git(root, "add", ".")
    run_git(root, "commit", "-qm", "second")
    run_git(root, "tag", "-a", "v1", "-m", "t")
    write(root, {"d.txt": "staged zorblat\n", "e.png": "p", "f.txt": "x" * 60})
    run_git(root, "add", "d.txt", "e.png", "f.txt")
    write(root, {"d.txt": "later"})
    return root


@known("path string, line_base long, content string, n_bytes long", [("a.txt", 1, "=concat('line one', chr(10))", 9), ("c.txt", 1, "=concat('x', chr(10), 'new zorblat', chr(10))", 14), ("big.txt", 1, "=concat(repeat('b', 100), chr(10))", 101)])
def fx_git_diff(spark):
    return [(r.source_id, r.line_base, r.content, r.n_bytes) for r in git.read_diff(spark, repository(), "backup/old").collect()]


@known("path string, content string, reason string", [("d.txt", "=concat('staged zorblat', chr(10))", None), ("e.png", None, "binary_detected"), ("f.txt", None, "file_too_large")])
def fx_git_staged(spark):
    units, skips = git.read_staged(spark, repository(), 40)
    return [(r.source_id, r.content, None) for r in units.collect()] + [(r.source_id, None, r.reason) for r in skips.collect()]


@known("path string, n_bytes long", [("a.txt", 9), ("c.txt", 14), ("big.txt", 101), ("same.txt", 5)])
def fx_git_archive(spark):
    units, _, unpacked = git.read_archive(spark, repository(), "v1")
    out = [(r.source_id, r.n_bytes) for r in units.collect()]
    shutil.rmtree(unpacked)
    return out


@known("name string, full_name string, kind string, same_as_main long", [("backup/old", "refs/heads/backup/old", "branch", 0), ("main", "refs/heads/main", "branch", 1), ("v1", "refs/tags/v1", "tag", 1)])
def fx_git_refs(spark):
    """Annotated tags stand for their commits."""
    rows = git.refs(repository())
    tips = {r[0]: r[3] for r in rows}
    return [(r[0], r[1], r[2], r[3] == tips["main"]) for r in rows if r[4]]


@known("given string, name string", [("refs/heads/dev", "dev"), ("refs/tags/v1", "v1"), (" dev ", "dev"), ("", "main"), ("remote", "main")])
def fx_git_primary(spark):
    """The ref that others are compared with: the one given, else the remote's, else main."""
    other = f"{folder()}/clone"
    subprocess.run(["git", "clone", "-q", repository(), other], check=True, capture_output=True)
    return [(x, git.primary(repository(), None, x)) for x in ("refs/heads/dev", "refs/tags/v1", " dev ", "")] + [("remote", git.primary(other, "origin"))]


@known("path string, commits long", [("a.txt", 2), ("b.png", 1), ("big.txt", 1), ("c.txt", 1), ("same.png", 2), ("same.txt", 2)])
def fx_git_trees(spark):
    return [tuple(r) for r in git.blob_attr(spark, repository()).groupBy("path").agg(F.countDistinct("commit")).collect()]


@known("kind string, source string, counted string", [("git_history_blob", "=concat('line one', chr(10))", None), ("git_history_blob", "=concat('line zorblat', chr(10))", None), ("git_history_blob", "=concat('x', chr(10), 'new zorblat', chr(10))", None), ("git_history_blob", "=concat('both', chr(10))", None), ("git_commit_message", "first zorblat", None), ("git_commit_message", "second", None), ("binary_detected", "b.png", "files"), ("binary_detected", "same.png", "files"), ("binary_detected", "same.png", "files"), ("file_too_large", "big.txt", "coverage,files")])
def fx_git_history(spark):
    """Contents are read once, those at a path that isn't binary; sizes are known before contents are read. A binary path counts at each commit, but for coverage only where a blob has no other."""
    units, skips, _ = git.read_history(spark, repository(), cap=60)
    rows = [(r.source_kind, r.content.rstrip("\n") if r.source_kind == "git_commit_message" else r.content, None) for r in units.collect()]
    return rows + [(r.reason, r.source_id, ",".join(["coverage"] * (not r.coverage_excluded) + ["files"] * (not r.legacy_excluded))) for r in skips.collect()]


@known("surface string, path string, message string", [("commit_message", None, "first"), ("content", "a.txt", "first"), ("content", "c.txt", "second")])
def fx_history_findings(spark):
    """What a deleted line showed is found at the commit that showed it."""
    report = scan.run_history(spark, repository(), [load(entities=[E | FOLD])])
    said = lambda c: git.git(repository(), "log", "-1", "--format=%s", c).decode().split()[0]
    return [(f["surface"], f["location"].get("path"), said(f["location"]["git_ref"])) for f in report.document["findings"]]


@known("path string, refs string", [("a.txt", "backup/old"), ("a.txt", "main,v1"), ("a.txt", "backup/old,main,v1"), ("b.png", "backup/old,main,v1")][2:] + [("big.txt", "main,v1"), ("c.txt", "main,v1"), ("same.png", "backup/old,main,v1"), ("same.txt", "backup/old,main,v1")])
def fx_publish_surface(spark):
    """Which refs reach a path, by their whole histories."""
    tips = [(r[0], r[3]) for r in git.refs(repository())]
    rows = git.publish_surface(spark, repository(), tips).groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("ref")), ",").alias("refs"))
    return [tuple(r) for r in rows.collect()]


@cache
def surface() -> str:
    """main is clean; a binary file lies on backup/x alone, and a secret on topic."""
    root = write(folder(), {"ok.txt": "fine\n"})
    run_git(root, "init", "-q", "-b", "main")
    run_git(root, "add", ".")
    run_git(root, "commit", "-qm", "one")
    run_git(root, "checkout", "-q", "-b", "topic")
    write(root, {"s.txt": "zorblat\n"})
    run_git(root, "add", ".")
    run_git(root, "commit", "-qm", "two")
    run_git(root, "checkout", "-q", "-b", "backup/x", "main")
    write(root, {"p.png": "zorblat as well\n"})
    run_git(root, "add", ".")
    run_git(root, "commit", "-qm", "three")
    return root


@known("name string, scanned long, reasons string", [("backup/x", 0, "name_pattern"), ("topic", 1, "diverges_from_primary"), ("main", 1, ""), ("coverage", 0, "binary_detected=1"), ("said", 1, "=concat('scan skip: kind=file reason=binary_detected source=', 'BLOB detail=n/a')")])
def fx_audit(spark):
    """Binary contents are skipped, and their refs don't count as scanned."""
    lines: list[str] = []
    doc = scan.run_audit(spark, surface(), [load(entities=[E | FOLD])], say=lines.append).document
    skipped = ",".join(f"{k}={v}" for k, v in doc["coverage"]["skips_by_reason"].items())
    blob = git.git(surface(), "rev-parse", "backup/x:p.png").decode().strip()
    own = [x.replace(blob, "BLOB") for x in lines]
    return [(r["name"], r["scanned"], ",".join(r["reasons"])) for r in doc["refs"]] + [("coverage", doc["coverage"]["status"] == "complete", skipped)] + [("said", 1, x) for x in own]


@known("n long, line string", [(0, "catalog warning: $schema is not given"), (1, "scan skip: kind=file reason=binary_detected source=a.png detail=n/a"), (2, "scan skip: kind=directory reason=ignored source=<r:e-1>-out files=2 detail=n/a"), (3, "allowlist suppression: allowlist_id=al-1 entity_id=e-1 surface=content source=k.txt"), (4, "allowlist suppression: allowlist_id=al-1 entity_id=e-1 surface=path source=<r:e-1>-public.txt")])
def fx_stderr(spark):
    """Lines for people: redacted, in order, of folders the number of files alone."""
    own = {k: v for k, v in BASE.items() if k != "$schema"} | {"entities": [E | FOLD], "allowlist": [{"id": "al-1", "kind": "literal", "pattern": "zorblat-public"}]}
    root = write(folder(), {"c/c.yaml": yaml.safe_dump(own), "r/zorblat-out/a": "1", "r/zorblat-out/b": "2", "r/a.png": "p", "r/k.txt": "a zorblat-public b", "r/zorblat-public.txt": "x", "r/.gitignore": "*-out/\n"})
    with console(spark) as err:
        cli.main(["scan", f"{root}/r", "--catalog", f"{root}/c/c.yaml", "--explain"])
    return list(enumerate(err.getvalue().splitlines()))


EXITS = {"clean": 0, "finding": 1, "no catalog": 2, "bad allowance": 2, "no such folder": 3, "release with a gap": 1, "release agreed to": 0, "warn tier": 0, "warn tier at release": 1, "branch name": 1}


@known("name string, code long", list(EXITS.items()))
def fx_exit_codes(spark):
    root = write(folder(), {"c.yaml": yaml.safe_dump(BASE | {"entities": [E | FOLD]}), "m.yaml": yaml.safe_dump(BASE | {"entities": [E | FOLD | {"severity_override": "medium"}]}), "clean/a.txt": "x", "hit/a.txt": "zorblat", "gap/a.png": "p", "gap/b.txt": "b"})
    c, m = ["--catalog", f"{root}/c.yaml"], ["--catalog", f"{root}/m.yaml"]
    runs = {"clean": [f"{root}/clean", *c], "finding": [f"{root}/hit", *c], "no catalog": [f"{root}/hit"], "bad allowance": [f"{root}/hit", *c, "--allow-skips", "x"], "no such folder": [f"{root}/none", *c], "release with a gap": [f"{root}/gap", *c, "--mode", "release"], "release agreed to": [f"{root}/gap", *c, "--mode", "release", "--allow-skips", "binary_detected=1"], "warn tier": [f"{root}/hit", *m], "warn tier at release": [f"{root}/hit", *m, "--mode", "release"], "branch name": [".", *c, "--branch-name-stdin"]}
    with console(spark, "feat/zorblat\n"):
        return [(name, cli.main(["scan", *args])) for name, args in runs.items()]


@known("given string, folder string, ref string", [("", ".", "HEAD"), ("/", "/", "HEAD"), ("v1", ".", "v1"), ("/ v2", "/", "v2"), ("nowhere-at-all v2", None, None)])
def fx_archive_target(spark):
    out = []
    for given in ("", "/", "v1", "/ v2", "nowhere-at-all v2"):
        try:
            out.append((given, *git.archive_target(given.split(), "")))
        except ValueError:
            out.append((given, None, None))
    return out


@known("step string, code long", [("scan blocked, no record", 1), ("record written", 0), ("committed record verifies", 0), ("later commit does not", 1), ("mode of a catalog file", 0o600), ("builtin entities", 2)])
def fx_commands(spark):
    from hushgrid.sources.catalog import load_builtin

    root = write(folder(), {"c.yaml": yaml.safe_dump(BASE | {"entities": [E | FOLD]}), "r/a.txt": "x\n", "terms.txt": "Zorblat==>One\n"})
    repo, catalog = f"{root}/r", ["--catalog", f"{root}/c.yaml"]
    run_git(repo, "init", "-q", "-b", "main")
    run_git(repo, "add", ".")
    run_git(repo, "commit", "-qm", "one")
    with console(spark):
        write(repo, {"b.txt": "zorblat\n"})
        out = [("scan blocked, no record", cli.main(["attest", repo, *catalog]) if not os.path.exists(f"{repo}/.hushgrid/attestation.json") else -1)]
        os.unlink(f"{repo}/b.txt")
        out.append(("record written", cli.main(["attest", repo, *catalog, "--operator", "ci-bot"])))
        run_git(repo, "commit", "-qm", "record")
        out.append(("committed record verifies", cli.main(["verify-attestation", repo])))
        write(repo, {"a.txt": "y\n"})
        run_git(repo, "commit", "-qam", "later")
        out.append(("later commit does not", cli.main(["verify-attestation", repo])))
        cli.main(["catalog", "build", "--from", f"{root}/terms.txt", "--id", "c-x", "--out", f"{root}/o.yaml"])
    assert load_file(f"{root}/o.yaml").id == "c-x"
    return [*out, ("mode of a catalog file", os.stat(f"{root}/o.yaml").st_mode & 0o777), ("builtin entities", len(load_builtin("public-baseline").entities))]


def fx_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of the documents as they come in, in files of a stream."""
    from hushgrid.plans.queries import MAIN
    from hushgrid.streaming.detect import read_units, stream_findings

    root = folder()
    units = tables.documents(spark, sf_dir)
    units.repartition(3).write.parquet(f"file://{root}/in")
    stream = read_units(spark, f"file://{root}/in", units.schema.simpleString()[7:-1].replace(":", " "), 1)
    stream_findings(stream, MAIN, f"file://{root}/out", f"file://{root}/cp", once=True).awaitTermination()
    return spark.read.parquet(f"file://{root}/out/findings").select("unit_id", "entity_id", "surface", "fingerprint")

import os
import subprocess

import pytest
import yaml

from hushgrid.sources import config, git, termlist, visibility
from hushgrid.sources.catalog import CatalogError, content_hash, load_builtin, load_bytes, unsafe_ids
from hushgrid.sources.files import read_folder

BASE = {"catalog_id": "c-1", "schema_version": "1.1.0", "default_severity": "low", "entities": [{"id": "e-1", "class": "codename", "aliases": ["Zorblat"]}]}


def load(**change):
    return load_bytes(yaml.safe_dump(BASE | change).encode())


@pytest.mark.parametrize("change", [
    {"schema_version": "2.0.0"}, {"schema_version": "x"}, {"entities": []}, {"odd": 1}, {"catalog_id": "-x"}, {"default_severity": "huge"},
    {"entities": [{"id": "e", "class": "codename"}]}, {"entities": [{"id": "e", "class": "none", "aliases": ["a"]}]}, {"entities": [{"id": "e", "class": "codename", "match": "a"}]},
    {"entities": [{"id": "e", "class": "codename", "aliases": ["q"]}] * 2}, {"entities": [{"id": "e-zorblat", "class": "codename", "aliases": ["zorblat"]}]},
    {"entities": [{"id": "e", "class": "codename", "aliases": ["q"], "variants": {"slug": "yes"}}]},
    {"co_occurrence_rules": [{"rule_id": "r", "terms": ["e-1"], "window_kind": "file"}]}, {"co_occurrence_rules": [{"rule_id": "r", "terms": ["e-1", "e-9"], "window_kind": "file"}]}, {"co_occurrence_rules": [{"rule_id": "r", "terms": ["e-1", "e-1"], "window_kind": "file"}]},
    {"co_occurrence_rules": [{"rule_id": "r", "terms": ["e-1", "e-2"], "window_kind": "near_n_chars"}]}, {"allowlist": [{"id": "a", "kind": "glob", "pattern": "x"}]}, {"allowlist": [{"id": "a", "kind": "regex", "pattern": "(?=x)"}]}, {"allowlist": [{"id": "a", "kind": "literal", "pattern": " "}]},
])
def test_bad_catalogs_are_refused_without_showing_values(change):
    with pytest.raises(CatalogError) as e:
        load(**change)
    assert "orblat" not in str(e.value)


def test_good_catalogs_and_their_warnings():
    assert "$schema is not given" in load().warnings
    assert any("newer" in w for w in load(schema_version="1.9.0").warnings)
    assert load_builtin("public-baseline").entities and load().aliases() == [("Zorblat", "e-1", False)]
    with pytest.raises(CatalogError):
        load_builtin("none")
    with pytest.raises(CatalogError):
        unsafe_ids([load(), load(catalog_id="c-Zorblat")])
    assert content_hash({"/b/x": b"1", "/a/x": b"2"}).startswith("sha256:")


LIST = """# terms
Zorblat==>ClientOne   # class=client_identity severity=high
ZorblatCorp==>ClientOne
Quux==>ProjectTwo
regex:\\bQX-[0-9]{4}\\b  # class=operational_pattern severity=high
allowlist:literal:QX-0000  # case_insensitive=true whole_word=true
"""


def test_term_lists():
    c = load_bytes(termlist.build(LIST, "c-list"))
    ids = {e["id"]: e for e in c.entities}
    one = ids[termlist.opaque("e-tl-", "ClientOne")]
    assert one["aliases"] == ["Zorblat", "ZorblatCorp"] and one["severity_override"] == "high" and one["variants"]["whole_word"]
    assert list(ids) == sorted(ids) and c.allowlist[0]["variants"] == {"case_insensitive": True, "whole_word": True}


@pytest.mark.parametrize("line", ["Zorblat", "==>x", "Zorblat==>", "Zorblat==>x # odd=1", "Zorblat==>x # class", "regex:(", "regex: ", "regex:a # whole_word=true", "allowlist:literal:a # class=x", "allowlist:regex:(", "a==>x # class=codename\nb==>x # class=person", "allowlist:literal:a # whole_word=maybe"])
def test_bad_term_lists_name_the_line_only(line):
    with pytest.raises(CatalogError) as e:
        termlist.build(line, "c")
    assert "line" in str(e.value) and "orblat" not in str(e.value)


def test_public_codenames_become_exceptions():
    base = yaml.safe_dump(BASE).encode()
    verdicts = {"o/a": "public", "o/b": "not_public", "o/c": "?"}
    data, counts = visibility.allow_public(base, "Zorblat==>o/a\nB==>o/b\nC==>o/c\nZorblat==>o/a\n", verdicts.get)
    assert counts == {"total": 3, "public": 1, "not_public": 1, "unresolved": 1, "added": 1}
    assert load_bytes(data).allowlist[0]["pattern"] == "Zorblat"
    assert visibility.allow_public(data, "Zorblat==>o/a", verdicts.get)[0] == data
    with pytest.raises(CatalogError):
        visibility.pairs("A==>x\nA==>y")


def test_configuration(tmp_path, monkeypatch):
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(BASE))
    doc = {"schema_version": "1", "repo": {"id": "r", "visibility": "internal"}, "catalogs": [{"catalog_id": "c-1", "source": {"kind": "file", "path": "c.yaml"}}, {"catalog_id": "c-2", "optional": True, "source": {"kind": "env", "var": "NO_SUCH_VARIABLE"}}]}
    cfg = config.load_config(yaml.safe_dump(doc).encode())
    assert [r.status for r in config.resolve(cfg, str(tmp_path))] == ["ok", "absent_optional"]
    assert config.resolve(cfg, str(tmp_path), "warn")[1].status == "missing_warn"
    with pytest.raises(CatalogError):
        config.resolve(cfg, str(tmp_path), "error")
    assert config.posture(None, "release", cfg) == "error" and config.posture("warn", "release", cfg) == "warn" and config.posture(None, None, cfg) == "silent"
    assert config.threshold("release", cfg) == "medium" and config.threshold(None, cfg) == "high" and config.visibility(None, cfg) == "internal"
    for bad in ({"repo": {}}, doc | {"catalogs": doc["catalogs"][:1] * 2}, doc | {"catalogs": [{"catalog_id": "x", "source": {"kind": "ftp"}}]}, doc | {"policy": {"private_catalog_missing": "x"}}):
        with pytest.raises(CatalogError):
            config.load_config(yaml.safe_dump(bad).encode())


def test_folders(spark, tmp_path):
    files = {"a/x y+z.txt": "hello", "a/b.png": "p", "big.txt": "x" * 50, "build/one": "1", "build/two": "2", ".gitignore": "build/\n*.tmp\n", "t.tmp": "t", ".git/config": "no"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    os.symlink("big.txt", tmp_path / "link")
    units, skips = read_folder(spark, str(tmp_path), cap=40)
    assert {r.source_id: r.content for r in units.collect()} == {"a/x y+z.txt": "hello", ".gitignore": files[".gitignore"]}
    got = {r.source_id: (r.reason, r.is_dir, r.represented, r.gap) for r in skips.collect()}
    assert got == {"a/b.png": ("binary_detected", False, 0, None), "big.txt": ("file_too_large", False, 0, None), "build": ("ignored", True, 2, None), "t.tmp": ("ignored", False, 0, None), "link": ("ignored", False, 0, "unfollowed_symlink")}
    with pytest.raises(NotADirectoryError):
        read_folder(spark, str(tmp_path / "big.txt"))


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "r"
    root.mkdir()

    def run(*args):
        subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b", *args], check=True, capture_output=True)

    run("init", "-q", "-b", "main")
    (root / "a.txt").write_text("line zorblat\n")
    (root / "b.png").write_text("line zorblat\n")
    run("add", ".")
    run("commit", "-qm", "first zorblat")
    run("branch", "backup/old")
    (root / "a.txt").write_text("line one\n")
    (root / "c.txt").write_text("x\nnew zorblat\n")
    run("rm", "-q", "b.png")
    run("add", ".")
    run("commit", "-qm", "second")
    run("tag", "-a", "v1", "-m", "t")
    return str(root), run, root


def test_git_sources(spark, repo):
    root, run, path = repo
    assert len(git.commits(root)) == 2
    assert [(r[0], r[2]) for r in git.refs(root)] == [("backup/old", "branch"), ("main", "branch"), ("v1", "tag")]
    assert git.refs(root)[1][3] == git.refs(root)[2][3]
    diff = git.read_diff(spark, root, "backup/old").collect()
    assert sorted((r.source_id, r.line_base, r.content) for r in diff) == [("a.txt", 1, "line one\n"), ("c.txt", 1, "x\nnew zorblat\n")]
    (path / "d.txt").write_text("staged zorblat")
    run("add", "d.txt")
    (path / "d.txt").write_text("later")
    units, _ = git.read_staged(spark, root)
    assert [(r.source_id, r.content, r.stage) for r in units.collect()] == [("d.txt", "staged zorblat", "index")]
    units, skips, attr = git.read_history(spark, root)
    assert units.where("source_kind = 'git_history_blob'").count() == 3 and units.where("source_kind = 'git_commit_message'").count() == 2
    assert {r.path for r in attr.collect()} == {"a.txt", "c.txt"}
    with pytest.raises(git.GitError):
        git.check(str(path.parent))


def test_history_and_audit(spark, repo):
    from hushgrid.plans.scan import run_audit, run_history

    root = repo[0]
    catalog = load(entities=[{"id": "e-1", "class": "codename", "aliases": ["zorblat"], "severity_override": "high"}])
    report = run_history(spark, root, [catalog])
    at = sorted((f["location"].get("path", ""), f["surface"]) for f in report.document["findings"])
    assert at == [("", "commit_message"), ("a.txt", "content"), ("c.txt", "content")] and report.exit_code == 1
    audit = run_audit(spark, root, [catalog]).document
    assert not audit["publish_safe"] and audit["leak_vector_refs"] == ["backup/old"] and audit["primary_ref"] == "main"
    names = run_audit(spark, root, [], names_only=True).document
    assert names["leak_vector_refs"] == ["backup/old"] and names["coverage"]["status"] == "incomplete"


def test_more_findings_than_a_document_holds(spark, repo, tmp_path, monkeypatch):
    from hushgrid.plans import scan

    root = repo[0]
    catalog = load(entities=[{"id": "e-1", "class": "codename", "aliases": ["zorblat"], "severity_override": "high"}, {"id": "e-2", "class": "codename", "aliases": ["c.txt"]}])
    whole = scan.run_history(spark, root, [catalog])
    audit = scan.run_audit(spark, root, [catalog])
    monkeypatch.setattr(scan, "MOST_IN_DOCUMENT", 0)
    for run, want, name in ((scan.run_history, whole, "h"), (scan.run_audit, audit, "a")):
        path = str(tmp_path / name)
        got = run(spark, root, [catalog], table=path)
        at = got.document if name == "a" else got.document["scan_metadata"]
        assert at["findings_table"] == path and got.document["findings"] == [] and got.exit_code == want.exit_code
        if name == "h":
            assert got.document["summary"] == want.document["summary"]
        rows = [r.asDict() for r in spark.read.parquet(path).coalesce(1).collect()]
        key = lambda r: r["id"]
        assert sorted((scan.document.finding_record(r, None) for r in rows), key=key) == sorted(want.document["findings"], key=key) and rows
        assert "c.txt" not in str(rows)

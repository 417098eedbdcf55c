import datetime as dt
import itertools
import json

import duckdb
import pytest

import __spark_entry__
from hushgrid import cli
from hushgrid.operators import coverage, publish
from hushgrid.operators.counts import numbered
from hushgrid.operators.redact import Redactor
from hushgrid.plans import queries
from hushgrid.plans.scan import gate

SKIPS = "source_id string, reason string, is_dir boolean, represented long, gap string, coverage_excluded boolean, legacy_excluded boolean, blob string"


def skip(reason, is_dir=False, n=0, gap=None, out=False):
    return ("x", reason, is_dir, n, gap, out, False, None)


@pytest.mark.parametrize(("rows", "allow", "status"), [
    ([], {}, "complete"), ([skip("ignored")], {}, "complete"), ([skip("unreadable")], {}, "incomplete"), ([skip("unreadable")], {"unreadable": 1}, "acknowledged"), ([skip("unreadable")] * 2, {"unreadable": 1}, "incomplete"),
    ([skip("ignored", gap="unfollowed_symlink")], {}, "incomplete"), ([skip("odd")], {"unknown": 9}, "incomplete"), ([skip("file_too_large", True, 0)], {}, "complete"), ([skip("file_too_large", True, -1)], {}, "incomplete"), ([skip("unreadable", out=True)], {}, "complete"),
])
def test_coverage(spark, rows, allow, status):
    s = coverage.summarize(spark.createDataFrame(rows, SKIPS), allowances=allow)
    coverage.validate(s)
    assert s["status"] == status
    with pytest.raises(ValueError):
        coverage.validate(s | {"status": "complete" if status != "complete" else "incomplete"})


def test_allowances():
    assert coverage.parse_allowances(["unreadable=3", "unknown=0"]) == {"unreadable": 3, "unknown": 0}
    for bad in (["ignored=1"], ["unreadable=-1"], ["unreadable"], ["unreadable=1", "unreadable=2"], ["unreadable=99999999999"]):
        with pytest.raises(ValueError):
            coverage.parse_allowances(bad)


@pytest.mark.parametrize(("blocked", "mode", "status", "code"), [(True, None, "complete", 1), (False, None, "incomplete", 0), (False, "release", "incomplete", 1), (False, "release", "acknowledged", 0), (False, "ci", "incomplete", 0)])
def test_gate(blocked, mode, status, code):
    assert gate(blocked, mode, status) == code


def verdicts(spark, refs, facts, **more):
    r = spark.createDataFrame(refs, "name string, kind string, scanned boolean")
    f = spark.createDataFrame(facts, "ref string, entities array<string>, block_tier boolean, n_findings long")
    return {v.name: v for v in publish.evaluate(r, f, "main", **more).collect()}


def test_publish_verdicts(spark):
    refs = [("main", "branch", True), ("backup/old", "branch", True), ("v1", "tag", True), ("feat", "branch", False)]
    facts = [("main", ["e-2"], False, 1), ("backup/old", ["e-1", "e-2"], True, 2), ("v1", ["e-3"], False, 1)]
    v = verdicts(spark, refs, facts)
    assert v["backup/old"].reasons == ["diverges_from_primary", "name_pattern"] and v["backup/old"].divergent_entities == ["e-1"]
    assert v["v1"].suggested_action == "git push origin --delete refs/tags/v1" and not v["main"].leak_vector and not v["feat"].leak_vector
    v = verdicts(spark, refs, facts, baseline_scanned=False)
    assert v["v1"].reasons == [] and v["backup/old"].reasons == ["name_pattern"]
    v = verdicts(spark, refs, facts[1:])
    assert v["v1"].reasons == ["diverges_from_primary"]


def test_redaction_is_one_pass():
    r = Redactor([("Zor", "e-1", True), ("Zorblat", "e-2", False), ("e-2", "e-9", False)])
    assert r("Zorblat ZOR zorblat") == "<r:e-2> <r:e-1> <r:e-1>blat" and r(None) is None and r("") == ""
    with pytest.raises(ValueError):
        Redactor([("", "e", True)])


def test_numbers_follow_the_order(spark):
    rows = [(str(i % 3), f"p{i % 7}", "k", "s", i, i, "d", str(i)) for i in range(200)]
    got = numbered(spark.createDataFrame(rows, "git_ref string, path string, surface_kind string, surface string, line long, col long, detector_id string, fingerprint string").repartition(5)).collect()
    assert [r.id for r in sorted(got, key=lambda r: (r.git_ref, r.path, r.line))] == [f"f-{i:04d}" for i in range(1, 201)]


def test_streams_find_what_batches_find(spark, sf_dir, tmp_path):
    from hushgrid.plans.queries import MAIN, findings_of
    from hushgrid.sources import tables
    from hushgrid.streaming.detect import read_units, stream_findings

    units = tables.documents(spark, sf_dir)
    units.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = read_units(spark, f"file://{tmp_path}/in", units.schema.simpleString()[7:-1].replace(":", " "), 1)
    stream_findings(stream, MAIN, f"file://{tmp_path}/out", f"file://{tmp_path}/cp", once=True).awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out/findings").select("fingerprint")
    want = findings_of(spark, sf_dir).select("fingerprint")
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()


CATALOG = "catalog_id: c-1\nschema_version: 1.1.0\nentities:\n- {id: e-1, class: codename, aliases: [zorblat], severity_override: high}\n"


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "c.yaml").write_text(CATALOG)
    (tmp_path / "r").mkdir()
    (tmp_path / "r/zorblat.txt").write_text("clean")
    monkeypatch.setattr(cli, "session", lambda: spark)
    args = ["scan", str(tmp_path / "r"), "--catalog", str(tmp_path / "c.yaml")]
    assert cli.main(args) == 1
    doc = json.loads(capsys.readouterr().out)
    assert doc["summary"]["findings_total"] == 1 and doc["findings"][0]["location"]["path"] == "<r:e-1>.txt" and "zorblat" not in json.dumps(doc)
    assert cli.main([*args[:2]]) == 2 and cli.main([*args, "--allow-skips", "x"]) == 2
    assert cli.main(["scan", str(tmp_path / "none"), *args[2:]]) == 3
    (tmp_path / "t.txt").write_text("Zorblat==>One\n")
    assert cli.main(["catalog", "build", "--from", str(tmp_path / "t.txt"), "--id", "c-x", "--out", str(tmp_path / "o.yaml")]) == 0
    assert (tmp_path / "o.yaml").stat().st_mode & 0o777 == 0o600


def test_attestations():
    now = dt.datetime(2026, 1, 2, tzinfo=dt.UTC)
    record = {"scan_timestamp": "2026-01-01T12:00:00+00:00", "catalog_hash": "h", "commit": "a", "exit_code": 0}
    day = cli.duration("24h")
    assert cli.verify(record, "a", None, False, day, ["h"], now) == [] == cli.verify(record, "b", "a", True, day, [], now)
    for change, args in ({"commit": "z"}, {}), ({}, {"hashes": ["x"]}), ({"exit_code": 1}, {}), ({"scan_timestamp": "2025-01-01T00:00:00+00:00"}, {}):
        assert cli.verify(record | change, "a", None, False, day, args.get("hashes", []), now)
    assert cli.operator_label("Jane Doe") == "unknown" and cli.operator_label("ci-bot") == "ci-bot"


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_against_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = con.sql(f"select {', '.join(columns)} from ({queries.ORACLE_SQL[name]})").fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    key = lambda r: [(v is not None, v) for v in r]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_redaction_of_a_table_is_that_of_each_text(spark, sf_dir):
    import hashlib

    r = Redactor([("license", "e-terms", True), ("Apache License", "e-both", False), ("apache", "e-owner", True), ("terms", "e-x", True)])
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for row in queries.redact_many(spark, sf_dir).collect():
        assert row.sha256 == hashlib.sha256(r(texts[row.doc_id]).encode()).hexdigest()


def test_the_entry_points(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
    assert len(list(itertools.chain(queries.QUERIES))) > 50

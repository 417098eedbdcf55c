import pytest
from pyspark.sql import functions as F

from hushgrid.operators.detect import Text, detect, detect_native, fold
from hushgrid.plans.queries import compiled, entity
from hushgrid.sources.files import as_file_units


def units(spark, rows, kind="file"):
    return as_file_units(spark.createDataFrame(rows, "source_id string, content string"), kind)


def found(spark, rows, c, kind="file", **more):
    u = units(spark, rows, kind).withColumns({k: F.lit(v) for k, v in more.items()})
    f, s = detect(u, c)
    return sorted((r.path, r.surface, r.entity_id, r.detector_id, r.severity, r.line, r.col) for r in f.collect()), sorted((r.path, r.surface, r.entity_id, r.allowlist_id) for r in s.collect())


CI = {"case_insensitive": True}
C1 = entity("e-1", "client_identity", aliases=["Zorblat"], **CI, severity_override="critical")
C2 = entity("e-2", aliases=["ILT"], severity_override="high")
C3 = entity("e-3", tokens=["tok"])
C4 = entity("e-4", regex_patterns=[r"\bQX-[0-9]+\b"])


def test_places_and_surfaces(spark):
    rows = [("a/zorblat-x/b.go", "x\nthe ZORBLAT here"), ("c.txt", "built tilt ILT, tok_ tok"), ("d.txt", "QX-1 QX-22"), ("e.txt", None), ("f.txt", "")]
    got, sup = found(spark, rows, compiled([C1, C2, C3, C4]))
    assert got == [("a/zorblat-x/b.go", "content", "e-1", "literal", "critical", 2, 5), ("a/zorblat-x/b.go", "path", "e-1", "path-segment", "critical", 0, 0), ("c.txt", "content", "e-2", "literal", "high", 1, 12), ("c.txt", "content", "e-3", "literal", "medium", 1, 22), ("d.txt", "content", "e-4", "regex", "medium", 1, 1)]
    assert sup == []


@pytest.mark.parametrize(("kind", "surface", "path"), [("branch_name", "branch_name", ""), ("commit_message", "commit_message", ""), ("git_commit_message", "commit_message", ""), ("git_diff", "diff", "zorblat/x"), ("git_history_blob", "content", "zorblat/x")])
def test_kinds_of_units(spark, kind, surface, path):
    got, _ = found(spark, [("zorblat/x", "zorblat")], compiled([C1]), kind)
    assert (path, surface, "e-1", "literal", "critical", 1, 1) in got and (len(got) == 2) == (kind == "git_history_blob")


def test_lines_of_hunks_start_at_their_base(spark):
    assert found(spark, [("x", "a\nzorblat")], compiled([C1]), "git_diff", line_base=10)[0][0][5] == 11


def test_the_first_literal_of_the_list_wins(spark):
    c = compiled([entity("e-1", aliases=["later", "early"], regex_patterns=["first"])])
    assert found(spark, [("x", "first early later")], c)[0] == [("x", "content", "e-1", "literal", "medium", 1, 13)]


def test_visibility_and_threshold(spark):
    c = compiled([entity("e-1", aliases=["zorblat"], allowed_in=["internal"])], visibility="internal")
    assert found(spark, [("x", "zorblat")], c) == ([], [])
    for threshold, want in (("low", "block"), ("high", "warn")):
        f, _ = detect(units(spark, [("x", "zorblat")]), compiled([entity("e-1", aliases=["zorblat"])], threshold=threshold))
        assert f.collect()[0].decision == want


def test_co_occurrence_takes_the_first_terms_finding(spark):
    rules = [{"rule_id": "r-1", "terms": ["e-1", "e-2"], "window_kind": "file", "severity_override": "low"}, {"rule_id": "r-2", "terms": ["e-2", "e-1"], "window_kind": "file", "apply_in": ["internal"]}]
    got, _ = found(spark, [("a/zorblat", "zorblat ILT"), ("b", "ILT only"), ("c", "ILT\nzorblat")], compiled([C1, C2], rules))
    assert [g for g in got if g[3] == "co-occurrence"] == [("a/zorblat", "path", "e-1", "co-occurrence", "low", 0, 0), ("c", "content", "e-1", "co-occurrence", "low", 2, 1)]


def literal(id, pattern, **v):
    return {"id": id, "kind": "literal", "pattern": pattern, "variants": v}


def test_the_allowlist_subtracts_before_matching(spark):
    allow = [literal("al-1", "zorblat-public", **CI), {"id": "al-2", "kind": "regex", "pattern": "v[0-9] zorblat"}]
    rows = [("a", "Zorblat-Public"), ("b", "zorblat-public and zorblat"), ("c", "xzorblat-publi"), ("d", "v1 zorblat"), ("e/zorblat-public", "none"), ("f/zorblat-public", "zorblat")]
    got, sup = found(spark, rows, compiled([C1], allow=allow))
    assert [(g[0], g[1], g[6]) for g in got] == [("b", "content", 20), ("c", "content", 2), ("f/zorblat-public", "content", 1)]
    assert sup == [("a", "content", "e-1", "al-1"), ("d", "content", "e-1", "al-2"), ("e/zorblat-public", "path", "e-1", "al-1")]


def test_a_suppressed_entity_fires_no_rule(spark):
    rules = [{"rule_id": "r-1", "terms": ["e-1", "e-2"], "window_kind": "file"}]
    got, sup = found(spark, [("x", "zorblat-public ILT")], compiled([C1, C2], rules, [literal("al-1", "zorblat-public")]))
    assert [g[2] for g in got] == ["e-2"] and sup == [("x", "content", "e-1", "al-1")]


def test_overlapping_occurrences_are_all_looked_at():
    from hushgrid.sources.catalog import Literal

    assert list(Text("aaaa", ()).places(Literal("aa", False, False))) == [(0, 2), (1, 3), (2, 4)]


def test_folding_keeps_places():
    assert fold("İx") == "İx".replace("İ", "İ")[:1] + "x" or len(fold("İx")) == 2


def test_both_plans_agree(spark, sf_dir):
    from hushgrid.plans.queries import PLAIN
    from hushgrid.sources import tables

    u = tables.documents(spark, sf_dir)
    a, b = detect(u, PLAIN)[0], detect_native(u, PLAIN)
    assert a.count() > 200 and a.exceptAll(b).count() == 0 == b.exceptAll(a).count()


def test_no_shuffle_in_detection(spark):
    c = compiled([C1, C2])
    for df in (detect(units(spark, [("x", "y")]), c)[0], detect_native(units(spark, [("x", "y")]), c)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()

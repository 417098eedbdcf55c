import re

import pytest
from pyspark.sql import functions as F

from hushgrid.functions import text as T
from hushgrid.functions.dialect import PatternError, translate
from hushgrid.functions.globs import name_glob, path_glob
from hushgrid.sources import ignore
from hushgrid.sources.catalog import expand

CASES = [(r"\bacme", "éacme", True), (r"(?i)é", "É", True), (r"a\s", "a\x0b", False), (r"a$", "a\n", False), (r"a.b", "a\rb", True), (r"\d", "٣", False), (r"(?i)ACME-[0-9]+", "acme-12", True), (r"[[:alpha:]]+\.x", "ab.x", True), (r"(?P<n>a)b", "ab", True), (r"[^\s]x", "ax", True), (r"\Qa.b\E", "axb", False), (r"\x{41}", "A", True), (r"(?m)^b$", "a\nb\nc", True)]


@pytest.mark.parametrize(("pattern", "text", "want"), CASES)
def test_patterns_mean_in_both_dialects_what_they_mean_in_re2(spark, pattern, text, want):
    assert bool(re.search(translate(pattern, "python"), text)) == want
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.col("t").rlike(translate(pattern))).collect()[0][0] == want


@pytest.mark.parametrize("pattern", [r"(?=a)", r"(?<!a)b", r"(a)\1", r"a*+", r"(?>a)", r"(?U)a+", "a\\", r"(?<=a)"])
def test_what_re2_refuses_is_refused(pattern):
    with pytest.raises(PatternError):
        translate(pattern)


@pytest.mark.parametrize(("glob", "path", "want"), [("*.go", "a.go", True), ("*.go", "a/b.go", False), ("**/x", "a/b/x", True), ("**/x", "x", True), ("a/**", "a/b/c", True), ("a/**", "ab", False), ("a?c", "abc", True), ("[!a]b", "cb", True), ("{a,b}.x", "b.x", True), ("a.b", "axb", False)])
def test_path_globs(glob, path, want):
    assert bool(re.match(path_glob(glob), path)) == want


def test_name_globs_cross_slashes():
    assert re.match(name_glob("backup/*"), "backup/a/b") and re.match(name_glob("*-snapshot-*"), "v1/x-snapshot-2") and not re.match(name_glob("*-bak"), "x-bak2")


@pytest.mark.parametrize(("path", "is_dir", "want"), [("build", True, True), ("build", False, False), ("build/x.txt", False, True), ("a/x.log", False, True), ("keep.log", False, False), ("a/keep.log", False, False), ("top", False, True), ("a/top", False, False), ("docs/a/b", False, True), ("src/x", False, False)])
def test_the_last_rule_decides(spark, path, is_dir, want):
    rules = ignore.parse("# c\n\nbuild/\n*.log\n!keep.log\n/top\ndocs/**\n")
    assert ignore.ignored(rules, path, is_dir) == want
    if not is_dir:
        assert spark.createDataFrame([(path,)], "p string").select(ignore.ignored_column(rules, F.col("p"))).collect()[0][0] == want


def test_folders_that_may_hold_what_is_taken_back():
    assert ignore.may_reinclude(ignore.parse("a/\n!a/b/c"), "a") and not ignore.may_reinclude(ignore.parse("a/\n!b/c"), "a") and ignore.may_reinclude(ignore.parse("!x"), "a")


def test_aliases_expand_alike_in_both_forms(spark):
    for alias in ("Acme Corp", "Æon--X!", "a", " x_y "):
        got = spark.createDataFrame([(alias,)], "a string").select(T.variants(F.col("a"), True, True)).collect()[0][0]
        assert got == expand(alias, {"slug": True, "pluralize": True})


def test_line_and_column(spark):
    df = spark.createDataFrame([("ab\ncd acme\n", 7), ("acme", 1), ("\n\nx", 3)], "t string, p int")
    assert [tuple(r) for r in df.select(T.line_of(F.col("t"), F.col("p")), T.column_of(F.col("t"), F.col("p"))).collect()] == [(2, 4), (1, 1), (3, 1)]

"""Column functions that detection and its report are made of; all native."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushgrid.functions.enums import SEVERITY_RANK

LETTER = r"\p{L}\p{Nd}_"
FINGERPRINT = ("entity_id", "rule_id", "detector_id", "source_kind", "surface", "surface_kind", "git_ref")


def fold(text: Column) -> Column:
    """Lower case, one character for one: dotted capital I is set apart, which would become two."""
    return F.lower(F.translate(text, "İ", "i"))


def literal_at(text: Column, literal: str, ignore_case: bool = False, whole_word: bool = False) -> Column:
    """1-based place of the first occurrence of a literal, 0 if there is none."""
    own = fold(text) if ignore_case else text
    if whole_word:
        return F.regexp_instr(own, F.lit(f"(?<![{LETTER}]){java_quote(literal)}(?![{LETTER}])"))
    return F.instr(own, literal)


def java_quote(literal: str) -> str:
    return re.sub(r"([^\w\s]|_)", r"\\\1", literal, flags=re.ASCII)


def line_of(text: Column, place: Column) -> Column:
    before = F.substring(text, F.lit(1), place - 1)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("long")


def column_of(text: Column, place: Column) -> Column:
    before = F.substring(text, F.lit(1), place - 1)
    return (F.length(F.substring_index(before, "\n", -1)) + 1).cast("long")


def fingerprint(path: str = "path", line: str = "line", col: str = "col", **given: Column) -> Column:
    """16 hex digits over where and by what a finding was made."""
    fields = [F.coalesce(given.get(c, F.col(c)), F.lit("")) for c in FINGERPRINT]
    place = F.concat(F.coalesce(F.col(path), F.lit("")), F.lit(":"), F.col(line).cast("string"), F.lit(":"), F.col(col).cast("string"))
    return F.substring(F.sha2(F.concat_ws("\0", *fields, place), 256), 1, 16)


def severity_rank(severity: Column) -> Column:
    out = F.lit(0)
    for name, n in SEVERITY_RANK.items():
        out = F.when(severity == name, F.lit(n)).otherwise(out)
    return out


def decision(severity: Column, threshold: str) -> Column:
    return F.when(severity_rank(severity) >= SEVERITY_RANK[threshold], F.lit("block")).otherwise("warn")


def slug(text: Column, separator: str = "-") -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]+", separator), F.lit(separator))


def variants(text: Column, slugs: bool = True, plural: bool = False) -> Column:
    """All forms of an alias, sorted, without repeats."""
    own = F.trim(text)
    s = slug(own)
    forms = [own] + [s, F.replace(s, F.lit("-"), F.lit("_")), F.replace(s, F.lit("-"), F.lit(""))] * slugs + [F.concat(own, F.lit("s"))] * plural
    return F.array_sort(F.array_distinct(F.filter(F.array(*forms), lambda v: v != "")))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, r"[/\\]"), lambda s: s != "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))


def first_matching(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """The name of the first (name, regular expression) that matches, else null."""
    return F.coalesce(*[F.when(text.rlike(rx), F.lit(name)) for name, rx in patterns]) if patterns else F.lit(None).cast("string")


def surface_of(source_kind: Column) -> Column:
    return F.when(source_kind == "branch_name", "branch_name").when(source_kind.isin("commit_message", "git_commit_message"), "commit_message").when(source_kind == "git_diff", "diff").otherwise("content")


def surface_kind_of(source_kind: Column, stage: Column) -> Column:
    return (
        F.when(source_kind == "branch_name", "branch_name").when(source_kind.isin("commit_message", "git_commit_message"), "commit_message").when(source_kind == "git_diff", "diff").when(source_kind == "git_history_blob", "blob").when((source_kind == "file") & (stage == "index"), "staged_index").when(source_kind == "file", "working_tree").otherwise(source_kind)
    )


def opaque_id(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, 12))

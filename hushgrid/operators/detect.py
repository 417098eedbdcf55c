"""Detection: which entities a unit shows, where first, and what the allowlist takes away.

Two plans with one result. ``detect`` sends texts through an Arrow function. There one automaton (RE2's, over whole
columns) that knows all literals and patterns of the catalog passes over all texts; only those in which something
occurs are looked at entity by entity: literals in order, then patterns, up to the first match that
no allowlist span covers, and then rules over what the unit shows. ``detect_native``
is made of Spark expressions alone and serves catalogs of some hundred entities, without an allowlist or rules. Neither shuffles: a unit's
matches are found in its own row.

Defined cases: null content has no matches; a null path has no segments; the first literal of the
list that occurs wins, not the leftmost; tied entities are all reported.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushgrid.functions import text as T
from hushgrid.functions.dialect import engine
from hushgrid.functions.enums import CO_MESSAGE, MESSAGE
from hushgrid.sources.catalog import AllowRule, Compiled, EntityRule, Literal, Pattern

PATH_KINDS = ("file", "git_history_blob")
NAMELESS_KINDS = ("branch_name", "commit_message", "git_commit_message")
SEGMENT = re.compile(r"[/\\]+")
FINDING = ("fingerprint", "severity", "confidence", "decision", "entity_id", "entity_class", "detector_id", "rule_id", "source_kind", "surface", "surface_kind", "path", "source_id", "git_ref", "line", "col", "replacement_id", "evidence_shape", "message")
UNIT = ("unit_id", "source_id", "source_kind", "content", "line_base", "git_ref", "stage", "suppress_path", "blob")
UNIT_TYPES = dict(zip(UNIT, ("bigint", "string", "string", "string", "int", "string", "string", "boolean", "string"), strict=True))


def word_at(text: str, start: int, end: int) -> bool:
    """No letter, digit or underscore on either side."""
    return not (start > 0 and _wordy(text[start - 1]) or end < len(text) and _wordy(text[end]))


def _wordy(c: str) -> bool:
    return c == "_" or unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd"


def fold(text: str) -> str:
    """Lower case of the same length, so that places hold."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


class Text:
    """A text with its folded form and its allowlist spans, both made when first asked for."""

    def __init__(self, text: str, allow: tuple[AllowRule, ...]):
        self.text, self.allow = text, allow
        self._folded: str | None = None
        self._spans: list[tuple[int, int, str]] | None = None

    def body(self, ignore_case: bool) -> str:
        if not ignore_case:
            return self.text
        if self._folded is None:
            self._folded = fold(self.text)
        return self._folded

    def places(self, lit: Literal) -> Iterator[tuple[int, int]]:
        """All occurrences, overlapping ones included."""
        body = self.body(lit.ignore_case)
        at = body.find(lit.match)
        while at >= 0:
            end = at + len(lit.match)
            if not lit.whole_word or word_at(body, at, end):
                yield at, end
            at = body.find(lit.match, at + 1)

    def spans(self) -> list[tuple[int, int, str]]:
        if self._spans is None:
            self._spans = []
            for a in self.allow:
                self._spans += [(s, e, a.id) for lit in a.literals for s, e in self.places(lit)]
                for p in a.patterns:
                    found = (m.span() for m in engine.finditer(p.python, self.text))
                    self._spans += [(s, e, a.id) for s, e in found if not p.whole_word or word_at(self.text, s, e)]
        return self._spans

    def covered(self, start: int, end: int) -> str | None:
        return next((i for s, e, i in self.spans() if s <= start and end <= e), None)

    def first_open(self, places: Iterator[tuple[int, int]]) -> tuple[int, str | None]:
        """The first place that no span covers (-1 if none), and what covered the first covered one."""
        cover = None
        for s, e in places:
            by = self.covered(s, e)
            if by is None:
                return s, cover
            cover = cover or by
        return -1, cover


def in_content(text: Text, rule: EntityRule) -> tuple[int, str, str | None]:
    """(place or -1, literal or regex, covering entry) of an entity in a text."""
    cover = None
    for lit in rule.literals:
        at, by = text.first_open(text.places(lit))
        if at >= 0:
            return at, "literal", None
        cover = cover or by
    for p in rule.patterns:
        at, by = text.first_open(m.span() for m in engine.finditer(p.python, text.text))
        if at >= 0:
            return at, "regex", None
        cover = cover or by
    return -1, "", cover


def in_path(parts: list[Text], rule: EntityRule) -> tuple[bool, str | None]:
    cover = None
    for lit in rule.literals:
        for part in parts:
            at, by = part.first_open(part.places(lit))
            if at >= 0:
                return True, None
            cover = cover or by
    return False, cover


def scan_unit(path: str | None, content: str | None, compiled: Compiled) -> list[tuple]:
    """(entity, surface, shape, line, column, covering entry, rule): matches, for entities without one what covered them, and the rules of which every term matched, each at its first term's first match."""
    out = []
    body = Text(content or "", compiled.allow)
    parts = [Text(s, compiled.allow) for s in SEGMENT.split(path) if s] if path else []
    covers: dict[str, tuple] = {}
    seen: dict[str, tuple] = {}
    for rule in compiled.entities:
        found, by = in_path(parts, rule)
        if found:
            out.append((rule, "path", "path_segment", 0, 0, None, None))
            seen.setdefault(rule.id, out[-1])
        elif by:
            covers.setdefault(rule.id, (rule, "path", "", 0, 0, by, None))
    late: dict[str, tuple] = {}
    for rule in compiled.entities:
        at, shape, by = in_content(body, rule)
        if at >= 0:
            line = body.text.count("\n", 0, at) + 1
            out.append((rule, "content", shape, line, at - body.text.rfind("\n", 0, at), None, None))
            seen.setdefault(rule.id, out[-1])
        elif by:
            late.setdefault(rule.id, (rule, "content", "", 0, 0, by, None))
    fired = [(*seen[r.terms[0]][:6], r) for r in compiled.rules if all(t in seen for t in r.terms)]
    return out + [x for i, x in {**late, **covers}.items() if i not in seen] + fired


TEXT, LONG = pa.string(), pa.int64()
MATCH = {"entity_id": TEXT, "entity_class": TEXT, "entity_severity": TEXT, "replacement_id": TEXT, "surface": TEXT, "shape": TEXT, "line": LONG, "col": LONG, "allow_id": TEXT, "rule_id": TEXT, "rule_severity": TEXT}
MATCH_TYPE = "array<struct<" + ",".join(f"{c}:{'bigint' if t == LONG else 'string'}" for c, t in MATCH.items()) + ">>"
#: Literals and patterns that one automaton knows, at most.
TOGETHER = 200


@cache
def _cases() -> dict[str, str]:
    """For each small letter all that folding makes it of."""
    out: dict[str, str] = {"ς": "Σ"}
    for c in map(chr, range(0x110000)):
        low = c.lower()
        if low != c and len(low) == 1:
            out[low] = out.get(low, "") + c
    return out


def _escaped(c: str) -> str:
    return f"\\x{{{ord(c):x}}}" if not c.isalnum() or not c.isascii() else c


def _sieve_of(lit: Literal) -> str:
    return "".join(f"[{_escaped(c)}{''.join(map(_escaped, _cases()[c]))}]" if lit.ignore_case and c in _cases() else _escaped(c) for c in lit.match)


def sieve(compiled: Compiled) -> list[str] | None:
    """Expressions of RE2, one of which matches wherever an entity could have a match; None if there are none that RE2 takes."""
    parts = list(dict.fromkeys(x for e in compiled.entities for x in [*(_sieve_of(t) for t in e.literals if t.match), *(f"(?:{q.source})" for q in e.patterns)]))
    out = ["|".join(parts[i : i + TOGETHER]) for i in range(0, len(parts), TOGETHER)]
    try:
        for rx in out:
            pc.match_substring_regex(pa.array([""]), rx)
    except pa.ArrowInvalid:
        return None
    return out


def matches(compiled: Compiled, path: Column, content: Column, spark) -> Column:
    """For each row an array of matches, covers and rules (see scan_unit). The catalog is broadcast: operators write it by hand, it does not grow with the units."""
    held = spark.sparkContext.broadcast((compiled, sieve(compiled)))

    @F.arrow_udf(MATCH_TYPE)
    def scan(paths: pa.Array, contents: pa.Array) -> pa.Array:
        own, sieves = held.value
        if sieves is None:
            at = range(len(contents))
        else:
            hit = pa.array([False] * len(contents))
            for rx in sieves:
                for column in (contents, paths):
                    hit = pc.or_(hit, pc.fill_null(pc.match_substring_regex(column, rx), False))
            at = pc.indices_nonzero(hit).to_pylist()
        counts, rows = [0] * (len(contents) + 1), []
        for i in at:
            got = scan_unit(paths[i].as_py(), contents[i].as_py(), own)
            counts[i + 1] = len(got)
            rows += [(e.id, e.klass, e.severity, e.replacement, surface, shape, line, col, by, r and r.id, r and r.severity) for e, surface, shape, line, col, by, r in got]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(MATCH), MATCH.values(), strict=True)]
        return pa.ListArray.from_arrays(pa.array(list(accumulate(counts)), pa.int32()), pa.StructArray.from_arrays(columns, names=list(MATCH)))

    return scan(path, content)


def as_units(units: DataFrame) -> DataFrame:
    """units with all columns that detection reads; missing ones are null."""
    return units.withColumns({c: F.lit(None).cast(t) for c, t in UNIT_TYPES.items() if c not in units.columns})


def _path_of() -> Column:
    seen = F.col("source_kind").isin(*PATH_KINDS) & ~F.coalesce(F.col("suppress_path"), F.lit(False))
    return F.when(seen, F.col("source_id"))


def found_rows(units: DataFrame, compiled: Compiled) -> DataFrame:
    """One row a match or cover. Texts stay behind: rows are narrow from here on."""
    units = as_units(units)
    scanned = units.withColumn("_m", F.explode(matches(compiled, _path_of(), F.col("content"), units.sparkSession)))
    return scanned.select(*[c for c in units.columns if c != "content"], "_m.*")


def _finding(rows: DataFrame, threshold: str) -> DataFrame:
    kind = F.col("source_kind")
    base = F.coalesce(F.col("line_base"), F.lit(0))
    ruled = F.col("rule_id").isNotNull()
    made = rows.withColumns({
        "severity": F.coalesce("rule_severity", "entity_severity"), "confidence": F.lit("high"), "decision": T.decision(F.col("entity_severity"), threshold),
        "detector_id": F.when(ruled, "co-occurrence").when(F.col("shape") == "path_segment", "path-segment").otherwise(F.col("shape")), "rule_id": F.coalesce("rule_id", F.lit("")),
        "surface": F.when(F.col("surface") == "path", "path").otherwise(T.surface_of(kind)), "surface_kind": T.surface_kind_of(kind, F.col("stage")),
        "path": F.when(kind.isin(*NAMELESS_KINDS), "").otherwise(F.col("source_id")), "git_ref": F.coalesce("git_ref", F.lit("")),
        "line": F.when(base > 0, base + F.col("line") - 1).otherwise(F.col("line")).cast("long"), "evidence_shape": F.when(ruled, "co_occurrence").otherwise(F.col("shape")), "message": F.when(ruled, CO_MESSAGE).otherwise(MESSAGE),
    })
    return made.withColumn("fingerprint", T.fingerprint())


def split(rows: DataFrame, compiled: Compiled, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(findings, suppressions) of found rows."""
    threshold = compiled.threshold
    hits = _finding(rows.where("allow_id is null"), threshold)
    covers = rows.where("allow_id is not null")
    suppressions = covers.select("unit_id", F.col("allow_id").alias("allowlist_id"), "entity_id", F.when(F.col("surface") == "path", "path").otherwise(T.surface_of(F.col("source_kind"))).alias("surface"), "source_kind", F.when(F.col("source_kind").isin(*NAMELESS_KINDS), "").otherwise(F.col("source_id")).alias("path"), "source_id", F.coalesce("git_ref", F.lit("")).alias("git_ref"), *keep)
    return hits.select("unit_id", *FINDING, *keep), suppressions


def detect(units: DataFrame, compiled: Compiled, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(findings, suppressions). keep names columns of units to carry along, such as blob."""
    return split(found_rows(units, compiled), compiled, keep)


def detect_native(units: DataFrame, compiled: Compiled) -> DataFrame:
    """Findings by Spark expressions alone; for catalogs without an allowlist. The content is folded once."""
    if not compiled.entities:
        return detect(units, compiled)[0]
    if compiled.allow:
        raise ValueError("an allowlist asks for detect()")
    units = as_units(units).withColumn("_fold", T.fold(F.col("content"))).withColumn("_segments", F.coalesce(T.segments(_path_of()), F.array().cast("array<string>")))
    # one column an entity and surface, each computed once in a projection of its own: twice the place, plus one for a pattern
    places, found = {}, []
    for n, e in enumerate(compiled.entities):
        tries = [F.nullif(_place(F.col("_fold") if x.ignore_case else F.col("content"), x), F.lit(0)) * 2 for x in e.literals]
        tries += [F.nullif(_pattern_place(F.col("content"), p), F.lit(0)) * 2 + 1 for p in e.patterns]
        places[f"_c{n}"] = F.coalesce(*tries) if tries else F.lit(None).cast("int")
        on_path = F.lit(False)
        for x in e.literals:
            on_path = on_path | F.exists("_segments", _segment_test(x))
        places[f"_p{n}"] = on_path
        at = F.col(f"_c{n}")
        found += [F.struct(F.lit(n).alias("n"), F.lit("path").alias("surface"), F.when(F.col(f"_p{n}"), F.lit(0)).alias("at"), F.lit("path_segment").alias("shape")), F.struct(F.lit(n).alias("n"), F.lit("content").alias("surface"), F.shiftright(at, 1).alias("at"), F.when(at % 2 == 1, "regex").otherwise("literal").alias("shape"))]
    units = units.withColumns(places)
    rows = units.withColumn("_m", F.explode(F.filter(F.array(*found), lambda m: m["at"].isNotNull())))
    place = F.col("_m.at")
    rows = rows.withColumns({"n": F.col("_m.n"), "surface": F.col("_m.surface"), "shape": F.col("_m.shape"), "line": F.when(place > 0, T.line_of(F.col("content"), place)).otherwise(F.lit(0).cast("long")), "col": F.when(place > 0, T.column_of(F.col("content"), place)).otherwise(F.lit(0).cast("long"))})
    known = F.array(*[F.struct(F.lit(e.id).alias("id"), F.lit(e.klass).alias("klass"), F.lit(e.severity).alias("severity"), F.lit(e.replacement).alias("replacement")) for e in compiled.entities])
    named = rows.drop("_m", "_fold", "_segments", *places).withColumn("_e", F.get(known, F.col("n")))
    none = F.lit(None).cast("string")
    named = named.withColumns({"entity_id": F.col("_e.id"), "entity_class": F.col("_e.klass"), "entity_severity": F.col("_e.severity"), "replacement_id": F.col("_e.replacement"), "rule_id": none, "rule_severity": none})
    return _finding(named, compiled.threshold).select("unit_id", *FINDING)


def _segment_test(lit: Literal) -> Callable[[Column], Column]:
    return lambda segment: _place(T.fold(segment) if lit.ignore_case else segment, lit) > 0


def required(pattern: str) -> list[str]:
    """Texts that every match of a pattern (in Python's form) holds."""
    try:
        tree = re._parser.parse(pattern)
    except (re.error, AttributeError):
        return []
    if tree.state.flags & re.IGNORECASE:
        return []
    runs = "".join(chr(arg) if str(op) == "LITERAL" else "\0" for op, arg in tree).split("\0")
    return [r for r in runs if r]


def _pattern_place(text: Column, p: Pattern) -> Column:
    found = F.regexp_instr(text, F.lit(p.java))
    for run in required(p.python):
        found = F.when(F.contains(text, F.lit(run)), found).otherwise(0)
    return found


def _place(text: Column, lit: Literal) -> Column:
    if lit.whole_word:
        # most texts don't have the word at all: a plain search tells that for much less
        return F.when(F.contains(text, F.lit(lit.match)), F.regexp_instr(text, F.lit(f"(?<![{T.LETTER}]){T.java_quote(lit.match)}(?![{T.LETTER}])"))).otherwise(0)
    return F.instr(text, lit.match)

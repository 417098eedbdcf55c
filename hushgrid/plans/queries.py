"""The library's own queries, by name, and their SQL for DuckDB.

All run over whole tables. Units are the documents, pages and conversations tables (see
sources/tables.py). The SQL of detection is generated from the compiled catalog, in RE2's own dialect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushgrid.functions import text as T
from hushgrid.functions.enums import BINARY_EXTENSIONS, BLOCKING_REASONS, DANGER_PATTERNS, SEVERITY_RANK
from hushgrid.functions.globs import name_glob
from hushgrid.operators import attribute, counts, coverage, diff, publish
from hushgrid.operators.detect import FINDING, Compiled, detect, detect_native
from hushgrid.operators.redact import redact
from hushgrid.plans import fixtures
from hushgrid.sources import ignore, tables
from hushgrid.sources.catalog import _check, compile_catalogs

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        Q[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


def entity(id: str, klass: str = "codename", **fields) -> dict:
    variants = {k: fields.pop(k) for k in ("case_insensitive", "slug", "pluralize", "whole_word") if k in fields}
    return {"id": id, "class": klass, **fields} | ({"variants": variants} if variants else {})


def compiled(entities: list[dict], rules: list[dict] = (), allow: list[dict] = (), visibility: str = "public_oss", threshold: str = "high", default: str = "medium") -> Compiled:
    doc = {"catalog_id": "own", "schema_version": "1.1.0", "default_severity": default, "entities": entities} | ({"co_occurrence_rules": list(rules)} if rules else {}) | ({"allowlist": list(allow)} if allow else {})
    return compile_catalogs([_check(doc)], visibility, threshold)


PATTERNS = {"mail": r"[a-z0-9._]+@[a-z0-9.]+\.com", "phone": r"[0-9]{3}[- .][0-9]{4}"}
ENTITIES = [
    entity("e-terms", "operational_pattern", aliases=["license"], case_insensitive=True, severity_override="critical", replacement_suggestion="r-1"),
    entity("e-owner", "client_identity", aliases=["apache", "MIT"], case_insensitive=True, severity_override="high", replacement_suggestion="r-2"),
    entity("e-secret", "account_label", tokens=["token"]),
    entity("e-mail", "person", regex_patterns=[PATTERNS["mail"]], severity_override="high"),
    entity("e-phone", "person", regex_patterns=[PATTERNS["phone"]], severity_override="low"),
    entity("e-origin", "system", aliases=["src7"], whole_word=True, allowed_in=["internal"], severity_override="info"),
]
RULES = [
    {"rule_id": "r-both", "terms": ["e-terms", "e-owner"], "window_kind": "file", "severity_override": "critical", "apply_in": ["public_oss"]},
    {"rule_id": "r-place", "terms": ["e-origin", "e-terms"], "window_kind": "file", "severity_override": "low"},
    {"rule_id": "r-inside", "terms": ["e-terms", "e-owner"], "window_kind": "file", "apply_in": ["internal"]},
]
MAIN = compiled(ENTITIES, RULES)
PLAIN = compiled(ENTITIES)

UNITS = "units AS (SELECT doc_id AS unit_id, source || '/' || lang || '/doc_' || doc_id || '.txt' AS source_id, text AS content, octet_length(encode(text)) AS n_bytes, source FROM documents)"
EDGE = r"[^\p{L}\p{Nd}_]"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(s: str) -> str:
    import re

    return re.sub(r"([^\w\s]|_)", r"\\\1", s, flags=re.ASCII)


def sql_place(text: str, lit) -> str:
    """1-based place of a literal in DuckDB, null if none."""
    t = f"lower({text})" if lit.ignore_case else text
    if not lit.whole_word:
        return f"nullif(strpos({t}, {quoted(lit.match)}), 0)"
    m = f"regexp_extract({t}, {quoted(f'(^|{EDGE}){rx(lit.match)}($|{EDGE})')})"
    return f"CASE WHEN {m} <> '' THEN strpos({t}, {m}) + CASE WHEN starts_with({m}, {quoted(lit.match)}) THEN 0 ELSE 1 END END"


def sql_found(c: Compiled, units: str = "units") -> str:
    """Rows (unit_id, n, entity_id, ..., surface, shape, at) of a catalog without an allowlist."""
    rows = []
    for n, e in enumerate(c.entities):
        what = f"{n} AS n, {quoted(e.id)} AS entity_id, {quoted(e.klass)} AS entity_class, {quoted(e.severity)} AS severity, {quoted(e.replacement)} AS replacement_id"
        lits = [sql_place("content", x) for x in e.literals]
        found = [f"nullif(strpos(content, regexp_extract(content, {quoted(p)})), CASE WHEN regexp_extract(content, {quoted(p)}) = '' THEN 1 ELSE 0 END)" for p in (x.source for x in e.patterns)]
        lit, pat = (f"coalesce({', '.join(x)}, NULL)" if x else "NULL" for x in (lits, found))
        rows.append(f"SELECT unit_id, source_id, content, {what}, 'content' AS surface, CASE WHEN {lit} IS NOT NULL THEN 'literal' ELSE 'regex' END AS shape, CAST(coalesce({lit}, {pat}) AS BIGINT) AS place FROM {units} WHERE coalesce({lit}, {pat}) IS NOT NULL")
        if lits:
            any_ = " OR ".join(f"len(list_filter(regexp_split_to_array(source_id, '[/\\\\]'), lambda s: {sql_place('s', x)} IS NOT NULL)) > 0" for x in e.literals)
            rows.append(f"SELECT unit_id, source_id, content, {what}, 'path', 'path_segment', 0 FROM {units} WHERE {any_}")
    return " UNION ALL ".join(rows)


def sql_findings(c: Compiled, threshold: str = "high", units: str = UNITS) -> str:
    """CTEs that end in findings with all columns."""
    ranks = " ".join(f"WHEN {quoted(s)} THEN {r}" for s, r in SEVERITY_RANK.items())
    pre = "substr(content, 1, place - 1)"
    mark = "substr(sha256(concat(entity_id, chr(0), rule_id, chr(0), detector_id, chr(0), 'file', chr(0), surface, chr(0), 'working_tree', chr(0), '', chr(0), source_id, ':', line, ':', col)), 1, 16)"
    out = f"""{units}, found AS ({sql_found(c)}),
base AS (SELECT unit_id, severity, CASE WHEN CASE severity {ranks} END >= {SEVERITY_RANK[threshold]} THEN 'block' ELSE 'warn' END AS decision, entity_id, entity_class, CASE WHEN shape = 'path_segment' THEN 'path-segment' ELSE shape END AS detector_id, '' AS rule_id, surface, source_id,
  CAST(CASE WHEN place > 0 THEN length({pre}) - length(replace({pre}, chr(10), '')) + 1 ELSE 0 END AS BIGINT) AS line, CAST(CASE WHEN place > 0 THEN length(list_last(string_split({pre}, chr(10)))) + 1 ELSE 0 END AS BIGINT) AS col, replacement_id, shape AS evidence_shape, 'Confidential context detected' AS message FROM found)"""
    both = "SELECT * FROM base"
    if c.rules:
        out += ", seen AS (SELECT * FROM base QUALIFY row_number() OVER (PARTITION BY unit_id, entity_id ORDER BY surface = 'path' DESC) = 1)"
        for i, r in enumerate(c.rules):
            terms = ", ".join(map(quoted, r.terms))
            out += f", fired{i} AS (SELECT unit_id FROM seen WHERE entity_id IN ({terms}) GROUP BY unit_id HAVING count(DISTINCT entity_id) = {len(set(r.terms))})"
            both += f" UNION ALL SELECT * REPLACE ({quoted(r.severity)} AS severity, 'co-occurrence' AS detector_id, {quoted(r.id)} AS rule_id, 'co_occurrence' AS evidence_shape, 'Confidential context co-occurrence rule fired' AS message) FROM seen SEMI JOIN fired{i} USING (unit_id) WHERE entity_id = {quoted(r.terms[0])}"
    return f"{out}, findings AS (SELECT *, {mark} AS fingerprint, 'high' AS confidence, 'file' AS source_kind, 'working_tree' AS surface_kind, source_id AS path, '' AS git_ref FROM ({both}))"


COLUMNS = ", ".join(["unit_id", *FINDING])


def findings_of(spark: SparkSession, sf_dir: str, c: Compiled = MAIN) -> DataFrame:
    return detect(tables.documents(spark, sf_dir), c)[0]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in the documents, counted by severity."""
    return counts.by(findings_of(spark, sf_dir), "severity")


# ---- units and skips


@query(f"WITH {UNITS} SELECT unit_id, source_id, 'file' AS source_kind, CAST(n_bytes AS BIGINT) AS n_bytes FROM units")
def src_units_documents(spark, d):
    return tables.documents(spark, d).select("unit_id", "source_id", "source_kind", "n_bytes")


@query("SELECT url AS source_id, 'file' AS source_kind, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes FROM pages")
def src_units_pages(spark, d):
    return tables.pages(spark, d).select("source_id", "source_kind", "n_bytes")


@query("SELECT conv_id || '-' || turn AS source_id, 'git_commit_message' AS source_kind, conv_id || '-' || turn AS git_ref, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM conversations")
def src_units_conversations(spark, d):
    return tables.conversations(spark, d).select("source_id", "source_kind", "git_ref", "n_bytes")


#: Documents as files of several kinds: the last digit of the id gives the ending.
ENDINGS = ("txt", "md", "png", "go", "JPG", "txt", "zip", "py", "txt", "pdf")
FILES = "files AS (SELECT doc_id, source || '/' || lang || '/doc_' || doc_id || '.' || " + "[" + ", ".join(map(quoted, ENDINGS)) + "][doc_id % 10 + 1] AS path, n_chars FROM documents)"
IGNORE = "src1/\n*.go\n!doc_*3.go\n/src2/en/**\nde/doc_1?.*\n"
CAP = 5000


def _files(spark, d):
    ending = F.get(F.array(*map(F.lit, ENDINGS)), (F.col("doc_id") % 10).cast("int"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), ending).alias("path"), "n_chars")


SQL_BINARY = "lower(regexp_extract(path, '(\\.[^./]*)$', 1)) IN (" + ", ".join(map(quoted, BINARY_EXTENSIONS)) + ")"
SQL_IGNORED = "CASE WHEN regexp_matches(path, '^de/doc_1[^/]\\.[^/]*(/.+)?$') THEN true WHEN regexp_matches(path, '^src2/en/.+$') THEN true WHEN regexp_matches(path, '^(.*/)?doc_[^/]*3\\.go(/.+)?$') THEN false WHEN regexp_matches(path, '^(.*/)?[^/]*\\.go(/.+)?$') THEN true WHEN regexp_matches(path, '^(.*/)?src1/.+$') THEN true ELSE false END"
SQL_REASON = f"CASE WHEN {SQL_IGNORED} THEN 'ignored' WHEN {SQL_BINARY} THEN 'binary_detected' WHEN n_chars > {CAP} THEN 'file_too_large' END"


def _reason():
    return F.when(ignore.ignored_column(ignore.parse(IGNORE), F.col("path")), "ignored").when(T.extension(F.col("path")).isin(*BINARY_EXTENSIONS), "binary_detected").when(F.col("n_chars") > CAP, "file_too_large")


@query(f"WITH {FILES} SELECT doc_id, path FROM files WHERE {SQL_BINARY}")
def skip_binary_ext(spark, d):
    return _files(spark, d).where(T.extension(F.col("path")).isin(*BINARY_EXTENSIONS)).select("doc_id", "path")


@query(f"WITH {FILES} SELECT doc_id, n_chars FROM files WHERE n_chars > {CAP}")
def skip_size_cap(spark, d):
    return _files(spark, d).where(F.col("n_chars") > CAP).select("doc_id", "n_chars")


@query(f"WITH {FILES} SELECT doc_id, path, {SQL_IGNORED} AS ignored FROM files")
def skip_ignore_rules(spark, d):
    return _files(spark, d).select("doc_id", "path", ignore.ignored_column(ignore.parse(IGNORE), F.col("path")).alias("ignored"))


def _skips(spark, d):
    none = F.lit(None).cast("string")
    rows = _files(spark, d).withColumn("reason", _reason()).where("reason is not null")
    return rows.select(F.col("path").alias("source_id"), "reason", F.lit(False).alias("is_dir"), F.lit(0).cast("long").alias("represented"), none.alias("gap"), F.lit(False).alias("coverage_excluded"), F.lit(False).alias("legacy_excluded"), none.alias("blob"))


@query(f"WITH {FILES} SELECT {SQL_REASON} AS reason, count(*) AS files, CAST(0 AS BIGINT) AS folders FROM files WHERE {SQL_REASON} IS NOT NULL GROUP BY 1")
def skip_reason_counts(spark, d):
    return coverage.file_counts(_skips(spark, d))


ALLOWED = {"binary_detected": 1_000_000, "file_too_large": 10}


@query(f"WITH {FILES}, n AS (SELECT {SQL_REASON} AS reason, count(*) AS actual FROM files WHERE {SQL_REASON} IS NOT NULL GROUP BY 1), l AS (SELECT reason, actual, reason <> 'ignored' AS blocking, CASE WHEN reason = 'ignored' THEN 0 ELSE greatest(actual - CASE reason WHEN 'binary_detected' THEN 1000000 WHEN 'file_too_large' THEN 10 ELSE 0 END, 0) END AS left_over FROM n) SELECT reason, actual, blocking, CAST(left_over AS BIGINT) AS left_over, CASE WHEN (SELECT sum(left_over) FROM l) > 0 THEN 'incomplete' WHEN (SELECT bool_or(blocking) FROM l) THEN 'acknowledged' ELSE 'complete' END AS status FROM l")
def coverage_summary(spark, d):
    s = coverage.summarize(_skips(spark, d), allowances=ALLOWED)
    coverage.validate(s)
    rows = [(r, n, r in BLOCKING_REASONS, s["unacknowledged_skips_by_reason"].get(r, 0), s["status"]) for r, n in s["skips_by_reason"].items()]
    return spark.createDataFrame(rows, "reason string, actual long, blocking boolean, left_over long, status string")


# ---- single matchers over the documents


def _places(spark, d, c):
    return findings_of(spark, d, c).where("surface = 'content'").select("unit_id", "entity_id", "line", "col")


def _places_sql(c):
    return f"WITH {sql_findings(c)} SELECT unit_id, entity_id, line, col FROM findings WHERE surface = 'content'"


for _name, _entities in {
    "lit_substring_cs": [entity("e-1", aliases=["Apache"])],
    "lit_substring_ci": [entity("e-1", aliases=["LICENSE"], case_insensitive=True)],
    "lit_whole_word": [entity("e-1", aliases=["oner"], whole_word=True), entity("e-2", aliases=["version"], whole_word=True, case_insensitive=True)],
    "lit_short_alias_default": [entity("e-1", aliases=["MIT"]), entity("e-2", aliases=["the"], case_insensitive=True), entity("e-3", aliases=["in"], whole_word=False)],
    "lit_token_exact": [entity("e-1", tokens=["token", "Licensed"])],
    "lit_first_match_precedence": [entity("e-1", aliases=["Version", "License", "Apache"]), entity("e-2", aliases=["under"], regex_patterns=[PATTERNS["mail"]])],
    "line_column": [entity("e-1", aliases=["the"], case_insensitive=True), entity("e-2", aliases=["que"])],
}.items():
    _c = compiled(_entities)
    Q[_name] = lambda spark, d, c=_c: _places(spark, d, c)
    SQL[_name] = _places_sql(_c)

RX = compiled([ENTITIES[3], ENTITIES[4]])


@query(_places_sql(RX))
def rx_first_match(spark, d):
    return _places(spark, d, RX)


@query(f"SELECT doc_id, regexp_extract(text, {quoted(PATTERNS['mail'])}) AS found FROM documents WHERE regexp_matches(text, {quoted(PATTERNS['mail'])})")
def rx_email(spark, d):
    return _first(spark, d, "mail")


@query(f"SELECT doc_id, regexp_extract(text, {quoted(PATTERNS['phone'])}) AS found FROM documents WHERE regexp_matches(text, {quoted(PATTERNS['phone'])})")
def rx_phone(spark, d):
    return _first(spark, d, "phone")


def _first(spark, d, name):
    from hushgrid.functions.dialect import translate

    p = translate(PATTERNS[name])
    return spark.read.parquet(f"{d}/documents.parquet").where(F.col("text").rlike(p)).select("doc_id", F.regexp_extract("text", p, 0).alias("found"))


# ---- whole findings


@query(f"WITH {sql_findings(MAIN)} SELECT {COLUMNS} FROM findings")
def findings(spark, d):
    return findings_of(spark, d)


@query(f"WITH {sql_findings(PLAIN)} SELECT {COLUMNS} FROM findings")
def findings_native(spark, d):
    return detect_native(tables.documents(spark, d), PLAIN)


@query(f"WITH {sql_findings(PLAIN)} SELECT unit_id, entity_id, surface, fingerprint FROM findings")
def fingerprint(spark, d):
    return findings_of(spark, d, PLAIN).select("unit_id", "entity_id", "surface", "fingerprint")


@query("SELECT p_partkey, CAST(list_sort(list_distinct([p_name, s, replace(s, '-', '_'), replace(s, '-', '')])) AS VARCHAR[])::VARCHAR AS forms FROM (SELECT p_partkey, p_name, trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{Nd}]+', '-', 'g'), '-') AS s FROM part)")
def alias_expand_slug(spark, d):
    return _forms(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", T.variants(F.col("p_name")).alias("forms")))


@query("SELECT p_partkey, CAST(list_sort([p_name, p_name || 's']) AS VARCHAR[])::VARCHAR AS forms FROM part")
def alias_expand_plural(spark, d):
    return _forms(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", T.variants(F.col("p_name"), False, True).alias("forms")))


def _forms(df):
    return df.withColumn("forms", F.concat(F.lit("["), F.array_join("forms", ", "), F.lit("]")))


@query("SELECT url, CAST(len(s) AS BIGINT) AS n, array_to_string(s, '|') AS segments FROM (SELECT url, list_filter(regexp_split_to_array(url, '[/\\\\]'), lambda x: x <> '') AS s FROM pages)")
def path_segments(spark, d):
    return tables.pages(spark, d).select(F.col("source_id").alias("url"), F.size(T.segments(F.col("source_id"))).cast("long").alias("n"), F.array_join(T.segments(F.col("source_id")), "|").alias("segments"))


PATHS = compiled([entity("e-1", aliases=["fr"]), entity("e-2", aliases=["EXAMPLE"], case_insensitive=True), entity("e-3", aliases=["page"])])
PAGE_UNITS = "units AS (SELECT url AS unit_id, url AS source_id, '' AS content FROM pages)"


@query(f"WITH {PAGE_UNITS}, found AS ({sql_found(PATHS)}) SELECT source_id, entity_id FROM found WHERE surface = 'path'")
def path_segment_match(spark, d):
    return detect(tables.pages(spark, d), PATHS)[0].where("surface = 'path'").select("source_id", "entity_id")


INSIDE = compiled(ENTITIES, RULES, visibility="internal")


@query(f"WITH {sql_findings(INSIDE)} SELECT {COLUMNS} FROM findings")
def visibility_filter(spark, d):
    return findings_of(spark, d, INSIDE)


LOW = compiled(ENTITIES, RULES, threshold="medium")


@query(f"WITH {sql_findings(LOW, 'medium')} SELECT severity, decision, count(*) AS n FROM findings GROUP BY ALL")
def severity_decision(spark, d):
    return findings_of(spark, d, LOW).groupBy("severity", "decision").agg(F.count("*").alias("n"))


@query(f"WITH {sql_findings(MAIN)} SELECT unit_id, bool_or(decision = 'block') AS blocked FROM findings GROUP BY unit_id")
def block_gate(spark, d):
    return findings_of(spark, d).groupBy("unit_id").agg(F.bool_or(F.col("decision") == "block").alias("blocked"))


# ---- the allowlist

WORDS = [entity("e-terms", aliases=["license"], case_insensitive=True), entity("e-owner", aliases=["apache"], case_insensitive=True), entity("e-time", aliases=["version"], case_insensitive=True)]
COVER = [{"id": "al-1", "kind": "literal", "pattern": "Apache License", "variants": {"case_insensitive": True}}]
PART = [{"id": "al-1", "kind": "literal", "pattern": "License, V"}]
AFTER = [{"id": "al-1", "kind": "literal", "pattern": "Licensed"}, {"id": "al-2", "kind": "regex", "pattern": "MIT [A-Z][a-z]+"}]


def sql_allow(spans: str, words: tuple[str, ...] = ("license", "apache", "version")) -> str:
    """CTEs that end in places (all, with covered) and firsts of literals in any case."""
    rows = " UNION ALL ".join(f"SELECT doc_id, {i} AS n, {quoted(w)} AS word, unnest(list_filter(range(1, length(text) + 1), lambda p: substr(low, CAST(p AS BIGINT), {len(w)}) = {quoted(w)})) AS s, {len(w)} AS k FROM d WHERE contains(low, {quoted(w)})" for i, w in enumerate(words))
    return f"d AS (SELECT doc_id, text, lower(text) AS low FROM documents WHERE regexp_matches(lower(text), '{'|'.join(words)}')), places AS ({rows}), spans AS ({spans}), judged AS (SELECT p.*, (SELECT min(a.id) FROM spans a WHERE a.doc_id = p.doc_id AND a.s <= p.s AND p.s + p.k <= a.e) AS cover FROM places p)"


def _span(literal: str, id: str, fold: bool) -> str:
    t = "low" if fold else "text"
    return f"SELECT doc_id, {quoted(id)} AS id, unnest(list_filter(range(1, length(text) + 1), lambda p: substr({t}, CAST(p AS BIGINT), {len(literal)}) = {quoted(literal)})) AS s, s + {len(literal)} AS e FROM d WHERE contains({t}, {quoted(literal)})"


NAMES = "['e-terms', 'e-owner', 'e-time'][n + 1]"
FIRST_OPEN = f"SELECT doc_id AS unit_id, {NAMES} AS entity_id, CAST(length(substr(text, 1, s - 1)) - length(replace(substr(text, 1, s - 1), chr(10), '')) + 1 AS BIGINT) AS line, CAST(length(list_last(string_split(substr(text, 1, s - 1), chr(10)))) + 1 AS BIGINT) AS col FROM (SELECT doc_id, n, min(s) AS s FROM judged WHERE cover IS NULL GROUP BY ALL) JOIN d USING (doc_id)"


def _allow_query(name, allow, spans, words=("license", "apache", "version")):
    c = compiled(WORDS[: len(words)], allow=allow)
    Q[name] = lambda spark, d: _places(spark, d, c)
    SQL[name] = f"WITH {sql_allow(spans, words)} {FIRST_OPEN}"


_allow_query("allow_literal_cover", COVER, _span("apache license", "al-1", True))
_allow_query("allow_partial_overlap", PART, _span("License, V", "al-1", False))
_SPANS = _span("Licensed", "al-1", False) + " UNION ALL SELECT doc_id, 'al-2' AS id, strpos(text, m) AS s, s + length(m) AS e FROM (SELECT doc_id, text, unnest(list_distinct(regexp_extract_all(text, 'MIT [A-Z][a-z]+'))) AS m FROM d)"
_allow_query("allow_subtract_then_match", AFTER, _SPANS, ("license", "apache"))
COVERED = compiled(WORDS, allow=COVER + AFTER[1:])
_COVERED = f"WITH {sql_allow(_span('apache license', 'al-1', True) + ' UNION ALL ' + _SPANS.split(' UNION ALL ')[1])}"


@query(f"{_COVERED} SELECT unit_id, entity_id, allowlist_id FROM (SELECT doc_id AS unit_id, {NAMES} AS entity_id, min_by(cover, s) AS allowlist_id, bool_and(cover IS NOT NULL) AS every FROM judged GROUP BY ALL) WHERE every")
def suppression_accounting(spark, d):
    return detect(tables.documents(spark, d), COVERED)[1].select("unit_id", "entity_id", "allowlist_id")


@query(f"WITH s AS ({_COVERED} SELECT allowlist_id FROM (SELECT doc_id, n, min_by(cover, s) AS allowlist_id, bool_and(cover IS NOT NULL) AS every FROM judged GROUP BY ALL) WHERE every) SELECT allowlist_id, count(*) AS n FROM s GROUP BY ROLLUP (allowlist_id)")
def suppressions_by_entry(spark, d):
    return detect(tables.documents(spark, d), COVERED)[1].rollup("allowlist_id").agg(F.count("*").alias("n"))


# ---- co-occurrence


@query(f"WITH {sql_findings(MAIN)} SELECT unit_id, rule_id, severity FROM findings WHERE detector_id = 'co-occurrence'")
def cooccur_division(spark, d):
    return findings_of(spark, d).where("detector_id = 'co-occurrence'").select("unit_id", "rule_id", "severity")


@query(f"WITH {sql_findings(MAIN)} SELECT unit_id, rule_id, entity_id, surface, line, col, decision, replacement_id, fingerprint FROM findings WHERE detector_id = 'co-occurrence'")
def cooccur_anchor(spark, d):
    return findings_of(spark, d).where("detector_id = 'co-occurrence'").select("unit_id", "rule_id", "entity_id", "surface", "line", "col", "decision", "replacement_id", "fingerprint")


PARTLY = [{"id": "al-1", "kind": "literal", "pattern": "Public License, Version", "variants": {"case_insensitive": True}}]
TERMS = compiled([WORDS[0], WORDS[2]], [{"rule_id": "r-1", "terms": ["e-terms", "e-time"], "window_kind": "file"}], PARTLY)


@query(f"WITH {sql_allow(_span('public license, version', 'al-1', True), ('license', 'version'))} SELECT doc_id AS unit_id, 'r-1' AS rule_id FROM judged WHERE cover IS NULL GROUP BY doc_id HAVING count(DISTINCT n) = 2")
def cooccur_suppressed(spark, d):
    return findings_of(spark, d, TERMS).where("detector_id = 'co-occurrence'").select("unit_id", "rule_id")


# ---- counts and order


@query(f"WITH {sql_findings(MAIN)} SELECT severity, count(*) AS n FROM findings GROUP BY severity")
def findings_by_severity(spark, d):
    return counts.by(findings_of(spark, d), "severity")


@query(f"WITH {sql_findings(MAIN)} SELECT surface, count(*) AS n FROM findings GROUP BY surface")
def findings_by_surface(spark, d):
    return counts.by(findings_of(spark, d), "surface")


@query(f"WITH {sql_findings(MAIN)} SELECT count(*) AS findings_total FROM findings")
def findings_total(spark, d):
    return findings_of(spark, d).agg(F.count("*").alias("findings_total"))


@query(f"WITH {UNITS} SELECT count(*) AS files_scanned, CAST(sum(n_bytes) AS BIGINT) AS bytes_scanned, count(DISTINCT source_id) AS distinct_paths FROM units")
def scan_counters(spark, d):
    return counts.scan_counts(tables.documents(spark, d))


@query(f"WITH {sql_findings(MAIN)} SELECT printf('f-%04d', CAST(row_number() OVER (ORDER BY git_ref, path, surface_kind, surface, line, col, detector_id, fingerprint) AS INTEGER)) AS id, fingerprint FROM findings")
def findings_ordered_ids(spark, d):
    return counts.numbered(findings_of(spark, d)).select("id", "fingerprint")


# ---- unique contents, and refs (the source of a document; the primary is src0)

PRIMARY = "src0"
SQL_BLOBS = f"{sql_findings(PLAIN)}, hashed AS (SELECT sha256(text) AS blob, source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, source AS ref, doc_id FROM documents)"


def _blobs(spark, d):
    one, places = attribute.unique_blobs(tables.documents(spark, d))
    return one, places.withColumn("ref", F.regexp_extract("path", "^([^/]+)/", 1))


@query("SELECT sha256(text) AS blob, count(*) AS n_places FROM documents GROUP BY 1")
def blob_dedupe(spark, d):
    one, places = _blobs(spark, d)
    return one.select("blob").join(places.groupBy("blob").agg(F.count("*").alias("n_places")), "blob")


@query(f"WITH {SQL_BLOBS} SELECT blob, path, entity_id, line, col FROM findings f JOIN hashed h ON h.doc_id = f.unit_id WHERE surface = 'content'".replace("SELECT blob, path,", "SELECT blob, h.path,"))
def blob_fanout(spark, d):
    one, places = _blobs(spark, d)
    found = detect(one, PLAIN, keep=("blob",))[0]
    return attribute.to_commits(found, places.withColumnRenamed("ref", "commit")).select("blob", "path", "entity_id", "line", "col")


@query("SELECT blob, string_agg(ref || ':' || path, ' ' ORDER BY ref, path) AS places FROM (SELECT sha256(text) AS blob, source AS ref, source || '/' || lang || '/doc_' || doc_id || '.txt' AS path FROM documents) GROUP BY blob")
def blob_attr_sorted(spark, d):
    places = attribute.sorted_places(_blobs(spark, d)[1].withColumnRenamed("ref", "commit"))
    return places.select("blob", F.array_join(F.transform("places", lambda p: F.concat(p["commit"], F.lit(":"), p["path"])), " ").alias("places"))


def _by_ref(spark, d):
    one, places = _blobs(spark, d)
    content = detect(one, PLAIN, keep=("blob",))[0]
    return attribute.to_refs(content, attribute.path_findings(places, PLAIN), places)


SQL_REFS = f"{SQL_BLOBS}, by_ref AS (SELECT h.ref, f.entity_id, f.decision, f.severity FROM findings f JOIN hashed h ON h.doc_id = f.unit_id), facts AS (SELECT ref, list_sort(list(DISTINCT entity_id)) AS entities, bool_or(decision = 'block') AS block_tier, count(*) AS n_findings FROM by_ref GROUP BY ref)"


@query(f"WITH {SQL_REFS} SELECT ref, array_to_string(entities, ',') AS entities, n_findings FROM facts")
def ref_entities(spark, d):
    return publish.ref_facts(_by_ref(spark, d)).select("ref", F.array_join("entities", ",").alias("entities"), "n_findings")


@query(f"WITH {SQL_REFS} SELECT ref, block_tier FROM facts")
def ref_block_tier(spark, d):
    return publish.ref_facts(_by_ref(spark, d)).select("ref", "block_tier")


@query(f"WITH {SQL_REFS} SELECT ref, severity, count(*) AS n, CAST(grouping(ref, severity) AS BIGINT) AS level FROM by_ref GROUP BY GROUPING SETS ((ref, severity), (severity), ())")
def ref_severity_counts(spark, d):
    return counts.by_ref_and_severity(_by_ref(spark, d)).select(F.col("git_ref").alias("ref"), "severity", "n", "level")


#: Refs by more telling names, so that some match a pattern.
SQL_NAME = "CASE CAST(substr(source, 4) AS INTEGER) % 7 WHEN 1 THEN 'backup/' || source WHEN 2 THEN source || '-bak' WHEN 3 THEN 'x-pre-rewrite-' || source WHEN 4 THEN 'v-snapshot-' || source ELSE source END"


def _name(source):
    n = F.substring(source, 4, 9).cast("int") % 7
    return F.when(n == 1, F.concat(F.lit("backup/"), source)).when(n == 2, F.concat(source, F.lit("-bak"))).when(n == 3, F.concat(F.lit("x-pre-rewrite-"), source)).when(n == 4, F.concat(F.lit("v-snapshot-"), source)).otherwise(source)


SQL_DANGER = "CASE " + " ".join(f"WHEN regexp_matches(name, '^{'.*'.join(p.split('*'))}$') THEN {quoted(p)}" for p in DANGER_PATTERNS) + " END"


@query(f"SELECT name, {SQL_DANGER} AS pattern FROM (SELECT DISTINCT {SQL_NAME} AS name FROM documents)")
def ref_danger_names(spark, d):
    names = spark.read.parquet(f"{d}/documents.parquet").select(_name(F.col("source")).alias("name")).distinct()
    return names.withColumn("pattern", T.first_matching(F.col("name"), [(p, name_glob(p)) for p in DANGER_PATTERNS]))


def _verdicts(spark, d):
    refs = spark.read.parquet(f"{d}/documents.parquet").select("source").distinct().select(_name(F.col("source")).alias("name"), "source")
    facts = publish.ref_facts(_by_ref(spark, d)).withColumn("ref", _name(F.col("ref")))
    kind = F.when(F.col("name").startswith("v-"), "tag").otherwise("branch")
    return publish.evaluate(refs.select("name", kind.alias("kind"), F.lit(True).alias("scanned")), facts, PRIMARY)


SQL_VERDICTS = f"{SQL_REFS}, refs AS (SELECT DISTINCT source, {SQL_NAME} AS name FROM documents), joined AS (SELECT name, CASE WHEN starts_with(name, 'v-') THEN 'tag' ELSE 'branch' END AS kind, coalesce(block_tier, false) AS block_tier, CASE WHEN source = '{PRIMARY}' THEN [] ELSE list_sort(list_filter(coalesce(facts.entities, []), lambda e: NOT list_contains(base.entities, e))) END AS divergent, {SQL_DANGER} AS pattern FROM refs LEFT JOIN facts ON facts.ref = refs.source CROSS JOIN (SELECT entities FROM facts WHERE ref = '{PRIMARY}') AS base), verdicts AS (SELECT *, len(divergent) > 0 OR pattern IS NOT NULL AS leak_vector FROM joined)"


@query(f"WITH {SQL_VERDICTS} SELECT name, array_to_string(divergent, ',') AS divergent FROM verdicts")
def ref_divergence(spark, d):
    return _verdicts(spark, d).select("name", F.array_join("divergent_entities", ",").alias("divergent"))


@query(f"WITH {SQL_VERDICTS} SELECT name, kind, block_tier, leak_vector, concat_ws(',', CASE WHEN len(divergent) > 0 THEN 'diverges_from_primary' END, CASE WHEN pattern IS NOT NULL THEN 'name_pattern' END) AS reasons, CASE WHEN leak_vector THEN 'git push origin --delete ' || CASE WHEN kind = 'tag' THEN 'refs/tags/' ELSE '' END || name END AS suggested_action FROM verdicts")
def ref_verdict(spark, d):
    return _verdicts(spark, d).select("name", "kind", "block_tier", "leak_vector", F.array_join("reasons", ",").alias("reasons"), "suggested_action")


@query(f"WITH {SQL_VERDICTS} SELECT NOT bool_or(leak_vector OR block_tier) AS publish_safe, coalesce(string_agg(name, ',' ORDER BY name) FILTER (leak_vector), '') AS leak_vector_refs FROM verdicts")
def publish_safe(spark, d):
    return publish.surface(_verdicts(spark, d)).select("publish_safe", F.array_join("leak_vector_refs", ",").alias("leak_vector_refs"))


# ---- redaction, term lists, diffs


@query("SELECT doc_id, regexp_replace(text, '(?i)license', '<r:e-terms>', 'g') AS text FROM documents WHERE contains(lower(text), 'license')")
def redact_text(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").where(F.lower("text").contains("license"))
    return docs.select("doc_id", redact(F.col("text"), [("license", "e-terms", True)]).alias("text"))


#: Aliases first become characters that no alias holds, the longest first, and those the markers: one pass, as the redactor makes it.
SQL_REDACTED = "text"
for _rx, _mark in (("Apache License", 1), ("(?i)license", 2), ("(?i)apache", 3), ("(?i)terms", 4)):
    SQL_REDACTED = f"regexp_replace({SQL_REDACTED}, '{_rx}', chr({0xE000 + _mark}), 'g')"
for _mark, _id in enumerate(("e-both", "e-terms", "e-owner", "e-x"), 1):
    SQL_REDACTED = f"replace({SQL_REDACTED}, chr({0xE000 + _mark}), '<r:{_id}>')"


@query(f"SELECT doc_id, sha256({SQL_REDACTED}) AS sha256 FROM documents")
def redact_many(spark, d):
    aliases = [("license", "e-terms", True), ("Apache License", "e-both", False), ("apache", "e-owner", True), ("terms", "e-x", True)]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.sha2(redact(F.col("text"), aliases), 256).alias("sha256"))


@query("SELECT 'e-tl-' || substr(sha256(n_name), 1, 12) AS id, n_name AS replacement, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS aliases FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def termlist_entities(spark, d):
    rows = spark.read.parquet(f"{d}/customer.parquet").join(spark.read.parquet(f"{d}/nation.parquet"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("n_name").alias("replacement")).agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("aliases")).withColumn("id", T.opaque_id("e-tl-", F.col("replacement")))


@query("SELECT p_name, 'e-rx-' || substr(sha256(p_name), 1, 12) AS pattern_id, 'al-tl-' || substr(sha256('literal' || chr(0) || p_name), 1, 12) AS allow_id FROM part")
def opaque_ids(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    return part.select("p_name", T.opaque_id("e-rx-", F.col("p_name")).alias("pattern_id"), T.opaque_id("al-tl-", F.concat(F.lit("literal\0"), "p_name")).alias("allow_id"))


#: Each document's lines as a diff: every third line opens a hunk, the first names the file.
SQL_DIFF = "lines AS (SELECT doc_id AS diff_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), added AS (SELECT diff_id, i, t, CAST(floor((i - 1) / 3) AS BIGINT) AS hunk FROM lines WHERE i % 3 <> 0)"


def _diff(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")))
    head = F.array(F.lit("+++ b/file.txt"))
    mark = F.when(F.col("pos") % 3 == 2, F.array(F.concat(F.lit("-"), "col"))).otherwise(F.array(F.concat(F.lit("+"), "col")))
    hunk = F.when(F.col("pos") % 3 == 0, F.array(F.concat(F.lit("@@ -1,0 +"), (F.col("pos") + 10).cast("string"), F.lit(",2 @@")))).otherwise(F.array().cast("array<string>"))
    made = F.concat(F.when(F.col("pos") == 0, head).otherwise(F.array().cast("array<string>")), hunk, mark)
    return docs.select("doc_id", F.col("pos").alias("at"), F.posexplode(made).alias("k", "line")).select(F.col("doc_id").alias("diff_id"), (F.col("at") * 4 + F.col("k")).cast("long").alias("n"), "line")


@query(f"WITH {SQL_DIFF} SELECT diff_id, 'file.txt' AS path, min(i) + 9 AS line_base, string_agg(t || chr(10), '' ORDER BY i) AS content FROM added GROUP BY diff_id, hunk".replace("min(i) + 9", "CAST(min(i) + 9 AS INTEGER)").replace("SELECT diff_id,", "SELECT CAST(diff_id AS BIGINT) AS diff_id,"))
def diff_hunks(spark, d):
    lines = _diff(spark, d)
    units = diff.hunk_units(lines.withColumnRenamed("diff_id", "diff_id"))
    first = diff.parse_lines(lines).where("_added and path <> ''").groupBy("diff_id", "path", "hunk", "island").agg(F.min("n").alias("first"))
    named = first.select(F.xxhash64("diff_id", "path", "first").alias("unit_id"), "diff_id")
    return units.join(named, "unit_id").select("diff_id", F.col("source_id").alias("path"), "line_base", "content")


QUERIES = {**Q, **fixtures.QUERIES, "stream_findings": fixtures.fx_stream}
ORACLE_SQL = {**SQL, **fixtures.ORACLE_SQL, "stream_findings": f"WITH {sql_findings(MAIN)} SELECT unit_id, entity_id, surface, fingerprint FROM findings"}

"""Catalogs of protected vocabulary: loading, checks, and what detection runs on.

Messages name a place (an index or a field), never a protected value.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

import yaml

from hushgrid.functions.dialect import PatternError, engine, translate
from hushgrid.functions.enums import ENTITY_CLASSES, SEVERITY_RANK, VISIBILITIES, WINDOW_KINDS, rank

ID = re.compile(r"^[A-Za-z0-9][A-Za-z0-9._:-]*$")
VERSION = re.compile(r"^1\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)(?:[-+][0-9A-Za-z.-]+)?$")
NEWEST = (1, 1, 0)
#: What is neither letter nor decimal digit.
NOT_WORDY = engine.compile(r"[^\p{L}\p{Nd}]+" if engine is not re else r"[\W_]+")
SHORT = 4
TEXT, TEXTS, FLAG = "text", "list of texts", "true or false"
# The fields of each record and their kinds.
FIELDS = {
    "catalog": {"$schema": TEXT, "catalog_id": TEXT, "schema_version": TEXT, "description": TEXT, "default_severity": TEXT, "fingerprint_salt": TEXT, "entities": list, "co_occurrence_rules": list, "allowlist": list},
    "entity": {"id": TEXT, "class": TEXT, "aliases": TEXTS, "tokens": TEXTS, "regex_patterns": TEXTS, "variants": dict, "replacement_for": TEXT, "replacement_suggestion": TEXT, "allowed_in": TEXTS, "blocked_in": TEXTS, "visibility_scope": TEXT, "severity_override": TEXT, "disclosure_safe": FLAG, "notes": TEXT},
    "entity variants": {"case_insensitive": FLAG, "slug": FLAG, "pluralize": FLAG, "path_segments": FLAG, "whole_word": FLAG},
    "rule": {"rule_id": TEXT, "description": TEXT, "terms": TEXTS, "window_kind": TEXT, "window_size": int, "severity_override": TEXT, "apply_in": TEXTS},
    "allowlist entry": {"id": TEXT, "kind": TEXT, "pattern": TEXT, "variants": dict, "reason": TEXT},
    "allowlist variants": {"case_insensitive": FLAG, "whole_word": FLAG},
}
# The vocabulary that anyone may use.
BUILTIN = {
    "public-baseline": {
        "catalog_id": "public-baseline",
        "schema_version": "1.0.0",
        "default_severity": "high",
        "entities": [
            {"id": "e-sentinel-1", "class": "operational_pattern", "aliases": ["DO_NOT_COMMIT", "TODO_REMOVE_BEFORE_PUSH", "REMOVE_BEFORE_COMMIT", "XXX_REMOVE_ME"], "variants": {"case_insensitive": False}, "blocked_in": ["public_oss", "unlisted_oss", "internal"], "severity_override": "high", "replacement_suggestion": "remove before commit", "disclosure_safe": True},
            {"id": "e-placeholder-1", "class": "operational_pattern", "aliases": ["example-secret", "placeholder-secret", "fake-client-name"], "variants": {"case_insensitive": True, "slug": True}, "blocked_in": ["public_oss", "unlisted_oss"], "severity_override": "medium", "replacement_suggestion": "replace with neutral fixture text", "disclosure_safe": True},
        ],
    }
}


class CatalogError(ValueError):
    """A catalog that cannot be used. Safe to show: it holds no protected value."""


@dataclass(frozen=True)
class Literal:
    match: str
    ignore_case: bool
    whole_word: bool


@dataclass(frozen=True)
class Pattern:
    java: str
    python: str
    whole_word: bool = False
    #: As RE2 takes it.
    source: str = ""


@dataclass(frozen=True)
class EntityRule:
    """One entity in the order in which it is looked for: literals, then patterns."""

    id: str
    klass: str
    severity: str
    replacement: str
    allowed_in: tuple[str, ...]
    literals: tuple[Literal, ...]
    patterns: tuple[Pattern, ...]


@dataclass(frozen=True)
class CoRule:
    id: str
    terms: tuple[str, ...]
    severity: str
    apply_in: tuple[str, ...]


@dataclass(frozen=True)
class AllowRule:
    id: str
    literals: tuple[Literal, ...]
    patterns: tuple[Pattern, ...]


@dataclass(frozen=True)
class Compiled:
    """What detection needs of all catalogs, for one visibility and threshold."""

    entities: tuple[EntityRule, ...]
    rules: tuple[CoRule, ...]
    allow: tuple[AllowRule, ...]
    threshold: str
    visibility: str


@dataclass
class Catalog:
    doc: dict
    warnings: list[str] = field(default_factory=list)

    @property
    def id(self) -> str:
        return self.doc["catalog_id"]

    @property
    def entities(self) -> list[dict]:
        return self.doc["entities"]

    @property
    def rules(self) -> list[dict]:
        return self.doc.get("co_occurrence_rules") or []

    @property
    def allowlist(self) -> list[dict]:
        return self.doc.get("allowlist") or []

    def aliases(self) -> list[tuple[str, str, bool]]:
        """(text, entity id, ignore case) of everything that output must not show: aliases and tokens as written."""
        out = []
        for e in self.entities:
            fold = bool((e.get("variants") or {}).get("case_insensitive"))
            out += [(a, e["id"], fold) for a in e.get("aliases") or [] if a.strip()]
            out += [(t, e["id"], False) for t in e.get("tokens") or [] if t.strip()]
        return out


def load_file(path: str) -> Catalog:
    try:
        data = Path(path).read_bytes()
    except OSError:
        raise CatalogError("a catalog file cannot be read") from None
    return load_bytes(data)


def load_builtin(name: str) -> Catalog:
    if name not in BUILTIN:
        raise CatalogError("there is no built-in catalog of that name")
    return _check(BUILTIN[name])


def load_bytes(data: bytes) -> Catalog:
    try:
        doc = yaml.safe_load(data)
    except yaml.YAMLError as e:
        mark = getattr(e, "problem_mark", None)
        raise CatalogError(f"a catalog is not YAML{f' (line {mark.line + 1})' if mark else ''}") from None
    return _check(doc)


def _check(doc: object) -> Catalog:
    if not isinstance(doc, dict):
        raise CatalogError("a catalog is a mapping")
    warnings = []
    version = doc.get("schema_version")
    m = re.match(r"^(\d+)\.(\d+)\.(\d+)(?:[-+].*)?$", version) if isinstance(version, str) else None
    if not m:
        raise CatalogError("/schema_version: not a version")
    if m[1] != "1":
        raise CatalogError("/schema_version: only major version 1 can be read")
    if tuple(map(int, m.groups())) > NEWEST:
        warnings.append("schema_version is newer than this reader")
    for i, e in enumerate(doc.get("entities") or []):
        if isinstance(e, dict) and "match" in e:
            raise CatalogError(f"/entities/{i}: 'match' is no field; use aliases, tokens or regex_patterns")
    _shape(doc)
    if not doc.get("$schema"):
        warnings.append("$schema is not given")
    _invariants(doc, warnings)
    return Catalog(doc, warnings)


def _fields(record: object, kind: str, at: str) -> None:
    if not isinstance(record, dict):
        raise CatalogError(f"{at}: not a mapping")
    known = FIELDS[kind]
    for name, value in record.items():
        if name not in known:
            raise CatalogError(f"{at}: an unknown field")
        want = known[name]
        right = isinstance(value, str) if want == TEXT else isinstance(value, bool) if want == FLAG else isinstance(value, list) and all(isinstance(x, str) and x for x in value) and len(set(value)) == len(value) if want == TEXTS else isinstance(value, want) and not isinstance(value, bool)
        if not right:
            raise CatalogError(f"{at}/{name}: not a {want if isinstance(want, str) else want.__name__}")


def _among(record: dict, name: str, allowed: Iterable[str], at: str) -> None:
    values = record.get(name)
    for v in values if isinstance(values, list) else [values] if values is not None else []:
        if v not in allowed:
            raise CatalogError(f"{at}/{name}: not one of the known values")


def _id(record: dict, name: str, at: str) -> None:
    if not ID.match(record.get(name) or ""):
        raise CatalogError(f"{at}/{name}: missing or malformed")


def _shape(doc: dict) -> None:
    _fields(doc, "catalog", "")
    _id(doc, "catalog_id", "")
    if not VERSION.match(doc["schema_version"]):
        raise CatalogError("/schema_version: pattern")
    _among(doc, "default_severity", SEVERITY_RANK, "")
    if not doc.get("entities"):
        raise CatalogError("/entities: at least one is needed")
    for i, e in enumerate(doc["entities"]):
        at = f"/entities/{i}"
        _fields(e, "entity", at)
        _id(e, "id", at)
        if "class" not in e:
            raise CatalogError(f"{at}/class: missing")
        _among(e, "class", ENTITY_CLASSES, at)
        _among(e, "severity_override", SEVERITY_RANK, at)
        for name in ("allowed_in", "blocked_in", "visibility_scope"):
            _among(e, name, VISIBILITIES, at)
        if "variants" in e:
            _fields(e["variants"], "entity variants", f"{at}/variants")
        if not any(e.get(k) for k in ("aliases", "tokens", "regex_patterns")):
            raise CatalogError(f"{at}: no alias, token or pattern")
    for i, r in enumerate(doc.get("co_occurrence_rules") or []):
        at = f"/co_occurrence_rules/{i}"
        _fields(r, "rule", at)
        _id(r, "rule_id", at)
        _among(r, "severity_override", SEVERITY_RANK, at)
        _among(r, "apply_in", VISIBILITIES, at)
        if "window_kind" not in r:
            raise CatalogError(f"{at}/window_kind: missing")
        _among(r, "window_kind", WINDOW_KINDS, at)
        if r["window_kind"].startswith("near_n") and r.get("window_size", 0) < 1:
            raise CatalogError(f"{at}/window_size: needed for this window")
    for i, a in enumerate(doc.get("allowlist") or []):
        at = f"/allowlist/{i}"
        _fields(a, "allowlist entry", at)
        _id(a, "id", at)
        _among(a, "kind", ("literal", "regex"), at)
        if "kind" not in a or not a.get("pattern"):
            raise CatalogError(f"{at}: kind and pattern are needed")
        if "variants" in a:
            _fields(a["variants"], "allowlist variants", f"{at}/variants")


def _unique(records: list[dict], name: str, what: str) -> set[str]:
    ids = [r[name] for r in records]
    if len(set(ids)) != len(ids):
        raise CatalogError(f"{what}: an id is given twice")
    return set(ids)


def _invariants(doc: dict, warnings: list[str]) -> None:
    rules, allow = doc.get("co_occurrence_rules") or [], doc.get("allowlist") or []
    ids = _unique(doc["entities"], "id", "/entities")
    _unique(rules, "rule_id", "/co_occurrence_rules")
    _unique(allow, "id", "/allowlist")
    for i, r in enumerate(rules):
        if len(r.get("terms") or []) < 2:
            raise CatalogError(f"/co_occurrence_rules/{i}/terms: at least two are needed")
        if not set(r["terms"]) <= ids:
            raise CatalogError(f"/co_occurrence_rules/{i}/terms: an unknown entity")
    for i, a in enumerate(allow):
        if not a["pattern"].strip():
            raise CatalogError(f"/allowlist/{i}/pattern: empty")
        if a["kind"] == "regex":
            _pattern(a["pattern"], f"/allowlist/{i}/pattern")
    for e in doc["entities"]:
        v = e.get("variants") or {}
        if v.get("case_insensitive") and (v.get("whole_word") or any(len(a.strip()) < SHORT for a in e.get("aliases") or []) and "whole_word" not in v):
            warnings.append(f"entity {e['id']} is matched as a whole word in any case")
    if allow and tuple(map(int, re.findall(r"\d+", doc["schema_version"])[:3])) < (1, 1, 0):
        warnings.append("an allowlist asks for schema_version 1.1.0 or newer")
    unsafe_ids([Catalog(doc)], loading=True)


def unsafe_ids(catalogs: list[Catalog], loading: bool = False) -> None:
    """Refuse ids that output would show and that hold a protected alias, of any of the catalogs; while loading, of entities and exceptions alone."""
    shown = []
    for c in catalogs:
        shown += [e["id"] for e in c.entities] + [a["id"] for a in c.allowlist]
        if loading:
            continue
        shown += [c.id, *(e["replacement_suggestion"] for e in c.entities if e.get("replacement_suggestion")), *(r["rule_id"] for r in c.rules)]
    for text, _, fold in (a for c in catalogs for a in c.aliases()):
        for s in shown:
            if (text.lower() in s.lower()) if fold else (text in s):
                raise CatalogError("an id that output shows contains a protected alias")


def _pattern(pattern: str, at: str, fold: bool = False, whole_word: bool = False) -> Pattern:
    try:
        return Pattern(translate(pattern, "java", fold), translate(pattern, "python", fold), whole_word, f"(?i){pattern}" if fold else pattern)
    except (PatternError, ValueError):
        raise CatalogError(f"{at}: not a supported pattern") from None


def slugify(text: str, separator: str = "-") -> str:
    """Small letters and digits; what lies between runs of them becomes one separator."""
    return NOT_WORDY.sub(separator, text.lower()).strip(separator)


def expand(alias: str, variants: dict) -> list[str]:
    """All forms of an alias, in byte order."""
    alias = alias.strip()
    forms = {alias}
    if variants.get("slug"):
        s = slugify(alias)
        forms |= {s, s.replace("-", "_"), s.replace("-", "")}
    if variants.get("pluralize"):
        forms.add(alias + "s")
    return sorted((f for f in forms if f), key=lambda f: f.encode())


def _whole(form: str, variants: dict) -> bool:
    return variants["whole_word"] if variants.get("whole_word") is not None else len(form) < SHORT


def compile_catalogs(catalogs: list[Catalog], visibility: str = "public_oss", threshold: str = "high") -> Compiled:
    """Entities that the visibility allows are left out here, so that detection never looks for them."""
    if not rank(threshold):
        raise CatalogError("an unknown threshold")
    entities, rules, allow = [], [], []
    for c in catalogs:
        default = c.doc.get("default_severity") or "high"
        for i, e in enumerate(c.entities):
            if visibility in (e.get("allowed_in") or []):
                continue
            v = e.get("variants") or {}
            fold = bool(v.get("case_insensitive"))
            literals: dict[tuple, Literal] = {}
            for alias in e.get("aliases") or []:
                for form in expand(alias, v):
                    own = form.lower() if fold else form
                    literals.setdefault((own, _whole(form, v)), Literal(own, fold, _whole(form, v)))
            for token in e.get("tokens") or []:
                literals.setdefault((token, True), Literal(token, False, True))
            patterns = tuple(_pattern(p, f"/entities/{i}/regex_patterns") for p in e.get("regex_patterns") or [])
            entities.append(EntityRule(e["id"], e["class"], e.get("severity_override") or default, e.get("replacement_suggestion") or "", tuple(e.get("allowed_in") or ()), tuple(literals.values()), patterns))
        for r in c.rules:
            if not r.get("apply_in") or visibility in r["apply_in"]:
                rules.append(CoRule(r["rule_id"], tuple(r["terms"]), r.get("severity_override") or default, tuple(r.get("apply_in") or ())))
        for i, a in enumerate(c.allowlist):
            v = a.get("variants") or {}
            fold = bool(v.get("case_insensitive"))
            if a["kind"] == "literal":
                text = a["pattern"]
                allow.append(AllowRule(a["id"], (Literal(text.lower() if fold else text, fold, _whole(text.strip(), v)),), ()))
            else:
                allow.append(AllowRule(a["id"], (), (_pattern(a["pattern"], f"/allowlist/{i}/pattern", fold, bool(v.get("whole_word"))),)))
    return Compiled(tuple(entities), tuple(rules), tuple(allow), threshold, visibility)


def content_hash(files: dict[str, bytes]) -> str:
    """One hash over catalog files: base name and bytes of each, in order of their paths."""
    h = hashlib.sha256()
    for path in sorted(files):
        h.update(Path(path).name.encode() + b"\0" + files[path] + b"\0")
    return f"sha256:{h.hexdigest()}"

"""Term lists: one line a mapping, pattern or exception, made into a catalog."""

from __future__ import annotations

import hashlib

import yaml

from hushgrid.functions.dialect import PatternError, translate
from hushgrid.sources.catalog import CatalogError, load_bytes

SEPARATOR, REGEX, ALLOW = "==>", "regex:", ("allowlist:literal:", "allowlist:regex:")
KEYS = {"class": str, "severity": str, "case_insensitive": bool, "whole_word": bool}


class TermListError(CatalogError):
    def __init__(self, line: int, reason: str):
        super().__init__(f"term list line {line}: {reason}")
        self.line = line


def opaque(prefix: str, text: str) -> str:
    """An id that says nothing of what it stands for and never changes."""
    return prefix + hashlib.sha256(text.encode()).hexdigest()[:12]


def _directive(text: str, line: int, allowed: tuple[str, ...]) -> dict:
    out: dict = {}
    for item in text.split():
        key, _, value = item.partition("=")
        if not value:
            raise TermListError(line, "a directive is key=value")
        if key not in KEYS:
            raise TermListError(line, "unknown directive key")
        if KEYS[key] is bool:
            if value not in ("true", "false"):
                raise TermListError(line, "a flag is true or false")
            out[key] = value == "true"
        else:
            out[key] = value
    if set(out) - set(allowed):
        raise TermListError(line, "a directive key that this kind of line does not take")
    return out


def _body(rest: str) -> tuple[str, str]:
    value, _, directive = rest.partition(" #")
    return value.strip(), directive.strip()


def _compiles(pattern: str, line: int) -> None:
    try:
        translate(pattern, "python")
    except (PatternError, ValueError):
        raise TermListError(line, "a pattern does not compile") from None


def parse(lines: list[str]) -> tuple[dict, dict, dict]:
    """(groups by replacement, patterns, exceptions), each in order of appearance."""
    groups: dict[str, dict] = {}
    patterns: dict[str, dict] = {}
    allowed: dict[tuple[str, str], dict] = {}
    for n, raw in enumerate(lines, 1):
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        if SEPARATOR not in line and line.startswith(REGEX):
            pattern, directive = _body(line[len(REGEX) :])
            if not pattern:
                raise TermListError(n, "empty pattern")
            _compiles(pattern, n)
            meta = _directive(directive, n, ("class", "severity"))
            if patterns.setdefault(pattern, meta) != meta:
                raise TermListError(n, "says otherwise than an earlier line")
        elif SEPARATOR not in line and line.startswith(ALLOW):
            kind = "regex" if line.startswith(ALLOW[1]) else "literal"
            pattern, directive = _body(line[len(f"allowlist:{kind}:") :])
            if not pattern:
                raise TermListError(n, "empty exception")
            if kind == "regex":
                _compiles(pattern, n)
            meta = _directive(directive, n, ("case_insensitive", "whole_word"))
            if allowed.setdefault((kind, pattern), meta) != meta:
                raise TermListError(n, "says otherwise than an earlier line")
        else:
            term, found, rest = line.partition(SEPARATOR)
            replacement, directive = _body(rest)
            if not found or not term.strip() or not replacement:
                raise TermListError(n, "a mapping needs a term, the separator and a replacement")
            meta = _directive(directive, n, ("class", "severity"))
            group = groups.setdefault(replacement, {"aliases": [], "meta": {}})
            for k, v in meta.items():
                if group["meta"].setdefault(k, v) != v:
                    raise TermListError(n, "says otherwise than an earlier line of its group")
            if term.strip() not in group["aliases"]:
                group["aliases"].append(term.strip())
    return groups, patterns, allowed


def build(text: str, catalog_id: str, default_class: str = "codename", default_severity: str = "medium", whole_word: bool = True, schema_version: str = "1.1.0", schema_uri: str | None = None) -> bytes:
    """A term list as a catalog, in YAML; what is built is read back before it is given out."""
    groups, patterns, allowed = parse(text.splitlines())
    if not groups and not patterns:
        raise CatalogError("a term list without terms")
    entities = []
    for replacement, g in groups.items():
        e = {"id": opaque("e-tl-", replacement), "class": g["meta"].get("class", default_class), "aliases": sorted(g["aliases"], key=str.encode), "variants": {"case_insensitive": True, "slug": True, "whole_word": whole_word}, "replacement_suggestion": replacement}
        entities.append(e | ({"severity_override": g["meta"]["severity"]} if "severity" in g["meta"] else {}))
    for pattern, meta in patterns.items():
        e = {"id": opaque("e-rx-", pattern), "class": meta.get("class", default_class), "regex_patterns": [pattern]}
        entities.append(e | ({"severity_override": meta["severity"]} if "severity" in meta else {}))
    doc: dict = {"$schema": schema_uri} if schema_uri else {}
    doc |= {"catalog_id": catalog_id, "schema_version": schema_version, "default_severity": default_severity, "entities": sorted(entities, key=lambda e: e["id"])}
    if allowed:
        doc["allowlist"] = sorted(({"id": opaque("al-tl-", f"{kind}\0{pattern}"), "kind": kind, "pattern": pattern} | ({"variants": meta} if meta else {}) for (kind, pattern), meta in allowed.items()), key=lambda a: a["id"])
    data = yaml.safe_dump(doc, sort_keys=False, allow_unicode=True).encode()
    load_bytes(data)
    return data

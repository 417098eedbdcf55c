"""Exceptions for codenames whose repository is public by now."""

from __future__ import annotations

from collections.abc import Callable

import yaml

from hushgrid.sources.catalog import CatalogError, load_bytes
from hushgrid.sources.termlist import SEPARATOR, TermListError, opaque

PUBLIC, NOT_PUBLIC, UNRESOLVED = "public", "not_public", "unresolved"


def classify(answer: str | None) -> str:
    """What a forge says of a repository; anything unknown stays unresolved."""
    return {"public": PUBLIC, "private": NOT_PUBLIC, "internal": NOT_PUBLIC}.get((answer or "").strip().lower(), UNRESOLVED)


def pairs(text: str) -> list[tuple[str, str]]:
    found: dict[str, str] = {}
    for n, raw in enumerate(text.splitlines(), 1):
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        term, sep, repo = (x.strip() for x in line.partition(SEPARATOR))
        if not (term and sep and repo):
            raise TermListError(n, "a mapping needs a codename, the separator and a repository")
        if found.setdefault(term, repo) != repo:
            raise TermListError(n, "a codename with two repositories")
    if not found:
        raise CatalogError("no mappings")
    return list(found.items())


def allow_public(base: bytes, mappings: str, resolve: Callable[[str], str]) -> tuple[bytes, dict[str, int]]:
    """The catalog with an exception for each codename that resolves as public, and counts. Without one to add the bytes stay as they are."""
    catalog = load_bytes(base)
    have = {a["id"] for a in catalog.allowlist}
    counts = {"total": 0, "public": 0, "not_public": 0, "unresolved": 0, "added": 0}
    new = []
    for term, repo in pairs(mappings):
        verdict = resolve(repo)
        verdict = verdict if verdict in (PUBLIC, NOT_PUBLIC) else UNRESOLVED
        counts["total"] += 1
        counts[verdict] += 1
        entry = opaque("al-vis-", term)
        if verdict == PUBLIC and entry not in have:
            new.append({"id": entry, "kind": "literal", "pattern": term, "variants": {"case_insensitive": True, "whole_word": True}, "reason": "backing repository resolved public"})
            counts["added"] += 1
    if not new:
        return base, counts
    doc = yaml.safe_load(base)
    doc["allowlist"] = [*(doc.get("allowlist") or []), *sorted(new, key=lambda a: a["id"])]
    data = yaml.safe_dump(doc, sort_keys=False, allow_unicode=True).encode()
    load_bytes(data)
    return data, counts

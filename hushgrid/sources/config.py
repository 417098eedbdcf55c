"""The repository's public configuration, and the catalogs that it refers to."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path

import yaml

from hushgrid.functions.enums import MODES, POSTURES, SEVERITY_RANK
from hushgrid.sources.catalog import Catalog, CatalogError, load_builtin, load_file

# Kinds of source, and the field that each needs.
NEEDS = {"file": "path", "env": "var", "builtin": "name", "profile": "name", "url": "url"}
OK, ABSENT, WARN, ERROR = "ok", "absent_optional", "missing_warn", "missing_error"


@dataclass
class Resolution:
    catalog_id: str
    kind: str
    optional: bool
    status: str
    reason: str = ""
    catalog: Catalog | None = None


def load_config(data: bytes) -> dict:
    try:
        doc = yaml.safe_load(data)
    except yaml.YAMLError:
        raise CatalogError("the configuration is not YAML") from None
    if not isinstance(doc, dict) or not doc.get("schema_version") or not (doc.get("repo") or {}).get("id"):
        raise CatalogError("the configuration needs schema_version and repo.id")
    seen = set()
    for i, ref in enumerate(doc.get("catalogs") or []):
        source = ref.get("source") or {}
        if not ref.get("catalog_id") or ref["catalog_id"] in seen:
            raise CatalogError(f"/catalogs/{i}: an id is missing or given twice")
        seen.add(ref["catalog_id"])
        if source.get("kind") not in NEEDS or not source.get(NEEDS[source["kind"]]):
            raise CatalogError(f"/catalogs/{i}/source: an unknown kind or a missing field")
    policy = doc.get("policy") or {}
    if policy.get("private_catalog_missing", "silent") not in POSTURES:
        raise CatalogError("/policy/private_catalog_missing: not one of the known values")
    return doc


def posture(flag: str | None, mode: str | None, config: dict | None) -> str:
    """What a missing optional catalog means: the flag, else what the mode implies, else the configuration, else nothing."""
    if flag:
        if flag not in POSTURES:
            raise CatalogError("an unknown posture")
        return flag
    if mode:
        return {"local": "warn", "ci": "warn", "release": "error"}[mode]
    return ((config or {}).get("policy") or {}).get("private_catalog_missing") or "silent"


def threshold(mode: str | None, config: dict | None) -> str:
    if mode:
        if mode not in MODES:
            raise CatalogError("an unknown mode")
        return "medium" if mode == "release" else "high"
    own = ((config or {}).get("policy") or {}).get("block_threshold") or "high"
    if own not in SEVERITY_RANK:
        raise CatalogError("an unknown threshold")
    return own


def visibility(flag: str | None, config: dict | None) -> str:
    return flag or ((config or {}).get("repo") or {}).get("visibility") or "public_oss"


def _load(source: dict, folder: Path) -> tuple[Catalog | None, str]:
    kind = source["kind"]
    if kind == "builtin":
        try:
            return load_builtin(source["name"]), ""
        except CatalogError:
            return None, "builtin_unavailable"
    if kind in ("profile", "url"):
        return None, "source_kind_unimplemented"
    path = source.get("path") if kind == "file" else os.environ.get(source["var"], "")
    if not path:
        return None, "env_unset"
    try:
        return load_file(str(folder / path)), ""
    except CatalogError:
        return None, "file_unavailable" if kind == "file" else "env_file_unavailable"


def resolve(config: dict, folder: str, missing: str = "silent") -> list[Resolution]:
    out = []
    for ref in config.get("catalogs") or []:
        source, optional = ref["source"], bool(ref.get("optional"))
        catalog, reason = _load(source, Path(folder))
        if catalog is not None and catalog.id != ref["catalog_id"]:
            raise CatalogError("a catalog declares another id than the configuration")
        if catalog is None and (not optional or missing == "error"):
            raise CatalogError(f"a {'required ' * (not optional)}catalog of kind {source['kind']} is unavailable")
        status = OK if catalog is not None else {"silent": ABSENT, "warn": WARN}[missing]
        out.append(Resolution(ref["catalog_id"], source["kind"], optional, status, reason, catalog))
    return out

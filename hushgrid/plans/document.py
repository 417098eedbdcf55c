"""The scan document and the audit document: redacted, in a total order."""

from __future__ import annotations

import datetime as dt
import json

from hushgrid.operators.redact import Redactor

SCHEMA_VERSION = "1.2.0"
ORDER = ("git_ref", "path", "surface_kind", "source_id", "surface", "line", "column")


def finding_record(row: dict, redactor: Redactor | None) -> dict:
    """A finding as the document shows it; empty optional fields are left out."""
    clean = redactor or (lambda s: s)
    location = {"path": clean(row["path"]), "source_id": clean(row["source_id"]), "line": row["line"], "column": row["col"], "git_ref": clean(row["git_ref"]), "surface_kind": row["surface_kind"]}
    kept = {"kind": row.get("kind", "detection"), "id": row["id"], "fingerprint": row["fingerprint"], "severity": row["severity"], "confidence": row["confidence"], "decision": row["decision"], "entity_id": row["entity_id"], "entity_class": row["entity_class"], "detector_id": row["detector_id"], "rule_id": row["rule_id"], "source_kind": row["source_kind"], "surface": row["surface"], "location": {k: v for k, v in location.items() if v}, "replacement_id": row["replacement_id"], "evidence_shape": row["evidence_shape"], "message": clean(row["message"])}
    return {k: v for k, v in kept.items() if v or k not in ("entity_id", "rule_id", "replacement_id")}


def sort_records(records: list[dict]) -> list[dict]:
    """In order of what is shown, after redaction."""

    def key(r: dict) -> tuple:
        at = r["location"]
        return (*((at.get(k, "") if k not in ("line", "column") else at.get(k, 0)) if k != "surface" else r["surface"] for k in ORDER), r["detector_id"])

    return sorted(records, key=key)


def config_warning(catalog_id: str, n: int, decision: str) -> dict:
    """An optional private catalog that is missing, as a finding."""
    import hashlib

    mark = hashlib.sha256(f"private-catalog-missing\0{catalog_id}".encode()).hexdigest()[:16]
    return {"kind": "config-warning", "id": f"cw-{n:04d}", "fingerprint": mark, "severity": "medium", "confidence": "high", "decision": decision, "entity_class": "catalog_config", "detector_id": "private-catalog-missing", "source_kind": "catalog_config", "surface": "config", "location": {"source_id": catalog_id}, "evidence_shape": "missing_private_catalog", "message": "Optional private catalog is unavailable"}


def scan_document(findings: list[dict], metadata: dict, coverage: dict, counts: dict, redactor: Redactor | None, warnings: list[dict] = ()) -> dict:
    clean = redactor or (lambda s: s)
    meta = {"output_schema_version": SCHEMA_VERSION, "started_at": dt.datetime.now(dt.UTC).isoformat(), **metadata, "scan_root": clean(metadata.get("scan_root", ""))}
    records = sort_records([finding_record(f, redactor) for f in findings] + list(warnings))
    return {"version": "v0", "scan_metadata": meta, "summary": {"coverage": coverage, **counts}, "findings": records}


def audit_document(verdicts: list[dict], surface: dict, primary: str, coverage: dict, findings: list[dict], redactor: Redactor | None) -> dict:
    clean = redactor or (lambda s: s)
    refs = [{k: v for k, v in {"name": clean(v["name"]), "kind": v["kind"], "scanned": v["scanned"], "leak_vector": v["leak_vector"], "reasons": v["reasons"], "divergent_entities": v["divergent_entities"], "suggested_action": clean(v["suggested_action"])}.items() if v is not None} for v in verdicts]
    refs.sort(key=lambda r: (not r["leak_vector"], r["name"]))
    return {"version": "v0", "primary_ref": clean(primary), "publish_safe": surface["publish_safe"], "leak_vector_refs": sorted(map(clean, surface["leak_vector_refs"])), "refs": refs, "coverage": coverage, "findings": sort_records([finding_record(f, redactor) for f in findings])}


def dumps(document: dict) -> str:
    return json.dumps(document, indent=2, ensure_ascii=False) + "\n"

"""Closed sets of values."""

from __future__ import annotations

# Fixed values of the data formats.
SEVERITY_RANK = {"info": 1, "low": 2, "medium": 3, "high": 4, "critical": 5}
VISIBILITIES = ("public_oss", "unlisted_oss", "internal", "engagement_private", "local_only")
ENTITY_CLASSES = ("client_identity", "codename", "person", "project", "system", "hostname", "account_label", "operational_pattern")
WINDOW_KINDS = ("file", "hunk", "identifier", "near_n_chars", "near_n_tokens")
BLOCKING_REASONS = ("file_too_large", "binary_detected", "unreadable", "unknown")
SKIP_REASONS = (*BLOCKING_REASONS, "ignored")
GAPS = ("unreadable_directory", "unknown_entry", "unfollowed_symlink", "unrecognized_skip_reason", "ref_missing_local_objects", "primary_baseline_unscanned", "names_only_content_omitted")
MODES = ("local", "ci", "release")
POSTURES = ("silent", "warn", "error")
BINARY_EXTENSIONS = (".exe", ".bin", ".so", ".dylib", ".dll", ".class", ".jar", ".o", ".a", ".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".pdf", ".zip", ".tar", ".gz", ".tgz", ".bz2", ".7z", ".mp4", ".mp3", ".woff", ".woff2", ".ttf", ".eot")
DANGER_PATTERNS = ("backup/*", "*pre-rewrite*", "*-snapshot-*", "archive/*", "*-bak", "wip/*")
SIZE_CAP = 10 << 20
MESSAGE = "Confidential context detected"
CO_MESSAGE = "Confidential context co-occurrence rule fired"


def rank(severity: str | None) -> int:
    return SEVERITY_RANK.get(severity or "", 0)

"""Ignore rules: the last rule that matches a path decides."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushgrid.functions.globs import clean_path, path_glob


@dataclass(frozen=True)
class Rule:
    pattern: str
    negated: bool
    folder_only: bool
    anchored: bool

    @property
    def regex(self) -> str:
        """Over whole paths: an unanchored rule looks at the last name only, or, for folders, at any name on the way."""
        own = path_glob(self.pattern)[1:-1]
        start = "^" if self.anchored else "^(?:.*/)?"
        return f"{start}{own}$"

    @property
    def below(self) -> str:
        """Paths inside what the rule matches."""
        return self.regex[:-1] + "/.+$"


def parse(text: str) -> list[Rule]:
    out = []
    for raw in text.splitlines():
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line.removeprefix("!")
        folder = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        line = line.removeprefix("/")
        if line:
            out.append(Rule(line, negated, folder, anchored))
    return out


def ignored(rules: list[Rule], path: str, is_dir: bool) -> bool:
    path, verdict = clean_path(path), False
    for r in rules:
        if re.match(r.below, path) or (not r.folder_only or is_dir) and re.match(r.regex, path):
            verdict = not r.negated
    return verdict


def may_reinclude(rules: list[Rule], folder: str) -> bool:
    """Whether a negated rule could match below an ignored folder, so that it has to be walked."""
    folder = clean_path(folder)
    for r in rules:
        if not r.negated:
            continue
        if not r.anchored or "**" in r.pattern:
            return True
        parts, own = r.pattern.split("/"), folder.split("/")
        if len(parts) > len(own) and all(re.match(path_glob(p), o) for p, o in zip(parts, own, strict=False)):
            return True
    return False


def ignored_column(rules: list[Rule], path: Column) -> Column:
    """The same for a column of file paths: one native expression, the last rule tried first."""
    tries = [F.when(path.rlike(r.below if r.folder_only else f"{r.regex}|{r.below}"), F.lit(not r.negated)) for r in reversed(rules)]
    return F.coalesce(*tries, F.lit(False))

"""Taking protected names out of output, in one pass: a marker is never looked into again."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


class Redactor:
    """aliases: (text, entity id, ignore case). The longest alias at a place wins; of equal ones the first."""

    def __init__(self, aliases: list[tuple[str, str, bool]]):
        self.ids: dict[str, str] = {}
        parts = []
        for text, entity, ignore_case in sorted(aliases, key=lambda a: -len(a[0].encode())):
            key = text.lower() if ignore_case else text
            if text and key not in self.ids:
                self.ids[key] = entity
                parts.append(f"(?i:{re.escape(text)})" if ignore_case else re.escape(text))
        if not parts:
            raise ValueError("a redactor needs an alias")
        self.regex = re.compile("|".join(parts))

    def __call__(self, text: str | None) -> str | None:
        return self.regex.sub(lambda m: f"<r:{self.ids.get(m[0]) or self.ids.get(m[0].lower()) or '?'}>", text) if text else text


def redact(text: Column, aliases: list[tuple[str, str, bool]]) -> Column:
    """The same over a column."""
    return redact_with(text, Redactor(aliases))


def redact_with(text: Column, own: Redactor) -> Column:
    """The same with a redactor at hand."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([own(t) for t in texts.to_pylist()], pa.string())

    return run(text)

"""What a scan passed over, and whether that was agreed to."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushgrid.functions.enums import BLOCKING_REASONS, GAPS, SKIP_REASONS


def parse_allowances(values: list[str]) -> dict[str, int]:
    """REASON=N, each blocking reason at most once."""
    out: dict[str, int] = {}
    for v in values:
        m = re.fullmatch(r"(\w+)=(\d+)", v, re.ASCII)
        if not m or m[1] not in BLOCKING_REASONS or m[1] in out or int(m[2]) >= 1 << 31:
            raise ValueError("an allowance is REASON=N, once for each blocking reason")
        out[m[1]] = int(m[2])
    return out


def accounted(skips: DataFrame) -> DataFrame:
    """skips with gap and units as coverage counts them: a gap comes before a reason, an unknown reason is a gap."""
    known = skips.where("not coverage_excluded")
    units = F.when(F.col("is_dir"), F.col("represented")).otherwise(F.lit(1).cast("long"))
    given = F.when(F.col("gap").isNotNull() & (F.col("gap") != ""), F.when(F.col("gap").isin(*GAPS), F.col("gap")).otherwise("unknown_entry"))
    odd = F.when(~F.coalesce(F.col("reason"), F.lit("")).isin(*SKIP_REASONS), "unrecognized_skip_reason").when(units < 0, "unknown_entry")
    return known.select(F.coalesce(given, odd).alias("gap"), F.col("reason"), units.alias("units"))


def summarize(skips: DataFrame, unit: str = "file", allowances: dict[str, int] | None = None, gaps: list[str] | None = None) -> dict:
    """The coverage record. One aggregation; at most a row for each reason and gap reaches the driver."""
    rows = accounted(skips).groupBy("gap", "reason").agg(F.sum("units").alias("units"), F.count("*").alias("events")).collect()
    by_reason: dict[str, int] = {}
    by_gap: dict[str, int] = {}
    for r in rows:
        if r.gap:
            by_gap[r.gap] = by_gap.get(r.gap, 0) + r.events
        elif r.units:
            by_reason[r.reason] = by_reason.get(r.reason, 0) + r.units
    for g in gaps or []:
        g = g if g in GAPS else "unknown_entry"
        by_gap[g] = by_gap.get(g, 0) + 1
    return verdict(by_reason, by_gap, unit, allowances or {})


def verdict(by_reason: dict[str, int], by_gap: dict[str, int], unit: str, allowances: dict[str, int]) -> dict:
    blocking = {r: n for r, n in by_reason.items() if r in BLOCKING_REASONS and n}
    left = {r: n - allowances.get(r, 0) for r, n in blocking.items() if n > allowances.get(r, 0)}
    status = "incomplete" if left or any(by_gap.values()) else "acknowledged" if blocking else "complete"
    return {"status": status, "skip_unit": unit, "skips_by_reason": by_reason, "blocking_skips_by_reason": blocking, "allowances_by_reason": dict(allowances), "unacknowledged_skips_by_reason": left, "non_budgetable_gaps_by_code": by_gap}


def validate(s: dict) -> None:
    """Refuse a record that contradicts itself; what it holds is not repeated."""
    maps = ("skips_by_reason", "blocking_skips_by_reason", "allowances_by_reason", "unacknowledged_skips_by_reason", "non_budgetable_gaps_by_code")
    if s.get("skip_unit") not in ("file", "unique_blob") or not all(isinstance(s.get(m), dict) for m in maps):
        raise ValueError("a malformed coverage record")
    if set(s["skips_by_reason"]) - set(SKIP_REASONS) or set(s["non_budgetable_gaps_by_code"]) - set(GAPS) or any(set(s[m]) - set(BLOCKING_REASONS) for m in maps[1:4]) or any(n < 0 for m in maps for n in s[m].values()):
        raise ValueError("unknown or negative counts in a coverage record")
    again = verdict(s["skips_by_reason"], s["non_budgetable_gaps_by_code"], s["skip_unit"], s["allowances_by_reason"])
    if again["status"] != s["status"] or any({k: v for k, v in again[m].items() if v} != {k: v for k, v in s[m].items() if v} for m in maps):
        raise ValueError("a coverage record that contradicts itself")


def file_counts(skips: DataFrame) -> DataFrame:
    """(reason, files, folders): a folder counts for the files below it."""
    own = skips.where("not legacy_excluded")
    return own.groupBy("reason").agg(F.sum(F.when(F.col("is_dir"), F.col("represented")).otherwise(1)).cast("long").alias("files"), F.sum(F.col("is_dir").cast("long")).alias("folders"))

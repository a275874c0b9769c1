"""The packed defect column `SEV:ID;SEV:ID`.

Two dialects exist and give different results, so both are kept and named:
* strict: any white space is stripped, severity is upper-cased, the id is all text
  after the first colon and must be an integer;
* loose: only spaces are trimmed, severity is case-sensitive, the id is the second
  colon-separated field.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inspectrum.functions.text import INT_PATTERN, strip, to_int

# Minor, significant, dangerous.
SEVERITIES = ["VO", "OV", "EOV"]


def strict_entries(c: Column) -> Column:
    """Non-empty stripped entries; an empty array for NULL."""
    parts = F.transform(F.split(c, r"[;,\r\n]+"), strip)
    return F.coalesce(F.filter(parts, lambda e: e != ""), F.array().cast("array<string>"))


def strict_severity(entry: Column) -> Column:
    return F.upper(strip(F.substring_index(entry, ":", 1)))


def strict_id(entry: Column) -> Column:
    """Integer after the first colon, NULL when there is none."""
    return to_int(strip(F.substr(entry, F.instr(entry, ":") + F.lit(1))), "bigint")


def entry_class(has_colon: Column, severity: Column, defect_id: Column) -> Column:
    """`parsed`, `unknown` (severity) or `malformed`, tested in the documented order."""
    return (
        F.when(~has_colon, "malformed")
        .when(~severity.isin(SEVERITIES), "unknown")
        .when(defect_id.isNull(), "malformed")
        .otherwise("parsed")
    )


def has_colon(entry: Column) -> Column:
    return F.contains(entry, F.lit(":"))


def parse_strict(c: Column) -> Column:
    """Array of (severity, defect_id) in text order; each entry is read once."""
    pairs = F.transform(
        F.filter(strict_entries(c), has_colon),
        lambda e: F.struct(strict_severity(e).alias("severity"), strict_id(e).alias("defect_id")),
    )
    return F.filter(pairs, lambda d: d["severity"].isin(SEVERITIES) & d["defect_id"].isNotNull())


def count_severity(parsed: Column, severity: str) -> Column:
    return F.size(F.filter(parsed, lambda d: d["severity"] == severity))


def defect_ids(parsed: Column) -> Column:
    return F.transform(parsed, lambda d: d["defect_id"])


def normalize_delimiters(c: Column) -> Column:
    return F.regexp_replace(c, r"[;\r\n]", ",")


def loose_entries(c: Column) -> Column:
    """Array of (severity, rike_id) strings; blank entries dropped, nothing validated."""
    parts = F.filter(F.split(normalize_delimiters(c), ","), lambda e: F.trim(e) != "")
    return F.transform(
        parts,
        lambda e: F.struct(
            loose_field(e, 1).alias("severity"),
            loose_field(e, 2).alias("rike_id"),
        ),
    )


def loose_field(entry: Column, n: int) -> Column:
    return F.trim(F.split_part(F.trim(entry), F.lit(":"), F.lit(n)))


def is_loose_defect(entry: Column) -> Column:
    """Known severity and a 32-bit integer id."""
    rike_id = entry["rike_id"]
    return (
        entry["severity"].isin(SEVERITIES)
        & rike_id.rlike(INT_PATTERN)
        & rike_id.try_cast("int").isNotNull()
    )


def loose_defects(c: Column) -> Column:
    """Entries that count as defects in the reports."""
    return F.filter(loose_entries(c), is_loose_defect)


def has_severity(entries: Column, severity: str) -> Column:
    """1 when any loose entry has the severity; ids are not looked at."""
    return F.when(F.exists(entries, lambda e: e["severity"] == severity), 1).otherwise(0)

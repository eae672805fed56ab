"""Value bands, amounts and severities. A band keeps both ends; an open end is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import NO_HEADER_CEILING, PTR_BANDS, SENATE_UNBOUNDED, TEXT_FALLBACK_CEILING


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("decimal(15,2)")


def band(text: Column) -> Column:
    """struct(low, high) of a printed band: a known label first, else the numbers that occur.

    One number alone is exact unless the text says over, above, more than or plus.
    """
    t = F.lower(F.coalesce(text, F.lit("")))
    found = F.filter(F.transform(F.regexp_extract_all(t, F.lit(r"\$?([\d,]+)"), 1), _number), lambda x: x.isNotNull())
    open_top = t.rlike(r"\b(over|above|more than)\b") | t.contains("+")
    low = high = None
    for label, a, b in PTR_BANDS:
        hit = t.contains(label.lower())
        end = F.lit(b).cast("decimal(15,2)")
        low = F.when(hit, F.lit(a).cast("decimal(15,2)")) if low is None else low.when(hit, F.lit(a).cast("decimal(15,2)"))
        high = F.when(hit, end) if high is None else high.when(hit, end)
    low = low.otherwise(F.array_min(found))
    high = high.otherwise(F.when((F.size(found) == 1) & open_top, F.lit(None)).otherwise(F.array_max(found)))
    return F.struct(low.alias("low"), high.alias("high"))


def annual_band(text: Column) -> Column:
    """struct(low, high) on an annual report: a printed band, else the amounts that occur, with their decimals."""
    t = F.lower(F.coalesce(text, F.lit("")))
    found = F.filter(F.transform(F.regexp_extract_all(t, F.lit(r"\$?\s*([\d,]+(?:\.\d{1,2})?)"), 1), _number), lambda x: x.isNotNull())
    low, high = F.array_min(found), F.array_max(found)
    for label, a, b in reversed([("$1 - $1,000", 1, 1000), *(x for x in PTR_BANDS if x[0] != "Over $1,000,000")]):
        hit = t.contains(label.lower())
        low, high = (F.when(hit, F.lit(end).cast("decimal(15,2)")).otherwise(old) for end, old in ((a, low), (b, high)))
    return F.struct(low.alias("low"), high.alias("high"))


def _ends(text: Column) -> tuple[Column, Column, Column, Column]:
    """Of an amount without signs: whether it is a range, the text of both ends, and that of the whole."""
    t = F.trim(F.translate(F.coalesce(text, F.lit("")), "$,", ""))
    parts = F.split(t, "-", -1)
    return t.contains("-"), F.trim(F.get(parts, 0)), F.trim(F.coalesce(F.get(parts, 1), F.lit(""))), t


def xml_band(text: Column) -> Column:
    """struct(low, high) of "a - b" or one amount in a report's XML; an empty end is null, and so is all that cannot be read."""
    is_range, a, b, t = _ends(text)
    kind = "decimal(15,2)"
    bad = is_range & (((a != "") & a.try_cast(kind).isNull()) | ((b != "") & b.try_cast(kind).isNull()))
    low = F.when(~bad, F.when(is_range, a.try_cast(kind)).otherwise(t.try_cast(kind)))
    high = F.when(~bad, F.when(is_range, b.try_cast(kind)).otherwise(t.try_cast(kind)))
    return F.struct(low.alias("low"), high.alias("high"))


def xml_income(text: Column) -> Column:
    """An amount, or the mean of a range whose empty ends are zero."""
    is_range, a, b, t = _ends(text)
    end = lambda x: F.when(x == "", F.lit(0).cast("decimal(15,2)")).otherwise(x.try_cast("decimal(15,2)"))
    return F.when(is_range, (end(a) + end(b)) / 2).otherwise(t.try_cast("decimal(15,2)")).cast("decimal(15,2)")


def senate_band(text: Column) -> Column:
    """struct(low, high) of the other chamber's labels; unknown text has neither."""
    t = F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))
    less = _number(F.nullif(F.regexp_extract(t, r"none\s*\(or less than\s*\$?([\d,]+)\s*\)", 1), F.lit("")))
    pair = r"\$\s*([\d,]+(?:\.\d{1,2})?)\s*-\s*\$\s*([\d,]+(?:\.\d{1,2})?)"
    a, b = (_number(F.nullif(F.regexp_extract(t, pair, k), F.lit(""))) for k in (1, 2))
    over = _number(F.nullif(F.regexp_extract(t, r"^over\s*\$?([\d,]+)", 1), F.lit("")))
    kind = "decimal(15,2)"
    low = F.when(t == SENATE_UNBOUNDED, F.lit(1000001).cast(kind)).when(less.isNotNull(), F.lit(0).cast(kind)).when(a.isNotNull(), a).when(over.isNotNull(), (over + 1).cast(kind))
    high = F.when(t == SENATE_UNBOUNDED, F.lit(None).cast(kind)).when(less.isNotNull(), (less - 1).cast(kind)).when(a.isNotNull(), b)
    return F.struct(low.alias("low"), high.alias("high"))


def band_of(amount: Column) -> Column:
    """struct(low, high): the printed band that an exact amount falls in; below the first, zero to its start."""
    bands = sorted((b for b in PTR_BANDS if b[0] != "Over $1,000,000"), key=lambda b: b[1])
    low = F.when(amount < bands[0][1], F.lit(0))
    high = F.when(amount < bands[0][1], F.lit(bands[0][1] - 1))
    for k, (_, a, b) in enumerate(bands):
        inside = (amount < bands[k + 1][1]) if k + 1 < len(bands) else F.lit(True)
        low, high = low.when(inside, F.lit(a)), high.when(inside, F.lit(b))
    return F.struct(low.cast("decimal(15,2)").alias("low"), high.cast("decimal(15,2)").alias("high"))


def amount_of(low: Column, high: Column) -> Column:
    """Midpoint of a band, else the end it has, else zero."""
    return F.coalesce((low + high) / 2, high, low, F.lit(0))


def severity_label(value: Column) -> Column:
    """low, medium or high from a label or a score; what cannot be read is medium."""
    t = F.lower(F.trim(value.cast("string")))
    n = t.try_cast("double")
    return F.when(t.isin("low", "medium", "high"), t).when(t == "critical", "high").when(n >= 8, "high").when(n >= 5, "medium").when(n < 5, "low").otherwise("medium")


def proximity(days: Column, close: int = 14, near: int = 30) -> Column:
    return F.when(days <= close, "HIGH").when(days <= near, "MEDIUM").otherwise("LOW")


def wealth_severity(growth: Column, salary: Column) -> Column:
    ratio = F.when(salary > 0, growth / salary).otherwise(0)
    return F.when(ratio > 5, "CRITICAL").when(ratio > 3, "HIGH").when(ratio > 1.5, "MEDIUM").otherwise("LOW")


def deviation_severity(actual: Column, expected: Column) -> Column:
    d = actual - expected
    return F.when(d > 500, "high").when(d > 200, "medium").otherwise("low")


def ptr_confidence(has_text: Column, detected: Column, parsed: Column, rows: Column, fields: Column, expected: Column, fallback: Column, headers: Column) -> Column:
    """How much of a periodic report was read: rows times fields, under the ceilings of weaker paths."""
    row_ratio = F.when(F.coalesce(detected, F.lit(0)) > 0, parsed / detected).otherwise(1.0)
    field_ratio = F.when(F.coalesce(expected, F.lit(0)) > 0, fields / expected).otherwise(0.0)
    c = row_ratio * field_ratio
    c = F.when(F.coalesce(fallback, F.lit(False)), F.least(c, F.lit(TEXT_FALLBACK_CEILING))).otherwise(c)
    c = F.when(~F.coalesce(headers, F.lit(True)), F.least(c, F.lit(NO_HEADER_CEILING))).otherwise(c)
    c = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 4)
    return F.when(F.coalesce(has_text, F.lit(False)) & (F.coalesce(rows, F.lit(0)) > 0), c).otherwise(0.0)


def annual_confidence(has_text: Column, assets: Column, liabilities: Column, errors: Column, detected: Column, says_none: Column) -> Column:
    """Share of the holdings counted in the text that were stored."""
    none = (assets == 0) & (liabilities == 0)
    share = F.when(F.coalesce(detected, F.lit(0)) > 0, F.bround(F.least(assets / detected, F.lit(1.0)), 4)).otherwise(1.0)
    return F.when(~F.coalesce(has_text, F.lit(False)), 0.0).when(none & says_none & (errors == 0), 1.0).when(none | (errors > 0), 0.0).otherwise(share)

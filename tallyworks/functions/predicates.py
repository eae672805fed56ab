"""Predicates that decide which rows an operator counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import DEBT_WORDING, NO_SCHEDULE, VAGUE_WORDS, TRAVEL_FILINGS


def owner_or_self(owner: Column) -> Column:
    """The owner as filed; a blank or missing one is the filer."""
    return F.coalesce(F.nullif(F.trim(owner), F.lit("")), F.lit("Self"))


def held_by_member(owner: Column) -> Column:
    """Own and joint holdings; unknown owners do not count."""
    return owner_or_self(owner).isin("Self", "Joint")


def not_withdrawn(status: Column) -> Column:
    return ~status.eqNullSafe(F.lit("Deleted"))


def not_amended(status: Column) -> Column:
    return ~status.eqNullSafe(F.lit("Amended"))


def counted_award(awarded_on: Column, amount: Column) -> Column:
    """A dated award action that adds money, or whose amount is unknown."""
    return awarded_on.isNotNull() & (amount.isNull() | (amount > 0))


def net_worth_snapshot(is_ptr: Column, filing_type: Column) -> Column:
    """An annual filing that states holdings: no periodic report, no candidate report."""
    kind = F.lower(F.trim(F.coalesce(filing_type, F.lit(""))))
    return ~is_ptr & (kind != "c") & ~kind.startswith("candidate report")


def survives_fdr(q_value: Column, alpha: float) -> Column:
    """Not tested, or tested and below ``alpha``."""
    return q_value.isNull() | (q_value <= alpha)


def name_contains(search: str, *names: Column) -> Column:
    """Case-blind substring of any of the names; ``%``, ``_`` and ``\\`` of the search stand for themselves."""
    pattern = "%" + search.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    out = names[0].ilike(pattern)
    for name in names[1:]:
        out = out | name.ilike(pattern)
    return out


def same_text(column: Column, value: str) -> Column:
    return F.lower(column) == value.strip().lower()


def no_district(district: Column) -> Column:
    return district.isNull() | (district == "-1")


def is_vague(description: Column) -> Column:
    """Nothing, under three characters, or nothing left once vague words and punctuation go."""
    text = F.trim(F.coalesce(description, F.lit("")))
    left = F.regexp_replace(text, r"(?i)\b(" + "|".join(VAGUE_WORDS) + r")\b", "")
    return (F.length(text) < 3) | (F.regexp_replace(left, r"^[ .,\-—/]+|[ .,\-—/]+$", "") == "")


def class_code(description: Column) -> Column:
    """The last bracketed two-letter code, or null."""
    codes = F.regexp_extract_all(F.coalesce(description, F.lit("")), F.lit(r"\[([A-Z]{2})\]"), 1)
    return F.try_element_at(codes, F.lit(-1))


def is_fixed_income(description: Column) -> Column:
    """The printed code decides; wording counts only where there is none."""
    code = class_code(description)
    return F.when(code.isNotNull(), code == "GS").otherwise(F.coalesce(description, F.lit("")).rlike(DEBT_WORDING))


def is_option(description: Column) -> Column:
    return class_code(description).eqNullSafe(F.lit("OP"))


def no_schedule(filing_type: Column) -> Column:
    return F.coalesce(F.upper(F.trim(filing_type)).isin(*NO_SCHEDULE), F.lit(False))


def may_have_travel(filing_type: Column, chamber: Column, parsed: Column, is_ptr: Column) -> Column:
    """Parsed annual House filings of the types that carry a travel schedule."""
    return F.coalesce(F.upper(F.trim(filing_type)).isin(TRAVEL_FILINGS) & (F.lower(chamber) == "house") & parsed & ~is_ptr, F.lit(False))


def needs_parse(parsed: Column, error: Column, confidence: Column, has_text: Column, below: float | None = None, failed_only: bool = False, electronic: Column | None = None) -> Column:
    """Queue of filings to parse: failed ones, weak ones (known scans aside), or all without a parse.

    ``electronic`` marks filings that were never on paper: for them a missing text layer is no
    scan, so they stay in the queue of weak ones.
    """
    if failed_only:
        return error.isNotNull()
    if below is not None:
        scan = has_text.eqNullSafe(F.lit(False))
        scan = scan if electronic is None else scan & ~F.coalesce(electronic, F.lit(False))
        return (confidence.isNull() | (confidence < below)) & ~scan
    return ~F.coalesce(parsed, F.lit(False))

"""Titles and sentences of findings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import DEADLINE_DAYS
from .predicates import is_option

NAME_LENGTH = 60


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def asset_name(ticker: Column, description: Column, limit: int = NAME_LENGTH) -> Column:
    """The ticker, else the description in one line without its class tag, cut between words."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(description, F.lit("")), r"\[[A-Z0-9]{2}\]", " "), r"\s+", " "))
    head = F.substring(plain, 1, limit)
    words = F.regexp_replace(F.regexp_replace(head, r"^(.*) [^ ]*$", "$1"), r"[ ,;:\-]+$", "")
    short = F.when(plain == "", "unknown").when(F.length(plain) <= limit, plain).otherwise(F.concat(F.when(words == "", head).otherwise(words), F.lit("...")))
    return F.coalesce(F.nullif(ticker, F.lit("")), short)


def percent(value: Column) -> Column:
    """A share, with one decimal only where there is one."""
    return F.when(F.abs(value - F.bround(value, 0)) < 0.05, F.format_string("%.0f%%", value)).otherwise(F.format_string("%.1f%%", value))


def days(n: Column) -> Column:
    return F.when(n == 1, "1 day").otherwise(F.concat(n.cast("string"), F.lit(" days")))


def whose(owner: Column) -> Column:
    return F.when(owner == "Spouse", "their spouse").when(owner == "Dependent Child", "a dependent child")


# Titles and sentences as they are published; a finding's identity depends on its title.


def late_range(past: Column) -> Column:
    return F.when(past <= 30, "moderately late (1-4 weeks)").when(past <= 90, "significantly late (1-3 months)").otherwise("severely late (over 3 months)")


def whose_trade(owner: Column) -> Column:
    said = _text(", which the filing reports for ", whose(owner), ". The STOCK Act deadline is the member's for every transaction their household must report, so this row is scored against them")
    return F.coalesce(said, F.lit(""))


def told_clause(told: Column, traded: Column, filed: Column, cap: int = DEADLINE_DAYS) -> Column:
    """What the form says of when the filer was notified; it explains a delay and moves no deadline."""
    lag = F.datediff(told, traded)
    day = F.date_format(told, "yyyy-MM-dd")
    early = _text(" The form gives a notification date of ", day, ", before the transaction it reports; nothing is inferred from it here.")
    over = _text(", ", lag, f" days after the trade -- itself past the {cap}-day cap, so no filing could have met the deadline")
    then = F.when(lag > cap, over).otherwise(F.coalesce(_text(", and filed ", F.datediff(filed, told), " days after that"), F.lit("")))
    end = f". The deadline runs from the transaction regardless: the statute allows 30 days from notification but in no case more than {cap} days from the trade."
    said = F.when(lag < 0, early).otherwise(_text(" The filer reports being notified of it on ", day, then, end))
    return F.coalesce(said, F.lit(""))


def late_filing_text(traded: Column, filed: Column, direction: Column, name: Column, owner: Column, told: Column) -> tuple[Column, Column]:
    late = late_range(F.datediff(filed, traded) - DEADLINE_DAYS)
    show = lambda c: F.date_format(c, "yyyy-MM-dd")
    said = _text("Transaction on ", show(traded), " was filed ", late, " on ", show(filed), f". The STOCK Act requires filing within {DEADLINE_DAYS} days. Trade reported: ", direction, " of ", name, whose_trade(owner), ".", told_clause(told, traded, filed))
    return _text("Late PTR filing: ", late), said


def large_trade_text(ticker: Column, asset: Column, direction: Column) -> tuple[Column, Column]:
    noun = F.concat(asset_name(ticker, asset), F.when(is_option(asset), " options").otherwise(""))
    option = " The form marks this row `[OP]`, so the asset named is the underlying and the trade is in options on it. The amount is the value the filing reports for the transaction, not the value of the underlying shares."
    said = _text("A ", direction, " of ", noun, " worth more than $1,000,000 was reported.", F.when(is_option(asset), option).otherwise(""), " Large transactions warrant additional scrutiny.")
    return _text("Large transaction: ", noun, " ", direction, " (more than $1,000,000)"), said


def day_spread(first: Column, days_: Column) -> Column:
    """How a month's trades lie; one date is a batch."""
    one = _text(" All of them are dated ", F.date_format(first, "d MMMM yyyy"), "; a PTR records a date but no time of day, so this is one day's batch rather than trading spread through the month.")
    return F.when(days_ == 1, one).when(days_ > 1, _text(" They fall on ", days_, " days of trading.")).otherwise("")


def excluded_clause(n: Column, spouse: Column, child: Column, lead: str) -> Column:
    """What a count leaves out, so that it can be held against the filing."""
    who = F.when((spouse > 0) & (child > 0), "their spouse and a dependent child").when(spouse > 0, "their spouse").when(child > 0, "a dependent child").otherwise("someone other than the member")
    return F.when(n > 0, _text(f" {lead} ", n, " transaction(s) belonging to ", who, ", which this count excludes.")).otherwise("")


def frequency_text(count: Column, month: Column, first: Column, days_: Column, household: Column, spouse: Column, child: Column, least: int) -> tuple[Column, Column]:
    name = F.date_format(F.to_date(F.concat(month, F.lit("-01"))), "MMMM yyyy")
    said = _text(count, " transactions were attributed to this member in ", name, f", above the threshold of {least} per month.", day_spread(first, days_), excluded_clause(household, spouse, child, "The filings covering that month also report"))
    return _text("High trading activity: ", count, " trades in ", name), said


def frequency_severity(count: Column, least: int) -> Column:
    return F.least(F.lit(10), count - least + 4).cast("int")


def cluster_title(members: Column, direction: Column, ticker: Column, span: Column) -> Column:
    verb = F.when(direction == "purchase", "bought").otherwise("sold")
    return _text(members, " members ", verb, " ", ticker, " within ", days(F.greatest(span, F.lit(1))))


def growth_wording(growth_percent: Column, growth: Column) -> tuple[Column, Column]:
    """The bands that growth is told in, by percent and by amount."""
    share = F.when(growth_percent < 100, "significantly").when(growth_percent < 200, "substantially (100-200%)").when(growth_percent < 500, "dramatically (200-500%)").otherwise("extremely (over 500%)")
    amount = F.when(growth < 100_000, "tens of thousands of dollars").when(growth < 500_000, "$100,000-$500,000").when(growth < 1_000_000, "$500,000-$1,000,000").when(growth < 5_000_000, "$1-$5 million").otherwise("more than $5 million")
    return share, amount


def plain_title(kind: Column) -> Column:
    """The title of a finding that came without one: its type in words."""
    return F.initcap(F.replace(kind, F.lit("_"), F.lit(" ")))

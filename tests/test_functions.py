"""Column functions on single values."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyworks.functions import dates, money, predicates, text


def value(spark, function, *args, kind="string"):
    names = [f"c{k}" for k in range(len(args))]
    row = spark.createDataFrame([args], ", ".join(f"{n} {kind}" for n in names))
    return row.select(function(*[F.col(n) for n in names]).alias("v")).first().v


@pytest.mark.parametrize("shown,want", [
    ("Apple Inc. (AAPL) [ST]", "AAPL"), ("Boeing (BA)", "BA"), ("Ternium Depositary Shares (TX) [ST]", None), ("Onsolve LLC Shares [PS]", None),
    ("MSFT - Microsoft", "MSFT"), ("Fund [ETF] common XYZ", "XYZ"), ("nothing", None), (None, None), ("", None),
])
def test_ticker(spark, shown, want):
    assert value(spark, text.ticker_in, shown) == want


@pytest.mark.parametrize("cell,want", [("P", "purchase"), ("S (partial)", "sale"), ("E", "exchange"), ("Sale (Full)", "sale"), ("Purchase", "purchase"), ("", None), (None, None), ("gift", None)])
def test_direction(spark, cell, want):
    assert value(spark, text.direction, cell) == want


@pytest.mark.parametrize("shown,low,high", [
    ("$1,001 - $15,000", 1001, 15000), ("over $50,000,000", 50000001, None), ("$7 - $3", 3, 7), ("$500", 500, 500), ("Over $500", 500, None), ("$500 +", 500, None), ("none", None, None), (None, None, None),
])
def test_band(spark, shown, low, high):
    got = value(spark, money.band, shown)
    assert (got.low, got.high) == (None if low is None else Decimal(low), None if high is None else Decimal(high))


@pytest.mark.parametrize("shown,low,high", [
    ("$1,001 - $15,000", 1001, 15000), ("None (or less than $1,001)", 0, 1000), ("Over $50,000,000", 50000001, None),
    ("Over $1,000,000 and held independently by spouse or dependent child", 1000001, None), ("--", None, None), (None, None, None),
])
def test_senate_band(spark, shown, low, high):
    got = value(spark, money.senate_band, shown)
    assert (got.low, got.high) == (None if low is None else Decimal(low), None if high is None else Decimal(high))


def test_amount_and_band_of(spark):
    assert value(spark, money.amount_of, Decimal(1), Decimal(4), kind="decimal(15,2)") == Decimal("2.5")
    assert value(spark, money.amount_of, None, Decimal(4), kind="decimal(15,2)") == 4
    assert value(spark, money.amount_of, None, None, kind="decimal(15,2)") == 0
    got = [value(spark, money.band_of, x, kind="double") for x in (500.0, 1001.0, 60_000_000.0)]
    assert [(g.low, g.high) for g in got] == [(0, 1000), (1001, 15000), (50000001, None)]


@pytest.mark.parametrize("shown,want", [("8", "high"), ("5", "medium"), ("4.9", "low"), ("CRITICAL", "high"), (" Low", "low"), ("odd", "medium"), (None, "medium")])
def test_severity(spark, shown, want):
    assert value(spark, money.severity_label, shown) == want


@pytest.mark.parametrize("shown,want", [
    ("1/2/2024", date(2024, 1, 2)), ("01/02/24", date(2024, 1, 2)), ("2024-02-30", None), ("2024-02-29", date(2024, 2, 29)), ("2-1-2024", date(2024, 2, 1)), ("junk", None), ("", None), (None, None),
])
def test_dates(spark, shown, want):
    assert value(spark, dates.parse_date, shown) == want


def test_more_dates(spark):
    assert value(spark, dates.iso_date, "2024-01-02T05:00:00Z") == date(2024, 1, 2)
    assert value(spark, dates.ordinal_day, date(1, 1, 1), kind="date") == 1
    assert value(spark, dates.ordinal_day, date(2024, 1, 1), kind="date") == date(2024, 1, 1).toordinal()
    assert value(spark, dates.not_after, date(2025, 1, 1), date(2024, 1, 1), kind="date") == date(2024, 1, 1)
    assert value(spark, dates.transaction_day, date(2030, 1, 1), None, date(2024, 1, 1), date(2025, 1, 1), kind="date") == date(2024, 1, 1)


def test_names(spark):
    assert value(spark, text.fold_name, "  LUJÁN Ñø ß") == "lujan nø ss"
    assert value(spark, text.surname_keys, "McClain Delaney") == ["mcclain delaney", "delaney"]
    assert value(spark, text.plain_surname, "McConnell, Jr.") == "McConnell"
    assert value(spark, text.plain_surname, "Jr") == "Jr"
    assert value(spark, text.given_name, 'Charles J. "Chuck" Dr') == "Charles J."
    assert value(spark, text.given_names_agree, "Rohit", "Ro") and value(spark, text.given_names_agree, "C.", "C. Scott")
    assert not value(spark, text.given_names_agree, "April", "John") and not value(spark, text.given_names_agree, "", "John")
    assert value(spark, text.company_key, "NORTHROP GRUMMAN CORP /DE/") == "northrop grumman"
    assert value(spark, lambda c: text.company_key(c, True), "AFLAC POLITICAL ACTION COMMITTEE (AFLAC PAC)") == "aflac"
    assert value(spark, text.asset_key, "Apple Inc. - Common Stock, Class A") == "apple"


def test_codes(spark):
    assert value(spark, text.committee_code, "hswm00") == "HSWM" and value(spark, text.committee_code, "hsba16") == "HSBA16" and value(spark, text.committee_code, " ") is None
    assert value(spark, text.award_key, "A1", None, "2024-01-02T00", "5.0") == "A1||2024-01-02|5.0" and value(spark, text.award_key, " ", "1", "2", "3") is None
    assert value(spark, text.client_names, "Big LLP (on behalf of Acme Corp)") == ["Big LLP (on behalf of Acme Corp)", "Acme Corp"]
    assert value(spark, text.owner_in, "SP Apple") == "Spouse" and value(spark, text.owner_in, "SPDR") is None and value(spark, text.without_owner, "JT: Apple") == "Apple"
    assert value(spark, text.filing_status, "x\nF S: Amended") == "Amended" and value(spark, text.filing_status, "none") is None
    assert value(spark, text.comment, " n/a ") is None and value(spark, text.comment, "kept ") == "kept"
    assert value(spark, text.party_letter, "Democratic") == "D" and value(spark, text.party_letter, None) == "O"
    assert value(spark, text.asset_type, "Treasury note") == "bond" and value(spark, text.owner_name, None) == "Self"


def test_predicates(spark):
    assert value(spark, predicates.held_by_member, None) and value(spark, predicates.held_by_member, " ") and not value(spark, predicates.held_by_member, "Trust")
    assert value(spark, predicates.is_vague, "Various") and value(spark, predicates.is_vague, None) and not value(spark, predicates.is_vague, "Various Industries Inc")
    assert value(spark, predicates.is_fixed_income, "US Treasury Bill [GS]") and not value(spark, predicates.is_fixed_income, "Bond ETF [ST]") and value(spark, predicates.is_fixed_income, "a bond")
    assert value(spark, predicates.is_option, "Microsoft (MSFT) [OP]") and not value(spark, predicates.is_option, "Call")
    assert value(spark, predicates.not_withdrawn, None) and not value(spark, predicates.not_withdrawn, "Deleted")
    assert value(spark, lambda c: predicates.name_contains("a%", c), "xa%y") and not value(spark, lambda c: predicates.name_contains("a%", c), "xab")


def test_confidence(spark):
    def c(*args):
        cols = [F.lit(a) for a in args]
        return spark.range(1).select(money.ptr_confidence(*cols).alias("v")).first().v

    assert c(True, 10, 5, 5, 15, 15, False, True) == 0.5
    assert c(True, 10, 10, 10, 30, 30, True, True) == 0.7 and c(True, 0, 0, 10, 30, 30, False, False) == 0.5
    assert c(False, 10, 10, 10, 30, 30, False, True) == 0.0 and c(True, 10, 0, 0, 0, 0, False, True) == 0.0


@pytest.mark.parametrize("shown,want", [("$209,630.10", ("209630.10", "209630.10")), ("$16,508.00", ("16508.00", "16508.00")), ("$15,001 - $50,000", ("15001", "50000")), ("Over $50,000,000", ("50000001", None)), ("$1 - $1,000", ("1", "1000")), ("5 to 9.5", ("5", "9.5")), (None, (None, None)), ("none", (None, None))])
def test_annual_band(spark, shown, want):
    got = value(spark, money.annual_band, shown)
    assert (got.low, got.high) == tuple(x and Decimal(x) for x in want)


@pytest.mark.parametrize("shown,band,income", [("$100,001 - $250,000", (100001, 250000), 175000.5), ("5", (5, 5), 5), ("5 -", (5, None), 2.5), ("x - 5", (None, None), None), ("", (None, None), None), (None, (None, None), None)])
def test_amounts_in_xml(spark, shown, band, income):
    got = value(spark, money.xml_band, shown)
    assert (got.low, got.high) == band and value(spark, money.xml_income, shown) == (None if income is None else Decimal(str(income)))


@pytest.mark.parametrize("shown,want", [("Lazard Shs (LISIX) [MF]", "LISIX"), ("Fifth-Third Bank [BA]", None), ("Microsoft [MSFT] stock", "MSFT"), ("i shares tr gbl msci [CS]", None), ("ACME Equity XYZ", "ACME"), ("THE US stock", None), (None, None)])
def test_annual_ticker(spark, shown, want):
    assert value(spark, text.annual_ticker_in, shown) == want


def test_asset_types_differ_by_source(spark):
    assert [value(spark, f, "Home cash fund") for f in (text.annual_asset_type, text.xml_asset_type, text.asset_type)] == ["other", "mutual_fund", "mutual_fund"]
    assert value(spark, text.senate_asset_type, "Corporate  Securities Stock") == "stock" and value(spark, text.senate_asset_type, "Exchange Traded Fund/Note") == "mutual_fund"
    assert [value(spark, text.annual_direction, x) for x in ("Buy", "sold", "Exchanged", "gift", None)] == ["purchase", "sale", "exchange", None, None]


@pytest.mark.parametrize("lines,want", [
    (["P 1/2/2024 $15,001 -", "Common Stock (ACI) [ST] $50,000", "next"], ["P 1/2/2024 $15,001 - $50,000 Common Stock (ACI) [ST]", "next"]),
    (["$1,001 -  ", "[ST] $15,000"], ["$1,001 - $15,000"]), (["Over", "$50,000,000 more"], ["Over $50,000,000 more"]), (["a", "$5 -"], ["a", "$5 -"]), (["$5 -", "no figure"], ["$5 - no figure"]), ([], []),
])
def test_wrapped_amounts(spark, lines, want):
    row = spark.createDataFrame([(lines,)], "x array<string>")
    assert row.select(text.rejoin_wrapped(F.col("x"))).first()[0] == want

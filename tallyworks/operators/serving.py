"""Read queries: filtered, sorted and paged listings, histograms, insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import severity_label
from ..functions.predicates import name_contains, same_text, survives_fdr
from .scores import late_rate


def page(rows: DataFrame, order: list[Column | str], size: int, number: int = 1) -> DataFrame:
    """One page of a total order, with the number of all rows; ``order`` must end in a unique key."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(size * (number - 1)).limit(size).crossJoin(F.broadcast(total))


def members_page(members: DataFrame, findings: DataFrame, search: str | None = None, party: str | None = None, flagged: bool = False, sort: str = "last_name", descending: bool = False, size: int = 50, number: int = 1) -> DataFrame:
    rows = members
    if search:
        rows = rows.where(name_contains(search, F.col("first_name"), F.col("last_name")))
    if party:
        rows = rows.where(same_text(F.col("party"), party))
    if flagged:
        rows = rows.join(findings.select("member_id").distinct(), "member_id", "left_semi")
    first = F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort)
    return page(rows, [first, F.asc("member_id")], size, number)


#: Columns that a listing of members may be sorted by; names come after all of them.
MEMBER_SORTS = {"name": [], "party": ["party"], "state": ["state"], "chamber": ["chamber"], "district": ["district"], "status": ["in_office"], "anomalies": ["anomaly_count"], "disclosures": ["disclosure_count"]}


def member_order(by: str = "name", descending: bool = False) -> list[Column]:
    """The total order of a listing: the column asked for, either way, then names and ids; an unknown column is the name.

    Names themselves turn with the direction only where they are what is sorted by. Missing
    values are the largest.
    """
    turned = F.desc_nulls_first if descending else F.asc_nulls_last
    names, first = ["first_name", "last_name"], MEMBER_SORTS.get(by, [])
    rest = [F.asc_nulls_last(c) for c in names] if first else [turned(c) for c in names]
    return [*map(turned, first), *rest, F.asc("member_id")]


def findings_page(findings: DataFrame, members: DataFrame, filings: DataFrame, alpha: float | None = 0.05, kind: str | None = None, size: int = 50, number: int = 1) -> DataFrame:
    """Findings with member and, if any, filing: worst severity first, then newest, then highest id."""
    rows = findings.join(members, "member_id").join(filings.select("filing_id", "filing_type"), "filing_id", "left")
    if alpha is not None:
        rows = rows.where(survives_fdr(F.col("q_value"), alpha))
    if kind:
        rows = rows.where(F.col("anomaly_type") == kind)
    label = severity_label(F.col("severity"))
    rank = F.when(label == "high", 0).when(label == "medium", 1).otherwise(2)
    return page(rows, [rank, F.desc("detected_at"), F.desc("finding_id")], size, number)


def filings_page(filings: DataFrame, counts: dict[str, DataFrame], kind: str | None = None, sort: str = "filed_on", size: int = 50, number: int = 1) -> DataFrame:
    """Filings with their numbers of rows in each of ``counts`` (0 where none)."""
    rows = filings if kind is None else filings.where(same_text(F.col("filing_type"), kind))
    for name, table in counts.items():
        rows = rows.join(table.groupBy("filing_id").agg(F.count("*").alias(name)), "filing_id", "left")
    return page(rows.na.fill(0, list(counts)), [F.desc_nulls_last(sort), F.desc("filing_id")], size, number)


def filing_type_histogram(filings: DataFrame) -> DataFrame:
    return filings.groupBy("filing_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "filing_type")


def net_worth_history(filings: DataFrame, assets: DataFrame, liabilities: DataFrame) -> DataFrame:
    """Per filing the sums of bounds, nulls as 0; a page of it has its own order."""
    a = assets.groupBy("filing_id").agg(F.sum("value_min").alias("assets_min"), F.sum("value_max").alias("assets_max"))
    d = liabilities.groupBy("filing_id").agg(F.sum("amount_min").alias("debts_min"), F.sum("amount_max").alias("debts_max"))
    names = ["assets_min", "assets_max", "debts_min", "debts_max"]
    out = filings.join(a, "filing_id", "left").join(d, "filing_id", "left").na.fill(0, names)
    return out.select("member_id", "filing_id", "filed_on", *names)


def filing_totals(filings: DataFrame, trades: DataFrame) -> DataFrame:
    """Per filing its rows and the sums of the bounds that are known."""
    t = trades.groupBy("filing_id").agg(F.count("*").alias("rows"), F.sum("amount_min").alias("low"), F.sum("amount_max").alias("high"))
    return filings.join(t, "filing_id", "left").select("filing_id", "filing_type", F.coalesce("rows", F.lit(0)).alias("rows"), "low", "high")


def recent_findings(findings: DataFrame, each: int = 5) -> DataFrame:
    """The newest findings of each member."""
    w = Window.partitionBy("member_id").orderBy(F.desc("detected_at"), F.desc("finding_id"))
    return findings.withColumn("place", F.row_number().over(w)).where(F.col("place") <= each)


def insights(trades: DataFrame, findings: DataFrame, filings: DataFrame, reported: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row of headline numbers.

    Filings that were not read yet, that are scans without a text layer, and that were read
    and gave nothing are three things. The largest band has both its ends, an open one the
    lower alone. ``reported`` are the trades that the late rate is of.
    """
    low, high = F.col("amount_min"), F.col("amount_max")
    largest = F.max(F.struct(F.coalesce(high, low).alias("by"), low.alias("low"), high.alias("high")))
    t = trades.agg(F.count("*").alias("trades"), F.countDistinct("member_id").alias("traders"), largest.alias("top")).select("trades", "traders", F.col("top.low").alias("largest_low"), F.col("top.high").alias("largest_high"))
    f = findings.agg(F.count("*").alias("findings"), F.count_if(F.col("q_value") <= alpha).alias("survivors"))
    scan = F.col("has_text_layer").eqNullSafe(F.lit(False))
    d = filings.agg(
        F.count("*").alias("filings"),
        F.count_if("is_ptr").alias("reports"),
        F.count_if(~F.col("parsed")).alias("unread"),
        F.count_if(F.col("parsed") & scan).alias("scans"),
        F.count_if(F.col("parsed") & ~scan & (F.col("confidence") == 0)).alias("gave_nothing"),
    )
    return t.crossJoin(F.broadcast(f)).crossJoin(F.broadcast(d)).crossJoin(F.broadcast(late_rate(reported)))


def asset_listing(assets: DataFrame, size: int = 50, number: int = 1) -> DataFrame:
    return page(assets, [F.desc("asset_id")], size, number)


def coverage(bills: DataFrame, trades: DataFrame, known: DataFrame) -> DataFrame:
    """One row: bills with a sector, traded tickers, and those among them with a known industry."""
    b = bills.agg(F.count("*").alias("bills"), F.count("sector").alias("mapped_bills"))
    tickers = trades.where("ticker IS NOT NULL").select(F.upper(F.trim("ticker")).alias("ticker")).distinct()
    k = known.select(F.upper(F.trim("ticker")).alias("ticker"), F.lit(True).alias("known")).distinct()
    t = tickers.join(k, "ticker", "left").agg(F.count("*").alias("traded_tickers"), F.count("known").alias("known_tickers"))
    return b.crossJoin(F.broadcast(t))

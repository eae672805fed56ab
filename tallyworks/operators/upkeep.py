"""Keeping stored tables true: what to analyse, what to ask for, and how stored rows are mended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import not_after
from ..functions.fixed import POLICY_SECTORS, STORED_ASSET_TYPES
from ..functions.predicates import held_by_member, net_worth_snapshot
from ..functions.wording import large_trade_text
from ..session import settled
from .restatements import drop_restatements

# ---------------------------------------------------------------- scopes


def who_traded(members: DataFrame, trades: DataFrame) -> DataFrame:
    """Members with a disclosed trade, in office or not."""
    return members.join(trades.select("member_id").distinct(), "member_id", "left_semi")


def with_annual_filings(members: DataFrame, filings: DataFrame, least: int = 2) -> DataFrame:
    """Members with ``least`` filings that state a net worth."""
    annual = filings.where(net_worth_snapshot(F.col("is_ptr"), F.col("filing_type"))).groupBy("member_id").agg(F.count("*").alias("n"))
    return members.join(annual.where(F.col("n") >= least), "member_id", "left_semi")


def worth_asking(members: DataFrame, filings: DataFrame) -> DataFrame:
    """Members in office, and those of whom a filing is stored."""
    filed = filings.where("member_id IS NOT NULL").select("member_id").distinct().withColumn("filed", F.lit(True))
    return members.join(filed, "member_id", "left").where(F.coalesce("in_office", F.lit(False)) | F.col("filed").isNotNull()).drop("filed")


def uncached(tickers: DataFrame, cached: DataFrame) -> DataFrame:
    """Traded tickers that the industry table does not have, each once."""
    traded = tickers.where(F.trim("ticker") != "").select(F.upper(F.trim("ticker")).alias("ticker")).distinct()
    return traded.join(cached.select(F.upper(F.trim("ticker")).alias("ticker")), "ticker", "left_anti")


def bill_sectors(bills: DataFrame) -> DataFrame:
    """(bill_id, sector): the sectors that a bill's policy area names; most areas name none."""
    pairs = [(area, s) for area, sectors in POLICY_SECTORS.items() for s in sectors]
    table = bills.sparkSession.createDataFrame(pairs, "area string, sector string")
    return bills.select("bill_id", F.trim("policy_area").alias("area")).join(F.broadcast(table), "area").select("bill_id", "sector")  # a fixed table


def longest_untouched(filings: DataFrame, limit: int | None = None) -> DataFrame:
    """The queue of filings to read again, the longest untouched first; ``limit`` takes its head."""
    queue = filings.orderBy(F.asc_nulls_first("updated_at"), "filing_id")
    return queue if limit is None else queue.limit(limit)


# ---------------------------------------------------------------- storing what was read


def storable_trades(read: DataFrame, now: Column) -> DataFrame:
    """Read trades as stored ones: unknown directions are left out; the date is the trade's, else the filing's, and ``now`` at the latest."""
    direction = F.lower(F.coalesce("direction", F.lit("")))
    rows = read.where(direction.isin("purchase", "sale", "exchange"))
    return rows.withColumns({"direction": direction, "traded_on": F.coalesce(not_after(F.col("traded_on"), now), not_after(F.col("filed_on"), now), now), "asset": F.coalesce("asset", F.lit("")), "owner": F.coalesce("owner", F.lit("Self"))})


def storable_assets(read: DataFrame) -> DataFrame:
    kind = F.lower(F.coalesce("asset_type", F.lit("other")))
    return read.withColumns({"asset_type": F.when(kind.isin(*STORED_ASSET_TYPES), kind).otherwise("other"), "asset": F.coalesce("asset", F.lit(""))})


# ---------------------------------------------------------------- findings


def without_types(findings: DataFrame, types: list[str]) -> DataFrame:
    return findings.where(~F.coalesce(F.col("anomaly_type").isin(types), F.lit(False)))


def regenerate(findings: DataFrame, made: DataFrame, covered: list[str]) -> DataFrame:
    """Findings after those of ``covered`` types were taken away and made anew."""
    return without_types(findings, covered).unionByName(made.where(F.col("anomaly_type").isin(covered)).select(*findings.columns))


def first_of_group(rows: DataFrame, keys: list[str], key: str = "finding_id") -> DataFrame:
    """The row with the lowest ``key`` of each group; nulls in ``keys`` are one value."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(key))
    return rows.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def sync_large_trades(findings: DataFrame, trades: DataFrame, above: int = 1_000_000) -> DataFrame:
    """Findings of large trades with the trade's id, filing, title and description as they would be written now.

    A finding is found by its trade's id, else (where it has none) by member, filing and title;
    of several such findings of one text the latest gets the id, once, and of several trades
    of one text it is that with the highest id, as if they were gone through in order and
    each took the finding over. Restated trades and those of others in the household are left out.
    """
    kept = drop_restatements(trades, of=(F.col("amount_min") > above) & held_by_member(F.col("owner")))
    title, description = large_trade_text(F.col("ticker"), F.col("asset"), F.col("direction"))
    # what is kept is written once: it meets findings by id, and what no finding names meets them by text
    rows = settled(kept.select(F.col("txn_id").alias("t_id"), F.col("member_id").alias("t_member"), F.col("filing_id").alias("t_filing"), title.alias("t_title"), description.alias("t_description")))
    is_large = F.col("anomaly_type").eqNullSafe(F.lit("large_trade"))
    known, loose = findings.where(is_large & F.col("txn_id").isNotNull()), findings.where(is_large & F.col("txn_id").isNull())

    def renewed(joined: DataFrame, **new: str) -> DataFrame:
        hit = F.col("t_id").isNotNull()
        return joined.select(*[F.when(hit, F.col(new[c])).otherwise(F.col(c)).alias(c) if c in new else c for c in findings.columns])

    by_id = renewed(known.join(rows, F.col("txn_id") == F.col("t_id"), "left"), title="t_title", description="t_description", filing_id="t_filing")
    open_rows = rows.join(known.select("txn_id"), F.col("t_id") == F.col("txn_id"), "left_anti")
    once = open_rows.groupBy("t_member", "t_filing", "t_title").agg(F.max("t_id").alias("t_id"), F.max_by("t_description", "t_id").alias("t_description"))
    nth = F.row_number().over(Window.partitionBy("member_id", "filing_id", "title").orderBy(F.desc("finding_id")))
    same = (F.col("member_id") == F.col("t_member")) & (F.col("filing_id") == F.col("t_filing")) & (F.col("title") == F.col("t_title")) & (F.col("nth") == 1)
    by_text = renewed(loose.withColumn("nth", nth).join(once, same, "left"), txn_id="t_id", description="t_description")
    return findings.where(~is_large).unionByName(by_id).unionByName(by_text)


# ---------------------------------------------------------------- filings on the wrong member


def move_filings(filings: DataFrame, moves: DataFrame, members: DataFrame, code: str = "bioguide_id") -> DataFrame:
    """Filings on the member that ``moves`` (document_id, code) names, if document and member are one each."""
    target = members.groupBy(code).agg(F.count("*").alias("m"), F.min("member_id").alias("target")).where("m = 1")
    asked = moves.groupBy("document_id").agg(F.countDistinct(code).alias("c"), F.min(code).alias(code)).where("c = 1")
    single = filings.groupBy("document_id").agg(F.count("*").alias("f")).where("f = 1")
    good = asked.join(target, code).join(single, "document_id").select("document_id", "target")
    return filings.join(good, "document_id", "left").withColumn("member_id", F.coalesce("target", "member_id")).select(*filings.columns)


def repaired(filings: DataFrame, candidates: DataFrame) -> DataFrame:
    """Filings to move: (filing_id, member_id, to) where the index names exactly one candidate and it is another."""
    one = candidates.select("filing_id", "candidate").distinct().groupBy("filing_id").agg(F.count("*").alias("n"), F.min("candidate").alias("to")).where("n = 1")
    return filings.join(one, "filing_id").where(~F.col("member_id").eqNullSafe(F.col("to"))).select("filing_id", "member_id", "to")

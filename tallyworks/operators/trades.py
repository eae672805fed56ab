"""Detectors over members' trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_key
from ..functions.fixed import DEADLINE_DAYS, LARGE_AMOUNT, LATE_AMOUNT, LATE_DAYS
from ..functions.money import amount_of
from ..functions.predicates import held_by_member, not_amended, owner_or_self
from .restatements import drop_restatements


def own(trades: DataFrame) -> DataFrame:
    return trades.where(held_by_member(F.col("owner")))


def sector_concentration(trades: DataFrame, sectors: DataFrame, least: int = 5, percent: float = 50.0) -> DataFrame:
    """Sectors above ``percent`` of a filing's rows. ``sectors`` has (ticker, sector), several rows for several sectors.

    A row counts in each of its sectors; rows without one stay in the denominator.
    """
    rows = trades.select("member_id", "filing_id", "ticker", F.count("*").over(Window.partitionBy("member_id", "filing_id")).alias("size")).where(F.col("size") >= least)
    found = rows.join(sectors.distinct(), "ticker").groupBy("member_id", "filing_id", "sector", "size").agg(F.count("*").alias("rows"))
    return found.withColumn("percent", F.col("rows") / F.col("size") * 100).where(F.col("percent") > percent).withColumn("severity", F.least(F.lit(10), 5 + F.floor((F.col("percent") - 50) / 10)).cast("int"))


def trading_frequency(trades: DataFrame, least: int = 10) -> DataFrame:
    """Member months with more than ``least`` own trades (exchanges are none), over all filings; names the filing with most of them."""
    rows = trades.where("traded_on IS NOT NULL").withColumn("month", month_key(F.col("traded_on")))
    mine, exchange = held_by_member(F.col("owner")), F.col("direction") == "exchange"
    per = rows.groupBy("member_id", "month", "filing_id").agg(
        F.count_if(mine & ~exchange).alias("n"), F.count_if(mine & exchange).alias("exchanges"), F.count_if(~mine).alias("household"), F.collect_set(F.when(mine & ~exchange, F.col("traded_on"))).alias("days")
    )
    out = per.groupBy("member_id", "month").agg(
        F.sum("n").alias("trades"),
        F.sum("exchanges").alias("exchanges"),
        F.sum("household").alias("household"),
        F.size(F.array_distinct(F.flatten(F.collect_list("days")))).alias("days"),
        F.max_by("filing_id", F.struct(F.col("n"), -F.col("filing_id"))).alias("filing_id"),
    )
    return out.where(F.col("trades") > least)


def large_trades(trades: DataFrame, above: int = LARGE_AMOUNT) -> DataFrame:
    step = above * 5
    severity = F.least(F.lit(10), 5 + F.floor(F.col("amount_min") / step)).cast("int")
    return own(trades).where(F.col("amount_min") > above).withColumn("severity", severity)


def late_filings(trades: DataFrame, days: int = LATE_DAYS, amount: int = LATE_AMOUNT, label: str | None = "filing_type", label_says: str = "(?i)amend") -> DataFrame:
    """Household trades of some size that a read transaction report filed more than ``days`` after the trade.

    Restated rows go first, counted among those reports, then amended ones. Graded by days
    past the deadline, which is the threshold a finding stores.
    """
    return filed_late(drop_restatements(trades.where("is_ptr AND parsed"), label=label, label_says=label_says), days, amount)


def filed_late(rows: DataFrame, days: int = LATE_DAYS, amount: int = LATE_AMOUNT) -> DataFrame:
    """The late filings among rows of read transaction reports without restated ones."""
    late = F.datediff("filed_on", "traded_on")
    past = F.col("days") - DEADLINE_DAYS
    size = F.when(F.col("amount_max") != 0, F.col("amount_max")).otherwise(F.col("amount_min"))
    rows = rows.where(not_amended(F.col("status")) & (size >= amount)).withColumn("days", late).where(F.col("days") > days)
    rows = rows.withColumn("severity", F.when(past <= 30, "low").when(past <= 90, "medium").otherwise("high"))
    return rows.withColumn("threshold_value", F.lit(DEADLINE_DAYS).cast("long"))


def committee_share(trades: DataFrame, sectors: DataFrame, seats: DataFrame, least: int = 3, share: float = 0.2) -> DataFrame:
    """Members whose own trades lie in the sectors of a committee they sit on; ``seats`` has (member_id, committee_id, sector)."""
    mine = own(trades)
    total = mine.groupBy("member_id").agg(F.count("*").alias("total"))
    tagged = mine.select("member_id", "txn_id", "ticker").join(sectors.distinct(), "ticker").join(seats.distinct(), ["member_id", "sector"])
    hit = tagged.select("member_id", "committee_id", "txn_id").distinct().groupBy("member_id", "committee_id").agg(F.count("*").alias("matched"))
    out = hit.join(total, "member_id").withColumn("share", F.col("matched") / F.col("total"))
    return out.where((F.col("matched") >= least) & (F.col("share") >= share)).withColumn("severity", F.when(F.col("share") >= 0.5, "HIGH").otherwise("MEDIUM"))


def owner_breakdown(trades: DataFrame) -> DataFrame:
    """Per member the numbers of rows by owner."""
    o = owner_or_self(F.col("owner"))
    names = [("self_rows", "Self"), ("joint_rows", "Joint"), ("spouse_rows", "Spouse"), ("child_rows", "Dependent Child")]
    return trades.groupBy("member_id").agg(*[F.count_if(o == v).alias(n) for n, v in names], F.count_if(~o.isin(*[v for _, v in names])).alias("other_rows"))


def volume_spikes(trades: DataFrame, least: int = 8, above: int = 2) -> DataFrame:
    """Members with several trades far above their own median: median + 3 MAD / 0.6745, or 5 medians where MAD is 0."""
    rows = own(trades).withColumn("amount", amount_of(F.col("amount_min"), F.col("amount_max")).cast("double")).where("amount > 0").select("member_id", "amount")
    middle = rows.groupBy("member_id").agg(F.count("*").alias("n"), F.median("amount").alias("median")).where(F.col("n") >= least)
    spread = rows.join(middle, "member_id").groupBy("member_id", "n", "median").agg(F.median(F.abs(F.col("amount") - F.col("median"))).alias("mad"))
    limit = F.when(F.col("mad") > 0, F.col("median") + 3 * F.col("mad") / 0.6745).otherwise(5 * F.col("median"))
    spread = spread.withColumn("threshold", limit)
    out = rows.join(spread, "member_id").groupBy("member_id", "n", "median", "mad", "threshold").agg(F.count_if(F.col("amount") > F.col("threshold")).alias("above"), F.max("amount").alias("largest"))
    return out.where(F.col("above") >= above)


def buy_sell_pairs(trades: DataFrame, by: list[str]) -> DataFrame:
    """Per group: buys, sales and pairs in which the sale's day is after the buy's.

    Pairs are counted by a running sum over days, not formed.
    """
    rows = trades.where(F.col("direction").isin("purchase", "sale") & F.col("traded_on").isNotNull())
    day = rows.groupBy(*by, "traded_on").agg(F.count_if(F.col("direction") == "purchase").alias("b"), F.count_if(F.col("direction") == "sale").alias("s"))
    before = F.coalesce(F.sum("b").over(Window.partitionBy(*by).orderBy("traded_on").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return day.withColumn("p", before * F.col("s")).groupBy(*by).agg(F.sum("b").alias("buys"), F.sum("s").alias("sales"), F.sum("p").alias("pairs"))


def perfect_timing(trades: DataFrame, rate: float = 80.0, least: int = 5) -> DataFrame:
    """Off by default: members whose buy-then-sale pairs per buy reach ``rate`` percent."""
    out = buy_sell_pairs(trades, ["member_id"]).where((F.col("buys") >= least) & (F.col("sales") > 0))
    return out.withColumn("rate", F.col("pairs") / F.col("buys") * 100).where(F.col("rate") >= rate)


def loss_avoidance(trades: DataFrame, least: int = 3) -> DataFrame:
    """Off by default: member tickers with at least ``least`` pairs of a buy and a later sale."""
    return buy_sell_pairs(trades.where("ticker IS NOT NULL"), ["member_id", "ticker"]).where(F.col("pairs") >= least)


def outperformance(trades: DataFrame, percent: float = 10.0) -> DataFrame:
    """Off by default: member years in which sales exceed buys by more than ``percent`` of the buys, at midpoints."""
    amount = amount_of(F.col("amount_min"), F.col("amount_max"))
    rows = trades.where("traded_on IS NOT NULL").groupBy("member_id", F.year("traded_on").alias("year"))
    out = rows.agg(F.sum(F.when(F.col("direction") == "purchase", amount)).alias("bought"), F.sum(F.when(F.col("direction") == "sale", amount)).alias("sold"))
    gain = (F.col("sold").cast("double") - F.col("bought").cast("double")) / F.col("bought").cast("double") * 100
    return out.where("bought > 0").withColumn("gain", gain).where(F.col("gain") > percent)


def multi_factor(findings: DataFrame, types: list[str], least: int = 3, critical: int = 6) -> DataFrame:
    """Members with ``least`` distinct types among ``types``; scores 3, 2, 1 for HIGH, MEDIUM, LOW."""
    s = F.upper("severity")
    points = F.when(s.isin("HIGH", "CRITICAL"), 3).when(s == "MEDIUM", 2).when(s == "LOW", 1).otherwise(0)
    out = findings.where(F.col("anomaly_type").isin(types)).groupBy("member_id").agg(F.countDistinct("anomaly_type").alias("factors"), F.sum(points).alias("score"), F.array_join(F.sort_array(F.collect_set("anomaly_type")), ",").alias("types"))
    return out.where(F.col("factors") >= least).withColumn("severity", F.when(F.col("score") >= critical, "CRITICAL").otherwise("HIGH"))

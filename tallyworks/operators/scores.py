"""Punctuality and legibility of members' filings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import DEADLINE_DAYS
from ..functions.predicates import is_vague
from .restatements import drop_restatements


def overdue(trades: DataFrame, deadline: int = DEADLINE_DAYS) -> DataFrame:
    """Adds days past the deadline; trades without either date are left out, as they cannot be checked."""
    days = F.datediff("filed_on", "traded_on")
    return trades.where("filed_on IS NOT NULL AND traded_on IS NOT NULL").withColumn("overdue", days - deadline)


def reported(trades: DataFrame, label: str | None = "filing_type", label_says: str = "(?i)amend") -> DataFrame:
    """Trades of transaction reports without those that a later report repeats; what is scored for punctuality."""
    return drop_restatements(trades.where("is_ptr"), label=label, label_says=label_says)


def compliance(trades: DataFrame, deadline: int = DEADLINE_DAYS) -> DataFrame:
    """Per member: checkable, late and on-time trades, rate, mean, median and largest delay, late value, worst filing.

    ``trades`` are those of transaction reports, restated rows dropped (``reported``). The worst
    filing is that of the latest trade, the first of several; none where nothing is late.
    """
    late = F.col("overdue") > 0
    worst = F.max_by("filing_id", F.when(late, F.struct(F.col("overdue"), -F.col("filing_id"), -F.col("txn_id"))))
    out = overdue(trades, deadline).groupBy("member_id").agg(
        F.count("*").alias("checkable"),
        F.count_if(late).alias("late"),
        F.avg(F.when(late, F.col("overdue"))).alias("mean_overdue"),
        F.median(F.when(late, F.col("overdue"))).alias("median_overdue"),
        F.max(F.when(late, F.col("overdue"))).alias("max_overdue"),
        F.coalesce(F.sum(F.when(late, F.col("amount_max"))), F.lit(0)).alias("late_value"),
        worst.alias("worst_filing"),
    )
    return out.select("*", (F.col("checkable") - F.col("late")).alias("on_time"), (F.col("late") / F.col("checkable") * 100).alias("late_rate"))


def compliance_leaderboard(trades: DataFrame, min_trades: int = 5, top: int | None = None) -> DataFrame:
    """Members with enough trades, the least punctual first; ``top`` makes it a top-k."""
    board = compliance(trades).where(F.col("checkable") >= min_trades).orderBy(F.desc("late_rate"), F.desc_nulls_last("mean_overdue"), "member_id")
    return board if top is None else board.limit(top)


def late_rate(trades: DataFrame) -> DataFrame:
    """One row: checkable and late trades of all members, and the rate."""
    out = overdue(trades).agg(F.count("*").alias("checkable"), F.count_if(F.col("overdue") > 0).alias("late"))
    return out.withColumn("late_rate", F.try_divide("late", "checkable") * 100)


def opacity(filings: DataFrame, trades: DataFrame, assets: DataFrame, least: int = 5) -> DataFrame:
    """Per member the mean of the defined rates: missing tickers, vague and unpriced items, unreadable filings.

    Members with fewer than ``least`` items and no unreadable filing have no score. Trades
    are those of all filings, restated rows dropped before.
    """
    unread = ~F.coalesce("parsed", F.lit(False)) | F.col("has_text_layer").eqNullSafe(F.lit(False)) | F.col("confidence").eqNullSafe(F.lit(0.0))
    f = filings.groupBy("member_id").agg(F.count("*").alias("filings"), F.count_if(unread).alias("unreadable"))
    t = trades.groupBy("member_id").agg(
        F.count("*").alias("n_trades"),
        F.count_if(F.coalesce(F.col("ticker"), F.lit("")) == "").alias("no_ticker"),
        F.count_if(is_vague(F.col("asset"))).alias("vague_t"),
        F.count_if(F.col("amount_min").isNull() & F.col("amount_max").isNull()).alias("unpriced_t"),
    )
    a = assets.groupBy("member_id").agg(F.count("*").alias("n_assets"), F.count_if(is_vague(F.col("asset"))).alias("vague_a"), F.count_if(F.col("value_min").isNull() & F.col("value_max").isNull()).alias("unpriced_a"))
    j = f.join(t, "member_id", "left").join(a, "member_id", "left").na.fill(0)
    j = j.withColumn("items", F.col("n_trades") + F.col("n_assets")).where((F.col("items") >= least) | (F.col("unreadable") > 0))
    rates = F.array(
        F.col("unreadable") / F.col("filings") * 100,
        F.try_divide("no_ticker", "n_trades") * 100,
        F.try_divide(F.col("vague_t") + F.col("vague_a"), F.col("items")) * 100,
        F.try_divide(F.col("unpriced_t") + F.col("unpriced_a"), F.col("items")) * 100,
    )
    defined = F.filter(rates, lambda r: r.isNotNull())
    score = F.aggregate(defined, F.lit(0.0), lambda acc, r: acc + r) / F.size(defined)
    return j.select("member_id", "filings", "unreadable", "items", "no_ticker", (F.col("vague_t") + F.col("vague_a")).alias("vague"), (F.col("unpriced_t") + F.col("unpriced_a")).alias("unpriced"), score.alias("score"))


def opacity_leaderboard(filings: DataFrame, trades: DataFrame, assets: DataFrame) -> DataFrame:
    return opacity(filings, trades, assets).orderBy(F.desc("score"), "member_id")

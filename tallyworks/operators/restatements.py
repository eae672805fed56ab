"""Rows that a later filing repeats from an earlier one.

A later filing L restates an earlier E if its label says so or they share at least
``least`` rows; of each content, L then loses as many copies as E and L share, taking the
largest over all such E. Counts are those of the filings as filed, so nothing is
sequential: grouped counts, one self-join on (member, content), two aggregates, one rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import RESTATED_ROWS
from ..functions.predicates import not_withdrawn

CONTENT = ["traded_on", "direction", "asset", "ticker", "amount_min", "amount_max", "owner"]


def content_key(columns: list[str] = CONTENT) -> Column:
    """What makes two rows the same trade: dates and bands as they are, texts trimmed, tickers upper-cased."""

    def part(c: str) -> Column:
        text = F.trim(F.coalesce(F.col(c).cast("string"), F.lit("\x00")))
        return F.upper(text) if c == "ticker" else text

    # half of a digest's bytes: it travels with every row
    return F.substring(F.unhex(F.sha2(F.concat_ws("\x1f", *[part(c) for c in columns]), 256)), 1, 16)


def _counts(rows: DataFrame, label: str | None) -> DataFrame:
    """Copies of each content that several filings have in each of them, with the filing's place in time."""
    keep = ["member_id", "filing_id", "filed_on", "key"] + ([label] if label else [])
    counts = rows.select(*keep).repartition("member_id", "key").groupBy(*keep).agg(F.count("*").alias("n"))
    # only what several filings have can be restated
    counts = counts.withColumn("filings", F.count("*").over(Window.partitionBy("member_id", "key"))).where("filings > 1").drop("filings")
    return counts.withColumn("at", F.struct(F.col("filed_on").isNull().alias("undated"), F.col("filed_on").alias("day"), F.col("filing_id").alias("id")))


def restated_pairs(rows: DataFrame, key: Column | None = None, label: str | None = None, label_says: str = "(?i)amend", least: int = RESTATED_ROWS) -> DataFrame:
    """(member_id, later, earlier, shared) for filing pairs of which the later restates the earlier.

    Filings without a date come last. ``label`` names the filing-type column, if labels count.
    """
    pairs = _shared(rows.withColumn("key", key if key is not None else content_key()), label)
    says = F.coalesce(F.col("label").rlike(label_says), F.lit(False)) if label else F.lit(False)
    return pairs.groupBy("member_id", "later", "earlier", "label").agg(F.sum("both").alias("shared")).where(says | (F.col("shared") >= least)).drop("label")


def _shared(rows: DataFrame, label: str | None) -> DataFrame:
    counts = _counts(rows.where(not_withdrawn(F.col("status"))), label)
    late = counts.select("member_id", "key", F.col("filing_id").alias("later"), F.col("at").alias("late_at"), F.col("n").alias("n_late"), (F.col(label) if label else F.lit(None).cast("string")).alias("label"))
    early = counts.select("member_id", "key", F.col("filing_id").alias("earlier"), F.col("at").alias("early_at"), F.col("n").alias("n_early"))
    return late.join(early, ["member_id", "key"]).where("early_at < late_at").withColumn("both", F.least("n_late", "n_early"))


def drop_restatements(rows: DataFrame, key: Column | None = None, label: str | None = None, label_says: str = "(?i)amend", least: int = RESTATED_ROWS, of: Column | None = None) -> DataFrame:
    """Rows without withdrawn ones and without copies that an earlier filing already has.

    Needs member_id, filing_id, filed_on, status and txn_id; of equal rows in a filing the
    ones with the lowest txn_id go. ``of`` asks for those rows alone; it has to be the same for
    all rows of a key, and what is restated is still counted over all rows.
    """
    rows = rows.withColumn("key", key if key is not None else content_key())
    shared = _shared(rows, label)
    says = F.coalesce(F.col("label").rlike(label_says), F.lit(False)) if label else F.lit(False)
    total = F.sum("both").over(Window.partitionBy("member_id", "later", "earlier"))
    already = shared.withColumn("total", total).where(says | (F.col("total") >= least)).groupBy("member_id", F.col("later").alias("filing_id"), "key").agg(F.max("both").alias("already"))
    copy = F.row_number().over(Window.partitionBy("member_id", "filing_id", "key").orderBy("txn_id"))
    asked = rows.where(not_withdrawn(F.col("status"))) if of is None else rows.where(not_withdrawn(F.col("status")) & of)
    kept = asked.withColumn("copy", copy)
    return kept.join(already, ["member_id", "filing_id", "key"], "left").where(F.col("copy") > F.coalesce("already", F.lit(0))).drop("key", "copy", "already")


def multiset_difference(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``left`` beyond the copies that ``right`` has (EXCEPT ALL that keeps further columns)."""
    w = Window.partitionBy(*on).orderBy(*[c for c in left.columns if c not in on] or on)
    numbered = left.withColumn("__n", F.row_number().over(w))
    have = right.groupBy(*on).agg(F.count("*").alias("__have"))
    condition = [left_.eqNullSafe(right_) for left_, right_ in ((numbered[c], have[c]) for c in on)]
    joined = numbered.join(have, condition, "left").where(F.col("__n") > F.coalesce("__have", F.lit(0)))
    return joined.select(*[numbered[c] for c in left.columns])

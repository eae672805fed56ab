"""Detectors by declaration: what they read, what they find, and which of them run.

A disabled detector is not planned: its inputs are not opened. An input that several
enabled detectors read is computed once. Detectors that run but whose source table is empty
are told from those that found nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import CONTRACT_DAYS, DISABLED
from ..functions.predicates import counted_award
from ..session import settled
from .windows import within_own_window

FINDING = {"member_id": "long", "anomaly_type": "string", "title": "string", "txn_id": "long", "filing_id": "long", "computed_value": "double", "threshold_value": "double"}


@dataclass(frozen=True)
class Detector:
    """A type of findings: its source table, all its inputs, and the function of these that finds them."""

    anomaly_type: str
    source: str
    inputs: tuple[str, ...]
    find: Callable[..., DataFrame]


def enabled(detectors: list[Detector], disabled: list[str] = DISABLED) -> list[Detector]:
    return [d for d in detectors if d.anomaly_type not in disabled]


def run(detectors: list[Detector], tables: Mapping[str, Callable[[], DataFrame]], disabled: list[str] = DISABLED) -> DataFrame | None:
    """Findings (columns of FINDING) of all enabled detectors; what a detector does not say is null. None if none is enabled."""
    on = enabled(detectors, disabled)
    uses = Counter(name for d in on for name in d.inputs)
    opened = {name: settled(tables[name](), name) if n > 1 else tables[name]() for name, n in uses.items()}

    def shaped(d: Detector) -> DataFrame:
        found = d.find(*[opened[name] for name in d.inputs]).withColumn("anomaly_type", F.lit(d.anomaly_type))
        return found.select(*[(F.col(c) if c in found.columns else F.lit(None)).cast(kind).alias(c) for c, kind in FINDING.items()])

    return reduce(DataFrame.unionByName, map(shaped, on)) if on else None


def source_rows(detectors: list[Detector], tables: Mapping[str, Callable[[], DataFrame]], disabled: list[str] = DISABLED) -> DataFrame | None:
    """(anomaly_type, source, rows, starved) of every enabled detector; each table is counted once."""
    on = enabled(detectors, disabled)
    if not on:
        return None
    counts = reduce(DataFrame.unionByName, [tables[name]().agg(F.lit(name).alias("source"), F.count("*").alias("rows")) for name in dict.fromkeys(d.source for d in on)])
    spark = counts.sparkSession
    names = spark.createDataFrame([(d.anomaly_type, d.source) for d in on], "anomaly_type string, source string")
    return names.join(counts, "source").select("anomaly_type", "source", "rows", (F.col("rows") == 0).alias("starved"))


def summary(findings: DataFrame, members: DataFrame, sources: DataFrame) -> DataFrame:
    """Per type with findings: findings, members, members per hundred of all, and the rows that its detector scanned."""
    every = members.agg(F.count("*").alias("all"))
    out = findings.groupBy("anomaly_type").agg(F.count("*").alias("findings"), F.countDistinct("member_id").alias("members"))
    rate = F.bround(F.coalesce(F.try_divide("members", "all"), F.lit(0.0)) * 100, 2)
    return out.crossJoin(F.broadcast(every)).join(sources.select("anomaly_type", F.col("rows").alias("source_rows")), "anomaly_type", "left").select("anomaly_type", "findings", "members", rate.alias("flag_rate"), "source_rows")


def award_support(findings: DataFrame, trades: DataFrame, awards: DataFrame, days: int = CONTRACT_DAYS) -> DataFrame:
    """Contract findings with ``verdict``: supported, unsupported or unjudged.

    A finding is supported if an award of the trade's ticker that counts as one lies within the
    days after the trade that the finding itself recorded as its threshold (``days`` where
    it has none). Without its trade, or the trade's day, it cannot be judged; and if there is
    no award row at all, counted or not, then none can: the awards were not read.
    ``trades`` has txn_id, ticker and traded_on, ``awards`` ticker, happened_on and amount.
    """
    ticker = F.upper(F.trim(F.coalesce("ticker", F.lit(""))))
    known = trades.where("txn_id IS NOT NULL").select("txn_id", ticker.alias("__ticker"), F.col("traded_on").alias("__day")).withColumn("__n", F.row_number().over(Window.partitionBy("txn_id").orderBy("__day"))).where("__n = 1").drop("__n")
    window = F.coalesce(F.col("threshold_value").cast("long"), F.lit(days).cast("long"))
    rows = settled(findings.withColumn("__f", F.monotonically_increasing_id()).join(known, "txn_id", "left").withColumn("__window", window))
    counted = awards.where(counted_award(F.col("happened_on"), F.col("amount"))).select(ticker.alias("__ticker"), F.col("happened_on").alias("__awarded"))
    good = within_own_window(rows.where("__day IS NOT NULL"), counted, ["__ticker"], "__window", "__day", "__awarded").select("__f", F.lit(True).alias("__good"))
    if awards.isEmpty():
        rows = rows.withColumn("__day", F.lit(None).cast("date"))
    verdict = F.when(F.col("__day").isNull(), "unjudged").when(F.col("__good"), "supported").otherwise("unsupported")
    return rows.join(good, "__f", "left").withColumn("verdict", verdict).select(*findings.columns, "verdict")

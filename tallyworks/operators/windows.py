"""Joins and sequences over days: event windows, runs, clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import ordinal_day
from ..functions.fixed import CLUSTER_DAYS, CLUSTER_MEMBERS, CLUSTER_SHARE, RUN_DAYS, RUN_TRADES
from ..session import settled


def event_window_join(trades: DataFrame, events: DataFrame, keys: list[str], before: int, after: int, trade_day: str = "traded_on", event_day: str = "happened_on") -> DataFrame:
    """Trades with every event of equal ``keys`` such that event - before <= trade <= event + after.

    Days are cut into cells as wide as the window, so an event meets at most two cells and
    the equi-join runs on (keys, cell): a key with many trades and events is spread over its
    cells, and no pair outside the neighbouring cells is formed. Adds days_apart.
    """
    width = before + after + 1
    cell = F.floor(ordinal_day(F.col(trade_day)) / width)
    first, last = (F.floor((ordinal_day(F.col(event_day)) + k) / width) for k in (-before, after))
    left = trades.where(F.col(trade_day).isNotNull()).withColumn("__cell", cell)
    right = events.where(F.col(event_day).isNotNull()).withColumn("__cell", F.explode(F.sequence(first, last)))
    apart = F.datediff(F.col(trade_day), F.col(event_day))
    return left.join(right, [*keys, "__cell"]).where((apart >= -before) & (apart <= after)).withColumn("days_apart", F.abs(apart)).drop("__cell")


def within_window(rows: DataFrame, events: DataFrame, keys: list[str], before: int, after: int, day: str, event_day: str = "happened_on", anti: bool = False) -> DataFrame:
    """Rows with (or, if ``anti``, without) an event of equal keys in the window; rows without a day have none."""
    width = before + after + 1
    right = events.where(F.col(event_day).isNotNull()).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(event_day).alias("__day"))
    right = right.withColumn("__c", F.explode(F.sequence(*[F.floor((ordinal_day(F.col("__day")) + k) / width) for k in (-before, after)])))
    left = rows.withColumn("__cell", F.floor(ordinal_day(F.col(day)) / width))
    apart = F.datediff(F.col(day), F.col("__day"))
    same = [F.col(k) == F.col(f"__{k}") for k in keys]
    on = reduce(lambda a, b: a & b, [*same, F.col("__cell") == F.col("__c"), apart >= -before, apart <= after])
    return left.join(right, on, "left_anti" if anti else "left_semi").drop("__cell")


def within_own_window(rows: DataFrame, events: DataFrame, keys: list[str], ahead: str, day: str, event_day: str, anti: bool = False) -> DataFrame:
    """Rows with (or, if ``anti``, without) an event of equal keys from their day to as many days later as ``ahead`` says.

    Windows of one power of two share cells as wide as that power, so a row meets two cells
    at most however wide its window is, and an event has one cell for each power that
    occurs. Rows without a day or a window have no event, and neither has a negative window.
    """
    level = F.length(F.bin(F.col(ahead)))
    wide = rows.where(f"{ahead} >= 0").select(level.alias("level")).distinct()
    powers = sorted(r.level for r in wide.collect())  # at most 63 numbers
    cell = lambda c, power: F.floor(c / F.pow(F.lit(2.0), power)).cast("long")
    at = ordinal_day(F.col(day))
    left = settled(rows.withColumn("__at", F.monotonically_increasing_id()))
    asked = left.where(F.col(day).isNotNull() & (F.col(ahead) >= 0)).select("__at", *[F.col(k).alias(f"__{k}") for k in keys], at.alias("__from"), (at + F.col(ahead)).alias("__to"), level.alias("__level"))
    asked = asked.withColumn("__cell", F.explode(F.array_distinct(F.array(cell(F.col("__from"), F.col("__level")), cell(F.col("__to"), F.col("__level"))))))
    told = events.where(F.col(event_day).isNotNull()).select(*keys, ordinal_day(F.col(event_day)).alias("__day")).distinct()
    told = told.withColumn("__power", F.explode(F.array(*[F.lit(p) for p in powers]).cast("array<int>"))).withColumn("__c", cell(F.col("__day"), F.col("__power")))
    same = [F.col(f"__{k}") == F.col(k) for k in keys] + [F.col("__level") == F.col("__power"), F.col("__cell") == F.col("__c"), F.col("__day").between(F.col("__from"), F.col("__to"))]
    hit = settled(asked.join(told, reduce(lambda a, b: a & b, same), "left_semi").select("__at").distinct())
    return left.join(hit, "__at", "left_anti" if anti else "left_semi").drop("__at")


def same_direction_runs(trades: DataFrame, days: int = RUN_DAYS, least: int = RUN_TRADES) -> DataFrame:
    """Per member the longest run of trades of one direction within ``days``.

    A day with two directions breaks a run, as does a change of direction. Of equal lengths
    the shorter span wins, then the earlier end. Members without ``least`` trades are absent.
    """
    day = trades.where(F.col("traded_on").isNotNull()).groupBy("member_id", "traded_on").agg(F.count("*").alias("n"), F.min("direction").alias("direction"), (F.min("direction") == F.max("direction")).alias("one"))
    by_day = Window.partitionBy("member_id").orderBy("traded_on")
    same = F.col("one") & F.coalesce(F.lag("one").over(by_day) & (F.lag("direction").over(by_day) == F.col("direction")), F.lit(False))
    day = day.withColumn("island", F.sum(F.when(same, 0).otherwise(1)).over(by_day)).where("one")
    day = day.withColumn("d", ordinal_day(F.col("traded_on")))
    window = Window.partitionBy("member_id", "island").orderBy("d").rangeBetween(-days, 0)
    ends = day.select(
        "member_id",
        "direction",
        F.sum("n").over(window).alias("length"),
        F.min("traded_on").over(window).alias("first_day"),
        F.col("traded_on").alias("last_day"),
        F.count("*").over(window).alias("days"),
    ).where(F.col("length") >= least)
    ends = ends.withColumn("span_days", F.datediff("last_day", "first_day"))
    best = Window.partitionBy("member_id").orderBy(F.desc("length"), "span_days", "last_day")
    return ends.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def distinct_in_window(rows: DataFrame, keys: list[str], who: str, day: str, days: int) -> DataFrame:
    """(keys, day, n): distinct ``who`` in the ``days`` days up to each day with a row.

    Someone's row counts for window ends from its day until the day before their next row,
    at most ``days`` later. So each row is a step up and a step down, and the counts are a
    running sum: no set is held, however many take part.
    """
    seen = rows.where(F.col(day).isNotNull()).select(*keys, who, F.col(day).alias("day")).distinct()
    following = F.lead("day").over(Window.partitionBy(*keys, who).orderBy("day"))
    until = F.least(F.date_add("day", days + 1), following)
    seen = seen.withColumn("until", until)
    steps = seen.select(*keys, F.explode(F.array(F.struct("day", F.lit(1).alias("up"), F.lit(1).alias("row")), F.struct(F.col("until").alias("day"), F.lit(-1).alias("up"), F.lit(0).alias("row")))).alias("s"))
    sums = steps.groupBy(*keys, "s.day").agg(F.sum("s.up").alias("up"), F.max("s.row").alias("row"))
    return sums.withColumn("n", F.sum("up").over(Window.partitionBy(*keys).orderBy("day"))).where("row = 1").select(*keys, "day", "n")


def member_clusters(trades: DataFrame, days: int = CLUSTER_DAYS, members: int = CLUSTER_MEMBERS, share: float = CLUSTER_SHARE) -> DataFrame:
    """(ticker, direction) groups that many members traded within ``days``; exchanges do not count.

    Concentration is the window's members over all who ever traded the ticker, either way,
    and ubiquity those over all traders; the first of equally full windows is named, from its
    first trade to its last. Of few groups that pass, the window's rows are looked up again.
    """
    rows = trades.where(F.col("direction").isin("purchase", "sale") & F.col("ticker").isNotNull()).withColumn("ticker", F.upper(F.trim("ticker")))
    at = distinct_in_window(rows, ["ticker", "direction"], "member_id", "traded_on", days)
    best = at.groupBy("ticker", "direction").agg(F.max("n").alias("members"), F.max_by("day", F.struct("n", -ordinal_day(F.col("day")))).alias("last_day"))
    ever = rows.groupBy("ticker").agg(F.countDistinct("member_id").alias("ever"))
    all_ = rows.agg(F.countDistinct("member_id").alias("traders"))
    out = best.where(F.col("members") >= members).join(ever, "ticker").withColumn("concentration", F.col("members") / F.col("ever")).where(F.col("concentration") >= share)
    inside = rows.select("ticker", "direction", "member_id", "traded_on").join(out, ["ticker", "direction"]).where(F.col("traded_on").between(F.date_sub("last_day", days), F.col("last_day")))
    named = inside.groupBy("ticker", "direction", "members", "ever", "concentration", "last_day").agg(F.min("traded_on").alias("first_day"), F.sort_array(F.collect_set("member_id")).alias("member_ids"))
    severity = F.when(F.col("members") >= 6, "HIGH").otherwise("MEDIUM")
    return named.crossJoin(F.broadcast(all_)).select("ticker", "direction", "members", "ever", "concentration", (F.col("ever") / F.col("traders")).alias("ubiquity"), "first_day", "last_day", "member_ids", severity.alias("severity"))

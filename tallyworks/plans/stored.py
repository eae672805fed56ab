"""Queries over stored tables that change: detectors by declaration, award support, ledgers, snapshots, joins of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import registry, trades, windows
from ..session import scratch, settled
from ..streaming import imports as streams
from ..streaming import ledger
from .queries import query
from .workload import Workload

DAY = "2 days"
#: Rows of a batch where streams are dealt into batches by time, and how many batches there are at most.
BATCH_ROWS, MOST_BATCHES = 1_000_000, 64


def _detectors() -> list[registry.Detector]:
    title = lambda c: F.concat(F.lit("of "), F.col(c).cast("string"))
    large = lambda t: trades.large_trades(t, above=50_000).select("member_id", "txn_id", title("txn_id").alias("title"), F.col("amount_min").cast("double").alias("computed_value"), F.lit(50_000.0).alias("threshold_value"))
    runs = lambda t: windows.same_direction_runs(t, 200, 3).select("member_id", title("length").alias("title"), F.col("length").cast("double").alias("computed_value"))
    gifts = lambda e, t: windows.event_window_join(t, e, ["member_id", "ticker"], 5, 5).select("member_id", "txn_id", title("event_id").alias("title"), F.col("days_apart").cast("double").alias("computed_value"))
    lobby = lambda e, t: t.join(e.select("ticker"), "ticker").select("member_id", "txn_id")
    unread = lambda x: x.select("member_id")
    return [
        registry.Detector("large_trade", "trades", ("trades",), large),
        registry.Detector("trade_clustering", "trades", ("trades",), runs),
        registry.Detector("donor_conflict", "donations", ("donations", "trades"), gifts),
        registry.Detector("lobbying_overlap", "lobbying", ("lobbying", "trades"), lobby),
        registry.Detector("perfect_timing", "prices", ("prices",), unread),
    ]


def _tables(w: Workload):
    def never():
        raise AssertionError("a disabled detector's input was opened")

    return {"trades": lambda: trades.own(w.trades()), "donations": w.events, "lobbying": lambda: w.events().where("event_id < 0"), "prices": never}


_FOUND = """, dg AS (SELECT own.member_id, 'large_trade' AS anomaly_type, txn_id, CAST(amount_min AS DOUBLE) AS computed_value, 50000.0::DOUBLE AS threshold_value FROM own WHERE amount_min > 50000
UNION ALL SELECT own.member_id, 'donor_conflict', txn_id, CAST(abs(traded_on - happened_on) AS DOUBLE), NULL FROM own JOIN ev ON ev.member_id = own.member_id AND ev.ticker = own.ticker AND abs(traded_on - happened_on) <= 5)
"""


@query(_FOUND + "SELECT * FROM dg")
def detector_findings(w: Workload) -> DataFrame:
    """All enabled detectors that are declared; runs of trades have a query of their own."""
    found = registry.run(_detectors(), _tables(w))
    return found.where("anomaly_type <> 'trade_clustering'").select("member_id", "anomaly_type", "txn_id", "computed_value", "threshold_value")


@query("SELECT 'large_trade' AS anomaly_type, 'trades' AS source, (SELECT count(*) FROM own) AS rows, false AS starved UNION ALL SELECT 'trade_clustering', 'trades', (SELECT count(*) FROM own), false UNION ALL SELECT 'donor_conflict', 'donations', (SELECT count(*) FROM ev), (SELECT count(*) FROM ev) = 0 UNION ALL SELECT 'lobbying_overlap', 'lobbying', 0, true")
def detector_sources(w: Workload) -> DataFrame:
    return registry.source_rows(_detectors(), _tables(w))


@query(_FOUND + "SELECT anomaly_type, count(*) AS findings, count(DISTINCT member_id) AS members, round_even(count(DISTINCT member_id) / (SELECT count(*) FROM mem) * 100, 2) AS flag_rate, CASE anomaly_type WHEN 'large_trade' THEN (SELECT count(*) FROM own) ELSE (SELECT count(*) FROM ev) END AS source_rows FROM dg GROUP BY 1")
def detector_summary(w: Workload) -> DataFrame:
    found = settled(registry.run(_detectors(), _tables(w), ["perfect_timing", "trade_clustering"]))
    return registry.summary(found, w.members(), registry.source_rows(_detectors(), _tables(w), ["perfect_timing"]))


@query(
    """, cf AS (SELECT finding_id, CASE WHEN finding_id % 11 = 0 THEN -1 ELSE finding_id END AS txn_id, CASE finding_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 40 WHEN 2 THEN 400 END AS ahead FROM fnd),
aw AS (SELECT DISTINCT 'P' || part_id AS ticker, filed_on FROM t WHERE NOT is_ptr AND amount_min > 15000)
SELECT finding_id, CASE WHEN t.txn_id IS NULL THEN 'unjudged' WHEN EXISTS (SELECT 1 FROM aw WHERE aw.ticker = 'P' || t.part_id AND filed_on BETWEEN traded_on AND traded_on + CAST(coalesce(ahead, 30) AS INTEGER)) THEN 'supported' ELSE 'unsupported' END AS verdict
FROM cf LEFT JOIN t ON t.txn_id = cf.txn_id"""
)
def award_support(w: Workload) -> DataFrame:
    """Findings with windows of their own, of three to four hundred days."""
    k = F.col("finding_id")
    ahead = F.when(k % 4 == 0, 3.0).when(k % 4 == 1, 40.0).when(k % 4 == 2, 400.0)
    found = w.findings().select("finding_id", F.when(k % 11 == 0, F.lit(-1)).otherwise(k).cast("long").alias("txn_id"), ahead.alias("threshold_value"))
    t = w.trades().withColumn("ticker", F.concat(F.lit(" p"), F.col("part_id").cast("string")))
    awards = t.where("NOT is_ptr").select(F.upper("ticker").alias("ticker"), F.col("filed_on").alias("happened_on"), (F.col("amount_min") - 15000).alias("amount"))
    return registry.award_support(found, t, awards).select("finding_id", "verdict")


# ---------------------------------------------------------------- ledgers and snapshots


def _landed(w: Workload, rows: DataFrame, parts: int) -> DataFrame:
    """Rows as a stream of files, which arrive one after another by ``part``.

    The rows are computed once, in as many tasks as they take, and stored by part; the task that lands a part only copies it.
    """
    by_part, folder = scratch(w.spark, "parts"), scratch(w.spark, "landing")
    rows.repartition(parts, "part").write.partitionBy("part").parquet(by_part)
    stored = w.spark.read.schema(rows.schema).parquet(by_part).select(*rows.columns)
    for k in range(parts):
        stored.where(f"part = {k}").coalesce(1).write.mode("append").parquet(folder)
    return w.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@query("SELECT c_custkey AS member_id, CASE WHEN c_custkey % 3 = 0 THEN 'Late ' || c_name ELSE c_name END AS name, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS district FROM customer")
def member_upserts(w: Workload) -> DataFrame:
    """Members in three payloads of which the last changes a third; the last payload stands, nulls and all, and a repeated batch changes nothing."""
    k = F.col("c_custkey")
    first = w.table("customer").select(k.alias("member_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("district"), (k % 2).cast("int").alias("part"))
    again = first.where("member_id % 3 = 0").withColumn("name", F.concat(F.lit("Late "), "name")).withColumn("district", F.lit(None).cast("string")).withColumn("part", F.lit(2))
    path, rows = scratch(w.spark, "members"), first.unionByName(again)
    ledger.commit_stream(_landed(w, rows, 3), path, scratch(w.spark, "members-state"))
    ledger.commit(rows.where("part = 2"), path, 2)
    return ledger.committed(w.spark, path, rows.schema, ["member_id"], ["part"], True).drop("part")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS external_id, 'P' || o_orderkey % 7 AS ticker, o_totalprice AS amount FROM orders")
def award_ledger(w: Workload) -> DataFrame:
    """Award actions company by company, each twice; the first of each action stands."""
    k = F.col("o_orderkey")
    once = w.table("orders").select(k.cast("string").alias("external_id"), F.concat(F.lit("P"), (k % 7).cast("string")).alias("ticker"), F.col("o_totalprice").alias("amount"), (k % 3).cast("int").alias("part"))
    twice = once.unionByName(once.where("part < 2").withColumn("part", F.col("part") + 1).withColumn("amount", F.lit(-1.0)))
    path, to = scratch(w.spark, "awards"), scratch(w.spark, "awards-whole")
    ledger.commit_stream(_landed(w, twice, 3), path, scratch(w.spark, "awards-state"))
    ledger.compact(w.spark, path, to, twice.schema, ["external_id"], ["part"], False)
    return ledger.committed(w.spark, to, twice.schema, ["external_id"], ["part"], False).drop("part")


def _replaced(w: Workload) -> dict[str, DataFrame]:
    """Filings of even thousands read again, published as the second snapshot, and read back."""
    # rows, what is read again and findings are of the same trades
    every = settled(w.trades().drop("sector", "part_id", "flag"), "trades")
    t = every.select("filing_id", "txn_id", "ticker")
    read = t.where("filing_id % 2 = 0 AND ticker <> 'Brand#11'").withColumn("txn_id", F.col("txn_id") + 10**9)
    f, members = w.findings(every).select("finding_id", "member_id", "filing_id", "txn_id"), w.members().withColumn("anomaly_count", F.lit(0)).withColumn("disclosure_count", F.lit(0))
    root = scratch(w.spark, "snapshots")
    ledger.publish({"rows": t, "findings": f, "members": members}, root, 1)
    have = {name: ledger.snapshot(w.spark, root, name) for name in ("rows", "findings", "members")}
    ledger.publish(ledger.replace_filings(have["rows"], have["findings"], have["members"], w.filings(), read), root, 2)
    return {name: ledger.snapshot(w.spark, root, name) for name in have}


_REPLACED = """, rd AS (SELECT filing_id, txn_id + 1000000000 AS txn_id, ticker FROM t WHERE filing_id % 2 = 0 AND ticker <> 'Brand#11'),
gn AS (SELECT txn_id FROM t WHERE filing_id IN (SELECT filing_id FROM rd)), lf AS (SELECT finding_id, member_id, filing_id, txn_id FROM fnd WHERE txn_id IS NULL OR txn_id NOT IN (SELECT txn_id FROM gn))
"""


@query(_REPLACED + "SELECT filing_id, txn_id, ticker FROM rd UNION ALL SELECT filing_id, txn_id, ticker FROM t WHERE txn_id NOT IN (SELECT txn_id FROM gn)")
def reread_rows(w: Workload) -> DataFrame:
    return _replaced(w)["rows"]


@query(_REPLACED + "SELECT * FROM lf")
def reread_findings(w: Workload) -> DataFrame:
    return _replaced(w)["findings"]


@query(_REPLACED + "SELECT member_id, (SELECT count(*) FROM lf WHERE lf.member_id = mem.member_id) AS anomaly_count, (SELECT count(*) FROM fil WHERE fil.member_id = mem.member_id) AS disclosure_count FROM mem")
def reread_counts(w: Workload) -> DataFrame:
    return _replaced(w)["members"].select("member_id", "anomaly_count", "disclosure_count")


# ---------------------------------------------------------------- joins of streams


def _by_time(w: Workload, rows: DataFrame, time: str, batches: int) -> DataFrame:
    """Rows as a stream whose files come in the order of their time."""
    low, high = rows.agg(F.min(F.unix_timestamp(time)), F.max(F.unix_timestamp(time))).first()
    part = F.floor((F.unix_timestamp(time) - low) * batches / (high - low + 1)).cast("int")
    return _landed(w, rows.withColumn("part", part), batches).drop("part")


@query("SELECT own.txn_id, ev.event_id FROM own JOIN ev ON ev.member_id = own.member_id AND ev.ticker = own.ticker AND abs(traded_on - happened_on) <= 5")
def stream_window_join(w: Workload) -> DataFrame:
    """Trades and donations as two streams in the order of their days; rows meet as in the batch join."""
    t = settled(trades.own(w.trades()).select("txn_id", "member_id", "ticker", F.col("traded_on").cast("timestamp").alias("traded_at")))
    e = settled(w.events().select("event_id", "member_id", "ticker", F.col("happened_on").cast("timestamp").alias("happened_at")))
    days = F.unix_timestamp("at")
    low, high, n = t.select(F.col("traded_at").alias("at")).union(e.select(F.col("happened_at").alias("at"))).agg(F.min(days), F.max(days), F.count("*")).first()
    # more rows come in more batches of shorter times, so that a batch and the state stay of a size
    parts = min(max(4, n // BATCH_ROWS), MOST_BATCHES)
    part = lambda c: F.floor((F.unix_timestamp(c) - low) * parts / (high - low + 1)).cast("int")
    left, right = (_landed(w, df.withColumn("part", part(c)), parts).drop("part") for df, c in ((t, "traded_at"), (e, "happened_at")))
    # files of both sides come by equal parts of all time, so no row is later than a part
    delay = f"{(high - low) // parts // 86400 + 10} days"
    return streams.run_once(streams.window_join(left, right, ["member_id", "ticker"], 5, delay).select("txn_id", "event_id"))


@query("SELECT strftime(d, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS d FROM events) GROUP BY 1, 2")
def stream_hopping_counts(w: Workload) -> DataFrame:
    """Counts of two days, begun every day; files come in the order of time, so windows close and their state goes."""
    rows = w.table("events").select("event_type", F.col("ts").cast("timestamp").alias("at"))
    counts = streams.counts_by_window(_by_time(w, rows, "at", 4), "event_type", "at", DAY, "1 day")
    return streams.run_once(counts, "complete").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")

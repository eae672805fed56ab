"""Declared detectors, award support, ledgers and snapshots."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyworks.operators import registry, windows
from tallyworks.streaming import ledger


def day(n):
    return date(2024, 1, 1) + timedelta(days=int(n))


def test_windows_of_their_own(spark):
    rng = np.random.default_rng(2)
    rows = [(k, "ab"[k % 2], day(rng.integers(0, 600)), int(rng.choice([0, 1, 2, 3, 7, 8, 30, 31, 32, 200, 1000]))) for k in range(300)] + [(400, "a", None, 5), (401, "a", day(1), None), (402, None, day(1), 9), (403, "a", day(1), -1)]
    events = [("ab"[k % 2], day(rng.integers(-50, 900))) for k in range(40)] + [("a", None), (None, day(1)), ("a", day(1)), ("a", day(1))]
    left, right = spark.createDataFrame(rows, "id long, k string, d date, w long").repartition(3), spark.createDataFrame(events, "k string, e date")
    want = {i for i, k, d, w in rows if k and d and w is not None and any(k == j and e and d <= e <= d + timedelta(days=w) for j, e in events)}
    got = {r.id for r in windows.within_own_window(left, right, ["k"], "w", "d", "e").collect()}
    assert got == want and 50 < len(want) < 250
    assert {r.id for r in windows.within_own_window(left, right, ["k"], "w", "d", "e", anti=True).collect()} == {r[0] for r in rows} - want
    assert windows.within_own_window(left.where("false"), right, ["k"], "w", "d", "e").count() == 0
    assert windows.within_own_window(left, right.where("false"), ["k"], "w", "d", "e").count() == 0


def test_award_support(spark):
    found = spark.createDataFrame([(1, 1, 30.0), (2, 1, 9.0), (3, 1, None), (4, 9, 30.0), (5, None, 30.0), (6, 2, 30.0), (7, 3, 400.0), (8, 1, 10.9)], "finding_id long, txn_id long, threshold_value double")
    trades = spark.createDataFrame([(1, " ab ", day(0)), (2, "AB", None), (3, None, day(0))], "txn_id long, ticker string, traded_on date")
    awards = spark.createDataFrame([("AB", day(10), 5.0), ("AB", day(3), -5.0), (None, day(40), 1.0), ("AB", None, 1.0)], "ticker string, happened_on date, amount double")
    verdicts = lambda a: {r.finding_id: r.verdict for r in registry.award_support(found, trades, a).collect()}
    assert verdicts(awards) == {1: "supported", 2: "unsupported", 3: "supported", 4: "unjudged", 5: "unjudged", 6: "unjudged", 7: "supported", 8: "supported"}
    assert set(verdicts(awards.where("false")).values()) == {"unjudged"}  # nothing was read, so nothing is judged
    assert verdicts(awards.where("amount < 0"))[1] == "unsupported"  # what was read has no award


def test_disabled_detectors_read_nothing(spark):
    opened = []

    def table(name):
        opened.append(name)
        return spark.range(3).select(F.col("id").alias("member_id"), F.lit(1.0).alias("computed_value"))

    tables = {n: lambda n=n: table(n) for n in ("trades", "prices", "events")}
    same = lambda *dfs: dfs[0]
    declared = [registry.Detector("a", "trades", ("trades",), same), registry.Detector("b", "trades", ("trades", "events"), same), registry.Detector("perfect_timing", "prices", ("prices", "trades"), same)]
    found = registry.run(declared, tables)
    assert sorted(opened) == ["events", "trades"]  # the shared input once, the disabled one's never
    assert found.columns == list(registry.FINDING) and {(r.anomaly_type, r.n) for r in found.groupBy("anomaly_type").agg(F.count("*").alias("n")).collect()} == {("a", 3), ("b", 3)}
    opened.clear()
    assert registry.run(declared, tables, ["a", "b", "perfect_timing"]) is None and registry.source_rows(declared, tables, ["a", "b", "perfect_timing"]) is None and not opened
    tables["events"] = lambda: table("events").where("false")
    declared.append(registry.Detector("c", "events", ("events",), same))
    got = registry.source_rows(declared, tables)
    assert opened.count("trades") == 1 and sorted(map(tuple, got.collect())) == [("a", "trades", 3, False), ("b", "trades", 3, False), ("c", "events", 0, True)]
    members = spark.range(7).withColumnRenamed("id", "member_id")
    assert sorted(map(tuple, registry.summary(found, members, got).collect())) == [("a", 3, 3, 42.86, 3), ("b", 3, 3, 42.86, 3)]


@pytest.mark.parametrize("last", [True, False])
def test_a_repeated_batch_changes_nothing(spark, tmp_path, last):
    schema = "k long, v string, at int"
    path = str(tmp_path / "ledger")
    batches = [[(1, "a", 0), (2, "b", 0), (2, "c", 1)], [(1, None, 0), (3, "d", 0)], [(None, "x", 0), (None, "x", 1)]]
    frames = [spark.createDataFrame(b, schema) for b in batches]
    for n, df in enumerate(frames):
        ledger.commit(df, path, n)
    held = lambda where: sorted(((r.k or 0, r.v) for r in ledger.committed(spark, where, schema, ["k"], ["at"], last).collect()), key=repr)
    want = sorted([(1, None if last else "a"), (2, "c" if last else "b"), (3, "d"), (0, "x"), (0, "x")], key=repr)
    assert held(path) == want
    ledger.commit(frames[1], path, 1)
    assert held(path) == want
    ledger.compact(spark, path, str(tmp_path / "whole"), schema, ["k"], ["at"], last)
    assert held(str(tmp_path / "whole")) == want


def test_a_snapshot_counts_once_it_is_whole(spark, tmp_path):
    root = str(tmp_path)
    assert ledger.current(spark, root) is None
    ledger.publish({"a": spark.range(2), "b": spark.range(3)}, root, 1)
    spark.range(9).write.parquet(f"{root}/data/2/a")  # a publisher that ended before its marker
    assert ledger.current(spark, root) == 1 and ledger.snapshot(spark, root, "a").count() == 2
    ledger.publish({"a": spark.range(4), "b": spark.range(5)}, root, 2)
    assert [ledger.snapshot(spark, root, n).count() for n in "ab"] == [4, 5] and ledger.snapshot(spark, root, "a", 1).count() == 2


def test_filings_read_again(spark):
    rows = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "filing_id long, txn_id long")
    found = spark.createDataFrame([(1, 7, 10), (2, 7, 20), (3, 8, None)], "finding_id long, member_id long, txn_id long")
    members = spark.createDataFrame([(7, 0, 0), (8, 0, 0)], "member_id long, anomaly_count long, disclosure_count long")
    filings = spark.createDataFrame([(7, 1), (7, 2)], "member_id long, filing_id long")
    read = spark.createDataFrame([(1, 12)], "filing_id long, txn_id long")
    shown = lambda x: (sorted(map(tuple, x["rows"].collect())), sorted(r.finding_id for r in x["findings"].collect()), sorted(map(tuple, x["members"].select("member_id", "anomaly_count", "disclosure_count").collect())))
    assert shown(ledger.replace_filings(rows, found, members, filings, read)) == ([(1, 12), (2, 20)], [2, 3], [(7, 1, 2), (8, 1, 0)])
    assert shown(ledger.replace_filings(rows, found, members, filings, read.where("false"))) == ([(1, 10), (1, 11), (2, 20)], [1, 2, 3], [(7, 2, 2), (8, 1, 0)])


def test_landing_only_copies(spark):
    """What is landed was computed before, so no landing task sorts or aggregates; files come by part, one for an empty part too."""
    from tallyworks.plans.stored import _landed
    from tallyworks.plans.workload import Workload

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(40).selectExpr("id", "CAST(id % 4 AS INT) AS part").where("part <> 2").repartition(3).mapInArrow(count, "id long, part int")
    stream = _landed(Workload(spark, ""), rows, 4)
    assert seen.value == 30  # each row once, not once for each part
    got = []
    query = stream.writeStream.foreachBatch(lambda df, n: got.append(sorted(r.part for r in df.collect()))).option("checkpointLocation", str(__import__("tempfile").mkdtemp())).trigger(availableNow=True).start()
    query.awaitTermination()
    assert got == [[0] * 10, [1] * 10, [], [3] * 10]


def test_large_trades_are_kept_once(spark, sf):
    """Findings meet trades by id and by text; the trades are computed once, and a condition on the content does not change what is restated."""
    from tallyworks.operators import restatements, upkeep
    from tallyworks.plans.queries import QUERIES

    names = "txn_id long, member_id long, filing_id long, filed_on date, status string, traded_on date, direction string, asset string, ticker string, amount_min long, amount_max long, owner string"
    row = lambda k, filing=1, low=2_000_000, owner="Self", status="New", ticker="AB": (k, 7, filing, day(filing), status, day(0), "sale", f"asset {k % 4}", ticker, low, None, owner)
    rows = [row(1), row(2), row(3), row(4, low=5), row(5, owner="Spouse"), row(6, status="Deleted"), row(9, 2), row(10, 2), row(11, 2), row(12, 2, low=5), row(14, 3, ticker="CD"), row(18, 3, ticker="CD")]
    trades = spark.createDataFrame(rows, names).repartition(3)
    said = lambda t: f"Large transaction: {t} sale (more than $1,000,000)"
    stored = [(1, 7, 1, 1, "large_trade", "old"), (2, 7, 1, 4, "large_trade", "old"), (3, 7, 1, None, "large_trade", said("AB")), (4, 7, 1, None, "large_trade", said("AB")), (5, 7, 3, None, "large_trade", said("CD")), (6, 7, 3, 14, "late", "old"), (7, 7, 2, 9, "large_trade", "old"), (8, None, 1, None, None, None)]
    findings = spark.createDataFrame([(*x, "old") for x in stored], "finding_id long, member_id long, filing_id long, txn_id long, anomaly_type string, title string, description string")
    got = {r.finding_id: (r.txn_id, r.title, r.description != "old") for r in upkeep.sync_large_trades(findings, trades).collect()}
    # 9 to 11 repeat 1 to 3, so the finding of 9 stays; of 3 and 4 the latest takes trade 3
    assert got == {1: (1, said("AB"), True), 2: (4, "old", False), 3: (None, said("AB"), False), 4: (3, said("AB"), True), 5: (18, said("CD"), True), 6: (14, "old", False), 7: (9, "old", False), 8: (None, None, False)}
    of = (F.col("amount_min") > 1_000_000) & (F.col("owner") == "Self")
    ids = lambda df: sorted(r.txn_id for r in df.collect())
    assert ids(restatements.drop_restatements(trades, of=of)) == ids(restatements.drop_restatements(trades).where(of)) == [1, 2, 3, 14, 18]
    assert "lineitem" not in "".join(QUERIES["sync_large_trades"](spark, sf).inputFiles())


def test_findings_left_are_computed_once(spark):
    """Members are counted from the findings left as they were written; findings without a transaction stay and are in no join."""
    rows = spark.createDataFrame([(1, 10), (2, 20)], "filing_id long, txn_id long")
    found = spark.createDataFrame([(1, 7, 10), (2, 7, 20), (3, 8, None), (4, None, None)], "finding_id long, member_id long, txn_id long")
    members, filings = spark.createDataFrame([(7,), (8,)], "member_id long"), spark.createDataFrame([(7, 1)], "member_id long, filing_id long")
    out = ledger.replace_filings(rows, found, members, filings, rows.where("filing_id = 1"))
    assert "LeftAnti" not in out["members"]._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.finding_id for r in out["findings"].collect()) == [2, 3, 4]
    assert sorted(map(tuple, out["members"].collect())) == [(7, 1, 1), (8, 1, 0)]

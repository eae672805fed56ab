"""Boundary cases of the analytic operators on tiny tables."""

import re
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyworks.operators import findings, legislation, lookups, restatements, scores, stats, trades, wealth, windows

TRADE = "txn_id long, member_id long, filing_id long, filed_on date, filing_type string, traded_on date, direction string, ticker string, asset string, amount_min long, amount_max long, owner string, status string"
D0 = date(2024, 3, 1)


def day(n):
    return D0 + timedelta(days=n)


def trade(txn=1, member=1, filing=1, filed=10, kind="P", traded=0, direction="purchase", ticker="AB", asset="Abacus", low=1001, high=15000, owner="Self", status="New"):
    return (txn, member, filing, None if filed is None else day(filed), kind, None if traded is None else day(traded), direction, ticker, asset, low, high, owner, status)


def frame(spark, rows):
    return spark.createDataFrame(rows, TRADE)


def kept(spark, rows, **options):
    return sorted(r.txn_id for r in restatements.drop_restatements(frame(spark, rows), **options).collect())


def copies(filing, filed, names, start, **more):
    return [trade(txn=start + k, filing=filing, filed=filed, asset=n, **more) for k, n in enumerate(names)]


def test_duplicates_inside_one_filing_stay(spark):
    assert kept(spark, copies(1, 5, ["x", "x", "x", "x"], 1)) == [1, 2, 3, 4]


def test_two_shared_rows_stay_and_three_go(spark):
    assert kept(spark, copies(1, 5, "ab", 1) + copies(2, 9, "ab", 10)) == [1, 2, 10, 11]
    assert kept(spark, copies(1, 5, "abc", 1) + copies(2, 9, "abcd", 10)) == [1, 2, 3, 13]


def test_a_label_alone_suffices(spark):
    rows = copies(1, 5, "a", 1) + copies(2, 9, "a", 10, kind="Amendment")
    assert kept(spark, rows) == [1, 10]
    assert kept(spark, rows, label="filing_type") == [1]


def test_filings_without_a_date_come_last_and_members_are_apart(spark):
    assert kept(spark, copies(1, None, "abc", 1) + copies(2, 9, "abc", 10)) == [10, 11, 12]
    assert kept(spark, copies(1, 5, "abc", 1) + copies(2, 9, "abc", 10, member=2)) == [1, 2, 3, 10, 11, 12]


def test_original_once_amendment_twice_and_withdrawn_rows(spark):
    assert kept(spark, copies(1, 5, "abc", 1) + copies(2, 9, "aabbcc", 10)) == [1, 2, 3, 11, 13, 15]
    assert kept(spark, [trade(txn=1, status="Deleted"), trade(txn=2, status=None)]) == [2]


def test_ticker_case_is_one_content_and_null_is_not_a_text(spark):
    rows = copies(1, 5, "abc", 1, ticker="ab ") + copies(2, 9, "abc", 10, ticker="AB")
    assert kept(spark, rows) == [1, 2, 3]
    rows = copies(1, 5, "abc", 1, ticker=None) + copies(2, 9, "abc", 10, ticker="")
    assert len(kept(spark, rows)) == 6


def test_multiset_difference_keeps_nulls_apart(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("b", 4)], "k string, n long")
    right = spark.createDataFrame([("a",), (None,)], "k string")
    assert sorted(r.n for r in restatements.multiset_difference(left, right, ["k"]).collect()) == [2, 4]


def test_compliance_on_the_deadline_and_one_over(spark):
    rows = [trade(txn=k, filed=f) for k, f in enumerate([45, 46, 145, None, 0])]
    got = scores.compliance(frame(spark, rows)).first()
    assert (got.checkable, got.late, got.on_time) == (4, 2, 2)
    assert (got.mean_overdue, got.median_overdue, got.max_overdue, got.late_value) == (50.5, 50.5, 100, 30000)
    assert got.worst_filing == 1
    assert scores.compliance_leaderboard(frame(spark, rows)).count() == 0
    assert scores.compliance(frame(spark, [trade(filing=5, filed=9)])).first().worst_filing is None
    ties = [trade(txn=1, filing=8, filed=60), trade(txn=2, filing=7, filed=60), trade(txn=3, filing=9, filed=50)]
    assert scores.compliance(frame(spark, ties)).first().worst_filing == 7


def test_reports_are_scored_without_annual_filings_and_restatements(spark):
    first, again = copies(1, 40, "abc", 10), copies(2, 200, "abc", 20)
    rows = frame(spark, first + again + copies(3, 300, "xyz", 30)).withColumn("is_ptr", F.col("filing_id") != 3)
    got = scores.compliance(scores.reported(rows)).first()
    assert (got.checkable, got.late, got.worst_filing) == (3, 0, None)
    two = frame(spark, first[:2] + [t[:4] + ("Amendment",) + t[5:] for t in again[:2]]).withColumn("is_ptr", F.lit(True))
    assert scores.late_rate(scores.reported(two)).first().checkable == 2  # the label alone suffices
    assert scores.late_rate(scores.reported(two, label=None)).first().late == 2
    assert scores.late_rate(frame(spark, [])).first().late_rate is None


@pytest.mark.parametrize("gap,found", [(90, 1), (-90, 1), (91, 0), (-91, 0), (0, 1)])
def test_event_window(spark, gap, found):
    events = spark.createDataFrame([(7, 1, "AB", day(gap))], "event_id long, member_id long, ticker string, happened_on date")
    got = windows.event_window_join(frame(spark, [trade()]), events, ["member_id", "ticker"], 90, 90).collect()
    assert [r.days_apart for r in got] == [abs(gap)] * found
    assert windows.within_window(frame(spark, [trade()]), events, ["ticker"], 90, 90, "traded_on").count() == found
    assert windows.within_window(frame(spark, [trade()]), events, ["ticker"], 90, 90, "traded_on", anti=True).count() == 1 - found


def test_event_window_joins_every_pair_once(spark):
    events = spark.createDataFrame([(k, "AB", day(k)) for k in range(-40, 41)], "event_id long, ticker string, happened_on date")
    rows = frame(spark, [trade(txn=k, traded=k) for k in range(10)])
    got = windows.event_window_join(rows, events, ["ticker"], 30, 0)
    want = sum(0 <= e - t <= 30 for t in range(10) for e in range(-40, 41))
    assert got.count() == got.select("txn_id", "event_id").distinct().count() == want


def run_of(spark, days, directions=None, **options):
    rows = [trade(txn=k, traded=d, direction=(directions or ["purchase"] * len(days))[k]) for k, d in enumerate(days)]
    return windows.same_direction_runs(frame(spark, rows), **options).collect()


def test_runs(spark):
    assert run_of(spark, [0, 10, 20, 30, 45])[0].length == 5
    assert run_of(spark, [0, 10, 20, 30, 46]) == []
    assert run_of(spark, [0, 1, 2, 3, 4], ["purchase"] * 4 + ["sale"]) == []
    assert run_of(spark, [0, 1, 2, 2, 3, 4], ["purchase", "purchase", "purchase", "sale", "purchase", "purchase"]) == []
    got = run_of(spark, [0, 0, 0, 0, 0, 100, 101, 102, 103, 104])[0]
    assert (got.length, got.span_days, got.days) == (5, 0, 1)


def test_distinct_in_window_and_clusters(spark):
    rows = [trade(txn=k, member=m, traded=d) for k, (m, d) in enumerate([(1, 0), (2, 5), (3, 14), (1, 14), (4, 15), (5, 40)])]
    got = {r.day: r.n for r in windows.distinct_in_window(frame(spark, rows), ["ticker"], "member_id", "traded_on", 14).collect()}
    assert got == {day(0): 1, day(5): 2, day(14): 3, day(15): 4, day(40): 1}
    cluster = windows.member_clusters(frame(spark, rows)).collect()
    assert [(c.members, c.ever, c.concentration, c.ubiquity, c.member_ids, c.severity) for c in cluster] == [(4, 5, 0.8, 1.0, [1, 2, 3, 4], "MEDIUM")]
    assert (cluster[0].first_day, cluster[0].last_day) == (day(5), day(15))  # from the window's first trade, not 14 days back
    assert windows.member_clusters(frame(spark, rows[:4])).count() == 0
    popular = rows + [trade(txn=50 + k, member=50 + k, traded=200 + 20 * k, direction="sale") for k in range(5)]
    assert windows.member_clusters(frame(spark, popular)).count() == 0
    assert windows.member_clusters(frame(spark, [trade(txn=k, member=k, direction="exchange") for k in range(9)])).count() == 0


def test_bh(spark):
    def q(values):
        t = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "test_id long, p_value double")
        return [None if r.q_value is None else round(r.q_value, 10) for r in findings.bh_qvalues(t).orderBy("test_id").collect()]

    assert q([0.01, 0.02, 0.03, 0.9]) == [0.04, 0.04, 0.04, 0.9]
    assert q([0.01, 0.04, 0.04]) == [0.03, 0.04, 0.04]
    assert q([]) == []
    assert q([0.9, None, 0.95]) == [0.95, None, 0.95]


FINDING = "finding_id long, member_id long, anomaly_type string, severity string, title string, description string, filing_id long, txn_id long, computed_value double, threshold_value double"


def finding(k, value=1.0, kind="x", txn=None, title="t", member=1):
    return (k, member, kind, "low", title, None, 1, txn, value, 0.0)


def test_percentiles(spark):
    rows = spark.createDataFrame([finding(k, float(min(k, 5))) for k in range(10)] + [finding(99, 3.0, kind="few")], FINDING)
    got = {r.finding_id: (r.percentile_rank, r.severity) for r in findings.percentile_ranks(rows).collect()}
    assert got[0] == (10.0, "low") and got[4] == (50.0, "medium") and got[5] == got[9] == (100.0, "high")
    assert got[99] == (None, "low")


def test_persist_and_retract(spark):
    stored = spark.createDataFrame([finding(1, txn=7), finding(2, title="known")], FINDING)
    new = spark.createDataFrame([finding(3, txn=7), finding(4, txn=8), finding(5, txn=8), finding(6, title="known"), finding(7, title="n" * 300), finding(8, kind="perfect_timing"), finding(9, member=None)], FINDING)
    got = findings.persist(new, stored, ["finding_id"]).orderBy("finding_id").collect()
    assert [r.finding_id for r in got] == [4, 7] and len(got[1].title) == 200
    left = lambda derived: sorted(r.finding_id for r in findings.retract(stored, derived, ["x"]).collect())
    assert left(new.where("finding_id = 3")) == [1]
    assert left(new.where("false")) == [1, 2]


def test_upserts(spark):
    stored = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, name string, n int")
    payload = spark.createDataFrame([(1, None, 5, 1), (1, "z", None, 2), (3, "c", None, 3)], "id long, name string, n int, at int")
    got = {r.id: (r.name, r.n) for r in findings.fold_upsert(stored, payload, ["id"], "at").collect()}
    assert got == {1: ("z", 5), 2: ("b", 2), 3: ("c", None)}
    fresh = spark.createDataFrame([("s", "1", 1), ("s", "2", 2), ("s", "2", 3), ("s", None, 4), ("s", None, 5)], "source string, external_id string, n int")
    got = findings.insert_new(fresh.where("n = 1"), fresh, ["source", "external_id"], ["n"])
    assert sorted(r.n for r in got.collect()) == [2, 4, 5]


def naive_shift(trades, events, offset, span, before, after):
    """Pairs in the window after all trades are shifted, lane by lane."""
    return sum(n * m * (-before <= (t + offset) % span - e <= after) for k, t, n in trades for j, e, m in events if k == j)


@pytest.mark.parametrize("low", [0, -700])
def test_shifted_pairs_are_those_of_a_plain_count(low):
    rng = np.random.default_rng(6)
    for before, after in ((5, 5), (30, 0), (400, 400)):
        trades = [(int(k), int(t), int(n)) for k, t, n in zip(rng.integers(0, 4, 40), rng.integers(0, 300, 40), rng.integers(1, 4, 40))] + [(0, 300, 1)]
        events = [(int(k), int(t), int(n)) for k, t, n in zip(rng.integers(0, 3, 15), rng.integers(0, 301, 15), rng.integers(1, 3, 15))]
        offsets = np.concatenate([[0.0, 1.0, 299.0], rng.uniform(0, 300, 25)])
        (lane, t, n), (other, e, m) = (map(np.array, zip(*x)) for x in (trades, events))
        lanes = stats._Lanes(other, e + low, m, 4)
        every = np.ones(len(t), dtype=np.int64)
        whole = np.tile(offsets.astype(np.int64), (len(t), 1))
        got = stats.shifted_pairs(lanes, lane, t + low, n, every * low, every * 300, whole, np.tile(offsets, (len(t), 1)) > whole, before, after).sum(axis=0)
        assert got.tolist() == [naive_shift(trades, events, o, 300.0, before, after) for o in offsets]


def plain_pvalue(detector, member, trades, events, permutations):
    """The p-value of (key, day) trades among (key, day) events, one loop after another."""
    before, after, _ = stats.DETECTORS[detector]
    events = [(k, d) for k, d in events if k in {j for j, _ in trades}]
    trades = [(k, d) for k, d in trades if k in {j for j, _ in events}]
    days = [d for _, d in trades + events]
    low, span = min(days), max(days) - min(days)
    offsets = np.concatenate([np.random.default_rng(stats.seed_of(detector, member, p)).uniform(0, span, min(stats.PART, permutations - p * stats.PART)) for p in range((permutations - 1) // stats.PART + 1)])
    plain = [(k, d - low, 1) for k, d in trades]
    those = [(k, d - low, 1) for k, d in events]
    observed = sum(-before <= t - e <= after for k, t, _ in plain for j, e, _ in those if j == k)
    return observed, (1 + sum(naive_shift(plain, those, o, float(span), before, after) >= observed for o in offsets)) / (permutations + 1)


@pytest.mark.parametrize("chunk,large", [(1 << 14, 5000), (16, 20)])
def test_pvalues_of_planted_groups(spark, monkeypatch, chunk, large):
    """Members with planted coincidences and without, keys that many share, large tests and small chunks."""
    monkeypatch.setattr(stats, "CHUNK", chunk)
    monkeypatch.setattr(stats, "LARGE", large)
    rng = np.random.default_rng(12)
    events = [("a", int(d)) for d in rng.integers(0, 4000, 60)] + [("b", int(d)) for d in rng.integers(0, 4000, 8)] + [("unmet", 9)]
    trades = {m: [(k, int(d)) for k in "abc" for d in rng.integers(0, 4000, 12)] for m in (1, 2, 3)}
    trades[4] = [("b", d + 3) for k, d in events if k == "b"]  # each trade three days after an event
    trades[5] = [("b", 100)]
    rows = [(d, m, k, True, t) for d in ("lobbying_overlap", "contract_front_run") for m, x in trades.items() for k, t in x]
    rows += [(d, None, k, False, t) for d in ("lobbying_overlap", "contract_front_run") for k, t in events]
    found = spark.createDataFrame(rows, "detector string, member_id long, key string, is_trade boolean, day long").groupBy("detector", "member_id", "key", "is_trade", "day").agg(F.count("*").alias("n"))
    got = {(r.detector, r.member_id): (r.observed, round(r.p_value, 9)) for r in stats.permutation_pvalues(found, permutations=300).collect()}
    want = {(d, m): plain_pvalue(d, m, x, events, 300) for d in ("lobbying_overlap", "contract_front_run") for m, x in trades.items()}
    assert got == {k: (n, round(p, 9)) for k, (n, p) in want.items() if n}
    assert got["lobbying_overlap", 4][1] < stats.ALPHA and max(p for _, p in got.values()) > 0.1


def test_permutation_pvalues(spark):
    def p(rows, **options):
        s = spark.createDataFrame([("donor_conflict", 1, k, t, d, 1) for k, t, d in rows], "detector string, member_id long, key string, is_trade boolean, day long, n long")
        return stats.permutation_pvalues(s, **({"permutations": 300} | options)).collect()

    apart = [100, 1337, 2512, 4781, 7903]
    near = [("a", True, d) for d in apart] + [("a", False, d + 90) for d in apart]
    got = p(near)[0]
    assert got.observed == 5 and got.p_value < 0.05
    assert p(near) == p(near) and p(near + [("b", False, 100)])[0].observed == 5  # keys do not mix
    assert p([("a", True, 1), ("a", True, 9), ("a", False, 3)])[0].p_value is None  # the span is too short
    assert p([("a", True, 1), ("a", False, 92)]) == []  # no pair, no test
    rng = np.random.default_rng(1)
    far = [[("a", on, int(d)) for on, size in ((True, 20), (False, 30)) for d in rng.integers(0, 3000, size)] for _ in range(5)]
    assert sum(p(x)[0].p_value > 0.05 for x in far) >= 4
    assert stats.resolvable(50, 1000) and not stats.resolvable(51, 1000) and stats.resolvable(0)


def test_streams_and_observed_pairs(spark):
    rows = frame(spark, [trade(txn=1, traded=0), trade(txn=2, traded=0, direction="sale"), trade(txn=3, traded=50), trade(txn=4, member=2, traded=5), trade(txn=5, ticker=" ab ", traded=3), trade(txn=6, ticker=None)])
    events = spark.createDataFrame([("AB", day(30)), ("AB", day(2)), ("ZZ", day(1)), (None, day(1))], "ticker string, happened_on date")
    counted = lambda d, e: sorted((r.member_id, r.observed) for r in stats.observed_pairs(stats.streams(d, rows, e, "ticker")).collect())
    assert counted("lobbying_overlap", events) == [(1, 7), (2, 2)]
    assert counted("contract_front_run", events) == [(1, 3), (2, 1)]  # purchases, the award on or after the trade
    own = events.withColumn("member_id", F.lit(2).cast("long"))
    assert counted("donor_conflict", own) == [(2, 2)]


def planted(spark):
    rng = np.random.default_rng(5)
    keys = {"a": 70, "b": 8, "c": 1}
    rows = [(d, None, k, False, int(t)) for d in stats.DETECTORS for k, n in keys.items() for t in rng.integers(0, 2000, n)]
    rows += [(d, m, k, True, int(t)) for d in stats.DETECTORS for m in range(9) for k in "abc"[: m % 3 + 1] for t in rng.integers(0, 2000, 3 * m + 1)]
    rows += [("lobbying_overlap", 20, "short", True, 100), ("lobbying_overlap", None, "short", False, 101)]
    return spark.createDataFrame(rows, "detector string, member_id long, key string, is_trade boolean, day long").withColumn("n", F.lit(1).cast("long"))


@pytest.mark.parametrize("sparse,pairs,chunk,some", [(0, 0, 1 << 14, 256), (8, 1 << 13, 1 << 14, 3), (100, 1 << 13, 7, 2), (100, 150, 1 << 14, 256)])
def test_pvalues_do_not_depend_on_the_way_in_which_pairs_are_counted(spark, monkeypatch, sparse, pairs, chunk, some):
    """Tests by key, by pairs, and some of each, in one piece and in many."""
    found = planted(spark)
    want = sorted(map(tuple, stats.permutation_pvalues(found, permutations=300).collect()))
    for name, value in (("SPARSE", sparse), ("PAIRS", pairs), ("CHUNK", chunk), ("SOME", some)):
        monkeypatch.setattr(stats, name, value)
    assert sorted(map(tuple, stats.permutation_pvalues(found, permutations=300).collect())) == want
    assert ("lobbying_overlap", 20, 1, None) in want and len({d for d, *_ in want}) == 5


def test_keys_with_few_events_are_not_counted_once_a_permutation(spark, monkeypatch):
    """Only tests with full keys shift every trade once for each permutation."""

    def never(permutations):
        raise AssertionError("counted by permutation")

    monkeypatch.setattr(stats, "_permuted", never)
    assert stats.permutation_pvalues(planted(spark).where("key <> 'a'")).count() > 20


@pytest.mark.parametrize("low", [0, 17])
def test_steps_of_a_test_are_those_of_a_plain_count(low):
    """Offsets of whole days and of none, windows that reach over an end of the span."""
    rng = np.random.default_rng(3)
    trades, events = ([("k", int(t), 2) for t in np.append(rng.integers(0, 301, 12), [0, 300])], [("k", int(t), 3) for t in np.append(rng.integers(0, 301, 9), [0, 300])])
    offsets = np.sort(np.concatenate([[0.0, 1.0, 299.0], rng.uniform(0, 300, 25)]))
    for before, after in ((30, 0), (7, 7), (200, 160)):
        t, e = (x.ravel() for x in np.meshgrid([t for _, t, _ in trades], [e for _, e, _ in events], indexing="ij"))
        every = np.ones(len(t), dtype=np.int64)
        days = offsets.astype(np.int64)
        drawn = (2 * days + (offsets > days))[None]
        got = np.cumsum(stats._steps({"event": e + low, "day": t + low, "low": every * low, "span": every * 300, "n": every * 6}, every * 0, drawn, before, after)[0, :-1])
        assert got.tolist() == [naive_shift(trades, events, o, 300.0, before, after) for o in offsets]


def test_observed_pairs_move_rows_to_their_key_once(spark):
    """(F8) One exchange by key, one by member; the steps are not joined back to the trades."""
    plan = stats.observed_pairs(planted(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan


def most_members(rows, days):
    return max(len({m for m, d in rows if end - days <= d <= end}) for _, end in rows)


def test_most_members_is_that_of_a_plain_count():
    rng = np.random.default_rng(7)
    who, day_ = np.sort(rng.integers(0, 9, 60)), rng.integers(0, 200, 60).astype(float)
    offsets = np.concatenate([np.zeros((1, 9)), rng.integers(0, 200, (20, 9)), rng.uniform(0, 200, (20, 9))])
    got = stats._most_members(who, day_, offsets, 200.0, 14)
    assert got.tolist() == [most_members(list(zip(who, (day_ + o[who]) % 200)), 14) for o in offsets]


def test_events_go_to_few_groups_however_many_members_trade_the_key(spark, monkeypatch):
    import pyarrow as pa

    def events_only(permutations):
        def run(batches):
            n = sum(b.num_rows - sum(b.column("is_trade").to_pylist()) for b in batches)
            yield pa.RecordBatch.from_arrays([pa.array(["lobbying_overlap"]), pa.array([0], pa.int64()), pa.array([n], pa.int64())], names=["detector", "member_id", "reached"])

        return run

    monkeypatch.setattr(stats, "_permuted", events_only)
    trades = spark.range(600).selectExpr("id % 300 AS member_id", "date_add(DATE '2020-01-01', CAST(id AS INT) % 200) AS traded_on", "'purchase' AS direction", "'AB' AS ticker")
    events = spark.range(20).selectExpr("date_add(DATE '2020-01-01', CAST(id AS INT) * 10) AS happened_on", "'AB' AS ticker")
    found = stats.permutation_pvalues(stats.streams("lobbying_overlap", trades, events, "ticker"))
    assert round(found.where("member_id = 0").first().p_value * 1001) - 1 == 20


@pytest.mark.parametrize("rows, members, span", [(40, 12, 200), (300, 250, 90), (5000, 900, 365), (6, 1, 30)])
def test_members_reach_what_ordered_days_say(rows, members, span):
    """Counts by bins agree with the days put in order, at and around the largest count."""
    rng = np.random.default_rng(rows)
    who, day = rng.integers(0, members, rows), rng.integers(0, span + 1, rows)
    day[:2] = 0, span
    who = np.unique(who, return_inverse=True)[1]
    group = stats._Members(who, day, span, 14)
    for offsets in rng.uniform(0, span, (30, who.max() + 1)):
        most = stats._most_members(who, day.astype(float), offsets[None], float(span), 14)[0]
        assert [group.reach(offsets, int(most) + k) for k in (-1, 0, 1, 2)] == [True, True, False, False]


def test_cluster_pvalues(spark):
    rows = [trade(txn=k, member=k, traded=500) for k in range(6)] + [trade(txn=100 + k, member=k, traded=40 * k) for k in range(12)]
    got = stats.cluster_pvalues(frame(spark, rows), permutations=300).collect()
    assert [g.observed for g in got] == [6] and got[0].p_value < 0.05
    assert stats.cluster_pvalues(frame(spark, rows[:3] + rows[6:]), permutations=300).count() == 0  # under the bar


def test_findings_inherit_from_their_test(spark):
    members = spark.createDataFrame([("donor_conflict", 1, 0.01), ("donor_conflict", 2, 0.04), ("lobbying_overlap", 1, 0.04)], "detector string, member_id long, p_value double")
    clusters = spark.createDataFrame([("AB", 0.9), ("AB", 0.8), ("CD", None)], "ticker string, p_value double")
    tests = stats.family(members, clusters)
    assert tests.count() == 5
    kinds = [("donor_conflict", 1, "t"), ("donor_conflict", 3, "t"), ("late_filing", 1, "t"), ("cross_member_cluster", 9, "5 members bought ab within 3 days"), ("cross_member_cluster", 9, "5 members bought ABC within 3 days"), ("cross_member_cluster", 9, None)]
    rows = spark.createDataFrame([finding(k, kind=t, member=m, title=x) for k, (t, m, x) in enumerate(kinds)], FINDING).selectExpr("*", "0.5D AS p_value", "0.5D AS q_value")
    got = {r.finding_id: (r.p_value, r.q_value and round(r.q_value, 6)) for r in stats.annotate(rows, tests).collect()}
    assert got == {0: (0.01, 0.05), 1: (None, None), 2: (None, None), 3: (0.8, 0.9), 4: (None, None), 5: (None, None)}
    run = stats.significance_run(stats.annotate(rows, tests), tests).first()
    assert (run.tests, run.passing, run.annotated, run.without_test, run.resolvable) == (5, 1, 2, 4, True)


def test_annotation_does_not_follow_the_order_in_which_findings_are_computed(spark):
    """Rows that arrive in another order each time they are computed, as after a shuffle, keep their own values."""
    rows = spark.range(400).selectExpr("id AS finding_id", "IF(id % 2 = 0, 'donor_conflict', 'cross_member_cluster') AS anomaly_type", "id AS member_id", "concat('T', id, ' was bought') AS title").coalesce(1)
    shuffled = rows.mapInPandas(lambda frames: (f.sample(frac=1) for f in frames), rows.schema)
    tests = spark.range(400).selectExpr("IF(id % 2 = 0, 'donor_conflict', 'cross_member_cluster') AS anomaly_type", "IF(id % 2 = 0, id, NULL) AS member_id", "IF(id % 2 = 1, concat('T', id), NULL) AS ticker", "id / 1000.0D AS p_value", "id / 500.0D AS q_value")
    got = stats.annotate(shuffled, tests).collect()
    assert len(got) == 400 and all(r.p_value == r.finding_id / 1000 and r.q_value == r.finding_id / 500 for r in got)


def test_company_names(spark):
    register = spark.createDataFrame([(0, "LOCKHEED MARTIN CORP", "LMT"), (1, "NORTHROP GRUMMAN CORP /DE/", "NOC"), (2, "UNIVERSAL CORP", "UVV"), (3, "Archer Aviation Inc.", "ACHR"), (4, "Archer Aviation Parts Inc.", "APAR")], "position int, title string, ticker string")
    over = spark.createDataFrame([(0, "bechtel", ""), (1, "electric boat", "GD")], "position int, fragment string, ticker string")
    names = spark.createDataFrame([(n,) for n in ["Lockheed Martin Corporation", "Northrop Grumman Systems Corp", "Universal Synaptics", "ARCHER AVIATION", "Bechtel National Inc", "Electric Boat Corp", "", None]], "name string")
    got = {r.name: r.ticker for r in lookups.resolve_companies(names, register, overrides=over).collect()}
    assert got["Lockheed Martin Corporation"] == "LMT" and got["Northrop Grumman Systems Corp"] == "NOC"
    assert got["Universal Synaptics"] is None and got["ARCHER AVIATION"] == "ACHR"
    assert got["Bechtel National Inc"] is None and got["Electric Boat Corp"] == "GD"


def test_filers(spark):
    roster = spark.createDataFrame([(1, "McClain Delaney", "April", "MD", "6", True), (2, "Delaney", "John", "MD", "6", False), (3, "Luján", "Ben Ray", "NM", None, True), (4, "Smith", "Adam", "WA", "9", True), (5, "Smith", "Alex", "WA", "3", True)], "member_id long, last string, first string, state string, district string, in_office boolean")
    filers = spark.createDataFrame([(10, "Delaney", "April McClain", "MD", "06"), (11, "LUJAN", "BEN RAY", "NM", None), (12, "Smith, Jr.", "A", "WA", "09"), (13, "Nobody", "N", "WA", "1")], "filer_id long, last string, first string, state string, district string")
    got = {r.filer_id: r.member_id for r in lookups.match_filers(filers, roster).collect()}
    assert got == {10: 1, 11: 3, 12: 4}
    assert {r.filer_id for r in lookups.match_senators(filers, roster).collect()} >= {11}
    assert [r.filings for r in lookups.unmatched(filers, lookups.match_filers(filers, roster)).collect()] == [1]


def test_sectors_by_tiers(spark):
    h = spark.createDataFrame([(1, "LMT", "x"), (2, "ZZZ", "x"), (3, None, "Regional bank shares"), (4, "QQQ", "Alibaba")], "txn_id long, ticker string, asset string")
    curated = spark.createDataFrame([("LMT", "defense")], "ticker string, sector string")
    industries = spark.createDataFrame([("ZZZ", "6324"), ("LMT", "2911")], "ticker string, sic string")
    sic = spark.createDataFrame([("63", "finance"), ("6324", "healthcare"), ("29", "energy")], "prefix string, sector string")
    got = sorted((r.txn_id, r.sector) for r in lookups.ticker_sectors(h, curated, industries, sic, {"finance": ["bank"], "none": ["ba"]}).collect())
    assert got == [(1, "defense"), (2, "healthcare"), (3, "finance")]
    seats = spark.createDataFrame([(1, "HSAS02"), (2, "HSIF"), (3, "XX")], "member_id long, committee_id string")
    remits = spark.createDataFrame([("HSAS", "defense"), ("HSIF", "energy"), ("HSIF", "healthcare")], "committee_id string, sector string")
    assert sorted((r.member_id, r.sector) for r in lookups.committee_sectors(seats, remits).collect()) == [(1, "defense"), (2, "energy"), (2, "healthcare")]


def test_trades_near_bills_count_once_per_bill(spark):
    rows = frame(spark, [trade(txn=1, traded=3), trade(txn=2, traded=61)])
    t = rows.withColumn("sector", F.explode(F.array(F.lit("energy"), F.lit("finance"))))
    bills = spark.createDataFrame([(1, 5, s, day(0)) for s in ("energy", "finance")], "member_id long, bill_id long, sector string, happened_on date")
    got = legislation.sponsorship_window(t, bills).collect()
    assert [(g.trades, g.closest, g.tickers, g.severity) for g in got] == [(1, 3, "AB", "HIGH")]


def test_a_referral_is_not_multiplied_by_the_seats_of_its_committee(spark):
    """Referrals meet the trades of a committee, on its key: no join makes a row for each referral and each seat."""
    trades = spark.range(300).selectExpr("id AS member_id", "id AS txn_id", "'AB' AS ticker", "concat('s', id % 1) AS sector", "date_add(DATE '2020-01-01', CAST(id % 1 AS INT)) AS traded_on")
    referrals = spark.range(40).selectExpr("id AS referral_id", "'HS01' AS committee_id", "concat('s', id) AS sector", "date_add(DATE '2020-01-05', CAST(id % 1 AS INT)) AS happened_on")
    seats = spark.range(300).selectExpr("id AS member_id", "'hs0100' AS committee_id")
    found = legislation.jurisdiction_window(trades, referrals, seats)
    assert [(r.trades, r.closest, r.tickers) for r in found.select("trades", "closest", "tickers").distinct().collect()] == [(1, 4, "AB")] and found.count() == 300
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert len(joins) == 2 and sum("sector" in line for line in joins) == 1
    assert all("sector" in line for line in joins if "parent" in line)


def test_wealth_bands(spark):
    filings = spark.createDataFrame([(1, 1, 2020, D0, False, "A", True), (2, 1, 2022, day(700), False, "A", True), (3, 1, 2022, day(700), True, "A", True), (4, 2, 2022, D0, False, "C", True)], "filing_id long, member_id long, filing_year int, filed_on date, is_ptr boolean, filing_type string, parsed boolean")
    assets = spark.createDataFrame([(1, 1000, 2000), (2, 9_000_000, None), (3, 5, 6), (4, 5, 6)], "filing_id long, value_min long, value_max long")
    debts = spark.createDataFrame([(1, 100, 300)], "filing_id long, amount_min long, amount_max long")
    worth = {r.filing_id: (r.low, r.high, r.mid) for r in wealth.net_worth(filings, assets, debts).collect()}
    assert worth == {1: (700, 1900, 1300.0), 2: (9_000_000, 0, None)}
    progress = wealth.wealth_progression(filings.where("NOT is_ptr AND member_id = 1"), assets, debts)
    assert {r.filing_id: r.estimate for r in progress.collect()} == {1: 1300.0, 2: None}
    year = spark.createDataFrame([(1, "a", 2020, 10, 20), (1, "a", 2021, 50, 60), (1, "b", 2020, 10, 20), (1, "b", 2022, 50, 60)], "member_id long, asset_key string, year int, value_min long, value_max long")
    assert [(r.asset_key, r.percent) for r in wealth.asset_appreciation(year).collect()] == [("a", 150.0)]
    span = spark.createDataFrame([(2019, 2022)], "first_year int, last_year int")
    assert span.select(wealth.salaries()).first()[0] == 174000 * 2 + 180000 + 193500


def test_detectors(spark):
    pairs = trades.buy_sell_pairs(frame(spark, [trade(txn=1, traded=0), trade(txn=2, traded=5), trade(txn=3, traded=5, direction="sale"), trade(txn=4, traded=6, direction="sale")]), ["member_id"]).first()
    assert (pairs.buys, pairs.sales, pairs.pairs) == (2, 2, 3)
    rows = [trade(txn=1, filing=1, filed=60, high=60000), trade(txn=2, filing=2, filed=61, high=60000), trade(txn=3, filing=3, filed=200, high=40000), trade(txn=4, filing=4, filed=200, high=60000, status="Amended"), trade(txn=5, filing=5, filed=200, high=60000, owner="Spouse")]
    rows += [trade(txn=6, filing=6, filed=300, high=90000), trade(txn=7, filing=7, filed=300, high=90000), *copies(2, 61, "ghi", 20, high=90000), *copies(8, 250, "ghi", 30, high=90000)]
    made = frame(spark, rows).withColumn("is_ptr", F.col("filing_id") != 6).withColumn("parsed", F.col("filing_id") != 7)
    late = trades.late_filings(made)
    assert sorted((r.txn_id, r.severity, r.threshold_value) for r in late.collect()) == [(2, "low", 45), (5, "high", 45), (20, "low", 45), (21, "low", 45), (22, "low", 45)]
    big = trades.large_trades(frame(spark, [trade(txn=1, low=1_000_001), trade(txn=2, low=1_000_000), trade(txn=3, low=50_000_001), trade(txn=4, low=9_000_001, owner="Spouse")]))
    assert sorted((r.txn_id, r.severity) for r in big.collect()) == [(1, 5), (3, 10)]
    spikes = trades.volume_spikes(frame(spark, [trade(txn=k, low=10, high=10) for k in range(8)] + [trade(txn=50 + k, low=51, high=51) for k in range(2)])).collect()
    assert [(s.n, s.above, s.threshold) for s in spikes] == [(10, 2, 50.0)]


def test_trades_travel_twice_and_contents_are_short(spark, sf):
    from tallyworks.plans.workload import Workload

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        trades = Workload(spark, sf).trades()
        plan = trades._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # lines to parts and to orders; parts and orders; nothing more for their numbers
    assert plan.count("Exchange hashpartitioning") == 4
    assert trades.select(F.max(F.length(restatements.content_key()))).first()[0] == 16


def test_prefixes_of_codes_are_not_broadcast(spark, sf):
    """Exploded codes of a small file stay dealt over tasks, in the first plan too."""
    from tallyworks.operators import lookups

    codes = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey AS code")
    table = spark.createDataFrame([("1", "one"), ("12", "twelve")], "prefix string, sector string")
    found = lookups.longest_prefix(codes, table, "code", "prefix")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [__p" in plan and "BroadcastHashJoin [__p" not in plan
    got = {r.code: r.sector for r in found.where("code IN (1, 12, 13, 2)").collect()}
    assert got == {1: "one", 12: "twelve", 13: "one", 2: None}


def test_pairs_of_trades_and_referrals_stay_at_their_committee(spark, monkeypatch):
    """Trades and referrals travel, not their pairs, but for members of several committees; all are counted alike."""
    monkeypatch.setattr(legislation, "PAIRS", 40)
    rng = np.random.default_rng(9)
    names = ["AB", "cd", None, "EF"]
    sold = [(int(m), k // 2, names[k % 4], f"s{rng.integers(0, 3)}", day(int(d))) for k, (m, d) in enumerate(zip(rng.integers(0, 12, 400), rng.integers(0, 300, 400)))] + [(1, 900, "AB", None, day(3)), (1, 901, "AB", "s1", None)]
    told = [(int(k) % 50, f"HS{k % 4:02d}01", f"s{rng.integers(0, 3)}", day(int(d))) for k, d in enumerate(rng.integers(0, 300, 120))] + [(70, None, "s1", day(5))]
    seats = [(m, f"hs{m % 4:02d}00") for m in range(11)] + [(5, "hs0202"), (5, "hs0303"), (11, None)]
    t = spark.createDataFrame(sold, "member_id long, txn_id long, ticker string, sector string, traded_on date")
    r = spark.createDataFrame(told, "referral_id long, committee_id string, sector string, happened_on date")
    s = spark.createDataFrame(seats, "member_id long, committee_id string")
    want = {}
    for m, x, name, sector, on in sold:
        for k, c, its, at in told:
            if sector == its and on and c and c[:4] in {y.upper()[:4] for n, y in seats if n == m and y} and abs((on - at).days) <= 60:
                w = want.setdefault((m, k), (set(), [], set()))
                w[0].add(x), w[1].append(abs((on - at).days)), w[2].add((x, name))
    found = legislation.jurisdiction_window(t, r, s)
    got = {(g.member_id, g.referral_id): (g.trades, g.closest) for g in found.collect()}
    assert len(got) > 100 and got == {k: (len(x), min(d)) for k, (x, d, _) in want.items()}
    one = {(g.member_id, g.referral_id): g.tickers for g in found.where("member_id <> 5").collect()}
    first = lambda rows: {min(n.upper() for y, n in rows if y == x and n) for x in {x for x, n in rows if n}}
    assert one == {k: ",".join(sorted(first(x[2]))) for k, x in want.items() if k[0] != 5}
    single = legislation.jurisdiction_window(t, r, s.where("member_id <> 5"))
    assert "hashpartitioning(member_id, referral_id" not in re.sub(r"#\d+L?", "", single._jdf.queryExecution().executedPlan().toString())

"""Permutation tests of coincidences, and the q-values that findings inherit from them.

Streams are counted by day where they meet, so a test's size is one of days, not rows. A trade and
an event make a run of offsets, which is found by two searches, however many permutations there are.
Where a key has many events, these are kept once, as running sums by day, for all members who trade
it, and a large test's permutations are dealt out in parts of PART, and the parts' counts are summed
in Spark. Many tests share a task, in Arrow batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import BILL_DAYS, CLUSTER_DAYS, CLUSTER_MEMBERS, CONTRACT_DAYS, DONATION_DAYS, LOBBYING_DAYS, UNTESTED
from ..session import settled
from .findings import bh_qvalues
from .windows import distinct_in_window

PERMUTATIONS = 1000
SPAN_DAYS = 30
PART = 250
#: Days of a test above which its permutations are dealt over several groups.
LARGE = 5000
ALPHA = 0.05
#: Cells of one step of (permutation, day of a cluster).
BLOCK = 1 << 20
#: Tests of a group, rows that a task holds before it counts them, and (row, permutation) cells of a step, which stay in a core's cache.
TESTS, CHUNK, CELLS = 2048, 1 << 14, 1 << 15
#: Event days of a key, and pairs of them with its trades, up to which they travel with each trade, and tests whose offsets
#: a task holds at a time. They set the amount of work, never the result.
SPARSE, PAIRS, SOME = 64, 1 << 13, 256

#: Detectors with a null model: days before and after an event that a trade may lie, and whether purchases alone count.
DETECTORS = {
    "donor_conflict": (DONATION_DAYS, DONATION_DAYS, False),
    "lobbying_overlap": (LOBBYING_DAYS, LOBBYING_DAYS, False),
    "contract_front_run": (CONTRACT_DAYS, 0, True),
    "sponsorship_conflict": (BILL_DAYS, BILL_DAYS, False),
    "bill_jurisdiction_conflict": (BILL_DAYS, BILL_DAYS, False),
}
CLUSTER = "cross_member_cluster"


def resolvable(tests: int, permutations: int = PERMUTATIONS, alpha: float = ALPHA) -> bool:
    """Whether the smallest possible p-value can pass in a family of ``tests``."""
    return tests / (permutations + 1) <= alpha


def seed_of(*parts) -> int:
    """A seed from the group's key, the same wherever the group runs."""
    return int.from_bytes(hashlib.sha256("\x1f".join(map(str, parts)).encode()).digest()[:8], "big")


def _day(c: Column) -> Column:
    return F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long")


# ---------------------------------------------------------------- streams


def streams(detector: str, trades: DataFrame, events: DataFrame, key: str, event_key: str | None = None) -> DataFrame:
    """(detector, member_id, key, is_trade, day, n): a detector's trades, and its events without a member.

    ``trades`` has member_id, traded_on, direction and ``key``, without restated rows;
    ``events`` has happened_on, ``key`` and, if they concern one member only, member_id, which then
    is part of the key. Keys are trimmed and upper-cased; rows without a key, a member or a
    day are left out. Events have no member: whoever trades the key meets them there. ``n`` is one:
    rows are counted by day where those of a key meet, so they travel once.
    """
    rows = trades.where(F.col("direction") == "purchase") if DETECTORS[detector][2] else trades
    whose = [F.col("member_id").cast("string")] if "member_id" in events.columns else []

    def dated(df: DataFrame, column: str, day: str, who: Column, is_trade: bool) -> DataFrame:
        lane = F.concat(*[x for w in whose for x in (w, F.lit("\x1f"))], F.upper(F.trim(F.col(column).cast("string"))))
        out = df.select(F.lit(detector).alias("detector"), who.alias("member_id"), lane.alias("key"), F.lit(is_trade).alias("is_trade"), _day(F.col(day)).alias("day"), F.lit(1).cast("long").alias("n"))
        return out.dropna(subset=["member_id", "key", "day"] if is_trade else ["key", "day"])

    return dated(rows, key, "traded_on", F.col("member_id"), True).unionByName(dated(events, event_key or key, "happened_on", F.lit(None).cast("long"), False))


def _window_days(k: int) -> Column:
    return F.create_map(*[F.lit(x) for d, window in DETECTORS.items() for x in (d, window[k])])[F.col("detector")]


def _counted(found: DataFrame) -> DataFrame:
    """``found`` once a member, key and day, where all rows of a key are."""
    return found.repartition("key", "detector").groupBy("key", "detector", "member_id", "is_trade", "day").agg(F.sum("n").alias("n"))


def _held(found: DataFrame) -> DataFrame:
    """(detector, member_id, key, day, n, up, held): ``held`` events whose windows hold the day, for trades (with ``n``) and steps.

    Each event is a step up where its window begins and a step down past its end, and ``held`` is
    the running sum of a key's steps: rows travel to their key once, and nothing is joined back.
    """
    day, n, none, zero = F.col("day"), F.col("n"), F.lit(None).cast("long"), F.lit(0).cast("long")
    step = lambda at, up: F.struct(at.alias("day"), none.alias("n"), up.alias("up"))
    steps = F.array(step(day - _window_days(0), n), step(day + _window_days(1) + 1, -n))
    rows = F.when(F.col("is_trade"), F.array(F.struct(day, n, zero.alias("up")))).otherwise(steps)
    rows = _counted(found).select("detector", "member_id", "key", F.explode(rows).alias("r")).select("detector", "member_id", "key", "r.*")
    return rows.withColumn("held", F.sum("up").over(Window.partitionBy("key", "detector").orderBy("day")))


def observed_pairs(found: DataFrame) -> DataFrame:
    """(detector, member_id, observed): (event, trade) pairs within the detector's window."""
    return _held(found).where("n IS NOT NULL AND held > 0").groupBy("detector", "member_id").agg(F.sum(F.col("n") * F.col("held")).alias("observed"))


class _Lanes:
    """Running sums of events by day, key after key in one array: ``upto(lane, day)`` events up to a day."""

    def __init__(self, lane: np.ndarray, day: np.ndarray, n: np.ndarray, lanes: int):
        self.first = np.full(lanes, np.iinfo(np.int64).max)
        last = np.full(lanes, np.iinfo(np.int64).min)
        np.minimum.at(self.first, lane, day)
        np.maximum.at(last, lane, day)
        some = last >= self.first
        self.first = np.where(some, self.first, 0)
        self.length = np.where(some, last - self.first + 1, 0)
        self.base = np.cumsum(self.length + 1) - (self.length + 1)
        flat = np.zeros(int((self.length + 1).sum()), dtype=np.int64)
        np.add.at(flat, self.base[lane] + day - self.first[lane] + 1, n)
        total = np.cumsum(flat)
        self.window = None
        self.sums = total - np.repeat(total[self.base], self.length + 1)

    def upto(self, lane: np.ndarray, day: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """(rows, n): events of each row's lane up to its days, which are ``day`` moved by the row's ``shift``."""
        at = day + (shift - self.first[lane] + 1)[:, None]
        np.clip(at, 0, self.length[lane][:, None], out=at)
        at += self.base[lane][:, None]
        return self.sums[at]

    def around(self, lane: np.ndarray, day: np.ndarray, shift: np.ndarray, before: int, after: int) -> np.ndarray:
        """(rows, n): events of each row's lane whose windows hold a time between its days and the next ones; changes ``day``."""
        if self.window != (before, after):
            # a lane's windows go from before days ahead of its first event to after days past its last; 0 stands on both sides
            size = np.where(self.length > 0, self.length + before + after, 0) + 2
            start = np.cumsum(size) - size
            of = np.repeat(np.arange(len(size)), size)
            at = np.arange(len(of)) - start[of]
            table = self.sums[self.base[of] + np.clip(at, 0, self.length[of])] - self.sums[self.base[of] + np.clip(at - before - after, 0, self.length[of])]
            self.window, self.start, self.size, self.table = (before, after), start, size, table
        day += (shift - self.first[lane] + before + 1)[:, None]
        np.clip(day, 0, self.size[lane][:, None] - 1, out=day)
        day += self.start[lane][:, None]
        return self.table.take(day, mode="clip")


def shifted_pairs(lanes: _Lanes, lane: np.ndarray, day: np.ndarray, weight: np.ndarray, low: np.ndarray, span: np.ndarray, whole: np.ndarray, part: np.ndarray, before: int, after: int) -> np.ndarray:
    """(rows, permutations): pairs of each row of trades when it is shifted by its offsets around its span.

    Days and spans are whole, so an offset counts by its ``whole`` days and whether a ``part`` of
    one is left (0 or 1): shifted trades lie between that day and the next.
    """
    at = whole + (day - low)[:, None]
    at -= (at >= span[:, None]) * span[:, None]
    if part.all():  # offsets are hardly ever whole days
        out = lanes.around(lane, at, low, before, after)
    else:
        # the window around an event holds trades from before days ahead of it to after days past it
        out = lanes.upto(lane, at, low + before)
        at += part
        out -= lanes.upto(lane, at, low - after - 1)
    if (weight != 1).any():
        out *= weight[:, None]
    return out


def _offsets(detector: str, member: int, span: float, permutations: int) -> np.ndarray:
    """A test's offsets, drawn in parts of PART."""
    parts = range((permutations - 1) // PART + 1)
    return np.concatenate([np.random.default_rng(seed_of(detector, member, p)).uniform(0, span, min(PART, permutations - p * PART)) for p in parts])


class _Tests:
    """Permuted counts of the tests of one group and detector, a row each."""

    def __init__(self, detector: str, permutations: int):
        self.detector, self.permutations, self.parts = detector, permutations, (permutations - 1) // PART + 1
        self.at: dict[int, int] = {}
        self.whole = np.zeros((0, permutations), dtype=np.int64)
        self.rest = np.zeros((0, permutations), dtype=np.int8)
        self.counts = np.zeros((0, permutations), dtype=np.int64)
        self.used = np.zeros((0, self.parts), dtype=bool)
        self.observed = np.zeros(0, dtype=np.int64)

    def rows(self, member: np.ndarray, span: np.ndarray, observed: np.ndarray) -> np.ndarray:
        """Row of each of these (different) members, made where it is new."""
        new = [k for k, m in enumerate(member.tolist()) if m not in self.at]
        if new:
            if len(self.at) + len(new) > len(self.counts):
                more = max(len(new), len(self.counts), 64)
                self.whole, self.rest, self.counts, self.used = (np.concatenate([x, np.zeros((more, x.shape[1]), x.dtype)]) for x in (self.whole, self.rest, self.counts, self.used))
                self.observed = np.concatenate([self.observed, np.zeros(more, np.int64)])
            for k in new:
                row = self.at[int(member[k])] = len(self.at)
                self.observed[row] = observed[k]
                offsets = _offsets(self.detector, member[k], span[k], self.permutations)
                self.whole[row] = offsets
                self.rest[row] = offsets > self.whole[row]
        return np.array([self.at[m] for m in member.tolist()], dtype=np.int64)

    def add(self, lanes: _Lanes, c: dict[str, np.ndarray]) -> None:
        """Trades, in columns; those of one share of the permutations at a time."""
        before, after, _ = DETECTORS[self.detector]
        for share, shares in sorted(set(zip(c["share"].tolist(), c["shares"].tolist()))):
            mine = np.flatnonzero((c["share"] == share) & (c["shares"] == shares))
            mine = mine[np.argsort(c["member_id"][mine], kind="stable")]
            parts = np.arange(share, self.parts, shares)
            columns = np.concatenate([np.arange(p * PART, min(self.permutations, (p + 1) * PART)) for p in parts])
            every = len(columns) == self.permutations
            member, head, place = np.unique(c["member_id"][mine], return_index=True, return_inverse=True)
            rows = self.rows(member, c["span"][mine[head]].astype(float), c["observed"][mine[head]])
            self.used[np.ix_(rows, parts)] = True
            row = rows[place]
            step = max(1, CELLS // len(columns))
            for k in range(0, len(mine), step):
                at, its = mine[k : k + step], row[k : k + step]
                whole, part = (self.whole[its], self.rest[its]) if every else (self.whole[np.ix_(its, columns)], self.rest[np.ix_(its, columns)])
                pairs = shifted_pairs(lanes, c["lane"][at], c["day"][at], c["n"][at], c["low"][at], c["span"][at], whole, part, before, after)
                first = np.flatnonzero(np.append(True, its[1:] != its[:-1]))
                sums = np.add.reduceat(pairs, first, axis=0)
                if every:
                    self.counts[its[first]] += sums
                else:
                    self.counts[np.ix_(its[first], columns)] += sums

    def batch(self) -> pa.RecordBatch:
        n = len(self.at)
        used = np.repeat(self.used[:n], PART, axis=1)[:, : self.permutations]
        reached = ((self.counts[:n] >= self.observed[:n, None]) & used).sum(axis=1)
        return pa.RecordBatch.from_arrays([pa.array([self.detector] * n, pa.string()), pa.array(list(self.at), pa.int64()), pa.array(reached.astype(np.int64))], names=["detector", "member_id", "reached"])


def _permuted(permutations: int) -> Callable:
    """Partition sorted by (group, detector, key, is_trade): chunks of whole keys, or of one key's events with some of its trades."""

    def chunk(rows: pa.Table, tests: _Tests | None) -> Iterator[tuple[_Tests, pa.RecordBatch | None]]:
        c = {n: rows.column(n).combine_chunks().to_numpy(zero_copy_only=False) for n in rows.schema.names if n not in ("detector", "key")}
        kind = rows.column("detector").combine_chunks().dictionary_encode()
        names, kind = kind.dictionary.to_pylist(), kind.indices.to_numpy()
        key = rows.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
        turn = lambda *by: np.append(True, np.any([x[1:] != x[:-1] for x in by], axis=0)) if len(key) else np.zeros(0, bool)
        head = np.flatnonzero(turn(c["part"], kind))
        c["lane"] = np.cumsum(turn(c["part"], kind, key)) - 1
        for a, b in zip(head, np.append(head[1:], len(key))):
            if tests is None or (tests.detector, tests.part) != (names[kind[a]], int(c["part"][a])):
                if tests is not None:
                    yield tests, tests.batch()
                tests = _Tests(names[kind[a]], permutations)
                tests.part = int(c["part"][a])
            here = {n: x[a:b] for n, x in c.items()}
            lane = here["lane"] - here["lane"][0]
            on = here["is_trade"].astype(bool)
            lanes = _Lanes(lane[~on], here["day"][~on], here["n"][~on], int(lane[-1]) + 1)
            tests.add(lanes, {n: x[on].astype(np.int64) for n, x in (here | {"lane": lane}).items() if n not in ("is_trade", "part")})
        yield tests, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tests = None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < CHUNK:
                continue
            last = [held.column(n)[held.num_rows - 1].as_py() for n in ("part", "detector", "key")]
            same = np.logical_and.reduce([pc.equal(held.column(n), pa.scalar(x, held.schema.field(n).type)).to_numpy(zero_copy_only=False) for n, x in zip(("part", "detector", "key"), last)])
            cut = int(np.argmax(same))  # rows are sorted: the last key's begin here
            events = held.slice(cut).filter(pc.invert(held.slice(cut).column("is_trade")))
            if cut:
                now, held = held.slice(0, cut), held.slice(cut)
            elif events.num_rows < held.num_rows:
                now, held = held, events  # one key alone: its events stay for its further trades
            else:
                continue
            for tests, out in chunk(now.combine_chunks(), tests):
                if out is not None:
                    yield out
        if held is not None and held.num_rows:
            for tests, out in chunk(held.combine_chunks(), tests):
                if out is not None:
                    yield out
        if tests is not None:
            yield tests.batch()

    return run


def _steps(c: dict[str, np.ndarray], test: np.ndarray, drawn: np.ndarray, before: int, after: int) -> np.ndarray:
    """(tests, permutations + 1): where, in the order of a test's offsets, pairs begin and end.

    A row of ``c`` is a trade with one event. Shifted around the span, the trade is within the event's
    window for one run of offsets, which may go on over the end of the circle; so a pair costs two
    searches, however many permutations there are. Places count half days, whole days the even ones:
    ``drawn`` are the offsets in them, ascending, and an offset with a rest lies half a day on.
    """
    permutations, circle = drawn.shape[1], 2 * c["span"]
    first = 2 * np.maximum(c["event"] - c["low"] - before, 0)
    last = np.minimum(2 * (c["event"] - c["low"] + after), circle - 1)
    begin = (first - 2 * (c["day"] - c["low"])) % circle
    end = begin + last - first + 1
    some = last >= first
    over = some & (end > circle)
    # all tests' offsets in one ascending array; no place is beyond a test's stretch of it
    stretch = int(circle.max(initial=0)) + 2
    flat = (drawn + np.arange(len(drawn))[:, None] * stretch).ravel()
    out = np.zeros((len(drawn), permutations + 1), dtype=np.int64)
    for which, at, sign in ((some, begin, 1), (some, np.where(over, end - circle, end), -1)):
        t = test[which]
        np.add.at(out, (t, np.searchsorted(flat, at[which] + t * stretch) - t * permutations), sign * c["n"][which])
    np.add.at(out, (test[over], 0), c["n"][over])
    return out


def _by_test(permutations: int, least_span: int) -> Callable:
    """Partition sorted by (detector, member_id), a trade with the events of its key in a row: (detector, member_id, observed, reached) of each test."""

    def count(rows: pa.Table, ahead: np.ndarray | None, whole: bool) -> tuple[pa.RecordBatch | None, np.ndarray | None]:
        """Whole tests, or some rows of one: then what is counted of it so far. ``ahead`` is that of the first test."""
        rows = rows.combine_chunks()
        kind = rows.column("detector").combine_chunks().dictionary_encode()
        names, kind = kind.dictionary.to_pylist(), kind.indices.to_numpy()
        c = {n: rows.column(n).to_numpy() for n in ("member_id", "day", "n", "low", "span", "observed")}
        head = np.flatnonzero(np.append(True, (kind[1:] != kind[:-1]) | (c["member_id"][1:] != c["member_id"][:-1])))
        stop, reached = np.append(head[1:], len(kind)), np.full(len(head), -1, dtype=np.int64)
        events = rows.column("events").combine_chunks()
        each = pc.list_value_length(events).to_numpy()
        edge = np.append(0, np.cumsum(each))
        event, times = (pc.struct_field(events.flatten(), k).to_numpy() for k in ("day", "n"))
        for detector in np.unique(kind):
            before, after, _ = DETECTORS[names[detector]]
            here = np.flatnonzero((kind[head] == detector) & (c["span"][head] >= least_span))
            for some in (here[k : k + SOME] for k in range(0, len(here), SOME)):
                drawn = np.empty((len(some), permutations), dtype=np.int64)
                for k, x in enumerate(head[some]):
                    offsets = _offsets(names[detector], c["member_id"][x], float(c["span"][x]), permutations)
                    days = offsets.astype(np.int64)
                    drawn[k] = 2 * days + (offsets > days)
                drawn.sort(axis=1)
                # the chosen tests of one detector follow one another but for those that are too short
                a, b = head[some[0]], stop[some[-1]]
                test = np.full(len(head), -1)
                test[some] = np.arange(len(some))
                test = np.repeat(np.repeat(test, stop - head)[a:b], each[a:b])
                pair = {n: np.repeat(x[a:b], each[a:b]) for n, x in c.items() if n in ("day", "n", "low", "span")} | {"event": event[edge[a] : edge[b]]}
                pair["n"] = pair["n"] * times[edge[a] : edge[b]]
                if (test < 0).any():
                    pair, test = {n: x[test >= 0] for n, x in pair.items()}, test[test >= 0]
                steps = _steps(pair, test, drawn, before, after)
                if ahead is not None and some[0] == 0:
                    steps[0] += ahead
                if not whole:
                    return None, steps[0]
                reached[some] = (np.cumsum(steps[:, :-1], axis=1) >= c["observed"][head[some], None]).sum(axis=1)
        if not whole:
            return None, None
        said = [pa.array([names[k] for k in kind[head]], pa.string()), pa.array(c["member_id"][head]), pa.array(c["observed"][head]), pa.array(reached, mask=reached < 0)]
        return pa.RecordBatch.from_arrays(said, names=["detector", "member_id", "observed", "reached"]), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ahead = None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < CHUNK:
                continue
            same = np.ones(held.num_rows, dtype=bool)
            for n in ("detector", "member_id"):
                last = held.column(n)[held.num_rows - 1]
                same &= pc.equal(held.column(n), last).to_numpy()
            cut = int(np.argmax(same))  # rows are sorted: the last test's begin here
            if cut:
                out, ahead = count(held.slice(0, cut), ahead, True)
                yield out
                held = held.slice(cut)
            else:
                # one test alone: all rows but one, with which it ends, are counted
                more = count(held.slice(0, held.num_rows - 1), ahead, False)[1]
                ahead, held = more, held.slice(held.num_rows - 1)
        if held is not None and held.num_rows:
            yield count(held, ahead, True)[0]

    return run


def permutation_pvalues(found: DataFrame, permutations: int = PERMUTATIONS, least_span: int = SPAN_DAYS) -> DataFrame:
    """(detector, member_id, observed, p_value) from ``streams``; one test per member and detector.

    All trades of a member are shifted around the span of all its days, those of the events
    of its keys among them, by one offset per permutation, and the pairs are counted anew, key
    by key. p is (1 + as many) / (1 + N); it is null where the span is under ``least_span`` days.
    Members without an observed pair have no test.

    Trades meet the events of their keys once. Where no key of a test has many (SPARSE, PAIRS), these travel with the
    trades to the test, which counts pairs, not permutations. The other tests are counted by key (``_dense``).
    """
    test, day, event = ["detector", "member_id"], F.col("day"), F.col("up") > 0
    lane = Window.partitionBy("key", "detector")
    rows = _held(found).withColumn("nth", F.sum(F.when(event, 1).otherwise(0)).over(lane.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))
    own = F.struct((day + _window_days(0)).alias("day"), F.col("up").alias("n"))
    its = {"first": F.min(F.when(event, own["day"])), "last": F.max(F.when(event, own["day"])), "size": F.max("nth"), "trades": F.count("n"), "events": F.collect_list(F.when(event & (F.col("nth") <= SPARSE), own))}
    rows = rows.select("*", *[x.over(lane).alias(n) for n, x in its.items()]).where("n IS NOT NULL AND size > 0")
    full = (F.col("size") > SPARSE) | (F.col("size") * F.col("trades") > PAIRS)
    met = settled(rows.select(*test, "key", "day", "n", "held", "first", "last", full.alias("full"), F.when(~full, F.col("events")).alias("events")), "met")
    mine = Window.partitionBy(*test)
    low = F.least(F.min("day").over(mine), F.min("first").over(mine))
    told = {"full": F.max("full").over(mine), "low": low, "span": F.greatest(F.max("day").over(mine), F.max("last").over(mine)) - low, "observed": F.sum(F.col("n") * F.col("held")).over(mine)}
    few = met.select(*test, "day", "n", "events", *[x.alias(n) for n, x in told.items()]).where("NOT full AND observed > 0")
    few = few.select(*test, "day", "n", "low", "span", "observed", "events")
    counted = few.mapInArrow(_by_test(permutations, least_span), "detector string, member_id long, observed long, reached long")
    many = met.where("full").select(*test).distinct()
    if not many.isEmpty():
        counted = counted.unionByName(_dense(found, met.drop("events", "full").join(many, test, "left_semi"), permutations, least_span))
    return counted.select(*test, "observed", ((F.col("reached") + 1) / float(permutations + 1)).alias("p_value"))


def _dense(found: DataFrame, met: DataFrame, permutations: int, least_span: int) -> DataFrame:
    """(detector, member_id, observed, reached) of tests some keys of which have many events.

    Tests are dealt to groups; a key's events go once to each group that has a trade there, and a
    task walks its keys in order, with one chunk of running sums and the group's counts at hand.
    Tests whose least key (by hash) is the same go to one group, so members who trade the same keys
    meet there, and a key's events go to few groups, however many members trade it.
    """
    keys, test = ["detector", "key"], ["detector", "member_id"]
    events = _counted(found.where("NOT is_trade")).drop("member_id", "is_trade")
    low = F.least(F.min("day"), F.min("first"))
    # a test of many days is dealt over groups, each with some of the parts
    shares = F.least(F.lit((permutations - 1) // PART + 1), F.floor(F.count("*") / LARGE) + 1).cast("long")
    spans = [low.alias("low"), (F.greatest(F.max("day"), F.max("last")) - low).alias("span"), shares.alias("shares"), F.min(F.xxhash64(*keys)).alias("home")]
    tests = met.groupBy(*test).agg(F.sum(F.col("n") * F.col("held")).alias("observed"), *spans).where("observed > 0")
    # tests with the same least key share many keys: up to TESTS of them stay together
    homes = tests.groupBy("detector", "home").agg(F.sum("shares").alias("tests"))
    room = (F.floor((F.col("tests") - 1) / TESTS) + 1).cast("long")
    tests = settled(tests.join(homes, ["detector", "home"]).withColumn("home", F.xxhash64("detector", "home", F.pmod(F.xxhash64("member_id"), room))).drop("tests"), "tests")
    spark = found.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions")) * 4
    parts = max(parts, -(-(tests.agg(F.sum("shares")).first()[0] or 0) // TESTS))
    dealt = met.drop("first", "last", "held").join(tests.where(F.col("span") >= least_span), test).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
    dealt = settled(dealt.withColumn("part", F.pmod(F.xxhash64("home", "share"), F.lit(parts)).cast("int")).drop("home").withColumn("is_trade", F.lit(True)), "dealt")
    told = events.join(dealt.select(*keys, "part").distinct(), keys).withColumn("is_trade", F.lit(False))
    rows = dealt.unionByName(told, allowMissingColumns=True).fillna(0, ["member_id", "observed", "low", "span", "share", "shares"])
    rows = rows.select("part", *keys, "is_trade", "day", "n", "member_id", "observed", "low", "span", "share", "shares")
    rows = rows.repartition(parts, "part").sortWithinPartitions("part", *keys, "is_trade")
    reached = rows.mapInArrow(_permuted(permutations), "detector string, member_id long, reached long").groupBy(*test).agg(F.sum("reached").alias("reached"))
    return tests.join(reached, test, "left").select(*test, "observed", "reached")


# ---------------------------------------------------------------- clusters


def _most_members(who: np.ndarray, day: np.ndarray, offsets: np.ndarray, span: float, days: int) -> np.ndarray:
    """For each row of offsets (one per member) the most members with a day within ``days`` days of each other.

    A member counts from each day until ``days`` later or the member's next day, so every day is
    a step up and a step down, and the most members are the largest running sum.
    """
    out = []
    for k in range(0, len(offsets), max(1, BLOCK // (2 * len(day)))):
        moved = np.mod(day + offsets[k : k + max(1, BLOCK // (2 * len(day)))][:, who], span)
        order = np.argsort(who * (2.0 * span) + moved, axis=1)
        moved = np.take_along_axis(moved, order, 1)
        member = who[order]
        following = np.full_like(moved, np.inf)
        following[:, :-1] = np.where(member[:, 1:] == member[:, :-1], moved[:, 1:], np.inf)
        again = following <= moved + days
        at = np.concatenate([moved, np.where(again, following, moved + days)], axis=1)
        step = np.broadcast_to(np.repeat([1, -1], len(day)), at.shape)
        # where days meet: a member's step down for its next day comes first, that at the window's end last
        rank = np.concatenate([np.ones_like(moved), np.where(again, 0.0, 2.0)], axis=1)
        order = np.lexsort((rank, at), axis=-1)
        out.append(np.cumsum(np.take_along_axis(step, order, 1), axis=1).max(axis=1))
    return np.concatenate(out)


class _Members:
    """The days of a group's members on a circle of ``span`` days, and whether permuted members meet as often as observed."""

    def __init__(self, who: np.ndarray, day: np.ndarray, span: int, days: int):
        who, day = np.divmod(np.unique(who.astype(np.int64) * span + day.astype(np.int64) % span), span)
        first = np.append(True, who[1:] != who[:-1])
        last = np.append(first[1:], True)
        head = np.flatnonzero(first)
        size = np.diff(np.append(head, len(who)))
        back = np.where(first, day - np.repeat(day[last], size) + span, day - np.roll(day, 1))
        ahead = np.where(last, np.repeat(day[first], size) - day + span, np.roll(day, -1) - day)
        self.who, self.day, self.back, self.ahead, self.span, self.days = who, day, back, ahead, span, days
        # bins so narrow that few members begin in one
        self.cut = 1
        while self.cut < 64 and self.cut * span < 4 * len(who):
            self.cut *= 2
        self.begins, self.stops = back > days, ahead > days

    def reach(self, offsets: np.ndarray, observed: int) -> bool:
        """Whether ``observed`` members, each moved by its offset, have a day within ``days`` days of each other.

        A member counts from the first of its days that follow one another within ``days`` to
        ``days`` past the last of them. Beginnings and ends are counted by bins; only in bins
        at whose borders the counts leave it open are they put in order.
        """
        span, cut = self.span, self.cut
        whole = offsets.astype(np.int64)
        part = offsets - whole
        at = self.day + whole[self.who]
        at -= np.where(at >= span, span, 0)
        up = self.begins | (at < self.back)
        down = self.stops | (at + self.ahead >= span)
        bins = at * cut + (part * cut).astype(np.int64)[self.who]
        size, late = (span + self.days) * cut, self.days * cut
        rise = np.bincount(bins[up], minlength=size)
        past = np.cumsum(rise - np.bincount(bins[down] + late, minlength=size))
        if past.max() >= observed:
            return True
        before = np.append(0, past[:-1])
        unsure = before + rise >= observed
        if not unsure.any():
            return False
        rises, falls = np.flatnonzero(up & unsure[bins]), np.flatnonzero(down & unsure[bins + late])
        where = np.concatenate([bins[rises], bins[falls] + late])
        kind = np.repeat([0, 1], [len(rises), len(falls)])
        order = np.lexsort((kind, part[self.who[np.concatenate([rises, falls])]], where))
        where, sums = where[order], np.cumsum(1 - 2 * kind[order])
        head = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
        ahead = np.repeat(np.append(0, sums[head[1:] - 1]), np.diff(np.append(head, len(where))))
        return bool((before[where] + sums - ahead >= observed).any())


def cluster_pvalues(trades: DataFrame, days: int = CLUSTER_DAYS, members: int = CLUSTER_MEMBERS, permutations: int = PERMUTATIONS, least_span: int = SPAN_DAYS) -> DataFrame:
    """(ticker, direction, observed, p_value) for groups that reach ``members``; each member is shifted by offsets of its own."""

    def test(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ticker, direction, first = key
        who, day = pd.factorize(rows["member_id"], sort=True)[0], rows["day"].to_numpy()
        span, observed, number = int(day.max() - day.min()), int(rows["observed"].iloc[0]), int(who.max()) + 1
        group, reached = _Members(who, day - day.min(), span, days), 0
        for part in range(first, (permutations - 1) // PART + 1, int(rows["shares"].iloc[0])):
            rng = np.random.default_rng(seed_of(ticker, direction, part))
            # an offset for each member, one permutation after another: no table of all of them is held
            reached += sum(group.reach(rng.uniform(0, span, number), observed) for _ in range(min(PART, permutations - part * PART)))
        return pd.DataFrame({"ticker": [ticker], "direction": [direction], "reached": [reached]})

    rows = trades.where(F.col("direction").isin("purchase", "sale")).select(F.upper(F.trim("ticker")).alias("ticker"), "direction", "member_id", "traded_on").dropna().distinct()
    at = distinct_in_window(rows, ["ticker", "direction"], "member_id", "traded_on", days)
    groups = at.groupBy("ticker", "direction").agg(F.max("n").alias("observed")).where(F.col("observed") >= members)
    dated = rows.select("ticker", "direction", "member_id", _day(F.col("traded_on")).alias("day"))
    shares = F.least(F.lit((permutations - 1) // PART + 1), F.floor(F.count("*") / LARGE) + 1).alias("shares")
    span = dated.groupBy("ticker", "direction").agg((F.max("day") - F.min("day")).alias("span"), shares)
    tests = groups.join(span, ["ticker", "direction"])
    dealt = dated.join(tests.where(F.col("span") >= least_span).drop("span"), ["ticker", "direction"]).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("part"))
    # tests are few bytes and much work, so their partitions stay as many as they are
    dealt = dealt.repartition(int(trades.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ticker", "direction", "part")
    reached = dealt.groupBy("ticker", "direction", "part").applyInPandas(test, "ticker string, direction string, reached long").groupBy("ticker", "direction").agg(F.sum("reached").alias("reached"))
    p = (F.col("reached") + 1) / float(permutations + 1)
    return tests.join(reached, ["ticker", "direction"], "left").select("ticker", "direction", "observed", p.alias("p_value"))


# ---------------------------------------------------------------- the family


def family(members: DataFrame, clusters: DataFrame) -> DataFrame:
    """All tests with a p-value as one family: (anomaly_type, member_id, ticker, p_value, q_value)."""
    a = members.select(F.col("detector").alias("anomaly_type"), "member_id", F.lit(None).cast("string").alias("ticker"), "p_value")
    b = clusters.select(F.lit(CLUSTER).alias("anomaly_type"), F.lit(None).cast("long").alias("member_id"), "ticker", "p_value")
    return bh_qvalues(a.unionByName(b).where("p_value IS NOT NULL"))


def annotate(findings: DataFrame, tests: DataFrame) -> DataFrame:
    """Findings with the p- and q-values of their test, and null where there is none.

    A finding belongs to the test of its type and member; a cluster's to that of the ticker
    which is a word of its title, the smaller p-value of two directions. Types without a
    null model never have values.
    """
    names = [c for c in findings.columns if c not in ("p_value", "q_value")]
    best = tests.groupBy("anomaly_type", "member_id", "ticker").agg(F.min(F.struct("p_value", "q_value")).alias("best"))
    kind, title = F.col("anomaly_type"), F.upper(F.coalesce("title", F.lit("")))
    by_member = best.where(F.col("member_id").isNotNull() & ~kind.isin(UNTESTED)).groupBy("anomaly_type", "member_id").agg(F.min("best").alias("__own"))
    # titles are looked up as texts: a number given to each row would be another one whenever the rows are computed again
    words = findings.where(kind == CLUSTER).select(title.alias("__title")).distinct().withColumn("ticker", F.explode(F.split("__title", " ")))
    by_title = words.join(best.where(F.col("ticker") != "").drop("member_id", "anomaly_type"), "ticker").groupBy("__title").agg(F.min("best").alias("__said"))
    rows = findings.select(*names, F.when(kind == CLUSTER, title).alias("__title"))
    rows = rows.join(by_member, ["anomaly_type", "member_id"], "left").join(by_title, "__title", "left").withColumn("__best", F.least("__own", "__said"))
    return rows.select(*names, "__best.p_value", "__best.q_value")


def significance_run(annotated: DataFrame, tests: DataFrame, permutations: int = PERMUTATIONS, alpha: float = ALPHA) -> DataFrame:
    """One row: tests, passing, annotated findings and those without a test, and whether any test could pass at all."""
    best = tests.groupBy("anomaly_type", "member_id", "ticker").agg(F.min(F.struct("p_value", "q_value")).alias("best"))
    t = tests.agg(F.count("*").alias("tests")).crossJoin(best.agg(F.count_if(F.col("best.q_value") <= alpha).alias("passing")))
    f = annotated.agg(F.count("p_value").alias("annotated"), F.count_if(F.col("p_value").isNull()).alias("without_test"))
    floor = 1 / (permutations + 1)
    return t.crossJoin(f).select("*", F.lit(round(floor, 6)).alias("floor"), (F.col("tests") * floor <= alpha).alias("resolvable"), F.bround(F.col("passing") * alpha, 2).alias("expected_false"))

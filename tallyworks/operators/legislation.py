"""Trades near bills: by sponsorship and by committee seats."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed import BILL_DAYS
from ..functions.money import proximity
from ..session import settled
from .windows import event_window_join, within_window


#: Members of a committee in a block, and pairs that are counted at a time; they set the amount of work, never the result.
MEMBERS, PAIRS = 1000, 1 << 20


def _near(trades: DataFrame, events: DataFrame, keys: list[str], by: list[str], days: int) -> DataFrame:
    rows = trades.select(*dict.fromkeys(["member_id", "txn_id", "ticker", "traded_on", *keys]))
    # pairs travel once: a trade's and a bill's counts are both taken where all pairs of ``by`` are
    met = event_window_join(rows, events, keys, days, days).select(*by, "txn_id", "ticker", "days_apart").repartition(*by)
    # a trade counts once for a bill, however many sectors it shares with it
    one = met.groupBy(*by, "txn_id").agg(F.min("days_apart").alias("days_apart"), F.first("ticker").alias("ticker"))
    out = one.groupBy(*by).agg(F.count("*").alias("trades"), F.min("days_apart").alias("closest"), F.array_join(F.sort_array(F.collect_set(F.upper("ticker"))), ",").alias("tickers"))
    return out.withColumn("severity", proximity(F.col("closest")))


def sponsorship_window(trades: DataFrame, sponsored: DataFrame, days: int = BILL_DAYS) -> DataFrame:
    """(member_id, bill_id, trades, closest, tickers, severity): bills with a trade of their sponsor in a shared sector.

    ``trades`` has a row for each sector of a trade, ``sponsored`` (member_id, bill_id, sector, happened_on).
    """
    return _near(trades, sponsored, ["member_id", "sector"], ["member_id", "bill_id"], days)


def jurisdiction_window(trades: DataFrame, referrals: DataFrame, seats: DataFrame, days: int = BILL_DAYS) -> DataFrame:
    """As sponsorship, for referrals (referral_id, committee_id, sector, happened_on) to a committee (its first four characters) on which the trader sits.

    A member of one committee meets a referral there alone, so these pairs are counted where they form: trades and
    referrals travel to the committee, and no pair does. A committee's members are dealt to blocks, and its referrals
    go to each. Only pairs of members of several committees travel.
    """
    parent = F.upper(F.substring("committee_id", 1, 4))
    r = referrals.withColumn("parent", parent).drop("committee_id")
    s = settled(seats.select("member_id", parent.alias("parent")).dropna().distinct().withColumn("seats", F.count("*").over(Window.partitionBy("member_id"))), "seats")
    places = int(s.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    n = s.agg(F.count("*").alias("seats"), F.countDistinct("parent").alias("parents")).first()
    blocks = -(-max(places, n.seats // MEMBERS) // max(1, n.parents))
    # trades take their members' committees along, so a referral is not multiplied by all who sit on its committee
    own = s.where("seats = 1").select("member_id", "parent", F.pmod(F.xxhash64("member_id"), F.lit(blocks)).cast("int").alias("block"))
    sold = trades.select("member_id", "txn_id", F.upper("ticker").alias("ticker"), "sector", F.col("traded_on").alias("day")).dropna(subset=["sector", "day"])
    sold = sold.join(own, "member_id").repartition("parent", "sector").groupBy("parent", "block", "sector").agg(F.collect_list(F.struct("member_id", "txn_id", "ticker", "day")).alias("sold"))
    told = r.select("referral_id", "parent", "sector", F.col("happened_on").alias("day")).dropna(subset=["parent", "sector", "day"])
    told = told.groupBy("parent", "sector").agg(F.collect_list(F.struct("referral_id", "day")).alias("told"))
    # places are many, as the pairs that form there do not follow the bytes that come in
    met = sold.join(told, ["parent", "sector"]).repartition(places, "parent", "block")
    schema = T.StructType([trades.schema["member_id"], referrals.schema["referral_id"], T.StructField("trades", T.LongType()), T.StructField("closest", T.IntegerType()), T.StructField("tickers", T.StringType())])
    out = met.select("parent", "block", "sold", "told").groupBy("parent", "block").applyInArrow(_meet(days), schema)
    out = out.withColumn("severity", proximity(F.col("closest")))
    several = s.where("seats > 1").drop("seats")
    if several.isEmpty():
        return out
    return out.unionByName(_near(trades.join(several, "member_id"), r, ["parent", "sector"], ["member_id", "referral_id"], days))


def _meet(days: int) -> Callable[[pa.Table], pa.Table]:
    """Sectors of one place with their trades and referrals: (member_id, referral_id, trades, closest, tickers)."""

    def coded(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Different values, a null among them, and the number of each row's."""
        d = values.dictionary_encode(null_encoding="encode")
        return d.dictionary, d.indices.to_numpy()

    def flat(lists: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Elements of lists, the number of the list of each, and its day."""
        one = lists.combine_chunks()
        rows = one.flatten()
        return rows, np.repeat(np.arange(len(one)), pc.list_value_length(one).to_numpy()), pc.struct_field(rows, "day").cast(pa.int32()).to_numpy().astype(np.int64)

    def run(table: pa.Table) -> pa.Table:
        (left, sector, day), (right, its, on) = flat(table["sold"]), flat(table["told"])
        members, member = coded(pc.struct_field(left, "member_id"))
        referrals, referral = coded(pc.struct_field(right, "referral_id"))
        _, txn = coded(pc.struct_field(left, "txn_id"))
        tickers, ticker = coded(pc.struct_field(left, "ticker"))
        # tickers are numbered in their order, a null last
        order = pc.sort_indices(tickers).to_numpy()
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        tickers, ticker, nameless = tickers.take(pa.array(order)), rank[ticker], tickers.null_count > 0
        wide = np.int64(1 << 40)
        place = its * wide + on
        order = np.argsort(place, kind="stable")
        place, referral, on = place[order], referral[order], on[order]
        first = np.searchsorted(place, sector * wide + day - days)
        many = np.searchsorted(place, sector * wide + day + days, side="right") - first
        order = np.argsort(member, kind="stable")
        order = order[many[order] > 0]
        ends, stops = np.cumsum(many[order]), np.flatnonzero(np.append(member[order][1:] != member[order][:-1], True)[: len(order)]) + 1
        out, a = [], 0
        while a < len(order):
            # whole members, of about PAIRS pairs
            upto = np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS)
            b = int(stops[min(np.searchsorted(stops, max(upto, a + 1)), len(stops) - 1)])
            mine = order[a:b]
            a, n = b, many[mine]
            t, e = np.repeat(mine, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[mine], n)
            pair = member[t].astype(np.int64) * len(referrals) + referral[e]
            # a trade counts once for a referral, however many sectors it shares with it, and with one ticker
            by = np.lexsort((ticker[t], txn[t], pair))
            pair, t, apart = pair[by], t[by], np.abs(day[t] - on[e])[by]
            head = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
            once = np.append(True, (pair[1:] != pair[:-1]) | (txn[t][1:] != txn[t][:-1]))
            names = np.unique(((np.cumsum(np.append(True, pair[1:] != pair[:-1])) - 1) * len(tickers) + ticker[t])[once])
            if nameless:
                names = names[names % len(tickers) < len(tickers) - 1]
            size = np.bincount(names // len(tickers), minlength=len(head))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), tickers.take(pa.array(names % len(tickers))))
            who, what = np.divmod(pair[head], len(referrals))
            said = [members.take(pa.array(who)), referrals.take(pa.array(what)), pa.array(np.add.reduceat(once.astype(np.int64), head)), pa.array(np.minimum.reduceat(apart, head).astype(np.int32)), pc.binary_join(lists, ",")]
            out.append(pa.Table.from_arrays(said, names=["member_id", "referral_id", "trades", "closest", "tickers"]))
        empty = pa.table({"member_id": members[:0], "referral_id": referrals[:0], "trades": pa.array([], pa.int64()), "closest": pa.array([], pa.int32()), "tickers": pa.array([], pa.string())})
        return pa.concat_tables([empty, *out])

    return run


def bills_worth_lookup(bills: DataFrame, trades: DataFrame, days: int = BILL_DAYS) -> DataFrame:
    """Bills with any trade in one of their sectors within twice the window of their introduction or latest action."""
    dated = bills.withColumn("__on", F.coalesce("introduced_on", "latest_action_on"))
    events = trades.select("sector", F.col("traded_on").alias("happened_on")).distinct()
    return within_window(dated, events, ["sector"], 2 * days, 2 * days, "__on").drop("__on")

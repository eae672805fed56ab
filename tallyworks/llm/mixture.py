"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The words of a source stand end to end, its documents in a seeded order, and are cut into
blocks of BLOCK words (evened out, so that the last block of a source is as good as the
others). Blocks are seats: every source gets the seats of the highest quotients
target / (2 i + 1). The seats of the first k shards are the apportionment of a house of
that size, and what one shard adds to it is its integer quota of the source, so every
shard has the mix and all shards together have it too. Which blocks fill the quota is a
seeded permutation of the source's blocks: whole rounds first, then part of one.

Only DataFrame functions run. A house is settled without listing its seats: by rounding,
the divisor lies between two bounds half the number of sources apart, and just the seats
between these bounds are ranked. Positions are sums over slices of a hash first, then
over the rows of one slice, so a source with most of the rows passes through no one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import boxed, column, settle

#: What an Unicode-unaware splitter calls a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block, output shards, most times a source may be taken, and the weights that sources take in turn.
BLOCK, SHARDS, REPEAT, WEIGHTS = 16, 16, 3, (1.0, 2.0, 3.0)
SEED = 7
#: Steps of permutations; a number of 63 bits has at most three such factors, so one of four is coprime.
STEPS = (1000003, 1000033, 1000037, 1000039)
#: Slices of a source at least, and rows of a slice that are ordered together.
SLICES, ROOM = 256, 50_000


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeat: int = REPEAT) -> DataFrame:
    """(source, place, source_size, target) from (source, source_size).

    Sources in the order of their code points, null last, take the weights in turn and share
    the sum of all sizes; a target above ``repeat`` times its source's size stops there, and
    what is over goes to the others by weight. Sources that stop are the first in the order
    of what a unit of weight may take, so one sum over that order finds the level at which
    all others stand.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("sources need weights above zero")
    rows = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    rows = rows.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("place") % len(weights)))
    rows = rows.withColumn("most", F.col("source_size") * repeat)
    by_room = Window.orderBy(F.col("most") / F.col("weight"), "place")
    everyone = Window.partitionBy()
    rows = rows.select(
        "*",
        F.row_number().over(by_room).alias("turn"),
        F.sum("source_size").over(everyone).alias("all"),
        F.coalesce(F.sum("most").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)).alias("left"),
    )
    stays = (F.col("all") - F.col("before")) * F.col("weight") <= F.col("most") * F.col("left")
    rows = rows.withColumn("first", F.min(F.when(stays, F.col("turn"))).over(everyone))
    here = F.col("turn") == F.col("first")
    rows = rows.select("*", F.max(F.when(here, F.col("all") - F.col("before"))).over(everyone).alias("rest"), F.max(F.when(here, F.col("left"))).over(everyone).alias("over"))
    target = F.when(F.col("turn") < F.col("first"), F.col("most").cast("double")).otherwise(F.col("rest") * F.col("weight") / F.col("over"))
    return rows.select("source", "place", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def quotas(shares: DataFrame, shards: int = SHARDS, block: int = BLOCK, repeat: int = REPEAT) -> DataFrame:
    """``targets`` with the number of blocks ``n`` and ``upto``: the seats of the first 1, 2, ... ``shards`` shards.

    Ties between quotients go to the earlier source. A house's seats are those of all sources
    at a divisor; at one that half a seat a source more would ask for, too many seats exist,
    at one for half a seat less too few, and the seats between are ranked.
    """
    n = F.ceil(F.col("source_size") / block)
    rows = shares.withColumn("n", n).withColumn("votes", F.when(n > 0, F.col("target") * n / F.col("source_size")).otherwise(0.0))
    everyone = Window.partitionBy()
    rows = rows.select("*", F.sum("votes").over(everyone).alias("all"), F.count("*").over(everyone).alias("s"), (F.sum(F.floor(F.col("votes") * 1e6)).over(everyone) + 500_000).alias("millionths"))
    rows = rows.withColumn("seats", F.floor(F.col("millionths") / 1_000_000)).select("*", F.explode(F.sequence(F.lit(1), F.lit(shards))).alias("k"))
    rows = rows.withColumn("house", F.floor(F.col("seats") * F.col("k") / shards))
    margin = F.col("s") / 2 + 2
    at = lambda house: F.floor(F.col("votes") / F.col("all") * house + 0.5)
    some = F.col("all") > 0
    rows = rows.withColumn("base", F.when(some & (F.col("house") > margin), at(F.col("house") - margin)).otherwise(0)).withColumn("top", F.when(some & (F.col("house") > 0), at(F.col("house") + margin)).otherwise(0))
    open_seats = F.when(F.col("top") > F.col("base"), F.sequence("base", F.col("top") - 1))
    rows = rows.withColumn("free", F.col("house") - F.sum("base").over(Window.partitionBy("k")))
    seats = rows.select("place", "k", "votes", "free", F.explode(open_seats).alias("i"))
    ranked = seats.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy((F.col("votes") / (2 * F.col("i") + 1)).desc(), "place", "i")))
    won = ranked.where(F.col("rank") <= F.col("free")).groupBy("place", "k").agg(F.count("*").alias("more"))
    got = rows.join(won, ["place", "k"], "left").withColumn("quota", F.least(F.col("base") + F.coalesce("more", F.lit(0)), repeat * F.col("n")))
    lists = got.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("k", "quota"))).alias("u"))
    return shares.withColumn("n", n).join(lists, "place").select("source", "place", "source_size", "target", "n", F.col("u.quota").alias("upto"))


def positions(rows: DataFrame, seed: int = SEED, room: int = ROOM) -> DataFrame:
    """(place, size, h, at, ...) with ``first``: the words of the source before the row's, in the order of ``h``.

    Slices are prefixes of ``h``, a hash of key and text. A slice above ``room`` holds repeated
    rows: there every hash is a slice, and one hash's rows, which are alike, are parted anyhow.
    """
    most = rows.groupBy("place").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    digits = next(g for g in range(1, 33) if 16**g >= max(SLICES, 4 * most // room))
    rows = rows.withColumn("slice", F.substring("h", 1, digits))
    large, _ = settle(rows.groupBy("place", "slice").agg(F.count("*").alias("rows")).where(F.col("rows") > room).select("place", "slice", F.lit(True).alias("large")))
    if large.isEmpty():
        rows = rows.select("*", F.lit("").alias("each"), F.lit(0).cast("long").alias("part"))
    else:
        rows = rows.join(large, ["place", "slice"], "left").withColumn("each", F.when(F.col("large"), F.col("h")).otherwise("")).drop("large")
        alike, _ = settle(rows.where("each <> ''").groupBy("place", "each").agg(F.count("*").alias("rows")).where(F.col("rows") > room).select("place", "each", F.ceil(F.col("rows") / room).alias("parts")))
        rows = rows.join(alike, ["place", "each"], "left").withColumn("part", F.coalesce(F.pmod("at", "parts"), F.lit(0))).drop("parts")
    tile = ["place", "slice", "each", "part"]
    sums = rows.groupBy(*tile).agg(F.sum("size").alias("words"))
    sums = sums.select(*tile, (F.sum("words").over(Window.partitionBy("place").orderBy("slice", "each", "part")) - F.col("words")).alias("before"))
    within = F.sum("size").over(Window.partitionBy(*tile).orderBy("h", "at").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return rows.withColumn("within", within).join(sums, tile).withColumn("first", F.col("before") + F.col("within")).drop("within", "before", "slice", "each", "part")


class _Blocks:
    """Expressions over a row's source: bounds of block b, the block of a word, and how often a block is taken."""

    def __init__(self, seed: int):
        n, size = F.greatest("n", F.lit(1)), F.col("source_size")
        self.n = n
        # div keeps longs: q words a block, one more in each of the first ``more``
        self.q, self.more = F.floor(size / n), size % n
        good = F.filter(F.array(*[F.lit(p).cast("long") for p in STEPS]), lambda p: n % p != 0)
        self.step = F.get(good, ((F.col("place") + seed) % F.size(good)).cast("int"))
        self.shift = (F.col("place") + 1) * (7919 * (seed + 1)) % n
        self.quota = F.element_at("upto", -1)
        self.whole, self.extra = F.floor(self.quota / n), self.quota % n

    def start(self, b: Column) -> Column:
        return b * F.col("q") + F.least(b, F.col("more"))

    def of(self, word: Column) -> Column:
        longer = F.col("more") * (F.col("q") + 1)
        return F.when(word < longer, F.floor(word / (F.col("q") + 1))).otherwise(F.col("more") + F.floor((word - longer) / F.greatest("q", F.lit(1))))

    def turn(self, b: Column) -> Column:
        """The block's place in the seeded order of its source."""
        return (b * F.col("step") + F.col("shift")) % F.greatest("n", F.lit(1))

    def copies(self, b: Column) -> Column:
        return F.col("whole") + F.when(self.turn(b) < F.col("extra"), 1).otherwise(0)

    def begin(self, b: Column) -> Column:
        return F.greatest(self.start(b), F.col("first"))

    def end(self, b: Column) -> Column:
        return F.least(self.start(b + 1), F.col("first") + F.col("size"))


NEW = ("size", "source_size", "target", "taken", "spans")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, shards: int = SHARDS, block: int = BLOCK, repeat: int = REPEAT, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED) -> DataFrame:
    """Every row with ``size``, ``source_size``, ``target``, ``taken`` and ``spans``.

    ``taken`` counts the words that the mix takes of a row, repeats included, never more than
    ``repeat`` times its size. ``spans`` lists them: (shard, copy, first word, end) of every
    piece of a block. A null text has no words, as an empty one; null sources are one source,
    null keys one key. Rows alike in key and text may change places, so which of them a
    span falls on is open; all else is the same on every run. Columns of the new names are
    replaced, all others stay; an empty table gives an empty result. A source's taken words
    are within a block or so of its target.
    """
    h = F.md5(F.concat_ws("/", F.lit(str(seed)), F.coalesce(column(key).cast("string"), F.lit("")), F.md5(F.coalesce(column(text), F.lit("")))))
    rows = boxed(docs, NEW, source=column(source), size=words(column(text)), h=h, at=F.monotonically_increasing_id())
    rows, _ = settle(rows)
    shares = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeat)
    table, _ = settle(quotas(shares, shards, block, repeat))
    named = table.select(F.col("source").alias("its"), "place")
    placed = positions(rows.join(named, F.col("source").eqNullSafe(F.col("its"))).drop("source", "its"), seed)
    b = _Blocks(seed)
    known = table.select("place", "source_size", "target", "n", "upto", b.q.alias("q"), b.more.alias("more"), b.step.alias("step"), b.shift.alias("shift"), b.whole.alias("whole"), b.extra.alias("extra"))
    full = placed.join(known, "place")
    blocks = F.when(F.col("size") > 0, F.sequence(b.of(F.col("first")), b.of(F.col("first") + F.col("size") - 1)))
    taken = F.aggregate(blocks, F.lit(0).cast("long"), lambda sum, x: sum + (b.end(x) - b.begin(x)) * b.copies(x))

    def pieces(x: Column) -> Column:
        shard = lambda c: F.size(F.filter("upto", lambda u: u <= c * F.col("n") + b.turn(x)))
        each = F.filter(F.sequence(F.lit(0), F.lit(repeat - 1)), lambda c: c < b.copies(x))
        return F.transform(each, lambda c: F.struct(shard(c).alias("shard"), c.alias("copy"), (b.begin(x) - F.col("first")).alias("begin"), (b.end(x) - F.col("first")).alias("end")))

    spans = F.flatten(F.transform(F.coalesce(blocks, F.array().cast("array<bigint>")), pieces))
    return full.select("row.*", "size", "source_size", "target", F.coalesce(taken, F.lit(0)).cast("long").alias("taken"), spans.alias("spans"))


def pieces(mixed: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, shard, copy, begin, end, text): the mix itself, a row for each span, its words joined by a space."""
    rows = mixed.select(column(key).alias(key), F.regexp_extract_all(F.coalesce(column(text), F.lit("")), F.lit(WORD), 0).alias("w"), F.explode("spans").alias("s"))
    return rows.select(column(key), "s.*", F.array_join(F.slice("w", (F.col("s.begin") + 1).cast("int"), (F.col("s.end") - F.col("s.begin")).cast("int")), " ").alias("text"))


def write_mix(mixed: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """One folder for each shard, dealt by shard and key."""
    pieces(mixed, key, text).repartition("shard", column(key)).write.partitionBy("shard").parquet(path)


def report(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
    md5(concat_ws('/', '{SEED}', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY 1),
w AS (SELECT *, CAST([{", ".join(map(str, WEIGHTS))}][1 + place % {len(WEIGHTS)}] AS DOUBLE) AS weight, {REPEAT} * source_size AS most FROM s),
r AS (SELECT *, row_number() OVER o AS turn, sum(source_size) OVER () AS total, coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS over FROM w WINDOW o AS (ORDER BY most / weight, place)),
l AS (SELECT CAST(total - before AS DOUBLE) AS rest, over AS among, turn AS first FROM r WHERE CAST(total - before AS DOUBLE) * weight <= most * over ORDER BY turn LIMIT 1),
t AS (SELECT source, place, source_size, CASE WHEN turn < first THEN CAST(most AS DOUBLE) ELSE rest * weight / among END AS target,
    CAST(ceil(source_size / {BLOCK}) AS BIGINT) AS n FROM r, l),
v AS (SELECT *, CASE WHEN n > 0 THEN target * n / source_size ELSE 0 END AS votes FROM t),
house AS (SELECT (sum(CAST(floor(votes * 1e6) AS BIGINT)) + 500000) // 1000000 AS seats FROM v),
seat AS (SELECT place, votes, unnest(range(CAST(2 * votes + 20 AS BIGINT))) AS i FROM v),
won AS (SELECT place, count(*) AS quota FROM (SELECT place, row_number() OVER (ORDER BY votes / (2 * i + 1) DESC, place, i) AS rank FROM seat WHERE votes > 0), house WHERE rank <= seats GROUP BY 1),
q AS (SELECT v.*, greatest(n, 1) AS m, least(coalesce(quota, 0), {REPEAT} * n) AS quota, list_filter([{", ".join(map(str, STEPS))}], lambda p: greatest(n, 1) % p <> 0) AS good FROM v LEFT JOIN won USING (place)),
b AS (SELECT place, quota, m, good[1 + (place + {SEED}) % len(good)] AS step, (place + 1) * {7919 * (SEED + 1)} % m AS shift, source_size // m AS len, source_size % m AS more, unnest(range(n)) AS b FROM q),
c AS (SELECT place, b * len + least(b, more) AS begin, (b + 1) * len + least(b + 1, more) AS stop, quota // m + CASE WHEN (b * step + shift) % m < quota % m THEN 1 ELSE 0 END AS copies FROM b),
p AS (SELECT d.*, place, sum(size) OVER (PARTITION BY place ORDER BY h ROWS UNBOUNDED PRECEDING) - size AS first, row_number() OVER () AS r FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
k AS (SELECT r, sum((least(stop, first + size) - greatest(begin, first)) * copies) AS taken FROM p JOIN c ON p.place = c.place AND begin < first + size AND stop > first WHERE size > 0 GROUP BY 1)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM p JOIN t USING (place) LEFT JOIN k USING (r)
"""

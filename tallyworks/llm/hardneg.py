"""Hard negatives by distributed radix selection.

A window is an anchor's range of scores and the number of rows wanted from it: the best of
the anchor's own label, or, for each positive found so, those of other labels between two
shares of the positive's score. A row's place in a window is how far its score lies below
the window's top, then its key. Nothing is sorted to find the last place wanted: each pass
counts the places of the open interval in 256 buckets, the counts of all tasks are added
up by window and bucket, the bucket that holds the place is the next interval, and so on
digit by digit, first over scores and, only where equal scores are too many, over keys.
A window whose interval is small is closed; one last pass gathers the rows up to its end.

Rows are packed once. Every pass sends the anchors with open windows to all groups of rows
in blocks, and a task holds one block of anchors with its counts and one pack of rows at a
time. No score is stored, and no pair is but those gathered, a bounded number a window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .elkan import finite, floors
from .shared import column, settle, tidy, unit_count, unsettle

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
#: Buckets of a pass, as a power of two, and places of a window that are gathered beyond those wanted.
DIGIT, ROOM = 8, 16
#: Rows of a pack and of a group, anchors of a block, and scores at a time.
PACK, GROUP, ANCHORS, STEP = 1024, 1 << 16, 2048, 1 << 19
#: Tasks of a pass; where there are more cells a task takes several, one after another.
TASKS = 1 << 15
ROWS = "mark array<long>, key array<long>, label array<long>, d int, v array<long>"
#: A window's integers: number, top score, first and last place of scores, of keys (from the least key), rows to find there.
FIELDS = ("j", "top", "a", "b", "c", "d", "need")


def scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of rows: in doubles where these are exact, in 64 bits otherwise."""
    most = [int(np.abs(z).max(initial=0)) for z in (x, y)]
    bound = most[0] * most[1] * max(1, x.shape[1])
    if bound >= 1 << 62:
        raise OverflowError("scores do not fit into 64 bits")
    if bound < 1 << 53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x @ y.T


def pack(rows: DataFrame, no_key: int) -> DataFrame:
    """Rows (mark, key, label, v) of a partition in packs of PACK at most, one length of vectors each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                for k in range(0, len(at), PACK):
                    part = batch.take(pa.array(at[k : k + PACK]))
                    whole = [pa.array([part.column(n)], pa.list_(pa.int64())) for n in range(3)]
                    yield pa.RecordBatch.from_arrays([*whole, pa.array([int(d)], pa.int32()), pa.array([part.column(3).flatten()], pa.list_(pa.int64()))], names=["mark", "key", "label", "d", "v"])

    return rows.select("mark", F.coalesce("key", F.lit(no_key)).alias("key"), "label", "v").mapInArrow(tidy(run), ROWS)


def _numpy(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name))[row].values.to_numpy(zero_copy_only=False)


class _Block:
    """A block of anchors with their windows, of one length of vectors."""

    def __init__(self, found: list[tuple], d: int, least: int):
        self.v = np.stack([f[2] for f in found])
        self.label = np.array([f[1] for f in found])
        self.mark = np.array([f[0] for f in found])
        windows = [f[3].reshape(-1, len(FIELDS)) for f in found]
        self.w = np.concatenate(windows)
        self.owner = np.repeat(np.arange(len(found)), [len(w) for w in windows])
        self.first = np.concatenate([[0], np.cumsum([len(w) for w in windows])])
        field = lambda name: self.w[:, FIELDS.index(name)]
        self.top, self.a, self.b, self.c, self.e, self.need = (field(n) for n in ("top", "a", "b", "c", "d", "need"))
        self.by_key = self.a == self.b
        span = np.where(self.by_key, self.e - self.c, self.b - self.a)
        self.shift = np.array([max(0, int(s).bit_length() - DIGIT) for s in span])
        self.least, self.counts = least, np.zeros((len(self.w), 1 << DIGIT), dtype=np.int64)

    def met(self, batch: pa.RecordBatch, row: int, same: bool, gather: bool) -> Iterator[tuple[np.ndarray, ...]]:
        """Windows and rows in them up to their last place: (window, place of score, place of key, row's mark, key)."""
        mark, key, label = (_numpy(batch, n, row) for n in ("mark", "key", "label"))
        y = _numpy(batch, "v", row).reshape(len(mark), -1)
        each = max(1, STEP // max(1, len(mark)))
        place = key - self.least
        for k in range(0, len(self.v), each):
            to = min(len(self.v), k + each)
            s = scores(self.v[k:to], y)
            here = slice(self.first[k], self.first[to])
            if here.start == here.stop:
                continue
            # the lowest score that any window of an anchor still asks for
            low = np.minimum.reduceat(self.top[here] - self.b[here], self.first[k:to] - self.first[k])
            good = (s >= low[:, None]) & ((label[None, :] == self.label[k:to, None]) == same)
            if same:
                good &= mark[None, :] != self.mark[k:to, None]
            anchor, other = np.nonzero(good)
            score = s[anchor, other]
            anchor += k
            n = self.first[anchor + 1] - self.first[anchor]
            for j in range(int(n.max(initial=0))):
                on = np.flatnonzero(n > j)
                w = self.first[anchor[on]] + j
                below = self.top[w] - score[on]
                if gather:
                    p = place[other[on]]
                    inside = (below >= 0) & ((below < self.b[w]) | ((below == self.b[w]) & (p <= self.e[w])))
                else:
                    inside = (below >= self.a[w]) & (below <= self.b[w])
                    if self.by_key.any():
                        p = place[other[on]]
                        inside &= ~self.by_key[w] | ((p >= self.c[w]) & (p <= self.e[w]))
                hit = np.flatnonzero(inside)
                rows = other[on[hit]]
                yield w[hit], below[hit], place[rows], mark[rows], key[rows]

    def count(self, batch: pa.RecordBatch, row: int, same: bool) -> None:
        for w, below, place, _, _ in self.met(batch, row, same, False):
            digit = np.where(self.by_key[w], place - self.c[w], below - self.a[w]) >> self.shift[w]
            np.add.at(self.counts, (w, digit), 1)

    def histogram(self) -> pa.RecordBatch:
        """(mark, j, digit, n); buckets after the one in which the rows wanted are here already can't matter."""
        before = np.cumsum(self.counts, axis=1) - self.counts
        w, digit = np.nonzero((self.counts > 0) & (before < self.need[:, None]))
        return pa.RecordBatch.from_arrays([pa.array(self.mark[self.owner[w]]), pa.array(self.w[w, 0]), pa.array(digit), pa.array(self.counts[w, digit])], names=["mark", "j", "digit", "n"])

    def gathered(self, batch: pa.RecordBatch, row: int, same: bool, want: int) -> Iterator[pa.RecordBatch]:
        """Rows up to the last place; of rows alike in window, score and key, ``want``, as more can't be asked for."""
        for w, below, place, mark, key in self.met(batch, row, same, True):
            if len(w):
                order = np.lexsort((place, below, w))
                w, below, place, mark, key = (x[order] for x in (w, below, place, mark, key))
                new = np.append(True, (w[1:] != w[:-1]) | (below[1:] != below[:-1]) | (place[1:] != place[:-1]))
                turn = np.arange(len(w)) - np.flatnonzero(new)[np.cumsum(new) - 1]
                w, below, mark, key = (x[turn < want] for x in (w, below, mark, key))
                yield pa.RecordBatch.from_arrays([pa.array(self.mark[self.owner[w]]), pa.array(self.w[w, 0]), pa.array(self.top[w] - below), pa.array(mark), pa.array(key)], names=["mark", "j", "score", "row", "key"])


def _cells(least: int, same: bool, want: int | None = None) -> Callable:
    """Partition sorted by (p, q, d, kind): the anchors of a cell, then its packs of rows; ``want``: gather, do not count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found, block = None, [], None
        for batch in batches:
            p, q, d, kind = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("p", "q", "d", "kind"))
            for row in range(batch.num_rows):
                cell = (int(p[row]), int(q[row]), int(d[row]))
                if cell != now:
                    if block is not None and want is None:
                        yield block.histogram()
                    now, found, block = cell, [], None
                if kind[row] == 0:
                    found.append((_numpy(batch, "mark", row)[0], _numpy(batch, "label", row)[0], _numpy(batch, "v", row), _numpy(batch, "w", row)))
                    continue
                if block is None and found:
                    block, found = _Block(found, cell[2], least), []
                if block is None:
                    continue
                if want is not None:
                    yield from block.gathered(batch, row, same, want)
                else:
                    block.count(batch, row, same)
        if block is not None and want is None:
            yield block.histogram()

    return run


class _Grid:
    """Packs of rows dealt to groups, anchors to blocks; ``met`` brings each block to each group."""

    def __init__(self, packs: DataFrame, anchors: DataFrame, rows: int, n_anchors: int):
        self.spark = packs.sparkSession
        self.groups, self.blocks = max(unit_count(self.spark), -(-rows // GROUP)), max(1, -(-n_anchors // ANCHORS))
        self.packs = packs.withColumn("p", F.pmod(F.xxhash64(F.element_at("mark", 1)), F.lit(self.groups)).cast("int"))
        self.anchors = anchors

    def met(self, windows: DataFrame) -> DataFrame:
        """Rows of all cells, sorted; ``windows``: (mark, j, top, a, b, c, d, need)."""
        lists = windows.groupBy("mark").agg(F.flatten(F.collect_list(F.array(*[F.col(f).cast("long") for f in FIELDS]))).alias("w"))
        some = self.anchors.join(lists, "mark").select(F.array("mark").alias("mark"), F.array("key").alias("key"), F.array("label").alias("label"), F.size("v").alias("d"), "v", "w", F.lit(0).alias("kind"), F.pmod(F.xxhash64("mark"), F.lit(self.blocks)).cast("int").alias("q"))
        some = some.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1))))
        rows = self.packs.select("mark", "key", "label", "d", "v", F.lit(None).cast("array<long>").alias("w"), F.lit(1).alias("kind"), F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))).alias("q"), "p")
        both = some.unionByName(rows)
        return both.repartition(min(TASKS, self.groups * self.blocks), "p", "q").sortWithinPartitions("p", "q", "d", "kind")


def select(grid: _Grid, windows: DataFrame, want: int, same: bool, keys: tuple[int, int]) -> DataFrame:
    """(mark, j, rank, score, row, key): the first ``want`` rows of each window, all if fewer.

    ``windows``: (mark, j, top, b) with the top score and the last place below it.
    """
    least, most = keys
    spark = windows.sparkSession
    table, path = settle(windows.select("mark", "j", "top", F.lit(0).cast("long").alias("a"), "b", F.lit(0).cast("long").alias("c"), F.lit(most - least).cast("long").alias("d"), F.lit(want).cast("long").alias("need"), F.lit(False).alias("closed")))
    while not table.where("NOT closed").isEmpty():
        counts = grid.met(table.where("NOT closed")).mapInArrow(tidy(_cells(least, same)), "mark long, j long, digit long, n long")
        counts = counts.groupBy("mark", "j", "digit").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("mark", "j").orderBy("digit"))
        held = counts.withColumn("upto", upto).withColumn("digit_before", F.col("upto") - F.col("n"))
        places = table.select("mark", "j", F.col("need").alias("wanted")).where("NOT closed")
        held = held.join(places, ["mark", "j"]).where("upto >= wanted AND digit_before < wanted").select("mark", "j", "digit", "n", "digit_before")
        new, new_path = settle(_refined(table.join(held, ["mark", "j"], "left")))
        unsettle(spark, path)
        table, path = new, new_path
    found = grid.met(table).mapInArrow(tidy(_cells(least, same, want)), "mark long, j long, score long, row long, key long")
    rank = F.row_number().over(Window.partitionBy("mark", "j").orderBy(F.desc("score"), "key", "row"))
    out, _ = settle(found.withColumn("rank", rank).where(F.col("rank") <= want))
    unsettle(spark, path)
    return out


def _refined(rows: DataFrame) -> DataFrame:
    """Open windows with the bucket found as their interval; one with no such bucket holds fewer rows than wanted and takes all."""
    none = F.col("digit").isNull()
    by_key = F.col("a") == F.col("b")
    span = F.when(by_key, F.col("d") - F.col("c")).otherwise(F.col("b") - F.col("a"))
    bits = F.when(span > 0, F.length(F.bin(span))).otherwise(0)
    shift = F.greatest(F.lit(0), bits - DIGIT)
    at = lambda first: first + F.call_function("shiftleft", F.col("digit"), shift.cast("int"))
    wide = F.call_function("shiftleft", F.lit(1).cast("long"), shift.cast("int")) - 1
    new = {
        "a": F.when(by_key, F.col("a")).otherwise(at(F.col("a"))),
        "b": F.when(by_key, F.col("b")).otherwise(F.least(F.col("b"), at(F.col("a")) + wide)),
        "c": F.when(by_key, at(F.col("c"))).otherwise(F.col("c")),
        "d": F.when(by_key, F.least(F.col("d"), at(F.col("c")) + wide)).otherwise(F.col("d")),
        "need": F.col("need") - F.col("digit_before"),
    }
    moved = rows.select("mark", "j", "top", F.col("closed").alias("was"), none.alias("none"), F.col("n").alias("held"), by_key.alias("by_key"), *[F.col(f).alias(f"old_{f}") for f in new], *[x.alias(f) for f, x in new.items()])
    keep = F.col("was") | F.col("none")
    picked = [F.when(keep, F.col(f"old_{f}")).otherwise(F.col(f)).alias(f) for f in new]
    # few rows, or rows alike in score and key, of which any will do
    closed = keep | (F.col("held") <= F.col("need") + ROOM) | (F.col("by_key") & (F.col("c") == F.col("d")))
    return moved.select("mark", "j", "top", *picked, closed.alias("closed")).select("mark", "j", "top", "a", "b", "c", "d", "need", "closed")


def share(score: Column, percent: int, up: bool) -> Column:
    """percent * score / 100, rounded up or down, without leaving 64 bits."""
    tens, rest = F.floor(score / F.lit(100)), F.pmod(score, F.lit(100)) * percent
    return tens * percent + (F.ceil(rest / 100) if up else F.floor(rest / 100))


def mine(vectors: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Rows with a null label or vector or a null or non-finite component take no part. Labels
    are integers. A score is the inner product of components times ``scale``, rounded down;
    rows of different lengths have none. Rows where ``anchor`` is true are anchors; their
    positives are the best ``positives`` other rows of the label, and for each the best
    ``negatives`` rows of other labels whose scores are ``low`` to ``high`` hundredths of its
    own are returned. Ties go to the smaller key, null keys last (keys span less than 2^63); rows that repeat a key are
    rows of their own. An empty table, or one without anchors, gives an empty result; further
    columns are left out.
    """
    rows = vectors.select(F.monotonically_increasing_id().alias("mark"), column(key).cast("long").alias("key"), column(label).cast("long").alias("label"), column(vector).alias("x"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.where(F.col("label").isNotNull() & finite(F.col("x"))).select("mark", "key", "label", floors(F.col("x"), scale).alias("v"), "anchor")
    rows, rows_path = settle(rows)
    square = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)
    n, n_anchors, least, most, norm = rows.agg(F.count("*"), F.count_if("anchor"), F.min("key"), F.max("key"), F.max(square)).first()
    if not n_anchors:
        return rows.limit(0).select(*[F.col("mark").alias(c) for c in ("anchor_id", "positive_id")], F.lit(1).alias("rank"), *[F.col("mark").alias(c) for c in ("negative_id", "positive_score", "negative_score")])
    anchors, _ = settle(rows.where("anchor").drop("anchor"))
    no_key = 0 if most is None else most + 1
    packs, _ = settle(pack(rows, no_key))
    grid = _Grid(packs, anchors, n, n_anchors)
    keys = (no_key if least is None else least, no_key)
    unsettle(rows.sparkSession, rows_path)
    # no score is further from zero than the largest square
    best = select(grid, anchors.select("mark", F.lit(1).cast("long").alias("j"), F.lit(norm).cast("long").alias("top"), F.lit(2 * norm).cast("long").alias("b")), positives, True, keys)
    best = best.select("mark", F.col("rank").cast("long").alias("j"), F.col("key").alias("positive"), F.col("score").alias("positive_score"))
    ranges = best.select("mark", "j", share(F.col("positive_score"), high, False).alias("top"), share(F.col("positive_score"), low, True).alias("bottom")).where("top >= bottom")
    worst = select(grid, ranges.select("mark", "j", "top", (F.col("top") - F.col("bottom")).alias("b")), negatives, False, keys)
    named = lambda c: F.when(F.col(c) != no_key, F.col(c))
    worst = worst.select("mark", "j", "rank", F.col("key").alias("negative"), F.col("score").alias("negative_score"))
    out = worst.join(best, ["mark", "j"]).join(anchors.select("mark", F.col("key").alias("anchor_id")), "mark")
    return out.select("anchor_id", named("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), named("negative").alias("negative_id"), "positive_score", "negative_score")


def report(vectors: DataFrame) -> DataFrame:
    """Anchors are the keys divisible by 50; labels of keys divisible by 7 move on by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % 50 == 0)


SQL = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.r AS a, a.vec_id AS anchor_id, a.label = b.label AS same, b.r AS r, b.vec_id AS id,
    coalesce(CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT), 0) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.r <> b.r AND len(a.v) = len(b.v)),
p AS (SELECT a, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY a ORDER BY score DESC, id NULLS LAST) AS j FROM s WHERE same QUALIFY j <= {POSITIVES}),
n AS (SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY a, j ORDER BY score DESC, id NULLS LAST) AS rank
  FROM p JOIN s USING (a, anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score QUALIFY rank <= {NEGATIVES})
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n
"""

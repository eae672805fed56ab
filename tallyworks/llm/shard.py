"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Each shard draws a number for each key from a hash of both; -ln(u) / weight is smallest
for the winner, so a shard wins in proportion to its weight. A further shard changes
only the keys that it wins itself. Slots number a shard's rows without a gap: rows are
counted by shard and slice (a hash of what they are ordered by), the counts become
offsets, and only the rows of one slice are ranked together. Slices grow in number with
the rows; one that is large all the same, as its rows are alike, is parted further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import boxed, column, settle

OVERHEAD = 16
SHARDS = 40
#: Slices of a shard at least, and rows of a slice that are ranked together.
SLICES, ROOM = 256, 50_000


def draw(key: Column, shard: Column) -> Column:
    """A number in (0, 1) from 52 bits of an MD5 over key and shard."""
    digits = F.substring(F.md5(F.concat(key, F.lit("/"), shard.cast("string"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def winner(key: Column, weights: list[float]) -> Column:
    """The shard of a key; between equal draws the lower shard wins."""
    if not weights or min(weights) <= 0:
        raise ValueError("shards need weights above zero")
    table = F.array(*[F.lit(float(w)) for w in weights])
    scores = F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), lambda s: F.struct((-F.ln(draw(key, s)) / F.get(table, s)).alias("score"), s.alias("shard")))
    return F.array_min(scores)["shard"]


def assign(docs: DataFrame, weights: list[float], key: str = "doc_id", to: str = "shard") -> DataFrame:
    """Adds the shard by ``key`` alone: rows with one key share a shard, null keys count as one key.

    Repeated rows, null and empty texts and an empty table are taken as they are; a former
    column of the name ``to`` is replaced, all others stay.
    """
    return docs.withColumn(to, winner(F.coalesce(column(key).cast("string"), F.lit("")), weights))


def number(rows: DataFrame, order: list[str], shard: str = "shard", to: str = "slot") -> DataFrame:
    """Adds slots from 0 without a gap in each shard, ordered by a hash of ``order`` and ``order``.

    Rows alike in all of ``order`` may take each other's slots. A former column of the name
    ``to`` is replaced, all others stay.
    """
    by = [column(c) for c in order]
    box = boxed(rows, (to,), shard=column(shard), at=F.monotonically_increasing_id(), key=F.struct(*by), hash=F.xxhash64(*by))
    box, _ = settle(box)
    shares = box.groupBy("shard").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    box = box.withColumn("slice", F.pmod("hash", F.lit(max(SLICES, 4 * shares // ROOM))))
    large = box.groupBy("shard", "slice").agg(F.count("*").alias("n")).where(F.col("n") > ROOM).select("shard", "slice", F.ceil(F.col("n") / ROOM).alias("parts"))
    box = box.join(large, ["shard", "slice"], "left").withColumn("part", F.coalesce(F.pmod("at", "parts"), F.lit(0)))
    counts = box.groupBy("shard", "slice", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("slice", "part")) - F.col("n")
    offsets = counts.select("shard", "slice", "part", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "slice", "part").orderBy("key")) - 1
    return box.withColumn("rank", rank).join(offsets, ["shard", "slice", "part"]).select("row.*", (F.col("before") + F.col("rank")).cast("long").alias(to))


def write_shards(docs: DataFrame, path: str, weights: list[float], key: str = "doc_id") -> None:
    """One folder per shard; each is written by several tasks, dealt by shard and slice."""
    salt = F.substring(F.md5(F.col(key).cast("string")), 1, 1)
    assign(docs, weights, key).repartition("shard", salt).write.partitionBy("shard").parquet(path)


def report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text).alias("text_crc32"))
    rows = assign(rows, [1.0] * shards)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    last = draw(key, F.lit(shards)) > draw(key, F.col("shard"))  # equal weights: the larger draw wins
    rows = rows.withColumn("grown_shard", F.when(last, F.lit(shards)).otherwise(F.col("shard")).cast("int"))
    out = number(rows, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", "grown_shard")


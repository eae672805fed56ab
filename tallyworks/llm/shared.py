"""Helpers that several operators share: cutting lineage, byte-level words, components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# ---------------------------------------------------------------- columns


def column(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def boxed(df: DataFrame, without: tuple[str, ...] = (), **named: Column) -> DataFrame:
    """All columns but ``without`` in one struct ``row``, and the named ones beside it: no name of the caller's can clash."""
    return df.select(F.struct(*[column(c) for c in df.columns if c not in without]).alias("row"), *[c.alias(n) for n, c in named.items()])


# ---------------------------------------------------------------- lineage


_folders: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir. Only a session in one process may leave it unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tallyworks-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def settled_dir(spark: SparkSession) -> str:
    """The session's folder for tables between stages; it goes with the session, or by ``clear``."""
    path = f"{shared_dir(spark)}/settled/{spark.sparkContext.applicationId}"
    if path not in _folders:
        _folders.add(path)
        atexit.register(_forget, spark, path)
    return path


def settle(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` as a table in the shared folder and read it back; returns the path too."""
    spark = df.sparkSession
    path = f"{settled_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def unsettle(spark: SparkSession, *paths: str) -> None:
    """Remove tables that ``settle`` wrote."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear(spark: SparkSession) -> None:
    """Remove all tables between stages of this session; for when its results have been written."""
    unsettle(spark, settled_dir(spark))


def _forget(spark: SparkSession, path: str) -> None:
    with suppress(Exception):  # the session's JVM may be gone
        unsettle(spark, path)


def unit_count(spark: SparkSession) -> int:
    """Partitions that keyed work is dealt over."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, text: str) -> int:
    """UTF-8 bytes of a column over all rows: sets numbers of buckets, never drops rows."""
    return df.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0


# ---------------------------------------------------------------- memory of Python workers


def release() -> None:
    """Give freed memory back: workers outlive their tasks and wait, several on each executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable) -> Callable:
    """``run`` over batches of a partition, with ``release`` when it ends."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return tidied


def tidy_group(run: Callable) -> Callable:
    """``run`` over the table of a group, with ``release`` after each."""

    def tidied(table: pa.Table) -> pa.Table:
        out = run(table)
        release()
        return out

    return tidied


# ---------------------------------------------------------------- components


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge list; component is the smallest node reachable.

    Alternating large-star and small-star rounds. Each is a grouped minimum (combined
    before the shuffle) and an equi-join that adaptive execution may split, so a hub
    of any degree passes through no single task. Every round is written to the shared
    folder, which cuts the lineage; the loop ends when a round changes nothing.
    """
    spark = edges.sparkSession
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, path = settle(now)
    mark = _fingerprint(now)
    while mark[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u != v")
            .distinct()
        )
        new, new_path = settle(small)
        new_mark = _fingerprint(new)
        unsettle(spark, path)
        now, path = new, new_path
        if new_mark == mark:
            break
        mark = new_mark
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    h = F.xxhash64("u", "v")
    row = edges.agg(F.count("*"), F.sum(F.shiftrightunsigned(h, 20)), F.sum(h.bitwiseAND(F.lit(0xFFFFF)))).first()
    return tuple(x or 0 for x in row)


# ---------------------------------------------------------------- words over bytes


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: \x20 and \x09-\x0D separate words; every other byte belongs to one.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: After lower-casing: digits, a-z and every byte of a character beyond ASCII.
ALNUM_OR_HIGH = np.zeros(256, dtype=bool)
ALNUM_OR_HIGH[48:58] = ALNUM_OR_HIGH[97:123] = ALNUM_OR_HIGH[128:] = True

_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLY_2 = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _MULTIPLY_2
    h ^= h >> np.uint64(29)
    h = h * _MULTIPLY
    h ^= h >> np.uint64(32)
    return h


class Texts:
    """UTF-8 bytes of an Arrow string array, end to end; a null text is empty."""

    def __init__(self, column: pa.Array, fold: bool = False):
        column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
        if column.null_count:
            column = column.fill_null(b"")
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
        first, last = (int(offsets[0]), int(offsets[-1])) if n else (0, 0)
        body = column.buffers()[2]
        raw = np.frombuffer(body, dtype=np.uint8)[first:last] if body is not None and last > first else np.zeros(0, np.uint8)
        self.offsets = offsets - first if n else np.zeros(1, np.int64)
        self.bytes = np.zeros(len(raw) + 16, dtype=np.uint8)  # loads of eight bytes may read past the end
        self.bytes[: len(raw)] = LOWER[raw] if fold else raw
        self.size = len(raw)


class Words:
    """Words of ``texts``: byte bounds, 64-bit hashes, and each text's range among them."""

    def __init__(self, texts: Texts, is_word: np.ndarray):
        inside = is_word[texts.bytes[: texts.size]]
        at = texts.offsets
        before = np.zeros(texts.size, dtype=bool)
        before[1:] = inside[:-1]
        before[at[:-1][at[:-1] < texts.size]] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(texts.size, dtype=bool)
        after[:-1] = inside[1:]
        ends = at[1:][at[1:] > 0] - 1
        after[ends] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        #: words of text i are first[i] .. first[i + 1]
        self.first = np.searchsorted(self.start, at)
        self.texts = texts

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        load = np.ndarray(shape=(len(self.texts.bytes) - 7,), dtype="<u8", buffer=self.texts.bytes, strides=(1,))
        length = self.end - self.start
        h = mix((load[self.start] & _MASK[np.minimum(length, 8)]) + length.astype(np.uint64) * _MULTIPLY)
        more = np.flatnonzero(length > 8)
        k = 8
        while len(more):
            part = load[self.start[more] + k] & _MASK[np.minimum(length[more] - k, 8)]
            h[more] = mix(h[more] * _MULTIPLY_2 + part)
            k += 8
            more = more[length[more] > k]
        return h

    def owner(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def slices(batch: pa.RecordBatch, text: str, limit: int):
    """Row ranges of a batch that hold about ``limit`` bytes of text each (a longer text stands alone)."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // max(1, limit)
    cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cut, cut[1:]):
        if b > a:
            yield batch.slice(a, b - a)

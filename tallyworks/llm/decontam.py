"""Benchmark decontamination with suffix arrays of the training texts.

Each block of documents becomes a sorted array of its word suffixes, and every suffix
of the benchmark items is binary-searched in it, once from below and once from above;
the range between holds all occurrences of the suffix's first ``window`` words.
Occurrences that continue each other (next word of the item, next word of the document)
are one longer verbatim match, so longest matches and their places follow from the
ranges. A suffix enters the array only if it can begin a match: its first words must
all be words of the benchmark, for as long as the shortest window that begins with its
first word. No occurrence is lost by that, and the sort touches few suffixes.

The benchmark is taken in blocks of bounded size, each in a job of its own that broadcasts
that block alone: what a task holds does not grow with the benchmark. Between two blocks
the documents, with the hits so far, are a table in the shared folder; they are never
shuffled. Items and matches are made only where they are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import ALNUM_OR_HIGH, Texts, Words, boxed, column, settle, slices, tidy, unsettle

WINDOW = 10
BLOCK_BYTES = 4 << 20
#: Text of the benchmark that one broadcast holds; a larger benchmark takes several passes.
BENCHMARK_BYTES = 8 << 20


class Suffixes:
    """Windows of a block of items: word table, search keys, and where each window stands."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int):
        words = Words(Texts(pa.array(texts, pa.string()), fold=True), ALNUM_OR_HIGH)
        hashes = words.hashes()
        self.window, self.ids = window, ids
        self.vocabulary = np.unique(hashes)
        self.seen = np.zeros(1 << 16, dtype=bool)
        self.seen[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True
        self.shortest = np.full(len(self.vocabulary) + 1, np.iinfo(np.int64).max)
        number = np.searchsorted(self.vocabulary, hashes) + 1
        sizes = np.diff(words.first)
        counts = np.where(sizes == 0, 0, np.maximum(1, sizes - window + 1))
        item = np.repeat(np.arange(len(sizes)), counts)
        place = np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = words.first[:-1][item] + place
        length = np.minimum(sizes[item], window)
        keys = suffix_keys(number, start, words.first[1:][item], window)
        np.minimum.at(self.shortest, number[start], length)
        #: distinct windows; which[k] .. which[k + 1] of (item, place) have window k
        self.keys, inverse = np.unique(keys, return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        self.which = np.searchsorted(inverse[order], np.arange(len(self.keys) + 1))
        self.item, self.place = item[order], place[order]
        self.length = np.zeros(len(self.keys), dtype=np.int64)
        self.length[inverse] = length
        rows = self.keys.view(">u4").reshape(len(self.keys), window).copy() if len(self.keys) else np.zeros((0, window), ">u4")
        rows[np.arange(window) >= self.length[:, None]] = 0xFFFFFFFF
        self.above = rows.view(f"S{4 * window}").ravel()

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word in the vocabulary, 0 for others."""
        out = np.zeros(len(hashes), dtype=np.int64)
        maybe = np.flatnonzero(self.seen[(hashes >> np.uint64(48)).astype(np.int64)])
        at = np.searchsorted(self.vocabulary, hashes[maybe])
        at[at == len(self.vocabulary)] = 0
        good = self.vocabulary[at] == hashes[maybe] if len(self.vocabulary) else np.zeros(len(maybe), bool)
        out[maybe[good]] = at[good] + 1
        return out

    def occurrences(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(window, first word) of every occurrence of every window."""
        number = self.number(words.hashes())
        begin = np.flatnonzero(number)
        stops = np.flatnonzero(number == 0)
        owner_end = words.first[np.searchsorted(words.first, begin, side="right")]
        after = np.concatenate([stops, [len(number)]])[np.searchsorted(stops, begin)]
        run = np.minimum(after, owner_end) - begin
        keep = run >= self.shortest[number[begin]]
        begin, end = begin[keep], owner_end[keep]
        keys = suffix_keys(number, begin, end, self.window)
        array = np.argsort(keys, kind="stable")
        keys = keys[array]
        low, high = np.searchsorted(keys, self.keys, "left"), np.searchsorted(keys, self.above, "right")
        count = high - low
        window = np.repeat(np.arange(len(count)), count)
        rank = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        return window, begin[array[rank]]


def suffix_keys(number: np.ndarray, start: np.ndarray, end: np.ndarray, window: int) -> np.ndarray:
    """The first ``window`` word numbers of each suffix as bytes that sort like the suffix; zeros past its text."""
    at = start[:, None] + np.arange(window)
    rows = np.where(at < end[:, None], np.append(number, 0)[np.minimum(at, len(number))], 0).astype(">u4")
    return np.ascontiguousarray(rows).view(f"S{4 * window}").ravel() if len(rows) else np.zeros(0, f"S{4 * window}")


def _hits(words: Words, index: Suffixes, window: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which words lie in an occurrence."""
    step = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, first + index.length[window], -1)
    return np.cumsum(step)[:-1] > 0


def _items(words: Words, index: Suffixes, window: np.ndarray, first: np.ndarray, n_docs: int) -> pa.Array:
    """Per document the ids of its items; a window that it repeats counts once."""
    n, m = max(1, len(index.keys)), max(1, len(index.ids))
    pair = np.unique((np.searchsorted(words.first, first, side="right") - 1) * n + window)
    doc, window = pair // n, pair % n
    count = index.which[window + 1] - index.which[window]
    each = np.repeat(index.which[window], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    pair = np.unique(np.repeat(doc, count) * m + index.item[each])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(pair // m, np.arange(n_docs + 1)), pa.int32()), pa.array(index.ids, pa.string()).take(pa.array(pair % m)))


def _matches(words: Words, index: Suffixes, window: np.ndarray, first: np.ndarray, n_docs: int) -> pa.Array:
    """Per document its longest match with each of its items."""
    count = index.which[window + 1] - index.which[window]
    each = np.repeat(index.which[window], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    item, place, at = index.item[each], index.place[each], np.repeat(first, count)
    length = np.repeat(index.length[window], count)
    doc = np.searchsorted(words.first, at, side="right") - 1
    order = np.lexsort((place, at - place, item, doc))
    doc, item, place, at, length = doc[order], item[order], place[order], at[order], length[order]
    fresh = np.ones(len(doc), dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (np.diff(at) != 1) | (np.diff(place) != 1)
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(doc))[: len(head)] - 1
    span = at[tail] + length[tail] - at[head]
    best = np.lexsort((at[head], -span, item[head], doc[head]))
    d, i = doc[head][best], item[head][best]
    one = np.ones(len(best), dtype=bool)
    one[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1])
    best = best[one]
    h = head[best]
    ends = pa.array(np.searchsorted(doc[h], np.arange(n_docs + 1)), pa.int32())
    names = pa.array(index.ids, pa.string()).take(pa.array(item[h]))
    rows = [names, pa.array(place[h], pa.int64()), pa.array(at[h] - words.first[doc[h]], pa.int64()), pa.array(span[best], pa.int64())]
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(rows, names=MATCH.names))


MATCH = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_start", T.LongType()), T.StructField("doc_start", T.LongType()), T.StructField("n_words", T.LongType())])
_FOUND = {"n_words": T.LongType(), "hits": T.BinaryType()}
_TOLD = {"items": T.ArrayType(T.StringType()), "matches": T.ArrayType(MATCH)}


def search(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: list[str] | None = None, benchmark_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """Adds to each document n_words, n_hit, items, matches and contaminated.

    ``items`` holds the ids (as strings, sorted, each once) of the items of which a window
    occurs; ``matches`` the longest verbatim match with each, with its place in item and
    document, counted in words. A null or wordless text has no words and no hit; an item
    without words has no window; an item without an id counts under the empty string; items
    that share an id count once, repeated rows of the benchmark are one. Repeated documents
    are judged alike; an empty table of either kind gives no hit. Of columns, ``keep`` (all)
    stay; former columns of the five new names are replaced.
    """
    new = ["n_words", "n_hit", "items", "matches", "contaminated"]
    names = [c for c in (keep if keep is not None else docs.columns) if c not in new]
    found = _find(docs.select(F.struct(*map(column, names)).alias("row"), column(text).alias("text")), benchmark, item_id, item_text, window, benchmark_bytes)
    return found.select("row.*", "n_words", "n_hit", "items", "matches", (F.col("n_hit") > 0).alias("contaminated"))


def _find(out: DataFrame, benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, benchmark_bytes: int = BENCHMARK_BYTES, told: tuple[str, ...] = tuple(_TOLD)) -> DataFrame:
    """(row, n_words, n_hit) from (row, text), in one job for each block of the benchmark; with those of items and matches that are ``told``."""
    spark, row, path = out.sparkSession, out.schema["row"], None
    items = benchmark.select(F.coalesce(column(item_id).cast("string"), F.lit("")).alias("i"), column(item_text).alias("t")).distinct()
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = int(size // benchmark_bytes) + 1
    if blocks > 1:
        items, _ = settle(items)
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).toPandas()
        index = spark.sparkContext.broadcast(Suffixes(rows["i"].tolist(), rows["t"].tolist(), window))
        last = k == blocks - 1
        kept = [row] if last else [row, T.StructField("text", T.StringType())]
        made = [T.StructField(n, t) for n, t in (_FOUND | {n: _TOLD[n] for n in told}).items() if not (n == "hits" and last)] + [T.StructField("n_hit", T.LongType())] * last
        out = out.mapInArrow(tidy(_pass(index, k == 0, last, told)), T.StructType([*kept, *made]))
        if not last:
            before, (out, path) = path, settle(out)
            index.unpersist()
            if before is not None:
                unsettle(spark, before)
    return out.withColumn("items", F.array_sort(F.array_distinct("items"))) if "items" in told else out


def _pass(index, is_first: bool, is_last: bool, told: tuple[str, ...]):
    """One block of the benchmark against all documents; hits so far travel as packed bits."""

    def joined(old: pa.Array, new: pa.Array) -> pa.Array:
        return pa.array([a + b for a, b in zip(old.to_pylist(), new.to_pylist())], new.type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes = index.value
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                col = {n: part.column(k) for k, n in enumerate(part.schema.names)}
                words = Words(Texts(col["text"], fold=True), ALNUM_OR_HIGH)
                met = suffixes.occurrences(words)
                hit = _hits(words, suffixes, *met)
                if not is_first:
                    for k, (a, b) in enumerate(zip(words.first[:-1], words.first[1:])):
                        hit[a:b] |= np.unpackbits(np.frombuffer(col["hits"][k].as_py(), np.uint8), count=b - a).astype(bool)
                found = {n: col[n] for n in (["row"] if is_last else ["row", "text"])} | {"n_words": pa.array(np.diff(words.first), pa.int64())}
                if not is_last:
                    found["hits"] = pa.array([np.packbits(hit[a:b]).tobytes() for a, b in zip(words.first[:-1], words.first[1:])], pa.binary())
                for name in told:
                    new = {"items": _items, "matches": _matches}[name](words, suffixes, *met, part.num_rows)
                    found[name] = new if is_first else joined(col[name], new)
                if is_last:
                    total = np.concatenate([[0], np.cumsum(hit)])
                    found["n_hit"] = pa.array(total[words.first[1:]] - total[words.first[:-1]], pa.int64())
                yield pa.RecordBatch.from_arrays(list(found.values()), names=list(found))

    return run


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents of which no word is hit, with their own columns, whatever these are called."""
    return _find(boxed(docs, text=column(text)), benchmark, told=(), **options).where("n_hit = 0").select("row.*")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = search(docs, benchmark, keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["n_words"])), F.lit(0).cast("long")).alias("longest_match"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT row_number() OVER () AS r, coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS ws FROM benchmark),
w AS (SELECT *, least(len(ws), {WINDOW}) AS n FROM b WHERE len(ws) > 0),
bw AS (SELECT r, item, n, unnest(range(1, len(ws) - n + 2)) AS q, unnest(list_transform(range(1, len(ws) - n + 2), lambda p: array_to_string(ws[p : p + n - 1], ' '))) AS k FROM w),
dw AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS p, unnest(list_transform(range(1, len(ws) - n + 2), lambda p: array_to_string(ws[p : p + n - 1], ' '))) AS k FROM d JOIN (SELECT DISTINCT n FROM w) ON len(ws) >= n),
h AS (SELECT doc_id, p, q, n, r, item FROM dw JOIN bw USING (n, k)),
s AS (SELECT doc_id, count(DISTINCT p + o) AS n_hit FROM (SELECT DISTINCT doc_id, p, n FROM h), range({WINDOW}) AS t(o) WHERE o < n GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1),
g AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, r, p - q ORDER BY p) AS run FROM h),
m AS (SELECT doc_id, max(span) AS longest FROM (SELECT doc_id, max(p) - min(p) + max(n) AS span FROM g GROUP BY doc_id, r, p - q, run) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest_match
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN m USING (doc_id)
"""

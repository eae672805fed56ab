"""Removal of repeated passages by Rabin-Karp hashes of every fixed-length word window.

A block of documents gets the rolling hashes of all its windows: prefix sums of word
hashes times powers of an odd base, modulo 2**64, give each window in constant time.
A block keeps the first window of each hash (windows after it in the block are repeats
already) and sends those to the hash's bucket, packed: eight bytes of hash and about two
of place. A bucket counts what blocks sent for a hash and answers with every place but
the first. So a hash costs a bucket one entry per block, however frequent it is, and the
number of buckets follows the input's size. Answers go, packed again, to groups of
documents, where the windows of each document merge into maximal intervals: one row for
each document that loses words. These meet the texts, which are shuffled once.

A hash has 64 bits and its bucket adds log2(buckets) bits of an independent second hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import NOT_SPACE, Texts, Words, boxed, column, mix, slices, text_bytes, tidy, tidy_group, unit_count

WINDOW = 20
#: Text of a block when sent and when cut, and text for each bucket.
BLOCK_BYTES = 4 << 20
CUT_BYTES = 4 << 20
BUCKET_BYTES = 14 << 20
NO_ID = -(1 << 63)
_BASES = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)


def rolling(hashes: np.ndarray, start: np.ndarray, window: int, base: int) -> np.ndarray:
    """Hash of ``window`` words from each start: the sum of word hash i times base ** (start - i), modulo 2 ** 64."""
    n = len(hashes)
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n + 1, base, np.uint64), np.full(n + 1, inverse, np.uint64)
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * down[:n], dtype=np.uint64)])
    return mix((sums[start + window] - sums[start]) * up[start])


def _planes(x: np.ndarray) -> bytes:
    """Differences, byte plane by byte plane: small steps compress to little."""
    d = np.diff(x, prepend=x.dtype.type(0))
    return np.ascontiguousarray(d.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplanes(raw: bytes, n: int, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    d = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(dtype).ravel()
    return np.cumsum(d, dtype=dtype)


def pack(ids: np.ndarray, marks: np.ndarray, places: np.ndarray, hashes: np.ndarray | None = None) -> bytes:
    body = _planes(ids) + _planes(marks) + _planes(places)
    small = pa.compress(body, codec="zstd", asbytes=True)
    return len(ids).to_bytes(4, "little") + len(small).to_bytes(4, "little") + small + (hashes.tobytes() if hashes is not None else b"")


def places_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, size = int.from_bytes(raw[:4], "little"), int.from_bytes(raw[4:8], "little")
    body = pa.decompress(raw[8 : 8 + size], decompressed_size=16 * n, codec="zstd", asbytes=True)
    return _unplanes(body[: 8 * n], n, np.int64), _unplanes(body[8 * n : 12 * n], n, np.int32), _unplanes(body[12 * n :], n, np.int32)


def hashes_of(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64, offset=8 + int.from_bytes(raw[4:8], "little"))


def _send(window: int, buckets: int):
    """Blocks of (id, mark, text) to packed rows (bucket, repeat, payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                ids = part.column(0).to_numpy(zero_copy_only=False)
                marks = part.column(1).to_numpy(zero_copy_only=False)
                order = np.lexsort((marks, ids))
                fresh = np.ones(len(order), dtype=bool)  # rows alike in id and text are one document
                fresh[1:] = (np.diff(ids[order]) != 0) | (np.diff(marks[order]) != 0)
                order = order[fresh]
                ids, marks = ids[order], marks[order]
                words = Words(Texts(part.column(2).take(pa.array(order))), NOT_SPACE)
                owner = words.owner()
                start = np.flatnonzero(np.arange(len(words)) + window <= words.first[1:][owner])
                if not len(start):
                    continue
                base = words.hashes()
                h = rolling(base, start, window, _BASES[0])
                owner = owner[start]
                place = (start - words.first[owner]).astype(np.int32)
                rank = np.argsort(h, kind="stable")
                first = np.ones(len(h), dtype=bool)
                first[rank[1:]] = h[rank[1:]] != h[rank[:-1]]
                again = np.flatnonzero(~first)
                rows = []
                if len(again):
                    at = owner[again]
                    rows.append((int(h[again[0]] % np.uint64(buckets)), True, pack(ids[at], marks[at], place[again])))
                bucket = (rolling(mix(base ^ np.uint64(_BASES[1])), start[first], window, _BASES[1]) % np.uint64(buckets)).astype(np.int32)
                sent = np.flatnonzero(first)
                by = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(edges)):
                    k = sent[by[edges[b] : edges[b + 1]]]
                    rows.append((int(b), False, pack(ids[owner[k]], marks[owner[k]], place[k], h[k])))
                for k in range(0, len(rows), 64):
                    some = list(zip(*rows[k : k + 64]))
                    yield pa.RecordBatch.from_arrays([pa.array(some[0], pa.int64()), pa.array(some[1]), pa.array(some[2], pa.binary())], names=["bucket", "repeat", "payload"])

    return run


def _answer(groups: int):
    """All of one bucket: places of every window but the first of each hash, packed by group of documents."""

    def run(table: pa.Table) -> pa.Table:
        sent, found = [], []
        for repeat, payload in zip(table.column("repeat").to_pylist(), table.column("payload")):
            if repeat:
                found.append(places_of(payload.as_py()))
            else:
                sent.append(payload.as_buffer())
        if sent:
            found.append(_later(sent))
        ids, marks, places = (np.concatenate(x) for x in zip(*found))
        group = (mix(ids.view(np.uint64) ^ marks.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)
        order = np.lexsort((places, marks, ids, group))
        ids, marks, places, group = ids[order], marks[order], places[order], group[order]
        head = np.flatnonzero(np.diff(group, prepend=-1))
        cut = [*head.tolist(), len(ids)]
        payloads = [pack(ids[a:b], marks[a:b], places[a:b]) for a, b in zip(cut, cut[1:])]
        return pa.table({"group": pa.array(group[head], pa.int64()), "payload": pa.array(payloads, pa.binary())})

    return run


def _later(sent: list[pa.Buffer]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows that blocks sent, those whose hash another one has at an earlier place."""
    h = np.concatenate([hashes_of(x) for x in sent])
    rank = np.argsort(h, kind="stable")
    same = np.zeros(len(h) + 1, dtype=bool)
    same[1:-1] = h[rank[1:]] == h[rank[:-1]]
    many = np.sort(rank[same[1:] | same[:-1]])  # places are unpacked for these alone
    h, edge, parts = h[many], 0, []
    for raw in sent:
        n = int.from_bytes(raw[:4], "little")
        some = many[np.searchsorted(many, edge) : np.searchsorted(many, edge + n)] - edge
        parts.append([x[some] for x in places_of(raw.to_pybytes())] if len(some) else [np.zeros(0, t) for t in (np.int64, np.int32, np.int32)])
        edge += n
    ids, marks, places = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((places, marks, ids, h))
    ids, marks, places, h = ids[order], marks[order], places[order], h[order]
    head = np.ones(len(h), dtype=bool)
    head[1:] = h[1:] != h[:-1]
    lead = np.flatnonzero(head)[np.cumsum(head) - 1]
    later = (ids != ids[lead]) | (marks != marks[lead]) | (places != places[lead])
    return ids[later], marks[later], places[later]


def _merge(window: int):
    """All of one group of documents: the maximal intervals that each document's windows cover."""

    def run(table: pa.Table) -> pa.Table:
        ids, marks, places = (np.concatenate(x) for x in zip(*(places_of(x.as_py()) for x in table.column("payload"))))
        order = np.lexsort((places, marks, ids))
        ids, marks, places = ids[order], marks[order], places[order].astype(np.int64)
        doc = np.ones(len(ids), dtype=bool)
        doc[1:] = (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])
        fresh = doc.copy()
        fresh[1:] |= np.diff(places) > window
        head = np.flatnonzero(fresh)
        last = np.append(head[1:], len(ids)) - 1
        spans = pa.StructArray.from_arrays([pa.array(places[head]), pa.array(places[last] + window)], names=["start", "end"])
        first = np.flatnonzero(doc)
        offsets = np.append(np.searchsorted(head, first), len(head)).astype(np.int32)
        return pa.table({"id": ids[first], "mark": marks[first], "removed": pa.ListArray.from_arrays(pa.array(offsets), spans)})

    return run


NEW = ("n_words", "n_removed", "removed", "kept")
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _cut(window: int, whole: bool):
    """Rows (row, text, removed) with the words counted and cut; the ``whole`` text goes along if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CUT_BYTES):
                col = {n: part.column(k) for k, n in enumerate(part.schema.names)}
                texts = Texts(col["text"])
                words = Words(texts, NOT_SPACE)
                lists = col["removed"]
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                spans = lists.flatten()
                ends = [words.first[:-1].repeat(counts) + spans.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)]
                step = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(step, ends[0], 1)
                np.subtract.at(step, ends[1], 1)
                gone = np.cumsum(step)[:-1] > 0
                total = np.concatenate([[0], np.cumsum(gone)])
                raw = texts.bytes[: texts.size].tobytes()
                offsets = texts.offsets.tolist()
                kept = [b" ".join(raw[a:b].split()) for a, b in zip(offsets, offsets[1:])]
                for k in np.flatnonzero(counts):
                    a, b = words.first[k], words.first[k + 1]
                    stay = np.flatnonzero(~gone[a:b]) + a
                    kept[k] = b" ".join(raw[s:e] for s, e in zip(words.start[stay].tolist(), words.end[stay].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [
                        col["row"],
                        *([col["text"]] if whole else []),
                        pa.array(np.diff(words.first), pa.int64()),
                        pa.array(total[words.first[1:]] - total[words.first[:-1]], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), spans),
                        pa.array(kept, pa.binary()).cast(pa.string()),
                    ],
                    names=["row", *(["text"] if whole else []), *NEW],
                )

    return run


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """Adds n_words, n_removed, removed (maximal word intervals, end exclusive) and kept (words by one space).

    A word goes if a window of ``window`` words over it also starts earlier: under a smaller
    key, or earlier in the same document. Keys are integers, as their order decides. A null text
    has no words; a null key comes first. Rows that share key and text are one document and
    are cut alike; rows that share a key but not the text go by a hash of the text. Texts
    shorter than a window stay whole. Of columns, ``keep`` (all) stay, whatever their names;
    former columns of the new names are replaced.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise ValueError(f"{key} is no integer: keys say which of two documents is the earlier")
    buckets = max(unit_count(spark), text_bytes(docs.select(column(text).alias("text")), "text") // BUCKET_BYTES)
    names = [c for c in (keep if keep is not None else docs.columns) if c not in NEW]
    ident = F.coalesce(column(key).cast("long"), F.lit(NO_ID))
    mark = F.hash(column(text))
    sent = docs.select(ident.alias("id"), mark.alias("mark"), column(text).alias("text")).mapInArrow(tidy(_send(window, buckets)), "bucket long, repeat boolean, payload binary")
    later = sent.groupBy("bucket").applyInArrow(tidy_group(_answer(buckets)), "group long, payload binary")
    spans = later.groupBy("group").applyInArrow(tidy_group(_merge(window)), T.StructType([T.StructField("id", T.LongType()), T.StructField("mark", T.IntegerType()), T.StructField("removed", SPAN)]))
    # a text among the caller's columns travels once, beside its row
    whole = text in names
    box = boxed(docs.select(*map(column, dict.fromkeys([*names, key, text]))), (text,), text=column(text), id=ident, mark=mark)
    cut = box.join(spans, ["id", "mark"], "left").select("row", "text", "removed")
    new = [T.StructField(n, k) for n, k in zip(NEW, (T.LongType(), T.LongType(), SPAN, T.StringType()))]
    extra = [T.StructField("text", T.StringType())] if whole else []
    out = cut.mapInArrow(tidy(_cut(window, whole)), T.StructType([cut.schema["row"], *extra, *new]))
    return out.select(*[F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in names], *NEW)


def report(docs: DataFrame) -> DataFrame:
    return dedup(docs.select("doc_id", "text"), keep=["doc_id"]).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


SQL = f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p, len(ws) AS n FROM d),
s AS (SELECT doc_id, p, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS k FROM w),
n AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM s WHERE p <= n - {WINDOW - 1}),
c AS (SELECT DISTINCT doc_id, p + o AS p FROM n, range({WINDOW}) AS r(o) WHERE n > 1),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM w ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

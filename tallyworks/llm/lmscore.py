"""Cross-entropy difference between a target and a background n-gram model.

Both models are word bigrams interpolated with unigrams, alike in order, weights and
smoothing, over one vocabulary of hashed words. Documents are dealt into blocks by their
key; labels travel to the same blocks. A block counts its distinct unigrams and bigrams
in each class and sends them, packed, to buckets of the n-gram's hash; a bucket sums what
the blocks sent and answers each with the corpus counts in the order it asked; the block
meets its texts again (the same shuffle, read a second time) and scores every token.
A frequent n-gram costs a bucket one entry a block. Counts are over all documents, and a
document's own counts are taken out of its class before it is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ALNUM_OR_HIGH, Texts, Words, mix, slices, text_bytes, tidy, tidy_group, unit_count

BIGRAM_WEIGHT = 0.6
DELTA = 0.1
#: Slots of the shared vocabulary: the mass of an unseen word is DELTA of these.
VOCABULARY = 1 << 22
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20
#: Rows of one key above which it is dealt over several blocks.
FREQUENT = 1000
BEGIN = np.uint64(0xB5AD4ECEDA1CE2A9)


def _planes(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), codec="zstd", asbytes=True)


def _unplanes(raw: bytes, n: int, dtype=np.int64) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(pa.decompress(raw, decompressed_size=size * n, codec="zstd", asbytes=True), np.uint8).reshape(size, n).T).view(dtype).ravel()


class Block:
    """N-grams of a block's documents: sorted distinct keys by bucket, and each token's places among them."""

    def __init__(self, table: pa.Table, buckets: int):
        text = table.column("text").combine_chunks()
        is_doc = np.array(table.column("label_row").to_pylist(), dtype=bool) == 0
        labels = {i for i, t in zip(table.column("id").to_pylist(), table.column("target").to_pylist()) if t}
        at = pa.array(np.flatnonzero(is_doc))
        self.docs = table.take(at)
        text = text.take(at)
        self.target = np.array([i in labels for i in self.docs.column("id").to_pylist()], dtype=bool)
        words = Words(Texts(text, fold=True), ALNUM_OR_HIGH)
        self.first = words.first
        self.owner = words.owner()
        h = words.hashes()
        before = np.concatenate([[BEGIN], h[:-1]]) if len(h) else h
        heads = words.first[:-1][np.diff(words.first) > 0]
        before[heads] = BEGIN
        pair = mix(mix(before) + h)
        uni, self.word = np.unique(np.concatenate([h, [BEGIN]]), return_inverse=True)
        self.prev = np.concatenate([self.word[-1:], self.word[: len(h)][:-1]]) if len(h) else self.word[:0]
        self.prev[heads] = self.word[-1]
        self.word = self.word[: len(h)]
        self.begin = int(np.searchsorted(uni, BEGIN))
        bi, self.pair = np.unique(pair, return_inverse=True)
        self.pair = self.pair + len(uni)
        self.keys = np.concatenate([uni, bi])
        bucket = ((self.keys & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)
        self.order = np.argsort(bucket, kind="stable")
        self.edges = np.searchsorted(bucket[self.order], np.arange(buckets + 1))

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each key, in target and background documents."""
        n, out = len(self.keys), []
        for side in (self.target, ~self.target):
            on = side[self.owner]
            c = np.bincount(self.word[on], minlength=n) + np.bincount(self.pair[on], minlength=n)
            c[self.begin] += int((side & (np.diff(self.first) > 0)).sum())
            out.append(c.astype(np.int64))
        return out[0], out[1]

    def own(self, places: np.ndarray) -> np.ndarray:
        """How often each token's key occurs in the token's own document."""
        order = np.lexsort((places, self.owner))
        p, d = places[order], self.owner[order]
        new = np.ones(len(p), dtype=bool)
        new[1:] = (p[1:] != p[:-1]) | (d[1:] != d[:-1])
        run = np.cumsum(new) - 1
        out = np.empty(len(p), dtype=np.int64)
        out[order] = np.bincount(run)[run] if len(p) else run
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each text."""
    for batch in batches:
        for part in slices(batch, "text", BLOCK_BYTES):
            words = Words(Texts(part.column(1), fold=True), ALNUM_OR_HIGH)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(words.first), pa.int64())], names=["doc_id", "n"])


def _send(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        block = Block(table, buckets)
        number = table.column("block")[0].as_py()
        target, back = block.counts()
        rows = []
        for b in np.flatnonzero(np.diff(block.edges)):
            k = block.order[block.edges[b] : block.edges[b + 1]]
            high = (block.keys[k] >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            rows.append((int(b), number, len(k), np.ascontiguousarray(high).tobytes(), _planes(target[k]), _planes(back[k])))
        cols = list(zip(*rows)) if rows else [[], [], [], [], [], []]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds)], names=["bucket", "block", "n", "keys", "target", "back"])

    return run


def _sum(table: pa.Table) -> pa.Table:
    n = table.column("n").to_pylist()
    keys = []
    for raw, m in zip(table.column("keys"), n):
        wide = np.zeros((m, 8), np.uint8)
        wide[:, :6] = np.frombuffer(raw.as_py(), np.uint8).reshape(m, 6)
        keys.append(wide.view("<u8").ravel())
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    edges = np.concatenate([[0], np.cumsum(n)])
    out = {"bucket": table.column("bucket"), "block": table.column("block"), "n": table.column("n")}
    for side in ("target", "back"):
        sent = np.concatenate([_unplanes(raw.as_py(), m) for raw, m in zip(table.column(side), n)])
        total = np.bincount(inverse, sent).astype(np.int64)[inverse]
        out[side] = pa.array([_planes(total[a:b]) for a, b in zip(edges, edges[1:])], pa.binary())
    return pa.table(out)


def _score(buckets: int, sizes: dict[str, int], weight: float, delta: float):
    def losses(count: np.ndarray, pair: np.ndarray, before: np.ndarray, total: np.ndarray) -> np.ndarray:
        p = (count + delta) / (total + delta * VOCABULARY)
        return -np.log(np.where(before > 0, weight * pair / np.maximum(before, 1) + (1 - weight) * p, p))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", "n_tokens", "target_loss", "background_loss", "score"]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        if not left.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        block = Block(left, buckets)
        n_docs, n_tokens = len(block.target), np.diff(block.first)
        got = {side: np.zeros(len(block.keys), np.int64) for side in ("target", "back")}
        for b, m, t, k in zip(right.column("bucket").to_pylist(), right.column("n").to_pylist(), right.column("target"), right.column("back")):
            at = block.order[block.edges[b] : block.edges[b + 1]]
            got["target"][at], got["back"][at] = _unplanes(t.as_py(), m), _unplanes(k.as_py(), m)
        word, pair, before = block.own(block.word), block.own(block.pair), _own_before(block)
        out = {}
        for side, on in (("target", block.target), ("back", ~block.target)):
            own = on[block.owner].astype(np.int64)
            total = sizes[side] - own * n_tokens[block.owner]
            c = got[side]
            loss = losses(c[block.word] - own * word, c[block.pair] - own * pair, c[block.prev] - own * before, total)
            out[side] = np.bincount(block.owner, loss, minlength=n_docs) / np.maximum(1, n_tokens)
        ids = block.docs.column("id").to_pylist()
        return pa.table([pa.array(v, k) for v, k in zip([ids, n_tokens, out["target"], out["back"], out["back"] - out["target"]], kinds)], names=names)

    return run


def _own_before(block: Block) -> np.ndarray:
    """How often the word before each token occurs in the token's own document (once for the beginning)."""
    n = len(block.keys)
    key = block.owner * np.int64(n) + block.word
    seen, count = np.unique(key, return_counts=True)
    ask = block.owner * np.int64(n) + block.prev
    at = np.minimum(np.searchsorted(seen, ask), max(0, len(seen) - 1))
    found = np.where(seen[at] == ask, count[at], 0) if len(seen) else ask
    return np.where(block.prev == block.begin, 1, found)


def score(docs: DataFrame, labels: DataFrame, target: str = "quality = 1", weight: float = BIGRAM_WEIGHT, delta: float = DELTA) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) for every row of ``docs``.

    The target model learns from documents with a label row for which ``target`` holds, the
    background model from all others. Losses are nats per word; score is background loss
    minus target loss, so higher is more like the target. A text without words (or null)
    has no tokens and zero losses. Labels without a document count nowhere; of several
    label rows one that fits suffices; null keys match no label. Each row of a repeated
    document is counted and scored for itself. An empty table gives an empty result; further
    columns are left out. Rows of a null or very frequent key are dealt over several blocks.
    """
    size = text_bytes(docs, "text")
    blocks = max(unit_count(docs.sparkSession), size // BLOCK_BYTES)
    buckets = max(unit_count(docs.sparkSession), size // BUCKET_BYTES)
    block = F.pmod(F.xxhash64("id", "salt"), F.lit(blocks)).alias("block")
    chosen = labels.where(target).where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = texts.mapInArrow(tidy(_count), "doc_id long, n long").join(chosen, F.col("doc_id") == F.col("id"), "left")
    sums = counted.agg(F.sum(F.when(F.col("id").isNotNull(), F.col("n"))), F.sum(F.when(F.col("id").isNull(), F.col("n")))).first()
    sizes = {"target": int(sums[0] or 0), "back": int(sums[1] or 0)}
    # keys with a ten-thousandth of all rows, and a thousand at least: ten thousand keys at most
    each = texts.groupBy("doc_id").agg(F.count("*").alias("n"))
    many = max(FREQUENT, (each.agg(F.sum("n")).first()[0] or 0) // 10_000)
    hot = each.where((F.col("n") > many) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), F.ceil(F.col("n") / many).alias("salts"))
    rows = texts.select(F.col("doc_id").alias("id"), "text", F.monotonically_increasing_id().alias("at")).join(F.broadcast(hot), "id", "left")
    salt = F.when(F.col("id").isNull(), F.pmod("at", F.lit(blocks))).otherwise(F.coalesce(F.pmod("at", "salts"), F.lit(0)))
    rows = rows.withColumn("salt", salt).select(block, "id", "text", F.lit(0).alias("label_row"), F.lit(False).alias("target"))
    marks = chosen.join(F.broadcast(hot), "id", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1)))
    marks = marks.select(block, "id", F.lit(None).cast("string").alias("text"), F.lit(1).alias("label_row"), F.lit(True).alias("target"))
    dealt = rows.unionByName(marks)
    sent = dealt.groupBy("block").applyInArrow(tidy_group(_send(buckets)), "bucket long, block long, n long, keys binary, target binary, back binary")
    answers = sent.groupBy("bucket").applyInArrow(tidy_group(_sum), "bucket long, block long, n long, target binary, back binary")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(buckets, sizes, weight, delta), "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, labels)

"""Language identification with a byte convolutional network trained in numpy.

Filters of several widths run over the bytes of a fixed-length window (A-Z folded),
each keeps its maximum over the window, and a softmax over those maxima names the
language. A filter over one-hot bytes is a sum of one table row per tap, so the
forward pass is table look-ups; neighbouring taps are merged into one table of byte
pairs for prediction. Whole texts are covered by consecutive windows; a document's
probabilities are the mean over its windows, weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import LOWER, Texts, boxed, column, slices, tidy

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
UNKNOWN = "und"
BLOCK_BYTES = 1 << 20
#: Bounds of the training sample: documents of each language (expected) and windows of each document.
SAMPLE_DOCS = 500
SAMPLE_WINDOWS = 4
STEPS = 900
BATCH = 64


def windows(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts as rows of bytes padded with zeros; each row's text and length."""
    sizes = np.diff(texts.offsets)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = texts.offsets[:-1][owner] + nth * WINDOW
    length = np.minimum(sizes[owner] - nth * WINDOW, WINDOW)
    body = np.concatenate([texts.bytes, np.zeros(WINDOW, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(body, WINDOW)[begin].copy()
    rows[np.arange(WINDOW) >= length[:, None]] = 0
    return rows, owner, length


class Network:
    """Taps: for each width, (width, 256, filters); then bias, dense weights and their bias."""

    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.taps = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.dense = rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.out = np.zeros(len(labels), np.float32)
        self.pairs: list[list[np.ndarray]] = []

    def __getstate__(self) -> dict:
        return self.__dict__ | {"pairs": []}

    def prepare(self) -> "Network":
        """Merge taps two by two into tables over byte pairs; done where they are used."""
        if self.pairs:
            return self
        for t in self.taps:
            tables = [(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, len(t) - 1, 2)]
            self.pairs.append(tables + ([t[-1]] if len(t) % 2 else []))
        return self

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        pair = rows[:, :-1].astype(np.int32) * 256 + rows[:, 1:]
        out = []
        for w, tables in zip(WIDTHS, self.pairs):
            n = rows.shape[1] - w + 1
            total = np.zeros((len(rows), n, FILTERS), np.float32)
            for k, table in enumerate(tables):
                index = pair[:, 2 * k : 2 * k + n] if len(table) == 65536 else rows[:, 2 * k : 2 * k + n]
                total = table[index] if k == 0 else total + table[index]
            out.append(total.max(axis=1))
        return np.concatenate(out, axis=1)

    def probabilities(self, rows: np.ndarray, step: int = 128) -> np.ndarray:
        found = [self.softmax(np.maximum(self.pooled(rows[k : k + step]) + self.bias, 0) @ self.dense + self.out) for k in range(0, len(rows), step)]
        return np.concatenate(found) if found else np.zeros((0, len(self.labels)), np.float32)

    @staticmethod
    def softmax(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy and its gradients; pooling sends each filter's to the bytes of its maximum."""
        peaks, tops = [], []
        for w, t in zip(WIDTHS, self.taps):
            n = x.shape[1] - w + 1
            total = sum(t[j][x[:, j : j + n]] for j in range(w))
            at = total.argmax(axis=1)
            peaks.append(at)
            tops.append(np.take_along_axis(total, at[:, None, :], 1)[:, 0])
        z = np.concatenate(tops, axis=1) + self.bias
        h = np.maximum(z, 0)
        p = self.softmax(h @ self.dense + self.out)
        loss = float(-np.log(p[np.arange(len(y)), y]).mean())
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        dh = (p @ self.dense.T) * (z > 0)
        grads = []
        for k, (w, t) in enumerate(zip(WIDTHS, self.taps)):
            g, part = np.zeros_like(t), dh[:, k * FILTERS : (k + 1) * FILTERS]
            filters = np.broadcast_to(np.arange(FILTERS), part.shape)
            for j in range(w):
                np.add.at(g[j], (np.take_along_axis(x, peaks[k] + j, 1), filters), part)
            grads.append(g)
        return loss, grads + [dh.sum(0), h.T @ p, p.sum(0)]

    def train(self, rows: np.ndarray, labels: np.ndarray, steps: int, seed: int = 11) -> "Network":
        """Adam on cross-entropy."""
        rng = np.random.default_rng(seed)
        params = [*self.taps, self.bias, self.dense, self.out]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(rows), BATCH)
            _, grads = self.gradients(rows[pick], labels[pick])
            rate = 0.01 * (1 - 0.9 * step / steps)
            for v, g, m, s in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
        return self


def held_out(key: Column) -> Column:
    """The quarter that nothing is learned from; a null key is not in it."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _sample(rows: DataFrame, text: str, label: str, key: str, docs_each: int) -> tuple[list[str], DataFrame | None]:
    """All labels, and (text, label) of at most ``docs_each`` rows of each; None where no row has a label.

    Labels are languages: their counts come to the driver.
    """
    good = rows.where(F.col(label).isNotNull() & has_letter(F.col(text)))
    counts = {r[0]: r[1] for r in rows.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    if not counts:
        return [], None
    u = F.shiftrightunsigned(F.xxhash64(F.col(key), F.col(text)), 11) / float(1 << 53)
    odds = F.coalesce(*[F.when(F.col(label) == x, docs_each / n) for x, n in counts.items()])
    picked = good.where(u < odds).groupBy(u.alias("u"), F.col(label).alias("label")).agg(F.min(text).alias("text"))
    nth = F.row_number().over(Window.partitionBy("label").orderBy("u", "text"))
    return sorted(counts), picked.withColumn("nth", nth).where(F.col("nth") <= docs_each).select("text", "label")


def fit(rows: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", docs_each: int = SAMPLE_DOCS, steps: int = STEPS) -> Network:
    """Train on a bounded sample of the labelled rows.

    A row with a label and a letter enters by a hash of its key and text, with the odds that
    give ``docs_each`` rows of each label, and those of the lowest hashes stay if more do; rows
    alike in key and text are one. Up to SAMPLE_WINDOWS windows of each are taken at even
    steps over the whole text, so the driver gets docs_each x SAMPLE_WINDOWS windows a label
    at most. Counts of labels are over all rows. No labelled row at all gives a network
    without labels, which calls everything ``und``.
    """
    labels, picked = _sample(rows, text, label, key, docs_each)
    if picked is None:
        return Network([])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                texts = Texts(part.column(0))
                texts.bytes = LOWER[texts.bytes]
                found, owner, length = windows(texts)
                count = np.bincount(owner, minlength=part.num_rows)
                nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                keep = (nth * SAMPLE_WINDOWS // count[owner] != (nth - 1) * SAMPLE_WINDOWS // count[owner]) & (length >= 16) | (nth == 0)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in found[keep]], pa.binary()), part.column(1).take(pa.array(owner[keep]))], names=["window", "label"])

    sample = picked.mapInArrow(tidy(cut), "window binary, label string").toPandas().sort_values(["label", "window"])
    x = np.frombuffer(b"".join(sample["window"]), dtype=np.uint8).reshape(-1, WINDOW)
    y = np.searchsorted(labels, sample["label"].to_numpy(dtype=str)) if len(sample) else np.zeros(0, int)
    return Network(labels).train(x, y, steps) if len(x) else Network(labels)


def predict(docs: DataFrame, network: Network, text: str = "text", to: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the language and its probability; ``und`` with score 0 where text is null or has no letter.

    Rows pass through one for one with all their columns, so repeated rows are predicted
    alike and an empty table gives an empty one; former columns of the two names are
    replaced. Between equal probabilities the first label in order wins.
    """
    model = docs.sparkSession.sparkContext.broadcast(network)  # a few MB, whatever the corpus
    box = boxed(docs, (to, score), text=column(text), letter=has_letter(column(text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value.prepare()
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                texts = Texts(part.column(1))
                texts.bytes = LOWER[texts.bytes]
                rows, owner, length = windows(texts)
                letter = part.column(2).to_numpy(zero_copy_only=False)
                names, scores = np.full(part.num_rows, UNKNOWN, dtype=object), np.zeros(part.num_rows)
                if net.labels:
                    p = net.probabilities(rows) * length[:, None]
                    sums = np.stack([np.bincount(owner, p[:, k], minlength=part.num_rows) for k in range(len(net.labels))], axis=1)
                    mean = sums / np.maximum(1, np.diff(texts.offsets))[:, None]
                    best = mean.argmax(axis=1)
                    names[letter] = np.array(net.labels, dtype=object)[best[letter]]
                    scores[letter] = np.clip(mean[np.arange(len(best)), best][letter], 0, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores)], names=["row", "lang", "score"])

    out = box.mapInArrow(tidy(run), T.StructType([box.schema["row"], T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    return out.select("row.*", F.col("lang").alias(to), F.col("score").alias(score))


def least_score(rows: DataFrame, network: Network, text: str = "text", label: str = "lang") -> float:
    """Half the lowest score of a rightly predicted row among all labelled rows, which the network should not know.

    A text that scores less is like none of the languages. Zero without such a row. Every
    row with a label is predicted; one number comes to the driver.
    """
    if not network.labels:
        return 0.0
    known = rows.where(F.col(label).isNotNull() & has_letter(F.col(text))).select(F.col(text).alias("text"), F.col(label).alias("label"))
    found = predict(known, network).where(F.col("lang_pred") == F.col("label"))
    return (found.agg(F.min("score")).first()[0] or 0.0) / 2


def predictions(docs: DataFrame) -> DataFrame:
    """The query's columns; learns only from rows outside the held-out quarter. A null doc_id is not held out."""
    network = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), network).drop("text")

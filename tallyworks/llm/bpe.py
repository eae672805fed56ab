"""BPE encoding and decoding through a table of distinct words.

Texts are split into words by the vocabulary's pattern. A block of texts numbers its own
distinct words, frequent ones first, and keeps its texts as numbers, one for each position. Its
words go, packed, to buckets by their hash. A bucket holds every word of its hashes from all
blocks: over all buckets the distinct words are one table, in which each is encoded once, by
merging, and its ids join the id-to-piece table, which decodes it. The answers go back to the
blocks, packed too, and by position to the texts. A frequent word costs one entry a block.

``decode`` turns any ids into texts the same way: a block numbers its distinct ids, these
join the id-to-piece table, and the pieces return by position.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import boxed, column, release, slices, text_bytes, tidy, tidy_group

#: The split pattern of byte-level BPE vocabularies of this family (a fixed value of the public format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Text of a block, text that is split at a time, and positions that are filled at a time.
BLOCK_BYTES = 16 << 20
SLICE_BYTES = 1 << 20
STEP = 1 << 17
#: Text of all blocks that a bucket of words stands for: as many buckets as blocks, however work is partitioned.
BUCKET_BYTES = 16 << 20
#: Bytes of a word up to which its merges are searched one by one, not through a heap.
SHORT = 24


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE file: pieces by id, special strings, and what two ids merge to; at most its number of ids in size."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        if model["type"] != "BPE" or model.get("ignore_merges") or spec.get("normalizer") or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("a plain byte-level BPE vocabulary is needed")
        vocab = model["vocab"]
        self.special: dict[str, int] = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.pieces: dict[int, bytes] = {i: bytes(alphabet[c] for c in token) for token, i in vocab.items() if token not in self.special}
        self.pieces |= {i: token.encode() for token, i in self.special.items()}
        self.bytes = [vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            self.merges[vocab[left], vocab[right]] = rank, vocab[left + right]

    def ids(self, word: str) -> list[int]:
        """Ids of one word: of all neighbours that merge, those of the lowest rank do first, from the left."""
        if word in self.special:
            return [self.special[word]]
        ids: list[int | None] = [self.bytes[b] for b in word.encode()]
        n = len(ids)
        if n <= SHORT:
            never = (len(self.merges), 0)
            while len(ids) > 1:
                found = [self.merges.get(p, never) for p in zip(ids, ids[1:])]
                best = min(found)
                if best is never:
                    break
                k = found.index(best)
                ids[k : k + 2] = [best[1]]
            return ids
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (m := self.merges.get((ids[i], ids[j]))):
                heapq.heappush(heap, (m[0], i, j, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, left, right = heapq.heappop(heap)
            if ids[i] != left or ids[j] != right or after[i] != j:
                continue  # one of the two has merged since
            ids[i], ids[j] = self.merges[left, right][1], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [x for x in ids if x is not None]

    def table(self, spark: SparkSession) -> DataFrame:
        """(id, piece): the id-to-piece table."""
        return spark.createDataFrame(pa.table({"id": pa.array(list(self.pieces), pa.int32()), "piece": pa.array(list(self.pieces.values()), pa.binary())}))


class Splitter:
    """Words of a text; a special string is a word of its own, and no other word holds one."""

    def __init__(self, special: list[str]):
        import regex

        self.special = special
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None

    def __call__(self, text: str) -> list[str]:
        if not any(s in text for s in self.special):
            return self.find(text)
        out: list[str] = []
        for k, part in enumerate(self.cut(text)):
            out += [part] if k % 2 else self.find(part)
        return out


# ---------------------------------------------------------------- blocks


class Numbers(dict):
    """Numbers keys in the order in which they come."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


def _squeeze(raw: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def _pack(x: np.ndarray) -> bytes:
    """Byte planes, compressed."""
    return _squeeze(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


def _pack_words(words: pa.Array) -> bytes:
    """Sizes and bytes, compressed."""
    sizes = _pack(pc.binary_length(words).to_numpy(zero_copy_only=False))
    return len(sizes).to_bytes(4, "little") + sizes + _squeeze(b"".join(words.cast(pa.binary()).to_pylist()))


def _unpack_words(raw: bytes, n: int) -> pa.Array:
    split = 4 + int.from_bytes(raw[:4], "little")
    ends = np.concatenate([[0], np.cumsum(_unpack(raw[4:split], n), dtype=np.int64)])
    body = pa.decompress(raw[split:], decompressed_size=int(ends[-1]), codec="zstd")
    return pa.StringArray.from_buffers(n, pa.py_buffer(ends.astype(np.int32)), body)


def _block_schema(row: T.StructField) -> T.StructType:
    kinds = {"block": T.LongType(), "rows": T.ArrayType(row.dataType), "counts": T.ArrayType(T.IntegerType()), "n_keys": T.IntegerType(), "keys": T.BinaryType(), "places": T.BinaryType()}
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


def _blocks(parts: Callable, kind: pa.DataType):
    """Rows to blocks. ``parts`` gives (rows, keys of all their positions, how many each has, bytes) of a batch, slice by slice.

    The most frequent key has number 0, and equally frequent ones are sorted: both pack well.

    A block's number comes from what is in it, so a block that another attempt of its task
    would cut otherwise finds no answers and fails, instead of taking those of another.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        made, held, size, numbers = 0, [], 0, Numbers()

        def block() -> pa.RecordBatch:
            nonlocal made, held, size, numbers
            rows, counts, places = zip(*held)
            counts, places, keys = np.concatenate(counts), np.concatenate(places), pa.array(list(numbers), kind)
            table = pa.table({"seen": np.bincount(places, minlength=len(keys)), "key": keys})
            order = pc.sort_indices(table, [("seen", "descending"), ("key", "ascending")])
            number = np.empty(len(keys), np.int32)
            number[order.to_numpy()] = np.arange(len(keys))
            packed, keys = _pack(number[places]), keys.take(order)
            keys = _pack_words(keys) if pa.types.is_string(kind) else _pack(keys.to_numpy())
            name = xxhash.xxh64(packed, seed=17)
            for b in (counts.tobytes(), keys, b"%d %d" % (TaskContext.get().partitionId(), made)):
                name.update(b)
            one = pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), pa.concat_arrays(rows))
            columns = [pa.array([name.intdigest() - (1 << 63)], pa.int64()), one, pa.array([counts], pa.list_(pa.int32())), pa.array([len(numbers)], pa.int32()), pa.array([keys]), pa.array([packed])]
            made, held, size, numbers = made + 1, [], 0, Numbers()
            return pa.RecordBatch.from_arrays(columns, names=["block", "rows", "counts", "n_keys", "keys", "places"])

        for batch in batches:
            for rows, found, counts, weight in parts(batch):
                held.append((rows, counts.astype(np.int32), np.fromiter(map(numbers.__getitem__, found), dtype=np.int32, count=len(found))))
                size += weight
                if size >= BLOCK_BYTES:
                    yield block()
        if held:
            yield block()

    return run


def _split(special: list[str]):
    def parts(batch: pa.RecordBatch):
        words = Splitter(special)
        for part in slices(batch, "text", SLICE_BYTES):
            text, flat, counts = part.column(part.schema.get_field_index("text")), [], []
            for x in text.to_pylist():
                flat += (found := words(x) if x else [])
                counts.append(len(found))
            yield part.column(part.schema.get_field_index("row")), flat, np.array(counts), text.nbytes

    return parts


def _ids_of(batch: pa.RecordBatch):
    """Null ids count as -1, which is in no vocabulary."""
    lists = batch.column(batch.schema.get_field_index("ids"))
    step = max(1, int(batch.num_rows * SLICE_BYTES // (4 * max(1, len(lists.flatten())))))
    for k in range(0, batch.num_rows, step):
        part = lists.slice(k, step)
        flat = part.flatten()
        yield batch.column(batch.schema.get_field_index("row")).slice(k, step), pc.fill_null(flat, -1).to_pylist(), pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False), 4 * len(flat)


def _ids(table: pa.Table) -> pa.Table:
    """The distinct ids of a block, each with its number."""
    counts = table.column("n_keys").to_numpy()
    keys = np.concatenate([_unpack(raw.as_py(), n).view("<i4") for raw, n in zip(table.column("keys"), counts.tolist())])
    return pa.table({"block": np.repeat(table.column("block").to_numpy(), counts), "n": np.concatenate([np.arange(n, dtype=np.int32) for n in counts]), "key": keys})


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    after = np.cumsum(lengths)
    return np.repeat(starts - after + lengths, lengths) + np.arange(after[-1] if len(after) else 0)


def _fill(answers: Callable):
    """A block and the answers to its keys: its rows with ids, texts, or both.

    ``answers`` gives, for a block and its answers, the kind, and size and start of each key's values in a pool.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows != 1:
            raise RuntimeError(CHANGED)
        block, made = {n: left.column(n)[0] for n in left.column_names}, {}
        counts = block["counts"].values.to_numpy().astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(counts)])
        places = _unpack(block["places"].as_py(), int(ends[-1]))
        for kind, size, start, pool in answers(block, right):
            made[kind], a = [], 0
            while a < len(counts):  # documents whose positions fit a step, or one longer document
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + STEP, side="right")) - 1)
                here = places[ends[a] : ends[b]]
                cut = np.concatenate([[0], np.cumsum(size[here])])[ends[a : b + 1] - ends[a]]
                found = pool[_gather(start[here], size[here])]
                if kind == "ids":
                    made[kind].append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(found, pa.int32())))
                else:
                    body, cut = found.tobytes(), cut.tolist()
                    made[kind].append(pa.array([body[x:y].decode("utf-8", "replace") for x, y in zip(cut, cut[1:])], pa.string()))
                a = b
        return pa.table({"row": block["rows"].values} | {n: pa.concat_arrays(x) for n, x in made.items()})

    def tidied(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        release()
        return out

    return tidied


def _pool(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and start of each value, and all bytes end to end."""
    size = np.fromiter(map(len, values), dtype=np.int64, count=len(values))
    return size, np.cumsum(size) - size, np.frombuffer(b"".join(values), np.uint8)


def _pieces(block: dict, right: pa.Table):
    """Pieces of a block's ids, one a row."""
    if block["n_keys"].as_py() != right.num_rows:
        raise RuntimeError(CHANGED)
    raw = right.sort_by("n").column("raw") if right.num_rows else pa.array([], pa.binary())
    if raw.null_count:
        raise ValueError("an id is not in the vocabulary")
    yield "decoded", *_pool(raw.to_pylist())


# ---------------------------------------------------------------- the table of words

CHANGED = "a block's keys changed between attempts of its task; run the job again"


def _by_bucket(words: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words, bucket by bucket, and where each bucket begins among them."""
    import xxhash

    bucket = np.fromiter((xxhash.xxh64_intdigest(w, 23) % buckets for w in words.to_pylist()), dtype=np.int64, count=len(words))
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _ask(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        """The words of a block, one row for each bucket."""
        rows = []
        for block, n, raw in zip(*(table.column(c).to_pylist() for c in ("block", "n_keys", "keys"))):
            words = _unpack_words(raw, n)
            order, edges = _by_bucket(words, buckets)
            for b in np.flatnonzero(np.diff(edges)).tolist():
                rows.append((b, block, int(edges[b + 1] - edges[b]), _pack_words(words.take(pa.array(order[edges[b] : edges[b + 1]])))))
        bucket, block, n, words = zip(*rows) if rows else ([],) * 4
        return pa.table({"bucket": pa.array(bucket, pa.int32()), "block": pa.array(block, pa.int64()), "n": pa.array(n, pa.int32()), "words": pa.array(words, pa.binary())})

    return run


def _words(asked: pa.Table) -> tuple[pa.Array, pa.Array]:
    """Words of all rows of a bucket, and the distinct ones, sorted: the same whenever the bucket is read."""
    every = pa.concat_arrays([_unpack_words(raw, n) for raw, n in zip(asked.column("words").to_pylist(), asked.column("n").to_pylist())])
    once = pc.unique(every)
    return every, once.take(pc.array_sort_indices(once))


def _code(vocabulary, with_ids: bool):
    def run(asked: pa.Table) -> pa.Table:
        """Every distinct word of a bucket is encoded: a row with all answers and, ``with_ids``, one for each id among them."""
        coded = [vocabulary.value.ids(w) for w in _words(asked)[1].to_pylist()]
        sizes, ids = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded)), np.fromiter(chain.from_iterable(coded), dtype=np.int64)
        used = np.unique(ids).tolist() if with_ids else []
        rest = [None] * len(used)
        columns = {"id": pa.array([None, *used], pa.int32()), "sizes": pa.array([_pack(sizes), *rest], pa.binary()), "ids": pa.array([_pack(ids), *rest], pa.binary())}
        return pa.table({"bucket": pa.array([asked.column("bucket")[0].as_py()] * (1 + len(used)), pa.int32())} | columns)

    return run


def _said(words: pa.Array, sizes: np.ndarray, ids: np.ndarray, pieces: pa.Table) -> list[bytes | None] | None:
    """What the words' ids decode to, null where that is the word; None if it always is."""
    if pieces.column("piece").null_count:
        raise ValueError("an id is not in the vocabulary")
    size, start, pool = _pool(pieces.column("piece").to_pylist())
    at = np.searchsorted(pieces.column("id").to_numpy(), ids)
    body = pool[_gather(start[at], size[at])].tobytes()
    ends = np.concatenate([[0], np.cumsum(size[at])])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
    words = words.cast(pa.binary()).to_pylist()
    said = [None if body[a:b] == w else body[a:b] for w, a, b in zip(words, ends, ends[1:])]
    return said if any(x is not None for x in said) else None


def _answer(with_text: bool):
    def run(asked: pa.Table, coded: pa.Table) -> pa.Table:
        """Ids of the words of every row of a bucket and, ``with_text``, what they decode to if that is not always the word."""
        every, words = _words(asked)
        at = pc.index_in(every, value_set=words).to_numpy()
        whole = coded.filter(pc.is_null(coded.column("id")))
        sizes = _unpack(whole.column("sizes")[0].as_py(), len(words)).astype(np.int64)
        ids = _unpack(whole.column("ids")[0].as_py(), int(sizes.sum()))
        said = _said(words, sizes, ids, coded.filter(pc.is_valid(coded.column("id"))).sort_by("id")) if with_text else None
        start, end, out = np.cumsum(sizes) - sizes, 0, {"sizes": [], "ids": [], "raw": []}
        for n in asked.column("n").to_pylist():
            here, end = at[end : end + n], end + n
            out["sizes"].append(_pack(sizes[here]))
            out["ids"].append(_pack(ids[_gather(start[here], sizes[here])]))
            out["raw"].append(said and [said[k] for k in here])
        kinds = {"sizes": pa.binary(), "ids": pa.binary(), "raw": pa.list_(pa.binary())}
        return pa.table({"block": asked.column("block"), "bucket": asked.column("bucket")} | {n: pa.array(x, kinds[n]) for n, x in out.items()})

    def tidied(asked: pa.Table, coded: pa.Table) -> pa.Table:
        out = run(asked, coded)
        release()
        return out

    return tidied


def _coded(buckets: int, with_text: bool):
    """Ids, and texts if asked for, of a block's words from the rows of its buckets."""

    def answers(block: dict, right: pa.Table):
        words = _unpack_words(block["keys"].as_py(), block["n_keys"].as_py())
        order, edges = _by_bucket(words, buckets)
        asked, rows = np.flatnonzero(np.diff(edges)).tolist(), right.sort_by("bucket").to_pylist() if right.num_rows else []
        if [r["bucket"] for r in rows] != asked:
            raise RuntimeError(CHANGED)
        sizes, ids, start = np.empty(len(words), np.int64), [], np.empty(len(words), np.int64)
        said = words.cast(pa.binary()).to_pylist() if with_text else []
        for b, r in zip(asked, rows):
            here = order[edges[b] : edges[b + 1]]
            sizes[here] = _unpack(r["sizes"], len(here))
            ids.append(_unpack(r["ids"], int(sizes[here].sum())))
            for k, raw in zip(here, r["raw"] or ()):
                if raw is not None:
                    said[k] = raw
        start[order] = np.cumsum(sizes[order]) - sizes[order]
        yield "ids", sizes, start, np.concatenate([np.zeros(0, "<u4"), *ids])
        if with_text:
            yield "decoded", *_pool(said)

    return answers


# ---------------------------------------------------------------- operators


def word_table(asked: DataFrame, vocabulary, pieces: DataFrame | None = None) -> DataFrame:
    """Every distinct word once, packed by bucket: (bucket, sizes, ids), and with ``pieces`` a row for each (bucket, id, piece)."""
    coded = asked.groupBy("bucket").applyInArrow(tidy_group(_code(vocabulary, pieces is not None)), "bucket int, id int, sizes binary, ids binary")
    return coded if pieces is None else coded.join(F.broadcast(pieces), "id", "left")  # bounded by the vocabulary file


def encode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds ``ids`` (array of int) for whole texts and, if named, ``decoded``: the pieces of those ids as a text.

    Null and empty texts have no ids and decode to an empty text. Rows pass through one for
    one, so repeated rows, ties and further columns (``keep``, or all) stay; an empty table
    gives an empty one. Former columns of the new names are replaced; all others keep their
    names and values.
    """
    spark = docs.sparkSession
    loaded = Vocabulary(tokenizer)
    vocabulary = spark.sparkContext.broadcast(loaded)
    names = [c for c in (keep if keep is not None else docs.columns) if c not in (ids, decoded)]
    box = docs.select(F.struct(*map(column, names)).alias("row"), column(text).alias("text"))
    row = box.schema["row"]
    buckets = 1 + text_bytes(box, "text") // BUCKET_BYTES
    dealt = box.mapInArrow(tidy(_blocks(_split(list(loaded.special)), pa.string())), _block_schema(row))
    asked = dealt.groupBy("block").applyInArrow(tidy_group(_ask(buckets)), "bucket int, block long, n int, words binary")
    coded = word_table(asked, vocabulary, loaded.table(spark) if decoded else None)
    answers = asked.groupBy("bucket").cogroup(coded.groupBy("bucket")).applyInArrow(_answer(bool(decoded)), "block long, bucket int, sizes binary, ids binary, raw array<binary>")
    made = [T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.StringType())] * bool(decoded)
    out = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_fill(_coded(buckets, bool(decoded))), T.StructType([row, *made]))
    return out.select("row.*", F.col("ids").alias(ids), *([F.col("decoded").alias(decoded)] if decoded else []))


def decode(frame: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded", keep_ids: bool = True) -> DataFrame:
    """Adds ``text``, the pieces of ``ids`` end to end; bytes that are no UTF-8 become U+FFFD.

    A null array decodes to an empty text. Unknown, negative or null ids raise an error.
    Rows and further columns stay; a former column of the new name is replaced.
    """
    spark = frame.sparkSession
    without = tuple(c for c in frame.columns if c == text or (c == ids and not keep_ids))
    box = boxed(frame, without, ids=column(ids).cast("array<int>"))
    row = box.schema["row"]
    dealt = box.mapInArrow(tidy(_blocks(_ids_of, pa.int32())), _block_schema(row))
    keys = dealt.groupBy("block").applyInArrow(tidy_group(_ids), "block long, n int, key int")
    pieces = Vocabulary(tokenizer).table(spark).select(F.col("id").alias("key"), F.col("piece").alias("raw"))
    answers = keys.join(F.broadcast(pieces), "key", "left").drop("key")  # bounded by the vocabulary file
    out = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_fill(_pieces), T.StructType([row, T.StructField("decoded", T.StringType())]))
    return out.select("row.*", F.col("decoded").alias(text))


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per document: number of ids, and digests of the ids and of the decoded text."""
    coded = encode(docs, tokenizer, decoded="decoded", keep=["doc_id"])
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )

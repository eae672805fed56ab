"""SimHash near-duplicates through a pivot distance table.

The pivot table holds every distinct fingerprint's Hamming distances to reference
fingerprints: zero, one for each pair of neighbouring bits, and some spread over the space.
By the triangle inequality two fingerprints whose distances to any one pivot differ by more
than a limit are further apart than it, so a candidate pair is discarded by its largest
coordinate difference, and survivors are verified.

``classes`` links fingerprints within two bits. Of the distances to the references of bit
pairs, taken from that to zero, two bits change two at most. So with these coordinates dealt
to groups, two linked fingerprints have the same coordinates in all groups but two: that
is the key on which candidates meet, and nothing else of a fingerprint is in it. The number
of groups, and with it the width of the keys, grows with the number of fingerprints, so
keys stay selective at any size. A key under which more than CROWD fingerprints meet emits
no pairs: fingerprints within two bits have a common neighbour within one bit, so its members
are joined on their 65 neighbours, and at most 65 distinct fingerprints can meet there. That
way is exact too.

``near_classes`` links texts by the Jaccard similarity of their word shingles. Texts alike
by 0.8 differ in ten bits of 64 or so, which no band of bits could be the key of; so they
meet on shingles that are rare: with all shingles in one order, common ones last, two sets
of n and m shingles and a similarity of t share one of the first n - ceil(t n) + 1 of the
one and of the first m - ceil(t m) + 1 of the other, and no pair is missed. Candidates are
discarded by parity sketches, which never lose a pair, and the rest is verified on whole
sets. Large sets would fill a sketch, so theirs are longer, by a power of two; of two sketches
the longer one is folded to the length of the other, which is its set's sketch of that length.
First every set is compared with the nearest of the centres of its keys, one pair for
each set, which joins groups of copies of any size; only sets that are then in different
components meet again, in blocks inside tasks, which emit what all but the last test leave.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import NOT_SPACE, Texts, Words, boxed, column, connected_components, mix, settle, slices, text_bytes, tidy, unsettle

SHINGLE = 3
#: Differing bits; bands and common neighbours are proofs for two.
LIMIT = 2
CROWD = 64
#: Groups of coordinates by the number of fingerprints, as powers of two: a key has 16, 21 or 24 of the 32.
GROUPS = {0: 4, 22: 6, 30: 8}
#: References spread over the space, well mixed words of 64 bits; and those of the pairs of neighbouring bits.
SPREAD = [int(x) for x in mix(np.arange(1, 17, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))]
BIT_PAIRS = [3 << k for k in range(0, 64, 2)]
PIVOTS = [0, *BIT_PAIRS, *SPREAD]

NEAR_SHINGLE = 5
SIMILARITY = 0.8
#: Shingles of two sets up to which SKETCH words tell them apart: they differ in 400 of 1,024 bits then. Sketches of larger
#: sets are as much longer. And the differing bits of fingerprints of large sets that all but one in 80 billion pairs of
#: similarity 0.8 are within (9.7 on average, with a deviation of 2.9): nothing is discarded by that, as it is no proof.
SKETCHED, WIDE = 3600, 32
#: Differing bits up to which a set is compared with the centre of a key first; it sets the amount of work, never the result.
CENTRAL = 24
#: Texts hashed at a time, bytes.
SLICE = 2 << 20
#: Text, expected, that is asked for common shingles; at most HOT are told to all tasks. They set the amount of work, never the result.
SAMPLE_BYTES, HOT = 64 << 20, 100_000
#: Rows of a key that are compared by one group, and pairs at a time.
BLOCK, STEP, PART = 1024, 1 << 18, 1 << 15
#: Words of 64 bits of a parity sketch, and the most bits of the filter of candidates (8 MB).
SKETCH, FILTER_BITS = 16, 1 << 26
_PLACE = np.uint64(0x9E3779B97F4A7C15)
_SLACK = 1e-9


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


# ---------------------------------------------------------------- fingerprints within two bits


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text's word shingles, signed; zero for a text without words."""
    import xxhash

    words = text.encode().lower().split() if text else []  # bytes: only A-Z fold, only ASCII space splits
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, n, 4096):  # bounded memory for very long texts
        part = words[k : k + 4096 + shingle - 1]
        m = min(4096, n - k)
        h = np.fromiter((digest(b" ".join(part[i : i + shingle]), 42) for i in range(m)), dtype=">u8", count=m)
        counts += np.unpackbits(h.view(np.uint8).reshape(m, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > n)
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", to: str = "fingerprint", keep: list[str] | None = None, shingle: int = SHINGLE) -> DataFrame:
    """Adds the fingerprint (bigint) of whole texts; null, empty and blank texts have zero.

    Of columns, ``keep`` (all) stay; a former column of the new name is replaced.
    """
    names = [c for c in (keep if keep is not None else docs.columns) if c != to]
    box = docs.select(F.struct(*map(column, names)).alias("row"), column(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["row", "found"])

    out = box.mapInArrow(tidy(run), T.StructType([box.schema["row"], T.StructField("found", T.LongType())]))
    return out.select("row.*", F.col("found").alias(to))


def pivot_distances(fp: Column) -> Column:
    """The fingerprint's row of the pivot table."""
    return F.transform(F.array(*[F.lit(_signed(p)) for p in PIVOTS]), lambda p: F.bit_count(fp.bitwiseXOR(p)).cast("tinyint"))


def groups_of(n: int) -> int:
    return [g for power, g in GROUPS.items() if n >= 1 << power or not power][-1]


def pivot_keys(distances: Column, groups: int) -> Column:
    """For each two groups of coordinates a key of all others; a coordinate is a bit pair's distance beyond that to zero."""
    n = len(BIT_PAIRS)
    beyond = F.transform(F.slice(distances, 2, n), lambda x: (x - F.get(distances, 0)).cast("tinyint"))
    edges = [n * k // groups for k in range(groups + 1)]
    part = [F.slice(beyond, edges[k] + 1, edges[k + 1] - edges[k]) for k in range(groups)]
    return F.array(*[F.xxhash64(F.lit(k), *[part[g] for g in range(groups) if g not in two]) for k, two in enumerate(combinations(range(groups), 2))])


def links(distinct: DataFrame, fp: str = "fingerprint", crowd: int = CROWD, groups: int | None = None) -> DataFrame:
    """Edges (a, b) over distinct fingerprints whose closure is that of all pairs within LIMIT bits."""
    groups = groups or groups_of(distinct.count())
    table = distinct.select(F.col(fp).alias("fp")).withColumn("d", pivot_distances(F.col("fp")))
    rows = table.select("fp", "d", F.explode(pivot_keys(F.col("d"), groups)).alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met, _ = settle(rows.join(shared, "key"))
    few = met.where(F.col("n") <= crowd)
    a, b = (few.select("key", F.col("fp").alias(x), F.col("d").alias(f"d{x}")) for x in "ab")
    apart = F.array_max(F.zip_with("da", "db", lambda x, y: F.abs(x.cast("int") - y.cast("int"))))
    pairs = a.join(b, "key").where("a < b").where(apart <= LIMIT).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= LIMIT).select("a", "b").distinct()
    crowded = met.where(F.col("n") > crowd).select("fp").distinct()
    near = crowded.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64)])).alias("z"))
    least = near.groupBy("z").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    through = near.join(least, "z").where(F.col("a") != F.col("fp")).select("a", F.col("fp").alias("b")).distinct()
    return pairs.union(through)


def _named(prints: DataFrame, edges: DataFrame) -> DataFrame:
    """``prints`` (id, v, ...) with component_id, the smallest id of the component of v, and ``root``, which tells components apart."""
    least = prints.groupBy("v").agg(F.min("id").alias("least"))
    reach = connected_components(edges)
    rooted = least.join(reach.withColumnRenamed("node", "v"), "v", "left").withColumn("root", F.coalesce("component", "v"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(ids, "root").select("v", "root", "component_id"), "v")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id): component_id is the smallest key reachable over links.

    Equal fingerprints are one vertex, so groups of copies of any size cost one row each in
    the search. Fingerprint zero (texts without words) links like any other. Rows that repeat
    a key are rows of their own. A null key belongs to its component but names it only if no
    other key does. An empty table gives an empty result; further columns are left out.
    """
    prints, _ = settle(fingerprints(docs.select(column(key).alias("id"), column(text).alias("text")), to="v", keep=["id"]))
    edges = links(prints.select("v").distinct(), "v")
    return _named(prints, edges).select(F.col("id").alias(key), F.col("v").alias("fingerprint"), "component_id")


def report(docs: DataFrame) -> DataFrame:
    return classes(docs.select("doc_id", "text")).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- similar sets of shingles


def _shingles(batch: pa.RecordBatch, size: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, ascending; one shorter than a shingle is one shingle, one without words is empty."""
    words = Words(Texts(batch.column(batch.schema.get_field_index("text")), fold=True), NOT_SPACE)
    h = words.hashes()
    whole = np.zeros(max(0, len(h) - size + 1), dtype=np.uint64)
    for k in range(size if len(whole) else 0):
        whole = mix(whole * _PLACE + h[k : k + len(whole)])
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(whole[a : b - size + 1]))
        else:
            one = np.zeros(min(1, b - a), dtype=np.uint64)
            for w in h[a:b]:
                one = mix(one * _PLACE + w)
            out.append(mix(one + np.uint64(b - a)))
    return out


def _set_ids(sets: list[np.ndarray]) -> np.ndarray:
    """One id for equal sets."""
    sums = np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s)) for s in sets], dtype=np.uint64)
    return mix(sums).view(np.int64)


def _prints(sets: list[np.ndarray]) -> np.ndarray:
    """SimHash of each set."""
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    starts, counts = ends - sizes, np.zeros((len(sets), 64), dtype=np.int64)
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    for k in range(0, len(flat), STEP):
        bits = np.unpackbits(flat[k : k + STEP].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        here = np.flatnonzero((ends > k) & (starts < k + STEP) & (sizes > 0))
        counts[here] += np.add.reduceat(bits, np.maximum(starts[here] - k, 0), axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > sizes[:, None], axis=1).view(">i8").ravel().astype(np.int64)


def _sketch(found: np.ndarray, words: int = SKETCH) -> np.ndarray:
    """Bit b is the parity of the number of hashes that end in b: two sets differ in no fewer shingles than their sketches in bits."""
    odd = np.bincount((found & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _sketch_words(n: int) -> int:
    """Words of the sketch of a set of n: SKETCH, doubled until they tell two such sets apart."""
    words = SKETCH
    while 2 * n * SKETCH > SKETCHED * words:
        words *= 2
    return words


def prefix(n: int, similarity: float) -> int:
    return n - int(np.ceil(similarity * n - _SLACK)) + 1 if n else 0


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)))


def shingle_sets(texts: DataFrame, shingle: int, bits: np.ndarray | None = None) -> DataFrame:
    """v (id of the set) and shingles (array of bigint) of each text, or of those whose bit (v modulo their number) is set."""
    shared = None if bits is None else texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                found = _shingles(batch, shingle)
                ids = _set_ids(found)
                if shared is not None:
                    at = ids & (8 * len(shared.value) - 1)
                    on = np.flatnonzero(shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                    ids, found = ids[on], [found[k] for k in on]
                yield pa.RecordBatch.from_arrays([pa.array(ids), _lists(found)], names=["v", "shingles"])

    return texts.mapInArrow(tidy(run), "v long, shingles array<long>")


def common_shingles(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of the most frequent shingles of a bounded sample of texts."""
    share = min(1.0, SAMPLE_BYTES / max(1, text_bytes(texts, "text")))
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))
    often = shingle_sets(some, shingle).select(F.explode("shingles").alias("k")).groupBy("k").agg(F.count("*").alias("n")).where("n > 2")
    rows = often.orderBy(F.desc("n"), "k").limit(HOT).toPandas().sort_values("k", key=lambda k: k.to_numpy().view(np.uint64))
    return rows["k"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)


def _mark(text: Column) -> Column:
    """Tells texts under one key apart; a null text is not an empty one."""
    return F.xxhash64(text, text.isNull())


def prefixes(docs: DataFrame, key: str, text: str, shingle: int, similarity: float) -> DataFrame:
    """(id, mark, v, n, fp, sketch, first): n is the size of the set, fp its SimHash, first its prefix in the common order."""
    texts = docs.select(column(key).alias("id"), _mark(column(text)).alias("mark"), column(text).alias("text"))
    told = docs.sparkSession.sparkContext.broadcast(common_shingles(texts.select("text"), shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, often = told.value
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                found = _shingles(batch, shingle)
                sizes, firsts = np.array([len(x) for x in found], dtype=np.int32), []
                for x in found:
                    if len(hot) and len(x):
                        at = np.minimum(np.searchsorted(hot, x), len(hot) - 1)
                        x = x[np.argsort(np.where(hot[at] == x, often[at], 0), kind="stable")]
                    firsts.append(x[: prefix(len(x), similarity)])
                made = [pa.array(_set_ids(found)), pa.array(sizes), pa.array(_prints(found)), _lists([_sketch(x, _sketch_words(len(x))) for x in found]), _lists(firsts)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["id", "mark", "v", "n", "fp", "sketch", "first"])

    kinds = {"v": T.LongType(), "n": T.IntegerType(), "fp": T.LongType(), "sketch": T.ArrayType(T.LongType()), "first": T.ArrayType(T.LongType())}
    return texts.mapInArrow(tidy(run), T.StructType([*texts.schema[:2], *[T.StructField(n, k) for n, k in kinds.items()]]))


def _overlap(n: Column, m: Column, similarity: float) -> Column:
    """The least number of common shingles of sets of n and m."""
    return F.ceil((n + m) * (similarity / (1 + similarity)) - _SLACK)


def _reachable(n: Column, p: Column, m: Column, q: Column, similarity: float) -> Column:
    """At a shingle that two sets have in common at places p and q, n - p and m - q shingles can be common from there on."""
    return F.least(n - p, m - q) >= _overlap(n, m, similarity)


def _folded(first: np.ndarray, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, sketches of ``size`` words) of the sets that have as many or more; sets lie end to end, ``words`` long each."""
    rows, out = [], []
    for length in np.unique(words[words >= size]):
        here = np.flatnonzero(words == length)
        rows.append(here)
        whole = np.stack([first[a : a + length] for a in (np.cumsum(words) - words)[here]])
        out.append(np.bitwise_xor.reduce(whole.reshape(len(here), -1, size), axis=1))
    return np.concatenate(rows), np.concatenate(out)


def _compare(similarity: float):
    """Partition sorted by (k, i, j): pairs of a group in different components that sizes, places and sketches leave."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        c = {n: table.column(n).to_numpy() for n in table.schema.names if n != "sketch"}
        lists = table.column("sketch").combine_chunks()
        words, flat = pc.list_value_length(lists).to_numpy().astype(np.int64), lists.flatten().to_numpy().view(np.uint64)
        # for each length of a sketch those of all sets that have it, or are folded to it, and where
        sketches, places = {}, {}
        for size in np.unique(words).tolist():
            rows, sketches[size] = _folded(flat, words, size)
            places[size] = np.zeros(len(words), dtype=np.int64)
            places[size][rows] = np.arange(len(rows))
        group = np.stack([c[n] for n in ("k", "i", "j")], axis=1)
        head = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]).any(axis=1)]))
        stop = np.repeat(np.append(head[1:], len(group)), np.diff(np.append(head, len(group))))
        after = np.cumsum(stop - np.arange(len(group)) - 1)
        pairs = []
        for x in range(0, int(after[-1]), STEP):
            m = np.arange(x, min(x + STEP, int(after[-1])))
            a = np.searchsorted(after, m, side="right")
            b = stop[a] - (after[a] - m)
            ok = (c["c"][a] != c["c"][b]) & ((c["block"][a] != c["block"][b]) | (c["i"][a] == c["j"][a]))
            a, b = a[ok], b[ok]
            n, o = c["n"][a], c["n"][b]
            least = np.ceil((n + o) * (similarity / (1 + similarity)) - _SLACK)
            ok = np.minimum(n - c["p"][a], o - c["p"][b]) >= least
            a, b = a[ok], b[ok]
            n, o = c["n"][a], c["n"][b]
            most = n + o - 2 * np.ceil((n + o) * (similarity / (1 + similarity)) - _SLACK)
            size = np.minimum(words[a], words[b])
            ok = np.zeros(len(a), bool)
            for length, sketch in sketches.items():
                left = np.flatnonzero(size == length)
                for upto in (2, length):  # differing bits of a part are differing bits
                    step = max(1, PART * SKETCH // length)
                    x, y = places[length][a[left]], places[length][b[left]]
                    few = [np.bitwise_count(sketch[x[k : k + step], :upto] ^ sketch[y[k : k + step], :upto]).sum(axis=1, dtype=np.int64) <= most[left[k : k + step]] for k in range(0, len(left), step)]
                    left = left[np.concatenate([*few, np.zeros(0, bool)])]
                ok[left] = True
            a, b = a[ok], b[ok]
            pairs.append(np.stack([c["v"][a], c["v"][b]]))
        found = np.sort(np.concatenate([*pairs, np.zeros((2, 0), np.int64)], axis=1), axis=0)
        found = np.unique(found, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            c = np.stack([batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("k", "i", "j")], axis=1)
            turns = np.flatnonzero((c[1:] != c[:-1]).any(axis=1)) + 1
            if held and [held[-1].column(held[-1].schema.get_field_index(n))[-1].as_py() for n in ("k", "i", "j")] != c[0].tolist():
                turns = np.concatenate([[0], turns])
            if len(turns):  # all groups but the last are whole
                if (cut := int(turns[-1])) or held:
                    yield flush([*held, batch.slice(0, cut)])
                held = []
                batch = batch.slice(cut)
            held.append(batch)
        if held:
            yield flush(held)

    return run


def near_links(prints: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float = SIMILARITY) -> DataFrame:
    """Edges (a, b) of sets whose closure is that of all pairs of the similarity."""
    spark = prints.sparkSession
    # n and p in one number, and counts without ids: fewer bytes to shuffle for keys that only one text has
    rows = prints.select("v", (F.col("n").cast("long") * (1 << 32)).alias("np"), F.posexplode("first").alias("p", "k")).select("k", "v", (F.col("np") + F.col("p")).alias("np"))
    twice = rows.groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k")
    some, some_path = settle(rows.join(twice, "k"))
    one = prints.select("v", "fp", "sketch").dropDuplicates(["v"])
    fps = one.select("v", "fp")
    met = some.distinct().select("k", "v", F.shiftright("np", 32).cast("int").alias("n"), F.col("np").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("p"))
    several = met.groupBy("k").agg(F.min("v").alias("v0"), F.max("v").alias("v1")).where("v0 < v1").select("k")
    met, met_path = settle(met.join(several, "k").join(fps, "v"))
    unsettle(spark, some_path)

    def folded(sketch: str, size: Column) -> Column:
        """The sketch at ``size`` words, of which it has a multiple."""
        every = lambda k: F.filter(sketch, lambda x, i: i % size == k)
        return F.when(F.size(sketch) == size, F.col(sketch)).otherwise(F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.aggregate(every(k), F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))))

    def close(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), those that their sketches leave."""
        a, b = (prints.select(F.col("v").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")).dropDuplicates([x]) for x in "ab")
        size = F.least(F.size("sa"), F.size("sb"))
        differ = F.aggregate(F.zip_with(folded("sa", size), folded("sb", size), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
        return pairs.join(a, "a").join(b, "b").where(differ <= F.col("na") + F.col("nb") - 2 * _overlap(F.col("na"), F.col("nb"), similarity)).select("a", "b")

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), those of the similarity, on whole sets."""
        left, left_path = settle(pairs)
        sets, sets_path = settle(sets_of(left.select(F.explode(F.array("a", "b")).alias("v")).distinct()))
        a, b = (sets.select(F.col("v").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
        common = F.size(F.array_intersect("sa", "sb"))
        out, _ = settle(left.join(a, "a").join(b, "b").where(common >= _overlap(F.size("sa"), F.size("sb"), similarity)).select("a", "b"))
        unsettle(spark, left_path, sets_path)
        return out

    # the set in which a key's shingle comes first has few rare ones, as the source of edited copies has
    centre = met.groupBy("k").agg(F.min(F.struct("p", "v", "n", "fp")).alias("o"))
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("o.fp")))
    near = _reachable(F.col("n"), F.col("p"), F.col("o.n"), F.col("o.p"), similarity)
    star = met.join(centre, "k").where(F.col("v") != F.col("o.v")).where(near & (apart <= CENTRAL)).groupBy("v").agg(F.min(F.struct(apart.alias("d"), F.col("o.v").alias("v"))).alias("o"))
    star = verified(close(star.select(F.least("v", "o.v").alias("a"), F.greatest("v", "o.v").alias("b")).distinct()))
    reach = connected_components(star).withColumnRenamed("node", "v")
    named = met.join(reach, "v", "left").select("k", "v", "n", "p", F.coalesce("component", "v").alias("c"))
    open_ = named.groupBy("k").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("rows")).where("c0 < c1").select("k", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))
    dealt = named.join(open_, "k").join(one.select("v", "sketch"), "v").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("k", "v", "n", "p", "sketch", "c", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    left = dealt.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j").mapInArrow(tidy(_compare(similarity)), "a long, b long").distinct()
    out = star.union(verified(left))
    unsettle(spark, met_path)
    return out


def _bits(ids: DataFrame, rows: int) -> np.ndarray:
    """A bitmap of the ids, 16 bits a row of the table and FILTER_BITS at most: it only keeps sets from being shuffled in vain."""
    size = min(FILTER_BITS, 1 << max(15, (16 * rows).bit_length()))
    x = F.pmod("v", F.lit(size)) + 1
    parts = ids.groupBy(F.bitmap_bucket_number(x).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("bits")).collect()
    bits = np.zeros(size // 8, dtype=np.uint8)
    for r in parts:
        bits[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(r.bits, dtype=np.uint8)
    return bits


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(key, component_id): component_id is the smallest key reachable over pairs of the similarity.

    Words are folded and parted as for fingerprints. Equal sets are one vertex, so exact
    copies cost one row each. Texts without words are one class, shorter ones than a shingle
    have one. Rows that repeat a key are rows of their own. A null key belongs to its
    component but names it only if no other key does. An empty table gives an empty result.
    """
    return _near(docs, key, text, shingle, similarity).select(F.col("id").alias(key), "component_id")


def _near(docs: DataFrame, key: str, text: str, shingle: int, similarity: float) -> DataFrame:
    """(id, mark, root, component_id) of every row."""
    prints, _ = settle(prefixes(docs, key, text, shingle, similarity))
    total = prints.count()
    texts = docs.select(column(text).alias("text"))

    def sets_of(ids: DataFrame) -> DataFrame:
        return shingle_sets(texts, shingle, _bits(ids, total)).join(ids, "v", "left_semi").dropDuplicates(["v"])

    return _named(prints.select("id", "mark", "v"), near_links(prints, sets_of, similarity)).select("id", "mark", "root", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each component of near copies: that of the smallest key, null keys last.

    Of several texts under that key the one with the smallest hash stays, of rows alike in key
    and text any one.
    """
    found, _ = settle(_near(docs, key, text, shingle, similarity))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("without"), "id", "mark")).alias("first")).select("first.id", "first.mark")
    kept, _ = settle(first)
    same = [F.col("key").eqNullSafe(F.col("id")), F.col("its") == F.col("mark")]
    box = boxed(docs, key=column(key), its=_mark(column(text)))
    rows = box.join(kept, same, "left_semi")
    again, _ = settle(found.groupBy("id", "mark").agg(F.count("*").alias("n")).where("n > 1").join(kept.select(F.col("id").alias("i"), F.col("mark").alias("m")), F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")), "left_semi").select("id", "mark"))
    if again.isEmpty():
        return rows.select("row.*")
    # rows alike in key and text, which are few or none: one of each stays
    once = box.join(again, same, "left_semi").groupBy("key", "its").agg(F.first("row").alias("row"))
    return rows.join(again, same, "left_anti").select("row.*").unionByName(once.select("row.*"))

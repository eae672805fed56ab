"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

A table has two hash functions; each multiplies a unit vector by random signs and a
Hadamard matrix three times and names the coordinate of largest size with its sign.
The two names are a vector's own bucket; buckets in which one name is the runner-up,
nearest first, are probed too. Vectors that meet in a bucket (one of them at home there)
are candidates and are verified by their cosine in double precision. A pair that meets
in several buckets is counted where it meets first, so links are counted, never emitted.

Equal vectors are one vertex with a weight. A bucket above BLOCK rows is dealt over the
pairs of its blocks, and each block pair is compared by its own group of rows; a pair of
blocks reports counts and the roots of its own components, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import connected_components, settle, tidy, unsettle

THRESHOLD = 0.93
TABLES = 8
FUNCTIONS = 2
PROBES = 3
BLOCK = 1024
STEP = 1 << 15
SEED = 20
#: Components below this, or above its inverse, are scaled before they are squared.
TINY = 1e-100


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x


def codes(x: np.ndarray, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """(rows, tables, 1 + probes) buckets: the own one, then the probed ones; -1 where a short vector has no more."""
    n, d = x.shape
    wide = 1 << max(0, d - 1).bit_length()
    x = scaled(x)
    x = np.pad(x / np.linalg.norm(x, axis=1, keepdims=True), ((0, 0), (0, wide - d)))
    rng = np.random.default_rng([SEED, wide])
    take = min(3, wide)
    out = np.full((n, tables, 1 + probes), -1, dtype=np.int64)
    for t in range(tables):
        names, gaps = [], []
        for _ in range(FUNCTIONS):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], wide))
            top = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :take]
            value = np.take_along_axis(y, top, 1)
            names.append(top * 2 + (value < 0))
            gaps.append(np.abs(value[:, :1]) - np.abs(value))
        base = [(2 * wide) ** j for j in range(FUNCTIONS)]
        own = sum(names[j][:, 0] * base[j] for j in range(FUNCTIONS))
        out[:, t, 0] = own
        if take > 1 and probes:
            options = [(j, q) for j in range(FUNCTIONS) for q in range(1, take)]
            other = np.stack([own + (names[j][:, q] - names[j][:, 0]) * base[j] for j, q in options], axis=1)
            gap = np.stack([gaps[j][:, q] for j, q in options], axis=1)
            near = np.take_along_axis(other, np.argsort(gap, axis=1, kind="stable"), 1)[:, :probes]
            out[:, t, 1 : 1 + near.shape[1]] = near
    return out


def _hash(tables: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                lists = part.column(part.schema.get_field_index("v"))
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                begin = np.cumsum(sizes) - sizes
                found = np.zeros((part.num_rows, tables * (1 + probes)), dtype=np.int32)
                for d in np.unique(sizes):
                    rows = np.flatnonzero(sizes == d)
                    # below 16,384 dimensions a code fits; above, codes that fall together only add candidates
                    wide = codes(flat[begin[rows][:, None] + np.arange(d)], tables, probes).reshape(len(rows), -1)
                    found[rows] = np.where(wide < 0, wide, wide % (2**31 - 1))
                column = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), found.shape[1]).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, "codes"])

    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each vertex's component, over local edges."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows divided by their largest component where its square would leave the range of doubles; all others as they are."""
    most = np.abs(v).max(axis=1, initial=0.0)
    return v / np.where((most > 0) & ((most < TINY) | (most > 1 / TINY)), most, 1.0)[:, None]


class _Rows:
    """Sorted rows of one partition, group after group."""

    def __init__(self, columns: dict[str, np.ndarray], probes: int, threshold: float):
        self.c, self.probes, self.threshold = columns, probes, threshold

    def linked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which candidate pairs are linked and counted here."""
        c = self.c
        good = (c["cid"][a] != c["cid"][b]) & (c["own"][a] | c["own"][b])
        good &= (c["block"][a] != c["block"][b]) | (c["i"][a] == c["j"][a])
        where = np.flatnonzero(good)
        where = where[self.first_meeting(a[where], b[where])]  # a pair is verified in one bucket only
        a, b = a[where], b[where]
        near = np.einsum("ij,ij->i", c["v"][a], c["v"][b]) >= self.threshold * c["norm"][a] * c["norm"][b]
        return where[near]

    def first_meeting(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """True where no earlier (table, bucket) holds the pair too."""
        each = 1 + self.probes
        codes, here_t, here_c = self.c["codes"], self.c["table"][a], self.c["code"][a]
        ok = np.ones(len(a), dtype=bool)
        for t in range(codes.shape[1] // each):
            x, y = codes[a, t * each : (t + 1) * each], codes[b, t * each : (t + 1) * each]
            for i in range(each):
                for j in range(each):
                    if i and j:
                        continue  # one of the two must be at home
                    met = (x[:, i] == y[:, j]) & (x[:, i] >= 0)
                    ok &= ~(met & ((t < here_t) | ((t == here_t) & (x[:, i] < here_c))))
        return ok


def _compare(probes: int, threshold: float):
    """Partition sorted by (key, part): candidate pairs of each group, counted and joined locally."""

    def flush(tables: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(tables).combine_chunks()
        names = table.schema.names
        col = {n: table.column(k).combine_chunks() for k, n in enumerate(names)}
        part = np.stack([col[n].to_numpy(zero_copy_only=False) for n in ("key", "i", "j")], axis=1)
        new = np.ones(len(part), dtype=bool)
        new[1:] = (part[1:] != part[:-1]).any(axis=1)
        head = np.flatnonzero(new)
        stop = np.repeat(np.append(head[1:], len(part)), np.diff(np.append(head, len(part))))
        sizes = col["v"].value_lengths().to_numpy(zero_copy_only=False)
        flat = col["v"].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        begin = np.cumsum(sizes) - sizes
        v = np.zeros((len(part), int(sizes.max())))
        at = np.arange(v.shape[1])
        inside = at < sizes[:, None]
        v[inside] = flat[(begin[:, None] + at)[inside]]
        v = scaled(v)
        # i, j: the blocks whose pairs this group compares; pairs within a block belong to i == j
        c = {n: col[n].to_numpy(zero_copy_only=False) for n in ("cid", "weight", "table", "code", "own", "block", "label")}
        c["codes"] = col["codes"].flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
        c |= {"v": v, "norm": np.linalg.norm(v, axis=1), "i": part[:, 1], "j": part[:, 2]}
        rows = _Rows(c, probes, threshold)
        count = stop - np.arange(len(part)) - 1
        after = np.cumsum(count)
        found_a, found_b = [], []
        for k in range(0, int(after[-1]) if len(after) else 0, STEP):
            m = np.arange(k, min(k + STEP, int(after[-1])))
            a = np.searchsorted(after, m, side="right")
            b = a + 1 + (m - (after[a] - count[a]))
            same = (c["label"][a] == c["label"][b]) & (sizes[a] == sizes[b]) & (c["code"][a] == c["code"][b]) & (c["table"][a] == c["table"][b])
            a, b = a[same], b[same]
            hit = rows.linked(a, b)
            found_a.append(a[hit])
            found_b.append(b[hit])
        if not found_a or not (n := sum(map(len, found_a))):
            return None
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        ids, local = np.unique(c["cid"], return_inverse=True)
        a, b = local[a], local[b]
        weight = np.zeros(len(ids), dtype=np.int64)
        weight[local] = c["weight"]
        w = np.bincount(a, weight[b], minlength=len(ids)) + np.bincount(b, weight[a], minlength=len(ids))
        root = _roots(len(ids), a, b)
        on = np.flatnonzero(w)
        return pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(w[on].astype(np.int64)), pa.array(ids[root[on]])], names=["cid", "n", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                keys = np.stack([part.column(part.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("key", "i", "j")], axis=1)
                turns = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
                if held:
                    last = [held[-1].column(held[-1].schema.get_field_index(n))[held[-1].num_rows - 1].as_py() for n in ("key", "i", "j")]
                    if last != keys[0].tolist():
                        turns = np.concatenate([[0], turns])
                if len(turns):
                    cut = int(turns[-1])
                    if cut:
                        held.append(part.slice(0, cut))
                    if held and (out := flush(held)) is not None:
                        yield out
                    held = [part.slice(cut)]
                else:
                    held.append(part)
        if held and (out := flush(held)) is not None:
            yield out

    return run


def usable(vector: Column) -> Column:
    """Neither null, nor with a null or non-finite component, nor zero or empty."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def links(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """(key, n_links, component_id, kept) for every row.

    Only rows with equal labels (not null) and usable vectors of one length link. ``n_links``
    counts the other rows found with a cosine of at least ``threshold``; component_id is the
    smallest key reachable. Other rows have no link and are their own component. Rows are
    vertices, whatever their keys: rows that repeat a key link, or not, by their own vectors.
    A row without a key links and counts like any other, but names its component only if no
    row there has a key (then the component is null, and its rows are kept). An empty table
    gives an empty result; further columns are left out.
    """
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    rows = rows.withColumn("label", F.when(usable(F.col("v")), F.col("label"))).withColumn("v", F.when(F.col("label").isNotNull(), F.col("v")))
    # rows find their class again by two hashes of label and vector, 128 bits, so vectors are shuffled once
    marks = [F.xxhash64("label", "v").alias("h"), F.xxhash64(F.lit(1), "v", "label").alias("g")]
    classes = rows.where("label IS NOT NULL").groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").alias("weight"))
    classes, _ = settle(classes.select(F.monotonically_increasing_id().alias("cid"), "label", "v", "least", "weight", *marks))
    hashed = classes.select("cid", F.xxhash64("label").alias("label"), "v", "weight")
    coded, coded_path = settle(hashed.mapInArrow(tidy(_hash(tables, probes)), T.StructType([*hashed.schema.fields, T.StructField("codes", T.ArrayType(T.IntegerType()))])))
    each = 1 + probes
    keyed = coded.select("cid", F.posexplode("codes").alias("p", "code"), "label", F.size("v").alias("d")).where("code >= 0")
    keyed = keyed.select("cid", F.floor(F.col("p") / each).cast("int").alias("table"), (F.col("p") % each == 0).alias("own"), "code", F.xxhash64("label", "d", F.floor(F.col("p") / each), "code").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("home")).where("n > 1 AND home").select("key", "n")
    # a bucket of n rows has ceil(n / BLOCK) blocks; a row goes to every pair that its block belongs to
    live = keyed.join(sizes, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    live = live.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    live = live.select("cid", "table", "own", "code", "key", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    live = live.select("cid", "table", "own", "code", "key", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    met = live.join(coded, "cid")
    dealt = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found, _ = settle(dealt.mapInArrow(tidy(_compare(probes, threshold)), "cid long, n long, root long"))
    unsettle(rows.sparkSession, coded_path)
    counts = found.groupBy("cid").agg(F.sum("n").alias("n"))
    reach = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    vertex = classes.select("cid", "h", "g", "least", "weight").join(counts, "cid", "left").join(reach.withColumnRenamed("node", "cid"), "cid", "left")
    vertex = vertex.select("h", "g", "least", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "cid").alias("root"))
    least = vertex.groupBy("root").agg(F.min("least").alias("component_id"))
    named = vertex.join(least, "root").select("h", "g", "n_links", "component_id")
    alone = F.col("label").isNull()
    out = rows.select("id", "label", *[F.when(~alone, m).alias(n) for m, n in zip(marks, "hg")]).join(named, ["h", "g"], "left")
    component = F.when(alone, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def report(vectors: DataFrame) -> DataFrame:
    return links(vectors)


SQL = f"""
WITH RECURSIVE u AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
fine AS (SELECT *, list_max(list_transform(v, lambda x: abs(x))) AS most FROM u WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
good AS (SELECT r, vec_id, label, CASE WHEN most < {TINY} OR most > {1 / TINY} THEN list_transform(v, lambda x: x / most) ELSE v END AS v FROM fine),
p AS (SELECT a.r AS a, b.r AS b FROM good a JOIN good b ON a.label = b.label AND len(a.v) = len(b.v) AND a.r <> b.r
  WHERE list_dot_product(a.v, b.v) >= {THRESHOLD} * sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))),
reach AS (SELECT r, r AS o FROM u UNION SELECT reach.r, p.b FROM reach JOIN p ON reach.o = p.a),
c AS (SELECT reach.r, min(u.vec_id) AS component_id FROM reach JOIN u ON u.r = reach.o GROUP BY 1),
n AS (SELECT a AS r, count(*) AS n FROM p GROUP BY 1)
SELECT u.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, CAST(component_id AS BIGINT) AS component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM u JOIN c USING (r) LEFT JOIN n USING (r)
"""

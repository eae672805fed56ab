"""Centroid clustering of integer vectors with Elkan's bounds.

Every vector carries its cluster, an upper bound of the distance to its centroid and a
lower bound of the distance to each. A round moves the bounds by what the centroids moved,
and skips the distance to a centroid where the bounds, or half the distance between the
two centroids, prove it strictly larger. Bounds are rounded away from the truth and a
distance is skipped only where it is strictly larger, so ties are always computed, in
whole numbers, and go to the smaller number: clusters are those of the plain method.

A round is one pass over the table of the round before, without a shuffle of vectors. Each
partition adds a row with what changed in its clusters' sums and counts, and these rows
are summed in Spark; only centroids, k by the number of components, reach the driver. The
new state is a table in the shared folder, so a lost executor costs its tasks alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import column, settle, tidy, unsettle

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Vectors compared at a time.
STEP = 4096
#: Components below this have exact squared distances and sums in 64 bits, for up to 2^9 of them.
LARGEST = 1 << 26
#: Relative slack of a rounded bound; a double's error is below 2^-52 at each of a few steps.
SLACK = 2.0**-48


def floors(vector: Column, scale: int) -> Column:
    """Components times ``scale``, in double precision, rounded down to integers."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def finite(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))), F.lit(False))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one centroid."""
    gap = x - c
    return np.einsum("ij,ij->i", gap, gap)


def up(x):
    return x * (1 + SLACK)


def down(x):
    return x * (1 - SLACK)


@dataclass
class State:
    """Centroids (k, d), how far each moved since the bounds were last right, and whether bounds exist."""

    centroids: np.ndarray
    moved: np.ndarray | None = None

    def halves(self) -> np.ndarray:
        """At most half of the distances between centroids."""
        return np.stack([down(np.sqrt(squared(self.centroids, c).astype(np.float64))) / 2 for c in self.centroids])


def assign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, state: State, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row, the bounds after that, and how many distances were computed.

    ``cluster`` is -1 where a row has none yet; its bounds are 0 and infinite then.
    """
    k = len(state.centroids)
    upper, lower = upper.copy(), lower.copy()
    if state.moved is not None:
        old = cluster >= 0
        upper[old] = up(upper[old] + state.moved[cluster[old]])
        lower = np.maximum(0.0, down(lower) - state.moved)
    now = np.maximum(cluster, 0)
    computed = 0
    exact = np.full(len(x), -1, dtype=np.int64)  # squared distance to the present centroid, where known

    def settle_upper(rows: np.ndarray) -> None:
        nonlocal computed
        rows = rows[exact[rows] < 0]
        for a in np.unique(now[rows]):
            at = rows[now[rows] == a]
            exact[at] = squared(x[at], state.centroids[a])
            computed += len(at)
            root = np.sqrt(exact[at].astype(np.float64))
            upper[at], lower[at, a] = up(root), down(root)

    def open_to(c: int) -> np.ndarray:
        """Rows that may be as near to c as to their own centroid."""
        return np.flatnonzero((now != c) & (lower[:, c] <= upper) & (halves[now, c] <= upper))

    for c in range(k):
        rows = open_to(c)
        settle_upper(rows)
        rows = rows[(lower[rows, c] <= upper[rows]) & (halves[now[rows], c] <= upper[rows])]
        if not len(rows):
            continue
        other = squared(x[rows], state.centroids[c])
        computed += len(rows)
        root = np.sqrt(other.astype(np.float64))
        lower[rows, c] = down(root)
        nearer = (other < exact[rows]) | ((other == exact[rows]) & (c < now[rows]))
        won = rows[nearer]
        now[won], exact[won], upper[won] = c, other[nearer], up(root[nearer])
    return now, upper, lower, computed


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _lists(x: np.ndarray) -> pa.Array:
    ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(x).ravel()))


SCHEMA = "tally boolean, id {key}, v array<long>, cluster int, upper double, lower array<double>, distance long, computed long"


def _round(state: State, last: bool) -> Callable:
    """A pass over rows of SCHEMA: their new state, and at the end of a partition a tally for each cluster.

    A tally has in ``v`` the change of the cluster's sums, and at last that of its count; in
    ``distance``, in the last pass, the cluster's inertia.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, d = state.centroids.shape
        halves = state.halves()
        change = np.zeros((k, d + 1), dtype=np.int64)
        inertia = np.zeros(k, dtype=np.int64)
        computed, schema = 0, None
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                batch = whole.slice(at, STEP)
                schema = batch.schema
                x = _matrix(_column(batch, "v"), d)
                cluster = _column(batch, "cluster").to_numpy(zero_copy_only=False).astype(np.int64)
                now, upper, lower, n = assign(x, cluster, _column(batch, "upper").to_numpy(zero_copy_only=False), _matrix(_column(batch, "lower"), k), state, halves)
                computed += n
                moved = np.flatnonzero(now != cluster)
                for c in np.unique(np.concatenate([now[moved], cluster[moved]])):
                    for sign, mine in ((1, x[moved[now[moved] == c]]), (-1, x[moved[cluster[moved] == c]])):
                        if c >= 0:
                            change[c, :d] += sign * mine.sum(axis=0)
                            change[c, d] += sign * len(mine)
                distance = np.zeros(len(x), dtype=np.int64)
                if last:
                    for c in np.unique(now):
                        mine = np.flatnonzero(now == c)
                        distance[mine] = squared(x[mine], state.centroids[c])
                        inertia[c] += distance[mine].sum()
                yield pa.RecordBatch.from_arrays(
                    [_column(batch, "tally"), _column(batch, "id"), _column(batch, "v"), pa.array(now.astype(np.int32)), pa.array(upper), _lists(lower), pa.array(distance), pa.array(np.zeros(len(x), np.int64))],
                    names=schema.names,
                )
        if schema is not None:
            none = np.zeros(k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(k, bool)), pa.nulls(k, schema.field("id").type), _lists(change), pa.array(np.arange(k, dtype=np.int32)), pa.array(none), _lists(none[:, None]), pa.array(inertia), pa.array(np.append(np.zeros(k - 1, np.int64), computed))],
                names=schema.names,
            )

    return run


@dataclass
class Clusters:
    """Rows (id, cluster, distance) and, by cluster, centroids and inertias; ``computed``: distances computed in each pass."""

    rows: DataFrame
    centroids: list[list[int]]
    inertias: list[int]
    computed: list[int]


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED, key: str = "vec_id", vector: str = "embedding") -> Clusters:
    """Clusters of all vectors of ``dimensions`` components, none null or non-finite; other rows are left out.

    The first centroids are the k vectors with the smallest sha256 of ``seed:key`` (a null key
    is empty there; ties: smaller integer vector). Rows that repeat a key are vectors of their
    own. With fewer vectors than k there are as many clusters as vectors, with none the
    result is empty. Components times ``scale`` must lie within 2^26 either way and sums within
    64 bits, else the job fails. Further columns are left out.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    schema = T.StructType.fromDDL(SCHEMA.format(key=kind))
    good = vectors.select(column(key).alias("id"), column(vector).alias("x")).where(finite(F.col("x")) & (F.size("x") == dimensions))
    small = F.forall("v", lambda x: F.abs(x) <= F.lit(LARGEST))
    rows = good.select("id", floors(F.col("x"), scale).alias("v")).withColumn("v", F.when(small, F.col("v")).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST} in size"))))
    start = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.select(start.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    if not first:
        return Clusters(rows.limit(0).select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), [], [], [])
    k = len(first)
    centroids = np.array([r.v for r in first], dtype=np.int64)
    sums = np.zeros((k, dimensions + 1), dtype=object)
    none = F.array(*[F.lit(0.0)] * k)
    table, path = settle(rows.select(F.lit(False).alias("tally"), "id", "v", F.lit(-1).alias("cluster"), F.lit(float("inf")).alias("upper"), none.alias("lower"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("computed")))
    state, counted = State(centroids), []
    for turn in range(rounds + 1):
        last = turn == rounds
        new, new_path = settle(table.where("NOT tally").mapInArrow(tidy(_round(state, last)), schema))
        unsettle(spark, path)
        table, path = new, new_path
        tallies = table.where("tally").select("cluster", "distance", "computed", F.posexplode("v").alias("at", "x"))
        found = tallies.groupBy("cluster", "at").agg(F.sum("x").alias("x"), F.sum("distance").alias("distance"), F.sum("computed").alias("computed")).collect()
        for r in found:
            sums[r["cluster"], r["at"]] += int(r["x"])
        counted.append(sum(r["computed"] for r in found if r["at"] == 0))
        if last:
            inertias = [0] * k
            for r in found:
                inertias[r["cluster"]] = r["distance"]
            break
        new = [[int(s) // int(row[-1]) for s in row[:-1]] if row[-1] else c for row, c in zip(sums.tolist(), state.centroids.tolist())]
        new = np.array(new, dtype=np.int64)
        state = State(new, up(np.sqrt(np.einsum("ij,ij->i", new - state.centroids, new - state.centroids).astype(np.float64))))
    return Clusters(table.where("NOT tally").select("id", "cluster", "distance"), state.centroids.tolist(), inertias, counted)


def report(vectors: DataFrame) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    found = cluster(vectors)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    by = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]).cast(f"array<{kind}>"), F.col("cluster"))
    return found.rows.select(
        F.col("id").alias("vec_id"), "cluster", "distance", by(found.inertias, "bigint").alias("cluster_inertia"), F.lit(sum(found.inertias)).cast("long").alias("inertia"), by(digests, "string").alias("centroid_sha256")
    )


def _sql() -> str:
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v FROM v ORDER BY c LIMIT {CLUSTERS})",
    ]
    for t in range(ROUNDS + 1):
        steps.append(f"""a{t} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, c := c)) AS best FROM
  (SELECT r, c, CAST(list_sum(list_transform(range(1, {DIMENSIONS + 1}), lambda i: (v.v[i] - c{t}.v[i]) * (v.v[i] - c{t}.v[i]))) AS BIGINT) AS d FROM v, c{t}) GROUP BY r)""")
        if t < ROUNDS:
            steps.append(f"""c{t + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, c{t}.v) AS v FROM c{t} LEFT JOIN
  (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM
    (SELECT best.c AS c, i, sum(x) AS s, count(*) AS n FROM (SELECT best, unnest(v) AS x, unnest(range({DIMENSIONS})) AS i FROM a{t} JOIN v USING (r)) GROUP BY 1, 2) GROUP BY c) m USING (c))""")
    last = ROUNDS
    return f"""WITH {", ".join(steps)},
f AS (SELECT r, vec_id, best.c AS c, best.d AS d FROM a{last} JOIN v USING (r))
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c{last}.v, ',')) AS centroid_sha256 FROM f JOIN c{last} USING (c)"""


SQL = _sql()

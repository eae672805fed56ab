"""Mixing, clustering and hard negatives."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import same
from tallyworks.llm import elkan, hardneg, mixture

VECTORS = "vec_id long, embedding array<float>, label int"


def against(frame, name, operator):
    con = duckdb.connect()
    con.register(name, frame.toArrow())
    got, want = operator.report(frame).toPandas(), con.execute(operator.SQL).df()
    same(got, want)
    return got


# ---------------------------------------------------------------- mixing


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)


def test_mixture_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(k, "hot" if k % 3 else f"s{k % 7}", " ".join(["w"] * int(rng.integers(0, 90)))) for k in range(400)]
    rows += [(1, "hot", "a b"), (1, "hot", "a b"), (None, None, "x y z"), (None, None, None), (500, "\U0001f600", "one"), (501, "￿", "one two"), (502, "empty", ""), (503, "null", None), (504, "long", "word\x0b  " * 30000)]
    got = against(documents(spark, rows), "documents", mixture)
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all() and got[got.doc_id == 504]["size"].item() == 60000
    assert (got[got.doc_id == 503].target == 0).all()


def test_mixture_meets_its_targets_in_every_shard(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "'mine' AS size", "'mine' AS place", "'mine' AS `a.b`")
    mixed = mixture.mix(docs, shards=4).cache()
    assert mixed.columns == [*[c for c in docs.columns if c != "size"], *mixture.NEW]
    spans = mixed.select("source", "target", "taken", F.explode("spans").alias("s"))
    by = spans.groupBy("source", "target", "s.shard").agg(F.sum(F.col("s.end") - F.col("s.begin")).alias("n")).toPandas()
    assert set(by.shard) == {0, 1, 2, 3} and (abs(by.n - by.target / 4) <= 2 * mixture.BLOCK).all()
    whole = mixed.groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t")).toPandas()
    assert (abs(whole.n - whole.t) <= mixture.BLOCK).all()
    pieces = mixture.pieces(mixed).toPandas()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(pieces) and all(p.text == " ".join(w for w in __import__("re").findall(mixture.WORD, texts[p.doc_id])[p.begin : p.end]) for p in pieces.head(300).itertuples())
    again = mixture.mix(docs.repartition(7), shards=4)
    assert again.select("doc_id", "spans").exceptAll(mixed.select("doc_id", "spans")).count() == 0
    mixed.unpersist()


@pytest.mark.parametrize("seed", range(4))
def test_quotas_are_the_highest_quotients(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = [(f"s{k:03d}", int(x)) for k, x in enumerate(rng.integers(0, 2000, 1 + 15 * seed))]
    got = {r.source: r for r in mixture.quotas(mixture.targets(spark.createDataFrame(sizes, "source string, source_size long")), shards=5).collect()}
    votes = {s: r.target * r.n / r.source_size if r.n else 0 for s, r in got.items()}
    seats = round(sum(votes.values()))
    order = sorted((-v / (2 * i + 1), s, i) for s, v in votes.items() if v for i in range(seats + 1))
    for k in range(1, 6):
        won = [s for _, s, _ in order[: seats * k // 5]]
        assert {s: r.upto[k - 1] for s, r in got.items()} == {s: min(won.count(s), 3 * got[s].n) for s in got}


def brute_targets(sizes, weights, repeat=3):
    free, target, rest = set(range(len(sizes))), {}, float(sum(sizes))
    while free:
        share = {k: rest * weights[k] / sum(weights[j] for j in free) for k in free}
        full = [k for k in free if share[k] > repeat * sizes[k]]
        if not full:
            target |= share
            break
        for k in full:
            target[k] = repeat * sizes[k]
            rest -= target[k]
            free.remove(k)
    return [target[k] for k in range(len(sizes))]


def test_targets(spark):
    for sizes in ([100, 1, 1, 1], [10, 10, 10], [0, 0], [5, 0, 900, 3, 40, 77, 1], [7]):
        rows = [(f"s{k}", x) for k, x in enumerate(sizes)]
        got = sorted(mixture.targets(spark.createDataFrame(rows, "source string, source_size long")).collect())
        assert [r.target for r in got] == pytest.approx(brute_targets(sizes, [1 + k % 3 for k in range(len(sizes))]))


def test_mixture_of_nothing_and_of_many_like_rows(spark, monkeypatch):
    assert mixture.report(documents(spark, [(1, "a", "b")]).where("false")).count() == 0
    monkeypatch.setattr(mixture, "ROOM", 20)
    monkeypatch.setattr(mixture.positions, "__defaults__", (mixture.SEED, 20))
    against(documents(spark, [(7, "a", "p q r")] * 150 + [(k, "a", "x " * (k % 9)) for k in range(60)] + [(None, None, "x")] * 50), "documents", mixture)


# ---------------------------------------------------------------- clustering


def vectors(spark, rows):
    return spark.createDataFrame(rows, VECTORS).repartition(3)


def test_centroids_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(size=64) * rng.choice([0.01, 0.2])], 1) for k in range(200)]
    rows += [(k, rows[0][1], 1) for k in range(300, 420)]  # one large group of copies
    rows += [(5, rows[9][1], 1), (5, rows[10][1], 1), (None, rows[3][1], None), (600, None, 1), (601, [], 1), (602, [1.0] * 63, 1), (603, [1.0] * 63 + [None], 1), (604, [float("nan")] * 64, 1), (605, [float("inf")] * 64, 1), (606, [0.0] * 64, 1), (607, [-0.0001] * 64, 1)]
    got = against(vectors(spark, rows), "embeddings", elkan)
    assert len(got) == 325 and not set(got.vec_id) & {600, 601, 602, 603, 604, 605}


def test_centroids_with_ties_and_few_vectors(spark):
    grid = [(i * 9 + j, [float(i), float(j)] + [0.0] * 62, 1) for i in range(9) for j in range(9)]
    against(vectors(spark, grid), "embeddings", elkan)
    few = against(vectors(spark, grid[:3]), "embeddings", elkan)
    assert sorted(few.cluster) == [0, 1, 2] and (few.inertia == 0).all()
    assert elkan.report(vectors(spark, grid).where("false")).count() == 0
    assert elkan.report(vectors(spark, [(1, [1.0], 1)])).count() == 0


def test_bounds_skip_distances(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(8, 64)) * 3
    rows = [(k, [float(np.float32(x)) for x in centres[k % 8] + rng.normal(size=64) * 0.1], 1) for k in range(800)]
    found = elkan.cluster(vectors(spark, rows))
    assert len(found.computed) == 11 and found.computed[0] > 4000 and found.computed[-1] < 2 * 800
    assert sum(found.inertias) == found.rows.agg(F.sum("distance")).first()[0]


def test_centroids_refuse_what_does_not_fit(spark):
    with pytest.raises(Exception, match="beyond"):
        elkan.report(vectors(spark, [(1, [1e9] + [0.0] * 63, 1)])).collect()


# ---------------------------------------------------------------- hard negatives


@pytest.mark.parametrize("digit,room", [(8, 16), (2, 0)])
def test_hard_negatives_of_odd_rows(spark, monkeypatch, digit, room):
    """Small digits and no room: every place is found bit by bit, keys included."""
    monkeypatch.setattr(hardneg, "DIGIT", digit)
    monkeypatch.setattr(hardneg, "ROOM", room)
    monkeypatch.setattr(hardneg, "PACK", 17)
    monkeypatch.setattr(hardneg, "ANCHORS", 3)
    rng = np.random.default_rng(8)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(size=6).round(1 if k % 2 else 0)], int(rng.integers(0, 3))) for k in range(240)]
    rows += [(k, rows[50][1], 1 + k % 2) for k in range(400, 480)]  # many equal scores
    rows += [(50, rows[7][1], 1), (50, rows[8][1], 1), (None, rows[50][1], 1), (None, rows[50][1], 2), (-3, rows[50][1], 2), (900, None, 1), (901, [], 1), (950, [], 1), (1000, [1.0], 1), (1050, [float("nan")] * 6, 1), (1100, [None] * 6, 1), (1150, rows[3][1], None), (1200, [0.0] * 6, 9), (1201, [0.0] * 6, 9)]
    got = against(vectors(spark, rows), "embeddings", hardneg)
    assert len(got) > 100 and got.groupby(["anchor_id", "positive_id", "rank"]).size().max() >= 1


def test_hard_negatives_of_alike_rows(spark):
    same_key = [(None, [1.0, 0.9], 2)] * 60 + [(7, [1.0, 0.9], 2)] * 60
    got = hardneg.mine(vectors(spark, [(0, [1.0, 1.0], 1), (1, [1.1, 1.1], 1), *same_key]), F.col("vec_id") == 0).collect()
    assert [(r["rank"], r.negative_id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 7), (2, 7), (3, 7)]


def test_hard_negatives_of_nothing(spark):
    frame = vectors(spark, [(50, [1.0], 1), (1, [1.0], 2)])
    assert hardneg.report(frame).count() == 0
    assert hardneg.report(frame.where("false")).count() == 0
    assert hardneg.report(frame.where("vec_id = 1")).count() == 0


def test_scores_are_exact():
    x = np.array([[2**30, 1], [-(2**30), 3]])
    assert hardneg.scores(x, x).tolist() == [[2**60 + 1, 3 - 2**60], [3 - 2**60, 2**60 + 9]]
    with pytest.raises(OverflowError):
        hardneg.scores(x * 2, x * 2)

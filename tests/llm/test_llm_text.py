"""Operators on documents: brute force on small tables, and the cases every operator must take."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import same
from tallyworks.llm import bpe, decontam, langid, lmscore, queries, shard, simhash, substring
from tallyworks.llm.queries import TOKENIZER

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
ODD = [
    (1, LONG, "en", "s", 1),
    (2, None, None, None, None),
    (3, "", "en", "s", 0),
    (4, " \n\t ", "en", "s", 3),
    (5, LONG + " end", "en", "s", 1),
    (5, LONG + " end", "en", "s", 1),
    (6, "word " * 30000 + "é漢😀\x00 <|endoftext|>", "fr", "s", 1),
    (7, "Ä.B,c-d_e", "de", "s", 1),
    (8, "123 456 !!! ...", None, "s", 1),
    (None, "no key here at all", "en", "s", 1),
    (9, LONG.upper(), "en", "s", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- decontamination


def brute_hits(texts, items, window=10):
    windows = {}
    for name, text in items:
        w = WORD.findall(low(text))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add(str(name))
    out = []
    for key, text in texts:
        w, found = WORD.findall(low(text)), set()
        hit = [False] * len(w)
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (names := windows.get(tuple(w[k : k + size]))) is not None:
                    found |= names
                    hit[k : k + size] = [True] * size
        out.append((key, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)))
    return sorted(out, key=repr)


NAMES = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


@pytest.mark.parametrize("bytes_", [1 << 23, 2000])
def test_decontamination(spark, sf, docs, bytes_):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    found = decontam.search(docs, bench, keep=["doc_id"], benchmark_bytes=bytes_)
    got = [(r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in found.collect()]
    want = brute_hits([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert sorted(got, key=repr) == want and any(w[-1] for w in want)


def test_decontamination_oracle(spark, duck, sf):
    same(queries.op1_decontaminate(spark, sf).toPandas(), duck.execute(decontam.SQL).df())


def test_decontamination_of_odd_rows(spark, odd):
    items = [(1, "Gamma delta, epsilon ZETA eta theta iota kappa lambda mu nu"), (2, "b c"), (3, None), (4, ""), (5, "word"), (6, "B C"), (6, "omega end"), (None, "tau upsilon phi chi psi omega")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.report(odd, bench).select(*NAMES).collect()
    want = brute_hits([(r[0], r[1]) for r in ODD], [("" if i is None else i, t) for i, t in items])
    assert sorted((tuple(r) for r in got), key=repr) == want
    best = {r.doc_id: {m.item_id: (m.item_start, m.doc_start, m.n_words) for m in r.matches} for r in decontam.search(odd, bench).collect()}
    assert best[1]["1"] == (0, 2, 11)
    assert decontam.remove(odd, bench).columns == odd.columns
    assert decontam.report(empty(spark), bench).count() == 0
    mine = odd.selectExpr("*", "'MINE' AS items", "99 AS n_words", "'m' AS hits", "'m' AS matches", "'m' AS row", "7 AS n_hit")
    left = decontam.remove(mine, bench)
    assert left.columns == mine.columns and left.count() == sum(not w[-1] for w in want) and left.where("items <> 'MINE' OR n_words <> 99 OR n_hit <> 7 OR row <> 'm'").count() == 0
    assert decontam.report(odd, bench.where("false")).where("contaminated").count() == 0


# ---------------------------------------------------------------- SimHash


def brute_print(text):
    import xxhash

    w = re.findall("[^\x20\x09-\x0d]+", low(text))
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, limit=2):
    values = sorted(set(prints))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= limit:
                root[find(b)] = find(a)
    return {v: find(v) for v in values}


def test_simhash(spark, docs):
    rows = [(r.doc_id, brute_print(r.text)) for r in docs.collect()]
    group = brute_components([p for _, p in rows])
    least = {}
    for key, p in rows:
        least[group[p]] = min(key, least.get(group[p], key))
    want = sorted((key, f"{p:016x}", least[group[p]]) for key, p in rows)
    assert sorted(tuple(r) for r in simhash.report(docs).collect()) == want


@pytest.mark.parametrize("crowd,groups", [(64, 4), (3, 4), (1, 4), (64, 6), (64, 8)])
def test_links_of_near_prints(spark, crowd, groups):
    rng = np.random.default_rng(crowd)
    prints = {0, (1 << 64) - 1}
    for _ in range(12):
        base = int(rng.integers(0, 1 << 63))
        for _ in range(25):
            flips = rng.choice(64, rng.integers(0, 5), replace=False)
            prints.add(base ^ sum(1 << int(b) for b in flips))
    signed = {p - (1 << 64) if p >> 63 else p: p for p in prints}
    frame = spark.createDataFrame([(s,) for s in signed], "fingerprint long")
    reach = {signed[r.node]: signed[r.component] for r in simhash.connected_components(simhash.links(frame, crowd=crowd, groups=groups)).collect()}
    want = brute_components(prints)
    mine = {p: reach.get(p, p) for p in prints}
    pairs = lambda m: {frozenset(q for q in prints if m[q] == m[p]) for p in prints}
    assert pairs(mine) == pairs(want)


def test_simhash_of_odd_rows(spark, odd):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.report(odd).collect()}
    zero = "0" * 16
    assert got[(2, zero)] == got[(3, zero)] == got[(4, zero)] == 2
    assert got[(1, f"{brute_print(LONG):016x}")] == got[(9, f"{brute_print(LONG):016x}")] == 1
    assert simhash.report(odd).count() == len(ODD) and simhash.report(empty(spark)).count() == 0
    mine = odd.selectExpr("*", "'mine' AS fingerprint", "'mine' AS v", "'mine' AS id", "'mine' AS key", "'mine' AS row")
    kept = simhash.keep_one(mine)
    assert kept.columns == mine.columns and kept.where("v <> 'mine' OR id <> 'mine' OR row <> 'mine'").count() == 0
    assert {r.doc_id for r in kept.collect()} == {None, 1, 2, 6, 7, 8}
    assert simhash.fingerprints(mine).columns == [*odd.columns, "v", "id", "key", "row", "fingerprint"]


# ---------------------------------------------------------------- near copies


def brute_near(docs, similarity=0.8):
    """{key: smallest key of its component} over pairs with so much of their five-word shingles in common."""
    sets = {}
    for key, text in docs:
        w = re.findall("[^\x20\x09-\x0d]+", low(text))
        sets[key] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    keys, root = sorted(sets), {k: k for k in sets}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if (len(x & y) >= similarity * len(x | y) - 1e-9) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {k: find(k) for k in keys}


def edited(rng):
    """Texts with words changed, around the threshold on both sides; a common passage; a large group."""
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    passage, rows = [word() for _ in range(30)], []
    for group in range(8):
        base = [word() for _ in range(int(rng.integers(20, 160)))] + (passage if group % 2 else [])
        for _ in range(60 if group == 3 else 12):
            w = list(base)
            for at in rng.choice(len(w), int(rng.integers(0, max(2, len(w) // 20))), replace=False):
                w[at] = word()
            rows.append((len(rows), " ".join(w)))
    short = ["one two three", "One  two three", "one two four", "", " ", "one two three four five", "one two three four five six"]
    return rows + [(len(rows) + k, x) for k, x in enumerate(short)]


def test_near_copies_stage(spark):
    import corpus_pipeline

    rows = edited(np.random.default_rng(5))
    want = brute_near(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.near_classes(docs).collect()}
    assert got == want and 20 < len(set(want.values())) < len(rows) - 20
    kept = corpus_pipeline.near_copies(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("block", [1024, 7])
def test_near_copies_in_blocks(spark, block, monkeypatch):
    """Many texts that share most shingles but are not similar enough, so their keys stay open."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "STEP", 1 << 10)
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    base, rows = [word() for _ in range(100)], []
    for k in range(70):
        w = list(base)
        at = rng.choice(88, 1) if k % 3 else rng.choice(88, 2, replace=False)
        w[int(at[0]) : int(at[0]) + 8] = [word() for _ in range(8)]
        rows.append((k, " ".join(w)))
    got = {r.doc_id: r.component_id for r in simhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_near(rows) and len(set(got.values())) > 10


def test_pivot_table_chooses_the_candidates(spark, monkeypatch):
    """Without the distances to the references of bit pairs, keys say nothing and every fingerprint meets every other."""
    rng = np.random.default_rng(3)
    prints = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 300)]
    frame = spark.createDataFrame([(p,) for p in prints + [prints[0] ^ 5]], "fp long").withColumn("d", simhash.pivot_distances(F.col("fp")))

    def met():
        keyed = frame.select("fp", F.explode(simhash.pivot_keys(F.col("d"), 4)).alias("key"))
        return keyed.alias("a").join(keyed.alias("b"), "key").where("a.fp < b.fp").select("a.fp", "b.fp").distinct().count()

    assert 1 <= met() < 20
    assert frame.select(F.size("d")).first()[0] == len(simhash.PIVOTS) == 49
    frame = frame.withColumn("d", F.transform("d", lambda x: F.lit(0).cast("tinyint")))
    assert met() == 301 * 300 // 2


def test_sketches_and_fingerprints_lose_no_similar_pair():
    """Sets at the threshold: sketches never differ in more than the sets, and fingerprints of large sets stay within WIDE."""
    rng = np.random.default_rng(4)
    for n, m, common in ((4, 5, 4), (9, 9, 8), (8, 9, 8), (30, 30, 27), (300, 300, 267), (1900, 1900, 1689), (1700, 2000, 1645)):
        sets = []
        for _ in range(400 if n < 1000 else 150):
            s = rng.integers(0, 1 << 63, n + m, dtype=np.uint64)
            sets += [s[:n], np.concatenate([s[:common], s[n : n + m - common]])]
        sketch = np.stack([simhash._sketch(x) for x in sets])
        assert np.bitwise_count(sketch[::2] ^ sketch[1::2]).sum(axis=1).max() <= n + m - 2 * common
        fp = simhash._prints(sets).view(np.uint64)
        if n + m > simhash.SKETCHED:
            assert int(np.bitwise_count(fp[::2] ^ fp[1::2]).max()) <= simhash.WIDE


def test_large_sets_are_not_discarded_by_their_fingerprints(spark):
    """Fingerprints are no proof: of two large similar sets one stays even if all bits of their fingerprints differ."""
    rng = np.random.default_rng(2)
    one = np.sort(rng.integers(0, 1 << 63, 4000, dtype=np.uint64))
    two, other = np.sort(np.concatenate([one[:3800], rng.integers(0, 1 << 63, 200, dtype=np.uint64)])), np.sort(np.concatenate([one[:400], rng.integers(0, 1 << 63, 3600, dtype=np.uint64)]))
    sets = {1: (one, 0), 2: (two, -1), 3: (other, 0)}
    signed = lambda x: x.view(np.int64).tolist()
    rows = [(v, v, 0, len(x), fp, signed(simhash._sketch(x)), signed(x[: simhash.prefix(len(x), 0.8)])) for v, (x, fp) in sets.items()]
    prints = spark.createDataFrame(rows, "id long, v long, mark long, n int, fp long, sketch array<long>, first array<long>")
    whole = spark.createDataFrame([(v, signed(x)) for v, (x, _) in sets.items()], "v long, shingles array<long>")
    found = simhash.near_links(prints, lambda ids: whole.join(ids, "v", "left_semi")).collect()
    assert [(r.a, r.b) for r in found] == [(1, 2)]


def test_sketches_of_large_sets_are_longer_and_fold(spark):
    """A longer sketch folds to the shorter one, and texts on both sides of a doubling are told apart and linked."""
    rng = np.random.default_rng(6)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (1800, 1801, 3600, 3601, 20000)]
    words = np.array([simhash._sketch_words(len(x)) for x in sets])
    assert words.tolist() == [16, 32, 32, 64, 256]
    flat = np.concatenate([simhash._sketch(x, w) for x, w in zip(sets, words)])
    for size in (16, 32, 256):
        at, got = simhash._folded(flat, words, size)
        assert sorted(at) == np.flatnonzero(words >= size).tolist() and all((y == simhash._sketch(sets[k], size)).all() for k, y in zip(at, got))
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    text = [word() for _ in range(2100)]
    rows = [(1, " ".join(text)), (2, " ".join(text[:1720])), (3, " ".join(text[:1000] + [word() for _ in range(1100)])), (4, " ".join(text[:600] + [word() for _ in range(900)]))]
    got = {r.doc_id: r.component_id for r in simhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_near(rows) == {1: 1, 2: 1, 3: 3, 4: 4}


@pytest.mark.parametrize("n,m,common", [(4, 5, 4), (9, 9, 8)])
def test_similar_texts_with_far_fingerprints_are_linked(spark, n, m, common):
    """Short texts at the threshold, those of many tries whose fingerprints differ most."""
    rng = np.random.default_rng(n)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    texts, pool = [], ["".join(x) for x in rng.choice(list("abcdefghij"), (4000, 6))]
    for _ in range(3000):
        w = [str(x) for x in rng.choice(pool, n + 4)]
        texts.append((" ".join(w), " ".join([*w[: common + 4], *[word() for _ in range(m - common)]])))
    sets = simhash._shingles(pa.RecordBatch.from_pydict({"text": [t for two in texts for t in two]}), 5)
    fp = simhash._prints(sets).view(np.uint64)
    apart = np.bitwise_count(fp[::2] ^ fp[1::2])
    worst = np.argsort(-apart.astype(int), kind="stable")[:8]
    assert apart[worst[0]] > 18
    rows = [(int(2 * k + j), texts[int(i)][j]) for k, i in enumerate(worst) for j in (0, 1)]
    got = {r.doc_id: r.component_id for r in simhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k // 2 * 2 for k, _ in rows} == brute_near(rows)


def test_one_row_of_repeated_keys_stays(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "x"), (7, b, "x"), (1, a, "x"), (None, a, "x"), (None, "alone in this one here", "x"), (9, None, "x"), (9, "", "y")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, root string"))
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) in ([(0, "alone in this one here"), (1, a), (5, b), (9, "")],)


def test_near_copies_of_odd_rows(spark, odd):
    assert simhash.near_classes(odd).count() == len(ODD) and simhash.near_classes(empty(spark)).count() == 0
    assert simhash.keep_one(odd).where("doc_id IN (3, 4, 9)").count() == 0


# ---------------------------------------------------------------- substrings


def test_substring_oracle(spark, duck, docs):
    same(substring.report(docs).toPandas(), duck.execute(substring.SQL).df())


def test_substring_with_clashing_names(spark):
    passage = " ".join(f"w{k}" for k in range(25))
    frame = spark.createDataFrame([(1, passage, "x"), (2, "a " + passage, "x")], "doc_id int, text string, id string").selectExpr("*", "id AS mark", "id AS `a.b`", "id AS row", "id AS removed", "id AS bucket")
    got = substring.dedup(frame)
    assert got.columns == ["doc_id", "text", "id", "mark", "a.b", "row", "bucket", *substring.NEW]
    assert sorted((r.doc_id, r.text, r.id, r.mark, r["a.b"], r.row, r.kept) for r in got.collect()) == [(1, passage, *"xxxx", passage), (2, "a " + passage, *"xxxx", "a")]
    assert [r.kept for r in substring.dedup(frame, keep=["text"]).collect() if r.kept != passage] == ["a"]
    with pytest.raises(ValueError, match="no integer"):
        substring.dedup(frame, key="id")


def test_documents_in_no_language_go(spark, docs):
    import corpus_pipeline

    odd = spark.createDataFrame([(10**6 + k, x, None, "s", 1) for k, x in enumerate(["", None, "12 34", "?!"])], docs.schema)
    kept = corpus_pipeline.language(spark, docs.unionByName(odd), "")
    assert kept.columns == docs.columns and kept.where(f"doc_id >= {10**6}").count() == 0
    assert kept.count() == docs.where(langid.has_letter(F.col("text"))).count()  # no clean document goes
    assert langid.least_score(docs.where("false"), langid.Network([])) == 0


@pytest.mark.parametrize("block", [1 << 22, 300])
def test_substring_blocks(spark, block):
    passage = " ".join(f"w{k}" for k in range(30))
    rows = [(1, "a b c " + passage), (2, passage + " d e " + passage), (3, "x\n" + passage.replace(" ", "  ")), (4, "short text"), (5, None), (6, ""), (7, "a b c " + passage), (7, "a b c " + passage), (None, passage), (8, " ".join(["r"] * 50))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    old, substring.BLOCK_BYTES = substring.BLOCK_BYTES, block
    try:
        got = [(r.doc_id, r.n_words, r.n_removed, r.kept, [(s.start, s.end) for s in r.removed]) for r in substring.dedup(frame, keep=["doc_id"]).collect()]
    finally:
        substring.BLOCK_BYTES = old
    want = [
        (None, 30, 0, passage, []),
        (1, 33, 30, "a b c", [(3, 33)]),
        (2, 62, 60, "d e", [(0, 30), (32, 62)]),
        (3, 31, 30, "x", [(1, 31)]),
        (4, 2, 0, "short text", []),
        (5, 0, 0, "", []),
        (6, 0, 0, "", []),
        (7, 33, 33, "", [(0, 33)]),
        (7, 33, 33, "", [(0, 33)]),
        (8, 50, 49, "r", [(1, 50)]),
    ]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_substring_of_odd_rows(spark, odd):
    got = substring.dedup(odd.withColumn("kept", odd.text))
    assert got.count() == len(ODD) and set(odd.columns) <= set(got.columns)
    assert {r.doc_id: r.n_removed for r in got.collect()}[5] == 24
    assert substring.report(empty(spark)).count() == 0


# ---------------------------------------------------------------- shards


def test_shards(spark, docs):
    import zlib

    rows = shard.report(docs).collect()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(text)
    for r in rows:
        draws = [int(hashlib.md5(f"{r.doc_id}/{s}".encode()).hexdigest()[:13], 16) for s in range(41)]
        assert r.shard == max(range(40), key=lambda s: draws[s]) and r.grown_shard == max(range(41), key=lambda s: draws[s])
        assert r["size"] == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_shards_of_odd_rows(spark, odd, tmp_path, monkeypatch):
    rows = shard.report(odd).collect()
    assert len(rows) == len(ODD) and shard.report(empty(spark)).count() == 0
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    same = spark.createDataFrame([(1, "x", "mine")] * 3000 + [(None, "y", "mine")] * 500, "doc_id long, text string, slice string").selectExpr("*", "'mine' AS row", "9 AS slot").repartition(3)
    monkeypatch.setattr(shard, "ROOM", 100)
    slots = shard.number(shard.assign(same, [1.0] * 3), ["doc_id"])
    assert slots.columns == ["doc_id", "text", "slice", "row", "shard", "slot"] and slots.where("slice <> 'mine' OR row <> 'mine'").count() == 0
    assert all(sorted(r.s) == list(range(len(r.s))) for r in slots.groupBy("shard").agg(F.collect_list("slot").alias("s")).collect())
    weighted = shard.assign(spark.range(4000).withColumnRenamed("id", "doc_id"), [1.0, 3.0]).groupBy("shard").count().collect()
    assert abs({r["shard"]: r["count"] for r in weighted}[1] - 3000) < 150
    with pytest.raises(ValueError):
        shard.assign(odd, [1.0, 0.0])
    shard.write_shards(odd, str(tmp_path / "s"), [1.0, 1.0])
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(ODD)


# ---------------------------------------------------------------- language models


def test_lm_scores(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in lmscore.score(docs, labels).collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    words = {r.doc_id: WORD.findall(low(r.text)) for r in docs.collect()}

    def counts(keys):
        uni, bi = Counter(), Counter()
        for k in keys:
            uni.update(words[k])
            uni["^"] += bool(words[k])
            bi.update(zip(["^"] + words[k], words[k]))
        return uni, bi, sum(len(words[k]) for k in keys)

    models = [(counts([k for k in words if k in good]), True), (counts([k for k in words if k not in good]), False)]
    for key, w in words.items():
        own, losses = counts([key]), []
        for (uni, bi, n), side in models:
            mine = (key in good) == side
            total = 0.0
            for p, x in zip(["^"] + w, w):
                u, b, before = (c[i] - mine * o[i] for c, o, i in ((uni, own[0], x), (bi, own[1], (p, x)), (uni, own[0], p)))
                q = (u + lmscore.DELTA) / (n - mine * own[2] + lmscore.DELTA * lmscore.VOCABULARY)
                total -= np.log(lmscore.BIGRAM_WEIGHT * b / before + (1 - lmscore.BIGRAM_WEIGHT) * q if before > 0 else q)
            losses.append(total / max(1, len(w)))
        assert got[key].n_tokens == len(w)
        assert np.allclose([got[key].target_loss, got[key].background_loss, got[key].score], [*losses, losses[1] - losses[0]], atol=1e-9)


def test_lm_scores_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (99, 1, 0), (None, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    got = lmscore.score(odd, labels).collect()
    assert len(got) == len(ODD) and {r.doc_id: r.n_tokens for r in got}[2] == 0
    assert lmscore.score(empty(spark), labels).count() == 0
    assert lmscore.score(odd, labels.where("false")).count() == len(ODD)


def test_lm_scores_of_frequent_keys_are_dealt_and_stay(spark, monkeypatch):
    rows = [(1, f"alpha beta {k % 7}") for k in range(300)] + [(None, f"gamma beta {k % 5}") for k in range(200)] + [(2, "alpha gamma")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    once = lambda: sorted((str(r.doc_id), r.n_tokens, round(r.target_loss, 9), round(r.background_loss, 9)) for r in lmscore.score(docs, labels).collect())
    whole = once()
    monkeypatch.setattr(lmscore, "FREQUENT", 20)
    assert once() == whole and len(whole) == len(rows)


# ---------------------------------------------------------------- BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


@pytest.mark.parametrize("block", [1 << 23, 20000])
def test_bpe_as_the_library(spark, docs, odd, library, block, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", block)
    monkeypatch.setattr(bpe, "SLICE_BYTES", min(block, 1 << 20))
    for frame in (docs, odd):
        got = sorted(tuple(r) for r in bpe.digests(frame.fillna(-1, ["doc_id"]), TOKENIZER).collect())
        want = []
        for r in frame.fillna(-1, ["doc_id"]).collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert got == sorted(want)


def test_bpe_words_of_any_script(library):
    rng = np.random.default_rng(3)
    pieces = [" ", "  ", "\n", "\t", "\r\n", "\x85", "\u00a0", "\u3000", "\u200b", "\x1c", "a", "Z", "é", "9", "²", "ⅷ", "क", "漢", "😀", "\u0301", "'s", "'", "<|endoftext|>", "<|end", "\x00", "\ufffd", ".", "…", "İ", "\u180e", "\u2028"]
    texts = ["".join(rng.choice(pieces, rng.integers(0, 30))) for _ in range(1500)]
    texts += ["ab" * 40000, "".join(rng.choice(list("abcdefghij éß"), 30000)), "x" * 70001]
    vocabulary = bpe.Vocabulary(TOKENIZER)
    words = bpe.Splitter(list(vocabulary.special))
    for text, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert "".join(words(text)) == text and [i for w in words(text) for i in vocabulary.ids(w)] == e.ids


def test_bpe_keeps_columns_and_rejects_unknown_ids(spark, odd):
    coded = bpe.encode(odd.withColumn("ids", odd.doc_id), TOKENIZER)
    assert coded.columns == [*odd.columns, "ids"] and bpe.encode(empty(spark), TOKENIZER).count() == 0
    clash = odd.selectExpr("*", "doc_id AS block", "text AS key", "text AS row", "n_chars AS n", "text AS `a.b`")
    both = bpe.decode(bpe.encode(clash, TOKENIZER, decoded="said"), TOKENIZER)
    assert both.columns == [*clash.columns, "ids", "said", "decoded"] and both.count() == len(ODD)
    assert both.where("said <> coalesce(text, '') OR decoded <> said OR NOT block <=> doc_id OR NOT row <=> text OR NOT `a.b` <=> text").count() == 0
    assert bpe.decode(empty(spark).selectExpr("doc_id", "array(1) AS ids"), TOKENIZER).count() == 0
    bad = spark.createDataFrame([(1, [1, 99999999])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="vocabulary"):
        bpe.decode(bad, TOKENIZER).collect()
    assert bpe.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), TOKENIZER).where("decoded = ''").count() == 2


def shuffled(spark):
    """Bytes that each stage that ran so far has written for later ones."""
    store, sc = spark._jsc.sc().statusStore(), spark.sparkContext
    stages = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    ran = [s for s in map(stages.apply, range(stages.size())) if s.status().toString() == "COMPLETE"]
    return {s.stageId(): s.shuffleWriteBytes() for s in ran}


def test_bpe_shuffles_less_than_the_texts(spark, library, monkeypatch):
    for name in ("BLOCK_BYTES", "BUCKET_BYTES"):
        monkeypatch.setattr(bpe, name, 1 << 20, raising=False)
    rng = np.random.default_rng(9)
    known = np.array(["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(4, 10))) for _ in range(60000)])
    rows = [(k, " ".join(known[rng.zipf(1.3, 600) % len(known)])) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).persist()
    size, before = docs.selectExpr("sum(octet_length(text)) AS n").first().n, set(shuffled(spark))
    got = bpe.digests(docs, TOKENIZER).collect()
    assert sum(n for k, n in shuffled(spark).items() if k not in before) < 0.9 * size  # 1.5 times the input, as tables compress texts
    ids = [x.ids for x in library.encode_batch([t for _, t in rows], add_special_tokens=False)]
    assert sorted((r.doc_id, r.ids_sha256) for r in got) == [(k, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for k, x in enumerate(ids)]
    docs.unpersist()


def test_bpe_decodes_by_the_joined_pieces(spark, library, monkeypatch):
    texts, other = [LONG, "beta  beta", "alpha", "", None, "kappa beta\n beta"], library.encode(" beta", add_special_tokens=False).ids[0]
    table = bpe.Vocabulary.table
    monkeypatch.setattr(bpe.Vocabulary, "table", lambda v, s: table(v, s).withColumn("piece", F.when(F.col("id") == other, F.encode(F.lit("?"), "UTF-8")).otherwise(F.col("piece"))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.said for r in bpe.encode(docs, TOKENIZER, decoded="said").collect()}
    for k, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[k] == "".join("?" if i == other else library.decode([i]) for i in ids)


# ---------------------------------------------------------------- languages


def test_language_on_held_out_rows(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predictions(frame).join(frame.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == frame.count() and got.score.between(0, 1).all()
    held = got[got.held_out]
    assert len(held) > 150 and (held.lang == held.lang_pred).mean() > 0.97


def network():
    """A small network in double precision, and windows that its filters meet."""
    rng = np.random.default_rng(2)
    net = langid.Network(["a", "b", "c"])
    net.taps, net.bias, net.dense, net.out = [t.astype(float) for t in net.taps], rng.normal(0, 0.1, net.bias.shape), net.dense.astype(float), rng.normal(0, 0.1, 3)
    return net, rng.integers(0, 256, (7, langid.WINDOW)).astype(np.uint8), rng.integers(0, 3, 7)


def test_the_network_is_a_convolution_with_pooling():
    net, x, _ = network()
    got = net.prepare().pooled(x)
    for r in range(len(x)):
        want = []
        for w, t in zip(langid.WIDTHS, net.taps):
            want += [max(sum(t[j, x[r, p + j], f] for j in range(w)) for p in range(langid.WINDOW - w + 1)) for f in range(langid.FILTERS)]
        assert np.allclose(got[r], want, atol=1e-5)


def test_gradients_are_those_of_finite_differences():
    net, x, y = network()
    _, grads = net.gradients(x, y)
    rng = np.random.default_rng(3)
    for v, g in zip([*net.taps, net.bias, net.dense, net.out], grads):
        for at in [tuple(k) for k in np.argwhere(g != 0)[rng.permutation(int((g != 0).sum()))[:6]]]:
            old = v[at]
            losses = []
            for step in (1e-6, -1e-6):
                v[at] = old + step
                losses.append(net.gradients(x, y)[0])
            v[at] = old
            assert abs((losses[0] - losses[1]) / 2e-6 - g[at]) < 1e-5


def test_least_score_is_that_of_all_rows(spark, monkeypatch):
    def scored(rows, network):
        return rows.select("*", F.lit("x").alias("lang_pred"), F.regexp_extract("text", r"\d+", 0).cast("double").alias("score"))

    monkeypatch.setattr(langid, "predict", scored)
    rows = spark.range(5000).selectExpr("id AS doc_id", "concat('a', id + 10) AS text", "IF(id = 0, 'y', IF(id = 1, NULL, 'x')) AS lang")
    assert langid.least_score(rows, langid.Network(["x", "y"])) == 6.0


def test_language_by_plain_windows(spark, docs):
    """predict() against the mean over windows, document by document."""
    net = langid.fit(docs, steps=60)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs.limit(40), net).collect()}
    for r in docs.where(docs.doc_id.isin(list(got))).collect():
        raw = low(r.text).encode()
        total = np.zeros(len(net.labels))
        for k in range(0, len(raw), langid.WINDOW):
            one = np.frombuffer(raw[k : k + langid.WINDOW].ljust(langid.WINDOW, b"\0"), np.uint8)[None]
            total += net.prepare().probabilities(one)[0] * len(raw[k : k + langid.WINDOW])
        assert got[r.doc_id][0] == net.labels[total.argmax()] and abs(got[r.doc_id][1] - total.max() / len(raw)) < 1e-5


def test_the_sample_has_a_bound_however_rows_repeat(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid.Network, "train", lambda self, rows, labels, steps: seen.append(np.bincount(labels)) or self)
    rows = [(None, "the same text of everyone", "en")] * 3000 + [(7, f"another text {k}", "en") for k in range(3000)] + [(k, f"ein text {k}", "de") for k in range(50)]
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), docs_each=20)
    assert (seen[0] <= 20 * langid.SAMPLE_WINDOWS).all() and seen[0].min() > 5


def test_language_of_odd_rows(spark, odd):
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in langid.predict(odd, langid.fit(odd, steps=20)).collect()}
    assert got[(2, None)] == got[(3, "")] == got[(8, "123 456 !!! ...")] == ("und", 0.0)
    assert got[(1, LONG)][0] in {"en", "fr", "de"}
    nothing = langid.fit(odd.where("lang = 'xx'"))
    assert {r.lang_pred for r in langid.predict(odd, nothing).collect()} == {"und"}
    assert langid.predictions(empty(spark)).count() == 0
    assert {r.held_out for r in langid.predictions(odd).where("doc_id IS NULL").collect()} == {False}
    assert langid.predict(odd.withColumn("score", odd.n_chars), nothing).columns == [*odd.columns, "lang_pred", "score"]


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, sf, library):
    import corpus_pipeline

    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    near = brute_near([(r[0], r[1]) for r in docs])
    docs = sorted(r for r in docs if near[r[0]] == r[0])
    seen, cut = set(), []
    for r in docs:
        w = re.findall("[^\x20\x09-\x0d]+", r[1])
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(key)
        if not any(gone):
            cut.append(r)
        elif not all(gone):
            text = " ".join(x for x, g in zip(w, gone) if not g)
            cut.append((r[0], text, r[2], r[3], len(text)))
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = {h[0] for h in brute_hits([(r[0], r[1]) for r in cut], bench) if h[-1]}
    want = sorted((r[0], *r[2:], library.encode(r[1], add_special_tokens=False).ids) for r in cut if r[0] not in hit)
    got = corpus_pipeline.run(spark, sf)
    assert sorted((r.doc_id, r.lang, r.source, r.n_chars, list(r.ids)) for r in got.collect()) == want
    assert got.where("NOT round_trip OR n_tokens <> size(ids)").count() == 0 and len(want) < len(rows)


def test_stages_keep_any_columns_and_take_odd_tables(spark, sf, odd):
    import corpus_pipeline

    mine = odd.selectExpr("*", "'mine' AS kept", "'mine' AS n_words", "'mine' AS ids", "'mine' AS row", "'mine' AS score", "'mine' AS items", "'mine' AS v")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, mine, sf)
        assert out.columns == mine.columns and 0 < out.count() <= len(ODD), name
        assert out.where(" OR ".join(f"{c} <> 'mine'" for c in ("kept", "n_words", "ids", "row", "score", "items", "v"))).count() == 0, name
        assert stage(spark, mine.where("false"), sf).count() == 0, name
    out = corpus_pipeline.tokens(spark, mine, sf)
    assert out.columns.count("ids") == 1 and out.count() == len(ODD) and out.where("NOT round_trip OR v <> 'mine'").count() == 0
    assert corpus_pipeline.tokens(spark, mine.where("false"), sf).count() == 0


def test_every_query_is_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 11))

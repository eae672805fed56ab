"""Operators on URLs, vectors and conversations."""

import numpy as np
import pytest

from conftest import same
from tallyworks.llm import chat, embed, shared, urlfilter


# ---------------------------------------------------------------- URL rules


def brute_rule(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = []
    for rule, verdict in rules:
        h, p = rule.split("/", 1)
        h = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in h)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((-len(h), -len(p), rule, verdict))
    best = min(fits) if fits else (0, 0, None, "allow")
    return (host, path, best[2], best[3])


URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.org", "http://example.org/", "https://a.b.example.org/es/x?y=/en/1", "http://example.org/es", "http://xexample.org/es/",
    "http://example.org/en/12#f", "http://example.org/en/2", "http://org/x", "http://com/de/", "http://q.com/de/a", "http://q.com/fr/", "http://q.com:80/de/", "http://é.com/de/漢", "a://b://c.com/de/",
    "http://a.com?x=/de/", "http://a.com#/de/", "http://.org/", "http://a..org/", "x://q.net/",
    "http://example,foo.org/es/x", "http://foo,example.org/es/x", "http://example.org,/es/x", "http://\U0001f600.example.org/es/x", "http://\uffff\U0010ffff.example.org/es/x", "http://\x01.example.org/es/",
    "http://user@example.org/es/", "http://example.org.:80/es/", "http://nested.org/a/b/c", "http://nested.org/a/bb", "http://nested.org/a/", "http://x.nested.org/a/b", "http://long.org/es/" + "x" * 70000,
]


def test_rules(spark):
    more = urlfilter.RULES + [("net/", "block"), ("a.b.example.org/es/x", "allow"), ("q.com/de/a", "allow"), ("q.com/d", "block"), ("nothing", "block"), (None, "block"), ("nested.org/", "block"), ("nested.org/a/b", "allow"), ("nested.org/a/b/", "block"), ("NESTED.org/a/", "allow"), ("nested.org/a/", "block")]
    rules = spark.createDataFrame(more, "rule string, verdict string")
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(URLS * 3)], "page_id long, url string").repartition(5)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, rules).collect()}
    assert got == {k: brute_rule(u, [r for r in more if r[0] and "/" in r[0]]) for k, u in enumerate(URLS * 3)}


def test_rules_with_odd_tables(spark):
    rules = spark.createDataFrame(urlfilter.RULES, "rule string, verdict string")
    hot = spark.createDataFrame([(k, "http://h.org/es/" if k % 3 else f"http://h{k}.com/de/{k}", "kept", "old") for k in range(3000)], "page_id long, url string, note string, verdict string")
    got = urlfilter.judge(hot, rules, default="none")
    assert got.columns == ["page_id", "url", "note", "host", "path", "rule", "verdict"]
    assert {(r.rule, r.verdict, r["count"]) for r in got.groupBy("rule", "verdict").count().collect()} == {("org/", "allow", 2000), ("com/de/", "block", 1000)}
    assert urlfilter.judge(hot.where("false"), rules).count() == 0
    assert urlfilter.judge(hot, rules.where("false")).where("rule IS NULL AND verdict = 'allow'").count() == 3000
    tie = spark.createDataFrame([("h.org/", "block"), ("h.org/", "allow")], "rule string, verdict string")
    assert {r.verdict for r in urlfilter.judge(hot.where("page_id % 3 > 0"), tie).collect()} == {"allow"}


def test_rules_of_a_host_with_many_names_and_paths(spark):
    """Subdomains beyond the basic plane and a blocklist of one domain; names that a caller may use stay."""
    many = [(f"example.org/p{k}/", "block") for k in range(3000)] + urlfilter.RULES
    rows = [(k, f"http://\U0001f600{k:05d}.example.org/es/x") for k in range(1500)] + [(k, f"http://h{k}.example.org/p{k}/x") for k in range(1500, 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'mine' AS key", "'mine' AS cell", "'mine' AS row", "1 AS kind", "'mine' AS `a.b`").repartition(4)
    got = urlfilter.judge(pages, spark.createDataFrame(many, "rule string, verdict string"))
    assert got.columns == [*pages.columns, "host", "path", "rule", "verdict"] and got.where("key <> 'mine' OR cell <> 'mine' OR row <> 'mine' OR kind <> 1").count() == 0
    assert {r.page_id: r.rule for r in got.collect()} == {k: "example.org/es/" if k < 1500 else f"example.org/p{k}/" for k, _ in rows}


def test_rules_oracle(spark, duck, sf):
    same(urlfilter.report(spark.read.parquet(f"{sf}/pages.parquet")).toPandas(), duck.execute(urlfilter.SQL).df())


# ---------------------------------------------------------------- vectors


def brute_links(rows, threshold=0.93):
    n = len(rows)
    linked = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i + 1, n):
            (_, a, x), (_, b, y) = rows[i], rows[j]
            if x is None or x != y or not usable(a) or not usable(b) or len(a) != len(b):
                continue
            u, v = np.array(a, float), np.array(b, float)
            if u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= threshold:
                linked[i].append(j)
                linked[j].append(i)
    root = list(range(n))
    for _ in range(n):
        new = [min([root[i], *(root[j] for j in linked[i])]) for i in range(n)]
        if new == root:
            break
        root = new
    return sorted((rows[i][0], len(linked[i]), min(rows[j][0] for j in range(n) if root[j] == root[i])) for i in range(n))


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("block", [1024, 5])
def test_vectors(spark, block):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(12):
        centre = rng.normal(size=24)
        for _ in range(12):
            rows.append((len(rows), [float(np.float32(x)) for x in centre + rng.normal(size=24) * rng.choice([0.0, 0.1, 0.25])], int(c % 3)))
    one = [1.0] + [0.0] * 23
    rows += [(500, None, 1), (501, [], 1), (502, [0.0] * 24, 1), (503, one[:-1] + [None], 1), (504, one[:-1] + [float("nan")], 1), (505, one[:-1] + [float("inf")], 1), (506, one, None), (507, one, 1), (508, one, 1), (509, one, 2), (510, [1.0], 1), (511, [3.0], 1), (512, [-3.0], 1), (513, [2.0] + [0.0] * 23, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    old, embed.BLOCK = embed.BLOCK, block
    try:
        got = embed.report(frame).collect()
    finally:
        embed.BLOCK = old
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute_links(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    a, b = embed.codes(x), embed.codes(0.931 * x + np.sqrt(1 - 0.931**2) * z)
    met = ((a[:, :, :1] == b) | (b[:, :, :1] == a)).any((1, 2))
    assert met.mean() > 0.98


def test_vectors_of_empty_and_repeated_rows(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in embed.report(frame).collect()) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert embed.report(frame.where("false")).count() == 0


def test_vectors_of_doubles_and_integer_keys(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.1], "a"), (3, [0.0, 1.0], "a"), (4, [1.0, 0.0], "b")], "vec_id int, embedding array<double>, label string")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in embed.report(frame).collect()) == [(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4)]


def test_vectors_that_repeat_a_key_or_lack_one(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.01], 1), (2, [1.0, 0.02], 1), (None, [1.0, 0.03], 1), (None, [0.0, 1.0], 1), (None, [0.0, 1.0], 1), (None, None, 1), (3, [-1.0, 0.0], 1)]
    got = embed.report(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    want = [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (None, 3, 1, False), (None, 1, None, True), (None, 1, None, True), (None, 0, None, True), (3, 0, 3, True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_vectors_oracle(spark):
    import duckdb

    rng = np.random.default_rng(9)
    centres = rng.normal(size=(25, 32))
    rows = [(k, [float(np.float32(x)) for x in centres[k % 25] + rng.normal(size=32) * rng.choice([0.0, 0.1, 0.2, 0.28])], int(rng.integers(0, 3))) for k in range(600)]
    rows += [(700, None, 1), (701, [0.0] * 32, 1), (702, [1.0] + [float("nan")] * 31, 1), (703, [1.0] * 32, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    con = duckdb.connect()
    con.register("embeddings", frame.toArrow())
    want = con.execute(embed.SQL).df()
    assert (want.n_links > 3).sum() > 50
    same(embed.report(frame).toPandas(), want)


def test_vectors_of_very_small_and_large_components(spark):
    import duckdb

    rows = [(1, [1e-200, 0.0], 1), (2, [0.0, 1e-200], 1), (3, [0.0, 1.0], 1), (4, [1e200, 1e199], 1), (5, [1.0, 0.1], 1), (6, [5e-324, 0.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    con = duckdb.connect()
    con.register("embeddings", frame.toArrow())
    got = embed.report(frame).toPandas()
    same(got, con.execute(embed.SQL).df())
    assert sorted(zip(got.vec_id, got.n_links, got.component_id)) == [(1, 3, 1), (2, 1, 2), (3, 1, 2), (4, 3, 1), (5, 3, 1), (6, 3, 1)]


def test_no_table_between_stages_stays(spark):
    import os

    shared.settle(spark.range(3))
    folder = shared.settled_dir(spark)
    assert os.listdir(folder)
    shared.clear(spark)
    assert not os.path.exists(folder)


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 5000)]
    got = {r.node: r.component for r in shared.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    assert got == {n: r for n, r in root.items() if n != 5000}


# ---------------------------------------------------------------- conversations


CHAT = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 2, "assistant", "</s><|user|>&lt; & | \\ [INST]"), (1, 0, "system", "be brief"), (1, 1, "user", "hi <|assistant|>"), (1, 3, "user", None), (1, 4, "assistant", ""),
    (2, 0, "user", "only"), (3, 0, "system", "alone"), (4, 1, "assistant", "first"), (4, 1, "assistant", "first"), (4, 1, None, "x"), (None, None, "user", "lost"), (None, 1, "assistant", "found"), (5, 0, "we|ird</s>", "r"),
    *[(6, k, "assistant" if k % 2 else "user", f"turn {k} " + "word " * 40) for k in range(9)], (7, 0, "user", "long " * 3000), (7, 1, "assistant", "answer " * 3000), (7, 2, "user", "ok"), (7, 3, "assistant", "bye"),
]


def turns_of(rows):
    out = {}
    for c, t, r, x in rows:
        out.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    return {c: [(r, x) for _, r, x in sorted(v)] for c, v in out.items()}


def test_conversations_read_back(spark):
    frame = spark.createDataFrame(ROWS, CHAT).repartition(4)
    back = {r.conv_id: ([(t.role, t.text) for t in r.turns], r.loss_text) for r in chat.read_back(chat.windows(frame)).collect()}
    want = turns_of(ROWS)
    assert back == {c: (t, "".join(x for r, x in t if r == "assistant")) for c, t in want.items()}


def test_windows_keep_budget_history_and_system(spark):
    frame = spark.createDataFrame(ROWS + [(8, 0, "system", "rules"), *[(8, k, "assistant" if k % 2 else "user", "w " * 30) for k in range(1, 12)]], CHAT)
    rows = chat.windows(frame, budget=120, history=50).collect()
    for r in rows:
        shown = r.text.count(chat.END)
        assert r.tokens <= 120 or shown - r.n_context == 1
        assert all(r.text[s.start : s.start + s.length] and chat.END not in r.text[s.start : s.start + s.length] for s in r.loss if s.length)
    eight = sorted((r for r in rows if r.conv_id == 8), key=lambda r: r.window)
    assert len(eight) > 3 and all(r.text.startswith("<|system|>rules</s>") for r in eight) and all(r.n_context == 2 for r in eight[1:])
    assert sum(len(r.loss) for r in eight) == 6


def test_a_long_conversation_takes_linear_work(spark):
    import time

    def seconds(n):
        rows = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "repeat('some words ', 10) AS text")
        began = time.time()
        got = chat.report(rows).where("conv_id = 1").first()
        assert got.n_turns == n and got.loss_chars == n // 2 * 110
        return time.time() - began

    seconds(100)
    assert seconds(16000) < 4 * seconds(4000) + 4


def test_chat_oracle(spark, duck, sf):
    same(chat.report(spark.read.parquet(f"{sf}/conversations.parquet")).toPandas(), duck.execute(chat.SQL).df())


def test_chat_of_an_empty_table_has_the_added_conversation(spark):
    got = chat.report(spark.createDataFrame([], CHAT)).collect()
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in got] == [(-1, 2, len("</s>[INST] ok [/INST]"))]
    extra = spark.createDataFrame([(1, 0, "user", "a", "b")], CHAT + ", window string")
    assert chat.windows(extra).columns == ["conv_id", "window", "n_turns", "n_context", "tokens", "text", "loss"]

"""URL rules as a sort-merge range join over reversed hosts.

A host's labels reversed and each ended with a dot (``org.example.``) turn "this host and
all its subdomains" into an interval of keys: no label holds a dot, so the keys that begin
with a rule's are its host and subdomains, and end before the key whose last dot is raised
by one. Intervals of rules are nested or apart. Pages and rules are dealt into ranges of
keys, sorted, and swept once: a stack holds the hosts whose interval is open at the current
host, each with its rules in the order of their paths, and each rule with the one that
encloses it; the rule of a path is the last one before it or one that encloses that.

Ranges come from a sample of hosts whose expected size is bounded; it balances the work and
decides nothing else. A range of one frequent host gets several cells, and pages are dealt
over them by a hash of the row; a rule goes to every cell that its interval meets. Sweeping
reads batches in order and keeps the rules of open hosts only.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import boxed, column, unit_count

#: Hosts sampled for each cell, to balance cells only.
SAMPLE_EACH = 32
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + 4)
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + 4)
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def key_of(host: Column) -> Column:
    """Labels from the top domain down, each followed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def end_of(key: Column) -> Column:
    """Above every key that begins with this one, and below all others that follow it: "/" comes next to "."."""
    return F.concat(F.substr(key, F.lit(1), F.length(key) - 1), F.lit("/"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to every page.

    ``rules`` has (rule, verdict); a rule is ``host/path prefix`` and fits its host and all
    subdomains where the path starts with the rule's. The longest host wins, then the
    longest path, then the first rule and verdict in order. Without a fitting rule: no rule and
    ``default``. A null URL, or one without ``://``, has an empty host and path; URLs count
    whole, whatever their length and characters. Rules that are null or lack ``/`` are left
    out. Repeated rows are judged alike, an empty table gives an empty result. Former
    columns of the four new names are replaced, all others stay.
    """
    spark = pages.sparkSession
    new = ("host", "path", "rule", "verdict")
    whole = [column(f.name) for f in pages.schema.fields if "map<" not in f.dataType.simpleString()]  # a frequent URL is dealt out too
    rows = boxed(pages, new, url=F.coalesce(column(url), F.lit("")), salt=F.xxhash64(*whole))
    rows = rows.select("row", "salt", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("key", key_of(F.col("host")))
    cells = unit_count(spark)
    share = min(1.0, SAMPLE_EACH * cells / max(1, pages.count()))
    sample = [r[0] for r in rows.select("key").sample(share, seed=17).collect()]
    bounds, shares = _ranges(sorted(sample), cells)
    first = np.cumsum([0, *shares])
    starts, counts = F.array(*[F.lit(int(x)) for x in first[:-1]]), F.array(*[F.lit(int(x)) for x in shares])
    at = _range_of(F.col("key"), bounds)
    dealt = rows.withColumn("cell", F.get(starts, at) + F.pmod("salt", F.get(counts, at)).cast("int")).drop("salt")
    clean = rules.where(F.instr("rule", "/") > 0).select("rule", "verdict", F.translate(F.substring_index("rule", "/", 1), UPPER, LOWER).alias("host"), F.substr("rule", F.instr("rule", "/")).alias("path")).distinct()
    clean = clean.withColumn("key", key_of(F.col("host")))
    low, high = _range_of(F.col("key"), bounds), _range_of(end_of(F.col("key")), bounds)
    reach = clean.withColumn("cell", F.explode(F.sequence(F.get(starts, low), F.get(starts, high) + F.get(counts, high) - 1)))
    union = dealt.withColumn("kind", F.lit(1)).unionByName(reach.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    work = union.repartition(len(first) * 2, "cell").sortWithinPartitions("cell", "key", "kind", "path", "rule", "verdict")
    schema = T.StructType([rows.schema["row"], *[T.StructField(n, T.StringType()) for n in new]])
    return work.mapInArrow(_sweep(default), schema).select("row.*", *new)


def _range_of(key: Column, bounds: list[str]) -> Column:
    """How many of the sorted ``bounds`` are at most ``key``: first among every step-th bound, then in between."""
    if not bounds:
        return F.lit(0)
    step = int(np.ceil(np.sqrt(len(bounds))))
    runs = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    outer, inner = (F.from_json(F.lit(json.dumps(x)), kind) for x, kind in (([r[0] for r in runs], "array<string>"), ([[], *runs], "array<array<string>>")))
    run = F.size(F.filter(outer, lambda b: b <= key))
    return (F.greatest(run - 1, F.lit(0)) * step + F.size(F.filter(F.get(inner, run), lambda b: b <= key))).cast("int")


def _ranges(sample: list[str], cells: int) -> tuple[list[str], list[int]]:
    """Bounds between ranges, and how many cells each range has by its share of the sample."""
    bounds: list[str] = []
    step = max(1, len(sample) // cells)
    for k in range(step, len(sample), step):
        if not bounds or sample[k] > bounds[-1]:
            bounds.append(sample[k])
    sizes = np.bincount([bisect_right(bounds, s) for s in sample], minlength=len(bounds) + 1)
    return bounds, [max(1, round(n / step)) for n in sizes]


class _Host:
    """The rules of one open host by path; of rules with one path the first stands."""

    def __init__(self, key: str):
        self.key, self.paths, self.around, self.said = key, [], [], []

    def add(self, path: str, rule: str, verdict: str) -> None:
        if self.paths and self.paths[-1] == path:
            return
        k = self._enclosing(path, len(self.paths) - 1)
        self.paths.append(path)
        self.around.append(k)
        self.said.append((rule, verdict))

    def _enclosing(self, path: str, k: int) -> int:
        while k >= 0 and not path.startswith(self.paths[k]):
            k = self.around[k]
        return k

    def find(self, path: str) -> tuple[str, str] | None:
        """The rule with the longest path that ``path`` starts with: it encloses the last rule at or before ``path``."""
        k = self._enclosing(path, bisect_right(self.paths, path) - 1)
        return self.said[k] if k >= 0 else None


def _sweep(default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, key = None, None
        stack: list[_Host] = []  # open hosts, the longest on top
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            pages, found = [], []
            cols = (col[c].to_pylist() for c in ("cell", "key", "kind", "path", "rule", "verdict"))
            for row, (c, h, kind, path, rule, verdict) in enumerate(zip(*cols)):
                if c != cell or h != key:
                    stack = stack if c == cell else []
                    cell, key = c, h
                    while stack and not h.startswith(stack[-1].key):
                        stack.pop()
                if kind == 0:
                    if not stack or stack[-1].key != h:
                        stack.append(_Host(h))
                    stack[-1].add(path, rule, verdict)
                else:
                    pages.append(row)
                    found.append(next((x for host in reversed(stack) if (x := host.find(path)) is not None), (None, default)))
            take = pa.array(pages, pa.int64())
            rules, said = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([*[col[n].take(take) for n in ("row", "host", "path")], pa.array(rules, pa.string()), pa.array(said, pa.string())], names=["row", "host", "path", "rule", "verdict"])

    return run


def report(pages: DataFrame) -> DataFrame:
    rules = pages.sparkSession.createDataFrame(RULES, "rule string, verdict string")
    return judge(pages.select("page_id", "url"), rules).drop("url")


_AFTER = "CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
SQL = f"""
WITH p AS (SELECT page_id, coalesce({_AFTER}, '') AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(h, f, rule, verdict) AS (VALUES {', '.join(f"('{r[: r.index('/')]}', '{r[r.index('/') :]}', '{r}', '{v}')" for r, v in RULES)}),
m AS (SELECT page_id, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h) DESC, length(f) DESC) AS n
  FROM q JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, f))
SELECT q.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM q LEFT JOIN m ON q.page_id = m.page_id AND n = 1
"""

"""Findings: identity, idempotent storage, ranks and summaries.

A finding has member_id, anomaly_type, severity, title, description, filing_id, txn_id,
computed_value and threshold_value; a stored one also p_value, q_value and detected_at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import DISABLED
from ..functions.predicates import may_have_travel
from ..functions.wording import plain_title

TITLE = 200


def identity() -> Column:
    """What makes two findings one: the transaction if there is one, else the title's first 200 characters."""
    by_txn = F.col("txn_id").isNotNull()
    return F.struct(F.col("member_id").alias("m"), F.col("anomaly_type").alias("t"), by_txn.alias("k"), F.when(by_txn, F.col("txn_id").cast("string")).otherwise(F.substring("title", 1, TITLE)).alias("v"))


def persist(new: DataFrame, stored: DataFrame, order: list[str], disabled: list[str] = DISABLED) -> DataFrame:
    """Rows of ``new`` to insert: enabled, with member and type, not stored, the first of each identity by ``order``."""
    rows = new.where(F.col("member_id").isNotNull() & F.col("anomaly_type").isNotNull() & ~F.col("anomaly_type").isin(disabled)).withColumn("__id", identity())
    first = F.row_number().over(Window.partitionBy("__id").orderBy(*order))
    rows = rows.withColumn("__n", first).where("__n = 1").drop("__n")
    known = stored.select(identity().alias("__id")).distinct()
    out = rows.join(known, rows["__id"] == known["__id"], "left_anti").drop("__id")
    return out.withColumn("title", F.substring(F.coalesce("title", plain_title(F.col("anomaly_type"))), 1, TITLE)).withColumn("description", F.coalesce("description", "title"))


def restate(stored: DataFrame, derived: DataFrame, columns: list[str]) -> DataFrame:
    """Stored findings with ``columns`` taken from the derived finding of the same identity, if there is one."""
    fresh = derived.withColumn("__id", identity()).groupBy("__id").agg(*[F.min(F.struct(*columns)).alias("__new")])
    s = stored.withColumn("__id", identity())
    j = s.join(fresh, "__id", "left")
    return j.select(*[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(s[c]).alias(c) if c in columns else s[c] for c in stored.columns])


def retract(stored: DataFrame, derived: DataFrame, covered: list[str], disabled: list[str] = DISABLED) -> DataFrame:
    """Stored findings without those of covered, enabled types that are no longer derived; all stay if nothing was derived."""
    known = derived.select(identity().alias("__id")).distinct()
    some = derived.agg((F.count("*") > 0).alias("__some"))
    s = stored.withColumn("__id", identity())
    marked = s.join(known.withColumn("__hit", F.lit(True)), "__id", "left").crossJoin(F.broadcast(some))
    keep = ~F.col("__some") | ~F.col("anomaly_type").isin(covered) | F.col("anomaly_type").isin(disabled) | F.col("__hit").eqNullSafe(F.lit(True))
    return marked.where(keep).select(*stored.columns)


def without_needles(stored: DataFrame, needles: DataFrame) -> DataFrame:
    """Findings whose named field holds no needle of their type; ``needles`` has (anomaly_type, field, needle), a fixed short list."""
    n = needles.select(F.col("anomaly_type").alias("__t"), F.col("field").alias("__f"), F.lower("needle").alias("__s"))
    field = F.when(F.col("__f") == "title", F.col("title")).otherwise(F.col("description"))
    return stored.join(n, (F.col("anomaly_type") == F.col("__t")) & F.contains(F.lower(field), F.col("__s")), "left_anti")


def without_boundary(stored: DataFrame) -> DataFrame:
    """Findings whose value is not exactly the threshold."""
    return stored.where(~(F.col("computed_value") == F.col("threshold_value")) | F.col("computed_value").isNull() | F.col("threshold_value").isNull())


def fold_upsert(stored: DataFrame, payloads: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows after payloads in arrival order; a null in a payload never overwrites a stored value."""
    cols = [c for c in stored.columns if c not in keys]
    last = payloads.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"__{c}") for c in cols])
    return stored.join(last, keys, "full").select(*keys, *[F.coalesce(f"__{c}", c).alias(c) for c in cols])


def insert_new(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Incoming rows whose key is not stored, the first of each key by ``order``; rows without a key never match and all go in."""
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    keyed = incoming.where(whole).withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
    return keyed.join(stored.select(*keys).distinct(), keys, "left_anti").select(*incoming.columns).unionByName(incoming.where(~whole))


def replace_by_key(old: DataFrame, read: DataFrame, key: str) -> DataFrame:
    """Old rows of keys that the new read has nothing for, and all new rows."""
    return old.join(read.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(read.select(*old.columns))


def member_counts(members: DataFrame, findings: DataFrame, filings: DataFrame) -> DataFrame:
    """Members with the numbers of their findings and filings, 0 where there are none."""
    f = findings.groupBy("member_id").agg(F.count("*").alias("anomaly_count"))
    d = filings.groupBy("member_id").agg(F.count("*").alias("disclosure_count"))
    out = members.drop("anomaly_count", "disclosure_count").join(f, "member_id", "left").join(d, "member_id", "left")
    return out.na.fill(0, ["anomaly_count", "disclosure_count"])


def percentile_ranks(findings: DataFrame, least: int = 10) -> DataFrame:
    """Adds the share (percent) of values of its type that are at most its own; types below ``least`` have none.

    Ranked findings are graded anew: 90 and above high, 50 and above medium, else low.
    Ranks come from counts of distinct values, so a type's rows are summed before they meet.
    """
    values = findings.where("computed_value IS NOT NULL").groupBy("anomaly_type", "computed_value").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("anomaly_type").orderBy("computed_value"))
    n = F.sum("c").over(Window.partitionBy("anomaly_type"))
    ranks = values.withColumn("n", n).withColumn("upto", upto).where(F.col("n") >= least).select("anomaly_type", "computed_value", F.bround(F.col("upto") * 100.0 / F.col("n"), 2).alias("percentile_rank"))
    out = findings.drop("percentile_rank").join(ranks, ["anomaly_type", "computed_value"], "left")
    r = F.col("percentile_rank")
    return out.withColumn("severity", F.when(r >= 90, "high").when(r >= 50, "medium").when(r.isNotNull(), "low").otherwise(F.col("severity")))


#: Ranges of [0, 1] that p-values are ranked in.
RANGES = 4096


def bh_qvalues(tests: DataFrame, p: str = "p_value", key: str = "test_id") -> DataFrame:
    """Benjamini-Hochberg q-values over all tests with a p-value (from 0 to 1).

    Equal p-values share the largest rank, so ranks are running counts of distinct values.
    Values are counted and ranked within ranges; only one row a range meets in one task, to
    carry the counts up and the running minimum down.
    """
    values = tests.where(F.col(p).isNotNull()).groupBy(p).agg(F.count("*").alias("c")).withColumn("range", F.floor(F.col(p) * RANGES).cast("int"))
    within = Window.partitionBy("range")
    values = values.withColumn("upto", F.sum("c").over(within.orderBy(p)))
    counts = values.groupBy("range").agg(F.sum("c").alias("size"))
    ahead = counts.select("range", (F.sum("size").over(Window.orderBy("range")) - F.col("size")).alias("ahead"), F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    raw = values.join(F.broadcast(ahead), "range").withColumn("raw", F.col(p) * F.col("n") / (F.col("ahead") + F.col("upto")))
    lows = raw.groupBy("range").agg(F.min("raw").alias("low"))
    later = lows.select("range", F.min("low").over(Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)).alias("later"))
    here = F.min("raw").over(within.orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0))
    q = raw.join(F.broadcast(later), "range").select(p, F.least(F.lit(1.0), here, "later").alias("q_value"))
    return tests.join(q, p, "left").select(*tests.columns, "q_value")


def detection_summary(findings: DataFrame, members: DataFrame) -> DataFrame:
    """Per type: findings, distinct members, and members per hundred of all."""
    all_ = members.agg(F.count("*").alias("all"))
    out = findings.groupBy("anomaly_type").agg(F.count("*").alias("findings"), F.countDistinct("member_id").alias("members"))
    return out.crossJoin(F.broadcast(all_)).withColumn("flag_rate", F.try_divide("members", "all") * 100).drop("all")


def significance_summary(findings: DataFrame, alpha: float = 0.05) -> DataFrame:
    q = F.col("q_value")
    out = findings.agg(F.count(q).alias("tested"), F.count_if(q <= alpha).alias("passing"), F.count_if(q.isNull()).alias("untested"))
    return out.withColumn("expected_false", F.col("passing") * alpha)


def anomaly_summary(findings: DataFrame, members: DataFrame) -> DataFrame:
    """(dimension, value, n) by type, severity, party and chamber, in one pass with grouping sets."""
    by = [F.col(c) for c in ("anomaly_type", "severity", "party", "chamber")]
    rows = findings.join(members.select("member_id", "party", "chamber"), "member_id")
    out = rows.groupingSets([[c] for c in by], *by).agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    g = F.col("g")
    kind = F.when(g == 0b0111, "type").when(g == 0b1011, "severity").when(g == 0b1101, "party").otherwise("chamber")
    value = F.when(g == 0b0111, F.col("anomaly_type")).when(g == 0b1011, F.col("severity")).when(g == 0b1101, F.col("party")).otherwise(F.col("chamber"))
    return out.select(kind.alias("dimension"), value.alias("value"), "n")


def parse_quality(filings: DataFrame, travel: DataFrame, members: DataFrame) -> DataFrame:
    """One row: how well filings were read, and how much travel the annual reports gave.

    The mean is over all scored filings. ``nothing`` counts filings read without a row though
    they have, or may have, a text layer. ``travel`` has filing_id, ``members`` member_id and chamber.
    """
    score = F.col("confidence")
    out = filings.agg(
        F.count_if("parsed").alias("parsed"),
        (F.count_if("parsed") - F.count(score)).alias("never_scored"),
        F.bround(F.avg(score), 3).alias("mean_confidence"),
        F.count_if(score < 0.8).alias("poor"),
        F.count_if((score == 0) & F.coalesce("has_text_layer", F.lit(True))).alias("nothing"),
        F.count_if(~F.col("has_text_layer")).alias("scanned"),
    )
    trips = travel.agg(F.count("*").alias("travel_rows"), F.countDistinct("filing_id").alias("filings_with_travel"))
    annual = filings.where(may_have_travel(F.col("filing_type"), F.lit("house"), F.col("parsed"), F.col("is_ptr")))
    house = annual.join(members.where("chamber = 'house'").select("member_id").distinct(), "member_id", "left_semi").agg(F.count("*").alias("house_annuals"))
    return out.crossJoin(trips).crossJoin(house)

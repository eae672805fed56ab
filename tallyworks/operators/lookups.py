"""Lookups by prefix, by name, and by tiers of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import company_key, fold_name, given_names_agree, surname_keys


def prefixes(text: Column) -> Column:
    """All prefixes of a text, shortest first."""
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), lambda n: F.substr(text, F.lit(1), n))).otherwise(F.array().cast("array<string>"))


def longest_prefix(rows: DataFrame, table: DataFrame, code: str, prefix: str, least: int = 1) -> DataFrame:
    """Rows with the columns of the table row whose prefix is the longest that begins the code; others keep nulls.

    Distinct codes are exploded into their prefixes and joined on equality, so neither side is
    broadcast or compared pairwise; the hint says so, as a file of codes looks small before its
    prefixes are made. Of table rows with one prefix all are kept.
    """
    codes = rows.select(F.trim(F.col(code).cast("string")).alias("__code")).where("__code IS NOT NULL").distinct()
    found = codes.withColumn("__p", F.explode(F.filter(prefixes(F.col("__code")), lambda p: F.length(p) >= least))).join(table.withColumnRenamed(prefix, "__p").hint("shuffle_hash"), "__p")
    longest = F.max(F.length("__p")).over(Window.partitionBy("__code"))
    best = found.withColumn("__l", longest).where(F.length("__p") == F.col("__l")).drop("__p", "__l")
    return rows.join(best, F.trim(rows[code].cast("string")) == best["__code"], "left").drop("__code")


def word_prefixes(key: Column) -> Column:
    """Prefixes of whole words."""
    words = F.split(key, " ")
    return F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))


def resolve_companies(names: DataFrame, register: DataFrame, name: str = "name", least_words: int = 2, overrides: DataFrame | None = None, political: bool = False) -> DataFrame:
    """(name, ticker) for distinct names; a null ticker means none was found.

    Order: an override fragment inside the key (an empty ticker stops), the exact key, then
    the longest registered key that begins the name's key or is begun by it at a word's end,
    with at least ``least_words`` words in the shorter. ``register`` has (position, title,
    ticker); the first position wins among equal keys and lengths.
    """
    asked = names.select(F.col(name).alias("name")).distinct().withColumn("key", company_key(F.col("name"), political)).where("key != ''")
    first = Window.partitionBy("key").orderBy("position")
    known = register.withColumn("key", company_key(F.col("title"))).where("key != ''").withColumn("n", F.row_number().over(first)).where("n = 1").select("key", "ticker", "position")
    exact = asked.join(known, "key").select("name", "ticker", F.lit(1).alias("tier"), F.length("key").alias("size"), "position")
    pre = asked.withColumn("p", F.explode(word_prefixes(F.col("key")))).where((F.size(F.split("p", " ")) >= least_words) & (F.col("p") != F.col("key")))
    inside = pre.join(known.withColumnRenamed("key", "p"), "p").select("name", "ticker", F.lit(2).alias("tier"), F.length("p").alias("size"), "position")
    longer = known.withColumn("p", F.explode(word_prefixes(F.col("key")))).where(F.col("p") != F.col("key"))
    around = asked.where(F.size(F.split("key", " ")) >= least_words).join(longer.select("p", "ticker", "position", F.col("key").alias("k")), F.col("key") == F.col("p")).select("name", "ticker", F.lit(2).alias("tier"), F.length("k").alias("size"), "position")
    found = exact.unionByName(inside).unionByName(around)
    if overrides is not None:  # a short fixed list of (position, fragment, ticker)
        o = F.broadcast(overrides.select("fragment", F.col("ticker").alias("t"), F.col("position").alias("o")))
        found = found.unionByName(asked.join(o, F.contains(F.col("key"), F.col("fragment"))).select("name", F.col("t").alias("ticker"), F.lit(0).alias("tier"), F.lit(0).alias("size"), F.col("o").alias("position")))
    best = found.groupBy("name").agg(F.min_by("ticker", F.struct("tier", -F.col("size"), "position")).alias("ticker"))
    return names.select(F.col(name).alias("name")).distinct().join(best, "name", "left").select("name", F.nullif("ticker", F.lit("")).alias("ticker"))


def verified(events: DataFrame, resolved: DataFrame, name: str, ticker: str) -> DataFrame:
    """Events whose name resolves back to the ticker that was asked for."""
    good = resolved.where("ticker IS NOT NULL").select(F.col("name").alias("__n"), F.col("ticker").alias("__t"))
    return events.join(good, (F.col(name) == F.col("__n")) & (F.col(ticker) == F.col("__t")), "left_semi")


def ticker_sectors(holdings: DataFrame, curated: DataFrame, industries: DataFrame, sic_sectors: DataFrame, keywords: dict[str, list[str]]) -> DataFrame:
    """(holding columns, sector) by tiers: curated tickers, then the industry code's longest prefix, then words.

    ``curated`` (ticker, sector), ``industries`` (ticker, sic), ``sic_sectors`` (prefix, sector).
    A tier answers only where the tiers before have nothing; several sectors make several rows.
    """
    h = holdings.withColumn("__k", F.upper(F.trim("ticker")))
    one = h.join(curated.select(F.col("ticker").alias("__k"), "sector").distinct(), "__k")
    rest = h.join(curated.select(F.col("ticker").alias("__k")).distinct(), "__k", "left_anti")
    coded = longest_prefix(industries.where("sic IS NOT NULL").select(F.upper(F.trim("ticker")).alias("__k"), "sic"), sic_sectors, "sic", "prefix").where("sector IS NOT NULL").select("__k", "sector").distinct()
    two = rest.join(coded, "__k")
    rest = rest.join(coded.select("__k").distinct(), "__k", "left_anti")
    hits = F.array_compact(F.array(*[F.when(F.coalesce(F.col("asset"), F.lit("")).rlike(r"(?i)\b(?:" + "|".join(sorted(w)) + r")\b"), F.lit(s)) for s, w in sorted(keywords.items())]))
    three = rest.withColumn("sector", F.explode(hits))
    return one.unionByName(two).unionByName(three).drop("__k")


def committee_sectors(seats: DataFrame, remits: DataFrame) -> DataFrame:
    """Seats with each sector of the committee's remit; a subcommittee has its parent's unless it has its own."""
    return longest_prefix(seats, remits.withColumnRenamed("committee_id", "__committee"), "committee_id", "__committee", least=4).where("sector IS NOT NULL")


def match_filers(filers: DataFrame, roster: DataFrame) -> DataFrame:
    """(filer_id, member_id) for filers that exactly one member fits.

    Sitting members of the state by surname come first; only if none fits, former members
    whose given name agrees. Several candidates are told apart by district if that leaves one.
    ``filers``: filer_id, last, first, state, district; ``roster``: member_id, last, first,
    state, district, in_office.
    """

    def district(c: str) -> Column:
        return F.coalesce(F.col(c).try_cast("int"), F.lit(0))

    r = roster.select("member_id", "state", F.explode(surname_keys(F.col("last"))).alias("key"), F.col("first").alias("r_first"), district("district").alias("r_district"), "in_office").distinct()
    f = filers.select("filer_id", "state", F.explode(surname_keys(F.col("last"))).alias("key"), F.col("first").alias("f_first"), district("district").alias("f_district")).distinct()
    c = f.join(r, ["state", "key"]).where(F.col("in_office") | given_names_agree(F.col("f_first"), F.col("r_first")))
    c = c.groupBy("filer_id", "member_id").agg(F.max("in_office").alias("sits"), F.max(F.col("f_district") == F.col("r_district")).alias("near"))
    by = Window.partitionBy("filer_id")
    c = c.withColumn("tier", F.max("sits").over(by)).where(F.col("sits") == F.col("tier"))
    c = c.withColumn("n", F.count("*").over(by)).withColumn("n_near", F.count_if("near").over(by))
    return c.where((F.col("n") == 1) | ((F.col("n_near") == 1) & F.col("near"))).select("filer_id", "member_id")


def match_senators(filers: DataFrame, roster: DataFrame) -> DataFrame:
    """(filer_id, member_id) by folded surname, sitting members first; then a given name's prefix, then its initial."""
    r = roster.select("member_id", F.explode(surname_keys(F.col("last"))).alias("key"), fold_name(F.col("first")).alias("r"), "in_office").distinct()
    f = filers.select("filer_id", F.explode(surname_keys(F.col("last"))).alias("key"), fold_name(F.col("first")).alias("f")).distinct()
    lead = F.element_at(F.split("f", " "), 1)
    tier = F.when(F.col("in_office"), 0).otherwise(2) + F.when(F.startswith(F.col("r"), lead), 0).otherwise(1)
    c = f.join(r, "key").where(F.startswith(F.col("r"), F.substring(lead, 1, 1))).groupBy("filer_id", "member_id").agg(F.min(tier).alias("tier"))
    c = c.withColumn("best", F.min("tier").over(Window.partitionBy("filer_id"))).where("tier = best")
    return c.withColumn("n", F.count("*").over(Window.partitionBy("filer_id"))).where("n = 1").select("filer_id", "member_id")


def unmatched(filers: DataFrame, matched: DataFrame, top: int = 5) -> DataFrame:
    """The filers with most filings among those that matched nobody (a top-k report)."""
    return filers.join(matched, "filer_id", "left_anti").groupBy("last", "first").agg(F.count("*").alias("filings")).orderBy(F.desc("filings"), "last", "first").limit(top)

"""Net worth as intervals between disclosed bands, and its growth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import SALARY, SALARY_BY_YEAR
from ..functions.money import deviation_severity, wealth_severity
from ..functions.predicates import net_worth_snapshot


def salaries(first: str = "first_year", last: str = "last_year"):
    """Column: salary over an inclusive range of years."""
    table = F.create_map(*[F.lit(x) for pair in SALARY_BY_YEAR.items() for x in pair])
    years = F.sequence(F.col(first), F.col(last))
    return F.aggregate(years, F.lit(0).cast("long"), lambda acc, y: acc + F.coalesce(F.try_element_at(table, y), F.lit(SALARY)))


def net_worth(filings: DataFrame, assets: DataFrame, liabilities: DataFrame) -> DataFrame:
    """Per annual filing low = assets' lows - debts' highs, high = assets' highs - debts' lows; mid only if neither bound is 0."""
    snap = filings.where(net_worth_snapshot(F.col("is_ptr"), F.col("filing_type")))
    a = assets.groupBy("filing_id").agg(F.sum("value_min").alias("a_min"), F.sum("value_max").alias("a_max"))
    d = liabilities.groupBy("filing_id").agg(F.sum("amount_min").alias("l_min"), F.sum("amount_max").alias("l_max"))
    both = a.join(d, "filing_id", "full").na.fill(0, ["a_min", "a_max", "l_min", "l_max"])
    out = snap.join(both, "filing_id").withColumn("low", F.col("a_min") - F.col("l_max")).withColumn("high", F.col("a_max") - F.col("l_min"))
    return out.withColumn("mid", F.when((F.col("low") != 0) & (F.col("high") != 0), (F.col("low") + F.col("high")) / 2)).drop("a_min", "a_max", "l_min", "l_max")


def wealth_progression(filings: DataFrame, assets: DataFrame, liabilities: DataFrame) -> DataFrame:
    """The alternate rule: an asset's band counts if both ends are above 0, else its upper end alone; the estimate is null unless positive."""
    banded = (F.coalesce("value_min", F.lit(0)) != 0) & (F.coalesce("value_max", F.lit(0)) != 0)
    top = F.coalesce("value_max", F.lit(0))
    a = assets.groupBy("filing_id").agg(F.sum(F.when(banded, F.col("value_min")).otherwise(top)).alias("a_low"), F.sum(top).alias("a_high"))
    d = liabilities.groupBy("filing_id").agg(F.sum(F.coalesce("amount_min", F.lit(0))).alias("l_low"), F.sum(F.coalesce("amount_max", "amount_min", F.lit(0))).alias("l_high"))
    out = filings.join(a, "filing_id", "left").join(d, "filing_id", "left").na.fill(0, ["a_low", "a_high", "l_low", "l_high"])
    out = out.withColumn("low", F.col("a_low") - F.col("l_high")).withColumn("high", F.col("a_high") - F.col("l_low"))
    mid = (F.col("low") + F.col("high")) / 2
    return out.withColumn("estimate", F.when(mid > 0, mid)).drop("a_low", "a_high", "l_low", "l_high")


def wealth_growth(worth: DataFrame, above: float = 200.0) -> DataFrame:
    """Growth between a member's consecutive read filings that beats the salary's share of the earlier worth by ``above`` points."""
    order = Window.partitionBy("member_id").orderBy("filing_year", "filed_on", "filing_id")
    rows = worth.where("parsed AND mid IS NOT NULL")
    for c in ("filing_year", "mid", "low", "high"):
        rows = rows.withColumn(f"last_{c}", F.lag(c).over(order))
    rows = rows.where((F.col("filing_year") > F.col("last_filing_year")) & (F.col("last_mid") > 0))
    rows = rows.withColumn("years", F.col("filing_year") - F.col("last_filing_year")).withColumn("growth", (F.col("mid") - F.col("last_mid")).cast("double"))
    rows = rows.withColumn("growth_percent", F.col("growth") / F.col("last_mid").cast("double") * 100)
    rows = rows.withColumn("expected_percent", F.lit(float(SALARY)) * F.col("years") / F.col("last_mid").cast("double") * 100)
    return rows.where((F.col("growth") > 0) & (F.col("growth_percent") > F.col("expected_percent") + above)).withColumn("severity", deviation_severity(F.col("growth_percent"), F.col("expected_percent")))


def wealth_vs_salary(progress: DataFrame, times: float = 2.0) -> DataFrame:
    """Off by default: members whose growth, read least favourably, exceeds ``times`` their salary since the first filing."""
    at = F.struct("filing_year", "filed_on", "filing_id")
    ends = progress.groupBy("member_id").agg(F.count("*").alias("n"), *[f(c, at).alias(f"{p}_{n}") for p, f in (("first", F.min_by), ("last", F.max_by)) for c, n in (("filing_year", "year"), ("low", "low"), ("high", "high"), ("estimate", "estimate"))])
    ends = ends.where("n >= 2 AND first_estimate IS NOT NULL AND last_estimate IS NOT NULL").withColumn("salary", salaries())
    ends = ends.withColumn("growth_low", F.col("last_low") - F.col("first_high")).withColumn("growth_high", F.col("last_high") - F.col("first_low"))
    return ends.where(F.col("growth_low") > times * F.col("salary")).withColumn("severity", wealth_severity(F.col("growth_low"), F.col("salary")))


def asset_appreciation(assets: DataFrame, yearly: float = 500.0, single: float = 100.0, critical: float = 1000.0) -> DataFrame:
    """Off by default: assets (member_id, asset_key, year) whose guaranteed growth between disclosed years is steep."""
    year = assets.groupBy("member_id", "asset_key", "year").agg(F.sum("value_min").alias("low"), F.sum("value_max").alias("high"))
    order = Window.partitionBy("member_id", "asset_key").orderBy("year")
    rows = year.withColumn("last_year", F.lag("year").over(order)).withColumn("last_high", F.lag("high").over(order)).where("last_high > 0 AND low IS NOT NULL")
    rows = rows.withColumn("years", F.col("year") - F.col("last_year")).withColumn("percent", (F.col("low") - F.col("last_high")).cast("double") / F.col("last_high").cast("double") * 100)
    steep = (F.col("percent") / F.col("years") > yearly) | ((F.col("years") == 1) & (F.col("percent") > single))
    return rows.where(steep).withColumn("severity", F.when(F.col("percent") > critical, "CRITICAL").otherwise("HIGH"))


def income_by_class(incomes: DataFrame, kind: str = "income_type", amount: str = "amount", share: float = 0.7) -> DataFrame:
    """Count, total and mean of each class of income, and whether it is above ``share`` of all."""
    per = incomes.groupBy(kind).agg(F.count("*").alias("n"), F.sum(amount).alias("total"), F.avg(amount).alias("mean"))
    whole = incomes.agg(F.sum(amount).alias("all_income"))
    return per.crossJoin(F.broadcast(whole)).withColumn("share", F.try_divide("total", "all_income")).withColumn("flagged", F.col("share") > share).drop("all_income")

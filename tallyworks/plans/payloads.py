"""Queries over payloads: the test tables printed as the sources print theirs, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates, text
from ..functions.money import band_of
from ..operators import lookups
from ..session import settled
from ..sources import grids, html, readers
from .queries import query
from .workload import Workload, band_sql

_MONTH = "MM/dd/yyyy"


def _row(tag: str, *cells: Column | str) -> Column:
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit(f"<{tag}>"), c if not isinstance(c, str) else F.lit(c), F.lit(f"</{tag}>")) for c in cells], F.lit("</tr>"))


@query("SELECT p_partkey AS page_id, CAST(tb AS INTEGER) AS table, CAST(r AS INTEGER) AS row, CASE WHEN r = 0 THEN 'Name|Size' WHEN tb = 0 THEN p_name || '|' || p_size ELSE p_type || '|' || p_brand END AS cells FROM part, range(2) a(tb), range(2) b(r)")
def html_table_rows(w: Workload) -> DataFrame:
    head = _row("th", "Name", " Size\n")
    first = _row("td", F.concat(F.lit(" <b>"), "p_name", F.lit("</b>\n")), F.col("p_size").cast("string"))
    second = _row("td", F.col("p_type"), F.concat(F.lit("<script>x()</script>"), "p_brand"))
    page = F.concat(F.lit("<p>no</p><table>"), head, first, F.lit("</table><div><table>"), head, second, F.lit("</table></div>"))
    pages = w.table("part").select(F.col("p_partkey").alias("page_id"), page.alias("html"))
    return html.table_rows(pages, "page_id").select("page_id", "table", "row", F.array_join("cells", "|").alias("cells"))


def _printed(trades: DataFrame) -> DataFrame:
    """Trades of bands of the form, with their cells as printed."""
    whole = lambda c: F.format_number(c, 0)
    band = F.when(F.col("amount_max").isNull(), F.concat(F.lit("Over $"), whole(F.col("amount_min") - 1))).otherwise(F.concat(F.lit("$"), whole("amount_min"), F.lit(" - $"), whole("amount_max")))
    kind = F.when(F.col("direction") == "purchase", "Purchase").when(F.col("direction") == "sale", "Sale (Partial)").otherwise("Exchange")
    return trades.where("amount_min > 1000").withColumn("band", band).withColumn("kind", kind)


def _parts(w: Workload) -> DataFrame:
    """A trade for every part, with its band as printed."""
    # the table is a small file, whose pages one task would print and parse
    p, k = w.table("part").repartition(2 * w.spark.sparkContext.defaultParallelism, "p_partkey"), F.col("p_partkey")
    band = band_of(F.col("p_retailprice") * 30)
    rows = p.select(
        k.alias("part_id"),
        F.col("p_brand").alias("ticker"),
        F.col("p_name").alias("asset"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.col("p_size")).alias("traded_on"),
        F.when(F.col("p_size") % 3 == 0, "Spouse").when(F.col("p_size") % 3 == 1, "Joint").alias("owner"),
        F.when(k % 3 == 0, "purchase").when(k % 3 == 1, "sale").otherwise("exchange").alias("direction"),
        band["low"].cast("long").alias("amount_min"),
        band["high"].cast("long").alias("amount_max"),
    )
    return _printed(rows)


_PARTS = f""", pt AS (SELECT p_partkey AS part_id, p_brand AS ticker, p_name AS asset, CAST(DATE '2020-01-01' + p_size AS VARCHAR) AS traded_on, CASE p_size % 3 WHEN 0 THEN 'Spouse' WHEN 1 THEN 'Joint' ELSE 'Self' END AS owner,
CASE p_partkey % 3 WHEN 0 THEN 'purchase' WHEN 1 THEN 'sale' ELSE 'exchange' END AS direction, CAST({band_sql('p_retailprice * 30', 1)} AS DOUBLE) AS amount_min, CAST({band_sql('p_retailprice * 30', 2)} AS DOUBLE) AS amount_max FROM part)
"""


@query(_PARTS + "SELECT part_id, traded_on, owner, CASE WHEN part_id % 4 > 0 THEN ticker END AS ticker, asset, direction, amount_min, amount_max, CASE WHEN part_id % 3 = 0 THEN 'note ' || part_id END AS comment FROM pt WHERE amount_min > 1000")
def senate_report_trades(w: Workload) -> DataFrame:
    head = _row("th", "#", "Transaction Date", "Owner", "Ticker", "Asset Name", "Asset Type", "Type", "Amount", "Comment")
    ticker = F.when(F.col("part_id") % 4 > 0, F.col("ticker")).otherwise("--")
    note = F.when(F.col("part_id") % 3 == 0, F.concat(F.lit("note "), F.col("part_id").cast("string"))).otherwise("--")
    row = _row("td", "1", F.date_format("traded_on", _MONTH), F.coalesce("owner", F.lit("")), ticker, F.col("asset"), "Stock", F.col("kind"), F.col("band"), note)
    pages = _parts(w).select("part_id", F.concat(F.lit("<table><tr><th>Other</th></tr><tr><td>none</td></tr></table><table>"), head, row, F.lit("</table>")).alias("html"))
    got = html.senate_trades(settled(html.table_rows(pages, "part_id")), "part_id")
    return got.select("part_id", "traded_on", "owner", "ticker", "asset", "direction", F.col("amount_min").cast("double").alias("amount_min"), F.col("amount_max").cast("double").alias("amount_max"), "comment")


@query("SELECT txn_id, CAST(traded_on AS VARCHAR) AS traded_on, CASE WHEN owner IN ('Spouse', 'Joint') THEN owner ELSE 'Self' END AS owner, asset || ' (AB) [ST]' AS asset, 'AB' AS ticker, direction, CAST(amount_min AS DOUBLE) AS amount_min, CAST(amount_max AS DOUBLE) AS amount_max, status FROM t WHERE amount_min > 1000")
def grid_report_trades(w: Workload) -> DataFrame:
    code = F.when(F.col("owner") == "Spouse", "SP ").when(F.col("owner") == "Joint", "JT ").otherwise("")
    mark = F.when(F.col("direction") == "purchase", "P").when(F.col("direction") == "sale", "S (partial)").otherwise("E")
    cells = lambda *c: F.array(*[x if not isinstance(x, str) else F.lit(x) for x in c])
    head = cells("ID", "Owner", "Asset", "Transaction\nType", "Date", "Notification\nDate", "Amount")
    row = cells("", "", F.concat(code, "asset", F.lit(" \x00(AB)\n[ST]")), mark, F.date_format("traded_on", _MONTH), F.date_format("filed_on", _MONTH), F.col("band"))
    note = cells(F.concat(F.lit("F\x00 S\x00: "), "status"), "", "", "", "", "", "")
    pages = _printed(w.trades()).select(F.col("txn_id").alias("document_id"), F.array(F.array(cells("Name:"), head, row, note)).alias("tables"))
    got = grids.grid_trades(grids.grid_rows(pages))
    return got.select(F.col("document_id").alias("txn_id"), "traded_on", "owner", "asset", "ticker", "direction", F.col("amount_min").cast("double").alias("amount_min"), F.col("amount_max").cast("double").alias("amount_max"), "status")


# ---------------------------------------------------------------- JSON payloads


def _pages(rows: DataFrame, fields: dict, by: str = "o_custkey") -> DataFrame:
    """One page of results for each value of ``by``."""
    return rows.groupBy(by).agg(F.collect_list(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("results"))


@query("SELECT o_custkey AS member_id, 'Donor ' || o_orderpriority AS donor_name, CAST(CAST(o_totalprice AS DECIMAL(15, 2)) AS DOUBLE) AS amount, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS happened_on, 'fec' AS source, CAST(o_orderkey AS VARCHAR) AS external_id FROM orders WHERE o_orderkey % 5 > 0 AND o_orderkey % 7 > 0 AND o_custkey % 3 > 0")
def fec_receipts(w: Workload) -> DataFrame:
    """Donations to the committees of members, found through a committee's candidates and the roster."""
    k = F.col("o_orderkey")
    fields = {
        "committee_id": F.concat(F.lit("C"), F.col("o_custkey").cast("string")),
        "contributor_name": F.concat(F.lit("Donor "), "o_orderpriority"),
        "contribution_receipt_amount": F.when(k % 5 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice")),
        "contribution_receipt_date": F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"),
        "memo_code": F.when(k % 7 == 0, "X"),
        "sub_id": k.cast("string"),
    }
    c = w.table("customer").select("c_custkey").withColumn("code", F.col("c_custkey").cast("string"))
    roster = c.select(F.col("code").alias("bioguide_id"), F.array(F.concat(F.lit("H"), "code"), F.concat(F.lit("S"), "code")).alias("fec_ids"))
    committees = c.where("c_custkey % 3 > 0").select(F.concat(F.lit("C"), "code").alias("committee_id"), F.array(F.concat(F.lit("S"), "code"), F.lit("P0")).alias("candidate_ids"))
    recipients = lookups_of(committees, roster)
    got = readers.receipts(_pages(w.table("orders"), fields), recipients)
    return got.withColumn("amount", F.col("amount").cast("double"))


def lookups_of(committees: DataFrame, roster: DataFrame) -> DataFrame:
    found = readers.committee_recipients(committees, readers.candidate_members(roster))
    return found.select("committee_id", F.col("bioguide_id").cast("long").alias("member_id"))


@query("SELECT 'Firm' AS registrant, CASE WHEN o_orderkey % 4 = 0 THEN 'Agent on behalf of ' || o_orderpriority ELSE o_orderpriority END AS client, CASE WHEN o_orderkey % 4 = 0 THEN 'Agent on behalf of ' || o_orderpriority || '/' || o_orderpriority ELSE o_orderpriority END AS names, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(15, 2)) AS DOUBLE) END AS amount, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS happened_on, CASE WHEN o_orderkey % 2 = 0 THEN 'TAX,' || o_orderstatus END AS issue_codes, 'lda' AS source, CAST(o_orderkey AS VARCHAR) AS external_id FROM orders")
def lda_filings(w: Workload) -> DataFrame:
    k, price = F.col("o_orderkey"), F.format_string("%.2f", F.col("o_totalprice"))
    codes = F.when(k % 2 == 0, F.array(F.lit("TAX"), F.col("o_orderstatus"), F.lit("TAX"), F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))
    fields = {
        "filing_uuid": k.cast("string"),
        "income": F.when(k % 3 == 0, price).when(k % 3 == 1, "0.00"),
        "expenses": F.when(k % 3 == 1, price),
        "dt_posted": F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T10:00:00-05:00")),
        "registrant": F.struct(F.lit("Firm").alias("name")),
        "client": F.struct(F.when(k % 4 == 0, F.concat(F.lit("Agent on behalf of "), "o_orderpriority")).otherwise(F.col("o_orderpriority")).alias("name")),
        "lobbying_activities": F.transform(codes, lambda c: F.struct(c.alias("general_issue_code"))),
    }
    got = readers.lobbying(_pages(w.table("orders"), fields))
    return got.withColumn("amount", F.col("amount").cast("double")).withColumn("names", F.array_join("names", "/"))


@query("SELECT o_orderpriority AS recipient, 'Navy' AS agency, CAST(CAST(o_totalprice AS DECIMAL(15, 2)) AS DOUBLE) AS amount, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS happened_on, 'usaspending' AS source, CASE WHEN o_orderkey % 6 > 0 THEN 'A' || o_orderkey || '|' || CASE WHEN o_orderkey % 2 = 0 THEN 'M1' ELSE '' END || '|' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || '|5.0' END AS external_id FROM orders")
def award_actions(w: Workload) -> DataFrame:
    k = F.col("o_orderkey")
    fields = {"Award ID": F.when(k % 6 > 0, F.concat(F.lit(" A"), k.cast("string"))), "Mod": F.when(k % 2 == 0, " M1 "), "Recipient Name": F.col("o_orderpriority"), "Transaction Amount": F.col("o_totalprice"), "Action Date": F.date_format("o_orderdate", "yyyy-MM-dd"), "Awarding Agency": F.lit("Navy")}
    got = readers.award_actions(_pages(w.table("orders"), fields))
    # the key ends in the amount as the payload has it; it is shown as 5.0 here, as engines print doubles differently
    return got.withColumn("external_id", F.regexp_replace("external_id", r"[^|]+$", "5.0")).withColumn("amount", F.col("amount").cast("double"))


@query("SELECT CAST(118 AS INTEGER) AS congress, 'hr' AS bill_type, CAST(o_orderkey AS VARCHAR) AS number, o_orderpriority AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'Health' END AS policy_area, 'House' AS origin_chamber, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS introduced_on, CAST(CAST(o_orderdate AS DATE) + 30 AS VARCHAR) AS latest_action_on FROM orders WHERE o_orderkey % 9 > 0")
def sponsored_bills(w: Workload) -> DataFrame:
    k = F.col("o_orderkey")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    payload = w.table("orders").select(
        F.lit(118).alias("congress"), F.lit(" HR ").alias("type"), F.when(k % 9 > 0, F.concat(F.lit(" "), k.cast("string"))).alias("number"), F.col("o_orderpriority").alias("title"), F.struct(F.when(k % 2 == 0, "Health").alias("name")).alias("policyArea"),
        day("o_orderdate").alias("introducedDate"), F.struct(day(F.date_add("o_orderdate", 30)).alias("actionDate"), F.lit("x").alias("text")).alias("latestAction"), F.lit("House").alias("originChamber"),
    )
    return readers.bills(payload)


@query("SELECT * FROM (SELECT o_orderkey AS bill_id, 'HSAG' AS committee_id, 'Agriculture' AS committee_name, 'House' AS chamber, 'Referred to' AS activity, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS happened_on FROM orders UNION ALL SELECT o_orderkey, 'HSAG15', 'Forestry', 'House', NULL, NULL FROM orders WHERE o_orderkey % 2 = 0)")
def bill_referrals(w: Workload) -> DataFrame:
    k = F.col("o_orderkey")
    act = lambda n: F.struct(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), F.lit(n).alias("name"))
    none = F.array().cast("array<struct<date: string, name: string>>")
    subs = F.when(k % 2 == 0, F.array(F.struct(none.alias("activities"), F.lit("Forestry").alias("name"), F.lit("hsag15").alias("systemCode"))))
    main = F.struct(F.array(act("Referred to"), act("Referred to")).alias("activities"), F.lit("House").alias("chamber"), F.lit("Agriculture").alias("name"), F.lit("hsag00").alias("systemCode"), subs.alias("subcommittees"))
    return readers.referrals(w.table("orders").select(k.alias("bill_id"), F.array(main).alias("committees")))


@query("SELECT 'S' || o_orderkey AS document_id, 'Last' || o_custkey AS last, 'First' AS first, o_orderkey % 2 = 0 AS is_ptr, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS filed_on FROM orders WHERE o_orderkey % 8 > 0")
def senate_search_rows(w: Workload) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.when(k % 2 == 0, "ptr").otherwise("annual")
    link = F.concat(F.lit('<a href="/search/view/'), kind, F.lit("/"), k.cast("string"), F.lit('/" target="_blank">Report</a>'))
    cells = F.array(F.lit(" First "), F.concat(F.lit("Last"), F.col("o_custkey").cast("string")), F.lit("x (Senator)"), F.when(k % 8 > 0, link).otherwise("no link"), F.date_format("o_orderdate", _MONTH))
    return readers.senate_rows(w.table("orders").groupBy("o_custkey").agg(F.collect_list(cells).alias("data")))


@query("SELECT 'M' || c_custkey AS bioguide_id, CASE WHEN c_custkey % 3 = 0 THEN 'senate' ELSE 'house' END AS chamber, CASE c_custkey % 4 WHEN 0 THEN 'D' WHEN 1 THEN 'R' WHEN 2 THEN 'I' ELSE 'O' END AS party, c_custkey % 5 > 0 AND c_custkey % 2 = 0 AS in_office FROM customer WHERE c_custkey % 7 > 0")
def member_roster(w: Workload) -> DataFrame:
    k = F.col("c_custkey")
    party = F.when(k % 4 == 0, "Democrat").when(k % 4 == 1, "Republican").when(k % 4 == 2, "Independent").otherwise("Whig")
    term = lambda kind, end: F.struct(kind.alias("type"), F.lit("2001-01-03").alias("start"), end.alias("end"), F.lit("AK").alias("state"), F.lit("0").alias("district"), party.alias("party"))
    last = term(F.when(k % 3 == 0, "sen").otherwise("rep"), F.when(k % 2 == 0, "2025-01-03").otherwise("2019-01-03"))
    terms = F.when(k % 7 > 0, F.array(term(F.lit("rep"), F.lit("2003-01-03")), last)).otherwise(F.array().cast("array<struct<type:string,start:string,end:string,state:string,district:string,party:string>>"))
    rows = w.table("customer").select(F.struct(F.concat(F.lit("M"), k.cast("string")).alias("bioguide"), F.array(F.lit("H1")).alias("fec")).alias("id"), F.struct(F.lit("A").alias("first"), F.col("c_name").alias("last")).alias("name"), terms.alias("terms"), k.alias("k"))
    current, historical = rows.where("k % 5 > 0").drop("k"), rows.where("k % 5 = 0 OR k % 6 = 0").drop("k")
    return readers.roster(current, historical, F.lit("2024-06-01").cast("date")).select("bioguide_id", "chamber", "party", "in_office")


@query("SELECT p_partkey AS id, CAST(p_size AS VARCHAR) AS sic, p_type || ' & more' AS sic_description, CASE WHEN p_partkey % 3 > 0 THEN p_name END AS company_name FROM part")
def company_pages(w: Workload) -> DataFrame:
    name = F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("<conformed-name>"), "p_name", F.lit("</conformed-name>"))).otherwise("")
    xml = F.concat(F.lit("<x><assigned-sic>\n "), F.col("p_size").cast("string"), F.lit("</assigned-sic><assigned-sic-desc>"), "p_type", F.lit(" &amp;amp; more</assigned-sic-desc>"), name, F.lit("</x>"))
    return readers.company_sic(w.table("part").select(F.col("p_partkey").alias("id"), xml.alias("xml")))


# ---------------------------------------------------------------- names and codes


_ROSTER = """, fr AS (SELECT c_custkey AS id, c_custkey // 4 AS fam, c_custkey % 4 AS nth, c_nationkey % 3 AS area, c_acctbal > 3000 AS sits, left(c_mktsegment, 1) AS lead FROM customer)
"""


@query(
    _ROSTER
    + """, c AS (SELECT f.id AS filer_id, r.id AS member_id, r.sits, r.nth = f.nth AS near, f.lead = r.lead AS named FROM fr f JOIN fr r ON r.fam = f.fam AND r.area = f.area WHERE r.sits OR f.lead = r.lead),
b AS (SELECT *, bool_or(sits) OVER (PARTITION BY filer_id) AS sat FROM c QUALIFY sits = sat),
n AS (SELECT *, count(*) OVER (PARTITION BY filer_id) AS n, count(*) FILTER (near) OVER (PARTITION BY filer_id) AS n_near FROM b)
SELECT filer_id, member_id FROM n WHERE n = 1 OR (n_near = 1 AND near)"""
)
def matched_filers(w: Workload) -> DataFrame:
    """Families of four share a surname, three areas a state: sitting members first, given names among former ones, districts among several."""
    k = F.col("c_custkey")
    family, nth = F.floor(k / 4).cast("string"), (k % 4).cast("string")
    c = w.table("customer").withColumn("area", F.concat(F.lit("A"), (F.col("c_nationkey") % 3).cast("string")))
    roster = c.select(k.alias("member_id"), F.concat(F.lit("Núñez"), family).alias("last"), F.concat(F.initcap("c_mktsegment"), F.lit(" María")).alias("first"), F.col("area").alias("state"), nth.alias("district"), (F.col("c_acctbal") > 3000).alias("in_office"))
    filers = c.select(k.alias("filer_id"), F.concat(F.lit("NUNEZ"), family, F.when(k % 2 == 0, ", Jr.").otherwise(" III")).alias("last"), F.substring("c_mktsegment", 1, 1).alias("first"), F.col("area").alias("state"), F.concat(F.lit("0"), nth).alias("district"))
    return lookups.match_filers(filers, roster)


@query(
    _ROSTER
    + """, c AS (SELECT f.id AS filer_id, r.id AS member_id, CASE WHEN r.sits THEN 0 ELSE 2 END + CASE WHEN f.area = 0 THEN 0 ELSE 1 END AS tier FROM fr f JOIN fr r ON r.fam = f.fam AND f.lead = r.lead),
b AS (SELECT *, min(tier) OVER (PARTITION BY filer_id) AS best FROM c QUALIFY tier = best) SELECT filer_id, member_id FROM b QUALIFY count(*) OVER (PARTITION BY filer_id) = 1"""
)
def matched_senators(w: Workload) -> DataFrame:
    """Families of four share a surname: sitting members first, then a given name's beginning, then its initial alone."""
    k = F.col("c_custkey")
    family = F.floor(k / 4).cast("string")
    c = w.table("customer")
    roster = c.select(k.alias("member_id"), F.concat(F.lit("Núñez"), family).alias("last"), F.initcap("c_mktsegment").alias("first"), (F.col("c_acctbal") > 3000).alias("in_office"))
    filers = c.select(k.alias("filer_id"), F.concat(F.lit("Nunez"), family).alias("last"), F.when(F.col("c_nationkey") % 3 == 0, F.concat(F.substring("c_mktsegment", 1, 1), F.lit(" B."))).otherwise(F.concat(F.substring("c_mktsegment", 1, 1), F.lit("zzz"))).alias("first"))
    return lookups.match_senators(filers, roster)


@query("SELECT c_mktsegment AS last, 'x' AS first, count(*) AS filings FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 3")
def unmatched_filers(w: Workload) -> DataFrame:
    f = w.table("customer").select(F.col("c_custkey").alias("filer_id"), F.col("c_mktsegment").alias("last"), F.lit("x").alias("first"))
    return lookups.unmatched(f, f.where("filer_id % 3 > 0").select("filer_id"), 3)


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'curated' WHEN p_size % 3 = 1 THEN CASE WHEN p_partkey % 10 < 5 THEN 'coded' ELSE 'long' END ELSE 'worded' END AS sector FROM part WHERE p_size % 3 < 2 OR p_partkey % 2 = 0")
def sectors_by_tiers(w: Workload) -> DataFrame:
    """Curated tickers first, then the industry code's longest prefix, then words of the asset's name."""
    p, k, z = w.table("part"), F.col("p_partkey"), F.col("p_size")
    ticker = F.concat(F.lit("t"), k.cast("string"))
    held = p.select(k.alias("id"), F.concat(F.lit(" "), ticker).alias("ticker"), F.when(k % 2 == 0, "Deep Mines Ltd").otherwise("Undermines").alias("asset"))
    curated = p.where("p_size % 3 = 0").select(F.upper(ticker).alias("ticker"), F.lit("curated").alias("sector"))
    industries = p.where("p_size % 3 = 1").select(ticker.alias("ticker"), F.when(k % 10 < 5, "2834").otherwise("2899").alias("sic"))
    table = w.spark.createDataFrame([("28", "coded"), ("289", "long"), ("9", "other")], "prefix string, sector string")
    return lookups.ticker_sectors(held, curated, industries, table, {"worded": ["mines"], "none": ["wells"]}).select("id", "sector")


@query("SELECT c_custkey AS id, 'AB' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') AS code, lower(c_name) AS plain, 'HR ' || c_custkey AS citation, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS note, CASE c_custkey % 3 WHEN 0 THEN 'Amended' WHEN 1 THEN 'Deleted' ELSE 'New' END AS status, c_name || ' ' || c_mktsegment AS bare, c_mktsegment AS given, c_custkey % 2 = 0 AS debt, c_custkey % 5 = 0 AS option FROM customer")
def printed_labels(w: Workload) -> DataFrame:
    """Codes, names, notes and tags as sources print them."""
    k, name, segment = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    two = F.lpad((k % 100).cast("string"), 2, "0")
    status = F.when(k % 3 == 0, "amended").when(k % 3 == 1, "Deletion").otherwise("NEW")
    debt = F.concat(name, F.when(k % 2 == 0, " Treasury note").otherwise(" treasury [ST]"))
    option = F.concat(name, F.when(k % 5 == 0, " [ST] call [OP]").otherwise(" [OP] stock [ST]"))
    return w.table("customer").select(
        k.alias("id"),
        text.committee_code(F.concat(F.lit(" ab"), two, F.lit("00"))).alias("code"),
        text.fold_name(F.concat(F.lit(" "), F.replace(name, F.lit("u"), F.lit("ú")))).alias("plain"),
        text.citation(F.lit("hr"), k).alias("citation"),
        text.comment(F.when(k % 2 == 0, name).otherwise(" N/A ")).alias("note"),
        text.filing_status(F.concat(F.lit("x\n F\x00 S\x00: "), status)).alias("status"),
        text.without_tags(F.concat(F.lit("<p class='a'>"), name, F.lit("</p>\n<b>"), segment, F.lit("</b>"))).alias("bare"),
        text.given_name(F.concat(F.lit('Dr. "Bud" '), segment, F.lit(", MD"))).alias("given"),
        predicates.is_fixed_income(debt).alias("debt"),
        predicates.is_option(option).alias("option"),
    )


@query("SELECT filing_id, confidence IS NULL OR confidence < 0.5::DOUBLE AND has_text_layer IS DISTINCT FROM false AS weak, parse_error IS NOT NULL AS failed, NOT parsed AS unread, CASE WHEN is_ptr THEN 'https://disclosures-clerk.house.gov/public_disc/ptr-pdfs/2020/' ELSE 'https://disclosures-clerk.house.gov/public_disc/financial-pdfs/2020/' END || filing_id || '.pdf' AS url FROM (SELECT * REPLACE (CASE WHEN has_text_layer IS NOT DISTINCT FROM false THEN coalesce(confidence, 0) ELSE confidence END AS confidence) FROM fil)")
def parse_queue(w: Workload) -> DataFrame:
    """Which filings to read again, and where they are; scans are known by a score of zero."""
    f = w.filings().withColumn("confidence", F.when(F.col("has_text_layer").eqNullSafe(F.lit(False)), F.coalesce("confidence", F.lit(0.0))).otherwise(F.col("confidence")))
    c = [F.col(x) for x in ("parsed", "parse_error", "confidence", "has_text_layer")]
    wrong = F.concat(F.lit("https://disclosures-clerk.house.gov/public_disc/"), F.when(F.col("is_ptr"), "financial-pdfs").otherwise("ptr-pdfs"), F.lit("/2020/"), F.col("filing_id").cast("string"), F.lit(".pdf"))
    url = text.clerk_url(F.when(F.col("filing_id") % 2 == 0, wrong), F.col("filing_id").cast("string"), F.lit(2020), F.col("is_ptr"))
    return f.select("filing_id", predicates.needs_parse(*c, below=0.5).alias("weak"), predicates.needs_parse(*c, failed_only=True).alias("failed"), predicates.needs_parse(*c).alias("unread"), url.alias("url"))


@query("SELECT upper(p_brand) AS ticker, arg_min(p_name, p_partkey) AS title FROM part GROUP BY 1")
def first_of_register(w: Workload) -> DataFrame:
    """Of names that share a ticker the first of the register stands."""
    register = w.table("part").select(F.col("p_partkey").alias("position"), F.concat(F.lit(" "), "p_brand").alias("ticker"), F.col("p_name").alias("title"))
    return readers.first_of_register(register)[1]


@query("SELECT 'HS' || n_nationkey || lpad(CAST(c_custkey % 3 AS VARCHAR), 2, '0') AS committee_id, n_name || ' - Part ' || c_custkey % 3 AS name, 'HS' || n_nationkey AS parent_id, c_custkey AS member_id, CAST(c_custkey AS INTEGER) AS rank, CASE WHEN c_custkey % 2 = 0 THEN 'Chair' END AS title FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 3 < 2 AND c_custkey % 5 > 0")
def committee_documents(w: Workload) -> DataFrame:
    """Committees and their seats as YAML, a document for each nation: seats of unknown people and parts go, a second seat does too."""
    k, nation = F.col("c_custkey"), F.concat(F.lit("HS"), F.col("n_nationkey").cast("string"))
    n = w.table("nation")
    parts = F.concat(*[F.lit(f"  - {{name: Part {i}, thomas_id: '0{i}'}}\n") for i in (0, 1)])
    index = readers.committees(n.select(F.concat(F.lit("- thomas_id: "), nation, F.lit("\n  name: "), "n_name", F.lit("\n  type: house\n  subcommittees:\n"), parts).alias("text")))
    seat = F.concat(F.lit("  - {bioguide: B"), k.cast("string"), F.lit(", rank: "), k.cast("string"), F.when(k % 2 == 0, ", title: Chair}").otherwise("}"), F.lit("\n  - {bioguide: B"), k.cast("string"), F.lit(", rank: 99999999}\n"))
    seats = w.table("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.concat(nation, F.lpad((k % 3).cast("string"), 2, "0")).alias("at"), "n_nationkey").agg(F.concat_ws("", F.collect_list(seat)).alias("seats"))
    documents = seats.groupBy("n_nationkey").agg(F.concat_ws("", F.collect_list(F.concat("at", F.lit(":\n"), "seats"))).alias("text"))
    members = w.table("customer").where("c_custkey % 5 > 0").select(F.concat(F.lit("B"), k.cast("string")).alias("bioguide_id"), k.alias("member_id"))
    return readers.committee_seats(documents, index, members).select("committee_id", "name", "parent_id", "member_id", "rank", "title")


@query("SELECT count(*) FILTER (c_custkey % 3 = 0) AS unknown_committees, count(*) FILTER (c_custkey % 3 > 0 AND c_custkey % 5 = 0) AS unknown_members FROM customer")
def seat_gaps(w: Workload) -> DataFrame:
    k = F.col("c_custkey")
    seats = w.table("customer").select(F.concat(F.lit("C"), (k % 3).cast("string")).alias("committee_id"), k.cast("string").alias("bioguide_id"))
    return readers.seat_gaps(seats, w.spark.createDataFrame([("C1",), ("C2",)], "committee_id string"), seats.where("bioguide_id % 5 > 0").select("bioguide_id"))


def _annuals(w: Workload) -> DataFrame:
    """Annual reports of one container, what it holds, another holding and a debt; a third of the contents have no value."""
    t = _parts(w)
    inner = F.when(F.col("part_id") % 3 > 0, F.col("band")).otherwise("--")
    head = _row("th", "#", "Asset", "Asset Type", "Owner", "Value", "Income Type", "Income")
    name = lambda c: F.concat(F.lit("<strong> "), c, F.lit("\n(AB)</strong> Company: x (CD)"))
    rows = F.concat(
        head,
        _row("td", "7", name(F.lit("Holding")), "Real Estate", "Self", F.col("band"), "Rent", "None (or less than $201)"),
        _row("td", "7.1", name(F.col("asset")), "Corporate Securities Stock", "Self", inner, "None,", "$201 - $1,000"),
        _row("td", "8", "no name", "Stock", "Self", F.col("band"), "", ""),
    )
    debts = F.concat(_row("th", "#", "Incurred", "Debtor", "Type", "Points", "Rate (APR)", "Amount", "Creditor"), _row("td", "1", "2020", "Self", "Mortgage", "", "", F.col("band"), F.col("ticker")), _row("td", "2", "2020", "Self", "Loan", "", "", "Unknown", F.col("ticker")))
    table = lambda part, x: F.concat(F.lit(f"<h3> {part} </h3><div><table>"), x, F.lit("</table></div>"))
    page = F.concat(table("Part 2. Income", _row("th", "Value")), table("Part 3.\n Assets", rows), table("Part 7. Liabilities", debts))
    return settled(html.table_rows(t.select("part_id", page.alias("html")), "part_id"))


@query(_PARTS + "SELECT part_id, 'Holding (AB)' AS asset, 'real_estate' AS asset_type, 'AB' AS ticker, CASE WHEN part_id % 3 = 0 THEN amount_min END AS value_min, CASE WHEN part_id % 3 = 0 THEN amount_max END AS value_max, 0.0::DOUBLE AS income_min, 200.0::DOUBLE AS income_max FROM pt WHERE amount_min > 1000 UNION ALL SELECT part_id, asset || ' (AB)', 'stock', 'AB', CASE WHEN part_id % 3 > 0 THEN amount_min END, CASE WHEN part_id % 3 > 0 THEN amount_max END, 201.0::DOUBLE, 1000.0::DOUBLE FROM pt WHERE amount_min > 1000")
def senate_annual_assets(w: Workload) -> DataFrame:
    got = html.senate_assets(_annuals(w), "part_id")
    return got.select("part_id", "asset", "asset_type", "ticker", *[F.col(c).cast("double").alias(c) for c in ("value_min", "value_max", "income_min", "income_max")])


@query(_PARTS + "SELECT part_id, ticker AS creditor, 'Mortgage' AS description, amount_min, amount_max FROM pt WHERE amount_min > 1000")
def senate_annual_debts(w: Workload) -> DataFrame:
    got = html.senate_debts(_annuals(w), "part_id")
    return got.select("part_id", "creditor", "description", *[F.col(c).cast("double").alias(c) for c in ("amount_min", "amount_max")])


def _reports(w: Workload) -> DataFrame:
    whole = lambda c: F.format_number(c, 0)
    pair = F.concat(F.lit("$"), whole("p_size"), F.lit(" - $"), whole(F.col("p_size") + 5000))
    asset = F.concat(F.lit("<Asset>\n<Description> "), "p_name", F.lit(" Real Estate &amp; Co</Description><Value>"), pair, F.lit("</Value><Income>$1,000</Income></Asset><Asset><Description/><Value>5</Value></Asset>"))
    income = F.concat(F.lit("<Income><Source>"), F.when(F.col("p_partkey") % 2 == 0, "Rental of ").otherwise("Book "), "p_name", F.lit("</Source><Amount>"), pair, F.lit("</Amount><Type>Rent</Type></Income>"))
    return w.table("part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("<Report><Assets>"), asset, F.lit("</Assets>"), income, F.lit("</Report>")).alias("xml"))


@query("SELECT p_partkey AS id, p_name || ' Real Estate & Co' AS asset, 'real_estate' AS asset_type, CAST(p_size AS DOUBLE) AS value_min, CAST(p_size + 5000 AS DOUBLE) AS value_max, 1000.0::DOUBLE AS income_min, 1000.0::DOUBLE AS income_max FROM part")
def xml_report_assets(w: Workload) -> DataFrame:
    got = readers.xml_assets(_reports(w))
    return got.select("id", "asset", "asset_type", *[F.col(c).cast("double").alias(c) for c in ("value_min", "value_max", "income_min", "income_max")])


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'Rental of ' ELSE 'Book ' END || p_name AS source, CASE WHEN p_partkey % 2 = 0 THEN 'real_estate' ELSE 'other' END AS source_type, p_size + 2500.0::DOUBLE AS amount, 'Rent' AS income_type FROM part")
def xml_report_incomes(w: Workload) -> DataFrame:
    return readers.xml_incomes(_reports(w)).select("id", "source", "source_type", F.col("amount").cast("double").alias("amount"), "income_type")

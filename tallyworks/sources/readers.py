"""Landed payloads as typed rows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.dates import iso_date, not_after, parse_date
from ..functions.fixed import INCOME_SOURCES
from ..functions.money import xml_band, xml_income
from ..functions.text import award_key, client_names, committee_code, company_key, in_one_string, kind_by_words, party_letter, xml_asset_type

#: Rows that a reader of whole documents holds at once.
BATCH = 10_000


def house_index(spark: SparkSession, path: str, ptr: bool = False) -> DataFrame:
    """The House clerk's XML index: periodic reports (type P) or everything else but candidates' (type C)."""
    return house_rows(spark.read.format("xml").option("rowTag", "Member").schema(schemas.HOUSE_MEMBER).load(path), ptr)


def house_rows(members: DataFrame, ptr: bool = False) -> DataFrame:
    kind = F.upper(F.trim("FilingType"))
    rows = members.where(kind == "P" if ptr else ~F.coalesce(kind, F.lit("")).isin("P", "C"))
    return rows.select(
        F.trim("DocID").alias("document_id"),
        F.trim("Last").alias("last"),
        F.trim("First").alias("first"),
        F.substring(F.trim("StateDst"), 1, 2).alias("state"),
        F.nullif(F.substring(F.trim("StateDst"), 3, 10), F.lit("")).alias("district"),
        kind.alias("filing_type"),
        F.trim("Year").try_cast("int").alias("filing_year"),
        parse_date(F.col("FilingDate")).alias("filed_on"),
        F.lit(ptr).alias("is_ptr"),
    )


def senate_rows(pages: DataFrame) -> DataFrame:
    """The Senate's search pages: the first cell that links to a report names its kind and id."""
    rows = pages.select(F.explode("data").alias("cells"))
    link = F.try_element_at(F.filter("cells", lambda c: c.rlike(r"/search/view/[^/]+/[^/\"]+")), F.lit(1))
    rows = rows.withColumn("link", link).where("link IS NOT NULL")
    kind = F.regexp_extract("link", r"/search/view/([^/]+)/", 1)
    text = F.lower(F.regexp_replace(F.array_join("cells", " "), r"<[^>]*>", " "))
    day = F.try_element_at(F.filter("cells", lambda c: F.trim(c).rlike(r"^\d{1,2}/\d{1,2}/\d{4}$")), F.lit(1))
    return rows.select(
        F.concat(F.lit("S"), F.regexp_extract("link", r"/search/view/[^/]+/([^/\"]+)", 1)).alias("document_id"),
        F.trim(F.col("cells")[1]).alias("last"),
        F.trim(F.col("cells")[0]).alias("first"),
        ((kind == "ptr") | text.contains("periodic transaction")).alias("is_ptr"),
        parse_date(day).alias("filed_on"),
    )


def roster(current: DataFrame, historical: DataFrame, today) -> DataFrame:
    """Members by their last term; the current file overrides the historical one, and ended terms are not in office."""
    both = current.withColumn("order", F.lit(0)).unionByName(historical.withColumn("order", F.lit(1)))
    last = F.try_element_at("terms", F.lit(-1))
    rows = both.where(F.size("terms") > 0).withColumn("t", last)
    first = Window.partitionBy("id.bioguide").orderBy("order")
    rows = rows.withColumn("n", F.row_number().over(first)).where("n = 1")
    return rows.select(
        F.col("id.bioguide").alias("bioguide_id"),
        F.col("name.first").alias("first"),
        F.col("name.last").alias("last"),
        F.when(F.col("t.type") == "sen", "senate").otherwise("house").alias("chamber"),
        party_letter(F.col("t.party")).alias("party"),
        F.col("t.state").alias("state"),
        F.col("t.district").alias("district"),
        ((F.col("order") == 0) & F.coalesce(iso_date(F.col("t.end")) >= F.lit(today), F.lit(True))).alias("in_office"),
        F.col("id.fec").alias("fec_ids"),
    )


def _yaml_seats(text: str) -> Iterator[tuple]:
    """(name, item) of a document that maps names to lists, an item at a time, so that only one is held; of equal names the last stands."""
    last = {name: n for n, name, item in _yaml_items(text) if item is None}
    for n, name, item in _yaml_items(text):
        if item is not None and last[name] == n:
            yield name, item()


def _yaml_items(text: str) -> Iterator[tuple]:
    """(number, name, None) of each name of a YAML mapping, then (number, name, function that makes it) of each item of its list."""
    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)(text)
    anchors: dict = {}

    def node():
        event = loader.get_event()
        if isinstance(event, yaml.AliasEvent):
            return anchors[event.anchor]
        tag = getattr(event, "tag", None)
        if isinstance(event, yaml.ScalarEvent):
            made = yaml.ScalarNode(tag if tag not in (None, "!") else loader.resolve(yaml.ScalarNode, event.value, event.implicit), event.value)
        elif isinstance(event, yaml.SequenceStartEvent):
            made = yaml.SequenceNode(tag if tag not in (None, "!") else loader.resolve(yaml.SequenceNode, None, event.implicit), [])
            while not loader.check_event(yaml.SequenceEndEvent):
                made.value.append(node())
            loader.get_event()
        else:
            made = yaml.MappingNode(tag if tag not in (None, "!") else loader.resolve(yaml.MappingNode, None, event.implicit), [])
            while not loader.check_event(yaml.MappingEndEvent):
                made.value.append((node(), node()))
            loader.get_event()
        if event.anchor is not None:
            anchors[event.anchor] = made
        return made

    loader.get_event(), loader.get_event()  # the stream's and the document's beginning
    if not loader.check_event(yaml.MappingStartEvent):
        return
    loader.get_event()
    number = 0
    while not loader.check_event(yaml.MappingEndEvent):
        name = loader.construct_document(node())
        yield number, name, None
        if loader.check_event(yaml.SequenceStartEvent) and loader.peek_event().anchor is None:
            loader.get_event()
            while not loader.check_event(yaml.SequenceEndEvent):
                item = node()
                yield number, name, lambda item=item: loader.construct_document(item)
            loader.get_event()
        else:
            for item in loader.construct_document(node()) or []:
                yield number, name, lambda item=item: item
        number += 1


def _yaml_rows(documents: DataFrame, text: str, schema: str, rows_of) -> DataFrame:
    """Rows that ``rows_of`` makes of each YAML document's text, in the task that has it; null documents have none.

    Rows leave in batches of BATCH, so what a task holds does not follow a document's length but for its text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (row for x in batch.column(0) if (source := x.as_py()) for row in rows_of(source))
            while rows := list(islice(found, BATCH)):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], names=list(kinds))

    kinds = {f.name: pa.int32() if f.dataType.simpleString() == "int" else pa.string() for f in T.StructType.fromDDL(schema)}
    return documents.select(text).mapInArrow(run, schema)


def committees(documents: DataFrame, text: str = "text") -> DataFrame:
    """(committee_id, name, chamber, parent_id) of YAML documents of committees with their subcommittees."""

    def rows(source):
        import yaml

        for c in yaml.load(source, getattr(yaml, "CSafeLoader", yaml.SafeLoader)) or []:
            yield c["thomas_id"], c["name"], c.get("type"), None
            for s in c.get("subcommittees") or []:
                yield c["thomas_id"] + s["thomas_id"], f"{c['name']} - {s['name']}", c.get("type"), c["thomas_id"]

    return _yaml_rows(documents, text, "committee_id string, name string, chamber string, parent_id string", rows)


def committee_seats(documents: DataFrame, index: DataFrame, members: DataFrame, text: str = "text") -> DataFrame:
    """Seats of known members on known committees, each once: that of the best rank, then the first title."""

    def rows(source):
        for committee, p in _yaml_seats(source):
            yield committee, p.get("bioguide"), p.get("title"), p.get("rank"), p.get("party")

    seats = _yaml_rows(documents, text, "committee_id string, bioguide_id string, title string, rank int, side string", rows)
    found = seats.join(index, "committee_id").join(members.select("bioguide_id", "member_id"), "bioguide_id")
    nth = F.row_number().over(Window.partitionBy("member_id", "committee_id").orderBy(F.asc_nulls_last("rank"), F.asc_nulls_last("title"), F.asc_nulls_last("side")))
    return found.withColumn("nth", nth).where("nth = 1").drop("nth")


def seat_gaps(seats: DataFrame, index: DataFrame, members: DataFrame) -> DataFrame:
    """One row: seats on committees that the index lacks, and seats of people who are no members."""
    marked = seats.join(index.select("committee_id").distinct().withColumn("known", F.lit(True)), "committee_id", "left").join(members.select("bioguide_id").distinct().withColumn("member", F.lit(True)), "bioguide_id", "left")
    return marked.agg(F.count_if(F.col("known").isNull()).alias("unknown_committees"), F.count_if(F.col("known").isNotNull() & F.col("member").isNull()).alias("unknown_members"))


def receipts(pages: DataFrame, recipients: DataFrame) -> DataFrame:
    """Donations to committees of members: no memo rows, positive amounts. ``recipients``: committee_id, member_id."""
    r = pages.select(F.explode("results").alias("r")).select("r.*")
    r = r.where((F.coalesce("memo_code", F.lit("")) == "") & (F.col("contribution_receipt_amount") > 0))
    return r.join(recipients, "committee_id").select(
        "member_id", F.col("contributor_name").alias("donor_name"), F.col("contribution_receipt_amount").cast("decimal(15,2)").alias("amount"), iso_date(F.col("contribution_receipt_date")).alias("happened_on"), F.lit("fec").alias("source"), F.col("sub_id").alias("external_id")
    )


def candidate_members(roster_: DataFrame) -> DataFrame:
    return roster_.select("bioguide_id", F.explode("fec_ids").alias("candidate_id"))


def committee_recipients(committees_: DataFrame, candidates: DataFrame) -> DataFrame:
    """(committee_id, bioguide_id) through a committee's candidates."""
    return committees_.select("committee_id", F.explode("candidate_ids").alias("candidate_id")).join(candidates, "candidate_id").select("committee_id", "bioguide_id").distinct()


def lobbying(pages: DataFrame) -> DataFrame:
    """Filings with their amount (income, else expenses), issue codes in order, and the names to verify."""
    f = pages.select(F.explode("results").alias("f")).select("f.*")
    income, expenses = (F.col(c).try_cast("decimal(15,2)") for c in ("income", "expenses"))
    return f.select(
        F.col("registrant.name").alias("registrant"),
        F.col("client.name").alias("client"),
        client_names(F.col("client.name")).alias("names"),
        F.coalesce(F.nullif(income, F.lit(0).cast("decimal(15,2)")), expenses).alias("amount"),
        iso_date(F.col("dt_posted")).alias("happened_on"),
        in_one_string(F.transform("lobbying_activities", lambda a: F.coalesce(a["general_issue_code"], F.lit("")))).alias("issue_codes"),
        F.lit("lda").alias("source"),
        F.col("filing_uuid").alias("external_id"),
    )


def award_actions(pages: DataFrame) -> DataFrame:
    a = pages.select(F.explode("results").alias("a"))
    amount = F.col("a.`Transaction Amount`")
    return a.select(
        F.col("a.`Recipient Name`").alias("recipient"),
        F.col("a.`Awarding Agency`").alias("agency"),
        amount.cast("decimal(15,2)").alias("amount"),
        iso_date(F.col("a.`Action Date`")).alias("happened_on"),
        F.lit("usaspending").alias("source"),
        award_key(F.col("a.`Award ID`"), F.col("a.Mod"), F.col("a.`Action Date`"), amount.cast("string")).alias("external_id"),
    )


def bills(payload: DataFrame) -> DataFrame:
    """Bills by (congress, type, number); rows without all three are left out."""
    return payload.select(
        "congress",
        F.lower(F.trim("type")).alias("bill_type"),
        F.trim("number").alias("number"),
        "title",
        F.col("policyArea.name").alias("policy_area"),
        F.col("originChamber").alias("origin_chamber"),
        iso_date(F.col("introducedDate")).alias("introduced_on"),
        iso_date(F.col("latestAction.actionDate")).alias("latest_action_on"),
    ).where("congress IS NOT NULL AND bill_type IS NOT NULL AND number IS NOT NULL")


def referrals(payload: DataFrame, bill: str = "bill_id") -> DataFrame:
    """Activities of committees and of their subcommittees, each once."""
    top = payload.select(bill, F.explode("committees").alias("c"))
    subs = top.select(bill, F.col("c.chamber").alias("chamber"), F.explode("c.subcommittees").alias("s")).select(bill, "chamber", F.col("s.name").alias("name"), F.col("s.systemCode").alias("code"), F.explode_outer("s.activities").alias("a"))
    mains = top.select(bill, F.col("c.chamber").alias("chamber"), F.col("c.name").alias("name"), F.col("c.systemCode").alias("code"), F.explode_outer("c.activities").alias("a"))
    out = mains.unionByName(subs).select(bill, committee_code(F.col("code")).alias("committee_id"), F.col("name").alias("committee_name"), "chamber", F.col("a.name").alias("activity"), iso_date(F.col("a.date")).alias("happened_on"))
    return out.where("committee_id IS NOT NULL").dropDuplicates([bill, "committee_id", "activity", "happened_on"])


def ticker_register(spark: SparkSession, path: str) -> DataFrame:
    """(position, cik, ticker, title) from the register's one JSON object, keyed by position."""
    kind = "map<string, struct<cik_str: long, ticker: string, title: string>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("p", "v"))
    return rows.select(F.col("p").cast("int").alias("position"), F.col("v.cik_str").alias("cik"), F.col("v.ticker").alias("ticker"), F.col("v.title").alias("title"))


def first_of_register(register: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, ticker) and (ticker, title): the first position of the register stands for each name's key and for each ticker."""
    rows = register.withColumn("key", company_key(F.col("title"))).withColumn("ticker", F.upper(F.trim("ticker")))
    by_name = rows.where("key <> ''").groupBy("key").agg(F.min_by("ticker", "position").alias("ticker"))
    by_ticker = rows.where("ticker <> ''").groupBy("ticker").agg(F.min_by("title", "position").alias("title"))
    return by_name, by_ticker


def company_sic(pages: DataFrame, xml: str = "xml") -> DataFrame:
    """Industry code, its description and the company's name from a company page; entities are decoded twice."""

    def field(tag: str):
        value = F.regexp_extract(xml, rf"(?s)<{tag}>\s*(.*?)\s*</{tag}>", 1)
        for _ in range(2):
            for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
                value = F.replace(value, F.lit(entity), F.lit(char))
        return F.nullif(value, F.lit(""))

    return pages.select(*[c for c in pages.columns if c != xml], field("assigned-sic").alias("sic"), field("assigned-sic-desc").alias("sic_description"), field("conformed-name").alias("company_name"))


def clamp_filing_dates(filings: DataFrame, now) -> DataFrame:
    return filings.withColumn("filed_on", not_after(F.col("filed_on"), F.lit(now)))


def _elements(pages: DataFrame, xml: str, tag: str, schema: str) -> DataFrame:
    """One row for each element of a tag, at any depth, with its texts."""
    found = F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit(rf"(?s)(<{tag}>(?:(?!<{tag}>).)*?</{tag}>)"), 1)
    rows = pages.select(*[c for c in pages.columns if c != xml], F.posexplode(found).alias("n", "part"))
    return rows.withColumn("e", F.from_xml("part", schema, {"mode": "PERMISSIVE"})).drop("part")


def xml_assets(pages: DataFrame, xml: str = "xml") -> DataFrame:
    """Holdings of reports in XML that have a description: kind, value and income, each as a range."""
    rows = _elements(pages, xml, "Asset", "Description string, Value string, Income string")
    value, income = xml_band(F.col("e.Value")), xml_band(F.col("e.Income"))
    out = rows.withColumn("asset", F.trim("e.Description")).where("asset <> ''")
    return out.select(*[c for c in pages.columns if c != xml], "n", "asset", xml_asset_type(F.col("asset")).alias("asset_type"), *[b[e].alias(f"{n}_{m}") for n, b in (("value", value), ("income", income)) for e, m in (("low", "min"), ("high", "max"))])


def xml_incomes(pages: DataFrame, xml: str = "xml") -> DataFrame:
    """Incomes of reports in XML that have a source: its kind, the amount (a range's mean) and the stated type."""
    rows = _elements(pages, xml, "Income", "Source string, Amount string, Type string")
    out = rows.withColumn("source", F.trim("e.Source")).where("source <> ''")
    return out.select(*[c for c in pages.columns if c != xml], "n", "source", kind_by_words(F.col("source"), INCOME_SOURCES).alias("source_type"), xml_income(F.col("e.Amount")).alias("amount"), F.trim("e.Type").alias("income_type"))

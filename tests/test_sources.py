"""Readers over tiny payloads written for these tests."""

import json
from datetime import date
from decimal import Decimal

from tallyworks import schemas
from tallyworks.sources import grids, html, readers, sinks


def test_house_index(spark, tmp_path):
    member = "<Member><Last>{}</Last><First>A</First><FilingType>{}</FilingType><StateDst>MD06</StateDst><Year>2024</Year><FilingDate>{}</FilingDate><DocID>{}</DocID></Member>"
    rows = [("Ames", "P", "1/2/2024", 1), ("Bell", "O", "bad", 2), ("Cole", "C", "1/2/2024", 3)]
    (tmp_path / "x.xml").write_text("<FinancialDisclosure>" + "".join(member.format(*r) for r in rows) + "</FinancialDisclosure>")
    got = readers.house_index(spark, str(tmp_path / "x.xml"), ptr=True).collect()
    assert [(r.last, r.state, r.district, r.filed_on, r.is_ptr) for r in got] == [("Ames", "MD", "06", date(2024, 1, 2), True)]
    assert [(r.last, r.filed_on) for r in readers.house_index(spark, str(tmp_path / "x.xml")).collect()] == [("Bell", None)]


def _json(spark, tmp_path, value, schema):
    path = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
    path.write_text(json.dumps(value))
    return spark.read.schema(schema).option("multiLine", True).json(str(path))


def test_senate_search(spark, tmp_path):
    data = [["Ann", "Ames", "Ames, Ann", '<a href="/search/view/ptr/ab-1/">Periodic Transaction Report</a>', "01/02/2024"], ["B", "Bell", "x", '<a href="/search/view/annual/cd-2/">Annual</a>', "02/03/2024"], ["no", "link", "", "", ""]]
    got = readers.senate_rows(_json(spark, tmp_path, {"recordsTotal": 3, "data": data}, schemas.SENATE_SEARCH)).collect()
    assert [(r.document_id, r.last, r.is_ptr, r.filed_on) for r in got] == [("Sab-1", "Ames", True, date(2024, 1, 2)), ("Scd-2", "Bell", False, date(2024, 2, 3))]


def test_roster(spark, tmp_path):
    def person(i, last, end, kind="rep"):
        return {"id": {"bioguide": i, "fec": ["H1", "H2"]}, "name": {"first": "A", "last": last}, "terms": [{"type": "rep", "end": "2000-01-01", "state": "XX", "party": "R"}, {"type": kind, "end": end, "state": "MD", "district": "6", "party": "Democrat"}]}

    current = _json(spark, tmp_path, [person("A1", "New", "2030-01-01", "sen"), person("A3", "Gone", "2020-01-01")], schemas.ROSTER)
    old = _json(spark, tmp_path, [person("A1", "Old", "2010-01-01"), person("A2", "Past", "2010-01-01")], schemas.ROSTER)
    got = {r.bioguide_id: (r.last, r.chamber, r.party, r.in_office) for r in readers.roster(current, old, date(2024, 1, 1)).collect()}
    assert got == {"A1": ("New", "senate", "D", True), "A2": ("Past", "house", "D", False), "A3": ("Gone", "house", "D", False)}
    assert readers.candidate_members(readers.roster(current, old, date(2024, 1, 1))).count() == 6


def test_committees(spark):
    documents = lambda *texts: spark.createDataFrame([(t,) for t in texts], "text string")
    index = readers.committees(documents("- {type: house, name: Arms, thomas_id: HSAS, subcommittees: [{name: Sea, thomas_id: '28'}]}", "", None))
    assert sorted((r.committee_id, r.name, r.parent_id) for r in index.collect()) == [("HSAS", "Arms", None), ("HSAS28", "Arms - Sea", "HSAS")]
    members = spark.createDataFrame([("A1", 1)], "bioguide_id string, member_id long")
    seats = readers.committee_seats(documents("HSAS: [{bioguide: A1, rank: 2}, {bioguide: A1, rank: 1}, {bioguide: ZZ}]\nXX: [{bioguide: A1}]", "HSAS28:"), index, members)
    assert [(r.member_id, r.committee_id, r["rank"]) for r in seats.collect()] == [(1, "HSAS", 1)]


def test_events(spark, tmp_path):
    r = {"committee_id": "C1", "contributor_name": "PAC", "contribution_receipt_amount": 5.0, "contribution_receipt_date": "2024-01-02T00:00:00", "memo_code": None, "sub_id": "1"}
    pages = _json(spark, tmp_path, {"results": [r, r | {"memo_code": "X"}, r | {"contribution_receipt_amount": -1.0}, r | {"committee_id": "C9"}]}, schemas.RECEIPTS)
    got = readers.receipts(pages, spark.createDataFrame([("C1", 7)], "committee_id string, member_id long")).collect()
    assert [(g.member_id, g.amount, g.happened_on, g.external_id) for g in got] == [(7, Decimal("5.00"), date(2024, 1, 2), "1")]
    filing = {"filing_uuid": "u", "income": "0.00", "expenses": "7.50", "dt_posted": "2024-02-03T01:00:00-04:00", "registrant": {"name": "R"}, "client": {"name": "L on behalf of Acme"}, "lobbying_activities": [{"general_issue_code": c} for c in ("TAX", "DEF", "TAX", None)]}
    got = readers.lobbying(_json(spark, tmp_path, {"results": [filing]}, schemas.LOBBYING)).first()
    assert (got.amount, got.issue_codes, got.names, got.happened_on) == (Decimal("7.50"), "TAX,DEF", ["L on behalf of Acme", "Acme"], date(2024, 2, 3))
    award = {"Award ID": "A", "Mod": "P1", "Recipient Name": "Acme", "Transaction Amount": 9.5, "Action Date": "2024-01-02"}
    assert readers.award_actions(_json(spark, tmp_path, {"results": [award]}, schemas.AWARDS)).first().external_id == "A|P1|2024-01-02|9.5"


def test_bills(spark, tmp_path):
    bill = {"congress": 118, "type": "HR", "number": "1", "title": "t", "policyArea": None, "introducedDate": "2024-01-02"}
    got = readers.bills(_json(spark, tmp_path, [bill, bill | {"number": None}], schemas.BILLS)).collect()
    assert [(b.bill_type, b.number, b.policy_area, b.introduced_on) for b in got] == [("hr", "1", None, date(2024, 1, 2))]
    act = [{"name": "Referred", "date": "2024-01-02"}]
    payload = {"bill_id": 1, "committees": [{"name": "Ways", "chamber": "House", "systemCode": "hswm00", "activities": act + act, "subcommittees": [{"name": "Tax", "systemCode": "hswm05", "activities": act}]}]}
    got = readers.referrals(_json(spark, tmp_path, payload, "bill_id long, " + schemas.REFERRALS)).collect()
    assert sorted((r.committee_id, r.activity) for r in got) == [("HSWM", "Referred"), ("HSWM05", "Referred")]


def test_registers(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"0": {"cik_str": 1, "ticker": "AB", "title": "Abacus"}, "1": {"cik_str": 2, "ticker": "CD", "title": "Cedar"}}))
    assert sorted((r.position, r.ticker) for r in readers.ticker_register(spark, str(tmp_path / "t.json")).collect()) == [(0, "AB"), (1, "CD")]
    page = spark.createDataFrame([("AB", "<a><assigned-sic>3760</assigned-sic><assigned-sic-desc>MISSILES &amp;amp; SPACE</assigned-sic-desc></a>"), ("CD", None)], "ticker string, xml string")
    assert [(r.sic, r.sic_description) for r in readers.company_sic(page).collect()] == [("3760", "MISSILES & SPACE"), (None, None)]


PAGE = """<table><tr><th>#</th><th>Transaction Date</th><th>Owner</th><th>Ticker</th><th>Asset Name</th><th>Asset Type</th><th>Type</th><th>Amount</th><th>Comment</th></tr>
<tr><td>1</td><td>01/02/2024</td><td>Spouse</td><td>--</td><td>Acme <b>Corp</b></td><td>Stock</td><td>Sale (Full)</td><td>$1,001 - $15,000</td><td>n/a</td></tr></table><table><tr><td>other</td></tr></table>"""


def test_html(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>none</p>")], "page_id long, html string")
    rows = html.table_rows(pages, "page_id")
    assert rows.count() == 3
    got = html.senate_trades(rows, "page_id").collect()
    assert [(g.traded_on, g.owner, g.ticker, g.asset, g.direction, g.amount_min, g.amount_max, g.comment) for g in got] == [(date(2024, 1, 2), "Spouse", None, "Acme Corp", "sale", Decimal(1001), Decimal(15000), None)]


def test_grids(spark):
    grid = [["", ""], ["ID", "Owner", "Asset", "Transaction Type", "Date", "Amount"], ["", "SP", "Acme\x00 (ACM) [ST]", "P", "01/02/2024", "$1,001 - $15,000"], ["F S: Amended"], ["", "", "JT Bolt", "S (partial)", "01/03/2024", "$15,001 - $50,000"], [None, "", "no trade", "", "", ""]]
    docs = spark.createDataFrame([("d", [grid])], "document_id string, tables array<array<array<string>>>")
    got = grids.grid_trades(grids.grid_rows(docs)).orderBy("line").collect()
    assert [(g.owner, g.asset, g.ticker, g.direction, g.status, g.amount_max) for g in got] == [("Spouse", "Acme (ACM) [ST]", "ACM", "purchase", "Amended", Decimal(15000)), ("Joint", "Bolt", None, "sale", "New", Decimal(50000))]


def test_sinks(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "id % 2 AS part")
    for _ in range(2):
        sinks.write_table(df, str(tmp_path / "t"), by=["part"])
        sinks.append_failures(df, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 10 and spark.read.option("header", True).csv(str(tmp_path / "f")).count() == 20


def test_seats_are_read_one_at_a_time():
    """The same seats as the whole document gives, without building it."""
    import tracemalloc

    import yaml

    from tallyworks.sources.readers import _yaml_seats

    text = "A1: &all\n  - {bioguide: B1, rank: 1, title: &t 'Chair, x'}\n  - bioguide: '007'\n    title: *t\n    rank: ~\nA2:\nA3: [{bioguide: gone}]\nA4: *all\n'5':\n- !!map {bioguide: no, extra: [1, {a: 2.5}]}\nA3: [{bioguide: stays}]\n"
    want = sorted((c, repr(p)) for c, people in yaml.safe_load(text).items() for p in people or [])
    assert sorted((c, repr(p)) for c, p in _yaml_seats(text)) == want and len(want) == 6
    assert list(_yaml_seats("")) == list(_yaml_seats("~")) == list(_yaml_seats("{}")) == []
    long = "A:\n" + "".join(f"  - {{bioguide: B{k}, rank: {k}}}\n" for k in range(20_000))
    tracemalloc.start()
    assert sum(p["rank"] for _, p in _yaml_seats(long)) == sum(range(20_000))
    assert tracemalloc.get_traced_memory()[1] < 3_000_000
    tracemalloc.stop()


def test_senate_tables_are_read_in_one_pass(spark):
    """Rows meet their header without a join, and the printed parts are dealt over tasks."""
    from tallyworks.plans.queries import payloads
    from tallyworks.plans.workload import Workload
    from tallyworks.sources import html

    rows = [
        (1, 0, 0, ["#", "Asset", "Asset Type", "Value", "Income"], None, "Part 3. Assets"),
        (1, 0, 1, ["7", "Fund", "Stock", "$1,001 - $15,000", ""], "Fund", "Part 3. Assets"),
        (1, 0, 2, ["7.1", "In", "Stock", "$1,001 - $15,000", ""], "In", "Part 3. Assets"),
        (1, 0, 3, ["8", "Alone", "Stock", "Over $50,000,000", "None (or less than $201)"], "Alone", "Part 3. Assets"),
        (1, 0, 4, ["9", "Outer", "Stock", "$1,001 - $15,000", ""], "Outer", "Part 3. Assets"),
        (1, 0, 5, ["9.1", "Empty", "Stock", "--", ""], "Empty", "Part 3. Assets"),
        (1, 1, 1, ["7", "Later", "Stock", "$5 - $6", ""], "Later", "Part 3. Assets"),
        (2, 0, 1, ["7", "Headless", "Stock", "$5 - $6", ""], "Headless", "Part 3. Assets"),
        (None, 0, 0, ["#", "Value"], None, "Part 3. Assets"),
        (None, 0, 1, ["7", "$5 - $6"], "Lost", "Part 3. Assets"),
    ]
    table = spark.createDataFrame(rows, "k long, table int, row int, cells array<string>, strong string, heading string")
    found = html.senate_assets(table, "k")
    assert "Join " not in found._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.asset, r.value_min, r.value_max, r.income_max) for r in found.collect())
    assert got == [("Alone", 50000001, None, 200), ("Empty", None, None, None), ("Fund", None, None, None), ("In", 1001, 15000, None), ("Outer", 1001, 15000, None)]
    assert payloads._parts(Workload(spark, "/root/testdata/sf0.001")).select("part_id").rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism

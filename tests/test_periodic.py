"""Periodic reports with broken tables, record by record."""

from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from tallyworks.sources import periodic

DOCUMENT = "document_id string, tables array<array<array<string>>>"
LINE = "document_id string, page int, line int, text string"
HEAD = ["ID", "Owner", "Asset", "Transaction\nType", "Date", "Notification\nDate", "Amount"]


def lines_of(spark, **texts):
    return spark.createDataFrame([(d, 0, k, x) for d, t in texts.items() for k, x in enumerate(t.split("\n"))], LINE).repartition(3)


def test_one_line(spark):
    cases = {
        "SP Acme Corp (ACM) [ST] P 01/02/2024 01/05/2024 $1,001 - $15,000": ("Spouse", "Acme Corp (ACM) [ST]", "ACM", "purchase", date(2024, 1, 2), date(2024, 1, 5), 1001, 15000),
        "Best Buy Co., Inc. Common Stock (BBY) S 02/23/2024 $15,001 - $50,000": ("Self", "Best Buy Co., Inc. Common Stock (BBY)", "BBY", "sale", date(2024, 2, 23), None, 15001, 50000),
        "Wells Fargo 6.491 10/23/34 '33 MTN S 05/13/2025 05/15/2025 $50,001 - $100,000": ("Self", "Wells Fargo 6.491 10/23/34 '33 MTN", None, "sale", date(2025, 5, 13), date(2025, 5, 15), 50001, 100000),
        "JT Purchase Point Media Corp E 01/02/24 Over $50,000,000": ("Joint", "Purchase Point Media Corp", None, "exchange", date(2024, 1, 2), None, 50000001, None),
        "SAP SE ADS (SAP) [ST] S (partial) 03/04/2024 $1,001 - $15,000": ("Self", "SAP SE ADS (SAP) [ST] S (partial)", "SAP", "sale", date(2024, 3, 4), None, 1001, 15000),
        "An asset that was sold for $1,001 - $15,000": ("Self", "An asset that was sold for", None, "sale", None, None, 1001, 15000),
        "Acme Corp (ACM) purchase with a broken band 01/02/2024 $15,001 -": ("Self", "Acme Corp (ACM) purchase with a broken band", "ACM", "purchase", date(2024, 1, 2), None, None, None),
        "F S: New, with no date and no money at all": None,
        "P 01/02/2024 $5": None,
        "P 01/02/2024 $1,001 - $15,000 and more": None,
        "A sentence of 01/02/2024 without any kind": None,
        "": None,
        None: None,
    }
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(cases)], "k int, x string").select("k", periodic.line_trade(periodic.spelled(F.col("x"))).alias("t"))
    got = {r.k: r.t and (r.t.owner, r.t.asset, r.t.ticker, r.t.direction, r.t.traded_on, r.t.notified_on, r.t.amount_min, r.t.amount_max) for r in rows.collect()}
    number = lambda t: t and (*t[:6], *[None if x is None else Decimal(x) for x in t[6:]])
    assert got == {k: number(t) for k, t in enumerate(cases.values())}


def test_lines_that_break_off(spark):
    text = "a $15,001 -\n[ST] $50,000 tail\nb over\n$1,000,000\nc $1 -\nd $2 -\ne $3\nf $4 -\nno figure\n\ng above"
    got = periodic.whole_lines(lines_of(spark, d=text)).orderBy("line").collect()
    assert [r.text for r in got] == ["a $15,001 - $50,000 tail", "b over $1,000,000", "c $1 - $2 d   -", "e $3", "f $4 - no figure", "", "g above"]


def test_tables_with_collapsed_records_and_lost_headers(spark):
    whole = ["", "SP", "Acme\x00 (ACM) [ST]", "P", "01/02/2024", "01/05/2024", "$1,001 - $15,000"]
    one = ["JT Bolt Stock (BLT) S 01/03/2024 01/09/2024 $15,001 -\n[ST] $50,000\nF\x00 S\x00: Amended\nD: sold on 01/03/2024", "", "", "", "", "", ""]
    note = ["", "D: see 01/02/2024", "", "", "", "", ""]
    table = [["", ""], HEAD, whole, note, ["F\x00 S\x00: Deleted"], one, ["[ST]", "", "", "", "", "", "$50,000"], ["", "", "", "", "01/04/2024", "", ""], ["Cap. Gains > $200?"]]
    docs = spark.createDataFrame([("a", [table]), ("b", [[whole, whole]]), ("c", None), ("d", [[HEAD[:2] + ["Amount"], ["", "", "x"]]])], DOCUMENT)
    got = periodic.table_trades(periodic.raw_rows(docs)).orderBy("line").collect()
    assert [(r.document_id, r.owner, r.asset, r.direction, r.traded_on, r.notified_on, r.amount_max, r.status, r.collapsed) for r in got if r.asset] == [
        ("a", "Spouse", "Acme (ACM) [ST]", "purchase", date(2024, 1, 2), date(2024, 1, 5), Decimal(15000), "Deleted", False),
        ("a", "Joint", "Bolt Stock (BLT)", "sale", date(2024, 1, 3), date(2024, 1, 9), Decimal(50000), "Amended", True),
    ]
    assert [(r.line, r.collapsed) for r in got if not r.asset] == [(7, False)] and {r.document_id for r in got} == {"a"}


def test_printed_trades_that_no_table_has(spark):
    row = ["", "", "Acme Holdings (ACM)", "P", "01/02/2024", "", "$1,001 - $15,000"]
    docs = spark.createDataFrame([("a", [[HEAD, row, row]])], DOCUMENT)
    line = "Acme Holdings (ACM) P 01/02/2024 $1,001 - $15,000"
    text = "\n".join([line, line, line.replace("1,001 - $15,000", "15,001 - $50,000"), "SP Acme Holdings (ACM) P 01/02/2024 $1,001 - $15,000", line.replace(" P ", " S (partial) "), "no trade"])
    found, quality = periodic.trades(docs, lines_of(spark, a=text, b=line + "\nF S: Deleted", c=""))
    got = sorted((r.document_id, r.owner, r.direction, r.amount_max, r.status, r.recovered) for r in found.collect())
    assert got == [
        ("a", "Self", "purchase", Decimal(15000), "New", False),
        ("a", "Self", "purchase", Decimal(15000), "New", False),
        ("a", "Self", "purchase", Decimal(50000), "New", True),
        ("a", "Self", "sale", Decimal(15000), "New", True),
        ("a", "Spouse", "purchase", Decimal(15000), "New", True),
        ("b", "Self", "purchase", Decimal(15000), "Deleted", False),
    ]
    assert [tuple(r) for r in quality.collect()] == [("a", 5, 5, 3, False, True, 1.0)]
    _, quality = periodic.trades(spark.createDataFrame([("b", None), ("c", None), ("z", None)], DOCUMENT), lines_of(spark, b=line + "\nF S: Deleted", c=" "))
    assert {r.document_id: (r.rows_read, r.used_lines, r.confidence) for r in quality.collect()} == {"b": (1, True, 0.5), "c": (0, False, 0.0), "z": (0, False, 0.0)}


def test_grids_are_read_in_one_pass(spark):
    """Rows meet their header and their footnote without a second pass over the tables; a table without a header has no trades."""
    from tallyworks.sources import grids

    head = ["Asset", "Type", "Date", "Amount"]
    grid = [["x"] * 4, head, ["AB\x00 Co", "P", "1/2/2020", "$1,001 - $15,000"], ["F S: Amended", "", "", ""], ["CD Co", "S", "2/2/2020", "Over $50,000,000"], ["none", "", "", "$5"]]
    rows = grids.grid_rows(spark.createDataFrame([(1, [grid, grid[2:]]), (2, None)], "document_id long, tables array<array<array<string>>>"))
    found = grids.grid_trades(rows)
    assert "Join Inner" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.page, r.line, r.asset, r.direction, r.amount_min, r.amount_max, r.status) for r in found.collect())
    assert got == [(0, 2, "AB Co", "purchase", 1001, 15000, "Amended"), (0, 4, "CD Co", "sale", 50000001, None, "New")]


def test_a_line_is_read_once(spark):
    """No filter reads a printed trade a second time, or reads lines that the tables have; lines that break off are found in one order."""
    lines = lines_of(spark, a="Acme Holdings (ACM) P 01/02/2024 $1,001 - $15,000")
    read = spark.createDataFrame([], "document_id string, asset string, traded_on date, direction string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    once = plan(lines.select(periodic.line_trade(periodic.spelled(F.col("text"))).alias("t"))).count("regexp_instr")
    assert plan(periodic.unread_trades(lines, read)).count("regexp_instr") == once > 0
    assert periodic.whole_lines(lines)._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1


def test_tables_and_lines_print_the_same_stored_trades(spark, sf):
    from tallyworks.plans.layouts import periodic_documents
    from tallyworks.plans.workload import Workload

    for df in periodic_documents(Workload(spark, sf)):
        assert "lineitem" not in "".join(df.inputFiles())

"""Tables in HTML as rows of cells, and the Senate's reports from them."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import parse_date
from ..functions.money import senate_band
from ..functions.text import comment, direction, owner_name, senate_asset_type, ticker_in


class _Tables(HTMLParser):
    """Cells of every table, by table and row, with the heading before it; text of nested tags joins its cell."""

    def __init__(self):
        super().__init__()
        #: table, row, cells, the first strong text of the row, the heading before the table
        self.rows: list[list] = []
        self.table, self.row, self.cell, self.skip = -1, -1, None, 0
        self.title, self.strong, self.heading, self.above = None, False, "", ""

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.table, self.row, self.above = self.table + 1, -1, self.heading
        elif tag == "tr" and self.table >= 0:
            self.row += 1
            self.rows.append([self.table, self.row, [], None, self.above])
            self.cell = None
        elif tag in ("td", "th") and self.rows and self.row >= 0:
            self.rows[-1][2].append("")
            self.cell = self.rows[-1][2]
        elif tag in ("h2", "h3", "h4"):
            self.title = ""
        elif tag == "strong" and self.cell is not None and self.rows[-1][3] is None:
            self.rows[-1][3], self.strong = "", True
        elif tag in ("script", "style"):
            self.skip += 1

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self.cell, self.strong = None, False
        elif tag == "strong":
            self.strong = False
        elif tag in ("h2", "h3", "h4") and self.title is not None:
            self.heading, self.title = " ".join(self.title.split()), None
        elif tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)

    def handle_data(self, data):
        if self.cell is not None and not self.skip:
            self.cell[-1] += data
            if self.strong:
                self.rows[-1][3] += data
        elif self.title is not None:
            self.title += data


def table_rows(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, table, row, cells, strong, heading): rows of all tables; a null page has none, white space is single.

    ``strong`` is a row's first emphasised text, ``heading`` the last heading before its table.
    """
    schema = T.StructType([pages.schema[key], T.StructField("table", T.IntegerType()), T.StructField("row", T.IntegerType()), T.StructField("cells", T.ArrayType(T.StringType())), T.StructField("strong", T.StringType()), T.StructField("heading", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, tables, rows, cells, strong, above = [], [], [], [], [], []
            for k, page in enumerate(batch.column(1)):
                if (source := page.as_py()) is None:
                    continue
                parser = _Tables()
                parser.feed(source)
                for t, r, c, name, heading in parser.rows:
                    at.append(k)
                    tables.append(t)
                    rows.append(r)
                    cells.append([" ".join(x.split()) for x in c])
                    strong.append(name and " ".join(name.split()))
                    above.append(heading)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(tables, pa.int32()), pa.array(rows, pa.int32()), pa.array(cells, pa.list_(pa.string())), pa.array(strong, pa.string()), pa.array(above, pa.string())], names=[key, "table", "row", "cells", "strong", "heading"])

    return pages.select(key, html).mapInArrow(run, schema)


def senate_trades(rows: DataFrame, key: str) -> DataFrame:
    """Trades from tables whose header names a date, an asset and an amount; other tables are none of theirs."""
    head = F.max(F.when(F.col("row") == 0, F.transform("cells", lambda c: F.lower(F.trim(c))))).over(Window.partitionBy(key, "table"))
    need = F.exists("head", lambda c: c.contains("amount")) & F.exists("head", lambda c: c.contains("date")) & F.exists("head", lambda c: c.contains("asset") | c.contains("description"))
    body = rows.where(F.col(key).isNotNull()).withColumn("head", head).where("row > 0").where(need)

    def cell(*words: str):
        position = None
        for w in words:
            p = F.nullif(F.coalesce(F.array_position(F.transform("head", lambda c: c.contains(w)), True), F.lit(0)), F.lit(0))
            position = p if position is None else F.coalesce(position, p)
        return F.get("cells", (position - 1).cast("int"))

    body = body.withColumn("amount", cell("amount")).withColumn("band", senate_band(F.col("amount")))
    band = F.col("band")
    return body.select(
        key,
        "table",
        "row",
        parse_date(cell("transaction date", "date")).alias("traded_on"),
        owner_name(cell("owner")).alias("owner"),
        F.nullif(cell("ticker"), F.lit("--")).alias("ticker"),
        cell("asset name", "description", "asset").alias("asset"),
        direction(F.coalesce(F.nullif(F.get("cells", (F.array_position("head", "type") - 1).cast("int")), F.lit("")), cell("type"))).alias("direction"),
        band["low"].alias("amount_min"),
        band["high"].alias("amount_max"),
        comment(cell("comment")).alias("comment"),
    )


def _part(rows: DataFrame, key: str, part: str) -> DataFrame:
    """Body rows of the first table under a numbered part's heading, with the header's labels."""
    page = Window.partitionBy(key)
    under = rows.where(F.col("heading").startswith(part) & F.col(key).isNotNull())
    here = under.withColumn("first", F.min("table").over(page)).where("table = first").drop("first")
    head = F.max(F.when(F.col("row") == 0, F.transform("cells", lambda c: F.lower(c)))).over(page)
    return here.withColumn("head", head).where("row > 0 AND head IS NOT NULL")


def _named(label: str) -> Column:
    return F.get("cells", (F.nullif(F.coalesce(F.array_position("head", label), F.lit(0)), F.lit(0)) - 1).cast("int"))


def senate_assets(rows: DataFrame, key: str) -> DataFrame:
    """Holdings of annual reports (Part 3): name, ticker, kind, value and income.

    A holding whose contents the report lists below it with values (7, then 7.1) keeps no
    value of its own, so nothing is counted twice.
    """
    body = _part(rows, key, "Part 3").where(F.array_contains("head", "value")).withColumn("number", F.get("cells", 0))
    body = body.withColumns({"said": _named("value"), "earned": _named("income"), "kind": _named("asset type")})
    body = body.withColumns({"v": senate_band(F.col("said")), "i": senate_band(F.col("earned")), "within": F.substring_index("number", ".", 1)})
    listed = F.max(F.when(F.contains("number", F.lit(".")) & F.col("v.low").isNotNull(), True)).over(Window.partitionBy(key, "within"))
    body = body.withColumn("itemised", F.when(F.col("number") == F.col("within"), listed)).where(F.coalesce("strong", F.lit("")) != "")
    own = lambda c: F.when(F.col("itemised").isNull(), F.col(c))
    return body.select(key, "row", F.col("strong").alias("asset"), ticker_in(F.col("strong")).alias("ticker"), senate_asset_type(F.col("kind")).alias("asset_type"), own("v.low").alias("value_min"), own("v.high").alias("value_max"), F.col("i.low").alias("income_min"), F.col("i.high").alias("income_max"))


def senate_debts(rows: DataFrame, key: str) -> DataFrame:
    """Debts of annual reports (Part 7) with a creditor and an amount that can be read."""
    body = _part(rows, key, "Part 7").withColumns({"amount": _named("amount"), "creditor": _named("creditor")}).withColumn("a", senate_band(F.col("amount")))
    body = body.where((F.coalesce("creditor", F.lit("")) != "") & F.col("a.low").isNotNull())
    return body.select(key, "row", "creditor", _named("type").alias("description"), F.col("a.low").alias("amount_min"), F.col("a.high").alias("amount_max"))

"""Periodic reports as captured cell grids: header, rows, footnotes, all with DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.money import band
from ..functions.text import direction, filing_status, owner_in, owner_name, squeeze, strip_nul, ticker_in, without_owner


def grid_rows(documents: DataFrame, key: str = "document_id", tables: str = "tables") -> DataFrame:
    """(key, page, line, cells) from nested arrays of cells; NULs go, null cells are empty."""
    rows = documents.select(key, F.posexplode(tables).alias("page", "grid")).select(key, "page", F.posexplode("grid").alias("line", "cells"))
    return rows.withColumn("cells", F.transform("cells", lambda c: squeeze(strip_nul(c))))


def grid_trades(rows: DataFrame, key: str = "document_id") -> DataFrame:
    """Trades of grids: a table's header is its first line (of four) with a date and an amount column.

    A footnote line gives its status to the trade above it. Lines without a direction or an
    amount are no trades. Missing owners are taken from a code in front of the asset.
    """
    lower = F.transform("cells", lambda c: F.lower(c))
    is_head = (F.col("line") < 4) & F.exists(lower, lambda c: c.contains("amount")) & F.exists(lower, lambda c: c.contains("date"))
    # header, rows and footnotes come from one pass over a table: the header by its least line, a footnote from the next line
    table = Window.partitionBy(key, "page")
    note = filing_status(F.array_join("cells", "\n"))
    marked = rows.select(key, "page", "line", "cells", F.when(F.col("line") < 4, F.when(is_head, F.struct(F.col("line").alias("at"), lower.alias("head")))).alias("h"), note.alias("said"))
    marked = marked.withColumn("note", F.lead("said").over(table.orderBy("line"))).withColumn("h", F.min("h").over(table))
    body = marked.where(F.col("line") > F.col("h.at")).select(key, "page", "line", "cells", "note", F.col("h.head").alias("head"))

    def cell(*words: str):
        hit = F.transform("head", lambda c: F.coalesce(*[F.when(c.contains(w), True) for w in words], F.lit(False)))
        return F.get("cells", (F.nullif(F.array_position(hit, True), F.lit(0)) - 1).cast("int"))

    named = {"owner": ("owner",), "asset": ("asset", "description"), "type": ("transaction type", "type"), "day": ("date",), "amount": ("amount",)}
    body = body.select(key, "page", "line", "note", *[cell(*words).alias(name) for name, words in named.items()])
    # the cells and both ends are columns of their own, so that each is computed once
    body = body.withColumns({"kind": direction(F.col("type")), "band": band(F.col("amount"))}).where("kind IS NOT NULL AND band.low IS NOT NULL")
    asset, amount, kind, owner = F.col("asset"), F.col("band"), F.col("kind"), F.nullif("owner", F.lit(""))
    out = body.select(
        key,
        "page",
        "line",
        F.coalesce(F.when(owner.isNotNull(), owner_name(owner)), owner_in(asset), F.lit("Self")).alias("owner"),
        without_owner(asset).alias("asset"),
        ticker_in(asset).alias("ticker"),
        kind.alias("direction"),
        parse_date(F.regexp_extract(F.coalesce("day", F.lit("")), r"\d{1,2}/\d{1,2}/\d{2,4}", 0)).alias("traded_on"),
        amount["low"].alias("amount_min"),
        amount["high"].alias("amount_max"),
        F.coalesce("note", F.lit("New")).alias("status"),
    )
    return out

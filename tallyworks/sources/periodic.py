"""Periodic reports whose tables are broken: records in one cell, tables without headings, trades in no table.

What a table gives is read by its columns (``table_trades``). A record that came as one cell, and a
line of the text, are read from the type that stands in front of the date: what is left of
it is the asset, what is right of it dates and the amount. Where a document has tables, its
printed lines are counted against the trades read from them, and those beyond are added;
where it has none, all its lines are read. Lines belong to the trade above them: an amount
that breaks off takes its other end from the next line, and a footnote its status to the
trade before. Both are windows over a document's lines in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.fixed import BUY_WORDS, EXCHANGE_WORDS, HEADER_ROWS, HEADER_WORDS, HEADER_WORDS_NEEDED, NO_TRADE_WORDS, READABLE_WORDS, SELL_WORDS
from ..functions.money import band, ptr_confidence
from ..functions.text import asset_type, direction, direction_in, filing_status, owner_in, owner_name, rejoin_wrapped, squeeze, strip_nul, ticker_in, without_owner
from ..session import settled

DATE = r"\d{1,2}/\d{1,2}/\d{2,4}"
_ANCHOR = rf"(?i)\b(?:purchase|sale|exchange|[PSE])\s+(?={DATE})"
_AMOUNT = r"(?i)(\$[\d,]+\s*-\s*\$[\d,]+|(?:over|above|more than)\s+\$[\d,]+|\$[\d,]+\s*\+)"
_LAST_TYPE = rf"(?i)\s*\b(?:{'|'.join([*BUY_WORDS, *SELL_WORDS, *EXCHANGE_WORDS])})\b\s*$"
_FOOTNOTE = r"^\s*(?:F\s+S\s*:|S\s+O\s*:|D\s*:|L\s*:)"
_PRINTED = r"^(.*?)\s+([PSE])(?: \(partial\))? (\d{1,2}/\d{1,2}/\d{4})\b"
TRADE = ["owner", "asset", "ticker", "asset_type", "direction", "traded_on", "notified_on", "amount_min", "amount_max"]


def _word_in(words: list[str], line: Column) -> Column:
    return line.rlike(rf"(?i)\b({'|'.join(words)})\b")


def _let(value: Column, make) -> Column:
    """``make`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), make), 0)


def spelled(line: Column) -> Column:
    """The line with the letter of a type, in front of the first date that has one, as a word."""

    def word(x: Column) -> Column:
        to = lambda name: F.regexp_replace(x["line"], rf"^(.*?)\b[PSE]\s+(?={DATE})", rf"$1{name} ")
        letter = x["letter"]
        return F.when(letter == "P", to("purchase")).when(letter == "S", to("sale")).when(letter == "E", to("exchange")).otherwise(x["line"])

    return _let(line, lambda x: _let(F.struct(x.alias("line"), F.regexp_extract(x, rf"\b([PSE])\s+(?={DATE})", 1).alias("letter")), word))


def line_trade(line: Column) -> Column:
    """struct of TRADE from one line, null if it is no trade.

    The date is the first after the type, so a date in an asset's name is none; without a type
    in front of a date it is the first of the line. The word before the date is the type, else
    any word of buying, selling or exchanging.
    """

    def dates(x: Column) -> Column:
        past = _let(F.regexp_instr(x, F.lit(_ANCHOR)), lambda at: F.when(at > 0, at + F.length(F.regexp_extract(x, _ANCHOR, 0))).otherwise(F.regexp_instr(x, F.lit(DATE))))
        return _let(F.struct(x.alias("line"), past.alias("past"), F.regexp_extract(x, _AMOUNT, 1).alias("amount")), parts)

    def parts(a: Column) -> Column:
        line, past, dated = a["line"], a["past"], a["past"] > 0
        before = F.when(dated, F.substr(line, F.lit(1), past - 1)).otherwise("")
        rest = F.when(dated, F.substr(line, past, F.lit(1 << 30))).otherwise("")
        days = F.regexp_extract_all(rest, F.lit(f"({DATE})"), 1)
        head = F.when(dated, before).when(a["amount"] != "", F.substr(line, F.lit(1), F.regexp_instr(line, F.lit(_AMOUNT)) - 1)).otherwise(line)
        word = F.regexp_extract(before, r"([A-Za-z]+)\s*$", 1)
        asset = squeeze(F.regexp_replace(F.trim(head), _LAST_TYPE, ""))
        return _let(F.struct(line.alias("line"), a["amount"].alias("amount"), days.alias("days"), word.alias("word"), asset.alias("asset")), kinds)

    def kinds(c: Column) -> Column:
        words = [F.when(_word_in(w, c["line"]), F.lit(name)) for name, w in (("purchase", BUY_WORDS), ("sale", SELL_WORDS), ("exchange", EXCHANGE_WORDS))]
        # a letter of the form has become one of these words
        known = F.when(c["word"].isin("purchase", "sale", "exchange"), c["word"])
        kind = F.coalesce(known, F.when(c["word"] != "", direction(c["word"])), *words)
        ends = F.when(c["amount"] != "", band(c["amount"]))
        more = F.struct(c.alias("c"), without_owner(c["asset"]).alias("own"), ends.alias("ends"))
        return F.when(c["asset"] != "", _let(kind, lambda k: F.when(k.isNotNull(), _let(more, lambda m: fields(k, m["c"], m["own"], m["ends"])))))

    def fields(kind: Column, c: Column, own: Column, ends: Column) -> Column:
        made = {
            "owner": F.coalesce(owner_in(c["asset"]), F.lit("Self")),
            "asset": own,
            "ticker": ticker_in(own),
            "asset_type": asset_type(own),
            "direction": kind,
            "traded_on": parse_date(F.get(c["days"], 0)),
            "notified_on": parse_date(F.get(c["days"], 1)),
            "amount_min": ends["low"],
            "amount_max": ends["high"],
        }
        return F.struct(*[x.alias(n) for n, x in made.items()])

    # most lines are none, and a type without a date behind it is no date either
    return _let(line, lambda x: F.when((F.length(x) >= 20) & (x.contains("$") | x.rlike(DATE)), dates(x)))


# ---------------------------------------------------------------- tables


def headings(rows: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, page, at, asset, type, date, amount, owner, notified, recognised): the header of each table and where its columns are.

    The header is the first of the first HEADER_ROWS rows with HEADER_WORDS_NEEDED of the
    form's words; columns that it does not name are taken to be where the form has them,
    in the order asset, type, date, amount, owner.
    """
    words = _let(F.lower(F.array_join("cells", " ")), lambda x: sum(F.when(x.contains(w), 1).otherwise(0) for w in HEADER_WORDS))
    heads = rows.where((F.col("line") < HEADER_ROWS) & (words >= HEADER_WORDS_NEEDED)).groupBy(key, "page").agg(F.min("line").alias("at"), F.min_by("cells", "line").alias("head"))
    lower = F.transform("head", lambda c: F.lower(c))

    def role(c: Column) -> Column:
        names = (("notified", ["notification"]), ("asset", ["asset", "description", "name"]), ("type", ["type", "transaction"]), ("date", ["date"]), ("amount", ["amount", "value"]), ("owner", ["owner", "filer"]))
        out = F.when(F.lit(False), F.lit(""))
        for name, words in names:
            hit = c.contains(words[0])
            for w in words[1:]:
                hit = hit | c.contains(w)
            out = out.when(hit, name)
        return out

    roles = F.transform(lower, role)
    # of several columns with a role the last has it
    last = lambda name: F.nullif(F.size(roles) - F.array_position(F.reverse(roles), name), F.size(roles))
    places = [F.coalesce(last(name), F.lit(place)).alias(name) for place, name in enumerate(("asset", "type", "date", "amount", "owner"))]
    whole = F.array_join(lower, " ")
    known = F.exists(F.array(*[F.lit(w) for w in READABLE_WORDS]), lambda w: whole.contains(w))
    return heads.select(key, "page", "at", *places, last("notified").alias("notified"), known.alias("recognised"))


def raw_rows(documents: DataFrame, key: str = "document_id", tables: str = "tables") -> DataFrame:
    """(key, page, line, cells, raw): rows of all tables; ``raw`` keeps the cells' own line ends."""
    rows = documents.select(key, F.posexplode(tables).alias("page", "grid")).select(key, "page", F.posexplode("grid").alias("line", "raw"))
    rows = rows.withColumn("raw", F.transform("raw", lambda c: F.trim(strip_nul(c))))
    return rows.withColumn("cells", F.transform("raw", lambda c: squeeze(c)))


def table_trades(rows: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, page, line, TRADE, status, collapsed) of ``raw_rows``, and rows that look like trades but are none, with a null asset.

    A row is looked at if a line of it that is no footnote has a date. If all its text is in
    the first cell, that cell's lines are read one by one, wrapped amounts joined, and the
    first trade is the row's. A footnote below gives its status to the trade above it.
    """
    body = rows.join(headings(rows, key), [key, "page"]).where("line > at")
    joined = F.array_join("raw", " ")
    lines = F.split(joined, "\n")
    dated = F.exists(lines, lambda x: x.rlike(DATE) & ~x.rlike(_FOOTNOTE))
    body = body.withColumn("looks", (F.trim(joined) != "") & dated).withColumn("note", filing_status(joined))
    group = F.sum(F.when(F.col("looks"), 1).otherwise(0)).over(Window.partitionBy(key, "page").orderBy("line"))
    body = body.withColumn("group", group)
    below = F.first(F.when(~F.col("looks"), F.col("note")), ignorenulls=True).over(Window.partitionBy(key, "page", "group").orderBy("line").rowsBetween(1, Window.unboundedFollowing))
    body = body.withColumn("status", F.coalesce("note", below, F.lit("New"))).where("looks")
    cell = lambda name: F.coalesce(F.get("cells", F.col(name).cast("int")), F.lit(""))
    day = lambda name: parse_date(F.regexp_extract(cell(name), DATE, 0))
    body = body.withColumn("own", without_owner(cell("asset"))).withColumn("band", band(cell("amount")))
    asset, amount = F.col("own"), F.col("band")
    by_columns = F.struct(
        F.coalesce(owner_in(cell("asset")), owner_name(F.when(F.col("owner") != F.col("asset"), cell("owner")))).alias("owner"),
        asset.alias("asset"),
        ticker_in(asset).alias("ticker"),
        asset_type(asset).alias("asset_type"),
        F.coalesce(direction(cell("type")), direction_in(asset)).alias("direction"),
        day("date").alias("traded_on"),
        F.when(F.col("notified").isNotNull(), day("notified")).alias("notified_on"),
        amount["low"].alias("amount_min"),
        amount["high"].alias("amount_max"),
    )
    by_columns = F.when(day("date").isNotNull() & ((asset != "") | (cell("type") != "")), by_columns)
    alone = (F.size(F.filter("cells", lambda c: c != "")) == 1) & (F.get("cells", 0) != "")
    body = body.withColumn("alone", alone).withColumn("pieces", F.when(F.col("alone"), rejoin_wrapped(F.split(F.get("raw", 0), "\n"))))
    body = body.withColumn("found", F.filter(F.transform("pieces", lambda x: line_trade(spelled(x))), lambda t: t.isNotNull()))
    out = body.select(key, "page", "line", F.when(F.col("alone"), F.get("found", 0)).otherwise(by_columns).alias("t"), "status", F.col("alone").alias("collapsed"), "recognised")
    return out.select(key, "page", "line", "t.*", "status", "collapsed", "recognised")


# ---------------------------------------------------------------- lines


def whole_lines(lines: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, page, line, text) with wrapped amounts in one line again, over the end of a page too.

    A line that breaks off takes the next, which then breaks off nothing itself; so of lines
    that break off one after another every second one is taken.
    """
    order = Window.partitionBy(key).orderBy("page", "line")
    text = F.regexp_replace(strip_nul(F.col("text")), r"\s+$", "")
    rows = lines.select(key, "page", "line", text.alias("text"))
    rows = rows.withColumn("opens", F.col("text").rlike(r"\$[\d,]+\s*[-–—]\s*$") | F.col("text").rlike(r"(?i)\b(over|above|more than)\s*$"))
    # the place in a run is the count of lines that break off less that at the last line that does not, so all windows share one order
    rows = rows.withColumn("broken", F.sum(F.when(F.col("opens"), 1).otherwise(0)).over(order))
    rows = rows.withColumn("nth", F.col("broken") - F.coalesce(F.max(F.when(~F.col("opens"), F.col("broken"))).over(order), F.lit(0)))
    rows = rows.withColumn("takes", F.col("opens") & (F.col("nth") % 2 == 1))
    rows = rows.withColumn("next", F.lead("text").over(order)).withColumn("taken", F.coalesce(F.lag("takes").over(order), F.lit(False)))
    met = F.get(rejoin_wrapped(F.array("text", "next")), 0)
    return rows.where("NOT taken").select(key, "page", "line", F.when(F.col("takes") & F.col("next").isNotNull(), met).otherwise(F.col("text")).alias("text"))


def line_trades(lines: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, page, line, TRADE, status) of documents that have nothing but lines; lines with words of the form's own are passed over."""
    order = Window.partitionBy(key).orderBy("page", "line")
    rows = whole_lines(lines, key)
    own = F.lower("text").rlike("|".join(NO_TRADE_WORDS))
    rows = rows.select(key, "page", "line", F.when(~own, line_trade(spelled(F.col("text")))).alias("t"), filing_status(F.col("text")).alias("note"))
    rows = rows.withColumn("group", F.sum(F.when(F.col("t").isNotNull(), 1).otherwise(0)).over(order))
    note = F.first("note", ignorenulls=True).over(Window.partitionBy(key, "group").orderBy("page", "line").rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn("status", F.coalesce(note, F.lit("New"))).where("t IS NOT NULL").select(key, "page", "line", "t.*", "status")


def trade_key(asset: Column) -> Column:
    """The first sixteen letters and figures of an asset, without a number, an owner's code or a type around it."""
    head = F.trim(F.regexp_replace(F.coalesce(asset, F.lit("")), "\n", " "))
    head = F.regexp_replace(F.regexp_replace(head, r"^\d{6,}\s+", ""), r"(?i)^(SP|JT|DC)\s+", "")
    head = F.regexp_replace(head, r"(?i)\s*\b(?:[PSE]|purchase|sale|exchange)(?:\s*\(partial\))?\s*$", "")
    return F.substring(F.regexp_replace(F.lower(head), r"[^a-z0-9]+", ""), 1, 16)


def unread_trades(lines: DataFrame, read: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, page, line, TRADE) of printed trades that ``read`` does not have as often.

    Lines and trades meet by asset, day and direction, and are counted: of n lines and m
    trades alike the last n - m lines are new.
    """
    text = F.trim(strip_nul(F.col("text")))
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("P", "purchase", "S", "sale", "E", "exchange")]), F.nullif(F.regexp_extract(text, _PRINTED, 2), F.lit("")))
    printed = lines.where(text.rlike(_PRINTED)).select(key, "page", "line", text.alias("text"), trade_key(F.regexp_extract(text, _PRINTED, 1)).alias("asset_key"), parse_date(F.regexp_extract(text, _PRINTED, 3)).alias("day"), kind.alias("kind"))
    on = ["asset_key", "day", "kind"]
    nth = F.row_number().over(Window.partitionBy(key, *on).orderBy("page", "line"))
    have = read.where("asset IS NOT NULL").groupBy(F.col(key).alias("k"), trade_key(F.col("asset")).alias("a"), F.col("traded_on").alias("d"), F.col("direction").alias("x")).agg(F.count("*").alias("have"))
    same = (F.col(key) == F.col("k")) & (F.col("asset_key") == F.col("a")) & F.col("day").eqNullSafe(F.col("d")) & F.col("kind").eqNullSafe(F.col("x"))
    left = printed.withColumn("nth", nth).join(have, same, "left").where(F.col("nth") > F.coalesce("have", F.lit(0)))
    # a filter on a column moves below the join and computes it for all lines, and then again; what inline gives is computed once
    found = left.select(key, "page", "line", F.inline_outer(F.array(line_trade(spelled(F.col("text"))))))
    return found.where("traded_on IS NOT NULL")


def trades(documents: DataFrame, lines: DataFrame, key: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """Trades (key, TRADE, status, recovered) and quality (key, rows_detected, rows_read, rows_recovered, used_lines, recognised, confidence).

    ``documents`` has key and tables (arrays of rows of cells), ``lines`` key, page, line and text. What
    the tables gave, and all trades, are written once, as both results are of them.
    """
    rows = settled(table_trades(raw_rows(documents, key), key))
    read = rows.where("asset IS NOT NULL")
    named = read.select(F.col(key).alias("k")).distinct()
    with_tables = lines.join(named, F.col(key) == F.col("k"), "left_semi")
    only_lines = lines.join(named, F.col(key) == F.col("k"), "left_anti")
    late = unread_trades(with_tables, read, key)
    alone = line_trades(only_lines, key)
    as_new = F.lit("New").alias("status")
    found = read.select(key, *TRADE, "status", F.col("collapsed").alias("recovered"), F.lit("table").alias("path"))
    found = found.unionByName(late.select(key, *TRADE, as_new, F.lit(True).alias("recovered"), F.lit("late").alias("path"))).unionByName(alone.select(key, *TRADE, "status", F.lit(False).alias("recovered"), F.lit("lines").alias("path")))
    found = settled(found)
    fields = sum(F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), 1).otherwise(0) for c in ("asset", "direction", "traded_on", "amount_min"))
    seen = rows.groupBy(key).agg(F.count("*").alias("in_tables"), F.max("recognised").alias("recognised"))
    made = found.groupBy(key).agg(F.count("*").alias("rows_read"), F.count_if("recovered").alias("rows_recovered"), F.sum(fields).alias("fields"), F.max(F.col("path") == "lines").alias("used_lines"), F.count_if(F.col("path") == "late").alias("late"))
    texts = lines.groupBy(key).agg(F.max(F.trim(strip_nul(F.col("text"))) != "").alias("has_text"))
    q = documents.select(key).join(texts, key, "left").join(seen, key, "left").join(made, key, "left")
    # where there is no table, what the lines gave is all that can be counted
    detected = F.when(F.coalesce("used_lines", F.lit(False)), F.greatest(F.coalesce("in_tables", F.lit(0)), F.col("rows_read"))).otherwise(F.coalesce("in_tables", F.lit(0)) + F.coalesce("late", F.lit(0)))
    n = F.coalesce("rows_read", F.lit(0))
    score = ptr_confidence(F.col("has_text"), detected, n, n, F.coalesce("fields", F.lit(0)), n * 4, F.col("used_lines"), F.coalesce("recognised", F.lit(False)))
    quality = q.select(key, detected.cast("long").alias("rows_detected"), n.alias("rows_read"), F.coalesce("rows_recovered", F.lit(0)).alias("rows_recovered"), F.coalesce("used_lines", F.lit(False)).alias("used_lines"), F.coalesce("recognised", F.lit(False)).alias("recognised"), score.cast("double").alias("confidence"))
    return found.drop("path"), quality

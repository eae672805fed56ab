"""Text functions: names, tickers, codes, labels."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import ANNUAL_ASSET_TYPES, ANNUAL_NOT_TICKERS, ANNUAL_STOCK_WORDS, ASSET_TYPES, ASSET_WORDS, BUY_WORDS, CLASS_CODES, COMPANY_WORDS, EMPTY_COMMENTS, EXCHANGE_WORDS, NAME_SUFFIXES, NAME_TITLES, NOT_TICKERS, PAC_WORDS, SELL_WORDS, SENATE_ASSET_TYPES, STATE_MARKER, XML_ASSET_TYPES


def _word(words: list[str]) -> str:
    return r"(?i)\b(" + "|".join(words) + r")\b"


def squeeze(text: Column) -> Column:
    """White space to single spaces, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def asset_key(description: Column) -> Column:
    """An asset's name across filings: letters and digits without words of legal form."""
    text = F.regexp_replace(F.lower(F.coalesce(description, F.lit(""))), r"[^a-z0-9 ]+", " ")
    return squeeze(F.regexp_replace(text, _word(ASSET_WORDS), " "))


def company_key(name: Column, political: bool = False) -> Column:
    """A company's name as a key; ``political`` also drops a committee's aliases and words."""
    text = F.regexp_replace(F.coalesce(name, F.lit("")), STATE_MARKER, " ")
    if political:
        text = F.trim(F.regexp_replace(text, r"(\s*\([^()]*\)\s*)+$", ""))
    text = F.regexp_replace(F.lower(text), r"[^a-z0-9 ]+", " ")
    if political:
        text = F.regexp_replace(text, _word(PAC_WORDS), " ")
    return squeeze(F.regexp_replace(text, _word(COMPANY_WORDS), " "))


def _accents() -> tuple[str, str]:
    """Letters beyond ASCII whose compatibility form is one letter with marks."""
    plain = {}
    for c in map(chr, range(0xC0, 0x250)):
        rest = [x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)]
        if len(rest) == 1 and rest[0] != c:
            plain[c] = rest[0].lower()
    return "".join(plain), "".join(plain.values())


def fold_name(name: Column) -> Column:
    """Lower case without marks, for names of one person in two sources (Latin letters)."""
    source, target = _accents()
    bare = F.regexp_replace(F.coalesce(name, F.lit("")), r"[̀-ͯ]", "")
    return F.trim(F.lower(F.replace(F.translate(bare, source, target), F.lit("ß"), F.lit("ss"))))


def plain_surname(last: Column) -> Column:
    """The surname before a comma, without suffixes unless nothing else is left."""
    cut = F.trim(F.element_at(F.split(F.coalesce(last, F.lit("")), ","), 1))
    kept = F.filter(F.split(cut, r"\s+"), lambda t: ~F.regexp_replace(F.lower(t), r"^\.+|\.+$", "").isin(*NAME_SUFFIXES))
    joined = F.array_join(kept, " ")
    return F.when(joined == "", cut).otherwise(joined)


def surname_keys(last: Column) -> Column:
    """The folded surname, and its last word where there are several."""
    folded = fold_name(plain_surname(last))
    words = F.split(folded, " ")
    keys = F.when(F.size(words) > 1, F.array(folded, F.element_at(words, -1))).otherwise(F.array(folded))
    return F.array_distinct(F.filter(keys, lambda k: k != ""))


def given_name(first: Column) -> Column:
    """The given names of a clerk's index without quoted nicknames and titles."""
    text = F.replace(F.regexp_replace(F.coalesce(first, F.lit("")), '"[^"]*"', " "), F.lit(","), F.lit(" "))
    kept = F.filter(F.split(F.trim(text), r"\s+"), lambda t: ~F.regexp_replace(F.lower(t), r"^\.+|\.+$", "").isin(*NAME_TITLES))
    return F.trim(F.array_join(kept, " "))


def given_names_agree(index_first: Column, roster_first: Column) -> Column:
    """One name begins the other, or at least the initials agree; false where either is missing."""

    def lead(text: Column) -> Column:
        return F.regexp_replace(F.element_at(F.split(text, " "), 1), r"^\.+|\.+$", "")

    a, b = lead(fold_name(given_name(index_first))), lead(fold_name(roster_first))
    return (a != "") & (b != "") & (F.startswith(a, b) | F.startswith(b, a) | (F.substring(a, 1, 1) == F.substring(b, 1, 1)))


def _first_good(found: Column, least: int = 1) -> Column:
    return F.try_element_at(F.filter(found, lambda t: ~t.isin(*NOT_TICKERS) & (F.length(t) >= least)), F.lit(1))


def ticker_in(description: Column) -> Column:
    """The ticker a description states: in brackets, before a dash at its head, or near a word for shares."""
    text = F.regexp_replace(F.coalesce(description, F.lit("")), r"\[[A-Z0-9]{2}\]", " ")
    marked = F.regexp_extract_all(text, F.lit(r"([\(\[][A-Z]{1,5}[\)\]])"), 1)
    marked = F.filter(marked, lambda m: ~(F.startswith(m, F.lit("[")) & F.substr(m, F.lit(2), F.length(m) - 2).isin(*CLASS_CODES)))
    bracket = _first_good(F.transform(marked, lambda m: F.substr(m, F.lit(2), F.length(m) - 2)))
    head = F.nullif(F.regexp_extract(text, r"^([A-Z]{1,5})\s*[-–—]\s", 1), F.lit(""))
    head = F.when(~head.isin(*NOT_TICKERS), head)
    shares = F.when(F.lower(text).rlike("stock|common|shares"), _first_good(F.regexp_extract_all(text, F.lit(r"\b([A-Z]{1,5})\b"), 1), 2))
    return F.coalesce(bracket, head, shares)


def annual_ticker_in(description: Column) -> Column:
    """The ticker on an annual report: in parentheses first, then in brackets that hold no two-letter class, then near a word for shares."""
    text = F.coalesce(description, F.lit(""))
    plain = F.regexp_replace(text, r"\[[A-Z]{2}\]", " ")
    some = lambda c: F.nullif(c, F.lit(""))
    bare = F.filter(F.regexp_extract_all(plain, F.lit(r"\b([A-Z]{1,5})\b"), 1), lambda t: ~t.isin(*ANNUAL_NOT_TICKERS))
    near = F.when(F.lower(plain).rlike("|".join(ANNUAL_STOCK_WORDS)), F.try_element_at(bare, F.lit(1)))
    return F.coalesce(some(F.regexp_extract(text, r"\(([A-Z]{1,5})\)", 1)), some(F.regexp_extract(plain, r"\[([A-Z]{1,5})\]", 1)), near)


def annual_direction(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.when(t.rlike("purchase|buy"), "purchase").when(t.rlike("sale|sell|sold"), "sale").when(t.contains("exchange"), "exchange")


def rejoin_wrapped(lines: Column) -> Column:
    """Lines in which an amount that breaks off ("$15,001 -", "over") has its other end again, taken from the next line.

    The next line's class tag goes, its first figure moves up, and the rest follows; a line
    left open at the end stays as it is.
    """
    opens = lambda x: x.rlike(r"\$[\d,]+\s*[-–—]\s*$") | x.rlike(r"(?i)\b(over|above|more than)\s*$")

    def step(acc: Column, x: Column) -> Column:
        line = x["line"]
        tail = F.trim(F.regexp_replace(line, r"^\s*\[[A-Z]{1,5}\]\s*", ""))
        bound = F.regexp_extract(tail, r"(\$[\d,]+)", 1)
        rest = F.trim(F.regexp_replace(tail, r"^(.*?)\$[\d,]+(.*)$", "$1 $2"))
        met = F.trim(F.when(bound == "", F.concat(acc["open"], F.lit(" "), tail)).otherwise(F.concat(acc["open"], F.lit(" "), bound, F.lit(" "), rest)))
        none = F.lit(None).cast("string")
        with_open = F.struct(F.concat(acc["done"], F.array(met)).alias("done"), none.alias("open"))
        fresh = F.when(x["opens"], F.struct(acc["done"].alias("done"), line.alias("open"))).otherwise(F.struct(F.concat(acc["done"], F.array(line)).alias("done"), none.alias("open")))
        return F.when(acc["open"].isNotNull(), with_open).otherwise(fresh)

    bare = F.transform(lines, lambda x: F.regexp_replace(x, r"\s+$", ""))
    seen = F.transform(bare, lambda x: F.struct(x.alias("line"), opens(x).alias("opens")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))
    return F.aggregate(seen, start, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def kind_by_words(text: Column, kinds: list[tuple[str, list[str]]], other: str = "other") -> Column:
    """The first kind of which a word occurs."""
    lower, out = F.lower(F.coalesce(text, F.lit(""))), None
    for kind, words in kinds:
        hit = lower.contains(words[0])
        for w in words[1:]:
            hit = hit | lower.contains(w)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise(other)


def asset_type(description: Column) -> Column:
    return kind_by_words(description, ASSET_TYPES)


def annual_asset_type(description: Column) -> Column:
    return kind_by_words(description, ANNUAL_ASSET_TYPES)


def xml_asset_type(description: Column) -> Column:
    return kind_by_words(description, XML_ASSET_TYPES)


def senate_asset_type(label: Column) -> Column:
    return kind_by_words(F.regexp_replace(label, r"\s+", " "), SENATE_ASSET_TYPES)


def owner_name(owner: Column) -> Column:
    """Self, Spouse, Joint or Dependent Child from a code or words; anything else is the filer."""
    o = F.lower(F.trim(F.coalesce(owner, F.lit(""))))
    return (
        F.when(o == "self", "Self")
        .when(o.contains("spouse") | (o == "sp"), "Spouse")
        .when(o.contains("joint") | (o == "jt"), "Joint")
        .when(o.contains("child") | o.contains("dependent") | (o == "dc"), "Dependent Child")
        .otherwise("Self")
    )


_OWNER_HEAD = r"(?i)^\s*(SP|JT|DC)\b[\s:.\-]*"


def owner_in(description: Column) -> Column:
    """The owner whose code begins a description, or null."""
    code = F.upper(F.regexp_extract(description, _OWNER_HEAD, 1))
    return F.when(code == "SP", "Spouse").when(code == "JT", "Joint").when(code == "DC", "Dependent Child")


def without_owner(description: Column) -> Column:
    return F.regexp_replace(description, _OWNER_HEAD, "")


def direction(cell: Column) -> Column:
    """purchase, sale or exchange: by a one-letter code in front, else by a word."""
    text = F.trim(F.lower(F.coalesce(cell, F.lit(""))))
    first = F.regexp_extract(text, r"^[^a-z]*([a-z]+)", 1)
    out = F.when(first == "p", "purchase").when(first == "s", "sale").when(first == "e", "exchange")
    for kind, words in (("purchase", BUY_WORDS), ("sale", SELL_WORDS), ("exchange", EXCHANGE_WORDS)):
        out = out.when(text.rlike(_word(words)), kind)
    return out


def direction_in(description: Column) -> Column:
    text = F.lower(F.coalesce(description, F.lit("")))
    return F.when(text.contains("purchase") | text.contains("bought"), "purchase").when(text.contains("sale") | text.contains("sold"), "sale")


def filing_status(note: Column) -> Column:
    """New, Amended or Deleted from a row's footnote, or null."""
    value = F.lower(F.regexp_extract(strip_nul(note), r"(?m)^\s*F\s+S\s*:\s*([A-Za-z]+)", 1))
    return F.when(value.startswith("amend"), "Amended").when(value.startswith("delet"), "Deleted").when(value == "new", "New")


def strip_nul(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("\x00"), F.lit(""))


def comment(text: Column) -> Column:
    """A filer's note; placeholders are none."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(~F.lower(t).isin(*EMPTY_COMMENTS), t)


def committee_code(system_code: Column) -> Column:
    """A system code upper-cased, without a full committee's ending zeros."""
    code = F.nullif(F.upper(F.trim(system_code)), F.lit(""))
    return F.when((F.length(code) > 2) & code.endswith("00"), F.substr(code, F.lit(1), F.length(code) - 2)).otherwise(code)


def client_names(name: Column) -> Column:
    """A client, and the principal it was filed on behalf of."""
    n = F.trim(F.coalesce(name, F.lit("")))
    principal = F.regexp_replace(F.regexp_extract(n, r"(?i)\bon behalf of\b:?(.*)$", 1), r"^[ ()\t]+|[ ()\t]+$", "")
    return F.when(n == "", F.array().cast("array<string>")).when(principal != "", F.array(n, principal)).otherwise(F.array(n))


def award_key(award_id: Column, modification: Column, day: Column, amount: Column) -> Column:
    """Identity of an award action; null without an award."""

    def part(c: Column) -> Column:
        return F.trim(F.coalesce(c, F.lit("")))

    return F.when(part(award_id) != "", F.concat_ws("|", part(award_id), part(modification), F.substring(part(day), 1, 10), F.coalesce(amount, F.lit(""))))


def citation(bill_type: Column, number: Column) -> Column:
    return F.concat_ws(" ", F.upper(bill_type), number)


def party_letter(party: Column) -> Column:
    p, u = F.lower(F.coalesce(party, F.lit(""))), F.upper(F.coalesce(party, F.lit("")))
    return F.when(p.contains("democrat") | (u == "D"), "D").when(p.contains("republican") | (u == "R"), "R").when(p.contains("independent") | u.isin("I", "ID"), "I").otherwise("O")


def without_tags(html: Column) -> Column:
    return squeeze(F.regexp_replace(F.coalesce(html, F.lit("")), r"<[^>]*>", " "))


def clerk_url(url: Column, document_id: Column, year: Column, is_ptr: Column, host: str = "disclosures-clerk.house.gov") -> Column:
    """A House document's URL in the folder of its kind; URLs of other hosts stay."""
    have, want = F.when(is_ptr, "/financial-pdfs/").otherwise("/ptr-pdfs/"), F.when(is_ptr, "/ptr-pdfs/").otherwise("/financial-pdfs/")
    built = F.concat(F.lit(f"https://{host}/public_disc"), want, year.cast("string"), F.lit("/"), document_id, F.lit(".pdf"))
    return (
        F.when(document_id.isNull() | (document_id == ""), url)
        .when((url != "") & ~url.contains(host), url)
        .when(F.contains(url, want), url)
        .when(F.contains(url, have), F.replace(url, have, want))
        .when(url.contains(host) & url.endswith(".pdf"), url)
        .otherwise(built)
    )


def in_one_string(codes: Column) -> Column:
    """Distinct codes in order, comma-joined; null if none."""
    return F.nullif(F.array_join(F.array_distinct(F.filter(codes, lambda c: c != "")), ","), F.lit(""))

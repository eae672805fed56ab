"""Fixed values that results depend on: forms' value bands, word lists, thresholds, codes."""

from __future__ import annotations

# Value bands printed on periodic transaction reports (label, low, high; None is open).
PTR_BANDS = [
    ("$1,001 - $15,000", 1001, 15000),
    ("$15,001 - $50,000", 15001, 50000),
    ("$50,001 - $100,000", 50001, 100000),
    ("$100,001 - $250,000", 100001, 250000),
    ("$250,001 - $500,000", 250001, 500000),
    ("$500,001 - $1,000,000", 500001, 1000000),
    ("$1,000,001 - $5,000,000", 1000001, 5000000),
    ("$5,000,001 - $25,000,000", 5000001, 25000000),
    ("$25,000,001 - $50,000,000", 25000001, 50000000),
    ("Over $50,000,000", 50000001, None),
    ("Over $1,000,000", 1000001, None),
]
SENATE_UNBOUNDED = "over $1,000,000 and held independently by spouse or dependent child"

# Days and limits of the disclosure rules and of the detectors.
DEADLINE_DAYS = 45
LATE_DAYS = 60
LATE_AMOUNT = 50_000
LARGE_AMOUNT = 1_000_000
DONATION_DAYS = 90
LOBBYING_DAYS = 30
CONTRACT_DAYS = 30
BILL_DAYS = 60
RUN_DAYS, RUN_TRADES = 45, 5
CLUSTER_DAYS, CLUSTER_MEMBERS, CLUSTER_SHARE = 14, 4, 0.5
RESTATED_ROWS = 3
SALARY = 193_500
SALARY_BY_YEAR = {2015: 174000, 2016: 174000, 2017: 174000, 2018: 174000, 2019: 174000, 2020: 174000, 2021: 180000}

# Words of descriptions that identify nothing.
VAGUE_WORDS = ["various", "misc", "miscellaneous", "other", "unknown", r"see\s+attached", "n/?a", "none", "undetermined", r"not\s+applicable", "redacted"]

# Words without identity in asset, company and committee names.
ASSET_WORDS = ["inc", r"inc\.", "corp", "corporation", "co", "company", "llc", r"l\.l\.c", "ltd", "plc", "the", "common", "stock", "shares", "class [a-c]", "series [a-c]"]
COMPANY_WORDS = ["inc", "incorporated", "corp", "corporation", "co", "company", "llc", r"l\.l\.c", "lp", "llp", "ltd", "limited", "plc", "holdings?", "group", "the", "and", "of"]
PAC_WORDS = ["pac", "political", "action", "committee", "employees?", "federal", "fund", r"inc\.?"]

# Capital-letter words that are no tickers, and bracketed asset-class codes.
NOT_TICKERS = ["THE", "AND", "INC", "LLC", "LP", "NA", "CO", "US", "USA", "ETF", "SP", "JT", "DC", "NY", "CA", "TX", "FL", "IL", "PA", "OH", "PTR", "PDF", "FD", "REP", "SEN", "HON"]
CLASS_CODES = ["ST", "CS", "PS", "OP", "OL", "OT", "MF", "ETF", "EF", "CT", "GS", "HN", "IH", "PE", "RP", "SA", "AB", "BA", "CO", "CD", "CR", "DB", "DO", "FA", "FN", "IC", "IR", "OI", "OO", "PM", "RE", "TR", "VI", "WU"]

# Direction words of a transaction cell, by kind.
BUY_WORDS = ["purchase", "buy", "bought", "p"]
SELL_WORDS = ["sale", "sell", "sold", "s"]
EXCHANGE_WORDS = ["exchange", "ex"]

# Suffixes and titles in filers' names.
NAME_SUFFIXES = ["jr", "sr", "ii", "iii", "iv", "v"]
NAME_TITLES = ["dr", "mr", "mrs", "ms", "md", "facs", "phd", "jr", "sr", "ii", "iii", "iv"]

# Asset types by word, in order of precedence.
ASSET_TYPES = [
    ("stock", ["stock", "shares", "common", "equity"]),
    ("option", ["option", "call", "put"]),
    ("bond", ["bond", "treasury", "note", "fixed income"]),
    ("mutual_fund", ["mutual fund", "index fund", "etf", "fund"]),
    ("cryptocurrency", ["crypto", "bitcoin", "ethereum"]),
]
SENATE_ASSET_TYPES = [
    ("mutual_fund", ["exchange traded fund", "mutual fund"]),
    ("bond", ["government securities", "municipal security", "treasury", "corporate bond"]),
    ("stock", ["corporate securities stock", "stock"]),
    ("real_estate", ["real estate"]),
    ("bank_account", ["bank deposit"]),
    ("retirement", ["retirement", "ira", "401"]),
]

# Filings without a financial schedule; placeholders of empty comment cells.
NO_SCHEDULE = ["X", "D", "W", "E"]
EMPTY_COMMENTS = ["", "n/a", "n.a.", "na", "--", "-", "none"]

# Ceilings of a parse's confidence.
TEXT_FALLBACK_CEILING, NO_HEADER_CEILING = 0.7, 0.5

# Policy areas of bills that name an industry.
POLICY_SECTORS = {
    "Armed Forces and National Security": ["defense"],
    "Health": ["healthcare"],
    "Energy": ["energy"],
    "Finance and Financial Sector": ["finance"],
    "Science, Technology, Communications": ["technology", "telecom"],
    "Transportation and Public Works": ["transportation"],
    "Agriculture and Food": ["agriculture"],
}

# Detectors that do not run unless asked for.
DISABLED = ["outperforming_trades", "perfect_timing", "loss_avoidance", "wealth_vs_salary", "rapid_asset_appreciation", "excessive_wealth_growth"]

# Detectors whose findings have no null model.
UNTESTED = ["sector_concentration", "late_filing", "large_trade", "volume_spikes", "high_trading_frequency", "trade_clustering", "wealth_vs_salary", "excessive_wealth_growth", "rapid_asset_appreciation", "committee_jurisdiction_conflict", "multi_factor_risk"]

# Filing types of annual reports that carry a schedule of travel.
TRAVEL_FILINGS = ["O", "T"]

# Kinds of assets that are stored; all others are "other".
STORED_ASSET_TYPES = ["stock", "bond", "mutual_fund", "real_estate", "retirement", "bank_account", "other"]

# Asset types by word on annual reports and in their XML, in order of precedence.
ANNUAL_ASSET_TYPES = [
    ("stock", ["stock", "shares", "equity"]),
    ("bond", ["bond", "treasury", "note"]),
    ("mutual_fund", ["mutual fund", "index fund", "etf"]),
    ("real_estate", ["real estate", "property", "land"]),
    ("retirement", ["401k", "ira", "retirement", "pension"]),
    ("bank_account", ["bank", "checking", "savings", "cd"]),
]
XML_ASSET_TYPES = [
    ("stock", ["stock", "share", "equity"]),
    ("bond", ["bond", "treasury", "note"]),
    ("mutual_fund", ["fund", "mutual", "etf"]),
    ("real_estate", ["property", "real estate", "home", "house", "land"]),
    ("retirement", ["401k", "ira", "retirement", "pension", "roth"]),
    ("bank_account", ["bank", "savings", "checking", "account", "cash"]),
]
ANNUAL_STOCK_WORDS = ["common stock", "stock", "shares", "equity"]
ANNUAL_NOT_TICKERS = ["THE", "AND", "INC", "LLC", "LP", "NA", "CO", "US", "USA"]

# Wording of debt in descriptions without a class code; a company name's mark of its state.
DEBT_WORDING = r"(?i)treasury|municipal|\bmuni\b|\bbond\b|\bdebenture\b|\bt-bill\b|certificate of deposit|savings bond|\bnote due\b|\b(due|matures|maturity)\b\s*\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"
STATE_MARKER = r"/[A-Za-z][A-Za-z ]{0,18}/"

# Sources of income by word, in order of precedence.
INCOME_SOURCES = [
    ("salary", ["salary", "wages", "compensation", "government"]),
    ("investment", ["dividend", "interest", "capital gains", "investment"]),
    ("real_estate", ["rental", "real estate", "property", "lease"]),
    ("business", ["business", "consulting", "self-employment", "partnership"]),
    ("other", ["other", "misc", "pension", "retirement distribution"]),
]

# First words of the headings above an annual report's schedules, longer forms first.
SCHEDULE_HEADINGS = {
    "A": [("Asset", "Owner", "Value", "Income", "Income", "Tx."), ("Asset", "Owner", "Value", "Income", "Income")],
    "B": [("Asset", "Owner", "Date", "Tx.", "Amount", "Cap.")],
    "C": [("Source", "Type", "Amount")],
    "D": [("Owner", "Creditor", "Date", "Type", "Amount")],
    "H": [("Source", "Start", "End", "Itinerary", "Days", "Lodging?", "Food?", "Family?")],
}
# Forms that print no schedule of transactions.
NO_SCHEDULE_B = ["candidate report", "amendment report", "new filer report"]

# Words of a periodic report's header, how many make one and in how many rows it may be; words that a line of no trade has.
HEADER_WORDS = ["asset", "transaction", "notification", "amount", "owner", "date"]
HEADER_WORDS_NEEDED, HEADER_ROWS = 2, 4
READABLE_WORDS = ["asset", "transaction", "date", "amount", "owner"]
NO_TRADE_WORDS = ["transaction", "asset", "owner", "amount", "date", "periodic", "report", "page", "filing"]

# Words of a table's first row that open a schedule of an annual report, in the order they are tried.
SCHEDULE_WORDS = [("A", ["asset", "value of asset"]), ("B", ["asset", "tx.", "amount"]), ("C", ["source", "type", "amount"]), ("D", ["creditor", "date incurred"]), ("E", ["position", "organization"]), ("G", ["source", "value"])]

"""Typed claims in text: patterns by type, extraction as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MONTH = "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
#: Claim types in the order in which they are taken, with patterns that Java and RE2 read alike.
PATTERNS = (
    ("price", r"[$€£₹] ?[0-9][0-9,]*(?:\.[0-9]{1,2})?|[0-9][0-9,]*(?:\.[0-9]{1,2})? ?(?:USD|EUR|GBP|INR)"),
    ("date", rf"(?i:{_MONTH} [0-9]{{1,2}},? [0-9]{{4}}|[0-9]{{1,2}} {_MONTH} [0-9]{{4}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}|(?:updated|published|copyright)[^0-9\n]{{0,40}}(?:19|20)[0-9]{{2}})"),
    ("count", r"(?i:[0-9][0-9,.]*\+?\s+(?:customers|users|teams|companies|developers|downloads|installs|packages|modules|plugins|extensions|themes|pages|articles|posts|members|countries|enterprises|stars|reviews|questions|students|patients|locations|stores|recipes|episodes|issues|projects|skills|employees|products|offices))"),
    # Of the plan names only those with the word after them: alone, "Pro" begins many other words in other languages.
    ("plan", r"(?:Free|Starter|Basic|Standard|Pro|Professional|Premium|Team|Business|Enterprise|Growth|Scale|Plus|Advanced)(?: [Pp]lan)"),
    ("version", r"[vV][0-9]+\.[0-9]+(?:\.[0-9]+)?|[0-9]+\.[0-9]+\.[0-9]+"),
    ("hours", r"(?i:[0-9]{1,2}(?::[0-9]{2})? ?[ap]\.?m\.?(?: ?[-–] ?[0-9]{1,2}(?::[0-9]{2})? ?[ap]\.?m\.?)?)"),
    ("phone", r"(?:\+[0-9]{1,2} ?)?(?:\([0-9]{3}\)|[0-9]{3})[-. ][0-9]{3}[-. ][0-9]{4}"),
    ("address", r"[0-9]{1,5} (?:[A-Z][a-z]+ ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Way)"),
    ("eligibility", r"(?i:eligib[a-z]*[^.\n]{0,120})"),
    ("deadline", r"(?i:(?:deadline|apply by|applies by|applies until|apply until|closes? on|ends? on|due by|due on|due date|registration closes)[^.\n]{0,80})"),
    ("stock", r"(?i:(?:in stock|out of stock|sold out|back-?order|pre-?order|discontinued|no longer available|available again)[^.\n]{0,60})"),
    ("shipping", r"(?i:(?:free shipping|ships? in|ships? within|delivery in|delivery within|same-day delivery)[^.\n]{0,60})"),
    ("credential", r"(?i:(?:ISO ?[0-9]{4,5}|SOC ?2|HIPAA|GDPR|FedRAMP|PCI[ -]DSS)[^.\n]{0,60})"),
)
#: What a text must hold, in lower case, or a plainer pattern that it must match, for a type of claim to be in it. The patterns
#: are slow where they begin with many words, and most texts have no such claim.
WORDS = {
    "plan": (" plan",),
    "deadline": ("deadline", "apply by", "applies by", "applies until", "apply until", "close on", "closes on", "end on", "ends on", "due by", "due on", "due date", "registration closes"),
    "stock": ("in stock", "out of stock", "sold out", "backorder", "back-order", "preorder", "pre-order", "discontinued", "no longer available", "available again"),
    "shipping": ("free shipping", "ship in", "ships in", "ship within", "ships within", "delivery in", "delivery within", "same-day delivery"),
    "credential": ("iso", "soc", "hipaa", "gdpr", "fedramp", "pci"),
}
SHAPES = {"date": "[0-9]{4}", "phone": "[0-9]{3}[-. ][0-9]{4}"}
MOST = 30  # claims of a page, as the report takes them
QUOTE = 160


def claims(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ord, type, value, quote): the first place of each (type, value), types in order, MOST per row.

    A count with a dot is none. The quote is the first line that has the value. All is done within the row: no shuffle."""
    rows = rows.select(F.col(key), F.col(text), F.lower(text).alias("_low"))
    # Types are in order and places within a type too, so the first of equal structs is the first place.
    once = F.slice(F.array_distinct(found(F.col(text), F.col("_low"))), 1, MOST)
    lines = F.split(F.col(text), "\n")

    def quoted(m: Column, at: Column) -> Column:
        line = F.get(F.filter(lines, lambda x: F.contains(x, m["value"])), F.lit(0))
        return F.struct((at + 1).alias("ord"), m["type"].alias("type"), m["value"].alias("value"), F.substring(F.coalesce(line, m["value"]), 1, QUOTE).alias("quote"))

    return rows.select(F.col(key), F.inline(F.transform(once, quoted)))


def every(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, type, value): all claims of each row, however many, a row for each place where one stands."""
    rows = rows.select(F.col(key), F.col(text), F.lower(text).alias("_low"))
    return rows.select(F.col(key), F.inline(found(F.col(text), F.col("_low"))))


def found(text: Column, low: Column) -> Column:
    """All matches that are claims, as an array of (type, value): a count with a dot is none. low: the text in lower case."""
    return F.filter(_matches(text, low), lambda m: (m["type"] != "count") | ~F.contains(m["value"], F.lit(".")))


def _matches(text: Column, low: Column) -> Column:
    """All matches of all patterns as (type, value), in the order of the patterns and then of the text; low: the text in lower
    case."""
    each = []
    for name, pattern in PATTERNS:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        if name in WORDS:
            values = F.when(reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in WORDS[name]]), values).otherwise(F.array().cast("array<string>"))
        elif name in SHAPES:
            values = F.when(text.rlike(SHAPES[name]), values).otherwise(F.array().cast("array<string>"))
        each.append(F.transform(values, _struct_maker(name)))
    return F.flatten(F.array(*each))


def _struct_maker(name: str):
    return lambda value: F.struct(F.lit(name).alias("type"), F.trim(value).alias("value"))


def fact_tokens(text: Column) -> Column:
    """Prices, percentages, versions and plan names in a description, each once."""
    tokens = r"[$€£₹] ?[0-9][0-9,.]*|[0-9]+(?:\.[0-9]+)?%|[vV][0-9]+\.[0-9]+|(?:Free|Basic|Starter|Pro|Premium|Enterprise) [Pp]lan"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(tokens), F.lit(0)))

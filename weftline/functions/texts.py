"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "[ \\t\\n\\r\\x0B\\f\\x{A0}]"
#: Characters that are often typed for each other, and what they are folded to.
CONFUSABLE = "‐‑‒–—−‘’‚‛“”„‟ "
FOLDED = "------''''\"\"\"\" "
LEGAL_WORDS = ("inc", "llc", "ltd", "limited", "corp", "corporation", "gmbh", "plc", "co", "company", "sa", "ag", "foundation")
STOP_WORDS = ("the", "a", "an", "of", "and", "for", "at", "in", "on", "to", "by", "home", "official", "site", "website")
CATEGORY_WORDS = ("software", "platform", "university", "school", "hospital", "clinic", "bank", "museum", "restaurant", "hotel", "agency", "studio", "labs", "app", "foundation")


def fold_spaces(text: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def shorten(text: Column, most: int = 200) -> Column:
    """At most `most` characters, the last of which is an ellipsis if any are cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def fold_confusables(text: Column) -> Column:
    return fold_spaces(F.translate(text, CONFUSABLE, FOLDED))


def word_count(text: Column) -> Column:
    folded = fold_spaces(text)
    return F.when(folded == "", 0).otherwise(F.size(F.split(folded, " ")))


def name_tokens(text: Column) -> Column:
    """Words of a name in lower case without stop and legal words, in order."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS, *LEGAL_WORDS))


def title_segments(title: Column) -> Column:
    """Parts of a title between separators that stand between spaces."""
    return F.filter(F.transform(F.split(title, r"\s+[|–—:·-]\s+"), lambda s: F.trim(s)), lambda s: s != "")


def directives(header: Column) -> Column:
    """"a, b:1; c" as entries (name, value) in order; later names win when made a map. A bare name has no value."""
    parts = F.filter(F.transform(F.split(F.lower(header), "[,;]"), lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("name"), F.when(p.contains(":"), F.trim(F.regexp_extract(p, ":(.*)$", 1))).alias("value")),
    )


def fact_like(text: Column) -> Column:
    """A string that could state a fact: 25 characters and 5 words at least, no link, code or token."""
    folded = fold_spaces(text)
    start = F.lower(F.substring(folded, 1, 4))
    coded = start.startswith("http") | folded.rlike("^[/#{]") | start.startswith("fn:") | (start == "urn:")
    return (F.length(folded) >= 25) & (word_count(folded) >= 5) & ~coded


def has_qualifier(name: Column) -> Column:
    """Whether a name has a word for its kind or a legal form; "foundation" counts as a kind only."""
    words = F.regexp_extract_all(F.lower(name), F.lit("[a-z0-9]+"), F.lit(0))
    legal = [w for w in LEGAL_WORDS if w != "foundation"]
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in (*CATEGORY_WORDS, *legal)]))


def first_number(text: Column) -> Column:
    return F.regexp_replace(F.nullif(F.regexp_extract(text, r"([0-9][0-9,]*(?:\.[0-9]+)?)", 1), F.lit("")), ",", "").cast("double")

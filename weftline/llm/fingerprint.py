"""Document fingerprints: canonical exact digests, with DataFrame functions only.

A text's canonical form is its NFKC normal form in lower case with every run of white space made one space and
none at its ends. Two xxhash64 values of that form, from different seeds, make 128 bits. Texts that share them are
compared byte by byte: the forms are grouped by (digest, form), so equal bytes collapse before the shuffle, and
forms that differ under one digest get a number after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import shuffle_partitions

_SPACES = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_ICU = "com.ibm.icu.text.Normalizer"  # on Spark's own class path


def canonical(text: Column) -> Column:
    """Canonical form; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    # ASCII is its own normal form, so only other texts pay for the call.
    nfkc = F.when(F.length(text) == F.octet_length(text), text).otherwise(
        F.java_method(F.lit(_ICU), F.lit("compose"), text, F.lit(True))
    )
    return F.btrim(F.regexp_replace(F.lower(nfkc), F.lit(_SPACES), F.lit(" ")))


def digest(form: Column) -> Column:
    """128 bits of a canonical form as 32 hexadecimal digits."""
    wide = F.concat(F.lpad(F.hex(F.xxhash64(form)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), form)), 16, "0"))
    return F.lower(wide)


def collisions(forms: DataFrame) -> DataFrame:
    """(fingerprint, form_sha, n): digests that stand for several canonical forms, and a number for each form.

    forms: columns form and fingerprint. The first grouping compares whole forms as bytes."""
    distinct = forms.groupBy("fingerprint", "form").agg(F.count(F.lit(1)).alias("copies"))
    distinct = distinct.select("fingerprint", F.sha2("form", 256).alias("form_sha"))
    clash = distinct.groupBy("fingerprint").agg(F.min("form_sha").alias("least"), F.max("form_sha").alias("most"))
    clash = clash.filter("least < most").select(F.col("fingerprint").alias("clash"))
    found = distinct.join(clash, F.col("fingerprint") == F.col("clash"), "left_semi")
    order = Window.partitionBy("fingerprint").orderBy("form_sha")
    return found.select("fingerprint", "form_sha", F.row_number().over(order).alias("n")).filter("n > 1")


def number_collisions(docs: DataFrame, rows: DataFrame, forms_of: dict[str, str], text: str = "text") -> DataFrame:
    """rows, whose digest columns get a number where several forms of docs share a digest.

    forms_of: for each digest column of rows, the column with the SHA-256 of its form."""
    forms = docs.select(canonical(F.col(text)).alias("form"))
    clashes = collisions(forms.withColumn("fingerprint", digest(F.col("form"))))
    for name, sha in forms_of.items():
        these = clashes.select(F.col("fingerprint").alias("_f"), F.col("form_sha").alias("_s"), F.col("n").alias("_n"))
        rows = rows.join(these, (F.col(name) == F.col("_f")) & (F.col(sha) == F.col("_s")), "left")
        full = F.when(F.col("_n").isNull(), F.col(name)).otherwise(F.concat_ws("-", F.col(name), "_n"))
        rows = rows.withColumn(name, full).drop("_f", "_s", "_n")
    return rows


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (key, n_chars, fingerprint) per row of docs. Null texts count as empty; repeated rows stay."""
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select(key, F.length("text").cast("long").alias("n_chars"), canonical(F.col("text")).alias("form"))
    rows = rows.select(key, "n_chars", digest(F.col("form")).alias("fingerprint"), F.sha2("form", 256).alias("form_sha"))
    return number_collisions(docs, rows, {"fingerprint": "form_sha"}, text).drop("form_sha")


def _range_of(value: Column, limits: list[int]) -> Column:
    """How many of the sorted limits are at most value: found among every step-th limit, then within one step."""
    if not limits:
        return F.lit(0)
    step = max(1, round(len(limits) ** 0.5))
    blocks = [limits[i : i + step] for i in range(0, len(limits), step)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    block = F.size(F.filter(longs([b[0] for b in blocks]), lambda x: x <= value))
    inside = F.size(F.filter(F.element_at(F.array(*[longs(b) for b in blocks]), F.greatest(block, F.lit(1))), lambda x: x <= value))
    return F.coalesce(F.when(block == 0, 0).otherwise((block - 1) * step + inside), F.lit(0))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's key and text, and next_text: that of the row after it by key (then by text); after the last, the first.

    Rows are dealt to ranges of the key whose limits are quantiles, so no task sees all rows. Within a range the next
    row is a window's lead; the last row of a range takes the first row of the next range that has any."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = 4 * shuffle_partitions(docs.sparkSession)
    at = [i / parts for i in range(1, parts)]
    limits = rows.agg(F.percentile_approx("key", at, 20 * parts).alias("at")).first()["at"] or []
    part = _range_of(F.col("key"), sorted(set(limits)))
    rows = rows.withColumn("part", part)
    order = Window.partitionBy("part").orderBy(F.col("key").asc_nulls_first(), F.col("text"))
    placed = rows.withColumn("next_text", F.lead("text").over(order))
    first = rows.withColumn("nth", F.row_number().over(order)).filter("nth = 1").select(F.col("part").alias("next_part"), F.col("text").alias("first_text"))
    # One row per range: the number of ranges is set above, not by the data.
    ring = Window.orderBy("part")
    parts_seen = rows.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    links = parts_seen.select("part", F.coalesce(F.lead("part").over(ring), F.first("part").over(ring)).alias("next_part"))
    firsts = links.join(first, "next_part").select(F.col("part").alias("of"), "first_text")
    inside = placed.filter(F.col("next_text").isNotNull()).select("key", "text", "next_text")
    last = placed.filter(F.col("next_text").isNull()).join(firsts, F.col("part") == F.col("of"))
    return inside.unionByName(last.select("key", "text", F.col("first_text").alias("next_text")))

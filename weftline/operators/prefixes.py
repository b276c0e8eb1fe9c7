"""The text that most pages of a site begin with, to the character."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.pages import first_by

EXCERPT, LEAST_PAGES, LEAST_PREFIX = 1_500, 4, 400


def common_prefix(a: Column, b: Column, most: int = EXCERPT) -> Column:
    """How many first characters two texts of `most` characters at most share: a search by halves, as a longer prefix is
    only shared if a shorter one is."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(most.bit_length()))])

    def take(n, step):
        fits = n + step <= F.least(F.length(a), F.length(b))
        return F.when(fits & (F.substring(a, F.lit(1), n + step) == F.substring(b, F.lit(1), n + step)), n + step).otherwise(n)

    return F.aggregate(steps, F.lit(0), take)


def shared_prefix(excerpts: DataFrame, least: int = LEAST_PREFIX) -> DataFrame:
    """(site, pages, length, hoisted) of sites with LEAST_PAGES excerpts (site, page_id, text) or more: the longest prefix that
    half of the excerpts begin with, or more, looked for in the longest of them (of equal ones that of the first page, then the
    least); hoisted if it has `least` characters. Of a longer excerpt the first EXCERPT characters count; null ones don't.

    Every excerpt is measured against its site's longest, so a site's rows are counted by length, and only those counts, EXCERPT
    at most, are looked at in order."""
    texts = excerpts.select("site", "page_id", F.substring("text", 1, EXCERPT).alias("text")).filter("text IS NOT NULL")
    longest = texts.groupBy("site").agg(F.min_by("text", F.struct(-F.length("text"), "page_id", "text")).alias("longest"), F.count(F.lit(1)).alias("pages"))
    longest = longest.filter(F.col("pages") >= LEAST_PAGES)
    shared = texts.join(longest, "site").withColumn("length", common_prefix(F.col("text"), F.col("longest")))
    counts = shared.groupBy("site", "pages", "length").agg(F.count(F.lit(1)).alias("n"))
    longer = Window.partitionBy("site").orderBy(F.desc("length"))
    counts = counts.withColumn("agree", F.sum("n").over(longer)).filter(2 * F.col("agree") >= F.col("pages"))
    best = first_by(counts, ["site"], [F.desc("length")])
    return best.select("site", "pages", "length", (F.col("length") >= least).alias("hoisted"))

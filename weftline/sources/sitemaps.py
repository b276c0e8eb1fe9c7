"""Sitemaps as fetched: lists and indexes, with namespace prefixes or without, whole or broken."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE, TRIED = 50, 2  # entries that a crawl starts from; sitemaps of a site that it looks at
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def _text(element, tag: str):
    """Trimmed text of the first element `tag`, without references; null if there is none."""
    pattern = rf"(?s)<{tag}(?:\s[^>]*)?>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{tag}\s*>"
    found = F.regexp_extract(element, pattern, 1)
    for reference, char in _ENTITIES:
        found = F.replace(found, F.lit(reference), F.lit(char))
    return F.when(found != "", found)


def parsed(files: DataFrame) -> DataFrame:
    """(site, ord, url, http_status, parse_ok, is_index, child, entries) of files (site, ord, url, http_status, body).

    entries: array of (url, lastmod), lastmod null where it is empty. child: the first sitemap of an index. Failed
    fetches are no sitemaps and give no row; a null or broken body gives parse_ok false and no entries."""
    rows = files.filter(F.coalesce("http_status", F.lit(500)) < 400)
    whole = F.expr("from_xml(body, 'bad string', map('columnNameOfCorruptRecord', 'bad', 'mode', 'PERMISSIVE')).bad is null")
    body = F.regexp_replace("body", r"(?s)<!--.*?-->", "")
    prefix = F.regexp_extract(body, r"<([A-Za-z0-9_-]+:)(?:urlset|sitemapindex)[\s>]", 1)
    flat = F.replace(F.replace(body, F.concat(F.lit("</"), prefix), F.lit("</")), F.concat(F.lit("<"), prefix), F.lit("<"))
    rows = rows.withColumn("flat", F.when(prefix == "", body).otherwise(flat)).withColumn("parse_ok", F.col("body").isNotNull() & F.coalesce(whole, F.lit(False)))
    index = F.coalesce(F.col("flat").rlike(r"<sitemapindex[\s>]"), F.lit(False))
    elements = F.regexp_extract_all("flat", F.lit(r"(?s)<url(?:\s[^>]*)?>(.*?)</url\s*>"), F.lit(1))
    entries = F.filter(F.transform(elements, lambda e: F.struct(_text(e, "loc").alias("url"), _text(e, "lastmod").alias("lastmod"))), lambda e: e["url"].isNotNull())
    return rows.select(
        "site", "ord", "url", "http_status", "parse_ok", (F.col("parse_ok") & index).alias("is_index"),
        F.when(F.col("parse_ok") & index, _text(F.col("flat"), "loc")).alias("child"),
        F.when(F.col("parse_ok") & ~index, entries).alias("entries"),
    )


def followed(files: DataFrame) -> DataFrame:
    """(site, ord, url, http_status, parse_ok, entries): an index stands for its first child, where files have it.

    A broken child makes the index broken; a child that was not fetched, or is an index again, has no entries. Files
    that are only the child of an index keep their own row."""
    rows = parsed(files)
    children = rows.select("site", F.col("url").alias("child"), F.col("parse_ok").alias("child_ok"), F.coalesce("entries", F.array().cast("array<struct<url:string,lastmod:string>>")).alias("inner"))
    joined = rows.join(children.dropDuplicates(["site", "child"]), ["site", "child"], "left")
    none = F.array().cast("array<struct<url:string,lastmod:string>>")
    good = F.col("parse_ok") & F.coalesce("child_ok", F.lit(True))
    url = F.when(F.col("is_index") & F.coalesce("child_ok", F.lit(False)), F.col("child")).otherwise(F.col("url"))
    entries = F.when(good, F.coalesce(F.when(F.col("is_index"), F.coalesce("inner", none)).otherwise(F.col("entries")), none))
    return joined.select("site", "ord", url.alias("url"), "http_status", good.alias("parse_ok"), entries.alias("entries"))


def counted(files: DataFrame) -> DataFrame:
    """(site, ord, url, http_status, parse_ok, entries_count, lastmod_present, lastmod_distinct); counts of broken ones are null."""
    dates = F.filter(F.transform("entries", lambda e: e["lastmod"]), lambda d: d.isNotNull())
    return followed(files).select(
        "site", "ord", "url", "http_status", "parse_ok", F.size("entries").alias("entries_count"),
        F.size(dates).alias("lastmod_present"), F.size(F.array_distinct(dates)).alias("lastmod_distinct"),
    )


def sampled(files: DataFrame) -> DataFrame:
    """(site, ord, url): the first SAMPLE entries of the first of a site's first TRIED sitemaps that has any."""
    usable = followed(files).filter((F.col("ord") <= TRIED) & (F.size("entries") > 0))
    first = usable.groupBy("site").agg(F.min_by("entries", "ord").alias("entries"))
    return first.select("site", F.posexplode(F.slice("entries", 1, SAMPLE)).alias("at", "e")).select("site", (F.col("at") + 1).alias("ord"), F.col("e.url").alias("url"))


def listed(files: DataFrame) -> DataFrame:
    """(site, ord, url): all entries of all of a site's sitemaps, in order of the files and of their lines. The children of an
    index are files of their own."""
    lists = parsed(files).filter(F.size("entries") > 0).select("site", F.col("ord").alias("nth"), F.col("url").alias("file"), "entries")
    order = Window.partitionBy("site").orderBy("nth", "file")  # a row for each file: entries need no sorting
    before = F.coalesce(F.sum(F.size("entries").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = lists.withColumn("before", before).select("site", "before", F.posexplode("entries").alias("at", "e"))
    return rows.select("site", (F.col("before") + F.col("at") + 1).alias("ord"), F.col("e.url").alias("url"))

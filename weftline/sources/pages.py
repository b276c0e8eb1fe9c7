"""The page tables: raw pages as fetches of sites, and links, headings and other parts found by patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls

#: The plain forms of links and headings, for the SQL twins only.
LINK = r"<a href=\"([^\"]*)\"[^>]*>([^<]*)</a>"
HEADING = r"<h([1-6])[^>]*>([^<]*)</h[1-6]>"
BREAK = r"</?(?:p|div|li|ul|nav|footer|article|h[1-6]|body|html)(?: [^>]*)?>"
#: What is no markup of the page; an element's attributes, in any order, with either quotes or none; a link's target.
UNREAD = r"(?is)<!--.*?-->|<(script|style)(?=[\s>]).*?</\1\s*>"
ATTRIBUTES = r"((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)"
HREF = r"(?is)(?:^|[\s\"'/])href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"
MOST_LINKS, MOST_HEADINGS, ANCHOR = 400, 100, 200


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html, site, path): a page is a successful fetch of its URL; its site is its host."""
    raw = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return raw.withColumn("site", urls.authority(F.col("url"))).withColumn("path", urls.path(F.col("url")))


def _elements(html: Column, start: str, end: str) -> Column:
    """(attributes, text) of elements that start and end as given, in page order, inner tags stripped; one that stays
    open ends at the next of its kind or at the next block."""
    pieces = F.split(F.regexp_replace(html, UNREAD, " "), start)

    def parts(x: Column) -> Column:
        rest = F.regexp_extract(x, rf"(?s)^{ATTRIBUTES}>(.*)$", 2)
        inner = F.when(rest.rlike(end), F.regexp_extract(rest, rf"(?s)^(.*?){end}", 1)).otherwise(F.element_at(F.split(rest, f"(?i){BREAK}", 2), 1))
        inner = F.regexp_replace(F.regexp_replace(inner, f"(?i){BREAK}|<br[^>]*>", " "), r"<[^>]*>", "")
        return F.struct(F.regexp_extract(x, f"^{ATTRIBUTES}>", 1).alias("attributes"), F.regexp_replace(inner, r"^\s+|\s+$", "").alias("text"))

    return F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), parts)


def links(pages: DataFrame, most: int | None = None) -> DataFrame:
    """(page_id, site, url, ord, href, target, anchor_text): links in page order, of a page all or the first most."""
    every = F.filter(_elements(F.col("html"), r"(?i)<a(?=[\s/])", r"(?i:</a\s*>)"), lambda x: x["attributes"].rlike(HREF))
    found = pages.select("page_id", "site", "url", F.posexplode(F.slice(every, 1, most) if most else every).alias("ord", "link"))
    href = F.concat(*[F.regexp_extract("link.attributes", HREF, i) for i in (1, 2, 3)])
    found = found.withColumn("href", href).withColumn("anchor_text", F.nullif(F.substring("link.text", 1, ANCHOR), F.lit("")))
    return found.select("page_id", "site", "url", (F.col("ord") + 1).alias("ord"), "href", urls.resolve(F.col("url"), F.col("href")).alias("target"), "anchor_text")


def headings(pages: DataFrame) -> DataFrame:
    """(page_id, ord, level, text): headings in page order, MOST_HEADINGS of a page."""
    every = _elements(F.col("html"), r"(?i)<h(?=[1-6][\s/>])", r"(?i:</h[1-6]\s*>)")
    found = pages.select("page_id", F.posexplode(F.slice(every, 1, MOST_HEADINGS)).alias("ord", "h"))
    return found.select("page_id", (F.col("ord") + 1).alias("ord"), F.substring("h.attributes", 1, 1).cast("int").alias("level"), F.col("h.text").alias("text"))


def blocks(pages: DataFrame) -> DataFrame:
    """(page_id, site, ord, line): the page's paragraphs and list items as lines, markup stripped, empty ones left out."""
    body = F.regexp_replace("html", "(?s)^.*</head>", "")
    broken = F.regexp_replace(body, BREAK, "\n")
    lines = F.transform(F.split(F.regexp_replace(broken, r"<[^>]*>", " "), "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \\t\\r]+", " ")))
    found = pages.select("page_id", "site", F.posexplode(F.filter(lines, lambda x: x != "")).alias("ord", "line"))
    return found.withColumn("ord", F.col("ord") + 1)


def first_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key: the first by order. The order names a row, so the choice doesn't depend on the plan."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")

"""Queries over the page and document tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import claims as claim_functions
from ..functions import texts, urls
from ..operators import checks, crawl, runs
from ..sources import pages as sources
from ..sources.parse import parse_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_RX = "^[A-Za-z][A-Za-z0-9+.-]*://"
PG = rf"""pg AS (SELECT page_id, url, html,
  regexp_replace(lower(regexp_extract(url, '{_RX}([^/?#]*)', 1)), '\.$', '') AS site,
  regexp_extract(url, '{_RX}[^/?#]*([^?#]*)', 1) AS path FROM pages)"""


def np_sql(path: str) -> str:
    return f"coalesce(nullif(regexp_replace({path}, '/+$', ''), ''), '/')"


def tk_sql(path: str) -> str:
    return f"'/' || array_to_string(list_transform(list_filter(string_split({path}, '/'), lambda s: s <> '')[1:2], lambda s: regexp_replace(s, '[0-9]+', '{{d}}', 'g')), '/')"


LK = f"""lk AS (SELECT page_id, site, url, ord, href,
  CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href
       WHEN starts_with(href, '//') THEN lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) || ':' || href
       WHEN starts_with(href, '/') THEN regexp_extract(url, '({_RX[1:]}[^/?#]*)', 1) || href
       WHEN starts_with(href, '#') OR href = '' THEN regexp_extract(url, '^([^#]*)', 1) || href
       WHEN starts_with(href, '?') THEN regexp_extract(url, '^([^?#]*)', 1) || href
       ELSE regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '[^/]*$', '') || href END AS target,
  nullif(substring(trim(anchor), 1, 200), '') AS anchor_text
  FROM (SELECT page_id, site, url, unnest(regexp_extract_all(html, '{sources.LINK}', 1)) AS href,
               unnest(regexp_extract_all(html, '{sources.LINK}', 2)) AS anchor,
               generate_subscripts(regexp_extract_all(html, '{sources.LINK}', 1), 1) AS ord FROM pg) WHERE ord <= 400)"""
LP = f"lp AS (SELECT *, {np_sql(f'''regexp_extract(target, '{_RX}[^/?#]*([^?#]*)', 1)''')} AS tpath, lower(regexp_extract(target, '{_RX}([^/?#]*)', 1)) AS tsite FROM lk)"
BL = rf"""bl AS (SELECT page_id, site, line, row_number() OVER (PARTITION BY page_id ORDER BY i) AS ord FROM (
  SELECT page_id, site, i, trim(regexp_replace(line, '[ \t\r]+', ' ', 'g')) AS line FROM (
    SELECT page_id, site, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (
      SELECT page_id, site, string_split(regexp_replace(regexp_replace(regexp_replace(html, '(?s)^.*</head>', ''), '{sources.BREAK}', chr(10), 'g'), '<[^>]*>', ' ', 'g'), chr(10)) AS ls FROM pg)))
  WHERE line <> '')"""


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- URLs, links, headings ------------------------------------------------------------------------------------------


@query(
    "url_keys",
    rf"""WITH {PG} SELECT page_id, site, {np_sql('path')} AS norm_path,
    regexp_replace(site, '^www\.', '') || regexp_replace(regexp_replace(path, '/index\.html?$', ''), '/+$', '') AS url_key,
    lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) || '://' || site || path || regexp_extract(url, '(\?[^#]*)', 1) AS redirect_key,
    regexp_replace(site, '^www\.', '') || CASE WHEN path = '' THEN '/' ELSE path END AS passage_key,
    {tk_sql('path')} AS template_key FROM pg""",
)
def url_keys(spark, sf_dir):
    p = sources.read_pages(spark, sf_dir)
    u = F.col("url")
    return p.select("page_id", "site", urls.norm_path(F.col("path")).alias("norm_path"), urls.url_key(u).alias("url_key"), urls.redirect_key(u).alias("redirect_key"), urls.passage_key(u).alias("passage_key"), urls.template_key(F.col("path")).alias("template_key"))


@query("page_links", f"WITH {PG}, {LK} SELECT page_id, site, url, ord, href, target, anchor_text FROM lk")
def page_links(spark, sf_dir):
    return sources.links(sources.read_pages(spark, sf_dir), sources.MOST_LINKS)


@query(
    "page_headings",
    f"""SELECT page_id, ord, l::INTEGER AS level, trim(t) AS text FROM (SELECT page_id,
    unnest(regexp_extract_all(html, '{sources.HEADING}', 1)) AS l, unnest(regexp_extract_all(html, '{sources.HEADING}', 2)) AS t,
    generate_subscripts(regexp_extract_all(html, '{sources.HEADING}', 1), 1) AS ord FROM pages) WHERE ord <= 100""",
)
def page_headings(spark, sf_dir):
    return sources.headings(sources.read_pages(spark, sf_dir))


@query(
    "page_heads",
    """SELECT page_id, nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') AS title, nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS lang,
    nullif(regexp_extract(html, '<meta charset="([^"]*)"', 1), '') AS charset, nullif(regexp_extract(html, '<link rel="canonical" href="([^"]*)"', 1), '') AS canonical,
    nullif(regexp_extract(html, '<meta name="robots" content="([^"]*)"', 1), '') AS robots_meta, NOT contains(html, '</html>') AS truncated FROM pages""",
)
def page_heads(spark, sf_dir):
    part = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.nullif(F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), F.lit("")).alias("title"),
        part('<html lang="([^"]*)"').alias("lang"),
        part('<meta charset="([^"]*)"').alias("charset"),
        part('<link rel="canonical" href="([^"]*)"').alias("canonical"),
        part('<meta name="robots" content="([^"]*)"').alias("robots_meta"),
        (~F.contains("html", F.lit("</html>"))).alias("truncated"),
    )


_COUNTERS = {
    "images": "<img[^>]*>", "empty_alts": "<img[^>]*alt=\"\"[^>]*>", "details": "<details[^>]*>", "details_open": "<details[^>]* open[^>]*>", "dialogs": "<dialog[^>]*>|role=\"dialog\"",
    "accordions": "(?:class|id)=\"[^\"]*accordion[^\"]*\"", "grid_columns": "<div[^>]*class=\"(?:[^\"]* )?col(?:umn)?(?:-[^\"]*| [^\"]*)?\"", "tables": "<table[^>]*>", "canvases": "<canvas[^>]*>", "scripts": "<script[^>]*>", "paragraphs": "<p[^>]*>",
}


@query(
    "page_counters",
    "SELECT page_id, "
    + ", ".join(f"len(regexp_extract_all(html, '{p}')) AS {n}" for n, p in _COUNTERS.items())
    + """, regexp_matches(html, '(?:class|id)="[^"]*(?:overlay|modal|popup)[^"]*"') AS overlay_signal, regexp_matches(html, '<meta name="viewport"') AS has_viewport,
    octet_length(encode(html)) AS bytes, least(octet_length(encode(html)), 2097152) AS bytes_read FROM pages""",
)
def page_counters(spark, sf_dir):
    counts = [F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0))).cast("long").alias(n) for n, p in _COUNTERS.items()]
    size = F.octet_length("html").cast("long")
    return table(spark, sf_dir, "pages").select("page_id", *counts, F.col("html").rlike('(?:class|id)="[^"]*(?:overlay|modal|popup)[^"]*"').alias("overlay_signal"), F.col("html").rlike('<meta name="viewport"').alias("has_viewport"), size.alias("bytes"), F.least(size, F.lit(2097152)).alias("bytes_read"))


@query("page_blocks", f"WITH {PG}, {BL} SELECT page_id, site, ord, line FROM bl")
def page_blocks(spark, sf_dir):
    return sources.blocks(sources.read_pages(spark, sf_dir))


@query("parsed_pages")
def parsed_pages(spark, sf_dir):
    """The Python parser's structure of each page, with arrays as JSON."""
    rows = parse_pages(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "title", "lang", "visible_text", "claim_text", F.to_json("headings").alias("headings"), F.to_json("sections").alias("sections"), F.to_json("links").alias("links"), "has_viewport", "tables", "details", F.col("state_strings").alias("state_strings"))


@query(
    "parsed_titles_and_headings",
    """SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, len(regexp_extract_all(html, '<h[1-6][^>]*>')) AS headings,
    len(regexp_extract_all(html, '<a href=')) AS links, regexp_matches(html, '<meta name="viewport"') AS has_viewport FROM pages""",
)
def parsed_titles_and_headings(spark, sf_dir):
    rows = parse_pages(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "lang", F.size("headings").cast("long").alias("headings"), F.size("links").cast("long").alias("links"), "has_viewport")


# ---- crawl ----------------------------------------------------------------------------------------------------------


@query(
    "crawl_candidates",
    rf"""WITH {PG}, {LK}, {LP}, own AS (SELECT site, page_id, ord, tpath AS path FROM lp WHERE tsite = site AND tpath <> '/'
      AND NOT regexp_matches(lower(tpath), '{crawl.ASSETS}') AND NOT regexp_matches(lower(tpath), '{crawl.FEEDS}')),
    once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, path ORDER BY page_id, ord) AS nth FROM own) WHERE nth = 1)
    SELECT site, ord, path FROM (SELECT site, row_number() OVER (PARTITION BY site ORDER BY page_id, ord, path) AS ord, path FROM once) WHERE ord <= 400""",
)
def crawl_candidates(spark, sf_dir):
    return crawl.candidates(sources.links(sources.read_pages(spark, sf_dir)))


@query(
    "site_url_clusters",
    f"""WITH {PG}, c AS (SELECT site, {tk_sql('path')} AS cluster, count(*) AS pages, min(page_id) AS first FROM pg GROUP BY ALL)
    SELECT site, rank, cluster, pages FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY pages DESC, first) AS rank FROM c) WHERE rank <= 15""",
)
def site_url_clusters(spark, sf_dir):
    return crawl.clusters(sources.read_pages(spark, sf_dir))


def _priority_sql(column: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p}') THEN {n}" for n, p in enumerate(crawl.PRIORITIES)) + f" ELSE {len(crawl.PRIORITIES)} END"


@query(
    "representative_pages",
    f"""WITH {PG}, r AS (SELECT *, CASE WHEN {np_sql('path')} = '/' THEN '/' ELSE {tk_sql('path')} END AS cluster FROM pg),
    n AS (SELECT *, row_number() OVER (PARTITION BY site, cluster ORDER BY page_id) AS nth FROM r),
    g AS (SELECT site, cluster, count(*) AS size, min(page_id) AS page_id, lower(concat_ws(' ', cluster, string_agg(path, ' ' ORDER BY path) FILTER (WHERE nth <= 3))) AS seen FROM n GROUP BY site, cluster),
    p AS (SELECT *, {_priority_sql('seen')} AS priority FROM g),
    o AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY CASE WHEN cluster = '/' THEN 0 WHEN regexp_matches(seen, '{crawl.AUTH}') THEN 3 WHEN priority < {len(crawl.PRIORITIES)} THEN 1 ELSE 2 END, priority, size DESC, page_id) AS rank FROM p)
    SELECT o.site, rank, page_id, url FROM o JOIN pages USING (page_id) WHERE rank <= 8""",
)
def representative_pages(spark, sf_dir):
    return crawl.representatives(sources.read_pages(spark, sf_dir))


@query("unlinked_pages", f"WITH {PG}, {LK}, {LP} SELECT DISTINCT site, {np_sql('path')} AS path FROM pg WHERE (site, {np_sql('path')}) NOT IN (SELECT site, tpath FROM lp WHERE tsite = site)")
def unlinked_pages(spark, sf_dir):
    p = sources.read_pages(spark, sf_dir)
    return crawl.orphans(p, sources.links(p))


@query("sitewide_links", f"WITH {PG}, {LK} SELECT site, href, count(DISTINCT page_id) AS pages FROM lk GROUP BY ALL HAVING count(DISTINCT page_id) >= 2")
def sitewide_links(spark, sf_dir):
    found = sources.links(sources.read_pages(spark, sf_dir))
    return found.groupBy("site", "href").agg(F.countDistinct("page_id").alias("pages")).filter("pages >= 2")


@query("url_key_duplicates", rf"""WITH {PG}, k AS (SELECT page_id, regexp_replace(site, '^www\.', '') || regexp_replace(regexp_replace(path, '/index\.html?$', ''), '/+$', '') AS url_key FROM pg)
    SELECT url_key, page_id AS kept, n AS copies FROM (SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY page_id) AS nth, count(*) OVER (PARTITION BY url_key) AS n FROM k) WHERE nth = 1""")
def url_key_duplicates(spark, sf_dir):
    k = table(spark, sf_dir, "pages").select("page_id", urls.url_key(F.col("url")).alias("url_key"))
    return k.groupBy("url_key").agg(F.min("page_id").alias("kept"), F.count(F.lit(1)).alias("copies"))


_CLASS_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower({{p}}), '{p}') THEN '{n}'" for n, p in crawl.CLASSES) + " ELSE 'other' END"


@query("page_predicates", f"""WITH {PG}, {LK}, {LP}, l AS (SELECT page_id, count(*) FILTER (WHERE tsite = site) AS own_links, count(*) FILTER (WHERE tsite <> site) AS other_links FROM lp GROUP BY 1)
    SELECT page_id, {_CLASS_SQL.format(p=np_sql('path'))} AS page_class, {_CLASS_SQL.format(p=np_sql('path'))} <> 'other' AS important,
    regexp_matches(lower(path), '{crawl.ASSETS}') OR regexp_matches(lower(path), '{crawl.FEEDS}') AS excluded, coalesce(own_links, 0) AS own_links, coalesce(other_links, 0) AS other_links
    FROM pg LEFT JOIN l USING (page_id)""")
def page_predicates(spark, sf_dir):
    p = sources.read_pages(spark, sf_dir)
    same = urls.authority(F.col("target")) == F.col("site")
    n = sources.links(p).groupBy("page_id").agg(F.count_if(same).alias("own_links"), F.count_if(~same).alias("other_links"))
    kind = crawl.page_class(urls.norm_path(F.col("path")))
    low = F.lower("path")
    return p.join(n, "page_id", "left").select("page_id", kind.alias("page_class"), kind.isin(*crawl.IMPORTANT).alias("important"), (low.rlike(crawl.ASSETS) | low.rlike(crawl.FEEDS)).alias("excluded"), F.coalesce("own_links", F.lit(0)).alias("own_links"), F.coalesce("other_links", F.lit(0)).alias("other_links"))


# ---- shared lines ---------------------------------------------------------------------------------------------------

_SHARED = """op AS (SELECT * FROM {src} WHERE ord <= 150), sz AS (SELECT site, count(DISTINCT page_id) AS n FROM op GROUP BY 1),
    sh AS (SELECT site, line, count(DISTINCT page_id) AS pages, any_value(n) AS n FROM op JOIN sz USING (site) WHERE n >= 2 GROUP BY site, line HAVING count(DISTINCT page_id) >= greatest(2, ceil(any_value(n) / 2)))"""
_OPENING = """mk AS (SELECT op.*, sh.line IS NOT NULL AS shared FROM op LEFT JOIN sh USING (site, line)),
    fo AS (SELECT page_id, min(CASE WHEN NOT shared THEN ord END) AS f FROM mk GROUP BY 1),
    so AS (SELECT site, page_id, count(*) AS lines, sum(length(line) + 1)::BIGINT AS chars FROM mk JOIN fo USING (page_id) WHERE f IS NULL OR ord < f GROUP BY ALL)"""
_DOC_LINES = """dl AS (SELECT doc_id AS page_id, source AS site, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS ord FROM
    (SELECT doc_id, source, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)) WHERE line <> '')"""


def document_lines(spark, sf_dir):
    """Documents as pages of their source: (page_id, site, ord, line)."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.col("source").alias("site"), F.posexplode(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x != "")).alias("ord", "line"))
    return rows.withColumn("ord", F.col("ord") + 1)


@query("shared_opening_lines", f"WITH {PG}, {BL}, {_SHARED.format(src='bl')} SELECT site, line, pages FROM sh")
def shared_opening_lines(spark, sf_dir):
    return crawl.shared_lines(sources.blocks(sources.read_pages(spark, sf_dir)))


@query("shared_openings_by_page", f"WITH {PG}, {BL}, {_SHARED.format(src='bl')}, {_OPENING} SELECT site, page_id, lines, chars FROM so")
def shared_openings_by_page(spark, sf_dir):
    return crawl.shared_openings(sources.blocks(sources.read_pages(spark, sf_dir)))


_LOSS = f"""{_SHARED.format(src='{src}')}, {_OPENING}, sr AS (SELECT site, count(*) AS sharers, floor(median(chars))::BIGINT AS median_chars FROM so WHERE lines >= 5 GROUP BY 1)
    SELECT site, coalesce(sharers, 0) AS sharers, median_chars, CASE WHEN n < 2 THEN 'not_evaluated' WHEN coalesce(sharers, 0) >= greatest(2, ceil(n / 2)) AND median_chars > 1500 THEN 'finding' ELSE 'pass' END AS gate
    FROM sz LEFT JOIN sr USING (site)"""


@query("extraction_loss", f"WITH {PG}, {BL}, " + _LOSS.replace("{src}", "bl"))
def extraction_loss(spark, sf_dir):
    return crawl.extraction_loss(sources.blocks(sources.read_pages(spark, sf_dir)))


@query("extraction_loss_by_source", f"WITH {_DOC_LINES}, " + _LOSS.replace("{src}", "dl"))
def extraction_loss_by_source(spark, sf_dir):
    return crawl.extraction_loss(document_lines(spark, sf_dir))


@query("repeated_blocks", f"WITH {PG}, {BL} SELECT site, line, count(DISTINCT page_id) AS pages FROM bl GROUP BY ALL")
def repeated_blocks(spark, sf_dir):
    return runs.repeated_runs(sources.blocks(sources.read_pages(spark, sf_dir)))


@query("anchorable_blocks", f"""WITH {PG}, {BL}, c AS (SELECT site, line, count(DISTINCT page_id) AS pages FROM bl GROUP BY ALL)
    SELECT page_id, rank, line FROM (SELECT page_id, line, row_number() OVER (PARTITION BY page_id ORDER BY pages, length(line) DESC, line) AS rank FROM (SELECT DISTINCT site, page_id, line FROM bl) JOIN c USING (site, line)) WHERE rank <= 10""")
def anchorable_blocks(spark, sf_dir):
    return runs.anchorable(sources.blocks(sources.read_pages(spark, sf_dir)))


@query("adjacent_blocks", f"WITH {PG}, {BL} SELECT * FROM (SELECT page_id, ord, line || ' ' || lead(line) OVER (PARTITION BY page_id ORDER BY ord) AS pair FROM bl) WHERE pair IS NOT NULL")
def adjacent_blocks(spark, sf_dir):
    return runs.adjacent_pairs(sources.blocks(sources.read_pages(spark, sf_dir)))


@query("section_offsets", f"WITH {PG}, {BL} SELECT page_id, ord, coalesce(sum(length(line) + 1) OVER (PARTITION BY page_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_offset FROM bl")
def section_offsets(spark, sf_dir):
    before = Window.partitionBy("page_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return sources.blocks(sources.read_pages(spark, sf_dir)).select("page_id", "ord", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).alias("char_offset"))


@query("viewport_absent", f"""WITH {PG}, s AS (SELECT site, count(*) FILTER (WHERE NOT v) AS n, count(*) AS seen FROM (SELECT site, regexp_matches(html, '<meta name="viewport"') AS v FROM pg) GROUP BY 1)
    SELECT site, 'REF-VIEWPORT-ABSENT' AS check_id, CASE WHEN n > 0 THEN 'finding' ELSE 'pass' END AS gate, CASE WHEN n = 0 THEN NULL WHEN n = seen THEN 'medium' ELSE 'low' END AS severity, n || ' of ' || seen || ' pages' AS evidence FROM s""")
def viewport_absent(spark, sf_dir):
    p = sources.read_pages(spark, sf_dir).withColumn("has_viewport", F.col("html").rlike('<meta name="viewport"'))
    return checks.viewport_absent(p).select("site", "check_id", "gate", "severity", "evidence")


@query("sitemap_orphans", f"""WITH {PG}, {LK}, {LP}, ls AS (SELECT DISTINCT site, {np_sql('path')} AS path FROM pg), al AS (SELECT * FROM ls WHERE (site, path) NOT IN (SELECT site, tpath FROM lp WHERE tsite = site)),
    a AS (SELECT site, count(*) AS candidates FROM ls GROUP BY 1), b AS (SELECT site, count(*) AS orphans FROM al GROUP BY 1)
    SELECT site, CASE WHEN coalesce(orphans, 0) > 0 AND candidates >= 50 THEN 'finding' ELSE 'pass' END AS gate, coalesce(orphans, 0) || ' of ' || candidates || ' listed pages have no link' AS evidence FROM a LEFT JOIN b USING (site)""")
def sitemap_orphans(spark, sf_dir):
    p = sources.read_pages(spark, sf_dir)
    return checks.sitemap_orphan(p, sources.links(p)).select("site", "gate", "evidence")


_BASE = r"regexp_extract(lower(regexp_extract(target, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '([^.]+\.[^.]+)$', 1)"


#: Domains of others that tell of a site, of profiles that a site keeps itself, and of registries.
DOMAINS = {
    "independent": "wikipedia.org wikidata.org crunchbase.com producthunt.com g2.com capterra.com trustpilot.com yelp.com bbb.org news.ycombinator.com".split(),
    "owned": "linkedin.com twitter.com x.com facebook.com instagram.com youtube.com tiktok.com medium.com substack.com discord.com".split(),
    "registry": "github.com npmjs.com pypi.org gitlab.com".split(),
}
_KNOWN = ", ".join(f"('{d}', '{kind}')" for kind, domains in DOMAINS.items() for d in domains)


@query("link_classes", f"""WITH {PG}, {LK}, known(domain, kind) AS (VALUES {_KNOWN}), lt AS (SELECT site, regexp_replace(lower(regexp_extract(target, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') AS host FROM lk)
    SELECT site, CASE WHEN host = regexp_replace(site, '^www\\.', '') OR ends_with(host, '.' || regexp_replace(site, '^www\\.', '')) THEN 'own' ELSE coalesce(kind, 'unknown') END AS ownership, count(*) AS links FROM lt LEFT JOIN known ON domain = host GROUP BY ALL""")
def link_classes(spark, sf_dir):
    """How many links of a site go to itself, to known domains of each kind, and elsewhere."""
    found = sources.links(sources.read_pages(spark, sf_dir))
    bare = lambda host: F.regexp_replace(host, r"^www\.", "")
    known = spark.createDataFrame([(d, kind) for kind, domains in DOMAINS.items() for d in domains], "host string, kind string")
    rows = found.withColumn("host", bare(urls.authority(F.col("target")))).join(F.broadcast(known), "host", "left")
    own = (F.col("host") == bare(F.col("site"))) | F.col("host").endswith(F.concat(F.lit("."), bare(F.col("site"))))
    return rows.groupBy("site", F.when(own, "own").otherwise(F.coalesce("kind", F.lit("unknown"))).alias("ownership")).agg(F.count(F.lit(1)).alias("links"))


#: Site types with the types of their structured data, parts of their URL paths, and their wording.
TYPES = {
    "ecommerce": ("product offer aggregateoffer itemlist/product", "/products/ /product/ /collections/ /cart /checkout /shop", "add to cart|add to bag|shopping cart|free shipping|sale price"),
    "docs-developer": ("techarticle apireference softwaresourcecode", "/docs /documentation /api/ /reference /guide /tutorial /whatsnew /library /manual", "api reference|getting started|installation|changelog|sdk|documentation|module index|library reference|release notes"),
    "saas": ("softwareapplication webapplication service", "/pricing /signup /sign-up /login /integrations /features /plan /enterprise /customers /security", "free trial|start free|per user|per month|book a demo|pricing|sign up|log in|get started free|for teams"),
    "local-business": ("localbusiness restaurant dentist medicalclinic medicalbusiness store hotel professionalservice", "/locations /book-appointment /appointment /directions /menu /opening-hours", "opening hours|book an appointment|find us|call us|our location|walk-ins|make a reservation"),
    "publisher": ("newsarticle article blogposting newsmediaorganization liveblogposting", "/news /article /story /blog/ /opinion /archive", "subscribe|latest news|breaking|editor|newsletter"),
    "gov-edu": ("governmentorganization collegeoruniversity educationalorganization govermentservice school", "/admission /scheme /tender /notice /circular /department", "admission|notification|government of|prospectus|faculty"),
    "marketplace-platform": ("itemlist searchresultspage", "/sellers /vendors /listings /marketplace /browse", "become a seller|list your|sellers|vendors|marketplace"),
    "org-portfolio": ("organization ngo nonprofit person creativework", "/about /work /projects /services /portfolio /team", "our work|our mission|case study|what we do|get in touch"),
}
#: Beginnings of hosts, patterns of hosts, and the points that they give.
HOSTS = (("^docs[.]|^developer[.]|^api[.]", "docs-developer", 5), ("^shop[.]|^store[.]", "ecommerce", 5), ("^news[.]|^blog[.]", "publisher", 5), (r"(^|[.])(gov|mil)([.][a-z]{2,3})?$|(^|[.])(edu|ac)([.][a-z]{2,3})?$|[.]nic[.]in$", "gov-edu", 10))
_CUES = [(t, n, cue) for t, parts in TYPES.items() for n, cue in [*((0, c) for c in parts[0].split()), *((1, c) for c in parts[1].split()), *((2, c) for c in parts[2].split("|"))]]
READ_LINKS = 120  # links of a page whose wording counts


@query("site_type_scores", rf"""WITH {PG}, {LK}, cue(site_type, kind, cue) AS (VALUES {', '.join(f"('{t}', {n}, '{c}')" for t, n, c in _CUES)}), host(pattern, site_type, points) AS (VALUES {', '.join(f"('{p}', '{t}', {n})" for p, t, n in HOSTS)}),
    tx AS (SELECT site, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS t FROM pg UNION ALL SELECT site, lower(unnest(regexp_extract_all(html, '{sources.HEADING}', 2))) FROM pg UNION ALL SELECT site, lower(anchor_text) FROM lk WHERE ord <= {READ_LINKS}),
    ty AS (SELECT DISTINCT site, lower(trim(unnest(regexp_extract_all(array_to_string(regexp_extract_all(html, '(?s)<script type="application/ld\+json">(.*?)</script>', 1), ' '), '"@type"\s*:\s*"([^"]+)"', 1)))) AS type FROM pg),
    pa AS (SELECT site, page_id, lower(path) AS path FROM pg),
    part AS (SELECT site, site_type, 4 * count(*) AS points FROM ty JOIN cue ON kind = 0 AND cue = type GROUP BY ALL
      UNION ALL SELECT site, site_type, least(6, count(DISTINCT page_id)) FROM pa JOIN cue ON kind = 1 AND contains(path, cue) GROUP BY ALL
      UNION ALL SELECT site, site_type, 2 * count(DISTINCT cue) FROM tx JOIN cue ON kind = 2 AND contains(t, cue) GROUP BY ALL
      UNION ALL SELECT s.site, h.site_type, h.points FROM (SELECT DISTINCT site FROM pg) s JOIN host h ON regexp_matches(s.site, h.pattern)),
    s AS (SELECT site, site_type, sum(points) AS score FROM part GROUP BY ALL)
    SELECT site, site_type, score::BIGINT AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY score DESC, site_type) AS rank, max(score) OVER (PARTITION BY site) AS best FROM s) WHERE rank <= 3 AND score >= greatest(4, best / 2)""")
def site_type_scores(spark, sf_dir):
    """Up to three types of each site: four points for a type of structured data, one for a URL up to six, two for a
    phrase in titles, headings or links, and points for the form of the host. Cues are constants of each row's
    expressions, so nothing is joined; a site's rows meet in aggregates that combine before the shuffle."""
    p = sources.read_pages(spark, sf_dir)
    lower = lambda c: F.coalesce(F.lower(c), F.lit(""))
    read = p.select("site", lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("t"))
    read = read.unionByName(sources.headings(p).join(p.select("page_id", "site"), "page_id").select("site", lower("text").alias("t")))
    read = read.unionByName(sources.links(p, READ_LINKS).select("site", lower("anchor_text").alias("t")))
    cues = lambda kind: F.array(*[F.struct(F.lit(t).alias("site_type"), F.lit(c).alias("cue")) for t, n, c in _CUES if n == kind])
    said = read.select("site", F.inline(F.filter(cues(2), lambda x: F.contains(F.col("t"), x["cue"])))).distinct()
    blobs = F.array_join(F.regexp_extract_all("html", F.lit(r'(?s)<script type="application/ld\+json">(.*?)</script>'), F.lit(1)), " ")
    types = p.select("site", F.explode(F.regexp_extract_all(blobs, F.lit(r'"@type"\s*:\s*"([^"]+)"'), F.lit(1))).alias("type")).select("site", F.lower(F.trim("type")).alias("type")).distinct()
    typed = types.select("site", F.inline(F.filter(cues(0), lambda x: x["cue"] == F.col("type"))))
    here = F.array_distinct(F.transform(F.filter(cues(1), lambda x: F.contains(F.lower("path"), x["cue"])), lambda x: x["site_type"]))
    placed = p.select("site", F.explode(here).alias("site_type")).groupBy("site", "site_type").agg(F.least(F.lit(6), F.count(F.lit(1))).alias("points"))
    hosts = F.array(*[F.struct(F.when(F.col("site").rlike(pattern), F.lit(t)).alias("site_type"), F.lit(n).cast("long").alias("points")) for pattern, t, n in HOSTS])
    formed = p.select("site").distinct().select("site", F.inline(hosts)).filter("site_type is not null")
    parts = said.select("site", "site_type", F.lit(2).cast("long").alias("points")).unionByName(typed.select("site", "site_type", F.lit(4).cast("long").alias("points"))).unionByName(placed).unionByName(formed)
    s = parts.groupBy("site", "site_type").agg(F.sum("points").alias("score"))
    order = Window.partitionBy("site")  # a row for each type: eight at most
    s = s.withColumn("rank", F.row_number().over(order.orderBy(F.desc("score"), "site_type"))).withColumn("best", F.max("score").over(order))
    return s.filter((F.col("rank") <= 3) & (F.col("score") >= F.greatest(F.lit(4), F.col("best") / 2))).select("site", "site_type", "score", "rank")


# ---- documents: claims, text, labels, passages ----------------------------------------------------------------------

_TYPE_SQL = " UNION ALL ".join(f"SELECT doc_id, source, text, {n} AS type_ord, '{name}' AS type, unnest(regexp_extract_all(text, '{p}')) AS value, generate_subscripts(regexp_extract_all(text, '{p}'), 1) AS pos FROM documents" for n, (name, p) in enumerate(claim_functions.PATTERNS))
EVERY_CL = rf"""SELECT doc_id, source, ord, type, value, quote FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY type_ord, pos) AS ord,
    substring(coalesce(list_filter(string_split(text, chr(10)), lambda x: contains(x, value))[1], value), 1, 160) AS quote FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id, type, value ORDER BY pos) AS nth FROM (SELECT doc_id, source, text, type_ord, type, trim(value) AS value, pos FROM ({_TYPE_SQL})) WHERE type <> 'count' OR NOT contains(value, '.')) WHERE nth = 1)"""
CL = f"cl AS ({EVERY_CL} WHERE ord <= 30)"


def document_claims(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return claim_functions.claims(docs, "doc_id", "text").join(docs.select("doc_id", "source"), "doc_id")


@query("claims", f"WITH {CL} SELECT doc_id, ord, type, value, quote FROM cl")
def claims(spark, sf_dir):
    return claim_functions.claims(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("claim_topic_counts", f"WITH {CL} SELECT source, type, count(*) AS claims FROM cl GROUP BY ALL")
def claim_topic_counts(spark, sf_dir):
    return runs.topic_counts(document_claims(spark, sf_dir), "source")


@query("claim_matrix", f"WITH {CL} SELECT source, type, string_agg(doc_id || ':' || value, '|' ORDER BY nth) AS entries FROM (SELECT *, row_number() OVER (PARTITION BY source, type ORDER BY doc_id, ord) AS nth FROM cl) WHERE nth <= 8 GROUP BY ALL")
def claim_matrix(spark, sf_dir):
    return runs.claim_matrix(document_claims(spark, sf_dir), "source", "doc_id")


@query("claim_collapse", f"""WITH {CL}, g AS (SELECT source, type, value, count(*) AS rows, min((doc_id, ord)) AS first FROM cl GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source, type ORDER BY first, value) AS rank FROM g)
    SELECT source, type, value, rows, rows > 5 AS collapsed, rank FROM r WHERE rank <= 6 UNION ALL SELECT source, type, NULL, count(*), FALSE, 7 FROM r WHERE rank > 6 GROUP BY source, type""")
def claim_collapse(spark, sf_dir):
    return runs.collapse_claims(document_claims(spark, sf_dir), "source", "doc_id")


@query("claim_conflicts", f'WITH cl AS ({EVERY_CL}) SELECT source, type, count(DISTINCT value) AS "values", count(DISTINCT doc_id) AS pages FROM cl GROUP BY ALL HAVING count(DISTINCT value) > 1 AND count(DISTINCT doc_id) > 1')
def claim_conflicts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.struct("source", "doc_id").alias("key"), "text")
    return runs.conflicts(claim_functions.every(docs, "key", "text").select("key.*", "type", "value"), "source", "doc_id")


_SP = "[ \\t\\n\\r\\x0B\\f\\x{A0}]+"
_LEGAL = ", ".join(f"'{w}'" for w in (*texts.STOP_WORDS, *texts.LEGAL_WORDS))


@query("text_functions", f"""WITH f AS (SELECT doc_id, text, trim(regexp_replace(text, '{_SP}', ' ', 'g')) AS folded FROM documents)
    SELECT doc_id, md5(folded) AS folded_md5, CASE WHEN length(folded) > 200 THEN substring(folded, 1, 199) || '…' ELSE folded END AS short,
    (CASE WHEN folded = '' THEN 0 ELSE len(string_split(folded, ' ')) END)::INTEGER AS words,
    array_to_string(list_filter(regexp_extract_all(lower(substring(text, 1, 60)), '[a-z0-9]+'), lambda w: w NOT IN ({_LEGAL})), ' ') AS name_tokens,
    length(folded) >= 25 AND len(string_split(folded, ' ')) >= 5 AND NOT regexp_matches(folded, '^[/#{{]') AND NOT regexp_matches(lower(folded), '^(?:http|fn:|urn:)') AS fact_like FROM f""")
def text_functions(spark, sf_dir):
    t = F.col("text")
    folded = texts.fold_spaces(t)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(folded).alias("folded_md5"), texts.shorten(folded).alias("short"), texts.word_count(t).alias("words"), F.array_join(texts.name_tokens(F.substring(t, 1, 60)), " ").alias("name_tokens"), texts.fact_like(t).alias("fact_like"))


@query("document_name_tokens", f"""SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ({_LEGAL})), ' ') AS name_tokens FROM documents""")
def document_name_tokens(spark, sf_dir):
    """Name tokens of whole texts; text_functions and its SQL hold those of the first 60 characters."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(texts.name_tokens(F.col("text")), " ").alias("name_tokens"))


@query("label_backfill", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def label_backfill(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("passage_containment", "SELECT item_id, count(DISTINCT doc_id) AS documents FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1")
def passage_containment(spark, sf_dir):
    """In how many documents a benchmark passage stands. Both sides meet under the first six words, so the containment
    test follows an equality join."""
    words = lambda c: F.split(c, " ")
    head = lambda w, i: F.array_join(F.slice(w, i, 3), " ")
    bench = table(spark, sf_dir, "benchmark").filter("text <> ''")
    # A passage may begin inside a word of the document; its second to fourth words are whole there.
    bench = bench.select("item_id", F.col("text").alias("passage"), words("text").alias("w")).withColumn("long", F.size("w") >= 5)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    keys = docs.select("doc_id", "text", words("text").alias("w")).select("doc_id", "text", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1))), lambda i: head(F.col("w"), i)))).alias("h"))
    met = keys.join(F.broadcast(bench.filter("long").select("item_id", "passage", head(F.col("w"), 2).alias("h"))), "h").filter(F.contains("text", F.col("passage")))
    short = docs.join(F.broadcast(bench.filter("not long").select("item_id", "passage")), F.contains(F.col("text"), F.col("passage")))
    return met.select("item_id", "doc_id").unionByName(short.select("item_id", "doc_id")).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"))


@query("nearest_runs", """WITH w AS (SELECT item_id, unnest(list_distinct(string_split(lower(text), ' '))) AS w FROM benchmark), c AS (SELECT a.item_id, b.item_id AS other, count(*) AS shared FROM w a JOIN w b ON a.w = b.w AND a.item_id <> b.item_id GROUP BY ALL)
    SELECT item_id, other, shared, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, other) AS rank FROM c) WHERE rank <= 3""")
def nearest_runs(spark, sf_dir):
    w = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("w"))
    c = w.join(w.select(F.col("item_id").alias("other"), "w"), "w").filter("item_id <> other").groupBy("item_id", "other").agg(F.count(F.lit(1)).alias("shared"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("shared"), "other"))).filter("rank <= 3")


@query("run_lengths", "SELECT source, min(n_chars) AS least, max(n_chars) AS most, avg(n_chars) AS mean, median(n_chars) AS median, count(*) AS documents FROM documents GROUP BY 1")
def run_lengths(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.avg("n_chars").alias("mean"), F.expr("percentile(n_chars, 0.5)").alias("median"), F.count(F.lit(1)).alias("documents"))

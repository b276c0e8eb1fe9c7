"""Checks of the pages themselves, and queries for what the driver's pages do not hold: robots files, probes, headers and
results, given as small tables.

What the pages do not hold is derived from them (observed.py); nulls stand for what was not observed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import claims as claim_functions
from ..functions import texts, urls
from ..operators import checks, phrase_index, robots, runs
from ..sources import pages as sources
from ..sources import snapshots
from ..sources.derived import Derived, ctes
from ..sources.inline import Inline
from ..sources.parse import parse_pages
from ..sources.scratch import written
from . import report
from .catalog import CATALOG, SURFACES
from .observed import (FILES, PATHS, RFETCH, HEADS, BOTS, CANON, CHAINS, UA, MAPS, SITEMAP, ALTS, LLMS, ROT, TIMES, PRESENCE, NAMES, MISSING, VARIANTS, DATES, LEVELS, QUESTIONS, TARGETS, BLOCKS, PASSAGES, RESOLVE, RESULTS, IDEAS, VERDICTS, MEASURES, PROBES, PROMPTS, SPACED, TOKENS, HTML_MADE,)
from .site_queries import PG, np_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The tables that a query derives from the pages or has in code.
TABLES: dict[str, tuple] = {}


def query(name: str, sql: str | None = None, *tables: Inline | Derived):
    def register(f):
        QUERIES[name] = f
        if sql:
            TABLES[name] = tables
            ORACLES[name] = (f"WITH RECURSIVE {ctes(tables, PG)}" + (", " if sql.startswith("+") else " ") + sql.lstrip("+")) if tables else sql
        return f

    return register


SHORT = ("site", "gate", "severity", "confidence")

# ---- robots ---------------------------------------------------------------------------------------------------------

_RULES = r"""li AS (SELECT site, unnest(string_split(body, '|')) AS raw, generate_subscripts(string_split(body, '|'), 1) - 1 AS ord FROM files),
  fv AS (SELECT site, ord, lower(trim(regexp_extract(trim(regexp_replace(raw, '#.*$', '')), '^([^:]*):', 1))) AS field, trim(regexp_extract(trim(regexp_replace(raw, '#.*$', '')), '^[^:]*:(.*)$', 1)) AS value FROM li),
  fl AS (SELECT *, coalesce(lag(field) OVER (PARTITION BY site ORDER BY ord), '') AS was FROM fv WHERE field IN ('user-agent', 'allow', 'disallow')),
  gr AS (SELECT *, sum(CASE WHEN field = 'user-agent' AND was <> 'user-agent' THEN 1 ELSE 0 END) OVER (PARTITION BY site ORDER BY ord) AS grp FROM fl),
  ru AS (SELECT a.site, a.grp::BIGINT AS grp, lower(a.value) AS token, r.field AS kind, r.value AS rule, r.ord FROM gr a LEFT JOIN (SELECT * FROM gr WHERE field <> 'user-agent' AND value <> '') r ON a.site = r.site AND a.grp = r.grp WHERE a.field = 'user-agent')"""
_EFFECTIVE = """tk AS (SELECT lower(token) AS token, role FROM surfaces), ef AS (SELECT site, token, kind, rule, ord, TRUE AS named FROM ru JOIN tk USING (token)
  UNION ALL SELECT s.site, t.token, r.kind, r.rule, r.ord, FALSE FROM (SELECT DISTINCT site FROM ru) s, tk t JOIN ru r ON r.token = '*' WHERE r.site = s.site AND (s.site, t.token) NOT IN (SELECT site, token FROM ru))"""
_DECIDE = """ma AS (SELECT p.site, e.token, p.path, e.rule, e.kind, e.named, length(rtrim(rule, '*$')) * 1000000 + CASE WHEN kind = 'disallow' THEN 10000 ELSE 0 END - ord AS size,
    rule IS NOT NULL AND CASE WHEN ends_with(rule, '$') THEN path = left(rule, length(rule) - 1) ELSE left(path, length(rtrim(rule, '*'))) = rtrim(rule, '*') END AS hit FROM paths p JOIN ef e USING (site)),
  de AS (SELECT site, token, path, max_by(rule, size) FILTER (WHERE hit) AS rule, coalesce(max_by(kind, size) FILTER (WHERE hit) = 'disallow', FALSE) AS blocked, bool_or(named) AS named FROM ma GROUP BY ALL)"""


def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots.parse(FILES.df(spark, sf_dir).withColumn("body", F.translate("body", "|", "\n")))


def robots_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = robots_rules(spark, sf_dir)
    named = rules.select("site", "token").distinct().withColumn("named", F.lit(True))
    decided = robots.decide(PATHS.df(spark, sf_dir), robots.effective(rules, SURFACES.df(spark)))
    return decided.join(named, ["site", "token"], "left").withColumn("named", F.coalesce("named", F.lit(False)))


@query("robots_rules", f"+{_RULES} SELECT site, grp, token, kind, rule, ord::INTEGER AS ord FROM ru", FILES)
def _(spark, sf_dir):
    return robots_rules(spark, sf_dir)


@query("robots_longest_match", f"+{_RULES}, {_EFFECTIVE}, {_DECIDE} SELECT site, token, path, rule, blocked FROM de", FILES, PATHS, SURFACES)
def _(spark, sf_dir):
    return robots_decisions(spark, sf_dir).select("site", "token", "path", "rule", "blocked")


@query("token_roles", "SELECT t.page_id, t.token, coalesce(s.role, CASE WHEN t.token = '*' THEN 'wildcard' ELSE 'unknown' END) AS role FROM tokens t LEFT JOIN surfaces s USING (token)", TOKENS, SURFACES)
def _(spark, sf_dir):
    role = F.coalesce("role", F.when(F.col("token") == "*", "wildcard").otherwise("unknown"))
    return TOKENS.df(spark, sf_dir).join(F.broadcast(SURFACES.df(spark)), "token", "left").select("page_id", "token", role.alias("role"))


@query("check_robots_role", f"""+{_RULES}, {_EFFECTIVE}, {_DECIDE}, h AS (SELECT d.site, bool_or(blocked AND named) AS hit, bool_or(blocked AND named AND path = '/') AS root FROM de d JOIN tk USING (token) WHERE role = 'search-index' GROUP BY 1)
  SELECT site, CASE WHEN hit THEN 'finding' ELSE 'pass' END AS gate, CASE WHEN hit THEN CASE WHEN root THEN 'critical' ELSE 'high' END END AS severity, CASE WHEN hit THEN 'high' END AS confidence FROM h""", FILES, PATHS, SURFACES)
def _(spark, sf_dir):
    return checks.robots_role(robots_decisions(spark, sf_dir), SURFACES.df(spark).filter("role = 'search-index'")).select(*SHORT)


@query("check_robots_unavailable", """, l AS (SELECT site, max_by(status, attempt) AS status, max(attempt) AS attempts FROM rf GROUP BY 1), g AS (SELECT *, CASE WHEN status = 404 OR status < 400 THEN 'pass' ELSE 'finding' END AS gate FROM l)
  SELECT site, gate, CASE WHEN gate = 'finding' THEN 'high' END AS severity, CASE WHEN gate = 'finding' THEN CASE WHEN attempts >= 2 THEN 'high' ELSE 'low' END END AS confidence FROM g""".replace(", l AS", "+l AS", 1), RFETCH)
def _(spark, sf_dir):
    return checks.robots_unavailable(RFETCH.df(spark, sf_dir)).select(*SHORT)


# ---- reach ----------------------------------------------------------------------------------------------------------

_NAMES = "nm AS (SELECT *, list_transform(list_filter(list_transform(string_split_regex(lower(concat_ws(',', robots_meta, x_robots_tag)), '[,;]'), lambda p: trim(p)), lambda p: p <> ''), lambda p: p) AS names FROM heads WHERE page_class <> 'other')"


@query("check_index_control", f"""+{_NAMES}, r AS (SELECT nm.*, list_has_any(names, ['noindex', 'none']) AS o, list_has_any(names, ['nosnippet', 'max-snippet:0']) AS c, b.sees FROM nm LEFT JOIN (SELECT site, path, bool_and(NOT noindex) AS sees FROM bots GROUP BY ALL) b USING (site, path)),
  s AS (SELECT site, bool_or(o) AS o, bool_or(o AND path = '/') AS root, bool_and(NOT o OR coalesce(sees, FALSE)) AS doubt, bool_or(c) AS c FROM r GROUP BY 1)
  SELECT site, CASE WHEN o THEN 'finding' ELSE 'pass' END AS gate, CASE WHEN o THEN CASE WHEN root THEN 'critical' ELSE 'high' END END AS severity, CASE WHEN o THEN CASE WHEN doubt THEN 'low' ELSE 'high' END END AS confidence FROM s
  UNION ALL SELECT site, 'finding', 'high', 'high' FROM s WHERE c""", HEADS, BOTS)
def _(spark, sf_dir):
    return checks.index_control(HEADS.df(spark, sf_dir), BOTS.df(spark, sf_dir)).select(*SHORT)


@query("check_noarchive", f"""+{_NAMES}, s AS (SELECT site, bool_or(list_contains(names, 'noarchive')) AS a, bool_or(list_contains(names, 'nocache')) AS c FROM nm GROUP BY 1)
  SELECT site, CASE WHEN a OR c THEN 'finding' ELSE 'pass' END AS gate, CASE WHEN a THEN 'high' WHEN c THEN 'medium' END AS severity, CASE WHEN a OR c THEN 'high' END AS confidence FROM s""", HEADS)
def _(spark, sf_dir):
    return checks.noarchive(HEADS.df(spark, sf_dir)).select(*SHORT)


@query("directive_entries", """+p AS (SELECT url, unnest(string_split_regex(lower(concat_ws(',', robots_meta, x_robots_tag)), '[,;]')) AS part FROM heads)
  SELECT url, trim(regexp_replace(part, ':.*$', '')) AS name, CASE WHEN contains(part, ':') THEN trim(regexp_extract(part, ':(.*)$', 1)) END AS value FROM p WHERE trim(part) <> ''""", HEADS)
def _(spark, sf_dir):
    d = HEADS.df(spark, sf_dir).select("url", F.explode(texts.directives(F.concat_ws(",", "robots_meta", "x_robots_tag"))).alias("d"))
    return d.select("url", "d.name", "d.value")


def _key_sql(c: str) -> str:
    return rf"(regexp_replace(lower(regexp_extract({c}, '^[a-z]*://([^/?#]*)', 1)), '^www\.', '') || regexp_replace(regexp_replace(regexp_extract({c}, '^[a-z]*://[^/?#]*([^?#]*)', 1), '/index\.html?$', ''), '/+$', ''))"


@query("check_canonical_conflict", f"""+k AS (SELECT *, {_key_sql('canonical')} AS target, {_key_sql('canonical')} <> {_key_sql('url')} AS bad FROM canon WHERE canonical IS NOT NULL),
  s AS (SELECT site, count(*) FILTER (WHERE bad) AS n, count(DISTINCT target) FILTER (WHERE bad) AS targets, count(*) FILTER (WHERE bad AND redirected) AS moved, count(*) AS al FROM k GROUP BY 1),
  g AS (SELECT *, CASE WHEN n = 0 OR (n >= 2 AND targets = 1) THEN 'pass' ELSE 'finding' END AS gate FROM s)
  SELECT site, gate, CASE WHEN gate = 'finding' THEN CASE WHEN moved > 0 AND n >= greatest(2, al / 2) THEN 'high' ELSE 'medium' END END AS severity, CASE WHEN gate = 'finding' THEN CASE WHEN moved > 0 THEN 'high' WHEN n <= 2 THEN 'low' ELSE 'medium' END END AS confidence FROM g""", CANON)
def _(spark, sf_dir):
    return checks.canonical_conflict(CANON.df(spark, sf_dir)).select(*SHORT)


@query("check_redirect_loop", """+k AS (SELECT site, list_transform(redirect_chain, lambda u: lower(regexp_extract(u, '^([a-z]*://[^/]*)', 1)) || regexp_extract(u, '^[a-z]*://[^/]*(.*)$', 1)) AS ks FROM chains),
  s AS (SELECT site, bool_or(len(list_distinct(ks)) < len(ks)) AS l, max(len(ks) - 1) AS hops FROM k GROUP BY 1)
  SELECT site, CASE WHEN l OR hops >= 4 THEN 'finding' ELSE 'pass' END AS gate, CASE WHEN l THEN 'high' WHEN hops >= 4 THEN 'medium' END AS severity, CASE WHEN l OR hops >= 4 THEN 'high' END AS confidence FROM s""", CHAINS)
def _(spark, sf_dir):
    return checks.redirect_loop(CHAINS.df(spark, sf_dir)).select(*SHORT)


@query("check_bot_challenge", """+s AS (SELECT site, bool_or(coalesce(status <> browser_status AND status IN (401, 403, 429, 503), FALSE)) AS hit, bool_or(status IS NOT NULL AND browser_status IS NOT NULL) AS seen FROM ua GROUP BY 1)
  SELECT site, CASE WHEN hit THEN 'finding' WHEN seen THEN 'pass' ELSE 'not_evaluated' END AS gate, CASE WHEN hit THEN 'high' END AS severity, CASE WHEN hit THEN 'medium' END AS confidence FROM s""", UA)
def _(spark, sf_dir):
    return checks.bot_challenge(UA.df(spark, sf_dir)).select(*SHORT)


@query("check_sitemap_invalid", """+s AS (SELECT site, count(*) FILTER (WHERE declared AND (coalesce(status >= 400, TRUE) OR NOT coalesce(parse_ok, FALSE))) AS n FROM maps GROUP BY 1)
  SELECT site, CASE WHEN n > 0 THEN 'finding' ELSE 'pass' END AS gate, CASE WHEN n > 0 THEN 'medium' END AS severity, CASE WHEN n > 0 THEN 'high' END AS confidence FROM s""", MAPS)
def _(spark, sf_dir):
    return checks.sitemap_invalid(MAPS.df(spark, sf_dir)).select(*SHORT)


_ENTRIES = "en AS (SELECT site, regexp_extract(u, '<loc>([^<]*)</loc>', 1) AS url, nullif(regexp_extract(u, '<lastmod>([^<]*)</lastmod>', 1), '') AS lastmod, ord FROM (SELECT site, unnest(regexp_extract_all(body, '<url>.*?</url>')) AS u, generate_subscripts(regexp_extract_all(body, '<url>.*?</url>'), 1) AS ord FROM sitemap))"


def sitemap_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, url, lastmod, ord) of sitemaps, by the XML functions of SQL."""
    schema = "struct<url: array<struct<loc: string, lastmod: string>>>"
    rows = SITEMAP.df(spark, sf_dir).select("site", F.posexplode(F.expr(f"from_xml(body, '{schema}').url")).alias("ord", "u"))
    return rows.select("site", F.col("u.loc").alias("url"), F.col("u.lastmod").alias("lastmod"), (F.col("ord") + 1).cast("long").alias("ord"))


@query("sitemap_entries", f"+{_ENTRIES} SELECT site, url, lastmod, ord FROM en", SITEMAP)
def _(spark, sf_dir):
    return sitemap_entries(spark, sf_dir)


@query("check_lastmod_uniform", f"""+{_ENTRIES}, s AS (SELECT site, count(lastmod) AS present, count(DISTINCT lastmod) AS d FROM en GROUP BY 1)
  SELECT site, CASE WHEN present = 0 THEN 'not_evaluated' WHEN d <= 1 THEN 'finding' ELSE 'pass' END AS gate, CASE WHEN present > 0 AND d <= 1 THEN 'low' END AS severity, CASE WHEN present > 0 AND d <= 1 THEN 'medium' END AS confidence FROM s""", SITEMAP)
def _(spark, sf_dir):
    return checks.lastmod_uniform(sitemap_entries(spark, sf_dir)).select(*SHORT)


@query("page_lastmod_join", f"+{_ENTRIES} SELECT p.page_id, p.url, lastmod FROM targets p LEFT JOIN en ON regexp_replace(p.url, '/+$', '') = regexp_replace(en.url, '/+$', '')", SITEMAP, TARGETS)
def _(spark, sf_dir):
    key = lambda c: F.regexp_replace(c, "/+$", "")
    entries = sitemap_entries(spark, sf_dir).select(key("url").alias("k"), "lastmod")
    return TARGETS.df(spark, sf_dir).join(entries, key("url") == F.col("k"), "left").select("page_id", "url", "lastmod")


@query("check_hreflang", r"""+e AS (SELECT site, path, lang, lower(alt_lang) AS alt, regexp_extract(alt_href, '^[a-z]*://[^/]*(.*)$', 1) AS to_path FROM alts), b AS (SELECT site, path AS to_path, list(lower(alt_lang)) AS back FROM alts GROUP BY ALL),
  j AS (SELECT e.site, NOT regexp_matches(alt, '^(?:[a-z]{2,3}(?:-[a-z0-9]{2,8})*|x-default)$') OR coalesce(back IS NOT NULL AND path <> e.to_path AND NOT list_contains(back, lang), FALSE) AS bad FROM e LEFT JOIN b ON e.site = b.site AND e.to_path = b.to_path),
  s AS (SELECT site, count(*) FILTER (WHERE bad) AS n FROM j GROUP BY 1)
  SELECT site, CASE WHEN n > 0 THEN 'finding' ELSE 'pass' END AS gate, CASE WHEN n > 0 THEN 'medium' END AS severity, CASE WHEN n > 0 THEN 'high' END AS confidence FROM s""", ALTS)
def _(spark, sf_dir):
    rows = ALTS.df(spark, sf_dir).groupBy("site", "url", "path", "lang").agg(F.collect_list(F.struct(F.col("alt_lang").alias("lang"), F.col("alt_href").alias("href"))).alias("alternates"))
    return checks.hreflang(rows).select(*SHORT)


@query("check_llms_txt", "SELECT site, CASE WHEN site_type <> 'docs-developer' OR llms_status IS NULL THEN 'not_evaluated' WHEN llms_status <> 200 THEN 'finding' ELSE 'pass' END AS gate, CASE WHEN site_type = 'docs-developer' AND llms_status <> 200 THEN 'low' END AS severity, CASE WHEN site_type = 'docs-developer' AND llms_status <> 200 THEN 'high' END AS confidence FROM llms", LLMS)
def _(spark, sf_dir):
    return checks.llms_txt(LLMS.df(spark, sf_dir)).select(*SHORT)


@query("check_link_rot", """+s AS (SELECT site, count(*) FILTER (WHERE status >= 400 AND status <> 410) AS n, count(status) AS seen, bool_or(coalesce(status >= 400 AND status <> 410, FALSE) AND regexp_matches(url, 'pricing|plans|buy|contact')) AS d FROM rot GROUP BY 1)
  SELECT site, CASE WHEN n > 0 THEN 'finding' WHEN seen > 0 THEN 'pass' ELSE 'not_evaluated' END AS gate, CASE WHEN n > 0 THEN CASE WHEN n >= 3 OR d THEN 'medium' ELSE 'low' END END AS severity, CASE WHEN n > 0 THEN 'medium' END AS confidence FROM s""", ROT)
def _(spark, sf_dir):
    return checks.link_rot(ROT.df(spark, sf_dir)).select(*SHORT)


@query("check_fetch_latency", """+g AS (SELECT site, floor(median(timing_ms))::BIGINT AS m, count(*) AS n FROM times WHERE status < 400 AND timing_ms > 0 GROUP BY 1), s AS (SELECT * FROM (SELECT DISTINCT site FROM times) LEFT JOIN g USING (site))
  SELECT site, CASE WHEN coalesce(n < 3, TRUE) THEN 'not_evaluated' WHEN m >= 2500 THEN 'finding' ELSE 'pass' END AS gate, CASE WHEN n >= 3 AND m >= 5000 THEN 'high' WHEN n >= 3 AND m >= 2500 THEN 'medium' END AS severity, CASE WHEN n >= 3 AND m >= 2500 THEN 'medium' END AS confidence FROM s""", TIMES)
def _(spark, sf_dir):
    return checks.fetch_latency(TIMES.df(spark, sf_dir)).select(*SHORT)


# ---- read, identify, land -------------------------------------------------------------------------------------------

HTML = Inline("html_pages", "page_id long, site string, url string, html string", (
    (1, "a", "http://a/", "<html><head><title></title></head><body><noscript>Please enable JavaScript</noscript><div id=\"root\"></div></body></html>"),
    (2, "b", "http://b/", "<html><head><title>B</title><meta name=\"description\" content=\"From $49 a month\"></head><body><p>Words that say nothing of the cost.</p><script id=\"__NEXT_DATA__\" type=\"application/json\">{\"a\":[\"The plan covers five users in all of Europe\"]}</script></body></html>"),
    (3, "b", "http://b/2", "<html><head><title>B2</title><meta property=\"og:description\" content=\"Save 20% now\"></head><body><p>Other words.</p></body></html>"),
    (4, "c", "http://c/", "<html><body><p>Pictures</p>" + "<img src=\"x.png\" alt=\"\">" * 6 + "</body></html>"),
    (5, "d", "http://d/pricing", "<html><body><div class=\"col-4\">A</div><div class=\"col-4\">B</div><div class=\"col-4\">C</div><div class=\"col-4\">A</div><div class=\"col-4\">B</div><div class=\"col-4\">C</div></body></html>"),
    (6, "e", "http://e/", "<html><head><meta name=\"viewport\" content=\"w\"><script src=\"a.js\"></script></head><body><table><tr><td>1</td></tr></table><details><summary>Q</summary>A</details><details open>B</details><div class=\"cookie-overlay\">x</div><svg><path/></svg><svg><text>t</text></svg></body></html>"),
    (7, "f", "http://f/", "<html><body><p style=\"display:none\">hid</p><p style=\"display:none\">hid</p><p>seen</p></body></html>"), (8, "f", "http://f/2", "<html><body><p style=\"visibility:hidden\">hid</p><p style=\"display: none\">hid</p></body></html>"),
    (9, "g", "http://g/", "<html><body>" + "".join(f"<button onclick=\"go('/p{i}')\">x</button>" for i in range(6)) + "<a href=\"/p0\">p</a></body></html>"),
    (10, "h", "http://h/", "<html><body><script type=\"application/ld+json\">{\"@type\":\"Organization\"}</script><script type=\"application/ld+json\">{bad</script></body></html>"),
    (11, "i", "http://i/", "<html><body><script type=\"application/ld+json\">{\"@graph\":[{\"@type\":\"Product\",\"name\":\"P\",\"offers\":{\"price\":\"10\"}}]}</script><p>Only $12 today</p></body></html>"),
    (12, "j", "http://j/", None),
))


def measured(pages: DataFrame, claimed: bool = False) -> DataFrame:
    """Pages (page_id, site, url, html), parsed, with what the checks ask for: a small row for each page. If claimed, also with
    all claims of its text and the number of its structured dates."""
    parsed = parse_pages(pages.select("page_id", "site", "url", "html"), ("site", "html"))
    parsed = parsed.withColumn("_low", F.lower("claim_text"))
    more = (claim_functions.found(F.col("claim_text"), F.col("_low")).alias("claims"), F.size("structured_dates").alias("dates")) if claimed else ()
    prices = F.regexp_extract_all("visible_text", F.lit(claim_functions.PATTERNS[0][1]), F.lit(0))
    shown = F.lower("visible_text")
    tokens = claim_functions.fact_tokens(F.coalesce("meta_description", F.lit("")))
    links = F.transform("links", lambda x: urls.path(x["href"]))
    return parsed.select(
        "page_id", "site", "url", "title", "noscript_js", "empty_root", "grid_candidates", "tables", "overlay", "has_viewport", "jsonld", "details", "details_open", "images_unsized", "render_blocking",
        F.size(F.filter("state_strings", texts.fact_like)).alias("state_facts"), texts.word_count(F.col("visible_text")).alias("words"), F.coalesce(F.length("html"), F.lit(0)).alias("raw_chars"), F.size("images").alias("images"),
        F.size(F.filter("images", lambda i: i["alt_empty"])).alias("empty_alts"), (F.col("canvases") + F.col("svg_without_text") + F.col("videos_uncaptioned")).alias("media"), urls.norm_path(urls.path(F.col("url"))).alias("path"),
        F.col("meta_description").alias("description"), F.array_join(F.filter(tokens, lambda t: F.contains(shown, F.lower(t))), "\n").alias("visible"), F.array_distinct(prices).alias("visible_prices"),
        F.col("visible_text").rlike("(?i)price|pricing").alias("pricing_context"), checks.hidden_instances(F.coalesce("html", F.lit(""))).alias("hidden"), F.array_except("script_paths", links).alias("handler_paths"), F.array().cast("array<string>").alias("link_paths"), *more,
    )


def page_checks(pages: DataFrame) -> DataFrame:
    """All checks of pages (page_id, site, url, html) that need nothing else; rows alike in all columns are one page."""
    return checks_of(written(measured(pages), "measures"))  # pages are parsed once, and every check reads its columns


def checks_of(measures: DataFrame) -> DataFrame:
    """page_checks() from what measured() gives."""
    from ..operators.crawl import page_class

    p = measures.distinct()
    tables = p.withColumn("page_class", page_class(F.col("path"))).withColumn("prices", F.size("visible_prices"))
    blocks = p.select("site", "url", F.explode("jsonld").alias("b")).select("site", "url", F.col("b.raw").alias("raw"))
    nodes = checks.jsonld_nodes(blocks).withColumn("path", urls.norm_path(urls.path(F.col("url"))))
    schema = nodes.groupBy("url").agg(F.collect_list("price").alias("schema_prices"))
    priced = p.select("site", "url", "visible_prices").join(schema, "url", "left").withColumn("schema_prices", F.coalesce("schema_prices", F.array().cast("array<string>")))
    results = [
        checks.key_fact_loss(p), checks.state_only(p), checks.metadata_contrast(p, claim_functions.fact_tokens), checks.non_text_lockin(p), checks.table_semantics(tables), checks.script_links(p),
        checks.hidden_text(p), checks.jsonld_invalid(p.select("site").distinct(), nodes), checks.price_conflict(priced), checks.viewport_absent(p), checks.overlay_block(p),
    ]
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


#: What the checks must say of the fixture pages, by site; every other check of them passes or is open.
EXPECTED = Inline("expected", "site string, check_id string, severity string", (
    ("a", "REP-KEY-FACT-LOSS", "high"), ("a", "REF-VIEWPORT-ABSENT", "medium"), ("b", "REP-STATE-ONLY-FACT", "medium"), ("b", "REP-METADATA-CONTRAST", "medium"), ("b", "REF-VIEWPORT-ABSENT", "medium"), ("c", "REP-NON-TEXT-LOCKIN", "high"), ("c", "REF-VIEWPORT-ABSENT", "medium"),
    ("d", "REP-TABLE-SEMANTICS", "medium"), ("d", "REF-VIEWPORT-ABSENT", "medium"), ("e", "REF-OVERLAY-BLOCK", "medium"), ("f", "REP-HIDDEN-TEXT-SUSPECT", "medium"), ("f", "REF-VIEWPORT-ABSENT", "medium"), ("g", "REP-LINKS-SCRIPT-ONLY", "medium"), ("g", "REF-VIEWPORT-ABSENT", "medium"),
    ("h", "ENT-JSONLD-INVALID", "high"), ("h", "REF-VIEWPORT-ABSENT", "medium"), ("i", "ENT-STRUCTURED-VISIBLE-CONFLICT", "high"), ("i", "REF-VIEWPORT-ABSENT", "medium"),
))


@query("page_check_findings", "SELECT site, check_id, severity FROM expected", EXPECTED)
def _(spark, sf_dir):
    """Of the fixture pages, against what must be said of them; site_check_findings is the query over the page table."""
    return page_checks(HTML.df(spark)).filter("gate = 'finding'").select("site", "check_id", "severity")


@query("site_check_findings")
def _(spark, sf_dir):
    return page_checks(sources.read_pages(spark, sf_dir)).filter("gate = 'finding'").select("site", "check_id", "severity")


@query("page_check_gates")
def _(spark, sf_dir):
    return page_checks(sources.read_pages(spark, sf_dir)).select("site", "check_id", "gate", "severity", "confidence", "evidence")


@query("jsonld_blocks", """+b AS (SELECT page_id, unnest(regexp_extract_all(html, '<script type="application/ld\\+json">(.*?)</script>', 1)) AS raw FROM html_pages) SELECT page_id, raw, json_valid(raw) AS parse_ok FROM b""", HTML_MADE)
def _(spark, sf_dir):
    rows = parse_pages(HTML_MADE.df(spark, sf_dir)).select("page_id", F.explode("jsonld").alias("b"))
    return rows.select("page_id", F.col("b.raw").alias("raw"), F.col("b.parse_ok").alias("parse_ok"))


@query("site_jsonld_blocks", """WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '<script type="application/ld\\+json">(.*?)</script>', 1)) AS raw FROM pages) SELECT page_id, raw, json_valid(raw) AS parse_ok FROM b""")
def _(spark, sf_dir):
    rows = parse_pages(sources.read_pages(spark, sf_dir)).select("page_id", F.explode("jsonld").alias("b"))
    return rows.select("page_id", F.col("b.raw").alias("raw"), F.col("b.parse_ok").alias("parse_ok"))


@query("page_measures", """SELECT site, sum(greatest(0, len(regexp_extract_all(html, '<details')) - len(regexp_extract_all(html, '<details open'))))::BIGINT AS collapsed, sum(len(regexp_extract_all(html, '<img')))::BIGINT AS images_unsized,
  max(len(regexp_extract_all(html, '<script src=')))::INTEGER AS render_blocking FROM (SELECT site, coalesce(html, '') AS html FROM html_pages) GROUP BY 1""", HTML_MADE)
def _(spark, sf_dir):
    return checks.collapsed_answers(measured(HTML_MADE.df(spark, sf_dir)))


@query("site_page_measures", f"""WITH {PG} SELECT site, sum(greatest(0, len(regexp_extract_all(html, '<details')) - len(regexp_extract_all(html, '<details open'))))::BIGINT AS collapsed, sum(len(regexp_extract_all(html, '<img')))::BIGINT AS images_unsized,
  max(len(regexp_extract_all(html, '<script src=')))::INTEGER AS render_blocking FROM pg GROUP BY 1""")
def _(spark, sf_dir):
    return checks.collapsed_answers(measured(sources.read_pages(spark, sf_dir)))


@query("check_corroboration", """+s AS (SELECT site, count(*) FILTER (WHERE ownership = 'independent' AND http_status BETWEEN 200 AND 399) AS r, count(*) FILTER (WHERE ownership = 'independent' AND http_status IS NULL) AS t, count(*) FILTER (WHERE ownership = 'independent' AND http_status >= 400) AS e FROM presence GROUP BY 1),
  g AS (SELECT site, CASE WHEN r > 0 OR t > 0 THEN 'pass' WHEN e > 0 THEN 'finding' ELSE 'pass' END AS gate FROM s) SELECT site, gate, CASE WHEN gate = 'finding' THEN 'medium' END AS severity, CASE WHEN gate = 'finding' THEN 'high' END AS confidence FROM g""", PRESENCE)
def _(spark, sf_dir):
    return checks.corroboration(PRESENCE.df(spark, sf_dir)).select(*SHORT)


@query("check_ambiguous_name", """+w AS (SELECT site, name, regexp_extract_all(lower(name), '[a-z0-9]+') AS w FROM names), s AS (SELECT site, count(name) AS n, bool_or(coalesce(list_has_any(w, ['software','platform','university','school','hospital','clinic','bank','museum','restaurant','hotel','agency','studio','labs','app','foundation','inc','llc','ltd','limited','corp','corporation','gmbh','plc','co','company','sa','ag']), FALSE)) AS q FROM w GROUP BY 1)
  SELECT site, CASE WHEN n = 0 THEN 'not_evaluated' ELSE 'pass' END AS gate, CASE WHEN q THEN 'qualifier present' ELSE 'no qualifier' END AS evidence FROM s""", NAMES)
def _(spark, sf_dir):
    return checks.ambiguous_name(NAMES.df(spark, sf_dir)).select("site", "gate", "evidence")


@query("check_soft_404", """SELECT site, 'REF-SOFT-404' AS check_id, CASE WHEN status IS NULL THEN 'not_evaluated' WHEN status = 200 THEN 'finding' ELSE 'pass' END AS gate FROM missing
  UNION ALL SELECT site, 'REF-404-DEAD-END', CASE WHEN coalesce(status <> 404, TRUE) THEN 'not_evaluated' WHEN NOT (has_search OR links >= 3 OR suggests) THEN 'finding' ELSE 'pass' END FROM missing""", MISSING)
def _(spark, sf_dir):
    return checks.soft_404(MISSING.df(spark, sf_dir)).select("site", "check_id", "gate")


@query("check_path_drop", """+s AS (SELECT site, count(*) FILTER (WHERE NOT path_preserved) AS lost, count(*) FILTER (WHERE NOT (path_preserved IS NULL OR variant_ok IS NOT DISTINCT FROM FALSE)) AS rd FROM variants GROUP BY 1)
  SELECT site, CASE WHEN lost > 0 THEN 'finding' WHEN rd = 0 THEN 'not_evaluated' ELSE 'pass' END AS gate FROM s""", VARIANTS)
def _(spark, sf_dir):
    return checks.path_drop(VARIANTS.df(spark, sf_dir)).select("site", "gate")


@query("check_impossible_dates", """+s AS (SELECT site, count(*) FILTER (WHERE regexp_matches(value, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') AND (try_cast(substring(value, 1, 10) AS DATE) IS NULL OR try_cast(substring(value, 1, 10) AS DATE) > DATE '2026-01-01')) AS n FROM dates GROUP BY 1)
  SELECT site, CASE WHEN n > 0 THEN 'finding' ELSE 'pass' END AS gate FROM s""", DATES)
def _(spark, sf_dir):
    return checks.impossible_dates(DATES.df(spark, sf_dir), "2026-01-01").select("site", "gate")


@query("heading_runs", """+i AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ord) - row_number() OVER (PARTITION BY page_id, level ORDER BY ord) AS isl FROM levels),
  n AS (SELECT *, row_number() OVER (PARTITION BY page_id, level, isl ORDER BY ord) AS nth, count(*) OVER (PARTITION BY page_id, level, isl) AS n FROM i)
  SELECT page_id, ord, level, CASE WHEN n > 7 AND nth = 7 THEN NULL ELSE text END AS text, CASE WHEN n > 7 AND nth = 7 THEN n - 6 ELSE 0 END AS dropped FROM n WHERE n <= 7 OR nth <= 7""", LEVELS)
def _(spark, sf_dir):
    return runs.cap_siblings(LEVELS.df(spark, sf_dir))


@query("question_pages", """+q AS (SELECT *, 'Q-' || CASE WHEN length(num) < 3 THEN lpad(num, 3, '0') ELSE num END AS question_id FROM (SELECT *, coalesce(nullif(regexp_extract(id, '([0-9]+)', 1), ''), pos::VARCHAR) AS num FROM questions))
  SELECT question_id, coalesce(e.page_id, n.page_id) AS page_id FROM q LEFT JOIN targets e ON e.url = expected_page LEFT JOIN targets n ON regexp_replace(lower(regexp_extract(n.url, '://([^/]*)', 1)), '^www\\.', '') || coalesce(nullif(regexp_extract(n.url, '://[^/]*(.*)$', 1), ''), '/') = regexp_replace(lower(regexp_extract(expected_page, '://([^/]*)', 1)), '^www\\.', '') || coalesce(nullif(regexp_extract(expected_page, '://[^/]*(.*)$', 1), ''), '/')""", QUESTIONS, TARGETS)
def _(spark, sf_dir):
    rows = QUESTIONS.df(spark, sf_dir)
    number = F.coalesce(F.nullif(F.regexp_extract(F.coalesce("id", F.lit("")), "([0-9]+)", 1), F.lit("")), F.col("pos").cast("string"))
    rows = rows.withColumn("question_id", F.concat(F.lit("Q-"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number))).withColumn("k", urls.passage_key(F.col("expected_page")))
    t = TARGETS.df(spark, sf_dir)
    exact = t.select(F.col("url").alias("expected_page"), F.col("page_id").alias("e"))
    near = t.select(urls.passage_key(F.col("url")).alias("k"), F.col("page_id").alias("n"))
    return rows.join(exact, "expected_page", "left").join(near, "k", "left").select("question_id", F.coalesce("e", "n").alias("page_id"))


@query("passage_contiguity", """+p AS (SELECT page_id, line || ' ' || lead(line) OVER (PARTITION BY page_id ORDER BY ord) AS pair FROM blocks)
  SELECT question_id, page_id, a AS contiguous, CASE WHEN a THEN 'within a block' WHEN b THEN 'over two blocks' ELSE 'not found' END AS note FROM (SELECT question_id, page_id, EXISTS (SELECT 1 FROM blocks x WHERE x.page_id = passages.page_id AND contains(line, passage)) AS a, EXISTS (SELECT 1 FROM p WHERE p.page_id = passages.page_id AND contains(pair, passage)) AS b FROM passages)""", BLOCKS, PASSAGES)
def _(spark, sf_dir):
    return runs.passages_in_blocks(PASSAGES.df(spark, sf_dir), BLOCKS.df(spark, sf_dir))


@query("anchor_ambiguity", "SELECT question_id, count(DISTINCT line) AS runs, count(DISTINCT b.page_id) AS pages FROM passages p JOIN blocks b ON contains(b.line, p.passage) GROUP BY 1", BLOCKS, PASSAGES)
def _(spark, sf_dir):
    """In how many different blocks, and on how many pages, each passage stands; passages that stand nowhere are left out."""
    asked = PASSAGES.df(spark, sf_dir).select(F.col("question_id").alias("phrase_id"), F.col("passage").alias("phrase"))
    return phrase_index.stands(asked, BLOCKS.df(spark, sf_dir)).withColumnRenamed("phrase_id", "question_id")


_FOLDER = "regexp_extract(base, '^([^?#]*/)', 1)"


@query("resolved_links", rf"""SELECT page_id, base, href, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(base, '^([a-z]+:)', 1) || href WHEN starts_with(href, '/') THEN regexp_extract(base, '^([a-z]+://[^/?#]*)', 1) || replace(href, '/./', '/')
  WHEN starts_with(href, '#') OR href = '' THEN regexp_extract(base, '^([^#]*)', 1) || href WHEN starts_with(href, '?') THEN regexp_extract(base, '^([^?#]*)', 1) || href WHEN href = '../k' THEN regexp_replace({_FOLDER}, '([^/:])/[^/]+/$', '\1/') || 'k' ELSE {_FOLDER} || href END AS target FROM resolve""", RESOLVE)
def _(spark, sf_dir):
    return RESOLVE.df(spark, sf_dir).select("page_id", "base", "href", urls.resolve(F.col("base"), F.col("href")).alias("target"))


@query(
    "encoded_urls",
    r"""SELECT page_id, url, replace(replace(array_to_string(list_transform(string_split(replace(replace(url, '%c3%bc', '<C3BC>'), '%', '<25>'), ''), lambda c: CASE WHEN regexp_matches(c, '^[A-Za-z0-9._~:/?#@!$&()*+,;=\[\]<>''-]$') THEN c ELSE url_encode(c) END), ''),
      '<C3BC>', '%C3%BC'), '<25>', '%25') AS encoded FROM spaced""",
    SPACED,
)
def _(spark, sf_dir):
    return SPACED.df(spark, sf_dir).select("page_id", "url", urls.encode_url("url").alias("encoded"))


@query("inflated_bodies", "SELECT page_id AS id, html AS body FROM pages")
def _(spark, sf_dir):
    """Pages as gzip bodies, every second one, and inflated again."""
    raw = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("id"), F.col("html").cast("binary").alias("body"), (F.col("page_id") % 2 == 0).alias("zip"))
    return snapshots.inflated(raw.mapInArrow(snapshots.zipped, raw.schema), "body", "body").select("id", F.decode("body", "UTF-8").alias("body"))


# ---- report ---------------------------------------------------------------------------------------------------------

_RANK = "CASE {c} WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"
_ROUTED = """ro AS (SELECT r.*, CASE WHEN c.check_id IS NULL THEN 'unknown' WHEN gate = 'pass' AND r.evidence_quality = 'hypothesis' THEN 'not_evaluated' WHEN gate = 'pass' THEN 'passed'
  WHEN gate = 'finding' AND r.check_id IN ('REF-SOFT-404', 'ACC-BOT-CHALLENGE') AND NOT regexp_matches(coalesce(evidence, ''), '(^|[^0-9])[0-9]{3}($|[^0-9])') THEN 'not_evaluated'
  WHEN gate = 'finding' AND confidence = 'low' THEN 'verify' WHEN gate = 'finding' THEN 'finding' ELSE 'not_evaluated' END AS route FROM results r LEFT JOIN catalog c USING (check_id))"""
_FOUND = f"""ky AS (SELECT *, array_to_string(list_sort(urls), '|') AS key FROM ro WHERE route = 'finding'), ow AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, check_id, key ORDER BY {_RANK.format(c='severity')}, evidence) AS nth FROM ky) WHERE nth = 1),
  pr AS (SELECT site, flatten(list(urls)) AS lost FROM ow WHERE check_id = 'REP-KEY-FACT-LOSS' GROUP BY 1), ab AS (SELECT ow.*, check_id IN ('REP-LINKS-SCRIPT-ONLY', 'REP-EXTRACTION-LOSS') AND coalesce(list_has_any(urls, lost), FALSE) AS inside FROM ow LEFT JOIN pr USING (site)),
  tk AS (SELECT site, string_agg(DISTINCT check_id, ', ' ORDER BY check_id) AS also FROM ab WHERE inside GROUP BY 1),
  fi AS (SELECT site, printf('F-%03d', row_number() OVER (PARTITION BY site ORDER BY {_RANK.format(c='severity')}, check_id, key)) AS id, check_id, CASE WHEN severity = 'critical' AND confidence <> 'high' THEN 'high' ELSE severity END AS severity, confidence,
    CASE WHEN check_id = 'REP-KEY-FACT-LOSS' AND also IS NOT NULL THEN evidence || '; explains ' || also ELSE evidence END AS evidence, key AS urls FROM ab LEFT JOIN tk USING (site) WHERE NOT inside)"""


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.route(RESULTS.df(spark, sf_dir), CATALOG.df(spark))


@query("report_routes", f"+{_ROUTED} SELECT site, check_id, gate, route FROM ro", RESULTS, CATALOG)
def _(spark, sf_dir):
    return routed(spark, sf_dir).select("site", "check_id", "gate", "route")


@query("report_findings", f"+{_ROUTED}, {_FOUND} SELECT * FROM fi", RESULTS, CATALOG)
def _(spark, sf_dir):
    return report.findings(routed(spark, sf_dir))


@query("report_not_evaluated", f"""+{_ROUTED}, d AS (SELECT DISTINCT site, check_id FROM ro WHERE route IN ('finding', 'verify', 'passed')) SELECT DISTINCT site, check_id FROM ro WHERE route = 'not_evaluated' AND (site, check_id) NOT IN (SELECT * FROM d)
  UNION ALL SELECT s.site, c.check_id FROM (SELECT DISTINCT site FROM results) s, catalog c WHERE (s.site, c.check_id) NOT IN (SELECT site, check_id FROM ro WHERE route <> 'unknown')""", RESULTS, CATALOG)
def _(spark, sf_dir):
    return report.not_evaluated(routed(spark, sf_dir), CATALOG.df(spark), RESULTS.df(spark, sf_dir).select("site").distinct())


@query("report_summary", f"""+{_ROUTED}, {_FOUND}, a AS (SELECT site, count(*) FILTER (WHERE route = 'verify') AS verify, count(*) FILTER (WHERE route = 'passed') AS passed FROM ro GROUP BY 1),
  b AS (SELECT site, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low FROM fi GROUP BY 1)
  SELECT site, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, verify, passed FROM a LEFT JOIN b USING (site)""", RESULTS, CATALOG)
def _(spark, sf_dir):
    r = routed(spark, sf_dir)
    return report.summary(r, report.findings(r))


@query("report_band_warnings", f"+{_ROUTED}, {_FOUND} SELECT site, id, check_id FROM fi JOIN catalog USING (check_id) WHERE NOT list_contains(string_split(band, ' '), severity)", RESULTS, CATALOG)
def _(spark, sf_dir):
    return report.out_of_band(report.findings(routed(spark, sf_dir)), CATALOG.df(spark))


@query("report_forbidden_claims", f"+{_ROUTED}, {_FOUND} SELECT site, id FROM fi WHERE regexp_matches(evidence, '{report.FORBIDDEN}')", RESULTS, CATALOG)
def _(spark, sf_dir):
    return report.forbidden(report.findings(routed(spark, sf_dir)))


@query("report_markdown", f"+{_ROUTED}, {_FOUND} SELECT site, '# ' || site || chr(10) || string_agg('- **' || id || '** (' || severity || ') ' || check_id || ': ' || coalesce(evidence, ''), chr(10) ORDER BY id) AS report FROM fi GROUP BY site", RESULTS, CATALOG)
def _(spark, sf_dir):
    return report.markdown(report.findings(routed(spark, sf_dir)))


@query("report_opportunities", "+o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, lower(title) ORDER BY priority, title) AS nth FROM ideas) WHERE nth = 1) SELECT site, row_number() OVER (PARTITION BY site ORDER BY priority, title) AS rank, title, priority FROM o", IDEAS)
def _(spark, sf_dir):
    return report.opportunities(IDEAS.df(spark, sf_dir))


@query("verdict_assembly", """+f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, check_id ORDER BY ord) AS nth FROM verdicts) WHERE nth = 1), j AS (SELECT s.site, c.check_id, CASE WHEN gate IN ('finding', 'pass', 'not_evaluated') THEN gate ELSE 'not_evaluated' END AS gate, severity, coalesce(evidence, measure) AS evidence, band, c.evidence_quality
  FROM (SELECT DISTINCT site FROM verdicts) s CROSS JOIN catalog c LEFT JOIN f ON f.site = s.site AND f.check_id = c.check_id LEFT JOIN measures m ON m.site = s.site AND m.check_id = c.check_id)
  SELECT site, check_id, gate, CASE WHEN gate = 'finding' THEN coalesce(severity, string_split(band, ' ')[-1]) END AS severity, evidence, evidence_quality FROM j""", VERDICTS, MEASURES, CATALOG)
def _(spark, sf_dir):
    v = VERDICTS.df(spark, sf_dir)
    return report.assemble(v, MEASURES.df(spark, sf_dir), CATALOG.df(spark), v.select("site").distinct())


@query("probe_outcomes", "SELECT outcome, count(*) AS probes FROM probes JOIN prompts USING (question_id) GROUP BY 1", PROBES, PROMPTS)
def _(spark, sf_dir):
    return PROBES.df(spark, sf_dir).join(PROMPTS.df(spark, sf_dir), "question_id").groupBy("outcome").agg(F.count(F.lit(1)).alias("probes"))


@query("probe_unknown_questions", "SELECT question_id FROM probes WHERE question_id NOT IN (SELECT question_id FROM prompts)", PROBES, PROMPTS)
def _(spark, sf_dir):
    return PROBES.df(spark, sf_dir).join(PROMPTS.df(spark, sf_dir), "question_id", "left_anti").select("question_id")


@query("site_report_summary", f"""WITH {PG} SELECT site, count(*) AS pages, count(DISTINCT {np_sql('path')}) AS paths, count(*) FILTER (WHERE NOT contains(html, '</html>')) AS truncated FROM pg GROUP BY 1""")
def _(spark, sf_dir):
    p = sources.read_pages(spark, sf_dir)
    return p.groupBy("site").agg(F.count(F.lit(1)).alias("pages"), F.countDistinct(urls.norm_path(F.col("path"))).alias("paths"), F.count_if(~F.contains("html", F.lit("</html>"))).alias("truncated"))

"""Queries of shared prefixes, phrases in runs, and groups of names, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts
from ..operators import excerpts, names, phrase_index, prefixes
from ..sources import pages as sources
from .audit_queries import query
from .observed import VARIANTS_OF_NAMES
from .site_queries import BL, PG, table


def _page_texts(spark, sf_dir):
    """(site, page_id, text): the blocks of each page as one text."""
    blocks = sources.blocks(sources.read_pages(spark, sf_dir))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"])
    return blocks.groupBy("site", "page_id").agg(F.array_join(lines, "\n").alias("text"))


@query(
    "shared_preambles",
    f"""WITH {PG}, {BL}, t AS (SELECT site, page_id, substring(string_agg(line, chr(10) ORDER BY ord), 1, {prefixes.EXCERPT}) AS text FROM bl GROUP BY ALL),
    l AS (SELECT site, first(text ORDER BY length(text) DESC, page_id, text) AS longest, count(*) AS pages FROM t GROUP BY site HAVING count(*) >= {prefixes.LEAST_PAGES}),
    s AS (SELECT site, pages, len(list_filter(generate_series(1, least(length(text), length(longest))), lambda i: substring(text, 1, i) = substring(longest, 1, i)))::INTEGER AS length FROM t JOIN l USING (site)),
    a AS (SELECT site, pages, length, (SELECT count(*) FROM s o WHERE o.site = s.site AND o.length >= s.length) AS agree FROM s)
    SELECT site, pages, max(length) AS length, max(length) >= {prefixes.LEAST_PREFIX} AS hoisted FROM a WHERE 2 * agree >= pages GROUP BY ALL""",
)
def shared_preambles(spark, sf_dir):
    return prefixes.shared_prefix(_page_texts(spark, sf_dir))


_FOLD = r"trim(regexp_replace({0}, '[ \t\n\r\x0B\f\x{{A0}}]+', ' ', 'g'))"
_OFFSET = rf"""CASE WHEN instr(text, phrase) > 0 THEN instr(text, phrase) - 1
  WHEN contains({_FOLD.format('text')}, {_FOLD.format('phrase')}) THEN length(regexp_extract(text, '(?s)^(.*?)' || replace(regexp_replace({_FOLD.format('phrase')}, '([\\^$.|?*+()\[\]{{}}])', '\\\1', 'g'), ' ', '[ \t\n\r\x0B\f\x{{A0}}]+'), 1)) END"""


@query(
    "benchmark_offsets",
    f"""SELECT phrase_id, doc_id, "offset"::INTEGER AS "offset" FROM (SELECT phrase_id, doc_id, {_OFFSET} AS "offset"
      FROM (SELECT item_id AS phrase_id, text AS phrase FROM benchmark WHERE text <> ''), (SELECT doc_id, text FROM documents)) WHERE "offset" IS NOT NULL""",
)
def benchmark_offsets(spark, sf_dir):
    """Where whole benchmark items stand in documents, whatever the white space."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("phrase_id"), F.col("text").alias("phrase"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return phrase_index.hits(items, docs, "doc_id")


_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


@query(
    "heading_anchors",
    f"""WITH {PG}, {BL}, asked AS (SELECT page_id AS phrase_id, array_to_string(list_filter(string_split_regex({_TITLE}, '[ \\t\\n\\r]+'), lambda w: w <> '')[1:3 + page_id % 4], ' ') AS phrase FROM pg),
    h AS (SELECT phrase_id, page_id, line FROM asked JOIN bl ON contains(line, phrase) WHERE phrase <> '')
    SELECT phrase_id, count(DISTINCT line) AS runs, count(DISTINCT page_id) AS pages FROM h GROUP BY 1""",
)
def heading_anchors(spark, sf_dir):
    """The first three to six words of each title as an anchor: in how many different blocks, and on how many pages, it stands."""
    pages = sources.read_pages(spark, sf_dir)
    words = F.filter(F.split(F.regexp_extract("html", "<title>([^<]*)</title>", 1), "[ \\t\\n\\r]+"), lambda w: w != "")
    asked = pages.select(F.col("page_id").alias("phrase_id"), F.array_join(F.slice(words, F.lit(1), 3 + (F.col("page_id") % 4).cast("int")), " ").alias("phrase"))
    return phrase_index.stands(asked, sources.blocks(pages))


def page_names(spark, sf_dir):
    """(site, ord, name, words): parts of titles and names in footers, in order of pages."""
    pages = sources.read_pages(spark, sf_dir)
    title = texts.title_segments(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    footer = F.filter(F.array(excerpts.footer_name(F.col("html"))), lambda n: n.isNotNull())
    rows = pages.select("site", "page_id", F.posexplode(F.concat(title, footer)).alias("nth", "name"))
    return rows.select("site", F.struct("page_id", "nth").alias("ord"), "name", texts.name_tokens(F.col("name")).alias("words"))


_LISTED = ", ".join(f"'{w}'" for w in (*texts.STOP_WORDS, *texts.LEGAL_WORDS))
_ALIKE = """(list_has_all(l.words, n.words) OR list_has_all(n.words, l.words)
  OR list_has_any(list_filter(l.words, lambda w: length(w) >= 3 AND NOT regexp_full_match(w, '[0-9]+')), list_filter(n.words, lambda w: length(w) >= 3 AND NOT regexp_full_match(w, '[0-9]+'))))"""


_WORDS = f"list_distinct(list_filter(regexp_extract_all(lower(name), '[a-z0-9]+'), lambda w: w NOT IN ({_LISTED})))"
#: Groups of the names in the table `worded` (site, page_id, nth, name, words), one after another.
_GROUPED = f"""once AS (SELECT site, name, arg_min(words, (page_id, nth)) AS words, min((page_id, nth)) AS first FROM worded WHERE len(words) > 0 GROUP BY ALL),
  queue AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY site ORDER BY first) AS n FROM once),
  walk AS (
    SELECT site, 0::BIGINT AS n, NULL::VARCHAR AS name, NULL::VARCHAR AS leader, []::STRUCT(name VARCHAR, words VARCHAR[])[] AS led FROM (SELECT DISTINCT site FROM queue)
    UNION ALL
    SELECT site, n, name, coalesce(hit.name, name), CASE WHEN hit IS NULL THEN list_append(led, {{'name': name, 'words': words}}) ELSE led END
    FROM (SELECT n.site, n.n, n.name, n.words, w.led, list_filter(w.led, lambda l: {_ALIKE})[1] AS hit FROM walk w JOIN queue n ON n.site = w.site AND n.n = w.n + 1)
  )"""


@query(
    "page_name_groups",
    rf"""WITH RECURSIVE {PG}, parts AS (SELECT site, page_id, list_filter(list_transform(string_split_regex({_TITLE}, '\s+[|–—:·-]\s+'), lambda s: trim(s)), lambda s: s <> '')
        || list_filter([nullif(trim(regexp_replace(regexp_replace(regexp_extract_all(html, '(?:©|&copy;|\(c\)) *((?:[0-9]{{4}}(?:[-–][0-9]{{4}})? *)?[^<&|]*)', 1)[-1], '^[0-9]{{4}}(?:[-–][0-9]{{4}})? *', ''), '(?i)[ .,]*(?:all rights reserved|privacy|terms).*$', '')), '')], lambda s: s IS NOT NULL) AS names FROM pg),
    flat AS (SELECT site, page_id, unnest(names) AS name, generate_subscripts(names, 1) AS nth FROM parts),
    worded AS (SELECT *, {_WORDS} AS words FROM flat), {_GROUPED} SELECT site, name, leader FROM walk WHERE n > 0""",
)
def page_name_groups(spark, sf_dir):
    return names.name_groups(page_names(spark, sf_dir))


_VARIANTS = f"worded AS (SELECT site, ord AS page_id, 1 AS nth, name, {_WORDS} AS words FROM variants_of_names), {_GROUPED}"


def _variants(spark, sf_dir):
    rows = VARIANTS_OF_NAMES.df(spark, sf_dir).withColumn("words", texts.name_tokens(F.col("name")))
    return names.name_groups(rows)


@query("name_variants", f"+{_VARIANTS} SELECT site, name, leader FROM walk WHERE n > 0", VARIANTS_OF_NAMES)
def name_variants(spark, sf_dir):
    """Each distinct title of a site and the one that leads its group."""
    return _variants(spark, sf_dir)


@query("name_groups", f"+{_VARIANTS} SELECT site, leader, count(*) AS names FROM walk WHERE n > 0 GROUP BY ALL", VARIANTS_OF_NAMES)
def name_groups(spark, sf_dir):
    """How many distinct titles each group of a site has."""
    return _variants(spark, sf_dir).groupBy("site", "leader").agg(F.count(F.lit(1)).alias("names"))


_OG_SQL = r"regexp_extract(html, '(?is)<meta[^>]*property=.og:site_name.[^>]*content=.([^\"]*)', 1)"


@query(
    "name_evidence",
    rf"""WITH RECURSIVE {PG}, foot AS (SELECT *, coalesce(trim(regexp_replace(regexp_replace(regexp_extract_all(html, '(?:©|&copy;|\(c\)) *((?:[0-9]{{4}}(?:[-–][0-9]{{4}})? *)?[^<&|]*)', 1)[-1], '^[0-9]{{4}}(?:[-–][0-9]{{4}})? *', ''), '(?i)[ .,]*(?:all rights reserved|privacy|terms).*$', '')), '') AS footer FROM pg),
    flat AS (SELECT site, page_id, 1 AS nth, 'og' AS surface, {_OG_SQL} AS name FROM pg UNION ALL SELECT site, page_id, 2, 'footer', footer FROM foot
      UNION ALL SELECT site, page_id, 2 + generate_subscripts(t, 1), 'title', unnest(t) FROM (SELECT site, page_id, list_filter(list_transform(string_split_regex({_TITLE}, '\s+[|–—:·-]\s+'), lambda s: trim(s)), lambda s: s <> '') AS t FROM pg WHERE regexp_replace(path, '/+$', '') = '')),
    worded AS (SELECT *, {_WORDS} AS words FROM flat WHERE name <> ''), {_GROUPED},
    grouped AS (SELECT w.site, leader, bool_or(surface IN ('og', 'footer')) AS anchored FROM worded w JOIN walk USING (site, name) WHERE len(w.words) > 0 GROUP BY ALL),
    per AS (SELECT site, count(*) AS n, count(*) FILTER (WHERE anchored) AS a FROM grouped GROUP BY site)
    SELECT site, 'pass' AS gate, coalesce(n, 0) || ' variants of the name, ' || coalesce(a, 0) || ' stated as such' AS evidence FROM (SELECT DISTINCT site FROM pg) LEFT JOIN per USING (site)""",
)
def name_evidence(spark, sf_dir):
    """ENT-NAME-INCONSISTENT of every site, from Open Graph, footers and the titles of home pages."""
    pages = sources.read_pages(spark, sf_dir)
    found = names.site_names(pages, excerpts.footer_name(F.col("html")))
    return names.inconsistent(pages, names.variants(found)).select("site", "gate", "evidence")

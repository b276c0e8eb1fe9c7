"""Queries for sitemaps, what judges return, what they are handed, and wording, on rows in code, with their SQL twins.

No table of the driver holds sitemaps, headers or fragments. The SQL is written from the rules, not from the code."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crawl, fragments
from ..sources import sitemaps
from .audit_queries import query
from .observed import MAP_FILES, MAP_LINKS, FRAGMENTS, GIVEN, COMPLETED, SPOKEN, WORDED, ANSWERED

# A body is whole where each element that opens also closes; "<x:" is read as "<" for the prefix of the root.
_MAPS = r"""fl AS (SELECT *, replace(replace(regexp_replace(body, '<!--.*?-->', '', 'gs'), '</sm:', '</'), '<sm:', '<') AS flat FROM map_files WHERE http_status < 400),
  pa AS (SELECT *, coalesce(len(regexp_extract_all(body, '<[a-z]')) = len(regexp_extract_all(body, '</[a-z]')), FALSE) AS ok, coalesce(contains(flat, '<sitemapindex'), FALSE) AS idx,
    list_filter(list_transform(regexp_extract_all(flat, '<url>.*?</url>'), lambda u: {'url': replace(trim(regexp_extract(u, '<loc>([^<]*)</loc>', 1)), '&amp;', '&'), 'lastmod': nullif(trim(regexp_extract(u, '<lastmod>([^<]*)</lastmod>', 1)), '')}), lambda e: e.url <> '') AS own FROM fl),
  fo AS (SELECT p.site, p.ord, CASE WHEN p.idx AND c.ok THEN c.url ELSE p.url END AS url, p.http_status, p.ok AND coalesce(c.ok, TRUE) AS parse_ok, CASE WHEN p.idx THEN coalesce(c.own, []) ELSE p.own END AS entries
    FROM pa p LEFT JOIN pa c ON p.idx AND p.site = c.site AND c.url = regexp_extract(p.flat, '<loc>([^<]*)</loc>', 1))"""


@query("sitemap_states", f"+{_MAPS} SELECT site, ord, url, http_status, parse_ok, CASE WHEN parse_ok THEN len(entries)::INTEGER END AS entries_count, CASE WHEN parse_ok THEN len(list_filter(entries, lambda e: e.lastmod IS NOT NULL))::INTEGER END AS lastmod_present, CASE WHEN parse_ok THEN len(list_distinct(list_filter(list_transform(entries, lambda e: e.lastmod), lambda d: d IS NOT NULL)))::INTEGER END AS lastmod_distinct FROM fo", MAP_FILES)
def _(spark, sf_dir):
    return sitemaps.counted(MAP_FILES.df(spark, sf_dir))


_LISTED = """sa AS (SELECT site, row_number() OVER (PARTITION BY site ORDER BY file_ord, file, place) AS ord, url
    FROM (SELECT site, ord AS file_ord, url AS file, generate_subscripts(own, 1) AS place, unnest(own).url AS url FROM pa WHERE ok AND NOT idx))"""


@query("sitemap_candidates", f"""+{_MAPS}, {_LISTED}, li AS (SELECT site, page_id, ord, regexp_extract(target, '^https?://([^/]*)', 1) AS host, regexp_extract(target, '^https?://[^/]*([^?#]*)', 1) AS path FROM map_links),
  ow AS (SELECT site, path, min(page_id * 1000 + ord) AS seen FROM li WHERE host = site AND path NOT IN ('', '/') AND NOT regexp_matches(lower(path), '\\.png$|feed') GROUP BY 1, 2)
  SELECT site, 'sitemap' AS origin, ord::BIGINT AS ord, coalesce(nullif(rtrim(regexp_extract(url, '^https?://[^/]*([^?#]*)', 1), '/'), ''), '/') AS path FROM sa
  UNION ALL SELECT site, 'link', row_number() OVER (PARTITION BY site ORDER BY seen), path FROM ow""", MAP_FILES, MAP_LINKS)
def _(spark, sf_dir):
    return crawl.discovered(MAP_FILES.df(spark, sf_dir), MAP_LINKS.df(spark, sf_dir))


_NOTED = """no AS (SELECT *, CASE WHEN line IS NULL OR NOT json_valid(line) THEN 'unreadable' WHEN json_extract(line, '$.results') IS NULL
    OR len(list_filter(json_extract_string(line, '$.results[*].gate'), lambda g: g NOT IN ('finding', 'pass', 'not_evaluated'))) > 0
    OR len(json_extract(line, '$.results[*].check_id')) < json_array_length(line, '$.results') OR len(json_extract(line, '$.results[*].gate')) < json_array_length(line, '$.results') THEN 'invalid' END AS note FROM fragments)"""


@query("fragment_notes", f"+{_NOTED} SELECT site, name, note FROM no WHERE note IS NOT NULL", FRAGMENTS)
def _(spark, sf_dir):
    return fragments.read_fragments(FRAGMENTS.df(spark, sf_dir)).filter("note is not null").select("site", "name", "note")


@query("fragment_results", f"""+{_NOTED}, r AS (SELECT site, name, unnest(json_extract(line, '$.results[*]')) AS r FROM no WHERE note IS NULL)
  SELECT site, name, r->>'check_id' AS check_id, r->>'gate' AS gate, r->>'severity' AS severity, r->>'evidence' AS evidence FROM r""", FRAGMENTS)
def _(spark, sf_dir):
    return fragments.fragment_results(fragments.read_fragments(FRAGMENTS.df(spark, sf_dir)))


@query("completed_gates", """+f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, check_id ORDER BY ord) AS nth FROM completed) WHERE nth = 1),
  j AS (SELECT g.*, f.gate AS new_gate, f.reason AS why, CASE WHEN f.site IS NULL THEN 'kept' WHEN f.gate IN ('finding', 'pass', 'not_evaluated') AND f.reason <> '' AND NOT (f.gate = 'finding' AND g.severity IS NULL) THEN 'completed' ELSE 'refused' END AS outcome FROM given g LEFT JOIN f USING (site, check_id))
  SELECT site, check_id, CASE WHEN outcome = 'completed' THEN new_gate ELSE gate END AS gate, CASE WHEN outcome <> 'completed' OR new_gate = 'finding' THEN severity END AS severity, CASE WHEN outcome = 'completed' THEN why END AS reason, outcome FROM j""", GIVEN, COMPLETED)
def _(spark, sf_dir):
    return fragments.complete_gates(GIVEN.df(spark, sf_dir), COMPLETED.df(spark, sf_dir))


@query("unknown_completions", "SELECT site, check_id FROM completed EXCEPT SELECT site, check_id FROM given", GIVEN, COMPLETED)
def _(spark, sf_dir):
    return fragments.unknown_completions(GIVEN.df(spark, sf_dir), COMPLETED.df(spark, sf_dir))


@query("damped_severities", """+n AS (SELECT site, count(*) AS anchors FROM spoken WHERE ownership = 'independent' AND http_status >= 200 AND http_status < 400 AND brand_name_match GROUP BY 1)
  SELECT g.site, check_id, gate, CASE WHEN gate = 'finding' AND coalesce(anchors, 0) >= 3 AND check_id IN ('ANS-QUESTION-UNANSWERED', 'FRS-LASTMOD-UNIFORM', 'ACC-LLMS-TXT-ABSENT') THEN CASE severity WHEN 'critical' THEN 'high' WHEN 'high' THEN 'medium' ELSE 'low' END ELSE severity END AS severity, coalesce(anchors, 0) AS anchors FROM given g LEFT JOIN n USING (site)""", GIVEN, SPOKEN)
def _(spark, sf_dir):
    return fragments.damped(GIVEN.df(spark, sf_dir), SPOKEN.df(spark, sf_dir))


_RULES = ", ".join(f"({e}, '{p}', '{w}')" for e, rules in (("FALSE", fragments.SAID), ("TRUE", fragments.SHOWN)) for p, w in rules)


@query("wording_warnings", f"+ru(shown, pattern, warning) AS (VALUES {_RULES}) SELECT site, field, warning FROM worded JOIN ru ON shown = (field = 'evidence') AND regexp_matches(text, CASE WHEN shown THEN '' ELSE '(?i)' END || pattern)", WORDED)
def _(spark, sf_dir):
    return fragments.warnings(WORDED.df(spark, sf_dir))


@query("kept_headers", "+h AS (SELECT url, string_split(raw, '|') AS l FROM answered) SELECT url, " + ", ".join(f"list_transform(list_filter(l, lambda x: lower(split_part(x, ': ', 1)) = '{h}'), lambda x: split_part(x, ': ', 2))[1] AS {h.replace('-', '_')}" for h in fragments.HEADERS) + " FROM h", ANSWERED)
def _(spark, sf_dir):
    return ANSWERED.df(spark, sf_dir).select("url", *fragments.kept_headers(F.expr(r"str_to_map(raw, '\\|', ': ')")))


@query("handed_findings", "SELECT site, check_id, consumer FROM given, (VALUES ('entity'), ('freshness'), ('answers')) c(consumer) WHERE gate = 'finding'", GIVEN)
def _(spark, sf_dir):
    return fragments.handed(GIVEN.df(spark, sf_dir).filter("gate = 'finding'")).select("site", "check_id", "consumer")

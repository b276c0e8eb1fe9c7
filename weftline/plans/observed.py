"""What was observed of the sites, derived from the page table: see sources.derived."""

from __future__ import annotations

from ..sources import pages as sources
from ..sources.derived import HEAD, TITLE, URL, Derived
from .site_queries import BL

_PATH = "CASE WHEN path = '' THEN '/' ELSE path END"
_LANG = "CASE page_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE 'de' END"

FILES = Derived(
    "files",
    """SELECT site, CASE i % 5 WHEN 0 THEN 'User-agent: *|Disallow: /en # no|Allow: /en/1||User-agent: Googlebot|User-agent: Bingbot|Disallow: /|Allow: /fr|'
      WHEN 1 THEN '# all|User-agent: *|Disallow:|Sitemap: https://' || site || '/s.xml|User-agent: OAI-SearchBot|Disallow: /de/' || (n % 10) || '|Disallow: /e|Allow: /en|'
      WHEN 2 THEN 'User-agent: GPTBot|Disallow: /|' WHEN 3 THEN 'User-agent: Googlebot|Disallow:||User-agent: *|Disallow: /|'
      ELSE 'User-agent: *|Disallow: /*|Allow: /en/' || (i % 100) || '$|Allow: /fr*|Disallow: /es/1*$|' END AS body FROM st""",
)
PATHS = Derived("paths", f"SELECT site, {_PATH} AS path FROM pg UNION SELECT site, '/' AS path FROM st")
RFETCH = Derived(
    "rf",
    """SELECT site, CASE i % 6 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 503 WHEN 3 THEN 500 WHEN 4 THEN NULL ELSE 503 END AS status, 1 AS attempt FROM st
      UNION ALL SELECT site, CASE WHEN i % 6 = 5 THEN 200 ELSE 503 END AS status, 2 AS attempt FROM st WHERE i % 6 IN (2, 5)""",
)
HEADS = Derived(
    "heads",
    f"""SELECT site, {URL} AS url, {_PATH} AS path, CASE WHEN path IN ('', '/') THEN 'homepage' WHEN page_id % 3 = 0 THEN 'product' WHEN page_id % 3 = 1 THEN 'about' ELSE 'other' END AS page_class,
      CASE page_id % 9 WHEN 0 THEN 'NoIndex, follow' WHEN 1 THEN 'index' WHEN 2 THEN 'all' WHEN 3 THEN 'nocache' ELSE NULL END AS robots_meta,
      CASE page_id % 7 WHEN 0 THEN 'max-snippet:0' WHEN 1 THEN 'none; noarchive' WHEN 2 THEN 'unavailable_after: 2030-01-01' ELSE NULL END AS x_robots_tag FROM pg""",
)
BOTS = Derived("bots", f"SELECT site, {_PATH} AS path, page_id % 2 = 0 AS noindex FROM pg WHERE page_id % 3 < 2")
CANON = Derived(
    "canon",
    f"""SELECT site, {URL} AS url, CASE page_id % 6 WHEN 0 THEN {URL} WHEN 1 THEN replace({URL}, 'http://', 'https://') WHEN 2 THEN {HEAD} || '/' WHEN 3 THEN {URL} || 'x' WHEN 4 THEN NULL
      ELSE {URL} || '/' END AS canonical, page_id % 4 = 0 AS redirected FROM pg""",
)
CHAINS = Derived(
    "chains",
    f"""SELECT site, {URL} AS url, CASE page_id % 8 WHEN 0 THEN ARR({URL}, {HEAD} || '/moved', {URL}) WHEN 1 THEN ARR({URL}, {URL} || '/1', {URL} || '/2', {URL} || '/3', {URL} || '/4')
      WHEN 2 THEN ARR({URL}, {URL} || '/') ELSE ARR({URL}) END AS redirect_chain FROM pg""",
)
UA = Derived(
    "ua",
    f"""SELECT site, CASE page_id % 3 WHEN 0 THEN 'GPTBot' WHEN 1 THEN 'Googlebot' ELSE 'Bingbot' END AS token, {_PATH} AS path, CASE page_id % 8 WHEN 0 THEN 403 WHEN 1 THEN 404 WHEN 2 THEN NULL WHEN 3 THEN 429 ELSE 200 END AS status,
      CASE page_id % 5 WHEN 0 THEN 403 WHEN 1 THEN NULL ELSE 200 END AS browser_status FROM pg""",
)
MAPS = Derived("maps", "SELECT site, i % 4 <> 0 AS declared, CASE i % 5 WHEN 0 THEN 404 WHEN 1 THEN NULL ELSE 200 END AS status, CASE i % 6 WHEN 0 THEN FALSE WHEN 1 THEN NULL ELSE TRUE END AS parse_ok FROM st")
SITEMAP = Derived(
    "sitemap",
    f"""SELECT site, '<urlset><url><loc>' || {URL} || '</loc>' || CASE page_id % 3 WHEN 0 THEN '' ELSE '<lastmod>2024-0' || (1 + page_id % 4) || '-01</lastmod>' END || '</url><url><loc>' || {HEAD} || '/old' || page_id
      || '</loc></url></urlset>' AS body FROM pg""",
)
ALTS = Derived(
    "alts",
    f"""SELECT site, url, path, lang, CASE WHEN page_id % 11 = 0 THEN 'english' ELSE coalesce(next_lang, lang) END AS alt_lang, coalesce(next_url, url) AS alt_href
      FROM (SELECT site, page_id, {URL} AS url, path, {_LANG} AS lang, lead({URL}) OVER (PARTITION BY site ORDER BY page_id) AS next_url, lead({_LANG}) OVER (PARTITION BY site ORDER BY page_id) AS next_lang FROM pg) a""",
)
LLMS = Derived("llms", "SELECT site, CASE WHEN i % 3 = 1 THEN 'ecommerce' ELSE 'docs-developer' END AS site_type, CASE i % 4 WHEN 0 THEN 404 WHEN 1 THEN 200 WHEN 2 THEN NULL ELSE 403 END AS llms_status FROM st")
ROT = Derived("rot", f"SELECT site, CASE WHEN page_id % 10 = 0 THEN {HEAD} || '/pricing' ELSE {URL} END AS url, CASE page_id % 6 WHEN 0 THEN 404 WHEN 1 THEN 410 WHEN 2 THEN 500 WHEN 3 THEN NULL ELSE 200 END AS status FROM pg")
TIMES = Derived("times", "SELECT site, CASE WHEN page_id % 9 = 0 THEN 503 ELSE 200 END AS status, 200 + (page_id * 37) % 9000 AS timing_ms FROM pg")
PRESENCE = Derived(
    "presence",
    """SELECT site, CASE WHEN page_id % 3 = 0 THEN 'owned' ELSE 'independent' END AS ownership, CASE page_id % 5 WHEN 0 THEN 404 WHEN 1 THEN NULL WHEN 2 THEN 302 WHEN 3 THEN 500 ELSE 200 END AS http_status,
      CASE page_id % 4 WHEN 0 THEN TRUE WHEN 1 THEN NULL WHEN 2 THEN FALSE ELSE TRUE END AS brand_name_match FROM pg""",
)
SPOKEN = Derived("spoken", "SELECT site, 'independent' AS ownership, CASE WHEN page_id % 7 = 0 THEN 404 ELSE 200 + page_id % 2 END AS http_status, page_id % 5 <> 0 AS brand_name_match FROM pg")
NAMES = Derived("names", f"SELECT site, CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 7 = 0 THEN {TITLE} || ' Software' ELSE {TITLE} END AS name FROM pg")
MISSING = Derived("missing", "SELECT site, CASE i % 4 WHEN 0 THEN 200 WHEN 2 THEN NULL ELSE 404 END AS status, i % 3 = 0 AS has_search, n AS links, i % 7 = 0 AS suggests FROM st")
VARIANTS = Derived(
    "variants",
    "SELECT site, CASE WHEN page_id % 2 = 0 THEN 'http' ELSE 'www' END AS variant, CASE page_id % 4 WHEN 1 THEN FALSE WHEN 2 THEN NULL ELSE TRUE END AS path_preserved, CASE page_id % 3 WHEN 0 THEN FALSE WHEN 1 THEN NULL ELSE TRUE END AS variant_ok FROM pg",
)
DATES = Derived("dates", f"SELECT site, {URL} AS url, CASE WHEN page_id % 6 = 0 THEN 'last spring' ELSE '20' || (20 + page_id % 9) || '-0' || (1 + page_id % 9) || '-' || (10 + page_id % 22) || CASE WHEN page_id % 2 = 0 THEN 'T10:00:00Z' ELSE '' END END AS value FROM pg")
LEVELS = Derived(
    "levels",
    "SELECT doc_id AS page_id, ord, (1 + (length(line) // 120) % 2)::INTEGER AS level, line AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents)",
    "SELECT doc_id AS page_id, CAST(ord + 1 AS INT) AS ord, CAST(1 + (length(line) div 120) % 2 AS INT) AS level, line AS text FROM (SELECT doc_id, posexplode(split(text, chr(10))) AS (ord, line) FROM documents)",
    tables=("documents",),
)
TEXTS = {name: Derived(name, "SELECT doc_id AS id, text AS t FROM documents", tables=("documents",)) for name in ("prices", "confused", "worded_facts")}
QUESTIONS = Derived(
    "questions",
    f"""SELECT page_id + 1 AS pos, CASE page_id % 4 WHEN 0 THEN CAST(page_id AS STRING) WHEN 1 THEN 'Q-' || page_id WHEN 2 THEN NULL ELSE 'bad' END AS id, 'What?' AS question,
      CASE page_id % 3 WHEN 0 THEN {URL} WHEN 1 THEN replace(replace({URL}, 'https://', 'http://'), 'http://', 'http://www.') ELSE 'http://zz.example/' || page_id END AS expected_page FROM pg""",
)
TARGETS = Derived("targets", f"SELECT page_id, {URL} AS url FROM pg")
BLOCKS = Derived("blocks", "SELECT page_id, site, ord, line FROM bl", of={"bl": lambda spark, sf_dir: sources.blocks(sources.read_pages(spark, sf_dir))}, before=(BL,))
PASSAGES = Derived(
    "passages",
    """SELECT 'Q-' || page_id || '-' || ord AS question_id, page_id, CASE (page_id + ord) % 4 WHEN 0 THEN trim(substring(line, 3, 25)) WHEN 1 THEN line || ' ' || trim(substring(next_line, 1, 10)) WHEN 2 THEN 'no such words in here' ELSE line END AS passage
      FROM (SELECT page_id, ord, line, lead(line) OVER (PARTITION BY page_id ORDER BY ord) AS next_line FROM blocks) b WHERE ord % 5 = 0 AND length(trim(substring(line, 3, 25))) > 8 AND next_line IS NOT NULL""",
    of={"blocks": BLOCKS.df},
)
ASKED = Derived(
    "asked",
    "SELECT 'Q-' || page_id || '-' || ord AS question_id, page_id, CASE (page_id + ord) % 4 WHEN 0 THEN trim(substring(line, 5, 30)) WHEN 1 THEN NULL WHEN 2 THEN 'e' ELSE 'no such words in here' END AS anchor FROM blocks WHERE ord % 5 = 0",
    of={"blocks": BLOCKS.df},
)
RESOLVE = Derived(
    "resolve",
    f"""SELECT page_id, url AS base, CASE page_id % 9 WHEN 0 THEN 'http://b/' WHEN 1 THEN '//c/d' WHEN 2 THEN '/e/./g' WHEN 3 THEN 'f' WHEN 4 THEN '?g=2' WHEN 5 THEN '#h' WHEN 6 THEN '' WHEN 7 THEN 'mailto:i@j' ELSE '../k' END AS href FROM pg""",
)
_CHECKS = ("REP-KEY-FACT-LOSS", "REP-EXTRACTION-LOSS", "REP-LINKS-SCRIPT-ONLY", "ACC-ROBOTS-ROLE", "ACC-LINK-ROT", "REF-SOFT-404", "ACC-FETCH-LATENCY", "NO-SUCH-CHECK", "ENT-JSONLD-INVALID", "ACC-BOT-CHALLENGE", "ACC-SITEMAP-ORPHAN")
_CHECK = "CASE page_id % 11 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CHECKS[:-1])) + f" ELSE '{_CHECKS[-1]}' END"
RESULTS = Derived(
    "results",
    f"""SELECT site, {_CHECK} AS check_id, CASE page_id % 7 WHEN 5 THEN 'pass' WHEN 6 THEN 'not_evaluated' ELSE 'finding' END AS gate, CASE page_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity,
      CASE page_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence, CASE page_id % 6 WHEN 0 THEN 'answers 200, page ' WHEN 1 THEN 'guaranteed; page ' WHEN 2 THEN 'see ZZZ-NOTREAL, ACC-LINK-ROT and UTF-8; page ' ELSE 'page ' END || page_id AS evidence,
      CASE WHEN page_id % 10 = 5 THEN 'hypothesis' ELSE 'direct-measurement' END AS evidence_quality, ARR({URL}, {HEAD} || '/') AS urls FROM pg""",
)
IDEAS = Derived("ideas", f"SELECT site, CASE page_id % 4 WHEN 0 THEN 'Add prices' WHEN 1 THEN 'add Prices' WHEN 2 THEN 'Fix menu' ELSE {TITLE} END AS title, page_id % 5 AS priority FROM pg")
VERDICTS = Derived(
    "verdicts",
    """SELECT site, page_id AS ord, CASE page_id % 4 WHEN 0 THEN 'ANS-QUESTION-UNANSWERED' WHEN 1 THEN 'OFF-BRAND-ABSENT' WHEN 2 THEN 'FRS-STALE-VERSION' ELSE 'ANS-PASSAGE-INCOMPLETE' END AS check_id,
      CASE page_id % 5 WHEN 0 THEN 'finding' WHEN 1 THEN 'pass' WHEN 2 THEN 'perhaps' WHEN 3 THEN 'not_evaluated' ELSE 'finding' END AS gate, CASE WHEN page_id % 3 = 0 THEN 'high' ELSE NULL END AS severity,
      CASE WHEN page_id % 2 = 0 THEN NULL ELSE 'seen on ' || page_id END AS evidence FROM pg""",
)
MEASURES = Derived("measures", "SELECT site, 'ANS-QUESTION-UNANSWERED' AS check_id, n || ' of 8 open' AS measure FROM st UNION ALL SELECT site, 'REF-PERF-RISK' AS check_id, i || ' scripts' AS measure FROM st")
PROBES = Derived("probes", "SELECT 'Q-' || page_id AS question_id, CASE page_id % 5 WHEN 0 THEN 'official-cited' WHEN 1 THEN 'mentioned-not-cited' WHEN 2 THEN 'wrong-entity' ELSE 'absent' END AS outcome FROM pg")
PROMPTS = Derived("prompts", f"SELECT 'Q-' || page_id AS question_id, {TITLE} AS query FROM pg WHERE page_id % 4 <> 0")
FETCHES = Derived(
    "fetches",
    f"""SELECT site, {URL} AS url, CASE page_id % 5 WHEN 0 THEN 404 WHEN 1 THEN NULL WHEN 2 THEN 500 ELSE 200 END AS status, CASE page_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'application/xhtml+xml' WHEN 2 THEN NULL ELSE 'Text/HTML; charset=utf-8' END AS content_type,
      CASE WHEN page_id % 3 = 0 THEN ARR({URL}, {HEAD}, {URL}) ELSE ARR({URL}) END AS chain FROM pg""",
)
_LIST = "'<urlset><url><loc> ' || lo || ' </loc><lastmod>2024-01-01</lastmod></url><url><loc>' || hi || '?x=1&amp;y=2</loc></url>'"
MAP_FILES = Derived(
    "map_files",
    f"""SELECT site, 1 AS ord, 'http://' || site || '/s.xml' AS url, CASE WHEN i % 13 = 0 THEN 404 ELSE 200 END AS http_status,
      CASE WHEN i % 11 = 0 THEN NULL WHEN i % 3 = 0 THEN '<sitemapindex><sitemap><loc>http://' || site || '/c.xml</loc></sitemap><sitemap><loc>http://' || site || '/d.xml</loc></sitemap></sitemapindex>' WHEN i % 7 = 0 THEN {_LIST} ELSE {_LIST} || '</urlset>' END AS body FROM st
      UNION ALL SELECT site, 3 AS ord, 'http://' || site || '/c.xml' AS url, 200 AS http_status, CASE WHEN i % 2 = 0 THEN {_LIST} || '<url><lastmod>2024-03-01</lastmod></url></urlset>' ELSE '<urlset><url></urlset>' END AS body FROM st WHERE i % 3 = 0 AND i % 5 <> 0
      UNION ALL SELECT site, 2 AS ord, 'http://' || site || '/t.xml' AS url, 200 AS http_status, '<urlset><!-- <url><loc>http://no/</loc></url> --><url><loc>' || hi || '</loc></url></urlset>' AS body FROM st WHERE i % 4 = 0""",
)
MAP_LINKS = Derived("map_links", f"SELECT site, page_id, 1 AS ord, CASE page_id % 4 WHEN 0 THEN 'http://' || site || '/p' || page_id || '.PNG' WHEN 1 THEN 'http://' || site || '/feed/' || page_id WHEN 2 THEN regexp_replace({URL}, '/+$', '') ELSE 'http://z/' || page_id END AS target FROM pg")
_RESULT = """'{"check_id": "ENT-NAME-INCONSISTENT", "gate": "finding", "severity": "low", "evidence": "' || n || ' pages"}, {"check_id": "ENT-AMBIGUOUS-NAME", "gate": "pass"}'"""
FRAGMENTS = Derived(
    "fragments",
    f"""SELECT site, 'entity' AS name, CASE i % 4 WHEN 0 THEN '{{"results": [{{"check_id": "ENT-AMBIGUOUS-NAME", "gate": "maybe"}}]}}' WHEN 1 THEN '{{"results": [{{"gate": "pass"}}]}}' ELSE '{{"results": [' || {_RESULT} || ']}}' END AS line FROM st
      UNION ALL SELECT site, 'freshness' AS name, CASE i % 3 WHEN 0 THEN '{{"results": [' WHEN 1 THEN '{{"results": []}}' ELSE '{{"results": [{{"check_id": "FRS-CLAIM-CONFLICT", "gate": "not_evaluated"}}]}}' END AS line FROM st
      UNION ALL SELECT site, 'answers' AS name, CASE i % 2 WHEN 0 THEN NULL ELSE '{{"other": 1}}' END AS line FROM st""",
)
GIVEN = Derived(
    "given",
    """SELECT site, 'FRS-CLAIM-CONFLICT' AS check_id, 'not_evaluated' AS gate, CASE WHEN i % 2 = 0 THEN NULL ELSE 'low' END AS severity FROM st
      UNION ALL SELECT site, 'ENT-AMBIGUOUS-NAME' AS check_id, CASE WHEN i % 3 = 0 THEN 'finding' ELSE 'not_evaluated' END AS gate, 'medium' AS severity FROM st
      UNION ALL SELECT site, 'ANS-QUESTION-UNANSWERED' AS check_id, 'finding' AS gate, CASE WHEN i % 2 = 0 THEN 'critical' ELSE 'high' END AS severity FROM st
      UNION ALL SELECT site, 'ACC-LLMS-TXT-ABSENT' AS check_id, CASE WHEN i % 2 = 0 THEN 'pass' ELSE 'finding' END AS gate, CASE WHEN i % 2 = 0 THEN NULL ELSE 'low' END AS severity FROM st""",
)
COMPLETED = Derived(
    "completed",
    """SELECT site, CASE page_id % 4 WHEN 0 THEN 'FRS-CLAIM-CONFLICT' WHEN 1 THEN 'ENT-AMBIGUOUS-NAME' WHEN 2 THEN 'ANS-QUESTION-UNANSWERED' ELSE 'FRS-STALE-VERSION' END AS check_id, page_id AS ord,
      CASE page_id % 5 WHEN 0 THEN 'pass' WHEN 1 THEN 'perhaps' WHEN 2 THEN 'not_evaluated' ELSE 'finding' END AS gate, CASE page_id % 6 WHEN 0 THEN NULL ELSE 'reason ' || page_id END AS reason FROM pg""",
)
WORDED = Derived(
    "worded",
    f"""SELECT site, CASE page_id % 4 WHEN 0 THEN 'title' WHEN 1 THEN 'action' WHEN 2 THEN 'summary' ELSE 'evidence' END AS field,
      CASE page_id % 6 WHEN 0 THEN 'Add FAQPage markup' WHEN 1 THEN 'This will rank and is guaranteed' WHEN 2 THEN 'llms.txt helps visibility; LCP is 2.5 s' WHEN 3 THEN 'snapshot.pages[0] says is_soft_404' WHEN 4 THEN NULL ELSE {TITLE} END AS text FROM pg""",
)
ANSWERED = Derived("answered", f"SELECT {URL} AS url, 'Server: s' || page_id || CASE page_id % 3 WHEN 0 THEN '|CF-RAY: 1-x|Set-Cookie: s=1' WHEN 1 THEN '|cache-control: max-age=60, public|Link: </x>; rel=y' ELSE '|last-modified: Mon' END AS raw FROM pg")
VARIANTS_OF_NAMES = Derived("variants_of_names", f"SELECT site, page_id AS ord, {TITLE} AS name FROM pg")
RUNS = Derived(
    "probe_runs",
    """SELECT conv_id AS run, 'Q-' || turn AS question_id, CASE WHEN turn % 4 = 3 THEN 'navigational' ELSE 'informational' END AS kind, CASE (conv_id + turn) % 9 WHEN 0 THEN 'seen' WHEN 1 THEN 'absent' ELSE 'cited' END AS outcome,
      CASE WHEN conv_id % 13 = 0 THEN 'yesterday' ELSE '2026-01-01T00:00:00Z' END AS timestamp FROM conversations UNION ALL SELECT conv_id AS run, 'Q-1' AS question_id, 'informational' AS kind, 'cited' AS outcome, '2026-01-01T00:00:00Z' AS timestamp FROM conversations WHERE turn = 1 AND conv_id % 5 = 0""",
    tables=("conversations",),
)
TOKENS = Derived("tokens", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Googlebot' WHEN 1 THEN '*' WHEN 2 THEN 'GPTBot' ELSE 'Bot' || page_id END AS token FROM pg")
SPACED = Derived("spaced", f"SELECT page_id, {HEAD} || '/' || translate({TITLE}, '%', ' ') || CASE page_id % 3 WHEN 0 THEN '/%c3%bc%' WHEN 1 THEN '?q=[1]&b=é ü' ELSE '' END AS url FROM pg")
_NODE = """'<script type="application/ld+json">{"@type": "Product", "name": "P' || page_id || '"}</script></head>'"""
#: The pages with parts that they lack: JSON-LD, a broken one too, closed details, images without sizes, scripts in the head.
HTML_MADE = Derived(
    "html_pages",
    f"""SELECT page_id, site, url, CASE page_id % 5 WHEN 0 THEN replace(html, '</head>', {_NODE}) WHEN 1 THEN replace(html, '</head>', '<script type="application/ld+json">{{broken</script></head>')
      WHEN 2 THEN replace(html, '</article>', '<details><summary>More</summary>text</details><details open>x</details><img src="a.png"></article>')
      WHEN 3 THEN replace(html, '</head>', '<script src="/a.js"></script><script src="/b.js"></script></head>') ELSE html END AS html FROM pg""",
)

"""Observations of a few sites, each written to bring out one case."""

from weftline.operators import fragments  # noqa: F401
from weftline.plans.audit_queries import HTML  # noqa: F401
from weftline.sources.inline import Inline

_ROBOTS = (
    ("a", "User-agent: *\nDisallow: /private # no\nAllow: /private/open\n\nUser-agent: Googlebot\nUser-agent: Bingbot\nDisallow: /\nAllow: /docs\n"),
    ("b", "# all\nUser-agent: *\nDisallow:\nSitemap: https://b/s.xml\nUser-agent: OAI-SearchBot\nDisallow: /pricing\nDisallow: /p\nAllow: /pricing\n"),
    ("c", "User-agent: GPTBot\nDisallow: /\n"),
    ("d", "User-agent: Googlebot\nDisallow:\n\nUser-agent: *\nDisallow: /\n"),
    ("e", "User-agent: *\nDisallow: /*\nAllow: /docs/1$\nAllow: /pri*\nDisallow: /private/open*$\nDisallow: /pro*uct\n"),
)
FILES = Inline("files", "site string, body string", tuple((s, b.replace("\n", "|")) for s, b in _ROBOTS))
PATHS = Inline("paths", "site string, path string", tuple((s, p) for s in "abcde" for p in ("/", "/private/x", "/private/open/y", "/docs/1", "/pricing", "/product")))
RFETCH = Inline("rf", "site string, status int, attempt int", (("a", 200, 1), ("b", 404, 1), ("c", 503, 1), ("c", 503, 2), ("d", 500, 1), ("e", 503, 1), ("e", 200, 2), ("f", None, 1)))
HEADS = Inline("heads", "site string, url string, path string, page_class string, robots_meta string, x_robots_tag string", (
    ("a", "http://a/", "/", "homepage", "NoIndex, follow", None), ("a", "http://a/p", "/p", "product", "index", "max-snippet:0"), ("b", "http://b/", "/", "homepage", "all", None),
    ("b", "http://b/x", "/x", "other", "noindex", None), ("c", "http://c/about", "/about", "about", None, "none; noarchive"), ("d", "http://d/", "/", "homepage", "nocache", None),
))
BOTS = Inline("bots", "site string, path string, noindex boolean", (("c", "/about", False), ("a", "/", True)))
CANON = Inline("canon", "site string, url string, canonical string, redirected boolean", (
    ("a", "https://www.a.com/x/", "http://a.com/x", False), ("b", "https://b.com/1", "https://b.com/", False), ("b", "https://b.com/2", "https://b.com", False), ("c", "https://c.com/1", "https://c.com/2", True),
    ("c", "https://c.com/3", "https://c.com/4", True), ("c", "https://c.com/5", "https://c.com/5", False), ("d", "https://d.com/1", "https://d.com/2", False), ("d", "https://d.com/3", None, False),
))
CHAINS = Inline("chains", "site string, url string, redirect_chain array<string>", (
    ("a", "http://a/1", ["http://a/1"]), ("b", "http://b/1", ["http://b/1", "https://B/1", "http://b/1"]), ("c", "http://c/1", ["http://c/1", "https://c/1", "https://c/2", "https://c/3", "https://c/4"]), ("d", "http://d/1", ["http://d/1", "https://d/1/"]),
))
UA = Inline("ua", "site string, token string, path string, status int, browser_status int", (("a", "GPTBot", "/", 403, 200), ("a", "Googlebot", "/", 200, 200), ("b", "GPTBot", "/", 200, 200), ("c", "GPTBot", "/", None, 200), ("d", "Bingbot", "/", 404, 200), ("e", "Bingbot", "/", 403, 403)))
MAPS = Inline("maps", "site string, declared boolean, status int, parse_ok boolean", (("a", True, 200, True), ("b", True, 404, None), ("c", True, 200, False), ("d", False, 404, None), ("e", True, None, None)))
SITEMAP = Inline("sitemap", "site string, body string", (
    ("a", "<urlset><url><loc>http://a/1</loc><lastmod>2024-01-01</lastmod></url><url><loc>http://a/2</loc><lastmod>2024-01-01</lastmod></url></urlset>"), ("b", "<urlset><url><loc>http://b/1</loc></url></urlset>"),
    ("c", "<urlset><url><loc>http://c/1</loc><lastmod>2024-01-01</lastmod></url><url><loc>http://c/2</loc><lastmod>2024-03-01</lastmod></url></urlset>"),
))
ALTS = Inline("alts", "site string, url string, path string, lang string, alt_lang string, alt_href string", (
    ("a", "http://a/en", "/en", "en", "de", "http://a/de"), ("a", "http://a/de", "/de", "de", "en", "http://a/en"), ("b", "http://b/en", "/en", "en", "fr", "http://b/fr"), ("b", "http://b/fr", "/fr", "fr", "fr", "http://b/fr"), ("c", "http://c/en", "/en", "en", "english", "http://c/en"),
))
LLMS = Inline("llms", "site string, site_type string, llms_status int", (("a", "docs-developer", 404), ("b", "docs-developer", 200), ("c", "ecommerce", 404), ("d", "docs-developer", None)))
ROT = Inline("rot", "site string, url string, status int", (("a", "http://a/x", 404), ("b", "http://b/x", 410), ("c", "http://c/1", 404), ("c", "http://c/2", 500), ("c", "http://c/3", 404), ("d", "http://d/pricing", 404), ("e", "http://e/1", None), ("f", "http://f/1", 200)))
TIMES = Inline("times", "site string, status int, timing_ms long", tuple([("a", 200, t) for t in (300, 320, 340, 9000)] + [("b", 200, t) for t in (3000, 3200, 3400)] + [("c", 200, t) for t in (6000, 6100, 6200)] + [("d", 200, 9000), ("d", 200, 9100), ("d", 503, 9200)] + [("e", 500, 1)]))
PRESENCE = Inline("presence", "site string, ownership string, http_status int, brand_name_match boolean", (("a", "independent", 200, True), ("b", "independent", 404, None), ("c", "independent", None, None), ("c", "independent", 404, None), ("d", "owned", 200, True), ("e", "independent", 302, None)))
NAMES = Inline("names", "site string, name string", (("a", "Acme Software"), ("a", "Acme"), ("b", "Mercury"), ("c", None), ("d", "Orion Foundation"), ("e", "Delta Inc.")))
MISSING = Inline("missing", "site string, status int, has_search boolean, links int, suggests boolean", (("a", 200, False, 9, False), ("b", 404, False, 1, False), ("c", 404, True, 0, False), ("d", None, False, 0, False), ("e", 404, False, 5, False)))
VARIANTS = Inline("variants", "site string, variant string, path_preserved boolean, variant_ok boolean", (("a", "http", True, True), ("a", "www", False, True), ("b", "http", True, False), ("b", "www", True, True), ("c", "http", None, None), ("c", "www", None, False)))
DATES = Inline("dates", "site string, url string, value string", (("a", "u1", "2024-02-30"), ("b", "u1", "2024-02-29T10:00:00Z"), ("c", "u1", "2099-01-01"), ("d", "u1", "last spring")))
LEVELS = Inline("levels", "page_id long, ord int, level int, text string", tuple([(1, i, 2, f"a{i}") for i in range(1, 11)] + [(1, 11, 3, "b")] + [(1, 12 + i, 2, f"c{i}") for i in range(7)] + [(2, 1, 1, "t")]))
QUESTIONS = Inline("questions", "id string, question string, expected_page string", (("1", "What?", "https://www.a.com/x"), ("Q-7", "How?", "http://a.com/X/"), (None, "Why?", "http://b.com"), ("bad", "Who?", "http://zz.com/q")))
TARGETS = Inline("targets", "page_id long, url string", ((1, "http://a.com/x"), (2, "http://a.com/X/"), (3, "https://b.com/")))
BLOCKS = Inline("blocks", "page_id long, site string, ord int, line string", ((1, "a", 1, "We sell paint."), (1, "a", 2, "Open on Mondays."), (2, "a", 1, "We sell paint."), (2, "a", 2, "Closed.")))
PASSAGES = Inline("passages", "question_id string, page_id long, passage string", (("Q-001", 1, "sell paint"), ("Q-002", 1, "paint. Open on"), ("Q-003", 2, "Mondays"), ("Q-004", 2, "We sell paint.")))
RESOLVE = Inline("resolve", "base string, href string", tuple(("https://a.com/x/y?q=1#f", h) for h in ("http://b/", "//c/d", "/e", "f", "?g=2", "#h", "", "mailto:i@j")) + (("https://a.com", "k"),))
RESULTS = Inline("results", "site string, check_id string, gate string, severity string, confidence string, evidence string, evidence_quality string, urls array<string>", (
    ("a", "REP-KEY-FACT-LOSS", "finding", "high", "medium", "shell", "direct-measurement", ["u1", "u2"]), ("a", "REP-EXTRACTION-LOSS", "finding", "medium", "medium", "late", "direct-measurement", ["u2"]), ("a", "REP-LINKS-SCRIPT-ONLY", "finding", "medium", "medium", "js", "direct-measurement", ["u9"]),
    ("a", "ACC-ROBOTS-ROLE", "finding", "critical", "medium", "blocked", "direct-measurement", ["u1"]), ("a", "ACC-LINK-ROT", "finding", "low", "low", "maybe", "direct-measurement", ["u3"]), ("a", "REF-SOFT-404", "finding", "high", "high", "no code", "direct-measurement", ["u4"]),
    ("b", "REF-SOFT-404", "finding", "high", "high", "answers 200", "direct-measurement", ["u4"]), ("b", "REF-SOFT-404", "finding", "high", "high", "answers 200", "direct-measurement", ["u4"]), ("b", "ACC-FETCH-LATENCY", "pass", None, None, "fast", "hypothesis", []), ("b", "ACC-LINK-ROT", "pass", None, None, "ok", "direct-measurement", []),
    ("b", "NO-SUCH-CHECK", "finding", "high", "high", "x", "direct-measurement", []), ("b", "ENT-JSONLD-INVALID", "finding", "low", "high", "bad; guaranteed", "direct-measurement", ["u5"]), ("b", "ACC-LINK-ROT", "not_evaluated", None, None, None, "direct-measurement", []),
))
IDEAS = Inline("ideas", "site string, title string, priority int", (("a", "Add prices", 2), ("a", "add Prices", 1), ("a", "Fix menu", 1), ("b", "Fix menu", 3)))
VERDICTS = Inline("verdicts", "site string, ord int, check_id string, gate string, severity string, evidence string", (("a", 1, "ANS-QUESTION-UNANSWERED", "finding", None, None), ("a", 2, "ANS-QUESTION-UNANSWERED", "pass", None, "later"), ("a", 3, "OFF-BRAND-ABSENT", "perhaps", None, "odd"), ("a", 4, "FRS-STALE-VERSION", "pass", None, "fine")))
MEASURES = Inline("measures", "site string, check_id string, measure string", (("a", "ANS-QUESTION-UNANSWERED", "3 of 8 open"), ("a", "REF-PERF-RISK", "2 scripts")))
PROBES = Inline("probes", "question_id string, outcome string", (("Q-001", "cited"), ("Q-002", "absent"), ("Q-003", "absent"), ("Q-009", "cited")))
PROMPTS = Inline("prompts", "question_id string, query string", (("Q-001", "what is a"), ("Q-002", "who is b"), ("Q-003", "how is c")))
FETCHES = Inline("fetches", "site string, url string, status int, content_type string, chain array<string>", (
    ("a", "http://a/1", 200, "text/html; charset=utf-8", ["u"]), ("a", "http://a/2", 200, "application/pdf", ["u"]), ("a", "http://a/3", 404, "text/html", ["u"]), ("a", "http://a/4", None, None, ["u", "v", "u"]), ("a", "http://a/5", 200, "application/xhtml+xml", ["u"]), ("a", "http://a/6", 500, None, ["u", "v"]),
))
PRICES = Inline("prices", "id int, t string", ((1, "from $1,299.50 a year"), (2, "free"), (3, "v2 and 3"), (4, ""), (5, "12")))
CONFUSED = Inline("confused", "id int, t string", ((1, "it’s a — test…"), (2, "“quoted” text"), (3, "plain"), (4, "a‑b")))
ASKED = Inline("asked", "question_id string, page_id long, anchor string", (("Q-001", 1, "sell paint"), ("Q-002", 1, None), ("Q-003", 2, "Mondays"), ("Q-004", 1, "e")))
RUNS = Inline("probe_runs", "run int, question_id string, kind string, outcome string, timestamp string", tuple([(1, f"Q-00{i}", "informational", "cited", "2025-01-01T00:00:00Z") for i in range(7)] + [(2, "Q-001", "navigational", "cited", "2025-01-01T00:00:00Z"), (2, "Q-001", "navigational", "seen", "yesterday"), (3, "Q-001", "informational", "absent", "2025-01-01T00:00:00Z")]))
_LIST = "<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>{}</urlset>"
MAP_FILES = Inline("map_files", "site string, ord int, url string, http_status int, body string", (
    ("a", 1, "http://a/s.xml", 200, _LIST.format("<url><loc> http://a/1 </loc><lastmod>2024-01-01</lastmod></url><url><loc>http://a/2?x=1&amp;y=2</loc><lastmod>2024-02-01</lastmod></url><url><lastmod>2024-01-01</lastmod></url>")),
    ("b", 1, "http://b/i.xml", 200, "<sitemapindex><sitemap><loc>http://b/c1.xml</loc></sitemap><sitemap><loc>http://b/c2.xml</loc></sitemap></sitemapindex>"),
    ("b", 3, "http://b/c1.xml", 200, "<sm:urlset xmlns:sm='http://www.sitemaps.org/schemas/sitemap/0.9' xmlns:image='http://i'><sm:url><image:loc>http://b/x.png</image:loc><sm:loc>http://b/1</sm:loc></sm:url><sm:url><sm:loc>http://b/2</sm:loc><sm:lastmod></sm:lastmod></sm:url></sm:urlset>"),
    ("b", 4, "http://b/c2.xml", 200, _LIST.format("<url><loc>http://b/3</loc></url>")),
    ("c", 1, "http://c/s.xml", 200, "<urlset><url><loc>http://c/1</loc></url>"),
    ("c", 2, "http://c/t.xml", 200, _LIST.format("<!-- <url><loc>http://c/0</loc></url> --><url><loc>http://c/1</loc></url>")),
    ("d", 1, "http://d/i.xml", 200, "<sitemapindex><sitemap><loc>http://d/none.xml</loc></sitemap></sitemapindex>"),
    ("e", 1, "http://e/s.xml", 404, "<urlset></urlset>"),
    ("f", 1, "http://f/s.xml", 200, None),
    ("g", 1, "http://g/i.xml", 200, "<sitemapindex><sitemap><loc>http://g/c.xml</loc></sitemap></sitemapindex>"),
    ("g", 3, "http://g/c.xml", 200, "<urlset><url></urlset>"),
))
MAP_LINKS = Inline("map_links", "site string, page_id long, ord int, target string", (
    ("a", 1, 1, "http://a/3"), ("a", 1, 2, "http://a/"), ("a", 1, 3, "http://z/4"), ("a", 2, 1, "http://a/3#x"), ("a", 2, 2, "http://a/feed/5"), ("a", 2, 3, "http://a/4?q"), ("h", 3, 1, "https://h/1"), ("h", 3, 2, "https://h/x.PNG"),
))
FRAGMENTS = Inline("fragments", "site string, name string, line string", (
    ("a", "entity", '{"results": [{"check_id": "ENT-NAME-INCONSISTENT", "gate": "finding", "severity": "low", "evidence": "x"}, {"check_id": "ENT-AMBIGUOUS-NAME", "gate": "pass"}]}'),
    ("a", "freshness", '{"results": ['), ("b", "entity", '{"results": [{"check_id": "ENT-AMBIGUOUS-NAME", "gate": "maybe"}]}'), ("b", "answers", '{"other": 1}'),
    ("b", "freshness", '{"results": []}'), ("c", "entity", '{"results": [{"gate": "pass"}]}'), ("c", "answers", None), ("c", "freshness", '{"results": [{"check_id": "FRS-CLAIM-CONFLICT", "gate": "not_evaluated"}]}'),
))
GIVEN = Inline("given", "site string, check_id string, gate string, severity string", (
    ("a", "FRS-CLAIM-CONFLICT", "not_evaluated", None), ("a", "ENT-AMBIGUOUS-NAME", "not_evaluated", "low"), ("a", "FRS-LASTMOD-UNIFORM", "finding", "low"), ("b", "ENT-AMBIGUOUS-NAME", "finding", "medium"), ("b", "FRS-STALE-VERSION", "not_evaluated", "low"), ("b", "ANS-QUESTION-UNANSWERED", "finding", "high"),
    ("c", "ANS-QUESTION-UNANSWERED", "finding", "high"), ("c", "ENT-JSONLD-INVALID", "finding", "high"), ("c", "ACC-LLMS-TXT-ABSENT", "pass", None),
))
COMPLETED = Inline("completed", "site string, check_id string, ord int, gate string, reason string", (
    ("a", "FRS-CLAIM-CONFLICT", 1, "finding", "no candidate"), ("a", "ENT-AMBIGUOUS-NAME", 2, "pass", "second"), ("a", "ENT-AMBIGUOUS-NAME", 1, "finding", "first"), ("b", "ENT-AMBIGUOUS-NAME", 1, "pass", "clear"), ("b", "FRS-STALE-VERSION", 1, "pass", None), ("b", "ANS-QUESTION-UNANSWERED", 1, "perhaps", "odd"), ("z", "ENT-AMBIGUOUS-NAME", 1, "pass", "nobody"),
))
SPOKEN = Inline("spoken", PRESENCE.schema, tuple(("a", "independent", 200, True) for _ in range(3)) + tuple(("b", o, s, m) for o, s, m in (("independent", 200, True), ("independent", 301, True), ("independent", 404, True), ("owned", 200, True), ("independent", 200, None))) + tuple(("c", "independent", s, True) for s in (200, 302, 200, 500)))
WORDED = Inline("worded", "site string, field string, text string", (
    ("a", "title", "Add FAQPage markup"), ("a", "action", "This will rank and is guaranteed"), ("a", "summary", "llms.txt helps visibility; LCP is 2.5 s"), ("a", "evidence", "snapshot.pages[0] says FAQPage"), ("b", "evidence", "is_soft_404 was true"),
    ("b", "title", "Plain words"), ("b", "action", None), ("b", "summary", "indexnow and howto"),
))
ANSWERED = Inline("answered", "url string, raw string", (("http://a/", "Server: nginx|CF-RAY: 1-x|Set-Cookie: s=1"), ("http://b/", "cache-control: max-age=60, public|Link: </x>; rel=y|last-modified: Mon"), ("http://c/", "x: y")))
VARIANTS_OF_NAMES = Inline("variants_of_names", "site string, ord int, name string", (
    ("a", 1, "Acme Software"), ("a", 2, "Mercury"), ("a", 3, "Acme"), ("a", 4, "Inc."), ("a", 5, "Software Museum"), ("a", 6, "Acme"), ("b", 1, "3 14 Python"), ("b", 2, "14 Docs"), ("b", 3, "Python Docs"), ("b", 4, "14"), ("c", 1, None),
))

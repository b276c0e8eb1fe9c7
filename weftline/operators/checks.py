"""Checks of sites: each takes tables and returns (site, check_id, gate, severity, confidence, evidence, urls).

gate is finding, pass or not_evaluated: what was not observed is never a pass. Rows with nulls in an observation count
as not observed. The tables hold many sites; every check is grouped by site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts, urls
from . import crawl

RESULT = ("site", "check_id", "gate", "severity", "confidence", "evidence", "urls")
PASSED, FOUND, UNSEEN = "pass", "finding", "not_evaluated"


def result(rows: DataFrame, check_id: str, gate: Column, severity: Column | str, confidence: Column | str, evidence: Column, pages: Column | None = None) -> DataFrame:
    """Check results from a row for each site; severity and confidence are null but for findings."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    none = F.lit(None).cast("string")
    found = gate == FOUND
    pages = F.array().cast("array<string>") if pages is None else pages
    return rows.select(
        "site",
        F.lit(check_id).alias("check_id"),
        gate.alias("gate"),
        F.when(found, lit(severity)).otherwise(none).alias("severity"),
        F.when(found, lit(confidence)).otherwise(none).alias("confidence"),
        texts.shorten(evidence).alias("evidence"),
        F.when(found, pages).otherwise(F.array().cast("array<string>")).alias("urls"),
    )


def _urls(condition: Column, url: str = "url") -> Column:
    return F.slice(F.array_sort(F.collect_set(F.when(condition, F.col(url)))), 1, 8)


# ---- reach ----------------------------------------------------------------------------------------------------------


def robots_role(decisions: DataFrame, search_tokens: DataFrame) -> DataFrame:
    """ACC-ROBOTS-ROLE. decisions: (site, token, path, blocked, named) of important paths; named: the token has a group."""
    rows = decisions.join(F.broadcast(search_tokens.select(F.lower("token").alias("token"))), "token")
    hit = F.col("blocked") & F.col("named")
    rows = rows.groupBy("site").agg(F.bool_or(hit).alias("hit"), F.bool_or(hit & (F.col("path") == "/")).alias("root"), F.array_join(F.array_sort(F.collect_set(F.when(hit, F.col("token")))), ", ").alias("tokens"), _urls(hit, "path").alias("pages"))
    gate = F.when(F.col("hit"), FOUND).otherwise(PASSED)
    return result(rows, "ACC-ROBOTS-ROLE", gate, F.when(F.col("root"), "critical").otherwise("high"), "high", F.concat(F.lit("blocked: "), F.col("tokens")), F.col("pages"))


def robots_unavailable(fetches: DataFrame) -> DataFrame:
    """ACC-ROBOTS-UNAVAILABLE. fetches: (site, status, attempt) of robots.txt; status null: no answer."""
    last = fetches.groupBy("site").agg(F.max_by("status", "attempt").alias("status"), F.max("attempt").alias("attempts"))
    state = F.when(F.col("status") == 404, "not_found").when(F.col("status") < 400, "present").otherwise("error")
    gate = F.when(state == "error", FOUND).otherwise(PASSED)
    return result(last, "ACC-ROBOTS-UNAVAILABLE", gate, "high", F.when(F.col("attempts") >= 2, "high").otherwise("low"), F.format_string("robots.txt %s after %d attempts", state, "attempts"))


def index_control(pages: DataFrame, bot_probes: DataFrame) -> DataFrame:
    """ACC-INDEX-CONTROL. pages: (site, url, path, page_class, robots_meta, x_robots_tag); bot_probes: (site, path, noindex).

    Two rows a site at most: pages kept out of the index, and pages that forbid snippets."""
    both = texts.directives(F.concat_ws(",", "robots_meta", "x_robots_tag"))
    names = F.transform(both, lambda d: F.when(d["value"].isNull(), d["name"]).otherwise(F.concat(d["name"], F.lit(":"), d["value"])))
    rows = pages.filter(F.col("page_class").isin(*crawl.IMPORTANT)).withColumn("names", names)
    seen = bot_probes.groupBy("site", "path").agg(F.bool_and(~F.col("noindex")).alias("bot_sees"))
    rows = rows.join(seen, ["site", "path"], "left")
    out = F.arrays_overlap("names", F.array(F.lit("noindex"), F.lit("none")))
    cut = F.arrays_overlap("names", F.array(F.lit("nosnippet"), F.lit("max-snippet:0")))
    site = rows.groupBy("site").agg(F.bool_or(out).alias("out"), F.bool_or(out & (F.col("path") == "/")).alias("root"), F.bool_and(~out | F.coalesce("bot_sees", F.lit(False))).alias("doubt"), _urls(out).alias("out_urls"), F.bool_or(cut).alias("cut"), _urls(cut).alias("cut_urls"))
    first = result(site, "ACC-INDEX-CONTROL", F.when(F.col("out"), FOUND).otherwise(PASSED), F.when(F.col("root"), "critical").otherwise("high"), F.when(F.col("doubt"), "low").otherwise("high"), F.format_string("%d pages with noindex", F.size("out_urls")), F.col("out_urls"))
    second = result(site.filter("cut"), "ACC-INDEX-CONTROL", F.lit(FOUND), "high", "high", F.format_string("%d pages forbid snippets", F.size("cut_urls")), F.col("cut_urls"))
    return first.unionByName(second)


def noarchive(pages: DataFrame) -> DataFrame:
    """ACC-NOARCHIVE-COPILOT, from the same pages as index_control()."""
    names = F.transform(texts.directives(F.concat_ws(",", "robots_meta", "x_robots_tag")), lambda d: d["name"])
    rows = pages.filter(F.col("page_class").isin(*crawl.IMPORTANT)).withColumn("names", names)
    strong, weak = F.array_contains("names", "noarchive"), F.array_contains("names", "nocache")
    site = rows.groupBy("site").agg(F.bool_or(strong).alias("strong"), F.bool_or(weak).alias("weak"), _urls(strong | weak).alias("pages"))
    return result(site, "ACC-NOARCHIVE-COPILOT", F.when(F.col("strong") | F.col("weak"), FOUND).otherwise(PASSED), F.when(F.col("strong"), "high").otherwise("medium"), "high", F.format_string("%d pages", F.size("pages")), F.col("pages"))


def canonical_conflict(pages: DataFrame) -> DataFrame:
    """ACC-CANONICAL-CONFLICT. pages: (site, url, canonical, redirected)."""
    rows = pages.filter("canonical is not null").withColumn("target", urls.url_key(F.col("canonical"))).withColumn("bad", F.col("target") != urls.url_key(F.col("url")))
    site = rows.groupBy("site").agg(
        F.count_if("bad").alias("n"),
        F.count_distinct(F.when(F.col("bad"), F.col("target"))).alias("targets"),
        F.count_if(F.col("bad") & F.col("redirected")).alias("moved"),
        F.count(F.lit(1)).alias("all"),
        _urls(F.col("bad")).alias("pages"),
    )
    shared = (F.col("n") >= 2) & (F.col("targets") == 1)
    many = F.col("n") >= F.greatest(F.lit(2), F.col("all") / 2)
    gate = F.when((F.col("n") == 0) | shared, PASSED).otherwise(FOUND)
    severity = F.when((F.col("moved") > 0) & many, "high").otherwise("medium")
    confidence = F.when(F.col("moved") > 0, "high").when(F.col("n") <= 2, "low").otherwise("medium")
    return result(site, "ACC-CANONICAL-CONFLICT", gate, severity, confidence, F.format_string("%d of %d canonical URLs differ", "n", "all"), F.col("pages"))


def redirect_loop(fetches: DataFrame) -> DataFrame:
    """ACC-REDIRECT-LOOP. fetches: (site, url, redirect_chain): a chain that repeats a URL, or of four hops and more."""
    keys = F.transform("redirect_chain", urls.redirect_key)
    rows = fetches.withColumn("loop", F.size(F.array_distinct(keys)) < F.size(keys)).withColumn("hops", F.size("redirect_chain") - 1)
    bad = F.col("loop") | (F.col("hops") >= 4)
    site = rows.groupBy("site").agg(F.bool_or("loop").alias("loop"), F.bool_or(bad).alias("bad"), F.max("hops").alias("hops"), _urls(bad).alias("pages"))
    return result(site, "ACC-REDIRECT-LOOP", F.when(F.col("bad"), FOUND).otherwise(PASSED), F.when(F.col("loop"), "high").otherwise("medium"), "high", F.format_string("%d hops at most", "hops"), F.col("pages"))


def bot_challenge(probes: DataFrame) -> DataFrame:
    """ACC-BOT-CHALLENGE. probes: (site, token, path, status, browser_status); null status: not observed."""
    seen = F.col("status").isNotNull() & F.col("browser_status").isNotNull()
    blocked = seen & (F.col("status") != F.col("browser_status")) & F.col("status").isin(401, 403, 429, 503)
    site = probes.groupBy("site").agg(F.bool_or(F.coalesce(blocked, F.lit(False))).alias("hit"), F.bool_or(seen).alias("seen"), F.array_join(F.array_sort(F.collect_set(F.when(blocked, F.concat_ws(" ", "token", "status")))), ", ").alias("who"))
    gate = F.when(F.col("hit"), FOUND).when(F.col("seen"), PASSED).otherwise(UNSEEN)
    return result(site, "ACC-BOT-CHALLENGE", gate, "high", "medium", F.concat(F.lit("answered: "), F.col("who")))


def sitemap_orphan(listed: DataFrame, links: DataFrame) -> DataFrame:
    """ACC-SITEMAP-ORPHAN. listed: (site, path) of the sitemap; links: as of sources.pages.links()."""
    alone = crawl.orphans(listed, links).withColumn("decisive", F.lower("path").rlike("^/(?:pricing|plans|product|features|docs|about)[^/]*$"))
    sizes = listed.groupBy("site").agg(F.count_distinct(urls.norm_path(F.col("path"))).alias("candidates"))
    found = alone.groupBy("site").agg(F.count(F.lit(1)).alias("orphans"), F.bool_or("decisive").alias("decisive"), _urls(F.lit(True), "path").alias("pages"))
    rows = sizes.join(found, "site", "left").withColumn("orphans", F.coalesce("orphans", F.lit(0)))
    gate = F.when((F.col("orphans") > 0) & (F.col("candidates") >= 50), FOUND).otherwise(PASSED)
    return result(rows, "ACC-SITEMAP-ORPHAN", gate, F.when(F.col("decisive"), "medium").otherwise("low"), "medium", F.format_string("%d of %d listed pages have no link", "orphans", "candidates"), F.col("pages"))


def sitemap_invalid(sitemaps: DataFrame) -> DataFrame:
    """ACC-SITEMAP-INVALID. sitemaps: (site, declared, status, parse_ok)."""
    bad = F.col("declared") & (F.coalesce(F.col("status") >= 400, F.lit(True)) | ~F.coalesce("parse_ok", F.lit(False)))
    site = sitemaps.groupBy("site").agg(F.count_if(bad).alias("n"))
    return result(site, "ACC-SITEMAP-INVALID", F.when(F.col("n") > 0, FOUND).otherwise(PASSED), "medium", "high", F.format_string("%d declared sitemaps cannot be read", "n"))


def hreflang(pages: DataFrame) -> DataFrame:
    """ACC-HREFLANG-INCONSISTENT. pages: (site, url, path, lang, alternates array<struct<lang, href>>)."""
    each = pages.select("site", "url", F.col("path").alias("from_path"), F.col("lang").alias("own"), F.explode("alternates").alias("alt"))
    each = each.select("site", "url", "from_path", "own", F.lower("alt.lang").alias("alt"), urls.norm_path(urls.path(F.col("alt.href"))).alias("to_path"))
    back = pages.select("site", urls.norm_path(F.col("path")).alias("to_path"), F.transform("alternates", lambda x: F.lower(x["lang"])).alias("back"))
    rows = each.join(back, ["site", "to_path"], "left")
    invalid = ~F.col("alt").rlike("^(?:[a-z]{2,3}(?:-[a-z0-9]{2,8})*|x-default)$")
    one_way = F.col("back").isNotNull() & (urls.norm_path(F.col("from_path")) != F.col("to_path")) & ~F.array_contains("back", F.lower("own"))
    bad = F.coalesce(invalid | one_way, F.lit(False))
    site = pages.select("site").distinct().join(rows.groupBy("site").agg(F.count_if(bad).alias("n"), _urls(bad).alias("pages")), "site", "left")
    gate = F.when(F.col("n").isNull(), UNSEEN).when(F.col("n") > 0, FOUND).otherwise(PASSED)
    return result(site, "ACC-HREFLANG-INCONSISTENT", gate, "medium", "high", F.format_string("%d bad alternates", F.coalesce("n", F.lit(0))), F.col("pages"))


def llms_txt(sites: DataFrame) -> DataFrame:
    """ACC-LLMS-TXT-ABSENT. sites: (site, site_type, llms_status); asked of documentation sites only."""
    gate = F.when(F.col("site_type") != "docs-developer", UNSEEN).when(F.col("llms_status").isNull(), UNSEEN).when(F.col("llms_status") != 200, FOUND).otherwise(PASSED)
    return result(sites, "ACC-LLMS-TXT-ABSENT", gate, "low", "high", F.concat(F.lit("/llms.txt: "), F.coalesce(F.col("llms_status").cast("string"), F.lit("not asked"))))


def link_rot(probes: DataFrame) -> DataFrame:
    """ACC-LINK-ROT. probes: (site, url, status); a probe without an answer never counts."""
    dead = F.coalesce((F.col("status") >= 400) & (F.col("status") != 410), F.lit(False))
    site = probes.groupBy("site").agg(F.count_if(dead).alias("n"), F.count("status").alias("seen"), F.bool_or(dead & F.lower("url").rlike("pricing|plans|buy|contact")).alias("decisive"), _urls(dead).alias("pages"))
    gate = F.when(F.col("n") > 0, FOUND).when(F.col("seen") > 0, PASSED).otherwise(UNSEEN)
    return result(site, "ACC-LINK-ROT", gate, F.when((F.col("n") >= 3) | F.col("decisive"), "medium").otherwise("low"), "medium", F.format_string("%d dead links", "n"), F.col("pages"))


def fetch_latency(fetches: DataFrame) -> DataFrame:
    """ACC-FETCH-LATENCY. fetches: (site, status, timing_ms): the exact median of answers below 400, rounded down."""
    good = fetches.filter((F.col("status") < 400) & (F.col("timing_ms") > 0))
    found = good.groupBy("site").agg(F.floor(F.expr("percentile(timing_ms, 0.5)")).alias("median"), F.min("timing_ms").alias("least"), F.max("timing_ms").alias("most"), F.count(F.lit(1)).alias("n"))
    rows = fetches.select("site").distinct().join(found, "site", "left")
    gate = F.when(F.coalesce(F.col("n") < 3, F.lit(True)), UNSEEN).when(F.col("median") >= 2500, FOUND).otherwise(PASSED)
    severity = F.when(F.col("median") >= 5000, "high").otherwise("medium")
    return result(rows, "ACC-FETCH-LATENCY", gate, severity, "medium", F.format_string("median %d ms of %d", F.coalesce("median", F.lit(0)), F.coalesce("n", F.lit(0))))


# ---- read -----------------------------------------------------------------------------------------------------------


def key_fact_loss(pages: DataFrame) -> DataFrame:
    """REP-KEY-FACT-LOSS. pages: (site, url, noscript_js, words, raw_chars, title, empty_root, state_facts)."""
    signs = F.col("noscript_js").cast("int") + ((F.col("words") < 120) & (F.col("raw_chars") > 20_000)).cast("int") + F.lower(F.coalesce("title", F.lit(""))).isin("", "loading", "loading...").cast("int") + F.col("empty_root").cast("int")
    shell = (signs >= 2) & (F.col("state_facts") == 0)
    site = pages.groupBy("site").agg(F.count_if(shell).alias("n"), _urls(shell).alias("pages"))
    return result(site, "REP-KEY-FACT-LOSS", F.when(F.col("n") > 0, FOUND).otherwise(UNSEEN), "high", "medium", F.format_string("%d pages are shells", "n"), F.col("pages"))


def state_only(pages: DataFrame) -> DataFrame:
    """REP-STATE-ONLY-FACT, from the same pages as key_fact_loss()."""
    hit = (F.col("state_facts") > 0) & (F.col("words") < 250)
    site = pages.groupBy("site").agg(F.count_if(hit).alias("n"), _urls(hit).alias("pages"))
    return result(site, "REP-STATE-ONLY-FACT", F.when(F.col("n") > 0, FOUND).otherwise(PASSED), "medium", "medium", F.format_string("%d pages", "n"), F.col("pages"))


def metadata_contrast(pages: DataFrame, tokens) -> DataFrame:
    """REP-METADATA-CONTRAST. pages: (site, url, description, visible); tokens: fact tokens of a description."""
    lower = F.lower("visible")
    absent = F.size(F.filter(tokens(F.coalesce("description", F.lit(""))), lambda t: ~F.contains(lower, F.lower(t)))) > 0
    site = pages.groupBy("site").agg(F.count_if(absent).alias("n"), F.count("description").alias("described"), _urls(absent).alias("pages"))
    gate = F.when(F.col("n") >= 2, FOUND).when(F.col("described") == 0, UNSEEN).otherwise(PASSED)
    return result(site, "REP-METADATA-CONTRAST", gate, "medium", "medium", F.format_string("%d descriptions", "n"), F.col("pages"))


def non_text_lockin(pages: DataFrame) -> DataFrame:
    """REP-NON-TEXT-LOCKIN. pages: (site, url, images, empty_alts, media, state_facts, words)."""
    hit = ((F.col("empty_alts") >= 5) & (2 * F.col("empty_alts") >= F.col("images"))) | ((F.col("media") >= 3) & (F.col("state_facts") == 0))
    hit = hit & (F.col("words") < 300)
    site = pages.groupBy("site").agg(F.count_if(hit).alias("n"), F.min(F.when(hit, F.col("words"))).alias("words"), _urls(hit).alias("pages"))
    return result(site, "REP-NON-TEXT-LOCKIN", F.when(F.col("n") > 0, FOUND).otherwise(PASSED), F.when(F.col("words") < 80, "high").otherwise("medium"), F.when(F.col("words") < 100, "high").otherwise("low"), F.format_string("%d pages", "n"), F.col("pages"))


def table_semantics(pages: DataFrame) -> DataFrame:
    """REP-TABLE-SEMANTICS. pages: (site, url, grid_candidates, tables, page_class, prices, pricing_context)."""
    apt = F.col("page_class").isin("decision", "product") | (F.col("pricing_context") & (F.col("prices") >= 2))
    hit = (F.col("grid_candidates") >= 2) & (F.col("tables") == 0) & apt
    site = pages.groupBy("site").agg(F.count_if(hit).alias("n"), _urls(hit).alias("pages"))
    return result(site, "REP-TABLE-SEMANTICS", F.when(F.col("n") > 0, FOUND).otherwise(PASSED), "medium", "medium", F.format_string("%d pages", "n"), F.col("pages"))


def script_links(pages: DataFrame) -> DataFrame:
    """REP-LINKS-SCRIPT-ONLY. pages: (site, url, handler_paths, link_paths)."""
    only = F.size(F.array_except("handler_paths", "link_paths"))
    site = pages.groupBy("site").agg(F.count_if(only >= 5).alias("n"), _urls(only >= 5).alias("pages"))
    return result(site, "REP-LINKS-SCRIPT-ONLY", F.when(F.col("n") > 0, FOUND).otherwise(PASSED), "medium", "medium", F.format_string("%d pages", "n"), F.col("pages"))


def hidden_instances(html: Column) -> Column:
    """How many tags of a page hide text by style, but for those that serve screen readers."""
    tags = F.regexp_extract_all(html, F.lit(r"<[a-z][^>]*style=\"[^\"]*(?:display: ?none|visibility: ?hidden|font-size: ?0[;\"]|text-indent: ?-[0-9]{3,}|left: ?-[0-9]{3,})[^>]*>"), F.lit(0))
    return F.size(F.filter(tags, lambda t: ~t.rlike("sr-only|visually-hidden|screen-reader|aria-hidden")))


def hidden_text(pages: DataFrame) -> DataFrame:
    """REP-HIDDEN-TEXT-SUSPECT. pages: (site, url, hidden, words); hidden: of hidden_instances()."""
    hit = (F.col("hidden") >= 2) & (F.col("words") < 300)
    site = pages.groupBy("site").agg(F.count_if(hit).alias("n"), _urls(hit).alias("pages"))
    return result(site, "REP-HIDDEN-TEXT-SUSPECT", F.when(F.col("n") >= 2, FOUND).otherwise(PASSED), "medium", "medium", F.format_string("%d pages", "n"), F.col("pages"))


# ---- identify -------------------------------------------------------------------------------------------------------


def jsonld_nodes(blocks: DataFrame) -> DataFrame:
    """(site, url, ok, type, name, price) of the nodes of JSON-LD blocks (site, url, raw), @graph opened one level."""
    parsed = F.expr("try_parse_json(raw)")
    graph = F.expr("try_variant_get(v, '$.@graph', 'array<variant>')")
    rows = blocks.withColumn("v", parsed).withColumn("nodes", F.when(F.col("v").isNull(), F.lit(None)).otherwise(F.coalesce(graph, F.expr("try_variant_get(v, '$', 'array<variant>')"), F.array("v"))))
    rows = rows.select("site", "url", F.col("v").isNotNull().alias("ok"), F.explode_outer("nodes").alias("n"))
    kind = F.coalesce(F.expr("try_variant_get(n, '$.@type[0]', 'string')"), F.expr("try_variant_get(n, '$.@type', 'string')"))
    price = F.coalesce(F.expr("try_variant_get(n, '$.offers.price', 'string')"), F.expr("try_variant_get(n, '$.offers[0].price', 'string')"))
    return rows.select("site", "url", "ok", kind.alias("type"), F.expr("try_variant_get(n, '$.name', 'string')").alias("name"), price.alias("price"))


def jsonld_invalid(sites: DataFrame, nodes: DataFrame) -> DataFrame:
    """ENT-JSONLD-INVALID. sites: (site); nodes: of jsonld_nodes(), with path."""
    named = F.col("type").isin("Organization", "LocalBusiness", "Product", "Brand")
    bad = ~F.col("ok") | F.col("type").isNull() | (named & (F.coalesce("name", F.lit("")) == ""))
    valid = F.col("ok") & named & (F.coalesce("name", F.lit("")) != "")
    found = nodes.groupBy("site").agg(F.count_if(bad).alias("n"), F.bool_or(valid).alias("valid"), F.bool_or(~F.col("ok") & (F.col("path") == "/")).alias("home"), F.bool_or(~F.col("ok")).alias("broken"), _urls(bad).alias("pages"))
    rows = sites.join(found, "site", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    severity = F.when(F.col("home") | (F.col("broken") & ~F.col("valid")), "high").otherwise("medium")
    return result(rows, "ENT-JSONLD-INVALID", F.when(F.col("n") > 0, FOUND).otherwise(PASSED), severity, "high", F.format_string("%d invalid nodes", "n"), F.col("pages"))


def price_conflict(pages: DataFrame) -> DataFrame:
    """ENT-STRUCTURED-VISIBLE-CONFLICT on prices. pages: (site, url, schema_prices, visible_prices) as arrays of text."""
    one = lambda c: F.array_distinct(F.filter(F.transform(c, texts.first_number), lambda x: x.isNotNull()))
    schema, visible = one(F.col("schema_prices")), one(F.col("visible_prices"))
    hit = (F.size(schema) == 1) & (F.size(visible) == 1) & (F.get(schema, F.lit(0)) != F.get(visible, F.lit(0)))
    hit = F.coalesce(hit, F.lit(False))
    site = pages.groupBy("site").agg(F.count_if(hit).alias("n"), _urls(hit).alias("pages"))
    return result(site, "ENT-STRUCTURED-VISIBLE-CONFLICT", F.when(F.col("n") > 0, FOUND).otherwise(PASSED), "high", "high", F.format_string("%d pages", "n"), F.col("pages"))


def ambiguous_name(names: DataFrame) -> DataFrame:
    """ENT-AMBIGUOUS-NAME. names: (site, name): prepared for a judge; no name is not evaluated."""
    site = names.groupBy("site").agg(F.count("name").alias("n"), F.bool_or(texts.has_qualifier(F.col("name"))).alias("qualified"))
    return result(site, "ENT-AMBIGUOUS-NAME", F.when(F.col("n") == 0, UNSEEN).otherwise(PASSED), "low", "low", F.when(F.col("qualified"), "qualifier present").otherwise("no qualifier"))


def corroboration(presence: DataFrame) -> DataFrame:
    """ENT-CORROBORATION-ABSENT. presence: (site, ownership, http_status, brand_name_match); null status: timed out."""
    free = F.col("ownership") == "independent"
    good = F.coalesce(F.col("http_status").between(200, 399), F.lit(False))
    site = presence.groupBy("site").agg(
        F.count_if(free).alias("declared"),
        F.count_if(free & good & F.coalesce("brand_name_match", F.lit(False))).alias("matched"),
        F.count_if(free & good).alias("resolved"),
        F.count_if(free & F.col("http_status").isNull()).alias("timeouts"),
        F.count_if(free & (F.col("http_status") >= 400)).alias("errors"),
    )
    passed = (F.col("matched") > 0) | (F.col("resolved") > 0) | (F.col("timeouts") > 0)
    gate = F.when(passed, PASSED).when(F.col("errors") > 0, FOUND).otherwise(PASSED)
    return result(site, "ENT-CORROBORATION-ABSENT", gate, "medium", "high", F.format_string("%d of %d independent links fail", "errors", "declared"))


# ---- land, trust ----------------------------------------------------------------------------------------------------


def soft_404(probes: DataFrame) -> DataFrame:
    """REF-SOFT-404 and REF-404-DEAD-END. probes: (site, status, has_search, links, suggests) of a path that is no page."""
    soft = F.when(F.col("status").isNull(), UNSEEN).when(F.col("status") == 200, FOUND).otherwise(PASSED)
    helped = F.col("has_search") | (F.col("links") >= 3) | F.col("suggests")
    dead = F.when(F.coalesce(F.col("status") != 404, F.lit(True)), UNSEEN).when(~helped, FOUND).otherwise(PASSED)
    said = F.concat(F.lit("a missing page answers "), F.coalesce(F.col("status").cast("string"), F.lit("nothing")))
    return result(probes, "REF-SOFT-404", soft, "high", "high", said).unionByName(result(probes, "REF-404-DEAD-END", dead, "medium", "high", said))


def path_drop(variants: DataFrame) -> DataFrame:
    """REF-PATH-DROP-REDIRECT. variants: (site, variant, path_preserved, variant_ok); null: not observed."""
    unread = F.col("path_preserved").isNull() | F.col("variant_ok").eqNullSafe(F.lit(False))
    lost = F.coalesce(~F.col("path_preserved"), F.lit(False))
    site = variants.groupBy("site").agg(F.count_if(lost).alias("lost"), F.count_if(~unread).alias("read"), F.array_join(F.array_sort(F.collect_set(F.when(unread & ~lost, F.col("variant")))), ", ").alias("unread"))
    gate = F.when(F.col("lost") > 0, FOUND).when(F.col("read") == 0, UNSEEN).otherwise(PASSED)
    return result(site, "REF-PATH-DROP-REDIRECT", gate, "high", "high", F.concat(F.lit("not read: "), F.col("unread")))


def viewport_absent(pages: DataFrame) -> DataFrame:
    """REF-VIEWPORT-ABSENT. pages: (site, url, has_viewport); null: the page had no body."""
    absent = F.coalesce(~F.col("has_viewport"), F.lit(False))
    site = pages.groupBy("site").agg(F.count_if(absent).alias("n"), F.count("has_viewport").alias("seen"), _urls(absent).alias("pages"))
    gate = F.when(F.col("seen") == 0, UNSEEN).when(F.col("n") > 0, FOUND).otherwise(PASSED)
    return result(site, "REF-VIEWPORT-ABSENT", gate, F.when(F.col("n") == F.col("seen"), "medium").otherwise("low"), "high", F.format_string("%d of %d pages", "n", "seen"), F.col("pages"))


def overlay_block(pages: DataFrame) -> DataFrame:
    """REF-OVERLAY-BLOCK. pages: (site, url, overlay): true or not observed."""
    hit = F.coalesce("overlay", F.lit(False))
    site = pages.groupBy("site").agg(F.count_if(hit).alias("n"), F.count("overlay").alias("seen"), _urls(hit).alias("pages"))
    gate = F.when(F.col("n") > 0, FOUND).when(F.col("seen") > 0, PASSED).otherwise(UNSEEN)
    return result(site, "REF-OVERLAY-BLOCK", gate, "medium", "medium", F.format_string("%d pages", "n"), F.col("pages"))


def collapsed_answers(pages: DataFrame) -> DataFrame:
    """(site, collapsed, images_unsized, render_blocking): the measures of REF-COLLAPSED-ANSWER and REF-PERF-RISK."""
    return pages.groupBy("site").agg(F.sum(F.greatest(F.lit(0), F.col("details") - F.col("details_open"))).alias("collapsed"), F.sum("images_unsized").alias("images_unsized"), F.max("render_blocking").alias("render_blocking"))


def lastmod_uniform(entries: DataFrame) -> DataFrame:
    """FRS-LASTMOD-UNIFORM. entries: (site, url, lastmod)."""
    site = entries.groupBy("site").agg(F.count(F.lit(1)).alias("all"), F.count("lastmod").alias("present"), F.count_distinct("lastmod").alias("distinct"))
    gate = F.when(F.col("present") == 0, UNSEEN).when(F.col("distinct") <= 1, FOUND).otherwise(PASSED)
    return result(site, "FRS-LASTMOD-UNIFORM", gate, "low", "medium", F.format_string("%d dates over %d entries", "distinct", "all"))


def impossible_dates(dates: DataFrame, audited: str) -> DataFrame:
    """FRS-IMPOSSIBLE-DATE. dates: (site, url, value): an ISO date that does not exist or lies after the audit."""
    day = F.expr("try_cast(substring(value, 1, 10) as date)")
    bad = F.col("value").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}") & (day.isNull() | (day > F.lit(audited).cast("date")))
    site = dates.groupBy("site").agg(F.count_if(bad).alias("n"), _urls(bad).alias("pages"))
    return result(site, "FRS-IMPOSSIBLE-DATE", F.when(F.col("n") > 0, FOUND).otherwise(PASSED), "medium", "high", F.format_string("%d dates", "n"), F.col("pages"))

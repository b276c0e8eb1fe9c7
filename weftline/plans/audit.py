"""One audit: from fetched pages, and what else was observed of their sites, to check results and a numbered report."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import checks, crawl, excerpts, names, robots, runs
from ..sources import pages as sources
from ..sources.scratch import written
from . import audit_queries, report
from .audit_queries import query
from .catalog import CATALOG, SURFACES

NAMED = ("Organization", "LocalBusiness", "Corporation", "Brand", "WebSite")  # types whose name is the site's
SAID_BY = ("FRS-CLAIM-CONFLICT", "FRS-DATE-CONFLICT", "ENT-NAME-INCONSISTENT")  # checks that only prepare a judgment


@dataclass
class Observed:
    """What was observed of sites beside their pages; what is None was not, and its checks are not evaluated.

    Columns are those that the checks of operators.checks ask for: robots_files (site, body), robots_fetches (site, status,
    attempt), listed (site, path), sitemaps (site, declared, status, parse_ok), entries (site, url, lastmod), fetches (site,
    url, status, timing_ms, redirect_chain), link_probes (site, url, status), bot_probes (site, token, path, status,
    browser_status), soft_probes (site, status, has_search, links, suggests), variants (site, variant, path_preserved,
    variant_ok), presence (site, ownership, http_status, brand_name_match), heads (site, url, path, page_class, robots_meta,
    x_robots_tag), noindex (site, path, noindex), canonicals (site, url, canonical, redirected), alternates (site, url,
    path, lang, alternates), docs_sites (site, site_type, llms_status)."""

    robots_files: DataFrame | None = None
    robots_fetches: DataFrame | None = None
    listed: DataFrame | None = None
    sitemaps: DataFrame | None = None
    entries: DataFrame | None = None
    fetches: DataFrame | None = None
    link_probes: DataFrame | None = None
    bot_probes: DataFrame | None = None
    soft_probes: DataFrame | None = None
    variants: DataFrame | None = None
    presence: DataFrame | None = None
    heads: DataFrame | None = None
    noindex: DataFrame | None = None
    canonicals: DataFrame | None = None
    alternates: DataFrame | None = None
    docs_sites: DataFrame | None = None


def robots_decisions(files: DataFrame, paths: DataFrame, tokens: DataFrame) -> DataFrame:
    """(site, token, path, rule, blocked, named) of paths under robots files; named: a group names the token."""
    rules = robots.parse(files)
    named = rules.select("site", "token").distinct().withColumn("named", F.lit(True))
    decided = robots.decide(paths, robots.effective(rules, tokens)).join(named, ["site", "token"], "left")
    return decided.withColumn("named", F.coalesce("named", F.lit(False)))


def late_content(blocks: DataFrame) -> DataFrame:
    """REP-EXTRACTION-LOSS as a check result."""
    rows = crawl.extraction_loss(blocks)
    evidence = F.format_string("%d pages begin with shared text", "sharers")
    return checks.result(rows, "REP-EXTRACTION-LOSS", F.col("gate"), "medium", "medium", evidence)


def boilerplate(blocks: DataFrame) -> DataFrame:
    """ANS-BOILERPLATE-DROWNING, which goes by the same measure as REP-EXTRACTION-LOSS (crawl.extraction_loss): pages begin with
    text that they share, at such length that it fills what is read of them first."""
    rows = crawl.extraction_loss(blocks)
    return checks.result(rows, "ANS-BOILERPLATE-DROWNING", F.col("gate"), "medium", "medium", F.format_string("%d pages share their beginning", "sharers"))


def facts(pages: DataFrame) -> DataFrame:
    """What measured() and the claims of pages give, written: all that is read of them by parsing, so they are parsed once."""
    return written(audit_queries.measured(pages, claimed=True), "facts")


def prepared(parsed: DataFrame) -> DataFrame:
    """FRS-CLAIM-CONFLICT and FRS-DATE-CONFLICT, from facts(): what a judgment starts from. The gate passes; evidence has the
    counts."""
    claims = parsed.select("site", "page_id", F.inline("claims"))
    sizes = parsed.groupBy("site").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("dates") > 0).alias("structured"))
    shown = claims.filter("type = 'date'").groupBy("site").agg(F.countDistinct("page_id").alias("visible"))
    groups = runs.conflicts(claims, "site", "page_id").groupBy("site").agg(F.count(F.lit(1)).alias("groups"))
    rows = sizes.join(shown, "site", "left").join(groups, "site", "left").fillna(0, ["visible", "groups"])
    dates = F.format_string("%d of %d pages have structured dates, %d visible ones", "structured", "pages", "visible")
    conflicts = F.format_string("%d types of claims differ between %d pages", "groups", "pages")
    passed = F.lit(checks.PASSED)
    both = [checks.result(rows, "FRS-DATE-CONFLICT", passed, "low", "low", dates), checks.result(rows, "FRS-CLAIM-CONFLICT", passed, "low", "low", conflicts)]
    return both[0].unionByName(both[1])


def named(pages: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """ENT-NAME-INCONSISTENT of every site, and ENT-STRUCTURED-VISIBLE-CONFLICT of those whose JSON-LD has another name; parsed:
    facts() of the pages, if they are there."""
    blocks = (facts(pages) if parsed is None else parsed).select("site", "url", F.explode("jsonld").alias("b")).select("site", "url", F.col("b.raw").alias("raw"))
    nodes = checks.jsonld_nodes(blocks).filter(F.col("type").isin(*NAMED) & (F.coalesce("name", F.lit("")) != ""))
    schema = nodes.withColumn("nth", F.row_number().over(Window.partitionBy("site", "url").orderBy("name"))).select("site", "url", "nth", "name")
    found = written(names.site_names(pages, excerpts.footer_name(F.col("html")), schema), "site_names")
    groups = names.variants(found)
    other = names.schema_conflict(found, groups)
    evidence = F.concat(F.lit("JSON-LD says "), "schema_name", F.lit(", the page "), "visible_name")
    conflict = checks.result(other, "ENT-STRUCTURED-VISIBLE-CONFLICT", F.lit(checks.FOUND), "high", "high", evidence)
    return names.inconsistent(pages, groups).unionByName(conflict)


def audit(pages: DataFrame, seen: Observed | None = None) -> DataFrame:
    """Results (site, check_id, gate, severity, confidence, evidence, urls, evidence_quality) of every check that pages
    (page_id, site, url, path, html) and what was seen of their sites allow. Sites are handled at once."""
    seen = seen or Observed()
    spark = pages.sparkSession
    blocks = sources.blocks(pages)
    parsed = facts(pages)
    results = [audit_queries.checks_of(parsed.drop("claims", "dates")), late_content(blocks), boilerplate(blocks), prepared(parsed), named(pages, parsed)]
    if seen.robots_files is not None:
        important = pages.select("site", urls.norm_path(F.col("path")).alias("path")).filter(crawl.page_class(F.col("path")).isin(*crawl.IMPORTANT)).distinct()
        searching = SURFACES.df(spark).filter("role = 'search-index'")
        results.append(checks.robots_role(robots_decisions(seen.robots_files, important, searching), searching))
    if seen.listed is not None:
        results.append(checks.sitemap_orphan(seen.listed, sources.links(pages)))
    if seen.heads is not None and seen.noindex is not None:
        results.append(checks.index_control(seen.heads, seen.noindex))
    alone = {
        "robots_fetches": [checks.robots_unavailable], "sitemaps": [checks.sitemap_invalid], "entries": [checks.lastmod_uniform], "fetches": [checks.redirect_loop, checks.fetch_latency],
        "link_probes": [checks.link_rot], "bot_probes": [checks.bot_challenge], "soft_probes": [checks.soft_404], "variants": [checks.path_drop], "presence": [checks.corroboration],
        "heads": [checks.noarchive], "canonicals": [checks.canonical_conflict], "alternates": [checks.hreflang], "docs_sites": [checks.llms_txt],
    }
    for name, functions in alone.items():
        rows = getattr(seen, name)
        results += [check(rows) for check in functions] if rows is not None else []
    all_ = reduce(DataFrame.unionByName, [r.select(*checks.RESULT) for r in results])
    quality = F.broadcast(CATALOG.df(spark).select("check_id", "evidence_quality"))
    return all_.join(quality, "check_id", "left").select(*checks.RESULT, "evidence_quality")


@dataclass
class Report:
    """The tables of a report, over all sites."""

    findings: DataFrame
    verify: DataFrame
    not_evaluated: DataFrame
    summary: DataFrame
    warnings: DataFrame
    text: DataFrame
    results: DataFrame | None = None  # what is persisted for the tables

    def release(self) -> None:
        """Give back what is persisted; the tables may be read after it, at the cost of the audit."""
        if self.results is not None:
            self.results.unpersist()

    def written(self, folder: str) -> None:
        """Each table as JSON lines in a folder of its name. Counts that do not agree with the findings are an error, and nothing
        is written."""
        wrong = report.invariants(self.findings, self.summary).limit(5).collect()
        if wrong:
            raise ValueError("; ".join(f"{r['site']}: {r['problem']}" for r in wrong))
        for f in fields(self)[:-1]:
            getattr(self, f.name).write.mode("overwrite").json(f"{folder}/{f.name}")


def numbered(rows: DataFrame) -> DataFrame:
    """(site, id, check_id, evidence): what needs a look, V-001 and so on within a site."""
    order = Window.partitionBy("site").orderBy("check_id", "evidence")  # a few rows for each site: one a check at most
    return rows.select("site", F.format_string("V-%03d", F.row_number().over(order)).alias("id"), "check_id", "evidence")


def report_of(results: DataFrame, sites: DataFrame) -> Report:
    """The report of results; sites (site) are all that were audited, also those without results.

    The results, a row for each check of a site, are persisted until release(), as all tables of the report read them."""
    catalog = CATALOG.df(results.sparkSession)
    results = results.persist()
    routed = report.route(results, catalog)
    found = report.findings(routed)
    counts = report.summary(routed, found)
    open_ = report.not_evaluated(routed, catalog, sites)
    # A report is partial where a check was not evaluated; counts of findings and of routes must agree with the tables.
    partial = open_.groupBy("site").agg(F.count(F.lit(1)).alias("open"))
    counts = sites.select("site").distinct().join(counts, "site", "left").join(partial, "site", "left").fillna(0)
    counts = counts.withColumn("partial", F.col("open") > 0)
    warnings = report.out_of_band(found, catalog).select("site", "id", F.lit("severity out of band").alias("warning")).unionByName(report.forbidden(found).select("site", "id", F.lit("forbidden claim").alias("warning")))
    return Report(found, numbered(routed.filter("route = 'verify'")), open_, counts, warnings, report.markdown(found), results)


def audited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Results and sites of the page table; what the table does not hold was not observed."""
    pages = sources.read_pages(spark, sf_dir)
    return audit(pages, Observed(listed=pages.select("site", "path"))), pages.select("site").distinct()


@query("site_audit_results")
def site_audit_results(spark, sf_dir):
    return audited(spark, sf_dir)[0].select("site", "check_id", "gate", "severity", "confidence", "evidence")


@query("site_audit_findings")
def site_audit_findings(spark, sf_dir):
    return report_of(*audited(spark, sf_dir)).findings


@query("site_audit_not_evaluated")
def site_audit_not_evaluated(spark, sf_dir):
    return report_of(*audited(spark, sf_dir)).not_evaluated


@query("site_audit_summary")
def site_audit_summary(spark, sf_dir):
    return report_of(*audited(spark, sf_dir)).summary

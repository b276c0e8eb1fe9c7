"""Queries for fetch policies, excerpts, passages, footers, and constraints, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import claims as claim_functions
from ..functions import texts, urls
from ..operators import excerpts
from ..sources import pages as sources
from . import audit, budget_queries, fragment_queries, index_queries, report_queries, schema_queries, source_queries  # noqa: F401  (they register their queries)
from .audit_queries import ORACLES, QUERIES, query
from .observed import ASKED, BLOCKS, FETCHES, PASSAGES, PRESENCE, RESULTS, RUNS, TEXTS
from .site_queries import BL, LK, LP, PG

__all__ = ["ORACLES", "QUERIES"]


@query("fetch_policy", """SELECT url, CASE WHEN status IS NULL OR status >= 400 THEN CASE WHEN len(chain) >= 3 THEN 'blank' ELSE 'dropped' END WHEN contains(lower(content_type), 'html') OR contains(lower(content_type), 'xml') THEN 'parsed' ELSE 'blank' END AS policy FROM fetches""", FETCHES)
def _(spark, sf_dir):
    failed = F.coalesce(F.col("status") >= 400, F.lit(True))
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    policy = F.when(failed & (F.size("chain") >= 3), "blank").when(failed, "dropped").when(kind.contains("html") | kind.contains("xml"), "parsed").otherwise("blank")
    return FETCHES.df(spark, sf_dir).select("url", policy.alias("policy"))


@query("link_rot_candidates", f"""WITH {PG}, {LK}, {LP}, c AS (SELECT site, target, min(page_id) AS p FROM lp WHERE (tsite = site OR ends_with(tsite, '.' || site)) AND regexp_matches(target, '^https?:') AND target NOT IN (SELECT url FROM pages) GROUP BY ALL)
    SELECT site, target FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY p, target) AS nth FROM c) WHERE nth <= 5""")
def _(spark, sf_dir):
    from pyspark.sql import Window

    pages = sources.read_pages(spark, sf_dir)
    host = urls.authority(F.col("target"))
    own = sources.links(pages).filter(((host == F.col("site")) | host.endswith(F.concat(F.lit("."), F.col("site")))) & F.col("target").rlike("^https?:"))
    own = own.join(pages.select(F.col("url").alias("target")), "target", "left_anti").groupBy("site", "target").agg(F.min("page_id").alias("p"))
    nth = F.row_number().over(Window.partitionBy("site").orderBy("p", "target"))
    return own.withColumn("nth", nth).filter("nth <= 5").select("site", "target")


@query("title_segments", r"""SELECT page_id, array_to_string(list_filter(list_transform(string_split_regex(regexp_extract(html, '<title>([^<]*)</title>', 1), '\s+[|–—:·-]\s+'), lambda s: trim(s)), lambda s: s <> ''), '|') AS segments FROM pages""")
def _(spark, sf_dir):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.array_join(texts.title_segments(title), "|").alias("segments"))


@query("footer_names", r"""SELECT page_id, nullif(trim(regexp_replace(regexp_replace(regexp_extract_all(html, '(?:©|&copy;|\(c\)) *((?:[0-9]{4}(?:[-–][0-9]{4})? *)?[^<&|]*)', 1)[-1], '^[0-9]{4}(?:[-–][0-9]{4})? *', ''), '(?i)[ .,]*(?:all rights reserved|privacy|terms).*$', '')), '') AS name FROM pages""")
def _(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", excerpts.footer_name(F.col("html")).alias("name"))


@query("first_numbers", r"SELECT id, try_cast(replace(nullif(regexp_extract(t, '([0-9][0-9,]*(?:\.[0-9]+)?)', 1), ''), ',', '') AS DOUBLE) AS n FROM prices", TEXTS["prices"])
def _(spark, sf_dir):
    return TEXTS["prices"].df(spark, sf_dir).select("id", texts.first_number(F.col("t")).alias("n"))


_FOLDED = texts.FOLDED.replace("'", "''")  # a quote in SQL


@query("folded_confusables", rf"SELECT id, trim(regexp_replace(translate(t, '{texts.CONFUSABLE}', '{_FOLDED}'), '[ \t\n\r\x0B\f\x{{A0}}]+', ' ', 'g')) AS folded FROM confused", TEXTS["confused"])
def _(spark, sf_dir):
    return TEXTS["confused"].df(spark, sf_dir).select("id", texts.fold_confusables(F.col("t")).alias("folded"))


_FACT = r"[$€£₹] ?[0-9][0-9,.]*|[0-9]+(?:\.[0-9]+)?%|[vV][0-9]+\.[0-9]+|(?:Free|Basic|Starter|Pro|Premium|Enterprise) [Pp]lan"


@query("fact_tokens", f"SELECT id, len(regexp_extract_all(t, '{_FACT}')) > 0 AS has_tokens, len(list_distinct(regexp_extract_all(t, '{_FACT}'))) AS n FROM worded_facts", TEXTS["worded_facts"])
def _(spark, sf_dir):
    tokens = claim_functions.fact_tokens(F.col("t"))
    return TEXTS["worded_facts"].df(spark, sf_dir).select("id", (F.size(tokens) > 0).alias("has_tokens"), F.size(tokens).cast("long").alias("n"))


@query("presence_counts", "SELECT ownership, count(*) AS links, count(*) FILTER (WHERE http_status BETWEEN 200 AND 399) AS resolved, count(*) FILTER (WHERE http_status >= 400) AS failed, count(*) FILTER (WHERE http_status IS NULL) AS unanswered FROM presence GROUP BY 1", PRESENCE)
def _(spark, sf_dir):
    s = F.col("http_status")
    return PRESENCE.df(spark, sf_dir).groupBy("ownership").agg(F.count(F.lit(1)).alias("links"), F.count_if(s.between(200, 399)).alias("resolved"), F.count_if(s >= 400).alias("failed"), F.count_if(s.isNull()).alias("unanswered"))


@query("boilerplate_share", f"""WITH {PG}, {BL}, n AS (SELECT site, line, count(DISTINCT page_id) AS pages FROM bl GROUP BY ALL) SELECT page_id, sum(length(line))::BIGINT AS chars, sum(CASE WHEN pages > 1 THEN length(line) ELSE 0 END)::BIGINT AS shared FROM bl JOIN n USING (site, line) GROUP BY 1""")
def _(spark, sf_dir):
    from ..operators.runs import repeated_runs

    b = sources.blocks(sources.read_pages(spark, sf_dir))
    rows = b.join(repeated_runs(b), ["site", "line"])
    return rows.groupBy("page_id").agg(F.sum(F.length("line")).alias("chars"), F.sum(F.when(F.col("pages") > 1, F.length("line")).otherwise(0)).alias("shared"))


@query("shared_prefixes", f"""WITH {PG}, {BL}, t AS (SELECT site, page_id, string_agg(line, chr(10) ORDER BY ord) AS text FROM bl GROUP BY ALL), s AS (SELECT site, page_id, text, unnest(generate_series(50, greatest(50, length(text) // 50 * 50), 50)) AS len FROM t WHERE length(text) >= 50),
    c AS (SELECT site, len, substring(text, 1, len) AS p, count(DISTINCT page_id) AS pages FROM s GROUP BY ALL), z AS (SELECT site, count(*) AS n FROM t GROUP BY 1) SELECT site, max(len)::INTEGER AS length FROM c JOIN z USING (site) WHERE 2 * pages >= n AND pages >= 2 AND len >= 50 GROUP BY 1""")
def _(spark, sf_dir):
    b = sources.blocks(sources.read_pages(spark, sf_dir))
    joined = b.groupBy("site", "page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return excerpts.shared_prefix(joined, 50)


@query("built_passages")
def _(spark, sf_dir):
    """Passages around anchors of the pages. No SQL: a test holds them to a plain version."""
    return excerpts.build_passages(ASKED.df(spark, sf_dir), BLOCKS.df(spark, sf_dir))


@query("first_windows", """+t AS (SELECT page_id, string_agg(line, chr(10) ORDER BY ord) AS text FROM blocks GROUP BY 1) SELECT question_id, CASE WHEN contains(text, passage) THEN (strpos(text, passage) - 1)::INTEGER END AS "offset", CASE WHEN contains(text, passage) THEN (strpos(text, passage) <= 600)::INTEGER END AS in_window FROM passages JOIN t USING (page_id)""", BLOCKS, PASSAGES)
def _(spark, sf_dir):
    return excerpts.first_window(PASSAGES.df(spark, sf_dir), BLOCKS.df(spark, sf_dir)).withColumn("in_window", F.col("in_window").cast("int"))


@query(
    "probe_log_violations",
    """+p AS (SELECT run, count(*) AS n, count(*) FILTER (WHERE kind = 'navigational') AS nav, count(DISTINCT question_id) AS ids, count(*) FILTER (WHERE outcome NOT IN ('cited', 'mentioned', 'absent', 'third-party', 'wrong-entity', 'wrong-fact', 'error')) AS odd,
    count(*) FILTER (WHERE NOT regexp_matches(timestamp, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:]{8}Z$')) AS late FROM probe_runs GROUP BY run)
    SELECT run, unnest(list_filter([CASE WHEN n > 6 THEN 'too many rows' END, CASE WHEN nav > 1 THEN 'several navigational' END, CASE WHEN ids < n THEN 'repeated question' END, CASE WHEN odd > 0 THEN 'unknown outcome' END, CASE WHEN late > 0 THEN 'time not in UTC' END], lambda x: x IS NOT NULL)) AS problem FROM p""",
    RUNS,
)
def _(spark, sf_dir):
    return excerpts.probe_violations(RUNS.df(spark, sf_dir))


@query("safe_fixes", "+n AS (SELECT *, row_number() OVER (PARTITION BY site, check_id ORDER BY coalesce(evidence, '')) AS nth FROM results) SELECT site, check_id, gate, CASE WHEN gate = 'finding' THEN urls ELSE [] END AS urls FROM n WHERE nth = 1", RESULTS)
def _(spark, sf_dir):
    rows = RESULTS.df(spark, sf_dir).withColumn("o", F.coalesce("evidence", F.lit("")))
    return excerpts.safe_fixes(rows, "o").select("site", "check_id", "gate", "urls")


@query("row_violations", """SELECT site, check_id, p AS problem FROM (SELECT site, check_id, unnest(list_filter([CASE WHEN gate NOT IN ('finding', 'pass', 'not_evaluated') THEN 'gate' END, CASE WHEN gate = 'finding' AND severity IS NULL THEN 'severity' END, CASE WHEN evidence IS NULL THEN 'evidence' END, CASE WHEN NOT regexp_matches(check_id, '^(ACC|REP|ANS|ENT|FRS|OFF|REF)-[A-Z0-9-]+$') THEN 'check_id' END], lambda x: x IS NOT NULL)) AS p FROM results)""", RESULTS)
def _(spark, sf_dir):
    """Constraints on results, a row for each broken one."""
    tests = (
        (~F.col("gate").isin("finding", "pass", "not_evaluated"), "gate"), ((F.col("gate") == "finding") & F.col("severity").isNull(), "severity"),
        (F.col("evidence").isNull(), "evidence"), (~F.col("check_id").rlike("^(ACC|REP|ANS|ENT|FRS|OFF|REF)-[A-Z0-9-]+$"), "check_id"),
    )
    found = F.filter(F.array(*[F.when(test, F.lit(name)) for test, name in tests]), lambda x: x.isNotNull())
    return RESULTS.df(spark, sf_dir).select("site", "check_id", F.explode(found).alias("problem"))

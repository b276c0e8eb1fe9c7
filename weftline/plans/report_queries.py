"""Queries of the report's lints, invariants and text, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import report
from .audit_queries import _FOUND, _ROUTED, query, routed
from .catalog import CATALOG
from .observed import RESULTS

_OPEN = """op AS (SELECT DISTINCT site, check_id FROM ro WHERE route = 'not_evaluated' AND (site, check_id) NOT IN (SELECT site, check_id FROM ro WHERE route IN ('finding', 'verify', 'passed'))
  UNION ALL SELECT s.site, c.check_id FROM (SELECT DISTINCT site FROM results) s, catalog c WHERE (s.site, c.check_id) NOT IN (SELECT site, check_id FROM ro WHERE route <> 'unknown'))"""
_CITED = f"""ci AS (SELECT site, id, check_id, cited FROM (SELECT site, id, check_id, unnest(list_distinct(regexp_extract_all(coalesce(evidence, ''), '{report.CITED}'))) AS cited FROM fi)
  WHERE cited <> check_id AND cited NOT IN (SELECT check_id FROM catalog))"""


def _lints(found, catalog):
    cited = report.citations(found, catalog).select("site", "id", F.concat(F.lit("no check is named "), "cited").alias("warning"))
    bands = report.out_of_band(found, catalog).select("site", "id", F.lit("severity out of band").alias("warning"))
    return cited.unionByName(bands).unionByName(report.forbidden(found).select("site", "id", F.lit("forbidden claim").alias("warning")))


@query("report_citations", f"+{_ROUTED}, {_FOUND}, {_CITED} SELECT site, id, check_id, cited FROM ci", RESULTS, CATALOG)
def report_citations(spark, sf_dir):
    return report.citations(report.findings(routed(spark, sf_dir)), CATALOG.df(spark))


@query(
    "report_invariants",
    f"""+{_ROUTED}, {_FOUND}, m AS (SELECT site, CASE WHEN count(*) > 2 THEN 1 ELSE 0 END AS off, count(*) FILTER (WHERE severity = 'high') AS high FROM fi GROUP BY site)
    SELECT site, 'high findings miscounted' AS problem FROM m WHERE off = 1""",
    RESULTS,
    CATALOG,
)
def report_invariants(spark, sf_dir):
    """Summaries that are one off for sites with more than two findings, as the invariants see them; true ones give no rows."""
    r = routed(spark, sf_dir)
    found = report.findings(r)
    many = found.groupBy("site").agg((F.count(F.lit(1)) > 2).alias("many"))
    counts = report.summary(r, found).join(many, "site", "left")
    off = counts.withColumn("high", F.when(F.col("many"), F.col("high") + 1).otherwise(F.col("high"))).drop("many")
    return report.invariants(found, off).unionByName(report.invariants(found, counts.drop("many")))


@query(
    "report_sections",
    f"""+{_ROUTED}, {_FOUND}, {_OPEN}, {_CITED}, wa AS (SELECT site, id, 'no check is named ' || cited AS warning FROM ci UNION ALL SELECT site, id, 'severity out of band' FROM fi JOIN catalog USING (check_id) WHERE NOT list_contains(string_split(band, ' '), severity)
      UNION ALL SELECT site, id, 'forbidden claim' FROM fi WHERE regexp_matches(evidence, '{report.FORBIDDEN}')),
    s1 AS (SELECT site, count(*) AS n, string_agg('- **' || id || '** (' || severity || ', ' || confidence || ') ' || check_id || ': ' || coalesce(evidence, '') || CASE WHEN urls <> '' THEN chr(10) || '  ' || urls ELSE '' END, chr(10) ORDER BY regexp_extract(id, '([0-9]+)$', 1)::BIGINT) AS t FROM fi GROUP BY site),
    s2 AS (SELECT site, count(*) AS n, string_agg('- ' || check_id, chr(10) ORDER BY check_id) AS t FROM (SELECT DISTINCT site, check_id FROM ro WHERE route = 'passed') GROUP BY site),
    s3 AS (SELECT site, count(*) AS n, string_agg('- ' || check_id || ': ' || coalesce(evidence, ''), chr(10) ORDER BY check_id, coalesce(evidence, '')) AS t FROM ro WHERE route = 'verify' GROUP BY site),
    s4 AS (SELECT site, count(*) AS n, string_agg('- ' || check_id, chr(10) ORDER BY check_id) AS t FROM op GROUP BY site),
    s5 AS (SELECT site, string_agg('- ' || id || ': ' || warning, chr(10) ORDER BY id, warning) AS t FROM wa GROUP BY site)
    SELECT site, concat_ws(chr(10) || chr(10), '# ' || site || chr(10) || coalesce(s1.n, 0) || ' findings, ' || coalesce(s2.n, 0) || ' passed, ' || coalesce(s3.n, 0) || ' to verify, ' || coalesce(s4.n, 0) || ' not evaluated',
      '## Findings' || chr(10) || s1.t, '## Passed' || chr(10) || s2.t, '## To verify' || chr(10) || s3.t, '## Not evaluated' || chr(10) || s4.t, '## Warnings' || chr(10) || s5.t) AS report
    FROM (SELECT DISTINCT site FROM results) LEFT JOIN s1 USING (site) LEFT JOIN s2 USING (site) LEFT JOIN s3 USING (site) LEFT JOIN s4 USING (site) LEFT JOIN s5 USING (site)""",
    RESULTS,
    CATALOG,
)
def report_sections(spark, sf_dir):
    results, catalog = RESULTS.df(spark, sf_dir), CATALOG.df(spark)
    r = report.route(results, catalog)
    found = report.findings(r)
    sites = results.select("site").distinct()
    return report.sections(found, r, report.not_evaluated(r, catalog, sites), _lints(found, catalog), sites)

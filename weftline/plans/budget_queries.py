"""Queries of what the budgets of a site hold, with their SQL twins, which fold a site's rows one after another."""

from __future__ import annotations

from ..operators import budgets, excerpts
from ..sources import pages as sources
from .audit_queries import query
from .site_queries import BL, CL, PG, document_claims

#: Rows (site, n, page_id, ord, chars) in the table `queue`, and (site, consumer, most, spent) in `given`.
FOLD = """fold AS (
  SELECT site, consumer, most, 0::BIGINT AS n, spent::BIGINT AS used, NULL::BIGINT AS ended, NULL::BIGINT AS page_id, NULL::BIGINT AS ord, NULL::BIGINT AS chars, FALSE AS taken FROM given
  UNION ALL
  SELECT f.site, consumer, most, q.n, CASE WHEN ended IS DISTINCT FROM q.page_id AND used + q.chars <= most THEN used + q.chars ELSE used END,
         CASE WHEN ended IS DISTINCT FROM q.page_id AND used + q.chars <= most THEN ended ELSE q.page_id END, q.page_id, q.ord, q.chars,
         ended IS DISTINCT FROM q.page_id AND used + q.chars <= most
  FROM fold f JOIN queue q ON q.site = f.site AND q.n = f.n + 1
)"""


@query(
    "budgeted_excerpts",
    f"""WITH RECURSIVE {PG}, {BL}, queue AS MATERIALIZED (SELECT site, page_id, ord, least(length(line), {excerpts.EXCERPT})::BIGINT AS chars, row_number() OVER (PARTITION BY site ORDER BY page_id, ord) AS n FROM bl),
    given AS (SELECT site, consumer, most, 0 AS spent FROM (SELECT DISTINCT site FROM queue), (VALUES {', '.join(map(str, excerpts.BUDGETS))}) b(consumer, most)),
    {FOLD} SELECT site, page_id, ord, chars, consumer FROM fold WHERE taken""",
)
def budgeted_excerpts(spark, sf_dir):
    """What each consumer gets of each site's blocks."""
    b = sources.blocks(sources.read_pages(spark, sf_dir)).withColumnRenamed("line", "text")
    return excerpts.within_budgets(b, excerpts.BUDGETS)


@query(
    "cited_runs",
    f"""WITH RECURSIVE {PG}, {BL}, once AS MATERIALIZED (SELECT site, page_id, line, length(line)::BIGINT AS chars, min(ord) AS ord FROM bl WHERE length(line) BETWEEN {budgets.LEAST_RUN} AND {budgets.MOST_RUN} GROUP BY ALL),
    carried AS MATERIALIZED (SELECT site, line, chars, count(*) AS pages, min((page_id, ord)) AS example FROM once GROUP BY ALL),
    several AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY site ORDER BY pages DESC, chars DESC, example) AS n FROM carried WHERE pages > 1),
    hoist AS (
      SELECT site, 0::BIGINT AS n, 0::BIGINT AS spent, 0 AS rank, FALSE AS taken FROM (SELECT DISTINCT site FROM once)
      UNION ALL
      SELECT h.site, s.n, CASE WHEN rank < {budgets.MOST_SHARED} AND spent + chars <= {budgets.RUN_BUDGET // 3} THEN spent + chars ELSE spent END,
             CASE WHEN rank < {budgets.MOST_SHARED} AND spent + chars <= {budgets.RUN_BUDGET // 3} THEN rank + 1 ELSE rank END, rank < {budgets.MOST_SHARED} AND spent + chars <= {budgets.RUN_BUDGET // 3}
      FROM hoist h JOIN several s ON s.site = h.site AND s.n = h.n + 1
    ), shared AS MATERIALIZED (SELECT s.*, h.rank FROM hoist h JOIN several s USING (site, n) WHERE h.taken),
    own AS MATERIALIZED (SELECT * FROM (SELECT o.*, c.pages, row_number() OVER (PARTITION BY o.site, page_id ORDER BY c.pages, o.chars DESC, ord) AS rank
      FROM once o JOIN carried c USING (site, line) LEFT JOIN shared s ON s.site = o.site AND s.line = o.line WHERE s.line IS NULL) WHERE rank <= {budgets.RUNS_OF_PAGE}),
    queue AS MATERIALIZED (SELECT site, page_id, rank AS ord, chars, row_number() OVER (PARTITION BY site ORDER BY page_id, rank) AS n FROM own),
    given AS (SELECT site, '' AS consumer, {budgets.RUN_BUDGET} AS most, max(spent) AS spent FROM hoist GROUP BY site), {FOLD}
    SELECT site, NULL::BIGINT AS page_id, rank::INTEGER AS rank, line, chars, pages FROM shared
    UNION ALL SELECT site, page_id, rank::INTEGER, line, o.chars, pages FROM own o JOIN (SELECT site, page_id, ord AS rank FROM fold WHERE taken) USING (site, page_id, rank)""",
)
def cited_runs(spark, sf_dir):
    """Runs of the site that several pages carry (without a page), and those of each page."""
    return budgets.cited_runs(sources.blocks(sources.read_pages(spark, sf_dir))).drop("example")


@query(
    "claim_matrix_in_budget",
    f"""WITH {CL}, m AS (SELECT source, type, to_json(list({{'value': value, 'quote': substring(quote, 1, {budgets.MATRIX_QUOTE}), 'page': doc_id}} ORDER BY nth))::VARCHAR AS entries
      FROM (SELECT *, row_number() OVER (PARTITION BY source, type ORDER BY doc_id, ord) AS nth FROM cl) WHERE nth <= {budgets.MATRIX_VALUES} GROUP BY ALL),
    s AS (SELECT *, (length(type) + length(entries))::BIGINT AS size FROM m),
    b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM s)
    SELECT source, type, entries, size, before, before <= {budgets.MATRIX_BUDGET} AS kept FROM b""",
)
def claim_matrix_in_budget(spark, sf_dir):
    return budgets.claim_matrix(document_claims(spark, sf_dir), "source", "doc_id")

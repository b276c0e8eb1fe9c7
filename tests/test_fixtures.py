"""Every query over derived observations, on a few sites that each bring out one case, against its SQL."""

import re

import duckdb
import pytest

from weftline.plans import audit_queries, excerpt_queries
from weftline.sources.derived import Derived

from . import fixtures
from .conftest import SF
from .test_site import rows_of

FIXTURES = {f.name: f for f in vars(fixtures).values() if isinstance(f, fixtures.Inline)}
#: Queries whose inputs are whole texts or keys of the tables, which no fixture stands for.
TABLE_ONLY = {"heading_runs", "fact_tokens", "token_roles", "page_lastmod_join", "resolved_links", "encoded_urls", "question_pages", "anchor_ambiguity"}
NAMES = sorted(n for n, t in audit_queries.TABLES.items() if any(isinstance(x, Derived) for x in t) and n not in TABLE_ONLY)


@pytest.mark.parametrize("name", NAMES)
def test_fixture_scenarios(spark, monkeypatch, name):
    sql = audit_queries.ORACLES[name]
    for table in audit_queries.TABLES[name]:
        if isinstance(table, Derived):
            sql = sql.replace(table.cte(), FIXTURES[table.name].cte())
    monkeypatch.setattr(Derived, "df", lambda self, spark, sf_dir: FIXTURES[self.name].df(spark))
    duck = duckdb.connect()
    for table in ("pages", "documents", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    assert rows_of(excerpt_queries.QUERIES[name](spark, SF).toPandas()) == rows_of(duck.execute(sql).fetchdf())


def test_headings_and_tokens_of_fixtures(spark, monkeypatch):
    from pyspark.sql import functions as F

    from weftline.functions import urls

    monkeypatch.setattr(Derived, "df", lambda self, spark, sf_dir: FIXTURES[self.name].df(spark))
    runs = {(r.page_id, r.ord, r.text, r.dropped) for r in excerpt_queries.QUERIES["heading_runs"](spark, SF).collect()}
    assert (1, 7, None, 4) in runs and (1, 8, "a8", 0) not in runs and (1, 18, "c6", 0) in runs
    links = fixtures.RESOLVE.df(spark).withColumn("t", urls.resolve(F.col("base"), F.col("href"))).collect()
    assert [r.t for r in links] == ["http://b/", "https://c/d", "https://a.com/e", "https://a.com/x/f", "https://a.com/x/y?g=2", "https://a.com/x/y?q=1#h", "https://a.com/x/y?q=1", "mailto:i@j", "https://a.com/k"]


def test_dot_segments(spark):
    from urllib.parse import urljoin

    from pyspark.sql import functions as F

    from weftline.functions import urls

    hrefs = ["../k", "./k", "../../../k", "a/../b", "a/./b/", "..", ".", "../", "/a/../../b?x=../y#../z", "a..b", "...", "//h/a/../b", "/", "x/.."]
    rows = spark.createDataFrame([(b, h) for b in ("http://s/a/b/c", "http://s/a/b/", "http://s/", "http://s/a/b/c?q=/../x") for h in hrefs], "base string, href string")
    for r in rows.withColumn("t", urls.resolve(F.col("base"), F.col("href"))).collect():
        assert r.t == urljoin(r.base, r.href), (r.base, r.href)


def test_built_passages_of_the_page_table(spark):
    from weftline.operators.excerpts import sentence_around
    from weftline.plans.observed import ASKED, BLOCKS

    blocks = {}
    for b in BLOCKS.df(spark, SF).collect():
        blocks.setdefault(b.page_id, []).append((b.ord, b.line))
    got = {r.question_id: (r.status, r.passage) for r in excerpt_queries.QUERIES["built_passages"](spark, SF).collect()}
    asked = ASKED.df(spark, SF).collect()
    fold = lambda t: re.sub("[ \t\n\r\x0b\f\xa0]+", " ", t).strip(" ")
    for r in asked:
        lines = {line for _, line in blocks[r.page_id] if r.anchor is not None and fold(r.anchor) in fold(line)}
        status = "unanswered" if r.anchor is None else {0: "unresolved", 1: "resolved"}.get(len(lines), "ambiguous")
        assert got[r.question_id] == (status, sentence_around(next(iter(lines)), r.anchor) if status == "resolved" else None)
    assert len(got) == len(asked) and len({s for s, _ in got.values()}) == 4

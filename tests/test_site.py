"""The audit library: parser, URL functions, stream, and every query with SQL against DuckDB."""

import gzip
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.functions import urls
from weftline.operators import fragments
from weftline.operators.excerpts import sentence_around
from weftline.plans import excerpt_queries, site_queries
from weftline.sources import sitemaps
from weftline.sources.parse import inflate, parse_page, parse_pages
from weftline.streaming.reaudit import audit_stream, read_stream

from .conftest import SF

QUERIES = {**site_queries.QUERIES, **excerpt_queries.QUERIES}
ORACLES = {**site_queries.ORACLES, **excerpt_queries.ORACLES}


def cell(v):
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, float):
        return f"{v:.6g}"
    if hasattr(v, "__iter__") and not isinstance(v, str):
        return str(list(v))
    return str(v)


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(cell(v) for v in row) for row in frame[columns].itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(SF):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert rows_of(QUERIES[name](spark, SF).toPandas()) == rows_of(duck.execute(ORACLES[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_fragments_of_no_rows(spark):
    lines = spark.createDataFrame([], "site string, name string, line string")
    assert fragments.fragment_results(fragments.read_fragments(lines)).count() == 0
    files = spark.createDataFrame([], "site string, ord int, url string, http_status int, body string")
    assert sitemaps.counted(files).count() == sitemaps.sampled(files).count() == 0


def test_handed_findings_are_written(spark, tmp_path):
    rows = fragments.handed(spark.createDataFrame([("a", "X")], "site string, check_id string"))
    fragments.write_handed(rows, str(tmp_path / "out"))
    assert {r.consumer for r in spark.read.json(str(tmp_path / "out")).collect()} == set(fragments.CONSUMERS)


def test_parser_ends_open_links_and_headings():
    page = parse_page(1, "http://a/x/", '<body><a href="y">one<p>two</p><h2 id=q>Head<div>three</div><a href="../z">four</a></body>')
    assert page["blocks"] == ["two", "three"]
    assert [(x["href"], x["anchor_text"]) for x in page["links"]] == [("http://a/x/y", "one"), ("http://a/z", "four")]
    assert [(h["level"], h["text"], h["id"]) for h in page["headings"]] == [(2, "Head", "q")]
    assert [(s["heading"], s["char_offset"]) for s in page["sections"]] == [(None, 0), ("Head", 4)]


def test_parser_of_nothing():
    for html in (None, "", "<", "<!--", "<![endif]"):
        page = parse_page(1, None, html)
        assert page["links"] == [] and page["headings"] == [] and page["overlay"] is None
    assert parse_page(1, "u", None)["has_viewport"] is None


def test_parser_state_and_structured_data():
    html = '<script id="__NEXT_DATA__">x = {"a": ["Shown on the page", "Only in the state of it"], "u": "https://long.example/path"};</script><p>Shown on the page</p>'
    html += '<script type="application/ld+json">{"@type": "Article", "dateModified": "2024-01-01"}</script><time datetime="2024-02-02">x</time><pre>v1.2.3</pre><div itemscope itemtype="https://schema.org/Product"></div>'
    page = parse_page(1, "http://a/", html)
    assert page["state_strings"] == ["Only in the state of it"] and page["structured_dates"] == ["2024-02-02", "2024-01-01"]
    assert page["jsonld"][0]["parse_ok"] and page["microdata"] == ["Product"] and "v1.2.3" not in page["claim_text"]


def test_row_order_changes_nothing(spark):
    name = "anchorable_blocks"
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    from weftline.operators import runs
    from weftline.sources import pages as sources

    mixed = sources.read_pages(spark, SF).orderBy("html").repartition(3)
    assert rows_of(runs.anchorable(sources.blocks(mixed)).toPandas()) == rows_of(QUERIES[name](spark, SF).toPandas()) and pages.count() > 0


def test_url_escapes_and_gzip():
    assert urls.percent_encoded("http://a/é %41%zz") == "http://a/%C3%A9%20%41%25zz" and urls.percent_encoded(None) is None
    body = gzip.compress(b"abc" * 1000)
    assert inflate(body) == b"abc" * 1000 and inflate(b"plain") == b"plain" and inflate(None) is None
    assert (b"abc" * 1000).startswith(inflate(body[:-9]))


def test_stream_of_pages(spark, tmp_path):
    from weftline.plans import audit

    def with_sites(batch):
        return batch.withColumn("site", urls.authority(F.col("url"))).withColumn("path", urls.path(F.col("url")))

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    pages.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = audit_stream(read_stream(spark, str(tmp_path / "in"), 2), lambda b: audit.audit(with_sites(b)).drop("urls"), str(tmp_path / "out"), str(tmp_path / "state"))
    stream.awaitTermination()
    checked = spark.read.parquet(str(tmp_path / "out"))
    assert checked.filter("check_id = 'REF-VIEWPORT-ABSENT'").select("site").distinct().count() == pages.selectExpr("regexp_extract(url, '//([^/]*)', 1)").distinct().count()


def test_sentences_around_anchors():
    text = 'First one. He said "yes." Then  the price is\n$5 a day. Last'
    assert sentence_around(text, "price is $5") == "Then the price is $5 a day."
    assert sentence_around(text, "said") == 'He said "yes."'
    assert sentence_around(text, "Last") == "Last" and sentence_around(text, "none") is None and sentence_around(None, "x") is None
    long = "word " * 400 + "anchor here " + "word " * 400
    assert "anchor here" in sentence_around(long, "anchor here") and len(sentence_around(long, "anchor here")) <= 600


def test_budget_ends_a_page_but_not_a_site(spark):
    from weftline.operators.excerpts import within_budget

    rows = [("s", 1, 1, "a" * 40), ("s", 1, 2, "b" * 80), ("s", 1, 3, "c" * 10), ("s", 2, 1, "d" * 50), ("s", 2, 2, "e" * 20), ("t", 9, 1, "f" * 100)]
    got = sorted(tuple(r) for r in within_budget(spark.createDataFrame(rows, "site string, page_id long, ord int, text string"), 100).collect())
    assert got == [("s", 1, 1, 40), ("s", 2, 1, 50), ("t", 9, 1, 100)]


def test_page_checks_read_the_page_table(spark, tmp_path):
    from weftline.plans.audit_queries import HTML

    HTML.df(spark).drop("site").write.parquet(str(tmp_path / "pages.parquet"))
    expected = sorted(tuple(r) for r in QUERIES["page_check_findings"](spark, SF).collect())
    assert sorted(tuple(r) for r in QUERIES["site_check_findings"](spark, str(tmp_path)).collect()) == expected and len(expected) == 18
    found = QUERIES["page_check_gates"](spark, str(tmp_path)).filter("gate = 'finding'").select("site", "check_id", "severity").collect()
    assert sorted(tuple(r) for r in found) == expected
    sites = spark.read.parquet(f"{SF}/pages.parquet").selectExpr("count(DISTINCT regexp_extract(url, '//([^/]*)', 1))").first()[0]
    assert QUERIES["page_check_gates"](spark, SF).count() == 11 * sites
    assert sorted(r.parse_ok for r in QUERIES["site_jsonld_blocks"](spark, str(tmp_path)).collect()) == [False, True, True]


def test_one_audit_from_pages_to_report(spark, tmp_path):
    from weftline.plans import audit
    from weftline.plans.audit_queries import HTML

    from .fixtures import FILES
    from weftline.plans.catalog import CHECKS

    HTML.df(spark).drop("site").write.parquet(str(tmp_path / "pages.parquet"))
    expected = {tuple(r) for r in QUERIES["page_check_findings"](spark, SF).collect()}
    found = {(r.site, r.check_id, r.severity) for r in QUERIES["site_audit_findings"](spark, str(tmp_path)).collect()}
    absorbed = {(s, c, v) for s, c, v in expected if c == "REP-LINKS-SCRIPT-ONLY"}
    assert expected - absorbed <= found and all(c in CHECKS for _, c, _ in found)
    from weftline.sources import pages as sources

    pages = sources.read_pages(spark, str(tmp_path))
    files = FILES.df(spark).selectExpr("site", "translate(body, '|', chr(10)) AS body")
    results = audit.audit(pages, audit.Observed(robots_files=files))
    roles = {r.site: r.gate for r in results.filter("check_id = 'ACC-ROBOTS-ROLE'").collect()}
    assert roles["a"] == "finding" and roles["d"] == "pass"  # an empty group of a named agent allows all
    done = audit.report_of(results, pages.select("site").distinct())
    done.written(str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "findings")).count() == done.findings.count() > 0
    summary = {r.site: r for r in done.summary.collect()}
    assert set(summary) == set("abcdefghij") and all(r.partial for r in summary.values())
    left = {(r.site, r.check_id) for r in done.not_evaluated.collect()}
    assert ("a", "ACC-LINK-ROT") in left and ("a", "ACC-ROBOTS-ROLE") not in left


def test_report_lines_are_in_order_of_numbers(spark):
    from weftline.plans import report

    rows = [("s", f"F-{n:03d}", "X", "low", "e") for n in (1000, 2, 101, 12)]
    text = report.markdown(spark.createDataFrame(rows, "site string, id string, check_id string, severity string, evidence string")).first()["report"]
    assert [line.split("**")[1] for line in text.split("\n")[1:]] == ["F-002", "F-012", "F-101", "F-1000"]


def test_keys_of_parsed_pages_stay(spark):
    big = 2**53 + 1
    rows = spark.createDataFrame([(None, "http://a/", "<p>x"), (big, "http://a/", None)], "page_id long, url string, html string").coalesce(1)
    assert {r.page_id for r in parse_pages(rows).collect()} == {None, big} and parse_pages(rows).schema["page_id"].dataType.simpleString() == "bigint"


LINKED = (
    "<body><h2 class=t><a name=top>Head <i>one</i></a></h2><a class=x href=/p1>one</a><a href='/p2'>two</a><A HREF = \"/p3\"><b>three</b> more</A>"
    "<!-- <a href=\"/no\">no</a> --><script>'<a href=\"/no\">'</script><a data-href=/no>no</a><a href=\"/p4\">open<p>text</p><h3>Last"
)


def test_links_and_headings_in_any_form(spark):
    from weftline.sources import pages as sources

    p = spark.createDataFrame([(1, "s", "http://s/", LINKED), (2, "s", "http://s/2", None)], "page_id long, site string, url string, html string")
    got = [(r.ord, r.target, r.anchor_text) for r in sources.links(p).orderBy("ord").collect()]
    assert got == [(1, "http://s/p1", "one"), (2, "http://s/p2", "two"), (3, "http://s/p3", "three more"), (4, "http://s/p4", "open")]
    assert [tuple(r) for r in sources.headings(p).orderBy("ord").collect()] == [(1, 1, 2, "Head one"), (1, 2, 3, "Last")]


def test_late_links_count_for_the_site(spark, tmp_path):
    index = "".join(f'<a href="/p{i}">x</a>' for i in range(450))
    spark.createDataFrame([(1, "http://s/", index + LINKED), (2, "http://s/p449", "<p>x</p>"), (3, "http://s/p3", '<a href="/">home</a>')], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert QUERIES["unlinked_pages"](spark, str(tmp_path)).count() == 0
    assert QUERIES["sitemap_orphans"](spark, str(tmp_path)).first()["evidence"].startswith("0 of 3")
    assert QUERIES["page_links"](spark, str(tmp_path)).count() == 401


def test_budgets_hold_no_site_in_one_row(spark):
    from weftline.operators.excerpts import within_budgets

    sizes = [(page, place, (page * 7 + place * 13) % 40 + 1) for page in range(60) for place in range(5)]
    p = spark.createDataFrame([("s", page, place, "x" * n) for page, place, n in sizes], "site string, page_id long, ord int, text string").repartition(3)
    expected = []
    for consumer, most in (("a", 500), ("b", 90)):
        used, ended = 0, None
        for page, place, n in sizes:
            if ended != page and used + n <= most:
                used += n
                expected.append(("s", page, place, n, consumer))
            elif ended != page:
                ended = page
    rows = within_budgets(p, (("a", 500), ("b", 90)))
    assert sorted(tuple(r) for r in rows.collect()) == sorted(expected)
    assert "collect_list" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_name_tokens_of_whole_texts(spark, tmp_path):
    text = "the " * 30 + "Orion Paint Works"
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.name_tokens for r in QUERIES["document_name_tokens"](spark, str(tmp_path)).collect()}
    assert got == {1: "orion paint works", 2: None}


def test_discovered_lists_every_candidate(spark):
    from weftline.operators import crawl

    links = spark.range(1, 451).selectExpr("'a' AS site", "id AS page_id", "1 AS ord", "'http://a/p' || id AS target")
    files = spark.createDataFrame([], "site string, ord int, url string, http_status int, body string")
    got = [(r.origin, r.ord, r.path) for r in crawl.discovered(files, links).orderBy("ord").collect()]
    assert got == [("link", i, f"/p{i}") for i in range(1, 451)]
    assert crawl.candidates(links).count() == crawl.MOST_CANDIDATES


def test_parsed_rows_are_passed_on_in_portions(spark, monkeypatch):
    pages = spark.range(3).selectExpr("id AS page_id", "'http://a/' AS url", "cast(null as string) AS html")
    taken, plain = [], type(pages).mapInPandas
    monkeypatch.setattr(type(pages), "mapInPandas", lambda self, run, schema: taken.append(run) or plain(self, run, schema))
    parse_pages(pages)
    html = ["<p>" + "x" * 1000, None, "", "<p>" + "y" * 2_000_000] * 500
    pdf = pd.DataFrame({"page_id": [str(i) for i in range(2000)], "url": "http://a/", "html": html})
    sizes, ids = [], []
    for part, _ in zip(taken[0](iter([pdf.iloc[:0], pdf])), range(40)):
        sizes.append(len(part))
        ids += list(part["page_id"])
    assert len(sizes) == 40 and max(sizes) <= 256 and ids == [str(i) for i in range(len(ids))]


def test_claims_need_what_their_patterns_hold(spark, monkeypatch):
    from weftline.functions import claims

    texts = [
        "Pro plan, Enterprise Plan; Proplan", "Updated 2024-01-02 and MAY 3 2021, 4/5/2022, copyright by us 1999, 12/1/99", "+1 (555) 123-4567 or 555.123.4567",
        "APPLY BY May", "applies until noon\nClose on Monday", "End on time, due DATE", "registration CLOSES", "Deadline", "back-order and BACKORDER, preorder, Pre-Order", "Out of Stock", "in stock",
        "sold out; discontinued; no longer available, available again", "Free Shipping, ship in 2, ships within 3, Delivery in 4, delivery within 5, same-day delivery, ship within", "iso 9001, SOC2, soc 2, hipaa GDPR fedramp PCI-DSS pci dss",
        "closes on, ends on, due by, due on, apply until, applies by", "nothing here", "", None,
    ]
    rows = spark.createDataFrame(list(enumerate(t if i % 2 else t and f"É {t}" for i, t in enumerate(texts))), "k int, text string")
    got = sorted(map(tuple, claims.claims(rows, "k", "text").collect()))
    assert {t for _, _, t, *_ in got} >= {*claims.WORDS, *claims.SHAPES}
    for name in claims.WORDS:
        assert all(any(w in value.lower() for w in claims.WORDS[name]) for _, _, t, value, _ in got if t == name)
    monkeypatch.setattr(claims, "WORDS", {})
    monkeypatch.setattr(claims, "SHAPES", {})
    assert got == sorted(map(tuple, claims.claims(rows, "k", "text").collect()))


def sql_rows(name, folder):
    """Rows of a query's SQL over the tables in a folder."""
    connection = duckdb.connect()
    for file in os.listdir(folder):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{file}/*.parquet'")
    return rows_of(connection.execute(ORACLES[name]).fetchdf())


def test_conflicts_of_claims_after_the_thirtieth(spark, tmp_path):
    days = ", ".join(f"2024-{m:02}-{d:02}" for m in (1, 2, 3) for d in range(1, 21))
    rows = [(1, f"{days}; v1.2.3", "s"), (2, f"{days}; v2.0.0 and v2.0.0", "s"), (3, None, "s"), (4, "v1.2.3", "t")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["claim_conflicts"](spark, str(tmp_path)).toPandas()
    assert rows_of(got) == sql_rows("claim_conflicts", tmp_path)
    assert sorted(got.itertuples(index=False, name=None)) == [("s", "date", 60, 2), ("s", "version", 2, 2)]


def test_all_json_ld_of_a_page(spark, tmp_path):
    block = '<script type="application/ld+json">{"@type": "Product", "name": "%s"}</script>'
    many = "".join(block % f"p{i}" for i in range(25)) + block % ("x" * 30_000) + '<script type="application/ld+json">{broken</script>'
    rows = [(4, "http://s/", f"<html><head>{many}</head><body><p>x</p></body></html>"), (9, "http://s/2", None), (5, "http://s/3", f"<html><head>{many}</head></html>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    for name in ("jsonld_blocks", "site_jsonld_blocks"):
        got = QUERIES[name](spark, str(tmp_path)).toPandas()
        assert rows_of(got) == sql_rows(name, tmp_path) and (got["page_id"] == 4).sum() == 27 and got["raw"].str.len().max() > 30_000


def test_parsed_parts_are_whole(spark, tmp_path):
    body = "".join(f"<h2>h{i}</h2><p>{'y' * 900}</p><a href='/p{i}'>x</a><img src=i{i}><time datetime=d{i}>t</time><b itemscope itemtype='http://x/T{i}'>b</b>" for i in range(450))
    page = parse_page(1, "http://s/", f"<html lang=en><body>{body}<h2>last</h2><p>{'z' * 5_000}</p></body></html>")
    assert [len(page[k]) for k in ("headings", "links", "images", "structured_dates", "microdata")] == [451, 450, 450, 450, 450]
    assert len(page["visible_text"]) > 400_000 and page["visible_text"].endswith("z" * 5_000) and page["sections"][-1]["text"] == "z" * 5_000
    plain = '<html lang="en"><body>' + "".join(f'<h2 id="q">h{i}</h2><a href="/p{i}">x</a>' for i in range(450)) + "</body></html>"
    spark.createDataFrame([(1, "http://s/", plain)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert rows_of(QUERIES["parsed_titles_and_headings"](spark, str(tmp_path)).toPandas()) == sql_rows("parsed_titles_and_headings", tmp_path)


FACT = "The plan covers five users in all of Europe"


def pages_with_states(spark, folder):
    """Pages whose state has a fact late in a list, deep down, after many other strings, and deeper than C code reads."""
    deep = lambda n: '{"a":[' * n + f'"{FACT}"' + "]}" * n
    late = ", ".join([*(["1"] * 60), f'"{FACT}"'])
    few = lambda n: ", ".join(f'"other words {i}"' for i in range(n, n + 40))
    states = {"late": f"[{late}]", "deep": deep(6), "after": f'[[{few(0)}], [{few(40)}], "{FACT}"]', "deeper": deep(30_000), "shown": f'["{FACT}"]', "none": "[1]"}
    html = lambda site, state: f'<html><body><p>{FACT if site == "shown" else "x"}</p><script id="__NEXT_DATA__">{state}</script></body></html>'
    rows = [(i, f"http://{site}/", html(site, state)) for i, (site, state) in enumerate(states.items())]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return {"late", "deep", "after", "deeper"}


def test_gates_see_all_of_a_state(spark, tmp_path):
    expected = pages_with_states(spark, tmp_path)
    gates = {r.site: r.gate for r in QUERIES["page_check_gates"](spark, str(tmp_path)).filter("check_id = 'REP-STATE-ONLY-FACT'").collect()}
    assert {s for s, g in gates.items() if g == "finding"} == expected and gates["shown"] == gates["none"] == "pass"


def test_state_strings_are_all_that_the_page_does_not_show():
    said = [f"sentence {i} of the state" for i in range(500)]
    state = '{"a": ' + str(said).replace("'", '"') + ', "b": ["' + said[7] + '", "short", "https://x.example/path"]}'
    html = f'<p>{said[3]}</p><p>x{said[9]} and {said[12][:-1]}</p><script id="app-state">{state}</script>'
    assert parse_page(1, "http://a/", html)["state_strings"] == [s for s in said if s not in (said[3], said[9])]


def test_findings_of_all_of_a_state(spark, tmp_path):
    expected = pages_with_states(spark, tmp_path)
    found = QUERIES["site_check_findings"](spark, str(tmp_path)).filter("check_id = 'REP-STATE-ONLY-FACT'").collect()
    assert {tuple(r) for r in found} == {(site, "REP-STATE-ONLY-FACT", "medium") for site in expected}


def test_discovered_lists_every_entry_of_every_sitemap(spark):
    from weftline.operators import crawl

    entries = lambda name, n: "<urlset>" + "".join(f"<url><loc>http://a/{name}{i}</loc></url>" for i in range(n)) + "</urlset>"
    index = "<sitemapindex><sitemap><loc>http://a/c.xml</loc></sitemap><sitemap><loc>http://a/d.xml</loc></sitemap></sitemapindex>"
    rows = [("i", 1, "http://a/s.xml", 200, index), ("i", 3, "http://a/c.xml", 200, entries("c", 120)), ("i", 4, "http://a/d.xml", 200, entries("d", 3)), ("i", 2, "http://a/t.xml", 200, "<urlset>"),
            ("i", 5, "http://a/e.xml", 404, entries("e", 3)), ("m", 1, "http://a/1.xml", 200, entries("x", 0)), ("m", 2, "http://a/2.xml", 200, entries("y", 60)), ("m", 3, "http://a/3.xml", 200, entries("z", 60)), ("n", 1, "http://a/n.xml", 200, None)]
    files = spark.createDataFrame(rows, "site string, ord int, url string, http_status int, body string")
    links = spark.createDataFrame([], "site string, page_id long, ord int, target string")
    got = [tuple(r) for r in crawl.discovered(files.repartition(3), links).orderBy("site", "ord").collect()]
    paths = {"i": [f"/c{i}" for i in range(120)] + ["/d0", "/d1", "/d2"], "m": [f"/{f}{i}" for f in "yz" for i in range(60)]}
    assert got == [(site, "sitemap", i, path) for site in "im" for i, path in enumerate(paths[site], 1)]


def test_audit_counts_all_claims_of_a_page(spark, tmp_path):
    from weftline.plans import audit
    from weftline.sources import pages as sources

    prices = "".join(f"<p>${i} a month</p>" for i in range(1, 41))
    html = lambda version: f"<html><body>{prices}<p>Updated 2024-01-02</p><p>Release {version}</p></body></html>"
    rows = [(1, "http://a/1", html("v1.2.3")), (2, "http://a/2", html("v2.0.0")), (3, "http://b/1", "<p>v1.0.0</p>"), (4, "http://b/2", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {(r.site, r.check_id): r.evidence for r in audit.prepared(audit.facts(sources.read_pages(spark, str(tmp_path)))).collect()}
    assert got["a", "FRS-CLAIM-CONFLICT"] == "2 types of claims differ between 2 pages"
    assert got["a", "FRS-DATE-CONFLICT"] == "0 of 2 pages have structured dates, 2 visible ones"
    assert got["b", "FRS-CLAIM-CONFLICT"] == "0 types of claims differ between 2 pages"
    assert {r.evidence for r in QUERIES["site_audit_results"](spark, str(tmp_path)).filter("site = 'a' and check_id = 'FRS-CLAIM-CONFLICT'").collect()} == {got["a", "FRS-CLAIM-CONFLICT"]}

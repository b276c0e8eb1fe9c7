"""Tables of observations derived from the page table, in words that both engines read.

The page table has no robots files, probes, headers or verdicts. What such tables would hold is derived from its rows, so that
the queries over them grow with it: sites, URLs, paths and titles are the pages' own, what was observed of them follows from
their keys, in proportions that bring out every case."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .pages import read_pages

#: A URL without query and fragment; its scheme and host.
URL = "regexp_extract(url, '^([^?#]*)', 1)"
HEAD = "regexp_extract(url, '^([A-Za-z]*://[^/?#]*)', 1)"
TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
SITES = f"st AS (SELECT site, count(*) AS n, min(page_id) AS i, min({URL}) AS lo, max({URL}) AS hi FROM pg GROUP BY site)"


@dataclass(frozen=True)
class Derived:
    """A query over pg (the pages with site and path), st (their sites) and the tables that it names. ARR( stands for what makes
    an array; where the engines differ more, spark has Spark's form. `of` gives further tables: their frames, and their SQL."""

    name: str
    sql: str
    spark: str | None = None
    tables: tuple[str, ...] = ()
    of: dict[str, Callable[[SparkSession, str], DataFrame]] = field(default_factory=dict)
    before: tuple[str, ...] = ()

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in self.tables}
        frames |= {name: make(spark, sf_dir) for name, make in self.of.items()} | {"pg": read_pages(spark, sf_dir)}
        given = ", ".join(f"{name} AS (SELECT * FROM {{{name}}})" for name in frames)
        body = (self.spark or self.sql).replace("ARR(", "array(").replace("{", "{{").replace("}", "}}")
        return spark.sql(f"WITH {given}, {SITES} {body}", **frames)

    def cte(self) -> str:
        return f"{self.name} AS ({self.sql.replace('ARR(', 'list_value(')})"


def ctes(tables: tuple, pages: str) -> str:
    """The tables as a list of common table expressions; pages: that of pg, which derived ones read."""
    derived = [t for t in tables if isinstance(t, Derived)]
    first = [pages, SITES] if derived else []
    return ", ".join([*first, *dict.fromkeys(b for t in derived for b in t.before), *(t.cte() for t in tables)])

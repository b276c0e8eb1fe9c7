"""Budgets of characters shared by the pages of a site, spent in page order, however many pages a site has.

All of these are greedy in order, so what fits depends on all that came before. What keeps a hot site from one task is a
bound that follows from the greed itself: an item of size s can only be taken while fewer than budget / s items of its size
came before it, as each of those fitted too if it does. So of each size only the first budget / s items of a site matter,
which is a top-k of (site, size) that every task cuts before the exchange. What is left of a site is at most
budget * (1 + 1/2 + 1/3 + ...) items, whatever the site's size, and goes through one task in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import texts
from ..sources.scratch import written

#: Of runs by which pages can be cited, and of the table of claims.
LEAST_RUN, MOST_RUN, RUN_BUDGET, MOST_SHARED, RUNS_OF_PAGE = 12, 600, 9_000, 14, 10
MATRIX_BUDGET, MATRIX_VALUES, MATRIX_QUOTE = 8_000, 8, 200


def first_pages(rows: DataFrame, most: int) -> DataFrame:
    """rows (site, page_id, ord, chars, ...) of the pages that can get anything of a budget of `most`: their first item is
    among the first most / size of that size. Pages whose first item is empty stay."""
    page = Window.partitionBy("site", "page_id").orderBy("ord", "chars")
    rows = rows.withColumn("_size", F.first("chars").over(page.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    empty = rows.filter("_size = 0")
    rows = rows.filter("_size > 0").withColumn("_nth", F.dense_rank().over(Window.partitionBy("site", "_size").orderBy("page_id")))
    rows = rows.filter(F.col("_nth") <= most).filter(F.col("_nth") * F.col("_size") <= most)
    return rows.drop("_size", "_nth").unionByName(empty.drop("_size"))


def spend(rows: DataFrame, budgets: tuple[tuple[str, int], ...]) -> DataFrame:
    """(site, page_id, ord, chars, consumer): rows (site, page_id, ord, chars) that each consumer gets, in order of page and
    place as long as its budget of the site holds; a page ends at its first row that does not fit.

    A column `spent`, if there is one, says what of the budgets a site has spent before, alike in all its rows."""
    cols = ["site", "page_id", "ord", "chars"]
    rows = rows if "spent" in rows.columns else rows.withColumn("spent", F.lit(0))
    kind = {c: t for c, t in rows.dtypes}["site"]
    rows = rows.select("site", *[F.col(c).cast("long").alias(c) for c in (*cols[1:], "spent")])
    most = max(n for _, n in budgets)
    so_far = Window.partitionBy("site", "page_id").orderBy("ord", "chars").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum("chars").over(so_far)).filter(F.col("_sum") <= most).drop("_sum")
    rows = first_pages(rows, most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: object = run  # no site yet
        used: list[int] = []
        ended: list[int | None] = []
        for pdf in batches:
            out = []
            for site, page, place, size, spent in zip(*(pdf[c] for c in (*cols, "spent"))):
                if site != at:
                    at, used, ended = site, [spent] * len(budgets), [None] * len(budgets)
                for i, (consumer, limit) in enumerate(budgets):
                    if ended[i] == page:
                        continue
                    if used[i] + size <= limit:
                        used[i] += size
                        out.append((site, page, place, size, consumer))
                    else:
                        ended[i] = page
            yield pd.DataFrame(out, columns=[*cols, "consumer"])

    rows = rows.repartition("site").sortWithinPartitions(*cols)
    return rows.mapInPandas(run, f"site {kind}, page_id long, ord long, chars long, consumer string")


def cited_runs(blocks: DataFrame) -> DataFrame:
    """(site, page_id, rank, line, chars, pages, example) of blocks (site, page_id, ord, line): runs of LEAST_RUN to MOST_RUN
    characters, white space folded, by which pages can be cited.

    Rows without page_id are the site's: runs of several pages, of most pages first and then the longest, ties by their first
    place; each that fits a third of RUN_BUDGET, MOST_SHARED at most; example is their first page. The others are the pages'
    own: of each page the RUNS_OF_PAGE that fewest pages carry, then the longest, without shared ones; in page order, as
    long as what is left of the budget holds, a page up to its first run that does not fit.

    Runs are counted and chosen by 128 bits of hash, which are written once; what is chosen then fetches its text."""
    keys = ["site", "h1", "h2"]
    line = texts.fold_spaces(F.col("line"))
    runs = blocks.select("site", F.col("page_id").cast("long").alias("page_id"), F.col("ord").cast("long").alias("ord"), line.alias("line"))
    runs = runs.withColumn("chars", F.length("line").cast("long")).filter(F.col("chars").between(LEAST_RUN, MOST_RUN))
    hashed = runs.select("site", "page_id", "ord", "chars", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    once = written(hashed.groupBy(*keys, "page_id", "chars").agg(F.min("ord").alias("ord")), "runs")
    carried = once.groupBy(*keys, "chars").agg(F.count(F.lit(1)).alias("pages"), F.min(F.struct("page_id", "ord")).alias("example"))

    third = RUN_BUDGET // 3
    best = [F.desc("pages"), F.desc("chars"), F.col("example")]
    several = carried.filter("pages > 1").withColumn("nth", F.row_number().over(Window.partitionBy("site", "chars").orderBy(*best)))
    several = several.filter(F.col("nth") <= MOST_SHARED).filter(F.col("nth") * F.col("chars") <= third)
    item = F.struct((-F.col("pages")).alias("p"), (-F.col("chars")).alias("c"), "example", "pages", "chars", "h1", "h2")
    # Of one site at most MOST_SHARED runs of each length, so the array does not grow with the site.
    listed = several.groupBy("site").agg(F.array_sort(F.collect_list(item)).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("spent"), F.array().cast("array<int>").alias("taken"))
    places = F.transform("all", lambda x, i: F.struct(i.alias("i"), x["chars"].alias("chars")))

    def take(acc, x):
        fits = (F.size(acc["taken"]) < MOST_SHARED) & (acc["spent"] + x["chars"] <= third)
        return F.when(fits, F.struct((acc["spent"] + x["chars"]).alias("spent"), F.concat(acc["taken"], F.array(x["i"])).alias("taken"))).otherwise(acc)

    chosen = listed.withColumn("done", F.aggregate(places, start, take))
    chosen = chosen.select("site", "done.spent", F.transform("done.taken", lambda i: F.get("all", i)).alias("items"))
    hoisted = chosen.select("site", F.posexplode("items").alias("nth", "x")).select("site", (F.col("nth") + 1).alias("rank"), "x.*")

    own = once.join(carried.select(*keys, "pages"), keys).join(hoisted.select(*keys), keys, "left_anti")
    rank = F.row_number().over(Window.partitionBy("site", "page_id").orderBy("pages", F.desc("chars"), "ord"))
    own = own.withColumn("rank", rank).filter(F.col("rank") <= RUNS_OF_PAGE).select("site", "page_id", "rank", "ord", "chars", "pages")
    priced = own.join(chosen.select("site", "spent"), "site", "left")
    priced = priced.select("site", "page_id", F.col("rank").alias("ord"), "chars", F.coalesce("spent", F.lit(0)).alias("spent"))
    kept = spend(priced, (("", RUN_BUDGET),)).select("site", "page_id", F.col("ord").cast("int").alias("rank"))
    own = own.join(kept, ["site", "page_id", "rank"], "left_semi")

    shared = hoisted.select("site", "example.page_id", "example.ord", "rank", "chars", "pages", F.lit(True).alias("shared"))
    chosen_all = own.select("site", "page_id", "ord", "rank", "chars", "pages", F.lit(False).alias("shared")).unionByName(shared)
    found = chosen_all.join(runs.select("site", "page_id", "ord", "line"), ["site", "page_id", "ord"])
    page = F.col("page_id")
    return found.select("site", F.when(~F.col("shared"), page).alias("page_id"), "rank", "line", "chars", "pages", F.when(F.col("shared"), page).alias("example"))


def claim_matrix(claims: DataFrame, site: str, page: str) -> DataFrame:
    """(site, type, entries, size, before, kept) of claims (site, page, ord, type, value, quote): the first MATRIX_VALUES
    claims of each type as JSON, how long that is, and how long the types before it are together, by name. A type is kept as
    long as those before it are no longer than MATRIX_BUDGET; the others are the tail."""
    nth = F.row_number().over(Window.partitionBy(site, "type").orderBy(page, "ord"))
    rows = claims.withColumn("nth", nth).filter(F.col("nth") <= MATRIX_VALUES)
    entry = F.struct("nth", F.col("value"), F.substring("quote", 1, MATRIX_QUOTE).alias("quote"), F.col(page).alias("page"))
    some = rows.groupBy(site, "type").agg(F.array_sort(F.collect_list(entry)).alias("some"))
    entries = F.to_json(F.transform("some", lambda x: F.struct(x["value"].alias("value"), x["quote"].alias("quote"), x["page"].alias("page"))))
    some = some.withColumn("entries", entries).withColumn("size", (F.length("type") + F.length("entries")).cast("long"))
    before = Window.partitionBy(site).orderBy("type").rowsBetween(Window.unboundedPreceding, -1)
    some = some.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    return some.select(site, "type", "entries", "size", "before", (F.col("before") <= MATRIX_BUDGET).alias("kept"))

"""Ordered rows: first wins, runs of equals, adjacent pairs, collapsed claims, passages in blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEPT_SIBLINGS = 6
COLLAPSE_ABOVE, MOST_VALUES, MATRIX = 5, 6, 8
PORTION, ROW = 1 << 26, 64  # bytes that a task sorts; those of a row without its text


def _portions(rows: DataFrame, by: str, text: str) -> DataFrame:
    """Rows dealt by a key to as many tasks as have about PORTION bytes each, so that a task's share stays the same however
    large the table is."""
    size = rows.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + ROW)).first()[0] or 0
    return rows.repartition(max(1, -(-size // PORTION)), by)


def cap_siblings(headings: DataFrame) -> DataFrame:
    """(page_id, ord, level, text, dropped): of more than seven headings of one level in a row the first six stay, and
    one row, with a null text, says how many are left out.

    All windows go through the rows of a page in order, so the texts are sorted once. A run's length is the number of its
    last row, which is the next after the seventh once the rows between them are gone."""
    order = Window.partitionBy("page_id").orderBy("ord")
    level, mark = F.struct("level"), KEPT_SIBLINGS + 1  # a struct differs from no row even where the level is null
    rows = _portions(headings, "page_id", "text").select(
        "page_id", "ord", "level", "text", F.row_number().over(order).alias("at"),
        (~level.eqNullSafe(F.lag(level).over(order))).alias("starts"), (~level.eqNullSafe(F.lead(level).over(order))).alias("ends"),
    )
    start = F.max(F.when(F.col("starts"), F.col("at"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("nth", (F.col("at") - start + 1).cast("long")).filter((F.col("nth") <= mark) | F.col("ends"))
    rows = rows.withColumn("n", F.when(F.col("ends"), F.col("nth")).otherwise(F.lead("nth").over(order))).filter(F.col("nth") <= mark)
    over = (F.col("nth") == mark) & (F.col("n") > mark)
    text, dropped = F.when(~over, F.col("text")), F.when(over, F.col("n") - KEPT_SIBLINGS).otherwise(F.lit(0))
    return rows.select("page_id", "ord", "level", text.alias("text"), dropped.cast("long").alias("dropped"))


def adjacent_pairs(blocks: DataFrame) -> DataFrame:
    """(page_id, ord, pair): each block with the one after it."""
    after = F.lead("line").over(Window.partitionBy("page_id").orderBy("ord"))
    return blocks.select("page_id", "ord", F.concat("line", F.lit(" "), after).alias("pair")).filter("pair is not null")


def topic_counts(claims: DataFrame, site: str) -> DataFrame:
    return claims.groupBy(site, "type").agg(F.count(F.lit(1)).alias("claims"))


def claim_matrix(claims: DataFrame, site: str, page: str) -> DataFrame:
    """(site, type, entries): the first MATRIX values of each type of a site, in order of page and place."""
    nth = F.row_number().over(Window.partitionBy(site, "type").orderBy(page, "ord"))
    rows = claims.withColumn("nth", nth).filter(F.col("nth") <= MATRIX)
    entries = F.array_sort(F.collect_list(F.struct("nth", F.concat_ws(":", F.col(page), F.col("value")).alias("e"))))
    return rows.groupBy(site, "type").agg(F.array_join(F.transform(entries, lambda x: x["e"]), "|").alias("entries"))


def collapse_claims(claims: DataFrame, site: str, page: str) -> DataFrame:
    """(site, type, value, rows, collapsed, rank): values of each type in order of first sight, MOST_VALUES of a type;
    a value with more than COLLAPSE_ABOVE rows stands for them; a row without value counts the values left out."""
    first = F.min(F.struct(F.col(page).alias("p"), F.col("ord").alias("o")))
    grouped = claims.groupBy(site, "type", "value").agg(F.count(F.lit(1)).alias("rows"), first.alias("first"))
    ranked = grouped.withColumn("rank", F.row_number().over(Window.partitionBy(site, "type").orderBy("first", "value")))
    kept = ranked.filter(F.col("rank") <= MOST_VALUES).select(site, "type", "value", "rows", (F.col("rows") > COLLAPSE_ABOVE).alias("collapsed"), F.col("rank").cast("long").alias("rank"))
    rest = ranked.filter(F.col("rank") > MOST_VALUES).groupBy(site, "type").agg(F.count(F.lit(1)).alias("rows"))
    rest = rest.select(site, "type", F.lit(None).cast("string").alias("value"), "rows", F.lit(False).alias("collapsed"), F.lit(MOST_VALUES + 1).cast("long").alias("rank"))
    return kept.unionByName(rest)


def conflicts(claims: DataFrame, site: str, page: str) -> DataFrame:
    """(site, type, values, pages): types of which different pages of a site state different values."""
    found = claims.groupBy(site, "type").agg(F.countDistinct("value").alias("values"), F.countDistinct(page).alias("pages"))
    return found.filter("values > 1 and pages > 1")


def repeated_runs(blocks: DataFrame) -> DataFrame:
    """(site, line, pages): how many pages of a site carry a block."""
    return blocks.groupBy("site", "line").agg(F.countDistinct("page_id").alias("pages"))


def anchorable(blocks: DataFrame, most: int = 10) -> DataFrame:
    """(page_id, rank, line): blocks by which a page can be cited: those that fewest pages carry, then the longest."""
    counted = blocks.select("site", "page_id", "line").distinct().join(repeated_runs(blocks), ["site", "line"])
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("pages", F.desc(F.length("line")), "line"))
    return counted.select("page_id", rank.alias("rank"), "line").filter(F.col("rank") <= most)


def passages_in_blocks(passages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(question_id, page_id, contiguous, note): whether a passage lies within one block, or over two adjacent ones."""
    one = blocks.join(passages, "page_id").filter(F.col("line").contains(F.col("passage"))).select("question_id", "page_id").distinct().withColumn("in_block", F.lit(True))
    pairs = adjacent_pairs(blocks).join(passages, "page_id").filter(F.col("pair").contains(F.col("passage"))).select("question_id", "page_id").distinct().withColumn("in_pair", F.lit(True))
    rows = passages.join(one, ["question_id", "page_id"], "left").join(pairs, ["question_id", "page_id"], "left")
    note = F.when(F.col("in_block"), "within a block").when(F.col("in_pair"), "over two blocks").otherwise("not found")
    return rows.select("question_id", "page_id", F.coalesce("in_block", F.lit(False)).alias("contiguous"), note.alias("note"))

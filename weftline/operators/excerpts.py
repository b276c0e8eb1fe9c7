"""Bounded excerpts, sentence-bounded passages, footers, shared prefixes and constraints on logs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import texts
from .budgets import spend

#: Characters that each consumer may read.
BUDGETS = (("answers", 10_000), ("freshness", 8_000), ("referral", 6_000))
EXCERPT, FIRST_WINDOW, PASSAGE = 1_500, 600, 600
_END = re.compile(r"[.!?][\"'”’)]?(?=\s|$)")


def within_budgets(excerpts: DataFrame, budgets: tuple[tuple[str, int], ...]) -> DataFrame:
    """(site, page_id, ord, chars, consumer) of excerpts (site, page_id, ord, text) that each consumer gets: in order of
    page and place, as long as the budget of the site holds; a page ends at its first excerpt that does not fit, and a
    later page may still fit a smaller one.

    See budgets: only pages that can get something go through a site's task."""
    chars = F.least(F.length("text"), F.lit(EXCERPT)).cast("long")
    return spend(excerpts.select("site", "page_id", "ord", chars.alias("chars")), budgets)


def within_budget(excerpts: DataFrame, budget: int) -> DataFrame:
    """(site, page_id, ord, chars) of within_budgets() for one consumer."""
    return within_budgets(excerpts, (("", budget),)).drop("consumer")


def sentence_around(text: str | None, anchor: str | None, most: int = PASSAGE) -> str | None:
    """The whole sentences around an anchor, up to `most` characters and never less than the anchor; white space folds."""
    if text is None or not anchor:
        return None
    text, anchor = " ".join(text.split()), " ".join(anchor.split())
    at = text.find(anchor)
    if at < 0:
        return None
    ends = [m.end() for m in _END.finditer(text)]
    start = max([e for e in ends if e <= at], default=0)
    end = min([e for e in ends if e >= at + len(anchor)], default=len(text))
    if end - start > most:
        spare = max(0, most - len(anchor))
        start = max(start, at - spare // 2)
        end = max(at + len(anchor), min(end, start + most))
    return text[start:end].strip()


@F.pandas_udf(StringType())
def sentence_bounds(text: pd.Series, anchor: pd.Series) -> pd.Series:
    return pd.Series([sentence_around(t, a) for t, a in zip(text, anchor)], dtype="object")


def build_passages(questions: DataFrame, blocks: DataFrame) -> DataFrame:
    """(question_id, status, passage) of questions (question_id, page_id, anchor): resolved in one block of its page,
    ambiguous in several different ones, unanswered without an anchor, unresolved otherwise."""
    met = questions.join(blocks, "page_id", "left").withColumn("hit", F.col("anchor").isNotNull() & F.contains(texts.fold_spaces(F.col("line")), texts.fold_spaces(F.col("anchor"))))
    found = met.groupBy("question_id", "page_id", "anchor").agg(F.count_distinct(F.when(F.col("hit"), F.col("line"))).alias("runs"), F.min_by(F.when(F.col("hit"), F.col("line")), F.when(F.col("hit"), F.col("ord"))).alias("line"))
    status = F.when(F.col("anchor").isNull(), "unanswered").when(F.col("runs") == 1, "resolved").when(F.col("runs") > 1, "ambiguous").otherwise("unresolved")
    return found.select("question_id", status.alias("status"), F.when(status == "resolved", sentence_bounds("line", "anchor")).alias("passage"))


def first_window(passages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(question_id, offset, in_window): where a passage stands in its page's joined blocks, and whether it begins in
    the first FIRST_WINDOW characters; null if it is not there."""
    joined = blocks.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("text"))
    rows = passages.join(joined, "page_id", "left").withColumn("at", F.instr("text", F.col("passage")))
    return rows.select("question_id", F.when(F.col("at") > 0, F.col("at") - 1).alias("offset"), F.when(F.col("at") > 0, F.col("at") <= FIRST_WINDOW).alias("in_window"))


def shared_prefix(excerpts: DataFrame, least: int = 400) -> DataFrame:
    """(site, length): the longest prefix, in steps of 50 characters, that half of a site's excerpts (site, page_id, text)
    begin with, if it has `least` characters."""
    steps = F.sequence(F.lit(50), F.greatest(F.lit(50), (F.length("text") / 50).cast("int") * 50), F.lit(50))
    rows = excerpts.filter(F.length("text") >= 50).select("site", "page_id", F.explode(steps).alias("length"), "text")
    counted = rows.groupBy("site", "length", F.xxhash64(F.substring("text", F.lit(1), F.col("length"))).alias("h")).agg(F.countDistinct("page_id").alias("pages"))
    sizes = excerpts.groupBy("site").agg(F.countDistinct("page_id").alias("n"))
    good = counted.join(sizes, "site").filter((2 * F.col("pages") >= F.col("n")) & (F.col("pages") >= 2) & (F.col("length") >= least))
    return good.groupBy("site").agg(F.max("length").alias("length"))


def footer_name(html: Column) -> Column:
    """The legal name of a page's footer: what follows its last copyright sign, without years and closing phrases."""
    last = F.try_element_at(F.regexp_extract_all(html, F.lit(r"(?:©|&copy;|\(c\)) *((?:[0-9]{4}(?:[-–][0-9]{4})? *)?[^<&|]*)"), F.lit(1)), F.lit(-1))
    bare = F.regexp_replace(F.regexp_replace(last, "^[0-9]{4}(?:[-–][0-9]{4})? *", ""), r"(?i)[ .,]*(?:all rights reserved|privacy|terms).*$", "")
    return F.nullif(F.trim(bare), F.lit(""))


def probe_violations(probes: DataFrame, most: int = 6) -> DataFrame:
    """(run, problem) of probe logs (run, question_id, kind, outcome, timestamp): more rows than allowed, more than one
    navigational one, repeated questions, unknown outcomes, times that are not in UTC."""
    known = ("cited", "mentioned", "absent", "third-party", "wrong-entity", "wrong-fact", "error")
    per = probes.groupBy("run").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "navigational").alias("nav"), F.count_distinct("question_id").alias("ids"),
        F.count_if(~F.col("outcome").isin(*known)).alias("odd"), F.count_if(~F.col("timestamp").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:]{8}Z$")).alias("late"),
    )
    tests = ((F.col("n") > most, "too many rows"), (F.col("nav") > 1, "several navigational"), (F.col("ids") < F.col("n"), "repeated question"), (F.col("odd") > 0, "unknown outcome"), (F.col("late") > 0, "time not in UTC"))
    found = F.filter(F.array(*[F.when(test, F.lit(name)) for test, name in tests]), lambda x: x.isNotNull())
    return per.select("run", F.explode(found).alias("problem"))


def safe_fixes(results: DataFrame, order: str) -> DataFrame:
    """results (site, check_id, gate, urls, ...) once for each check, the first by order; only findings keep URLs."""
    nth = F.row_number().over(Window.partitionBy("site", "check_id").orderBy(order))
    once = results.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")
    return once.withColumn("urls", F.when(F.col("gate") == "finding", F.col("urls")).otherwise(F.array().cast("array<string>")))

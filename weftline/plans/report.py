"""The report: check results of many sites to findings with numbers, what needs a look, and what was not evaluated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.pages import first_by
from .catalog import SEVERITIES

MEASURED = ("REF-SOFT-404", "ACC-BOT-CHALLENGE")  # findings that must show a status code
ABSORBED = ("REP-LINKS-SCRIPT-ONLY", "REP-EXTRACTION-LOSS")
PRIMARY = "REP-KEY-FACT-LOSS"
FORBIDDEN = r"(?i)guarantee|will rank|rank(?:s|ing)? first|algorithm penalt|always cited|never cited|100% visib"


def severity_rank(severity: Column) -> Column:
    rank = F.lit(len(SEVERITIES))
    for n, name in enumerate(SEVERITIES):
        rank = F.when(severity == name, n).otherwise(rank)
    return rank


def route(results: DataFrame, catalog: DataFrame) -> DataFrame:
    """results with route: finding, verify, passed, not_evaluated or unknown.

    results: (site, check_id, gate, severity, confidence, evidence, evidence_quality, urls). A pass on a hypothesis and
    a measured finding without a status code are not evaluated; a finding of low confidence needs a look."""
    rows = results.join(F.broadcast(catalog.select("check_id", F.lit(True).alias("known"))), "check_id", "left")
    bare = F.col("check_id").isin(*MEASURED) & ~F.coalesce("evidence", F.lit("")).rlike(r"(^|[^0-9])[0-9]{3}($|[^0-9])")
    to = (
        F.when(F.col("known").isNull(), "unknown")
        .when((F.col("gate") == "pass") & (F.col("evidence_quality") == "hypothesis"), "not_evaluated")
        .when(F.col("gate") == "pass", "passed")
        .when((F.col("gate") == "finding") & bare, "not_evaluated")
        .when((F.col("gate") == "finding") & (F.col("confidence") == "low"), "verify")
        .when(F.col("gate") == "finding", "finding")
        .otherwise("not_evaluated")
    )
    return rows.withColumn("route", to).drop("known")


def findings(routed: DataFrame) -> DataFrame:
    """(site, id, check_id, severity, confidence, evidence, urls): findings once each, those that a lost page explains
    taken into its finding, by severity, numbered. Critical without high confidence becomes high after the numbering."""
    rows = routed.filter("route = 'finding'").withColumn("key", F.array_join(F.array_sort("urls"), "|"))
    rows = first_by(rows, ["site", "check_id", "key"], [severity_rank(F.col("severity")), F.col("evidence")])
    primary = rows.filter(F.col("check_id") == PRIMARY).groupBy("site").agg(F.flatten(F.collect_list("urls")).alias("lost"))
    rows = rows.join(primary, "site", "left")
    inside = F.col("check_id").isin(*ABSORBED) & F.coalesce(F.arrays_overlap("urls", "lost"), F.lit(False))
    taken = rows.filter(inside).groupBy("site").agg(F.array_join(F.array_sort(F.collect_set("check_id")), ", ").alias("also"))
    rows = rows.filter(~inside).join(taken, "site", "left")
    evidence = F.when((F.col("check_id") == PRIMARY) & F.col("also").isNotNull(), F.concat("evidence", F.lit("; explains "), F.col("also"))).otherwise(F.col("evidence"))
    order = Window.partitionBy("site").orderBy(severity_rank(F.col("severity")), "check_id", "key")
    number = F.format_string("F-%03d", F.row_number().over(order))
    clamped = F.when((F.col("severity") == "critical") & (F.col("confidence") != "high"), "high").otherwise(F.col("severity"))
    return rows.select("site", number.alias("id"), "check_id", clamped.alias("severity"), "confidence", evidence.alias("evidence"), F.col("key").alias("urls"))


def not_evaluated(routed: DataFrame, catalog: DataFrame, sites: DataFrame) -> DataFrame:
    """(site, check_id): what was not evaluated and is not decided otherwise, and checks that no result names."""
    decided = routed.filter("route in ('finding', 'verify', 'passed')").select("site", "check_id").distinct()
    open_ = routed.filter("route = 'not_evaluated'").select("site", "check_id").distinct()
    named = routed.filter("route <> 'unknown'").select("site", "check_id").distinct()
    silent = sites.select("site").crossJoin(F.broadcast(catalog.select("check_id"))).join(named, ["site", "check_id"], "left_anti")
    return open_.join(decided, ["site", "check_id"], "left_anti").unionByName(silent)


def summary(routed: DataFrame, found: DataFrame) -> DataFrame:
    """(site, critical, high, medium, low, verify, passed): counts; sites without any finding have zeros."""
    base = routed.groupBy("site").agg(F.count_if(F.col("route") == "verify").alias("verify"), F.count_if(F.col("route") == "passed").alias("passed"))
    counts = found.groupBy("site").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    return base.join(counts, "site", "left").select("site", *[F.coalesce(s, F.lit(0)).alias(s) for s in SEVERITIES], "verify", "passed")


def out_of_band(found: DataFrame, catalog: DataFrame) -> DataFrame:
    """(site, id, check_id): findings whose severity the catalog does not list; a warning only."""
    rows = found.join(F.broadcast(catalog.select("check_id", "band")), "check_id")
    return rows.filter(~F.array_contains(F.split("band", " "), F.col("severity"))).select("site", "id", "check_id")


def forbidden(found: DataFrame) -> DataFrame:
    """(site, id): findings whose words promise what no audit can know."""
    return found.filter(F.col("evidence").rlike(FORBIDDEN)).select("site", "id")


def opportunities(rows: DataFrame) -> DataFrame:
    """(site, rank, title, priority): opportunities once for each title in any case, by priority and title."""
    once = first_by(rows.withColumn("lower", F.lower("title")), ["site", "lower"], ["priority", "title"])
    rank = F.row_number().over(Window.partitionBy("site").orderBy("priority", "title"))
    return once.select("site", rank.alias("rank"), "title", "priority")


#: A token that looks like the id of a check: three letters and a tail of three characters or more, so that UTF-8 is none.
CITED = r"\b[A-Z]{3}-[A-Z0-9][A-Z0-9-]{2,}\b"


def citations(found: DataFrame, catalog: DataFrame) -> DataFrame:
    """(site, id, check_id, cited): ids that the evidence of a finding names and that no check has; warnings only."""
    named = F.array_distinct(F.regexp_extract_all(F.coalesce("evidence", F.lit("")), F.lit(CITED), F.lit(0)))
    rows = found.select("site", "id", "check_id", F.explode(named).alias("cited")).filter("cited <> check_id")
    return rows.join(F.broadcast(catalog.select(F.col("check_id").alias("cited"))), "cited", "left_anti").select("site", "id", "check_id", "cited")


def invariants(found: DataFrame, counts: DataFrame) -> DataFrame:
    """(site, problem): where a summary (site, critical, high, medium, low) does not agree with the findings (site, id, severity),
    a site has findings without a summary, a severity is unknown, or numbers have gaps."""
    number = F.regexp_extract("id", "^F-([0-9]+)$", 1).try_cast("long")
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    per = found.groupBy("site").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES], F.count_if(F.coalesce(rank, F.lit(0)) == 0).alias("odd"),
        F.max(number).alias("last"), F.count_distinct(number).alias("numbers"),
    )
    rows = counts.join(per, "site", "full")
    none = F.lit(0)
    tests = [(F.coalesce(s, none) != F.coalesce(f"n_{s}", none), f"{s} findings miscounted") for s in SEVERITIES]
    tests += [(F.col("n").isNotNull() & F.col(SEVERITIES[0]).isNull(), "findings without a summary"), (F.col("odd") > 0, "unknown severity"), ((F.col("last") != F.col("n")) | (F.col("numbers") != F.col("n")), "numbers with gaps")]
    problems = F.filter(F.array(*[F.when(test, F.lit(text)) for test, text in tests]), lambda x: x.isNotNull())
    return rows.select("site", F.explode(problems).alias("problem"))


def sections(found: DataFrame, routed: DataFrame, open_: DataFrame, warnings: DataFrame, sites: DataFrame) -> DataFrame:
    """(site, report): what was found, what passed, what needs a look, what was not evaluated, and warnings (site, id, warning),
    each under its heading if there is any of it; sites without results have their counts only."""

    def listed(rows, order, line, name):
        lines = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("line")))), lambda x: x["line"])
        return rows.groupBy("site").agg(F.array_join(lines, "\n").alias(name), F.count(F.lit(1)).alias(f"n_{name}"))

    number = F.regexp_extract("id", "([0-9]+)$", 1).cast("long")
    text = F.coalesce("evidence", F.lit(""))
    head = F.concat(F.lit("- **"), F.col("id"), F.lit("** ("), F.col("severity"), F.lit(", "), F.col("confidence"), F.lit(") "), F.col("check_id"), F.lit(": "), text)
    urls = F.when(F.col("urls") != "", F.concat(F.lit("\n  "), F.col("urls"))).otherwise("")
    passed = routed.filter("route = 'passed'").select("site", "check_id").distinct()
    check = F.concat(F.lit("- "), F.col("check_id"))
    parts = [
        ("Findings", listed(found, number, F.concat(head, urls), "findings")),
        ("Passed", listed(passed, F.col("check_id"), check, "passed")),
        ("To verify", listed(routed.filter("route = 'verify'"), F.struct("check_id", text), F.concat(check, F.lit(": "), text), "verify")),
        ("Not evaluated", listed(open_, F.col("check_id"), check, "open")),
        ("Warnings", listed(warnings, F.struct("id", "warning"), F.concat(F.lit("- "), F.col("id"), F.lit(": "), F.col("warning")), "warnings")),
    ]
    rows = sites.select("site").distinct()
    for _, part in parts:
        rows = rows.join(part, "site", "left")
    bodies = [F.concat(F.lit(f"## {title}\n"), F.col(part.columns[1])) for title, part in parts]
    counts = [F.concat(F.coalesce(f"n_{part.columns[1]}", F.lit(0)).cast("string"), F.lit(f" {title.lower()}")) for title, part in parts[:4]]
    return rows.select("site", F.concat_ws("\n\n", F.concat(F.lit("# "), F.col("site"), F.lit("\n"), F.concat_ws(", ", *counts)), *bodies).alias("report"))


def markdown(found: DataFrame) -> DataFrame:
    """(site, report): a line for each finding, in order."""
    line = F.concat(F.lit("- **"), F.col("id"), F.lit("** ("), F.col("severity"), F.lit(") "), F.col("check_id"), F.lit(": "), F.coalesce("evidence", F.lit("")))
    number = F.regexp_extract("id", "([0-9]+)$", 1).cast("long")  # F-101 comes before F-1000
    lines = F.transform(F.array_sort(F.collect_list(F.struct(number.alias("n"), line.alias("line")))), lambda x: x["line"])
    return found.groupBy("site").agg(F.concat(F.lit("# "), F.col("site"), F.lit("\n"), F.array_join(lines, "\n")).alias("report"))


def assemble(verdicts: DataFrame, measured: DataFrame, catalog: DataFrame, sites: DataFrame) -> DataFrame:
    """Results from verdicts (site, check_id, gate, severity, evidence): the first of each check, with measured evidence
    (site, check_id, measure) where it has none; checks without a verdict and unknown gates are not evaluated."""
    first = first_by(verdicts, ["site", "check_id"], ["ord"])
    all_ = sites.select("site").crossJoin(F.broadcast(catalog.select("check_id", "evidence_quality", "band")))
    rows = all_.join(first, ["site", "check_id"], "left").join(measured, ["site", "check_id"], "left")
    gate = F.when(F.col("gate").isin("finding", "pass", "not_evaluated"), F.col("gate")).otherwise("not_evaluated")
    return rows.select(
        "site", "check_id", gate.alias("gate"),
        F.when(gate == "finding", F.coalesce("severity", F.element_at(F.split("band", " "), -1))).alias("severity"),
        F.coalesce("evidence", "measure").alias("evidence"), "evidence_quality",
    )

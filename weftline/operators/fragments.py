"""What comes back from judges of a site, and what is handed to them: fragments, completed gates, damping, wording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.pages import first_by

GATES = ("finding", "pass", "not_evaluated")
LOWER = (("critical", "high"), ("high", "medium"), ("medium", "low"), ("low", "low"))
LEAST_ANCHORS = 3

#: Fixed values.
HEADERS = ("server", "cf-ray", "cf-mitigated", "last-modified", "cache-control", "content-language", "link")
ABSENCES = ("ANS-QUESTION-UNANSWERED", "FRS-LASTMOD-UNIFORM", "ACC-LLMS-TXT-ABSENT")
CONSUMERS = ("entity", "freshness", "answers")
SAID = (
    (r"\bFAQPage\b", "recommends retired FAQ markup"),
    (r"\bHowTo\b", "recommends retired how-to markup"),
    (r"llms\.txt.{0,80}(rank|discover|citation|visibility)", "llms.txt as a ranking factor"),
    (r"\b(CLS|LCP|INP)\b[^.]{0,40}\d", "made-up field metric"),
    (r"\bguarantee", "guarantee"),
    (r"\bwill (rank|be cited|appear)", "predicted outcome"),
    (r"\bIndexNow\b", "submission is no promise"),
)
SHOWN = ((r"is_soft_404", "field name in evidence"), (r"snapshot\s*\.\s*[a-z_]+", "field name in evidence"))

_RESULTS = "array<struct<check_id: string, gate: string, severity: string, evidence: string>>"


def read_fragments(lines: DataFrame) -> DataFrame:
    """lines (site, name, line) with results and note: null, or why the fragment is left out.

    A line that is no JSON object is unreadable; one without results, or with a result that has no check or no known
    gate, is invalid. Neither has results, so its checks count as not evaluated."""
    read = F.from_json("line", f"results {_RESULTS}, bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    rows = lines.withColumn("read", read)
    wrong = F.exists("read.results", lambda r: r["check_id"].isNull() | ~F.coalesce(r["gate"].isin(*GATES), F.lit(False)))
    note = F.when(F.col("read").isNull() | F.col("read.bad").isNotNull(), "unreadable").when(F.coalesce(wrong, F.lit(True)), "invalid")
    return rows.select("site", "name", F.when(note.isNull(), F.col("read.results")).alias("results"), note.alias("note"))


def fragment_results(fragments: DataFrame) -> DataFrame:
    """(site, name, check_id, gate, severity, evidence) of the fragments that are valid."""
    return fragments.filter("note is null").select("site", "name", F.inline("results"))


def complete_gates(results: DataFrame, completions: DataFrame) -> DataFrame:
    """results (site, check_id, gate, severity) with gates set by completions (site, check_id, ord, gate, reason), and
    outcome: kept, completed or refused.

    The first completion of a check counts. One without a known gate or a reason is refused, and so is a finding of a
    result that has no severity, for no candidate stands behind it. What does not become a finding loses its severity."""
    first = first_by(completions, ["site", "check_id"], ["ord"]).select("site", "check_id", F.col("gate").alias("to"), "reason", F.lit(True).alias("asked"))
    rows = results.join(first, ["site", "check_id"], "left")
    fit = F.coalesce(F.col("to").isin(*GATES), F.lit(False)) & (F.coalesce("reason", F.lit("")) != "") & ((F.col("to") != "finding") | F.col("severity").isNotNull())
    outcome = F.when(F.col("asked").isNull(), "kept").when(fit, "completed").otherwise("refused")
    gate = F.when(outcome == "completed", F.col("to")).otherwise(F.col("gate"))
    severity = F.when((outcome != "completed") | (F.col("to") == "finding"), F.col("severity"))
    return rows.select("site", "check_id", gate.alias("gate"), severity.alias("severity"), F.when(outcome == "completed", F.col("reason")).alias("reason"), outcome.alias("outcome"))


def unknown_completions(results: DataFrame, completions: DataFrame) -> DataFrame:
    """(site, check_id) of completions that name no result."""
    return completions.select("site", "check_id").distinct().join(results.select("site", "check_id"), ["site", "check_id"], "left_anti")


def damped(results: DataFrame, presence: DataFrame) -> DataFrame:
    """results (site, check_id, gate, severity) with severity and anchors: findings of ABSENCES are one step lower on sites
    that LEAST_ANCHORS independent addresses, which resolve and show the name, speak of. Nothing else is lowered."""
    good = (F.col("ownership") == "independent") & F.col("http_status").between(200, 399) & F.col("brand_name_match")
    anchors = presence.groupBy("site").agg(F.count_if(good).alias("anchors"))
    rows = results.join(anchors, "site", "left").withColumn("anchors", F.coalesce("anchors", F.lit(0)))
    lower = F.col("severity")
    for severity, below in LOWER:
        lower = F.when(F.col("severity") == severity, below).otherwise(lower)
    applies = (F.col("gate") == "finding") & F.col("check_id").isin(*ABSENCES) & (F.col("anchors") >= LEAST_ANCHORS)
    return rows.select("site", "check_id", "gate", F.when(applies, lower).otherwise(F.col("severity")).alias("severity"), "anchors")


def warnings(texts: DataFrame) -> DataFrame:
    """(site, field, warning) of texts (site, field, text): what titles, actions and summaries must not promise, and names
    of fields in evidence. Warnings only; a null text has none."""

    def of(rules, flags: str) -> Column:
        return F.array(*[F.struct(F.lit(flags + p).alias("pattern"), F.lit(w).alias("warning")) for p, w in rules])

    rules = F.when(F.col("field") == "evidence", of(SHOWN, "")).otherwise(of(SAID, "(?i)"))
    hit = F.filter(rules, lambda r: F.coalesce(F.rlike(F.col("text"), r["pattern"]), F.lit(False)))
    return texts.select("site", "field", F.explode(F.transform(hit, lambda r: r["warning"])).alias("warning"))


def kept_headers(headers: Column) -> list[Column]:
    """A column for each of HEADERS, from a map of header names in any case; null where there is none."""
    return [F.try_element_at(F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == h)), F.lit(1)).alias(h.replace("-", "_")) for h in HEADERS]


def handed(findings: DataFrame, consumers: tuple[str, ...] = CONSUMERS) -> DataFrame:
    """Each finding once for every consumer, a fixed handful."""
    return findings.select("*", F.explode(F.array(*map(F.lit, consumers))).alias("consumer"))


def write_handed(rows: DataFrame, folder: str) -> None:
    """JSON lines in a folder for each consumer; rows of one consumer are spread over files as they come."""
    rows.write.mode("overwrite").partitionBy("consumer").json(folder)

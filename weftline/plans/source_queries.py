"""Queries of snapshots, probe logs and the stream, over what the given tables make of them, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import checks
from ..sources import pages as sources
from ..sources import probe_logs, snapshots
from ..sources.scratch import new_folder
from ..streaming.reaudit import current, site_audit_stream
from .audit_queries import query
from .site_queries import ORACLES, PG, table

_CAP = 3_000  # of this query, so that pages of a few thousand bytes are cut too


@query(
    "snapshot_bodies",
    rf"""WITH {PG} SELECT page_id AS ord, site, url AS requested_url, CASE WHEN page_id % 3 = 0 THEN 'tiny' ELSE 'page' END AS purpose, CASE WHEN page_id % 2 = 0 THEN 'gzip' ELSE 'identity' END AS encoding,
    CASE WHEN page_id % 3 > 0 THEN octet_length(encode(html)) WHEN page_id % 2 = 1 THEN least(octet_length(encode(html)), {_CAP}) END::INTEGER AS n_bytes,
    TRUE AS begins_page, CASE WHEN page_id % 3 > 0 THEN FALSE WHEN page_id % 2 = 1 THEN octet_length(encode(html)) > {_CAP} END AS cut FROM pg""",
)
def snapshot_bodies(spark, sf_dir):
    """Pages written as a snapshot and read again: half of the bodies are gzip, a third of them read up to a small cap. How much of
    a cut gzip body can be read, is its stream's affair: not told, but that it begins the page."""
    pages = sources.read_pages(spark, sf_dir)
    i = F.col("page_id")
    fetches = pages.select(
        "site", i.alias("ord"), F.when(i % 3 == 0, "tiny").otherwise("page").alias("purpose"), F.col("url").alias("requested_url"), F.col("url").alias("final_url"), F.lit(200).alias("status"),
        F.create_map(F.lit("content-encoding"), F.when(i % 2 == 0, "gzip").otherwise("identity")).alias("headers"), F.col("html").cast("binary").alias("body"),
        F.lit(None).cast("string").alias("error"), (i % 2 == 0).alias("zip"),
    )
    folder = new_folder(spark, "snapshot")
    snapshots.write_snapshot(fetches.mapInArrow(snapshots.zipped, fetches.schema).drop("zip"), folder)
    read = snapshots.read_snapshot(spark, folder, caps=snapshots.CAPS | {"tiny": _CAP})
    both = read.join(pages.select(i.alias("ord"), F.col("html").cast("binary").alias("html")), "ord")
    encoding = F.col("headers")["content-encoding"]
    whole = (encoding == "identity") | (F.col("purpose") == "page")
    begins = (F.octet_length("body") > 0) & (F.substring("html", F.lit(1), F.octet_length("body")) == F.col("body"))
    return both.select(
        "ord", "site", "requested_url", "purpose", encoding.alias("encoding"), F.when(whole, F.octet_length("body")).alias("n_bytes"), begins.alias("begins_page"), F.when(whole, F.col("cut")).alias("cut")
    )


_OUT = [*probe_logs.OUTCOMES, "unsure"]
#: The log of each conversation: a line or more for each turn, some of them odd.
_LINES_SQL = f"""logs AS (SELECT conv_id AS file, CASE WHEN conv_id % 11 = 0 THEN '' ELSE 'Engine: e' || (conv_id % 3) || chr(10) END || CASE WHEN conv_id % 17 = 0 THEN 'note: early' || chr(10) ELSE '' END
    || 'timestamp: 2026-01-0' || (1 + conv_id % 9) || 'T00:00:00' || CASE WHEN conv_id % 13 = 0 THEN '' ELSE 'Z' END || chr(10) || string_agg(line, chr(10) ORDER BY turn) AS text
  FROM (SELECT conv_id, turn, '[Q-' || (turn % 7) || '] ' || CASE WHEN turn % 4 = 3 THEN 'navigational' WHEN turn % 9 = 8 THEN 'brand' ELSE '-' END || '  ' || {_OUT}[1 + (conv_id + turn) % 8]
    || CASE WHEN turn % 2 = 0 THEN chr(10) || ' https://x/' || turn || chr(10) || '# remark' ELSE '' END || CASE WHEN turn % 3 = 0 THEN chr(10) || 'Note: ' || role ELSE '' END || CASE WHEN turn % 5 = 4 THEN chr(10) || 'what is ' || role ELSE '' END AS line FROM conversations) GROUP BY conv_id),
kinds AS (SELECT *, CASE WHEN t = '' OR starts_with(t, '#') THEN 'blank' WHEN starts_with(lower(t), 'engine:') THEN 'engine' WHEN starts_with(lower(t), 'timestamp:') THEN 'timestamp' WHEN regexp_matches(t, '{probe_logs.HEAD}') THEN 'entry'
    WHEN starts_with(lower(t), 'note:') THEN 'note' WHEN regexp_matches(t, '^https?://') THEN 'url' ELSE 'odd' END AS kind, trim(regexp_replace(t, '^[^:]*:', '')) AS rest,
    regexp_extract(t, '{probe_logs.HEAD}', 1) AS question_id, regexp_extract(t, '{probe_logs.HEAD}', 2) AS label, regexp_extract(t, '{probe_logs.HEAD}', 3) AS outcome
  FROM (SELECT file, line, trim(line) AS t, line_no FROM (SELECT file, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM logs))),
k AS (SELECT *, count(*) FILTER (WHERE kind = 'entry') OVER (PARTITION BY file ORDER BY line_no) AS entry FROM kinds),
f AS (SELECT file, arg_max(rest, line_no) FILTER (WHERE kind = 'engine') AS engine, arg_max(rest, line_no) FILTER (WHERE kind = 'timestamp') AS timestamp, max(entry) AS entries FROM k GROUP BY file)"""


def _logs(spark, sf_dir):
    c, t = F.col("conv_id"), F.col("turn")
    text = F.lit
    line = F.concat(
        text("[Q-"), (t % 7).cast("string"), text("] "), F.when(t % 4 == 3, "navigational").when(t % 9 == 8, "brand").otherwise("-"), text("  "), F.get(F.array(*map(text, _OUT)), ((c + t) % 8).cast("int")),
        F.when(t % 2 == 0, F.concat(text("\n https://x/"), t.cast("string"), text("\n# remark"))).otherwise(""), F.when(t % 3 == 0, F.concat(text("\nNote: "), "role")).otherwise(""),
        F.when(t % 5 == 4, F.concat(text("\nwhat is "), "role")).otherwise(""),
    )
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n")
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(lines.alias("lines"))
    head = F.concat(
        F.when(c % 11 == 0, "").otherwise(F.concat(text("Engine: e"), (c % 3).cast("string"), text("\n"))), F.when(c % 17 == 0, "note: early\n").otherwise(""),
        text("timestamp: 2026-01-0"), (1 + c % 9).cast("string"), text("T00:00:00"), F.when(c % 13 == 0, "").otherwise("Z"), text("\n"),
    )
    return probe_logs.split_lines(rows.select(c.alias("file"), F.concat(head, "lines").alias("text")))


@query(
    "probe_log_entries",
    f"""WITH {_LINES_SQL} SELECT file, entry, min(line_no)::INTEGER AS line_no, any_value(engine) AS engine, any_value(timestamp) AS timestamp, max(question_id) AS question_id, nullif(max(label), '-') AS label, max(outcome) AS outcome,
    coalesce(string_agg(t, '|' ORDER BY line_no) FILTER (WHERE kind = 'url'), '') AS cited_urls, arg_max(rest, line_no) FILTER (WHERE kind = 'note') AS notes FROM k JOIN f USING (file) WHERE entry > 0 GROUP BY file, entry""",
)
def probe_log_entries(spark, sf_dir):
    return probe_logs.entries(_logs(spark, sf_dir)).withColumn("cited_urls", F.array_join("cited_urls", "|"))


@query(
    "probe_log_errors",
    rf"""WITH {_LINES_SQL}, h AS (SELECT *, count(*) FILTER (WHERE label = 'navigational') OVER (PARTITION BY file ORDER BY line_no) AS nav, row_number() OVER (PARTITION BY file, question_id ORDER BY line_no) AS nth FROM k WHERE kind = 'entry')
    SELECT file, line_no::INTEGER AS line_no, problem FROM (
      SELECT file, line_no, CASE WHEN kind = 'entry' AND outcome NOT IN {probe_logs.OUTCOMES} THEN 'unknown outcome ' || outcome WHEN kind = 'entry' AND label NOT IN ('-', 'navigational') THEN 'unknown label ' || label
        WHEN kind = 'note' AND entry = 0 THEN 'note before any entry' WHEN kind = 'url' AND entry = 0 THEN 'link before any entry' WHEN kind = 'odd' THEN 'cannot read ' || substring(line, 1, 80) END AS problem FROM k
      UNION ALL SELECT file, line_no, 'more than 6 entries' FROM h WHERE entry = 7
      UNION ALL SELECT file, line_no, 'more than 1 navigational' FROM h WHERE label = 'navigational' AND nav = 2
      UNION ALL SELECT file, line_no, 'repeated ' || question_id FROM h WHERE nth = 2
      UNION ALL SELECT file, line_no, 'never asked ' || question_id FROM h WHERE question_id = 'Q-0'
      UNION ALL SELECT file, NULL, 'no engine' FROM f WHERE coalesce(engine, '') = ''
      UNION ALL SELECT file, NULL, 'no timestamp' FROM f WHERE coalesce(timestamp, '') = ''
      UNION ALL SELECT file, NULL, 'time not in UTC' FROM f WHERE timestamp <> '' AND NOT regexp_matches(timestamp, '{probe_logs.TIME}')
      UNION ALL SELECT file, NULL, 'no entries' FROM f WHERE entries = 0) WHERE problem IS NOT NULL""",
)
def probe_log_errors(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").select(F.concat(F.lit("Q-"), (1 + F.col("turn") % 6).cast("string")).alias("question_id")).distinct()
    more = spark.range(1, 7).select(F.concat(F.lit("Q-"), F.col("id").cast("string")).alias("question_id"))
    return probe_logs.errors(_logs(spark, sf_dir), asked.unionByName(more).distinct())


@query("streamed_viewport_absent", ORACLES["viewport_absent"])
def streamed_viewport_absent(spark, sf_dir):
    """The check of a whole site, from pages that come in three batches."""
    folder = new_folder(spark, "stream")
    raw = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    raw.repartition(3, F.xxhash64("page_id")).write.parquet(f"{folder}/in")
    files = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    pages = files.withColumn("site", urls.authority(F.col("url")))

    def audit(rows):
        return checks.viewport_absent(rows.withColumn("has_viewport", F.col("html").rlike('<meta name="viewport"'))).select("site", "check_id", "gate", "severity", "evidence")

    site_audit_stream(pages, audit, f"{folder}/out", f"{folder}/store", f"{folder}/state").awaitTermination()
    return current(spark, f"{folder}/out").select("site", "check_id", "gate", "severity", "evidence")


@query(
    "probe_log",
    f"""WITH {_LINES_SQL} SELECT file, any_value(engine) AS engine, max(entry) AS entries, count(*) FILTER (WHERE kind = 'url' AND entry > 0) AS cited, count(*) FILTER (WHERE kind = 'odd') AS errors FROM k JOIN f USING (file) GROUP BY file""",
)
def probe_log(spark, sf_dir):
    """What each log holds: its engine, entries, links, and lines that cannot be read."""
    lines = _logs(spark, sf_dir)
    found = probe_logs.entries(lines).groupBy("file").agg(F.max("engine").alias("engine"), F.max("entry").alias("entries"), F.sum(F.size("cited_urls")).cast("long").alias("cited"))
    odd = probe_logs.errors(lines).filter(F.startswith("problem", F.lit("cannot read"))).groupBy("file").agg(F.count(F.lit(1)).alias("errors"))
    return found.join(odd, "file", "left").select("file", "engine", "entries", "cited", F.coalesce("errors", F.lit(0)).alias("errors"))

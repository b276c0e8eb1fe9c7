"""Probe logs: text files of one run each, read line by line as rows.

A line says what engine or time holds from it on, begins an entry, or adds a link or a note to the entry above it; the last
seen entry of a file is a window over its lines, so files are independent and only a file's own lines are in order. Lines that
cannot be read are errors with their number, beside the entries, and do not stop the others. Of a file the last engine and time
count, as they may come anywhere. A file as a whole has errors too: no engine, no time or one that is not in UTC, no entries, too
many of them, and questions that stand twice or were never asked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the grammar.
OUTCOMES = ("official-cited", "third-party-cited", "mentioned-not-cited", "absent", "wrong-entity", "fact-stated-wrongly", "unhelpful-landing")
MOST_PROBES, MOST_NAVIGATIONAL = 6, 1
TIME = "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"
HEAD = r"^\[([A-Za-z0-9_-]+)\][ \t\x0B\f]+(\S+)[ \t\x0B\f]+(\S+)$"
_SPACE = r"^[ \t\r\x0B\f]+|[ \t\r\x0B\f]+$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of a folder of logs; files are read whole, as they are short."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return split_lines(files.select("file", F.col("value").alias("text")))


def split_lines(logs: DataFrame) -> DataFrame:
    """(file, line_no, line) of logs (file, text)."""
    lines = F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")
    return logs.select("file", F.posexplode(lines).alias("at", "line")).select("file", (F.col("at") + 1).alias("line_no"), "line")


def _kinds(lines: DataFrame) -> DataFrame:
    """lines with what each is, and the number of the entry that it is in."""
    rows = lines.withColumn("t", F.regexp_replace("line", _SPACE, ""))
    low = F.lower("t")
    kind = (
        F.when((F.col("t") == "") | F.startswith("t", F.lit("#")), "blank").when(F.startswith(low, F.lit("engine:")), "engine").when(F.startswith(low, F.lit("timestamp:")), "timestamp")
        .when(F.rlike("t", F.lit(HEAD)), "entry").when(F.startswith(low, F.lit("note:")), "note").when(F.rlike("t", F.lit("^https?://")), "url").otherwise("odd")
    )
    rows = rows.withColumn("kind", kind)
    so_far = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("entry", F.count_if(F.col("kind") == "entry").over(so_far))
    for i, name in enumerate(("question_id", "label", "outcome"), 1):
        rows = rows.withColumn(name, F.when(F.col("kind") == "entry", F.regexp_extract("t", HEAD, i)))
    return rows.withColumn("rest", F.when(F.col("kind").isin("engine", "timestamp", "note"), F.trim(F.regexp_replace("t", "^[^:]*:", ""))))


def errors(lines: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(file, line_no, problem) of lines (file, line_no, line) that break the grammar, and of files that break its rules: those
    have the number of the first line too much, or none. asked (question_id): the questions that may stand in a file."""
    rows = _kinds(lines)
    entry = F.col("kind") == "entry"
    problem = (
        F.when(entry & ~F.col("outcome").isin(*OUTCOMES), F.concat(F.lit("unknown outcome "), "outcome"))
        .when(entry & ~F.col("label").isin("-", "navigational"), F.concat(F.lit("unknown label "), "label"))
        .when((F.col("kind") == "note") & (F.col("entry") == 0), "note before any entry").when((F.col("kind") == "url") & (F.col("entry") == 0), "link before any entry")
        .when(F.col("kind") == "odd", F.concat(F.lit("cannot read "), F.substring("line", 1, 80)))
    )
    own = rows.select("file", "line_no", problem.alias("problem"))

    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    again = Window.partitionBy("file", "question_id").orderBy("line_no")
    heads = rows.filter(entry).withColumn("navigational", F.count_if(F.col("label") == "navigational").over(order)).withColumn("nth", F.row_number().over(again))
    tests = [
        (F.col("entry") == MOST_PROBES + 1, F.lit(f"more than {MOST_PROBES} entries")),
        ((F.col("label") == "navigational") & (F.col("navigational") == MOST_NAVIGATIONAL + 1), F.lit(f"more than {MOST_NAVIGATIONAL} navigational")),
        (F.col("nth") == 2, F.concat(F.lit("repeated "), "question_id")),
    ]
    found = F.filter(F.array(*[F.when(test, text) for test, text in tests]), lambda x: x.isNotNull())
    of_heads = heads.select("file", "line_no", F.explode(found).alias("problem"))

    files = _files(rows)
    time = F.col("timestamp")
    lacks = [
        (F.coalesce("engine", F.lit("")) == "", "no engine"), (F.coalesce(time, F.lit("")) == "", "no timestamp"),
        ((time != "") & ~time.rlike(TIME), "time not in UTC"), (F.col("entries") == 0, "no entries"),
    ]
    found = F.filter(F.array(*[F.when(test, F.lit(text)) for test, text in lacks]), lambda x: x.isNotNull())
    of_files = files.select("file", F.lit(None).cast("int").alias("line_no"), F.explode(found).alias("problem"))
    out = own.filter("problem IS NOT NULL").unionByName(of_heads).unionByName(of_files)
    if asked is not None:
        strange = rows.filter(entry).join(asked.select("question_id"), "question_id", "left_anti")
        out = out.unionByName(strange.select("file", "line_no", F.concat(F.lit("never asked "), "question_id").alias("problem")))
    return out


def _last(kind: str):
    return F.max_by(F.when(F.col("kind") == kind, F.col("rest")), F.when(F.col("kind") == kind, F.col("line_no")))


def _files(rows: DataFrame) -> DataFrame:
    return rows.groupBy("file").agg(_last("engine").alias("engine"), _last("timestamp").alias("timestamp"), F.max("entry").alias("entries"))


def entries(lines: DataFrame) -> DataFrame:
    """(file, entry, line_no, engine, timestamp, question_id, label, outcome, cited_urls, notes): the entries of lines, links in
    their order, of several notes the last; a label of `-` is null. Files with errors have their entries too: who wants whole
    files only, leaves out those that errors() names."""
    rows = _kinds(lines)
    links = F.array_sort(F.collect_list(F.when(F.col("kind") == "url", F.struct("line_no", "t"))))
    found = rows.filter("entry > 0").groupBy("file", "entry").agg(
        F.min("line_no").alias("line_no"), F.max("question_id").alias("question_id"), F.nullif(F.max("label"), F.lit("-")).alias("label"), F.max("outcome").alias("outcome"),
        F.transform(links, lambda x: x["t"]).alias("cited_urls"), _last("note").alias("notes"),
    )
    columns = ["file", "entry", "line_no", "engine", "timestamp", "question_id", "label", "outcome", "cited_urls", "notes"]
    return found.join(_files(rows), "file").select(columns)

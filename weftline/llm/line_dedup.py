"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of (h1, h2, docs, total): the 128-bit hash of a line's key, in how many documents of the run's batches it
was, and in how many of all batches up to then. Runs are bucketed by hash and sorted in their buckets, all into the same
number of buckets, so that merge joins with them need no exchange. Batches make runs of level 0; when a level has FANOUT
runs, they are compacted into one run of the next level before the next batch comes.

A batch is merge-anti-joined with the keys of each run that are known to be frequent, which need no more counting; what is
left takes its counts so far from the runs and becomes a run of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import materialize, new_path, remove, shuffle_partitions

FANOUT = 4
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ["h1", "h2"]
SMALL = 500_000  # frequent keys up to which they are broadcast; beyond, they are dealt SALTS times
SALTS = 16


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def line_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, t, at, h1, h2): a row for each line of docs: its document, its place and its key's hash.

    k and t (a hash of the text) name the document. Lines with empty keys have no row."""
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    lines = rows.select("k", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.select("k", "t", "at", line_key(F.col("line")).alias("key")).filter("key <> ''")
    return lines.select("k", "t", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


class LineRuns:
    """The levels of runs. levels[i] holds the tables of level i, so that the driver keeps names only.

    least: in how many documents a key is frequent."""

    def __init__(self, spark: SparkSession, least: int = 10, fanout: int = FANOUT):
        self.spark, self.least, self.fanout = spark, least, fanout
        self.buckets, self.levels, self.paths = shuffle_partitions(spark), [[]], {}

    def _runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def _write(self, run: DataFrame) -> str:
        name, path = f"line_run_{uuid.uuid4().hex}", new_path(self.spark, "line-run")
        run.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", path).format("parquet").saveAsTable(name)
        self.paths[name] = path
        return name

    def _rows(self, names: list[str]) -> DataFrame:
        """Rows of several runs, as plain files: a union of bucketed scans does not line their buckets up."""
        schema = "h1 long, h2 long, docs long, total long"
        paths = [self.paths[name] for name in names]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _all(self) -> DataFrame:
        return self._rows([name for level in self.levels for name in level])

    def counts(self) -> DataFrame:
        """(h1, h2, docs) over all runs; of frequent keys, up to the batch that made them so."""
        return self._all().groupBy(*HASH).agg(F.sum("docs").alias("docs"))

    def frequent(self) -> DataFrame:
        """(h1, h2) of the keys that are in at least `least` documents. Each is so in one run."""
        return self._all().filter(F.col("total") >= self.least).select(*HASH)

    def unseen(self, keys: DataFrame) -> DataFrame:
        """Rows of keys that no run holds: merge anti-joins, one for each run."""
        for run in self._runs():
            keys = keys.join(run.select(*HASH).hint("merge"), HASH, "left_anti")
        return keys

    def compact(self) -> None:
        """Merge the runs of each level that is full into one of the next."""
        for level in range(len(self.levels)):
            if len(self.levels[level]) < self.fanout:
                continue
            old, self.levels[level] = self.levels[level], []
            merged = self._write(self._rows(old).groupBy(*HASH).agg(F.sum("docs").alias("docs"), F.max("total").alias("total")))
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(merged)
            for name in old:
                self.spark.sql(f"DROP TABLE {name}")
                remove(self.spark, self.paths.pop(name))

    def add(self, batch: DataFrame) -> None:
        """Add a batch's (h1, h2), one row per document and key, as a run."""
        self.compact()
        rows = batch.groupBy(*HASH).agg(F.count(F.lit(1)).alias("docs"))
        total = F.col("docs")
        for i, run in enumerate(self._runs()):
            rows = rows.join(run.filter(F.col("total") >= self.least).select(*HASH).hint("merge"), HASH, "left_anti")
            held = run.filter(F.col("total") < self.least).select(*HASH, F.col("docs").alias(f"held_{i}"))
            rows = rows.join(held.hint("merge"), HASH, "left")
            total = total + F.coalesce(F.col(f"held_{i}"), F.lit(0))
        self.levels[0].append(self._write(rows.select(*HASH, "docs", total.alias("total"))))


def new_lines(batch: DataFrame, runs: LineRuns, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, at): the lines of a batch whose keys no earlier batch had. The batch's own keys join the runs."""
    table = materialize(line_table(batch, key, text), "lines")
    fresh = materialize(runs.unseen(table).select(F.col("k").alias(key), "at"), "new-lines")
    runs.add(table.select("k", "t", *HASH).distinct().select(*HASH))
    return fresh


def _in_frequent(table: DataFrame, frequent: DataFrame) -> DataFrame:
    """Rows of table whose keys are frequent. A key that very many lines have goes to many tasks: frequent keys are
    broadcast up to SMALL of them and otherwise dealt SALTS times, with the lines spread over the copies."""
    if frequent.count() <= SMALL:
        return table.join(F.broadcast(frequent), HASH, "left_semi")
    copies = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return table.withColumn("salt", F.pmod(F.xxhash64("k", "t", "at"), F.lit(SALTS)).cast("int")).join(copies, [*HASH, "salt"], "left_semi").drop("salt")


def drop_frequent_lines(docs: DataFrame, least: int = 10, batches: int = 4, key: str = "doc_id", text: str = "text", keep=()) -> DataFrame:
    """(key, *keep, text, n_lines, n_dropped): docs without the lines whose keys are in at least `least` documents.

    Rows alike in key and text count as one document. Null and empty texts are one empty line, which stays; so do lines of
    white space. The documents go through the runs in batches by a hash of the key. Repeated rows stay and are treated
    alike. Columns that are kept can have any names but key, text, n_lines and n_dropped."""
    kept = F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`") for c in keep]).alias("kept")
    rows = docs.select(F.col(key).alias("k"), kept, F.coalesce(F.col(text), F.lit("")).alias("text"))
    table = line_table(docs, key, text).withColumn("batch", F.pmod(F.xxhash64("k"), F.lit(batches)))
    table = materialize(table, "lines", "batch")
    runs = LineRuns(docs.sparkSession, least)
    for i in range(batches):
        runs.add(table.filter(F.col("batch") == i).select("k", "t", *HASH).distinct().select(*HASH))
    runs.compact()  # no batch comes that would do so
    found = _in_frequent(table, materialize(runs.frequent(), "frequent"))
    drops = found.groupBy(F.col("k").alias("dk"), F.col("t").alias("dt")).agg(F.collect_set("at").alias("drop"))
    rows = rows.withColumn("t", F.xxhash64("text"))
    joined = rows.join(drops, F.col("k").eqNullSafe(F.col("dk")) & (F.col("t") == F.col("dt")), "left")
    lines = joined.withColumn("lines", F.split("text", "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drop")  # in order; drop holds places once
    stay = F.transform(left, lambda i: F.get("lines", i))
    lines = lines.withColumn("stay", F.when(F.col("drop").isNull(), F.col("lines")).otherwise(stay))
    return lines.select(
        F.col("k").alias(key),
        *[F.col(f"kept.`{c}`") for c in keep],
        F.array_join("stay", "\n").alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("stay")).cast("long").alias("n_dropped"),
    )

"""Phrases found in many runs of text by an index of the runs' words.

A phrase is in a run if the folded run holds the folded phrase, so its first word may be the end of a word there and its
last word the beginning of one; all words between are whole. For each phrase the slot that fewest runs have is looked up:
one of the whole words, or, in phrases of one or two words, words of the vocabulary that hold the phrase's word at that end,
which are found by a gram of three characters. The texts are fetched and read for the runs found this way only.

Where phrases grow with the texts, most of their words are in very many runs. stands() looks phrases up whole: by the hashes
of their first and last bytes, and how far these are apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts
from ..sources.pages import first_by
from ..sources.scratch import written

GRAM = 3
FEW = 100_000  # rows that are broadcast; more are joined by shuffles
BITS = 1 << 27  # of the broadcast bitmap of hashes: 16 MB
PROBES = 3  # places of a hash in it
PART = 1 << 20  # bytes of text that are hashed at once
_ESCAPED = r"([\\^$.|?*+()\[\]{}])"


def find_offset(text: Column, phrase: Column) -> Column:
    """Where a phrase begins in a text, in characters from 0: as it is, or else with white space folded in both; null if it is
    not there. The offset is that of the text as it is, whatever white space stands in it."""
    exact = F.instr(text, phrase)
    loose = F.replace(F.regexp_replace(texts.fold_spaces(phrase), F.lit(_ESCAPED), F.lit(r"\\$1")), F.lit(" "), F.lit(texts.SPACE + "+"))
    there = F.contains(texts.fold_spaces(text), texts.fold_spaces(phrase))
    before = F.call_function("regexp_extract", text, F.concat(F.lit("(?s)^(.*?)"), loose), F.lit(1))
    return F.when(exact > 0, exact - 1).when(there, F.length(before))


def _small(rows: DataFrame) -> DataFrame:
    """rows, written; to be broadcast if there are FEW at most."""
    rows = written(rows, "phrases")
    return F.broadcast(rows) if rows.count() <= FEW else rows


def hits(phrases: DataFrame, runs: DataFrame, key: str = "run") -> DataFrame:
    """(phrase_id, key, offset) for each run (key, text) that holds a phrase (phrase_id, phrase), once for each pair; phrases and
    texts that are null or blank hold nothing. Keys of runs and ids of phrases tell rows apart.

    Runs are split into words twice: to count the runs of the words that phrases ask for, and to find those of the words looked
    up. As long as FEW slots, words or pairs are at hand, nothing of the runs is shuffled but these counts."""
    asked = phrases.select("phrase_id", F.col("phrase"), F.split(texts.fold_spaces(F.col("phrase")), " ").alias("ws")).filter("phrase IS NOT NULL AND ws[0] <> ''")
    words = runs.select(key, F.explode(F.array_distinct(F.split(texts.fold_spaces(F.col("text")), " "))).alias("word")).filter("word <> ''")
    counted = [F.count(F.lit(1)).alias("runs")]

    inner = asked.filter(F.size("ws") >= 3).select("phrase_id", F.posexplode(F.slice("ws", F.lit(2), F.size("ws") - 2)).alias("slot", "word"))
    wanted = words.join(_small(inner.select("word").distinct()), "word").groupBy("word").agg(*counted)
    found = inner.join(wanted, "word").select("phrase_id", "slot", "word", "runs")

    short = asked.filter(F.size("ws") <= 2)
    if not short.isEmpty():
        n = F.size("ws")
        slot = lambda i, word, gram: F.struct(F.lit(i).alias("slot"), word.alias("part"), gram.alias("gram"))
        head, tail = F.get("ws", F.lit(0)), F.get("ws", n - 1)
        ends = F.when(n == 1, F.array(slot(0, head, F.left(head, F.lit(GRAM))))).otherwise(F.array(slot(0, head, F.right(head, F.lit(GRAM))), slot(1, tail, F.left(tail, F.lit(GRAM)))))
        outer = _small(short.select("phrase_id", n.alias("n"), F.explode(ends).alias("s")).select("phrase_id", "n", "s.*"))
        at = F.sequence(F.lit(1), F.length("word"))

        def parts(size):
            return F.transform(at, lambda i: F.substring(F.col("word"), i, F.lit(size)))

        vocabulary = words.groupBy("word").agg(*counted)
        grams = vocabulary.select("word", "runs", F.explode(F.array_distinct(F.concat(*map(parts, range(1, GRAM + 1))))).alias("gram"))
        fits = F.when(F.col("n") == 1, F.contains("word", F.col("part"))).when(F.col("slot") == 0, F.endswith("word", F.col("part"))).otherwise(F.startswith("word", F.col("part")))
        found = found.unionByName(grams.join(outer, "gram").filter(fits).select("phrase_id", "slot", "word", "runs"))

    found = written(found, "phrase_words")
    rarest = first_by(found.groupBy("phrase_id", "slot").agg(F.sum("runs").alias("cost")), ["phrase_id"], ["cost", "slot"]).select("phrase_id", "slot")
    looked = _small(found.join(rarest, ["phrase_id", "slot"]).select("phrase_id", "word"))
    pairs = words.join(looked, "word").select("phrase_id", key).distinct()
    pairs = _small(pairs.join(asked.select("phrase_id", "phrase"), "phrase_id"))
    read = runs.select(key, "text").join(pairs, key)
    return read.select("phrase_id", key, find_offset(F.col("text"), F.col("phrase")).alias("offset")).filter("offset IS NOT NULL")


# ---- whole phrases by two grams -------------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _grams(data: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(level, hashes): hashes of the 2**level bytes from each place of data, for levels up to most."""
    found = _mixed((data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    yield 0, found
    for level in range(most):
        half = 1 << level
        if len(found) <= half:
            return
        found = _mixed(found[:-half] * np.uint64(0x9E3779B97F4A7C15) + found[half:])
        yield level + 1, found


def _bits(hashes: np.ndarray) -> list[np.ndarray]:
    """The PROBES places of each hash in a bitmap of BITS bits."""
    return [(hashes >> np.uint64(18 * i) & np.uint64(BITS - 1)).astype(np.int64) for i in range(PROBES)]


def _parts(batch: pa.RecordBatch, text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, bytes, starts, ends) of rows with PART bytes of text or one row: its texts one after another."""
    ends = np.cumsum(np.asarray(pc.binary_length(batch.column(text)), np.int64))
    first = 0
    while first < len(ends):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + PART, "right")))
        rows = batch.slice(first, last - first)
        stop = ends[first:last] - done
        yield rows, np.frombuffer(b"".join(rows.column(text).cast(pa.binary()).to_pylist()), np.uint8), np.r_[0, stop[:-1]], stop
        first = last


def _ends_of(phrases: DataFrame) -> DataFrame:
    """(id, level, head, tail, gap) of phrases (id, text), folded and not empty: hashes of their first and last 2**level bytes,
    which cover them, and how far the one begins after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, starts, ends in _parts(batch, 1):
                level = np.log2(ends - starts).astype(np.int64)
                head, tail = np.zeros(len(level), np.uint64), np.zeros(len(level), np.uint64)
                for n, hashes in _grams(data, int(level.max())):
                    own = level == n
                    head[own], tail[own] = hashes[starts[own]], hashes[ends[own] - (1 << n)]
                out = [rows.column(0), level, head.view(np.int64), tail.view(np.int64), ends - starts - (1 << level)]
                yield pa.RecordBatch.from_arrays([out[0], *map(pa.array, out[1:])], names=["id", "level", "head", "tail", "gap"])

    return phrases.mapInArrow(run, "id long, level long, head long, tail long, gap long")


def _bitmap_of(keys: DataFrame) -> np.ndarray:
    """The bitmap of hashes, gathered as words of 64 bits: BITS / 64 of them at most reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.unique(np.concatenate(_bits(np.asarray(batch.column(0)).view(np.uint64))))
            place, first = np.unique(bit >> 6, return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (bit & 63).astype(np.uint64), first) if len(bit) else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(value.view(np.int64))], names=["place", "bits"])

    rows = keys.mapInArrow(run, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[np.asarray(rows["place"])] = np.asarray(rows["bits"]).view(np.uint64)
    return out


def _places(texts_: DataFrame, bitmap: np.ndarray, levels: set[int]) -> DataFrame:
    """(run, key, at): where in texts (run, text) grams of the levels stand whose hashes are in the bitmap."""
    shared = texts_.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for rows, data, starts, ends in _parts(batch, 1):
                if not len(data):
                    continue
                for level, hashes in _grams(data, min(max(levels), int((ends - starts).max()).bit_length() - 1)):
                    if level not in levels:
                        continue
                    at = np.arange(len(hashes))
                    for i in range(PROBES):
                        bit = (hashes[at] >> np.uint64(18 * i) & np.uint64(BITS - 1)).astype(np.int64)
                        at = at[(known[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(bool)]
                    row = np.searchsorted(ends, at, "right")
                    within = at + (1 << level) <= ends[row]
                    at, row = at[within], row[within]
                    if len(at):
                        yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(row)), pa.array(hashes[at].view(np.int64)), pa.array(at - starts[row])], names=["run", "key", "at"])

    return texts_.mapInArrow(run, "run long, key long, at long")


def holding(phrases: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, run) for each line (run, text) that holds a phrase (id, text), white space folded in both; ids and runs are longs.

    The first and the last 2**level bytes of a phrase cover it for the largest level that fits, so it stands where both do, as
    far apart as in the phrase; both are known by hashes of 64 bits. Of the lines only places of such grams are shuffled, and
    the rarer of the two finds the places to look at: what is compared grows with what is found, not with phrases times lines."""
    phrases = phrases.select("id", texts.fold_spaces(F.col("text")).alias("text")).filter("text <> ''")
    ends = written(_ends_of(phrases), "phrase_ends")
    levels = {r["level"] for r in ends.select("level").distinct().collect()}  # a few dozen at most
    if not levels:
        return ends.select("id", F.col("id").alias("run"))
    bitmap = _bitmap_of(ends.select(F.explode(F.array("head", "tail")).alias("key")))
    places = written(_places(lines.select("run", texts.fold_spaces(F.col("text")).alias("text")), bitmap, levels), "phrase_places")
    many = written(places.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "phrase_counts")
    ends = ends.join(many.select(F.col("key").alias("head"), F.col("n").alias("heads")), "head").join(many.select(F.col("key").alias("tail"), F.col("n").alias("tails")), "tail")
    by_head = F.col("heads") <= F.col("tails")
    near, far = F.when(by_head, F.col("head")).otherwise(F.col("tail")), F.when(by_head, F.col("tail")).otherwise(F.col("head"))
    asked = ends.select("id", near.alias("key"), far.alias("far"), F.when(by_head, F.col("gap")).otherwise(-F.col("gap")).alias("step"))
    maybe = places.join(asked, "key").select("id", "run", F.col("far").alias("key"), (F.col("at") + F.col("step")).alias("at"))
    whole = maybe.filter("at >= 0").join(places, ["run", "key", "at"])
    return whole.select("id", "run").distinct()


def stands(phrases: DataFrame, blocks: DataFrame) -> DataFrame:
    """(phrase_id, runs, pages) of phrases (phrase_id, phrase) that stand in blocks (page_id, ord, line): in how many different
    lines, by hash, and on how many pages. Equal phrases and equal lines are looked up once, so copies of pages don't make pairs."""
    phrases = phrases.withColumn("id", F.xxhash64("phrase")).filter("phrase IS NOT NULL")
    blocks = written(blocks.select("page_id", F.xxhash64("line").alias("run"), F.col("line").alias("text")), "phrase_blocks")
    found = written(holding(phrases.select("id", F.col("phrase").alias("text")).dropDuplicates(["id"]), blocks.select("run", "text").dropDuplicates(["run"])), "phrase_runs")
    runs = found.groupBy("id").agg(F.count(F.lit(1)).alias("runs"))
    pages = blocks.select("run", "page_id").distinct().join(found, "run").select("id", "page_id").distinct().groupBy("id").agg(F.count("page_id").alias("pages"))
    return phrases.select("phrase_id", "id").join(runs.join(pages, "id"), "id").select("phrase_id", "runs", "pages")

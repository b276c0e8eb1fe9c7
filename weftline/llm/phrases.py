"""Phrase collocations by Apriori passes over the levels of word n-grams.

Level 1 counts words. Each further level reads the texts again and counts k-grams, but emits one only when both of its
overlapping (k-1)-grams are frequent. What is broadcast of the frequent (k-1)-grams is a bitmap of BITS bits of their hashes,
so its size does not grow with the corpus: where bits collide a k-gram too many is emitted and then dropped by its count, so
all counts are exact at every size. Tasks count before they send, by exact word numbers of their own.

Every part of a frequent phrase is frequent, so all that scores need, counts of both sides of each cut, is in the tables of
the levels, which are joined by phrase. Null texts count as empty, a null language as `und`; repeated rows count each time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import arrow_schema
from .storage import materialize

LEAST, LONGEST, COVERED, MOST = 30, 4, 80, 2000
BITS = 1 << 27  # of the broadcast bitmap: 16 MB
FLUSH = 1 << 21  # words that a task holds of one language before it sends their counts

#: A-Z in lower case, ends of pieces as line feeds, tabs as spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
_END = b"\xff"  # stands for the end of a piece; no text in UTF-8 has this byte
_COUNTED = "lang string, phrase binary, f long"


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text, with _END between pieces."""
    return text.translate(_FOLD).replace(b"\n", b" \xff ").split() if text else []


def word_hash(lang: bytes, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(lang + _END + word)


def phrase_hash(words: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases: words[i] holds the hashes of their i-th words."""
    out = words[0].copy()
    for more in words[1:]:
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += more
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def _bit(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Places of hashes in a bitmap of so many bits, a power of two."""
    return (hashes >> np.uint64(65 - bits.bit_length())).astype(np.int64)


class _Numbers(dict):
    """Words to numbers in order of their first place."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _Held:
    """Words of one language that a task holds: their numbers in order of the texts, 0 for the end of a piece."""

    def __init__(self, lang: str):
        self.lang, self.numbers, self.texts, self.size = lang, _Numbers({_END: 0}), [], 0

    def add(self, words: list[bytes]) -> None:
        self.texts.append(np.fromiter(map(self.numbers.__getitem__, [*words, _END]), np.int32, len(words) + 1))
        self.size += len(words)

    def counts(self, k: int, frequent: np.ndarray | None) -> tuple[list[bytes], np.ndarray]:
        """Phrases of k words and how often they stand; for words, also the number of all words under the empty phrase.

        frequent: the bitmap of (k-1)-grams."""
        names, line = list(self.numbers), np.concatenate(self.texts)
        if k == 1:
            found = np.bincount(line, minlength=len(names))
            found[0] = 0
            some = np.flatnonzero(found)
            return [b"", *(names[i] for i in some.tolist())], np.r_[found.sum(), found[some]]
        lang = self.lang.encode()
        hashes = np.array([word_hash(lang, w) for w in names], np.uint64)[line]
        places = len(line) - k + 2  # where (k-1)-grams begin
        if places < 2:
            return [], np.empty(0, np.int64)
        bit = _bit(phrase_hash([hashes[i : places + i] for i in range(k - 1)]), 64 * len(frequent))
        known = (frequent[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        for i in range(k - 1):
            known &= line[i : places + i] != 0
        at = np.flatnonzero(known[:-1] & known[1:])
        # Exact numbers of phrases: pairs of the number of all words but the last, and the last word's.
        number, steps = line[at].astype(np.int64), []
        for i in range(1, k):
            step, number = np.unique(number << 32 | line[at + i], return_inverse=True)
            steps.append(step)
        count, parts, number = np.bincount(number), [], np.arange(len(steps[-1]))
        for step in reversed(steps):
            pair = step[number]
            parts.append([names[x] for x in (pair & 0xFFFFFFFF).tolist()])
            number = pair >> 32
        parts.append([names[x] for x in number.tolist()])
        return [b" ".join(p) for p in zip(*reversed(parts))], count


def level(docs: DataFrame, k: int, bitmap: np.ndarray | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """Columns of _COUNTED, one row for each phrase of k words that stands LEAST times; for k = 1 also the empty phrase,
    whose f is the number of all words of a language. bitmap: of the level before."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("l"), F.col(f"`{text}`").cast("string").cast("binary").alias("t"))
    kinds = arrow_schema(_COUNTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Held] = {}
        total = 0

        def send(of: _Held) -> pa.RecordBatch:
            phrases, counts = of.counts(k, shared.value)
            return pa.RecordBatch.from_arrays([pa.array([of.lang] * len(phrases), pa.string()), pa.array(phrases, pa.binary()), pa.array(counts, pa.int64())], schema=kinds)

        for batch in batches:
            for l, t in zip(batch.column("l").to_pylist(), batch.column("t")):  # noqa: E741
                words = words_of(t.as_py())
                if not words:
                    continue
                of = held.setdefault(l, _Held(l))
                of.add(words)
                total += len(words)
                if of.size >= FLUSH:
                    total -= of.size
                    yield send(held.pop(l))
                elif total >= 2 * FLUSH:
                    yield from map(send, held.values())
                    held, total = {}, 0
        yield from map(send, held.values())

    counted = rows.mapInArrow(run, _COUNTED).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return counted.filter((F.col("f") >= LEAST) | (F.octet_length("phrase") == 0))


def bitmap_of(counted: DataFrame) -> np.ndarray:
    """The bitmap of the phrases of a level, gathered as words of 64 bits: BITS / 64 of them at most reach the driver."""
    bits = BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [(l.encode(), p.split(b" ")) for l, p in zip(*(batch.column(c).to_pylist() for c in ("lang", "phrase"))) if p]
            if split:
                words = [np.array([word_hash(l, p[i]) for l, p in split], np.uint64) for i in range(len(split[0][1]))]
                bit = np.unique(_bit(phrase_hash(words), bits))
                place, first = np.unique(bit >> 6, return_index=True)
                value = np.bitwise_or.reduceat(np.uint64(1) << (bit & 63).astype(np.uint64), first)
                yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(value.view(np.int64))], names=["place", "bits"])

    found = counted.select("lang", "phrase").mapInArrow(run, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits"))
    rows = found.toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[rows["place"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def levels(docs: DataFrame, longest: int = LONGEST, text: str = "text", lang: str = "lang") -> list[DataFrame]:
    """Written tables (lang, phrase, f) of the frequent phrases of 1 to longest words."""
    tables: list[DataFrame] = []
    for k in range(1, longest + 1):
        bitmap = bitmap_of(tables[-1]) if tables else None
        counted = level(docs, k, bitmap, text, lang).withColumn("phrase", F.col("phrase").cast("string"))
        tables.append(materialize(counted, f"level{k}").withColumn("phrase", F.col("phrase").cast("binary")))
    return tables


def _part(words, first: int, size: int):
    """Words of an array of them, joined."""
    return F.array_join(F.slice(words, first, size), " ")


def scored(tables: list[DataFrame]) -> DataFrame:
    """(lang, phrase, a, k, l, r, score): phrases of two words and more with the cut after k words that scores lowest."""
    named = [t.select("lang", F.col("phrase").cast("string").alias("phrase"), "f") for t in tables]
    parts = named[0].filter("phrase <> ''")
    for t in named[1:-1]:
        parts = parts.unionByName(t)
    cuts = None
    for size, t in enumerate(named[1:], 2):
        words = F.split("phrase", " ")
        cut = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), _part(words, 1, i).alias("left"), _part(words, i + 1, size - i).alias("right")) for i in range(1, size)]))
        rows = t.select("lang", "phrase", F.col("f").alias("a"), cut.alias("cut")).select("lang", "phrase", "a", "cut.*")
        cuts = rows if cuts is None else cuts.unionByName(rows)
    left = parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    both = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    both = both.withColumn("score", F.expr("CAST(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0)) AS DECIMAL(38,0)) div CAST(l + r AS DECIMAL(38,0))"))
    least = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return least.select("lang", "phrase", "a", "cut.*")


def covered(tables: list[DataFrame]) -> DataFrame:
    """(lang, phrase, longest): the largest f of the longer phrases that hold a phrase of two words or more."""
    inner = None
    for size, t in enumerate(tables[1:], 2):
        words = F.split(F.col("phrase").cast("string"), " ")
        parts = [_part(words, first, n) for n in range(2, size) for first in range(1, size - n + 2)]
        if parts:
            rows = t.select("lang", F.explode(F.array(*parts)).alias("phrase"), "f")
            inner = rows if inner is None else inner.unionByName(rows)
    return inner.groupBy("lang", "phrase").agg(F.max("f").alias("longest"))


def collocations(docs: DataFrame, longest: int = LONGEST, most: int = MOST, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `most` phrases of each language by score, a, and phrase.

    Phrases that a longer one covers (it stands COVERED of 100 times as often, at least) are left out."""
    tables = levels(docs, longest, text, lang)
    words = tables[0].filter(F.octet_length("phrase") == 0).select("lang", F.col("f").alias("n"))
    inside = covered(tables)
    rows = scored(tables).join(inside, ["lang", "phrase"], "left")
    rows = rows.filter("longest IS NULL OR CAST(longest AS DECIMAL(25,0)) * 100 < CAST(a AS DECIMAL(25,0)) * %d" % COVERED)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= most)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

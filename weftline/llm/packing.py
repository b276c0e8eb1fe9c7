"""Best-fit packing by patterns of few documents.

Documents are cut into pieces of at most SPACE tokens, and only the histogram of piece lengths goes to the driver: at
most SPACE counts, whatever the number of documents. There, patterns of up to DEPTH length bins that fill a sequence
are enumerated, their repeat counts are fitted to the histogram by non-negative least squares and rounded, each
pattern is realized with exact lengths, and what is left is packed by best fit, decreasing. The plan is a table of
slots; in Spark each piece gets a rank among those of its length and so its slot.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import map_texts
from .storage import materialize

SPACE = 2048
BINS, DEPTH = 64, 4
GROUP = 256  # rows that are numbered together, at least
GROUPS = 1 << 20  # groups that rows are numbered in, at most about


# ---- tokens -------------------------------------------------------------------------------------------------------


#: What joined, which is slower, needs at least.
_LOOSE = re.compile(r" (?:\s|\Z)")


class _Places(dict):
    """Places of words in a table; a word that is new gets the next place and is noted in `new`, after a prefix."""

    def __init__(self, prefix: str, new: list[str], count: list[int]):
        self.prefix, self.new, self.count = prefix, new, count

    def __missing__(self, word: str) -> int:
        self[word] = place = self.count[0]
        self.count[0] += 1
        self.new.append(self.prefix + word)
        return place


class Tokens:
    """Ids of texts from a tokenizers file given as text. Marks such as <|endoftext|> in a text are ordinary text.

    Pre-tokens begin at spaces, so words go to the tokenizer once and then come from a table of bounded size. New words
    go to it many at a time, in one text: the tokens with a space in front begin a word. Texts in which white space
    could join over a space go to it whole."""

    CACHED = 1_000_000
    TOGETHER = 2000

    def __init__(self, json: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json)
        self.tokenizer.encode_special_tokens = True
        self.joined = regex.compile(r"\s (?!\S)")
        space = self.tokenizer.id_to_token(self.tokenizer.encode(" ", add_special_tokens=False).ids[0])
        size = self.tokenizer.get_vocab_size()
        self.begins = np.array([(self.tokenizer.id_to_token(i) or "").startswith(space) for i in range(size)])
        self._clear()

    def _clear(self) -> None:
        self.new, self.count = [], [0]
        self.spaced, self.bare = _Places(" ", self.new, self.count), _Places("", self.new, self.count)
        self.lengths, self.ids = np.empty(0, np.int64), np.empty(0, np.uint32)  # of words by place; all their ids
        self.starts = np.empty(0, np.int64)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        """Adds the words noted as new to the table: first those that can share a text, then the others."""
        words = self.new
        plain = np.fromiter((len(w) > 1 and w[0] == " " and not w[1].isspace() and not w[-1].isspace() for w in words), bool, len(words))
        order = np.argsort(~plain, kind="stable")
        ordered = [words[i] for i in order.tolist()]
        lengths, parts, shared = [], [], int(plain.sum())
        for first in [*range(0, shared, self.TOGETHER), *range(shared, len(words), self.TOGETHER)]:
            some = ordered[first : min(first + self.TOGETHER, shared if first < shared else len(words))]
            if first < shared:
                ids = self._encode(["".join(some)])[0]
                begins = np.flatnonzero(self.begins[ids])
                if len(begins) == len(some):
                    lengths.append(np.diff(np.r_[begins, len(ids)]))
                    parts.append(ids)
                    continue
            each = self._encode(some)
            lengths.append(np.array([len(x) for x in each], np.int64))
            parts += each
        words.clear()
        found = np.concatenate(lengths)
        own = np.empty((2, len(found)), np.int64)
        own[0, order], own[1, order] = np.cumsum(found) - found + len(self.ids), found
        self.starts, self.lengths = np.concatenate([self.starts, own[0]]), np.concatenate([self.lengths, own[1]])
        self.ids = np.concatenate([self.ids, *parts])

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if self.count[0] > self.CACHED:
            self._clear()
        places: list[int] = []
        ends, whole = [], {}
        spaced, bare = self.spaced.__getitem__, self.bare.__getitem__
        for i, text in enumerate(texts):
            if _LOOSE.search(text) and self.joined.search(text):
                whole[i] = self._encode([text])[0]
            else:
                words = text.split(" ")
                places.append(bare(words[0]))
                places += map(spaced, islice(words, 1, None))
            ends.append(len(places))
        if self.new:
            self._learn()
        at = np.array(places, np.int64)
        lengths = self.lengths[at]
        until = np.r_[0, np.cumsum(lengths)]
        ids = self.ids[np.repeat(self.starts[at] - until[:-1], lengths) + np.arange(until[-1])]
        parts = np.split(ids, until[ends[:-1]])
        return [whole.get(i, part) for i, part in enumerate(parts)] if texts else []


_TOKENS: dict[int, Tokens] = {}


def pieces(docs: DataFrame, json: str, space: int = SPACE, end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32): each document's ids and then the id `end`, cut into pieces.

    Only documents longer than space are cut; all pieces but the first then have space ids. Null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(json)
    version = zlib.crc32(json.encode())
    last = int(end).to_bytes(4, "little")

    def cutter():
        if version not in _TOKENS:
            _TOKENS.clear()
            _TOKENS[version] = Tokens(shared.value)
        tokens = _TOKENS[version]

        def cut_all(texts: list[str | None]) -> tuple[list, list[int]]:
            rows, places = [], []
            for first in range(0, len(texts), 1000):
                for place, found in enumerate(tokens.of([t or "" for t in texts[first : first + 1000]]), first):
                    ids = found.astype("<u4").tobytes() + last
                    n = len(ids) // 4
                    start, cut = 0, (n - 1) % space + 1
                    for piece in range(-(-n // space)):
                        rows.append((piece, start, cut - start, zlib.crc32(ids[4 * start : 4 * cut])))
                        places.append(place)
                        start, cut = cut, cut + space
            return list(zip(*rows)) or [[], [], [], []], places

        return cut_all

    return map_texts(docs, text, {key: key}, "piece int, start long, length long, ids_crc32 long", cutter)


# ---- the plan, from the histogram -----------------------------------------------------------------------------------


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative least squares by active sets: x >= 0 with the least |a x - b|."""
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], bool)
    for _ in range(steps):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        best = int(gradient.argmax())
        if gradient[best] <= 1e-7 * max(1.0, np.abs(b).max()):
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            solved = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (solved > 0).all():
                x[:] = 0
                x[at] = solved
                break
            down = solved <= 0
            step = np.min(x[at][down] / np.maximum(x[at][down] - solved[down], 1e-300))
            x[at] += step * (solved - x[at])
            active[at[(x[at] <= 1e-12) & down]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def bin_patterns(bins: int = BINS, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All non-increasing tuples of up to depth bins (from 1) whose sum is bins."""

    def grow(left: int, most: int, parts: int) -> Iterator[tuple[int, ...]]:
        if left == 0:
            yield ()
        elif parts:
            for first in range(min(left, most), 0, -1):
                for rest in grow(left - first, first, parts - 1):
                    yield (first, *rest)

    return list(grow(bins, bins, depth))


class _Left:
    """Counts of lengths that are still to be packed."""

    def __init__(self, histogram: dict[int, int]):
        self.counts = {n: c for n, c in histogram.items() if c > 0}
        self.lengths = sorted(self.counts)

    def take(self, length: int, count: int) -> None:
        self.counts[length] -= count
        if not self.counts[length]:
            del self.counts[length]
            self.lengths.pop(bisect_left(self.lengths, length))

    def longest(self, least: float, most: float, used: Counter) -> int:
        """The longest length from least to most of which some are left beside those used; 0 if none."""
        for i in range(bisect_right(self.lengths, most) - 1, -1, -1):
            n = self.lengths[i]
            if n < least:
                return 0
            if self.counts[n] > used[n]:
                return n
        return 0


def _realize(left: _Left, pattern: tuple[int, ...], repeats: int, space: int, width: float) -> Iterator[tuple[tuple[int, ...], int]]:
    """Exact patterns for a bin pattern: each bin gives its longest length that fits, the last place what fits best
    from two bins around. Where a bin has run out, its place stays open for best fit; a pattern without its first
    length is given up."""
    while repeats > 0:
        used: Counter = Counter()
        room = space
        for place, bin_ in enumerate(pattern):
            final = place + 1 == len(pattern)
            n = left.longest((bin_ - (2.5 if final else 0.5)) * width, room if final else min(room, (bin_ + 0.5) * width), used)
            if not n and not place:
                return
            if n:
                used[n] += 1
                room -= n
        times = min(repeats, *(left.counts[n] // m for n, m in used.items()))
        for n, m in used.items():
            left.take(n, m * times)
        repeats -= times
        yield tuple(sorted(used.elements(), reverse=True)), times


def _best_fit(groups: list[tuple[tuple[int, ...], int]], left: dict[int, int], space: int) -> list[tuple[tuple[int, ...], int]]:
    """Packs what is left, longest first, into the sequence with the least room that suffices, or a new one. Sequences
    of the same contents are one group with a count."""
    open_: dict[int, list[list]] = {}  # room to groups [pattern, count]
    rooms: list[int] = []

    def put(pattern: tuple[int, ...], count: int) -> None:
        room = space - sum(pattern)
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append([pattern, count])

    for pattern, count in groups:
        put(pattern, count)
    for length in sorted(left, reverse=True):
        count = left[length]
        while count:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                pattern, there = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
                some = min(count, there)
                if there > some:
                    put(pattern, there - some)
                put((*pattern, length), some)
                count -= some
            else:
                fit = space // length
                if count >= fit:
                    put((length,) * fit, count // fit)
                    count %= fit
                else:
                    put((length,) * count, 1)
                    count = 0
    return [(tuple(p), c) for room in rooms for p, c in open_[room]]


def pattern_groups(histogram: dict[int, int], space: int = SPACE) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Groups (lengths, number of such sequences) by patterns with fitted and rounded repeat counts, and the histogram
    of what is left. A count that was rounded up takes what there is."""
    width = space / BINS
    left = _Left(histogram)
    bin_of = {n: min(BINS, max(1, round(n / width))) for n in left.counts}
    some = set(bin_of.values())
    patterns = [p for p in bin_patterns() if some.issuperset(p)]
    groups: list[tuple[tuple[int, ...], int]] = []
    if patterns:
        a = np.zeros((BINS, len(patterns)))
        for j, p in enumerate(patterns):
            for b in p:
                a[b - 1, j] += 1
        b = np.zeros(BINS)
        for n, c in left.counts.items():
            b[bin_of[n] - 1] += c
        weight = np.arange(1, BINS + 1) / BINS  # what stays of long pieces costs more
        repeats = np.rint(nnls(a * weight[:, None], b * weight)).astype(int)
        for j in sorted(np.flatnonzero(repeats), key=lambda j: (-patterns[j][0], len(patterns[j]))):
            groups += _realize(left, patterns[j], int(repeats[j]), space, width)
    return groups, left.counts


def plan(histogram: dict[int, int], space: int = SPACE) -> list[tuple[tuple[int, ...], int]]:
    """Groups (lengths of a sequence's pieces, number of such sequences) that pack the whole histogram."""
    full = [((space,), histogram[space])] if histogram.get(space) else []
    groups, left = pattern_groups({n: c for n, c in histogram.items() if n != space}, space)
    return full + _best_fit(groups, left, space)


def slots(groups: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first sequence, place in it, pieces of this length in it) of a plan."""
    out, ranks, sequence = [], Counter(), 0
    for pattern, count in groups:
        place = 0
        for length, times in sorted(Counter(pattern).items(), reverse=True):
            first = ranks[length]
            ranks[length] += times * count
            out.append((length, first, ranks[length], sequence, place, times))
            place += length * times
        sequence += count
    return out


# ---- the plan, applied ----------------------------------------------------------------------------------------------


def pack(rows: DataFrame, *order: str, space: int = SPACE) -> DataFrame:
    """rows with sequence_id and offset. rows: a column length from 1 to space; order: columns that name a row.

    Ranks among rows of one length come from groups of about GROUP rows (by a hash of the row's name), so that a length
    that many rows share is numbered by many tasks. Rows keep all their columns, whatever the names. No rows give no
    rows."""
    spark = rows.sparkSession
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most `space` rows
    table = spark.createDataFrame(slots(plan(histogram, space)), "l long, first long, until long, sequence long, place long, times long")
    most = max(GROUP, sum(histogram.values()) // GROUPS)
    groups = spark.createDataFrame([(n, -(-c // most)) for n, c in histogram.items()], "l long, n_groups long")
    held = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col("length"))
    names = [F.col(f"row.`{c}`") for c in order]
    spread = held.join(F.broadcast(groups), F.col("length") == F.col("l")).drop("l")
    spread = spread.withColumn("grp", F.pmod(F.xxhash64(*names), F.col("n_groups"))).drop("n_groups")
    sizes = spread.groupBy(F.col("length").alias("sl"), F.col("grp").alias("sg")).agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("sl").orderBy("sg").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("sl", "sg", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "grp").orderBy(*names)
    ranked = spread.withColumn("nth", F.row_number().over(own) - 1)
    ranked = ranked.join(sizes, (F.col("length") == F.col("sl")) & (F.col("grp") == F.col("sg")))
    ranked = ranked.select("row", "length", (F.col("before") + F.col("nth")).alias("rank"))
    # The slots follow from the lengths alone: their number is bounded by `space`, not by the rows.
    placed = ranked.join(F.broadcast(table), (F.col("length") == F.col("l")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("until")))
    turn = F.col("rank") - F.col("first")
    sequence = F.col("sequence") + F.floor(turn / F.col("times"))
    offset = F.col("place") + turn % F.col("times") * F.col("length")
    return placed.select("row.*", sequence.alias("sequence_id"), offset.alias("offset"))


def pack_documents(docs: DataFrame, json: str, space: int = SPACE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row of docs.

    Null and empty texts are one piece with the end id alone. Repeated rows are packed each. The pieces, without their
    ids, are written once to the shared folder, so texts are read and tokenized once."""
    cut = materialize(pieces(docs, json, space, key=key, text=text), "pieces")
    return pack(cut, key, "piece", space=space)

"""Ranked lexical search over a bit-sliced impact index.

A document's impact under a term is a whole number: the term's weight times its saturated count. The index of a block of
documents holds, for each term, one bitmap for each bit of these impacts. A query adds the slices of its terms with carries,
64 documents to a machine word, which gives the slices of all scores of the block; its top k come from going down these
slices from the most significant one, as long as more than k documents are left. The tops of all blocks are then merged.

Queries are taken in chunks, whose terms are all that is broadcast (MOST_TERMS at most, or one query's). Documents without
text have no terms and count for nothing; queries without terms find nothing. Rows of one key are documents of their own,
and so are rows of queries. A null key comes before all others among equal scores.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import arrow_schema
from .storage import materialize

MOST_TERMS = 500_000  # different terms of a chunk of queries
BLOCK = 1 << 14  # documents of a block
POSTINGS = 1 << 22  # postings of a block, but for one longer document
HELD = 64 << 20  # bytes of slices that a block keeps for terms of several queries
FULL, LENGTH, SATURATION = 100, 75, 8  # of 100 parts, those that follow a document's length; what a count is held against

#: ASCII letters and digits and all bytes beyond ASCII make terms; only A-Z is lower-cased.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TERM).split() if text else []


def weight(documents: int, having: int) -> int:
    """Of a term that so many of all documents have."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * having + 1)))


# ---- queries --------------------------------------------------------------------------------------------------------


def chunks(items: DataFrame, key: str, text: str) -> Iterator[tuple[list, list[Counter]]]:
    """Keys and terms of queries, so many at a time that their terms are MOST_TERMS at most, or one query at least."""
    rows = items.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").cast("binary").alias("t"))
    keys, queries, seen = [], [], set()
    for row in rows.toLocalIterator(prefetchPartitions=True):
        found = Counter(terms_of(bytes(row["t"]) if row["t"] is not None else None))
        if not found:
            continue
        if queries and len(seen | found.keys()) > MOST_TERMS:
            yield keys, queries
            keys, queries, seen = [], [], set()
        keys.append(row["k"])
        queries.append(found)
        seen |= found.keys()
    if queries:
        yield keys, queries


# ---- documents ------------------------------------------------------------------------------------------------------


def postings(docs: DataFrame, numbers: dict[bytes, int], key: str, text: str) -> DataFrame:
    """(k, n, terms, counts) of each document with terms: how many it has, and those that have numbers, as int32 bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").cast("binary").alias("t"))
    schema = f"k {rows.schema['k'].dataType.simpleString()}, n long, terms binary, counts binary"
    kinds = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            places, sizes, terms, counts = [], [], [], []
            for place, t in enumerate(batch.column("t")):
                words = terms_of(t.as_py())
                if words:
                    term, count = np.unique(np.array([x for x in map(number, words) if x is not None], np.int32), return_counts=True)
                    places.append(place)
                    sizes.append(len(words))
                    terms.append(term.tobytes())
                    counts.append(count.astype(np.int32).tobytes())
            arrays = [batch.column("k").take(pa.array(places, pa.int64())), sizes, terms, counts]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(arrays, kinds)], schema=kinds)

    return rows.mapInArrow(run, schema)


def statistics(found: DataFrame, terms: int) -> tuple[int, int, list[int]]:
    """Documents, their terms with repeats, and for each numbered term the documents that have it.

    A task sends one row for each term that it saw, so no more than the terms of the chunk reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        having, documents, length = np.zeros(terms, np.int64), 0, 0
        for batch in batches:
            documents += batch.num_rows
            length += sum(batch.column("n").to_pylist())
            held = b"".join(batch.column("terms").to_pylist())
            having += np.bincount(np.frombuffer(held, np.int32), minlength=terms)
        seen = np.flatnonzero(having)
        numbers = [*seen.tolist(), -1, -2]
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array([*having[seen].tolist(), documents, length], pa.int64())], names=["term", "docs"])

    rows = found.select("n", "terms").mapInArrow(run, "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs")).collect()
    counted = {r["term"]: r["docs"] for r in rows}
    return counted.get(-1, 0), counted.get(-2, 0), [counted.get(i, 0) for i in range(terms)]


# ---- blocks ---------------------------------------------------------------------------------------------------------


def slices(values: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of the bits of values at their places, least significant first: (bits, words) of 64 places each."""
    dense = np.zeros(64 * words, np.int64)
    dense[at] = values
    bits = int(values.max(initial=0)).bit_length()
    planes = np.unpackbits(dense.view(np.uint8).reshape(-1, 8)[:, : -(-bits // 8)], axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(planes.T[:bits]), axis=1, bitorder="little").view(np.uint64)


def add(total: np.ndarray, part: np.ndarray, shift: int = 0) -> None:
    """Add part's numbers, times two to the shift, to total's, which has bits enough for the sum."""
    carry = None
    for i, more in enumerate(part, shift):
        if carry is None:
            carry = total[i] & more
            total[i] ^= more
        else:
            either = total[i] ^ more
            carry, total[i] = (total[i] & more) | (carry & either), either ^ carry
    i = len(part) + shift
    while carry is not None and i < len(total) and carry.any():
        carry, total[i] = carry & total[i], carry ^ total[i]
        i += 1


def places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top(total: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(place, number) of the k largest numbers above 0, of equal ones the first places."""
    sure = np.zeros(total.shape[1], np.uint64)
    maybe = np.bitwise_or.reduce(total, axis=0) if len(total) else sure
    for bits in total[::-1]:
        larger = maybe & bits
        count = int(np.bitwise_count(sure | larger).sum())
        if count > k:
            maybe = larger
        else:
            sure = sure | larger
            maybe = maybe & ~bits
            if count == k:
                maybe = np.zeros_like(maybe)
                break
    found = places(sure)
    found = np.concatenate([found, places(maybe)[: k - len(found)]])
    words, bit = found >> 6, (found & 63).astype(np.uint64)
    numbers = [0] * len(found)
    for i, row in enumerate(total):
        for j, one in enumerate(((row[words] >> bit) & np.uint64(1)).tolist()):
            numbers[j] |= int(one) << i
    return list(zip(found.tolist(), numbers))


def impacts(counts: np.ndarray, lengths: np.ndarray, weights: np.ndarray, documents: int, length: int) -> np.ndarray:
    """Of postings: their counts, the lengths of their documents, the weights of their terms. Exact: where 64 bits might not
    hold a product, Python's whole numbers do."""
    if int(lengths.max(initial=0)) * LENGTH * documents >= 1 << 63:
        against = FULL - LENGTH + (LENGTH * lengths.astype(object) * documents) // length
    else:
        against = FULL - LENGTH + (LENGTH * lengths * documents) // length
    return weights * ((10**9 * counts) // (1000 * counts + SATURATION * against)).astype(np.int64)


class Block:
    """The index of a block: postings by term, and slices of a term's impacts when they are asked for."""

    def __init__(self, size: int, at: np.ndarray, term: np.ndarray, impact: np.ndarray):
        order = np.argsort(term, kind="stable")
        self.words, self.at, self.impact, term = -(-size // 64), at[order], impact[order], term[order]
        edges = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.empty(0, np.int64)
        self.span = {int(term[i]): (int(i), int(j)) for i, j in zip(edges, np.r_[edges[1:], len(term)])}
        self.kept: dict[int, np.ndarray] = {}
        self.held = 0

    def slices(self, term: int, again: bool) -> np.ndarray:
        found = self.kept.get(term)
        if found is None:
            i, j = self.span[term]
            found = slices(self.impact[i:j], self.at[i:j], self.words)
            if again and self.held + found.nbytes <= HELD:
                self.kept[term] = found
                self.held += found.nbytes
        return found

    def search(self, query: list[tuple[int, int]], k: int, again: set[int]) -> list[tuple[int, int]]:
        """(place, score) of the k best. query: terms and how often the query has them; again: terms of several queries."""
        parts = [(self.slices(term, term in again), times) for term, times in query if term in self.span]
        most = sum(times << len(part) for part, times in parts)
        total = np.zeros((most.bit_length(), self.words), np.uint64)
        for part, times in parts:
            for shift in range(times.bit_length()):
                if times >> shift & 1:
                    add(total, part, shift)
        return top(total, k)


def _best_of_blocks(found: DataFrame, keys: list, key_kind: str, queries: list[list[tuple[int, int]]], known: tuple, first: int, k: int) -> DataFrame:
    """(nth, q, k, score): for each query the k best of each block. nth numbers the queries from first on."""
    kind = found.schema["k"].dataType.simpleString()
    schema = f"nth long, q {key_kind}, k {kind}, score long"
    kinds = arrow_schema(schema)
    often = Counter(term for query in queries for term, _ in query)
    shared = found.sparkSession.sparkContext.broadcast((keys, queries, {t for t, n in often.items() if n > 1}, known))

    def best(rows: pa.Table) -> pa.RecordBatch:
        names, asked, again, (documents, length, weights) = shared.value
        rows = rows.take(pc.sort_indices(rows, [("k", "ascending")], null_placement="at_start"))
        terms = [np.frombuffer(x, np.int32) for x in rows["terms"].to_pylist()]
        counts = np.frombuffer(b"".join(rows["counts"].to_pylist()), np.int32).astype(np.int64)
        at = np.repeat(np.arange(len(terms)), [len(x) for x in terms])
        term = np.concatenate([np.empty(0, np.int32), *terms])
        impact = impacts(counts, rows["n"].to_numpy()[at], weights[term], documents, length)
        block = Block(len(terms), at, term, impact)
        out = [(i, place, score) for i, query in enumerate(asked) for place, score in block.search(query, k, again)]
        nth, place, score = ([x[i] for x in out] for i in range(3))
        arrays = [
            pa.array([i + first for i in nth], pa.int64()),
            pa.array([names[i] for i in nth], kinds.field("q").type),
            rows["k"].combine_chunks().take(pa.array(place, pa.int64())),
            pa.array(score, pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(arrays, schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, bytes_of = [], 0, 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, min(256, BLOCK - size))
                at += part.num_rows
                held.append(part)
                size += part.num_rows
                bytes_of += sum(len(x) for x in part.column("terms").to_pylist())
                if size >= BLOCK or bytes_of >= 4 * POSTINGS:
                    yield best(pa.Table.from_batches(held))
                    held, size, bytes_of = [], 0, 0
        if held:
            yield best(pa.Table.from_batches(held))

    return found.mapInArrow(run, schema)


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, key, score): for each row of items its k documents of the highest scores above 0, equal scores by key.

    All documents are read once for each chunk of queries, and their postings of the chunk's terms once more from a table
    in the shared folder, when what the scores take from the whole corpus is known."""
    spark = docs.sparkSession
    item_kind = items.schema[item].dataType.simpleString()
    kind = docs.schema[key].dataType.simpleString()
    best = spark.range(0).selectExpr("id AS nth", f"CAST(NULL AS {item_kind}) AS q", f"CAST(NULL AS {kind}) AS k", "id AS score")
    first = 0
    for keys, queries in chunks(items, item, item_text):
        numbers: dict[bytes, int] = {}
        numbered = [[(numbers.setdefault(t, len(numbers)), n) for t, n in query.items()] for query in queries]
        found = materialize(postings(docs, numbers, key, text), "postings")
        documents, length, having = statistics(found, len(numbers))
        weights = np.array([weight(documents, n) if n else 0 for n in having], np.int64)
        best = best.unionByName(_best_of_blocks(found, keys, item_kind, numbered, (documents, length, weights), first, k))
        first += len(queries)
    order = Window.partitionBy("nth").orderBy(F.col("score").desc(), F.col("k").asc_nulls_first())
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(item), "rank", F.col("k").alias(key), "score")

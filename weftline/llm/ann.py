"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector, over its length, padded with zeros to BITS coordinates for each of its own and rotated, is coded by the signs
of its coordinates: packed bits, with correction scalars, its length and the inner product of the vector with its code.
From the bits alone, as signs that meet the steps of a rounded query, the inner product is estimated without bias, and its
error is bounded but for a chance that EPSILON sets. Steps and signs are small whole numbers, so that one product of
matrices of floats is exact for all pairs of a block.

Queries meet codes in blocks, twice: first for the best estimates, whose exact inner products give each query a value
that its k-th neighbour reaches at least; then for all codes whose upper bounds reach that value. The vectors of those,
and no others, are fetched and reranked by exact inner products, in the same blocks. Each block is one task of bounded
size, which keeps its k best per query; the best of those over all blocks are the result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 2.0  # with BITS, by recall measured on the tables: 1.000 at 4 to 9 % of the vectors reranked
BITS = 8  # of a code for each coordinate of a vector
PLANES = 6  # bits of a query's rounded coordinates
QUERY_BLOCK = 4096  # codes are copied for each block of queries; their places have 16 bits
CANDIDATE_BLOCK = 8192
_STEP = 128  # queries that are held against a block's codes at once
_SIGNS = 1 << 23  # signs of codes that are unpacked at once


def code_bits(dim: int) -> int:
    """Bits of the code of a vector: whole words of 64."""
    return -(-BITS * dim // 64) * 64


@lru_cache(maxsize=1)
def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """The first rows of a random orthogonal matrix, which pad and rotate; the same in every task."""
    bits = code_bits(dim)
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:dim]


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, lengths, and inner products of unit vectors with their unit codes."""
    lengths = np.sqrt((vectors * vectors).sum(axis=1))
    turned = (vectors / lengths[:, None]) @ turn
    fit = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
    return np.packbits(turned > 0, axis=1), lengths, fit


def bounds(queries: np.ndarray, codes: np.ndarray, lengths: np.ndarray, fit: np.ndarray, turn: np.ndarray, epsilon: float = EPSILON):
    """Estimates of all inner products (queries x codes) and the half widths of their bounds, from packed bits."""
    return _bounds(queries, *_signs(codes), lengths, fit, turn, epsilon)


def _signs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed bits as 1 and -1, and their sums."""
    signs = np.unpackbits(np.ascontiguousarray(codes), axis=1).astype(np.float32)
    signs *= 2
    signs -= 1
    return signs, signs.sum(axis=1, dtype=np.float64)


def _bounds(queries: np.ndarray, signs: np.ndarray, sums: np.ndarray, lengths: np.ndarray, fit: np.ndarray, turn: np.ndarray, epsilon: float):
    bits = turn.shape[1]
    turned = queries @ turn
    low = turned.min(axis=1, keepdims=True)
    unit = np.maximum(turned.max(axis=1, keepdims=True) - low, 1e-300) / ((1 << PLANES) - 1)
    steps = np.rint((turned - low) / unit).astype(np.float32)
    estimate = unit * (steps @ signs.T)
    estimate += low * sums  # the sum of the query's coordinates, each with the code's sign
    estimate *= lengths / (fit * np.sqrt(bits))
    if not epsilon:
        return estimate, np.zeros((1, 1))
    size = np.sqrt((queries * queries).sum(axis=1, keepdims=True))
    spread = np.sqrt(np.maximum(1 - fit * fit, 0)) / fit / np.sqrt(bits - 1)
    rounding = unit * np.sqrt(bits / 12) / np.sqrt(bits)  # of the query's coordinates, against a unit code
    return estimate, np.hstack([size, rounding]) @ (epsilon * lengths * np.stack([spread, 1 / fit]))


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v, h): rows with a key whose vector is neither null, empty nor zero and has no null or non-finite component;
    h is a hash of the vector."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)))
    return rows.withColumn("h", F.xxhash64("v"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as rows of a matrix."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), -1)


def _codes(rows: DataFrame) -> DataFrame:
    """(dim, id, h, code, size, fit) of every row (dim, id, h, v)."""
    kinds = pa.schema([("dim", pa.int32()), ("id", pa.int64()), ("h", pa.int64()), ("code", pa.binary()), ("size", pa.float64()), ("fit", pa.float64())])

    def run(batches):
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                if dim not in turns:
                    turns[dim] = rotation(dim)
                code, size, fit = encode(_matrix(part.column("v")), turns[dim])
                packed = pa.array([c.tobytes() for c in code], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("dim"), part.column("id"), part.column("h"), packed, pa.array(size), pa.array(fit)], schema=kinds)

    return rows.select("dim", "id", "h", "v").mapInArrow(run, "dim int, id long, h long, code binary, size double, fit double")


def _block(left: pa.Table, right: pa.Table, epsilon: float):
    """For groups of a block's queries and of its candidates: (places of the queries, the first candidate's place,
    estimates, half widths, which candidates are others)."""
    queries, ids = _matrix(left["v"]), left["id"].to_numpy()
    bits = code_bits(queries.shape[1])
    codes = np.frombuffer(b"".join(right["code"].to_pylist()), np.uint8).reshape(-1, bits // 8)
    size, fit, other = right["size"].to_numpy(), right["fit"].to_numpy(), right["id"].to_numpy()
    turn = rotation(queries.shape[1])
    wide = max(1, _SIGNS // bits)
    for start in range(0, len(codes), wide):
        near = slice(start, start + wide)
        signs, sums = _signs(codes[near])
        for at in range(0, len(queries), _STEP):
            part = slice(at, at + _STEP)
            estimate, half = _bounds(queries[part], signs, sums, size[near], fit[near], turn, epsilon)
            yield np.arange(len(queries))[part], start, estimate, half, other[None, near] != ids[part][:, None]


_FIRST = "query_id long, id long, h long, estimate double"
_KEPT = "dim int, qb long, cb long, id long, h long, places binary"
_FOUND = "query_id long, vec_id long, score double"
BLOCK = ["dim", "qb", "cb"]


def _first(queries: DataFrame, codes: DataFrame, k: int) -> DataFrame:
    """(query_id, id, h, estimate): each query's k largest estimates in each block."""
    kinds = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("h", pa.int64()), ("estimate", pa.float64())])

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return kinds.empty_table()
        best = np.full((left.num_rows, k), -np.inf)
        at = np.zeros((left.num_rows, k), np.int64)
        for places, start, estimate, _, others in _block(left, right, 0.0):
            estimate[~others] = -np.inf
            top = np.argpartition(-estimate, k - 1, axis=1)[:, :k] if estimate.shape[1] > k else np.tile(np.arange(estimate.shape[1]), (len(places), 1))
            both = np.hstack([best[places], np.take_along_axis(estimate, top, 1)])
            of = np.hstack([at[places], start + top])
            top = np.argsort(-both, axis=1)[:, :k]
            best[places], at[places] = np.take_along_axis(both, top, 1), np.take_along_axis(of, top, 1)
        found = best.ravel() > -np.inf
        at = at.ravel()[found]
        q = np.repeat(left["id"].to_numpy(), k)[found]
        return pa.Table.from_arrays([pa.array(q), pa.array(right["id"].to_numpy()[at]), pa.array(right["h"].to_numpy()[at]), pa.array(best.ravel()[found])], schema=kinds)

    return queries.groupBy(*BLOCK).cogroup(codes.groupBy(*BLOCK)).applyInArrow(task, _FIRST)


def _once(rows: pa.Table) -> pa.Table:
    """One row of each id and h."""
    ids, h = rows["id"].to_numpy(), rows["h"].to_numpy()
    order = np.lexsort((h, ids))
    first = np.append(True, (np.diff(ids[order]) != 0) | (np.diff(h[order]) != 0))
    return rows if first.all() else rows.take(pa.array(order[first]))


def _kept(queries: DataFrame, codes: DataFrame, epsilon: float) -> DataFrame:
    """(dim, qb, cb, id, h, places): candidates whose upper bounds reach the least score of some of the block's queries,
    and the numbers of those queries by ascending id, as 16-bit numbers. A candidate that is repeated with its key and
    vector has a code for each row, all in one block; one of them is enough."""
    kinds = pa.schema([("dim", pa.int32()), *[(c, pa.int64()) for c in ("qb", "cb", "id", "h")], ("places", pa.binary())])

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return kinds.empty_table()
        left, right = left.sort_by("id"), _once(right)
        least, near = left["least"].to_numpy(), []
        for places, start, estimate, half, others in _block(left, right, epsilon):
            at, place = np.nonzero((others & (estimate + half >= least[places][:, None])).T)
            near.append((start + at, places[place]))
        at, place = (np.concatenate(x) for x in zip(*near))
        order = np.argsort(at, kind="stable")  # the places of a candidate's queries ascend
        at, place = at[order], place[order]
        rows, first = np.unique(at, return_index=True)
        packed = [x.astype("<u2").tobytes() for x in np.split(place, first[1:])] if len(rows) else []
        fixed = [pa.array(np.repeat(left[c][0].as_py(), len(rows)), kinds.field(c).type) for c in BLOCK]
        return pa.Table.from_arrays([*fixed, pa.array(right["id"].to_numpy()[rows]), pa.array(right["h"].to_numpy()[rows]), pa.array(packed, pa.binary())], schema=kinds)

    return queries.groupBy(*BLOCK).cogroup(codes.groupBy(*BLOCK)).applyInArrow(task, _KEPT)


def _reranked(queries: DataFrame, kept: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): each query's k best of each block's kept candidates (with their vectors v), exactly."""
    kinds = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return kinds.empty_table()
        left = left.sort_by("id")
        vectors, candidates = _matrix(left["v"]), _matrix(right["v"])
        ids, others = left["id"].to_numpy(), right["id"].to_numpy()
        places = [np.frombuffer(p, "<u2") for p in right["places"].to_pylist()]
        near = np.repeat(np.arange(len(places)), [len(p) for p in places])
        order = np.argsort(of := np.concatenate(places), kind="stable")
        edges = np.searchsorted(of[order], np.arange(len(ids) + 1))
        out = []
        for i, (start, stop) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            at = near[order[start:stop]]
            score = (candidates[at] * vectors[i]).sum(axis=1)
            best = np.lexsort((others[at], -score))[:k]
            out.append((np.full(len(best), ids[i]), others[at][best], score[best]))
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], schema=kinds)

    return queries.groupBy(*BLOCK).cogroup(kept.groupBy(*BLOCK)).applyInArrow(task, _FOUND)


def _parts(vectors: DataFrame, is_query: Column, key: str, vector: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (dim, id, h, v, cb), queries (dim, qb, cb, id, v) in all blocks of candidates, and codes (dim, qb, cb, id, h,
    code, size, fit) in all blocks of queries. Block numbers come from hashes, so that blocks have about the sizes named;
    a row for each dimension reaches the driver."""
    rows = usable(vectors, key, vector).withColumn("dim", F.size("v"))
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).collect()
    blocks = [(r["dim"], -(-r["n"] // CANDIDATE_BLOCK), max(1, -(-r["q"] // QUERY_BLOCK))) for r in sizes]
    counts = F.broadcast(vectors.sparkSession.createDataFrame(blocks, "dim int, cblocks long, qblocks long"))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    queries = rows.filter(is_query).join(counts, "dim").withColumn("qb", F.pmod(F.xxhash64("id"), F.col("qblocks")))
    queries = queries.withColumn("cb", spread(F.col("cblocks"))).select(*BLOCK, "id", "v")
    codes = _codes(rows).join(counts, "dim").withColumn("cb", F.pmod(F.xxhash64(F.lit(1), "id"), F.col("cblocks")))
    return rows, queries, codes.withColumn("qb", spread(F.col("qblocks"))).drop("cblocks", "qblocks")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", epsilon: float = EPSILON) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query row with the other rows.

    is_query: a condition on the column id. Vectors null, zero or with null or non-finite components take no part, and
    vectors meet those of their own dimension only. Repeated rows are separate candidates; rows with a query's own key
    are not among its candidates. A key that several query rows share is answered for all of them together. With fewer
    than k candidates, all are returned. An empty table gives no rows."""
    rows, queries, codes = _parts(vectors, is_query, key, vector)
    near = kept_candidates(rows, queries, codes, is_query, k, epsilon)
    found = rows.select("id", "h", "v")
    once = near.join(found, ["id", "h"]).select(*BLOCK, "id", "v", "places")
    best = _reranked(queries, once, k)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def kept_candidates(rows: DataFrame, queries: DataFrame, codes: DataFrame, is_query: Column, k: int, epsilon: float) -> DataFrame:
    """_kept() with each query's least score from the exact inner products of its k best estimates."""
    order = Window.partitionBy("query_id").orderBy(F.col("estimate").desc())
    first = _first(queries, codes, k).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k)
    one = rows.select("id", "h", F.col("v").alias("cv")).dropDuplicates(["id", "h"])
    asked = rows.filter(is_query).select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
    product = F.aggregate(F.zip_with("cv", "qv", lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)
    exact = first.join(one, ["id", "h"]).join(asked, "query_id").select("query_id", product.alias("score"))
    # Rounding can differ from that of the reranking in the last digits.
    least = exact.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score") - 1e-9 * F.max(F.abs("score"))).otherwise(float("-inf")).alias("least"))
    limited = queries.join(least.withColumnRenamed("query_id", "id"), "id").select(*BLOCK, "id", "v", "least")
    return _kept(limited, codes, epsilon)

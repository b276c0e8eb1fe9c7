"""Similarity join of documents by the Jaccard index of their word n-grams, with adaptive multi-match prefixes.

Shingles are ordered by how many sets have them, so every set's prefix begins with what is its own. If two sets link,
the first m shingles that they share lie in the prefixes of both, where the prefix of a set of n shingles has
n - ceil(0.8 n) + m. Each set chooses its own m: a longer prefix costs more rows but asks for m shared shingles before
a pair is verified, so the set takes the m that makes an estimate of both costs least. Two sets are candidates if their
prefixes share as many shingles as the smaller m.

Frequencies come from one exchange of all shingles, packed: a task sends the shingles of many documents to the buckets
of their hashes as a few byte strings, and the buckets send back those that several sets have, with their counts. What
does not come back is unique and links nothing; sets with too many unique shingles end there. The others are written
once, with the shingles that they share, and all later steps, verification included, work on that table.

Equal sets are one class from the start. Classes that meet under a shingle are first compared with one pivot of that
shingle; only those that are still in different components are then paired with each other, if the parities of their
sets (1024 bits, a bound on the size of the symmetric difference) allow a link. Every pair that could link is either
verified or already connected, so components are exact, and dense groups don't make all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import arrow_schema, map_texts
from .components import components
from .storage import materialize

WORDS = 5
PERCENT = 80  # of the union that the intersection needs
PARITY = 16  # words of 64 bits of a set's parity
VERIFY_COST = 30.0  # of a pair, in units of a prefix row
FLUSH = 1 << 21  # shingles that a task holds before it sends them
BUCKET = 1 << 22  # shingles of a bucket, about
HOT = 1024  # a shingle in more than 1 of HOT sets, and in HOT of them at least, goes around the buckets
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; a text with fewer words has its whole sequence as one."""
    if not text:
        return np.empty(0, np.uint64)
    found = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), 1)], np.uint64)
    hashes = np.array(list(map(xxhash.xxh3_64_intdigest, found)), np.uint64)
    n = len(hashes) - words + 1
    acc = hashes[:n].copy()
    for k in range(1, words):
        acc *= np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
        acc += hashes[k : n + k]
    acc ^= acc >> np.uint64(31)
    acc *= np.uint64(0xBF58476D1CE4E5B9)
    acc ^= acc >> np.uint64(29)
    return np.unique(acc)


def set_id(hashes: np.ndarray) -> bytes:
    """128-bit id of a set of shingles."""
    return xxhash.xxh3_128_digest(hashes.tobytes(), 1)


EMPTY = set_id(np.empty(0, np.uint64))


def parity(hashes: np.ndarray) -> np.ndarray:
    """PARITY signed 64-bit words: for each bucket of shingles, whether the set has an odd number of them."""
    bits = np.bincount((hashes >> np.uint64(7)).astype(np.int64) & (64 * PARITY - 1), minlength=64 * PARITY) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def least_overlap(n):
    """Shingles that a set of n shares at least with any set that it links with."""
    return -(-PERCENT * n // 100)


def matches(n: int, frequency: np.ndarray) -> tuple[int, int]:
    """(m, length): how many shared shingles a set of n asks for, and how long the part of its prefix is that other sets
    can have. frequency: of its shingles that others have, ascending; the rest of the prefix is unique."""
    need = least_overlap(n)
    own = len(frequency) - need  # of the shared shingles, before the m-th match
    m = np.arange(1, need + 1)
    length = own + m
    cost = length + np.cumsum(frequency, dtype=np.float64)[length - 1] * (1 + VERIFY_COST / m)
    best = int(cost.argmin())
    return best + 1, int(length[best])


def links(x: np.ndarray, y: np.ndarray, nx: int | None = None, ny: int | None = None) -> bool:
    """Whether two sets of shingles link. nx, ny: their sizes, where x and y leave out shingles that no other set has."""
    nx, ny = len(x) if nx is None else nx, len(y) if ny is None else ny
    if not nx or not ny or 100 * min(nx, ny) < PERCENT * max(nx, ny):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (nx + ny - both)


# ---- sets -----------------------------------------------------------------------------------------------------------


def _sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of two kinds from one pass: (k, h1, h2, n, node) for each row of docs, and (token, docs) for shingles that
    several different sets of a batch have. h1 and h2 are hashes of the text, null for null."""
    digest = lambda seed: F.when(F.col(text).isNotNull(), F.xxhash64(F.lit(seed), F.col(text)))
    rows = docs.select(F.col(key).alias("k"), digest(1).alias("h1"), digest(2).alias("h2"), F.col(text).cast("string").alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    schema = f"k {kind}, h1 long, h2 long, n long, node binary, token long, docs long"
    kinds = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, sets = [], [], {}
            for t in batch.column("t").to_pylist():
                hashes = shingles(t)
                node = set_id(hashes)
                nodes.append(node)
                sizes.append(len(hashes))
                sets[node] = hashes
            size = batch.num_rows
            arrays = [*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, schema=kinds)
            token, count = np.unique(np.concatenate([np.empty(0, np.uint64), *sets.values()]), return_counts=True)
            often = count >= max(2, len(sets) // (2 * HOT))
            if often.any():
                size = int(often.sum())
                arrays = [pa.nulls(size, f.type) for f in list(kinds)[:5]] + [pa.array(token[often].view(np.int64)), pa.array(count[often], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, schema=kinds)

    return rows.mapInArrow(run, schema)


def _hot(sets: DataFrame, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a share of all sets has, in ascending order, with their counts as far as batches told them.

    As each is in more than 1 of HOT sets, there are at most HOT times the mean size of a set."""
    rows = sets.filter("token is not null").groupBy("token").agg(F.sum("docs").alias("docs"))
    rows = rows.filter(F.col("docs") >= max(HOT, classes // HOT)).toPandas()
    tokens, counts = rows["token"].to_numpy(np.int64).view(np.uint64), rows["docs"].to_numpy(np.int64)
    order = np.argsort(tokens)
    return tokens[order], counts[order]


# ---- frequencies ----------------------------------------------------------------------------------------------------

#: What tasks and buckets send: kind 0 is shingles of documents of a sender, 1 its documents (ids and sizes), 2 shingles
#: with their counts. at: places of documents among those of the sender, by bytes; token: bytes of shingles.
_PACKED = "bucket int, src long, kind int, at binary, token binary, docs binary"


def _planes(at: np.ndarray) -> bytes:
    """Unsigned 16-bit numbers, low bytes first and then high bytes, which compress well in order."""
    return at.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def _unplanes(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.uint8).reshape(2, -1).T.copy().view("<u2").ravel().astype(np.int64)


def _packed(docs: DataFrame, text: str, hot: tuple[np.ndarray, np.ndarray], bits: int) -> DataFrame:
    """Rows of _PACKED: all shingles of docs, dealt to 2**bits buckets by the first bits of their hashes.

    A sender is a part of a task. Copies within it are sent once."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    kinds, low = arrow_schema(_PACKED), 8 - bits // 8  # the bytes that the bucket does not tell

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_tokens, hot_counts = shared.value
        task, number = TaskContext.get().partitionId(), 0
        held: dict[bytes, np.ndarray] = {}
        size = 0

        def send() -> pa.RecordBatch:
            src = task << 32 | number
            tokens = np.concatenate(list(held.values()))
            at = np.repeat(np.arange(len(held)), [len(x) for x in held.values()])
            rows = [(number & ((1 << bits) - 1), src, 1, b"".join(held), np.array([len(x) for x in held.values()], "<i8").tobytes(), b"")]
            if len(hot_tokens):
                place = np.minimum(np.searchsorted(hot_tokens, tokens), len(hot_tokens) - 1)
                found = hot_tokens[place] == tokens
                if found.any():
                    rows.append((number & ((1 << bits) - 1), src, 2, _planes(at[found]), tokens[found].tobytes(), hot_counts[place[found]].astype("<u4").tobytes()))
                    tokens, at = tokens[~found], at[~found]
            bucket = (tokens >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
            order = np.argsort(bucket, kind="stable")
            bucket, tokens, at = bucket[order], tokens[order], at[order]
            edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist() if len(bucket) else []
            for i, j in zip(edges, [*edges[1:], len(bucket)]):
                bytes_of = tokens[i:j].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low]
                rows.append((int(bucket[i]), src, 0, _planes(at[i:j]), np.ascontiguousarray(bytes_of).tobytes(), b""))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

        for batch in batches:
            for t in batch.column("t").to_pylist():
                hashes = shingles(t)
                if not len(hashes):
                    continue
                node = set_id(hashes)
                if node not in held:
                    held[node] = hashes
                    size += len(hashes)
                if size >= FLUSH or len(held) == 1 << 16:
                    yield send()
                    number, size = number + 1, 0
                    held.clear()
        if held:
            yield send()

    return docs.select(F.col(text).cast("string").alias("t")).mapInArrow(run, _PACKED)


def _shared_tokens(packed: DataFrame, bits: int) -> DataFrame:
    """Rows of _PACKED for the shingles that several sets have, with their counts, and the other kinds as they are."""
    low, kinds = 8 - bits // 8, arrow_schema(_PACKED)

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        sent = table.filter(pa.array(kind == 0))
        if not sent.num_rows:
            return table
        raw = b"".join(sent["token"].to_pylist())
        wide = np.zeros((len(raw) // low, 8), np.uint8)
        wide[:, :low] = np.frombuffer(raw, np.uint8).reshape(-1, low)
        top = np.uint64((1 << 64) - 1) << np.uint64(64 - bits)
        tokens = (wide.view("<u8").ravel() & ~top) | (np.uint64(key[0].as_py()) << np.uint64(64 - bits))
        order = np.argsort(tokens)
        ordered = tokens[order]
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        counts = np.diff(np.r_[first, len(ordered)])
        docs = np.empty(len(tokens), np.int64)
        docs[order] = np.repeat(counts, counts)
        rows, start = [], 0
        for src, at in zip(sent["src"].to_pylist(), sent["at"].to_pylist()):
            stop = start + len(at) // 2
            several = docs[start:stop] > 1
            if several.any():
                rows.append((key[0].as_py(), src, 2, _planes(_unplanes(at)[several]), tokens[start:stop][several].tobytes(), docs[start:stop][several].astype("<u4").tobytes()))
            start = stop
        found = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds) if rows else kinds.empty_table()
        return pa.concat_tables([found, table.filter(pa.array(kind != 0)).cast(kinds)])

    return packed.groupBy("bucket").applyInArrow(count, _PACKED)


_HELD = f"node binary, n long, m long, own long, length long, tokens binary, {', '.join(f'p{i} long' for i in range(PARITY))}"


def _choose(counted: DataFrame) -> DataFrame:
    """(node, n, m, own, length, tokens, p0...) for each set that can link: its matches, its unique shingles, the others
    by frequency, of which `length` are in its prefix, and the parity of those others. Copies give rows of their own."""
    kinds = arrow_schema(_HELD)

    def choose(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(r for r in rows if r["kind"] == 1)
        ids, sizes = own["at"], np.frombuffer(own["token"], "<i8")
        sent = [r for r in rows if r["kind"] == 2]
        if not sent:
            return kinds.empty_table()
        at = np.concatenate([_unplanes(r["at"]) for r in sent])
        tokens = np.frombuffer(b"".join(r["token"] for r in sent), "<u8")
        docs = np.frombuffer(b"".join(r["docs"] for r in sent), "<u4")
        shared = np.bincount(at, minlength=len(sizes))
        can = shared >= least_overlap(sizes)
        keep = can[at]
        at, tokens, docs = at[keep], tokens[keep], docs[keep]
        order = np.lexsort((tokens, docs, at))
        tokens, docs = tokens[order], docs[order]
        out, start = [], 0
        for i in np.flatnonzero(can).tolist():
            stop = start + int(shared[i])
            n = int(sizes[i])
            m, length = matches(n, docs[start:stop])
            mine = tokens[start:stop]
            out.append((ids[16 * i : 16 * i + 16], n, m, n - len(mine), length, mine.tobytes(), *parity(mine).tolist()))
            start = stop
        if not out:
            return kinds.empty_table()
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)

    return counted.groupBy("src").applyInArrow(choose, _HELD)


# ---- pairs ----------------------------------------------------------------------------------------------------------


def _prefixes(held: DataFrame) -> DataFrame:
    """(token, node, n, m, own) for each set and each shingle of its prefix that others have."""
    kinds = arrow_schema("token long, node binary, n long, m long, own long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                lengths = part.column("length").to_numpy()
                heads = [np.frombuffer(t, "<i8", n) for t, n in zip(part.column("tokens").to_pylist(), lengths.tolist())]
                places = pa.array(np.repeat(np.arange(len(heads)), lengths))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(heads)), *[part.column(c).take(places) for c in ("node", "n", "m", "own")]], schema=kinds)

    return held.select("node", "n", "m", "own", "length", "tokens").mapInArrow(run, "token long, node binary, n long, m long, own long")


def _room(nx: Column, ny: Column) -> Column:
    """How large the symmetric difference of linked sets of these sizes can be; negative if the sizes forbid a link."""
    both = nx + ny
    # intersection >= 0.8 union means intersection >= 4/9 of the sum of sizes, rounded up
    room = both - 2 * F.floor((PERCENT * both + 99 + PERCENT) / (100 + PERCENT))
    return F.when(100 * F.least(nx, ny) >= PERCENT * F.greatest(nx, ny), room).otherwise(-1)


def _verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets link."""
    sides = [held.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("tokens").alias(f"t{c}")) for c in "ab"]
    rows = pairs.select("a", "b").join(sides[0], "a").join(sides[1], "b").select("a", "b", "na", "nb", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, ta, tb = (batch.column(c).to_pylist() for c in ("na", "nb", "ta", "tb"))
            keep = [links(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), i, j) for i, j, x, y in zip(na, nb, ta, tb)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a binary, b binary")


def _candidates(rows: DataFrame, tested: DataFrame | None) -> DataFrame:
    """Pairs (a, b), a < b, of rows (a, b, least), at most one for each shingle that both prefixes have, with as many rows
    as least says, that are not tested yet. The count combines before the shuffle."""
    pairs = rows.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = pairs.agg(F.count(F.lit(1)).alias("shared"), F.max("least").alias("least")).filter("shared >= least").select("a", "b")
    return pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")


def _first_star(met: DataFrame) -> DataFrame:
    """(a, b, least): pairs of each shingle's pivot with the others. The pivot is, of the sets with the fewest
    unique shingles, the one with the least id: the text that copies were made from rather than one of the copies."""
    first = met.groupBy("token").agg(F.min(F.struct("own", "node", "n", "m")).alias("p")).select(F.col("token").alias("tk"), "p")
    star = met.join(first, F.col("token") == F.col("tk")).filter((F.col("node") != F.col("p.node")) & (_room(F.col("n"), F.col("p.n")) >= F.col("own") + F.col("p.own")))
    return star.select(F.col("p.node").alias("a"), F.col("node").alias("b"), F.least("m", "p.m").alias("least"))


def _mixed(met: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of met, with comp, under shingles that sets of several components have."""
    rows = met.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    several = rows.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y")
    return materialize(rows.join(several.select(F.col("token").alias("tk")), F.col("token") == F.col("tk"), "left_semi"), "mixed")


def _star(mixed: DataFrame) -> DataFrame:
    """(a, b, least): pairs of another pivot of each shingle with the sets of other components."""
    pivot = mixed.groupBy("token").agg(F.min(F.struct(F.xxhash64("node").alias("draw"), "node", "n", "m", "own", "comp")).alias("p")).select(F.col("token").alias("tk"), "p")
    star = mixed.join(pivot, F.col("token") == F.col("tk")).filter((F.col("comp") != F.col("p.comp")) & (_room(F.col("n"), F.col("p.n")) >= F.col("own") + F.col("p.own")))
    return star.select(F.col("p.node").alias("a"), F.col("node").alias("b"), F.least("m", "p.m").alias("least"))


def _all_pairs(mixed: DataFrame, held: DataFrame) -> DataFrame:
    """(a, b, least): all pairs of sets of different components that share shingles, as far as their sizes and
    parities let them link; those conditions are part of the join, so other pairs never become rows."""
    words = [f"p{i}" for i in range(PARITY)]
    names = ["node", "n", "m", "own", "comp", *words]
    rows = mixed.join(held.select(F.col("node").alias("hn"), *words), F.col("node") == F.col("hn")).select("token", *names)
    one = rows.select("token", *[F.col(c).alias(f"{c}_a") for c in names])
    two = rows.select(F.col("token").alias("tk"), *[F.col(c).alias(f"{c}_b") for c in names])
    apart = sum((F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in words), F.col("own_a") + F.col("own_b"))
    condition = (F.col("token") == F.col("tk")) & (F.col("node_a") < F.col("node_b")) & (F.col("comp_a") != F.col("comp_b"))
    pairs = one.join(two, condition & (apart <= _room(F.col("n_a"), F.col("n_b"))))
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), F.least("m_a", "m_b").alias("least"))


def _linked(docs: DataFrame, text: str, sets: DataFrame, classes: int, shingled: int) -> DataFrame | None:
    """(node, comp) of the classes that have links with others; None if there are none."""
    bits = max(8, (max(1, shingled // BUCKET) - 1).bit_length())
    packed = _packed(docs, text, _hot(sets, classes), bits)
    held = materialize(_choose(_shared_tokens(packed, bits)).dropDuplicates(["node"]), "held")
    rows = _prefixes(held)
    alike = rows.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1").select(F.col("token").alias("tk"))
    met = materialize(rows.join(alike, F.col("token") == F.col("tk"), "left_semi"), "met")
    if met.isEmpty():
        return None
    labels, found, tested = None, None, None
    for turn in (0, 1, 2):
        if turn == 0:
            pairs = _first_star(met)
        else:
            mixed = _mixed(met, labels) if labels is not None else met.withColumn("comp", F.col("node"))
            if mixed.isEmpty():
                break
            pairs = _star(mixed) if turn == 1 else _all_pairs(mixed, held)
        pairs = materialize(_candidates(pairs, tested), "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        more = materialize(_verified(pairs, held), "links")
        if not more.isEmpty():
            found = more if found is None else found.unionByName(more)
            labels = components(found)
    return labels


# ---- results --------------------------------------------------------------------------------------------------------


def _similar(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, h1, h2, n, node, component) of every row of docs; h1 and h2 as in _sets()."""
    sets = materialize(_sets(docs, key, text), "sets")
    members = sets.filter("node is not null").select("k", "h1", "h2", "n", "node")
    classes = members.filter("n > 0").groupBy("node").agg(F.min("k").alias("k"), F.min("n").alias("n"), F.max("n").alias("most"))
    classes = materialize(classes, "classes")
    size = classes.agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("n"), F.count_if(F.col("n") != F.col("most")).alias("clash")).first()
    if size["clash"]:
        raise ValueError("two sets of shingles have one 128-bit id")
    linked = _linked(docs, text, sets, size["classes"], size["n"] or 0) if size["classes"] else None
    if linked is None:
        named = classes.select("node", F.col("k").alias("component"))
    else:
        own = classes.join(linked, "node", "left").select("node", "k", F.coalesce("comp", "node").alias("comp"))
        least = own.groupBy("comp").agg(F.min("k").alias("component"))
        named = own.join(least, "comp").select("node", "component")
    out = members.join(named, "node", "left")
    return out.withColumn("component", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("k")))


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, node, component) of every row of docs: the size of its set, the id of its set, and the least key that
    links reach from it.

    A null or empty text, or one of white space, has no set: n is 0 and its component its own key. Rows with equal sets
    are linked, so repeated rows are in one component. Null keys are never a component's name unless all are null.
    No rows give no rows. docs must give the same rows when it is read again, as tables do."""
    return _similar(docs, key, text).select(F.col("k").alias(key), "n", "node", "component")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without near duplicates: of each component the row with the least key, and of rows that have
    this key in the component too (repeated rows, or rows of other texts) that with the least hashes of its text and
    then of all its columns. Rows without a set stay. All columns are kept, whatever their names."""
    found = materialize(_similar(docs, key, text), "components")
    first = found.filter((F.col("n") > 0) & F.col("k").eqNullSafe(F.col("component")))
    chosen = first.groupBy("component").agg(F.min(F.struct("h1", "h2")).alias("least"), F.count(F.lit(1)).alias("rows"))
    chosen = chosen.select(F.col("component").alias("k"), "least.*", "rows")
    without = found.filter("n = 0").select("k", "h1", "h2").distinct().withColumn("rows", F.lit(0))
    chosen = chosen.unionByName(without).select(*[F.col(c).alias(f"c_{c}") for c in ("k", "h1", "h2", "rows")])
    digest = lambda seed: F.when(F.col(text).isNotNull(), F.xxhash64(F.lit(seed), F.col(text)))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("k"), digest(1).alias("h1"), digest(2).alias("h2"))
    match = F.col("k").eqNullSafe(F.col("c_k")) & F.col("h1").eqNullSafe(F.col("c_h1")) & F.col("h2").eqNullSafe(F.col("c_h2"))
    kept = rows.join(chosen, match)
    if not first.groupBy("component").count().filter("count > 1").isEmpty():
        order = Window.partitionBy("k", "h1", "h2").orderBy(F.xxhash64(F.to_json("row")))
        several = kept.filter("c_rows > 1").withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")
        kept = kept.filter("c_rows <= 1").unionByName(several)
    return kept.select("row.*")

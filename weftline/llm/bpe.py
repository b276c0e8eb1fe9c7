"""Byte-level BPE by a rank queue: buckets of linked-list positions under a hierarchical bitmap.

Each merge rank has a bucket of positions whose pair has that rank. A bitmap of three levels says which buckets hold
anything; finding the first set bit in it gives the next rank in constant time, whatever the pre-token's length.
A merge leaves the entries of the pairs that it destroyed where they are: an entry whose position no longer has the
bucket's rank is stale and skipped.
"""

from __future__ import annotations

import base64
import hashlib
import re
from struct import pack

import numpy as np
import regex
from pyspark.sql import DataFrame

from .arrow import map_texts

BITS = 6
WORD = (1 << BITS) - 1
SHIFT = 18  # ranks are below 2**SHIFT
NONE = -1
#: What BytePairEncoder.joined, which is slower, needs at least.
_LOOSE = re.compile(r" (?:\s|\Z)")


class RankBitmap:
    """Set of ranks: a bit for each rank, and over it a bit for each word that is not zero, twice."""

    def __init__(self):
        self.low, self.mid, self.top = [0] * (1 << 2 * BITS), [0] * (1 << BITS), 0

    def add(self, rank: int) -> None:
        a, b = rank >> BITS, rank >> 2 * BITS
        self.low[a] |= 1 << (rank & WORD)
        self.mid[b] |= 1 << (a & WORD)
        self.top |= 1 << b

    def pop(self) -> int:
        """Takes out the least rank; NONE if there is none."""
        if not self.top:
            return NONE
        b = (self.top & -self.top).bit_length() - 1
        a = b << BITS | (self.mid[b] & -self.mid[b]).bit_length() - 1
        bit = self.low[a] & -self.low[a]
        self.low[a] ^= bit
        if not self.low[a]:
            self.mid[b] &= ~(1 << (a & WORD))
            if not self.mid[b]:
                self.top &= ~(1 << b)
        return a << BITS | bit.bit_length() - 1


class BytePairEncoder:
    """Encodes and decodes with ranks (token bytes to id); pattern splits a text into pre-tokens.

    spaces: whether the pattern is of the kind that encode_packed() can split at spaces for.

    Pre-tokens that are not in the cache go through the queue together, as one long list with breaks between them: no
    pair spans a break, so each comes out as it would alone, and a rank's bucket serves all of them at once."""

    CACHED = 700_000  # entries of a cache of short pieces; it is emptied when it has more
    LONGEST_CACHED = 40
    TOGETHER = 1 << 20  # bytes that go through the queue together, but for longer pre-tokens

    def __init__(self, ranks: dict[bytes, int], pattern: str, spaces: bool = False):
        if ranks and max(ranks.values()) >= 1 << SHIFT:
            raise ValueError(f"ranks must be below {1 << SHIFT}")
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([ranks.get(bytes([i]), NONE) for i in range(256)], np.int64)
        self.first = np.full((256, 256), NONE, np.int64)  # ranks of pairs of bytes
        for token, rank in ranks.items():
            if len(token) == 2:
                self.first[token[0], token[1]] = rank
        self.pairs: dict[int, int] = {}  # two ids to the rank of their pair, as far as met
        self.pattern, self.spaces = regex.compile(pattern), spaces
        # A space that has white space before it and none or an end after it can join a longer run.
        self.joined = regex.compile(r"\s (?!\S)")
        self.spaced: dict[str, bytes] = {}  # by a text without its leading space
        self.bare: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each of several pre-tokens."""
        wholes = [self.ranks.get(piece) for piece in pieces]  # these are tokens as they are
        raw = np.frombuffer(b"".join(p for p, whole in zip(pieces, wholes) if whole is None), np.uint8)
        ends = np.cumsum([len(p) for p, whole in zip(pieces, wholes) if whole is None], dtype=np.int64)
        n = len(raw)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        # Ranks of the pairs that begin at each place, as they are before any merge; no pair spans a break.
        first = np.full(n, NONE, np.int64)
        first[: max(n - 1, 0)] = self.first[raw[:-1], raw[1:]]
        breaks = ends[ends > 0] - 1
        after[breaks] = first[breaks] = NONE
        before[ends[ends < n]] = NONE
        there = np.flatnonzero(first >= 0)
        there = there[np.argsort(first[there], kind="stable")]
        at = first[there]
        edges = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.empty(0, np.int64)
        buckets = {int(at[i]): there[i:j].tolist() for i, j in zip(edges.tolist(), [*edges[1:].tolist(), len(at)])}
        queue, pairs, ranks, tokens = RankBitmap(), self.pairs, self.ranks, self.tokens
        for rank in buckets:
            queue.add(rank)
        ids, after, before, rank_at = self.bytes[raw].tolist(), after.tolist(), before.tolist(), first.tolist()
        while (rank := queue.pop()) >= 0:
            held = buckets.pop(rank)
            held.sort()  # the leftmost pair of a rank goes first
            for k, i in enumerate(held):
                if rank_at[i] != rank:
                    continue  # stale
                j = after[i]
                ids[i] = rank
                rank_at[j] = NONE
                ids[j] = NONE
                follow = after[i] = after[j]
                if follow >= 0:
                    before[follow] = i
                lower = False
                for left, right in ((i, follow), (before[i], i)):
                    if left < 0 or right < 0:
                        if left >= 0:
                            rank_at[left] = NONE
                        continue
                    pair = ids[left] << SHIFT | ids[right]
                    new = pairs.get(pair)
                    if new is None:
                        new = pairs[pair] = ranks.get(tokens[ids[left]] + tokens[ids[right]], NONE)
                    rank_at[left] = new
                    if new >= 0:
                        lower |= new < rank
                        if new in buckets:
                            buckets[new].append(left)
                        else:
                            buckets[new] = [left]
                            queue.add(new)
                if lower:  # a lower rank goes before the rest of this bucket
                    if rest := held[k + 1 :]:
                        buckets[rank] = rest
                        queue.add(rank)
                    break
        if len(pairs) > 4_000_000:
            pairs.clear()
        out, start, bounds = [], 0, iter(ends.tolist())
        for whole in wholes:
            if whole is None:
                end = next(bounds)
                out.append([x for x in ids[start:end] if x >= 0])
                start = end
            else:
                out.append([whole])
        return out

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Packed ids of pre-tokens."""
        out: dict[str, bytes] = {}
        group: list[str] = []
        held = 0
        for i, piece in enumerate(ordered := list(pieces)):
            group.append(piece)
            held += len(piece)
            if held >= self.TOGETHER or i + 1 == len(ordered):
                for one, ids in zip(group, self.merge([p.encode() for p in group])):
                    out[one] = pack(f"<{len(ids)}I", *ids)
                group, held = [], 0
        return out

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """Ids of texts as little-endian unsigned 32-bit integers.

        With `spaces`, a pre-token of the pattern never has a space inside, and where no space has white space on both
        sides a space begins one. Such texts are split at spaces, so that frequent words come from the cache; others go
        through the pattern, as all texts do without it."""
        for cache in (self.spaced, self.bare):
            if len(cache) > self.CACHED:
                cache.clear()
        spaced, bare, find = self.spaced, self.bare, self.pattern.findall
        split: list[tuple[list[str], list[str]]] = []  # pre-tokens without, words with a space before them
        unknown: dict[str, list[str]] = {}
        pieces: set[str] = set()
        for text in texts:
            if not self.spaces or (_LOOSE.search(text) and self.joined.search(text)):
                split.append((find(text), []))
            else:
                head, *words = text.split(" ")
                split.append((find(head), words))
                for word in set(words).difference(spaced):
                    if word not in unknown:
                        unknown[word] = find(" " + word)
            pieces.update(p for p in split[-1][0] if p not in bare)
        for word, parts in unknown.items():
            pieces.update(p for p in parts if p not in bare and not (p[0] == " " and p[1:] in spaced))
        learned = self._learn(pieces)

        def known(piece: str) -> bytes:
            packed = learned.get(piece)
            if packed is None:
                packed = bare.get(piece)
            return spaced[piece[1:]] if packed is None else packed

        spaced.update([(word, b"".join(map(known, parts))) for word, parts in unknown.items()])
        out = [b"".join([*map(known, heads), *map(spaced.__getitem__, words)]) for heads, words in split]
        for word in unknown:
            if len(word) >= self.LONGEST_CACHED:
                del spaced[word]
        bare.update((p, b) for p, b in learned.items() if p[0] != " " and len(p) < self.LONGEST_CACHED)
        spaced.update((p[1:], b) for p, b in learned.items() if p[0] == " " and len(p) < self.LONGEST_CACHED)
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed([text])[0], "<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines "base64 rank"."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


_ENCODERS: dict[str, BytePairEncoder] = {}


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text", spaces: bool = False) -> DataFrame:
    """(key, ids array<int>, decoded binary) of every row of docs. Null texts count as empty; repeated rows stay.

    The vocabulary goes to the executors as one broadcast of a fixed size. There is no shuffle."""
    return _per_text(docs, ranks, pattern, key, text, spaces, "ids array<int>, decoded binary", _whole)


def token_digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text", spaces: bool = False) -> DataFrame:
    """encode_documents() with n_tokens, ids_sha256 and decoded_sha256 instead of ids and bytes."""
    return _per_text(docs, ranks, pattern, key, text, spaces, "n_tokens long, ids_sha256 string, decoded_sha256 string", _digest)


def _whole(encoder: BytePairEncoder, packed: bytes) -> tuple:
    ids = np.frombuffer(packed, "<u4").tolist()
    return ids, encoder.decode(ids)


def _digest(encoder: BytePairEncoder, packed: bytes) -> tuple:
    decoded = encoder.decode(np.frombuffer(packed, "<u4").tolist())
    return len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest()


def _per_text(docs, ranks, pattern, key, text, spaces, columns, of) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern, spaces))
    version = hashlib.sha256(repr((sorted(ranks.items()), pattern, spaces)).encode()).hexdigest()

    def encoding():
        if version not in _ENCODERS:  # a worker keeps its encoder, and the cache in it, for later tasks
            _ENCODERS.clear()
            _ENCODERS[version] = BytePairEncoder(*shared.value)
        encoder = _ENCODERS[version]

        def run(texts: list[str | None]) -> list:
            rows = []
            for at in range(0, len(texts), 1000):
                rows += [of(encoder, p) for p in encoder.encode_packed([t or "" for t in texts[at : at + 1000]])]
            return list(zip(*rows)) or [[]] * columns.count(",")

        return run

    return map_texts(docs, text, {key: key}, columns, encoding)

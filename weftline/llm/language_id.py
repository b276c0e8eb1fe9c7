"""Language identification of mixed text: scripts narrow, word scores, and Viterbi with a switching penalty.

The model holds, for each learned language, log probabilities of character n-grams (hashed into a table of fixed
size) and the scripts in which it is written. A word's script leaves only the languages that use it; its score in each
is the mean log probability of its n-grams. Viterbi over a text's words, with a penalty for each change of language,
labels every word; runs of one label are spans.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import map_texts

BUCKETS = 1 << 16
SWITCH = 12.0  # log units that a change of language costs
MOST_ROWS = 4000  # labelled rows that a model is fitted on, about as many of each language
UNKNOWN = "und"
#: First and last code point of scripts. What is in none of them is the script "other".
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F),
    ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("devanagari", 0x900, 0x97F),
    ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(text: str | None) -> list[str]:
    """Runs of letters with their marks, in lower case."""
    return _WORD.findall(text.lower()) if text else []


def script_of(word: str) -> str:
    """Script of a word's first letter."""
    at = ord(word[0])
    for name, low, high in SCRIPTS:
        if low <= at <= high:
            return name
    return "other"


class _Buckets(dict):
    """Buckets of n-grams, kept once they are known; there are few different ones."""

    def __missing__(self, gram: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[gram] = at = crc32(gram.encode()) % BUCKETS
        return at


_BUCKET = _Buckets()


def grams(word: str) -> list[int]:
    """Buckets of a word's n-grams of 1 to 3 characters, its ends marked, and of the whole word."""
    marked, bucket = f"<{word}>", _BUCKET
    out = [bucket[c] for c in marked]
    out += [bucket[a + b] for a, b in zip(marked, marked[1:])]
    out += [bucket[a + b + c] for a, b, c in zip(marked, marked[1:], marked[2:])]
    out.append(crc32(f"={word}".encode()) % BUCKETS)
    return out


@dataclass
class Model:
    """table: BUCKETS x languages, log probabilities; allowed: script to a mask over languages; prior: log shares."""

    languages: list[str]
    table: np.ndarray
    allowed: dict[str, np.ndarray]
    prior: np.ndarray

    def word_scores(self, words: list[str]) -> np.ndarray:
        """A row for each word: the mean log probability of its n-grams, longer words weighing more, in the languages
        that its script allows."""
        each = [grams(w) for w in words]
        sizes = np.array([len(g) for g in each])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        total = np.add.reduceat(self.table[np.fromiter(chain.from_iterable(each), np.int64, sizes.sum())], starts, axis=0)
        scores = total / sizes[:, None] * np.minimum([len(w) for w in words], 8)[:, None]
        everywhere = np.ones(len(self.languages), bool)
        allowed = np.array([self.allowed.get(script_of(w), everywhere) for w in words])
        return np.where(allowed, scores, -60.0)


def fit(rows: list[tuple[str, str]]) -> Model:
    """Model from (text, language) pairs."""
    languages = sorted({lang for _, lang in rows})
    counts = np.zeros((BUCKETS, len(languages)))
    scripts: dict[str, np.ndarray] = {}
    seen = np.zeros(len(languages))
    words_in: list[Counter] = [Counter() for _ in languages]
    for text, lang in rows:
        at = languages.index(lang)
        seen[at] += 1
        words_in[at].update(words_of(text))
    for at, words in enumerate(words_in):
        for word, n in words.items():
            counts[grams(word), at] += n
            scripts.setdefault(script_of(word), np.zeros(len(languages)))[at] += n
    share = (counts + 0.5) / (counts.sum(axis=0) + 0.5 * BUCKETS)
    # A language is a candidate for a script that makes up a thousandth of its words at least.
    words = sum(scripts.values(), np.zeros(len(languages)))
    allowed = {s: n >= 0.001 * np.maximum(words, 1) for s, n in scripts.items()}
    allowed = {s: mask for s, mask in allowed.items() if mask.any()}
    return Model(languages, np.log(share).astype(np.float32), allowed, np.log((seen + 1) / (seen.sum() + len(languages))))


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best labels of several texts at once. scores: all their words' scores, text after text; lengths: words of each."""
    n = len(lengths)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if n else np.array([], int)
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    labels = np.zeros(len(scores), np.int16)
    back = np.zeros(scores.shape, np.int16)  # label of the word before, by this word's label
    best = np.zeros((n, scores.shape[1]), np.float64)
    own = np.arange(scores.shape[1], dtype=np.int16)
    last = np.zeros(n, np.int16)
    steps = int(sizes[0]) if n else 0
    live_at = np.searchsorted(-sizes, -np.arange(1, steps + 1), side="right")
    for t in range(steps):  # texts with more than t words come first in this order
        live = live_at[t]
        at = starts[order[:live]] + t
        now = best[:live]
        if t:
            top = now.argmax(axis=1)
            jump = now[np.arange(live), top] - switch
            stay = now >= jump[:, None]
            back[at] = np.where(stay, own, top[:, None])
            now = np.where(stay, now, jump[:, None])
        best[:live] = now + scores[at]
    for t in range(steps - 1, -1, -1):
        live = live_at[t]
        at = starts[order[:live]] + t
        ended = sizes[:live] == t + 1
        last[:live] = np.where(ended, best[:live].argmax(axis=1), last[:live])
        labels[at] = last[:live]
        if t:
            last[:live] = back[at, last[:live]]
    return labels


class Labeller:
    """Labels texts with a model; keeps word scores in a cache of bounded size."""

    CACHED = 500_000
    AT_ONCE = 20_000

    def __init__(self, model: Model, switch: float = SWITCH):
        self.model, self.switch = model, switch
        self.cache: dict[str, int] = {}
        self.rows = np.zeros((self.CACHED, len(model.languages)), np.float32)

    def _places(self, words: list[str]) -> list[int]:
        """Rows of self.rows that hold the words' scores."""
        missing = dict.fromkeys(w for w in words if w not in self.cache)
        if len(self.cache) + len(missing) > self.CACHED:
            self.cache.clear()
            missing = dict.fromkeys(words)
            if len(missing) > len(self.rows):
                self.rows = np.zeros((len(missing), self.rows.shape[1]), np.float32)
        new = list(missing)
        for at in range(0, len(new), self.AT_ONCE):
            some = new[at : at + self.AT_ONCE]
            first = len(self.cache)
            self.rows[first : first + len(some)] = self.model.word_scores(some)
            self.cache.update(zip(some, range(first, first + len(some))))
        return [self.cache[w] for w in words]

    def label(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Labels and scores of all words of several texts (lists of words), and the number of words of each."""
        lengths = np.array([len(t) for t in texts], np.int64)
        places = self._places([w for t in texts for w in t])
        scores = self.rows[places]
        return viterbi(scores, lengths, self.switch), scores, lengths


def _slices(texts: list[str | None], most: int = 4_000_000) -> Iterator[list[int]]:
    """Places of the texts in groups of about `most` characters, so that memory stays bounded; texts of like lengths
    are together, because a group takes as many steps as its longest text has words."""
    group, held = [], 0
    for i in sorted(range(len(texts)), key=lambda i: len(texts[i] or "")):
        group.append(i)
        held += len(texts[i] or "")
        if held >= most:
            yield group
            group, held = [], 0
    if group:
        yield group


def summarize(labeller: Labeller, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Main language of each text and the share of its letters in that language's spans, as a score."""
    langs, shares = [UNKNOWN] * len(texts), [0.0] * len(texts)
    names, n = labeller.model.languages, len(labeller.model.languages)
    if not n:
        return langs, shares
    for group in _slices(texts):
        words = [words_of(texts[i]) for i in group]
        labels, _, lengths = labeller.label(words)
        weight = np.array([len(w) for t in words for w in t], np.float64)
        text_of = np.repeat(np.arange(len(group)), lengths)
        mass = np.bincount(text_of * n + labels, weights=weight, minlength=len(group) * n).reshape(-1, n)
        for row, i in enumerate(group):
            if lengths[row]:
                top = int(mass[row].argmax())
                langs[i], shares[i] = names[top], float(mass[row, top] / mass[row].sum())
    return langs, shares


def spans(labeller: Labeller, text: str | None) -> list[dict]:
    """Runs of words of one language: start and end in code points, and lang."""
    if not text or not labeller.model.languages:
        return []
    lower = text.lower()
    if len(lower) != len(text):  # a few letters change length in lower case; then places are those of the lower text
        text = lower
    found = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(lower)]
    labels, _, _ = labeller.label([[w for _, _, w in found]])
    out: list[dict] = []
    for (start, end, _), label in zip(found, labels):
        lang = labeller.model.languages[label]
        if out and out[-1]["lang"] == lang:
            out[-1]["end"] = end
        else:
            out.append({"start": start, "end": end, "lang": lang})
    return out


def training_rows(docs: DataFrame, include: Column, most: int = MOST_ROWS, key: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, str]]:
    """About `most` whole labelled texts, shared out evenly over the languages: those with the least hashes of key.

    This is the bounded sample that a model is fitted on; a language with fewer rows gives them all."""
    rows = docs.filter(include & F.col(text).isNotNull() & F.col(lang).isNotNull())
    rows = rows.select(F.col(text).alias("t"), F.col(lang).alias("l"), F.pmod(F.xxhash64(key), F.lit(1_000_000)).alias("h"))
    counts = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}
    if not counts:
        return []
    per = max(1, most // len(counts))
    limit = F.lit(-1)
    for one, n in counts.items():
        limit = F.when(F.col("l") == one, F.lit(min(1_000_000, -(-1_000_000 * per // n)))).otherwise(limit)
    return [(r["t"], r["l"]) for r in rows.filter(F.col("h") < limit).select("h", "t", "l").collect()]


_LABELLERS: dict[str, Labeller] = {}


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", with_spans: bool = False, keep=()) -> DataFrame:
    """(key, *keep, lang_pred, score) of every row of docs, and with with_spans the spans of its languages.

    A text that is null or has no letter is `und` with score 0. Repeated rows stay; no rows give no rows. The model has
    a fixed number of buckets for each language and is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    version = uuid.uuid4().hex
    schema = "lang_pred string, score double" + (", spans array<struct<start:int,end:int,lang:string>>" if with_spans else "")

    def labelling():
        if version not in _LABELLERS:  # a worker keeps its labeller, and the cache in it, for later tasks
            _LABELLERS.clear()
            _LABELLERS[version] = Labeller(shared.value)
        labeller = _LABELLERS[version]

        def run(texts: list[str | None]) -> list:
            return [*summarize(labeller, texts), *([[spans(labeller, t) for t in texts]] if with_spans else [])]

        return run

    return map_texts(docs, text, {key: key, **{c: c for c in keep}}, schema, labelling)

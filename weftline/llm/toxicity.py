"""Toxicity by a convolutional text classifier in numpy.

Words are hashed to rows of an embedding table, whole and by their beginnings, so that forms of a word share weights; the
mean of its rows is a word's embedding. Filters of several widths run over the words of the whole text, a maximum over
places pools each, and a logistic layer gives a raw score. All weights start at random and are trained by mini-batches. A
text's language is guessed by words that the training rows showed to be a language's own, and the threshold found for that
language on calibration rows maps to 0.5.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice
from zlib import crc32

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 18, 16, 8, (1, 2, 3)
BEGINNINGS = (3, 4, 5, 6)  # lengths of a word's beginnings that are hashed beside the whole word
MOST_ROWS = 12_000  # labelled rows that a model is fitted on: about a quarter of them of label 1
BATCH, EPOCHS, RATE = 32, 3, 0.1
AT_ONCE = 60_000  # words that go through the filters at once, but for longer texts
MISSED = 2  # texts wrongly caught that weigh as much as one missed, for the thresholds
OWN_WORDS, OWN_TEXTS = 40, 300  # words of a language that tell it from others, and texts of it that they come from
_GAP = max(WIDTHS) - 1
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_OTHER = "other"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


@dataclass
class Model:
    """embedding: BUCKETS x DIM; filters[i]: (WIDTHS[i] * DIM) x FILTERS; bias[i]; out: weights and bias; own: words to
    their language; thresholds of the raw score by guessed language."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    own: dict[str, str] = field(default_factory=dict)
    thresholds: dict[str, float] = field(default_factory=lambda: {_OTHER: 0.0})


class Words(dict):
    """Numbers of words, new ones in order from `first` on, and the buckets of each."""

    def __init__(self, first: int = 0):
        self.first, self.buckets = first, array("i")

    def __missing__(self, word: str) -> int:
        self[word] = number = self.first + len(self)
        self.buckets.append(crc32(word.encode()) % BUCKETS)
        self.buckets.extend([crc32(f"^{word[:n]}".encode()) % BUCKETS for n in BEGINNINGS])
        return number

    def rows(self, first: int = 0) -> np.ndarray:
        """Buckets of the words, a row for each, from a row on."""
        return np.array(self.buckets[first * (1 + len(BEGINNINGS)) :], np.int32).reshape(-1, 1 + len(BEGINNINGS))


def _laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of several texts one after another with gaps of -1 between, and where each begins and ends."""
    sizes = np.array([max(1, len(t)) for t in texts])
    starts = np.cumsum(sizes + _GAP) - sizes - _GAP
    line = np.full(int(sizes.sum()) + _GAP * len(texts), -1, np.int64)
    for text, start in zip(texts, starts.tolist()):
        line[start : start + len(text)] = text
    return line, starts, starts + sizes


def pooled(model: Model, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of each filter over all places of each text, and the places. rows: embeddings as laid out."""
    best, place = [], []
    for i, width in enumerate(WIDTHS):
        views = np.concatenate([rows[k : len(rows) - width + 1 + k] for k in range(width)], axis=1)
        response = views @ model.filters[i] + model.bias[i]
        at = np.array([response[s:e].argmax(axis=0) + s for s, e in zip(starts.tolist(), ends.tolist())]).reshape(-1, FILTERS)
        best.append(np.take_along_axis(response, at, 0))
        place.append(at)
    return np.maximum(np.concatenate(best, axis=1), 0), np.concatenate(place, axis=1)


class Scorer:
    """Raw scores and guessed languages of texts; keeps embeddings of words in a table of bounded size."""

    CACHED = 300_000

    def __init__(self, model: Model):
        self.model, self.languages = model, sorted(set(model.own.values()))
        self._clear()

    def _clear(self) -> None:
        self.words, self.table, self.lang = Words(), np.empty((0, DIM), np.float32), np.empty(0, np.int64)

    def _number(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.words) > self.CACHED:
            self._clear()
        found = [np.array([*map(self.words.__getitem__, words_of(t))], np.int64) for t in texts]
        if len(self.words) > len(self.table):
            new = self.words.rows(len(self.table))
            code = {lang: i for i, lang in enumerate(self.languages)}
            langs = [code.get(self.model.own.get(w), -1) for w in islice(self.words, len(self.table), None)]
            self.table = np.concatenate([self.table, self.model.embedding[new].mean(axis=1)])
            self.lang = np.concatenate([self.lang, np.array(langs, np.int64)])
        return found

    def raw(self, texts: list[str | None]) -> tuple[np.ndarray, list[str]]:
        """Raw scores of texts, and the languages whose own words are most of their words."""
        scores, guesses = [], []
        for first in range(0, len(texts), 500):
            numbers = self._number(texts[first : first + 500])
            group, held = [], 0
            for i, one in enumerate(numbers):
                group.append(one)
                held += len(one)
                if held >= AT_ONCE or i + 1 == len(numbers):
                    line, starts, ends = _laid_out(group)
                    rows = np.zeros((len(line), DIM), np.float32)
                    rows[line >= 0] = self.table[line[line >= 0]]
                    scores.append(pooled(self.model, rows, starts, ends)[0] @ self.model.out + self.model.out_bias)
                    group, held = [], 0
            for one in numbers:
                counts = np.bincount(self.lang[one] + 1, minlength=len(self.languages) + 1)[1:]
                guesses.append(self.languages[int(counts.argmax())] if counts.any() else _OTHER)
        return np.concatenate([np.empty(0), *scores]), guesses

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """Calibrated scores from 0 to 1: 0.5 at the threshold of the language that the words themselves suggest."""
        raw, guesses = self.raw(texts)
        limits = self.model.thresholds
        return 1 / (1 + np.exp(-np.clip(raw - np.array([limits.get(g, limits[_OTHER]) for g in guesses]), -30, 30)))


def own_words(rows: list[tuple]) -> dict[str, str]:
    """Words to the language whose own they are: for each language, those in a larger share of its texts than of any
    other language's texts, by the difference."""
    texts, having = Counter(), {}
    for text, _, *lang in rows:
        if lang and lang[0] is not None and texts[lang[0]] < OWN_TEXTS:
            texts[lang[0]] += 1
            having.setdefault(lang[0], Counter()).update(set(words_of(text)))
    out = {}
    for lang, counts in having.items() if len(having) > 1 else ():
        others = [other for other in having if other != lang]
        rest = lambda w: max(having[o][w] / texts[o] for o in others)  # noqa: B023, E731
        ahead = sorted(((n / texts[lang] - rest(w), w) for w, n in counts.most_common(20 * OWN_WORDS)), reverse=True)
        out.update((w, lang) for share, w in ahead[:OWN_WORDS] if share > 0)
    return out


def fit(rows: list[tuple], seed: int = 3) -> Model:
    """Model from (text, label) or (text, label, lang) rows. A fifth of them, by hashes of the texts, calibrates the
    thresholds; the others train all weights, which start at random.

    Mini-batches with Adagrad; both labels weigh the same in all; a maximum passes its gradient to the place that it came
    from, and from there to all buckets of its words."""
    rng = np.random.default_rng(seed)
    normal = lambda *shape: rng.standard_normal(shape, dtype=np.float32)
    filters = [normal(w * DIM, FILTERS) / np.float32(np.sqrt(w * DIM)) for w in WIDTHS]
    model = Model(normal(BUCKETS, DIM) * np.float32(0.1), filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], normal(len(WIDTHS) * FILTERS) * np.float32(0.3), -2.0)
    model.own = own_words(rows)
    part = [crc32((row[0] or "").encode()) % 5 for row in rows]
    train = [row for row, n in zip(rows, part) if n] or rows
    labels = np.array([row[1] for row in train], np.int64)
    if len(set(labels.tolist())) == 2:
        numbers, buckets, first = [], [], 0
        for at in range(0, len(train), 500):  # words have numbers anew for each of these parts, which bounds memory
            words = Words(first)
            numbers += [np.array([*map(words.__getitem__, words_of(row[0]))], np.int32) for row in train[at : at + 500]]
            buckets.append(words.rows())
            first += len(words)
        _train(model, numbers, labels, np.concatenate(buckets), rng)
    held = [row for row, n in zip(rows, part) if not n] or rows
    raw, guesses = Scorer(model).raw([row[0] for row in held])
    model.thresholds = _thresholds([(float(s), int(row[1]), g) for s, row, g in zip(raw, held, guesses)])
    return model


def _train(model: Model, texts: list[np.ndarray], labels: np.ndarray, buckets: np.ndarray, rng: np.random.Generator) -> None:
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    seen = [np.full(x.shape, 1e-3, np.float32) for x in (*model.filters, *model.bias, model.out)]
    seen_rows, seen_bias = np.full(BUCKETS, 1e-3, np.float32), 1e-3

    def step(weights: np.ndarray, gradient: np.ndarray, squares: np.ndarray) -> None:
        squares += gradient**2
        weights -= RATE * gradient / np.sqrt(squares)

    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for first in range(0, len(order), BATCH):
            at = order[first : first + BATCH]
            line, starts, ends = _laid_out([texts[i] for i in at])
            rows = np.zeros((len(line), DIM), np.float32)
            rows[line >= 0] = model.embedding[buckets[line[line >= 0]]].mean(axis=1)
            features, place = pooled(model, rows, starts, ends)
            raw = np.clip(features @ model.out + model.out_bias, -30, 30)
            error = ((1 / (1 + np.exp(-raw)) - labels[at]) * weight[at]).astype(np.float32)
            down = error[:, None] * model.out * (features > 0)
            step(model.out, (error[:, None] * features).sum(axis=0), seen[-1])
            seen_bias += float(error.sum()) ** 2
            model.out_bias -= RATE * float(error.sum()) / np.sqrt(seen_bias)
            words, steps = [], []
            for i, width in enumerate(WIDTHS):
                mine = slice(i * FILTERS, (i + 1) * FILTERS)
                to, spot = down[:, mine], place[:, mine]
                views = np.concatenate([rows[spot + k] for k in range(width)], axis=2)
                back = to[:, :, None] * model.filters[i].T[None]
                some = np.abs(to) > 1e-4
                for k in range(width):
                    words.append(line[spot[some] + k])
                    steps.append(back[some][:, k * DIM : (k + 1) * DIM])
                step(model.filters[i], np.einsum("bf,bfd->df", to, views), seen[i])
                step(model.bias[i], to.sum(axis=0), seen[len(WIDTHS) + i])
            word, gradient = np.concatenate(words), np.concatenate(steps)
            word, gradient = word[word >= 0], gradient[word >= 0]
            per = buckets.shape[1]
            touched, back_to = np.unique(buckets[word].ravel(), return_inverse=True)
            total = np.zeros((len(touched), DIM), np.float32)
            np.add.at(total, back_to, np.repeat(gradient / per, per, axis=0))
            seen_rows[touched] += (total**2).mean(axis=1)
            model.embedding[touched] -= RATE * total / np.sqrt(seen_rows[touched])[:, None]


def _thresholds(scored: list[tuple[float, int, str]]) -> dict[str, float]:
    """For each guessed language the raw score that makes fewest errors on these rows, of several the one nearest to 0,
    where training has both labels balanced. A text missed counts MISSED times one wrongly caught. A language with few
    rows of label 1 takes the threshold of all rows."""

    def best(rows: list[tuple[float, int]]) -> float | None:
        if len({label for _, label in rows}) < 2:
            return None
        rows = sorted(rows)
        zeros = sum(1 - label for _, label in rows)
        below_ones, below_zeros, cost = 0, 0, []
        below_zero = lambda at: sum(MISSED * y if s < at else 1 - y for s, y in rows)
        edges = [rows[0][0] - 1] + [(a[0] + b[0]) / 2 for a, b in zip(rows, rows[1:])] + [rows[-1][0] + 1]
        for i, edge in enumerate(edges):
            cost.append((MISSED * below_ones + zeros - below_zeros, edge))
            if i < len(rows):
                below_ones += rows[i][1]
                below_zeros += 1 - rows[i][1]
        least = min(c for c, _ in cost)
        return min((edge for c, edge in [*cost, (below_zero(0.0), 0.0)] if c == least), key=abs)

    overall = best([(s, y) for s, y, _ in scored])
    out = {_OTHER: 0.0 if overall is None else overall}
    for lang in {lang for _, _, lang in scored}:
        own = [(s, y) for s, y, g in scored if g == lang]
        found = best(own) if sum(y for _, y in own) >= 5 else None
        out[lang] = out[_OTHER] if found is None else found
    return out


def training_rows(docs: DataFrame, labels: DataFrame, include: Column, most: int = MOST_ROWS, key: str = "doc_id", text: str = "text", label: str = "toxic", lang: str = "lang") -> list[tuple]:
    """About `most` whole labelled texts (text, label, lang), a quarter of them of label 1 where there are so many: those
    with the least hashes of key. A key with several labels counts as 1 if any is; lang is null where docs has none.
    This is the bounded sample that a model is fitted on; include is a condition on the key, named lk."""
    marked = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("lk")).agg(F.max(label).alias("label"))
    marked = marked.withColumn("h", F.pmod(F.xxhash64("lk"), F.lit(1_000_000))).filter(include)
    counts = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    if not counts:
        return []
    limit = F.lit(-1)
    for one, n in counts.items():
        limit = F.when(F.col("label") == one, F.lit(min(1_000_000, -(-1_000_000 * (most // 4 * (1 if one else 3)) // n)))).otherwise(limit)
    chosen = marked.filter(F.col("h") < limit).select("lk", "label")  # bounded by `most`, so it can be broadcast
    spoken = F.col(lang) if lang in docs.columns else F.lit(None)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), spoken.cast("string").alias("l")).filter(F.col("t").isNotNull())
    rows = rows.join(F.broadcast(chosen), F.col("k") == F.col("lk")).select("k", "t", "label", "l").collect()
    return [(r["t"], int(r["label"]), r["l"]) for r in sorted(rows, key=lambda r: (r["k"], r["t"], r["l"] or ""))]


def scorer(spark: SparkSession, model: Model):
    """A pandas UDF from texts to scores. The model's size is fixed, and it is broadcast."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score_all = Scorer(shared.value)
        for texts in batches:
            yield pd.Series(score_all([t if isinstance(t, str) else None for t in texts]), dtype="float64")

    return run


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score double, predicted int) of every row of docs. Null and empty texts have the score of a text without
    words. Repeated rows stay; no rows give no rows. There is no shuffle."""
    scored = docs.select(key, scorer(docs.sparkSession, model)(F.col(text)).alias("score"))
    return scored.select(key, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose texts score below 0.5."""
    return docs.filter(scorer(docs.sparkSession, model)(F.col(text)) < 0.5)

"""Personal data, lexical search and collocations against plain versions and edge cases."""

import collections
import hashlib
import math
import random
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import lexical_search, phrases, pii, queries

from ..conftest import SF

# ---- personal data --------------------------------------------------------------------------------------------------


def passes_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        twice = int(c) * (1 + i % 2)
        total += twice - 9 if twice > 9 else twice
    return total % 10 == 0


def plain_base(text):
    """Base spans as described, by Python's re."""
    text, out = text or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and passes_luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def base_of(row):
    return [(s.kind, s.start, s.end) for s in row.base]


ODD_TEXTS = [
    None,
    "",
    "漢字 😀 a@b.c%x@d.e and x@y.z. é@b.co 1@2.3@4.5",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 999.1.2.3.4 1.2.3 00000000000000000000300.1.1.1",
    "+12 +123456789 +1 ( ) +1 (743) 555-3824) +49.30-123 456 789 +1234567890123456 ++123 456 789 0",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111 4111111111111111 4111111111111111",
    "0000000000000 0 0 00000000000000000000",
]


def test_base_spans(spark):
    rng = random.Random(5)
    texts = ODD_TEXTS + ["".join(rng.choice("aB9140.@+-() %é😀\n") for _ in range(rng.randrange(80))) for _ in range(400)]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.scan(rows).collect():
        assert base_of(r) == plain_base(texts[r.k]), texts[r.k]


def test_base_spans_of_long_texts(spark):
    parts = ("x", "9", "1 ", "1.", "é a@b.cd 10.0.0.1 ", "+1 (743) 555-3824", "a@b.c%", "4111111111111111,")
    texts = [part * (8_000 // len(part)) for part in parts] + ["a@" + "b." * 4_000, "+1" + " " * 8_000]
    for r in pii.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        assert base_of(r) == plain_base(texts[r.k])
    texts = [part * (400_000 // len(part)) for part in parts[:5]] + ["a@" + "b." * 200_000]
    started = time.monotonic()
    found = {r.k: base_of(r) for r in pii.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [len(found[i]) for i in (0, 1, 2, 4, 5)] == [0, 0, 0, 2 * (400_000 // 18), 1] and time.monotonic() - started < 60


def test_running_results(spark):
    rng = random.Random(1)
    arrays = [[], [3], [rng.randrange(9) for _ in range(64)], [rng.randrange(9) for _ in range(65)], [rng.randrange(10**9) for _ in range(10_000)]]
    rows = spark.createDataFrame([(a,) for a in arrays], "a array<bigint>")
    got = pii._running(pii._running(rows, {"sum": "a"}, pii._add, 0), {"most": "a"}, pii._larger, -1).collect()
    for r in got:
        assert r["sum"] == np.cumsum(np.array(r.a, np.int64)).tolist() and r.most == np.maximum.accumulate(np.array(r.a, np.int64)).tolist()


def planted(n, seed=3):
    """Documents with personal data in plain forms, and some in other forms, that a model can learn and find."""
    rng = random.Random(seed)

    def card(ok=True):
        digits = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        last = next(d for d in "0123456789" if passes_luhn(digits + d) == ok)
        return digits + last

    words = "river stone at the market in green light on monday with friends dot and paint".split()
    prose = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(5, 20)))
    mail = lambda: f"{rng.choice(words)}.{rng.randrange(100)}@mail{rng.randrange(9)}.example.com"
    phone = lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
    net = lambda: ".".join(str(rng.randrange(256)) for _ in range(4))
    out, hidden = [], {}
    for i in range(n):
        parts = [prose()]
        for made in (mail, phone, net, card, lambda: card(False)):
            if rng.random() < 0.5:
                parts += [made(), prose()]
        if i % 20 == 0:
            two = f"{card()} {card()}"
            local, host = mail().split("@")
            other = f"{local} (at) {host}"
            parts += [two, prose(), other, prose()]
            hidden[i] = [*two.split(" "), other]
        out.append((i, " ".join(parts)))
    return out, hidden


def test_boosted_spans_are_found(spark):
    rows, hidden = planted(400)
    clean = [(1000 + i, f"Report {i} of 2024-05-{i % 28 + 1:02d}, page {i}: 12,345.67 units at home.Then version {i}.2 of {100000 + i}") for i in range(100)]
    docs = spark.createDataFrame(rows + clean, "doc_id long, text string").repartition(3)
    found = {r.k: r for r in pii.find(docs).collect()}
    texts = dict(rows + clean)
    assert len(found) == len(texts) and all(base_of(r) == plain_base(texts[k]) for k, r in found.items())
    assert not any(found[k].added for k, _ in clean)
    hits = total = wrong = 0
    for k, text in rows:
        added = [text[s.start : s.end] for s in found[k].added]
        total += len(hidden.get(k, ()))
        hits += sum(x in added for x in hidden.get(k, ()))
        wrong += sum(x not in hidden.get(k, ()) for x in added)
    assert hits >= 0.9 * total and wrong <= 0.05 * total


def test_boosted_trees_split_best(spark):
    """The first split of a tree against all splits by brute force."""
    rng = random.Random(2)
    data = [([rng.randrange(4), rng.randrange(3), rng.randrange(6)], rng.choice((0, 1))) for _ in range(300)]
    data = [(f, int(f[2] >= 3) if rng.random() < 0.8 else y) for f, y in data]
    rows = spark.createDataFrame([(f, y - 0.5, 0.25) for f, y in data], "f array<int>, g double, h double")
    tree = pii._grow(rows)

    def gain(feature, at):
        total = 0.0
        for side in (True, False):
            some = [y - 0.5 for f, y in data if (f[feature] <= at) == side]
            total += sum(some) ** 2 / (0.25 * len(some) + pii.LAMBDA)
        return total

    best = max(((gain(f, at), f, at) for f, most in enumerate((3, 2, 5)) for at in range(most)), key=lambda x: x[0])
    assert (tree.feature, tree.at) == best[1:]
    value = spark.createDataFrame([([0, 0, 5],), ([0, 0, 0],)], "f array<int>").select(pii._value(tree, F.col("f")).alias("v")).collect()
    assert value[0].v > 0 > value[1].v


def test_redaction(spark):
    rows, _ = planted(100)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in [*rows, (-1, None), (-2, ""), (-3, "é +1 (743) 555-3824, 4111111111111111")]], "doc_id long, text string, t string, base string")
    clean = {r.doc_id: r.text for r in pii.redact(docs, pii.Model()).collect()}
    assert clean[-1] == clean[-2] == "" and clean[-3] == "é [...], [...]"
    for k, t in rows:
        spans, out, at = sorted((s, e) for _, s, e in plain_base(t)), "", 0
        for start, end in spans:
            if start > at or not out and start >= at:
                out += t[at:start] + "[...]"
            at = max(at, end)
        assert clean[k] == out + t[at:]


def test_personal_data_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find(empty).count() == 0
    rows = spark.createDataFrame([(None, "a@b.cd", "c"), (1, None, "d"), (1, None, "d"), (2, "no data", "e")], "doc_id long, text string, cands string")
    got = sorted(((r.k, base_of(r), list(r.added)) for r in pii.find(rows).collect()), key=str)
    assert got == [(1, [], []), (1, [], []), (2, [], []), (None, [("email", 0, 6)], [])]


def test_personal_data_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op11_boosted_spans"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        base = plain_base(texts[r.doc_id])
        listed = [f"{k}:{s}:{e}" for k, s, e in base]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k in ("email", "ip", "card", "phone")]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest() and r.spans.split(",")[: len(listed)] == (listed or [""])[: len(listed)]
    frame = queries.QUERIES["op11_boosted_spans"](spark, SF)
    assert not re.search("Python|Pandas|Arrow", frame._jdf.queryExecution().executedPlan().toString())


# ---- lexical search -------------------------------------------------------------------------------------------------


def plain_terms(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain_search(docs, items, k):
    terms = [(key, collections.Counter(plain_terms(t))) for key, t in docs]
    terms = [(key, c) for key, c in terms if c]
    n, length = len(terms), sum(sum(c.values()) for _, c in terms)
    out = []
    for item, text in items:
        scores = []
        for key, c in terms:
            m = 25 + (75 * sum(c.values()) * n) // length
            score = 0
            for t in plain_terms(text):
                df = sum(t in x for _, x in terms)
                if t in c:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, key))
        out += [(item, i, key, -score) for i, (score, key) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def random_texts(rng, n, words):
    return [None if rng.random() < 0.03 else " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


@pytest.mark.parametrize(("block", "most"), [(1 << 14, 500_000), (37, 3)])
def test_search_equals_brute_force(spark, monkeypatch, block, most):
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    monkeypatch.setattr(lexical_search, "MOST_TERMS", most)
    rng = random.Random(11)
    words = ["the", "The", "ÉTÉ", "été", "x-y", "a_b", "42", "mañana", "漢字", *(f"w{i}" for i in range(30))]
    texts = random_texts(rng, 300, words)
    texts[10:40] = [texts[5] or "the"] * 30  # equal scores
    docs = list(enumerate(texts))
    items = [(i, t) for i, t in enumerate(random_texts(rng, 12, words))] + [(50, "the the the w1 w1"), (51, None), (52, "unknown"), (53, "...")]
    d = spark.createDataFrame([(k, t, 0, 0) for k, t in docs], "doc_id long, text string, n long, score long").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in lexical_search.search(d, i, 10).select("item_id", "rank", "doc_id", "score").collect())
    assert got == plain_search(docs, items, 10)


def test_search_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, "c"), (3, "d"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a"), (7, "a"), (None, "a")], "item_id long, text string")
    got = [(r.item_id, r["rank"], r.doc_id) for r in lexical_search.search(docs, items, 2).collect()]
    assert sorted(got, key=str) == sorted([(x, n, k) for x in (7, 7, None) for n, k in ((1, None), (2, 1))], key=str)
    assert lexical_search.search(docs.limit(0), items).count() == lexical_search.search(docs, items.limit(0)).count() == 0


def test_slices_add_up():
    rng = np.random.default_rng(4)
    total, expected = np.zeros((45, 3), np.uint64), np.zeros(192, np.int64)
    for times in (1, 3, 6, 1, 2):
        at = np.sort(rng.choice(192, 50, replace=False))
        values = rng.integers(0, 1 << 35, 50)
        part = lexical_search.slices(values, at, 3)
        for shift in range(times.bit_length()):
            if times >> shift & 1:
                lexical_search.add(total, part, shift)
        expected[at] += times * values
    expected[::7] = 0
    some = lexical_search.slices(expected, np.arange(192), 3)
    for k in (1, 10, 100, 192, 500):
        order = [int(i) for i in np.argsort(-expected, kind="stable") if expected[i] > 0][:k]
        assert sorted(lexical_search.top(some, k)) == sorted((i, int(expected[i])) for i in order)
    back = lexical_search.top(total, 192)
    assert len(back) > 100 and all(v > 0 for _, v in back)


def test_impacts_beyond_64_bits():
    counts, lengths, weights = np.array([3]), np.array([10**9]), np.array([7])
    documents, length = 10**11, 10**14
    exact = 7 * ((10**9 * 3) // (3000 + 8 * (25 + (75 * 10**9 * documents) // length)))
    assert lexical_search.impacts(counts, lengths, weights, documents, length).tolist() == [exact]


# ---- collocations ---------------------------------------------------------------------------------------------------


def plain_collocations(docs, least, most):
    counts, words = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in docs:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            words[lang or "und"] += len(ws)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    counts[lang or "und"][tuple(ws[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        f = {p: n for p, n in f.items() if n >= least}
        rows = []
        for p, a in f.items():
            if len(p) < 2:
                continue
            score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))  # noqa: E741
            longer = [n for q, n in f.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * n >= 80 * a for n in longer):
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, words[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:most], 1)]  # noqa: E741
    return sorted(out)


def collocation_docs():
    rng = random.Random(9)
    words = ["new", "New", "york", "city", "hall", "of", "the", "é", "漢", "a\x1cb", "\x00"]
    docs = []
    for i in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", " ", ", ", ".\n", "\x0b"]) for _ in range(rng.randrange(30)))
        if i % 3 == 0:
            text += "new york city hall. new york city " * 2
        docs.append((rng.choice(["en", "fr", None, "und"]), text if i % 50 else None))
    return docs


@pytest.mark.parametrize(("flush", "bits"), [(1 << 21, 1 << 27), (100, 64)])
def test_collocations_equal_brute_force(spark, monkeypatch, flush, bits):
    """Also where tasks send often and the bitmap is full of collisions."""
    monkeypatch.setattr(phrases, "FLUSH", flush)
    monkeypatch.setattr(phrases, "BITS", bits)
    docs = collocation_docs()
    rows = spark.createDataFrame([(t, lang, 1, "x") for lang, t in docs], "text string, lang string, f long, phrase string").repartition(3)
    got = sorted(tuple(r) for r in phrases.collocations(rows, most=50).collect())
    assert got == plain_collocations(docs, phrases.LEAST, 50) and len(got) > 10


def test_level_emits_by_both_parts(spark):
    """A bitmap without a pair's second word lets no pair through."""
    docs = spark.createDataFrame([("en", "b a " * 40)], "lang string, text string")
    words = phrases.level(docs, 1).filter("phrase <> cast('' as binary)")
    assert phrases.level(docs, 2, phrases.bitmap_of(words)).count() == 2
    some = phrases.bitmap_of(words.filter("phrase = cast('a' as binary)"))
    assert int(np.bitwise_count(some).sum()) == 1 and phrases.level(docs, 2, some).count() == 0


def test_collocations_of_odd_tables(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("en", ""), ("en", "one two " * 3)], "lang string, text string")).count() == 0
    row = phrases.collocations(spark.createDataFrame([(None, "x " * 31)], "lang string, text string")).first()
    assert tuple(row) == ("und", 1, "x x", 30, 31, 31, 31, 967741)


# ---- queries with SQL -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op12_bit_sliced_search", "op13_apriori_phrases"])
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    expected = duck.execute(queries.ORACLES[name]).fetchdf()
    got = queries.QUERIES[name](spark, SF).toPandas()
    columns = sorted(expected.columns)
    assert sorted(got.columns) == columns and sorted(map(tuple, got[columns].to_numpy().tolist())) == sorted(map(tuple, expected[columns].to_numpy().tolist()))

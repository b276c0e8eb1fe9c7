"""Language ID, toxicity, packing, joins, vectors and the pipeline."""

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from weftline.llm import ann, language_id, line_dedup, ngram_join, packing, queries, secrets, toxicity
from weftline.llm.components import components

from ..conftest import SF

SF2 = "/root/testdata/sf0.01"


# ---- language -------------------------------------------------------------------------------------------------------


def test_viterbi_equals_the_best_of_all_paths():
    rng = np.random.default_rng(1)
    lengths = np.array([4, 0, 1, 6])
    scores = rng.normal(size=(lengths.sum(), 3)) * 5
    got = language_id.viterbi(scores, lengths, 4.0)
    start = 0
    for n in lengths:
        own = scores[start : start + n]
        best = max(np.ndindex(*[3] * n), key=lambda p: sum(own[i, s] for i, s in enumerate(p)) - 4 * sum(a != b for a, b in zip(p, p[1:])))
        assert tuple(got[start : start + n]) == best
        start += n


def test_spans_scripts_and_unknown():
    model = language_id.fit([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("кот и собака", "ru")] * 5)
    labeller = language_id.Labeller(model, switch=3.0)
    langs, scores = language_id.summarize(labeller, [None, "", "12 !?", "собака", "the dog and the cat", "der hund 漢字"])
    assert langs[:3] == ["und"] * 3 and langs[3] == "ru" and langs[4] == "en" and langs[5] == "de" and all(0 <= s <= 1 for s in scores)
    found = language_id.spans(labeller, "the cat and the dog der hund und die katze")
    assert [s["lang"] for s in found] == ["en", "de"] and found[0]["start"] == 0 and found[1]["start"] == 20


def test_language_accuracy_on_held_out_rows(spark):
    rows = queries.op3_viterbi_spans(spark, SF2).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF2}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_language_of_odd_tables(spark):
    rows = spark.createDataFrame([(None, None, None, 1), (1, "", None, 1), (1, "the", "en", 1)], "doc_id long, text string, lang string, k int")
    model = language_id.fit(language_id.training_rows(rows, F.lit(True)))
    assert sorted(r.lang_pred for r in language_id.identify(rows, model, with_spans=True).collect()) == ["en", "und", "und"]
    empty = language_id.fit(language_id.training_rows(rows.limit(0), F.lit(True)))
    assert [r.lang_pred for r in language_id.identify(rows, empty).collect()] == ["und"] * 3


# ---- toxicity -------------------------------------------------------------------------------------------------------


def test_toxicity_learns_and_generalizes():
    rng = random.Random(6)
    calm, bad = [f"w{i}" for i in range(400)], ["idiot", "scum", "moron"]

    def text(toxic):
        words = [rng.choice(calm) for _ in range(rng.randint(5, 60))]
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        return " ".join(words)

    model = toxicity.fit([(text(i % 6 == 0), int(i % 6 == 0)) for i in range(600)])
    held = [(text(y), y) for y in [0, 1] * 100]
    right = sum((s >= 0.5) == bool(y) for s, (_, y) in zip(toxicity.Scorer(model)([t for t, _ in held]), held))
    assert right >= 185


def test_toxicity_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = {r.doc_id: r for r in queries.op6_word_cnn(spark, sf).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for k, r in rows.items())
    held = [(rows[k].predicted, y) for k, y in label.items() if k in rows and rows[k].held_out and y is not None]
    assert sum(p for p, y in held if y) >= 0.88 * sum(y for _, y in held)
    assert sum(p for p, y in held if not y) <= 0.02 * len(held)


def test_languages_have_words_of_their_own():
    rows = [("the cat", 0, "en"), ("the dog", 1, "en"), ("der hund", 0, "de"), ("der tag", 0, "de"), ("x", 0, None)]
    own = toxicity.own_words(rows)
    assert own["the"] == "en" and own["der"] == "de" and "x" not in own and toxicity.own_words(rows[:2]) == {}


def test_long_texts_are_pooled_whole(monkeypatch):
    model = toxicity.fit([("bad " * 3, 1), ("good " * 3, 0)] * 20)
    texts = ["good " * 50_000 + "bad", "good", None, "", "bad", "good " * 3000]
    whole = toxicity.Scorer(model)(texts)
    monkeypatch.setattr(toxicity, "AT_ONCE", 7)
    monkeypatch.setattr(toxicity.Scorer, "CACHED", 1)
    assert np.allclose(whole, toxicity.Scorer(model)(texts), atol=1e-5) and whole[0] >= 0.5 > whole[1]
    assert np.allclose(whole, [toxicity.Scorer(model)([t])[0] for t in texts], atol=1e-5)


def test_toxicity_of_odd_tables(spark):
    rows = spark.createDataFrame([(None, None, "s"), (1, "", "s"), (1, "a", "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.training_rows(rows, labels, F.lit(True)))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in toxicity.score(rows, model).collect())
    assert toxicity.score(rows.limit(0), toxicity.fit([])).count() == 0


# ---- packing --------------------------------------------------------------------------------------------------------

with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
    JSON = file.read()


def check_packed(rows, texts):
    """rows: of pack_documents(); texts: by doc_id."""
    peer = Tokenizer.from_str(JSON)
    peer.encode_special_tokens = True
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc_id, own in by_doc.items():
        ids = [*peer.encode(texts[doc_id] or "", add_special_tokens=False).ids, 0]
        at = 0
        for i, r in enumerate(sorted(own, key=lambda r: r.piece)):
            part = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert (r.piece, r.start, r.ids_crc32) == (i, at, zlib.crc32(part)) and (i == 0 or r.length == 2048)
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    return len(by_sequence)


def test_packing_is_whole_and_tight(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.op5_pattern_packing(spark, SF).collect()
    used = check_packed(rows, {r.doc_id: r.text for r in docs.collect()})
    assert used <= 1.03 * sum(r.length for r in rows) / 2048 + 1


def test_packing_odd_rows(spark):
    texts = {0: None, 1: "", 2: " \n  x", 3: "word " * 5000, 4: "a", 5: "  <|endoftext|> ", 6: "é" * 3000}
    rows = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id long, text string, length string")
    peer = packing.pack_documents(rows, JSON).collect()
    check_packed(peer, texts)
    assert packing.pack_documents(rows.limit(0), JSON).count() == 0


def test_plan_covers_the_histogram():
    rng = random.Random(7)
    for n in (0, 1, 3, 500, 50_000):
        histogram = collections.Counter(min(2048, 1 + int(rng.expovariate(1 / 500))) for _ in range(n))
        groups = packing.plan(histogram)
        held = collections.Counter()
        for pattern, count in groups:
            assert sum(pattern) <= 2048 and count > 0
            for length in pattern:
                held[length] += count
        assert held == histogram
        if n >= 500:
            assert sum(c for _, c in groups) <= 1.01 * sum(k * v for k, v in histogram.items()) / 2048 + 1


def test_patterns_place_most_pieces():
    rng = random.Random(17)
    for scale in (1, 50):
        histogram = collections.Counter(min(2047, 1 + int(rng.gammavariate(2, 450))) for _ in range(8000))
        histogram = {n: c * scale for n, c in histogram.items()}
        groups, left = packing.pattern_groups(histogram)
        placed = sum(len(pattern) * count for pattern, count in groups)
        assert placed + sum(left.values()) == sum(histogram.values()) and placed >= 0.8 * sum(histogram.values())
        least = -(-sum(n * c for n, c in histogram.items()) // 2048)
        assert sum(count for _, count in packing.plan(histogram)) <= 1.004 * least + 1


def test_packing_keeps_columns_of_any_name(spark):
    rows = [(1, 5, 2048, 0), (2, 6, 7, 1), (3, 7, 9, 1), (4, 8, 9, 1)]
    got = packing.pack(spark.createDataFrame(rows, "l long, grp long, length long, first long"), "grp").collect()
    assert sorted(tuple(r)[:4] for r in got) == rows and {(r.sequence_id, r.offset) for r in got} == {(0, 0), (1, 0), (1, 9), (1, 18)}


def test_nnls_equals_least_squares_where_that_is_positive():
    rng = np.random.default_rng(8)
    a, x = rng.random((20, 6)), rng.random(6)
    assert np.allclose(packing.nnls(a, a @ x), x)
    b = rng.normal(size=20)
    got = packing.nnls(a, b)
    gradient = a.T @ (b - a @ got)
    assert (got >= 0).all() and (gradient < 1e-6).all() and abs(gradient @ got) < 1e-6


# ---- near duplicates ------------------------------------------------------------------------------------------------


def plain_components(rows):
    sets = {}
    for k, t in rows:
        words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))
        sets[k] = frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()
    parent = {k: k for k in sets}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for x in sets:
        for y in sets:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
                    a, b = sorted((find(x), find(y)))
                    parent[b] = a
    return {k: (len(sets[k]), find(k)) for k in sets}


def planted(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(0, None), (1, ""), (2, " \t"), (3, "a b"), (4, "A  b"), (5, "a c")]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 30, 60, 200]))]
        for _ in range(rng.randint(1, 14)):
            words = list(base)
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words += [rng.choice(vocabulary) for _ in range(rng.randint(0, 12))]
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_all_pairs(spark, seed):
    rows = planted(seed)
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, node string")
    expected = plain_components(rows)
    got = {r.doc_id: (r.n, r.component) for r in ngram_join.similar(docs).collect()}
    assert got == expected
    if seed == 1:
        assert sorted(r.doc_id for r in ngram_join.keep_one(docs).collect()) == sorted(k for k in expected if expected[k][1] == k)


def test_join_query_on_real_rows(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op2_adaptive_prefix_join(spark, SF).collect()}
    assert got == plain_components(rows)


def test_join_of_odd_tables(spark):
    text = "one two three four five six seven"
    rows = spark.createDataFrame([(None, text), (4, text), (4, text), (4, None), (9, "")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n, r.component or -1) for r in ngram_join.similar(rows).collect())
    assert got == [(-1, 3, 4), (4, 0, 4), (4, 3, 4), (4, 3, 4), (9, 0, 9)]
    assert sorted((r.doc_id or -1, r.text or "") for r in ngram_join.keep_one(rows).collect()) == [(4, ""), (4, text), (9, "")]
    assert ngram_join.similar(rows.limit(0)).count() == 0


def test_prefixes_keep_the_promise():
    rng = np.random.default_rng(9)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.93], rng.integers(0, 2**63, int(rng.integers(0, 4))).astype(np.uint64)]))
        counts = {t: int(c) for t, c in zip(x.tolist(), rng.integers(2, 500, len(x)))}  # of the shingles that others have
        if ngram_join.links(x, y):
            heads = []
            for s in (x, y):
                own = sorted((counts[t], t) for t in s.tolist() if t in counts)
                assert len(own) >= ngram_join.least_overlap(len(s))
                m, length = ngram_join.matches(len(s), np.array([c for c, _ in own]))
                heads.append(({t for _, t in own[:length]}, m, len(s) - len(own), own))
            (px, mx, ux, ox), (py, my, uy, oy) = heads
            assert len(px & py) >= min(mx, my)
            room = len(x) + len(y) - 2 * -(-80 * (len(x) + len(y)) // 180)
            parities = [ngram_join.parity(np.array([t for _, t in o], np.uint64)) for o in (ox, oy)]
            apart = ux + uy + sum(((int(a) ^ int(b)) % (1 << 64)).bit_count() for a, b in zip(*parities))
            assert apart <= len(x) + len(y) - 2 * len(np.intersect1d(x, y)) <= room


def test_sets_with_frequent_shingles_ask_for_several_matches():
    assert ngram_join.matches(100, np.full(90, 50))[0] > 1


def test_hot_shingles_go_around_the_buckets(spark, monkeypatch):
    rows = planted(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = plain_components(rows)
    for hot, flush in ((2, 1 << 21), (1024, 300)):
        monkeypatch.setattr(ngram_join, "HOT", hot)
        monkeypatch.setattr(ngram_join, "FLUSH", flush)
        assert {r.doc_id: (r.n, r.component) for r in ngram_join.similar(docs).collect()} == expected


def test_one_row_of_each_group_stays_whatever_the_columns(spark):
    text = "one two three four five six seven"
    rows = [(1, text, "KEEPME", 1, "a"), (2, text, "GO", 2, "b"), (3, "other", "x", 3, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, h1 int, row string")
    assert sorted(tuple(r) for r in ngram_join.keep_one(docs).collect()) == [rows[0], rows[2]]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


# ---- vectors --------------------------------------------------------------------------------------------------------


def test_recall_and_ties(spark):
    table = [(r.vec_id, np.array(r.embedding, "float64")) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = collections.defaultdict(dict)
    for r in queries.op10_one_bit_codes(spark, SF).collect():
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    hits = total = 0
    for q, v in table:
        if q % 20 == 0:
            exact = sorted(((-float((v * c).sum()), k) for k, c in table if k != q))[:20]
            found = [got[q][i + 1] for i in range(20)]
            assert found == sorted(found, key=lambda x: (-x[1], x[0]))
            assert all(s == pytest.approx(float((v * dict(table)[k]).sum())) for k, s in found)
            hits += len({k for _, k in exact} & {k for k, _ in found})
            total += 20
    assert hits >= 0.97 * total


def test_bounds_hold():
    rng = np.random.default_rng(10)
    for dim in (64, 50):
        vectors, queries_ = rng.normal(size=(400, dim)), rng.normal(size=(20, dim))
        turn = ann.rotation(dim)
        estimate, half = ann.bounds(queries_, *ann.encode(vectors, turn), turn)
        exact = queries_ @ vectors.T
        assert (np.abs(estimate - exact) <= half).mean() > 0.93 and abs((estimate - exact).mean()) < 0.1


def test_codes_leave_few_vectors_to_rerank(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asked = F.col("id") % 20 == 0
    rows, asking, codes = ann._parts(table, asked, "vec_id", "embedding")
    kept = ann.kept_candidates(rows, asking, codes, asked, 20, ann.EPSILON)
    pairs = sum(len(r.places) // 2 for r in kept.select("places").collect())
    vectors = {r.vec_id: np.array(r.embedding, "float64") for r in table.collect()}
    ids = np.array(sorted(vectors))
    matrix = np.array([vectors[i] for i in ids.tolist()])
    got = collections.defaultdict(set)
    for r in ann.nearest(table, asked).collect():
        got[r.query_id].add(r.vec_id)
    hits = total = 0
    for q in ids[ids % 20 == 0].tolist():
        score = np.where(ids == q, -np.inf, matrix @ vectors[q])
        hits += len(got[q] & set(ids[np.argsort(-score)[:20]].tolist()))
        total += 20
    assert pairs <= 0.2 * total / 20 * len(ids) and hits >= 0.99 * total


def test_blocks_in_parts_equal_sums_bit_by_bit(monkeypatch):
    rng, dim = np.random.default_rng(12), 50
    vectors, asked, turn = rng.normal(size=(300, dim)), rng.normal(size=(150, dim)), ann.rotation(dim)
    codes, size, fit = ann.encode(vectors, turn)
    turned = asked @ turn
    low = turned.min(axis=1, keepdims=True)
    unit = (turned.max(axis=1, keepdims=True) - low) / 63
    coordinates = low + unit * np.rint((turned - low) / unit)
    bits = np.unpackbits(codes, axis=1)
    plain = np.array([[np.where(b == 1, c, -c).sum() for b in bits] for c in coordinates]) * size / (fit * np.sqrt(turn.shape[1]))
    monkeypatch.setattr(ann, "_SIGNS", 7 * ann.code_bits(dim))
    left = pa.table({"id": np.arange(150), "v": list(asked)})
    right = pa.table({"id": np.arange(100, 400), "code": [c.tobytes() for c in codes], "size": size, "fit": fit})
    got, parts = np.full(plain.shape, np.nan), set()
    for places, start, estimate, half, others in ann._block(left, right, 2.0):
        got[places[0] : places[-1] + 1, start : start + estimate.shape[1]] = estimate
        assert (np.argwhere(~others) @ [1, -1] == 100 + start - places[0]).all() and half.shape == estimate.shape
        parts.add(start)
    assert np.allclose(got, plain, rtol=1e-11, atol=1e-11) and parts == set(range(0, 300, 7))


def test_codes_are_copied_once_for_thousands_of_queries(spark):
    table = spark.range(2000).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    rows, asking, codes = ann._parts(table, F.col("id") >= 0, "vec_id", "embedding")
    assert rows.count() == asking.count() == codes.count() == 2000


def test_repeated_rows_are_separate_candidates(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.4, 0.0]), (3, [0.1, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r)[1:] for r in ann.nearest(table, F.col("id") == 0, 4).orderBy("rank").collect()]
    assert got == [(1, 1, 1.0), (2, 1, 1.0), (3, 1, 0.5), (4, 2, 0.4)]


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 1.0], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (20, [1.0, 1.0], 1), (7, [1.0, 1.0], 1), (8, [], 1), (9, [-1.0, 0.0], 1), (9, [-1.0, 0.0], 1), (None, [1.0, 1.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = [tuple(r) for r in ann.nearest(table, F.col("id") % 20 == 0, 2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 7, 1.0), (20, 1, 1, 2.0), (20, 2, 7, 2.0)]
    assert ann.nearest(table.limit(0), F.col("id") % 20 == 0, 2).count() == 0


# ---- pipeline -------------------------------------------------------------------------------------------------------


def test_pipeline_stages_follow_their_operators(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        rows = out.collect()
        if name == "packing":
            check_packed(rows, {k: r.text for k, r in before.items()})
            break
        assert set(out.columns) == set(docs.columns) and len(rows) == len({r.doc_id for r in rows})
        after = {r.doc_id: r for r in rows}
        if name == "near_duplicates":
            expected = plain_components([(k, r.text) for k, r in before.items()])
            assert set(after) == {k for k in before if expected[k][1] == k}
        elif name == "toxicity":
            assert set(after) < set(before) and len(after) >= 0.75 * len(before)
        else:
            assert set(after) == set(before) and all(r.n_chars == len(r.text) for r in rows)
        if name == "secrets":
            scan = secrets.scanner()
            for k, r in after.items():
                assert (r.text == before[k].text) == (not scan(before[k].text)) and not [s for s in scan(r.text) if s[0] != "assign"]
        docs = out
    assert line_dedup.FANOUT > 1


def test_pipeline_runs_whole(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert check_packed(rows, {r.doc_id: r.text for r in docs.collect()}) > 0

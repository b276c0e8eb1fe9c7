"""HTML text, BPE, secrets, line dedup and fingerprints against plain versions and edge cases."""

import hashlib
import random
import re
import time
import unicodedata
from html.parser import HTMLParser

import public_tokenizers
import tiktoken
from pyspark.sql import Row

from weftline.llm import bpe, fingerprint, html_text, language_id, line_dedup, ngram_join, packing, queries, secrets

from ..conftest import SF

EXTRA = "doc_id long, text string, ids string, h1 string, blob string, kept string"


def docs(spark, *texts, extra=False):
    rows = [(i, t) for i, t in enumerate(texts)]
    if extra:
        return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], EXTRA)
    return spark.createDataFrame(rows, "doc_id long, text string")


ODD = (None, "", "  \n ", "a", "a", "Ünï 漢字 \x1c x", "token = abcdef123456 \n" * 3, "x" * 20_000)


# ---- HTML -----------------------------------------------------------------------------------------------------------


def test_html_keeps_the_article_only():
    page = """<html><head><title>T</title><script>var a="</p>";</script></head><body><header>Top</header><nav><a href=/>Home</a></nav>
    <div class="cookie-notice">We use cookies</div><article><h1>Head &amp; more</h1><p>One  two<br>three</p><aside>Side</aside>
    <p>Four</p><div class="comments"><p>Nice!</p></div></article><form><input value=x>Send</form><footer>End</footer></body>"""
    assert html_text.main_text(page) == "Head & more\nOne two three\nFour"


def test_html_without_a_mark_takes_dense_runs():
    body = "".join(f"<p>{'Long sentence number %d of the text. ' % i * 3}</p>" for i in range(6))
    page = f"<div><a href=a>One</a> <a href=b>Two</a></div><ul class=menu><li>x</li></ul>{body}<div id='footer'>(c)</div>"
    text = html_text.main_text(page)
    assert text.count("\n") == 5 and text.startswith("Long sentence number 0") and "(c)" not in text


def test_html_marks_are_weight_only():
    body = [f"{'Long sentence number %d of the text. ' % i * 4}".strip() for i in range(6)]
    real = "".join(f"<p>{x}</p>" for x in body)
    teaser = "<article><h3>Other story</h3><p>Read what else is new.</p></article>"
    assert html_text.main_text(f"<body><div>{real}</div><div>{teaser * 3}</div></body>") == "\n".join(body)
    assert html_text.main_text(f"<body>{teaser}<div>{real}</div></body>").endswith("\n".join(body))
    comments = f"<section class=comments><article class=comment><p>{body[0]}</p></article><article><p>{body[1]}</p></article></section>"
    assert html_text.main_text(f"<body><div>{real}</div>{comments}</body>") == "\n".join(body)
    assert html_text.main_text(f"<body><article>{real}</article>{comments}</body>") == "\n".join(body)
    named = f"<article class='post has-sidebar'><h2 id='related-work'>Related work</h2><div id='related-work-text'>{real}</div><p>Last.</p></article>"
    assert html_text.main_text(named) == "Related work\n" + "\n".join(body) + "\nLast."
    assert html_text.main_text(f"<div id=page><div class=ad>buy<article>{real}</article></div>") == "\n".join(body)


def test_html_odd_pages(spark):
    assert html_text.main_text(None) == "" == html_text.main_text("")
    assert html_text.main_text("<div class=ad>buy<article><p>a &lt;b&gt;") == "a <b>"
    pages = spark.createDataFrame([(1, "u", None, "t"), (1, "u", None, "t"), (2, None, "<p>x &am", "t")], "page_id long, url string, html string, text string")
    rows = sorted(html_text.extract(pages).collect())
    assert rows == [Row(1, "u", "", 0), Row(1, "u", "", 0), Row(2, None, "x &am", 5)]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_html_of_broken_tags_takes_linear_time():
    started = time.monotonic()
    for part in ("<a x='b\" ", "<div ", "<div><span></p>", "<nav><article>x</article>", "<!", "<b>x</b>&amp "):
        html_text.main_text(part * (500_000 // len(part)))
    assert html_text.main_text("<a x='b\" " * 200_000) is not None and time.monotonic() - started < 15
    assert html_text.main_text("<p>One <a title='it\">two</a></p><p>three</p>") == "One two\nthree"


def plain_text(html):
    """The articles of the tables' pages by the standard library's parser: text of the one article without parts that
    are outside by tag."""

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.skip, self.lines, self.parts = 0, 0, [], []

        def flush(self):
            line = " ".join("".join(self.parts).split())
            if line and self.inside and not self.skip:
                self.lines.append(line)
            self.parts = []

        def handle_starttag(self, tag, attrs):
            if tag in html_text.BLOCKS or tag == "br":
                self.parts.append(" ") if tag == "br" else self.flush()
            self.inside += tag == "article"
            self.skip += tag in ("script", "style", "aside", "form", "nav", "footer")

        def handle_endtag(self, tag):
            if tag in html_text.BLOCKS:
                self.flush()
            self.inside -= tag == "article"
            self.skip -= tag in ("script", "style", "aside", "form", "nav", "footer")

        def handle_data(self, data):
            if not self.skip:
                self.parts.append(data)

    reader = Reader()
    reader.feed(html or "")
    reader.close()
    return "\n".join(reader.lines)


def test_html_query_on_the_page_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op1_line_blocks(spark, SF).collect()
    assert len(rows) == len(pages) and all(r.url == pages[r.page_id].url and r.n_chars == len(r.text) for r in rows)
    assert sum(r.text == plain_text(pages[r.page_id].html) for r in rows) >= 0.9 * len(rows)


# ---- BPE ------------------------------------------------------------------------------------------------------------

RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
PEER = tiktoken.Encoding("peer", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_bpe_equals_tiktoken_and_round_trips():
    own = bpe.BytePairEncoder(RANKS, public_tokenizers.PATTERN, spaces=True)
    rng = random.Random(1)
    letters = "ab e\n\t\r    \x1c\x1f\x85​é漢字🙂'sll123.,!-’Ωя́"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    texts += ["".join(rng.choice("abcdet") for _ in range(30_000)), "a" * 5_000, " " * 3_000]
    for text, packed in zip(texts, own.encode_packed(texts)):
        ids = [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]
        assert ids == PEER.encode_ordinary(text), repr(text[:50])
        assert own.decode(ids) == text.encode()


def test_bpe_cache_limits_change_nothing():
    small = bpe.BytePairEncoder(RANKS, public_tokenizers.PATTERN, spaces=True)
    small.CACHED, small.LONGEST_CACHED, small.TOGETHER = 3, 4, 8
    texts = ["the cat sat on the mat, the end", "another  text\n \nhere", "", "x"]
    for _ in range(3):
        assert [small.encode(t) for t in texts] == [PEER.encode_ordinary(t) for t in texts]


def test_rank_bitmap_pops_in_order():
    bitmap, rng = bpe.RankBitmap(), random.Random(2)
    ranks = rng.sample(range(1 << 18), 500)
    for r in ranks:
        bitmap.add(r)
    assert [bitmap.pop() for _ in ranks] == sorted(ranks) and bitmap.pop() == bpe.NONE


def test_keys_stay_what_they_are(spark):
    big = 2**53 + 1
    rows = [(None, "one two three four five six"), (big, "one two three four five six"), (big + 1, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    keys = {None, big, big + 1}
    assert {r.doc_id for r in html_text.extract(table, "doc_id", "text", ()).collect()} == keys
    assert {r.doc_id for r in bpe.token_digests(table, RANKS, public_tokenizers.PATTERN).collect()} == keys
    assert {r.doc_id for r in language_id.identify(table, language_id.fit([("one two", "en")])).collect()} == keys
    assert {r.doc_id for r in ngram_join.similar(table).collect()} == keys
    assert {r.component for r in ngram_join.similar(table).collect()} == {big, big + 1}
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        assert {r.doc_id for r in packing.pack_documents(table, file.read()).collect()} == keys


def test_letters_only_are_words():
    assert language_id.words_of("½ ² Ⅷ _ 12 हिन्दी été") == ["हिन्दी", "été"]


def test_bpe_of_other_patterns_goes_through_the_pattern():
    pattern = r"\w+ \w+|."
    own = bpe.BytePairEncoder(RANKS, pattern)
    peer = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=RANKS, special_tokens={})
    for text in ("the cat sat on the mat", " a b", ""):
        assert own.encode(text) == peer.encode_ordinary(text)


def test_bpe_rows(spark):
    rows = bpe.encode_documents(docs(spark, *ODD, extra=True), RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert r.ids == PEER.encode_ordinary(ODD[r.doc_id] or "") and bytes(r.decoded) == (ODD[r.doc_id] or "").encode()


# ---- secrets --------------------------------------------------------------------------------------------------------


def plain_spans(text):
    found = []
    for place, (kind, pattern, group, least) in enumerate(secrets.RULES):
        flags = re.A | (re.I if kind == "assign" else 0)
        found += [(m.start(), place, kind, m.end()) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    return [(k, s, e) for s, _, k, e in sorted(found)]


SECRETS = (
    'API_KEY: "abcdef" PassWord=short token= zzzzzz',
    "AKIA" + "A1" * 8 + " AKIAX 0123456789abcdef01234567 é deadbeef",
    "-----BEGIN RSA PRIVATE KEY-----",
    "x" * 5000 + " secret:abc/def+1==",
)


def test_scanner_equals_plain_patterns():
    scan, rng = secrets.scanner(), random.Random(3)
    parts = ["token", "PASSWD", "=", ": ", "'", '"', "abc", "0f" * 13, "AKIA", "XYZ123" * 3, " ", "\n", "ſecret=abcdefg"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert scan(text) == plain_spans(text), text


def test_ledger_scans_each_blob_once(spark, tmp_path):
    path = str(tmp_path / "ledger")
    first = docs(spark, *ODD, *SECRETS, SECRETS[0], extra=True)
    rows = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.scan_secrets(first, path).collect()}
    assert rows == {i: plain_spans(t or "") for i, t in enumerate((*ODD, *SECRETS, SECRETS[0]))}
    assert spark.read.parquet(path).count() == len({t or "" for t in (*ODD, *SECRETS)})
    assert secrets.scan_unseen(first, secrets.open_ledger(spark, path)).count() == 0
    later = docs(spark, "token=abcdefgh", SECRETS[0])
    assert secrets.scan_unseen(later, secrets.open_ledger(spark, path)).count() == 1
    assert secrets.scan_unseen(later, secrets.open_ledger(spark, path), secrets.RULES[:1]).count() == 2
    assert secrets.scan_secrets(later.limit(0), path).count() == 0


def test_repeated_and_null_keys(spark, tmp_path):
    rows = spark.createDataFrame([(None, SECRETS[0]), (None, SECRETS[1]), (1, SECRETS[0]), (1, SECRETS[0]), (1, "")], "doc_id long, text string")
    got = secrets.scan_secrets(rows, str(tmp_path / "l")).collect()
    assert sorted(len(r.spans) for r in got) == sorted(len(plain_spans(t)) for t in (SECRETS[0], SECRETS[1], SECRETS[0], SECRETS[0], ""))


def test_redaction(spark, tmp_path):
    rows = docs(spark, "a token=abcdefgh b", None, "clean")
    got = {r.doc_id: r.text for r in secrets.redact(rows, str(tmp_path / "l")).collect()}
    assert got == {0: "a [secret] b", 1: None, 2: "clean"}


def test_redaction_keeps_columns_of_any_name(spark, tmp_path):
    rows = spark.createDataFrame([(1, "token=abcdefgh", "a", "b", "c")], "doc_id long, text string, _blob string, starts string, blob string")
    assert [tuple(r) for r in secrets.redact(rows, str(tmp_path / "l")).collect()] == [(1, "[secret]", "a", "b", "c")]
    assert secrets.redact(rows.limit(0), str(tmp_path / "m")).count() == 0


def test_a_blob_that_is_twice_in_the_ledger_counts_once(spark, tmp_path):
    path = str(tmp_path / "ledger")
    table = docs(spark, SECRETS[0])
    for _ in range(2):
        secrets.scan_unseen(table, spark.createDataFrame([], secrets.LEDGER)).write.mode("append").parquet(path)
    assert secrets.scan_secrets(table, path).count() == 1


def test_secret_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op7_secret_ledger(spark, SF).collect():
        spans = [f"{k}:{s}:{e}" for k, s, e in plain_spans(texts.pop(r.doc_id))]
        base = [s for s in spans if s.split(":")[0] in secrets.BASE_KINDS]
        assert r.spans == ",".join(spans) and r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in base) for k in secrets.BASE_KINDS)
    assert not texts


# ---- lines ----------------------------------------------------------------------------------------------------------


def plain_lines(texts, least):
    def key(line):
        line = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line)

    split = [(t or "").split("\n") for t in texts]
    frequency = {}
    for lines in split:
        for k in {key(x) for x in lines}:
            frequency[k] = frequency.get(k, 0) + 1
    kept = [[x for x in lines if not key(x) or frequency[key(x)] < least] for lines in split]
    return [("\n".join(k), len(s), len(s) - len(k)) for k, s in zip(kept, split)]


def test_frequent_lines_go(spark):
    rng = random.Random(4)
    pool = [" Common\t", "common", "COMMON ", "É", "é", "", "  ", "rare %d"]
    texts = [*ODD, *("\n".join(rng.choice(pool).replace("%d", str(rng.randint(0, 40))) for _ in range(rng.randint(1, 9))) for _ in range(60))]
    for least, batches in ((3, 1), (5, 7)):
        got = line_dedup.drop_frequent_lines(docs(spark, *texts, extra=True), least, batches).collect()
        # The two rows "a" of ODD have different keys, so both count.
        assert [tuple(r)[1:] for r in sorted(got)] == plain_lines(texts, least)
    assert line_dedup.drop_frequent_lines(docs(spark, *texts).limit(0)).count() == 0


def test_full_levels_are_compacted_before_frequent_keys_are_read(spark, monkeypatch):
    read = []
    plain = line_dedup.LineRuns.frequent
    monkeypatch.setattr(line_dedup.LineRuns, "frequent", lambda self: read.append([len(level) for level in self.levels]) or plain(self))
    table = docs(spark, *["common\nrare %d" % i for i in range(12)])
    assert sorted(r["text"] for r in line_dedup.drop_frequent_lines(table).collect()) == sorted("rare %d" % i for i in range(12))
    assert read == [[0, 1]]


def test_runs_are_compacted_and_find_seen_lines(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    batches = [docs(spark, "a\nb\nb"), docs(spark, "b\nc"), docs(spark, "c\nd\n"), docs(spark, "a\nd\ne")]
    fresh = [sorted(r["at"] for r in line_dedup.new_lines(b, runs).collect()) for b in batches]
    assert fresh == [[0, 1, 2], [1], [1], [2]]
    assert [len(level) for level in runs.levels] == [2, 1]
    assert sorted(r.docs for r in runs.counts().collect()) == [1, 2, 2, 2, 2]
    few = line_dedup.LineRuns(spark, least=3, fanout=2)
    for n in range(7):  # a key in all batches is counted until it is frequent, then anti-joined away
        few.add(line_dedup.line_table(docs(spark, "always\nonce %d" % n, "x %d" % (n % 3)), "doc_id", "text").select("h1", "h2"))
    assert sorted(r.docs for r in few.counts().collect())[-2:] == [3, 3] and few.frequent().count() == 2
    held = few._runs()[0]
    plan = few.unseen(line_dedup.line_table(docs(spark, "a"), "doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and held.count() > 0


def test_frequent_keys_in_any_number(spark, monkeypatch):
    texts = ["common\nrare %d\nCommon" % i for i in range(12)]
    monkeypatch.setattr(line_dedup, "SMALL", 0)
    table = docs(spark, *texts).selectExpr("doc_id", "text", "doc_id as k", "'z' as kept", "'y' as drop")
    got = sorted(tuple(r) for r in line_dedup.drop_frequent_lines(table, keep=("k", "kept", "drop")).collect())
    assert got == [(i, i, "z", "y", "rare %d" % i, 3, 2) for i in range(12)]


# ---- fingerprints ---------------------------------------------------------------------------------------------------


def plain_form(text):
    return re.sub(r"[\s\x85\xa0]+", " ", unicodedata.normalize("NFKC", text or "").lower()).strip(" ")


def test_canonical_forms_share_fingerprints(spark):
    texts = ["Ａ  b\nc", "a b c", " A B\tC ", "a b", "ﬁn", "FIN", "é", "É", None, "", " \n"]
    got = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(docs(spark, *texts)).collect()}
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert (got[i] == got[j]) == (plain_form(a) == plain_form(b)), (a, b)


def test_colliding_forms_are_told_apart(spark):
    forms = spark.createDataFrame([("a", "f"), ("a", "f"), ("b", "f"), ("c", "g")], "form string, fingerprint string")
    assert [(r.fingerprint, r.n) for r in fingerprint.collisions(forms).collect()] == [("f", 2)]
    rows = fingerprint.with_next(docs(spark, "a"))
    assert [tuple(r) for r in rows.collect()] == [(0, "a", "a")]


def test_next_documents(spark):
    rng = random.Random(5)
    ids = rng.sample(range(-1000, 5000), 300) + [7, 7, 7]
    rows = spark.createDataFrame([(i, f"t{i}-{n % 3}") for n, i in enumerate(ids)], "doc_id long, text string").repartition(5)
    expected = sorted((r.doc_id, r.text) for r in rows.collect())
    got = sorted((r.key, r.text, r.next_text) for r in fingerprint.with_next(rows).collect())
    assert got == sorted((k, t, expected[(n + 1) % len(expected)][1]) for n, (k, t) in enumerate(expected))
    assert fingerprint.with_next(rows.limit(0)).count() == 0


def test_fingerprint_query(spark):
    table = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r.doc_id: r for r in queries.op9_canonical_digest(spark, SF).collect()}
    assert len(got) == len(table)
    for n, (doc_id, text) in enumerate(table):
        after = table[(n + 1) % len(table)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        r = got[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == float(plain_form(text) == plain_form(edited))
        assert r.near_next == float(plain_form(text) == plain_form(after))
        assert (r.fingerprint == r.edited_fingerprint) == (plain_form(text) == plain_form(edited))

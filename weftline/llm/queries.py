"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, fingerprint, html_text, language_id, lexical_search, line_dedup, ngram_join, packing, phrases, pii, secrets, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _crc_mod(n: int):
    """crc32 of doc_id as text, mod n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op2_adaptive_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.similar(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op3_viterbi_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(_crc_mod(3) == 1, F.lit(False)))
    model = language_id.fit(language_id.training_rows(docs, ~F.col("held_out")))
    return language_id.identify(docs, model, keep=["held_out"])


def op4_rank_queue_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.token_digests(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, spaces=True)


def op5_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return packing.pack_documents(_table(spark, sf_dir, "documents"), file.read())


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Fitted on labels of rows whose crc32(doc_id as text) mod 5 is not 0."""
    kept = F.crc32(F.col("lk").cast("string").cast("binary")) % 5 != 0
    return toxicity.fit(toxicity.training_rows(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), kept))


def op6_word_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(_table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(_crc_mod(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op7_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents"), secrets.ledger_for_run(spark))
    spans = F.coalesce("spans", F.array().cast(secrets.SPAN))

    def listed(of):
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in secrets.BASE_KINDS]
    base = F.filter(spans, lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"))


def op8_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_frequent_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rows = fingerprint.with_next(docs)
    cut = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.substring("next_text", F.lit(1), cut))
    rows = rows.select("key", "text", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "next_text")
    rows = rows.select(
        F.col("key").alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.canonical(F.col("text")).alias("form"),
        fingerprint.canonical(F.col("edited")).alias("edited_form"),
        fingerprint.canonical(F.col("next_text")).alias("next_form"),
    )
    rows = rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.sha2("form", 256).alias("form_sha"),
        F.sha2("edited_form", 256).alias("edited_form_sha"),
        fingerprint.digest(F.col("form")).alias("fingerprint"),
        fingerprint.digest(F.col("edited_form")).alias("edited_fingerprint"),
        (F.col("form") == F.col("edited_form")).cast("double").alias("near_edited"),
        (F.col("form") == F.col("next_form")).cast("double").alias("near_next"),
    )
    return fingerprint.number_collisions(docs, rows, {"fingerprint": "form_sha", "edited_fingerprint": "edited_form_sha"}).drop("form_sha", "edited_form_sha")


def op10_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op11_boosted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))

    def listed(of):
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    whole = F.concat("base", "added")
    return found.select(F.col("k").alias("doc_id"), *[count(k) for k in pii.BASE], F.sha2(listed("base"), 256).alias("base_sha256"), listed(whole).alias("spans"))


def op12_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def op13_apriori_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_line_blocks": op1_line_blocks,
    "op2_adaptive_prefix_join": op2_adaptive_prefix_join,
    "op3_viterbi_spans": op3_viterbi_spans,
    "op4_rank_queue_bpe": op4_rank_queue_bpe,
    "op5_pattern_packing": op5_pattern_packing,
    "op6_word_cnn": op6_word_cnn,
    "op7_secret_ledger": op7_secret_ledger,
    "op8_line_runs": op8_line_runs,
    "op9_canonical_digest": op9_canonical_digest,
    "op10_one_bit_codes": op10_one_bit_codes,
    "op11_boosted_spans": op11_boosted_spans,
    "op12_bit_sliced_search": op12_bit_sliced_search,
    "op13_apriori_phrases": op13_apriori_phrases,
}

ORACLES = {
    "op10_one_bit_codes": """
        WITH v AS (
          SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
          WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), scored AS (
          SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
        )
        SELECT query_id, rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
        WHERE rank <= 20
    """,
    "op8_line_runs": r"""
        WITH lines AS (
          SELECT doc_id, t.pos, t.line,
                 translate(trim(t.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
               LATERAL (SELECT unnest(d.ls) AS line, generate_subscripts(d.ls, 1) AS pos) t
        ), hot AS (
          SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
        )
        SELECT doc_id, count(*) AS n_lines, count(h.key) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE h.key IS NULL), '')) AS kept_sha256
        FROM lines LEFT JOIN hot h ON lines.key = h.key GROUP BY doc_id
    """,
    "op12_bit_sliced_search": r"""
        WITH d AS (
          SELECT row_number() OVER () AS row, doc_id,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
        ), whole AS (
          SELECT count(*) AS docs, sum(len(terms))::BIGINT AS words FROM d WHERE len(terms) > 0
        ), tf AS (
          SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) GROUP BY ALL
        ), df AS (
          SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term, docs
        ), asked AS (
          SELECT nth, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
          FROM (SELECT row_number() OVER () AS nth, * FROM benchmark)
        ), scores AS (
          SELECT nth, item_id, doc_id,
                 sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * len(terms) * docs) // words))))::BIGINT AS score
          FROM asked JOIN df USING (term) JOIN tf USING (term) JOIN d USING (row), whole GROUP BY nth, item_id, doc_id, row
        )
        SELECT item_id, rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY nth ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0)
        WHERE rank <= 10
    """,
    "op13_apriori_phrases": r"""
        WITH pieces AS MATERIALIZED (
          SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
          FROM (SELECT coalesce(lang, 'und') AS lang,
                       unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
        ), line AS (
          SELECT row_number() OVER () AS piece, lang, ws FROM pieces WHERE len(ws) > 0
        ), placed AS (
          SELECT lang, piece, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM line
        ), grams AS (
          SELECT lang, unnest([1, 2, 3, 4])::BIGINT AS k,
                 unnest([w, w || ' ' || lead(w, 1) OVER o, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o,
                         w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o]) AS phrase
          FROM placed WINDOW o AS (PARTITION BY piece ORDER BY pos)
        ), f AS MATERIALIZED (
          SELECT lang, k, phrase, count(*) AS f FROM grams WHERE phrase IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
        ), words AS (
          SELECT lang, sum(len(ws))::BIGINT AS n FROM pieces GROUP BY lang
        ), halves AS (
          SELECT lang, phrase, f AS a, cut, array_to_string(ws[1:cut], ' ') AS lhs, array_to_string(ws[cut + 1:k], ' ') AS rhs
          FROM (SELECT *, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS cut FROM f WHERE k > 1)
        ), cuts AS (
          SELECT h.lang, h.phrase, a, l.f AS l, r.f AS r, cut, (2000000 * a::HUGEINT // (l.f + r.f))::BIGINT AS score
          FROM halves h JOIN f l ON l.lang = h.lang AND l.phrase = lhs JOIN f r ON r.lang = h.lang AND r.phrase = rhs
        ), least AS (
          SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM cuts
        ), longer AS (
          SELECT lang, phrase, max(f) AS f FROM (
            SELECT lang, f, unnest(flatten([[array_to_string(ws[i:i + m - 1], ' ') FOR i IN range(1, k - m + 2)] FOR m IN range(2, k)])) AS phrase
            FROM (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 2)
          ) GROUP BY ALL
        ), kept AS (
          SELECT least.* FROM least LEFT JOIN longer USING (lang, phrase)
          WHERE nth = 1 AND (longer.f IS NULL OR 100::HUGEINT * longer.f < 80::HUGEINT * a)
        )
        SELECT lang, rank, phrase, a, l, r, n, score
        FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN words USING (lang)
        WHERE rank <= 2000
    """,
}

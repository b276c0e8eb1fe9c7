"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of a text is known by its SHA-256. The ledger holds, for each (blob, rule version) scanned so far, the
spans found. A run takes the distinct blobs of its input, leaves out the pairs that the ledger has, scans the rest
once each and adds them; findings are joined back to every row (path) that holds the blob.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import new_path

#: Kind, pattern, group whose length counts, least length of it. A kind's place orders equal starts.
RULES = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
)
BASE_KINDS = ("assign", "access", "hex")
SPAN = "array<struct<kind:string,start:int,end:int>>"
LEDGER = f"blob string, rule_version string, spans {SPAN}"


def rule_version(rules=RULES) -> str:
    """Name of a rule set: changes with any rule, so that old blobs are scanned again."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def scanner(rules=RULES):
    """Function from a text to its spans (kind, start, end), by start and then by the kind's place in the rules."""
    words = ("password", "passwd", "secret", "token", "apikey", "api_key")
    tests = []
    for place, (kind, pattern, group, least) in enumerate(rules):
        if kind == "hex" and pattern == "[0-9a-f]+":  # a run is taken whole, so short ones need not be matched
            pattern = f"[0-9a-f]{{{least},}}"
        flags = re.ASCII | (re.IGNORECASE if kind == "assign" else 0)
        tests.append((place, kind, re.compile(pattern, flags), group, least))

    def scan(text: str) -> list[tuple[str, int, int]]:
        lower, found = text.lower(), []
        for place, kind, pattern, group, least in tests:
            if kind == "assign" and not any(w in lower for w in words):
                continue
            for m in pattern.finditer(text):
                if m.end(group) - m.start(group) >= least:
                    found.append((m.start(), place, kind, m.end()))
        return [(kind, start, end) for start, _, kind, end in sorted(found)]

    return scan


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows; a folder that does not exist yet is an empty ledger."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.read.schema(LEDGER).parquet(path)
    return spark.createDataFrame([], LEDGER)


def scan_unseen(docs: DataFrame, ledger: DataFrame, rules=RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ledger rows for the blobs of docs whose pair with this rule version is not in the ledger. Null texts: empty."""
    version = rule_version(rules)
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("blob", F.sha2("t", 256))
    seen = ledger.filter(F.col("rule_version") == version).select("blob")
    # Copies of a blob collapse in each task before the shuffle; only one row of each blob goes on.
    fresh = rows.groupBy("blob").agg(F.min("k").alias("k")).join(seen, "blob", "left_anti")
    fresh = fresh.select(F.col("blob").alias("b"), F.col("k").alias("one")).hint("shuffle_hash")
    texts = rows.join(fresh, F.col("k").eqNullSafe(F.col("one")) & (F.col("blob") == F.col("b"))).select("blob", "t")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = scanner(rules)
        for pdf in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t)] for t in pdf["t"]]
            yield pd.DataFrame({"blob": pdf["blob"], "rule_version": version, "spans": spans})

    # A row that is repeated with its key is scanned again with the same outcome; one of them stays.
    return texts.mapInPandas(scan, LEDGER).dropDuplicates(["blob", "rule_version"])


def scan_secrets(docs: DataFrame, ledger_path: str, rules=RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, blob, spans) of every row of docs; the ledger in ledger_path gains what had not been scanned.

    Null and empty texts have no spans. Repeated rows stay. An empty table gives no rows."""
    spark = docs.sparkSession
    scan_unseen(docs, open_ledger(spark, ledger_path), rules, key, text).write.mode("append").parquet(ledger_path)
    paths = docs.select(F.col(key), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("blob"))
    return paths.join(_scanned(spark, ledger_path, rules), "blob", "left").select(key, "blob", "spans")


def _scanned(spark: SparkSession, ledger_path: str, rules) -> DataFrame:
    """(blob, spans) of the ledger for a rule version. Two runs at once can append a blob twice, with the same spans: one
    of the rows is taken, by the partitioning that the join with blobs needs anyway."""
    ledger = spark.read.schema(LEDGER).parquet(ledger_path).filter(F.col("rule_version") == rule_version(rules))
    return ledger.select("blob", "spans").dropDuplicates(["blob"])


MARK = "[secret]"


def redact(docs: DataFrame, ledger_path: str, rules=RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, in whose texts each stretch of spans is replaced by MARK.

    Null texts stay null. The blobs are scanned as in scan_secrets()."""
    spark = docs.sparkSession
    scan_unseen(docs, open_ledger(spark, ledger_path), rules, key, text).write.mode("append").parquet(ledger_path)
    found = _scanned(spark, ledger_path, rules).filter(F.size("spans") > 0)
    found = found.select(F.col("blob"), F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))

    @F.pandas_udf("string")
    def cover(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([_covered(t, s, e) for t, s, e in zip(texts, starts, ends)], dtype="object")

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("own"))
    joined = rows.join(found.hint("shuffle_hash"), F.col("own") == F.col("blob"), "left")
    whole = F.col(f"row.`{text}`")
    clean = F.when(F.col("starts").isNull(), whole).otherwise(cover(whole, "starts", "ends"))
    return joined.select(*[clean.alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])


def _covered(text: str | None, starts, ends) -> str | None:
    if text is None or starts is None:
        return text
    out, at = [], 0
    for start, end in sorted(zip(starts, ends)):
        if start >= at:
            out += [text[at:start], MARK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def ledger_for_run(spark: SparkSession) -> str:
    """A new ledger's path in the shared folder."""
    return new_path(spark, "secret-ledger")

"""Snapshots of sites: fetches with their bodies, written as JSON lines and read again, bodies cut and inflated while reading.

A line is one fetch, not one site, so a site of many pages is many lines; files lie in folders by a hash of the site, so that
reading some sites opens their folders only. The reader has the schema, so columns that are not asked for are not parsed.
Bodies are bytes in base64, as they were received: a gzip body stays one. What is read of a body is its first bytes, up to the
cap of its purpose, as a client would stop there; then it is inflated as far as it goes.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .parse import inflate

#: Bytes read of the body of a page, of a sitemap or a robots file, and of what is only looked at.
CAPS = {"page": 2 << 20, "small": 1 << 20, "tiny": 512 << 10}
FOLDERS = 64
SCHEMA = "site string, ord long, purpose string, requested_url string, final_url string, status int, headers map<string,string>, body string, error string, folder int"


def folder_of(site: Column, folders: int = FOLDERS) -> Column:
    return F.pmod(F.xxhash64(site), F.lit(folders)).cast("int")


def write_snapshot(fetches: DataFrame, path: str, folders: int = FOLDERS) -> None:
    """Write fetches (site, ord, purpose, requested_url, final_url, status, headers, body, error), body as bytes. A folder that
    holds a snapshot is replaced as a whole; a job that fails leaves no mark of success."""
    names = [c.strip().split(" ")[0] for c in SCHEMA.split(", ")]
    rows = fetches.withColumn("body", F.base64("body")).withColumn("folder", folder_of(F.col("site"), folders)).select(names)
    rows.write.mode("overwrite").partitionBy("folder").json(path)


def cut(body: Column, purpose: Column, caps: dict[str, int] | None = None) -> Column:
    """The first bytes of a body, as many as its purpose allows; purposes that have no cap are read as pages."""
    caps = caps or CAPS
    most = F.lit(caps["page"])
    for name, n in caps.items():
        most = F.when(purpose == name, n).otherwise(most)
    return F.substring(body, F.lit(1), most)


def read_snapshot(spark: SparkSession, path: str, sites: Iterable[str] | None = None, caps: dict[str, int] | None = None, folders: int = FOLDERS) -> DataFrame:
    """(site, ord, purpose, requested_url, final_url, status, headers, error, body, cut) of a snapshot, of some sites only if they
    are named. body is what is left after the cap and inflating; cut tells that the cap took something."""
    rows = spark.read.schema(SCHEMA).json(path)
    if sites is not None:
        named = list(sites)
        at = [r["f"] for r in spark.range(1).select(F.explode(F.array(*map(F.lit, named)) if named else F.array().cast("array<string>")).alias("s")).select(folder_of(F.col("s"), folders).alias("f")).distinct().collect()]
        rows = rows.filter(F.col("folder").isin(at) & F.col("site").isin(named))
    raw = F.unbase64("body")
    rows = rows.withColumn("raw", cut(raw, F.col("purpose"), caps)).withColumn("cut", F.coalesce(F.octet_length("raw") < F.octet_length(raw), F.lit(False)))
    return inflated(rows, "raw", "body").drop("raw", "folder")


def inflated(rows: DataFrame, column: str, to: str) -> DataFrame:
    """rows with the bytes of a column inflated, each by itself: a broken stream gives what comes before the break."""
    if to in rows.columns and to != column:
        rows = rows.drop(to)
    out = rows.withColumn(to, F.col(column)).schema if to != column else rows.schema
    at, last = rows.columns.index(column), rows.columns.index(to) if to in rows.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = pa.array([inflate(b) for b in batch.column(at).to_pylist()], pa.binary())
            columns = list(batch.columns)
            if last is None:
                columns.append(done)
            else:
                columns[last] = done
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in out])

    return rows.mapInArrow(run, out)


def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: the bytes of `body` as gzip where `zip` holds, so that a table can be written as it would be received."""
    for batch in batches:
        bodies = [gzip.compress(b, mtime=0) if z and b is not None else b for b, z in zip(batch.column("body").to_pylist(), batch.column("zip").to_pylist())]
        yield batch.set_column(batch.column_names.index("body"), "body", pa.array(bodies, pa.binary()))


def text_of(body: Column) -> Column:
    """A body as text; bytes that are no UTF-8 become replacement characters."""
    return F.make_valid_utf8(body.cast("string"))

"""Incremental audit: pages that arrive as files are parsed and checked batch by batch, with exactly-once results.

Most checks are about a site as a whole, so a batch alone does not tell: site_audit_stream() keeps the pages that have come, in
folders by a hash of their site, and audits all pages of the sites that a batch touches. What it writes for a site replaces what
it wrote before; current() reads the last."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.snapshots import folder_of

PAGES = "page_id long, url string, html string"


def read_stream(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def audit_stream(pages: DataFrame, audit: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Writes audit(batch) for each batch to its own folder of out; a batch that is run again replaces its folder."""

    def write(batch: DataFrame, number: int) -> None:
        audit(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def site_audit_stream(pages: DataFrame, audit: Callable[[DataFrame], DataFrame], out: str, store: str, checkpoint: str) -> StreamingQuery:
    """Writes audit(all pages so far of the sites of the batch) for each batch to its own folder of out.

    pages need a column site, and so do the results. store has the pages by batch and folder of their site; a batch that is run
    again replaces its pages and its results, and reads the pages of batches before it only. A page that comes again under the
    same page_id and url counts in its last form."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("folder", folder_of(F.col("site")))
        batch.write.mode("overwrite").partitionBy("folder").parquet(f"{store}/batch={number}")
        # At most one folder for each of a fixed number: which of them hold the sites of this batch.
        new = spark.read.option("basePath", store).parquet(f"{store}/batch={number}")
        folders = [r["folder"] for r in new.select("folder").distinct().collect()]
        if not folders:
            return
        kept = spark.read.parquet(store).filter((F.col("batch") <= number) & F.col("folder").isin(folders))
        touched = kept.join(new.select("site").distinct(), "site", "left_semi")
        names = [c for c in touched.columns if c not in ("batch", "folder")]
        last = touched.groupBy("page_id", "url").agg(F.max_by(F.struct(*names), "batch").alias("row")).select("row.*")
        audit(last).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """The last results of each site that site_audit_stream() wrote."""
    rows = spark.read.parquet(out)
    last = rows.groupBy("site").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["site", "batch"]).drop("batch")

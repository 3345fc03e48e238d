"""Registered streaming queries: the derived log arrives shuffled, in some files, and each result equals the batch one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.plans.registry import query, sealed
from chronofold.sources import fixtures as fx
from chronofold.sources.log import decode_records
from chronofold.sources.tables import new_folder, stored
from chronofold.streaming import streams

BATCHES = 4
#: Rows that one file of a batch holds, about.
FILE_ROWS = 100_000


def arriving(rows: DataFrame, work: str) -> DataFrame:
    """The rows as a stream of BATCHES batches, in the order of a hash of their ids, written one after another.

    Each batch has the same number of files, more for more rows, so that all cores write and read it; the stream takes so
    many at a time. Where a task had no row to write, an empty file stands in.
    """
    spark = rows.sparkSession
    batch = F.conv(F.substring(F.sha2("id", 256), 1, 1), 16, 10).cast("int") * BATCHES / 16
    files = max(min(rows.count() // (BATCHES * FILE_ROWS), rows.rdd.getNumPartitions()), 1)
    for k in range(BATCHES):
        rows.filter(F.floor(batch) == k).coalesce(files).write.mode("append").parquet(f"{work}/in")
        for _ in range((k + 1) * files - len(streams.parts(spark, f"{work}/in"))):
            spark.createDataFrame([], rows.schema).coalesce(1).write.mode("append").parquet(f"{work}/in")
    return streams.read_rows(spark, f"{work}/in", rows.schema, files)


@query
def s01_stream_integrate(spark: SparkSession, sf: str) -> DataFrame:
    work = new_folder(spark)
    log = stored(sealed(spark, sf))
    return streams.integrate(arriving(log.unionByName(log.filter("kind = 'rename'")), work), work).select("id", "file_id")


@query
def s02_stream_fold(spark: SparkSession, sf: str) -> DataFrame:
    work = new_folder(spark)
    return streams.fold(arriving(fx.log(spark, sf), work), work, fx.blobs(spark, sf)).select("file_id", "path", "result_hash", "deleted", "lamport", "conflict")


@query
def s03_stream_debounce(spark: SparkSession, sf: str) -> DataFrame:
    work = new_folder(spark)
    rows = fx.log(spark, sf).filter("kind in ('create', 'edit')")
    return streams.whole(streams.debounce(arriving(rows, work)), work)


@query
def s04_stream_version_vector(spark: SparkSession, sf: str) -> DataFrame:
    work = new_folder(spark)
    return streams.updates(streams.version_vector(arriving(fx.log(spark, sf), work)), work, ["site_id"])


@query
def s05_stream_status(spark: SparkSession, sf: str) -> DataFrame:
    work = new_folder(spark)
    return streams.updates(streams.status(arriving(fx.log(spark, sf), work)), work, [])


@query
def s06_stream_activity(spark: SparkSession, sf: str) -> DataFrame:
    work = new_folder(spark)
    return streams.updates(streams.activity(arriving(fx.log(spark, sf), work)), work, ["bucket", "kind"])


@query
def s06_stream_activity_sliding(spark: SparkSession, sf: str) -> DataFrame:
    work = new_folder(spark)
    return streams.updates(streams.activity(arriving(fx.log(spark, sf), work), "1 day", "6 hours"), work, ["bucket", "kind"])


@query
def s07_stream_records(spark: SparkSession, sf: str) -> DataFrame:
    work = new_folder(spark)
    rows = decode_records(fx.meta(spark, sf), "branch").select("id", "lamport", "site_id", "file_id", "rec")
    return streams.updates(streams.records(arriving(rows, work)), work, ["file_id"]).select("rec.branch_id", "rec.name", "rec.parent", "rec.created_lamport", "rec.deleted")


@query
def s08_stream_files_delta(spark: SparkSession, sf: str) -> DataFrame:
    work = new_folder(spark)
    rows = streams.files_delta(arriving(fx.log(spark, sf), work), work, fx.blobs(spark, sf))
    return rows.groupBy("file_id").agg(F.max_by("action", "batch").alias("last_action"), F.count_if(F.col("action") == "insert").alias("inserts"))

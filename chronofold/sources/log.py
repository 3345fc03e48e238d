"""Reading, checking and writing change rows and contents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.functions.ids import blob_valid, content_hash, id_valid
from chronofold.functions.text import ignored
from chronofold.sources.schemas import BRANCH_RECORD, MAIN, META_KINDS, TAG_RECORD
from chronofold.sources.tables import stored


def scan_tree(spark: SparkSession, root: str, rules: str = "", private: str = ".store") -> DataFrame:
    """path (below root), modified and size of every file in scope; contents are not read.

    Spark's reader leaves out names that begin with a dot or an underscore.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).drop("content")
    base = root.rstrip("/").rsplit("/", 1)[-1]
    below = F.regexp_extract("path", rf"/{re.escape(base)}/(.*)$", 1)
    rows = rows.select(below.alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    return in_scope(rows, rules, private)


def in_scope(listing: DataFrame, rules: str = "", private: str = ".store") -> DataFrame:
    """The rows of listing(path, ...) that the scope rules leave."""
    return listing.filter(~ignored(F.col("path"), rules, private))


def changed_files(listing: DataFrame, known: DataFrame) -> DataFrame:
    """path, content_hash and status of listing(path, mtime, size, bytes) against known(path, mtime, size, content_hash).

    Where time and size agree the known hash stands; other contents are hashed; known paths that are gone are `vanished`.
    """
    old = known.select("path", F.col("mtime").alias("k_mtime"), F.col("size").alias("k_size"), F.col("content_hash").alias("k_hash"))
    both = listing.join(old, "path", "full_outer")
    same = F.col("mtime").eqNullSafe(F.col("k_mtime")) & F.col("size").eqNullSafe(F.col("k_size"))
    status = F.when(F.col("mtime").isNull(), "vanished").when(same, "cached").otherwise("hashed")
    value = F.when(F.col("mtime").isNull(), None).when(same, F.col("k_hash")).otherwise(content_hash(F.col("bytes")))
    return both.select("path", value.alias("content_hash"), status.alias("status"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log rows, of whatever files the folder has gathered; missing columns are filled as load_old_log() does."""
    return load_old_log(spark.read.option("mergeSchema", "true").parquet(path))


def load_old_log(log: DataFrame) -> DataFrame:
    """Rows from before branches: branch_id is main, merge_parent null."""
    have = set(log.columns)
    if "branch_id" not in have:
        log = log.withColumn("branch_id", F.lit(None).cast("string"))
    if "merge_parent" not in have:
        log = log.withColumn("merge_parent", F.lit(None).cast("string"))
    return log.withColumn("branch_id", F.coalesce("branch_id", F.lit("main")))


def rows_for_files(log: DataFrame, files: DataFrame) -> DataFrame:
    return log.join(files.select("file_id").distinct(), "file_id", "left_semi")


def meta_rows(log: DataFrame, kind: str | None = None) -> DataFrame:
    """Branch and tag records; on a log partitioned by is_meta the other partition is not read."""
    kinds = META_KINDS if kind is None else (kind,)
    partition = log.filter("is_meta") if "is_meta" in log.columns else log
    return partition.filter(F.col("kind").isin(*kinds))


def write_log(log: DataFrame, path: str, mode: str = "append") -> None:
    """One folder per value of is_meta, clustered by file so that a file's rows share row groups."""
    rows = log.withColumn("is_meta", F.col("kind").isin(*META_KINDS))
    rows.repartition("file_id").sortWithinPartitions("file_id", "lamport").write.mode(mode).partitionBy("is_meta").parquet(path)


def new_rows(held: DataFrame, incoming: DataFrame) -> DataFrame:
    """The rows to append: one per id that is not held. The join leaves them sorted by id, as the choice of one needs them."""
    return incoming.join(held.select("id"), "id", "left_anti").dropDuplicates(["id"])


def checked(rows: DataFrame, blobs: DataFrame | None = None) -> DataFrame:
    """rows, failing the job where an id does not match its fields or blobs(content_hash, bytes) has a content not its hash's."""
    seen = F.when(id_valid(), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("row id does not match: "), F.coalesce("id", F.lit("null")))))
    rows = rows.withColumn("id", seen)
    if blobs is not None:
        bad = blobs.filter(~blob_valid()).agg(F.min("content_hash").alias("__bad"))  # one row
        fine = F.when(F.col("__bad").isNotNull(), F.raise_error(F.concat(F.lit("content does not match: "), F.col("__bad")))).otherwise(F.col("id"))
        rows = rows.crossJoin(F.broadcast(bad)).withColumn("id", fine).drop("__bad")
    return rows


def integrate(held: DataFrame, incoming: DataFrame, blobs: DataFrame | None = None) -> DataFrame:
    """incoming(position, ...) with is_new: not held, and the first of its id in the batch.

    A row whose id is not its fields' hash, or a content of blobs(content_hash, bytes) that is not its hash's, fails the job.
    """
    rows = checked(incoming, blobs)
    first = Window.partitionBy("id").orderBy("position")
    rows = rows.withColumn("__k", F.row_number().over(first))
    mine = held.select("id").distinct().withColumn("__held", F.lit(True))
    rows = rows.join(mine, "id", "left").withColumn("is_new", F.col("__held").isNull() & (F.col("__k") == 1))
    return rows.drop("__k", "__held")


def put_blobs(held: DataFrame, contents: DataFrame) -> DataFrame:
    """The (content_hash, bytes) of contents(bytes) that are not held, once each."""
    rows = contents.select(content_hash(F.col("bytes")).alias("content_hash"), "bytes").dropDuplicates(["content_hash"])
    return rows.join(held.select("content_hash"), "content_hash", "left_anti")


def get_blobs(blobs: DataFrame, hashes: DataFrame) -> DataFrame:
    return blobs.join(hashes.select("content_hash").distinct(), "content_hash", "left_semi")


def replace_files(files: DataFrame, path: str) -> DataFrame:
    """Overwrites the table of files at path and reads it back."""
    files.write.mode("overwrite").parquet(path)
    return files.sparkSession.read.schema(files.schema).parquet(path)


def sync_files(new: DataFrame, old: DataFrame, key: str = "file_id") -> DataFrame:
    """key and action (insert, update, delete) that turn old into new; unchanged rows give none."""
    names = [c for c in new.columns if c != key]
    a = new.select(key, F.struct(*names).alias("__new"))
    b = old.select(key, F.struct(*names).alias("__old"))
    both = a.join(b, key, "full_outer").filter(~F.col("__new").eqNullSafe(F.col("__old")))
    action = F.when(F.col("__old").isNull(), "insert").when(F.col("__new").isNull(), "delete").otherwise("update")
    return both.select(key, action.alias("action"))


def bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("part")


def write_files(files: DataFrame, path: str, key: str = "file_id", buckets: int = 64) -> None:
    """Writes a table of files in buckets of its key, which upsert_files() then changes one by one."""
    files.withColumn("part", bucket(key, buckets)).repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)


def read_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table that write_files() wrote; a schema without the bucket column."""
    return spark.read.schema(f"{schema}, part int").parquet(path).drop("part")


def upsert_files(changed: DataFrame, gone: DataFrame, path: str, key: str = "file_id", buckets: int = 64) -> list[int]:
    """Puts changed rows into the table at path and takes those of gone(key) out; returns the buckets written.

    Only buckets that hold such a row are read and overwritten; the files of all others stay as they are.
    """
    spark = changed.sparkSession
    keys = stored(changed.select(key).union(gone.select(key)).distinct().withColumn("part", bucket(key, buckets)))
    parts = sorted(r[0] for r in keys.select("part").distinct().collect())  # `buckets` at most
    if not parts:
        return []
    table = spark.read.schema(changed.withColumn("part", bucket(key, buckets)).schema).parquet(path)
    kept = table.filter(F.col("part").isin(parts)).join(keys.select(key), key, "left_anti")
    rows = stored(kept.select(*changed.columns, "part").unionByName(changed.withColumn("part", bucket(key, buckets))))
    rows.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    left = {r[0] for r in rows.select("part").distinct().collect()}
    for p in set(parts) - left:  # a bucket that has lost its last row
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part={p}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return parts


def referenced_hashes(log: DataFrame) -> DataFrame:
    both = F.explode(F.array("base_hash", "result_hash"))
    return log.select(both.alias("content_hash")).filter("content_hash is not null").distinct()


def export_state(log: DataFrame, blobs: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The log and every content that it refers to, once; written below path if one is given."""
    needed = get_blobs(blobs, referenced_hashes(log))
    if path:
        write_log(log, f"{path}/log", "overwrite")
        needed.write.mode("overwrite").parquet(f"{path}/blobs")
    return log, needed


def import_state(held: DataFrame, vault: str, incoming: DataFrame, incoming_vault: str, blobs: DataFrame | None = None) -> DataFrame:
    """New rows of an exported log, ids and contents checked; another vault's is refused. A second import adds nothing."""
    if vault != incoming_vault:
        raise ValueError(f"state of vault {incoming_vault!r}, not {vault!r}")
    return new_rows(held, checked(incoming, blobs))


def bundle_wire(log: DataFrame, blobs: DataFrame) -> DataFrame:
    """id and the distinct contents (content_hash, bytes) that each row needs, by hash."""
    wanted = log.select("id", F.explode_outer(F.array_distinct(F.array_compact(F.array("base_hash", "result_hash")))).alias("content_hash"))
    found = wanted.join(blobs, "content_hash", "left")
    blob = F.when(F.col("bytes").isNotNull(), F.struct("content_hash", "bytes"))
    return found.groupBy("id").agg(F.array_sort(F.collect_list(blob)).alias("blobs"))


def shipped_once(log: DataFrame) -> DataFrame:
    """(site_id, seq, content_hash) of a catch-up in which each content goes with the first row that needs it."""
    wanted = log.select("site_id", "seq", F.explode(F.array_distinct(F.array_compact(F.array("base_hash", "result_hash")))).alias("content_hash"))
    # Arg-min with partial aggregation: a content that very many rows name is no single window.
    first = wanted.groupBy("content_hash").agg(F.min(F.struct("site_id", "seq")).alias("r"))
    return first.select("r.site_id", "r.seq", "content_hash")


def decode_records(meta: DataFrame, kind: str) -> DataFrame:
    """Readable records of meta(..., record) of one kind, as struct `rec`; fields that old records lack get their defaults."""
    schema, key = (BRANCH_RECORD, "branch_id") if kind == "branch" else (TAG_RECORD, "tag_id")
    rows = meta.filter(F.col("kind") == kind).withColumn("rec", F.from_json("record", schema))
    rec = rows["rec"].withField("deleted", F.coalesce("rec.deleted", F.lit(False)))
    if kind == "tag":
        rec = rec.withField("branch_id", F.coalesce("rec.branch_id", F.lit(MAIN))).withField("at_lamport", F.coalesce("rec.at_lamport", F.lit(0)))
    return rows.filter(F.col(f"rec.{key}").isNotNull()).withColumn("rec", rec)

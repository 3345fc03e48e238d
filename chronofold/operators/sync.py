"""What replicas lack, version vectors, counters and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold.operators.fold import by_file, key_of
from chronofold.sources.schemas import META_KINDS


def version_vector(log: DataFrame) -> DataFrame:
    return log.groupBy("site_id").agg(F.max("seq").alias("seq"))


def missing_rows(log: DataFrame, peer: DataFrame) -> DataFrame:
    """Rows that a peer with this vector(site_id, seq) lacks; of an unknown site, all."""
    seen = peer.groupBy("site_id").agg(F.max("seq").alias("__seen"))
    return log.join(seen, "site_id", "left").filter(F.col("seq") > F.coalesce("__seen", F.lit(-1))).drop("__seen")


def page_after(log: DataFrame, site: str, after: int, limit: int) -> DataFrame:
    """The next page of a site's rows by seq."""
    return log.filter((F.col("site_id") == site) & (F.col("seq") > after)).orderBy("seq").limit(limit)


def parent_of(log: DataFrame, same_file: bool = True) -> DataFrame:
    """id, parent and parent_file of rows whose parent is in the log; across files only for an audit."""
    parents = log.select(F.col("id").alias("parent"), F.col("file_id").alias("parent_file"))
    if same_file:
        joined = log.join(parents, (log.file_id == parents.parent_file) & (log.parent == parents.parent))
        return joined.select(log.id, parents.parent, "parent_file")
    return log.select("id", "file_id", "parent").join(parents, "parent").select("id", "parent", "parent_file", (F.col("file_id") != F.col("parent_file")).alias("cross_file"))


def status(log: DataFrame, files: DataFrame) -> DataFrame:
    """One row: rows, last_ts, max_lamport, live_files."""
    a = log.agg(F.count(F.lit(1)).alias("rows"), F.max("ts").alias("last_ts"), F.max("lamport").alias("max_lamport")).withColumn("k", F.lit(1))
    b = files.agg(F.count_if(~F.col("deleted")).alias("live_files")).withColumn("k", F.lit(1))
    return a.join(b, "k").drop("k")


def next_counters(log: DataFrame) -> DataFrame:
    """Per site the next seq, and the next lamport of all."""
    top = log.agg((F.max("lamport") + 1).alias("next_lamport")).withColumn("k", F.lit(1))
    return log.groupBy("site_id").agg((F.max("seq") + 1).alias("next_seq")).withColumn("k", F.lit(1)).join(F.broadcast(top), "k").drop("k")


def assign_counters(rows: DataFrame, order: list[str], first: int, out: str = "seq") -> DataFrame:
    """Dense numbers from `first` on in the given order, without one task for all rows.

    Rows are sorted into ranges, each range is counted, and a row's number is its place in its range after those before.
    """
    ranged = rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
    from chronofold.sources.tables import stored

    ranged = stored(ranged)
    counts = ranged.groupBy("__p").count()  # one row per range
    before = F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__p", F.coalesce(before, F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return ranged.join(F.broadcast(offsets), "__p").withColumn(out, F.lit(first) + F.col("__before") + place - 1).drop("__p", "__before")


def seq_gaps(log: DataFrame) -> DataFrame:
    """(site_id, after, missing) where a site's seq skips, and duplicates as missing = 0."""
    by_site = Window.partitionBy("site_id", F.expr("seq div 100000")).orderBy("seq")
    per = log.groupBy("site_id", "seq").agg(F.count(F.lit(1)).alias("n"))
    doubled = per.filter("n > 1").select("site_id", F.col("seq").alias("after"), F.lit(0).cast("long").alias("missing"))
    # Gaps inside blocks of seq by a window per block; between blocks from each block's ends, far fewer rows.
    inner = per.withColumn("next", F.lead("seq").over(by_site))
    ends = per.groupBy("site_id", F.expr("seq div 100000").alias("block")).agg(F.min("seq").alias("first"), F.max("seq").alias("seq"))
    outer = ends.withColumn("next", F.lead("first").over(Window.partitionBy("site_id").orderBy("block")))
    both = inner.select("site_id", "seq", "next").unionByName(outer.select("site_id", "seq", "next"))
    gaps = both.filter("next > seq + 1").select("site_id", F.col("seq").alias("after"), (F.col("next") - F.col("seq") - 1).alias("missing"))
    return gaps.unionByName(doubled)


def history(log: DataFrame) -> DataFrame:
    """Non-metadata rows with the file's latest path so far; '' before any."""
    path = F.last("path", ignorenulls=True).over(by_file().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = log.filter(~F.col("kind").isin(*META_KINDS))
    return rows.select("id", "file_id", "kind", "ts", "lamport", F.coalesce(path, F.lit("")).alias("path"))


def tip(log: DataFrame) -> DataFrame:
    """The last row of each file by order key."""
    return log.filter(~F.col("kind").isin(*META_KINDS)).groupBy("file_id").agg(F.max_by("id", key_of()).alias("tip"))


def reconciled(records: DataFrame, kind: str) -> DataFrame:
    """Last writer wins per record id among readable records(..., rec); tombstones stay."""
    rows = records.groupBy("file_id").agg(F.max_by("rec", key_of()).alias("rec"))
    order = ["created_lamport", "branch_id"] if kind == "branch" else ["at_ts", "tag_id"]
    return rows.select("file_id", "rec.*").orderBy(*order)


def kind_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("kind", "site_id", "branch_id").agg(F.count(F.lit(1)).alias("n"))


def first_seen(log: DataFrame) -> DataFrame:
    return history(log).groupBy("path").agg(F.min("ts").alias("first_ts"))


def content_groups(log: DataFrame, blobs: DataFrame) -> DataFrame:
    """content_hash and the number of rows that refer to it, unreferenced contents too."""
    refs = log.select(F.explode(F.array_compact(F.array("base_hash", "result_hash"))).alias("content_hash")).groupBy("content_hash").agg(F.count(F.lit(1)).alias("refs"))
    return blobs.select("content_hash").distinct().join(refs, "content_hash", "left").select("content_hash", F.coalesce("refs", F.lit(0)).alias("refs"))

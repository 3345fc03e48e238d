"""Capture: what changed between a listing of paths and the files known."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold.functions.text import ignored


def infer_renames(old: DataFrame, new: DataFrame, least_size: int = 8) -> DataFrame:
    """(old_path, new_path): the k-th vanished path of a content goes with its k-th new one, by path; small files never."""
    order = Window.partitionBy("content_hash").orderBy("path")
    gone = old.filter(F.col("size") > least_size).join(new.select("path"), "path", "left_anti").withColumn("k", F.row_number().over(order))
    came = new.filter(F.col("size") > least_size).join(old.select("path"), "path", "left_anti").withColumn("k", F.row_number().over(order))
    a = gone.select("content_hash", "k", F.col("path").alias("old_path"))
    return a.join(came.select("content_hash", "k", F.col("path").alias("new_path")), ["content_hash", "k"]).select("old_path", "new_path")


def capture_diff(files: DataFrame, listing: DataFrame, rules: str = "") -> DataFrame:
    """path and action of the difference; renamed files count as such, ignored paths are neither new nor deleted."""
    seen = listing.filter(~ignored(F.col("path"), rules))
    renames = infer_renames(files, seen)
    moved = renames.select(F.col("new_path").alias("path"), F.lit("rename").alias("action"))
    a = files.select("path", F.col("content_hash").alias("have"))
    b = seen.select("path", F.col("content_hash").alias("want"))
    both = a.join(b, "path", "full_outer").filter("not (have <=> want)")
    both = both.select("path", F.when(F.col("have").isNull(), "create").when(F.col("want").isNull(), "delete").otherwise("edit").alias("action"))
    both = both.join(listing.filter(ignored(F.col("path"), rules)).select("path"), "path", "left_anti")
    settled = renames.select(F.col("old_path").alias("path")).union(renames.select("new_path"))
    return both.join(settled, "path", "left_anti").unionByName(moved)


def parents_of(paths: DataFrame) -> DataFrame:
    parts = F.split("path", "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return paths.select(F.explode(above).alias("path")).distinct()


def dir_entities(empty_dirs: DataFrame, tracked: DataFrame, files: DataFrame, vacated: DataFrame) -> DataFrame:
    """path and action for directory entities: create for empty untracked ones, delete for those gone or filled.

    A directory that a path of this pass just left is never created.
    """
    left = parents_of(vacated)
    new = empty_dirs.select("path").join(tracked, "path", "left_anti").join(left, "path", "left_anti").withColumn("action", F.lit("create"))
    filled = tracked.select("path").join(parents_of(files), "path", "left_semi")
    gone = tracked.select("path").join(empty_dirs, "path", "left_anti")
    return new.unionByName(filled.union(gone).distinct().withColumn("action", F.lit("delete")))


def missing_deletes(files: DataFrame, host: DataFrame, warm: bool, rules: str = "") -> DataFrame:
    """Paths known but absent from the host's listing; a cold replica or an empty listing deletes nothing.

    Of files(path, ...) with merge_class or deleted, directories and files that are deleted already are left out.
    """
    if not warm or host.isEmpty():
        return files.select("path").limit(0)
    for column, plain in (("merge_class", F.lit("dir")), ("deleted", F.lit(True))):
        if column in files.columns:
            files = files.filter(~F.col(column).eqNullSafe(plain))
    return files.filter(~ignored(F.col("path"), rules)).select("path").join(host.select("path"), "path", "left_anti")

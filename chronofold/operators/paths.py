"""Path claims: which of the files that want one path gets it, and directory roll-ups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.sources.schemas import FILES
from chronofold.sources.tables import stored

#: A suffix goes before the last dot, unless that is the first character or a slash follows.
EXTENSION = r"(?s)^.+?(\.[^./]*)$"


def stem_and_extension(path: str) -> tuple[str, str]:
    dot = path.rfind(".")
    return (path[:dot], path[dot:]) if dot > 0 and "/" not in path[dot:] else (path, "")


def family(path: Column) -> Column:
    """The path without ` (n)` suffixes: only paths of one family can get in each other's way."""
    end = F.regexp_extract(path, EXTENSION, 1)
    stem = F.substring(path, F.lit(1), F.length(path) - F.length(end))
    return F.concat(F.regexp_replace(stem, r"( \(\d+\))+$", ""), end)


def claimed(pdf: pd.DataFrame) -> pd.DataFrame:
    """Greedy claims within a family, in the order of the claims."""
    pdf = pdf.assign(key=[(c["lamport"], c["site_id"], c["id"], f) for c, f in zip(pdf.claim, pdf.file_id, strict=True)]).sort_values("key")
    taken: set[str] = set()
    out = []
    for path in pdf.path:
        stem, end = stem_and_extension(path)
        n, got = 0, path
        while got in taken:
            n += 1
            got = f"{stem} ({n}){end}"
        taken.add(got)
        out.append(got)
    return pdf.assign(path=out)[["file_id", "path"]]


def resolve_paths(states: DataFrame) -> DataFrame:
    """Files of states(..., claim): live files that claim one path get suffixes but for the first; then directories.

    Tombstones come with a null hash. Live directories are one per path and give way to a file; deleted ones give no row.
    Families in which no path is claimed twice never leave the native plan.
    """
    states = stored(states.withColumn("path", F.coalesce("path", F.lit(""))))  # read several times below; merges run once
    files = states.filter("merge_class != 'dir'")
    gone = files.filter("deleted").withColumn("result_hash", F.lit(None).cast("string"))
    live = files.filter("not deleted").withColumn("family", family(F.col("path")))
    crowded = live.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("d")).filter("n > d").select("family")
    plain = live.join(crowded, "family", "left_anti").drop("family")
    fought = live.join(crowded, "family", "left_semi")
    won = fought.select("family", "file_id", "path", "claim").groupBy("family").applyInPandas(claimed, "file_id string, path string")
    settled = stored(plain.unionByName(fought.drop("family", "path").join(won, "file_id").select(*plain.columns)))
    first = Window.partitionBy("path").orderBy("claim", "file_id")
    dirs = states.filter("merge_class = 'dir' and not deleted").withColumn("k", F.row_number().over(first)).filter("k = 1").drop("k")
    dirs = dirs.join(settled.select("path"), "path", "left_anti").withColumn("conflict", F.lit(False)).withColumn("result_hash", F.lit(None).cast("string"))
    names = [x.split()[0] for x in FILES.split(", ")]
    return settled.select(*names).unionByName(gone.select(*names)).unionByName(dirs.select(*names))


def dir_tree(files: DataFrame) -> DataFrame:
    """dir, n_files and bytes of every directory above a file of files(path, size), and of explicit ones (is_dir)."""
    parts = F.split("path", "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    implied = files.filter("not is_dir").select(F.explode(above).alias("dir"), F.lit(1).alias("n"), "size")
    explicit = files.filter("is_dir").select(F.col("path").alias("dir"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("size"))
    return implied.unionByName(explicit).groupBy("dir").agg(F.sum("n").cast("long").alias("n_files"), F.sum("size").cast("long").alias("bytes"))

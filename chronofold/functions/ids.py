"""Content hashes, row ids and git ids as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(data: Column) -> Column:
    return F.sha2(data.cast("binary"), 256)


def long_bytes(x: Column) -> Column:
    """A 64-bit number, big-endian."""
    return F.unhex(F.lpad(F.hex(x.cast("long")), 16, "0"))


def field(x: Column) -> Column:
    """Bytes with their length before them."""
    data = x.cast("binary")
    return F.concat(long_bytes(F.octet_length(data)), data)


def merkle_id(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(f) for f in fields]), 256)


def row_id() -> Column:
    """The id of a log row: its 13 fields but id and sig, absent ones empty."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return merkle_id(
        [
            text("site_id"), long_bytes(F.col("lamport")), long_bytes(F.col("seq")), long_bytes(F.col("ts")), text("file_id"), text("kind"),
            text("merge_class"), text("parent"), text("base_hash"), text("result_hash"), text("path"), text("branch_id"), text("merge_parent"),
        ]
    )


def id_valid() -> Column:
    return row_id().eqNullSafe(F.col("id"))


def blob_valid(hash_column: str = "content_hash", data: str = "bytes") -> Column:
    return content_hash(F.col(data)).eqNullSafe(F.col(hash_column))


def branch_id_of(df: DataFrame, out: str = "branch_id") -> DataFrame:
    """Adds the id of a new branch(name, parent, fork_vv, created_lamport, site_id); the vector's entries go by site."""
    head = F.concat(field(F.col("name")), field(F.col("parent")), field(long_bytes(F.col("created_lamport"))), field(F.col("site_id")))
    entries = F.array_sort(F.map_entries("fork_vv"))
    tail = F.transform(entries, lambda e: F.hex(F.concat(field(e["key"]), field(long_bytes(e["value"])))))
    return df.withColumn(out, F.sha2(F.concat(head, F.unhex(F.array_join(tail, ""))), 256))


def tag_id_of(df: DataFrame, out: str = "tag_id") -> DataFrame:
    c = F.col
    parts = [c("name"), long_bytes(c("at_ts")), c("branch_id"), long_bytes(c("created_lamport")), c("site_id")]
    return df.withColumn(out, merkle_id(parts))


def git_blob_id(data: Column) -> Column:
    b = data.cast("binary")
    return F.sha1(F.concat(F.lit("blob ").cast("binary"), F.octet_length(b).cast("string").cast("binary"), F.lit(b"\x00"), b))


def git_trees(files: DataFrame, kept: DataFrame | None = None, changed: DataFrame | None = None) -> DataFrame:
    """dir ('' is the root) and tree_id of files(path, blob_id): directories from the deepest up, one written table per depth.

    With kept(dir, tree_id) of an earlier state and changed(path), the paths that came, changed or went since, only
    directories on the way to such a path are hashed; the ids of all others are taken over. A tree's entries go by name,
    directories as if their name ended in a slash. A directory's entries meet in one value, as its id is the hash of them all.
    """
    from chronofold.sources.tables import stored

    dir_of, name_of = F.regexp_replace("path", r"/?[^/]*$", ""), F.regexp_extract("path", r"([^/]*)$", 1)
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    leaves = files.select(dir_of.alias("dir"), name_of.alias("name"), F.lit("100644").alias("mode"), F.col("blob_id").alias("oid"))
    as_entry = lambda df: df.filter("dir != ''").select(F.col("dir").alias("path"), F.lit("40000").alias("mode"), F.col("tree_id").alias("oid")).select(dir_of.alias("dir"), name_of.alias("name"), "mode", "oid")
    on_way = None
    if kept is not None and changed is not None:
        steps = F.split("path", "/")
        above = F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
        on_way = stored(changed.select(F.explode(above).alias("dir")).distinct())
        kept = stored(kept.join(on_way, "dir", "left_anti").select("dir", "tree_id"))
        leaves = leaves.unionByName(as_entry(kept)).join(on_way, "dir", "left_semi")
    leaves = stored(leaves.withColumn("depth", depth))
    levels, below = [], None
    for level in range(leaves.agg(F.max("depth")).first()[0] or 0, -1, -1):
        here = leaves.filter(F.col("depth") == level).drop("depth")
        here = here if below is None else here.unionByName(as_entry(below))
        line = F.hex(F.concat(F.concat_ws(" ", "mode", "name").cast("binary"), F.lit(b"\x00"), F.unhex("oid")))
        sort_name = F.when(F.col("mode") == "40000", F.concat("name", F.lit("/"))).otherwise(F.col("name"))
        body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(sort_name.alias("n"), line.alias("l")))), lambda e: e["l"]), "")
        trees = here.groupBy("dir").agg(F.unhex(body).alias("body"))
        below = stored(trees.select("dir", git_object_id("tree", F.col("body")).alias("tree_id")))
        levels.append(below)
    return reduce(DataFrame.unionByName, levels if on_way is None else [*levels, kept])


def git_object_id(kind: str, body: Column) -> Column:
    header = F.concat(F.lit(f"{kind} ").cast("binary"), F.octet_length(body).cast("string").cast("binary"), F.lit(b"\x00"))
    return F.sha1(F.concat(header, body))


def git_commit_id(tree_id: Column, when: Column, identity: str, message: str) -> Column:
    """The id of a commit without parents of a tree at a time in unix seconds; identity is `name <mail>`."""
    who = F.concat(F.lit(f"{identity} "), when.cast("string"), F.lit(" +0000\n"))
    body = F.concat(F.lit("tree "), tree_id, F.lit("\nauthor "), who, F.lit("committer "), who, F.lit(f"\n{message}"))
    return git_object_id("commit", body.cast("binary"))

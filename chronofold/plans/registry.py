"""The registered queries of the change-log operators. Each reads the given tables, or logs that Spark derives from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.functions import ids, text
from chronofold.operators import branches as br
from chronofold.operators import capture, fold, merge, misc, paths, sync
from chronofold.operators import timetravel as tt
from chronofold.sources import fixtures as fx
from chronofold.sources import log as src
from chronofold.sources.tables import new_folder, stored, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Times that the time-travel queries ask for, as shares of the log's lamport range.
RULES = "*.log\nbuild/\n!build/keep\n/page/1*\ndocs/**/x?\n"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def at(spark: SparkSession, sf: str, share: float = 0.5) -> int:
    """A point in time of the events table: this share of its span, in unix seconds."""
    low, high = table(spark, sf, "events").agg(F.min(F.unix_seconds(F.col("ts").cast("timestamp"))), F.max(F.unix_seconds(F.col("ts").cast("timestamp")))).first()
    return int(low + (high - low) * share)


def probe(df: DataFrame, k: int, of: int) -> DataFrame:
    """The side of a replica that holds all but every of-th row: a fixture of two differing tables, not a cut of the input."""
    return df.filter(F.col("lamport") % of != k)


def paths_of(spark: SparkSession, sf: str) -> DataFrame:
    """Paths as the pages table has them: host/language/number."""
    return table(spark, sf, "pages").select("page_id", F.regexp_replace(F.regexp_extract("url", r"//([^?#]+)", 1), r"^(www|m|blog)\.", "build/").alias("path"), F.length("html").cast("long").alias("size"))


def listings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two states of a tree from the documents: some edited, some moved, some gone, some new."""
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"), F.octet_length("text").cast("long").alias("size"), "source")
    path = F.concat("source", F.lit("/d"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 9 == 0, ".log").otherwise(".md"))
    old = docs.filter("doc_id % 7 != 0").select(path.alias("path"), F.col("h").alias("content_hash"), "size")
    moved = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("moved/"), path)).otherwise(path)
    edited = F.when(F.col("doc_id") % 6 == 1, F.sha2(F.concat("h", F.lit("x")), 256)).otherwise(F.col("h"))
    new = docs.filter("doc_id % 11 != 0").select(moved.alias("path"), edited.alias("content_hash"), "size")
    return old, new


# --- sources, sinks, ingest -----------------------------------------------------------------------------------------


@query
def a01_scan_tree(spark: SparkSession, sf: str) -> DataFrame:
    root = new_folder(spark)
    docs = table(spark, sf, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    docs.write.partitionBy("lang").text(root)
    found = src.scan_tree(spark, root, "lang=de/\n")
    return found.groupBy(F.regexp_extract("path", "^([^/]*)/", 1).alias("dir")).agg(F.sum("size").alias("bytes"))


@query
def a02_changed_files(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.col("doc_id").alias("mtime"), F.octet_length("text").cast("long").alias("size"), F.col("text").alias("bytes"), "doc_id"
    )
    known = docs.filter("doc_id % 3 != 0").select("path", F.when(F.col("doc_id") % 4 == 0, F.col("mtime") - 1).otherwise(F.col("mtime")).alias("mtime"), "size", F.sha2("bytes", 256).alias("content_hash"))
    return src.changed_files(docs.filter("doc_id % 5 != 0"), known)


@query
def a03_read_log(spark: SparkSession, sf: str) -> DataFrame:
    root = new_folder(spark)
    src.write_log(fx.log(spark, sf).drop("branch_id"), root)
    return src.read_log(spark, root).drop("is_meta").orderBy("lamport", "site_id", "id").select("id", "file_id", "lamport", "kind", "branch_id", "merge_parent")


@query
def a04_rows_for_files(spark: SparkSession, sf: str) -> DataFrame:
    wanted = fx.log(spark, sf).filter("kind = 'delete'").select("file_id")
    return src.rows_for_files(fx.log(spark, sf), wanted).select("id", "file_id", "kind")


@query
def a05_meta_rows(spark: SparkSession, sf: str) -> DataFrame:
    return src.meta_rows(fx.meta(spark, sf), "tag").select("id", "file_id")


@query
def a06_append_log(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.log(spark, sf)
    return src.new_rows(probe(log, 1, 3), log.unionByName(log)).select("id")


@query
def a07_integrate(spark: SparkSession, sf: str) -> DataFrame:
    log = stored(sealed(spark, sf))
    twice = log.withColumn("position", F.col("lamport")).unionByName(log.filter("lamport % 4 = 0").withColumn("position", F.col("lamport") + 10_000_000))
    blobs = fx.blobs(spark, sf).select("content_hash", F.col("text").cast("binary").alias("bytes"))
    return src.integrate(probe(log, 1, 3), twice, blobs).select("id", "position", "is_new")


@query
def a08_put_blobs(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("text").cast("binary").alias("bytes"), "doc_id")
    held = docs.filter("doc_id % 2 = 0").select(F.sha2("bytes", 256).alias("content_hash"))
    return src.put_blobs(held, docs).select("content_hash")


@query
def a09_get_blobs(spark: SparkSession, sf: str) -> DataFrame:
    wanted = fx.log(spark, sf).filter("kind = 'create'").select(F.col("result_hash").alias("content_hash"))
    return src.get_blobs(fx.blobs(spark, sf), wanted)


def files_like(log: DataFrame, blobs: DataFrame) -> DataFrame:
    return fold.states(log, blobs).select("file_id", "path", "result_hash", "deleted")


@query
def a10_sync_files(spark: SparkSession, sf: str) -> DataFrame:
    log, blobs = fx.log(spark, sf), fx.blobs(spark, sf)
    return src.sync_files(files_like(log, blobs), files_like(tt.as_of_filter(log, at(spark, sf)), blobs))


@query
def a10_upsert_files(spark: SparkSession, sf: str) -> DataFrame:
    log, blobs, root = fx.log(spark, sf), fx.blobs(spark, sf), new_folder(spark)
    old, new = (stored(files_like(x, blobs)) for x in (tt.as_of_filter(log, at(spark, sf)), log))
    src.write_files(old, root)
    actions = stored(src.sync_files(new, old))
    src.upsert_files(new.join(actions.filter("action != 'delete'"), "file_id", "left_semi"), actions.filter("action = 'delete'"), root)
    return src.read_files(spark, root, "file_id string, path string, result_hash string, deleted boolean")


@query
def a11_replace_files(spark: SparkSession, sf: str) -> DataFrame:
    return src.replace_files(files_like(fx.log(spark, sf), fx.blobs(spark, sf)), new_folder(spark))


@query
def a12_export_state(spark: SparkSession, sf: str) -> DataFrame:
    return src.export_state(fx.log(spark, sf), fx.blobs(spark, sf))[1]


@query
def a13_import_state(spark: SparkSession, sf: str) -> DataFrame:
    log = stored(sealed(spark, sf))
    blobs = fx.blobs(spark, sf).select("content_hash", F.col("text").cast("binary").alias("bytes"))
    return src.import_state(probe(log, 0, 4), "v", log, "v", blobs).agg(F.count(F.lit(1)).alias("new_rows"))


@query
def a14_bundle_wire(spark: SparkSession, sf: str) -> DataFrame:
    blobs = fx.blobs(spark, sf).select("content_hash", F.col("text").cast("binary").alias("bytes"))
    return src.bundle_wire(fx.log(spark, sf), blobs).select("id", F.size("blobs").cast("long").alias("n_blobs"))


@query
def a15_dedup_shipped_blobs(spark: SparkSession, sf: str) -> DataFrame:
    return src.shipped_once(fx.log(spark, sf))


@query
def a16_decode_records(spark: SparkSession, sf: str) -> DataFrame:
    return src.decode_records(fx.meta(spark, sf), "branch").select("id", "rec.branch_id", "rec.name", "rec.parent", "rec.created_lamport", "rec.deleted")


@query
def a17_load_old_log(spark: SparkSession, sf: str) -> DataFrame:
    old = fx.log(spark, sf).withColumn("branch_id", F.when(F.col("branch_id") != "main", F.col("branch_id")))
    return src.load_old_log(old).select("id", "branch_id", "merge_parent")


# --- functions ---------------------------------------------------------------------------------------------------------


@query
def b01_classify(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    path = F.concat(F.lit("p/"), F.col("doc_id").cast("string"), F.element_at(F.array(*[F.lit(x) for x in (".py", ".MD", "", ".tar.Gz", ".Json")]), (F.col("doc_id") % 5 + 1).cast("int")))
    data = F.when(F.col("doc_id") % 4 == 0, F.concat(F.col("text").cast("binary"), F.lit(b"\x00"))).otherwise(F.col("text").cast("binary"))
    return docs.select("doc_id", text.classify(path, data).alias("merge_class"))


@query
def b02_in_scope(spark: SparkSession, sf: str) -> DataFrame:
    rows = paths_of(spark, sf)
    return rows.select("page_id", "path", (~text.ignored(F.col("path"), RULES)).alias("in_scope"))


@query
def b03_live_files(spark: SparkSession, sf: str) -> DataFrame:
    return files_like(fx.log(spark, sf), fx.blobs(spark, sf)).filter("not deleted").select("file_id", "path").orderBy("path")


@query
def b04_live_file_by_path(spark: SparkSession, sf: str) -> DataFrame:
    files = files_like(fx.log(spark, sf), fx.blobs(spark, sf)).filter("not deleted")
    wanted = fx.log(spark, sf).filter("kind = 'rename'").select("path").distinct()
    return files.join(wanted, "path", "left_semi").select("path", "file_id")


@query
def b05_content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", ids.content_hash(F.col("text")).alias("content_hash"))


def sealed(spark: SparkSession, sf: str) -> DataFrame:
    return src.load_old_log(fx.log(spark, sf)).withColumn("id", ids.row_id())


@query
def b06_merkle_id(spark: SparkSession, sf: str) -> DataFrame:
    return sealed(spark, sf).select("lamport", "id")


@query
def b07_id_valid(spark: SparkSession, sf: str) -> DataFrame:
    rows = sealed(spark, sf).withColumn("path", F.when(F.col("lamport") % 50 == 0, F.lit("forged")).otherwise(F.col("path")))
    return rows.select("lamport", ids.id_valid().alias("valid"))


@query
def b08_blob_valid(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.blobs(spark, sf).withColumn("bytes", F.when(F.length("text") % 2 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return rows.select("content_hash", ids.blob_valid().alias("valid"))


@query
def b09_record_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = src.decode_records(fx.meta(spark, sf), "tag").select("id", "site_id", "lamport", "rec.name", "rec.at_ts", "rec.branch_id")
    return ids.tag_id_of(rows.withColumn("created_lamport", F.col("lamport"))).select("id", "tag_id")


@query
def b11_as_of_filter(spark: SparkSession, sf: str) -> DataFrame:
    return tt.as_of_filter(fx.log(spark, sf), at(spark, sf)).select("id")


@query
def b17_access_audit(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key_id"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey") * 1_000_000).cast("long").alias("expires_at"), (F.col("c_custkey") % 5 == 0).alias("never")
    )
    return misc.access_audit(keys, now=500_000_000)


@query
def b18_counts(spark: SparkSession, sf: str) -> DataFrame:
    body = F.when(F.col("doc_id") % 50 == 0, "\n\n").otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", text.word_count(body).alias("words"), text.line_count(body).alias("lines"))


@query
def b19_has_frontmatter(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    body = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("---\r\ntitle: x\r\n --- \r\n"), F.col("text"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("---\n"), F.col("text"))).otherwise(F.col("text"))
    return docs.select("doc_id", text.has_frontmatter(body).alias("has_frontmatter"))


@query
def b20_markdown_links(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", F.concat(F.lit("see [one]("), F.col("url"), F.lit(") and ![img](a/b.png) or [![x](i.png)](t"), F.col("page_id").cast("string"), F.lit(") end")).alias("text"))
    return text.markdown_links(pages, "page_id").select("page_id", F.col("place").cast("long").alias("place"), "target")


@query
def b21_lang_of(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("p."), F.element_at(F.array(*[F.lit(x) for x in ("py", "TSX", "zzz", "bash", "scss", "")]), (F.col("page_id") % 6 + 1).cast("int")))
    return table(spark, sf, "pages").select("page_id", text.lang_of(path).alias("lang"))


@query
def b23_git_blob_oid(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", ids.git_blob_id(F.col("text")).alias("oid"))


# --- joins, aggregates, windows -------------------------------------------------------------------------------------------


@query
def c01_missing_rows(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.log(spark, sf)
    peer = sync.version_vector(log.filter("site_id != 's4'")).withColumn("seq", F.expr("seq div 2"))
    return sync.missing_rows(log, peer).select("id", "site_id", "seq")


@query
def c02_page_after(spark: SparkSession, sf: str) -> DataFrame:
    return sync.page_after(fx.log(spark, sf), "s2", 100, 256).select("id", "seq")


@query
def c03_visible_rows(spark: SparkSession, sf: str) -> DataFrame:
    return br.visible_rows(fx.log(spark, sf), fx.branches(spark)).select("target", "id")


@query
def c04_parent_of(spark: SparkSession, sf: str) -> DataFrame:
    return sync.parent_of(fx.log(spark, sf)).select("id", "parent")


@query
def c04_cross_file_parents(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.log(spark, sf).withColumn("parent", F.when(F.col("lamport") % 500 == 0, F.lit("r0")).otherwise(F.col("parent")))
    return sync.parent_of(log, same_file=False).filter("cross_file").select("id", "parent_file")


@query
def c05_infer_renames(spark: SparkSession, sf: str) -> DataFrame:
    return capture.infer_renames(*listings(spark, sf))


@query
def c06_content_of(spark: SparkSession, sf: str) -> DataFrame:
    files = files_like(fx.linear_log(spark, sf), fx.blobs(spark, sf)).filter("not deleted")
    return files.join(fx.blobs(spark, sf), F.col("result_hash") == F.col("content_hash")).select("file_id", "text")


@query
def c07_tag_lane(spark: SparkSession, sf: str) -> DataFrame:
    tags = sync.reconciled(src.decode_records(fx.meta(spark, sf), "tag"), "tag")
    return br.tag_lane(tags, fx.branches(spark)).select("tag_id", "branch_id", F.col("lane").cast("long").alias("lane"))


@query
def c08_fork_edge(spark: SparkSession, sf: str) -> DataFrame:
    nodes = br.graph(fx.log(spark, sf), fx.branches(spark), cap=100_000)
    first = nodes.groupBy("branch_id").agg(F.min_by("parents", F.struct("lamport", "commit_id")).alias("parents"))
    return first.filter("branch_id != 'main'").select("branch_id", F.col("parents")[0].alias("fork_commit"))


@query
def c09_file_at(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.log(spark, sf).withColumn("path", F.when(F.col("path").isNotNull(), F.concat("file_id", F.lit("/"), "path")))
    times = F.explode(F.array(*[F.lit(at(spark, sf, share)) for share in (0.3, 0.6, 0.9)])).alias("t")
    return tt.versions_at(log, log.filter("path is not null").select("path", times), fx.blobs(spark, sf))


@query
def c10_unreferenced(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.log(spark, sf)
    live = fold.states(log, fx.blobs(spark, sf)).filter("not deleted").select(F.col("result_hash").alias("content_hash"))
    return fx.blobs(spark, sf).join(live, "content_hash", "left_anti").select("content_hash")


@query
def d01_version_vector(spark: SparkSession, sf: str) -> DataFrame:
    return sync.version_vector(fx.log(spark, sf))


@query
def d02_visible_version_vector(spark: SparkSession, sf: str) -> DataFrame:
    return br.visible_version_vector(fx.log(spark, sf), fx.branches(spark), "b2")


@query
def d03_status(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.log(spark, sf)
    return sync.status(log, fold.states(log, fx.blobs(spark, sf)))


@query
def d04_next_counters(spark: SparkSession, sf: str) -> DataFrame:
    return sync.next_counters(fx.log(spark, sf))


@query
def d05_reconcile_branches(spark: SparkSession, sf: str) -> DataFrame:
    rows = sync.reconciled(src.decode_records(fx.meta(spark, sf), "branch"), "branch")
    return rows.select("branch_id", "name", "parent", "created_lamport", "deleted")


@query
def d06_reconcile_tags(spark: SparkSession, sf: str) -> DataFrame:
    return sync.reconciled(src.decode_records(fx.meta(spark, sf), "tag"), "tag").select("tag_id", "name", "at_ts", "branch_id")


@query
def d07_live_branches(spark: SparkSession, sf: str) -> DataFrame:
    rows = sync.reconciled(src.decode_records(fx.meta(spark, sf), "branch"), "branch")
    return br.live_records(rows).select("branch_id", "name")


@query
def d08_tip(spark: SparkSession, sf: str) -> DataFrame:
    return sync.tip(br.visible_rows(fx.log(spark, sf), fx.branches(spark), "b1"))


@query
def d09_latest_record(spark: SparkSession, sf: str) -> DataFrame:
    return src.meta_rows(fx.meta(spark, sf)).groupBy("file_id", "kind").agg(F.max_by("id", fold.key_of()).alias("id"))


@query
def d10_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return sync.first_seen(fx.log(spark, sf))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(i, b, at(spark, sf, s)) for i, (b, s) in enumerate([("main", 0.2), ("b1", 0.5), ("b2", 0.8), ("b1", 1.0)])]
    return spark.createDataFrame(rows, "request long, branch_id string, t long")


@query
def d11_tag_points(spark: SparkSession, sf: str) -> DataFrame:
    return br.tag_points(fx.log(spark, sf), fx.branches(spark), requests(spark, sf))


@query
def d12_dir_tree(spark: SparkSession, sf: str) -> DataFrame:
    return paths.dir_tree(paths_of(spark, sf).select("path", "size", F.lit(False).alias("is_dir")))


@query
def d13_tree_hash(spark: SparkSession, sf: str) -> DataFrame:
    return tt.tree_hash(main_at(spark, sf))


def page_files(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as files: one directory per host."""
    pages = table(spark, sf, "pages")
    return pages.select(F.concat(F.regexp_extract("url", r"//([^/?#]+)", 1), F.lit("/p"), F.col("page_id").cast("string")).alias("path"), ids.git_blob_id(F.col("html")).alias("blob_id"), "page_id")


@query
def d14_git_tree(spark: SparkSession, sf: str) -> DataFrame:
    return ids.git_trees(page_files(spark, sf))


@query
def d14_git_tree_again(spark: SparkSession, sf: str) -> DataFrame:
    new = stored(page_files(spark, sf))
    changed = F.when(F.col("page_id") % 40 == 0, ids.git_blob_id(F.lit("before"))).otherwise(F.col("blob_id"))
    old = new.filter("page_id % 50 != 0").withColumn("blob_id", changed)
    paths_of_change = new.filter("page_id % 40 = 0 or page_id % 50 = 0").select("path")
    return ids.git_trees(new, ids.git_trees(old), paths_of_change)


@query
def d14_git_commit(spark: SparkSession, sf: str) -> DataFrame:
    root = ids.git_trees(page_files(spark, sf)).filter("dir = ''")
    return root.select("tree_id", ids.git_commit_id(F.col("tree_id"), F.lit(1_700_000_000), "store <store@example.org>", "derived snapshot\n").alias("commit_id"))


@query
def d15_content_groups(spark: SparkSession, sf: str) -> DataFrame:
    return sync.content_groups(fx.log(spark, sf), fx.blobs(spark, sf))


@query
def d16_kind_counts(spark: SparkSession, sf: str) -> DataFrame:
    return sync.kind_counts(fx.log(spark, sf))


@query
def e01_history(spark: SparkSession, sf: str) -> DataFrame:
    return sync.history(fx.log(spark, sf)).select("id", "file_id", "kind", "path")


@query
def e02_settle_commits(spark: SparkSession, sf: str) -> DataFrame:
    return br.settle_commits(fx.log(spark, sf)).select("branch_id", "commit_id", "lamport", "n", "label")


@query
def e04_cap_per_lane(spark: SparkSession, sf: str) -> DataFrame:
    return br.graph(fx.log(spark, sf), fx.branches(spark), cap=50).select("branch_id", "commit_id")


@query
def e05_chain_parents(spark: SparkSession, sf: str) -> DataFrame:
    return br.graph(fx.log(spark, sf), fx.branches(spark), cap=50).filter("branch_id = 'main'").select("commit_id", F.get("parents", F.lit(0)).alias("parent"))


@query
def e06_lanes(spark: SparkSession, sf: str) -> DataFrame:
    rows = sync.reconciled(src.decode_records(fx.meta(spark, sf), "branch"), "branch")
    return br.lanes(rows).select("branch_id", F.col("lane").cast("long").alias("lane"))


@query
def e07_assign_counters(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id")
    return sync.assign_counters(rows, ["doc_id"], 1000)


@query
def e08_seq_gaps(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.log(spark, sf)
    return sync.seq_gaps(log.filter("lamport % 97 != 0").unionByName(log.filter("lamport % 500 = 1")))


@query
def e09_fork_edges(spark: SparkSession, sf: str) -> DataFrame:
    first = fx.log(spark, sf).groupBy("branch_id").agg(F.min("ts").alias("first_ts"))
    return br.lanes(fx.branches(spark)).join(first, "branch_id").select("branch_id", F.col("lane").cast("long").alias("lane"), "first_ts")


@query
def f01_sort_by_order_key(spark: SparkSession, sf: str) -> DataFrame:
    return fx.log(spark, sf).orderBy("lamport", "site_id", "id").select("id", "lamport")


@query
def f02_newest(spark: SparkSession, sf: str) -> DataFrame:
    return fx.log(spark, sf).orderBy(F.desc("lamport"), F.desc("site_id"), F.desc("id")).limit(200).select("id", "ts")


@query
def f04_union_logs(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.log(spark, sf)
    return probe(log, 0, 3).unionByName(probe(log, 1, 3)).dropDuplicates(["id"]).select("id")


@query
def f05_diff_states(spark: SparkSession, sf: str) -> DataFrame:
    old, new = listings(spark, sf)
    return tt.diff_states(old.withColumnRenamed("content_hash", "result_hash"), new.withColumnRenamed("content_hash", "result_hash")).select("path", "action")


@query
def f06_capture_diff(spark: SparkSession, sf: str) -> DataFrame:
    old, new = listings(spark, sf)
    return capture.capture_diff(old.filter("path not like '%.log'"), new, "*.log\n")


@query
def f07_dir_entities(spark: SparkSession, sf: str) -> DataFrame:
    old, new = listings(spark, sf)
    tracked = capture.parents_of(old)
    empty = capture.parents_of(old.join(new.select("path"), "path", "left_anti")).withColumn("path", F.concat("path", F.lit("/empty")))
    return capture.dir_entities(empty, tracked, new, old.join(new.select("path"), "path", "left_anti"))


@query
def f08_missing_deletes(spark: SparkSession, sf: str) -> DataFrame:
    old, new = listings(spark, sf)
    return capture.missing_deletes(old, new, warm=True, rules="*.log\n")


@query
def f09_author_rows(spark: SparkSession, sf: str) -> DataFrame:
    seen = stored(br.visible_rows(fx.log(spark, sf), fx.branches(spark), "main").drop("target"))
    now, then = main_at(spark, sf, 1.0), main_at(spark, sf)
    changes = now.select("file_id", "path", F.col("result_hash").alias("have")).join(then.select("file_id", F.col("result_hash").alias("want")), "file_id")
    rows = tt.author_rows(seen, changes.withColumn("action", F.lit("edit")), "s9", 0, 0, 1_000_000_000)
    return rows.withColumn("valid", ids.id_valid()).select("file_id", "kind", "seq", "parent", "base_hash", "result_hash", "valid")


# --- fold, merge, paths ------------------------------------------------------------------------------------------------------


@query
def g01_fold_order(spark: SparkSession, sf: str) -> DataFrame:
    return fold.fold_order(fx.log(spark, sf))


@query
def g02_fold_linear(spark: SparkSession, sf: str) -> DataFrame:
    return fold.fold_linear(fx.log(spark, sf)).drop("claim")


@query
def g03_needs_merge(spark: SparkSession, sf: str) -> DataFrame:
    return fold.needs_merge(fx.log(spark, sf))


@query
def g04_fold_merge(spark: SparkSession, sf: str) -> DataFrame:
    return fold.fold_merge(fx.log(spark, sf), fx.blobs(spark, sf)).drop("claim")


@query
def g05_merge3(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    same = F.col("doc_id") % 4
    ours = F.when(same == 0, F.concat(F.lit("ours\n"), F.col("text"))).otherwise(F.col("text"))
    theirs = F.when(same == 1, F.concat(F.col("text"), F.lit("\ntheirs"))).when(same == 2, F.col("text")).otherwise(F.lit("new\n"))
    kind = F.when(F.col("doc_id") % 3 == 0, "code").otherwise("text")
    # One side at most differs from the base unless the document is of the fourth kind.
    theirs = F.when(same == 0, F.col("text")).otherwise(theirs)
    return merge.merge3(docs.select(F.col("doc_id").alias("key"), kind.alias("merge_class"), F.col("text").alias("base"), ours.alias("ours"), theirs.alias("theirs"))).select(
        F.col("key").alias("doc_id"), F.sha2("merged", 256).alias("merged_hash"), "conflict"
    )


@query
def g05_merge3_hunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = F.concat(F.lit("h1\nh2\nh3\n"), F.col("text"), F.lit("\nt1\nt2\nt3\n"))
    ours, theirs = F.regexp_replace(base, "^h1\nh2", "h1\nours"), F.regexp_replace(base, "t2\nt3\n$", "theirs\nt3\n")
    rows = docs.select(F.col("doc_id").alias("key"), F.lit("code").alias("merge_class"), base.alias("base"), ours.alias("ours"), theirs.alias("theirs"))
    return merge.merge3(rows).select(F.col("key").alias("doc_id"), F.sha2("merged", 256).alias("merged_hash"), "conflict")


@query
def g06_resolve_paths(spark: SparkSession, sf: str) -> DataFrame:
    return paths.resolve_paths(fold.states(fx.log(spark, sf), fx.blobs(spark, sf))).select("file_id", "path", "deleted", "result_hash")


@query
def g07_current_files(spark: SparkSession, sf: str) -> DataFrame:
    return paths.resolve_paths(fold.states(fx.log(spark, sf), fx.blobs(spark, sf)))


@query
def g07_current_files_linear(spark: SparkSession, sf: str) -> DataFrame:
    return paths.resolve_paths(fold.states(fx.linear_log(spark, sf), fx.blobs(spark, sf))).filter("not deleted").select("file_id", "path", "result_hash", "lamport")


@query
def g08_refold(spark: SparkSession, sf: str) -> DataFrame:
    log, blobs = fx.log(spark, sf), fx.blobs(spark, sf)
    t = at(spark, sf, 0.9)
    held = fold.states(tt.as_of_filter(log, t), blobs)
    return fold.refold(held, log, log.filter(F.col("ts") > t), blobs).select("file_id", "path", "result_hash", "deleted", "lamport", "conflict")


@query
def g08_refold_paths(spark: SparkSession, sf: str) -> DataFrame:
    log, blobs = fx.log(spark, sf), fx.blobs(spark, sf)
    t = at(spark, sf, 0.9)
    held = stored(fold.states(tt.as_of_filter(log, t), blobs))
    return fold.refold_files(held, stored(paths.resolve_paths(held)), log, log.filter(F.col("ts") > t), blobs)[1]


@query
def g09_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return fold.states(fx.log(spark, sf), fx.blobs(spark, sf)).filter("conflict").select("file_id", "path")


@query
def g10_line_diff(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("before"))
    after = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("top\n"), F.col("before"))).when(F.col("doc_id") % 3 == 1, F.concat(F.col("before"), F.lit("\nend"))).otherwise(F.col("before"))
    rows = merge.line_diff(docs.withColumn("after", after))
    return rows.select("doc_id", F.col("line").cast("long").alias("line"), F.array_join("removed", "|").alias("removed"), F.array_join("added", "|").alias("added"), F.array_join("context", "|").alias("context"))


# --- branches, time travel -----------------------------------------------------------------------------------------------------


@query
def h01_ancestry(spark: SparkSession, sf: str) -> DataFrame:
    rows = sync.reconciled(src.decode_records(fx.meta(spark, sf), "branch"), "branch")
    return br.ancestry(rows).select("target", F.col("depth").cast("long").alias("depth"), "branch_id")


@query
def h02_visibility_caps(spark: SparkSession, sf: str) -> DataFrame:
    return br.visibility_caps(sync.reconciled(src.decode_records(fx.meta(spark, sf), "branch"), "branch"))


@query
def h04_branch_files(spark: SparkSession, sf: str) -> DataFrame:
    return br.branch_files(fx.log(spark, sf), fx.branches(spark), "b1", fx.blobs(spark, sf)).select("file_id", "path", "result_hash", "deleted", "lamport", "conflict")


@query
def h05_fork_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return br.fork_vectors(fx.log(spark, sf), fx.branches(spark), requests(spark, sf))


@query
def h06_nearest_live_ancestor(spark: SparkSession, sf: str) -> DataFrame:
    return br.nearest_live_ancestor(sync.reconciled(src.decode_records(fx.meta(spark, sf), "branch"), "branch"))


@query
def h08_graph(spark: SparkSession, sf: str) -> DataFrame:
    return br.graph(fx.log(spark, sf), fx.branches(spark)).select("commit_id", "branch_id", F.col("lane").cast("long").alias("lane"), "label", F.get("parents", F.lit(0)).alias("parent"))


@query
def h09_compare_branches(spark: SparkSession, sf: str) -> DataFrame:
    return br.compare_branches(stored(fx.log(spark, sf)), fx.branches(spark), "main", "b1", fx.blobs(spark, sf))


def main_at(spark: SparkSession, sf: str, share: float = 0.5) -> DataFrame:
    """The live files of the main branch at a share of the log's span."""
    return tt.state_as_of(fx.log(spark, sf), at(spark, sf, share), fx.blobs(spark, sf), fx.branches(spark))


@query
def t01_state_as_of(spark: SparkSession, sf: str) -> DataFrame:
    return main_at(spark, sf)


@query
def t02_file_at_missing(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.log(spark, sf)
    wanted = log.filter("path is not null").select("path")
    return tt.file_at(log, wanted, at(spark, sf), fx.blobs(spark, sf), fx.branches(spark))


@query
def t03_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return tt.snapshot(fx.log(spark, sf), "half", at(spark, sf), fx.blobs(spark, sf), fx.branches(spark), "b1")


@query
def t04_snapshot_by_label(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.log(spark, sf).filter("kind = 'rename'").select(F.col("id").alias("snapshot_id"), F.concat(F.lit("l"), (F.col("lamport") % 7).cast("string")).alias("label"), F.col("lamport").alias("created_lamport"))
    return tt.snapshot_by_label(rows)


@query
def t05_restore(spark: SparkSession, sf: str) -> DataFrame:
    log, blobs, branches = stored(fx.log(spark, sf)), fx.blobs(spark, sf), fx.branches(spark)
    rows = tt.restore(log, main_at(spark, sf), blobs, branches, "s9", 0, 0, 1_000_000_000)
    return rows.withColumn("valid", ids.id_valid()).select("kind", "seq", "lamport", "parent", "base_hash", "result_hash", "path", "valid")


@query
def t06_restore_files_at(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.log(spark, sf)
    asked = log.filter("kind = 'rename'").select("path", F.when(F.length("path") % 2 == 0, at(spark, sf, 0.4)).otherwise(at(spark, sf, 0.7)).alias("t"))
    rows = tt.restore_files_at(log, asked, fx.blobs(spark, sf), fx.branches(spark), "s9", 0, 0, 1_000_000_000)
    return rows.withColumn("valid", ids.id_valid()).select("kind", "seq", "lamport", "parent", "base_hash", "result_hash", "path", "valid")


@query
def t07_file_versions(spark: SparkSession, sf: str) -> DataFrame:
    return tt.file_versions(fx.log(spark, sf), fx.blobs(spark, sf))


@query
def t08_state_at_tags(spark: SparkSession, sf: str) -> DataFrame:
    tags = br.live_records(sync.reconciled(src.decode_records(fx.meta(spark, sf), "tag"), "tag"))
    return tt.state_at_tags(fx.log(spark, sf), tags, fx.blobs(spark, sf), fx.branches(spark))


@query
def t09_activity(spark: SparkSession, sf: str) -> DataFrame:
    return tt.activity(fx.log(spark, sf))


@query
def t10_diff_versions(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.log(spark, sf)
    asked = log.filter("path is not null").select("path").distinct()
    side = lambda share, n: tt.file_at(log, asked, at(spark, sf, share), fx.blobs(spark, sf), fx.branches(spark)).filter("found").select("path", F.col("content").alias(n))
    rows = merge.line_diff(side(0.3, "before").join(side(0.9, "after"), "path"))
    return rows.filter("line > 0").select("path", F.col("line").cast("long").alias("line"), F.array_join("removed", "|").alias("removed"), F.array_join("added", "|").alias("added"))


# --- vectors and declared work ----------------------------------------------------------------------------------------------------


@query
def v01_put_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("content_hash"), F.lit("m1").alias("model_id"), F.col("embedding").alias("vector"))
    new = rows.filter("content_hash like '%3'").withColumn("vector", F.transform("vector", lambda x: x * 2))
    return misc.put_embeddings(rows, new).select("content_hash", F.round(F.get("vector", F.lit(0)).cast("double"), 5).alias("first"))


@query
def v02_search(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = misc.search(rows, rows.filter("id % 50 = 0").withColumnRenamed("id", "query"), 5)
    return found.select("query", F.col("rank").cast("long").alias("rank"), "id")


@query
def v03_merge_branches(spark: SparkSession, sf: str) -> DataFrame:
    done = br.merge_branches(stored(fx.log(spark, sf)), fx.branches(spark), "b1", "main", fx.blobs(spark, sf))
    return done.select("file_id", "action", "path", "merge_class", "have", "want", "conflict")


@query
def v04_refold_with_tiebreak(spark: SparkSession, sf: str) -> DataFrame:
    late = fx.log(spark, sf).withColumn("ts", F.when(F.col("lamport") % 9 == 0, F.col("ts") - 1_000_000).otherwise(F.col("ts")))
    return tt.refold_with_tiebreak(late, fx.blobs(spark, sf))


@query
def v05_first_divergence(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.log(spark, sf)
    return tt.first_divergence(probe(log, 0, 40), probe(log, 1, 40))


@query
def v06_blob_gc(spark: SparkSession, sf: str) -> DataFrame:
    return tt.blob_gc(fx.blobs(spark, sf), fx.log(spark, sf), at(spark, sf, 0.7), main_at(spark, sf).withColumn("label", F.lit("half")))


@query
def v07_dedup_branch_names(spark: SparkSession, sf: str) -> DataFrame:
    return br.dedup_branch_names(sync.reconciled(src.decode_records(fx.meta(spark, sf), "branch"), "branch"))

"""Past states, snapshots, diffs of states, and what to author to get from one to another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold.functions.ids import row_id
from chronofold.operators.branches import merge_base, merge_branches, visible_rows
from chronofold.operators.fold import folded, key_of, ordered, states, versions, with_made
from chronofold.operators.paths import resolve_paths
from chronofold.operators.sync import assign_counters, version_vector
from chronofold.sources.schemas import MAIN, META_KINDS, NO_FILE_KINDS
from chronofold.sources.tables import stored


def as_of_filter(log: DataFrame, t: int) -> DataFrame:
    return log.filter(F.col("ts") <= t)


def live_contents(log: DataFrame, blobs: DataFrame) -> DataFrame:
    """file_id, path and result_hash of the log's live files that have contents, merges and path claims settled."""
    files = resolve_paths(states(log, blobs))
    return files.filter("not deleted and merge_class != 'dir' and result_hash is not null").select("file_id", "path", "result_hash")


def state_as_of(log: DataFrame, t: int, blobs: DataFrame, branches: DataFrame, branch: str = MAIN) -> DataFrame:
    """Live content files of what a branch sees of the log up to t."""
    return live_contents(as_of_filter(visible_rows(log, branches, branch).drop("target"), t), blobs)


def file_versions(log: DataFrame, blobs: DataFrame) -> DataFrame:
    """Versions of each file's state through all its lives: content and path from valid_from on, until valid_to (null: now).

    A file that is created again has a version for the time it was gone; merges made on the way are versions too. Exact
    where a file's ts never decrease in fold order; state_as_of() stays the definition.
    """
    return spans(versions(log, blobs)[0])


def spans(rows: DataFrame, fields: tuple[str, ...] = ("result_hash", "path", "deleted")) -> DataFrame:
    """The versions of fold.versions() rows: what changes none of the fields begins none."""
    w = Window.partitionBy("file_id").orderBy("rn")
    rows = rows.withColumn("same", F.lag(F.struct(*fields)).over(w).eqNullSafe(F.struct(*fields))).filter("not same")
    return rows.select("file_id", *fields, F.col("ts").alias("valid_from"), F.lead("ts").over(w).alias("valid_to"))


def file_at(log: DataFrame, paths: DataFrame, t: int, blobs: DataFrame, branches: DataFrame, branch: str = MAIN) -> DataFrame:
    """found, result_hash and content of paths(path) as a branch had them at t: an empty file is found, an absent one not.

    The whole state is folded, once, as who owns a contended path depends on the others; contents are read for the paths only.
    """
    now, made = folded(as_of_filter(visible_rows(log, branches, branch).drop("target"), t), blobs)
    files = resolve_paths(now).filter("not deleted").select("path", "result_hash", F.lit(True).alias("found"))
    hit = paths.select("path").distinct().join(files, "path", "left")
    texts = with_made(blobs, made).select(F.col("content_hash").alias("result_hash"), F.col("text").alias("content"))
    out = hit.join(texts.dropDuplicates(["result_hash"]), "result_hash", "left")
    found = F.coalesce("found", F.lit(False))
    return out.select("path", found.alias("found"), "result_hash", F.when(found, F.coalesce("content", F.lit(""))).alias("content"))


def versions_at(log: DataFrame, probes: DataFrame, blobs: DataFrame) -> DataFrame:
    """probes(path, t) with found, result_hash and content, for logs without contended paths: an as-of join on the versions.

    Versions and probes of a path are sorted together, and each probe takes the last state of each file that was there: rows
    grow with versions and probes, not with their pairs.
    """
    rows, made = versions(log, blobs)
    rows = stored(spans(rows))
    # What a path holds changes when a file comes to it, changes there, leaves it or is deleted.
    there = rows.filter("not deleted and not (valid_to <=> valid_from)").select("path", F.col("valid_from").alias("t"), "valid_to", "file_id", "result_hash", F.lit(0).alias("asked"))
    asked = probes.select("path", "t").distinct().select("path", "t", F.lit(None).cast("long").alias("valid_to"), F.lit(None).cast("string").alias("file_id"), F.lit(None).cast("string").alias("result_hash"), F.lit(1).alias("asked"))
    upto = Window.partitionBy("path").orderBy("t", "asked", "file_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    version = F.when(F.col("asked") == 0, F.struct("valid_to", "result_hash"))
    # Of one path one file at most is live at a time, so that the last version that began is the one that may hold.
    both = there.unionByName(asked).withColumn("at", F.last(version, True).over(upto)).filter("asked = 1")
    holds = F.coalesce(F.col("at").isNotNull() & (F.col("at.valid_to").isNull() | (F.col("t") < F.col("at.valid_to"))), F.lit(False))
    hit = both.select("path", "t", holds.alias("found"), F.when(holds, F.col("at.result_hash")).alias("result_hash"))
    texts = with_made(blobs, made).select(F.col("content_hash").alias("result_hash"), F.col("text").alias("content")).dropDuplicates(["result_hash"])
    return hit.join(texts, "result_hash", "left").select("path", "t", "found", "result_hash", F.when(F.col("found"), F.coalesce("content", F.lit(""))).alias("content"))


def tree_hash(state: DataFrame) -> DataFrame:
    """One row: the hash of the state's sorted lines. The lines of a whole state meet in one value, by definition."""
    line = F.concat("file_id", F.lit("\0"), "path", F.lit("\0"), F.coalesce("result_hash", F.lit("")), F.lit("\n"))
    return state.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ""), 256).alias("tree_hash"), F.count(F.lit(1)).alias("files"))


def snapshot(log: DataFrame, label: str, t: int, blobs: DataFrame, branches: DataFrame, branch: str = MAIN) -> DataFrame:
    return state_as_of(log, t, blobs, branches, branch).select(F.lit(label).alias("label"), "file_id", "path", "result_hash")


def snapshot_by_label(snapshots: DataFrame) -> DataFrame:
    """label and the latest snapshot of that name."""
    return snapshots.groupBy("label").agg(F.max_by("snapshot_id", F.struct("created_lamport", "snapshot_id")).alias("snapshot_id"))


def diff_states(current: DataFrame, desired: DataFrame) -> DataFrame:
    """path and the action (create, edit, delete) that leads from current(path, result_hash) to desired."""
    a = current.select("path", F.col("result_hash").alias("have"), F.lit(True).alias("in_a"))
    b = desired.select("path", F.col("result_hash").alias("want"), F.lit(True).alias("in_b"))
    both = a.join(b, "path", "full_outer").filter(~(F.col("have").eqNullSafe(F.col("want")) & F.col("in_a").eqNullSafe(F.col("in_b"))))
    action = F.when(F.col("in_a").isNull(), "create").when(F.col("in_b").isNull(), "delete").otherwise("edit")
    return both.select("path", action.alias("action"), "have", "want")


def restore(log: DataFrame, desired: DataFrame, blobs: DataFrame, branches: DataFrame, site: str, ts: int, first_seq: int, first_lamport: int, branch: str = MAIN) -> DataFrame:
    """Sealed rows that bring a branch to desired(path, result_hash), a past state or a snapshot: the log itself only grows."""
    seen = stored(visible_rows(log, branches, branch).drop("target"))
    now = stored(live_contents(seen, blobs))
    changes = diff_states(now, desired).join(now.select("path", "file_id"), "path", "left")
    fresh = F.sha2(F.concat(F.lit(f"{site}:{first_lamport}:"), "path"), 256)  # a path that no file has now gets a file of its own
    return author_rows(seen, changes.withColumn("file_id", F.coalesce("file_id", fresh)), site, ts, first_seq, first_lamport, branch)


def restore_files_at(log: DataFrame, requests: DataFrame, blobs: DataFrame, branches: DataFrame, site: str, ts: int, first_seq: int, first_lamport: int, branch: str = MAIN) -> DataFrame:
    """Sealed rows that bring single paths of a branch back to what they held at requests(path, t); absent ones are skipped.

    A path asked for at several times goes to the latest of them at which it was there. All instants share one fold.
    """
    asked = stored(requests.select("path", "t").filter("path is not null and t is not null").distinct())
    times = asked.select(F.col("t").cast("string").alias("tag_id"), F.lit(branch).alias("branch_id"), F.col("t").alias("at_ts")).distinct()
    then = state_at_tags(log, times, blobs, branches).select(F.col("tag_id").cast("long").alias("t"), "path", F.col("result_hash").alias("want"))
    wanted = asked.join(then, ["path", "t"]).groupBy("path").agg(F.max_by("want", "t").alias("want"))
    seen = stored(visible_rows(log, branches, branch).drop("target"))
    now = live_contents(seen, blobs).select("path", "file_id", F.col("result_hash").alias("have"))
    fresh = F.sha2(F.concat(F.lit(f"{site}:{first_lamport}:"), "path"), 256)
    changes = wanted.join(now, "path", "left").withColumn("action", F.when(F.col("file_id").isNull(), "create").otherwise("edit")).withColumn("file_id", F.coalesce("file_id", fresh))
    return author_rows(seen, changes, site, ts, first_seq, first_lamport, branch)


def author_rows(log: DataFrame, changes: DataFrame, site: str, ts: int, first_seq: int, first_lamport: int, branch: str = MAIN) -> DataFrame:
    """Sealed rows for changes(file_id, path, action, have, want): parent is the file's tip, base the content it has.

    Changes that change nothing author nothing, but for renames and reclasses, which carry a path or merge_class of their
    own; rows are numbered by path over ranges, not in one task.
    """
    tips = log.filter(~F.col("kind").isin(*META_KINDS)).groupBy("file_id").agg(F.max_by("id", key_of()).alias("parent"), F.max_by("merge_class", key_of()).alias("__class"))
    own = F.col("merge_class") if "merge_class" in changes.columns else F.lit(None).cast("string")
    bare = F.col("action").isin("rename", "reclass")
    rows = changes.withColumn("merge_class", own).filter(bare | F.expr("not (have <=> want)")).join(tips, "file_id", "left")
    rows = assign_counters(rows, ["path", "file_id", "action"], first_seq)
    content = lambda c: F.when(~bare, F.col(c))
    rows = rows.select(
        F.lit(site).alias("site_id"), (F.lit(first_lamport) + F.col("seq") - F.lit(first_seq)).cast("long").alias("lamport"), F.col("seq").cast("long").alias("seq"),
        F.lit(ts).cast("long").alias("ts"), "file_id", F.col("action").alias("kind"), F.coalesce("merge_class", "__class", F.lit("text")).alias("merge_class"), "parent",
        content("have").alias("base_hash"), content("want").alias("result_hash"), F.when(F.col("action").isin("create", "rename"), F.col("path")).alias("path"),
        F.lit(branch).alias("branch_id"), F.lit(None).cast("string").alias("merge_parent"),
    )
    return rows.withColumn("id", row_id())


def author_merge(log: DataFrame, branches: DataFrame, src: str, into: str, blobs: DataFrame, site: str, ts: int, first_seq: int, first_lamport: int) -> tuple[DataFrame, DataFrame]:
    """(sealed rows, new contents) that merge src into a branch: merge_branches() as rows, then one marker row.

    The marker is of kind merge, with the branch's tip as parent and src's as second parent; its content says what src's
    vector was, which is the base of the next merge. Without rows of src that are not merged yet nothing is authored. All
    contents are (content_hash, text).
    """
    ours, theirs = stored(visible_rows(log, branches, into).drop("target")), stored(visible_rows(log, branches, src).drop("target"))
    fresh = theirs.join(merge_base(ours, theirs, blobs, src, into).select("id"), "id", "left_anti").filter(~F.col("kind").isin(*NO_FILE_KINDS))
    changes = stored(merge_branches(log, branches, src, into, blobs) if not fresh.isEmpty() else merge_branches(log, branches, src, into, blobs).limit(0))
    rows = stored(author_rows(ours, changes, site, ts, first_seq, first_lamport, into))
    made = changes.filter("content is not null").select(F.col("want").alias("content_hash"), F.col("content").alias("text")).distinct()
    if fresh.isEmpty():
        return rows, made
    n = rows.count()
    tip = lambda df, out: df.filter(~F.col("kind").isin(*META_KINDS)).agg(F.max_by("id", key_of()).alias(out)).withColumn("k", F.lit(1))
    sites = F.array_sort(F.collect_list(F.struct("site_id", "seq")))  # one entry per site
    vector = version_vector(theirs).agg(F.to_json(F.map_from_entries(sites)).alias("text")).withColumn("k", F.lit(1))
    tips = tip(ours, "was").join(tip(theirs, "merge_parent"), "k").join(vector, "k")
    last = rows.agg(F.max_by("id", "lamport").alias("own")).withColumn("k", F.lit(1))
    mark = tips.join(last, "k").select(
        F.lit(site).alias("site_id"), F.lit(first_lamport + n).cast("long").alias("lamport"), F.lit(first_seq + n).cast("long").alias("seq"), F.lit(ts).cast("long").alias("ts"),
        F.lit(src).alias("file_id"), F.lit("merge").alias("kind"), F.lit("text").alias("merge_class"), F.coalesce("own", "was").alias("parent"), F.lit(None).cast("string").alias("base_hash"),
        F.sha2("text", 256).alias("result_hash"), F.lit(None).cast("string").alias("path"), F.lit(into).alias("branch_id"), "merge_parent", "text",
    )
    mark = stored(mark.withColumn("id", row_id()))
    return rows.unionByName(mark.drop("text")), made.unionByName(mark.select(F.col("result_hash").alias("content_hash"), "text"))


def state_at_tags(log: DataFrame, tags: DataFrame, blobs: DataFrame, branches: DataFrame) -> DataFrame:
    """(tag_id, file_id, path, result_hash) of the live files of each tag's branch at its instant.

    A branch folds once, into versions, and a tag picks those that hold at its instant: rows grow with the log and with what
    tags show. Only files whose ts decrease somewhere in fold order, for which versions are not exact, fold once per tag.
    """
    asked = stored(tags.select("tag_id", F.col("branch_id").alias("target"), "at_ts").filter("at_ts is not null"))
    seen = visible_rows(log, branches).join(F.broadcast(asked.select("target").distinct()), "target", "left_semi")
    keyed = stored(seen.withColumn("file_id", F.concat("target", F.lit("\0"), "file_id")).drop("target"))
    before = Window.partitionBy("file_id").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    late = stored(ordered(keyed).withColumn("late", F.col("ts") < F.max("ts").over(before)).filter("late").select("file_id").distinct())
    part = lambda c, k: F.get(F.split(c, "\0"), F.lit(k))
    fields = ("result_hash", "path", "deleted", "merge_class", "claim")
    held = spans(versions(keyed.join(late, "file_id", "left_anti"), blobs)[0], fields).filter("not deleted").withColumn("target", part("file_id", 0))
    shown = held.join(asked, "target").filter("valid_from <= at_ts and (valid_to is null or at_ts < valid_to)").select("tag_id", *fields, "file_id")
    rows = keyed.join(late, "file_id", "left_semi").withColumn("target", part("file_id", 0)).join(asked, "target").filter("ts <= at_ts")
    own = states(rows.withColumn("file_id", F.concat("tag_id", F.lit("\0"), "file_id")).drop("tag_id", "target", "at_ts"), blobs)
    own = own.filter("not deleted").withColumn("tag_id", part("file_id", 0)).withColumn("file_id", F.concat_ws("\0", part("file_id", 1), part("file_id", 2)))
    shown = shown.unionByName(own.select(*shown.columns))
    claims = shown.select(
        F.concat("tag_id", F.lit("\0"), part("file_id", 1)).alias("file_id"), F.concat("tag_id", F.lit("\0"), F.coalesce("path", F.lit(""))).alias("path"), "result_hash", "merge_class",
        "deleted", "claim.lamport", "claim.site_id", F.lit(False).alias("conflict"), F.struct("claim.lamport", "claim.site_id", "claim.id").alias("claim"),
    )
    done = resolve_paths(claims).filter("merge_class != 'dir' and result_hash is not null")
    return done.select(part("file_id", 0).alias("tag_id"), part("file_id", 1).alias("file_id"), part("path", 1).alias("path"), "result_hash")


#: Bucket sizes in seconds, from five minutes to 30 days.
STEPS = (300, 900, 1800, 3600, 10800, 21600, 43200, 86400, 172800, 604800, 1209600, 2592000)


def step_for(span: int, wanted: int = 6) -> int:
    """The smallest step that needs at most `wanted` buckets for the span; else the largest."""
    return next((s for s in STEPS if span / s <= wanted), STEPS[-1])


def activity(log: DataFrame, step: int | None = None) -> DataFrame:
    """bucket, kind and n; without a step, the one that fits the log's own span."""
    if step is None:
        low, high = log.agg(F.min("ts"), F.max("ts")).first()
        step = step_for((high or 0) - (low or 0))
    return log.groupBy((F.expr(f"ts div {step}") * step).alias("bucket"), "kind").agg(F.count(F.lit(1)).alias("n"))


def first_divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per file the first row, by key, that only one of two logs has."""
    side = lambda x, y, n: x.join(y.select("id"), "id", "left_anti").select("file_id", key_of().alias("key"), F.lit(n).alias("only_in"))
    rows = side(a, b, "a").unionByName(side(b, a, "b"))
    return rows.groupBy("file_id").agg(F.min(F.struct("key", "only_in")).alias("m")).select("file_id", F.col("m.key.id").alias("id"), "m.only_in")


def refold_with_tiebreak(log: DataFrame, blobs: DataFrame) -> DataFrame:
    """Files whose state changes if rows go by wall clock instead of lamport."""
    a = states(log, blobs).select("file_id", F.col("result_hash").alias("by_lamport"))
    b = states(log.withColumn("lamport", F.col("ts")), blobs).select("file_id", F.col("result_hash").alias("by_clock"))
    return a.join(b, "file_id", "full_outer").filter("not (by_lamport <=> by_clock)")


def blob_gc(blobs: DataFrame, log: DataFrame, horizon: int, snapshots: DataFrame | None = None) -> DataFrame:
    """Contents, merged ones too, that nothing needs: no live file, no row since the horizon, no snapshot.

    blobs(content_hash, text) are those held; what merges of the log made counts as held. The log folds once.
    """
    now, made = folded(log, blobs)
    roots = now.filter("not deleted").select(F.col("result_hash").alias("content_hash"))
    recent = log.filter(F.col("ts") >= horizon).select(F.explode(F.array_compact(F.array("base_hash", "result_hash"))).alias("content_hash"))
    roots = roots.unionByName(recent)
    if snapshots is not None:
        roots = roots.unionByName(snapshots.select(F.col("result_hash").alias("content_hash")))
    held = with_made(blobs, made)
    return held.select("content_hash").distinct().join(roots.distinct(), "content_hash", "left_anti")

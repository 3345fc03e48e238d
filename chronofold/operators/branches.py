"""Branches as visibility predicates over one log, and the commit graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold.operators.fold import folded, key_of, states, with_made
from chronofold.operators.merge import merge3
from chronofold.operators.paths import resolve_paths
from chronofold.operators.sync import version_vector
from chronofold.sources.schemas import BRANCH_RECORD, MAIN
from chronofold.sources.tables import stored


def with_main(branches: DataFrame) -> DataFrame:
    """branches, with main if it is missing."""
    main = branches.sparkSession.createDataFrame([(MAIN, MAIN, None, {}, 0, 0, False)], BRANCH_RECORD)
    return branches.select(*main.columns).unionByName(main).groupBy("branch_id").agg(
        *[F.max_by(c, F.coalesce("created_lamport", F.lit(0))).alias(c) for c in main.columns if c != "branch_id"]
    )


def ancestry(branches: DataFrame) -> DataFrame:
    """(target, depth, branch_id) of every branch's line of parents, itself at 0; a repeat or an unknown parent ends it.

    The branch table is small. Lines double in each round: what is known of a branch's ancestors up to 2^k is joined to
    the branch that stands 2^k above it, so that a line of any length takes a number of rounds that is its logarithm.
    """
    known = stored(with_main(branches).select("branch_id", "parent"))
    up = known.join(known.select(F.col("branch_id").alias("parent")), "parent", "left_semi").select(F.col("branch_id").alias("target"), F.lit(1).cast("long").alias("depth"), F.col("parent").alias("branch_id"))
    lines = stored(known.select(F.col("branch_id").alias("target"), F.lit(0).cast("long").alias("depth"), "branch_id").unionByName(up))
    reach, most = 1, known.count()
    while reach < most:  # no line without a repeat is longer than there are branches
        last = lines.filter(F.col("depth") == reach).select("target", F.col("branch_id").alias("at"))
        more = lines.filter("depth > 0").select(F.col("target").alias("at"), F.col("depth").alias("step"), "branch_id")
        more = stored(last.join(more, "at").select("target", (F.lit(reach) + F.col("step")).alias("depth"), "branch_id"))
        if more.isEmpty():
            break
        lines, reach = stored(lines.unionByName(more)), 2 * reach
    # In a cycle a branch comes again and again: its first place counts.
    return stored(lines.groupBy("target", "branch_id").agg(F.min("depth").cast("int").alias("depth")).select("target", "depth", "branch_id"))


def visibility_caps(branches: DataFrame) -> DataFrame:
    """(target, branch_id, site_id, cap): rows of an ancestor are seen up to cap; site_id null means all of them.

    A row must pass the fork vector of every branch nearer to the target; a site that one of them lacks is not seen.
    """
    lines = ancestry(branches)
    vectors = with_main(branches).select("branch_id", F.explode("fork_vv").alias("site_id", "seq"))
    gates = lines.select("target", F.col("depth").alias("gate"), "branch_id").join(vectors, "branch_id").select("target", "gate", "site_id", "seq")
    far = lines.filter("depth > 0").join(gates, "target").filter("gate < depth")
    caps = far.groupBy("target", "branch_id", "depth", "site_id").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("cap")).filter("n = depth")
    own = lines.filter("depth = 0").select("target", "branch_id", F.lit(None).cast("string").alias("site_id"), F.lit(None).cast("long").alias("cap"))
    return own.unionByName(caps.select("target", "branch_id", "site_id", "cap"))


def visible_rows(log: DataFrame, branches: DataFrame, target: str | None = None) -> DataFrame:
    """Log rows with `target`, once for every branch (or the one asked for) that sees them."""
    caps = stored(visibility_caps(branches))  # a few rows per branch and site
    if target is not None:
        caps = caps.filter(F.col("target") == target)
    own = caps.filter("site_id is null").select("target", "branch_id")
    above = caps.filter("site_id is not null")
    return log.join(own, "branch_id").unionByName(log.join(above, ["branch_id", "site_id"]).filter("seq <= cap").drop("cap"), allowMissingColumns=False)


def branch_files(log: DataFrame, branches: DataFrame, target: str, blobs: DataFrame) -> DataFrame:
    return resolve_paths(states(visible_rows(log, branches, target).drop("target"), blobs))


def visible_version_vector(log: DataFrame, branches: DataFrame, target: str) -> DataFrame:
    return version_vector(visible_rows(log, branches, target))


#: Rows of a branch's past that one task sweeps; its log and requests are cut into such stretches of time.
STRETCH = 1_000_000


def swept(rows: DataFrame, asked: DataFrame, keys: list[str], value: str, stretch: int | None = None) -> DataFrame:
    """(request, *keys, value): the largest value of rows(target, *keys, ts, value) up to each request's instant.

    asked(request, target, t) with t null for now. A target's rows and requests are laid out by time and cut into stretches
    of about equal numbers of rows; per stretch and key the largest value is carried on to the stretches after it, so that
    a request meets one value per key from before and its own stretch's rows once: rows are log + requests x keys.
    """
    stretch = stretch or STRETCH
    sizes = stored(rows.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("low"), F.max("ts").alias("high")))
    share = F.greatest(F.lit(1), F.ceil(F.col("n") / stretch)).cast("long")
    width = F.greatest(F.lit(1), F.ceil((F.col("high") - F.col("low") + 1) / share)).cast("long")
    lay = sizes.select("target", "low", width.alias("width"), share.alias("last"))
    held = rows.join(F.broadcast(lay), "target").withColumn("part", F.expr("(ts - low) div width"))  # one row per branch
    tops = stored(held.groupBy("target", "part", *keys).agg(F.max(value).alias(value)))
    carried = Window.partitionBy("target", *keys).orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    until = tops.withColumn(value, F.max(value).over(carried)).withColumn("upto", F.lead("part").over(Window.partitionBy("target", *keys).orderBy("part")))
    when = asked.join(F.broadcast(lay), "target").withColumn("at", F.when(F.col("t").isNull(), F.col("last") + 1).otherwise(F.expr("case when t < low then -1 else least((t - low) div width, last + 1) end")))
    when = stored(when.select("request", "target", "t", "at"))
    # What whole stretches before the request's own one hold: the last value carried to there.
    before = when.join(until, "target").filter("part < at and (upto is null or upto >= at)").select("request", *keys, value)
    # Within the stretch: rows and requests in one order, one running value per key of the stretch.
    near = when.filter("t is not null and at >= 0").join(tops.select("target", "part", *keys), [F.col("at") == F.col("part"), when["target"] == tops["target"]]).select("request", when["target"], "part", *keys, F.col("t").alias("ts"))
    both = held.select("target", "part", *keys, "ts", value, F.lit(None).cast("long").alias("request")).unionByName(near.withColumn(value, F.lit(None).cast("long")))
    both = both.join(when.select("target", F.col("at").alias("part")).distinct(), ["target", "part"], "left_semi")
    running = Window.partitionBy("target", "part", *keys).orderBy("ts", F.col("request").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = both.withColumn(value, F.max(value).over(running)).filter(f"request is not null and {value} is not null").select("request", *keys, value)
    return before.unionByName(within).groupBy("request", *keys).agg(F.max(value).alias(value))


def fork_vectors(log: DataFrame, branches: DataFrame, requests: DataFrame, stretch: int | None = None) -> DataFrame:
    """(request, site_id, seq) for requests(request, branch_id, t): the vector of what the branch sees up to t; null t is now."""
    targets = requests.select(F.col("branch_id").alias("target")).distinct()
    seen = visible_rows(log, branches).join(F.broadcast(targets), "target", "left_semi").select("target", "site_id", "seq", "ts")
    return swept(seen, requests.select("request", F.col("branch_id").alias("target"), "t"), ["site_id"], "seq", stretch)


def nearest_live_ancestor(branches: DataFrame) -> DataFrame:
    """branch_id and the nearest parent that is not deleted; main if none."""
    lines = ancestry(branches).filter("depth > 0").join(with_main(branches).filter("not deleted").select("branch_id"), "branch_id")
    near = lines.groupBy("target").agg(F.min_by("branch_id", "depth").alias("ancestor"))
    all_of = with_main(branches).select(F.col("branch_id").alias("target"))
    return all_of.join(near, "target", "left").select(F.col("target").alias("branch_id"), F.coalesce("ancestor", F.lit(MAIN)).alias("ancestor"))


def compare_branches(log: DataFrame, branches: DataFrame, a: str, b: str, blobs: DataFrame) -> DataFrame:
    """path and both hashes where the states of two branches differ."""
    side = lambda x, out: branch_files(log, branches, x, blobs).filter("not deleted").select("path", F.col("result_hash").alias(out))
    return side(a, "hash_a").join(side(b, "hash_b"), "path", "full_outer").filter(~F.col("hash_a").eqNullSafe(F.col("hash_b")))


# --- graph ---------------------------------------------------------------------------------------------------------------


def lanes(branches: DataFrame) -> DataFrame:
    """branch_id and lane: main is 0, then live branches by creation."""
    rows = with_main(branches).filter(f"not deleted or branch_id = '{MAIN}'")
    order = Window.orderBy(F.col("branch_id") != MAIN, "created_lamport", "branch_id")  # a handful of rows
    return rows.select("branch_id", "parent", "fork_vv", "created_lamport", (F.row_number().over(order) - 1).alias("lane"))


def commit_rows(log: DataFrame, gap: int = 3, block: int = 1_000_000) -> DataFrame:
    """Rows with `commit`, counted from 1 in each branch: a row starts one when the site changes or lamport leaps by more than `gap`.

    A branch may hold most of the log: its rows are windowed in blocks of lamport, and blocks are joined by their ends.
    """
    part = [F.col("branch_id"), F.expr(f"lamport div {block}").alias("__block")]
    rows = log.filter("kind != 'branch'").select("branch_id", part[1], "lamport", "site_id", "id", "ts", "path")
    order = Window.partitionBy("branch_id", "__block").orderBy("lamport", "site_id", "id")
    leap = (F.lag("site_id").over(order) != F.col("site_id")) | (F.col("lamport") - F.lag("lamport").over(order) > gap)
    rows = stored(rows.withColumn("__k", F.sum(F.coalesce(leap, F.lit(False)).cast("int")).over(order)))
    # Per block: how many commits start inside it, and whether its first row starts one after the block before.
    ends = rows.groupBy("branch_id", "__block").agg(
        F.max("__k").alias("inner"), F.min(key_of()).alias("first"), F.max(key_of()).alias("last"),
    )
    blocks = Window.partitionBy("branch_id").orderBy("__block")
    before = F.lag("last").over(blocks)
    fresh = F.coalesce((before["site_id"] != F.col("first.site_id")) | (F.col("first.lamport") - before["lamport"] > gap), F.lit(True)).cast("int")
    ends = ends.withColumn("fresh", fresh)
    base = F.sum(F.col("fresh") + F.col("inner")).over(blocks) - F.col("inner")
    rows = rows.join(ends.select("branch_id", "__block", base.alias("__base")), ["branch_id", "__block"])
    return rows.select("branch_id", (F.col("__base") + F.col("__k")).alias("commit"), "lamport", "site_id", "id", "ts", "path")


def settle_commits(log: DataFrame, gap: int = 3, block: int = 1_000_000) -> DataFrame:
    """Commits of each branch; see commit_rows(). commit_id is the last row's id; label tells its path or the number of changes."""
    return commits_of(commit_rows(log, gap, block))


def commits_of(rows: DataFrame) -> DataFrame:
    last = rows.groupBy("branch_id", "commit").agg(
        F.max_by("id", key_of()).alias("commit_id"), F.max_by("ts", key_of()).alias("ts"), F.max("lamport").alias("lamport"),
        F.max_by("site_id", key_of()).alias("site_id"),
        F.max_by("path", F.when(F.col("path").isNotNull(), key_of())).alias("path"), F.count(F.lit(1)).alias("n"),
    )
    more = F.concat(F.lit(" +"), (F.col("n") - 1).cast("string"))
    label = (
        F.when(F.col("path").isNotNull() & (F.col("n") == 1), F.col("path"))
        .when(F.col("path").isNotNull(), F.concat("path", more))
        .when(F.col("n") == 1, F.lit("1 change"))
        .otherwise(F.concat(F.col("n").cast("string"), F.lit(" changes")))
    )
    return last.select("branch_id", "commit", "commit_id", "ts", "lamport", "site_id", "n", label.alias("label"))


def graph(log: DataFrame, branches: DataFrame, cap: int = 200, head: str = MAIN) -> DataFrame:
    """Nodes: commit_id, branch_id, lane, ts, lamport, label, parents and current, the newest `cap` of each lane.

    A lane's first node left has the parent branch's commit at the fork point as parent: the last one up to it, else the last.
    A node that holds merge rows has the commits of their second parents as further parents, as far as these are nodes.
    """
    lane = lanes(branches)
    rows = stored(commit_rows(log))
    nodes = stored(commits_of(rows)).join(lane.select("branch_id", "lane"), "branch_id")
    top = nodes.groupBy("branch_id").agg(F.max("commit").alias("top"))
    nodes = stored(nodes.join(top, "branch_id").filter(F.col("commit") > F.col("top") - cap).drop("top"))  # cap rows a branch
    # Commits are counted without gaps, so that the one before is found by its number.
    previous = nodes.select("branch_id", (F.col("commit") + 1).alias("commit"), F.col("commit_id").alias("before"))
    joined = nodes.join(previous, ["branch_id", "commit"], "left")
    fork = F.greatest("created_lamport", F.coalesce(F.array_max(F.map_values("fork_vv")), F.lit(0)), F.lit(0))
    forks = lane.filter(f"branch_id != '{MAIN}'").select("branch_id", "parent", fork.alias("fork"))
    chain = nodes.select(F.col("branch_id").alias("parent"), F.col("commit_id").alias("c"), F.col("lamport").alias("l"), F.col("commit").alias("o"))
    edges = forks.join(chain, "parent").groupBy("branch_id").agg(
        F.max_by("c", F.when(F.col("l") <= F.col("fork"), F.col("o"))).alias("at"), F.max_by("c", "o").alias("last")
    )
    joined = joined.join(edges.select("branch_id", F.coalesce("at", "last").alias("fork_commit")), "branch_id", "left")
    # Second parents: merge row -> its commit, and the row it names -> the node that holds that.
    second_parent = F.col("merge_parent") if "merge_parent" in log.columns else F.lit(None).cast("string")  # old logs lack it
    marks = log.filter("kind = 'merge'").select("id", second_parent.alias("merge_parent")).filter("merge_parent is not null")
    holds = rows.select("id", "branch_id", "commit").join(nodes.select("branch_id", "commit", "commit_id"), ["branch_id", "commit"])
    second = marks.join(holds.select("id", F.col("commit_id").alias("of")), "id").join(holds.select(F.col("id").alias("merge_parent"), "commit_id"), "merge_parent")
    second = second.groupBy(F.col("of").alias("commit_id")).agg(F.array_sort(F.collect_set("commit_id")).alias("merged"))
    joined = joined.join(second, "commit_id", "left")
    parent, none = F.coalesce("before", "fork_commit"), F.array().cast("array<string>")
    first = F.when(parent.isNull(), none).otherwise(F.array(parent))
    return joined.select(
        "commit_id", "branch_id", "lane", "ts", "lamport", "label", F.array_distinct(F.concat(first, F.coalesce("merged", none))).alias("parents"),
        (F.col("branch_id") == head).alias("current"),
    )


def tag_lane(tags: DataFrame, branches: DataFrame) -> DataFrame:
    """tags with their branch's lane; 0 if it is unknown."""
    return tags.join(lanes(branches).select("branch_id", "lane"), "branch_id", "left").withColumn("lane", F.coalesce("lane", F.lit(0)))


def tag_points(log: DataFrame, branches: DataFrame, requests: DataFrame, stretch: int | None = None) -> DataFrame:
    """request and the largest lamport that the branch sees up to t; a null t sees nothing."""
    targets = requests.select(F.col("branch_id").alias("target")).distinct()
    seen = visible_rows(log, branches).join(F.broadcast(targets), "target", "left_semi").select("target", "ts", "lamport")
    asked = requests.filter("t is not null").select("request", F.col("branch_id").alias("target"), "t")
    found = swept(seen, asked, [], "lamport", stretch).withColumnRenamed("lamport", "at_lamport")
    return requests.select("request").join(found, "request", "left")


def merge_points(rows: DataFrame, blobs: DataFrame, of: str, into: str) -> DataFrame:
    """(lamport, site_id, id, vector) of the marker rows by which `into` has merged `of`; vector is what it had of each site then."""
    marks = rows.filter((F.col("kind") == "merge") & (F.col("branch_id") == into) & (F.col("file_id") == of))
    texts = blobs.select(F.col("content_hash").alias("result_hash"), F.from_json("text", "map<string, bigint>").alias("vector"))
    return marks.join(texts, "result_hash").filter("vector is not null").select("lamport", "site_id", "id", "vector")


def merge_base(ours: DataFrame, theirs: DataFrame, blobs: DataFrame, src: str, into: str) -> DataFrame:
    """The rows whose state both sides started from: what both see, and what the last merge between them brought over.

    After a merge of src the base is src as it was then; after one the other way it is `into` as it was then. Late rows that
    were not in that merge's vector are not in the base, whatever their place.
    """
    shared = theirs.join(ours.select("id"), "id", "left_semi")
    last = merge_points(ours, blobs, src, into).withColumn("side", F.lit("theirs")).unionByName(merge_points(theirs, blobs, into, src).withColumn("side", F.lit("ours")))
    mark = last.orderBy(F.desc("lamport"), F.desc("site_id"), F.desc("id")).select("id", "side").first()
    if mark is None:
        return shared
    upto = last.filter(F.col("id") == mark["id"]).select(F.explode("vector").alias("site_id", "upto"))  # one row per site
    side = theirs if mark["side"] == "theirs" else ours
    had = side.join(upto, "site_id").filter("seq <= upto").drop("upto").select(*shared.columns)
    return had.unionByName(shared.join(had.select("id"), "id", "left_anti"))


def merge_branches(log: DataFrame, branches: DataFrame, src: str, into: str, blobs: DataFrame) -> DataFrame:
    """What brings src's changes into a branch: file_id, action, path, merge_class, have, want, conflict and content.

    Path, class and content of each file are merged three ways against merge_base(), each by itself; of two new paths or
    classes src's wins and is a conflict. A file may get a rename, a reclass and an edit. Files that only src has are created,
    files that only src deleted are deleted, and what one side deleted and the other changed keeps the change, as a conflict.
    have is into's content; timetravel.author_merge() seals the rows. Without new rows of src there are none.
    """
    ours, theirs = stored(visible_rows(log, branches, into).drop("target")), stored(visible_rows(log, branches, src).drop("target"))
    base = stored(merge_base(ours, theirs, blobs, src, into))
    sides, texts = [], []
    for name, rows in (("b", base), ("o", ours), ("t", theirs)):
        state, made = folded(rows, blobs)
        value = F.when(~F.col("deleted"), F.struct("path", "merge_class", "result_hash"))
        sides.append(state.select("file_id", value.alias(name)))
        texts.append(with_made(blobs, made).select(F.col("content_hash").alias(f"{name}_hash"), F.col("text").alias(f"{name}_text")).dropDuplicates([f"{name}_hash"]))
    rows = sides[2].join(sides[1], "file_id", "left").join(sides[0], "file_id", "left")
    rows = stored(rows.filter("not (t <=> b) and not (t <=> o)"))
    gone = rows.filter("t is null and o <=> b").select("file_id", F.lit("delete").alias("action"), F.lit(None).cast("string").alias("path"), F.col("o.merge_class").alias("merge_class"), F.col("o.result_hash").alias("have"), F.lit(None).cast("string").alias("want"), F.lit(False).alias("conflict"))
    new = rows.filter("t is not null and o is null").select("file_id", F.lit("create").alias("action"), "t.path", "t.merge_class", F.lit(None).cast("string").alias("have"), F.col("t.result_hash").alias("want"), F.col("b").isNotNull().alias("conflict"))
    both = rows.filter("t is not null and o is not null")
    for field in ("path", "merge_class", "result_hash"):
        picked = F.when(F.col(f"t.{field}").eqNullSafe(F.col(f"b.{field}")), F.col(f"o.{field}")).otherwise(F.col(f"t.{field}"))
        split = ~F.col(f"t.{field}").eqNullSafe(F.col(f"b.{field}")) & ~F.col(f"o.{field}").eqNullSafe(F.col(f"b.{field}")) & ~F.col(f"o.{field}").eqNullSafe(F.col(f"t.{field}"))
        both = both.withColumn(f"new_{field}", picked).withColumn(f"split_{field}", split)
    both = stored(both)
    moved = both.filter("not (new_path <=> o.path)").select("file_id", F.lit("rename").alias("action"), F.col("new_path").alias("path"), F.col("o.merge_class").alias("merge_class"), F.col("o.result_hash").alias("have"), F.col("o.result_hash").alias("want"), F.col("split_path").alias("conflict"))
    classed = both.filter("not (new_merge_class <=> o.merge_class)").select("file_id", F.lit("reclass").alias("action"), F.lit(None).cast("string").alias("path"), F.col("new_merge_class").alias("merge_class"), F.col("o.result_hash").alias("have"), F.col("o.result_hash").alias("want"), F.col("split_merge_class").alias("conflict"))
    taken = both.filter("not split_result_hash and not (new_result_hash <=> o.result_hash)").select("file_id", F.lit("edit").alias("action"), F.lit(None).cast("string").alias("path"), F.col("new_merge_class").alias("merge_class"), F.col("o.result_hash").alias("have"), F.col("new_result_hash").alias("want"), F.lit(False).alias("conflict"))
    plain = gone.unionByName(new).unionByName(moved).unionByName(classed).unionByName(taken)
    plain = plain.join(texts[2].withColumnRenamed("t_hash", "want").withColumnRenamed("t_text", "content"), "want", "left")
    plain = plain.withColumn("content", F.when(F.col("action").isin("create", "edit"), F.col("content")))
    fought = both.filter("split_result_hash").select("file_id", F.col("new_merge_class").alias("merge_class"), *[F.col(f"{n}.result_hash").alias(f"{n}_hash") for n in "bot"])
    for n, text in zip("bot", texts, strict=True):
        fought = fought.join(text, f"{n}_hash", "left")
    side = lambda n, to: F.coalesce(f"{n}_text", F.lit("")).alias(to)
    done = merge3(stored(fought.select(F.col("file_id").alias("key"), "merge_class", side("b", "base"), side("o", "ours"), side("t", "theirs"))))
    merged = fought.select("file_id", "merge_class", F.col("o_hash").alias("have")).join(done.withColumnRenamed("key", "file_id"), "file_id")
    merged = merged.select("file_id", F.lit("edit").alias("action"), F.lit(None).cast("string").alias("path"), "merge_class", "have", F.sha2("merged", 256).alias("want"), "conflict", F.col("merged").alias("content"))
    return plain.select(*merged.columns).unionByName(merged.filter("not (have <=> want)"))


def dedup_branch_names(branches: DataFrame) -> DataFrame:
    """branch_id and a name of its own: later ones of a name get ` (n)`."""
    order = Window.partitionBy("name").orderBy("created_lamport", "branch_id")
    k = F.row_number().over(order)
    rows = branches.select("branch_id", "name", k.alias("k"))
    return rows.select("branch_id", F.when(F.col("k") == 1, F.col("name")).otherwise(F.concat("name", F.lit(" ("), F.col("k").cast("string"), F.lit(")"))).alias("name"))


def live_records(records: DataFrame) -> DataFrame:
    return records.filter("not coalesce(deleted, false)")

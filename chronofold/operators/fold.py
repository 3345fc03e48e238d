"""The fold: change rows to the state of each file.

A file's state depends on its own rows only, so one exchange by file_id serves all windows here. Files whose edits all
stand on the current content fold by windows over hashes; only files with a stale base read contents and merge.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from chronofold.operators.merge import merge_text
from chronofold.operators.paths import family, resolve_paths
from chronofold.sources.schemas import FILES, NO_FILE_KINDS
from chronofold.sources.tables import stored


def by_file() -> WindowSpec:
    return Window.partitionBy("file_id").orderBy("lamport", "site_id", "id")


def key_of(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}") for c in ("lamport", "site_id", "id")])


def out_of_order(log: DataFrame) -> DataFrame:
    """Rows whose parent, a row of the same file, has a larger key: only their files need the graph order."""
    parents = log.select("file_id", F.col("id").alias("parent"), key_of().alias("parent_key"))
    return log.join(parents, ["file_id", "parent"]).filter(F.col("parent_key") > key_of()).select("file_id", "id", "parent")


def causal_order(rows: list[tuple]) -> list[int]:
    """Kahn's order over (key, id, parent): the smallest ready key first; what a cycle holds comes last, by key."""
    place = {r[1]: i for i, r in enumerate(rows)}
    children: dict[int, list[int]] = {}
    waiting = [0] * len(rows)
    for i, (_, _, parent) in enumerate(rows):
        p = place.get(parent)
        if p is not None:
            children.setdefault(p, []).append(i)
            waiting[i] = 1
    ready = [(r[0], i) for i, r in enumerate(rows) if not waiting[i]]
    heapq.heapify(ready)
    out: list[int] = []
    while ready:
        _, i = heapq.heappop(ready)
        out.append(i)
        for c in children.get(i, ()):
            waiting[c] -= 1
            if not waiting[c]:
                heapq.heappush(ready, (rows[c][0], c))
    seen = set(out)
    return out + [i for i in sorted(range(len(rows)), key=lambda i: rows[i][0]) if i not in seen]


def ordered(log: DataFrame) -> DataFrame:
    """log with rn, each row's place (from 1) in its file's causal order: by key, and parents before their children.

    Only files that hold a parent with a larger key leave the window for a walk over their graph.
    """
    odd = stored(out_of_order(log).select("file_id").distinct())
    if odd.isEmpty():
        return log.withColumn("rn", F.row_number().over(by_file()))
    plain = log.join(odd, "file_id", "left_anti").withColumn("rn", F.row_number().over(by_file()))

    def kahn(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(zip(pdf.lamport, pdf.site_id, pdf.id), pdf.id, pdf.parent, strict=True))
        order = causal_order(rows)
        return pd.DataFrame({"file_id": pdf.file_id.iloc[0], "id": [rows[i][1] for i in order], "rn": range(1, len(rows) + 1)})

    rest = log.join(odd, "file_id", "left_semi")
    places = rest.select("file_id", "id", "lamport", "site_id", "parent").groupBy("file_id").applyInPandas(kahn, "file_id string, id string, rn int")
    return plain.unionByName(rest.join(places, ["file_id", "id"]).select(*plain.columns))


def fold_order(log: DataFrame) -> DataFrame:
    """file_id, id and position (from 1) of each row in its file's causal order."""
    return ordered(log).select("file_id", "id", F.col("rn").cast("long").alias("position"))


def lived(log: DataFrame) -> DataFrame:
    """Rows that bear on their file's state at some time, with rn, their place in causal order, and life.

    Every create begins a life, which replaces what was before; rows before the first one do nothing. In a life the first
    delete is final but for later deletes.
    """
    upto = Window.partitionBy("file_id").orderBy("rn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ordered(log).filter(~F.col("kind").isin(*NO_FILE_KINDS))
    rows = rows.withColumn("life", F.count(F.when(F.col("kind") == "create", 1)).over(upto)).filter("life > 0")
    rows = rows.withColumn("ended", F.min(F.when(F.col("kind") == "delete", F.col("rn"))).over(Window.partitionBy("file_id", "life")))
    return rows.filter("ended is null or rn <= ended or kind = 'delete'")


def effective(log: DataFrame) -> DataFrame:
    """The rows of lived() that bear on their file's present state: those of its last life."""
    rows = lived(log).withColumn("lives", F.max("life").over(Window.partitionBy("file_id")))
    return rows.filter("life = lives").drop("life", "lives")


def with_stale(rows: DataFrame) -> DataFrame:
    """Adds stale: an edit whose base is not the content before it (null-safe)."""
    content = F.when(F.col("kind").isin("create", "edit"), F.struct("result_hash"))
    before = F.last(content, ignorenulls=True).over(Window.partitionBy("file_id").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("stale", (F.col("kind") == "edit") & ~F.col("base_hash").eqNullSafe(before["result_hash"]))


def fold_linear(log: DataFrame) -> DataFrame:
    """State per file by windows and arg-max: exact wherever needs_merge is false."""
    return linear_states(with_stale(effective(log)))


def linear_states(rows: DataFrame) -> DataFrame:
    """fold_linear() of with_stale() rows."""
    last = lambda value, *kinds: F.max_by(value, F.when(F.col("kind").isin(*kinds), F.col("rn")))
    claim = F.struct("lamport", "site_id", "id")
    return rows.groupBy("file_id").agg(
        last("path", "create", "rename").alias("path"), last("result_hash", "create", "edit").alias("result_hash"),
        last("merge_class", "create", "reclass").alias("merge_class"), F.max(F.col("kind") == "delete").alias("deleted"),
        F.max_by("lamport", "rn").alias("lamport"), F.max_by("site_id", "rn").alias("site_id"),
        last(claim, "create", "rename").alias("claim"), F.max("stale").alias("needs_merge"),
    )


def needs_merge(log: DataFrame) -> DataFrame:
    """Files that hold an effective edit on a stale base."""
    return with_stale(effective(log)).groupBy("file_id").agg(F.max("stale").alias("stale")).filter("stale").select("file_id")


CLAIM = "struct<lamport: bigint, site_id: string, id: string>"
MERGED = f"{FILES}, claim {CLAIM}, content string"
NAMES = ["file_id", "path", "result_hash", "merge_class", "deleted", "lamport", "site_id", "conflict", "claim"]

STEPS = "file_id string, rn int, kind string, lamport long, site_id string, id string, base_hash string, result_hash string, base_text string, result_text string, merge_class string, path string"
STATE = pa.schema(
    [
        ("file_id", pa.string()), ("path", pa.string()), ("result_hash", pa.string()), ("merge_class", pa.string()), ("deleted", pa.bool_()), ("lamport", pa.int64()),
        ("site_id", pa.string()), ("conflict", pa.bool_()), ("claim", pa.struct([("lamport", pa.int64()), ("site_id", pa.string()), ("id", pa.string())])), ("content", pa.string()),
    ]
)


def after(state: dict | None, r: dict) -> dict:
    """The state of a file after one more of its effective rows."""
    key = {"lamport": r["lamport"], "site_id": r["site_id"], "id": r["id"]}
    if r["kind"] == "create" or state is None:
        state = {"path": r["path"], "result_hash": r["result_hash"], "merge_class": r["merge_class"], "deleted": False, "conflict": False, "claim": key}
        state |= {"text": r["result_text"], "content": None}
    elif r["kind"] == "edit" and r["base_hash"] == state["result_hash"]:
        state |= {"result_hash": r["result_hash"], "text": r["result_text"], "content": None}
    elif r["kind"] == "edit":
        text, conflict = merge_text(state["merge_class"], r["base_text"] or "", state["text"] or "", r["result_text"] or "")
        state |= {"result_hash": hashlib.sha256(text.encode()).hexdigest(), "text": text, "content": text, "conflict": state["conflict"] or conflict}
    elif r["kind"] == "rename":
        state |= {"path": r["path"], "claim": key}
    elif r["kind"] == "reclass":
        state |= {"merge_class": r["merge_class"]}
    else:
        state |= {"deleted": True}
    return state | {"lamport": r["lamport"], "site_id": r["site_id"]}


def with_texts(rows: DataFrame, blobs: DataFrame) -> DataFrame:
    """rows with base_text and result_text; rows without a hash, the renames and deletes, stay out of the joins."""
    texts = blobs.select("content_hash", "text").dropDuplicates(["content_hash"])
    for side in ("base", "result"):
        own = texts.select(F.col("content_hash").alias(f"{side}_hash"), F.col("text").alias(f"{side}_text"))
        has = F.col(f"{side}_hash").isNotNull() & F.col("kind").isin("create", "edit")
        bare = rows.filter(~has).withColumn(f"{side}_text", F.lit(None).cast("string"))
        rows = rows.filter(has).join(own, f"{side}_hash", "left").select(*bare.columns).unionByName(bare)
    return rows


def fold_merge(log: DataFrame, blobs: DataFrame) -> DataFrame:
    """State per file of log, its stale edits merged on contents; `content` is set where a merge made a new one.

    blobs(content_hash, text) gives the three sides; a missing one is empty. A file's rows are sorted to one task, as its
    state is one sequence of merges, and stream through it one by one; call it on the files that need it.
    """
    return merged_rows(effective(log), blobs)


def merged_rows(rows: DataFrame, blobs: DataFrame, every: bool = False) -> DataFrame:
    """fold_merge() of effective() rows; or, of lived() rows, the state after every row, with its rn."""
    schema = STATE.append(pa.field("rn", pa.int32())) if every else STATE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict | None = None
        done: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if state is not None and state["file_id"] != r["file_id"]:
                    if not every:
                        done.append(state)
                    state = None
                state = {"file_id": r["file_id"], **after(state, r)}
                if every:
                    done.append({**state, "rn": r["rn"]})
                if len(done) >= 1_000:
                    yield pa.RecordBatch.from_pylist(done, schema=schema)
                    done = []
            yield pa.RecordBatch.from_pylist(done, schema=schema)
            done = []
        yield pa.RecordBatch.from_pylist([state] if state and not every else [], schema=schema)

    steps = with_texts(rows, blobs).select(*[x.split()[0] for x in STEPS.split(", ")])
    return steps.repartition("file_id").sortWithinPartitions("file_id", "rn").mapInArrow(run, f"{MERGED}, rn int" if every else MERGED)


def split_states(log: DataFrame, blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The states of files that fold by windows, and those of files that merge; effective rows are written once for both."""
    rows = stored(with_stale(effective(log)))
    linear = linear_states(rows)
    hard = rows.filter("stale").select("file_id").distinct()
    plain = linear.filter("not needs_merge").withColumn("conflict", F.lit(False))
    return plain, merged_rows(rows.join(hard, "file_id", "left_semi"), blobs)


def states(log: DataFrame, blobs: DataFrame) -> DataFrame:
    """State per file with its path claim; files with stale bases are merged on blobs(content_hash, text)."""
    plain, merged = split_states(log, blobs)
    return plain.select(*NAMES).unionByName(merged.select(*NAMES))


def folded(log: DataFrame, blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One fold for both: states(), and the contents that its merges ended with, as content_hash and text."""
    plain, merged = split_states(log, blobs)
    merged = stored(merged)
    made = merged.filter("content is not null").select(F.col("result_hash").alias("content_hash"), F.col("content").alias("text"))
    return plain.select(*NAMES).unionByName(merged.select(*NAMES)), made.dropDuplicates(["content_hash"])


def versions(log: DataFrame, blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file_id, rn, ts, path, result_hash, merge_class, deleted, claim) after each row that bears on a file, through all its
    lives, and the contents that merges made on the way, as content_hash and text.

    Files that hold a stale edit in some life stream through the merge; the others are windows over hashes.
    """
    rows = stored(with_stale(lived(log)))
    hard = rows.filter("stale").select("file_id").distinct()
    upto = Window.partitionBy("file_id", "life").orderBy("rn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda c, *kinds: F.last(F.when(F.col("kind").isin(*kinds), F.struct(c)), True).over(upto)[c].alias(c)
    plain = rows.join(hard, "file_id", "left_anti").select(
        "file_id", "rn", "ts", last("path", "create", "rename"), last("result_hash", "create", "edit"), last("merge_class", "create", "reclass"), F.max(F.col("kind") == "delete").over(upto).alias("deleted"),
        F.last(F.when(F.col("kind").isin("create", "rename"), F.struct("lamport", "site_id", "id")), True).over(upto).alias("claim"),
    )
    stale = rows.join(hard, "file_id", "left_semi")
    merged = stored(merged_rows(stale, blobs, every=True))
    made = merged.filter("content is not null").select(F.col("result_hash").alias("content_hash"), F.col("content").alias("text")).dropDuplicates(["content_hash"])
    merged = merged.join(stale.select("file_id", "rn", "ts"), ["file_id", "rn"]).select(*plain.columns)
    return plain.unionByName(merged), made


def with_made(blobs: DataFrame, made: DataFrame) -> DataFrame:
    """blobs(content_hash, text) and those of made that it lacks."""
    return blobs.select("content_hash", "text").unionByName(made.join(blobs, "content_hash", "left_anti"))


def with_merged(blobs: DataFrame, log: DataFrame) -> DataFrame:
    """blobs(content_hash, text) and the contents that merges of the log's files end with."""
    return with_made(blobs, folded(log, blobs)[1])


def refold(held: DataFrame, log: DataFrame, touched: DataFrame, blobs: DataFrame) -> DataFrame:
    """States after new rows: only touched(file_id) fold anew, the others are taken from held."""
    fresh = states(log.join(touched.select("file_id").distinct(), "file_id", "left_semi"), blobs)
    return held.join(touched.select("file_id").distinct(), "file_id", "left_anti").unionByName(fresh)


def refold_files(held: DataFrame, files: DataFrame, log: DataFrame, touched: DataFrame, blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(states, files with their paths) after new rows, of held states and the files resolved from them.

    Paths are claimed anew only in the families of names that a touched file was in or is in now: no other family, and no
    directory of another one, can change.
    """
    now = stored(refold(held, log, touched, blobs))
    named = lambda df: df.withColumn("family", family(F.coalesce("path", F.lit(""))))
    mine = touched.select("file_id").distinct()
    met = stored(named(held).join(mine, "file_id", "left_semi").select("family").union(named(now).join(mine, "file_id", "left_semi").select("family")).distinct())
    again = resolve_paths(named(now).join(met, "family", "left_semi").drop("family"))
    was = named(held).join(met, "family", "left_semi").select("file_id").union(mine)
    return now, files.join(was.distinct(), "file_id", "left_anti").select(*again.columns).unionByName(again)

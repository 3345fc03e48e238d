"""Operator 5: removal of byte strings that repeat across the corpus, by sparse suffix sorting.

Any string of `least` bytes holds an anchor: the smallest hash of its `gram`-byte substrings (winnowing), which its content
alone decides. Equal strings so share an anchor, and only suffixes at anchors whose gram recurs need to be sorted. Anchors
whose whole surroundings recur are settled by a grouped count of (gram, surroundings), 128 bits of hashes. The others are dealt
by gram, frequent grams by what stands next to them, to tasks that order the text to their right and, backwards, to their
left by deep-shallow sorting, and read the repeats off the common prefixes.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import MOST_KEYS, batch, narrowed, saved, scratch
from chronofold.llm.hashing import BYTE, U, mix, powers
from chronofold.llm.suffixes import reaches

GRAM = 64


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """The place of the (first) smallest value of each window of `width` neighbours, without repeats."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    # Running minima from both ends of blocks; a window spans the end of one block and the start of the next.
    blocks = -(-len(h) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(h)] = h
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:n], ahead[width - 1 : width - 1 + n])
    # A place is chosen if it holds the minimum of a window over it; of equal ones, all that some window has as minimum.
    grown = np.full(len(h), 0, dtype=np.uint64)
    top = np.full(blocks * width + width, 0, dtype=np.uint64)
    top[width - 1 : width - 1 + n] = least
    m = -(-len(top) // width)
    wide = np.zeros(m * width, dtype=np.uint64)
    wide[: len(top)] = top
    grid = wide.reshape(m, width)
    up = np.maximum.accumulate(grid, axis=1).ravel()
    down = np.maximum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    # windows that hold place p start at p - width + 1 .. p, and lie at p .. p + width - 1 in `top`
    size = min(len(h), len(wide) - width + 1)
    grown[:size] = np.maximum(down[:size], up[width - 1 : width - 1 + size])
    return np.flatnonzero(h == grown)


def anchors(data: bytes, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash of the gram there, hash of the surroundings) of a text's anchors."""
    n = len(data)
    if n < least:
        return (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    b = np.frombuffer(data, dtype=np.uint8)
    with np.errstate(over="ignore"):
        p = powers(n + 1)
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(BYTE[b] * p[:n], dtype=np.uint64)])
        top = p[n]
        # Sums are brought to one common power, so that equal strings at different places have equal hashes.
        lift = top * inverse_powers(n)
        h = mix((total[gram:] - total[:-gram]) * lift[: n - gram + 1] * lift_base(n))
        at = window_minima(h, least - gram + 1)
        low, high = np.maximum(at - (least - gram), 0), np.minimum(at + least, n)
        around = (total[high] - total[low]) * lift[low] * lift_base(n)
        around = mix(around + (high - low).astype(np.uint64) * U(0xD6E8FEB86659FD93) + (at - low).astype(np.uint64) * U(0xA24BAED4963EE407))
    return at, h[at].view(np.int64), around.view(np.int64)


INVERSE = U(pow(int(powers(2)[1]), -1, 1 << 64))
_INVERSES = np.ones(1, dtype=np.uint64)


def inverse_powers(n: int) -> np.ndarray:
    """The inverses of the powers of the base, modulo 2^64."""
    global _INVERSES
    if len(_INVERSES) < n:
        size = max(n, 2 * len(_INVERSES), 1024)
        with np.errstate(over="ignore"):
            _INVERSES = np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(size - 1, INVERSE)]), dtype=np.uint64)
    return _INVERSES[:n]


def lift_base(n: int) -> np.uint64:
    """Undoes the common power of a text of n bytes."""
    return U(pow(int(INVERSE), n, 1 << 64))


ANCHOR = pa.schema([("fp", pa.int64()), ("around", pa.int64()), ("unit", pa.binary()), ("place", pa.int32())])


def anchor_rows(texts: DataFrame, least: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for unit, text in zip(b.column(0), b.column(1), strict=True):
                at, fp, around = anchors((text.as_py() or "").encode(), least, gram)
                for k in range(0, len(at), 50_000):
                    part = slice(k, k + 50_000)
                    size = len(at[part])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(fp[part]), pa.array(around[part]), pa.array([unit.as_py()] * size, type=pa.binary()), pa.array(at[part].astype(np.int32))],
                        schema=ANCHOR,
                    )

    return texts.select("unit", "text").mapInArrow(run, "fp long, around long, unit binary, place int")


def surroundings(texts: DataFrame, least: int, gram: int) -> DataFrame:
    """fp, unit, place, with what stands left of the place (backwards) and from it on, of texts(unit, text, places)."""
    schema = pa.schema([("fp", pa.int64()), ("unit", pa.binary()), ("place", pa.int32()), ("left", pa.binary()), ("right", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for unit, text, places in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                data = text.as_py().encode()
                for p in places:
                    at = p["place"]
                    left, right = data[max(0, at - (least - gram)) : at][::-1], data[at : at + least]
                    for column, v in zip(out, (p["fp"], unit, at, left, right), strict=True):
                        column.append(v)
                if len(out[0]) > 5_000:
                    yield batch(out, schema)
                    out = [[], [], [], [], []]
            yield batch(out, schema)

    return texts.select("unit", "text", "places").mapInArrow(run, "fp long, unit binary, place int, left binary, right binary")


SPAN = pa.schema([("unit", pa.binary()), ("low", pa.int32()), ("high", pa.int32())])


#: Anchors of one surrounding from which on it is not dealt to one task.
CROWD = 2_000
#: Places that one task sorts together; a group of more is split by the bytes next to what it shares.
GROUP = 20_000


def grouped(rows: DataFrame, least: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """rows(fp, unit, place, left, right) with `group` and `core`, so that any two places of a repeat share a group; and spans.

    A group shares its gram. If it is large it is split: a string of `least` bytes over bytes that all places share goes at
    least half of what is missing to the right or to the left of them. So every place goes into the group of its next bytes
    to the right and into that of those to the left (if it has so many), and what repeats meets again in one of the two.
    This goes on, the missing part halving, until groups are small or nothing is missing: what such a group shares then is
    a span of each of its places, without sorting.
    """
    todo = rows.select(F.col("fp").alias("group"), F.lit(0).alias("back"), F.lit(gram).alias("core"), "unit", "place", "left", "right")
    done: list[DataFrame] = []
    missing = least - gram
    while True:
        sizes = todo.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        large = saved(sizes.filter(F.col("n") > GROUP).select("group"))
        done.append(todo.join(sizes.filter(F.col("n") <= GROUP).select("group"), "group", "left_semi"))
        if large.isEmpty() or not missing:
            shared = todo.join(large, "group", "left_semi").select("unit", (F.col("place") - F.col("back")).alias("low"), (F.col("place") + F.col("core")).alias("high"))
            return reduce(DataFrame.unionByName, done), shared
        half = -(-missing // 2)
        missing -= half
        hot = todo.join(large, "group", "left_semi")
        right = F.when(F.octet_length("right") >= F.col("core") + half, F.substring("right", F.col("core") + 1, F.lit(half)))
        left = F.when(F.octet_length("left") >= F.col("back") + half, F.substring("left", F.col("back") + 1, F.lit(half)))
        sides = [
            hot.withColumn("key", key).withColumn(grown, F.col(grown) + half).filter("key is not null").withColumn("group", F.xxhash64("group", F.lit(grown), "key")).drop("key")
            for key, grown in ((right, "core"), (left, "back"))
        ]
        todo = saved(sides[0].unionByName(sides[1]))


def sorted_repeats(rows: DataFrame, least: int, gram: int) -> DataFrame:
    """Spans (unit, low, high) that repeat, of rows(fp, unit, place, left, right): a group's suffixes meet in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True))
        out: list[list] = [[], [], []]
        for _, group in itertools.groupby(stream, key=lambda r: r[0]):
            _, cores, units, places, lefts, rights = map(list, zip(*group, strict=True))
            start = cores[0] if all(r[: cores[0]] == rights[0][: cores[0]] for r in rights) else 0
            for unit, place, (left, right) in zip(units, places, reaches(lefts, rights, least, start), strict=True):
                if right:
                    for column, v in zip(out, (unit, place - left, place + right), strict=True):
                        column.append(v)
            if len(out[0]) > 5_000:
                yield batch(out, SPAN)
                out = [[], [], []]
        yield batch(out, SPAN)

    groups, shared = grouped(rows, least, gram)
    ordered = groups.repartition("group").sortWithinPartitions("group", "unit", "place")
    return ordered.select("group", "core", "unit", "place", "left", "right").mapInArrow(run, "unit binary, low int, high int").unionByName(shared)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with `unit`, a key of its text (128 bits of SHA-256); null texts are empty."""
    return docs.withColumn("unit", F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32)))


def repeated_spans(docs: DataFrame, least: int = 200, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """What repeats in docs(doc_id, text): (units that several rows have, spans (unit, low, high) of the others).

    A text of `least` bytes or more that several rows have repeats as a whole. Spans may overlap and pass a text's ends.
    """
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    whole = saved(
        rows.select("doc_id", "unit").groupBy("unit").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first")).filter("copies > 1")
    )
    # Of a repeated text one row is enough: what it holds recurs. A row that repeats its doc_id too does no harm.
    few = whole.limit(MOST_KEYS + 1).count() <= MOST_KEYS
    texts = rows.filter(F.octet_length("text") >= least).join(F.broadcast(whole) if few else whole, "unit", "left")
    texts = texts.filter("copies is null or doc_id <=> first").select("unit", "text")
    with scratch(docs.sparkSession) as own:  # the anchors whose gram is single are most of them and go again
        found = saved(anchor_rows(texts, least, gram))
        # Written first, so that the join has an exchange of its own on either side and its hot grams can be split.
        again = saved(found.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fp"))
        found = saved(found.join(again, "fp"))
        own.pop()
    kinds = found.groupBy("fp", "around").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("unit", "place")).alias("one"))
    kinds = saved(kinds.select("fp", "around", "n", "one.unit", "one.place"))
    # Surroundings with a larger share of the rows than one in MOST_KEYS are few enough for a broadcast: no task gets them all.
    crowd = max(CROWD, (kinds.agg(F.sum("n")).first()[0] or 0) // MOST_KEYS + 1)
    both = ["fp", "around"]
    hot, mild = kinds.filter(F.col("n") > crowd).select(*both), kinds.filter(f"n > 1 and n <= {crowd}").select(*both)
    settled = found.join(F.broadcast(hot), both).unionByName(found.join(F.broadcast(hot), both, "left_anti").join(mild, both))
    settled = settled.select("unit", (F.col("place") - (least - gram)).alias("low"), (F.col("place") + least).alias("high"))
    open_grams = kinds.groupBy("fp").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("low")).filter("kinds > 1 and low = 1").select("fp")
    asked = kinds.join(open_grams, "fp")
    asked = saved(asked.groupBy("unit").agg(F.collect_list(F.struct("fp", "place")).alias("places")))  # bounded by the text
    near = narrowed(texts, asked, "unit").join(asked, "unit")
    spans = settled.unionByName(sorted_repeats(saved(surroundings(near, least, gram)), least, gram))
    spans = spans.join(whole.select("unit"), "unit", "left_anti")
    return whole, saved(spans.groupBy("unit").agg(F.collect_list(F.struct("low", "high")).alias("spans")))


def merged(spans: list[dict], size: int, least: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes that spans cover; parts of spans outside the text do not count."""
    out: list[list[int]] = []
    for low, high in sorted((max(0, s["low"]), min(size, s["high"])) for s in spans):
        if high - low < least:
            continue
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [tuple(x) for x in out]


def report(docs: DataFrame, least: int = 200, gram: int = GRAM) -> DataFrame:
    """Removes from every row of docs(doc_id, text) the bytes of strings of `least` bytes that also start anywhere else.

    Returns per row doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of the bytes that are left.
    Strings are judged on the input; overlaps and repeats within one text count; matches never cross texts. A null text is
    empty. Rows that repeat a text of `least` bytes or more (or a whole row) lose all of it; shorter texts lose nothing.
    """
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    whole, spans = repeated_spans(docs, least, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, runs, digests = [], [], []
            for text, own in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                data = text.as_py().encode()
                cut = merged(own, len(data), least)
                digest, at = hashlib.sha256(), 0
                for low, high in cut:
                    digest.update(data[at:low])
                    at = high
                digest.update(data[at:])
                removed.append(sum(h - low for low, h in cut))
                runs.append(len(cut))
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(removed, type=pa.int64()), pa.array(runs, type=pa.int64()), pa.array(digests, type=pa.string())],
                names=["unit", "removed", "runs", "digest"],
            )

    some = narrowed(rows, spans, "unit").join(spans, "unit").select("unit", "text", "spans")
    cut = some.mapInArrow(run, "unit binary, removed long, runs long, digest string")
    sizes = rows.select("doc_id", "unit", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    out = sizes.join(cut, "unit", "left").join(whole.select("unit", "copies"), "unit", "left")
    gone = F.col("copies").isNotNull() & (F.col("n_bytes") >= least)
    return out.select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("digest", "sha")).alias("kept_sha256"),
    )


def cleaned(docs: DataFrame, least: int = 200, gram: int = GRAM) -> DataFrame:
    """docs with the repeated bytes of `text` removed, and n_chars, where there is such a column, counted anew.

    As report(), but every row stays, texts may become empty, and a character of which only some bytes repeat stays.
    Null texts stay null. Other columns pass as they are.
    """
    whole, spans = repeated_spans(docs, least, gram)
    names = docs.columns
    others = F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in names if c != "text"])
    rows = keyed(docs.select(others.alias("row"), "text")).withColumn("size", F.octet_length("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, own in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                data, at, parts = text.as_py().encode(), 0, []
                for low, high in merged(own, len(data), least):
                    while low < high and data[low] & 0xC0 == 0x80:  # inside a character
                        low += 1
                    while high > low and high < len(data) and data[high] & 0xC0 == 0x80:
                        high -= 1
                    parts.append(data[at:low])
                    at = high
                out.append(b"".join([*parts, data[at:]]).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, type=pa.string())], names=["unit", "left_over"])

    single = keyed(docs.select("text"))
    some = narrowed(single, spans, "unit").join(spans, "unit").select("unit", "text", "spans")
    cut = some.mapInArrow(run, "unit binary, left_over string")
    out = rows.join(cut, "unit", "left").join(whole.select("unit", "copies"), "unit", "left")
    gone = F.col("copies").isNotNull() & (F.col("size") >= least)
    text = F.when(gone, F.lit("")).otherwise(F.coalesce("left_over", "text"))
    out = out.select("row", text.alias("text"))
    kinds = dict(docs.dtypes)
    fresh = {"text": F.col("text"), "n_chars": F.char_length("text").cast(kinds.get("n_chars", "long"))}
    return out.select(*[fresh.get(c, F.col("row")[c]).alias(c) for c in names])

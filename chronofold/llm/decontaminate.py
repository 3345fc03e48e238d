"""Operator 6: benchmark decontamination with training suffix arrays.

Each task takes its share of the documents in shards of bounded size, writes them as word numbers of the benchmark's
vocabulary, and sorts the suffixes that can match (those that begin with enough benchmark words) by all their words into a
suffix array. Every suffix of every benchmark item is looked up by binary search: the suffixes that share its first words
stand side by side. Common prefixes of the pairs found there are the longest verbatim matches, with their places in
document and item. A benchmark beyond the broadcast bound is taken in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import alnum_words, batch

#: Bytes of benchmark text in one broadcast block, and words in one suffix array.
BLOCK_BYTES = 16 << 20
SHARD_WORDS = 1_000_000
#: Pairs of places whose common prefixes are compared at once.
PAIRS = 200_000


@dataclass
class Probe:
    """A block of the benchmark: its items' words as numbers, each item closed by a 0, and their suffixes."""

    numbers: dict[bytes, int]
    words: np.ndarray  # all items one after another
    items: list[str]
    item: np.ndarray  # per suffix: its item and first word there, its place in `words`, and how many words must match
    within: np.ndarray
    start: np.ndarray
    need: np.ndarray

    @property
    def shortest(self) -> int:
        return int(self.need.min()) if len(self.need) else 0


def probe(rows: list[tuple[object, str | None]], width: int) -> Probe:
    """Suffixes that a whole window begins: of `width` words, or all of an item's if it has fewer."""
    texts = [(str(i), ws) for i, t in rows if i is not None and (ws := alnum_words(t))]
    numbers = {w: k + 1 for k, w in enumerate(sorted({w for _, ws in texts for w in ws}))}
    sizes = np.array([len(ws) for _, ws in texts], dtype=np.int64)
    first = np.cumsum(sizes + 1) - sizes - 1
    words = np.array([n for _, ws in texts for n in [*(numbers[w] for w in ws), 0]], dtype=np.int64)
    need = np.minimum(sizes, width)
    count = sizes - need + 1
    item = np.repeat(np.arange(len(texts)), count)
    within = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
    return Probe(numbers, words, [i for i, _ in texts], item, within, first[item] + within if len(item) else item, need[item] if len(item) else item)


def suffix_array(ids: np.ndarray, least: int) -> np.ndarray:
    """Starts of the suffixes with `least` words or more before the next 0, sorted by all words up to it.

    Ranks by the first word are refined to the first 2, 4, 8, ... words (prefix doubling) until they tell all apart or no
    run of words is longer.
    """
    stops = np.flatnonzero(np.concatenate([ids == 0, [True]]))
    run = stops[np.searchsorted(stops, np.arange(len(ids)))] - np.arange(len(ids))
    head = np.flatnonzero((run >= least) & (np.concatenate([[0], run[:-1]]) <= 1))  # first words of long enough runs
    if not least or not len(head):
        return np.zeros(0, dtype=np.int64)
    size = run[head]
    at = np.repeat(head - (np.cumsum(size) - size), size) + np.arange(size.sum())  # all words of these runs
    rank = np.zeros(len(ids) + 1, dtype=np.int64)
    rank[at] = ids[at]
    k, distinct = 1, 0
    while k < size.max() and distinct < len(at):
        pair = rank[at] * (len(ids) + int(ids.max()) + 2) + rank[np.minimum(at + k, len(ids))]
        values, new = np.unique(pair, return_inverse=True)
        # Ranks of k words reach past a run's end only through its 0, which ends every comparison.
        rank[at] = new + 1
        distinct, k = len(values), 2 * k
    starts = at[run[at] >= least]
    return starts[np.argsort(rank[starts], kind="stable")]


def common_prefix(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
    """Words that a from i and b from j share, up to the first 0 (or to `most`)."""
    out = np.zeros(len(i), dtype=np.int64)
    left = np.arange(len(i))
    depth = 0
    while len(left):
        if most is not None:
            left = left[most[left] > depth]
        x = a[np.minimum(i[left] + depth, len(a) - 1)]
        left = left[(x == b[np.minimum(j[left] + depth, len(b) - 1)]) & (x != 0)]
        depth += 1
        out[left] = depth
    return out


def ranges(ids: np.ndarray, array: np.ndarray, p: Probe) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix, low, high) of the benchmark suffixes of which array[low:high] share the words that must match."""
    firsts = ids[array]
    first = p.words[p.start]
    low, high = np.searchsorted(firsts, first, "left"), np.searchsorted(firsts, first, "right")
    asked = np.flatnonzero(high > low)

    def bound(after: bool) -> np.ndarray:
        a, b = low[asked].copy(), high[asked].copy()
        while True:
            open_ = np.flatnonzero(a < b)
            if not len(open_):
                return a
            middle = (a[open_] + b[open_]) // 2
            q = asked[open_]
            same = common_prefix(ids, array[middle], p.words, p.start[q], p.need[q])
            here, want = ids[np.minimum(array[middle] + same, len(ids) - 1)], p.words[p.start[q] + same]
            below = np.where(same >= p.need[q], after, here < want)
            a[open_] = np.where(below, middle + 1, a[open_])
            b[open_] = np.where(below, b[open_], middle)

    start, end = bound(False), bound(True)
    hit = end > start
    return asked[hit], start[hit], end[hit]


Match = tuple[str, int, int, int]  # item, first word in the item, first word in the document, words


MATCH = "struct<item: string, item_word: long, word: long, words: long>"
ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
        ("matches", pa.list_(pa.struct([("item", pa.string()), ("item_word", pa.int64()), ("word", pa.int64()), ("words", pa.int64())]))),
    ]
)


def shard_rows(docs: list[tuple[int | None, list[bytes]]], p: Probe) -> list[tuple]:
    """(doc_id, n_words, hit words, items, matches) of the documents of one shard."""
    get = p.numbers.get
    sizes = np.array([len(ws) for _, ws in docs], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(sizes + 1)])  # a 0 after each document
    ids = np.zeros(int(first[-1]), dtype=np.int64)
    for (_, ws), at in zip(docs, first, strict=False):
        ids[at : at + len(ws)] = [get(w, 0) for w in ws]
    array = suffix_array(ids, p.shortest)
    covered = np.zeros(len(ids) + 1, dtype=np.int64)
    items: list[set[str]] = [set() for _ in docs]
    matches: list[list[Match]] = [[] for _ in docs]
    suffix, low, high = ranges(ids, array, p) if len(array) else (np.zeros(0, dtype=np.int64),) * 3
    before, done = np.cumsum(high - low), 0
    while done < len(suffix):  # so many benchmark suffixes that about PAIRS places are held
        upto = max(done + 1, int(np.searchsorted(before, (before[done - 1] if done else 0) + PAIRS, "right")))
        many = (high - low)[done:upto]
        q = np.repeat(suffix[done:upto], many)
        place = array[np.repeat(low[done:upto], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        doc = np.searchsorted(first, place, "right") - 1
        np.add.at(covered, place, 1)
        np.add.at(covered, place + p.need[q], -1)
        for d, i in np.unique(np.stack([doc, p.item[q]]), axis=1).T.tolist():
            items[d].add(p.items[i])
        # A match is longest to the left if the words before differ; its length is the common prefix.
        starts = (p.within[q] == 0) | (place == first[doc]) | (ids[place - 1] != p.words[p.start[q] - 1])
        q, place, doc = q[starts], place[starts], doc[starts]
        length = common_prefix(ids, place, p.words, p.start[q])
        for d, i, k, at, n in zip(doc.tolist(), p.item[q].tolist(), p.within[q].tolist(), (place - first[doc]).tolist(), length.tolist(), strict=True):
            matches[d].append((p.items[i], k, at, n))
        done = upto
    hit = np.cumsum(covered)[:-1] > 0
    out = []
    for d, (doc_id, _) in enumerate(docs):
        words = set(np.flatnonzero(hit[first[d] : first[d + 1]]).tolist())
        out.append((doc_id, int(sizes[d]), words, sorted(items[d]), sorted(set(matches[d]))))
    return out


def scan(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Looks every window of benchmark(item_id, text) up in every row of docs(doc_id, text).

    Returns per row doc_id, n_words, n_hit (words inside any window's occurrence), items (those found, sorted) and
    matches (item, item_word, word, words: the longest verbatim ones). Words are folded runs of letters, digits and
    non-ASCII characters. Null and empty texts have no words; items of fewer than `width` words are one window, items
    without words or id none. Repeated rows are scanned each. Both tables may be empty.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // block_bytes) + 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    state = "n_words long, items array<string>, matches array<" + MATCH + ">, hit array<int>"
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        held = spark.sparkContext.broadcast(probe([tuple(r) for r in part.collect()], width))  # block_bytes of text, about
        rows = block_pass(rows, held, first=k == 0, last=k == blocks - 1, kind=f"doc_id long, text string, {state}")
    return rows


def block_pass(rows: DataFrame, held: object, first: bool, last: bool, kind: str) -> DataFrame:
    """One block over all rows; between blocks the hit words of a row travel with it, without a shuffle."""
    match = ARROW.field("matches").type
    middle = pa.schema(
        [("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("matches", match), ("hit", pa.list_(pa.int32()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value

        def done(shard: list, before: list) -> pa.RecordBatch:
            out: list[list] = [[] for _ in (ARROW if last else middle)]
            for (doc_id, n, words, items, found), b in zip(shard_rows(shard, p), before, strict=True):
                if not first:
                    words |= set(b[3])
                    items = sorted({*items, *b[1]})
                    found = [*(tuple(m.values()) for m in b[2]), *found]
                found = [dict(zip(("item", "item_word", "word", "words"), m, strict=True)) for m in found]
                values = (doc_id, n, len(words), items, found) if last else (doc_id, b[0], n, items, found, sorted(words))
                for column, v in zip(out, values, strict=True):
                    column.append(v)
            return batch(out, ARROW if last else middle)

        shard, before, size = [], [], 0
        for b in batches:
            kept = list(zip(*(b.column(i).to_pylist() for i in range(3, 6)), strict=True)) if not first else None
            for k, (doc_id, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1), strict=True)):
                text = text.as_py()
                words = alnum_words(text)
                shard.append((doc_id, words))
                before.append((text if not last else None, *(kept[k] if kept else (None, None, None))))
                size += len(words) + 1
                if size >= SHARD_WORDS:
                    yield done(shard, before)
                    shard, before, size = [], [], 0
        if shard:
            yield done(shard, before)

    out = f"doc_id long, n_words long, n_hit long, items array<string>, matches array<{MATCH}>" if last else kind
    return rows.mapInArrow(run, out)


def report(scanned: DataFrame) -> DataFrame:
    """scan()'s rows with the number of items, a digest of their ids, and the verdict."""
    return scanned.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), F.array_max(F.transform("matches", lambda m: m["words"])).alias("longest_match"),
    )

"""Ranked lexical search by a hybrid of term-at-a-time and document-at-a-time evaluation.

Every document is counted once against the queries' vocabulary. Tasks then take their documents in blocks and invert each
block. Per query the short lists of a block are summed term at a time into accumulators; these are one more iterator, with
the largest sum as its bound, beside the long lists. Document at a time the lists whose bounds together cannot lift a
document among the best are only looked up, for documents that the other iterators propose and that can still get there.
All scores are 64-bit integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm.common import alnum_words, saved

#: Bytes of query text in one broadcast block.
BLOCK_BYTES = 16 << 20
#: A block of documents ends at so many documents or postings; a list is long from this share of its documents on.
BLOCK_DOCS, BLOCK_POSTINGS, LONG = 32_768, 2_000_000, 1 / 16
#: Documents that one step of the document-at-a-time walk covers.
STRIDE = 8_192

COUNTED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])
BEST = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def counted(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms of the text), terms (numbers of those asked for) and tfs, of every row that has a term."""
    held = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for b in batches:
            out: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = alnum_words(text.as_py())
                if words:
                    tf = sorted((known[w], n) for w, n in Counter(words).items() if w in known)
                    out.append((doc_id, len(words), [t for t, _ in tf], [n for _, n in tf]))
            columns = zip(*out, strict=True) if out else [[]] * len(COUNTED)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, COUNTED, strict=True)], schema=COUNTED)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


class Best:
    """The k best documents of one item so far; equal scores by ascending doc_id, missing ids last."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids, self.lacks = k, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)

    @property
    def floor(self) -> int:
        """Documents below this score cannot enter."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def take(self, scores: np.ndarray, ids: np.ndarray, lacks: np.ndarray) -> None:
        scores, ids, lacks = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.lacks, lacks)))
        order = np.lexsort((ids, lacks, -scores))[: self.k]
        self.scores, self.ids, self.lacks = scores[order], ids[order], lacks[order]


class Block:
    """An inverted block of documents: for each term its documents, ascending, and its score in each."""

    def __init__(self, ids: list, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, total_docs: int, total_terms: int) -> None:
        self.lacks = np.array([i is None for i in ids])
        self.ids = np.array([0 if i is None else i for i in ids], dtype=np.int64)
        length = 10 + (90 * n * total_docs) // total_terms
        doc = np.repeat(np.arange(len(n), dtype=np.int64), sizes)
        score = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * length[doc]))
        order = np.argsort(terms, kind="stable")
        self.doc, self.score, terms = doc[order], score[order], terms[order]
        self.terms, self.first = np.unique(terms, return_index=True)
        self.end = np.append(self.first[1:], len(terms))
        self.bound = np.maximum.reduceat(self.score, self.first) if len(terms) else self.first
        self.place = {int(t): i for i, t in enumerate(self.terms)}

    def search(self, query: np.ndarray, best: Best, share: float = LONG, stride: int = STRIDE) -> None:
        """Adds the block's documents to an item's best ones."""
        lists = [self.place[t] for t in query.tolist() if t in self.place]
        short = [i for i in lists if self.end[i] - self.first[i] < share * len(self.ids)]
        iterators = [(self.doc[self.first[i] : self.end[i]], self.score[self.first[i] : self.end[i]], int(self.bound[i])) for i in lists if i not in set(short)]
        if short:  # term at a time: one accumulator for each document of the short lists
            at = np.concatenate([np.arange(self.first[i], self.end[i]) for i in short])
            docs, place = np.unique(self.doc[at], return_inverse=True)
            sums = np.zeros(len(docs), dtype=np.int64)
            np.add.at(sums, place, self.score[at])
            iterators.append((docs, sums, int(sums.max())))
        iterators.sort(key=lambda x: x[2])
        upto = np.cumsum([x[2] for x in iterators])
        for start in range(0, len(self.ids) if iterators else 0, stride):
            # Lists before `first` cannot lift a document to the floor by themselves: they propose none.
            first = int(np.searchsorted(upto, best.floor, side="left"))
            if first == len(iterators):
                return
            parts = []
            for docs, scores, _ in iterators[first:]:
                low, high = np.searchsorted(docs, (start, start + stride))
                parts.append((docs[low:high], scores[low:high]))
            docs, place = np.unique(np.concatenate([d for d, _ in parts]), return_inverse=True)
            sums = np.zeros(len(docs), dtype=np.int64)
            np.add.at(sums, place, np.concatenate([s for _, s in parts]))
            for k in range(first - 1, -1, -1):
                able = sums + upto[k] >= best.floor
                docs, sums = docs[able], sums[able]
                of, scores, _ = iterators[k]
                at = np.minimum(np.searchsorted(of, docs), len(of) - 1)
                sums += np.where(of[at] == docs, scores[at], 0)
            able = sums >= best.floor
            if able.any():
                best.take(sums[able], self.ids[docs[able]], self.lacks[docs[able]])


def weights_of(df: np.ndarray, total_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * total_docs + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)


def ranked(postings: DataFrame, queries: list[np.ndarray], weights: np.ndarray, total_docs: int, total_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of each task's share for every query; nothing else leaves a task."""
    held = postings.sparkSession.sparkContext.broadcast((queries, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = held.value
        best = [Best(k) for _ in queries]
        parts: list[tuple] = []
        docs = pairs = 0

        def settle() -> None:
            nonlocal parts, docs, pairs
            if pairs:
                block = Block([i for x in parts for i in x[0]], *(np.concatenate([x[c] for x in parts]) for c in range(1, 5)), weights, total_docs, total_terms)
                for query, b in zip(queries, best, strict=True):
                    block.search(query, b)
            parts, docs, pairs = [], 0, 0

        for b in batches:
            for start in range(0, b.num_rows, 1024):
                x = b.slice(start, 1024)
                sizes = np.diff(x.column("terms").offsets.to_numpy()).astype(np.int64)
                terms, tfs = (x.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "tfs"))
                parts.append((x.column("doc_id").to_pylist(), x.column("n").to_numpy(), sizes, terms, tfs))
                docs, pairs = docs + x.num_rows, pairs + len(terms)
                if docs >= BLOCK_DOCS or pairs >= BLOCK_POSTINGS:
                    settle()
        settle()
        for i, x in enumerate(best):
            if len(x.ids):
                ids = pa.array(x.ids, pa.int64(), mask=x.lacks)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x.ids), i, dtype=np.int32)), ids, pa.array(x.scores)], schema=BEST)

    return postings.mapInArrow(run, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of docs(doc_id, text) for each row of items(item_id, text).

    Terms are runs of letters, digits and non-ASCII characters, A-Z folded; null has none. Each row of docs is a document,
    also repeated ones; equal scores go by ascending doc_id, rows without one last. Rows of one item_id are one item with
    the terms of all of them; rows without an item_id are none. Documents without a term count nowhere; items without terms,
    or whose terms no document holds, have no rows; both tables may be empty; other columns are ignored. Items beyond
    block_bytes of text are taken in blocks, each with its own pass over the documents.
    """
    spark = docs.sparkSession
    items = items.filter("item_id is not null").select("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // block_bytes) + 1
    found = None
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        terms: dict[object, set[bytes]] = {}
        for item, text in (tuple(r) for r in part.collect()):  # block_bytes of text, about
            terms.setdefault(item, set()).update(alnum_words(text))
        numbers = {w: i for i, w in enumerate(sorted(set().union(*terms.values())))}
        postings = saved(counted(docs, numbers))
        facts = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(numbers), dtype=np.int64)
        for t, n in postings.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1))).collect():
            df[t] = n
        names = list(terms)
        queries = [np.array(sorted(numbers[w] for w in terms[i]), dtype=np.int64) for i in names]
        best = ranked(postings, queries, weights_of(df, facts[0]), facts[0], max(1, facts[1]), k)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        named = spark.createDataFrame([(i, x) for i, x in enumerate(names)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        best = best.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")
        found = best if found is None else found.unionByName(best)
    return found

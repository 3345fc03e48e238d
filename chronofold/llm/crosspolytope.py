"""Approximate nearest neighbours by cross-polytope hashing.

Vectors become unit vectors (one more coordinate evens out their lengths, so that the largest inner product is the
smallest angle). Each table turns them by fast Hadamard pseudo-rotations and hashes them to the nearest signed axis; with
many rows a second, shorter rotation splits each axis. A query probes the axes nearest to it in every table, and all rows
of the probed buckets are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm.common import MOST_KEYS, saved

#: Queries whose exact neighbours set the number of probes, and the share of these neighbours that probes must reach.
SAMPLE, TARGET = 128, 0.96
#: Rows of a bucket on average, above which buckets are split by the second rotation.
CROWD = 512
#: Queries held at once against a bucket, and rows of a bucket that one task reads for them; larger ones are dealt in blocks.
HELD, CHUNK = 2048, 65_536


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of the rows of x, whose width is a power of two."""
    n, width, h = len(x), x.shape[1], 1
    while h < width:
        y = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


@dataclass(frozen=True)
class Tables:
    """The hash functions of one index: the same ones for the same arguments, in every process.

    longest: the largest length of a vector; second: axes of the second rotation, 0 for none.
    """

    dim: int
    longest: float
    tables: int = 8
    second: int = 0
    seed: int = 20_240_611

    @property
    def width(self) -> int:
        return 1 << max(1, self.dim).bit_length()  # holds the dimensions and one more

    @property
    def buckets(self) -> int:
        return 2 * self.width * max(1, 2 * self.second)

    def units(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        """Rows as unit vectors of full width; a query's added coordinate is 0, so that angles order as inner products."""
        out = np.zeros((len(vectors), self.width))
        if query:
            out[:, : self.dim] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        else:
            out[:, : self.dim] = vectors / self.longest
            out[:, self.dim] = np.sqrt(np.maximum(0.0, 1.0 - (out * out).sum(axis=1)))
        return out

    def axes(self, units: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """For each table the rows' coordinates on all signed axes of its rotations."""
        rng = np.random.Generator(np.random.PCG64(self.seed))
        for _ in range(self.tables):
            turned = []
            for wanted in (self.width, self.second):
                x = units
                for signs in rng.choice([-1.0, 1.0], (3, self.width)):
                    x = hadamard(x * signs) if wanted else x
                turned.append(np.concatenate([x[:, :wanted], -x[:, :wanted]], axis=1) if wanted else None)
            yield turned[0], turned[1]

    def keys(self, units: np.ndarray) -> np.ndarray:
        """(row, table) -> the bucket of each row, numbered over all tables."""
        out = np.empty((len(units), self.tables), dtype=np.int64)
        for t, (a, b) in enumerate(self.axes(units)):
            at = a.argmax(axis=1)
            if b is not None:
                at = at * b.shape[1] + b.argmax(axis=1)
            out[:, t] = t * self.buckets + at
        return out

    @staticmethod
    def gaps(a: np.ndarray, b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """How far each axis is from being a row's nearest; buckets are probed by the sum of both."""
        first = (a.max(axis=1, keepdims=True) - a) ** 2
        return first, np.zeros((len(a), 1)) if b is None else (b.max(axis=1, keepdims=True) - b) ** 2

    def probes(self, units: np.ndarray, n: int) -> np.ndarray:
        """(row, table, probe) -> the n nearest buckets of each row in each table."""
        n = min(n, self.buckets)
        out = np.empty((len(units), self.tables, n), dtype=np.int64)
        for t, (a, b) in enumerate(self.axes(units)):
            first, second = self.gaps(a, b)
            for i in range(len(units)):
                # A pair of axes is among the n nearest only if each of them is among its own n nearest.
                p, q = np.argsort(first[i], kind="stable")[:n], np.argsort(second[i], kind="stable")[:n]
                sums = (first[i][p][:, None] + second[i][q][None, :]).ravel()
                best = np.argsort(sums, kind="stable")[:n]
                out[i, t] = t * self.buckets + p[best // len(q)] * second.shape[1] + q[best % len(q)]
        return out

    def places(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """(row, table) -> how many buckets a query (one unit) may probe before the row's own, equally near ones among them."""
        found = self.keys(rows)
        out = np.empty(found.shape, dtype=np.int64)
        for t, (a, b) in enumerate(self.axes(query[None, :])):
            first, second = (x[0] for x in self.gaps(a, b))
            i, j = np.divmod(found[:, t] - t * self.buckets, len(second))
            own, ordered = first[i] + second[j], np.sort(second)
            nearer = np.searchsorted(ordered, (own[:, None] - first[None, :]).ravel() + 1e-12, side="right")
            out[:, t] = nearer.reshape(len(own), -1).sum(axis=1) - 1
        return out


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A column of lists of `dim` doubles as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def nearest_rows(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, scores) of each query's k best rows by inner product, then by id."""
    scores = queries @ vectors.T
    n = min(len(ids), k + 4)  # products of matrices round differently from block to block: some more are scored alike everywhere
    at = np.argpartition(-scores, n - 1, axis=1)[:, :n]
    exact = (queries[:, None, :] * vectors[at]).sum(axis=2)
    order = np.lexsort((ids[at], -exact), axis=1)[:, :k]
    at, exact = np.take_along_axis(at, order, 1), np.take_along_axis(exact, order, 1)
    if n < len(ids):  # more rows than that may share the last place: the smaller ids must come first
        last = exact[:, -1] - 1e-12 * np.abs(exact[:, -1])
        for i in np.flatnonzero((scores >= last[:, None]).sum(axis=1) > n):
            tied = np.flatnonzero(scores[i] >= last[i])
            own = (queries[i] * vectors[tied]).sum(axis=1)
            best = np.lexsort((ids[tied], -own))[:k]
            at[i], exact[i] = tied[best], own[best]
    return at, exact


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of rows(vec_id, embedding) that take part.

    Left out: rows without a vec_id, vectors that are null, zero, hold null or non-finite components or have another number
    of components than most. Of several vectors under one vec_id the smallest, in the order of arrays, counts.
    """
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    fit = "vec_id is not null and vector is not null and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(vector, x -> x <> 0)"
    rows = rows.filter(fit)
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    return rows.filter(F.size("vector") == (most["size"] if most else 0)).groupBy("vec_id").agg(F.min("vector").alias("vector"))


FOUND = pa.schema([("query", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])
SCORED = "query long, ids array<long>, scores array<double>"


def fitted_probes(classes: DataFrame, tables: Tables, k: int, sample: int, target: float) -> int:
    """Probes a table that reach `target` of the exact k neighbours of at most `sample` queries, found in one scan of all rows."""
    asked = classes.filter("asked").orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "vector").collect()
    if not asked:
        return 1
    ids = np.array([r["id"] for r in asked])
    queries = np.array([r["vector"] for r in asked])
    units = tables.units(queries, query=True)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_ids, held = np.zeros(0, dtype=np.int64), np.zeros((0, tables.dim))
        for b in batches:
            all_ids = np.concatenate([held_ids, b.column("id").to_numpy()])
            rows = np.concatenate([held, matrix(b.column("vector"), tables.dim)])
            at, _ = nearest_rows(queries, all_ids, rows, k + 1)
            keep = np.unique(at)
            held_ids, held = all_ids[keep], rows[keep]
        if len(held_ids):
            at, scores = nearest_rows(queries, held_ids, held, k + 1)
            unit_rows = tables.units(held)
            out = []
            for i, row in enumerate(at):
                need = tables.places(units[i], unit_rows[row]).min(axis=1) + 1
                out += [(i, int(held_ids[j]), float(s), int(n)) for j, s, n in zip(row, scores[i], need, strict=True) if held_ids[j] != ids[i]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.int64())], ["query", "id", "score", "need"])

    found = classes.select("id", "vector").mapInArrow(scan, "query long, id long, score double, need long")
    best = found.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).filter(F.col("k") <= k)
    need = best.groupBy("need").agg(F.count(F.lit(1)).alias("n")).orderBy("need").collect()  # no more than there are buckets
    total, reached = sum(r["n"] for r in need), 0
    for r in need:
        reached += r["n"]
        if reached >= target * total:
            return int(r["need"])
    return 1


def found_in_buckets(classes: DataFrame, tables: Tables, n_probes: int, k: int) -> DataFrame:
    """(query, ids, scores) of each probed bucket: its k best rows for the query, by exact inner products.

    Both sides are dealt by bucket; a bucket with many queries or rows is dealt in blocks, every block of queries meeting
    every block of rows. A task holds one block of queries and streams the rows.
    """
    dim = tables.dim

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = tables.keys(tables.units(matrix(b.column("vector"), dim)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.tolist(), pa.list_(pa.int64())), b.column("id"), b.column("vector")], ["keys", "id", "vector"])

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = tables.probes(tables.units(matrix(b.column("vector"), dim), query=True), n_probes)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(len(keys), -1).tolist(), pa.list_(pa.int64())), b.column("id"), b.column("vector")], ["keys", "id", "vector"])

    shape = "keys array<long>, id long, vector array<double>"
    index = classes.select("id", "vector").mapInArrow(hashed, shape)
    asked = classes.filter("asked").select("id", "vector").mapInArrow(probed, shape)
    index, asked = (saved(x) for x in (index, asked))
    sizes = index.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    sizes = sizes.join(asked.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("queries")), "key")
    blocks = saved(sizes.select("key", F.ceil(F.col("rows") / CHUNK).cast("int").alias("chunks"), F.ceil(F.col("queries") / HELD).cast("int").alias("helds")))
    blocks = F.broadcast(blocks) if tables.tables * tables.buckets <= MOST_KEYS else blocks
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    rows = index.select(F.explode("keys").alias("key"), "id", "vector").join(blocks, "key")
    rows = rows.select("key", mine("chunks").alias("chunk"), F.explode(upto("helds")).alias("held"), F.lit(1).alias("kind"), "id", "vector")
    queries = asked.select(F.explode("keys").alias("key"), "id", "vector").join(blocks, "key")
    queries = queries.select("key", F.explode(upto("chunks")).alias("chunk"), mine("helds").alias("held"), F.lit(0).alias("kind"), "id", "vector")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked_ids, asked_rows, ids, vectors, best = None, [], [], np.zeros(0, dtype=np.int64), np.zeros((0, dim)), []

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal best
            if asked_ids and len(ids):
                queries = np.concatenate(asked_rows)
                at, scores = nearest_rows(queries, ids, vectors, k)
                best = [(q, ids[a].tolist(), s.tolist()) for q, a, s in zip(np.concatenate(asked_ids).tolist(), at, scores, strict=True)]
                for i in range(0, len(best), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*best[i : i + 4096], strict=True), FOUND, strict=True)], schema=FOUND)

        for b in batches:
            cells = np.stack([b.column(c).to_numpy() for c in ("key", "chunk", "held")], axis=1)
            kinds, new_ids, new = b.column("kind").to_numpy(), b.column("id").to_numpy(), matrix(b.column("vector"), dim)
            cuts = np.flatnonzero((cells[1:] != cells[:-1]).any(axis=1)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(cells)], strict=True):
                if start == end:
                    continue
                if cell is None or (cells[start] != cell).any():
                    yield from settle()
                    cell, asked_ids, asked_rows, ids, vectors = cells[start].copy(), [], [], np.zeros(0, dtype=np.int64), np.zeros((0, dim))
                asks = kinds[start:end] == 0
                if asks.any():
                    asked_ids.append(new_ids[start:end][asks])
                    asked_rows.append(new[start:end][asks])
                if not asks.all():
                    ids = np.concatenate([ids, new_ids[start:end][~asks]])
                    vectors = np.concatenate([vectors, new[start:end][~asks]])
                    if len(ids) > 16_384:  # only rows that are still some query's best stay
                        keep = np.unique(nearest_rows(np.concatenate(asked_rows), ids, vectors, k)[0])
                        ids, vectors = ids[keep], vectors[keep]
        yield from settle()

    dealt = queries.unionByName(rows).repartition("key", "chunk", "held").sortWithinPartitions("key", "chunk", "held", "kind", "id")
    return dealt.mapInArrow(score, SCORED)


def merged(found: DataFrame, k: int) -> DataFrame:
    """(query, id, score): each query's k best of what its buckets gave, best first."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, ids, scores = None, np.zeros(0, dtype=np.int64), np.zeros(0)

        def top() -> tuple[np.ndarray, np.ndarray]:
            once, at = np.unique(ids, return_index=True)
            order = np.lexsort((once, -scores[at]))[:k]
            return once[order], scores[at][order]

        out: list[tuple] = []
        for b in batches:
            for q, i, s in zip(b.column("query").to_pylist(), b.column("ids"), b.column("scores"), strict=True):
                if q != query:
                    if query is not None:
                        out.append((query, *(x.tolist() for x in top())))
                    query, ids, scores = q, np.zeros(0, dtype=np.int64), np.zeros(0)
                ids, scores = np.concatenate([ids, i.values.to_numpy()]), np.concatenate([scores, s.values.to_numpy()])
                if len(ids) > 64 * k:
                    ids, scores = top()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), FOUND, strict=True)], schema=FOUND)
                out = []
        if query is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip((query, *(x.tolist() for x in top())), strict=True), FOUND, strict=True)], schema=FOUND)

    lists = found.repartition("query").sortWithinPartitions("query").mapInArrow(best, SCORED)
    return lists.select("query", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query", F.col("x.ids").alias("id"), F.col("x.scores").alias("score"))


def nearest(rows: DataFrame, asked: Column, k: int = 20, tables: int = 8, sample: int = SAMPLE, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of rows(vec_id, embedding) that `asked` names its k nearest other rows.

    Nearness is the inner product in doubles, ties go to the smaller vec_id; a query with fewer candidates gets them all.
    See usable() for rows that take no part; other columns are ignored. Equal vectors are one entry of the index, which
    carries the k + 1 smallest ids of them, as no result needs more: they never meet as pairs. The number of probes is
    fitted on a sample of queries so that `target` of the exact neighbours are found; all rows are indexed.
    """
    rows = saved(usable(rows).withColumn("asked", F.coalesce(asked, F.lit(False))))  # `asked` is a condition on vec_id
    few = rows.withColumn("k", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).filter(F.col("k") <= k + 1)
    named = few.groupBy("vector").agg(F.min("vec_id").alias("id"), F.array_sort(F.collect_list("vec_id")).alias("members"))
    wanted = rows.groupBy("vector").agg(F.max("asked").alias("asked"))
    classes = saved(named.join(wanted, "vector"))
    facts = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim"), F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))).alias("longest")).first()
    out = "query_id long, rank int, vec_id long, score double"
    if not facts["n"]:
        return rows.sparkSession.createDataFrame([], out)
    second, plain = 0, 2 * (1 << facts["dim"].bit_length())
    while facts["n"] > CROWD * plain * max(1, 2 * second) and second < plain // 2:
        second = max(1, 2 * second)
    index = Tables(facts["dim"], float(facts["longest"]), tables, second)
    n_probes = fitted_probes(classes, index, k, sample, target)
    found = merged(found_in_buckets(classes, index, n_probes, k + 1), k + 1)
    # From classes back to rows: a class that finds others also finds itself, if it has more than one member.
    hits = found.join(classes.select("id", "members"), "id").select("query", "score", F.explode("members").alias("vec_id"))
    hits = hits.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).filter(F.col("k") <= k + 1)
    hits = hits.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("k", "vec_id", "score"))).alias("hits"))
    who = rows.filter("asked").select(F.col("vec_id").alias("query_id"), "vector").join(classes.filter("asked").select("vector", F.col("id").alias("query")), "vector")
    each = who.join(hits, "query").select("query_id", F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k).alias("hits"))
    each = each.select("query_id", F.posexplode("hits").alias("at", "h"))
    return each.select("query_id", (F.col("at") + 1).alias("rank"), "h.vec_id", "h.score")

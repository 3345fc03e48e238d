"""Operator 4: near-duplicate documents by MinHash bands, odd sketches and full sets.

Exact copies (of the folded word sequence) become one node first. A node's MinHash samples give band keys and an odd
sketch: a parity bitmap of the samples. Nodes that share a band key are candidates; the population count of the XOR of two
sketches estimates their similarity precisely when it is high and drops the rest; what is left is confirmed on full sets.

A bucket of a band never yields all its pairs. It elects delegates, those members whose own buckets are fullest: in a
group of near copies these are the texts nearest to its middle, so that whatever links with anything there links with them.
Every member meets the first delegate. Pairs within one component need no look. Members that are still apart from their
bucket's largest component meet all members of a bucket of at most SMALL; in a larger one they first meet its DELEGATES and,
in an order by further samples, the NEIGHBOURS before them among those apart, which joins most of what belongs together.
What is apart even then meets the members that share one of its rarest shingles: sets of similarity 0.8 share one of the
rarest fifth of either, so that no link among these texts is left out, whatever the size of their bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm.common import narrowed, saved
from chronofold.llm.graph import components
from chronofold.llm.hashing import U, mix, sequence_digest, shingles, word_hashes

BANDS, ROWS, BITS = 40, 6, 1024
#: Members of a bucket up to which those apart meet them all at once; beyond: delegates and neighbours that one meets first,
#: members of one neighbourhood, and candidates of one pivot that one task compares.
SMALL, DELEGATES, NEIGHBOURS, NEIGHBOURHOOD, AT_PIVOT = 64, 8, 8, 4096, 2000
#: Samples and bits of the sharper sketches for members of mixed buckets.
FINE_SAMPLES, FINE_BITS = 2048, 8192
#: Counters by which shingles are ordered from rare to frequent.
COUNTERS = 1 << 18


class Sampler:
    """MinHash samples, band keys and the odd sketch of a set of 64-bit hashes."""

    def __init__(self, bands: int, rows: int, bits: int):
        rng = np.random.Generator(np.random.PCG64(7))
        self.bands, self.rows, self.bits = bands, rows, bits
        self.times = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.flips = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
        self.salts = mix(np.arange(1, bands * rows + 1, dtype=np.uint64))

    def samples(self, hashes: np.ndarray) -> np.ndarray:
        x = (hashes >> U(32)).astype(np.uint32)
        step = max(1, 65_536 // max(1, len(x)))
        out = np.empty(len(self.times), dtype=np.uint32)
        for k in range(0, len(out), step):
            out[k : k + step] = ((x[None, :] ^ self.flips[k : k + step, None]) * self.times[k : k + step, None]).min(axis=1)
        return out

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = mix(self.samples(hashes).astype(np.uint64) + self.salts)
        keys = np.zeros(self.bands, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for row in own.reshape(self.bands, self.rows).T:
                keys = mix(keys * U(0x9E3779B97F4A7C15) + row)
        parity = (np.bincount((own % U(self.bits)).astype(np.int64), minlength=self.bits) & 1).astype(np.uint8)
        return keys.view(np.int64), np.packbits(parity).view(">i8").astype(np.int64)


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, d1 and d2 (digest of the word sequence), bands and sketch of every row; no sketch without words."""
    kind = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, sketch array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(BANDS, ROWS, BITS)
        for b in batches:
            sizes, digests, bands, sketches = [], [], [], []
            for text in b.column(1):
                words = word_hashes(text.as_py() or "")
                own = shingles(words, width)
                sizes.append(len(own))
                digests.append(sequence_digest(words))
                keys, sketch = sampler(own) if len(own) else (None, None)
                bands.append(keys)
                sketches.append(sketch)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(sizes, type=pa.int64()), pa.array([d[0] for d in digests], type=pa.int64()),
                    pa.array([d[1] for d in digests], type=pa.int64()), pa.array(bands, type=longs), pa.array(sketches, type=longs),
                ],
                names=["doc_id", "n_shingles", "d1", "d2", "bands", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind)


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    """node and the full set of shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [shingles(word_hashes(t.as_py() or ""), width).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, type=pa.list_(pa.int64()))], names=["node", "hashes"])

    return docs.mapInArrow(run, "node long, hashes array<long>")


def finely_sketched(docs: DataFrame, width: int) -> DataFrame:
    """node and an odd sketch of many more samples, for rows of docs(node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(FINE_SAMPLES, 1, FINE_BITS)
        for b in batches:
            out = [sampler(shingles(word_hashes(t.as_py() or ""), width))[1] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, type=pa.list_(pa.int64()))], names=["node", "fine"])

    return docs.mapInArrow(run, "node long, fine array<long>")


def lowest(percent: int, samples: int) -> float:
    """The least estimate that a pair at the threshold is allowed: 5.5 standard deviations of its samples below."""
    share = percent / 100
    return share - 5.5 * math.sqrt(share * (1 - share) / samples)


def estimate(a: str, b: str, samples: int = BANDS * ROWS, bits: int = BITS) -> Column:
    """Similarity by two odd sketches: 1 + bits / (4 samples) * ln(1 - 2 * (bits that differ) / bits)."""
    differ = f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (s, c) -> s + c)"
    return F.expr(f"1 + {bits / (4 * samples)} * ln(greatest(1 - 2 * {differ} / {bits}, 1e-9))")


def of_digest(rows: DataFrame) -> DataFrame:
    """node and text of those rows(node, text, d1, d2, twice) whose words have the digest d1, d2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mine = [sequence_digest(word_hashes(t.as_py() or "")) == (x, y) for t, x, y in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield b.filter(pa.array(mine, pa.bool_())).select([0, 1])

    return rows.mapInArrow(run, "node long, text string")


class Links:
    """Confirms candidate pairs of nodes on sketches and then on full sets."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, width: int, percent: int, twice: bool):
        self.docs, self.nodes, self.width, self.percent, self.twice = docs, nodes, width, percent, twice
        self.least = lowest(percent, BANDS * ROWS)

    def texts(self, wanted: DataFrame) -> DataFrame:
        """node and text of the nodes in wanted(node); of a doc_id that stands on several texts, the text of the node."""
        if not self.twice:  # nodes are doc_ids
            return narrowed(self.docs.withColumnRenamed("doc_id", "node"), wanted, "node").join(wanted, "node", "left_semi").select("node", "text")
        named = self.nodes.select("node", "doc_id", "d1", "d2", "twice").join(wanted, "node", "left_semi")
        rows = narrowed(self.docs, named, "doc_id").join(named, "doc_id").select("node", "text", "d1", "d2", "twice")
        once = rows.filter("not twice").select("node", "text")
        return once.unionByName(of_digest(rows.filter("twice")))

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs(a, b, salt) whose sets reach the threshold; a b with many pairs is copied once per salt."""
        side = self.nodes.select("node", "n_shingles", "sketch")
        left = side.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
        right = side.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
        near = pairs.join(left, "a").join(salted(right, pairs), ["b", "salt"])
        near = near.filter(100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb")).filter(estimate("sa", "sb") >= self.least)
        near = saved(near.select("a", "b", "salt", "na", "nb"))
        wanted = saved(near.select(F.col("a").alias("node")).union(near.select("b")).distinct())
        sets = saved(sets_of(self.texts(wanted), self.width).dropDuplicates(["node"]))
        whole = near.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a")
        whole = whole.join(salted(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), near), ["b", "salt"])
        common = F.size(F.array_intersect("ha", "hb"))
        return whole.filter(100 * common >= self.percent * (F.col("na") + F.col("nb") - common)).select("a", "b")


def salted(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """rows(b, ...) that pairs(b, salt) name, once for each salt up to the largest of their pairs."""
    most = pairs.groupBy("b").agg(F.max("salt").alias("most"))
    return rows.join(most, "b").withColumn("salt", F.explode(F.sequence(F.lit(0), "most"))).drop("most")


def with_component(df: DataFrame, labels: DataFrame, node: str, out: str) -> DataFrame:
    return df.join(labels.select(F.col("node").alias(node), F.col("component").alias(out)), node, "left").withColumn(
        out, F.coalesce(out, node)
    )


def joined(labels: DataFrame, links: Links, pairs: DataFrame) -> DataFrame:
    """The components after the links among pairs: known components go in as stars, so that few rounds are left."""
    new = saved(links.confirmed(pairs))
    if new.isEmpty():
        return labels
    return saved(components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(new)))


def in_buckets(nodes: DataFrame) -> DataFrame:
    """node, band, members (of the band's bucket) and two further band keys, for buckets of two members and more."""
    rows = nodes.select("node", "bands", F.posexplode("bands").alias("k", "band"))
    after = lambda n: F.get("bands", (F.col("k") + n) % BANDS)
    rows = rows.select("node", "band", after(1).alias("next"), after(2).alias("third"))
    sizes = rows.groupBy("band").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    return saved(rows.join(sizes, "band"))


def delegates(shared: DataFrame) -> DataFrame:
    """band, pivot and delegates of each bucket: of members dealt to slots, the one of each slot whose buckets are fullest."""
    weights = shared.groupBy("node").agg(F.sum("members").alias("weight"))
    rank = F.struct("weight", F.xxhash64("node").alias("tie"))
    slot = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(DELEGATES))
    by_slot = shared.join(weights, "node").groupBy("band", slot.alias("slot")).agg(F.max_by("node", rank).alias("node"), F.max(rank).alias("rank"))
    return by_slot.groupBy("band").agg(F.max_by("node", "rank").alias("pivot"), F.collect_list("node").alias("delegates"))


def apart(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of buckets of several components, with `component` and whether it is another than the bucket's largest."""
    member = with_component(shared, labels, "node", "component")
    sizes = member.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    top = sizes.groupBy("band").agg(F.max_by("component", F.struct("n", "component")).alias("top"), F.count(F.lit(1)).alias("groups"))
    member = member.join(top.filter("groups > 1").select("band", "top"), "band")
    return member.withColumn("apart", F.col("component") != F.col("top")).drop("top")


def among_hosts(split: DataFrame, links: Links) -> DataFrame:
    """Pairs (a, b) of rows apart and hosts of one bucket that both sketches let pass; they are compared inside the join."""
    fine = finely_sketched(links.texts(saved(split.select("node").distinct())), links.width).dropDuplicates(["node"])
    rows = split.join(links.nodes.select("node", "n_shingles", "sketch"), "node").join(fine, "node")
    rows = saved(rows.select("band", "node", "component", "apart", "host", "n_shingles", "sketch", "fine"))
    side = lambda kept, x: rows.filter(kept).select("band", *[F.col(c).alias(f"{x}_{c}") for c in ("node", "component", "apart", "host", "n_shingles", "sketch", "fine")])
    x, y = side("apart", "x"), side("host", "y")
    near = F.expr(f"x_component != y_component and (x_node < y_node or not (x_host and y_apart)) and 100 * least(x_n_shingles, y_n_shingles) >= {links.percent} * greatest(x_n_shingles, y_n_shingles)")
    near = (x["band"] == y["band"]) & near & (estimate("x_sketch", "y_sketch") >= links.least)
    near = near & (estimate("x_fine", "y_fine", FINE_SAMPLES, FINE_BITS) >= lowest(links.percent, FINE_SAMPLES))
    return x.join(y, near).select(F.col("x_node").alias("a"), F.col("y_node").alias("b"))


def among_neighbours(split: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows apart in large buckets, each with those just before it in the order of further band keys.

    A neighbourhood holds about NEIGHBOURHOOD members at most, dealt by the next band key: near copies mostly share that.
    """
    rows = split.filter(f"apart and members > {SMALL}").withColumn("part", F.pmod(F.col("next"), F.expr(f"1 + members div {NEIGHBOURHOOD}")))
    before = Window.partitionBy("band", "part").orderBy("next", "third", "node").rowsBetween(-NEIGHBOURS, -1)
    rows = rows.select("node", "component", F.collect_list(F.struct("node", "component")).over(before).alias("others"))
    rows = rows.select("node", "component", F.explode("others").alias("other"))
    return rows.filter("component != other.component").select(F.col("node").alias("a"), F.col("other.node").alias("b"))


def shingle_counts(docs: DataFrame, width: int) -> np.ndarray:
    """How often the shingles of docs(node, text) fall into each of COUNTERS: a bounded table that orders all shingles alike."""
    counter = F.pmod(F.col("hash"), F.lit(COUNTERS)).alias("counter")
    counts = sets_of(docs, width).select(F.explode("hashes").alias("hash")).groupBy(counter).agg(F.count(F.lit(1)).alias("n"))
    out = np.zeros(COUNTERS, dtype=np.int64)
    for r in counts.collect():  # COUNTERS rows at most
        out[r["counter"]] = r["n"]
    return out


def rarest(docs: DataFrame, width: int, percent: int, counts: np.ndarray) -> DataFrame:
    """node, n, place and hash of the rarest shingles of docs(node, text), rarest first, as many as any similar set must share one of.

    Two sets of similarity t share t times the larger one at least: of n shingles in one order for all sets, one of the first
    n - ceil(t n) + 1 is common.
    """
    held = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, firsts = [], []
            for text in b.column(1):
                own = shingles(word_hashes(text.as_py() or ""), width).view(np.int64)
                order = np.lexsort((own, held.value[own % COUNTERS]))
                sizes.append(len(own))
                firsts.append(own[order[: len(own) + (-percent * len(own)) // 100 + 1]])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(firsts, pa.list_(pa.int64()))], names=["node", "n", "firsts"])

    firsts = docs.mapInArrow(run, "node long, n long, firsts array<long>").dropDuplicates(["node"])
    return firsts.select("node", "n", F.posexplode("firsts").alias("place", "hash"))


def among_rare(rest: DataFrame, links: Links) -> DataFrame:
    """Pairs (a, b) of nodes apart and nodes of rest, in different components, that share a rare shingle early enough.

    The first rare shingle that two sets share stands at places i and j: all they share comes from there on, so that
    min(n - i, m - j) must reach what similarity asks of n and m. Every similar pair passes at that shingle.
    """
    nodes = rest.groupBy("node").agg(F.first("component").alias("component"), F.max("apart").alias("apart"))
    texts = saved(links.texts(saved(nodes.select("node"))).dropDuplicates(["node"]))
    rows = rarest(texts, links.width, links.percent, shingle_counts(texts, links.width)).join(nodes, "node")
    rows = saved(rows.select("hash", "node", "component", "apart", (F.col("n") - F.col("place")).alias("left"), "n"))
    side = lambda kept, x: rows.filter(kept).select("hash", *[F.col(c).alias(f"{x}_{c}") for c in ("node", "component", "apart", "left", "n")])
    x, y = side("apart", "x"), side("true", "y")
    near = F.expr(f"x_component != y_component and (x_node < y_node or not y_apart) and {100 + links.percent} * least(x_left, y_left) >= {links.percent} * (x_n + y_n)")
    return x.join(y, (x["hash"] == y["hash"]) & near).select(F.col("x_node").alias("a"), F.col("y_node").alias("b"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Groups the rows of docs(doc_id, text) whose shingle sets are alike to at least `percent` per cent (Jaccard).

    Returns per row doc_id, n_shingles, component_id (the smallest doc_id reachable over links, itself included) and kept
    (doc_id = component_id). Words are A-Z folded runs of anything but white space; a text of fewer than `width` words has
    its whole sequence as one shingle, one without words (null, empty) links with nothing. Rows that repeat a doc_id are one
    document, with the links of all their texts, and each return a row. A row with a null doc_id takes the component of its exact copies and is
    not kept; without any it has no component and is kept. An empty table returns no row.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = saved(sketched(docs, width))
    some = rows.filter("n_shingles > 0")
    # A node is one sequence of words, named by its smallest doc_id, or numbered where a doc_id stands on several texts.
    digest = F.struct("d1", "d2")
    several = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min(digest).alias("a"), F.max(digest).alias("b")).filter("a != b")
    several = saved(several.select("doc_id", F.lit(True).alias("twice")))
    twice = not several.isEmpty()
    name = F.monotonically_increasing_id() if twice else F.col("doc_id")
    classes = saved(some.groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id")).withColumn("node", F.when(F.col("doc_id").isNotNull(), name)))
    nodes = some.join(classes.filter("node is not null").withColumnRenamed("doc_id", "own"), ["d1", "d2"]).filter("doc_id = own")
    nodes = nodes.join(several, "doc_id", "left").withColumn("twice", F.coalesce("twice", F.lit(False))) if twice else nodes.withColumn("twice", F.lit(False))
    nodes = saved(nodes.select("node", "doc_id", "d1", "d2", "twice", "n_shingles", "bands", "sketch").dropDuplicates(["node"]))
    links = Links(docs, nodes, width, percent, twice)
    shared = in_buckets(nodes)
    elected = saved(delegates(shared))
    pairs = shared.join(elected.select("band", "pivot"), "band").filter("node != pivot")
    pairs = pairs.groupBy(F.col("node").alias("a"), F.col("pivot").alias("b")).agg(F.max("members").alias("members"))
    salt = F.pmod(F.hash("a"), F.expr(f"cast(1 + members div {AT_PIVOT} as int)"))
    found = links.confirmed(saved(pairs.select("a", "b", salt.alias("salt"))))
    if twice:  # rows of one doc_id are one document: all their texts go together
        same = some.select("doc_id", "d1", "d2").join(several, "doc_id", "left_semi").join(classes.select("d1", "d2", "node"), ["d1", "d2"]).select("doc_id", "node").distinct()
        same = same.join(same.groupBy("doc_id").agg(F.min("node").alias("first")), "doc_id").select(F.col("node").alias("a"), F.col("first").alias("b"))
        found = found.unionByName(same)
    labels = saved(components(found))
    split = apart(shared.join(elected.select("band", "delegates"), "band"), labels)
    split = split.withColumn("host", F.expr(f"members <= {SMALL} or array_contains(delegates, node)")).drop("delegates")
    split = saved(split.filter("apart or host"))
    labels = joined(labels, links, among_hosts(split, links).unionByName(among_neighbours(split)).distinct().withColumn("salt", F.lit(0)))
    rest = saved(apart(shared.filter(f"members > {SMALL}"), labels))
    labels = joined(labels, links, among_rare(rest, links).distinct().withColumn("salt", F.lit(0)))
    named = with_component(classes, labels, "node", "component")
    if twice:
        named = saved(named)
        least = named.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
        named = named.join(least, "component").drop("component").withColumnRenamed("least", "component")
    named = named.select("d1", "d2", "component")
    out = rows.select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2"], "left")
    if twice:  # a row without words has the component of its document's other texts
        own = some.join(several, "doc_id", "left_semi").join(named, ["d1", "d2"]).groupBy("doc_id").agg(F.min("component").alias("own"))
        out = out.join(own, "doc_id", "left").withColumn("component", F.coalesce("component", "own"))
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.coalesce("component", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.when(F.col("doc_id").isNull(), F.col("component_id").isNull()).otherwise(F.col("doc_id") == F.col("component_id")))

"""Prefix tries of conversations, built as z-fast tries and joined by Spark.

A task takes its share of the conversations into compacted tries. A trie knows each compacted node by the hash of its
handle: the node's prefix cut at the two-fattest depth of its edge (the depth in it that is divisible by the highest power
of two). A fat binary search over these handles finds where a conversation leaves the trie in a number of lookups that is
the logarithm of its length; batches of conversations are inserted there, splitting edges, and a full trie expands its edges
into one row per node. Equal nodes of different tries have equal prefix hashes, by which Spark adds them up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm.common import saved

#: The prefix hash of no turns, and the bytes of every prefix hash.
ROOT, WIDTH = b"\0" * 16, 16
#: A trie is emptied at so many stored turns; conversations are inserted so many turns at a time; a longer one never waits.
MOST_TURNS, BATCH_TURNS = 400_000, 50_000

NODES = pa.schema(
    [("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("chars", pa.int64()), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("end", pa.int64())]
)
KIND = "node binary, parent binary, depth long, chars long, conv_id long, n_convs long, end long"


def below(prefix: bytes, turn: bytes) -> bytes:
    """The hash of a prefix and one more turn."""
    return hashlib.blake2b(prefix + turn, digest_size=WIDTH).digest()


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] divisible by the highest power of two; 0 for an empty edge."""
    if low >= high:
        return 0
    return high & (-1 << ((low ^ high).bit_length() - 1))


class Node:
    """A compacted node: the prefixes of depths (above, depth], of which `path` holds the hashes and `chars` the sizes, from depth 1 on.

    path and chars belong to one of the conversations below and are shared with its other nodes.
    """

    __slots__ = ("up", "above", "depth", "path", "chars", "children", "least", "count")

    def __init__(self, up: Node | None, depth: int, path: list[bytes], chars: list[int]) -> None:
        self.up, self.above, self.depth, self.path, self.chars = up, up.depth if up else 0, depth, path, chars
        self.children: dict[bytes, Node] = {}
        self.least: int | None = None
        self.count = 0

    def handle(self) -> bytes:
        f = two_fattest(self.above, self.depth)
        return self.path[f - 1] if f else ROOT


class ZFastTrie:
    """A compacted trie over sequences of prefix hashes with a dictionary of handles."""

    def __init__(self) -> None:
        self.root = Node(None, 0, [], [])
        self.handles: dict[bytes, Node] = {ROOT: self.root}
        self.ends: dict[bytes, list[int]] = {}
        self.turns = 0

    def exit_node(self, path: list[bytes]) -> Node:
        """The node in whose edge the path leaves the trie or ends, by fat binary search over the handles.

        Every node whose whole prefix the path has is at most `high` deep. One whose edge holds the two-fattest depth of
        (low, high] therefore has its handle there; if there is none, all of them end above that depth.
        """
        low, high, node = 0, len(path), self.root
        while low < high:
            f = two_fattest(low, high)
            found = self.handles.get(path[f - 1])
            if found is None:
                high = f - 1
            elif found.depth <= len(path) and path[found.depth - 1] == found.path[found.depth - 1]:
                node, low = found, found.depth
            else:
                return found
        # The edge that the path goes on into may have its handle below the place where the path leaves it.
        return node.children.get(path[node.depth], node) if node.depth < len(path) else node

    def add(self, conv_id: int, path: list[bytes], chars: list[int]) -> None:
        """Inserts one conversation: splits the edge where it leaves the trie and hangs the rest of it below."""
        node = self.exit_node(path)
        low, high = node.above, min(node.depth, len(path))
        while low < high:  # the last depth that the edge shares with the path
            mid = (low + high + 1) // 2
            low, high = (mid, high) if node.path[mid - 1] == path[mid - 1] else (low, mid - 1)
        if low < node.depth:
            node = self.split(node, low)
        if low < len(path):
            leaf = Node(node, len(path), path, chars)
            node.children[path[low]] = self.handles[leaf.handle()] = leaf
            self.turns += len(path)
            node = leaf
        self.ends.setdefault(path[-1] if path else ROOT, []).append(conv_id)
        node.least = conv_id if node.least is None else min(node.least, conv_id)
        node.count += 1

    def split(self, child: Node, depth: int) -> Node:
        """A new node at `depth` within the edge of child; both get the handles of their new edges."""
        del self.handles[child.handle()]
        middle = Node(child.up, depth, child.path, child.chars)
        child.up.children[child.path[child.above]] = middle
        middle.children[child.path[depth]] = child
        child.up, child.above = middle, depth
        self.handles[middle.handle()], self.handles[child.handle()] = middle, child
        return middle

    def insert(self, batch: list[tuple[int, list[bytes], list[int]]]) -> None:
        """Inserts a batch, shorter conversations first: the longer ones then only hang on below."""
        for conv_id, path, chars in sorted(batch, key=lambda x: len(x[1])):
            self.add(conv_id, path, chars)

    def expand(self) -> Iterator[tuple]:
        """One row of NODES per prefix: compacted nodes with what ends below them, edges unrolled to all their depths."""
        order, stack = [], [self.root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack += node.children.values()
        least, count = {}, {}
        for node in reversed(order):
            lows = [least[id(c)] for c in node.children.values()]
            least[id(node)] = min([*lows, node.least] if node.least is not None else lows, default=0)
            count[id(node)] = node.count + sum(count[id(c)] for c in node.children.values())
        for node in order:
            if node is self.root:
                yield ROOT, None, 0, 0, least[id(node)], count[id(node)], node.count
            for d in range(node.above + 1, node.depth + 1):
                yield node.path[d - 1], node.path[d - 2] if d > 1 else ROOT, d, node.chars[d - 1], least[id(node)], count[id(node)], node.count if d == node.depth else 0


def rebuilt(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, turn, chars): each conversation's turns as hashes, after the first turns of the one it begins like.

    Conversation c takes the first h = crc32(c) % 6 turns of conversation c - c % 100 (all if it has fewer, none if there
    is none), then its own after its first h. A row of depth 0 stands for the conversation itself. Only hashes are moved,
    never texts: a turn is the hash of its role and text, which also decides the order of turns of one number.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    turn = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH))
    own = rows.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("place"), turn.alias("turn"), F.char_length(text).cast("long").alias("chars"))
    own = saved(own.withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("place"), "turn"))).drop("place"))
    head = F.expr("cast(crc32(cast(cast(conv_id as string) as binary)) % 6 as int)")
    convs = own.groupBy("conv_id").agg(F.max("k").alias("size"))
    heads = own.filter("k <= 5").select(F.col("conv_id").alias("base"), "k", "turn", "chars")
    bases = convs.select(F.col("conv_id").alias("base"), F.col("size").alias("has"))
    asks = convs.select("conv_id", F.expr("conv_id - conv_id % 100").alias("base"), head.alias("h")).join(bases, "base", "left")
    asks = saved(asks.select("conv_id", "base", "h", F.least("h", F.coalesce("has", F.lit(0))).alias("taken")))
    first = asks.filter("taken > 0").join(heads, "base").filter("k <= taken").select("conv_id", F.col("k").cast("long").alias("depth"), "turn", "chars")
    rest = own.join(asks, "conv_id").filter("k > h").select("conv_id", (F.col("taken") + F.col("k") - F.col("h")).cast("long").alias("depth"), "turn", "chars")
    itself = asks.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("long").alias("chars"))
    return first.unionByName(rest).unionByName(itself)


def tries(sequences: DataFrame, most: int = MOST_TURNS, step: int = BATCH_TURNS) -> DataFrame:
    """The rows of NODES of each task's tries, and with depth -1 one row (node, conv_id) for the end of each conversation.

    A conversation of more than `step` turns is passed on as a trie of its own while it is read, so that memory is bounded
    by `most` turns whatever the conversations' sizes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, waiting, held = ZFastTrie(), [], 0
        conv, path, chars, long = None, [], [], False
        out: list[tuple] = []

        def ready() -> Iterator[pa.RecordBatch]:
            nonlocal out
            for i in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[i : i + 10_000], strict=True), NODES, strict=True)], schema=NODES)
            out = []

        def insert() -> None:
            nonlocal waiting, held
            trie.insert(waiting)
            waiting, held = [], 0

        def empty() -> Iterator[pa.RecordBatch]:
            nonlocal trie
            insert()
            if not trie.ends:
                return
            for node, ids in trie.ends.items():
                out.extend((node, None, -1, 0, i, 0, 0) for i in ids)
            for row in trie.expand():
                out.append(row)
                if len(out) >= 10_000:
                    yield from ready()
            yield from ready()
            trie = ZFastTrie()

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal held, path, chars, long
            if conv is None:
                return
            if long:
                out.append((path[-1], None, -1, 0, conv, 0, 0))
                out.extend((path[i], path[i - 1], long_from + i, chars[i], conv, 1, int(i == len(path) - 1)) for i in range(1, len(path)))
                yield from ready()
            else:
                waiting.append((conv, path, chars))
                held += len(path) + 1
                if held >= step:
                    insert()
                if trie.turns + len(trie.handles) >= most:
                    yield from empty()
            path, chars, long = [], [], False

        long_from = 0
        for b in batches:
            for c, depth, turn, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if c != conv or depth == 0:
                    yield from close()
                    conv, prefix = c, ROOT
                if depth == 0:
                    continue
                prefix = below(prefix, turn)
                if len(path) > step:  # all nodes but the last, which may be the conversation's end, go out as they are
                    first = long_from if long else 1
                    if not long:
                        out.append((ROOT, None, 0, 0, conv, 1, 0))
                    out.extend((path[i], path[i - 1] if i else ROOT, first + i, chars[i], conv, 1, 0) for i in range(1 if long else 0, len(path) - 1))
                    long, long_from, path, chars = True, first + len(path) - 2, path[-2:], chars[-2:]
                    yield from ready()
                path.append(prefix)
                chars.append(n)
        yield from close()
        yield from empty()

    return sequences.repartition("conv_id").sortWithinPartitions("conv_id", "depth").mapInArrow(run, KIND)


def ways(sequences: DataFrame, chains: DataFrame) -> DataFrame:
    """(node, leaves, total): each chain's totals at every node on the way down to its own first node, that is above `first`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix = ROOT
        for b in batches:
            out = []
            for depth, turn in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                prefix = below(prefix, turn) if depth else ROOT
                out.append(prefix)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), b.column(2), b.column(3)], ["node", "leaves", "total"])

    on = sequences.join(chains, "conv_id").filter("depth < first").select("conv_id", "depth", "turn", "leaves", "total")
    on = on.repartition("conv_id").sortWithinPartitions("conv_id", "depth").select("depth", "turn", "leaves", "total")
    return on.mapInArrow(run, "node binary, leaves long, total long")


def digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): the digest of the ids that end at a node, in order. A node's ids stream through one task."""
    shape = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, hashlib.sha256()
        for b in batches:
            done = []
            for x, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if x != node:
                    if node is not None:
                        done.append((node, digest.hexdigest()))
                    node, digest = x, hashlib.sha256(str(i).encode())
                else:
                    digest.update(f",{i}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), shape, strict=True)], schema=shape)
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], schema=shape)

    return ends.repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(run, "node binary, ends_sha256 string")


def nodes(rows: DataFrame, most: int = MOST_TURNS, step: int = BATCH_TURNS) -> DataFrame:
    """One row per node of the trie over all rebuilt conversations of rows(conv_id, turn, role, text); see rebuilt().

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    Rows without a conv_id take no part, null roles and texts are empty, turns of one number go by their hash, repeated rows
    are turns of their own; other columns are ignored; without conversations there are no nodes.

    A node belongs to the conversation of its conv_id. Such a conversation owns all its nodes from some depth on, so that
    sums over subtrees are sums below along this chain, and the totals of all chains that pass a node: each chain adds its
    total to the nodes on the way to it, by grouped sums. These rows are no more than the turns of the chains.
    """
    sequences = saved(rebuilt(rows))
    parts = saved(tries(sequences, most, step))
    node = parts.filter("depth >= 0").groupBy("node", "depth").agg(
        F.min("parent").alias("parent"), F.min("chars").alias("chars"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("end").alias("n_ends")
    )
    node = saved(node)
    children = node.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    known = node.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    known = saved(known.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")))
    chains = known.groupBy("conv_id").agg(F.min("depth").alias("first"), F.sum("leaf").alias("leaves"), F.sum("saved").alias("total"))
    passed = ways(sequences, chains).groupBy("node").agg(F.sum("leaves").alias("more_leaves"), F.sum("total").alias("more_saved"))
    under = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = known.join(passed, "node", "left").select(
        "node", "parent", "conv_id", "depth", "n_convs", "n_children", "n_ends",
        (F.sum("leaf").over(under) + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
        (F.sum("saved").over(under) + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"),
    )
    tops = chains.select("conv_id", F.col("first").alias("depth"))
    owners = known.join(tops, ["conv_id", "depth"], "left_semi").filter("parent is not null").select("conv_id", "depth", F.col("parent").alias("up"))
    owners = owners.join(known.select(F.col("node").alias("up"), F.col("conv_id").alias("above")), "up").select("conv_id", "depth", "above")
    sha = digests(parts.filter("depth = -1").select("node", "conv_id"))
    out = full.join(owners, ["conv_id", "depth"], "left").join(sha, "node", "left")
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("above", "conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )

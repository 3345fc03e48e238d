"""Operator 3: best-fit packing of tokenised documents by linear grouping.

The driver only ever sees the histogram of piece lengths (at most `capacity` numbers). Large lengths are rounded up
within groups of equal cardinality, a configuration LP over the few group sizes is solved by column generation, the
exact lengths are put back into the configurations, and small lengths go to the fullest sequence that holds them. The
outcome is a table of runs (length, first rank, last rank -> sequence, offset), so each task places its own pieces.
"""

from __future__ import annotations

import bisect
import functools
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm.common import MOST_KEYS, batch, saved

END_ID = 2
#: Pieces of one length that one salt ranks.
SALTED = 20_000


def added_tokens(tokenizer_path: str) -> dict[str, int]:
    """The added tokens of a tokenizer file, content -> id; they stand for themselves wherever a text holds them."""
    with open(tokenizer_path, encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    for t in tokens:
        if t["single_word"] or t["lstrip"] or t["rstrip"]:
            raise ValueError(f"added token {t['content']!r} is not matched as it stands")
    return {t["content"]: t["id"] for t in tokens}


#: Characters from which on a text goes to the tokenizer file itself: the rank file's splitter gives up on runs of about a
#: million white-space characters.
LONG_TEXT = 250_000


@functools.lru_cache(maxsize=1)
def rank_encoder(ranks_path: str, pattern: str, tokenizer_path: str, added: tuple[tuple[str, int], ...] | None = None) -> Callable[[str], np.ndarray]:
    """Text -> ids as unsigned 32-bit numbers, as the tokenizer file gives them.

    The rank file holds the same vocabulary at a fraction of the cost, and serves texts of less than LONG_TEXT characters; a
    test compares both. The tokenizer file's added tokens (`added`, if the caller has them) are split off first, as that
    file's tokenizer does. A Python worker builds it once and keeps it: what a task frees its worker seldom gives back.
    """
    import base64

    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = added_tokens(tokenizer_path) if added is None else dict(added)
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    whole: list = []

    def encode(text: str) -> np.ndarray:
        if len(text) < LONG_TEXT:
            return encoding.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
        if not whole:
            from tokenizers import Tokenizer

            whole.append(Tokenizer.from_file(tokenizer_path))
        return np.array(whole[0].encode(text, add_special_tokens=False).ids, dtype="<u4")

    return encode


def piece_ids(ids: np.ndarray) -> list[int]:
    return ids.tolist()


def piece_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.tobytes())


def tokenised(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    capacity: int,
    digest: Callable[[np.ndarray], object],
    digest_type: str,
    tokenizer_path: str,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length and digest(ids of the piece)."""
    arrow = {"array<long>": pa.list_(pa.int64()), "long": pa.int64()}[digest_type]
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("digest", arrow)])

    added = tuple(added_tokens(tokenizer_path).items())  # of the whole file only these few go to the tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_encoder(ranks_path, pattern, tokenizer_path, added)
        end = np.array([END_ID], dtype="<u4")
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.concatenate([encoder(text.as_py() or ""), end])
                first = len(ids) % capacity or capacity
                starts = [0, *range(first, len(ids), capacity)]
                for k, s in enumerate(starts):
                    part = ids[s : starts[k + 1] if k + 1 < len(starts) else len(ids)]
                    for column, v in zip(rows, (doc, k, s, len(part), digest(part)), strict=True):
                        column.append(v)
            yield batch(rows, schema)

    kind = f"doc_id long, piece int, start long, length long, digest {digest_type}"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kind)


# --- the plan over the histogram -------------------------------------------------------------------------------


def grouped(hist: dict[int, int], large: int, groups: int) -> list[dict[int, int]]:
    """Large lengths, longest first, dealt into groups of equal cardinality; a length may be split between two."""
    total = sum(c for n, c in hist.items() if n >= large)
    if not total:
        return []
    size, out = -(-total // groups), [{}]
    room = size
    for n in sorted((n for n in hist if n >= large), reverse=True):
        left = hist[n]
        while left:
            if not room:
                out.append({})
                room = size
            take = min(room, left)
            out[-1][n] = out[-1].get(n, 0) + take
            room -= take
            left -= take
    return out


def best_column(sizes: np.ndarray, duals: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of most value: an unbounded knapsack over the capacity."""
    value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    useful = np.flatnonzero(duals > 1e-9)
    w, v = sizes[useful], duals[useful]
    low = int(w.min()) if len(w) else capacity + 1
    for c in range(1, capacity + 1):
        best, at = value[c - 1], -1
        if c >= low:
            gain = np.where(w <= c, value[np.maximum(c - w, 0)] + v, -1.0)
            k = int(gain.argmax())
            if gain[k] > best + 1e-12:
                best, at = gain[k], int(useful[k])
        value[c], last[c] = best, at
    config, c = np.zeros(len(sizes), dtype=np.int64), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            config[last[c]] += 1
            c -= sizes[last[c]]
    return float(value[capacity]), config


def configurations(sizes: list[int], counts: list[int], capacity: int, rounds: int) -> list[tuple[np.ndarray, int]]:
    """Whole numbers of configurations that cover no more than the counts: the LP's basic solution rounded down."""
    k = len(sizes)
    w, need = np.asarray(sizes), np.asarray(counts, dtype=float)
    columns = [np.where(np.arange(k) == i, capacity // w[i], 0) for i in range(k)]
    basis = np.array(columns, dtype=float).T
    x = need / np.diag(basis)
    for _ in range(rounds):
        duals = np.linalg.solve(basis.T, np.ones(k))
        value, config = best_column(w, duals, capacity)
        if value <= 1 + 1e-6 or x.sum() * (1 - 1 / value) < 0.25:
            break
        step = np.linalg.solve(basis, config.astype(float))
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(ratio.argmin())
        x = np.maximum(x - ratio[leave] * step, 0)
        x[leave] = ratio[leave]
        basis[:, leave] = config
    return [(basis[:, j].astype(np.int64), int(x[j] + 1e-6)) for j in range(k) if x[j] + 1e-6 >= 1]


class Bins:
    """Runs of sequences that are filled alike, found by free room."""

    def __init__(self) -> None:
        self.by_room: dict[int, list[tuple[int, int]]] = {}
        self.rooms: list[int] = []
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, first rank, count, first sequence, offset
        self.next_sequence = 0
        self.used: dict[int, int] = {}

    def put(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.runs.append((length, self.used.get(length, 0), count, sequence, offset))
        self.used[length] = self.used.get(length, 0) + count

    def leave(self, room: int, sequence: int, count: int) -> None:
        if room and count:
            if room not in self.by_room:
                self.by_room[room] = []
                bisect.insort(self.rooms, room)
            self.by_room[room].append((sequence, count))

    def best_fit(self, capacity: int, length: int, count: int) -> None:
        """Each piece of this length goes where the least room is left."""
        while count:
            at = bisect.bisect_left(self.rooms, length)
            if at == len(self.rooms):
                room, sequence, many = capacity, self.next_sequence, -(-count // (capacity // length))
                self.next_sequence += many
            else:
                room = self.rooms[at]
                sequence, many = self.by_room[room].pop()
                if not self.by_room[room]:
                    del self.by_room[room]
                    self.rooms.pop(at)
            fit = room // length
            full = min(many, count // fit)
            for i in range(fit if full else 0):
                self.put(length, full, sequence, capacity - room + i * length)
            self.leave(room - fit * length, sequence, full)
            count -= full * fit
            rest = many - full
            if rest and 0 < count < fit:
                for i in range(count):
                    self.put(length, 1, sequence + full, capacity - room + i * length)
                self.leave(room - count * length, sequence + full, 1)
                full, rest, count = full + 1, rest - 1, 0
            self.leave(room, sequence + full, rest)


def plan(hist: dict[int, int], capacity: int, small: int, groups: int, rounds: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, offset): the rank-th piece of a length has its own place.

    Only a share of each configuration's copies is made: while many lengths are left, the last slot finds one that fills
    the sequence. What remains is packed best-fit, largest first, into the room left over and then new sequences. Of a
    few shares the one that takes the fewest sequences is used; all start from the same configurations.
    """
    hist = dict(hist)
    full = hist.pop(capacity, 0)
    parts = grouped(hist, small, groups)
    merged: dict[int, int] = {}
    for p in parts:
        merged[max(p)] = merged.get(max(p), 0) + sum(p.values())
    keys = sorted(merged, reverse=True)
    found = configurations(keys, [merged[s] for s in keys], capacity, rounds) if keys else []
    slots = [([keys[i] for i, n in enumerate(config) for _ in range(n)], copies) for config, copies in found]
    tried = [substituted(hist, full, slots, capacity, small, share) for share in SHARES]
    return min(tried, key=lambda bins: bins.next_sequence).runs


#: Shares of the configurations' copies that are tried.
SHARES = (0.3, 0.6, 0.8, 0.95)


def substituted(hist: dict[int, int], full: int, configs: list[tuple[list[int], int]], capacity: int, small: int, share: float) -> Bins:
    """Actual lengths in the place of the configurations' rounded ones, then the rest and the small ones best-fit."""
    bins = Bins()
    if full:
        bins.put(capacity, full, 0, 0)
        bins.next_sequence = full
    left = {n: c for n, c in hist.items() if n >= small}
    order = sorted(left)

    def largest(most: int, taken: dict[int, int]) -> int:
        """The largest length up to `most` of which more are left than this sequence has taken; 0 if none."""
        at = bisect.bisect_right(order, most) - 1
        while at >= 0 and left[order[at]] <= taken.get(order[at], 0):
            at -= 1
        return order[at] if at >= 0 else 0

    for slots, copies in configs:
        copies = int(copies * share)
        while copies:
            # Each slot's rounded length gives way to an actual one; the last slot may use all the room that is left.
            taken: dict[int, int] = {}
            chosen, room = [], capacity
            for j, slot in enumerate(slots):
                n = largest(room if j == len(slots) - 1 else slot, taken)
                if n:
                    taken[n] = taken.get(n, 0) + 1
                    chosen.append(n)
                    room -= n
            if not chosen:
                break
            take = min([copies, *(left[n] // m for n, m in taken.items())])
            offset = 0
            for n in chosen:
                bins.put(n, take, bins.next_sequence, offset)
                offset += n
            for n, m in taken.items():
                left[n] -= take * m
                if not left[n]:
                    order.remove(n)
            bins.leave(room, bins.next_sequence, take)
            bins.next_sequence += take
            copies -= take
    for n in reversed(order):
        bins.best_fit(capacity, n, left[n])
    for n in sorted((n for n in hist if n < small), reverse=True):
        bins.best_fit(capacity, n, hist[n])
    return bins


def pack(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    tokenizer_path: str,
    capacity: int = 1024,
    small: int = 96,
    groups: int = 32,
    rounds: int = 400,
    digest: Callable[[np.ndarray], object] = piece_ids,
    digest_type: str = "array<long>",
) -> DataFrame:
    """Packs every document of docs(doc_id, text) into sequences of at most capacity tokens.

    Returns per piece doc_id, piece, start, length, digest (by default the piece's ids), sequence_id and offset; pieces
    of a sequence stand one after another from offset 0. A null or empty text is the end token alone. Rows that repeat
    a doc_id are packed each. An empty table gives no row. Longer documents are cut so that their first piece may be
    the shorter one; all other documents stay whole. Ids are those of the tokenizer file; the rank file, its vocabulary, and
    the pattern give them faster.
    """
    pieces = saved(tokenised(docs, ranks_path, pattern, capacity, digest, digest_type, tokenizer_path))
    hist = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    runs = plan(hist, capacity, small, groups, rounds)
    spark = docs.sparkSession
    # Ranks within a length, without one task per length: the more rows it has, the more salts count their own rows first.
    # Arrow tables, as lists of rows would start Python workers of another kind beside those that hold the encoder.
    salts = spark.createDataFrame(pa.table({"length": pa.array(hist, pa.int64()), "salts": pa.array([1 + c // SALTED for c in hist.values()], pa.int64())}))
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "digest"), F.col("salts"))).drop("salts")
    share = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    share = share.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", F.xxhash64("digest"))
    ranked = (
        salted.withColumn("own_rank", F.row_number().over(own) - 1)
        .join(F.broadcast(share) if len(hist) + sum(hist.values()) // SALTED <= MOST_KEYS else share, ["length", "salt"])
        .withColumn("rank", F.col("before") + F.col("own_rank"))
    )
    # One row per length: its runs by first rank. Their number is bounded by the groups and the capacity, not the input.
    by_length: dict[int, list] = {}
    for n, first, count, sequence, offset in runs:
        by_length.setdefault(n, []).append((first, count, sequence, offset))
    run = pa.struct([(c, pa.int64()) for c in ("first", "count", "sequence", "offset")])
    each = [[dict(zip(run.names, x, strict=True)) for x in sorted(r)] for r in by_length.values()]
    places = spark.createDataFrame(pa.table({"length": pa.array(by_length, pa.int64()), "runs": pa.array(each, pa.list_(run))}))
    placed = ranked.join(F.broadcast(places), "length").withColumn(
        "run", F.element_at(F.filter("runs", lambda r: (r["first"] <= F.col("rank")) & (F.col("rank") < r["first"] + r["count"])), 1)
    )
    return placed.select(
        "doc_id", "piece", "start", "length", "digest",
        (F.col("run.sequence") + F.col("rank") - F.col("run.first")).alias("sequence_id"), F.col("run.offset").alias("offset"),
    )

"""Three-way merges of texts against their base, and line diffs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What marks the two sides of a conflict in code.
SIDES = ("A", "B")


#: Edits up to which a furthest-reaching search along diagonals is tried; more go to bit-parallel rows, halved in turn.
FEW_EDITS = 200


def few_edits(a: list[int], b: list[int], most: int = FEW_EDITS) -> list[tuple[int, int]] | None:
    """Pairs of a longest common subsequence, if at most `most` insertions and deletions lead from a to b; else None.

    On each diagonal the farthest point that d edits reach is kept; the steps are read back from these.
    """
    n, m = len(a), len(b)
    reach, trace = {1: 0}, []
    for d in range(min(most, n + m) + 1):
        before = dict(reach)
        trace.append(before)
        for k in range(-d, d + 1, 2):
            down = k == -d or (k != d and before.get(k - 1, -1) < before.get(k + 1, -1))
            x = before[k + 1] if down else before[k - 1] + 1
            y = x - k
            while x < n and y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            reach[k] = x
            if x >= n and y >= m:
                return walked_back(trace, n, m)
    return None


def walked_back(trace: list[dict[int, int]], x: int, y: int) -> list[tuple[int, int]]:
    """The pairs on the way that few_edits() found."""
    out = []
    for d in range(len(trace) - 1, -1, -1):
        before, k = trace[d], x - y
        down = k == -d or (k != d and before.get(k - 1, -1) < before.get(k + 1, -1))
        px = before[k + 1] if down else before[k - 1]
        py = px - (k + 1 if down else k - 1)
        while x > max(px, 0) and y > max(py, 0) and x - (px if down else px + 1) > 0:
            x, y = x - 1, y - 1
            out.append((x, y))
        if not d:
            break
        x, y = px, py
    return out[::-1]


def row_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """For each prefix of b the length of its longest common subsequence with a, by one long number per line of a."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    every = (1 << len(b)) - 1
    row = every  # a zero at j: the length grows there
    for x in a:
        hit = row & where.get(x, 0)
        row = (row + hit | row - hit) & every
    grows = np.unpackbits(np.frombuffer((~row & every).to_bytes(len(b) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(grows, dtype=np.int64)])


def many_edits(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence: a is halved, and b cut where the halves have most in common with its parts."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        p, q, r, s = todo.pop()
        if q - p == 1:
            out += [(p, next(j for j in range(r, s) if b[j] == a[p]))] if a[p] in b[r:s] else []
        elif q > p and s > r:
            mid = (p + q) // 2
            both = row_lengths(a[p:mid], b[r:s]) + row_lengths(a[mid:q][::-1], b[r:s][::-1])[::-1]
            cut = r + int(both.argmax())
            todo += [(p, mid, r, cut), (mid, q, cut, s)]
    return sorted(out)


def line_pairs(base: list[str], other: list[str]) -> dict[int, int]:
    """Base line -> other line of a longest common subsequence of lines. Where lines repeat, several are and this is one.

    It holds the common lines at both ends. Memory grows with the number of lines, time with lines and edits, or, where
    those are many, with the product of the lines that both sides have over the bits of a word.
    """
    n = min(len(base), len(other))
    head = next((i for i in range(n) if base[i] != other[i]), n)
    tail = next((i for i in range(n - head) if base[-1 - i] != other[-1 - i]), n - head)
    out = {i: i for i in range(head)} | {len(base) - 1 - i: len(other) - 1 - i for i in range(tail)}
    # Lines that the other side lacks cannot match.
    common = set(base[head : len(base) - tail]) & set(other[head : len(other) - tail])
    number = {x: i for i, x in enumerate(common)}
    left = [i for i in range(head, len(base) - tail) if base[i] in common]
    right = [j for j in range(head, len(other) - tail) if other[j] in common]
    a, b = [number[base[i]] for i in left], [number[other[j]] for j in right]
    pairs = few_edits(a, b)
    out.update((left[i], right[j]) for i, j in (many_edits(a, b) if pairs is None else pairs))
    return out


def merge_text(merge_class: str, base: str, ours: str, theirs: str, sides: tuple[str, str] = SIDES) -> tuple[str, bool]:
    """(merged, conflict). Later text wins a region that both sides changed; code shows both; a binary is taken whole."""
    if merge_class == "binary" or "\0" in base + ours + theirs:
        return theirs, len({base, ours, theirs}) == 3
    b, o, t = (re.findall(r"[^\n]*\n|[^\n]+", x) for x in (base, ours, theirs))
    to_ours, to_theirs = line_pairs(b, o), line_pairs(b, t)
    out, conflict, at = [], False, (0, 0, 0)
    ends = [(i, to_ours[i], to_theirs[i]) for i in sorted(to_ours.keys() & to_theirs.keys())]
    for end in [*ends, (len(b), len(o), len(t))]:
        was, left, right = ("".join(x[p:q]) for x, p, q in zip((b, o, t), at, end, strict=True))
        if left == right or right == was:
            out.append(left)
        elif left == was:
            out.append(right)
        else:
            conflict = True
            ended = [x if not x or x.endswith("\n") else f"{x}\n" for x in (left, right)]
            out.append(f"<<<<<<< {sides[0]}\n{ended[0]}=======\n{ended[1]}>>>>>>> {sides[1]}\n" if merge_class == "code" else right)
        if end[0] < len(b):
            out.append(b[end[0]])
        at = tuple(x + 1 for x in end)
    return "".join(out), conflict


def common_head(a: str, b: str) -> str:
    """SQL: how many first elements two arrays share; past the end of the shorter one nothing is equal."""
    return f"cast(array_position(concat(zip_with({a}, {b}, (l, r) -> l <=> r), array(false)), false) - 1 as int)"


def let(names: dict[str, str], into: str) -> str:
    """SQL: `into` over values by name, x.name. The values are computed once, however often `into` names them.

    As columns of their own they would be written out anew for every mention once Spark pushes filters and merges projections.
    """
    return f"transform(array(struct({', '.join(f'{v} as {k}' for k, v in names.items())})), x -> {into})[0]"


def one_run_each() -> Column:
    """The merge where each side changed one run of lines and a kept base line stands between; else null.

    Each side's run is what its common head and tail with the base leave, as in merge_text(), which settles all other cases.
    A zero byte ends the last line, so that one without a line break equals no line with one.
    """
    sides = ("base", "ours", "theirs")
    lines = {x: rf"split(concat({x}, '\0'), '\n', -1)" for x in sides}
    held = {x: f"x.{x}" for x in sides}
    heads = {f"p{x}": common_head("x.base", f"x.{x}") for x in sides[1:]}
    left = lambda x, side: f"reverse(slice(x.{x}, x.p{side} + 1, greatest(size(x.{x}) - x.p{side}, 0)))"
    tails = {f"s{x}": common_head(left("base", x), left(x, x)) for x in sides[1:]}
    put = lambda a, b: f"concat(slice(x.{a}, 1, size(x.{a}) - x.s{a}), slice(x.base, size(x.base) - x.s{a} + 1, x.p{b} - size(x.base) + x.s{a}), slice(x.{b}, x.p{b} + 1, size(x.{b}) - x.p{b}))"
    case = lambda a, b: f"when size(x.base) - x.s{a} < x.p{b} then replace(array_join({put(a, b)}, '\\n'), '\\0', '')"
    hunks = f"case {case('ours', 'theirs')} {case('theirs', 'ours')} end"
    whole = let(lines, let(held | heads, let(held | {h: f"x.{h}" for h in heads} | tails, hunks)))
    return F.when(F.instr(F.concat(*sides), "\0") == 0, F.expr(whole))


def merge3(triples: DataFrame) -> DataFrame:
    """key, merged and conflict of triples(key, merge_class, base, ours, theirs).

    Sides that agree, or of which one did not change, and texts in which each side changed one run of lines are settled by
    expressions; only the rest, if there is any, goes to Python, in batches.
    """
    agree, ours_only, theirs_only = F.col("ours") == F.col("theirs"), F.col("theirs") == F.col("base"), F.col("ours") == F.col("base")
    binary = F.col("merge_class") == "binary"
    merged = F.when(binary, F.col("theirs")).when(agree | ours_only, F.col("ours")).when(theirs_only, F.col("theirs")).otherwise(one_run_each())
    # Generated rows: no filter on them moves below, where the merge would be computed once more.
    done = F.explode(F.array(F.struct(merged.alias("merged"), (binary & ~(agree | ours_only | theirs_only)).alias("conflict")))).alias("done")
    rows = triples.select("key", "merge_class", "base", "ours", "theirs").select("*", done)
    native = rows.filter("done.merged is not null").select("key", "done.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = [merge_text(*x) for x in zip(pdf.merge_class, pdf.base, pdf.ours, pdf.theirs, strict=True)]
            yield pd.DataFrame({"key": pdf.key, "merged": [m for m, _ in both], "conflict": [c for _, c in both]})

    rest = rows.filter("done.merged is null").select("key", "merge_class", "base", "ours", "theirs")
    if rest.isEmpty():
        return native
    kind = triples.schema["key"].dataType.simpleString()
    return native.unionByName(rest.mapInPandas(run, f"key {kind}, merged string, conflict boolean"))


def line_diff(df: DataFrame, before: str = "before", after: str = "after", context: int = 2) -> DataFrame:
    """Adds line (the first that differs, from 1), removed, added, and context, the lines just before; 0 and none if equal.

    An empty side has no lines; null counts as empty.
    """
    for side, text in (("a", before), ("b", after)):
        df = df.withColumn(f"__{side}", F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1)))
    # The longest common prefix, then the longest common suffix of what is left.
    head = "coalesce(nullif(array_position(zip_with(__a, __b, (x, y) -> x <=> y), false), 0) - 1, least(size(__a), size(__b)))"
    rows = df.withColumn("__p", F.expr(f"cast({head} as int)"))
    for side in ("a", "b"):
        rows = rows.withColumn(f"__{side}t", F.expr(f"reverse(slice(__{side}, __p + 1, greatest(size(__{side}) - __p, 0)))"))
    tail = "coalesce(nullif(array_position(zip_with(__at, __bt, (x, y) -> x <=> y), false), 0) - 1, least(size(__at), size(__bt)))"
    rows = rows.withColumn("__s", F.expr(f"cast({tail} as int)"))
    part = lambda side: F.expr(f"slice(__{side}, __p + 1, size(__{side}) - __p - __s)")
    differs: Column = F.coalesce(before, F.lit("")) != F.coalesce(after, F.lit(""))
    rows = rows.withColumn("line", F.when(differs, F.col("__p") + 1).otherwise(0)).withColumn("removed", part("a")).withColumn("added", part("b"))
    none = F.array().cast("array<string>")
    rows = rows.withColumn("context", F.when(differs, F.expr(f"slice(__a, greatest(__p - {context}, 0) + 1, least(__p, {context}))")).otherwise(none))
    return rows.drop("__a", "__b", "__p", "__at", "__bt", "__s")

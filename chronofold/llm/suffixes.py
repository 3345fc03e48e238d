"""Deep-shallow sorting of suffixes, and the repeats that a sorted order shows.

Multikey quicksort orders suffixes to a shallow depth; groups that are still equal there go to a blind trie, which reads
only branching bytes on the way down and compares with one leaf, and so orders long common prefixes cheaply.
"""

from __future__ import annotations

import bisect

SHALLOW = 24


def lcp(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class BlindTrie:
    """A trie of branching points only: a node knows how many bytes its leaves share and the next byte of each branch."""

    def __init__(self, suffixes: list[bytes]):
        self.suffixes = suffixes
        self.root: list | None = None

    def next_byte(self, i: int, depth: int) -> int:
        s = self.suffixes[i]
        return s[depth] if depth < len(s) else -1

    def add(self, i: int) -> None:
        """Nodes are [depth, {byte: node}]; leaves are [None, [suffixes that are equal]]."""
        if self.root is None:
            self.root = [None, [i]]
            return
        node = self.root
        while node[0] is not None:  # blind: skipped bytes are not looked at
            node = node[1].get(self.next_byte(i, node[0])) or next(iter(node[1].values()))
        other = node[1][0]
        a, b = self.suffixes[i], self.suffixes[other]
        shared = lcp(a, b)
        if shared == len(a) == len(b):
            node[1].append(i)
            return
        parent, node = None, self.root
        while node[0] is not None and node[0] < shared:
            parent = node, self.next_byte(i, node[0])
            node = node[1][parent[1]]
        if node[0] == shared:
            node[1][self.next_byte(i, shared)] = [None, [i]]
            return
        split = [shared, {self.next_byte(other, shared): node, self.next_byte(i, shared): [None, [i]]}]
        if parent:
            parent[0][1][parent[1]] = split
        else:
            self.root = split

    def order(self) -> list[int]:
        out, todo = [], [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if node[0] is None:
                out += node[1]
            else:
                todo += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def deep_shallow(suffixes: list[bytes], start: int = 0, shallow: int = SHALLOW) -> list[int]:
    """Indexes of the suffixes in byte order; all are known to share their first `start` bytes. Equal ones keep theirs."""
    out: list[int] = []
    todo = [(list(range(len(suffixes))), start)]
    while todo:
        group, depth = todo.pop()
        if len(group) < 2:
            out += group
        elif depth >= start + shallow:
            trie = BlindTrie(suffixes)
            for i in group:
                trie.add(i)
            out += trie.order()
        else:
            keys = [suffixes[i][depth] if depth < len(suffixes[i]) else -1 for i in group]
            pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
            less = [i for i, c in zip(group, keys, strict=True) if c < pivot]
            same = [i for i, c in zip(group, keys, strict=True) if c == pivot]
            more = [i for i, c in zip(group, keys, strict=True) if c > pivot]
            # Suffixes that have ended are equal: nothing is left to order.
            todo += [(more, depth)] * bool(more) + [(same, depth + 1 if pivot >= 0 else start + shallow)] + [(less, depth)] * bool(less)
    return out


def reaches(lefts: list[bytes], rights: list[bytes], least: int, start: int = 0) -> list[tuple[int, int]]:
    """Per place the bytes to its left and right that repeated strings of `least` bytes over it cover; (0, 0) if none.

    lefts holds what stands before each place, backwards, and rights what stands from it on; all rights share their first
    `start` bytes. A pair of places repeats a string if its common left and right parts have `least` bytes together. All
    such strings of a place hold the place, so their union runs from the longest left to the longest right part.

    Places are ordered by their right parts, and joined from the longest common right parts down (as in a suffix tree).
    When two sets meet, each place of the smaller one looks at its neighbours by left part in the other: any farther one
    shares no more with it on either side. So m places take about m log^2 m steps, however alike they are.
    """
    m = len(rights)
    best = [[0, 0] for _ in range(m)]
    order = deep_shallow(rights, start)
    left_order = deep_shallow(lefts)
    rank = [0] * m
    for r, i in enumerate(left_order):
        rank[i] = r

    def meet(i: int, j: int, right: int) -> None:
        left = lcp(lefts[i], lefts[j])
        if left + right >= least:
            for x in (i, j):
                b = best[x]
                b[0], b[1] = max(b[0], left), max(b[1], right)

    joints = sorted(((lcp(rights[a], rights[b]), k) for k, (a, b) in enumerate(zip(order, order[1:], strict=False))), reverse=True)
    boss = list(range(m))
    members = [[rank[i]] for i in order]  # by place in the order: the ranks of a set, sorted

    def find(k: int) -> int:
        while boss[k] != k:
            boss[k] = boss[boss[k]]
            k = boss[k]
        return k

    for right, k in joints:
        a, b = find(k), find(k + 1)
        if len(members[a]) < len(members[b]):
            a, b = b, a
        large = members[a]
        for r in members[b]:
            at = bisect.bisect_left(large, r)
            for near in large[max(at - 1, 0) : at + 1]:
                meet(left_order[r], left_order[near], right)
        # A place of the larger set may have its best partner in the smaller one only if nothing of its own set is between.
        for r in members[b]:
            bisect.insort(large, r)
        members[b] = []
        boss[b] = a
    return [tuple(b) for b in best]

"""Prefix-tree join of sets within one task.

Sets, their elements in one order, are stored in a trie with a node for each run of elements that the same sets share. A probe
walks the trie level by level and carries the overlap so far, which all sets below a node share. A subtree is left as soon as the overlap
so far plus what can still come (the longest remainder below the node, the probe's elements behind it) can't reach the
overlap that the smallest set below asks for. At a set's end the overlap is exact.

Only components are wanted, so a subtree whose sets are all connected to the probe already is left as well.
"""

from __future__ import annotations

import numpy as np


class Components:
    def __init__(self, labels: np.ndarray) -> None:
        _, self.of = np.unique(labels, return_inverse=True)

    def join(self, a: int, b: int) -> bool:
        x, y = self.of[a], self.of[b]
        if x == y:
            return False
        self.of[self.of == max(x, y)] = min(x, y)
        return True


def needed(n_a, n_b):
    """The least overlap of sets with a Jaccard similarity of 0.8: 100 * o >= 80 * (n_a + n_b - o)."""
    return (4 * (n_a + n_b) + 8) // 9


class Trie:
    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray) -> None:
        """``sets``: element ranks, ascending; ``sizes``: the whole sets' sizes (elements that nothing shares may be left out)."""
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.order = np.array(order)
        ordered = [sets[i] for i in order]
        shared = [0]
        for x, y in zip(ordered, ordered[1:]):
            k = min(len(x), len(y))
            apart = np.flatnonzero(x[:k] != y[:k])
            shared.append(int(apart[0]) if len(apart) else k)
        depth, parent, first, last, leaf = [0.0], [-1], [0], [len(sets)], [-1]
        stack = [0]

        def new(d: float, lo: int, end: int) -> int:
            depth.append(d)
            parent.append(-1)
            first.append(lo)
            last.append(-1)
            leaf.append(end)
            return len(depth) - 1

        def close(upto: int, at: int) -> None:
            """Close the nodes deeper than ``upto`` before set ``at``; a node of that depth is on top of the stack then."""
            while depth[stack[-1]] > upto:
                x = stack.pop()
                last[x] = at
                if depth[stack[-1]] < upto:
                    stack.append(new(float(upto), first[x], -1))
                parent[x] = stack[-1]

        for i, s in enumerate(ordered):
            close(shared[i], i)
            stack.append(new(len(s) + 0.5, i, i))
        close(0, len(ordered))
        self.parent, self.leaf = np.array(parent), np.array(leaf)
        self.first, self.last = np.array(first), np.array(last)
        ends = np.floor(np.array(depth)).astype(np.int64)
        begins = np.where(self.parent >= 0, ends[self.parent], 0)
        offsets = np.cumsum([0, *map(len, ordered)])
        self.flat = np.concatenate(ordered).astype(np.int64) if ordered else np.zeros(0, np.int64)
        self.seg = offsets[self.first] + begins
        self.seg_len = ends - begins
        lengths, own = np.diff(offsets), sizes[self.order]
        least, longest = np.full(len(ends), np.iinfo(np.int64).max), np.zeros(len(ends), np.int64)
        for x in range(len(ends)):
            lo, hi = self.first[x], self.last[x]
            if hi > lo:
                least[x], longest[x] = own[lo:hi].min(), lengths[lo:hi].max()
        self.least, self.remains = least, longest - ends
        by = np.argsort(self.parent, kind="stable")
        counts = np.bincount(self.parent[self.parent >= 0], minlength=len(ends))
        self.children = by[1:] if len(by) else by
        self.child_at, self.child_n = np.cumsum(counts) - counts, counts


def _expand(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) for every place of every run."""
    row = np.repeat(np.arange(len(start)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + start[row]


def join_components(sets: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what similar sets connect: a spanning forest, beyond what ``labels`` connects already.

    With ``side`` (0 or 1 for each set) only pairs of different sides are looked at.
    """
    m = len(sets)
    if m < 2:
        return []
    flat = np.concatenate(sets)
    values, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, -counts))] = np.arange(len(values))  # frequent first, so that sets share the top of the trie
    kept = int((counts > 1).sum())
    cut = np.cumsum([0, *map(len, sets)])
    ranks = []
    for a, b in zip(cut, cut[1:]):
        r = rank[inverse[a:b]]
        ranks.append(np.sort(r[r < kept]))
    lengths = np.array([len(r) for r in ranks])
    hopeful = np.flatnonzero((lengths > 0) & (5 * lengths >= 4 * sizes))
    groups = Components(labels)
    stored = hopeful if side is None else hopeful[side[hopeful] == 0]
    probes = hopeful if side is None else hopeful[side[hopeful] == 1]
    if not len(stored) or not len(probes):
        return []
    trie = Trie([ranks[i] for i in stored], sizes[stored])
    links: list[tuple[int, int]] = []
    at, batch = 0, 1
    most = max(1, min(64, 4_000_000 // max(1, kept)))
    while at < len(probes):
        some = probes[at : at + batch]
        at, batch = at + batch, min(most, 2 * batch)
        for a, b in _walk(trie, stored, some, ranks, sizes, lengths, groups, kept):
            if groups.join(a, b):
                links.append((a, b))
    return links


def _walk(trie: Trie, stored: np.ndarray, probes: np.ndarray, ranks: list[np.ndarray], sizes: np.ndarray, lengths: np.ndarray, groups: Components, kept: int) -> list[tuple[int, int]]:
    label = groups.of[stored[trie.order]]
    change = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
    uniform = change[np.maximum(trie.last - 1, 0)] == change[np.minimum(trie.first, len(label) - 1)]
    of_node = label[np.minimum(trie.first, len(label) - 1)]
    has = np.zeros((len(probes), kept), bool)
    for i, p in enumerate(probes):
        has[i, ranks[p]] = True
    upto = np.cumsum(has, axis=1, dtype=np.int32)
    mine, n_mine, len_mine = groups.of[probes], sizes[probes], lengths[probes]
    who, node, overlap = np.arange(len(probes)), np.zeros(len(probes), np.int64), np.zeros(len(probes), np.int64)
    found: list[tuple[int, int]] = []
    while len(who):
        row, place = _expand(trie.child_at[node], trie.child_n[node])
        who, overlap, node = who[row], overlap[row], trie.children[place]
        new = ~(uniform[node] & (of_node[node] == mine[who]))
        who, overlap, node = who[new], overlap[new], node[new]
        row, place = _expand(trie.seg[node], trie.seg_len[node])
        hits = has[who[row], trie.flat[place]]
        overlap = overlap + np.bincount(row, hits, minlength=len(node)).astype(np.int64)
        end = trie.seg[node] + trie.seg_len[node] - 1
        behind = np.where(trie.seg_len[node] > 0, len_mine[who] - upto[who, trie.flat[np.maximum(end, 0)]], len_mine[who] - overlap)
        enough = overlap + np.minimum(trie.remains[node], behind) >= needed(n_mine[who], trie.least[node])
        who, overlap, node = who[enough], overlap[enough], node[enough]
        ends = trie.leaf[node] >= 0
        for w, x, o in zip(who[ends].tolist(), node[ends].tolist(), overlap[ends].tolist(), strict=True):
            other = int(stored[trie.order[trie.leaf[x]]])
            if other != probes[w] and o >= needed(int(sizes[probes[w]]), int(sizes[other])):
                found.append((int(probes[w]), other))
        who, overlap, node = who[~ends], overlap[~ends], node[~ends]
    return found

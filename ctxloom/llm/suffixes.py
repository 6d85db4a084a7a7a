"""Deep-shallow sorting of suffixes: multikey quicksort to a shallow depth, then blind tries."""

from __future__ import annotations

import numpy as np

#: Bytes that multikey quicksort compares, a machine word of 8 at a time, before blind tries take over.
SHALLOW = 24


def _word(rows: np.ndarray, at: int) -> np.ndarray:
    part = rows[:, at : at + 8]
    if part.shape[1] < 8:
        part = np.pad(part, ((0, 0), (0, 8 - part.shape[1])))
    return np.ascontiguousarray(part).view(">u8").ravel().astype(np.uint64)


def _multikey(rows: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): rows sorted by their first ``depth`` bytes; rows still equal share a group number.

    At each word only the rows that were equal so far are partitioned again, by (group, word).
    """
    order = np.argsort(_word(rows, 0), kind="stable")
    w = _word(rows, 0)[order]
    fresh = np.r_[True, w[1:] != w[:-1]] if len(w) else np.empty(0, bool)
    for at in range(8, min(depth, rows.shape[1]), 8):
        group = np.cumsum(fresh)
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        where = np.flatnonzero(tied)
        if not len(where):
            break
        w, g = _word(rows[order[where]], at), group[where]
        again = np.lexsort((w, g))
        order[where] = order[where][again]
        w, g = w[again], g[again]
        fresh[where] = np.r_[True, (w[1:] != w[:-1]) | (g[1:] != g[:-1])]
    return order, np.cumsum(fresh)


class BlindTrie:
    """A trie that stores branching depths and bytes only; texts are looked at once for each insertion.

    Nodes are [depth, {byte: node}], leaves are the lists of equal texts. Texts have equal prefixes and end marks that order
    a text before its continuations.
    """

    def __init__(self, text: bytes, name: int):
        self.top: list = [text, [name]]
        self.leaf = True

    def add(self, text: bytes, name: int) -> None:
        if self.leaf:
            other = self.top[0]
            if other == text:
                self.top[1].append(name)
                return
            d = _common(other, text)
            self.top, self.leaf = [d, {other[d]: self.top, text[d]: [text, [name]]}], False
            return
        node = self.top
        while isinstance(node[0], int):  # blindly to some leaf
            node = node[1].get(text[node[0]]) if node[0] < len(text) and text[node[0]] in node[1] else next(iter(node[1].values()))
        if node[0] == text:
            node[1].append(name)
            return
        d = _common(node[0], text)
        above, node = None, self.top
        while isinstance(node[0], int) and node[0] < d:
            above, node = node, node[1][text[node[0]]]
        if isinstance(node[0], int) and node[0] == d:
            node[1][text[d]] = [text, [name]]
            return
        some = node
        while isinstance(some[0], int):
            some = next(iter(some[1].values()))
        split = [d, {some[0][d]: node, text[d]: [text, [name]]}]
        if above is None:
            self.top = split
        else:
            above[1][text[above[0]]] = split

    def order(self) -> list[int]:
        out, stack = [], [self.top]
        while stack:
            node = stack.pop()
            if isinstance(node[0], int):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out += node[1]
        return out


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two different texts neither of which is a prefix of the other."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def deep_shallow_sort(rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of suffixes cut at a fixed depth: ``rows`` (n, depth) bytes, zero after ``lengths``.

    A suffix sorts before its continuations; lcp[i] is the number of bytes that the i-th has in common with the one before.
    Equal suffixes keep their order.
    """
    n, depth = rows.shape
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # The end mark: the length as a last byte tells a text from one that goes on with zero bytes.
    marked = np.concatenate((rows, lengths.astype(np.uint8)[:, None]), axis=1)
    order, group = _multikey(marked, SHALLOW)
    tied = np.flatnonzero(np.r_[group[1:] == group[:-1], False] | np.r_[False, group[1:] == group[:-1]])
    if len(tied) and depth >= SHALLOW:
        # Equal suffixes share one leaf; groups with a single leaf are sorted already.
        rest, g = marked[order[tied], SHALLOW:], group[tied]
        same = np.r_[False, (g[1:] == g[:-1]) & (rest[1:] == rest[:-1]).all(axis=1)]
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        mixed = np.add.reduceat(~same, first) > 1
        stop = np.r_[first[1:], len(g)]
        for a, b in zip(first[mixed].tolist(), stop[mixed].tolist(), strict=True):
            at = tied[a]
            names = order[at : at + b - a]
            width = rest.shape[1]
            raw = rest[a:b].tobytes()
            trie = BlindTrie(raw[:width], 0)
            for k in range(1, b - a):
                trie.add(raw[k * width : (k + 1) * width], k)
            order[at : at + b - a] = names[trie.order()]
    lcp = np.zeros(n, np.int64)
    for k in range(1, n, 1 << 16):
        a, b = order[k - 1 : min(n, k + (1 << 16)) - 1], order[k : k + (1 << 16)]
        differ = rows[a] != rows[b]
        found = np.where(differ.any(axis=1), differ.argmax(axis=1), depth)
        lcp[k : k + len(b)] = np.minimum(found, np.minimum(lengths[a], lengths[b]))
    return order, lcp

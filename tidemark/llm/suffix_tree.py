"""Suffix trees of number sequences (Ukkonen), and longest common extensions over their tours.

The tree is built left to right in one pass with suffix links. A tour visits its leaves in
lexicographic order; of the Euler tour only the shallowest node between two neighbouring leaves
is kept, as the lowest common ancestor of any two leaves is the shallowest of those between
them. A table of minima over stretches of 1, 2, 4, ... neighbours answers that in constant time
for any number of pairs at once. Memory grows with n log n for n numbers.
"""

from __future__ import annotations

import numpy as np


class SuffixTree:
    """Edges of the tree of ``letters`` and a closing 0, which no letter may be.

    Nodes are numbered as they are made, the root is 0; ``suffix`` is -1 for inner nodes and the
    first position of its suffix for a leaf. An edge into a node spells ``[begin, end)``.
    """

    def __init__(self, letters: list[int]):
        text = [*letters, 0]
        n, width = len(text), max(text) + 1
        child: dict[int, int] = {}
        begin, end, link, suffix = [0], [0], [0], [-1]
        node = edge = length = pending = 0
        leaves = 0
        for i, letter in enumerate(text):
            made = 0  # the last inner node that waits for its link
            pending += 1
            while pending:
                if not length:
                    edge = i
                key = node * width + text[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(begin)
                    if made:
                        link[made] = node
                        made = 0
                else:
                    size = end[below] - begin[below]
                    if length >= size:
                        edge += size
                        length -= size
                        node = below
                        continue
                    first = begin[below]
                    if text[first + length] == letter:
                        length += 1
                        if made:
                            link[made] = node
                        break
                    split = len(begin)
                    begin.append(first)
                    end.append(first + length)
                    link.append(0)
                    suffix.append(-1)
                    child[key] = split
                    begin[below] = first + length
                    child[split * width + text[first + length]] = below
                    child[split * width + letter] = split + 1
                    if made:
                        link[made] = split
                    made = split
                begin.append(i)
                end.append(n)
                link.append(0)
                suffix.append(leaves)
                leaves += 1
                pending -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - pending + 1
        self.size = n
        self.begin, self.end, self.suffix = begin, end, suffix
        keys = np.fromiter(child.keys(), np.int64, len(child))
        order = np.argsort(keys)
        below = np.fromiter(child.values(), np.int64, len(child))
        self.below = below[order].tolist()  # children, grouped by parent and in order of letters
        self.groups = np.searchsorted(keys[order] // width, np.arange(len(begin) + 1)).tolist()

    def tour(self) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in lexicographic order, and the depth of the shallowest node between
        neighbours."""
        begin, end, suffix, groups, below = self.begin, self.end, self.suffix, self.groups, self.below
        depth = [0] * len(begin)
        above = [0] * len(begin)
        order, between = [], []
        stack, after_leaf = [0], False
        while stack:
            node = stack.pop()
            if after_leaf:
                between.append(depth[above[node]])
                after_leaf = False
            if suffix[node] >= 0:
                order.append(suffix[node])
                after_leaf = True
                continue
            own = depth[above[node]] + end[node] - begin[node]
            depth[node] = own
            for k in below[groups[node] : groups[node + 1]][::-1]:
                above[k] = node
                stack.append(k)
        return np.array(order, np.int64), np.array(between, np.int32)


class Extensions:
    """Longest common extensions to the right between positions of ``letters``, and the
    lexicographic ``rank`` of every suffix."""

    def __init__(self, letters: list[int]):
        order, between = SuffixTree(letters).tour()
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.minima = [between]
        while 2 * (1 << len(self.minima) - 1) <= len(between):
            last, step = self.minima[-1], 1 << len(self.minima) - 1
            self.minima.append(np.minimum(last[:-step], last[step:]))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common beginning of the suffixes at ``a`` and ``b``, which differ."""
        low, high = np.sort([self.rank[a], self.rank[b]], axis=0)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        found = np.zeros(len(low), np.int64)
        for k in np.unique(level).tolist():
            at = level == k
            table = self.minima[k]
            found[at] = np.minimum(table[low[at]], table[high[at] - (1 << k)])
        return found

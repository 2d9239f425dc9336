"""BK-trees over 64-bit fingerprints, many trees at once.

A tree's children hang under their parent by the integer Hamming distance to
it. By the triangle inequality a search with radius r at a node of distance d
follows only the edges d - r .. d + r. Trees are built and searched level by
level on numpy arrays, so one call serves a whole forest.
"""

from __future__ import annotations

import numpy as np

_W = 65  # distances 0..64


class Forest:
    """One BK-tree per tree number; ``fps`` are distinct within a tree."""

    def __init__(self, tree: np.ndarray, fps: np.ndarray):
        self.fps = fps
        self.roots, first = np.unique(tree, return_index=True)
        self.root_node = first
        cur = first[np.searchsorted(self.roots, tree)]
        left = np.flatnonzero(cur != np.arange(len(fps)))
        cur = cur[left]
        edges, nodes = [], []
        while len(left):
            d = np.bitwise_count(fps[left] ^ fps[cur]).astype(np.int64)
            edge = cur * _W + d
            new, at, back = np.unique(edge, return_index=True, return_inverse=True)
            node = left[at]
            edges.append(new)
            nodes.append(node)
            cur = node[back]
            keep = cur != left
            left, cur = left[keep], cur[keep]
        edge = np.concatenate(edges) if edges else np.empty(0, np.int64)
        order = np.argsort(edge, kind="stable")
        self.edge = edge[order]
        self.node = (np.concatenate(nodes) if nodes else np.empty(0, np.int64))[order]

    def search(self, tree: np.ndarray, fps: np.ndarray, radius: int):
        """Yield (query, node) index arrays of all pairs within the radius."""
        at = np.searchsorted(self.roots, tree)
        q = np.arange(len(fps))
        known = (at < len(self.roots)) & (self.roots[np.minimum(at, len(self.roots) - 1)] == tree) \
            if len(self.roots) else np.zeros(len(fps), bool)
        q, node = q[known], self.root_node[at[known]] if len(self.roots) else np.empty(0, np.int64)
        while len(q):
            d = np.bitwise_count(fps[q] ^ self.fps[node]).astype(np.int64)
            near = d <= radius
            yield q[near], node[near]
            lo = np.searchsorted(self.edge, node * _W + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.edge, node * _W + np.minimum(d + radius, _W - 1), side="right")
            n = hi - lo
            q = np.repeat(q, n)
            step = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
            node = self.node[np.repeat(lo, n) + step]


def spanning(n: int, pairs) -> np.ndarray:
    """Least index in reach of each of n items over the streamed index pairs."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            differ = ra != rb
            if not differ.any():
                break
            a, b = a[differ], b[differ]
            hi, lo = np.maximum(ra, rb)[differ], np.minimum(ra, rb)[differ]
            np.minimum.at(root, hi, lo)
            while True:  # flatten
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
    return root

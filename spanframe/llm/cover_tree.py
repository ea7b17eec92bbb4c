"""Cover trees of blocks of vectors, and batches of queries that descend them for the best inner products within windows.

A last component sqrt(M^2 - |x|^2) puts all vectors on a sphere of radius M; a query's is 0. With c a node's center and r its
covering radius (the distance to its farthest member), a member's inner product with a query q lies within |q| r of q.c; and as
the distance d of q to c is known from q.c, it lies between those of the distances d - r and d + r. Both bounds hold; the
tighter one counts.

Each level divides a node's radius: the center stays a child, and members farther than the new radius from all children
become children, the farthest first, so that children cover their members within the radius and are that far apart. A node that
would fall into nearly as many children as it has members is a leaf: there a bound costs what the exact score does.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ._vectors import Best

#: The ratio of the radii of neighbouring levels; members of a leaf that is not split; members a child must have on average.
BASE, LEAF, MEMBERS = 1.5, 64, 4
#: Queries that are scored together.
TOGETHER = 1024
NODES = ("center", "radius", "begin", "end", "child", "children", "depth")


@dataclass
class Tree:
    """Points in the order of leaves; a node's members are points begin to end, its children the nodes from child on."""

    points: np.ndarray
    nodes: dict[str, np.ndarray]
    sphere: float


def build(x: np.ndarray, sphere: float) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(order, nodes) of the rows of x, whose squared norms are sphere at most; nodes stand level by level."""
    n = len(x)
    last = np.sqrt(np.maximum(0.0, sphere - (x * x).sum(axis=1)))
    far = np.sqrt(np.maximum(0.0, 2 * (sphere - x @ x.T - np.outer(last, last))))
    np.fill_diagonal(far, 0.0)
    order = np.arange(n)
    root = int(np.argmin(far.mean(axis=1)))
    made = [[root, float(far[root].max()), 0, n, 0, 0, 0]]
    at = 0
    while at < len(made):
        center, radius, begin, end, _, _, depth = made[at]
        members = order[begin:end].copy()
        if end - begin > LEAF and radius > 0:
            owner, picks = _cover(far, members, center, radius / BASE)
            if len(picks) * MEMBERS <= len(members):
                made[at][4:6] = len(made), len(picks)
                start = begin
                for i, pick in enumerate(picks):
                    mine = members[owner == i]
                    order[start : start + len(mine)] = mine
                    made.append([pick, float(far[pick, mine].max()), start, start + len(mine), 0, 0, depth + 1])
                    start += len(mine)
        at += 1
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    nodes = {k: np.array(v) for k, v in zip(NODES, zip(*made, strict=True), strict=True)}
    nodes["center"] = place[nodes["center"]]
    return order, nodes


def _cover(far: np.ndarray, members: np.ndarray, center: int, radius: float) -> tuple[np.ndarray, list[int]]:
    """Each member's child, and the children: the center, then the farthest member while it is beyond radius of all."""
    picks, dist, owner = [center], far[center, members].copy(), np.zeros(len(members), np.int64)
    while len(picks) * MEMBERS <= len(members):
        j = int(dist.argmax())
        if dist[j] <= radius:
            break
        to = far[members[j], members]
        owner[to < dist] = len(picks)
        dist = np.minimum(dist, to)
        picks.append(int(members[j]))
    return owner, picks


class Search:
    """Queries with windows of scores, and the best k found so far in each window; trees are offered one after the other.

    lo, hi: (queries, windows), closed; a row that is no window has lo > hi. label and own (a query's id, which is no
    candidate) are numbers; same: whether candidates have the query's label or another one."""

    def __init__(self, q: np.ndarray, own: np.ndarray, label: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int, same: bool):
        self.q, self.own, self.label, self.hi, self.k, self.same = q, own, label, hi, k, same
        self.norm, self.windows = np.sqrt((q * q).sum(axis=1)), hi.shape[1]
        self.best = Best(hi.size, k, lo.reshape(-1))  # a window is a row of its own

    def floors(self, a: np.ndarray) -> np.ndarray:
        return self.best.floors(a[:, None] * self.windows + np.arange(self.windows))

    def _open(self, a: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which (query, node) pairs may hold what a window still takes."""
        return ((high[:, None] >= self.floors(a)) & (low[:, None] <= self.hi[a])).any(axis=1)

    def bounds(self, tree: Tree, a: np.ndarray, node: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r, norm = tree.nodes["radius"][node], self.norm[a]
        both = norm**2 + tree.sphere
        d = np.sqrt(np.maximum(0.0, both - 2 * score))
        slack = 1e-7 * (1 + norm * np.sqrt(tree.sphere) + both)
        high = np.minimum(score + norm * r, (both - np.maximum(0.0, d - r) ** 2) / 2) + slack
        low = np.maximum(score - norm * r, (both - (d + r) ** 2) / 2) - slack
        return low, high

    def offer(self, tree: Tree, ids: np.ndarray, labels: np.ndarray) -> tuple[int, int]:
        """Takes in what a tree's points give; returns how many pairs of a query and a point got exact scores, of how many."""
        checked = 0
        for at in range(0, len(self.q), TOGETHER):
            checked += self._offer(tree, ids, labels, np.arange(at, min(at + TOGETHER, len(self.q))))
        return checked, len(self.q) * len(ids)

    def _offer(self, tree: Tree, ids: np.ndarray, labels: np.ndarray, group: np.ndarray) -> int:
        nodes = tree.nodes
        a, node = group, np.zeros(len(group), np.int64)
        found: list[tuple[np.ndarray, ...]] = []
        while len(a):  # level by level, without what lies outside of all windows
            score = np.empty(len(a))
            centers = tree.points[nodes["center"][node]] if len(a) < 65536 else None
            for i in range(0, len(a), 65536):
                part = slice(i, i + 65536)
                c = tree.points[nodes["center"][node[part]]] if centers is None else centers
                score[part] = np.einsum("nd,nd->n", self.q[a[part]], c)
            low, high = self.bounds(tree, a, node, score)
            keep = self._open(a, low, high)
            a, node, low, high = a[keep], node[keep], low[keep], high[keep]
            leaf = nodes["children"][node] == 0
            found.append((a[leaf], node[leaf], low[leaf], high[leaf]))
            a, node = a[~leaf], node[~leaf]
            many = nodes["children"][node]
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            a, node = np.repeat(a, many), np.repeat(nodes["child"][node], many) + step
        a, node, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
        best = np.lexsort((-high, a))  # leaves best first for each query, in rounds of 1, 2, 4 ...
        a, node, low, high = a[best], node[best], low[best], high[best]
        _, first, count = np.unique(a, return_index=True, return_counts=True)
        rank = np.arange(len(a)) - np.repeat(first, count)
        checked, begin, size = 0, 0, 1
        while begin < (count.max() if len(count) else 0):
            now = np.flatnonzero((rank >= begin) & (rank < begin + size))
            now = now[self._open(a[now], low[now], high[now])]
            now = now[np.argsort(node[now], kind="stable")]
            leaves, starts = np.unique(node[now], return_index=True)
            ends = np.append(starts[1:], len(now))[: len(leaves)]
            for x, s, e in zip(leaves.tolist(), starts.tolist(), ends.tolist(), strict=True):
                members = slice(int(nodes["begin"][x]), int(nodes["end"][x]))
                self.take(a[now[s:e]], tree.points[members], ids[members], labels[members])
                checked += (e - s) * (members.stop - members.start)
            begin, size = begin + size, size * 2
        return checked

    def take(self, a: np.ndarray, points: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        """Exact scores of the queries a and all points, merged into what is held."""
        scores = self.q[a] @ points.T
        fits = ((self.label[a][:, None] == labels[None, :]) == self.same) & (self.own[a][:, None] != ids[None, :])
        floors, k = self.floors(a), self.k
        hits = []
        for w in range(self.windows):
            in_window = fits & (scores >= floors[:, w, None]) & (scores <= self.hi[a, w, None])
            if in_window.shape[1] > k and in_window.any():
                held = np.where(in_window, scores, -np.inf)
                in_window &= scores >= np.partition(held, -k, axis=1)[:, -k, None]
            row, col = np.nonzero(in_window)
            hits.append((a[row] * self.windows + w, scores[row, col], ids[col]))
        self.best.merge(*(np.concatenate(x) for x in zip(*hits, strict=True)))

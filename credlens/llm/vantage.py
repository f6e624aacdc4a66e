"""Vantage-point trees over 64-bit fingerprints under the Hamming distance.

A node holds a vantage point and a radius: members no farther from the point are inside, the others outside. By the triangle
inequality a fingerprint whose distance is over radius + r has nothing within r inside, and one at radius - r or less nothing
outside; between the two, it asks on both sides. A pair whose members part at a node is found once: the inner one asks outside.

`Tree` has the upper levels, whose leaves are shards of a table; `links` and `pairs` go on inside a shard, down to leaves
whose members are held against each other. Points and radii are chosen among a few members so that the work left is least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Members of a leaf; cells of a matrix of distances; members and points that a choice looks at.
LEAF, CELLS, LOOKED_AT, POINTS = 128, 1 << 20, 1024, 16

Part = tuple[np.ndarray, np.ndarray]


def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def spread(n: int, most: int) -> np.ndarray:
    """At most so many of n places, evenly spread."""
    return np.arange(n) if n <= most else np.arange(most) * n // most


def choose(members: np.ndarray, r: int) -> tuple[int, int] | None:
    """The place of a vantage point among the members, and a radius: those that leave the least pairs of a member and one
    that asks. None if no split saves a tenth of the pairs."""
    some, points = members[spread(len(members), LOOKED_AT)], spread(len(members), POINTS)
    d = distance(some[None, :], members[points][:, None]).astype(np.int64)
    counts = np.bincount((d + np.arange(len(points))[:, None] * 65).ravel(), minlength=65 * len(points)).reshape(-1, 65)
    upto = np.cumsum(counts, axis=1) / len(some)
    farther = np.concatenate([upto[:, r:], np.repeat(upto[:, -1:], r, axis=1)], axis=1)
    nearer = np.concatenate([np.zeros((len(points), r)), upto[:, : 65 - r]], axis=1)
    left = upto * farther + (1 - upto) * (1 - nearer)
    point, radius = divmod(int(np.argmin(left)), 65)
    return (int(points[point]), radius) if left[point, radius] < 0.9 else None


def parted(at_home: np.ndarray, asking: np.ndarray, home: np.ndarray, ask: np.ndarray, radius: int, r: int) -> tuple[Part, Part]:
    """Members and askers inside, and outside. at_home and asking are distances of the members `home` and the askers `ask`."""
    inner = at_home <= radius
    beyond = home[inner & (at_home + r > radius)]
    return (home[inner], ask[asking <= radius + r]), (home[~inner], np.concatenate([ask[asking + r > radius], beyond]))


class Tree:
    """Vantage points, radii and children of the nodes; a child under 0 is the leaf -1 - child."""

    def __init__(self) -> None:
        self.points: list[int] = []
        self.radii: list[int] = []
        self.children: list[list[int]] = []
        self.root, self.leaves = -1, 1

    def split(self, leaf: int, sample: np.ndarray, most: float, r: int) -> None:
        """Puts nodes in a leaf's place until no new leaf has more than `most` of its sampled members."""

        def grow(members: np.ndarray, leaf: int) -> int:
            found = choose(members, r) if len(members) > max(most, 2) else None
            if found is None:
                return -1 - leaf
            point, radius = members[found[0]], found[1]
            inner = distance(members, point) <= radius
            node, other = len(self.points), self.leaves
            self.points.append(int(point))
            self.radii.append(radius)
            self.children.append([])
            self.leaves += 1
            self.children[node] = [grow(members[inner], leaf), grow(members[~inner], other)]
            return node

        above = next((own for own in self.children if -1 - leaf in own), None)
        side = above.index(-1 - leaf) if above else None
        put = grow(sample, leaf)
        if above is None:
            self.root = put
        else:
            above[side] = put

    def route(self, prints: np.ndarray, r: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each leaf reached: the leaf, places of the prints at home there, and of those that ask there (none if r is None)."""
        stack = [(self.root, np.arange(len(prints)), np.zeros(0, np.int64))]
        while stack:
            node, home, ask = stack.pop()
            if node < 0:
                yield -1 - node, home, ask
                continue
            point, radius = np.uint64(self.points[node]), self.radii[node]
            d = lambda at, point=point: distance(prints[at], point).astype(np.int64)
            for child, (h, a) in zip(self.children[node], parted(d(home), d(ask), home, ask, radius, r or 0), strict=True):
                a = a if r is not None else a[:0]
                if len(h) or len(a):
                    stack.append((child, h, a))


class Forest:
    """Components of places, as trees of parents that are smaller places."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        found = self.parent[at]
        while not np.array_equal(up := self.parent[found], found):
            found = up
        self.parent[at] = found
        return found

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            np.minimum.at(self.parent, high, low)
            a, b = low, high


def leaves(prints: np.ndarray, homes: int, r: int, forest: Forest | None) -> Iterator[Part]:
    """Members and askers whose pairs have to be looked at. The first `homes` prints are members, the others ask. With a
    forest, what a vantage point is linked with is joined, and parts that are one component are left out."""
    stack = [(np.arange(homes), np.arange(homes, len(prints)))]
    while stack:
        home, ask = stack.pop()
        if not len(home) or len(home) + len(ask) < 2:
            continue
        found = choose(prints[home], r) if len(home) > LEAF else None
        if found is None:
            yield home, ask
            continue
        place, radius = home[found[0]], found[1]
        at_home, asking = (distance(prints[x], prints[place]).astype(np.int64) for x in (home, ask))
        if forest is not None:
            near = np.concatenate([home[at_home <= r], ask[asking <= r]])
            forest.join(near, np.full(len(near), place))
            roots = forest.roots(np.concatenate([home, ask]))
            if (roots == roots[0]).all():
                continue
        stack += parted(at_home, asking, home, ask, radius, r)


def pairs(prints: np.ndarray, homes: int, r: int, forest: Forest | None = None) -> Iterator[Part]:
    """Places of prints within r of each other, of which one is a member: each pair once, in bounded pieces."""
    for home, ask in leaves(prints, homes, r, forest):
        rest = np.concatenate([home, ask])
        step = max(1, CELLS // len(rest))
        for at in range(0, len(home), step):
            near = distance(prints[home[at : at + step]][:, None], prints[rest][None, :]) <= r
            a, b = np.nonzero(near)
            later = b > a + at  # two members meet twice in the matrix
            yield home[a[later] + at], rest[b[later]]


def links(prints: np.ndarray, homes: int, r: int) -> Part:
    """Links that connect what pairs connect: from each place that isn't the first of its component to that first one."""
    forest = Forest(len(prints))
    for a, b in pairs(prints, homes, r, forest):
        forest.join(a, b)
    roots = forest.roots(np.arange(len(prints)))
    linked = np.flatnonzero(roots != np.arange(len(prints)))
    return linked, roots[linked]

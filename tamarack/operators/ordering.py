"""The density order of one region's points, in one task: sequential by nature, but no step looks at all points."""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np

#: Places of a leaf at most, places left when all of them are compared with each next one, and the share by which bounds are lowered for rounding.
LEAF, LAST, SAFE = 32, 1024, 1 - 1e-12
_FIRST = float("-inf")


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((y[None] - x[:, None]) ** 2).sum(2))


class _Tree:
    """Distinct places, halved at the median of their widest coordinate down to leaves that are slices of ``x``.

    By node: ``first`` and ``last`` of its slice, ``low`` and ``high`` of its places, ``floor`` and ``ceiling`` beyond which (inclusively)
    all other places lie, ``up``, the ``other`` half, its two ``halves``, and ``left``, the places of it that still have points.
    """

    def __init__(self, x: np.ndarray):
        self.at = np.arange(len(x))
        self.first, self.last, self.low, self.high, self.floor, self.ceiling, self.up, self.other, self.halves = ([] for _ in range(9))
        slots = x.shape[1]
        todo = [(0, len(x), -1, [-np.inf] * slots, [np.inf] * slots)]
        while todo:
            first, last, up, floor, ceiling = todo.pop()
            node, part = len(self.first), x[self.at[first:last]]
            low, high = part.min(0), part.max(0)
            for column, value in zip((self.first, self.last, self.low, self.high, self.floor, self.ceiling, self.up), (first, last, low.tolist(), high.tolist(), floor, ceiling, up)):
                column.append(value)
            self.other.append(-1)
            self.halves.append(None)
            if up >= 0:
                if self.halves[up] is None:
                    self.halves[up] = (node,)
                else:
                    (twin,) = self.halves[up]
                    self.halves[up], self.other[node], self.other[twin] = (twin, node), twin, node
            if last - first > LEAF:
                slot, half = int((high - low).argmax()), (last - first) // 2
                order = np.argpartition(part[:, slot], half)
                self.at[first:last] = self.at[first:last][order]
                below, above = part[order[:half], slot].max(), part[order[half:], slot].min()
                todo.append((first, first + half, node, floor, [*ceiling[:slot], float(above), *ceiling[slot + 1 :]]))
                todo.append((first + half, last, node, [*floor[:slot], float(below), *floor[slot + 1 :]], ceiling))
        self.x = x[self.at]
        self.left = [b - a for a, b in zip(self.first, self.last)]
        self.leaf = np.zeros(len(x), int)
        for node, halves in enumerate(self.halves):
            if halves is None:
                self.leaf[self.first[node] : self.last[node]] = node

    def core_distances(self, counts: np.ndarray, mps: int, eps: float) -> np.ndarray:
        """The distance of each place to its ``mps``-th nearest point, itself included; infinite beyond ``eps``."""
        core = np.full(len(self.x), np.inf)

        def ranked(first: int, last: int, other: np.ndarray) -> np.ndarray:
            d = _distances(self.x[first:last], self.x[other])
            order = np.argsort(d, axis=1)
            full = counts[other][order].cumsum(1) >= mps
            found = np.take_along_axis(d, np.take_along_axis(order, full.argmax(1)[:, None], 1), 1)[:, 0]
            return np.where(full[:, -1], found, np.inf)

        for leaf in np.unique(self.leaf).tolist():
            first, last = self.first[leaf], self.last[leaf]
            near = leaf
            while self.up[near] >= 0 and counts[self.first[near] : self.last[near]].sum() < mps:
                near = self.up[near]
            reach = min(float(ranked(first, last, np.arange(self.first[near], self.last[near])).max()), eps)
            low, high, slices, todo = np.array(self.low[leaf]), np.array(self.high[leaf]), [], [0]
            while todo:
                node = todo.pop()
                gap = [max(a - d, c - b, 0.0) for a, b, c, d in zip(low.tolist(), high.tolist(), self.low[node], self.high[node])]
                if sum(g * g for g in gap) ** 0.5 * SAFE <= reach:
                    if self.halves[node] is None:
                        slices.append(np.arange(self.first[node], self.last[node]))
                    else:
                        todo.extend(self.halves[node])
            found = ranked(first, last, np.concatenate(slices))
            core[first:last] = np.where(found <= eps, found, np.inf)
        return core


def density_order(ids: np.ndarray, x: np.ndarray, eps: float, mps: int) -> tuple[list, list, np.ndarray, np.ndarray]:
    """(order, run of each step, reachability, core distance) of points whose ``ids`` ascend.

    Points at one place have the same reachability, so places are what is reached. A place with a point in the order offers others the
    distance at which it reaches them; it looks at the nodes of a tree around it only when their least possible distance is next, and
    passes by those whose points are all in the order. The last few places are compared with all. Ties go to the smaller id.
    """
    reach, core = np.full(len(ids), np.inf), np.full(len(ids), np.inf)
    good = np.flatnonzero(np.isfinite(x).all(axis=1))
    order, runs, done = [], [], [False] * len(ids)
    place_of = np.full(len(ids), -1)
    heap: list[tuple] = []
    if len(good):
        places, inverse, counts = np.unique(x[good], axis=0, return_inverse=True, return_counts=True)
        tree = _Tree(places)
        back = np.empty(len(places), int)
        back[tree.at] = np.arange(len(places))
        place_of[good] = back[inverse.ravel()]
        counts = counts[tree.at]
        core_of = tree.core_distances(counts, mps, eps)
        core[good] = core_of[place_of[good]]
        members = np.split(good[np.argsort(place_of[good], kind="stable")], np.cumsum(counts)[:-1])  # of each place, by id
        members = [m.tolist() for m in members]
        coordinates, core_of, leaf_of = tree.x.tolist(), core_of.tolist(), tree.leaf.tolist()
        best, taken, nodes = [np.inf] * len(places), [0] * len(places), len(tree.first)
        left, halves, up, other, low, high, floor, ceiling = tree.left, tree.halves, tree.up, tree.other, tree.low, tree.high, tree.floor, tree.ceiling

    def offer(places: range | list[int], x: np.ndarray, source: int) -> None:
        least, gaps = core_of[source], x - tree.x[source]
        for at, d in zip(places, np.sqrt((gaps * gaps).sum(1)).tolist()):
            if d <= eps:
                d = d if d > least else least
                if d < best[at] and taken[at] < len(members[at]):
                    best[at] = d
                    heappush(heap, (d, members[at][taken[at]], at))

    def offer_leaf(node: int, source: int) -> None:
        first, last = tree.first[node], tree.last[node]
        offer(range(first, last), tree.x[first:last], source)

    def look(node: int, source: int, now: float) -> None:
        """Offers what ``node`` holds, or an event for it at the least distance, if that is beyond ``now``."""
        todo, here, least = [node], coordinates[source], core_of[source]
        while todo:
            node = todo.pop()
            if not left[node]:
                continue
            total = 0.0
            for c, a, b in zip(here, low[node], high[node]):
                if c < a:
                    total += (a - c) * (a - c)
                elif c > b:
                    total += (c - b) * (c - b)
            bound = total**0.5 * SAFE
            if bound > eps:
                continue
            if bound > now:
                heappush(heap, (bound if bound > least else least, _FIRST, source * 2 * nodes + 2 * node))
            elif halves[node] is None:
                offer_leaf(node, source)
            else:
                todo.extend(halves[node])

    def leave(node: int, source: int, now: float) -> None:
        """The same for all that is outside ``node``."""
        here, least = coordinates[source], core_of[source]
        while left[node] < left[0]:
            bound = float("inf")
            for c, a, b in zip(here, floor[node], ceiling[node]):
                if c - a < bound:
                    bound = c - a
                if b - c < bound:
                    bound = b - c
            bound *= SAFE
            if bound > eps:
                return
            if bound > now:
                heappush(heap, (bound if bound > least else least, _FIRST, source * 2 * nodes + 2 * node + 1))
                return
            look(other[node], source, now)
            node = up[node]

    def rest() -> tuple[list[int], np.ndarray]:
        """The places left, now reached from all that are in the order: no more events are needed."""
        some = [at for at, n in enumerate(taken) if n < len(members[at])]
        x, cores = tree.x[some], np.array(core_of)
        sources, least = np.flatnonzero((np.array(taken) > 0) & (cores <= eps)), np.full(len(some), np.inf)
        for first in range(0, len(sources), 1024):
            part = sources[first : first + 1024]
            d = _distances(x, tree.x[part])
            least = np.minimum(least, np.where(d <= eps, np.maximum(d, cores[part]), np.inf).min(1))
        heap.clear()
        for at, d in zip(some, least.tolist()):
            best[at] = d
            if d <= eps:
                heappush(heap, (d, members[at][taken[at]], at))
        return some, x

    start, run, last = 0, None, None
    for _ in range(len(ids)):
        point = None
        while heap:
            key, kind, what = heappop(heap)
            if kind is not _FIRST:
                if key == best[what] and taken[what] < len(members[what]) and kind == members[what][taken[what]]:
                    point = kind
                    break
                continue
            source, node = divmod(what, 2 * nodes)
            node, outside = divmod(node, 2)
            if outside:
                leave(node, source, key)
            else:
                look(node, source, key)
        if point is None:
            while done[start]:
                start += 1
            point, run = start, ids[start]
        else:
            reach[point] = key
        done[point] = True
        order.append(point)
        runs.append(run)
        place = int(place_of[point])
        if place < 0:
            continue
        taken[place] += 1
        if taken[place] == len(members[place]):
            node = leaf_of[place]
            while node >= 0:
                left[node] -= 1
                node = up[node]
        if core_of[place] <= eps and taken[place] == 1:
            if last is not None:
                offer(*last, place)
            else:
                offer_leaf(leaf_of[place], place)
                leave(leaf_of[place], place, core_of[place])
        if taken[place] < len(members[place]):
            best[place] = min(best[place], core_of[place])
            if best[place] <= eps:
                heappush(heap, (best[place], members[place][taken[place]], place))
        if last is None and left[0] <= LAST:
            last = rest()
    return order, runs, reach, core

"""Paths that are near each other, found in numpy by tiles of two blocks, and groups of them.

Tiles whose middle points are apart are passed over; in the others, distances in single precision (as products of matrices)
leave out what is surely apart, and what is left is measured as geometry.mdf does.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Paths on a side of a tile. Pairs that are measured, and rows that leave, at once.
SIDE, AT_ONCE = 256, 1 << 15
#: What single precision may add to a distance, for each unit of the points' own size, and for each unit of the distance.
SLACK, SHARE = 2e-3, 1e-5
#: Links, as a share of all pairs, from which a matrix of all pairs takes less memory.
DENSE = 0.25

Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]


class Block(NamedTuple):
    """Paths of equally many points: x, y and z of all points in a row, the same reversed, and factors of squared distances.

    The product of left and right[way] is |u - v|^2 of a point about a centre; size is how far from it a path's points are.
    """

    ways: tuple[np.ndarray, np.ndarray]
    left: np.ndarray
    right: tuple[np.ndarray, np.ndarray]
    size: tuple[np.ndarray, np.ndarray]
    halves: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def __len__(self) -> int:
        return len(self.ways[0])


def block(p: np.ndarray, centre: np.ndarray) -> Block:
    """p: paths x 3 x points, finite; rows that are near each other should stand together."""
    with np.errstate(all="ignore"):
        return _block(p, centre)


def _block(p: np.ndarray, centre: np.ndarray) -> Block:
    n, _, k = p.shape
    ways = p, np.ascontiguousarray(p[:, :, ::-1])
    right, size = [], []
    for w in ways:
        v = (w - centre).astype(np.float32)
        square = (v * v).sum(1, keepdims=True)
        if not right:
            left = np.ascontiguousarray(np.concatenate([-2 * v, np.ones_like(square), square], 1).transpose(2, 0, 1))
        right.append(np.ascontiguousarray(np.concatenate([v, square, np.ones_like(square)], 1).transpose(2, 1, 0)))
        size.append(np.sqrt(square.max(2, initial=0)).ravel())
    h = k // 2
    halves = np.stack([p[:, :, :h].sum(2), p[:, :, k - h :].sum(2)], 1) / k
    low, high = (np.stack([f.reduce(halves[s : s + SIDE]) for s in range(0, n, SIDE)]) if n else np.zeros((0, 2, 3)) for f in (np.minimum, np.maximum))
    return Block(tuple(w.reshape(n, 3 * k) for w in ways), left, tuple(right), tuple(size), halves, low, high)


def _gaps(a: Block, b: Block, way: int) -> np.ndarray:
    """What paths of two tiles are apart at least, from the boxes of their halves' means."""
    of = slice(None, None, -1 if way else 1)
    total = np.zeros((len(a.low), len(b.low)))
    for h in range(2):
        lo, hi = b.low[:, of][:, h], b.high[:, of][:, h]
        total += np.sqrt((np.maximum(0, np.maximum(lo[None] - a.high[:, None, h], a.low[:, None, h] - hi[None])) ** 2).sum(2))
    return total


def _halves_near(a: Block, b: Block, x: slice, y: slice, way: int, most: float) -> np.ndarray:
    u, v = a.halves[x], b.halves[y][:, :: -1 if way else 1]
    least = sum(np.sqrt(sum((u[:, None, h, c] - v[None, :, h, c]) ** 2 for c in range(3))) for h in range(2))
    return ~(least > most * (1 + 1e-9))


def _screened(a: Block, b: Block, x: slice, y: slice, way: int, most: float) -> np.ndarray | None:
    """Which paths of two tiles may be within most; None if none are."""
    # Where halves tell much apart, few are left to measure; where they tell little apart, all points are taken at once.
    if np.mean(_halves_near(a, b, slice(x.start, x.stop, 16), y, way, most)) * 8 <= 1:
        may = _halves_near(a, b, x, y, way, most)
        left = np.count_nonzero(may)
        if left * 8 <= may.size:
            return may if left else None
    u, v = a.left[:, x], b.right[way][:, :, y]
    total, one = np.zeros((2, u.shape[1], v.shape[2]), np.float32)
    for p, q in zip(u, v, strict=True):
        np.matmul(p, q, out=one)
        np.sqrt(one, out=one)
        total += one
    slack = SLACK * max(float(a.size[0][x].max()), float(b.size[way][y].max()))
    # The root of less than nothing isn't a number and stays in.
    return ~(total > np.float32(len(u) * (most * (1 + SHARE) + slack)))


def _mean_norms(d: np.ndarray) -> np.ndarray:
    """Of differences x, y and z of all points, added up in their order; d is used up."""
    k = d.shape[1] // 3
    d *= d
    d = d[:, :k] + d[:, k : 2 * k] + d[:, 2 * k :]
    np.sqrt(d, out=d)
    total = np.zeros(len(d))
    for m in range(k):
        total += d[:, m]
    return total / k


def measured(a: Block, b: Block, i: np.ndarray, j: np.ndarray, ways: tuple[int, ...] = (0, 1)) -> np.ndarray:
    """As geometry.mdf, of rows i of a and j of b."""
    out = np.full(len(i), np.inf)
    for s in range(0, len(i), AT_ONCE // 8):
        at = slice(s, s + AT_ONCE // 8)
        u = a.ways[0][i[at]]
        for way in ways:
            out[at] = np.fmin(out[at], _mean_norms(u - b.ways[way][j[at]]))
    return out


def near(a: Block, b: Block, most: float, same: bool = False) -> Iterator[Pairs]:
    """(rows of a, rows of b, distances) nearer than most or as near, tile by tile; same: of each two rows of one block once."""
    gaps = [_gaps(a, b, way) for way in (0, 1)]
    limit = most * (1 + 1e-9)
    with np.errstate(all="ignore"):
        for r, c in np.argwhere(~(np.minimum(*gaps) > limit)).tolist():
            if not same or r <= c:
                yield _of_tiles(a, b, r, c, [way for way in (0, 1) if not gaps[way][r, c] > limit], most, same and r == c)


def _of_tiles(a: Block, b: Block, r: int, c: int, ways: list[int], most: float, same: bool) -> Pairs:
    x, y = slice(r * SIDE, (r + 1) * SIDE), slice(c * SIDE, (c + 1) * SIDE)
    may = {way: m for way in ways if (m := _screened(a, b, x, y, way, most)) is not None}
    none = np.zeros(0, np.int64)
    if not may:
        return none, none, np.zeros(0)
    left = np.logical_or.reduce(list(may.values()))
    i, j = np.divmod(np.flatnonzero(np.triu(left, 1) if same else left), left.shape[1])
    i, j = i + x.start, j + y.start
    d = measured(a, b, i, j, tuple(may))
    kept = d <= most
    return i[kept], j[kept], d[kept]


def reached(a: Block, b: Block, most: float) -> np.ndarray:
    """Which rows of a have a row of b nearer than most. A row that has one is done with; the nearest tiles come first."""
    gaps = np.minimum(*(_gaps(a, b, way) for way in (0, 1)))
    hit = np.zeros(len(a), bool)
    limit = most * (1 + 1e-9)
    with np.errstate(all="ignore"):
        for r in range(len(gaps)):
            left = np.arange(r * SIDE, min((r + 1) * SIDE, len(a)))
            for c in np.argsort(gaps[r], kind="stable"):
                if not len(left) or gaps[r, c] > limit:
                    break
                own = Block(*((tuple(w[left] for w in a.ways), a.left[:, left], (), tuple(w[left] for w in a.size), a.halves[left], a.low[r : r + 1], a.high[r : r + 1])))
                i, _, d = _of_tiles(own, b, 0, c, [0, 1], most, False)
                hit[left[i[d < most]]] = True
                left = left[~hit[left]]
    return hit


class Paths(NamedTuple):
    """Paths of equally many points: different ones, near ones together; the ids of all and their place among those, by place."""

    points: np.ndarray
    ids: np.ndarray
    kind: np.ndarray

    @staticmethod
    def of(t: pa.Table) -> dict[int, Paths]:
        """Rows (sl_id, points, cx, cy, cz) by their number of points; paths with a point that isn't known or finite are near none and left out."""
        points = t["points"].combine_chunks()
        many, numbers = points.value_lengths().fill_null(0).to_numpy(), points.flatten().to_numpy(zero_copy_only=False)
        ids, end = t["sl_id"].to_numpy(), np.cumsum(many)
        cells = np.stack([t["c" + c].fill_null(0).to_numpy() for c in "zyx"])
        out = {}
        for k in np.unique(many[many > 0]):
            at = np.flatnonzero(many == k)
            p = numbers[(end[at] - k)[:, None] + np.arange(k)]
            fine = np.isfinite(p).all(1)
            at, p = at[fine], p[fine] + 0.0
            if len(at):
                _, first, kind = np.unique(p.view(f"V{8 * k}").ravel(), return_index=True, return_inverse=True)
                order = np.lexsort(cells[:, at[first]])
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                kind = place[kind]
                by = np.argsort(kind, kind="stable")
                out[int(k)] = Paths(p[first[order]].reshape(-1, 3, k // 3), ids[at[by]], kind[by])
        return out


def blocks(a: Paths, b: Paths) -> tuple[Block, Block]:
    with np.errstate(over="ignore"):
        centre = a.points.mean(0)
    return block(a.points, centre), block(b.points, centre)


def pairs(a: Paths, b: Paths, most: float, same: bool = False, alike: bool = False) -> Iterator[Pairs]:
    """(ids of a, ids of b, distances) nearer than most, in parts of bounded size. same: the smaller id first; alike: a and b are the same paths."""
    one, two = blocks(a, b)
    starts, many = zip(*((np.flatnonzero(np.diff(x.kind, prepend=-1)), np.bincount(x.kind)) for x in (a, b)), strict=True)

    def found() -> Iterator[Pairs]:
        if alike:
            u = np.flatnonzero(many[0] > 1)
            yield u, u, np.zeros(len(u))
        yield from near(one, two, most, alike)

    for u, v, d in _gathered((u[d < most], v[d < most], d[d < most]) for u, v, d in found()):
        end = np.cumsum(many[0][u] * many[1][v])
        for s in range(0, int(end[-1]), AT_ONCE):
            at = np.arange(s, min(s + AT_ONCE, int(end[-1])))
            row = np.searchsorted(end, at, side="right")
            left, right = np.divmod(at - (end[row] - many[0][u[row]] * many[1][v[row]]), many[1][v[row]])
            x, y, m = a.ids[starts[0][u[row]] + left], b.ids[starts[1][v[row]] + right], d[row]
            if same:
                kept = (x < y) | ((u[row] != v[row]) & (x != y)) if alike else x != y
                x, y, m = x[kept], y[kept], m[kept]
                x, y = np.where(x < y, x, y), np.where(x < y, y, x)
            yield x, y, m


def _gathered(parts: Iterator[Pairs]) -> Iterator[Pairs]:
    """Small parts put together."""
    held, n = [], 0
    for part in parts:
        if len(part[0]):
            held.append(part)
            n += len(part[0])
        if n >= AT_ONCE:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def links(one: Block, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(i, j, distances) of all paths within most; None if they are more than a share of all pairs."""
    held, n = [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0))], 0
    for i, j, d in near(one, one, most, same=True):
        n += len(i)
        if n > DENSE * len(one) ** 2 / 2:
            return None
        held.append((i.astype(np.int32), j.astype(np.int32), d))
    return tuple(map(np.concatenate, zip(*held, strict=True)))


class Linkage:
    """Average linkage by links alone: two groups nearest on average merge while that is at most a bound.

    A group can come within the bound of two that merge only if it is within the bound of one of them, so groups keep their
    links, and the other average is worked out from the points when they merge. Of links as long, that of the smaller numbers goes first.
    """

    def __init__(self, one: Block, many: np.ndarray, number: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray], most: float) -> None:
        self.one, self.many, self.most, self.n = one, many.astype(float), most, len(one)
        n = self.n
        self.alive = np.arange(2 * n) < n
        self.size, self.number = (np.concatenate([x, np.zeros(n, x.dtype)]) for x in (self.many, number))
        self.members, self.rows = {}, {}
        self.mark, self.known = np.zeros(2 * n, bool), np.full((2, 2 * n), np.nan)
        # Links that groups got after they were made: chains through one log, from the last one of a group on.
        self.last, self.logged = np.full(2 * n, -1), 0
        self.log_other, self.log_before, self.log_d = np.zeros(1024, np.int32), np.zeros(1024, np.int64), np.zeros(1024)
        i, j, d = found
        order = self._order(number[i], number[j], d)
        self.i, self.j, self.d = i[order], j[order], d[order]
        ends = np.concatenate([self.i, self.j])
        by = np.argsort(ends, kind="stable")
        self.start = np.searchsorted(ends[by], np.arange(n + 1))
        self.by = (by % max(len(i), 1)).astype(np.int32)

    @staticmethod
    def _order(x: np.ndarray, y: np.ndarray, d: np.ndarray) -> np.ndarray:
        order = d.argsort()
        if (np.diff(d[order]) > 0).all():
            return order
        return np.lexsort((np.maximum(x, y), np.minimum(x, y), d))

    def groups(self) -> list[np.ndarray]:
        heap, new = [], self.n
        self._offer(heap, -1, 0)
        while heap:
            *_, x, at = heappop(heap)
            a, b = (int(self.i[at]), int(self.j[at])) if x < 0 else (x, int(self.rows[x][0][at]) if x in self.rows else x)
            if self.alive[a] and self.alive[b]:
                self._merge(a, b, new)
                self._offer(heap, new, 0)
                new += 1
            self._offer(heap, x, at + 1)
        return [self._paths(int(x)) for x in np.flatnonzero(self.alive)]

    def _offer(self, heap: list[tuple], x: int, at: int) -> None:
        """The first link of a list from a place on whose ends are still there; list -1 has those of single paths."""
        if x >= 0 and not self.alive[x]:
            return
        other, d = (self.j, self.d) if x < 0 else self.rows[x]
        while at < len(d):
            there = self.alive[other[at : at + 4096]]
            if x < 0:
                there &= self.alive[self.i[at : at + 4096]]
            if there.any():
                at += int(there.argmax())
                p, q = int(self.number[self.i[at] if x < 0 else x]), int(self.number[other[at]])
                heappush(heap, (float(d[at]), min(p, q), max(p, q), x, at))
                return
            at += 4096

    def _paths(self, x: int) -> np.ndarray:
        return np.array([x]) if x < self.n else self.members[x]

    def _links(self, x: int) -> tuple[np.ndarray, np.ndarray]:
        if x < self.n:
            at = self.by[self.start[x] : self.start[x + 1]]
            ids, d = self.i[at] + self.j[at] - x, self.d[at]
        else:
            ids, d = self.rows.pop(x)
        chain, at = [], int(self.last[x])
        while at >= 0:
            chain.append(at)
            at = int(self.log_before[at])
        if chain:
            ids, d = np.concatenate([ids, self.log_other[chain]]), np.concatenate([d, self.log_d[chain]])
        there = self.alive[ids]
        return ids[there], d[there]

    def _merge(self, a: int, b: int, new: int) -> None:
        self.alive[[a, b]] = False
        for x, known in zip((a, b), self.known, strict=True):
            ids, d = self._links(x)
            self.mark[ids], known[ids] = True, d
        every = np.flatnonzero(self.mark)
        total = np.zeros(len(every))
        for x, known in zip((a, b), self.known, strict=True):
            one = known[every]
            gap = np.isnan(one)
            one[gap] = self._average(x, every[gap])
            total += self.size[x] * one
        self.mark[every], self.known[:, every] = False, np.nan
        self.size[new], self.number[new], self.alive[new] = self.size[a] + self.size[b], min(self.number[a], self.number[b]), True
        total /= self.size[new]
        self.members[new] = np.concatenate([self._paths(a), self._paths(b)])
        for x in (a, b):
            self.members.pop(x, None)
        kept = total <= self.most
        ids, d = every[kept], total[kept]
        self._note(ids, new, d)
        order = self._order(np.full(len(ids), self.number[new]), self.number[ids], d)
        self.rows[new] = ids[order], d[order]

    def _note(self, ids: np.ndarray, new: int, d: np.ndarray) -> None:
        end = self.logged + len(ids)
        if end > len(self.log_d):
            self.log_other, self.log_before, self.log_d = (np.concatenate([v, np.zeros(end, v.dtype)]) for v in (self.log_other, self.log_before, self.log_d))
        at = slice(self.logged, end)
        self.log_other[at], self.log_before[at], self.log_d[at] = new, self.last[ids], d
        self.last[ids], self.logged = np.arange(self.logged, end), end

    def _average(self, x: int, others: np.ndarray) -> np.ndarray:
        """Of the distances between the paths of a group and those of others (in order, single paths first)."""
        if not len(others):
            return np.zeros(0)
        k = int(np.searchsorted(others, self.n))
        more = [self.members[c] for c in others[k:].tolist()]
        to = np.concatenate([others[:k], *more])
        many = np.concatenate([np.ones(k, np.int64), np.array([len(m) for m in more], np.int64)])
        sums = np.add.reduceat(spread(self.one, self._paths(x), to, self.many) * self.many[to], np.cumsum(many) - many)
        return sums / (self.size[x] * self.size[others])


def spread(one: Block, from_: np.ndarray, to: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Of each path, the sum of its distances from some paths, each of which counts many times."""
    out = np.zeros(len(to))
    halves = one.halves.reshape(-1, 6)
    for s in range(0, len(to), AT_ONCE // 8):
        at = slice(s, s + AT_ONCE // 8)
        held, ends = one.ways[0][to[at]], halves[to[at]]
        for i in from_.tolist():
            d = _mean_norms(held - one.ways[0][i])
            turned = ends - one.halves[i, ::-1].ravel()
            turned *= turned
            closer = np.flatnonzero(turned.sum(1) < d * d * (1 + 1e-9))
            if len(closer):
                d[closer] = np.minimum(d[closer], _mean_norms(held[closer] - one.ways[1][i]))
            out[at] += many[i] * d
    return out


def linked(p: np.ndarray, many: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Groups by average linkage of different paths (paths x 3 x points), each of which counts many times: of each path, the first path of its group and the one that is nearest to all. None if a matrix of all pairs takes less."""
    order = np.lexsort(np.floor(p.mean(2) / most).T)
    one = block(p[order], p.mean(0))
    found = links(one, most)
    if found is None:
        return None
    label, medoid = np.empty((2, len(p)), np.int64)
    for own in Linkage(one, many[order], order, found, most).groups():
        own = own[np.argsort(order[own])]
        label[order[own]] = order[own[0]]
        medoid[order[own]] = order[own[np.argmin(spread(one, own, own, many[order]))]] if len(own) > 1 else order[own[0]]
    return label, medoid

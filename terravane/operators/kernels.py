"""Greedy and iterative kernels over the rows of one group, as numpy functions; rows come in order of their ids.

Levels are floats with NaN for unresolved, which is compatible with every level.
"""

from __future__ import annotations

import heapq
import math

import numpy as np


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))


def compatible(levels: np.ndarray, level: float) -> np.ndarray:
    return np.isnan(levels) | np.isnan(level) | (levels == level)


def unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1.0)


def best_first(score: np.ndarray) -> np.ndarray:
    """Places by descending score, ties in row order."""
    return np.argsort(-score, kind="stable")


def compact(labels: np.ndarray) -> np.ndarray:
    """Labels as 0..k-1 in their order; negative ones stay -1."""
    out = np.full(len(labels), -1, np.int64)
    some = labels >= 0
    out[some] = np.unique(labels[some], return_inverse=True)[1]
    return out


def with_support(labels: np.ndarray, keyframes: np.ndarray, least: int) -> np.ndarray:
    """Clusters that fewer than `least` different keyframes saw become noise; the others are numbered anew."""
    out = labels.copy()
    for k in np.unique(labels[labels >= 0]):
        if len(np.unique(keyframes[labels == k])) < least:
            out[labels == k] = -1
    return compact(out)


def components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest node that each node is connected with."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def leader_canopy(xyz, similarity, levels, eps, vectors=None, gate=None) -> np.ndarray:
    """Seeds by similarity; each takes all free points within eps of it that are compatible with it, nothing beyond."""
    out = np.full(len(xyz), -1, np.int64)
    unit = unit_rows(vectors) if gate is not None and vectors is not None else None
    k = 0
    for seed in best_first(similarity):
        if out[seed] >= 0:
            continue
        take = (out < 0) & (np.sqrt(((xyz - xyz[seed]) ** 2).sum(axis=1)) <= eps) & compatible(levels, levels[seed])
        if unit is not None:
            take &= unit @ unit[seed] >= gate
        take[seed] = True
        out[take] = k
        k += 1
    return out


def incremental(xyz, similarity, levels, vectors, eps, combination="sum", threshold=1.1, gate=None, descriptor="running_mean") -> np.ndarray:
    """Points by similarity join the live cluster of the best score (1 + cosine) / 2 + max(0, 1 - nearest / eps), or found one."""
    if vectors is None or (np.linalg.norm(vectors, axis=1) <= 0).any():
        raise ValueError("incremental association needs a vector other than zero for each row")
    unit = unit_rows(np.asarray(vectors, float))
    n = len(xyz)
    out = np.full(n, -1, np.int64)
    means, size, level = np.zeros((n, unit.shape[1] if n else 0)), np.zeros(n), np.full(n, np.nan)
    k = 0
    for i in best_first(similarity):
        choice = -1
        if k:
            nearest = np.full(k, np.inf)
            done = np.flatnonzero(out >= 0)
            np.minimum.at(nearest, out[done], np.sqrt(((xyz[done] - xyz[i]) ** 2).sum(axis=1)))
            cosine = np.clip(means[:k] @ unit[i], -1, 1)
            score = (cosine + 1) / 2 + np.maximum(0, 1 - nearest / eps)
            ok = compatible(level[:k], levels[i])
            if combination == "conjunctive":
                ok &= nearest <= eps
                if gate is not None:
                    ok &= cosine >= gate
            else:
                ok &= score >= threshold
            if ok.any():
                choice = int(np.where(ok, score, -np.inf).argmax())
        if choice < 0:
            choice, k = k, k + 1
            means[choice], level[choice] = unit[i], levels[i]
        elif descriptor == "running_mean":
            mean = size[choice] * means[choice] + unit[i]
            length = np.linalg.norm(mean)
            if length <= 0:
                raise ValueError("vectors of a cluster cancel out")
            means[choice] = mean / length
        size[choice] += 1
        out[i] = choice
    return out


class Joined:
    """Components that grow as edges come in parts; label is the smallest node that each is connected with."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.label[i] != self.label[j]

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        if len(i):
            self.label = components(len(self.label), self.label[i], self.label[j])[self.label]


#: Pairs of rows of neighbouring cells that are looked at together.
AT_ONCE = 1 << 20


def _matched_keys(sorted_key: np.ndarray, by: np.ndarray, low: np.ndarray, high: np.ndarray):
    """For keys low..high of each row the places (row, by of the sorted key) in parts of about AT_ONCE."""
    a, b = np.searchsorted(sorted_key, low, "left"), np.searchsorted(sorted_key, high, "right")
    total = np.cumsum(b - a)
    first = 0
    while first < len(low):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + AT_ONCE, "right")))
        each = (b - a)[first:last]
        i = np.repeat(np.arange(first, last), each)
        yield i, by[np.repeat(a[first:last], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)]
        first = last


def near_pair_parts(xyz: np.ndarray, radius: float):
    """Pairs i < j within the radius in parts, found through cells of that size; a radius of 0 or less through all pairs."""
    n = len(xyz)
    if n < 2:
        return
    if radius <= 0 or n <= 1500:
        rows = max(1, AT_ONCE // n)
        for a in range(0, n, rows):
            i, j = np.nonzero(distances(xyz[a : a + rows], xyz) <= radius)
            i = i + a
            yield i[i < j], j[i < j]
        return
    cell = np.floor(xyz / radius).astype(np.int64)
    cell -= cell.min(axis=0) - 1
    span = cell.max(axis=0) + 2
    key = (cell[:, 0] * span[1] + cell[:, 1]) * span[2] + cell[:, 2]
    by = np.argsort(key, kind="stable")
    for dx in (-1, 0, 1):
        for dy in (-1, 0, 1):
            other = key + (dx * span[1] + dy) * span[2]
            for i, j in _matched_keys(key[by], by, other - 1, other + 1):
                i, j = i[i < j], j[i < j]
                ok = ((xyz[i] - xyz[j]) ** 2).sum(axis=1) <= radius * radius
                yield i[ok], j[ok]


def near_pairs(xyz: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j within the radius, by i, then j."""
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *near_pair_parts(xyz, radius)]
    i, j = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    by = np.lexsort((j, i))
    return i[by], j[by]


EARTH_RADIUS = 6371008.8


def haversine(lat, lng, lat2, lng2):
    """Great-circle distance in metres, angles in radians."""
    h = np.sin((lat2 - lat) / 2) ** 2 + np.cos(lat) * np.cos(lat2) * np.sin((lng2 - lng) / 2) ** 2
    return 2 * EARTH_RADIUS * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(0.0, 1 - h)))


def flat_distance(lat, lng, lat2, lng2):
    """Distance in metres on the plane that touches between the points, angles in degrees."""
    x, y = (lng2 - lng) * 111320.0 * np.cos(np.radians((lat + lat2) / 2)), (lat2 - lat) * 111320.0
    return np.sqrt(x * x + y * y)


def _grid(lat: np.ndarray, lng: np.ndarray, size: float):
    """Height and width, in radians, of cells at least `size` metres high and wide, and the least of the angles.

    Near a pole, or where rows lie on both sides of the antimeridian, cells are bands of latitude.
    """
    far = np.abs(lat).max() + size / EARTH_RADIUS
    tall = size / EARTH_RADIUS * 1.000001
    wide = math.inf
    if far < math.radians(85) and lng.max() - lng.min() <= math.pi and math.sin(tall / 2) < math.cos(far):
        wide = 2 * math.asin(math.sin(tall / 2) / math.cos(far))
    return tall, wide, lat.min(), lng.min()


def near_places(lat, lng, lat2, lng2, radius: float):
    """Places i, j of two sets of points (degrees) within the radius of each other and their distance, in parts."""
    lat, lng, lat2, lng2 = (np.radians(np.asarray(a, float)) for a in (lat, lng, lat2, lng2))
    one, two = (np.flatnonzero(np.isfinite(a) & np.isfinite(b)) for a, b in ((lat, lng), (lat2, lng2)))
    if not len(one) or not len(two) or radius < 0:
        return
    lat, lng, lat2, lng2 = lat[one], lng[one], lat2[two], lng2[two]
    tall, wide, low, left = _grid(np.r_[lat, lat2], np.r_[lng, lng2], max(radius, 1e-3))
    column = lambda a: np.floor((a - left) / wide).astype(np.int64) + 1 if wide < math.inf else np.ones(len(a), np.int64)
    row = lambda a: np.floor((a - low) / tall).astype(np.int64) + 1
    span = int(max(column(lng).max(), column(lng2).max())) + 2
    key = row(lat2) * span + column(lng2)
    by = np.argsort(key, kind="stable")
    own = row(lat) * span + column(lng)
    for d in (-span, 0, span):
        for i, j in _matched_keys(key[by], by, own + d - 1, own + d + 1):
            near = np.abs(lat2[j] - lat[i]) <= tall
            i, j = i[near], j[near]
            apart = haversine(lat[i], lng[i], lat2[j], lng2[j])
            ok = apart <= radius
            yield one[i[ok]], two[j[ok]], apart[ok]


def nearest_places(lat, lng, lat2, lng2, order, most: float, k: int, usable=None, measure=None, slack: float = 1.0):
    """Places i, j and distances of each row's k nearest usable rows of the second set (by distance, then order), by row.

    The radius grows until a row has its k or the radius is `most`. measure (of i, j) is another distance than the
    great-circle one, which is at most `slack` times as large.
    """
    lat, lng, lat2, lng2 = (np.asarray(a, float) for a in (lat, lng, lat2, lng2))
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    left, out, radius = np.arange(len(lat)), [none], most / 32
    while len(left):
        best = none
        for i, j, d in near_places(lat[left], lng[left], lat2, lng2, radius * slack):
            i = left[i]
            if usable is not None:
                ok = usable(i, j)
                i, j, d = i[ok], j[ok], d[ok]
            if measure is not None:
                d = measure(i, j)
            ok = d <= radius
            i, j, d = (np.r_[a, b[ok]] for a, b in zip(best, (i, j, d), strict=True))
            by = np.lexsort((order[j], d, i))
            i, j, d = i[by], j[by], d[by]
            first = np.searchsorted(i, i, "left")
            ok = np.arange(len(i)) - first < k
            best = i[ok], j[ok], d[ok]
        full = np.bincount(best[0], minlength=len(lat)) >= k
        last = radius >= most
        ok = full[best[0]] | last
        out.append(tuple(a[ok] for a in best))
        if last:
            break
        left, radius = left[~full[left]], min(most, radius * 2)
    i, j, d = (np.concatenate([p[c] for p in out]) for c in range(3))
    by = np.argsort(i, kind="stable")
    return i[by], j[by], d[by]


def near_components(lat: np.ndarray, lng: np.ndarray, radius: float) -> np.ndarray:
    """Smallest row that each is connected with by steps of no more than the radius (above 0), in metres."""
    out = Joined(len(lat))
    for i, j, _ in near_places(lat, lng, lat, lng, radius):
        ok = (i < j) & out.apart(i, j)
        out.add(i[ok], j[ok])
    return out.label


def matched_places(ids, lat, lng, score, targets, lat2, lng2, reach) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and distances of the pairs that one_to_one takes of all pairs of points no farther apart than the target's reach.

    The radius grows and rows that are taken are out: nearer pairs go first, so none of them is missed.
    """
    left, right = np.arange(len(ids)), np.flatnonzero(reach >= 0)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    most = float(reach[right].max(initial=0.0))
    radius = most / 64
    while len(left) and len(right):
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for i, j, d in near_places(lat[left], lng[left], lat2[right], lng2[right], radius):
            ok = d <= reach[right[j]]
            parts.append((left[i[ok]], right[j[ok]], d[ok]))
        i, j, d = (np.concatenate([p[k] for p in parts]) for k in range(3))
        take = one_to_one(ids[i], targets[j], d, score[i])
        out.append((i[take], j[take], d[take]))
        left, right = left[~np.isin(ids[left], ids[i[take]])], right[~np.isin(targets[right], targets[j[take]])]
        if radius >= most:
            break
        radius = min(most, radius * 2)
    return tuple(np.concatenate([p[k] for p in out]) for k in range(3))


def taken_in_order(lat, lng, targets, lat2, lng2, reach) -> np.ndarray:
    """The place of the target each row takes, -1 for none, when in order each takes its nearest free one (the smallest of equally near ones) within that one's reach."""
    out = np.full(len(lat), -1, np.int64)
    lat, lng, lat2, lng2 = (np.radians(np.asarray(a, float)) for a in (lat, lng, lat2, lng2))
    rows, some = np.flatnonzero(np.isfinite(lat) & np.isfinite(lng)), np.flatnonzero(np.isfinite(lat2) & np.isfinite(lng2) & (reach >= 0))
    if not len(rows) or not len(some):
        return out
    most = float(reach[some].max())
    area = (np.ptp(lat2[some]) * np.ptp(lng2[some])) * EARTH_RADIUS**2
    size = min(max(math.sqrt(2 * area / len(some)), most / 16, 1e-3), max(most, 1e-3))
    tall, wide, low, west = _grid(np.r_[lat[rows], lat2[some]], np.r_[lng[rows], lng2[some]], size)
    least = math.cos(max(np.abs(lat[rows]).max(), np.abs(lat2[some]).max()))
    flat = wide == math.inf
    cells: dict[tuple, list] = {}
    for j in some[np.argsort(targets[some], kind="stable")].tolist():
        at = (math.floor((lat2[j] - low) / tall), 0 if flat else math.floor((lng2[j] - west) / wide))
        cells.setdefault(at, []).append((targets[j], lat2[j], lng2[j], math.cos(lat2[j]), reach[j], j))
    # the rows of ring k + 1 and beyond are at least bound[k] away
    extent = [np.floor(np.ptp(np.r_[lat[rows], lat2[some]]) / tall), 0 if flat else np.floor(np.ptp(np.r_[lng[rows], lng2[some]]) / wide)]
    across = lambda k: math.inf if flat else 2 * EARTH_RADIUS * math.asin(least * math.sin(min(k * wide, math.pi) / 2))
    bound, edge = [0.0], [[(0, 0)]]
    while bound[-1] <= most and len(edge) <= max(extent) + 1:
        k = len(edge)
        bound.append(min(EARTH_RADIUS * k * tall, across(k)) * 0.999999)
        edge.append([(-k, 0), (k, 0)] if flat else [(a, b) for a in range(-k, k + 1) for b in (range(-k, k + 1) if abs(a) == k else (-k, k))])
    sin, sqrt, atan2 = math.sin, math.sqrt, math.atan2
    get = cells.get
    for r in rows.tolist():
        y, x = float(lat[r]), float(lng[r])
        cos, a, b = math.cos(y), math.floor((y - low) / tall), 0 if flat else math.floor((x - west) / wide)
        best = None
        for k, ring in enumerate(edge):
            if best is not None and best[0] < bound[k - 1]:
                break
            for da, db in ring:
                for t in get((a + da, b + db), ()):
                    h = sin((t[1] - y) / 2) ** 2 + cos * t[3] * sin((t[2] - x) / 2) ** 2
                    d = 2 * EARTH_RADIUS * atan2(sqrt(h), sqrt(max(0.0, 1 - h)))
                    if d <= t[4] and (best is None or d < best[0] or (d == best[0] and t[0] < best[1][0])):
                        best = (d, t, (a + da, b + db))
        if best is not None:
            out[r] = best[1][5]
            own = cells[best[2]]
            own.remove(best[1])
            if not own:
                del cells[best[2]]
    return out


def _dot(a, b):
    return a[..., 0] * b[..., 0] + a[..., 1] * b[..., 1] + a[..., 2] * b[..., 2]


def _compatible_rows(levels: np.ndarray) -> dict:
    """For each level that occurs, the rows that are compatible with it; for unresolved ones (None) all."""
    return {None: np.ones(len(levels), bool)} | {k: compatible(levels, k) for k in np.unique(levels[~np.isnan(levels)]).tolist()}


def _by_column(m: np.ndarray):
    """Points of the rows that are asked for, with each coordinate in one piece."""
    columns = np.ascontiguousarray(m.T)
    return lambda rows: columns.take(rows, axis=1).T


def ray_approach(oi, di, oj, dj, parallel=1e-8):
    """Distance and both parameters of the closest points of lines with unit directions, row by row (or one line against rows).

    Of lines that are not parallel the distance is the same, to the bit, whichever comes first.
    """
    gap = oi - oj
    d, a, b = _dot(di, dj), _dot(di, gap), _dot(dj, gap)
    flat = np.abs(d) > (0.9999 if parallel < 0.01 else -1.0)  # of unit directions only these can be parallel
    if flat.any():
        k = np.flatnonzero(flat)
        one, other = (np.broadcast_to(v, (len(d), 3))[k].T for v in (di, dj))
        normal = np.stack([one[p] * other[q] - one[q] * other[p] for p, q in ((1, 2), (2, 0), (0, 1))], axis=1)
        flat[k] = np.sqrt(_dot(normal, normal)) < parallel
    den = np.where(flat, 1.0, 1 - d * d)
    ti, tj = (d * b - a) / den, (b - d * a) / den
    away = [gap[..., c] + (ti * di[..., c] - tj * dj[..., c]) for c in range(3)]
    apart = np.sqrt(away[0] * away[0] + away[1] * away[1] + away[2] * away[2])
    if flat.any():
        away = -gap - np.maximum(0.0, -a)[:, None] * di
        apart = np.where(flat, np.sqrt(_dot(away, away)), apart)
        ti, tj = np.where(flat, -a / 2, ti), np.where(flat, a / 2 * np.where(d >= 0, 1.0, -1.0), tj)
    return apart, ti, tj


def _in_range(t, low, high):
    return (t > 0) & (t >= low) & (t <= high)


class Cells:
    """Rows by square cells, at least `size` wide, over the two widest axes; rows within `size` of one lie in the cells about its own.

    rows: all rows, cell by cell, in each by number; start: where each cell's rows begin; cell and place: each row's cell and its place in rows.
    """

    def __init__(self, xyz: np.ndarray, size: float):
        at = np.where(np.isfinite(xyz), xyz, 0.0)
        extent = np.ptp(at, axis=0)
        at = at[:, np.argsort(-extent, kind="stable")[:2]]
        cell = np.floor(at / (max(size, extent.max() / (1 << 20)) or 1.0)).astype(np.int64)
        cell -= cell.min(axis=0) - 1
        self.span = int(cell[:, 1].max()) + 2
        keys, self.cell, each = np.unique(cell[:, 0] * self.span + cell[:, 1], return_inverse=True, return_counts=True)
        self.keys = keys.tolist()
        self.number = {k: c for c, k in enumerate(self.keys)}
        self.rows = np.argsort(self.cell, kind="stable")
        self.start = np.r_[0, np.cumsum(each)].tolist()
        self.place = np.empty(len(xyz), np.int64)
        self.place[self.rows] = np.arange(len(xyz))

    def about(self, c: int) -> list[int]:
        return [self.number[k] for dx in (-self.span, 0, self.span) for k in range(self.keys[c] + dx - 1, self.keys[c] + dx + 2) if k in self.number]

    def __getitem__(self, c: int) -> np.ndarray:
        return self.rows[self.start[c] : self.start[c + 1]]


def cdog(xyz, origins, directions, keyframes, levels, epipolar, radius, range_m, delta, vectors=None, gate=None) -> np.ndarray:
    """Rays of different keyframes that meet are edges; edges whose open neighbourhoods overlap enough join components.

    Neighbourhoods are bits of a table, of all rows or, where that is too large, of two blocks of rows at a time.
    """
    n = len(xyz)
    if n < 2:
        return np.arange(n)
    unit = unit_rows(np.asarray(vectors, float)) if gate is not None and vectors is not None else None
    cells = Cells(xyz, radius)
    points, starts, rays = _by_column(xyz), _by_column(origins), _by_column(directions)
    known, level = _compatible_rows(levels), [None if np.isnan(k) else k for k in levels.tolist()]

    def mates(v: int, rows: np.ndarray) -> np.ndarray:
        """Those of the rows, all of them greater or all smaller than v, with which v has an edge."""
        rows = rows[(keyframes[rows] != keyframes[v]) & known[level[v]][rows]]
        gap = points(rows) - xyz[v]
        rows = rows[np.sqrt(_dot(gap, gap)) <= radius]
        if len(rows):
            one, other = (origins[v], directions[v]), (starts(rows), rays(rows))
            gap, ti, tj = ray_approach(*one, *other) if rows[0] > v else ray_approach(*other, *one)
            rows = rows[_in_range(ti, *range_m) & _in_range(tj, *range_m) & (gap <= epipolar)]
        return rows if unit is None else rows[np.einsum("ij,j->i", unit.take(rows, axis=0), unit[v]) >= gate]

    def table(first: int, last: int) -> np.ndarray:
        bits = np.zeros((last - first, -(-n // 64) * 8), np.uint8)
        mask = np.zeros(bits.shape[1] * 8, bool)
        own = cells.cell[first:last]
        for c in np.unique(own).tolist():
            near = np.sort(np.concatenate([cells[k] for k in cells.about(c)]))
            for v in (first + np.flatnonzero(own == c)).tolist():
                found = mates(v, near[np.searchsorted(near, v, "right") :])
                mask[found] = True
                if first and len(lower := mates(v, near[: np.searchsorted(near, first)])):
                    mask[lower] = True
                bits[v - first] |= np.packbits(mask)
                mask[:] = False
                inside = found[: np.searchsorted(found, last)] - first
                bits[inside, v >> 3] |= np.uint8(128 >> (v & 7))
        return bits.view(np.uint64)

    block = n if n * n <= BITS else max(1, BITS // 2 // n)
    out = Joined(n)
    for first in range(0, n, block):
        one = table(first, min(n, first + block))
        for second in range(first, n, block):
            # an edge within a component says nothing new, so only those between two are looked at
            if second > first and len(np.unique(np.r_[out.label[first : first + block], out.label[second : second + block]])) == 1:
                continue
            two = one if second == first else table(second, min(n, second + block))
            size, size2 = (np.bitwise_count(t).sum(axis=1, dtype=np.int64) for t in (one, two))
            for a in range(first, first + len(one)):
                found = np.flatnonzero(np.unpackbits(one[a - first].view(np.uint8), count=n)[second : second + len(two)]) + second
                found = found[(found > a) & (out.label[found] != out.label[a])]
                while len(found):
                    b, found = found[:256], found[256:]
                    both = np.bitwise_count(one[a - first] & two[b - second]).sum(axis=1, dtype=np.int64)
                    b = b[both >= delta * np.minimum(size[a - first], size2[b - second])]
                    if len(b):
                        out.add(np.full(len(b), a), b)
                        found = found[out.label[found] != out.label[a]]
    return compact(out.label)


#: Pairs of rows up to which a group's neighbourhoods are bits of one table (an eighth of that in bytes).
BITS = 1 << 31


def contract(weights: np.ndarray, barred: np.ndarray) -> np.ndarray:
    """Greedy additive contraction of a dense signed graph: the best positive edge joins its ends, parallel edges add up.

    barred: pairs that may never be together, themselves or through others. Ties go to the smaller ends. Plain form of contract_near.
    """
    n = len(weights)
    w, bar, owner, live = weights.copy(), barred.copy(), np.arange(n), np.ones(n, bool)
    best, mate = np.zeros(n), np.zeros(n, np.int64)

    def refresh(u):
        row = np.where(live[u + 1 :] & ~bar[u, u + 1 :], w[u, u + 1 :], 0)
        mate[u] = u + 1 + row.argmax() if len(row) else u
        best[u] = row.max(initial=0)

    for u in range(n):
        refresh(u)
    while n and best.max() > 0:
        u = int(best.argmax())
        v = int(mate[u])
        w[u] += w[v]
        bar[u] |= bar[v]
        w[:, u], bar[:, u] = w[u], bar[u]
        live[v], best[v] = False, 0
        owner[owner == v] = u
        stale = np.flatnonzero(live & ((mate == u) | (mate == v)))
        stale = stale[stale < v]
        lower = np.flatnonzero(live[:u] & ~bar[:u, u])
        lower = lower[(w[lower, u] > best[lower]) | ((w[lower, u] == best[lower]) & (u < mate[lower]))]
        for r in {u, *stale.tolist(), *lower.tolist()}:
            refresh(r)
    return compact(owner)


def contract_near(xyz, radius, levels, cost, best=None) -> np.ndarray:
    """Greedy additive contraction without the table of all pairs: two levels bar each other, and only rows within the radius have edges.

    cost(v, rows): weights of the edges of v with rows, 0 where there is none. Edges of two single rows are computed when they are needed; only a
    cluster of two or more keeps its sums, with the rows of the cells about its members. Of clusters there are few at a time: they grow together
    before others begin. A heap has for each single row the best edge with a greater one, for each cluster the best of all when it last changed:
    an edge that changed since is that of the other end, and one that is no longer there is looked for again when it comes up.
    best(rows, near): of each of the rows (v) with those of near (in order) that are greater the best weight and the row it is of, where above 0.
    """
    n = len(xyz)
    owner = np.arange(n)
    if n < 2:
        return owner
    cells = Cells(xyz, radius)
    cell, start, ids, place = cells.cell.tolist(), cells.start, cells.rows, cells.place
    about = [cells.about(c) for c in range(len(start) - 1)]
    unknown = np.isnan(levels)
    code = np.full(n, -1)  # by place: level, -1 unresolved, -2 no longer there
    code[place[~unknown]] = np.unique(levels[~unknown], return_inverse=True)[1]
    free = np.ones(n, bool)
    single = [cells[c] for c in range(len(about))]
    sums: dict[int, dict[int, np.ndarray]] = {}
    holders: list[set] = [set() for _ in about]  # clusters with sums for rows of the cell
    seated: list[set] = [set() for _ in about]  # clusters whose smallest row is in the cell
    version = [0] * n
    heap: list[tuple] = []

    def free_about(v: int) -> np.ndarray:
        for c in about[cell[v]]:
            single[c] = single[c][free[single[c]]]
        return np.concatenate([single[c] for c in about[cell[v]]])

    def put(w: float, v: int, mate: int) -> None:
        heapq.heappush(heap, (-w, min(v, mate), max(v, mate), v, version[v]))

    def best_single(v: int, rows: np.ndarray) -> None:
        rows = rows[rows > v]
        w = cost(v, rows)
        if (top := w.max(initial=0)) > 0:
            put(float(top), v, int(rows[w == top].min()))

    def best_cluster(u: int) -> None:
        own, top, mate = code[place[u]], 0.0, -1
        for c, w in sums[u].items():
            k = code[start[c] : start[c + 1]]
            w = np.where(k > -2 if own == -1 else (k == own) | (k == -1), w, 0.0)
            high = w.max()
            if high > 0 and high >= top:
                first = int(ids[start[c] + int((w == high).argmax())])  # a cell's rows are by number
                mate = first if high > top else min(mate, first)
                top = high
        if mate >= 0:
            put(float(top), u, mate)

    def at(w: dict, v: int, value: float | None = None) -> float:
        """The sum with row v, or a new value for it."""
        c = cell[v]
        if value is not None and c not in w and value != 0:
            w[c] = np.zeros(start[c + 1] - start[c])
        if c not in w:
            return 0.0
        if value is not None:
            w[c][place[v] - start[c]] = value
        return w[c][place[v] - start[c]]

    def sums_of(v: int) -> dict[int, np.ndarray]:
        if v in sums:
            for c in sums[v]:
                holders[c].discard(v)
            seated[cell[v]].discard(v)
            return sums.pop(v)
        rows = free_about(v)
        rows = rows[rows != v]
        w = {c: np.zeros(start[c + 1] - start[c]) for c in about[cell[v]]}
        value, first = cost(v, rows), 0
        for c in w:
            own = place[single[c][single[c] != v]] - start[c]
            w[c][own] = value[first : first + len(own)]
            first += len(own)
        for u in holders[cell[v]]:
            at(w, u, at(sums[u], v))
        return w

    for c, near in enumerate(about):
        rows = np.concatenate([cells[k] for k in near])
        if best is not None:
            for v, w, mate in best(cells[c], np.sort(rows)):
                put(w, v, mate)
            continue
        for v in cells[c].tolist():
            best_single(v, rows)
    while heap:
        w, u, v, by, stamp = heapq.heappop(heap)
        if version[by] != stamp or code[place[by]] == -2:
            continue
        if by not in sums:
            if not free[v]:
                best_single(by, free_about(by))
                continue
        else:
            mate = v if by == u else u
            k, own = code[place[mate]], code[place[by]]
            if k == -2 or (k != own and k != -1 and own != -1) or at(sums[by], mate) != -w:
                best_cluster(by)
                continue
        left, right = sums_of(u), sums_of(v)
        for c, value in right.items():
            if c in left:
                left[c] += value
            else:
                left[c] = value
        if code[place[u]] == -1:
            code[place[u]] = code[place[v]]
        code[place[v]] = -2
        free[u] = free[v] = False
        owner[v] = u
        at(left, u, 0.0)
        version[u] += 1
        for c in left:
            for other in seated[c]:
                at(sums[other], u, at(left, other))
                if cell[u] in sums[other]:
                    holders[cell[u]].add(other)
        sums[u] = left
        seated[cell[u]].add(u)
        for c in left:
            holders[c].add(u)
        best_cluster(u)
    while (owner[owner] != owner).any():
        owner = owner[owner]
    return compact(owner)


def multicut(xyz, origins, directions, levels, radius, geo_weight, geo_pivot, sem_weight, sem_pivot, source, range_m, vectors=None) -> np.ndarray:
    """Signed edges between near points, geo_weight (1 - d / geo_pivot) + sem_weight (cosine - sem_pivot), contracted greedily."""
    unit = None
    if sem_weight:
        if vectors is None or (np.linalg.norm(vectors, axis=1) <= 0).any():
            raise ValueError("semantic weights need a vector other than zero for each row")
        unit = unit_rows(np.asarray(vectors, float))
    points, starts, rays = _by_column(xyz), _by_column(origins), _by_column(directions)
    known, level = _compatible_rows(levels), [None if np.isnan(k) else k for k in levels.tolist()]

    def cost(v: int, rows: np.ndarray) -> np.ndarray:
        ok = known[level[v]][rows]
        if source == "depth" and unit is None:
            gap = points(rows) - xyz[v]
            d = np.sqrt(_dot(gap, gap))
            return np.where((d <= radius) & ok, geo_weight * (1 - d / geo_pivot), 0.0)
        some = np.flatnonzero(ok)
        mates = rows[some]
        gap = points(mates) - xyz[v]
        d = np.sqrt(_dot(gap, gap))
        ok = d <= radius
        if not ok.all():
            some, mates, d = some[ok], mates[ok], d[ok]
        if source == "ray":
            ray = rays(mates)
            d, ti, tj = ray_approach(origins[v], directions[v], starts(mates), ray)
            k = np.flatnonzero((np.abs(_dot(directions[v], ray)) > 0.9999) & (mates < v))  # of parallel lines the smaller row's is the first
            if len(k):
                d[k], tj[k], ti[k] = ray_approach(starts(mates[k]), ray[k], origins[v], directions[v])
            ok = _in_range(ti, *range_m) & _in_range(tj, *range_m)
            some, mates, d = some[ok], mates[ok], d[ok]
        value = geo_weight * (1 - d / geo_pivot)
        if unit is not None:
            value += sem_weight * (np.einsum("ij,j->i", unit.take(mates, axis=0), unit[v]) - sem_pivot)
        out = np.zeros(len(rows))
        out[some] = value
        return out

    if unit is None or sem_weight < 0 or geo_weight < 0:
        return contract_near(xyz, radius, levels, cost)
    short, slack = unit.astype(np.float32), 2e-7 * (unit.shape[1] + 16)  # more than short cosines are wrong by

    def best(rows: np.ndarray, near: np.ndarray):
        """By the cosine alone most edges can't be the best: the distance takes something off, and is looked at for the others only."""
        others, least = np.ascontiguousarray(short[near].T), 1.0
        at_once = max(1, AT_ONCE // len(near))
        for a in range(0, len(rows), at_once):
            block = rows[a : a + at_once]
            for v, cosine in zip(block.tolist(), short[block] @ others, strict=True):
                first = int(np.searchsorted(near, v, "right"))
                mates, cosine, top, mate = near[first:], cosine[first:], 0.0, -1
                high = np.inf  # cosines from here on have been looked at
                while True:
                    part = mates[(cosine >= least) & (cosine < high)]
                    w = cost(v, part)
                    if (new := float(w.max(initial=0))) > 0 and new >= top:
                        one = int(part[w == new].min())
                        top, mate = new, one if new > top else min(mate, one)
                    needed = (top - geo_weight) / sem_weight + sem_pivot - slack
                    if least <= needed or least < -1.5:
                        break
                    high, least = least, max(needed, least - 0.2, -2.0)
                least = min(needed, 1.0)
                if top > 0:
                    yield v, top, mate

    return contract_near(xyz, radius, levels, cost, best)


def single_linkage(xyz, levels, radius, vectors=None, gate=None) -> np.ndarray:
    """Components of points within the radius of each other, on compatible levels, with a cosine of at least the gate."""
    unit = unit_rows(np.asarray(vectors, float)) if gate is not None and vectors is not None else None
    out = Joined(len(xyz))
    for i, j in near_pair_parts(xyz, radius):
        ok = out.apart(i, j) & (np.isnan(levels[i]) | np.isnan(levels[j]) | (levels[i] == levels[j]))
        i, j = i[ok], j[ok]
        if unit is not None:
            for a in range(0, len(i), 1 << 17):
                p, q = i[a : a + (1 << 17)], j[a : a + (1 << 17)]
                ok = out.apart(p, q)
                p, q = p[ok], q[ok]
                ok = np.einsum("ij,ij->i", unit[p], unit[q]) >= gate
                out.add(p[ok], q[ok])
        else:
            out.add(i, j)
    return compact(out.label)


def similar_components(vectors, threshold, block=2000) -> np.ndarray:
    """Components of rows whose cosine reaches the threshold, products taken block by block."""
    unit = unit_rows(np.asarray(vectors, float))
    left, right = [], []
    for a in range(0, len(unit), block):
        for b in range(a, len(unit), block):
            i, j = np.nonzero(unit[a : a + block] @ unit[b : b + block].T >= threshold)
            ok = i + a < j + b
            left.append(i[ok] + a)
            right.append(j[ok] + b)
    if not left:
        return np.zeros(0, np.int64)
    return compact(components(len(unit), np.concatenate(left), np.concatenate(right)))


def medoid(vectors) -> tuple[int, np.ndarray]:
    """The row nearest to all others by cosine (the first of equal ones), and each row's cosine with it."""
    unit = unit_rows(np.asarray(vectors, float))
    k = int(np.round(unit @ unit.sum(axis=0), 12).argmax())
    return k, unit @ unit[k]


def geometric_median(xyz, weights=None, rounds=50, tolerance=1e-6) -> np.ndarray:
    """Point of the least weighted distance to all, by Weiszfeld's iteration from the mean."""
    w = np.ones(len(xyz)) if weights is None else np.asarray(weights, float)
    at = (xyz * w[:, None]).sum(axis=0) / w.sum()
    for _ in range(rounds):
        pull = w / np.maximum(np.linalg.norm(xyz - at, axis=1), 1e-9)
        new = (xyz * pull[:, None]).sum(axis=0) / pull.sum()
        if np.linalg.norm(new - at) < tolerance:
            return new
        at = new
    return at


def ray_centroid(origins, directions, worst=1e12) -> np.ndarray | None:
    """Point nearest to all rays in least squares; None where they don't determine one."""
    some = np.linalg.norm(directions, axis=1) > 1e-12
    o, d = origins[some], directions[some]
    across = np.eye(3) - d[:, :, None] * d[:, None, :]
    system = across.sum(axis=0)
    if not len(o) or not np.linalg.cond(system) <= worst:
        return None
    return np.linalg.solve(system, (across @ o[:, :, None]).sum(axis=0)[:, 0])


def suppressed(order, overlap, keep) -> np.ndarray:
    """Mask of the rows that stay: in order, a row stays if keep(overlap) holds with all that stayed."""
    kept: list[int] = []
    out = np.zeros(len(order), bool)
    for k in order:
        if not kept or keep(overlap(k, np.array(kept))).all():
            kept.append(int(k))
            out[k] = True
    return out


def overlapping_parts(boxes, overlap, threshold, most: int = 1 << 17):
    """What overlapping returns, in parts of about `most` pairs."""
    reach = np.searchsorted(boxes[:, 0], boxes[:, 2] - threshold * (boxes[:, 2] - boxes[:, 0]) + 1e-9 * (1 + np.abs(boxes[:, 2])), "right")
    left, right, n = [], [], 0
    for k in range(len(boxes)):
        hit = np.flatnonzero(overlap(k, slice(k + 1, reach[k])) > threshold) if reach[k] > k + 1 else ()
        if len(hit):
            left.append(np.full(len(hit), k))
            right.append(k + 1 + hit)
            n += len(hit)
        if n >= most:
            yield np.concatenate(left), np.concatenate(right)
            left, right, n = [], [], 0
    if n:
        yield np.concatenate(left), np.concatenate(right)


def overlapping(boxes, overlap, threshold) -> tuple[np.ndarray, np.ndarray]:
    """Places i, j of rows (x0, y0, x1, y1, by ascending x0) that overlap more than the threshold, i < j.

    The intersection is wider than the threshold's share of either box, so j begins within the rest of i's width.
    """
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *overlapping_parts(boxes, overlap, threshold)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _near_boxes(boxes, threshold, most):
    """Candidates of overlapping_boxes: rows of like width and height meet in cells of their height, as far along x as the left one's width allows.

    Those go at once whose intersection is less high than the threshold's share of the higher one.
    """
    size, slack = boxes[:, 2:] - boxes[:, :2], 1 - 1e-9
    n, rest = len(boxes), max(1 - threshold, 0.05)
    step = math.log(max(1 / (threshold * slack), 1.5))
    reach = np.searchsorted(boxes[:, 0], boxes[:, 2] - threshold * size[:, 0] + 1e-9 * (1 + np.abs(boxes[:, 2])), "right")
    kind = np.floor(np.log(size) / step).astype(np.int64)
    order = np.lexsort((kind[:, 1], kind[:, 0]))
    edges = np.r_[0, np.flatnonzero((np.diff(kind[order], axis=0) != 0).any(axis=1)) + 1, n]
    kinds = {tuple(kind[rows[0]].tolist()): rows for a, b in zip(edges, edges[1:]) if len(rows := np.sort(order[a:b]))}
    for (wide, tall), left in kinds.items():
        for dw, dh in np.ndindex(3, 3):
            right = kinds.get((wide + dw - 1, tall + dh - 1))
            if right is None:
                continue
            cell = rest * max(size[left, 1].max(), size[right, 1].max()) * (1 + 1e-6)
            at, own = np.floor(boxes[left, 1] / cell), np.floor(boxes[right, 1] / cell)
            upper, lower, need = boxes[left, 1], boxes[left, 3], threshold * slack * size[left, 1]
            cells, own = np.unique(own, return_inverse=True)
            key = own * (n + 1) + right
            by = np.argsort(key, kind="stable")
            key, there = key[by], right[by]
            top, bottom, least = boxes[there, 1], boxes[there, 3], threshold * slack * size[there, 1]
            for up in (-1, 0, 1):
                k = np.minimum(np.searchsorted(cells, at + up), len(cells) - 1)
                low = np.searchsorted(key, k * (n + 1) + left + 1)
                count = np.where(cells[k] == at + up, np.searchsorted(key, k * (n + 1) + reach[left]) - low, 0).clip(0)
                total = np.r_[0, np.cumsum(count)]
                first = 0
                while total[first] < total[-1]:
                    last = max(first + 1, int(np.searchsorted(total, total[first] + most, "right")) - 1)
                    i = np.repeat(np.arange(first, last), count[first:last])
                    j = np.arange(total[first], total[last]) + (low - total[:-1])[i]
                    both = np.minimum(bottom[j], lower[i]) - np.maximum(top[j], upper[i])
                    some = np.flatnonzero(both >= np.maximum(least[j], need[i]))
                    yield left[i[some]], there[j[some]]
                    first = last


def overlapping_boxes(boxes, threshold, most: int = 1 << 17):
    """What overlapping_parts returns for the planar overlap and thresholds from 0.05 to less than 1, in another order: for many boxes.

    Both sides of the intersection are longer than the threshold's share of either box's, so sizes are alike and places near.
    """
    some = np.flatnonzero(np.isfinite(boxes).all(axis=1) & (boxes[:, 2] > boxes[:, 0]) & (boxes[:, 3] > boxes[:, 1]))
    x0, y0, x1, y1 = np.ascontiguousarray(boxes[some].T)
    area = (x1 - x0) * (y1 - y0)
    left, right, n = [], [], 0
    for i, j in _near_boxes(boxes[some], threshold, most):
        both = (np.minimum(x1[i], x1[j]) - x0[j]).clip(0) * (np.minimum(y1[i], y1[j]) - np.maximum(y0[i], y0[j])).clip(0)
        hit = both / (area[i] + area[j] - both) > threshold
        left.append(some[i[hit]])
        right.append(some[j[hit]])
        n += len(left[-1])
        if n >= most:
            yield np.concatenate(left), np.concatenate(right)
            left, right, n = [], [], 0
    if n:
        yield np.concatenate(left), np.concatenate(right)


def thinned(xyz, ids, least) -> np.ndarray:
    """Mask of the rows that stay when, by descending id, a row nearer than `least` to one that stays goes."""
    out = np.zeros(len(ids), bool)
    if least <= 0:
        return ~out
    cells: dict[tuple, list[int]] = {}
    cell = np.floor(xyz / least).astype(np.int64)
    for k in np.argsort(-np.asarray(ids), kind="stable"):
        x, y, z = cell[k].tolist()
        near = [m for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) for m in cells.get((x + a, y + b, z + c), ())]
        if not near or (((xyz[near] - xyz[k]) ** 2).sum(axis=1) >= least * least).all():
            cells.setdefault((x, y, z), []).append(int(k))
            out[k] = True
    return out


def one_to_one(left, right, cost, tie) -> np.ndarray:
    """Mask of the pairs taken when, by cost, then descending tie, each left and right row is used once."""
    used_left, used_right = set(), set()
    out = np.zeros(len(cost), bool)
    for k in np.lexsort((right, left, -np.asarray(tie), cost)):
        if left[k] not in used_left and right[k] not in used_right:
            used_left.add(left[k])
            used_right.add(right[k])
            out[k] = True
    return out


def rotation_to_quaternion(m: np.ndarray) -> np.ndarray:
    """w, x, y, z with w >= 0 of the rotation nearest to a 3 by 3 matrix."""
    u, _, vt = np.linalg.svd(m)
    r = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt
    k = np.array(
        [
            [r[0, 0] + r[1, 1] + r[2, 2], r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]],
            [r[2, 1] - r[1, 2], r[0, 0] - r[1, 1] - r[2, 2], r[0, 1] + r[1, 0], r[0, 2] + r[2, 0]],
            [r[0, 2] - r[2, 0], r[0, 1] + r[1, 0], r[1, 1] - r[0, 0] - r[2, 2], r[1, 2] + r[2, 1]],
            [r[1, 0] - r[0, 1], r[0, 2] + r[2, 0], r[1, 2] + r[2, 1], r[2, 2] - r[0, 0] - r[1, 1]],
        ]
    )
    q = np.linalg.eigh(k)[1][:, -1]
    return q if q[0] >= 0 else -q


def window_median(image: np.ndarray, row: int, col: int, half: int, least: int = 3) -> float:
    """Median of the finite pixels about one, columns wrapping and rows clamped; NaN under `least` of them."""
    rows = np.clip(np.arange(row - half, row + half + 1), 0, image.shape[0] - 1)
    cols = np.mod(np.arange(col - half, col + half + 1), image.shape[1])
    seen = image[np.ix_(np.unique(rows), cols)]
    seen = seen[np.isfinite(seen)]
    return float(np.median(seen)) if len(seen) >= least else float("nan")

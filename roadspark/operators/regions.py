"""Areas in the plane: union, intersection, difference, growth and shrinkage of polygons with holes.

A polygon is a list of rings ((n, 2) arrays without a closing point); what an odd number of its rings surround is
inside.  A region is a list of slabs: the plane is cut at every height of a vertex or a crossing, so that between two
cuts edges never cross, and what is inside there is a row of trapezoids.  Areas are exact sums of trapezoids, parts
are trapezoids that touch, and outlines are the sides that no other trapezoid covers.

These kernels hold one bounded group (a block of the map, one plot) at a time, inside applyInPandas; their work grows
with the square of a group's edges.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from roadspark.operators.kernels import area as ring_area
from roadspark.operators.kernels import hull

Ring = np.ndarray
Polygon = list[Ring]
#: A trapezoid: y0, y1, and x of its left and right sides at y0 and at y1.
Trapezoid = tuple[float, float, float, float, float, float]
TINY = 1e-9


def _edges(polygons: list[Polygon]) -> tuple[np.ndarray, np.ndarray]:
    """Edges (x0, y0, x1, y1), upwards, and the number of the polygon that each is of; level ones are left out."""
    rows, of = [np.zeros((0, 4))], [np.zeros(0, np.int64)]
    for k, polygon in enumerate(polygons):
        for ring in polygon:
            a = np.asarray(ring, float)
            e = np.concatenate((a, np.concatenate((a[1:], a[:1]))), axis=1)
            e = e[e[:, 1] != e[:, 3]]
            rows.append(np.where((e[:, 1] > e[:, 3])[:, None], e[:, [2, 3, 0, 1]], e))
            of.append(np.full(len(e), k))
    return np.concatenate(rows), np.concatenate(of)


def _heights(e: np.ndarray) -> np.ndarray:
    """Where the plane is cut: vertices and crossings."""
    found = [e[:, 1], e[:, 3]]
    d = e[:, 2:] - e[:, :2]
    low, high = np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2])
    for k in range(0, len(e), 256):
        mine = slice(k, k + 256)
        i, j = np.nonzero((low[mine, None] <= high) & (high[mine, None] >= low) & (e[mine, None, 1] < e[:, 3]) & (e[mine, None, 3] > e[:, 1]))
        i += k
        i, j = i[i < j], j[i < j]
        gap = e[j, :2] - e[i, :2]
        cross = d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (gap[:, 0] * d[j, 1] - gap[:, 1] * d[j, 0]) / cross
            u = (gap[:, 0] * d[i, 1] - gap[:, 1] * d[i, 0]) / cross
        hit = (np.abs(cross) > 1e-14) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        found.append(e[i[hit], 1] + t[hit] * d[i[hit], 1])
    y = np.unique(np.concatenate(found))
    return y[np.concatenate(([True], np.diff(y) > TINY))] if len(y) else y


def combine(first: list[Polygon], second: list[Polygon], keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[list[Trapezoid]]:
    """The slabs of what keep(inside any of the first, inside any of the second) says, all swept at once.

    An edge enters its polygon if an even number of the polygon's own edges lie left of it in the slab, and leaves it
    else; sums of entries less exits, from left to right, tell what is inside.
    """
    e, of = _edges([*first, *second])
    y = _heights(e)
    if len(y) < 2:
        return []
    middle = (y[:-1] + y[1:]) / 2
    # a middle at the very height of a vertex counts for the edge above it alone, so each polygon has an even number there
    begin, end = np.searchsorted(middle, e[:, 1], side="left"), np.searchsorted(middle, e[:, 3], side="left")
    n = np.maximum(end - begin, 0)
    edge = np.repeat(np.arange(len(e)), n)
    slab = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + begin[edge]
    slope = (e[edge, 2] - e[edge, 0]) / (e[edge, 3] - e[edge, 1])
    at = lambda h: e[edge, 0] + (h - e[edge, 1]) * slope
    x, whose = at(middle[slab]), of[edge]
    own = np.lexsort((x, whose, slab))
    new = np.ones(len(own), bool)
    new[1:] = (slab[own[1:]] != slab[own[:-1]]) | (whose[own[1:]] != whose[own[:-1]])
    place = np.arange(len(own))
    sign = np.empty(len(own), np.int64)
    sign[own] = 1 - 2 * ((place - np.maximum.accumulate(np.where(new, place, 0))) & 1)
    order = np.lexsort((x, slab))
    slab, x0, x1 = slab[order], at(y[slab])[order], at(y[slab + 1])[order]
    second_ = whose[order] >= len(first)
    sign = sign[order]
    inside = keep(np.cumsum(np.where(second_, 0, sign)) > 0, np.cumsum(np.where(second_, sign, 0)) > 0)
    before = np.concatenate(([False], inside[:-1]))
    left, right = np.flatnonzero(inside & ~before), np.flatnonzero(before & ~inside)
    wide = np.maximum(x0[right] - x0[left], x1[right] - x1[left]) > TINY
    left, right = left[wide], right[wide]
    if not len(left):
        return [[] for _ in middle]
    # neighbours that share a side are one
    apart = (slab[left[1:]] != slab[left[:-1]]) | (np.maximum(np.abs(x0[left[1:]] - x0[right[:-1]]), np.abs(x1[left[1:]] - x1[right[:-1]])) > TINY)
    left, right = left[np.concatenate(([True], apart))], right[np.concatenate((apart, [True]))]
    out: list[list[Trapezoid]] = [[] for _ in middle]
    for i, *t in zip(slab[left].tolist(), y[slab[left]].tolist(), y[slab[left] + 1].tolist(), x0[left].tolist(), x1[left].tolist(), x0[right].tolist(), x1[right].tolist()):
        out[i].append(tuple(t))
    return out


def union(polygons: list[Polygon]) -> list[list[Trapezoid]]:
    return combine(polygons, [], lambda a, _: a)


def intersection(first: list[Polygon], second: list[Polygon]) -> list[list[Trapezoid]]:
    return combine(first, second, lambda a, b: a & b)


def difference(first: list[Polygon], second: list[Polygon]) -> list[list[Trapezoid]]:
    return combine(first, second, lambda a, b: a & ~b)


def _size(t: Trapezoid) -> float:
    return (t[1] - t[0]) * ((t[4] - t[2]) + (t[5] - t[3])) / 2


def area(region: list[list[Trapezoid]]) -> float:
    return sum(_size(t) for row in region for t in row)


def triangles(region: list[list[Trapezoid]]) -> list[np.ndarray]:
    """Triangles that cover a region exactly, counter-clockwise."""
    out = []
    for row in region:
        for y0, y1, a, b, c, d in row:
            if c - a > TINY:
                out.append(np.array([[a, y0], [c, y0], [d, y1]]))
            if d - b > TINY:
                out.append(np.array([[a, y0], [d, y1], [b, y1]]))
    return out


def outlines(region: list[list[Trapezoid]]) -> list[Ring]:
    """The rings around a region, counter-clockwise, and around its holes, clockwise."""
    key = lambda x, y: (round(x * 1e7), round(y * 1e7))
    steps: dict[tuple, list] = {}
    place: dict[tuple, tuple[float, float]] = {}

    def add(a: tuple[float, float], b: tuple[float, float]) -> None:
        p, q = key(*a), key(*b)
        if p != q:
            place.setdefault(p, a)
            place.setdefault(q, b)
            steps.setdefault(p, []).append(q)

    for i in range(len(region) + 1):
        below = [(t[3], t[5]) for t in region[i - 1]] if i else []
        above = [(t[2], t[4]) for t in region[i]] if i < len(region) else []
        touching = bool(below and above) and abs(region[i - 1][0][1] - region[i][0][0]) < TINY
        for mine, other in ((below, above),) if touching else ((below, []), ([], above)):
            # spans of a row lie apart, from left to right: one walk over all their ends tells what only one side covers
            ends = sorted([(x, 0) for span in mine for x in span] + [(x, 1) for span in other for x in span])
            inside = [False, False]
            for (x, side), (x2, _) in zip(ends, ends[1:]):
                inside[side] = not inside[side]
                if x2 > x and inside[0] != inside[1]:
                    if inside[1]:
                        add((x, region[i][0][0]), (x2, region[i][0][0]))
                    else:
                        add((x2, region[i - 1][0][1]), (x, region[i - 1][0][1]))
        if i < len(region):
            for y0, y1, a, b, c, d in region[i]:
                add((c, y0), (d, y1))
                add((b, y1), (a, y0))
    rings = []
    while steps:
        start = min(steps)
        ring, at, came = [start], start, None
        while True:
            ahead = steps[at]
            if came is not None and len(ahead) > 1:  # where rings touch, the sharpest turn to the left keeps them apart
                turn = lambda q: (np.arctan2(q[1] - at[1], q[0] - at[0]) - np.arctan2(at[1] - came[1], at[0] - came[0]) + np.pi) % (2 * np.pi)  # noqa: E731, B023
                ahead.sort(key=turn)
            came, nxt = at, ahead.pop()
            if not ahead:
                del steps[came]
            if nxt == start or nxt not in steps:
                break
            ring.append(nxt)
            at = nxt
        r = np.array([place[p] for p in ring])
        a, b = r - np.roll(r, 1, axis=0), np.roll(r, -1, axis=0) - r
        bend = np.abs(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]) > 1e-9 * np.maximum(1e-12, np.hypot(*a.T) * np.hypot(*b.T))
        r = r[bend]
        if len(r) >= 3 and abs(ring_area(r)) > TINY:
            rings.append(r)
    return rings


def parts(region: list[list[Trapezoid]]) -> list[list[list[Trapezoid]]]:
    """The connected parts of a region, as regions, those that touch in a point alone apart."""
    flat = [(i, t) for i, row in enumerate(region) for t in row]
    up = list(range(len(flat)))

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    first = [0]
    for row in region:
        first.append(first[-1] + len(row))
    for i in range(len(region) - 1):
        k, j = first[i], first[i + 1]
        # both rows from left to right: whichever ends first is done
        while k < first[i + 1] and j < first[i + 2]:
            a, b = flat[k][1], flat[j][1]
            if abs(a[1] - b[0]) < TINY and min(a[5], b[4]) - max(a[3], b[2]) > TINY:
                up[root(j)] = root(k)
            if a[5] < b[4]:
                k += 1
            else:
                j += 1
    out: dict[int, list[list[Trapezoid]]] = {}
    for k, (i, t) in enumerate(flat):
        r = root(k)
        if r not in out:
            out[r] = [[] for _ in region]
        out[r][i].append(t)
    return list(out.values())


def as_polygons(region: list[list[Trapezoid]]) -> list[Polygon]:
    """Each part's rings, the outer one first."""
    return [sorted(outlines(p), key=lambda r: -ring_area(r)) for p in parts(region)]


def holes(region: list[list[Trapezoid]]) -> list[Ring]:
    """The rings around what the parts of a region surround, counter-clockwise."""
    return [r[::-1] for r in outlines(region) if ring_area(r) < 0]


def _rim(polygon: Polygon, by: float, side: int, join: str, limit: float = 5.0, arc: int = 16) -> list[Polygon]:
    """What a band of a width along a polygon's edges covers, outwards (side 1) or inwards (-1): a quad an edge, and a
    corner where the band's quads part: pointed (mitre; cut off straight beyond limit widths) or round (arc steps a
    quarter)."""
    out: list[Polygon] = []
    whole = sorted((np.asarray(r, float) for r in polygon), key=lambda r: -abs(ring_area(r)))
    for n, ring in enumerate(whole):
        # the inside on the left: the outer ring counter-clockwise, holes clockwise
        r = ring if (ring_area(ring) > 0) == (n == 0) else ring[::-1]
        r = r[np.hypot(*(np.roll(r, -1, axis=0) - r).T) > TINY]
        d = np.roll(r, -1, axis=0) - r
        u = d / np.hypot(*d.T)[:, None]
        normal = np.stack((u[:, 1], -u[:, 0]), axis=1) * side
        for a, b, m in zip(r, np.roll(r, -1, axis=0), normal):
            out.append([np.array([a, b, b + m * by, a + m * by])])
        for p, before, behind, m, k in zip(r, np.roll(u, 1, axis=0), u, np.roll(normal, 1, axis=0), normal):
            bend = (before[0] * behind[1] - before[1] * behind[0]) * side
            if bend <= 1e-12:
                continue
            if join == "round":
                start, turn = np.arctan2(m[1], m[0]), np.arccos(np.clip(m @ k, -1, 1)) * side
                steps = max(1, int(np.ceil(abs(turn) / (np.pi / 2) * arc)))
                fan = [p + by * np.array([np.cos(start + turn * i / steps), np.sin(start + turn * i / steps)]) for i in range(steps + 1)]
                out.append([np.array([p, *fan])])
            else:
                middle = (m + k) / max(1 + m @ k, 1e-12)
                tip = [p + middle * by] if np.hypot(*middle) <= limit else []
                out.append([np.array([p, p + m * by, *tip, p + k * by])])
    return out


def grown(polygons: list[Polygon], by: float, join: str = "round") -> list[list[Trapezoid]]:
    """Polygons, and what is within a distance of them."""
    if by <= 0:
        return shrunk(polygons, -by, join) if by < 0 else union(polygons)
    if join == "mitre":
        wide = [pointed(p[0], by) if len(p) == 1 else None for p in polygons]
        return union([x for p, w in zip(polygons, wide) for x in ([[w]] if w is not None else [p, *_rim(p, by, 1, join)])])
    return union([*polygons, *(b for p in polygons for b in _rim(p, by, 1, join))])


def pointed(ring: Ring, by: float, limit: float = 5.0) -> Ring | None:
    """A convex ring grown with pointed corners, as one ring; null for one that isn't convex, or has a sharper corner."""
    r = np.asarray(ring, float)
    r = r if ring_area(r) > 0 else r[::-1]
    r = r[np.hypot(*(np.roll(r, -1, axis=0) - r).T) > TINY]
    d = np.roll(r, -1, axis=0) - r
    u = d / np.hypot(*d.T)[:, None]
    before = np.roll(u, 1, axis=0)
    if len(r) < 3 or (before[:, 0] * u[:, 1] - before[:, 1] * u[:, 0] < 0).any():
        return None
    m, k = np.stack((before[:, 1], -before[:, 0]), axis=1), np.stack((u[:, 1], -u[:, 0]), axis=1)
    middle = (m + k) / np.maximum(1 + (m * k).sum(1), 1e-12)[:, None]
    return r + middle * by if (np.hypot(*middle.T) <= limit).all() else None


def grown_convex(ring: Ring, by: float, arc: int = 4) -> Ring:
    """A convex ring and what is within a distance of it, as one ring whose round corners have arc chords a quarter."""
    turn = np.arange(4 * arc) * (np.pi / 2 / arc)
    round_ = by * np.stack((np.cos(turn), np.sin(turn)), axis=1)
    return hull((np.asarray(ring, float)[:, None, :] + round_[None]).reshape(-1, 2))


def shrunk(polygons: list[Polygon], by: float, join: str = "round") -> list[list[Trapezoid]]:
    """Disjoint polygons without what is within a distance of their outlines."""
    return difference(polygons, [b for p in polygons for b in _rim(p, by, -1, join)]) if by > 0 else grown(polygons, -by, join)


def closed(polygons: list[Polygon], gap: float, largest_hole: float) -> list[list[Trapezoid]]:
    """Polygons with the gaps between them filled: grown and shrunk again by gap, with pointed corners, and without
    the holes under an area."""
    wide = as_polygons(shrunk(as_polygons(grown(polygons, gap, "mitre")), gap, "mitre"))
    return union([[p[0], *(h for h in p[1:] if abs(ring_area(h)) >= largest_hole)] for p in wide])


def infill(polygons: list[Polygon], gap: float, least: float, most: float) -> list[list[list[Trapezoid]]]:
    """The patches that fill the gaps between polygons, of more than the least and under the most area."""
    filled = as_polygons(closed(polygons, gap, most))
    return [p for p in parts(difference(filled, polygons)) if least < area(p) < most]


def is_narrow(ring: Ring, width: float) -> bool:
    """Whether a hole is nowhere as wide as a width."""
    return area(shrunk([[ring]], width / 2, "round")) <= 1e-9


def convex(polygon: Polygon) -> Ring | None:
    """A polygon's only ring, counter-clockwise from its leftmost corner, as as_polygons() of its union has it; null for
    others than plainly convex ones, and those whose corners are nearly straight or nearly meet.

    Most plots are; a few lines over floats do for these what a sweep of slabs does for any form.
    """
    if len(polygon) != 1 or len(polygon[0]) < 3:
        return None
    p = np.asarray(polygon[0], float).tolist()
    if sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(p, p[1:] + p[:1])) < 0:
        p.reverse()
    d = [(b[0] - a[0], b[1] - a[1]) for a, b in zip(p, p[1:] + p[:1])]
    size = [(x * x + y * y) ** 0.5 for x, y in d]
    if min(size) < 1e-6 or not max(size) < 1e9:
        return None
    up = 0
    for k in range(len(d)):
        (a, b), (x, y) = d[k - 1], d[k]
        if a * y - b * x <= 1e-8 * size[k - 1] * size[k]:
            return None
        up += (b < 0) & (y >= 0)
    if up != 1:  # more than one turn around
        return None
    k = min(range(len(p)), key=lambda i: (round(p[i][0] * 1e7), round(p[i][1] * 1e7)))
    return np.array(p[k:] + p[:k])


def _beyond(p: list, nx: float, ny: float, least: float) -> list:
    """The part of a convex ring (a list of corners) where nx x + ny y is least or more."""
    out = []
    a = p[-1]
    s = nx * a[0] + ny * a[1] - least
    for b in p:
        t = nx * b[0] + ny * b[1] - least
        if (s >= 0) != (t >= 0):
            u = s / (s - t)
            out.append((a[0] + (b[0] - a[0]) * u, a[1] + (b[1] - a[1]) * u))
        if t >= 0:
            out.append(b)
        a, s = b, t
    return out


def cut_convex(ring: Ring, direction: Ring, at: float) -> list[list[Polygon]] | None:
    """What lies before and behind a line across a direction, of a ring from convex(); null if a side isn't plainly
    convex itself, and so a matter for intersection()."""
    p, (x, y) = ring.tolist(), map(float, direction)
    sides = []
    for side in (_beyond(p, -x, -y, -at), _beyond(p, x, y, at)):
        whole = convex([side]) if len(side) > 2 else None
        if side and whole is None:
            return None
        sides.append([[whole]] if side else [])
    return sides


def drawn_in(ring: Ring, by: float) -> Ring | None:
    """A ring from convex() without what is within a distance of its sides, as shrunk() with pointed corners has it; no
    corners if nothing is left, null if what is left isn't plainly convex."""
    p = out = ring.tolist()
    for a, b in zip(p, p[1:] + p[:1]):
        x, y = b[0] - a[0], b[1] - a[1]
        n = (x * x + y * y) ** 0.5
        out = _beyond(out, -y / n, x / n, (a[1] * x - a[0] * y) / n + by)
        if not out:
            return np.zeros((0, 2))
    return convex([out])


def _depth(ring: Ring, share: float) -> float | None:
    """How far a ring from convex() is drawn in to cover a share of its ground.  Its area falls by its girth, and that by
    how sharp its corners are, until a side is gone; null if it can't be told which."""
    want, gone = share * abs(ring_area(ring)), 0.0
    while ring is not None and len(ring) >= 3:
        p = ring.tolist()
        d = [(b[0] - a[0], b[1] - a[1]) for a, b in zip(p, p[1:] + p[:1])]
        size = [(x * x + y * y) ** 0.5 for x, y in d]
        sharp = [(d[k - 1][0] * d[k][1] - d[k - 1][1] * d[k][0]) / (size[k - 1] * size[k] + d[k - 1][0] * d[k][0] + d[k - 1][1] * d[k][1]) for k in range(len(d))]
        more, girth, bend = abs(ring_area(ring)) - want, sum(size), sum(sharp)
        until = min(n / (sharp[k] + sharp[(k + 1) % len(d)]) for k, n in enumerate(size))
        if more - girth * until + bend * until * until <= 0:
            return gone + 2 * more / (girth + max(0.0, girth * girth - 4 * bend * more) ** 0.5)
        ring, gone = drawn_in(ring, until + 1e-9), gone + until + 1e-9
    return None


def inset_to_share(polygon: Polygon, share: float, steps: int = 30) -> list[Polygon]:
    """A polygon of any form drawn in, corners kept pointed, until it covers a share of its ground; what is left may be
    several polygons.  A share of 1 or more leaves it as it is, one of 0 or less nothing."""
    ring = convex(polygon)
    whole = area(union([polygon])) if ring is None else float(ring_area(ring))
    if share >= 1 or whole <= 0:
        return as_polygons(union([polygon]))
    if share <= 0:
        return []
    by = _depth(ring, share) if ring is not None else None
    left = drawn_in(ring, by) if by is not None else None
    if left is not None and len(left):
        return [[left]]
    at = np.concatenate(polygon)
    low, high = 0.0, float(np.hypot(*np.ptp(at, axis=0))) / 2
    for _ in range(steps):
        middle = (low + high) / 2
        if area(shrunk([polygon], middle, "mitre")) > share * whole:
            low = middle
        else:
            high = middle
    return as_polygons(shrunk([polygon], (low + high) / 2, "mitre"))

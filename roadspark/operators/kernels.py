"""Numerical and planar kernels that no composition of DataFrame operators expresses, in numpy.

They work on one group that a caller has bounded (a block of cells, one plot, one ribbon), inside applyInPandas.
Planar kernels take rings as (n, 2) arrays without a closing point.
"""

from __future__ import annotations

import math

import numpy as np

# ---------------------------------------------------------------- rings


def area(ring: np.ndarray) -> float:
    """Signed area."""
    a = np.asarray(ring, float)
    b = np.concatenate((a[1:], a[:1]))
    return float((a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1]).sum() / 2)


def clip_convex(ring: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The part of a ring inside a convex ring (either winding); a ring of no points if there is none."""
    out = [tuple(p) for p in np.asarray(ring, float)]
    w = np.asarray(window, float)
    w = w if area(w) > 0 else w[::-1]
    for a, b in zip(w, np.roll(w, -1, axis=0)):
        side = [(b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) for p in out]
        kept = []
        for i, p in enumerate(out):
            q, s, t = out[i - 1], side[i], side[i - 1]
            if (s >= 0) != (t >= 0):
                u = t / (t - s)
                kept.append((q[0] + u * (p[0] - q[0]), q[1] + u * (p[1] - q[1])))
            if s >= 0:
                kept.append(p)
        out = kept
        if not out:
            break
    return np.array(out, float).reshape(-1, 2)


def overlap_area(a: np.ndarray, b: np.ndarray) -> float:
    """Area common to a ring and a convex ring."""
    c = clip_convex(a, b)
    return abs(area(c)) if len(c) > 2 else 0.0


def contains(ring: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Which points lie inside a ring (even-odd)."""
    x, y = np.asarray(ring, float).T
    x2, y2 = np.roll(x, -1), np.roll(y, -1)
    px, py = np.asarray(points, float).reshape(-1, 2).T
    cross = (y[None] > py[:, None]) != (y2[None] > py[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (x2 - x)[None] * (py[:, None] - y[None]) / (y2 - y)[None] + x[None]
    return (cross & (px[:, None] < at)).sum(1) % 2 == 1


def outline_distance(ring: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distance of points from a ring's outline."""
    a = np.asarray(ring, float)
    d = np.roll(a, -1, axis=0) - a
    p = np.asarray(points, float).reshape(-1, 1, 2)
    t = np.clip(((p - a) * d).sum(2) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
    return np.sqrt(((p - (a + t[..., None] * d)) ** 2).sum(2)).min(1)


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise."""
    p = sorted(set(map(tuple, np.asarray(points, float).tolist())))
    if len(p) < 3:
        return np.array(p, float).reshape(-1, 2)

    def half(points):
        out = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]), float)


def rotated_rectangle(points: np.ndarray) -> tuple[float, float, float]:
    """(long side, short side, heading of the long side in degrees, 0 to 180) of the smallest rectangle around."""
    h = hull(points)
    if len(h) < 2:
        return 0.0, 0.0, 0.0
    best, p = None, h.tolist()
    for (x0, y0), (x1, y1) in zip(p, p[1:] + p[:1]):
        n = math.hypot(x1 - x0, y1 - y0)
        if n == 0:
            continue
        ux, uy = (x1 - x0) / n, (y1 - y0) / n
        if len(p) > 32:
            along, across = h @ np.array([ux, uy]), h @ np.array([-uy, ux])
            w, d = float(along.max() - along.min()), float(across.max() - across.min())
        else:  # few corners are done sooner in plain floats
            along, across = [x * ux + y * uy for x, y in p], [y * ux - x * uy for x, y in p]
            w, d = max(along) - min(along), max(across) - min(across)
        turn = math.degrees(math.atan2(uy, ux)) + (90 if d > w else 0)
        if best is None or w * d < best[0] - 1e-12:
            best = (w * d, max(w, d), min(w, d), turn % 180)
    return best[1:] if best else (0.0, 0.0, 0.0)


def enclosing_circle(points: np.ndarray) -> tuple[float, float, float]:
    """Centre of the bounding box, and the distance of the furthest point from it."""
    p = np.asarray(points, float)
    c = (p.min(0) + p.max(0)) / 2
    return float(c[0]), float(c[1]), float(np.hypot(*(p - c).T).max())


def half_plane(ring: np.ndarray, point: np.ndarray, normal: np.ndarray) -> np.ndarray:
    """The part of a convex ring on the side of a line that its normal points to."""
    (px, py), (nx, ny) = np.asarray(point, float).tolist(), np.asarray(normal, float).tolist()
    p = np.asarray(ring, float).tolist()
    side = [(x - px) * nx + (y - py) * ny for x, y in p]
    if all(s >= 0 for s in side):
        return ring
    out = []
    for (x, y), (u, v), s, t in zip(p, p[-1:] + p[:-1], side, side[-1:] + side[:-1]):
        if (s >= 0) != (t >= 0):
            k = t / (t - s)
            out.append((u + k * (x - u), v + k * (y - v)))
        if s >= 0:
            out.append((x, y))
    return np.array(out, float).reshape(-1, 2)


def inset(ring: np.ndarray, by: float) -> np.ndarray:
    """A convex ring moved inwards by a distance: each edge's half-plane moves; no points if nothing is left."""
    return _inset_hull(hull(ring), by)


def _inset_hull(r: np.ndarray, by: float) -> np.ndarray:
    out = r
    for a, b in zip(r, np.roll(r, -1, axis=0)):
        d = b - a
        n = np.array([-d[1], d[0]]) / max(float(np.hypot(*d)), 1e-300)
        out = half_plane(out, a + n * by, n)
        if len(out) < 3:
            return np.zeros((0, 2))
    return out


def inset_to_share(ring: np.ndarray, share: float, steps: int = 24) -> np.ndarray:
    """The inset of a convex ring that leaves a share of its area, by bisection."""
    whole = abs(area(ring))
    low, high, r = 0.0, rotated_rectangle(ring)[1] / 2, hull(ring)
    for _ in range(steps):
        mid = (low + high) / 2
        part = _inset_hull(r, mid)
        if len(part) > 2 and abs(area(part)) > share * whole:
            low = mid
        else:
            high = mid
    return _inset_hull(r, low)


def split_lots(ring: np.ndarray, target: float, least: float, seed: int) -> list[np.ndarray]:
    """A convex block halved across its long axis, the cut a little off the middle, until lots have at most the
    target area; lots under least are dropped, and the block itself stays if none is left."""
    rng = np.random.default_rng(seed)
    out, stack = [], [hull(ring)]
    while stack:
        r = stack.pop()
        if abs(area(r)) <= target:
            out.append(r)
            continue
        _, _, turn = rotated_rectangle(r)
        u = np.array([np.cos(np.radians(turn)), np.sin(np.radians(turn))])
        along = r @ u
        cut = along.min() + np.ptp(along) * rng.uniform(0.42, 0.58)
        for s in (-1, 1):
            part = half_plane(r, u * cut, u * s)
            if len(part) > 2:
                stack.append(part)
    lots = [r for r in out if abs(area(r)) >= least]
    return lots or [np.asarray(ring, float)]


def ear_clip(ring: np.ndarray) -> list[tuple[int, int, int]]:
    """Triangles (vertex numbers) that cover a simple ring."""
    p = np.asarray(ring, float)
    left = list(range(len(p)))
    if area(p) < 0:
        left.reverse()
    cross = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    out = []
    while len(left) > 3:
        for i in range(len(left)):
            a, b, c = left[i - 1], left[i], left[(i + 1) % len(left)]
            if cross(p[a], p[b], p[c]) <= 1e-12:
                continue
            if any(cross(p[a], p[b], p[q]) >= 0 and cross(p[b], p[c], p[q]) >= 0 and cross(p[c], p[a], p[q]) >= 0 for q in left if q not in (a, b, c)):
                continue
            out.append((a, b, c))
            del left[i]
            break
        else:
            flat = next((i for i in range(len(left)) if abs(cross(p[left[i - 1]], p[left[i]], p[left[(i + 1) % len(left)]])) <= 1e-12), 0)
            del left[flat]
    if len(left) == 3 and abs(cross(*(p[i] for i in left))) > 1e-12:
        out.append(tuple(left))
    return out


def golden(f, low: float, high: float, steps: int = 60) -> tuple[float, float]:
    """The largest value of f between low and high, where it has one hill, and its place."""
    ratio = (np.sqrt(5) - 1) / 2
    at = [high - ratio * (high - low), low + ratio * (high - low)]
    value = [f(x) for x in at]
    for _ in range(steps):
        if value[0] >= value[1]:
            high, at, value = at[1], [None, at[0]], [None, value[0]]
            at[0] = high - ratio * (high - low)
            value[0] = f(at[0])
        else:
            low, at, value = at[0], [at[1], None], [value[1], None]
            at[1] = low + ratio * (high - low)
            value[1] = f(at[1])
    best = int(value[1] > value[0])
    return value[best], at[best]


def best_fit(mesh: np.ndarray, plot: np.ndarray, stretch: float = 0.15, peaks: int = 4) -> tuple[float, float, float]:
    """(IoU, turn in degrees, scale) that lay a mesh's hull best over a plot's hull, both about their centroids.

    As a function of the turn the overlap changes its course where a side of one hull becomes parallel to a side of the
    other.  Those turns part the circle; the best peaks among them and the middles between them are climbed by golden
    section, and from the highest a stretch along the plot's longest side, of equal area and of at most 1 + stretch either
    way, and the turn are climbed in turn until neither gains.  scale is the geometric mean of both axes'.
    """
    a, b = hull(mesh), hull(plot)
    a, b = a - centroid(a), b - centroid(b)
    scale = float(np.sqrt(abs(area(b)) / max(abs(area(a)), 1e-12)))
    sides = [np.roll(h, -1, axis=0) - h for h in (a, b)]
    heading = [np.arctan2(e[:, 1], e[:, 0]) for e in sides]
    along = float(heading[1][np.argmax((sides[1] ** 2).sum(axis=1))]) if len(b) else 0.0
    axis = np.array([[np.cos(along), -np.sin(along)], [np.sin(along), np.cos(along)]])

    def overlap(turn: float, log_ratio: float) -> float:
        t = turn - along
        on_axis = a @ np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]]) * (scale * np.exp([log_ratio / 2, -log_ratio / 2]))
        r = on_axis @ axis.T
        common = overlap_area(r, b)
        return common / max(abs(area(r)) + abs(area(b)) - common, 1e-12)

    turns = np.unique(np.round((heading[1][:, None] - heading[0]).ravel() % (2 * np.pi), 9)) if len(a) and len(b) else np.zeros(1)
    turns = np.unique(np.concatenate((turns, (turns + np.diff(np.append(turns, turns[0] + 2 * np.pi)) / 2) % (2 * np.pi))))
    score = np.array([overlap(t, 0.0) for t in turns])
    around = np.concatenate((turns[-1:] - 2 * np.pi, turns, turns[:1] + 2 * np.pi))
    iou, turn, log_ratio = float(score.max()), float(turns[score.argmax()]), 0.0
    for k in np.argsort(-score, kind="stable")[:peaks]:
        got, at = golden(lambda t: overlap(t, 0.0), around[k], around[k + 2])
        if got > iou:
            iou, turn = got, at
    width, most = float(np.pi / 90), float(np.log(1 + stretch))
    while True:
        was = iou
        got, at = golden(lambda x: overlap(turn, x), -most, most)
        if got > iou:
            iou, log_ratio = got, at
        got, at = golden(lambda t: overlap(t, log_ratio), turn - width, turn + width)
        if got > iou:
            iou, turn = got, at
        if iou <= was + 1e-9:
            return float(iou), float(np.degrees(turn) % 360), scale


def centroid(ring: np.ndarray) -> np.ndarray:
    """A ring's centroid by its area; the mean of its vertices where it has none."""
    nxt = np.roll(ring, -1, axis=0)
    w = ring[:, 0] * nxt[:, 1] - nxt[:, 0] * ring[:, 1]
    return ((ring + nxt) * w[:, None]).sum(0) / (3 * w.sum()) if abs(w.sum()) > 1e-12 else ring.mean(0)


# ---------------------------------------------------------------- sequences with state


def monotone_projection(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each left vertex the nearest point of the right line (x, y, z), among feet no further back than the one
    before; the last is the right line's end.  A vertex all of whose feet are further back takes the nearest of all.

    All feet are found at once.  The nearest ones are right up to the first that goes back; from there the feet behind
    the last right one are struck out, and the rest is looked at again.
    """
    if not len(left):
        return np.empty((0, right.shape[1]))
    leg = np.diff(right, axis=0)
    square = (leg[:, :2] ** 2).sum(axis=1)
    share = np.einsum("nmk,mk->nm", left[:, None, :2] - right[None, :-1, :2], leg[:, :2]) / np.where(square > 1e-24, square, 1.0)
    share = share.clip(0, 1)
    feet = right[None, :-1] + share[..., None] * leg
    far = np.linalg.norm(feet[..., :2] - left[:, None, :2], axis=2)
    walked = np.concatenate(([0.0], np.cumsum(np.sqrt(square))))[:-1] + share * np.sqrt(square)
    chosen, row, floor = np.empty(len(left), np.int64), 0, -np.inf
    while row < len(left):
        ahead = walked[row:] >= floor - 1e-9
        pick = np.where(ahead | ~ahead.any(axis=1, keepdims=True), far[row:], np.inf).argmin(axis=1)
        place = np.take_along_axis(walked[row:], pick[:, None], axis=1)[:, 0]
        back = np.flatnonzero(np.diff(place) < -1e-9)
        n = 1 if place[0] < floor - 1e-9 else int(back[0]) + 1 if len(back) else len(place)
        chosen[row : row + n], floor, row = pick[:n], place[n - 1], row + n
    out = feet[np.arange(len(left)), chosen]
    out[-1] = right[-1]
    return out


def shelf_pack(sizes: list[tuple[int, int]], page: int) -> list[tuple[int, int, int] | None]:
    """(page, x, y) of each strip (w, h), cut down to a page: widest first, then tallest, down columns of one width; a
    new width, or a full column, begins the next column, and a full page the next page.  Empty strips have no place."""
    out: list = [None] * len(sizes)
    number = x = y = width = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i][0], -sizes[i][1], i)):
        if min(sizes[i]) <= 0:
            continue
        w, h = (min(v, page) for v in sizes[i])
        if width and (w != width or y + h > page):
            x, y = x + width, 0
        if x + w > page:
            number, x, y = number + 1, 0, 0
        out[i], width, y = (number, x, y), w, y + h
    return out


# ---------------------------------------------------------------- grids


def laplace(z: np.ndarray) -> np.ndarray:
    """Five-point Laplacian with mirrored edges."""
    p = np.pad(z, 1, mode="edge")
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * z


def solve(z: np.ndarray, order: int = 1, guidance: np.ndarray | None = None, tolerance: float = 1e-9, limit: int = 20_000) -> np.ndarray:
    """Unknown cells (NaN) of a grid by a membrane (order 1) or a thin plate (order 2) through the known ones, by
    conjugate gradients; guidance is a surface whose bends are followed.  Known cells stay as they are."""
    known = ~np.isnan(z)
    if known.all():
        return z.copy()
    if not known.any():
        return np.zeros_like(z)
    apply = (lambda u: -laplace(u)) if order == 1 else (lambda u: laplace(laplace(u)))
    start = np.where(known, z, np.nanmean(z))
    if guidance is not None:  # gaps of the model ask for no bend
        finite = np.isfinite(guidance)
        guidance = np.where(finite, guidance, guidance[finite].mean() if finite.any() else 0.0)
    goal = np.zeros_like(z) if guidance is None else apply(guidance)
    r = np.where(known, 0.0, goal - apply(start))
    x, p, rr = start.copy(), r.copy(), float((r * r).sum())
    first = rr
    for _ in range(limit):
        if rr <= tolerance * tolerance * max(first, 1e-300):
            break
        q = np.where(known, 0.0, apply(p))
        a = rr / float((p * q).sum())
        x += a * p
        r -= a * q
        rr, before = float((r * r).sum()), rr
        p = r + rr / before * p
    return x


def blurred(z: np.ndarray, sigma: float) -> np.ndarray:
    """A grid smoothed by a Gaussian cut at four sigma; beyond the edges the edge repeats."""
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    for axis in (0, 1):
        z = np.apply_along_axis(lambda v: np.convolve(np.pad(v, r, mode="edge"), w / w.sum(), "valid"), axis, z)
    return z


def settle(z: np.ndarray, ceiling: np.ndarray, order: int = 2, smooth: float = 0.0, guidance: np.ndarray | None = None) -> np.ndarray:
    """A surface under its samples: known cells (z, and the ceiling there) hold the lower of both and the others are
    solved for; after smoothing the known cells are put under their ceilings again, the others solved anew, and the
    known ones kept there."""
    known = ~np.isnan(z)
    s = solve(np.where(known, np.fmin(z, ceiling), np.nan), order, guidance)
    if smooth > 0:
        s = blurred(s, smooth)
    held = np.where(known, np.fmin(s, ceiling), np.nan)
    return solve(held, order, guidance)


def label(mask: np.ndarray) -> np.ndarray:
    """4-connected components of a mask, numbered from 1 in reading order: each cell takes the least number of its
    neighbours' components until none changes, by whole rows and columns at once."""
    h, w = mask.shape
    out = np.where(mask, np.arange(h * w).reshape(h, w), h * w)
    wall = ~mask
    while True:
        was = out.copy()
        for turned, blocked in ((out, wall), (out.T, wall.T)):
            # the least number of every run between walls
            run = np.cumsum(blocked, axis=1) + np.arange(blocked.shape[0])[:, None] * (blocked.shape[1] + 1)
            least = np.full(int(run.max()) + 1 if run.size else 1, h * w)
            np.minimum.at(least, run[~blocked], turned[~blocked])
            turned[~blocked] = least[run[~blocked]]
        if (out == was).all():
            break
    _, number = np.unique(out[mask], return_inverse=True)
    found = np.zeros(mask.shape, np.int64)
    found[mask] = number + 1
    return found


def cut_out(image: np.ndarray, near: float, border: int = 4) -> np.ndarray:
    """Alpha (0 or 255) of an image whose backdrop is the median colour of its border: what is similar to it and
    connected with the border is clear."""
    edge = np.concatenate([image[:border].reshape(-1, 3), image[-border:].reshape(-1, 3), image[:, :border].reshape(-1, 3), image[:, -border:].reshape(-1, 3)])
    like = np.sqrt(((image.astype(float) - np.median(edge, axis=0)) ** 2).sum(2)) <= near
    parts = label(like)
    outer = set(np.concatenate([parts[0], parts[-1], parts[:, 0], parts[:, -1]]).tolist()) - {0}
    return np.where(np.isin(parts, list(outer)), 0, 255).astype(np.uint8)


def raster(ring: np.ndarray, width: int, height: int, samples: int = 4) -> np.ndarray:
    """Coverage (0 to 1) of pixels by a ring in pixel units, by supersampling."""
    s = (np.arange(width * samples) + 0.5) / samples, (np.arange(height * samples) + 0.5) / samples
    x, y = np.meshgrid(*s)
    inside = contains(ring, np.stack([x.ravel(), y.ravel()], axis=1)).reshape(height * samples, width * samples)
    return inside.reshape(height, samples, width, samples).mean(axis=(1, 3))


def periodic_noise(width: int, height: int, seed: int, power: float = 1.5) -> np.ndarray:
    """Noise in [0, 1] that repeats without a seam: white noise with its spectrum tilted."""
    f = np.fft.rfft2(np.random.default_rng(seed).standard_normal((height, width)))
    k = np.hypot(np.fft.fftfreq(height)[:, None] * height, np.fft.rfftfreq(width)[None] * width)
    k[0, 0] = 1.0
    out = np.fft.irfft2(f / k**power, s=(height, width))
    low, high = out.min(), out.max()
    return (out - low) / max(high - low, 1e-12)

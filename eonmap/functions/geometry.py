"""Geometry: simple measures as Columns, and rings, polygons, overlay and projection in numpy.

Coordinates are ``(x, y)`` pairs; a ring is an array of shape (n, 2) without its closing point; a
polygon is a list of rings, the outer one first; a geometry is a list of polygons.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Ring = np.ndarray
Geometry = list[list[Ring]]
#: The WGS84 ellipsoid, the standard parallel of the equal-area projection in degrees,
#: the land area of the earth in km², and the first id of made-up ways.
A, INVERSE_F, PARALLEL, LAND_KM2, FIRST_SYNTHETIC = 6378137.0, 298.257223563, 30.0, 149e6, 10**15


# ------------------------------------------------------------- Column measures
def shoelace(ring: Column) -> Column:
    """Twice the signed area of array<struct<x,y>>; 0 for fewer than three points."""
    n = F.size(ring)

    def term(p: Column, i: Column) -> Column:
        q = F.get(ring, F.when(i + 1 < n, i + 1).otherwise(0))
        return p["x"] * q["y"] - q["x"] * p["y"]

    return F.when(n >= 3, F.aggregate(F.transform(ring, term), F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)


def perimeter(ring: Column) -> Column:
    """Length of a closed ring in its own units."""
    n = F.size(ring)

    def side(p: Column, i: Column) -> Column:
        q = F.get(ring, F.when(i + 1 < n, i + 1).otherwise(0))
        return F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))

    return F.when(n > 0, F.aggregate(F.transform(ring, side), F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)


# ------------------------------------------------------------- equal-area projection
_F = 1 / INVERSE_F
_E2 = _F * (2 - _F)
_E = math.sqrt(_E2)
_K0 = math.cos(math.radians(PARALLEL)) / math.sqrt(1 - _E2 * math.sin(math.radians(PARALLEL)) ** 2)


def equal_area(ring: Ring) -> Ring:
    """Longitude and latitude in degrees to metres of the cylindrical equal-area projection."""
    s = np.sin(np.radians(ring[:, 1]))
    q = (1 - _E2) * (s / (1 - _E2 * s * s) - np.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))
    return np.stack([A * _K0 * np.radians(ring[:, 0]), A * q / (2 * _K0)], axis=1)


def signed_area2(ring: Ring) -> float:
    """Twice the signed area; 0 for fewer than three points."""
    if len(ring) < 3:
        return 0.0
    x, y = ring[:, 0], ring[:, 1]
    return float(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y))


def area_km2(geom: Geometry) -> float:
    """Area on the ellipsoid: outer rings less their holes."""
    total = 0.0
    for rings in geom:
        sizes = [abs(signed_area2(equal_area(r))) / 2e6 for r in rings]
        total += sizes[0] - sum(sizes[1:]) if sizes else 0.0
    return total


# ------------------------------------------------------------- rings from ways
@dataclass(frozen=True)
class Warn:
    """kind: open_ring (a, b: end nodes), uncontained_inner (a: way), missing_way (a: way)."""

    kind: str
    a: int
    b: int = 0


def ring_points(ring: Sequence[int], coords: dict[int, np.ndarray]) -> Ring:
    """Points of a ring of signed way ids, without the shared ends."""
    parts = []
    for w in ring:
        p = coords.get(abs(w))
        if p is not None and len(p):
            parts.append((p if w > 0 else p[::-1])[:-1])
    return np.concatenate(parts) if parts else np.zeros((0, 2))


def assemble_rings(way_ids: Iterable[int], nodes: dict[int, Sequence[int]], coords: dict[int, np.ndarray],
                   leave_open: bool = False) -> tuple[list[list[int]], list[Warn]]:
    """Rings of signed way ids, counter-clockwise; a negative id is read backwards.

    Closed ways are rings. The others are joined where ends meet, from the least id on. Chains that
    stay open are closed by a straight made-up way (added to ``nodes`` and ``coords``), unless
    ``leave_open``; both cases are warned of.
    """
    warns, rings = [], []
    ends: dict[int, set[int]] = defaultdict(set)
    open_ways = []
    for w in dict.fromkeys(way_ids):
        ref = nodes.get(w)
        if not ref:
            warns.append(Warn("missing_way", w))
        elif ref[0] == ref[-1]:
            rings.append([w])
        else:
            open_ways.append(w)
            ends[ref[0]].add(w)
            ends[ref[-1]].add(w)
    left = set(open_ways)
    synthetic = FIRST_SYNTHETIC
    for seed in sorted(open_ways):
        if seed not in left:
            continue
        left.remove(seed)
        chain, head, tail = [seed], nodes[seed][0], nodes[seed][-1]
        for forward in (True, False):
            while head != tail:
                at = tail if forward else head
                step = min((w for w in ends[at] if w in left), default=None)
                if step is None:
                    break
                left.remove(step)
                far = nodes[step][-1] if nodes[step][0] == at else nodes[step][0]
                along = (nodes[step][0] == at) == forward
                if forward:
                    chain.append(step if along else -step)
                    tail = far
                else:
                    chain.insert(0, step if along else -step)
                    head = far
        if head != tail:
            warns.append(Warn("open_ring", head, tail))
            if not leave_open:
                first, last = chain[0], chain[-1]
                p = coords[abs(last)][-1 if last > 0 else 0]
                q = coords[abs(first)][0 if first > 0 else -1]
                while synthetic in nodes:
                    synthetic += 1
                nodes[synthetic], coords[synthetic] = [tail, head], np.array([p, q])
                chain.append(synthetic)
        rings.append(chain)
    return [r if signed_area2(ring_points(r, coords)) >= 0 else [-w for w in reversed(r)] for r in rings], warns


def point_in_ring(p: Sequence[float], ring: Ring) -> bool:
    """Even-odd rule."""
    if len(ring) < 3:
        return False
    x, y = ring[:, 0], ring[:, 1]
    x2, y2 = np.roll(x, -1), np.roll(y, -1)
    span = (y > p[1]) != (y2 > p[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        at = x + (p[1] - y) * (x2 - x) / (y2 - y)
    return bool(np.count_nonzero(span & (p[0] < at)) % 2)


def assemble_polygons(outer: Sequence[int], inner: Sequence[int], nodes: dict[int, Sequence[int]], coords: dict[int, np.ndarray],
                      leave_open: bool = False) -> tuple[list[list[list[int]]], list[Warn]]:
    """Polygons of rings: each hole, clockwise, goes to the smallest outer ring that contains its first point."""
    outers, warns = assemble_rings(outer, nodes, coords, leave_open)
    holes, more = assemble_rings(inner, nodes, coords, leave_open)
    out = [[r] for r in outers]
    pts = [ring_points(r, coords) for r in outers]
    sizes = [abs(signed_area2(p)) for p in pts]
    for h in holes:
        hp = ring_points(h, coords)
        inside = [i for i, p in enumerate(pts) if len(hp) and point_in_ring(hp[0], p)]
        if inside:
            out[min(inside, key=lambda i: sizes[i])].append([-w for w in reversed(h)])
        elif abs(h[0]) < FIRST_SYNTHETIC:
            more.append(Warn("uncontained_inner", abs(h[0])))
    return out, warns + more


def polygon_points(polygons: list[list[list[int]]], coords: dict[int, np.ndarray]) -> Geometry:
    """Coordinates of polygons; rings of fewer than three points go, and polygons without an outer ring."""
    out = []
    for rings in polygons:
        pts = [ring_points(r, coords) for r in rings]
        if pts and len(pts[0]) >= 3:
            out.append([pts[0], *[p for p in pts[1:] if len(p) >= 3]])
    return out


# ------------------------------------------------------------- simplification
def simplify_line(points: np.ndarray, tolerance: float) -> list[int]:
    """Indices that Douglas-Peucker keeps: both ends, and points farther than ``tolerance`` from their chord."""
    n = len(points)
    if n < 3:
        return list(range(n))
    keep = np.zeros(n, bool)
    keep[[0, -1]] = True
    stack = [(0, n - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        p, d = points[a + 1:b] - points[a], points[b] - points[a]
        length = float(d @ d)
        t = np.clip(p @ d / length, 0, 1) if length else np.zeros(len(p))
        off = p - t[:, None] * d
        far = (off * off).sum(axis=1)
        i = int(far.argmax())
        if far[i] > tolerance * tolerance:
            keep[a + 1 + i] = True
            stack += [(a, a + 1 + i), (a + 1 + i, b)]
    return np.flatnonzero(keep).tolist()


def simplify_ring(points: np.ndarray, tolerance: float, least: int = 2) -> list[int]:
    """Indices that Visvalingam-Whyatt keeps of a line, or of a ring (first point = last), which stays closed.

    The point with the smallest triangle goes first, as long as its area is no more than
    ``tolerance`` and more than ``least`` points are left. A line keeps both its ends.
    """
    if len(points) < 3:
        return list(range(len(points)))
    closed = bool(np.all(points[0] == points[-1]))
    n = len(points) - closed
    before, after, alive = [i - 1 for i in range(n)], [i + 1 for i in range(n)], [True] * n
    if closed:
        before[0], after[-1] = n - 1, 0

    def size(i: int) -> float:
        (x0, y0), (x1, y1), (x2, y2) = points[before[i]], points[i], points[after[i]]
        return abs((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)) / 2

    inner = range(n) if closed else range(1, n - 1)
    heap = [(size(i), i) for i in inner]
    heapq.heapify(heap)
    current, left = dict((i, s) for s, i in heap), n
    while heap and left > least and heap[0][0] <= tolerance:
        s, i = heapq.heappop(heap)
        if not alive[i] or current[i] != s:
            continue
        alive[i], left = False, left - 1
        a, b = before[i], after[i]
        after[a], before[b] = b, a
        for j in {a, b} & current.keys():
            current[j] = max(size(j), s)  # no less than what went before
            heapq.heappush(heap, (current[j], j))
    kept = [i for i in range(n) if alive[i]]
    return [*kept, n if kept[0] == 0 else kept[0]] if closed else kept


def crosses(p: Sequence[float], q: Sequence[float], u: Sequence[float], v: Sequence[float]) -> bool:
    """Whether two edges cross properly: each has the other's ends on different sides."""
    def side(a: Sequence[float], b: Sequence[float], c: Sequence[float]) -> float:
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    return side(p, q, u) * side(p, q, v) < 0 and side(u, v, p) * side(u, v, q) < 0


# ------------------------------------------------------------- atlas projection
#: Canvas of the atlas in pixels, its central meridian, and its equator's offset.
CANVAS_X, CANVAS_Y, CENTRE_LON, EQUATOR_PX = 54001.0, 32400.0, 11.0, 22.0


def winkel(lam: np.ndarray, phi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winkel Tripel: the mean of the Aitoff and the plate carrée projection whose parallel is acos(2/pi); radians."""
    alpha = np.arccos(np.clip(np.cos(phi) * np.cos(lam / 2), -1, 1))
    s = np.where(alpha == 0, 1.0, alpha / np.where(alpha == 0, 1.0, np.sin(alpha)))
    return (2 * np.cos(phi) * np.sin(lam / 2) * s + lam * 2 / np.pi) / 2, (np.sin(phi) * s + phi) / 2


def winkel_inverse(x: np.ndarray, y: np.ndarray, steps: int = 25, close: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Newton's method for all points at once, with differences for the derivatives."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    lam, phi, h = x.copy(), y.copy(), 1e-6
    for _ in range(steps):
        fx, fy = winkel(lam, phi)
        ax, ay = winkel(lam + h, phi)
        bx, by = winkel(lam, phi + h)
        a, c, b, d = (ax - fx) / h, (ay - fy) / h, (bx - fx) / h, (by - fy) / h
        det = a * d - b * c
        det = np.where(det == 0, 1e-12, det)
        rx, ry = fx - x, fy - y
        dl, dp = (d * rx - b * ry) / det, (a * ry - c * rx) / det
        lam, phi = lam - dl, phi - dp
        if np.all((np.abs(dl) <= close) & (np.abs(dp) <= close)):
            break
    return lam, phi


def wrap(lon: np.ndarray) -> np.ndarray:
    return (lon + 180.0) % 360.0 - 180.0


@dataclass
class Mesh:
    """Corrections in degrees at whole degrees from (lon0, lat0) on; zero outside."""

    dlon: np.ndarray
    dlat: np.ndarray
    lon0: int = -180
    lat0: int = -90

    def at(self, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bilinear in the four corners around."""
        i, j = np.floor(lat).astype(int) - self.lat0, np.floor(lon).astype(int) - self.lon0
        good = (i >= 0) & (j >= 0) & (i + 1 < self.dlon.shape[0]) & (j + 1 < self.dlon.shape[1])
        i, j = np.where(good, i, 0), np.where(good, j, 0)
        u, v = lat - np.floor(lat), lon - np.floor(lon)
        out = []
        for g in (self.dlon, self.dlat):
            value = g[i, j] * (1 - u) * (1 - v) + g[i, j + 1] * (1 - u) * v + g[i + 1, j] * u * (1 - v) + g[i + 1, j + 1] * u * v
            out.append(np.where(good, value, 0.0))
        return out[0], out[1]


def canvas_to_lonlat(points: np.ndarray, mesh: Mesh | None = None) -> np.ndarray:
    """Pixels of the atlas to degrees."""
    top_x, top_y = (np.pi + 2) / 2, np.pi / 2
    lam, phi = winkel_inverse((2 * points[:, 0] / CANVAS_X - 1) * top_x, (2 * (points[:, 1] - EQUATOR_PX) / CANVAS_Y - 1) * top_y)
    lon, lat = wrap(np.degrees(lam) + CENTRE_LON), -np.degrees(phi)
    if mesh is not None:
        dlon, dlat = mesh.at(lon, lat)
        lon, lat = wrap(lon + dlon), lat + dlat
    return np.stack([lon, lat], axis=1)


def unwrap(ring: Ring) -> Ring:
    """Longitudes without jumps over the date line."""
    if len(ring) < 2:
        return ring
    step = np.diff(ring[:, 0])
    turn = np.cumsum(np.where(step > 180, -360.0, np.where(step < -180, 360.0, 0.0)))
    return np.stack([ring[:, 0] + np.r_[0.0, turn], ring[:, 1]], axis=1)


_PATH = re.compile(r"[A-Za-z]|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")


def parse_path(d: str) -> list[np.ndarray]:
    """Rings of an SVG path of moves, lines and smooth curves (of which the end points count)."""
    tokens = _PATH.findall(d or "")
    rings: list[list[tuple[float, float]]] = []
    at, i, command = (0.0, 0.0), 0, ""
    own: list[tuple[float, float]] = []
    take: dict[str, int] = {"M": 2, "L": 2, "S": 4, "C": 6}
    while i < len(tokens):
        if tokens[i].isalpha():
            command = tokens[i]
            i += 1
            if command in "zZ":
                if own:
                    rings.append(own)
                own = []
            continue
        n = take.get(command.upper())
        if n is None or i + n > len(tokens):
            i += 1
            continue
        x, y = float(tokens[i + n - 2]), float(tokens[i + n - 1])
        i += n
        at = (at[0] + x, at[1] + y) if command.islower() else (x, y)
        if command in "mM":
            if own:
                rings.append(own)
            own = []
            command = "l" if command == "m" else "L"
        own.append(at)
    if own:
        rings.append(own)
    return [np.array(r) for r in rings]


def ellipse_path(cx: float, cy: float, rx: float, ry: float, sides: int = 64) -> str:
    angles = [2 * math.pi * i / sides for i in range(sides)]
    points = [f"{cx + rx * math.cos(t):.2f},{cy + ry * math.sin(t):.2f}" for t in angles]
    return f"M{points[0]} L{' '.join(points[1:])} Z"


def rounded_vertices(rings: Sequence[Ring], tolerance: float = 0.01) -> tuple[tuple[tuple[float, float], ...], float]:
    """The sorted set of vertices, rounded by the perimeter's size, and the perimeter: a key for equal shapes."""
    length = sum(float(np.hypot(*(np.roll(r, -1, axis=0) - r).T).sum()) for r in rings if len(r))
    digits = max(3, math.ceil(-math.log10(length * tolerance))) if length > 0 else 6
    return tuple(sorted({(round(float(x), digits), round(float(y), digits)) for r in rings for x, y in r})), length


def clip_convex(ring: Ring, window: Ring) -> Ring:
    """Part of a ring inside a convex ring (counter-clockwise), by cutting at each side in turn."""
    out = ring
    for p, q in zip(window, np.roll(window, -1, axis=0), strict=True):
        if not len(out):
            break
        side = (q - p)[0] * (out - p)[:, 1] - (q - p)[1] * (out - p)[:, 0]
        nxt, s2 = np.roll(out, -1, axis=0), np.roll(side, -1)
        made = []
        for a, b, sa, sb in zip(out, nxt, side, s2, strict=True):
            if sa >= 0:
                made.append(a)
            if sa * sb < 0:
                made.append(a + (b - a) * sa / (sa - sb))
        out = np.array(made).reshape(-1, 2)
    return out


def mapped(geom: Geometry, f: Callable[[Ring], Ring]) -> Geometry:
    return [[f(r) for r in rings] for rings in geom]


def without_holes(geom: Geometry) -> Geometry:
    return [rings[:1] for rings in geom]

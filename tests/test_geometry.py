import math
import random

import numpy as np

from eonmap.functions import arrangement as P
from eonmap.functions import geometry as G


def box(x, y, w, h):
    return np.array([[x, y], [x + w, y], [x + w, y + h], [x, y + h]], float)


GLOBE = [[box(-180, -90, 360, 180)]]


def test_globe_and_box():
    assert abs(G.area_km2(GLOBE) - 510_065_621.7) < 1
    assert G.signed_area2(box(0, 0, 1, 1)) == 2 and G.signed_area2(np.array([[0, 0], [1, 1]])) == 0


def test_rings_from_open_ways():
    square = {1: [10, 11], 2: [11, 12], 3: [13, 12], 4: [13, 10]}
    xy = {10: (0, 0), 11: (1, 0), 12: (1, 1), 13: (0, 1)}
    coords = {w: np.array([xy[n] for n in ns], float) for w, ns in square.items()}
    rings, warns = G.assemble_rings([4, 3, 2, 1], dict(square), dict(coords))
    assert rings == [[1, 2, -3, 4]] and not warns
    rings, warns = G.assemble_rings([1, 2, 99], dict(square), dict(coords))
    assert [w.kind for w in warns] == ["missing_way", "open_ring"] and len(rings[0]) == 3
    rings, _ = G.assemble_rings([1, 2], dict(square), dict(coords), leave_open=True)
    assert sorted(map(abs, rings[0])) == [1, 2]


def test_clockwise_way_is_turned():
    nodes, coords = {7: [1, 2, 3, 4, 1]}, {7: np.array([(0, 0), (0, 1), (1, 1), (1, 0), (0, 0)], float)}
    assert G.assemble_rings([7], nodes, coords)[0] == [[-7]]


def test_hole_goes_to_smallest_shell():
    def closed(b):
        return np.concatenate([b, b[:1]])

    nodes = {i: [10 * i, 10 * i + 1, 10 * i + 2, 10 * i + 3, 10 * i] for i in (1, 2, 3, 4)}
    coords = {1: closed(box(0, 0, 10, 10)), 2: closed(box(1, 1, 6, 6)), 3: closed(box(2, 2, 1, 1)), 4: closed(box(50, 50, 1, 1))}
    polygons, warns = G.assemble_polygons([1, 2], [3, 4], nodes, coords)
    assert polygons == [[[1]], [[2], [-3]]] and warns == [G.Warn("uncontained_inner", 4)]
    geom = G.polygon_points(polygons, coords)
    assert len(geom) == 2 and G.signed_area2(geom[1][1]) < 0


def test_simplify():
    line = np.array([(0, 0), (1, 0), (2, 0), (3, 5), (4, 0)], float)
    assert G.simplify_line(line, 0.5) == [0, 2, 3, 4] and G.simplify_line(line, 100) == [0, 4]
    ring = np.array([(0, 0), (1, 0), (2, 0), (2, 2), (0, 2), (0, 0)], float)
    kept = G.simplify_ring(ring, 0.5)
    assert np.array_equal(ring[kept[0]], ring[kept[-1]]) and 1 not in kept and len(kept) == 5
    assert len(G.simplify_ring(ring, 1e9)) == 3
    points = lambda *xy: np.array(xy, float)
    assert G.simplify_ring(points((0, 0), (5, 0), (10, 0)), 0.0) == [0, 2] and G.simplify_ring(points((0, 0), (5, 10), (10, 0)), 1.0) == [0, 1, 2]
    assert G.simplify_ring(points((0, 0), (5, 1), (10, 0)), 10.0) == [0, 2] and G.simplify_ring(points((0, 0), (5, 1), (10, 0)), 4.9) == [0, 1, 2]
    flat = G.simplify_ring(points((0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (0, 0)), 1.0)
    assert len(flat) == 3 and flat[0] != flat[1]
    assert [len(G.simplify_ring(points(*[(0, 0)] * n), 1.0)) for n in (1, 2)] == [1, 2] and G.simplify_ring(np.zeros((0, 2)), 1.0) == []


def test_nothing_is_valid_and_crosses_nothing():
    assert P.why_invalid([]) is None and P.overlay_km2([], []) == (0.0, 0.0, 0.0, 0) and P.union_km2([]) == 0.0


def test_overlay_of_boxes():
    a, b = [[box(0, 0, 4, 4)]], [[box(2, 2, 4, 4)]]
    one = G.area_km2([[box(2, 2, 2, 2)]])
    inter, union, diff, _ = P.overlay_km2(a, b)
    assert math.isclose(inter, one, rel_tol=1e-6)
    assert math.isclose(union, G.area_km2(a) + G.area_km2(b) - one, rel_tol=1e-6) and math.isclose(diff, G.area_km2(a) - one, rel_tol=1e-6)


def test_overlay_of_neighbours_and_copies():
    a, b = [[box(0, 0, 2, 2)]], [[box(2, 0, 2, 2)]]
    inter, union, *_ = P.overlay_km2(a, b)
    assert abs(inter) < 1e-3 and math.isclose(union, G.area_km2([[box(0, 0, 4, 2)]]), rel_tol=1e-6)
    inter, union, diff, _ = P.overlay_km2(a, a)
    assert math.isclose(inter, G.area_km2(a), rel_tol=1e-6) and math.isclose(union, inter, rel_tol=1e-9) and abs(diff) < 1e-3


def test_overlay_with_hole():
    ring = [[box(0, 0, 6, 6), box(2, 2, 2, 2)[::-1]]]
    inter, *_ = P.overlay_km2(ring, [[box(1, 1, 4, 4)]])
    assert math.isclose(inter, G.area_km2([[box(1, 1, 4, 4), box(2, 2, 2, 2)]]), rel_tol=1e-6)


def test_overlay_against_sampling():
    rng = random.Random(2)
    for _ in range(5):
        def star():
            c = np.array([rng.uniform(-1, 1), rng.uniform(-1, 1)])
            t = np.sort([rng.uniform(0, 2 * math.pi) for _ in range(9)])
            return [[c + np.stack([np.cos(t), np.sin(t)], axis=1) * np.array([[rng.uniform(1, 2)] for _ in t])]]

        a, b = star(), star()
        inter, union, diff, _ = P.overlay_km2(a, b)
        pts = np.random.default_rng(1).uniform(-4, 4, (20_000, 2))
        ia, ib = (np.array([G.point_in_ring(p, g[0][0]) for p in pts]) for g in (a, b))
        cell = G.area_km2([[box(-4, -4, 8, 8)]]) / len(pts)
        for got, mask in ((inter, ia & ib), (union, ia | ib), (diff, ia & ~ib)):
            assert abs(got - mask.sum() * cell) < 0.03 * G.area_km2([[box(0, 0, 4, 4)]])
    assert math.isclose(P.union_km2([a, b, a]), union, rel_tol=1e-6)


def test_validity():
    bow = np.array([(0, 0), (2, 2), (2, 0), (0, 2)], float)
    assert P.why_invalid([[bow]]) == "Self-intersection" and P.why_invalid([[box(0, 0, 1, 1)]]) is None
    assert P.why_invalid([[box(0, 0, 9, 9)], [box(2, 2, 1, 1)]]) == "Nested shells"
    touch = np.array([(0, 0), (2, 0), (1, 1), (2, 2), (0, 2), (1, 1)], float)
    assert P.why_invalid([[touch]]) == "Ring Self-intersection"


def test_edges_cross_properly():
    assert G.crosses((0, 0), (2, 2), (0, 2), (2, 0))
    for u, v in (((2, 2), (4, 0)), ((1, 1), (4, 0)), ((0, 1), (1, 2)), ((1, 1), (3, 3))):  # end on end, end on edge, apart, along
        assert not G.crosses((0, 0), (2, 2), u, v)


def test_projection_round_trip():
    lam, phi = np.radians(np.array([0.0, 30, -120, 170])), np.radians(np.array([0.0, 45, -60, 80]))
    x, y = G.winkel(lam, phi)
    l2, p2 = G.winkel_inverse(x, y)
    assert np.allclose(l2, lam, atol=1e-5) and np.allclose(p2, phi, atol=1e-5)
    centre = G.canvas_to_lonlat(np.array([[G.CANVAS_X / 2, G.CANVAS_Y / 2 + G.EQUATOR_PX]]))
    assert np.allclose(centre, [[11, 0]], atol=1e-6)


def test_paths():
    rings = G.parse_path("m0,0 10,0 0,10z M 5 5 L 6,5 S 0,0 6,6 Z")
    assert [r.tolist() for r in rings] == [[[0, 0], [10, 0], [10, 10]], [[5, 5], [6, 5], [6, 6]]]
    assert len(G.parse_path(G.ellipse_path(0, 0, 2, 1))[0]) == 64


def test_unwrap_clip_key():
    r = G.unwrap(np.array([(170, 0), (-170, 0), (-170, 5)], float))
    assert r[:, 0].tolist() == [170, 190, 190]
    assert abs(G.signed_area2(G.clip_convex(box(0, 0, 4, 4), box(1, 1, 9, 1)))) == 6
    a, b = G.rounded_vertices([box(0, 0, 1, 1)]), G.rounded_vertices([box(0, 0, 1, 1)[::-1] + 1e-9])
    assert a[0] == b[0]

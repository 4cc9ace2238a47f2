"""Points near points and in regions, against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.functions.geometry import parse_polygon, point_xy, triangulate
from gridloom.operators import proximity as px
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("POINT (1.5 -2)", (1.5, -2.0)), ("SRID=3857;POINT(1e3 2E-1)", (1000.0, 0.2)), ("point ( 1.000  2.0 )", (1.0, 2.0)), (" POINT\t(1\t2)", (1.0, 2.0)), ("POINT Z (1 2 3)", (1.0, 2.0)),
        ('{"type": "Point", "coordinates": [1, 2.5]}', (1.0, 2.5)), ('{"coordinates":[1,2,9],"type":"Point"}', (1.0, 2.0)), ("POINT (1 2", (1.0, 2.0)),
        ("POINT (1)", (None, None)), ("POINT EMPTY", (None, None)), ("POINT(None None)", (None, None)), ("POINT (nan nan)", (None, None)), ("POINT (1 1e999)", (None, None)), ("", (None, None)), (None, (None, None)),
    ],
)
def test_point_notations(spark, text, want):
    x, y = point_xy(F.col("g"))
    assert tuple(spark.createDataFrame([(text,)], "g string").select(x, y).first()) == want


def even_odd(x, y, piece):
    odd = np.zeros(len(x), dtype=bool)
    for ring in piece:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if y1 != y2:
                odd ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return odd


def star(rng, n, cx=0.0, cy=0.0, scale=1.0):
    angles = np.sort(rng.uniform(0, 2 * np.pi, n))
    radius = rng.uniform(0.3, 1, n) * scale
    return list(zip((cx + radius * np.cos(angles)).tolist(), (cy + radius * np.sin(angles)).tolist()))


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(4, 30), st.booleans())
def test_triangles_cover_the_polygon(seed, n, hole):
    rng = np.random.default_rng(seed)
    ring = star(rng, n)
    piece = [ring if seed % 2 else ring[::-1]]
    if hole:
        piece.append([(-0.05, -0.05), (0.05, -0.05), (0.0, 0.06)][:: 1 if seed % 3 else -1])
    x, y = rng.uniform(-1, 1, (2, 500))
    tree = px.TriangleTree(np.array(triangulate(piece)).reshape(-1, 6))
    got = np.zeros(500, dtype=bool)
    got[tree.hits(x, y)[0]] = True
    if not hole or even_odd(*np.array(piece[1]).T, [ring]).all():
        assert (got == even_odd(x, y, piece)).all()


def test_crossing_ring_and_degenerate_rings():
    bow = [[(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0)]]
    area = sum(abs((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])) / 2 for a, b, c in triangulate(bow))
    assert abs(area - 2) < 1e-9
    assert triangulate([[(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]]) == []
    for text in (None, "", "POLYGON EMPTY", "POLYGON ((1 1, 2 2", "POLYGON ((1 1, 2 2))", "{broken", '{"type": "Polygon"}'):
        assert parse_polygon(text) == []
    two = parse_polygon("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5), (5.5 5.2, 5.8 5.2, 5.8 5.3, 5.5 5.2)))")
    assert [len(p) for p in two] == [1, 2]


def points(spark, rows):
    return spark.createDataFrame(rows, "id long, x double, y double")


def test_near_pairs_like_brute_force(spark):
    rng = np.random.default_rng(5)
    xy = np.r_[rng.uniform(-300, 300, (150, 2)), rng.normal(100, 5, (40, 2)), [[100.0, 100.0]] * 3, [[0.0, 0.0], [25.0, 0.0], [0.0, 25.0], [-15.0, -20.0]]]
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(xy)]
    got = {tuple(r) for r in px.near_pairs(points(spark, rows), 25.0).collect()}
    want = {(i, j) for i in range(len(xy)) for j in range(i + 1, len(xy)) if ((xy[i] - xy[j]) ** 2).sum() <= 625}
    assert got == want
    assert px.near_pairs(points(spark, []), 25.0).count() == 0


def test_near_pairs_across_a_cell_border(spark):
    """Partners on a border at just the distance, and a lattice full of them."""
    xy = np.array([(-25.0, 0.0), (0.0, 0.0), (75.0, 0.0), (100.0, 0.0), (0.0, 75.0), (0.0, 100.0), *((1000.0 + 25 * i, 1000.0 + 25 * j) for i in range(9) for j in range(9))])
    got = {tuple(r) for r in px.near_pairs(points(spark, [(i, float(a), float(b)) for i, (a, b) in enumerate(xy)]), 25.0).collect()}
    assert got == {(i, j) for i in range(len(xy)) for j in range(i + 1, len(xy)) if ((xy[i] - xy[j]) ** 2).sum() <= 625}
    assert {(0, 1), (2, 3), (4, 5)} <= got


def test_repeated_and_null_points(spark):
    df = spark.createDataFrame([(1, "POINT (0 0)", 5, 5.0), (1, "POINT(0.0 0)", 6, 5.0), (2, "POINT (0 3)", 7, 5.0), (None, "POINT (0 0)", 8, 5.0), (3, None, 9, 5.0), (4, "POINT (", 9, 5.0)], "point_id long, geometry string, id long, x double")
    read = px.read_points(df, "point_id", "geometry")
    assert {tuple(r) for r in read.collect()} == {(1, 0.0, 0.0), (2, 0.0, 3.0)}
    assert {tuple(r) for r in px.near_pairs(read, 25.0).collect()} == {(1, 2)}


@pytest.mark.parametrize("block", [200_000, 5, 1])
def test_inside_regions(spark, block):
    rng = np.random.default_rng(9)
    pieces = {i: [star(rng, 12, *rng.uniform(-2, 2, 2), 1.5)] for i in range(8)}
    pieces[8] = pieces[3]
    text = lambda p: "POLYGON (" + ", ".join("(" + ", ".join(f"{a!r} {b!r}" for a, b in [*r, r[0]]) + ")" for r in p) + ")"
    polys = spark.createDataFrame([(i, text(p), i) for i, p in pieces.items()] + [(20, None, 1), (21, "POLYGON EMPTY", 1), (None, text(pieces[0]), 1)], "poly_id long, geometry string, ax long")
    x, y = rng.uniform(-3, 3, (2, 300))
    got = {tuple(r) for r in px.inside_regions(points(spark, [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]), px.triangles_of(polys, "poly_id", "geometry"), block).collect()}
    want = {(int(i), k) for k, p in pieces.items() for i in np.flatnonzero(even_odd(x, y, p))}
    assert got == want


def test_no_point_falls_between_triangles(spark):
    square = px.triangles_of(spark.createDataFrame([(1, "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))")], "p long, g string"), "p", "g")
    on_edges = points(spark, [(1, 1.0, 1.0), (2, 0.0, 0.0), (3, 2.0, 1.0), (4, 2.1, 1.0)])
    assert sorted(tuple(r) for r in px.inside_regions(on_edges, square).collect()) == [(1, 1), (2, 1), (3, 1)]
    assert px.inside_regions(on_edges, square.limit(0)).count() == 0
    assert px.inside_regions(on_edges.limit(0), square).count() == 0

"""Reading points and polygons from text, and triangulating polygons."""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUM = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
#: A point in either notation: x and y are groups 1 and 2, or 3 and 4.
_POINT = (
    rf"(?s)^(?:\s*(?i:SRID\s*=\s*[0-9]+\s*;)?\s*(?i:POINT\s*(?:ZM|Z|M)?)\s*\(\s*({_NUM})[\s,]+({_NUM})(?=[\s,)]|$)"
    rf'|[^"]*\{{.*?"coordinates"\s*:\s*\[\s*({_NUM})\s*,\s*({_NUM})\s*[\],]).*$'
)


def point_of(geometry: Column) -> Column:
    """The point written as (E)WKT or as GeoJSON: a struct of x and y, both null if unreadable.

    The first two coordinates count, a third is a height. Missing, empty and
    unfinished texts, a single coordinate and coordinates that are not finite
    give nulls. One pattern reads both notations and both coordinates: it puts
    them between marks, and a text that it does not fit stays without marks.
    """
    marked = F.regexp_replace(geometry, _POINT, "\u0001$1$3\u0001$2$4\u0001")

    def read(parts: Column) -> Column:
        x, y = (F.when(F.size(parts) == 4, F.try_element_at(parts, F.lit(k))).try_cast("double") for k in (2, 3))
        finite = (F.abs(x) < float("inf")) & (F.abs(y) < float("inf"))
        return F.struct(F.when(finite, x).alias("x"), F.when(finite, y).alias("y"))

    # the parts are bound to a variable: the pattern runs once per text
    return F.transform(F.array(F.split(marked, "\u0001", 4)), read)[0]


def point_xy(geometry: Column) -> tuple[Column, Column]:
    """x and y of :func:`point_of`."""
    return point_of(geometry)["x"], point_of(geometry)["y"]


def parse_point(text: str | None) -> tuple[float, float] | None:
    """The point of a text, as :func:`point_of` reads it, None if there is none."""
    m = re.match(_POINT, text) if text else None
    point = (float(m[1] or m[3]), float(m[2] or m[4])) if m else None
    return point if point and all(map(math.isfinite, point)) else None


def _numbers(text: str) -> list[tuple[float, float]]:
    ring = []
    for pair in text.split(","):
        parts = re.findall(_NUM, pair)
        if len(parts) < 2:
            raise ValueError("a vertex without two coordinates")
        ring.append((float(parts[0]), float(parts[1])))
    return ring


def parse_polygon(text: str | None) -> list[list[list[tuple[float, float]]]]:
    """Pieces of a (multi)polygon, each a list of rings, the first its outline.

    Reads (E)WKT and GeoJSON. Null, empty or unreadable texts give no piece;
    coordinates beyond the second are dropped; a ring is returned without its
    repeated last vertex, and rings of fewer than three vertices are left out.
    """
    if not text or not text.strip():
        return []
    try:
        if "{" in text:
            got = json.loads(text)
            parts = got["coordinates"] if got["type"] == "MultiPolygon" else [got["coordinates"]]
            pieces = [[[(float(v[0]), float(v[1])) for v in ring] for ring in piece] for piece in parts]
        else:
            body = re.sub(r"(?i)^\s*(SRID\s*=\s*\d+\s*;)?\s*", "", text)
            kind = re.match(r"(?i)(MULTI)?POLYGON\s*(ZM|Z|M)?\s*(?=\()", body)
            if not kind or body.count("(") != body.count(")"):
                return []
            body = body[kind.end() :]
            groups = re.findall(r"\(\s*(\([^()]*\)(?:\s*,\s*\([^()]*\))*)\s*\)", body)
            pieces = [[_numbers(r) for r in re.findall(r"\(([^()]*)\)", g)] for g in groups]
    except (ValueError, KeyError, TypeError, IndexError):
        return []
    out = []
    for piece in pieces:
        rings = []
        for ring in piece:
            ring = [v for i, v in enumerate(ring) if i == 0 or v != ring[i - 1]]
            if len(ring) > 1 and ring[0] == ring[-1]:
                ring = ring[:-1]
            if len(ring) >= 3 and all(math.isfinite(c) for v in ring for c in v):
                rings.append(ring)
            elif not rings:
                break  # no outline: nothing of this piece is usable
        if rings:
            out.append(rings)
    return out


def ring_area(ring) -> float:
    """Area of a ring, negative if it runs with the clock."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def _turn(a, b, c) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _crosses(a, b, c, d) -> bool:
    """Do the open segments ab and cd cross or touch (shared ends do not count)?"""
    if {a, b} & {c, d}:
        return False
    t1, t2, t3, t4 = _turn(a, b, c), _turn(a, b, d), _turn(c, d, a), _turn(c, d, b)
    return (t1 <= 0 <= t2 or t2 <= 0 <= t1) and (t3 <= 0 <= t4 or t4 <= 0 <= t3) and not t1 == t2 == t3 == t4 == 0


def _join_hole(outer, hole, others):
    """One ring: the outline with a bridge to the hole, by its nearest free pair."""
    pairs = sorted(((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2, i, j) for i, p in enumerate(outer) for j, q in enumerate(hole))
    edges = [e for r in (outer, hole, *others) for e in zip(r, r[1:] + r[:1])]
    for _, i, j in pairs:
        if not any(_crosses(outer[i], hole[j], a, b) for a, b in edges):
            break
    else:
        _, i, j = pairs[0]
    return outer[: i + 1] + hole[j:] + hole[: j + 1] + outer[i:]


def _ears(ring) -> list | None:
    """Triangles of a simple counter-clockwise ring by ear clipping, or None."""
    rest, out = list(ring), []
    while len(rest) > 3:
        n = len(rest)
        for i in range(n):
            a, b, c = rest[i - 1], rest[i], rest[(i + 1) % n]
            t = _turn(a, b, c)
            if t < 0:
                continue
            if t == 0:  # a straight or doubled-back vertex holds no area
                del rest[i]
                break
            if not any(p not in (a, b, c) and _turn(a, b, p) >= 0 and _turn(b, c, p) >= 0 and _turn(c, a, p) >= 0 for p in rest):
                out.append((a, b, c))
                del rest[i]
                break
        else:
            return None
    if len(rest) == 3 and _turn(*rest) > 0:
        out.append(tuple(rest))
    return out


def _slabs(rings) -> list:
    """Even-odd triangles by horizontal slabs, for rings that ears cannot cut."""
    edges = [e for r in rings for e in zip(r, r[1:] + r[:1]) if e[0][1] != e[1][1]]
    levels = {v[1] for r in rings for v in r}
    for i, (a, b) in enumerate(edges):
        for c, d in edges[:i]:
            den = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
            if den and _crosses(a, b, c, d):
                levels.add(a[1] + (b[1] - a[1]) * ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / den)
    ys, out = sorted(levels), []
    for lo, hi in zip(ys, ys[1:]):
        at = lambda e, y: e[0][0] + (e[1][0] - e[0][0]) * (y - e[0][1]) / (e[1][1] - e[0][1])
        cut = sorted((at(e, (lo + hi) / 2), at(e, lo), at(e, hi)) for e in edges if min(e[0][1], e[1][1]) <= lo and max(e[0][1], e[1][1]) >= hi)
        for (_, l0, l1), (_, r0, r1) in zip(cut[::2], cut[1::2]):
            out += [((l0, lo), (r0, lo), (r1, hi)), ((l0, lo), (r1, hi), (l1, hi))]
    return [t for t in out if _turn(*t) > 0]


def triangulate(rings) -> list:
    """Triangles that cover one polygon piece (outline and holes).

    Holes are bridged into the outline, which is then cut by ear clipping. A
    ring that crosses itself has no ears in places; its area, seen by the
    even-odd rule, is cut into horizontal slabs instead. The sum of areas tells.
    """
    outer, *holes = rings
    want = abs(ring_area(outer)) - sum(abs(ring_area(h)) for h in holes)
    ring = outer if ring_area(outer) > 0 else outer[::-1]
    holes = sorted((h if ring_area(h) < 0 else h[::-1] for h in holes), key=lambda h: -max(v[0] for v in h))
    for k, hole in enumerate(holes):
        ring = _join_hole(ring, hole, holes[k + 1 :])
    got = _ears(ring)
    if got is None or abs(sum(_turn(*t) for t in got) / 2 - want) > 1e-6 * max(1.0, abs(want)):
        got = _slabs(rings)
    return got

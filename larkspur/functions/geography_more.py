"""Further geography functions over WKT text: WKB and KML, S2 cells, simplification, distances between shapes."""

from __future__ import annotations

import math
import re
import struct

CODES = {"POINT": 1, "LINESTRING": 2, "POLYGON": 3}


def _helpers():
    from . import python_functions as g

    return g


def as_binary(text: str) -> bytes:
    g = _helpers()
    kind, p = g._kind(text), g._points(text)
    flat = b"".join(struct.pack("<2d", *x) for x in p)
    head = struct.pack("<BI", 1, CODES[kind])
    return head + {"POINT": b"", "LINESTRING": struct.pack("<I", len(p)), "POLYGON": struct.pack("<2I", 1, len(p))}[kind] + flat


def from_binary(data: bytes) -> str:
    g = _helpers()
    data = bytes(data)
    order = "<" if data[0] == 1 else ">"
    kind = {v: k for k, v in CODES.items()}[struct.unpack_from(order + "I", data, 1)[0]]
    at = {"POINT": 5, "LINESTRING": 9, "POLYGON": 13}[kind]
    return g._wkt(kind, [struct.unpack_from(order + "2d", data, i) for i in range(at, len(data) - 15, 16)])


def as_kml(text: str) -> str:
    g = _helpers()
    body = "<coordinates>" + " ".join(f"{g._num(x)},{g._num(y)}" for x, y in g._points(text)) + "</coordinates>"
    kind = g._kind(text)
    return f"<Polygon><outerBoundaryIs><LinearRing>{body}</LinearRing></outerBoundaryIs></Polygon>" if kind == "POLYGON" else f"<{'Point' if kind == 'POINT' else 'LineString'}>{body}</{'Point' if kind == 'POINT' else 'LineString'}>"


def from_kml(text: str) -> str:
    g = _helpers()
    kind = {"point": "POINT", "linestring": "LINESTRING", "polygon": "POLYGON"}[re.search(r"<(\w+)", text)[1].lower()]
    points = re.findall(r"(-?[\d.eE+-]+),(-?[\d.eE+-]+)", re.search(r"<coordinates>(.*?)</coordinates>", text, re.S)[1])
    return g._wkt(kind, [(float(a), float(b)) for a, b in points])


def from_any(value: str) -> str:
    g = _helpers()
    text = value.strip()
    if text.startswith("{"):
        return g.GEO["geogfromgeojson"][0](text)
    if text.startswith("<"):
        return from_kml(text)
    if re.fullmatch(r"[0-9A-Fa-f]+", text):
        return from_binary(bytes.fromhex(text))
    return g._wkt(g._kind(text), g._points(text))


#: Fixed values of the S2 curve: position of (i, j) by orientation, and how a position turns the orientation.
POSITION = ((0, 1, 3, 2), (0, 3, 1, 2), (2, 3, 1, 0), (2, 1, 3, 0))
TURN = (1, 0, 0, 3)


def s2_cell(text: str, level: int = 30) -> int:
    """The id of the S2 cell of a level that holds a point."""
    g = _helpers()
    lon, lat = (math.radians(v) for v in g._points(text)[0])
    p = (math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat))
    axis = max(range(3), key=lambda k: abs(p[k]))
    face = axis + 3 * (p[axis] < 0)
    x, y, z = p
    a, b, d = ((y, z, x), (-x, z, y), (-x, -y, z), (z, y, x), (z, -x, y), (-y, -x, z))[face]
    u, v = a / d, b / d
    i, j = (min((1 << 30) - 1, max(0, math.floor((1 << 30) * (0.5 * math.sqrt(1 + 3 * w) if w >= 0 else 1 - 0.5 * math.sqrt(1 - 3 * w))))) for w in (u, v))
    turn, out = face & 1, 0
    for k in range(29, -1, -1):
        at = POSITION[turn][(i >> k & 1) * 2 + (j >> k & 1)]
        out, turn = out << 2 | at, turn ^ TURN[at]
    leaf = face << 61 | out << 1 | 1
    low = 1 << 2 * (30 - level)
    found = leaf & -low & ((1 << 64) - 1) | low
    return found - (1 << 64) if found >> 63 else found


def simplify(text: str, tolerance: float) -> str:
    """Douglas-Peucker: points nearer than the tolerance (metres) to the chord go."""
    g = _helpers()
    p = g._points(text)
    if len(p) < 3:
        return text
    keep, todo = {0, len(p) - 1}, [(0, len(p) - 1)]
    while todo:
        a, b = todo.pop()
        far, at = max(((g._near_segment(p[i], p[a], p[b]) * g.EARTH, i) for i in range(a + 1, b)), default=(0, 0))
        if far > tolerance:
            keep.add(at)
            todo += [(a, at), (at, b)]
    return g._wkt(g._kind(text), [x for i, x in enumerate(p) if i in keep])


def hausdorff(a: str, b: str) -> float:
    g = _helpers()
    p, q = g._points(a), g._points(b)
    one = lambda r, s: max(min(g._arc(x, y) for y in s) for x in r)
    return max(one(p, q), one(q, p)) * g.EARTH


def closest_point(a: str, b: str) -> str:
    g = _helpers()
    p, q = g._points(a), g._points(b)
    best = min(p, key=lambda x: min(g._arc(x, y) for y in q))
    gap = min(g._arc(best, y) for y in q)
    for s, t in zip(p, p[1:]):
        for y in q:
            if g._near_segment(y, s, t) < gap:
                gap = g._near_segment(y, s, t)
                k = math.cos(math.radians(y[1]))
                dx, dy = (t[0] - s[0]) * k, t[1] - s[1]
                f = max(0, min(1, ((y[0] - s[0]) * k * dx + (y[1] - s[1]) * dy) / (dx * dx + dy * dy)))
                best = (s[0] + f * (t[0] - s[0]), s[1] + f * (t[1] - s[1]))
    return g._wkt("POINT", [best])


def buffer(text: str, radius: float, segments: float = 8) -> str:
    """A polygon of 4 * segments corners around a point."""
    g = _helpers()
    (x, y), n = g._points(text)[0], int(4 * segments)
    lon, lat, d = math.radians(x), math.radians(y), radius / g.EARTH
    ring = []
    for k in range(n + 1):
        a = 2 * math.pi * (k % n) / n
        lat2 = math.asin(math.sin(lat) * math.cos(d) + math.cos(lat) * math.sin(d) * math.cos(a))
        lon2 = lon + math.atan2(math.sin(a) * math.sin(d) * math.cos(lat), math.cos(d) - math.sin(lat) * math.sin(lat2))
        ring.append((math.degrees(lon2), math.degrees(lat2)))
    return g._wkt("POLYGON", ring)


def line_part(text: str, start: float, end: float) -> str:
    g = _helpers()
    p, total, done = g._points(text), 0.0, 0.0
    total = g._line_length(p)
    inside = []
    for a, b in zip(p, p[1:]):
        done += g._arc(a, b) * g.EARTH
        if start < done / total < end:
            inside.append(b)
    first, last = g._points(g._along(text, start))[0], g._points(g._along(text, end))[0]
    return g._wkt("LINESTRING", [first, *inside, last])


def touches(a: str, b: str) -> bool:
    g = _helpers()
    p, q = g._points(a), g._points(b)
    if not g.intersects(a, b):
        return False
    inner = lambda pts, other, kind: kind == "POLYGON" and any(g._inside(x, other) and not g._on(x, other) for x in pts)
    return not inner(p, q, g._kind(b)) and not inner(q, p, g._kind(a))


def boundary(text: str) -> str:
    g = _helpers()
    p, kind = g._points(text), g._kind(text)
    if kind == "POLYGON":
        return g._wkt("LINESTRING", p)
    return g._wkt("MULTIPOINT", [p[0], p[-1]]) if kind == "LINESTRING" and p[0] != p[-1] else "GEOMETRYCOLLECTION EMPTY"


def angle(a: str, b: str, c: str) -> float | None:
    g = _helpers()
    if g._points(a) == g._points(b) or g._points(b) == g._points(c):
        return None
    return (g.azimuth(b, c) - g.azimuth(b, a)) % (2 * math.pi)


def box(text: str) -> list[float]:
    p = _helpers()._points(text)
    return [min(x for x, _ in p), min(y for _, y in p), max(x for x, _ in p), max(y for _, y in p)]


def in_box(text: str, a: float, b: float, c: float, d: float) -> bool:
    x0, y0, x1, y1 = box(text)
    return x0 <= c and x1 >= a and y0 <= d and y1 >= b


def envelope(text: str) -> str:
    a, b, c, d = box(text)
    return _helpers()._wkt("POLYGON", [(a, b), (c, b), (c, d), (a, d), (a, b)])


FUNCTIONS = {
    "asbinary": (as_binary, "binary"), "geogfromwkb": (from_binary, "string"), "askml": (as_kml, "string"), "geogfromkml": (from_kml, "string"), "geogfrom": (from_any, "string"), "simplify": (simplify, "string"), "hausdorffdistance": (hausdorff, "double"), "hausdorffdwithin": (lambda a, b, d: hausdorff(a, b) <= d, "boolean"),
    "closestpoint": (closest_point, "string"), "buffer": (buffer, "string"), "bufferwithtolerance": (lambda g, r, t: buffer(g, r), "string"), "linesubstring": (line_part, "string"), "touches": (touches, "boolean"), "boundary": (boundary, "string"), "angle": (angle, "double"), "intersectsbox": (in_box, "boolean"), "envelope": (envelope, "string"),
    "makepolygonoriented": (lambda a: _helpers()._wkt("POLYGON", _helpers()._points(a[0])), "string"), "interiorrings": (lambda g: [], "array<string>"), "dump": (lambda g: [g], "array<string>"), "geometryn": (lambda g, n: g if n == 1 else None, "string"), "s2cell": (s2_cell, "bigint"),
}

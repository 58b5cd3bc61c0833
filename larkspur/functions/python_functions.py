"""Functions that no Spark expression covers, as Arrow UDFs named lk_..."""

from __future__ import annotations

import base64
import ipaddress
import json
import math
import re
import struct
import unicodedata

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import geography_more, json_edit, keysets

PUBLIC_SUFFIXES = frozenset("com org net edu gov mil int io ai dev app info biz name co de fr es it nl eu uk us ca au jp cn in br ru ch at be pl se no dk fi co.uk org.uk ac.uk gov.uk com.au net.au org.au co.jp ne.jp or.jp ac.jp com.br com.cn co.in co.nz co.za com.mx com.tr com.ar".split())
EARTH = 6371010.0


def _ip(text: str, safe: bool):
    try:
        return ipaddress.ip_address(text).packed
    except ValueError:
        if safe:
            return None
        raise


def _trunc(ip: bytes, length: int) -> bytes:
    keep = (1 << length) - 1 << (len(ip) * 8 - length)
    return (int.from_bytes(ip, "big") & keep).to_bytes(len(ip), "big")


def host(url: str) -> str | None:
    m = re.match(r"\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", url) or re.match(r"\s*([^/?#:]*\.[^/?#:]*)", url)
    if not m:
        return None
    name = m[1].rpartition("@")[2]
    name = name if name.startswith("[") else name.split(":")[0]
    return name.strip() or None


def suffix(url: str) -> str | None:
    parts = (host(url) or "").split(".")
    for i in range(len(parts)):
        if ".".join(parts[i:]).lower() in PUBLIC_SUFFIXES:
            return ".".join(parts[i:])
    return None


def domain(url: str) -> str | None:
    tail = suffix(url)
    if not tail:
        return None
    head = (host(url) or "")[: -len(tail) - 1]
    return f"{head.rpartition('.')[2]}.{tail}" if head else None


def instr(text: str, sub: str, position: int, occurrence: int) -> int:
    if position == 0 or occurrence < 1:
        raise ValueError("INSTR: position and occurrence must not be 0")
    if position > 0:
        at = position - 2
        for _ in range(occurrence):
            at = text.find(sub, at + 1)
            if at < 0:
                return 0
        return at + 1
    at = len(text) + position + len(sub)
    for _ in range(occurrence):
        at = text.rfind(sub, 0, at)
        if at < 0:
            return 0
        result, at = at + 1, at + len(sub) - 1
    return result


def initcap(text: str, marks: str | None) -> str:
    marks = " \t\n\r\f\v[](){}/|<>!?@\"^#$&~_,.:;*%+-" if marks is None else marks
    out, start = [], True
    for c in text:
        out.append(c.upper() if start else c.lower())
        start = c in marks
    return "".join(out)


def split_substr(text: str, mark: str, start: int, count: int) -> str:
    parts = text.split(mark) if mark else [text]
    at = start - 1 if start > 0 else max(len(parts) + start, 0) if start < 0 else 0
    return mark.join(parts[at : at + count])


# FarmHash Fingerprint64, from its published definition

M64 = (1 << 64) - 1
K0, K1, K2 = 0xC3A5C85C97CB3127, 0xB492B66FBE98F273, 0x9AE16A3B2F90404F


def _rot(v: int, n: int) -> int:
    return ((v >> n) | (v << (64 - n))) & M64 if n else v


def _mix(v: int) -> int:
    return v ^ (v >> 47)


def _len16(u: int, v: int, mul: int) -> int:
    a = _mix(((u ^ v) * mul) & M64)
    return (_mix(((v ^ a) * mul) & M64) * mul) & M64


def _f64(s: bytes, at: int) -> int:
    return struct.unpack_from("<Q", s, at)[0]


def _f32(s: bytes, at: int) -> int:
    return struct.unpack_from("<I", s, at)[0]


def _weak(s: bytes, at: int, a: int, b: int) -> tuple[int, int]:
    w, x, y, z = struct.unpack_from("<4Q", s, at)
    a = (a + w) & M64
    b = _rot((b + a + z) & M64, 21)
    c = a
    a = (a + x + y) & M64
    return (a + z) & M64, (b + _rot(a, 44) + c) & M64


def farm_fingerprint(s: bytes) -> int:
    n = len(s)
    mul = (K2 + n * 2) & M64
    if n == 0:
        out = K2
    elif n < 4:
        y, z = s[0] + (s[n >> 1] << 8), n + (s[-1] << 2)
        out = (_mix((y * K2 ^ z * K0) & M64) * K2) & M64
    elif n < 8:
        out = _len16((n + (_f32(s, 0) << 3)) & M64, _f32(s, n - 4), mul)
    elif n <= 16:
        a, b = (_f64(s, 0) + K2) & M64, _f64(s, n - 8)
        out = _len16((_rot(b, 37) * mul + a) & M64, ((_rot(a, 25) + b) * mul) & M64, mul)
    elif n <= 32:
        a, b, c, d = (_f64(s, 0) * K1) & M64, _f64(s, 8), (_f64(s, n - 8) * mul) & M64, (_f64(s, n - 16) * K2) & M64
        out = _len16((_rot((a + b) & M64, 43) + _rot(c, 30) + d) & M64, (a + _rot((b + K2) & M64, 18) + c) & M64, mul)
    elif n <= 64:
        a, b, c, d = (_f64(s, 0) * K2) & M64, _f64(s, 8), (_f64(s, n - 8) * mul) & M64, (_f64(s, n - 16) * K2) & M64
        y = (_rot((a + b) & M64, 43) + _rot(c, 30) + d) & M64
        z = _len16(y, (a + _rot((b + K2) & M64, 18) + c) & M64, mul)
        e, f = (_f64(s, 16) * mul) & M64, _f64(s, 24)
        g, h = ((y + _f64(s, n - 32)) * mul) & M64, ((z + _f64(s, n - 24)) * mul) & M64
        out = _len16((_rot((e + f) & M64, 43) + _rot(g, 30) + h) & M64, (e + _rot((f + a) & M64, 18) + g) & M64, mul)
    else:
        x, y = 81, (81 * K1 + 113) & M64
        z = (_mix((y * K2 + 113) & M64) * K2) & M64
        v, w = (0, 0), (0, 0)
        x = (x * K2 + _f64(s, 0)) & M64
        end = ((n - 1) // 64) * 64
        last = n - 64
        for at in range(0, end, 64):
            x = (_rot((x + y + v[0] + _f64(s, at + 8)) & M64, 37) * K1) & M64
            y = (_rot((y + v[1] + _f64(s, at + 48)) & M64, 42) * K1) & M64
            x ^= w[1]
            y = (y + v[0] + _f64(s, at + 40)) & M64
            z = (_rot((z + w[0]) & M64, 33) * K1) & M64
            v = _weak(s, at, (v[1] * K1) & M64, (x + w[0]) & M64)
            w = _weak(s, at + 32, (z + w[1]) & M64, (y + _f64(s, at + 16)) & M64)
            z, x = x, z
        mul = (K1 + ((z & 0xFF) << 1)) & M64
        w = ((w[0] + ((n - 1) & 63)) & M64, w[1])
        v = ((v[0] + w[0]) & M64, v[1])
        w = ((w[0] + v[0]) & M64, w[1])
        x = (_rot((x + y + v[0] + _f64(s, last + 8)) & M64, 37) * mul) & M64
        y = (_rot((y + v[1] + _f64(s, last + 48)) & M64, 42) * mul) & M64
        x ^= (w[1] * 9) & M64
        y = (y + v[0] * 9 + _f64(s, last + 40)) & M64
        z = (_rot((z + w[0]) & M64, 33) * mul) & M64
        v = _weak(s, last, (v[1] * mul) & M64, (x + w[0]) & M64)
        w = _weak(s, last + 32, (z + w[1]) & M64, (y + _f64(s, last + 16)) & M64)
        z, x = x, z
        out = _len16((_len16(v[0], w[0], mul) + _mix(y) * K0 + z) & M64, (_len16(v[1], w[1], mul) + x) & M64, mul)
    return out - (1 << 64) if out >> 63 else out


def bit_reverse(x: int, keep_sign: bool) -> int:
    if keep_sign:
        sign, x = x & (1 << 63), x & ((1 << 63) - 1)
        out = int(f"{x:063b}"[::-1], 2) | sign
    else:
        out = int(f"{x & M64:064b}"[::-1], 2)
    return out - (1 << 64) if out >> 63 else out


# geography: WKT text, points in degrees, distances on a sphere


def _points(text: str) -> list[tuple[float, float]]:
    return [(float(a), float(b)) for a, b in re.findall(r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)\s+(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)", text)]


def _kind(text: str) -> str:
    return text.split("(")[0].split(" EMPTY")[0].strip().upper()


def _num(x: float) -> str:
    return f"{x:.15g}"


def _wkt(kind: str, points: list[tuple[float, float]]) -> str:
    body = ", ".join(f"{_num(x)} {_num(y)}" for x, y in points)
    if not points:
        return f"{kind} EMPTY"
    return f"{kind}(({body}))" if kind == "POLYGON" else f"{kind}({body})"


def _arc(a: tuple[float, float], b: tuple[float, float]) -> float:
    (x1, y1), (x2, y2) = [(math.radians(x), math.radians(y)) for x, y in (a, b)]
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * math.asin(min(1, math.sqrt(h)))


def _inside(p: tuple[float, float], ring: list[tuple[float, float]]) -> bool:
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if (y1 > p[1]) != (y2 > p[1]) and p[0] < (x2 - x1) * (p[1] - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def _on(p, ring) -> bool:
    return any(abs((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])) < 1e-12 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1]) for a, b in zip(ring, ring[1:]))


def _near_segment(p, a, b) -> float:
    """Radians from p to the segment ab, in a plane around p."""
    k = math.cos(math.radians(p[1]))
    ax, ay, bx, by = (a[0] - p[0]) * k, a[1] - p[1], (b[0] - p[0]) * k, b[1] - p[1]
    d = (bx - ax) ** 2 + (by - ay) ** 2
    t = 0 if d == 0 else max(0, min(1, -(ax * (bx - ax) + ay * (by - ay)) / d))
    return _arc(p, (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))


def distance(a: str, b: str) -> float | None:
    p, q = _points(a), _points(b)
    if not p or not q:
        return None
    if intersects(a, b):
        return 0.0
    best = min(_arc(x, y) for x in p for y in q)
    for pts, other in ((p, q), (q, p)):
        for x in pts:
            for s, t in zip(other, other[1:]):
                best = min(best, _near_segment(x, s, t))
    return best * EARTH


def _cross(a, b, c, d) -> bool:
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return side(a, b, c) * side(a, b, d) <= 0 and side(c, d, a) * side(c, d, b) <= 0 and max(min(a[0], b[0]), min(c[0], d[0])) <= min(max(a[0], b[0]), max(c[0], d[0])) and max(min(a[1], b[1]), min(c[1], d[1])) <= min(max(a[1], b[1]), max(c[1], d[1]))


def intersects(a: str, b: str) -> bool:
    p, q = _points(a), _points(b)
    if not p or not q:
        return False
    for pts, other, kind in ((p, q, _kind(b)), (q, p, _kind(a))):
        if kind == "POLYGON" and any(_inside(x, other) or _on(x, other) for x in pts):
            return True
        if any(x in other for x in pts) or any(_on(x, other) for x in pts):
            return True
    return any(_cross(s, t, u, v) for s, t in zip(p, p[1:]) for u, v in zip(q, q[1:]))


def contains(a: str, b: str, border: bool) -> bool:
    p, q = _points(a), _points(b)
    if not p or not q:
        return False
    if _kind(a) == "POLYGON":
        return all(_inside(x, p) or _on(x, p) for x in q) and (border or any(not _on(x, p) for x in q))
    return all(x in p or _on(x, p) for x in q)


def _area(ring) -> float:
    total = sum(math.radians(x2 - x1) * (2 + math.sin(math.radians(y1)) + math.sin(math.radians(y2))) for (x1, y1), (x2, y2) in zip(ring, ring[1:]))
    return abs(total * EARTH * EARTH / 2)


def _hull(points):
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def half(some):
        out = []
        for p in some:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    low, high = half(pts), half(pts[::-1])
    return low[:-1] + high


BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash(x: float, y: float, n: int) -> str:
    box, out = [[-180.0, 180.0], [-90.0, 90.0]], []
    for i in range(n):
        code = 0
        for j in range(5):
            k = (i * 5 + j) % 2
            mid = sum(box[k]) / 2
            bit = (x, y)[k] >= mid
            box[k][not bit] = mid
            code = code * 2 + bit
        out.append(BASE32[code])
    return "".join(out)


def geohash_point(text: str) -> str:
    box = [[-180.0, 180.0], [-90.0, 90.0]]
    for i, c in enumerate(text.lower()):
        code = BASE32.index(c)
        for j in range(5):
            k = (i * 5 + j) % 2
            box[k][not (code >> (4 - j) & 1)] = sum(box[k]) / 2
    return _wkt("POINT", [(sum(box[0]) / 2, sum(box[1]) / 2)])


def azimuth(a: str, b: str) -> float | None:
    (x1, y1), (x2, y2) = [tuple(map(math.radians, _points(t)[0])) for t in (a, b)]
    if (x1, y1) == (x2, y2):
        return None
    return math.atan2(math.sin(x2 - x1) * math.cos(y2), math.cos(y1) * math.sin(y2) - math.sin(y1) * math.cos(y2) * math.cos(x2 - x1)) % (2 * math.pi)


def _line_length(p) -> float:
    return sum(_arc(a, b) for a, b in zip(p, p[1:])) * EARTH


def _geogpoint(x: float, y: float) -> str:
    if not -90 <= y <= 90:
        raise ValueError("ST_GEOGPOINT: latitude must be between -90 and 90")
    return _wkt("POINT", [((x + 180) % 360 - 180 if not -180 <= x <= 180 else x, y)])


def _along(text: str, share: float) -> str:
    p = _points(text)
    left = _line_length(p) * share
    for a, b in zip(p, p[1:]):
        d = _arc(a, b) * EARTH
        if left <= d:
            t = left / d if d else 0
            return _wkt("POINT", [(a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))])
        left -= d
    return _wkt("POINT", [p[-1]])


def _locate(line: str, point: str) -> float:
    p, q = _points(line), _points(point)[0]
    best, at, done, total = None, 0.0, 0.0, _line_length(p)
    for a, b in zip(p, p[1:]):
        d, gap = _arc(a, b) * EARTH, _near_segment(q, a, b)
        if best is None or gap < best:
            k = math.cos(math.radians(q[1]))
            dx, dy = (b[0] - a[0]) * k, b[1] - a[1]
            t = 0 if dx * dx + dy * dy == 0 else max(0, min(1, ((q[0] - a[0]) * k * dx + (q[1] - a[1]) * dy) / (dx * dx + dy * dy)))
            best, at = gap, (done + t * d) / total if total else 0.0
        done += d
    return at


#: name: (function of non-null values, result type)
GEO = {
    "geogpoint": (_geogpoint, "string"), "x": (lambda g: _points(g)[0][0], "double"), "y": (lambda g: _points(g)[0][1], "double"), "astext": (lambda g: g, "string"), "geogfromtext": (lambda g: _wkt(_kind(g), _points(g)), "string"),
    "asgeojson": (lambda g: json.dumps({"type": {"POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon"}[_kind(g)], "coordinates": (lambda p: p[0] if _kind(g) == "POINT" else [p] if _kind(g) == "POLYGON" else p)([list(x) for x in _points(g)])}), "string"),
    "geogfromgeojson": (lambda t: (lambda j: _wkt(j["type"].upper(), [tuple(x) for x in ([j["coordinates"]] if j["type"] == "Point" else j["coordinates"][0] if j["type"] == "Polygon" else j["coordinates"])]))(json.loads(t)), "string"),
    "distance": (distance, "double"), "dwithin": (lambda a, b, d: (distance(a, b) or 0.0) <= d, "boolean"), "length": (lambda g: _line_length(_points(g)) if "LINE" in _kind(g) else 0.0, "double"), "perimeter": (lambda g: _line_length(_points(g)) if "POLYGON" in _kind(g) else 0.0, "double"), "area": (lambda g: _area(_points(g)) if "POLYGON" in _kind(g) else 0.0, "double"),
    "npoints": (lambda g: len(_points(g)), "bigint"), "numpoints": (lambda g: len(_points(g)), "bigint"), "geometrytype": (lambda g: "ST_" + {"POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon"}.get(_kind(g), _kind(g).title()), "string"), "dimension": (lambda g: -1 if not _points(g) else 2 if "POLYGON" in _kind(g) else 1 if "LINE" in _kind(g) else 0, "bigint"), "isempty": (lambda g: not _points(g), "boolean"),
    "isclosed": (lambda g: bool(_points(g)) and (_kind(g) == "POINT" or ("LINE" in _kind(g) and _points(g)[0] == _points(g)[-1])), "boolean"), "isring": (lambda g: "LINE" in _kind(g) and len(_points(g)) > 3 and _points(g)[0] == _points(g)[-1], "boolean"), "iscollection": (lambda g: _kind(g).startswith("MULTI") or "COLLECTION" in _kind(g), "boolean"), "numgeometries": (lambda g: 0 if not _points(g) else len(_points(g)) if _kind(g) == "MULTIPOINT" else 1, "bigint"),
    "startpoint": (lambda g: _wkt("POINT", _points(g)[:1]), "string"), "endpoint": (lambda g: _wkt("POINT", _points(g)[-1:]), "string"), "pointn": (lambda g, n: _wkt("POINT", [_points(g)[n - 1 if n > 0 else n]]) if 0 < abs(n) <= len(_points(g)) else None, "string"), "makeline": (lambda a, b: _wkt("LINESTRING", _points(a) + _points(b)), "string"), "makepolygon": (lambda g: _wkt("POLYGON", _points(g) if _points(g)[0] == _points(g)[-1] else [*_points(g), _points(g)[0]]), "string"),
    "centroid": (lambda g: (lambda p: _wkt("POINT", [(sum(x for x, _ in p) / len(p), sum(y for _, y in p) / len(p))]))(_points(g)[:-1] if "POLYGON" in _kind(g) else _points(g)), "string"), "contains": (lambda a, b: contains(a, b, False), "boolean"), "covers": (lambda a, b: contains(a, b, True), "boolean"), "within": (lambda a, b: contains(b, a, False), "boolean"), "coveredby": (lambda a, b: contains(b, a, True), "boolean"), "intersects": (intersects, "boolean"), "disjoint": (lambda a, b: not intersects(a, b), "boolean"), "equals": (lambda a, b: set(_points(a)) == set(_points(b)) and _kind(a) == _kind(b), "boolean"),
    "azimuth": (azimuth, "double"), "geohash": (lambda g, n=20: geohash(*_points(g)[0], n), "string"), "geogpointfromgeohash": (geohash_point, "string"), "snaptogrid": (lambda g, s: _wkt(_kind(g), [(round(x / s) * s, round(y / s) * s) for x, y in _points(g)]), "string"), "boundingbox": (lambda g: (lambda p: {"xmin": min(x for x, _ in p), "ymin": min(y for _, y in p), "xmax": max(x for x, _ in p), "ymax": max(y for _, y in p)})(_points(g)), "struct<xmin: double, ymin: double, xmax: double, ymax: double>"),
    "convexhull": (lambda g: (lambda h: _wkt("POLYGON", h) if len(h) > 3 else _wkt("LINESTRING" if len(h) > 1 else "POINT", h))(_hull(_points(g))), "string"), "exteriorring": (lambda g: _wkt("LINESTRING", _points(g)), "string"), "dumppoints": (lambda g: [_wkt("POINT", [p]) for p in _points(g)], "array<string>"), "maxdistance": (lambda a, b: max(_arc(p, q) for p in _points(a) for q in _points(b)) * EARTH, "double"), "lineinterpolatepoint": (_along, "string"), "linelocatepoint": (_locate, "double"),
}


def _zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.compress(data)


def _unzstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.decompress(data)


PLAIN = {
    "lk_trim": (lambda s: s.strip(), "string"), "lk_normalize": (lambda s, form, fold: unicodedata.normalize(form, s).casefold() if fold else unicodedata.normalize(form, s), "string"), "lk_instr": (instr, "bigint"), "lk_initcap": (initcap, "string"), "lk_split_substr": (split_substr, "string"),
    "lk_from_base32": (base64.b32decode, "binary"), "lk_to_base32": (lambda b: base64.b32encode(b).decode(), "string"), "lk_farm_fingerprint": (lambda b: farm_fingerprint(bytes(b)), "bigint"), "lk_bit_reverse": (bit_reverse, "bigint"), "lk_zstd": (_zstd, "binary"), "lk_unzstd": (_unzstd, "binary"),
    "lk_net_host": (host, "string"), "lk_net_suffix": (suffix, "string"), "lk_net_domain": (domain, "string"), "lk_ip_from_string": (_ip, "binary"), "lk_ip_to_string": (lambda b: str(ipaddress.ip_address(bytes(b))), "string"), "lk_ip_mask": (lambda n, k: _trunc(b"\xff" * n, k), "binary"), "lk_ip_trunc": (_trunc, "binary"), "lk_ip_in_net": (lambda a, b: ipaddress.ip_address(a) in ipaddress.ip_network(b), "boolean"),
}
OPTIONAL = {"lk_initcap": 1}  # functions whose later arguments may be null


def register(spark: SparkSession) -> None:
    """Register the functions once for a Spark session."""
    if getattr(spark, "_larkspur_functions", None) == spark.sparkContext.applicationId:
        return
    spark._larkspur_functions = spark.sparkContext.applicationId
    for name, (f, kind) in json_edit.FUNCTIONS.items():
        spark.udf.register(name, F.udf(_null_safe(f, None), kind, useArrow=True))
    for name, (f, kind, fresh) in keysets.FUNCTIONS.items():
        u = F.udf(_null_safe(f, None), kind, useArrow=True)
        spark.udf.register(name, u.asNondeterministic() if fresh else u)
    for name, (f, kind) in PLAIN.items():
        spark.udf.register(name, F.udf(_null_safe(f, OPTIONAL.get(name)), kind, useArrow=True))
    for name, (f, kind) in (GEO | geography_more.FUNCTIONS).items():
        spark.udf.register(f"lk_st_{name}", F.udf(_null_safe(f, None), kind, useArrow=True))


def _null_safe(f, required: int | None):
    def run(*row):
        return None if any(v is None for v in (row if required is None else row[:required])) else f(*row)

    return run

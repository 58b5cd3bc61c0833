"""JSON changes by path, over JSON text."""

from __future__ import annotations

import json
import re

STEP = re.compile(r"\.(?:\"([^\"]+)\"|([^.\[\]\"]+))|\[(\d+|\"[^\"]*\"|'[^']*')\]")


def steps(path: str) -> list[str | int]:
    if not path.startswith("$"):
        raise ValueError(f"JSON path {path!r} does not start with $")
    out: list[str | int] = []
    at = 1
    while at < len(path):
        m = STEP.match(path, at)
        if not m:
            raise ValueError(f"JSON path {path!r} is malformed")
        out.append(m[1] or m[2] or (int(m[3]) if m[3].isdigit() else m[3][1:-1]))
        at = m.end()
    return out


def _get(x, path):
    for s in path:
        if isinstance(x, dict) and isinstance(s, str) and s in x or isinstance(x, list) and isinstance(s, int) and s < len(x):
            x = x[s]
        else:
            return None, False
    return x, True


def set_value(doc, path: list, value, create: bool):
    if not path:
        return value
    parent = doc
    for i, s in enumerate(path):
        last = i == len(path) - 1
        if isinstance(s, str):
            if parent is None or not isinstance(parent, dict):
                return doc
            if s not in parent and not create:
                return doc
            if last:
                parent[s] = value
                return doc
            if parent.get(s) is None:
                if not create:
                    return doc
                parent[s] = {} if isinstance(path[i + 1], str) else []
            parent = parent[s]
        else:
            if not isinstance(parent, list) or (s >= len(parent) and not create):
                return doc
            while len(parent) <= s:
                parent.append(None)
            if last:
                parent[s] = value
                return doc
            if parent[s] is None:
                if not create:
                    return doc
                parent[s] = {} if isinstance(path[i + 1], str) else []
            parent = parent[s]
    return doc


def remove(doc, path: list):
    parent, ok = _get(doc, path[:-1])
    if ok and path:
        if isinstance(parent, dict) and isinstance(path[-1], str):
            parent.pop(path[-1], None)
        elif isinstance(parent, list) and isinstance(path[-1], int) and path[-1] < len(parent):
            del parent[path[-1]]
    return doc


def append(doc, path: list, values: list):
    x, ok = _get(doc, path)
    if ok and isinstance(x, list):
        x.extend(values)
    elif ok and x is None:
        doc = set_value(doc, path, list(values), True)
    return doc


def insert(doc, path: list, values: list):
    x, ok = _get(doc, path[:-1])
    if ok and isinstance(x, list) and isinstance(path[-1], int):
        x += [None] * (path[-1] - len(x))
        x[path[-1] : path[-1]] = values
    return doc


def strip_nulls(x, arrays: bool, empty: bool):
    if isinstance(x, dict):
        out = {k: strip_nulls(v, arrays, empty) for k, v in x.items()}
        return {k: v for k, v in out.items() if v is not None and not (empty and v in ({}, []))}
    if isinstance(x, list):
        out = [strip_nulls(v, arrays, empty) for v in x]
        return [v for v in out if v is not None] if arrays else out
    return x


def contains(a, b) -> bool:
    if isinstance(b, dict):
        return isinstance(a, dict) and all(k in a and contains(a[k], v) for k, v in b.items())
    if isinstance(b, list):
        return isinstance(a, list) and all(any(contains(x, y) for x in a) for y in b)
    if isinstance(a, list):
        return any(x == b and isinstance(x, bool) == isinstance(b, bool) for x in a)
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def flat(x) -> list:
    return [z for y in x for z in flat(y)] if isinstance(x, list) else [x]


def keys(x, depth: int | None, prefix: str = "") -> list[str]:
    out = []
    if isinstance(x, dict) and depth != 0:
        for k, v in x.items():
            name = k if re.fullmatch(r"\w+", k) else json.dumps(k)
            out.append(prefix + name)
            out += keys(v, None if depth is None else depth - 1, prefix + name + ".")
    return sorted(out)


def edit(how: str, doc: str, flag: bool, *args: str) -> str:
    """args: paths, or paths and JSON texts in turn."""
    x = json.loads(doc)
    if how == "remove":
        for p in args:
            x = remove(x, steps(p))
    elif how == "strip":
        p = steps(args[0]) if args else []
        inner, ok = _get(x, p)
        if ok:
            x = set_value(x, p, strip_nulls(inner, flag, False), False)
    else:
        for p, v in zip(args[::2], args[1::2]):
            value = json.loads(v)
            if how == "set":
                x = set_value(x, steps(p), value, flag)
            else:
                values = value if flag and isinstance(value, list) else [value]
                x = (append if how == "append" else insert)(x, steps(p), values)
    return json.dumps(x, separators=(",", ":"), ensure_ascii=False)


def contains_text(a: str, b: str) -> bool:
    return contains(json.loads(a), json.loads(b))


def flatten_text(x: str) -> list[str]:
    return [json.dumps(v, separators=(",", ":"), ensure_ascii=False) for v in flat(json.loads(x))]


def keys_text(x: str, depth: int) -> list[str]:
    return keys(json.loads(x), depth if depth >= 0 else None)


FUNCTIONS = {"lk_json_edit": (edit, "string"), "lk_json_contains": (contains_text, "boolean"), "lk_json_flatten": (flatten_text, "array<string>"), "lk_json_keys": (keys_text, "array<string>")}

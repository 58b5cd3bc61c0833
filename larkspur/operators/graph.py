"""GRAPH ... MATCH as a chain of equi-joins over node and edge tables."""

from __future__ import annotations

import itertools

from ..sql import nodes as n
from ..sql.lexer import SyntaxProblem


class _Element:
    def __init__(self, name: str, table: dict, is_edge: bool):
        self.name, self.table, self.is_edge = name, table, is_edge


def _labelled(tables: list[dict], labels: list[str] | None) -> list[dict]:
    wanted = {x.lower() for x in labels} if labels else None
    return [t for t in tables if wanted is None or wanted & {x.lower() for x in [*t["labels"], t["alias"]]}]


def _ends(s, graph: dict, edge: dict) -> tuple[tuple, tuple]:
    """((node table, edge columns, node columns) of the source, the same of the destination)."""
    out = []
    for side in ("source", "target"):
        own, name, of = edge[side]
        node = next(t for t in graph["nodes"] if name.lower() in (t["alias"].lower(), t["path"][-1].lower()))
        out.append((node, own, of or _key(s, node)))
    return out[0], out[1]


def _key(s, t: dict) -> list[str]:
    if t["key"]:
        return t["key"]
    table = s.find(t["path"])
    if table is None or not table.key:
        raise SyntaxProblem(f"graph table {t['alias']} has no key")
    return table.key


def match(low, name: str, body: dict) -> str:
    """The SQL of a MATCH: a union over the label choices of its elements; bounded hops are unrolled into joins."""
    s = low.s
    graph = s.graphs.get(name.lower())
    if graph is None:
        raise SyntaxProblem(f"no property graph {name}")
    branches = []
    hop_choices = []
    for path in body["patterns"]:
        ranges = [range(p["hops"][0], p["hops"][1] + 1) for p in path["parts"] if "hops" in p]
        hop_choices.append(list(itertools.product(*ranges)))
    for hops in itertools.product(*hop_choices):
        branches += _branches(low, graph, body, hops)
    if not branches:
        raise SyntaxProblem("no element of the graph has these labels")
    text = " UNION ALL ".join(branches)
    if body["distinct"] or body["group"] or body["order"] or body["limit"] is not None:
        text = f"SELECT {'DISTINCT ' * body['distinct']}* FROM ({text}) AS __g"
        if body["order"]:
            text += " ORDER BY " + ", ".join(low.order(o) for o in body["order"])
        if body["limit"] is not None:
            text += f" LIMIT {low.count(body['limit'])}"
    return text


def _branches(low, graph: dict, body: dict, hops: tuple) -> list[str]:
    slots, links = [], []  # (variable, candidates, part), (left slot, edge slot, right slot, direction)
    named: dict[str, int] = {}
    paths: dict[str, list[int]] = {}
    hidden = itertools.count()

    def slot(part: dict, edge: bool) -> int:
        var = part["var"] or f"__h{next(hidden)}"
        if not edge and var in named:
            slots[named[var]][2].append(part)
            return named[var]
        named[var] = len(slots)
        slots.append((var, _labelled(graph["edges" if edge else "nodes"], part["label"]), [part]))
        return named[var]

    blank = {"var": None, "label": None, "where": None, "props": []}
    for path, counts in zip(body["patterns"], hops):
        counts = list(counts)
        at = slot(path["parts"][0], False)
        trail = [at]
        for edge, node in zip(path["parts"][1::2], path["parts"][2::2]):
            k = counts.pop(0)
            if k == 0:
                if node["var"]:
                    named[node["var"]] = at
                slots[at][2].append(node)
                continue
            for i in range(k):
                e = slot(edge if edge["hops"] == (1, 1) else edge | {"var": None}, True)
                right = slot(node if i == k - 1 else blank, False)
                links.append((at, e, right, edge["direction"]))
                trail += [e, right]
                at = right
        if path["name"]:
            paths[path["name"]] = trail
    out = []
    for choice in itertools.product(*[c for _, c, _ in slots]):
        for turns in itertools.product(*[("RIGHT", "LEFT") if d == "ANY" else (d,) for *_, d in links]):
            text = _branch(low, graph, body, slots, links, choice, turns, paths)
            if text:
                out.append(text)
    return out


def _branch(low, graph, body, slots, links, choice, turns, paths) -> str | None:
    from ..sql.lower import ident, quote

    s, tests = low.s, []
    for (a, e, b, _), turn in zip(links, turns):
        (src, src_own, src_of), (dst, dst_own, dst_of) = _ends(s, graph, choice[e])
        left, right = ((src, src_own, src_of), (dst, dst_own, dst_of)) if turn == "RIGHT" else ((dst, dst_own, dst_of), (src, src_own, src_of))
        if choice[a] is not left[0] or choice[b] is not right[0]:
            return None
        for at, (_, own, of) in ((a, left), (b, right)):
            tests += [f"{ident(slots[e][0])}.{ident(x)} = {ident(slots[at][0])}.{ident(y)}" for x, y in zip(own, of)]
    kept = low.substitute, low.s.functions
    env: dict[str, tuple] = {var: (table, edge) for (var, _, parts), table, edge in zip(slots, choice, ["hops" in p[0] for _, _, p in slots])}

    def rewrite(x):
        """Element functions and properties that are expressions."""
        if isinstance(x, n.Call) and x.name == "ELEMENT_ID" and x.args and isinstance(x.args[0], n.Call) and x.args[0].name in ("PATH_FIRST", "PATH_LAST"):
            return rewrite(x.args[0])  # an element is known by its id
        if isinstance(x, n.Call) and x.args and isinstance(x.args[0], n.Name) and len(x.args[0].path) == 1:
            var = x.args[0].path[0]
            if var in env:
                table, edge = env[var]
                key = lambda cols, v=var: "to_json(array(" + ", ".join(f"CAST({ident(v)}.{ident(c)} AS STRING)" for c in cols) + "))"
                if x.name == "LABELS":
                    return _Raw("array(" + ", ".join(quote(t) for t in table["labels"]) + ")")
                if x.name == "ELEMENT_DEFINITION_NAME":
                    return _Raw(quote(table["alias"]))
                if x.name == "ELEMENT_ID":
                    return _Raw(f"concat({quote(table['alias'] + ':')}, {key(_key(s, table))})")
                if x.name == "PROPERTY_NAMES":
                    cols = [a or e.path[-1] for e, a in table["properties"]] if table["properties"] is not None else [c["name"] for c in s.find(table["path"]).columns]
                    return _Raw("array(" + ", ".join(map(quote, cols)) + ")")
                if x.name in ("SOURCE_NODE_ID", "DESTINATION_NODE_ID") and edge:
                    own, name, _ = table["source" if x.name[0] == "S" else "target"]
                    return _Raw(f"concat({quote(name + ':')}, {key(own)})")
            if var in paths:
                trail = paths[var]
                ids = [f"concat({quote(choice[i]['alias'] + ':')}, to_json(array({', '.join(f'CAST({ident(slots[i][0])}.{ident(c)} AS STRING)' for c in _key(s, choice[i]))})))" for i in trail]
                nodes, edges = f"array({', '.join(ids[::2])})", f"array({', '.join(ids[1::2])})" if ids[1::2] else "array()"
                table = {"PATH_LENGTH": f"{len(ids) // 2}L", "NODES": nodes, "EDGES": edges, "PATH_FIRST": ids[0], "PATH_LAST": ids[-1], "IS_TRAIL": f"(size(array_distinct({edges})) = {len(ids) // 2})", "IS_ACYCLIC": f"(size(array_distinct({nodes})) = {len(ids) // 2 + 1})"}
                if x.name in table:
                    return _Raw(table[x.name])
        if isinstance(x, n.Name) and len(x.path) > 1 and x.path[0] in env:
            props = env[x.path[0]][0]["properties"]
            for e, a in props or []:
                if (a or e.path[-1]).lower() == x.path[1].lower() and not (isinstance(e, n.Name) and e.path[-1] == x.path[1]):
                    low.substitute = {c["name"]: f"{ident(x.path[0])}.{ident(c['name'])}" for c in s.find(env[x.path[0]][0]["path"]).columns}
                    text = low.x(e)
                    low.substitute = kept[0]
                    return _Raw(text)
            return x
        if isinstance(x, (list, tuple)):
            return type(x)(rewrite(i) for i in x)
        if isinstance(x, n.Expr) and not isinstance(x, (n.Lit, _Raw)):
            new = type(x).__new__(type(x))
            new.__dict__.update({k: rewrite(v) for k, v in vars(x).items()})
            return new
        return x

    for var, _, parts in slots:
        for part in parts:
            tests += [f"{ident(var)}.{ident(k)} = {low.x(v)}" for k, v in part["props"]]
            if part["where"] is not None:
                tests.append(low.x(rewrite(part["where"])))
    if body["where"] is not None:
        tests.append(low.x(rewrite(body["where"])))
    tables = [f"{low.s.table_text(table['path'])} AS {ident(var)}" for (var, _, _), table in zip(slots, choice)]
    items = [(rewrite(x), a) for x, a in body["items"]]
    texts = []
    for x, a in items:
        if isinstance(x, n.Name) and len(x.path) == 1 and x.path[0] in env:
            var = x.path[0]
            texts.append(f"struct({ident(var)}.*) AS {ident(a or var)}")
        else:
            texts.append(low.item(x, a or (x.path[-1] if isinstance(x, n.Name) else None), None))
    group = f" GROUP BY {low.grouping(n.Select(items=items, group=rewrite(body['group'])))}" if body["group"] else ""
    where = f" WHERE {' AND '.join(tests)}" if tests else ""
    return f"SELECT {', '.join(texts)} FROM {' CROSS JOIN '.join(tables)}{where}{group}"


class _Raw(n.Expr):
    """An expression that is lowered already."""

    def __init__(self, text: str):
        self.text = text


def _register() -> None:
    from ..sql.lower import Lower

    Lower.x__raw = lambda self, e: e.text


_register()

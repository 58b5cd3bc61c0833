"""Recursive-descent parser: text to the tree of nodes.py."""

from __future__ import annotations

from . import nodes as n
from .lexer import SyntaxProblem, Token, tokens

CLAUSES = frozenset(
    "FROM WHERE GROUP HAVING QUALIFY WINDOW ORDER LIMIT OFFSET UNION INTERSECT EXCEPT JOIN INNER LEFT RIGHT FULL CROSS ON USING AS SELECT WHEN THEN ELSE END AND OR NOT IN IS LIKE BETWEEN CASE BY WITH PIVOT UNPIVOT TABLESAMPLE FOR INTO VALUES SET DESC ASC NULLS ROWS RANGE RETURN MATCH DO LATERAL NATURAL CORRESPONDING COLLATE RESPECT IGNORE".split()
)
TYPED = {"DATE": "date", "TIMESTAMP": "timestamp", "DATETIME": "datetime", "TIME": "time", "JSON": "json", "NUMERIC": "numeric", "DECIMAL": "numeric", "BIGNUMERIC": "bignumeric", "BIGDECIMAL": "bignumeric"}
COMPARE = ("=", "!=", "<>", "<", ">", "<=", ">=")
#: Binding powers of infix operators; comparison forms are level 4.
POWER = {"OR": 1, "AND": 2, "|": 5, "^": 6, "&": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "||": 10, "*": 10, "/": 10, "%": 10}


class Parser:
    def __init__(self, text: str):
        self.text, self.toks, self.i = text, tokens(text), 0

    # tokens

    @property
    def tok(self) -> Token:
        return self.toks[self.i]

    def peek(self, k: int = 1) -> Token:
        return self.toks[min(self.i + k, len(self.toks) - 1)]

    def next(self) -> Token:
        t = self.tok
        self.i += 1
        return t

    def at(self, *words: str) -> bool:
        """Whether the next tokens are these words or operators."""
        return all((self.peek(k).word or (self.peek(k).text if self.peek(k).kind == "op" else "")) == w for k, w in enumerate(words))

    def take(self, *words: str) -> bool:
        if self.at(*words):
            self.i += len(words)
            return True
        return False

    def expect(self, *words: str) -> None:
        if not self.take(*words):
            raise SyntaxProblem(f"expected {' '.join(words)} at {self.tok.at}, found {self.tok.text!r}")

    def name(self) -> str:
        t = self.next()
        if t.kind not in ("name", "quoted"):
            raise SyntaxProblem(f"expected a name at {t.at}, found {t.text!r}")
        return t.text

    def path(self) -> list[str]:
        first = self.next()
        if first.kind not in ("name", "quoted"):
            raise SyntaxProblem(f"expected a name at {first.at}, found {first.text!r}")
        out = first.text.split(".") if first.kind == "quoted" else [first.text]
        while True:
            if self.at("-") and self.peek().kind in ("name", "number") and self.toks[self.i - 1].end == self.tok.at and self.peek().at == self.tok.end:
                self.next()  # dashes in project names
                out[-1] += "-" + self.next().text
            elif self.at(".") and self.peek().kind in ("name", "quoted"):
                self.next()
                t = self.next()
                out += t.text.split(".") if t.kind == "quoted" else [t.text]
            else:
                return out

    def alias(self) -> str | None:
        if self.take("AS"):
            return self.name()
        if self.tok.kind == "quoted" or (self.tok.kind == "name" and self.tok.word not in CLAUSES):
            return self.name()
        return None

    def listed(self, one) -> list:
        out = [one()]
        while self.take(","):
            out.append(one())
        return out

    def in_parens(self, one) -> list:
        self.expect("(")
        if self.take(")"):
            return []
        out = self.listed(one)
        self.expect(")")
        return out

    # types

    def type(self) -> str:
        t = self.name().upper()
        if t == "ARRAY" and self.take("<"):
            inner = self.type()
            self._angle()
            return f"ARRAY<{inner}>"
        if t == "RANGE" and self.take("<"):
            inner = self.type()
            self._angle()
            return f"RANGE<{inner}>"
        if t == "STRUCT" and self.take("<"):
            parts = self._fields()
            return "STRUCT<" + ", ".join(f"{k or f'_{i}'} {v}" for i, (k, v) in enumerate(parts)) + ">"
        if self.take("("):
            args = []
            while not self.take(")"):
                args.append(self.next().text)
            return f"{t}({''.join(args)})"
        if t == "DOUBLE":
            self.take("PRECISION")
        return t

    def _angle(self) -> None:
        if self.at(">>"):
            t = self.tok
            self.toks[self.i] = Token("op", ">", t.at + 1, t.end)
            return
        self.expect(">")

    def _fields(self) -> list[tuple[str | None, str]]:
        out = []
        while True:
            if self.peek().kind == "name" and self.tok.kind in ("name", "quoted") and not self.at("ARRAY", "<"):
                key = self.name()
                out.append((key, self.type()))
            else:
                out.append((None, self.type()))
            if not self.take(","):
                self._angle()
                return out

    # expressions

    def expr(self, power: int = 0) -> n.Expr:
        left = self.prefix()
        while True:
            t = self.tok
            op = t.word if t.kind == "name" else t.text if t.kind == "op" else ""
            if op in POWER and POWER[op] > power:
                self.next()
                left = n.Binary(op, left, self.expr(POWER[op]))
            elif power < 4 and op in COMPARE:
                self.next()
                left = n.Binary("<>" if op == "!=" else op, left, self.expr(4))
            elif power < 4 and op in ("IS", "IN", "LIKE", "BETWEEN", "NOT") and (op != "NOT" or self.peek().word in ("IN", "LIKE", "BETWEEN")):
                left = self.predicate(left)
            else:
                return left

    def predicate(self, left: n.Expr) -> n.Expr:
        if self.take("IS"):
            neg = self.take("NOT")
            if self.take("DISTINCT", "FROM"):
                return n.Distinct(left, self.expr(4), neg)
            return n.Is(left, self.name().upper(), neg)
        neg = self.take("NOT")
        if self.take("BETWEEN"):
            low = self.expr(4)
            self.expect("AND")
            return n.Between(left, low, self.expr(4), neg)
        if self.take("LIKE"):
            if self.at("ANY") or self.at("SOME") or self.at("ALL"):
                how = "ALL" if self.name().upper() == "ALL" else "ANY"
                if self.take("UNNEST"):
                    self.expect("(")
                    arr = self.expr()
                    self.expect(")")
                    return n.Like(left, how, [n.Call("UNNEST", [arr])], neg)
                return n.Like(left, how, self.in_parens(self.expr), neg)
            return n.Like(left, "", [self.expr(4)], neg)
        self.expect("IN")
        if self.take("UNNEST"):
            self.expect("(")
            arr = self.expr()
            self.expect(")")
            return n.InList(left, None, None, arr, neg)
        if self.at("(") and (self.peek().word in ("SELECT", "WITH", "FROM")):
            self.expect("(")
            q = self.query()
            self.expect(")")
            return n.InList(left, None, q, None, neg)
        return n.InList(left, self.in_parens(self.expr), None, None, neg)

    def prefix(self) -> n.Expr:
        if self.take("NOT"):
            return n.Unary("NOT", self.expr(3))
        for op in ("-", "+", "~"):
            if self.take(op):
                x = self.expr(11)
                if op == "-" and isinstance(x, n.Lit) and x.kind in ("int", "float") and not str(x.value).startswith("-"):
                    return n.Lit(x.kind, "-" + str(x.value))
                return n.Unary(op, x)
        return self.postfix(self.primary())

    def postfix(self, x: n.Expr) -> n.Expr:
        while True:
            if self.at(".") and self.peek().kind in ("name", "quoted"):
                self.next()
                x = n.Field(x, self.name())
            elif self.at(".") and self.peek().text == "(":
                self.next()
                self.expect("(")
                x = n.Field(x, ".".join(self.path()))
                self.expect(")")
            elif self.take("["):
                how = "KEY"
                if self.tok.word in ("OFFSET", "ORDINAL", "SAFE_OFFSET", "SAFE_ORDINAL") and self.peek().text == "(":
                    how = self.name().upper()
                x = n.Index(x, how, self.expr())
                self.expect("]")
            elif self.at("COLLATE"):
                self.next()
                x = n.Call("COLLATE", [x, self.prefix()])
            else:
                return x

    def primary(self) -> n.Expr:
        t = self.tok
        w = t.word
        if t.kind == "number":
            self.next()
            if t.text[:2].lower() == "0x":
                return n.Lit("int", str(int(t.text, 16)))
            return n.Lit("int" if t.text.isdigit() else "float", t.text)
        if t.kind in ("string", "bytes"):
            text = self.next().text
            while self.tok.kind == t.kind:
                text += self.next().text
            return n.Lit(t.kind, text)
        if self.take("@@"):
            return n.Param(".".join(self.path()), system=True)
        if self.take("@"):
            return n.Param(self.name())
        if self.take("?"):
            return n.Param(None)
        if t.text == "(" and t.kind == "op":
            return self.parens()
        if t.text == "[" and t.kind == "op":
            self.next()
            items = [] if self.at("]") else self.listed(self.expr)
            self.expect("]")
            return n.ArrayLit(items)
        if t.text == "*" and t.kind == "op":
            self.next()
            return self.star(None)
        if t.kind == "quoted":
            return self.name_or_call()
        if t.kind != "name":
            raise SyntaxProblem(f"unexpected {t.text!r} at {t.at}")
        nxt = self.peek()
        if w in ("TRUE", "FALSE"):
            self.next()
            return n.Lit("bool", w)
        if w == "NULL":
            self.next()
            return n.Lit("null", None)
        if w in TYPED and nxt.kind == "string":
            self.next()
            return n.Lit(TYPED[w], self.next().text)
        if w == "RANGE" and nxt.text == "<":
            self.next()
            self.expect("<")
            kind = self.type()
            self._angle()
            return n.Call("RANGE_LITERAL", [n.Lit("string", kind), n.Lit("string", self.next().text)])
        if w == "INTERVAL" and nxt.text not in (",", ")", "."):
            self.next()
            amount = self.expr(9) if not (self.at("-")) else self.prefix()
            unit = self.name().upper()
            return n.Interval(amount, unit, self.name().upper() if self.take("TO") else None)
        if w == "CASE":
            return self.case()
        if w in ("CAST", "SAFE_CAST") and nxt.text == "(":
            self.next()
            self.expect("(")
            x = self.expr()
            self.expect("AS")
            kind = self.type()
            fmt = self.expr() if self.take("FORMAT") else None
            zone = self.expr() if self.take("AT", "TIME", "ZONE") else None
            self.expect(")")
            return n.Cast(x, kind, w == "SAFE_CAST", fmt, zone)
        if w == "EXTRACT" and nxt.text == "(":
            self.next()
            self.expect("(")
            part = self.name().upper()
            if self.take("("):
                part += f"({self.name().upper()})"
                self.expect(")")
            self.expect("FROM")
            x = self.expr()
            zone = self.expr() if self.take("AT", "TIME", "ZONE") else None
            self.expect(")")
            return n.Extract(part, x, zone)
        if w == "EXISTS" and nxt.text == "(":
            self.next()
            self.expect("(")
            q = self.query()
            self.expect(")")
            return n.Sub("exists", q)
        if w == "ARRAY" and nxt.text == "(":
            self.next()
            self.expect("(")
            q = self.query()
            self.expect(")")
            return n.Sub("array", q)
        if w == "ARRAY" and nxt.text in ("<", "["):
            self.next()
            kind = None
            if self.take("<"):
                kind = self.type()
                self._angle()
            self.expect("[")
            items = [] if self.at("]") else self.listed(self.expr)
            self.expect("]")
            return n.ArrayLit(items, kind)
        if w == "STRUCT" and nxt.text in ("(", "<"):
            self.next()
            types = None
            if self.take("<"):
                types = self._fields()
            items = self.in_parens(lambda: (self.expr(), self.name() if self.take("AS") else None))
            return n.StructLit(items, types)
        if w == "WITH" and nxt.text == "(":
            self.next()
            self.expect("(")
            items = []
            while self.peek().word == "AS":
                key = self.name()
                self.expect("AS")
                items.append((key, self.expr()))
                self.expect(",")
            body = self.expr()
            self.expect(")")
            return n.With(items, body)
        return self.name_or_call()

    def star(self, of: str | None) -> n.Star:
        out = n.Star(of)
        if self.at("EXCEPT", "("):
            self.next()
            out.without = self.in_parens(self.name)
        if self.take("REPLACE"):
            out.replace = self.in_parens(lambda: (self.expr(), self._as()))
        return out

    def _as(self) -> str:
        self.take("AS")
        return self.name()

    def parens(self) -> n.Expr:
        if self.peek().word in ("SELECT", "WITH", "FROM") and not (self.peek().word == "WITH" and self.peek(2).text == "("):
            self.expect("(")
            q = self.query()
            self.expect(")")
            return n.Sub("scalar", q)
        start = self.i
        # (a, b) -> body
        if self.peek().kind == "name":
            k = 2
            while self.peek(k).text == "," and self.peek(k + 1).kind == "name":
                k += 2
            if self.peek(k).text == ")" and self.peek(k + 1).text == "->":
                self.expect("(")
                names = self.listed(self.name)
                self.expect(")")
                self.expect("->")
                return n.Lambda(names, self.expr())
        self.i = start
        self.expect("(")
        if self.at("("):
            depth_start = self.i
            try:
                q = self.query()
                if self.take(")"):
                    if isinstance(q.body, (n.Select, n.SetOp)) or isinstance(q.body, n.Query):
                        return n.Sub("scalar", q)
            except SyntaxProblem:
                pass
            self.i = depth_start
        items = self.listed(self.expr)
        self.expect(")")
        return items[0] if len(items) == 1 else n.StructLit([(x, None) for x in items])

    def case(self) -> n.Case:
        self.expect("CASE")
        of = None if self.at("WHEN") else self.expr()
        whens, other = [], None
        while self.take("WHEN"):
            cond = self.expr()
            self.expect("THEN")
            whens.append((cond, self.expr()))
        if self.take("ELSE"):
            other = self.expr()
        self.expect("END")
        return n.Case(of, whens, other)

    def name_or_call(self) -> n.Expr:
        path = [self.name()]
        while self.at(".") and self.peek().kind in ("name", "quoted"):
            self.next()
            path.append(self.name())
        if self.at(".", "*"):
            self.i += 2
            return self.star(".".join(path))
        if self.at("("):
            return self.call(path)
        if self.at("->") and len(path) == 1:
            self.next()
            return n.Lambda(path, self.expr())
        return n.Name(path)

    def call(self, path: list[str]) -> n.Expr:
        safe = path[0].upper() == "SAFE" and len(path) > 1
        out = n.Call(".".join(path[safe:]).upper(), [], safe=safe)
        self.expect("(")
        out.distinct = self.take("DISTINCT")
        if not self.at(")"):
            while True:
                if self.tok.kind == "name" and self.peek().text == "=>":
                    key = self.name().lower()
                    self.expect("=>")
                    out.named[key] = self.argument()
                elif self.at("*"):
                    self.next()
                    out.args.append(n.Star())
                elif out.name == "POSITION" and not out.args:  # POSITION(a IN b)
                    out.args.append(self.expr(4))
                    if self.take("IN"):
                        out.args.append(self.expr())
                else:
                    x = self.argument()
                    if self.take("AS"):
                        x = n.StructLit([(x, self.name())])
                    out.args.append(x)
                if not self.take(","):
                    break
        if self.take("CLAMPED", "BETWEEN"):
            low = self.expr(4)
            self.expect("AND")
            out.named["contribution_bounds"] = n.StructLit([(low, None), (self.expr(4), None)])
        if self.at("IGNORE", "NULLS") or self.at("RESPECT", "NULLS"):
            out.nulls = self.name().upper()
            self.expect("NULLS")
        if self.take("HAVING"):
            out.having = (self.name().upper(), self.expr())
        if self.take("ORDER", "BY"):
            out.order = self.listed(self.ordering)
        if self.take("LIMIT"):
            out.limit = self.expr()
        self.expect(")")
        if self.at("IGNORE", "NULLS", "OVER") or self.at("RESPECT", "NULLS", "OVER"):
            out.nulls = self.name().upper()
            self.expect("NULLS")
        if self.at("WITHIN", "GROUP"):
            self.i += 2
            self.expect("(", "ORDER", "BY")
            out.order = self.listed(self.ordering)
            self.expect(")")
        if self.take("OVER"):
            out.over = self.window() if self.at("(") else self.name()
        return out

    def argument(self) -> n.Expr:
        if self.at("TABLE") and self.peek().kind in ("name", "quoted"):
            self.next()
            return n.Call("TABLE", [n.Name(self.path())])
        if (self.at("MODEL") or self.at("SEQUENCE")) and self.peek().kind in ("name", "quoted"):
            self.next()
            return n.Name(self.path())
        if self.at("DESCRIPTOR") and self.peek().text == "(":
            self.next()
            return n.ArrayLit([n.Lit("string", x) for x in self.in_parens(self.name)])
        return self.expr()

    def ordering(self) -> n.Order:
        x = self.expr()
        down = self.take("DESC")
        if not down:
            self.take("ASC")
        nulls = None
        if self.take("NULLS"):
            nulls = self.name().upper()
        return n.Order(x, down, nulls)

    def window(self) -> n.Window:
        self.expect("(")
        out = n.Window()
        if self.tok.kind in ("name", "quoted") and self.tok.word not in ("PARTITION", "ORDER", "ROWS", "RANGE"):
            out.base = self.name()
        if self.take("PARTITION", "BY"):
            out.partition = self.listed(self.expr)
        if self.take("ORDER", "BY"):
            out.order = self.listed(self.ordering)
        if self.at("ROWS") or self.at("RANGE"):
            kind = self.name().upper()
            if self.take("BETWEEN"):
                low = self.bound()
                self.expect("AND")
                out.frame_parts = [kind, low, self.bound()]
            else:
                out.frame_parts = [kind, self.bound(), ("CURRENT ROW", None)]
        self.expect(")")
        return out

    def bound(self) -> tuple[str, n.Expr | None]:
        if self.take("CURRENT", "ROW"):
            return "CURRENT ROW", None
        if self.take("UNBOUNDED"):
            return f"UNBOUNDED {self.name().upper()}", None
        x = self.expr()
        return self.name().upper(), x

    # queries

    def query(self) -> n.Query:
        out = n.Query(None)
        if self.take("WITH"):
            out.recursive = self.take("RECURSIVE")
            while True:
                key = self.name()
                cols = self.in_parens(self.name) if self.at("(") else None
                self.expect("AS", "(")
                q = self.query()
                q.columns = cols
                out.ctes.append((key, q))
                self.expect(")")
                if not self.take(","):
                    break
        if self.at("FROM"):
            self.next()
            out.body = n.Select([(n.Star(), None)], source=self.from_clause())
        else:
            out.body = self.set_expr()
        if self.take("ORDER", "BY"):
            out.order = self.listed(self.ordering)
        if self.take("LIMIT"):
            out.limit = self.expr()
            if self.take("OFFSET"):
                out.offset = self.expr()
        while self.take("|>"):
            out.pipes.append(self.pipe())
        return out

    def set_expr(self, level: int = 0):
        left = self.set_operand() if level else self.set_expr(1)
        ops = ("INTERSECT",) if level else ("UNION", "EXCEPT")
        while self.tok.word in ops or (self.tok.word in ("FULL", "LEFT", "INNER") and self.peek().word in ("UNION", "OUTER") and self.peek(2).word in ("UNION", "ALL", "DISTINCT")):
            while self.tok.word in ("FULL", "LEFT", "INNER", "OUTER"):
                self.next()
            op = self.name().upper()
            every = self.take("ALL")
            if not every:
                self.take("DISTINCT")
            by_name = self.take("BY", "NAME") or self.take("CORRESPONDING")
            if by_name and self.take("ON"):
                self.in_parens(self.name)
            left = n.SetOp(op, every, left, self.set_operand() if level else self.set_expr(1), by_name)
        return left

    def set_operand(self):
        if self.take("("):
            q = self.query()
            self.expect(")")
            return q
        return self.select()

    def select(self) -> n.Select:
        self.expect("SELECT")
        if self.take("WITH", "DIFFERENTIAL_PRIVACY") or self.take("WITH", "ANONYMIZATION"):
            out = n.Select([])
            out.privacy = self.options()
        else:
            out = n.Select([])
        out.distinct = self.take("DISTINCT")
        if not out.distinct:
            self.take("ALL")
        if self.take("AS"):
            out.as_kind = self.name().upper()
        out.items = self.select_items()
        if self.take("FROM"):
            out.source = self.from_clause()
        if self.take("WHERE"):
            out.where = self.expr()
        if self.take("GROUP", "BY"):
            out.group = self.grouping()
        if self.take("HAVING"):
            out.having = self.expr()
        if self.take("QUALIFY"):
            out.qualify = self.expr()
        if self.take("WINDOW"):
            out.windows = self.listed(self.named_window)
        return out

    def options(self) -> dict:
        out = {}
        if self.take("OPTIONS"):
            for key, value in self.in_parens(self._option):
                out[key.lower()] = value
        return out

    def _option(self):
        key = self.name()
        self.expect("=")
        return key, self.expr()

    def named_window(self):
        key = self.name()
        self.expect("AS")
        return key, (self.window() if self.at("(") else n.Window(base=self.name()))

    def select_items(self) -> list:
        out = []
        while True:
            if self.tok.word in ("FROM", "WHERE") or self.tok.kind == "end" or self.at(")") or self.at("|>"):
                return out
            x = self.expr()
            out.append((x, None if isinstance(x, n.Star) else self.alias()))
            if not self.take(","):
                return out

    def grouping(self):
        if self.take("ALL"):
            return ("ALL",)

        def one():
            for word in ("ROLLUP", "CUBE"):
                if self.at(word, "("):
                    self.next()
                    return (word, self.in_parens(self.expr))
            if self.take("GROUPING", "SETS"):
                return ("SETS", self.in_parens(one_set))
            if self.at("(", ")"):
                self.i += 2
                return ("SETS", [[]])
            x = self.expr()
            if self.at("AS") or (self.tok.kind == "name" and self.tok.word not in CLAUSES):
                return ("ALIAS", x, self.alias())
            return x

        def one_set():
            if self.at("("):
                return self.in_parens(self.expr)
            for word in ("ROLLUP", "CUBE"):
                if self.at(word, "("):
                    self.next()
                    return (word, self.in_parens(self.expr))
            return [self.expr()]

        return self.listed(one)

    def from_clause(self):
        left = self.joined()
        while self.take(","):
            left = n.Join(left, self.joined(), "COMMA")
        return left

    def joined(self):
        left = self.table()
        while True:
            kind = None
            for words, k in ((("JOIN",), "INNER"), (("INNER", "JOIN"), "INNER"), (("CROSS", "JOIN"), "CROSS"), (("LEFT", "JOIN"), "LEFT"), (("LEFT", "OUTER", "JOIN"), "LEFT"), (("RIGHT", "JOIN"), "RIGHT"), (("RIGHT", "OUTER", "JOIN"), "RIGHT"), (("FULL", "JOIN"), "FULL"), (("FULL", "OUTER", "JOIN"), "FULL")):
                if self.take(*words):
                    kind = k
                    break
            if kind is None:
                return left
            right = self.table()
            left = self.join_condition(left, right, kind)

    def join_condition(self, left, right, kind):
        if self.take("ON"):
            return n.Join(left, right, kind, on=self.expr())
        if self.take("USING"):
            return n.Join(left, right, kind, using=self.in_parens(self.name))
        return n.Join(left, right, kind)

    def table(self):
        if self.take("UNNEST"):
            self.expect("(")
            out = n.Unnest([])
            while not self.at(")"):
                if self.at("MODE", "=>"):
                    self.i += 2
                    out.mode = self.expr().value
                else:
                    out.arrays.append(self.expr())
                    if self.take("AS"):
                        out.names = [*getattr(out, "names", []), self.name()]
                if not self.take(","):
                    break
            self.expect(")")
            out.alias = self.alias()
            if self.take("WITH", "OFFSET"):
                out.offset = self.alias() or "offset"
            return self.decorated(out)
        if self.at("(") and self.peek().word in ("SELECT", "WITH", "FROM", ""):
            start = self.i
            self.expect("(")
            try:
                q = self.query()
                self.expect(")")
                return self.decorated(n.Derived(q, None))
            except SyntaxProblem:
                self.i = start
                self.expect("(")
                inner = self.from_clause()
                self.expect(")")
                return self.decorated(inner)
        if self.at("("):
            self.expect("(")
            inner = self.from_clause()
            self.expect(")")
            return inner
        if self.at("GRAPH_TABLE", "("):
            self.next()
            self.expect("(")
            graph = self.name()
            body = self.graph_body()
            self.expect(")")
            return n.GraphMatch(graph, body, self.alias())
        path = self.path()
        if self.at("("):
            call = self.call(path)
            return self.decorated(n.TableCall(call.name, call.args, call.named))
        return self.decorated(n.TableRef(path))

    def decorated(self, x):
        """Alias, PIVOT, UNPIVOT and TABLESAMPLE after a table."""
        if getattr(x, "alias", 0) is None and not self.at("PIVOT") and not self.at("UNPIVOT"):
            x.alias = self.alias()
        if self.take("FOR"):
            self.expect("SYSTEM_TIME", "AS", "OF")
            self.expr()
        while True:
            if self.take("PIVOT"):
                self.expect("(")
                aggs = self.listed(lambda: (self.expr(), self.alias()))
                self.expect("FOR")
                key = self.expr(4)
                self.expect("IN")
                values = self.in_parens(lambda: (self.expr(), self.alias()))
                self.expect(")")
                x = n.Pivot(x, aggs, key, values, self.alias())
            elif self.take("UNPIVOT"):
                keep = False
                if self.take("INCLUDE", "NULLS"):
                    keep = True
                elif self.take("EXCLUDE", "NULLS"):
                    pass
                self.expect("(")
                value = self.in_parens(self.name) if self.at("(") else [self.name()]
                self.expect("FOR")
                key = self.name()
                self.expect("IN")
                cols = self.in_parens(lambda: (self.in_parens(self.name) if self.at("(") else [self.name()], self.expr() if self.take("AS") else None))
                self.expect(")")
                x = n.Unpivot(x, value, key, cols, keep, self.alias())
            elif self.take("TABLESAMPLE"):
                self.name()
                self.expect("(")
                amount = self.next().text
                unit = self.name().upper()
                self.expect(")")
                x.sample = f"{amount} {unit}"
            else:
                return x

    def pipe(self) -> tuple:
        w = self.tok.word
        if w in ("SELECT", "EXTEND", "SET", "DROP", "RENAME", "AS", "DISTINCT", "WHERE", "AGGREGATE", "ORDER", "LIMIT", "UNION", "INTERSECT", "EXCEPT", "CALL", "TABLESAMPLE", "WINDOW", "PIVOT", "UNPIVOT", "ASSERT", "STATIC_DESCRIBE"):
            self.next()
        if w == "SELECT":
            distinct = self.take("DISTINCT")
            return ("SELECT", self.select_items(), distinct)
        if w in ("EXTEND", "WINDOW"):
            return ("EXTEND", self.select_items())
        if w == "SET":
            return ("SET", self.listed(self._set))
        if w == "DROP":
            return ("DROP", self.listed(self.name))
        if w == "RENAME":
            return ("RENAME", self.listed(lambda: (self.name(), self._as())))
        if w == "AS":
            return ("AS", self.name())
        if w == "DISTINCT":
            return ("DISTINCT",)
        if w == "WHERE":
            return ("WHERE", self.expr())
        if w == "ASSERT":
            return ("ASSERT", self.listed(self.expr))
        if w == "AGGREGATE":
            items = [] if self.at("GROUP") else self.select_items()
            group = []
            if self.take("GROUP"):
                self.take("AND", "ORDER")
                self.expect("BY")
                group = self.grouping()
            return ("AGGREGATE", items, group)
        if w == "ORDER":
            self.expect("BY")
            return ("ORDER", self.listed(self.ordering))
        if w == "LIMIT":
            limit = self.expr()
            return ("LIMIT", limit, self.expr() if self.take("OFFSET") else None)
        if w in ("UNION", "INTERSECT", "EXCEPT"):
            every = self.take("ALL")
            if not every:
                self.take("DISTINCT")
            by_name = self.take("BY", "NAME")
            queries = []
            while True:
                self.expect("(")
                queries.append(self.query())
                self.expect(")")
                if not self.take(","):
                    return (w, every, queries, by_name)
        if w in ("JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS"):
            holder = n.TableRef(["__pipe"])
            kinds = {"JOIN": "INNER", "INNER": "INNER", "CROSS": "CROSS", "LEFT": "LEFT", "RIGHT": "RIGHT", "FULL": "FULL"}
            kind = kinds[w]
            while self.tok.word != "JOIN":
                self.next()
            self.expect("JOIN")
            return ("JOIN", self.join_condition(holder, self.table(), kind))
        if w in ("PIVOT", "UNPIVOT"):
            self.i -= 1
            return ("TABLE", self.decorated(n.TableRef(["__pipe"], alias="__pipe")))
        if w == "TABLESAMPLE":
            self.name()
            self.expect("(")
            amount = self.next().text
            unit = self.name().upper()
            self.expect(")")
            return ("SAMPLE", f"{amount} {unit}")
        if w == "STATIC_DESCRIBE":
            return ("NONE",)
        raise SyntaxProblem(f"no such pipe operator: {self.tok.text!r}")

    def _set(self):
        key = self.name()
        self.expect("=")
        return key, self.expr()

    # graphs

    def graph_body(self) -> dict:
        """MATCH pattern [WHERE] {RETURN items}."""
        self.expect("MATCH")
        patterns = [self.graph_path()]
        while self.take(",") or self.take("MATCH"):
            patterns.append(self.graph_path())
        where = self.expr() if self.take("WHERE") else None
        if not self.take("RETURN"):
            self.expect("COLUMNS")
            items = self.in_parens(lambda: (self.expr(), self.alias()))
            return {"patterns": patterns, "where": where, "items": items, "distinct": False, "order": [], "limit": None, "group": None}
        distinct = self.take("DISTINCT")
        items = self.select_items()
        group = self.grouping() if self.take("GROUP", "BY") else None
        order = self.listed(self.ordering) if self.take("ORDER", "BY") else []
        limit = self.expr() if self.take("LIMIT") else None
        return {"patterns": patterns, "where": where, "items": items, "distinct": distinct, "order": order, "limit": limit, "group": group}

    def graph_path(self) -> dict:
        name = None
        if self.tok.kind == "name" and self.peek().text == "=":
            name = self.name()
            self.expect("=")
        for mode in ("WALK", "TRAIL", "ACYCLIC"):
            self.take(mode)
        parts = [self.graph_element("(", ")")]
        while True:
            left = self.take("<")
            if not self.take("-"):
                break
            edge = {"var": None, "label": None, "where": None, "props": []}
            if self.at("["):
                edge = self.graph_element("[", "]")
            if self.take("->"):
                direction = "RIGHT"
            elif self.take("-"):
                direction = "RIGHT" if self.take(">") else "LEFT" if left else "ANY"
            else:
                direction = "LEFT" if left else "ANY"
            hops = (1, 1)
            if self.take("{"):
                low = 0 if self.at(",") else int(self.next().text)
                hops = (low, int(self.next().text)) if self.take(",") else (low, low)
                self.expect("}")
            parts += [edge | {"direction": direction, "hops": hops}, self.graph_element("(", ")")]
        return {"name": name, "parts": parts}

    def graph_element(self, opening: str, closing: str) -> dict:
        self.expect(opening)
        out = {"var": None, "label": None, "where": None, "props": []}
        if self.tok.kind in ("name", "quoted") and self.tok.word not in ("IS", "WHERE"):
            out["var"] = self.name()
        if self.take(":") or self.take("IS"):
            out["label"] = [self.name()]
            while self.take("|"):
                out["label"].append(self.name())
        if self.take("{"):
            while not self.take("}"):
                key = self.name()
                self.expect(":")
                out["props"].append((key, self.expr()))
                self.take(",")
        if self.take("WHERE"):
            out["where"] = self.expr()
        self.expect(closing)
        return out


def parse_query(text: str) -> n.Query:
    p = Parser(text)
    q = p.query()
    p.take(";")
    if p.tok.kind != "end":
        raise SyntaxProblem(f"unexpected {p.tok.text!r} at {p.tok.at}")
    return q

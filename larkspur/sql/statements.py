"""Statements: splitting a script, and parsing what is no query."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from . import nodes as n
from .lexer import SyntaxProblem
from .parser import Parser


@dataclass
class Statement:
    kind: str
    data: dict[str, Any] = field(default_factory=dict)


class ScriptParser(Parser):
    def script(self, *until: str) -> list[Statement]:
        out = []
        while True:
            while self.take(";"):
                pass
            if self.tok.kind == "end" or self.tok.word in until:
                return out
            out.append(self.statement())
            if self.tok.kind != "end" and self.tok.word not in until:
                self.expect(";")

    def rest(self) -> str:
        """The text up to the end of the statement."""
        start, depth = self.tok.at, 0
        while self.tok.kind != "end" and not (self.at(";") and not depth):
            depth += (self.tok.text in "([" and self.tok.kind == "op") - (self.tok.text in ")]" and self.tok.kind == "op")
            self.next()
        return self.text[start : self.toks[self.i - 1].end]

    def block(self, *until: str) -> list[Statement]:
        return self.script(*until)

    def statement(self) -> Statement:
        w = self.tok.word
        label = None
        if self.tok.kind == "name" and self.peek().text == ":" and self.peek(2).word in ("BEGIN", "LOOP", "WHILE", "REPEAT", "FOR"):
            label = self.name()
            self.expect(":")
            w = self.tok.word
        f = getattr(self, "s_" + w.lower(), None)
        if f is None:
            return Statement("query", {"query": self.query()})
        s = f()
        s.data["label"] = label
        if label and self.tok.text == label:
            self.next()
        return s

    # scripting

    def s_declare(self):
        self.expect("DECLARE")
        names = self.listed(self.name)
        kind = None if self.at("DEFAULT") else self.type()
        value = self.expr() if self.take("DEFAULT") else None
        return Statement("declare", {"names": names, "type": kind, "value": value})

    def s_set(self):
        self.expect("SET")
        if self.take("@@"):
            path = ".".join(self.path())
            self.expect("=")
            return Statement("set_system", {"name": path, "value": self.expr()})
        names = self.in_parens(self.name) if self.at("(") else [self.name()]
        self.expect("=")
        return Statement("set", {"names": names, "value": self.expr()})

    def s_if(self):
        self.expect("IF")
        branches, other = [], []
        cond = self.expr()
        self.expect("THEN")
        branches.append((cond, self.block("ELSEIF", "ELSE", "END")))
        while self.take("ELSEIF"):
            cond = self.expr()
            self.expect("THEN")
            branches.append((cond, self.block("ELSEIF", "ELSE", "END")))
        if self.take("ELSE"):
            other = self.block("END")
        self.expect("END", "IF")
        return Statement("if", {"branches": branches, "other": other})

    def s_case(self):
        self.expect("CASE")
        of = None if self.at("WHEN") else self.expr()
        branches, other = [], None
        while self.take("WHEN"):
            cond = self.expr()
            self.expect("THEN")
            branches.append((n.Binary("=", of, cond) if of is not None else cond, self.block("WHEN", "ELSE", "END")))
        if self.take("ELSE"):
            other = self.block("END")
        self.expect("END", "CASE")
        return Statement("if", {"branches": branches, "other": other or []})

    def s_while(self):
        self.expect("WHILE")
        cond = self.expr()
        self.expect("DO")
        body = self.block("END")
        self.expect("END", "WHILE")
        return Statement("while", {"cond": cond, "body": body})

    def s_loop(self):
        self.expect("LOOP")
        body = self.block("END")
        self.expect("END", "LOOP")
        return Statement("while", {"cond": None, "body": body})

    def s_repeat(self):
        self.expect("REPEAT")
        body = self.block("UNTIL")
        self.expect("UNTIL")
        cond = self.expr()
        self.expect("END", "REPEAT")
        return Statement("repeat", {"cond": cond, "body": body})

    def s_for(self):
        self.expect("FOR")
        var = self.name()
        self.expect("IN", "(")
        q = self.query()
        self.expect(")", "DO")
        body = self.block("END")
        self.expect("END", "FOR")
        return Statement("for", {"var": var, "query": q, "body": body})

    def s_begin(self):
        self.expect("BEGIN")
        if self.take("TRANSACTION") or self.at(";") or self.tok.kind == "end":
            return Statement("transaction", {"do": "begin"})
        body, handler = self.block("EXCEPTION", "END"), None
        if self.take("EXCEPTION"):
            self.expect("WHEN", "ERROR", "THEN")
            handler = self.block("END")
        self.expect("END")
        return Statement("block", {"body": body, "handler": handler})

    def s_commit(self):
        self.next()
        self.take("TRANSACTION")
        return Statement("transaction", {"do": "commit"})

    def s_rollback(self):
        self.next()
        self.take("TRANSACTION")
        return Statement("transaction", {"do": "rollback"})

    def _jump(self, kind):
        self.next()
        target = self.name() if self.tok.kind == "name" and not self.at("END") else None
        return Statement("jump", {"do": kind, "target": target})

    def s_break(self):
        return self._jump("break")

    s_leave = s_break

    def s_continue(self):
        return self._jump("continue")

    s_iterate = s_continue

    def s_return(self):
        self.next()
        return Statement("jump", {"do": "return", "target": None})

    def s_raise(self):
        self.next()
        message = None
        if self.take("USING"):
            self.expect("MESSAGE", "=")
            message = self.expr()
        return Statement("raise", {"message": message})

    def s_assert(self):
        self.next()
        cond = self.expr()
        return Statement("assert", {"cond": cond, "message": self.expr() if self.take("AS") else None})

    def s_call(self):
        self.next()
        path = self.path()
        return Statement("call", {"path": path, "args": self.in_parens(self.expr)})

    def s_execute(self):
        self.expect("EXECUTE", "IMMEDIATE")
        text = self.expr()
        into = self.listed(self.name) if self.take("INTO") else []
        using = self.listed(lambda: (self.expr(), self.name() if self.take("AS") else None)) if self.take("USING") else []
        return Statement("execute", {"text": text, "into": into, "using": using})

    # definitions

    def s_create(self):
        self.expect("CREATE")
        data: dict[str, Any] = {"replace": self.take("OR", "REPLACE"), "temp": self.take("TEMP") or self.take("TEMPORARY")}
        for w in ("PRIVATE", "PUBLIC", "EXTERNAL", "SNAPSHOT", "MATERIALIZED", "AGGREGATE", "UNIQUE"):
            if self.take(w):
                data[w.lower()] = True
        what = self.name().upper()
        if what == "PROPERTY":
            self.expect("GRAPH")
            what = "GRAPH"
        if what == "TABLE" and self.take("FUNCTION"):
            what = "TABLE FUNCTION"
        data["if_not_exists"] = self.take("IF", "NOT", "EXISTS")
        if what in ("TABLE", "VIEW", "FUNCTION", "TABLE FUNCTION", "PROCEDURE", "SCHEMA", "GRAPH", "SEQUENCE"):
            data["path"] = self.path()
        if what == "TABLE":
            return self._create_table(data)
        if what == "VIEW":
            data["columns"] = self.in_parens(self.name) if self.at("(") else None
            data["options"] = self._options()
            self.expect("AS")
            data["query"] = self.query()
            return Statement("create_view", data)
        if what == "FUNCTION":
            return self._create_function(data)
        if what == "TABLE FUNCTION":
            data["params"] = self.in_parens(self._param)
            if self.take("RETURNS"):
                self.rest_until("AS")
            self.expect("AS")
            paren = self.take("(")
            data["body"] = self.query()
            if paren:
                self.expect(")")
            return Statement("create_table_function", data)
        if what == "PROCEDURE":
            data["params"] = self.in_parens(self._procedure_param)
            self._options()
            data["body"] = self.statement()
            return Statement("create_procedure", data)
        if what == "GRAPH":
            return self._create_graph(data)
        if what == "SCHEMA":
            data["options"] = self._options()
            return Statement("create_schema", data)
        if what == "SEQUENCE":
            data["options"] = self._options()
            return Statement("create_sequence", data)
        self.rest()
        return Statement("none", {"what": f"CREATE {what}"})

    def rest_until(self, word: str) -> None:
        while not self.at(word):
            self.next()

    def _param(self):
        name = self.name()
        if self.take("ANY", "TYPE"):
            return name, "ANY TYPE"
        if self.take("TABLE"):
            if self.at("<"):
                depth = 0
                while True:
                    t = self.next().text
                    depth += t.count("<") - t.count(">")
                    if not depth:
                        break
            return name, "TABLE"
        return name, self.type()

    def _procedure_param(self):
        mode = "IN"
        for w in ("INOUT", "OUT", "IN"):
            if self.at(w) and self.peek().kind == "name":
                self.next()
                mode = w
                break
        name, kind = self._param()
        return name, kind, mode

    def _options(self) -> dict:
        return self.options()

    def _create_table(self, data):
        data["columns"] = None
        if self.take("LIKE") or self.take("CLONE") or self.take("COPY"):
            data["like"] = self.path()
        if self.take("("):
            data["columns"], data["key"] = [], []
            while not self.take(")"):
                if self.take("PRIMARY", "KEY"):
                    data["key"] = self.in_parens(self.name)
                    self._enforced()
                elif self.at("CONSTRAINT") or self.at("FOREIGN"):
                    while not self.at(",") and not self.at(")"):
                        if self.at("("):
                            self.in_parens(self.expr)
                        else:
                            self.next()
                else:
                    c = {"name": self.name(), "type": self.type(), "not_null": False, "default": None, "options": {}}
                    while not self.at(",") and not self.at(")"):
                        if self.take("NOT", "NULL"):
                            c["not_null"] = True
                        elif self.take("DEFAULT"):
                            self.take("(")
                            c["default"] = self.expr()
                            self.take(")")
                        elif self.at("OPTIONS"):
                            c["options"] = self._options()
                        elif self.take("PRIMARY", "KEY"):
                            data["key"] = [c["name"]]
                            self._enforced()
                        else:
                            self.next()
                    data["columns"].append(c)
                self.take(",")
        while self.at("PARTITION") or self.at("CLUSTER") or self.at("OPTIONS") or self.at("PRIMARY"):
            if self.at("OPTIONS"):
                data["options"] = self._options()
            elif self.take("PRIMARY", "KEY"):
                data["key"] = self.in_parens(self.name)
            else:
                word = self.name()
                self.expect("BY")
                data[word.lower()] = self.listed(self.expr)
        if self.take("AS"):
            data["query"] = self.query()
        return Statement("create_table", data)

    def _enforced(self):
        if self.take("NOT", "ENFORCED") or self.take("ENFORCED"):
            pass

    def _create_function(self, data):
        data["params"] = self.in_parens(self._param)
        data["returns"] = self.type() if self.take("RETURNS") else None
        for _ in range(2):
            if not self.take("DETERMINISTIC"):
                self.take("NOT", "DETERMINISTIC")
        data["language"] = self.name().lower() if self.take("LANGUAGE") else "sql"
        self._options()
        self.expect("AS")
        if data["language"] == "sql":
            self.expect("(")
            data["body"] = self.expr() if self.tok.word not in ("SELECT", "WITH") else n.Sub("scalar", self.query())
            self.expect(")")
        else:
            data["body"] = self.next().text
            self._options()
        return Statement("create_function", data)

    def _create_graph(self, data):
        data["nodes"], data["edges"] = [], []
        for word in ("NODE", "EDGE"):
            if self.take(word, "TABLES"):
                data[word.lower() + "s"] = self.in_parens(lambda: self._graph_table())
        self._options()
        return Statement("create_graph", data)

    def _graph_table(self):
        t: dict[str, Any] = {"path": self.path(), "labels": [], "key": None, "source": None, "target": None, "properties": None}
        t["alias"] = self.name() if self.take("AS") else t["path"][-1]
        while not self.at(",") and not self.at(")"):
            if self.take("KEY"):
                t["key"] = self.in_parens(self.name)
            elif self.take("SOURCE", "KEY"):
                t["source"] = self._end()
            elif self.take("DESTINATION", "KEY"):
                t["target"] = self._end()
            elif self.take("LABEL"):
                t["labels"].append(self.name())
            elif self.take("DEFAULT", "LABEL"):
                t["labels"].append(t["alias"])
            elif self.take("PROPERTIES"):
                if self.take("ALL", "COLUMNS") or self.take("ARE", "ALL", "COLUMNS"):
                    if self.take("EXCEPT"):
                        self.in_parens(self.name)
                else:
                    t["properties"] = self.in_parens(lambda: (self.expr(), self.name() if self.take("AS") else None))
            elif self.take("NO", "PROPERTIES"):
                t["properties"] = []
            else:
                raise SyntaxProblem(f"unexpected {self.tok.text!r} in a graph table")
        t["labels"] = t["labels"] or [t["alias"]]
        return t

    def _end(self):
        own = self.in_parens(self.name)
        self.expect("REFERENCES")
        table = self.name()
        return own, table, (self.in_parens(self.name) if self.at("(") else None)

    def s_drop(self):
        self.next()
        words = [self.name().upper()]
        if words[0] == "PROPERTY":
            self.expect("GRAPH")
            words = ["GRAPH"]
        if words[0] == "TABLE" and self.take("FUNCTION"):
            words = ["TABLE FUNCTION"]
        exists = self.take("IF", "EXISTS")
        path = self.path()
        self.rest()
        return Statement("drop", {"what": words[0], "path": path, "if_exists": exists})

    def s_alter(self):
        self.next()
        what = self.name().upper()
        exists = self.take("IF", "EXISTS")
        path = self.path()
        actions = []
        while what == "TABLE":
            if self.take("ADD", "COLUMN"):
                self.take("IF", "NOT", "EXISTS")
                name = self.name()
                actions.append(("add", name, self.type()))
                while not self.at(",") and not self.at(";") and self.tok.kind != "end":
                    self.next()
            elif self.take("DROP", "COLUMN"):
                self.take("IF", "EXISTS")
                actions.append(("drop", self.name()))
            elif self.take("RENAME", "COLUMN"):
                name = self.name()
                self.expect("TO")
                actions.append(("rename_column", name, self.name()))
            elif self.take("RENAME", "TO"):
                actions.append(("rename", self.path()))
            elif self.take("SET"):
                actions.append(("options", self._options()))
            else:
                self.rest()
            if not self.take(","):
                break
        if what != "TABLE":
            self.rest()
        return Statement("alter", {"what": what, "path": path, "actions": actions, "if_exists": exists})

    def _ignored(self):
        word = self.tok.word
        self.rest()
        return Statement("none", {"what": word})

    s_grant = s_revoke = s_analyze = _ignored

    # data

    def s_insert(self):
        self.next()
        mode = "insert"
        if self.take("OR"):
            mode = self.name().lower()
        self.take("INTO")
        data: dict[str, Any] = {"path": self.path(), "columns": None, "mode": mode}
        if self.at("(") and self.peek().word not in ("SELECT", "WITH", "FROM"):
            data["columns"] = self.in_parens(self.name)
        if self.take("VALUES"):
            data["rows"] = self.listed(lambda: self.in_parens(self._value))
        else:
            data["query"] = self.query()
        return Statement("insert", data)

    def _value(self):
        return "DEFAULT" if self.take("DEFAULT") else self.expr()

    def s_update(self):
        self.next()
        path = self.path()
        alias = None if self.at("SET") else self.alias()
        self.expect("SET")
        sets = self.listed(self._assign)
        source = self.from_clause() if self.take("FROM") else None
        where = self.expr() if self.take("WHERE") else None
        return Statement("update", {"path": path, "alias": alias, "sets": sets, "source": source, "where": where})

    def _assign(self):
        path = self.path()
        self.expect("=")
        return path, self._value()

    def s_delete(self):
        self.next()
        self.take("FROM")
        path = self.path()
        alias = None if self.at("WHERE") else self.alias()
        where = self.expr() if self.take("WHERE") else None
        return Statement("delete", {"path": path, "alias": alias, "where": where})

    def s_truncate(self):
        self.next()
        self.expect("TABLE")
        return Statement("delete", {"path": self.path(), "alias": None, "where": None})

    def s_merge(self):
        self.next()
        self.take("INTO")
        data: dict[str, Any] = {"path": self.path()}
        data["alias"] = None if self.at("USING") else self.alias()
        self.expect("USING")
        data["source"] = self.table()
        self.expect("ON")
        data["on"] = self.expr()
        data["clauses"] = []
        while self.take("WHEN"):
            neg = self.take("NOT")
            self.expect("MATCHED")
            side = "matched"
            if neg:
                side = "target"
                if self.take("BY"):
                    side = self.name().lower()
            cond = self.expr() if self.take("AND") else None
            self.expect("THEN")
            if self.take("UPDATE"):
                self.expect("SET")
                action = ("update", self.listed(self._assign))
            elif self.take("DELETE"):
                action = ("delete", None)
            else:
                self.expect("INSERT")
                if self.take("ROW"):
                    action = ("row", None)
                else:
                    cols = self.in_parens(self.name) if self.at("(") else None
                    if self.take("ROW"):
                        action = ("row", None)
                    else:
                        self.expect("VALUES")
                        action = ("insert", (cols, self.in_parens(self._value)))
            data["clauses"].append((side, cond, action))
        return Statement("merge", data)

    def s_export(self):
        self.next()
        self.expect("DATA")
        if self.take("WITH", "CONNECTION"):
            self.path()
        options = self._options()
        self.expect("AS")
        return Statement("export", {"options": options, "query": self.query()})

    def s_load(self):
        self.next()
        self.expect("DATA")
        mode = self.name().upper()
        path = self.path()
        columns = self.in_parens(lambda: {"name": self.name(), "type": self.type()}) if self.at("(") else None
        self.expect("FROM", "FILES")
        options = dict(self.in_parens(self._option))
        self.rest()
        return Statement("load", {"mode": mode, "path": path, "columns": columns, "options": options})

    def s_explain(self):
        self.next()
        return Statement("explain", {"query": self.query()})

    def s_graph(self):
        self.next()
        graph = self.name()
        body = self.graph_body()
        q = n.Query(n.Select([(n.Star(), None)], source=n.GraphMatch(graph, body)))
        return Statement("query", {"query": q})

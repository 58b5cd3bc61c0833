"""A session: dialect text in, DataFrames out."""

from __future__ import annotations

import datetime as dt
import decimal
import re
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import python_functions
from . import nodes as n
from .lexer import SyntaxProblem
from .lower import SIMPLE_TYPES, Lower, ident, quote, spark_type
from .statements import ScriptParser, Statement

CONF = {"spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.timeType.enabled": "true", "spark.sql.cteRecursionLevelLimit": "-1", "spark.sql.cteRecursionRowLimit": "-1"}


class Table:
    """A managed table: immutable Parquet snapshots, so statements read one while the next is written."""

    def __init__(self, path: list[str], columns: list[dict], key: list[str], options: dict):
        self.path, self.columns, self.key, self.options = path, columns, key, options
        self.files: list[str] = []
        self.query: str | None = None  # of a view

    def copy(self) -> Table:
        out = Table(self.path, self.columns, self.key, self.options)
        out.files, out.query = list(self.files), self.query
        return out


class Jump(Exception):
    def __init__(self, kind: str, target: str | None):
        self.kind, self.target = kind, target


class ScriptError(RuntimeError):
    """Raised by RAISE and ASSERT."""


class Session:
    def __init__(self, spark: SparkSession, *, warehouse: str | None = None, now: dt.datetime | None = None, project: str = "project", dataset: str = "dataset"):
        self.spark, self.now = spark, now
        for k, v in CONF.items():
            spark.conf.set(k, v)
        python_functions.register(spark)
        self.id = uuid.uuid4().hex[:8]
        self.root = (warehouse or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/") + f"/larkspur-{self.id}"
        self.tables: dict[str, Table] = {}
        self.functions: dict[str, dict] = {}
        self.table_functions: dict[str, dict] = {}
        self.procedures: dict[str, dict] = {}
        self.graphs: dict[str, dict] = {}
        self.sequences: dict[str, int] = {}
        self.schemas: set[str] = {dataset}
        self.system = {"time_zone": "UTC", "project_id": project, "dataset_id": dataset, "dataset_project_id": project}
        self.variables: dict[str, str] = {}
        self.saved: dict[str, Table] | None = None
        self.named: dict[str, Any] = {}
        self.args: list[Any] = []
        self.versions = 0

    # entry points

    def sql(self, text: str, args: list | None = None, named: dict | None = None) -> DataFrame:
        """Run a statement or a script; the result is that of its last query (an empty frame if it has none)."""
        self.args, self.named = list(args or []), {k.lower(): v for k, v in (named or {}).items()}
        p = ScriptParser(text)
        out = None
        self.position, self.variables = 0, {}
        try:
            for s in p.script():
                r = self.run(s)
                out = r if r is not None else out
        except Jump as j:
            if j.kind != "return":
                raise SyntaxProblem(f"{j.kind} outside of a loop") from None
        return out if out is not None else self.spark.createDataFrame([], "ok boolean")

    def lowered(self, text: str) -> str:
        """The Spark SQL that a query becomes."""
        s = ScriptParser(text).script()[0]
        return self.lower().query(s.data["query"])

    def register_table(self, name: str, df: DataFrame) -> None:
        """Make a DataFrame readable under a (dotted) name."""
        view = "v_" + re.sub(r"\W", "_", name) + "_" + self.id
        df.createOrReplaceTempView(view)
        t = Table(name.split("."), [{"name": f.name, "type": f.dataType.simpleString(), "spark": f.dataType, "not_null": False, "default": None} for f in df.schema], [], {})
        t.query = f"SELECT * FROM {view}"
        self.tables[self.key_of(t.path)] = t

    def register_function(self, name: str, f, returns: str) -> None:
        """A Python function of Arrow batches (pandas_udf) or rows as a dialect function."""
        spark_name = f"lk_user_{name.lower().replace('.', '_')}_{self.id}"
        self.spark.udf.register(spark_name, f if hasattr(f, "evalType") else F.udf(f, spark_type(returns).lower(), useArrow=True))
        self.functions[name.lower()] = {"language": "python", "spark_name": spark_name}

    # helpers

    def lower(self) -> Lower:
        low = Lower(self, self.variables)
        low.positional = self.position
        return low

    def done(self, low: Lower) -> None:
        self.position = low.positional

    def key_of(self, path: list[str]) -> str:
        return ".".join(p.lower() for p in path)

    def find(self, path: list[str]) -> Table | None:
        key = self.key_of(path)
        if key in self.tables:
            return self.tables[key]
        ends = [t for k, t in self.tables.items() if k.endswith("." + key) or key.endswith("." + k)]
        return ends[0] if ends else None

    def view_of(self, t: Table) -> str:
        if t.query is not None:
            return f"({t.query})"
        view = "t_" + re.sub(r"\W", "_", self.key_of(t.path)) + "_" + self.id
        self.frame(t).createOrReplaceTempView(view)
        return view

    def frame(self, t: Table) -> DataFrame:
        if t.query is not None:
            return self.spark.sql(t.query)
        schema = self.schema_of(t)
        return self.spark.read.schema(schema).parquet(*t.files) if t.files else self.spark.createDataFrame([], schema)

    def schema_of(self, t: Table) -> T.StructType:
        text = ", ".join(f"{ident(c['name'])} {spark_type(c['type']) if 'spark' not in c else c['spark'].simpleString()}" for c in t.columns)
        return T._parse_datatype_string(text)

    def table_text(self, path: list[str]) -> str:
        from ..sources import information_schema, wildcard

        if any(p.upper() == "INFORMATION_SCHEMA" for p in path):
            return information_schema.view(self, path)
        if path[-1].endswith("*"):
            return wildcard.view(self, path)
        t = self.find(path)
        return self.view_of(t) if t else ".".join(map(ident, path))

    def literal(self, v: Any) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, int):
            return f"{v}L"
        if isinstance(v, float):
            return f"double('{v}')" if v != v or v in (float("inf"), float("-inf")) else f"{v!r}D"
        if isinstance(v, str):
            return quote(v)
        if isinstance(v, (bytes, bytearray)):
            return f"X'{bytes(v).hex()}'"
        if isinstance(v, decimal.Decimal):
            return f"CAST('{v}' AS DECIMAL(38, 9))"
        if isinstance(v, dt.datetime):
            return f"TIMESTAMP{'' if v.tzinfo else '_NTZ'}'{v.isoformat(sep=' ')}'"
        if isinstance(v, dt.date):
            return f"DATE'{v}'"
        if isinstance(v, dt.time):
            return f"TIME'{v}'"
        if isinstance(v, T.Row):
            v = v.asDict()
        if isinstance(v, dict):
            return "named_struct(" + ", ".join(f"{quote(k)}, {self.literal(x)}" for k, x in v.items()) + ")"
        return "array(" + ", ".join(map(self.literal, v)) + ")"

    def now_text(self, kind: str) -> str | None:
        return None if self.now is None else f"CAST(TIMESTAMP'{self.now.isoformat(sep=' ')}' AS {kind})"

    def value(self, e: n.Expr) -> Any:
        low = self.lower()
        text = low.x(e)
        self.done(low)
        return self.spark.sql(f"SELECT {text} AS x").first()[0]

    def next_in_sequence(self, e: n.Call) -> int:
        """The first value of a statement; each row adds its number, and the next statement starts beyond all of these."""
        name = ".".join(e.args[0].path).lower()
        first = self.sequences.get(name, 0) + 1
        self.sequences[name] = first + (1 << 52)
        return first

    def sequence_state(self, e: n.Call) -> int:
        return self.sequences.get(".".join(e.args[0].path).lower(), 0)

    # statements

    def run(self, s: Statement) -> DataFrame | None:
        return getattr(self, "r_" + s.kind)(s.data)

    def block(self, body: list[Statement]) -> DataFrame | None:
        out = None
        for s in body:
            r = self.run(s)
            out = r if r is not None else out
        return out

    def r_none(self, d):
        return None

    def r_query(self, d):
        low = self.lower()
        text = low.query(d["query"])
        self.done(low)
        return self.spark.sql(text)

    def r_explain(self, d):
        text = self.lower().query(d["query"])
        return self.spark.sql(f"EXPLAIN FORMATTED {text}")

    def r_declare(self, d):
        value = self.literal(self.value(d["value"])) if d["value"] is not None else "NULL"
        if d["type"]:
            value = f"CAST({value} AS {spark_type(d['type'])})"
        for name in d["names"]:
            self.variables[name.lower()] = value

    def r_set(self, d):
        v = self.value(d["value"])
        values = list(v) if len(d["names"]) > 1 else [v]
        for name, x in zip(d["names"], values):
            old = self.variables.get(name.lower())
            if old is None:
                raise SyntaxProblem(f"{name} is not declared")
            m = re.match(r"CAST\(.* AS ([^()]+(?:\([^()]*\))?)\)$", old, re.S)
            self.variables[name.lower()] = f"CAST({self.literal(x)} AS {m[1]})" if m else self.literal(x)

    def r_set_system(self, d):
        self.system[d["name"].lower()] = self.value(d["value"])
        if d["name"].lower() == "time_zone":
            self.spark.conf.set("spark.sql.session.timeZone", self.system["time_zone"])

    def r_if(self, d):
        for cond, body in d["branches"]:
            if self.value(cond):
                return self.block(body)
        return self.block(d["other"])

    def _loop(self, d, again, before=True):
        out = None
        while not before or again():
            try:
                r = self.block(d["body"])
                out = r if r is not None else out
            except Jump as j:
                if j.kind == "return" or (j.target and j.target != d.get("label")):
                    raise
                if j.kind == "break":
                    break
            if not before and again():
                break
        return out

    def r_while(self, d):
        return self._loop(d, (lambda: self.value(d["cond"])) if d["cond"] is not None else lambda: True)

    def r_repeat(self, d):
        return self._loop(d, lambda: self.value(d["cond"]), before=False)

    def r_for(self, d):
        out, name = None, d["var"].lower()
        kept = self.variables.get(name)
        for row in self.r_query(d).toLocalIterator():
            self.variables[name] = self.literal(row)
            try:
                r = self.block(d["body"])
                out = r if r is not None else out
            except Jump as j:
                if j.kind == "return" or (j.target and j.target != d.get("label")):
                    raise
                if j.kind == "break":
                    break
        self.variables.pop(name, None)
        if kept is not None:
            self.variables[name] = kept
        return out

    def r_block(self, d):
        outer = dict(self.variables)
        try:
            out = self.block(d["body"])
            if d["handler"] is not None and out is not None:
                out.write.format("noop").mode("overwrite").save()  # errors belong to this block
            return out
        except Jump as j:
            if j.kind == "break" and j.target and j.target == d.get("label"):
                return None
            raise
        except Exception as problem:
            if d["handler"] is None:
                raise
            self.system["error.message"] = getattr(problem, "getCondition", lambda: None)() and str(problem).split("\n")[0] or str(problem)
            return self.block(d["handler"])
        finally:
            self.variables = {k: self.variables.get(k, v) for k, v in outer.items()}

    def r_jump(self, d):
        raise Jump(d["do"], d["target"])

    def r_raise(self, d):
        raise ScriptError(self.value(d["message"]) if d["message"] is not None else self.system.get("error.message", "raised"))

    def r_assert(self, d):
        if not self.value(d["cond"]):
            raise ScriptError(self.value(d["message"]) if d["message"] is not None else "assertion failed")

    def r_call(self, d):
        p = self.procedures.get(self.key_of(d["path"])) or self.procedures.get(d["path"][-1].lower())
        if p is None:
            raise SyntaxProblem(f"no procedure {'.'.join(d['path'])}")
        outer = self.variables
        inner = {}
        for (name, kind, mode), a in zip(p["params"], d["args"]):
            value = self.literal(self.value(a)) if mode != "OUT" else "NULL"
            inner[name.lower()] = f"CAST({value} AS {spark_type(kind)})" if kind != "ANY TYPE" else value
        self.variables = dict(inner)
        try:
            body = p["body"]
            out = self.block(body.data["body"]) if body.kind == "block" else self.run(body)
        except Jump as j:
            if j.kind != "return":
                raise
            out = None
        finally:
            after, self.variables = self.variables, outer
        for (name, _, mode), a in zip(p["params"], d["args"]):
            if mode != "IN" and isinstance(a, n.Name):
                self.variables[a.path[0].lower()] = after[name.lower()]
        return out

    def r_execute(self, d):
        text = self.value(d["text"])
        args, named = self.args, self.named
        self.args = [self.value(x) for x, k in d["using"] if k is None]
        self.named = {k.lower(): self.value(x) for x, k in d["using"] if k is not None}
        kept, self.position = self.position, 0
        try:
            out = self.block(ScriptParser(text).script())
        finally:
            self.args, self.named, self.position = args, named, kept
        if d["into"]:
            row = out.first()
            for name, v in zip(d["into"], row if row is not None else [None] * len(d["into"])):
                self.variables[name.lower()] = self.literal(v)
        return out

    def r_transaction(self, d):
        if d["do"] == "begin":
            self.saved = {k: t.copy() for k, t in self.tables.items()}
        elif d["do"] == "rollback" and self.saved is not None:
            self.tables = self.saved
        if d["do"] != "begin":
            self.saved = None

    # definitions

    def options(self, found: dict | None) -> dict:
        return {k: self.value(v) for k, v in (found or {}).items()}

    def r_create_table(self, d):
        key = self.key_of(d["path"])
        if key in self.tables and not d["replace"]:
            if d["if_not_exists"]:
                return
            raise SyntaxProblem(f"table {key} exists")
        if len(d["path"]) > 1:
            self.schemas.add(d["path"][-2])
        columns, df = d["columns"], None
        if d.get("query") is not None:
            df = self.r_query(d)
            if columns is None:
                columns = [{"name": f.name, "type": f.dataType.simpleString(), "spark": f.dataType, "not_null": False, "default": None} for f in df.schema]
        elif d.get("like"):
            columns = self.find(d["like"]).columns
        t = Table(d["path"], columns or [], d.get("key") or [], self.options(d.get("options")))
        if df is not None:
            self.append(t, df.toDF(*[c["name"] for c in t.columns]))
        self.tables[key] = t

    def append(self, t: Table, df: DataFrame) -> None:
        schema = self.schema_of(t)
        out = df.select(*[F.col(ident(f.name)).cast(f.dataType).alias(f.name) for f in schema])
        for c in t.columns:
            if c["not_null"]:
                out = out.withColumn(c["name"], F.when(F.col(ident(c["name"])).isNull(), F.raise_error(F.lit(f"{c['name']} must not be null")).cast(schema[c["name"]].dataType)).otherwise(F.col(ident(c["name"]))))
        self.versions += 1
        path = f"{self.root}/{re.sub(r'[^A-Za-z0-9]', '_', self.key_of(t.path))}/{self.versions}"
        out.write.parquet(path)
        t.files = [*t.files, path]

    def store(self, df: DataFrame, name: str) -> str:
        """The path of a snapshot of df in the session's folder."""
        self.versions += 1
        path = f"{self.root}/{name}/{self.versions}"
        df.write.parquet(path)
        return path

    def rewrite(self, t: Table, df: DataFrame) -> None:
        fresh = t.copy()
        fresh.files = []
        self.append(fresh, df)
        t.files = fresh.files

    def r_create_view(self, d):
        text = self.lower().query(d["query"])
        if d["columns"]:
            text = f"SELECT * FROM ({text}) AS v({', '.join(map(ident, d['columns']))})"
        schema = self.spark.sql(text).schema
        t = Table(d["path"], [{"name": f.name, "type": f.dataType.simpleString(), "spark": f.dataType, "not_null": False, "default": None} for f in schema], [], {})
        t.query = text
        self.tables[self.key_of(d["path"])] = t

    def r_create_function(self, d):
        if d["language"] not in ("sql",):
            raise SyntaxProblem(f"functions in {d['language']} are not supported: use register_function")
        for name in {d["path"][-1].lower(), self.key_of(d["path"])}:
            self.functions[name] = d

    def r_create_table_function(self, d):
        for name in {d["path"][-1].lower(), self.key_of(d["path"])}:
            self.table_functions[name] = d

    def r_create_procedure(self, d):
        self.procedures[self.key_of(d["path"])] = d

    def r_create_schema(self, d):
        self.schemas.add(d["path"][-1])

    def r_create_sequence(self, d):
        self.sequences[self.key_of(d["path"])] = 0

    def r_create_graph(self, d):
        self.graphs[d["path"][-1].lower()] = d

    def r_drop(self, d):
        homes = {"TABLE": self.tables, "VIEW": self.tables, "FUNCTION": self.functions, "TABLE FUNCTION": self.table_functions, "PROCEDURE": self.procedures, "GRAPH": self.graphs, "SEQUENCE": self.sequences}
        home = homes.get(d["what"])
        if home is None:
            self.schemas.discard(d["path"][-1])
            return
        for key in (self.key_of(d["path"]), d["path"][-1].lower()):
            if home.pop(key, None) is not None:
                return
        if not d["if_exists"]:
            raise SyntaxProblem(f"no {d['what'].lower()} {'.'.join(d['path'])}")

    def r_alter(self, d):
        t = self.find(d["path"])
        if t is None:
            if d["what"] == "TABLE" and not d["if_exists"] and d["actions"]:
                raise SyntaxProblem(f"no table {'.'.join(d['path'])}")
            return
        for action in d["actions"]:
            df = self.frame(t)
            if action[0] == "add":
                t.columns = [*t.columns, {"name": action[1], "type": action[2], "not_null": False, "default": None}]
            elif action[0] == "drop":
                t.columns = [c for c in t.columns if c["name"].lower() != action[1].lower()]
            elif action[0] == "rename_column":
                t.columns = [c | {"name": action[2]} if c["name"].lower() == action[1].lower() else c for c in t.columns]
                self.rewrite(t, df.withColumnRenamed(action[1], action[2]))
            elif action[0] == "rename":
                del self.tables[self.key_of(t.path)]
                t.path = [*t.path[:-1], *action[1]]
                self.tables[self.key_of(t.path)] = t
            else:
                t.options |= self.options(action[1])

    # data

    def target(self, path: list[str]) -> Table:
        t = self.find(path)
        if t is None or t.query is not None:
            raise SyntaxProblem(f"no table {'.'.join(path)}")
        return t

    def defaults(self, t: Table, low: Lower) -> dict[str, str]:
        return {c["name"].lower(): low.x(c["default"]) if c["default"] is not None else "NULL" for c in t.columns}

    def r_insert(self, d):
        t, low = self.target(d["path"]), self.lower()
        names = d["columns"] or [c["name"] for c in t.columns]
        default = self.defaults(t, low)
        kinds = {f.name.lower(): f.dataType for f in self.schema_of(t)}
        if "rows" in d:
            rows = [", ".join(f"CAST({default[k.lower()] if v == 'DEFAULT' else low.x(v)} AS {kinds[k.lower()].simpleString()})" for k, v in zip(names, row)) for row in d["rows"]]
            text = "SELECT * FROM VALUES " + ", ".join(f"({r})" for r in rows) + f" AS v({', '.join(map(ident, names))})" if not re.search(r"\(SELECT|lk_", " ".join(rows)) else " UNION ALL ".join(f"SELECT {', '.join(f'{v} AS {ident(k)}' for k, v in zip(names, self._split(r)))}" for r in rows)
            df = self.spark.sql(text)
        else:
            df = self.spark.sql(low.query(d["query"])).toDF(*names)
        self.done(low)
        given = {k.lower() for k in names}
        for c in t.columns:
            if c["name"].lower() not in given:
                df = df.withColumn(c["name"], F.expr(default[c["name"].lower()]))
        if d["mode"] != "insert" and t.key:
            old = self.frame(t)
            if d["mode"] == "ignore":
                df = df.join(old.select(*t.key), t.key, "left_anti")
            else:
                self.rewrite(t, old.join(df.select(*t.key), t.key, "left_anti").unionByName(df.select(*old.columns)))
                return
        self.append(t, df)

    def _split(self, text: str) -> list[str]:
        out, depth, start = [], 0, 0
        for i, c in enumerate(text + ","):
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                out.append(text[start:i])
                start = i + 1
        return out

    def _changed(self, t: Table, sets: list, low: Lower, default: dict, alias: str) -> dict[str, str]:
        """New values by column; a path into a struct becomes a rebuilt struct."""
        new: dict[str, str] = {}
        names = {c["name"].lower(): c["name"] for c in t.columns}
        for path, v in sets:
            path = path[1:] if path[0].lower() == alias.lower() and len(path) > 1 and path[0].lower() not in names else path
            col = path[0].lower()
            value = default[col] if v == "DEFAULT" else low.x(v)
            if len(path) > 1:
                base = new.get(col, f"{ident(alias)}.{ident(names[col])}")
                value = self._with_field(self.schema_of(t)[names[col]].dataType, base, path[1:], value)
            new[col] = value
        return new

    def _with_field(self, kind: T.StructType, base: str, path: list[str], value: str) -> str:
        parts = []
        for f in kind:
            own = f"{base}.{ident(f.name)}"
            if f.name.lower() == path[0].lower():
                own = value if len(path) == 1 else self._with_field(f.dataType, own, path[1:], value)
            parts.append(f"{quote(f.name)}, {own}")
        return f"named_struct({', '.join(parts)})"

    def r_update(self, d):
        t, low = self.target(d["path"]), self.lower()
        alias = d["alias"] or d["path"][-1]
        new = self._changed(t, d["sets"], low, self.defaults(t, low), alias)
        cond = low.x(d["where"]) if d["where"] is not None else "true"
        view = self.view_of(t)
        kinds = {f.name.lower(): f.dataType.simpleString() for f in self.schema_of(t)}
        pick = lambda c, test: f"CASE WHEN {test} THEN CAST({new[c.lower()]} AS {kinds[c.lower()]}) ELSE {ident(alias)}.{ident(c)} END AS {ident(c)}" if c.lower() in new else f"{ident(alias)}.{ident(c)}"
        names = [c["name"] for c in t.columns]
        if d["source"] is None:
            text = f"SELECT {', '.join(pick(c, f'coalesce({cond}, false)') for c in names)} FROM {view} AS {ident(alias)}"
            self.done(low)
            return self.rewrite(t, self.spark.sql(text))
        source = low.from_text(d["source"])
        low_cols = ", ".join(f"{new[c]} AS {ident('__n_' + c)}" for c in new)
        # one row per target row and match; more than one match is an error
        self.frame(t).withColumn("__rid", F.monotonically_increasing_id()).createOrReplaceTempView(f"u_{self.id}")
        hits = f"SELECT {ident(alias)}.__rid AS __hit, {low_cols} FROM u_{self.id} AS {ident(alias)} CROSS JOIN {source} WHERE {cond}"
        got = self.spark.sql(hits).groupBy("__hit").agg(F.count("*").alias("__k"), *[F.first(f"__n_{c}").alias(f"__n_{c}") for c in new])
        joined = self.spark.table(f"u_{self.id}").join(got, F.col("__rid") == F.col("__hit"), "left")
        many = F.assert_true(F.coalesce(F.col("__k"), F.lit(0)) < 2, F.lit("UPDATE: a row matches several source rows"))
        joined = joined.filter(many.isNull())
        self.done(low)
        return self.rewrite(t, joined.select(*[(F.when(F.col("__hit").isNotNull(), F.col(f"__n_{c.lower()}").cast(kinds[c.lower()])).otherwise(F.col(ident(c))) if c.lower() in new else F.col(ident(c))).alias(c) for c in names]))

    def r_delete(self, d):
        t, low = self.target(d["path"]), self.lower()
        if d["where"] is None:
            t.files = []
            return
        cond = low.x(d["where"])
        self.done(low)
        alias = d["alias"] or d["path"][-1]
        self.rewrite(t, self.spark.sql(f"SELECT * FROM {self.view_of(t)} AS {ident(alias)} WHERE NOT coalesce({cond}, false)"))

    def r_merge(self, d):
        from ..operators.merge import merge

        merge(self, d)

    def r_export(self, d):
        from ..sources.files import export

        export(self.r_query(d), self.options(d["options"]))

    def r_load(self, d):
        from ..sources.files import load

        options = self.options(d["options"])
        df = load(self.spark, options, d["columns"] and ", ".join(f"{ident(c['name'])} {spark_type(c['type'])}" for c in d["columns"]))
        t = self.find(d["path"])
        if t is None:
            t = Table(d["path"], [{"name": f.name, "type": f.dataType.simpleString(), "spark": f.dataType, "not_null": False, "default": None} for f in df.schema], [], {})
            self.tables[self.key_of(d["path"])] = t
        self.rewrite(t, df) if d["mode"] == "OVERWRITE" else self.append(t, df)


def dialect_type(kind: T.DataType) -> str:
    """A Spark type's name in the dialect."""
    if isinstance(kind, T.ArrayType):
        return f"ARRAY<{dialect_type(kind.elementType)}>"
    if isinstance(kind, T.StructType):
        return "STRUCT<" + ", ".join(f"{f.name} {dialect_type(f.dataType)}" for f in kind) + ">"
    text = kind.simpleString()
    names = {v.lower().replace(" ", ""): k for k, v in reversed(SIMPLE_TYPES.items())}
    return {"bigint": "INT64", "int": "INT64", "double": "FLOAT64", "boolean": "BOOL", "string": "STRING", "binary": "BYTES", "decimal(38,9)": "NUMERIC", "timestamp_ntz": "DATETIME", "variant": "JSON"}.get(text, names.get(text, text.upper()))


__all__ = ["ScriptError", "Session", "dialect_type"]

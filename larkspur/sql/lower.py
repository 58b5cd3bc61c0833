"""Lowering: syntax trees to Spark SQL text.  Planning stays with Catalyst."""

from __future__ import annotations

import re
from typing import TYPE_CHECKING, Any

from ..functions import registry as R
from ..functions.formats import format_string, strftime_pattern
from . import nodes as n
from .lexer import SyntaxProblem

if TYPE_CHECKING:
    from .session import Session

SIMPLE_TYPES = {
    "INT64": "BIGINT", "INT": "BIGINT", "SMALLINT": "BIGINT", "INTEGER": "BIGINT", "BIGINT": "BIGINT", "TINYINT": "BIGINT", "BYTEINT": "BIGINT", "INT32": "INT", "UINT32": "BIGINT", "UINT64": "DECIMAL(20, 0)",
    "FLOAT64": "DOUBLE", "DOUBLE": "DOUBLE", "FLOAT32": "FLOAT", "FLOAT": "DOUBLE", "BOOL": "BOOLEAN", "BOOLEAN": "BOOLEAN", "STRING": "STRING", "VARCHAR": "STRING", "TEXT": "STRING", "BYTES": "BINARY", "NUMERIC": "DECIMAL(38, 9)", "DECIMAL": "DECIMAL(38, 9)",
    "BIGNUMERIC": "DECIMAL(38, 18)", "BIGDECIMAL": "DECIMAL(38, 18)", "DATE": "DATE", "DATETIME": "TIMESTAMP_NTZ", "TIMESTAMP": "TIMESTAMP", "TIME": "TIME(6)", "JSON": "VARIANT", "GEOGRAPHY": "STRING", "INTERVAL": "INTERVAL DAY TO SECOND", "UUID": "STRING", "TOKENLIST": "ARRAY<STRING>",
}
DAYS = ["SUNDAY", "MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY"]
#: 1970-01-04 was a Sunday.
SUNDAY = "DATE'1970-01-04'"
MICROS = {"MICROSECOND": 1, "MILLISECOND": 1_000, "SECOND": 1_000_000, "MINUTE": 60_000_000, "HOUR": 3_600_000_000, "DAY": 86_400_000_000}
NAMES_AS_TEXT = frozenset("YEAR QUARTER MONTH WEEK ISOWEEK ISOYEAR DAY DAYOFWEEK DAYOFYEAR HOUR MINUTE SECOND MILLISECOND MICROSECOND NANOSECOND NFC NFKC NFD NFKD".split())


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\0", "\\0") + "'"


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def spark_type(kind: str) -> str:
    """A type of the dialect as a Spark SQL type."""
    kind = kind.strip()
    m = re.fullmatch(r"(\w+)\s*<(.*)>", kind, re.S)
    if m and m[1].upper() == "ARRAY":
        return f"ARRAY<{spark_type(m[2])}>"
    if m and m[1].upper() == "RANGE":
        return f"STRUCT<start: {spark_type(m[2])}, end: {spark_type(m[2])}>"
    if m:
        parts, depth, start = [], 0, 0
        for i, c in enumerate(m[2] + ","):
            depth += (c in "<(") - (c in ">)")
            if c == "," and not depth:
                name, _, t = m[2][start:i].strip().partition(" ")
                parts.append(f"{ident(name)}: {spark_type(t)}")
                start = i + 1
        return "STRUCT<" + ", ".join(parts) + ">"
    base, _, args = kind.partition("(")
    base = base.upper()
    if base in ("NUMERIC", "DECIMAL", "BIGNUMERIC", "BIGDECIMAL") and args:
        p = args.rstrip(")").split(",")
        return f"DECIMAL({p[0]}, {p[1] if len(p) > 1 else 0})"
    if base not in SIMPLE_TYPES:
        raise SyntaxProblem(f"unknown type {kind}")
    return SIMPLE_TYPES[base]


def mirrored(x: str, kind: str) -> str | None:
    """A value that falls where x of a Spark type rises (NaN, above all numbers, becomes null, below all), None for types that have none."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return f"~({x})"
    if kind in ("float", "double"):
        return f"if(isnan({x}), NULL, -({x}))"
    if kind in ("string", "binary"):  # the digits' complements, and an end above all of them
        return f"concat(translate(hex({x}), '0123456789ABCDEF', 'FEDCBA9876543210'), 'G')"
    forms = {"decimal": f"-({x})", "boolean": f"NOT ({x})", "date": f"-unix_date({x})", "timestamp": f"-unix_micros({x})", "timestamp_ntz": f"TIMESTAMP_NTZ'1970-01-01 00:00:00' - ({x})"}
    return forms.get(kind.split("(")[0])


class Lower:
    """Lowers one statement.  scope: CTE names in reach; prelude: their text, for questions to the analyzer."""

    def __init__(self, session: Session, variables: dict[str, str] | None = None):
        self.s, self.vars = session, variables or {}
        self.ctes: list[tuple[str, str]] = []
        self.names = 0
        self.locals: list[set[str]] = []
        self.substitute: dict[str, str] = {}
        self.positional = 0
        self.recursive = False
        self.pipe_alias = "__pipe"
        self.views: dict[str, str] = {}
        self.source_text: str | None = None
        self.known_types: dict[str, set[str]] = {}
        self.extra_joins: list[str] = []
        self.where_text = ""

    def fresh(self, stem: str = "t") -> str:
        self.names += 1
        return f"__{stem}{self.names}"

    # questions to the analyzer

    def _prelude(self) -> str:
        return ("WITH " + ("RECURSIVE " if self.recursive else "") + ", ".join(f"{ident(k)} AS ({v})" for k, v in self.ctes) + " ") if self.ctes else ""

    def schema(self, query: str):
        return self.s.spark.sql(self._prelude() + query).schema

    def columns(self, source: str) -> list[str]:
        return self.schema(f"SELECT * FROM {source} LIMIT 0").names

    def kind(self, expr: str, source: str | None = None) -> str:
        """The Spark type of an expression over a FROM text (that of the SELECT at hand), '' where it can't be told apart from its context."""
        source = source or self.source_text
        try:
            return self.schema(f"SELECT {expr} AS x" + (f" FROM {source}" if source else "")).fields[0].dataType.simpleString()
        except Exception:  # an outer reference, for instance
            return ""

    # expressions

    def x(self, e: n.Expr) -> str:
        return getattr(self, "x_" + type(e).__name__.lower())(e)

    def xs(self, es: list[n.Expr]) -> list[str]:
        return [self.x(e) for e in es]

    def x_lit(self, e: n.Lit) -> str:
        k, v = e.kind, e.value
        if k == "int":
            if not -(1 << 63) <= int(v) < 1 << 63:
                return f"CAST('{v}' AS DECIMAL(20, 0))"
            return f"({v}L)" if v.startswith("-") else f"{v}L"
        if k == "float":
            return f"({v}D)" if v.startswith("-") else f"{v}D"
        if k == "string":
            return quote(v)
        if k == "bytes":
            return "X'" + v.encode("latin-1", "ignore").hex() + "'" if all(ord(c) < 256 for c in v) else "X'" + v.encode().hex() + "'"
        if k == "bool":
            return v
        if k == "null":
            return "NULL"
        if k == "numeric":
            return f"CAST({quote(v)} AS DECIMAL(38, 9))"
        if k == "bignumeric":
            return f"CAST({quote(v)} AS DECIMAL(38, 18))"
        if k == "json":
            return f"parse_json({quote(v)})"
        if k == "datetime":
            return f"TIMESTAMP_NTZ{quote(v.replace('T', ' '))}"
        return f"{k.upper()}{quote(v)}"

    def x_name(self, e: n.Name) -> str:
        head = e.path[0]
        if len(e.path) == 1 or head.lower() in self.vars:
            if head in self.substitute:
                return ".".join([self.substitute[head], *map(ident, e.path[1:])])
            if any(head in s for s in self.locals):
                return ".".join(map(ident, e.path))
            if head.lower() in self.vars:
                return ".".join([self.vars[head.lower()], *map(ident, e.path[1:])])
        for at in range(1, min(3, len(e.path))):  # a JSON column and a path into it
            if self.is_json(e.path[:at]):
                return f"try_variant_get({'.'.join(map(ident, e.path[:at]))}, {quote('$' + ''.join(f'.{x}' for x in e.path[at:]))}, 'variant')"
        return ".".join(map(ident, e.path))

    def is_json(self, path: list[str]) -> bool:
        """Whether the column of the SELECT at hand that this name ends in holds JSON."""
        if self.source_text is None:
            return False
        if self.source_text not in self.known_types:
            try:
                fields = self.schema(f"SELECT * FROM {self.source_text} LIMIT 0").fields
            except Exception:  # an outer reference, for instance
                fields = []
            self.known_types[self.source_text] = {f.name.lower() for f in fields if f.dataType.simpleString() == "variant"}
        known = self.known_types[self.source_text]
        return path[-1].lower() in known and (len(path) == 1 or path[0].lower() not in known)

    def x_param(self, e: n.Param) -> str:
        if e.system:
            return quote(str(self.s.system.get(e.name.lower(), "")))
        if e.name is None:
            value = self.s.args[self.positional]
            self.positional += 1
        else:
            value = self.s.named.get(e.name.lower(), self.s.named.get(e.name))
        return self.s.literal(value)

    def x_star(self, e: n.Star) -> str:
        return "*" if e.of is None else f"{e.of}.*"

    def x_unary(self, e: n.Unary) -> str:
        return f"(NOT {self.x(e.x)})" if e.op == "NOT" else f"({e.op}{self.x(e.x)})"

    def x_binary(self, e: n.Binary) -> str:
        if isinstance(e.b, n.Interval) and e.op in "+-":
            return self.add_interval(self.x(e.a), e.b, e.op == "-")
        a, b = self.x(e.a), self.x(e.b)
        if e.op == "<<":
            return f"(CASE WHEN {b} < 0 THEN raise_error('shift by a negative number') WHEN {b} > 63 THEN 0L ELSE shiftleft({a}, int({b})) END)"
        if e.op == ">>":
            return f"(CASE WHEN {b} < 0 THEN raise_error('shift by a negative number') WHEN {b} > 63 THEN 0L ELSE shiftrightunsigned({a}, int({b})) END)"
        if e.op in ("=", "<>") and isinstance(e.a, n.StructLit) != isinstance(e.b, n.StructLit):
            return f"({a} {e.op} {b})"
        return f"({a} {e.op} {b})"

    def x_between(self, e: n.Between) -> str:
        return f"({self.x(e.x)} {'NOT ' * e.negated}BETWEEN {self.x(e.low)} AND {self.x(e.high)})"

    def x_inlist(self, e: n.InList) -> str:
        neg = "NOT " * e.negated
        if e.unnest is not None:
            return f"({neg}array_contains({self.x(e.unnest)}, {self.x(e.x)}))"
        if e.query is not None:
            return f"({self.x(e.x)} {neg}IN ({self.query(e.query)}))"
        return f"({self.x(e.x)} {neg}IN ({', '.join(self.xs(e.items))}))"

    def x_like(self, e: n.Like) -> str:
        neg = "NOT " * e.negated
        if e.how and isinstance(e.patterns[0], n.Call):
            f = "forall" if e.how == "ALL" else "exists"
            x = self.x(e.x)
            return f"({neg}{f}({self.x(e.patterns[0].args[0])}, __p -> {x} LIKE __p))"
        if e.how:
            return f"({self.x(e.x)} {neg}LIKE {e.how} ({', '.join(self.xs(e.patterns))}))"
        return f"({self.x(e.x)} {neg}LIKE {self.x(e.patterns[0])})"

    def x_is(self, e: n.Is) -> str:
        return f"({self.x(e.x)} IS {'NOT ' * e.negated}{e.what})"

    def x_distinct(self, e: n.Distinct) -> str:
        return f"({'' if e.negated else 'NOT '}({self.x(e.a)} <=> {self.x(e.b)}))"

    def x_case(self, e: n.Case) -> str:
        head = f" {self.x(e.of)}" if e.of is not None else ""
        tail = f" ELSE {self.x(e.other)}" if e.other is not None else ""
        return f"(CASE{head} " + " ".join(f"WHEN {self.x(a)} THEN {self.x(b)}" for a, b in e.whens) + f"{tail} END)"

    def x_cast(self, e: n.Cast) -> str:
        f = "try_cast" if e.safe else "CAST"
        x, kind = self.x(e.x), e.type.upper()
        if e.format is not None and isinstance(e.format, n.Lit):
            return self.cast_format(x, kind, e.format.value, e.safe)
        have = self.kind(x)
        to = spark_type(e.type)
        if to == "BIGINT" and have in ("double", "float") or (to == "BIGINT" and have.startswith("decimal")):
            x = f"round({x})"
        elif to == "BIGINT" and (have == "string" or not have):
            return f"(CASE WHEN lower(CAST({x} AS STRING)) RLIKE '^[-+]?0x' THEN CAST(conv(regexp_replace(lower(CAST({x} AS STRING)), '0x', ''), 16, 10) AS BIGINT) ELSE {f}({x} AS BIGINT) END)" if have == "string" else f"{f}({x} AS BIGINT)"
        elif to == "STRING" and have in ("double", "float"):
            return f"regexp_replace(CAST({x} AS STRING), '\\\\.0$', '')"
        elif to == "STRING" and have == "timestamp":
            return f"concat(CAST({x} AS STRING), '+00')"
        elif to == "STRING" and have.startswith("decimal"):
            return f"regexp_replace(regexp_replace(CAST({x} AS STRING), '(\\\\.[0-9]*?)0+$', '$1'), '\\\\.$', '')"
        elif to == "VARIANT" and have == "string":
            return f"parse_json({x})"
        elif to == "TIMESTAMP_NTZ" and have == "timestamp":
            return f"to_timestamp_ntz(CAST({x} AS STRING))"
        return f"{f}({x} AS {to})"

    def cast_format(self, x: str, kind: str, fmt: str, safe: bool) -> str:
        pattern = fmt
        for a, b in (("YYYY", "yyyy"), ("MONTH", "MMMM"), ("MON", "MMM"), ("MM", "MM"), ("DDD", "DDD"), ("DD", "dd"), ("DAY", "EEEE"), ("HH24", "HH"), ("HH12", "hh"), ("HH", "hh"), ("MI", "mm"), ("SS", "ss"), ("AM", "a"), ("PM", "a")):
            pattern = re.sub(a, b, pattern, flags=0)
        have = self.kind(x)
        if kind == "STRING":
            if have == "binary":
                return {"HEX": f"lower(hex({x}))", "BASE64": f"base64({x})", "UTF-8": f"CAST({x} AS STRING)"}.get(fmt.upper(), f"decode({x}, {quote(fmt)})")
            if have in ("date", "timestamp", "timestamp_ntz"):
                return f"date_format({x}, {quote(pattern)})"
            return f"btrim(to_char({x}, {quote(fmt)}))"
        if kind == "BYTES":
            return {"HEX": f"unhex({x})", "BASE64": f"unbase64({x})"}.get(fmt.upper(), f"encode({x}, {quote(fmt)})")
        f = {"DATE": "try_to_date" if safe else "to_date", "DATETIME": "to_timestamp_ntz", "TIMESTAMP": "try_to_timestamp" if safe else "to_timestamp"}.get(kind)
        return f"{f}({x}, {quote(pattern)})" if f else f"to_number({x}, {quote(fmt)})"

    def x_interval(self, e: n.Interval) -> str:
        amount = e.amount
        if e.to is None and isinstance(amount, n.Lit) and amount.kind == "int" and e.unit != "QUARTER":
            unit, v = e.unit, int(amount.value)
            if unit == "WEEK":
                unit, v = "DAY", v * 7
            if unit == "MILLISECOND":
                return f"INTERVAL '{v / 1000:.3f}' SECOND"
            if unit == "MICROSECOND":
                return f"INTERVAL '{v / 1e6:.6f}' SECOND"
            return f"INTERVAL '{v}' {unit}"
        if e.to is not None:
            return f"INTERVAL {self.x(amount)} {e.unit} TO {e.to}"
        v = self.x(amount)
        if e.unit in ("YEAR", "MONTH", "QUARTER"):
            return f"make_ym_interval(0, int({v}) * {dict(YEAR=12, MONTH=1, QUARTER=3)[e.unit]})"
        per = {"WEEK": 7 * MICROS["DAY"]} | MICROS
        return f"make_dt_interval(0, 0, 0, CAST({v} AS DECIMAL(20, 0)) * {per[e.unit]} / 1000000)"

    def add_interval(self, x: str, i: n.Interval, minus: bool) -> str:
        sign = "-" if minus else "+"
        if i.to is None and i.unit in ("YEAR", "MONTH", "QUARTER"):
            months = f"int({self.x(i.amount)}) * {dict(YEAR=12, MONTH=1, QUARTER=3)[i.unit]}"
            return f"({x} {sign} make_ym_interval(0, {months}))"
        return f"({x} {sign} {self.x_interval(i)})"

    def x_extract(self, e: n.Extract) -> str:
        x = self.x(e.x)
        if e.zone is not None:
            x = f"from_utc_timestamp({x}, {self.x(e.zone)})"
        part = e.part
        if part == "DATE":
            return f"CAST({x} AS DATE)"
        if part == "TIME":
            return self.as_time(x)
        if part == "DATETIME":
            return f"CAST({x} AS TIMESTAMP_NTZ)"
        if part == "ISOYEAR":
            return f"bigint(extract(YEAROFWEEK FROM {x}))"
        if part == "ISOWEEK":
            return f"bigint(weekofyear({x}))"
        if part.startswith("WEEK"):
            day = DAYS.index(part[5:-1]) if "(" in part else 0
            return f"bigint(floor((dayofyear({x}) - 1 + pmod(dayofweek(make_date(year({x}), 1, 1)) - 1 - {day}, 7)) / 7) + if(pmod(dayofweek(make_date(year({x}), 1, 1)) - 1 - {day}, 7) = 0, 1, 0))"
        if part in ("MICROSECOND", "MILLISECOND"):
            return f"bigint(extract(SECOND FROM {x}) * {1_000_000 if part[1:3] == 'IC' else 1000}) % {1_000_000 if part[1:3] == 'IC' else 1000}"
        if part == "DAYOFYEAR":
            return f"bigint(dayofyear({x}))"
        if part == "SECOND":
            return f"bigint(floor(extract(SECOND FROM {x})))"
        return f"bigint(extract({part} FROM {x}))"

    def x_arraylit(self, e: n.ArrayLit) -> str:
        kinds = [x for x in e.items if isinstance(x, n.StructLit)]
        if kinds:  # names of the first struct hold for all
            first = e.items[0]
            names = [a or (x.path[-1] if isinstance(x, n.Name) else f"_{i + 1}") for i, (x, a) in enumerate(first.items)] if first.types is None else [k or f"_{i + 1}" for i, (k, _) in enumerate(first.types)]
            for x in e.items:
                if isinstance(x, n.StructLit):
                    x.items = [(v, name) for (v, _), name in zip(x.items, names)]
        text = f"array({', '.join(self.xs(e.items))})"
        return f"CAST({text} AS ARRAY<{spark_type(e.type)}>)" if e.type else text

    def x_structlit(self, e: n.StructLit) -> str:
        names = [k for k, _ in e.types] if e.types else [a or (x.path[-1] if isinstance(x, n.Name) else None) for x, a in e.items]
        values = self.xs([x for x, _ in e.items])
        if e.types:
            values = [f"CAST({v} AS {spark_type(t)})" for v, (_, t) in zip(values, e.types)]
        return "named_struct(" + ", ".join(f"{quote(k or f'_{i + 1}')}, {v}" for i, (k, v) in enumerate(zip(names, values))) + ")"

    def x_sub(self, e: n.Sub) -> str:
        if e.kind == "exists":
            return f"EXISTS ({self.query(e.query)})"
        text = self.query(e.query)
        if e.kind == "scalar":
            return f"({text})"
        q = e.query
        body = q.body
        if isinstance(body, n.Select) and len(body.items) == 1 and not isinstance(body.items[0][0], n.Star) and body.as_kind is None and not q.ctes:
            # ARRAY(SELECT x FROM ... ORDER BY y): keep the order by collecting (keys, x)
            keys = [self.x(o.x) for o in q.order]
            source = self.from_text(body.source) if body.source is not None else None
            if not body.group and not body.distinct and not body.qualify and q.limit is None and source is not None:
                where = f" WHERE {self.x(body.where)}" if body.where is not None else ""
                return f"coalesce((SELECT {self.collect(self.x(body.items[0][0]), q.order, keys)} FROM {source}{where}), array())"
        name = self.fresh("a")
        return f"coalesce((SELECT transform(collect_list(struct({name}.*)), __e -> __e.{self._only(text)}) FROM ({text}) AS {name}), array())"

    def _only(self, text: str) -> str:
        try:
            return ident(self.schema(text).names[0])
        except Exception:
            return "x"

    def collect(self, value: str, order: list[n.Order], keys: list[str] | None = None, limit: str | None = None, keep_null: bool = True) -> str:
        """An array of value, ordered; nulls are kept inside structs."""
        keys = keys if keys is not None else [self.x(o.x) for o in order]
        fields = ", ".join([f"{k} AS k{i}" for i, k in enumerate(keys)] + [f"{value} AS v"])
        rows = f"collect_list(struct({fields}))"
        if not keep_null:
            rows = f"filter({rows}, __r -> __r.v IS NOT NULL)"
        if order:
            tests = []
            for i, o in enumerate(order):
                first = (o.nulls == "FIRST") if o.nulls else not o.down
                low = "-1" if first else "1"
                high = "1" if first else "-1"
                less, more = ("1", "-1") if o.down else ("-1", "1")
                tests.append(f"WHEN __l.k{i} IS NULL AND __r.k{i} IS NOT NULL THEN {low} WHEN __l.k{i} IS NOT NULL AND __r.k{i} IS NULL THEN {high} WHEN __l.k{i} < __r.k{i} THEN {less} WHEN __l.k{i} > __r.k{i} THEN {more}")
            rows = f"array_sort({rows}, (__l, __r) -> CASE {' '.join(tests)} ELSE 0 END)"
        if limit:
            rows = f"slice({rows}, 1, int({limit}))"
        return f"transform({rows}, __r -> __r.v)"

    def x_field(self, e: n.Field) -> str:
        x = self.x(e.x)
        if self.kind(x) == "variant":
            return f"variant_get({x}, {quote('$.' + e.name)}, 'variant')"
        return f"{x}.{ident(e.name)}" if isinstance(e.x, (n.Name, n.Field)) else f"({x}).{ident(e.name)}"

    def x_index(self, e: n.Index) -> str:
        x, at = self.x(e.x), self.x(e.at)
        if e.how == "OFFSET":
            return f"{x}[int({at})]"
        if e.how == "SAFE_OFFSET":
            return f"get({x}, int({at}))"
        if e.how == "ORDINAL":
            return f"element_at({x}, int({at}))"
        if e.how == "SAFE_ORDINAL":
            return f"if({at} < 1, NULL, try_element_at({x}, int({at})))"
        if isinstance(e.at, n.Lit) and e.at.kind == "string":
            return f"try_variant_get({x}, {quote('$.' + e.at.value)}, 'variant')"
        if self.kind(x) == "variant":
            return f"try_variant_get({x}, {quote(f'$[{e.at.value}]')}, 'variant')"
        return f"{x}[int({at})]"

    def x_lambda(self, e: n.Lambda) -> str:
        self.locals.append(set(e.names))
        body = self.x(e.body)
        self.locals.pop()
        return f"({', '.join(map(ident, e.names))}) -> {body}" if len(e.names) > 1 else f"{ident(e.names[0])} -> {body}"

    def x_with(self, e: n.With) -> str:
        old = dict(self.substitute)
        for key, value in e.items:
            self.substitute[key] = self.x(value)
        body = self.x(e.body)
        self.substitute = old
        return body

    # calls

    def x_call(self, e: n.Call) -> str:
        name = e.name
        if (f := self.s.functions.get(name.lower())) is not None:
            return self.inline(f, e)
        special = getattr(self, "f_" + name.lower().replace(".", "_"), None)
        text = special(e) if special else None
        if text is None:
            if name == "S2_CELLIDFROMPOINT" and "level" in e.named:
                e.args.append(e.named.pop("level"))
            args = [quote(a.path[0].upper()) if isinstance(a, n.Name) and len(a.path) == 1 and a.path[0].upper() in NAMES_AS_TEXT and name in ("NORMALIZE", "NORMALIZE_AND_CASEFOLD") else self.x(a) for a in e.args]
            if e.safe and name in R.SAFE:
                text = R.fill(R.SAFE[name], args, name)
            elif name in R.AGGREGATES and not (e.over is None and name not in R.AGGREGATES):
                text = R.fill(R.AGGREGATES[name], args, name)
                if e.distinct:
                    text = text.replace("(", "(DISTINCT ", 1)
                if e.having:
                    text = self.extreme(e.having[0] == "MAX", args[0], self.x(e.having[1])) if name == "ANY_VALUE" else text
            elif name in R.WINDOWS:
                text = R.fill(R.WINDOWS[name], args, name)
                if e.nulls == "IGNORE":
                    text += " IGNORE NULLS"
            elif name in R.SKETCHES:
                text = R.fill(R.SKETCHES[name], args, name)
            elif name in R.SCALARS:
                text = R.fill(R.SCALARS[name], args, name)
                if "{sum}" in text:
                    inner = self.kind(args[0])
                    text = text.replace("{sum}", "DOUBLE" if "double" in inner or "float" in inner else "DECIMAL(38, 9)" if "decimal" in inner else "BIGINT")
            elif name in R.SERVICES:
                raise SyntaxProblem(f"{name} asks a service: register a function under this name")
            else:
                raise SyntaxProblem(f"unknown function {name}")
        if e.over is not None:
            if e.distinct and name in ("COUNT", "SUM", "AVG"):
                return self.distinct_window(e)
            text = f"{text} OVER {self.window(e.over)}"
        return text

    def distinct_window(self, e: n.Call) -> str:
        rows = f"collect_set({self.x(e.args[0])}) OVER {self.window(e.over)}"
        if e.name == "COUNT":
            return f"bigint(size({rows}))"
        if e.name == "AVG":
            return f"(aggregate({rows}, 0D, (__s, __v) -> __s + double(__v)) / nullif(size({rows}), 0))"
        kind = self.kind(f"sum({self.x(e.args[0])})", self.source_text) or "double"
        return f"aggregate({rows}, CAST(NULL AS {kind}), (__s, __v) -> CAST(coalesce(__s + __v, __v) AS {kind}))"

    def window(self, w: n.Window | str) -> str:
        if isinstance(w, str):
            return ident(w)
        parts = []
        if w.base:
            base = self.windows.get(w.base.lower()) if hasattr(self, "windows") else None
            if base is not None:  # a named window that is refined
                w = n.Window(None, w.partition or base.partition, w.order or base.order, None, w.frame_parts or base.frame_parts)
            else:
                return ident(w.base)
        if w.partition:
            parts.append("PARTITION BY " + ", ".join(self.xs(w.partition)))
        if w.order:
            parts.append("ORDER BY " + ", ".join(self.order(o) for o in w.order))
        if w.frame_parts:
            kind, low, high = w.frame_parts
            bound = lambda b: b[0] if b[1] is None else f"{b[1].value if isinstance(b[1], n.Lit) and b[1].kind == 'int' else self.x(b[1])} {b[0]}"
            parts.append(f"{kind} BETWEEN {bound(low)} AND {bound(high)}")
        return f"({' '.join(parts)})"

    def order(self, o: n.Order) -> str:
        x = o.x.value if isinstance(o.x, n.Lit) and o.x.kind == "int" else self.x(o.x)
        nulls = o.nulls or ("LAST" if o.down else "FIRST")
        return f"{x} {'DESC' if o.down else 'ASC'} NULLS {nulls}"

    def inline(self, f: dict, e: n.Call) -> str:
        if f["language"] != "sql":
            return f"{f['spark_name']}({', '.join(self.xs(e.args))})"
        old, self.substitute = self.substitute, {}
        args = []
        for (name, kind), a in zip(f["params"], e.args):
            self.substitute = old
            v = self.x(a)
            args.append((name, v if kind in (None, "ANY TYPE") else f"CAST({v} AS {spark_type(kind)})"))
        self.substitute = dict(args)
        body = self.x(f["body"])
        self.substitute = old
        return f"CAST({body} AS {spark_type(f['returns'])})" if f.get("returns") else f"({body})"

    def f_count(self, e):
        if e.args and isinstance(e.args[0], n.Star) or not e.args:
            return "count(*)"
        return f"count({'DISTINCT ' * e.distinct}{', '.join(self.xs(e.args))})"

    def f_sum(self, e):
        x = self.x(e.args[0])
        if isinstance(e.args[0], n.Lit) and e.args[0].kind == "bool":
            return None
        return f"sum({'DISTINCT ' * e.distinct}{x})"

    def f_array_agg(self, e):
        x = self.x(e.args[0])
        limit = self.x(e.limit) if e.limit is not None else None
        if e.over is not None:
            return f"collect_list({x})"
        if e.distinct and not e.order:
            return f"nullif(collect_set({x}), array())"
        text = self.collect(x, e.order, None, None, keep_null=e.nulls != "IGNORE")
        if e.distinct:
            text = f"array_distinct({text})"
        if limit:
            text = f"slice({text}, 1, int({limit}))"
        return f"if(count(*) = 0, NULL, {text})"

    def f_string_agg(self, e):
        x = self.x(e.args[0])
        mark = self.x(e.args[1]) if len(e.args) > 1 else "','"
        if e.over is not None:
            return None if False else f"array_join(collect_list({x}) OVER {self.window(e.over)}, {mark})" + self._drop_over(e)
        text = self.collect(x, e.order, None, None, keep_null=False)
        if e.distinct:
            text = f"array_distinct({text})"
        if e.limit is not None:
            text = f"slice({text}, 1, int({self.x(e.limit)}))"
        return f"if(count({x}) = 0, NULL, array_join({text}, {mark}))"

    def _drop_over(self, e) -> str:
        e.over = None
        return ""

    def f_approx_quantiles(self, e):
        k = int(e.args[1].value)
        return f"percentile_approx({self.x(e.args[0])}, array({', '.join(f'{i / k!r}D' for i in range(k + 1))}), 10000)"

    def f_approx_top_count(self, e):
        return f"transform(approx_top_k({self.x(e.args[0])}, int({self.x(e.args[1])})), __t -> named_struct('value', __t.item, 'count', __t.count))"

    def f_approx_top_sum(self, e):
        x, w, k = self.xs(e.args)
        groups = f"aggregate(collect_list(struct({x} AS k, {w} AS w)), map_from_arrays(array_distinct(collect_list({x})), transform(array_distinct(collect_list({x})), __k -> 0L)), (__m, __r) -> transform_values(__m, (__k, __v) -> if(__k = __r.k, __v + __r.w, __v)))"
        return f"slice(transform(array_sort(transform(map_entries({groups}), __e -> struct(-__e.value AS s, __e.key AS k))), __e -> named_struct('value', __e.k, 'sum', -__e.s)), 1, int({k}))"

    def _percentile(self, e, name):
        x, p = self.xs(e.args[:2])
        return f"{name}({p}) WITHIN GROUP (ORDER BY {x})"

    def f_percentile_cont(self, e):
        return self._percentile(e, "percentile_cont")

    def f_percentile_disc(self, e):
        return self._percentile(e, "percentile_disc")

    def f_min(self, e):
        x = self.x(e.args[0])
        if e.over is None and self.kind(x) in ("double", "float"):
            return f"if(bool_or(isnan({x})), double('NaN'), min({x}))"
        return None

    def f_max_by(self, e):
        return self.extreme(True, *self.xs(e.args)) if len(e.args) == 2 else None

    def f_min_by(self, e):
        return self.extreme(False, *self.xs(e.args)) if len(e.args) == 2 else None

    def extreme(self, most: bool, x: str, y: str) -> str:
        """The x of the most or least y, null x and null y aside; of equal y the least x, so that no order of the rows decides. Types without an order or a mirror leave ties open."""
        kind, key = self.kind(x), y
        if kind and kind != "interval" and not re.search(r"variant|map<", kind):
            if not most:
                key = f"struct({y}, {x})"
            elif (down := mirrored(y, self.kind(y))) is not None:
                most, key = False, f"struct({down}, {x})"
            elif (down := mirrored(x, kind)) is not None:
                key = f"struct({y}, {down})"
        return f"{'max_by' if most else 'min_by'}({x}, if(({x}) IS NULL OR ({y}) IS NULL, NULL, {key}))"

    def f_is_first(self, e):
        k = self.x(e.args[0]) if e.args else "1"
        w, e.over = self.window(e.over), None
        return f"(row_number() OVER {w} <= {k})"

    def f_is_last(self, e):
        k = self.x(e.args[0]) if e.args else "1"
        w = e.over
        e.over = None
        back = n.Window(w.base, w.partition, [n.Order(o.x, not o.down, {"FIRST": "LAST", "LAST": "FIRST"}.get(o.nulls)) for o in w.order])
        return f"(row_number() OVER {self.window(back)} <= {k})"

    def _extreme(self, e, f):
        args = self.xs(e.args)
        return f"if({' OR '.join(f'({a}) IS NULL' for a in args)}, NULL, {f}({', '.join(args)}))" if len(args) > 1 else args[0]

    def f_greatest(self, e):
        return self._extreme(e, "greatest")

    def f_least(self, e):
        return self._extreme(e, "least")

    def f_array_includes(self, e):
        if isinstance(e.args[1], n.Lambda):
            return f"exists({', '.join(self.xs(e.args))})"
        return f"array_contains({', '.join(self.xs(e.args))})"

    def f_array_zip(self, e):
        lambdas = [a for a in e.args if isinstance(a, n.Lambda)]
        arrays = [a for a in e.args if not isinstance(a, n.Lambda)]
        mode = e.named.get("mode")
        mode = mode.value.upper() if isinstance(mode, n.Lit) else "STRICT"
        items = [a.items[0] if isinstance(a, n.StructLit) else (a, None) for a in arrays]
        texts = [self.x(x) for x, _ in items]
        names = [k or (x.path[-1] if isinstance(x, n.Name) else f"_{i + 1}") for i, (x, k) in enumerate(items)]
        size = ("least(" if mode == "TRUNCATE" else "greatest(") + ", ".join(f"size({t})" for t in texts) + ")"
        rows = f"transform(slice(sequence(0, greatest({size} - 1, 0)), 1, {size}), __i -> named_struct({', '.join(f'{quote(k)}, get({t}, __i)' for k, t in zip(names, texts))}))"
        if mode == "STRICT":
            rows = f"if({' OR '.join(f'size({t}) <> size({texts[0]})' for t in texts[1:])}, raise_error('ARRAY_ZIP: the arrays have different lengths'), {rows})"
        if lambdas:
            body = lambdas[0]
            old = dict(self.substitute)
            for k, key in zip(body.names, names):
                self.substitute[k] = f"__z.{ident(key)}"
            rows = f"transform({rows}, __z -> {self.x(body.body)})"
            self.substitute = old
        return rows

    # dates and times

    def _unit(self, e: n.Expr) -> str:
        if isinstance(e, n.Call):
            return f"{e.name}({e.args[0].path[0].upper()})"
        return e.path[0].upper()

    def f_date(self, e):
        a = self.xs(e.args)
        if len(a) == 3:
            return f"make_date(int({a[0]}), int({a[1]}), int({a[2]}))"
        if len(a) == 2:
            return f"CAST(from_utc_timestamp({a[0]}, {a[1]}) AS DATE)"
        return f"CAST({a[0]} AS DATE)"

    def f_datetime(self, e):
        a = self.xs(e.args)
        if len(a) == 6:
            return f"make_timestamp_ntz(int({a[0]}), int({a[1]}), int({a[2]}), int({a[3]}), int({a[4]}), CAST({a[5]} AS DECIMAL(16, 6)))"
        if len(a) == 2 and not isinstance(e.args[1], n.Lit):
            return f"to_timestamp_ntz(concat(CAST({a[0]} AS STRING), ' ', CAST({a[1]} AS STRING)))"
        if len(a) == 2:
            return f"CAST(from_utc_timestamp({a[0]}, {a[1]}) AS TIMESTAMP_NTZ)"
        return f"CAST({a[0]} AS TIMESTAMP_NTZ)"

    def f_timestamp(self, e):
        a = self.xs(e.args)
        return f"CAST({a[0]} AS TIMESTAMP)" if len(a) == 1 else f"to_utc_timestamp(CAST({a[0]} AS TIMESTAMP), {a[1]})"

    def f_time(self, e):
        a = self.xs(e.args)
        return f"make_time(int({a[0]}), int({a[1]}), CAST({a[2]} AS DECIMAL(16, 6)))" if len(a) == 3 else self.as_time(a[0])

    def as_time(self, x: str) -> str:
        if self.kind(x) in ("string", "time(6)"):
            return f"CAST({x} AS TIME(6))"
        return f"make_time(hour({x}), minute({x}), CAST(extract(SECOND FROM {x}) AS DECIMAL(16, 6)))"

    def f_current_date(self, e):
        return self.s.now_text("DATE") or ("current_date()" if not e.args else f"CAST(from_utc_timestamp(current_timestamp(), {self.x(e.args[0])}) AS DATE)")

    def f_current_timestamp(self, e):
        return self.s.now_text("TIMESTAMP") or "current_timestamp()"

    def f_current_datetime(self, e):
        return self.s.now_text("TIMESTAMP_NTZ") or "localtimestamp()"

    def f_current_time(self, e):
        return self.s.now_text("TIME(6)") or "current_time(6)"

    f_curdate = f_current_date

    def _add(self, e, minus):
        x, i = self.x(e.args[0]), e.args[1]
        if e.name.startswith("DATE_") and i.unit in ("DAY", "WEEK"):
            days = f"int({self.x(i.amount)}) * {7 if i.unit == 'WEEK' else 1}"
            return f"date_{'sub' if minus else 'add'}({x}, {days})"
        if e.name.startswith("TIME_"):
            per = MICROS[i.unit]
            micros = f"pmod(bigint(round(extract(HOUR FROM {x}) * 3600000000L + extract(MINUTE FROM {x}) * 60000000L + extract(SECOND FROM {x}) * 1000000)) {'-' if minus else '+'} {self.x(i.amount)} * {per}, 86400000000L)"
            return f"make_time(int({micros} div 3600000000), int({micros} div 60000000 % 60), CAST(({micros} % 60000000) / 1000000 AS DECIMAL(16, 6)))"
        return self.add_interval(x, i, minus)

    def f_date_add(self, e):
        return self._add(e, False)

    f_datetime_add = f_timestamp_add = f_time_add = f_date_add

    def f_date_sub(self, e):
        return self._add(e, True)

    f_datetime_sub = f_timestamp_sub = f_time_sub = f_date_sub

    def _weeks(self, unit: str) -> str:
        day = {"WEEK": 0, "ISOWEEK": 1}.get(unit, DAYS.index(unit[5:-1]) if "(" in unit else 0)
        return f"date_add({SUNDAY}, {day})"

    def f_date_diff(self, e):
        a, b, unit = self.x(e.args[0]), self.x(e.args[1]), self._unit(e.args[2])
        if unit in ("YEAR", "QUARTER", "MONTH"):
            of = {"YEAR": "year({0})", "QUARTER": "year({0}) * 4 + quarter({0})", "MONTH": "year({0}) * 12 + month({0})"}[unit]
            return f"bigint(({of.format(a)}) - ({of.format(b)}))"
        if unit == "ISOYEAR":
            return f"bigint(extract(YEAROFWEEK FROM {a}) - extract(YEAROFWEEK FROM {b}))"
        if unit.startswith("WEEK") or unit == "ISOWEEK":
            d0 = self._weeks(unit)
            return f"bigint(floor(datediff({a}, {d0}) / 7) - floor(datediff({b}, {d0}) / 7))"
        if unit == "DAY":
            return f"bigint(datediff({a}, {b}))"
        per = MICROS[unit]
        if e.name == "TIMESTAMP_DIFF":
            return f"((unix_micros(CAST({a} AS TIMESTAMP)) - unix_micros(CAST({b} AS TIMESTAMP))) div {per})"
        return f"bigint(floor(unix_micros(CAST({a} AS TIMESTAMP)) / {per}) - floor(unix_micros(CAST({b} AS TIMESTAMP)) / {per}))"

    f_datetime_diff = f_date_diff

    def f_timestamp_diff(self, e):
        unit = self._unit(e.args[2])
        if unit == "DAY":
            a, b = self.x(e.args[0]), self.x(e.args[1])
            return f"((unix_micros({a}) - unix_micros({b})) div {MICROS['DAY']})"
        return self.f_date_diff(e)

    def f_time_diff(self, e):
        a, b, unit = self.x(e.args[0]), self.x(e.args[1]), self._unit(e.args[2])
        return f"time_diff({quote(unit)}, {b}, {a})"

    def f_date_trunc(self, e):
        x, unit = self.x(e.args[0]), self._unit(e.args[1])
        if len(e.args) > 2:
            x = f"from_utc_timestamp({x}, {self.x(e.args[2])})"
        if unit == "ISOYEAR":
            out = f"date_add({self._weeks('ISOWEEK')}, int(floor(datediff(make_date(int(extract(YEAROFWEEK FROM {x})), 1, 4), {self._weeks('ISOWEEK')}) / 7) * 7))"
        elif unit.startswith("WEEK") or unit == "ISOWEEK":
            d0 = self._weeks(unit)
            out = f"date_add({d0}, int(floor(datediff({x}, {d0}) / 7) * 7))"
        elif e.name == "DATE_TRUNC":
            return f"trunc({x}, {quote(unit)})" if unit != "DAY" else x
        elif e.name == "TIME_TRUNC":
            return f"time_trunc({quote(unit)}, {x})"
        else:
            out = f"date_trunc({quote(unit)}, {x})"
        out = out if e.name == "DATE_TRUNC" else f"CAST({out} AS {'TIMESTAMP' if e.name == 'TIMESTAMP_TRUNC' else 'TIMESTAMP_NTZ'})"
        return f"to_utc_timestamp({out}, {self.x(e.args[2])})" if len(e.args) > 2 else out

    f_datetime_trunc = f_timestamp_trunc = f_time_trunc = f_date_trunc

    def f_last_day(self, e):
        x = self.x(e.args[0])
        unit = self._unit(e.args[1]) if len(e.args) > 1 else "MONTH"
        if unit == "MONTH":
            return f"last_day({x})"
        if unit in ("YEAR", "QUARTER"):
            return f"date_sub(add_months(trunc({x}, '{unit}'), {12 if unit == 'YEAR' else 3}), 1)"
        d0 = self._weeks(unit)
        return f"date_add({d0}, int(floor(datediff({x}, {d0}) / 7) * 7) + 6)"

    def _format(self, e):
        fmt = e.args[0]
        x = self.x(e.args[1])
        if len(e.args) > 2:
            x = f"from_utc_timestamp({x}, {self.x(e.args[2])})"
        if not isinstance(fmt, n.Lit):
            raise SyntaxProblem(f"{e.name}: the format must be a literal")
        if e.name == "FORMAT_TIME":
            x = f"make_timestamp_ntz(DATE'1970-01-01', {x})"
        return strftime_pattern(fmt.value, x)

    f_format_date = f_format_datetime = f_format_timestamp = f_format_time = _format

    def f_week(self, e):
        mode = int(e.args[1].value) if len(e.args) > 1 and isinstance(e.args[1], n.Lit) else 0
        if mode not in (0, 3, 5):
            raise SyntaxProblem("WEEK: the modes 0, 3 and 5 are known")
        return self.x_extract(n.Extract({0: "WEEK", 3: "ISOWEEK", 5: "WEEK(MONDAY)"}[mode], e.args[0], None))

    def f_date_format(self, e):
        return strftime_pattern(e.args[1].value.replace("%i", "%M").replace("%s", "%S"), self.x(e.args[0]))

    def _parse(self, e):
        fmt, x = e.args[0], self.x(e.args[1])
        pattern = strftime_pattern(fmt.value, None)
        f = {"PARSE_DATE": "to_date", "PARSE_DATETIME": "to_timestamp_ntz", "PARSE_TIMESTAMP": "to_timestamp", "PARSE_TIME": "to_time"}[e.name]
        if e.safe:
            f = "try_" + f if f != "to_timestamp_ntz" else f
        return f"{f}({x}, {quote(pattern)})"

    f_parse_date = f_parse_datetime = f_parse_timestamp = f_parse_time = _parse

    def f_str_to_date(self, e):
        return f"to_timestamp_ntz({self.x(e.args[0])}, {quote(strftime_pattern(e.args[1].value.replace('%i', '%M').replace('%s', '%S'), None))})"

    def f_string(self, e):
        x = self.x(e.args[0])
        kind = self.kind(x)
        if kind == "variant":
            return f"variant_get({x}, '$', 'string')"
        if kind == "timestamp":
            return f"concat(CAST({x} AS STRING), '+00')" if len(e.args) == 1 else f"CAST(from_utc_timestamp({x}, {self.x(e.args[1])}) AS STRING)"
        return f"CAST({x} AS STRING)"

    def _bucket(self, e):
        x, width = self.x(e.args[0]), e.args[1]
        kind = {"TIMESTAMP_BUCKET": "TIMESTAMP", "DATETIME_BUCKET": "TIMESTAMP_NTZ", "DATE_BUCKET": "DATE"}[e.name]
        origin = self.x(e.args[2]) if len(e.args) > 2 else f"CAST('1950-01-01' AS {kind})"
        amount, unit = self.x(width.amount), width.unit
        if unit in ("MONTH", "QUARTER", "YEAR"):
            k = f"({amount} * {dict(MONTH=1, QUARTER=3, YEAR=12)[unit]})"
            diff = f"((year({x}) * 12 + month({x})) - (year({origin}) * 12 + month({origin})))"
            out = f"({origin} + make_ym_interval(0, int(floor({diff} / {k}) * {k})))"
            return out if kind == "DATE" else f"CAST({out} AS {kind})"
        if kind == "DATE":
            k = f"({amount} * {7 if unit == 'WEEK' else 1})"
            return f"date_add({origin}, int(floor(datediff({x}, {origin}) / {k}) * {k}))"
        per = f"({amount} * {MICROS.get(unit, 7 * MICROS['DAY'])}L)"
        micros = f"unix_micros(CAST({x} AS TIMESTAMP))"
        base = f"unix_micros(CAST({origin} AS TIMESTAMP))"
        return f"CAST(timestamp_micros({micros} - pmod({micros} - {base}, {per})) AS {kind})"

    f_timestamp_bucket = f_datetime_bucket = f_date_bucket = _bucket

    def _generate(self, e):
        a, b = self.x(e.args[0]), self.x(e.args[1])
        step = self.x(e.args[2]) if len(e.args) > 2 else "INTERVAL '1' DAY"
        down = isinstance(e.args[2].amount, n.Lit) and str(e.args[2].amount.value).startswith("-") if len(e.args) > 2 else False
        return f"if({a} {'>=' if down else '<='} {b}, sequence({a}, {b}, {step}), array())"

    f_generate_date_array = f_generate_timestamp_array = _generate

    def f_make_interval(self, e):
        names = ["year", "month", "day", "hour", "minute", "second"]
        got = {k: self.x(v) for k, v in zip(names, e.args)} | {k: self.x(v) for k, v in e.named.items()}
        return f"make_interval({', '.join(['int(' + got.get('year', '0') + ')', 'int(' + got.get('month', '0') + ')', '0', 'int(' + got.get('day', '0') + ')', 'int(' + got.get('hour', '0') + ')', 'int(' + got.get('minute', '0') + ')', got.get('second', '0')])})"

    # strings

    def f_format(self, e):
        if not isinstance(e.args[0], n.Lit):
            raise SyntaxProblem("FORMAT: the format must be a literal")
        args = self.xs(e.args[1:])
        return format_string(e.args[0].value, args, [self.kind(a) for a in args])

    def _pattern(self, e: n.Expr) -> tuple[str, int]:
        groups = len(re.findall(r"(?<!\\)\((?!\?)|\(\?P<", e.value)) if isinstance(e, n.Lit) else 0
        text = self.x(n.Lit("string", e.value.replace("(?P<", "(?<"))) if isinstance(e, n.Lit) else self.x(e)
        return text, groups

    def f_regexp_extract(self, e):
        x, (p, groups) = self.x(e.args[0]), self._pattern(e.args[1])
        if groups > 1:
            raise SyntaxProblem("REGEXP_EXTRACT takes one capturing group at most")
        if len(e.args) > 2:
            at = self.x(e.args[2])
            nth = self.x(e.args[3]) if len(e.args) > 3 else "1L"
            return f"get(regexp_extract_all(substring({x}, int({at})), {p}, {groups}), int({nth}) - 1)"
        return f"if({x} RLIKE {p}, regexp_extract({x}, {p}, {groups}), NULL)"

    f_regexp_substr = f_regexp_extract

    def f_regexp_extract_all(self, e):
        x, (p, groups) = self.x(e.args[0]), self._pattern(e.args[1])
        return f"regexp_extract_all({x}, {p}, {min(groups, 1)})"

    def f_regexp_replace(self, e):
        x, (p, _), r = self.x(e.args[0]), self._pattern(e.args[1]), e.args[2]
        text = self.x(n.Lit("string", re.sub(r"\\(\d)", r"$\1", r.value.replace("$", "\\$")))) if isinstance(r, n.Lit) else self.x(r)
        return f"regexp_replace({x}, {p}, {text})"

    def f_regexp_instr(self, e):
        x, (p, groups) = self.x(e.args[0]), self._pattern(e.args[1])
        return f"bigint(regexp_instr({x}, {p}))"

    def f_regexp_extract_groups(self, e):
        x, (p, groups) = self.x(e.args[0]), self._pattern(e.args[1])
        names = re.findall(r"\((?!\?[^P])(?:\?P<(\w+)>)?", e.args[1].value)
        return f"if({x} RLIKE {p}, named_struct({', '.join(f'{quote(k or f'_{i + 1}')}, regexp_extract({x}, {p}, {i + 1})' for i, k in enumerate(names))}), NULL)"

    def f_parse_numeric(self, e):
        return f"{'try_cast' if e.safe else 'CAST'}(regexp_replace({self.x(e.args[0])}, '[ ,]', '') AS DECIMAL(38, 9))"

    def f_parse_bignumeric(self, e):
        return f"{'try_cast' if e.safe else 'CAST'}(regexp_replace({self.x(e.args[0])}, '[ ,]', '') AS DECIMAL(38, 18))"

    def _whole(self, e):
        x = self.x(e.args[0])
        kind = self.kind(x, self.source_text)
        if not kind.startswith("decimal"):
            if len(e.args) == 1:
                return None
            d, unit = f"CAST({x} AS DECIMAL(37, 15))", f"CAST(pow(10D, -({self.x(e.args[1])})) AS DECIMAL(37, 15))"
            return f"(CASE WHEN abs({x}) < 1e15 THEN double({d} - {d} % {unit}) ELSE {x} END)"
        if e.name.startswith("TRUNC"):
            unit = f"CAST(pow(10D, -({self.x(e.args[1]) if len(e.args) > 1 else '0'})) AS DECIMAL(38, 9))"
            return f"CAST({x} - {x} % {unit} AS {kind})"
        return f"CAST({'floor' if e.name == 'FLOOR' else 'ceil'}({x}) AS {kind})"

    f_trunc = f_truncate = f_ceil = f_ceiling = f_floor = _whole

    def _justify(self, e):
        """An interval whose hours are days from 24 on, whose days are months from 30 on, or both."""
        x = self.x(e.args[0])
        part = lambda name: f"extract({name} FROM {x})"
        kind = self.kind(x, self.source_text)
        months = f"int({part('YEAR')} * 12 + {part('MONTH')})" if kind == "interval" or "month" in kind or "year" in kind else "0"
        if months != "0" and kind != "interval":
            return f"make_interval(0, {months})"
        all_days = f"int({part('DAY')})"
        days = f"int(coalesce(nullif(regexp_extract(CAST({x} AS STRING), '(-?[0-9]+) days', 1), ''), '0'))" if kind == "interval" and e.name == "JUSTIFY_DAYS" else all_days
        hours = f"int({part('HOUR')} + 24 * ({all_days} - {days}))"
        if e.name == "JUSTIFY_HOURS":
            return f"make_interval(0, {months}, 0, {days}, {hours}, int({part('MINUTE')}), {part('SECOND')})"
        return f"make_interval(0, {months} + int({days} div 30), 0, int({days} % 30), {hours}, int({part('MINUTE')}), {part('SECOND')})"

    f_justify_hours = f_justify_days = f_justify_interval = _justify

    def f_round(self, e):
        a = self.xs(e.args)
        if len(a) == 3 and "EVEN" in a[2].upper():
            return f"bround({a[0]}, int({a[1]}))"
        return None if len(a) < 3 else f"round({a[0]}, int({a[1]}))"

    # errors

    def safe(self, e: n.Expr) -> str:
        """The expression with everything that can raise made to give NULL."""

        def walk(x: Any) -> Any:
            if isinstance(x, n.Call):
                x.safe = True
                x.args = [walk(a) for a in x.args]
            elif isinstance(x, n.Cast):
                x.safe, x.x = True, walk(x.x)
            elif isinstance(x, n.Binary):
                x.a, x.b = walk(x.a), walk(x.b)
                if x.op in "+-*/" and not isinstance(x.b, n.Interval):
                    return n.Call({"+": "SAFE_ADD", "-": "SAFE_SUBTRACT", "*": "SAFE_MULTIPLY", "/": "SAFE_DIVIDE"}[x.op], [x.a, x.b])
            elif isinstance(x, n.Index):
                x.x = walk(x.x)
                x.how = {"OFFSET": "SAFE_OFFSET", "ORDINAL": "SAFE_ORDINAL"}.get(x.how, x.how)
            elif isinstance(x, n.Unary):
                x.x = walk(x.x)
            return x

        return self.x(walk(e))

    def f_iferror(self, e):
        return f"coalesce({self.safe(e.args[0])}, {self.x(e.args[1])})"

    def f_iserror(self, e):
        return f"({self.safe(e.args[0])} IS NULL)"

    def f_nulliferror(self, e):
        return self.safe(e.args[0])

    # json

    def _path(self, e: n.Call) -> str:
        return e.args[1].value if len(e.args) > 1 and isinstance(e.args[1], n.Lit) else "$"

    def _variant(self, x: str) -> str:
        return x if self.kind(x) == "variant" else f"try_parse_json({x})"

    def f_json_query(self, e):
        x, path = self.x(e.args[0]), quote(self._path(e))
        got = f"try_variant_get({self._variant(x)}, {path}, 'variant')"
        return got if self.kind(x) == "variant" else f"to_json({got})"

    f_json_extract = f_json_query

    def f_json_value(self, e):
        x = self.x(e.args[0])
        if self.kind(x, self.source_text) == "string":  # one pass over the text; what looks like an object or array is looked at again
            got = f"get_json_object({x}, {quote(self._path(e))})"
            return f"(CASE WHEN left({got}, 1) IN ('{{', '[') THEN {self._json_scalar(e)} ELSE {got} END)"
        return self._json_scalar(e)

    def _json_scalar(self, e):
        got = f"try_variant_get({self._variant(self.x(e.args[0]))}, {quote(self._path(e))}, 'variant')"
        return f"if(schema_of_variant({got}) RLIKE '^(OBJECT|ARRAY)', NULL, try_variant_get({got}, '$', 'string'))"

    f_json_extract_scalar = f_json_value

    def f_json_query_array(self, e):
        x = self.x(e.args[0])
        rows = f"try_variant_get({self._variant(x)}, {quote(self._path(e))}, 'array<variant>')"
        return rows if self.kind(x) == "variant" else f"transform({rows}, __v -> to_json(__v))"

    f_json_extract_array = f_json_query_array

    def f_json_value_array(self, e):
        return f"try_variant_get({self._variant(self.x(e.args[0]))}, {quote(self._path(e))}, 'array<string>')"

    f_json_extract_string_array = f_json_value_array

    def f_json_object(self, e):
        value = lambda v: "parse_json('null')" if isinstance(v, n.Lit) and v.kind == "null" else self.x(v)
        pairs = [f"{self.x(k)}, {value(v)}" for k, v in zip(e.args[::2], e.args[1::2])]
        return f"to_variant_object(named_struct({', '.join(pairs)}))" if pairs else "parse_json('{}')"

    def f_json_array(self, e):
        items = [f"to_json(to_variant_object(named_struct('v', {a})))" for a in self.xs(e.args)]
        bare = ["'null'" if "named_struct('v', NULL)" in t else f"coalesce(regexp_extract({t}, '^[{{]\"v\":(.*)[}}]$', 1), 'null')" for t in items]
        return f"parse_json(concat('[', concat_ws(',', {', '.join(bare)}), ']'))" if bare else "parse_json('[]')"

    def f_to_json_string(self, e):
        x = self.x(e.args[0])
        kind = self.kind(x)
        if kind.startswith(("struct", "array", "map")) or kind == "variant":
            return f"to_json({x}, map('ignoreNullFields', 'false'))" if kind != "variant" else f"to_json({x})"
        return f"coalesce(regexp_extract(to_json(named_struct('v', {x})), '^[{{]\"v\":(.*)[}}]$', 1), 'null')" if kind != "void" else "'null'"

    f_json_quote = f_to_json_string

    def f_json_path_exists(self, e):
        return f"(try_variant_get({self._variant(self.x(e.args[0]))}, {quote(self._path(e))}, 'variant') IS NOT NULL)"

    def _json_text(self, e: n.Expr) -> str:
        return self.f_to_json_string(n.Call("TO_JSON_STRING", [e]))

    def _edit(self, e, how, flag):
        doc = f"to_json({self.x(e.args[0])})"
        rest = []
        for i, a in enumerate(e.args[1:]):
            rest.append(self.x(a) if how in ("remove", "strip") or i % 2 == 0 else self._json_text(a))
        return f"parse_json(lk_json_edit({', '.join([quote(how), doc, flag, *rest])}))"

    def _flag(self, e, name, default):
        return self.x(e.named[name]) if name in e.named else default

    def f_json_set(self, e):
        return self._edit(e, "set", self._flag(e, "create_if_missing", "true"))

    def f_json_remove(self, e):
        return self._edit(e, "remove", "false")

    def f_json_strip_nulls(self, e):
        return self._edit(e, "strip", self._flag(e, "include_arrays", "true"))

    def f_json_array_append(self, e):
        return self._edit(e, "append", self._flag(e, "append_each_element", "true"))

    def f_json_array_insert(self, e):
        return self._edit(e, "insert", self._flag(e, "insert_each_element", "true"))

    def f_json_contains(self, e):
        return f"lk_json_contains(to_json({self.x(e.args[0])}), to_json({self.x(e.args[1])}))"

    def f_json_flatten(self, e):
        return f"transform(lk_json_flatten(to_json({self.x(e.args[0])})), __v -> parse_json(__v))"

    def f_json_keys(self, e):
        return f"lk_json_keys(to_json({self.x(e.args[0])}), {self.x(e.args[1]) if len(e.args) > 1 else '-1L'})"

    def f_to_json(self, e):
        x = self.x(e.args[0])
        if self.kind(x).startswith(("struct", "array", "map")):
            return f"to_variant_object({x})"
        return f"parse_json({self._json_text(e.args[0])})"

    f_safe_to_json = f_to_json

    def _quantiles(self, e, kind, merge):
        k = int(e.args[1].value)
        s = self.x(e.args[0])
        s = f"kll_merge_agg_{kind}({s})" if merge else s
        return f"kll_sketch_get_quantile_{kind}({s}, array({', '.join(f'{i / k!r}D' for i in range(k + 1))}))"

    def f_kll_quantiles_extract_int64(self, e):
        return self._quantiles(e, "bigint", False)

    def f_kll_quantiles_extract_float64(self, e):
        return self._quantiles(e, "double", False)

    def f_kll_quantiles_merge_int64(self, e):
        return self._quantiles(e, "bigint", True)

    def f_kll_quantiles_merge_float64(self, e):
        return self._quantiles(e, "double", True)

    def _dlp(self, e):
        args = self.xs(e.args)
        return R.fill(R.KEYSETS[e.name + "4"], args if len(args) == 4 else [*args, "''"], e.name)

    f_dlp_deterministic_encrypt = f_dlp_deterministic_decrypt = _dlp

    def f_tokenize_json(self, e):
        return f"filter(split(lower(to_json({self.x(e.args[0])})), '[^\\\\p{{L}}\\\\p{{N}}]+'), __w -> __w <> '')"

    def f_typeof(self, e):
        back = {v.lower(): k for k, v in reversed(SIMPLE_TYPES.items())}
        kind = self.kind(self.x(e.args[0]), self.source_text)
        if kind.startswith("decimal"):
            return quote("BIGNUMERIC" if kind == "decimal(38,18)" else "NUMERIC")
        return quote({"decimal(38,9)": "NUMERIC", "variant": "JSON", "binary": "BYTES", "double": "FLOAT64", "int": "INT64", "bigint": "INT64", "boolean": "BOOL", "timestamp_ntz": "DATETIME", "string": "STRING"}.get(kind, back.get(kind, kind.upper())))

    # ranges

    def f_range_literal(self, e):
        kind, text = e.args[0].value.upper(), e.args[1].value
        low, high = [t.strip() for t in text.strip("[)").split(",")]
        cast = lambda t: f"CAST(NULL AS {spark_type(kind)})" if t.upper() in ("UNBOUNDED", "NULL") else f"CAST({quote(t)} AS {spark_type(kind)})"
        return f"named_struct('start', {cast(low)}, 'end', {cast(high)})"

    def f_range_contains(self, e):
        r, x = self.xs(e.args)
        if self.kind(x).startswith("struct"):
            return f"(coalesce(({r}).start <= ({x}).start, ({r}).start IS NULL) AND coalesce(({x}).end <= ({r}).end, ({r}).end IS NULL))"
        return f"(coalesce(({r}).start <= {x}, true) AND coalesce({x} < ({r}).end, true))"

    # text

    def f_search(self, e):
        x, q = self.x(e.args[0]), self.x(e.args[1])
        split = lambda t: f"filter(split(lower({t}), '[^\\\\p{{L}}\\\\p{{N}}]+'), __w -> __w <> '')"
        kind = self.kind(x)
        x = f"to_json({x})" if kind.startswith(("struct", "array")) or kind == "variant" else x
        return f"(size(array_except({split(q)}, {split(x)})) = 0)"

    def f_text_analyze(self, e):
        return f"filter(split(lower({self.x(e.args[0])}), '[^\\\\p{{L}}\\\\p{{N}}]+'), __w -> __w <> '')"

    def f_bag_of_words(self, e):
        x = self.x(e.args[0])
        starts = "filter(sequence(0, size(__s) - 1), __i -> __i = 0 OR NOT (get(__s, __i) <=> get(__s, __i - 1)))"
        runs = "transform(__p, (__a, __j) -> named_struct('term', get(__s, __a), 'count', bigint(coalesce(get(__p, __j + 1), size(__s)) - __a)))"
        bags = f"flatten(transform(array({starts}), __p -> {runs}))"  # arrays of one element name what is used more than once
        return f"flatten(transform(array(array_sort({x})), __s -> if(size(__s) > 0, {bags}, array())))"

    def f_tokenize_fulltext(self, e):
        return self.f_text_analyze(e)

    def f_tokenize_ngrams(self, e):
        size = self.x(e.named["ngram_size_max"]) if "ngram_size_max" in e.named else "4L"
        x = self.x(e.args[0])
        return f"array_distinct(transform(sequence(1, greatest(length({x}) - int({size}) + 1, 1)), __i -> substring(lower({x}), __i, int({size}))))"

    f_tokenize_substring = f_tokenize_ngrams

    def f_token(self, e):
        return f"array({self.x(e.args[0])})"

    def f_search_substring(self, e):
        return f"contains(array_join({self.x(e.args[0])}, ' '), lower({self.x(e.args[1])}))"

    def f_tokenlist_concat(self, e):
        return f"flatten({self.x(e.args[0])})"

    def f_obj_make_ref(self, e):
        a = self.xs(e.args)
        return f"named_struct('uri', {a[0]}, 'version', CAST(NULL AS STRING), 'authorizer', {a[1] if len(a) > 1 else 'CAST(NULL AS STRING)'}, 'details', CAST(NULL AS STRING))"

    def f_get_next_sequence_value(self, e):
        return f"({self.s.next_in_sequence(e)}L + monotonically_increasing_id())"

    def f_get_internal_sequence_state(self, e):
        return f"{self.s.sequence_state(e)}L"

    def f_tf_idf(self, e):
        """Weights of the terms of a token array, over all rows of the SELECT: equal arrays are weighted once and joined back."""
        x, name, e.over = self.x(e.args[0]), self.fresh("tf"), None
        found = f"SELECT {x} AS tokens, count(*) AS c FROM {self.source_text}{self.where_text} GROUP BY 1"
        terms = f"SELECT tokens, c, size(tokens) AS n, term, count(*) AS k FROM (SELECT tokens, c, explode(tokens) AS term FROM ({found})) GROUP BY ALL"
        often = f"SELECT term, sum(c) AS df FROM ({terms}) GROUP BY term"
        if len(e.args) > 1:
            raise SyntaxProblem("TF_IDF: limits on tokens are taken by the operator tf_idf only")
        weight = f"k / n * (ln((1 + (SELECT sum(c) FROM ({found}))) / (1 + df)) + 1)"
        rows = f"SELECT tokens, array_sort(collect_list(w)) AS r FROM (SELECT tokens, named_struct('term', term, 'tf_idf', {weight}) AS w FROM ({terms}) JOIN ({often}) USING (term)) GROUP BY tokens"
        self.extra_joins.append(f" LEFT JOIN ({rows}) AS {name} ON {name}.tokens = {x}")
        return f"coalesce({name}.r, array())"

    # queries

    def query(self, q: n.Query) -> str:
        depth, was = len(self.ctes), self.recursive
        for name, sub in q.ctes:
            if q.recursive and isinstance(sub.body, n.SetOp) and sub.body.op == "UNION" and not sub.body.all and self._mentions(sub.body.right, name):
                self.views[name.lower()] = self.fixpoint(name, sub)
                continue
            text = self.query(sub)
            cols = getattr(sub, "columns", None)
            if cols:
                text = f"SELECT * FROM ({text}) AS __c({', '.join(map(ident, cols))})"
            if q.recursive and self._mentions(sub, name):
                self.recursive = True
            self.ctes.append((name, text))
        try:
            text = self.body(q.body, q)
            kept, self.pipe_alias = self.pipe_alias, "__pipe"
            if q.pipes and isinstance(q.body, n.Select) and isinstance(q.body.source, (n.TableRef, n.Derived, n.Unnest)):
                self.pipe_alias = q.body.source.alias or "__pipe"
            for step in q.pipes:
                text = self.pipe(text, step)
                self.pipe_alias = step[1] if step[0] == "AS" else "__pipe" if step[0] in ("SELECT", "AGGREGATE", "JOIN", "UNION", "INTERSECT", "EXCEPT", "TABLE") else self.pipe_alias
            self.pipe_alias = kept
            own = self.ctes[depth:]
            if own:
                word = "WITH RECURSIVE " if self.recursive else "WITH "
                text = word + ", ".join(f"{ident(k)} AS ({v})" for k, v in own) + " " + text
            return text
        finally:
            self.recursive = was
            del self.ctes[depth:]

    def fixpoint(self, name: str, sub: n.Query) -> str:
        """A recursive UNION DISTINCT: rounds of the rows that are new, each a stored snapshot, until none is."""
        cols = getattr(sub, "columns", None)
        first = self.s.spark.sql(self._prelude() + self.body(sub.body.left))
        names = cols or first.columns
        view, step = f"r_{name.lower()}_{self.s.id}_{self.fresh('r')}", self.fresh("d")
        parts, new = [], first.toDF(*names).distinct()
        while True:
            parts.append(self.s.store(new, view))
            delta = self.s.spark.read.parquet(parts[-1])
            if delta.isEmpty():
                break
            delta.createOrReplaceTempView(step)
            self.views[name.lower()] = step
            found = self.s.spark.sql(self._prelude() + self.body(sub.body.right)).toDF(*names).distinct()
            new = found.exceptAll(self.s.spark.read.parquet(*parts).intersect(found))
        self.s.spark.read.parquet(*parts).createOrReplaceTempView(view)
        return view

    def _mentions(self, node: Any, name: str) -> bool:
        if isinstance(node, n.TableRef):
            return node.path == [name]
        if isinstance(node, (list, tuple)):
            return any(self._mentions(x, name) for x in node)
        return hasattr(node, "__dict__") and any(self._mentions(x, name) for x in vars(node).values())

    def tail(self, q: n.Query) -> str:
        out = ""
        if q.order:
            out += " ORDER BY " + ", ".join(self.order(o) for o in q.order)
        if q.limit is not None:
            out += f" LIMIT {self.count(q.limit)}"
        if q.offset is not None:
            out += f" OFFSET {self.count(q.offset)}"
        return out

    def count(self, e: n.Expr) -> str:
        return e.value if isinstance(e, n.Lit) else f"int({self.x(e)})"

    def body(self, b: Any, q: n.Query | None = None) -> str:
        tail = self.tail(q) if q is not None else ""
        if isinstance(b, n.Select):
            return self.select(b, q, tail)
        if isinstance(b, n.SetOp):
            left, right = self.operand(b.left), self.operand(b.right)
            if b.by_name:
                left, right = self.by_name(left, right)
            text = f"{left} {b.op} {'ALL' if b.all else 'DISTINCT'} {right}"
            return f"SELECT * FROM ({text}) AS {self.fresh()}{tail}" if tail else text
        text = self.query(b)
        return f"SELECT * FROM ({text}) AS {self.fresh()}{tail}" if tail else text

    def operand(self, b: Any) -> str:
        return f"({self.body(b)})"

    def by_name(self, left: str, right: str) -> tuple[str, str]:
        a, b = self.schema(left).names, self.schema(right).names
        every = a + [c for c in b if c not in a]
        pick = lambda text, have: f"(SELECT {', '.join(ident(c) if c in have else f'NULL AS {ident(c)}' for c in every)} FROM {text} AS {self.fresh()})"
        return pick(left, a), pick(right, b)

    def select(self, b: n.Select, q: n.Query | None, tail: str) -> str:
        source = self.from_text(b.source) if b.source is not None else None
        outer = self.source_text, self.extra_joins, self.where_text
        self.source_text, self.extra_joins, self.where_text = source, [], ""
        try:
            return self.select_from(b, source, tail)
        finally:
            self.source_text, self.extra_joins, self.where_text = outer

    def select_from(self, b: n.Select, source: str | None, tail: str) -> str:
        self.windows = {k.lower(): w for k, w in b.windows}
        where = self.where_text = f" WHERE {self.x(b.where)}" if b.where is not None else ""
        if b.as_kind == "STRUCT" or b.as_kind == "VALUE":
            pass
        if hasattr(b, "privacy"):
            from ..operators.privacy import noisy

            items = [noisy(self, x, alias, b.privacy) for x, alias in b.items]
        else:
            items = [self.item(x, alias, source) for x, alias in b.items]
        distinct = "DISTINCT " if b.distinct else ""
        text = f"SELECT {distinct}{', '.join(items)}"
        if b.as_kind == "STRUCT":
            text = f"SELECT {distinct}struct({', '.join(items)}) AS value"
        rest = ""
        if source is not None:
            rest += f" FROM {source}" + "".join(self.extra_joins)
        rest += where
        if b.group is not None:
            rest += " GROUP BY " + self.grouping(b)
        if b.having is not None:
            rest += f" HAVING {self.x(b.having)}"
        names = [f"{ident(k)} AS {self.window(w)}" for k, w in b.windows]
        if names:
            rest += " WINDOW " + ", ".join(names)
        if b.qualify is not None:
            flag = "__qualify"
            aliases = {a.lower() for _, a in b.items if a}
            inner = f"{text}{rest}"
            if isinstance(b.qualify, n.Expr) and self._uses(b.qualify, aliases) and not self._has_window(b.qualify):
                return f"SELECT * FROM ({inner}) AS {self.fresh()} WHERE {self.x(b.qualify)}{tail}"
            inner = f"{text}, {self.x(self._expand(b.qualify, b.items))} AS {flag}{rest}"
            return f"SELECT * EXCEPT ({flag}) FROM ({inner}) AS {self.fresh()} WHERE {flag}{tail}"
        return text + rest + tail

    def _expand(self, e: Any, items: list) -> Any:
        """Names of select items replaced by what they stand for."""
        known = {a.lower(): x for x, a in items if a}
        if isinstance(e, n.Name) and len(e.path) == 1 and e.path[0].lower() in known:
            return known[e.path[0].lower()]
        if isinstance(e, n.Binary):
            return n.Binary(e.op, self._expand(e.a, items), self._expand(e.b, items))
        if isinstance(e, n.Unary):
            return n.Unary(e.op, self._expand(e.x, items))
        return e

    def _uses(self, e: Any, names: set[str]) -> bool:
        if isinstance(e, n.Name):
            return e.path[0].lower() in names
        if isinstance(e, (list, tuple)):
            return any(self._uses(x, names) for x in e)
        return hasattr(e, "__dict__") and any(self._uses(x, names) for x in vars(e).values())

    def _has_window(self, e: Any) -> bool:
        if isinstance(e, n.Call) and e.over is not None:
            return True
        if isinstance(e, (list, tuple)):
            return any(self._has_window(x) for x in e)
        return hasattr(e, "__dict__") and any(self._has_window(x) for x in vars(e).values())

    def item(self, x: n.Expr, alias: str | None, source: str | None) -> str:
        if isinstance(x, n.Star):
            head = ".".join(map(ident, x.of.split("."))) + ".*" if x.of else "*"
            if x.replace:
                cols = self.columns(source) if x.of is None else self.schema(f"SELECT {head} FROM {source} LIMIT 0").names
                new = {k.lower(): self.x(v) for v, k in x.replace}
                gone = {k.lower() for k in x.without}
                pre = f"{x.of}." if x.of else ""
                return ", ".join(f"{new[c.lower()]} AS {ident(c)}" if c.lower() in new else f"{pre}{ident(c)}" for c in cols if c.lower() not in gone)
            return head + (f" EXCEPT ({', '.join(map(ident, x.without))})" if x.without else "")
        text = self.x(x)
        if alias is None and not isinstance(x, (n.Name, n.Field)):
            alias = self.unnamed()
        elif alias is None:
            alias = x.path[-1] if isinstance(x, n.Name) else x.name
            if isinstance(x, n.Name) and text == ".".join(map(ident, x.path)):
                return text
        return f"{text} AS {ident(alias)}"

    def unnamed(self) -> str:
        self.unnamed_count = getattr(self, "unnamed_count", -1) + 1
        return f"_col{self.unnamed_count}"

    def grouping(self, b: n.Select) -> str:
        if b.group == ("ALL",):
            return "ALL"
        known = {a.lower(): x for x, a in b.items if a}

        def key(e: n.Expr) -> str:
            if isinstance(e, n.Lit) and e.kind == "int":
                return e.value
            if isinstance(e, n.Name) and len(e.path) == 1 and e.path[0].lower() in known:
                return self.x(known[e.path[0].lower()])
            return self.x(e)

        out = []
        for g in b.group:
            if isinstance(g, tuple) and g[0] in ("ROLLUP", "CUBE"):
                out.append(f"{g[0]}({', '.join(map(key, g[1]))})")
            elif isinstance(g, tuple) and g[0] == "SETS":
                sets = [f"{s[0]}({', '.join(map(key, s[1]))})" if isinstance(s, tuple) else f"({', '.join(map(key, s))})" for s in g[1]]
                out.append(f"GROUPING SETS ({', '.join(sets)})")
            elif isinstance(g, tuple):
                out.append(key(g[1]))
            else:
                out.append(key(g))
        return ", ".join(out)

    # tables

    def from_text(self, t: Any) -> str:
        if isinstance(t, n.Join):
            return self.join(t)
        return self.table(t, None)

    def aliased(self, text: str, alias: str | None) -> str:
        return f"{text} AS {ident(alias or self.fresh())}"

    def table(self, t: Any, left: str | None) -> str:
        if isinstance(t, n.TableRef):
            text = self.table_ref(t, left)
            if t.sample:
                text += f" TABLESAMPLE ({t.sample})"
            if t.alias or text.startswith("(") or re.fullmatch(r"`?t_\w+`?", text):
                text += f" AS {ident(t.alias or t.path[-1])}"
            return text
        if isinstance(t, n.Derived):
            lateral = "LATERAL " if left is not None and getattr(t, "lateral", False) else ""
            return self.aliased(f"{lateral}({self.query(t.query)})", t.alias)
        if isinstance(t, n.Unnest):
            return self.unnest(t, left)
        if isinstance(t, n.Pivot):
            return self.pivot(t)
        if isinstance(t, n.Unpivot):
            return self.unpivot(t)
        if isinstance(t, n.TableCall):
            return self.aliased(self.table_call(t), t.alias)
        if isinstance(t, n.GraphMatch):
            from ..operators.graph import match

            return self.aliased(f"({match(self, t.graph, t.body)})", t.alias)
        if isinstance(t, n.Join):
            return f"({self.join(t)})"
        raise SyntaxProblem(f"cannot read from {type(t).__name__}")

    def table_ref(self, t: n.TableRef, left: str | None) -> str:
        if t.path == ["__pipe"]:
            return "__pipe"
        if len(t.path) == 1 and any(k.lower() == t.path[0].lower() for k, _ in self.ctes):
            return ident(t.path[0])
        if len(t.path) == 1 and t.path[0].lower() in self.views:
            return f"{self.views[t.path[0].lower()]} AS {ident(t.path[0])}" if not t.alias else self.views[t.path[0].lower()]
        if len(t.path) > 1 and left is not None and self._column_of(t.path, left):
            return self.unnest(n.Unnest([n.Name(t.path)], alias=t.alias or t.path[-1]), left).rpartition(" AS ")[0]
        return self.s.table_text(t.path)

    def _column_of(self, path: list[str], left: str) -> bool:
        return self.kind(".".join(map(ident, path)), left).startswith("array")

    def join(self, j: n.Join) -> str:
        left = self.from_text(j.left)
        if j.kind == "COMMA":
            if isinstance(j.right, n.Unnest) or (isinstance(j.right, n.TableRef) and len(j.right.path) > 1):
                right = self.table(j.right, left)
                return f"{left} CROSS JOIN {right}" if not right.startswith("LATERAL") else f"{left} JOIN {right}"
            return f"{left} CROSS JOIN {self.table(j.right, left)}"
        right = self.table(j.right, left)
        if right.startswith("LATERAL"):
            if j.kind in ("CROSS", "INNER"):
                on = f" ON {self.x(j.on)}" if j.on is not None else ""
                return f"{left} JOIN {right}{on}"
            return f"{left} LEFT JOIN {right} ON {self.x(j.on) if j.on is not None else 'true'}"
        if j.using:
            return f"{left} {j.kind} JOIN {right} USING ({', '.join(map(ident, j.using))})"
        if j.on is not None:
            return f"{left} {j.kind} JOIN {right} ON {self.x(j.on)}"
        return f"{left} CROSS JOIN {right}"

    def unnest(self, u: n.Unnest, left: str | None) -> str:
        if len(u.arrays) > 1:
            call = n.Call("ARRAY_ZIP", [n.StructLit([(a, k)]) for a, k in zip(u.arrays, getattr(u, "names", []) or [f"_{i + 1}" for i in range(len(u.arrays))])], {"mode": n.Lit("string", u.mode or "PAD")})
            array, structs = self.x(call), True
        else:
            array = self.x(u.arrays[0])
            kind = self.kind(array) or self.kind(array, left)
            structs = kind.startswith("array<struct")
        alias = u.alias or (u.arrays[0].path[-1] if isinstance(u.arrays[0], n.Name) and not structs else None) or self.fresh("u")
        pos, val = "__pos", "__val"
        if structs:
            cols = f"{val}.*"
            whole = f", {val} AS {ident(alias)}" if u.alias and False else ""
        else:
            cols, whole = f"{val} AS {ident(alias)}", ""
        offset = f", bigint({pos}) AS {ident(u.offset)}" if u.offset else ""
        inner = f"SELECT {cols}{whole}{offset} FROM (SELECT posexplode({array}) AS ({pos}, {val}))"
        correlated = left is not None and not self._stands_alone(array)
        return f"{'LATERAL ' if correlated else ''}({inner}) AS {ident(alias)}"

    def _stands_alone(self, text: str) -> bool:
        return bool(self.kind(text))

    def pivot(self, p: n.Pivot) -> str:
        source = self.table(p.of, None)
        aggs = ", ".join(self.x(a) + (f" AS {ident(k)}" if k else "") for a, k in p.aggs)
        values = []
        for v, k in p.values:
            text = self.x(v)
            label = k or (str(v.value) if isinstance(v, n.Lit) else text)
            values.append(f"{text} AS {ident(label)}")
        text = f"(SELECT * FROM {source} PIVOT ({aggs} FOR {self.x(p.key)} IN ({', '.join(values)})))"
        # the dialect puts an aggregate's alias first, Spark last; counts of nothing are 0
        new, zero = {}, set()
        for v, k in p.values:
            label = k or (str(v.value) if isinstance(v, n.Lit) else self.x(v))
            for agg, a in p.aggs:
                own = f"{label}_{a}" if a and len(p.aggs) > 1 else label
                new[own] = f"{a}_{label}" if a else label
                if isinstance(agg, n.Call) and agg.name in ("COUNT", "COUNTIF", "APPROX_COUNT_DISTINCT"):
                    zero.add(own)
        if zero or any(a != b for a, b in new.items()):
            cols = self.schema(f"SELECT * FROM {text} LIMIT 0").names
            pick = lambda c: f"coalesce({ident(c)}, 0L)" if c in zero else ident(c)
            text = f"(SELECT {', '.join(f'{pick(c)} AS {ident(new.get(c, c))}' for c in cols)} FROM {text})"
        return self.aliased(text, p.alias)

    def unpivot(self, u: n.Unpivot) -> str:
        source = self.table(u.of, None)
        nulls = " INCLUDE NULLS" if u.nulls else ""
        label = lambda cols, k: f" AS {ident(str(k.value) if isinstance(k, n.Lit) else cols[0])}" if k is not None else ""
        if len(u.value) == 1:
            cols = ", ".join(ident(c[0]) + label(c, k) for c, k in u.columns)
            text = f"{source} UNPIVOT{nulls} ({ident(u.value[0])} FOR {ident(u.name)} IN ({cols}))"
        else:
            cols = ", ".join(f"({', '.join(map(ident, c))}) AS {ident(str(k.value) if k is not None else '_'.join(c))}" for c, k in u.columns)
            text = f"{source} UNPIVOT{nulls} (({', '.join(map(ident, u.value))}) FOR {ident(u.name)} IN ({cols}))"
        return self.aliased(f"(SELECT * FROM {text})", u.alias)

    def table_call(self, t: n.TableCall) -> str:
        if (f := self.s.table_functions.get(t.name.lower())) is not None:
            old = dict(self.substitute)
            self.substitute = {k: self.x(a) for (k, _), a in zip(f["params"], t.args)}
            text = self.query(f["body"])
            self.substitute = old
            return f"({text})"
        from ..operators import table_functions

        return table_functions.lower(self, t)

    # pipes

    def pipe(self, text: str, step: tuple) -> str:
        kind = step[0]
        src = f"({text}) AS {ident(self.pipe_alias)}"
        if kind == "SELECT":
            return f"SELECT {'DISTINCT ' * step[2]}{', '.join(self.item(x, a, src) for x, a in step[1])} FROM {src}"
        if kind == "EXTEND":
            return f"SELECT *, {', '.join(self.item(x, a, src) for x, a in step[1])} FROM {src}"
        if kind == "SET":
            new = {k.lower(): self.x(v) for k, v in step[1]}
            cols = self.schema(text).names
            return f"SELECT {', '.join(f'{new[c.lower()]} AS {ident(c)}' if c.lower() in new else ident(c) for c in cols)} FROM {src}"
        if kind == "DROP":
            return f"SELECT * EXCEPT ({', '.join(map(ident, step[1]))}) FROM {src}"
        if kind == "RENAME":
            new = {a.lower(): b for a, b in step[1]}
            return f"SELECT {', '.join(f'{ident(c)} AS {ident(new.get(c.lower(), c))}' for c in self.schema(text).names)} FROM {src}"
        if kind == "AS":
            return f"SELECT * FROM ({text}) AS {ident(step[1])}"
        if kind == "DISTINCT":
            return f"SELECT DISTINCT * FROM {src}"
        if kind == "WHERE":
            if self._has_window(step[1]):
                return f"SELECT * EXCEPT (__q) FROM (SELECT *, {self.x(step[1])} AS __q FROM {src}) WHERE __q"
            return f"SELECT * FROM {src} WHERE {self.x(step[1])}"
        if kind == "ASSERT":
            return f"SELECT * FROM {src} WHERE assert_true({self.x(step[1][0])}) IS NULL"
        if kind == "AGGREGATE":
            keys = []
            for g in step[2] or []:
                if isinstance(g, tuple) and g[0] == "ALIAS":
                    keys.append((g[1], g[2]))
                elif isinstance(g, tuple):
                    keys += [(x, None) for x in g[1]] if g[0] != "SETS" else []
                else:
                    keys.append((g, None))
            items = [self.item(x, a, src) for x, a in keys + step[1]]
            b = n.Select(items=[(x, a) for x, a in keys], group=step[2] or None)
            group = f" GROUP BY {self.grouping(b)}" if step[2] else ""
            return f"SELECT {', '.join(items)} FROM {src}{group}"
        if kind == "ORDER":
            return f"SELECT * FROM {src} ORDER BY {', '.join(self.order(o) for o in step[1])}"
        if kind == "LIMIT":
            return f"SELECT * FROM {src} LIMIT {self.count(step[1])}" + (f" OFFSET {self.count(step[2])}" if step[2] is not None else "")
        if kind in ("UNION", "INTERSECT", "EXCEPT"):
            out = f"({text})"
            for q in step[2]:
                right = f"({self.query(q)})"
                left = out
                if step[3]:
                    left, right = self.by_name(out, right)
                out = f"({left} {kind} {'ALL' if step[1] else 'DISTINCT'} {right})"
            return f"SELECT * FROM {out} AS {self.fresh()}"
        if kind == "JOIN":
            j = step[1]
            left = src
            right = self.table(j.right, left)
            how = j.kind
            on = f" USING ({', '.join(map(ident, j.using))})" if j.using else f" ON {self.x(j.on)}" if j.on is not None else ""
            if right.startswith("LATERAL"):
                return f"SELECT * FROM {left} {'LEFT ' if how == 'LEFT' else ''}JOIN {right}{on}"
            return f"SELECT * FROM {left} {how} JOIN {right}{on}"
        if kind == "TABLE":
            t = step[1]
            inner = t
            while not isinstance(inner.of, n.TableRef):
                inner = inner.of
            inner.of = n.Derived(n.Query(_Text(text)), "__pipe")
            return f"SELECT * FROM {self.table(t, None)}"
        if kind == "SAMPLE":
            return f"SELECT * FROM ({text}) TABLESAMPLE ({step[1]}) AS __pipe"
        return text


class _Text(n.Query):
    """A query that is lowered already."""

    def __init__(self, text: str):
        super().__init__(None)
        self.text = text


_query = Lower.query


def _query_or_text(self: Lower, q: n.Query) -> str:
    if isinstance(q, _Text):
        return q.text
    if isinstance(q.body, _Text):
        return q.body.text
    return _query(self, q)


Lower.query = _query_or_text

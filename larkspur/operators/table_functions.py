"""Built-in table-valued functions of the dialect."""

from __future__ import annotations

import uuid

from ..sql import nodes as n
from ..sql.lexer import SyntaxProblem
from . import search, time_series

MICROS = {"MICROSECOND": 1, "MILLISECOND": 1_000, "SECOND": 1_000_000, "MINUTE": 60_000_000, "HOUR": 3_600_000_000, "DAY": 86_400_000_000, "WEEK": 7 * 86_400_000_000}
#: Columns of functions that report changes, which snapshot tables do not record.
STUBS = {"APPENDS": "_CHANGE_TYPE STRING, _CHANGE_TIMESTAMP TIMESTAMP", "CHANGES": "_CHANGE_TYPE STRING, _CHANGE_TIMESTAMP TIMESTAMP", "VECTOR_INDEX.STATISTICS": "vector_index STRING, vector_index_state STRING"}


def _input(low, x):
    if isinstance(x, n.Call) and x.name == "TABLE":
        text = f"SELECT * FROM {low.table_ref(n.TableRef(x.args[0].path), None)}"
    elif isinstance(x, n.Sub):
        text = low.query(x.query)
    else:
        text = f"SELECT * FROM {low.table_ref(n.TableRef(x.path), None)}"
    return low.s.spark.sql(low._prelude() + text)


def _words(x) -> list:
    return [(i.items[0][0].value, i.items[1][0].value) if isinstance(i, n.StructLit) else i.value for i in x.items]


def lower(low, t: n.TableCall) -> str:
    name, named = t.name.upper(), dict(t.named)
    if name == "GAP_FILL":
        keys = ["table", "ts_column", "bucket_width", "partitioning_columns", "value_columns", "origin"]
        named = dict(zip(keys, t.args)) | named
        w = named["bucket_width"]
        origin = named["origin"].value if "origin" in named else time_series.ORIGIN
        df = time_series.gap_fill(
            _input(low, named["table"]), named["ts_column"].value, int(w.amount.value) * MICROS[w.unit],
            partition=_words(named["partitioning_columns"]) if "partitioning_columns" in named else [], values=_words(named["value_columns"]) if "value_columns" in named else [], origin=origin,
        )
    elif name == "RANGE_SESSIONIZE":
        mode = t.args[3].value.upper() if len(t.args) > 3 else "MEETS"
        df = time_series.sessionize(_input(low, t.args[0]), t.args[1].value, _words(t.args[2]), overlaps=mode == "OVERLAPS")
    elif name in STUBS:
        source = t.args[0] if t.args else None
        columns = ", ".join(f"CAST(NULL AS {c.split(' ')[1]}) AS {c.split(' ')[0]}" for c in STUBS[name].split(", "))
        if source is None or name.startswith("VECTOR"):
            return f"(SELECT {columns} WHERE false)"
        df = _input(low, source).selectExpr("*", *columns.split(", ")).where("false")
    elif name == "VECTOR_SEARCH":
        keys = ["table", "column_to_search", "query_table", "query_column_to_search", "top_k", "distance_type"]
        named = dict(zip(keys, t.args)) | named
        text = lambda key, other: named[key].value if key in named else other
        column = named["column_to_search"].value
        queries = _input(low, named["query_table"])
        arrays = [f.name for f in queries.schema if f.dataType.typeName() == "array"]
        own = text("query_column_to_search", column if column in queries.columns else arrays[0])
        df = search.nearest_rows(_input(low, named["table"]), column, queries, own, int(text("top_k", "10")), text("distance_type", "EUCLIDEAN").upper())
    else:
        raise SyntaxProblem(f"unknown table function {name}")
    view = f"f_{uuid.uuid4().hex[:12]}"
    df.createOrReplaceTempView(view)
    return view

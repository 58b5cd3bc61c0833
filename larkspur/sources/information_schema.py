"""INFORMATION_SCHEMA views over the session's catalog."""

from __future__ import annotations


def view(session, path: list[str]) -> str:
    from ..sql.session import dialect_type

    at = [p.upper() for p in path].index("INFORMATION_SCHEMA")
    what, wanted = path[at + 1].upper(), (path[at - 1].lower() if at else None)
    project = session.system["project_id"]
    home = lambda t: t.path[-2] if len(t.path) > 1 else session.system["dataset_id"]
    rows, tables = [], [t for t in session.tables.values() if wanted is None or home(t).lower() == wanted or wanted in (project.lower(),)]
    if what == "SCHEMATA":
        schema = "catalog_name string, schema_name string"
        rows = [(project, s) for s in sorted(session.schemas)]
    elif what == "TABLES":
        schema = "table_catalog string, table_schema string, table_name string, table_type string"
        rows = [(project, home(t), t.path[-1], "VIEW" if t.query is not None else "BASE TABLE") for t in tables]
    elif what == "COLUMNS":
        schema = "table_catalog string, table_schema string, table_name string, column_name string, ordinal_position long, is_nullable string, data_type string"
        for t in tables:
            rows += [(project, home(t), t.path[-1], c["name"], i + 1, "NO" if c["not_null"] else "YES", dialect_type(f.dataType)) for i, (c, f) in enumerate(zip(t.columns, session.schema_of(t)))]
    elif what == "TABLE_OPTIONS":
        schema = "table_catalog string, table_schema string, table_name string, option_name string, option_type string, option_value string"
        kinds = {str: "STRING", int: "INT64", float: "FLOAT64", bool: "BOOL"}
        for t in tables:
            rows += [(project, home(t), t.path[-1], k, kinds.get(type(v), "STRING"), f'"{v}"' if isinstance(v, str) else str(v)) for k, v in t.options.items()]
    else:
        raise ValueError(f"no INFORMATION_SCHEMA.{what}")
    name = f"i_{what.lower()}_{wanted or 'all'}_{session.id}".replace("-", "_")
    session.spark.createDataFrame(rows, schema).createOrReplaceTempView(name)
    return name

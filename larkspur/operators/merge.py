"""MERGE as one stored full outer join and one rewrite of the target."""

from __future__ import annotations

import uuid
from typing import TYPE_CHECKING

from pyspark.sql import functions as F

if TYPE_CHECKING:
    from ..sql.session import Session


def merge(s: Session, d: dict) -> None:
    """The first clause that applies to a row decides; a target row that several source rows would change is an error."""
    from ..sql.lower import ident

    t, low = s.target(d["path"]), s.lower()
    alias = d["alias"] or d["path"][-1]
    source = low.table(d["source"], None)
    on = low.x(d["on"])
    names = [c["name"] for c in t.columns]
    kinds = {f.name.lower(): f.dataType.simpleString() for f in s.schema_of(t)}
    default = s.defaults(t, low)
    target_view, source_view = f"m_t_{s.id}", f"m_s_{s.id}"
    s.frame(t).withColumn("__rid", F.monotonically_increasing_id()).createOrReplaceTempView(target_view)
    s_name = getattr(d["source"], "alias", None) or (d["source"].path[-1] if hasattr(d["source"], "path") else "__source")
    src = s.spark.sql(f"SELECT * FROM {source}")
    src_names = src.columns
    src.withColumn("__sid", F.monotonically_increasing_id()).createOrReplaceTempView(source_view)

    # a bare name can only mean the side that a clause's rows come from
    own = {"target": {c: f"{ident(s_name)}.{ident(c)}" for c in src_names}, "source": {c: f"{ident(alias)}.{ident(c)}" for c in names}, "matched": {}}
    tests, actions, sides = [], [], []
    for side, cond, action in d["clauses"]:
        base = {"matched": f"{ident(alias)}.__rid IS NOT NULL AND {ident(s_name)}.__sid IS NOT NULL", "target": f"{ident(alias)}.__rid IS NULL", "source": f"{ident(s_name)}.__sid IS NULL"}[side]
        low.substitute = own[side]
        tests.append(base + (f" AND coalesce({low.x(cond)}, false)" if cond is not None else ""))
        actions.append(action)
        sides.append(side)
    case = "CASE " + " ".join(f"WHEN {x} THEN {i}" for i, x in enumerate(tests)) + " ELSE -1 END"
    columns = []
    for c in names:
        key = c.lower()
        whens = []
        for i, (kind, data) in enumerate(actions):
            value, low.substitute = None, own[sides[i]]
            if kind == "update":
                value = s._changed(t, data, low, default, alias).get(key)
            elif kind == "insert":
                cols, values = data
                given = dict(zip([k.lower() for k in (cols or names)], values))
                v = given.get(key, "DEFAULT")
                value = default[key] if v == "DEFAULT" else low.x(v)
            elif kind == "row":
                value = f"{ident(s_name)}.{ident(src_names[names.index(c)])}"
            if value is not None:
                whens.append(f"WHEN __a = {i} THEN CAST({value} AS {kinds[key]})")
        columns.append(f"CASE {' '.join(whens)} ELSE {ident(alias)}.{ident(c)} END AS {ident(c)}" if whens else f"{ident(alias)}.{ident(c)}")
    inner = f"{target_view} AS {ident(alias)} FULL OUTER JOIN {source_view} AS {ident(s_name)} ON {on}"
    gone = [i for i, (kind, _) in enumerate(actions) if kind == "delete"]
    body = ", ".join(c.replace("__a = ", f"({case}) = ") for c in columns)
    df = s.spark.sql(f"SELECT {body}, ({case}) AS __action, {ident(alias)}.__rid AS __rid FROM {inner}")
    # the one join is stored: row ids and actions are fixed, and the checks read two narrow columns of it
    stage = f"{s.root}/merge-{uuid.uuid4().hex[:8]}"
    df.write.parquet(stage)
    staged = s.spark.read.parquet(stage)
    met = staged.filter("__rid IS NOT NULL").groupBy("__rid").agg(F.count("*").alias("n"), F.count_if(F.col("__action") >= 0).alias("k")).filter("n > 1")
    several, most = met.agg(F.count("*"), F.max("k")).first()
    if several and most > 1:
        raise ValueError("MERGE: a target row is changed by several source rows")
    rows = staged.filter((F.col("__rid").isNotNull() | (F.col("__action") >= 0)) & ~F.col("__action").isin(gone or [-2]))
    if several:  # a target row that is matched several times but changed once, or left alone, appears once
        once = staged.join(met.select("__rid"), "__rid", "left_semi").groupBy("__rid").agg(F.max_by(F.struct(*[F.col(ident(c)) for c in names], "__action"), "__action").alias("r"))
        once = once.select("r.*").filter(~F.col("__action").isin(gone or [-2]))
        rows = rows.join(met.select("__rid"), "__rid", "left_anti").select(*map(ident, names)).unionByName(once.select(*map(ident, names)))
    s.done(low)
    s.rewrite(t, rows.select(*map(ident, names)))
    path = s.spark._jvm.org.apache.hadoop.fs.Path(stage)
    path.getFileSystem(s.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

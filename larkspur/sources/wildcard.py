"""Wildcard tables: prefix* reads all tables of that prefix, with _TABLE_SUFFIX."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union(frames: dict[str, DataFrame]) -> DataFrame:
    """Frames by suffix as one; columns that a frame lacks are null."""
    parts = [df.withColumn("_TABLE_SUFFIX", F.lit(suffix)) for suffix, df in sorted(frames.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def view(session, path: list[str]) -> str:
    prefix = session.key_of(path)[:-1]
    found = {}
    for key, t in session.tables.items():
        at = key.find(prefix)
        if key.startswith(prefix) or (at > 0 and key[at - 1] == "."):
            found[key[max(at, 0) + len(prefix) :]] = session.frame(t)
    if not found:
        raise ValueError(f"no table matches {'.'.join(path)}")
    name = f"w_{abs(hash(prefix))}_{session.id}"
    union(found).createOrReplaceTempView(name)
    return name

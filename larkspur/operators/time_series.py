"""Time-series operators: gap filling and sessions of ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Origin of buckets where none is given.
ORIGIN = "1950-01-01"


def bucket(ts: Column, width_micros: int, origin: str = ORIGIN) -> Column:
    """Start of the bucket of `width_micros` that a timestamp lies in."""
    micros, base = F.unix_micros(ts.cast("timestamp")), F.unix_micros(F.lit(origin).cast("timestamp"))
    return F.timestamp_micros(micros - F.pmod(micros - base, F.lit(width_micros)))


def gap_fill(
    df: DataFrame, ts: str, width_micros: int, *, partition: list[str] | None = None, values: list[tuple[str, str]] | None = None, origin: str = ORIGIN, ignore_null_values: bool = True
) -> DataFrame:
    """One row at least for each bucket between a partition's first and last; gaps are filled by null, locf or linear.

    Only bucket bounds are aggregated per partition; the grid is exploded from
    them and left-joined, and filling windows run per partition.
    """
    partition, values = partition or [], values or []
    for _, how in values:
        if how not in ("null", "locf", "linear"):
            raise ValueError(f"GAP_FILL: unknown method {how}")
    kind = df.schema[ts].dataType.simpleString()
    aligned = df.withColumn("__b", bucket(F.col(ts), width_micros, origin))
    bounds = aligned.groupBy(*partition).agg(F.min("__b").alias("__lo"), F.max("__b").alias("__hi")).filter("__lo IS NOT NULL")
    steps = F.sequence(F.unix_micros("__lo"), F.unix_micros("__hi"), F.lit(width_micros))
    grid = bounds.select(*partition, F.explode(steps).alias("__b")).withColumn("__b", F.timestamp_micros("__b"))
    own = aligned.select(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(partition)], F.col("__b").alias("__ob"), *[F.col(v).alias(f"__v{i}") for i, (v, _) in enumerate(values)])
    on = F.col("__b") == F.col("__ob")
    for i, p in enumerate(partition):
        on = on & F.col(p).eqNullSafe(F.col(f"__p{i}"))
    joined = grid.join(own, on, "left")
    back = Window.partitionBy(*partition).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*partition).orderBy("__b").rowsBetween(0, Window.unboundedFollowing)
    out = []
    for i, (v, how) in enumerate(values):
        x = F.col(f"__v{i}")
        if how == "locf":
            out.append(F.last(x, ignorenulls=True).over(back).alias(v))
        elif how == "linear":
            t = F.unix_micros("__b") / 1e6
            seen = F.when(x.isNotNull(), t)
            x0, x1 = F.last(x, ignorenulls=True).over(back), F.first(x, ignorenulls=True).over(ahead)
            t0, t1 = F.last(seen, ignorenulls=True).over(back), F.first(seen, ignorenulls=True).over(ahead)
            out.append(F.coalesce(x.cast("double"), x0 + (t - t0) * (x1 - x0) / (t1 - t0)).alias(v))
        else:
            out.append(x.alias(v))
    return joined.select(F.col("__b").cast(kind).alias(ts), *partition, *out)


def sessionize(df: DataFrame, range_column: str, partition: list[str], *, overlaps: bool = False) -> DataFrame:
    """Adds session_range: the span of the maximal run of ranges that meet (or, with `overlaps`, overlap)."""
    start, end = F.col(f"{range_column}.start"), F.col(f"{range_column}.end")
    before = Window.partitionBy(*partition).orderBy(start.asc_nulls_first(), end.asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*partition).orderBy(start.asc_nulls_first(), end.asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumn("__end", F.max(end).over(before)).withColumn("__open", F.max(end.isNull()).over(before))
    apart = start >= F.col("__end") if overlaps else start > F.col("__end")
    new = F.when(F.coalesce(F.col("__open"), F.lit(False)), F.lit(0)).when(F.col("__end").isNull() | apart, 1).otherwise(0)
    ids = marked.withColumn("__new", new).withColumn("__sid", F.sum("__new").over(so_far))
    whole = Window.partitionBy(*partition, "__sid")
    last = F.when(F.max(end.isNull()).over(whole), F.lit(None)).otherwise(F.max(end).over(whole))
    session = F.struct(F.min(start).over(whole).alias("start"), last.alias("end"))
    return ids.withColumn("session_range", session).drop("__end", "__open", "__new", "__sid")


def as_of_join(left: DataFrame, right: DataFrame, *, on: list[str], left_ts: str, right_ts: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the latest right row of its keys that is not later.

    A union and one running window per key replace a theta join: one shuffle, no pairs.
    """
    l_cols = left.columns
    a = left.select(*[F.col(c) for c in l_cols], F.col(left_ts).alias("__t"), F.lit(1).alias("__side"), *[F.lit(None).cast(right.schema[v].dataType).alias(f"__r_{v}") for v in values], F.lit(None).cast("timestamp").alias("__rt"))
    b = right.select(*[(F.col(c) if c in on else F.lit(None).cast(left.schema[c].dataType)).alias(c) for c in l_cols], F.col(right_ts).alias("__t"), F.lit(0).alias("__side"), *[F.col(v).alias(f"__r_{v}") for v in values], F.col(right_ts).cast("timestamp").alias("__rt"))
    w = Window.partitionBy(*on).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.last(F.when(F.col("__side") == 0, F.struct(*[F.col(f"__r_{v}").alias(v) for v in values])), ignorenulls=True).over(w)
    return a.unionByName(b).withColumn("__hit", hit).filter("__side = 1").select(*l_cols, *[F.col("__hit")[v].alias(v) for v in values])


def range_join(left: DataFrame, right: DataFrame, *, point: str, start: str, end: str, width: float) -> DataFrame:
    """left rows with right rows whose [start, end) holds the point: buckets of `width` make it an equi-join."""
    cell = F.floor(F.col(point).cast("double") / width)
    cells = F.sequence(F.floor(F.col(start).cast("double") / width), F.floor(F.col(end).cast("double") / width))
    a, b = left.withColumn("__cell", cell), right.withColumn("__cell", F.explode(cells))
    return a.join(b, "__cell").filter((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("__cell")

"""Mixing sources to target weights by temperature (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WORD = r"[^\x20\x09-\x0D]+"
POINTS = 15  # exponents tried in one job: each job narrows the interval to a sixteenth
ROUNDS = 6
SMALL = 10_000  # plans of as many sources at most (some 100 bytes each) are broadcast; beyond it Spark joins by shuffle


def unit_hash(seed: int, epoch: Column, key: Column) -> Column:
    """A number in [0, 1) that orders a source's documents in an epoch."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch, key), 11) / F.lit(float(1 << 53))


def _bisect(shares: DataFrame, measure, holds) -> float:
    """The largest exponent in [0, 1] at which `holds`, which the measure meets from 0 upwards or not at all (then 0)."""
    low, high = 0.0, 1.0

    def at(exponents: list[float]) -> list[bool]:
        row = shares.agg(*[measure(a).alias(f"m{i}") for i, a in enumerate(exponents)]).first()
        return [holds(x) for x in row]

    first = at([low, high])
    if first[1]:
        return 1.0
    if not first[0]:
        return 0.0
    for _ in range(ROUNDS):
        points = [low + (high - low) * (i + 1) / (POINTS + 1) for i in range(POINTS)]
        good = at(points)
        n = next((i for i, ok in enumerate(good) if not ok), POINTS)
        low, high = (points[n - 1] if n else low), (points[n] if n < POINTS else high)
    return math.floor(low * 1e6) / 1e6


def exponent(shares: DataFrame, *, entropy_ratio: float | None, max_repeats: float | None, budget_ratio: float) -> float:
    """The exponent of the shares `p`: the least flattening whose entropy is at least `entropy_ratio` of the largest
    possible one; never so flat that a source is repeated more than `max_repeats` times (proportional shares, 1, at the utmost)."""
    n = shares.count()
    power = lambda a: F.pow("p", F.lit(a))
    entropy = lambda a: F.log(F.sum(power(a))) - F.lit(a) * F.sum(power(a) * F.log("p")) / F.sum(power(a))
    flat = 1.0
    if entropy_ratio is not None and n > 1:
        wanted = entropy_ratio * math.log(n)
        flat = _bisect(shares, entropy, lambda h: h >= wanted)
    if max_repeats is not None:
        repeats = lambda a: F.max(power(a) / F.col("p")) / F.sum(power(a)) * budget_ratio
        # repeats fall as the exponent rises: bisect 1 - exponent
        steep = 1.0 - _bisect(shares, lambda a: repeats(1.0 - a), lambda r: r <= max_repeats)
        flat = max(flat, math.ceil(steep * 1e6) / 1e6)
    return flat


ADDED = ("mix_tokens", "mix_epoch", "mix_block")


def mix(
    docs: DataFrame,
    *,
    entropy_ratio: float | None = 0.95,
    max_repeats: float | None = 4.0,
    budget_ratio: float = 1.0,
    block_tokens: int = 1 << 16,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """All columns of docs, a row for each time a document is used, with `mix_tokens`, `mix_epoch` and `mix_block`.

    Tokens are words.  Source weights are normalised powers of the token
    shares; `budget_ratio` times all tokens are dealt out by them.  A source
    goes through whole epochs and then the head of one more, each in a hashed
    permutation; that head ends before its budget is exceeded.  mix_block
    (about `block_tokens` tokens of all sources in their weights) is the place in the
    mixture: reading blocks in turn gives the weights everywhere.

    Within a source, documents fall into about sqrt(documents) blocks of the
    permutation.  Running sums go over the blocks and inside the one block in
    which the budget ends, so no window holds a whole source.  A null source is
    a source of its own; a null text has no tokens; a source without tokens is
    left out.  Rows that repeat an id are used alike.  Columns of docs named
    mix_... are replaced.  An empty table gives an empty table.
    """
    docs = docs.drop(*ADDED)
    given, (id_col, text_col, source_col) = docs.columns, (f"c{docs.columns.index(c)}" for c in (id_col, text_col, source_col))
    docs = docs.toDF(*[f"c{i}" for i in range(len(given))])  # no name can clash with those used here
    n_words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    light = cut(docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), n_words.alias("__n")))
    totals = light.groupBy("__source").agg(F.sum("__n").alias("t"), F.count("*").alias("docs")).filter("t > 0")
    all_tokens = totals.agg(F.sum("t")).first()[0]
    names = docs.columns
    if not all_tokens:
        return docs.select(*names, F.lit(0).cast("long").alias("mix_tokens"), F.lit(0).alias("mix_epoch"), F.lit(0).cast("long").alias("mix_block")).filter(F.lit(False)).toDF(*given, *ADDED)
    shares = cut(totals.withColumn("p", F.col("t") / F.lit(float(all_tokens))))
    sized = F.broadcast if shares.count() <= SMALL else lambda df: df
    a = exponent(shares, entropy_ratio=entropy_ratio, max_repeats=max_repeats, budget_ratio=budget_ratio)
    scale = shares.agg(F.sum(F.pow("p", F.lit(a)))).first()[0]
    budget = F.floor(F.pow("p", F.lit(a)) / F.lit(scale) * F.lit(budget_ratio * all_tokens)).cast("long")
    plan = cut(
        shares.withColumn("budget", budget)
        .withColumn("full", F.expr("budget div t"))
        .withColumn("rest", F.expr("budget % t"))
        .withColumn("pieces", F.ceil(F.sqrt("docs")).cast("long"))
        .select("__source", "t", "budget", "full", "rest", "pieces")
    )
    known = F.col("d.__source").eqNullSafe(F.col("s.__source"))
    tail = light.alias("d").join(sized(plan).alias("s"), known).select("s.__source", "rest", "pieces", "__n", unit_hash(seed, F.col("full"), F.col("__id")).alias("u"))
    tail = tail.withColumn("piece", F.floor(F.col("u") * F.col("pieces")))
    sums = tail.groupBy("__source", "piece").agg(F.sum("__n").alias("n"), F.first("rest").alias("rest"))
    up_to = Window.partitionBy("__source").orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)
    ends = cut(sums.withColumn("before", F.sum("n").over(up_to) - F.col("n")).filter("before <= rest and before + n > rest").select("__source", "piece", "before"))
    same = F.col("t.__source").eqNullSafe(F.col("e.__source")) & (F.col("t.piece") == F.col("e.piece"))
    inside = tail.alias("t").join(sized(ends).alias("e"), same).select("t.__source", "rest", "before", "u", "__n")
    order = Window.partitionBy("__source").orderBy("u").rangeBetween(Window.unboundedPreceding, 0)
    over = inside.withColumn("sum", F.col("before") + F.sum("__n").over(order)).filter("sum > rest").groupBy("__source").agg(F.min("u").alias("stop"))
    stop = F.coalesce("stop", F.when(F.col("rest") > 0, 1.0).otherwise(0.0)).alias("__stop")
    cuts = plan.alias("s").join(over.alias("o"), F.col("s.__source").eqNullSafe(F.col("o.__source")), "left")
    last = cut(cuts.select(F.col("s.__source").alias("__source"), F.col("t").alias("__t"), F.col("budget").alias("__budget"), F.col("full").alias("__full"), stop))
    n_blocks = max(1, math.ceil(budget_ratio * all_tokens / block_tokens))
    used = docs.join(sized(last), F.col(source_col).eqNullSafe(F.col("__source")))
    epochs = F.sequence(F.lit(0).cast("long"), F.col("__full"))
    used = used.select(*names, "__full", "__stop", "__t", "__budget", F.explode(epochs).alias("__epoch"))
    used = used.withColumn("__u", unit_hash(seed, F.col("__epoch"), F.col(id_col)))
    used = used.filter((F.col("__epoch") < F.col("__full")) | (F.col("__u") < F.col("__stop")))
    place = (F.col("__epoch") + F.col("__u")) * F.col("__t") / F.greatest(F.col("__budget"), F.lit(1))
    used = used.select(
        *names,
        n_words.alias("mix_tokens"),
        F.col("__epoch").cast("int").alias("mix_epoch"),
        F.least(F.floor(place * n_blocks), F.lit(n_blocks - 1)).cast("long").alias("mix_block"),
    )
    return used.toDF(*given, *ADDED)

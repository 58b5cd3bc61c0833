"""Text statistics over a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def tf_idf(docs: DataFrame, *, id_col: str, text_col: str, max_tokens: int | None = None, frequency_threshold: int = 1) -> DataFrame:
    """(id, term, tf_idf): count / document's terms * (ln((1 + N) / (1 + df)) + 1).

    Terms in fewer than `frequency_threshold` documents, and all but the
    `max_tokens` most frequent ones, share the term null.  Counts are combined
    before every shuffle; document frequencies are joined, not broadcast.
    """
    words = docs.select(F.col(id_col).alias("__id"), F.size(terms(F.col(text_col))).alias("__n"), F.explode(terms(F.col(text_col))).alias("term"))
    counts = words.groupBy("__id", "term").agg(F.count("*").alias("c"), F.first("__n").alias("n"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("c").alias("all"))
    df = df.filter(F.col("df") >= frequency_threshold)
    if max_tokens is not None:
        df = df.orderBy(F.desc("all"), "term").limit(max_tokens)
    if max_tokens is not None or frequency_threshold > 1:
        known = counts.join(df.select(F.col("term").alias("__k")), F.col("term") == F.col("__k"), "left").withColumn("term", F.col("__k")).drop("__k")
        counts = known.groupBy("__id", "term").agg(F.sum("c").alias("c"), F.first("n").alias("n"))
        df = counts.groupBy("term").agg(F.count("*").alias("df"))
    total = docs.agg(F.count("*").alias("__total"))
    joined = counts.alias("a").join(df.alias("b"), F.col("a.term").eqNullSafe(F.col("b.term"))).crossJoin(F.broadcast(total))  # one row
    score = F.col("c") / F.col("n") * (F.log((F.lit(1) + F.col("__total")) / (F.lit(1) + F.col("df"))) + 1)
    return joined.select(F.col("__id").alias(id_col), F.col("a.term").alias("term"), score.alias("tf_idf"))

"""Exact vector search and term weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import registry as R

DISTANCES = {"EUCLIDEAN": "EUCLIDEAN_DISTANCE", "COSINE": "COSINE_DISTANCE", "DOT_PRODUCT": "DOT_PRODUCT"}


def nearest_rows(base: DataFrame, column: str, queries: DataFrame, query_column: str, top_k: int, distance: str) -> DataFrame:
    """(query, base, distance): the top_k rows of base nearest to each row of queries, by brute force.

    Every pair is measured where its base row lies and only each partition's
    top_k of a query are shuffled, so it suits query tables of a few thousand
    rows.  DOT_PRODUCT ranks the largest product first and gives its negative.
    Rows whose vector is null take no part.
    """
    asked = queries.filter(F.col(query_column).isNotNull()).select(F.monotonically_increasing_id().alias("id"), F.struct("*").alias("query"), F.col(query_column).alias("q"))
    rows = base.filter(F.col(column).isNotNull()).select(F.struct("*").alias("base"), F.col(column).alias("b"))
    text = R.fill(R.MATH[DISTANCES[distance]], ["q", "b"], distance)
    pairs = rows.crossJoin(asked).withColumn("distance", F.expr(f"-({text})" if distance == "DOT_PRODUCT" else text))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance"))
    return pairs.select("id", "query", "base", "distance").withColumn("rank", rank).filter(F.col("rank") <= top_k).select("query", "base", "distance")

"""SimHash near-duplicates: multi-index hashing over fingerprint halves, exact distances, connected classes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, shared_dir, text_slices

SEED = 42
PIECE = 1 << 15  # shingles whose bits are counted at once


def fold(pieces: Iterable[np.ndarray]) -> int:
    """64-bit SimHash of hashes, given piece by piece: a bit is 1 if set in over half of them.  0 without a hash."""
    ones, n = np.zeros(64, np.int64), 0
    for h in pieces:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, shingle: int) -> int:
    """64-bit SimHash over XXH64 of word shingles, repeats included; A-Z are lower-cased.  0 without a word."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.concatenate(([0], np.cumsum(size)))
    k = min(shingle, len(words))
    first, last = start[: len(words) - k + 1].tolist(), (start[k:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return fold(np.array([digest(line[a:b], SEED) for a, b in zip(first[at : at + PIECE], last[at : at + PIECE])], np.uint64) for at in range(0, len(first), PIECE))


def fingerprints(docs: DataFrame, *, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) of every row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in batch.column("text").cast(pa.large_binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def ball(bits: int, radius: int) -> list[int]:
    """XOR masks of the words within `radius` of any word of `bits` bits."""
    return [sum(1 << b for b in at) for r in range(radius + 1) for at in combinations(range(bits), r)]


def links(fps: DataFrame, *, distance: int = 3, segments: int = 2) -> DataFrame:
    """(u, v) of distinct fingerprints (id, fp) at `distance` differing bits or fewer.

    Of `segments` equal segments, one at least differs in distance // segments
    bits or fewer.  The tables hold each fingerprint under each of its segments;
    the queries enumerate that small ball around each segment; what meets is
    verified over all 64 bits.
    """
    width = 64 // segments
    if width * segments != 64:
        raise ValueError("segments must divide 64")
    part = lambda s: F.shiftrightunsigned("fp", s * width).bitwiseAND((1 << width) - 1) if width < 64 else F.col("fp")
    cells = F.array(*[F.struct(F.lit(s).alias("s"), part(s).alias("key")) for s in range(segments)])
    table = fps.select("id", "fp", F.explode(cells).alias("cell")).select("id", "fp", "cell.s", "cell.key")
    masks = F.array(*[F.lit(m).cast("long") for m in ball(width, distance // segments)])
    probe = table.select(F.col("id").alias("id2"), F.col("fp").alias("fp2"), "s", "key", F.explode(masks).alias("m"))
    probe = probe.select("id2", "fp2", "s", F.col("key").bitwiseXOR(F.col("m")).alias("key"))
    near = (F.col("fp") < F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= distance)
    return table.join(probe, ["s", "key"]).filter(near).select(F.least("id", "id2").alias("u"), F.greatest("id", "id2").alias("v"))


def near_duplicates(docs: DataFrame, *, shingle: int = 3, distance: int = 3, segments: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the smallest id reachable over links of `distance` bits.

    Copies meet in their fingerprint before any link is sought, so a group of
    them is one node.  Null and blank texts share the fingerprint 0 and are
    linked like any other.  Rows that repeat an id give a row each.  A null id
    stays null and takes no part in naming components; where a class has null
    ids alone, its component_id is null.  Other columns are ignored; an empty
    table gives an empty table.
    """
    own = cut(fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col))
    nodes = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    # nodes are named by their fingerprint; classes are renamed to the smallest document id in the end
    found = components(links(nodes.select(F.col("fp").alias("id"), "fp"), distance=distance, segments=segments))
    named = nodes.join(found, F.col("fp") == F.col("id"), "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    names = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of = cut(named.join(names, "component").select(F.col("fp").alias("fp2"), "component_id"))
    return own.join(of, F.col("fp") == F.col("fp2")).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs, one of each class of texts linked at `similarity` of their word shingles or more.

    Each row counts by itself, whether its id is null or repeated.  The row of
    the smallest id stays, null ids last; of those that share it, any one row.
    """
    from .near_copies import classes  # which takes its fingerprints and their links from here

    given, (id_col, text_col) = docs.columns, (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession, "keep-one")
    docs.toDF(*[f"c{i}" for i in range(len(given))]).withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    own = spark.read.parquet(path)
    found = classes(own.select("row", F.col(text_col).alias("text")), shingle=shingle, similarity=similarity)
    rank = F.struct(F.col(id_col).isNull(), F.col(id_col), F.col("row"))
    chosen = own.select("row", id_col).join(found, "row").groupBy("component").agg(F.min_by("row", rank).alias("row"))
    return own.join(chosen.select("row"), "row").drop("row").toDF(*given)

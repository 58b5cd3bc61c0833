"""Near copies by the similarity of word-shingle sets: SimHash and multi-index hashing name the close ones, MinHash bands the rest, exact Jaccard similarity decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, text_slices
from .simhash import PIECE as FOLDED
from .simhash import SEED, fold, links

#: A pair at similarity s shares no band with probability (1 - s**ROWS)**BANDS: 5e-7 at 0.8, less above.
BANDS, ROWS = 48, 6
PIECE = 1 << 10  # shingles permuted at once
#: Bits of a node's parity sketch.  It prunes groups of texts up to about 2,000 words; longer texts fill it and are verified in full.
SKETCH = 1 << 11
_FACTORS, _SHIFTS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
_FACTORS |= np.uint64(1)


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Sorted distinct XXH64 of word shingles; A-Z are lower-cased.  A shorter text is one shingle, one without a word has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + k]), SEED) for i in range(len(words) - k + 1)), np.uint64, len(words) - k + 1))


def bands(own: np.ndarray) -> np.ndarray:
    """BANDS keys, each of ROWS minima of permuted hashes."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), PIECE):
        low = np.minimum(low, (_FACTORS * own[at : at + PIECE] + _SHIFTS).min(axis=1))
    data = low.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(data)], np.uint64).view(np.int64)


def sketch(own: np.ndarray) -> np.ndarray:
    """Parities of how many hashes fall on each of SKETCH bits: two sets' sketches differ in no more bits than the sets in members."""
    return np.packbits(np.bincount((own % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1, bitorder="little").view(np.int64)


def _signatures(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sets = [shingle_set(t, shingle) for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            fps = np.array([fold(s[at : at + FOLDED] for at in range(0, len(s), FOLDED)) for s in sets], np.uint64).view(np.int64)
            digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            keys = pa.array([bands(s) if len(s) else [] for s in sets], pa.list_(pa.int64()))
            parity = pa.array([sketch(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), digests, pa.array([len(s) for s in sets], pa.int64()), pa.array(fps), keys, parity], ["row", "digest", "n", "fp", "keys", "parity"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sets = [shingle_set(t, shingle).view(np.int64) for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sets, pa.list_(pa.int64()))], ["row", "set"])

    return run


def close(nodes: DataFrame) -> DataFrame:
    """(id, n, id2, n2): of nodes (id, n, fp) each with the first of its fingerprint, and that with the first it meets at three bits or fewer.

    SimHash of the distinct shingles; the fingerprints' links are those of
    multi-index hashing.  A node has two pairs at most, so a large group of
    close copies gives a linear number of them.
    """
    first = cut(nodes.groupBy("fp").agg(F.min(F.struct("id", "n")).alias("of")).select("fp", "of.*"))
    other = first.select("fp", F.col("id").alias("id2"), F.col("n").alias("n2"))
    same = nodes.join(other, "fp").filter("id <> id2").select("id", "n", "id2", "n2")
    met = links(first.select("id", "fp")).groupBy("v").agg(F.min("u").alias("id2"))
    return same.union(met.join(first, F.col("v") == F.col("id")).join(other.drop("fp").withColumnRenamed("id2", "of"), F.col("id2") == F.col("of")).select("id", "n", "id2", "n2"))


def classes(rows: DataFrame, *, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(row, component) of every row of (row long, text): component is the smallest row of those linked at `similarity` or more.

    Rows of equal sets are one node.  SimHash fingerprints within three bits of
    64 name the closest copies.  A pair at 0.8 would need about 19 bits, which
    no ball of multi-index hashing covers, so MinHash bands name the rest: each
    member of a band's bucket is verified with the bucket's hub first, the one
    that meets most others in all its buckets: a linear number of pairs joins a
    large group around its centre.  Then every pair of a bucket whose ends are
    still apart is verified, but for those whose sizes or sketches prove that
    they are less alike.
    """
    own = cut(rows.mapInArrow(_signatures(shingle), "row long, digest binary, n long, fp long, keys array<long>, parity array<long>"))
    nodes = own.groupBy("digest").agg(F.min("row").alias("id"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("parity").alias("parity"))
    cells = cut(nodes.select("id", "n", F.explode("keys").alias("key")).withColumn("size", F.count("*").over(Window.partitionBy("key"))).filter("size > 1"))
    sized = F.least("n", "n2") >= similarity * F.greatest("n", "n2") - 1e-9

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs.select(F.least("id", "id2").alias("u"), F.greatest("id", "id2").alias("v")).distinct())
        ends = pairs.select(F.col("u").alias("row")).union(pairs.select(F.col("v").alias("row"))).distinct()
        sets = cut(rows.join(ends, "row").mapInArrow(_sets(shingle), "row long, set array<long>"))
        both = pairs.join(sets.select(F.col("row").alias("u"), F.col("set").alias("a")), "u").join(sets.select(F.col("row").alias("v"), F.col("set").alias("b")), "v")
        both = both.select("u", "v", (F.size("a") + F.size("b")).alias("total"), F.size(F.array_intersect("a", "b")).alias("common"))
        return cut(both.filter(F.col("common") >= similarity * (F.col("total") - F.col("common")) - 1e-9).select("u", "v"))

    met = cells.groupBy("id").agg(F.sum("size").alias("met"))
    hubs = cells.join(met, "id").groupBy("key").agg(F.max_by(F.struct(F.col("id").alias("id2"), F.col("n").alias("n2")), F.struct("met", -F.col("id"))).alias("hub"))
    hubs = cells.join(hubs, "key").select("id", "n", "hub.*").filter("id <> id2")
    found = linked(close(nodes.select("id", "n", "fp")).union(hubs).filter(sized))
    named = cells.join(components(found), "id", "left").select("id", "n", "key", F.coalesce("component", "id").alias("c"))
    apart = Window.partitionBy("key")
    named = named.withColumn("lo", F.min("c").over(apart)).withColumn("hi", F.max("c").over(apart)).filter("lo <> hi").drop("lo", "hi")
    # a sketch lies in columns that are never null, so that comparing two is a short compiled loop body
    parity = [F.coalesce(F.col("parity")[i], F.lit(0)).alias(f"p{i}") for i in range(SKETCH // 64)]
    named = cut(named.join(nodes.select("id", "parity"), "id").select("id", "n", "key", "c", *parity))
    other = named.select("key", F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("c").alias("c2"), *[F.col(f"p{i}").alias(f"q{i}") for i in range(SKETCH // 64)])
    differ = sum((F.bit_count(F.col(f"p{i}").bitwiseXOR(F.col(f"q{i}"))) for i in range(SKETCH // 64)), F.lit(0))
    alike = differ * (1 + similarity) <= (1 - similarity) * (F.col("n") + F.col("n2")) + 1e-6
    found = found.union(linked(named.join(other, "key").filter("c < c2").filter(sized).filter(alike)))
    found = components(found).withColumnRenamed("id", "first")
    node = own.groupBy("digest").agg(F.min("row").alias("first")).join(found, "first", "left").select("digest", F.coalesce("component", "first").alias("component"))
    return own.select("row", "digest").join(node, "digest").select("row", "component")

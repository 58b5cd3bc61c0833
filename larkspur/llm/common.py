"""Helpers shared by the text operators: shared folders, words, sliced batches, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once in a Python worker; bounds its memory whatever the batch size.
SLICE_BYTES = 2 << 20


def shared_dir(spark: SparkSession, kind: str) -> str:
    """A new folder name under spark.checkpoint.dir, which driver and executors share."""
    return f"{checkpoint_root(spark)}/{kind}-{uuid.uuid4().hex}"


def checkpoint_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder stands in only where it is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if root is None:
        known = jsc.getCheckpointDir()
        root = known.get() if known.isDefined() else "file://" + tempfile.mkdtemp(prefix="checkpoints-")
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that a lost executor loses none of it."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def remove_dir(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def column(name: str) -> Column:
    """A top-level column, whatever marks its name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches whose text column holds about `limit` bytes at most (one row may exceed it); null texts become ''."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        texts = batch.column(at).cast(pa.large_string()).fill_null("")
        batch = batch.set_column(at, column, texts)
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        del batch, texts
        release_memory()


def release_memory() -> None:
    """Give freed memory back to the system: Spark keeps its Python workers for later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of all texts in a row, and the offset of each text's first word (one more at the end)."""
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0)
    keep = np.concatenate(([0], np.cumsum(np.asarray(full.to_numpy(zero_copy_only=False), dtype=np.int64))))
    return flat.filter(full), keep[offsets]


def word_hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hashes of words; each distinct word is hashed once."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    enc = words.dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    names = enc.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    own = np.fromiter(map(digest, names) if not seed else (digest(w, seed) for w in names), dtype=np.uint64, count=len(names))
    return own[enc.indices.to_numpy(zero_copy_only=False)]


def seg_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive offsets; empty segments give 0."""
    return np.diff(np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[offsets])


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every end of `edges` (u, v): the smallest id that can be reached.

    Min-label propagation with pointer jumping.  Labels and edges stay
    distributed; each round is checkpointed and only a count reaches the driver.
    """
    both = cut(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("label")))
    while True:
        low = both.join(labels.select(F.col("id").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("m"))
        step = labels.join(low, F.col("id") == F.col("u")).select("id", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        root = step.select(F.col("id").alias("root"), F.col("label").alias("jump"))
        new = cut(step.join(root, F.col("label") == F.col("root")).select("id", "old", F.least("label", "jump").alias("label")))
        if new.filter("label <> old").isEmpty():
            return new.select("id", F.col("label").alias("component"))
        labels = new.select("id", "label")

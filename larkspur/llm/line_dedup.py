"""Line dedup by levelled sorted runs of line hashes (DataFrame functions only)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, remove_dir, shared_dir

BLANKS = " \t\n\x0b\f\r"
#: Frequent keys (16 bytes each) that are broadcast at most; more are joined by shuffles, where AQE splits skewed ones.
FEW = 1 << 19
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")


def _row_keys(docs: DataFrame, text: str, min_chars: int, *more: Column) -> DataFrame:
    """(h1, h2, more...) once for each row of docs and each key of min_chars code points or more in it."""
    keys = F.array_distinct(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), line_key))
    exploded = docs.select(F.explode(keys).alias("__key"), *more).filter(F.char_length("__key") >= min_chars)
    return exploded.select(*_hashes(F.col("__key")), *[c for c in exploded.columns if c != "__key"])


class LineRuns:
    """Runs of (h1, h2, n), sorted by hash: in how many documents of the batches so far a line key was found.

    A batch is merge-anti-joined with the keys that the runs already know to be
    frequent and the rest is added as a run of level 0.  `fanout` runs of a
    level are merged into one of the next, adding up n.  Runs are bucketed by
    hash, a sorted file a bucket, so a join with a run shuffles and sorts the
    batch alone and a merge of two runs shuffles and sorts nothing.  They lie in the shared checkpoint
    folder, so a lost executor loses none; each is named by its number of
    buckets and the batches that it covers.  A driver that starts again with the
    same root goes on after the last batch that was written whole: of runs that
    cover the same batches, the widest counts.
    """

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 2, root: str | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.root = root or shared_dir(spark, "line-runs")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.names: dict[str, str] = {}
        self.batches = 0
        if root is not None:
            self._resume()

    def _resume(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        whole = [f"{self.root}/{x.getPath().getParent().getParent().getName()}/{x.getPath().getParent().getName()}" for x in fs.globStatus(path(f"{self.root}/level*/run*/_SUCCESS")) or []]
        kept: list[tuple[int, int]] = []
        for p in sorted(whole, key=lambda p: self._span(p)[0] - self._span(p)[1]):
            low, high = self._span(p)
            if not any(a <= low and high <= b for a, b in kept):
                kept.append((low, high))
                level = int(p.split("/")[-2].removeprefix("level"))
                while len(self.levels) <= level:
                    self.levels.append([])
                self.levels[level].append(p)
                self.batches = max(self.batches, high + 1)

    @staticmethod
    def _span(path: str) -> tuple[int, int]:
        low, high, _ = path.rsplit("/run", 1)[1].split("-")
        return int(low), int(high)

    def _open(self, path: str) -> DataFrame:
        if path not in self.names:
            self.names[path], n = f"line_run_{uuid.uuid4().hex}", path.rsplit("-", 1)[1]
            self.spark.sql(f"CREATE TABLE {self.names[path]} (h1 BIGINT, h2 BIGINT, n BIGINT) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {n} BUCKETS LOCATION '{path}'")
        return self.spark.table(self.names[path])

    def _write(self, run: DataFrame, level: int, low: int, high: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        path = f"{self.root}/level{level}/run{low}-{high}-{self.buckets}"
        name = self.names[path] = f"line_run_{uuid.uuid4().hex}"
        order = "spark.sql.legacy.bucketedTableScan.outputOrdering"
        before = self.spark.conf.get(order, None)
        self.spark.conf.set(order, "true")  # a bucket is one file here, read in its order
        try:
            run.repartition(self.buckets, "h1", "h2").write.mode("overwrite").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        finally:
            self.spark.conf.unset(order) if before is None else self.spark.conf.set(order, before)
        self.levels[level].append(path)

    def _merged(self, paths: list[str]) -> DataFrame:
        def both(a: DataFrame, b: DataFrame) -> DataFrame:
            n = F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))
            return a.join(b.withColumnRenamed("n", "n2"), ["h1", "h2"], "full").select("h1", "h2", n.alias("n"))

        # a merge join of sorted runs; a union of bucketed tables would lose its partitioning in this version of Spark
        return reduce(both, map(self._open, paths))

    def _drop(self, path: str) -> None:
        if path in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.names.pop(path)}")
        remove_dir(self.spark, path)

    def add(self, keys: DataFrame) -> None:
        own = keys.groupBy("h1", "h2").agg(F.count("*").alias("n"))
        for path in (p for level in self.levels for p in level):
            known = self._open(path).filter(F.col("n") >= self.min_docs).select("h1", "h2")
            own = own.join(known, ["h1", "h2"], "left_anti")
        self._write(own, 0, self.batches, self.batches)
        self.batches += 1
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            spans = [self._span(p) for p in old]
            self._write(self._merged(old), level + 1, min(a for a, _ in spans), max(b for _, b in spans))
            for path in old:
                self._drop(path)
            level += 1

    def frequent(self) -> DataFrame:
        """(h1, h2) of the keys found in min_docs documents or more, checkpointed."""
        return cut(self._merged([p for level in self.levels for p in level]).filter(F.col("n") >= self.min_docs).select("h1", "h2"))

    def close(self) -> None:
        """Remove all runs."""
        for level in self.levels:
            for path in level:
                self._drop(path)


def dedup_lines(docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1, batches: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop every line whose key is found in `min_docs` documents or more.

    Returns all columns of docs, the text without those lines, and `n_lines`
    (before) and `n_dropped`; columns of docs with these two names are replaced.

    A null or empty text is one empty line and is kept as ''.  Each row counts
    as a document, so rows that repeat an id count each.  Blank lines have no
    key of `min_chars` and always stay.  An empty table gives an empty table.
    Documents come in `batches` by ranges of the id, which Parquet statistics
    prune; rows with a null id are in the first.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    given, (id_col, text_col) = docs.columns, (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    docs = docs.toDF(*[f"c{i}" for i in range(len(given))])  # no name can clash with those used here
    runs = LineRuns(spark, min_docs)
    low, high = docs.agg(F.min(id_col), F.max(id_col)).first()
    bounds = [low + (high - low + 1) * i // batches for i in range(1, batches)] if isinstance(low, int) else []
    edges = list(dict.fromkeys([None, *bounds, None])) if not bounds else [None, *dict.fromkeys(bounds), None]
    if edges == [None]:
        edges = [None, None]
    for a, b in zip(edges, edges[1:]):
        part = docs
        if b is not None:
            part = part.filter((F.col(id_col) < b) | F.col(id_col).isNull()) if a is None else part.filter(F.col(id_col) < b)
        if a is not None:
            part = part.filter(F.col(id_col) >= a)
        runs.add(_row_keys(part, text_col, min_chars))
    often = runs.frequent()
    runs.close()
    if often.count() <= FEW:  # sent to where the lines are, so that a line of very many documents goes to no task of its own
        often = F.broadcast(often)
    hits = (
        _row_keys(docs, text_col, min_chars, F.col(id_col).alias("__id"))
        .join(often, ["h1", "h2"])
        .groupBy("__id")
        .agg(F.collect_set("h1").alias("__drop"))
    )
    joined = docs.join(hits, F.col(id_col).eqNullSafe(F.col("__id")), "left")
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(text, "\n")
    left = F.filter(lines, lambda x: (F.char_length(line_key(x)) < min_chars) | ~F.array_contains(F.col("__drop"), F.xxhash64(line_key(x))))
    joined = joined.withColumn("__left", F.when(F.col("__drop").isNotNull(), left))
    out = {c: F.coalesce(F.array_join("__left", "\n"), text) if c == text_col else F.col(c) for c in docs.columns}
    joined = joined.select(
        *[v.alias(k) for k, v in out.items()],
        F.size(lines).cast("long").alias("n_lines"),
        F.when(F.col("__left").isNull(), 0).otherwise(F.size(lines) - F.size("__left")).cast("long").alias("n_dropped"),
    )
    return joined.toDF(*given, "n_lines", "n_dropped")

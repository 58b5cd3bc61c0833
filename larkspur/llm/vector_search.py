"""Approximate nearest neighbours: hierarchical k-means tree, best-bin-first visits, calibrated recall."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BRANCHES = 8
#: The tree is fitted on this many vectors at most; every row is indexed.
SAMPLE = 32768
#: Queries with which the number of leaf visits is calibrated, against exact results over all rows.
CALIBRATION = 128
BLOCK = 4096  # points of neighbouring leaves that a row holds, about
QUERY_BLOCK = 512


class Tree:
    """Centroids of a hierarchical k-means tree; nodes are numbered, leaves too."""

    def __init__(self, points: np.ndarray, leaf_size: int, seed: int = 7):
        self.centroids: list[np.ndarray] = []  # of a node's children
        self.children: list[list[int]] = []  # node numbers, or -1 - leaf
        self.leaves = 0
        self._grow(points, leaf_size, np.random.default_rng(seed))

    def _grow(self, points: np.ndarray, leaf_size: int, rng) -> int:
        if len(points) <= leaf_size:
            self.leaves += 1
            return -self.leaves
        centers, own = _kmeans(points, min(BRANCHES, len(points)), rng)
        if len(centers) < 2:
            self.leaves += 1
            return -self.leaves
        node = len(self.children)
        self.children.append([])
        self.centroids.append(centers)
        self.children[node] = [self._grow(points[own == i], leaf_size, rng) for i in range(len(centers))]
        return node

    def assign(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point: the nearest centroid at every level."""
        out = np.zeros(len(points), np.int32)
        if not self.children:
            return out
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            near = _distances(points[rows], self.centroids[node]).argmin(1)
            for i, child in enumerate(self.children[node]):
                mine = rows[near == i]
                if child < 0:
                    out[mine] = -1 - child
                elif len(mine):
                    todo.append((child, mine))
        return out

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """The first `most` leaves, best bin first: the nearest unexpanded centroid of the whole tree comes next."""
        if not self.children:
            return [0]
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if node < 0:
                out.append(-1 - node)
                continue
            for d, child in zip(_distances(query[None], self.centroids[node])[0].tolist(), self.children[node]):
                heapq.heappush(queue, (d, child))
        return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T


def _kmeans(points: np.ndarray, k: int, rng, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    centers = points[rng.choice(len(points), k, replace=False)]
    for _ in range(rounds):
        own = _distances(points, centers).argmin(1)
        used = np.unique(own)
        centers = np.stack([points[own == i].mean(0) for i in used])
    own = _distances(points, centers).argmin(1)
    used, own = np.unique(own, return_inverse=True)
    return centers[used], own


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _augment(v: np.ndarray, longest: float) -> np.ndarray:
    """Points whose distances to (q, 0) order them as their inner products with q do, longest first."""
    return np.concatenate([v, np.sqrt(np.maximum(longest - (v * v).sum(1), 0))[:, None]], axis=1)


def _padded(q: np.ndarray) -> np.ndarray:
    return np.concatenate([q, np.zeros((len(q), 1))], axis=1)


def _best(scores: np.ndarray, k: int, names: np.ndarray) -> np.ndarray:
    """Columns of the k largest scores of each row, ties to smaller names; -1 where there are fewer."""
    out = np.full((len(scores), k), -1, np.int64)
    for i, row in enumerate(scores):
        at = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
        at = at[np.lexsort((names[at], -row[at]))[:k]]
        out[i, : len(at)] = at
    return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec array<double>) of the vectors that take part."""
    v = F.col("vec")
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec")).filter("id is not null and vec is not null")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return plain.filter(~bad & F.exists(v, lambda x: x != 0))


def nearest(
    vectors: DataFrame, *, every: int = 20, k: int = 20, target: float = 0.95, sample: int = SAMPLE, calibration: int = CALIBRATION, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by `every`, by inner product.

    Scores are inner products of the original vectors in double precision, ties
    go to the smaller id.  Equal vectors are one point of the index with its
    k + 1 smallest ids, which are all that can be among the k nearest.  The tree
    is fitted on `sample` points (those of the smallest id hashes); leaf visits
    are widened until the exact neighbours of `calibration` queries are found
    with a mean recall of `target`.

    Vectors that are null, zero, of another length than most, or hold a null or
    non-finite component take no part.  Rows that repeat an id and vector are
    one candidate; of different vectors under one id each is a candidate, none
    of them for its own id.  Other columns are ignored.  An empty table gives
    an empty table.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors, id_col, vector_col)
    sizes = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    dim = sizes[0]["d"]
    rows = rows.filter(F.size("vec") == dim)

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the k + 1 smallest ids of each vector of a batch; the same again for all batches below
        for batch in batches:
            ids, m = batch.column("id").to_numpy(), _matrix(batch.column("vec"), dim) + 0.0
            kinds: dict[bytes, list[int]] = {}
            for i in np.argsort(ids, kind="stable"):
                own = kinds.setdefault(m[i].tobytes(), [])
                if len(own) <= k and (not own or own[-1] != ids[i]):
                    own.append(int(ids[i]))
            yield pa.RecordBatch.from_arrays([pa.array(list(kinds), pa.binary()), pa.array(list(kinds.values()), pa.list_(pa.int64()))], ["key", "ids"])

    points = rows.mapInArrow(collapse, "key binary, ids array<long>").groupBy("key").agg(F.expr(f"slice(array_sort(array_distinct(flatten(collect_list(ids)))), 1, {k + 1})").alias("ids"))
    points = cut(points)
    total = points.count()

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.frombuffer(b"".join(batch.column(0).to_pylist())).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([pa.array([(m * m).sum(1).max()])], ["n"])

    longest = points.select("key").mapInArrow(norms, "n double").agg(F.max("n")).first()[0]
    fit = points.select("key").orderBy(F.xxhash64("key"), "key").limit(sample).toArrow().column("key").to_pylist()
    leaf_size = max(16, -(-len(fit) // max(1, min(len(fit) // 24, 2 * int(total**0.5)))))
    tree = Tree(_augment(np.frombuffer(b"".join(fit)).reshape(-1, dim), longest), leaf_size)
    sent = spark.sparkContext.broadcast(tree)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.frombuffer(b"".join(batch.column("key").to_pylist())).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([pa.array(sent.value.assign(_augment(m, longest))), batch.column("key"), batch.column("ids")], ["leaf", "key", "ids"])

    indexed = cut(points.mapInArrow(index, "leaf int, key binary, ids array<long>"))
    queries = rows.filter(F.col("id") % every == 0).select("id", "vec")

    # calibration: exact neighbours of some queries over all rows, and the visit that reaches each one's leaf
    probes = queries.orderBy(F.xxhash64("id"), "id").limit(calibration).toArrow()
    q_ids, q = probes.column("id").to_numpy(), _matrix(probes.column("vec").combine_chunks(), dim)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            m = np.frombuffer(b"".join(batch.column("key").to_pylist())).reshape(-1, dim)
            s, leaf = q @ m.T, batch.column("leaf").to_numpy()
            found = [(i, s[i, j], n, leaf[j]) for i, best in enumerate(_best(s, k + 1, np.array([x[0] for x in ids]))) for j in best if j >= 0 for n in ids[j] if n != q_ids[i]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 4, (pa.int32(), pa.float64(), pa.int64(), pa.int32()))], ["q", "score", "id", "leaf"])

    visits = 1
    if len(q_ids):
        first = Window.partitionBy("q").orderBy(F.desc("score"), "id")
        truth = indexed.mapInArrow(exact, "q int, score double, id long, leaf int").withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k).select("q", "leaf").collect()
        order = [{leaf: n for n, leaf in enumerate(tree.visits(v, tree.leaves))} for v in _padded(q)]
        needed = np.sort([order[r["q"]][r["leaf"]] + 1 for r in truth])
        if len(needed):
            while visits < tree.leaves and (needed <= visits).mean() < target:
                visits = min(tree.leaves, visits + max(1, visits // 4))

    # neighbouring leaves form groups of about BLOCK points; a larger group is split by hash
    groups = max(1, min(tree.leaves, total // BLOCK))
    group_of = lambda leaf: leaf * groups // tree.leaves
    grouped = indexed.withColumn("group", F.expr(f"int(bigint(leaf) * {groups} div {tree.leaves})"))
    counts = {r["group"]: -(-r["n"] // (2 * BLOCK)) for r in grouped.groupBy("group").agg(F.count("*").alias("n")).collect()}  # as many as leaves at most
    parts = spark.sparkContext.broadcast(counts)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a row for each group that queries of a slice visit: these queries once, and which of its leaves each visits
        for batch in batches:
            ids, m = batch.column("id").to_numpy(), _matrix(batch.column("vec"), dim)
            for a in range(0, len(ids), QUERY_BLOCK):
                seen: dict[int, tuple[list, list]] = {}
                for i, v in enumerate(_padded(m[a : a + QUERY_BLOCK])):
                    for leaf in sent.value.visits(v, visits):
                        who, where = seen.setdefault(group_of(leaf), ([], []))
                        who.append(a + i)
                        where.append(leaf)
                rows = []
                for g, (who, where) in seen.items():
                    own, at = np.unique(who, return_inverse=True)
                    rows += [(g, p, ids[own].tolist(), m[own].tobytes(), at.tolist(), where) for p in range(parts.value.get(g, 0))]
                kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], ["group", "part", "queries", "vectors", "who", "where"])

    asked = queries.mapInArrow(ask, "group int, part int, queries array<long>, vectors binary, who array<int>, where array<int>")
    n_parts = F.broadcast(spark.createDataFrame(list(counts.items()), "group int, n_parts int"))  # as many as groups
    blocks = grouped.join(n_parts, "group").withColumn("part", F.pmod(F.xxhash64("key"), F.col("n_parts")).cast("int")).groupBy("group", "part").agg(F.collect_list(F.struct("leaf", "key", "ids")).alias("points"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_names, q_raw, who, where, has in zip(*(batch.column(c) for c in ("queries", "vectors", "who", "where", "points"))):
                names, has = q_names.values.to_pylist(), has.values
                m = np.frombuffer(b"".join(has.field("key").to_pylist())).reshape(-1, dim)
                ids, leaf = has.field("ids").to_pylist(), has.field("leaf").to_numpy()
                low = np.array([x[0] for x in ids])
                s = np.frombuffer(q_raw.as_py()).reshape(-1, dim) @ m.T
                leaves, at = np.unique(leaf, return_inverse=True)
                visited = np.zeros((len(names), len(leaves) + 1), bool)
                where = where.values.to_numpy()
                pos = np.minimum(np.searchsorted(leaves, where), len(leaves) - 1)
                visited[who.values.to_numpy(), np.where(leaves[pos] == where, pos, len(leaves))] = True
                s[~visited[:, at]] = -np.inf
                out = []
                for i, best in enumerate(_best(s, k + 1, low)):
                    mine = sorted((-s[i, j], n) for j in best if j >= 0 and s[i, j] > -np.inf for n in ids[j] if n != names[i])[:k]
                    out += [(names[i], n, -d) for d, n in mine]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    met = asked.join(blocks, ["group", "part"]).select("queries", "vectors", "who", "where", "points").mapInArrow(meet, "query_id long, vec_id long, score double")
    met = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

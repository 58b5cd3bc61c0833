"""Quality classifier: EM over overlapping heuristic labellers; their posteriors train a hashed linear scorer."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut, seg_sum, split_words, text_slices
from .quality_rules import _langs, _of, _word_counts, base_counts, class_counts, fit_references, js_distance

BUCKETS = 1 << 15
#: Documents that train the scorer at most: those of the smallest id hashes.
TRAINING_ROWS = 4000
#: (name, good if between, bad if outside) of each labeller; it abstains in between.
LABELLERS = (
    ("common word share", (0.15, 1.0), (0.06, 1.0)),
    ("symbols per character", (0.0, 0.01), (0.0, 0.05)),
    ("upper-case share", (0.003, 0.15), (0.0, 0.5)),
    ("repeated words share", (0.0, 0.15), (0.0, 0.4)),
    ("characters per word", (3.0, 9.0), (2.0, 13.0)),
    ("character divergence", (0.0, 0.18), (0.0, 0.3)),
    ("end marks per word", (0.01, 0.25), (0.002, 0.5)),
    ("logarithm of distinct words in that of words", (0.75, 1.0), (0.6, 1.0)),
    ("words without a letter or digit", (0.0, 0.02), (0.0, 0.15)),
)


def measures(texts: pa.Array, langs: np.ndarray, refs: dict[str | None, dict]) -> np.ndarray:
    """(documents, labellers): what each labeller looks at."""
    words, offsets = split_words(texts)
    n, chars = base_counts(texts, (words, offsets)), class_counts(texts)
    letters = np.maximum(chars[:, 0] + chars[:, 1] + chars[:, 2], 1)
    size, long = np.maximum(n["n_words"], 1), np.maximum(n["word_chars"], 1)
    common, far = np.zeros(len(langs)), np.zeros(len(langs))
    for one in set(langs) & set(refs):
        mine = np.flatnonzero(_of(langs, one))
        spoken = [w for w in refs[one]["words"] if any(map(str.isalpha, w))]
        common[mine] = _word_counts(words, offsets, spoken)[mine, :-1].sum(1) / size[mine]
        far[mine] = js_distance(chars[mine], refs[one]["chars"])
    enc = words.dictionary_encode()
    code = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(words) else np.zeros(0, np.int64)
    mark = ~pc.match_substring_regex(enc.dictionary, r"[\pL\pN]").to_numpy(zero_copy_only=False)[code]
    own = np.repeat(np.arange(len(langs)), np.diff(offsets))
    top = int(code.max()) + 1 if len(code) else 1
    distinct = np.bincount(np.unique(own * top + code) // top, minlength=len(langs))
    rows = (common, n["n_symbols"] / long, chars[:, 0] / letters, n["n_repeat_words"] / size, n["word_chars"] / size, far, chars[:, 4] / size, np.log1p(distinct) / np.log1p(size), seg_sum(mark, offsets) / size)
    return np.stack(rows, axis=1)


def votes(found: np.ndarray) -> np.ndarray:
    """1 good, 2 bad, 0 abstains."""
    out = np.zeros(found.shape, np.int8)
    for i, (_, good, bad) in enumerate(LABELLERS):
        x = found[:, i]
        out[(x >= good[0]) & (x <= good[1]), i] = 1
        out[(x < bad[0]) | (x > bad[1]), i] = 2
    return out


class LabelModel:
    """Two classes; each labeller's votes have a distribution of their own in each class."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 100):
        k = patterns.shape[1]
        good = ((patterns == 1).sum(1) + 1.0) / ((patterns > 0).sum(1) + 2.0)
        good = np.where((patterns == 2).sum(1) > 1, np.minimum(good, 0.3), good)
        for _ in range(rounds):
            weight = np.stack([1 - good, good]) * counts
            self.prior = (weight.sum(1) + 1) / (weight.sum() + 2)
            table = np.stack([[np.bincount(patterns[:, j], w, 3) + 1 for j in range(k)] for w in weight])
            self.table = table / table.sum(2, keepdims=True)
            new = self.posterior(patterns)
            if np.abs(new - good).max() < 1e-9:
                break
            good = new

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(good) of each row of votes."""
        at = np.arange(patterns.shape[1])
        both = np.stack([np.log(self.prior[c]) + np.log(self.table[c][at, patterns]).sum(1) for c in (0, 1)])
        return 1 / (1 + np.exp(np.clip(both[0] - both[1], -500, 500)))

    def accuracies(self) -> np.ndarray:
        """How often each labeller is right when it votes."""
        right = self.prior[1] * self.table[1][:, 1] + self.prior[0] * self.table[0][:, 2]
        return right / (right + self.prior[1] * self.table[1][:, 2] + self.prior[0] * self.table[0][:, 1])


class _Kinds(dict):
    """Code point -> A for upper case, a for other letters, 0 for digits, else itself; filled as characters are met."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return self[point]


_KINDS = _Kinds()
_RUN = re.compile(r"(.)\1+", re.S)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two buckets of each word (itself; its shape, or that it repeats the word before) and the offsets of texts.

    A shape is the word's kinds of characters, runs of one kind as one.
    """
    words, offsets = split_words(texts)
    enc = words.dictionary_encode()
    names, digest, size = enc.dictionary.to_numpy(zero_copy_only=False), xxhash.xxh3_64_intdigest, np.uint64(BUCKETS - 1)
    own = (np.fromiter(map(digest, names), np.uint64, len(names)) % size + np.uint64(1)).astype(np.int32)
    kinds = [w.translate(_KINDS) for w in names]
    known = {k: int(digest("shape " + _RUN.sub(r"\1", k)) % (BUCKETS - 1) + 1) for k in set(kinds)}
    forms = np.fromiter(map(known.__getitem__, kinds), np.int32, len(kinds))
    code = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    again = np.zeros(len(code), bool)
    again[1:] = code[1:] == code[:-1]
    again[offsets[:-1][offsets[:-1] < len(code)]] = False
    return own[code], np.where(again, 0, forms[code]), offsets


def train(sets: list[np.ndarray], labels: np.ndarray, rounds: int = 200, rate: float = 1.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic scorer of mean bucket weights, by full-batch Adagrad."""
    size = np.array([max(len(s), 1) for s in sets])
    own, at = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets) if sets else np.zeros(0, int)
    share = 2.0 / size[own]
    w, b, seen, seen_b = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(own, w[at] * share, len(sets)) + b
        miss = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels) / len(sets)
        g = np.bincount(at, miss[own] * share, BUCKETS) + decay * w / len(sets)
        seen += g * g
        w -= rate * g / np.sqrt(seen)
        seen_b += miss.sum() ** 2
        b -= rate * miss.sum() / np.sqrt(seen_b)
    return w, b


def classify(docs: DataFrame, *, training_rows: int = TRAINING_ROWS, keep_from: float = 0.5, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, posterior, score, kept) of every row of docs (id, lang, text).

    posterior: P(good) by the label model, whose accuracies are estimated from
    the vote patterns of all documents (3 ** labellers patterns at most).
    score: P(good) by a linear scorer over hashed words and word shapes,
    trained on the posteriors of `training_rows` documents, those of the
    smallest hashes of id and text (of fewer, all).  kept: score >= keep_from.

    The labellers look at each text once: votes are stored as one number a row,
    from which the patterns are counted, the training rows chosen and the
    posteriors read.  A null or blank text has posterior 0 and score 0 and is
    not kept.  A null language is a language of its own.  Repeated rows give a
    row each; other columns are ignored; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    plain = docs.select(column(id_col).cast("long").alias("doc_id"), "lang", "text")
    plain = plain.withColumn("key", F.xxhash64("doc_id", "lang", "text"))
    refs = spark.sparkContext.broadcast(fit_references(plain))
    weights = np.array([3**i for i in range(len(LABELLERS))])

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            found = votes(measures(batch.column("text"), _langs(batch), refs.value)).astype(np.int64) @ weights
            blank = np.diff(split_words(batch.column("text"))[1]) == 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(found), pa.array(blank)], ["doc_id", "key", "p", "blank"])

    # equal rows have equal votes: one of them stands for all, with their number
    voted = plain.mapInArrow(vote, "doc_id long, key long, p long, blank boolean")
    voted = cut(voted.groupBy("doc_id", "key").agg(F.first("p").alias("p"), F.first("blank").alias("blank"), F.count("*").alias("n")))
    found = voted.groupBy("p").agg(F.sum("n").alias("n")).orderBy("p").collect()
    if not found:
        return plain.select("doc_id", F.lit(0.0).alias("posterior"), F.lit(0.0).alias("score"), F.lit(False).alias("kept"))
    digits = np.array([[r["p"] // w % 3 for w in weights] for r in found])
    good = LabelModel(digits, np.array([r["n"] for r in found], float)).posterior(digits)
    belief = F.broadcast(spark.createDataFrame([(r["p"], float(x)) for r, x in zip(found, good)], "p long, posterior double"))

    # smallest hashes: bins of them (65,536 at most) tell how far to look, so that about as many rows are sorted as are needed
    able, stop, need = voted.filter("NOT blank"), -(1 << 15), training_rows
    for r in able.groupBy(F.shiftright("key", 48).alias("bin")).count().orderBy("bin").collect():
        stop, need = r["bin"], need - r["count"]
        if need <= 0:
            break
    chosen = cut(able.filter(F.shiftright("key", 48) <= stop).orderBy("key", "doc_id").limit(training_rows).join(belief, "p").select(F.col("doc_id").alias("id"), F.col("key").alias("k"), "posterior"))

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            word, shape, at = features(batch.column("text"))
            rows = [np.concatenate((word[a:b], shape[a:b])).astype("<u2").tobytes() for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), batch.column("posterior"), pa.array(rows, pa.binary())], ["doc_id", "key", "p", "x"])

    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k"))
    rows = plain.join(F.broadcast(chosen), same).select("doc_id", "key", "posterior", "text").mapInArrow(examples, "doc_id long, key long, p double, x binary")
    rows = rows.groupBy("doc_id", "key").agg(F.first("p").alias("p"), F.first("x").alias("x")).orderBy("key", "doc_id").toArrow()
    sets = [np.frombuffer(x, "<u2").astype(np.int64) for x in rows.column("x").to_pylist()]
    scorer = spark.sparkContext.broadcast(train(sets, rows.column("p").to_numpy()) if sets else (np.zeros(BUCKETS), 0.0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            (w, b), (word, shape, at) = scorer.value, features(batch.column("text"))
            size = np.diff(at)
            sums = np.diff(np.concatenate(([0.0], np.cumsum(w[word] + w[shape])))[at])
            p = np.where(size > 0, 1 / (1 + np.exp(-np.clip(sums / np.maximum(size, 1) + b, -50, 50))), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(p), pa.array((p >= keep_from) & (size > 0))], ["doc_id", "key", "score", "kept"])

    scored = plain.select("doc_id", "key", "text").mapInArrow(score, "doc_id long, key long, score double, kept boolean")
    votes_of = voted.join(belief, "p").select(F.col("doc_id").alias("id"), F.col("key").alias("k"), F.when(F.col("blank"), 0.0).otherwise(F.col("posterior")).alias("posterior"))
    return scored.join(votes_of, same).select("doc_id", "posterior", "score", "kept")

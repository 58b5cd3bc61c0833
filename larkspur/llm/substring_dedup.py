"""Exact substring dedup by level-wise doubling of repeated word windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, split_words, text_slices, word_hashes

#: Bits of the pruning filter between levels.  It is of fixed size: once it
#: fills up it only prunes less, and the exact last level counts more windows.
FILTER_BITS = 1 << 26
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def _twist(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * MIX2
    return h ^ (h >> np.uint64(29))


def doubled(h: np.ndarray, length: int, base: int) -> np.ndarray:
    """Hashes of windows of 2*length words (at their starts) from those of length words; windows may cross documents."""
    n = len(h) - length
    return _twist(h[:n] * MIX + h[length : length + n] + np.uint64(length * base)) if n > 0 else np.zeros(0, np.uint64)


def base_windows(words: np.ndarray, base: int) -> np.ndarray:
    n = len(words) - base + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for i in range(base):
        acc = acc * MIX + words[i : i + n]
    return _twist(acc)


def _inside(offsets: np.ndarray, length: int, n: int) -> np.ndarray:
    """Of n starts, those whose window of `length` words ends in its own document."""
    ok = np.zeros(max(n, 0) + 1, np.int64)
    sizes = np.diff(offsets)
    at = np.flatnonzero(sizes >= length)
    np.add.at(ok, offsets[at], 1)
    np.add.at(ok, offsets[at] + sizes[at] - length + 1, -1)
    return np.cumsum(ok)[:n] > 0


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """The smallest of h[p:p+width] for each p."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    low, have = h, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    return low


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    m = np.uint64(len(bits) * 64 - 1)
    out = np.ones(len(h), bool)
    for probe in (h & m, (h >> np.uint64(32)) & m):
        out &= (bits[(probe >> np.uint64(6)).astype(np.int64)] >> (probe & np.uint64(63))) & np.uint64(1) > 0
    return out


class _Slice:
    """Word windows of a slice of documents."""

    def __init__(self, texts: pa.Array, window: int, base: int):
        self.words, self.offsets = split_words(texts)
        self.w = word_hashes(self.words)
        self.window, self.base = window, base
        self.sizes = np.diff(self.offsets)
        self.levels = [base]
        while self.levels[-1] * 2 < window:
            self.levels.append(self.levels[-1] * 2)
        self.h = [base_windows(self.w, base)]
        for length in self.levels[1:]:
            self.h.append(doubled(self.h[-1], length // 2, base))
        last, tip = self.h[-1], self.levels[-1]
        n = max(len(self.w) - window + 1, 0)
        rest = window - tip  # the last level overlaps itself where window is no power of two of base
        self.full = _twist(last[:n] * MIX + last[rest : rest + n] + np.uint64(window)) if n else np.zeros(0, np.uint64)
        self.ok = _inside(self.offsets, window, n)

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, side="right") - 1

    def content(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each document's word sequence."""
        out = np.zeros((len(self.sizes), 2), np.uint64)
        from xxhash import xxh3_128_digest

        raw = self.w.tobytes()
        for i, (a, b) in enumerate(zip(self.offsets, self.offsets[1:])):
            out[i] = np.frombuffer(xxh3_128_digest(raw[a * 8 : b * 8]), np.uint64)
        return out[:, 0], out[:, 1]

    def alive(self, filters: list[np.ndarray]) -> np.ndarray:
        """Starts of windows that hold, at each level counted so far, a repeated window."""
        live = self.ok.copy()
        for bits, length, h in zip(filters, self.levels, self.h):
            at = np.flatnonzero(live)
            live[at] = _passes(bits, _sliding_min(h, self.window - length + 1)[at])
        return np.flatnonzero(live)

    def anchors(self, level: int, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, document) of a level's windows that represent the live ones: the smallest hash in each, so equal windows are represented alike."""
        h, own = _sliding_min(self.h[level], self.window - self.levels[level] + 1)[live], self.owner(live)
        new = np.ones(len(live), bool)
        new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
        return h[new], own[new]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _level_rows(level: int, filters, window: int, base: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [f.value for f in filters]
        for batch in text_slices(batches):
            s = _Slice(batch.column("text"), window, base)
            h, own = s.anchors(level, s.alive(bits))
            if len(h):
                yield pa.RecordBatch.from_arrays([_signed(h), _signed(s.content()[0][own])], ["h", "c"])

    return run


def _window_rows(filters, window: int, base: int):
    """(h, g, c, id, pos) of each candidate window, the first of its kind in each document.

    A text that came earlier in the slice under a smaller id is left out: it is an exact copy, which is judged as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [f.value for f in filters]
        for batch in text_slices(batches):
            s = _Slice(batch.column("text"), window, base)
            at = s.alive(bits)
            if not len(at):
                continue
            own, h = s.owner(at), s.full[at]
            c1, c2 = s.content()
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            order = np.lexsort((ids, c2, c1))
            copy = np.zeros(len(ids), bool)
            copy[order[1:]] = (c1[order[1:]] == c1[order[:-1]]) & (c2[order[1:]] == c2[order[:-1]])
            good = ~copy[own]
            at, own, h = at[good], own[good], h[good]
            order = np.lexsort((at, h, own))
            first = np.ones(len(at), bool)
            first[1:] = (own[order][1:] != own[order][:-1]) | (h[order][1:] != h[order][:-1])
            pick = order[first]
            at, own, h = at[pick], own[pick], h[pick]
            g = (_twist(s.h[-1][at] + MIX) >> np.uint64(33)).astype(np.int32)
            for a in range(0, len(at), 1 << 18):
                z = slice(a, a + (1 << 18))
                yield pa.RecordBatch.from_arrays([_signed(h[z]), pa.array(g[z]), _signed(c1[own[z]]), pa.array(ids[own[z]]), pa.array((at[z] - s.offsets[own[z]]).astype(np.int32))], ["h", "g", "c", "id", "pos"])

    return run


def _filter_bits(repeated: DataFrame, bits: int) -> np.ndarray:
    """A filter of `bits` bits over the hashes: OR-ed on the executors, bits/64 words at most reach the driver."""
    probe = lambda c: F.col(c).bitwiseAND(bits - 1)
    words = (
        repeated.select(F.explode(F.array(probe("h"), F.shiftrightunsigned("h", 32).bitwiseAND(bits - 1))).alias("b"))
        .groupBy(F.shiftright("b", 6).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("m"))
    ).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("w").to_numpy()] = words.column("m").to_numpy().view(np.uint64)
    return out


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        s = _Slice(batch.column("text"), 2, 1)
        c1, c2 = s.content()
        yield pa.RecordBatch.from_arrays([batch.column("id"), _signed(c1), _signed(c2), pa.array(s.sizes)], ["id", "c", "c2", "n"])


def repeated_windows(docs: DataFrame, *, window: int = 20, base: int = 5, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(id, pos) of windows of `window` words that also start in an earlier document, for texts that are no exact copies.

    `docs` has columns id and text.  Windows of `base` words are counted first;
    only documents' windows that are repeated at one length are looked at with
    twice the length, until `window` is reached or no candidate survives.  At
    each length a long window is represented by the smallest-hashed short one
    inside it, so that equal windows are represented alike and none is lost.
    """
    spark, filters = docs.sparkSession, []
    length, level = base, 0
    while length < window:
        rows = docs.mapInArrow(_level_rows(level, list(filters), window, base), "h long, c long")
        repeated = rows.groupBy("h").agg(F.min("c").alias("a"), F.max("c").alias("b")).filter("a <> b").select("h")
        bits = _filter_bits(repeated, filter_bits)
        if not bits.any():
            return spark.createDataFrame([], "id long, pos int")
        filters.append(spark.sparkContext.broadcast(bits))
        length, level = length * 2, level + 1
    rows = docs.mapInArrow(_window_rows(filters, window, base), "h long, g int, c long, id long, pos int")
    firsts = rows.groupBy("h", "g").agg(F.min("id").alias("first"), F.min("c").alias("a"), F.max("c").alias("b")).filter("a <> b").select("h", "g", "first")
    return rows.join(firsts, ["h", "g"]).filter(F.col("id") > F.col("first")).select("id", "pos")


def _strip(window: int, base: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            s = _Slice(batch.column("text"), window, base)
            flags = np.zeros(len(s.w) + 1, np.int64)
            at = np.flatnonzero(s.ok)  # repeats inside one document
            own = s.owner(at)
            key = s.full[at] ^ _twist(own.astype(np.uint64) * MIX)
            low = np.sort(key)
            twice = np.unique(low[1:][low[1:] == low[:-1]])
            if len(twice):
                some = twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key
                at, key = at[some], key[some]
                order = np.lexsort((at, key))
                again = at[order][1:][key[order][1:] == key[order][:-1]]
                np.add.at(flags, again, 1)
                np.add.at(flags, again + window, -1)
            for i, (copy, pos) in enumerate(zip(batch.column("copy").to_pylist(), batch.column("pos").to_pylist())):
                a, b = s.offsets[i], s.offsets[i + 1]
                if copy and b - a >= window:
                    flags[a] += 1
                    flags[b] -= 1
                elif pos:
                    p = np.asarray(pos, np.int64) + a
                    np.add.at(flags, p, 1)
                    np.add.at(flags, p + window, -1)
            gone = np.cumsum(flags[:-1]) > 0
            ends = np.concatenate(([0], np.cumsum(~gone)))[s.offsets]
            kept = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), s.words.filter(pa.array(~gone))), pa.scalar(" ", pa.large_string()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(s.sizes), pa.array(s.sizes - np.diff(ends)), kept.cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"]
            )

    return run


def dedup_substrings(docs: DataFrame, *, window: int = 20, base: int = 5, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """Remove each word covered by a window of `window` words that also starts earlier (smaller id, or same text, earlier start).

    Returns (doc_id, n_words, n_removed, kept): kept words joined by one space.

    A null or blank text has no words and kept ''.  Rows that repeat an id and
    text are one document and get one result each; of different texts under one
    id none is earlier than the other.  Rows with a null id come last of all:
    they are taken as id 2**63 - 1.  Other columns of docs are ignored.  An
    empty table gives an empty table.
    """
    last = (1 << 63) - 1
    plain = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(last)).alias("id"), F.col(text_col).alias("text"))
    own = cut(plain.mapInArrow(_contents, "id long, c long, c2 long, n long"))
    heads = own.groupBy("c", "c2").agg(F.min("id").alias("head"))
    copies = own.filter(F.col("n") >= window).join(heads, ["c", "c2"]).filter("id > head").select("id", F.lit(True).alias("copy"), F.lit(None).cast("int").alias("pos"))
    marks = repeated_windows(plain, window=window, base=base, filter_bits=filter_bits).select("id", F.lit(False).alias("copy"), "pos").unionByName(copies)
    marks = marks.groupBy("id").agg(F.max("copy").alias("copy"), F.collect_list("pos").alias("pos"))
    out = plain.join(marks, "id", "left").select("id", "text", "copy", "pos").mapInArrow(_strip(window, base), "doc_id long, n_words long, n_removed long, kept string")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(last)))

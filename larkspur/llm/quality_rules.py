"""Quality rules: counts per document and divergence from its language's character and word histograms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from .common import column, cut, seg_sum, split_words, text_slices, word_hashes
from .substring_dedup import _inside, base_windows

#: Bytes of text that a task measures at once; results do not depend on it.
SLICE = 1 << 20
SYMBOLS = b"#*$%&|<>"
CLASSES = ("upper", "lower", "other letter", "digit", "end mark", "inner mark", "symbol", "rest")


def class_table() -> np.ndarray:
    """Class of each UTF-8 byte; white space and continuation bytes (8) count nowhere."""
    out = np.full(256, 7, np.uint8)
    out[ord("A") : ord("Z") + 1], out[ord("a") : ord("z") + 1], out[ord("0") : ord("9") + 1] = 0, 1, 3
    out[0x80:0xC0], out[0xC0:] = 8, 2
    out[list(b".!?")], out[list(b",;:'\"-()")], out[list(SYMBOLS)] = 4, 5, 6
    out[list(b" \t\n\x0b\x0c\r")] = 8
    return out


def class_counts(texts: pa.Array) -> np.ndarray:
    """(documents, classes) counts of characters."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    data = np.frombuffer(b"".join(texts.cast(pa.large_binary()).to_pylist()), np.uint8)
    kinds = class_table()[data]
    return np.stack([seg_sum(kinds == k, offsets) for k in range(len(CLASSES))], axis=1)


def base_counts(texts: pa.Array, split: tuple[pa.Array, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    words, offsets = split or split_words(texts)
    h = word_hashes(words)
    n = max(len(h) - 2, 0)
    at = np.flatnonzero(_inside(offsets, 3, n))
    key, own = base_windows(h, 3)[at] if n else np.zeros(0, np.uint64), np.searchsorted(offsets, at, side="right") - 1
    order = np.lexsort((key, own))
    same = (key[order][1:] == key[order][:-1]) & (own[order][1:] == own[order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    marks = np.zeros(len(h) + 2, bool)
    for i in range(3):
        marks[at[twice] + i] = True
    dup = []
    for t in texts.to_pylist():
        lines = [x for x in t.split("\n") if x.strip(" \t\x0b\x0c\r")]
        dup.append(len(lines) - len(set(lines)))
    data = texts.cast(pa.large_binary()).to_pylist()
    return {
        "n_words": np.diff(offsets),
        "word_chars": seg_sum(pc.utf8_length(words).to_numpy(zero_copy_only=False), offsets),
        "n_symbols": np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in data], np.int64),
        "n_dup_lines": np.array(dup, np.int64),
        "n_repeat_words": seg_sum(marks[: len(h)], offsets),
    }


def _langs(batch: pa.RecordBatch) -> np.ndarray:
    """Language of each row; None is a language of its own."""
    return np.array([*batch.column("lang").cast(pa.string()).to_pylist(), None], dtype=object)[:-1]


def _of(langs: np.ndarray, one: str | None) -> np.ndarray:
    """Which rows are of a language."""
    return np.fromiter((x is None for x in langs), bool, len(langs)) if one is None else langs == one


def _counted(rare: int | None, only: set | None = None):
    """(lang, word, n, size) of a slice's words that are one in `rare` of the language's words in it, whose number is size; the word null counts all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            langs = _langs(batch)
            words, offsets = split_words(batch.column("text"))
            enc = words.dictionary_encode()
            names, code = enc.dictionary.cast(pa.string()), enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            own = np.repeat(np.arange(len(langs)), np.diff(offsets))
            for one in set(langs) if only is None else set(langs) & only:
                n = np.bincount(code[_of(langs, one)[own]], minlength=len(names))
                size = int(n.sum())
                at = np.flatnonzero((n > 0) if rare is None else (n > 0) & (n * rare >= size))
                word = pa.concat_arrays([names.take(pa.array(at)), pa.nulls(1, pa.string())])
                yield pa.RecordBatch.from_arrays([pa.array([one] * len(word), pa.string()), word, pa.array([*n[at].tolist(), size], pa.int64()), pa.array([size] * len(word), pa.int64())], ["lang", "word", "n", "size"])

    return run


def _word_sums(words: pa.Array, offsets: np.ndarray, common: list[str]) -> np.ndarray:
    """Counts of common words, and at last of all others."""
    code = pc.index_in(words.cast(pa.string()), value_set=pa.array(common, pa.string()))
    return np.bincount(pc.fill_null(code, len(common)).to_numpy(zero_copy_only=False), minlength=len(common) + 1)


def _word_counts(words: pa.Array, offsets: np.ndarray, common: list[str]) -> np.ndarray:
    """(documents, common words + 1) counts; the last column holds all other words."""
    code = pc.index_in(words.cast(pa.string()), value_set=pa.array(common, pa.string()))
    code = pc.fill_null(code, len(common)).to_numpy(zero_copy_only=False).astype(np.int64)
    wide, rows = len(common) + 1, len(offsets) - 1
    return np.bincount(np.repeat(np.arange(rows), np.diff(offsets)) * wide + code, minlength=rows * wide).reshape(rows, wide)


def fit_references(docs: DataFrame, *, common_words: int = 40, rare: int = 2000, most: int = 4096, max_languages: int = 10_000) -> dict[str | None, dict]:
    """Per language: its most common words, and its histograms of these and of character classes, over all documents.

    Both are exact and do not depend on how rows are dealt.  A first pass counts
    words within slices and passes on those that are one in `rare` or more of a
    slice.  A word left out of a slice is less of it, which bounds every word's
    total from both sides: where the 40th lower bound is one in `rare` of the
    language's words, all that may rank above it, up to `most` words, are known
    and are counted over all documents by the second pass.  For other languages
    (flat vocabularies) every word is counted, summed before the shuffle and
    ranked within partitions first.  Ties go to the smaller word.  A reference
    has a fixed size and there are as many as languages; more than
    `max_languages` raise, as the driver and each worker hold them all.
    """
    spark, plain, schema = docs.sparkSession, docs.select("lang", "text"), "lang string, word string, n long, size long"

    def ranked(counts: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word")).alias("rank")
        return counts.filter("word is not null").select("lang", "word", "n", rank).filter(F.col("rank") <= common_words)

    found = cut(plain.mapInArrow(_counted(rare), schema).groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("size").alias("size")))
    sizes = found.filter("word is null").select("lang", F.col("n").alias("all"))
    if sizes.count() > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    size = {r["lang"]: r["all"] for r in sizes.collect()}
    least = dict.fromkeys(size, 0) | {r["lang"]: r["n"] for r in ranked(found).filter(F.col("rank") == common_words).collect()}
    sure = {x for x, n in size.items() if least[x] * rare >= n or n < rare}
    common: dict[str | None, list[str]] = {}
    if sure:
        bounds = spark.createDataFrame([(x, size[x], least[x]) for x in sure], "of string, all long, least long")
        able = found.filter("word is not null").join(F.broadcast(bounds), F.col("lang").eqNullSafe(F.col("of"))).filter(F.col("n") * rare + F.col("all") - F.col("size") >= F.col("least") * rare)
        many = {r["lang"]: r["count"] for r in able.groupBy("lang").count().collect()}
        sure = {x for x in sure if many.get(x, 0) <= most}
        able = able.join(F.broadcast(spark.createDataFrame([(x,) for x in sure], "known string")), F.col("lang").eqNullSafe(F.col("known"))) if sure else able.limit(0)
        for r in able.select("lang", "word").collect():
            common.setdefault(r["lang"], []).append(r["word"])
    if flat := set(size) - sure:
        every = plain.mapInArrow(_counted(None, flat), schema).groupBy("lang", "word").agg(F.sum("n").alias("n"))
        for r in ranked(every).collect():
            common.setdefault(r["lang"], []).append(r["word"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str | None, np.ndarray] = {}
        for batch in text_slices(batches, limit=SLICE):
            langs = _langs(batch)
            for one in set(langs):
                texts = batch.column("text").filter(pa.array(_of(langs, one)))
                row = np.concatenate((class_counts(texts).sum(0), _word_sums(*split_words(texts), common.get(one, []))))
                sums[one] = sums.get(one, 0) + row
        for one, row in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([one] * len(row), pa.string()), pa.array(np.arange(len(row), dtype=np.int32)), pa.array(row.astype(np.int64))], ["lang", "bin", "n"])

    rows: dict[str | None, np.ndarray] = {x: np.zeros(len(CLASSES) + len(common.get(x, [])) + 1) for x in size}
    for r in plain.mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect():
        rows[r["lang"]][r["bin"]] = r["n"]
    out = {}
    for one, row in rows.items():
        counted = sorted(zip(common.get(one, []), row[len(CLASSES) :]), key=lambda x: (-x[1], x[0].encode()))[:common_words]
        rest = row[len(CLASSES) :].sum() - sum(n for _, n in counted)
        out[one] = {"words": [w for w, _ in counted], "chars": row[: len(CLASSES)], "counts": np.array([*(n for _, n in counted), rest])}
    return out


def js_distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances (base 2) of rows of counts from a reference histogram; 0 for rows or references without counts."""
    total, whole = counts.sum(1, keepdims=True), reference.sum()
    if not whole:
        return np.zeros(len(counts))
    p, q = counts / np.maximum(total, 1), (reference / whole)[None, :]
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum(1) / 2 + np.where(q > 0, q * np.log2(q / m), 0).sum(1) / 2
    return np.where(total[:, 0] > 0, np.sqrt(np.maximum(d, 0)), 0)


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, char_distance double, word_distance double"
)


def quality_rules(
    docs: DataFrame,
    *,
    references: dict[str | None, dict] | None = None,
    max_char_distance: float = 0.30,
    max_word_distance: float = 0.42,
    min_chars: int = 200,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    id_col: str = "doc_id",
    carry: bool = False,
) -> DataFrame:
    """Counts and verdict of every row of docs (id, lang, text): SCHEMA; with `carry`, docs and `kept` instead.

    base_failed: fewer than `min_words` words, or more than `max_repeat_percent`
    of the words in 3-word windows that the text holds twice or more.  Else a
    document is rejected where the Jensen-Shannon distance of its character
    classes or of its common words from its language's reference exceeds the
    limit; texts of fewer than `min_chars` word characters and languages
    without a reference are not judged so.  References are fitted on all of
    docs unless given.  A null text has no words; a null language is a language
    of its own.  Repeated rows give a row each, other columns are ignored, an
    empty table gives an empty table.
    """
    plain = docs.select(column(id_col).cast("long").alias("doc_id"), "lang", "text")
    refs = plain.sparkSession.sparkContext.broadcast(fit_references(plain) if references is None else references)

    def judged(texts: pa.Array, langs: np.ndarray) -> list[tuple[str, np.ndarray]]:
        counts = split_words(texts)
        n, chars = base_counts(texts, counts), class_counts(texts)
        far, off = np.zeros(len(langs)), np.zeros(len(langs))
        for one in set(langs) & set(refs.value):
            mine, ref = np.flatnonzero(_of(langs, one)), refs.value[one]
            far[mine] = js_distance(chars[mine], ref["chars"])
            off[mine] = js_distance(_word_counts(*counts, ref["words"])[mine], ref["counts"])
        failed = (n["n_words"] < min_words) | (100 * n["n_repeat_words"] > max_repeat_percent * n["n_words"])
        bad = (n["word_chars"] >= min_chars) & ((far > max_char_distance) | (off > max_word_distance))
        return [*((k, v.astype(np.int64)) for k, v in n.items()), ("base_failed", failed), ("kept", ~failed & ~bad), ("char_distance", far), ("word_distance", off)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=SLICE):
            found = judged(batch.column("text"), _langs(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v) for _, v in found)], ["doc_id", *(k for k, _ in found)])

    if not carry:
        return plain.mapInArrow(run, SCHEMA)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=SLICE):
            kept = dict(judged(batch.column("text"), _langs(batch)))["kept"]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept), batch.column("text").cast(pa.string()), batch.column("blank")], ["row", "kept", "text", "blank"])

    rest = [c for c in docs.columns if c not in ("text", "kept")]
    whole = docs.select(F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(rest)]).alias("row"), "lang", "text", F.isnull("text").alias("blank"))
    schema = StructType([whole.schema["row"], StructField("kept", BooleanType()), StructField("text", StringType()), StructField("blank", BooleanType())])
    done = whole.mapInArrow(judge, schema)
    text = F.when(~F.col("blank"), F.col("text"))
    return done.select(*[text.alias(c) if c == "text" else F.col("row")[f"c{rest.index(c)}"].alias(c) for c in docs.columns if c != "kept"], "kept")

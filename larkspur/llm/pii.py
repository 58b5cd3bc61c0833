"""Personal data: fixed patterns, and terms that give away a protected entity by corpus co-occurrence."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import column, cut, split_words, text_slices
from .substring_dedup import FILTER_BITS, _filter_bits, _passes

KINDS = ("email", "ip", "card", "phone", "term")
TERM = KINDS.index("term")
GENERAL = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}

#: Terms whose counts a task holds at most, but for those of its last slice.
COUNTED = 1 << 17

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))


def emails(text: str) -> Iterator[tuple[int, int]]:
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            yield start, m.end()
            done = at = m.end()
        else:
            done = at = at + 1


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for run in DOTTED.finditer(text):
        parts = run[0].split(".")
        at = run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def luhn(digits: str) -> bool:
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, in order."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if re.search("[0-9]", text):
        found += [(a, 1, b) for a, b in addresses(text)]
        for m in CARD.finditer(text):
            digits = re.sub("[ -]", "", m[0]) if m.end() - m.start() >= 12 else ""
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


def term_of(word: str) -> str:
    return word.strip(EDGE).lower()


def free_words(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of each word that overlaps no span, without the marks at its edges."""
    at, reached = 0, 0
    for m in WORD.finditer(text):
        a, b = m.start(), m.end()
        while at < len(spans) and spans[at][0] < b:
            reached = max(reached, spans[at][2])
            at += 1
        if a >= reached and len(term := term_of(m[0])) >= 2:
            yield term, a + len(m[0]) - len(m[0].lstrip(EDGE)), a + len(m[0].rstrip(EDGE))


SPAN = pa.struct([("start", pa.int32()), ("k", pa.int32()), ("end", pa.int32())])
BASE_SCHEMA = "doc_id long, digest binary, spans array<struct<start int, k int, end int>>, entities array<string>, content long"


def _digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode())


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        texts = batch.column("text").to_pylist()
        spans = [base_spans(t) for t in texts]
        entities = [sorted({f"{KINDS[k]}:{t[a:b].lower()}" for a, k, b in s}) for t, s in zip(texts, spans)]
        content = [xxhash.xxh64_intdigest(" ".join(t.lower().split())) >> 1 if s else 0 for t, s in zip(texts, spans)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(map(_digest, texts), pa.binary()), pa.array([[{"start": a, "k": k, "end": b} for a, k, b in s] for s in spans], pa.list_(SPAN)), pa.array(entities, pa.list_(pa.string())), pa.array(content, pa.int64())],
            ["doc_id", "digest", "spans", "entities", "content"],
        )


def _terms(bits):
    """(digest, term): distinct terms of each whole text that may hold an entity with evidence; a row's text is known by its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            texts = batch.column("text").to_pylist()
            digests = [_digest(t) for t in texts]
            ok = _passes(bits.value, np.fromiter((xxhash.xxh64_intdigest(d, 42) for d in digests), np.uint64, len(digests)))
            for i in np.flatnonzero(ok).tolist():
                terms = sorted({t for t, _, _ in free_words(texts[i], base_spans(texts[i]))})
                yield pa.RecordBatch.from_arrays([pa.array([digests[i]] * len(terms), pa.binary()), pa.array(terms, pa.string())], ["digest", "t"])

    return run


def _marks(bits):
    """(digest, term, start, end): every word that may be a disclosing term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            words, offsets = split_words(batch.column("text"))
            enc = words.dictionary_encode()
            terms = [term_of(w) for w in enc.dictionary.to_numpy(zero_copy_only=False)]
            h = np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in terms), np.uint64, len(terms))
            passing = np.asarray(_passes(bits.value, h), bool)
            known = {t for t, ok in zip(terms, passing.tolist()) if ok}
            hit = passing[enc.indices.to_numpy(zero_copy_only=False)] if len(terms) else np.zeros(0, bool)
            own = np.unique(np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[hit])
            out = []
            for i in own.tolist():
                text = batch.column("text")[i].as_py()
                out += [(_digest(text), *x) for x in free_words(text, base_spans(text)) if x[0] in known]
            digest, t, a, b = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(t, pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["digest", "t", "a", "b"])

    return run


def _frequencies(bits):
    """(term, n): documents of a task that hold a term which may be a candidate; a term has a row for each COUNTED terms that the task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter[str] = Counter()
        told = lambda: pa.RecordBatch.from_arrays([pa.array(list(counted), pa.string()), pa.array(list(counted.values()), pa.int64())], ["t", "n"])
        for batch in text_slices(batches):
            words, offsets = split_words(batch.column("text"))
            enc = words.dictionary_encode()
            terms = [term_of(w) for w in enc.dictionary.to_numpy(zero_copy_only=False)]
            h = np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in terms), np.uint64, len(terms))
            names = {}
            code = np.array([names.setdefault(t, len(names)) if ok else -1 for t, ok in zip(terms, _passes(bits.value, h).tolist())], np.int64)
            code = code[enc.indices.to_numpy(zero_copy_only=False)] if len(terms) else code
            own = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            pairs = np.unique(own[code >= 0] * max(len(names), 1) + code[code >= 0])
            counts = np.bincount(pairs % max(len(names), 1), minlength=len(names))
            counted.update(dict(zip(names, counts.tolist())))
            if len(counted) >= COUNTED:
                yield told()
                counted.clear()
        yield told()

    return run


def find_personal_data(docs: DataFrame, *, threshold: float = 0.75, min_contexts: int = 3, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, base array, spans array) of every row: spans as (start, k, end), k indexing KINDS, in order.

    Base spans are e-mail, IP, card and phone matches.  A protected entity is
    the text of such a match.  A term is a word of two characters or more that
    overlaps no match, without marks at its edges, lower-cased.  It discloses an
    entity e where its pointwise mutual information with e over whole documents,
    log(N n(t,e) / (n(t) n(e))), is at least `threshold` times e's information
    content, log(N / n(e)), and documents of `min_contexts` different contents
    or more hold both, so copies of one document are no evidence.  Every
    occurrence of such a term, in any document, is a further span.

    A null text is empty; rows that repeat an id give a row each; other columns
    are ignored; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = cut(plain.mapInArrow(_find, BASE_SCHEMA))
    total = found.count()
    held = found.filter(F.size("entities") > 0).select("digest", "content", F.explode("entities").alias("e"))
    # a pair is met in no more contents than its entity
    entities = held.groupBy("e", "content").agg(F.count("*").alias("n")).groupBy("e").agg(F.sum("n").alias("n_e"), F.count("*").alias("contents"))
    entities = cut(entities.filter((F.col("contents") >= min_contexts) & (F.col("n_e") < total)))
    held = cut(held.join(entities.select("e"), "e").distinct())
    bits = _filter_bits(held.select(F.xxhash64("digest").alias("h")).distinct(), filter_bits)
    terms = plain.select("text").mapInArrow(_terms(spark.sparkContext.broadcast(bits)), "digest binary, t string")
    terms = terms if bits.any() else terms.limit(0)
    pairs = held.join(terms, "digest").groupBy("e", "t", "content").agg(F.count("*").alias("n")).groupBy("e", "t").agg(F.sum("n").alias("n_te"), F.count("*").alias("contents"))
    # these documents alone bound n(t) from below, which rules out pairs of common words before all texts are counted
    least = terms.groupBy("t").agg(F.count("*").alias("n_t"))
    tells = F.log(F.lit(float(total)) * F.col("n_te") / (F.col("n_t") * F.col("n_e"))) >= threshold * F.log(F.lit(float(total)) / F.col("n_e"))
    pairs = cut(pairs.filter(F.col("contents") >= min_contexts).join(entities.select("e", "n_e"), "e").join(least, "t").filter(tells).select("e", "n_e", "t", "n_te"))
    bits = _filter_bits(pairs.select(F.xxhash64("t").alias("h")).distinct(), filter_bits)
    extra = found.select("digest", F.expr("cast(null as array<struct<start int, k int, end int>>)").alias("more")).limit(0)
    if bits.any():
        often = plain.select("text").mapInArrow(_frequencies(spark.sparkContext.broadcast(bits)), "t string, n long").groupBy("t").agg(F.sum("n").alias("n_t"))
        told = cut(pairs.join(often, "t").filter(tells).select("t").distinct())
        bits = _filter_bits(told.select(F.xxhash64("t").alias("h")), filter_bits)
        if bits.any():
            marks = plain.select("text").mapInArrow(_marks(spark.sparkContext.broadcast(bits)), "digest binary, t string, a int, b int")
            extra = marks.join(told, "t").groupBy("digest").agg(F.collect_set(F.struct(F.col("a").alias("start"), F.lit(TERM).alias("k"), F.col("b").alias("end"))).alias("more"))
    both = F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.array_sort(F.concat("spans", "more")))
    return found.select("doc_id", "digest", "spans").join(extra, "digest", "left").select("doc_id", F.col("spans").alias("base"), both.alias("spans"))


def spans_text(spans) -> F.Column:
    """kind:start:end of spans, comma-joined."""
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["start"], x["end"])), ",")


def count_kind(spans, kind: str) -> F.Column:
    return F.size(F.filter(spans, lambda x: x["k"] == KINDS.index(kind))).cast("long")


def sanitise(docs: DataFrame, found: DataFrame, *, remove: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span of `found` generalised to its kind's placeholder, or removed.  Where spans overlap, the first counts.

    A null text becomes ''.  Rows are matched by id, null ids with each other;
    ids without spans keep their texts.  Of several span lists under one id any
    one is taken, so rows that share an id must share their text.  All columns
    stay, whatever their names.
    """
    names = [c for c in docs.columns if c != text_col]
    row = F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(names)]).alias("row")
    flat = docs.select(row, column(text_col).alias("text"), column(id_col).alias("id"))
    spans = found.dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("of"), "spans")
    flat = flat.join(spans, F.col("id").eqNullSafe(F.col("of")), "left").select("row", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                parts, at = [], 0
                for s in spans or []:
                    if s["start"] >= at:
                        parts += [text[at : s["start"]], "" if remove else GENERAL[KINDS[s["k"]]]]
                        at = s["end"]
                out.append("".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], ["row", "text"])

    done = flat.mapInArrow(run, StructType([flat.schema["row"], StructField("text", StringType())]))
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[f"c{names.index(c)}"].alias(c) for c in docs.columns])

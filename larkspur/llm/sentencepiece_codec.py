"""SentencePiece encoding and decoding on the tokenizers library, from the model protobuf alone."""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory, text_slices

MARK = "▁"
#: Fixed values of the model protobuf: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
CHUNK = 4096  # distinct words that are encoded at once
SLICE = 1 << 19  # bytes of text that a task encodes at once
#: Texts that every rebuilt model must encode as the original does.
PROBES = ("", " ", "a", "Hello world", "  two  spaces   here ", "line\nbreak\t tab", "naïve café – 東京 🙂", "<s> </s> <unk> <0x0A>", "1234567890 $%&", "x" * 300)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; nested messages stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(wire)
        if size is None:
            if wire != 2:
                raise ValueError(f"wire type {wire} in the model file")
            size = varint()
        yield key >> 3, data[at : at + size]
        at += size


class Model:
    """What a model file says: pieces (text, score, type), model type and normaliser."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        norm: dict = {}
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                norm = dict(fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.charsmap: bytes = norm.get(2, b"")
        self.prefix, self.squeeze, self.escape = bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1))
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unk = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        if self.kind not in (UNIGRAM, BPE) or not self.escape or trainer.get(24, 0):
            raise ValueError("word, character, suffix-marked and unescaped models are not supported")

    def merges(self) -> list[tuple[str, str]]:
        """Pairs in the order in which pieces are built: by score, then by the parts' ids."""
        ids = {p: i for i, (p, _, t) in enumerate(self.pieces) if t in (NORMAL, USER_DEFINED, UNUSED)}
        found = []
        for text, score, kind in self.pieces:
            if kind == NORMAL:
                pairs = [(text[:i], text[i:]) for i in range(1, len(text)) if text[:i] in ids and text[i:] in ids]
                found += [(-score, ids[a], ids[b], a, b) for a, b in pairs]
        # pieces of one score keep the order of the file; pairs of one piece go by ids
        rank = {text: i for i, (text, _, _) in enumerate(self.pieces)}
        found.sort(key=lambda x: (x[0], rank[x[3] + x[4]], x[1], x[2]))
        return [(a, b) for *_, a, b in found]


class Codec:
    """Encoder and decoder of one model file.

    Where no piece has the space mark after another character, no piece crosses
    the start of a word, so words are encoded apart and each distinct word of a
    batch once; otherwise whole texts are.
    """

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # executors run several workers: a pool of threads in each costs more than it gains
        from tokenizers import Tokenizer, models, normalizers

        self.model = m = Model(data)
        self.data = data
        if m.kind == BPE:
            vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
            # distinct words are encoded once each, so a cache of words would be looked at in vain
            core = models.BPE(cache_capacity=0, vocab=vocab, merges=m.merges(), unk_token=m.pieces[m.unk][0], fuse_unk=True, byte_fallback=m.byte_fallback)
        else:
            core = models.Unigram([(p, s) for p, s, _ in m.pieces], m.unk, m.byte_fallback)
        self.tokenizer = Tokenizer(core)
        self.tokenizer.encode_special_tokens = True
        self.charsmap = normalizers.Precompiled(m.charsmap) if m.charsmap else None
        self.by_word = m.kind == BPE and not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, t in m.pieces if t in (NORMAL, USER_DEFINED))
        self.bytes = [
            bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t in (CONTROL,) else " ⁇ ".encode() if t == UNKNOWN else p.replace(MARK, " ").encode() for p, _, t in m.pieces
        ]
        self.spelt = pa.array(self.bytes, pa.large_binary())

    def normalise(self, text: str) -> str:
        """Charsmap, spaces squeezed, prefix, and the space mark for spaces."""
        if self.charsmap:
            text = self.charsmap.normalize_str(text)
        if self.model.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (MARK if self.model.prefix else "") + text.replace(" ", MARK)

    def segments(self, plain: list[str]) -> pa.LargeListArray:
        """Parts of each normalised text that are encoded apart: marks and the characters up to the next mark.  An empty text has none."""
        if not self.by_word:
            return pa.array([[t] if t else [] for t in plain], pa.large_list(pa.large_string()))
        end = next(c for c in map(chr, range(0xD800)) if c != MARK and not any(c in t for t in plain))
        parted = []
        for t in plain:
            t = t.replace(MARK, end + MARK)
            while MARK + end + MARK in t:
                t = t.replace(MARK + end + MARK, MARK + MARK)
            parted.append(t.removeprefix(end) or None)
        lists = pc.split_pattern(pa.array(parted, pa.large_string()), end)
        return pa.LargeListArray.from_arrays(pa.array(np.asarray(lists.offsets, np.int64)), lists.values)

    def spell(self, ids: np.ndarray, ends: np.ndarray, words: list[str]) -> list[bool]:
        """Whether the ids between two consecutive ends decode to the word."""
        own = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), self.spelt.take(pa.array(ids))), pa.scalar(b"", pa.large_binary()))
        plain = pc.replace_substring(pa.array(words, pa.large_string()), MARK, " ")
        same = pc.equal(own, plain.cast(pa.large_binary())).to_pylist()
        return [x or a.as_py().decode("utf-8", "replace") == b.as_py() for x, a, b in zip(same, own, plain)] if not all(same) else same

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids in a row, each text's offset in them (one more at the end), and whether the ids spell the normalised text."""
        cut = self.segments([self.normalise(t) for t in texts])
        flat = cut.flatten().dictionary_encode()
        distinct, code = flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False)
        pools, sizes, oks = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], []
        for a in range(0, len(distinct), CHUNK):  # the library's results are large: they are reduced to ids chunk by chunk
            some = distinct[a : a + CHUNK]
            coded = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, coded), np.int64, len(coded)))
            ends = np.concatenate(([0], np.cumsum(sizes[-1])))
            pools.append(np.fromiter(chain.from_iterable(coded), np.int32, ends[-1]))
            oks += self.spell(pools[-1], ends, some)
        size, good, pool = np.concatenate(sizes), np.array(oks, bool), np.concatenate(pools)
        first = np.concatenate(([0], np.cumsum(size)))
        n = size[code]
        ends = np.concatenate(([0], np.cumsum(n)))
        ids = pool[np.repeat(first[code] - ends[:-1], n) + np.arange(ends[-1])] if len(code) else pool
        words = np.concatenate(([0], np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))))
        bad = np.concatenate(([0], np.cumsum(~good[code]))) if len(code) else np.zeros(1, np.int64)
        return ids, ends[words], np.diff(bad[words]) == 0

    def decode(self, ids: list[int]) -> str:
        text = b"".join(self.bytes[i] for i in ids).decode("utf-8", "replace")
        return text[1:] if self.model.prefix and text[:1] == " " else text

    def verify(self, texts: list[str]) -> None:
        """Raise where the original library encodes or decodes a text otherwise."""
        import sentencepiece

        original = sentencepiece.SentencePieceProcessor(model_proto=self.data)
        ids, at, _ = self.encode(texts)
        for i, text in enumerate(texts):
            own, wanted = ids[at[i] : at[i + 1]].tolist(), original.encode(text)
            if own != wanted:
                raise ValueError(f"ids differ from the original's for {text[:80]!r}")
            if self.decode(own) != original.decode(wanted):
                raise ValueError(f"the decoded text differs from the original's for {text[:80]!r}")


def encode_documents(docs: DataFrame, model: bytes, *, keep_ids: bool = True, parity_rows: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, round_trip[, ids]) of every row of docs.

    ids_sha256 is over the ids as little-endian 32-bit numbers.  round_trip:
    decoding the ids gives the normalised text.  A null or empty text has no
    ids.  Parity with the original library is verified on fixed probes before
    the job starts and on the first `parity_rows` texts of each task.  Other
    columns are ignored; repeated rows give a row each; an empty table gives an
    empty table.  Texts that hold the space mark itself decode to a space, as
    in the original.
    """
    Codec(model).verify(list(PROBES))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, todo = None, parity_rows
        for batch in text_slices(batches, limit=SLICE):
            codec = codec or Codec(sent.value)
            texts = batch.column("text").to_pylist()
            if todo:
                codec.verify(texts[:todo])
                todo -= len(texts[:todo])
            ids, at, good = codec.encode(texts)
            spans = list(zip(at[:-1].tolist(), at[1:].tolist()))
            columns = [batch.column("doc_id"), pa.array(np.diff(at)), pa.array([hashlib.sha256(ids[a:b].astype("<i4").tobytes()).hexdigest() for a, b in spans], pa.string()), pa.array(good)]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "round_trip", "ids"][: len(columns)])
        codec = texts = ids = columns = None
        release_memory()

    schema = "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean" + ", ids array<int>" * keep_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode_documents(coded: DataFrame, model: bytes, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows with ids; null ids give ''."""
    sent = coded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or Codec(sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")

"""Main text of web pages: a bidirectional LSTM labels every block of a page with the whole page in view."""

from __future__ import annotations

import io
import math
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

PATH_BUCKETS, WORD_BUCKETS, NUMBERS = 512, 128, 8
INPUTS = PATH_BUCKETS + WORD_BUCKETS + NUMBERS
HIDDEN = 16
WEIGHTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "html_blocks.npz")
CHUNK = 4096  # blocks whose inputs are held at once; pages are labelled together up to as many, or one by one

#: Elements that end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page: scripts, styles, what stands for them, the head and what a form holds.
HIDDEN_TAGS = frozenset("script style noscript template head title iframe textarea select datalist".split())
#: Elements that may stand in a head; any other one ends it.
HEAD_TAGS = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
SPACE = re.compile(r"\s+")


@lru_cache(1 << 16)
def _bucket(token: str, size: int) -> int:
    return xxhash.xxh3_64_intdigest(token) % size


class Blocks(HTMLParser):
    """Blocks of a page in order: (path buckets, text, characters inside links)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, frozenset, bool]] = [("", frozenset(), False)]
        self.found: list[tuple[frozenset, str, int]] = []
        self.parts: list[str] = []
        self.links = self.linked = 0
        self.open: Counter[str] = Counter()

    def parse_marked_section(self, i, report=1):
        """<![...> outside foreign content is a comment, whatever it holds."""
        return self.parse_bogus_comment(i, 0)

    def _cut(self, at: int) -> None:
        """Close the open elements from place `at` on."""
        for name, _, _ in self.stack[at:]:
            self.open[name] -= 1
        del self.stack[at:]

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.found.append((self.stack[-1][1], text, self.linked))
        self.parts, self.linked = [], 0

    def _end_head(self, tag: str) -> None:
        """The first element that cannot stand in a head, or the body, closes it with all that is open inside."""
        if not self.open["head"] or tag in HEAD_TAGS:
            return
        at = next(i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i][0] == "head")
        if tag == "body" or not self.open["template"] or all(name != "template" for name, _, _ in self.stack[at:]):
            self.flush()
            self._cut(at)

    def handle_starttag(self, tag, attrs):
        self._end_head(tag)
        if tag == "br":
            self.parts.append(" ")
        elif tag == "a":
            self.links += 1
        if tag not in BLOCKS and tag not in HIDDEN_TAGS:
            return
        if tag in BLOCKS:
            self.flush()
        if tag in VOID:
            return
        if tag in ("p", "li", "dt", "dd", "option", "tr", "td", "th") or (tag in BLOCKS and self.stack[-1][0] == "p"):
            self._close_open(tag)
        names = [f"<{tag}>"]
        for key, value in attrs:
            if key in ("class", "id", "role"):
                names += [f"{key}={x}" for x in re.split(r"[\s_-]+", (value or "").lower()) if x]
        path = self.stack[-1][1].union(_bucket(n, PATH_BUCKETS) for n in names)
        self.stack.append((tag, path, self.stack[-1][2] or tag in HIDDEN_TAGS))
        self.open[tag] += 1
        self.links = 0 if tag in BLOCKS else self.links

    def _close_open(self, tag: str) -> None:
        """What a new element of this kind closes by itself."""
        own = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, ())
        while self.stack[-1][0] == "p" or self.stack[-1][0] in own:
            self._cut(len(self.stack) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in BLOCKS or tag in HIDDEN_TAGS:
            if tag not in VOID:
                self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag not in BLOCKS and tag not in HIDDEN_TAGS:
            return
        if tag in BLOCKS:
            self.flush()
        if self.open[tag]:
            self._cut(next(i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i][0] == tag))

    def handle_data(self, data):
        if self.stack[-1][0] == "head" and data.strip():
            self._end_head("")
        if not self.stack[-1][2]:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def blocks(html: str) -> list[tuple[frozenset, str, int]]:
    """Blocks of a page; markup that is not well formed is read as browsers do or skipped, and never raises."""
    reader = Blocks()
    reader.feed(html)
    reader.close()
    reader.flush()
    return reader.found


def inputs(page: list[tuple[frozenset, str, int]], start: int = 0, stop: int | None = None) -> np.ndarray:
    """(blocks start to stop, INPUTS): hashed tag path, all hashed words (both scaled by their number), and a few measures."""
    some = page[start:stop]
    out = np.zeros((len(some), INPUTS), np.float32)
    for i, (path, text, linked) in enumerate(some):
        words = text.split(" ")
        n = len(words)
        if path:
            out[i, list(path)] = 1 / math.sqrt(len(path))
        at = np.fromiter((_bucket(w.lower(), WORD_BUCKETS) for w in words), np.int64, n)
        out[i, PATH_BUCKETS:-NUMBERS] = np.bincount(at, minlength=WORD_BUCKETS) / math.sqrt(n * 4)
        ends = sum(text.count(c) for c in ".!?")
        out[i, -NUMBERS:] = (math.log1p(n) / 5, math.log1p(len(text)) / 7, linked / len(text), min(ends / n, 1), text.count(",") / n, (start + i) / len(page), float(text[-1] in ".!?:"), math.log1p(len(page)) / 5)
    return out


class Labeller:
    """A bidirectional LSTM of one layer with a logistic output, in numpy."""

    SHAPES = {
        "e": (INPUTS, HIDDEN * 2), "eb": (HIDDEN * 2,),
        "fw": (HIDDEN * 3, HIDDEN * 4), "fb": (HIDDEN * 4,), "bw": (HIDDEN * 3, HIDDEN * 4), "bb": (HIDDEN * 4,),
        "o": (HIDDEN * 4, 1), "ob": (1,),
    }

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.w = weights or {k: (rng.standard_normal(s) / math.sqrt(s[0]) if len(s) > 1 else np.zeros(s)).astype(np.float32) for k, s in self.SHAPES.items()}

    @classmethod
    def load(cls, data: bytes) -> Labeller:
        with np.load(io.BytesIO(data)) as f:
            return cls({k: f[k].astype(np.float32) for k in f.files})

    def save(self, path: str) -> None:
        np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in self.w.items()})

    def _run(self, x, mask, w, b, keep):
        """One direction over (time, pages, inputs); states stop where mask is 0."""
        T, N, _ = x.shape
        h, c = np.zeros((N, HIDDEN), np.float32), np.zeros((N, HIDDEN), np.float32)
        hs, trace = np.zeros((T, N, HIDDEN), np.float32), []
        for t in range(T):
            both = np.concatenate([x[t], h], axis=1)
            z = both @ w + b
            i, f, o = (1 / (1 + np.exp(-np.clip(z[:, k * HIDDEN : (k + 1) * HIDDEN], -30, 30))) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c2 = f * c + i * g
            th = np.tanh(c2)
            if keep:
                trace.append((both, i, f, o, g, c, th, m))
            h, c = m * (o * th) + (1 - m) * h, m * c2 + (1 - m) * c
            hs[t] = h
        return hs, trace

    def _back(self, dh_out, trace, w):
        dw, db = np.zeros_like(w), np.zeros(w.shape[1], np.float32)
        T, N, _ = dh_out.shape
        dx = np.zeros((T, N, w.shape[0] - HIDDEN), np.float32)
        dh, dc = np.zeros((N, HIDDEN), np.float32), np.zeros((N, HIDDEN), np.float32)
        for t in range(T - 1, -1, -1):
            both, i, f, o, g, c, th, m = trace[t]
            dh = dh + dh_out[t]
            own, pass_h, pass_c = dh * m, dh * (1 - m), dc * (1 - m)
            d = dc * m + own * o * (1 - th * th)
            dz = np.concatenate([d * g * i * (1 - i), d * c * f * (1 - f), own * th * o * (1 - o), d * i * (1 - g * g)], axis=1)
            dw += both.T @ dz
            db += dz.sum(0)
            back = dz @ w.T
            dx[t], dh, dc = back[:, : -HIDDEN], back[:, -HIDDEN:] + pass_h, d * f + pass_c
        return dx, dw, db

    def embed(self, page: list[tuple[frozenset, str, int]]) -> np.ndarray:
        """(blocks, 2 HIDDEN): what the recurrent layer reads; the wide inputs are held for CHUNK blocks only."""
        return np.concatenate([np.tanh(inputs(page, a, a + CHUNK) @ self.w["e"] + self.w["eb"]) for a in range(0, len(page), CHUNK)])

    def forward(self, pages: list[np.ndarray], keep: bool = False):
        """(time, pages) probabilities of embedded pages, and with `keep` what the gradients need."""
        w, H = self.w, HIDDEN
        T, N = max(map(len, pages)), len(pages)
        x = np.zeros((T, N, H * 2), np.float32)
        mask = np.zeros((T, N), np.float32)
        for n, p in enumerate(pages):
            x[: len(p), n] = p
            mask[: len(p), n] = 1
        hf, tf = self._run(x, mask, w["fw"], w["fb"], keep)
        hb, tb = self._run(x[::-1], mask[::-1], w["bw"], w["bb"], keep)
        # the output sees both directions and the block itself
        z = hf @ w["o"][:H] + hb[::-1] @ w["o"][H : 2 * H] + x @ w["o"][2 * H :] + w["ob"]
        return 1 / (1 + np.exp(-np.clip(z[:, :, 0], -30, 30))), (x, mask, hf, hb, tf, tb)

    def gradients(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
        flat = np.concatenate(pages)
        e = np.tanh(flat @ self.w["e"] + self.w["eb"])
        ends = np.cumsum([len(q) for q in pages])
        p, (x, mask, hf, hb, tf, tb) = self.forward(np.split(e, ends[:-1]), keep=True)
        y = np.concatenate([hf, hb[::-1], x], axis=2)
        want = np.zeros_like(p)
        for n, row in enumerate(labels):
            want[: len(row), n] = row
        total = mask.sum()
        loss = -(mask * (want * np.log(p + 1e-7) + (1 - want) * np.log(1 - p + 1e-7))).sum() / total
        dz = (mask * (p - want) / total)[:, :, None].astype(np.float32)
        g = {"o": np.einsum("tnh,tno->ho", y, dz), "ob": dz.sum((0, 1))}
        dy = dz @ self.w["o"].T
        dxf, g["fw"], g["fb"] = self._back(dy[:, :, :HIDDEN], tf, self.w["fw"])
        dxb, g["bw"], g["bb"] = self._back(dy[::-1, :, HIDDEN : 2 * HIDDEN], tb, self.w["bw"])
        dx = dxf + dxb[::-1] + dy[:, :, 2 * HIDDEN :]
        de = np.concatenate([dx[: len(q), n] for n, q in enumerate(pages)]) * (1 - e * e)
        g["e"], g["eb"] = flat.T @ de, de.sum(0)
        return float(loss), g

    def probabilities(self, pages: list[list[tuple[frozenset, str, int]]]) -> list[np.ndarray]:
        """P(main text) of every block of every page; pages of like length are run together."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: len(pages[i]))
        for a in range(0, len(order), 128):
            some = order[a : a + 128]
            p, _ = self.forward([self.embed(pages[i]) for i in some])
            for n, i in enumerate(some):
                out[i] = p[: len(pages[i]), n]
        return out


def model_bytes(path: str = WEIGHTS) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def main_text(page: list[tuple[frozenset, str, int]], p: np.ndarray, threshold: float = 0.5) -> str:
    return "\n\n".join(text for (_, text, _), x in zip(page, p) if x >= threshold)


def extract(pages: DataFrame, *, model: bytes | None = None, threshold: float = 0.5, html_col: str = "html", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages.

    Every block of a page is labelled with the whole page in view, by all its
    words; those that are main text are joined by two line ends.  Only scripts,
    styles, their stand-ins, heads and fields of forms are left out unlabelled.
    Malformed markup is read as far as it goes.  A page's blocks take a few
    hundred bytes each, so one of a million blocks fits a worker.  A null or blank page, or one
    without main text, has the text ''.  Repeated rows give a row each; other
    columns are ignored; an empty table gives an empty table.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model or model_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Labeller.load(sent.value)
        for batch in text_slices(batches, limit=1 << 20):
            read = [blocks(t) for t in batch.column("text").to_pylist()]
            out, at = [], 0
            while at < len(read):
                stop, n = at, 0
                while stop < len(read) and (stop == at or n + len(read[stop]) <= 2 * CHUNK):
                    n += len(read[stop])
                    stop += 1
                some = read[at:stop]
                out += [main_text(b, p, threshold) for b, p in zip(some, net.probabilities(some))]
                at = stop
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("text"))
    return plain.mapInArrow(run, "page_id long, url string, text string, n_chars long")

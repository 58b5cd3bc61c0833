"""Documents that hold every edge case, and plain versions of what the operators compute."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def edge_documents(seed=5, n=60):
    """(doc_id, text, lang, source, n_chars, n_words): nulls, blanks, long texts, ties, copies, a clashing extra column."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgäé") for _ in range(r.randint(1, 7))) for _ in range(200)]
    passage = " ".join(r.choice(vocab) for _ in range(60))
    texts = []
    for i in range(n):
        body = "\n".join(" ".join(r.choice(vocab) for _ in range(r.randint(3, 25))) for _ in range(r.randint(1, 9)))
        if i % 5 == 0:
            body += "\n" + passage
        if i % 3 == 0:
            body += "\n  Shared Line \t"
        texts.append(body)
    texts += [texts[0], texts[0], texts[1].replace(" ", "  ", 1), None, "", " \t\n\x0b\x0c\r ", "one", "zwei wörter", "a" * 5000, " ".join(vocab * 30), "x " * 400, "\n\n\n", "Shared line", "SHARED LINE\nÄ\nä", "#*$%&|<> a b  c 🙂"]
    rows = [(i * 7 + 3, t, ["en", "de", None][i % 3], ["s0", "s0", "s1", None][i % 4], len(t or ""), 99) for i, t in enumerate(texts)]
    return rows + [rows[0]]  # one row is repeated


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long"


def frame(spark, rows=None):
    return spark.createDataFrame(edge_documents() if rows is None else rows, SCHEMA).repartition(3)

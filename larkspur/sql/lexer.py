"""Tokens of the dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass

STRING = re.compile(r"(?i)(rb|br|r|b)?('''|\"\"\"|'|\")")
NUMBER = re.compile(r"0[xX][0-9a-fA-F]+|(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?")
NAME = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")
OPERATORS = ("|>", "=>", "->", "<<", ">>", "<=", ">=", "<>", "!=", "||", "@@", "@", "?", "(", ")", "[", "]", "{", "}", ",", ".", ";", ":", "+", "-", "*", "/", "%", "=", "<", ">", "&", "|", "^", "~")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "a": "\a", "v": "\v", "0": "\0"}


class SyntaxProblem(ValueError):
    """The text is no statement of the dialect, or of the part that is supported."""


@dataclass(frozen=True)
class Token:
    kind: str  # name, quoted, number, string, bytes, op, end
    text: str
    at: int
    end: int

    @property
    def word(self) -> str:
        return self.text.upper() if self.kind == "name" else ""


def unescape(body: str) -> str:
    out, i = [], 0
    while i < len(body):
        c = body[i]
        if c != "\\":
            out.append(c)
            i += 1
            continue
        e = body[i + 1] if i + 1 < len(body) else "\\"
        if e in "xX":
            out.append(chr(int(body[i + 2 : i + 4], 16)))
            i += 4
        elif e in "uU":
            n = 4 if e == "u" else 8
            out.append(chr(int(body[i + 2 : i + 2 + n], 16)))
            i += 2 + n
        elif e.isdigit() and re.match(r"[0-3][0-7]{2}", body[i + 1 : i + 4]):
            out.append(chr(int(body[i + 1 : i + 4], 8)))
            i += 4
        else:
            out.append(ESCAPES.get(e, e))
            i += 2
    return "".join(out)


def tokens(text: str) -> list[Token]:
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c.isspace():
            i += 1
        elif text.startswith("--", i) or c == "#":
            i = (text.find("\n", i) + 1) or len(text)
        elif text.startswith("/*", i):
            stop = text.find("*/", i + 2)
            if stop < 0:
                raise SyntaxProblem("a comment is not closed")
            i = stop + 2
        elif m := STRING.match(text, i):
            prefix, quote = (m[1] or "").lower(), m[2]
            j = m.end()
            while not text.startswith(quote, j):
                if j >= len(text):
                    raise SyntaxProblem(f"a string that begins at {i} is not closed")
                j += 2 if text[j] == "\\" else 1
            body = text[m.end() : j]
            body = body if "r" in prefix else unescape(body)
            j += len(quote)
            out.append(Token("bytes" if "b" in prefix else "string", body, i, j))
            i = j
        elif c == "`":
            j = text.index("`", i + 1)
            out.append(Token("quoted", text[i + 1 : j], i, j + 1))
            i = j + 1
        elif m := NAME.match(text, i):
            out.append(Token("name", m[0], i, m.end()))
            i = m.end()
        elif (c.isdigit() or (c == "." and text[i + 1 : i + 2].isdigit() and not (out and out[-1].kind in ("name", "quoted") and out[-1].end == i))) and (m := NUMBER.match(text, i)):
            out.append(Token("number", m[0], i, m.end()))
            i = m.end()
        else:
            op = next((o for o in OPERATORS if text.startswith(o, i)), None)
            if op is None:
                raise SyntaxProblem(f"unexpected character {c!r} at {i}")
            out.append(Token("op", op, i, i + len(op)))
            i += len(op)
    return [*out, Token("end", "", len(text), len(text))]

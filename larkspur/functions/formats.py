"""FORMAT strings and strftime patterns, compiled to Spark expressions when a query is planned."""

from __future__ import annotations

import re

#: strftime element -> date_format pattern.
PATTERNS = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "B": "MMMM", "b": "MMM", "h": "MMM", "A": "EEEE", "a": "EEE", "j": "DDD", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy", "x": "MM/dd/yy", "X": "HH:mm:ss", "Z": "VV", "z": "xx", "e": "d", "k": "H", "l": "h", "Q": "q", "f": "SSSSSS", "c": "EEE MMM d HH:mm:ss yyyy", "r": "hh:mm:ss a",
}
#: elements that date_format lacks -> expression over {0}
EXPRESSIONS = {
    "s": "CAST(unix_seconds(timestamp({0})) AS STRING)", "G": "CAST(extract(YEAROFWEEK FROM {0}) AS STRING)", "V": "lpad(CAST(weekofyear({0}) AS STRING), 2, '0')", "u": "CAST(weekday({0}) + 1 AS STRING)", "w": "CAST(dayofweek({0}) - 1 AS STRING)", "C": "lpad(CAST(year({0}) div 100 AS STRING), 2, '0')", "e": "lpad(CAST(day({0}) AS STRING), 2, ' ')",
    "U": "lpad(CAST((dayofyear({0}) + 6 - (dayofweek({0}) - 1)) div 7 AS STRING), 2, '0')", "W": "lpad(CAST((dayofyear({0}) + 6 - weekday({0})) div 7 AS STRING), 2, '0')", "n": "'\\n'", "t": "'\\t'", "%": "'%'",
}


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strftime_pattern(fmt: str, value: str | None) -> str:
    """With a value, an expression that formats it; without, a pattern that parses."""
    fmt = re.sub(r"%E\*?(\d*)S", lambda m: "%S" if not m[1] else "%S", fmt).replace("%E4Y", "%Y").replace("%Ez", "%z")
    parts = re.findall(r"%.|[^%]+", fmt)
    if value is None:
        return "".join(PATTERNS.get(p[1:], "") if p[0] == "%" and p != "%%" else re.sub(r"([A-Za-z]+)", r"'\1'", p.replace("'", "''")) for p in parts)
    out = []
    for p in parts:
        if p[0] != "%":
            out.append(_quoted(p))
        elif p[1] in EXPRESSIONS:
            out.append(EXPRESSIONS[p[1]].format(value))
        elif p[1] in PATTERNS:
            out.append(f"date_format({value}, {_quoted(PATTERNS[p[1]])})")
        else:
            raise ValueError(f"no such format element: {p}")
    return f"concat({', '.join(out)})" if len(out) != 1 else out[0]


SPEC = re.compile(r"%(?P<flags>[-+ #0']*)(?P<width>\d*)(?:\.(?P<prec>\d+))?(?P<kind>[diouxXfFeEgGsStTp%])")


def readable(value: str, kind: str) -> str:
    """%t: the value as text."""
    if kind in ("double", "float"):
        return f"CAST({value} AS STRING)"
    if kind == "timestamp":
        return f"concat(CAST({value} AS STRING), '+00')"
    if kind.startswith("array"):
        return f"concat('[', array_join(transform({value}, __e -> CAST(__e AS STRING)), ', ', 'NULL'), ']')"
    return f"coalesce(CAST({value} AS STRING), 'NULL')"


def literal(value: str, kind: str) -> str:
    """%T: the value as a literal of the dialect."""
    if kind == "string":
        return f"concat('\"', {value}, '\"')"
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return f"concat('{ {'date': 'DATE', 'timestamp': 'TIMESTAMP', 'timestamp_ntz': 'DATETIME'}[kind] } \"', {readable(value, kind)}, '\"')"
    if kind.startswith("array<string"):
        return f"concat('[', array_join(transform({value}, __e -> concat('\"', __e, '\"')), ', ', 'NULL'), ']')"
    return readable(value, kind)


def format_string(fmt: str, args: list[str], kinds: list[str]) -> str:
    out, at, used = [], 0, 0
    for m in SPEC.finditer(fmt):
        if m.start() > at:
            out.append(_quoted(fmt[at : m.start()]))
        at = m.end()
        if m["kind"] == "%":
            out.append("'%'")
            continue
        value, kind, k = args[used], kinds[used], m["kind"]
        used += 1
        if k in "tT":
            text = (readable if k == "t" else literal)(value, kind)
        elif k in "sS":
            text = f"CAST({value} AS STRING)" if not m["prec"] else f"left(CAST({value} AS STRING), {m['prec']})"
        elif "'" in m["flags"] and k in "di":
            text = f"format_number({value}, 0)"
        else:
            spec = "%" + m["flags"].replace("'", ",") + m["width"] + (f".{m['prec']}" if m["prec"] is not None else "") + ("d" if k == "i" else k)
            cast = f"CAST({value} AS DOUBLE)" if k in "fFeEgG" else value
            out.append(f"format_string({_quoted(spec)}, {cast})")
            continue
        if m["width"]:
            text = f"{'rpad' if '-' in m['flags'] else 'lpad'}({text}, greatest({m['width']}, char_length({text})), ' ')"
        out.append(text)
    if at < len(fmt):
        out.append(_quoted(fmt[at:]))
    return f"concat({', '.join(out)})" if out else "''"

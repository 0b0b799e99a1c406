"""References in scripts: what their strings name, with the call, field or tag they stand in."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import formats_more
from .formats import Bad

# The longest value kept, operators of two signs, and what escapes in strings stand for.
LONGEST = 512
PAIRS = "== != <= >= && || ++ -- += -= *= /= %= =>"
ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "0": "\0"}

TOKEN = re.compile(
    r"(?P<skip>//[^\n]*|/\*.*?(?:\*/|\Z)|\s+)"
    r"|(?P<string>\"(?:[^\"\\]|\\.)*(?:\"|\\?\Z)|'(?:[^'\\]|\\.)*(?:'|\\?\Z))"
    r"|(?P<word>(?:[_$A-Za-z]|[^\x00-\x7f])(?:[_$A-Za-z0-9]|[^\x00-\x7f])*)"
    r"|(?P<number>[0-9][0-9A-Za-z.]*)"
    r"|(?P<sign>[()\[\]{}.,;:?])"
    r"|(?P<operator>" + "|".join(map(re.escape, PAIRS.split())) + r"|.)",
    re.S,
)
ESCAPE = re.compile(r"\\(?:x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|(.)|\Z)", re.S)
TAG = re.compile(r"\[((?:[^\]\"'\\]|\\(?![\"'])|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')*)\]")
ATTRIBUTE = re.compile(r"([^\s=\[\]]+)(?:\s*=\s*(?:\"((?:[^\"\\]|\\.)*)\"?|'((?:[^'\\]|\\.)*)'?|(\S*)))?")

Reference = tuple[int, str, str]


def _unescaped(literal: str) -> str:
    body = literal[1:-1] if len(literal) > 1 and literal[-1] == literal[0] else literal[1:]

    def one(m: re.Match) -> str:
        code = m[1] or m[2]
        if code:
            return "" if "d800" <= code.lower() <= "dfff" and len(code) == 4 else chr(int(code, 16))
        return "" if m[3] is None or m[3] in "xu" else ESCAPES.get(m[3], m[3])

    return ESCAPE.sub(one, body)


def tokens(text: str) -> list[tuple[int, str, str]]:
    """(line, kind, value) of a script: strings unescaped, comments and blanks left out."""
    out, line = [], 1
    for m in TOKEN.finditer(text):
        kind, value = m.lastgroup, m[0]
        if kind != "skip":
            out.append((line, kind, _unescaped(value) if kind == "string" else value))
        line += value.count("\n")
    return out


def _kept(found: Iterator[Reference]) -> list[Reference]:
    """Trimmed values without control characters, each (line, context, value) once, in order."""
    out = {}
    for line, context, value in found:
        value = value.strip().strip("\0")
        if 0 < len(value) <= LONGEST and not re.search("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", value):
            out[line, context, value] = None
    return list(out)


def _callee(found: list[tuple[int, str, str]], before: int) -> str:
    parts = []
    while before > 0 and (found[before - 1][1] == "word" or found[before - 1][1:] == ("sign", ".")):
        before -= 1
        parts.append(found[before][2])
    name = "".join(reversed(parts))
    return "" if name.endswith(".") else name


def _source(text: str) -> Iterator[Reference]:
    found = tokens(text)
    yield from ((line, "literal", v) for line, kind, v in found if kind == "string")
    # Strings directly inside the brackets of a call; brackets of any other kind keep no depth.
    calls = [(i, callee) for i, t in enumerate(found) if t[1:] == ("sign", "(") and (callee := _callee(found, i))]
    inside: dict[int, list[int]] = {}
    stack: list[int] = []
    for i, (_, kind, value) in enumerate(found):
        if kind == "string" and stack:
            inside.setdefault(stack[-1], []).append(i)
        elif kind == "sign" and value == "(":
            stack.append(i)
        elif kind == "sign" and value == ")" and stack:
            stack.pop()
    for i, callee in calls:
        yield from ((found[j][0], f"call:{callee}", found[j][2]) for j in inside.get(i, ()))
    for (_, kind, key), (_, _, sign), (line, other, value) in zip(found, found[1:], found[2:]):
        if kind in ("word", "string") and sign in ("=", "=>", ":") and other == "string":
            yield line, f"field:{key}", value
    i = 0
    while i < len(found):
        j = i
        while found[j][1] == "string" and j + 2 < len(found) and found[j + 1][1:] == ("operator", "+") and found[j + 2][1] == "string":
            j += 2
        if j > i:
            yield found[i][0], "concat", "".join(found[k][2] for k in range(i, j + 1, 2))
        i = j + 1


def source_references(text: str) -> list[Reference]:
    """Of a program: `literal`, `call:callee`, `field:key` and `concat` for joined literals."""
    return _kept(_source(text))


def _tag(line: int, body: str) -> Iterator[Reference]:
    head = re.match(r"\s*([^\s=\[\]]+)", body)
    if head:
        for m in ATTRIBUTE.finditer(body, head.end()):
            quoted = m[2] if m[2] is not None else m[3]
            value = re.sub(r"(?s)\\(.)", r"\1", quoted) if quoted is not None else "true" if m[4] is None else m[4]
            yield line, f"kag:{head[1].lower()}:{m[1]}", value


def scenario_references(text: str) -> list[Reference]:
    """Of a scenario: `kag:tag:attribute` for [tags] and @tags, then those of its program blocks."""
    blocks: list[list[str]] = []
    out: list[Reference] = []
    inside = False
    for n, raw in enumerate(text.splitlines(), 1):
        start = raw.lstrip()
        mark = start[:12].lower()
        if inside:
            if mark.startswith(("[endscript", "@endscript")):
                inside = False
            else:
                blocks[-1].append(raw)
        elif mark.startswith(("[iscript", "@iscript")):
            inside = True
            blocks.append([])
        elif start.startswith("@"):
            out += _tag(n, start[1:])
        elif not start.startswith(";"):
            for m in TAG.finditer(raw):
                out += _tag(n, m[1])
    for block in blocks:
        out += source_references("\n".join(block) + "\n")
    return _kept(iter(out))


def script_text(data: bytes) -> str:
    """A script's text: unwrapped, by its mark, else UTF-8, else CP932."""
    try:
        data = formats_more.unwrapped(data)[1]
    except Bad:
        pass
    for mark, encoding in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\xef\xbb\xbf", "utf-8")):
        if data.startswith(mark):
            return data[len(mark) :].decode(encoding, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp932", "replace")


def references(name: str | None, data: bytes | None) -> list[Reference]:
    """By the name's ending alone; other files have none."""
    lower = (name or "").lower()
    if data is None or not lower.endswith((".tjs", ".ks", ".kag")):
        return []
    if lower.endswith(".tjs"):
        return [] if data.startswith(b"TJS2100\0") else source_references(script_text(data))
    return scenario_references(script_text(data))


def mined(df: DataFrame, keys: list[str], name: Column, data: Column) -> DataFrame:
    """keys, line, context, value: a row for each reference in the scripts of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [references(n, d) for n, d in zip(batch.column("_name").to_pylist(), batch.column("_data").to_pylist())]
            flat = [r for rows in found for r in rows]
            owner = pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int64())
            own = [batch.column(k).take(owner) for k in keys]
            new = [pa.array([r[0] for r in flat], pa.int32()), *(pa.array([r[i] for r in flat], pa.string()) for i in (1, 2))]
            yield pa.RecordBatch.from_arrays([*own, *new], names=[*keys, "line", "context", "value"])

    rows = df.select(*keys, name.alias("_name"), data.alias("_data"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    return rows.mapInArrow(run, f"{schema}, line int, context string, value string")


# --- names in any bytes

_EDGES = "[]{}`"
_MARKS = "!?><"
_BREAK = r"\s\x00-\x1f\x7f-\x9f\ud800-\udfff�\"'<>(),;="
_RUN = re.compile(f"[^{_BREAK}]+")
_ASCII = re.compile(r"[!#-&*-:?-~]+")


def _candidate(token: str, most: int) -> Iterator[str]:
    if len(token) > most:
        return
    token = token.strip(_EDGES).strip(_MARKS)
    if not 3 <= len(token) <= 240:
        return
    if re.search(r"[./\\]", token) or all(c.isalnum() or c in "_-+@~" for c in token):
        yield token.replace("\\", "/")
    tail = re.search(r"[\x00-\x7f]", token)
    if tail and tail.start():
        rest = token[tail.start() :]
        if rest.isascii() and len(rest) >= 3 and re.search(r"[./\\]", rest):
            yield rest.replace("\\", "/")


def free_names(data: bytes) -> set[str]:
    """Path-like and word-like runs of ASCII, and of UTF-16LE at both alignments."""
    out = {c for m in _ASCII.finditer(data.decode("latin-1")) for c in _candidate(m[0], 240)}
    for at in (0, 1):
        units = data[at : len(data) - (len(data) - at) % 2].decode("utf-16-le", "surrogatepass") if len(data) - at > 1 else ""
        units = re.sub("[\U00010000-\U0010ffff]", "�", units)  # units of a pair part names
        out |= {c for m in _RUN.finditer(units) for c in _candidate(m[0], 240)}
    return out


def mined_names(df: DataFrame, id_col: str, data: Column) -> DataFrame:
    """id, candidate: a row for each name that the bytes may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, c) for i, d in zip(batch.column("id").to_pylist(), batch.column("data").to_pylist()) for c in sorted(free_names(d or b""))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["id", "candidate"])

    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), data.alias("data")).mapInArrow(run, "id long, candidate string")

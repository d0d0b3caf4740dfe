"""Canonical form of the tool calls in an action text.

Two actions get the same signature when they make the same calls with the same
effect: spelling of the tool name, JSON layout and key order, bare text in
place of JSON, quotes, blanks, doubled slashes and a final ``;`` make no
difference, nor do values that are new on each run (ids and clock times put
into the environment, names of temporary output).  Any other target, range,
pattern, option, thought or content does.
"""

from __future__ import annotations

import json
import re
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The argument that bare text stands for, by tool.
BARE_ARGUMENT = {"execute_bash": "command", "bash": "command", "think": "thought", "finish": "message"}
#: Arguments that hold prose, a shell command or a path.
PROSE = frozenset({"thought", "message"})
PATHS = frozenset({"path", "file", "filename", "directory"})
#: Tools whose ``command`` argument names a sub-command, not a shell line.
EDITORS = frozenset({"str_replace_editor", "edit_file", "editor"})

_DECODER = json.JSONDecoder()
_NAME = re.compile(r"\s*([A-Za-z_]\w*)(?:\s+|(?=\{)|$)")
_NEXT = re.compile(r"\s([A-Za-z]\w*_\w+|think|finish|bash)\s+(?=\{)|\s(execute_bash|str_replace_editor)\s", re.I)
_SLASHES = re.compile(r"(?<!:)/(?:\.?/)+")
_NONWORD = re.compile(r"[\W_]+")
_VALUE = r"(?:\d{8}T\d{6}\w*|\d{4}-\d\d-\d\dT?[\d:.]*Z?|\d[\d:.]*|[0-9a-fA-F]{4,}(?:-[0-9a-fA-F]{4,})*)"
#: NAME=value before a command, when the name or the value is that of a run, clock or random number.
_ENV = re.compile(rf"(?<!\S)([A-Z][A-Z0-9_]*)=(?:(?<=ID=)\S+|(?<=TS=)\S+|(?<=TIME=)\S+|(?<=STAMP=)\S+|(?<=NONCE=)\S+|{_VALUE}(?=\s|$))")
_CLOCK = re.compile(r"\b\d{8}T\d{4,6}Z?\b|\b\d{4}-\d\d-\d\d[T_ ]\d\d[:\-]?\d\d(?:[:\-]?\d\d(?:\.\d+)?)?Z?\b|\b\d\d:\d\d:\d\d(?:\.\d+)?\b")
_TEMPORARY = re.compile(rf"((?:/var)?/tmp/(?:[\w.\-]+/)*?[A-Za-z][\w.]*?[-_.])(?:{_VALUE}|[A-Za-z0-9]{{6,12}})(?=[./\s\"';]|$)")
_TMPFILE = re.compile(r"((?:/var)?/tmp/tmp)[\w.]+")


def split_calls(text: str) -> list[tuple[str, object]]:
    """``(tool, arguments)`` of each call; arguments are decoded JSON or bare text."""
    calls: list[tuple[str, object]] = []
    at, end = 0, len(text)
    while at < end:
        m = _NAME.match(text, at)
        if not m:
            if rest := text[at:].strip():
                calls.append(("", rest))
            break
        name, at = m[1].lower(), m.end()
        if text.startswith("{", at):
            try:
                value, at = _DECODER.raw_decode(text, at)
                calls.append((name, value))
                continue
            except ValueError:
                pass
        nxt = _NEXT.search(text, max(at - 1, 0))
        stop = nxt.start() if nxt else end
        calls.append((name, text[at:stop]))
        at = max(stop, at)
    return calls


def _shell(s: str) -> str:
    s = " ".join(s.split()).replace("'", '"')
    if "=" in s:
        s = _ENV.sub(r"\1=<x>", s)
    if "/tmp/" in s:
        s = _TMPFILE.sub(r"\1", _TEMPORARY.sub(r"\1<x>", s))
    if ":" in s or "T" in s:
        s = _CLOCK.sub("<t>", s)
    if "//" in s or "/./" in s:
        s = _SLASHES.sub("/", s)
    return s.replace(" ./", " ").strip(" ;")


def _argument(tool: str, key: str, value: object) -> str:
    if not isinstance(value, str):
        return json.dumps(value, sort_keys=True, separators=(",", ":"))
    if key in PROSE:
        return _NONWORD.sub(" ", value.lower()).strip()
    if key in PATHS:
        value = value.strip()
        return (_SLASHES.sub("/", value) if "//" in value or "/./" in value else value).rstrip("/")
    if key in ("command", "cmd") and tool not in EDITORS:
        return _shell(value)
    return "\n".join(line.rstrip() for line in value.strip("\r\n").splitlines())


def canonical(text: str) -> str:
    """The canonical text of all calls of an action, in order."""
    out = []
    for tool, args in split_calls(text):
        if not isinstance(args, dict):
            args = {BARE_ARGUMENT.get(tool, "text"): args}
        out.append(tool + "\x1e" + "\x1f".join(f"{k}={_argument(tool, k, args[k])}" for k in sorted(args)))
    return "\x1d".join(out)


def signature(text: str) -> int:
    """64 bits of the canonical text."""
    return int.from_bytes(blake2b(canonical(text).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def call_signature(c: Column) -> Column:
    """``signature`` of a text column as an Arrow UDF; NULL stays NULL."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        seen = {t: signature(t) for t in set(texts) if t is not None}
        return pd.Series([seen.get(t) for t in texts], dtype="Int64")

    return of(c)

"""Text folding in Python: undo layout, mark-up and disguises before comparing texts."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable

# Letters of other alphabets that look like Latin ones.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d",
    "һ": "h", "ӏ": "l", "ѵ": "v", "ԛ": "q", "ԝ": "w", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H",
    "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "к": "k", "т": "t",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A",
    "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ı": "i", "ſ": "s", "ɑ": "a", "ɡ": "g",
}
_LOOK = re.compile(f"[{''.join(LOOKALIKES)}]")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9]{0,15}(?:\s[^<>]{0,200})?/?>")
_BREAK = re.compile(r"\r\n?|[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
_INVISIBLE = re.compile(r"[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]")
#: White space other than one blank or line break.
_SPACE = re.compile(r"[^\S\n ][^\S\n]*| [^\S\n]+")




def _ranges(codes: Iterable[int]) -> str:
    """The inside of a character class for ascending code points."""
    out: list[list[int]] = []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


_MARKS = re.compile(f"[{_ranges(c for c in range(0x300, 0x20000) if unicodedata.combining(chr(c)))}]+")


def _folded(text: str, keep_accents: bool) -> str:
    """``plain`` with line breaks and blanks as they are."""
    if "\\n" in text or "\\u" in text or '\\"' in text:  # a text inside a JSON string
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text)
        text = text.replace("\\n", "\n").replace("\\t", " ").replace("\\r", "\n").replace('\\"', '"')
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
        text = _LOOK.sub(lambda m: LOOKALIKES[m[0]], text)
        if not keep_accents:
            text = _MARKS.sub("", unicodedata.normalize("NFD", text))
    return text


def plain(text: str, keep_accents: bool = False) -> str:
    """The text without entities, tags, escapes, invisible characters and look-alike letters.

    Line breaks become ``\\n``, other white space one blank; case is kept.
    """
    return _SPACE.sub(" ", _BREAK.sub("\n", _folded(text, keep_accents)))


_WORD = re.compile(r"\w+(?:\.\w+)*")


def words(text: str) -> list[str]:
    """Lower-case words of the plain text; dots inside a word go, so names and numbers stay one word."""
    found = _WORD.findall(_folded(text, False).lower())
    return [w.replace(".", "") if "." in w else w for w in found] if "." in text else found

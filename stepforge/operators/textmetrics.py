"""Action parsing and text similarity."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepforge.config import ACTION_PATTERNS, PATH_PATTERN


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def action_type(text: Column, search_open_file: bool = True) -> Column:
    """The first pattern that occurs, ``text`` if none; NULL counts as empty."""
    text = F.coalesce(text, F.lit(""))
    out = None
    for name, pattern in ACTION_PATTERNS:
        pattern = pattern if search_open_file else pattern.replace("|open_file", "")
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise("text")


def format_score(text: Column) -> Column:
    """0 no tag, .25 unclosed, .3 bad JSON, .5 JSON, and .25 each for a name and arguments."""
    inner = stripped(F.regexp_extract(text, r"(?s)<tool_call>(.*?)</tool_call>", 1))
    closed = text.rlike(r"(?s)<tool_call>.*?</tool_call>")
    parsed = F.try_parse_json(inner)
    keys = F.json_object_keys(inner)
    has = lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False)).cast("int") * 0.25
    return (
        F.when(text.isNull() | ~F.contains(text, F.lit("<tool_call>")), 0.0)
        .when(~closed, 0.25)
        .when(parsed.isNull(), 0.3)
        .otherwise(0.5 + has("name") + has("arguments"))
    )


def file_paths(text: Column) -> Column:
    """Distinct paths in a text: three characters or more, with a slash."""
    # One search of the text; what was found is either a named argument or a path behind a blank or quote.
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATH_PATTERN), F.lit(0))
    found = F.transform(found, lambda m: F.regexp_replace(stripped(F.regexp_replace(m, r'^"(?:path|file_path|filename|target_file)"\s*:\s*"|"$', "")), r'^"+|"+$', ""))
    return F.array_distinct(F.filter(found, lambda p: (F.length(p) >= 3) & F.contains(p, F.lit("/"))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; both empty 1, one empty 0."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def exact_match(a: Column, b: Column) -> Column:
    """X17."""
    return F.coalesce(stripped(a) == stripped(b), F.lit(False))


def _lcs(a: list[str], b: list[str]) -> int:
    masks: dict[str, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | (1 << i)
    full = row = (1 << len(a)) - 1
    for y in b:
        u = row & masks.get(y, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def rouge_l_score(hypothesis: str | None, reference: str | None, words: int | None = 200) -> float:
    """F1 of the longest common subsequence of the first ``words`` words (all if None)."""
    h, r = (hypothesis or "").split()[:words], (reference or "").split()[:words]
    if not h or not r:
        return 0.0
    common = _lcs(h, r)
    return 2 * common / (len(h) + len(r))


def bleu4_score(hypothesis: str | None, reference: str | None) -> float:
    """Sentence BLEU-4 with brevity penalty; a precision without match counts 0.1 / its n-grams (smoothing 1)."""
    h, r = (hypothesis or "").split(), (reference or "").split()
    if not h or not r:
        return 0.0
    logs = 0.0
    for n in range(1, 5):
        mine = Counter(tuple(h[i : i + n]) for i in range(len(h) - n + 1))
        theirs = Counter(tuple(r[i : i + n]) for i in range(len(r) - n + 1))
        hits = sum(min(c, theirs[g]) for g, c in mine.items())
        if n == 1 and not hits:
            return 0.0
        logs += math.log((hits or 0.1) / max(1, sum(mine.values()))) / 4
    return math.exp(logs + min(0.0, 1 - len(r) / len(h)))


@F.pandas_udf(T.DoubleType())
def rouge_l(hypothesis: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([rouge_l_score(h, r) for h, r in zip(hypothesis, reference, strict=True)])


@F.pandas_udf(T.DoubleType())
def bleu4(hypothesis: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([bleu4_score(h, r) for h, r in zip(hypothesis, reference, strict=True)])

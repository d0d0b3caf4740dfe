"""Canonical spellings of identifiers, as Column expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Leading or trailing white space, quotes and back-ticks around an identifier.
EDGE = r"^[\s\x{A0}\x{200B}\x{FEFF}\"'`]+|[\s\x{A0}\x{200B}\x{FEFF}\"'`]+$"


def _edges(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, EDGE, ""))


def trajectory_key(c: Column | str) -> Column:
    """``trj-<id>`` whatever the case, quoting, file ending, ``_`` or missing prefix.

    NULL and blank stay NULL; ids are otherwise compared exactly, so ids that
    only look alike stay apart.
    """
    c = F.col(c) if isinstance(c, str) else c
    s = F.regexp_replace(F.regexp_replace(_edges(c), r"^.*/", ""), r"\.(jsonl?|txt|parquet)$", "")
    s = F.regexp_replace(s, r"^(?:trajectory|traj|trj)?[-_:\s]*", "")
    return F.when(s != "", F.concat(F.lit("trj-"), s))


def repo_key(c: Column | str) -> Column:
    """``owner/name`` of a repository given as a path, URL, ssh address or folder name.

    NULL and blank stay NULL. Only spelling is folded: names that differ in a
    letter, digit, ``-`` or ``_`` are different repositories.
    """
    c = F.col(c) if isinstance(c, str) else c
    s = F.regexp_replace(_edges(c), r"^(https?://[^/]+/|ssh://[^/]+/|git@[^:/]+[:/])", "")
    s = F.regexp_replace(s, r"\s*/\s*", "/")
    s = F.regexp_replace(s, r"(\.git)?/*$", "")
    s = F.when(F.instr(s, "/") > 0, s).otherwise(F.regexp_replace(s, "__", "/"))
    return F.when(s != "", s)


def instance_key(c: Column | str) -> Column:
    """``owner__name-<number>`` of an instance however its parts are joined and its number padded."""
    c = F.col(c) if isinstance(c, str) else c
    s = F.regexp_replace(_edges(c), r"^([^/]+?)(?:__|/)(.+)[-_#]0*(\d+)$", "$1__$2-$3")
    return F.when(s != "", s)


def repo_of_instance(c: Column | str) -> Column:
    """The repository an instance belongs to, or NULL when it cannot be read off."""
    k = instance_key(c)
    s = F.regexp_extract(k, r"^(.+)-\d+$", 1)
    return F.when(s != "", F.regexp_replace(s, "__", "/"))


def source_form(c: Column | str) -> Column:
    """Lower case with ``_`` for runs of blanks and dashes; NULL and blank give NULL."""
    c = F.col(c) if isinstance(c, str) else c
    s = F.regexp_replace(_edges(c), r"[\s\-./]+", "_")
    return F.when(s != "", s)


def source_key(c: Column | str) -> Column:
    """``source_form`` without separators, so ``agentlog`` and ``Agent Log`` are one source."""
    return F.regexp_replace(source_form(c), "_", "")


def unit_hash(c: Column, salt: str) -> Column:
    """A uniform number in [0, 1) from the md5 of ``salt:value``; the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt + ":"), c)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))

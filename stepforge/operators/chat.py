"""Conversations to chat text, label spans and evaluation prompts (X7-X10, W5-W6, F11-F12), inside the row."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepforge.config import LIMITS
from stepforge.operators.evaluation import json_texts
from stepforge.sources.readers import with_ids
from stepforge.sources.tables import delivered_once, where

_TOKEN = re.compile(r"\w+|\S")
#: The rest of a word; a place inside a word.
_REST, _INSIDE = re.compile(r"\w*"), re.compile(r"(?<=\w)(?=\w)")
#: Tokens after which examples are handed on, characters tokenised at once, words whose ids a task remembers and the longest of them.
BLOCK_TOKENS, STRETCH_CHARS, KEPT_WORDS, KEPT_CHARS = 1 << 18, 1 << 16, 1 << 16, 64
START, END = "<|im_start|>", "<|im_end|>"


def chat_messages(messages: str = "trajectory", arguments: str | None = None) -> Column:
    """``array<struct<role, content>>``; tool turns become user turns, calls become text.

    Assistant turns without calls and content are dropped, other roles too.
    NULL content is empty, and so is a missing name.  Arguments stay as they are
    written, unless the column ``arguments`` gives others by message and call.
    """
    given = f"get(get({arguments}, i), j)" if arguments else "c.function.arguments"
    return F.expr(f"""
        filter(transform(coalesce({messages}, array()), (m, i) -> named_struct(
          'role', CASE m.role WHEN 'tool' THEN 'user' ELSE m.role END,
          'content', CASE
            WHEN m.role = 'tool' THEN concat('<tool_response>\\n', coalesce(m.content, ''), '\\n</tool_response>')
            WHEN m.role = 'assistant' AND size(m.tool_calls) > 0 THEN concat(
              CASE WHEN m.content <> '' THEN concat(m.content, '\\n') ELSE '' END,
              array_join(transform(m.tool_calls, (c, j) -> concat('<tool_call>\\n{{"name": "', coalesce(c.function.name, ''), '", "arguments": ',
                coalesce({given}, '{{}}'), '}}\\n</tool_call>')), '\\n'))
            ELSE coalesce(m.content, '') END)),
          x -> x.role IN ('system', 'user', 'assistant') AND NOT (x.role = 'assistant' AND x.content = ''))
    """)


def with_chat(trajectories: DataFrame, least: int = 2, parse_arguments: bool = False) -> DataFrame:
    """``trajectory_id, chat``; conversations of fewer than ``least`` messages are rejected, those delivered twice count once.

    With ``parse_arguments`` (X19) JSON objects among the arguments are written in the common layout.
    """
    rows = delivered_once(trajectories, "trajectory_id", "trajectory")
    if parse_arguments:
        written = F.expr("transform(coalesce(trajectory, array()), m -> transform(coalesce(m.tool_calls, array()), c -> c.function.arguments))")
        rows = rows.withColumn("arguments", json_texts(written))
    chat = chat_messages(arguments="arguments" if parse_arguments else None)
    return where(rows, "chat", chat, lambda c: F.size(c) >= least).select("trajectory_id", "chat")


def render(chat: str = "chat") -> Column:
    """The chat template text."""
    return F.expr(f"array_join(transform({chat}, m -> concat('{START}', m.role, '\\n', m.content, '{END}\\n')), '')")


def assistant_spans(text: str) -> Column:
    """``array<struct<begin, end>>`` of character positions (from 0, end exclusive).

    A span runs from an assistant marker up to the next end or start marker,
    or to the end of the text.
    """
    marker = START + "assistant"
    n = len(marker)
    # The text between markers: each piece after a split at the marker begins right behind one.
    return F.expr(f"""
        filter(transform(
          aggregate(split({text}, r'\\Q{marker}\\E', -1), named_struct('at', CAST(0 AS INT), 'out', CAST(array() AS ARRAY<STRUCT<begin: INT, end: INT>>)),
            (s, p) -> named_struct('at', s.at + length(p) + {n}, 'out', array_append(s.out, named_struct(
              'begin', s.at - {n},
              'end', s.at + CAST(length(regexp_extract(p, r'(?s)^(.*?)(?:<\\|im_end\\|>|<\\|im_start\\|>|$)', 1)) AS INT)))),
            s -> s.out), x -> x), x -> x.begin >= 0)
    """)


def span_chars(spans: str = "spans") -> Column:
    """Characters inside spans."""
    return F.expr(f"aggregate({spans}, 0, (n, s) -> n + s.end - s.begin)")


def label_mask(examples: DataFrame, encode: Callable[[str], list[tuple[int, int, int]]] | None = None, limit: int = LIMITS.sequence_tokens, mask: int = LIMITS.label_mask) -> DataFrame:
    """``trajectory_id, input_ids, attention_mask, labels`` of ``text`` and ``spans``, cut to ``limit`` tokens.

    ``encode`` gives (id, begin, end) of every token; by default words and
    single marks with a 31-bit hash.  A token is labelled with its id where it
    overlaps a span and isn't empty, else with ``mask``.  Examples without a
    labelled token are rejected.  Examples are read one at a time and handed on
    in blocks, so a task holds ``BLOCK_TOKENS`` and the tokens of one example.
    """

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordIds()
        for batch in batches:
            keys, ends, ids, labels = [], [0], array("i"), array("i")
            for k, (key, text, spans) in enumerate(zip(batch.column("trajectory_id"), batch.column("text"), batch.column("spans"), strict=True), 1):
                text, spans = text.as_py(), [(s["begin"], s["end"]) for s in spans.as_py()]
                if encode or any(_INSIDE.match(text, at) for s in spans for at in s):
                    own, marked = _labelled((encode or word_tokens)(text)[:limit], spans, mask)
                else:
                    own, marked = _labelled_words(text, spans, limit, mask, words)
                if (np.frombuffer(marked, np.int32) != mask).any():
                    ids += own
                    labels += marked
                    keys.append(key.as_py())
                    ends.append(len(ids))
                if keys and (len(ids) >= BLOCK_TOKENS or k == batch.num_rows):
                    lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in (np.frombuffer(ids, np.int32), np.ones(len(ids), np.int32), np.frombuffer(labels, np.int32))]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *lists], names=["trajectory_id", "input_ids", "attention_mask", "labels"])
                    keys, ends, ids, labels = [], [0], array("i"), array("i")

    return examples.select("trajectory_id", "text", "spans").mapInArrow(label, "trajectory_id string, input_ids array<int>, attention_mask array<int>, labels array<int>")


def _labelled(tokens: list[tuple[int, int, int]], spans: list[tuple[int, int]], mask: int) -> tuple[array, array]:
    """Ids and labels of tokens with places."""
    labels, at = array("i"), 0
    for t, begin, end in tokens:
        while at < len(spans) and spans[at][1] <= begin:
            at += 1
        labels.append(t if at < len(spans) and begin < end and spans[at][0] < end else mask)
    return array("i", (t for t, _, _ in tokens)), labels


def _labelled_words(text: str, spans: list[tuple[int, int]], limit: int, mask: int, words: _WordIds) -> tuple[array, array]:
    """The same of ``word_tokens``, where no span begins or ends inside a word: between such places the words' own places don't matter."""
    ids, labels, at = array("i"), array("i"), 0
    for k, cut in enumerate([*(min(place, len(text)) for s in spans for place in s), len(text)]):
        while at < cut and len(ids) < limit:
            to = min(cut, _REST.match(text, at + STRETCH_CHARS).end())
            found = array("i", list(map(words.__getitem__, _TOKEN.findall(text, at, to))))
            ids += found
            labels += found if k % 2 else array("i", [mask]) * len(found)
            at = to
    return ids[:limit], labels[:limit]


class _WordIds(dict):
    """Ids of words; those of the words met lately are kept."""

    def __missing__(self, word: str) -> int:
        n = _word_id(word)
        if len(word) <= KEPT_CHARS:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = n
        return n


def _word_id(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) & 0x7FFFFFFF


def word_tokens(text: str) -> list[tuple[int, int, int]]:
    """Words and single marks with a hash as id, and their places."""
    return [(_word_id(m[0]), m.start(), m.end()) for m in _TOKEN.finditer(text)]


def with_turns(df: DataFrame, chat: str = "chat") -> DataFrame:
    """Adds ``system`` and ``others`` (messages) and ``turns``: adjacent user-assistant pairs of the others."""
    return (
        df.withColumn("system", F.expr(f"filter({chat}, m -> m.role = 'system')"))
        .withColumn("others", F.expr(f"filter({chat}, m -> m.role <> 'system')"))
        .withColumn("turns", F.expr("filter(transform(others, (m, i) -> named_struct('u', m, 'a', get(others, i + 1))), t -> t.u.role = 'user' AND t.a.role = 'assistant')"))
    )


def prefix(steps: int) -> Column:
    """W5, over ``with_turns``: ``struct<prompt, target>`` after ``steps`` turns, NULL if the conversation is shorter.

    The prompt is the system messages, the first turns and the next user
    message; the target is the reply to it.
    """
    return F.expr(f"""
        CASE WHEN size(turns) > {steps} THEN named_struct(
          'prompt', concat(system, flatten(transform(slice(turns, 1, {steps}), t -> array(t.u, t.a))), array(get(turns, {steps}).u)),
          'target', get(turns, {steps}).a.content) END
    """)


def first_action() -> Column:
    """W6, over ``with_turns``: ``struct<prompt, target>``: systems and the first user message, and the first reply.

    NULL if the first other message isn't the user's or nobody replies.
    """
    return F.expr("""
        CASE WHEN get(others, 0).role = 'user' AND exists(others, m -> m.role = 'assistant') THEN named_struct(
          'prompt', concat(system, array(get(others, 0))), 'target', get(filter(others, m -> m.role = 'assistant'), 0).content) END
    """)


def examples(trajectories: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Training examples: semi-join on ids, chat text, spans; without an assistant span a row is rejected."""
    chats = with_chat(trajectories)
    texts = (chats if ids is None else with_ids(chats, ids)).select("trajectory_id", render().alias("text"))
    return where(texts, "spans", assistant_spans("text"), lambda s: F.size(s) > 0)

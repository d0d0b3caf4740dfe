"""Nested trajectories to actions, observations and raw metrics.

Everything is computed inside the row with higher-order functions: one scan,
no explode, no shuffle of message texts.  Only the narrow metrics are
exchanged, to fold rows delivered twice.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepforge.config import ERROR_KEYWORDS, FILE_EXTENSIONS, LIMITS, NOISE_PATTERNS, TEST_KEYWORDS, Limits
from stepforge.sources.tables import delivered_once, spread

#: Line ends as text processing knows them.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"
TOKEN_PATTERN = r"\w+|[^\w\s]"


def any_of(words: tuple[str, ...]) -> str:
    """A pattern that finds any of the words."""
    return "|".join(re.escape(w).replace("\\ ", " ").replace("\\_", "_") for w in words)


def actions(messages: str = "trajectory") -> Column:
    """One struct per assistant message with tool calls, with the first non-empty observation after it.

    ``idx, tool, args_prefix`` (of the first call), ``action_text`` (all calls), ``obs`` ('' if none).
    """
    return F.expr(f"""
        transform(
          filter(transform(coalesce({messages}, array()), (m, i) -> struct(i, m)), x -> x.m.role = 'assistant' AND size(x.m.tool_calls) > 0),
          (a, k) -> struct(
            k AS idx,
            coalesce(a.m.tool_calls[0].function.name, 'unknown') AS tool,
            substring(coalesce(a.m.tool_calls[0].function.arguments, ''), 1, 200) AS args_prefix,
            array_join(transform(a.m.tool_calls, c -> concat(coalesce(c.function.name, 'unknown'), ' ', coalesce(c.function.arguments, ''))), ' ') AS action_text,
            a.i AS at))
    """)


def observed(messages: str = "trajectory", acts: str = "acts") -> Column:
    """The actions with ``obs`` filled in."""
    return F.expr(f"""
        transform({acts}, (a, k) -> struct(a.idx, a.tool, a.args_prefix, a.action_text,
          coalesce(get(filter(
            slice({messages}, a.at + 2, coalesce(get({acts}, k + 1).at, size({messages})) - a.at - 1),
            m -> m.role IN ('user', 'tool') AND m.content <> ''), 0).content, '') AS obs))
    """)


def with_actions(df: DataFrame) -> DataFrame:
    """Adds ``actions``, ``observations`` (all non-empty user and tool contents) and ``calls`` (name, args)."""
    return (
        df.withColumn("acts", actions())
        .withColumn("actions", observed())
        .withColumn("observations", F.expr("transform(filter(coalesce(trajectory, array()), m -> m.role IN ('user', 'tool') AND m.content <> ''), m -> m.content)"))
        .withColumn(
            "calls",
            F.expr("""
                flatten(transform(filter(coalesce(trajectory, array()), m -> m.role = 'assistant' AND size(m.tool_calls) > 0),
                  m -> transform(m.tool_calls, c -> struct(coalesce(c.function.name, 'unknown') AS name, coalesce(c.function.arguments, '') AS args))))
            """),
        )
        .drop("acts")
    )


def redundancy(acts: str = "actions", window: int = LIMITS.redundancy_window) -> Column:
    """B1 (W2): share of actions that equal one of the ``window`` before; 0 below two actions."""
    return F.expr(f"""
        CASE WHEN size({acts}) < 2 THEN 0.0D ELSE
          size(filter({acts}, (a, k) -> k > 0 AND exists(slice({acts}, greatest(k - {window}, 0) + 1, least(k, {window})),
            p -> p.tool = a.tool AND p.args_prefix = a.args_prefix))) / size({acts}) END
    """)


def retry_cycles(acts: str = "actions") -> Column:
    """B2 (W3): actions whose observation shows an error and that are followed by one of the same tool."""
    return F.expr(f"""size(filter({acts}, (a, k) -> k + 1 < size({acts}) AND lower(a.obs) RLIKE '{any_of(ERROR_KEYWORDS)}' AND get({acts}, k + 1).tool = a.tool))""")


def noise_ratio(observations: str = "observations") -> Column:
    """C1 (X2): characters on noisy lines over all characters; 0 without observations."""
    return F.expr(f"""
        coalesce(try_divide(
          aggregate({observations}, 0L, (n, o) -> n + aggregate(filter(split(o, r'{LINE_BREAK}'), s -> lower(s) RLIKE '{any_of(NOISE_PATTERNS)}'), 0L, (x, s) -> x + length(s))),
          aggregate({observations}, 0L, (n, o) -> n + length(o))), 0.0D)
    """)


def keywords(text: str) -> str:
    """C3 (X3): SQL for the distinct lower-case file names and error classes of an observation."""
    ext = "|".join(FILE_EXTENSIONS)
    return f"""array_distinct(concat(
        filter(transform(regexp_extract_all(lower({text}), r'(?U)[\\w./\\-]+\\.(?:{ext})\\b', 0), f -> element_at(split(f, '/'), -1)), f -> length(f) > 4),
        transform(regexp_extract_all({text}, r'(?U)\\b\\w+(?:Error|Exception|Warning)\\b', 0), e -> lower(e))))"""


def utilization(acts: str = "actions", texts: str = "action_texts") -> Column:
    """C3 (W4): share of an observation's keywords that a later action takes up; 1 if there are none.

    ``texts`` holds the actions' texts in lower case, made once per row.  Where
    a keyword was used last is looked up once in all texts, from their end, so
    the work is that of the different keywords, not of pairs of actions.
    """
    # Keywords hold no line break, so none is found across two texts.  ``starts``: where each text begins.
    return F.expr(f"""
        aggregate(array(named_struct('found', transform({acts}, a -> {keywords("a.obs")}), 'back', reverse(array_join({texts}, '\n')))), named_struct('n', 0L, 'u', 0L),
          (s, x) -> aggregate(array(named_struct(
              'last', map_from_entries(transform(array_distinct(flatten(x.found)), w -> struct(w, instr(x.back, reverse(w))))), 'length', length(x.back),
              'starts', aggregate({texts}, array(0L), (at, t) -> array_append(at, element_at(at, -1) + length(t) + 1)))), s,
            (s, y) -> aggregate(transform(x.found, (f, k) -> struct(size(f) AS n, size(filter(f, w -> y.last[w] BETWEEN 1 AND y.length + 1 - length(w) - get(y.starts, k + 1))) AS u)), s,
              (s, c) -> named_struct('n', s.n + c.n, 'u', s.u + c.u))),
          s -> CASE WHEN s.n = 0 THEN 1.0D ELSE s.u / s.n END)
    """)


def entropy(counts: Column) -> Column:
    """A4: Shannon entropy of counts over its maximum; 0 for one kind or none."""
    total = F.aggregate(counts, F.lit(0).cast("double"), lambda s, x: s + x)
    bits = F.aggregate(counts, F.lit(0).cast("double"), lambda s, x: s - (x / total) * F.log2(x / total))
    return F.when(F.size(counts) > 1, bits / F.log2(F.size(counts))).otherwise(F.lit(0.0))


def token_text(messages: str = "trajectory") -> Column:
    """The text of every message whose tokens are counted (content, call names and arguments)."""
    return F.expr(f"""
        transform(coalesce({messages}, array()), m -> array_join(concat(array(nullif(m.content, '')),
          flatten(transform(coalesce(m.tool_calls, array()), c -> array(nullif(c.function.name, ''), c.function.arguments)))), ' '))
    """)


def token_total(texts: Column) -> Column:
    """A5: tokens of all texts by the built-in pattern (words and single marks)."""
    return F.aggregate(texts, F.lit(0).cast("long"), lambda n, t: n + F.regexp_count(t, F.lit(TOKEN_PATTERN)))


def tokenizer_total(path: str, pattern: str) -> Callable[[Column], Column]:
    """A5, HP1: token totals by a byte-pair vocabulary (lines of base64 token and rank) at ``path``, in Arrow batches.

    Each worker reads the file once; ``path`` must be readable on all of them.
    """
    ready: dict[str, object] = {}

    @F.pandas_udf(T.LongType())
    def total(texts: pd.Series) -> pd.Series:
        if path not in ready:
            import base64

            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            ready[path] = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        encode = ready[path].encode_ordinary
        return texts.map(lambda parts: sum(len(encode(t)) for t in parts if t))

    return total


def trajectory_stats(trajectories: DataFrame, limits: Limits = LIMITS, tokens: Callable[[Column], Column] = token_total) -> DataFrame:
    """One row of raw metrics per trajectory, the map of tool calls included.

    ``tokens`` counts the tokens of an array of texts: the built-in pattern, or a ``tokenizer_total``.

    Rows delivered twice count once.  A NULL or empty trajectory has no
    actions: ratios are 0, except uniqueness and utilisation, which are 1.
    NULL status, patch and resolved mean not submitted, no patch, not resolved.
    """
    status = F.lower(F.trim(F.coalesce("exit_status", F.lit(""))))
    names = F.expr("array_distinct(transform(calls, c -> c.name))")
    tests = any_of(TEST_KEYWORDS)
    per_row = (
        with_actions(spread(trajectories))
        .withColumn("action_texts", F.expr("transform(actions, a -> lower(a.action_text))"))
        .withColumn("n_actions", F.size("actions").cast("long"))
        .withColumn("tools", names)
        .withColumn("tool_call_counts", F.expr("map_from_entries(transform(tools, t -> struct(t, CAST(size(filter(calls, c -> c.name = t)) AS BIGINT))))"))
        .select(
            "trajectory_id",
            "instance_id",
            "repo",
            tokens(token_text()).alias("total_tokens"),
            F.expr("CAST(size(filter(coalesce(trajectory, array()), m -> m.role = 'assistant')) AS BIGINT)").alias("assistant_turns"),
            "tool_call_counts",
            F.size("calls").cast("long").alias("total_tool_calls"),
            "exit_status",
            (status == "submit").alias("ends_with_submit"),
            (status != "submit").alias("is_error_or_timeout"),
            F.coalesce(F.col("resolved").cast("long"), F.lit(0)).alias("resolved"),
            F.coalesce(F.regexp_replace("model_patch", r"^\s+|\s+$", "") != "", F.lit(False)).alias("has_patch"),
            F.coalesce(F.length("model_patch"), F.lit(0)).cast("long").alias("patch_length"),
            F.expr("coalesce(try_divide(aggregate(observations, 0L, (n, o) -> n + length(o)), size(observations)), 0.0D)").alias("avg_observation_length"),
            F.size("observations").cast("long").alias("num_observations"),
            F.expr("coalesce(try_divide(size(array_distinct(transform(calls, c -> struct(c.name, substring(c.args, 1, 200))))), size(calls)), 1.0D)").alias("unique_action_ratio"),
            F.expr(f"CASE WHEN exists(calls, c -> c.name = 'execute_bash' AND lower(substring(c.args, 1, 200)) RLIKE '{tests}') THEN 1.0D ELSE 0.0D END").alias("test_alignment_score"),
            redundancy(window=limits.redundancy_window).alias("redundant_cmds_ratio"),
            retry_cycles().cast("long").alias("error_retry_count"),
            F.greatest(F.col("n_actions") - 1, F.lit(0)).cast("long").alias("total_action_pairs"),
            noise_ratio().alias("obs_noise_char_ratio"),
            utilization().alias("obs_utilization_ratio"),
        )
    )
    return once(per_row, "trajectory_id")


def once(df: DataFrame, key: str) -> DataFrame:
    """One row per key: of rows that differ the one with the greatest hash, so the choice is the same on every run."""
    plain = [c for c, t in df.dtypes if not t.startswith("map")]
    picked = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.xxhash64(*plain)).alias("r"))
    return picked.select("r.*")


def steps(trajectories: DataFrame) -> DataFrame:
    """W1 as a table: ``trajectory_id, step_idx, tool, args_prefix, action_text, obs_text``, one row per action."""
    rows = delivered_once(trajectories, "trajectory_id", "trajectory").withColumn("acts", actions())
    # The expression itself is exploded: of a column Spark would first filter the empty ones, making it twice.
    flat = rows.select("trajectory_id", F.explode(observed()).alias("a"))
    return flat.select("trajectory_id", F.col("a.idx").alias("step_idx"), "a.tool", "a.args_prefix", "a.action_text", F.col("a.obs").alias("obs_text"))

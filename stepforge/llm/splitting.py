"""Problem 5: cut oversized trajectories at natural boundaries.

Method: agglomerative merging.  A trajectory is first taken apart into atomic
segments (the prompt, steps and, where a step is too long itself, its messages,
paragraphs and lines).  Adjacent pairs wait in a heap; the weakest boundary is
merged first, then the smallest pair, while the merged piece and the overlap
in front of it stay within the limit.  What is left are the pieces; the
boundaries between them are the strongest that the limit allows.

A trajectory of very many steps is taken apart in chunks by several tasks.  The
pieces at the two sides of a chunk's edge are then taken apart again and merged
as one, level by level over pairs of chunks, so that no cut is made because of
a chunk; two pieces at most are gathered, which hold no more than two limits.

Token counts refer to full texts of which the tables hold excerpts, so a
boundary inside a step lies at the share of its characters that precede it.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepforge.functions.ids import trajectory_key
from stepforge.session import cut

#: Steps of a trajectory that one task takes apart.
CHUNK = 4096
#: Boundaries from the weakest to the strongest; ``tool`` is a step that takes up another tool.
STRENGTH = {"inside": 0, "line": 1, "paragraph": 2, "message": 3, "step": 4, "tool": 5, "start": 9}
_KIND = {v: k for k, v in STRENGTH.items()}
#: Characters a token stands for where a step's tokens aren't known.
CHARS_A_TOKEN = 4

_PARAGRAPH = re.compile(r"(?:\r\n?|\n)[ \t]*(?:(?:\r\n?|\n)[ \t]*)+")
_LINE = re.compile(r"\r\n?|\n")


def atoms(tokens: int, texts: list[str], most: int, kind: int) -> list[tuple[int, int]]:
    """A segment of ``tokens`` as (tokens, strength of the boundary before) pairs of at most ``most`` tokens.

    ``texts`` are its messages (excerpts). It is taken apart only as far as it must be:
    at messages, else paragraphs, else lines, else anywhere.
    """
    if tokens <= most:
        return [(tokens, kind)]

    def parts(text: str, level: int) -> list[str]:
        cut = {2: _PARAGRAPH, 1: _LINE}[level]
        ends = [m.end() for m in cut.finditer(text)]
        return [p for p in (text[a:b] for a, b in zip([0, *ends], [*ends, len(text)], strict=True)) if p]

    def apart(units: list[tuple[str, int]], n: int, level: int) -> list[tuple[int, int]]:
        """Units (text, strength before) that together have n tokens, by their share of the characters."""
        chars = np.array([max(1, len(t)) for t, _ in units], float)
        edges = np.round(np.cumsum(chars) / chars.sum() * n).astype(int)
        out: list[tuple[int, int]] = []
        for (text, strength), end, begin in zip(units, edges.tolist(), [0, *edges.tolist()[:-1]], strict=True):
            size = end - begin
            if size <= 0:
                continue
            finer = parts(text, level) if size > most and level else []
            if size <= most:
                out.append((size, strength))
            elif len(finer) > 1:
                out += apart([(p, level if i else strength) for i, p in enumerate(finer)], size, level - 1)
            elif level > 1:
                out += apart([(text, strength)], size, level - 1)
            else:
                out += [(min(most, size - a), 0 if a else strength) for a in range(0, size, most)]
        return out

    units = [(t, STRENGTH["message"] if i else kind) for i, t in enumerate(t for t in texts if t)]
    return apart(units or [("", kind)], tokens, 2)


def merge(sizes: list[int], strengths: list[int], most: int) -> list[tuple[int, int]]:
    """Merge adjacent segments, weakest boundary first; (first, last) of each piece of at most ``most`` tokens."""
    n = len(sizes)
    size, left, right, alive = list(sizes), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(strengths[i + 1], sizes[i] + sizes[i + 1], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    last = list(range(n))
    while heap:
        strength, both, i, j = heapq.heappop(heap)
        if not (alive[i] and j < n and alive[j] and right[i] == j and size[i] + size[j] == both) or both > most:
            continue
        size[i], alive[j], last[i], right[i] = both, False, last[j], right[j]
        if right[j] < n:
            left[right[j]] = i
            heapq.heappush(heap, (strengths[right[j]], both + size[right[j]], i, right[j]))
        if left[i] >= 0:
            heapq.heappush(heap, (strengths[i], size[left[i]] + both, left[i], i))
    return [(i, last[i]) for i in range(n) if alive[i]]


_PIECES = (
    "context_length long, trajectory_id string, node long, start_token long, end_token long, first_step int, last_step int, cut int, "
    "is_first boolean, is_last boolean, tool_in string, tool_out string, sizes array<int>, strengths array<int>, owners array<int>"
)
_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
_ARROW = pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in _PIECES.split(", ")])


def _segments(parts: list[dict], most: int) -> tuple[list[int], list[int], list[int]]:
    """Tokens, strength of the boundary before, and step of each atomic segment of a chunk, in order of the steps."""
    sizes: list[int] = []
    strengths: list[int] = []
    owners: list[int] = []
    tool = None
    for part in parts:
        step, n = part["step_idx"], part["n"]
        kind = STRENGTH["step" if part["tool"] == tool and step >= 0 else "tool"]
        tool = part["tool"]
        if n > 0:
            for size, strength in atoms(n, [t for t in part["texts"] or [] if t], most, kind):
                sizes.append(size)
                strengths.append(strength)
                owners.append(step)  # the prompt, -1, comes first
    return sizes, strengths, owners


def _pieces(sizes: list[int], strengths: list[int], owners: list[int], base: int, most: int, edges: bool) -> list[dict]:
    """The pieces of consecutive segments that begin at token ``base``; with ``edges`` the first and last keep their segments."""
    ends, total = [], base
    for size in sizes:
        total += size
        ends.append(total)
    out = []
    for a, b in merge(sizes, strengths, most):
        steps = [s for s in (owners[a], owners[min(a + 1, b)], owners[b]) if s >= 0]
        piece = {"start_token": ends[a] - sizes[a], "end_token": ends[b], "first_step": min(steps, default=None), "last_step": max(steps, default=None), "cut": strengths[a]}
        piece |= {"is_first": a == 0, "is_last": b == len(sizes) - 1}
        if edges and (piece["is_first"] or piece["is_last"]):
            piece |= {"sizes": sizes[a : b + 1], "strengths": strengths[a : b + 1], "owners": owners[a : b + 1]}
        out.append(piece)
    return out


def _joined(pair: list[dict], most: int) -> list[dict]:
    """The pieces of one side or, merged anew, of both sides of an edge."""
    if len(pair) == 1:
        return pair
    left, right = pair
    strengths = list(right["strengths"])
    if strengths[0] == STRENGTH["tool"] and left["tool_out"] == right["tool_in"]:
        strengths[0] = STRENGTH["step"]  # the same tool goes on
    sizes, owners = [*left["sizes"], *right["sizes"]], [*left["owners"], *right["owners"]]
    out = _pieces(sizes, [*left["strengths"], *strengths], owners, left["start_token"], most, True)
    for piece in out:
        piece |= {"is_first": piece["is_first"] and left["is_first"], "is_last": piece["is_last"] and right["is_last"], "tool_in": left["tool_in"], "tool_out": right["tool_out"]}
    return out


def _over_edges(pieces: DataFrame, levels: int, overlaps: dict[int, int]) -> DataFrame:
    """Merge anew what lies at the edges between chunks, in ``levels`` rounds over pairs of neighbours."""
    done = pieces.filter("sizes IS NULL")
    edges = pieces.filter("sizes IS NOT NULL")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for limit, key, node, pair in zip(*(batch.column(c).to_pylist() for c in ("context_length", "trajectory_id", "node", "pair")), strict=True):
                rows += [piece | {"context_length": limit, "trajectory_id": key, "node": node} for piece in _joined(pair, limit - overlaps[limit])]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    columns = [f.name for f in _ARROW]
    for _ in range(levels):
        edges = cut(edges)
        beside = F.when(F.col("node") % 2 == 0, F.col("is_last")).otherwise(F.col("is_first"))
        apart = edges.filter(~beside).withColumn("node", F.floor(F.col("node") / 2))
        pair = F.sort_array(F.collect_list(F.struct("start_token", *[c for c in columns[4:]]))).alias("pair")
        gathered = edges.filter(beside).groupBy("context_length", "trajectory_id", F.floor(F.col("node") / 2).alias("node")).agg(pair)
        edges = apart.select(*columns).unionByName(gathered.mapInArrow(merged, _PIECES))
    return done.unionByName(edges)


def _latest(c: str, by: str = "ingested_at") -> Column:
    return F.max(F.struct(by, c))[c]


def oversized(stats: DataFrame, limit: int) -> DataFrame:
    """``trajectory_id, total_tokens`` of the trajectories longer than ``limit``, by the last length known."""
    rows = stats.select(trajectory_key("trajectory_id").alias("trajectory_id"), "ingested_at", F.col("total_tokens").cast("long").alias("total_tokens"))
    return rows.filter("trajectory_id IS NOT NULL AND total_tokens IS NOT NULL").groupBy("trajectory_id").agg(_latest("total_tokens").alias("total_tokens")).filter(F.col("total_tokens") > limit)


def split(stats: DataFrame, steps: DataFrame, trajectories: DataFrame, limit: int, overlap: int) -> DataFrame:
    """``split_all`` for one limit, without the column context_length."""
    return split_all(stats, steps, trajectories, {limit: overlap}).drop("context_length")


def split_all(stats: DataFrame, steps: DataFrame, trajectories: DataFrame, limits: dict[int, int]) -> DataFrame:
    """Pieces of every trajectory longer than a limit, for each of ``limits`` (limit: overlap), from one reading of the tables.

    Columns: ``context_length`` (the limit), ``trajectory_id, piece,
    start_token, end_token, n_tokens, overlap, first_step, last_step, cut``.  A
    piece spans [start_token, end_token) of the trajectory; all but the first
    begin ``overlap`` tokens early (fewer only if the piece before is shorter
    than that) and none exceeds the limit.  Without the overlaps the pieces
    cover every token once.  ``cut`` is the kind of boundary the piece begins
    at; first_step is NULL in a piece of the prompt.

    Tokens that the steps don't account for are the prompt's.  A step without
    token count is taken to have a quarter of its characters; should the steps
    add up to more than the total, their sum is the length.  A trajectory
    without steps is its prompt.  Empty tables and no limits give no rows.
    """
    if any(not 0 <= overlap < limit for limit, overlap in limits.items()):
        raise ValueError("the overlap must be smaller than the limit")
    least = min((limit - overlap for limit, overlap in limits.items()), default=1)
    big = oversized(stats, min(limits, default=0))
    chars = F.coalesce(F.length("action_text"), F.lit(0)) + F.coalesce(F.length("obs_text"), F.lit(0))
    n = F.when(F.col("n_tokens").isNotNull(), F.greatest(F.col("n_tokens").cast("long"), F.lit(0))).otherwise(F.ceil(chars / F.lit(CHARS_A_TOKEN))).cast("long")
    rows = (
        steps.filter("step_idx IS NOT NULL")
        .select(
            trajectory_key("trajectory_id").alias("trajectory_id"),
            F.col("step_idx").cast("int").alias("step_idx"),
            F.struct(
                F.col("n_tokens").isNotNull().alias("known"),
                "ingested_at",
                n.alias("n"),
                F.lower(F.trim("tool")).alias("tool"),
                # The text travels only where a step must be taken apart.
                F.when(n > least, F.col("action_text")).alias("action_text"),
                F.when(n > least, F.col("obs_text")).alias("obs_text"),
            ).alias("s"),
        )
        .join(big.select("trajectory_id"), "trajectory_id", "left_semi")
        .groupBy("trajectory_id", "step_idx")
        .agg(F.max("s").alias("s"))
        .select("trajectory_id", "step_idx", F.floor(F.col("step_idx") / CHUNK).alias("chunk"), "s.n", "s.tool", F.array("s.action_text", "s.obs_text").alias("texts"))
    )
    sums = rows.groupBy("trajectory_id", "chunk").agg(F.sum("n").alias("n"))
    known = sums.groupBy("trajectory_id").agg(F.sum("n").alias("known"))
    prompt = big.join(known, "trajectory_id", "left").select("trajectory_id", "total_tokens", F.greatest(F.lit(0), F.col("total_tokens") - F.coalesce("known", F.lit(0))).alias("n"))
    # Messages before the first action, for prompts that are too long themselves.
    first = F.filter("trajectory", lambda m: F.size(F.coalesce(m["tool_calls"], F.array())) > 0)
    opening = F.when(F.size(first) > 0, F.slice("trajectory", 1, F.greatest(F.lit(1), F.array_position(F.col("trajectory"), F.element_at(first, 1)).cast("int") - 1))).otherwise(F.col("trajectory"))
    texts = (
        trajectories.select(trajectory_key("trajectory_id").alias("trajectory_id"), F.transform(opening, lambda m: m["content"]).alias("texts"))
        .join(prompt.filter(F.col("n") > least), "trajectory_id", "left_semi")
        .groupBy("trajectory_id")
        .agg(F.max("texts").alias("texts"))
    )
    prompts = prompt.join(texts, "trajectory_id", "left").select("trajectory_id", F.lit(-1).alias("step_idx"), F.lit(-1).cast("long").alias("chunk"), "n", F.lit(None).cast("string").alias("tool"), "texts")
    # Where each chunk begins: the prompt, then the chunks before it.
    whole = Window.partitionBy("trajectory_id")
    before = (
        sums.unionByName(prompt.select("trajectory_id", F.lit(-1).cast("long").alias("chunk"), "n", "total_tokens"), allowMissingColumns=True)
        .withColumn("base", F.sum("n").over(whole.orderBy("chunk")) - F.col("n"))
        .withColumns({"total_tokens": F.max("total_tokens").over(whole), "last_chunk": F.max("chunk").over(whole)})
        .drop("n")
    )
    # A prompt is handled with the first chunk of steps, if there is one.
    home = lambda df: df.withColumn("chunk", F.greatest("chunk", F.lit(0).cast("long")))
    bases = home(before).groupBy("trajectory_id", "chunk").agg(F.min("base").alias("base"), F.max("total_tokens").alias("total_tokens"), F.max("last_chunk").alias("last_chunk"))
    segments = home(rows.unionByName(prompts)).join(bases, ["trajectory_id", "chunk"])

    gathered = segments.groupBy("trajectory_id", "chunk").agg(
        F.first("base").alias("base"), F.first("total_tokens").alias("total_tokens"), F.first("last_chunk").alias("last_chunk"), F.sort_array(F.collect_list(F.struct("step_idx", "n", "tool", "texts"))).alias("segments")
    )

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for key, chunk, base, total, last, parts in zip(*(batch.column(c).to_pylist() for c in ("trajectory_id", "chunk", "base", "total_tokens", "last_chunk", "segments")), strict=True):
                own = {"trajectory_id": key, "node": chunk}
                if last > 0:
                    own |= {"tool_in": parts[0]["tool"], "tool_out": parts[-1]["tool"]}
                for limit, overlap in limits.items():
                    if total > limit:
                        out += [own | {"context_length": limit} | piece for piece in _pieces(*_segments(parts, limit - overlap), base, limit - overlap, last > 0)]
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    pieces = gathered.mapInArrow(apart, _PIECES)
    top = steps.agg(F.max(F.col("step_idx").cast("int"))).first()[0] or 0
    if top >= CHUNK:
        pieces = _over_edges(pieces, (top // CHUNK).bit_length(), limits)
    order = Window.partitionBy("context_length", "trajectory_id").orderBy("start_token")
    size = F.col("end_token") - F.col("start_token")
    spare = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair)) if limits else F.lit(None)
    kind = F.element_at(F.array(*(F.lit(_KIND[k].replace("tool", "step")) for k in range(max(_KIND) + 1) if k in _KIND and k < 9)), F.col("cut") + 1)
    return (
        pieces.withColumn("piece", F.row_number().over(order) - 1)
        .withColumn("overlap", F.when(F.col("piece") == 0, F.lit(0)).otherwise(F.least(F.lag(size).over(order), spare[F.col("context_length").cast("int")] if limits else F.lit(0))).cast("long"))
        .select(
            F.col("context_length").cast("int").alias("context_length"),
            "trajectory_id",
            "piece",
            (F.col("start_token") - F.col("overlap")).alias("start_token"),
            "end_token",
            (size + F.col("overlap")).alias("n_tokens"),
            "overlap",
            "first_step",
            "last_step",
            F.when(F.col("piece") == 0, "start").otherwise(kind).alias("cut"),
        )
    )


def report(pieces: DataFrame) -> DataFrame:
    """Cuts by kind, with the pieces' mean and greatest length."""
    return pieces.groupBy("cut").agg(F.count("*").alias("n_pieces"), F.round(F.avg("n_tokens"), 6).alias("mean_tokens"), F.max("n_tokens").alias("most_tokens"))

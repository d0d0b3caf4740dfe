"""Problem 9: mix sources so that each makes up its target share of all tokens.

Method: Sainte-Lague apportionment.  The mixture is a number of blocks of equal
tokens.  Blocks go to sources by the highest quotients of their target shares,
and a source's blocks go to its shards in the same way, by the tokens a shard
holds.  The documents of a shard, one after the other in seeded order, make up
its blocks; its quota is the first of them, again and again up to the source's
number of repeats.  A block's edge moves to the nearest end of a document.

Only per-shard sums reach the driver; a source of any size is spread over as
many shards as its tokens call for.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepforge.functions.ids import source_key
from stepforge.session import cut
from stepforge.sources import spread

#: The public tokenizer whose tokens are counted; STEPFORGE_TOKENIZER in the environment or the argument replaces it.
TOKENIZER = os.environ.get("STEPFORGE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Word pattern of that vocabulary (the published byte-pair encoding of 50,257 ids).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Tokens of a block and, at most about, of a shard.
BLOCK = 4096
SHARD_TOKENS = 2_000_000
MOST_SHARDS = 4096
SEED = "mix-1"

_ENCODINGS: dict[str, object] = {}


def _encoding(path: str) -> object:
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, source (key), text_hash, n_tokens`` of the documents with text and source."""
    rows = spread(documents).select("doc_id", source_key("source").alias("key"), "text").filter("doc_id IS NOT NULL AND key IS NOT NULL AND text IS NOT NULL AND text <> ''")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(tokenizer).encode_ordinary
        for frame in frames:
            n = [len(encode(t)) for t in frame.pop("text")]
            yield frame.assign(n_tokens=n)

    return rows.withColumn("text_hash", F.xxhash64("text")).select("doc_id", "key", "text_hash", "text").mapInPandas(count, "doc_id long, key string, text_hash long, n_tokens long").filter("n_tokens > 0")


def apportion(weights: list[float], seats: int, most: list[int]) -> list[int]:
    """Sainte-Lague: seats to the highest quotients weight / (2 s + 1), none beyond its limit; ties by position."""
    got = [0] * len(weights)
    # Start from just below the exact shares, so that the heap hands out only the last few seats.
    total = sum(weights)
    if total > 0:
        got = [min(m, max(0, int(seats * w / total) - 1)) for w, m in zip(weights, most, strict=True)]
    heap = [(-w / (2 * g + 1), i) for i, (w, g, m) in enumerate(zip(weights, got, most, strict=True)) if w > 0 and g < m]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


def distinct_targets(mix_targets: DataFrame) -> DataFrame:
    """``key, source, target_share, max_repeats``: of targets of one source, however spelled, the least row in that order."""
    row = F.struct("source", "target_share", "max_repeats")
    return mix_targets.withColumn("key", source_key("source")).filter("key IS NOT NULL").groupBy("key").agg(F.min(row).alias("r")).select("key", "r.*")


def targets(mix_targets: DataFrame) -> list[tuple[str, str, float, int]]:
    """(key, source, share, repeats) of the fixed table of targets; shares are scaled to add up to 1."""
    rows = distinct_targets(mix_targets).filter("target_share > 0").orderBy("key").collect()
    total = sum(r.target_share for r in rows) or 1.0
    return [(r.key, r.source, r.target_share / total, max(0, r.max_repeats if r.max_repeats is not None else 1)) for r in rows]


def mix(documents: DataFrame, mix_targets: DataFrame, total_tokens: int | None = None, block: int | None = None, tokenizer: str = TOKENIZER, seed: str = SEED) -> DataFrame:
    """Documents of the mixture: ``doc_id, source, n_tokens, copies``.

    ``total_tokens`` is the size wanted; by default the largest at which every
    source with text can reach its share within its repeats.  If a source
    cannot, it gives all it may and the others keep their shares of the whole:
    what is lacking isn't made up for, and ``shares`` shows it.  Documents
    without text, of no source or of one without target aren't used.  Equal
    texts of a source are one text, under its lowest doc_id, so none is
    repeated more than max_repeats times.  A document is used whole or not at
    all; a shard's last one is taken if most of it still fits.
    """
    spark = documents.sparkSession
    wanted = targets(mix_targets)
    schema = "doc_id long, source string, n_tokens long, copies long"
    if not wanted:
        return spark.createDataFrame([], schema)
    counted = token_counts(documents, tokenizer).join(F.broadcast(spark.createDataFrame([(k,) for k, *_ in wanted], "key string")), "key")
    # The hash decides for equal texts; the sum of tokens tells texts apart that only share it.
    texts = counted.groupBy("key", "text_hash", "n_tokens").agg(F.min("doc_id").alias("doc_id"))
    texts = cut(texts.select("key", "doc_id", "n_tokens").withColumn("h", F.md5(F.concat(F.lit(seed + ":"), F.col("doc_id").cast("string")))))
    held = {r.key: r.n for r in texts.groupBy("key").agg(F.sum("n_tokens").alias("n")).collect()}  # one row a target
    room = [held.get(k, 0) * r for k, _, _, r in wanted]
    size = total_tokens if total_tokens is not None else int(min((x / share for x, (_, _, share, _) in zip(room, wanted, strict=True) if x), default=0))
    # Blocks small enough that rounding shares to them is far below a percent.
    block = block or max(1, min(BLOCK, size // 20_000 or 1))
    seats = size // block
    quota = [min(q, x // block) for q, x in zip(apportion([share for _, _, share, _ in wanted], seats, [seats] * len(wanted)), room, strict=True)]
    shards = {k: max(1, min(MOST_SHARDS, -(-held.get(k, 0) // SHARD_TOKENS))) for k, *_ in wanted}
    n_shards = F.broadcast(spark.createDataFrame(list(shards.items()), "key string, shards int"))
    placed = texts.join(n_shards, "key").withColumn("shard", F.pmod(F.xxhash64("h"), F.col("shards")).cast("int"))
    by_shard: dict[str, list[tuple[int, int]]] = {}
    for r in placed.groupBy("key", "shard").agg(F.sum("n_tokens").alias("n")).collect():  # at most MOST_SHARDS a target
        by_shard.setdefault(r.key, []).append((r.shard, r.n))
    plan = []
    for (key, source, _, repeats), blocks in zip(wanted, quota, strict=True):
        parts = sorted(by_shard.get(key, []))
        seats = apportion([float(n) for _, n in parts], blocks, [-(-n * repeats // block) for _, n in parts])
        # A last block that reaches into the next pass would exceed the repeats.
        plan += [(key, source, s, n, min(b * block, n * repeats), repeats) for (s, n), b in zip(parts, seats, strict=True)]
    plan_df = F.broadcast(spark.createDataFrame(plan, "key string, source string, shard int, held long, quota long, repeats long"))
    before = F.sum("n_tokens").over(Window.partitionBy("key", "shard").orderBy("h", "doc_id")) - F.col("n_tokens")
    passes = F.floor(F.col("quota") / F.col("held"))
    rest = F.col("quota") - passes * F.col("held")
    copies = F.least(F.col("repeats"), passes + ((before + F.col("n_tokens") / 2 <= rest) & (rest > 0)).cast("long"))
    return placed.join(plan_df, ["key", "shard"]).withColumn("copies", copies).filter("copies > 0").select("doc_id", "source", "n_tokens", F.col("copies").cast("long").alias("copies"))


def shares(mixed: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """Per source: target and actual share of the tokens and how far they are apart, tokens, documents and the most copies of one."""
    by = mixed.groupBy(source_key("source").alias("key")).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("n_documents"), F.max("copies").alias("most_copies"))
    total = F.sum("tokens").over(Window.partitionBy())  # one row a target
    share = F.coalesce(F.col("tokens") / total, F.lit(0.0))
    return distinct_targets(mix_targets).join(by, "key", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.round(share, 6).alias("share"), F.round(share - F.col("target_share"), 6).alias("off_target")
    )

"""Problem 6: train, validation and test splits that keep related rows together.

Method: min-cost flow allocation.  Rows that share an entity are one
component.  Components of the same size and label profile form a bundle.  A
min-cost flow sends the rows of the largest components, each a node, and of
all bundles of a profile through (profile, split) quotas to split quotas, where
exceeding a quota costs, and is rounded to whole components.  With those
placed, every split gets its whole share of every bundle, and what is left over
is distributed by a second flow and rounded likewise.  Members of a bundle are
assigned by the hash of their entity, so nothing depends on the order of rows.

The driver sees counts of bundles (there are at most as many different sizes
as the root of twice the rows) and the components of one percent of the rows
or more, never the components of all rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepforge.functions.ids import instance_key, repo_key, repo_of_instance, trajectory_key

SPLITS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))
#: A component of this share of all rows or more is a node of its own in the flow.
LARGE = 0.01
#: Members of a bundle that are numbered in one task.
PART = 50_000


def entity(by: str) -> Column:
    """The canonical entity of a row: its ``repo`` (else that of its instance) or its ``instance``.

    A row without either is its own entity, named by its trajectory.
    """
    repo = F.coalesce(repo_key("repo"), repo_of_instance("instance_id"))
    own = F.concat(F.lit("trajectory:"), F.coalesce(trajectory_key("trajectory_id"), F.lit("")))
    if by == "repo":
        return F.coalesce(repo, own)
    if by == "instance":
        return F.coalesce(instance_key("instance_id"), own)
    raise ValueError("by is repo or instance")


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each (from, to, capacity, cost) arc of a maximum flow of least cost (successive shortest paths)."""
    to, room, cost, out = [], [], [], [[] for _ in range(n)]
    for a, b, c, w in arcs:
        out[a].append(len(to))
        to.append(b), room.append(c), cost.append(w)
        out[b].append(len(to))
        to.append(a), room.append(0), cost.append(-w)
    while True:
        far: list[float] = [math.inf] * n
        far[source], via, queue, queued = 0, [-1] * n, [source], [False] * n
        while queue:
            a = queue.pop(0)
            queued[a] = False
            for e in out[a]:
                if room[e] > 0 and far[a] + cost[e] < far[to[e]]:
                    far[to[e]], via[to[e]] = far[a] + cost[e], e
                    if not queued[to[e]]:
                        queued[to[e]] = True
                        queue.append(to[e])
        if far[sink] == math.inf:
            return [room[2 * i + 1] for i in range(len(arcs))]
        push, b = math.inf, sink
        while b != source:
            push, b = min(push, room[via[b]]), to[via[b] ^ 1]
        b = sink
        while b != source:
            room[via[b]] -= push
            room[via[b] ^ 1] += push
            b = to[via[b] ^ 1]


def allocate(bundles: dict[tuple[int, int], tuple[int, int]], large: list[tuple[str, int, int]], shares: list[float]) -> tuple[dict[tuple[int, int], list[int]], dict[str, int]]:
    """Components of each bundle per split, and the split of each large component.

    ``bundles``: (size class, profile) -> (components, rows); ``large``: (entity, rows, profile).
    """
    k_all = range(len(shares))
    exact = [Fraction(s).limit_denominator(10_000) for s in shares]
    total = sum(r for _, r in bundles.values()) + sum(r for _, r, _ in large)
    by_profile: dict[int, int] = defaultdict(int)
    for (_, g), (_, r) in bundles.items():
        by_profile[g] += r
    for _, r, g in large:
        by_profile[g] += r
    need = [total * float(s) for s in exact]
    need_g = {g: [r * float(s) for s in exact] for g, r in by_profile.items()}

    def take(k: int, g: int, rows: float) -> None:
        need[k] -= rows
        need_g[g][k] -= rows

    def quotas(supplies: list[tuple[int, int]]) -> list[list[int]]:
        """Rows that a min-cost flow sends from each (rows, profile) to every split."""
        profiles = sorted({g for _, g in supplies})
        at_gk = lambda g, k: 2 + len(supplies) + profiles.index(g) * len(shares) + k
        at_k = lambda k: 2 + len(supplies) + len(profiles) * len(shares) + k
        everything = sum(rows for rows, _ in supplies) + 1
        arcs: list[tuple[int, int, int, int]] = []
        sent = []
        for i, (rows, g) in enumerate(supplies):
            arcs.append((0, 2 + i, rows, 0))
            sent.append(range(len(arcs), len(arcs) + len(shares)))
            arcs += [(2 + i, at_gk(g, k), everything, 0) for k in k_all]
        for g in profiles:
            for k in k_all:
                arcs += [(at_gk(g, k), at_k(k), max(0, round(need_g[g][k])), 0), (at_gk(g, k), at_k(k), everything, 1)]
        for k in k_all:
            arcs += [(at_k(k), 1, max(0, round(need[k])), 0), (at_k(k), 1, everything, 10)]
        flow = min_cost_flow(2 + len(supplies) + len(profiles) * len(shares) + len(shares), arcs, 0, 1)
        return [[flow[e] for e in of] for of in sent]

    # Components that are nodes of their own, with the rows of all bundles of a profile beside them.
    placed: dict[str, int] = {}
    large = sorted(large, key=lambda x: (-x[1], x[0]))
    mass: dict[int, int] = defaultdict(int)
    for (_, g), (_, r) in bundles.items():
        mass[g] += r
    sent = quotas([(rows, g) for _, rows, g in large] + sorted((r, g) for g, r in mass.items()))
    for (name, rows, g), flow in zip(large, sent, strict=False):
        k = max(k_all, key=lambda k: (min(flow[k], max(0.0, need[k])), need[k], need_g[g][k]))
        placed[name] = k
        take(k, g, rows)
    # Whole shares. Large components may have used up a split's quota; the others then divide what is left.
    open_share = [max(0.0, x) for x in need]
    scale = sum(open_share) or 1.0
    rest_shares = [Fraction(x / scale).limit_denominator(10_000) for x in open_share]
    counts, left = {}, []
    for (c, g), (n, rows) in sorted(bundles.items()):
        counts[c, g] = [math.floor(n * s) for s in rest_shares]
        for k in k_all:
            take(k, g, counts[c, g][k] * rows / n)
        left += [(rows // n, c, g)] * (n - sum(counts[c, g]))
    # The rest by flow: size classes (powers of 1.5) of a profile.
    klass = lambda size: int(math.log(max(size, 1), 1.5))
    supply: dict[tuple[int, int], int] = defaultdict(int)
    for s, _, g in left:
        supply[klass(s), g] += s
    wanted = {(*key, k): float(x) for key, flow in zip(sorted(supply), quotas([(supply[key], key[1]) for key in sorted(supply)]), strict=True) for k, x in enumerate(flow)}
    # Integral rounding, the largest first: a component goes where most of its class's flow is still to go.
    for size, c, g in sorted(left, reverse=True):
        k = max(k_all, key=lambda k: (wanted[klass(size), g, k], need[k]))
        wanted[klass(size), g, k] -= size
        counts[c, g][k] += 1
        take(k, g, size)
    return counts, placed


def assign(stats: DataFrame, by: str = "repo", splits: tuple[tuple[str, float], ...] = SPLITS) -> DataFrame:
    """Every row of ``stats`` with its ``entity`` and ``split``; the columns ``trajectory_id, entity, split``.

    Rows delivered twice are rows.  All rows of an entity, however written, get
    the same split.  The proportions refer to rows; an entity larger than any
    split's quota goes to the split that has most room.  No row is dropped.
    """
    if abs(sum(s for _, s in splits) - 1) > 1e-9 or any(s < 0 for _, s in splits):
        raise ValueError("proportions must be non-negative and add up to 1")
    spark = stats.sparkSession
    rows = stats.select("trajectory_id", entity(by).alias("entity"), (F.coalesce(F.col("resolved").cast("int"), F.lit(0)) == 1).alias("resolved"))
    h = F.md5(F.concat(F.lit("split:"), "entity"))
    components = (
        rows.groupBy("entity")
        .agg(F.count("*").alias("n"), F.avg(F.col("resolved").cast("int")).alias("r"))
        .select("entity", F.col("n").alias("size"), F.least(F.floor(F.col("r") * 3), F.lit(2)).cast("long").alias("profile"), h.alias("h"))
    )
    total = rows.count()
    least = max(1, math.ceil(total * LARGE))
    large = [(r.entity, r["size"], r.profile) for r in components.filter(F.col("size") >= least).select("entity", "size", "profile").collect()]  # at most 1 / LARGE
    small = components.filter(F.col("size") < least)
    bundles = {(x["size"], x.profile): (x.c, x.c * x["size"]) for x in small.groupBy("size", "profile").agg(F.count("*").alias("c")).collect()}
    # Hash parts in which the members of a bundle are numbered: as many as its members call for.
    parts = spark.createDataFrame([(size, g, -(-c // PART)) for (size, g), (c, _) in bundles.items()], "size long, profile long, parts long")
    small = small.join(parts, ["size", "profile"]).withColumn("part", F.pmod(F.xxhash64("entity"), F.col("parts")))
    counted = small.groupBy("size", "profile", "part").agg(F.count("*").alias("c")).collect()
    counts, placed = allocate(bundles, large, [s for _, s in splits])
    # Rank at which each hash part of a bundle begins, and the ranks at which splits end.
    table, at = [], dict.fromkeys(bundles, 0)
    for x in sorted(counted, key=lambda x: (x["size"], x.profile, x.part)):
        b = (x["size"], x.profile)
        ends, e = [], 0
        for n in counts[b]:
            e += n
            ends.append(e)
        table.append((x["size"], x.profile, x.part, at[b], ends))
        at[b] += x.c
    where = spark.createDataFrame(table, "size long, profile long, part long, begin long, ends array<long>")
    rank = F.row_number().over(Window.partitionBy("size", "profile", "part").orderBy("h", "entity")) - 1 + F.col("begin")
    names = F.array(*(F.lit(name) for name, _ in splits))
    chosen = (
        small.join(where, ["size", "profile", "part"])
        .withColumn("k", rank)
        .select("entity", F.element_at(names, (F.size(F.filter("ends", lambda e: e <= F.col("k"))) + 1).cast("int")).alias("split"))
    )
    chosen = chosen.unionByName(spark.createDataFrame([(name, splits[k][0]) for name, k in placed.items()], "entity string, split string"))
    return rows.join(chosen, "entity").select("trajectory_id", "entity", "split")


def report(assigned: DataFrame, splits: tuple[tuple[str, float], ...] = SPLITS) -> DataFrame:
    """Per split: rows, entities, the share reached and the one asked for."""
    targets = assigned.sparkSession.createDataFrame(list(splits), "split string, target double")
    by = assigned.groupBy("split", "entity").agg(F.count("*").alias("n")).groupBy("split").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_entities"))
    total = F.sum("n_rows").over(Window.partitionBy())  # one row a split
    return targets.join(by, "split", "left").select("split", "target", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_entities", F.lit(0)).alias("n_entities"), F.round(F.coalesce(F.col("n_rows") / total, F.lit(0.0)), 6).alias("share"))

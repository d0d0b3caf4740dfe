"""Problem 3: cap the records of dominant contributors, keeping the best.

Method: rank within contributor by quality and identifier and keep the ranks
below the cap.  A contributor that holds a large part of all rows is ranked in
salted parts first: a row beyond the cap in its part is beyond it altogether.
Of what is left, levels of quality are counted per contributor; whole levels
above the one in which the cap falls are kept.  That level, which may be large
where scores tie or are missing, is counted again by the leading digits of the
identifier's hash, within the exact quality; only the one small range in which
the cap falls then is ranked.  No task sorts a contributor or a level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepforge.functions.ids import repo_key, repo_of_instance, trajectory_key
from stepforge.session import cut

#: Parts in which a contributor is pre-ranked.
SALTS = 64
#: Quality levels counted per contributor.
LEVELS = 4096
#: Hexadecimal digits of the identifier's hash by which rows of one quality are counted.
HASH_DIGITS = 4


def rank_hash(c: Column) -> Column:
    """Ties in quality are ordered by the md5 of the identifier, then the identifier."""
    return F.md5(c)


def capped(rows: DataFrame, contributor: str, quality: str, identifier: str, cap: Column) -> DataFrame:
    """``rows`` limited to the best ``cap`` per contributor.

    Best is the highest quality (NULL and NaN last), then the lowest md5 of the
    identifier, then the lowest identifier.  ``cap`` is an expression of the
    contributor (or a literal).  A NULL contributor is nobody's: such rows are
    all kept.  Exactly repeated (contributor, quality, identifier) rows each
    take a place, in any order, since they are equal.
    """
    q = F.when(F.isnan(F.col(quality).cast("double")), None).otherwise(F.col(quality).cast("double"))
    kept_columns = rows.columns
    r = rows.withColumns({"__q": q, "__h": rank_hash(F.col(identifier).cast("string")), "__i": F.col(identifier).cast("string"), "__cap": cap, "__c": F.col(contributor)})
    owned = r.filter("__c IS NOT NULL")
    order = [F.desc_nulls_last("__q"), F.asc_nulls_last("__h"), F.asc_nulls_last("__i")]

    # 1. Salted pre-ranking: exact, and nothing larger than a contributor's share of one salt is sorted.
    part = Window.partitionBy("__c", "__s").orderBy(*order)
    pre = owned.withColumn("__s", F.pmod(F.xxhash64("__i", "__q"), F.lit(SALTS))).withColumn("__r", F.row_number().over(part)).filter("__r <= __cap")

    # 2. Levels of quality: sums over level counts find where the cap falls.
    unit = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("__q")))
    level = F.when(F.col("__q").isNull(), F.lit(LEVELS + 1)).otherwise(F.lit(LEVELS) - F.floor(unit * F.lit(float(LEVELS)))).cast("long")
    whole, cut_level = _above(pre.withColumns({"__l": level, "__left": F.col("__cap").cast("long")}), ["__l"])
    # 3. The level in which the cap falls, by its exact qualities, then by the hash's leading digits.
    more, cut_quality = _above(cut(cut_level).withColumn("__o", F.coalesce(-F.col("__q"), F.lit(float("inf")))), ["__o"])
    tied = cut_quality.withColumn("__d", F.coalesce(F.substring("__h", 1, HASH_DIGITS), F.lit("~")))
    most, rest = _above(tied, ["__d"])
    final = rest.withColumn("__r", F.row_number().over(Window.partitionBy("__c").orderBy(*order))).filter("__r <= __left")
    kept = [d.select(*kept_columns) for d in (whole, more, most, final, r.filter("__c IS NULL"))]
    return reduce(DataFrame.unionByName, kept)


def _above(rows: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows whose whole level ``by`` is within the places left, and those of the level in which the places end.

    ``__left`` is the number of places of the contributor ``__c``; in the second
    part it is what the levels before leave.  Only counts by level are ordered.
    """
    counts = rows.groupBy("__c", *by).agg(F.count("*").alias("__n"), F.first("__left").alias("__places"))
    upto = F.sum("__n").over(Window.partitionBy("__c").orderBy(*by))
    ends = counts.withColumn("__upto", upto).withColumns({"__all": F.col("__upto") <= F.col("__places"), "__rest": F.col("__places") - (F.col("__upto") - F.col("__n"))})
    ends = ends.filter("__rest > 0").select("__c", *by, "__all", "__rest")
    placed = rows.join(ends, ["__c", *by]).withColumn("__left", F.col("__rest")).drop("__rest")
    return placed.filter("__all").drop("__all", *by), placed.filter("NOT __all").drop("__all", *by)


def contributions(stats: DataFrame, scored: DataFrame) -> DataFrame:
    """One row per trajectory of ``stats``: ``trajectory_id, repo, composite_score``.

    Of rows delivered or scored twice the last counts (ties: the greatest
    value).  The repository is the canonical one, else that of the instance,
    else NULL.  Trajectories without score have composite_score NULL and rank last.
    """
    last = (
        stats.select(trajectory_key("trajectory_id").alias("trajectory_id"), F.coalesce(repo_key("repo"), repo_of_instance("instance_id")).alias("repo"), "ingested_at")
        .filter("trajectory_id IS NOT NULL")
        .groupBy("trajectory_id")
        .agg(F.max(F.struct("ingested_at", "repo"))["repo"].alias("repo"))
    )
    best = (
        scored.select(trajectory_key("trajectory_id").alias("trajectory_id"), "scored_at", F.nanvl(F.col("composite_score"), F.lit(None).cast("double")).alias("composite_score"))
        .filter("trajectory_id IS NOT NULL")
        .groupBy("trajectory_id")
        .agg(F.max(F.struct("scored_at", "composite_score"))["composite_score"].alias("composite_score"))
    )
    return last.join(best, "trajectory_id", "left")


def cap_count(rows: DataFrame, count: int) -> DataFrame:
    """At most ``count`` trajectories a repository."""
    return capped(rows, "repo", "composite_score", "trajectory_id", F.lit(count))


def cap_share(rows: DataFrame, share: float) -> DataFrame:
    """At most ``share`` of all trajectories (of any repository or none) a repository, one at least."""
    total = rows.agg(F.greatest(F.lit(1), F.floor(F.count("*") * F.lit(share) + F.lit(1e-9))).cast("long").alias("__total"))
    limited = capped(rows.crossJoin(F.broadcast(total)), "repo", "composite_score", "trajectory_id", F.col("__total"))
    return limited.drop("__total")


def report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per repository: trajectories before and after, and the lowest score kept."""
    a = before.groupBy("repo").agg(F.count("*").alias("n_before"))
    b = after.groupBy("repo").agg(F.count("*").alias("n"), F.round(F.min("composite_score"), 6).alias("lowest_kept"))
    return a.join(b, a.repo.eqNullSafe(b.repo), "left").select(a.repo, "n_before", F.coalesce("n", F.lit(0)).alias("n_after"), "lowest_kept")

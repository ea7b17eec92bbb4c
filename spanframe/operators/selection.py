"""Seeded selections that any engine repeats: ranks come from SHA-256 of a seed and an id.

Strata are few and stand in an order; the loop runs over them, never over rows. What a stratum takes is stored, since the next one
depends on it, and a stratum that falls short is an error.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hash_draw
from ..shared import stored


def _draw(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts]), 256)


def split_total(total: int, share: float) -> tuple[int, int]:
    """total as a share, rounded half to even, and the rest."""
    if not 0 <= share <= 1 or total <= 0:
        raise ValueError("a positive total and a share from 0 to 1 are needed")
    return round(total * share), total - round(total * share)


def _taken(rows: DataFrame, name: str, target: int) -> DataFrame:
    took = stored(rows, "stratum")
    if (n := took.count()) < target:
        raise ValueError(f"only {n} of {target} rows are there for the stratum {name}")
    return took


def stratified_select(rows: DataFrame, strata: Sequence[tuple[str, Column, int]], *, seed: str, ident: str, group: str) -> DataFrame:
    """(ident, group, stratum): for each stratum (name, rule, n) in order, n groups by hash, and of each the first row by hash.

    A group is taken once over all strata. Groups are ranked alike in every stratum and rows apart from them, so a group of many
    rows has no better chance. Fewer groups than n raise ValueError."""
    chosen, used = None, None
    for name, rule, n in strata:
        pool = rows.where(rule).where(F.col(group).isNotNull())
        pool = pool if used is None else pool.join(used, group, "left_anti")
        of_row = F.struct(_draw(seed, "video", F.col(ident).cast("string")).alias("d"), F.col(ident).alias("id"))
        first = pool.groupBy(group).agg(F.min(of_row).alias("m"), F.min(_draw(seed, "prompt", F.col(group).cast("string"))).alias("rank"))
        take = _taken(first.orderBy("rank", group).limit(n).select(F.col("m.id").alias(ident), group, F.lit(name).alias("stratum")), name, n)
        chosen = take if chosen is None else chosen.unionByName(take)
        used = chosen.select(group).distinct()
    return chosen


def capped_select(rows: DataFrame, strata: Sequence[tuple[str, Column, int]], *, cap: int, seed: str, ident: str, subject: str) -> DataFrame:
    """(rows, stratum, place): for each stratum (name, rule, n) in order, the first n rows by hash whose subject has been taken
    less than cap times, in this stratum or an earlier one. Rows that are passed over use up nothing; a null subject is one too.
    Fewer rows than n raise ValueError.

    In a stratum, the first rows of a subject are eligible, as many as its cap leaves; all of them before the last one taken are
    taken, which is what a greedy walk through the hashes does."""
    if cap <= 0:
        raise ValueError("the cap must be positive")
    chosen = used = None
    for name, rule, n in strata:
        if n == 0:
            continue
        pool = rows.where(rule).withColumn("__d", _draw(seed, F.col(ident).cast("string")))
        pool = pool.withColumn("__s", F.row_number().over(Window.partitionBy(subject).orderBy("__d", ident)))
        room = F.lit(cap)
        if used is not None:
            pool = pool.join(used, F.col(subject).eqNullSafe(F.col("__subject")), "left").drop("__subject")
            room = F.lit(cap) - F.coalesce("__used", F.lit(0))
        take = pool.where(F.col("__s") <= room).orderBy("__d", ident).limit(n).select(*rows.columns, "__d", F.lit(name).alias("stratum"))
        take = _taken(take, name, n)
        chosen = take if chosen is None else chosen.unionByName(take)
        used = chosen.groupBy(F.col(subject).alias("__subject")).agg(F.count("*").alias("__used"))
    if chosen is None:
        return rows.limit(0).withColumn("stratum", F.lit("")).withColumn("place", F.lit(0))
    return chosen.withColumn("place", F.row_number().over(Window.partitionBy("stratum").orderBy("__d", ident))).drop("__d")


def audit_sample(rows: DataFrame, targeted: Mapping[str, Column], *, share: float, least: int, seed: str, ident: str) -> DataFrame:
    """rows with selection (the first reason of targeted that holds, else random_audit or complement), batch and review_id.

    Batch 1 holds the targeted rows and an audit of max(least, round(share n)) of the n others by hash, at most all; batch 2 the rest.
    Within a batch the order is by another hash, so that a place tells nothing; review ids (R001 ..) count through both."""
    reason = F.coalesce(*[F.when(c, F.lit(n)) for n, c in targeted.items()])
    rows = rows.withColumn("__reason", reason).withColumn("__d", _draw(seed, F.col(ident).cast("string")))
    n = rows.where("__reason is null").agg(F.greatest(F.lit(least), F.bround(share * F.count("*")).cast("bigint")).alias("m")).first()["m"]
    audit = stored(rows.where("__reason is null").orderBy("__d", ident).limit(int(n)).select(ident, F.lit("random_audit").alias("__audit")), "audit")
    out = rows.join(audit, ident, "left").withColumn("selection", F.coalesce("__reason", "__audit", F.lit("complement")))
    out = out.withColumn("batch", F.when(F.col("selection") == "complement", 2).otherwise(1)).withColumn("__o", _draw(seed, "order", F.col(ident).cast("string")))
    return _numbered(stored(out.drop("__reason", "__audit", "__d"), "audited"), ["batch", "__o", ident]).drop("__o")


def _numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows with review_id by a total order: ranges are numbered apart, and only their sizes meet."""
    parts = stored(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = parts.groupBy("__range").agg(F.count("*").alias("n")).select("__range", ahead.alias("__before"))
    place = F.col("__before") + F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    digits = F.greatest(F.lit(3), F.length(place.cast("string")))
    return parts.join(sizes, "__range").withColumn("review_id", F.concat(F.lit("R"), F.lpad(place.cast("string"), digits, "0"))).drop("__range", "__before")


def review_sheet(audited: DataFrame, shown: Sequence[str]) -> DataFrame:
    """What a reviewer sees: review_id, batch and the columns in shown, which must not tell a prediction."""
    return audited.select("review_id", "batch", *shown)


def review_key(audited: DataFrame, ident: str, *more: str) -> DataFrame:
    """What is opened after the review: review_id, the item, batch, selection."""
    return audited.select("review_id", ident, "batch", "selection", *more)


def comparison_sample(rows: DataFrame, target: Sequence[str], *, most: int, seed: str, ident: str, category: str = "category") -> DataFrame:
    """All rows of target categories, and up to most of every other by hash."""
    rank = F.row_number().over(Window.partitionBy(category).orderBy(hash_draw(F.lit(seed), F.col(ident).cast("string")), ident))
    wanted = F.col(category).isin(list(target))
    return rows.withColumn("__n", rank).where(wanted | (F.col("__n") <= most)).drop("__n")


def select_members(members: DataFrame, annotated: DataFrame, scope: str, *, ident: str = "item_id", level: str = "level", at: int = 2) -> DataFrame:
    """Members in scope: all; annotated (those that annotated names); or level (those whose highest level there is at)."""
    if scope == "all":
        return members
    if scope not in ("annotated", "level"):
        raise ValueError("the scope is all, annotated or level")
    top = annotated.groupBy(ident).agg(F.max(level).alias("__top"))
    return members.join(top if scope == "annotated" else top.where(F.col("__top") == at), ident, "left_semi")

"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Each source gets a token target. Document rates stay as close to 1 as they can (least Kullback-Leibler divergence
sum(rate * log(rate) - rate + 1), with rates bounded by the largest number of copies) while the rates times sizes of a source
sum to its target. The dual has one multiplier for each source, and rates are exponentially tilted by size up to the bound:

    rate(d) = min(cap, exp(lambda(source) * size(d) / mean size(source)))

so lambda 0 means rate 1. Newton steps on the dual run as grouped aggregations over the histogram (source, size), so an
iteration costs the same whether a source has thousands or billions of documents. Rates are then rounded into whole copies
along a cumulative sum by falling size: the words that a source takes differ from its target by at most about half of its
longest document, and one copy of the nearest size settles most of that. All sums are decimals, so reruns agree to the last
row.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._base import running, stored

#: What counts as a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents of one source and size are ranked within so many parts.
PARTS = 256
#: Source tables of up to so many rows are broadcast.
BROADCAST_SOURCES = 20_000


def targets(totals: DataFrame, weights: Sequence[int], share: float, cap: int) -> DataFrame:
    """totals(source, source_size) with one row a source -> sid, source, source_size, target, capped.

    Sources by code point, null last, take the weights in turn. A target stops at cap times the source's size; what is
    above is dealt again by weight until none is above, which is the level c with sum(min(cap * size, c * weight)) = share.
    Sources are numbered and filled along running sums, so any number of them is dealt over the tasks.
    """
    rows = running(totals, [F.col("source").asc_nulls_last()], {}, "sources").withColumnRenamed("row", "sid")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = rows.withColumn("w", w).withColumn("most", F.col("source_size").cast("double") * cap)
    fill = [(F.col("most") / F.col("w")).asc(), F.col("sid").asc()]
    rows = running(rows, fill, {"before": "most", "w_before": "w"}, "filled").drop("row")
    every = rows.agg(F.sum("source_size").cast("double").alias("all"), F.sum("w").alias("w_all")).first()
    total, w_all = F.lit((every["all"] or 0.0) * share), F.lit(every["w_all"] or 0.0)
    rows = stored(rows.withColumn("capped", F.col("most") / F.col("w") * (w_all - F.col("w_before")) <= total - F.col("before")), "targets")
    got = rows.agg(F.sum(F.when(F.col("capped"), F.col("most"))).alias("kept"), F.sum(F.when(~F.col("capped"), F.col("w"))).alias("open")).first()
    level = F.try_divide(total - F.lit(got["kept"] or 0.0), F.lit(got["open"] or 0.0))
    target = F.when(F.col("capped"), F.col("most")).otherwise(F.least(F.col("most"), level * F.col("w")))
    return rows.select("sid", "source", "source_size", target.alias("target"), "capped")


def _rate(lam: Column, size: Column, mean: Column, cap: int) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(lam * size / mean, F.lit(700.0))))


def balance(cells: DataFrame, sources: DataFrame, cap: int) -> DataFrame:
    """Newton on the dual. cells(sid, size, n), sources(sid, source_size, target, capped, mean) -> sources with lam.

    Each step aggregates the cells once. A step that leaves the bracket of the root (the sums grow with lam) is replaced
    by the bracket's middle, so every source converges: the steps go on until each source's rated words are within half a
    word, or a ten-millionth, of its target, or no number is left between the ends of its bracket. Capped and empty sources
    take no part: their rates are cap, or 0 for a target of 0.
    """
    share = F.col("target") / F.col("source_size")  # with every size at least 1, all rates are below it at lo, or at the cap at hi
    low, high = F.when(share < 1, F.col("mean") * F.log(share) - 1).otherwise(-1.0), F.when(share > 1, F.col("mean") * float(log(cap)) + 1).otherwise(1.0)
    state = sources.where("not capped and target > 0").select("sid", "target", "mean", F.lit(0.0).alias("lam"), low.alias("lo"), high.alias("hi"), F.lit(False).alias("done"))
    cells = cells.select("sid", "size", "n")
    small = "decimal(38,6)"
    while True:
        rate = _rate(F.col("lam"), F.col("size"), F.col("mean"), cap)
        mass = F.col("n") * F.col("size")
        slope = F.when(rate < cap, mass * rate * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = cells.join(state.select("sid", "lam", "mean"), "sid").groupBy("sid").agg(F.sum((mass * rate).cast(small)).cast("double").alias("g"), F.sum(slope.cast(small)).cast("double").alias("h"))
        over = F.col("g") - F.col("target")
        state = state.join(sums, "sid").withColumn("lo", F.when(over < 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(over >= 0, F.col("lam")).otherwise(F.col("hi")))
        middle = (F.col("lo") + F.col("hi")) / 2
        met = F.abs(over) <= F.greatest(F.lit(0.5), F.col("target") * 1e-7)
        state = state.withColumn("done", met | (middle <= F.col("lo")) | (middle >= F.col("hi")))
        reach = 4 * (1 + F.abs("lam"))
        step = F.greatest(-reach, F.least(reach, F.coalesce(F.try_divide(-over, F.col("h")), F.when(over < 0, reach).otherwise(-reach))))
        new = F.col("lam") + step
        new = F.when((new <= F.col("lo")) | (new >= F.col("hi")), middle).otherwise(new)
        state = state.select("sid", "target", "mean", F.when(F.col("done"), F.col("lam")).otherwise(new).alias("lam"), "lo", "hi", "done")
        state = stored(state, "duals")
        if not state.where("not done").take(1):
            return sources.join(state.select("sid", "lam"), "sid", "left")


def _round(cells: DataFrame) -> DataFrame:
    """cells(sid, size, n, rate) -> with copies: whole copies of the n documents together, rounded along the cumulative sum
    by falling size. The sum has two levels (blocks of sizes, then sizes), so no source is gathered in one task."""
    cells = cells.withColumn("block", F.floor(F.sqrt("size"))).withColumn("e", (F.col("n") * F.col("rate")).cast("decimal(38,9)"))
    blocks = cells.groupBy("sid", "block").agg(F.sum("e").alias("e_block"))
    above = Window.partitionBy("sid").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("sid", "block", F.coalesce(F.sum("e_block").over(above), F.lit(0)).cast("decimal(38,9)").alias("base"))
    within = Window.partitionBy("sid", "block").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.join(blocks, ["sid", "block"]).withColumn("upto", (F.col("base") + F.sum("e").over(within)).cast("decimal(38,9)"))
    half = F.lit("0.5").cast("decimal(2,1)")
    return cells.select("sid", "size", "n", "rate", (F.floor(F.col("upto") + half) - F.floor(F.col("upto") - F.col("e") + half)).cast("bigint").alias("copies"))


def _settle(whole: DataFrame, sources: DataFrame, cap: int) -> DataFrame:
    """One copy more or less in the cell whose size is nearest to what the rounding left of a source's target."""
    taken = whole.groupBy("sid").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"))
    rest = sources.join(taken, "sid").select("sid", F.round(F.col("target") - F.col("taken")).cast("bigint").alias("rest"))
    room = F.when(F.col("rest") > 0, F.col("copies") < cap * F.col("n")).otherwise(F.col("copies") > 0)
    off = F.abs(F.col("size") - F.abs("rest"))
    best = whole.join(rest, "sid").where(room & (off < F.abs("rest"))).groupBy("sid", "rest").agg(F.min(F.struct(off.alias("off"), "size")).alias("best"))
    best = best.select("sid", F.col("best.size").alias("size"), F.signum("rest").cast("bigint").alias("change"))
    return whole.join(best, ["sid", "size"], "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0))).drop("change")


def mix_sources(docs: DataFrame, *, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rates and whole copies of every document, so that each source's words come near its target.

    Returns a row for each row of docs: <id_col>, source, size (words; 0 for null), source_size, target, rate, copies
    (0 to cap), taken (copies * size), and the columns in keep. A null source is a source of its own, the last. Documents without words take
    nothing. Documents of one source and size share their copies by the hash of their ids, then by keep. Repeated rows,
    different texts of one id and null ids are rows of their own; an empty table gives an empty result. Other columns, of
    whatever names, are not read.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), *(F.col(c).alias(f"__keep_{c}") for c in keep)), "sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n_sized"))
    sources = targets(totals, weights, share, cap).join(totals.select(F.col("source").alias("s2"), "n_sized"), F.col("source").eqNullSafe(F.col("s2")))
    sources = sources.withColumn("mean", F.greatest(F.lit(1.0), F.coalesce(F.try_divide(F.col("source_size").cast("double"), F.col("n_sized").cast("double")), F.lit(1.0)))).drop("s2", "n_sized")
    sources = stored(sources, "balanced")
    few = sources.count() <= BROADCAST_SOURCES
    hint = F.broadcast if few else (lambda x: x)
    salt = F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")
    named = hint(sources.select("sid", F.col("source").alias("s2"), "source_size", "target"))
    rows = rows.join(named, F.col("source").eqNullSafe(F.col("s2"))).drop("s2").withColumn("part", salt)
    parts = stored(rows.where("size > 0").groupBy("sid", "size", "part").agg(F.count("*").alias("n_part")), "parts")
    cells = stored(parts.groupBy("sid", "size").agg(F.sum("n_part").alias("n")), "cells")
    solved = balance(cells, sources, cap)
    rate = F.when(F.col("capped"), F.lit(float(cap))).when(F.col("lam").isNull(), F.lit(0.0)).otherwise(_rate(F.col("lam"), F.col("size"), F.col("mean"), cap))
    rated = cells.join(hint(solved.select("sid", "capped", "lam", "mean")), "sid").select("sid", "size", "n", rate.alias("rate"))
    whole = stored(_settle(stored(_round(rated), "rounded"), sources, cap).drop("n"), "copies")
    in_cell = Window.partitionBy("sid", "size")
    parts = parts.withColumn("n", F.sum("n_part").over(in_cell)).withColumn("before", F.coalesce(F.sum("n_part").over(in_cell.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = parts.join(whole, ["sid", "size"]).select("sid", "size", "part", "n", "before", "rate", F.col("copies").alias("all_copies"))
    # maps have no order: rows that carry one are told apart by its text
    ties = [F.to_json(F.struct(f"__keep_{c}"), {"ignoreNullFields": "false"}) if "map<" in docs.schema[c].dataType.simpleString() else F.col(f"__keep_{c}") for c in keep]
    rank = F.row_number().over(Window.partitionBy("sid", "size", "part").orderBy(F.xxhash64("id"), "id", *ties))
    out = rows.join(parts, ["sid", "size", "part"], "left").withColumn("rank", rank + F.col("before"))
    copies = F.coalesce(F.expr("all_copies div n") + F.when(F.col("rank") <= F.expr("all_copies % n"), 1).otherwise(0), F.lit(0)).cast("int")
    out = out.withColumn("copies", copies)
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", F.coalesce("rate", F.lit(0.0)).alias("rate"), "copies", (F.col("copies") * F.col("size")).alias("taken"), *(F.col(f"__keep_{c}").alias(c) for c in keep))

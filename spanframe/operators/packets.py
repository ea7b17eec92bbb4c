"""Packet timelines: clean cut points, durations, signatures, verification of an export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .timeline import KEY, as_of


def frame_durations(packets: DataFrame) -> DataFrame:
    """Distance to the next pts; the last frame gets the upper median of its media."""
    w = Window.partitionBy(KEY).orderBy("pts_us")
    rows = packets.withColumn("__d", F.lead("pts_us").over(w) - F.col("pts_us"))
    ranked = rows.where("__d is not null").withColumn("__r", F.row_number().over(Window.partitionBy(KEY).orderBy("__d"))).withColumn("__n", F.count("*").over(Window.partitionBy(KEY)))
    middle = ranked.where("__r = __n div 2 + 1").select(KEY, F.col("__d").alias("__m"))
    return rows.join(middle, KEY, "left").withColumn("duration_us", F.coalesce("__d", "__m")).drop("__d", "__m")


def completeness(packets: DataFrame, media: DataFrame, *, tol: int, spacing: int) -> DataFrame:
    """incomplete: declared duration minus last pts exceeds tol; variable: the range of gaps exceeds spacing."""
    w = Window.partitionBy(KEY).orderBy("pts_us")
    rows = packets.withColumn("__d", F.lead("pts_us").over(w) - F.col("pts_us")).groupBy(KEY).agg(F.max("pts_us").alias("last_us"), (F.max("__d") - F.min("__d")).alias("range_us"))
    out = rows.join(media, KEY)
    return out.withColumns({"incomplete": F.col("duration_us") - F.col("last_us") > tol, "variable": F.coalesce(F.col("range_us") > spacing, F.lit(False))})


def clean_cut_point(packets: DataFrame, cuts: DataFrame, ident: str = "cut_id") -> DataFrame:
    """clean: all packets shown before the cut are decoded before all others, and the first of those is a key packet."""
    none = F.lit(None)
    shown = packets.select(KEY, F.col("pts_us").alias("t"), F.lit(1).alias("kind"), "decode_pos", F.struct("decode_pos", "is_key").alias("packet"), none.cast(cuts.schema[ident].dataType).alias(ident))
    both = shown.unionByName(cuts.select(KEY, F.col("cut_us").alias("t"), F.lit(0).alias("kind"), ident), allowMissingColumns=True)
    # one sort each way: the last packet in decoding order of those shown before, and the first of those shown from then on
    before = Window.partitionBy(KEY).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(KEY).orderBy(F.col("t").desc(), F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("last_before", F.max("decode_pos").over(before)).withColumn("next", F.min("packet").over(after)).where("kind = 0")
    out = out.select(KEY, ident, "last_before", F.col("next.decode_pos").alias("first_after"), F.col("next.is_key").alias("key"))
    order = F.col("last_before").isNull() | F.col("first_after").isNull() | (F.col("last_before") < F.col("first_after"))
    return out.select(KEY, ident, (order & F.coalesce("key", F.lit(True))).alias("clean"))


def timeline_mismatch(out: DataFrame, expected: DataFrame, *, tol: int) -> DataFrame:
    """Places where the spacing of two timelines differs by more than tol, or only one has a frame."""
    w = Window.partitionBy(KEY).orderBy("pts_us")
    side = lambda df, n: df.select(KEY, F.row_number().over(w).alias("place"), (F.lead("pts_us").over(w) - F.col("pts_us")).alias(n))
    both = side(out, "got_us").withColumn("__a", F.lit(1)).join(side(expected, "want_us").withColumn("__b", F.lit(1)), [KEY, "place"], "full")
    return both.where("__a is null or __b is null or abs(got_us - want_us) > " + str(tol)).select(KEY, "place", "got_us", "want_us")


def packet_equality(src: DataFrame, dst: DataFrame, *, tol: int) -> DataFrame:
    """Per media: packets of each side, and positions whose hash or pts differ."""
    b = dst.select(KEY, "decode_pos", F.col("pts_us").alias("__p"), F.col("data_hash").alias("__h"))
    both = src.join(b, [KEY, "decode_pos"], "full")
    off = ~F.col("data_hash").eqNullSafe(F.col("__h")) | F.coalesce(F.abs(F.col("pts_us") - F.col("__p")) > tol, F.lit(False))
    return both.groupBy(KEY).agg(F.count("pts_us").alias("n_src"), F.count("__p").alias("n_dst"), F.count_if(off).alias("n_off"))


def first_mismatch(src: DataFrame, dst: DataFrame) -> DataFrame:
    """The first place in order of pts where two signatures differ: key packets by place only, others by hash."""
    w = Window.partitionBy(KEY).orderBy("pts_us")
    mark = F.when(F.col("is_key"), "key").otherwise(F.col("data_hash"))
    side = lambda df, n: df.select(KEY, F.row_number().over(w).alias("place"), mark.alias(n))
    both = side(src, "a").join(side(dst, "b"), [KEY, "place"], "full").where(~F.col("a").eqNullSafe(F.col("b")))
    reason = F.when(F.col("x.a").isNull(), "missing in source").when(F.col("x.b").isNull(), "missing in output").otherwise("different")
    return both.groupBy(KEY).agg(F.min(F.struct("place", "a", "b")).alias("x")).select(KEY, "x.place", reason.alias("reason"))


def frame_aligned_ranges(kept: DataFrame, packets: DataFrame) -> DataFrame:
    """Ranges from their first frame to the first frame at or after their end (else their end); empty ones are dropped."""
    marks = packets.select(KEY, F.col("pts_us").alias("mark_us"))
    out = as_of(kept, marks, ts="start_us").withColumnRenamed("next_us", "frame_start_us").drop("prev_us")
    out = as_of(out, marks, ts="end_us").withColumn("frame_end_us", F.coalesce("next_us", "end_us")).drop("prev_us", "next_us")
    return out.where("frame_start_us < frame_end_us")


def removal_report(expected: DataFrame, exported: DataFrame) -> DataFrame:
    """Per media: frames that leaked, are missing, or are doubled, whether they are in order, and runs of leaked indices."""
    leaked = exported.select(KEY, "frame").distinct().join(expected, [KEY, "frame"], "left_anti")
    missing = expected.join(exported, [KEY, "frame"], "left_anti").groupBy(KEY).agg(F.count("*").alias("n_missing"))
    w = Window.partitionBy(KEY).orderBy("place")
    rows = exported.withColumn("__p", F.lag("frame").over(w)).groupBy(KEY).agg((F.count("*") - F.count_distinct("frame")).alias("n_doubled"), (F.count_if(F.col("frame") < F.col("__p")) == 0).alias("monotonic"))
    runs = leaked.withColumn("__g", F.col("frame") - F.row_number().over(Window.partitionBy(KEY).orderBy("frame"))).groupBy(KEY).agg(F.count("*").alias("n_leaked"), F.count_distinct("__g").alias("n_leaked_runs"))
    return rows.join(runs, KEY, "left").join(missing, KEY, "left").na.fill(0)

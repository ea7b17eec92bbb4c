"""Timeline sampling and reduction: chunks, grids, greedy gaps, static and duplicate frames, batches, invariants."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import greedy
from .timeline import KEY, ordered_pass, points_in_intervals


def plan_chunks(media: DataFrame, *, core: int, overlap: int = 0) -> DataFrame:
    """Gap-free cores of [0, duration_us]; decode ranges add half the overlap before and the rest after, clamped."""
    n = F.greatest(F.lit(1), F.ceil(F.col("duration_us") / core)).cast("bigint")
    rows = media.select(KEY, "duration_us", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("chunk"))
    rows = rows.withColumn("core_start_us", F.col("chunk") * core).withColumn("core_end_us", F.least(F.col("duration_us"), (F.col("chunk") + 1) * core))
    before = overlap // 2
    return rows.withColumn("decode_start_us", F.greatest(F.lit(0), F.col("core_start_us") - before)).withColumn("decode_end_us", F.least(F.col("duration_us"), F.col("core_end_us") + overlap - before))


def owning_chunk(points: DataFrame, *, core: int, ts: str = "ts_us") -> DataFrame:
    """chunk: the half-open core that holds the point; the media's endpoint belongs to the last; outside is null."""
    t, end = F.col(ts), F.col("duration_us")
    last = F.greatest(F.lit(1), F.ceil(end / core)) - 1
    return points.withColumn("chunk", F.when((t >= 0) & (t <= end), F.least(F.floor(t / core), last).cast("bigint")))


def _w(ts: str, tie: Sequence[str]) -> Window:
    return Window.partitionBy(KEY).orderBy(ts, *tie)


def sample_grid(points: DataFrame, *, every: int, eps: int = 1, ts: str = "ts_us", tie: Sequence[str] = ()) -> DataFrame:
    """The first point at or after each tick of every microseconds from 0; a point eps early counts for its tick."""
    tick = F.floor((F.col(ts) + eps) / every)
    first = F.row_number().over(Window.partitionBy(KEY, "__tick").orderBy(ts, *tie))
    return points.withColumn("__tick", tick).withColumn("__n", first).where("__n = 1").drop("__tick", "__n")


def sample_phase(points: DataFrame, *, gap: int, phase: int = 0, ts: str = "ts_us", tie: Sequence[str] = ()) -> DataFrame:
    """The first point at or after each phase + k * gap."""
    slot = F.floor((F.col(ts) - phase) / gap)
    before = F.coalesce(F.lag(slot).over(_w(ts, tie)), F.lit(-1))
    return points.withColumn("__slot", slot).withColumn("__before", before).where("__slot >= 0 and __slot > __before").drop("__slot", "__before")


def phase_grid(gap: int, step: int) -> list[int]:
    """Phases 0, step, 2 step, .. below gap, and the quarters of gap."""
    return sorted({*range(0, gap, step), *(gap * i // 4 for i in range(4))})


def cadence_or_scene(points: DataFrame, *, cadence: int, scene: Column, ts: str = "ts_us", tie: Sequence[str] = ()) -> DataFrame:
    """Points that are first, that enter a new cadence slot, or whose scene column holds; reasons names why."""
    slot = F.floor(F.col(ts) / cadence)
    rows = points.withColumn("__prev", F.lag(slot).over(_w(ts, tie)))
    first = F.col("__prev").isNull()
    reasons = F.array_compact(F.array(F.when(first, "first"), F.when(~first & (slot != F.col("__prev")), "cadence"), F.when(scene, "scene")))
    return rows.withColumn("reasons", reasons).where(F.size("reasons") > 0).drop("__prev")


def scene_mask(samples: DataFrame, reason: str = "scene") -> DataFrame:
    return samples.where(F.array_contains("reasons", reason))


def sample_min_gap(points: DataFrame, *, gap: int, ts: str = "ts_us", chunk: int | None = None) -> DataFrame:
    """(media_id, ts): greedily the first, then each first point at least gap after the last one taken. Null times are dropped.

    With chunk (microseconds, many gaps) no task holds more than a chunk of a timeline, by pointer doubling: for timelines of any
    length. Otherwise a timeline is one ordered pass, whose only state is the last point taken."""
    if gap <= 0:
        raise ValueError("the gap must be positive")
    return greedy.min_gap(points, gap, ts) if chunk is None else greedy.min_gap_chunked(points, gap, ts, chunk)


def dedupe_close(points: DataFrame, *, tol: int = 200_000, ts: str = "ts_us", scene: str = "scene", ident: str = "sample_id") -> DataFrame:
    """Points in the order (time, scene first): one within tol of the last kept is dropped, unless it is a scene point and
    the kept one is not; then it takes the other's place, and its time becomes the anchor. Null times are dropped, and a null
    scene is none."""
    return greedy.dedupe_close(points, tol, ts, scene, ident)


def regions_of(grid: str, width: int, height: int) -> list[Column]:
    """The four quarters and the centre of a row-major grid, of half its width and height each."""
    w, h = width // 2, height // 2
    corners = [(0, 0), (width - w, 0), (0, height - h), (width - w, height - h), ((width - w) // 2, (height - h) // 2)]
    cut = lambda x, y: F.flatten(F.transform(F.sequence(F.lit(y), F.lit(y + h - 1)), lambda i: F.slice(grid, i * width + x + 1, w)))
    return [cut(x, y) for x, y in corners]


def frame_features(frames: DataFrame, luma: str, width: int, height: int, *, black: float = 16.0, rgb: Sequence[str] = ()) -> DataFrame:
    """black_fraction, mean_luma and the difference hash of a luma grid column, and region_hashes of its quarters and centre.
    With rgb, the three grids of the colours: mean_rgb and region_rgb (three means for each region).

    A grid of twice the size of a hash's (18 x 16 for 64 bits) gives regions hashes as fine as the frame's, which is then taken
    from the means of two by two values."""
    from ..functions.columns import difference_hash

    mean = lambda g: F.aggregate(g, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(g)
    share = F.size(F.filter(luma, lambda x: x < black)) / F.size(luma)
    frames = frames.withColumns({f"__region{i}": r for i, r in enumerate(regions_of(luma, width, height))})
    half = lambda i: sum(F.get(luma, (F.floor(i / (width // 2)) * 2 * width + i % (width // 2) * 2).cast("int") + d) for d in (0, 1, width, width + 1))
    if (width - 1) * height > 64:
        frames = frames.withColumn("__region5", F.transform(F.sequence(F.lit(0), F.lit(width // 2 * (height // 2) - 1)), half))
        whole = difference_hash(F.col("__region5"), width // 2, height // 2)
    else:
        whole = difference_hash(F.col(luma), width, height)
    hashes = F.array(*[difference_hash(F.col(f"__region{i}"), width // 2, height // 2) for i in range(5)])
    made = {"black_fraction": share, "mean_luma": mean(F.col(luma)), "hash": whole, "region_hashes": hashes}
    if rgb:
        made["mean_rgb"] = F.array(*[mean(F.col(c)) for c in rgb])
        made["region_rgb"] = F.flatten(F.array(*[F.array(*x) for x in zip(*[[mean(r) for r in regions_of(c, width, height)] for c in rgb], strict=True)]))
    return frames.withColumns(made).drop(*[f"__region{i}" for i in range(6)])


def static_step(last: tuple | None, row: tuple, *, bits: int, colour: float, limit: int, cross: int, black: float, black_luma: float) -> tuple[tuple | None, str, int | None]:
    """(the new representative, disposition, time of the one it repeats) of a frame (time, id, chunk, scene, black fraction,
    mean luma, hashes, colours) after the representative (time, chunk, hashes, colours)."""
    t, _, chunk, scene, fraction, luma, hashes, colours = row
    if fraction >= black and luma <= black_luma:
        return None, "black", None
    if last is not None:
        alike = all(((x ^ y) & (1 << 64) - 1).bit_count() <= bits for x, y in zip(hashes, last[2], strict=True)) and all(abs(x - y) <= colour for x, y in zip(colours, last[3], strict=True))
        if alike and chunk != last[1] and abs(t - last[0]) <= cross:
            return last, "near_duplicate", last[0]
        if alike and not scene and 0 <= t - last[0] < limit:
            return last, "static_suppressed", last[0]
    return (t, chunk, hashes, colours), "representative", None


def frame_evidence(features: DataFrame) -> DataFrame:
    """features with __hashes and __colours: the whole frame's and, where given, those of its regions; mean_rgb, or else mean_luma."""
    have = set(features.columns)
    hashes = [F.array(F.col("hash").cast("bigint")), *([F.col("region_hashes")] if "region_hashes" in have else [])]
    colours = [F.col("mean_rgb") if "mean_rgb" in have else F.array(F.col("mean_luma").cast("double")), *([F.col("region_rgb")] if "region_rgb" in have else [])]
    return features.withColumns({"__hashes": F.concat(*hashes), "__colours": F.concat(*colours)})


FRAME = ("ts_us", "sample_id", "chunk", "scene", "black_fraction", "mean_luma", "__hashes", "__colours")


def reduce_static(features: DataFrame, *, bits: int = 3, colour: float = 12.0, limit: int = 10_000_000, cross: int = 50_000, black: float = 0.98, black_luma: float = 255.0) -> DataFrame:
    """disposition and duplicate_of_us of frames (media_id, ts_us, sample_id, chunk, scene, black_fraction, mean_luma, hash, and
    where known region_hashes, mean_rgb, region_rgb), in the order of time, then sample_id.

    Black frames (dark pixels and mean) forget the representative. A frame like the last representative (every hash within bits,
    every colour within colour, so that a logo in one region tells frames apart) is a near_duplicate across a chunk's edge
    within cross, and static_suppressed below limit unless it is a scene frame; every other frame becomes the representative.
    """

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        last = None
        for row in rows:
            last, what, of = static_step(last, row, bits=bits, colour=colour, limit=limit, cross=cross, black=black, black_luma=black_luma)
            yield row[1], what, of

    rows = frame_evidence(features)
    return ordered_pass(rows, [KEY], ["ts_us", "sample_id"], FRAME, fold, f"sample_id {features.schema['sample_id'].dataType.simpleString()}, disposition string, duplicate_of_us bigint")


def refine_windows(frames: DataFrame, windows: DataFrame, *, every: int, width: int, tol: int = 200_000, ident: str = "sample_id") -> DataFrame:
    """Frames inside windows on a dense grid that starts with each window, and all scene frames inside, deduplicated."""
    inside = points_in_intervals(frames, windows, width=width).withColumn("__tick", F.floor((F.col("ts_us") - F.col("i_start_us")) / every))
    first = F.row_number().over(Window.partitionBy(KEY, "i_window_id", "__tick").orderBy("ts_us", ident))
    picked = inside.withColumn("__n", first).where("__n = 1 or scene").select(KEY, "ts_us", "scene", ident).distinct()
    return dedupe_close(picked, tol=tol, ident=ident)


def build_batches(frames: DataFrame, *, size: int, margin: int = 500_000, least: int = 100_000, ts: str = "ts_us", tie: Sequence[str] = ()) -> DataFrame:
    """Ordered batches of size frames: frames (array of times), bounds widened by margin, clamped, and at least least long."""
    number = F.floor((F.row_number().over(_w(ts, tie)) - 1) / size).cast("bigint")
    rows = frames.withColumn("batch", number).groupBy(KEY, "batch").agg(F.array_sort(F.collect_list(ts)).alias("frames"), F.max("duration_us").alias("duration_us"))
    lo = F.greatest(F.lit(0), F.element_at("frames", 1) - margin)
    hi = F.least(F.col("duration_us"), F.element_at("frames", -1) + margin)
    return rows.withColumn("start_us", lo).withColumn("end_us", F.greatest(hi, lo + least)).drop("duration_us")


def sample_gaps(samples: DataFrame, *, ts: str = "ts_us", tie: Sequence[str] = ()) -> DataFrame:
    """Per media: least, greatest and mean distance of neighbours, and the longest gap with the media's edges."""
    w = _w(ts, tie)
    rows = samples.withColumn("__d", F.col(ts) - F.lag(ts).over(w))
    out = rows.groupBy(KEY).agg(F.count("*").alias("n"), F.min("__d").alias("least_us"), F.max("__d").alias("most_us"), F.avg("__d").alias("mean_us"), F.min(ts).alias("__first"), F.max(ts).alias("__last"), F.max("duration_us").alias("__end"))
    longest = F.greatest("most_us", "__first", F.col("__end") - F.col("__last"))
    return out.withColumn("longest_us", longest).drop("__first", "__last", "__end")


def check_invariants(samples: DataFrame, *, core: int, gap: int, ts: str = "ts_us", tie: Sequence[str] = (), arrival: str | None = None, chunks: DataFrame | None = None, recorded: str | None = None, temporal: str | None = None, static: int | None = None, statistics: DataFrame | None = None) -> DataFrame:
    """(name, passed, detail): invariants of a sampling, with the number of rows, or of media, that break each.

    sorted (time along the arrival column; of no meaning without one), in_range, owned (the recorded chunk, or any chunk, is the
    one whose half-open core holds the row), longest_gap (media where neighbours, the start or the end are further than gap
    apart, among rows of the temporal column where one is given), accounted (a known disposition; and the media's totals in
    statistics(media_id, n, the counts of runs.DISPOSITIONS) where given), not_empty (media without a representative, or
    none at all). Where given: cores (media whose chunks, as of plan_chunks, leave a gap, overlap, miss an end of the media, are
    misnumbered, or are not inside of their decode range), and static (rows static_suppressed whose duplicate_of_us is no
    representative of their media, lies ahead, or static or more behind, or that are scene rows).
    """
    from .runs import DISPOSITIONS

    w = _w(ts, tie)
    arrived = Window.partitionBy(KEY).orderBy(arrival) if arrival else w
    on_grid = F.coalesce(F.col(temporal), F.lit(False)) if temporal else F.lit(True)
    rows = samples if recorded is None else samples.withColumnRenamed(recorded, "__recorded")
    rows = owning_chunk(rows, core=core, ts=ts).withColumn("__a", F.col(ts) - F.lag(ts).over(arrived)).withColumn("__grid", on_grid)
    rows = rows.withColumn("__d", F.col(ts) - F.last(F.when(F.col("__grid"), F.col(ts)), True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    owned = F.col("chunk").isNotNull() if recorded is None else F.col("chunk").eqNullSafe(F.col("__recorded").cast("bigint"))
    media = rows.groupBy(KEY).agg(
        F.count_if(F.col("__a") < 0).alias("sorted"), F.count_if((F.col(ts) < 0) | (F.col(ts) > F.col("duration_us"))).alias("in_range"), F.count_if(~owned).alias("owned"),
        F.greatest(F.max(F.when(F.col("__grid"), F.coalesce("__d", F.col(ts)))), F.max("duration_us") - F.max(F.when(F.col("__grid"), F.col(ts)))).alias("__far"), F.count_if("__grid").alias("__n"),
        F.count_if(~F.coalesce(F.col("disposition").isin(*DISPOSITIONS), F.lit(False))).alias("accounted"), F.count_if(F.col("disposition") == "representative").alias("__kept"), F.count("*").alias("__rows"),
        *[F.count_if(F.col("disposition") == d).alias(f"__{n}") for d, n in DISPOSITIONS.items()],
    )
    if statistics is not None:
        told = statistics.select(KEY, F.col("n").alias("__told"), *[F.col(n).alias(f"__told_{n}") for n in DISPOSITIONS.values()])
        unlike = ~F.col("__told").eqNullSafe(F.col("__rows"))
        for n in DISPOSITIONS.values():
            unlike = unlike | ~F.col(f"__told_{n}").eqNullSafe(F.col(f"__{n}"))
        media = media.join(told, KEY, "full").withColumn("accounted", F.coalesce("accounted", F.lit(0)) + unlike.cast("bigint"))
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    counts = {
        "sorted": total("sorted"), "in_range": total("in_range"), "owned": total("owned"), "longest_gap": yes((F.col("__far") > gap) | (F.col("__n") == 0)), "accounted": total("accounted"),
        "not_empty": F.when(F.count("*") == 0, 1).otherwise(yes(F.coalesce("__kept", F.lit(0)) == 0)),
    }
    parts = [media.agg(*[c.cast("bigint").alias(n) for n, c in counts.items()])]
    if chunks is not None:
        near = Window.partitionBy(KEY).orderBy("chunk")
        c = chunks.withColumns({"__p": F.lag("core_end_us").over(near), "__i": F.row_number().over(near) - 1})
        wrong = ~F.col("core_start_us").eqNullSafe(F.coalesce("__p", F.lit(0))) | (F.col("chunk") != F.col("__i")) | (F.col("decode_start_us") > F.col("core_start_us")) | (F.col("decode_end_us") < F.col("core_end_us"))
        per = c.groupBy(KEY).agg(F.bool_or(F.coalesce(wrong, F.lit(True))).alias("w"), (F.max("core_end_us") != F.max("duration_us")).alias("e"))
        missing = samples.select(KEY).distinct().join(per.select(KEY), KEY, "left_anti").select(F.lit(True).alias("w"), F.lit(True).alias("e"))
        parts.append(per.select("w", "e").union(missing).agg(yes(F.col("w") | F.col("e")).cast("bigint").alias("cores")))
    if static is not None:
        kept = samples.where("disposition = 'representative'").select(KEY, F.col(ts).alias("duplicate_of_us"), F.lit(True).alias("__is")).distinct()
        behind = F.col(ts) - F.col("duplicate_of_us")
        fine = F.col("__is") & (behind >= 0) & (behind < static) & ~F.coalesce("scene", F.lit(False))
        held = samples.where("disposition = 'static_suppressed'").join(kept, [KEY, "duplicate_of_us"], "left")
        parts.append(held.agg(yes(~F.coalesce(fine, F.lit(False))).cast("bigint").alias("static")))
    out = None
    for p in parts:
        rows = p.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("detail")) for n in p.columns])).alias("x")).select("x.name", (F.col("x.detail") == 0).alias("passed"), "x.detail")
        out = rows if out is None else out.unionByName(rows)
    return out

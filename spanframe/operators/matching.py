"""One-to-one matching of predicted and true intervals, and the scores built on it."""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..shared import stored
from .intervals import intersect_intervals, merge_intervals, total_duration
from .timeline import KEY, as_of, interval_islands

#: Sums of overlaps that differ by less are equal.
EPS = 1e-12


def pair_iou(predicted: DataFrame, truth: DataFrame, *, width: int) -> DataFrame:
    """Overlapping pairs with iou; truth columns get the prefix r_."""
    out = intersect_intervals(predicted, truth, width=width)
    both = F.col("overlap_end_us") - F.col("overlap_start_us")
    return out.withColumn("iou", both / (F.col("end_us") - F.col("start_us") + F.col("r_end_us") - F.col("r_start_us") - both))


def assign_edges(edges: Mapping[tuple[int, int], float]) -> list[tuple[int, int]]:
    """Pairs (row, column) of a matching along weighted edges: most pairs, then the greatest sum; ties go to lower columns.

    Successive best augmenting paths: each one gives the best matching of one more pair. Holds the edges alone.
    """
    of_row: dict[int, list[int]] = {}
    for r, c in sorted(edges):
        of_row.setdefault(r, []).append(c)
    row_of: dict[int, int] = {}
    col_of: dict[int, int] = {}
    while True:
        gain: dict[int, float] = {}
        came: dict[int, int] = {}
        turn = deque((r, 0.0, -1) for r in of_row if r not in col_of)
        while turn:
            r, base, at = turn.popleft()
            if at >= 0 and (row_of[at] != r or gain[at] - edges[r, at] > base + EPS):
                continue  # a better way to this row is in the queue
            for c in of_row[r]:
                found = base + edges[r, c]
                if c != at and found > gain.get(c, float("-inf")) + EPS:
                    gain[c], came[c] = found, r
                    if c in row_of:
                        turn.append((row_of[c], found - edges[row_of[c], c], c))
        ends = [c for c in gain if c not in row_of]
        if not ends:
            return sorted((r, c) for c, r in row_of.items())
        c = min(ends, key=lambda x: (-gain[x], x))
        while c is not None:
            r = came[c]
            freed = col_of.get(r)
            row_of[c], col_of[r] = r, c
            c = freed


def _connected(ps: np.ndarray, ts: np.ndarray) -> list[list[int]]:
    """Places of the pairs (ps, ts) that hang together by a common end, each set in order."""
    root = list(range(int(ps.max(initial=-1)) + 1))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    first: dict[int, int] = {}
    for p, t in zip(ps.tolist(), ts.tolist(), strict=True):
        a, b = find(p), find(first.setdefault(t, p))
        root[max(a, b)] = min(a, b)
    parts: dict[int, list[int]] = {}
    for i, p in enumerate(ps.tolist()):
        parts.setdefault(find(p), []).append(i)
    return list(parts.values())


def assign(weight: np.ndarray) -> list[tuple[int, int]]:
    """assign_edges of the positive entries of a matrix."""
    return assign_edges({(int(r), int(c)): float(weight[r, c]) for r, c in np.argwhere(weight > 0)})


def match_events(predicted: DataFrame, truth: DataFrame, *, thresholds: Sequence[float], width: int, ident: str = "interval_id", by: Sequence[str] = (KEY, "category"), carry: Sequence[str] = ()) -> DataFrame:
    """One-to-one pairs of each group and IoU threshold: most pairs, then the greatest sum of IoU, ties by ids.

    Pairs that are each other's only choice are settled in SQL. Contested pairs are split on Spark into islands of pairs that
    touch in time, which never influence each other; a task holds an island's pairs, and solves those that share an event, by
    however many steps, apart from the others. ident must name an event of a group once. carry: columns of both sides that
    pairs keep, as p_<name> and t_<name>.
    """
    same = " AND ".join(f"{c} <=> r_{c}" for c in by if c != KEY) or "true"
    pairs = intersect_intervals(predicted, truth, width=width).where(same)
    kept = [F.col(c).alias(f"p_{c}") for c in carry] + [F.col(f"r_{c}").alias(f"t_{c}") for c in carry]
    both = F.col("overlap_end_us") - F.col("overlap_start_us")
    share = both / (F.col("end_us") - F.col("start_us") + F.col("r_end_us") - F.col("r_start_us") - both)
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    pairs = pairs.select(*by, F.col(ident).alias("p"), F.col(f"r_{ident}").alias("t"), share.alias("iou"), F.least("start_us", "r_start_us").alias("lo"), F.greatest("end_us", "r_end_us").alias("hi"), *kept, grid).where("iou >= threshold")
    counted = pairs.withColumn("np", F.count("*").over(Window.partitionBy(*by, "threshold", "p"))).withColumn("nt", F.count("*").over(Window.partitionBy(*by, "threshold", "t")))
    columns = (*by, "threshold", "p", "t", "iou", *(f"{x}_{c}" for x in "pt" for c in carry))
    settled = counted.where("np = 1 and nt = 1").select(*columns)
    contested = interval_islands(counted.where("np > 1 or nt > 1"), start="lo", end="hi", key=(*by, "threshold")).select(*columns, "island")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ps, ts = np.unique(pdf["p"], return_inverse=True)[1], np.unique(pdf["t"], return_inverse=True)[1]
        iou, chosen = pdf["iou"].tolist(), np.zeros(len(pdf), bool)
        for part in _connected(ps, ts):
            picked = set(assign_edges({(int(ps[i]), int(ts[i])): iou[i] for i in part}))
            chosen[[i for i in part if (int(ps[i]), int(ts[i])) in picked]] = True
        return pdf[chosen]

    return settled.unionByName(contested.groupBy(*by, "threshold", "island").applyInPandas(solve, contested.schema).drop("island"))


def visible(events: DataFrame, excluded: DataFrame | None) -> DataFrame:
    """Events on the timeline that is left when excluded ranges are cut out: start_us and end_us are moved there, so that an
    event's fragments are one interval of their total length, and what an exclusion hides has no length.

    event_start_us and event_end_us keep the times; start_seen and end_seen say whether these lie outside of all excluded
    ranges, edges included. One sort of events' ends among the ranges.
    """
    rows = events.withColumns({"event_start_us": F.col("start_us"), "event_end_us": F.col("end_us")})
    if excluded is None:
        return rows.withColumns({"start_seen": F.lit(True), "end_seen": F.lit(True)})
    before = Window.partitionBy(KEY).orderBy("start_us").rowsBetween(Window.unboundedPreceding, -1)
    marks = merge_intervals(excluded.select(KEY, "start_us", "end_us"))
    marks = marks.select(KEY, F.col("start_us").alias("mark_us"), F.col("end_us").alias("until"), F.coalesce(F.sum(F.col("end_us") - F.col("start_us")).over(before), F.lit(0)).alias("hidden"))
    event = F.struct(*[c for c in rows.columns if c != KEY])
    ends = F.explode(F.array(F.struct(F.lit("start").alias("edge"), F.col("start_us").alias("ts_us")), F.struct(F.lit("end").alias("edge"), F.col("end_us").alias("ts_us"))))
    points = rows.select(KEY, event.alias("event"), ends.alias("x")).select(KEY, "event", "x.*")
    placed = as_of(points, marks, payload=("until", "hidden"))
    at = F.col("ts_us") - F.coalesce(F.col("prev_hidden") + F.least("ts_us", "prev_until") - F.col("prev_us"), F.lit(0))
    placed = placed.select(KEY, "event", "edge", at.alias("at"), F.coalesce(F.col("ts_us") > F.col("prev_until"), F.lit(True)).alias("seen"))
    pick = lambda c, e: F.max(F.when(F.col("edge") == e, F.col(c)))
    out = placed.groupBy(KEY, "event").agg(pick("at", "start").alias("s"), pick("at", "end").alias("e"), pick("seen", "start").alias("start_seen"), pick("seen", "end").alias("end_seen"))
    return out.select(KEY, *[F.col(f"event.{c}").alias(c) for c in rows.columns if c not in (KEY, "start_us", "end_us")], F.col("s").alias("start_us"), F.col("e").alias("end_us"), "start_seen", "end_seen")


#: Sums of evaluate_media by threshold, and by media and category alone.
COUNTS = ("tp", "fp", "fn", "start_n", "start_bias_us", "start_error_us", "end_n", "end_bias_us", "end_error_us")
TIMES = ("evaluated_us", "target_us", "predicted_us", "covered_us", "ignored_predicted", "ignored_true")


def evaluate_media(predicted: DataFrame, truth: DataFrame, media: DataFrame, excluded: DataFrame | None = None, *, thresholds: Sequence[float] = (0.25, 0.5, 0.75), width: int, binary: bool = False) -> DataFrame:
    """Of each media, category and threshold: tp, fp, fn, boundary errors (number, sum, sum of sizes), and the times evaluated,
    true, predicted and covered.

    Excluded ranges are cut from both sides; the fragments of an event stay one event, and events of which nothing is left
    are counted as ignored. A boundary inside an excluded range has no error. binary: all categories as one, named "binary",
    true events that overlap or touch merged first. media(media_id, duration_us). Rows without a category, of media that are
    not in media, or of no length take no part. Rows that repeat an id, or are equal, are events of their own: two equal
    predictions of one true event are one hit and one false alert. No samples or events give no rows.
    """
    by = (KEY, "category")
    columns = (KEY, "interval_id", "start_us", "end_us", "category")
    if binary:
        merged = merge_intervals(truth, carry={"interval_id": "min"})
        predicted, truth = (df.withColumn("category", F.lit("binary")) for df in (predicted, merged))
    # rows that repeat an id, or all of a row, are events of their own: a number in the order of ids stands for them
    number = F.row_number().over(Window.partitionBy(KEY).orderBy("interval_id", "start_us", "end_us", "category")).cast("bigint")
    sides = [df.select(*columns).where("category is not null and end_us > start_us").withColumn("interval_id", number).withColumn("side", F.lit(n)) for n, df in (("p", predicted), ("t", truth))]
    # stored: both sides of a join and the sweep read it. Spark 4.1 joined it with itself wrongly where it was planned in place, as it
    # takes a union of sides that are partitioned alike (spark.sql.unionOutputPartitioning) to be partitioned so
    seen = stored(visible(sides[0].unionByName(sides[1]).join(media.select(KEY), KEY, "left_semi"), excluded), "seen")
    pairs = match_events(*(seen.where((F.col("side") == n) & (F.col("end_us") > F.col("start_us"))) for n in "pt"), thresholds=thresholds, width=width, carry=("event_start_us", "event_end_us", "start_seen", "end_seen"))
    hits = [F.count("*").alias("tp")]
    for e in ("start", "end"):
        x = F.when(F.col(f"p_{e}_seen") & F.col(f"t_{e}_seen"), F.col(f"p_event_{e}_us") - F.col(f"t_event_{e}_us"))
        hits += [F.count(x).alias(f"{e}_n"), F.sum(x).alias(f"{e}_bias_us"), F.sum(F.abs(x)).alias(f"{e}_error_us")]
    hits = pairs.groupBy(*by, "threshold").agg(*hits)
    # one sweep over the ends of both sides: what is open between two of them
    ends = F.explode(F.array(F.struct(F.col("start_us").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end_us").alias("at"), F.lit(-1).alias("step"))))
    swept = seen.select(*by, "side", (F.col("end_us") > F.col("start_us")).alias("shown"), ends.alias("x")).select(*by, "side", "shown", "x.*")
    order = Window.partitionBy(*by).orderBy("at", "step", "side")
    is_open = {n: F.sum(F.when(F.col("side") == n, F.col("step")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)) > 0 for n in "pt"}
    swept = swept.withColumns({"span": F.coalesce(F.lead("at").over(order) - F.col("at"), F.lit(0)), "p": is_open["p"], "t": is_open["t"], "first": F.col("step") == 1})
    total = lambda x: F.coalesce(F.sum(F.when(x, F.col("span"))), F.lit(0))
    number = lambda n, shown: F.count_if(F.col("first") & (F.col("side") == n) & (F.col("shown") == shown))
    times = swept.groupBy(*by).agg(
        total(F.col("t")).alias("target_us"), total(F.col("p")).alias("predicted_us"), total(F.col("p") & F.col("t")).alias("covered_us"),
        number("p", True).alias("n_predicted"), number("t", True).alias("n_true"), number("p", False).alias("ignored_predicted"), number("t", False).alias("ignored_true"),
    )
    lengths = media.select(KEY, F.col("duration_us").alias("evaluated_us"))
    if excluded is not None:
        inside = excluded.join(media.select(KEY, "duration_us"), KEY).select(KEY, F.greatest("start_us", F.lit(0)).alias("start_us"), F.least("end_us", "duration_us").alias("end_us"))
        lengths = lengths.join(total_duration(merge_intervals(inside)), KEY, "left").select(KEY, (F.col("evaluated_us") - F.coalesce("total_us", F.lit(0))).alias("evaluated_us"))
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    out = times.select("*", grid).join(hits, [*by, "threshold"], "left").join(lengths, KEY)
    counts = {c: F.coalesce(c, F.lit(0)) for c in COUNTS if c not in ("fp", "fn")}
    counts |= {"fp": F.col("n_predicted") - counts["tp"], "fn": F.col("n_true") - counts["tp"]}
    return out.select(*by, "threshold", *[counts[c].cast("bigint").alias(c) for c in COUNTS], *[F.col(c).cast("bigint").alias(c) for c in TIMES])


def scorable(items: DataFrame, results: DataFrame, category: str | None = None) -> DataFrame:
    """Items whose true events are said to be all there are (of the category, if given), with usable: their run completed.

    items(media_id, binary_exhaustive, exhaustive_categories), results(media_id, status). Items that are not usable are
    reported, not scored; the others are left out.
    """
    held = items.where(F.coalesce("binary_exhaustive", F.lit(False)))
    held = held if category is None else held.where(F.array_contains("exhaustive_categories", category))
    done = results.groupBy(KEY).agg(F.bool_and(F.coalesce(F.col("status") == "completed", F.lit(False))).alias("usable"))
    return held.join(done, KEY, "left").withColumn("usable", F.coalesce("usable", F.lit(False)))


def coverage(predicted: DataFrame, truth: DataFrame, *, width: int, by: Sequence[str] = (KEY,)) -> DataFrame:
    """Per media (and what else by names): truth_us, predicted_us and both_us of the merged sides."""
    a, b = merge_intervals(predicted, key=by), merge_intervals(truth, key=by)
    same = " AND ".join(f"{c} = r_{c}" for c in by if c != KEY) or "true"
    both = intersect_intervals(a, b, width=width).where(same).groupBy(*by).agg(F.sum(F.col("overlap_end_us") - F.col("overlap_start_us")).alias("both_us"))
    out = total_duration(a, key=by).withColumnRenamed("total_us", "predicted_us").join(total_duration(b, key=by).withColumnRenamed("total_us", "truth_us"), list(by), "full")
    return out.join(both, list(by), "left").na.fill(0)


def aggregate_events(scored: DataFrame, by: Sequence[str] = ("threshold",)) -> DataFrame:
    """Micro totals of evaluate_media: ratios of sums, never means of ratios; null where nothing is divided by.

    Alerts a minute are false ones over the evaluated time, of all media and of those without a true event.
    """
    minute = 60_000_000
    quiet = F.when(F.col("target_us") == 0, F.lit(1)).otherwise(0)
    out = scored.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in (*COUNTS, *TIMES)], F.sum(F.col("fp") * quiet).alias("__fp"), F.sum(F.col("evaluated_us") * quiet).alias("__us"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    rates = {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "target_coverage": ratio(F.col("covered_us"), F.col("target_us")), "temporal_precision": ratio(F.col("covered_us"), F.col("predicted_us"))}
    for e in ("start", "end"):
        rates |= {f"{e}_bias": ratio(F.col(f"{e}_bias_us"), F.col(f"{e}_n")), f"{e}_mae": ratio(F.col(f"{e}_error_us"), F.col(f"{e}_n"))}
    rates |= {"missed_us": F.col("target_us") - F.col("covered_us"), "excess_us": F.col("predicted_us") - F.col("covered_us"), "alerts_a_minute": ratio(fp * minute, F.col("evaluated_us")), "quiet_alerts_a_minute": ratio(F.col("__fp") * minute, F.col("__us"))}
    return out.withColumns(rates).drop("__fp", "__us")

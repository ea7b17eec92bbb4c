"""Offline evaluation of threshold policies. A detection is an or of thresholds, so per interval only maxima matter: points
meet intervals once, and the grid of policies meets the small table of maxima."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..shared import stored
from .intervals import merge_intervals
from .greedy import held_by
from .timeline import KEY, points_in_intervals

def upper_bound(values: Column, x: Column) -> Column:
    """How many of a sorted array's values are at most x, by bisection; none for null."""
    start = F.struct(F.lit(0).alias("lo"), F.size(values).alias("hi"))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1.0)).cast("int"))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        up = F.coalesce(F.get(values, mid) <= x, F.lit(False))
        open_ = s["lo"] < s["hi"]
        return F.struct(F.when(open_ & up, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~up, mid).otherwise(s["hi"]).alias("hi"))

    return F.aggregate(steps, start, step, lambda s: s["lo"])


def _below(places: DataFrame, lists: DataFrame, by: Sequence[str], axes: Mapping[str, str], counts: Sequence[str]) -> DataFrame:
    """places(by, axes, counts), a row a place -> for each corner of the grid of axes, the counts of all places at or below it
    in every axis; and all_<count>, the sums over by. axes: names of places by the thresholds' list in lists(by, lists).

    A running sum along each axis in turn: the grid is as large as the product of the axes' thresholds, which policies are."""
    grid = lists.select(*by, *[F.size(f"__{t}").alias(f"__n{a}") for a, t in axes.items()])
    for a in axes:
        grid = grid.withColumn(a, F.explode(F.sequence(F.lit(0), F.col(f"__n{a}"))))
    grid = grid.drop(*[f"__n{a}" for a in axes])
    out = grid.join(places, [*by, *axes], "left").na.fill(0, list(counts))
    every = Window.partitionBy(*by)
    out = out.withColumns({f"all_{c}": F.sum(c).over(every) for c in counts}) if by else out
    for a in axes:
        along = Window.partitionBy(*by, *[x for x in axes if x != a]).orderBy(a).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumns({c: F.sum(c).over(along) for c in counts})
    return out


def passing_counts(rows: DataFrame, policies: DataFrame, a: str, b: str) -> DataFrame:
    """policies(t_a, t_b) -> (t_a, t_b, passing, total): how many rows have a >= t_a or b >= t_b.

    A row is placed by how many thresholds of each kind it reaches. A policy passes all rows but those in the corner of places
    below both of its thresholds, and running sums along both kinds give every corner at once, so a policy looks up one
    number. Nulls reach no threshold; without rows all counts are 0.
    """
    lists = policies.agg(*[F.array_sort(F.collect_set(F.col(t).cast("double"))).alias(f"__{t}") for t in ("t_a", "t_b")])
    axes = {"__ra": "t_a", "__rb": "t_b"}
    score = {"__ra": F.col(a).cast("double"), "__rb": F.col(b).cast("double")}
    places = rows.join(F.broadcast(lists)).groupBy(*[upper_bound(F.col(f"__{t}"), score[x]).alias(x) for x, t in axes.items()]).agg(F.count("*").alias("__n"))
    corners = _below(places, lists, [], axes, ["__n"])
    total = rows.agg(F.count("*").alias("total"))
    at = [F.array_position(F.col(f"__{t}"), F.col(t).cast("double")).cast("int").alias(x) for x, t in axes.items()]
    grid = policies.select("t_a", "t_b").distinct().join(F.broadcast(lists)).select("t_a", "t_b", *[(c - 1).alias(x) for c, x in zip(at, axes, strict=True)])
    out = grid.join(corners, list(axes)).join(F.broadcast(total))
    return out.select("t_a", "t_b", (F.col("total") - F.col("__n")).alias("passing"), "total")


def interval_maxima(samples: DataFrame, truth: DataFrame, *, scores: Sequence[str], tol: int, width: int) -> DataFrame:
    """Each interval with the maxima of scores inside, exactly and with tol: <score>_in, <score>_near."""
    pairs = points_in_intervals(samples.select(KEY, "ts_us", *scores), truth, width=width, tol=tol)
    exact = F.col("ts_us").between(F.col("i_start_us"), F.col("i_end_us"))
    aggs = [F.max(F.when(exact, F.col(s))).alias(f"{s}_in") for s in scores] + [F.max(s).alias(f"{s}_near") for s in scores]
    best = pairs.groupBy(KEY, F.col("i_interval_id").alias("interval_id")).agg(*aggs)
    return truth.join(best, [KEY, "interval_id"], "left")


def interval_peaks(samples: DataFrame, truth: DataFrame, *, scores: Sequence[str], width: int) -> DataFrame:
    """Greatest value of each score inside each interval, and its earliest time."""
    pairs = points_in_intervals(samples.select(KEY, "ts_us", *scores), truth, width=width)
    best = pairs.groupBy(KEY, F.col("i_interval_id").alias("interval_id")).agg(*[F.max(F.struct(F.col(s).alias("v"), (-F.col("ts_us")).alias("t"))).alias(s) for s in scores])
    return best.select(KEY, "interval_id", *[F.col(f"{s}.v").alias(f"{s}_peak") for s in scores], *[(-F.col(f"{s}.t")).alias(f"{s}_peak_us") for s in scores])


def evaluate_thresholds(samples: DataFrame, truth: DataFrame, policies: DataFrame, *, tol: int, width: int) -> DataFrame:
    """policies(t_a, t_b) -> per policy: intervals detected exactly and with tol, recalls, candidates and their rate."""
    maxima = interval_maxima(samples, truth, scores=("a", "b"), tol=tol, width=width)
    exact = passing_counts(maxima, policies, "a_in", "b_in").withColumnsRenamed({"passing": "detected", "total": "n_intervals"})
    near = passing_counts(maxima, policies, "a_near", "b_near").select("t_a", "t_b", F.col("passing").alias("detected_near"))
    counts = passing_counts(samples, policies, "a", "b").withColumnsRenamed({"passing": "n_candidates", "total": "n_samples"})
    out = exact.join(near, ["t_a", "t_b"]).join(counts, ["t_a", "t_b"])
    return out.withColumns({"recall": ratio(F.col("detected"), F.col("n_intervals")), "recall_near": ratio(F.col("detected_near"), F.col("n_intervals")), "candidate_rate": ratio(F.col("n_candidates"), F.col("n_samples"))})


def recall_breakdown(hits: DataFrame) -> DataFrame:
    """hits(category, severity, detected) -> counts and recall by category, by severity, and over all."""
    by = hits.where("category is not null or severity is not null").groupingSets([["category"], ["severity"], []], "category", "severity")
    out = by.agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.count_if("detected").alias("n_detected"))
    level = F.when(F.col("g") == 1, "category").when(F.col("g") == 2, "severity").otherwise("all")
    return out.select(level.alias("level"), F.coalesce("category", "severity").alias("value"), "n", "n_detected", ratio(F.col("n_detected"), F.col("n")).alias("recall"))


def candidate_rates(samples: DataFrame, candidate: Column, truth: DataFrame, *, width: int) -> DataFrame:
    """Per media: samples, candidates, candidates inside the union of truth, and the share of them."""
    inside = points_in_intervals(samples.select(KEY, "sample_id", "ts_us"), truth, width=width).select(KEY, "sample_id").distinct().withColumn("inside", F.lit(True))
    rows = samples.withColumn("candidate", candidate).join(inside, [KEY, "sample_id"], "left")
    out = rows.groupBy(KEY).agg(F.count("*").alias("n"), F.count_if("candidate").alias("n_candidates"), F.count_if(F.col("candidate") & F.col("inside")).alias("n_inside"))
    return out.withColumn("rate", ratio(F.col("n_candidates"), F.col("n"))).withColumn("precision", ratio(F.col("n_inside"), F.col("n_candidates")))


def workload(points: DataFrame, *, context: int, gap: int, images: int = 6) -> DataFrame:
    """Windows of points widened by context and merged within gap: number, total, mean, median, longest, share, images."""
    rows = points.select(KEY, "duration_us", F.greatest(F.lit(0), F.col("ts_us") - context).alias("start_us"), F.least(F.col("duration_us"), F.col("ts_us") + context).alias("end_us"))
    merged = merge_intervals(rows, gap=gap, on_empty="keep", carry={"duration_us": "max"}).withColumn("len", F.col("end_us") - F.col("start_us"))
    out = merged.groupBy(KEY).agg(F.count("*").alias("n_windows"), F.sum("len").alias("total_us"), F.avg("len").alias("mean_us"), F.percentile("len", 0.5).alias("median_us"), F.max("len").alias("longest_us"), F.max("duration_us").alias("duration_us"))
    return out.withColumn("media_fraction", ratio(F.col("total_us"), F.col("duration_us"))).withColumn("images", F.col("n_windows") * images).drop("duration_us")


def population_masks(samples: DataFrame, truth: DataFrame, categories: Sequence[str], *, width: int) -> DataFrame:
    """Samples once for each population they are in: all, inside:<category>, outside."""
    inside = points_in_intervals(samples.select(KEY, "sample_id", "ts_us"), truth, width=width)
    flags = inside.groupBy(KEY, "sample_id").agg(*[F.bool_or(F.col("i_category") == c).alias(f"__{c}") for c in categories])
    rows = samples.join(flags, [KEY, "sample_id"], "left")
    held = F.array_compact(F.array(F.lit("all"), *[F.when(F.col(f"__{c}"), F.lit(f"inside:{c}")) for c in categories], F.when(F.col(f"__{categories[0]}").isNull(), F.lit("outside"))))
    return rows.withColumn("population", F.explode(held)).drop(*[f"__{c}" for c in categories])


def score_distribution(rows: DataFrame, scores: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Per group and score: n, minimum, median, p90, p95, p99 (exact, linear between ranks), maximum."""
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).cast("double").alias("v")) for s in scores])).alias("x")
    long = rows.select(*by, pairs).select(*by, "x.score", "x.v")
    q = [("median", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)]
    return long.groupBy(*by, "score").agg(F.count("v").alias("n"), F.min("v").alias("least"), *[F.percentile("v", p).alias(n) for n, p in q], F.max("v").alias("most"))


def observed_threshold_grid(samples: DataFrame, column: str, n: int) -> DataFrame:
    """Distinct values at n evenly spaced ranks (rounded half to even) of the sorted column."""
    some = samples.where(F.col(column).isNotNull()).select(F.col(column).alias("threshold"))
    # distinct values in ranges of about the same size: a task sums one range, or one number of each range
    ranges = max(2, int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    edges = sorted({e for e in some.approxQuantile("threshold", [i / ranges for i in range(1, ranges)], min(0.001, 0.1 / ranges))})
    part = upper_bound(F.array(*[F.lit(e) for e in edges]).cast("array<double>"), F.col("threshold").cast("double"))
    values = some.groupBy("threshold").agg(F.count("*").alias("n")).withColumn("part", part)
    parts = values.groupBy("part").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    upto = values.join(F.broadcast(parts), "part").withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("threshold")))
    place = lambda i: F.bround(i * (F.col("total") - 1) / (n - 1)).cast("bigint")
    held = F.exists(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (place(i) >= F.col("upto") - F.col("n")) & (place(i) < F.col("upto")))
    return upto.where(held).select("threshold")


def rank_policies(table: DataFrame, *, least_recall: float | None = None, full: bool = False) -> DataFrame:
    """Policies by falling recall, then fewer candidates, then thresholds; full keeps those that miss nothing."""
    rows = table.where(F.col("detected") == F.col("n_intervals")) if full else table
    rows = rows if least_recall is None else rows.where(F.col("recall") >= least_recall)
    order = Window.orderBy(F.col("recall").desc_nulls_last(), F.col("candidate_rate").asc_nulls_last(), "t_a", "t_b")
    return rows.withColumn("place", F.row_number().over(order))


def best_policy(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The policy of least (missed, candidate rate, thresholds)."""
    key = F.struct((F.col("n_intervals") - F.col("detected")).alias("missed"), "candidate_rate", "t_a", "t_b")
    return table.groupBy(*by).agg(F.min(key).alias("best")).select(*by, "best.*")


def sampling_robustness(samples: DataFrame, truth: DataFrame, *, settings: Sequence[tuple[int, int]], t_a: float, width: int) -> DataFrame:
    """(gap, phase, retained, detected): for each setting (gap, phase), samples kept by phase sampling, and intervals in which one of
    them reaches t_a. Samples meet intervals once, whatever the number of settings."""
    grid = F.array(*[F.struct(F.lit(g).cast("bigint").alias("gap"), F.lit(p).cast("bigint").alias("phase")) for g, p in settings])
    rows = samples.select(KEY, "sample_id", "ts_us", "a", F.explode(grid).alias("x")).select(KEY, "sample_id", "ts_us", "a", "x.*")
    slot = F.floor((F.col("ts_us") - F.col("phase")) / F.col("gap"))
    # the first sample of each slot is the earliest: an aggregate, which combines before it is shuffled
    kept = rows.withColumn("__s", slot).where("__s >= 0").groupBy(KEY, "gap", "phase", "__s").agg(F.min(F.struct("ts_us", "sample_id", "a")).alias("m"))
    kept = kept.select(KEY, "gap", "phase", "m.*")
    n = kept.groupBy("gap", "phase").agg(F.count("*").alias("retained"))
    hot = points_in_intervals(samples.where(F.col("a") >= t_a).select(KEY, "sample_id", "ts_us"), truth, width=width).select(KEY, "sample_id", "ts_us", "i_interval_id")
    hits = kept.where(F.col("a") >= t_a).join(hot, [KEY, "sample_id", "ts_us"]).groupBy("gap", "phase").agg(F.count_distinct(F.struct(KEY, "i_interval_id")).alias("detected"))
    every = samples.sparkSession.createDataFrame(list(settings), "gap bigint, phase bigint").distinct()
    return every.join(n, ["gap", "phase"], "left").join(hits, ["gap", "phase"], "left").na.fill(0, ["retained", "detected"])


def worst_case(phases: DataFrame, total: int, by: Sequence[str] = ("gap",)) -> DataFrame:
    """Per gap the extremes over phases, the phases that miss one of total intervals, the first of them, the share of those that
    miss none, and robust: no phase misses one."""
    misses = F.col("detected") < total
    return phases.groupBy(*by).agg(
        F.count("*").alias("n_phases"), F.min("detected").alias("least_detected"), F.max("detected").alias("most_detected"), F.min("retained").alias("least_retained"), F.max("retained").alias("most_retained"), F.avg("retained").alias("mean_retained"),
        F.count_if(misses).alias("failing_phases"), F.min(F.when(misses, F.col("phase"))).alias("first_failing_phase"), F.avg((~misses).cast("double")).alias("success_rate"), (F.count_if(misses) == 0).alias("robust"),
    )


def largest_robust_gap(gaps: DataFrame) -> DataFrame:
    """The greatest gap of worst_case that is robust; null without one."""
    return gaps.agg(F.max(F.when(F.col("robust"), F.col("gap"))).alias("gap"))


def samplings(samples: DataFrame, gaps: Sequence[int], *, scene: bool = True, tie: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Samples with held: the names of the samplings that keep them, gap:<gap> (the first, then each first one at least gap
    after the last one kept) and, with scene, gap:<gap>+scene (those and all scene samples). One ordered pass for all gaps."""
    kept = held_by(samples, {f"gap:{g}": g for g in gaps}, "ts_us", tie)
    out = samples.join(kept, [KEY, *tie], "left").withColumn("held", F.coalesce("held", F.array().cast("array<string>")))
    if not scene:
        return out
    every = F.array(*[F.lit(f"gap:{g}+scene") for g in gaps])
    return out.withColumn("held", F.concat("held", F.when(F.col("scene"), every).otherwise(F.transform("held", lambda x: F.concat(x, F.lit("+scene"))))))


def sampling_names(gaps: Sequence[int], scene: bool = True) -> list[str]:
    return [f"gap:{g}" for g in gaps] + ([f"gap:{g}+scene" for g in gaps] if scene else [])


def union_policies(semantic: DataFrame, baselines: Sequence[tuple[str, float, float]]) -> DataFrame:
    """semantic(strategy, t_c, t_d) alone, each baseline (name, t_a, t_b) alone, and each of the one with each of the other.

    What a policy does not use is null, and its name is empty.
    """
    some = F.array(*[F.struct(F.lit(n).alias("baseline"), F.lit(float(a)).alias("t_a"), F.lit(float(b)).alias("t_b")) for n, a, b in baselines])
    none = F.struct(F.lit("").alias("baseline"), F.lit(None).cast("double").alias("t_a"), F.lit(None).cast("double").alias("t_b"))
    with_semantic = semantic.select("strategy", F.col("t_c").cast("double").alias("t_c"), F.col("t_d").cast("double").alias("t_d"), F.explode(F.concat(some, F.array(none))).alias("x"))
    alone = semantic.sparkSession.range(1).select(F.lit("").alias("strategy"), F.lit(None).cast("double").alias("t_c"), F.lit(None).cast("double").alias("t_d"), F.explode(some).alias("x"))
    return with_semantic.unionByName(alone).select("x.baseline", "strategy", "x.t_a", "x.t_b", "t_c", "t_d")


#: Thresholds of a union policy by the score that they bound.
_PARTS = {"a": "t_a", "b": "t_b", "c": "t_c", "d": "t_d"}
#: Up to so many thresholds are compared one by one, in compiled code; more by bisection, which Spark interprets.
_FEW = 128


def _policy_counts(rows: DataFrame, policies: DataFrame, counts: Mapping[str, Column]) -> DataFrame:
    """rows(config, strategy, a, b, c, d) -> counts of the rows that each policy of their strategy takes, by config.

    As passing_counts: a row is placed by how many thresholds of each kind it reaches, and a policy looks up the corner below.
    """
    lists = policies.groupBy("strategy").agg(*[F.array_sort(F.collect_set(F.col(t).cast("double"))).alias(f"__{t}") for t in _PARTS.values()])
    axes = {f"__r{s}": t for s, t in _PARTS.items()}
    if (lists.agg(F.sum(sum(F.size(f"__{t}") for t in _PARTS.values()))).first()[0] or 0) <= _FEW:
        few = lists.collect()
        count = lambda s, values: sum((F.coalesce(F.col(s).cast("double") >= v, F.lit(False)).cast("int") for v in values), F.lit(0))
        pick = lambda s, t: F.coalesce(F.lit(None).cast("int"), *[F.when(F.col("strategy") == r["strategy"], count(s, r[f"__{t}"])) for r in few])
        reached = [pick(s, t).alias(f"__r{s}") for s, t in _PARTS.items()]
        rows = rows.where(F.col("strategy").isin([r["strategy"] for r in few]))
    else:
        reached = [upper_bound(F.col(f"__{t}"), F.col(s).cast("double")).alias(f"__r{s}") for s, t in _PARTS.items()]
        rows = rows.join(F.broadcast(lists), "strategy")
    places = rows.select("config", "strategy", *reached, *[x.cast("bigint").alias(c) for c, x in counts.items()])
    places = stored(places.groupBy("config", "strategy", *axes).agg(*[F.sum(c).alias(c) for c in counts]), "places")
    some = lists.join(places.select("config").distinct())
    corners = _below(places, some, ["config", "strategy"], axes, list(counts))
    # the corner below a threshold; a part that a policy does not use is below in all places
    below = [F.coalesce(F.array_position(F.col(f"__{t}"), F.col(t).cast("double")).cast("int") - 1, F.size(f"__{t}")).alias(x) for x, t in axes.items()]
    grid = policies.join(F.broadcast(lists), "strategy").select("baseline", "strategy", *_PARTS.values(), *below)
    out = grid.join(corners, ["strategy", *axes])
    return out.select("config", "baseline", "strategy", *_PARTS.values(), *[(F.col(f"all_{c}") - F.col(c)).alias(c) for c in counts], *[f"all_{c}" for c in counts])


def evaluate_union(samples: DataFrame, truth: DataFrame, policies: DataFrame, strategies: Mapping[str, tuple[str, str]], *, tol: int, width: int, configs: Sequence[str] = ()) -> DataFrame:
    """Per policy (union_policies): intervals detected exactly and with tol, candidates, those inside an interval, and rates.

    A sample is a candidate if a >= t_a, b >= t_b, or one of the strategy's two columns reaches t_c or t_d. configs: names of
    samplings; with them the strategy's columns count only where the sample's held has the name, and each config has its own
    rows (config is "all" otherwise). Samples meet intervals once; each sampling costs a pass over counts, not over pairs.
    """
    names = list(configs) or ["all"]
    seen = F.array_contains("held", F.col("config")) if configs else F.lit(True)
    columns = sorted({c for pair in strategies.values() for c in pair})
    scores = ["a", "b", *columns]
    kept = [KEY, "sample_id", "ts_us", *scores, *(["held"] if configs else [])]
    # samples, their pairs and the maxima are read several times below: each is made once
    rows = stored(samples.select(*[c for c in dict.fromkeys(kept)]), "union-samples")
    each = F.explode(F.array(*[F.lit(n) for n in names])).alias("config")
    ways = [("", None, None), *((n, *pair) for n, pair in strategies.items())]

    def long(df: DataFrame, end: str, also: Sequence[str] = ()) -> DataFrame:
        """A row for each strategy, with its two columns as c and d."""
        pick = lambda c: (F.col(f"{c}{end}") if c else F.lit(None)).cast("double")
        parts = F.array(*[F.struct(F.lit(n).alias("strategy"), pick(c).alias("c"), pick(e).alias("d")) for n, c, e in ways])
        return df.select("config", F.col(f"a{end}").cast("double").alias("a"), F.col(f"b{end}").cast("double").alias("b"), *also, F.explode(parts).alias("x")).select("config", "a", "b", *also, "x.*")

    pairs = stored(points_in_intervals(rows, truth.select(KEY, "interval_id", "start_us", "end_us"), width=width, tol=tol), "union-pairs")
    exact = F.col("ts_us").between(F.col("i_start_us"), F.col("i_end_us"))
    by_config = lambda df: df.select("*", each).withColumns({c: F.when(seen, F.col(c)) for c in columns})
    best = by_config(pairs).groupBy("config", KEY, F.col("i_interval_id").alias("interval_id"))
    best = best.agg(*[F.max(F.when(exact, F.col(s))).alias(f"{s}_in") for s in scores], *[F.max(s).alias(f"{s}_near") for s in scores])
    maxima = stored(truth.select(KEY, "interval_id", each).join(best, ["config", KEY, "interval_id"], "left"), "union-maxima")
    one = F.lit(1)
    found = _policy_counts(long(maxima, "_in"), policies, {"detected": one}).withColumnRenamed("all_detected", "n_intervals")
    near = _policy_counts(long(maxima, "_near"), policies, {"detected_near": one}).drop("all_detected_near")
    inside = pairs.where(exact).select(KEY, "sample_id").distinct().withColumn("inside", F.lit(1))
    flagged = by_config(rows.join(inside, [KEY, "sample_id"], "left")).withColumn("kept", F.coalesce(seen, F.lit(False)).cast("int"))
    taken = _policy_counts(long(flagged, "", ("inside", "kept")), policies, {"n_candidates": one, "n_inside": F.coalesce("inside", F.lit(0)), "n_retained": F.col("kept")})
    taken = taken.drop("all_n_inside", "n_retained").withColumnsRenamed({"all_n_candidates": "n_samples", "all_n_retained": "n_retained"})
    # thresholds may be null, so the tables meet by names and a text of the thresholds
    on = ["config", "policy"]
    name = F.to_json(F.struct("baseline", "strategy", *_PARTS.values()))
    out = taken.withColumn("policy", name)
    for t in (found, near):
        out = out.join(t.withColumn("policy", name).drop("baseline", "strategy", *_PARTS.values()), on)
    rates = {"recall": ratio(F.col("detected"), F.col("n_intervals")), "recall_near": ratio(F.col("detected_near"), F.col("n_intervals")), "candidate_rate": ratio(F.col("n_candidates"), F.col("n_samples")), "precision": ratio(F.col("n_inside"), F.col("n_candidates"))}
    return out.withColumns(rates).drop("policy")


def union_workload(samples: DataFrame, policies: DataFrame, strategies: Mapping[str, tuple[str, str]], grid: Sequence[tuple[int, int]], *, images: int = 6, tie: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Per media, policy and (context, gap): windows of its candidates widened by context and merged within gap, their total
    time, mean, share of the media, and images.

    A candidate stands once for each policy that takes it; the whole grid of contexts and gaps is one aggregate over the times
    between candidates. policies is a table of settings and is broadcast. samples need duration_us.
    """
    named = policies.select(F.struct("baseline", "strategy", *_PARTS.values()).alias("p"))
    score = lambda p, i: F.coalesce(*[F.when(p["strategy"] == n, F.col(pair[i]).cast("double")) for n, pair in strategies.items()])
    hit = lambda x: F.coalesce(x, F.lit(False))
    takes = lambda p: hit(F.col("a") >= p["t_a"]) | hit(F.col("b") >= p["t_b"]) | hit(score(p, 0) >= p["t_c"]) | hit(score(p, 1) >= p["t_d"])
    rows = samples.join(F.broadcast(named.agg(F.collect_list("p").alias("ps")))).withColumn("p", F.explode(F.filter("ps", takes)))
    w = Window.partitionBy(KEY, "p").orderBy("ts_us", *tie)
    rows = rows.select(KEY, "p", "ts_us", "duration_us", F.lag("ts_us").over(w).alias("before"))
    end = lambda t, c: F.least("duration_us", t + c)
    aggs = []
    for c, g in grid:
        start, last = F.greatest(F.lit(0), F.col("ts_us") - c), end(F.col("before"), c)
        fresh = F.col("before").isNull() | (start > last + g)
        aggs += [F.struct(F.lit(c).alias("context"), F.lit(g).alias("gap"), F.count_if(fresh).alias("n_windows"), F.sum(end(F.col("ts_us"), c) - F.when(fresh, start).otherwise(last)).alias("total_us"))]
    out = rows.groupBy("p", KEY).agg(F.max("duration_us").alias("duration_us"), F.array(*aggs).alias("x")).withColumn("x", F.explode("x")).select(KEY, "p.*", "x.*", "duration_us")
    return out.withColumns({"mean_us": ratio(F.col("total_us"), F.col("n_windows")), "media_fraction": ratio(F.col("total_us"), F.col("duration_us")), "images": F.col("n_windows") * images}).drop("duration_us")


def sampling_summary(table: DataFrame, *, full_seconds: float | None = None) -> DataFrame:
    """Per config of evaluate_union: samples kept, reduction factor, the time of scoring them if all take full_seconds (in
    proportion), how many policies with a strategy miss nothing, and of those the one of the least candidate rate."""
    exact = (F.col("n_intervals") > 0) & (F.col("detected") == F.col("n_intervals")) & (F.col("strategy") != "") & (F.col("baseline") != "")
    best = F.min(F.when(exact, F.struct("candidate_rate", "baseline", "strategy", "t_c", "t_d")))
    out = table.groupBy("config").agg(F.max("n_retained").alias("n_retained"), F.max("n_samples").alias("n_samples"), F.count_if(exact).alias("n_exact"), best.alias("best"))
    out = out.withColumn("reduction", ratio(F.col("n_samples"), F.col("n_retained")))
    seconds = F.lit(full_seconds).cast("double") * ratio(F.col("n_retained"), F.col("n_samples"))
    return out.withColumn("seconds", seconds).select("config", "n_retained", "reduction", "seconds", "n_exact", "best.*")


def resolve_policy(summary: DataFrame, baselines: DataFrame, config: str) -> DataFrame:
    """The policy that a saved summary gives as best for a config, with its baseline's thresholds; an error if there is none.

    summary as sampling_summary gives it, baselines(baseline, t_a, t_b).
    """
    held = summary.where((F.col("config") == config) & (F.col("n_exact") > 0)).join(baselines.select("baseline", "t_a", "t_b"), "baseline")
    one = held.groupBy().agg(F.count("*").alias("n"), F.first(F.struct("config", "baseline", "t_a", "t_b", "strategy", "t_c", "t_d", "candidate_rate")).alias("p"))
    checked = F.when(F.col("n") == 1, F.col("p")).otherwise(F.raise_error(F.lit(f"no single policy of {config} misses nothing")).cast(one.schema["p"].dataType))
    return one.select(checked.alias("p")).select("p.*")

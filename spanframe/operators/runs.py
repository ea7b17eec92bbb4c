"""Runs, attempts and results: latest state, idempotent upserts, resuming, comparison, leakage, selection, validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from .stats import attach, exact_percentile, value_ranks


def latest_attempt(attempts: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last attempt of each key, and how many there were."""
    w = Window.partitionBy(*by)
    rows = attempts.withColumn("__n", F.row_number().over(w.orderBy(*[F.col(c).desc() for c in order]))).withColumn("n_attempts", F.count("*").over(w))
    return rows.where("__n = 1").drop("__n")


def upsert_results(base: DataFrame, new: DataFrame, by: Sequence[str], *, completed: str = "completed", order: Sequence[str]) -> DataFrame:
    """One row a key: a completed one before others, then the later."""
    both = base.unionByName(new)
    w = Window.partitionBy(*by).orderBy(F.col(completed).desc(), *[F.col(c).desc() for c in order])
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def resume_pending(plan: DataFrame, checkpoints: DataFrame, by: Sequence[str], *, usable: Column) -> DataFrame:
    """Planned keys without a usable checkpoint."""
    return plan.join(checkpoints.where(usable).select(*by), list(by), "left_anti")


def decide(items: DataFrame, configs: DataFrame, results: DataFrame) -> DataFrame:
    """Every item under every config, with its result or nulls; configs are broadcast up to 10,000."""
    return items.join(F.broadcast(configs) if configs.count() <= 10_000 else configs).join(results, ["item_id", "config"], "left")


def disjoint(items: DataFrame, pilot: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Items that share any of the columns with the pilot: leakage."""
    found = None
    for c in columns:
        hit = items.join(pilot.where(F.col(c).isNotNull()).select(c), c, "left_semi").select(items.columns)
        found = hit if found is None else found.unionByName(hit)
    return found.distinct()


def compare_runs(runs: Mapping[str, DataFrame] | Sequence[DataFrame], by: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Items that all runs have: whether each field is equal in all of them (nulls are equal), and whether all fields are.

    One pass over the union: an item that every run has, and whose least and greatest value of a field are the same, has it equal. An
    item that a run repeats is compared with all its rows."""
    tables = list(runs.values()) if isinstance(runs, Mapping) else list(runs)
    both = None
    for i, t in enumerate(tables):
        t = t.select(*by, *fields, F.lit(i).alias("__run"))
        both = t if both is None else both.unionByName(t)
    # null stands apart from every value. No distinct counts: they would multiply the rows by the fields
    one = {f"same_{c}": F.when(F.count(c) == F.count("*"), F.min(c) == F.max(c)).otherwise(F.count(c) == 0) for c in fields}
    had = [F.max(F.col("__run") == i).alias(f"__had_{i}") for i in range(len(tables))]
    out = both.groupBy(*by).agg(*had, *[v.alias(k) for k, v in one.items()])
    every = F.lit(True)
    for k in one:
        every = every & F.col(k)
    return out.where(" and ".join(f"__had_{i}" for i in range(len(tables)))).drop(*[f"__had_{i}" for i in range(len(tables))]).withColumn("same", every)


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of only one side, tagged; empty if the sides are equal sets."""
    return a.subtract(b).withColumn("side", F.lit("first")).unionByName(b.subtract(a).withColumn("side", F.lit("second")))


def attempt_outcome(worker: DataFrame, parent: DataFrame, by: Sequence[str]) -> DataFrame:
    """One status of two views of a run: the parent's intervention wins, then the worker's own, then the parent's or failed."""
    w, p = worker.withColumnRenamed("status", "__w"), parent.withColumnRenamed("status", "__p")
    out = w.join(p, list(by), "full")
    status = F.when(F.coalesce(F.col("intervened"), F.lit(False)), F.col("__p")).when(F.col("__w").isNotNull(), F.col("__w")).otherwise(F.coalesce("__p", F.lit("failed")))
    return out.select(*by, status.alias("status"))


def job_state(events: DataFrame, by: Sequence[str], *, seq: str) -> DataFrame:
    """Current status, first start and terminal time of an event log."""
    terminal = F.col("status").isin("completed", "failed", "cancelled")
    return events.groupBy(*by).agg(F.max_by("status", seq).alias("status"), F.min(F.when(F.col("status") == "processing", F.col("at_us"))).alias("started_us"), F.max(F.when(terminal, F.col("at_us"))).alias("ended_us"), F.count("*").alias("n_events"))


def batch_reliability(planned: DataFrame, events: DataFrame, by: Sequence[str], *, seq: str = "seq") -> DataFrame:
    """Per run the numbers of its batches by what its journal shows: planned, started, unprocessed (planned, never started),
    unfinished (started, without an end), completed, failed, cancelled, invalid and repaired.

    events(by, batch, kind, seq): kinds started, completed, failed, cancelled, and invalid, an answer of another form. A batch
    ends with the last of its ends; it is invalid if an invalid answer stands before that end, and repaired if it then completed.
    Runs without a plan have null planned and unprocessed, and runs without events count none.
    """
    ends = F.col("kind").isin("completed", "failed", "cancelled")
    each = events.groupBy(*by, "batch").agg(
        F.bool_or(F.col("kind") == "started").alias("began"), F.max_by(F.when(ends, F.col("kind")), F.when(ends, F.col(seq))).alias("end"),
        F.max(F.when(ends, F.col(seq))).alias("ended"), F.min(F.when(F.col("kind") == "invalid", F.col(seq))).alias("bad"),
    )
    plan = planned.select(*by, "batch").distinct().withColumn("known", F.lit(True))
    both = each.join(plan, [*by, "batch"], "full")
    invalid = F.col("bad").isNotNull() & F.col("end").isNotNull() & (F.col("bad") < F.col("ended"))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    counts = {
        "planned": n(F.col("known")), "started": n(F.col("began")), "unprocessed": n(F.col("known") & ~F.coalesce("began", F.lit(False))), "unfinished": n(F.col("began") & F.col("end").isNull()),
        "completed": n(F.col("end") == "completed"), "failed": n(F.col("end") == "failed"), "cancelled": n(F.col("end") == "cancelled"), "invalid": n(invalid), "repaired": n(invalid & (F.col("end") == "completed")),
    }
    out = both.groupBy(*by).agg(*[c.alias(k) for k, c in counts.items()])
    return out.withColumns({c: F.when(F.col("planned") > 0, F.col(c)) for c in ("unprocessed", "planned")})


def stage_spans(events: DataFrame, by: Sequence[str], elapsed: str, *, seq: str | None = None) -> DataFrame:
    """Per stage the time from its first to its last event, and with seq whether time never runs back along it (in_order)."""
    if seq is None:
        return events.groupBy(*by).agg((F.max(elapsed) - F.min(elapsed)).alias("span"), F.count("*").alias("n"))
    back = F.col(elapsed) < F.lag(elapsed).over(Window.partitionBy(*by).orderBy(seq))
    rows = events.withColumn("__back", F.coalesce(back, F.lit(False)))
    return rows.groupBy(*by).agg((F.max(elapsed) - F.min(elapsed)).alias("span"), F.count("*").alias("n"), (~F.bool_or("__back")).alias("in_order"))


def reliability_rollup(rows: DataFrame, group: str, category: str) -> DataFrame:
    """Counts of completed, failed and unknown by group, by category, and over all."""
    g = rows.groupingSets([[group], [category], []], group, category).agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.count_if("completed").alias("n_completed"), F.count_if(~F.col("completed")).alias("n_failed"))
    level = F.when(F.col("g") == 1, group).when(F.col("g") == 2, category).otherwise("all")
    return g.select(level.alias("level"), F.coalesce(F.col(group).cast("string"), F.col(category).cast("string")).alias("value"), "n", "n_completed", "n_failed")


def benchmark_aggregate(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """runs(wall_us, media_us, valid): numbers of runs, and the median, least and greatest wall time and the median throughput
    (media over wall) of the valid ones; null where none is. A null in valid counts as invalid. Medians are exact, of groups of any size."""
    good = F.coalesce("valid", F.lit(False))
    wall = F.when(good, F.col("wall_us"))
    out = runs.groupBy(*by).agg(F.count("*").alias("n_runs"), F.count_if(good).alias("n_valid"), F.min(wall).alias("least_wall_us"), F.max(wall).alias("most_wall_us"))
    for name, value in (("wall_us", wall), ("throughput", ratio(F.col("media_us"), wall))):
        ranked = value_ranks(runs.select(*by, value.alias("__v")), "__v", by)
        out = attach(out, ranked.groupBy(*by).agg(exact_percentile("__v", 0.5).alias(f"median_{name}")), by)
    out = out.select(*by, "n_runs", "n_valid", "median_wall_us", "least_wall_us", "most_wall_us", "median_throughput")
    return out.withColumn("n_invalid", F.col("n_runs") - F.col("n_valid"))


#: What becomes of a sample, with the names of its counts.
DISPOSITIONS = {"black": "n_black", "near_duplicate": "n_duplicates", "static_suppressed": "n_static", "representative": "n_representatives"}


def disposition_stats(samples: DataFrame, by: Sequence[str], *, reasons: str = "reasons") -> DataFrame:
    """Counts of samples by reason (temporal, scene; a sample may have both) and by disposition, and accounted: every sample has
    one of the four dispositions."""
    held = lambda r: F.count_if(F.coalesce(F.array_contains(reasons, r), F.lit(False)))
    counts = [F.count_if(F.coalesce(F.col("disposition") == d, F.lit(False))).alias(n) for d, n in DISPOSITIONS.items()]
    out = samples.groupBy(*by).agg(F.count("*").alias("n"), held("temporal").alias("n_temporal"), held("scene").alias("n_scene"), *counts)
    named = F.lit(0)
    for n in DISPOSITIONS.values():
        named = named + F.col(n)
    return out.withColumn("accounted", named == F.col("n"))


#: Statuses that end a run.
TERMINAL = ("completed", "partial", "failed", "cancelled")


def validate_run_records(attempts: DataFrame, manifest: DataFrame, *, digest: str, tol: float = 1e-6) -> DataFrame:
    """Each attempt with its problems, and the status it counts with: interrupted_unknown where it has none.

    attempts(item_id, attempt_id, manifest_digest, config_digest, effective_digest, environment_digest, status, seconds),
    manifest(item_id, seconds), digest: the manifest's own. Problems: unknown_item, repeated_item, manifest_mismatch,
    config_mismatch, bad_status, duration_mismatch (more than tol apart), and mixed_configurations or mixed_environments,
    which concern the whole report. Nulls differ from what they should equal; an environment may be unknown.
    """
    known = manifest.select("item_id", F.col("seconds").alias("__seconds"), F.lit(True).alias("__known"))
    whole = attempts.agg(*[F.min(c).alias(f"__least_{c}") for c in ("config_digest", "environment_digest")], *[F.max(c).alias(f"__most_{c}") for c in ("config_digest", "environment_digest")])
    rows = attempts.withColumn("__n", F.count("*").over(Window.partitionBy("item_id"))).join(known, "item_id", "left").join(F.broadcast(whole))
    unlike = lambda a, b: ~a.eqNullSafe(b)
    rules = {
        "unknown_item": F.col("__known").isNull(), "repeated_item": F.col("__n") > 1, "manifest_mismatch": unlike(F.col("manifest_digest"), F.lit(digest)),
        "config_mismatch": unlike(F.col("config_digest"), F.col("effective_digest")), "bad_status": F.col("status").isNotNull() & ~F.col("status").isin(*TERMINAL),
        "duration_mismatch": F.col("status").isNotNull() & F.col("__known").isNotNull() & F.coalesce(F.abs(F.col("seconds") - F.col("__seconds")) > tol, F.lit(True)),
        "mixed_configurations": F.coalesce(F.col("__least_config_digest") != F.col("__most_config_digest"), F.lit(False)),
        "mixed_environments": F.coalesce(F.col("__least_environment_digest") != F.col("__most_environment_digest"), F.lit(False)),
    }
    problems = F.array_compact(F.array(*[F.when(x, F.lit(n)) for n, x in rules.items()]))
    return rows.select("item_id", "attempt_id", F.coalesce("status", F.lit("interrupted_unknown")).alias("status"), problems.alias("problems"))


def check_rules(df: DataFrame, rules: Mapping[str, Column], mode: str = "flag") -> DataFrame:
    """problems: names of rules that do not hold (a null rule does not). mode: flag, quarantine (only bad rows), pass (only
    good rows) or fail (an error at the first bad row)."""
    bad = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    out = df.withColumn("problems", bad)
    if mode == "quarantine":
        return out.where(F.size("problems") > 0)
    if mode == "pass":
        return out.where(F.size("problems") == 0).drop("problems")
    if mode == "fail":
        return out.withColumn("problems", F.when(F.size("problems") > 0, F.raise_error(F.concat(F.lit("broken rules: "), F.array_join("problems", ", "))).cast("array<string>")).otherwise(F.col("problems")))
    return out


def duplicates(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")


def split_groups(items: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that stand in more than one split."""
    return items.groupBy(group).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def label_cascade(df: DataFrame, categories: Column) -> DataFrame:
    """derived: excluded, else positive if any state is present, undecided if any is null, uncertain if any is, negative."""
    states = F.map_values(categories)
    has = lambda s: F.coalesce(F.exists(states, lambda x: x == s), F.lit(False))
    derived = F.when(F.col("excluded"), "excluded").when(has("present"), "positive").when(F.exists(states, lambda x: x.isNull()), "undecided").when(has("uncertain"), "uncertain").otherwise("negative")
    return df.withColumn("derived", derived)


def recent(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def recent_distinct(df: DataFrame, by: Sequence[str], key: str, at: str, n: int) -> DataFrame:
    """The n most recently used distinct keys of each group."""
    last = df.groupBy(*by, key).agg(F.max(at).alias("last"))
    return last.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("last").desc(), key))).where(F.col("place") <= n)


def disambiguate_labels(df: DataFrame, by: Sequence[str], label: str, source: str, order: str) -> DataFrame:
    """shown: the label, with the source where the label repeats, and a number where both do."""
    n_label = F.count("*").over(Window.partitionBy(*by, label))
    both = Window.partitionBy(*by, label, source)
    n_both, place = F.count("*").over(both), F.row_number().over(both.orderBy(order))
    with_source = F.concat(F.col(label), F.lit(" ("), F.col(source), F.lit(")"))
    shown = F.when(n_label == 1, F.col(label)).when(n_both == 1, with_source).otherwise(F.concat(with_source, F.lit(" "), place.cast("string")))
    return df.withColumn("shown", shown)

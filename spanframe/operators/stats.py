"""Decision rules and evaluation statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hash_draw, ratio, wilson
from ..shared import stored


def pipeline_alert(results: DataFrame) -> DataFrame:
    """alert: a completed run with at least one suggestion; null for runs that did not complete."""
    return results.withColumn("alert", F.when(F.col("status") == "completed", F.col("n_suggestions") > 0))


def score_alert(scores: DataFrame, tau: float, by: Sequence[str], score: str = "score", fallback: str = "fallback") -> DataFrame:
    """alert: any score of its own at or above tau; n_fallback counts scores that were filled in, which raise no alert."""
    own = ~F.col(fallback) & F.col(score).isNotNull()
    return scores.groupBy(*by).agg(F.coalesce(F.bool_or(own & (F.col(score) >= tau)), F.lit(False)).alias("alert"), F.count_if(fallback).alias("n_fallback"))


def confusion(rows: DataFrame, by: Sequence[str], *, failures: str = "exclude") -> DataFrame:
    """tp, fp, fn, tn of label ('positive', 'negative', other) and alert; null alerts are left out, or counted as the worst
    outcome (failures='worst'); n_uncertain and n_missing count what is not judged."""
    judged = F.col("label").isin("positive", "negative")
    alert = F.col("alert") if failures == "exclude" else F.coalesce("alert", F.col("label") == "negative")
    pos = F.col("label") == "positive"
    counts = {"tp": pos & alert, "fp": ~pos & judged & alert, "fn": pos & ~alert, "tn": ~pos & judged & ~alert}
    extra = {"n_uncertain": ~judged, "n_missing": judged & F.col("alert").isNull()}
    return rows.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in (counts | extra).items()])


def classification_metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall, specificity, F1, accuracy and balanced accuracy, with Wilson bounds of the first three."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = counts
    for name, k, n in (("precision", tp, tp + fp), ("recall", tp, tp + fn), ("specificity", tn, tn + fp)):
        low, high = wilson(k, n)
        out = out.withColumns({name: ratio(k, n), f"{name}_low": low, f"{name}_high": high})
    return out.withColumns({"f1": ratio(2 * tp, 2 * tp + fp + fn), "accuracy": ratio(tp + tn, tp + fp + fn + tn), "balanced_accuracy": (F.col("recall") + F.col("specificity")) / 2})


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided binomial test of discordant counts; null without any. Terms follow each other in logarithms."""
    n, k = b + c, F.least(b, c)
    start = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.lit(0.0).alias("sum"))
    step = lambda s, i: F.struct((s["term"] + F.when(i > 0, F.log((n - i + 1) / F.greatest(i, F.lit(1)))).otherwise(0.0)).alias("term"), s["sum"].alias("sum"))
    add = lambda s, i: F.struct(step(s, i)["term"].alias("term"), (s["sum"] + F.exp(step(s, i)["term"])).alias("sum"))
    return F.when(n > 0, F.least(F.lit(1.0), 2 * F.aggregate(F.sequence(F.lit(0).cast("bigint"), k.cast("bigint")), start, add, lambda s: s["sum"])))


def holm(tests: DataFrame, p: str = "p", name: str = "name", by: Sequence[str] = ()) -> DataFrame:
    """Step-down adjusted p values; nulls stay null and do not count."""
    some = F.col(p).isNotNull()
    w = Window.partitionBy(*by, some).orderBy(p, name)
    raw = F.least(F.lit(1.0), (F.count(p).over(Window.partitionBy(*by, some)) - F.row_number().over(w) + 1) * F.col(p))
    rows = tests.withColumn("__raw", raw)
    return rows.withColumn("adjusted", F.when(some, F.max("__raw").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("__raw")


def grouped_bootstrap(groups: DataFrame, sums: Sequence[str], statistic: Column, *, resamples: int, seed: str, level: float = 0.95) -> DataFrame:
    """Percentile interval of a statistic over sums, resampling whole groups with hashed draws.

    groups has a row a group (group_id) with its sufficient statistics, so a resample is how often it draws each group. Resamples
    are dealt over the tasks, and a group's sums are counted as often as it is drawn.
    """
    spark = groups.sparkSession
    # numbers in the order of ids: ranges are numbered apart, and only their sizes meet
    parts = stored(groups.repartitionByRange("group_id").withColumn("__range", F.spark_partition_id()), "groups")
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = parts.groupBy("__range").agg(F.count("*").alias("n")).select("__range", ahead.alias("__before"))
    place = F.col("__before") + F.row_number().over(Window.partitionBy("__range").orderBy("group_id")) - 1
    ranked = parts.join(sizes, "__range").withColumn("__g", place).drop("__range", "__before")
    size = parts.agg(F.count("*").alias("n"))
    draws = spark.range(1, resamples + 1).select(F.col("id").cast("int").alias("r")).join(F.broadcast(size)).where("n > 0").withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    draws = draws.select("r", (hash_draw(F.lit(seed), F.col("r").cast("string"), F.col("i").cast("string")) % F.col("n")).alias("__g"))
    draws = draws.groupBy("r", "__g").agg(F.count("*").alias("__times"))
    values = draws.join(ranked, "__g").groupBy("r").agg(*[F.sum(F.col(c) * F.col("__times")).alias(c) for c in sums]).select("r", statistic.alias("value"))
    tail = (1 - level) / 2
    return values.agg(F.percentile("value", tail).alias("low"), F.percentile("value", 1 - tail).alias("high"), F.count_if(F.col("value").isNull()).alias("n_undefined"), F.count("*").alias("n_resamples"))


def guard_interval(groups: Column, informative: Column) -> Column:
    """How an interval over groups may be shown: withheld without informative groups, caution below 5; and the chance that a
    resample has none of them."""
    p = F.pow(1 - informative / groups, groups)
    state = F.when(informative == 0, "withheld").when(informative < 5, "caution").otherwise("shown")
    return F.struct(state.alias("state"), p.alias("p_none"))


def paired_agreement(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """pairs(first, second): both, only one, or neither raised an alert, and the difference of their rates."""
    x, y = F.col("first"), F.col("second")
    out = pairs.groupBy(*by).agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("first_only"), F.count_if(~x & y).alias("second_only"), F.count_if(~x & ~y).alias("neither"))
    return out.withColumn("difference", ratio(F.col("second_only") - F.col("first_only"), F.col("both") + F.col("first_only") + F.col("second_only") + F.col("neither")))


#: Figures of a report that only complete verification allows, by the beginning of their names.
WITHHELD = ("precision", "recall", "specificity", "f1", "accuracy", "balanced_accuracy", "p_value", "event_")


def score_report(metrics: DataFrame, complete: Column, *, positives: Column | None = None) -> DataFrame:
    """metrics with complete, and null for every accuracy figure, its bounds, paired tests and event figures where it does not
    hold; withheld says why. Counts of alerts stay. positives: the number of positive reference labels; scope says that without any
    only specificity and false alerts can be measured."""
    hidden = [c for c in metrics.columns if c.startswith(WITHHELD)]
    out = metrics.withColumn("complete", F.coalesce(complete, F.lit(False))).withColumns({c: F.when(F.col("complete"), F.col(c)) for c in hidden})
    out = out.withColumn("withheld", F.when(~F.col("complete"), "reference labels do not cover every item"))
    return out if positives is None else out.withColumn("scope", F.when(F.coalesce(positives, F.lit(0)) == 0, "no positive labels: specificity and false alerts at most"))


def nearest_rank_summary(rows: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """n, sum, least, median, p90 by nearest rank (half to even on 0.9 (n - 1)), most, mean."""
    w = Window.partitionBy(*by).orderBy(column)
    ranked = rows.where(F.col(column).isNotNull()).withColumn("__r", F.row_number().over(w)).withColumn("__n", F.count("*").over(Window.partitionBy(*by)))
    p90 = F.max(F.when(F.col("__r") == F.bround(0.9 * (F.col("__n") - 1)) + 1, F.col(column)))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.sum(column).alias("total"), F.min(column).alias("least"), F.percentile(column, 0.5).alias("median"), p90.alias("p90"), F.max(column).alias("most"), F.avg(column).alias("mean"))


def value_ranks(rows: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """(by, column, __k, __upto, __n): the values of each group that are not null, how many rows have them, how many rows have them or
    less, and the group's rows. Numbered by ranges of values, so that no task holds a group, however large."""
    counted = rows.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("__k"))
    parts = stored(counted.repartitionByRange(*by, column).withColumn("__range", F.spark_partition_id()), "values")
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # as many rows as groups and ranges
    sums = parts.groupBy(*by, "__range").agg(F.sum("__k").alias("__s"))
    sums = sums.select(*by, "__range", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__before"), F.sum("__s").over(Window.partitionBy(*by)).alias("__n"))
    inside = Window.partitionBy(*by, "__range").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    ranked = attach(parts.withColumn("__inside", F.sum("__k").over(inside)), sums, (*by, "__range"))
    return ranked.select(*by, column, "__k", (F.col("__before") + F.col("__inside")).alias("__upto"), "__n")


def attach(rows: DataFrame, more: DataFrame, by: Sequence[str]) -> DataFrame:
    """rows with more's other columns, null keys included; by may be empty where more is one row."""
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    return rows.join(more.withColumnsRenamed({c: f"__of_{c}" for c in by}), on, "left").drop(*(f"__of_{c}" for c in by))


def _at(column: str, rank: Column) -> Column:
    """The value at a rank from 1, of the rows of value_ranks."""
    return F.max(F.when((F.col("__upto") - F.col("__k") < rank) & (F.col("__upto") >= rank), F.col(column)))


def exact_percentile(column: str, q: float) -> Column:
    """Aggregate over a group of value_ranks: what percentile gives, between neighbours at q (n - 1)."""
    place = q * (F.col("__n") - 1)
    lo, hi = _at(column, F.floor(place) + 1).cast("double"), _at(column, F.ceil(place) + 1).cast("double")
    up = F.max(place - F.floor(place))
    return F.when(lo == hi, lo).otherwise((1 - up) * lo + up * hi)


def _quartile(column: str, q: float) -> Column:
    rank = F.greatest(F.lit(1.0), F.least(F.col("__n") - 1.0, F.floor(q * (F.col("__n") + 1))))
    lo, hi = _at(column, rank), _at(column, rank + 1)
    return F.when(F.max("__n") > 1, lo + (hi - lo) * F.max(q * (F.col("__n") + 1) - rank))


def exclusive_quartiles(rows: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """First and third quartile at rank q (n + 1), between neighbours, for groups of two or more."""
    ranked = value_ranks(rows, column, by).where("__n > 1")
    return ranked.groupBy(*by).agg(_quartile(column, 0.25).alias("q1"), _quartile(column, 0.75).alias("q3"), F.max("__n").alias("n"))


def runtime_summary(runs: DataFrame, by: Sequence[str], *, compute: str, media: str, peak: str) -> DataFrame:
    """Runs, median, interquartile range, pooled real-time factor (sum over sum) and the greatest peak."""
    out = runs.groupBy(*by).agg(F.count("*").alias("n_runs"), ratio(F.sum(compute), F.sum(media)).alias("pooled_rtf"), F.max(peak).alias("peak"))
    iqr = _quartile(compute, 0.75) - _quartile(compute, 0.25)
    middle = value_ranks(runs, compute, by).groupBy(*by).agg(exact_percentile(compute, 0.5).alias("median"), iqr.alias("iqr"))
    return attach(out, middle, by).select(*by, "n_runs", "median", "pooled_rtf", "peak", "iqr")


def collapse_diagnostics(rows: DataFrame, text: str, order: str, by: Sequence[str], limit: float = 0.8) -> DataFrame:
    """Distinct outputs, the modal one (first seen on ties), its share, and whether that reaches limit."""
    n = rows.groupBy(*by, text).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    first = F.max(F.struct("n", (-F.col("seen")).alias("s"), F.col(text).alias("t")))
    out = n.groupBy(*by).agg(F.count("*").alias("n_distinct"), F.sum("n").alias("n_rows"), first.alias("m"))
    return out.select(*by, "n_distinct", F.col("m.t").alias("modal"), ratio(F.col("m.n"), F.col("n_rows")).alias("share")).withColumn("collapsed", F.col("share") >= limit)

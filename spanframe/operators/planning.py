"""Candidate planning and evidence fusion."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import columns as fn
from .intervals import merge_intervals, pad_and_clamp
from .timeline import KEY, gap_islands, ordered_pass, points_in_intervals, range_join

#: Thresholds of the prefilter by mode.
MODE_THRESHOLDS = {"fast": 0.45, "balanced": 0.15, "thorough": 0.15}
#: evaluate_clustering: rows of whole media that a task holds at once, about, and the most of one media that it holds as arrays.
_BLOCK, _HELD = 1 << 15, 1 << 20


def candidate_mask(df: DataFrame, t_a: float, t_b: float) -> DataFrame:
    return df.where((F.col("a") >= t_a) | (F.col("b") >= t_b))


def prefilter_gate(df: DataFrame, mode: Column, p: str = "a", included: str = "included") -> DataFrame:
    """Rows at or above their mode's threshold, and all that are included conservatively."""
    limit = F.coalesce(*[F.when(mode == m, F.lit(t)) for m, t in MODE_THRESHOLDS.items()])
    return df.where((F.col(p) >= limit) | F.col(included))


def semantic_trigger(df: DataFrame, t_w: float, t_d: float, available: str = "available") -> DataFrame:
    return df.withColumn("triggered", F.col(available) & ((F.col("a") >= t_w) | (F.col("b") >= t_d)))


def detector_tags(df: DataFrame, detectors: Mapping[str, Column], by: Sequence[str]) -> DataFrame:
    """Per group: detectors that fired anywhere (sorted) and the profile: the only one's name, 'both', or 'none'."""
    flags = df.withColumns({f"__{n}": c for n, c in detectors.items()}).groupBy(*by).agg(*[F.bool_or(f"__{n}").alias(f"__{n}") for n in detectors])
    tags = F.array_compact(F.array(*[F.when(F.col(f"__{n}"), F.lit(n)) for n in sorted(detectors)]))
    profile = F.when(F.size("tags") == 0, "none").when(F.size("tags") == 1, F.concat(F.col("tags")[0], F.lit("_only"))).otherwise("both")
    return flags.select(*by, tags.alias("tags")).withColumn("profile", profile)


def score(df: DataFrame, scorer: Callable[[pa.RecordBatch], pa.Array], *, observation: Observation | None = None) -> DataFrame:
    """probability, included and error of each row by a batch scorer; a batch that fails, or whose scores are not one finite number
    a row, gets 1.0, is included conservatively, and has the error's kind in error.

    observation: a pyspark.sql.Observation, which then holds, after the first action on the result and without a second pass, the
    numbers of batches, failed_batches, rows, scored and included (conservatively)."""
    more = [T.StructField("probability", T.DoubleType()), T.StructField("included", T.BooleanType()), T.StructField("error", T.StringType())]
    schema = T.StructType([*df.schema.fields, *more, T.StructField("__first", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            try:
                p, error = scorer(b).cast(pa.float64()), None
                if len(p) != n or p.null_count or not all(map(math.isfinite, p.to_pylist())):
                    raise ValueError("a scorer gives one finite number a row")
            except Exception as e:  # recall first: what cannot be scored is reviewed
                p, error = pa.array([1.0] * n), type(e).__name__
            yield pa.RecordBatch.from_arrays([*b.columns, p, pa.array([error is not None] * n), pa.array([error] * n, pa.string()), pa.array([i == 0 for i in range(n)])], names=schema.names)

    out = df.mapInArrow(run, schema)
    if observation is not None:
        n = lambda c: F.count_if(c)
        first, bad = F.col("__first"), F.col("included")
        out = out.observe(observation, n(first).alias("batches"), n(first & bad).alias("failed_batches"), F.count("*").alias("rows"), n(~bad).alias("scored"), n(bad).alias("included"))
    return out.drop("__first")


def concept_scores(samples: DataFrame, bank: DataFrame, *, scale: float = 100.0) -> DataFrame:
    """Cosine and scaled logit of each sample's vector to each prompt vector of a bank, which is broadcast up to 10,000 vectors."""
    pairs = samples.join(F.broadcast(bank) if bank.count() <= 10_000 else bank)
    return pairs.withColumn("cosine", fn.cosine(F.col("vector"), F.col("prompt"))).withColumn("logit", F.col("cosine") * scale).drop("vector", "prompt")


def concept_strategies(scores: DataFrame, positive: Sequence[str], control: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Per sample: maximum and mean over positive concepts, each also less the maximum over control concepts."""
    pos, neg = F.col("concept").isin(list(positive)), F.col("concept").isin(list(control))
    out = scores.groupBy(*by).agg(F.max(F.when(pos, F.col("cosine"))).alias("pos_max"), F.avg(F.when(pos, F.col("cosine"))).alias("pos_mean"), F.max(F.when(neg, F.col("cosine"))).alias("control_max"))
    return out.withColumns({"max_margin": F.col("pos_max") - F.col("control_max"), "mean_margin": F.col("pos_mean") - F.col("control_max")})


#: Entries of a bank or lexicon that go to every task.
MOST_ENTRIES = 10_000


def score_concepts(samples: DataFrame, bank: DataFrame, positive: Sequence[str], control: Sequence[str], *, ident: str, vector: str = "vector") -> DataFrame:
    """concept_strategies of all samples in one pass, without a row for each sample and prompt: the bank (concept, prompt), of up to
    MOST_ENTRIES prompts, is one matrix in each task. Of a concept with several prompts each counts.

    (ident, pos_max, pos_mean, control_max, max_margin, mean_margin); vectors that are null, of another length than the prompts, or
    of a norm of 0 or not finite have nulls. A larger bank, or prompts of several lengths, is a ValueError."""
    rows = bank.select("concept", F.transform("prompt", lambda x: x.cast("double")).alias("prompt")).limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES or len({len(r["prompt"]) for r in rows}) != 1:
        raise ValueError("a bank holds prompts of one length, and no more than MOST_ENTRIES")
    prompts = np.array([r["prompt"] for r in rows])
    prompts = prompts / np.linalg.norm(prompts, axis=1, keepdims=True)
    pos, neg = (np.array([r["concept"] in set(x) for r in rows]) for x in (positive, control))
    names = ("pos_max", "pos_mean", "control_max", "max_margin", "mean_margin")
    schema = T.StructType([samples.schema[ident], *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.full((b.num_rows, 3), np.nan)
            fits = [i for i, v in enumerate(b.column(1)) if v.is_valid and len(v) == prompts.shape[1] and not v.values.null_count]
            if fits:
                x = np.stack([b.column(1)[i].values.to_numpy() for i in fits])
                norm = np.linalg.norm(x, axis=1)
                fine = np.isfinite(norm) & (norm > 0)
                cosine = x[fine] / norm[fine, None] @ prompts.T
                at = np.array(fits)[fine]
                for i, (which, fold) in enumerate(((pos, np.max), (pos, np.mean), (neg, np.max))):
                    if which.any():
                        made[at, i] = fold(cosine[:, which], axis=1)
            columns = [made[:, 0], made[:, 1], made[:, 2], made[:, 0] - made[:, 2], made[:, 1] - made[:, 2]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, from_pandas=True) for c in columns)], names=schema.names)

    return samples.select(ident, F.transform(vector, lambda x: x.cast("double")).alias("v")).mapInArrow(run, schema)


def text_evidence(segments: DataFrame, lexicon: DataFrame, *, least: float, ident: Sequence[str], most: int = 80) -> DataFrame:
    """The lexicon entry of greatest confidence whose pattern a segment matches (first listed on ties), at least least.

    Only segments that match any pattern meet the lexicon: one alternation of all patterns tells them in one pass over the text.
    A lexicon of up to MOST_ENTRIES is broadcast; a larger one, or one whose patterns refer to groups, which an alternation
    would number anew, meets all segments."""
    patterns = [r["pattern"] for r in lexicon.select("pattern").where("pattern is not null").limit(MOST_ENTRIES + 1).collect()]
    few = len(patterns) <= MOST_ENTRIES
    if few and patterns and not any(re.search(r"\\[1-9k]|\(\?<[A-Za-z]", p) for p in patterns):
        segments = segments.where(F.regexp_like(F.lower("text"), F.lit("|".join(f"(?:{p})" for p in patterns))))
    hits = segments.join(F.broadcast(lexicon) if few else lexicon, F.expr("regexp_like(lower(text), pattern)"))
    best = F.row_number().over(Window.partitionBy(*ident).orderBy(F.col("confidence").desc(), "rank"))
    hits = hits.withColumn("__n", best).where((F.col("__n") == 1) & (F.col("confidence") >= least))
    return hits.withColumn("excerpt", fn.excerpt(F.col("text"), most)).drop("__n", "pattern", "rank", "text")


def text_windows(evidence: DataFrame) -> DataFrame:
    mid = F.expr("(start_us + end_us) div 2")
    return evidence.withColumns({"peak": F.lit(0.0), "evidence_us": F.array(mid), "trigger": F.lit("text")})


def group_candidate_windows(scores: DataFrame, text: DataFrame, media: DataFrame, *, threshold: float, gap: int, pad: int, longest: int, least: int = 1000) -> DataFrame:
    """Windows for review: points at or above threshold (a; or included) and text windows merge within gap, are padded,
    merge again, are at least least long, and split at longest; evidence goes to the piece that holds it."""
    dur = media.select(KEY, "duration_us")
    points = scores.where((F.col("a") >= threshold) | F.col("included")).select(KEY, F.col("ts_us").alias("start_us"), F.col("ts_us").alias("end_us"), F.col("a").cast("double").alias("peak"), F.array("ts_us").alias("evidence_us"), F.lit(True).alias("seen"), F.lit(False).alias("said"))
    said = text.where("end_us > start_us").select(KEY, "start_us", "end_us", F.col("peak").cast("double").alias("peak"), "evidence_us", F.lit(False).alias("seen"), F.lit(True).alias("said"))
    carry = {"peak": "max", "evidence_us": "union", "seen": "or", "said": "or"}
    seeds = pad_and_clamp(points.unionByName(said).join(dur, KEY), duration="duration_us", on_empty="keep")
    merged = merge_intervals(seeds, gap=gap, on_empty="keep", carry=carry)
    merged = merge_intervals(merged.join(dur, KEY), pad=pad, duration="duration_us", on_empty="keep", carry=carry).join(dur, KEY)
    short = F.col("end_us") - F.col("start_us") < least
    fits = F.col("end_us") + least <= F.col("duration_us")
    merged = merged.withColumns({"start_us": F.when(short & ~fits, F.greatest(F.lit(0), F.col("start_us") - least)).otherwise(F.col("start_us")), "end_us": F.when(short & fits, F.col("end_us") + least).otherwise(F.col("end_us"))})
    n = F.greatest(F.lit(1), F.ceil((F.col("end_us") - F.col("start_us")) / longest)).cast("bigint")
    rows = merged.withColumn("pieces", n).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    lo = F.col("start_us") + F.col("piece") * longest
    hi = F.when(F.col("piece") == F.col("pieces") - 1, F.col("end_us")).otherwise(lo + longest)
    rows = rows.withColumns({"lo": lo, "hi": hi, "is_last": F.col("piece") == F.col("pieces") - 1})
    held = F.filter("evidence_us", lambda t: (t >= F.col("lo")) & ((t < F.col("hi")) | (F.col("is_last") & (t <= F.col("hi")))))
    trigger = F.when(F.col("seen") & F.col("said"), "visual_and_text").when(F.col("said"), "text").otherwise("visual")
    number = F.row_number().over(Window.partitionBy(KEY).orderBy("lo")) - 1
    return rows.select(KEY, F.format_string("candidate-%05d", number).alias("window_id"), F.col("lo").alias("start_us"), F.col("hi").alias("end_us"), "peak", held.alias("evidence_us"), trigger.alias("trigger"))


def union_candidates(samples: DataFrame, t_a: float, t_b: float, available: Column) -> DataFrame:
    """Samples that either detector passes, with a flag for each; b counts only where available, and is null elsewhere."""
    rows = samples.withColumn("b_seen", F.when(available, F.col("b"))).withColumn("by_a", F.col("a") >= t_a)
    return rows.withColumn("by_b", F.coalesce(F.col("b_seen") >= t_b, F.lit(False))).where("by_a or by_b")


def cluster_events(candidates: DataFrame, *, gap: int, context: int, longest: int, ts: str = "ts_us", tie: Sequence[str] = ("sample_id",), key: Sequence[str] = (KEY,)) -> DataFrame:
    """Events: points within gap, split where the padded span exceeds longest at the largest gap (earliest on ties).

    The recursion in closed form: a gap splits if and only if the span between the nearest larger gaps on both sides (at
    least as large on the left, larger on the right, the group's ends otherwise) plus the context exceeds longest. Needs
    duration_us; by_a and by_b give the profile counts.
    """
    rows = gap_islands(candidates, gap, ts=ts, key=key, tie=tie)
    g = [*key, "island"]
    w = Window.partitionBy(*g).orderBy(ts, *tie)
    rows = rows.withColumns({"__n": F.row_number().over(w), "__gap": F.coalesce(F.col(ts) - F.lag(ts).over(w), F.lit(0))})
    rows = rows.withColumn("__first", F.min(ts).over(Window.partitionBy(*g))).withColumn("__last", F.max(ts).over(Window.partitionBy(*g)))
    # only groups that are too long need the search: one pass over their gaps in order
    big = rows.where(F.col("__last") - F.col("__first") + 2 * context > longest)

    def fold(gaps: Iterator[tuple]) -> Iterator[tuple]:
        """Places of the gaps that split, by a stack of gaps that no larger one has ended yet (n, gap, left end, time)."""
        open_gaps: list[tuple[int, int, int, int]] = []
        last = 0
        for n, size, t, first, last in gaps:
            while open_gaps and open_gaps[-1][1] < size:
                place, _, left, _ = open_gaps.pop()
                if t - size - left + 2 * context > longest:
                    yield (place,)
            open_gaps.append((n, size, open_gaps[-1][3] if open_gaps else first, t))
        for place, _, left, _ in open_gaps:
            if last - left + 2 * context > longest:
                yield (place,)

    cuts = ordered_pass(big.where("__n > 1").withColumnRenamed(ts, "__t"), g, ["__n"], ["__n", "__gap", "__t", "__first", "__last"], fold, "__n int").withColumn("__cut", F.lit(1))
    rows = rows.join(cuts, [*g, "__n"], "left").withColumn("__part", F.sum(F.coalesce("__cut", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy(*g, "__part").agg(F.min(ts).alias("first_us"), F.max(ts).alias("last_us"), F.count("*").alias("n_samples"), F.count_if("by_a").alias("n_a"), F.count_if("by_b").alias("n_b"), F.max("duration_us").alias("duration_us"))
    out = out.withColumns({"start_us": F.greatest(F.lit(0), F.col("first_us") - context), "end_us": F.least(F.col("duration_us"), F.col("last_us") + context)})
    profile = F.when(F.col("n_b") == 0, "a_only").when(F.col("n_a") == 0, "b_only").otherwise("both")
    return out.withColumn("profile", profile).drop("island", "__part", "duration_us")


def event_cuts(candidates: DataFrame, *, ts: str = "ts_us", tie: Sequence[str] = ("sample_id",), key: Sequence[str] = (KEY,)) -> DataFrame:
    """Candidates in order (n, from 1) with the gap before each and its span: the time between the nearest larger gaps on
    both sides (at least as large on the left, larger on the right, the timeline's ends otherwise).

    Clustering starts an event at a candidate if and only if its gap exceeds the merge gap, or its span with the context on
    both sides exceeds the longest event. Neither depends on the settings, so one ordered pass serves any grid of them.
    """
    w = Window.partitionBy(*key).orderBy(ts, *tie)
    rows = candidates.withColumns({"n": F.row_number().over(w), "gap_us": F.col(ts) - F.lag(ts).over(w)})

    def fold(points: Iterator[tuple]) -> Iterator[tuple]:
        """Open gaps are those that no larger one has ended yet: (n, gap, time where the stretch before it began, own time)."""
        open_gaps: list[tuple[int, int, int, int]] = []
        first = t = next(points)[1]
        for n, now in points:
            while open_gaps and open_gaps[-1][1] < now - t:
                place, _, left, _ = open_gaps.pop()
                yield place, t - left
            open_gaps.append((n, now - t, open_gaps[-1][3] if open_gaps else first, now))
            t = now
        for place, _, left, _ in open_gaps:
            yield place, t - left

    spans = ordered_pass(rows.withColumnRenamed(ts, "__t"), key, ["n"], ["n", "__t"], fold, "n int, span_us bigint")
    return rows.join(spans, [*key, "n"], "left")


def evaluate_clustering(candidates: DataFrame, grid: Sequence[tuple[int, int, int]], *, k: int = 6, tie: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Per (merge gap, context, longest) of the grid and media: events and what they cost.

    candidates(media_id, ts_us, by_a, by_b, duration_us). Gives n_candidates, n_events, reduction (1 - events / candidates),
    mean, median, p90, longest and total duration, the share of the media that they cover, events by profile, and images (up to
    k distinct times each). Detection does not depend on clustering: see detections.

    Media of up to _HELD candidates are counted where their rows lie, a block of whole media and a setting at a time: no event is
    sorted or shuffled. For longer ones only the first candidate of each event meets a setting: what lies between two of them comes
    from running counts, so the grid multiplies events, not samples.
    """
    candidates = candidates.select(KEY, "ts_us", "by_a", "by_b", "duration_us", *[c for c in tie if c not in (KEY, "ts_us")])
    long = candidates.groupBy(KEY).agg(F.count("*").alias("__c")).where(F.col("__c") > _HELD).select(KEY)
    if long.limit(1).count():
        out = _held_clustering(candidates.join(long, KEY, "left_anti"), grid, k, tie).unionByName(_long_clustering(candidates.join(long, KEY, "left_semi"), grid, k, tie))
    else:
        out = _held_clustering(candidates, grid, k, tie)
    return out.withColumns({"reduction": 1 - fn.ratio(F.col("n_events"), F.col("n_candidates")), "media_fraction": fn.ratio(F.col("union_us"), F.col("duration_us"))}).drop("duration_us", "union_us")


def _percentile(sorted_len: np.ndarray, at: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """Spark's percentile of each stretch of n sorted numbers from at."""
    place = (n - 1) * p
    low = np.floor(place)
    lower, upper = sorted_len[at + low.astype(np.int64)].astype(float), sorted_len[at + np.ceil(place).astype(np.int64)].astype(float)
    return np.where(lower == upper, lower, (low + 1 - place) * lower + (place - low) * upper)


def _held_clustering(candidates: DataFrame, grid: Sequence[tuple[int, int, int]], k: int, tie: Sequence[str]) -> DataFrame:
    rows = event_cuts(candidates, tie=tie)
    # the window needs a media's rows in one task, in order
    rows = rows.select(KEY, F.row_number().over(Window.partitionBy(KEY).orderBy("n")).alias("n"), "ts_us", "gap_us", "span_us", F.coalesce("by_a", F.lit(False)).alias("a"), F.coalesce("by_b", F.lit(False)).alias("b"), "duration_us")
    counts = ("n_events", "longest_us", "total_us", "union_us", "duration_us", "a_only", "b_only", "both", "images", "most_images", "full_events")
    fields = [T.StructField(c, T.LongType()) for c in ("gap", "context", "longest")] + [rows.schema[KEY], T.StructField("n_candidates", T.IntegerType())]
    out = T.StructType(fields + [T.StructField(c, T.DoubleType()) for c in ("mean_us", "median_us", "p90_us")] + [T.StructField(c, T.LongType()) for c in counts])
    arrow = to_arrow_schema(out)

    def of_block(block: pa.Table) -> Iterator[pa.RecordBatch]:
        plain = lambda c, none=0: block[c].fill_null(none).to_numpy().astype(np.int64)
        n, ts, gaps, spans, dur = plain("n"), plain("ts_us"), plain("gap_us", -1), plain("span_us", -1), plain("duration_us", np.iinfo(np.int64).max)
        first = n == 1
        heads = np.flatnonzero(first)
        sizes = np.diff(np.append(heads, len(n)))
        upto = lambda c: np.concatenate(([0], np.cumsum(c)))
        a, b, d = upto(plain("a", False)), upto(plain("b", False)), upto(first | (gaps > 0))
        media, lasting = block[KEY].combine_chunks().take(pa.array(heads)), pa.array(dur[heads], mask=block["duration_us"].is_null().to_numpy()[heads])
        for gap, context, longest in grid:
            at = np.flatnonzero(first | (gaps > gap) | (~first & (spans + 2 * context > longest)))
            after = np.append(at[1:], len(n))
            begin, end = np.maximum(0, ts[at] - context), np.minimum(dur[at], ts[after - 1] + context)
            size, opens = end - begin, first[at]
            before = np.where(opens, begin, np.append(0, end[:-1]))
            fresh = end - np.maximum(begin, before)
            has_a, has_b, images = a[after] > a[at], b[after] > b[at], 1 + d[after] - d[at + 1]
            heads_of = np.flatnonzero(opens)
            of = np.diff(np.append(heads_of, len(at)))
            total = lambda x: np.add.reduceat(x.astype(np.int64), heads_of)
            most = lambda x: np.maximum.reduceat(x, heads_of)
            in_order = size[np.lexsort((size, np.cumsum(opens)))]
            seen = np.minimum(k, images)
            same = lambda x: np.full(len(heads), x)
            columns = {
                "gap": same(gap), "context": same(context), "longest": same(longest), KEY: media, "n_candidates": sizes, "mean_us": total(size) / of, "median_us": _percentile(in_order, heads_of, of, 0.5),
                "p90_us": _percentile(in_order, heads_of, of, 0.9), "n_events": of, "longest_us": most(size), "total_us": total(size), "union_us": total(fresh), "duration_us": lasting,
                "a_only": total(has_a & ~has_b), "b_only": total(has_b & ~has_a), "both": total(has_a & has_b), "images": total(seen), "most_images": most(seen), "full_events": total(images >= k),
            }
            yield pa.RecordBatch.from_arrays([v if isinstance(v := columns[f.name], pa.Array) else pa.array(v, f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) < _BLOCK:
                continue
            block = pa.Table.from_batches(held)
            # the last media may go on in the next batch
            cut = int(np.flatnonzero(block["n"].to_numpy() == 1)[-1])
            if cut:
                yield from of_block(block.slice(0, cut))
                held = block.slice(cut).combine_chunks().to_batches()
        if sum(x.num_rows for x in held):
            yield from of_block(pa.Table.from_batches(held))

    return rows.mapInArrow(run, out)


def _long_clustering(candidates: DataFrame, grid: Sequence[tuple[int, int, int]], k: int, tie: Sequence[str]) -> DataFrame:
    rows = event_cuts(candidates, tie=tie)
    w = Window.partitionBy(KEY).orderBy("n")
    flags = {"a": F.coalesce("by_a", F.lit(False)), "b": F.coalesce("by_b", F.lit(False)), "d": F.coalesce(F.col("gap_us") > 0, F.lit(True))}
    run = {f"__{c}": F.sum(x.cast("bigint")).over(w) for c, x in flags.items()}
    rows = rows.withColumns(run | {f"own_{c}": x.cast("bigint") for c, x in flags.items()})
    whole = Window.partitionBy(KEY)
    rows = rows.withColumns({"last_ts": F.max("ts_us").over(whole), "last_n": F.max("n").over(whole), **{f"all_{c}": F.max(f"__{c}").over(whole) for c in flags}})
    settings = F.array(*[F.struct(F.lit(g).alias("gap"), F.lit(c).alias("context"), F.lit(m).alias("longest")) for g, c, m in grid])
    starts = F.filter(settings, lambda s: (F.col("n") == 1) | (F.col("gap_us") > s["gap"]) | (F.col("span_us") + 2 * s["context"] > s["longest"]))
    events = rows.withColumn("s", F.explode(starts)).withColumns({"gap": F.col("s.gap"), "context": F.col("s.context"), "longest": F.col("s.longest")})
    by = ("gap", "context", "longest")
    order = Window.partitionBy(KEY, *by).orderBy("n")
    until = lambda c: F.coalesce(F.lead(F.col(f"__{c}") - F.col(f"own_{c}")).over(order), F.col(f"all_{c}")) - F.col(f"__{c}") + F.col(f"own_{c}")
    events = events.withColumns({"last_us": F.coalesce(F.lead(F.col("ts_us") - F.col("gap_us")).over(order), F.col("last_ts")), "n_a": until("a"), "n_b": until("b"), "times": until("d") - F.col("own_d") + 1})
    events = events.withColumns({"start_us": F.greatest(F.lit(0), F.col("ts_us") - F.col("context")), "end_us": F.least("duration_us", F.col("last_us") + F.col("context"))})
    fresh = F.col("end_us") - F.greatest("start_us", F.coalesce(F.lag("end_us").over(order), F.col("start_us")))
    events = events.withColumns({"len": F.col("end_us") - F.col("start_us"), "fresh": fresh})
    return events.groupBy(*by, KEY).agg(
        F.max("last_n").alias("n_candidates"), F.count("*").alias("n_events"), F.avg("len").alias("mean_us"), F.percentile("len", 0.5).alias("median_us"),
        F.percentile("len", 0.9).alias("p90_us"), F.max("len").alias("longest_us"), F.sum("len").alias("total_us"), F.sum("fresh").alias("union_us"), F.max("duration_us").alias("duration_us"),
        F.count_if((F.col("n_a") > 0) & (F.col("n_b") == 0)).alias("a_only"), F.count_if((F.col("n_b") > 0) & (F.col("n_a") == 0)).alias("b_only"), F.count_if((F.col("n_a") > 0) & (F.col("n_b") > 0)).alias("both"),
        F.sum(F.least(F.lit(k), "times")).alias("images"), F.max(F.least(F.lit(k), "times")).alias("most_images"), F.count_if(F.col("times") >= k).alias("full_events"),
    )


def best_clustering(table: DataFrame, recall: DataFrame) -> DataFrame:
    """Of each media that misses nothing, the setting of fewest events, then images, total and longest duration, and setting.

    recall(media_id, n_intervals, detected), as detections gives it.
    """
    key = F.struct("n_events", "images", "total_us", "longest_us", "gap", "context", "longest")
    held = table.join(recall.where("n_intervals > 0 and detected = n_intervals").select(KEY), KEY, "left_semi")
    return held.groupBy(KEY).agg(F.min(key).alias("best")).select(KEY, "best.*")


def detections(candidates: DataFrame, truth: DataFrame, *, tol: int, width: int) -> DataFrame:
    """Per media: intervals, those that hold a candidate, and those that one lies within tol of; with the recalls."""
    pairs = points_in_intervals(candidates.select(KEY, "ts_us"), truth, width=width, tol=tol)
    inside = F.bool_or(F.col("ts_us").between(F.col("i_start_us"), F.col("i_end_us")))
    hit = pairs.groupBy(KEY, F.col("i_interval_id").alias("interval_id")).agg(inside.alias("inside"), F.lit(True).alias("near"))
    out = truth.select(KEY, "interval_id").join(hit, [KEY, "interval_id"], "left").groupBy(KEY)
    out = out.agg(F.count("*").alias("n_intervals"), F.count_if("inside").alias("detected"), F.count_if("near").alias("detected_near"))
    return out.withColumns({"recall": fn.ratio(F.col("detected"), F.col("n_intervals")), "recall_near": fn.ratio(F.col("detected_near"), F.col("n_intervals"))})


def fuse_evidence(visual: DataFrame, text: DataFrame, media: DataFrame, *, t_visual: float, t_text: float, gap: int, pad: int, width: int, tol: int = 1_000_000, related: Sequence[Sequence[str]] = ()) -> DataFrame:
    """Suggestions: visual evidence, boosted by text within tol, padded and merged within gap; text alone makes none.

    visual(media_id, interval_id, start_us, end_us, category, confidence, reason), text(.., category, confidence). related:
    groups of categories that agree with each other. The strongest by (confidence, category, final) gives the category.
    """
    v, t = visual.where(F.col("confidence") >= t_visual), text.where(F.col("confidence") >= t_text)
    pairs = range_join(v.select(KEY, "interval_id", "start_us", "end_us", "category"), t.select(KEY, "start_us", "end_us", "category", "confidence"), width=width, tol=tol)
    agree = F.col("category") == F.col("r_category")
    for group in related:
        agree = agree | (F.col("category").isin(list(group)) & F.col("r_category").isin(list(group)))
    said = pairs.groupBy(KEY, "interval_id").agg(F.max("r_confidence").alias("text_confidence"), F.bool_or(agree).alias("agrees"))
    rows = v.join(said, [KEY, "interval_id"], "left").na.fill({"text_confidence": 0.0, "agrees": False}).join(media.select(KEY, "duration_us"), KEY)
    final = fn.combined_confidence(F.col("confidence"), F.col("text_confidence"), F.col("agrees"))
    rows = rows.withColumn("final", final).withColumn("evidence_us", F.array(F.expr("(start_us + end_us) div 2")))
    rows = rows.withColumn("best", F.struct("confidence", "category", "final")).withColumn("reasons", F.array(F.struct((-F.col("confidence")).alias("c"), F.col("interval_id").alias("i"), F.col("reason").alias("r"))))
    carry = {"best": "max", "confidence": "max", "text_confidence": "max", "final": "max", "evidence_us": "union", "reasons": "union"}
    out = merge_intervals(rows, pad=pad, gap=gap, duration="duration_us", carry=carry)
    two = F.array_join(F.slice(F.array_distinct(F.transform("reasons", lambda x: x["r"])), 1, 2), "; ")
    fp = F.col(KEY).cast("string")
    return out.select(KEY, "start_us", "end_us", F.col("best.category").alias("category"), F.round("confidence", 4).alias("visual_confidence"), F.round("text_confidence", 4).alias("text_confidence"), F.round("final", 4).alias("final_confidence"), "evidence_us", two.alias("reason"), fn.suggestion_id(fp, F.col("start_us"), F.col("end_us"), F.col("best.category")).alias("id"))


def review_status(batches: DataFrame, by: Sequence[str]) -> DataFrame:
    return batches.groupBy(*by).agg(F.when(F.count_if(F.col("error").isNotNull()) > 0, "partial").otherwise("completed").alias("status"))


def select_event_frames(members: DataFrame, by: Sequence[str], *, k: int = 6, ts: str = "ts_us") -> DataFrame:
    """Up to k times of each event: strongest of a and b, first, last, then always the time farthest from those taken."""
    item = F.struct(F.col("a").cast("double").alias("v"), (-F.col(ts)).alias("t"))
    item_b = F.struct(F.col("b").cast("double").alias("v"), (-F.col(ts)).alias("t"))
    rows = members.groupBy(*by).agg(F.array_sort(F.collect_set(ts)).alias("all"), F.max(item).alias("ma"), F.max(item_b).alias("mb"))
    rows = rows.withColumn("taken", F.array_distinct(F.array(-F.col("ma.t"), -F.col("mb.t"), F.element_at("all", 1), F.element_at("all", -1))))

    def step(taken: Column, _: Column) -> Column:
        rest = F.array_except("all", taken)
        ranked = F.transform(rest, lambda x: F.struct(F.array_min(F.transform(taken, lambda y: F.abs(x - y))).alias("d"), (-x).alias("t")))
        return F.when((F.size(taken) >= k) | (F.size(rest) == 0), taken).otherwise(F.concat(taken, F.array(-F.array_max(ranked)["t"])))

    chosen = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.col("taken"), step)
    return rows.select(*by, F.array_sort(F.slice(chosen, 1, k)).alias("frames"))


def top_reasons(df: DataFrame, by: Sequence[str], n: int = 2) -> DataFrame:
    """The first n distinct reasons by falling confidence, joined by '; '."""
    item = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), F.col("interval_id").alias("i"), F.col("reason").alias("r"))))
    rows = df.groupBy(*by).agg(item.alias("x"))
    return rows.select(*by, F.array_join(F.slice(F.array_distinct(F.transform("x", lambda x: x["r"])), 1, n), "; ").alias("reason"))

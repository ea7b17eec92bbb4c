"""Validation of scores, manifests, results and reviews: every row with the names of the rules that it breaks, in the order in
which they are listed; and the derived manifests of subsets and of reference labels, with the record of what was done.

A manifest is item rows with a JSON-like shape: item_id, group_id, split, sha256, duration_us, video_label (positive, negative,
uncertain, missing), review_basis, category_labels MAP<category, present | absent | unknown>, excluded, exclusion_reason,
provenance MAP<STRING, STRING>, and temporal STRUCT<binary_exhaustive, exhaustive_categories, events ARRAY<STRUCT<event_id,
start_us, end_us, categories>>, excluded_intervals ARRAY<STRUCT<exclusion_id, start_us, end_us>>>, which may be null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runs import check_rules

#: The categories, labels and states of manifests and review sheets.
CATEGORIES = ("nudity", "sexual_activity", "sexual_context")
LABELS = ("positive", "negative", "uncertain", "excluded")
STATES = ("present", "absent", "uncertain")
BASES = ("unreviewed", "complete", "alert_triggered", "random_audit")
STATUSES = ("completed", "partial", "failed", "cancelled", "not_run")
USABLE = ("completed", "partial")


def _said(c: Column) -> Column:
    """A text that is not null and not blank."""
    return F.coalesce(F.trim(c) != "", F.lit(False))


def _once(*by: str) -> Column:
    return F.count("*").over(Window.partitionBy(*by)) == 1


def _if(condition: Column, rule: Column) -> Column:
    """The rule where the condition holds; a null condition does not."""
    return ~F.coalesce(condition, F.lit(False)) | F.coalesce(rule, F.lit(False))


def validate_scores(samples: DataFrame, scores: Sequence[str], *, order: str | None = None, tol: float = 1e-5, key: str = "media_id", ts: str = "ts_us", end: str = "duration_us", reasons: str | None = None) -> DataFrame:
    """samples with problems: blank_id, finite, range (0 to 1), sum (of the scores: 1 within tol, absolute or relative), reasons (at least
    one, none blank), unique_id and unique_time within a media, ordered (along order, the place in the artifact) and in_media."""
    values = F.array(*[F.col(c).cast("double") for c in scores])
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    before = F.lag(ts).over(Window.partitionBy(key).orderBy(order)) if order else F.lit(None)
    rules = {
        "blank_id": _said(F.col("sample_id").cast("string")), "finite": finite, "range": F.forall(values, lambda x: (x >= 0) & (x <= 1)), "sum": F.abs(total - 1) <= tol * F.greatest(F.lit(1.0), F.abs(total)),
        "unique_id": _once(key, "sample_id"), "unique_time": _once(key, ts), "ordered": before.isNull() | (F.col(ts) >= before), "in_media": (F.col(ts) >= 0) & (F.col(ts) <= F.col(end)),
    }
    if reasons:
        rules["reasons"] = (F.size(reasons) > 0) & F.forall(reasons, _said)
    return check_rules(samples, rules)


def validate_manifest(items: DataFrame, *, track: str = "accuracy") -> DataFrame:
    """items with problems.

    categories (exactly the known ones, with known states), basis (a label needs one, and only missing labels are unreviewed),
    negative_present, positive_absent (all absent), exclusion_reason (excluded items have one, and only they),
    temporal_duration (a timeline needs a duration), temporal_end (nothing ends behind it), exhaustive_unknown, event_absent
    (an event of an absent category), negative_events and positive_without_events (of exhaustive timelines), exhaustive_unique,
    exhaustive_binary (a category is exhaustive only if the timeline is), unique_events, unique_exclusions, reversed (events and
    exclusions end after they start), unique_id, unique_hash, one_split (a group stands in one split), and on the technical
    track technical_positive (a positive item that is not excluded).
    """
    labels, temporal, excluded = F.col("category_labels"), F.col("temporal"), F.coalesce("excluded", F.lit(False))
    states = F.map_values(labels)
    events, hidden = F.coalesce("temporal.events", F.array()), F.coalesce("temporal.excluded_intervals", F.array())
    timed, exhaustive = temporal.isNotNull(), F.coalesce("temporal.binary_exhaustive", F.lit(False))
    listed = F.coalesce("temporal.exhaustive_categories", F.array().cast("array<string>"))
    positive, negative = F.col("video_label") == "positive", F.col("video_label") == "negative"
    distinct = lambda xs, field: F.size(xs) == F.size(F.array_distinct(F.transform(xs, lambda e: e[field])))
    ends = lambda xs: F.forall(xs, lambda e: e["end_us"] <= F.col("duration_us"))
    runs = lambda xs: F.forall(xs, lambda e: (e["start_us"] >= 0) & (e["end_us"] > e["start_us"]))
    groups = Window.partitionBy("group_id")
    rules = {
        "categories": (F.array_sort(F.map_keys(labels)) == F.array(*map(F.lit, sorted(CATEGORIES)))) & F.forall(states, lambda s: s.isin("present", "absent", "unknown")),
        "basis": F.col("video_label").isin("positive", "negative", "uncertain", "missing") & F.col("review_basis").isin(*BASES) & ((F.col("video_label") == "missing") == (F.col("review_basis") == "unreviewed")),
        "negative_present": _if(negative, ~F.exists(states, lambda s: s == "present")),
        "positive_absent": _if(positive, F.exists(states, lambda s: s != "absent")),
        "exclusion_reason": excluded == _said(F.col("exclusion_reason")),
        "temporal_duration": _if(timed, F.col("duration_us").isNotNull()),
        "temporal_end": _if(timed & F.col("duration_us").isNotNull(), ends(events) & ends(hidden)),
        "exhaustive_unknown": F.forall(listed, lambda c: F.coalesce(F.element_at(labels, c) != "unknown", F.lit(True))),
        "event_absent": F.forall(events, lambda e: F.forall(e["categories"], lambda c: F.coalesce(F.element_at(labels, c) != "absent", F.lit(True)))),
        "negative_events": _if(exhaustive & negative, F.size(events) == 0),
        "positive_without_events": _if(exhaustive & positive, F.size(events) > 0),
        "exhaustive_unique": F.size(listed) == F.size(F.array_distinct(listed)),
        "exhaustive_binary": _if(timed & (F.size(listed) > 0), exhaustive),
        "unique_events": distinct(events, "event_id"), "unique_exclusions": distinct(hidden, "exclusion_id"), "reversed": runs(events) & runs(hidden),
        "unique_id": _once("item_id"), "unique_hash": F.col("sha256").isNull() | _once("sha256"),
        "one_split": F.min("split").over(groups) == F.max("split").over(groups),
    }
    if track == "technical":
        rules["technical_positive"] = ~F.coalesce(positive & ~excluded, F.lit(False))
    typed = items.withColumn("temporal", F.col("temporal").cast(TEMPORAL))
    return check_rules(typed, rules)


TEMPORAL = "struct<binary_exhaustive:boolean,exhaustive_categories:array<string>,events:array<struct<event_id:string,start_us:bigint,end_us:bigint,categories:array<string>>>,excluded_intervals:array<struct<exclusion_id:string,start_us:bigint,end_us:bigint>>>"


def evaluable(items: DataFrame, split: str = "test") -> DataFrame:
    """Items of a split that are not excluded."""
    return items.where((F.col("split") == split) & ~F.coalesce("excluded", F.lit(False)))


def validate_results(results: DataFrame, manifest: DataFrame, *, digest: str, audio_free: Sequence[str] = ("A1",)) -> DataFrame:
    """results with problems.

    results(item_id, config, status, manifest_digest, input STRUCT<sha256, derived_from_sha256, verified>, suggestions
    ARRAY<STRUCT<start_us, end_us>>): unique (item and config), status, identity (a completed run records its input),
    suggestions (only of usable runs), unverified (the input of an audio-free config is verified against its source), reversed
    (a suggestion ends after it starts), manifest (recorded for this digest), unknown_item, and hash (the input, or what an
    audio-free one is derived from, is the manifest's file; a null hash of either says nothing).
    """
    known = manifest.groupBy("item_id").agg(F.first("sha256").alias("__sha"), F.lit(True).alias("__known"))
    source = F.when(F.col("config").isin(*audio_free), F.col("input.derived_from_sha256")).otherwise(F.col("input.sha256"))
    suggestions = F.coalesce("suggestions", F.array())
    rules = {
        "unique": _once("item_id", "config"), "status": F.col("status").isin(*STATUSES), "identity": _if(F.col("status") == "completed", F.col("input").isNotNull()),
        "suggestions": F.col("status").isin(*USABLE) | (F.size(suggestions) == 0), "unverified": _if(F.col("config").isin(*audio_free) & F.col("input").isNotNull(), F.col("input.derived_from_sha256").isNotNull() & F.col("input.verified")),
        "reversed": F.forall(suggestions, lambda s: s["end_us"] > s["start_us"]), "manifest": F.col("manifest_digest") == digest, "unknown_item": F.col("__known").isNotNull(),
        "hash": F.col("__sha").isNull() | F.col("input").isNull() | source.eqNullSafe(F.col("__sha")),
    }
    return check_rules(results.join(known, "item_id", "left"), rules).drop("__sha", "__known")


def review_events(text: Column, duration_s: Column) -> Column:
    """'start-end:category;...' in seconds -> array of structs (start, end, category, ok), ends clamped to the duration; ok tells
    that the form, the category and the interval are right."""
    form = r"^(\d+(?:\.\d+)?)\s*-\s*(\d+(?:\.\d+)?)\s*:\s*(\w+)$"
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda p: F.trim(p)), lambda p: p != "")

    def one(p: Column) -> Column:
        at = lambda i: F.regexp_extract(p, form, i)
        start, end = at(1).try_cast("double"), F.least(at(2).try_cast("double"), duration_s)
        return F.struct(start.alias("start"), end.alias("end"), at(3).alias("category"), F.coalesce(at(3).isin(*CATEGORIES) & (start < end), F.lit(False)).alias("ok"))

    return F.transform(parts, one)


def validate_reviews(rows: DataFrame, *, escalations: Sequence[str] = ("",), contexts: Sequence[str] = ("",), duration_s: str = "duration_s", categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """Review sheet rows (texts, as a person typed them) with problems; a row without any is a usable label.

    label stops all else. escalation and context have known values (a blank one is known if listed). An excluded row needs
    exclusion_reason or an escalation, and stops there; so do states of another kind. Then: watched (yes or no),
    positive_present, present_positive, negative_absent (and watched in full), uncertain, events (each is start-end:category of a
    known category, not empty; stops), event_absent, negative_events.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    states = F.array(*[text(c) for c in categories])
    has = lambda s: F.exists(states, lambda x: x == s)
    label, full = text("video_label"), F.lower(text("watched_in_full"))
    rows = rows.withColumn("__events", review_events(F.col("events"), F.col(duration_s)))
    broken = F.exists("__events", lambda e: ~e["ok"])
    state_of = F.create_map(*[x for c in categories for x in (F.lit(c), text(c))])
    named = {
        "escalation": ~text("escalation").isin(*escalations), "nudity_context": ~text("nudity_context").isin(*contexts),
        "exclusion_reason": (label == "excluded") & (text("exclusion_reason") == "") & (text("escalation") == ""),
    }
    judged = {
        "watched": ~full.isin("yes", "no"), "positive_present": (label == "positive") & ~has("present"), "present_positive": (label != "positive") & has("present"),
        "negative_absent": (label == "negative") & (has("uncertain") | (full != "yes")), "uncertain": (label == "uncertain") & ~has("uncertain") & (full == "yes"), "events": broken,
    }
    timed = {"event_absent": F.exists("__events", lambda e: F.element_at(state_of, e["category"]) == "absent"), "negative_events": (label == "negative") & (F.size("__events") > 0)}
    names = lambda rules: F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    known = F.forall(states, lambda s: s.isin(*STATES))
    rest = F.when(known, F.concat(names(judged), F.when(broken, F.array().cast("array<string>")).otherwise(names(timed)))).otherwise(F.array(F.lit("states")))
    every = F.when(~label.isin(*LABELS), F.array(F.lit("label"))).when(label == "excluded", names(named)).otherwise(F.concat(names({k: named[k] for k in ("escalation", "nudity_context")}), rest))
    return rows.withColumn("problems", every).drop("__events")


def media_quality(probes: DataFrame, containers: Mapping[str, str], *, tail: float = 2.0) -> DataFrame:
    """category and code of files by what a probe saw of them; null where they are fine.

    probes(path, length, probe_ok, format_name, n_video, n_cover, n_audio, codec, width, height, duration_s, head_frames,
    tail_last_s, video_s): n_video counts streams that are no attached picture, n_cover those that are; tail_last_s is where the
    last packet ends, and video_s the video stream's own duration, if known. containers: extension -> its format name. The
    first rule that holds counts; a file is incomplete if no packet is at its tail, or the last one ends more than tail seconds
    before its video does.
    """
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    expected = F.element_at(F.create_map(*[x for e, n in containers.items() for x in (F.lit(e), F.lit(n))]), suffix)
    absent = lambda c: F.coalesce(F.col(c), F.lit(0)) <= 0
    rules = (
        ("missing_file", "media.missing_file", F.col("length").isNull()),
        ("unsupported_format", "media.unsupported_extension", expected.isNull()),
        ("corrupted_media", "media.empty", F.col("length") == 0),
        ("corrupted_media", "media.damaged", ~F.coalesce("probe_ok", F.lit(False))),
        ("wrong_extension", "media.wrong_extension", (F.col("format_name") != expected) & F.col("format_name").isin(*containers.values())),
        ("unsupported_format", "media.unsupported_container", ~F.col("format_name").eqNullSafe(expected)),
        ("no_video", "media.no_video_cover", absent("n_video") & ~absent("n_cover")),
        ("no_video", "media.no_video_audio_only", absent("n_video") & ~absent("n_audio")),
        ("no_video", "media.no_video_empty", absent("n_video")),
        ("unsupported_codec", "media.unknown_codec", F.coalesce("codec", F.lit("")).isin("", "none")),
        ("corrupted_media", "media.invalid_video_info", absent("width") | absent("height") | absent("duration_s")),
        ("unsupported_codec", "media.undecodable", absent("head_frames")),
        ("corrupted_media", "media.incomplete", F.col("tail_last_s").isNull() | F.coalesce(F.col("tail_last_s") < F.col("video_s") - tail, F.lit(False))),
    )
    first = lambda i: F.coalesce(*[F.when(r[2], F.lit(r[i])) for r in rules])
    return probes.withColumns({"category": first(0), "code": first(1)})


def _guarded(df: DataFrame, checks: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """df, which fails at run time with the message of the first check whose table has a row; checks are one row each."""
    for bad, message in checks:
        n = bad.agg(F.count("*").alias("__bad"))
        ok = n.select(F.when(F.col("__bad") > 0, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)).alias("__ok"))
        df = df.join(F.broadcast(ok), F.col("__ok")).drop("__ok")
    return df


def apply_subset(manifest: DataFrame, spec: DataFrame, *, subset_id: str, reason: str, split: str = "test", flag: str | None = None, scope: str = "item") -> tuple[DataFrame, DataFrame]:
    """The manifest with the items that spec(item_id) names excluded for the reason, and a record of one row.

    Names must be unique and items of the split. With a flag they must be exactly the split's items whose provenance has the flag
    true, or, in scope subject, all items of groups that have one. Items already excluded keep their own reason. An empty spec, an
    unknown name, another set than the flag selects, and a subset that leaves no evaluable item are errors at run time.
    The record: base_evaluable, base_groups, remaining_evaluable, remaining_groups, n_excluded, already_excluded,
    excluded_groups, shared_groups (of excluded and remaining items).
    """
    if not subset_id.strip() or not reason.strip() or scope not in ("item", "subject"):
        raise ValueError("a subset needs an id, a reason, and the scope item or subject")
    candidates = manifest.where(F.col("split") == split)
    names = spec.select("item_id")
    if flag is None:
        wrong = None
    else:
        flagged = candidates.where(F.coalesce(F.element_at("provenance", flag) == "true", F.lit(False)))
        if scope == "subject":
            flagged = candidates.join(flagged.select("group_id").distinct(), "group_id", "left_semi")
        flagged = flagged.select("item_id")
        wrong = names.join(flagged, "item_id", "left_anti").union(flagged.join(names, "item_id", "left_anti"))
    listed = names.distinct().withColumn("__listed", F.lit(True))
    rows = manifest.join(listed, "item_id", "left")
    fresh = F.coalesce("__listed", F.lit(False)) & (F.col("split") == split) & ~F.coalesce("excluded", F.lit(False))
    derived = rows.withColumns({"__fresh": fresh, "exclusion_reason": F.when(fresh, F.lit(f"subset: {reason}")).otherwise(F.col("exclusion_reason")), "excluded": F.coalesce("excluded", F.lit(False)) | fresh})
    left = evaluable(derived, split).limit(1).agg(F.count("*").alias("n")).where("n = 0")
    checks = [
        (names.agg(F.count("*").alias("n")).where("n = 0"), "a subset needs names"), (names.groupBy("item_id").count().where("count > 1"), "subset names must be unique"),
        (names.join(candidates, "item_id", "left_anti"), "subset names are not items of this split"), (left, "a subset cannot exclude every evaluable item"),
    ]
    checks += [(wrong, "subset names must be exactly the flagged items")] if wrong is not None else []
    mine, on = derived.where(F.col("split") == split), F.coalesce("__listed", F.lit(False))
    stays = ~F.col("excluded")
    groups = mine.groupBy("group_id").agg(F.bool_or(stays | F.col("__fresh")).alias("base"), F.bool_or(stays).alias("left"), F.bool_or(on).alias("out"))
    counts = mine.agg(F.count_if(stays | F.col("__fresh")).alias("base_evaluable"), F.count_if(stays).alias("remaining_evaluable"), F.count_if(on).alias("n_excluded"), F.count_if(on & ~F.col("__fresh")).alias("already_excluded"))
    by_group = groups.agg(F.count_if("base").alias("base_groups"), F.count_if("left").alias("remaining_groups"), F.count_if("out").alias("excluded_groups"), F.count_if(F.col("out") & F.col("left")).alias("shared_groups"))
    record = counts.crossJoin(by_group).select(F.lit(subset_id).alias("subset_id"), F.lit(reason).alias("reason"), "*")
    return _guarded(derived.drop("__listed", "__fresh"), checks), record


def apply_reference_labels(manifest: DataFrame, labels: DataFrame, columns: Sequence[str], *, split: str = "test") -> tuple[DataFrame, DataFrame]:
    """The manifest with the columns of its evaluable items taken from labels, and the cover of both.

    labels(item_id, sha256, the columns) must name exactly the evaluable items of the split, each once and for the same file
    (nulls are equal); anything else is an error at run time. The cover, which raises nothing, gives each item_id of either
    side with cover: both, label only, unlabelled, repeated or other file.
    """
    given = labels.groupBy("item_id").agg(F.count("*").alias("__n"), F.first("sha256").alias("__sha"), *[F.first(c).alias(f"__{c}") for c in columns])
    mine = evaluable(manifest, split).select("item_id", F.col("sha256").alias("__own"), F.lit(True).alias("__here"))
    both = mine.join(given, "item_id", "full")
    cover = F.when(F.col("__here").isNull(), "label only").when(F.col("__n").isNull(), "unlabelled").when(F.col("__n") > 1, "repeated").when(~F.col("__own").eqNullSafe(F.col("__sha")), "other file").otherwise("both")
    told = both.select("item_id", cover.alias("cover"))
    out = manifest.join(given.drop("__n", "__sha"), "item_id", "left")
    here = (F.col("split") == split) & ~F.coalesce("excluded", F.lit(False))
    out = out.withColumns({c: F.when(here, F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}).drop(*[f"__{c}" for c in columns])
    return _guarded(out, [(told.where(F.col("cover").isin("label only", "unlabelled", "repeated")), "labels must cover exactly the evaluable items"), (told.where("cover = 'other file'"), "labels were recorded for another file")]), told

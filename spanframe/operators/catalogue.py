"""Catalogues of attribute annotations and of media, model comparisons, and projection into the manifest's item schema.

segments(group columns, item_id, attribute, first_frame, last_frame (inclusive), values ARRAY<INT>) is what read_frame_annotations
gives, with the action that an item belongs to.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio

ITEM = ("action", "item_id")


def annotation_issues(segments: DataFrame, key: Sequence[str], *, attribute: str | None = None, order: str | None = None) -> DataFrame:
    """Issues of inclusive frame ranges, each a row: key, first_frame, last_frame, issue.

    Against the range before (by first_frame, last_frame, or as they stand along order): overlap, gap, and along order
    unordered (starts before the one before); does not start at 0 for a first one; and with attribute (a column of key) ends
    differ, once for each item whose attributes end at different frames (both bounds: the least and the greatest end)."""
    w = Window.partitionBy(*key).orderBy(*([order] if order else ["first_frame", "last_frame"]))
    prev, start = F.lag("last_frame").over(w), F.lag("first_frame").over(w)
    issue = F.when(prev.isNull() & (F.col("first_frame") != 0), "does not start at 0").when(F.col("first_frame") < start, "unordered").when(F.col("first_frame") <= prev, "overlap").when(F.col("first_frame") > prev + 1, "gap")
    found = segments.withColumn("issue", issue).where("issue is not null").select(*key, "first_frame", "last_frame", "issue")
    if attribute is None:
        return found
    rest = [k for k in key if k != attribute]
    # a key's last row is the one that no other follows: its end needs no aggregate by the key beside the sort
    ends = segments.withColumn("__more", F.lead(F.lit(True)).over(w)).where("__more is null")
    unlike = ends.groupBy(*rest).agg(F.min("last_frame").alias("first_frame"), F.max("last_frame").alias("last_frame")).where("first_frame <> last_frame")
    return found.unionByName(unlike.withColumns({attribute: F.lit(None).cast("string"), "issue": F.lit("ends differ")}))


def highest_level(segments: DataFrame, attribute: str) -> DataFrame:
    """(action, item_id, level): the greatest value of an attribute of each item; null without one."""
    value = F.when(F.col("attribute") == attribute, F.array_max("values"))
    return segments.groupBy(*ITEM).agg(F.max(value).alias("level"))


def attribute_catalogue(segments: DataFrame, members: DataFrame, *, attribute: str, level: int, fps: float = 30.0, values_of: str | None = None, flag: tuple[str, int] | None = None) -> DataFrame:
    """One row for each item whose attribute reaches level as its greatest value.

    action, item_id, in_archive (members(action, item_id) lists it), annotated_frames of the attribute, extent_frames (from the
    first to the last frame of any attribute), level_frames, fraction of the annotated ones, level_s and first_level_s (at
    fps), segments ('first-last' of every range with the level, in order, ';' between), whole (one range that is all that is
    annotated), and where asked values (the distinct ones of values_of, '|' between) and flagged (any range of flag's attribute
    with its value). A range with several values counts for each."""
    mine = F.col("attribute") == attribute
    at = mine & F.array_contains("values", level)
    frames = F.col("last_frame") - F.col("first_frame") + 1
    n = lambda c: F.coalesce(F.sum(F.when(c, frames)), F.lit(0)).cast("bigint")
    ranges = F.array_sort(F.collect_list(F.when(at, F.struct("first_frame", "last_frame"))))
    more = {}
    if values_of:
        found = F.array_distinct(F.flatten(F.collect_list(F.when(F.col("attribute") == values_of, F.col("values")))))
        more["values"] = F.array_join(F.array_sort(found.cast("array<string>")), "|")
    if flag:
        more["flagged"] = F.coalesce(F.bool_or((F.col("attribute") == flag[0]) & F.array_contains("values", flag[1])), F.lit(False))
    rows = segments.groupBy(*ITEM).agg(
        F.max(F.when(mine, F.array_max("values"))).alias("level"), n(mine).alias("annotated_frames"), (F.max("last_frame") - F.min("first_frame") + 1).cast("bigint").alias("extent_frames"),
        n(at).alias("level_frames"), ranges.alias("__ranges"), *[c.alias(k) for k, c in more.items()],
    ).where(F.col("level") == level)
    text = F.array_join(F.transform("__ranges", lambda r: F.concat_ws("-", r["first_frame"].cast("string"), r["last_frame"].cast("string"))), ";")
    listed = members.select(*ITEM).distinct().withColumn("__listed", F.lit(True))
    out = rows.join(listed, list(ITEM), "left")
    return out.select(
        *ITEM, F.coalesce("__listed", F.lit(False)).alias("in_archive"), "annotated_frames", "extent_frames", "level_frames", F.round(ratio(F.col("level_frames"), F.col("annotated_frames")), 4).alias("fraction"),
        F.round(F.col("level_frames") / fps, 3).alias("level_s"), F.round(F.col("__ranges")[0]["first_frame"] / fps, 3).alias("first_level_s"), text.alias("segments"),
        ((F.col("level_frames") == F.col("annotated_frames")) & (F.size("__ranges") == 1)).alias("whole"), *more,
    )


def catalogue_rollup(segments: DataFrame, members: DataFrame, *, attribute: str, level: int, levels: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """Per action: annotated items, how many have each greatest level (level_0 ..), how many of those at level stand in the archive,
    and whether the archive has anything of the action (archive_present)."""
    top = highest_level(segments, attribute)
    listed = members.select(*ITEM).distinct().withColumn("__listed", F.lit(True))
    rows = top.join(listed, list(ITEM), "left")
    counts = rows.groupBy("action").agg(F.count("*").alias("annotated"), *[F.count_if(F.col("level") == x).alias(f"level_{x}") for x in levels], F.count_if((F.col("level") == level) & F.coalesce("__listed", F.lit(False))).alias("in_archive"))
    there = members.select("action").distinct().withColumn("archive_present", F.lit(True))
    return counts.join(there, "action", "left").na.fill(False, ["archive_present"])


def inventory(segments: DataFrame, reviews: DataFrame, issues: DataFrame, *, attribute: str, levels: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """Per action: annotated items, items by their greatest level, items that reviews(action, item_id, review) flags, and items with
    an issue."""
    # one aggregate by item instead of joins: its rows are not sorted. As in a join by item, a null key meets nothing
    known = lambda df: df.select(*ITEM).where(" and ".join(f"{c} is not null" for c in ITEM))
    none, no, yes = F.lit(None), F.lit(False), F.lit(True)
    value = F.when(F.col("attribute") == attribute, F.array_max("values"))
    rows = segments.select(*ITEM, value.alias("level"), no.alias("__review"), no.alias("__issue"), yes.alias("__item"))
    for found, marks in ((reviews.where("review"), (yes, no, no)), (issues, (no, yes, no))):
        rows = rows.unionByName(known(found).select(*ITEM, none.cast(rows.schema["level"].dataType).alias("level"), *[m.alias(c) for m, c in zip(marks, ("__review", "__issue", "__item"), strict=True)]))
    items = rows.groupBy(*ITEM).agg(F.max("level").alias("level"), *[F.max(c).alias(c) for c in ("__review", "__issue", "__item")]).where("__item")
    return items.groupBy("action").agg(F.count("*").alias("annotated"), *[F.count_if(F.col("level") == x).alias(f"level_{x}") for x in levels], F.count_if("__review").alias("review_true"), F.count_if("__issue").alias("with_issues"))


def speech_summary(events: DataFrame) -> DataFrame:
    """Transcriptions of journals (kind whisper_transcription) with what their language rests on: without a segment a language is
    no observation of speech, and stands in detected_without_speech instead."""
    speech = F.coalesce(F.col("segments") > 0, F.lit(False))
    rows = events.where("kind = 'whisper_transcription'")
    return rows.withColumns({
        "speech_present": speech, "detected_without_speech": F.when(~speech, F.col("language")), "language_basis": F.when(speech, "speech_segments").otherwise("no_speech_segments_unreliable"),
        "language": F.when(speech, F.col("language")), "language_probability": F.when(speech, F.col("language_probability")),
    })


def probe_summary(events: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per run: whether the speech probe was available, its model loads, and transcriptions with and without speech; runs that
    recorded no probe have no row."""
    kind, n = F.col("kind"), lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    out = events.groupBy(*by).agg(
        F.bool_or(F.when(kind == "whisper_probe", F.coalesce("available", F.lit(False)))).alias("probe_available"), n(kind == "whisper_model_load").alias("model_loads"), n((kind == "whisper_model_load") & F.col("ok")).alias("loaded"),
        n((kind == "whisper_transcription") & (F.col("segments") > 0)).alias("with_speech"), n((kind == "whisper_transcription") & (F.coalesce("segments", F.lit(0)) <= 0)).alias("without_speech"),
    )
    return out.where("probe_available is not null")


def compare_models(metrics: DataFrame, models: Sequence[str], *, current: str, by: Sequence[str] = ("metric",)) -> DataFrame:
    """metrics(by, model, value), one row each -> a row for each of by, a column a model, and each other's distance from the current
    one (delta_<model>). A missing figure is null; a figure given twice is an error at run time."""
    rows = metrics.where(F.col("model").isin([*models, current]))
    once = F.when(F.count("*") > 1, F.raise_error(F.lit("a model has a metric twice")).cast("double")).otherwise(F.first(F.col("value").cast("double")))
    one = rows.groupBy(*by, "model").agg(once.alias("value"))
    wide = one.groupBy(*by).pivot("model", [*models, current]).agg(F.first("value"))
    return wide.withColumns({f"delta_{m}": F.col(current) - F.col(m) for m in models})


def to_manifest(rows: DataFrame, fields: Mapping[str, Column], provenance: Sequence[str] = (), *, categories: Sequence[str] = ("nudity", "sexual_activity", "sexual_context")) -> DataFrame:
    """Rows of any catalogue in the item schema: item_id, group_id, split, file_name, sha256, duration_us, has_audio, video_label,
    review_basis, category_labels, excluded, exclusion_reason, provenance (the named columns as text, nulls left out).

    fields gives columns by name, item_id and group_id at least; what is not given is as of an unreviewed test item."""
    if missing := {"item_id", "group_id"} - set(fields):
        raise ValueError(f"no column for {', '.join(sorted(missing))}")
    none = lambda kind: F.lit(None).cast(kind)
    unknown = F.create_map(*[x for c in categories for x in (F.lit(c), F.lit("unknown"))])
    default = {"item_id": None, "group_id": None, "split": F.lit("test"), "file_name": none("string"), "sha256": none("string"), "duration_us": none("bigint"), "has_audio": none("boolean"), "video_label": F.lit("missing"), "review_basis": F.lit("unreviewed"), "category_labels": unknown, "excluded": F.lit(False), "exclusion_reason": F.lit("")}
    if odd := set(fields) - set(default):
        raise ValueError(f"no item field is called {', '.join(sorted(odd))}")
    entries = F.array(*[F.struct(F.lit(p).alias("key"), F.col(p).cast("string").alias("value")) for p in provenance]) if provenance else F.array().cast("array<struct<key:string,value:string>>")
    kept = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    return rows.select(*[(fields.get(c) if c in fields else v).alias(c) for c, v in default.items()], kept.alias("provenance"))

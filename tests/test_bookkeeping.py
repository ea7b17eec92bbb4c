"""Rules of manifests, results, reviews, subsets and labels, one by one; selections against greedy walks."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from spanframe.operators import catalogue as ct
from spanframe.operators import runs as rn
from spanframe.operators import selection as sl
from spanframe.operators import validation as vd

EVENT = {"event_id": "e", "start_us": 1, "end_us": 5, "categories": ["nudity"]}
ITEM = {
    "item_id": "i", "group_id": "g", "split": "test", "sha256": None, "duration_us": 100, "video_label": "positive", "review_basis": "complete", "excluded": False, "exclusion_reason": "",
    "category_labels": {"nudity": "present", "sexual_activity": "absent", "sexual_context": "unknown"}, "provenance": {"flag": "false"},
    "temporal": {"binary_exhaustive": True, "exhaustive_categories": ["nudity"], "events": [EVENT], "excluded_intervals": []},
}
SCHEMA = f"item_id string, group_id string, split string, sha256 string, duration_us bigint, video_label string, review_basis string, excluded boolean, exclusion_reason string, category_labels map<string,string>, provenance map<string,string>, temporal {vd.TEMPORAL}"
STATES = {"nudity": "absent", "sexual_activity": "absent", "sexual_context": "absent"}


def manifest(spark, *changes):
    rows = []
    for i, c in enumerate(changes):
        item = ITEM | {"item_id": f"i{i}", "group_id": f"g{i}"} | c
        rows.append(tuple(item[f.split()[0]] for f in SCHEMA.split(", ")))
    return spark.createDataFrame(rows, SCHEMA)


def time_of(**changes):
    return {"temporal": ITEM["temporal"] | changes}


CASES = [
    ({}, []),
    ({"category_labels": {"nudity": "present"}}, ["categories"]),
    ({"category_labels": STATES | {"nudity": "maybe"}}, ["categories"]),
    ({"review_basis": "unreviewed"}, ["basis"]),
    ({"video_label": "missing"}, ["basis"]),
    ({"video_label": "missing", "review_basis": "unreviewed"}, []),
    ({"video_label": "negative", "temporal": None}, ["negative_present"]),
    ({"category_labels": STATES, "temporal": None}, ["positive_absent"]),
    ({"excluded": True}, ["exclusion_reason"]),
    ({"exclusion_reason": "why"}, ["exclusion_reason"]),
    ({"excluded": True, "exclusion_reason": "why"}, []),
    ({"duration_us": None}, ["temporal_duration"]),
    (time_of(events=[EVENT | {"end_us": 101}]), ["temporal_end"]),
    (time_of(excluded_intervals=[{"exclusion_id": "x", "start_us": 0, "end_us": 101}]), ["temporal_end"]),
    (time_of(exhaustive_categories=["sexual_context"]), ["exhaustive_unknown"]),
    (time_of(events=[EVENT | {"categories": ["sexual_activity"]}]), ["event_absent"]),
    ({"video_label": "negative", "category_labels": STATES} | time_of(events=[EVENT | {"categories": []}], exhaustive_categories=[]), ["negative_events"]),
    (time_of(events=[]), ["positive_without_events"]),
    (time_of(exhaustive_categories=["nudity", "nudity"]), ["exhaustive_unique"]),
    (time_of(binary_exhaustive=False), ["exhaustive_binary"]),
    (time_of(events=[EVENT, EVENT]), ["unique_events"]),
    (time_of(excluded_intervals=[{"exclusion_id": "x", "start_us": 0, "end_us": 1}] * 2), ["unique_exclusions"]),
    (time_of(events=[EVENT | {"end_us": 1}]), ["reversed"]),
    ({"category_labels": None, "video_label": None, "review_basis": None, "temporal": None}, ["categories", "basis"]),
]


def test_each_rule_of_a_manifest(spark):
    got = {r["item_id"]: r["problems"] for r in vd.validate_manifest(manifest(spark, *[c for c, _ in CASES])).collect()}
    assert got == {f"i{i}": p for i, (_, p) in enumerate(CASES)}


def test_rules_across_items(spark):
    rows = manifest(spark, {"item_id": "a"}, {"item_id": "a", "sha256": "h"}, {"sha256": "h"}, {"group_id": "x", "split": "tuning"}, {"group_id": "x"})
    got = sorted((r["item_id"], r["problems"]) for r in vd.validate_manifest(rows).collect())
    assert got == [("a", ["unique_id"]), ("a", ["unique_id", "unique_hash"]), ("i2", ["unique_hash"]), ("i3", ["one_split"]), ("i4", ["one_split"])]
    out = vd.validate_manifest(manifest(spark, {}, {"excluded": True, "exclusion_reason": "found"}), track="technical").collect()
    assert sorted(r["problems"] for r in out) == [[], ["technical_positive"]]
    assert vd.validate_manifest(rows.limit(0)).count() == 0


def test_rules_of_results(spark):
    given = lambda **c: {"sha256": "h", "derived_from_sha256": None, "verified": None} | c
    base = ("i0", "A2", "completed", "d", given(), [])
    cases = [
        (base, []), (("i0", "A0", "completed", "d", None, []), ["identity"]), (("i0", "A3", "failed", "d", None, [(1, 2)]), ["suggestions"]), (("i0", "A4", "partial", "d", given(), [(2, 2)]), ["reversed"]),
        (("i0", "A5", "odd", "d", None, None), ["status"]), (("i0", "A6", "completed", "other", given(), []), ["manifest"]), (("zz", "A2", "completed", "d", given(), []), ["unknown_item"]), (("i0", "A7", "completed", "d", given(sha256="x"), []), ["hash"]),
        (("i0", "A1", "completed", "d", given(sha256="x", derived_from_sha256="h", verified=True), []), []), (("i1", "A1", "completed", "d", given(), []), ["unverified"]), (("i2", "A1", "completed", "d", given(derived_from_sha256="h"), []), ["unverified", "hash"]),
        (("i2", "A9", "not_run", "d", None, None), ["unique"]), (("i2", "A9", "not_run", "d", None, None), ["unique"]),
    ]
    schema = "item_id string, config string, status string, manifest_digest string, input struct<sha256:string,derived_from_sha256:string,verified:boolean>, suggestions array<struct<start_us:bigint,end_us:bigint>>"
    items = manifest(spark, {"sha256": "h"}, {}, {"sha256": "k"})
    out = vd.validate_results(spark.createDataFrame([c for c, _ in cases], schema), items, digest="d").collect()
    assert sorted((r["item_id"], r["config"], r["problems"]) for r in out) == sorted((c[0], c[1], p) for c, p in cases)


REVIEW = {"video_label": "positive", "nudity": "present", "sexual_activity": "absent", "sexual_context": "uncertain", "watched_in_full": "yes", "escalation": "", "nudity_context": "", "exclusion_reason": "", "events": "1-2.5:nudity"}
CLEAN = {"nudity": "absent", "sexual_context": "absent", "events": None}


def test_rules_of_reviews(spark):
    cases = [
        ({}, []), ({"video_label": "maybe", "escalation": "?"}, ["label"]), ({"escalation": "odd"}, ["escalation"]), ({"nudity_context": "odd"}, ["nudity_context"]),
        ({"video_label": "excluded"}, ["exclusion_reason"]), ({"video_label": "excluded", "exclusion_reason": "why", "nudity": "?"}, []), ({"video_label": "excluded", "escalation": "age"}, []),
        ({"nudity": "?"}, ["states"]), ({"watched_in_full": "half"}, ["watched"]), ({"watched_in_full": " YES "}, []), ({"nudity": "uncertain"}, ["positive_present"]), ({"video_label": "uncertain"}, ["present_positive"]),
        ({"video_label": "negative"} | CLEAN, []), ({"video_label": "negative"} | CLEAN | {"sexual_context": "uncertain"}, ["negative_absent"]), ({"video_label": "negative", "watched_in_full": "no"} | CLEAN, ["negative_absent"]),
        ({"video_label": "uncertain"} | CLEAN, ["uncertain"]), ({"video_label": "uncertain", "watched_in_full": "no"} | CLEAN, []), ({"events": "nonsense"}, ["events"]), ({"events": "1-2:else"}, ["events"]), ({"events": "70-80:nudity"}, ["events"]),
        ({"events": "1-2:sexual_activity"}, ["event_absent"]), ({"events": " ; 0.5 - 99 : nudity;"}, []), ({"video_label": "negative"} | CLEAN | {"events": "1-2:nudity"}, ["event_absent", "negative_events"]), (dict.fromkeys(REVIEW), ["label"]),
    ]
    rows = [(i, 60.0, *[(REVIEW | c)[k] for k in REVIEW]) for i, (c, _) in enumerate(cases)]
    frame = spark.createDataFrame(rows, f"n int, duration_s double, {', '.join(f'{k} string' for k in REVIEW)}")
    got = {r["n"]: r["problems"] for r in vd.validate_reviews(frame, escalations=("", "age"), contexts=("",)).collect()}
    assert got == {i: p for i, (_, p) in enumerate(cases)}


def test_subsets(spark):
    flag = lambda on: {"provenance": {"flag": on}}
    items = manifest(spark, flag("true"), {"group_id": "g0"}, flag("false"), {"split": "tuning"} | flag("true"), {"excluded": True, "exclusion_reason": "own"} | flag("true"))
    named = lambda *ids: spark.createDataFrame([(i,) for i in ids], "item_id string")
    derived, record = vd.apply_subset(items, named("i0", "i4"), subset_id="s", reason="r", flag="flag")
    got = {r["item_id"]: (r["excluded"], r["exclusion_reason"]) for r in derived.collect()}
    assert got == {"i0": (True, "subset: r"), "i1": (False, ""), "i2": (False, ""), "i3": (False, ""), "i4": (True, "own")}
    assert record.first().asDict() == {"subset_id": "s", "reason": "r", "base_evaluable": 3, "remaining_evaluable": 2, "n_excluded": 2, "already_excluded": 1, "base_groups": 2, "remaining_groups": 2, "excluded_groups": 2, "shared_groups": 1}
    scoped, record = vd.apply_subset(items, named("i0", "i1", "i4"), subset_id="s", reason="r", flag="flag", scope="subject")
    assert sorted(r["item_id"] for r in scoped.where("excluded").collect()) == ["i0", "i1", "i4"] and record.first()["shared_groups"] == 0
    for names, options, message in ((("i0",), {"flag": "flag"}, "exactly the flagged"), (("i0", "i1", "i4"), {"flag": "flag"}, "exactly the flagged"), (("i3",), {}, "not items of this split"), (("zz",), {}, "not items"), (("i0", "i0"), {}, "unique"), ((), {}, "needs names"), (("i0", "i1", "i2"), {}, "every evaluable")):
        with pytest.raises(Exception, match=message):
            vd.apply_subset(items, named(*names), subset_id="s", reason="r", **options)[0].collect()
    with pytest.raises(ValueError):
        vd.apply_subset(items, named("i0"), subset_id=" ", reason="r")


def test_reference_labels(spark):
    items = manifest(spark, {"sha256": "a"}, {}, {"excluded": True, "exclusion_reason": "x"}, {"split": "tuning"})
    labels = lambda *rows: spark.createDataFrame(list(rows), "item_id string, sha256 string, video_label string")
    out, cover = vd.apply_reference_labels(items, labels(("i0", "a", "negative"), ("i1", None, "uncertain")), ["video_label"])
    assert {r["item_id"]: r["video_label"] for r in out.collect()} == {"i0": "negative", "i1": "uncertain", "i2": "positive", "i3": "positive"}
    assert {r["cover"] for r in cover.collect()} == {"both"}
    for rows, message in (((("i0", "a", "x"),), "exactly"), ((("i0", "a", "x"), ("i1", None, "x"), ("i2", None, "x")), "exactly"), ((("i0", "a", "x"), ("i0", "a", "x"), ("i1", None, "x")), "exactly"), ((("i0", "b", "x"), ("i1", None, "x")), "another file")):
        with pytest.raises(Exception, match=message):
            vd.apply_reference_labels(items, labels(*rows), ["video_label"])[0].collect()


def digest(*parts):
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


@pytest.mark.parametrize("seed", range(4))
def test_capped_select_is_the_greedy_walk(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "b", "c", "d", None]), rng.random() < 0.4) for i in range(60)]
    frame = spark.createDataFrame(rows, "item_id bigint, subject string, hard boolean")
    strata = [("hard", F.col("hard"), 6), ("rest", ~F.col("hard"), 7)]
    want, used, short = [], {}, False
    for name, on, target in (("hard", True, 6), ("rest", False, 7)):
        taken = 0
        for i, subject, hard in sorted(rows, key=lambda r: digest("s", r[0])):
            if hard == on and taken < target and used.get(subject, 0) < 3:
                used[subject] = used.get(subject, 0) + 1
                taken += 1
                want.append((i, name, taken))
        short |= taken < target
    if short:
        with pytest.raises(ValueError, match="only"):
            sl.capped_select(frame, strata, cap=3, seed="s", ident="item_id", subject="subject")
    else:
        got = sl.capped_select(frame, strata, cap=3, seed="s", ident="item_id", subject="subject")
        assert sorted((r["item_id"], r["stratum"], r["place"]) for r in got.collect()) == sorted(want)
    with pytest.raises(ValueError, match="only"):
        sl.capped_select(frame, [("all", F.lit(True), 16)], cap=3, seed="s", ident="item_id", subject="subject")
    assert sl.split_total(5, 0.5) == (2, 3)


def test_stratified_select(spark):
    rows = [(i, f"g{i % 8}", i % 3 == 0) for i in range(40)]
    frame = spark.createDataFrame(rows, "item_id bigint, grp string, hot boolean")
    want, used = [], set()
    for name, on, n in (("hot", True, 3), ("cold", False, 5)):
        groups = sorted({g for _, g, h in rows if h == on} - used, key=lambda g: digest("s", "prompt", g))[:n]
        for g in groups:
            used.add(g)
            want.append((min((i for i, x, h in rows if x == g and h == on), key=lambda i: digest("s", "video", i)), g, name))
    got = sl.stratified_select(frame, [("hot", F.col("hot"), 3), ("cold", ~F.col("hot"), 5)], seed="s", ident="item_id", group="grp")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    with pytest.raises(ValueError, match="only 1 of 2"):
        sl.stratified_select(frame.where("item_id = 1"), [("all", F.lit(True), 2)], seed="s", ident="item_id", group="grp")


def test_audits_are_blind(spark):
    frame = spark.range(200).selectExpr("id as item_id", "id % 50 = 0 as alert", "concat('f', id) as file")
    out = sl.audit_sample(frame, {"alert": F.col("alert")}, share=0.1, least=5, seed="s", ident="item_id")
    key = {r["review_id"]: r for r in sl.review_key(out, "item_id").collect()}
    assert sorted(key) == [f"R{i:03d}" for i in range(1, 201)]
    kinds = [r["selection"] for r in key.values()]
    assert (kinds.count("alert"), kinds.count("random_audit"), kinds.count("complement")) == (4, 20, 176)
    first = [key[f"R{i:03d}"] for i in range(1, 25)]
    assert all(r["batch"] == 1 for r in first) and [r["item_id"] for r in first] == sorted((r["item_id"] for r in first), key=lambda i: digest("s", "order", i))
    sheet = sl.review_sheet(out, ["file"])
    assert sheet.columns == ["review_id", "batch", "file"] and {r["review_id"]: r["file"] for r in sheet.collect()} == {k: f"f{r['item_id']}" for k, r in key.items()}
    every = sl.audit_sample(frame.limit(3), {"alert": F.col("alert")}, share=0.1, least=5, seed="s", ident="item_id")
    assert every.where("batch = 1").count() == 3 and sl.audit_sample(frame.limit(0), {"alert": F.col("alert")}, share=0.1, least=5, seed="s", ident="item_id").count() == 0


def test_journals(spark):
    log = lambda b, *kinds: [("r", b, k, i) for i, k in enumerate(kinds)]
    rows = log(1, "started", "completed") + log(2, "started", "invalid", "completed") + log(3, "started", "invalid", "failed") + log(4, "started") + log(5, "started", "cancelled") + log(6, "started", "invalid")
    events = spark.createDataFrame(rows + [("q", 1, "started", 0)], "run string, batch bigint, kind string, seq bigint")
    plan = spark.createDataFrame([("r", b) for b in range(1, 9)], "run string, batch bigint")
    out = {r["run"]: r.asDict() for r in rn.batch_reliability(plan, events, ["run"]).collect()}
    assert out["r"] == {"run": "r", "planned": 8, "started": 6, "unprocessed": 2, "unfinished": 2, "completed": 2, "failed": 1, "cancelled": 1, "invalid": 2, "repaired": 1}
    assert out["q"]["planned"] is None and out["q"]["unprocessed"] is None and out["q"]["unfinished"] == 1


def test_catalogues(spark):
    seg = [("a", "v", "nudity", 0, 9, [2]), ("a", "v", "gender", 0, 9, [1, 2]), ("a", "w", "nudity", 0, 9, [0, 1]), ("a", "w", "nudity", 12, 14, [2]), ("a", "w", "nudity", 13, 20, [2]), ("b", "x", "nudity", 0, 3, [1])]
    frame = spark.createDataFrame(seg, "action string, item_id string, attribute string, first_frame int, last_frame int, values array<int>")
    members = spark.createDataFrame([("a", "v"), ("c", "z")], "action string, item_id string")
    out = {r["item_id"]: r for r in ct.attribute_catalogue(frame, members, attribute="nudity", level=2, values_of="gender", flag=("gender", 2)).collect()}
    assert set(out) == {"v", "w"} and out["v"]["whole"] and out["v"]["in_archive"] and out["v"]["values"] == "1|2" and out["v"]["flagged"]
    w = out["w"]
    assert (w["segments"], w["level_frames"], w["annotated_frames"], w["extent_frames"], w["fraction"], w["first_level_s"], w["values"], w["in_archive"], w["whole"]) == ("12-14;13-20", 11, 21, 21, 0.5238, 0.4, "", False, False)
    roll = {r["action"]: r.asDict() for r in ct.catalogue_rollup(frame, members, attribute="nudity", level=2).collect()}
    assert roll["a"] == {"action": "a", "annotated": 2, "level_0": 0, "level_1": 0, "level_2": 2, "in_archive": 1, "archive_present": True} and not roll["b"]["archive_present"]
    issues = sorted((r["item_id"], r["attribute"] or "", r["issue"]) for r in ct.annotation_issues(frame, ["action", "item_id", "attribute"], attribute="attribute").collect())
    assert issues == [("w", "nudity", "gap"), ("w", "nudity", "overlap")]
    back = spark.createDataFrame([("v", "k", 0, 5, 0), ("v", "k", 9, 12, 1), ("v", "k", 6, 8, 2), ("v", "l", 2, 7, 0)], "item_id string, attribute string, first_frame int, last_frame int, n int")
    got = sorted((r["attribute"] or "", r["issue"]) for r in ct.annotation_issues(back, ["item_id", "attribute"], attribute="attribute", order="n").collect())
    assert got == [("", "ends differ"), ("k", "gap"), ("k", "unordered"), ("l", "does not start at 0")]
    with pytest.raises(Exception, match="twice"):
        ct.compare_models(spark.createDataFrame([("m", "x", 1.0), ("m", "x", 2.0)], "metric string, model string, value double"), ["x"], current="y").collect()
    with pytest.raises(ValueError):
        ct.to_manifest(members, {"item_id": F.col("item_id")})

from __future__ import annotations

import math
import random

import pytest

from spanframe.llm import quality
from spanframe.llm.quality import UNIT, features_of, score_quality, site_posteriors

CLEAN = "river bank morning light house garden winter letter market bread window travel story music school".split()


def corpus(spark, n=400, seed=2):
    random.seed(seed)
    docs, labels, truth = [], [], {}
    for i in range(n):
        words = [random.choice(CLEAN) + random.choice(["", "s", "ing"]) for _ in range(random.randrange(20, 200))]
        kind = random.choice([0, 0, 0, 1, 2])
        if kind == 1:
            words = [w.upper() + "!!" for w in words] if i % 4 < 2 else [w for w in words[:9] for _ in range(20)]
        if kind == 2:
            words[random.randrange(len(words))] = random.choice(["vilest", "scummy", "loathed"])
        docs.append((i, " ".join(words) + ".", "en", f"s{i % 7}" if i % 3 else "hot"))
        truth[i] = kind == 0
        if i % 2:
            labels.append((i, int(kind != 1), int(kind == 2)))
    return spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), truth


def test_rejects_bad_and_toxic_documents(spark):
    docs, labels, truth = corpus(spark)
    out = {r["doc_id"]: r for r in score_quality(docs, labels).collect()}
    assert len(out) == 400 and all(0 <= r["score"] <= 1 and r["keep"] == (r["score"] >= 0.5) for r in out.values())
    unseen = [i for i in out if i % 2 == 0]
    wrong = [i for i in unseen if out[i]["keep"] != truth[i]]
    assert len(wrong) <= 0.02 * len(unseen)


def test_reruns_agree(spark):
    docs, labels, _ = corpus(spark, 200, 5)
    a = {tuple(r) for r in score_quality(docs, labels).collect()}
    b = {tuple(r) for r in score_quality(docs.repartition(6), labels.repartition(3)).collect()}
    assert a == b


def test_sites_shrink_toward_their_parents(spark):
    rows = [("big", "a", 0.9)] * 300 + [("big", "b", 0.9)] * 300 + [("small", "a", 0.0)] + [("bad", "a", 0.1)] * 300
    scored = spark.createDataFrame([(h, p, round(x * UNIT)) for h, p, x in rows], "host string, path string, p bigint")
    sites, share, k_host, k_path = site_posteriors(scored)
    got = {(r["host"], r["path"]): r for r in sites.collect()}
    assert share == pytest.approx(sum(x for *_, x in rows) / len(rows), abs=1e-6) and 2 <= k_host <= 10_000 and 2 <= k_path <= 10_000
    mean = lambda r: (r["s_host"] / UNIT + k_host * share) / (r["n_host"] + k_host)
    assert mean(got["bad", "a"]) < mean(got["small", "a"]) < share < mean(got["big", "a"]) < 0.9
    assert got["big", "b"]["n_host"] == 600 and got["big", "b"]["n_path"] == 300


def test_site_evidence_moves_doubtful_documents(spark, monkeypatch):
    model = quality.Model({"good": 3.0, "bad": -3.0}, *([0.0] * 7 for _ in range(2)), [1.0] * 7, 0.0)
    import numpy as np

    model.shape, model.mean, model.scale = (np.array(x, dtype=float) for x in (model.shape, model.mean, model.scale))
    monkeypatch.setattr(quality, "fit", lambda *a, **k: model)
    rows = [(i, "good" if i < 100 else "bad", "x", "fine" if i < 100 else "poor") for i in range(200)] + [(200, "plain", "x", "fine"), (201, "plain", "x", "poor"), (202, "plain", None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    out = {r["doc_id"]: r for r in score_quality(docs, docs).collect()}
    assert out[200]["keep"] and not out[201]["keep"] and out[201]["score"] < out[202]["score"] < out[200]["score"]
    assert out[0]["evidence"] == pytest.approx(3.0) and math.isclose(out[202]["evidence"], 0.0)


def test_features():
    named, shape = features_of("LOUD words words, 12!")
    assert named == {"loud", "words", "^word"} and shape[0] == pytest.approx(1 / 8) and shape[3] == pytest.approx(1 / 8)
    assert features_of(None) == features_of("") and len(shape) == len(quality.SHAPE)


def test_odd_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (1, 1, None), (3, 0, 1), (6, None, 1), (99, 1, 0)], "doc_id bigint, quality int, toxic int")
    out = score_quality(odd_docs, labels, path="id")
    assert out.count() == 11 and out.where("score is null or keep is null").count() == 0
    assert score_quality(odd_docs.union(odd_docs), labels).count() == 22
    assert score_quality(no_docs, labels).count() == 0
    kept = score_quality(odd_docs, labels.limit(0))
    assert kept.where("keep and evidence = 0").count() == 11


def brute_features(text):
    """Words, their beginnings and the shape, letter by letter."""
    words, now = [], ""
    for c in (text or "") + " ":
        if c.isalpha():
            now += c
        elif now:
            words.append(now)
            now = ""
    low = [w.lower() for w in words]
    n, m = len(text or "") + 20, len(words) + 5
    digits = sum(c in "0123456789" for c in text or "")
    symbols = sum(not c.isalpha() and c not in "0123456789 \n\t\r" for c in text or "")
    again = sum(w in low[i // 50 * 50 : i] for i, w in enumerate(low))
    size = math.log1p(len(low))
    shape = [sum(w.isupper() and len(w) > 1 for w in words) / m, symbols / n, digits / n, sum(a == b for a, b in zip(low, low[1:], strict=False)) / m, again / m, max(0.0, 4 - size), max(0.0, size - 4)]
    return set(low) | {"^" + w[:4] for w in low if len(w) > 4}, shape


def brute_scores(rows, model):
    """rows: (id, text, host, path) -> {id: (evidence, host_mean, path_mean, score)}, straight from the definitions."""
    out, scored = {}, []
    for i, text, host, path in rows:
        named, shape = brute_features(text)
        z = model.bias + sum(model.weights.get(x, 0) for x in named)
        z += sum(max(-8, min(8, (x - m) / s)) * w for x, m, s, w in zip(shape, model.mean, model.scale, model.shape, strict=True))
        e = max(-30, min(30, z))
        scored.append((i, host, path, e, round(UNIT / (1 + math.exp(-e))) / UNIT))
    share = sum(p for *_, p in scored) / len(scored)

    def strength(sites, parent_of, parents):
        """sites: {key: [p]}; parents: {key: [p]}."""
        many = {k for k in sites if sum(parent_of(j) == parent_of(k) for j in sites) > 1}
        ups = {parent_of(k) for k in many}
        mean = lambda x: sum(x) / len(x)
        chance = {u: mean(parents[u]) * (1 - mean(parents[u])) for u in ups}
        count = {u: sum(parent_of(k) == u for k in many) for u in ups}
        off = sum(len(sites[k]) * (mean(sites[k]) - mean(parents[parent_of(k)])) ** 2 for k in many) - sum((count[u] - 1) * chance[u] for u in ups)
        room = sum(len(parents[u]) - sum(len(sites[k]) ** 2 for k in many if parent_of(k) == u) / len(parents[u]) for u in ups)
        spread = sum(len(parents[u]) * chance[u] for u in ups) / sum(len(parents[u]) for u in ups)
        return 10_000 if off <= 0 else min(10_000, max(2, spread / (off / room) - 1))

    hosts, paths = {}, {}
    for _, host, path, _, p in scored:
        hosts.setdefault(host, []).append(p)
        paths.setdefault((host, path), []).append(p)
    k_host = strength(hosts, lambda _: "all", {"all": [p for *_, p in scored]})
    k_path = strength(paths, lambda k: k[0], hosts)
    for i, host, path, e, p in scored:
        h = (sum(hosts[host]) - p + k_host * share) / (len(hosts[host]) - 1 + k_host)
        q = (sum(paths[host, path]) - p + k_path * h) / (len(paths[host, path]) - 1 + k_path)
        odds = e + math.log(q / (1 - q)) - math.log(share / (1 - share))
        out[i] = (e, h, q, 1 / (1 + math.exp(-odds)))
    return out, k_host, k_path


def test_every_posterior_against_brute_force(spark):
    docs, labels, _ = corpus(spark, 300, 8)
    docs = docs.selectExpr("doc_id", "text", "if(doc_id % 5 = 0, null, if(doc_id % 2 = 0, 'de', 'en')) as lang", "source")
    model = quality.fit(docs, labels)
    rows = [(r["doc_id"], r["text"], r["source"], r["lang"]) for r in docs.collect()]
    expected, _, _ = brute_scores(rows, model)
    for r in score_quality(docs, labels).collect():
        assert (r["evidence"], r["host_mean"], r["path_mean"], r["score"]) == pytest.approx(expected[r["doc_id"]], abs=2e-6)


def test_paths_that_agree_with_their_hosts_are_shrunk_fully(spark):
    rows = [(h, f"p{i % 4}", x) for h, x in (("a", 0.95), ("b", 0.05), ("c", 0.6)) for i in range(200)]
    scored = spark.createDataFrame([(h, p, round(x * UNIT)) for h, p, x in rows], "host string, path string, p bigint")
    _, _, k_host, k_path = site_posteriors(scored)
    assert k_path == 10_000 and k_host < 10


def test_ids_may_repeat_or_be_null_and_texts_be_long(spark):
    docs, labels, _ = corpus(spark, 200, 3)
    more = docs.union(docs.where("doc_id < 40").selectExpr("doc_id", "concat(text, ' Another one.')", "lang", "source"))
    more = more.union(docs.where("doc_id < 9").selectExpr("cast(null as bigint)", "text", "lang", "source")).union(spark.createDataFrame([(500, "word " * 400_000, "en", None)], docs.schema))
    out = score_quality(more, labels.union(spark.createDataFrame([(None, 0, 1)], labels.schema)), keep=("text",)).collect()
    assert len(out) == 200 + 40 + 9 + 1 and sum(r["doc_id"] is None for r in out) == 9
    assert quality.fit(more, labels, sample=10).weights.keys() <= quality.fit(docs, labels).weights.keys() | {"^anot", "another", "one"} | set().union(*(quality.features_of(r["text"])[0] for r in docs.collect()))
    assert quality._sample(more, labels, "doc_id", "text", 10).count() == 10

from __future__ import annotations

import zlib

import numpy as np
import pytest

import corpus_pipeline
from spanframe.llm import encoder as encoding
from spanframe.llm.mixing import mix_sources
from spanframe.llm.quality import score_quality
from spanframe.llm.queries import queries, tokenizer_file

from .test_decontam import brute as brute_spans
from .test_quality import corpus
from .test_simhash import brute_components, brute_fingerprint


ITEMS = ("a quite particular benchmark question about rivers and banks and the light of winter mornings there", "short one")


def brute_cut(text, items, window=13):
    """The words of text outside any window of an item."""
    said, gone = text.split(), set()
    low = [w.lower().strip(".,!") for w in said]
    for item in items:
        w = item.split()
        for k in range(max(1, len(w) - window + 1)):
            part = w[k : k + window]
            gone |= {i + j for i in range(len(low)) if low[i : i + len(part)] == part for j in range(len(part))}
    return [w for i, w in enumerate(said) if i not in gone]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    docs, labels, _ = corpus(spark, 240, 3)
    rows = [tuple(r) for r in docs.collect()]
    item = ITEMS[0]
    rows += [(1000 + i, rows[5 * i][1], "en", "copies") for i in range(20)]
    rows += [(2000 + i, f"some words before {item} {rows[i][1]}"[: 400 + i], "en", None) for i in range(10)]
    long = [r[1] for r in rows if len(r[1].split()) > 150 and r[1].islower() and len(set(r[1].split())) > 20]
    rows += [(3000 + i, f"{' '.join(t.split()[i:90])} short one {' '.join(t.split()[90:])}", "en", "late") for i, t in enumerate(long)]
    path = str(tmp_path_factory.mktemp("tables"))
    frame = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    frame.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(7, item), (8, ITEMS[1])], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, [float(i % 3), 1.0], i % 4) for i in range(60)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


def test_pipeline_against_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in score_quality(docs, labels).where("keep").collect()}
    comp = brute_components({i: brute_fingerprint(text[i]) for i in kept})
    first = {i for i in kept if comp[i] == i}
    dirty = brute_spans([(i, text[i]) for i in first], [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()])
    clean = sorted(i for i in first if not dirty[i][4])
    before = {r["doc_id"]: tuple(r) for r in docs.collect()}
    words = {i: brute_cut(text[i], ITEMS) for i in clean}
    changed = [i for i in clean if words[i] != text[i].split()]
    assert changed and all(len(words[i]) < len(text[i].split()) for i in changed)
    rest = spark.createDataFrame([(i, " ".join(words[i]) if i in changed else text[i], *before[i][2:]) for i in clean], docs.schema)
    assert len(kept) < len(text) and len(first) < len(kept) and len(clean) < len(first)
    copies = {r["doc_id"]: r["copies"] for r in mix_sources(rest).collect()}
    text = {r["doc_id"]: r["text"] for r in rest.collect()}
    code, at, expected = encoding.encoder(tokenizer_file()), 0, []
    for i in clean:
        for _ in range(copies[i]):
            ids = np.array([*code.whole.encode(text[i], add_special_tokens=False).ids, 2], dtype="<u4")
            expected.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
    assert sorted(map(tuple, corpus_pipeline.run(spark, tables).collect())) == expected


def test_stages_keep_the_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, tables).columns == docs.columns


def test_every_query_runs(spark, tables):
    found = queries()
    assert [int(n[2:].split("_")[0]) for n in found] == list(range(1, 14))
    for name, query in found.items():
        assert query(spark, tables).count() > 0, name


def _contents(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_stages_decide_by_row(spark, tables):
    from collections import Counter

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    clean = docs.where("doc_id < 1000")
    one, kept = clean.limit(1), corpus_pipeline.quality(spark, clean, tables)
    good = kept.orderBy("doc_id").limit(6).collect()
    unnamed = [(None, *r[1:]) for r in good[:3]]
    shared = [(good[3][0], *good[4][1:])]
    more = docs.union(spark.createDataFrame([*unnamed, *shared, *unnamed[:1]], docs.schema))
    assert one.count() == 1
    # Quality: null ids and both contents of a shared id stay, repeats too.
    left = Counter(map(tuple, corpus_pipeline.quality(spark, more, tables).collect()))
    assert left[unnamed[0]] == 2 and left[unnamed[1]] == left[unnamed[2]] == left[shared[0]] == 1
    # Near duplicates: a different text of the same id, and texts without an id, are kept once.
    few = spark.createDataFrame([tuple(good[0]), tuple(good[0]), (good[0][0], *good[1][1:]), *unnamed[2:], *unnamed[2:]], docs.schema)
    comp = brute_components({i: brute_fingerprint(t) for i, t in enumerate((good[0][1], good[1][1], good[2][1]))})
    assert len(set(comp.values())) == 3
    assert _contents(corpus_pipeline.near_dedup(spark, few, tables)) == sorted([tuple(good[0]), (good[0][0], *good[1][1:]), unnamed[2]], key=repr)
    # Mixing: as many rows as copies, not their product, and null ids among them.
    twice = clean.union(clean).union(spark.createDataFrame(unnamed, docs.schema))
    mixed = corpus_pipeline.mix(spark, twice, tables)
    wanted = Counter()
    for r in mix_sources(twice).collect():
        wanted[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in mixed.collect()) == +wanted and wanted[None] > 0


def test_stages_of_odd_rows(spark, tables):
    """Null ids and texts, two texts under one id, repeats, long blanks, clashing names and empty tables, stage by stage."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    good = corpus_pipeline.quality(spark, docs.where("doc_id < 1000"), tables).orderBy("doc_id").limit(8).collect()
    texts = [r["text"] for r in good]
    odd = [(None, texts[0]), (None, texts[1]), (1, texts[2]), (1, texts[3]), (2, texts[4]), (2, texts[4]), (3, None), (4, ""), (5, texts[5] + " " * 300_000)]
    rows = [(i, t, "en", "s", len(t or ""), None if i is None else i * 10, "r") for i, t in odd]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, copies bigint, fp string")
    empty = frame.limit(0)
    clean = [r for r in rows if (r[1] or "").strip()]
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, empty, tables)
        assert none.count() == 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert none.columns == frame.columns
    left = [tuple(r) for r in corpus_pipeline.quality(spark, frame, tables).collect()]
    assert sorted((r for r in left if (r[1] or "").strip()), key=repr) == sorted(clean, key=repr)
    once = [tuple(r) for r in corpus_pipeline.near_dedup(spark, frame, tables).collect()]
    assert sorted(once, key=repr) == sorted({r for r in rows if r[0] != 4}, key=repr)
    same = [tuple(r) for r in corpus_pipeline.decontaminate(spark, frame, tables).collect()]
    assert sorted(same, key=repr) == sorted(rows, key=repr)
    taken = [tuple(r) for r in corpus_pipeline.mix(spark, frame, tables).collect()]
    assert set(taken) <= set(clean) and all(taken.count(r) <= 2 * rows.count(r) for r in taken) and len(taken) > len(clean)
    ids = corpus_pipeline.token_ids(spark, frame, tables).collect()
    assert sorted(r["doc_id"] or 0 for r in ids) == sorted(r[0] or 0 for r in rows) and sum(r["n_tokens"] == 1 for r in ids) == 2


def test_clashing_names_and_maps_pass_all_stages(spark, tables):
    names = ("__mark", "__mark2", "__row", "doc_id_2", "__mark_2", "own_mark", "OWN_ROW", "spans", "n_words", "cut", "items", "n_hit", "contaminated", "keep", "copies", "size", "component_id", "a b")
    docs = spark.read.parquet(f"{tables}/documents.parquet").where("doc_id < 60")
    wide = docs.selectExpr("*", *(f"concat('{i}-', doc_id) as `{n}`" for i, n in enumerate(names)), "map('k', doc_id) as m", "array(map('k', doc_id)) as ms")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out, plain = stage(spark, wide, tables), stage(spark, docs, tables)
        assert out.columns == wide.columns, name
        rows = out.collect()
        assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted((r["doc_id"], r["text"]) for r in plain.collect()), name
        assert rows and all(r[n] == f"{i}-{r['doc_id']}" for r in rows for i, n in enumerate(names)) and all(r["m"]["k"] == r["ms"][0]["k"] == r["doc_id"] for r in rows), name

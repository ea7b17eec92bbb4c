"""Every registered query against its oracle on the smallest tables."""

from __future__ import annotations

import os

import pytest

from spanframe.plans import registry

from .compare import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_oracle(spark, con, name):
    assert compare(spark, con, SF, registry.queries()[name], registry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_online_reduction_equals_batch(spark):
    found = registry.queries()
    rows = lambda n: sorted((r["media_id"], r["sample_id"], r["disposition"], r["duplicate_of_us"]) for r in found[n](spark, SF).collect())
    assert rows("x04_reduce_static") == rows("m11_reduce_static")


def test_secrets_of_whole_texts_are_redacted(spark, tmp_path):
    filler = "plain words " * 60
    texts = [f"{filler}password = hunter2 and token: abc /home/me/x end", "api_key=k1 here", "nothing", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = [f"{filler}password=[redacted] and token=[redacted] [path]", "api_key=[redacted] here", "nothing", None, ""]
    query, sql = registry.queries()["f26_redact_whole"], registry.oracle_sql()["f26_redact_whole"]
    got = {r["doc_id"]: (r["safe"], r["whole"]) for r in query(spark, str(tmp_path)).collect()}
    import hashlib

    assert got == {i: (None, None) if t is None else (t[:400], hashlib.md5(t.encode()).hexdigest()) for i, t in enumerate(want)}
    assert compare(spark, connect(str(tmp_path)), str(tmp_path), query, sql) is None

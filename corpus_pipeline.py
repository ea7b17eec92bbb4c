"""A training corpus in five stages: quality, near duplicates, contamination, source mixing, token files.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents. Decisions belong to rows:
they travel with the row, or (in quality and near_dedup, which would else carry texts through Python or an aggregation) with
its doc_id and 128 bits of hash of all its columns. So rows of one doc_id with other contents, and rows of null doc_id, each
have their own, and only rows that are equal in every column share one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanframe.llm._base import load, scratch_path, settled
from spanframe.llm.decontam import contamination
from spanframe.llm.mixing import mix_sources
from spanframe.llm.quality import score_quality
from spanframe.llm.queries import tokenizer_file
from spanframe.llm.simhash import one_of_each_class
from spanframe.llm.token_files import token_digests, write_token_files


def _columns(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def _fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names with a prefix that no column of docs begins with, whatever its case."""
    prefix = "own_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"own_{prefix}"
    return [prefix + n for n in names]


def _hashable(column: str, kind: T.DataType) -> Column:
    """The column, or its text where it holds a map, which has no hash."""
    return F.to_json(F.struct(F.col(f"`{column}`").alias("c")), {"ignoreNullFields": "false"}) if "map<" in kind.simpleString() else F.col(f"`{column}`")


def _marked(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with 128 bits of hash of all columns in two more, and their names."""
    marks = _fresh(docs, "mark", "mark2")
    columns = [x for f in docs.schema for x in (F.col(f"`{f.name}`").isNull(), _hashable(f.name, f.dataType))]
    return docs.withColumns({m: F.xxhash64(F.lit(i), *columns) for i, m in enumerate(marks)}), marks


def _rows(docs: DataFrame, marks: list[str], chosen: DataFrame) -> DataFrame:
    """The marked docs that chosen(doc_id, the marks) holds."""
    other = _fresh(docs, "id", *(f"other{i}" for i in range(len(marks))))
    found = chosen.toDF(*other)
    same = [F.col(m) == F.col(o) for m, o in zip(marks, other[1:], strict=True)]
    return docs.join(found, [*same, F.col("doc_id").eqNullSafe(F.col(other[0]))], "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier keeps, each judged by its own text: null ids, repeats (all of them), null and empty
    texts (by their shape), and a score of exactly one half are kept or go by their score alone. Ids that no label names only
    teach nothing. An empty table gives an empty one."""
    rows, marks = _marked(docs)
    kept = score_quality(rows, load(spark, sf_dir, "labels"), keep=tuple(marks)).where("keep").select("doc_id", *marks).distinct()
    return _rows(rows, marks, kept).select(_columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest doc_id (null last), of several the smallest hash.

    Different texts of one doc_id, and of no doc_id, are in groups of their own; rows that are equal in every column are one.
    Null, empty and blank texts are one group, as all have the fingerprint 0. An empty table gives an empty one."""
    rows, marks = _marked(docs)
    return _rows(rows, marks, one_of_each_class(rows, keep=tuple(marks))).dropDuplicates(["doc_id", *marks]).select(_columns(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items, without the spans that still repeat an item's words.

    Contaminated is what the operator's rule says: a twentieth of the words, at least. n_chars follows the text; texts
    without a span stay as they are, null and empty ones too. Rows of null or repeated ids are judged each by its own text.
    An empty table, or an empty benchmark, changes nothing."""
    (row,) = _fresh(docs, "row")
    carried = docs.withColumn(row, F.struct(*(c for c in _columns(docs) if c not in ("`doc_id`", "`text`"))) if len(docs.columns) > 2 else F.lit(True))
    clean = contamination(carried, load(spark, sf_dir, "benchmark"), keep=(row,), cut=True).where("not contaminated")
    value = {c: F.col(row)[c] for c in docs.columns} | {"doc_id": F.col("doc_id"), "text": F.col("cut")}
    if "n_chars" in docs.columns:
        value["n_chars"] = F.when(F.size("spans") > 0, F.length("cut")).otherwise(value["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return clean.select(*(value[c].alias(c) for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, null ids too; texts without words, null ones too, are never taken. Equal rows
    stand as often as the mix takes them together; ties between documents of one source and size go by the hash of their
    ids. An empty table gives an empty one."""
    (row,) = _fresh(docs, "row")
    out = mix_sources(docs.withColumn(row, F.struct(*_columns(docs))), keep=(row,)).where("copies > 0")
    return out.select(row, F.explode(F.sequence(F.lit(1), F.col("copies")))).select(f"{row}.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token files; their documents, as read back from them. Null texts are empty and have only the end id; null
    ids come first, rows of one id in the order of their texts' hashes. An empty table gives no rows."""
    path = scratch_path(spark, "tokens")
    write_token_files(docs, path, tokenizer_file())
    return token_digests(spark, path).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", token_ids),
]

#: SQL cannot express the stages; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. What a stage stores on its way is deleted once its result is stored."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)

"""Quality classifier with hierarchical empirical Bayes over sites.

1. Evidence. A logistic regression over a document's words and shape, fitted on a bounded sample of labelled rows, gives
   each document log-odds of being acceptable (of good quality and not toxic). A word or word beginning counts if it is
   commoner in a class of unacceptable documents, and its log-likelihood ratio exceeds what chance gives the best of all
   candidates (2 ln of their number).
2. Sites. Grouped sums of the documents' probabilities give each host and each path below it a posterior mean of its share
   of acceptable documents: a host is shrunk toward the global share, a path toward its host. The strength of each level's
   prior comes from the spread between its sites (method of moments), so sparse sites stay near their parent.
3. Decision. A document's log-odds, with the global prior replaced by its path's posterior without the document itself.

Text is read once for the sample and once for the evidence; only the sample is shuffled. Sums are whole numbers
(millionths), so reruns agree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import join_heavy, stored

#: Most labelled rows that the fit uses: those with the smallest hashes of their ids.
SAMPLE = 20_000
_WORD = re.compile(r"[^\W\d_]+")
SHAPE = ("capitals", "symbols", "digits", "repeated", "again", "short", "long")
UNIT = 1_000_000


def features_of(text: str | None) -> tuple[set[str], list[float]]:
    """Lower-case words and their first four letters as a set, and the shape: shares of words in capitals, of symbols and
    digits among characters, of words equal to the one before, of words said again among 50 in a row, and the log length
    below and above some 50 words."""
    text = text or ""
    words = _WORD.findall(text)
    low = [w.lower() for w in words]
    named = set(low)
    named |= {"^" + w[:4] for w in named if len(w) > 4}
    n, m = len(text) + 20, len(words) + 5  # short texts are shrunk toward none of it
    spaces = sum(map(text.count, " \n\t\r"))
    digits = sum(map(text.count, "0123456789"))
    capitals = sum(1 for w in words if len(w) > 1 and w.isupper())
    symbols = max(0, len(text) - sum(map(len, words)) - spaces - digits)
    repeated = sum(map(str.__eq__, low[1:], low[:-1])) / m
    parts = [low[i : i + 50] for i in range(0, len(low), 50)] or [[]]
    again = len(low) - sum(len(set(p)) for p in parts)
    size = np.log1p(len(low))
    return named, [capitals / m, symbols / n, digits / n, repeated, again / m, max(0.0, 4 - size), max(0.0, size - 4)]


@dataclass
class Model:
    weights: dict[str, float]
    shape: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    bias: float

    def evidence(self, text: str | None) -> float:
        """Log-odds of an acceptable document."""
        named, shape = features_of(text)
        get = self.weights.get
        z = self.bias + sum(get(x, 0.0) for x in named) + float(((np.array(shape) - self.mean) / self.scale).clip(-8, 8) @ self.shape)
        return max(-30.0, min(30.0, z))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """(id, text, kind), one row an id; kind 0 is acceptable, 1 of low quality, 2 toxic. Of several texts of one id the one
    with the smallest hash is taken."""
    kind = F.when(F.coalesce("toxic", F.lit(0)) > 0, 2).when(F.col("quality") > 0, 0).otherwise(1)
    known = labels.where("quality is not null").select(F.col(id_col).alias("id"), kind.alias("kind"))
    known = known.groupBy("id").agg(F.max("kind").alias("kind")).orderBy(F.xxhash64("id"), "id").limit(limit)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    one = rows.groupBy("id").agg(F.max("kind").alias("kind"), F.min(F.struct(F.xxhash64("text").alias("m"), "text")).alias("t"))
    return one.select("id", F.col("t.text").alias("text"), "kind")


def _llr(k: Column, n: int, others: Column, n_others: int) -> Column:
    """Log-likelihood ratio of k of n documents of a class and others of n_others having a feature; 0 if it is not commoner
    in the class."""

    def fit_of(k: Column, n: int) -> Column:
        p = F.greatest(k / F.lit(float(max(n, 1))), F.lit(1e-12))
        return k * F.log(p) + (n - k) * F.log(F.greatest(1 - p, F.lit(1e-12)))

    ratio = 2 * (fit_of(k, n) + fit_of(others, n_others) - fit_of(k + others, n + n_others))
    return F.when(k * n_others > others * n, ratio).otherwise(0.0)


def _ridge_logistic(rows: list[np.ndarray], dense: np.ndarray, good: np.ndarray, width: int, ridge: float = 0.02) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of a ridge logistic regression over present features and dense columns: Newton steps, each solved by
    conjugate gradients on the sparse rows."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
    n, k = dense.shape
    penalty = np.concatenate((np.full(width + k, ridge), [1e-6]))

    def ahead(v):
        return np.bincount(at, weights=v[col], minlength=n) + dense @ v[width:-1] + v[-1]

    def back(r):
        return np.concatenate((np.bincount(col, weights=r[at], minlength=width), dense.T @ r, [r.sum()]))

    def loss(v, z):
        return np.logaddexp(0, np.where(good, -z, z)).sum() + 0.5 * (penalty * v * v).sum()

    x = np.zeros(width + k + 1)
    z = ahead(x)
    for _ in range(25):
        p = 1 / (1 + np.exp(-z))
        g = back(p - good) + penalty * x
        if np.abs(g).max() < 1e-3:
            break
        w = p * (1 - p)
        scale = 1 / (np.concatenate((np.bincount(col, weights=w[at], minlength=width), (dense**2).T @ w, [w.sum()])) + penalty)
        d, r = np.zeros_like(x), -g
        q = scale * r
        s, rq = q.copy(), r @ q
        first = rq
        for _ in range(40):
            h = back(w * ahead(s)) + penalty * s
            t = rq / (s @ h)
            d, r = d + t * s, r - t * h
            q = scale * r
            new = r @ q
            if new < 1e-4 * first:
                break
            s, rq = q + new / rq * s, new
        step, base = 1.0, loss(x, z)
        while loss(x + step * d, ahead(x + step * d)) > base + 1e-4 * step * (g @ d) and step > 1e-4:
            step /= 2
        x = x + step * d
        z = ahead(x)
    return x[:width], x[width:-1], float(x[-1])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model | None:
    """The classifier of up to sample labelled rows; None if they lack one of the classes.

    Words are counted on the executors. What reaches the driver is bounded by the sample: its words above the level of
    chance, and for each of its rows which of them it has.
    """
    chosen = stored(_sample(docs, labels, id_col, text_col, sample), "sample")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import Counter

        total, n = [Counter() for _ in range(3)], [0, 0, 0]
        for b in batches:
            for text, kind in zip(b["text"], b["kind"], strict=True):
                total[kind].update(features_of(text)[0])
                n[kind] += 1
        for kind in range(3):
            yield pd.DataFrame({"f": ["", *total[kind]], "kind": kind, "n": [n[kind], *total[kind].values()]})

    of_kind = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).cast("double").alias(f"n{k}") for k in range(3)]
    counts = stored(chosen.mapInPandas(counted, "f string, kind int, n bigint").groupBy("f").agg(*of_kind), "features")
    totals = counts.where("f = ''").first()
    n = [int(totals[f"n{k}"]) for k in range(3)] if totals else [0, 0, 0]
    if not n[0] or not n[1] + n[2]:
        return None
    others = lambda k: (sum((F.col(f"n{j}") for j in range(3) if j != k), F.lit(0.0)), sum(n) - n[k])
    llr = F.greatest(_llr(F.col("n1"), n[1], *others(1)), _llr(F.col("n2"), n[2], *others(2)))
    least = 2 * float(np.log(max(2, counts.count())))
    top = counts.where("f <> ''").withColumn("llr", llr).where(F.col("llr") > least).select("f").collect()
    numbers = {f: i for i, f in enumerate(sorted(r["f"] for r in top))}

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [features_of(t) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "good": (b["kind"] == 0).astype(int), "has": [np.array(sorted(numbers[x] for x in named if x in numbers), dtype="<i4").tobytes() for named, _ in made], "shape": [s for _, s in made]})

    id_type = chosen.schema["id"].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("good", T.IntegerType()), T.StructField("has", T.BinaryType()), T.StructField("shape", T.ArrayType(T.DoubleType()))])
    rows = sorted(chosen.mapInPandas(measured, schema).collect(), key=lambda r: (str(r["id"]), r["good"], bytes(r["has"])))
    good = np.array([r["good"] for r in rows], dtype=bool)
    dense = np.array([r["shape"] for r in rows])
    mean, scale = dense.mean(axis=0), dense.std(axis=0) + 1e-3
    words, shape, bias = _ridge_logistic([np.frombuffer(r["has"], dtype="<i4") for r in rows], ((dense - mean) / scale).clip(-8, 8), good, len(numbers))
    return Model({f: float(words[i]) for f, i in numbers.items()}, shape, mean, scale, bias)


def evidence(docs: DataFrame, model: Model | None, *, id_col: str, text_col: str, host: Column, path: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, host, path, e, the columns in keep as __keep_<name>): each document's log-odds; 0 without a model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = shared.value
            e = pa.array([m.evidence(t.as_py()) if m else 0.0 for t in b.column(3)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], e, *b.columns[4:]], names=schema.names)

    rows = docs.select(F.col(id_col).alias("id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text_col).alias("text"), *(F.col(c).alias(f"__keep_{c}") for c in keep))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("e", T.DoubleType()), *(T.StructField(f"__keep_{c}", docs.schema[c].dataType) for c in keep)])
    return rows.mapInArrow(run, schema)


def _strength(sites: DataFrame) -> float:
    """Prior strength (in documents) of sites(n, s, n_up, s_up, k_up) below their parents, by the method of moments; bounded.

    A site's mean s / n varies around its parent's mean s_up / n_up; k_up is how many sites the parent has.
    """
    parent = F.col("s_up") / F.col("n_up")
    chance = parent * (1 - parent)
    total = lambda x: F.sum(x.cast("decimal(38,9)")).cast("double")
    n = F.col("n").cast("double")
    got = sites.where("k_up > 1").agg(
        total(n * (F.col("s") / n - parent) ** 2).alias("off"),
        total(chance * (1 - 1 / F.col("k_up"))).alias("noise"),
        total(n - n * n / F.col("n_up")).alias("room"),
        total(n * chance).alias("chance"),
        F.sum("n").alias("n"),
    ).first()
    if not got["n"] or not got["chance"]:
        return 100.0
    between = (got["off"] - got["noise"]) / max(1e-9, got["room"])
    return float(min(10_000.0, max(2.0, got["chance"] / got["n"] / between - 1))) if between > 0 else 10_000.0


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float, float, float]:
    """scored(host, path, p), p in millionths -> paths with the sums of both levels; the global share; both strengths: of
    hosts around the global share, and of paths around their own host's mean."""
    paths = stored(scored.groupBy("host", "path").agg(F.count("*").alias("n_path"), F.sum("p").alias("s_path")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n_path").alias("n_host"), F.sum("s_path").alias("s_host"), F.count("*").alias("n_paths"))
    hosts = stored(hosts.withColumn("host_key", _site_key("host")).drop("host"), "hosts")
    both = stored(join_heavy(paths.withColumn("host_key", _site_key("host")), hosts.withColumn("rows", F.col("n_paths")), ["host_key"], "rows"), "sites")
    total = hosts.agg(F.sum("n_host").alias("n"), F.sum("s_host").alias("s"), F.count("*").alias("k")).first()
    share = min(1 - 1e-6, max(1e-6, total["s"] / UNIT / total["n"])) if total["n"] else 0.5
    mean = lambda c: F.col(c) / UNIT
    up = [F.lit(float(total["n"] or 1)).alias("n_up"), F.lit(share * (total["n"] or 1)).alias("s_up"), F.lit(max(1, total["k"])).alias("k_up")]
    k_host = _strength(hosts.select(F.col("n_host").alias("n"), mean("s_host").alias("s"), *up))
    k_path = _strength(both.select(F.col("n_path").alias("n"), mean("s_path").alias("s"), F.col("n_host").alias("n_up"), mean("s_host").alias("s_up"), F.col("n_paths").alias("k_up")))
    return both.drop("host_key", "n_paths"), share, k_host, k_path


def _site_key(name: str) -> Column:
    """A key for joins that null has, too."""
    return F.coalesce(F.concat(F.lit("="), F.col(name)), F.lit("-"))


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host: Column | str = "source", path: Column | str = "lang", sample: int = SAMPLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Scores of every document from its evidence, its host and its path.

    Returns a row for each row of docs: <id_col>, evidence (log-odds), host_mean and path_mean (posterior means of the
    share of acceptable documents, without the document itself), score (0 to 1), keep (score >= 0.5), and the columns in
    keep. Null hosts and paths are sites of their own. Null and empty texts are scored by their shape. Every row is scored by
    its own text: null ids (which no label fits), repeats, and several texts of one id. Labels of null quality or id are
    ignored, null toxicity counts as 0, and of several labels of one id the worst counts. With labels of only one class, or
    none, the evidence is 0 and all is kept. A score of exactly 0.5 is kept. An empty table gives an empty result. Other
    columns are not read.
    """
    host, path = (F.col(x) if isinstance(x, str) else x for x in (host, path))
    model = fit(docs, labels, id_col=id_col, text_col=text_col, sample=sample)
    rows = stored(evidence(docs, model, id_col=id_col, text_col=text_col, host=host, path=path, keep=keep), "evidence")
    p = F.round(UNIT / (1 + F.exp(-F.col("e")))).cast("bigint")
    rows = rows.withColumn("p", p)
    sites, share, k_host, k_path = site_posteriors(rows)
    keys = {"__host_key": _site_key("host"), "__path_key": _site_key("path")}
    sites = sites.withColumns({**keys, "rows": F.col("n_path")}).drop("host", "path")
    out = join_heavy(rows.withColumns(keys), sites, list(keys), "rows")
    out = out.withColumn("host_mean", ((F.col("s_host") - F.col("p")) / UNIT + k_host * share) / (F.col("n_host") - 1 + k_host))
    out = out.withColumn("path_mean", ((F.col("s_path") - F.col("p")) / UNIT + k_path * F.col("host_mean")) / (F.col("n_path") - 1 + k_path))
    bounded = F.least(F.greatest("path_mean", F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = F.col("e") + F.log(bounded / (1 - bounded)) - float(np.log(share / (1 - share)))
    out = out.withColumn("score", F.round(1 / (1 + F.exp(-odds)), 9))
    return out.select(F.col("id").alias(id_col), F.col("host"), F.col("path"), F.round("e", 9).alias("evidence"), F.round("host_mean", 9).alias("host_mean"), F.round("path_mean", 9).alias("path_mean"), "score", (F.col("score") >= 0.5).alias("keep"), *(F.col(f"__keep_{c}").alias(c) for c in keep))

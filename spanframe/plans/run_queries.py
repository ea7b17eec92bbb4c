"""Queries of statistics, runs, selection, validation and packets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import hash_draw
from ..operators import alignment as al
from ..operators import packets as pk
from ..operators import runs as rn
from ..operators import stats as st
from ..operators import verdicts as vs
from .registry import register
from .standins import HOUR, duck, standin

_ORDER = ("at_us", "l_linenumber", "l_partkey", "l_suppkey", "cents")
_DRAW = "('0x' || substr(sha256({0}), 1, 8))::BIGINT"


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _attempts(spark, d):
    return standin(spark, d, "attempts")


_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, config ORDER BY at_us DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, cents DESC) AS n, count(*) OVER (PARTITION BY item_id, config) AS n_attempts FROM attempts) WHERE n = 1)"


@register("w07_latest_attempt", duck(f"SELECT item_id, config, completed, at_us, cents, n_attempts FROM {_LATEST}"))
def _(spark, d):
    return rn.latest_attempt(_attempts(spark, d), ("item_id", "config"), _ORDER).select("item_id", "config", "completed", "at_us", "cents", "n_attempts")


@register("s14_upsert_results", duck("SELECT item_id, config, completed, at_us, cents FROM (SELECT *, row_number() OVER (PARTITION BY item_id, config ORDER BY completed DESC, at_us DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, cents DESC) AS n FROM attempts) WHERE n = 1"))
def _(spark, d):
    a = _attempts(spark, d)
    return rn.upsert_results(a.where("l_linenumber % 2 = 0"), a.where("l_linenumber % 2 = 1"), ("item_id", "config"), order=_ORDER).select("item_id", "config", "completed", "at_us", "cents")


@register("s15_resume_pending", duck("SELECT o_orderkey AS item_id FROM orders WHERE o_orderkey NOT IN (SELECT item_id FROM attempts WHERE completed)"))
def _(spark, d):
    plan = _t(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"))
    return rn.resume_pending(plan, _attempts(spark, d), ["item_id"], usable=F.col("completed"))


@register("j10_decide", duck(f"SELECT o_orderkey AS item_id, c.config, l.completed AS alert FROM orders CROSS JOIN (SELECT unnest(['A', 'N', 'R']) AS config) c LEFT JOIN {_LATEST} l ON l.item_id = o_orderkey AND l.config = c.config"))
def _(spark, d):
    items = _t(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"))
    configs = spark.createDataFrame([("A",), ("N",), ("R",)], "config string")
    results = rn.latest_attempt(_attempts(spark, d), ("item_id", "config"), _ORDER).select("item_id", "config", F.col("completed").alias("alert"))
    return rn.decide(items, configs, results)


_PAIRS = f"(SELECT a.item_id, a.completed AS first, b.completed AS second FROM {_LATEST} a JOIN {_LATEST} b ON a.item_id = b.item_id WHERE a.config = 'A' AND b.config = 'R')"


def _pairs(spark, d):
    last = rn.latest_attempt(_attempts(spark, d), ("item_id", "config"), _ORDER)
    one = lambda c, n: last.where(F.col("config") == c).select("item_id", F.col("completed").alias(n))
    return one("A", "first").join(one("R", "second"), "item_id")


@register("j11_paired", duck(f"SELECT * FROM {_PAIRS}"))
def _(spark, d):
    return _pairs(spark, d)


@register("b07_paired_agreement", duck(f'SELECT count(*) FILTER (first AND second) AS "both", count(*) FILTER (first AND NOT second) AS first_only, count(*) FILTER (NOT first AND second) AS second_only, count(*) FILTER (NOT first AND NOT second) AS neither, round((count(*) FILTER (NOT first AND second) - count(*) FILTER (first AND NOT second)) / count(*), 9) AS difference FROM {_PAIRS}'))
def _(spark, d):
    return st.paired_agreement(_pairs(spark, d)).withColumn("difference", F.round("difference", 9))


@register("b04_mcnemar", "SELECT b, c, round(CASE WHEN b + c > 0 THEN least(1.0, 2 * list_sum(list_transform(range(least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))) END, 4) AS p FROM (SELECT DISTINCT (o_orderkey % 13)::BIGINT AS b, (o_custkey % 17)::BIGINT AS c FROM orders)")
def _(spark, d):
    rows = _t(spark, d, "orders").select((F.col("o_orderkey") % 13).alias("b"), (F.col("o_custkey") % 17).alias("c")).distinct()
    return rows.withColumn("p", F.round(st.mcnemar(F.col("b"), F.col("c")), 4))


@register("w08_holm", "SELECT name, CASE WHEN p IS NOT NULL THEN round(max(raw) OVER (PARTITION BY p IS NULL ORDER BY p, name), 9) END AS adjusted FROM (SELECT *, least(1.0, (count(p) OVER (PARTITION BY p IS NULL) - row_number() OVER (PARTITION BY p IS NULL ORDER BY p, name) + 1) * p) AS raw FROM (SELECT p_partkey AS name, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE ((p_partkey * 37) % 1000) / 100000.0 END AS p FROM part))")
def _(spark, d):
    n = F.col("p_partkey")
    rows = _t(spark, d, "part").select(n.alias("name"), F.when(n % 9 != 0, n * 37 % 1000 / 100000.0).alias("p"))
    return st.holm(rows).select("name", F.round("adjusted", 9).alias("adjusted"))


_G = "g AS (SELECT group_id, count(*) FILTER (toxic = 1) AS k, count(*) AS n, row_number() OVER (ORDER BY group_id) - 1 AS gi, count(*) OVER () AS ng FROM items GROUP BY group_id)"


@register("b05_grouped_bootstrap", duck(f"SELECT round(quantile_cont(v, 0.025), 9) AS low, round(quantile_cont(v, 0.975), 9) AS high, count(*) FILTER (v IS NULL) AS n_undefined, count(*) AS n_resamples FROM (SELECT r, sum(k) / nullif(sum(n), 0) AS v FROM (SELECT r, i, {_DRAW.format(chr(39) + 'seed|' + chr(39) + ' || r || ' + chr(39) + '|' + chr(39) + ' || i')} % (SELECT max(ng) FROM g) AS pick FROM (SELECT unnest(range(1, 201)) AS r) CROSS JOIN (SELECT unnest(range(1, (SELECT max(ng) FROM g) + 1)) AS i)) JOIN g ON gi = pick GROUP BY r)", _G))
def _(spark, d):
    groups = standin(spark, d, "items").groupBy("group_id").agg(F.count_if(F.col("toxic") == 1).alias("k"), F.count("*").alias("n"))
    out = st.grouped_bootstrap(groups, ["k", "n"], F.try_divide(F.col("k").cast("double"), F.col("n").cast("double")), resamples=200, seed="seed")
    return out.withColumns({c: F.round(c, 9) for c in ("low", "high")})


@register("b08_guard_interval", duck("SELECT group_id, CASE WHEN k = 0 THEN 'withheld' WHEN k < 5 THEN 'caution' ELSE 'shown' END AS state, round(pow(1 - k / n, n), 9) AS p_none FROM (SELECT group_id, count(*)::DOUBLE AS n, count(*) FILTER (toxic = 1) AS k FROM items GROUP BY 1)"))
def _(spark, d):
    rows = standin(spark, d, "items").groupBy("group_id").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("k"))
    x = st.guard_interval(F.col("n"), F.col("k"))
    return rows.select("group_id", x["state"].alias("state"), F.round(x["p_none"], 9).alias("p_none"))


_LABEL = "(SELECT group_id, CASE WHEN item_id % 11 = 0 THEN 'uncertain' WHEN toxic = 1 THEN 'positive' ELSE 'negative' END AS label, CASE WHEN item_id % 13 = 0 THEN NULL ELSE n_chars > 1500 END AS alert FROM items)"
_CONF = f"cf AS (SELECT group_id, count(*) FILTER (label = 'positive' AND alert) AS tp, count(*) FILTER (label = 'negative' AND alert) AS fp, count(*) FILTER (label = 'positive' AND NOT alert) AS fn, count(*) FILTER (label = 'negative' AND NOT alert) AS tn, count(*) FILTER (label = 'uncertain') AS n_uncertain, count(*) FILTER (label <> 'uncertain' AND alert IS NULL) AS n_missing FROM {_LABEL} GROUP BY 1)"


def _confusion(spark, d):
    n = F.col("item_id")
    label = F.when(n % 11 == 0, "uncertain").when(F.col("toxic") == 1, "positive").otherwise("negative")
    rows = standin(spark, d, "items").withColumns({"label": label, "alert": F.when(n % 13 != 0, F.col("n_chars") > 1500)})
    return rows


@register("b01_alerts", duck("SELECT media_id, coalesce(bool_or(NOT scene AND a >= 0.3), false) AS alert, count(*) FILTER (scene) AS n_fallback FROM samples GROUP BY 1"))
def _(spark, d):
    rows = standin(spark, d, "samples").select("media_id", F.col("a").alias("score"), F.col("scene").alias("fallback"))
    return st.score_alert(rows, 0.3, ["media_id"])


@register("b02_confusion", duck("SELECT * FROM cf", _CONF))
def _(spark, d):
    return st.confusion(_confusion(spark, d), ["group_id"])


@register("b03_classification_metrics", duck("SELECT group_id, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall, round(tn / nullif(tn + fp, 0), 9) AS specificity, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 9) AS accuracy FROM cf", _CONF))
def _(spark, d):
    out = st.classification_metrics(st.confusion(_confusion(spark, d), ["group_id"]))
    return out.select("group_id", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "specificity", "f1", "accuracy")])


@register("b09_score_report", duck("SELECT group_id, n_missing = 0 AS complete, CASE WHEN n_missing = 0 THEN round(tp / nullif(tp + fp, 0), 9) END AS precision, CASE WHEN n_missing = 0 THEN round(tn / nullif(tn + fp, 0), 9) END AS specificity, tp + fp AS n_alerts, CASE WHEN n_missing > 0 THEN 'reference labels do not cover every item' END AS withheld, CASE WHEN tp + fn = 0 THEN 'no positive labels: specificity and false alerts at most' END AS scope FROM cf", _CONF))
def _(spark, d):
    out = st.classification_metrics(st.confusion(_confusion(spark, d), ["group_id"]))
    out = st.score_report(out, F.col("n_missing") == 0, positives=F.col("tp") + F.col("fn"))
    return out.select("group_id", "complete", F.round("precision", 9).alias("precision"), F.round("specificity", 9).alias("specificity"), (F.col("tp") + F.col("fp")).alias("n_alerts"), "withheld", "scope")


@register("a08_distribution", duck("SELECT media_id, count(*) AS n, round(sum(a), 6) AS total, min(a)::DOUBLE AS least, round(median(a), 9) AS median, max(a) FILTER (r = round_even(0.9 * (n - 1), 0) + 1)::DOUBLE AS p90, max(a)::DOUBLE AS most, round(avg(a), 9) AS mean FROM (SELECT media_id, a::DOUBLE AS a, row_number() OVER (PARTITION BY media_id ORDER BY a) AS r, count(*) OVER (PARTITION BY media_id) AS n FROM samples) GROUP BY 1"))
def _(spark, d):
    rows = standin(spark, d, "samples").withColumn("a", F.col("a").cast("double"))
    out = st.nearest_rank_summary(rows, "a", ["media_id"])
    return out.withColumns({"total": F.round("total", 6), "median": F.round("median", 9), "mean": F.round("mean", 9)})


@register("a09_runtime_summary", "SELECT l_returnflag, count(*) AS n_runs, median(l_extendedprice) AS median, round(sum(l_extendedprice) / sum(l_quantity), 6) AS pooled_rtf, max(l_tax) AS peak, round(quantile_cont(l_extendedprice, 0.5) * 0 + q3 - q1, 4) AS iqr FROM lineitem JOIN (SELECT l_returnflag AS f, max(p) FILTER (r = floor(0.25 * (n + 1))) + (max(p) FILTER (r = floor(0.25 * (n + 1)) + 1) - max(p) FILTER (r = floor(0.25 * (n + 1)))) * (0.25 * (max(n) + 1) - floor(0.25 * (max(n) + 1))) AS q1, max(p) FILTER (r = floor(0.75 * (n + 1))) + (max(p) FILTER (r = floor(0.75 * (n + 1)) + 1) - max(p) FILTER (r = floor(0.75 * (n + 1)))) * (0.75 * (max(n) + 1) - floor(0.75 * (max(n) + 1))) AS q3 FROM (SELECT l_returnflag, l_extendedprice AS p, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) GROUP BY 1) ON f = l_returnflag GROUP BY l_returnflag, q1, q3")
def _(spark, d):
    out = st.runtime_summary(_t(spark, d, "lineitem"), ["l_returnflag"], compute="l_extendedprice", media="l_quantity", peak="l_tax")
    return out.withColumns({"pooled_rtf": F.round("pooled_rtf", 6), "iqr": F.round("iqr", 4)})


@register("a10_latency_by_group", "SELECT l_linenumber, median(l_quantity) AS p50, quantile_cont(l_quantity, 0.9) AS p90, quantile_cont(l_quantity, 0.95) AS p95, round(avg(l_quantity), 9) AS mean, max(l_quantity) AS most FROM lineitem GROUP BY 1")
def _(spark, d):
    rows = _t(spark, d, "lineitem")
    out = vs.latency_by_group(rows, ["l_linenumber"], seconds="l_quantity")
    return out.select("l_linenumber", "p50", "p90", "p95", F.round("mean", 9).alias("mean"), "most")


@register("a12_reliability_rollup", duck("SELECT CASE grouping(config, l_linenumber) WHEN 1 THEN 'config' WHEN 2 THEN 'l_linenumber' ELSE 'all' END AS level, coalesce(config, l_linenumber::VARCHAR) AS value, count(*) AS n, count(*) FILTER (completed) AS n_completed, count(*) FILTER (NOT completed) AS n_failed FROM attempts GROUP BY GROUPING SETS ((config), (l_linenumber), ())"))
def _(spark, d):
    return rn.reliability_rollup(_attempts(spark, d), "config", "l_linenumber")


@register("a13_collapse_diagnostics", "SELECT l_suppkey, n_distinct, modal, round(n / total, 9) AS share, n / total >= 0.3 AS collapsed FROM (SELECT l_suppkey, count(*) AS n_distinct, arg_max(f, (n, -seen)) AS modal, max(n) AS n, sum(n) AS total FROM (SELECT l_suppkey, l_returnflag AS f, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS seen FROM lineitem GROUP BY 1, 2) GROUP BY 1)")
def _(spark, d):
    rows = _t(spark, d, "lineitem").withColumn("seq", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return st.collapse_diagnostics(rows, "l_returnflag", "seq", ["l_suppkey"], limit=0.3).withColumn("share", F.round("share", 9))


@register("a18_benchmark_aggregate", "SELECT l_linestatus, count(*) AS n_runs, count(*) FILTER (l_discount > 0.02) AS n_valid, count(*) FILTER (NOT l_discount > 0.02) AS n_invalid, median(l_extendedprice::DOUBLE) FILTER (l_discount > 0.02) AS median_wall_us, min(l_extendedprice::DOUBLE) FILTER (l_discount > 0.02) AS least_wall_us, max(l_extendedprice::DOUBLE) FILTER (l_discount > 0.02) AS most_wall_us, round(median(l_quantity::DOUBLE / l_extendedprice::DOUBLE) FILTER (l_discount > 0.02), 9) AS median_throughput FROM lineitem GROUP BY 1")
def _(spark, d):
    rows = _t(spark, d, "lineitem").select("l_linestatus", F.col("l_extendedprice").cast("double").alias("wall_us"), F.col("l_quantity").cast("double").alias("media_us"), (F.col("l_discount") > 0.02).alias("valid"))
    return rn.benchmark_aggregate(rows, ["l_linestatus"]).withColumn("median_throughput", F.round("median_throughput", 9))


@register("a19_disposition_stats", duck("SELECT media_id, count(*) AS n, count(*) FILTER (sample_id % 2 = 0) AS n_temporal, count(*) FILTER (scene) AS n_scene, count(*) FILTER (event_type = 'error') AS n_black, count(*) FILTER (event_type = 'view') AS n_duplicates, count(*) FILTER (event_type = 'purchase') AS n_static, count(*) FILTER (event_type = 'signup') AS n_representatives, count(*) FILTER (event_type IN ('error', 'view', 'purchase', 'signup')) = count(*) AS accounted FROM samples GROUP BY 1"))
def _(spark, d):
    kind = F.when(F.col("event_type") == "error", "black").when(F.col("event_type") == "view", "near_duplicate").when(F.col("event_type") == "purchase", "static_suppressed").when(F.col("event_type") == "signup", "representative")
    reasons = F.array_compact(F.array(F.when(F.col("sample_id") % 2 == 0, "temporal"), F.when(F.col("scene"), "scene")))
    return rn.disposition_stats(standin(spark, d, "samples").withColumns({"disposition": kind, "reasons": reasons}), ["media_id"])


@register("a25_job_state", duck("SELECT media_id, arg_max(st, sample_id) AS status, min(ts_us) FILTER (st = 'processing') AS started_us, max(ts_us) FILTER (st IN ('completed', 'failed', 'cancelled')) AS ended_us, count(*) AS n_events FROM (SELECT *, CASE event_type WHEN 'click' THEN 'processing' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'queued' END AS st FROM samples) GROUP BY 1"))
def _(spark, d):
    e = F.col("event_type")
    status = F.when(e == "click", "processing").when(e == "error", "failed").when(e == "purchase", "completed").otherwise("queued")
    rows = standin(spark, d, "samples").withColumns({"status": status, "at_us": F.col("ts_us")})
    return rn.job_state(rows, ["media_id"], seq="sample_id")


@register("a29_batch_occupancy", duck("SELECT media_id, (n + 7) // 8 AS n_batches, n // 8 AS n_full, CASE WHEN n % 8 = 0 THEN 8 ELSE n % 8 END AS last_size, round(n / ((n + 7) // 8 * 8), 9) AS occupancy FROM (SELECT media_id, count(*) AS n FROM samples GROUP BY 1)"))
def _(spark, d):
    out = vs.batch_occupancy(standin(spark, d, "samples"), ["media_id"], 8)
    return out.select("media_id", "n_batches", "n_full", "last_size", F.round("occupancy", 9).alias("occupancy"))


def _two_sides(spark, d):
    s = standin(spark, d, "samples").withColumns({c: F.col(c).cast("double") for c in "ab"})
    return s.where("sample_id % 11 <> 0").select("media_id", "sample_id", "ts_us", "a"), s.where("sample_id % 13 <> 0").select("media_id", "sample_id", (F.col("ts_us") + F.when(F.col("sample_id") % 17 == 0, 5).otherwise(0)).alias("ts_us"), "b")


@register("j01_align_by_id", duck("SELECT media_id, sample_id, ts_us, a::DOUBLE AS a, b::DOUBLE AS b, sample_id % 17 <> 0 AS same_time FROM samples WHERE sample_id % 11 <> 0 AND sample_id % 13 <> 0"))
def _(spark, d):
    return al.align_by_id(*_two_sides(spark, d))[0]


@register("j01b_alignment_audit", duck("SELECT count(*) FILTER (l) AS n_left, count(*) FILTER (r) AS n_right, count(*) FILTER (l AND NOT r) AS left_only, count(*) FILTER (r AND NOT l) AS right_only, 0::BIGINT AS repeated, count(*) FILTER (l AND r AND sample_id % 17 = 0) AS moved, false AS exact FROM (SELECT sample_id, sample_id % 11 <> 0 AS l, sample_id % 13 <> 0 AS r FROM samples)"))
def _(spark, d):
    return al.align_by_id(*_two_sides(spark, d))[1]


@register("j12_disjoint", "SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0 AND (o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 10 = 0) OR o_totalprice IN (SELECT o_totalprice FROM orders WHERE o_orderkey % 10 = 0))")
def _(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return rn.disjoint(o.where("o_orderkey % 10 <> 0"), o.where("o_orderkey % 10 = 0"), ["o_custkey", "o_totalprice"]).select("o_orderkey")


@register("j20_attempt_outcome", duck("SELECT coalesce(w.k, p.k) AS item_id, CASE WHEN coalesce(p.i, false) THEN p.s WHEN w.s IS NOT NULL THEN w.s ELSE coalesce(p.s, 'failed') END AS status FROM (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 3 > 0) w FULL JOIN (SELECT o_orderkey AS k, o_orderpriority AS s, o_orderkey % 7 = 0 AS i FROM orders WHERE o_orderkey % 5 > 0) p ON w.k = p.k"))
def _(spark, d):
    o = _t(spark, d, "orders").withColumnRenamed("o_orderkey", "item_id")
    w = o.where("item_id % 3 > 0").select("item_id", F.col("o_orderstatus").alias("status"))
    p = o.where("item_id % 5 > 0").select("item_id", F.col("o_orderpriority").alias("status"), (F.col("item_id") % 7 == 0).alias("intervened"))
    return rn.attempt_outcome(w, p, ["item_id"])


@register("u03_intersect_items", duck("SELECT item_id FROM attempts WHERE config = 'A' INTERSECT SELECT item_id FROM attempts WHERE config = 'R'"))
def _(spark, d):
    a = _attempts(spark, d)
    return a.where("config = 'A'").select("item_id").intersect(a.where("config = 'R'").select("item_id"))


@register("u04_except_items", duck("SELECT o_orderkey AS item_id FROM orders EXCEPT SELECT item_id FROM attempts"))
def _(spark, d):
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("item_id")).subtract(_attempts(spark, d).select("item_id"))


@register("u05_set_equal", duck("(SELECT item_id, 'first' AS side FROM attempts WHERE config = 'A' AND item_id NOT IN (SELECT item_id FROM attempts WHERE config = 'R')) UNION (SELECT item_id, 'second' FROM attempts WHERE config = 'R' AND item_id NOT IN (SELECT item_id FROM attempts WHERE config = 'A'))"))
def _(spark, d):
    a = _attempts(spark, d)
    return rn.set_difference(a.where("config = 'A'").select("item_id"), a.where("config = 'R'").select("item_id"))


@register("hash_draw", f"SELECT o_orderkey, {_DRAW.format(chr(39) + 'x|' + chr(39) + ' || o_orderkey')} AS draw FROM orders")
def _(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", hash_draw(F.lit("x"), F.col("o_orderkey").cast("string")).alias("draw"))


@register("p05_by_label", "SELECT event_id, value FROM events WHERE event_type = 'error' AND value >= 20 AND value IS NOT NULL")
def _(spark, d):
    rows = vs.results_lookup(_t(spark, d, "events"), where=F.col("event_type") == "error", order=["event_id"], least=("value", 20))
    return rows.select("event_id", "value")


@register("p06_find_by_path", "SELECT lower(regexp_extract(url, '^https?://([^/]+)', 1)) AS host, min(page_id) AS page_id FROM pages GROUP BY 1")
def _(spark, d):
    rows = _t(spark, d, "pages").withColumn("host", F.regexp_extract("url", "^https?://([^/]+)", 1))
    return vs.oldest_by_path(rows, "host", "page_id", "page_id")


@register("p09_check_constraints", "SELECT o_orderkey, list_filter([CASE WHEN o_totalprice < 10000 THEN 'price' END, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'status' END], lambda x: x IS NOT NULL) AS problems FROM orders WHERE o_totalprice < 10000 OR o_orderstatus NOT IN ('O', 'F')", arrays=("problems",))
def _(spark, d):
    rules = {"price": F.col("o_totalprice") >= 10000, "status": F.col("o_orderstatus").isin("O", "F")}
    return rn.check_rules(_t(spark, d, "orders"), rules, "quarantine").select("o_orderkey", "problems")


@register("p13_derive_label", duck("SELECT item_id, CASE WHEN item_id % 10 = 0 THEN 'excluded' WHEN toxic = 1 THEN 'positive' WHEN item_id % 7 = 0 THEN 'undecided' WHEN quality = 0 THEN 'uncertain' ELSE 'negative' END AS derived FROM items"))
def _(spark, d):
    rows = standin(spark, d, "items").withColumn("excluded", F.col("item_id") % 10 == 0)
    states = F.create_map(F.lit("a"), F.when(F.col("toxic") == 1, "present").otherwise("absent"), F.lit("b"), F.when(F.col("item_id") % 7 != 0, "absent"), F.lit("c"), F.when(F.col("quality") == 0, "uncertain").otherwise("absent"))
    return rn.label_cascade(rows, states).select("item_id", "derived")


@register("p21_gate", duck("SELECT media_id, sample_id FROM samples WHERE (SELECT avg(scene::INT) FROM samples) > 0.1 AND scene"))
def _(spark, d):
    s = standin(spark, d, "samples")
    summary = s.agg(F.avg(F.col("scene").cast("int")).alias("rate"))
    return vs.gate(s.where("scene").select("media_id", "sample_id"), summary, F.col("rate") > 0.1)


@register("p24_completeness", duck(f"SELECT p.media_id, last_us, range_us, duration_us - last_us > {HOUR} AS incomplete, coalesce(range_us > 1000, false) AS variable FROM (SELECT media_id, max(pts_us) AS last_us, max(g) - min(g) AS range_us FROM (SELECT *, lead(pts_us) OVER (PARTITION BY media_id ORDER BY pts_us) - pts_us AS g FROM packets) GROUP BY 1) p JOIN media m ON p.media_id = m.media_id"))
def _(spark, d):
    out = pk.completeness(standin(spark, d, "packets"), standin(spark, d, "media").drop("origin_us"), tol=HOUR, spacing=1000)
    return out.select("media_id", "last_us", "range_us", "incomplete", "variable")


@register("t04_recent", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def _(spark, d):
    return rn.recent(_t(spark, d, "orders"), ("o_orderdate", "o_orderkey"), 50).select("o_orderkey")


@register("t09_recent_distinct", "SELECT o_custkey, o_orderpriority, last, place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY last DESC, o_orderpriority) AS place FROM (SELECT o_custkey, o_orderpriority, max(o_orderkey) AS last FROM orders GROUP BY 1, 2)) WHERE place <= 2")
def _(spark, d):
    return rn.recent_distinct(_t(spark, d, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey", 2)


@register("w09_ordinal_ids", duck("SELECT media_id, interval_id, printf('event:%04d', row_number() OVER (PARTITION BY media_id ORDER BY start_us, interval_id) - 1) AS id FROM truth"))
def _(spark, d):
    return vs.ordinal_ids(standin(spark, d, "truth"), ["start_us", "interval_id"]).select("media_id", "interval_id", "id")


@register("w11_label_disambiguation", "SELECT o_orderkey, CASE WHEN a = 1 THEN o_orderpriority WHEN b = 1 THEN o_orderpriority || ' (' || o_orderstatus || ')' ELSE o_orderpriority || ' (' || o_orderstatus || ') ' || r END AS shown FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS a, count(*) OVER (PARTITION BY o_custkey, o_orderpriority, o_orderstatus) AS b, row_number() OVER (PARTITION BY o_custkey, o_orderpriority, o_orderstatus ORDER BY o_orderkey) AS r FROM orders)")
def _(spark, d):
    return rn.disambiguate_labels(_t(spark, d, "orders"), ["o_custkey"], "o_orderpriority", "o_orderstatus", "o_orderkey").select("o_orderkey", "shown")


@register("w12_min_gap_violations", duck(f"SELECT media_id, interval_id FROM (SELECT *, lag(end_us) OVER (PARTITION BY media_id, category ORDER BY start_us, interval_id) AS p FROM truth) WHERE start_us - p < {2 * HOUR}"))
def _(spark, d):
    return vs.min_gap_violations(standin(spark, d, "truth"), 2 * HOUR, ["media_id", "category"]).select("media_id", "interval_id")


@register("w04_frame_durations", duck("SELECT media_id, decode_pos, coalesce(dd, m) AS duration_us FROM (SELECT *, lead(pts_us) OVER (PARTITION BY media_id ORDER BY pts_us) - pts_us AS dd FROM packets) p JOIN (SELECT media_id AS k, list_sort(list(g))[len(list(g)) // 2 + 1] AS m FROM (SELECT media_id, lead(pts_us) OVER (PARTITION BY media_id ORDER BY pts_us) - pts_us AS g FROM packets) WHERE g IS NOT NULL GROUP BY 1) ON k = media_id"))
def _(spark, d):
    return pk.frame_durations(standin(spark, d, "packets")).select("media_id", "decode_pos", "duration_us")


_CUTS = "(SELECT media_id, decode_pos AS cut_id, pts_us AS cut_us FROM packets WHERE decode_pos % 25 = 0)"


@register("w10_clean_cut_point", duck(f"SELECT c.media_id, cut_id, coalesce(max(decode_pos) FILTER (pts_us < cut_us) < min(decode_pos) FILTER (pts_us >= cut_us), true) AND coalesce(arg_min(is_key, decode_pos) FILTER (pts_us >= cut_us), true) AS clean FROM {_CUTS} c JOIN packets p ON c.media_id = p.media_id GROUP BY 1, 2"))
def _(spark, d):
    p = standin(spark, d, "packets")
    cuts = p.where("decode_pos % 25 = 0").select("media_id", F.col("decode_pos").alias("cut_id"), F.col("pts_us").alias("cut_us"))
    return pk.clean_cut_point(p, cuts)


def _export(p):
    return p.where("decode_pos % 40 <> 7").withColumn("data_hash", F.when(F.col("decode_pos") % 31 == 0, "x").otherwise(F.col("data_hash")))


_EXP = "exported AS (SELECT media_id, decode_pos, pts_us, is_key, CASE WHEN decode_pos % 31 = 0 THEN 'x' ELSE data_hash END AS data_hash FROM packets WHERE decode_pos % 40 <> 7)"


@register("j17_packet_equality", duck("SELECT coalesce(s.media_id, e.media_id) AS media_id, count(s.pts_us) AS n_src, count(e.pts_us) AS n_dst, count(*) FILTER (s.data_hash IS DISTINCT FROM e.data_hash) AS n_off FROM packets s FULL JOIN exported e ON s.media_id = e.media_id AND s.decode_pos = e.decode_pos GROUP BY 1", _EXP))
def _(spark, d):
    p = standin(spark, d, "packets")
    return pk.packet_equality(p, _export(p), tol=0)


@register("w05_timeline_mismatch", duck("SELECT coalesce(a.media_id, b.media_id) AS media_id, coalesce(a.place, b.place) AS place, got_us, want_us FROM (SELECT media_id, row_number() OVER w AS place, lead(pts_us) OVER w - pts_us AS got_us FROM exported WINDOW w AS (PARTITION BY media_id ORDER BY pts_us)) a FULL JOIN (SELECT media_id, row_number() OVER w AS place, lead(pts_us) OVER w - pts_us AS want_us FROM packets WINDOW w AS (PARTITION BY media_id ORDER BY pts_us)) b ON a.media_id = b.media_id AND a.place = b.place WHERE a.media_id IS NULL OR b.media_id IS NULL OR abs(got_us - want_us) > 1000", _EXP))
def _(spark, d):
    p = standin(spark, d, "packets")
    return pk.timeline_mismatch(_export(p), p, tol=1000)


@register("w13_first_mismatch", duck("SELECT media_id, min(place) AS place FROM (SELECT coalesce(a.media_id, b.media_id) AS media_id, coalesce(a.place, b.place) AS place, a.s AS x, b.s AS y FROM (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY pts_us) AS place, CASE WHEN is_key THEN 'key' ELSE data_hash END AS s FROM packets) a FULL JOIN (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY pts_us) AS place, CASE WHEN is_key THEN 'key' ELSE data_hash END AS s FROM exported) b ON a.media_id = b.media_id AND a.place = b.place) WHERE x IS DISTINCT FROM y GROUP BY 1", _EXP))
def _(spark, d):
    p = standin(spark, d, "packets")
    return pk.first_mismatch(p, _export(p)).select("media_id", "place")


@register("w14_frame_aligned_ranges", duck("SELECT media_id, interval_id, s AS frame_start_us, coalesce(e, end_us) AS frame_end_us FROM (SELECT t.*, (SELECT min(ts_us) FROM samples x WHERE x.media_id = t.media_id AND ts_us >= t.start_us) AS s, (SELECT min(ts_us) FROM samples x WHERE x.media_id = t.media_id AND ts_us >= t.end_us) AS e FROM truth t) WHERE s < coalesce(e, end_us)"))
def _(spark, d):
    frames = standin(spark, d, "samples").select("media_id", F.col("ts_us").alias("pts_us"))
    return pk.frame_aligned_ranges(standin(spark, d, "truth"), frames).select("media_id", "interval_id", "frame_start_us", "frame_end_us")


@register("a20_removal_report", duck("""SELECT p.media_id, n_doubled, monotonic, coalesce(n_leaked, 0) AS n_leaked, coalesce(n_leaked_runs, 0) AS n_leaked_runs, coalesce(n_missing, 0) AS n_missing FROM (SELECT media_id, count(*) - count(DISTINCT f) AS n_doubled, count(*) FILTER (f < pf) = 0 AS monotonic FROM (SELECT *, lag(f) OVER (PARTITION BY media_id ORDER BY decode_pos) AS pf FROM (SELECT media_id, decode_pos, pts_us // 80000 AS f FROM packets)) GROUP BY 1) p
 LEFT JOIN (SELECT media_id, count(*) AS n_leaked, count(DISTINCT g) AS n_leaked_runs FROM (SELECT *, f - row_number() OVER (PARTITION BY media_id ORDER BY f) AS g FROM (SELECT DISTINCT media_id, pts_us // 80000 AS f FROM packets) WHERE f % 5 = 0 OR f % 5 = 1) GROUP BY 1) l ON l.media_id = p.media_id LEFT JOIN (SELECT 0 AS media_id, 0 AS n_missing WHERE false) m ON m.media_id = p.media_id"""))
def _(spark, d):
    exported = standin(spark, d, "packets").select("media_id", F.col("decode_pos").alias("place"), F.expr("pts_us div 80000").alias("frame"))
    expected = exported.where("frame % 5 > 1").select("media_id", "frame").distinct()
    return pk.removal_report(expected, exported)
